"""The registered queries of this subpackage and, where SQL expresses them, their oracle SQL."""

from __future__ import annotations

from quern.session import table


def op1_line_dedup(spark, sf_dir):
    from quern.llm.lines import line_classes

    return line_classes(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark, sf_dir):
    from quern.llm.near import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op3_toxicity(spark, sf_dir):
    from quern.llm.toxicity import judge

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op4_document_fingerprints(spark, sf_dir):
    from quern.llm.fingerprint import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_url_filters(spark, sf_dir):
    from quern.llm.urlrules import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark, sf_dir):
    from quern.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark, sf_dir):
    from quern.llm.wrappers import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark, sf_dir):
    from quern.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark, sf_dir):
    from quern.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark, sf_dir):
    from quern.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def queries():
    return {f.__name__: f for f in (op1_line_dedup, op2_minhash_near_dedup, op3_toxicity, op4_document_fingerprints, op5_url_filters, op6_benchmark_decontamination, op7_html_extraction, op8_language_id, op9_best_fit_packing, op10_chat_formatting)}


def oracle_sql():
    from quern.llm import oracles

    return {name: getattr(oracles, name) for name in queries() if hasattr(oracles, name)}
