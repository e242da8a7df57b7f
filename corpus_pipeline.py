"""A pretraining-corpus pipeline: language ID, line dedup, near dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a frame. All but the last return the columns of
their input; the last returns packed pieces. ``run`` writes each stage's result to the shared folder and
reads it back for the next. No stage is expressible in one SQL statement (trained models, an iterative
union-find, a tokenizer), so ORACLE_SQL is None and the tests hold ``run`` against brute force.
"""

from __future__ import annotations

from quern.functions.storage import materialise
from quern.llm.decontam import decontaminate
from quern.llm.langid import keep_identified
from quern.llm.lines import dedup_lines
from quern.llm.near import drop_near_duplicates
from quern.llm.packing import pack
from quern.session import importable, table


def language_id(spark, docs, sf_dir):
    """Documents whose language one of the models accepts."""
    importable(spark)
    return keep_identified(docs)


def line_dedup(spark, docs, sf_dir):
    """Documents with one line of each class of near-equal lines left in the corpus."""
    importable(spark)
    return dedup_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each class of near-equal documents (five-word shingles, Jaccard 0.8)."""
    importable(spark)
    return drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold no copy, whole or edited, of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """Pieces of at most 2048 tokens with their sequence and offset."""
    importable(spark)
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply STAGES to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
