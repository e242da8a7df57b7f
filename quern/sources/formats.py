"""Text, JSON and binary formats of collections, queries, judgements, runs, logs and vectors.

Readers check what a format promises and fail on rows that break it; writers are their inverse. All of them are Spark
scans and sinks, so a path may be a folder of any size.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import tsv_safe

EVENT_SCHEMA = """kind string, server_ts timestamp, type string, session_id string, request_id string, query string, doc_id long, rank long, dwell_ms long,
experiment_id string, variant string, team string, client_ts timestamp, interleaved boolean, simulated boolean, click_model string,
results array<struct<doc_id: long, rank: int, team: string>>"""


def _checked(rows: DataFrame, test, message: str) -> DataFrame:
    """``rows``; reading a row that fails ``test`` raises."""
    return rows.filter(F.when(test, True).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.coalesce("value", F.lit("null")))).cast("boolean")))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of ``pid <tab> text`` lines; a carriage return at the end goes, a bad pid raises."""
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", "")).filter("value <> ''")
    good = _checked(lines, F.col("value").rlike(r"^[0-9]+\t"), "not a collection line")
    return good.select(F.substring_index("value", "\t", 1).cast("long").alias("doc_id"), F.expr("substring(value, instr(value, '\\t') + 1)").alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, text; only the first tab separates."""
    good = _checked(spark.read.text(path).filter("value <> ''"), F.instr("value", "\t") > 1, "not a query line")
    return good.select(F.substring_index("value", "\t", 1).alias("qid"), F.expr("substring(value, instr(value, '\\t') + 1)").alias("text"))


def write_tsv(df: DataFrame, path: str, key: str, text: str = "text") -> None:
    df.select(F.concat_ws("\t", F.col(key).cast("string"), tsv_safe(F.col(text)))).write.text(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, grade of four-column lines."""
    rows = spark.read.text(path).filter("trim(value) <> ''").withColumn("p", F.split(F.trim("value"), r"\s+"))
    good = _checked(rows, F.size("p") == 4, "a judgement has four columns")
    return good.select(F.col("p")[0].alias("qid"), F.col("p")[2].alias("doc_id"), F.col("p")[3].cast("int").alias("grade"))


def write_qrels(qrels: DataFrame, path: str) -> None:
    ordered = qrels.orderBy(F.col("qid").cast("long"), F.col("doc_id").cast("long"))
    ordered.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("0"), F.col("doc_id").cast("string"), F.col("grade").cast("string"))).write.text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, file_rank, score, tag of six-column run lines."""
    rows = spark.read.text(path).filter("trim(value) <> ''").withColumn("p", F.split(F.trim("value"), r"\s+"))
    good = _checked(rows, F.size("p") == 6, "a run line has six columns")
    p = F.col("p")
    return good.select(p[0].alias("qid"), p[2].alias("doc_id"), p[3].cast("long").alias("file_rank"), p[4].cast("double").alias("score"), p[5].alias("tag"))


def ranked(run: DataFrame, by: str = "score") -> DataFrame:
    """``run`` with ``rank``: by score (then numeric ids before others, ascending) or in file order."""
    numeric = F.col("doc_id").rlike("^[0-9]+$")
    order = [F.asc("file_rank")] if by == "file" else [F.desc("score"), numeric.desc(), F.when(numeric, F.col("doc_id")).try_cast("long"), F.col("doc_id")]
    return run.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order)))


def write_run(run: DataFrame, path: str, tag: str = "quern", exact: bool = False) -> None:
    """Six-column lines. ``exact`` prints -rank as the score, so that any evaluator's own sort keeps this order."""
    score = (-F.col("rank")).cast("double") if exact else F.col("score")
    line = F.format_string("%s Q0 %s %d %.6f %s", F.col("qid").cast("string"), F.col("doc_id").cast("string"), F.col("rank"), score, F.lit(tag))
    run.repartition("qid").sortWithinPartitions("qid", "rank").select(line).write.text(path)


def tie_adjusted(run: DataFrame) -> DataFrame:
    """Scores rounded to 4 places, less a millionth for each earlier document of the same rounded score."""
    rounded = run.withColumn("score", F.round("score", 4))
    place = F.row_number().over(W.partitionBy("qid", "score").orderBy("rank")) - 1
    return rounded.withColumn("score", F.col("score") - place * 1e-6)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """row, embedding of a float32 matrix file: two little-endian uint32 (rows, width), then the values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                n, width = struct.unpack_from("<II", content)
                if len(content) != 8 + 4 * n * width:
                    raise ValueError(f"{len(content)} bytes for {n} x {width} values")
                x = np.frombuffer(content, "<f4", offset=8).reshape(n, width)
                for k in range(0, n, 4096):
                    yield pd.DataFrame({"row": np.arange(k, min(n, k + 4096)), "embedding": list(x[k : k + 4096])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, embedding array<float>")


def read_passages_json(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of JSON lines with _id, title and text: title and text with a space."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.select(F.col("_id").alias("doc_id"), F.concat_ws(" ", F.when(F.col("title") != "", F.col("title")), "text").alias("text"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Log records of JSON lines; malformed lines are skipped, envelopes ``{"events": [...]}`` are opened."""
    lines = spark.read.text(path)
    one = lines.select(F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE"}).alias("e"), F.get_json_object("value", "$.events").alias("many"))
    single = one.filter("many IS NULL AND (e.type IS NOT NULL OR e.kind IS NOT NULL)").select("e.*")
    opened = one.filter("many IS NOT NULL").select(F.explode(F.from_json("many", f"array<struct<{_as_struct(EVENT_SCHEMA)}>>")).alias("e")).select("e.*")
    return single.unionByName(opened)


def _as_struct(ddl: str) -> str:
    """Column DDL as struct fields."""
    return ", ".join(f"{name}: {kind}" for name, kind in (x.strip().split(" ", 1) for x in _split_top(ddl)))


def _split_top(ddl: str) -> list[str]:
    out, depth = [""], 0
    for c in ddl.replace("\n", " "):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def write_events(events: DataFrame, path: str) -> None:
    """JSON lines in one folder a UTC hour, nulls left out."""
    events.withColumn("hour", F.date_format("server_ts", "yyyyMMdd-HH")).write.partitionBy("hour").option("ignoreNullFields", "true").json(path)


def read_experiments(spark: SparkSession, path: str) -> list[dict]:
    """Experiment definitions of a JSON file with comments; ids must differ and allocations lie in [0, 1]."""
    rows = spark.read.option("multiLine", True).option("allowComments", True).json(path)
    found = [json.loads(r) for r in rows.toJSON().collect()]  # a configuration file
    found = [e for f in found for e in (f.get("experiments", [f]))]
    if len({e["id"] for e in found}) != len(found) or not all(0 <= e.get("allocation", 0) <= 1 for e in found):
        raise ValueError("experiment ids must differ and allocations lie in [0, 1]")
    return found


def write_ground_truth(found: DataFrame, path: str) -> None:
    """Exact neighbours (qid, rank, vec_id, score) as Parquet, dealt by query."""
    found.select("qid", "rank", "vec_id", "score").repartition("qid").sortWithinPartitions("qid", "rank").write.mode("overwrite").parquet(path)


def read_ground_truth(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """qid, rank, vec_id, score; with ``ids`` (vec_id, pid), in passage ids: qid, rank, pid, score."""
    truth = spark.read.parquet(path)
    return truth if ids is None else truth.join(ids, "vec_id").select("qid", "rank", "pid", "score")


def write_mined(mined: DataFrame, path: str) -> None:
    """Mined negatives as JSON lines, one a query: qid and its negatives (doc_id, source) in order of id."""
    rows = mined.groupBy("qid").agg(F.array_sort(F.collect_set(F.struct("doc_id", "source"))).alias("negatives"))
    rows.write.mode("overwrite").json(path)


def read_mined(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, source."""
    rows = spark.read.schema("qid long, negatives array<struct<doc_id: long, source: string>>").json(path)
    return rows.select("qid", F.explode("negatives").alias("n")).select("qid", "n.doc_id", "n.source")


def checked_manifest(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """name, md5, actual, ok of every file that a manifest (name, md5) lists; a file that is not there is not ok."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("actual"))
    return manifest.join(files, "name", "left").select("name", "md5", "actual", F.coalesce(F.col("md5") == F.col("actual"), F.lit(False)).alias("ok"))


def judged_topics(topics: DataFrame, qrels: DataFrame) -> DataFrame:
    """The topics (qid) that have a judgement."""
    return topics.join(qrels.select("qid").distinct(), "qid", "left_semi")


def zipf_corpus(spark: SparkSession, docs: int, vocabulary: int = 5000, longest: int = 200, seed: int = 1) -> DataFrame:
    """doc_id (sparse, ascending), text: words w<rank> drawn with probability about 1 / rank; some documents are empty. The same on any number of partitions."""
    draw = lambda *k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *k), 11).cast("double") / float(1 << 53)
    base = spark.range(docs).select((F.col("id") * 3 + 1).alias("doc_id"), F.floor(draw(F.lit("n"), "id") * (longest + 1)).cast("int").alias("n"))
    word = F.concat(F.lit("w"), F.floor(F.pow(F.lit(float(vocabulary)), draw(F.lit("w"), "doc_id", "at"))).cast("long"))
    words = base.filter("n > 0").select("doc_id", F.explode(F.expr("sequence(1, n)")).alias("at")).select("doc_id", "at", word.alias("w"))
    texts = words.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "w")))["w"], " ").alias("text"))
    return base.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
