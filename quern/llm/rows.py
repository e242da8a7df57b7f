"""Every row of a table as a document of its own, for operators that name documents by doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.storage import materialise


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """src (the whole row as a struct, so no column of it can clash), key, text and marked; and whether any row is marked.

    The key is the doc_id. Rows whose doc_id is repeated or null are marked, and their key is a hash of doc_id and text
    above 2**62, so it comes after all ordinary ids; marked rows that are equal in both share it.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("src"), F.col("doc_id").cast("long").alias("id"), "text")
    # Written before it is joined: its size is then known, and Spark broadcasts only below its threshold.
    repeated = materialise(own.groupBy(F.col("id").alias("again")).count().filter("count > 1 OR again IS NULL").select("again", F.lit(True).alias("marked")), "repeated")
    if repeated.isEmpty():
        return own.select("src", F.col("id").alias("key"), "text", F.lit(None).cast("boolean").alias("marked")), False
    joined = own.join(repeated, own["id"].eqNullSafe(repeated["again"]), "left")
    key = F.when(F.col("marked"), F.expr(f"(xxhash64(id, text) & {(1 << 62) - 1}L) | {1 << 62}L")).otherwise(F.col("id"))
    return joined.select("src", key.alias("key"), "text", "marked"), True
