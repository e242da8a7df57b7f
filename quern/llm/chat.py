"""Chat formatting by cumulative-snapshot collapse.

A logger that stores a conversation after every turn leaves many rows that are prefixes of longer ones.
Each turn gets a rolling hash of all turns up to it (an XOR of position-bound 128-bit turn hashes, so it
can be summed in parts); a conversation whose full hash is an inner prefix hash of another is dropped by
an anti-join, and of equal conversations the smallest conv_id stays. Survivors are rendered with
``<|im_start|>role ... <|im_end|>`` marks.

No group is collected whole: turns are ranked in blocks of ``BLOCK`` turn numbers whose offsets are
joined back, and a rendered conversation is returned in parts of ``PART`` turns (part 0 is all of an
ordinary conversation).

Defined cases: turns are ordered by turn (nulls first), role, text; a row repeated within its conversation
counts once; null text is the empty text, null role is ``unknown``; rows without conv_id belong to no
conversation and give none; ``<|`` inside a text is written ``<||`` so that marks cannot be forged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.storage import materialise

BLOCK, PART = 64, 256


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text and the rolling prefix hash (p1, p2) of every turn."""
    turns = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct().withColumn("block", F.coalesce(F.expr(f"floor(turn / {BLOCK})"), F.lit(-(2**60))).cast("long"))
    rank = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ranked = turns.withColumn("rn", F.row_number().over(rank))
    # The first offset numbers the turns, the second carries the hash over from earlier blocks.
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    offsets = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    hashed = (
        ranked.join(offsets, ["conv_id", "block"]).withColumn("pos", F.col("offset") + F.col("rn"))
        .withColumn("h1", F.xxhash64("pos", "role", "text")).withColumn("h2", F.xxhash64(F.lit("second"), "text", "role", "pos"))
    )
    running = W.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    own = hashed.withColumn("x1", F.bit_xor("h1").over(running)).withColumn("x2", F.bit_xor("h2").over(running))
    totals = hashed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    carried = totals.select("conv_id", "block", F.coalesce(F.bit_xor("t1").over(earlier), F.lit(0)).alias("c1"),
                            F.coalesce(F.bit_xor("t2").over(earlier), F.lit(0)).alias("c2"))
    return own.join(carried, ["conv_id", "block"]).select(
        "conv_id", "pos", "role", "text", F.expr("x1 ^ c1").alias("p1"), F.expr("x2 ^ c2").alias("p2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id and length of the conversations that are a prefix of no other, one of each set of equals."""
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "p1", "p2")).alias("e")).select("conv_id", "e.*")
    inner = (
        prefixes.select("conv_id", "pos", "p1", "p2")
        .join(ends.select("conv_id", F.col("pos").alias("n")), "conv_id").filter("pos < n")
        .select("pos", "p1", "p2").distinct()
    )
    unique = ends.groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return unique.join(inner, ["pos", "p1", "p2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "copies")


def render(prefixes: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, copies, text for the conversations in ``kept``."""
    piece = F.concat(F.lit("<|im_start|>"), F.replace("role", F.lit("<|"), F.lit("<||")), F.lit("\n"),
                     F.replace("text", F.lit("<|"), F.lit("<||")), F.lit("<|im_end|>\n"))
    return (
        prefixes.select("conv_id", "pos", piece.alias("piece")).join(kept, "conv_id")
        .groupBy("conv_id", F.expr(f"CAST(floor((pos - 1) / {PART}) AS BIGINT)").alias("part"), "n_turns", "copies")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("turns"))
        .select("conv_id", "part", "n_turns", "copies", F.array_join("turns.piece", "").alias("text"))
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Collapse snapshots, then render what is left."""
    prefixes = materialise(prefix_hashes(conversations.select("conv_id", "turn", "role", "text")), "prefixes")
    return render(prefixes, maximal(prefixes))
