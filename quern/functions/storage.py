"""Cutting lineage and bounding what is broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: str | None = None
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in one process (tests)."""
    global _fallback
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _fallback = _fallback or tempfile.mkdtemp(prefix="quern-ckpt-")
        root = _fallback
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/quern-{name}-{uuid.uuid4().hex}"
    # What is written needs its shuffle files no more; Spark may delete them when this execution ends.
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a frame that :func:`materialise` returned and no later plan reads."""
    root = checkpoint_root(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")) and "/quern-" in folder:
            path = hadoop.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
