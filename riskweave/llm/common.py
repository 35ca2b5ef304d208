"""Shared folder, stage tables and size-checked broadcasts of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after it was counted and found to have at most so many (narrow) rows.
BROADCAST_ROWS = 1_000_000
#: Rows and bytes of one Arrow batch; texts are long, so fewer than Spark's default.
ARROW_ROWS, ARROW_BYTES = 500, 16 << 20
_ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only on a local master (tests) may it be unset: a temporary folder is made and set then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='riskweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared one."""
    return f"{shared_dir(spark)}/riskweave/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all that these operators have left in the shared folder; only once no result of theirs is needed."""
    delete(spark, f"{shared_dir(spark)}/riskweave")


class Scratch:
    """Stage tables of one operator: ``written`` ones go when it ends, ``kept`` ones stay for its result.

    A stage table is df written as Parquet in the shared folder and read again: its lineage
    ends there, and a lost executor costs what was not yet written.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._going = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, name)
        self._going.append(path)
        return written(self.spark, df, name, path)

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return written(self.spark, df, name)

    def drop(self, keep: int = 0) -> None:
        """Delete the tables written so far but for the last ``keep``."""
        while len(self._going) > keep:
            delete(self.spark, self._going.pop(0))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Stage tables and small Arrow batches for the jobs run inside; both end with the block."""
    tables = Scratch(spark)
    before = {k: spark.conf.get(k, None) for k in _ARROW}
    for k, v in _ARROW.items():
        spark.conf.set(k, str(v))
    try:
        yield tables
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        tables.drop()


def written(spark: SparkSession, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = path or new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted, not guessed)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """``df`` as one struct column ``row`` beside ``keys``, so that no column of it can clash with an operator's own."""
    return df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()])


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores behind it while ``taken`` has it (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """The SHA-256 of a text (null: empty), 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def bounded_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows of ``df``, those whose hash of the ``key`` columns is smallest.

    The rows are counted first, so that little more than the sample reaches the driver
    from all tasks together.
    """
    share = min(1.0, (1.2 * rows + 200) / max(1, df.count()))
    drawn = df.withColumn("draw_", F.xxhash64(*key))
    near = drawn.where(F.col("draw_") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    return near.orderBy("draw_", *key).limit(rows).drop("draw_")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
