"""Incremental ingestion: a file stream of search hits, each new accession taken once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators import store

#: Source files of one commit, where a run is to be committed piece by piece.
COMMIT_FILES = 25
#: Filings of one commit of a run, and of one that processes stored filings again.
COMMIT_ROWS, COMMIT_ROWS_AGAIN = 25, 20


def units(work: DataFrame, folder: str, stage: str, rows: int = COMMIT_ROWS) -> None:
    """Write a work list (accession_no, ..) as files of exactly ``rows`` filings, the last with what is left.

    A stream that takes one file at a time then commits by filings: an admission of rows
    that survives a restart, as the stream's own log names the files taken.
    """
    placed = store.numbered(work, ["accession_no"], stage, name="nth")
    unit = F.floor((F.col("nth") - 1) / rows).cast("long")
    placed.withColumn("unit", unit).drop("nth").repartition("unit").write.partitionBy("unit").parquet(folder)


def ingest(spark: SparkSession, source: str, schema, stored: DataFrame, target: str, checkpoint: str, files: int = COMMIT_FILES, told: Callable[[int], None] | None = None) -> StreamingQuery:
    """Take what stands in ``source`` now: drop stored and repeated accessions, append the rest to ``target``.

    The stream keeps no state of its own, however long it runs: what earlier commits took
    is the target, and each micro-batch is joined against its keys and the stored ones.
    A micro-batch of ``files`` files is one commit unit, written under its id so that a
    repeated batch replaces itself. ``told`` hears how many rows each commit saved.
    """
    known = stored.select("accession_no").distinct()

    def take(batch: DataFrame, batch_id: int) -> None:
        path = f"{target}/batch={batch_id}"
        taken = spark.read.schema(f"{_ddl(batch)}, batch long").parquet(target).where(F.col("batch") < batch_id) if batch_id else None
        fresh = batch.dropDuplicates(["accession_no"]).join(known, "accession_no", "left_anti")
        if taken is not None:
            fresh = fresh.join(taken.select("accession_no"), "accession_no", "left_anti")
        fresh.write.mode("overwrite").parquet(path)
        if told is not None:
            told(spark.read.schema(batch.schema).parquet(path).count())

    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = new.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
    query.awaitTermination()
    return query


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def monthly_counts(events: DataFrame) -> DataFrame:
    """Counts by event type and 30-day window with late data up to a day: the stream twin of the monthly figures."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    return timed.groupBy(F.window("ts", "30 days"), "event_type").agg(F.count("*").alias("n"))
