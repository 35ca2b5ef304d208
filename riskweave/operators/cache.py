"""Cleaned texts kept by the content of their markup: only markup that hasn't been seen is parsed.

The table is Parquet in a shared folder, partitioned by the first two characters of the
key (the SHA-256 of the markup), so that a look-up of few keys reads few folders. Entries
are only ever added; of equal keys the newest counts, so one past its time is redone by
adding a newer one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.text import html_to_text
from riskweave.session import small_batches

#: Pages that a task hands to the parser at a time.
BATCH = 500
SCHEMA = "key string, text string, made double, prefix string"


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """All entries of a cache, of which there are none where the folder isn't there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(folder)


def cleaned(pages: DataFrame, folder: str, now: float, ttl: float | None = None) -> DataFrame:
    """``pages`` (html, ..) with key, text and made: the cleaned markup of each page and when it was cleaned (seconds).

    Markup without an entry, or with none younger than ``ttl`` seconds, is parsed, once
    however many pages have it, and added; a null counts as empty.
    """
    spark = pages.sparkSession
    key = F.sha2(F.coalesce("html", F.lit("")), 256)
    keyed = pages.withColumns({"key": key, "prefix": F.substring(key, 1, 2)})
    held = entries(spark, folder)
    live = held if ttl is None else held.where(F.col("made") > now - ttl)
    unseen = keyed.join(live.select("prefix", "key"), ["prefix", "key"], "left_anti").groupBy("key").agg(F.first(F.coalesce("html", F.lit(""))).alias("html"))
    made = unseen.select("key", html_to_text("html").alias("text"), F.lit(float(now)).alias("made"), F.substring("key", 1, 2).alias("prefix"))
    with small_batches(spark, BATCH):
        made.write.mode("append").partitionBy("prefix").parquet(folder)
    newest = entries(spark, folder).groupBy("prefix", "key").agg(F.max(F.struct("made", "text")).alias("x")).select("prefix", "key", "x.made", "x.text")
    return keyed.join(newest, ["prefix", "key"]).drop("prefix")
