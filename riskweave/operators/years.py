"""A table kept by filing year and bucket: a write reads and rewrites the years it touches and shuffles its own rows only.

The year is part of the accession number, so a key names its partition. Inside a year rows
are bucketed by accession number; the join of new rows with the stored ones then moves the
new ones alone. Years are replaced by dynamic partition overwrite: a write that fails while
years are moved into place leaves some of them new, and the same write repeated completes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR = "filed_year"
_MODE = "spark.sql.sources.partitionOverwriteMode"


def year_of(accession: Column) -> Column:
    """The two digits of an accession number's year; ``--`` where it is too short or null."""
    digits = F.substring(accession, 12, 2)
    return F.when(digits != "", digits).otherwise("--")


def attach(spark: SparkSession, name: str, schema: str, path: str, buckets: int) -> None:
    """Make the table ``name`` over ``path``, empty or with the years that stand there."""
    spark.sql(f"CREATE TABLE {name} ({schema}, {YEAR} string) USING parquet PARTITIONED BY ({YEAR}) CLUSTERED BY (accession_no) INTO {buckets} BUCKETS LOCATION '{path}'")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")


def read(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop(YEAR)


def touched(new: DataFrame) -> list[str]:
    """The years of the rows of ``new``: two characters, so few."""
    return sorted(r[0] for r in new.select(year_of(F.col("accession_no"))).distinct().collect())


def changed(spark: SparkSession, name: str, new: DataFrame, years: list[str], how: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``years`` after ``how(stored, new)``, which keeps the stored columns; other years aren't read."""
    old = spark.table(name).where(F.col(YEAR).isin(years)).drop(YEAR)
    return how(old, new).withColumn(YEAR, year_of(F.col("accession_no"))).select(spark.table(name).columns)


def write(spark: SparkSession, name: str, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
    """Change the table by ``new`` and return the years that were rewritten. No year stays without rows: delete them by their folder."""
    years = touched(new)
    before = spark.conf.get(_MODE)
    spark.conf.set(_MODE, "dynamic")
    try:
        changed(spark, name, new, years, how).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(_MODE, before)
    return years
