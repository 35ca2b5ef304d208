"""Changes of the four tables as snapshots: upsert, replace, flags, references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPDATABLE = ("company_name", "ticker", "sec_url", "filing_pdf_url", "crypto_connection", "entity_type", "purpose", "top_holdings", "processed_at")


def upsert(old: DataFrame, new: DataFrame, key: str = "accession_no", updatable: tuple[str, ...] = UPDATABLE) -> DataFrame:
    """``old`` with rows of ``new``: unknown keys are added whole, known keys change in ``updatable`` columns only."""
    there, fresh = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(*[(F.when(fresh if c in updatable else ~there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in old.columns])


def replace(old: DataFrame, new: DataFrame, key: str = "accession_no") -> DataFrame:
    """All rows of the keys of ``new`` go, then the rows of ``new`` come."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def ranked_documents(docs: DataFrame) -> DataFrame:
    """doc_seq by descending score, from 0."""
    order = Window.partitionBy("accession_no").orderBy(F.desc("crypto_score"), "seq")
    return docs.withColumn("doc_seq", F.row_number().over(order) - 1)


def first_is_primary(sections: DataFrame, *order) -> DataFrame:
    return sections.withColumn("is_primary", (F.row_number().over(Window.partitionBy("accession_no").orderBy(*order)) == 1).cast("int"))


def newest_is_current(summaries: DataFrame) -> DataFrame:
    return summaries.withColumn("is_current", (F.row_number().over(Window.partitionBy("accession_no").orderBy(F.desc("id"))) == 1).cast("int"))


def set_primary(sections: DataFrame, chosen: DataFrame) -> DataFrame:
    """The override of ``chosen`` (accession_no, id): a wrong id leaves none primary."""
    picked = chosen.select("accession_no", F.col("id").alias("picked"))
    flag = F.when(F.col("picked").isNotNull(), (F.col("id") == F.col("picked")).cast("int")).otherwise(F.col("is_primary"))
    return sections.join(picked, "accession_no", "left").withColumn("is_primary", flag).drop("picked")


def null_dangling(summaries: DataFrame, sections: DataFrame) -> DataFrame:
    """section_id of sections that are gone becomes null."""
    live = sections.select(F.col("id").alias("live"))
    joined = summaries.join(live, F.col("section_id") == F.col("live"), "left")
    return joined.withColumn("section_id", F.when(F.col("live").isNotNull(), F.col("section_id"))).drop("live")


def numbered(df: DataFrame, order: list[str], path: str, begin: int = 0, name: str = "id") -> DataFrame:
    """``df`` with numbers above ``begin``, in order: the place in a range partition behind the rows of those before it.

    ``path`` is where the ranges are written, so that they stay as they are; it must stay until the result is written.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed.write.mode("overwrite").parquet(path)
    placed = df.sparkSession.read.schema(placed.schema).parquet(path)
    begins, total = [], begin
    for r in placed.groupBy("part").count().orderBy("part").collect():  # a row a partition
        begins.append((r.part, total))
        total += r["count"]
    before = df.sparkSession.createDataFrame(begins, "part int, begin long")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return placed.join(F.broadcast(before), "part").withColumn(name, F.col("begin") + nth).drop("begin", "part")
