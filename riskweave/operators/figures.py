"""Dashboard figures as counts that add up, so that each ingest counts only what it changed.

A change is counted by taking the changed filings as they stood before (weight -1) and as
they stand now (weight 1). These partial counts are appended under the ingest's own id;
their sums are the figures. Nothing but the changed filings is read for a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines shown of the long figures.
LIMITS = {"company": 15, "keyword": 10, "day": 30}
COLUMNS = ("month", "company_name", "filing_category", "form_type", "search_keyword", "filing_date")
SETS = {"month": ("month",), "company": ("company_name",), "form": ("filing_category", "form_type"), "keyword": ("search_keyword",), "category": ("filing_category",), "day": ("filing_date",), "total": ()}
PARTIAL = "figure string, key string, n long"


def counts(view: DataFrame, weight: str = "count(*)") -> DataFrame:
    """(figure, key, n) of the rows of the gated view, all figures in one GROUPING SETS pass; ``weight`` is what a group adds up."""
    listed = ", ".join(COLUMNS)
    extra = [] if weight == "count(*)" else ["sign"]
    seen = view.select(*COLUMNS[1:], F.substring("filing_date", 1, 7).alias("month"), *extra)
    grouped = view.sparkSession.sql(
        f"SELECT grouping_id({listed}) AS g, {listed}, {weight} AS n FROM {{seen}} GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(x) + ')' for x in SETS.values())})",
        seen=seen,
    )
    bit = {c: 1 << (5 - i) for i, c in enumerate(COLUMNS)}
    figure = key = None
    for name, cols in SETS.items():
        test = F.col("g") == 63 - sum(bit[c] for c in cols)
        figure = F.when(test, name) if figure is None else figure.when(test, name)
        shown = F.concat_ws("|", *cols) if cols else F.lit("")
        key = F.when(test, shown) if key is None else key.when(test, shown)
    return grouped.select(figure.alias("figure"), key.alias("key"), "n")


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Partial counts of a change: the gated view's rows of the changed filings as they were and as they are.

    A filing that is only in ``after`` was added or became visible, one that is only in
    ``before`` went. Unchanged rows cancel out; sums of 0 are left out.
    """
    signed = before.select(*COLUMNS[1:], F.lit(-1).alias("sign")).unionByName(after.select(*COLUMNS[1:], F.lit(1).alias("sign")))
    return counts(signed, "sum(sign)").where("n <> 0")


def append(partial: DataFrame, folder: str, ingest: int) -> None:
    """Keep the partial counts of one ingest; one that is repeated replaces itself."""
    partial.write.mode("overwrite").parquet(f"{folder}/ingest={ingest}")


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """(figure, key, n) over all ingests; keys that no filing has any more are gone."""
    kept = spark.read.schema(f"{PARTIAL}, ingest long").parquet(folder)
    return kept.groupBy("figure", "key").agg(F.sum("n").alias("n")).where("n <> 0")


def bundle(facts: DataFrame) -> DataFrame:
    """The figures in their order, the long ones cut, with the counts of companies and rows."""
    # a figure without a limit is ranked inside each of its keys, so every window group is cut at 30 before the shuffle
    apart = F.when(F.col("figure").isin(*LIMITS), F.lit("")).otherwise(F.col("key"))
    newest, most = F.when(F.col("figure") == "day", F.col("key")), F.when(F.col("figure") != "day", F.col("n"))
    # the test reads the count, so it stays above the aggregate, whose shuffled rows both parts of the result share
    told = F.when(F.col("n") < 0, F.lit(False)).otherwise(F.expr("NOT (figure IN ('month', 'day', 'keyword') AND key = '') AND figure <> 'total'"))
    ranked = facts.where(told).withColumn("apart", apart)
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("figure", "apart").orderBy(newest.desc(), most.desc(), "key"))).where(F.col("place") <= max(LIMITS.values()))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair]), F.col("figure"))
    listed = ranked.where(F.col("place") <= F.coalesce(limit, F.lit(1))).select("figure", "key", "n")
    whole = facts.agg(F.count_if(F.col("figure") == "company").alias("companies"), F.coalesce(F.sum(F.when(F.col("figure") == "total", F.col("n"))), F.lit(0)).alias("total"))
    return listed.unionByName(whole.select(F.stack(F.lit(2), F.lit("companies"), "companies", F.lit("total"), "total").alias("figure", "n")).select("figure", F.lit("").alias("key"), "n"))
