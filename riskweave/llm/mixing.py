"""Mixing sources to target weights by Poisson replication.

A source of ``n`` rows that should make up the share ``w`` of a mix of ``total`` rows has
the repetition rate ``total * w / n``. Each row draws its number of copies from the
Poisson distribution of that mean by inversion: the uniform number is a hash of the
seed and the doc_id, so any rerun draws the same. A mean above ``SLICE`` is drawn as a
sum of independent slices, which keeps the tables and what one row becomes at once
bounded. Rows are exploded by their count and shuffled globally on a hash of seed,
doc_id and copy, which spreads every source and every document's copies evenly.

Defined results: a null source is a source of its own; rows with equal doc_id draw
equal counts; null texts and ids are kept as they are; a source without a target weight
has rate 0, and all have where no weight is above 0; empty tables give empty results;
other columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.llm import common

SEED = 17
#: A rates table of so many sources at most is broadcast.
SOURCES = 10_000
#: The greatest mean of one draw, and a bound on the copies that it gives.
SLICE, COPIES = 64, 1_000


def hashed(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1): the first 52 bits of the hash."""
    return F.conv(F.substring(hashed(seed, *parts), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: DataFrame | None, total: int | None) -> DataFrame:
    """(source, rate) for each source; without ``weights`` (source, weight) all sources weigh the same.

    Several weights of one source add up; where no weight names a present source all rates are 0.
    """
    sizes = docs.groupBy("source").agg(F.count("*").alias("rows"))
    if weights is None:
        shared = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        shared = sizes.join(given, sizes["source"].eqNullSafe(F.col("s")), "left").drop("s").fillna(0.0, ["weight"])
    sums = shared.agg(F.sum("weight").alias("weights"), F.sum("rows").alias("all")).first()  # one row
    if not sums.weights:
        return shared.select("source", F.lit(0.0).alias("rate"))
    whole = float(sums.all if total is None else total)
    return shared.select("source", (F.lit(whole) * F.col("weight") / F.lit(float(sums.weights)) / F.col("rows")).alias("rate"))


def inversion_tables(rates: DataFrame) -> DataFrame:
    """(source, slices, steps): in how many slices a row's count is drawn, and the Poisson cumulative distribution of one.

    A count of mean ``rate`` is the sum of ``slices`` independent counts of mean
    ``SLICE`` at most, so a table has some ``SLICE`` + 12 * sqrt(``SLICE``) + 20 entries
    at most, up to where the distribution is 1 in double precision.
    """
    cut = rates.where("rate > 0").withColumn("slices", F.greatest(F.ceil(F.col("rate") / SLICE), F.lit(1)).cast("long"))
    cut = cut.select("source", "slices", (F.col("rate") / F.col("slices")).alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20)
    terms = cut.select("source", "slices", "rate", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("k"))
    so_far = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_p = F.sum(F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log("rate") - F.log("k"))).over(so_far)
    terms = terms.withColumn("p", F.exp(log_p)).withColumn("c", F.sum("p").over(so_far))
    return terms.groupBy("source", "slices").agg(F.sort_array(F.collect_list("c")).alias("steps"))


def mix(spark: SparkSession, docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` replicated to the target weights and globally shuffled.

    Adds ``copy`` (the slice times COPIES, plus 0, 1, .. in the slice) and ``mix_key``,
    whose order is that of the mix; where ``docs`` has a column of that name it keeps it
    and the added one gets an underscore more.
    """
    with common.scratch(spark) as tables:
        steps = tables.kept(inversion_tables(rates(docs.select("source"), weights, total)), "rates").withColumnRenamed("source", "of")
    own = common.packed(docs, id=F.col("doc_id"), source=F.col("source"))
    drawn = own.join(common.small(steps, SOURCES), F.col("source").eqNullSafe(F.col("of")))
    # two generators in turn, so that neither step holds a row's copies at once: slices, then the copies of one
    sliced = drawn.select("row", "id", "steps", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    u = F.when(F.col("slice") == 0, uniform(seed, F.col("id"))).otherwise(uniform(seed, F.col("id"), F.col("slice")))
    counted = sliced.select("row", "id", "slice", "steps", u.alias("u")).select("row", "id", "slice", F.size(F.filter("steps", lambda c: c <= F.col("u"))).alias("n")).where("n > 0")
    copies = counted.select("row", "id", F.explode(F.sequence(F.col("slice") * COPIES, F.col("slice") * COPIES + F.col("n") - 1)).alias("copy"))
    keyed = copies.withColumn("mix_key", hashed(seed + 1, F.col("id"), F.col("copy")))
    names = [common.free_name(docs.columns, c) for c in ("copy", "mix_key")]
    # rows that share an id (null ids do) share keys: their contents spread them
    out = keyed.repartition("mix_key", F.xxhash64("row")).sortWithinPartitions("mix_key")
    return out.select("row.*", F.col("copy").alias(names[0]), F.col("mix_key").alias(names[1]))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that every source has the same weight, as many rows as before on average."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix(spark, docs)


OP3_SQL = f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM sizes)::DOUBLE * 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE / n::DOUBLE AS whole FROM sizes),
cut AS (SELECT source, slices, whole / slices AS rate FROM (SELECT source, whole, greatest(ceil(whole / {SLICE}), 1)::BIGINT AS slices FROM rates)),
terms AS (SELECT source, slices, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT))) AS k FROM cut),
logs AS (SELECT source, slices, k, sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(k::DOUBLE) END) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS l FROM (SELECT source, slices, rate, k FROM terms WHERE k > 0 OR k = 0)),
steps AS (SELECT source, slices, k, sum(exp(l)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM logs),
lists AS (SELECT source, slices, list(c) AS cs FROM steps GROUP BY source, slices),
sliced AS (SELECT d.*, cs, unnest(generate_series(0, slices - 1)) AS slice FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
drawn AS (
  SELECT *, len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || CASE WHEN slice > 0 THEN ':' || slice ELSE '' END), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)) AS copies FROM sliced
), copied AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(slice * {COPIES}, slice * {COPIES} + copies - 1)) AS copy FROM drawn WHERE copies > 0
)
SELECT doc_id, text, lang, source, n_chars, copy, md5('{SEED + 1}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR) AS mix_key FROM copied
"""
