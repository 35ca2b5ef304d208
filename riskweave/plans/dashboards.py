"""Figures of the dashboard; ties are broken by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.catalog import query
from riskweave.operators import figures, store
from riskweave.plans.views import gated, visible
from riskweave.session import work_folder


def _by(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


@query("stats_total", "SELECT count(*) AS total FROM visible")
def _(f):
    return visible(f.view).agg(F.count("*").alias("total"))


@query("stats_total_all", "SELECT count(*) AS total FROM filings")
def _(f):
    return f.filings.agg(F.count("*").alias("total"))


@query("stats_companies", "SELECT count(DISTINCT company_name) AS companies FROM visible")
def _(f):
    return visible(f.view).agg(F.countDistinct("company_name").alias("companies"))


@query("stats_category_counts", "SELECT count(*) FILTER (filing_category = 'ETF/Fund') AS funds, count(*) FILTER (filing_category = 'Operating Co.') AS operating FROM visible")
def _(f):
    return visible(f.view).agg(F.count_if(F.col("filing_category") == "ETF/Fund").alias("funds"), F.count_if(F.col("filing_category") == "Operating Co.").alias("operating"))


@query("stats_monthly", "SELECT substr(filing_date, 1, 7) AS month, count(*) AS n FROM visible WHERE filing_date <> '' GROUP BY 1 ORDER BY 1")
def _(f):
    return _by(visible(f.view).where("filing_date <> ''"), F.substring("filing_date", 1, 7).alias("month")).orderBy("month")


@query("stats_top_companies", "SELECT company_name, count(*) AS n FROM visible GROUP BY 1 ORDER BY n DESC, company_name LIMIT 15")
def _(f):
    return _by(visible(f.view), "company_name").orderBy(F.desc("n"), "company_name").limit(15)


@query("stats_form_types", "SELECT filing_category, form_type, count(*) AS n FROM visible GROUP BY 1, 2")
def _(f):
    return _by(visible(f.view), "filing_category", "form_type").orderBy(F.desc("n"), "filing_category", "form_type")


@query("stats_keywords", "SELECT search_keyword, count(*) AS n FROM visible WHERE search_keyword <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def _(f):
    return _by(visible(f.view).where("search_keyword <> ''"), "search_keyword").orderBy(F.desc("n"), "search_keyword").limit(10)


@query("stats_categories", "SELECT filing_category, count(*) AS n FROM visible GROUP BY 1")
def _(f):
    return _by(visible(f.view), "filing_category").orderBy(F.desc("n"), "filing_category")


@query("stats_daily", "SELECT filing_date, count(*) AS n FROM visible WHERE filing_date <> '' GROUP BY 1 ORDER BY filing_date DESC LIMIT 30")
def _(f):
    return _by(visible(f.view).where("filing_date <> ''"), "filing_date").orderBy(F.desc("filing_date")).limit(30)


_BUNDLE = """, facts AS (
  SELECT 'month' AS figure, substr(filing_date, 1, 7) AS key, count(*) AS n FROM visible WHERE filing_date <> '' GROUP BY ALL
  UNION ALL SELECT 'company', company_name, count(*) FROM visible GROUP BY ALL
  UNION ALL SELECT 'form', filing_category || '|' || form_type, count(*) FROM visible GROUP BY ALL
  UNION ALL SELECT 'keyword', search_keyword, count(*) FROM visible WHERE search_keyword <> '' GROUP BY ALL
  UNION ALL SELECT 'category', filing_category, count(*) FROM visible GROUP BY ALL
  UNION ALL SELECT 'day', filing_date, count(*) FROM visible WHERE filing_date <> '' GROUP BY ALL
  UNION ALL SELECT 'total', '', count(*) FROM visible
  UNION ALL SELECT 'companies', '', count(DISTINCT company_name) FROM visible
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY figure ORDER BY CASE WHEN figure = 'day' THEN key ELSE '' END DESC, CASE WHEN figure = 'day' THEN 0 ELSE n END DESC, key) AS place FROM facts
)
SELECT figure, key, n FROM ranked WHERE place <= CASE figure WHEN 'company' THEN 15 WHEN 'keyword' THEN 10 WHEN 'day' THEN 30 ELSE 1000000 END"""


@query("stats_bundle", _BUNDLE)
def bundle(f):
    """All figures of one GROUPING SETS pass over the gated view; a second aggregate of its shuffled rows counts companies."""
    return figures.bundle(figures.counts(visible(f.view)))


@query("api_stats_json", f"{_BUNDLE.replace('SELECT figure, key, n FROM ranked', 'SELECT figure, key, n, place FROM ranked')}".replace("SELECT figure, key, n, place FROM ranked", "SELECT figure, CAST(to_json(list({'key': key, 'n': n} ORDER BY place)) AS VARCHAR) AS body FROM ranked") + " GROUP BY figure")
def _(f):
    """The bundle as JSON, an array for each figure in its order."""
    order = F.array_sort(F.collect_list(F.struct(F.when(F.col("figure") != "day", -F.col("n")).alias("o"), F.when(F.col("figure") == "day", -F.regexp_replace("key", "-", "").cast("int")).alias("d"), "key", "n")))
    return bundle(f).groupBy("figure").agg(F.to_json(F.transform(order, lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n")))).alias("body"))


@query("stats_incremental", """, seen AS (SELECT v.* REPLACE (CASE WHEN k.okey % 3 = 0 THEN v.company_name || ' Inc' ELSE v.company_name END AS company_name)
  FROM visible v JOIN (SELECT accession_no, okey FROM filings) k USING (accession_no) WHERE (k.okey % 2 = 0 OR k.okey % 3 = 0) AND k.okey % 11 <> 0)""" + _BUNDLE.replace("FROM visible", "FROM seen"))
def _(f):
    """The bundle from partial counts of three ingests: half of the filings, then new and renamed ones, then removals."""
    folder = work_folder(f.spark, "figures")

    def seen(filings):
        return gated(filings, f.summaries)

    first = f.filings.where("okey % 2 = 0")
    figures.append(figures.change(seen(first.limit(0)), seen(first)), folder, 0)
    new = f.filings.where("okey % 3 = 0").withColumn("company_name", F.concat("company_name", F.lit(" Inc")))
    held = first.join(new.select("accession_no"), "accession_no", "left_semi").select(first.columns)
    figures.append(figures.change(seen(held), seen(store.upsert(held, new))), folder, 1)
    gone = store.upsert(first, new).where("okey % 11 = 0")
    figures.append(figures.change(seen(gone), seen(gone.limit(0))), folder, 2)
    return figures.bundle(figures.merged(f.spark, folder))
