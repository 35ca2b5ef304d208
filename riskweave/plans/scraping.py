"""Search, caches, work lists, metadata and run messages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.catalog import query
from riskweave.functions import fixed
from riskweave.functions.lexicons import quoted
from riskweave.operators import cache, ingest
from riskweave.operators import metadata as M
from riskweave.operators import summary as Y
from riskweave.session import work_folder
from riskweave.sources import search
from riskweave.streaming import ingest as stream

_NAME = "coalesce(json_extract_string(hit, '$._source.display_names[0]'), 'Unknown')"
_CODE = f"regexp_extract({_NAME}, '\\(([A-Z]{{1,5}})\\)', 1)"
_FORM = "CASE WHEN json_extract_string(hit, '$._source.form') <> '' THEN json_extract_string(hit, '$._source.form') ELSE form_type END"
_ROOT = f"regexp_replace({_FORM}, '/A$', '')"
_CLEAN = f"trim(regexp_replace(regexp_replace({_NAME}, '\\s*\\([A-Z]{{1,5}}\\)\\s*', ' ', 'g'), '\\s*\\(CIK \\d+\\)\\s*', '', 'g'))"
_FUND = "(" + ", ".join(f"'{x}'" for x in fixed.FUND_FORMS) + ")"
_MATCHED = "CASE " + " ".join(f"WHEN contains(lower({{0}}), '{w.lower()}') THEN '{w}'" for w in fixed.KEYWORDS) + " ELSE '' END"


def parsed_sql(source: str) -> str:
    """The work items of the hits of ``source`` (okey, source_rank, form_type, hit)."""
    return f"""SELECT okey, source_rank, CASE WHEN json_extract_string(hit, '$._source.adsh') <> '' THEN json_extract_string(hit, '$._source.adsh') ELSE split_part(json_extract_string(hit, '$._id'), ':', 1) END AS accession_no,
  ltrim(json_extract_string(hit, '$._source.ciks[0]'), '0') AS cik, {_CLEAN} AS company_name,
  CASE WHEN {_CODE} IN ('CIK', 'DE', 'NV', 'CA', 'NY', 'FL', 'TX') THEN '' ELSE {_CODE} END AS ticker, {_FORM} AS form_type, {_ROOT} AS root_form,
  json_extract_string(hit, '$._source.file_date') AS filing_date, CASE WHEN {_ROOT} IN {_FUND} THEN 1 ELSE 2 END AS tier, {_MATCHED.format(_CLEAN)} AS keyword FROM {source}"""


PARSED = f"parsed AS ({parsed_sql('hits')})"
_STORED = "SELECT accession_no FROM filings WHERE okey % 10 = 0"
FRESH = f"{PARSED}, fresh AS (SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY accession_no ORDER BY source_rank, okey) AS nth FROM parsed WHERE accession_no NOT IN ({_STORED})) WHERE nth = 1)"


def _fresh(f):
    return ingest.unseen(ingest.parse_hits(f.hits), f.filings.where("okey % 10 = 0"))


@query("src_search_hits", "SELECT form_type, nth AS position, hit FROM (SELECT form_type, hit, row_number() OVER (PARTITION BY form_type ORDER BY source_rank, okey) AS nth FROM hits) WHERE nth <= 100")
def _(f):
    """The first hundred hits of each form, in search order."""
    return ingest.capped(f.hits, ["form_type"], ["source_rank", "okey"], ingest.FORM_CAP).select("form_type", F.col("nth").cast("long").alias("position"), "hit")


@query("parse_search_hit", f", {PARSED} SELECT * FROM parsed")
def _(f):
    return ingest.parse_hits(f.hits)


@query("src_company_topn", "SELECT accession_no, cik, form_type FROM (SELECT accession_no, cik, form_type, row_number() OVER (PARTITION BY cik, form_type ORDER BY filing_date DESC, accession_no) AS nth FROM filings) WHERE nth <= 20")
def _(f):
    return ingest.capped(f.filings, ["cik", "form_type"], [F.desc("filing_date"), "accession_no"], ingest.COMPANY_CAP).select("accession_no", "cik", "form_type")


@query("ingest_dedup", f", {FRESH} SELECT * FROM fresh")
def _(f):
    return _fresh(f)


@query("ingest_form_cap", f", {FRESH} SELECT accession_no, form_type FROM (SELECT *, row_number() OVER (PARTITION BY form_type ORDER BY source_rank, okey) AS nth FROM fresh) WHERE nth <= 100")
def _(f):
    return ingest.capped(_fresh(f), ["form_type"], ["source_rank", "okey"], ingest.FORM_CAP).select("accession_no", "form_type")


@query("ingest_tier_counts", f", {FRESH} SELECT form_type, count(*) FILTER (tier = 1) AS tier_1, count(*) FILTER (tier = 2) AS tier_2 FROM fresh GROUP BY 1")
def _(f):
    return _fresh(f).groupBy("form_type").agg(F.count_if(F.col("tier") == 1).alias("tier_1"), F.count_if(F.col("tier") == 2).alias("tier_2"))


@query("run_message", """SELECT okey, CASE WHEN reprocessed > 0 THEN printf('Done: reprocessed %d filings, %d total with summaries (%.1fmin)', reprocessed, total, seconds / 60)
  WHEN new_found = 0 AND total > 0 THEN printf('Up to date: all %d filings already processed (%.1fmin)', total, seconds / 60)
  WHEN new_found = 0 AND total = 0 THEN 'No filings found. Check your internet connection and try again.'
  ELSE printf('Done: %d new, %d failed, %d total (%.1fmin)', saved, failed, total, seconds / 60) END AS message
FROM (SELECT okey, CASE WHEN okey % 4 = 0 THEN okey % 9 ELSE 0 END AS reprocessed, okey % 2 AS new_found, okey % 6 AS saved, okey % 5 AS failed, okey % 3 * (okey % 1000) AS total, (okey % 5000)::DOUBLE + 0.7::DOUBLE AS seconds FROM filings)""")
def _(f):
    k = F.col("okey")
    text = ingest.outcome_message(F.when(k % 4 == 0, k % 9).otherwise(0), k % 2, k % 6, k % 5, k % 3 * (k % 1000), (k % 5000).cast("double") + 0.7)
    return f.filings.select("okey", text.alias("message"))


@query("progress_percent", "SELECT okey, CASE WHEN okey % 10 = 0 THEN 0 ELSE CAST(round(100.0::DOUBLE * (okey % (okey % 10)) / (okey % 10)) AS INTEGER) END AS percent FROM filings")
def _(f):
    total = F.col("okey") % 10
    done = F.when(total == 0, F.lit(0)).otherwise(F.round(F.lit(100.0) * F.try_mod("okey", total) / total).cast("int"))
    return f.filings.select("okey", F.when(total == 0, 0).otherwise(done).alias("percent"))


@query("circuit_breaker_prefix", """, steps AS (SELECT okey, form_type, okey % 7 < 3 AS failed, row_number() OVER (PARTITION BY form_type ORDER BY okey) AS nth FROM filings),
  marked AS (SELECT *, failed AND lag(failed, 1, false) OVER w AND lag(failed, 2, false) OVER w AS trip FROM steps WINDOW w AS (PARTITION BY form_type ORDER BY okey))
SELECT okey, form_type FROM (SELECT *, coalesce(max(trip::INT) OVER (PARTITION BY form_type ORDER BY okey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tripped FROM marked) WHERE tripped = 0 AND NOT failed""")
def _(f):
    """Requests that succeed before three in a row have failed."""
    order = Window.partitionBy("form_type").orderBy("okey")
    df = f.filings.select("okey", "form_type", (F.col("okey") % 7 < 3).alias("failed"))
    trip = F.col("failed") & F.lag("failed", 1, False).over(order) & F.lag("failed", 2, False).over(order)
    df = df.withColumn("trip", trip.cast("int"))
    tripped = F.coalesce(F.max("trip").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("tripped", tripped).where("tripped = 0 AND NOT failed").select("okey", "form_type")


@query("cache_key_sha256", "SELECT accession_no, sha256(search_keyword || '|' || form_type || '|' || filing_date || '|' || '2024-12-31') AS key FROM filings")
def _(f):
    return f.filings.select("accession_no", F.sha2(F.concat_ws("|", "search_keyword", "form_type", "filing_date", F.lit("2024-12-31")), 256).alias("key"))


@query("cache_ttl_fresh", "SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-06-01') - epoch(ts) < 3600 * 24 * 400")
def _(f):
    """Cached answers no older than the time to live at a given moment."""
    age = F.lit("2024-06-01").cast("timestamp").cast("long") - F.col("ts").cast("timestamp").cast("long")
    return f.events.where(age < 3600 * 24 * 400).select("event_id")


@query("text_cache_key", "SELECT page_id, sha256(html) AS key, substr(sha256(html), 1, 2) AS folder FROM pages")
def _(f):
    key = F.sha2("html", 256)
    return f.pages.select("page_id", key.alias("key"), F.substring(key, 1, 2).alias("folder"))


@query("text_cache")
def _(f):
    """Every page's cleaned text through the cache, asked for twice: the second time nothing is parsed (no SQL twin: a parser's work)."""
    folder = work_folder(f.spark, "texts")
    cache.cleaned(f.html_pages, folder, 0.0)
    again = cache.cleaned(f.html_pages, folder, 60.0, 3600.0)
    return again.select("page_id", "key", "made", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("keyword_batches", """SELECT * FROM (VALUES (0, 'cryptocurrency OR blockchain OR "digital asset" OR bitcoin'), (1, 'ethereum OR XRP OR stablecoin OR "crypto ETF"'), (2, '"crypto fund" OR "crypto token" OR DeFi')) t(batch, query)""")
def _(f):
    rows = ", ".join(f"({i}, {quoted(b)})" for i, b in enumerate(ingest.keyword_batches()))
    return f.spark.sql(f"SELECT batch, query FROM VALUES {rows} AS t(batch, query)")


@query("matched_keyword", f"SELECT doc_id, {_MATCHED.format('text')} AS keyword FROM texts")
def _(f):
    return f.texts.select("doc_id", ingest.matched_keyword(F.col("text")).alias("keyword"))


@query("root_form", "SELECT DISTINCT form_type, regexp_replace(form_type, '/A$', '') AS root FROM filings")
def _(f):
    return f.filings.select("form_type", F.regexp_replace("form_type", r"/A\z", "").alias("root")).distinct()


@query("filing_url", "SELECT accession_no, 'https://filings.example/data/' || ltrim(cik, '0') || '/' || replace(accession_no, '-', '') || '/' || accession_no || '-index.htm' AS url FROM filings")
def _(f):
    return f.filings.select("accession_no", M.filing_url(F.col("cik"), F.col("accession_no")).alias("url"))


@query("first_pdf_url", "SELECT accession_no, coalesce(min_by(url, seq) FILTER (url LIKE '%.pdf'), '') AS pdf FROM fund_docs GROUP BY 1")
def _(f):
    pdf = F.when(F.col("url").endswith(".pdf"), F.struct("seq", "url"))
    return f.fund_docs.groupBy("accession_no").agg(F.coalesce(F.min(pdf)["url"], F.lit("")).alias("pdf"))


@query("fetch_text_coalesce")
def _(f):
    """The cleaned text of every page, its plain text where nothing is left of the markup (no SQL twin: a parser's work)."""
    return ingest.fetched(f.html_pages.join(f.pages.select("page_id", F.col("url").alias("plain")), "page_id")).select("page_id", "used", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("filing_category", f"SELECT accession_no, CASE WHEN replace(form_type, '/A', '') IN {_FUND} THEN 'ETF/Fund' ELSE 'Operating Co.' END AS category FROM filings")
def _(f):
    return f.filings.select("accession_no", F.when(M.is_fund(F.replace("form_type", F.lit("/A"), F.lit(""))), "ETF/Fund").otherwise("Operating Co.").alias("category"))


def _meta(f):
    return M.generate(f.filings, f.companies, f.details)


for _name, _cols in {"meta_entity_lookup": ["category"], "meta_tokens": ["tokens"], "meta_type": ["display_type"], "meta_purpose": ["new_purpose"], "meta_holdings": ["new_holdings"]}.items():
    query(_name, f"{M.META_SQL} SELECT accession_no, {', '.join(_cols)} FROM meta")(lambda f, cols=_cols: _meta(f).select("accession_no", *cols))


@query("backfill_metadata", f"{M.META_SQL} SELECT accession_no, CASE WHEN coalesce(entity_type, '') = '' THEN display_type ELSE entity_type END AS entity_type, CASE WHEN coalesce(entity_type, '') = '' THEN new_purpose ELSE purpose END AS purpose, CASE WHEN coalesce(entity_type, '') = '' THEN new_holdings ELSE top_holdings END AS top_holdings FROM meta")
def _(f):
    missing = F.coalesce("entity_type", F.lit("")) == ""
    pairs = (("entity_type", "display_type"), ("purpose", "new_purpose"), ("top_holdings", "new_holdings"))
    return _meta(f).select("accession_no", *[F.when(missing, F.col(new)).otherwise(F.col(old)).alias(old) for old, new in pairs])


@query("llm_response_parse", """SELECT okey, CASE WHEN json_valid(r) THEN json_extract_string(r, '$.summary') ELSE r END AS summary, CASE WHEN json_valid(r) THEN substr(json_extract_string(r, '$.purpose'), 1, 200) ELSE '' END AS purpose, CASE WHEN json_valid(r) THEN substr(json_extract_string(r, '$.top_holdings'), 1, 100) ELSE '' END AS top_holdings
FROM (SELECT okey, CASE WHEN okey % 4 = 0 THEN 'plain answer ' || okey ELSE '{"summary": "s' || okey || '", "purpose": "' || repeat('p', CAST(okey % 300 AS INT)) || '", "top_holdings": "BTC"}' END AS r FROM filings)""")
def _(f):
    """A model's reply: JSON fields, or the reply itself where it isn't JSON."""
    made = F.concat(F.lit('{"summary": "s'), "okey", F.lit('", "purpose": "'), F.repeat(F.lit("p"), (F.col("okey") % 300).cast("int")), F.lit('", "top_holdings": "BTC"}'))
    reply = F.when(F.col("okey") % 4 == 0, F.concat(F.lit("plain answer "), "okey")).otherwise(made)
    return f.filings.select("okey", Y.parsed_reply(reply).alias("r")).select("okey", "r.*")


# the search of all forms and keyword batches of some years, and of all companies, through the data source: what is new, at most a hundred of each form from the search
_FROM, _TO = "1996-01-01", "2000-12-31"
_DRIVER = f"""pages AS (SELECT okey, form_type, hit, okey % 3 AS batch, json_extract_string(hit, '$._source.file_date') AS file_date FROM hits WHERE source_rank = 0),
searched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY form_type, batch ORDER BY okey) AS page_nth FROM pages) WHERE page_nth <= 100 AND file_date BETWEEN '{_FROM}' AND '{_TO}'),
found AS ({parsed_sql("(SELECT okey, batch AS source_rank, form_type, hit FROM searched)")}), new_found AS (SELECT *, row_number() OVER (PARTITION BY accession_no ORDER BY source_rank, okey) AS again FROM found WHERE accession_no NOT IN ({_STORED})),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY form_type ORDER BY source_rank, okey) AS nth FROM new_found WHERE again = 1) WHERE nth <= 100),
by_company AS (SELECT accession_no, form_type FROM (SELECT f.accession_no, f.form_type, row_number() OVER (PARTITION BY f.cik, f.form_type ORDER BY filing_date DESC, f.accession_no) AS nth FROM filings f JOIN companies c USING (cik) WHERE f.form_type IN ('10-K', '10-Q', '8-K', 'S-1', 'S-1/A')) WHERE nth <= 20)
SELECT accession_no, form_type, 'search' AS source FROM kept UNION ALL
SELECT accession_no, form_type, 'company' AS source FROM by_company WHERE accession_no NOT IN ({_STORED}) AND accession_no NOT IN (SELECT accession_no FROM kept)"""


@query("search_driver", f", {_DRIVER}")
def _(f):
    """All forms and keyword batches read through the search source, its first pages and some years only, then the listings of all companies; each new accession once."""
    answers, listings = (work_folder(f.spark, n) for n in ("search-pages", "company-pages"))
    date = F.get_json_object("hit", "$._source.file_date").alias("file_date")
    search.write_pages(f.hits.where("source_rank = 0").select(F.col("form_type").alias("key"), (F.col("okey") % 3).alias("sub"), "okey", date, "hit"), answers, "okey")
    listed = f.filings.where(F.col("form_type").isin(*fixed.COMPANY_FORM_TYPES)).join(f.companies.select("cik"), "cik", "left_semi")
    entry = F.to_json(F.struct("accession_no"))
    search.write_pages(listed.select(F.col("cik").alias("key"), F.col("form_type").alias("sub"), F.col("okey"), F.col("filing_date").alias("file_date"), entry.alias("hit"), "accession_no"), listings, F.desc("file_date"), "accession_no")

    wanted = (F.col("position") < search.PAGE) & F.col("file_date").between(_FROM, _TO)
    hits = search.unbroken(search.read(f.spark, answers).where(wanted))
    hits = hits.select("okey", F.col("sub").cast("int").alias("source_rank"), F.col("key").alias("form_type"), "hit")
    stored = f.filings.where("okey % 10 = 0").select("accession_no")
    kept = ingest.capped(ingest.unseen(ingest.parse_hits(hits), stored), ["form_type"], ["source_rank", "okey"], ingest.FORM_CAP).select("accession_no", "form_type", F.lit("search").alias("source"))
    entries = search.read(f.spark, listings, ingest.COMPANY_CAP).where("error IS NULL")
    of_company = entries.select(F.get_json_object("hit", "$.accession_no").alias("accession_no"), F.col("sub").alias("form_type"), F.lit("company").alias("source"))
    fresh = of_company.join(stored, "accession_no", "left_anti").join(kept.select("accession_no"), "accession_no", "left_anti")
    return kept.unionByName(fresh)


@query("stream_ingest_dedup", f", {PARSED} SELECT DISTINCT accession_no FROM parsed WHERE accession_no NOT IN ({_STORED})")
def _(f):
    """The hits as two arriving files, taken by a stream that runs twice; the second run adds only what is new."""
    source, target, state = (work_folder(f.spark, n) for n in ("hits", "taken", "state"))
    hits = ingest.parse_hits(f.hits).select("accession_no", "source_rank")
    stored = f.filings.where("okey % 10 = 0")
    for rank in (0, 1):
        hits.where(F.col("source_rank") == rank).write.mode("append").parquet(source)
        stream.ingest(f.spark, source, hits.schema, stored, target, state)
    return f.spark.read.parquet(target).select("accession_no")


@query("stream_commit_units", f""", {FRESH}, listed AS (SELECT accession_no, form_type FROM (SELECT *, row_number() OVER (PARTITION BY form_type ORDER BY source_rank, okey) AS nth FROM fresh) WHERE nth <= 100),
  numbered AS (SELECT *, CAST((row_number() OVER (ORDER BY accession_no) - 1) // 25 AS BIGINT) AS unit FROM listed)
SELECT accession_no, form_type, unit, count(*) OVER (PARTITION BY unit) AS commit_rows FROM numbered""")
def _(f):
    """A run's work list (a hundred new filings of each form at most) committed 25 filings at a time, with the size of each filing's commit."""
    source, stage, target, state = (work_folder(f.spark, n) for n in ("units", "numbered", "commits", "state"))
    work = ingest.capped(_fresh(f), ["form_type"], ["source_rank", "okey"], ingest.FORM_CAP).select("accession_no", "form_type")
    stream.units(work, source, stage)
    stream.ingest(f.spark, source, f.spark.read.parquet(source).schema, f.filings.where("okey % 10 = 0"), target, state, files=1)
    taken = f.spark.read.parquet(target)
    return taken.select("accession_no", "form_type", F.col("unit").cast("long").alias("unit"), F.count("*").over(Window.partitionBy("batch")).alias("commit_rows"))


@query("stream_monthly_counts", "SELECT strftime(to_timestamp(floor(epoch(ts) / 2592000) * 2592000), '%Y-%m-%d') AS month_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(f):
    """The windowed stream run over the stored events in complete mode: counts by window and type."""
    folder = work_folder(f.spark, "events")
    f.events.select("ts", "event_type").write.parquet(folder)
    name = "counts_" + folder.rsplit("-", 1)[1]
    counts = stream.monthly_counts(f.spark.readStream.schema(f.events.select("ts", "event_type").schema).parquet(folder))
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return f.spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd").alias("month_start"), "event_type", "n")
