"""Upserts, replacements, flags and reprocessing selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.catalog import query
from riskweave.operators import store, years
from riskweave.session import work_folder

_NEW = "SELECT * REPLACE (company_name || ' Inc' AS company_name, '10-X' AS form_type, 'new' AS purpose, CASE WHEN okey % 6 = 0 THEN accession_no || 'N' ELSE accession_no END AS accession_no) FROM filings WHERE okey % 3 = 0"


@query("upsert_merge", f""", fresh AS ({_NEW}), old AS (SELECT * FROM filings WHERE okey % 2 = 0)
SELECT coalesce(o.accession_no, n.accession_no) AS accession_no, coalesce(n.company_name, o.company_name) AS company_name, coalesce(o.form_type, n.form_type) AS form_type,
  coalesce(n.purpose, o.purpose) AS purpose, coalesce(o.filing_date, n.filing_date) AS filing_date, coalesce(o.tier, n.tier) AS tier FROM old o FULL JOIN fresh n USING (accession_no)""")
def _(f):
    new = f.filings.where("okey % 3 = 0").withColumns({"company_name": F.concat("company_name", F.lit(" Inc")), "form_type": F.lit("10-X"), "purpose": F.lit("new"), "accession_no": F.when(F.col("okey") % 6 == 0, F.concat("accession_no", F.lit("N"))).otherwise(F.col("accession_no"))})
    return store.upsert(f.filings.where("okey % 2 = 0"), new).select("accession_no", "company_name", "form_type", "purpose", "filing_date", "tier")


@query("upsert_touched_years", f""", fresh AS ({_NEW} AND filing_date >= '1997'), old AS (SELECT * FROM filings WHERE okey % 2 = 0)
SELECT coalesce(o.accession_no, n.accession_no) AS accession_no, coalesce(n.company_name, o.company_name) AS company_name, coalesce(o.form_type, n.form_type) AS form_type, coalesce(n.purpose, o.purpose) AS purpose, coalesce(o.tier, n.tier) AS tier FROM old o FULL JOIN fresh n USING (accession_no)""")
def _(f):
    """The upsert into a table kept by year and bucket: years that no new filing is of are left as they stand."""
    folder = work_folder(f.spark, "years")
    name, columns = "filings_" + folder.rsplit("-", 1)[1], ["accession_no", "company_name", "form_type", "purpose", "tier"]
    years.attach(f.spark, name, "accession_no string, company_name string, form_type string, purpose string, tier int", folder, 8)
    years.write(f.spark, name, f.filings.where("okey % 2 = 0").select(columns), store.upsert)
    new = f.filings.where("okey % 3 = 0 AND filing_date >= '1997'").withColumns({"company_name": F.concat("company_name", F.lit(" Inc")), "form_type": F.lit("10-X"), "purpose": F.lit("new"), "accession_no": F.when(F.col("okey") % 6 == 0, F.concat("accession_no", F.lit("N"))).otherwise(F.col("accession_no"))})
    years.write(f.spark, name, new.select(columns), store.upsert)
    return years.read(f.spark, name)


@query("replace_documents", """, fresh AS (SELECT accession_no, CAST(row_number() OVER (PARTITION BY accession_no ORDER BY length(text) % 10 DESC, seq) - 1 AS INTEGER) AS doc_seq, name AS doc_name FROM fund_docs WHERE seq < 4),
  old AS (SELECT accession_no, seq AS doc_seq, 'old ' || name AS doc_name FROM fund_docs WHERE seq >= 4 UNION ALL SELECT accession_no || 'x', seq, name FROM fund_docs WHERE seq >= 6)
SELECT * FROM old WHERE accession_no NOT IN (SELECT accession_no FROM fresh) UNION ALL SELECT * FROM fresh""")
def _(f):
    docs = f.fund_docs
    scored = docs.where("seq < 4").withColumn("crypto_score", F.length("text") % 10)
    fresh = store.ranked_documents(scored).select("accession_no", "doc_seq", F.col("name").alias("doc_name"))
    old = docs.where("seq >= 4").select("accession_no", F.col("seq").alias("doc_seq"), F.concat(F.lit("old "), "name").alias("doc_name")).unionByName(
        docs.where("seq >= 6").select(F.concat("accession_no", F.lit("x")).alias("accession_no"), F.col("seq").alias("doc_seq"), F.col("name").alias("doc_name"))
    )
    return store.replace(old, fresh)


@query("replace_sections_primary", """, fresh AS (SELECT id + 1000000000 AS id, accession_no, CASE WHEN row_number() OVER (PARTITION BY accession_no ORDER BY id) = 1 THEN 1 ELSE 0 END AS is_primary FROM sections WHERE accession_no IN (SELECT accession_no FROM filings WHERE okey % 4 = 0))
SELECT id, accession_no, is_primary FROM sections WHERE accession_no NOT IN (SELECT accession_no FROM fresh) UNION ALL SELECT * FROM fresh""")
def _(f):
    chosen = f.filings.where("okey % 4 = 0").select("accession_no")
    fresh = f.sections.join(chosen, "accession_no", "left_semi").withColumn("id", F.col("id") + 1000000000)
    return store.replace(f.sections.select("id", "accession_no", "is_primary"), store.first_is_primary(fresh, "id"))


@query("summary_current_flag", "SELECT id, accession_no, CASE WHEN row_number() OVER (PARTITION BY accession_no ORDER BY id DESC) = 1 THEN 1 ELSE 0 END AS is_current FROM (SELECT id, accession_no FROM summaries UNION ALL SELECT max(id) + 5, accession_no FROM summaries WHERE id % 2 = 0 GROUP BY accession_no)")
def _(f):
    added = f.summaries.where("id % 2 = 0").groupBy("accession_no").agg((F.max("id") + 5).alias("id"))
    return store.newest_is_current(f.summaries.select("id", "accession_no").unionByName(added))


@query("primary_section_id", "SELECT accession_no, min(id) AS id FROM sections WHERE is_primary = 1 GROUP BY 1")
def _(f):
    return f.sections.where("is_primary = 1").groupBy("accession_no").agg(F.min("id").alias("id"))


@query("set_primary_override", """, chosen AS (SELECT accession_no, max(id) + CASE WHEN min(id) % 30 = 1 THEN 999 ELSE 0 END AS picked FROM sections WHERE id % 3 = 0 GROUP BY 1)
SELECT id, accession_no, CASE WHEN picked IS NULL THEN is_primary WHEN id = picked THEN 1 ELSE 0 END AS is_primary FROM sections LEFT JOIN chosen USING (accession_no)""")
def _(f):
    chosen = f.sections.where("id % 3 = 0").groupBy("accession_no").agg((F.max("id") + F.when(F.min("id") % 30 == 1, 999).otherwise(0)).alias("id"))
    return store.set_primary(f.sections, chosen).select("id", "accession_no", "is_primary")


@query("fk_set_null", "SELECT id, accession_no, CAST(CASE WHEN section_id IN (SELECT id FROM sections WHERE id % 7 <> 1) THEN section_id END AS VARCHAR) AS section_id FROM summaries")
def _(f):
    return store.null_dangling(f.summaries.select("id", "accession_no", "section_id"), f.sections.where("id % 7 <> 1")).withColumn("section_id", F.col("section_id").cast("string"))


_LOW = "extraction AS (SELECT accession_no, confidence FROM sections WHERE is_primary = 1)"


@query("reprocess_select", f", {_LOW} SELECT f.accession_no, f.form_type, CAST(m.id AS VARCHAR) AS summary_id, e.confidence FROM filings f LEFT JOIN summaries m USING (accession_no) LEFT JOIN extraction e USING (accession_no) WHERE m.summary IS NULL OR e.confidence < 0.5")
def reprocess(f):
    """Filings without a summary or with a weak section; once for each stored summary, as in the reference semantics."""
    primary = f.sections.where("is_primary = 1").select("accession_no", "confidence")
    kept = f.summaries.select("accession_no", F.col("id").cast("string").alias("summary_id"), "summary")
    joined = f.filings.select("accession_no", "form_type").join(kept, "accession_no", "left").join(primary, "accession_no", "left")
    return joined.where("summary IS NULL OR confidence < 0.5").select("accession_no", "form_type", "summary_id", "confidence")


@query("reprocess_low_conf", f", {_LOW} SELECT f.accession_no, e.confidence FROM filings f JOIN extraction e USING (accession_no) WHERE e.confidence < 0.5")
def _(f):
    return f.filings.select("accession_no").join(f.sections.where("is_primary = 1 AND confidence < 0.5").select("accession_no", "confidence"), "accession_no")


@query("reprocess_limit", f", {_LOW} SELECT f.accession_no, e.confidence FROM filings f JOIN extraction e USING (accession_no) WHERE e.confidence < 0.5 ORDER BY 1 LIMIT 25")
def _(f):
    low = f.sections.where("is_primary = 1 AND confidence < 0.5").select("accession_no", "confidence")
    return f.filings.select("accession_no").join(low, "accession_no").orderBy("accession_no").limit(25)


@query("write_caps", "SELECT accession_no, seq, substr(name, 1, 200) AS doc_name, substr(type, 1, 50) AS doc_type, length(substr(text, 1, 500000)) AS raw_chars, length(substr(text, 1, 200000)) AS section_chars FROM fund_docs")
def _(f):
    return f.fund_docs.select("accession_no", "seq", F.substring("name", 1, 200).alias("doc_name"), F.substring("type", 1, 50).alias("doc_type"), F.length(F.substring("text", 1, 500_000)).cast("long").alias("raw_chars"), F.length(F.substring("text", 1, 200_000)).cast("long").alias("section_chars"))


@query("rank_candidates", "SELECT accession_no, id, place FROM (SELECT accession_no, id, row_number() OVER (PARTITION BY accession_no ORDER BY confidence DESC, method, id) AS place FROM sections) WHERE place <= 5")
def _(f):
    from pyspark.sql.window import Window

    order = Window.partitionBy("accession_no").orderBy(F.desc("confidence"), "method", "id")
    return f.sections.select("accession_no", "id", F.row_number().over(order).cast("long").alias("place")).where("place <= 5")
