"""Listed and filtered filings, details and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.catalog import query
from riskweave.functions import display as D
from riskweave.functions import text as T
from riskweave.operators import filters
from riskweave.plans.views import COLUMNS, visible
from riskweave.sources import sinks

SHORT = ["accession_no", "company_name", "form_type", "filing_date", "filing_category", "search_keyword", "risk_summary"]
_SHORT = ", ".join(SHORT)
#: What a detail and a listing tell as JSON; engines write the same double alike once it is rounded.
DETAIL = COLUMNS
LISTED = [c for c in DETAIL if c != "risk_section"]


def _told(columns):
    return [F.round(c, 6).alias(c) if c == "extraction_confidence" else F.col(c) for c in columns]


def _listed(f, given):
    return filters.newest_first(filters.apply(visible(f.view), given)).select(*SHORT)


@query("view_display", "SELECT * FROM view_display")
def _(f):
    return f.view


@query("visible_filings", f"SELECT {_SHORT} FROM visible")
def _(f):
    return visible(f.view).select(*SHORT)


@query("list_filings", f"SELECT {_SHORT} FROM visible ORDER BY filing_date DESC, accession_no")
def _(f):
    return _listed(f, {})


for _name, _given, _where in (
    ("filter_company", {"company": "mer#00000001"}, "company_name ILIKE '%mer#00000001%'"),
    ("filter_form_type", {"form_type": "10-K"}, "form_type = '10-K'"),
    ("filter_month", {"month": "1996-05"}, "substr(filing_date, 1, 7) = '1996-05'"),
    ("filter_category", {"filing_category": "ETF/Fund"}, "filing_category = 'ETF/Fund'"),
    ("filter_keyword", {"search_keyword": "bitcoin"}, "search_keyword = 'bitcoin'"),
    ("filter_search_or", {"search": "LOSS_possible"}, "company_name ILIKE '%LOSS_possible%' OR risk_summary ILIKE '%LOSS_possible%' OR form_type ILIKE '%LOSS_possible%'"),
    ("filter_combined", {"company": "customer", "form_type": "", "filing_category": "Operating Co.", "search": "custody"}, "company_name ILIKE '%customer%' AND filing_category = 'Operating Co.' AND (company_name ILIKE '%custody%' OR risk_summary ILIKE '%custody%' OR form_type ILIKE '%custody%')"),
):
    query(_name, f"SELECT {_SHORT} FROM visible WHERE {_where}")(lambda f, given=_given: _listed(f, given))


@query("client_text_filter", f"SELECT {_SHORT} FROM visible WHERE contains(lower(concat_ws(' ', {_SHORT})), 'custody')")
def _(f):
    return visible(f.view).select(*SHORT).where(F.lower(F.concat_ws(" ", *SHORT)).contains("custody"))


def _detail(view, sections):
    best = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("is_primary")).alias("p"), (-F.col("confidence")).alias("c"), "id"))), lambda s: s["id"])
    listed = sections.groupBy("accession_no").agg(F.array_join(best.cast("array<string>"), ",").alias("candidate_ids"))
    return view.join(listed, "accession_no", "left")


_DETAIL = """SELECT v.*, c.candidate_ids FROM view_display v LEFT JOIN
(SELECT accession_no, string_agg(CAST(id AS VARCHAR), ',' ORDER BY is_primary DESC, confidence DESC, id) AS candidate_ids FROM sections GROUP BY 1) c ON c.accession_no = v.accession_no"""


@query("filing_detail", _DETAIL)
def _(f):
    """Every filing by key with its candidates, best first."""
    return _detail(f.view, f.sections)


def _row_sql(columns) -> str:
    return "CAST(to_json({" + ", ".join(f"'{c}': " + (f"round({c}, 6)" if c == "extraction_confidence" else c) for c in columns) + "}) AS VARCHAR)"


@query("api_detail_json", f"SELECT accession_no, {_row_sql([*DETAIL, 'candidate_ids'])} AS body FROM ({_DETAIL})")
def _(f):
    """Every filing's detail as JSON; null fields are told as null."""
    detail = _detail(f.view, f.sections)
    return detail.select("accession_no", F.to_json(F.struct(*_told(DETAIL), "candidate_ids"), {"ignoreNullFields": "false"}).alias("body"))


@query("api_section_text", "SELECT id, CAST(to_json({'text': text, 'html': '<h4 class=\"risk\">' || text || '</h4>'}) AS VARCHAR) AS body FROM sections")
def _(f):
    """Each candidate's text and its HTML as JSON (the made sections are one short line)."""
    return f.sections.select("id", F.to_json(F.struct("text", T.risk_html(F.col("text")).alias("html"))).alias("body"))


@query("api_filings_json", f"SELECT accession_no, {_row_sql(LISTED)} AS body FROM visible")
def _(f):
    """Rows as JSON without the long section text."""
    return visible(f.view).select("accession_no", F.to_json(F.struct(*_told(LISTED)), {"ignoreNullFields": "false"}).alias("body"))


@query("scan_accessions", "SELECT accession_no FROM filings")
def _(f):
    return f.filings.select("accession_no")


_ALL = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in COLUMNS)


@query("export_csv_roundtrip", f"SELECT {_ALL} FROM visible WHERE filing_category = 'ETF/Fund'")
def _(f):
    """The filtered view, all of its columns, written as CSV and read again."""
    rows = filters.newest_first(filters.apply(visible(f.view), filters.from_request({"filing_category": " ETF/Fund ", "company": "  "})))
    return sinks.read_csv(f.spark, sinks.export_csv(f.spark, rows.select(*[F.col(c).cast("string").alias(c) for c in COLUMNS])), COLUMNS)


@query("export_workbook_roundtrip", f"SELECT {_ALL} FROM visible WHERE form_type = '10-K'")
def _(f):
    """The filtered view as spreadsheet files, all of its columns, read again."""
    rows = filters.newest_first(filters.apply(visible(f.view), {"form_type": "10-K"}))
    return sinks.read_workbooks(f.spark, sinks.export_workbooks(f.spark, rows.select(*[D.excel_cell(F.col(c).cast("string")).alias(c) for c in COLUMNS])), COLUMNS)


@query("export_excel_rows", """SELECT accession_no, regexp_replace(company_name, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g') AS company_name,
  CASE WHEN length(risk_summary) > 32767 THEN substr(risk_summary, 1, 32764) || '...' ELSE risk_summary END AS risk_summary FROM visible""")
def _(f):
    return visible(f.view).select("accession_no", *[D.excel_cell(F.col(c)).alias(c) for c in ("company_name", "risk_summary")])


@query("excel_sanitize", r"""SELECT doc_id, length(v) AS n, md5(v) AS digest FROM (SELECT doc_id, CASE WHEN length(t) > 32767 THEN substr(t, 1, 32764) || '...' ELSE t END AS v FROM
  (SELECT doc_id, regexp_replace(chr(7) || coalesce(text, '') || chr(11) || text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g') AS t FROM documents))""")
def _(f):
    cell = D.excel_cell(F.concat(F.char(F.lit(7)), F.coalesce("text", F.lit("")), F.char(F.lit(11)), "text"))
    return f.documents.select("doc_id", cell.alias("v")).select("doc_id", F.length("v").cast("long").alias("n"), F.md5(F.col("v").cast("binary")).alias("digest"))


@query("display_truncate", """SELECT doc_id, CASE WHEN length(text) > 140 THEN substr(text, 1, 140) || '...' ELSE text END AS short_summary,
  CASE WHEN length(name) > 30 THEN substr(name, 1, 28) || '...' ELSE name END AS label FROM (SELECT doc_id, text, company_name || ' ' || CASE WHEN root_form = '10-K' THEN accession_no ELSE form_type END AS name FROM texts)""")
def _(f):
    name = F.concat_ws(" ", "company_name", F.when(F.col("root_form") == "10-K", F.col("accession_no")).otherwise(F.col("form_type")))
    return f.texts.select("doc_id", D.short_summary(F.col("text")).alias("short_summary"), D.label(name).alias("label"))


@query("form_badge", """SELECT DISTINCT form_type, CASE WHEN contains(form_type, '10-K') THEN '10k' WHEN contains(form_type, '10-Q') THEN '10q' WHEN contains(form_type, '8-K') THEN '8k' WHEN contains(form_type, '485') THEN '485'
  WHEN contains(form_type, 'N-1A') THEN 'n1a' WHEN contains(form_type, 'S-1') THEN 's1' ELSE 'other' END AS badge, lower(replace(replace(form_type, '/', ''), '-', '')) AS slug FROM filings""")
def _(f):
    return f.filings.select("form_type", D.badge(F.col("form_type")).alias("badge"), F.lower(F.replace(F.replace("form_type", F.lit("/"), F.lit("")), F.lit("-"), F.lit(""))).alias("slug")).distinct()


@query("confidence_bucket", """SELECT accession_no, CASE WHEN extraction_confidence = 0 THEN 'N/A' WHEN extraction_confidence >= 0.7 THEN 'high' WHEN extraction_confidence >= 0.4 THEN 'medium' ELSE 'low' END AS bucket,
  CAST(round(extraction_confidence * 100) AS INTEGER) AS percent FROM view_display""")
def _(f):
    c = F.col("extraction_confidence")
    return f.view.select("accession_no", D.bucket(c).alias("bucket"), F.round(c * 100).cast("int").alias("percent"))
