"""The display view: filings with their primary section and current summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ["accession_no", "cik", "company_name", "ticker", "form_type", "root_form", "filing_date", "filing_category", "tier", "sec_url", "filing_pdf_url", "crypto_connection", "entity_type", "search_keyword", "processed_at", "purpose", "top_holdings"]

COLUMNS = [*BASE, "risk_section", "text_length", "extraction_confidence", "extraction_method", "section_type", "risk_summary", "summary_model"]


def display(filings: DataFrame, sections: DataFrame, summaries: DataFrame) -> DataFrame:
    """24 columns; missing sections and summaries give empty strings and zeros."""
    primary = sections.where("is_primary = 1").select("accession_no", F.col("text").alias("s_text"), "char_count", "confidence", "method", F.col("section_type").alias("s_type"))
    current = summaries.where("is_current = 1").select("accession_no", "summary", "model")
    joined = filings.join(primary, "accession_no", "left").join(current, "accession_no", "left")
    return joined.select(
        *BASE,
        F.coalesce("s_text", F.lit("")).alias("risk_section"),
        F.coalesce("char_count", F.lit(0)).alias("text_length"),
        F.coalesce("confidence", F.lit(0.0)).alias("extraction_confidence"),
        F.coalesce("method", F.lit("")).alias("extraction_method"),
        F.coalesce("s_type", F.lit("")).alias("section_type"),
        F.coalesce("summary", F.lit("")).alias("risk_summary"),
        F.coalesce("model", F.lit("")).alias("summary_model"),
    )


def visible(view: DataFrame) -> DataFrame:
    """Only filings that have a summary show in lists and figures."""
    return view.where(F.col("risk_summary") != "")


def gated(filings: DataFrame, summaries: DataFrame) -> DataFrame:
    """The filings that show, for figures that name no column of a section: sections, of which a filing has one primary at most, aren't read."""
    return filings.join(summaries.where("is_current = 1 AND summary <> ''").select("accession_no"), "accession_no")


VIEW_SQL = f"""view_display AS (
  SELECT {", ".join("f." + c for c in BASE)}, coalesce(s.text, '') AS risk_section, coalesce(s.char_count, 0) AS text_length, coalesce(s.confidence, 0) AS extraction_confidence,
    coalesce(s.method, '') AS extraction_method, coalesce(s.section_type, '') AS section_type, coalesce(m.summary, '') AS risk_summary, coalesce(m.model, '') AS summary_model
  FROM filings f LEFT JOIN sections s ON s.accession_no = f.accession_no AND s.is_primary = 1 LEFT JOIN summaries m ON m.accession_no = f.accession_no AND m.is_current = 1
), visible AS (SELECT * FROM view_display WHERE risk_summary <> '')"""
