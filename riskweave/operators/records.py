"""From work items and texts to the records of the four tables, as one dataflow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import fixed, terms
from riskweave.functions.text import ascii_fold, fund_name
from riskweave.operators import extract, ingest, metadata, summary
from riskweave.session import drop_folder, small_batches, work_folder

#: Attachments that are looked at, and the least characters of one that counts.
ATTACHMENTS, ATTACHMENT_LEAST = 5, 500
TEXT_LEAST, HEAD = 200, 5_000
#: Texts, and bytes of them about, that a task hands to one Python worker at a time.
BATCH, BATCH_BYTES = 500, 4 << 20
FILING = ("accession_no", "cik", "company_name", "ticker", "form_type", "root_form", "filing_date", "filing_category", "tier", "sec_url", "filing_pdf_url", "crypto_connection", "entity_type", "search_keyword", "purpose", "top_holdings", "fetched_at", "processed_at")


@dataclass(frozen=True)
class Records:
    """What is stored of a run: a row a filing, its documents, its candidate sections (``place`` from 1) and its summary."""

    filings: DataFrame
    documents: DataFrame
    sections: DataFrame
    summaries: DataFrame


def fund_documents(attachments: DataFrame) -> DataFrame:
    """The first attachments of each filing that are text and long enough, with their score and the fund that they name."""
    kept = attachments.where((F.col("seq") < ATTACHMENTS) & (F.col("is_binary") == 0) & (F.length("text") >= ATTACHMENT_LEAST))
    score = terms.counted(F.substring("text", 1, 20_000))["crypto"]
    return kept.select("accession_no", "seq", "name", "type", "text", score.alias("crypto_score"), fund_name(F.col("text")).alias("fund_name"))


def compose(work: DataFrame, texts: DataFrame, attachments: DataFrame, companies: DataFrame, details: DataFrame, now: str, replies: DataFrame | None = None) -> Records:
    """The records of ``work`` (accession_no, cik, company_name, ticker, form_type, root_form, filing_date, keyword).

    ``texts`` (accession_no, text); ``attachments`` (accession_no, seq, name, type, url,
    is_binary, text); the dimensions ``companies`` and ``details``; ``replies`` of a hosted
    model by accession_no, if any. A filing without a text of ``TEXT_LEAST`` characters or
    without a candidate is dropped. Candidates and summaries are found once and stand, with
    what else comes from a text, in one stage table in the shared folder, scored documents in
    another; all four outputs read these, so that a write that evaluates an output several
    times reads no text again. What the headings leave open stands in a third table until its
    paragraphs are read, so that no task keeps the Python workers of all strategies.
    """
    spark = work.sparkSession
    passing = work_folder(spark, "tried")

    def staged(df: DataFrame, path: str) -> DataFrame:
        with small_batches(spark, BATCH, BATCH_BYTES):
            df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    sourced = work.join(texts.select("accession_no", "text"), "accession_no").where(F.length("text") >= TEXT_LEAST)
    shared = work.where(F.col("root_form").isin(*fixed.MULTI_FUND_FORMS)).select("accession_no", "root_form")
    documents = staged(fund_documents(attachments.join(shared.select("accession_no"), "accession_no", "left_semi")), work_folder(spark, "documents"))
    told = sourced.withColumns({"connection": metadata.connection(F.col("text"), F.col("root_form")), "matched": ingest.matched_keyword(F.substring("text", 1, HEAD))})
    long = sourced.where(F.col("root_form").isin(*fixed.MULTI_FUND_FORMS)).select("accession_no", "root_form")
    found = extract.with_best_document(told, long, documents, key="accession_no", carry=("connection", "matched"), stage=lambda df: staged(df, passing))
    found = work.join(found, "accession_no").withColumn("text", F.get("best", F.lit(0))["text"])
    stage = staged(summary.with_summary(found).drop("text"), work_folder(spark, "records"))
    drop_folder(spark, passing)

    pdf = F.min(F.when(F.col("url").endswith(".pdf"), F.struct("seq", "url")))["url"]
    urls = attachments.groupBy("accession_no").agg(pdf.alias("pdf"))
    root = F.col("root_form")
    base = stage.drop("best", "summary").withColumns({
        "company_name": F.coalesce(ascii_fold("company_name"), F.lit("")), "filing_category": F.when(metadata.is_fund(root), "ETF/Fund").otherwise("Operating Co."), "tier": F.when(metadata.is_fund(root), 1).otherwise(2),
        "sec_url": metadata.filing_url(F.col("cik"), F.col("accession_no")), "crypto_connection": F.col("connection"), "search_keyword": F.when(F.coalesce("keyword", F.lit("")) != "", F.col("keyword")).otherwise(F.col("matched")),
    })
    made = metadata.generate(base, companies, details).join(urls, "accession_no", "left")
    filings = made.withColumns({"filing_pdf_url": F.coalesce("pdf", F.lit("")), "entity_type": F.col("display_type"), "purpose": F.col("new_purpose"), "top_holdings": F.col("new_holdings"), "fetched_at": F.lit(now), "processed_at": F.lit(now)}).select(*FILING)
    return Records(
        filings,
        documents.join(stage.select("accession_no"), "accession_no", "left_semi"),
        stage.select("accession_no", F.inline("best")),
        summary.replied(stage.select("accession_no", "summary"), "accession_no", replies),
    )
