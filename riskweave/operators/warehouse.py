"""The four tables as Parquet snapshots in one shared folder: creation, migration, reset and writes.

A write makes new snapshot folders of the tables that it changes and then publishes them
together: one small file, renamed into place, names the snapshot of every table. Readers
take the newest such file, so a write that fails between two tables changes nothing. A
lock file keeps writers of a run apart; of two that publish at once one is refused.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import store

SCHEMA_VERSION = 1
ATTEMPTS = 5
#: Tables, parents first.
SCHEMAS = {
    "filings": "accession_no string, cik string, company_name string, ticker string, form_type string, root_form string, filing_date string, filing_category string, tier int, sec_url string, filing_pdf_url string, crypto_connection string, entity_type string, search_keyword string, purpose string, top_holdings string, fetched_at string, processed_at string",
    "documents": "accession_no string, doc_seq int, doc_name string, doc_type string, raw_text string, char_count int, crypto_score int, fund_name string",
    "sections": "id long, accession_no string, section_type string, method string, title string, text string, char_count int, confidence double, is_primary int, extracted_at string",
    "summaries": "id long, accession_no string, section_id long, model string, summary string, is_current int, created_at string",
}
#: Most characters that are stored of a document's name, type and text, and of a section's text.
NAME, TYPE, DOCUMENT, SECTION = 200, 50, 500_000, 200_000


class Locked(RuntimeError):
    """Another writer holds the folder."""


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, wait: float = 1.0) -> None:
        self.spark, self.root, self.wait = spark, root.rstrip("/"), wait
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- folders --

    def _list(self, path: str) -> list[str]:
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _commits(self) -> list[str]:
        return [c for c in self._list(f"{self.root}/_commits") if c.isdigit()]

    def _snapshots(self, nth: int = -1) -> dict[str, str]:
        """The folder of each table's snapshot in the newest commit (or the ``nth`` of all)."""
        commits = self._commits()
        if len(commits) < abs(nth):
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/_commits/{commits[nth]}", wholetext=True).first()[0])

    def _publish(self, written: dict[str, str]) -> None:
        """Make ``written`` the snapshots of their tables, all at once; what neither this commit nor the one before names is deleted."""
        before = self._snapshots()
        nth = max((int(c) for c in self._commits()), default=0) + 1
        given = self._path(f"{self.root}/_commits/_{uuid.uuid4().hex}")
        out = self._fs.create(given, False)
        out.write(bytearray(json.dumps(before | written).encode()))
        out.close()
        if not self._fs.rename(given, self._path(f"{self.root}/_commits/{nth:08d}")):
            self._fs.delete(given, False)
            raise Locked(self.root)
        kept = {*before.values(), *(before | written).values()}
        for name in SCHEMAS:  # one commit stays for readers that have begun
            for old in self._list(f"{self.root}/{name}"):
                if f"{name}/{old}" not in kept:
                    self._fs.delete(self._path(f"{self.root}/{name}/{old}"), True)

    @contextmanager
    def lock(self) -> Iterator[None]:
        """Hold the folder; a lock that stays is waited for a little longer each time, then given up."""
        at = self._path(f"{self.root}/_lock")
        for attempt in range(ATTEMPTS):
            if not self._fs.exists(at) and self._fs.createNewFile(at):
                break
            time.sleep(self.wait * (attempt + 1))
        else:
            raise Locked(self.root)
        try:
            yield
        finally:
            self._fs.delete(at, False)

    # -- life of the tables --

    def version(self) -> int:
        return max((int(v) for v in self._list(f"{self.root}/_schema")), default=0)

    def init(self, older: tuple[str, ...] = ()) -> None:
        """Create what is missing; a folder of this schema version is left as it is.

        Where no tables are there yet, those of the last of the ``older`` folders that has
        some are copied.
        """
        if self.version() >= SCHEMA_VERSION:
            return
        with self.lock():
            if not self._snapshots():
                legacy = [w for w in (Warehouse(self.spark, r) for r in sorted(older)) if w._snapshots()]
                self._publish({name: self._write(name, legacy[-1].read(name) if legacy else self.spark.createDataFrame([], schema)) for name, schema in SCHEMAS.items()})
            self._fs.mkdirs(self._path(f"{self.root}/_schema/{SCHEMA_VERSION}"))

    def reset(self) -> None:
        """Empty all tables."""
        with self.lock():
            self._publish({name: self._write(name, self.spark.createDataFrame([], schema)) for name, schema in SCHEMAS.items()})

    def read(self, name: str) -> DataFrame:
        return self._at(name, self._snapshots()[name])

    def _at(self, name: str, folder: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{folder}")

    def _write(self, name: str, df: DataFrame) -> str:
        """A new snapshot of a table, not yet published."""
        folder = f"{name}/{uuid.uuid4().hex}"
        df.select([c.strip().split(" ")[0] for c in SCHEMAS[name].split(",")]).write.parquet(f"{self.root}/{folder}")
        return folder

    # -- one write of many records --

    def save(self, filings: DataFrame, documents: DataFrame, candidates: DataFrame, summaries: DataFrame) -> None:
        """Write records to all four tables, in one commit.

        ``filings`` are upserted; ``documents`` (accession_no, seq, name, type, text,
        crypto_score, fund_name) and ``candidates`` (accession_no, place, section_type,
        method, title, text, confidence) replace those of their filings, the first
        candidate being primary; ``summaries`` (accession_no, model, summary) become
        current where they aren't empty, linked to the primary section.
        """
        with self.lock():
            made = {"filings": self._write("filings", store.upsert(self.read("filings"), filings))}
            now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
            docs = store.ranked_documents(documents).select(
                "accession_no", F.col("doc_seq").cast("int").alias("doc_seq"), F.substring("name", 1, NAME).alias("doc_name"), F.substring("type", 1, TYPE).alias("doc_type"),
                F.substring("text", 1, DOCUMENT).alias("raw_text"), F.length(F.substring("text", 1, DOCUMENT)).alias("char_count"), F.col("crypto_score").cast("int").alias("crypto_score"), "fund_name",
            )
            made["documents"] = self._write("documents", store.replace(self.read("documents"), docs))
            sections = candidates.select(
                "accession_no", "section_type", "method", "title", F.substring("text", 1, SECTION).alias("text"), F.length(F.substring("text", 1, SECTION)).alias("char_count"),
                "confidence", (F.col("place") == 1).cast("int").alias("is_primary"), now.alias("extracted_at"), "place",
            )
            old = self.read("sections")
            made["sections"] = self._write("sections", store.replace(old, self._numbered(sections, old, ["accession_no", "place"])))
            written = self._at("sections", made["sections"])
            primary = written.where("is_primary = 1").select("accession_no", F.col("id").alias("section_id"))
            told = summaries.where("summary <> ''").join(primary, "accession_no", "left").select("accession_no", "section_id", "model", "summary", F.lit(1).alias("is_current"), now.alias("created_at"))
            kept = store.null_dangling(self.read("summaries"), written)
            added = self._numbered(told, kept, ["accession_no"])
            made["summaries"] = self._write("summaries", store.newest_is_current(kept.unionByName(added.select(kept.columns))))
            self._publish(made)

    def _numbered(self, new: DataFrame, old: DataFrame, order: list[str]) -> DataFrame:
        """``new`` with ids above those of ``old``, in order."""
        last = old.agg(F.max("id")).first()[0] or 0
        return store.numbered(new, order, f"{self.root}/_numbering", last)
