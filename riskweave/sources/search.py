"""The filings index as a Python data source; offline it reads JSON pages from a shared folder.

``read(spark, folder)`` has two modes. ``search``: the answers to searches of a form and a
keyword batch. ``company``: the listings of a company and a form, newest first, at most
``cap`` rows of each. Rows are (key, sub, nth, position, file_date, okey, hit, error): key
and sub are the form and the batch, or the company and the form; ``nth`` counts the
searches in order; ``position`` is a hit's place in its answer.

A page's name tells its search, its place and the first and last date of its hits, so
filters on key, sub, position and file_date are pushed to the reader, which leaves pages
that can't hold a wanted hit unopened. A page that can't be read is tried once more, then
ends its search with a row that has an ``error`` in place of a hit and passes the same filters; ``unbroken`` drops what
comes after too many failed searches in a row.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.window import Window

RETRIES, MAX_FAILURES, PAGE = 1, 3, 100
#: Most partitions of a scan: searches or companies beyond that share one.
PARTITIONS = 10_000


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    parts = urlparse(uri)
    return (fs.LocalFileSystem(), unquote(parts.path)) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def _safe(text: str) -> str:
    return quote(text, safe="").replace("_", "%5F")


def page_name(key: str, sub: str, page: int, first: str = "", last: str = "") -> str:
    return f"{_safe(key)}_{_safe(sub)}_{page:06d}_{_safe(first)}_{_safe(last)}.json"


def write_pages(hits: DataFrame, folder: str, *order) -> None:
    """Write ``hits`` (key, sub, okey, file_date, hit: JSON) as the index would answer: pages of ``PAGE`` hits of each key and sub.

    Rows are dealt by (key, sub) and sorted by ``order``, so a task holds one page at a time.
    """

    def pages(batches):
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        held, key, nth, written = [], None, 0, 0

        def flush():
            dates = [h["date"] for h in held]
            with store.open_output_stream(f"{path}/{page_name(*key, nth, min(dates), max(dates))}") as out:
                out.write(json.dumps({"hits": {"hits": [{"okey": h["okey"], "date": h["date"], **h["hit"]} for h in held]}}).encode())

        for batch in batches:
            for row in batch.to_pylist():
                own = (row["key"], row["sub"])
                if held and (own != key or len(held) == PAGE):
                    flush()
                    held, nth, written = [], nth + 1 if own == key else 0, written + 1
                elif own != key:
                    nth = 0
                key = own
                held.append({"okey": row["okey"], "date": row["file_date"] or "", "hit": json.loads(row["hit"])})
        if held:
            flush()
        yield pa.RecordBatch.from_pydict({"n": pa.array([written], pa.int32())})

    dealt = hits.repartition("key", "sub").sortWithinPartitions("key", "sub", *order)
    dealt.select("key", F.col("sub").cast("string").alias("sub"), "okey", "file_date", "hit").mapInArrow(pages, "n int").count()


class _Answers(InputPartition):
    """Searches of one partition: (nth, key, sub, [(page, file, a date of it within the wanted ones)])."""

    def __init__(self, searches: list[tuple[int, str, str, list[tuple[int, str, str]]]]) -> None:
        self.searches = searches


class _Reader(DataSourceReader):
    def __init__(self, path: str, cap: int | None) -> None:
        self.path, self.below = path, cap
        self.equal: dict[str, set[str]] = {}
        self.first, self.last = "", "￿"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Note what narrows the pages; all filters are returned, since a page that is read may still hold other hits."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            value = getattr(f, "value", None)
            if name in ("key", "sub") and isinstance(f, EqualTo | In):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.equal[name] = self.equal.get(name, wanted) & wanted
            elif name == "position" and isinstance(f, LessThan | LessThanOrEqual):
                limit = value + isinstance(f, LessThanOrEqual)
                self.below = limit if self.below is None else min(self.below, limit)
            elif name == "file_date" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, value)
            if name == "file_date" and isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.last = min(self.last, value)
            yield f

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.path)
        found: dict[tuple[str, str], list[tuple[int, str, str, str]]] = {}
        for info in sorted(store.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda i: i.path):
            parts = os.path.basename(info.path).removesuffix(".json").split("_")
            if info.path.endswith(".json") and len(parts) == 5:
                key, sub, page, first, last = map(unquote, parts)
                found.setdefault((key, sub), []).append((int(page), info.path, first, last))
        searches = []
        for nth, ((key, sub), pages) in enumerate(sorted(found.items())):
            if all(v in self.equal.get(n, {v}) for n, v in (("key", key), ("sub", sub))):
                kept = [(p, file, min(last, self.last)) for p, file, first, last in pages if (self.below is None or p * PAGE < self.below) and first <= self.last and last >= self.first]
                if kept:
                    searches.append((nth, key, sub, kept))
        step = -(-len(searches) // PARTITIONS) or 1
        return [_Answers(searches[i : i + step]) for i in range(0, len(searches), step)] or [_Answers([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for nth, key, sub, pages in partition.searches:
            for page, file, date in pages:
                hits = error = None
                for attempt in range(RETRIES + 1):
                    try:
                        with store.open_input_stream(file) as source:
                            hits = json.loads(source.read())["hits"]["hits"][:PAGE]
                        break
                    except (OSError, ValueError, KeyError, TypeError) as failed:
                        error = f"{type(failed).__name__}: {failed}"[:120]
                        if attempt < RETRIES:
                            time.sleep(0.01)
                if hits is None:
                    yield key, sub, nth, page * PAGE, date, None, None, error
                    break
                for i, hit in enumerate(hits):
                    if self.below is not None and page * PAGE + i >= self.below:
                        break
                    known = hit if isinstance(hit, dict) else {}
                    rest = {k: v for k, v in known.items() if k not in ("okey", "date")} if known else hit
                    yield key, sub, nth, page * PAGE + i, known.get("date"), known.get("okey"), json.dumps(rest), None


class FilingSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filing_search"

    def schema(self) -> str:
        return "key string, sub string, nth int, position int, file_date string, okey long, hit string, error string"

    def reader(self, schema) -> DataSourceReader:
        cap = self.options.get("cap")
        return _Reader(self.options["path"], int(cap) if cap else None)


def read(spark: SparkSession, folder: str, cap: int | None = None) -> DataFrame:
    """The hits of ``folder``, the first ``cap`` of each search if given; filters on them reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilingSearch)
    reader = spark.read.format("filing_search").option("path", folder)
    return (reader.option("cap", cap) if cap else reader).load()


def unbroken(answers: DataFrame) -> DataFrame:
    """The hits of ``answers`` up to the search that is the third in a row to fail; a search with a hit or without any error hasn't.

    There is a row a search in the count of failures, of which there are forms times batches.
    """
    state = answers.groupBy("nth").agg(F.max(F.col("error").isNotNull()).alias("failed"))
    order = Window.orderBy("nth")
    in_a_row = F.col("failed")
    for back in range(1, MAX_FAILURES):
        in_a_row = in_a_row & F.lag("failed", back, False).over(order)
    ended = F.max("trips").over(order.rowsBetween(Window.unboundedPreceding, 0))
    alive = state.withColumn("trips", in_a_row).withColumn("ended", ended).where("NOT ended").select("nth")
    return answers.where("error IS NULL").join(alive, "nth", "left_semi").drop("error")
