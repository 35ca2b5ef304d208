"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases and phrases into longer phrases, level by level.
Where a phrase begins is decided by deterministic coin tossing: neighbouring names
(made distinct by counting runs as one) get labels from the lowest bit in which they
differ, again and again until six labels are left, and local maxima of the labels begin
phrases. A beginning depends on a few neighbours only, and a phrase is named by a hash
of its contents, so equal substrings get equal names inside, at whatever offset they
stand. The fingerprint is the bottom-k sketch of the names of levels ``LEVELS`` (each
salted with its level); the likeness of two texts is the share that they have in common
among the smallest k of both sketches, an estimate of the names' Jaccard similarity.

All texts of a batch are parsed at once; a text's first name has no neighbour on its
left and always begins a phrase, so a text's fingerprint doesn't depend on its batch.

Defined results: null and empty texts have the empty fingerprint, and two empty
fingerprints a likeness of 1, an empty and another one of 0; texts of equal doc_id are
ordered by the texts' hashes; null ids come first; one text alone is followed by itself; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common, words

U = np.uint64
LEVELS = (1, 2, 3)
SKETCH = 64
#: Sampled rows for each bucket of documents.
SAMPLED = 40
_P = words._powers(0xD1342543DE82EF95, 64)


def _toss_table(n: int) -> np.ndarray:
    """label[a, b]: twice the place of the lowest bit in which b differs from its left neighbour a, plus that bit of b."""
    a, b = np.arange(n)[:, None], np.arange(n)[None, :]
    low = (a ^ b) & -(a ^ b)
    place = np.where(low > 0, np.log2(np.maximum(low, 1)).astype(int), 0)
    return (2 * place + ((b >> place) & 1)).astype(np.uint8)


_BYTES, _WIDE, _SMALL = _toss_table(256), _toss_table(128), _toss_table(16)
_FIRST = np.uint8(255)


def _begins(labels: np.ndarray, head: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where phrases begin, from first labels of which neighbours differ; ``head``: a text's first name."""
    x = labels
    for t in (table, _SMALL, _SMALL):
        left = np.empty_like(x)
        left[1:] = x[:-1]
        left[head] = x[head] ^ 1  # no neighbour: as if the lowest bit differed
        x = t.ravel()[left.astype(np.uint16) * np.uint16(t.shape[0]) + x]
    left, right = np.empty_like(x), np.empty_like(x)
    left[1:], right[:-1] = x[:-1], x[1:]
    left[head] = 0
    right[-1] = 0
    ends = np.flatnonzero(head)[1:] - 1
    right[ends] = 0
    top = (x > left) & (x >= right)
    top[head] = True
    return top


def _wide_labels(names: np.ndarray, head: np.ndarray) -> np.ndarray:
    """First labels (below 128) of 64-bit names of which neighbours differ."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[head] = names[head] ^ U(1)
    differ = left ^ names
    low = differ & (~differ + U(1))
    place = (np.frexp(low.astype(np.float64))[1] - 1).astype(np.uint8)
    bit = ((names >> place.astype(U)) & U(1)).astype(np.uint8)
    return place * np.uint8(2) + bit


def _phrases(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A name for each phrase: a hash of its values in turn."""
    at = np.flatnonzero(begin)
    within = np.arange(len(values)) - np.repeat(at, np.diff(np.append(at, len(values))))
    value = values * _P[within]  # six labels leave a dozen values in a phrase at most
    size = np.diff(np.append(at, len(values))).astype(U)
    return words.mix64(np.add.reduceat(value, at) + size * U(0x9E3779B97F4A7C15))


def _runs(x: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal neighbours inside a text: where each begins, its length, and whether it is its text's first."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new |= head
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(x))), head[at]


def parse(data: np.ndarray, off: np.ndarray, levels: int = max(LEVELS)) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level from 1: the names of all phrases, text by text, and the offsets of each text's."""
    out = []
    full = np.flatnonzero(np.diff(off) > 0)
    head = np.zeros(len(data), bool)
    head[off[:-1][full]] = True
    names: np.ndarray = data
    for level in range(1, levels + 1):
        if not len(names):
            out.append((np.zeros(0, U), np.zeros(len(off), np.int64)))
            continue
        at, size, head = _runs(names, head)
        own = names[at]
        if level == 1:
            begin, value = _begins(own, head, _BYTES), words._BYTE[own]
        else:
            begin, value = _begins(_wide_labels(own, head), head, _WIDE), own
        long = size > 1
        value = value.copy()
        value[long] = words.mix64(value[long] + size[long].astype(U))
        names = _phrases(value, begin)
        at = np.flatnonzero(begin)
        head = head[at]
        ends = np.zeros(len(off), np.int64)
        per = np.diff(np.append(np.flatnonzero(head), len(names)))
        count = np.zeros(len(off) - 1, np.int64)
        count[full] = per
        np.cumsum(count, out=ends[1:])
        out.append((names, ends))
    return out


def sketches(col: pa.Array) -> list[np.ndarray]:
    """The sorted distinct SKETCH smallest salted names of each text."""
    data, off = words.text_bytes(col)
    found = parse(data, off)
    salted = [words.mix64(found[level - 1][0] ^ U(0xA5A5 * level)) for level in LEVELS]
    limit = U(2**64 - 1)
    out = []
    for i in range(len(off) - 1):
        parts = [s[found[level - 1][1][i] : found[level - 1][1][i + 1]] for s, level in zip(salted, LEVELS, strict=True)]
        own = np.concatenate(parts)
        if len(own) > 4 * SKETCH:  # the smallest are below a bound that nearly always leaves enough
            bound = U(min(int(limit), int(3 * SKETCH / len(own) * 2**64)))
            low = np.unique(own[own <= bound])
            own = low if len(low) >= SKETCH else np.unique(own)
        else:
            own = np.unique(own)
        out.append(own[:SKETCH])
    return out


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    k = min(SKETCH, max(len(a), len(b)))
    both = np.union1d(a, b)[:k] if max(len(a), len(b)) == SKETCH else np.union1d(a, b)
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).sum() / len(both))


def likeness_of(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    return likeness(*(np.frombuffer(bytes.fromhex(x), ">u8").astype(U) for x in (a, b)))


def edited(text: str, follower: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``follower``."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows (bucket, last, doc_id, text) in which each document's follower is the next row of its bucket.

    Buckets are ranges of (doc_id, hash of the text), cut at quantiles of a bounded
    sample, so that an id that many rows share is cut too; each is one task's. The first
    document of each bucket is sent to the bucket before it too (``last``), the very first
    one to the last bucket.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with common.scratch(spark) as tables:
        keys = docs.select("doc_id", "hash")
        drawn = sorted((r.doc_id is not None, r.doc_id or 0, r.hash) for r in common.bounded_sample(keys, SAMPLED * parts, "doc_id", "hash").collect())
        edges = sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if len(drawn) > 1 else []
        bucket_of = F.pandas_udf(_bucketing(edges), "int")
        keyed = docs.withColumn("bucket", bucket_of("doc_id", "hash"))
        firsts = tables.kept(keyed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "hash")).alias("m")).select("bucket", "m.doc_id", "m.hash"), "first-documents")  # a row a bucket
    order = [r.bucket for r in firsts.select("bucket").orderBy("bucket").collect()]
    before = {b: order[i - 1] for i, b in enumerate(order)}
    moved = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("bucket")) if before else F.lit(0)
    first = firsts.select(F.col("bucket").alias("b"), F.col("doc_id").alias("d"), F.col("hash").alias("h"))
    heads = keyed.join(F.broadcast(first), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")))
    heads = heads.groupBy("bucket").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"), F.first("hash").alias("hash")).select(moved.alias("bucket"), F.lit(True).alias("last"), "doc_id", "hash", "text")
    both = keyed.select("bucket", F.lit(False).alias("last"), "doc_id", "hash", "text").unionByName(heads)
    return both.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "last", "doc_id", "hash", "text").drop("hash")


def _bucketing(edges: list[tuple[bool, int, int]]):
    """The bucket of (doc_id, hash): how many of the sorted ``edges`` (has an id, doc_id, hash) are not above it."""
    nulls = np.array([h for named, _, h in edges if not named], np.int64)
    ids, hashes = (np.array([e[k] for e in edges if e[0]], np.int64) for k in (1, 2))

    def run(doc_id: pd.Series, hash: pd.Series) -> pd.Series:
        none = doc_id.isna().to_numpy()
        own, h = doc_id.fillna(0).astype("int64").to_numpy(), hash.to_numpy()
        out = np.searchsorted(ids, own, "left")
        equal = np.searchsorted(ids, own, "right") > out
        for d in np.unique(own[equal & ~none]):  # ids that are edges: their hashes decide
            at = own == d
            a, b = np.searchsorted(ids, [d], "left")[0], np.searchsorted(ids, [d], "right")[0]
            out[at] = a + np.searchsorted(hashes[a:b], h[at], "right")
        out = np.where(none, np.searchsorted(nulls, h, "right"), out + len(nulls))
        return pd.Series(out.astype(np.int32))

    return run


def _fingerprints(batches):
    """Fingerprints of a partition's documents, each with its follower, the next row of its bucket."""
    def finish(ids: list, texts: list[str], following: str):
        follow = [*texts[1:], following]
        changed = [edited(a, b) for a, b in zip(texts, follow, strict=True)]
        own = sketches(pa.array([*texts, following], pa.string()))
        new = sketches(pa.array(changed, pa.string()))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                "fingerprint": [text_of(s) for s in own[:-1]],
                "edited_fingerprint": [text_of(s) for s in new],
                "near_edited": [likeness(a, b) for a, b in zip(own, new, strict=False)],
                "near_next": [likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)],
            }
        )

    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text, last in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "last")), strict=True):
            if texts and (last or size + len(text) > words.CHUNK // 2):
                yield from finish(ids, texts, text)
                ids, texts, size = [], [], 0
            if not last:
                ids.append(doc_id)
                texts.append(text)
                size += len(text)


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text), of their edited texts, and their likeness."""
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(spark, docs).mapInArrow(_fingerprints, kinds)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(spark, common.table(spark, sf_dir, "documents"))
