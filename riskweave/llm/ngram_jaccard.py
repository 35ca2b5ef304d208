"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

Words are folded (lower case; runs of letters and digits) and a document is its set of
five-word shingles; a document of one to four words is one shingle of all of them.
Documents with equal sets form a class first, so copies cost one representative. The
representatives' MinHash values are banded, rows and bands chosen for a target recall
at the threshold, and shuffled on band hashes. What shares a bucket is tied to the
bucket's smallest id; connected ties give candidate clusters. A cluster of one block's
size, or one in which most pairs share a band, is verified whole; any other bucket by
bucket, so that only pairs that share a band are compared. Each set travels once to its
cluster, or to its buckets. A group above a block's size is dealt out over pairs of
blocks, so no task holds an unbounded group, and no step emits a row for each pair: it
returns counts of links and spanning edges.

Defined results: null or wordless texts have no links and are classes of their own; rows
are told apart by doc_id and text, so different texts under one doc_id are rows of their
own and repeated rows are copies; a null id is a row like any other and never names a
class that has an id; empty tables give empty results; other columns are ignored, or
carried along by ``keep_one`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common, words
from riskweave.llm.components import components

THRESHOLD = (4, 5)  # similarity of 0.8 as a fraction, so that it is compared in integers
RECALL = 0.9999
#: Members, and shingles of all members, of one block of a large cluster.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
U = np.uint64


def choose_bands(threshold: float, recall: float = RECALL, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at ``threshold`` with probability ``recall``."""
    fits = [(math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)), r) for r in range(1, 20)]
    return max((x for x in fits if x[0] * x[1] <= hashes), key=lambda x: x[1])


def minhash(values: np.ndarray, off: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of the sets ``values[off[i]:off[i+1]]``, none of them empty."""
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
    short = (values >> U(32)).astype(np.uint32)
    out = np.zeros((len(off) - 1, bands), U)
    for k in range(bands * rows):
        low = np.minimum.reduceat(short * a[k] + b[k], off[:-1])
        out[:, k // rows] += words.mix64(low.astype(U) + U(k << 32))
    return words.mix64(out + np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def set_digest(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each non-empty set."""
    return tuple(np.add.reduceat(words.mix64(values ^ U(salt)), off[:-1]) for salt in (0x1234567, 0xABCDEF01))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    text = batch.column("text")
    for at, to in words.chunks(text):
        values, off = words.unique_sets(*words.folded_shingles(text.slice(at, to - at)))
        yield at, to, values, off


def sketches(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for at, to, values, off in _sets(batch):
                n = np.diff(off)
                has = np.flatnonzero(n)
                d1, d2, keys = np.zeros(len(n), U), np.zeros(len(n), U), np.zeros((0, bands), U)
                if len(has):
                    own = np.append(off[has], off[-1])
                    d1[has], d2[has] = set_digest(values, own)
                    keys = minhash(values, own, bands, rows)
                ends = np.zeros(len(n) + 1, np.int32)
                np.cumsum(np.where(n > 0, bands, 0), out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends), _longs(keys.ravel()))
                own = [batch.column(c).slice(at, to - at) for c in ("doc_id", "hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int32)), _longs(d1), _longs(d2), lists], ["doc_id", "hash", "n", "d1", "d2", "bands"])

    return run


def _full_sets(batches):
    """Classes with their full sets."""
    for batch in batches:
        for at, to, values, off in _sets(batch):
            raw = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer((off * 8).astype(np.int64)), pa.py_buffer(values.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), raw], ["id", "shingles"])


def _linked(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """The matrix of pairs of sets that reach the threshold (false on the diagonal)."""
    sizes = np.array([len(x) for x in sets])
    m, (num, den) = len(sets), THRESHOLD
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    new = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = new[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common_n = np.zeros((m, m), np.float32)
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (at, at + width))
        x = np.zeros((m, width), np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        common_n += x @ x.T
    both = common_n.astype(np.int64)
    out = both * den >= num * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(out, False)
    return out


def verify(table: pa.Table) -> pa.Table:
    """Links of one group, or between two blocks of a large one: (u, links) counts and (u, v) spanning edges.

    In a group that is the bucket of band ``no``, a pair that shares an earlier band too
    is left to that band's bucket, so every pair counts once.
    """
    ids, size, block = (table.column(c).to_numpy() for c in ("id", "size", "block"))
    order = np.argsort(ids)
    ids, size, block = ids[order], size[order], block[order]
    raw = table.column("shingles").to_pylist()
    linked = _linked([np.frombuffer(raw[i], U) for i in order])
    no = table.column("no")[0].as_py()
    if no > 0:
        bands = np.array(table.column("bands").to_pylist(), np.int64)[order]
        for earlier in range(no):
            linked &= bands[:, None, earlier] != bands[None, :, earlier]
    if table.column("a")[0].as_py() != table.column("b")[0].as_py():
        linked &= block[:, None] != block[None, :]
    label = np.arange(len(ids))
    while True:
        near = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(1, initial=len(ids)))
        near = near[near]
        if (near == label).all():
            break
        label = near
    links = linked @ size
    tied = np.flatnonzero(label != np.arange(len(ids)))
    some = np.flatnonzero(links)
    none = [None] * len(some)
    return pa.table({"u": np.concatenate([ids[some], ids[tied]]), "v": pa.array(none + ids[label[tied]].tolist(), pa.int64()), "links": pa.array(links[some].tolist() + [None] * len(tied), pa.int64())})


def _blocks(n: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _groups(tables: common.Scratch, members: DataFrame) -> DataFrame:
    """(id, group, no, blocks): where each of ``members`` (id, cluster, n, bands) is verified.

    A cluster is verified whole (no -1) if it fits one block, or if its buckets hold as
    many pairs as it does. A larger one, held together by chains of unlike documents, is
    verified bucket by bucket: one for each distinct membership, of the first band that has it.
    """
    pairs = lambda n: n.cast("double") * n
    whole = members.groupBy("cluster").agg(F.count("*").alias("held"), F.sum("n").alias("shingles"))
    whole = tables.written(whole.withColumn("blocks", _blocks(F.col("held"), F.col("shingles"))), "clusters")
    large = whole.where("blocks > 1").select("cluster", F.col("held").alias("members"))
    banded = members.join(large, "cluster").select("id", "cluster", "members", "n", F.posexplode("bands").alias("no", "band"))
    buckets = banded.groupBy("cluster", "members", "no", "band").agg(F.count("*").alias("held"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("y")).where("held > 1")
    first = F.min(F.struct("no", "band", "shingles")).alias("f")
    buckets = tables.written(buckets.groupBy("cluster", "members", "held", "x", "y").agg(first).select("cluster", "members", "held", "f.*"), "buckets")
    loose = buckets.groupBy("cluster", "members").agg(F.sum(pairs(F.col("held"))).alias("pairs")).where(F.col("pairs") < pairs(F.col("members"))).select("cluster")
    loose = tables.written(loose, "loose-clusters")
    by_bucket = tables.written(buckets.join(loose, "cluster").select("no", "band", _blocks(F.col("held"), F.col("shingles")).alias("blocks")), "loose-buckets")
    in_whole = members.join(whole.join(loose, "cluster", "left_anti").select("cluster", "blocks"), "cluster").select("id", F.col("cluster").alias("group"), F.lit(-1).alias("no"), "blocks")
    spread = members.join(loose, "cluster").select("id", F.posexplode("bands").alias("no", "band"))
    in_bucket = spread.join(by_bucket, ["no", "band"]).select("id", F.col("band").alias("group"), "no", "blocks")
    return in_whole.unionByName(in_bucket)


def _classified(spark: SparkSession, docs: DataFrame, tables: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, hash, n, d1, d2) of ``docs`` (doc_id, text), and classes (d1, d2, first, class_first, n_links).

    ``hash`` is that of the text. Rows are told apart by doc_id and hash, so different
    texts under one doc_id and null ids are rows like any other. ``first`` is the least
    (no id, doc_id, hash) of a class, ``class_first`` that of all that links connect.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    bands, rows = choose_bands(THRESHOLD[0] / THRESHOLD[1])
    seen = tables.written(docs.mapInArrow(sketches(bands, rows), "doc_id long, hash long, n int, d1 long, d2 long, bands array<long>"), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    classes = seen.where("n > 0").groupBy("d1", "d2").agg(F.min(row).alias("first"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = tables.written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # written once: the ids stay
    banded = classes.select("id", F.explode("bands").alias("band"))
    leaders = tables.written(banded.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("held")).where("held > 1").drop("held"), "leaders")
    ties = banded.join(leaders, "band").where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    tied = components(spark, ties, "candidates")
    members = tables.written(classes.join(tied.select(F.col("v").alias("id"), F.col("c").alias("cluster")), "id"), "members")
    places = tables.written(_groups(tables, members), "places")
    # the text of each member: that of its first row
    wanted = members.select(F.col("first.doc_id").alias("want_id"), F.col("first.hash").alias("want_hash"), "id")
    held = docs.join(common.small(wanted), F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("hash") == F.col("want_hash"))).select("id", "text")
    sets = held.mapInArrow(_full_sets, "id long, shingles binary")
    if seen.where("n > 0").groupBy("doc_id", "hash").count().where("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["id"])  # fully repeated rows, which a class's size counts
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = places.join(members.select("id", "size", "bands"), "id").withColumn("block", block).withColumn("bands", F.when(F.col("no") > 0, F.col("bands"))).withColumn("other", other)
    dealt = dealt.select("id", "group", "no", "size", "bands", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    found = tables.written(sets.join(dealt, "id").groupBy("group", "no", "a", "b").applyInArrow(verify, "u long, v long, links long"), "links")
    labels = components(spark, found.where("v IS NOT NULL").select(F.col("u").alias("a"), F.col("v").alias("b")), "linked").select(F.col("v").alias("id"), F.col("c").alias("root"))
    links = found.where("links IS NOT NULL").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    joined = tables.written(labels.join(classes.select("id", "first"), "id"), "labels")
    roots = joined.groupBy("root").agg(F.min("first").alias("class_first"))
    named = joined.join(roots, "root").select("id", "class_first").join(links, "id", "left")
    out = classes.select("id", "d1", "d2", "first", "size").join(named, "id", "left")
    return seen, out.select("d1", "d2", "first", F.coalesce("class_first", "first").alias("class_first"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))


def jaccard_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of ``docs`` (doc_id, text).

    class_id is the smallest doc_id of the rows that links connect (null if none has one);
    n_links the number of other rows whose similarity to the row reaches the threshold.
    """
    with common.scratch(spark) as tables:
        seen, classes = _classified(spark, docs, tables)
        named = classes.select("d1", "d2", F.col("class_first.doc_id").alias("class_id"), "n_links")
        plain = seen.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
        found = seen.where("n > 0").select("doc_id", "d1", "d2").join(tables.written(named, "named-classes"), ["d1", "d2"]).select("doc_id", "class_id", "n_links")
        return tables.kept(found.unionByName(plain), "near-duplicates")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and numbers of links of all documents."""
    return jaccard_classes(spark, common.table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (null last, ties by the text's hash).

    Rows are told apart by doc_id and text, so no text is lost with another one under its
    id; of fully repeated rows one stays. Null and wordless texts all stay.
    """
    with common.scratch(spark) as tables:
        seen, classes = _classified(spark, docs, tables)
        first = tables.written(classes.select("d1", "d2", "class_first"), "firsts")
        same = F.col("class_first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("class_first.hash") == F.col("hash"))
        gone = seen.where("n > 0").select("doc_id", "hash", "d1", "d2").join(first, ["d1", "d2"]).where(~same)
        gone = tables.kept(gone.select(F.col("doc_id").alias("gone_id"), F.col("hash").alias("gone_hash")).distinct(), "copies")
        again = tables.kept(seen.where("n > 0").groupBy("doc_id", "hash").count().where("count > 1").select(F.col("doc_id").alias("twice_id"), F.col("hash").alias("twice_hash")), "repeated")
    own = common.packed(docs, id=F.col("doc_id").cast("long"), hash=F.xxhash64("text"))
    kept = own.join(common.small(gone), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti")
    if again.limit(1).count():
        twice = F.col("id").eqNullSafe(F.col("twice_id")) & (F.col("hash") == F.col("twice_hash"))
        kept = kept.join(again, twice, "left_anti").unionByName(kept.join(again, twice, "left_semi").dropDuplicates(["id", "hash"]))
    return kept.select("row.*")
