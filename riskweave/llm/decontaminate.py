"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short and documents may be long, so their Jaccard similarity says little.
Documents are partitioned by the size of their shingle set, and each partition uses its
own MinHash: the hash range is cut into so many bins that at most ``PER_BIN`` shingles of
its largest document fall into one, and the smallest hash of each bin is the sketch
(one-permutation MinHash), half of the set or less. An item's shingle is the smallest of
its bin in a document that contains it with a chance of ``KEPT`` or more whatever the
document's size, so an item of which a document has k shingles is missed with
(1 - KEPT) ** k or less: ``choose_signed`` gives the size from which that is within the
target recall, and smaller items are searched by all their shingles. Items are signed
once for each partition with all but the shingles that most other items have too (as many
as a leaking document may lack), and equal (partition, minimum) pairs are candidates.
Exact containment is then counted for candidates only: the share of the item's distinct
five-word shingles that the document has.

Texts are told apart by their SHA-256, so copies are searched once. A Bloom filter over
the items' shingles, sized to their number up to ``BLOOM_MOST`` bits, keeps what no item
has from being shuffled; it drops nothing that an item has.

Defined results: null and wordless texts neither leak nor are leaked; an item of one to
four words is found as a run of all its words; each row is searched by itself, so rows
that share a doc_id never add up; a (doc_id, item_id) that several rows or items of that
id give is returned once, with the greatest containment; a null doc_id is an id of its
own, null item_ids are ignored; empty tables give empty results; other columns are
ignored, or carried along by ``clean_only`` whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.llm import common, words

#: Share of an item's shingles that a leaking document holds, as a fraction.
CONTAINED = (4, 5)
#: Shingles of the partition's largest document for each bin, between half of it and it.
PER_BIN = 2
#: The least chance of a shingle to be its bin's minimum, at PER_BIN others in its bin.
KEPT = (1 - math.exp(-PER_BIN)) / PER_BIN
RECALL = 0.99
BLOOM_LEAST, BLOOM_MOST, BLOOM_HASHES = 1 << 20, 1 << 28, 4
U = np.uint64


def choose_signed(recall: float = RECALL) -> int:
    """The number of an item's shingles from which its signature gives the recall.

    A leaking document has 4/5 of an item, and the signature leaves out up to 1/5: at
    least 3/5 of the shingles are in both.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - KEPT) / 0.6)


SIGNED = choose_signed()


def bins_of(sizes: np.ndarray) -> np.ndarray:
    """The number of bins, a power of two, of the partition each set size belongs to."""
    need = np.maximum(np.ceil(np.maximum(sizes, 1) / PER_BIN), 1)
    return (1 << np.ceil(np.log2(need)).astype(np.int64)).astype(np.int64)


def signature(values: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash of each bin that has one; ``values`` are sorted and distinct.

    A bin is a range of the hash's leading bits, so its minimum is the first value in it.
    """
    if bins == 1:
        return values[:1]
    bin_ = values >> U(64 - int(math.log2(bins)))
    first = np.ones(len(values), bool)
    first[1:] = bin_[1:] != bin_[:-1]
    return values[first]


def bloom_bits(n: int) -> int:
    """16 bits or more for each of ``n`` shingles, between BLOOM_LEAST and BLOOM_MOST (32 MB)."""
    return int(min(BLOOM_MOST, max(BLOOM_LEAST, 1 << math.ceil(math.log2(max(1, 16 * n))))))


def _places(values: np.ndarray, bits: int):
    for shift in range(0, 9 * BLOOM_HASHES, 9):
        yield ((values >> U(shift)) & U(bits - 1)).astype(np.int64)


def bloom_of(values: np.ndarray, bits: int) -> np.ndarray:
    held = np.zeros(bits, bool)
    for at in _places(words.mix64(values), bits):
        held[at] = True
    return np.packbits(held)


def _may_hold(bloom: np.ndarray, values: np.ndarray) -> np.ndarray:
    mixed = words.mix64(values)
    out = np.ones(len(values), bool)
    for at in _places(mixed, 8 * len(bloom)):
        out &= (bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def _item_shingles(batches):
    for batch in batches:
        values, off = words.unique_sets(*words.folded_shingles(batch.column("text")))
        data, ends = words.text_bytes(pa.compute.utf8_lower(batch.column("text")))
        count = np.diff(words.spans(data, ends, words.FOLDED)[2])
        n = np.diff(off)
        own = batch.column("item").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(values.view(np.int64)), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(np.repeat(np.minimum(count, words.SHINGLE), n).astype(np.int32))], ["item", "shingle", "size", "words"])


def _bloom_part(bits: int):
    def run(batches):
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            held |= bloom_of(batch.column("shingle").to_numpy().view(U), bits)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["bits"])

    return run


def _bloom_whole(batches):
    held = None
    for batch in batches:
        for raw in batch.column("bits"):
            part = np.frombuffer(raw.as_buffer(), np.uint8)
            held = part.copy() if held is None else np.bitwise_or(held, part, out=held)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["bits"])


def doc_signatures(bloom: bytes, lengths: tuple[int, ...]):
    """For documents: (doc, bins, mins, shared): the size partition, the minima and all shingles that pass the filter.

    ``lengths``: how many words the items' shingles have, 5 and perhaps fewer.
    """

    def run(batches):
        bits = np.frombuffer(bloom, np.uint8)
        for batch in batches:
            text = batch.column("text")
            for at, to in words.chunks(text):
                part = pa.compute.utf8_lower(text.slice(at, to - at))
                data, off = words.text_bytes(part)
                starts, ends, first = words.spans(data, off, words.FOLDED)
                hashes = words.word_hashes(data, starts, ends)
                docs, shared, mins, sizes = [], [], [], []
                each = [words.shingle_hashes(hashes, first, n, short=False) for n in lengths]
                maybe = [_may_hold(bits, v) for v, _ in each]
                held = [np.add.reduceat(np.append(m, False).astype(np.int32), o[:-1]) * (np.diff(o) > 0) if len(o) > 1 else [] for m, (_, o) in zip(maybe, each, strict=True)]
                for d in np.flatnonzero(np.sum(held, axis=0)) if to > at else ():
                    own = np.unique(np.concatenate([v[o[d] : o[d + 1]] for v, o in each]))
                    bins = int(bins_of(np.array([len(own)]))[0])
                    low = signature(own, bins)
                    docs.append(d)
                    sizes.append(bins)
                    mins.append(low[_may_hold(bits, low)].view(np.int64))
                    shared.append(own[_may_hold(bits, own)].view(np.int64))
                ids = batch.column("doc").slice(at, to - at).take(pa.array(docs, pa.int64()))
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (mins, shared)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *lists], ["doc", "bins", "mins", "shared"])

    return run


def _item_signatures(bins: list[int]):
    def run(table: pa.Table) -> pa.Table:
        values = np.unique(table.column("shingle").to_numpy().view(U))
        found = [(b, signature(values, b)) for b in bins]
        n = [len(x) for _, x in found]
        return pa.table({"item": np.repeat(table.column("item")[0].as_py(), sum(n)), "bins": np.repeat([b for b, _ in found], n), "low": np.concatenate([x for _, x in found]).view(np.int64)})

    return run


def _leaking(spark: SparkSession, docs: DataFrame, items: DataFrame, tables: common.Scratch) -> DataFrame:
    """(doc, item_id, shared, size): the SHA-256 of each text of ``docs`` (text) that contains an item of ``items``."""
    items = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = tables.written(items.withColumn("item", F.monotonically_increasing_id()), "items")  # written once: the numbers stay
    wanted = tables.written(items.mapInArrow(_item_shingles, "item long, shingle long, size int, words int"), "item-shingles")
    n, longest = wanted.count(), wanted.select("words").distinct().collect()
    lengths = tuple(sorted({words.SHINGLE} | {r.words for r in longest}))  # 1 to 5
    bits = bloom_bits(n)
    parts = wanted.select("shingle").coalesce(8).mapInArrow(_bloom_part(bits), "bits binary")  # 8 filters of bounded size
    whole = parts.repartition(1).mapInArrow(_bloom_whole, "bits binary").collect()
    shared = spark.sparkContext.broadcast(whole[0].bits if whole else bytes(bits // 8))

    def sign(batches):
        return doc_signatures(shared.value, lengths)(batches)

    signed = docs.select(common.text_key(F.col("text")).alias("doc"), "text").mapInArrow(sign, "doc binary, bins long, mins array<long>, shared array<long>")
    signed = tables.written(signed, "document-signatures")
    bins = [r.bins for r in signed.select("bins").distinct().collect()]  # powers of two: 40 at most
    if not bins:
        return spark.createDataFrame([], "doc binary, item_id long, shared long, size int")
    # of each item, the shingles that fewest other items have
    common_first = Window.partitionBy("item").orderBy(F.desc("others"), "shingle")
    ranked = wanted.where(F.col("size") >= SIGNED).join(wanted.groupBy("shingle").agg(F.count("*").alias("others")), "shingle")
    left = ranked.withColumn("nth", F.row_number().over(common_first)).where(F.col("nth") * CONTAINED[1] > F.col("size") * (CONTAINED[1] - CONTAINED[0]))
    lows = tables.written(left.select("item", "shingle").groupBy("item").applyInArrow(_item_signatures(bins), "item long, bins long, low long"), "item-signatures")
    few = tables.written(wanted.where(F.col("size") < SIGNED).select("item", "shingle"), "few-shingles")
    by_low = signed.select("doc", "bins", F.explode("mins").alias("low")).join(common.small(lows), ["bins", "low"]).select("doc", "item")
    by_any = signed.select("doc", F.explode("shared").alias("shingle")).join(common.small(few), "shingle").select("doc", "item")
    candidates = tables.written(by_low.unionByName(by_any).distinct(), "candidates")
    # exact containment of the candidates: a key of document and shingle is as wide as what they share
    asked = candidates.join(common.small(wanted), "item").select("doc", "shingle", "item", "size")
    has = signed.join(candidates.select("doc").distinct(), "doc", "left_semi").select("doc", F.explode("shared").alias("shingle")).distinct()
    counted = asked.join(has, ["doc", "shingle"]).groupBy("doc", "item").agg(F.count("*").alias("shared"), F.first("size").alias("size"))
    counted = counted.where(F.col("shared") * CONTAINED[1] >= F.col("size") * CONTAINED[0])
    return counted.join(items.select("item", "item_id"), "item").select("doc", "item_id", "shared", "size")


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared, size): each document that contains an item, with the item's distinct shingles it has and their number."""
    with common.scratch(spark) as tables:
        found = tables.written(_leaking(spark, docs, items, tables), "leaking")
        texts = found.select("doc").distinct()
        of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key(F.col("text")).alias("doc")).join(common.small(texts), "doc", "left_semi")
        best = F.max(F.struct((F.col("shared") / F.col("size")).alias("share"), "shared", "size")).alias("b")
        return tables.kept(of.distinct().join(found, "doc").groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.shared", "b.size"), "leaks")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (doc_id, item_id) of a document that contains a benchmark item, and its containment."""
    found = leaks(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("shared").alias("shared_shingles"), F.col("size").cast("long").alias("item_shingles"), (F.col("shared") / F.col("size")).alias("containment"))


def clean_only(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text contains an item, whatever their ids."""
    with common.scratch(spark) as tables:
        bad = tables.kept(_leaking(spark, docs, items, tables).select(F.col("doc").alias("bad")).distinct(), "leaking")
    return common.packed(docs, own=common.text_key(F.col("text"))).join(common.small(bad), F.col("own") == F.col("bad"), "left_anti").select("row.*")
