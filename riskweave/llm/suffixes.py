"""Passages that repeat across documents, found through sparse suffixes: those that begin at minimisers.

Of every ``WINDOWS`` successive k-grams of words the one with the smallest hash (the
minimiser) is a content-selected position; a suffix is retained there if another document
has the k-gram too. The retained suffixes are sorted, across all tasks, and each is
compared with its neighbours: the nearest of another document on either side says how far
to the right any other document goes along. What precedes the positions is sorted and
compared alike, from the position leftwards. Where both extents together don't reach
``WORDS`` words, no repeat goes through the position, and it is left out; a match of
neighbours alone can't decide the rest, as the two extents may come from different
documents. So every window of ``WORDS`` words that both extents allow is hashed, and
hashes that two documents have are repeats; their union is the result.

A word counts with one byte in the sorted suffixes, and what a batch's first and last
document may meet outside of the batch is taken for a match: extents are never too short,
only sometimes too long, and the hashes of windows settle it. So ranges can be cut
anywhere, inside a frequent k-gram too, nothing is paired, and no group is capped however
many documents have a k-gram. The smallest k-gram of a window is a minimiser, and equal
windows hold the same one, hence no repeat is missed.

Texts that are equal as a whole take part once; their copies get the same spans, and
the whole text if it has ``WORDS`` words.

Defined results: null and short texts have no repeats; rows that share a doc_id are one
document, and each text of it has its own row and spans; null ids are ignored; repeats
inside one document don't count; empty tables give empty results; other columns are
ignored. Words are what ASCII white space separates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common, words

WORDS, KGRAM, WINDOWS = 50, 8, 40
GRAMS = WORDS - KGRAM + 1  # k-grams of a window
U = np.uint64
SIDE = WORDS - KGRAM  # words of a window beside its k-gram, on one side or on both
SUFFIX = "key long, doc_id long, tid long, place int, following binary, preceding binary"
EXTENT = "key long, doc_id long, tid long, place int, preceding binary, right int"
REACH = "doc_id long, tid long, place int, left int, right int"
WINDOW = "hash long, doc_id long, tid long, start long, end long"
SLICE = 1 << 16  # suffixes of one Arrow batch
_MIX = np.random.default_rng(20240612).integers(1, 2**63, WORDS, dtype=U) * U(2) + U(1)


def _kgrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = words.spans(data, off, words.PLAIN)
    hashes = words.word_hashes(data, starts, ends)
    grams, gram_off = words.shingle_hashes(hashes, first, KGRAM, short=False)
    return starts, ends, first, grams, gram_off


def _lowest(grams: np.ndarray, n: int) -> np.ndarray:
    """The place of the smallest of every ``n`` (33 to 64) successive k-grams, the first if several are."""
    low = (grams & ~U((1 << 28) - 1)) | np.arange(len(grams), dtype=U)  # the 36 leading bits decide, then the place
    for step in (1, 2, 4, 8, 16, n - 32):
        low = np.minimum(low[:-step], low[step:])
    return (low & U((1 << 28) - 1)).astype(np.int64)


def minimisers(grams: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place among its k-grams) of every minimiser."""
    if len(grams) < WINDOWS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _lowest(grams, WINDOWS)
    inside = np.zeros(len(grams) + 1, np.int64)
    full = np.diff(off) >= WINDOWS
    np.add.at(inside, off[:-1][full], 1)
    np.add.at(inside, off[1:][full] - WINDOWS + 1, -1)
    whole = np.cumsum(inside)[: len(low)] > 0
    chosen = np.unique(low[whole])
    text = np.searchsorted(off, chosen, "right") - 1
    return text, chosen - off[text]


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _keys(batches):
    """(key, doc_id, tid, place) of every minimiser."""
    for batch in batches:
        text = batch.column("text")
        for at, to in words.chunks(text):
            _, _, _, grams, off = _kgrams(*words.text_bytes(text.slice(at, to - at)))
            doc, place = minimisers(grams, off)
            own = [batch.column(c).slice(at, to - at).take(pa.array(doc)) for c in ("doc_id", "tid")]
            yield pa.RecordBatch.from_arrays([_longs(grams[off[doc] + place]), *own, pa.array(place.astype(np.int32))], ["key", "doc_id", "tid", "place"])


def _flat(places: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The elements of lists of places, and which list each is of."""
    return np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy())), places.flatten()


def _beside(codes: np.ndarray, at: np.ndarray, step: int, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The codes of the ``SIDE`` words from each ``at`` on (``step`` -1: backwards), 0 outside of low .. high."""
    index = at[:, None] + step * np.arange(SIDE)
    inside = (index >= low[:, None]) & (index < high[:, None])
    found = np.where(inside, codes[np.clip(index, 0, len(codes) - 1)], 0).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * SIDE).astype(np.int32)), pa.py_buffer(found.tobytes())])


def _suffixes(batches):
    """Of every wanted place: the words that follow and that precede its k-gram, a byte each."""
    for batch in batches:
        text, wanted = batch.column("text"), batch.column("places")
        for at, to in words.chunks(text):
            data, off = words.text_bytes(text.slice(at, to - at))
            starts, ends, first, grams, gram_off = _kgrams(data, off)
            codes = (words.mix64(words.word_hashes(data, starts, ends)) >> U(56)).astype(np.uint8)
            docs, places = _flat(wanted.slice(at, to - at))
            for cut in range(0, len(docs), SLICE):
                doc, place = docs[cut : cut + SLICE], places.slice(cut, SLICE)
                own = place.to_numpy()
                word, key = first[doc] + own, grams[gram_off[doc] + own]
                ids = [batch.column(c).slice(at, to - at).take(pa.array(doc)) for c in ("doc_id", "tid")]
                sides = [_beside(codes, word + KGRAM, 1, first[doc], first[doc + 1]), _beside(codes, word - 1, -1, first[doc], first[doc + 1])]
                yield pa.RecordBatch.from_arrays([_longs(key), *ids, place, *sides], ["key", "doc_id", "tid", "place", "following", "preceding"])


def _codes(col: pa.Array) -> np.ndarray:
    """A row of ``SIDE`` bytes for each value."""
    wide = pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    begin = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset]
    return np.frombuffer(data, np.uint8)[begin : begin + len(col) * SIDE].reshape(-1, SIDE)


def _nearest(common: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of sorted rows, what each has in common with the nearest row before it that is of another document.

    ``common``: what each row has in common with the one before it. Rows of the first
    document may meet anything before the batch and get the most there can be.
    """
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    run = np.cumsum(new)
    low = np.minimum.accumulate(common - run * 64) + run * 64  # the smallest since the run's first row
    return np.where(run == 1, SIDE, low)


def _common(batch: pa.RecordBatch, side: str) -> np.ndarray:
    """How many words each row of a sorted batch has in common with its neighbours of other documents, the most of both sides; -1 where no neighbour has its k-gram."""
    codes, key, doc = _codes(batch.column(side)), batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
    same = codes[1:] == codes[:-1]
    common = np.where(same.all(1), SIDE, same.argmin(1))
    common = np.concatenate([[SIDE], np.where(key[1:] == key[:-1], common, -1)])
    before = _nearest(common, doc)
    after = _nearest(np.concatenate([[SIDE], common[:0:-1]]), doc[::-1])[::-1]
    return np.maximum(before, after)


def _right(batches):
    """How many words from its k-gram on each suffix shares with another document; those go that can't reach ``WORDS`` with all that precedes them."""
    for batch in batches:
        if batch.num_rows:
            right = _common(batch, "following") + KGRAM
            far = (right >= KGRAM) & (batch.column("place").to_numpy() + right >= WORDS)
            kept = batch.select(["key", "doc_id", "tid", "place", "preceding"]).append_column("right", pa.array(right.astype(np.int32)))
            yield kept.filter(pa.array(far))


def _left(batches):
    """How many words before its k-gram each suffix shares with another document; those that reach ``WORDS`` on both sides together stay."""
    for batch in batches:
        if batch.num_rows:
            left = _common(batch, "preceding")
            far = (left >= 0) & (left + batch.column("right").to_numpy() >= WORDS)
            columns = [batch.column(c) for c in ("doc_id", "tid", "place")] + [pa.array(left.astype(np.int32)), batch.column("right")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tid", "place", "left", "right"]).filter(pa.array(far))


def _windows(batches):
    """Hash and characters of every window whose smallest k-gram is at a wanted place and that its extents allow."""
    for batch in batches:
        text, wanted = batch.column("text"), batch.column("places")
        for at, to in words.chunks(text):
            data, off = words.text_bytes(text.slice(at, to - at))
            starts, ends, first, grams, gram_off = _kgrams(data, off)
            if len(grams) < GRAMS:
                continue
            doc, found = _flat(wanted.slice(at, to - at))
            place = gram_off[doc] + found.field("place").to_numpy()
            left, right = np.zeros(len(grams), np.int32), np.zeros(len(grams), np.int32)
            left[place], right[place] = found.field("left").to_numpy(), found.field("right").to_numpy()
            low = _lowest(grams, GRAMS)
            before = low - np.arange(len(low))
            begin = np.flatnonzero((left[low] >= before) & (right[low] >= WORDS - before))
            doc = np.searchsorted(gram_off, begin, "right") - 1
            whole = begin + GRAMS <= gram_off[doc + 1]
            begin, doc = begin[whole], doc[whole]
            value = np.zeros(len(begin), U)
            for i in (*range(0, GRAMS, KGRAM), GRAMS - 1):  # these k-grams hold all words
                value += grams[begin + i] * _MIX[i]
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            word = first[doc] + begin - gram_off[doc]
            ids = [batch.column(c).slice(at, to - at).take(pa.array(doc)) for c in ("doc_id", "tid")]
            spans = (pa.array(chars[x] - chars[off[doc]]) for x in (starts[word], ends[word + WORDS - 1]))
            yield pa.RecordBatch.from_arrays([_longs(words.mix64(value)), *ids, *spans], ["hash", "doc_id", "tid", "start", "end"])


def _merged(spans):
    """Sorted spans (an array of structs) with those that meet made one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, s):
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    return F.aggregate(spans, empty, lambda done, s: F.when(F.size(done) == 0, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(add(done, s)))


def _sorted(suffixes: DataFrame, *order: str) -> DataFrame:
    """Sorted across all tasks, by k-gram first; ranges may be cut between any two rows."""
    return suffixes.repartitionByRange("key", *order).sortWithinPartitions("key", *order)


def repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, spans): each row of ``docs`` (doc_id, text) with passages that other doc_ids have too, as sorted struct(start, end)."""
    with common.scratch(spark) as tables:
        docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tid"))
        long = F.size(F.split(F.trim(F.regexp_replace("text", r"[\t-\r ]+", " ")), " ")) >= WORDS
        named = tables.written(docs.select("doc_id", "tid", F.sha2("text", 256).alias("name"), F.length("text").cast("long").alias("chars"), long.alias("long")), "text-names")
        classes = named.groupBy("name").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"), *[F.first(c).alias(c) for c in ("tid", "chars", "long")])
        classes = tables.written(classes, "text-classes")
        # a text is searched under its smallest id; other rows of it are dropped by id and text
        extra = named.join(classes.select("name", "rep"), "name").where("doc_id <> rep").select(F.col("doc_id").alias("copy"), F.col("tid").alias("copied")).distinct()
        once = docs.join(common.small(tables.written(extra, "copies")), (F.col("doc_id") == F.col("copy")) & (F.col("tid") == F.col("copied")), "left_anti")
        places = tables.written(once.mapInArrow(_keys, "key long, doc_id long, tid long, place int"), "minimisers")
        shared = places.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key")
        shared = tables.written(shared, "shared-keys")  # so that both sides of the join are dealt out and a hot key can be split
        wanted = places.join(shared, "key").groupBy("doc_id", "tid").agg(F.array_sort(F.collect_set("place")).alias("places"))
        held = once.join(wanted, ["doc_id", "tid"]).select("doc_id", "tid", "text", "places")
        suffixes = tables.written(held.mapInArrow(_suffixes, SUFFIX), "suffixes")
        order = ["following", "doc_id", "tid", "place"]
        extents = tables.written(_sorted(suffixes, *order).mapInArrow(_right, EXTENT), "right-extents")
        order[0] = "preceding"
        reach = tables.written(_sorted(extents, *order).mapInArrow(_left, REACH), "extents")
        reached = reach.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_list(F.struct("place", "left", "right"))).alias("places"))
        windows = tables.written(once.join(reached, ["doc_id", "tid"]).select("doc_id", "tid", "text", "places").mapInArrow(_windows, WINDOW), "windows")
        repeated = windows.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("hash")
        spans = windows.join(tables.written(repeated, "repeated-windows"), "hash").select("doc_id", "tid", "start", "end")
        found = spans.groupBy(F.col("doc_id").alias("rep"), "tid").agg(_merged(F.sort_array(F.collect_set(F.struct("start", "end")))).alias("spans"))
        whole = F.when((F.col("most") > F.col("rep")) & F.col("long"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("chars").alias("end"))))
        of_class = classes.join(found, ["rep", "tid"], "left").select("name", F.coalesce(whole, "spans").alias("spans")).where("spans IS NOT NULL")
        return tables.kept(named.join(tables.written(of_class, "class-spans"), "name").select("doc_id", "spans"), "repeats")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with passages of 50 words or more that other documents have too."""
    found = repeats(spark, common.table(spark, sf_dir, "documents"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), size.alias("repeated_chars"), text.alias("spans"))
