"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window is compressed once with each dictionary; the fewer bytes the toxic one needs,
the more the window looks like toxic text. Windows are the folded words of a text, each
between spaces and cut at ``WINDOW`` bytes, behind a fixed preamble that both
dictionaries hold: so every window compresses, and what differs is the window alone. A
text's score comes from how many of its windows pass each of several difference
thresholds, by a logistic model calibrated on labelled rows that the dictionaries
weren't trained on.

The dictionaries are trained (``zstandard.train_dictionary``) on windows of labelled
texts: the toxic one on those that hold byte sequences over-represented in toxic texts,
the ordinary one on as many others. Labels are learned from a bounded sample: ``SAMPLE``
rows of each label, of which dictionaries are trained on ``SAMPLE_CHARS`` characters
from a hashed place on; calibration and scores are of whole texts. Windows repeat, so a
worker remembers the differences of those it has seen.

Defined results: null and wordless texts get the score of a text without a window; where
the rows of a label to learn from are fewer than two parts of the sample, every score is
0; repeated rows are scored alike; null labels don't count; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common, words
from riskweave.llm.language_id import held_out

#: Rows to learn from, at most, of each label, and the characters of each, from a hashed place on, that dictionaries are trained on.
SAMPLE, SAMPLE_CHARS = {1: 4_000, 0: 6_000}, 3_000
#: Parts of the sample; each is measured with dictionaries trained on the others.
PARTS = 4
#: Texts whose windows are held at once in training.
PIECE = 200
DICTIONARY, WINDOW, GRAM = 8_000, 48, 6
OVER = 5.0  # standard errors by which a sequence must be over-represented
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8)
PREAMBLE = bytes(range(128, 168))
CACHE = 500_000
U = np.uint64


def _windows(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, window starts and ends, and for each text the index of its first window."""
    data, off = words.text_bytes(pc.utf8_lower(col))
    starts, ends, first = words.spans(data, off, words.FOLDED)
    parts = np.maximum(1, -(-(ends - starts) // WINDOW))
    if len(parts) and int(parts.max()) > 1:
        total = np.concatenate([[0], np.cumsum(parts)])
        nth = np.arange(total[-1]) - np.repeat(total[:-1], parts)
        starts, stop = np.repeat(starts, parts) + nth * WINDOW, np.repeat(ends, parts)
        ends, first = np.minimum(starts + WINDOW, stop), total[first]
    return data, starts, ends, first


def _delimited(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of ``texts``, each between spaces, one after the other; where each begins, its size, each text's first."""
    data, starts, ends, first = _windows(pa.array(texts, pa.string()))
    size = ends - starts + 2
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    within = np.arange(len(out)) - np.repeat(at, size)
    inner = (within > 0) & (within < np.repeat(size - 1, size))
    out[inner] = data[(np.repeat(starts - 1, size) + within)[inner]]
    return out, at, size, first


def _grams(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The GRAM-byte sequences inside the windows, as numbers, and the window of each; a shorter window is one sequence."""
    value = np.zeros(max(0, len(raw) - GRAM + 1), U)
    for i in range(GRAM):
        value = (value << U(8)) | raw[i : i + len(value)]
    window = np.repeat(np.arange(len(size)), size)[: len(value)]
    inside = np.arange(len(value)) - at[window] <= size[window] - GRAM
    few = np.flatnonzero(size < GRAM)
    whole = size[few].astype(U) << U(56)
    for i in range(GRAM - 1):
        has = size[few] > i
        whole[has] += raw[at[few[has]] + i].astype(U) << U(8 * i)
    value, window = np.concatenate([value[inside], whole]), np.concatenate([window[inside], few])
    order = np.argsort(window, kind="stable")
    return value[order], window[order]


Counts = tuple[np.ndarray, np.ndarray]


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """``_delimited`` of a few texts at a time, so that training holds the windows of those only."""
    for at in range(0, len(texts), PIECE):
        yield _delimited(texts[at : at + PIECE])


def _merged(parts: list[Counts]) -> Counts:
    """The sequences of all parts, their counts added."""
    grams, back = np.unique(np.concatenate([g for g, _ in parts] or [np.zeros(0, U)]), return_inverse=True)
    counts = np.concatenate([n for _, n in parts] or [np.zeros(0, np.int64)])
    return grams, np.bincount(back, counts, len(grams)).astype(np.int64)


def gram_counts(texts: list[str]) -> Counts:
    """The sequences of ``texts`` and how many of them have each."""
    found = []
    for raw, at, size, first in _pieces(texts):
        grams, window = _grams(raw, at, size)
        cuts = np.searchsorted(window, first)
        each = [np.unique(grams[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        found.append(np.unique(np.concatenate(each or [grams]), return_counts=True))
        if len(found) == 20:
            found = [_merged(found)]
    return _merged(found)


def over_represented(toxic: Counts, ordinary: Counts, n_toxic: int, n_ordinary: int) -> np.ndarray:
    """The sequences, sorted, that far more toxic texts have than ordinary ones would let expect."""
    (grams, seen), (others, other_n) = toxic, ordinary
    place = np.minimum(np.searchsorted(others, grams), max(len(others) - 1, 0))
    usual = np.where(others[place] == grams, other_n[place], 0) if len(others) else np.zeros(len(grams))
    expected = (usual + 0.5) * n_toxic / max(1, n_ordinary)
    return grams[((seen - expected) / np.sqrt(expected + 1) > OVER) & (seen > 3 * expected) & (seen >= 3)]


def _hits(piece: tuple[np.ndarray, ...], over: np.ndarray) -> np.ndarray:
    """Whether each window of a piece holds one of the sequences ``over``."""
    raw, at, size, _ = piece
    grams, window = _grams(raw, at, size)
    hit = np.zeros(len(at), bool)
    if len(over):
        hit[window[over[np.minimum(np.searchsorted(over, grams), len(over) - 1)] == grams]] = True
    return hit


def _cut(piece: tuple[np.ndarray, ...], chosen: np.ndarray) -> list[bytes]:
    raw, at, size, _ = piece
    return [raw[at[i] : at[i] + size[i]].tobytes() for i in chosen]


def _trained(samples: list[bytes]) -> bytes:
    try:
        return zs.train_dictionary(DICTIONARY, samples).as_bytes()
    except zs.ZstdError:  # too few samples: they are the dictionary
        return b"".join(dict.fromkeys(samples))[-DICTIONARY:]


def train_dictionaries(toxic: list[str], ordinary: list[str], over: np.ndarray) -> tuple[bytes, bytes]:
    """The contents of the toxic dictionary, from windows with sequences ``over``, and of the ordinary one, from as many without."""
    bad = [w for piece in _pieces(toxic) for w in _cut(piece, np.flatnonzero(_hits(piece, over)))]
    free = [np.flatnonzero(~_hits(piece, over)).astype(np.int32) for piece in _pieces(ordinary)]
    total = np.cumsum([0, *map(len, free)])
    drawn = np.sort(np.random.default_rng(3).permutation(int(total[-1]))[: max(len(bad), 1_000)])
    plain = [w for k, piece in enumerate(_pieces(ordinary)) for w in _cut(piece, free[k][drawn[(drawn >= total[k]) & (drawn < total[k + 1])] - total[k]])]
    return _trained(bad) + PREAMBLE, _trained(plain) + PREAMBLE


class Meter:
    """Compression differences of windows, and a text's features from them."""
    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self._of = []
        for raw in (ordinary, toxic):
            how = zs.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=6, min_match=5, strategy=zs.STRATEGY_LAZY2, target_length=1, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            held = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            self._of.append(zs.ZstdCompressor(dict_data=held, compression_params=how))
        self._known: dict[int, int] = {}

    def difference(self, window: bytes) -> int:
        ordinary, toxic = (len(c.compress(PREAMBLE + window)) for c in self._of)
        return ordinary - toxic

    def features(self, col: pa.Array) -> np.ndarray:
        """A row for each text: counts and shares of windows beyond each threshold, and what the strongest ones sum to."""
        data, starts, ends, first = _windows(col)
        n = np.diff(first)
        out = np.zeros((len(col), 2 * len(THRESHOLDS) + 4))
        if not len(starts):
            return out
        distinct, at, back = np.unique(words.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self._known) + len(distinct) > CACHE:
            self._known.clear()
        known, each = self._known, np.empty(len(distinct), np.int64)
        for i, h in enumerate(distinct.tolist()):
            d = known.get(h)
            if d is None:
                d = known[h] = self.difference(b" " + data[starts[at[i]] : ends[at[i]]].tobytes() + b" ")
            each[i] = d
        d = each[back]
        sums = lambda x: (s := np.concatenate([[0], np.cumsum(x)]))[first[1:]] - s[first[:-1]]
        size = np.maximum(n, 1)
        for i, t in enumerate(THRESHOLDS):
            count = sums(d >= t)
            out[:, 2 * i], out[:, 2 * i + 1] = np.log1p(count), count / size
        out[:, -4] = sums(d) / size
        out[:, -3] = np.log1p(n)
        out[:, -2] = np.log1p(sums(d <= -3))
        order = np.lexsort((-d, np.repeat(np.arange(len(n)), n)))
        ranked, nth = d[order], np.arange(len(d)) - np.repeat(first[:-1], n)
        out[:, -1] = sums(np.where(nth < 3, ranked, 0))
        return out


class Scorer:
    def __init__(self, toxic: bytes, ordinary: bytes, rows: np.ndarray, labels: np.ndarray) -> None:
        self.dictionaries = (toxic, ordinary)
        self.mean, self.scale = rows.mean(0), rows.std(0) + 1e-6
        x = np.c_[(rows - self.mean) / self.scale, np.ones(len(rows))]
        w = np.zeros(x.shape[1])
        ridge = np.eye(len(w))
        ridge[-1, -1] = 1e-6
        for _ in range(50):  # Newton's method on the ridge logistic loss
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ w)
        self.weights = w

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = np.c_[np.clip((rows - self.mean) / self.scale, -8, 8), np.ones(len(rows))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_meters: dict[tuple[bytes, bytes], Meter] = {}


def _meter(dictionaries: tuple[bytes, bytes]) -> Meter:
    if dictionaries not in _meters:
        if len(_meters) >= PARTS:
            _meters.clear()
        _meters[dictionaries] = Meter(*dictionaries)
    return _meters[dictionaries]


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of the sample: different texts with a label, at most ``SAMPLE`` rows of each.

    Rows that repeat an id, its text and its label count once, whichever table repeats
    them, and the bound is on what comes out of the join.
    """
    own = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(*SAMPLE)).select(F.col("doc_id").alias("id"), "toxic").distinct()
    keyed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).join(own, F.col("doc_id") == F.col("id")).select("id", "key", "toxic").distinct()
    drawn = [common.bounded_sample(keyed.where(F.col("toxic") == y), n, "id", "key") for y, n in SAMPLE.items()]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # as many rows as SAMPLE says, at most
    held = docs.select("doc_id", "text").withColumn("key_", F.sha2(F.coalesce("text", F.lit("")), 256)).join(chosen, (F.col("doc_id") == F.col("id")) & (F.col("key_") == F.col("key")))
    return held.groupBy("id", "key", "toxic").agg(F.first("text").alias("text")).select(F.col("id").alias("doc_id"), "toxic", "text")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """A scorer learned from ``labels`` (doc_id, toxic) that aren't held out.

    The sample is cut into ``PARTS`` by the hash of the text, so that copies, which count
    once in training, are in one part; each part is measured, whole texts, with
    dictionaries trained on the other parts, and the thresholds' weights are calibrated
    on that. The scorer's own dictionaries are trained on all parts.
    """
    with common.scratch(spark) as tables:
        sample = tables.written(_labelled(docs, labels).withColumn("part", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(PARTS)).cast("int")), "toxicity-sample")
        begin = (1 + F.pmod(F.xxhash64("text", F.lit("begin")), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)))).cast("int")
        rows = sample.select("toxic", "part", F.substring("text", begin, F.lit(SAMPLE_CHARS)).alias("text")).collect()
        texts = {y: [sorted({r.text or "" for r in rows if r.toxic == y and r.part == part}) for part in range(PARTS)] for y in (1, 0)}  # copies once
        if any(sum(map(bool, parts)) < 2 for parts in texts.values()):
            return None
        counts = {y: [gram_counts(part) for part in parts] for y, parts in texts.items()}

        def trained(without: int | None) -> tuple[bytes, bytes]:
            own = {y: [t for k, part in enumerate(parts) if k != without for t in part] for y, parts in texts.items()}
            of = {y: _merged([c for k, c in enumerate(parts) if k != without]) for y, parts in counts.items()}
            return train_dictionaries(own[1], own[0], over_represented(of[1], of[0], len(own[1]), len(own[0])))

        others = [trained(part) for part in range(PARTS)]

        def measured(batches):
            for batch in batches:
                for at, to in words.chunks(batch.column("text")):
                    own = batch.slice(at, to - at)
                    for part in range(PARTS):
                        some = own.filter(pc.equal(own.column("part"), part))
                        if some.num_rows:
                            rows = _meter(others[part]).features(some.column("text"))
                            yield pa.RecordBatch.from_arrays([some.column("toxic"), pa.array(list(rows), pa.list_(pa.float64()))], ["toxic", "f"])

        seen = sorted((r.toxic, r.f) for r in sample.mapInArrow(measured, "toxic int, f array<double>").collect())
    return Scorer(*trained(None), np.array([f for _, f in seen]), np.array([y for y, _ in seen], float))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    scorer = fit(spark, docs, labels.select("doc_id", F.col("toxic").cast("int")))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches):
        for batch in batches:
            for at, to in words.chunks(batch.column("text")):
                part = batch.column("text").slice(at, to - at)
                score = scorer.scores(_meter(scorer.dictionaries).features(part)) if scorer else np.zeros(to - at)
                own = [batch.column(c).slice(at, to - at) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
