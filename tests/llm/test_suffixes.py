import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import suffixes as sx


def brute(rows):
    """Every window of 50 words that two documents have, and the union of the windows."""
    where = defaultdict(set)
    spans = {}
    for d, text in rows:
        if d is not None and text is not None:
            spans[d] = [(m.start(), m.end()) for m in re.finditer(r"[^\t-\r ]+", text)]
            w = [text[a:b] for a, b in spans[d]]
            for i in range(len(w) - sx.WORDS + 1):
                where[tuple(w[i : i + sx.WORDS])].add((d, i))
    hit = defaultdict(set)
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                hit[d].add(i)
    out = {}
    texts = dict(rows)
    for d, at in hit.items():
        merged = []
        for i in sorted(at):
            a, b = spans[d][i][0], spans[d][i + sx.WORDS - 1][1]
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out[d] = [tuple(x) for x in merged]
        if sum(t == texts[d] for _, t in rows) > 1:
            out[d] = [(0, len(texts[d]))]
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["été,", "日本", "x" * 60]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = [text(rng.choice([30, 49, 50, 51, 60, 120, 400])) for _ in range(25)]
    rows = []
    for d in range(n):
        body = text(rng.choice([0, 10, 200, 900]))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(shared)
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(body)))
    copy = " ".join(text(70))
    return rows + [(900, copy), (901, copy), (902, copy), (903, None), (904, ""), (905, "short copy"), (906, "short copy"), (None, copy), (907, " ".join(shared[4] * 3)), (908, "a " * 5000), (909, "b " + "a " * 300)]


def found(spark, rows, parts=None):
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, spans int")
    docs = docs.repartition(parts) if parts else docs
    return {r.doc_id: [(s.start, s.end) for s in r.spans] for r in sx.repeats(spark, docs).collect()}


def test_same_as_brute_force(spark):
    rows = corpus(1)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("parts", [1, 64])
def test_groups_of_all_sizes_on_any_number_of_partitions(spark, parts):
    """Groups of 2, 3, 4, 40 and 70 documents around one passage, a core of 44 words that many share, and two runs alike."""
    rng = random.Random(8)
    text = lambda k: [f"v{rng.randrange(10**5)}" for _ in range(k)]
    rows, core = [], text(44)
    for size in (2, 3, 4, 40, 70):
        passage = text(75)
        rows += [(len(rows) + i, " ".join(text(9) + passage + text(rng.randrange(30)))) for i in range(size)]
    sides = [(text(6), text(6)) for _ in range(20)]
    for i in range(140):
        a, b = rng.choice(sides)
        rows.append((1000 + i, " ".join(text(20) + a[rng.randrange(4) :] + core + b[: rng.randrange(6)] + text(20))))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        want = brute(rows)
        assert found(spark, rows, parts) == want and len(want) > 150
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("size", [1, 2, 7, 400])
def test_extents_are_those_of_neighbours_and_never_too_short(size):
    """Sorted rows cut into batches of any size against every other row; inside a batch, away from its ends, they are exact."""
    rng = random.Random(size)
    rows = sorted((rng.randrange(4), bytes(rng.randrange(2) for _ in range(6)) + bytes(rng.choice([0, 0, 0, 9]) for _ in range(sx.SIDE - 6)), rng.randrange(25)) for _ in range(400))
    same = lambda a, b: next((i for i in range(sx.SIDE) if a[i] != b[i]), sx.SIDE)
    want = [max((same(t, u) for j, u, e in rows if j == k and e != d), default=-1) for k, t, d in rows]
    got = []
    for at in range(0, len(rows), size):
        key, side, doc = zip(*rows[at : at + size], strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(side, pa.binary()), pa.array(doc)], ["key", "following", "doc_id"])
        got += sx._common(batch.slice(0), "following").tolist()
    assert all(g == w or g == sx.SIDE for g, w in zip(got, want, strict=True))
    ends = {i for i in range(len(rows)) if all(rows[j][2] == rows[i][2] for j in range(i // size * size, i)) or all(rows[j][2] == rows[i][2] for j in range(i, min(len(rows), (i // size + 1) * size)))}
    assert all(got[i] == want[i] for i in range(len(rows)) if i not in ends)


def test_places_without_a_repeat_are_left_out_by_their_extents(spark):
    """Suffixes at a phrase that all documents have: only those of the two that share 50 words reach, but for the ends of batches."""
    rng = random.Random(6)
    text = lambda k: [f"r{rng.randrange(10**6)}" for _ in range(k)]
    phrase, side = text(sx.KGRAM), text(30)
    rows = [(d, " ".join(text(50) + (side if d in (7, 11) else text(30)) + phrase + (side if d in (7, 11) else text(30)))) for d in range(300)]
    docs = spark.createDataFrame([(d, 0, t, [80]) for d, t in rows], "doc_id long, tid long, text string, places array<int>").coalesce(1)
    suffixes = docs.mapInArrow(sx._suffixes, sx.SUFFIX)
    extents = sx._sorted(suffixes, "following", "doc_id", "tid", "place").mapInArrow(sx._right, sx.EXTENT)
    reach = sx._sorted(extents, "preceding", "doc_id", "tid", "place").mapInArrow(sx._left, sx.REACH)
    found = {r.doc_id: (r.left, r.right) for r in reach.collect()}
    assert {7, 11} <= set(found) and len(found) < 60
    assert all(found[d][0] >= 30 and found[d][1] >= 38 for d in (7, 11))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_two_documents_and_few_minimisers(spark, n):
    rng = random.Random(n)
    text = lambda k: [f"s{rng.randrange(10**5)}" for _ in range(k)]
    passage = text(75)
    rows = [(i, " ".join(text(12 * i) + passage + text(9))) for i in range(n)]
    assert found(spark, rows, 1) == brute(rows)


def test_an_id_with_several_texts(spark):
    """Text B of id 5 is searched although another row of id 5 is a copy; inside one id nothing repeats."""
    rng = random.Random(3)
    text = lambda k: [f"k{rng.randrange(10**5)}" for _ in range(k)]
    a, b, c = text(90), text(80), text(70)
    rows = [(1, " ".join(a)), (5, " ".join(a)), (5, " ".join(text(5) + b + text(5))), (9, " ".join(b)), (7, " ".join(c)), (7, " ".join(["x", *c]))]
    got = sx.repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shown = sorted((r.doc_id, [(s.start, s.end) for s in r.spans]) for r in got)
    begin = len(" ".join(rows[2][1].split()[:5])) + 1
    assert shown == sorted([(1, [(0, len(rows[0][1]))]), (5, [(0, len(rows[0][1]))]), (5, [(begin, begin + len(rows[3][1]))]), (9, [(0, len(rows[3][1]))])])


def test_empty(spark):
    assert found(spark, []) == {}


def hot_phrases(rng, n):
    """The ``n`` of many random k-grams with the smallest hash: minimisers wherever they stand, the first before the others."""
    phrases = [" ".join(f"h{rng.randrange(10**6)}" for _ in range(sx.KGRAM)) for _ in range(60_000)]
    _, _, _, grams, _ = sx._kgrams(*sx.words.text_bytes(sx.pa.array(phrases)))
    return [phrases[i].split() for i in grams.argsort()[:n]]


def test_repeat_around_a_frequent_phrase(spark):
    """One pair shares 21 words on each side of a phrase; many others share either side only and sort between."""
    rng = random.Random(5)
    text = lambda k: [f"t{rng.randrange(10**6)}" for _ in range(k)]
    left, right = text(21), text(21)
    sides = [(left, right)] * 2 + [(left, text(21)) for _ in range(800)] + [(text(21), right) for _ in range(800)]
    phrase, *pads = hot_phrases(rng, 1 + 2 * len(sides))  # the pads keep the sides' own k-grams from being minimisers
    rows = [(d, " ".join(text(40) + pads[2 * d] + a + phrase + b + pads[2 * d + 1] + text(40))) for d, (a, b) in enumerate(sides)]
    want = brute(rows)
    assert set(want) == {0, 1}
    assert found(spark, rows) == want


def test_group_over_many_partitions(spark):
    """Pairs that share what precedes a phrase only are found, however many partitions the group would be cut into."""
    rng = random.Random(4)
    text = lambda k: [f"u{rng.randrange(10**6)}" for _ in range(k)]
    (phrase,) = hot_phrases(rng, 1)
    lefts = [text(42) for _ in range(20)]
    rows = [(d, " ".join(text(30) + lefts[d % 20] + phrase + text(60))) for d in range(40)]
    want = brute(rows)
    assert len(want) == 40
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert found(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
