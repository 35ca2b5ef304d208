import random

from riskweave.llm import decontaminate as dc
from riskweave.llm.words import folded_words


def grams(text, n=5):
    w = folded_words(text)
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(docs, items):
    """Every document against every item, a document's runs of words counted once."""
    found, wanted = {}, [(i, grams(item)) for i, item in items]
    for d, text in docs:
        w = folded_words(text)
        have = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in range(1, 6)}
        for i, want in wanted:
            if want:
                both = len(want & have[len(next(iter(want)))])
                if 5 * both >= 4 * len(want):
                    found[d, i] = max(found.get((d, i), (0, 0, 0)), (both / len(want), both, len(want)))
    return sorted(((d, i, n, size) for (d, i), (_, n, size) in found.items()), key=repr)


def ordered(found):
    return sorted(map(tuple, found.collect()), key=repr)


def test_same_as_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, text(rng.randrange(14, 40))) for i in range(30)]
    docs = []
    for d in range(150):
        body = text(rng.choice([5, 60, 700, 9000]))
        if d % 3 == 0:
            item = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 3)):
                item[rng.choice([0, 1, -1, len(item) // 2])] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = item
        docs.append((d, " ".join(body)))
    items = [(i, " ".join(t).capitalize() + ".") for i, t in items] + [(90, "Only three words"), (91, None), (92, ""), (None, "w1 w2 w3 w4 w5 w6")]
    docs += [(900, "here are ONLY three words indeed"), (901, None), (902, ""), (None, items[0][1]), (903, items[1][1]), (903, items[1][1])]
    found = dc.leaks(spark, spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    assert ordered(found) == brute(docs, [x for x in items if x[0] is not None])


def test_empty_tables_and_filter(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g y"), (2, "clean"), (None, "a b c d e f g")], "doc_id long, text string")
    assert dc.leaks(spark, none, items).count() == 0
    assert dc.leaks(spark, docs, items.limit(0)).count() == 0
    assert [r.doc_id for r in dc.clean_only(spark, docs, items).collect()] == [2]


def test_recall_of_planted_items(spark):
    """4/5 of each item's shingles, or a few more, in documents of all sizes: the sketches alone reach the target."""
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(20_000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(dc.SIGNED + 5, 60)))) for i in range(150)]
    docs = []
    for d in range(600):
        words = items[d % 150][1].split()
        n = len(words) - 4
        cut = rng.randrange(0, n // 5 + 1)
        body = text(rng.choice([10, 300, 3000]))
        at = rng.randrange(len(body))
        body[at:at] = words[cut:] if d % 2 else words[: len(words) - cut]
        docs.append((d, " ".join(body)))
    want = brute(docs, items)
    got = ordered(dc.leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert len(want) >= 600 and set(got) <= set(want) and len(got) >= 0.99 * len(want)


def test_a_sketch_is_a_part_of_the_set():
    rng = dc.np.random.default_rng(1)
    for n in (60, 1000, 70_000):
        values = dc.np.unique(rng.integers(0, 2**64, n, dtype=dc.U))
        kept = len(dc.signature(values, int(dc.bins_of(dc.np.array([n]))[0]))) / n
        assert 0.8 * dc.KEPT < kept < 0.7


def test_rows_and_items_that_share_an_id(spark):
    item = [f"i{k}" for k in range(24)]
    rows = [(1, "x " + " ".join(item[:12])), (1, " ".join(item[8:]) + " y"), (2, " ".join(item)), (2, "clean"), (None, "z " + " ".join(item))]
    items = [(7, " ".join(item)), (7, "quite other words that nobody wrote in any of the documents here"), (7, " ".join(item)), (8, "a b"), (8, " ".join(item[:20]))]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, bad int, row string")
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert ordered(dc.leaks(spark, docs, frame)) == ordered(spark.createDataFrame([(2, 7, 20, 20), (2, 8, 16, 16), (None, 7, 20, 20), (None, 8, 16, 16)], "a long, b long, c long, d long"))
    assert sorted(map(tuple, dc.clean_only(spark, docs, frame).collect())) == sorted((*r, 1, "k") for r in (rows[0], rows[1], rows[3]))


def test_a_phrase_that_most_items_have(spark):
    """Items of which a fifth is one phrase: documents with the phrase alone aren't even candidates, those with an item are found."""
    phrase = "choose the one right answer below"
    items = [(i, f"{phrase} " + " ".join(f"q{i}x{k}" for k in range(26))) for i in range(40)]
    docs = [(d, f"some words {phrase} and d{d} more") for d in range(200)] + [(1000 + i, f"before it {t} after") for i, t in items]
    got = ordered(dc.leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items)
