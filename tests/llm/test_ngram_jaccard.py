import random

from riskweave.llm import ngram_jaccard as nj
from riskweave.llm.words import folded_words


def brute(rows):
    sets = []
    for _, text in rows:
        w = folded_words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    near = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * both >= 4 * len(sets[i] | sets[j]):
                near[i].add(j)
                near[j].add(i)
    label = {}
    for i in range(n):
        if i in label:
            continue
        todo, group = [i], set()
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += near[x]
        for x in group:
            label[x] = min((rows[y][0] for y in group if rows[y][0] is not None), default=None)
    return ordered((rows[i][0], label[i], len(near[i])) for i in range(n))


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def found(spark, rows):
    return ordered(nj.jaccard_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["été", "Ñandú"]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(3, 150))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            edited = list(base)
            for _ in range(rng.randrange(0, 4)):
                edited[rng.randrange(len(edited))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(edited)))
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "one two"), (1004, "One, two!"), (1005, rows[3][1])]
    return rows


def test_same_as_brute_force(spark):
    rows = corpus()
    got = nj.jaccard_classes(spark, spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, class_id string")).collect()
    assert ordered(got) == brute(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"v{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(60):
        edited = list(base)
        for _ in range(rng.randrange(0, 5)):
            edited[rng.randrange(120)] = f"z{rng.randrange(99)}"
        rows.append((i, " ".join(edited)))
    monkeypatch.setattr(nj, "BLOCK", 9)
    got = nj.jaccard_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered(got) == brute(rows)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert nj.jaccard_classes(spark, none).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, "q " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in nj.keep_one(spark, docs).collect()) == [1, 3]


def test_bands_reach_the_recall():
    bands, rows = nj.choose_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_repeated_rows_beside_a_linked_document(spark):
    base = [f"r{i}" for i in range(60)]
    near = [*base[:-1], "other"]
    rows = [(1, " ".join(base)), (1, " ".join(base)), (1, ", ".join(base)), (2, " ".join(near)), (3, "quite another text of seven words")]
    got = nj.jaccard_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered(got) == brute(rows)


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (5, a), (5, b), (5, None), (5, ""), (7, "..."), (7, b), (None, a), (None, "only here, in a row without an id"), (None, None)]
    for given in (rows, rows[::-1]):
        assert found(spark, given) == brute(given)
        kept = nj.keep_one(spark, spark.createDataFrame([(*r, True, "x") for r in given], "doc_id long, text string, stay boolean, row string")).collect()
        assert kept[0].__fields__ == ["doc_id", "text", "stay", "row"]
        assert sorted((r.text or "" for r in kept), key=repr) == sorted([a, b, "", "", "", "...", rows[8][1]], key=repr)
        assert {r.text: r.doc_id for r in kept}[b] == 5 and {r.text: r.doc_id for r in kept}[a] == 1


def test_repeated_rows_leave_one(spark):
    rows = [(3, "one row that stands here three times")] * 3 + [(4, "one row that stands here three times")] + [(None, "and a row without an id twice")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(nj.keep_one(spark, docs).collect()) == ordered([rows[0], rows[4]])
    assert found(spark, rows) == brute(rows)


def test_chains_are_verified_by_bucket(spark, monkeypatch):
    """Templated texts: one chain of candidates in which most pairs are unlike; no link is lost or counted twice."""
    rng = random.Random(11)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(rng.randrange(25, 60))]
        rows.append((i, " ".join(template[: rng.randrange(30, 60)] + own)))
        if i % 7 == 0:
            rows.append((1000 + i, rows[-1][1] + " end"))
    whole = found(spark, rows)
    groups = []
    real = nj._groups

    def watched(tables, members):
        out = real(tables, members)
        groups.append(out.where("no >= 0").count())
        return out

    monkeypatch.setattr(nj, "_groups", watched)
    monkeypatch.setattr(nj, "BLOCK", 12)
    assert found(spark, rows) == whole == brute(rows)
    assert groups[0] > 0
