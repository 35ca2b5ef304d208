import math
import random
import zlib

import zstandard as zs

from riskweave.llm import toxicity as tx
from riskweave.llm.words import folded_words


def made(n=500, seed=4):
    rng = random.Random(seed)
    syllables = ["the", "ing", "tion", "er", "an", "ou", "st"]
    bad = ["blockhead", "nitwit", "scoundrel", "dolt"]
    docs, labels = [], []
    for i in range(n):
        body = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(30, 200))]
        toxic = int(rng.random() < 0.25)
        for _ in range(rng.randrange(3, 8) if toxic else 0):
            body.insert(rng.randrange(len(body)), rng.choice(bad))
        docs.append((i, " ".join(body).capitalize()))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_and_edges(spark):
    docs, labels = made()
    rows = docs + [(900, None), (901, ""), (902, "!!!"), (903, "nitwit" * 20000), (904, docs[0][1]), (905, docs[0][1]), (None, "dolt")]
    frame = spark.createDataFrame([(a, b, 0.5) for a, b in rows], "doc_id long, text string, score double")
    got = tx.toxicity(spark, frame, spark.createDataFrame(labels + [(900, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert by[904].score == by[905].score == by[0].score and by[900].predicted == by[901].predicted == 0
    held = [(t, by[i].predicted) for i, _, t in labels if by[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in tx.toxicity(spark, docs, labels).collect()] == [0.0, 0.0]
    assert tx.toxicity(spark, docs.limit(0), labels.limit(0)).count() == 0


def plain_features(dictionaries, text):
    """Counts, shares and sums over the windows of one text, each compressed on its own."""
    def meter(raw):
        how = zs.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=6, min_match=5, strategy=zs.STRATEGY_LAZY2, target_length=1, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        held = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=how)
        return zs.ZstdCompressor(dict_data=held, compression_params=how)

    toxic, ordinary = (meter(x) for x in dictionaries)
    differences = []
    for word in folded_words(text):
        raw = word.encode()
        for at in range(0, len(raw), tx.WINDOW):
            window = tx.PREAMBLE + b" " + raw[at : at + tx.WINDOW] + b" "
            differences.append(len(ordinary.compress(window)) - len(toxic.compress(window)))
    n, out = max(1, len(differences)), []
    for t in tx.THRESHOLDS:
        count = sum(d >= t for d in differences)
        out += [math.log1p(count), count / n]
    return [*out, sum(differences) / n, math.log1p(len(differences)), math.log1p(sum(d <= -3 for d in differences)), sum(sorted(differences)[-3:])]


def test_scores_are_those_of_plain_compression(spark):
    docs, labels = made(300, 7)
    rows = docs + [(900, None), (901, ""), (902, "a" * 200 + " nitwit, été"), (903, "of to a I " * 30)]
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scorer = tx.fit(spark, frame, marks)
    got = {r.doc_id: r.score for r in tx.toxicity(spark, frame, marks).collect()}
    for doc_id, text in rows[::15] + rows[-4:]:
        x = plain_features(scorer.dictionaries, text)
        z = sum(w * min(8, max(-8, (v - m) / s)) for w, v, m, s in zip(scorer.weights[:-1], x, scorer.mean, scorer.scale, strict=True)) + scorer.weights[-1]
        assert abs(got[doc_id] - 1 / (1 + math.exp(-z))) < 1e-9


def test_short_words_can_be_learned():
    """Words of three letters, which hold no whole sequence, are told apart; so are long ones."""
    toxic, ordinary = ["good day abc then some words here"] * 30, ["good day then some other words here"] * 60
    over = tx.over_represented(tx.gram_counts(toxic), tx.gram_counts(ordinary), 30, 60)
    (piece,) = tx._pieces(toxic[:1])
    assert tx._cut(piece, tx._hits(piece, over).nonzero()[0]) == [b" abc "]


def test_pieces_change_nothing(monkeypatch):
    docs, labels = made(120, 9)
    texts = [t for _, t in docs]
    want = tx.gram_counts(texts), tx.train_dictionaries(texts[:40], texts[40:], tx.gram_counts(texts[:9])[0][::7])
    monkeypatch.setattr(tx, "PIECE", 3)
    got = tx.gram_counts(texts), tx.train_dictionaries(texts[:40], texts[40:], tx.gram_counts(texts[:9])[0][::7])
    assert all((a == b).all() for a, b in zip(want[0], got[0], strict=True)) and want[1] == got[1]


def test_the_sample_is_bounded_after_the_join(spark, monkeypatch):
    """Few labels of ids that very many rows share, with and without different texts."""
    monkeypatch.setattr(tx, "SAMPLE", {1: 30, 0: 40})
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:6]
    docs = spark.createDataFrame([(i, f"text {k % 50} of {i}") for i in ids for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)] * 3 + [(ids[0], 1), (ids[0], None)], "doc_id long, toxic int")
    got = tx._labelled(docs, labels).collect()
    assert len({tuple(r) for r in got}) == len(got) and {y: sum(r.toxic == y for r in got) for y in (0, 1)} == {0: 40, 1: 30}
    monkeypatch.setattr(tx, "SAMPLE", {1: 1000, 0: 1000})
    assert tx._labelled(docs, labels).count() == 50 * 7
