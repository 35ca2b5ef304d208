import random

import numpy as np
import plain

from riskweave.llm import language_id as li


def made(seed=2, n=240):
    rng = random.Random(seed)
    parts = {"aa": ["the", "tion", "ing", "wh"], "bb": ["ñó", "ez", "gar", "ción"], "cc": ["sch", "keit", "ü", "zu"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randrange(4, 90))), lang, "x"))
    return rows


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(0)
    net = li.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, w = rng.integers(0, 256, (6, 5)), rng.integers(0, 3, 5), np.ones(5)
    _, grads = net.gradients(x, y, w)
    for name in ("in_f", "rec_f", "rec_b", "out_b", "out"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        was, losses = net.p[name][at], []
        for step in (1e-2, -1e-2):
            net.p[name][at] = was + step
            losses.append(net.gradients(x, y, w)[0])
        net.p[name][at] = was
        assert abs((losses[0] - losses[1]) / 2e-2 - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at])) + 1e-4


def test_use_equals_training_recurrence():
    rng = np.random.default_rng(1)
    net = li.Network(["a", "b"])
    data = rng.integers(1, 256, 100).astype(np.uint8)
    f, b = net._run(data[:, None], "f")[0], net._run(data[:, None], "b")[0]
    logits = net.p["out_f"] @ f + net.p["out_b"] @ b + net.p["out"]
    q = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(net.pooled(data, np.array([0, 100]))[0], q.mean(0)[:, 0], atol=1e-4)


def test_held_out_accuracy_and_edges(spark):
    rows = made() + [(900, None, "aa", "x"), (901, "", None, "x"), (902, "123 ... !!", "bb", "x"), (903, "é" * 50000, None, "x"), (None, "thetion", None, "x")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")
    got = {r.doc_id: r for r in li.identify(spark, docs).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    held = [(r[2], got[r[0]].lang_pred) for r in rows[:240] if got[r[0]].held_out]
    assert held and sum(a == b for a, b in held) / len(held) > 0.95
    kept = li.keep_known(spark, docs)
    assert kept.columns == docs.columns and {900, 901, 902}.isdisjoint({r.doc_id for r in kept.collect()})


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert li.identify(spark, none).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert li.identify(spark, one).first().lang_pred == "und"


def test_predictions_are_those_of_a_plain_forward_pass(spark):
    """Whole texts of one, two and many windows, of one byte, of several scripts, against loops over bytes and units."""
    rng = random.Random(4)
    rows = made(5, 60) + [(900, "x", "aa", "s"), (901, "日本語 é" * 40, "bb", "s"), (902, "wh" * 200, "cc", "s"), (903, "1 2 3", "aa", "s"), (904, None, "aa", "s"), (905, "é", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    net = li.train(spark, docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(spark, docs).collect()}
    kept = {r.doc_id for r in li.keep_known(spark, docs).collect()}
    for doc_id, text, _, _ in rng.sample(rows[:60], 6) + rows[60:]:
        lang, score = plain.language(net, text)
        assert got[doc_id][0] == lang and abs(got[doc_id][1] - score) < 1e-3
        assert (doc_id in kept) == (lang != li.UND and score >= li.MIN_SCORE)
