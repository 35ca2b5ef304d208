import hashlib
import random

import numpy as np
import plain
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.llm import parsing as pp
from riskweave.llm import words


def names(text, level):
    return pp.parse(*words.text_bytes(pa.array([text])))[level - 1][0]


def test_equal_substrings_share_interior_names():
    rng = random.Random(0)
    word = lambda: "".join(rng.choices("abcdefgh é", k=40))
    core = "".join(word() for _ in range(60))
    for level in (1, 2, 3):
        a, b = (set(names(word() * n + core + word(), level).tolist()) for n in (1, 3))
        inside = set(names(core, level).tolist())
        assert len(a & b & inside) > 0.75 * len(inside)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aab c\né", max_size=80), max_size=8))
def test_a_batch_changes_nothing(texts):
    together = pp.sketches(pa.array(texts, pa.string()))
    for t, s in zip(texts, together, strict=True):
        assert (pp.sketches(pa.array([t], pa.string()))[0] == s).all()


def in_order(row):
    return row[0] is not None, row[0] or 0, plain.text_hash(row[1] or "")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aab c\né日", max_size=400) | st.text(max_size=60))
def test_sketches_are_those_of_plain_parsing(text):
    for t in (text, text * 7):
        assert pp.sketches(pa.array([t], pa.string()))[0].tolist() == plain.sketch(t)


def test_rows_that_share_an_id_are_cut_into_buckets(spark):
    rows = [(5 if i % 2 else None, f"words of row {i * 7 % 61} " * 5) for i in range(120)] + [(1, "one"), (8, "eight")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = pp.with_next(spark, docs).select("bucket", "last", F.spark_partition_id().alias("p")).collect()
    assert len({r.bucket for r in placed if not r.last}) >= 6 and all(r.bucket == r.p for r in placed)
    got = pp.fingerprints(spark, docs).collect()
    order = sorted(rows, key=in_order)
    want = [(d, hashlib.sha256(pp.edited(t, n).encode()).hexdigest()) for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)


def test_rows_against_plain_python(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choices("aeioubcdñ", k=5)) for _ in range(rng.randrange(0, 200)))
    rows = [(i * 3, text()) for i in range(120)] + [(900, None), (901, ""), (902, "a" * 50000), (903, "é"), (904, rng.choice("xy") * 2), (None, "null"), (905, "same " * 50), (906, "same " * 50)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in pp.fingerprints(spark, spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, bucket int")).collect()}
    order = sorted(rows, key=in_order)
    assert len(got) == len(rows)
    for (doc_id, t), (_, follower) in zip(order, order[1:] + order[:1], strict=True):
        t, follower, r = t or "", follower or "", got[doc_id]
        changed = pp.edited(t, follower)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert changed == t[: len(t) - len(t) // 2] + follower[: len(t) // 2]
        a, b, c = (plain.sketch(x) for x in (t, changed, follower))
        assert [r.fingerprint, r.edited_fingerprint] == ["".join(f"{x:016x}" for x in s) for s in (a, b)]
        assert abs(r.near_edited - plain.likeness(a, b)) < 1e-12 and abs(r.near_next - plain.likeness(a, c)) < 1e-12
    assert got[905].near_next == 1.0


def test_likeness_follows_what_is_shared():
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghijklm ", k=6000))
    other = "".join(rng.choices("abcdefghijklm ", k=6000))
    a, b, c = pp.sketches(pa.array([text, pp.edited(text, other), other]))
    assert 0.15 < pp.likeness(a, b) < 0.55 and pp.likeness(a, c) < 0.15 and pp.likeness(a, a) == 1.0
    assert pp.likeness(np.zeros(0, np.uint64), a) == 0.0


def test_one_and_none(spark):
    docs = spark.createDataFrame([(1, "alone in the table")], "doc_id long, text string")
    assert pp.fingerprints(spark, docs).first().near_next == 1.0
    assert pp.fingerprints(spark, docs.limit(0)).count() == 0
