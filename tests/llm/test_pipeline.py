"""The stages against plain Python on a small fixture, and run() on the smallest tables."""

import random

import corpus_pipeline as cp
import plain
import pytest
from riskweave.llm import common
from riskweave.llm import language_id as li
from test_token_codes import expected

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, stay int, bad string, of string, steps int, copy long, mix_key string, row string, gone_id long, hash long, id int"


def fixture():
    rng = random.Random(12)
    parts = {"aa": ["the", "tion", "ing", "wh", "er"], "bb": ["ñó", "ez", "gar", "ción", "lo"]}
    text = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(n))
    rows = [(i, text("aa" if i % 3 else "bb", rng.randrange(12, 36)), "aa" if i % 3 else "bb", f"s{i % 4 % 3}") for i in range(40)]
    items = [text("aa", 22), text("bb", 40), "three words only"]
    near = rows[4][1].split()
    near[len(near) // 2] = "changed"
    rows += [(100, rows[3][1], "aa", "s1"), (101, rows[3][1].upper() + "!", None, "s2"), (102, " ".join(near), "aa", "s0"), (2, rows[9][1] + " another text under an id that is there", "aa", "s0")]
    rows += [(103, f"{text('aa', 30)} {items[0]} {text('aa', 9)}", "aa", "s0"), (104, " ".join(items[1].split()[3:]), "bb", "s1"), (105, f"so {items[2].title()}!", "aa", None), (106, " ".join(items[0].split()[:12]), "aa", "s2")]
    rows += [(None, text("aa", 25), "aa", "s1"), (None, rows[5][1], "bb", "s1"), (107, None, "aa", "s0"), (108, "", None, None), (109, "12 345 ... 6!", "aa", "s0"), (110, text("bb", 9000), "bb", "s2"), (None, None, None, None)]
    rows += [rows[7], rows[7]]
    return [(*r, None if r[1] is None else len(r[1]), 1, "b", "o", 2, -i, "k", "r", 5, 6, 7) for i, r in enumerate(rows)], items


def stored(spark, tmp_path, rows, items):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


def test_run_against_plain_python(spark, tmp_path):
    rows, items = fixture()
    sf = stored(spark, tmp_path, rows, items)
    docs = common.table(spark, sf, "documents")
    net = li.train(spark, docs)
    known = []
    for r in (r.asDict() for r in docs.collect()):
        lang, score = plain.language(net, (r["text"] or "")[:600])
        if lang != li.UND and score >= li.MIN_SCORE:
            known.append(r)
    assert 40 < len(known) < len(rows)
    single = plain.one_of_each(known)
    clean = plain.without(single, items)
    assert len(clean) < len(single) < len(known)
    final = plain.mixed(clean)
    # each stage on what the one before kept; all but the last return the columns of documents
    kept = docs
    for (_, stage), size in zip(cp.STAGES[:-1], (known, single, clean, final), strict=True):
        kept = common.written(spark, stage(spark, kept, sf), "stage")
        assert kept.columns == docs.columns
        assert sorted(repr(tuple(r)) for r in kept.collect()) == sorted(repr(tuple(r.values())) for r in size)
    got = cp.STAGES[-1][1](spark, kept, sf).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected([(r["doc_id"], r["text"]) for r in final])


@pytest.mark.parametrize("some", [[], [2]])
def test_empty_tables(spark, tmp_path, some):
    """No documents, or none that any stage keeps; no benchmark."""
    rows, _ = fixture()
    sf = stored(spark, tmp_path, [rows[-3 - i] for i in some], [])
    assert cp.run(spark, sf).count() == 0


def test_run_on_the_smallest_tables(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_files"]
    got = sorted(cp.run(spark, SF).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids) and 50 < len({*ids}) < common.table(spark, SF, "documents").count()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def test_one_of_each_group_and_no_leak(spark):
    items = [r.text for r in common.table(spark, SF, "benchmark").limit(2).collect()]
    body = "plain words that nobody else has written in just this order "
    rows = [(1, body + "one", "en", "s", 1), (2, body + "one", "en", "s", 1), (3, "before " * 8 + items[0] + " after", "en", "s", 1), (4, "clean and short", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.one_of_each(spark, docs, SF).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in cp.without_benchmark(spark, docs, SF).collect()) == [1, 2, 4]
