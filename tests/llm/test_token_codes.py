import zlib

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import token_codes as tc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**20) | st.integers(0, 60), min_size=0, max_size=1500))
def test_round_trip_and_random_access(values):
    ids = np.array(values, np.uint32)
    file = tc.TokenFile(tc.encode(ids, np.array([5]), np.array([0])))
    assert (file.decode() == ids).all() and len(file) == len(ids)
    for i in range(0, len(ids), 97):
        assert file[i] == values[i]
    with pytest.raises(IndexError):
        file[len(ids)]


def expected(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tc.tokenizer_path())
    out, start = [], 0
    order = lambda r: (r[0] is not None, r[0] or 0, plain.text_hash(r[1] or ""))
    for doc_id, text in sorted(rows, key=order):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, tc.END_ID], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_hold_what_the_tokenizer_gives(spark, monkeypatch):
    rows = [(i * 7 % 40, f"It's Doc {i}'s text with\tspaces, numb3rs 12{i}, ÉTÉ été ΑΣ\ńx! ::: 日本語 " * (i % 5)) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "   "), (None, "null id"), (103, "long " * 30000), (104, "a\x01b \x01 %\x01 end"), (105, "x<|EndOfText|>y <|endoftext|> Z.z"), (106, "a=\u0338b.'s o'Re?'ll \"'s e\u0301.E\u0301 $5.0x")]
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, start int")
    got = tc.read_token_files(tc.write_token_files(spark, docs, f"{tc.common.new_folder(spark, 't')}", tc.tokenizer_path(), 300)).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected(rows)


def test_an_id_that_many_rows_share_is_cut_and_ordered(spark):
    rows = [(7 if i % 3 else None, f"text number {i * 37 % 101} of one id") for i in range(90)] + [(1, "low"), (9, "high")]
    for given in (rows, rows[::-1]):
        docs = spark.createDataFrame(given, "doc_id long, text string")
        manifest = tc.write_token_files(spark, docs, tc.common.new_folder(spark, "t"), tc.tokenizer_path(), 100)
        assert manifest.select("part").distinct().count() > 3
        got = sorted((tuple(r) for r in tc.read_token_files(manifest).collect()), key=lambda r: r[1])
        assert got == expected(rows)


def test_empty_table_and_repeated_rows(spark):
    assert tc.encode_corpus(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = tc.encode_corpus(spark, spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 3), (1, 3)]


def test_words_of_small_letters_need_no_rules(monkeypatch):
    """Only other pieces go through the tokenizer's rules; the ids of both are the tokenizer's own."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    own, ruled = tc.WordTokenizer(tc.tokenizer_path()), []
    whole, plainly = Tokenizer.from_file(tc.tokenizer_path()), own._ids
    monkeypatch.setattr(own, "_ids", lambda texts: ruled.extend(texts) or plainly(texts))
    letters = [chr(c) for c in range(0xC0, 0x180)] + ["a", "zq", "́", "×", "ǆ", "ﬁ", "日"]
    texts = ["ouaiieran été straße laéauxauxou Plain", "éelleanè&&& É'tÉ İi ı", *(f"x{a} {a}x {a}{b} x{a}{b}y" for a in letters for b in letters[::9]), "<|endoftext|> été EtÉ ab", ""]
    for part in ([t] for t in texts[:3]), (texts,), (texts[::-1],):
        for given_ in part:
            ids, off = own.encode(pa.array(given_))
            assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [whole.encode(t, add_special_tokens=False).ids for t in given_]
    assert not {"ouaiieran", "été", "straße", "laéauxauxou", "plain"} & set(ruled) and {"éelleanè&&&", "ı"} <= set(ruled)
