import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import common, lexicon, token_codes

PATH = token_codes.tokenizer_path()


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def looked_up(found, some):
    data = np.frombuffer(b"".join(some), np.uint8)
    ends = np.cumsum([len(w) for w in some])
    return found.ids(data, ends - [len(w) for w in some], ends)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=5), st.lists(st.integers(0, 3), max_size=4), max_size=40), st.lists(st.binary(min_size=1, max_size=6), max_size=20))
def test_transducer_gives_the_ids_of_its_words_and_knows_no_other(entries, others):
    found = lexicon.Lexicon(np.frombuffer(lexicon.compiled(sorted(entries.items())), np.uint8))
    asked = [*entries, *others]
    if asked:
        known, ids, sizes = looked_up(found, asked)
        assert known.tolist() == [w in entries for w in asked]
        ends = np.cumsum(sizes)
        assert [ids[b - n : b].tolist() for b, n in zip(ends, sizes, strict=True)] == [entries.get(w, []) for w in asked]


def test_transducer_shares_prefixes_and_suffixes():
    """As many arcs as the distinct sets of endings need."""
    stems, ends = [b"play", b"stay", b"delay", b"work"], [b"", b"s", b"ing", b"ings", b"ed"]
    entries = sorted((s + e, [i, 10 + j]) for i, s in enumerate(stems) for j, e in enumerate(ends))
    found = lexicon.Lexicon(np.frombuffer(lexicon.compiled(entries), np.uint8))
    tails = {tuple(sorted(w[i:] for w, _ in entries if w.startswith(w0[:i]))) for w0, _ in entries for i in range(len(w0) + 1)}
    arcs = sum(len({t[0] if t else -1 for t in tail}) for tail in tails)
    assert len(found) == arcs < sum(len(w) for w, _ in entries)
    assert looked_up(found, [b"delayin"])[1].tolist() == []
    assert looked_up(found, [b"delaying"])[1].tolist() == [2, 12]


TEXTS = ["Hello  world's 123", "", None, "   \t\n", "It's ÉTÉ été ΑΣ̓ ĳ İstanbul ǅ ﬁ Ᲊ Ɤ \U0002ebf0", "a≠b.'s o'Re?'ll \"'s é.É $5.0x", "x<|EndOfText|>y <|endoftext|> Z.z<|startoftext|>", "long" * 3000, "a\x00b \x01 \x1c \x85 \xa0 　 end", "日本語 テキスト 🙂🙂 ퟿", "sk-" + "A9f" * 40]


def test_encoder_equals_the_tokenizer(whole):
    for size in (0, 4, 1000):
        own = lexicon.rules(PATH)
        some = sorted({w.lower().encode() for t in TEXTS for w in (t or "").split()[:size] if len(w.encode()) <= lexicon.WORD_BYTES and "<|" not in w})
        made = lexicon.Encoder(PATH, lexicon.Lexicon(np.frombuffer(lexicon.compiled([(w, own.ids(w.decode())) for w in some]), np.uint8)))
        ids, off = made.encode(pa.array(TEXTS))
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [whole.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aAbeé 'st.,1<|>́Σσİ\n日") | st.characters(codec="utf-8"), max_size=60))
def test_unseen_words_are_merged_as_the_tokenizer_does(whole, text):
    assert lexicon.rules(PATH).ids(text) == whole.encode(text, add_special_tokens=False).ids
    made = lexicon.Encoder(PATH, lexicon.Lexicon(np.frombuffer(lexicon.compiled([]), np.uint8)))
    assert made.encode(pa.array([text]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_documents(spark, whole):
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)] + [(None, "null id here", 5), (3, "It's twice", 5), (3, "It's twice", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(4)
    uri = lexicon.build(spark, docs, PATH)
    assert lexicon.Lexicon.open(uri)._root  # words that occur twice are in it
    ids = [whole.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    said = [whole.decode(x, skip_special_tokens=False) for x in ids]
    order = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    encoded = lexicon.encode(docs, uri, PATH)
    assert sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=order) == sorted(zip([r[0] for r in rows], ids, strict=True), key=order)
    assert sorted(((r.doc_id, r.text) for r in lexicon.decode(encoded, PATH).collect()), key=order) == sorted(zip([r[0] for r in rows], said, strict=True), key=order)
    want = [(r[0], len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(s.encode()).hexdigest()) for r, x, s in zip(rows, ids, said, strict=True)]
    assert sorted((tuple(r) for r in lexicon.digests(docs, uri, PATH).collect()), key=order) == sorted(want, key=order)


def test_counts_and_choice_of_words(spark):
    docs = spark.createDataFrame([(1, "The cat the"), (2, "cat. THE dog"), (3, None), (4, "x" * 99)], "doc_id long, text string").repartition(3)
    got = {bytes(r.word): r.n for r in lexicon.word_counts(docs, PATH).collect()}
    assert got == {b"the": 3, b"cat": 2, b".": 1, b"dog": 1}
    found = lexicon.Lexicon.open(lexicon.build(spark, docs, PATH, 1))
    assert looked_up(found, [b"the", b"cat", b"dog"])[0].tolist() == [True, False, False]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lexicon.digests(docs, lexicon.build(spark, docs, PATH), PATH).count() == 0


def test_query_holds_all_documents(spark, whole):
    at = "/root/testdata/sf0.001"
    want = {r.doc_id: whole.encode(r.text or "", add_special_tokens=False).ids for r in common.table(spark, at, "documents").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in lexicon.op11_bpe_lexicon(spark, at).collect()}
    assert got == {k: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for k, x in want.items()}
