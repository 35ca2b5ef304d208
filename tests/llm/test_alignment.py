import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import alignment, common

PATHS = alignment._paths()


@pytest.fixture(scope="module")
def whole():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {chr(b): b for b in OWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in OWN)}


def a_bytes(token):
    return bytes(LETTERS[c] for c in token)


def b_bytes(sp, i):
    return bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()


def plain(text, whole):
    """(ids of A, ids of B, groups, links) of a whole text, tokenized at once, token ends as plain sets."""
    a, sp = whole
    if not text:
        return [], [], [], []
    x, y = a.encode(" " + text, add_special_tokens=False), sp.encode(text)
    of_a, of_b = [a_bytes(t) for t in x.tokens], [b_bytes(sp, i) for i in y]
    if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
        return [], [], [], []
    ends_a, ends_b = np.cumsum([len(t) for t in of_a]).tolist(), np.cumsum([len(t) for t in of_b]).tolist()
    nth_a, nth_b = {e: n for n, e in enumerate(ends_a, 1)}, {e: n for n, e in enumerate(ends_b, 1)}
    ids, made, links, i, j = x.ids, [], [], 0, 0
    for end in sorted({*nth_a} & {*nth_b}):
        k, m = nth_a[end], nth_b[end]
        made.append((ids[i:k], y[j:m]))
        links.append((ids[k - 1], y[m - 1]))
        i, j = k, m
    return ids, y, made, links


def shown(made):
    return ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in made)


def test_labels_and_groups():
    label = alignment.labels(np.array([1, 2, 1, 3]), np.array([3, 2, 2]))
    assert label == b"a.xab.x" and alignment.groups(label) == [(2, 1), (2, 2)]


TEXTS = ["Hello  world", "", None, " ", "   lead and trail  ", "\nline\n\n one\ttab \r\n x", "it's 12,345.67 don't", "naïve été 日本語　 x \xa0 y  z \x85 q", "<|endoftext|> <s> </s> <0x0A>", "has ▁ inside", "é é 🙂🙂 \x00 \x01 \x1c a", "long" * 2000, "word " * 3000, "a" + " " * 50 + "b", "trailing line\n", "trailing space "]


def test_texts_equal_whole_tokenization(whole):
    tokens, said, links, off = alignment.Aligner(*PATHS).align(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        x, y, made, pairs = plain(t, whole)
        assert (tokens[i].tolist(), said[i].decode(), [(v >> 32, v & 0xFFFFFFFF) for v in links[off[i] : off[i + 1]].tolist()]) == ([len(x), len(y)], shown(made), pairs), t


@settings(max_examples=250, deadline=None)
@given(st.lists(st.text(st.sampled_from("abe é'.1\n \t<|>▁　\xa0\r") | st.characters(codec="utf-8"), max_size=30), max_size=4))
def test_random_texts(whole, texts):
    found = alignment.aligner(*PATHS)
    tokens, said, _, _ = found.align(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        x, y, made, _ = plain(t, whole)
        assert (tokens[i].tolist(), said[i].decode()) == ([len(x), len(y)], shown(made))


def expected(rows, whole):
    told = [plain(t, whole) for _, t in rows]
    counts = Counter(p for *_, links in told for p in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (doc_id, _), (x, y, made, links) in zip(rows, told, strict=True):
        sha = hashlib.sha256(shown(made).encode()).hexdigest() if made else ""
        out.append((doc_id, len(x), len(y), len(made), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_corpus(spark, whole, monkeypatch, parts):
    monkeypatch.setattr(alignment, "CHUNK", 300)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "Hello twice"), (3, "Hello twice")] + [(50 + i, "the, the, of the") for i in range(20)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, chunk int, pairs int").repartition(parts)
    assert sorted((tuple(r) for r in alignment.align(spark, docs, *PATHS).collect()), key=str) == expected(rows, whole)
    said = {r.doc_id: r.groups for r in alignment.token_groups(docs, *PATHS).collect()}
    assert said[0] == shown(plain("Hello  world", whole)[2])


def test_nothing_to_align(spark):
    for rows in ([], [(1, None), (2, "")]):
        got = alignment.align(spark, spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect()
        assert sorted(tuple(r) for r in got) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]


def test_query(spark, whole):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in common.table(spark, at, "documents").collect()]
    assert sorted((tuple(r) for r in alignment.op13_token_alignment(spark, at).collect()), key=str) == expected(rows, whole)
