"""BPE ids through a lexicon: frequent words by a minimal acyclic transducer, unseen ones merged exactly.

Words are counted over the whole corpus; the ``WORDS`` most frequent ones and their ids
are compiled into one transducer. It reads a word's bytes and an end mark; ids stand on
its arcs, each as early as all words behind the arc agree on it, and states with equal
arcs are one, so words share prefixes and suffixes (the smallest automaton there is for
these words and ids). It is a file of plain arrays in the shared folder, which workers
map into memory: all of a machine share its pages, and no worker keeps words of its own
but the last unseen ones.

A word that isn't in it is normalised, cut and merged pair by pair in the order of the
tokenizer's merge ranks. So the size of the lexicon changes the time taken, never an id.
Decoding is a look-up of each id's entry, joined as the tokenizer's missing decoder does:
with a space between any two.

Defined results: null and empty texts, and those of white space, have no ids and decode
to an empty text; strings of special tokens give their ids; repeated rows are encoded
alike; null ids of documents stay; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common, storage, token_codes, words

#: Words of the lexicon at most, and the bytes of each; what the driver compiles is bounded by them.
WORDS, WORD_BYTES = 60_000, 40
#: Distinct words of a task that are counted before they are dealt out.
HELD_WORDS = 200_000
#: Unseen words of other letters than a to z whose ids a worker remembers.
UNSEEN = 200_000
MAGIC = b"RWLEX001"
END = 256
_ALPHABET = END + 1
# the tokenizer's pattern, over the ASCII letters that stand for themselves
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")


# -- the tokenizer's rules --


class Rules:
    """Vocabulary, merge ranks and special tokens of a tokenizer file of words with an end mark."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            given = json.load(source)
        model, whole = given["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or given["decoder"] or model["unk_token"] or any(not t["content"].startswith("<|") for t in given["added_tokens"]):
            raise ValueError("not a tokenizer of words with an end mark")
        self._normalizer, self._cutter = whole.normalizer, whole.pre_tokenizer
        self._suffix, self._vocab = model["end_of_word_suffix"], model["vocab"]
        ids = self._vocab
        self._pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        top = len(ids)
        keys = np.array([a * top + b for a, b in self._pairs], np.int64)
        order = np.argsort(keys)
        rank, to = np.array(list(self._pairs.values()), np.int64).reshape(-1, 2).T
        self._sorted = top, keys[order], rank[order], to[order]
        self._letter = np.array([[ids.get(chr(c) + end, -1) for c in range(128)] for end in ("", self._suffix)])
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else re.compile("(?!)()")
        names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        entries = [names.get(i, "").encode() + b" " for i in range(max(names, default=-1) + 1)]
        self._entries = np.frombuffer(b"".join(entries), np.uint8)
        self._entry_at = np.cumsum([0, *map(len, entries)])

    def ids(self, text: str) -> list[int]:
        """The ids of a text, its words merged one by one."""
        if text.isascii() and text.isprintable() and "<|" not in text:
            return [i for word in _ASCII.findall(text.lower()) for i in self.merged(word)]
        out: list[int] = []
        for i, part in enumerate(self._split.split(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                for word, _ in self._cutter.pre_tokenize_str(self._normalizer.normalize_str(part)):
                    out += self.merged(word)
        return out

    def merged(self, word: str) -> list[int]:
        """The ids of one word, given as the tokenizer's letters for its bytes: the pair of the lowest rank is merged, the first of equal ones."""
        vocab, pairs = self._vocab, self._pairs
        symbols = [vocab[c] for c in word[:-1]] + [vocab[word[-1] + self._suffix]]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p][0], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (symbols[i], symbols[j]) != pair:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pairs[pair][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (symbols[a], symbols[b])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], a, p))
        return [s for s in symbols if s >= 0]

    def merged_together(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words of letters a to z, one word's behind the other's, and the number of each word's.

        What ``merged`` does, a merge in every word at a time.
        """
        top, keys, ranks, to = self._sorted
        n, size = len(starts), ends - starts
        word = np.repeat(np.arange(n), size)
        last = np.cumsum(size) - 1
        symbol = self._letter[0][data[np.arange(len(word)) + np.repeat(starts - (last + 1 - size), size)]]
        symbol[last] = self._letter[1][data[ends - 1]]

        def look_up(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and result of the pairs that begin at ``i``; those of no merge, or of two words, rank last."""
            j = np.minimum(i + 1, len(symbol) - 1)
            key = symbol[i] * top + symbol[j]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            fits = (keys[at] == key) & (word[i] == word[j]) & (i < j)
            return np.where(fits, ranks[at], len(keys)), to[at]

        rank, result = look_up(np.arange(len(symbol)))
        out_symbol, out_word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(symbol):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            live = best < len(keys)
            if not live.all():
                out_symbol.append(symbol[~live])
                out_word.append(word[~live])
                symbol, word, rank, result, best = symbol[live], word[live], rank[live], result[live], best[live]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.diff(word[at], prepend=-1) > 0]  # a word's first
            symbol[at] = result[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word, rank, result = symbol[keep], word[keep], rank[keep], result[keep]
            at -= np.arange(len(at))
            changed = np.concatenate([at[at > 0] - 1, at])
            rank[changed], result[changed] = look_up(changed)
        word = np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return np.concatenate(out_symbol)[order], np.bincount(word, minlength=n)

    def decoded(self, ids: np.ndarray, off: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The UTF-8 bytes of all texts' entries, a space behind each entry, and the offsets of each text's."""
        size = self._entry_at[ids + 1] - self._entry_at[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        at = np.arange(ends[-1]) + np.repeat(self._entry_at[ids] - ends[:-1], size)
        return memoryview(self._entries[at].tobytes()), ends[off]


# -- the transducer --


def compiled(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The transducer file of (word, ids), distinct words in ascending order."""
    states: dict[tuple, int] = {(): 0}
    arcs: list[tuple] = [()]

    def state(lo: int, hi: int, depth: int) -> tuple[int, tuple]:
        """The state behind the first ``depth`` bytes of entries lo..hi-1, and the ids that all of them begin with."""
        out = []
        if len(entries[lo][0]) == depth:
            out.append((END, 0, tuple(entries[lo][1])))
            lo += 1
        for symbol, some in groupby(range(lo, hi), lambda i: entries[i][0][depth]):
            first, *rest = some
            out.append((symbol, *state(first, rest[-1] + 1 if rest else first + 1, depth + 1)))
        common_ids = os.path.commonprefix([x for _, _, x in out])
        own = tuple((symbol, to, x[len(common_ids) :]) for symbol, to, x in out)
        if own not in states:
            states[own] = len(arcs)
            arcs.append(own)
        return states[own], common_ids

    root, first = state(0, len(entries), 0) if entries else (0, ())
    flat = [(s * _ALPHABET + symbol, to, x) for s, own in enumerate(arcs) for symbol, to, x in sorted(own)]
    sizes = np.array([len(x) for _, _, x in flat], np.int64)
    parts = [np.array([root, len(flat), len(first), int(sizes.sum())]), np.array([k for k, _, _ in flat]), np.array([t for _, t, _ in flat]), np.cumsum(np.append(0, sizes)), np.array([*first, *(i for _, _, x in flat for i in x)])]
    return MAGIC + b"".join(p.astype("<i8").tobytes() for p in parts)


class Lexicon:
    """Looks many words up at once in a transducer file."""

    def __init__(self, data: np.ndarray) -> None:
        if data[: len(MAGIC)].tobytes() != MAGIC:
            raise ValueError("not a lexicon")
        body = data[len(MAGIC) :].view("<i8")
        self._root, n, k, m = body[:4].tolist()
        self._keys, self._to, self._out_at = body[4 : 4 + n], body[4 + n : 4 + 2 * n], body[4 + 2 * n : 5 + 3 * n]
        self._first, self._out = body[5 + 3 * n : 5 + 3 * n + k], body[5 + 3 * n + k : 5 + 3 * n + k + m]

    @classmethod
    def open(cls, uri: str) -> Lexicon:
        """From a file: mapped into memory where the shared folder is mounted, else read once a worker."""
        parts = urlparse(uri)
        if parts.scheme in ("", "file"):
            return cls(np.memmap(unquote(parts.path), np.uint8, "r"))
        return cls(np.frombuffer(storage.read(uri), np.uint8))

    def __len__(self) -> int:
        """The arcs."""
        return len(self._keys)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the words are known; the ids of those, one word's behind the other's, and the number of each word's (0: unknown)."""
        n, size = len(starts), ends - starts
        live = np.flatnonzero(size <= WORD_BYTES) if len(self._keys) else np.zeros(0, np.int64)
        state = np.full(len(live), self._root, np.int64)
        of_word, of_arc, known = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(n, bool)
        depth = 0
        while len(live):
            over = size[live] == depth
            symbol = np.where(over, END, data[np.minimum(starts[live] + depth, len(data) - 1)].astype(np.int64))
            key = state * _ALPHABET + symbol
            arc = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            found = self._keys[arc] == key
            known[live[found & over]] = True
            telling = found & (self._out_at[arc + 1] > self._out_at[arc])
            of_word.append(live[telling])
            of_arc.append(arc[telling])
            found &= ~over
            live, state = live[found], self._to[arc[found]]
            depth += 1
        word, arc = np.concatenate(of_word), np.concatenate(of_arc)
        kept = known[word]
        word, arc = word[kept], arc[kept]
        order = np.argsort(word, kind="stable")  # arcs of a word stay in its order
        word, arc = word[order], arc[order]
        count = self._out_at[arc + 1] - self._out_at[arc]
        ends_at = np.cumsum(count)
        ids = self._out[np.arange(int(count.sum())) + np.repeat(self._out_at[arc] - (ends_at - count), count)]
        sizes = np.bincount(word, count, n).astype(np.int64)
        if len(self._first):  # ids that all words begin with
            at = np.cumsum(sizes[known]) - sizes[known]
            ids = np.insert(ids, np.repeat(at, len(self._first)), np.tile(self._first, int(known.sum())))
            sizes[known] += len(self._first)
        return known, ids, sizes


# -- encoding --


def cut(data: np.ndarray, off: np.ndarray, special: re.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as words are looked up by (ASCII letters in lower case unless a special token may occur), word starts and ends, each text's first."""
    low = token_codes._LOWER[data]
    plain = bool(special.search(low.tobytes()))
    data = data if plain else low
    return data, *token_codes.pieces(data, off, plain)


class Encoder:
    """Ids of whole texts, by a lexicon and, for words not in it, by the rules."""

    def __init__(self, path: str, lexicon: Lexicon) -> None:
        self.rules, self.lexicon = rules(path), lexicon
        self.special = special_pattern(self.rules)
        self._unseen: dict[int, list[int]] = {}

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of ``col``, one after the other, and the offsets of each text's."""
        data, off = words.text_bytes(col)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        data, starts, ends, first = cut(data, off, self.special)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        hashes, at, back = np.unique(words.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        known, ids, sizes = self.lexicon.ids(data, starts[at], ends[at])
        if not known.all():
            flat, where = [ids], np.cumsum(sizes) - sizes
            place = len(ids)
            letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
            spelled = letters[ends[at]] - letters[starts[at]] == ends[at] - starts[at]
            plain = ~known & spelled & (ends[at] - starts[at] <= 2 * WORD_BYTES)
            if plain.any():
                own, n = self.rules.merged_together(data, starts[at[plain]], ends[at[plain]])
                where[plain], sizes[plain] = place + np.cumsum(n) - n, n
                flat.append(own)
                place += len(own)
            for i in np.flatnonzero(~known & ~plain).tolist():
                own = self._unseen.get(h := int(hashes[i]))
                if own is None:
                    own = self.rules.ids(data[starts[at[i]] : ends[at[i]]].tobytes().decode())
                    if len(self._unseen) >= UNSEEN:
                        self._unseen.clear()
                    if len(own) <= 8 * WORD_BYTES:  # not the longest ones
                        self._unseen[h] = own
                where[i], sizes[i] = place, len(own)
                flat.append(np.array(own, np.int64))
                place += len(own)
            ids = np.concatenate(flat)
        else:
            where = np.cumsum(sizes) - sizes
        size = sizes[back]
        ends_at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ends_at[1:])
        return ids[np.arange(ends_at[-1]) + np.repeat(where[back] - ends_at[:-1], size)], ends_at[first]


_rules: dict[str, Rules] = {}
_encoders: dict[tuple[str, str], Encoder] = {}


def rules(path: str) -> Rules:
    if path not in _rules:
        _rules[path] = Rules(path)
    return _rules[path]


def special_pattern(own: Rules) -> re.Pattern:
    return re.compile(b"|".join(re.escape(t.lower().encode()) for t in own.special) or b"(?!)")


def encoder(path: str, uri: str) -> Encoder:
    if (path, uri) not in _encoders:
        _encoders.clear()
        _encoders[path, uri] = Encoder(path, Lexicon.open(uri))
    return _encoders[path, uri]


# -- over documents --


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n): every word of at most ``WORD_BYTES`` bytes and how often it occurs in ``docs`` (text)."""

    def run(batches):
        special = special_pattern(rules(path))
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            text = batch.column("text")
            for at, to in words.chunks(text):
                data, off = words.text_bytes(text.slice(at, to - at))
                if not len(data):
                    continue
                data, starts, ends, _ = cut(data, off, special)
                short = ends - starts <= WORD_BYTES
                starts, ends = starts[short], ends[short]
                _, one, n = np.unique(words.word_hashes(data, starts, ends), return_index=True, return_counts=True)
                raw = data.tobytes()
                for a, b, k in zip(starts[one].tolist(), ends[one].tolist(), n.tolist(), strict=True):
                    held[w] = held.get(w := raw[a:b], 0) + k
                if len(held) >= HELD_WORDS:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build(spark: SparkSession, docs: DataFrame, path: str, size: int = WORDS) -> str:
    """Compile the ``size`` most frequent words of ``docs`` (those that occur twice or more); the file's place in the shared folder."""

    def spelled(batches):
        for batch in batches:
            own = [rules(path).ids(w.decode()) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(own, pa.list_(pa.int64()))], ["word", "ids"])

    with common.scratch(spark):
        top = word_counts(docs, path).where("n > 1").orderBy(F.desc("n"), "word").limit(size).select("word")
        rows = top.repartition(8).mapInArrow(spelled, "word binary, ids array<long>").collect()  # WORDS rows at most
    uri = f"{common.new_folder(spark, 'lexicon')}/words.lex"
    storage.write(uri, compiled(sorted((bytes(r.word), list(r.ids)) for r in rows)))
    return uri


def _encoded(path: str, uri: str, batches) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    own = encoder(path, uri)
    for batch in batches:
        text = batch.column("text")
        for at, to in words.chunks(text):
            yield batch.column("doc_id").slice(at, to - at), *own.encode(text.slice(at, to - at))


def encode(docs: DataFrame, uri: str, path: str) -> DataFrame:
    """(doc_id, ids) of each row of ``docs`` (doc_id, text), with the lexicon at ``uri``."""

    def run(batches):
        for doc_id, ids, off in _encoded(path, uri, batches):
            yield pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): what each row's ``ids`` say, special tokens with the others."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            data, off = rules(path).decoded(ids.flatten().to_numpy().astype(np.int64), ids.offsets.to_numpy() - ids.offsets[0].as_py())
            text = [bytes(data[a : max(a, b - 1)]).decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, uri: str, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode`` and ``decode`` in one pass, digests of both."""

    def run(batches):
        for doc_id, ids, off in _encoded(path, uri, batches):
            raw, at = memoryview(ids.astype("<u4").tobytes()), (off * 4).tolist()
            said, to = rules(path).decoded(ids, off)
            to = to.tolist()
            ids_sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            said_sha = [hashlib.sha256(said[a : max(a, b - 1)]).hexdigest() for a, b in zip(to[:-1], to[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(off)), pa.array(ids_sha), pa.array(said_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded through a lexicon of the corpus and decoded again."""
    docs, path = common.table(spark, sf_dir, "documents"), token_codes.tokenizer_path()
    return digests(docs, build(spark, docs, path), path)
