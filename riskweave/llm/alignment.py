"""Two tokenizers of the same texts aligned: groups of tokens that cover the same bytes.

Each byte of a text has a label: no token ends there, one of tokenizer A, one of B, or
one of both. A regular expression scans the labels and finds the spans up to each
both-label; the labels inside a span tell how many tokens of A and B make up its group,
and the last two of them are linked. Over the corpus, links are counted by pair of ids.

Neither tokenizer joins across the place before a space or a line end that follows
anything but white space, nor across that between an ASCII letter and an ASCII mark
behind it (A's kind and B's pieces are checked for that), so texts are cut there into
units, both tokenizers cut there too, and each distinct unit is tokenized,
labelled and scanned once a worker; a text's groups are those of its units in turn.

Texts are handled in chunks. A chunk's row in the stage table holds its distinct pairs
and, for each link in turn, the place of its pair among them. Pairs are dealt out once
a chunk to be counted, and their counts come back to the chunk, so no row is dealt out by
a pair or id as often as texts hold it.

Defined results: a text that is null or empty, or whose tokens of A or B don't spell a
space and the text (white space that B's piece for it stands for, say), has no tokens:
zeros and ''. Repeated rows count and are returned as often as they occur; null ids stay;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.llm import common, words

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text of a chunk (a longer text is one by itself).
CHUNK = 2 << 20
#: Units, and bytes of their groups, that a worker remembers.
UNITS, UNIT_BYTES = 300_000, 64 << 20
SPACE = "▁"
_GROUP = re.compile(rb"[^x]*x")
_LABEL = np.frombuffer(b".abx", np.uint8)
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_CROSSING = re.compile(f"\n|[^{SPACE}]{SPACE}|[A-Za-z][{re.escape(_MARKS)}]")
_LETTER, _MARK = (np.array([chr(c) in known for c in range(256)]) for known in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", _MARKS))
# white space beyond ASCII, in UTF-8: a space behind it doesn't begin a unit
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Pair:
    """The two tokenizers; ids and bytes of units."""

    def __init__(self, a: str, b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        if self.a.normalizer is not None or not isinstance(self.a.pre_tokenizer, pre_tokenizers.ByteLevel):
            raise ValueError("A isn't a plain byte-level tokenizer")
        self.a_bytes = _byte_level(self.a.get_vocab(with_added_tokens=True))
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_CROSSING.search(p) for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))):
            raise ValueError("a piece of B crosses the place where units are cut")
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in names], np.int64) for names in (self.a_bytes, self.b_bytes))

    def units(self, some: list[bytes]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """The ids of each unit by A and by B, and whether both spell it."""
        texts = [u.decode() for u in some]
        of_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # a line end in front keeps B's own space apart: its two tokens go
        of_b = [y[2:] for y in self.b.encode(["\n" + u for u in texts], num_threads=1)]
        spelled = lambda names, ids: b"".join([names[i] for i in ids])
        fine = [spelled(self.a_bytes, x) == u == spelled(self.b_bytes, y) for u, x, y in zip(some, of_a, of_b, strict=True)]
        return of_a, of_b, np.array(fine, bool)


def _byte_level(vocab: dict[str, int]) -> list[bytes]:
    """Each id's bytes: printable letters stand for themselves, the others for what the byte-level alphabet gives them."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes([letters[c] for c in token]) if all(c in letters for c in token) else token.encode()
    return out


def labels(a_sizes: np.ndarray, b_sizes: np.ndarray) -> bytes:
    """The label of each byte of a text whose tokens have so many bytes: ``.``, ``a``, ``b`` or ``x`` for both."""
    out = np.zeros(int(a_sizes.sum()), np.uint8)
    out[np.cumsum(a_sizes) - 1] |= 1
    out[np.cumsum(b_sizes) - 1] |= 2
    return _LABEL[out].tobytes()


def groups(label: bytes) -> list[tuple[int, int]]:
    """How many tokens of A and of B each group has."""
    return [(1, 1) if s == b"x" else (s.count(b"a") + 1, s.count(b"b") + 1) for s in _GROUP.findall(label)]


def cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A space put before every text that isn't empty; unit starts and ends, and each text's first unit."""
    size = np.diff(off)
    full = size > 0
    to = np.zeros(len(off), np.int64)
    np.cumsum(size + full, out=to[1:])
    out = np.full(int(to[-1]), 32, np.uint8)
    own = np.ones(len(out), bool)
    own[to[:-1][full]] = False
    out[own] = data
    solid = out > 32
    for m in _WIDE_SPACE.finditer(out.tobytes()):
        solid[m.end() - 1] = False
    begin = np.zeros(len(out), bool)
    begin[1:] = ((out[1:] == 32) | (out[1:] == 10)) & solid[:-1] | _MARK[out[1:]] & _LETTER[out[:-1]]
    begin[to[:-1][full]] = True
    starts = np.flatnonzero(begin)
    return out, starts, np.append(starts[1:], len(out)), np.searchsorted(starts, to)


class Aligner:
    """Units that a worker has seen: for each the number of its tokens, its groups as text, its linked pairs."""

    def __init__(self, a: str, b: str) -> None:
        self.pair = Pair(a, b)
        self._forget()

    def _forget(self) -> None:
        self._slot: dict[int, int] = {}
        self._text: list[bytes] = []
        self._held = 0
        self._counts, self._links, self._at = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _add(self, hashes: list[int], units: list[bytes]) -> None:
        """Tokenize, label and scan new units, one behind the other: each ends with a both-label."""
        of_a, of_b, fine = self.pair.units(units)
        good = np.flatnonzero(fine).tolist()
        a, b = [i for k in good for i in of_a[k]], [i for k in good for i in of_b[k]]
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        label = labels(self.pair.a_size[a_ids], self.pair.b_size[b_ids])
        sizes = groups(label)
        say_a, say_b, said, i, j = list(map(str, a)), list(map(str, b)), [], 0, 0
        for n, m in sizes:
            said.append(f"{say_a[i]}|{say_b[j]}" if n == m == 1 else f"{','.join(say_a[i : i + n])}|{','.join(say_b[j : j + m])}")
            i, j = i + n, j + m
        last = np.cumsum(np.array(sizes, np.int64).reshape(-1, 2), axis=0) - 1
        links = a_ids[last[:, 0]] << 32 | b_ids[last[:, 1]]
        of_unit = np.zeros(len(units), np.int64)
        stops = np.cumsum([len(units[k]) for k in good], dtype=np.int64)
        ends = np.flatnonzero(np.frombuffer(label, np.uint8) == _LABEL[3]) + 1
        of_unit[good] = np.diff(np.searchsorted(ends, stops, "right"), prepend=0)
        at = np.concatenate([[0], np.cumsum(of_unit)])
        text = [";".join(said[p:q]).encode() for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self._slot.update(zip(hashes, range(len(self._text), len(self._text) + len(units)), strict=True))
        self._text += text
        self._held += sum(map(len, text))
        counts = np.array([(len(x), len(y)) for x, y in zip(of_a, of_b, strict=True)], np.int64).reshape(-1, 2)
        counts[~fine] = -1
        self._counts = np.concatenate([self._counts, counts])
        self._links = np.concatenate([self._links, links])
        self._at = np.concatenate([self._at, self._at[-1] + at[1:]])

    def align(self, col: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of each text: (tokens of A, tokens of B), its groups as text; then all links in turn and the offsets of each text's."""
        n = len(col)
        data, off = words.text_bytes(col)
        data, starts, ends, first = cut(data, off)
        if not len(starts):
            return np.zeros((n, 2), np.int64), [b""] * n, np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        hashes, at, back = np.unique(words.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self._text) + len(hashes) > UNITS or self._held > UNIT_BYTES:
            self._forget()
        known = hashes.tolist()
        new = [i for i, h in enumerate(known) if h not in self._slot]
        if new:
            raw, froms, tos = data.tobytes(), starts[at].tolist(), ends[at].tolist()
            self._add([known[i] for i in new], [raw[froms[i] : tos[i]] for i in new])
        slot = np.array([self._slot[h] for h in known], np.int64)[back]
        counts = self._counts[slot]
        sums = np.zeros((len(slot) + 1, 2), np.int64)
        np.cumsum(np.maximum(counts, 0), axis=0, out=sums[1:])
        bad = np.concatenate([[0], np.cumsum(counts[:, 0] < 0)])
        bad = bad[first[1:]] > bad[first[:-1]]
        tokens = sums[first[1:]] - sums[first[:-1]]
        tokens[bad] = 0
        each, text = slot.tolist(), self._text
        said = [b"" if lost else b";".join([text[s] for s in each[a:b]]) for a, b, lost in zip(first[:-1].tolist(), first[1:].tolist(), bad.tolist(), strict=True)]
        size = self._at[slot + 1] - self._at[slot]
        size[np.repeat(bad, np.diff(first))] = 0
        to = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=to[1:])
        links = self._links[np.arange(to[-1]) + np.repeat(self._at[slot] - to[:-1], size)]
        return tokens, said, links, to[first]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def _paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A), public_tokenizers.path(B)


def token_groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, groups) of each row of ``docs`` (doc_id, text): ``a1,a2|b1;a3|b2,b3``, ids of A and B."""

    def run(batches):
        for batch in batches:
            for at, to in words.chunks(batch.column("text"), CHUNK):
                _, said, _, _ = aligner(a, b).align(batch.column("text").slice(at, to - at))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array([s.decode() for s in said])], ["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, groups string")


def _chunks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row a chunk: its documents, their figures, its distinct pairs, and each link's place among those."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, to in words.chunks(batch.column("text"), CHUNK):
                tokens, said, links, off = aligner(a, b).align(batch.column("text").slice(at, to - at))
                pairs, place = np.unique(links, return_inverse=True)
                sha = [hashlib.sha256(s).hexdigest() if s else "" for s in said]
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                ids = batch.column("doc_id").slice(at, to - at)
                columns = [pa.array([part << 32 | nth]), one(ids), one(pa.array(tokens[:, 0])), one(pa.array(tokens[:, 1])), one(pa.array(sha)), one(pa.array(np.diff(off))), pa.array([place.astype(np.min_scalar_type(len(pairs))).tobytes()], pa.binary()), one(pa.array(pairs)), one(pa.array(np.bincount(place, minlength=len(pairs)).astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "doc_id", "n_a", "n_b", "sha", "n_links", "place", "pairs", "times"])
                nth += 1

    return docs.select("doc_id", "text").mapInArrow(run, f"chunk long, doc_id array<{kind}>, n_a array<long>, n_b array<long>, sha array<string>, n_links array<long>, place binary, pairs array<long>, times array<long>")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold each pair of ids, and whether no other pair of its B id has more."""
    each = chunks.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
    counted = each.groupBy("pair").agg(F.sum("n").alias("count"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(2**32 - 1)))  # as many rows as A has ids, at most
    return counted.withColumn("best", F.col("count") == F.max("count").over(of_b))


def _figures(kind: str):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in ("doc_id", "n_a", "n_b", "sha", "n_links")}
                told = batch.column("told")[i].values
                n = row["n_links"].to_numpy()
                off = np.concatenate([[0], np.cumsum(n)])
                place = np.frombuffer(batch.column("place")[i].as_buffer(), np.min_scalar_type(batch.column("n_pairs")[i].as_py()))
                sums = []
                for name in ("best", "count"):
                    of_pair = np.zeros(len(told) if told is not None else 0, np.int64)
                    if len(of_pair):
                        of_pair[told.field("pos").to_numpy()] = told.field(name).cast(pa.int64()).to_numpy()
                    total = np.concatenate([[0], np.cumsum(of_pair[place])])
                    sums.append(pa.array(total[off[1:]] - total[off[:-1]]))
                yield pa.RecordBatch.from_arrays([row["doc_id"], row["n_a"], row["n_b"], row["n_links"], row["n_links"], *sums, row["sha"]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(spark: SparkSession, docs: DataFrame, a: str, b: str) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) its numbers of tokens, groups and links, what its links count corpus-wide, and the digest of its groups."""
    with common.scratch(spark) as tables:
        chunks = tables.written(_chunks(docs, a, b), "token-chunks")
        told = tables.written(pair_counts(chunks), "pair-counts")
        placed = chunks.select("chunk", F.posexplode("pairs").alias("pos", "pair")).join(told, "pair")
        back = placed.groupBy("chunk").agg(F.collect_list(F.struct("pos", F.col("best").cast("long").alias("best"), "count")).alias("told"))  # a chunk's distinct pairs
        back = tables.written(back, "chunk-counts")
        whole = chunks.withColumn("n_pairs", F.size("pairs")).drop("pairs", "times").join(back, "chunk", "left")
        return tables.kept(whole.mapInArrow(*_figures(dict(docs.dtypes)["doc_id"])), "alignment")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned."""
    return align(spark, common.table(spark, sf_dir, "documents"), *_paths())
