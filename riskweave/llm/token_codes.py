"""Token ids in files of directly addressable codes.

Ids are split into chunks from the low bits up. Level 0 has the first chunk of every
id; a continuation bitmap tells which ids have a further chunk, and the chunks of those
stand in the next level at their rank among the set bits, which a rank directory (the
count of set bits before every 512th position) gives without scanning. So the id at any
position is read without decoding a block. Chunk widths are chosen for each file by
dynamic programming over the lengths of its ids. Chunks are stored as bit planes.

A file: magic, length of a JSON header, header (sections with offset and size), then the
sections. It also holds its documents' ids and the position of each one's first token.

Files are written under the shared folder by the tasks of a range partition of doc_id,
each under its partition's name, first under a name of the attempt and then renamed: a
task that runs again replaces its files with equal ones.

Defined results: null and empty texts have the end id only; rows that share a doc_id
stand in a row, in the order of their texts' hashes; null ids come first; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.llm import common, storage, words

MAGIC = b"RWDAC001"
RANK_STEP = 512
#: Tokens of one file, about; a document isn't cut.
FILE_TOKENS = 2_000_000
#: Words whose ids a worker remembers.
CACHE_WORDS = 400_000
#: A control character that stands between words given to the tokenizer together.
MARK = "\x01"
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


# -- the format ---------------------------------------------------------------


def choose_widths(ids: np.ndarray) -> list[int]:
    """The chunk widths with the fewest bits in all for these ids (bitmaps and rank directories counted)."""
    top = max(1, int(ids.max(initial=0)).bit_length())
    above = [int((ids >= (1 << o)).sum()) if o else len(ids) for o in range(top)]
    extra = 1 + 32 / RANK_STEP
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (top + 1)
    for o in range(top - 1, -1, -1):
        best[o] = min((above[o] * (w + (extra if o + w < top else 0)) + best[o + w][0], [w, *best[o + w][1]]) for w in range(1, top - o + 1))
    return best[0][1]


def encode(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The bytes of a file. ``doc_ids``: int64, missing ids as the smallest; ``starts``: the position of each first token."""
    ids = ids.astype(np.uint32)
    widths = choose_widths(ids)
    sections, header = [], {"tokens": len(ids), "docs": len(doc_ids), "widths": widths, "at": {}}
    place = 0

    def put(name: str, x: np.ndarray) -> None:
        nonlocal place
        raw = x.tobytes()
        header["at"][name] = [place, len(raw)]
        sections.append(raw)
        place += len(raw)

    put("doc_ids", doc_ids.astype("<i8"))
    put("starts", starts.astype("<i8"))
    rest = ids
    for level, w in enumerate(widths):
        for bit in range(w):
            put(f"{level}.{bit}", np.packbits((rest >> np.uint32(bit)) & np.uint32(1) != 0, bitorder="little"))
        rest = rest >> np.uint32(w) if w < 32 else np.zeros_like(rest)
        if level + 1 < len(widths):
            more = rest != 0
            counts = np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
            put(f"{level}.more", np.packbits(more, bitorder="little"))
            put(f"{level}.rank", (np.cumsum(counts) - counts).astype("<u4"))
            rest = rest[more]
    head = json.dumps(header).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *sections])


class TokenFile:
    """Reads a file: ``file[i]`` is one id, found directly; ``decode()`` all of them."""
    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(data[8:12], "little")
        self.header = json.loads(data[12 : 12 + size])
        self._data, self._base = data, 12 + size
        self.doc_ids, self.starts = self._section("doc_ids", "<i8"), self._section("starts", "<i8")

    def __len__(self) -> int:
        return self.header["tokens"]

    def _section(self, name: str, kind: str = "u1") -> np.ndarray:
        at, size = self.header["at"][name]
        return np.frombuffer(self._data, kind, size // np.dtype(kind).itemsize, self._base + at)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for level, w in enumerate(self.header["widths"]):
            for bit in range(w):
                value |= ((int(self._section(f"{level}.{bit}")[i >> 3]) >> (i & 7)) & 1) << (shift + bit)
            shift += w
            if level + 1 == len(self.header["widths"]):
                break
            more = self._section(f"{level}.more")
            if not (more[i >> 3] >> (i & 7)) & 1:
                break
            first = i // RANK_STEP * RANK_STEP
            inside = np.unpackbits(more[first >> 3 : (i >> 3) + 1], bitorder="little")[: i - first]
            i = int(self._section(f"{level}.rank", "<u4")[i // RANK_STEP]) + int(inside.sum())
        return value

    def decode(self) -> np.ndarray:
        counts, n = [], len(self)
        for level in range(len(self.header["widths"])):
            counts.append(n)
            if level + 1 < len(self.header["widths"]):
                n = int(np.unpackbits(self._section(f"{level}.more"), count=n, bitorder="little").sum())
        value = np.zeros(0, np.uint32)
        for level in range(len(counts) - 1, -1, -1):
            low = np.zeros(counts[level], np.uint32)
            for bit in range(self.header["widths"][level]):
                low |= np.unpackbits(self._section(f"{level}.{bit}"), count=counts[level], bitorder="little").astype(np.uint32) << np.uint32(bit)
            if level + 1 < len(counts):
                more = np.unpackbits(self._section(f"{level}.more"), count=counts[level], bitorder="little").astype(bool)
                low[more] |= value << np.uint32(self.header["widths"][level])
            value = low
        return value


# -- tokenizing ---------------------------------------------------------------


#: Bytes by what may stand on either side of a cut: white space, ASCII letters, ASCII marks but the apostrophe, and the rest.
_SPACE, _LETTER, _POINT, _REST = range(4)
_KIND = np.full(256, _REST, np.uint8)
_KIND[np.flatnonzero(words.PLAIN)] = _SPACE
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _POINT
_KIND[[c for c in range(65, 123) if chr(c).isalpha()]] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: In UTF-8, the byte that leads the letters from U+00C0 to U+00FF, and whether one behind it makes a small letter.
_LATIN = 0xC3
_SMALL = np.isin(np.arange(256), [c for c in range(0x9F, 0xC0) if c != 0xB7])
#: What cuts at white space alone.
BARE = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Words given to the tokenizer in one text.
TOGETHER = 1_000


def pieces(data: np.ndarray, off: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of what is tokenized on its own, and each text's first.

    White space cuts, and unless ``plain`` so does the place between an ASCII letter and
    an ASCII mark that isn't an apostrophe: the tokenizer's pattern always cuts there.
    """
    kind = _KIND[data]
    begin = np.zeros(len(data) + 1, bool)
    begin[1:-1] = kind[1:] != kind[:-1]
    if plain:
        begin[1:-1] &= (kind[1:] == _SPACE) | (kind[:-1] == _SPACE)
    else:
        begin[1:-1] &= (kind[1:] != _REST) & (kind[:-1] != _REST) | (kind[1:] == _SPACE) | (kind[:-1] == _SPACE)
    begin[off] = True
    begin[-1] = True
    cuts = np.flatnonzero(begin)
    inside = kind[cuts[:-1]] != _SPACE
    starts = cuts[:-1][inside]
    return starts, cuts[1:][inside], np.searchsorted(starts, off)


class WordTokenizer:
    """Ids of whole texts by a tokenizer that ignores letter case, drops white space and never joins across it.

    So the ids of a text are those of its pieces in turn, and each distinct piece, its
    ASCII letters in lower case, is given to the tokenizer once. Where a special token's
    string occurs in any case, pieces are whole words as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        own = [t.content.lower().encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile(b"|".join(map(re.escape, own)) if own else b"(?!)")
        self._mark = self._tokenizer.encode(MARK, add_special_tokens=False).ids
        given = json.loads(self._tokenizer.to_str())
        end = given["model"].get("end_of_word_suffix")
        self._bare = Tokenizer.from_str(json.dumps(given | {"normalizer": None, "pre_tokenizer": BARE}))
        self._closes = np.zeros(max(self._tokenizer.get_vocab().values()) + 1, bool)
        self._closes[[i for token, i in self._tokenizer.get_vocab().items() if end and token.endswith(end)]] = True
        self._forget()

    def _forget(self) -> None:
        self._known: dict[int, int] = {}
        self._flat, self._off = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``texts`` (words), one after the other, and the number of each one's.

        Words are joined with a mark between them, which is cheaper than one call for
        each; a word that holds the mark, or any word if its id isn't single, goes alone.
        """
        joint = np.array([MARK not in t for t in texts], bool) & (len(self._mark) == 1)
        size = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = [None] * len(texts)
        alone = np.flatnonzero(~joint)
        for i, e in zip(alone, self._tokenizer.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False), strict=True):
            parts[i], size[i] = np.array(e.ids, np.uint32), len(e.ids)
        together = np.flatnonzero(joint)
        groups = [together[i : i + TOGETHER] for i in range(0, len(together), TOGETHER)]
        found = self._tokenizer.encode_batch_fast([f" {MARK} ".join([texts[i] for i in g]) + f" {MARK}" for g in groups], add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in found] or [np.zeros(0, np.uint32)])
        marks = np.flatnonzero(flat == self._mark[0]) if len(self._mark) == 1 else np.zeros(0, np.int64)
        if len(marks) != len(together):
            raise ValueError("a word's ids hold the mark's")
        size[together] = np.diff(np.append(-1, marks)) - 1
        flat = np.delete(flat, marks)
        if not len(alone):
            return flat, size
        ends = np.cumsum(size[together])
        for i, a, b in zip(together, ends - size[together], ends, strict=True):
            parts[i] = flat[a:b]
        return np.concatenate(parts), size

    def _spelled(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces as they are dealt with, the ids of all of them in that order, and the number of each one's.

        A piece of small Latin letters alone is one word to the tokenizer, which its rules leave
        as it is, and whose last id shows that it ends the word. So such pieces are given to the
        same model without those rules, and need no mark between them.
        """
        size = ends - starts
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat = data[within + np.repeat(starts, size)]
        behind = np.append(False, flat[:-1] == _LATIN)
        letter = (_KIND[flat] == _LETTER) & (flat > 90) | (flat == _LATIN) | behind & _SMALL[flat]
        easy = np.logical_and.reduceat(letter, np.cumsum(size) - size)
        own, rest = np.flatnonzero(easy), np.flatnonzero(~easy)
        place = np.append(0, np.cumsum(size[own] + 1))
        line = np.full(place[-1], 32, np.uint8)
        taken = np.repeat(easy, size)
        line[within[taken] + np.repeat(place[:-1], size[own])] = flat[taken]
        texts = [line[place[i] : place[min(i + TOGETHER, len(own))]].tobytes().decode() for i in range(0, len(own), TOGETHER)]
        found = self._bare.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found] or [np.zeros(0, np.uint32)])
        last = np.flatnonzero(self._closes[ids])
        if len(last) != len(own):  # not a tokenizer that shows where words end
            own, rest, ids, last = own[:0], np.arange(len(size)), ids[:0], last[:0]
        more, sizes = self._ids([bytes(data[starts[i] : ends[i]]).decode() for i in rest])
        return np.append(own, rest), np.concatenate([ids, more]), np.concatenate([np.diff(np.append(-1, last)), sizes])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of ``col``, one after the other, and the offsets of each text's."""
        data, off = words.text_bytes(col)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        low = _LOWER[data]
        plain = bool(self._special.search(low.tobytes()))
        data = data if plain else low
        starts, ends, first = pieces(data, off, plain)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        hashes = words.word_hashes(data, starts, ends)
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._known) + len(distinct) > CACHE_WORDS:
            self._forget()
        slot = np.array([self._known.get(h, -1) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            order, ids, sizes = self._spelled(data, starts[at[new]], ends[at[new]])
            new = new[order]
            slot[new] = np.arange(len(self._known), len(self._known) + len(new))
            self._known.update(zip(distinct[new].tolist(), slot[new].tolist(), strict=True))
            self._flat = np.concatenate([self._flat, ids])
            self._off = np.concatenate([self._off, self._off[-1] + np.cumsum(sizes)])
        of_word = slot[back]
        size = self._off[of_word + 1] - self._off[of_word]
        ends_at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ends_at[1:])
        from_ = np.arange(ends_at[-1]) - np.repeat(ends_at[:-1] - self._off[of_word], size)
        return self._flat[from_], ends_at[first]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# -- files --------------------------------------------------------------------

MANIFEST = "file string, part int, nth int, first_doc long, docs long, tokens long"


def _writer(folder: str, path: str, file_tokens: int):
    def run(batches):
        own = tokenizer(path)
        part = TaskContext.get().partitionId()
        held, ids_, sizes, n, nth = [], [], [], 0, 0

        def flush():
            nonlocal held, ids_, sizes, n, nth
            uri = f"{folder}/part-{part:06d}-{nth:04d}.dac"
            length = np.concatenate(sizes)
            ids, docs = np.concatenate(ids_), pa.chunked_array(held)
            first = docs[0].as_py()
            storage.write(uri, encode(ids, docs.fill_null(np.iinfo(np.int64).min).to_numpy(), np.cumsum(length) - length))
            done = pa.RecordBatch.from_pydict({"file": [uri], "part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()), "first_doc": pa.array([first], pa.int64()), "docs": pa.array([len(docs)], pa.int64()), "tokens": pa.array([len(ids)], pa.int64())})
            held, ids_, sizes, n, nth = [], [], [], 0, nth + 1
            return done

        for batch in batches:
            text = batch.column("text")
            for at, to in words.chunks(text):
                ids, off = own.encode(text.slice(at, to - at))
                ends = off[1:] + np.arange(1, to - at + 1)
                out = np.full(len(ids) + to - at, END_ID, np.uint32)
                keep = np.ones(len(out), bool)
                keep[ends - 1] = False
                out[keep] = ids
                held.append(batch.column("doc_id").slice(at, to - at))
                ids_.append(out)
                sizes.append(np.diff(off) + 1)
                n += len(out)
                if n >= file_tokens:
                    yield flush()
        if held:
            yield flush()

    return run


def write_token_files(spark: SparkSession, docs: DataFrame, folder: str, path: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; return the manifest with each file's ``start``."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    # an id that many rows share is cut by the hash of the texts, which orders them too
    ordered = keyed.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    with common.scratch(spark) as tables:
        manifest = tables.written(ordered.mapInArrow(_writer(folder, path, file_tokens), MANIFEST), "manifest")
        totals = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").collect()  # a row a partition
        ends = np.cumsum([r.tokens for r in totals], dtype=np.int64).tolist()
        begins = spark.createDataFrame([(r.part, end - r.tokens) for r, end in zip(totals, ends, strict=True)], "part int, begin long")
        before = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
        placed = manifest.join(F.broadcast(begins), "part").withColumn("start", (F.col("begin") + F.coalesce(F.sum("tokens").over(before), F.lit(0))).cast("long"))
        return tables.kept(placed.drop("begin"), "manifest-starts")


def _reader(batches):
    for batch in batches:
        for uri, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            file = TokenFile(storage.read(uri))
            ids = file.decode().astype("<u4")
            ends = np.append(file.starts, len(file))
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            docs = pa.array(file.doc_ids, pa.int64(), mask=file.doc_ids == np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays([docs, pa.array(file.starts + base), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files."""
    files = manifest.select("file", "start").repartition(max(1, min(manifest.count(), 10_000)), "file")
    return files.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_corpus(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder = common.new_folder(spark, "tokens")
    return read_token_files(write_token_files(spark, docs, folder, tokenizer_path()))


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to files and read back."""
    return encode_corpus(spark, common.table(spark, sf_dir, "documents"))
