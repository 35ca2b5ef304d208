"""One index of the lexicons' terms: a text is read once for all four of them.

An automaton over the literal beginnings of all terms names the places where a term
may begin; the lexicon's own pattern decides there. So occurrences are those that
``lexicons.count`` counts, leftmost and non-overlapping within a lexicon.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from riskweave.functions import lexicons

LEXICONS = ("crypto", "risk", "fee", "boilerplate")
COUNTS = StructType([StructField(name, IntegerType()) for name in LEXICONS])
PLACE = StructType([StructField(name, IntegerType()) for name in ("lexicon", "start", "end")])

# what Java's Unicode word boundary takes for a word's character
_WORD = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]"
# letters outside ASCII that patterns which ignore case take for an ASCII letter
_ALIKE = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k"))


def _beginning(term: str) -> str:
    """What every occurrence of a term begins with, in lower case."""
    literal = re.match(r"[A-Za-z \-]*", term).group()
    if term[len(literal) : len(literal) + 1] in ("?", "*", "{"):
        literal = literal[:-1]
    if not literal:
        raise ValueError(f"a term needs a literal beginning: {term}")
    return literal.lower()


@cache
def _automaton(names: tuple[str, ...] = LEXICONS) -> tuple[ahocorasick.Automaton, list[regex.Pattern]]:
    """The automaton of the lexicons ``names``, whose words carry (length, lexicons as bits), and each lexicon's pattern."""
    bits: dict[str, int] = {}
    for k, name in enumerate(names):
        for term in lexicons.WHOLE_WORDS.get(name) or lexicons.ANYWHERE[name]:
            bits[_beginning(term)] = bits.get(_beginning(term), 0) | 1 << k
    found = ahocorasick.Automaton()
    for word, of in bits.items():
        found.add_word(word, (len(word), of))
    found.make_automaton()
    any_of = lambda terms: "(?:" + "|".join(terms) + ")"
    whole = lambda terms: f"(?<!{_WORD}){any_of(terms)}(?!{_WORD})"
    return found, [regex.compile("(?i)" + (whole(lexicons.WHOLE_WORDS[n]) if n in lexicons.WHOLE_WORDS else any_of(lexicons.ANYWHERE[n]))) for n in names]


def _folded(text: str) -> str:
    if not text.isascii():
        for letter, alike in _ALIKE:  # four searches; translate() would look every character up
            text = text.replace(letter, alike)
    return text.lower()


def occurrences(text: str, names: tuple[str, ...] = LEXICONS) -> Iterator[tuple[int, int, int]]:
    """(lexicon's number in ``names``, start, end) of all terms by start; the end is exclusive."""
    automaton, patterns = _automaton(names)
    folded = _folded(text)
    places: dict[int, int] = {}
    for last, (size, of) in automaton.iter(folded):
        places[last - size + 1] = places.get(last - size + 1, 0) | of
    ends = [0] * len(patterns)
    for start in sorted(places):
        for k, pattern in enumerate(patterns):
            if places[start] >> k & 1 and start >= ends[k] and (hit := pattern.match(folded, start)):
                ends[k] = hit.end()
                yield k, start, ends[k]


def _counts(texts: pa.Array) -> pa.Array:
    counts = [[0] * len(texts) for _ in LEXICONS]
    for i, text in enumerate(texts):
        for k, _, _ in occurrences(text.as_py() or ""):
            counts[k][i] += 1
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in counts], names=list(LEXICONS), mask=texts.is_null())


@F.arrow_udf(COUNTS)
def counted(text: pa.Array) -> pa.Array:
    """How many terms of each lexicon a text holds; null for null."""
    return _counts(text)


def _tells(text: str) -> bool:
    """Whether a text holds a term of the topic and one of risk; it is read until both are found."""
    automaton, patterns = _automaton(("crypto", "risk"))
    folded, wanted = _folded(text), 0b11
    for last, (size, of) in automaton.iter(folded):
        for k, pattern in enumerate(patterns):
            if of & wanted & 1 << k and pattern.match(folded, last - size + 1):
                wanted ^= 1 << k
        if not wanted:
            return True
    return False


@F.arrow_udf(BooleanType())
def tells(text: pa.Array) -> pa.Array:
    """``told`` of a text's counts, without the counts; null for null."""
    return pa.array((None if (own := value.as_py()) is None else _tells(own) for value in text), pa.bool_())


@F.arrow_udf(ArrayType(StringType()))
def topics(text: pa.Array) -> pa.Array:
    """A text's different terms of the topic, as they stand there, in order; null for null."""
    words = lambda own: list(dict.fromkeys(own[a:b] for _, a, b in occurrences(own, ("crypto",))))
    return pa.array((None if (own := value.as_py()) is None else words(own) for value in text), pa.list_(pa.string()))


@F.arrow_udf(ArrayType(COUNTS))
def counted_each(texts: pa.Array) -> pa.Array:
    """``counted`` of every text of an array, each a text of its own; null for null."""
    counts = _counts(texts.flatten())
    return pa.ListArray.from_arrays(_offsets(texts), counts, mask=texts.is_null())


def _offsets(lists: pa.Array) -> pa.Array:
    """Where the lists begin and end in what ``flatten`` gives, which leaves null lists out."""
    sizes = lists.value_lengths().fill_null(0)
    return pa.array([0, *_running(sizes.to_pylist())], pa.int32())


def _running(sizes: list[int]) -> Iterator[int]:
    total = 0
    for size in sizes:
        total += size
        yield total


@F.arrow_udf(ArrayType(PLACE))
def index(text: pa.Array) -> pa.Array:
    """All occurrences of a text's terms: the lexicon's place in ``LEXICONS``, start and end in characters; null for null."""
    kind = pa.list_(pa.struct([("lexicon", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    rows = (None if (own := value.as_py()) is None else [{"lexicon": k, "start": a, "end": b} for k, a, b in occurrences(own)] for value in text)
    return pa.array(rows, kind)


# not to be copied: Catalyst would put what reads a text into each filter over its result too, and read it again
counted, counted_each, index, tells, topics = (udf.asNondeterministic() for udf in (counted, counted_each, index, tells, topics))


def told(hits: Column) -> Column:
    """Whether counts show a text to be on topic and on risk."""
    return (hits["crypto"] > 0) & (hits["risk"] > 0)


def telling(hits: Column) -> Column:
    """``told``, and neither boilerplate nor of fees."""
    return told(hits) & (hits["boilerplate"] == 0) & (hits["fee"] == 0)
