"""Lexicons as patterns, for Spark columns and for DuckDB SQL.

Spark's regex dialect reads ``\\s`` and ``\\b`` as Unicode with ``(?U)``; ``(?d)`` makes the
newline the only line end. DuckDB's ``\\b`` is ASCII, so its texts first get every accented
Latin letter replaced by a plain one.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions import fixed

WHOLE_WORDS = {"crypto": fixed.CRYPTO, "risk": fixed.RISK, "fee": fixed.FEES, "specific": fixed.SPECIFIC, "hedge": fixed.HEDGES}
ANYWHERE = {"boilerplate": fixed.BOILERPLATE, "generic": fixed.GENERIC}


def body(name: str) -> str:
    if name in WHOLE_WORDS:
        return r"\b(?:" + "|".join(WHOLE_WORDS[name]) + r")\b"
    return "(?:" + "|".join(ANYWHERE[name]) + ")"


def count(text: Column, name: str) -> Column:
    return F.regexp_count(text, F.lit("(?idU)" + body(name)))


def has(text: Column, name: str) -> Column:
    return text.rlike("(?idU)" + body(name))


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, which may stand in one group."""
    inner = pattern[1:-1] if pattern.startswith("(") and pattern.endswith(")") else pattern
    return re.findall(r"(?:\(\?:[^()]*\)|[^|()])+", inner)


def _words(alternative: str) -> list[str]:
    """The plain words that every match of an alternative holds."""
    words = [w for w in re.split(r"\(\?:[^()]*\)|\.\{\d+,\d+\}|\.\??|\\b", alternative) if w]
    if not words or any(not re.fullmatch(r"[A-Za-z ]+", w) for w in words):
        raise ValueError(f"an alternative needs plain words: {alternative}")
    return words


def named(low: Column, pattern: str, flags: str) -> Column:
    """Whether a text in lower case matches a pattern.

    Plain words are looked for first, so that a regular expression, which steps through
    every alternative at every character, reads only texts that hold all words of one.
    Alternatives in upper case are left out, as they can't match.
    """
    tests = []
    for alternative in _alternatives(pattern):
        words = _words(alternative)
        if all(w == w.lower() for w in words):
            held = [low.contains(w) for w in words]
            plain = words == [alternative]
            tests.append(reduce(Column.__and__, held if plain else [*held, low.rlike(flags + alternative)]))
    return reduce(Column.__or__, tests)


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def plain_sql(text: str) -> str:
    return f"regexp_replace({text}, '[À-ÖØ-öø-ÿ]', 'x', 'g')"


def count_sql(text: str, name: str) -> str:
    """DuckDB: the number of matches; ``text`` must be plain (see plain_sql)."""
    return f"len(regexp_extract_all({text}, {quoted('(?i)' + body(name))}))"


def has_sql(text: str, name: str) -> str:
    return f"regexp_matches({text}, {quoted('(?i)' + body(name))})"
