"""Scalar functions of the views and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions import fixed

CELL = 32_767


def excel_cell(text: Column) -> Column:
    """No control characters; at most CELL characters, the last three dots where cut."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    return cut(clean, CELL, CELL - 3)


def cut(text: Column, longest: int, keep: int) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def short_summary(text: Column) -> Column:
    return cut(text, fixed.SHORT_SUMMARY, fixed.SHORT_SUMMARY)


def label(text: Column) -> Column:
    return cut(text, fixed.LABEL, fixed.LABEL_CUT)


def badge(form: Column) -> Column:
    """The badge of a form by the first pattern it contains."""
    rules = (("10-K", "10k"), ("10-Q", "10q"), ("8-K", "8k"), ("485", "485"), ("N-1A", "n1a"), ("S-1", "s1"))
    out = F.when(form.contains(rules[0][0]), rules[0][1])
    for part, name in rules[1:]:
        out = out.when(form.contains(part), name)
    return out.otherwise("other")


def bucket(confidence: Column) -> Column:
    return F.when(confidence == 0, "N/A").when(confidence >= 0.7, "high").when(confidence >= 0.4, "medium").otherwise("low")
