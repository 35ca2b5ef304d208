"""Listing filters composed into one predicate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_ci(column: str, needle: str) -> Column:
    """Case-insensitive LIKE '%needle%'; percent and underscore in the needle stay wildcards, a backslash is itself."""
    return F.col(column).ilike("%" + needle.replace("\\", "\\\\") + "%")


CONDITIONS = {
    "company": lambda v: contains_ci("company_name", v),
    "form_type": lambda v: F.col("form_type") == v,
    "month": lambda v: F.substring("filing_date", 1, 7) == v,
    "filing_category": lambda v: F.col("filing_category") == v,
    "search_keyword": lambda v: F.col("search_keyword") == v,
    "search": lambda v: contains_ci("company_name", v) | contains_ci("risk_summary", v) | contains_ci("form_type", v),
}


def from_request(given: dict | None) -> dict:
    """Filters as a listing's request gives them: stripped, empty ones not set. (The JSON listing takes them as they are.)"""
    return {k: (v.strip() or None) if isinstance(v, str) else v for k, v in (given or {}).items()}


def active(filters: dict | None) -> dict:
    """The filters that are set."""
    return {k: v for k, v in (filters or {}).items() if v}


def apply(df: DataFrame, filters: dict | None) -> DataFrame:
    """Rows that meet every set filter."""
    tests = [CONDITIONS[k](v) for k, v in active(filters).items()]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("filing_date").desc(), "accession_no")
