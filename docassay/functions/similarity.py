"""Similarity of strings as matching blocks give it, and free-form dates: the functions that need pandas.

The ratio is asymmetric; the text read by OCR comes first. A sound bound on it from lengths alone is at hand
as a Column, so that joins can drop pairs before any Python runs.
"""

from __future__ import annotations

import datetime
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docassay.functions.adapt import let
from docassay.functions.normalize import normalize_identifier, normalize_name


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio is above it: twice the shorter length over the sum."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)


def ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over the sum of lengths; nulls count as empty."""

    def one(p: str, q: str) -> float:
        if not p and not q:
            return 1.0
        return 0.0 if set(p).isdisjoint(q) else SequenceMatcher(None, p, q).ratio()

    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(p or "", q or "") for p, q in zip(x, y)], dtype="float64")

    return compare(a, b)


def names_match(ocr: Column, reference: Column, threshold: float = 85.0) -> tuple[Column, Column]:
    """(matches, percent rounded to two places). The unrounded ratio is compared; an empty side never matches."""
    a, b = normalize_name(ocr), normalize_name(reference)
    some = (a != "") & (b != "")
    differ = some & (a != b)  # only such pairs are worth Python
    percent = F.when(~some, 0.0).when(a == b, 100.0).otherwise(ratio(F.when(differ, a), F.when(differ, b)) * 100)
    return some & (percent >= threshold), F.round(percent, 2)


def zone_name(c: Column) -> Column:
    """Upper case, fillers as spaces, other characters but A-Z and space removed, single spaces."""
    plain = F.regexp_replace(F.replace(F.upper(c), F.lit("<"), F.lit(" ")), "[^A-Z ]", "")
    return F.trim(F.regexp_replace(F.coalesce(plain, F.lit("")), r"\s+", " "))


def _compared(visual: Column, mrz: Column, close: float = 0.85, *, name: bool = False) -> Column:
    """struct(status, similarity) of a field read twice. Only sides that differ reach Python."""
    normal = zone_name if name else normalize_identifier
    sides = F.struct(normal(visual).alias("a"), normal(mrz).alias("b"))
    differ = let(sides, lambda s: F.when((s["a"] != "") & (s["b"] != "") & (s["a"] != s["b"]), s))

    def judge(s: Column) -> Column:
        missing = (s["a"] == "") | (s["b"] == "")
        value = F.when(missing, 0.0).when(s["a"] == s["b"], 1.0).otherwise(s["ratio"])
        status = F.when(missing, "NOT_AVAILABLE").when(s["a"] == s["b"], "MATCH").when(value >= close, "CLOSE_MATCH").otherwise("MISMATCH")
        return F.struct(status.alias("status"), F.round(value, 3).alias("similarity"))

    return let(F.struct(sides["a"].alias("a"), sides["b"].alias("b"), ratio(differ["a"], differ["b"]).alias("ratio")), judge)


def compare_fields(visual: Column, mrz: Column, close: float = 0.85, *, name: bool = False) -> tuple[Column, Column]:
    """(status, similarity rounded to three places) of a field read twice; names are compared as names."""
    both = _compared(visual, mrz, close, name=name)
    return both["status"], both["similarity"]


# The fields that stand on a visa twice.
TWICE = ("passport_number", "surname", "given_name", "nationality", "birth_date", "sex", "expiration_date")


def compare_zones(fields: Column, mrz: Column) -> Column:
    """A struct per field of TWICE: status and similarity of two structs or maps of fields."""
    return F.struct(*[_compared(fields[f], mrz[f], name=f in ("surname", "given_name")).alias(f) for f in TWICE])


def tally(checks: Column) -> Column:
    """available, matches, close_matches, mismatches and confidence (percent) of compare_zones()."""

    def counted(each: Column) -> Column:
        count = lambda s: F.size(F.filter(each, lambda x: x["status"] == s))
        total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x["similarity"])
        return F.struct(F.size(each).alias("available"), count("MATCH").alias("matches"), count("CLOSE_MATCH").alias("close_matches"), count("MISMATCH").alias("mismatches"), F.when(F.size(each) > 0, F.round(total / F.size(each) * 100, 2)).otherwise(0.0).alias("confidence"))

    every = let(checks, lambda c: F.array(*[c[f] for f in TWICE]))
    return let(F.filter(every, lambda x: x["status"] != "NOT_AVAILABLE"), counted)


def verification_status(has_mrz: Column, available: Column, matches: Column, mismatches: Column, confidence: Column) -> Column:
    return (
        F.when(~has_mrz, "VISA DATA DETECTED")
        .when(available == 0, "CLEARER IMAGE REQUIRED")
        .when((mismatches == 0) & (matches >= 2) & (confidence >= 85), "VERIFIED")
        .when(mismatches >= 2, "MISMATCH DETECTED")
        .when(confidence < 70, "CLEARER IMAGE REQUIRED")
        .otherwise("REVIEW REQUIRED")
    )


def parse_free_date(text: Column, as_of: datetime.date) -> Column:
    """ISO date of any text that dateutil reads, month first, else day first; missing parts come from ``as_of``."""
    fill = datetime.datetime(as_of.year, as_of.month, as_of.day)

    @F.pandas_udf("string")
    def read(batch: pd.Series) -> pd.Series:
        from dateutil import parser

        table = str.maketrans("\\.OQIL|", "//00111")

        def one(s: str | None) -> str | None:
            if not s or not s.strip():
                return None
            for day_first in (False, True):
                try:
                    return parser.parse(s.strip().translate(table), yearfirst=True, dayfirst=day_first, default=fill).date().isoformat()
                except (ValueError, OverflowError, TypeError):
                    continue
            return None

        return batch.map(one)

    return read(text)
