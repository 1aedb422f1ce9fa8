"""Normal forms of names, identifiers, dates and genders, for validation. All are Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def is_missing(c: Column) -> Column:
    """Null or blank."""
    return c.isNull() | (F.trim(c) == "")


def normalize_name(c: Column) -> Column:
    """Upper case; anything but A-Z is a space; single spaces; null gives an empty string."""
    return F.trim(F.regexp_replace(F.upper(_text(c)), "[^A-Z]+", " "))


def normalize_identifier(c: Column) -> Column:
    """Upper case, letters A-Z and digits only."""
    return F.regexp_replace(F.upper(_text(c)), "[^A-Z0-9]", "")


def normalize_numeric_identifier(c: Column) -> Column:
    """An identifier in which letters that OCR takes for digits become those digits."""
    return F.translate(normalize_identifier(c), "OQILZSB", "0011258")


def normalize_gender(c: Column) -> Column:
    u = F.trim(F.upper(_text(c)))
    return (
        F.when(_text(c) == "", "UNKNOWN")
        .when(u.isin("M", "MALE", "BOY", "0"), "M")
        .when(u.isin("F", "FEMALE", "GIRL", "1"), "F")
        .when(u.contains("TRANS"), "TRANSGENDER")
        .otherwise(F.substring(u, 1, 1))
    )


def repair_date_text(c: Column) -> Column:
    """Trimmed, one separator, and upper-case letters that OCR takes for digits replaced."""
    return F.translate(F.trim(c), "\\.OQIL|", "//00111")


def normalize_date(c: Column) -> Column:
    """ISO date of a text, or null.

    Forms: year first (month then day, else day then month), month/day/year else day/month/year, yyyymmdd, and
    yymmdd with years up to 50 ahead of 2024 in this century. Letters O, Q, I, L in digits' places are repaired
    first, so upper-case month names with them don't parse; for free forms use functions.dates.free_date.
    """
    s = F.regexp_replace(repair_date_text(c), "-", "/")
    parts = lambda order, fmt: F.try_to_date(F.regexp_replace(s, r"^(\d+)/(\d+)/(\d+)$", order), fmt)
    two = F.substring(s, 1, 2).try_cast("int")
    century = F.when(two <= 74, "20").otherwise("19")
    found = (
        F.when(s.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.coalesce(parts("$1-$2-$3", "yyyy-M-d"), parts("$1-$3-$2", "yyyy-M-d")))
        .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.coalesce(parts("$3-$1-$2", "yyyy-M-d"), parts("$3-$2-$1", "yyyy-M-d")))
        .when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))
        .when(s.rlike(r"^\d{6}$"), F.try_to_date(F.concat(century, s), "yyyyMMdd"))
    )
    return F.date_format(found, "yyyy-MM-dd")


def normalize_all_fields(fields: Column) -> Column:
    """A map of fields with each value in the form that its name asks for; empty ones are dropped."""

    def one(k: Column, v: Column) -> Column:
        has = lambda *parts: F.greatest(*[k.contains(p) for p in parts]) if len(parts) > 1 else k.contains(parts[0])
        return (
            F.when(has("name"), normalize_name(v))
            .when(has("date", "dob", "expiry", "issue"), F.coalesce(normalize_date(v), v))
            .when(has("gender", "sex"), normalize_gender(v))
            .when(has("number", "id"), normalize_identifier(v))
            .otherwise(F.trim(v))
        )

    return F.transform_values(F.map_filter(fields, lambda k, v: v.isNotNull() & (v != "")), one)
