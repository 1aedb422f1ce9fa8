"""Machine-readable zones: cleaning and reading by position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_mrz(text: Column) -> Column:
    """Upper case; look-alikes of the filler become fillers; only A-Z, 0-9 and < stay."""
    return F.regexp_replace(F.translate(F.upper(text), "«‹_— ", "<<<<"), "[^A-Z0-9<]", "")


def fit_line(line: Column, width: int = 44) -> Column:
    return F.rpad(F.substring(line, 1, width), width, "<")


def _plain(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, "<+", " ")), F.lit(""))


def plausible(line1: Column, line2: Column) -> Column:
    """False only if the first line begins with neither P nor V and the second with a letter or digit."""
    return line1.rlike("^[PV]") | ~line2.rlike("^[A-Z0-9]")


def parse_mrz(line1: Column, line2: Column) -> dict[str, Column]:
    """Fields of two fitted lines, by offset."""
    names = F.split(F.substring(line1, 6, 39), "<<", 2)
    number, personal = F.replace(F.substring(line2, 1, 9), F.lit("<"), F.lit("")), F.replace(F.substring(line2, 29, 14), F.lit("<"), F.lit(""))
    return {
        "document_code": F.substring(line1, 1, 2),
        "issuing_country": F.substring(line1, 3, 3),
        "surname": _plain(F.get(names, F.lit(0))),
        "given_name": _plain(F.get(names, F.lit(1))),
        "visa_number": F.nullif(number, F.lit("")),
        "passport_number": F.nullif(F.when(F.length(personal) >= 6, personal).otherwise(number), F.lit("")),
        "nationality": _plain(F.substring(line2, 11, 3)),
        "birth_date": F.substring(line2, 14, 6),
        "sex": F.substring(line2, 21, 1),
        "expiration_date": F.substring(line2, 22, 6),
        "personal_number": F.nullif(personal, F.lit("")),
    }


def passport_sex(code: Column) -> Column:
    """M for M and 0; whatever else is read counts as F."""
    return F.when(code.isin("M", "0"), "M").otherwise("F")


def mrz_date(code: Column, latest_year: int = 74) -> Column:
    """DD/MM/YYYY of yymmdd; years after ``latest_year`` are of the last century. Null off the calendar."""
    century = F.when(F.substring(code, 1, 2).try_cast("int") > latest_year, "19").otherwise("20")
    return F.date_format(F.try_to_date(F.concat(century, code), "yyyyMMdd"), "dd/MM/yyyy")


def parse_passport(line1: Column, line2: Column, country_names: dict[str, str] | None = None) -> dict[str, Column]:
    """Passport fields of two fitted lines: dates as DD/MM/YYYY, countries by name where ``country_names`` has their code."""
    named = lambda code: code if not country_names else F.coalesce(F.create_map(*[F.lit(x) for kv in country_names.items() for x in kv])[code], code)
    zone = parse_mrz(line1, line2)
    return {
        "name": zone["given_name"],
        "surname": zone["surname"],
        "sex": passport_sex(zone["sex"]),
        "date_of_birth": mrz_date(zone["birth_date"]),
        "nationality": named(zone["nationality"]),
        "passport_type": _plain(zone["document_code"]),
        "passport_number": zone["visa_number"],
        "issuing_country": named(_plain(zone["issuing_country"])),
        "expiration_date": mrz_date(zone["expiration_date"], latest_year=99),
        "personal_number": zone["personal_number"],
    }


def mean_confidence(first: Column, second: Column) -> Column:
    """Of the two lines, rounded to three places."""
    return F.round((first + second) / 2, 3)
