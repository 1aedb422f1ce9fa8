"""Synthetic registries whose every value follows from its key, so any engine makes the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.config import document_type

# Identifier patterns and shares (percent) of the statuses.
IDENTIFIERS = {"passport": "P%07d", "visa": "V%08d", "aadhaar": "%012d", "driving_license": "DL%010d", "national_id": "NID%08d", "permit": "PER%08d"}
STATUS_SHARES = (("ACTIVE", 70), ("EXPIRED", 10), ("REVOKED", 5), ("BLACKLISTED", 5), ("SUSPENDED", 5), ("LOST", 5))


def status(key: Column) -> Column:
    """A status drawn by the key's place in a full cycle of a hundred."""
    u, top = F.pmod(key * 37 + 11, F.lit(100)), 0
    out = F.lit(None).cast("string")
    for name, share in reversed(STATUS_SHARES):
        top += share
        out = F.when(u >= 100 - top, name) if top == share else out.when((u >= 100 - top), name)
    return out


def key_date(key: Column, first: str, days: int) -> Column:
    return F.date_add(F.lit(first).cast("date"), F.pmod(key * 7919, F.lit(days)).cast("int"))


# Names, states and kinds to draw from.
FIRST_NAMES = ("ARJUN", "PRIYA", "RAHUL", "ANANYA", "VIKRAM", "SNEHA", "AMIT", "POOJA", "ROHAN", "KAVYA", "ADITYA", "NEHA", "SANJAY", "DIVYA", "KARAN", "MEERA", "JOHN", "EMMA", "MICHAEL", "SOPHIA", "DAVID", "OLIVIA", "JAMES", "EMILY")
LAST_NAMES = ("MEHTA", "SHARMA", "PATEL", "GUPTA", "SINGH", "VERMA", "KUMAR", "JOSHI", "REDDY", "NAIR", "RAO", "DESHMUKH", "SMITH", "JOHNSON", "BROWN", "WILLIAMS")
NATIONALITIES = ("IND", "USA", "GBR", "CAN", "AUS", "DEU", "FRA", "SGP")
VISA_TYPES, PERMIT_TYPES, BLOOD_GROUPS, SEXES = ("TOURIST", "BUSINESS", "STUDENT", "WORK"), ("WORK", "RESIDENCE", "ENTRY"), ("A+", "B+", "O+", "AB+"), ("M", "F")


def draw(key: Column, salt: int, n: int) -> Column:
    """A number from 0 to n - 1 that follows from key and salt; products are cut down before they are shared out, so neighbours differ."""
    return F.pmod(F.floor(F.pmod(key * (7919 + 2 * salt) + 104_729 * salt, F.lit(1_000_003)) / 7), F.lit(n)).cast("int")


def pick(key: Column, salt: int, values: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), draw(key, salt, len(values)))


def drawn_date(key: Column, salt: int, first_year: int, last_year: int) -> Column:
    """An ISO date with a day of 28 at most."""
    return F.format_string("%04d-%02d-%02d", draw(key, salt, last_year - first_year + 1) + first_year, draw(key, salt + 1, 12) + 1, draw(key, salt + 2, 28) + 1)


def shown_day(key: Column, salt: int, first_year: int, last_year: int) -> Column:
    """Any day of the years, as DD/MM/YYYY."""
    days = (datetime.date(last_year, 12, 31) - datetime.date(first_year, 1, 1)).days + 1
    return F.date_format(F.date_add(F.lit(f"{first_year}-01-01").cast("date"), draw(key, salt, days)), "dd/MM/yyyy")


def registry_of(keys: DataFrame, type_name: str, key: str = "id") -> DataFrame:
    """A registry row of its type for every key (1 and up): ``id``, the identifier, the type's own columns and status.

    An expired document has an expiry in the past of the others. Equal keys give equal rows; a null key gives nulls.
    """
    k = F.col(key)
    first, last, other = pick(k, 1, FIRST_NAMES), pick(k, 2, LAST_NAMES), pick(k, 3, FIRST_NAMES)
    ended = lambda past, future: F.when(status(k) == "EXPIRED", past).otherwise(future)
    nation, sex = pick(k, 4, NATIONALITIES).alias("nationality"), pick(k, 5, SEXES).alias("gender")
    named = F.concat(first, F.lit(" "), last).alias("name")
    holder = F.format_string(IDENTIFIERS["passport"], draw(k, 6, 10_000) + 1).alias("passport_number")
    born = lambda a, b: drawn_date(k, 7, a, b).alias("date_of_birth")
    issued = lambda c: c.alias("date_of_issue")
    expires = lambda past, future: ended(F.lit(past), F.lit(future)).alias("date_of_expiry")
    columns = {
        "passport": [named, last.alias("surname"), nation, born(1965, 2003), issued(drawn_date(k, 10, 2015, 2023)), ended(drawn_date(k, 13, 2018, 2023), drawn_date(k, 16, 2027, 2035)).alias("date_of_expiry"), sex],
        "visa": [holder, named, nation, pick(k, 19, VISA_TYPES).alias("visa_type"), born(1965, 2003), issued(F.lit("2023-01-15")), expires("2024-01-14", "2030-01-14"), sex],
        "aadhaar": [named, born(1965, 2005), sex],
        "driving_license": [named, born(1970, 2002), issued(F.lit("2015-05-10")), expires("2020-05-09", "2035-05-09"), pick(k, 20, BLOOD_GROUPS).alias("blood_group"), F.concat(F.lit("S/O "), other, F.lit(" "), last).alias("relation")],
        "national_id": [named, nation, born(1970, 2002), expires("2022-01-01", "2032-01-01"), sex],
        "permit": [named, pick(k, 21, PERMIT_TYPES).alias("permit_type"), holder, issued(F.lit("2023-01-01")), expires("2023-12-31", "2028-12-31")],
    }
    number = F.when(k.isNotNull(), F.format_string(IDENTIFIERS[type_name], k)).alias(document_type(type_name).identifier)
    return keys.select(k.alias("id"), number, *columns[type_name], status(k).alias("status"))


def registry(spark: SparkSession, type_name: str, rows: int) -> DataFrame:
    """A registry of ``rows`` documents, keys 1 and up."""
    return registry_of(spark.range(1, rows + 1), type_name)


def small_registry(spark: SparkSession, type_name: str, rows: int = 50) -> DataFrame:
    """The small registry of a type, with identifiers as people write them, hyphens and all, and days as DD/MM/YYYY.

    A lookup by normal form finds none of the hyphenated ones unless the registry's keys are brought to their normal form too.
    """
    k = F.col("id")
    n, two = k.cast("string"), F.format_string("%02d", k)
    day = lambda salt, a, b, name: shown_day(k, salt, a, b).alias(name)
    born, nation, sex = day(1, 1970, 2000, "date_of_birth"), F.lit("IND").alias("nationality"), pick(k, 2, ("MALE", "FEMALE")).alias("gender")
    named = lambda who: F.concat(F.lit(f"{who} "), n).alias("name")
    number = lambda head, tail: F.concat(F.lit(head), tail).alias(document_type(type_name).identifier)
    # Identifiers, names and kinds of the small registries.
    columns = {
        "aadhaar": [number("1234567890", two), named("Test User"), sex, born, F.concat(F.lit("123 Fake Street, City "), n, F.lit(", State")).alias("address")],
        "driving_license": [number("DL-123456789-", n), named("Driver"), born, day(3, 2010, 2020, "date_of_issue"), day(4, 2030, 2040, "date_of_expiry"), F.lit("LMV, MCWG").alias("vehicle_classes")],
        "national_id": [number("NID-987654-", n), named("Citizen"), born, sex, nation],
        "passport": [number("P12345", two), named("Traveler"), born, sex, nation, day(3, 2015, 2022, "date_of_issue"), day(4, 2025, 2032, "date_of_expiry")],
        "permit": [number("PER-5555-", n), pick(k, 5, ("WORK", "RESIDENCE")).alias("permit_type"), named("Worker"), born, nation],
        "visa": [number("V-9999-", n), pick(k, 5, ("TOURIST", "BUSINESS")).alias("visa_type"), named("Visitor"), born, nation],
    }
    return spark.range(rows).select(*columns[type_name], F.lit("ACTIVE").alias("status"))
