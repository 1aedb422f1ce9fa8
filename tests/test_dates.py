"""Free-form dates against the reader they stand for, and in rules."""

import datetime
import random

from pyspark.sql import functions as F

from docassay.functions.dates import free_date
from docassay.functions.similarity import parse_free_date
from docassay.plans.validate import validate

MONTHS = "Jan jan January feb Mar april May JUN Jul Aug sept Sep Oct october Nov DEC december".split()
# Texts that are no dates, half dates, and dates in doubt.
ODD = [
    None, "", "  ", "no date", "Monday", "on 3 May 2020", "2020-13-01", "2020-02-30", "31 February", "13/13/2020", "at 5 june", "'99 Jan 5", "1/2/3/4", "O1/I2/199L", "15 OCT 2020", "APRIL 1 2020", "12 Foo 2020",
    "2020 2021 5", "5 5 5 5", "1990-", "Jan-", "Jan-5-", "-5 May", "May 5 2020 10", "3 4 2020 25", "3 4 2020 2359", "2029", "15Jan1990", "1st of May", "May", "Feb 29", "0", "00/00/0000", "99", "31", "12", "Jan Feb 3", "2020 Jan 2021",
]


def written(rng):
    def number():
        return rng.choice([str(rng.randrange(40)), f"{rng.randrange(40):02d}", str(rng.randrange(1900, 2100)), str(rng.randrange(1, 13)), str(rng.randrange(40, 100))])

    kind = rng.random()
    if kind < 0.35:
        return rng.choice(["/", "-", ".", "\\"]).join(number() if rng.random() < 0.85 else rng.choice(MONTHS) for _ in range(rng.choice([2, 3, 3, 3])))
    if kind < 0.85:
        parts = [number() if rng.random() < 0.9 else f"{rng.randrange(1, 32)}{rng.choice(['st', 'nd', 'rd', 'th'])}" for _ in range(rng.choice([0, 1, 1, 2, 2, 2]))]
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(MONTHS))
        if rng.random() < 0.2:
            parts.insert(0, rng.choice(["Mon", "tuesday", "Fri,", "Sunday "]))
        return rng.choice([" ", ", ", "-", "/", " , ", "  "]).join(parts)
    return rng.choice([f"{rng.randrange(10**8):08d}", f"{rng.randrange(10**6):06d}", str(rng.randrange(1900, 2100)), str(rng.randrange(1, 40)), str(rng.randrange(19000101, 20991231))])


def test_free_dates_agree(spark):
    rng, today = random.Random(7), datetime.date.today()  # the reader takes centuries from the clock
    texts = [*ODD, *(written(rng) for _ in range(2500))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    native = {r["i"]: r["d"] for r in df.select("i", free_date(F.col("t"), today).alias("d")).collect()}
    read = {r["i"]: r["d"] for r in df.select("i", parse_free_date(F.col("t"), today).alias("d")).collect()}
    assert [(texts[i], native[i], read[i]) for i in range(len(texts)) if native[i] != read[i]] == []
    assert sum(d is not None for d in native.values()) > 1200


def test_free_dates_in_rules(spark):
    fields = {"passport_number": "P1234567", "name": "ANN", "nationality": "IND", "gender": "F", "date_of_birth": "3 May 1980", "date_of_issue": "May 2030", "date_of_expiry": "soon"}
    scans = spark.createDataFrame([("1", 90.0, fields)], "request_id string, ocr_confidence double, fields map<string,string>")
    row = validate(scans, spark.createDataFrame([], "passport_number string, status string"), "passport", datetime.date(2024, 1, 31)).first()
    assert [(m["field"], m["type"]) for m in row["mismatches"]] == [("date_of_expiry", "INVALID_DATE_TYPE"), ("passport_number", "DATABASE_NOT_FOUND")]
    assert [c["field"] for c in row["checks"] if c["rule"] == "DATE_VALIDATION"] == ["date_of_issue"]
