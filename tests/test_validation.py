"""Expected values of the blueprint's fixtures, and behaviour on hostile records."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from docassay.config import TYPES
from docassay.functions import adapt, checksum, extract, mrz, normalize, similarity
from docassay.operators import layout, lookup, rules, synth
from docassay.operators.lookup import registry_lookup
from docassay.plans.validate import validate, validate_mixed
from docassay.sources import io
from docassay.sources.tables import registry_columns

AS_OF = datetime.date(2024, 1, 1)
PASSPORT = {"name": "Arjun Mehta", "passport_number": "P0000001", "nationality": "IND", "date_of_birth": "1998-04-12", "date_of_issue": "2020-01-01", "date_of_expiry": "2030-01-01", "gender": "M"}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function, text, expected",
    [
        (normalize.normalize_name, "Arjun  Mehta<", "ARJUN MEHTA"),
        (normalize.normalize_name, None, ""),
        (normalize.normalize_identifier, "P-123 456", "P123456"),
        (normalize.normalize_numeric_identifier, "O123L5S", "0123155"),
        (normalize.normalize_date, "1998/04/12", "1998-04-12"),
        (normalize.normalize_date, "15/08/1990", "1990-08-15"),
        (normalize.normalize_date, "12/05/1990", "1990-12-05"),
        (normalize.normalize_date, "2020-13-01", "2020-01-13"),
        (normalize.normalize_date, "2023-02-31", None),
        (normalize.normalize_date, "INVALID_DATE", None),
        (normalize.normalize_date, "", None),
        (normalize.normalize_gender, "Male", "M"),
        (normalize.normalize_gender, "1", "F"),
        (adapt.adapter_gender, "1", "M"),
        (adapt.adapter_gender, "N / F", "F"),
        (adapt.adapter_date, "850312", "1985-03-12"),
        (adapt.adapter_date, "360101", "1936-01-01"),
        (adapt.adapter_date, "15 JAN 1990", "1990-01-15"),
        (adapt.adapter_date, "12/05/90", "2090-05-12"),
        (adapt.adapter_date, "2029", "2029"),
        (adapt.normalize_country, "IND", "IN"),
        (extract.blood_group, "O+", None),
        (extract.blood_group, "O+X", "O+"),
        (mrz.clean_mrz, "p«ind‹‹a b", "P<IND<<AB"),
        (checksum.mask_number, "123456789012", "XXXX XXXX 9012"),
    ],
)
def test_scalars(spark, function, text, expected):
    assert one(spark, function(F.lit(text).cast("string"))) == expected


def test_verhoeff(spark):
    assert one(spark, checksum.verhoeff_valid(F.lit("2363"), 4)) is True  # the textbook example
    assert one(spark, checksum.verhoeff_valid(F.lit("2364"), 4)) is False
    assert one(spark, checksum.verhoeff_valid(F.lit("23x4"), 4)) is False


def test_similarity_is_asymmetric(spark):
    assert one(spark, similarity.ratio(F.lit("tide"), F.lit("diet"))) == 0.25
    assert one(spark, similarity.ratio(F.lit("diet"), F.lit("tide"))) == 0.5


def test_free_dates(spark):
    rows = spark.createDataFrame([("15 JAN 1990",), ("15 OCT 2020",), ("nonsense",), (None,)], "t string").select(similarity.parse_free_date(F.col("t"), AS_OF).alias("d")).collect()
    assert [r["d"] for r in rows] == ["1990-01-15", None, None, None]


def scan(spark, fields, confidence=96.0):
    return spark.createDataFrame([("r", confidence, fields)], "request_id string, ocr_confidence double, fields map<string,string>")


def registry(spark, status="ACTIVE", name="ARJUN MEHTA"):
    return spark.createDataFrame([("P0000001", name, "1998-04-12", status)], "passport_number string, name string, date_of_birth string, status string")


def verdict(spark, fields, confidence=96.0, **how):
    return validate(scan(spark, fields, confidence), registry(spark, **how), "passport", AS_OF).first()


@pytest.mark.parametrize(
    "status, score, outcome",
    [("ACTIVE", 100.0, "PASS"), ("LOST", 100.0, "PASS"), ("SUSPENDED", 100.0, "PASS"), ("EXPIRED", 70.0, "MANUAL_REVIEW"), ("REVOKED", 52.0, "MANUAL_REVIEW"), ("BLACKLISTED", 25.0, "FAIL")],
)
def test_status(spark, status, score, outcome):
    got = verdict(spark, PASSPORT, status=status)
    assert (got["validation_score"], got["validation_status"], got["document_status"]) == (score, outcome, status)


def test_confidence_and_name(spark):
    assert verdict(spark, PASSPORT, 60.0)["validation_score"] == 92.0
    assert verdict(spark, PASSPORT, 40.0)["validation_score"] == 85.0
    assert verdict(spark, PASSPORT, name="SOMEBODY ELSE")["validation_score"] == 70.0


def test_missing_record_and_fields(spark):
    got = verdict(spark, PASSPORT | {"passport_number": "P9999999"})
    assert (got["validation_score"], got["database_match"], got["document_status"]) == (70.0, False, "NOT_FOUND")
    got = verdict(spark, {"name": "X"})
    assert got["validation_status"] == "FAIL" and got["data_source"] == "none"
    assert {m["type"] for m in got["mismatches"]} >= {"MISSING_REQUIRED_FIELD", "DATABASE_NOT_FOUND"}


def test_future_birth(spark):
    assert "FUTURE_DOB" in {m["type"] for m in verdict(spark, PASSPORT | {"date_of_birth": "2099-01-01"})["mismatches"]}


@pytest.mark.parametrize("value", ["P0000001' OR '1'='1'; DROP TABLE passports; --", "<b>é€\x00</b>", "", None, "99999-999-999"])
def test_hostile_values(spark, value):
    got = verdict(spark, PASSPORT | {"passport_number": value, "name": value, "date_of_birth": value})
    assert 0 <= got["validation_score"] <= 100 and not got["database_match"]


def test_unknown_type(spark):
    got = validate(scan(spark, {"name": "A"}), spark.createDataFrame([], "document_number string, status string"), "intergalactic_space_permit", AS_OF).first()
    assert got["document_type"] == "intergalactic_space_permit" and not got["database_match"]


def test_adapt(spark):
    raw = F.create_map(*[F.lit(x) for x in ("Full_Name", "ARJUN", "checks", "x", "dob", "1990-01-01", "noise", "v", "sex", " ")])
    inner = F.create_map(F.lit("name"), F.lit("FIRST"))
    assert one(spark, adapt.adapt(raw, extracted=inner)) == {"name": "FIRST", "date_of_birth": "1990-01-01"}


def test_mutations(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, lookup.upsert(a, b, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, lookup.insert_ignore(a, b, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def tokens(spark, rows):
    return spark.createDataFrame([(1, i, t, c, float(x), float(y)) for i, (t, c, x, y) in enumerate(rows)], "doc_id long, ord int, text string, confidence double, cx double, cy double")


def test_layout(spark):
    page = tokens(spark, [("Name", 0.9, 0, 0), ("A 1234 B", 0.8, 50, 5), ("City: Rome", 0.7, 0, 100), ("Number", 0.9, 0, 200), ("X 2020 Y", 0.6, 5, 260)])
    found = {(r["label"], r["value"], r["source"]) for r in layout.dynamic_fields(page).collect()}
    assert found == {("Name", "A 1234 B", "layout_relation"), ("City", "Rome", "same_line"), ("Number", "X 2020 Y", "layout_relation")}
    twice = tokens(spark, [("HELLO WORLD", 0.5, 0, 0), ("HELLO WORL0", 0.9, 0, 0), ("OTHER", 0.4, 0, 0), ("--", 0.9, 0, 0)])  # without letters or digits: dropped
    assert {r["text"] for r in layout.fuzzy_dedup(twice).collect()} == {"HELLO WORL0", "OTHER"}


def test_licence_fields(spark):
    page = tokens(spark, [("NAME: ANN", 0.9123, 0, 0), ("B1OOD GROUP", 0.8, 0, 100), ("O+", 0.7, 150, 110), ("DATE 0F BIRTH", 0.9, 0, 200), ("01/02/1990", 0.6, 10, 300), ("NAME - BOB", 0.5, 0, 400), ("no 1234567", 0.5, 900, 900)])
    got = {r["label"]: (r["value"], r["confidence"], r["source"]) for r in layout.licence_fields(page).collect()}
    assert got == {
        "NAME": ("BOB", 0.5, "same_line"),  # the later one stays
        "BLOOD GROUP": ("O+", 0.7, "fuzzy_label_layout"),
        "DATE OF BIRTH": ("01/02/1990", 0.6, "fuzzy_label_layout"),
        "Detected Date 1": ("01/02/1990", 0.6, "pattern_detection"),
        "Detected Number 1": ("1234567", 0.5, "pattern_detection"),
    }
    assert layout.known_label("...") is None and layout.known_label("DL NUMBR") == "DL NUMBER" and layout.known_label("zzz") is None


def test_mrz_lines(spark):
    one_, two = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    page = tokens(spark, [(two, 0.8, 0, 50), (one_[:40], 0.6, 0, 10), (one_, 0.9, 0, 12), ("SHORT", 0.9, 0, 5)])
    (got,) = layout.mrz_lines(page).collect()
    assert (got["line1"], got["line2"], got["mrz_confidence"], got["reason"]) == (one_, two, 0.85, None)
    assert layout.mrz_lines(page.where("confidence < 0.7")).first()["reason"] == "Two MRZ lines were not detected."
    assert layout.mrz_lines(page.where("text = 'SHORT'")).first()["reason"] == "MRZ was not detected."


def test_mixed_types_and_scans_without_number(spark):
    rows = [("a", "passport", 96.0, PASSPORT), ("b", "Intergalactic Space Permit", 96.0, {"name": "X"}), ("c", None, 96.0, {}), ("d", "permit", 96.0, {"permit_number": None, "name": ""})]
    scans = spark.createDataFrame(rows, "request_id string, document_type string, ocr_confidence double, fields map<string,string>")
    got = {r["request_id"]: r for r in validate_mixed(scans, {"passport": registry(spark)}, AS_OF).collect()}
    alone = verdict(spark, PASSPORT)
    assert got["a"]["validation_score"] == alone["validation_score"] and got["a"]["checks"] == alone["checks"]
    assert (got["b"]["document_type"], got["b"]["source_status"]) == ("Intergalactic Space Permit", "unconfigured")
    assert got["c"]["document_type"] == "unknown" and got["d"]["validation_status"] == "FAIL"


def test_audit_routing(spark, tmp_path):
    rows = [("1", "o", "Passport", "IN", 91.239, {"passport_number": "P1", "odd": "x"}), ("2", "o", "visa", None, 1.0, {"country": "FR"}), ("3", "o", "other", None, 1.0, {})]
    io.write_audit(spark.createDataFrame(rows, "id string, officer_id string, document_type string, document_country string, ocr_confidence double, fields map<string,string>"), str(tmp_path), "b1")
    read = lambda n: io.read_audit(spark, str(tmp_path), n)
    assert read("scan_logs").count() == 3 and read("ocr_passports").first()["country"] == "IN" and read("ocr_visas").first()["country"] == "FR" and read("ocr_permits").count() == 0
    assert {r["ocr_confidence"] for r in read("scan_logs").collect()} == {91.24, 1.0}


def test_synthetic_registry(spark):
    made = synth.registry(spark, "passport", 1000)
    assert made.count() == made.select("passport_number").distinct().count() == 1000
    shares = {r["status"]: r["count"] for r in made.groupBy("status").count().collect()}
    assert shares == {"ACTIVE": 700, "EXPIRED": 100, "REVOKED": 50, "BLACKLISTED": 50, "SUSPENDED": 50, "LOST": 50}


def test_registries_have_their_own_columns(spark):
    for t, doc in TYPES.items():
        rows = [r.asDict() for r in synth.registry(spark, t, 300).collect()]
        _, held, free = registry_columns(t)
        assert set(rows[0]) == {"id", *held, *free, "status"}, t
        assert len({r[doc.identifier] for r in rows}) == 300
        if "date_of_expiry" in rows[0]:
            past = max(r["date_of_expiry"] for r in rows if r["status"] == "EXPIRED")
            assert past < min(r["date_of_expiry"] for r in rows if r["status"] != "EXPIRED"), t
        drawn = [c for c in ("nationality", "gender", "visa_type", "permit_type", "blood_group") if c in rows[0]]
        assert all(len({r[c] for r in rows}) >= 2 for c in drawn) and len({r["name"] for r in rows}) > 100
        small = [r.asDict() for r in synth.small_registry(spark, t).collect()]
        assert len(small) == 50 and small[7][doc.identifier].endswith("7") and all(re.fullmatch(r"\d\d/\d\d/\d{4}", r["date_of_birth"]) for r in small)
    nulls = synth.registry_of(spark.createDataFrame([(None,)], "id long"), "visa").first()
    assert nulls["visa_number"] is None and nulls["status"] is None
    hidden = registry_lookup(spark.createDataFrame([("PER55557",)], "n string"), synth.small_registry(spark, "permit"), F.col("n"), "permit_number").first()
    assert not hidden["database_match"]


def test_upload_guard(spark):
    files = spark.createDataFrame([("a/x.png", 10), ("a/y.exe", 10), ("a/z.pdf", 10), ("a/v.bmp", 0), ("a/w.jpg", 1 << 30)], "path string, length long")
    good, bad = io.guard_uploads(files)
    assert [r["path"] for r in good.collect()] == ["a/x.png"]
    assert {r["path"]: r["code"] for r in bad.collect()} == {"a/y.exe": 415, "a/z.pdf": 415, "a/v.bmp": 400, "a/w.jpg": 413}


def test_stream(spark, tmp_path):
    from docassay.streaming.validate import validate_stream

    scan(spark, PASSPORT).write.parquet(str(tmp_path / "in"))
    incoming = spark.readStream.schema("request_id string, ocr_confidence double, fields map<string,string>").parquet(str(tmp_path / "in"))
    validate_stream(incoming, registry(spark), "passport", AS_OF, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["validation_score"] == 100.0


def test_penalty_keys(spark):
    key = lambda rule, text: one(spark, rules.penalty_key(F.lit(rule), F.lit(text)))
    assert key("DATABASE_LOOKUP", "x") == "database_mismatch"
    assert key("DATABASE_FIELD_MATCH", "OCR 'EXPIRED'") == "expired"


def test_countries_cover_the_whole_table(spark):
    assert (len(adapt.ALPHA3), len(adapt.COUNTRY_NAMES)) == (177, 81)
    raw = [(k, v) for k, v in (adapt.ALPHA3 | adapt.COUNTRY_NAMES).items()]
    rows = spark.createDataFrame(raw, "raw string, code string").withColumn("got", adapt.normalize_country(F.lower("raw"))).collect()
    assert len(rows) == 258 and all(r["got"] == r["code"] for r in rows)
    known = {r["raw"]: r["got"] for r in rows}
    assert [known[k] for k in ("AFG", "ALB", "DZA", "KHM", "CUB", "BHUTAN")] == ["AF", "AL", "DZ", "KH", "CU", "BT"]
    assert one(spark, adapt.is_name_token(F.lit("AFG"))) is False


def test_label_keywords_in_the_order_of_the_whole_table(spark):
    assert len(adapt.LABEL_KEYWORDS) == 117
    texts = ["National ID", "Given Names", "PRENOM", "Date d'expiration", "the der", "Adresse", None]
    keyword, field = adapt.label_keyword(F.col("t"))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", keyword.alias("k"), field.alias("f")).collect()
    low = lambda t: next(((k, f) for k, f in adapt.LABEL_KEYWORDS.items() if k in t.lower()), (None, None)) if t else (None, None)
    assert [(r["k"], r["f"]) for r in got] == [low(t) for t in texts]
    assert got[0]["f"] == "id_number" and got[3]["f"] == "date_of_expiry" and got[4]["k"] is None
