"""Layout repair, engines' layouts and adapted records on written-out pages."""

import json

from pyspark.sql import functions as F

from docassay.functions.adapt import adapt_record
from docassay.functions.repair import repair_layout
from docassay.functions.wrappers import flatten_result
from docassay.operators import layout

CARD = {"ELAMISLUBA": "PS98765432", "ANANYA": "KODAKONDSUS / CITIZENSHIP SUNNIAEG / DATE OF BIRTH", "07": "1995", "KEHTIV KUNI / CARD EXPIRY": "2029", "Sharma": "876543"}
CARD_TEXTS = (
    "ELAMISLUBA|0\"|EST|PEREKONNANIMI Eesnimi|SURNAME Forename|SHARMA|ANANYA|SUGU / SEX|IND|14|07|N / F|LOA LIIK|TYPE OF PERMIT|KEHTIV KUNI / CARD EXPIRY|PIKAAJALINE|ELANIK|EU|06|20|REMARKS|MARKUSED|LONG|RESIDENT|TERM|EC|TOOTADA|LUBATUD|Sharma|RESIDENCE PERMIT"
).split("|")
CARD_FIELDS = {"permit_number": "PS98765432", "sharma": "876543", "surname": "SHARMA", "given_name": "ANANYA", "nationality": "IND", "gender": "N / F", "permit_type": "PIKAAJALINE", "date_of_birth": "1995-07-14", "date_of_expiry": "2029-06-20"}

#: (pairs, unpaired texts, repaired fields), each followed by hand.
PAGES = [
    (CARD, CARD_TEXTS, CARD_FIELDS),
    ({}, [], {}),
    (None, None, {}),
    ({"colour": " blue ", "Zip": None, "x": "DOB"}, ["", "  "], {"colour": "blue"}),  # a heading is no value
    ({"Colour": "a", "colour ": "b"}, [], {"colour": "b"}),  # of plain pairs the last stays
    ({"surname": "A", "Last Name": "B"}, [], {"surname": "A"}),  # of labels the first
    ({"Forename": "A", "given_name": "B"}, [], {"given_name": "B"}),  # a plain pair takes the place of a label's
    ({"ab 123 4567": None}, [], {"permit_number": "AB 123 4567"}),
    ({"AB1234567": "x", "123456789": "y"}, [], {"permit_number": "AB1234567"}),
    # Labels in a run take the same text.
    ({}, ["SURNAME", "GIVEN NAME", "LEE", "KIM"], {"surname": "LEE", "given_name": "LEE"}),
    ({}, ["NATIONALITY", "EU", "REMARKS", "DEU", "IND"], {"nationality": "DEU"}),
    ({}, ["nationality", "Germany", "IND"], {"nationality": "IND", "surname": "Germany"}),  # too long for a code; the lone code counts
    ({}, ["Nationality", "UN", "EST"], {"gender": None}),
    ({}, ["Sex", "Address", "M"], {"gender": "M", "address": "M"}),
    ({}, ["Sex", "LUBATUD", "12", "K1", "x"], {"gender": "X"}),  # further on, as no label stands between
    ({}, ["m / h", "F"], {"gender": "M / H"}),
    ({}, ["F", "m / h"], {"gender": "F"}),
    ({}, ["FR", "EU", "de"], {"issuing_country": "FR", "given_name": None, "surname": "de"}),
    ({}, ["LONG", "TERM", "resident", "EU", "ANN"], {"permit_type": "LONG TERM RESIDENT EU", "surname": "ANN"}),
    ({}, ["PEREKONNANIMI Eesnimi", "12", "LEE"], {"surname": "LEE"}),  # the text behind the label is no name
    ({}, ["NACHNAME VORNAME", "EC", "LEE", "SURNAME", "ANN", "BOB"], {"surname": "LEE", "given_name": "ANN"}),
    ({}, ["Ann", "Ind", "Visa"], {"surname": "Ann", "nationality": "IND"}),
    ({"KIM": "Perekonnanimi", "LEE": "kehtiv kuni"}, [], {"surname": "KIM", "given_name": "LEE"}),
    ({"KIM": "Perekonnanimi"}, ["KIM"], {"surname": "KIM"}),
    ({}, ["14", "25", "2031", "1990"], {"date_of_expiry": "2031-25-14"}),
    ({}, ["06", "20", "2031"], {"date_of_expiry": "2031-06-20"}),
    ({}, ["20", "06", "2031"], {"date_of_expiry": "2031-06-20"}),
    ({}, ["20", "2031"], {"date_of_expiry": "2031"}),
    ({"card expiry": "01.02.2030"}, ["1990", "11", "12"], {"date_of_expiry": "01.02.2030", "date_of_birth": "1990-12-11"}),
    ({"12": "1988", "Card valid from": "06.07.2031"}, ["30"], {"card valid from": "06.07.2031", "date_of_birth": "1988-12-30", "date_of_expiry": "06.07.2031"}),
    ({"12": "88"}, ["30", "11"], {}),
    ({}, ["Date of Birth", "REMARKS", "on 3.4.1990", "valid until", "soon"], {"date_of_birth": "on 3.4.1990", "surname": "soon"}),
    ({}, ["permit number", "ANN"], {"permit_number": "ANN", "surname": "ANN"}),
    ({}, ["id no", "77-1", "isikukood", "88"], {"id_number": "77-1"}),
]


def test_pages(spark):
    rows = [(i, None if f is None else list(f), None if f is None else list(f.values()), t) for i, (f, t, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "i int, keys array<string>, vals array<string>, unpaired array<string>").withColumn("fields", F.map_from_arrays("keys", "vals"))
    got = {r["i"]: r["repaired"] for r in repair_layout(df.withColumn("a.b", F.lit(1))).collect()}
    for i, (pairs, texts, expected) in enumerate(PAGES):
        assert got[i] == {k: v for k, v in expected.items() if v is not None}, (pairs, texts)


def test_recorded_card_through_all_steps(spark):
    raw = {"document_type": "PERMIT", "status": "OCR COMPLETED", "ocr_confidence": 94.03, "fields": {k: {"value": v, "confidence": 0.9} for k, v in CARD.items()}, "unpaired_text": [{"text": t} for t in CARD_TEXTS]}
    df = spark.createDataFrame([("permit", json.dumps(raw))], "kind string, raw string").select(flatten_result(F.col("kind"), F.col("raw")).alias("result"))
    df = repair_layout(df.withColumn("fields", F.col("result.fields")).withColumn("unpaired", F.col("result.unpaired")))
    row = adapt_record(df, "result", "repaired").first()
    assert list(row["result"]["fields"]) and row["adapted"] == {
        "permit_number": "PS98765432", "surname": "SHARMA", "given_name": "ANANYA", "name": "ANANYA SHARMA", "nationality": "IN", "gender": "F", "permit_type": "PIKAAJALINE", "date_of_birth": "1995-07-14", "date_of_expiry": "2029-06-20",
    }
    assert (row["document_type"], row["document_country"], row["ocr_confidence"], row["status"]) == ("permit", "IN", 94.03, "OCR COMPLETED")


def test_engines(spark):
    rows = [
        ("national_id", {"fields": {"b": {"value": "1"}, "a": 2, "c": {"confidence": 1}, "d": None, "e": ["DOB", "x"]}, "unpaired_text": [{"text": "t"}, {"other": 1}]}),
        ("driving_license", {"fields": {"name": {"value": None}, "x": {"value": 5}}, "ocr_confidence": "12.5", "unpaired_text": [{"text": "t"}]}),
        ("aadhaar", {"document_type": "T", "status": "S", "reason": "R", "ocr_confidence": 3, "format_valid": True, "n": None}),
        ("visa", {"fields": {"surname": "A", "dates": []}, "mrz": {"valid": False, "raw_line3": "L"}, "matches": 0}),
        ("passport", {"sex": "M"}),
        ("passport", {}),
        ("permit", None),
        ("permit", [1]),
        ("other", {"status": "S"}),
        (None, {"fields": {"a": 1}}),
    ]
    df = spark.createDataFrame([(i, k, None if v is None else json.dumps(v)) for i, (k, v) in enumerate(rows)] + [(10, "visa", '{"fields":'), (11, "permit", '{"a":1,"a":2}'), (12, "permit", "")], "i int, kind string, raw string")
    shown = F.expr("transform(map_entries(r.fields), e -> concat(e.key, '=', coalesce(e.value, '-')))")
    got = {r["i"]: r for r in df.select("i", flatten_result(F.col("kind"), F.col("raw")).alias("r")).withColumn("shown", shown).collect()}
    assert got[0]["shown"] == ["b=1", "a=2", "c=-", "d=-", "e=x"] and got[0]["r"]["unpaired"] == ["t", None]  # keys in the text's order
    assert got[1]["shown"] == ["name=-", "x=5"] and got[1]["r"]["unpaired"] == [] and got[1]["r"]["ocr_confidence"] == 12.5
    assert got[2]["shown"] == ["format_valid=true", "n=-"] and got[2]["r"]["document_type"] == "T"
    assert got[3]["r"]["extracted"] == {"surname": "A", "dates": None} and got[3]["r"]["mrz"] == {"valid": "false", "raw_line3": "L"}
    assert got[4]["r"]["ocr_confidence"] == 100.0 and got[5]["r"]["status"] == "CLEARER IMAGE REQUIRED"
    assert all(got[i]["r"]["status"] == "ERROR" and got[i]["shown"] == [] for i in (6, 7, 10, 11, 12))
    assert got[8]["r"]["document_type"] == "UNKNOWN" and got[9]["shown"] == []


def test_precedence_and_empty_records(spark):
    rows = [
        ("visa", {"fields": {"sex": "F", "surname": "VIS"}, "mrz": {"sex": "M", "surname": "MRZ", "nationality": "IND", "raw_line1": "P<", "raw_line2": "", "valid": True}}),
        ("national_id", {"fields": {"SURNAME": {"value": "Flat"}, "last_name": {"value": "Later"}}, "unpaired_text": [{"text": "Given Name"}, {"text": "ANN"}]}),
        ("driving_license", {"fields": {"license_number": {"value": "DL12X"}, "name": {"value": "ann lee"}}}),
        ("passport", {"name": "LEE", "surname": "lee", "sex": "1"}),
        ("permit", None),
    ]
    df = spark.createDataFrame([(i, k, None if v is None else json.dumps(v)) for i, (k, v) in enumerate(rows)], "i int, kind string, raw string").select("i", flatten_result(F.col("kind"), F.col("raw")).alias("result"))
    df = repair_layout(df.withColumn("fields", F.col("result.fields")).withColumn("unpaired", F.col("result.unpaired")))
    got = {r["i"]: r for r in adapt_record(df, "result", "repaired").collect()}
    assert got[0]["adapted"] == {"gender": "F", "surname": "VIS", "name": "VIS", "nationality": "IN", "mrz_line1": "P<"}
    assert got[1]["adapted"] == {"surname": "Flat", "given_name": "ANN", "name": "ANN Flat"}
    assert got[2]["adapted"] == {"license_number": "DL12X", "name": "ann lee"} and got[2]["document_country"] == "IN"
    assert got[3]["adapted"] == {"name": "lee", "surname": "lee", "gender": "M"}  # surname and name are one
    assert got[4]["adapted"] == {} and got[4]["document_type"] == "permit"
    assert adapt_record(df.limit(0), "result", "repaired").count() == 0


def test_next_value(spark):
    rows = [(1, 1, "L", True), (1, 2, "L", True), (1, 3, "a", False), (1, 4, "L", True), (2, 1, "b", None), (2, 0, "L", True), (None, 1, "L", True)]
    df = spark.createDataFrame(rows, "doc_id int, ord int, text string, lab boolean")
    got = {(r["doc_id"], r["ord"]): r["value"] for r in layout.next_value(df, F.col("lab")).collect()}
    assert got == {(1, 1): "a", (1, 2): "a", (1, 4): None, (2, 0): "b", (None, 1): None}
    assert layout.next_value(df.limit(0), F.col("lab")).count() == 0


def test_licence_quality(spark):
    tokens = spark.createDataFrame([(1, 0.36)] * 3 + [(2, 0.9)] * 2 + [(2, 0.1)], "doc_id int, confidence double")
    got = {r["doc_id"]: (r["clear"], r["readable"]) for r in layout.image_quality(tokens, tokens.select("doc_id").union(spark.createDataFrame([(3,)], "doc_id int")), layout.LICENSE_QUALITY).collect()}
    assert got == {1: (True, 3), 2: (False, 2), 3: (False, 0)}
