"""The remote registry, catalog tables, audit batches, image checks, types as data and rules that fail."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from docassay import config
from docassay.operators import lookup, rules
from docassay.plans.validate import read_requests, validate
from docassay.queries.validation import AS_OF
from docassay.sources import io, tables
from docassay.sources.registry_api import AGAIN, NarrowingReader, RegistryApi, RegistryReader
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

SCANS = "id string, officer_id string, document_type string, document_country string, ocr_confidence double, fields map<string,string>"


def read_api(spark, **options):
    spark.dataSource.register(RegistryApi)
    reader = spark.read.format("registry_api")
    for k, v in {"pause": 0, "prefix": "P", "width": 3, "doc_type": "passport", **options}.items():
        reader = reader.option(k, v)
    return reader.load()


def test_recorded_registry(spark, tmp_path):
    (tmp_path / "r").mkdir()
    lines = [{"key": "P001", "http_status": 200, "record": {"name": "A"}}, {"key": "P002", "http_status": 404}, {"key": "P003", "http_status": 200, "record": "{}", "fails": 2}, {"key": "P004", "http_status": 200, "fails": 3}, {"key": "P005", "http_status": 503}, {"key": "P006", "http_status": None}]
    (tmp_path / "r" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r["n"]: (r["key"], r["http_status"], r["record"], r["attempts"]) for r in read_api(spark, base=str(tmp_path / "r"), api_key="k", low=1, high=8, partitions=3, attempts=3).collect()}
    assert got == {1: ("P001", 200, '{"name": "A"}', 1), 2: ("P002", 404, None, 1), 3: ("P003", 200, "{}", 3), 4: ("P004", None, None, 3), 5: ("P005", 503, None, 3), 6: ("P006", None, None, 3), 7: ("P007", None, None, 3)}
    answers = read_api(spark, base=str(tmp_path / "r"), api_key="k", low=1, high=4).select("n", "http_status", "record")
    status = {r["n"]: r["source_status"] for r in lookup.api_lookup(spark.range(1, 9).withColumnRenamed("id", "n"), answers, "n").collect()}
    assert status[1] == "official_government_source" and status[2] == "gov_api_status_404" and status[8] == "api_connection_failed"
    unasked = read_api(spark, low=1, high=3)
    assert {(r["http_status"], r["attempts"]) for r in unasked.collect()} == {(401, 0)}
    assert read_api(spark, base="x", api_key="k", low=5, high=5).count() == 0


def test_http_registry(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append((self.path, self.headers["Authorization"]))
            key = self.path.rpartition("=")[2]
            again = key == "P002" and sum(p.endswith("P002") for p, _ in asked) < 2
            self.send_response(503 if again else 404 if key == "P003" else 200)
            self.end_headers()
            self.wfile.write(b'{"ok":1}')

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    got = {r["n"]: (r["http_status"], r["record"], r["attempts"]) for r in read_api(spark, base=base, api_key="secret", low=1, high=4, partitions=2).collect()}
    server.shutdown()
    assert got == {1: (200, '{"ok":1}', 1), 2: (200, '{"ok":1}', 2), 3: (404, None, 1)}
    assert {a for _, a in asked} == {"Bearer secret"} and asked[0][0].startswith("/v1/verify?doc_type=passport&id=P")
    assert read_api(spark, base="http://127.0.0.1:9", api_key="k", low=1, high=2, attempts=2, timeout=1).first()["http_status"] is None


def test_ranges_and_filters(spark, tmp_path):
    reader = RegistryReader({"low": "10", "high": "21", "partitions": "4"})
    assert [(p.low, p.high) for p in reader.partitions()] == [(10, 12), (12, 15), (15, 18), (18, 21)]
    narrow = NarrowingReader({"low": "0", "high": "100"})
    left = [GreaterThan(("n",), 10), LessThanOrEqual(("n",), 20), EqualTo(("key",), "x")]
    assert list(narrow.pushFilters(left)) == left[2:] and (narrow.low, narrow.high) == (11, 21)
    assert list(NarrowingReader({"high": "3"}).pushFilters([EqualTo(("n",), 7)])) == [] and 503 in AGAIN
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        assert {r["n"] for r in read_api(spark, low=0, high=1_000_000_000, narrow="true").where("n >= 7 and n < 9").collect()} == {7, 8}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bucketed_registry_joins_without_exchange(spark):
    tables.create_tables(spark, "reg_test", buckets=4)
    made = tables.create_tables(spark, "reg_test", buckets=4)  # a second time changes nothing
    assert {"passports", "scan_logs", "ocr_permits", "officer_profiles"} <= set(made)
    rows = spark.range(200).select(F.format_string("P%07d", F.col("id") % 150).alias("passport_number"), F.lit("N").alias("name"), F.lit("IN").alias("nationality"), F.lit("1990-01-01").alias("date_of_birth"), F.lit("2030-01-01").alias("date_of_expiry"), F.when(F.col("id") != 7, "M").alias("gender"))
    try:
        table = tables.load_registry(rows, "passport", "reg_test")
        assert table.count() == 150 and tables.rejects(rows, "passport").count() == 1 and {r["status"] for r in table.collect()} == {"ACTIVE"}
        tables.load_registry(rows.withColumn("status", F.lit("LOST")), "passport", "reg_test")  # keys that are there stay
        assert {r["status"] for r in table.collect()} == {"ACTIVE"}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        scans = spark.range(300).select(F.format_string("P%07d", "id").alias("number"))
        found = lookup.registry_lookup(scans, spark.table("reg_test.passports"), F.col("number"), "passport_number")
        plan = found._jdf.queryExecution().executedPlan().toString()
        registry_side = plan[plan.index("SortMergeJoin") :].split("FileScan")[0]
        assert plan.count("Exchange hashpartitioning") == 1, plan  # the scans alone move
        assert "Bucketed: true" in plan and registry_side
        assert found.where("database_match").count() == 150
        assert {r["n"] for r in tables.audit_keys(spark, "reg_test").collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql("DROP DATABASE reg_test CASCADE")


class Killed(Exception):
    pass


def test_audit_batch_is_all_or_none(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "audit")
    rows = [("1", "o", "Passport", "IN", 91.239, {"passport_number": "P1", "odd": "x"}), ("2", "o", "visa", None, 1.0, {"country": "FR"}), ("3", "o", "other", None, 1.0, {})]
    scans = spark.createDataFrame(rows, SCANS)
    real, seen = io.child_rows, []

    def dying(df, type_name):
        seen.append(type_name)
        if len(seen) == 3:
            raise Killed
        return real(df, type_name)

    monkeypatch.setattr(io, "child_rows", dying)
    with pytest.raises(Killed):  # between the log and the last child
        io.write_audit(scans, path, "b1")
    assert io.finished_batches(spark, path) == [] and io.read_audit(spark, path, "scan_logs", SCANS).count() == 0
    monkeypatch.setattr(io, "child_rows", real)
    io.write_audit(scans, path, "b1")
    io.write_audit(scans.limit(0), path, "b1")  # finished: nothing changes
    io.write_audit(scans.limit(0), path, "empty")
    log = io.read_audit(spark, path, "scan_logs")
    assert log.count() == 3 and {r["ocr_confidence"] for r in log.collect()} == {91.24, 1.0} and {r["batch"] for r in log.collect()} == {"b1"}
    assert io.read_audit(spark, path, "ocr_passports").first()["country"] == "IN" and io.read_audit(spark, path, "ocr_visas").first()["country"] == "FR"
    io.drop_batch(spark, path, "b1")
    assert io.finished_batches(spark, path) == ["empty"] and io.read_audit(spark, path, "scan_logs").count() == 0
    with pytest.raises(ValueError):
        io.write_audit(scans, path, "../x")


def test_images(spark, tmp_path):
    heads = {"a.png": b"\x89PNG\r\n\x1a\n..", "b.jpg": b"\xff\xd8\xff", "c.webp": b"RIFF1234WEBPVP8", "d.bmp": b"BM1", "e.tiff": b"MM\x00*", "f.png": b"", "g.png": b"RIFF1234WAVE", "h.jpg": b"\xff\xd8"}
    for name, data in heads.items():
        (tmp_path / name).write_bytes(data)
    files = io.read_uploads(spark, str(tmp_path))
    files = files.select("path", "content").unionByName(spark.createDataFrame([("f.png", bytearray())], "path string, content binary"))
    wanted = files.select("path").unionByName(spark.createDataFrame([("file:/nowhere.png",), (None,)], "path string"))
    good, bad = io.check_images(wanted, files)
    assert {r["path"].rpartition("/")[2]: r["format"] for r in good.collect()} == {"a.png": "png", "b.jpg": "jpeg", "c.webp": "webp", "d.bmp": "bmp", "e.tiff": "tiff"}
    reasons = {(r["path"] or "").rpartition("/")[2]: (r["reason"] or "").split(":")[0] for r in bad.collect()}
    assert reasons["f.png"] == "Image is empty" and reasons["g.png"] == reasons["h.jpg"] == "Unable to read image" and reasons["nowhere.png"] == "Image not found"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(io.object_path(F.lit("u1"), F.lit(17.9), F.lit("my é/file (1).png"))) == "u1/17_my_é_file__1_.png"
    assert one(io.object_path(F.lit("u1"), F.lit(17), F.lit("x"), F.lit(False))) is None and one(io.object_path(F.lit(None).cast("string"), F.lit(17), F.lit("x"))) is None


def test_types_from_files(spark, tmp_path):
    good = {"document_type": "Loan Card", "identifier_field": "card", "fields": {"z": {"required": True, "type": "string"}, "card": {"required": True, "type": "identifier", "pattern": "^C\\d$"}, "due": {"type": "date"}, "kind": {"type": "enum", "allowed": ["A"]}}, "cross_field_rules": [{"rule": "date_before", "field_a": "opened", "field_b": "due"}, {"rule": "not_future_date", "field": "due"}]}
    (tmp_path / "loan.json").write_text(json.dumps(good, indent=1))
    types = config.read_types(spark, str(tmp_path))
    assert types == {"loan_card": config.DocumentType("card", ("z", "card"), {"card": "^C\\d$"}, {"kind": ("A",)}, ("due",), (("opened", "due"),))}
    assert config.document_type(" LOAN card", types).identifier == "card" and config.document_type("passport", types) == config.FALLBACK
    scans = spark.createDataFrame([("1", 90.0, {"card": "c-1", "z": "x", "opened": "2020-02-02", "due": "2020-01-01"})], "request_id string, ocr_confidence double, fields map<string,string>")
    row = validate(scans, spark.createDataFrame([("C1", "ACTIVE")], "card string, status string"), "loan card", AS_OF, types=types).first()
    assert row["database_match"] and [m["type"] for m in row["mismatches"]] == ["CROSS_FIELD_MISMATCH"] and row["validation_score"] == 64.0
    (tmp_path / "bad.json").write_text('{"document_type": "x", ')
    with pytest.raises(ValueError, match="bad.json"):
        config.read_types(spark, str(tmp_path))
    spec = spark.createDataFrame([("T", None, "b", None, True, None, None, None, None), ("T", 1, "a", True, False, "date", None, None, "b")], config.SPEC_ROWS)
    assert config.types_of(spec) == {"t": config.DocumentType("a", ("b",), {}, {}, ("a",), (("a", "b"),))}
    assert config.types_of(spec.limit(0)) == {}


def test_unreadable_requests_and_failing_rules(spark):
    payloads = ['{"request_id":"a","document_type":"passport","fields":{"name":"ANN","age":3}}', '{"request_id":"b","fields":[1]}', "", None, "[1]", '{"request_id":"f","fields":{},"ocr_confidence":"70"}']
    requests = read_requests(spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string"))
    rows = {r["i"]: r for r in requests.collect()}
    assert rows[0]["fields"] == {"name": "ANN", "age": "3"} and rows[0]["ocr_confidence"] == 0.0 and rows[5]["ocr_confidence"] == 70.0
    assert all(rows[i]["fields"] is None for i in (1, 2, 3, 4))

    def judge(fields, record):
        if "name" not in fields:
            raise KeyError("name")
        return [{"rule": "MINE", "status": "FAIL", "severity": "CRITICAL", "message": "no", "mismatch": "MINE", "odd": 1}]

    registry = spark.createDataFrame([], "passport_number string, status string")
    extra = [rules.python_rule("MINE", judge), rules.column_rule("AGE", lambda f, r: F.when(f["age"].try_cast("int") >= 0, F.array().cast(f"array<{rules.FINDING}>")))]
    out = validate(requests.withColumn("request_id", F.col("i").cast("string")), registry, "passport", AS_OF, extra=extra)
    got = {int(r["request_id"]): r for r in out.collect()}
    assert got[0]["errors"] == [] and got[0]["mismatches"][-1]["type"] == "MINE"
    assert got[5]["errors"] == ["Error executing rule MINE: KeyError: 'name'", "Error executing rule AGE"] and got[5]["validation_status"] == "FAIL"
    for i in (1, 2, 3, 4):
        r = got[i]
        assert (r["validation_status"], r["validation_score"], r["recommendation"], r["source_status"], r["document_status"], r["data_source"]) == ("ERROR", 0.0, "FAIL", "error", "UNKNOWN", "none")
        assert [c["rule"] for c in r["checks"]] == ["VALIDATION_ENGINE"] and r["mismatches"] == [] and len(r["errors"]) == 1 and r["normalized_fields"] == {}
    assert validate(requests.limit(0), registry, "passport", AS_OF, extra=extra).count() == 0
    assert read_requests(requests.select("payload"), default_confidence=100.0).where("ocr_confidence = 100").count() == 5


def test_report_and_single_row(spark):
    scans = spark.createDataFrame([("r1", 90.0, {"passport_number": "P1234567", "name": "ANN", "nationality": "IND", "date_of_birth": "1980-02-03", "date_of_expiry": "2030-06-07", "gender": "F"})], "request_id string, ocr_confidence double, fields map<string,string>")
    known = spark.createDataFrame([("P1234567", "REVOKED")], "passport_number string, status string")
    text = io.report_text(validate(scans, known, "passport", AS_OF)).first()["report"].split("\n")
    assert text[0] == text[2] == text[-1] == "=" * 65 and text[1].strip() == "VALIDATION RESULT"
    assert "Request ID       : r1" in text and "Database Match   : YES" in text and "Validation Score : 52.0/100.0" in text and "Recommendation   : MANUAL_REVIEW" in text
    assert "  [PASS] REQUIRED_FIELDS           Required field 'name' is present." in text
    assert text[-2] == "  - Field 'status': Document is revoked (OCR: None | Ref: REVOKED)"
    assert io.report_text(validate(scans.limit(0), known, "passport", AS_OF)).count() == 0
    assert lookup.fetch_single(known) == {"passport_number": "P1234567", "status": "REVOKED"}
    with pytest.raises(LookupError, match="profile not found"):
        lookup.fetch_single(known.where("status = 'x'"), "profile")
    with pytest.raises(ValueError):
        lookup.fetch_single(known.unionAll(known))
