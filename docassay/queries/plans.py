"""Queries over requests that may fail, rules that are data, a remote registry, audit batches and image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.config import SPEC_ROWS, types_of
from docassay.functions.dates import MONTH_NAMES, free_date
from docassay.operators import lookup, rules, synth
from docassay.plans.validate import read_requests, validate, validate_mixed
from docassay.queries.validation import AS_OF, letters, mixed_scans, table
from docassay.sources import io
from docassay.sources.registry_api import RegistryApi

#: A request as JSON; every ninth is cut off, in every ninth the fields are no object. In SQL that both engines read.
PAYLOAD = """case o_orderkey % 9 when 4 then '{"document_type":"passport","fields":{"name":' when 5 then '{"document_type":"passport","fields":["name"]}' else
    concat('{"document_type":"passport","ocr_confidence":90,"fields":{"passport_number":"', passport_number, '","name":"', name, '","nationality":"IND","date_of_birth":"1980-02-03","date_of_expiry":"2005-06-07","gender":"M"',
        case o_orderkey % 4 when 0 then ',"visits":2' when 1 then ',"visits":"9"' when 2 then ',"visits":"many"' else '' end, '}}') end"""


def _visits(fields, record):
    n = F.coalesce(fields["visits"], F.lit("0")).try_cast("int")
    warning = rules.finding("VISITS", "WARNING", "LOW", F.concat(F.lit("Seen "), n.cast("string"), F.lit(" times.")), "visits")
    return F.when(n > 3, F.array(warning)).when(n <= 3, F.array().cast(f"array<{rules.FINDING}>"))


def _house(fields: dict, record: dict | None) -> list[dict]:
    if fields["name"].endswith("A"):
        raise ValueError("odd name")
    return [] if record else [{"rule": "HOUSE", "status": "FAIL", "severity": "LOW", "message": "Not one of ours."}]


def verdict_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as JSON, some of which can't be read, with two rules of our own that fail on some rows."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("P%07d", "o_custkey").alias("passport_number"), F.concat(F.lit("Holder "), letters(F.col("o_custkey"))).alias("name"))
    requests = read_requests(rows.select(F.col("o_orderkey").cast("string").alias("request_id"), F.expr(PAYLOAD).alias("payload")))
    known = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.format_string("P%07d", "c_custkey").alias("passport_number"), F.lit("ACTIVE").alias("status"))
    out = validate(requests, known, "passport", AS_OF, unique_registry=True, extra=[rules.column_rule("VISITS", _visits), rules.python_rule("HOUSE", _house)])
    return out.select("request_id", "validation_status", "validation_score", "recommendation", "source_status", "document_status", F.size("checks").alias("n_checks"), F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


#: A document type that no code knows, as rows of SPEC_ROWS.
LOAN_CARD = [
    ("Loan Card", 1, "card_number", True, True, "identifier", "^C[0-9]{6}$", None, None),
    ("Loan Card", 2, "name", False, True, "string", None, None, None),
    ("Loan Card", 3, "colour", False, False, "enum", None, ["RED", "BLUE"], None),
    ("Loan Card", 4, "opened", False, False, "date", None, None, "due"),
    ("Loan Card", 5, "due", False, False, "date", None, None, None),
]


def verdict_by_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cards of a type that a table describes, every fourth of a type that nothing describes."""
    types = types_of(spark.createDataFrame(LOAN_CARD, SPEC_ROWS))
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    values = {
        "card_number": F.when(k % 6 == 0, "X1").otherwise(F.format_string("c-%06d", "o_custkey")),
        "name": F.when(k % 5 != 0, "Ann"),
        "colour": F.get(F.array(F.lit("red"), F.lit(" green "), F.lit(None)), (k % 3).cast("int")),
        "opened": F.date_format(day, "yyyy/MM/dd"),
        "due": F.when(k % 7 == 0, "soon").otherwise(F.date_format(F.date_add(day, ((k % 11) - 5).cast("int")), "yyyy-MM-dd")),
    }
    pairs = F.map_from_arrays(F.array(*[F.lit(f) for f in values]), F.array(*values.values()))
    cards = table(spark, sf_dir, "orders").select(k.cast("string").alias("request_id"), F.when(k % 4 == 0, "Tram Ticket").otherwise("loan card").alias("document_type"), F.lit(90.0).alias("ocr_confidence"), pairs.alias("fields"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.format_string("C%06d", "c_custkey").alias("card_number"), F.lit("ACTIVE").alias("status"))
    out = validate_mixed(cards, {"loan_card": known}, AS_OF, types=types)
    return out.select("request_id", "document_type", "validation_score", "validation_status", "database_match", F.array_join(F.transform("mismatches", lambda m: m["type"]), ",").alias("mismatches"))


def api_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a remote registry, asked by ranges of keys through a data source; every second answer comes at the second attempt."""
    k, customer = F.col("c_custkey"), table(spark, sf_dir, "customer")
    folder = f"{io.scratch_dir(spark)}/answers"
    answers = customer.where("c_custkey % 5 <> 0").select(F.format_string("C%09d", k).alias("key"), F.when(k % 3 == 0, 200).when(k % 3 == 1, 404).alias("http_status"), F.to_json(F.struct("c_name", "c_nationkey")).alias("record"), (k % 2).alias("fails"))
    answers.write.json(folder)
    ends = customer.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    spark.dataSource.register(RegistryApi)
    reader = spark.read.format("registry_api").option("base", folder).option("api_key", "k").option("doc_type", "customer").option("prefix", "C").option("width", 9)
    asked = reader.option("low", ends[0] or 0).option("high", (ends[1] or -1) + 1).option("attempts", 2).option("pause", 0).load()
    joined = lookup.api_lookup(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("n")), asked.select("n", "http_status", "record"), "n")
    return joined.select("o_orderkey", F.get_json_object("record", "$.c_name").alias("name"), "source_status")


def audit_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed log written as two batches, one of them twice; the passports of the finished ones."""
    key = F.col("request_id").cast("long")
    scans = mixed_scans(spark, sf_dir).select(F.col("request_id").alias("id"), F.lit("o1").alias("officer_id"), "document_type", F.when(key % 2 == 0, "IN").alias("document_country"), "ocr_confidence", "fields")
    path = io.scratch_dir(spark)
    for batch in ("b1", "b2", "b1"):
        io.write_audit(scans.where(F.col("id").cast("long") % 2 == int(batch == "b2")), path, batch)
    return io.read_audit(spark, path, "ocr_passports").select("scan_log_id", "passport_number", "name", "country", "batch")


def image_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as image files, every seventh of which is not there: formats by content, and the reasons of rejects."""
    k = F.col("c_custkey")
    head = F.get(F.array(*[F.lit(x) for x in ("FFD8FFE000104A46", "89504E470D0A1A0A0000", "52494646AABBCCDD574542505650", "49492A0008", "")]), (k % 6).cast("int"))
    content = F.when(k % 6 == 5, F.col("c_name").cast("binary")).otherwise(F.unhex(head))
    path = F.concat(F.lit("img/"), k.cast("string"), F.lit(".png"))
    files = table(spark, sf_dir, "customer").select(k, path.alias("path"), content.alias("content"))
    good, bad = io.check_images(files.select("path"), files.where("c_custkey % 7 <> 0"))
    return good.select("path", "format", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("path", F.lit(None).cast("string").alias("format"), "reason"))


#: Dates as people write them, in SQL that both engines read; y, m, d are numbers of a day, n its month's name.
WRITTEN = ("concat(cast(d as string), ' ', n, ' ', cast(y as string))", "concat(n, ' ', cast(d as string), ', ', cast(y as string))", "concat(cast(d as string), '-', substring(n, 1, 3), '-', cast(y as string))", "concat(cast(y as string), ' ', n, ' ', cast(d as string))", "concat('on ', n, ' ', cast(y as string))", "cast(y as string)", "concat(cast(d as string), 'th of ', n)", "concat('the ', n)", "concat(cast(y as string), '.', cast(m as string), '.', cast(d as string))")


def free_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of orders, written out in nine ways."""
    day = F.col("o_orderdate").cast("date")
    parts = table(spark, sf_dir, "orders").select("o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.day(day).alias("d"), F.get(F.array(*[F.lit(n.capitalize()) for n in MONTH_NAMES]), F.month(day) - 1).alias("n"))
    text = F.expr("case o_orderkey % 9 " + " ".join(f"when {i} then {w}" for i, w in enumerate(WRITTEN)) + " end")
    return parts.select("o_orderkey", free_date(text, AS_OF).alias("iso"))


def synth_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visa and a licence for every customer, all their columns drawn by key."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    visas, licences = synth.registry_of(keys, "visa"), synth.registry_of(keys, "driving_license")
    own = licences.select("id", "license_number", F.col("date_of_expiry").alias("licence_expiry"), "blood_group", "relation")
    return visas.join(own, "id")


FUNCTIONS = (free_dates, synth_registry, verdict_errors, verdict_by_spec, api_source, audit_batches, image_check)

_DRAW = lambda salt, n: f"(((id * {7919 + 2 * salt} + {104_729 * salt}) % 1000003 // 7) % {n})"
_PICK = lambda salt, values: f"list_value({', '.join(repr(v) for v in values)})[{_DRAW(salt, len(values))} + 1]"

SQL = {
    "synth_registry": f"""
        with c as (select c_custkey as id, (c_custkey * 37 + 11) % 100 as u from customer),
        s as (select *, case when u < 70 then 'ACTIVE' when u < 80 then 'EXPIRED' when u < 85 then 'REVOKED' when u < 90 then 'BLACKLISTED' when u < 95 then 'SUSPENDED' else 'LOST' end as status, {_PICK(2, synth.LAST_NAMES)} as last from c)
        select id, printf('V%08d', id) as visa_number, printf('P%07d', {_DRAW(6, 10_000)} + 1) as passport_number, {_PICK(1, synth.FIRST_NAMES)} || ' ' || last as name, {_PICK(4, synth.NATIONALITIES)} as nationality,
               {_PICK(19, synth.VISA_TYPES)} as visa_type, printf('%04d-%02d-%02d', 1965 + {_DRAW(7, 39)}, 1 + {_DRAW(8, 12)}, 1 + {_DRAW(9, 28)}) as date_of_birth, '2023-01-15' as date_of_issue,
               case when status = 'EXPIRED' then '2024-01-14' else '2030-01-14' end as date_of_expiry, {_PICK(5, synth.SEXES)} as gender, status,
               printf('DL%010d', id) as license_number, case when status = 'EXPIRED' then '2020-05-09' else '2035-05-09' end as licence_expiry, {_PICK(20, synth.BLOOD_GROUPS)} as blood_group, 'S/O ' || {_PICK(3, synth.FIRST_NAMES)} || ' ' || last as relation
        from s""",
    "free_dates": """
        with o as (select o_orderkey, o_orderkey % 9 as i, o_orderdate::date as t from orders),
        p as (select *, case i when 4 then make_date(year(t), month(t), 1) when 5 then make_date(year(t), 6, 30) when 6 then make_date(1999, month(t), case when day(t) = 29 and month(t) = 2 then 28 else day(t) end) else t end as shown from o)
        select o_orderkey, case when i = 7 or (i = 6 and day(t) = 29 and month(t) = 2) or (month(t) = 10 and i not in (5, 8)) then null  -- the O of October is read as a zero
               when i = 4 then strftime(least(shown + 29, last_day(shown)), '%Y-%m-%d') else strftime(shown, '%Y-%m-%d') end as iso from p""",
    "verdict_errors": """
        with o as (select o_orderkey as k, o_custkey as c, o_orderkey % 9 in (4, 5) as bad, o_custkey % 5 = 0 or c_custkey is null as lost from orders left join customer on o_custkey = c_custkey),
        s as (select *, 100.0 - case when lost then 30 else 0 end - case when k % 4 = 1 then 3.5 else 0 end - case when lost and c % 10 <> 0 then 3.5 else 0 end as score from o)
        select k::varchar as request_id, case when bad then 'ERROR' when score >= 80 then 'PASS' when score >= 50 then 'MANUAL_REVIEW' else 'FAIL' end as validation_status,
               case when bad then 0.0 else score end::double as validation_score, case when bad then 'FAIL' when score >= 80 then 'PASS' when score >= 50 then 'MANUAL_REVIEW' else 'FAIL' end as recommendation,
               case when bad then 'error' when lost then 'not_found' else 'active' end as source_status, case when bad then 'UNKNOWN' when lost then 'NOT_FOUND' else 'ACTIVE' end as document_status,
               (case when bad then 1 else 9 + (k % 4 = 1)::int + (lost and c % 10 <> 0)::int end)::int as n_checks,
               case when bad then 'The record''s fields can''t be read.' else concat_ws('; ', case when k % 4 = 2 then 'Error executing rule VISITS' end, case when c % 10 = 0 then 'Error executing rule HOUSE: ValueError: odd name' end) end as errors,
               case when not bad and k % 4 = 1 then 'Seen 9 times.' else '' end as warnings
        from s""",
    "verdict_by_spec": """
        with o as (select o_orderkey as k, o_custkey as c, o_orderkey % 4 = 0 as tram, o_orderkey % 6 = 0 or o_custkey % 4 = 0 or c_custkey is null as lost from orders left join customer on o_custkey = c_custkey),
        m as (
            select *, case when tram then ['MISSING_REQUIRED_FIELD'] else [] end || case when k % 5 = 0 then ['MISSING_REQUIRED_FIELD'] else [] end
                || case when not tram and k % 6 = 0 then ['FORMAT_MISMATCH'] else [] end || case when not tram and k % 7 = 0 then ['INVALID_DATE_TYPE'] else [] end
                || case when not tram and k % 3 = 1 then ['ENUM_OUT_OF_RANGE'] else [] end || case when not tram and k % 7 <> 0 and k % 11 < 5 then ['CROSS_FIELD_MISMATCH'] else [] end
                || case when tram or lost then ['DATABASE_NOT_FOUND'] else [] end as found
            from o),
        s as (select *, greatest(0.0, 100.0 - list_sum([case x when 'MISSING_REQUIRED_FIELD' then 24 when 'FORMAT_MISMATCH' then 18 when 'CROSS_FIELD_MISMATCH' then 36 when 'DATABASE_NOT_FOUND' then 30 else 10 end for x in found || ['-']]) + 10) as score from m)
        select k::varchar as request_id, case when tram then 'Tram Ticket' else 'loan card' end as document_type, score::double as validation_score,
               case when score >= 80 then 'PASS' when score >= 50 then 'MANUAL_REVIEW' else 'FAIL' end as validation_status, not tram and not lost as database_match, coalesce(array_to_string(found, ','), '') as mismatches
        from s""",
    "api_source": """select o_orderkey, case when c_custkey % 5 <> 0 and c_custkey % 3 = 0 then c_name end as name,
            case when c_custkey is null or c_custkey % 5 = 0 or c_custkey % 3 = 2 then 'api_connection_failed' when c_custkey % 3 = 0 then 'official_government_source' else 'gov_api_status_404' end as source_status
        from orders left join customer on o_custkey = c_custkey""",
    "audit_batches": """select o_orderkey::varchar as scan_log_id, printf('%012d', o_custkey) as passport_number, case when o_orderkey % 5 <> 0 then 'Ann Lee' end as name, case when o_orderkey % 2 = 0 then 'IN' end as country,
            case when o_orderkey % 2 = 0 then 'b1' else 'b2' end as batch from orders where o_orderkey % 7 = 0""",
    "image_check": """with c as (select c_custkey as k, 'img/' || c_custkey || '.png' as path from customer)
        select path, case when k % 7 <> 0 and k % 6 < 4 then ['jpeg', 'png', 'webp', 'tiff'][k % 6 + 1] end as format,
               case when k % 7 = 0 then 'Image not found: ' || path when k % 6 = 4 then 'Image is empty: ' || path when k % 6 = 5 then 'Unable to read image: ' || path end as reason from c""",
}
