"""Queries over orders taken as scanned passports and customers taken as their registry."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.config import TYPES, document_type
from docassay.operators import lookup, rules, synth
from docassay.plans.validate import validate, validate_mixed
from docassay.sources import io

AS_OF = datetime.date(1999, 6, 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over as many parts as a shuffle has, where the scan has fewer: a narrow table of many rows is a small file, read by few tasks, and the work on each row is long."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def letters(key):
    return F.translate(key.cast("string"), "0123456789", "ABCDEFGHIJ")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    number = F.format_string("P%07d", F.when(k % 10 == 0, F.col("o_custkey") + 5_000_000).otherwise(F.col("o_custkey")))
    values = {
        "passport_number": number,
        "name": F.when(k % 7 == 0, "QQQQ").otherwise(F.concat(F.lit("Holder "), letters(F.col("o_custkey")))),
        "date_of_birth": iso(day),
        "date_of_issue": iso(F.date_add(day, 30)),
        "date_of_expiry": iso(F.date_add(day, ((k % 40) * 100 - 100).cast("int"))),
        "nationality": F.when(k % 11 != 0, "IND"),
        "gender": F.when(k % 3 == 0, "M").when(k % 3 == 1, "female").otherwise("x"),
    }
    pairs = F.map_from_arrays(F.array(*[F.lit(f) for f in values]), F.array(*values.values()))
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("request_id"), (k % 100).cast("double").alias("ocr_confidence"), pairs.alias("fields"), k.alias("k"), F.col("o_custkey").alias("c"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    status = F.when(c % 10 == 1, "BLACKLISTED").when(c % 10 == 2, "REVOKED").when(c % 10 == 3, "EXPIRED").when(c % 10 == 4, "LOST").otherwise("ACTIVE")
    return table(spark, sf_dir, "customer").where(c % 5 != 0).select(F.format_string("P%07d", c).alias("passport_number"), F.concat(F.lit("Holder "), letters(c)).alias("name"), status.alias("status"))


SCANS_SQL = """
    with s as (
        select o_orderkey as k, case when o_orderkey % 10 = 0 then o_custkey + 5000000 else o_custkey end as c, o_orderdate::date as birth,
               o_orderdate::date + 30 as issue, o_orderdate::date + ((o_orderkey % 40) * 100 - 100)::int as expiry, date '1999-06-30' as as_of
        from orders),
    r as (select c_custkey, case c_custkey % 10 when 1 then 'BLACKLISTED' when 2 then 'REVOKED' when 3 then 'EXPIRED' when 4 then 'LOST' else 'ACTIVE' end as status from customer where c_custkey % 5 <> 0),
    j as (select s.*, status, c_custkey is not null as matched from s left join r on c = c_custkey),
    v as (
        select *, greatest(0, 100.0 - (
            case when k % 11 = 0 then 24 else 0 end + case when k % 3 = 2 then 10 else 0 end
            + case when birth > as_of then 30 else 0 end + case when issue > as_of then 25 else 0 end + case when expiry <= issue then 30 else 0 end
            + case when birth > expiry then 36 else 0 end + case when not matched or k % 7 = 0 then 30 else 0 end
            + case status when 'BLACKLISTED' then 75 when 'REVOKED' then 48 when 'EXPIRED' then 30 else 0 end
            + case when k % 100 < 50 then 15 when k % 100 < 70 then 8 else 0 end)) as score
        from j)"""
RECOMMEND_SQL = "case when score >= 80 then 'PASS' when score >= 50 then 'MANUAL_REVIEW' else 'FAIL' end"


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate(scans(spark, sf_dir), registry(spark, sf_dir), "passport", AS_OF, unique_registry=True)
    return out.select("request_id", "validation_score", "validation_status", "database_match", "document_status", F.size("checks").alias("n_checks"), F.size("mismatches").alias("n_mismatches"))


VERDICT_SQL = f"""{SCANS_SQL}
    select k::varchar as request_id, score::double as validation_score, {RECOMMEND_SQL} as validation_status, matched as database_match,
           case when matched then status else 'NOT_FOUND' end as document_status,
           (7 + (k % 3 = 2)::int + greatest(1, (birth > as_of)::int + (issue > as_of)::int + (expiry <= issue)::int) + (birth > expiry)::int + case when matched then 2 else 1 end)::int as n_checks,
           ((k % 11 = 0)::int + (k % 3 = 2)::int + (birth > as_of)::int + (expiry <= issue)::int + (birth > expiry)::int + (not matched or k % 7 = 0)::int + coalesce(status in ('BLACKLISTED', 'REVOKED', 'EXPIRED'), false)::int)::int as n_mismatches
    from v"""


def recommendation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict(spark, sf_dir).groupBy("validation_status").agg(F.count("*").alias("n"), F.round(F.avg("validation_score"), 4).alias("mean_score"))


def _rule(name: str, build):
    """The findings of one rule, a row each."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        get = lambda f: F.col("fields")[f]
        found = scans(spark, sf_dir).select("request_id", F.explode(build(document_type("passport"), get)).alias("x"))
        return found.select("request_id", "x.rule", "x.status", "x.severity", "x.field", "x.mismatch")

    query.__name__ = name
    return query


rule_required = _rule("rule_required", lambda d, g: rules.required_fields(d, g))
rule_format = _rule("rule_format", lambda d, g: rules.formats(d, g, "passport"))
rule_type = _rule("rule_type", lambda d, g: rules.types(d, g))
rule_date = _rule("rule_date", lambda d, g: rules.dates(g, F.lit(AS_OF)))
rule_cross_field = _rule("rule_cross_field", lambda d, g: rules.cross_fields(d, g))

RULE_SQL = {
    "rule_required": f"""{SCANS_SQL} select k::varchar as request_id, 'REQUIRED_FIELDS' as rule, case when f = 'nationality' and k % 11 = 0 then 'FAIL' else 'PASS' end as status,
        case when f = 'nationality' and k % 11 = 0 then 'HIGH' else 'LOW' end as severity, f as field, case when f = 'nationality' and k % 11 = 0 then 'MISSING_REQUIRED_FIELD' end as mismatch
        from v, unnest(['name', 'passport_number', 'nationality', 'date_of_birth', 'date_of_expiry', 'gender']) as t(f)""",
    "rule_format": f"{SCANS_SQL} select k::varchar as request_id, 'FORMAT_VALIDATION' as rule, 'PASS' as status, 'LOW' as severity, 'passport_number' as field, null::varchar as mismatch from v",
    "rule_type": f"{SCANS_SQL} select k::varchar as request_id, 'TYPE_VALIDATION' as rule, 'FAIL' as status, 'MEDIUM' as severity, 'gender' as field, 'ENUM_OUT_OF_RANGE' as mismatch from v where k % 3 = 2",
    "rule_date": f"""{SCANS_SQL}, f as (
        select k, 'FAIL' as status, 'HIGH' as severity, 'date_of_birth' as field, 'FUTURE_DOB' as mismatch from v where birth > as_of
        union all select k, 'FAIL', 'MEDIUM', 'date_of_issue', null from v where issue > as_of
        union all select k, 'FAIL', 'HIGH', 'date_of_expiry', 'INVALID_EXPIRY_INTERVAL' from v where expiry <= issue
        union all select k, 'PASS', 'LOW', null, null from v where birth <= as_of and issue <= as_of and expiry > issue)
        select k::varchar as request_id, 'DATE_VALIDATION' as rule, status, severity, field, mismatch from f""",
    "rule_cross_field": f"{SCANS_SQL} select k::varchar as request_id, 'CROSS_FIELD_CONSISTENCY' as rule, 'FAIL' as status, 'HIGH' as severity, 'date_of_birth' as field, 'CROSS_FIELD_MISMATCH' as mismatch from v where birth > expiry",
}


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.registry_lookup(scans(spark, sf_dir), registry(spark, sf_dir), F.col("fields")["passport_number"], "passport_number", unique=True)


def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("request_id", "database_match", "data_source", "source_status", F.col("record.status").alias("status"))


def lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = scans(spark, sf_dir).select("request_id", F.col("fields")["passport_number"].alias("passport_number"))
    return lookup.require_known(keyed, registry(spark, sf_dir), "passport_number")[1].select("request_id")


def rule_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.database(document_type("passport"), lambda f: F.col("fields")[f], F.col("database_match"), {"name": F.col("record.name")})
    return _found(spark, sf_dir).select("request_id", F.explode(found).alias("x")).select("request_id", "x.rule", "x.status", "x.mismatch")


def rule_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.document_status(F.col("database_match"), F.col("record.status"))
    return _found(spark, sf_dir).select("request_id", F.explode(found).alias("x")).select("request_id", "x.status", "x.severity", "x.mismatch")


def hybrid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    first, second = customer.where("c_custkey % 3 = 0"), customer.where("c_custkey % 7 <> 0")
    return lookup.hybrid_lookup(orders.select("o_orderkey", "o_custkey"), first, second, "o_custkey", "c_custkey", "c_name")


def auth_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, users = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_custkey").distinct()
    state = F.when(F.col("o_custkey").isNull(), "MISSING").otherwise("OK")
    return customer.join(users, customer["c_custkey"] == users["o_custkey"], "left").select("c_custkey", state.alias("state"))


def count_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.counts({t: table(spark, sf_dir, t) for t in ("customer", "supplier", "part", "orders", "lineitem")})


def penalty_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("REQUIRED_FIELDS", "FORMAT_VALIDATION", "TYPE_VALIDATION", "DATE_VALIDATION", "CROSS_FIELD_CONSISTENCY", "DATABASE_LOOKUP", "DOCUMENT_STATUS")
    rule = F.get(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % 7).cast("int"))
    text = F.when(F.col("o_orderkey") % 5 == 0, "Name mismatch: OCR 'EXPIRED'").otherwise("plain")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.penalty_key(rule, text).alias("penalty"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    latest = lookup.latest_per_key(orders, ["o_custkey"], [F.col("o_orderkey").desc()])
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("long").alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice"))
    return lookup.upsert(target, latest.where("o_custkey % 2 = 0"), ["o_custkey"])


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return lookup.insert_ignore(customer.where("c_custkey % 3 = 0"), customer.where("c_custkey % 2 = 0"), ["c_custkey"])


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0")
    return lookup.delete_cascade(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), gone, "o_custkey", "c_custkey")


def foreign_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 6 <> 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


def child_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.fields_to_columns(scans(spark, sf_dir).select("request_id", "fields"), "fields", ("passport_number", "name", "nationality", "place_of_birth"))


def rls_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.row_security(table(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


def synth_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", synth.status(F.col("c_custkey")).alias("status"))


def mixed_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scans of six types and an unknown one; every fifth lacks its name, every third its expiry."""
    k, kinds = F.col("o_orderkey"), (*TYPES, "Space Permit")
    kind = F.get(F.array(*[F.lit(t) for t in kinds]), (k % len(kinds)).cast("int"))
    number = F.format_string("%012d", F.col("o_custkey"))
    values = {d.identifier: F.when(kind == t, number) for t, d in TYPES.items()} | {
        "name": F.when(k % 5 != 0, F.lit("Ann Lee")),
        "nationality": F.lit("IND"),
        "date_of_birth": F.lit("1980-02-03"),
        "date_of_issue": F.lit("1995-01-01"),
        "date_of_expiry": F.when(k % 3 != 0, F.lit("2005-06-07")),
        "gender": F.lit("F"),
    }
    pairs = F.map_from_arrays(F.array(*[F.lit(f) for f in values]), F.array(*values.values()))
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("request_id"), kind.alias("document_type"), F.lit(90.0).alias("ocr_confidence"), pairs.alias("fields"))


def verdict_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on a table of seven types against six registries, in one join."""
    number = F.format_string("%012d", F.col("c_custkey"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0")
    registries = {t: known.select(number.alias(d.identifier), F.lit("ANN LEE").alias("name"), F.when(F.col("c_custkey") % 7 == 0, "REVOKED").otherwise("ACTIVE").alias("status")) for t, d in TYPES.items()}
    out = validate_mixed(mixed_scans(spark, sf_dir), registries, AS_OF)
    return out.select("request_id", "document_type", "validation_score", "validation_status", "database_match", "source_status", "document_status", F.size("mismatches").alias("n_mismatches"))


def _officers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("officer_id"), F.lower(F.concat("s_name", F.lit("@x.org"))).alias("officer_email"))


def login_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    logins = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, "own@y.org").when(k % 3 == 1, "").alias("email"), F.when(k % 7 != 0, k.cast("string")).alias("officer_id"))
    return lookup.login_emails(logins, _officers(spark, sf_dir)).select("c_custkey", "resolved")


def officers_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.any_of(_officers(spark, sf_dir), officer_id="3", officer_email="supplier#000000005@x.org").select("officer_id")


def check_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.substring("c_name", 1, (k % 3).cast("int")).alias("first_name"), F.when(k % 4 != 0, k.cast("string")).alias("officer_id"), F.lit("").alias("email"), F.repeat(F.lit("p"), (k % 12).cast("int")).alias("password"))
    return lookup.check_inputs(rows).select("c_custkey", F.array_join("rejects", ",").alias("rejects"))


def api_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    answers = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(k.alias("o_custkey"), F.when(k % 3 == 0, 200).when(k % 3 == 1, 404).alias("http_status"), F.col("c_name").alias("record"))
    return lookup.api_lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), answers, "o_custkey").select("o_orderkey", "record", "source_status")


def alpha3_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.createDataFrame([("NATION_1", "One"), ("NATION_2", "Two"), ("NATION_2", "Two again")], "alpha_3 string, name string")
    return lookup.alpha3_names(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), codes, "n_name").select("n_nationkey", "country")


def child_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passports of a mixed log, with their columns."""
    scans_ = mixed_scans(spark, sf_dir).withColumn("id", F.col("request_id")).withColumn("officer_id", F.lit("o1")).withColumn("document_country", F.when(F.col("request_id").cast("long") % 2 == 0, "IN"))
    return io.child_rows(scans_, "passport")


def rotate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, "previous_run").otherwise("latest_run").alias("run"), F.col("r_name").alias("payload"))
    return io.rotate_runs(runs, table(spark, sf_dir, "nation").select(F.col("n_name").alias("payload")))


def touch_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("updated_at"))
    return lookup.touch(rows, F.col("o_orderstatus") == "F", F.lit(AS_OF)).select("o_orderkey", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_at"))


def keep_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.keep_complete(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0"), "c_custkey", "o_custkey")


FUNCTIONS = (verdict, recommendation_summary, rule_required, rule_format, rule_type, rule_date, rule_cross_field, registry_lookup, lookup_missing, rule_database, rule_status, hybrid_lookup, auth_sync, count_records, penalty_key, upsert_latest, insert_ignore, cascade_delete, foreign_key_audit, child_projection, rls_filter, synth_status, verdict_mixed, login_emails, officers_either, check_inputs, api_lookup, alpha3_names, child_rows, rotate_runs, touch_changed, keep_complete)

SQL = RULE_SQL | {
    "verdict": VERDICT_SQL,
    "recommendation_summary": f"{SCANS_SQL} select {RECOMMEND_SQL} as validation_status, count(*) as n, round(avg(score::double), 4) as mean_score from v group by 1",
    "registry_lookup": f"{SCANS_SQL} select k::varchar as request_id, matched as database_match, 'registry' as data_source, case when matched then 'active' else 'not_found' end as source_status, status from v",
    "lookup_missing": f"{SCANS_SQL} select k::varchar as request_id from v where not matched",
    "rule_database": f"""{SCANS_SQL} select k::varchar as request_id, case when matched then 'DATABASE_FIELD_MATCH' else 'DATABASE_LOOKUP' end as rule,
        case when matched and k % 7 <> 0 then 'PASS' else 'FAIL' end as status, case when not matched then 'DATABASE_NOT_FOUND' when k % 7 = 0 then 'NAME_MISMATCH' end as mismatch from v""",
    "rule_status": f"""{SCANS_SQL} select k::varchar as request_id, case when status in ('BLACKLISTED', 'REVOKED', 'EXPIRED') then 'FAIL' else 'PASS' end as status,
        case status when 'BLACKLISTED' then 'CRITICAL' when 'REVOKED' then 'HIGH' when 'EXPIRED' then 'HIGH' else 'LOW' end as severity,
        case when status in ('BLACKLISTED', 'REVOKED', 'EXPIRED') then status || '_DOCUMENT' end as mismatch from v where matched""",
    "hybrid_lookup": """select o_orderkey, o_custkey, coalesce(a.c_name, b.c_name) as c_name, case when a.c_custkey is not null then 'primary' else 'hybrid_fallback (secondary)' end as data_source
        from orders left join (select * from customer where c_custkey % 3 = 0) a on o_custkey = a.c_custkey left join (select * from customer where c_custkey % 7 <> 0) b on o_custkey = b.c_custkey and a.c_custkey is null""",
    "auth_sync": "select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey) then 'OK' else 'MISSING' end as state from customer",
    "count_records": " union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in ("customer", "supplier", "part", "orders", "lineitem")),
    "penalty_key": """select o_orderkey, case when o_orderkey % 5 = 0 then 'expired' else ['required', 'format', 'type', 'date', 'cross_field', 'database_mismatch', 'warning'][(o_orderkey % 7 + 1)::int] end as penalty from orders""",
    "upsert_latest": """with l as (select o_custkey, max(o_orderkey) as o_orderkey from orders where o_custkey % 2 = 0 group by 1)
        select o.o_custkey, o.o_orderkey, o.o_totalprice from orders o join l using (o_custkey, o_orderkey)
        union all select c_custkey, -1, c_acctbal from customer where c_custkey not in (select o_custkey from l)""",
    "insert_ignore": "select c_custkey, c_name from customer where c_custkey % 3 = 0 or c_custkey % 2 = 0",
    "cascade_delete": "select o_custkey, o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 4 = 0)",
    "foreign_key_audit": "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 6 <> 0)",
    "child_projection": """select o_orderkey::varchar as request_id, printf('P%07d', case when o_orderkey % 10 = 0 then o_custkey + 5000000 else o_custkey end) as passport_number,
        case when o_orderkey % 7 = 0 then 'QQQQ' else 'Holder ' || translate(o_custkey::varchar, '0123456789', 'ABCDEFGHIJ') end as name,
        case when o_orderkey % 11 <> 0 then 'IND' end as nationality, null::varchar as place_of_birth from orders""",
    "rls_filter": "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'",
    "synth_status": """select c_custkey, case when u < 70 then 'ACTIVE' when u < 80 then 'EXPIRED' when u < 85 then 'REVOKED' when u < 90 then 'BLACKLISTED' when u < 95 then 'SUSPENDED' else 'LOST' end as status
        from (select c_custkey, (c_custkey * 37 + 11) % 100 as u from customer)""",
    "verdict_mixed": """with s as (
            select o_orderkey as k, o_custkey as c, ['passport', 'visa', 'aadhaar', 'driving_license', 'national_id', 'permit', 'Space Permit'][o_orderkey % 7 + 1] as kind,
                   o_orderkey % 5 <> 0 as named, o_orderkey % 3 <> 0 as ends, o_orderkey % 7 < 6 and o_custkey in (select c_custkey from customer where c_custkey % 4 <> 0) as matched from orders),
        v as (
            select *, case when kind <> 'aadhaar' and not named then 1 else 0 end + case when kind in ('passport', 'visa', 'driving_license', 'permit') and not ends then 1 else 0 end
                      + case kind when 'visa' then 1 when 'Space Permit' then 1 else 0 end as missing,
                   -- twelve digits are too long for a passport
                   case when kind = 'passport' then 1 else 0 end as misshapen,
                   case when not matched then 1 else 0 end as absent, case when matched and c % 7 = 0 then 1 else 0 end as revoked
            from s),
        w as (select *, greatest(0, 100.0 - 24 * missing - 18 * misshapen - 30 * absent - 48 * revoked) as score from v)
        select k::varchar as request_id, kind as document_type, score::double as validation_score, case when score >= 80 then 'PASS' when score >= 50 then 'MANUAL_REVIEW' else 'FAIL' end as validation_status,
               matched as database_match, case when kind = 'Space Permit' then 'unconfigured' when matched then 'active' else 'not_found' end as source_status,
               case when not matched then 'NOT_FOUND' when revoked = 1 then 'REVOKED' else 'ACTIVE' end as document_status, (missing + misshapen + absent + revoked)::int as n_mismatches from w""",
    "login_emails": """select c_custkey, case when c_custkey % 3 = 0 then 'own@y.org' when c_custkey % 7 <> 0 then (select lower(s_name || '@x.org') from supplier where s_suppkey = c_custkey) end as resolved from customer""",
    "officers_either": "select s_suppkey::varchar as officer_id from supplier where s_suppkey = 3 or lower(s_name) = 'supplier#000000005'",
    "check_inputs": """select c_custkey, concat_ws(',', case when c_custkey % 3 = 0 then 'first_name' end,
            case when c_custkey % 4 = 0 or length(c_custkey::varchar) < 2 then 'officer_id' end, case when c_custkey % 12 < 8 then 'password' end, case when c_custkey % 4 = 0 then 'login' end) as rejects from customer""",
    "api_lookup": """select o_orderkey, case when status = 'official_government_source' then c_name end as record, status as source_status from (
        select o_orderkey, c_name, case when c_custkey is null or c_custkey % 5 = 0 or c_custkey % 3 = 2 then 'api_connection_failed' when c_custkey % 3 = 0 then 'official_government_source' else 'gov_api_status_404' end as status
        from orders left join customer on o_custkey = c_custkey)""",
    "alpha3_names": "select n_nationkey, case n_name when 'NATION_1' then 'One' when 'NATION_2' then 'Two' else n_name end as country from nation",
    "child_rows": """select o_orderkey::varchar as scan_log_id, 'o1' as officer_id, printf('%012d', o_custkey) as passport_number, case when o_orderkey % 5 <> 0 then 'Ann Lee' end as name, null::varchar as surname, null::varchar as given_name,
        'IND' as nationality, '1980-02-03' as date_of_birth, '1995-01-01' as date_of_issue, case when o_orderkey % 3 <> 0 then '2005-06-07' end as date_of_expiry, 'F' as gender, null::varchar as personal_number, null::varchar as passport_type,
        null::varchar as place_of_birth, null::varchar as issuing_authority, null::varchar as mrz_line1, null::varchar as mrz_line2, case when o_orderkey % 2 = 0 then 'IN' end as country from orders where o_orderkey % 7 = 0""",
    "rotate_runs": "select 'previous_run' as run, r_name as payload from region where r_regionkey <> 0 union all select 'latest_run', n_name from nation",
    "touch_changed": "select o_orderkey, case when o_orderstatus = 'F' then '1999-06-30' else strftime(o_orderdate, '%Y-%m-%d') end as updated_at from orders",
    "keep_complete": "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderkey % 3 = 0)",
}
