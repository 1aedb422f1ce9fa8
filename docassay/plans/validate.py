"""The validation pipeline: scans and a registry to verdicts, as one join and one projection."""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.config import TYPES, DocumentType, document_type
from docassay.functions.dates import free_date
from docassay.functions.normalize import normalize_all_fields, normalize_date, normalize_identifier
from docassay.operators import rules
from docassay.operators.lookup import registry_lookup

STATUSES = ("ACTIVE", "EXPIRED", "REVOKED", "BLACKLISTED", "SUSPENDED", "LOST", "NOT_FOUND", "UNKNOWN")
#: Columns of a registry that are never compared with a scan.
UNCOMPARED = {"id", "status", "created_at", "updated_at", "document_type"}


def get(f: str) -> Column:
    return F.col("fields")[f]


def iso(f: str) -> Column:
    return F.col("_iso")[f]


def _prepared(scans: DataFrame, docs: Iterable[DocumentType], as_of: datetime.date) -> DataFrame:
    """Scans with the normal forms that several rules need, each made once. Dates of no closed form are read token by token."""
    named = dict.fromkeys([*rules.DATE_FIELDS, *[f for d in docs for f in (*d.dates, *[x for pair in d.date_before for x in pair])]])
    closed = scans.withColumn("normalized_fields", normalize_all_fields(F.col("fields"))).withColumn("_closed", F.struct(*[normalize_date(get(f)).alias(f) for f in named]))
    # The fold is written once, over the fields that are left, as its plan is long.
    left = F.array(*[F.when(F.col("_closed")[f].isNull() & (F.trim(get(f)) != ""), get(f)) for f in named])
    free = F.when(F.exists(left, lambda c: c.isNotNull()), F.transform(left, lambda c: F.when(c.isNotNull(), free_date(c, as_of))))
    iso = F.struct(*[F.coalesce(F.col("_closed")[f], F.get(F.col("_free"), F.lit(i))).alias(f) for i, f in enumerate(named)])
    return closed.withColumn("_free", free).withColumn("_iso", iso).drop("_closed", "_free")


def _compared(columns, identifier: str) -> list[str]:
    return [f for f in columns if f not in {*UNCOMPARED, identifier} and (f == "name" or "date" in f)]


#: Why a record has no verdict of its own.
UNREADABLE = "The record's fields can't be read."


def _verdicts(found: DataFrame, type_name: Column, findings: Column, status: Column, extra: Sequence[rules.Rule] = ()) -> DataFrame:
    status = F.upper(status)
    unreadable = F.col("fields").isNull()
    judged = found.withColumn("outcomes", rules.isolated(extra, F.col("fields"), F.col("record"))) if extra else found
    findings = F.concat(findings, rules.rule_findings(F.col("outcomes"))) if extra else findings
    errors = rules.rule_errors(F.col("outcomes")) if extra else F.array().cast("array<string>")
    engine = F.array(rules.finding("VALIDATION_ENGINE", "FAIL", "CRITICAL", f"Validation failed due to internal error: {UNREADABLE}"))
    judged = judged.withColumn("findings", F.when(unreadable, engine).otherwise(findings)).withColumn("raw_score", F.when(unreadable, 0.0).otherwise(rules.raw_score(F.col("findings"), F.col("ocr_confidence"))))
    check = lambda c: F.struct(*[c[k] for k in ("rule", "status", "severity", "message", "field", "ocr_value", "reference_value")])
    miss = lambda c: F.struct(c["field"], c["mismatch"].alias("type"), c["severity"], c["note"].alias("message"), c["ocr_value"], c["reference_value"])
    recommended = rules.recommendation(F.col("raw_score"))
    return judged.select(
        "request_id",
        type_name.alias("document_type"),
        F.when(unreadable, "ERROR").otherwise(recommended).alias("validation_status"),
        F.round("raw_score", 1).alias("validation_score"),
        "database_match",
        "data_source",
        F.when(unreadable, "error").otherwise(F.col("source_status")).alias("source_status"),
        F.when(unreadable, "UNKNOWN").when(~F.col("database_match"), "NOT_FOUND").when(status.isin(*STATUSES), status).otherwise("ACTIVE").alias("document_status"),
        F.transform("findings", check).alias("checks"),
        F.transform(F.filter("findings", lambda c: c["mismatch"].isNotNull()), miss).alias("mismatches"),
        F.transform(F.filter("findings", lambda c: c["status"] == "WARNING"), lambda c: c["message"]).alias("warnings"),
        F.when(unreadable, F.array(F.lit(UNREADABLE))).otherwise(errors).alias("errors"),
        recommended.alias("recommendation"),
        F.coalesce("normalized_fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("normalized_fields"),
    )


def read_requests(payloads: DataFrame, payload: str = "payload", *, default_confidence: float = 0.0) -> DataFrame:
    """``payloads`` with request_id, document_type, ocr_confidence and fields out of JSON texts.

    A request without confidence has the default: 0 as sent by clients, 100 where the caller reads documents itself. Fields that are no object, and a payload that is no JSON object, are
    null: such a request gets the outcome ERROR. Values of fields become texts.
    """
    v = F.try_parse_json(F.col(payload))
    text = lambda path: F.try_variant_get(v, path, "string")
    values = F.try_variant_get(v, "$.fields", "map<string,variant>")
    fields = F.transform_values(values, lambda k, x: F.try_variant_get(x, "$", "string"))
    return payloads.select(*payloads.columns, *[c.alias(n) for n, c in (("request_id", text("$.request_id")), ("document_type", text("$.document_type")), ("ocr_confidence", F.coalesce(F.try_variant_get(v, "$.ocr_confidence", "double"), F.lit(default_confidence))), ("fields", fields)) if n not in payloads.columns])


def validate(scans: DataFrame, registry: DataFrame, type_name: str, as_of: datetime.date, *, unique_registry: bool = False, types: dict[str, DocumentType] | None = None, extra: Sequence[rules.Rule] = ()) -> DataFrame:
    """A verdict per scan of one document type.

    ``scans``: request_id, ocr_confidence and fields (map). ``registry``: the identifier column, status and any
    of the reference fields. The identifier is looked up in its normal form, registry keys as they are. ``types``
    replaces the built-in document types, ``extra`` rules come behind the built-in ones. A scan whose fields are
    null gets the outcome ERROR, score 0; a rule of one's own that fails on a scan is skipped there and named in errors.
    """
    doc = document_type(type_name, types)
    found = registry_lookup(_prepared(scans, [doc], as_of), registry, normalize_identifier(get(doc.identifier)), doc.identifier, unique=unique_registry)
    ref = {f: F.col(f"record.{f}").cast("string") for f in _compared(registry.columns, doc.identifier)}
    findings = rules.all_findings(doc, type_name, get, F.col("database_match"), ref, F.col("record.status"), F.lit(as_of), iso)
    return _verdicts(found, F.lit(type_name), findings, F.col("record.status"), extra)


def validate_mixed(scans: DataFrame, registries: dict[str, DataFrame], as_of: datetime.date, *, types: dict[str, DocumentType] | None = None, extra: Sequence[rules.Rule] = ()) -> DataFrame:
    """A verdict per scan of a table of several document types, in one join and one projection.

    ``scans`` has document_type too; names are compared in lower case with underscores. A type without rules
    of its own has those of an unknown document and no registry. Registries are laid under one another by type.
    ``types`` and ``extra`` are as for validate().
    """
    known = TYPES if types is None else types
    typed = _prepared(scans, known.values(), as_of).withColumn("_kind", F.replace(F.lower(F.trim(F.coalesce("document_type", F.lit("unknown")))), F.lit(" "), F.lit("_")))
    kind = F.col("_kind")
    by_type = lambda of, other: reduce(lambda a, t: F.when(kind == t, of(t)).otherwise(a), known, other)
    records = []
    for t, registry in registries.items():
        columns = [c for c in registry.columns if c not in ("id", "created_at", "updated_at")]
        fields = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
        records.append(registry.select(F.concat(F.lit(f"{t}\u0001"), F.col(document_type(t, known).identifier)).alias("key"), fields.alias("fields")))
    unknown = document_type("", known)
    key = by_type(lambda t: normalize_identifier(get(known[t].identifier)), normalize_identifier(get(unknown.identifier)))
    typed_key = F.when(key != "", F.concat(kind, F.lit("\u0001"), key))
    found = registry_lookup(typed, reduce(DataFrame.unionByName, records), typed_key, "key")
    found = found.withColumn("record", F.col("record.fields"))

    def findings(t: str) -> Column:
        columns = registries[t].columns if t in registries else ()
        ref = {f: F.col("record")[f] for f in _compared(columns, document_type(t, known).identifier)}
        return rules.all_findings(document_type(t, known), t, get, F.col("database_match"), ref, F.col("record")["status"], F.lit(as_of), iso)

    return _verdicts(found, F.coalesce("document_type", F.lit("unknown")), by_type(findings, findings("")), F.col("record")["status"], extra)
