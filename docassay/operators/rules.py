"""Validation rules. A rule is a Column: an array of check structs, built in one projection without a shuffle.
The texts of findings are fixed values.

Rules read the raw fields through ``get`` (name -> Column) and the registry record through ``ref``. A finding
that also counts as a mismatch has its type in ``mismatch`` and the text that goes with it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docassay.config import DocumentType
from docassay.functions.normalize import is_missing, normalize_date, normalize_gender, normalize_identifier, normalize_numeric_identifier
from docassay.functions.similarity import names_match

Get = Callable[[str], Column]
DATE_FIELDS = ("date_of_birth", "date_of_issue", "date_of_expiry")
FINDING_FIELDS = ("rule", "status", "severity", "message", "field", "ocr_value", "reference_value", "mismatch", "note")
FINDING = "struct<rule:string,status:string,severity:string,message:string,field:string,ocr_value:string,reference_value:string,mismatch:string,note:string>"


def finding(rule: str, status: str, severity: str, message: Column | str, field: str | None = None, ocr: Column | None = None, ref: Column | None = None, mismatch: str | None = None, note: Column | str | None = None) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = {"rule": rule, "status": status, "severity": severity, "message": message, "field": field, "ocr_value": ocr, "reference_value": ref, "mismatch": mismatch, "note": note}
    return F.struct(*[text(v).cast("string").alias(k) for k, v in values.items()])


def _findings(*found: Column) -> Column:
    """An array of the findings that are not null."""
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast(f"array<{FINDING}>")


def required_fields(doc: DocumentType, get: Get) -> Column:
    return _findings(*[
        F.when(is_missing(get(f)), finding("REQUIRED_FIELDS", "FAIL", "HIGH", f"Required field '{f}' is missing or empty.", f, mismatch="MISSING_REQUIRED_FIELD", note=f"Field '{f}' is required by document configuration."))
        .otherwise(finding("REQUIRED_FIELDS", "PASS", "LOW", f"Required field '{f}' is present.", f, get(f)))
        for f in doc.required
    ])


def formats(doc: DocumentType, get: Get, type_name: str) -> Column:
    out = []
    for f, pattern in doc.patterns.items():
        value = normalize_numeric_identifier(get(f)) if type_name == "aadhaar" else normalize_identifier(get(f))
        bad = finding("FORMAT_VALIDATION", "FAIL", "HIGH", F.concat(F.lit(f"Field '{f}' value '"), get(f), F.lit("' does not match required format pattern.")), f, get(f), mismatch="FORMAT_MISMATCH", note=f"Value does not conform to pattern '{pattern}'")
        good = finding("FORMAT_VALIDATION", "PASS", "LOW", f"Field '{f}' matches format pattern.", f, get(f))
        out.append(F.when(~is_missing(get(f)), F.when(value.rlike(pattern), good).otherwise(bad)))
    return _findings(*out)


def types(doc: DocumentType, get: Get, iso: Get | None = None) -> Column:
    """``iso`` gives a field's date in its normal form, where the caller has it at hand."""
    iso = iso or (lambda f: normalize_date(get(f)))
    shown = lambda f: F.concat(F.lit(f"Field '{f}' value '"), F.trim(get(f)))
    bad_date = lambda f: finding("TYPE_VALIDATION", "FAIL", "MEDIUM", F.concat(shown(f), F.lit("' cannot be parsed as a valid date.")), f, F.trim(get(f)), mismatch="INVALID_DATE_TYPE", note="Invalid date format")
    out = [F.when(~is_missing(get(f)) & iso(f).isNull(), bad_date(f)) for f in doc.dates]
    for f, allowed in doc.allowed.items():
        value = normalize_gender(get(f)) if f == "gender" else F.upper(F.trim(get(f)))
        names = f"[{', '.join(repr(a) for a in allowed)}]"
        bad = finding("TYPE_VALIDATION", "FAIL", "MEDIUM", F.concat(shown(f), F.lit(f"' not in allowed values {names}.")), f, F.trim(get(f)), mismatch="ENUM_OUT_OF_RANGE", note=f"Allowed values: {names}")
        out.append(F.when(~is_missing(get(f)) & ~value.isin(*allowed), bad))
    return _findings(*out)


def dates(get: Get, as_of: Column, iso: Get | None = None) -> Column:
    raw = {f: get(f) for f in DATE_FIELDS}
    birth, issue, expiry = (iso(f) if iso else normalize_date(c) for f, c in raw.items())
    today = F.date_format(as_of, "yyyy-MM-dd")
    future = lambda f: F.concat(F.lit("Date of " + f.split("_")[-1] + " '"), raw[f], F.lit("' is in the future relative to runtime date "), today, F.lit("."))
    born = F.when(birth > today, finding("DATE_VALIDATION", "FAIL", "HIGH", future("date_of_birth"), "date_of_birth", raw["date_of_birth"], mismatch="FUTURE_DOB", note="Date of birth cannot be in the future"))
    issued = F.when(issue > today, finding("DATE_VALIDATION", "FAIL", "MEDIUM", future("date_of_issue"), "date_of_issue", raw["date_of_issue"]))
    text = F.concat(F.lit("Date of expiry '"), raw["date_of_expiry"], F.lit("' is on or before date of issue '"), raw["date_of_issue"], F.lit("'."))
    ended = F.when(expiry <= issue, finding("DATE_VALIDATION", "FAIL", "HIGH", text, "date_of_expiry", raw["date_of_expiry"], mismatch="INVALID_EXPIRY_INTERVAL", note="Expiry date must be after issue date"))
    clean = F.when(~(F.coalesce(birth > today, F.lit(False)) | F.coalesce(issue > today, F.lit(False)) | F.coalesce(expiry <= issue, F.lit(False))), finding("DATE_VALIDATION", "PASS", "LOW", "Date validation passed."))
    return _findings(born, issued, ended, clean)


def cross_fields(doc: DocumentType, get: Get, iso: Get | None = None) -> Column:
    iso = iso or (lambda f: normalize_date(get(f)))
    out = []
    for a, b in doc.date_before:
        x, y = iso(a), iso(b)
        text = F.concat(F.lit(f"Cross-field failure: '{a}' ("), x, F.lit(f") is after '{b}' ("), y, F.lit(")."))
        out.append(F.when(x > y, finding("CROSS_FIELD_CONSISTENCY", "FAIL", "HIGH", text, a, x, y, "CROSS_FIELD_MISMATCH", f"'{a}' must be before '{b}'")))
    return _findings(*out)


def database(doc: DocumentType, get: Get, matched: Column, ref: dict[str, Column], iso: Get | None = None) -> Column:
    """No record: one finding. Else the name by similarity and every date by its normal form."""
    missing = finding("DATABASE_LOOKUP", "FAIL", "HIGH", "No record found in reference database matching identifier.", doc.identifier, mismatch="DATABASE_NOT_FOUND", note="Identifier not found in registry database")
    out = [F.when(~matched, missing)]
    for f, value in ref.items():
        both = matched & get(f).isNotNull() & value.isNotNull()
        if f == "name":
            same, percent = names_match(get(f), value)
            share = percent.cast("string")
            bad = finding("DATABASE_FIELD_MATCH", "FAIL", "HIGH", F.concat(F.lit("Name mismatch in DB: OCR '"), get(f), F.lit("' vs DB '"), value, F.lit("' (Similarity: "), share, F.lit("%)")), f, get(f), value, "NAME_MISMATCH", F.concat(F.lit("Name mismatch (Similarity: "), share, F.lit("%)")))
            good = finding("DATABASE_FIELD_MATCH", "PASS", "LOW", F.concat(F.lit("Name match in DB (Similarity: "), share, F.lit("%).")), f, get(f), value)
            out.append(F.when(both, F.when(same, good).otherwise(bad)))
        elif "date" in f:
            x, y = iso(f) if iso else normalize_date(get(f)), normalize_date(value)
            out.append(F.when(both & (x != y), finding("DATABASE_FIELD_MATCH", "FAIL", "HIGH", F.concat(F.lit(f"Field '{f}' mismatch in DB: OCR '"), x, F.lit("' vs DB '"), y, F.lit("'")), f, x, y, "DATABASE_MISMATCH", "Date mismatch")))
    return _findings(*out)


def document_status(matched: Column, status: Column) -> Column:
    """Blacklisted, revoked and expired documents fail; lost and suspended ones pass."""
    s = F.upper(F.coalesce(status, F.lit("ACTIVE")))
    # The texts of the outcomes.
    texts = {
        "BLACKLISTED": ("CRITICAL", "CRITICAL: Document is flagged as BLACKLISTED in official record."),
        "REVOKED": ("HIGH", "Document has been REVOKED by issuing authority."),
        "EXPIRED": ("HIGH", "Document status is EXPIRED in reference record."),
    }
    found = F.lit(None)
    for name, (severity, text) in texts.items():
        found = F.when(s == name, finding("DOCUMENT_STATUS", "FAIL", severity, text, "status", ref=s, mismatch=f"{name}_DOCUMENT", note=f"Document is {name.lower()}")).otherwise(found)
    good = finding("DOCUMENT_STATUS", "PASS", "LOW", F.concat(F.lit("Document status is '"), s, F.lit("'.")), "status", ref=s)
    return _findings(F.when(matched, F.coalesce(found, good)))


def all_findings(doc: DocumentType, type_name: str, get: Get, matched: Column, ref: dict[str, Column], status: Column, as_of: Column, iso: Get | None = None) -> Column:
    """Findings of every rule, in the rules' order."""
    return F.concat(required_fields(doc, get), formats(doc, get, type_name), types(doc, get, iso), dates(get, as_of, iso), cross_fields(doc, get, iso), database(doc, get, matched, ref, iso), document_status(matched, status))


@dataclass(frozen=True)
class Rule:
    """A rule of one's own: ``outcome`` gives struct(findings, error) from the columns ``fields`` and ``record``.

    Null findings mean that the rule failed on the row: it is skipped there and ``error`` says why; other rules and
    rows go on.
    """

    name: str
    outcome: Callable[[Column, Column], Column]


OUTCOME = f"struct<findings:array<{FINDING}>,error:string>"


def column_rule(name: str, findings: Callable[[Column, Column], Column]) -> Rule:
    """A rule of Column expressions. Write what may fail with ``try_`` functions: their null makes the rule fail on that row, as no expression can be caught."""
    return Rule(name, lambda fields, record: F.struct(findings(fields, record).alias("findings"), F.lit(None).cast("string").alias("error")))


def python_rule(name: str, judge: Callable[[dict, dict | None], list[dict]]) -> Rule:
    """A rule in Python: ``judge`` gets the fields and the registry's record of a row and returns findings as dictionaries; what it raises is caught row by row."""

    @F.pandas_udf(OUTCOME)
    def run(fields: pd.Series, record: pd.Series) -> pd.DataFrame:
        rows = []
        for f, r in zip(fields, record):
            try:
                found = [{k: x.get(k) for k in FINDING_FIELDS} for x in judge(json.loads(f) if f else {}, json.loads(r) if r else None)]
                rows.append((found, None))
            except Exception as e:  # a rule may fail in any way; its row says how
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["findings", "error"])

    return Rule(name, lambda fields, record: run(F.to_json(fields), F.to_json(record)))


def isolated(rules: Sequence[Rule], fields: Column, record: Column) -> Column:
    """Array of struct(name, findings, error), one for each rule."""
    return F.array(*[F.struct(F.lit(r.name).alias("name"), (o := r.outcome(fields, record))["findings"].cast(f"array<{FINDING}>").alias("findings"), o["error"].alias("error")) for r in rules])


def rule_findings(outcomes: Column) -> Column:
    return F.flatten(F.transform(outcomes, lambda o: F.coalesce(o["findings"], F.array().cast(f"array<{FINDING}>"))))


def rule_errors(outcomes: Column) -> Column:
    """A text for each rule that failed."""
    failed = F.filter(outcomes, lambda o: o["findings"].isNull())
    return F.transform(failed, lambda o: F.concat(F.lit("Error executing rule "), o["name"], F.coalesce(F.concat(F.lit(": "), o["error"]), F.lit(""))))


# Penalty weights, severity factors and thresholds of the score.
WEIGHTS = {"blacklisted": 50, "revoked": 40, "expired": 25, "required": 20, "format": 15, "type": 10, "date": 25, "cross_field": 30, "database_mismatch": 25, "warning": 5}
SEVERITIES = {"CRITICAL": 1.5, "HIGH": 1.2, "LOW": 0.7}


# What a failed check counts as, by the status words in its text, then by words in its rule.
BY_TEXT = (("BLACKLISTED", "blacklisted"), ("REVOKED", "revoked"), ("EXPIRED", "expired"))
BY_RULE = (("REQUIRED", "required"), ("FORMAT", "format"), ("TYPE", "type"), ("DATE", "date"), ("CROSS_FIELD", "cross_field"), ("CONSISTENCY", "cross_field"), ("DATABASE", "database_mismatch"))


def _by_key(rule: Column, message: Column, values: dict) -> Column:
    # DATABASE holds DATE no more than UPDATE does: D-A-T-A, so the order is safe.
    both, named = F.upper(F.concat_ws(" ", message, rule)), F.upper(rule)
    whens = [(both.contains(w), k) for w, k in BY_TEXT] + [(named.contains(w), k) for w, k in BY_RULE]
    return reduce(lambda a, x: F.when(x[0], values[x[1]]).otherwise(a), reversed(whens), F.lit(values["warning"]))


def penalty_key(rule: Column, message: Column) -> Column:
    """What a failed check counts as: the status words in its text come before its rule."""
    return _by_key(rule, message, {k: k for k in WEIGHTS})


def penalty(check: Column) -> Column:
    weight = _by_key(check["rule"], check["message"], {k: float(w) for k, w in WEIGHTS.items()})
    factor = reduce(lambda a, x: F.when(check["severity"] == x[0], x[1]).otherwise(a), SEVERITIES.items(), F.lit(1.0))
    return F.when(check["status"].isin("FAIL", "WARNING"), weight * factor).otherwise(0.0)


def raw_score(checks: Column, confidence: Column) -> Column:
    lost = F.aggregate(checks, F.lit(0.0), lambda a, c: a + penalty(c)) + F.when(confidence < 50, 15.0).when(confidence < 70, 8.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - lost))


def recommendation(score: Column) -> Column:
    return F.when(score >= 80, "PASS").when(score >= 50, "MANUAL_REVIEW").otherwise("FAIL")
