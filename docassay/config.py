"""Rules of each document type: identifier, required fields, patterns, enumerations and date order.

``date_before`` pairs must be in order. A new type is a new DocumentType, or rows of a table or a file that are read
at run time; unknown names get FALLBACK.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DocumentType:
    identifier: str
    required: tuple[str, ...]
    patterns: dict[str, str] = field(default_factory=dict)
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    dates: tuple[str, ...] = ()
    date_before: tuple[tuple[str, str], ...] = ()


# What each document type asks for.
SEXES = ("M", "F")
BLOOD = ("A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-")
BIRTH, ISSUE, EXPIRY = "date_of_birth", "date_of_issue", "date_of_expiry"
TYPES = {
    "passport": DocumentType("passport_number", ("name", "passport_number", "nationality", BIRTH, EXPIRY, "gender"), {"passport_number": "^[A-Z0-9]{6,9}$"}, {"gender": SEXES}, (BIRTH, ISSUE, EXPIRY), ((BIRTH, EXPIRY),)),
    "visa": DocumentType("visa_number", ("name", "visa_number", "passport_number", "nationality", EXPIRY), {"visa_number": "^[A-Z0-9]{6,15}$", "passport_number": "^[A-Z0-9]{6,9}$"}, {"gender": SEXES}, (BIRTH, ISSUE, EXPIRY), ((ISSUE, EXPIRY),)),
    "aadhaar": DocumentType("aadhaar_number", ("aadhaar_number",), {"aadhaar_number": r"^\d{12}$"}, {"gender": (*SEXES, "TRANSGENDER")}, (BIRTH,)),
    "driving_license": DocumentType("license_number", ("name", "license_number", BIRTH, EXPIRY), {"license_number": "^[A-Z0-9]{8,20}$"}, {"blood_group": BLOOD}, (BIRTH, ISSUE, EXPIRY), ((BIRTH, EXPIRY),)),
    "national_id": DocumentType("id_number", ("name", "id_number"), {"id_number": "^[A-Z0-9]{5,20}$"}, {"gender": SEXES}, (BIRTH, EXPIRY)),
    "permit": DocumentType("permit_number", ("name", "permit_number", EXPIRY), {"permit_number": "^[A-Z0-9]{5,20}$"}, {}, (ISSUE, EXPIRY), ((ISSUE, EXPIRY),)),
}
FALLBACK = DocumentType("document_number", ("document_number", "name"), dates=(EXPIRY,))

#: A type's rules as a JSON object: one file for each type.
SPEC = "document_type string, identifier_field string, fields map<string,struct<required:boolean,type:string,pattern:string,allowed:array<string>>>, cross_field_rules array<struct<rule:string,field_a:string,field_b:string>>"
#: The same as a table: one row for each field.
SPEC_ROWS = "document_type string, place int, field string, identifier boolean, required boolean, type string, pattern string, allowed array<string>, before string"


def clean_type(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def document_type(name: str, types: dict[str, DocumentType] | None = None) -> DocumentType:
    return (TYPES if types is None else types).get(clean_type(name), FALLBACK)


def read_types(spark: SparkSession, path: str) -> dict[str, DocumentType]:
    """The types described by the JSON files under a path, compiled into rules.

    A file without a name, an identifier or fields is an error that names the file; rules other than ``date_before``
    are left out, as dates in the future are always looked for. Of two files for one type the last path counts.
    """
    read = spark.read.schema(f"{SPEC}, damaged string").option("columnNameOfCorruptRecord", "damaged").option("multiLine", True).json(path)
    rows = read.select("document_type", "identifier_field", F.map_entries("fields").alias("fields"), F.coalesce("cross_field_rules", F.array().cast("array<struct<rule:string,field_a:string,field_b:string>>")).alias("rules"), "damaged", F.col("_metadata.file_path").alias("path"))
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r["path"]):  # a row for each type
        if r["damaged"] or not r["document_type"] or not r["identifier_field"] or not r["fields"]:
            raise ValueError(f"no document type in {r['path']}")
        before = tuple((x["field_a"], x["field_b"]) for x in r["rules"] if x["rule"] == "date_before")
        out[clean_type(r["document_type"])] = _compiled(r["identifier_field"], [(e["key"], e["value"] or {}) for e in r["fields"]], before)
    return out


def types_of(spec: DataFrame) -> dict[str, DocumentType]:
    """The types that a table of SPEC_ROWS describes; fields in order of ``place``, then name."""
    out: dict[str, list] = {}
    for r in spec.select(*[c.split()[0] for c in SPEC_ROWS.split(", ")]).collect():  # a row for each field of a type
        out.setdefault(clean_type(r["document_type"]), []).append(r)
    made = {}
    for name, rows in out.items():
        rows.sort(key=lambda r: (r["place"] is None, r["place"], r["field"]))
        identifier = next((r["field"] for r in rows if r["identifier"]), FALLBACK.identifier)
        made[name] = _compiled(identifier, [(r["field"], r) for r in rows], tuple((r["field"], r["before"]) for r in rows if r["before"]))
    return made


def _compiled(identifier: str, fields: list, before: tuple[tuple[str, str], ...]) -> DocumentType:
    get = lambda f, k: f[k] if k in f else None
    return DocumentType(
        identifier,
        tuple(n for n, f in fields if get(f, "required")),
        {n: f["pattern"] for n, f in fields if get(f, "pattern")},
        {n: tuple(f["allowed"]) for n, f in fields if get(f, "allowed")},
        tuple(n for n, f in fields if get(f, "type") == "date"),
        before,
    )
