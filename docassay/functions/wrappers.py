"""Results of extraction engines, in the layouts they come in, brought into one envelope.

An engine's result is a JSON object. Which keys it has differs by document type and from row to row, so it is read
as a variant: no schema is given and none inferred. Keys come in the order of the text, which decides between
fields of one meaning; values come from the variant, which knows objects from texts that look like one.

Cases. Null, malformed JSON, JSON that is no object, and repeated keys give an envelope with status ERROR, confidence 0
and empty fields. Numbers and booleans become texts; null, and an object without ``value`` where one is
expected, becomes null; lists give their first element that is no heading.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docassay.functions.adapt import clean_list

ENVELOPE = ("document_type", "status", "ocr_confidence", "reason")
#: Document type -> the name that its results bear where they bear none.
TITLES = {"passport": "PASSPORT", "visa": "VISA", "aadhaar": "AADHAAR", "driving_license": "DRIVING LICENSE", "national_id": "NATIONAL ID", "permit": "PERMIT"}
#: Types whose fields are objects with a value.
LABELLED = ("national_id", "permit", "driving_license")


def _empty() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def _kind(v: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(name), F.lit(False))


def _text(v: Column) -> Column:
    """A variant's scalar as text, a list's first value; null for objects and nulls."""
    return F.when(_kind(v, "ARRAY"), clean_list(F.try_variant_get(v, "$", "array<string>"))).when(~_kind(v, "OBJECT"), F.try_variant_get(v, "$", "string"))


def _object(variant: Column, text: Column, path: str, value) -> Column:
    """The object at a path as a map in the text's order of keys; null where there is none."""
    held = F.try_variant_get(variant, path, "map<string,variant>")
    keys = F.coalesce(F.json_object_keys(text if path == "$" else F.get_json_object(text, path)), F.map_keys(held))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), value(held[k]).alias("value"))))


def flatten_result(kind: Column, result: Column) -> Column:
    """struct(document_type, status, ocr_confidence, reason, fields, extracted, mrz, unpaired) of a result of type ``kind``.

    fields: flat values by label; extracted and mrz: the parts of a visa; unpaired: texts that belong to no label.
    """
    v = F.try_parse_json(result)
    whole = _kind(v, "OBJECT")
    labelled = _object(v, result, "$.fields", lambda x: F.when(_kind(x, "OBJECT"), F.try_variant_get(x, "$.value", "string")).otherwise(_text(x)))
    every = _object(v, result, "$", _text)
    fields = F.when(kind.isin(*LABELLED), labelled).when(kind == "aadhaar", F.map_filter(every, lambda k, _: ~k.isin(*ENVELOPE))).when(kind == "passport", every)
    unpaired = F.transform(F.try_variant_get(v, "$.unpaired_text", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string"))
    part = lambda path: F.when(kind == "visa", _object(v, result, path, _text))
    title = F.coalesce(F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])[kind], F.lit("UNKNOWN"))
    own = lambda name, other: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), other)
    mrz_read = F.size(F.coalesce(every, _empty())) > 0
    read = F.struct(
        F.when(kind == "passport", title).otherwise(own("document_type", title)).alias("document_type"),
        F.when(kind == "passport", F.when(mrz_read, "OCR SUCCESS").otherwise("CLEARER IMAGE REQUIRED")).otherwise(own("status", F.lit("UNKNOWN"))).alias("status"),
        F.when(kind == "passport", F.when(mrz_read, 100.0).otherwise(0.0)).otherwise(F.coalesce(F.try_variant_get(v, "$.ocr_confidence", "double"), F.lit(0.0))).alias("ocr_confidence"),
        F.when(kind == "passport", F.when(mrz_read, "Passport MRZ extracted successfully.").otherwise("The MRZ could not be read from this image.")).otherwise(own("reason", F.lit(""))).alias("reason"),
        F.coalesce(fields, _empty()).alias("fields"),
        F.coalesce(part("$.fields"), _empty()).alias("extracted"),
        F.coalesce(part("$.mrz"), _empty()).alias("mrz"),
        F.coalesce(F.when(kind.isin("national_id", "permit"), unpaired), F.array().cast("array<string>")).alias("unpaired"),
    )
    failed = F.struct(title.alias("document_type"), F.lit("ERROR").alias("status"), F.lit(0.0).alias("ocr_confidence"), F.lit("The result is no JSON object.").alias("reason"), _empty().alias("fields"), _empty().alias("extracted"), _empty().alias("mrz"), F.array().cast("array<string>").alias("unpaired"))
    return F.when(whole, read).otherwise(failed)
