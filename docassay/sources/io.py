"""Sources and sinks: guarded uploads, JSON results, audit tables and reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What may be uploaded, and the columns of each audit child table.
UPLOAD_TYPES = ("jpg", "jpeg", "png", "webp", "bmp", "tiff")
MAX_UPLOAD = 10 * 1024 * 1024


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; it goes when the driver ends. Without the setting only a local master gets one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    folder = f"{base.rstrip('/')}/docassay-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return folder


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def guard_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with an HTTP code) by extension and length."""
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    code = F.when(~kind.isin(*UPLOAD_TYPES), 415).when(F.col("length") > MAX_UPLOAD, 413).when(F.col("length") == 0, 400)
    marked = files.withColumn("code", code)
    return marked.where("code is null").drop("code"), marked.where("code is not null")


# How an image file begins, by format; dots stand for any byte.
MAGIC = {"jpeg": "^FFD8FF", "png": "^89504E470D0A1A0A", "bmp": "^424D", "webp": "^52494646.{8}57454250", "tiff": "^(49492A00|4D4D002A)"}


def image_format(content: Column) -> Column:
    """The format that a file's first bytes say it has; null for anything else. Reads 12 bytes, in the engine."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.lit(None).cast("string")
    for name, pattern in MAGIC.items():
        out = F.when(head.rlike(pattern), name).otherwise(out)
    return out


def check_images(wanted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images with their format, rejected paths with a reason) for the paths asked for.

    ``wanted`` has path; ``files`` path and content, as binaryFile reads them (it leaves out empty files, which so are missing). A path that no file has is missing; an
    empty file, one of another format and one whose name says another format than its content are not readable as
    they stand: the first two are rejected, the last is kept with the format of its content.
    """
    held = files.select("path", F.length("content").alias("length"), image_format(F.col("content")).alias("format"), F.lit(True).alias("_held"))
    marked = wanted.join(held, "path", "left")
    name = F.coalesce("path", F.lit(""))
    reason = F.when(F.col("_held").isNull(), F.concat(F.lit("Image not found: "), name)).when(F.coalesce("length", F.lit(0)) == 0, F.concat(F.lit("Image is empty: "), name)).when(F.col("format").isNull(), F.concat(F.lit("Unable to read image: "), name))
    marked = marked.withColumn("reason", reason).drop("_held")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").drop("format", "length")


def object_path(user: Column, epoch: Column, name: Column, stored: Column | None = None) -> Column:
    """Where an upload is kept: user, then seconds and the name made safe. Null where any part is, or where it was not ``stored``."""
    path = F.concat(user, F.lit("/"), epoch.cast("long").cast("string"), F.lit("_"), F.regexp_replace(name, r"[^\p{L}\p{N}._\-]", "_"))
    return path if stored is None else F.when(stored, path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Raw results as JSON lines, malformed ones as null rows."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def parse_fields(payload: Column) -> Column:
    """A map of fields from JSON text; anything else is an empty map."""
    return F.coalesce(F.from_json(payload, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


# The child table and its columns for each document type.
CHILD_TABLES = {
    "passport": ("ocr_passports", ("passport_number", "name", "surname", "given_name", "nationality", "date_of_birth", "date_of_issue", "date_of_expiry", "gender", "personal_number", "passport_type", "place_of_birth", "issuing_authority", "mrz_line1", "mrz_line2", "country")),
    "aadhaar": ("ocr_aadhaars", ("aadhaar_number", "masked_number", "name", "gender", "date_of_birth", "address", "country")),
    "visa": ("ocr_visas", ("visa_number", "control_number", "visa_type", "entries", "issuing_post", "issuing_authority", "annotation", "name", "surname", "given_name", "date_of_birth", "passport_number", "nationality", "date_of_issue", "date_of_expiry", "mrz_line1", "mrz_line2", "country")),
    "driving_license": ("ocr_driving_licenses", ("license_number", "name", "date_of_issue", "date_of_expiry", "date_of_birth", "blood_group", "relation", "address", "vehicle_classes", "issuing_authority", "nationality", "country")),
    "national_id": ("ocr_national_ids", ("id_number", "name", "surname", "given_name", "nationality", "date_of_birth", "date_of_issue", "date_of_expiry", "gender", "place_of_birth", "address", "issuing_authority", "mrz_line1", "mrz_line2", "country")),
    "permit": ("ocr_permits", ("permit_number", "permit_type", "name", "surname", "given_name", "date_of_birth", "date_of_issue", "date_of_expiry", "gender", "nationality", "passport_number", "issuing_authority", "address", "mrz_line1", "mrz_line2", "country")),
}


def child_rows(scans: DataFrame, type_name: str) -> DataFrame:
    """The child table's rows of one document type: scan_log_id, officer_id and its columns out of ``fields``.

    ``scans`` has id, officer_id, document_type, document_country and fields (map); the country joins the fields.
    """
    _, columns = CHILD_TABLES[type_name]
    kind = F.replace(F.lower(F.trim("document_type")), F.lit(" "), F.lit("_"))
    value = lambda c: F.coalesce("document_country", F.col("fields")[c]) if c == "country" else F.col("fields")[c]
    return scans.where(kind == type_name).select(F.col("id").alias("scan_log_id"), "officer_id", *[value(c).alias(c) for c in columns])


def _log_columns(scans: DataFrame) -> DataFrame:
    return scans.withColumn("ocr_confidence", F.round("ocr_confidence", 2))


def write_audit(scans: DataFrame, path: str, batch: str) -> None:
    """Write a batch's log and the rows of each child table, all or none.

    Everything is written under the batch's name, the log first; children are made of the log as it was written, so scans are
    computed once. The batch counts from the moment its name stands in ``commits``, which is written last. A batch that died
    is not seen by read_audit(), and writing it again replaces what it left; writing a finished one changes nothing.
    Types without a child table are in the log alone.
    """
    spark = scans.sparkSession
    if batch in finished_batches(spark, path):
        return
    if not batch or not set(batch) <= set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"):
        raise ValueError(f"not a batch name: {batch!r}")
    log = f"{path}/scan_logs/batch={batch}"
    _log_columns(scans).write.mode("overwrite").parquet(log)
    written = spark.read.schema(_log_columns(scans).schema).parquet(log)
    for type_name, (name, _) in CHILD_TABLES.items():
        child_rows(written, type_name).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    spark.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{batch}")


def finished_batches(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return []
    return sorted(r["batch"] for r in spark.read.schema("batch string").option("recursiveFileLookup", True).parquet(f"{path}/commits").collect())  # a row for each batch


def read_audit(spark: SparkSession, path: str, table: str, schema: str | None = None) -> DataFrame:
    """The rows of a table of finished batches, with their batch; ``schema`` is needed where there may be none."""
    done = finished_batches(spark, path)
    if not done:
        return spark.createDataFrame([], f"{schema}, batch string")
    reader = spark.read.option("basePath", f"{path}/{table}")
    rows = (reader.schema(f"{schema}, batch string") if schema else reader).parquet(*[f"{path}/{table}/batch={b}" for b in done])
    return rows.withColumn("batch", F.col("batch").cast("string"))


def drop_batch(spark: SparkSession, path: str, batch: str) -> None:
    """Take a batch back: its name goes first, so no reader sees a part of it, then its rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name in (f"commits/{batch}", f"scan_logs/batch={batch}", *[f"{name}/batch={batch}" for name, _ in CHILD_TABLES.values()]):
        where = hadoop.Path(f"{path}/{name}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def rotate_runs(runs: DataFrame, latest: DataFrame) -> DataFrame:
    """``runs`` (run, payload) after another run: what was latest_run becomes previous_run."""
    last = runs.where("run = 'latest_run'").select(F.lit("previous_run").alias("run"), "payload")
    return last.unionByName(latest.select(F.lit("latest_run").alias("run"), "payload"))


def report(verdicts: DataFrame) -> DataFrame:
    """A line of text per verdict."""
    return verdicts.select(F.format_string("%s  %s  score %.1f  %s", "request_id", "document_type", "validation_score", "validation_status").alias("line"))


def report_text(verdicts: DataFrame, title: str = "VALIDATION RESULT") -> DataFrame:
    """request_id and report: the whole verdict as text, checks and mismatches line by line. Nulls are shown as None."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    bar = F.lit("=" * 65)
    heads = {
        "Request ID": F.col("request_id"), "Document Type": F.upper("document_type"), "Data Source": F.concat(shown(F.col("data_source")), F.lit(" ("), shown(F.col("source_status")), F.lit(")")), "Database Match": F.when(F.col("database_match"), "YES").otherwise("NO"),
        "Document Status": F.col("document_status"), "Validation Score": F.concat(shown(F.col("validation_score")), F.lit("/100.0")), "Validation Status": F.col("validation_status"), "Recommendation": F.col("recommendation"),
    }
    lines = [F.concat(F.lit(f"{name:<17}: "), shown(c)) for name, c in heads.items()]
    check = lambda c: F.concat(F.lit("  "), F.when(c["status"] == "PASS", "[PASS] ").otherwise("[FAIL] "), F.rpad(c["rule"], F.greatest(F.length(c["rule"]), F.lit(25)), F.lit(" ")), F.lit(" "), shown(c["message"]))
    miss = lambda m: F.concat(F.lit("  - Field '"), shown(m["field"]), F.lit("': "), shown(m["message"]), F.lit(" (OCR: "), shown(m["ocr_value"]), F.lit(" | Ref: "), shown(m["reference_value"]), F.lit(")"))
    part = lambda head, rows: F.when(F.size(rows) > 0, F.concat(F.array(F.lit(""), F.lit(head)), rows)).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(bar, F.lit(title.center(65).rstrip()), bar, *lines, bar), part("[ VALIDATION CHECKS ]", F.transform("checks", check)), part("[ MISMATCHES DETECTED ]", F.transform("mismatches", miss)), F.array(bar))
    return verdicts.select("request_id", F.array_join(every, "\n").alias("report"))
