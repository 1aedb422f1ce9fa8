"""Catalog tables: registries bucketed by their key, audit tables, and their constraints as queries.

A registry is looked up by its key over and over. Stored in buckets of that key, sorted, it joins without being shuffled or
sorted again: only the scans move. Uniqueness and foreign keys, which a catalog doesn't enforce, are checked on
writing and by audit_keys().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.config import TYPES
from docassay.operators.lookup import orphans
from docassay.sources.io import CHILD_TABLES

# The registries with their columns; the first is the key, those behind the bar may be null.
REGISTRIES = {
    "passport": ("passports", "passport_number name nationality date_of_birth date_of_expiry gender | surname date_of_issue"),
    "visa": ("visas", "visa_number passport_number name nationality date_of_expiry | visa_type date_of_birth date_of_issue gender"),
    "aadhaar": ("aadhaars", "aadhaar_number | name date_of_birth gender"),
    "driving_license": ("driving_licenses", "license_number name date_of_birth date_of_expiry | date_of_issue blood_group relation"),
    "national_id": ("national_ids", "id_number name | nationality date_of_birth date_of_expiry gender"),
    "permit": ("permits", "permit_number name date_of_expiry | permit_type passport_number date_of_issue"),
}
# The log of scans and the profiles of officers.
SCAN_LOGS = "id STRING NOT NULL, officer_id STRING NOT NULL, document_type STRING NOT NULL, status STRING, ocr_confidence DOUBLE, fields MAP<STRING, STRING>, image_filename STRING, image_path STRING, processing_ms INT, created_at TIMESTAMP"
OFFICERS = "id STRING NOT NULL, first_name STRING, last_name STRING, officer_id STRING NOT NULL, officer_email STRING NOT NULL, organization STRING, designation STRING, created_at TIMESTAMP, updated_at TIMESTAMP"


def registry_columns(type_name: str) -> tuple[str, list[str], list[str]]:
    """Table, columns that are never null, columns that may be."""
    table, columns = REGISTRIES[type_name]
    held, _, free = columns.partition("|")
    return table, held.split(), free.split()


def registry_ddl(type_name: str, database: str, buckets: int) -> str:
    table, held, free = registry_columns(type_name)
    columns = ", ".join([*[f"{c} STRING NOT NULL" for c in held], *[f"{c} STRING" for c in free], "status STRING NOT NULL", "created_at TIMESTAMP"])
    return f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}) USING parquet CLUSTERED BY ({held[0]}) SORTED BY ({held[0]}) INTO {buckets} BUCKETS"


def audit_ddl(database: str) -> list[str]:
    children = [f"CREATE TABLE IF NOT EXISTS {database}.{table} (scan_log_id STRING NOT NULL, officer_id STRING NOT NULL, {', '.join(f'{c} STRING' for c in columns)}) USING parquet" for table, columns in CHILD_TABLES.values()]
    return [f"CREATE TABLE IF NOT EXISTS {database}.officer_profiles ({OFFICERS}) USING parquet", f"CREATE TABLE IF NOT EXISTS {database}.scan_logs ({SCAN_LOGS}) USING parquet", *children]


def create_tables(spark: SparkSession, database: str, buckets: int = 64) -> list[str]:
    """Create what is not there yet; the names of all tables of the database."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for ddl in [*[registry_ddl(t, database, buckets) for t in REGISTRIES], *audit_ddl(database)]:
        spark.sql(ddl)
    return sorted(t.name for t in spark.catalog.listTables(database))


def load_registry(rows: DataFrame, type_name: str, database: str) -> DataFrame:
    """Insert rows into a registry and return the table.

    Of rows with one key the first by all columns is taken, keys that are there already stay as they are, rows without a key
    or another column that must be there are left out: compare with rejects(). Absent columns are null, status ACTIVE.
    """
    spark = rows.sparkSession
    table, held, free = registry_columns(type_name)
    key, target = held[0], spark.table(f"{database}.{table}")
    shaped = _shaped(rows, held, free)
    good = shaped.where(_complete(held))
    first = good.groupBy(key).agg(F.min(F.struct(*[c for c in shaped.columns if c != key])).alias("_r")).select(key, "_r.*")
    new = first.join(target.select(key), key, "left_anti").select(*target.columns)
    buckets = int(next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {database}.{table}").collect() if r["col_name"] == "Num Buckets"))
    new.repartition(buckets, key).write.insertInto(f"{database}.{table}")  # a file for each bucket
    return spark.table(f"{database}.{table}")


def rejects(rows: DataFrame, type_name: str) -> DataFrame:
    """The rows that load_registry() leaves out for columns that are null."""
    _, held, free = registry_columns(type_name)
    return _shaped(rows, held, free).where(~_complete(held))


def _complete(held: list[str]):
    out = F.lit(True)
    for c in held:
        out = out & F.col(c).isNotNull()
    return out


def _shaped(rows: DataFrame, held: list[str], free: list[str]) -> DataFrame:
    column = lambda c, kind="string", other=None: (F.coalesce(F.col(c).cast(kind), F.lit(other)) if c in rows.columns else F.lit(other).cast(kind)).alias(c)
    return rows.select(*[column(c) for c in (*held, *free)], column("status", other="ACTIVE"), column("created_at", "timestamp"))


def audit_keys(spark: SparkSession, database: str) -> DataFrame:
    """table_name, problem, n: keys of registries that occur twice, and rows of child tables without their log."""
    out = None
    logs = spark.table(f"{database}.scan_logs")
    for t in TYPES:
        table, held, _ = registry_columns(t)
        twice = spark.table(f"{database}.{table}").groupBy(held[0]).count().where("count > 1").agg(F.count("*").alias("n"))
        child = CHILD_TABLES[t][0]
        lost = orphans(spark.table(f"{database}.{child}"), logs, "scan_log_id", "id").agg(F.count("*").alias("n"))
        for name, problem, found in ((table, "repeated key", twice), (child, "no scan_logs row", lost)):
            row = found.select(F.lit(name).alias("table_name"), F.lit(problem).alias("problem"), "n")
            out = row if out is None else out.unionByName(row)
    return out
