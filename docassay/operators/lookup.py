"""Registry lookups: joins of scanned records with reference records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(registry: DataFrame, key: str) -> DataFrame:
    return registry.where(F.col(key).isNotNull()).dropDuplicates([key])


def registry_lookup(scans: DataFrame, registry: DataFrame, scan_key: Column, key: str, *, source: str = "registry", unique: bool = False) -> DataFrame:
    """Scans with record (struct or null), database_match, data_source and source_status.

    A scan without an identifier has source ``none``. Catalyst broadcasts the registry if its size allows.
    """
    keyed = scans.withColumn("_key", F.nullif(scan_key, F.lit("")))
    records = (registry if unique else one_per_key(registry, key)).select(F.col(key).alias("_ref"), F.struct(*registry.columns).alias("record"))
    # Scans without a key get one of their own that no record bears, so they don't meet in one task.
    plain = [F.col(c) for c, kind in scans.dtypes if not kind.startswith(("map", "array", "struct"))]
    spread = F.coalesce("_key", F.concat(F.lit("\u0000"), F.xxhash64(F.lit(0), *plain).cast("string")))
    joined = keyed.withColumn("_join", spread).join(records, F.col("_join") == F.col("_ref"), "left").drop("_ref", "_join")
    return (
        joined.withColumn("database_match", F.col("record").isNotNull())
        .withColumn("data_source", F.when(F.col("_key").isNull(), "none").otherwise(source))
        .withColumn("source_status", F.when(F.col("_key").isNull(), "unconfigured").when(F.col("record").isNotNull(), "active").otherwise("not_found"))
        .drop("_key")
    )


def fetch_single(rows: DataFrame, what: str = "row") -> dict:
    """The one row of a selection; none is a LookupError, several are a ValueError. Two rows come to the driver at most."""
    found = rows.limit(2).collect()
    if not found:
        raise LookupError(f"{what} not found")
    if len(found) > 1:
        raise ValueError(f"more than one {what}")
    return found[0].asDict(recursive=True)


def hybrid_lookup(scans: DataFrame, primary: DataFrame, secondary: DataFrame, scan_key: str, key: str, value: str, names: tuple[str, str] = ("primary", "secondary")) -> DataFrame:
    """The primary's value, on a miss the secondary's; the label says fallback, and to what, even where both miss."""
    a = one_per_key(primary, key).select(F.col(key).alias("_a"), F.col(value).alias("_va"))
    b = one_per_key(secondary, key).select(F.col(key).alias("_b"), F.col(value).alias("_vb"))
    joined = scans.join(a, F.col(scan_key) == F.col("_a"), "left").join(b, (F.col(scan_key) == F.col("_b")) & F.col("_a").isNull(), "left")
    return joined.select(*scans.columns, F.coalesce("_va", "_vb").alias(value), F.when(F.col("_a").isNotNull(), names[0]).otherwise(f"hybrid_fallback ({names[1]})").alias("data_source"))


def require_known(rows: DataFrame, known: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a partner, rows without)."""
    keys = known.select(on).distinct()
    return rows.join(keys, on, "left_semi"), rows.join(keys, on, "left_anti")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows that break a foreign key."""
    return children.join(parents, F.col(child_key) == F.col(parent_key), "left_anti")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A row per table with its number of rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def row_security(rows: DataFrame, owner: str, user: str) -> DataFrame:
    return rows.where(F.col(owner) == user)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Updates replace rows with their keys; the rest is added. One anti join, no window over the target."""
    return target.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose keys are new."""
    return target.unionByName(rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def delete_cascade(children: DataFrame, gone: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(gone.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def fields_to_columns(rows: DataFrame, fields: str, columns: tuple[str, ...]) -> DataFrame:
    """A child table: each column out of the map of fields, null where it is absent."""
    return rows.select(*[c for c in rows.columns if c != fields], *[F.col(fields)[c].alias(c) for c in columns])


def api_lookup(scans: DataFrame, answers: DataFrame, key: str, *, credentials: bool = True) -> DataFrame:
    """Scans with record and source_status out of answers of a remote registry that were fetched beforehand.

    ``answers`` has the key (unique), http_status (null: no connection) and record. Without credentials nothing is asked.
    """
    joined = scans.join(answers.withColumn("_asked", F.lit(True)), key, "left")
    code = F.col("http_status")
    # The labels of the outcomes.
    status = F.lit("unauthorized_credentials_required") if not credentials else F.when(F.col("_asked").isNull() | code.isNull(), "api_connection_failed").when(code == 200, "official_government_source").otherwise(F.concat(F.lit("gov_api_status_"), code.cast("string")))
    return joined.select(*scans.columns, F.when(status == "official_government_source", F.col("record")).alias("record"), status.alias("source_status"))


def alpha3_names(rows: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """``rows`` with country: the name of the alpha-3 code in ``codes`` (alpha_3, name), else the code itself."""
    names = codes.groupBy(F.col("alpha_3").alias(code)).agg(F.min("name").alias("_name"))
    return rows.join(names, code, "left").withColumn("country", F.coalesce("_name", code)).drop("_name")


def any_of(rows: DataFrame, **wanted: str) -> DataFrame:
    """Rows in which at least one of the columns has the value asked for."""
    return rows.where(reduce(lambda a, b: a | b, [F.col(c) == v for c, v in wanted.items()]))


def login_emails(logins: DataFrame, officers: DataFrame) -> DataFrame:
    """Logins with resolved: their email, else that of the officer with their officer_id."""
    known = officers.where("officer_id is not null").groupBy("officer_id").agg(F.min("officer_email").alias("_mail"))
    return logins.join(known, "officer_id", "left").withColumn("resolved", F.coalesce(F.nullif("email", F.lit("")), "_mail")).drop("_mail")


# The least and greatest length of each input.
INPUT_LENGTHS = {"first_name": (1, 100), "last_name": (1, 100), "officer_id": (2, 50), "organization": (3, 150), "password": (8, None)}


def check_inputs(rows: DataFrame, lengths: dict[str, tuple[int, int | None]] = INPUT_LENGTHS) -> DataFrame:
    """Rows with rejects: the names of columns whose length is out of bounds, and ``login`` where neither id nor email is given."""
    out = []
    for c, (least, most) in lengths.items():
        if c in rows.columns:
            n = F.length(F.coalesce(c, F.lit("")))
            out.append(F.when((n < least) | (n > most if most else F.lit(False)), c))
    if {"officer_id", "email"} <= set(rows.columns):
        out.append(F.when(F.coalesce(F.nullif("officer_id", F.lit("")), F.nullif("email", F.lit(""))).isNull(), "login"))
    return rows.withColumn("rejects", F.filter(F.array(*out), lambda x: x.isNotNull()))


def touch(rows: DataFrame, changed: Column, at: Column) -> DataFrame:
    """Rows with updated_at set where they changed."""
    return rows.withColumn("updated_at", F.when(changed, at).otherwise(F.col("updated_at")))


def keep_complete(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents whose second write arrived: those without a child are taken back."""
    return parents.join(children.select(F.col(child_key).alias(parent_key)).distinct(), parent_key, "left_semi")
