"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the ASCII controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and every executor see, under spark.checkpoint.dir.

    Where that setting is absent a master ``local`` gets a temporary folder, since driver and executors are one
    process there, and the setting is filled in; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docassay-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: cuts lineage, survives lost executors."""
    return Scratch(df.sparkSession).table(df, label)


class Scratch:
    """Tables in the shared folder that can be dropped once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, shared_dir(spark), []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}-{label}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *kept: str) -> None:
        """Delete all tables but those with the labels ``kept``."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for path in self.paths:
            if path.rpartition("-")[2] not in kept:
                where = hadoop.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = [p for p in self.paths if p.rpartition("-")[2] in kept]


#: Keys that are salted, at most; a key beyond the first so many has at most that share of all rows.
HOT_KEYS = 20_000


def hot_keys(per_key: DataFrame, key: str, limit: int) -> DataFrame:
    """_hot, _salts of the keys with more than ``limit`` rows by column n, the HOT_KEYS most frequent at most: so many rows can be broadcast."""
    top = per_key.where(F.col("n") > limit).orderBy(F.col("n").desc(), key).limit(HOT_KEYS)
    return top.select(F.col(key).alias("_hot"), F.ceil(F.col("n") / limit).cast("int").alias("_salts"))


def hash_blocks(keys: DataFrame, key: str, *, limit: int = 500) -> Callable[[DataFrame, Column], DataFrame]:
    """A function of (rows, spread) that gives rows a column ``block``: 0, or for keys with more than ``limit`` rows in ``keys`` one of many, by the hash of ``spread``."""
    hot = materialise(hot_keys(keys.groupBy(key).agg(F.count("*").alias("n")), key, limit).coalesce(1), "hot")

    def block(rows: DataFrame, spread: Column) -> DataFrame:
        salted = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left")
        return salted.withColumn("block", F.coalesce(F.pmod(F.xxhash64(spread), "_salts").cast("int"), F.lit(0))).drop("_hot", "_salts")

    return block


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, spread: Column, *, limit: int = 50_000) -> DataFrame:
    """Inner join of many rows with a table of one row per key, whose column n says how many rows bear the key.

    A key with more than ``limit`` rows is spread over as many salts as it holds limits, by the hash of
    ``spread``. Of hot keys HOT_KEYS at most are salted and broadcast; the others have 1 / HOT_KEYS of all rows at most.
    """
    hot = hot_keys(per_key, key, limit)
    salted = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), "_salts").cast("int"), F.lit(0))).drop("_hot", "_salts")
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / limit).cast("int"), F.lit(1)) - 1)))
    return salted.join(copies.drop("n"), [key, "_salt"]).drop("_salt")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python in Arrow batches of fewer rows than Spark's default; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, rows)


def words(text):
    """The words of a text column, as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def give_back() -> None:
    """Return a worker's freed memory to the system, at the end of a task that held much; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # not in every C library
        libc.malloc_trim(0)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """An Arrow batch of row tuples."""
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
