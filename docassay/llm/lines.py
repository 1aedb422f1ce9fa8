"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A line's key is the line without white space at its ends, ASCII capitals lowered, as 128 bits of a digest. The
index keeps three ledgers of signed rows in a shared folder: ``members`` (document and text), ``pairs`` (text and
key) and ``counts`` (key and documents). An insertion appends rows, a deletion of documents appends their negatives,
and the sum over all rows of a key is the exact number of documents that hold it. Keys that reach ``min_docs`` stand
in the cuckoo filter of their shard (16-bit fingerprints, four slots a bucket, a stash for what finds no slot);
a key that falls below leaves it again, so lines come back once the documents that made them frequent are gone.
A shard whose filter would be too full is laid out anew from the counts.

Deduplication sends text and key digests, not lines, to the shards, where a task reads a shard's filter and streams
the pairs behind it. Only pairs that the filter lets pass are joined with the exact counts, which decide. What is
left, a set of keys for each text, meets the documents again, once.

Versions. Every update writes under its own number and counts from the moment its number is in the table of
versions, the last thing written; an update that dies leaves nothing that is read, and can be run again.

Skew. Pairs are counted per text, so copies of a text are one; shards with many pairs are dealt over salts with a
copy of the filter each; keys of many texts and texts of many documents are salted in their joins, documents by doc_id.
Of a text's keys one task holds the list.

Cases. A null or empty text is one empty line; the empty key is never frequent, for ``min_chars`` is 1 or more.
Each row is a document: repeated rows count for each. A null doc_id is an id like others. Deleting ids that were never
inserted, or twice, changes nothing. An empty table gives no rows and adds nothing. Columns of the input are kept
by deduplicate(), those with the names of its results replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm.common import hot_keys, join_hot, materialise, short_batches, whole_row

KEYED_ARROW = pa.schema([("t", pa.binary()), ("key", pa.binary())])
FILTER = "shard int, room long, slots binary"
FILTER_ARROW = pa.schema([("shard", pa.int32()), ("room", pa.int64()), ("slots", pa.binary())])


class Cuckoo:
    """A cuckoo filter over 16-byte keys in one array: buckets of four fingerprints, then the stash of (bucket, fingerprint)."""

    SLOTS, KICKS = 4, 200

    def __init__(self, room: int, data: bytes | None = None):
        """``room``: the number of buckets, a power of two."""
        self.room, self.stash = room, []
        if data is None:
            self.slots = np.zeros((room, self.SLOTS), np.uint16)
        else:
            held = 2 * room * self.SLOTS
            self.slots = np.frombuffer(data[:held], np.uint16).reshape(room, self.SLOTS).copy()
            self.stash = [tuple(x) for x in np.frombuffer(data[held:], np.int64).reshape(-1, 2).tolist()]

    @classmethod
    def room_for(cls, keys: int) -> int:
        """Buckets that hold twice as many keys at less than half their slots, so that growth is rare."""
        return 1 << max(4, (max(keys, 1) - 1).bit_length())

    @classmethod
    def holds(cls, room: int) -> int:
        """Keys up to which a filter of so many buckets is not laid out anew: 0.8 of its slots."""
        return room * cls.SLOTS * 4 // 5

    def bytes(self) -> bytes:
        return self.slots.tobytes() + np.array(self.stash, np.int64).tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bucket, second bucket and fingerprint of keys (rows of two 64-bit words)."""
        prints = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
        prints[prints == 0] = 1
        first = ((keys[:, 1] >> np.uint64(16)) % np.uint64(self.room)).astype(np.int64)
        return first, self.other(first, prints), prints

    def other(self, bucket, prints):
        return bucket ^ (prints * 0x5BD1E995 >> 7) % self.room

    def insert(self, keys: np.ndarray) -> None:
        rng = np.random.default_rng(5)
        for a, b, p in zip(*(x.tolist() for x in self.places(keys))):
            for bucket in (a, b):
                free = np.flatnonzero(self.slots[bucket] == 0)
                if len(free):
                    self.slots[bucket, free[0]] = p
                    break
            else:
                bucket = b
                for slot in rng.integers(0, self.SLOTS, self.KICKS).tolist():
                    p, self.slots[bucket, slot] = int(self.slots[bucket, slot]), p
                    bucket = self.other(bucket, p)
                    free = np.flatnonzero(self.slots[bucket] == 0)
                    if len(free):
                        self.slots[bucket, free[0]] = p
                        break
                else:
                    self.stash.append((bucket, p))

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that are in it; of the places that fit any one may go, they are alike."""
        for a, b, p in zip(*(x.tolist() for x in self.places(keys))):
            for bucket in (a, b):
                held = np.flatnonzero(self.slots[bucket] == p)
                if len(held):
                    self.slots[bucket, held[0]] = 0
                    break
            else:
                self.stash.remove((a, p) if (a, p) in self.stash else (b, p))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """False for keys that are not in it; true for those that are, and for few others."""
        a, b, p = self.places(keys)
        found = (self.slots[a] == p[:, None]).any(1) | (self.slots[b] == p[:, None]).any(1)
        for bucket, q in self.stash:
            found |= (p == q) & ((a == bucket) | (b == bucket))
        return found


def line_key(line: bytes) -> bytes:
    """The normal form of a line in UTF-8; of bytes, strip() and lower() know ASCII alone."""
    return line.strip().lower()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def text_id(text: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _words(column: pa.Array) -> np.ndarray:
    """Binary values of 16 bytes as rows of two numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def text_keys(documents: DataFrame, min_chars: int) -> DataFrame:
    """t, key: for every row each of the different keys in its text."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, keys = [], []
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {k for k in map(line_key, text.as_py().encode().split(b"\n")) if len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars)}
                keys += map(digest, found)
                owners += [t] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.binary()), pa.array(keys, pa.binary())], schema=KEYED_ARROW)

    short_batches(documents.sparkSession)
    return documents.select(text_id(_text()).alias("t"), _text().alias("text")).mapInArrow(split, "t binary, key binary")


class LineIndex:
    """The lines of a set of documents, with the documents that hold them counted; grows and shrinks."""

    def __init__(self, spark: SparkSession, path: str, *, min_docs: int = 10, min_chars: int = 1, shards: int = 64):
        self.spark, self.path, self.min_docs, self.min_chars, self.shards = spark, path, min_docs, max(1, min_chars), shards

    # -- versions

    def versions(self) -> list[int]:
        """The updates that were finished."""
        if not self._exists(f"{self.path}/versions"):
            return []
        return sorted(r["version"] for r in self.spark.read.schema("version int").parquet(f"{self.path}/versions").collect())

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _ledger(self, name: str, schema: str) -> DataFrame:
        paths = [p for v in self.versions() if self._exists(p := f"{self.path}/{name}/{v}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def members(self) -> DataFrame:
        """doc_id, t, n: the documents in the index."""
        return self._ledger("members", "doc_id long, t binary, n long").groupBy("doc_id", "t").agg(F.sum("n").alias("n")).where("n > 0")

    def counts(self) -> DataFrame:
        """key, n: the exact number of documents that hold a key."""
        return self._ledger("counts", "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")

    def filters(self) -> DataFrame:
        done = self.versions()
        return self.spark.read.schema(FILTER).parquet(f"{self.path}/filters/{done[-1]}") if done else self.spark.createDataFrame([], FILTER)

    # -- updates

    def insert(self, documents: DataFrame) -> None:
        """Add documents: every row counts."""
        version = max(self.versions(), default=0) + 1
        keyed = text_keys(documents, self.min_chars).groupBy("t", "key").agg(F.count("*").alias("n"))
        self._write(keyed, "pairs", version)
        self._write(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_id(_text()).alias("t")).groupBy("doc_id", "t").agg(F.count("*").alias("n")), "members", version)
        self._write(self._read("pairs", version, "t binary, key binary, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts", version)
        self._finish(version)

    def delete(self, ids: DataFrame) -> None:
        """Take out all documents with these doc_ids."""
        version = max(self.versions(), default=0) + 1
        known = ids.select(F.col("doc_id").cast("long").alias("_id")).distinct()
        gone = self.members().join(known, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        self._write(gone.withColumn("n", -F.col("n")), "members", version)
        texts = self._read("members", version, "doc_id long, t binary, n long").groupBy("t").agg(F.sum("n").alias("m"))
        pairs = self._ledger("pairs", "t binary, key binary, n long").select("t", "key").distinct()
        self._write(pairs.join(texts, "t").groupBy("key").agg(F.sum("m").alias("n")), "counts", version)
        self._finish(version)

    def _write(self, rows: DataFrame, name: str, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/{version}")

    def _read(self, name: str, version: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{version}")

    def _finish(self, version: int) -> None:
        """The filters of a version, then its number."""
        change = self._read("counts", version, "key binary, n long").withColumnRenamed("n", "more")
        old = self.counts().join(change.select("key"), "key", "left_semi")
        moved = change.join(old, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("was"), (F.coalesce("n", F.lit(0)) + F.col("more")).alias("now"))
        after = self.counts().unionByName(self._read("counts", version, "key binary, n long")).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs)
        after = after.select(_shard(F.col("key"), self.shards).alias("shard"), "key")
        # A row for each shard: how many keys its filter has to hold, and whether the filter at hand has room for them.
        need = after.groupBy("shard").count().join(self.filters().select("shard", "room"), "shard", "left")
        sizes = {r["shard"]: (r["count"], r["room"]) for r in need.collect()}
        rooms = {s: Cuckoo.room_for(n) for s, (n, room) in sizes.items() if room is None or n > Cuckoo.holds(room)}
        anew = F.array_contains(F.array(*map(F.lit, rooms)) if rooms else F.array().cast("array<int>"), F.col("shard"))
        crossed = moved.where((F.col("was") >= self.min_docs) != (F.col("now") >= self.min_docs)).select(_shard(F.col("key"), self.shards).alias("shard"), F.when(F.col("now") >= self.min_docs, 1).otherwise(2).alias("kind"), "key", F.lit(None).cast("long").alias("room"), F.lit(None).cast("binary").alias("slots"))
        fresh = after.where(anew).select("shard", F.lit(1).alias("kind"), "key", F.lit(None).cast("long").alias("room"), F.lit(None).cast("binary").alias("slots"))
        held = self.filters().where(~anew).select("shard", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("key"), "room", "slots")
        rows = held.unionByName(crossed.where(~anew)).unionByName(fresh).repartition("shard").sortWithinPartitions("shard", "kind")

        def update(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, cuckoo = None, None
            out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([cuckoo.room], pa.int64()), pa.array([cuckoo.bytes()], pa.binary())], schema=FILTER_ARROW)
            for batch in batches:
                for shard, kind, part in _parts(batch):
                    if shard != at:
                        if at is not None:
                            yield out()
                        at, cuckoo = shard, Cuckoo(rooms.get(shard, 16))
                    if kind == 0:
                        cuckoo = Cuckoo(part.column("room")[0].as_py(), part.column("slots")[0].as_py())
                    else:
                        (cuckoo.insert if kind == 1 else cuckoo.remove)(_words(part.column("key")))
            if at is not None:
                yield out()

        self._write(rows.mapInArrow(update, FILTER), "filters", version)
        self.spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    # -- use

    def probe(self, pairs: DataFrame, per_task: int = 100_000) -> DataFrame:
        """Of the pairs (t, key) those whose key may be frequent, by the filters."""
        pairs = pairs.withColumn("shard", _shard(F.col("key"), self.shards))
        sizes = {r["shard"]: r["count"] for r in pairs.groupBy("shard").count().collect()}  # a row for each shard
        salts = F.array(*[F.lit(-(-sizes.get(s, 0) // per_task) or 1) for s in range(self.shards)])
        n = F.get(salts, F.col("shard"))
        rows = pairs.select("shard", F.pmod(F.xxhash64("t"), n).cast("int").alias("salt"), F.lit(1).alias("kind"), "t", "key", F.lit(None).cast("long").alias("room"), F.lit(None).cast("binary").alias("slots"))
        copies = self.filters().select("shard", F.explode(F.sequence(F.lit(0), n - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("t"), F.lit(None).cast("binary").alias("key"), "room", "slots")

        def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, cuckoo = None, None
            for batch in batches:
                for shard, kind, part in _parts(batch):
                    if kind == 0:
                        at, cuckoo = shard, Cuckoo(part.column("room")[0].as_py(), part.column("slots")[0].as_py())
                    elif shard == at:  # a shard without a filter has no frequent keys
                        yield part.filter(pa.array(cuckoo.contains(_words(part.column("key"))))).select(["t", "key"])

        return copies.unionByName(rows).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(look, "t binary, key binary")

    def frequent(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (t, key) those whose key is frequent, by filter and count."""
        exact = self.counts().where(F.col("n") >= self.min_docs)
        return join_hot(self.probe(pairs), materialise(exact, "frequent"), "key", F.col("t"), limit=20_000).select("t", "key")

    def deduplicate(self, documents: DataFrame) -> DataFrame:
        """The documents with n_lines, n_dropped (long) and kept, the text without the lines whose keys are frequent."""
        pairs = materialise(text_keys(documents, self.min_chars).distinct(), "pairs")
        drops = self.frequent(pairs).groupBy("t").agg(F.collect_set("key").alias("_keys"))
        own = documents.drop("n_lines", "n_dropped", "kept")
        rows = own.select(whole_row(own).alias("_row"), _text().alias("_text"), text_id(_text()).alias("t"))
        hot = materialise(hot_keys(rows.groupBy("t").agg(F.count("*").alias("n")), "t", 500).coalesce(1), "hot")
        spread = lambda df, salt: df.join(F.broadcast(hot), F.col("t") == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_salts")
        salts = F.coalesce("_salts", F.lit(1))
        rows = spread(rows, F.pmod(F.xxhash64("_row.doc_id"), salts).cast("int"))  # by content, so a task run again deals alike
        drops = spread(drops, F.explode(F.sequence(F.lit(0), salts - 1)))
        joined = rows.join(drops, ["t", "_salt"], "left").select("_row", F.col("_text"), F.col("_keys"))

        @F.pandas_udf("n_lines long, n_dropped long, kept string")
        def strip(texts, keys):
            import pandas as pd

            out = []
            for text, drop in zip(texts, keys):
                if drop is None or not len(drop):
                    out.append((text.count("\n") + 1, 0, text))
                    continue
                gone, lines = {bytes(k) for k in drop}, text.encode().split(b"\n")
                kept = [x for x in lines if digest(line_key(x)) not in gone]
                out.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
            return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

        return joined.withColumn("_made", strip("_text", "_keys")).select("_row.*", "_made.*")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Shard, kind and rows of each stretch of a batch that lies in one shard and kind; filters come one by one."""
    shards, kinds = (batch.column(c).to_numpy() for c in ("shard", "kind"))
    ends = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0) | (kinds[1:] == 0)) + 1 if len(shards) else []
    for a, b in zip([0, *ends], [*ends, len(shards)]):
        if b > a:
            yield int(shards[a]), int(kinds[a]), batch.slice(a, b - a)
