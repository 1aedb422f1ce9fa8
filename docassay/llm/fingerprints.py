"""Fingerprints of documents by consistent weighted sampling.

Terms are words, weighted by how often they occur. For each of SAMPLES positions a term has r and c from
Gamma(2, 1) and a uniform b, all from a hash of the term and the position; with weight S it gives
t = floor(ln S / r + b) and the value ln c - r (t - b + 1), the logarithm of the usual c / (y e^r). The least
value's (term, t) is the sample. Two texts share a sample with a probability of their generalised Jaccard
similarity, sum of the smaller weights over sum of the larger ones. A fingerprint keeps 16 bits of each
sample, in hex; likeness is the share of equal samples.

Edited texts. The next document is the next lower doc_id; after the lowest the highest follows. The rows
are cut into ranges of doc_id by quantiles; each range is sorted by itself and gets the first row of the
next range behind its own, so no task orders the whole table and a text moves once.

Cases. A null text is empty. A text without words has the samples ``ffff``; two such texts have likeness
1. A null doc_id is the lowest. Rows with equal doc_id follow in order of their text, higher first: the next of all
but the last of equal rows is a row equal to them, so the last one's edited text may be another. A single document is its own next one. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import record_batch

SAMPLES = 128
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, element by element."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


#: A term, alone where its weight is 1.
Pair = str | tuple[str, int]


class Sampler:
    """Values of (term, weight) pairs, cached in an array of ``limit`` rows; samples of texts."""

    def __init__(self, samples: int = SAMPLES, limit: int = 120_000):
        self.samples, self.limit, self.rows = samples, limit, {}
        self.values = np.empty((limit, samples), np.float32)
        self.hashes, self.logs = np.empty(limit, np.uint64), np.empty(limit, np.float32)
        self.salts = _mix(np.arange(1, 2 * samples + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).reshape(2, samples)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)

    def _shape(self, h: np.ndarray, log_s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, b and t where h and the samples' salts meet (broadcast)."""
        bits = _mix(h ^ self.salts[0])
        r = -np.log(self._unit(bits >> _U(32)) * self._unit(bits & _U(0xFFFFFFFF)) + np.float32(1e-30))
        b = self._unit((bits * _U(0x9E3779B97F4A7C15)) >> _U(32))
        return r, b, np.floor(log_s / r + b)

    def _values(self, h: np.ndarray, log_s: np.ndarray) -> np.ndarray:
        r, b, t = self._shape(h[:, None], log_s[:, None])
        bits = _mix(h[:, None] ^ self.salts[1])
        c = -np.log(self._unit(bits >> _U(32)) * self._unit(bits & _U(0xFFFFFFFF)) + np.float32(1e-30))
        return np.log(c) - r * (t - b + 1)

    @staticmethod
    def _terms(pairs: list[Pair]) -> tuple[np.ndarray, np.ndarray]:
        full = [p if p.__class__ is tuple else (p, 1) for p in pairs]
        return np.array([xxhash.xxh3_64_intdigest(term) for term, _ in full], np.uint64), np.log(np.array([n for _, n in full], np.float64)).astype(np.float32)

    def learn(self, wanted: set[Pair]) -> None:
        """Compute the new pairs; if they don't fit beside the old, the old ones go."""
        new = wanted.difference(self.rows)
        if len(self.rows) + len(new) > self.limit:
            self.rows.clear()
            new = wanted
        new = list(new)[: self.limit]
        for i in range(0, len(new), 256):  # blocks that stay in the processor's cache
            part = new[i : i + 256]
            at = slice(len(self.rows), len(self.rows) + len(part))
            self.hashes[at], self.logs[at] = self._terms(part)
            self.values[at] = self._values(self.hashes[at], self.logs[at])
            self.rows.update(zip(part, range(at.start, at.stop)))

    def sign(self, pairs: list[Pair]) -> np.ndarray:
        """The samples of a text; pairs that weren't learnt are computed on the way."""
        if not pairs:
            return np.full(self.samples, 0xFFFF, np.uint16)
        low = np.full(self.samples, np.inf, np.float32)
        h, log_s = np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.float32)
        for i in range(0, len(pairs), 1024):
            part = pairs[i : i + 1024]
            try:
                at = np.fromiter(map(self.rows.__getitem__, part), np.int64, len(part))
                value, hashes, logs = self.values[at], self.hashes[at], self.logs[at]
            except KeyError:
                hashes, logs = self._terms(part)
                value = self._values(hashes, logs)
            least = value.argmin(0)
            found = value[least, np.arange(self.samples)]
            lower = found < low
            low, h, log_s = np.where(lower, found, low), np.where(lower, hashes[least], h), np.where(lower, logs[least], log_s)
        _, _, t = self._shape(h, log_s)
        return (_mix(h ^ (t.astype(np.int64).astype(np.uint64) * _U(0x9E3779B97F4A7C15))) % _U(0xFFFF)).astype(np.uint16)


_sampler: list[Sampler] = []


def _worker_sampler() -> Sampler:
    """One sampler for all the tasks of a Python worker."""
    if not _sampler:
        _sampler.append(Sampler())
    return _sampler[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def weighted_words(text: str) -> list[Pair]:
    """A word that occurs once as itself, others with their counts: plain strings are quick to look up."""
    return [w if n == 1 else (w, n) for w, n in Counter(text.split()).items()]


def edit(text: str, following: str) -> str:
    """The last third replaced by as much of the start of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def fingerprint_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and rank; a row with ``tail`` only follows the last of its range."""
    sampler, block, block_chars = _worker_sampler(), [], 0

    def flush(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        counts = [weighted_words(r["text"]) for r in rows]
        edited = [edit(a["text"], b["text"]) if not a["tail"] and a["bucket"] == b["bucket"] else None for a, b in zip(rows, rows[1:])]
        edited_counts = [None if e is None else weighted_words(e) for e in edited]
        sampler.learn(set().union(*counts, *[c for c in edited_counts if c]))
        signs = [sampler.sign(c) for c in counts]
        out = []
        for i, e in enumerate(edited):
            if e is not None:
                own, changed = signs[i], sampler.sign(edited_counts[i])
                out.append((rows[i]["doc_id"], len(rows[i]["text"]), hashlib.sha256(e.encode()).hexdigest(), own.astype(">u2").tobytes().hex(), changed.astype(">u2").tobytes().hex(), likeness(own, changed), likeness(own, signs[i + 1])))
        yield record_batch(out, ARROW)

    for row in _runs(batches):
        block.append(row)
        block_chars += len(row["text"])
        if block_chars > 150_000 and len(block) > 1 or len(block) > 1000:
            yield from flush(block)
            block, block_chars = block[-1:], len(block[-1]["text"])
    if len(block) > 1:
        yield from flush(block)


def _range_of(cuts: list[int]) -> Column:
    """Number of cuts (highest first) above doc_id, by halving; null is below them all."""

    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("doc_id") >= cuts[mid], half(low, mid)).otherwise(half(mid + 1, high))

    return F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(half(0, len(cuts)))


def fingerprint_documents(documents: DataFrame, ranges: int | None = None) -> DataFrame:
    """A row per document, SCHEMA."""
    spark = documents.sparkSession
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)  # the first range has the highest ids
    docs = docs.withColumn("bucket", _range_of(cuts).cast("int")).withColumn("tail", F.lit(False))
    # The first row of each range stands behind the last one of the range before: a row per range.
    firsts = docs.groupBy("bucket").agg(F.max("doc_id").alias("first")).collect()
    filled = sorted(r["bucket"] for r in firsts)
    if not filled:
        return spark.createDataFrame([], SCHEMA)
    ids = [r["first"] for r in firsts if r["first"] is not None]
    at_head = F.col("doc_id").isin(ids) if len(ids) == len(firsts) else F.col("doc_id").isin(ids) | F.col("doc_id").isNull()
    heads = docs.where(at_head).groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "text")).alias("head"))
    before = F.create_map(*[F.lit(x) for b, prior in zip(filled, [filled[-1], *filled]) for x in (b, prior)])
    tails = heads.select(F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), before[F.col("bucket")].alias("bucket"), F.lit(True).alias("tail"))
    placed = docs.select("doc_id", "text", "bucket", "tail").unionByName(tails).repartitionByRange(n, "bucket")
    return placed.sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), F.col("text").desc()).mapInArrow(fingerprint_partition, SCHEMA)
