"""Fill-in-the-middle over an index of distinct texts with Elias-Fano boundary lists.

Index. Texts are grouped by a 64-bit hash, and a group gathers the set of its different contents: copies are told
by comparing whole texts, a hash that two contents share just gives two texts, told apart by the document's
SHA-256. Tasks send each text once, however many copies they hold. For a text the places in UTF-8 where code
points begin, and its end, are one Elias-Fano list: the low bits of each place, and the high bits as distances in
unary, with the place of every 256th one beside them, about two bits a character of plain English. Documents bring
their id and cuts, not their texts, back to the index; the list of a text is made once for all the documents that
meet it, and each cut is selected from it: two reads give the byte places at which to cut.

Keys that bear many documents are dealt into blocks by doc_id, so a text that a third of all documents share is
cut in many tasks.

Cuts. The numbers h1 to h4 are the first four 8-digit groups of the hex SHA-256 of ``seed:doc_id``; the prefix
ends after min(h1 % (n + 1), h2 % (n + 1)) code points, the middle after the larger.

Cases. A null text is empty, and plain. A null doc_id counts as no digits. Rows with equal doc_id are cut each, equal
rows alike; equal rows stay in one block. A text that holds a mark is plain, so output and form always give the text
back. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import hash_blocks, record_batch, short_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


class EliasFano:
    """A list of ascending numbers in few bits, read at any place."""

    EVERY = 256
    HEAD = struct.Struct("<QB")

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.size, self.low_bits, self.low, self.high, self.marks = size, low_bits, low, high, marks

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        """The list of ``numbers``, which are not negative and never fall."""
        n = len(numbers)
        low_bits = max(0, (int(numbers[-1]) // n).bit_length() - 1) if n else 0
        ones = (numbers >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        low = (numbers[:, None] >> np.arange(low_bits)) & 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[:: cls.EVERY].astype(np.int64))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        block, rest = divmod(i, self.EVERY)
        first = int(self.marks[block])
        last = int(self.marks[block + 1]) if block + 1 < len(self.marks) else 8 * len(self.high)
        bits = np.unpackbits(self.high[first // 8 : last // 8 + 1], bitorder="little")[first % 8 :]
        top = first + int(np.flatnonzero(bits)[rest]) - i
        at = i * self.low_bits
        held = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little") >> at % 8
        return top << self.low_bits | held & ((1 << self.low_bits) - 1)

    def pack(self) -> bytes:
        return self.HEAD.pack(self.size, self.low_bits) + self.low.tobytes() + self.marks.tobytes() + self.high.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> EliasFano:
        size, low_bits = cls.HEAD.unpack_from(data)
        a = cls.HEAD.size
        b = a + (size * low_bits + 7) // 8
        c = b + 8 * -(-size // cls.EVERY)
        return cls(size, low_bits, np.frombuffer(data[a:b], np.uint8), np.frombuffer(data[c:], np.uint8), np.frombuffer(data[b:c], np.int64))


def boundaries(raw: bytes) -> EliasFano:
    """Where the code points of a UTF-8 text begin, and where the last one ends."""
    return EliasFano.of(np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80), len(raw)))


def _group(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th group of eight hex digits of the seeded digest, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def seeded_cuts(documents: DataFrame, *, seed: int, plain_percent: int, spm_percent: int) -> DataFrame:
    """doc_id, key, digest, n, form, low, high: what a document brings to the index, without its text."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    rows = documents.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("digest"), F.length(text).cast("long").alias("n"), (text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)).alias("marked"))
    h1, h2, h3, h4 = (_group(F.col("doc_id"), seed, k) for k in (1, 2, 3, 4))
    units = F.col("n") + 1
    form = F.when(F.col("marked") | (F.col("n") == 0) | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    return rows.select("doc_id", "key", "digest", "n", form.alias("form"), F.least(h1 % units, h2 % units).alias("low"), F.greatest(h1 % units, h2 % units).alias("high"))


def arrange(raw: bytes, index: EliasFano, form: str, low: int, high: int) -> bytes:
    """The text in the given form, cut behind ``low`` and ``high`` code points."""
    if form == "plain":
        return raw
    a, b = index[low], index[high]
    p, m, s = PREFIX.encode() + raw[:a], MIDDLE.encode() + raw[a:b], SUFFIX.encode() + raw[b:]
    return p + s + m if form == "psm" else s + p + m


def transform(documents: DataFrame, *, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """A row per document, SCHEMA; ``output`` is the transformed text."""
    spark = documents.sparkSession
    short_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    block = hash_blocks(documents.select(F.xxhash64(text).alias("key")), "key")
    cuts = block(seeded_cuts(documents, seed=seed, plain_percent=plain_percent, spm_percent=spm_percent), F.col("doc_id"))
    contents = block(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")), F.col("doc_id"))
    index = contents.groupBy("key", "block").agg(F.collect_set("text").alias("texts"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        at, held = None, {}
        for batch in batches:
            rows, texts = [], batch.column("texts")
            for i, (doc_id, key, blk, digest, n, form, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "block", "digest", "n", "form", "low", "high")))):
                if at != (key, blk):  # rows come in the order of the index: a list serves all the rows of its text
                    contents = [t.encode() for t in texts[i].as_py()]
                    names = [digest] if len(contents) == 1 else [hashlib.sha256(raw).hexdigest() for raw in contents]
                    at, held = (key, blk), {name: (raw, boundaries(raw)) for name, raw in zip(names, contents)}
                plain = form == "plain"
                rows.append((doc_id, n, form, None if plain else low, None if plain else high - low, arrange(*held[digest], form, low, high).decode()))
            yield record_batch(rows, ARROW)

    return cuts.join(index, ["key", "block"]).mapInArrow(cut, SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text again, from a transformed text and its form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
