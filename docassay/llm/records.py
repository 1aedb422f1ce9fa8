"""Token ids as length-delimited binary records, with an offset index beside them.

File format. A file is a run of frames; a frame is

    length    8 bytes   of the payload, little-endian
    check     4 bytes   masked CRC-32 of the length field
    payload             doc_id (8 bytes, signed), a flag (1: doc_id is null), bytes per id (2 or 4), ids
    check     4 bytes   masked CRC-32 of the payload
    newline   1 byte

A checksum is masked by rotating it right by 15 bits and adding a constant, so that a checksum of data that
holds checksums keeps its worth. Files are in ascending doc_id order by part number and roll number, as are
the frames in them. The index has a row per record: file, offset and length to read it alone, and its start,
the number of ids before it.

Cases. A null text is an empty document: its record holds the end id only. A null doc_id comes first. Rows
with equal doc_id are all written, in order of a digest of the text. An empty table gives a folder without
records and no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docassay.llm.common import materialise, record_batch
from docassay.llm.pieces import Chunks

# Fixed value: the constant that masked checksums of record files add.
MASK_DELTA = 0xA282EAD8
END = b"\n"

INDEX_SCHEMA = "file string, part int, roll int, pos long, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, before long"
INDEX_ARROW = pa.schema([("file", pa.string()), ("part", pa.int32()), ("roll", pa.int32()), ("pos", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("before", pa.int64())])


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record, without its newline; ids are little-endian, ``width`` bytes each."""
    payload = struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def frames(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """Offset, length, doc_id and ids of each record of a file; raises ValueError on any damage."""
    at = 0
    while at < len(data):
        head = data[at : at + 8]
        if len(data) < at + 12 or masked_crc(head) != int.from_bytes(data[at + 8 : at + 12], "little"):
            raise ValueError(f"the length at byte {at} is damaged")
        stop = at + 12 + int.from_bytes(head, "little")
        payload = data[at + 12 : stop]
        if masked_crc(payload) != int.from_bytes(data[stop : stop + 4], "little") or data[stop + 4 : stop + 5] != END:
            raise ValueError(f"the record at byte {at} is damaged")
        doc_id, null, width = struct.unpack_from("<qBB", payload)
        yield at, stop + 5 - at, None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10)
        at = stop + 5


_encoders: dict[str, Chunks] = {}


def text_encoder(path: str) -> Chunks:
    """The worker's cached encoder for a byte-level file of the tokenizers library, ids as little-endian u32."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode(texts: list[str]) -> list[bytes]:
            if sys.byteorder == "big" or array("I").itemsize != 4:
                return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        tokens = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
        leads = np.array([t.startswith("\u0120") for t in tokens])  # byte-level files write a space so
        special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        _encoders[path] = Chunks(encode, leads, special)
    return _encoders[path]


def write_records(documents: DataFrame, path: str, tokenizer: str, end_id: int, *, bundle_bytes: int = 1 << 20, bundles_per_file: int = 32) -> None:
    """Encode every text, end it with ``end_id`` and write the records in ascending doc_id order."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def bundles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail, held, size = text_encoder(tokenizer), struct.pack("<I", end_id), [], 0
        emit = lambda: pa.RecordBatch.from_pydict({"value": pa.array([END.join(held)], pa.binary())})
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode_texts(part.column(1).to_pylist())):
                    wide = np.frombuffer(ids + tail, "<u4")
                    width = 2 if wide.max() < 1 << 16 else 4
                    held.append(frame(doc_id, wide.astype(f"<u{width}").tobytes(), width))
                    size += len(held[-1])
                    if size >= bundle_bytes:
                        yield emit()
                        held, size = [], 0
        if held:
            yield emit()

    out = docs.mapInArrow(bundles, "value binary")
    # The text writer stores the bytes of a string as they are.
    out.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", bundles_per_file).text(path)


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the files (INDEX_SCHEMA): place, doc_id, ids counted and checked; before counts ids within the file."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name = file.rpartition("/")[2]
                part, roll = int(name.split("-")[1]), int(name.split("-c")[-1].split(".")[0])
                rows, before = [], 0
                for pos, (offset, length, doc_id, ids) in enumerate(frames(content.as_py())):
                    rows.append((name, part, roll, pos, offset, length, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                    before += len(ids)
                yield record_batch(rows, INDEX_ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(scan, INDEX_SCHEMA)


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Scan the files below ``path``, write their offset index to ``index`` and return it.

    Starts come from sums of two levels: files within their part, in windows by part, and parts one after
    another. The sums of parts are a number per task that wrote records, so their window is small at any size.
    """
    scanned = materialise(scan_records(spark, path), "scan")
    files = scanned.groupBy("part", "roll").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("part").orderBy("roll").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = files.groupBy("part").agg(F.sum("n").alias("m"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("earlier", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    placed = scanned.join(files.join(parts, "part").select("part", "roll", (F.col("earlier") + F.col("inside")).alias("base")), ["part", "roll"])
    placed.select("file", "offset", "length", "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32").write.parquet(index)
    return spark.read.schema("file string, offset long, length long, doc_id long, start long, n_tokens long, ids_crc32 long").parquet(index)


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int, *, shards: int = 64) -> DataFrame:
    """doc_id, ids (array), shard, place: the records that ``index`` names, cut out by offset and length, in a seeded order.

    ``index`` is write_index()'s table or some of its rows. A record's shard and place come from a hash of seed and position, so an
    epoch is the same on every run and another for every seed; a shard lies in one partition, in order of place. Checksums
    are verified as records are read; a file is read by one task however many of its records are asked for.
    """
    wanted = index.select("file", "offset", "length").distinct().groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("cuts"))
    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"), "content").join(wanted, "file")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, cuts in zip(batch.column("file").to_pylist(), batch.column("content"), batch.column("cuts").to_pylist()):
                data = content.as_py()
                for at in range(0, len(cuts), 256):
                    rows = []
                    for c in cuts[at : at + 256]:
                        ((_, _, doc_id, ids),) = frames(data[c["offset"] : c["offset"] + c["length"]])
                        rows.append((file, c["offset"], doc_id, ids.astype(np.int64).tolist()))
                    yield record_batch(rows, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    read = files.mapInArrow(cut, "file string, offset long, doc_id long, ids array<long>").withColumn("place", F.xxhash64(F.lit(seed), "file", "offset"))
    placed = read.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "file", "offset"), F.lit(shards)).cast("int"))
    return placed.select("doc_id", "ids", "shard", "place").repartition(shards, "shard").sortWithinPartitions("shard", "place")
