"""Periodic runs of words, found by bit-parallel lags over big integers.

A text's words get ids, and bit b of all ids is one big integer, a plane. Where a plane differs from itself
shifted by a lag q, words q apart differ; the OR over the planes marks every such place, and a stretch of zeros
is a stretch of words with period q. ANDing the matches with themselves shifted by 1, 2, 4 and so on leaves a bit
where a stretch of at least ``max(least, exponent * q) - q`` zeros begins, so long stretches stand out without a
walk over the words. Lags go upwards; a stretch that lies in a run of a smaller period is not a run of its own,
since its smallest period is that one.

Lags to try. Lags below 8 are all tried. For lags in [2^j, 2^(j+1)) every run of that period covers a place a that
is a multiple of 2^(j+1) with 2 q words of the run behind it, so the words [a, a + 2^j) and those q further are the
same. Their hashes (of 1, 2, 4, ... words, each from the two halves before) are compared at all those places, n / 2
comparisons for each j, and the lags that agree anywhere are tried. Places inside a known run of a smaller period
that goes on for 2 q words are left out: two periods can't share that many words. No run is lost, and a text of
n words costs n log n and a pass of planes for each lag that does occur, instead of n / 4 passes.

Cases. A null or empty text has no words, no runs and an empty collapsed text. A null doc_id plants nothing. Every
row is judged by itself, repeated ones alike. An empty table gives no rows. Extra columns are ignored. A text is
held whole by the task that has its row, beside (log n) planes of n bits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docassay.llm.common import record_batch, short_batches

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

#: start, length, smallest period; in words.
Run = tuple[int, int, int]


def number(words: list) -> np.ndarray:
    """Words as small numbers in order of appearance."""
    ids: dict = {}
    return np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of every id as one big integer, the first word in the lowest bit."""
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(int(ids.max()).bit_length())]


def places(bits: int) -> np.ndarray:
    """The set bits of a big integer."""
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def stretches(levels: list[int], n: int, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of words with period q, of at least ``least`` words."""
    differ = 0
    for p in levels:
        differ |= p ^ (p >> q)
    same = ~differ & ((1 << (n - q)) - 1)
    need, have = least - q, 1
    while have < need and same:
        step = min(have, need - have)
        same &= same >> step
        have += step
    return places(same & ~(same << 1)), places(same & ~(same >> 1)) + need + q


def candidate_lags(hashes: np.ndarray, n: int, low: int, reach: np.ndarray) -> list[int]:
    """Lags in [low, 2 low) that a run can have; ``hashes`` are of the ``low`` words from each place on."""
    step = 2 * low
    anchors = np.arange(0, n - step + 1, step)
    if not len(anchors):
        return []
    padded = np.concatenate([hashes, np.zeros(int(anchors[-1]) + step + 1 - len(hashes), np.uint64)]) if len(hashes) <= anchors[-1] + step else hashes
    following = np.lib.stride_tricks.as_strided(padded[low:], (len(anchors), low), (step * padded.itemsize, padded.itemsize), writeable=False)
    k, d = np.nonzero(hashes[anchors][:, None] == following)
    a, end = anchors[k], anchors[k] + 2 * (low + d)
    # Left out: too near to the text's end, or inside a known run, whose period is smaller, for 2 q words.
    return (low + np.unique(d[(end <= n) & (reach[a] < end)])).tolist()


def find_runs(words: list, *, least: int = 6, exponent: int = 4) -> list[Run]:
    """All runs with length >= max(least, exponent * period), by start, then period; ``exponent`` is 4 or more."""
    n = len(words)
    if n < least:
        return []
    ids = number(words)
    levels = planes(ids)
    runs: list[Run] = []
    reach = np.zeros(n, np.int64)  # how far the known runs go that begin at a place or before it

    def take(q: int) -> None:
        if max(least, exponent * q) > n:
            return
        starts, ends = stretches(levels, n, q, max(least, exponent * q))
        own = reach[starts] < ends
        if own.any():
            runs.extend((s, e - s, q) for s, e in zip(starts[own].tolist(), ends[own].tolist()))
            np.maximum.at(reach, starts[own], ends[own])
            np.maximum.accumulate(reach, out=reach)

    for q in range(1, 8):
        take(q)
    hashes, low = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    while 2 * low * exponent <= n:
        half = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = half[: len(half) - low] + (hashes[low:] ^ (hashes[low:] >> np.uint64(31)))
        low *= 2
        if low >= 8:
            for q in candidate_lags(hashes, n, low, reach):
                take(q)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period; of equals the one with the least start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list, runs: list[Run]) -> list:
    """The words without those that a run repeats: all behind the first period of each run go."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    return words if kept.all() else [w for w, k in zip(words, kept.tolist()) if k]


def plant(words: list, doc_id: int | None) -> list:
    """A tenth of documents, by the checksum of doc_id, repeat a stretch of their words to the end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def detect_runs(documents: DataFrame, *, least: int = 6, exponent: int = 4, change: Callable[[list, int | None], list] | None = None) -> DataFrame:
    """A row per document, SCHEMA. ``change`` gets the words (UTF-8) and doc_id and returns the words to judge."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()  # of bytes: splits at space and the controls 9 to 13 alone
                if change:
                    words = change(words, doc_id)
                runs = find_runs(words, least=least, exponent=exponent)
                best = strongest(runs)
                top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
                rows.append((doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()))
            yield record_batch(rows, ARROW)

    short_batches(documents.sparkSession)
    return documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(judge, SCHEMA)


def collapse_runs(documents: DataFrame, *, least: int = 6, exponent: int = 4) -> DataFrame:
    """The documents, all columns, with runs collapsed: words joined by single spaces where a run was found, else the text as it is."""

    def shorten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = batch.schema.get_field_index("text"), []
            for text in batch.column(at):
                text = text.as_py()
                words = (text or "").encode().split()
                runs = find_runs(words, least=least, exponent=exponent)
                out.append(b" ".join(collapse(words, runs)).decode() if runs else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    short_batches(documents.sparkSession)
    return documents.mapInArrow(shorten, documents.schema)
