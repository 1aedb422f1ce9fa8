"""Byte-level BPE by Spark's higher-order functions, over distinct words and a literal rank map.

A word is an array of numbers between two sentinels, one for each of its bytes' ids: the rank of the pair it begins
in the high bits, then its place, then the id. So the least number is the least rank, leftmost first; one step
of the fold takes it, puts the merged id in place and looks up the two ranks that change. The rank map is
literal arrays: a pair (a, b) stands at ``offset[a] + b`` and the entry names its owner a, so one addition finds any
pair (rows of a sparse matrix laid over one another). The arrays are written once, as a table of one row, and plans
take that row as a scalar subquery: tasks get the same constants, packed, and no plan prints or copies them.

Texts are cut into words by groups of some megabytes: the distinct pieces between single spaces are cut once per
group and texts are put together from them as numbers of words, by Arrow's dictionaries and takes.

The words of the corpus are counted; the frequent ones, at most ``frequent_limit``, are folded once and
their ids handed to every task. The other words are folded where they stand, each once per task as far as the
task's memory of words reaches, else once per group of texts. So nothing that grows with the corpus is broadcast, no text is shuffled and no word goes without its fold.
Only words that are tokens themselves skip it, as they do in the library whose results these are.

Decoding concatenates the byte pieces of the ids.

Cases. A null or empty text has no ids. Invalid surrogates can't occur in Spark strings. Repeated rows and
ties in counts change nothing. A null doc_id stays null. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm.common import give_back, materialise, record_batch, short_batches

#: Ranks are below; it marks a pair that doesn't merge.
NONE = 1 << 20
#: Bytes of text whose words are cut together, about.
GROUP = 4_000_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
MARKED_ARROW = pa.schema([("doc_id", pa.int64()), ("since", pa.int64()), ("marked", pa.binary()), ("rare", pa.list_(pa.string()))])
COUNT_ARROW = pa.schema([("word", pa.string()), ("n", pa.int64())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Every pair of ids whose bytes together are a token, with that token's id."""
    out = {}
    for token, merged in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                out[a, b] = merged
    return out


def overlay(pairs: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """offset by left id, and the entries ``a * NONE + merged`` (-1: free); rows with most pairs are placed first."""
    by_left: dict[int, list[tuple[int, int]]] = {}
    for (a, b), merged in pairs.items():
        by_left.setdefault(a, []).append((b, merged))
    top = max((max(p) for p in pairs), default=0) + 1
    low, width = top, 4096  # offsets are tried a stretch at a time, from the first that isn't full
    entries = np.full(8 * len(pairs) + 8 * top + 2 * width, -1, np.int64)
    taken = np.zeros(len(entries), bool)
    offset = np.full(top, 2 * top, np.int64)
    for a, row in sorted(by_left.items(), key=lambda x: (-len(x[1]), x[0])):
        columns = np.array(sorted(b for b, _ in row))
        while taken[low : low + width].all():
            low += width
        at = low - int(columns[0])
        while True:
            free = ~np.logical_or.reduce([taken[at + c : at + c + width] for c in columns])
            if free.any():
                at += int(free.argmax())
                break
            at += width
        offset[a] = at
        taken[at + columns] = True
        for b, merged in row:
            entries[at + b] = a * NONE + merged
    return offset, entries[: int(np.flatnonzero(taken).max(initial=0)) + top + 1]


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row, ``map``: the arrays of the rank map. Its size is the vocabulary's, a few megabytes."""
    offset, entries = overlay(merge_pairs(ranks))
    arrays = {
        "offsets": np.append(offset, np.full(max(0, max(ranks.values(), default=0) + 2 - len(offset)), 2 * len(entries))).astype(np.int32),
        "entries": np.where(entries < 0, 1 << 61, entries),
        "byte_ids": np.array([ranks[bytes([b])] for b in range(256)], np.int64),
    }
    columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in arrays.values()]
    row = pa.table({"map": pa.StructArray.from_arrays(columns, names=list(arrays))})
    return materialise(spark.createDataFrame(row).coalesce(1), "ranks")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once: the end of a fold over nothing, which copies no array as a transform would."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def fold_word(word: Column, end: int, offsets: Column, entries: Column, byte_ids: Column) -> Column:
    """The ids of a word, by the arrays of rank_table(); ``end`` is the sentinel's id, without row or column.

    A number has ``bits`` for the id, so many and one more for the rank at the top, and the others for the place.
    """
    bits = end.bit_length()
    top = 62 - bits
    long = lambda x: F.lit(x).cast("long")
    none, id_mask, place_mask = 1 << bits, (1 << bits) - 1, (1 << top) - (1 << bits)

    def rank(a: Column, b: Column) -> Column:
        # Another owner leaves bits of NONE or more, an entry that doesn't exist is null: both are no merge.
        entry = F.get(entries, F.get(offsets, a.cast("int")) + b.cast("int"))
        return F.shiftleft(F.least(entry.bitwiseXOR(F.shiftleft(a, NONE.bit_length() - 1)), long(none)), top)

    def merge(state: Column, least: Column) -> Column:
        merged = F.shiftright(least, top)

        def put(p: Column) -> Column:
            left, right = F.get(state, p - 2), F.get(state, p + 1)
            changed = F.array(
                rank(left.bitwiseAND(long(id_mask)), merged).bitwiseOR(left.bitwiseAND(long(place_mask + id_mask))),
                rank(merged, right.bitwiseAND(long(id_mask))).bitwiseOR(least.bitwiseAND(long(place_mask))).bitwiseOR(merged),
            )
            return F.concat(F.slice(state, 1, p - 2), changed, F.slice(state, p + 2, F.size(state)))

        return _let(F.array_position(state, least).cast("int"), put)

    def step(state: Column, _: Column) -> Column:
        return _let(F.array_min(state), lambda least: F.when(least < long(none << top), merge(state, least)).otherwise(state))

    sentinel = F.array(long(end))
    each = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(byte_ids, F.ascii(c)))
    number = lambda ids: lambda a, i: rank(a, F.coalesce(F.get(ids, i + 1), long(end))).bitwiseOR(F.shiftleft(i.cast("long"), bits)).bitwiseOR(a)
    start = _let(F.concat(sentinel, each, sentinel), lambda ids: F.transform(ids, number(ids)))
    done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1))), start, step)
    return _let(done, lambda state: F.transform(F.slice(state, 2, F.size(state) - 2), lambda x: x.bitwiseAND(long(id_mask)).cast("int")))


def fold_words(df: DataFrame, column: str, table: DataFrame, end: int) -> DataFrame:
    """``df`` with the array of words in ``column`` as an array of their ids; null stays null."""
    # The map is named once, so the optimizer puts the subquery where it is used and no row carries it.
    held = df.withColumn("_ranks", table.select("map").scalar())

    def fold(ranks: Column) -> Column:
        return _let(ranks["offsets"], lambda o: _let(ranks["entries"], lambda e: _let(ranks["byte_ids"], lambda b: F.transform(column, lambda x: fold_word(x, end, o, e, b)))))

    return held.select(*[c for c in df.columns if c != column], _let(F.col("_ranks"), fold).alias(column))


def groups(batches: Iterable[pa.RecordBatch], column: str, size: int = GROUP) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of ``column``."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 20):
            held.append(part := batch.slice(at, 20))
            n += part.column(column).nbytes
            if n >= size:
                group, held, n = pa.concat_batches(held), [], 0
                yield group
    if held:
        yield pa.concat_batches(held)


def _pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at every space: where each text's pieces begin, every piece as a number, and the distinct pieces."""
    cut = pc.split_pattern(pc.fill_null(texts, ""), " ")
    flat = cut.flatten().dictionary_encode()
    return cut.offsets.to_numpy() - cut.offsets[0].as_py(), flat.indices.to_numpy(), flat.dictionary.to_pylist()


def _stand(pieces: list[str]) -> np.ndarray:
    """Which pieces can be cut by themselves behind a space: those that neither begin nor end with white space."""
    return np.array([p != "" and p.strip() == p for p in pieces], bool)


def _led_words(pieces: list[str], find: Callable[[str], list[str]]) -> tuple[pa.Array, np.ndarray]:
    """The words of pieces that stand by themselves behind a space each, cut as one text, and how many each has."""
    words = pa.array(find(" " + " ".join(pieces)) if pieces else [], pa.string())
    starts = np.flatnonzero(pc.starts_with(words, " ").to_numpy(zero_copy_only=False))
    if len(starts) != len(pieces):
        raise ValueError("the pattern doesn't keep space-led pieces apart")
    return words, np.diff(starts, append=len(words))


def cut_texts(texts: pa.Array, find: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all texts as numbers, where each text's words end, and the distinct words.

    A text whose single spaces all stand between other characters is its first piece and the space-led ones,
    each cut by itself; any other is cut whole.
    """
    begins, codes, distinct = _pieces(texts)
    n, heads, row = len(texts), begins[:-1], np.repeat(np.arange(len(texts)), np.diff(begins))
    good = _stand(distinct)[codes]
    good[heads] = [distinct[c] != "" and not distinct[c][-1].isspace() for c in codes[heads].tolist()]
    chain = np.bincount(row[~good], minlength=n) == 0
    led = chain[row]
    led[heads] = False
    pieces = np.unique(codes[led])
    words, sizes = _led_words([distinct[c] for c in pieces.tolist()], find)
    own = [find(distinct[c] if whole else text or "") for c, whole, text in zip(codes[heads].tolist(), chain.tolist(), pc.if_else(chain, None, texts).to_pylist())]
    coded = pa.concat_arrays([words, pa.array([w for x in own for w in x], pa.string())]).dictionary_encode()
    sizes = np.concatenate([sizes, np.array([len(x) for x in own], np.int64)])
    # The units of a text: its head's number lies behind those of the pieces.
    number = np.zeros(len(distinct), np.int64)
    number[pieces] = np.arange(len(pieces))
    units = number[codes]
    units[heads] = len(pieces) + np.arange(n)
    led[heads] = True
    units, row = units[led], row[led]
    cut = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int64()), coded.indices)
    ends = np.cumsum(np.bincount(row, weights=sizes[units], minlength=n)).astype(np.int64)
    return cut.take(pa.array(units)).flatten().to_numpy(), ends, coded.dictionary


def count_words(documents: DataFrame, pattern: str) -> DataFrame:
    """word, n over all texts; tasks send sums, never single words."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for group in groups(batches, "text", 4 * GROUP):
            # A first piece counts as if a space led it, and where one can't be cut off by itself the count may name words a little off; it only ranks them.
            _, codes, distinct = _pieces(group.column("text"))
            n, good = np.bincount(codes, minlength=len(distinct)), _stand(distinct)
            words, sizes = _led_words([p for p, g in zip(distinct, good.tolist()) if g], find)
            odd = [find(" " + p) if p else [] for p, g in zip(distinct, good.tolist()) if not g]
            counts = pa.table([pa.concat_arrays([words, pa.array([w for x in odd for w in x], pa.string())]), np.append(np.repeat(n[good], sizes), np.repeat(n[~good], [len(x) for x in odd]))], ["word", "n"])
            sums = counts.group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
            yield from sums.cast(COUNT_ARROW).combine_chunks().to_batches()
        give_back()

    return documents.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _is_text(token: bytes) -> bool:
    try:
        return token.decode() is not None
    except UnicodeDecodeError:
        return False


def unpack(data: bytes) -> tuple[pa.Array, pa.LargeListArray]:
    """The words and their ids that pack() was given, as they lie there."""
    held = pa.ipc.open_stream(data).read_all().combine_chunks()
    return held.column(0).combine_chunks(), long_lists(held.column(1).combine_chunks())


def long_lists(lists: pa.ListArray) -> pa.LargeListArray:
    """Lists whose takes may hold more than 2^31 values."""
    return pa.LargeListArray.from_arrays(lists.offsets.cast(pa.int64()), lists.values.cast(pa.int32()))


def pack(table: pa.Table) -> bytes:
    """An Arrow table of words and their ids as bytes: neither driver nor tasks need a dictionary of Python's."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def frequent_words(documents: DataFrame, ranks: dict[bytes, int], pattern: str, limit: int, table: DataFrame, end: int) -> bytes:
    """Ids (little-endian u32) of the most frequent words, at most ``limit``, and of all words that are tokens."""
    counts = materialise(count_words(documents, pattern), "words")
    least, room = 1 << 62, limit
    # Distinct counts: their number grows with the root of the corpus at most.
    for row in counts.groupBy("n").count().orderBy(F.col("n").desc()).toLocalIterator():
        room -= row["count"]
        if room < 0:
            break
        least = row["n"]
    chosen = counts.where(F.col("n") >= least).select("word", F.array("word").alias("ids"))
    folded = fold_words(chosen, "ids", table, end).select("word", F.get("ids", F.lit(0)).alias("ids")).toArrow()
    own = [(t.decode(), [i]) for t, i in ranks.items() if _is_text(t)]
    words, ids = zip(*own) if own else ((), ())
    known = pa.table([pa.array(c, t) for c, t in zip((words, ids), folded.schema.types)], schema=folded.schema)
    folded = folded.filter(pc.invert(pc.is_in(folded.column("word"), known.column("word").combine_chunks())))
    return pack(pa.concat_tables([known, folded]))


def encode_documents(documents: DataFrame, rank_path: str, pattern: str, *, frequent_limit: int = 300_000, recent_limit: int = 100_000) -> DataFrame:
    """A row per document, SCHEMA."""
    short_batches(documents.sparkSession)
    sc = documents.sparkSession.sparkContext
    ranks = read_ranks(rank_path)
    table, end = rank_table(documents.sparkSession, ranks), max(ranks.values(), default=0) + 1
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = sc.broadcast(frequent_words(docs, ranks, pattern, frequent_limit, table, end))
    names = {i: token for token, i in ranks.items()}
    tokens = sc.broadcast([names.get(i, b"") for i in range(end)])

    # The two functions below stand in one task, one behind the other, and see the same rows in the same order. The
    # first writes texts as numbers of words: a frequent word's is its place, rarer words are numbered behind them as
    # the task meets them and sent in rows of their own before the texts that have them. The second keeps their ids. Both
    # remember the first ``recent_limit``; those from there on that a group before ``since`` had are numbered anew.
    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, (known, _) = regex.compile(pattern).findall, unpack(frequent.value)
        sent, met = {}, 0
        for group in groups(batches, "text"):
            since = met
            codes, ends, words = cut_texts(group.column("text"), find)
            numbers = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
            rare, new = np.flatnonzero(numbers < 0), []
            for place, word in zip(rare.tolist(), words.take(pa.array(rare)).to_pylist()):
                if (number := sent.get(word)) is None:
                    number = met
                    if met < recent_limit:
                        sent[word] = met
                    met += 1
                    new.append(word)
                numbers[place] = len(known) + number
            for at in range(0, len(new), 100_000):
                parts = [new[i : i + 1000] for i in range(at, min(at + 100_000, len(new)), 1000)]
                yield record_batch([(None, since, None, part) for part in parts], MARKED_ARROW)
            raw, ends = numbers.astype("<u4")[codes].tobytes(), [0, *(4 * ends).tolist()]
            rows = [(doc_id, since, raw[a:b], None) for doc_id, a, b in zip(group.column("doc_id").to_pylist(), ends, ends[1:])]
            yield record_batch(rows, MARKED_ARROW)
        del sent
        give_back()

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, known = unpack(frequent.value)
        token_bytes = pa.array(tokens.value, pa.large_binary())
        kept, forgotten = known.slice(0, 0), 0
        for batch in batches:
            kept = pa.concat_arrays([kept, long_lists(batch.column("rare").flatten())])
            pool, texts = pa.concat_arrays([known, kept]), batch.filter(pc.is_valid(batch.column("marked")))
            for part in groups([texts], "marked", GROUP // 2):
                marked = part.column("marked").to_pylist()
                numbers = np.frombuffer(b"".join(marked), "<u4").astype(np.int64)
                numbers[numbers >= len(known) + recent_limit] -= forgotten
                lists = pool.take(pa.array(numbers))
                ids = lists.flatten()
                names = token_bytes.take(ids)
                ends = lists.offsets.to_numpy()[np.cumsum([0, *(len(m) // 4 for m in marked)])]
                raw, places = ids.to_numpy().astype("<u4").tobytes(), ends.tolist()
                decoded, cuts = memoryview(names.buffers()[2] or b""), np.frombuffer(names.buffers()[1], np.int64)[ends].tolist()
                yield record_batch([
                    (doc_id, b - a, hashlib.sha256(raw[4 * a : 4 * b]).hexdigest(), hashlib.sha256(decoded[c:d]).hexdigest())
                    for doc_id, a, b, c, d in zip(part.column("doc_id").to_pylist(), places, places[1:], cuts, cuts[1:])
                ], ARROW)
            if batch.num_rows and (before := batch.column("since")[-1].as_py() - recent_limit) > forgotten:
                kept, forgotten = pa.concat_arrays([kept.slice(0, recent_limit), kept.slice(recent_limit + before - forgotten)]), before
        del kept
        give_back()

    marked = docs.mapInArrow(mark, "doc_id long, since long, marked binary, rare array<string>")
    return fold_words(marked, "rare", table, end).mapInArrow(finish, SCHEMA)
