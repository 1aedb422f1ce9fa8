"""Near-duplicate documents by DartMinHash over weighted word shingles.

Terms are runs of five words (a shorter text is one term), weighted by how often they occur. Every unit of a
term's weight is a region into which darts are thrown: their heights are the points of a Poisson process, their
coordinates are uniform, all from hashes of term, unit and number, so texts share the darts of the regions they
share. A text takes the darts in its regions below a ceiling that leaves no coordinate empty (k ln k + 2 k darts,
doubled where that is too few), and keeps the lowest dart of each coordinate. Two texts share it with a
probability of their generalised Jaccard similarity.

Search. Texts with the same words are one; the signature's bands of rows are buckets. In a bucket of up to
``small`` texts every pair is a candidate; candidates whose signatures agree too little for the threshold are
dropped, the rest are compared exactly. Texts that larger buckets tie together form a group. A group is dealt
into blocks of bounded size, and every two blocks are compared in a task of their own, all pairs exactly, by
products of sparse rows; two blocks give a count for each text and the trees that tie their texts together,
never pairs. Pairs within a group are compared there alone, so a link is counted once. Classes are the connected
components of pairs at or above the threshold. Joins on keys that many rows bear are salted, so no bucket, group,
class or text with many copies meets in one task, and nothing comes to the driver but counts. The work on a group
grows with the square of its texts, the data moved with its texts times its blocks.

Cases. Null and empty texts have no words and are copies of one another. Texts that differ in white space only
are copies. A class is named by the least doc_id in it. A null doc_id makes its row a class of its own, named
null, with no links. Rows with equal doc_id are one document: the text with the lowest digest speaks for it, and
all have its class. An empty table gives no rows. Columns other than doc_id and text are ignored by
near_duplicates() and kept by keep_one(), which keeps one row of each class and every row without a doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm.common import Scratch, join_hot, whole_row, words

WORDS = 5
#: A pair at similarity 0.8 shares a band with a probability of 1 - (1 - 0.8 ** 5) ** 19, above 0.999.
BANDS, ROWS = 19, 5
K = BANDS * ROWS
#: Texts and words of a block at most, on average; two blocks are held in a task.
BLOCK_TEXTS, BLOCK_WORDS = 2048, 1 << 19
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(word_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct terms (u64) and their weights of a text's word hashes."""
    h = word_hashes.astype(np.int64).view(np.uint64)
    if not len(h):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), np.uint64)
    for i in range(min(len(h), WORDS)):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out, return_counts=True)


def regions(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A name (u64) for every unit of weight: the terms of two texts overlap in as many as they share."""
    firsts = np.cumsum(weights) - weights
    place = (np.arange(int(weights.sum())) - np.repeat(firsts, weights)).astype(np.uint64)
    return _mix(np.repeat(terms, weights) ^ _mix(place + _U(1)))


def regions_of(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The regions (u64) of all texts, given as word hashes, and the text of each; a text's regions are in one run."""
    sizes = np.array([len(h) for h in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    flat = np.concatenate([np.asarray(h, np.int64) for h in texts]).view(np.uint64) if len(texts) else np.empty(0, np.uint64)
    n = max(0, len(flat) - WORDS + 1)
    terms = np.full(n, WORDS, np.uint64)
    for i in range(WORDS):
        terms = _mix(terms * _U(0x9E3779B97F4A7C15) + flat[i : i + n])
    inside = owner[:n] == owner[WORDS - 1 :] if n else np.empty(0, bool)
    short = [(i, shingles(texts[i])[0]) for i in np.flatnonzero((sizes > 0) & (sizes < WORDS))]
    terms, owner = np.concatenate([terms[inside], *[t for _, t in short]]), np.concatenate([owner[:n][inside], *[[i] for i, _ in short]]).astype(np.int64)
    order = np.lexsort((terms, owner))
    terms, owner = terms[order], owner[order]
    at = np.arange(len(terms))
    fresh = np.ones(len(terms), bool)
    fresh[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
    place = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return _mix(terms ^ _mix(place + _U(1))), owner


def signatures(region: np.ndarray, owner: np.ndarray, n_texts: int, k: int = K) -> np.ndarray:
    """Per text the names (u64) of the lowest darts per coordinate; zeros for a text without regions."""
    best, name = np.full(n_texts * k, np.inf), np.zeros(n_texts * k, np.uint64)
    counts = np.bincount(owner, minlength=n_texts)
    number = np.ones(len(region), np.uint64)
    dart = lambda at: _mix(region[at] + number[at] * _U(0x9E3779B97F4A7C15))
    rise = lambda d: -np.log(((d >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
    height = rise(dart(slice(None)))
    ceiling = (k * math.log(k) + 2 * k) / np.maximum(counts, 1)  # with so many darts most texts have one per coordinate
    open_ = counts > 0
    while open_.any():
        slots, heights, names = [], [], []
        below = np.flatnonzero((height < ceiling[owner]) & open_[owner])
        while len(below):
            d = dart(below)
            slots.append(owner[below] * k + (_mix(d ^ _U(0x5851F42D4C957F2D)) % _U(k)).astype(np.int64))
            heights.append(height[below])
            names.append(d)
            number[below] += _U(1)
            height[below] += rise(dart(below))
            below = below[height[below] < ceiling[owner[below]]]
        if slots:
            slot, low, d = map(np.concatenate, (slots, heights, names))
            np.minimum.at(best, slot, low)
            won = low == best[slot]
            name[slot[won]] = d[won]
        open_ &= ~np.isfinite(best.reshape(n_texts, k)).all(1)
        ceiling[open_] *= 2
    return name.reshape(n_texts, k)


def dart_signature(terms: np.ndarray, weights: np.ndarray, k: int = K) -> np.ndarray:
    """The signature of one text, given as terms and weights."""
    region = regions(terms, weights)
    return signatures(region, np.zeros(len(region), np.int64), 1, k)[0]


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _sketch(hashes: Column) -> Column:
    """Band keys, and one byte of each sample; texts are worked on together up to a number of words."""

    @F.pandas_udf("bands array<bigint>, bytes binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bands, marks = [], []
            texts = [np.asarray(h, np.int64) for h in batch]
            at = 0
            while at < len(texts):
                stop, size = at + 1, len(texts[at])
                while stop < len(texts) and size + len(texts[stop]) <= 20_000 and stop - at < 64:
                    size += len(texts[stop])
                    stop += 1
                found = signatures(*regions_of(texts[at:stop]), stop - at)
                key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (stop - at, 1))
                for row in range(ROWS):
                    key = _mix(key * _U(0x9E3779B97F4A7C15) + found[:, row::ROWS])
                bands.extend(key.view(np.int64))
                marks.extend(m.tobytes() for m in (_mix(found) & _U(255)).astype(np.uint8))
                at = stop
            yield pd.DataFrame({"bands": bands, "bytes": marks})

    return sketch(hashes)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Generalised Jaccard of the shingles of two texts, given as word hashes."""
    (s, m), (t, n) = shingles(np.asarray(a, np.int64)), shingles(np.asarray(b, np.int64))
    _, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
    shared = int(np.minimum(m[i], n[j]).sum())
    return shared / max(1, int(m.sum()) + int(n.sum()) - shared)


def _similarity(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(p, q) for p, q in zip(x, y)], dtype="float64")

    return compare(a, b)


def _agreement(a: str, b: str) -> Column:
    """How many samples agree in their byte."""

    @F.pandas_udf("int")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([int((np.frombuffer(p, np.uint8) == np.frombuffer(q, np.uint8)).sum()) for p, q in zip(x, y)], dtype="int32")

    return agree(a, b)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Generalised Jaccard of every text of one list with every text of the other, given as word hashes.

    Regions that many texts of both sides have are columns of two dense matrices, multiplied; the texts of the
    rarer ones are paired region by region.
    """
    (x, i), (y, j) = regions_of(left), regions_of(right)
    p, q = len(left), len(right)
    m, n = np.bincount(i, minlength=p), np.bincount(j, minlength=q)
    common = np.intersect1d(x, y)
    shared = np.zeros((p, q), np.float32)
    if len(common):
        (c, i), (d, j) = _among(x, i, common), _among(y, j, common)
        one, two = np.bincount(c, minlength=len(common)), np.bincount(d, minlength=len(common))
        often = one * two * 64 > p * q
        dense = np.flatnonzero(often)
        place = np.full(len(common), -1)
        for start in range(0, len(dense), 2048):
            part = dense[start : start + 2048]
            place[part] = np.arange(len(part))
            a, b = np.zeros((p, len(part)), np.float32), np.zeros((q, len(part)), np.float32)
            for matrix, own, col in ((a, i, c), (b, j, d)):
                hit = place[col] >= 0
                matrix[own[hit], place[col[hit]]] = 1
            shared += a @ b.T
            place[part] = -1
        # Rare regions: entries sorted by region; each left entry meets the right entries of its region.
        keep, order = ~often[c], np.argsort(d, kind="stable")
        c, i, j = c[keep], i[keep], j[order]
        first = np.cumsum(two) - two
        lengths = two[c]
        ends = np.cumsum(lengths)
        flat = shared.reshape(-1)
        at = 0
        while at < len(c):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")))
            size = lengths[at:stop]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pair = np.repeat(i[at:stop], size) * q + j[np.repeat(first[c[at:stop]], size) + inner]
            np.add.at(flat, pair, np.float32(1))
            at = stop
    return shared / np.maximum(1, m[:, None] + n[None, :] - shared.astype(np.float64))


def _among(names: np.ndarray, owner: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place among ``common`` and the owner of each name that is one of them."""
    at = np.minimum(np.searchsorted(common, names), len(common) - 1)
    hit = common[at] == names
    return at[hit], owner[hit]


def _compare_blocks(threshold: float):
    """For two blocks of a group: id, root (the least id its links lead to here) and n, its links, of each linked text."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        one, two = rows[rows["block"] == i], rows[rows["block"] == j]
        if one.empty or two.empty:
            return pd.DataFrame({"id": [], "root": [], "n": []}, dtype="int64")
        near = overlaps(one["h"].to_list(), two["h"].to_list()) >= threshold
        if i == j:
            np.fill_diagonal(near, False)
        ids, others = one["id"].to_numpy(np.int64), two["id"].to_numpy(np.int64)
        top = np.iinfo(np.int64).max
        low, high = ids.copy(), others.copy()
        while True:
            low_next = np.minimum(low, np.where(near, high[None, :], top).min(1))
            high_next = np.minimum(high, np.where(near, low_next[:, None], top).min(0))
            if (low_next == low).all() and (high_next == high).all():
                break
            low, high = low_next, high_next
        if i != j:  # a block with itself has each text and link on either side
            ids, low, n = np.concatenate([ids, others]), np.concatenate([low, high]), np.concatenate([near.sum(1), near.sum(0)])
        else:
            n = near.sum(1)
        return pd.DataFrame({"id": ids, "root": low, "n": n.astype(np.int64)})[n > 0]

    return compare


def components(members: DataFrame, rounds: int = 60) -> DataFrame:
    """id, root (the least id of its component) for every id in ``members`` (id, key): ids with a key in common are tied.

    Each round gives every key the least label of its ids, combined before the shuffle, and every id the least
    label of its keys; from the third on labels take their own labels too, so long chains settle in few rounds.
    """
    scratch = Scratch(members.sparkSession)
    sized = members.groupBy("key").agg(F.count("*").alias("n"))
    rows = join_hot(members, sized.withColumn("m", F.col("n")), "key", F.col("id"))
    state = scratch.table(rows.groupBy("id").agg(F.collect_list(F.struct("key", F.col("m").alias("n"))).alias("keys")).withColumn("label", F.col("id")), "labels")
    for turn in range(rounds):
        each = state.select("id", "label", F.explode("keys").alias("k")).select("id", "label", "k.key", "k.n")
        low = each.groupBy("key").agg(F.min("label").alias("low"), F.max("n").alias("n"))
        met = join_hot(each.select("id", "label", "key", F.col("n").alias("m")), low, "key", F.col("id"))
        after = met.groupBy("id").agg(F.min(F.least("label", "low")).alias("label"), F.max("label").alias("before"), F.collect_list(F.struct("key", F.col("m").alias("n"))).alias("keys"))
        if turn >= 2:
            after = scratch.table(after, f"step{turn}")
            heads = after.groupBy("label").agg(F.count("*").alias("n"))
            up = after.select(F.col("id").alias("label"), F.col("label").alias("up")).join(heads, "label")
            after = join_hot(after, up, "label", F.col("id")).withColumn("label", F.least("label", "up")).drop("up")
        state = scratch.table(after, f"labels{turn}")
        if state.where("label < before").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    scratch.clear(f"labels{turn}")
    return state.select("id", F.col("label").alias("root"))


def large_groups(buckets: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """id, group (its least id), block and n_blocks of the texts in ``buckets`` (id, key); ``sizes`` has id and n_words."""
    tied = components(buckets).withColumnRenamed("root", "group").join(sizes, "id")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("n_words") / BLOCK_WORDS)).cast("int")
    groups = scratch.table(tied.groupBy("group").agg(blocks.alias("n_blocks"), F.count("*").alias("n")), "groups")
    return scratch.table(join_hot(tied.select("id", "group"), groups, "group", F.col("id")).withColumn("block", F.pmod(F.xxhash64("id"), "n_blocks").cast("int")), "blocks")


def candidate_pairs(rows: DataFrame, small: int) -> DataFrame:
    """Pairs a < b of ids that share a bucket (key) and aren't of one group, once each: at most small - 1 a text and bucket."""
    inside = Window.partitionBy("key").orderBy("id").rowsBetween(-small, -1)
    met = rows.select("id", "group", F.collect_list(F.struct("id", F.coalesce("group", -F.col("id") - 1).alias("group"))).over(inside).alias("before"))
    other = F.filter("before", lambda x: F.col("group").isNull() | (x["group"] != F.col("group")))  # blocks compare the rest
    return met.select(F.explode(other["id"]).alias("a"), F.col("id").alias("b")).distinct()


def near_duplicates(documents: DataFrame, *, threshold: float = 0.8, small: int = 24, broadcast_ids: int = 1_000_000) -> DataFrame:
    """doc_id, class_id, n_links (the other texts at or above the threshold that share a bucket or group with its text) per row."""
    scratch = Scratch(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = docs.withColumn("h", word_hashes(F.col("text"))).select("doc_id", F.struct(F.xxhash64("h").alias("k1"), F.xxhash64(F.reverse("h"), F.lit(1)).alias("k2")).alias("k"), F.size("h").alias("n_words"), _sketch(F.col("h")).alias("s"))
    hashed = scratch.table(hashed.select("doc_id", "k", "n_words", "s.bands", "s.bytes"), "sketches")
    named = hashed.where("doc_id is not null")
    # One id for texts with the same words: a grouped minimum, combined before the shuffle.
    texts = named.groupBy("k").agg(F.min(F.struct("doc_id", "n_words", "bands", "bytes")).alias("m"), F.count("*").alias("n"))
    texts = scratch.table(texts.select("k", "n", F.col("m.doc_id").alias("id"), "m.n_words", "m.bands", "m.bytes"), "texts")
    first = texts.select("id", "k", "n_words", "bands", "bytes")
    if not texts.groupBy("id").count().where("count > 1").isEmpty():  # some doc_id has several texts
        first = first.groupBy("id").agg(F.min(F.struct("k", "n_words", "bands", "bytes")).alias("m")).select("id", "m.*")
        first = scratch.table(first, "first")
    rows = first.select("id", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = scratch.table(join_hot(rows, sizes.withColumn("size", F.col("n")), "key", F.col("id")), "buckets")
    groups = large_groups(rows.where(F.col("size") > small).select("id", "key"), first.select("id", "n_words"), scratch)
    pairs = candidate_pairs(rows.where(F.col("size") <= small).join(groups.select("id", "group"), "id", "left"), small)
    one = first.select(F.col("id").alias("a"), F.col("bytes").alias("x"))
    two = first.select(F.col("id").alias("b"), F.col("bytes").alias("y"))
    enough = int(K * threshold - 6 * math.sqrt(K * threshold * (1 - threshold)))  # six deviations below the threshold
    likely = scratch.table(pairs.join(one, "a").join(two, "b").where(_agreement("x", "y") >= enough).select("a", "b"), "likely")
    wanted = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).unionByName(groups.select("id")).distinct()
    wanted = scratch.table(wanted.join(first.select("id", F.col("k.k1").alias("k1")), "id").select(F.col("id").alias("doc_id"), "k1"), "wanted")
    few = wanted.count() <= broadcast_ids  # sixteen bytes each; beyond it the texts are shuffled instead
    held = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", "k1", word_hashes(F.col("text")).alias("h"))
    held = scratch.table(held.where(F.xxhash64("h") == F.col("k1")).select("doc_id", "h").dropDuplicates(["doc_id"]), "held")
    exact = likely.join(held.select(F.col("doc_id").alias("a"), F.col("h").alias("x")), "a").join(held.select(F.col("doc_id").alias("b"), F.col("h").alias("y")), "b")
    edges = scratch.table(exact.where(_similarity("x", "y") >= threshold).select("a", "b"), "links")
    texts_in = groups.join(held.withColumnRenamed("doc_id", "id"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    texts_in = texts_in.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "block", "h")
    compare = "group long, i int, j int, id long, root long, n long"
    block_pairs = texts_in.groupBy("group", "i", "j").applyInPandas(lambda key, rows: _compare_blocks(threshold)(key, rows).assign(group=key[0], i=key[1], j=key[2])[["group", "i", "j", "id", "root", "n"]], compare)
    inside = scratch.table(block_pairs, "compared")
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"), F.struct(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(-1).alias("i"), F.lit(-1).alias("j")).alias("key"), F.lit(1).cast("long").alias("n"))
    trees = inside.select("id", F.struct(F.col("group").alias("x"), F.col("root").alias("y"), "i", "j").alias("key"), "n")
    tied = ends.unionByName(trees)
    links = tied.groupBy("id").agg(F.sum("n").alias("n_links"))
    classes = texts.select("k", "id", "n").join(components(tied.select("id", "key")), "id", "left").join(links, "id", "left")
    classes = scratch.table(classes.select("k", "n", F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    scratch.clear("sketches", "classes")
    out = join_hot(named.select("doc_id", "k"), classes, "k", F.col("doc_id")).select("doc_id", "class_id", "n_links")
    return out.unionByName(hashed.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(documents: DataFrame, *, broadcast_ids: int = 1_000_000, **how) -> DataFrame:
    """One document of each class, the one whose id names it, with the columns of ``documents``; null ids stay.

    Of several rows with that id the one with the lowest digest stays.
    """
    scratch = Scratch(documents.sparkSession)
    named = near_duplicates(documents, broadcast_ids=broadcast_ids, **how).where("doc_id = class_id")
    keep = scratch.table(named.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")), "kept")
    docs = documents.select(F.col("doc_id").cast("long").alias("_id"), whole_row(documents).alias("_row"))
    found = docs.join(F.broadcast(keep) if keep.count() <= broadcast_ids else keep, "_id")
    several = found.where("_n > 1").groupBy("_id").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return found.where("_n = 1").select("_row.*").unionByName(several.select("_row.*")).unionByName(docs.where("_id is null").select("_row.*"))
