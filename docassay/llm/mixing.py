"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets. Sources in order of code point (null last) take the weights in turn. The mix is ``total_share`` of
all sizes, dealt by weight; a source takes at most ``cap`` times its size and what it can't take is dealt
again by weight until no source is above its cap. That fixed point is one number, the level: a source's
target is the smaller of its cap and level x weight.

Selection. Whole epochs come first: a source whose target is e times its size and a rest takes every document
e times. The rest is filled in order of exponential keys -ln(u) / quality, u from a digest of the
document's id, so reruns agree and better documents come earlier; a document is taken while at least half
of it fits below the rest.

Rows equal in source, doc_id and text are counted first, so a row that repeats without end is one entry whose
copies are taken by arithmetic. A source's keys are put in order by two levels: sums over ranges of the key's
uniform, as many as the source has thousands of entries, added up per source, then a sort inside each range.
No task sorts a whole source.

Cases. A null text has size 0 and takes 0. A null source is a source of its own. A source of size 0 has
target 0. Rows with equal doc_id have equal keys and follow in order of a digest of the text; of rows equal in
both as many are taken as fit. A null doc_id has the key of its text's digest. An empty table gives no rows.
Other columns are ignored or, in mix_documents, kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm.common import SPACE, materialise, whole_row

#: Entries of a key range, about.
RANGE_ENTRIES = 2000


def n_words(text: Column) -> Column:
    """Words, counted as the runs of other characters that the white space leaves."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def source_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], total_share: float = 1.5, cap: float = 2.0) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by water filling, in the order in which sources take weights."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weighted = [(s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(order)]
    left, heavy, level = total_share * sum(n for _, n, _ in weighted), sum(w for _, _, w in weighted), 0.0
    for _, n, w in sorted(weighted, key=lambda x: cap * x[1] / x[2]):
        level = left / heavy if heavy else 0.0
        if cap * n > level * w:
            break
        left, heavy = left - cap * n, heavy - w
    return [(s, n, min(cap * n, level * w)) for s, n, w in weighted]


def unit_uniform(doc_id: Column, tie: Column) -> Column:
    """A uniform in (0, 1) from the MD5 digest of the id's text."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.hex(tie)).cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def plan_mix(documents: DataFrame, quality: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """An entry per distinct (source, doc_id, text): size, n (its rows), source_size, target, and what is taken.

    ``quality`` has doc_id (unique) and weight (above 0); documents without a row weigh 1. ``epochs`` is how
    often each of the n rows is taken, ``extra`` how many of them are taken once more; ``tie`` is the text's digest.
    Per source one row of sums comes to the driver, where weights are assigned; the number of sources bounds it.
    """
    docs = documents.select("source", "doc_id", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    entries = docs.groupBy("source", "doc_id", "size", "tie").agg(F.count("*").alias("n"))
    weight = quality.select(F.col("doc_id").alias("_q_id"), F.col("weight").alias("_weight"))
    keyed = entries.join(weight, F.col("doc_id") == F.col("_q_id"), "left").drop("_q_id")
    keyed = materialise(keyed.withColumn("_key", -F.log(unit_uniform(F.col("doc_id"), F.col("tie"))) / F.coalesce("_weight", F.lit(1.0))).drop("_weight"), "keyed")
    sums = keyed.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count("*").alias("entries")).collect()
    ranges = {r["source"]: max(1, r["entries"] // RANGE_ENTRIES) for r in sums}
    rows = [(*t, ranges[t[0]]) for t in source_targets([(r["source"], r["size"]) for r in sums], weights, total_share, cap)]
    targets = documents.sparkSession.createDataFrame(rows, "_s string, source_size long, target double, _ranges int")
    small = len(rows) <= 100_000
    keyed = keyed.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # 1 - exp(-key) is close to uniform for weights near 1, so ranges of it hold like shares of a source.
    keyed = keyed.withColumn("_range", F.floor((1 - F.exp(-F.col("_key"))) * F.col("_ranges")).cast("int")).drop("_ranges")
    keyed = keyed.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    w = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy("_source", "_range").agg(F.sum(F.col("size") * F.col("n")).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    joined = keyed.join(before, ["_source", "_range"])
    order = Window.partitionBy("_source", "_range").orderBy("_key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    joined = joined.withColumn("epochs", epochs).withColumn("_room", F.col("target") - F.col("epochs") * F.col("source_size") - start - F.col("size") / 2)
    fits = F.when(F.col("_room") < 0, F.lit(0).cast("long")).when(F.col("size") == 0, F.col("n")).otherwise(F.floor(F.col("_room") / F.col("size")) + 1)
    return joined.withColumn("extra", F.least(F.col("n"), fits.cast("long"))).drop("_source", "_range", "_before", "_key", "_room")


def mix(documents: DataFrame, quality: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    plan = plan_mix(documents, quality, **how)
    rows = plan.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    taken = (F.col("epochs") + F.when(F.col("_k") <= F.col("extra"), 1).otherwise(0)) * F.col("size")
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_documents(documents: DataFrame, quality: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``documents``.

    A document without words is never part of a mix. Texts stay out of the sampling; they meet its result by
    digests of their text and id. Of rows equal in source, doc_id and text, those that are taken once more are
    copies of the one with the lowest digest.
    """
    names = ("source", "doc_id", "tie")
    key = F.struct(F.xxhash64(*names), F.xxhash64(F.lit(1), *names)).alias("_id")
    docs = documents.select(whole_row(documents).alias("_row"), "source", "doc_id", F.xxhash64("text").alias("tie")).select("_row", key)
    taken = plan_mix(documents.select("source", "doc_id", "text"), quality, **how).where("size > 0 and epochs + extra > 0")
    taken = materialise(taken.select(key, F.when(F.col("extra") == F.col("n"), F.col("epochs") + 1).otherwise(F.col("epochs")).cast("int").alias("each"), F.when(F.col("extra") < F.col("n"), F.col("extra")).otherwise(0).cast("int").alias("more"), "n"), "taken")
    every = docs.join(taken.where("each > 0").select("_id", "each"), "_id").select("_row", F.explode(F.sequence(F.lit(1), F.col("each")))).select("_row.*")
    # Where some of equal rows are taken once more the sum of sizes stops inside them: one such entry a source at most.
    part = docs.join(taken.where("more > 0").select("_id", "more"), "_id").groupBy("_id", "more").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return every.unionByName(part.select("_row", F.explode(F.sequence(F.lit(1), F.col("more")))).select("_row.*"))
