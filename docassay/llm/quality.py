"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts are taken for every document; the rules behind them are tried in an order that is measured: on a
bounded sample of rows each rule is run over many repeats in one job, the time of the same job without a rule is
taken off, and the rule with most rejections per second comes first. A document leaves the cascade at its first rejection, so the order
changes the work and never the verdict.

Repeated words. A text's three-word windows are hashed; each hash, cut by as many low bits as positions
need, is joined with its position into one long and sorted, so equal windows meet as neighbours. The
positions found are sorted again and a window adds the words that the one before it hasn't covered.

Cases. A null or empty text has no words: all counts are 0 and it fails the base. Texts of one or two words
have no windows. Lines without a word are not counted. Repeated rows are judged each. A null doc_id
stays null. An empty table gives no rows. Columns of the input with the names of results are replaced in
judge(); keep_good() gives the input's own columns back.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import NOT_SPACE, SPACE, materialise, whole_row

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    """Settings of base and rules; sample_docs bounds the sample on which rules are measured."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_char: float = 0.06
    max_capitals_per_char: float = 0.5
    max_shouts_per_word: float = 0.3
    min_mean_word: float = 2.0
    max_mean_word: float = 20.0
    max_dup_line_share: float = 0.5
    sample_docs: int = field(default=2000)


def rules(limits: Limits) -> dict[str, Column]:
    """Name -> true where the rule rejects; over the base counts and, for the costlier ones, the text."""
    text, chars, words = F.coalesce("text", F.lit("")), F.col("word_chars"), F.col("n_words")
    return {
        "symbols": F.col("n_symbols") > limits.max_symbols_per_char * chars,
        "word_length": (chars < limits.min_mean_word * words) | (chars > limits.max_mean_word * words),
        "dup_lines": F.col("n_dup_lines") > limits.max_dup_line_share * F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D][^\n]*")),
        "shouts": F.regexp_count(text, F.lit("!")) > limits.max_shouts_per_word * words,
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) > limits.max_capitals_per_char * chars,
    }


def base_counts(documents: DataFrame) -> DataFrame:
    """The documents with the columns of BASE (long); helper columns begin with an underscore."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    df = documents.drop(*BASE)
    df = df.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    df = df.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"), F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")).drop("_words")
    window = F.transform(F.slice("_hashes", 1, F.greatest(F.size("_hashes") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2)))
    df = df.withColumn("_windows", window).drop("_hashes")
    df = df.withColumn("_bits", F.ceil(F.log2(F.size("_windows") + 1.0)).cast("int"))
    shift = lambda way, x: F.call_function(way, x, F.col("_bits"))
    keyed = F.sort_array(F.transform("_windows", lambda h, i: shift("shiftleft", shift("shiftrightunsigned", h)).bitwiseOR(i.cast("long"))))
    df = df.withColumn("_keyed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), keyed).otherwise(F.array().cast("array<bigint>"))).drop("_windows")
    above = lambda x: shift("shiftrightunsigned", x)
    low = shift("shiftleft", F.lit(1).cast("long")) - 1
    next_same = lambda x, i: F.coalesce(above(x) == above(F.get("_keyed", i + 1)), F.lit(False))
    last_same = lambda x, i: (i > 0) & (above(x) == above(F.get("_keyed", F.greatest(i - 1, F.lit(0)))))
    twice = F.filter("_keyed", lambda x, i: next_same(x, i) | last_same(x, i))
    df = df.withColumn("_found", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low)))).drop("_keyed", "_bits")
    cover = F.aggregate("_found", F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n")))["n"]
    return df.withColumn("n_repeat_words", cover).drop("_found")


def _base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def measure(documents: DataFrame, limits: Limits, repeats: int = 20) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) on a sample of about sample_docs rows, best rejection per second first."""
    n = documents.count()
    if not n:
        return [(name, 1.0, 0.0) for name in rules(limits)]
    # By row, not by text: a text that a third of all rows share is a third of the sample.
    picked = documents.select("text").sample(min(1.0, limits.sample_docs / n), seed=17)
    sample = materialise(base_counts(picked).repartition(4), "sample").where(~_base_failed(limits))
    repeated = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def timed(rejects: Column) -> tuple[float, float]:
        began = time.perf_counter()
        row = repeated.agg(F.count_if(rejects).alias("bad"), F.count("*").alias("n")).first()
        return time.perf_counter() - began, row["bad"] / max(1, row["n"])

    idle = min(timed(F.col("_again") < 0)[0] for _ in range(3))
    out = []
    for name, rejects in rules(limits).items():
        seconds, share = timed(rejects)
        out.append((name, max(seconds - idle, 1e-3), share))
    return sorted(out, key=lambda r: -r[2] / r[1])


def judge(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents with BASE, base_failed and kept."""
    order = measure(documents, limits)
    tests = rules(limits)
    failed = _base_failed(limits)
    kept = ~failed
    for name, _, _ in order:  # AND stops at the first rule that rejects
        kept = kept & ~tests[name]
    own = [c for c in documents.columns if c not in (*BASE, "base_failed", "kept")]
    bare = documents.select(whole_row(documents.select(*["`" + c.replace("`", "``") + "`" for c in own])).alias("_row"), F.col("text").alias("text"))
    judged = base_counts(bare).withColumn("base_failed", failed).withColumn("kept", kept)
    return judged.select("_row.*", *BASE, "base_failed", "kept")


def keep_good(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass base and cascade, with their own columns."""
    bare = documents.select(whole_row(documents).alias("_row"), F.col("text").alias("text"))
    # The row number keeps the filter above the counts; pushed below them it would take each count again.
    judged = judge(bare, limits).withColumn("_n", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_n") >= 0)).select("_row.*")
