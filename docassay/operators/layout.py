"""Labels and values by place on the page, and order-dependent work per document.

Candidate relations are joins within a document on a grid of rows, so a document's tokens meet only those of
nearby heights. The greedy operators work through one document at a time as they stream by.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.functions import extract
from docassay.functions.checksum import verhoeff_valid


def by_document(tokens: DataFrame, work, schema: str) -> DataFrame:
    """``work(doc_id, rows)`` for each document, rows in order of ord; it yields tuples of ``schema``.

    Documents are dealt out by id and streamed, so a task holds one document at a time and pages of a few tokens
    don't pay for a group of their own.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, out = None, [], []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if rows and row.doc_id != key:
                    out.extend(work(key, rows))
                    rows = []
                key = row.doc_id
                rows.append(row)
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if rows:
            yield pd.DataFrame(list(work(key, rows)), columns=columns)

    return tokens.where("doc_id is not null").repartition("doc_id").sortWithinPartitions("doc_id", "ord").mapInPandas(stream, schema)


def right_of(tokens: DataFrame, labels: DataFrame, height: float = 45.0) -> DataFrame:
    """The nearest token to the right of each label within ``height``: doc_id, label_ord, value_ord, distance."""
    return _nearest(tokens, labels, height, lambda dx, dy: (dx > 0) & (F.abs(dy) < height), lambda dx, dy: dx + 2 * F.abs(dy))


def below(tokens: DataFrame, labels: DataFrame, height: float = 80.0, width: float | None = None) -> DataFrame:
    """The nearest token below each label."""
    fits = lambda dx, dy: (dy > 0) & (dy < height) & (F.lit(True) if width is None else F.abs(dx) < width)
    return _nearest(tokens, labels, height, fits, (lambda dx, dy: dy) if width is None else (lambda dx, dy: 2 * dy + F.abs(dx)))


def _nearest(tokens: DataFrame, labels: DataFrame, height: float, fits, distance) -> DataFrame:
    cell = F.floor(F.col("cy") / height).cast("long")
    a = labels.select("doc_id", F.col("ord").alias("label_ord"), F.col("cx").alias("lx"), F.col("cy").alias("ly"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = tokens.select("doc_id", F.col("ord").alias("value_ord"), F.col("cx").alias("vx"), F.col("cy").alias("vy"), cell.alias("cell"))
    dx, dy = F.col("vx") - F.col("lx"), F.col("vy") - F.col("ly")
    pairs = a.join(b, ["doc_id", "cell"]).where((F.col("label_ord") != F.col("value_ord")) & fits(dx, dy)).withColumn("distance", distance(dx, dy))
    best = pairs.groupBy("doc_id", "label_ord").agg(F.min(F.struct("distance", "value_ord")).alias("m"))
    return best.select("doc_id", "label_ord", F.col("m.value_ord").alias("value_ord"), F.col("m.distance").alias("distance"))


def nearest_value(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """To the right where there is a value, else below."""
    right = right_of(tokens, labels)
    return right.unionByName(below(tokens, labels).join(right, ["doc_id", "label_ord"], "left_anti"))


def unpaired(tokens: DataFrame, assigned: DataFrame) -> DataFrame:
    """Tokens whose text no field took."""
    return tokens.join(assigned.select("doc_id", "text").distinct(), ["doc_id", "text"], "left_anti")


def combine_digits(tokens: DataFrame, size: int = 12, reach: int = 5) -> DataFrame:
    """Runs of up to ``reach`` following digit tokens that make up exactly ``size`` digits, from every start."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(0, reach - 1)
    runs = tokens.select("doc_id", "ord", F.collect_list(F.struct("text", "confidence")).over(w).alias("run"))
    lengths = runs.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("run")))).withColumn("part", F.slice("run", 1, F.col("k")))
    number = F.array_join(F.transform("part", lambda x: F.regexp_replace(x["text"], "[^0-9]", "")), "")
    mean = F.aggregate("part", F.lit(0.0), lambda a, x: a + x["confidence"]) / F.col("k")
    hit = lengths.select("doc_id", "ord", "k", number.alias("number"), mean.alias("confidence")).where(F.length("number") == size)
    return hit.groupBy("doc_id", "ord").agg(F.min(F.struct("k", "number", "confidence")).alias("m")).select("doc_id", "ord", "m.number", "m.confidence")


def candidate_vote(candidates: DataFrame) -> DataFrame:
    """The number of each document with the best score plus agreement; ties go to the one seen first."""
    votes = candidates.groupBy("doc_id", "number").agg((F.max("score") + 0.05 * F.least(F.count("*"), F.lit(5))).alias("final"), F.min("ord").alias("first"))
    best = votes.groupBy("doc_id").agg(F.min(F.struct(-F.col("final"), F.col("first"), F.col("number"))).alias("m"))
    return best.select("doc_id", F.col("m.number").alias("number"), (-F.col("m.col1")).alias("final"))


def next_value(tokens: DataFrame, is_label: Column) -> DataFrame:
    """doc_id, ord, value: for each label the next text of its document that is no label; null where none follows."""
    behind = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    held = tokens.withColumn("_label", F.coalesce(is_label, F.lit(False)))
    return held.withColumn("value", F.first(F.when(~F.col("_label"), F.col("text")), ignorenulls=True).over(behind)).where("_label").select("doc_id", "ord", "value")


def reading_order(tokens: DataFrame, by: str = "lines") -> DataFrame:
    """Tokens with ``place``, 1, 2, … within their document: by ``lines`` (height, then left), ``height`` or ``confidence`` (best first)."""
    order = {"lines": ["cy", "cx", "ord"], "height": ["cy", "ord"], "confidence": [F.col("confidence").desc(), "ord"]}[by]
    return tokens.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def union_passes(passes: list[DataFrame]) -> DataFrame:
    """All readings of several passes over the same documents as one bag; ord counts on from pass to pass."""
    out = [p.withColumn("pass", F.lit(i)) for i, p in enumerate(passes)]
    every = reduce(DataFrame.unionByName, out)
    return every.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("pass", "ord")))


def full_text(tokens: DataFrame) -> DataFrame:
    """doc_id and the texts of its tokens, in order, with spaces between."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return tokens.where("text is not null").groupBy("doc_id").agg(rows.alias("r")).select("doc_id", F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"))


@dataclass(frozen=True)
class Quality:
    """Thresholds and texts of an image's verdict, in the order in which they are tried."""

    readable_at: float
    least_mean: float | None
    count_first: bool
    few: str
    poor: str
    good: str
    least_readable: int = 2


# The verdicts of visas and of forms.
NO_TEXT = "No readable text was detected."
VISA_QUALITY = Quality(0.40, 0.50, True, "Not enough readable visa text was detected.", "OCR confidence is too low.", "Image quality is sufficient.")
FORM_QUALITY = Quality(0.50, 0.55, False, "Insufficient readable text was detected.", "OCR confidence is too low.", "Sufficient text was detected.")
LICENSE_QUALITY = Quality(0.35, None, True, "Insufficient readable text was detected.", "", "Sufficient text was detected.", least_readable=3)


def image_quality(tokens: DataFrame, documents: DataFrame, rule: Quality = FORM_QUALITY) -> DataFrame:
    """doc_id, mean_confidence, readable, reason and clear for every document; one without tokens isn't clear."""
    stats = tokens.groupBy("doc_id").agg(F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") >= rule.readable_at).alias("readable"))
    every = documents.select("doc_id").distinct().join(stats, "doc_id", "left").na.fill(0.0, ["mean_confidence"])
    few = F.when(F.col("readable") < rule.least_readable, rule.few)
    poor = F.lit(None).cast("string") if rule.least_mean is None else F.when(F.col("mean_confidence") < rule.least_mean, rule.poor)
    found = F.coalesce(F.when(F.col("readable").isNull(), NO_TEXT), *((few, poor) if rule.count_first else (poor, few)))
    return every.withColumn("reason", F.coalesce(found, F.lit(rule.good))).withColumn("clear", found.isNull()).withColumn("readable", F.coalesce("readable", F.lit(0)))


# Texts that head a field of a visa and are never its value.
VISA_HEADERS = (
    "NAME", "FULL NAME", "SURNAME", "GIVEN NAME", "GIVEN NAMES", "FIRST NAME", "LAST NAME", "FAMILY NAME", "PASSPORT NUMBER", "PASSPORT NO", "PASSPORT #",
    "PASSPORT", "VISA NUMBER", "VISA NO", "VISA #", "CONTROL NUMBER", "REFERENCE NUMBER", "NATIONALITY", "COUNTRY", "VISA TYPE", "TYPE OF VISA", "CLASS", "SEX", "GENDER",
    "BIRTH DATE", "DATE OF BIRTH", "DOB", "ISSUE DATE", "DATE OF ISSUE", "ISSUED", "EXPIRATION DATE", "EXPIRY DATE", "DATE OF EXPIRY", "VALID UNTIL", "ISSUING POST",
    "ISSUING POST NAME", "ISSUED AT", "PLACE OF ISSUE", "ENTRIES", "ANNOTATION", "NUMBER", "TYPE", "POST", "DATE", "EXPIRATION", "ISSUE", "BIRTH", "TYPE /CLASS",
)
# The labels behind which a visa's fields stand.
VISA_LABELS = {
    "name": ("NAME", "FULL NAME", "SURNAME", "GIVEN NAME", "APPLICANT NAME"),
    "surname": ("SURNAME", "LAST NAME", "FAMILY NAME"),
    "given_name": ("GIVEN NAME", "FIRST NAME", "GIVEN NAMES"),
    "passport_number": ("PASSPORT NUMBER", "PASSPORT NO", "PASSPORT #"),
    "visa_number": ("VISA NUMBER", "VISA NO", "VISA #", "CONTROL NUMBER", "REFERENCE NUMBER"),
    "sex": ("SEX", "GENDER"),
    "birth_date": ("BIRTH DATE", "DATE OF BIRTH", "DOB"),
    "issue_date": ("ISSUE DATE", "DATE OF ISSUE", "ISSUED"),
    "expiration_date": ("EXPIRATION DATE", "EXPIRY DATE", "DATE OF EXPIRY", "VALID UNTIL"),
    "issuing_post": ("ISSUING POST", "ISSUING POST NAME", "ISSUED AT", "PLACE OF ISSUE"),
}


def values_after_labels(tokens: DataFrame, labels: dict[str, tuple[str, ...]], headers: tuple[str, ...] = VISA_HEADERS, reach: int = 5) -> DataFrame:
    """doc_id and a column per entry of ``labels``: its value in each document, or null.

    A token holds a label if the label is part of it. Of the ``reach`` tokens that follow, the first that isn't
    blank or a header is the value; the first token of the document that leads to one counts.
    """
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, reach)
    ahead = F.transform(F.collect_list("text").over(w), lambda x: F.trim(x))
    value = F.get(F.filter(ahead, lambda x: (x != "") & ~F.upper(x).isin(*headers)), F.lit(0))
    rows = tokens.select("doc_id", "ord", F.upper("text").alias("upper"), value.alias("value"))
    holds = lambda names: reduce(lambda a, n: a | F.contains("upper", F.lit(n.upper())), names, F.lit(False))
    return rows.groupBy("doc_id").agg(*[F.min_by("value", F.when(holds(names) & F.col("value").isNotNull(), F.col("ord"))).alias(f) for f, names in labels.items()])


def visa_fields(tokens: DataFrame) -> DataFrame:
    """A row per document: the fields behind VISA_LABELS and those found in its whole text; numbers fall back on the text's first."""
    found = values_after_labels(tokens, VISA_LABELS).join(full_text(tokens), "doc_id", "left")
    t = F.coalesce("text", F.lit(""))
    found = found.withColumns({"dates": extract.extract_dates(t), "passport_candidates": extract.passport_numbers(t), "visa_candidates": extract.visa_numbers(t), "nationality": extract.nationality(t), "visa_type": extract.visa_type(t)})
    first = lambda own, many: F.coalesce(own, F.get(many, F.lit(0)))
    return found.withColumns({"passport_number": first("passport_number", "passport_candidates"), "visa_number": first("visa_number", "visa_candidates")}).drop("text")


def find_numbers(tokens: DataFrame, size: int = 12) -> DataFrame:
    """The most likely number of each document: direct and combined candidates, scored, voted.

    doc_id, number, final (score with agreement), occurrences. Tokens come in order of height.
    """
    placed = reading_order(tokens, "height").drop("ord").withColumnRenamed("place", "ord")
    direct = placed.select("doc_id", F.col("ord").cast("long").alias("ord"), F.explode(extract.number_candidates(F.col("text"))).alias("number"), "confidence")
    digits = combine_digits(placed.where(extract.is_numeric_token(F.col("text"))), size)
    combined = digits.select("doc_id", (F.col("ord") + (1 << 32)).alias("ord"), "number", "confidence")  # behind all direct ones
    scored = direct.unionByName(combined).withColumn("score", extract.candidate_score(F.col("confidence"), verhoeff_valid(F.col("number"), size)))
    votes = scored.groupBy("doc_id", "number").agg((F.max("score") + 0.05 * F.least(F.count("*"), F.lit(5))).alias("final"), F.count("*").alias("occurrences"), F.min("ord").alias("first"))
    best = votes.groupBy("doc_id").agg(F.min_by(F.struct("number", "final", "occurrences"), F.struct(-F.col("final"), F.col("first"), F.col("number"))).alias("m"))
    return best.select("doc_id", "m.*")


def fuzzy_dedup(tokens: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Greedy: each token joins the first kept one it resembles, and takes its place if read more surely.

    Compared are letters A-Z and digits; a token without any is dropped.
    """

    def keep(doc_id: int, rows: list) -> Iterator[tuple]:
        kept: list[list] = []
        for row in rows:
            plain = re.sub("[^A-Z0-9]", "", row.text.upper())
            if not plain:
                continue
            for k in kept:
                a, b = len(plain), len(k[2])
                if 2 * min(a, b) >= threshold * (a + b) and SequenceMatcher(None, plain, k[2]).ratio() >= threshold:
                    if row.confidence > k[1]:
                        k[:] = [row.text, row.confidence, plain, row.ord]
                    break
            else:
                kept.append([row.text, row.confidence, plain, row.ord])
        return ((doc_id, k[3], k[0], k[1]) for k in kept)

    return by_document(tokens.select("doc_id", "ord", "text", "confidence"), keep, "doc_id long, ord int, text string, confidence double")


# Labels of licences, against which a token's text is matched.
KNOWN_LABELS = (
    "NAME", "SURNAME", "GIVEN NAME", "DATE OF BIRTH", "DATE OF ISSUE", "DATE OF EXPIRY", "EXPIRY DATE", "EXPIRATION DATE", "BLOOD GROUP", "BLOOD TYPE", "ADDRESS", "FATHER NAME",
    "MOTHER NAME", "HUSBAND NAME", "WIFE NAME", "SON OF", "DAUGHTER OF", "WIFE OF", "LICENSE NUMBER", "LICENCE NUMBER", "DRIVING LICENSE", "DRIVING LICENCE", "DL NUMBER", "DOB",
    "VALID FROM", "VALID UNTIL", "ISSUED", "ISSUE DATE", "SEX", "GENDER",
)
FIELD_SCHEMA = "doc_id long, label string, value string, confidence double, source string"


@lru_cache(maxsize=8)
def _matchers(labels: tuple[str, ...]) -> list[tuple[str, int, Counter, SequenceMatcher]]:
    """Per label: itself, its plain length and letters, and a matcher that has it as its second text."""
    plain = [(label, re.sub("[^A-Z0-9]", "", label.upper())) for label in labels]
    return [(label, len(p), Counter(p), SequenceMatcher(None, "", p)) for label, p in plain]


@lru_cache(maxsize=50_000)
def known_label(text: str, labels: tuple[str, ...] = KNOWN_LABELS, least: float = 0.65) -> str | None:
    """The label that a text resembles most, the first of equals, if it resembles it enough.

    Compared are only labels that could win: no ratio is above the one that lengths or common letters in any order allow.
    """
    own = re.sub("[^A-Z0-9]", "", text.upper())
    if not own:
        return None
    n, letters, best, found = len(own), Counter(own), -1.0, None
    for label, m, its, matcher in _matchers(labels):
        out_of_reach = lambda same: (bound := 2.0 * same / (n + m)) < least or bound <= best  # noqa: B023, E731
        if out_of_reach(min(n, m)) or out_of_reach(sum(min(k, its[c]) for c, k in letters.items() if c in its)):
            continue
        matcher.set_seq1(own)
        if (ratio := matcher.ratio()) > best:
            best, found = ratio, label
    return found if best >= least else None


def _pair_boxes(tokens: DataFrame, inline: str, label_of, nearest, accepts, source: str) -> DataFrame:
    """Fields of a page: ``label: value`` within a token, then labels in reading order with the nearest free token.

    A label met again replaces its field. Tokens that took part are gone; a nearest token that isn't accepted
    ends its label's search.
    """
    pattern = re.compile(inline)

    def pair(doc_id: int, page: list) -> Iterator[tuple]:
        rows = sorted(page, key=lambda r: (r.cy, r.cx, r.ord))
        fields: dict[str, tuple] = {}
        free = dict(enumerate(rows))
        for i, r in enumerate(rows):
            if m := pattern.match(r.text):
                label, value = " ".join(m[1].strip().rstrip(":：").split()), " ".join(m[2].split())
                if label and value:
                    fields[label] = (value, round(r.confidence, 3), "same_line")
                    del free[i]
        for i, r in enumerate(rows):
            label = label_of(r.text) if i in free else None
            if not label:
                continue
            near = nearest((v.cx - r.cx, v.cy - r.cy, j) for j, v in free.items() if j != i)
            if near is not None and accepts(free[near].text):
                value = free.pop(near)
                free.pop(i)
                fields[label] = (value.text, round(min(r.confidence, value.confidence), 3), source)
        return ((doc_id, label, *f) for label, f in fields.items())

    return by_document(tokens.where("text is not null").select("doc_id", "ord", "text", "confidence", "cx", "cy"), pair, FIELD_SCHEMA)


def dynamic_fields(tokens: DataFrame) -> DataFrame:
    """Fields of forms without a fixed layout (FIELD_SCHEMA): values stand right of their label, else below it."""

    def label_like(text: str) -> bool:
        t = text.strip()
        return bool(t) and len(t) <= 80 and (":" in t or "：" in t or len(t.split()) <= 7 and not re.search(r"\d{4,}", t))

    def label_of(text: str) -> str | None:
        label = " ".join(re.sub("[:：]+$", "", text.strip()).split())
        return label if label_like(label) else None

    def nearest(others) -> int | None:
        near = list(others)
        right = [(dx + 2 * abs(dy), j) for dx, dy, j in near if dx > 0 and abs(dy) < 45]
        below_ = [(dy, j) for _, dy, j in near if 0 < dy < 80]
        return min(right or below_)[1] if right or below_ else None

    return _pair_boxes(tokens, extract.LABEL_VALUE, label_of, nearest, lambda text: not label_like(text), "layout_relation")


# What becomes of a page whose image is clear.
NO_FIELDS = "Text was detected, but no reliable key-value relationships were identified."
SOME_FIELDS = "Text was extracted using layout-agnostic OCR and dynamic field detection."


def form_results(tokens: DataFrame, documents: DataFrame, title: str, rule: Quality = FORM_QUALITY, fields_of=dynamic_fields) -> DataFrame:
    """A result per document, as an extraction engine gives it: doc_id, document_type, status, ocr_confidence (percent), reason, fields, unpaired_text, raw_ocr.

    fields: label -> struct(value, confidence, source). unpaired_text: readings that are no field's value, raw_ocr: all
    readings, each in reading order. An unclear page has the reason of its quality and no fields; a document without
    tokens is unclear. As JSON, a row is what functions.wrappers.flatten_result() reads.
    """
    from docassay.functions.extract import document_status

    found = fields_of(tokens)
    value = F.struct("value", "confidence", "source")
    fields = found.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label").alias("key"), value.alias("value"))))).alias("_fields"))
    read = reading_order(tokens.where("text is not null")).withColumn("confidence", F.round("confidence", 3))
    listed = lambda df, name: df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text", "confidence"))), lambda t: F.struct(t["text"].alias("text"), t["confidence"].alias("confidence"))).alias(name))
    left = unpaired(read, found.select("doc_id", F.col("value").alias("text")))
    every = image_quality(tokens, documents, rule).join(fields, "doc_id", "left").join(listed(left, "_left"), "doc_id", "left").join(listed(read, "_read"), "doc_id", "left")
    n = F.when(F.col("_fields").isNull(), 0).otherwise(F.size("_fields"))
    texts = "array<struct<text:string,confidence:double>>"
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<value:string,confidence:double,source:string>>"))
    return every.select(
        "doc_id",
        F.lit(title).alias("document_type"),
        document_status(F.col("clear"), n).alias("status"),
        F.round(F.col("mean_confidence") * 100, 2).alias("ocr_confidence"),
        F.when(~F.col("clear"), F.col("reason")).when(n == 0, NO_FIELDS).otherwise(SOME_FIELDS).alias("reason"),
        F.coalesce(F.when(F.col("clear"), F.col("_fields")), none).alias("fields"),
        F.coalesce(F.when(F.col("clear"), F.col("_left")), F.array().cast(texts)).alias("unpaired_text"),
        F.coalesce(F.when(F.col("clear"), F.col("_read")), F.array().cast(texts)).alias("raw_ocr"),
    )


def licence_fields(tokens: DataFrame) -> DataFrame:
    """Fields of licences: known labels, however misread, with a value to the right or below, and numbered dates and numbers."""

    def nearest(others) -> int | None:
        ways = [(dx + 2 * abs(dy), j) if dx > 0 and abs(dy) < 70 else (2 * dy + abs(dx), j) for dx, dy, j in others if dx > 0 and abs(dy) < 70 or 0 < dy < 120 and abs(dx) < 350]
        return min(ways)[1] if ways else None

    paired = _pair_boxes(tokens, r"^\s*(.{1,70}?)\s*[:：\-]\s*(.+?)\s*$", known_label, nearest, lambda text: True, "fuzzy_label_layout")
    dates, numbers = numbered(tokens, extract.form_dates, "Detected Date "), numbered(tokens, extract.long_numbers, "Detected Number ")
    return paired.unionByName(dates).unionByName(numbers)


def numbered(tokens: DataFrame, find, prefix: str) -> DataFrame:
    """What ``find`` (text column -> array) finds in a page, numbered in reading order: FIELD_SCHEMA."""
    found = reading_order(tokens).select("doc_id", "place", "confidence", F.posexplode(find(F.col("text"))).alias("at", "value"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "at"))
    return found.select("doc_id", F.concat(F.lit(prefix), n.cast("string")).alias("label"), "value", F.round("confidence", 3).alias("confidence"), F.lit("pattern_detection").alias("source"))


def mrz_lines(tokens: DataFrame, threshold: float = 0.85) -> DataFrame:
    """doc_id, line1, line2, mrz_confidence and reason (null where two lines make a zone) of the readings of a page's lower part.

    Cleaned readings of twenty characters or more; of similar ones the surest; the upper two, padded.
    """
    from docassay.functions.mrz import clean_mrz, fit_line, mean_confidence, plausible

    long = tokens.select("doc_id", "ord", clean_mrz(F.col("text")).alias("text"), "confidence", "cy").where(F.length("text") >= 20)

    def keep(doc_id: int, rows: list) -> Iterator[tuple]:
        kept: list = []
        for row in rows:
            at = next((i for i, k in enumerate(kept) if SequenceMatcher(None, row.text, k.text).ratio() >= threshold), None)
            if at is None:
                kept.append(row)
            elif row.confidence > kept[at].confidence:
                kept[at] = row
        return ((doc_id, i, r.text, r.confidence) for i, r in enumerate(sorted(kept, key=lambda r: r.cy)[:2]))

    two = by_document(long, keep, "doc_id long, place int, text string, confidence double").groupBy("doc_id").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("place") == i, F.struct("text", "confidence"))).alias(f"l{i}") for i in (0, 1)])
    every = tokens.select("doc_id").distinct().join(two, "doc_id", "left")
    one, other = fit_line(F.col("l0.text")), fit_line(F.col("l1.text"))
    # Why there is no zone.
    reason = F.when(F.col("n").isNull(), "MRZ was not detected.").when(F.col("n") < 2, "Two MRZ lines were not detected.").when(~plausible(one, other), "Detected text does not appear to be a standard MRZ.")
    return every.select("doc_id", one.alias("line1"), other.alias("line2"), mean_confidence(F.col("l0.confidence"), F.col("l1.confidence")).alias("mrz_confidence"), reason.alias("reason"))
