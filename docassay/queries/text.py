"""Queries over texts that are built from keys: normal forms, extraction, layout and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions import adapt, checksum, extract, mrz, normalize, similarity
from docassay.operators import layout
from docassay.queries.validation import letters, registry, scans, spread, table


def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", normalize.normalize_name(F.concat_ws("<", "p_name", "p_type")).alias("name"))


def normalize_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", normalize.normalize_identifier(F.col("c_name")).alias("identifier"))


def normalize_numeric_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", normalize.normalize_numeric_identifier(F.concat_ws("-", "p_brand", "p_type")).alias("number"))


SEX_TEXTS = ("M", "male", "BOY", "0", "F", "Female", "girl", "1", "transgender", "other", "")


def _sex_text():
    return F.get(F.array(*[F.lit(x) for x in SEX_TEXTS]), (F.col("c_custkey") % len(SEX_TEXTS)).cast("int"))


def normalize_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", normalize.normalize_gender(_sex_text()).alias("gender"))


def adapter_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" / ", F.get(F.array(*[F.lit(x) for x in ("N", "Q", "k", "H")]), (F.col("c_custkey") % 4).cast("int")), F.lit("F"))
    return table(spark, sf_dir, "customer").select("c_custkey", adapt.adapter_gender(text).alias("gender"))


FORMATS = ("yyyy-MM-dd", "yyyy/M/d", "M/d/yyyy", "dd.MM.yyyy", "yyyyMMdd", "yyMMdd")


def _date_text():
    day = F.col("o_orderdate").cast("date")
    shown = F.lit("no date")
    for i, f in enumerate(FORMATS):
        shown = F.when(F.col("o_orderkey") % 7 == i, F.date_format(day, f)).otherwise(shown)
    return shown


def normalize_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", normalize.normalize_date(_date_text()).alias("iso"))


def adapter_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", adapt.adapter_date(_date_text()).alias("iso"))


def normalize_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("full_name"), F.col("c_name"), F.lit("sex"), _sex_text(), F.lit("member_id"), F.concat(F.lit("x-"), F.col("c_custkey").cast("string")), F.lit("note"), F.concat(F.lit(" "), "c_mktsegment"))
    made = normalize.normalize_all_fields(fields)
    return table(spark, sf_dir, "customer").select("c_custkey", *[made[k].alias(k) for k in ("full_name", "sex", "member_id", "note")])


def field_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("Full_Name", "dob", "kehtiv_kuni", "elamisluba", "something", "NRIC")
    key = F.get(F.array(*[F.lit(k) for k in keys]), (F.col("n_nationkey") % len(keys)).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", adapt.rename_field(key).alias("field"))


def country_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ("ind", "Germany", "xx", "Atlantis", " FRA ", "united kingdom")
    return table(spark, sf_dir, "nation").select("n_nationkey", adapt.normalize_country(F.get(F.array(*[F.lit(x) for x in raw]), (F.col("n_nationkey") % len(raw)).cast("int"))).alias("country"))


def _number():
    return F.lpad((F.col("o_orderkey") * 7919 + 13).cast("string"), 12, "7")


def verhoeff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", checksum.verhoeff_valid(_number()).alias("valid"))


def mask_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", checksum.mask_number(_number()).alias("masked"))


def id_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _number()
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("No "), F.substring(n, 1, 4), F.lit(" "), F.substring(n, 5, 4), F.lit("  "), F.substring(n, 9, 4), F.lit(" end"))).otherwise(F.concat(F.lit("id:"), n, F.lit(". 1234567890123")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(extract.number_candidates(text), ",").alias("numbers"))


def passport_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Passport no P"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.lit(" of HOLDER, p"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(extract.passport_numbers(text), ",").alias("numbers"))


def label_value_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" Name : "), "c_name", F.lit(" "))).otherwise(F.concat(F.lit("plain "), F.col("c_custkey").cast("string")))
    label, value = extract.label_value(text)
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"), value.alias("value"))


def license_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("DL-O"), F.when(F.col("c_custkey") % 2 == 0, "12345").otherwise(""), F.col("c_custkey").cast("string"), F.lit("I"))
    return table(spark, sf_dir, "customer").select("c_custkey", extract.license_number(text).alias("number"))


def blood_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.get(F.array(*[F.lit(x) for x in ("A+", "AB-", "O+X", "B -Y", "none")]), (F.col("c_custkey") % 5).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", extract.blood_group(F.concat(F.lit("BG: "), group)).alias("blood_group"))


def mrz_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", mrz.fit_line(mrz.clean_mrz(F.concat(F.lit("p_ind«"), "c_name"))).alias("line"))


def mrz_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = letters(F.col("c_custkey"))
    line1 = mrz.fit_line(F.concat(F.lit("P<IND"), name, F.lit("<<ANN<MARY")))
    line2 = mrz.fit_line(F.concat(F.rpad(F.concat(F.lit("P"), F.col("c_custkey").cast("string")), 9, "<"), F.lit("1IND8503124F3001017"), F.rpad(F.col("c_custkey").cast("string"), 14, "<")))
    return table(spark, sf_dir, "customer").select("c_custkey", *[c.alias(k) for k, c in mrz.parse_mrz(line1, line2).items()], mrz.mrz_date(F.lit("850312")).alias("born"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes: an order is a page, quantity and price place an item on it."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("t"), (F.col("l_partkey") % 50).cast("string")).alias("text"), ((F.col("l_partkey") % 100) / 100).alias("confidence"), (F.col("l_partkey") % 300).cast("double").alias("cx"), (F.col("l_suppkey") % 7 * 20 + F.col("l_quantity")).alias("cy"))


def nearest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(spark, sf_dir)
    return layout.nearest_value(tokens, tokens.where("ord % 2 = 1"))


def unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(spark, sf_dir)
    return layout.unpaired(tokens, tokens.where("ord = 1")).select("doc_id", "ord", "text")


def combine_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 4, "0").alias("text"), F.lit(0.5).alias("confidence"))
    return layout.combine_digits(tokens).select("doc_id", "ord", "number", "confidence")


def candidate_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), (F.col("l_partkey") % 3).cast("string").alias("number"), ((F.col("l_partkey") % 8) / 8).alias("score"))
    return layout.candidate_vote(candidates).select("doc_id", "number", F.round("final", 6).alias("final"))


def label_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first keyword of all, in the dictionary's order, that a turn of a conversation holds."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", adapt.label_keyword(F.col("text"))[0].alias("keyword"))


def label_keyword_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of all 117 keywords that a text holds, and its field."""
    keyword, field = adapt.label_keyword(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", keyword.alias("keyword"), field.alias("field"))


def fuzzy_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = scans(spark, sf_dir).select("request_id", F.col("fields")["passport_number"].alias("passport_number"), F.regexp_replace(F.col("fields")["name"], "B", "Z").alias("ocr")).join(registry(spark, sf_dir), "passport_number")
    same, percent = similarity.names_match(F.col("ocr"), F.col("name"))
    return joined.select("request_id", same.alias("matches"), percent.alias("percent"))


def fuzzy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.fuzzy_dedup(_tokens(spark, sf_dir).withColumn("ord", F.col("ord").cast("int")))


def dynamic_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(spark, sf_dir).withColumn("ord", F.col("ord").cast("int"))
    return layout.dynamic_fields(tokens.withColumn("text", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("No 20"), F.lpad((F.col("cx") % 97).cast("int").cast("string"), 4, "0"))).otherwise(F.col("text"))))


def field_compare_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    visual = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, letters(F.col("c_custkey"))).otherwise("ZZZZZZ")
    status, value = similarity.compare_fields(visual, letters(F.col("c_custkey")))
    return table(spark, sf_dir, "customer").select("c_custkey", status.alias("status"), value.alias("similarity"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Texts by key: {k} stands for the customer's key, {d} for a day of its month.
TEXTS = {
    "date_extract": ("Issued {d}/01/2020 until 2030-01-{d}", "15JAN2020 and 15 MAR 21", "1.2.2020 or {d}-03-99", "{d}/01/2020 {d}/01/2020", "5 JANUARY 2020", ""),
    "visa_numbers": ("Visa No: AB{k}0000", "visa number 12345{k}, control # C-{k}", "CONTROL NO.{k}9999", "reference: R{k}XYZ visa V{k}7654", "visa visa12", ""),
    "nationality": ("Nationality: United States 4", "country - INDIA", "NATIONALITY/COUNTRY: FR", "x country of {k}", "nationality{k} country: Peru", ""),
    "visa_type": ("Visa Type: B1/B2 tourist", "type of visa - Work {k}", "class: E", "type x", "TYPE VISA: H-1B", ""),
    "clean_name": ("Name: Union Bank of India", "Son of Driving Licence {k}", "DATE BIRTH", "ann  m. lee", "Daughter, Blood Group", ""),
    "clean_relation": ("S/o x Son/Daughter/Wife of: Raj {k}", "Wife of  Lee K.", "SON OF RAJ", "son daughter wife OF A", "daughter/wife of: BO", ""),
    "license_dates": ("DOB O1/I2/199{k}", "12 / 05 / 2O20 and 12-05-2020", "112/05/2020", "32/01/2000 1.1.2100", "5\\6\\1999", ""),
    "number_scan": ("4321 8765 {k}000 1", "no 123412341234 {k}", "x", "999941057058 12", "12 34 56", ""),
}


def _shape(name: str, k, d):
    shapes = TEXTS[name]
    text = F.get(F.array(*[F.lit(t) for t in shapes]), (k % len(shapes)).cast("int"))
    return F.replace(F.replace(text, F.lit("{k}"), k.cast("string")), F.lit("{d}"), d.cast("string"))


def _by_shape(shape: str, **columns):
    """A query over customers: each column is a function of the text that TEXTS makes of a key."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = F.col("c_custkey")
        made = table(spark, sf_dir, "customer").select("c_custkey", _shape(shape, k, k % 28 + 1).alias("t"))
        return made.select("c_custkey", *[f(F.col("t")).alias(c) for c, f in columns.items()])

    query.__name__ = shape
    return query


def shape_sql(name: str) -> str:
    shapes = ", ".join(quoted(t) for t in TEXTS[name])
    return f"(select c_custkey, replace(replace(list_value({shapes})[(c_custkey % {len(TEXTS[name])} + 1)::int], '{{k}}', c_custkey::varchar), '{{d}}', (c_custkey % 28 + 1)::varchar) as t from customer)"


joined = lambda f: lambda t: F.array_join(f(t), ",")
date_extract = _by_shape("date_extract", dates=joined(extract.extract_dates))
visa_numbers = _by_shape("visa_numbers", numbers=joined(extract.visa_numbers))
nationality = _by_shape("nationality", nationality=extract.nationality)
visa_type = _by_shape("visa_type", visa_type=extract.visa_type)
clean_name = _by_shape("clean_name", name=extract.clean_person_name)
clean_relation = _by_shape("clean_relation", relation=extract.clean_relation)
license_dates = _by_shape("license_dates", dates=joined(extract.license_dates), first=extract.license_date)


def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of visas and of forms on every user's readings, and on customers without any."""
    tokens = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), ((F.col("event_id") % 16) / 16).alias("confidence"))
    pages = tokens.select("doc_id").unionByName(table(spark, sf_dir, "customer").select((F.col("c_custkey") - 50).alias("doc_id")))
    each = [layout.image_quality(tokens, pages, rule).withColumn("kind", F.lit(kind)) for kind, rule in (("visa", layout.VISA_QUALITY), ("form", layout.FORM_QUALITY))]
    return each[0].unionByName(each[1])


def find_after_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("the "), "role")).otherwise(F.col("role")).alias("text"))
    return layout.values_after_labels(tokens, {"after_user": ("USER", "HUMAN"), "after_assistant": ("assistant",)}, ("SYSTEM", "USER"))


VISA_TOKENS = ("VISA", "Surname", "Given name", "LEE {k}", "Passport No", "P12{k}345", "NATIONALITY: PERU", "issue date", "0{k}/01/2020", "Visa Type: B1")


def _visa_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the tokens of a visa: an order is a page, the part says which token."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    text = F.get(F.array(*[F.lit(t) for t in VISA_TOKENS]), (F.col("p") % len(VISA_TOKENS)).cast("int"))
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.replace(text, F.lit("{k}"), (F.col("l_orderkey") % 10).cast("string")).alias("text"))


def visa_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.visa_fields(_visa_tokens(spark, sf_dir))
    return found.select("doc_id", "surname", "given_name", "passport_number", "visa_number", "issue_date", "nationality", "visa_type", F.array_join("dates", ",").alias("dates"))


def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.full_text(_visa_tokens(spark, sf_dir))


def _single_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As _tokens, one for each place of an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    return lines.select("doc_id", "ord", F.concat(F.lit("t"), (F.col("p") % 50).cast("string")).alias("text"), ((F.col("p") % 100) / 100).alias("confidence"), (F.col("p") % 300).cast("double").alias("cx"), (F.col("s") % 7 * 20 + F.col("q")).alias("cy"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _single_tokens(spark, sf_dir)
    placed = layout.reading_order(tokens)
    for by in ("height", "confidence"):
        placed = layout.reading_order(placed.withColumnRenamed("place", f"p_{by}_before"), by)
    return placed.select("doc_id", "ord", "cx", "cy", F.col("p_height_before").alias("by_lines"), F.col("p_confidence_before").alias("by_height"), F.col("place").alias("by_confidence"))


def union_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("text"))
    return layout.union_passes([tokens, tokens.where("text = 'F'"), tokens.where("text = 'O'")]).select("doc_id", "ord", "text", "pass")


def number_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a page of one token; the number found, its score and its status."""
    k = F.col("c_custkey")
    tokens = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit(1).alias("ord"), _shape("number_scan", k, k % 28 + 1).alias("text"), ((k % 10) / 20).alias("confidence"), F.lit(0.0).alias("cy"))
    best = tokens.select("doc_id").join(layout.find_numbers(tokens), "doc_id", "left")
    status = extract.number_status(F.col("final"), F.col("number"), checksum.verhoeff_valid(F.col("number")))
    return best.select("doc_id", "number", "occurrences", status.alias("s")).select("doc_id", "number", "occurrences", "s.*")


def detected_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _single_tokens(spark, sf_dir).withColumn("text", F.concat_ws(" ", "text", (F.col("cx").cast("int") * 733).cast("string"), F.lit("123456")))
    return layout.numbered(tokens, extract.long_numbers, "Detected Number ")


def zone_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read twice, equal, different or missing by key: the tallies and what they lead to."""
    k = F.col("c_custkey")
    fields = {f: F.when(k % (i + 2) != 0, F.concat(F.lit("ABC<"), letters(k))) for i, f in enumerate(similarity.TWICE)}
    zone = {f: F.when(k % (i + 3) == 0, "ZZZZZZZZZZZ").otherwise(F.concat(F.lit("ABC "), letters(k))) for i, f in enumerate(similarity.TWICE)}
    of = lambda d: F.struct(*[v.alias(f) for f, v in d.items()])
    base = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", similarity.tally(similarity.compare_zones(of(fields), of(zone))).alias("t"))
    status = similarity.verification_status(k % 9 != 0, F.col("t.available"), F.col("t.matches"), F.col("t.mismatches"), F.col("t.confidence"))
    return base.select("c_custkey", "t.available", "t.matches", "t.mismatches", status.alias("status"))


def passport_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    line1 = mrz.fit_line(F.concat(F.lit("P<UTO"), letters(k), F.lit("<<ANN<MARY")))
    line2 = mrz.fit_line(F.concat(F.rpad(F.concat(F.lit("P"), k.cast("string")), 9, "<"), F.lit("1IND85"), F.lpad((k % 14).cast("string"), 2, "0"), F.lit("124"), F.get(F.array(*[F.lit(x) for x in ("F", "M", "0", "<")]), (k % 4).cast("int")), F.lit("3001017")))
    fields = mrz.parse_passport(line1, line2, {"IND": "India"})
    return table(spark, sf_dir, "customer").select("c_custkey", *[fields[f].alias(f) for f in ("name", "surname", "sex", "date_of_birth", "nationality", "passport_type", "passport_number", "issuing_country", "expiration_date")])


def all_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code and name of the country tables, beside unknown ones."""
    known = [*adapt.ALPHA3, *adapt.COUNTRY_NAMES, "ATLANTIS", "QQQ", "Zz"]
    rows = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.explode(F.array(*[F.lit(x) for x in known])).alias("raw"))
    return rows.select("raw", adapt.normalize_country(F.concat(F.lit(" "), F.lower("raw"))).alias("country"))


def all_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.explode(F.array(*[F.lit(x) for x in (*adapt.FIELD_NAMES, "something")])).alias("raw"))
    return rows.select("raw", adapt.rename_field(F.upper("raw")).alias("field"))


FUNCTIONS = (
    normalize_name, normalize_identifier, normalize_numeric_id, normalize_gender, adapter_gender, normalize_date_formats, adapter_date, normalize_all_fields, field_rename,
    country_norm, verhoeff, mask_number, id_candidates, date_extract, passport_numbers, visa_numbers, label_value_split, license_number, blood_group, clean_name, clean_relation,
    nationality, visa_type, license_dates, visa_fields, full_text, reading_order, union_passes, number_scan, detected_numbers, zone_tally, passport_zone, all_countries, all_renames, mrz_clean, mrz_parse, nearest_value, unpaired, combine_tokens, candidate_vote, image_quality, find_after_label, label_keyword, label_keyword_all, fuzzy_name, fuzzy_dedup, dynamic_fields, field_compare_status,
)

_SEX_SQL = f"list_value({', '.join(repr(x) for x in SEX_TEXTS)})[(c_custkey % {len(SEX_TEXTS)} + 1)::int]"
_GENDER_SQL = f"(case when x = '' then 'UNKNOWN' when upper(x) in ('M', 'MALE', 'BOY', '0') then 'M' when upper(x) in ('F', 'FEMALE', 'GIRL', '1') then 'F' when upper(x) like '%TRANS%' then 'TRANSGENDER' else upper(x)[1] end)"
_LETTERS = lambda k: f"translate({k}::varchar, '0123456789', 'ABCDEFGHIJ')"
_NUMBER = "lpad((o_orderkey * 7919 + 13)::varchar, 12, '7')"
_TOKENS = "t as (select l_orderkey as doc_id, l_linenumber as ord, 't' || (l_partkey % 50)::varchar as text, (l_partkey % 100) / 100.0 as confidence, (l_partkey % 300)::double as cx, l_suppkey % 7 * 20 + l_quantity as cy from lineitem)"


_SINGLE = "t as (select l_orderkey as doc_id, l_linenumber as ord, (min(l_partkey) % 100) / 100.0 as confidence, (min(l_partkey) % 300)::double as cx, min(l_suppkey) % 7 * 20 + min(l_quantity) as cy from lineitem group by 1, 2)"
_VISA = f"""t as (select l_orderkey as doc_id, l_linenumber as ord, replace(list_value({", ".join(quoted(x) for x in VISA_TOKENS)})[(min(l_partkey) % {len(VISA_TOKENS)} + 1)::int], '{{k}}', (l_orderkey % 10)::varchar) as text from lineitem group by 1, 2)"""

def _verhoeff_sql(number: str) -> str:
    digits = f"list_transform(range(0, 12), lambda i: list_value({', '.join(map(str, checksum.PERMUTED))})[((i % 8) * 10 + {number}[12 - i]::int + 1)::int])"
    return f"(list_reduce(list_prepend(0, {digits}), lambda c, x: list_value({', '.join(map(str, checksum.PRODUCT))})[(c * 10 + x + 1)::int]) = 0)"


SQL = {
    "normalize_name": "select p_partkey, trim(regexp_replace(upper(p_name || '<' || p_type), '[^A-Z]+', ' ', 'g')) as name from part",
    "normalize_identifier": "select c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') as identifier from customer",
    "normalize_numeric_id": "select p_partkey, translate(regexp_replace(upper(p_brand || '-' || p_type), '[^A-Z0-9]', '', 'g'), 'OQILZSB', '0011258') as number from part",
    "normalize_gender": f"select c_custkey, {_GENDER_SQL} as gender from (select c_custkey, {_SEX_SQL} as x from customer)",
    "adapter_gender": "select c_custkey, ['F', 'F', 'F', 'M'][(c_custkey % 4 + 1)::int] as gender from customer",
    "normalize_date_formats": """select o_orderkey, case when o_orderkey % 7 < 6 then strftime(case when o_orderkey % 7 = 3 and day(o_orderdate) <= 12 then make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) else o_orderdate::date end, '%Y-%m-%d') end as iso from orders""",
    "adapter_date": """select o_orderkey, case o_orderkey % 7 when 6 then 'no date' when 4 then strftime(o_orderdate, '%Y%m%d')
        when 2 then strftime(o_orderdate, '%Y-%d-%m') else strftime(o_orderdate, '%Y-%m-%d') end as iso from orders""",
    "normalize_all_fields": f"""select c_custkey, trim(regexp_replace(upper(c_name), '[^A-Z]+', ' ', 'g')) as full_name, case when x <> '' then {_GENDER_SQL} end as sex,
        'X' || c_custkey::varchar as member_id, c_mktsegment as note from (select *, {_SEX_SQL} as x from customer)""",
    "field_rename": "select n_nationkey, ['name', 'date_of_birth', 'date_of_expiry', 'permit_number', 'something', 'id_number'][n_nationkey % 6 + 1] as field from nation",
    "country_norm": "select n_nationkey, ['IN', 'DE', 'XX', 'ATLANTIS', 'FR', 'GB'][n_nationkey % 6 + 1] as country from nation",
    "verhoeff": f"""with n as (select o_orderkey, {_NUMBER} as n from orders),
        d as (select o_orderkey, list_transform(range(0, 12), lambda i: list_value({', '.join(map(str, checksum.PERMUTED))})[((i % 8) * 10 + n[12 - i]::int + 1)::int]) as p from n)
        select o_orderkey, list_reduce(list_prepend(0, p), lambda c, x: list_value({', '.join(map(str, checksum.PRODUCT))})[(c * 10 + x + 1)::int]) = 0 as valid from d""",
    "mask_number": f"select o_orderkey, 'XXXX XXXX ' || right({_NUMBER}, 4) as masked from orders",
    "id_candidates": f"select o_orderkey, {_NUMBER} as numbers from orders",
    "passport_numbers": "select c_custkey, 'P' || lpad(c_custkey::varchar, 7, '0') as numbers from customer",
    "label_value_split": "select c_custkey, case when c_custkey % 3 = 0 then 'Name' end as label, case when c_custkey % 3 = 0 then c_name end as value from customer",
    "license_number": """select c_custkey, case when length(d) between 8 and 20 then d end as number
        from (select c_custkey, regexp_replace(translate('DL-O' || case when c_custkey % 2 = 0 then '12345' else '' end || c_custkey || 'I', 'OIL', '011'), '[^0-9]', '', 'g') as d from customer)""",
    "blood_group": "select c_custkey, case c_custkey % 5 when 2 then 'O+' when 3 then 'B-' end as blood_group from customer",
    "mrz_clean": "select c_custkey, rpad(left(regexp_replace('P<IND<' || upper(c_name), '[^A-Z0-9<]', '', 'g'), 44), 44, '<') as line from customer",
    "mrz_parse": f"""select c_custkey, 'P<' as document_code, 'IND' as issuing_country, {_LETTERS('c_custkey')} as surname, 'ANN MARY' as given_name, 'P' || c_custkey as visa_number,
        case when length(c_custkey::varchar) >= 6 then c_custkey::varchar else 'P' || c_custkey end as passport_number, 'IND' as nationality, '850312' as birth_date, 'F' as sex,
        '300101' as expiration_date, c_custkey::varchar as personal_number, '12/03/1985' as born from customer""",
    "nearest_value": f"""with {_TOKENS}, p as (select a.doc_id, a.ord as label_ord, b.ord as value_ord, b.cx - a.cx as dx, b.cy - a.cy as dy from t a join t b on a.doc_id = b.doc_id and a.ord <> b.ord where a.ord % 2 = 1),
        r as (select doc_id, label_ord, arg_min(value_ord, (dx + 2 * abs(dy), value_ord)) as value_ord, min(dx + 2 * abs(dy)) as distance from p where dx > 0 and abs(dy) < 45 group by all),
        b as (select doc_id, label_ord, arg_min(value_ord, (dy, value_ord)) as value_ord, min(dy) as distance from p where dy > 0 and dy < 80 group by all)
        select * from r union all select * from b where not exists (select 1 from r where r.doc_id = b.doc_id and r.label_ord = b.label_ord)""",
    "unpaired": f"with {_TOKENS} select doc_id, ord, text from t where not exists (select 1 from t u where u.doc_id = t.doc_id and u.ord = 1 and u.text = t.text)",
    "combine_tokens": """with t as (select l_orderkey as doc_id, l_linenumber as ord, lpad((min(l_partkey) % 1000)::varchar, 4, '0') as text from lineitem group by 1, 2)
        select doc_id, ord, number, 0.5::double as confidence from (select doc_id, ord, text || lead(text) over w || lead(text, 2) over w as number from t window w as (partition by doc_id order by ord)) where number is not null""",
    "candidate_vote": """with v as (select l_orderkey as doc_id, (l_partkey % 3)::varchar as number, max((l_partkey % 8) / 8.0) + 0.05 * least(count(*), 5) as final, min(l_linenumber) as first from lineitem group by 1, 2)
        select doc_id, arg_min(number, (-final, first, number)) as number, round(max(final)::double, 6) as final from v group by 1""",
    # Ones are misread, so B is Z; what is left of a name's letters stands in the same order on both sides. QQQQ shares none.
    "fuzzy_name": """
        with s as (select o_orderkey as k, o_custkey as c from orders join customer on o_custkey = c_custkey where o_orderkey % 10 <> 0 and o_custkey % 5 <> 0),
        r as (select *, 7 + length(c::varchar) as n, length(replace(c::varchar, '1', '')) + 7 as m from s),
        p as (select k, case when k % 7 = 0 then 0.0 else 100.0 * m / n end as percent from r)
        select k::varchar as request_id, percent >= 85 as matches, round(percent::double, 2) as percent from p""",
    # Texts of three characters resemble none but themselves.
    "fuzzy_dedup": f"""with {_TOKENS}, r as (select *, row_number() over (partition by doc_id, text order by confidence desc, ord) as place from t)
        select doc_id, ord::int as ord, text, confidence::double as confidence from r where place = 1""",
    "label_keyword": "select conv_id, turn, case " + " ".join(f"when contains(lower(text), {quoted(k)}) then {quoted(k)}" for k in adapt.LABEL_KEYWORDS) + " end as keyword from conversations",
    "label_keyword_all": "select item_id, " + ", ".join(
        "case " + " ".join(f"when contains(lower(text), {quoted(k)}) then {quoted(shown)}" for k, shown in pairs) + f" end as {name}"
        for name, pairs in (("keyword", [(k, k) for k in adapt.LABEL_KEYWORDS]), ("field", list(adapt.LABEL_KEYWORDS.items())))
    ) + " from benchmark",
    "field_compare_status": "select c_custkey, ['NOT_AVAILABLE', 'MATCH', 'MISMATCH'][(c_custkey % 3 + 1)::int] as status, case when c_custkey % 3 = 1 then 1.0 else 0.0 end::double as similarity from customer",
    "date_extract": f"""select c_custkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as dates from (
        select c_custkey, list_concat({", ".join(f"regexp_extract_all(upper(t), {quoted(p)})" for p in extract.DATES)}) as l from {shape_sql("date_extract")})""",
    "visa_numbers": f"""select c_custkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as numbers from (
        select c_custkey, list_concat({", ".join(f"regexp_extract_all(upper(t), {quoted(p)}, 1)" for p in extract.VISA_NUMBERS)}) as l from {shape_sql("visa_numbers")})""",
    **{
        name: f"""select c_custkey, trim(coalesce({", ".join(f"nullif(regexp_extract(upper(t), {quoted(p)}, 1), '')" for p in patterns)})) as {name} from {shape_sql(name)}"""
        for name, patterns in (("nationality", extract.NATIONALITIES), ("visa_type", extract.VISA_TYPES))
    },
    "clean_name": f"""select c_custkey, nullif(array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(upper(t), '[^A-Z .]', ' ', 'g')), '\\s+'),
        lambda w: w not in ('NAME', 'DRIVING', 'LICENCE', 'LICENSE', 'UNION', 'INDIA', 'DATE', 'BIRTH', 'BLOOD', 'GROUP', 'VALIDITY', 'ISSUE', '')), ' '), '') as name from {shape_sql("clean_name")}""",
    "clean_relation": f"""select c_custkey, case when length(x) >= 2 then x end as relation from (
        select c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(t), '^.*(SON *DAUGHTER *WIFE|SON/DAUGHTER/WIFE|DAUGHTER/WIFE|WIFE) +OF', ''), '[^A-Z .]', ' ', 'g'), ' +', ' ', 'g')) as x from {shape_sql("clean_relation")})""",
    "license_dates": f"""with r as (select c_custkey, regexp_replace(translate(upper(t), 'OQIL|\\.-', '00111///'), '\\s*/\\s*', '/', 'g') as u from {shape_sql("license_dates")}),
        -- a digit more before the day makes it too long to be one
        m as (select c_custkey, list_transform(list_filter(regexp_extract_all(u, '\\d+/\\d+/\\d+'), lambda x: regexp_matches(x, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$')), lambda x: string_split(x, '/')) as p from r),
        g as (select c_custkey, list_transform(list_filter(p, lambda x: x[1]::int between 1 and 31 and x[2]::int between 1 and 12 and x[3]::int between 1900 and 2100), lambda x: printf('%02d/%02d/%04d', x[1]::int, x[2]::int, x[3]::int)) as l from m)
        select c_custkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as dates, l[1] as first from g""",
    "image_quality": """with t as (select user_id as doc_id, (event_id % 16) / 16.0 as c from events), p as (select doc_id from t union select c_custkey - 50 from customer),
        s as (select p.doc_id, coalesce(avg(c), 0)::double as mean_confidence, count(c) as n, count(*) filter (c >= 0.4) as r40, count(*) filter (c >= 0.5) as r50 from p left join t on p.doc_id = t.doc_id group by 1),
        k as (
            select doc_id, mean_confidence, r40 as readable, 'visa' as kind, case when n = 0 then 'No readable text was detected.' when r40 < 2 then 'Not enough readable visa text was detected.'
                   when mean_confidence < 0.5 then 'OCR confidence is too low.' else 'Image quality is sufficient.' end as reason from s
            union all
            select doc_id, mean_confidence, r50, 'form', case when n = 0 then 'No readable text was detected.' when mean_confidence < 0.55 then 'OCR confidence is too low.'
                   when r50 < 2 then 'Insufficient readable text was detected.' else 'Sufficient text was detected.' end from s)
        select *, reason in ('Image quality is sufficient.', 'Sufficient text was detected.') as clear from k""",
    "find_after_label": """with t as (select conv_id as doc_id, turn as ord, case when turn % 3 = 0 then 'the ' || role else role end as text from conversations),
        a as (select *, list_filter(list(trim(text)) over (partition by doc_id order by ord rows between 1 following and 5 following), lambda x: x <> '' and upper(x) not in ('SYSTEM', 'USER'))[1] as value from t)
        select doc_id, arg_min(value, ord) filter (value is not null and (upper(text) like '%USER%' or upper(text) like '%HUMAN%')) as after_user,
               arg_min(value, ord) filter (value is not null and upper(text) like '%ASSISTANT%') as after_assistant from a group by 1""",
    "visa_fields": f"""with {_VISA}, a as (
            select *, list_filter(list(trim(text)) over (partition by doc_id order by ord rows between 1 following and 5 following), lambda x: upper(x) not in ('SURNAME', 'GIVEN NAME', 'PASSPORT NO', 'ISSUE DATE'))[1] as value from t),
        b as (select *, value as v, upper(text) as u from a),
        f as (select doc_id, arg_min(v, ord) filter (v is not null and u like '%SURNAME%') as surname, arg_min(v, ord) filter (v is not null and u like '%GIVEN NAME%') as given_name,
                     arg_min(v, ord) filter (v is not null and u like '%PASSPORT NO%') as passport_label, arg_min(v, ord) filter (v is not null and u like '%ISSUE DATE%') as issue_label, string_agg(text, ' ' order by ord) as x from b group by 1)
        select doc_id, surname, given_name, coalesce(passport_label, regexp_extract_all(upper(x), '\\b[A-Z0-9]{{6,12}}\\b').list_filter(lambda y: regexp_matches(y, '[0-9]'))[1]) as passport_number,
               nullif(regexp_extract(upper(x), {quoted(extract.VISA_NUMBERS[0])}, 1), '') as visa_number, issue_label as issue_date,
               trim(nullif(regexp_extract(upper(x), {quoted(extract.NATIONALITIES[0])}, 1), '')) as nationality, trim(nullif(regexp_extract(upper(x), {quoted(extract.VISA_TYPES[0])}, 1), '')) as visa_type,
               array_to_string(list_distinct(regexp_extract_all(x, '\\d\\d/\\d\\d/\\d{{4}}')), ',') as dates from f""",
    "full_text": f"with {_VISA} select doc_id, string_agg(text, ' ' order by ord) as text from t group by 1",
    "reading_order": f"""with {_SINGLE}, u as (select * from t)
        select doc_id, ord, cx, cy, row_number() over (partition by doc_id order by cy, cx, ord) as by_lines, row_number() over (partition by doc_id order by cy, ord) as by_height,
               row_number() over (partition by doc_id order by confidence desc, ord) as by_confidence from u""",
    "union_passes": """select o_custkey as doc_id, row_number() over (partition by o_custkey order by pass, o_orderkey) as ord, o_orderstatus as text, pass from (
        select *, 0 as pass from orders union all select *, 1 from orders where o_orderstatus = 'F' union all select *, 2 from orders where o_orderstatus = 'O')""",
    "number_scan": f"""with s as (select c_custkey as doc_id, t, (c_custkey % 10) / 20.0 as c from {shape_sql("number_scan")}),
        d as (select *, regexp_replace(t, '[^0-9]', '', 'g') as digits from s),
        direct as (select doc_id, c, unnest(list_concat(list_transform(regexp_extract_all(t, '\\b\\d{{4}}\\s+\\d{{4}}\\s+\\d{{4}}\\b'), lambda x: replace(x, ' ', '')), regexp_extract_all(t, '\\b\\d{{12}}\\b'))) as number from s),
        whole as (select doc_id, c, digits as number from d where length(digits) = 12 and length(digits) >= 0.6 * length(replace(t, ' ', ''))),
        every as (select * from direct union all select * from whole),
        v as (select doc_id, number, least(1.0, max(c) + 0.1 + case when {_verhoeff_sql("number")} then 0.15 else 0 end + 0.05 * count(*)) as final, count(*) as occurrences from every group by 1, 2)
        select doc_id, number, occurrences, case when final is null then 'CLEARER IMAGE REQUIRED' when final < 0.4 then 'AADHAAR DETECTED - LOW CONFIDENCE' else 'AADHAAR NUMBER DETECTED' end as status,
               coalesce(round(final * 100, 2), 0.0)::double as ocr_confidence, case when final is null then 'NOT DETECTED' else 'XXXX XXXX ' || right(number, 4) end as masked_number,
               case when final is null then 'No reliable 12-digit Aadhaar number was detected.' when final < 0.4 then 'A possible Aadhaar number was detected, but OCR confidence is low.'
                    when {_verhoeff_sql("number")} then 'A 12-digit Aadhaar number was detected and the extracted number passed Verhoeff checksum validation.'
                    else 'A 12-digit Aadhaar number was detected. The extracted number did not pass checksum validation.' end as reason
        from (select c_custkey as doc_id from customer) left join v using (doc_id)""",
    "detected_numbers": f"""with {_SINGLE}, u as (select doc_id, ord, cx, cy, confidence, (cx::int * 733)::varchar as n from t),
        f as (select *, unnest(case when length(n) >= 5 then [n, '123456'] else ['123456'] end) as value, unnest(case when length(n) >= 5 then [0, 1] else [1] end) as place from u)
        select doc_id, 'Detected Number ' || row_number() over (partition by doc_id order by cy, cx, ord, place) as label, value, round(confidence, 3)::double as confidence, 'pattern_detection' as source from f""",
    "zone_tally": """with k as (select c_custkey as k, unnest(range(0, 7)) as i from customer),
        s as (select k, count(*) filter (k % (i + 2) <> 0) as available, count(*) filter (k % (i + 2) <> 0 and k % (i + 3) <> 0) as matches, count(*) filter (k % (i + 2) <> 0 and k % (i + 3) = 0) as mismatches from k group by 1)
        select k as c_custkey, available::int as available, matches::int as matches, mismatches::int as mismatches,
               case when k % 9 = 0 then 'VISA DATA DETECTED' when available = 0 then 'CLEARER IMAGE REQUIRED' when mismatches = 0 and matches >= 2 then 'VERIFIED' when mismatches >= 2 then 'MISMATCH DETECTED'
                    when 100.0 * matches / available < 70 then 'CLEARER IMAGE REQUIRED' else 'REVIEW REQUIRED' end as status from s""",
    "passport_zone": f"""select c_custkey, 'ANN MARY' as name, {_LETTERS('c_custkey')} as surname, ['F', 'M', 'M', 'F'][(c_custkey % 4 + 1)::int] as sex, case when c_custkey % 14 between 1 and 12 then printf('12/%02d/1985', c_custkey % 14) end as date_of_birth,
        'India' as nationality, 'P' as passport_type, 'P' || c_custkey as passport_number, 'UTO' as issuing_country, '01/01/2030' as expiration_date from customer""",
    "all_countries": "select * from (values "
    + ", ".join(f"({quoted(x)}, {quoted(c)})" for x, c in [*adapt.ALPHA3.items(), *adapt.COUNTRY_NAMES.items(), ("ATLANTIS", "ATLANTIS"), ("QQQ", "QQQ"), ("Zz", "ZZ")])
    + ") as t(raw, country)",
    "all_renames": "select * from (values " + ", ".join(f"({quoted(x)}, {quoted(c)})" for x, c in [*adapt.FIELD_NAMES.items(), ("something", "something")]) + ") as t(raw, field)",
}
