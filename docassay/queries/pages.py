"""Queries over pages of tokens that are built from customers: licences, forms, zones, repeated readings, names.

Every customer is a page; which of a few layouts it has follows from the key. The twins say what each layout leads to, worked
out by hand, so they share nothing with the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions import adapt, similarity
from docassay.functions.wrappers import flatten_result
from docassay.operators import layout
from docassay.queries.validation import letters, table

Token = tuple[str, float, float, float]
LETTERS = "translate(cast(c_custkey as string), '0123456789', 'ABCDEFGHIJ')"

#: Layouts as (text in SQL, confidence, cx, cy).
LICENCES: list[list[Token]] = [
    # A misread label, its value to the right; a pair within one token; numbers, the first of them in a value.
    [("'NARNE'", 0.9, 0, 0), ("c_name", 0.8, 200, 10), ("'DOB: 12/05/1990'", 0.7, 0, 300), ("concat('REF ', cast(1000000 + c_custkey as string))", 0.6, 0, 600)],
    # A value below is nearer than one to the right; a value too far away belongs to nothing.
    [("'BLOOD GROUP'", 0.5, 0, 0), ("'x9'", 0.9, 300, 60), ("'B+'", 0.95, 50, 100), ("'Issue Date'", 0.9, 0, 400), ("'x2'", 0.9, 500, 470)],
    # Dates come by their shape, days first before years first; the dash makes a pair of its text as well.
    [("'hello'", 0.9, 0, 0), ("'2020-02-01 and 03/04/2021'", 0.4, 0, 50)],
]
FORMS: list[list[Token]] = [
    [("'Name:'", 0.9, 0, 0), ("c_name", 0.71239, 100, 10)],
    # The nearest text looks like a label, so the first label gets nothing; the second takes the number.
    [("'Zip'", 0.9, 0, 0), ("'City'", 0.8, 50, 0), ("'12345'", 0.7, 200, 0)],
    [("'No'", 0.5, 0, 0), ("concat('99', cast(1000 + c_custkey as string))", 0.9, 5, 60), ("'30021'", 0.9, 5, 79)],
    [("concat('Ref - ', cast(c_custkey as string))", 0.33333, 9, 9)],
]
_LINE1, _LINE2 = f"rpad(concat('P<INDLEE<<', {LETTERS}), 44, '<')", "rpad(concat('P', lpad(cast(c_custkey as string), 7, '0'), '<4IND8001014F2501017'), 43, '<')"
ZONES: list[list[Token]] = [
    [(f"{_LINE2}", 0.8, 0, 20), (f"{_LINE1}", 0.9, 0, 10), ("'P<SHORT'", 0.99, 0, 5)],
    # A second, surer reading of the first line, in small letters with a space and one letter wrong.
    [(f"{_LINE1}", 0.6, 0, 10), (f"{_LINE2}", 0.7, 0, 20), (f"lower(replace({_LINE1}, 'INDLEE', 'IND LEF'))", 0.95, 0, 11)],
    [(f"{_LINE1}", 0.9, 0, 10)],
    [(f"concat('A', substring({_LINE1}, 2, 43))", 0.5, 0, 10), (f"{_LINE2}", 0.75, 0, 20)],
    [("'nothing long'", 0.9, 0, 0)],
]
#: Two passes over the same page.
PASSES: list[list[Token]] = [
    [("'AB 1234'", 0.6, 0, 0), ("'XY'", 0.5, 0, 0), ("'!!'", 0.9, 0, 0), ("concat('NO 77', cast(1000 + c_custkey as string))", 0.7, 0, 0)],
    [("'ab-1234'", 0.9, 0, 0), ("'XYZ'", 0.99, 0, 0), ("concat('NO77', cast(1000 + c_custkey as string), '.')", 0.7, 0, 0)],
]


def _pages(spark: SparkSession, sf_dir: str, layouts: list[list[Token]], *, every: int | None = None) -> DataFrame:
    """doc_id, ord, text, confidence, cx, cy; ``every``: all customers have this one layout."""
    one = lambda tokens: "array(" + ", ".join(f"named_struct('text', {t}, 'confidence', double({c}), 'cx', double({x}), 'cy', double({y}))" for t, c, x, y in tokens) + ")"
    made = one(layouts[every]) if every is not None else f"case c_custkey % {len(layouts)} " + " ".join(f"when {i} then {one(t)}" for i, t in enumerate(layouts)) + " end"
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.expr(made)).alias("ord", "t"))
    return rows.select("doc_id", F.col("ord").cast("int").alias("ord"), "t.*")


def licence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence fields by misread labels and place, with dates and numbers counted through the page."""
    return layout.licence_fields(_pages(spark, sf_dir, LICENCES))


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form fields within a token, right of a label or below it; a label in the way ends a search."""
    return layout.dynamic_fields(_pages(spark, sf_dir, FORMS))


def zone_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two lines of a machine-readable zone among the readings of a page, or why there are none."""
    return layout.mrz_lines(_pages(spark, sf_dir, ZONES))


def repeated_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over each page as one bag, similar readings as one, the surer kept."""
    both = layout.union_passes([_pages(spark, sf_dir, PASSES, every=i) for i in range(2)])
    return layout.fuzzy_dedup(both.select("doc_id", "ord", "text", "confidence"))


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against the same names with letters put behind them or cut off in front: the share of common letters, and whether it is enough."""
    k, name = F.col("c_custkey"), F.concat(F.lit("HOLDER "), letters(F.col("c_custkey")))
    other = F.when(k % 2 == 0, F.concat(name, F.repeat(F.lit("z"), (k % 12).cast("int")))).otherwise(F.substring(name, 1 + k % 7, 100))
    same, percent = similarity.names_match(name, other)
    return table(spark, sf_dir, "customer").select("c_custkey", same.alias("matches"), percent.alias("percent"))


def form_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as an extraction engine's results, told apart by quality and fields, then brought into the common envelope."""
    pages = _pages(spark, sf_dir, FORMS).where("doc_id % 5 <> 0")
    results = layout.form_results(pages, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), "PERMIT")
    read = flatten_result(F.lit("permit"), F.to_json(F.struct(*[c for c in results.columns if c != "doc_id"])))
    shown = F.array_join(F.transform(F.map_entries("r.fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return results.select("doc_id", "raw_ocr", read.alias("r")).select("doc_id", "r.status", "r.ocr_confidence", "r.reason", shown.alias("fields"), F.array_join("r.unpaired", ";").alias("unpaired"), F.size("raw_ocr").alias("n_read"))


def nation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as they are written on documents: codes, names in several languages, and what no table knows."""
    raw = F.expr("case n_nationkey % 7 when 0 then n_name when 1 then 'deu' when 2 then ' Germany' when 3 then upper(substring(n_name, 1, 2)) when 4 then 'QQZ' when 5 then '' else 'united kingdom ' end")
    return table(spark, sf_dir, "nation").select("n_nationkey", adapt.normalize_country(raw).alias("country"))


FUNCTIONS = (licence_pages, form_pages, zone_pages, repeated_readings, similar_names, form_results, nation_codes)

SQL = {
    "licence_pages": """
        with c as (select c_custkey as k, c_custkey % 3 as i, c_name from customer),
        n as (select k, regexp_extract(c_name, '[0-9]+') as digits from c where i = 0)
        select k as doc_id, 'NAME' as label, c_name as value, 0.8::double as confidence, 'fuzzy_label_layout' as source from c where i = 0
        union all select k, 'DOB', '12/05/1990', 0.7, 'same_line' from c where i = 0
        union all select k, 'Detected Date 1', '12/05/1990', 0.7, 'pattern_detection' from c where i = 0
        union all select k, 'Detected Number 1', digits, 0.8, 'pattern_detection' from n
        union all select k, 'Detected Number 2', (1000000 + k)::varchar, 0.6, 'pattern_detection' from n
        union all select k, 'BLOOD GROUP', 'B+', 0.5, 'fuzzy_label_layout' from c where i = 1
        union all select k, 'Detected Date ' || j, ['03/04/2021', '2020-02-01'][j], 0.4, 'pattern_detection' from c, range(1, 3) as r(j) where i = 2
        union all select k, '2020', '02-01 and 03/04/2021', 0.4, 'same_line' from c where i = 2""",
    "form_pages": """
        with c as (select c_custkey as k, c_custkey % 4 as i, c_name from customer)
        select k as doc_id, ['Name', 'City', 'No', 'Ref'][i + 1] as label, [c_name, '12345', '99' || (1000 + k), k::varchar][i + 1] as value,
               [0.712, 0.7, 0.5, 0.333][i + 1]::double as confidence, case when i = 3 then 'same_line' else 'layout_relation' end as source from c""",
    "zone_pages": f"""
        with c as (select *, c_custkey as k, c_custkey % 5 as i, {_LINE1} as one, {_LINE2} as two from customer)
        select k as doc_id, case i when 0 then one when 1 then rpad(replace(one, 'INDLEE', 'INDLEF'), 44, '<')[1:44] when 2 then one when 3 then 'A' || one[2:] end as line1,
               case when i in (0, 1, 3) then rpad(two, 44, '<') end as line2, case i when 0 then 0.85 when 1 then 0.825 when 3 then 0.625 end::double as mrz_confidence,
               case i when 2 then 'Two MRZ lines were not detected.' when 3 then 'Detected text does not appear to be a standard MRZ.' when 4 then 'MRZ was not detected.' end as reason from c""",
    "repeated_readings": """
        select c_custkey as doc_id, ord::int as ord, text, confidence::double as confidence from customer,
            lateral (values (5, 'ab-1234', 0.9), (2, 'XY', 0.5), (4, 'NO 77' || (1000 + c_custkey), 0.7), (6, 'XYZ', 0.99)) as t(ord, text, confidence)""",
    "similar_names": """
        with c as (select c_custkey as k, 'HOLDER ' || translate(c_custkey::varchar, '0123456789', 'ABCDEFGHIJ') as name from customer),
        l as (select k, length(name) as n, case when k % 2 = 0 then length(name) + k % 12 else length(name) - case when k % 7 = 6 then 7 else k % 7 end end as m from c),
        r as (select k, 2.0 * least(n, m) / (n + m) * 100 as percent from l)
        select k as c_custkey, percent >= 85 as matches, round(percent::double, 2) as percent from r""",
    "form_results": """
        with c as (select c_custkey as k, case when c_custkey % 5 = 0 then 9 else c_custkey % 4 end as i, c_name from customer)
        select k as doc_id, case when i in (0, 1, 2) then 'OCR COMPLETED' else 'CLEARER IMAGE REQUIRED' end as status,
               case i when 0 then 80.62 when 1 then 80.0 when 2 then 76.67 when 3 then 33.33 else 0.0 end::double as ocr_confidence,
               case i when 3 then 'OCR confidence is too low.' when 9 then 'No readable text was detected.' else 'Text was extracted using layout-agnostic OCR and dynamic field detection.' end as reason,
               case i when 0 then 'Name=' || c_name when 1 then 'City=12345' when 2 then 'No=99' || (1000 + k) else '' end as fields, case i when 0 then 'Name:' when 1 then 'Zip;City' when 2 then 'No;30021' else '' end as unpaired, case when i in (1, 2) then 3 when i = 0 then 2 else 0 end::int as n_read from c""",
    "nation_codes": """select n_nationkey, case n_nationkey % 7 when 0 then upper(n_name) when 1 then 'DE' when 2 then 'DE' when 3 then upper(n_name[1:2]) when 4 then 'QQZ' when 6 then 'GB' end as country from nation""",
}
