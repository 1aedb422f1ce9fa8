"""Queries over extraction results: engines' layouts, repaired pages, adapted records, values behind labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions.adapt import adapt_record
from docassay.functions.repair import repair_layout
from docassay.functions.wrappers import flatten_result
from docassay.operators import layout
from docassay.queries.validation import spread, table

#: Results of the six engines, of which some are damaged, in SQL that both engines read; k is a customer's number.
RESULTS = {
    0: ("national_id", """concat('{"document_type":"NATIONAL ID","status":"OCR COMPLETED","ocr_confidence":', cast(k % 100 as string), '.5,"reason":"r","fields":{"Full Name":{"value":"', c_name, '","confidence":0.9},"Zip":', cast(k % 7 as string), ',"Lost":{"confidence":1},"Address":{"value":null},"DOB":{"value":"12/05/19', cast(50 + k % 49 as string), '"}},"unpaired_text":[{"text":"', c_mktsegment, '"},{"text":"IND"}]}')"""),
    1: ("permit", """concat('{"fields":null,"status":"REVIEW REQUIRED","unpaired_text":[{"text":"SURNAME"},{"text":"', c_mktsegment, '"}],"ocr_confidence":"', cast(k % 100 as string), '"}')"""),
    2: ("driving_license", """concat('{"document_type":"DRIVING LICENSE","fields":{"license_number":{"value":"MH12', cast(k as string), '"},"relation":{"value":"', c_mktsegment, '"},"flag":true},"unpaired_text":[{"text":"not read"}]}')"""),
    3: ("aadhaar", """concat('{"aadhaar_number":"', cast(100000000000 + k as string), '","masked_number":null,"format_valid":true,"ocr_occurrences":', cast(k % 9 as string), ',"status":"S","ocr_confidence":71.25}')"""),
    4: ("visa", """concat('{"fields":{"surname":"', c_mktsegment, '","given_name":"ANN","sex":"F","dates":["DOB","x', cast(k as string), '"]},"mrz":{"valid":true,"raw_line1":"P<', cast(k as string), '","nationality":"IND","visa_number":"V', cast(k as string), '"},"checks":{"name":"MATCH"},"matches":3,"ocr_confidence":88}')"""),
    5: ("passport", """concat('{"surname":"', c_mktsegment, '","name":"LEE","sex":"M","date_of_birth":"0', cast(1 + k % 9 as string), '/11/1990","nationality":"Germany","passport_number":"P', cast(k as string), '"}')"""),
    6: ("passport", "'{}'"),
    7: ("visa", "concat('{\"fields\": {\"a\": ', c_name)"),
    8: ("permit", "concat('[', cast(k as string), ']')"),
    9: ("unheard_of", "'{\"status\":\"S\",\"fields\":{\"a\":1}}'"),
}


def _case(values: dict[int, str], key: str = "k") -> str:
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in values.items()) + " end"


_KIND, _RAW = _case({i: f"'{kind}'" for i, (kind, _) in RESULTS.items()}), _case({i: raw for i, (_, raw) in RESULTS.items()})


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")).withColumn("k", F.col("c_custkey"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _customers(spark, sf_dir).select("c_custkey", F.expr(_KIND).alias("kind"), F.expr(_RAW).alias("raw"))
    return made.select("c_custkey", flatten_result(F.col("kind"), F.col("raw")).alias("result"))


def _shown(pairs: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-")))), ";")


def wrapper_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all engines, damaged ones too, in one envelope."""
    r = F.col("result")
    shown = [_shown(r[c]).alias(c) for c in ("fields", "extracted", "mrz")]
    return _results(spark, sf_dir).select("c_custkey", r["document_type"].alias("document_type"), r["status"].alias("status"), r["ocr_confidence"].alias("ocr_confidence"), r["reason"].alias("reason"), *shown, F.array_join(r["unpaired"], ";").alias("unpaired"))


def adapt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all engines as canonical records, pages of free layout repaired before."""
    df = _results(spark, sf_dir).withColumn("fields", F.col("result.fields")).withColumn("unpaired", F.col("result.unpaired"))
    a = F.col("adapted")
    fields = [a[c].alias(c) for c in ("name", "surname", "given_name", "gender", "date_of_birth", "nationality", "passport_number", "visa_number", "license_number", "aadhaar_number", "relation", "mrz_line1")]
    return adapt_record(repair_layout(df), "result", "repaired").select("c_custkey", "document_type", "document_country", "ocr_confidence", "status", *fields)


#: Pages: what was paired, as keys and values by turns, and the texts that were not; k is a customer's number.
PAGES = {
    0: (["'ELAMISLUBA'", "concat('PS', cast(10000000 + k as string))", "'ANANYA'", "'KODAKONDSUS / CITIZENSHIP'", "'07'", "cast(1950 + k % 50 as string)", "'CARD EXPIRY'", "'2029'"],
        ["'ELAMISLUBA'", "'EST'", "'PEREKONNANIMI Eesnimi'", "'SURNAME Forename'", "translate(cast(k as string), '0123456789', 'ABCDEFGHIJ') || 'X'", "'ANANYA'", "'IND'", "'14'", "'07'", "'N / F'", "'06'", "'20'"]),
    1: (["concat('AB', cast(1000000 + k as string))", "'x'", "'Zip'", "cast(k as string)"], ["'NATIONALITY'", "'EU'", "'REMARKS'", "'DEU'", "'FR'", "'SEX'", "' '", "'x1'", "'f'", "'PIKAAJALINE'", "'ELANIK'", "'EU'"]),
    2: (["'First Name'", "' '"], ["'SURNAME'", "'FORENAME'", "c_mktsegment", "'KIM'", "'12/05/2031'", "'date of expiry'", "concat('until ', cast(2020 + k % 9 as string))"]),
    3: (["'KIM'", "'Perekonnanimi'", "'LEE'", "'kehtiv kuni'"], ["'14'", "'25'", "'2031'", "'1990'", "'permit number'", "cast(k as string)"]),
    4: (["'Card valid from'", "'06.07.2031'", "'12'", "'1988'"], ["'30'", "'5'", "'Gender'", "'Address'", "'M'", "concat('Street ', cast(k as string))"]),
    5: (["'colour'", "c_mktsegment", "'given_name'", "'Ann'", "'Forename'", "'Bo'"], []),
}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir)
    pairs = _case({i: f"map({', '.join(p)})" for i, (p, _) in PAGES.items()})
    texts = _case({i: f"array({', '.join(t)})" if t else "cast(array() as array<string>)" for i, (_, t) in PAGES.items()})
    return rows.select("c_custkey", F.expr(pairs).alias("fields"), F.expr(texts).alias("unpaired"))


def repaired_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a page of swapped labels and values; the fields that repair makes of it."""
    f = F.col("repaired")
    names = ("surname", "given_name", "permit_number", "nationality", "issuing_country", "gender", "date_of_birth", "date_of_expiry", "permit_type", "address", "colour", "zip")
    return repair_layout(_pages(spark, sf_dir)).select("c_custkey", *[f[n].alias(n) for n in names], F.size(f).alias("n_fields"))


def next_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the texts of a page, two thirds of them labels; for each label the next text of its order that is none."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("part"))
    return layout.next_value(items.withColumn("text", F.concat(F.lit("P"), F.col("part").cast("string"))), F.col("part") % 3 != 0)


FUNCTIONS = (wrapper_flatten, adapt_records, repaired_pages, next_value)

_ENGINES_SQL = f"""
    with raw as (select c_custkey, {_KIND.replace('k %', 'c_custkey %')} as kind, raw from (select *, {_RAW} as raw from (select *, c_custkey as k from customer))),
    j as (select *, case when json_valid(raw) then case when json_type(raw) = 'OBJECT' then raw::json end end as j from raw),
    t as (select *, case kind when 'passport' then 'PASSPORT' when 'visa' then 'VISA' when 'aadhaar' then 'AADHAAR' when 'driving_license' then 'DRIVING LICENSE' when 'national_id' then 'NATIONAL ID' when 'permit' then 'PERMIT' else 'UNKNOWN' end as title from j)"""


def _pairs_sql(obj: str, keep: str = "true", unwrap: bool = False) -> str:
    value = f"json_extract({obj}, '$.\"' || x || '\"')"
    text = f"case when json_type({value}) = 'ARRAY' then json_extract_string({value}, '$[1]') when json_type({value}) <> 'OBJECT' then {value} ->> '$'" + (f" else json_extract_string({value}, '$.value')" if unwrap else "") + " end"
    return f"coalesce(array_to_string([x || '=' || coalesce({text}, '-') for x in json_keys({obj}) if {keep}], ';'), '')"


SQL = {
    "wrapper_flatten": f"""{_ENGINES_SQL}
        select c_custkey, case when j is null or kind = 'passport' then title else coalesce(j ->> 'document_type', title) end as document_type,
               case when j is null then 'ERROR' when kind = 'passport' then case when j = '{{}}' then 'CLEARER IMAGE REQUIRED' else 'OCR SUCCESS' end else coalesce(j ->> 'status', 'UNKNOWN') end as status,
               case when j is null then 0.0 when kind = 'passport' then case when j = '{{}}' then 0.0 else 100.0 end else coalesce(try_cast(j ->> 'ocr_confidence' as double), 0.0) end as ocr_confidence,
               case when j is null then 'The result is no JSON object.' when kind = 'passport' then case when j = '{{}}' then 'The MRZ could not be read from this image.' else 'Passport MRZ extracted successfully.' end else coalesce(j ->> 'reason', '') end as reason,
               case when j is null then '' when kind in ('national_id', 'permit', 'driving_license') then {_pairs_sql("(j -> 'fields')", unwrap=True)}
                    when kind = 'aadhaar' then {_pairs_sql("j", "x not in ('document_type', 'status', 'ocr_confidence', 'reason')")} when kind = 'passport' then {_pairs_sql("j")} else '' end as fields,
               case when kind = 'visa' and j is not null then {_pairs_sql("(j -> 'fields')")} else '' end as extracted,
               case when kind = 'visa' and j is not null then {_pairs_sql("(j -> 'mrz')")} else '' end as mrz,
               case when kind in ('national_id', 'permit') and j is not null then coalesce(array_to_string(json_extract_string(j, '$.unpaired_text[*].text'), ';'), '') else '' end as unpaired
        from t""",
    "adapt_records": """
        with c as (select *, c_custkey as k, c_custkey % 10 as i from customer)
        select c_custkey, ['national_id', 'permit', 'driving_license', 'aadhaar', 'visa', 'passport', 'passport', 'visa', 'permit', 'unknown'][i + 1] as document_type,
               case i when 0 then 'IN' when 2 then 'IN' when 3 then 'IN' when 4 then 'IN' when 5 then 'DE' end as document_country,
               case i when 0 then k % 100 + 0.5 when 1 then (k % 100)::double when 3 then 71.25 when 4 then 88.0 when 5 then 100.0 else 0.0 end::double as ocr_confidence,
               ['OCR COMPLETED', 'REVIEW REQUIRED', 'UNKNOWN', 'S', 'UNKNOWN', 'OCR SUCCESS', 'CLEARER IMAGE REQUIRED', 'ERROR', 'ERROR', 'S'][i + 1] as status,
               case i when 0 then c_mktsegment when 1 then c_mktsegment || ' ' || c_mktsegment when 4 then 'ANN ' || c_mktsegment when 5 then 'LEE ' || c_mktsegment end as name,
               case when i in (0, 1, 4, 5) then c_mktsegment end as surname, case i when 1 then c_mktsegment when 4 then 'ANN' end as given_name, case i when 4 then 'F' when 5 then 'M' end as gender,
               case i when 0 then '19' || (50 + k % 49) || '-05-12' when 5 then '1990-11-0' || (1 + k % 9) end as date_of_birth, case i when 0 then 'IN' when 4 then 'IN' when 5 then 'DE' end as nationality,
               case when i = 5 then 'P' || k end as passport_number, case when i = 4 then 'V' || k end as visa_number, case when i = 2 then 'MH12' || k end as license_number,
               case when i = 3 then (100000000000 + k)::varchar end as aadhaar_number, case when i = 2 then c_mktsegment end as relation, case when i = 4 then 'P<' || k end as mrz_line1
        from c""",
    "repaired_pages": """
        with c as (select *, c_custkey as k, c_custkey % 6 as i, translate(c_custkey::varchar, '0123456789', 'ABCDEFGHIJ') || 'X' as own from customer)
        select c_custkey, case i when 0 then own when 1 then null when 2 then c_mktsegment when 3 then 'KIM' end as surname,
               case i when 0 then 'ANANYA' when 2 then c_mktsegment when 3 then 'LEE' when 5 then 'Ann' end as given_name,
               case i when 0 then 'PS' || (10000000 + k) when 1 then 'AB' || (1000000 + k) when 3 then k::varchar end as permit_number,
               case i when 0 then 'IND' when 1 then 'DEU' end as nationality, case when i = 1 then 'FR' end as issuing_country,
               case i when 0 then 'N / F' when 1 then 'F' when 4 then 'M' end as gender,
               case i when 0 then (1950 + k % 50) || '-07-14' when 4 then '1988-12-30' end as date_of_birth,
               case i when 0 then '2029-06-20' when 2 then 'until ' || (2020 + k % 9) when 3 then '2031-25-14' when 4 then '06.07.2031' end as date_of_expiry,
               case when i = 1 then 'PIKAAJALINE ELANIK EU' end as permit_type, case when i = 4 then 'M' end as address, case when i = 5 then c_mktsegment end as colour, case when i = 1 then k::varchar end as zip,
               [7, 6, 3, 4, 5, 2][i + 1]::int as n_fields
        from c""",
    "next_value": """
        with t as (select l_orderkey as doc_id, l_linenumber as ord, min(l_partkey) as part from lineitem group by all),
        n as (select l.doc_id, l.ord, min(v.ord) as value_ord from t l left join t v on v.doc_id = l.doc_id and v.ord > l.ord and v.part % 3 = 0 where l.part % 3 <> 0 group by all)
        select n.doc_id, n.ord, 'P' || t.part as value from n left join t on t.doc_id = n.doc_id and t.ord = value_ord""",
}
