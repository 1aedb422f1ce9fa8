"""Work per row stays small: what was slow at size, and the same results by a plainer way."""

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from docassay.functions import adapt, similarity
from docassay.operators import layout
from docassay.queries import adapter


def test_known_label_compares_only_labels_that_can_win(monkeypatch):
    plain = lambda s: re.sub("[^A-Z0-9]", "", s.upper())

    def brute(text):
        ratios = [SequenceMatcher(None, plain(text), plain(label)).ratio() for label in layout.KNOWN_LABELS]
        return layout.KNOWN_LABELS[ratios.index(max(ratios))] if plain(text) and max(ratios) >= 0.65 else None

    draw = random.Random(3)
    texts = ["", "::", "ß", "A" * 300, "NAME" * 80]
    for _ in range(400):
        letters = list(draw.choice(layout.KNOWN_LABELS))
        for _ in range(draw.randint(0, 6)):
            letters.insert(draw.randrange(len(letters) + 1), draw.choice("AEINORST0 :é"))
            if draw.random() < 0.5:
                letters.pop(draw.randrange(len(letters)))
        texts.append("".join(letters))
    assert [layout.known_label(t) for t in texts] == [brute(t) for t in texts]

    calls, ratio = [], SequenceMatcher.ratio
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda self: calls.append(1) or ratio(self))
    assert layout.known_label("Customer#000004711") is None and layout.known_label("REF 1004711") is None
    assert len(calls) <= 4  # 60 when every label is compared


def _zones(spark):
    sides = ["P12-3", "p123", "", None, "ABC<DEF", "ABC DEG", "XYZ"]
    rows = [(i, {f: sides[(i + j) % 7] for j, f in enumerate(similarity.TWICE)}, {f: sides[(i // 7 + 2 * j) % 7] for j, f in enumerate(similarity.TWICE)}) for i in range(49)]
    return spark.createDataFrame(rows, "id int, a map<string,string>, b map<string,string>")


def test_zones_are_compared_by_a_plan_of_bounded_size(spark):
    df = _zones(spark)
    out = df.select("id", similarity.compare_zones(df.a, df.b).alias("c"), similarity.tally(similarity.compare_zones(df.a, df.b)).alias("t"), "a", "b")
    got = out.collect()

    def one(field, x, y):
        clean = (lambda s: " ".join(re.sub("[^A-Z ]", "", s.upper().replace("<", " ")).split())) if field in ("surname", "given_name") else (lambda s: re.sub("[^A-Z0-9]", "", s.upper()))
        x, y = clean(x or ""), clean(y or "")
        if not x or not y:
            return "NOT_AVAILABLE", 0.0
        r = SequenceMatcher(None, x, y).ratio()
        return "MATCH" if x == y else "CLOSE_MATCH" if r >= 0.85 else "MISMATCH", round(r, 3)

    for row in got:
        want = {f: one(f, row.a[f], row.b[f]) for f in similarity.TWICE}
        assert {f: (row.c[f].status, row.c[f].similarity) for f in want} == want
        seen = [w for w in want.values() if w[0] != "NOT_AVAILABLE"]
        assert (row.t.available, row.t.matches, row.t.close_matches, row.t.mismatches) == (len(seen), *[sum(w[0] == s for w in seen) for s in ("MATCH", "CLOSE_MATCH", "MISMATCH")])
        assert abs(row.t.confidence - (round(sum(w[1] for w in seen) / len(seen) * 100, 2) if seen else 0.0)) < 0.011
    one_pair = len(df.select(similarity.compare_zones(df.a, df.b))._jdf.queryExecution().analyzed().toString())
    whole = len(df.select(similarity.tally(similarity.compare_zones(df.a, df.b)))._jdf.queryExecution().analyzed().toString())
    assert whole < 2 * one_pair


def test_pages_are_dealt_over_all_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sf = "/root/testdata/sf0.001"
    assert spark.read.parquet(f"{sf}/customer.parquet").rdd.getNumPartitions() == 1
    assert adapter._pages(spark, sf).rdd.getNumPartitions() == n
    assert adapter._results(spark, sf).rdd.getNumPartitions() == n


def test_label_keyword_is_the_first_of_the_table(spark):
    draw = random.Random(4)
    keys = list(adapt.LABEL_KEYWORDS)
    texts = [None, "", "  ", "KIM", "a\nb"] + [(draw.choice(["", "x ", "\n"]) + draw.choice(keys) + draw.choice(["", " " + draw.choice(keys), "#", ". "])).upper() for _ in range(300)]
    texts += [k[:-1] for k in keys] + keys
    want = [next(((k, f) for k, f in adapt.LABEL_KEYWORDS.items() if k in t.lower()), (None, None)) if t else (None, None) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = df.select("i", *[c.alias(n) for c, n in zip(adapt.label_keyword(df.t), ("k", "f"))]).orderBy("i").collect()
    assert [(r.k, r.f) for r in got] == want
    odd = {"a.c": "dot", "(": "open", "x": "x", "": "none"}
    assert [r.k for r in spark.range(1).select(F.explode(F.array(F.lit("abc"), F.lit("a.c"), F.lit("z(")))).select(adapt.label_keyword(F.col("col"), odd)[0].alias("k")).collect()] == ["", "a.c", "("]


def test_each_source_of_a_record_is_renamed_once(spark):
    rows = [({"Full_Name": "A", "dob": " "}, {"surname": "B", "raw_line1": "P<"}, {"LAST_NAME": "C", "sex": "F", "x": "y"}, {"nom": "D", "name": "E", "gender": "M", "dob": "1.2.90"}), ({}, {}, {}, {}), ({"name": "SEX"}, {}, {}, {"name": "Z"})]
    df = spark.createDataFrame(rows, "e map<string,string>, m map<string,string>, r map<string,string>, f map<string,string>")
    out = df.select(adapt.adapt(df.f, df.e, df.m, df.r).alias("a"))
    assert [r.a for r in out.collect()] == [{"name": "A", "mrz_line1": "P<", "surname": "B", "gender": "F", "date_of_birth": "1.2.90"}, {}, {"name": "Z"}]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json") == 4
