"""Runs, line deduplication and fill-in-the-middle against brute force, and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docassay.llm import fim, lines, queries, runs

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i * 7 % 501}" for i in range(30_000))
ODD = [None, "", " ", "\n", "one", "a b c d", "x  y\n\n z\t", "ünï çödé 日本語 🙂 test", "l1 l2\nl1 l2\nl1 l2", "a b c a b c", LONG]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, None, f"s{i % 3}", None) for i, t in enumerate(texts)], DOC)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- runs


def brute_runs(w, least=6, exponent=4):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, end = i, j + q
            smaller = any(all(w[k] == w[k + p] for k in range(start, end - p)) for p in range(1, q))
            if end - start >= max(least, exponent * q) and not smaller:
                out.append((start, end - start, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randrange(260))]
        for _ in range(rng.randrange(4)):
            if len(w) > 10:
                start = rng.randrange(len(w) - 5)
                p = rng.randrange(1, max(2, (len(w) - start) // 4 + 1))
                for i in range(start + p, rng.randrange(start, len(w) + 1)):
                    w[i] = w[i - p]
        assert runs.find_runs(w) == brute_runs(w), w


def test_runs_of_long_texts():
    rng = random.Random(2)
    noise = lambda n: [rng.randrange(10**9) for _ in range(n)]
    unit = noise(3001)
    w = noise(777) + unit * 4 + unit[:50] + noise(40_000) + [1, 2, 1] * 5000 + noise(9)
    assert runs.find_runs(w) == [(777, 4 * 3001 + 50, 3001), (777 + 4 * 3001 + 50 + 40_000, 15_000, 3)]
    assert runs.find_runs([5] * 200_000) == [(0, 200_000, 1)]
    assert runs.find_runs([0, 0, 0, 0, 0, 0, 1] * 3)[:2] == [(0, 6, 1), (7, 6, 1)]


def test_run_queries(spark):
    rng = random.Random(3)
    texts = [*ODD, *(" ".join(rng.choices("ab", k=rng.randrange(120))) for _ in range(200)), "x y " * 9 + "x y z", "x y " * 9 + "x y z"]
    df = docs(spark, texts).withColumn("runs", F.lit(1)).unionByName(docs(spark, ["q " * 9]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("runs", F.lit(1)))
    got = {r["doc_id"]: r for r in runs.detect_runs(df, change=runs.plant).collect()}
    assert len(got) == len(texts) + 1
    for i, text in [*enumerate(texts), (None, "q " * 9)]:
        w = (text or "").encode().split()
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w) if len(w) < 1000 else runs.find_runs(w)
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in found)]
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        row = got[i]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(found), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert row["runs_sha256"] == sha("".join("%d,%d,%d\n" % r for r in found)) and row["collapsed_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()
    assert runs.detect_runs(df.limit(0)).count() == 0
    short = runs.collapse_runs(df)
    assert short.columns == df.columns
    after = {r["doc_id"]: r["text"] for r in short.collect()}
    assert after[None] == "q" and after[0] is None and after[len(texts) - 1] == "x y z" and after[6] == ODD[6]


# -- lines


def brute_lines(rows, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = Counter(k for text in rows for k in {key(x) for x in (text or "").split("\n")} if k)
    out = []
    for text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if held[key(x)] < min_docs]
        out.append((len(every), len(every) - len(kept), "\n".join(kept)))
    return out


def made_lines(rng, n):
    pool = [f"Line {i} ÉA" for i in range(40)] + ["", " \t", " ", "ſ", "K", "\x1c"]
    dress = [lambda x: x, str.upper, lambda x: f" \t{x}\r", lambda x: f"{x}\x0b"]
    return ["\n".join(rng.choice(dress)(rng.choice(pool)) for _ in range(rng.randrange(8))) for _ in range(n)]


def test_lines_against_brute_force_and_back(spark, tmp_path):
    rng = random.Random(4)
    first, second, extra = [*ODD, *made_lines(rng, 60), "hot\nown 1", "hot\nown 1"], made_lines(rng, 50), ["hot\nx", "Hot ", "own 1\nhot"]
    index = lines.LineIndex(spark, str(tmp_path / "i"), min_docs=4, shards=3)
    a, b, c = docs(spark, first), docs(spark, second, 1000), docs(spark, extra, 2000)

    def holds(df, texts, others):
        rows = df.withColumn("_text", F.lit("clash")).withColumn("kept", F.lit("clash")).withColumn("a.b", F.lit(7)).withColumn("t", F.lit(1))
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in index.deduplicate(rows).collect()}
        assert [got[k] for k in sorted(got)] == brute_lines([*texts, *others], 4)[: len(texts)]

    index.insert(a)
    holds(a, first, [])
    index.insert(b)
    holds(a, first, second)
    holds(b, second, first)
    index.insert(c)
    holds(c, extra, [*first, *second])
    index.delete(spark.createDataFrame([(1000 + i,) for i in range(50)] + [(999_999,), (1001,)], "doc_id long"))
    holds(a, first, extra)
    index.delete(b.select("doc_id"))  # a second time: nothing is left of them
    index.delete(c.select("doc_id"))
    holds(a, first, [])
    assert index.versions() == [1, 2, 3, 4, 5, 6]
    # An update that dies before its number is written is not seen, and its place is taken by the next.
    docs(spark, ["hot"] * 9).select(lines.text_id(F.col("text")).alias("key"), F.lit(9).cast("long").alias("n")).write.parquet(str(tmp_path / "i" / "counts" / "7"))
    holds(a, first, [])
    index.insert(c)
    holds(a, first, extra)


def test_lines_repeated_null_and_empty(spark, tmp_path):
    rows = spark.createDataFrame([(5, "same\nown")] * 3 + [(None, "same"), (None, None)], "doc_id long, text string")
    index = lines.LineIndex(spark, str(tmp_path / "i"), min_docs=4, shards=2)
    index.insert(rows)
    got = Counter(tuple(r) for r in index.deduplicate(rows).select("doc_id", "n_lines", "n_dropped", "kept").collect())
    assert got == Counter({(5, 2, 1, "own"): 3, (None, 1, 1, ""): 1, (None, 1, 0, ""): 1})
    index.delete(spark.createDataFrame([(None,)], "doc_id long"))
    assert {r["n_dropped"] for r in index.deduplicate(rows).collect()} == {0}
    index.insert(rows.limit(0))
    assert index.deduplicate(rows.limit(0)).count() == 0
    empty = lines.LineIndex(spark, str(tmp_path / "e"))
    empty.insert(rows.limit(0))
    assert empty.deduplicate(rows).where("n_dropped > 0").count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    held = lines.Cuckoo(1024)
    held.insert(keys)  # three quarters full
    held = lines.Cuckoo(1024, held.bytes())
    assert held.contains(keys).all()
    others = rng.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    assert held.contains(others).mean() < 0.001
    held.remove(keys[:1500])
    assert held.contains(keys[1500:]).all() and held.contains(keys[:1500]).mean() < 0.01
    full = lines.Cuckoo(16)
    full.insert(keys[:200])  # more than it has slots for: the rest stands in the stash
    assert full.stash and lines.Cuckoo(16, full.bytes()).contains(keys[:200]).all()
    full.remove(keys[:200])
    assert not full.stash and not full.slots.any()


# -- fill-in-the-middle


def test_elias_fano():
    rng = random.Random(5)
    for _ in range(150):
        values = np.sort(np.array([rng.randrange(rng.choice([1, 3, 50, 100_000])) for _ in range(rng.choice([1, 2, 5, 300, 2000]))]))
        index = fim.EliasFano.unpack(fim.EliasFano.of(values).pack())
        assert [index[i] for i in range(len(values))] == values.tolist()
    plain = fim.boundaries(b"a" * 100_000)
    assert len(plain.pack()) < 0.3 * 100_000


def test_fill_in_middle(spark):
    texts = [*ODD, "has <P> inside", "<S><M>", "<<P", "a<", "🙂", *["copy of many\n日本"] * 30, *(f"text {i} " * (i % 5) for i in range(300))]
    df = docs(spark, texts).withColumn("form", F.lit("clash")).withColumn("key", F.lit(1)).unionByName(docs(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("form", F.lit("")).withColumn("key", F.lit(2)))
    forms = Counter()
    got = {r["doc_id"]: r for r in fim.transform(df).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()}
    assert len(got) == len(texts) + 1
    for i, text in [*enumerate(texts), (None, "no id")]:
        text, row = text or "", got[i]
        x, n = sha(f"1:{'' if i is None else i}"), len(text)
        h1, h2, h3, h4 = (int(x[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
        assert (row["n"], row["form"], row["output"], row["restored"]) == (n, form, text if form == "plain" else p + s + m if form == "psm" else s + p + m, text)
        assert (row["prefix_chars"], row["middle_chars"]) == ((None, None) if form == "plain" else (a, b - a))
        forms[form] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 5
    assert fim.transform(df.limit(0)).count() == 0


def test_fill_in_middle_of_hot_texts(spark):
    """A text of more documents than a block holds is cut in several blocks."""
    df = spark.range(1800).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the one text of most documents").otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    rows = fim.transform(df.unionByName(df.where("doc_id = 4"))).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(rows) == 1801 and len({r["output"] for r in rows if r["doc_id"] == 4}) == 1
    assert Counter(r["restored"] for r in rows)["the one text of most documents"] == 1201


def test_queries_are_registered():
    assert {"op11_periodic_runs", "op12_line_dedup", "op13_fill_in_middle"} <= set(queries.QUERIES)
    assert {"op12_line_dedup", "op13_fill_in_middle"} <= set(queries.ORACLES)
