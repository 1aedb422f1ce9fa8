"""The pipeline against a brute-force version, on a table with nulls, repeats, empty texts and odd columns, and on an empty one."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from docassay.llm import bpe, mixing, toxicity
from docassay.llm.queries import learnable_labels

DOC = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, score double, kept string, _row int, tie long, key string"
LABEL = "doc_id long, quality int, toxic int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def poor(text):
    w = words(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    chars, lines = sum(map(len, w)), [x for x in (text or "").split("\n") if words(x)]
    if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
        return True
    symbols, shouts, capitals = sum(text.count(c) for c in "#*$%&|<>"), text.count("!"), sum(unicodedata.category(c) == "Lu" for c in text)
    return symbols > 0.06 * chars or not 2 * len(w) <= chars <= 20 * len(w) or len(lines) - len(set(lines)) > 0.5 * len(lines) or shouts > 0.3 * len(w) or capitals > 0.5 * chars


def shingles(text):
    w = words(text)
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def first_of_classes(rows):
    """Rows (doc_id, source, text) with one of each class of near copies; rows without doc_id all stay."""
    named = {r[0]: r for r in rows if r[0] is not None}
    ids, grams = sorted(named), {i: shingles(r[2]) for i, r in named.items()}
    label = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and sum((grams[i] & grams[j]).values()) >= 0.8 * sum((grams[i] | grams[j]).values()):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return [named[i] for i in ids if label[i] == i] + [r for r in rows if r[0] is None]


def mixed(spark, rows, weights, quality):
    size = {k: len(words(r[2])) for k, r in enumerate(rows)}
    sums = Counter()
    for k, r in enumerate(rows):
        sums[r[1]] += size[k]
    out = Counter()
    for source, n, target in mixing.source_targets(list(sums.items()), weights):
        epochs, at = int(target // n) if n else 0, 0

        def key(k):
            doc_id, _, text = rows[k]
            name = str(doc_id) if doc_id is not None else spark.createDataFrame([(text,)], "t string").select(F.hex(F.xxhash64("t"))).first()[0]
            return -math.log((int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / quality.get(doc_id, 1.0)

        for k in sorted((k for k, r in enumerate(rows) if r[1] == source), key=key):
            out[k] = epochs + (at + size[k] / 2 <= target - epochs * n)
            at += size[k]
    return out


def corpus():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices(["ta", "ri", "no", "le", "su", "ka", "mé"], k=rng.randrange(1, 4))) + str(i % 7) for i in range(1500)]
    rows, labels = [], []

    def add(doc_id, text, source):
        rows.append((doc_id, text, None, source, None, "x", 1.0, "k", 3, 4, "y"))

    for i in range(260):
        w = rng.choices(vocabulary, k=rng.randrange(60, 130))
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grobnik", "vexalot", "morblin"]))
        text = " ".join(w)
        add(i, text, rng.choice(["web", "book", "Ünl", None]))
        labels.append((i, int(i % 3 == 0), int(toxic)))
        if i % 20 == 1:  # copies: one exact, one with a word changed, in sources of their own
            add(1000 + i, text + " ", "copy")
            add(2000 + i, text.replace(w[7], "other", 1), "copy")
    for i, text in enumerate([None, "", " \n\t", "short", "a b c " * 40, "!! " * 60 + " ".join(vocabulary[:60]), "# $ % " * 30 + " ".join(vocabulary[:60]), "\n".join(["same line again"] * 30 + vocabulary[:9]), " ".join(vocabulary[:80]).upper()]):
        add(3000 + i, text, "web")
    rows += [rows[5], rows[5], rows[9]]  # repeated rows
    add(None, " ".join(rng.choices(vocabulary, k=90)), "book")
    add(None, None, None)
    labels += [(5, None, None), (None, 1, 1), (7, 0, None), (7, 1, 0), (99_999, 1, 1)]
    return rows, labels


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    sf_dir = str(tmp_path)
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, LABEL).write.parquet(f"{sf_dir}/labels.parquet")
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())

    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), learnable_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    score = lambda t: model.score_words(np.sort(model.word_logits(sorted(set((t or "").split())))))
    kept = [(r[0], r[3], r[1]) for r in rows if score(r[1]) < 0.5]
    lost = {r[0] for r in rows} - {r[0] for r in kept}
    assert sum(i in lost for i in range(0, 260, 4)) > 55 and sum(i in lost for i in range(260) if i % 4) < 8
    kept = [r for r in kept if not poor(r[2])]
    assert not {3000 + i for i in range(8)} & {r[0] for r in kept}
    kept = first_of_classes(kept)
    assert not {r[0] for r in kept if r[0] and 1000 <= r[0] < 3000 and r[0] % 1000 in {x[0] for x in kept}}
    good = {}
    for i, q, t in labels:
        if i is not None:
            good[i] = min(good.get(i, 1), int(q == 1 and (t or 0) == 0))
    taken = mixed(spark, kept, (5.0, 2.0, 1.0), {i: 2.0 if g else 0.5 for i, g in good.items()})

    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expected = Counter()
    for k, (doc_id, _, text) in enumerate(kept):
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        expected[doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += taken[k]
    assert got == +expected and None in {r[0] for r in got}


def test_stages_keep_odd_columns_and_empty_tables(spark, tmp_path):
    rows, labels = corpus()
    sf_dir = str(tmp_path)
    empty = spark.createDataFrame([], DOC)
    empty.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, LABEL).write.parquet(f"{sf_dir}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf_dir)
        assert out.columns == empty.columns and out.dtypes == empty.dtypes and out.count() == 0, name
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
    few = spark.createDataFrame(rows[:12] + rows[-5:], DOC)
    for name, stage in corpus_pipeline.STAGES[:-1]:  # without a model nothing is toxic, each stage by itself
        out = stage(spark, few, sf_dir)
        assert out.columns == few.columns, name
        assert {(r["doc_id"], r["text"], r["a.b"]) for r in out.collect()} <= {(r["doc_id"], r["text"], r["a.b"]) for r in few.collect()}, name
