"""Toxicity by subword bags: character n-gram embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with marks at its ends), hashed into BUCKETS vectors, and the mean of
the vectors stands for it. A document is the mean of its distinct words' vectors, each weighted by the exponential
of ``sharpness`` times its own logit, so every word counts and few toxic words aren't lost in a long text. That
mean, with the logarithm of the number of words beside it, goes into a linear softmax over clean and toxic, which
is the score. All is trained in numpy: first vectors and softmax on single words as the smallest documents, a word
counting as toxic as often as it stands in toxic texts and as clean as often as in clean ones; then vectors,
softmax, sharpness and length together on documents that the first part never saw, weighted to the labels' own
shares. A misspelling or an ending that no training text holds still shares most of its n-grams with the word it
stands for.

Since the softmax is linear, a trained model is one number per bucket and four more: the mean of the numbers of
a word's n-grams is its logit. That array of fixed size is what executors get.

Sample. Of the rows that may be learnt from, at most ``max_docs`` per label, lowest hash of doc_id first;
of a doc_id's different texts the one with
the lowest digest; equal texts count once. Two thirds train the words that ``min_texts`` of their texts hold, or more texts, if those
words are more than ``max_words``; one third trains documents, in order of a hash as long as their distinct words
sum to ``max_pooled`` at most.

Cases. A null or empty text, or one without letters or digits, has no words and score 0. Labels repeated for a
document count as their maximum; null labels and null doc_ids are not learnt from. With labels of one kind
only, or none, in the sample, every score is 0; where only the third for documents lacks one kind, documents
that trained words take its place. Repeated rows get equal scores. An empty table gives no rows. score() replaces
a column score; other columns are kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.llm.common import give_back, materialise, short_batches

BUCKETS = 1 << 17
SIZES = (3, 4, 5)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Words whose n-grams are made at once.
BLOCK = 8192


def ngrams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams and the word of each, in order of words; none for a word without letters or digits."""
    parts = [_ngrams(vocabulary[i : i + BLOCK]) for i in range(0, len(vocabulary), BLOCK)]
    flat = np.concatenate([f for f, _ in parts]) if parts else np.empty(0, np.int32)
    own = np.concatenate([o + np.int32(i * BLOCK) for i, (_, o) in enumerate(parts)]) if parts else np.empty(0, np.int32)
    return flat, own


def _ngrams(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    bare = [_EDGE.sub("", w.lower()) for w in vocabulary]
    marked = [f"<{w}>" if w else "" for w in bare]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked), dtype=np.int32), [len(w) for w in marked])
    buckets, owners = [], []
    for n in SIZES:
        if len(codes) < n:
            continue
        inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner[: len(owner) - n + 1][inside])
    if not buckets:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    flat, own = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return flat[order], own[order]


@dataclass(frozen=True)
class Model:
    """Collapsed vectors, a logit share per bucket and the bias of words; what turns pooled words into a document's logit."""

    weights: np.ndarray
    bias: float
    sharpness: float = 1.0
    scale: float = 1.0
    length: float = 0.0
    offset: float = 0.0

    def word_logits(self, vocabulary: list[str]) -> np.ndarray:
        """A logit per word; nan for a word without letters or digits."""
        out = np.empty(len(vocabulary))
        for i in range(0, len(vocabulary), BLOCK):  # blocks bound the memory of a batch full of new words
            part = vocabulary[i : i + BLOCK]
            flat, own = _ngrams(part)
            n = np.bincount(own, minlength=len(part))
            mean = np.bincount(own, self.weights[flat], len(part)) / np.maximum(n, 1)
            out[i : i + BLOCK] = np.where(n > 0, mean + self.bias, np.nan)
        return out

    def score_words(self, logits: np.ndarray) -> float:
        """The probability of toxic for the logits of a document's distinct words; 0 without any."""
        z = logits[~np.isnan(logits)]
        if not len(z):
            return 0.0
        weight = np.exp(self.sharpness * (z - z.max()))
        pooled = float(weight @ z / weight.sum())
        x = self.offset + self.scale * pooled + self.length * math.log(len(z))
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, x))))


def train_words(vocabulary: list[str], toxic: np.ndarray, clean: np.ndarray, *, dims: int = 6, epochs: int = 6, min_steps: int = 40, batch: int = 4096, rate: float = 0.05, decay: float = 1e-6, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, softmax and bias by Adam on word counts; the classes weigh the same in sum."""
    every, own = ngrams(vocabulary)
    sizes = np.bincount(own, minlength=len(vocabulary))
    some = sizes > 0
    sizes = sizes[some]
    firsts = np.cumsum(sizes) - sizes
    n = (toxic + clean)[some]
    share = toxic[some] / n
    weight = np.log1p(n)
    pos, neg = weight * share, weight * (1 - share)
    pos, neg = pos / max(pos.sum(), 1e-9), neg / max(neg.sum(), 1e-9)
    scale = len(sizes) / 2
    pos, neg = pos * scale, neg * scale
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, dims), np.float32) - 0.5) / dims
    soft, bias = rng.normal(0, 0.5, (dims, 2)).astype(np.float32), np.zeros(2, np.float32)
    m1, m2 = np.zeros_like(vectors), np.zeros_like(vectors)
    s1, s2, b1, b2 = np.zeros_like(soft), np.zeros_like(soft), np.zeros_like(bias), np.zeros_like(bias)
    step = 0
    for _ in range(max(epochs, -(-min_steps * batch // max(1, len(sizes))))):
        order = rng.permutation(len(sizes))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            lengths = sizes[pick]
            owner = np.repeat(np.arange(len(pick)), lengths)
            starts = np.cumsum(lengths) - lengths
            flat = every[np.arange(lengths.sum()) - np.repeat(starts, lengths) + np.repeat(firsts[pick], lengths)]
            mean = np.add.reduceat(vectors[flat], starts, axis=0) / lengths[:, None]
            logits = mean @ soft + bias
            p = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -30, 30)))
            g = (neg[pick] * p - pos[pick] * (1 - p)).astype(np.float32) / len(pick)
            grad_logits = np.stack([-g, g], 1)
            grad_soft = mean.T @ grad_logits + decay * soft
            grad_bias = grad_logits.sum(0)
            grad_mean = (grad_logits @ soft.T) / lengths[:, None]
            used, where = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(where, grad_mean[owner, d], len(used)) for d in range(dims)], 1).astype(np.float32) + decay * vectors[used]
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            m1[used] = 0.9 * m1[used] + 0.1 * grad
            m2[used] = 0.999 * m2[used] + 0.001 * grad * grad
            vectors[used] -= rate * fix * m1[used] / (np.sqrt(m2[used]) + 1e-8)
            for x, a, b, gx in ((soft, s1, s2, grad_soft), (bias, b1, b2, grad_bias)):
                a *= 0.9
                a += 0.1 * gx
                b *= 0.999
                b += 0.001 * gx * gx
                x -= rate * fix * a / (np.sqrt(b) + 1e-8)
    return vectors, soft, bias


def fit_curve(evidence: np.ndarray, labels: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    """Weighted logistic regression by Newton's method; the last number is the offset."""
    x = np.hstack([evidence, np.ones((len(evidence), 1))])
    weight = weight / weight.mean()
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1.0] * evidence.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + penalty @ w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def pooled_loss(vectors: np.ndarray, soft: np.ndarray, numbers: np.ndarray, bag: tuple[np.ndarray, np.ndarray], pool: tuple[np.ndarray, np.ndarray], labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted cross entropy of documents and its gradients.

    ``soft`` is the toxic column of the softmax less the clean one. ``numbers``: bias of words, sharpness, scale,
    length, offset. ``bag``: buckets of n-grams and the word of each, in order of words. ``pool``: words and the
    document of each, in order of documents; every word has an n-gram and every document a word.
    """
    bias, sharp, scale, length, offset = numbers
    (flat, own), (word, doc) = bag, pool
    sizes, n = np.bincount(own), np.bincount(doc, minlength=len(labels))
    starts, firsts = np.cumsum(sizes) - sizes, np.cumsum(n) - n
    mean = np.add.reduceat(vectors[flat], starts, axis=0) / sizes[:, None]
    z = (mean @ soft + bias)[word]
    top = np.maximum.reduceat(sharp * z, firsts)
    a = np.exp(sharp * z - top[doc])
    total = np.add.reduceat(a, firsts)
    a /= total[doc]
    p = np.add.reduceat(a * z, firsts)
    x = offset + scale * p + length * np.log(n)
    loss = float((weight * (np.logaddexp(0, x) - labels * x)).sum())
    g = weight * (1 / (1 + np.exp(-np.clip(x, -60, 60))) - labels)
    gz = np.bincount(word, (g * scale)[doc] * a * (1 + sharp * (z - p[doc])), len(sizes))
    steeper = np.add.reduceat(a * z * z, firsts) - p * p
    used, where = np.unique(flat, return_inverse=True)
    share = (gz / sizes)[own]
    grad_vectors = np.stack([np.bincount(where, share * s, len(used)) for s in soft], 1)
    grad_numbers = np.array([gz.sum(), (g * scale * steeper).sum(), (g * p).sum(), (g * np.log(n)).sum(), g.sum()])
    return loss, {"used": used, "vectors": grad_vectors, "soft": gz @ mean, "numbers": grad_numbers}


def train_documents(vectors: np.ndarray, soft: np.ndarray, bias: np.ndarray, vocabulary: list[str], docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, *, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 11) -> Model:
    """Vectors, softmax and pooling together by Adam on whole documents (places in ``vocabulary``), from the words' vectors on."""
    vectors, soft = vectors.astype(np.float64), (soft[:, 1] - soft[:, 0]).astype(np.float64)
    flat, own = ngrams(vocabulary)
    sizes = np.bincount(own, minlength=len(vocabulary))
    starts = np.cumsum(sizes) - sizes
    held = [d[sizes[d] > 0] for d in docs]
    some = np.flatnonzero([len(h) for h in held])
    start = Model((vectors @ soft).astype(np.float32), float(bias[1] - bias[0]))
    if not len(some):
        return start
    z = start.word_logits(vocabulary)
    fits = []
    for sharp in (0.5, 1.0, 2.0, 4.0, 8.0):  # where the common training starts from
        pooled = np.array([[(e := np.exp(sharp * (z[h] - z[h].max()))) @ z[h] / e.sum(), math.log(len(h))] for h in (held[i] for i in some)])
        scale, length, offset = fit_curve(pooled, labels[some], weight[some])
        x = pooled @ (scale, length) + offset
        fits.append((float(weight[some] @ (np.logaddexp(0, x) - labels[some] * x)), sharp, scale, length, offset))
    numbers = np.array([start.bias, *min(fits)[1:]])
    state = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in (("vectors", vectors), ("soft", soft), ("numbers", numbers))}
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(some)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            words_ = np.concatenate([held[i] for i in pick])
            known, word = np.unique(words_, return_inverse=True)
            doc = np.repeat(np.arange(len(pick)), [len(held[i]) for i in pick])
            length_ = sizes[known]
            inner = np.arange(length_.sum()) - np.repeat(np.cumsum(length_) - length_, length_)
            bag = flat[np.repeat(starts[known], length_) + inner], np.repeat(np.arange(len(known)), length_)
            w = weight[pick] / weight[some].mean() / len(pick)
            _, grads = pooled_loss(vectors, soft, numbers, bag, (word, doc), labels[pick], w)
            step += 1
            fix = math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for key, value, rows, speed in (("vectors", vectors, grads["used"], rate), ("soft", soft, slice(None), rate), ("numbers", numbers, slice(None), rate)):
                m, v = state[key]
                m[rows] = 0.9 * m[rows] + 0.1 * grads[key]
                v[rows] = 0.999 * v[rows] + 0.001 * grads[key] ** 2
                value[rows] -= speed * fix * m[rows] / (np.sqrt(v[rows]) + 1e-8)
            numbers[1] = max(numbers[1], 0.05)
    return Model((vectors @ soft).astype(np.float32), *map(float, numbers))


def distinct_words(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(t.split())) if t else [])

    return split(text)


def _least_count(counts: DataFrame, n: Column, max_words: int) -> int:
    """The least n from which on there are at most ``max_words`` words; its values are no more than the sampled texts."""
    left, least = max_words, 1 << 30
    for row in counts.groupBy(n.alias("n")).count().orderBy(F.col("n").desc()).collect():
        left -= row["count"]
        if left < 0:
            break
        least = row["n"]
    return least


def train(documents: DataFrame, labels: DataFrame, *, max_docs: int = 4000, min_texts: int = 2, max_words: int = 400_000, max_pooled: int = 2_000_000) -> Model | None:
    """A model from labelled documents, or None where labels of one kind are missing.

    ``labels`` has doc_id and toxic and holds only rows that may be learnt from.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    chosen = known.where("toxic = 1").orderBy("h").limit(max_docs).unionByName(known.where("toxic = 0").orderBy("h").limit(max_docs))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 x max_docs rows
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.sha2("text", 256).alias("digest"), "text"))["text"].alias("text"), F.first("toxic").alias("toxic"), F.first("h").alias("h"))
    texts = texts.groupBy(F.xxhash64("text").alias("key")).agg(F.max("toxic").alias("toxic"), F.min("h").alias("h"), F.first("text").alias("text"))
    texts = materialise(texts.repartition(8, "key").select("toxic", F.pmod(F.xxhash64("h"), F.lit(3)).alias("fold"), F.xxhash64("key").alias("at"), distinct_words(F.col("text")).alias("words")), "sample")
    counts = texts.where("fold > 0").select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    counts = materialise(counts.where(F.col("toxic") + F.col("clean") >= min_texts), "words")
    counts = counts.where(F.col("toxic") + F.col("clean") >= _least_count(counts, F.col("toxic") + F.col("clean"), max_words))
    sizes = texts.select("at", "toxic", "fold", F.size("words").alias("n")).where("n > 0").toPandas().sort_values("at")  # a row per sampled text
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if sizes["toxic"].nunique() < 2:
        return None
    third = sizes[sizes["fold"] == 0]
    sizes = third if third["toxic"].nunique() > 1 else sizes
    sizes = sizes[sizes["n"].cumsum() <= max(max_pooled, sizes["n"].iloc[0])]
    last = int(sizes["at"].iloc[-1])
    pooled = texts.where((F.col("at") <= last) & F.col("fold").isin(sizes["fold"].unique().tolist()) & (F.size("words") > 0))
    # One task trains, so the driver holds the finished weights only; what the task reads is bounded by the parameters.
    seen = counts.select(F.lit(None).cast("long").alias("at"), F.col("toxic").cast("long").alias("toxic"), F.col("clean").cast("long").alias("clean"), F.array("word").alias("words"))
    seen = seen.unionByName(pooled.select("at", F.col("toxic").cast("long").alias("toxic"), F.lit(0).cast("long").alias("clean"), "words"))
    found = seen.coalesce(1).mapInArrow(lambda batches: _fit(batches, shares), "weights binary, numbers array<double>").collect()
    return Model(np.frombuffer(found[0]["weights"], np.float32), *found[0]["numbers"]) if found else None


def _fit(batches: Iterable[pa.RecordBatch], shares: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """A row with the weights and numbers of a Model, from rows of words (``at`` null) and of documents; none where words lack a kind."""
    held = pa.Table.from_batches(list(batches), pa.schema([("at", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64()), ("words", pa.list_(pa.string()))]))
    single = held["at"].is_null()
    counts, rows = held.filter(single), held.filter(pc.invert(single)).sort_by("at").combine_chunks()
    counts = pa.table({"word": pc.list_flatten(counts["words"]), "toxic": counts["toxic"], "clean": counts["clean"]}).sort_by("word")
    del held, single
    toxic, clean = counts["toxic"].to_numpy().astype(float), counts["clean"].to_numpy().astype(float)
    if not toxic.sum() or not clean.sum():
        return
    vectors, soft, bias = train_words(counts["word"].to_pylist(), toxic, clean)
    del counts
    labels, bags = rows["toxic"].to_numpy().astype(float), rows["words"].combine_chunks()
    every, ends = bags.flatten().dictionary_encode(), (bags.offsets.to_numpy() - bags.offsets[0].as_py())[1:-1]
    weight = np.where(labels == 1, shares[1] / max(1.0, labels.sum()), shares[0] / max(1.0, (1 - labels).sum()))
    docs = np.split(every.indices.to_numpy().astype(np.int64), ends)
    vocabulary = every.dictionary.to_pylist()
    del rows, bags, every
    model = train_documents(vectors, soft, bias, vocabulary, docs, labels, weight)
    del vocabulary, docs
    give_back()
    numbers = [model.bias, model.sharpness, model.scale, model.length, model.offset]
    yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights.tobytes()], pa.binary()), "numbers": pa.array([numbers], pa.list_(pa.float64()))})


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """The documents with score, the probability of toxic."""
    short_batches(documents.sparkSession)
    if model is None:
        return documents.withColumn("score", F.lit(0.0))

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            out = []
            for at in range(0, len(texts), 128):  # word sets of few texts at a time
                split = [set(t.split()) if t else set() for t in texts.iloc[at : at + 128]]
                if len(known) > 300_000:
                    known.clear()
                new = sorted(set().union(*split).difference(known))
                known.update(zip(new, model.word_logits(new).tolist()))
                # Words in one order, so that equal texts have equal sums.
                out += [model.score_words(np.sort(np.fromiter(map(known.__getitem__, found), np.float64, len(found)))) for found in split]
            yield pd.Series(out, dtype="float64")
        known.clear()
        give_back()

    return documents.withColumn("score", judge(F.col("text")))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
