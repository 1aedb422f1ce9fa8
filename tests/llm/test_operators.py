"""Operators against brute force, and their behaviour on nulls, empty tables, ties, repeats and odd columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docassay.llm import bpe, chat, dedup, fingerprints, mixing, quality, records, toxicity, urls, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i * 7 % 501}" for i in range(30_000))


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, None, f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], DOC)


ODD = [None, "", " ", "one", "a b c d", "x  y\n\n z\t", "ünï çödé 日本語 🙂 test", "l1 l2\nl1 l2\nl1 l2", LONG]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_warc(spark, tmp_path):
    big = "é" * 30_000
    pages = spark.createDataFrame([(1, "http://a/", big, "x"), (2, None, big, "x"), (3, "u\r\nv", None, "x"), (4, "u", "s", "x"), (5, "u", "s", "x"), (5, "u", "s", "x"), (None, "u", big, "x"), (6, "u", "WARC/1.1\r\n\r\n" * 200, "x")], "page_id long, url string, html string, payload string")
    warc.write_archive(pages, str(tmp_path / "w"), segment_bytes=5_000, chunk_bytes=700, bundle_bytes=9_000, bundles_per_file=2)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["intact"]) for r in warc.read_archive(spark, str(tmp_path / "w")).collect()), key=str)
    n = len(big.encode())
    assert got == sorted([(1, n, "revisit", 2, True), (2, n, "response", None, True), (None, n, "revisit", 2, True), (3, 0, "response", None, True), (4, 1, "response", None, True), (5, 1, "response", None, True), (5, 1, "response", None, True), (6, 2400, "response", None, True)], key=str)


def test_warc_damage(spark, tmp_path):
    assert warc.dechunk(warc.chunked(b"x" * 1000, 7)) == b"x" * 1000
    assert warc.dechunk(b"5\r\nabc") is None
    warc.write_archive(spark.createDataFrame([(1, "u", "z" * 50_000)], "page_id long, url string, html string"), str(tmp_path / "w"))
    pieces_ = warc.read_records(spark, str(tmp_path / "w"))
    assert warc.assemble(pieces_.where("segment is null or segment <> 2")).first()["intact"] is False
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(empty, str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_chat_grammar():
    rng = random.Random(3)
    parts = [*chat.CONTROLS, "\\", "<", "|", "[", "a", "\n", "\\l", "é", "0|>", "<|user|0|>"]
    for _ in range(3000):
        role, text = ("".join(rng.choices(parts, k=rng.randrange(6))) for _ in range(2))
        assert [t[:2] for t in chat.parse(chat.render(role, text) * 2)] == [(role, text)] * 2


def test_chat(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, None, None, None), (None, 1, "assistant", "</s>"), (3, 5000, "user", "z"), (3, 1, "assistant", "y")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.digest_formatted(chat.format_conversations(turns)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["turns_sha256"], got[1]["loss_sha256"]) == (3, 2, sha("user\na\nassistant\nb\nassistant\nb\n"), sha("bb"))
    assert (got[2]["n_turns"], got[2]["turns_sha256"], got[2]["loss_chars"]) == (1, sha("\n\n"), 0)
    assert got[None]["loss_sha256"] == sha("</s>") and got[3]["turns_sha256"] == sha("assistant\ny\nuser\nz\n")
    assert chat.digest_formatted(chat.format_conversations(turns.limit(0))).count() == 0


def test_fingerprints_edited_and_near(spark):
    texts = [*ODD, "a b c d"]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs(spark, texts).withColumn("bucket", F.lit("x")), ranges=3).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""  # the next lower id; after the lowest the highest
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_next"] <= 1
    assert got[4]["fingerprint"] == got[len(ODD)]["fingerprint"]
    assert fingerprints.fingerprint_documents(docs(spark, [])).count() == 0
    single = fingerprints.fingerprint_documents(docs(spark, ["only one here"])).first()
    assert single["near_next"] == 1.0


def test_sampling_estimates_generalised_jaccard():
    rng = random.Random(5)
    errors = []
    sampler = fingerprints.Sampler(128, 10_000)
    for _ in range(30):
        a = Counter({f"w{i}": rng.randint(1, 5) for i in range(200)})
        b = Counter({w: (n if rng.random() < 0.6 else rng.randint(1, 9)) for w, n in a.items() if rng.random() < 0.9})
        pairs = [[w if n == 1 else (w, n) for w, n in c.items()] for c in (a, b)]
        true = sum((a & b).values()) / sum((a | b).values())
        errors.append(fingerprints.likeness(*map(sampler.sign, pairs)) - true)
        sampler.learn(set(pairs[0]) | set(pairs[1]))
        errors.append(fingerprints.likeness(*map(sampler.sign, pairs)) - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


@pytest.mark.parametrize("frequent, recent", [(1000, 1000), (3, 2)])
def test_bpe(spark, frequent, recent):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, "  lead", "trail ", "a\u00a0b \u2003c", "supercalifragilistic " * 3, "naïveté! zürich's 12345 ....", "it's we'll"]
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, texts), path, public_tokenizers.PATTERN, frequent_limit=frequent, recent_limit=recent).collect()}
    for i, t in enumerate(texts):
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest()), t
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_folds_a_word_once_for_a_group_of_texts(spark, monkeypatch):
    """Beyond the remembered words, too: they were folded anew for each text."""
    seen, fold = [], bpe.fold_words
    monkeypatch.setattr(bpe, "fold_words", lambda df, column, *a: seen.append(df.select(F.explode(column).alias("w"))) or fold(df, column, *a))
    text = " ".join(f"word{chr(97 + i)}xq" for i in range(20))
    got = bpe.encode_documents(docs(spark, [text] * 6).coalesce(1), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, frequent_limit=0, recent_limit=3)
    assert {r["decoded_sha256"] for r in got.collect()} == {hashlib.sha256(text.encode()).hexdigest()}
    words = [r["w"] for r in seen[-1].collect()]
    assert len(words) == len(set(words)) >= 20


def test_bpe_cuts_texts_as_the_pattern_does():
    import regex

    find, rng = regex.compile(public_tokenizers.PATTERN).findall, np.random.default_rng(5)
    texts = [*ODD, *("".join(rng.choice(list("ab é1.'s\n\t\u00a0\x1c "), n)) for n in rng.integers(0, 30, 2000)), *(" ".join(rng.choice(["it's", "ab", "1a.", "'s", "a\nb", "ß"], n)) for n in rng.integers(1, 9, 300))]
    codes, ends, words = bpe.cut_texts(pa.array(texts, pa.string()), find)
    cut = [words[c].as_py() for c in codes.tolist()]
    for t, a, b in zip(texts, [0, *ends.tolist()], ends.tolist()):
        assert cut[a:b] == find(t or ""), t


def test_bpe_empty(spark):
    assert bpe.encode_documents(docs(spark, []), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_urls(spark):
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
    rows = [(1, "http://A.Example.NET/en/1?x"), (2, "http://example.net/de/"), (3, "https://x.net"), (4, None), (5, "nothing"), (6, "http://badexample.com/de/x"), (7, "http://q.example.com/de/x#f"), (8, "a://b.org/fr/://c")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, verdict string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, none, rules).collect()}
    assert got == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/de/", "net/", "block"), 3: ("x.net", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("badexample.com", "/de/x", None, "allow"), 7: ("q.example.com", "/de/x", "example.com/de/", "block"), 8: ("b.org", "/fr/://c", "org/fr/", "allow"),
    }
    assert urls.judge_urls(pages.limit(0), none, rules).count() == 0


def test_reputation_blocks_bad_hosts(spark):
    rows = [(i, f"http://{'bad' if i < 60 else 'good'}.site{i % 2 if i >= 60 else 9}.com/{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i < 60 else 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labels, ())
    assert {(r["host"].split(".")[0], r["verdict"]) for r in got.collect()} == {("bad", "block"), ("good", "allow")}


def test_records(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, "  two  spaces", "tail ", "<|endoftext|> y", "a<|endoftext|>", "same", "same"]
    records.write_records(docs(spark, texts), str(tmp_path / "r"), path, 2, bundle_bytes=500, bundles_per_file=2)
    got = {r["doc_id"]: r for r in records.write_index(spark, str(tmp_path / "r"), str(tmp_path / "i")).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        file = next((tmp_path / "r").glob(got[i]["file"])).read_bytes()
        ((_, _, doc_id, alone),) = records.frames(file[got[i]["offset"] :][: got[i]["length"]])  # the index reads one record
        assert doc_id == i and alone.tolist() == ids
        at += len(ids)


def test_records_damage():
    data = records.frame(7, b"\x01\x00", 2) + b"\n"
    assert [(d, i.tolist()) for _, _, d, i in records.frames(data)] == [(7, [1])]
    for at in range(len(data)):
        with pytest.raises(ValueError):
            list(records.frames(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))


def test_chunks_match_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cache = records.text_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    cache.limit = 50
    rng = random.Random(1)
    texts = ["".join(rng.choices([*"ab1.' \n\té\u00a0\u2003", "<|endoftext|>", "\u0120"], k=rng.randrange(30))) for _ in range(3000)]
    for at in range(0, 3000, 100):
        part = texts[at : at + 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in cache.encode_texts(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def brute_mix(rows, weights, quality):
    size = {i: len(words(t)) for i, _, t in rows}
    sums = Counter()
    for i, s, _ in rows:
        sums[s] += size[i]
    targets = {s: (n, t) for s, n, t in mixing.source_targets(list(sums.items()), weights)}
    key = lambda i: -math.log((int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / quality.get(i, 1.0)
    out = {}
    for s, (n, target) in targets.items():
        epochs = int(target // n) if n else 0
        at = 0
        for i in sorted((i for i, x, _ in rows if x == s), key=key):
            out[i] = (epochs + (at + size[i] / 2 <= target - epochs * n)) * size[i]
            at += size[i]
    return out, targets


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", None]), " ".join("w" * rng.randrange(1, 30)) if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, taken int")
    quality_ = spark.createDataFrame([(i, 2.0 if i % 2 else 0.5) for i in range(0, 300, 3)], "doc_id long, weight double")
    expected, targets = brute_mix(rows, (5.0, 2.0, 1.0), {r["doc_id"]: r["weight"] for r in quality_.collect()})
    got = {r["doc_id"]: r for r in mixing.mix(df, quality_).collect()}
    assert {i: r["taken"] for i, r in got.items()} == expected
    for s, (n, target) in targets.items():
        assert target <= 2 * n and abs(sum(expected[i] for i, x, _ in rows if x == s) - target) <= 30
    mixed = Counter(r["doc_id"] for r in mixing.mix_documents(df, quality_).collect())
    assert mixed == {i: n // len(words(t)) for (i, _, t) in rows if (n := expected[i])}
    assert mixing.mix(df.limit(0), quality_).count() == 0 and mixing.mix_documents(df.limit(0), quality_).count() == 0


def test_mixing_repeated_and_null_rows(spark):
    rows = [(7, "a", "x y z", i % 2) for i in range(60)] + [(None, "a", None, 0), (None, "a", "p q", 1), (None, "a", "r", 2), (8, "a", "u v w x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, `a.b` int")
    none = spark.createDataFrame([], "doc_id long, weight double")
    got = mixing.mix(df, none, weights=(1.0,), total_share=1.5).collect()
    total = sum(len(words(t)) for _, _, t, _ in rows)
    assert len(got) == len(rows) and abs(sum(r["taken"] for r in got) - 1.5 * total) <= 4
    assert all(r["taken"] <= 2 * r["size"] for r in got) and {r["taken"] for r in got if r["doc_id"] == 7} == {3, 6}
    mixed = mixing.mix_documents(df, none, weights=(1.0,), total_share=1.5)
    assert mixed.columns == df.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == {k: v for k, v in sum((Counter({r["doc_id"]: r["taken"] // r["size"]}) for r in got if r["size"]), Counter()).items() if v}


def test_water_filling():
    got = mixing.source_targets([("a", 10), ("b", 1000), (None, 100)], (5.0, 2.0, 1.0))
    assert sum(t for *_, t in got) == pytest.approx(1.5 * 1110) and all(t <= 2 * n for _, n, t in got)


def five_grams(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(x, y):
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_dedup_against_brute_force(spark):
    rng = random.Random(4)
    base = [[f"v{rng.randrange(400)}" for _ in range(rng.randrange(30, 120))] for _ in range(25)]
    texts = [None, "", " \n", "a b", "a b", LONG, LONG + " end"]
    for words_ in base:
        for _ in range(rng.randrange(1, 8)):
            copy = list(words_)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    shared = " ".join(f"boiler{i}" for i in range(60))
    texts += [f"{shared} {' '.join(f'own{k}x{i}' for i in range(40))}" for k in range(20)]
    classes, split, grams = list(range(len(texts))), [words(t) for t in texts], [five_grams(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            same = split[i] == split[j]
            if same or jaccard(grams[i], grams[j]) >= 0.8:
                low, high = sorted((classes[i], classes[j]))
                classes = [low if c == high else c for c in classes]
    for small in (24, 2):  # the second way sends nearly all through the path of large buckets
        got = {r["doc_id"]: r["class_id"] for r in dedup.near_duplicates(docs(spark, texts), small=small).collect()}
        assert [got[i] for i in range(len(texts))] == classes
    kept = dedup.keep_one(docs(spark, texts).unionByName(spark.createDataFrame([(None, "n", None, None, None)], DOC)))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*set(classes), None])
    assert dedup.near_duplicates(docs(spark, [])).count() == 0


def star(rng, n_words, copies, edits):
    """An original amid its copies, each with other words replaced."""
    original = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    out = []
    for c in range(copies):
        text = list(original)
        for at in rng.sample(range(n_words), edits):
            text[at] = f"edit{c}x{at}"
        out.append(" ".join(text))
    out.insert(rng.randrange(copies // 3, copies), " ".join(original))
    return out


def test_dedup_loses_no_link_in_large_groups(spark):
    rng = random.Random(11)
    for texts, all_linked in ((star(rng, 200, 400, 4), False), (star(rng, 200, 150, 1), True)):
        near = [set() for _ in texts]
        grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(words, texts)]  # no run of five repeats here
        for i in range(len(texts)):
            for j in range(i):
                if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                    near[i].add(j)
                    near[j].add(i)
        assert all(len(x) == len(texts) - 1 for x in near) == all_linked
        got = {r["doc_id"]: r for r in dedup.near_duplicates(docs(spark, texts)).collect()}
        assert {r["class_id"] for r in got.values()} == {0}
        assert [got[i]["n_links"] for i in range(len(texts))] == [len(x) for x in near]


def test_darts_estimate_generalised_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        terms = rng.integers(1, 1 << 62, 300).astype(np.uint64)
        a, b = rng.integers(1, 4, 200), rng.integers(1, 4, 200)
        true = np.minimum(a[100:], b[:100]).sum() / (a.sum() + b.sum() - np.minimum(a[100:], b[:100]).sum())
        x, y = dedup.dart_signature(terms[:200], a), dedup.dart_signature(terms[100:], b)
        errors.append((x == y).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07
    assert (dedup.dart_signature(np.array([5], np.uint64), np.array([1])) != 0).all()


def test_quality_counts(spark):
    rng = random.Random(6)
    texts = [*ODD, *(" ".join(rng.choices(["a", "bb", "c|", "Dd"], k=rng.randrange(200))) for _ in range(40)), "same line here\n" * 30, "W " * 60]
    df = docs(spark, texts).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1))
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        expected = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        assert tuple(got[i][c] for c in quality.BASE) == expected, t
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert quality.judge(docs(spark, [])).count() == 0
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(8)
    bad = ["grobnik", "vexalot", "morblin"]
    rows, labels = [], []
    for i in range(900):
        w = ["".join(rng.choices(["ta", "ri", "no", "le", "su", "ka"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        toxic = i % 3 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(df.where("doc_id % 5 <> 0"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [i for i in range(0, 900, 5)]
    assert sum((got[i] >= 0.5) == (i % 3 == 0) for i in held) / len(held) > 0.95
    logits = model.word_logits(["grobnnik", "vexalott", "tarinole", "..."])
    assert logits[0] > logits[2] and logits[1] > logits[2] and np.isnan(logits[3])  # no letters, no evidence
    odd = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, ODD), model).collect()}
    assert all(0 <= s <= 1 for s in odd.values()) and odd[0] == odd[1] == odd[2] == 0.0


def test_toxicity_gradients_and_scores():
    rng = np.random.default_rng(3)
    vocabulary = ["grob", "vexalot", "ta", "rinole", "sukano"]
    flat, own = toxicity.ngrams(vocabulary)
    names, flat = np.unique(flat, return_inverse=True)
    vectors, soft = rng.normal(size=(len(names), 3)), rng.normal(size=3)
    numbers = np.array([0.2, 1.3, 0.8, -0.4, 0.1])
    docs = [[0, 1, 2], [3], [1, 2, 3, 4]]
    pool = np.concatenate(docs), np.repeat(np.arange(3), [len(d) for d in docs])
    labels, weight = np.array([1.0, 0, 1]), np.array([0.5, 2.0, 1.0])
    loss = lambda: toxicity.pooled_loss(vectors, soft, numbers, (flat, own), pool, labels, weight)
    _, grads = loss()
    for value, grad in ((vectors, grads["vectors"]), (soft, grads["soft"]), (numbers, grads["numbers"])):
        for at in np.ndindex(value.shape):
            held = value[at]
            value[at] = held + 1e-5
            high = loss()[0]
            value[at] = held - 1e-5
            low = loss()[0]
            value[at] = held
            assert grad[at] == pytest.approx((high - low) / 2e-5, abs=1e-6)
    # The score of one document, by a scalar version.
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.2, 1.3, 0.8, -0.4, 0.1)
    z = []
    for w in vocabulary:
        grams = [b for b, _ in zip(*toxicity.ngrams([w]))]
        z.append(sum(float(model.weights[b]) for b in grams) / len(grams) + 0.2)
    e = [math.exp(1.3 * x) for x in z]
    logit = 0.1 + 0.8 * sum(x * y for x, y in zip(e, z)) / sum(e) - 0.4 * math.log(len(z))
    assert model.score_words(model.word_logits([*vocabulary, "..."])) == pytest.approx(1 / (1 + math.exp(-logit)))


def test_toxicity_odd_tables(spark):
    rows = [(i % 7, ("bad grobnik " if i % 2 else "nice day ") * (1 + i % 3)) for i in range(40)] + [(None, "x"), (7, None), (7, None)]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, _evidence string, score double")
    labels = spark.createDataFrame([(0, 1), (0, None), (None, 1), (1, 0), (1, 1), (2, 0), (3, 1), (4, 0), (6, None)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.train(df, labels))
    assert got.columns == df.columns and got.count() == len(rows)
    by_text = {}
    for r in got.collect():
        by_text.setdefault(r["text"], set()).add(r["score"])
    assert all(len(v) == 1 for v in by_text.values()) and by_text[None] == {0.0}
    assert toxicity.score(df.limit(0), None).count() == 0 and toxicity.train(df.limit(0), labels) is None


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs(spark, ODD), none) is None
    assert {r["score"] for r in toxicity.score(docs(spark, ODD), None).collect()} == {0.0}


def test_rank_table():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        token, rank = f.readline().split()
    assert bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))[base64.b64decode(token)] == int(rank)
    pairs = {(0, 1): 5, (0, 3): 6, (1, 1): 7, (5, 2): 8}
    offset, entries = bpe.overlay(pairs)
    for a in range(9):
        for b in range(9):
            at = int(offset[a]) + b if a < len(offset) else -1
            hit = 0 <= at < len(entries) and entries[at] // bpe.NONE == a and entries[at] >= 0
            assert (int(entries[at] % bpe.NONE) if hit else None) == pairs.get((a, b))
