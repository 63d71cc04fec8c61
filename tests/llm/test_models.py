"""The trained operators against brute force, and the queries' columns."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import language_id, license_scan, packing, quality_classifier, quality_rules, simhash

from .test_texts import ODD, brute_counts, brute_fingerprint, groups, odd_rows


# language ID


def grams(text):
    plain = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    return {plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)}


def bucket(gram):
    code = sum(ord(c) * int(language_id._FACTORS[len(gram) - 1, k]) for k, c in enumerate(gram)) % 2**64
    return (code ^ code >> 29) * 0x9E3779B97F4A7C15 % 2**64 >> 48


def test_string_kernels_and_ridge_regression(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect() if r.text and r.lang and len(r.text) > 50][:80]
    texts, langs = [r.text[:400] for r in rows], [r.lang for r in rows]
    held, letters = language_id.presence(texts)
    assert letters.all()
    model = language_id.train([np.packbits(x).tobytes() for x in held], langs, landmarks=16, ridge=1e-2)
    languages = sorted(set(langs))
    chosen = [i for x in languages for i in [k for k, y in enumerate(langs) if y == x][: 16 // len(languages)]]
    whole = [grams(t) for t in texts]
    for own in ([{bucket(g) for g in x} for x in whole], whole):
        kernel = np.array([[len(a & own[j]) / math.sqrt(len(a) * len(own[j])) for j in chosen] for a in own])
        # hashed n-grams exactly; the n-grams themselves but for those that share a bucket, a few of some hundred
        assert np.abs(model.kernels(held) - kernel).max() < (0.03 if own is whole else 1e-5)
    # kernel ridge regression in the space of the landmarks, solved plainly
    k = model.kernels(held).astype(float)
    values, vectors = np.linalg.eigh(k[chosen])
    features = k @ vectors / np.sqrt(values)
    targets = np.array([[float(x == y) for y in languages] for x in langs])
    plain = features @ np.linalg.inv(features.T @ features + 1e-2 * len(texts) * np.eye(len(chosen))) @ features.T @ targets
    got, score = model.predict(texts)
    assert got == [languages[i] for i in plain.argmax(axis=1)]
    assert np.abs(score - np.clip(plain.max(axis=1), 0, 1)).max() < 1e-3


def test_language_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.query(spark, sf_dir)
    assert rows.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    import zlib

    got = rows.collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_language_sample_is_that_of_the_smallest_hashes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.unionAll(docs).unionAll(docs.select(F.lit(None).cast("bigint").alias("doc_id"), "text", "lang", "source", "n_chars").limit(5))
    a, b = language_id.fit(odd.repartition(7), each=10), language_id.fit(odd.repartition(2), each=10)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and np.array_equal(a.landmarks, b.landmarks)
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("lang"), "id").alias("lang"))
    assert len(language_id.fit(many, sample=50).languages) == 50


# quality rules


def chance_of(scores, stay, states):
    """Log likelihood of states by listing all paths. scores: of state 1 over state 0."""
    paths = [sum(scores[i] * p[i] for i in range(len(p))) + sum(stay[a, b] for a, b in itertools.pairwise(p)) for p in itertools.product((0, 1), repeat=len(scores))]
    own = sum(scores[i] * states[i] for i in range(len(states))) + sum(stay[a, b] for a, b in itertools.pairwise(states))
    return own - math.log(sum(math.exp(x) for x in paths))


def test_slopes_of_the_random_field():
    rng = np.random.default_rng(6)
    lengths = np.array([1, 4, 6, 2])
    features = (rng.random((int(lengths.sum()), 3)) < 0.5).astype(float)
    states = (rng.random(len(features)) < 0.5).astype(np.int8)
    weights, stay = rng.normal(size=3), rng.normal(size=(2, 2))

    def value(weights, stay):
        scores, at, out = features @ weights, 0, 0.0
        for n in lengths:
            out += chance_of(scores[at : at + n], stay, states[at : at + n])
            at += n
        return out

    slope, change = quality_rules.Crf._slopes(features, lengths, states, weights, stay)
    step = 1e-5
    for i in range(3):
        d = np.eye(3)[i] * step
        assert slope[i] == pytest.approx((value(weights + d, stay) - value(weights - d, stay)) / (2 * step), abs=1e-4)
    for a, b in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[a, b] = step
        assert change[a, b] == pytest.approx((value(weights, stay + d) - value(weights, stay - d)) / (2 * step), abs=1e-4)


def features_of(text):
    """The features of each line with a word, one character at a time."""
    out, seen = [], set()
    for line in (text or "").split("\n"):
        words = re.findall("[^\x20\x09-\x0d]+", line)
        if not words:
            continue
        chars = sum(map(len, words))
        of = lambda some, line=line: sum(c in some for c in line)
        capitals, small = of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("abcdefghijklmnopqrstuvwxyz")
        symbol, capital, digit, pipe, cry = of("#*$%&|<>") / chars, capitals / max(1, capitals + small), of("0123456789") / chars, of("|") / chars, of("!") / chars
        marks = [symbol > 0.02, symbol > 0.08, capital > 0.4, capital > 0.8, digit > 0.3, pipe > 0.02, cry > 0.04]
        again, mean = line in seen, chars / len(words)
        out.append([True, *marks, len(words) < 3, len(words) < 8, len(words) > 30, again, mean < 3, mean > 12, not (any(marks) or again)])
        seen.add(line)
    return np.array(out, float).reshape(-1, len(quality_rules.FEATURES)), [len(re.findall("[^\x20\x09-\x0d]+", x)) for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]


def test_quality_verdicts_by_listing_all_paths(spark, sf_dir):
    rng = np.random.default_rng(7)
    model = quality_rules.Crf(rng.normal(size=len(quality_rules.FEATURES)), rng.normal(size=(2, 2)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_rows(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text").where("doc_id IS NOT NULL").distinct())
    text = {r.doc_id: r.text for r in docs.collect()}
    checked = 0
    for r in quality_rules.label_lines(docs, model).collect():
        features, words = features_of(text[r.doc_id])
        if len(words) > 8:
            continue
        scores = features @ model.weights
        paths = list(itertools.product((0, 1), repeat=len(scores)))
        best = max(paths, key=lambda p: sum(scores[i] * p[i] for i in range(len(p))) + sum(model.stay[a, b] for a, b in itertools.pairwise(p)))
        share = sum(w for w, s in zip(words, best, strict=True) if s == 0) / max(1, sum(words))
        assert r.content_share == pytest.approx(share) and r.kept == (not r.base_failed and share >= quality_rules.KEEP_SHARE)
        assert [x for x in r.line_labels if x >= 0] == [1 - s for s in best]
        checked += 1
    assert checked > 100


def test_quality_sample_holds_whole_documents(spark):
    long = "\n".join(" ".join(f"line{i}{c}" for c in "abcdefgh") for i in range(1_000))
    short = "\n".join(" ".join(f"row{i}{c}" for c in "abcdefgh") for i in range(70))
    docs = spark.createDataFrame([(1, long), (2, short), (2, short + "\nand more"), (3, "too short"), (4, None), (None, short)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1), (None, 1), (9, 0)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality_rules.sample(docs, labels).collect()}
    assert {i: r.sizes for i, r in rows.items()} == {1: rows[1].sizes, 2: [64, 6]}  # 3 and 4 fail the base rules
    assert len(rows[1].sizes) == quality_rules.SAMPLE_RUNS and len(rows[1].lines) == sum(rows[1].sizes) and len(rows[2].lines) == 70
    counts = np.array([0, 1_000, 64, 0, 300])
    taken, sizes = quality_rules._runs(counts)
    kept = np.split(taken, np.cumsum(counts)[:-1])
    assert [int(x.sum()) for x in kept] == [0, sum(sizes[:4]), 64, 0, sum(sizes[5:])] and sizes.sum() == taken.sum()
    assert kept[1].nonzero()[0].max() > 500  # not only the first lines


def test_quality_query(spark, sf_dir):
    rows = quality_rules.query(spark, sf_dir)
    assert rows.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = rows.collect()
    assert len(got) == len(text) and all(tuple(r[1:6]) == brute_counts(text[r.doc_id]) for r in got)


# quality classifier


def fmix(x):
    mask = 2**64 - 1
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & mask
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & mask
    return x ^ x >> 33


def test_weights_and_keys_by_plain_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(odd_rows(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"), allowMissingColumns=True).where("length(text) < 5000 OR text IS NULL")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(quality_classifier.SEED), "doc_id").alias("noise")).collect()
    bucket = {}

    def places(text):
        words = [w.decode("utf-8", "replace") for w in re.findall(rb"[0-9a-z_\x80-\xff]+|[^\s0-9a-z_\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()).replace(b"\x00", b""))]
        out = []
        for some in [(w,) for w in words] + list(itertools.pairwise(words)):
            if some not in bucket:
                data = " ".join(some).encode()
                bucket[some] = int(quality_classifier.grams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0][-1])
            out.append(bucket[some])
        return out

    found = [places(r.text) for r in rows]
    raw, target = Counter(), Counter()
    for r, own in zip(rows, found, strict=True):
        raw.update(own)
        if r.doc_id in good:
            target.update(own)
    n, t = sum(raw.values()) + quality_classifier.BUCKETS, sum(target.values()) + quality_classifier.BUCKETS
    expected = defaultdict(list)
    for r, own in zip(rows, found, strict=True):
        weight = sum(math.log((target[b] + 1) / t) - math.log((raw[b] + 1) / n) for b in own)
        key = weight - math.log(-math.log((fmix(r.noise % 2**64) + 0.5) / 2.0**64))
        expected[r.doc_id].append((weight, key))
    got = defaultdict(list)
    result = quality_classifier.resample(docs, labels).collect()
    for r in result:
        got[r.doc_id].append((r.log_weight, r.gumbel_key))
    assert got.keys() == expected.keys()
    for i in got:
        assert np.allclose(sorted(got[i]), sorted(expected[i]), rtol=1e-6, atol=1e-6)
    k = math.ceil(quality_classifier.SHARE * len(rows))
    cut = sorted((r.gumbel_key for r in result), reverse=True)[k - 1]
    assert all(r.selected == (r.gumbel_key >= cut) for r in result)


def test_other_queries(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = quality_classifier.query(spark, sf_dir)
    assert rows.dtypes == [("doc_id", "bigint"), ("log_weight", "double"), ("gumbel_key", "double"), ("selected", "boolean")]
    assert sorted(r.doc_id for r in rows.collect()) == sorted(docs)
    rows = simhash.query(spark, sf_dir)
    assert rows.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    rows = sorted(rows.collect())
    assert [r.fingerprint for r in rows] == [f"{brute_fingerprint(docs[r.doc_id].text):016x}" for r in rows]
    rows = license_scan.query(spark, sf_dir)
    assert rows.columns == ["doc_id", "license", "permissive", "dice", "span_start", "span_end", "n_hits"]
    for r in rows.collect():
        hits = license_scan.scan_text(docs[r.doc_id].text or "")
        assert r.n_hits == len(hits) and ((r.license, r.span_start) in {(h[1], h[2]) for h in hits} if hits else r.license is None)


# pipeline


def test_pipeline_keeps_what_plain_code_keeps(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = language_id.fit(spark.createDataFrame(docs))
    told = [dict(zip(("lang", "score"), (x[0] for x in model.predict([r.text or ""])), strict=True)) for r in docs]
    first = [r for r, x in zip(docs, told, strict=True) if x["lang"] != "und" and x["score"] >= language_id.MIN_SCORE]
    crf = quality_rules.fit(spark.createDataFrame(first), labels)
    second = []
    for r in first:
        n_words, _, _, _, repeated = brute_counts(r.text)
        features, words = features_of(r.text)
        content = crf.decode(features, np.array([len(words)])) == 0
        if n_words >= 10 and 100 * repeated <= 20 * n_words and sum(w for w, c in zip(words, content, strict=True) if c) >= quality_rules.KEEP_SHARE * n_words:
            second.append(r)
    roots = groups([brute_fingerprint(r.text) for r in second], corpus_pipeline.NEAR_BITS)
    third = [second[k] for k in sorted(set(roots))]
    lengths = {r.doc_id: brute_counts(r.text)[0] for r in third}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    placed = Counter()
    for r in rows:
        placed[r.doc_id] += r.length
    assert placed == lengths
    source, bins = {r.doc_id: r.source for r in docs}, defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    for own in bins.values():
        assert sum(r.length for r in own) <= packing.CAPACITY
        told = [source[r.doc_id] for r in own if source[r.doc_id] is not None]
        assert len(told) == len(set(told))


def test_pipeline_of_odd_rows(spark, sf_dir):
    texts = [t for t in ODD if t is None or len(t) < 10_000] + [" ".join(f"mot{i}" for i in range(60_000)), "The same words again and again in one more text of ten words"]
    rows = [(None if i % 3 == 0 else i, t, None if i % 2 else "en", None if i % 2 == 0 else "src1", i, "x") for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    assert docs.select("text").distinct().count() == docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sum(r.length for r in last) == sum(len((r.text or "").split()) for r in docs.collect())
