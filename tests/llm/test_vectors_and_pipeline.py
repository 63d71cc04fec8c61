import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import language_id, neighbours, packing, quality_rules

from .test_texts import brute_fingerprint, groups


def brute(ids, vectors, k=20):
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % 20 == 0:
            score = (vectors * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [ids[j] for j in order]
    return out


def test_recall(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = vectors.collect()
    expected = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float))
    got = {}
    for r in neighbours.nearest(vectors, F.col("id") % 20 == 0, block=200, query_block=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == expected.keys() and all(len(x) == 20 for x in got.values())
    assert sum(len(set(got[q]) & set(expected[q])) for q in got) / (20 * len(got)) >= 0.9


def test_counts_of_bit_sets():
    rng = np.random.default_rng(3)
    for many in (1, 2, 3, 7, 64):
        held = rng.random((many, 2, 128)) < 0.4
        sets = np.packbits(held, axis=2, bitorder="little").view(np.uint64)
        for threshold in range(many + 2):
            got = np.unpackbits(neighbours.at_least(sets, threshold).view(np.uint8), axis=1, bitorder="little")
            assert (got == (held.sum(axis=0) >= threshold)).all()


def test_windows_hold_all_places_within_their_width():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(1_000, 12))
    points /= np.sqrt((points**2).sum(axis=1))[:, None]
    turn = neighbours.lines(12)
    index, placed = neighbours.Index(points, turn), points @ turn
    chosen = np.tile(np.arange(turn.shape[1]), (5, 1))
    for width in (0.01, 0.1, 0.5, 3.0):
        centres = placed[:5]
        for threshold in (1, 100, turn.shape[1]):
            found = np.unpackbits(index.colliding(chosen, centres, width, threshold).view(np.uint8), axis=1, count=1_000, bitorder="little")
            exact = (np.abs(placed[None] - centres[:, None]) <= width - 1e-6).sum(axis=2) >= threshold
            assert (found >= exact).all()  # windows end at cells, so they hold no less
    assert found.all()


def test_recall_at_the_defaults():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(neighbours.BLOCK, 64))
    ids = np.arange(len(vectors))
    q = ids[::320]
    found = neighbours.search_block(ids, vectors, q, vectors[q], np.sqrt((vectors**2).sum(axis=1)).max())
    exact = [set(np.argsort(-np.where(ids == i, -np.inf, vectors @ vectors[i]))[:20]) for i in q]
    assert sum(v in exact[i] for i, v in zip(found[0], found[1], strict=True)) / (20 * len(q)) >= 0.9


def test_query_of_a_table(spark, sf_dir):
    df = neighbours.query(spark, sf_dir)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    rows = df.collect()
    assert {(r.query_id, r["rank"]) for r in rows} == {(i, k) for i in vectors if i % 20 == 0 for k in range(1, 21)}
    assert all(abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-12 and r.vec_id != r.query_id for r in rows)


def test_unequal_lengths_of_vectors_are_found():
    rng = np.random.default_rng(1)
    n = 4_000
    vectors = rng.normal(size=(n, 24)) * rng.lognormal(sigma=0.7, size=(n, 1))
    ids = np.arange(n)
    q = ids[::200]
    largest = np.sqrt((vectors**2).sum(axis=1)).max()
    found = neighbours.search_block(ids, vectors, q, vectors[q], largest)
    exact = [set(np.argsort(-np.where(ids == i, -np.inf, vectors @ vectors[i]))[:20]) for i in q]
    assert sum(v in exact[i] for i, v in zip(found[0], found[1], strict=True)) / (20 * len(q)) >= 0.9


def test_repeated_ids_and_large_products(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [1e200, -1e200]), (2, [3.0, 4.0]), (40, [1e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, F.col("id") % 20 == 0).collect())
    inf = float("inf")
    one = [(1e200, 1), (1e200, 40), (3.0, 2), (0.0, 20)]
    other = [(1e200, 40), (4.0, 2), (0.0, 20), (-1e200, 1)]
    large = [(7e200, 2), (1e200, 20), (1e200, 20), (-inf, 1)]
    assert out == sorted((q, k + 1, v, s) for q, x in ((20, one), (20, other), (40, large)) for k, (s, v) in enumerate(x))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [float("inf"), 0.0]), (4, [-1.0, 0.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0, 3.0]), (100, [0.0, 2.0]), (120, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    out = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 100, 0.0), (0, 4, 4, -1.0), (100, 1, 1, 1.0), (100, 2, 2, 1.0), (100, 3, 0, 0.0), (100, 4, 4, 0.0)]
    assert neighbours.nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []


def pipeline_docs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(9_000, None, "en", "src0", 0), (9_001, "$$$ 1 2 3", "en", "src1", 9), (9_002, "", None, None, 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    return docs.withColumns({"row": F.lit(1), "kept": F.lit(None).cast("string"), "score of: it": F.array(F.lit(0.5)), "id": F.lit("x")})


def test_pipeline_stages(spark, sf_dir):
    docs = pipeline_docs(spark, sf_dir)
    rows = {r.doc_id: r for r in docs.collect()}
    model = language_id.fit(docs)
    langs = {r.doc_id: r for r in language_id.predict(docs.select("doc_id", "text"), model).collect()}
    expected = {i for i, r in langs.items() if r.lang_pred != "und" and r.score >= language_id.MIN_SCORE}
    first = corpus_pipeline.known_language(spark, docs, sf_dir)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == expected and not expected & {9_000, 9_001, 9_002}

    crf = quality_rules.fit(first, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    expected = {r.doc_id for r in quality_rules.label_lines(first, crf).collect() if r.kept}
    second = corpus_pipeline.good_quality(spark, first, sf_dir)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == expected

    ids = sorted(expected)
    roots = groups([brute_fingerprint(rows[i].text) for i in ids], corpus_pipeline.NEAR_BITS)
    third = corpus_pipeline.without_copies(spark, second.unionByName(second.limit(3)), sf_dir)
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == sorted({ids[k] for k in roots})

    last = corpus_pipeline.packed(spark, third, sf_dir).collect()
    assert {r.doc_id for r in last} == {ids[k] for k in roots}


def test_pipeline_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    room = {}
    for r in rows:
        room[r.bin_id] = room.get(r.bin_id, 0) + r.length
    assert max(room.values()) <= packing.CAPACITY
    full = [v for v in room.values()]
    assert sum(full) / (len(full) * packing.CAPACITY) > 0.5


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []


def test_bins_of_hot_keys_are_not_scanned():
    rnd = random.Random(2)
    lengths = [rnd.randint(1, 600) for _ in range(6_000)]
    placed = packing.pack_shard(lengths, ["hot" if rnd.random() < 0.4 else f"s{rnd.randrange(20)}" for _ in lengths], [i // 2 for i in range(len(lengths))])
    assert len(placed) == len(lengths)
