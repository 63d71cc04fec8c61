import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexloom.operators import evaluation as E
from lexloom.operators import gaps, layout, ordering, scoring, sequences, similarity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_deletion_index_finds_all(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7)))
    left, right = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    a, b = (spark.createDataFrame([(w, i) for i, w in enumerate(x)], f"{n} string, i{n} int") for n, x in (("a", left), ("b", right)))
    for most in (0, 1, 2):
        got = {(r.a, r.b, r.distance) for r in similarity.within_distance(a, b, "a", "b", most).collect()}
        assert got == {(x, y, distance(x, y)) for x in left for y in right if distance(x, y) <= most}
    by_length = F.when(F.length("a") < 3, 0).otherwise(2)
    got = {(r.a, r.b) for r in similarity.within_distance(a, b, "a", "b", by_length).collect()}
    assert got == {(x, y) for x in left for y in right if distance(x, y) <= (0 if len(x) < 3 else 2)}


def test_long_strings_meet_by_thirds(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("ab") for _ in range(n)) for n in (29, 30, 31, 32, 33, 34, 60, 150) for _ in range(2)]

    def edited(word):
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(word))
            word = rnd.choice([word[:i] + word[i + 1 :], word[:i] + "c" + word[i:], word[:i] + "c" + word[i + 1 :]])
        return word

    others = sorted({edited(w) for w in words for _ in range(3)})
    a, b = spark.createDataFrame([(w,) for w in set(words)], "a string"), spark.createDataFrame([(w,) for w in others], "b string")
    for most in (0, 1, 2):
        got = {(r.a, r.b) for r in similarity.within_distance(a, b, "a", "b", most).collect()}
        assert got == {(x, y) for x in set(words) for y in others if abs(len(x) - len(y)) <= most and distance(x, y) <= most}


def test_pairs_are_those_of_brute_force(spark):
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 5))) for _ in range(25)})
    readings = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 8))) for _ in range(12)]
    rows = spark.createDataFrame([(i % 5, r) for i, r in enumerate(readings)], "id int, r string")
    index = spark.createDataFrame(list(enumerate(words)), "pos int, word string")
    allowed = lambda p: 0 if len(p) <= 2 else 1 if len(p) <= 4 else 2
    for cap in (400, 5):
        got = {}
        for r in similarity.propose_pairs(rows, index, "id", "r", "word", "pos", cap).collect():
            got.setdefault(r.id, []).append((r.distance, r.a, r.b))
        for i in range(5):
            best = {}
            for r in {x for k, x in enumerate(readings) if k % 5 == i and len(x) >= 2}:
                for cut in range(1, len(r)):
                    sides = [[(k, distance(p, w)) for k, w in enumerate(words) if distance(p, w) <= allowed(p)] for p in (r[:cut], r[cut:])]
                    for (a, da), (b, db) in itertools.product(*sides):
                        best[a, b] = min(best.get((a, b), 99), da + db)
            assert sorted(got.get(i, [])) == sorted((d, a, b) for (a, b), d in best.items())[:cap]


def test_losses_are_sums_over_paths():
    rng = np.random.default_rng(1)
    logp = np.log(rng.dirichlet(np.ones(3), size=5))
    targets = [list(t) for n in range(5) for t in itertools.product((1, 2), repeat=n)]
    chance = dict.fromkeys(map(tuple, targets), 0.0)
    for path in itertools.product(range(3), repeat=5):
        read = tuple(c for i, c in enumerate(path) if c and (i == 0 or path[i - 1] != c))
        if read in chance:
            chance[read] += np.exp(sum(logp[t, c] for t, c in enumerate(path)))
    with np.errstate(divide="ignore"):
        assert np.allclose(scoring.ctc_losses(logp, targets), [-np.log(chance[tuple(t)]) for t in targets])
    assert scoring.ctc_losses(logp, [[1, 1, 1, 1]])[0] == np.inf


def test_top_candidates_and_ranking(spark):
    peaked = [[0.05, 0.9, 0.05], [0.9, 0.05, 0.05], [0.05, 0.05, 0.9]]
    frames = [[float(np.log(v)) for v in row] for row in peaked]
    df = spark.createDataFrame([(1, [frames, frames])], "id int, models array<array<array<double>>>")
    out = scoring.top_candidates(df, "id", "models", [("ab", [1, 2]), ("b", [2]), ("long", [1, 1, 2, 2])], 3).orderBy("rank").collect()
    assert [r.candidate for r in out] == ["ab", "b", "long"] and out[2].score is None and out[2].p_rel == 0 and abs(sum(r.p_rel for r in out) - 1) < 1e-3
    best = scoring.free_best(df.withColumn("r", F.expr("array(array(1, 2), array(), array(2))")), "id", "models", "r").first()
    assert best.reading == [1, 2]
    with pytest.raises(ValueError, match="at most"):
        scoring.top_losses(df, "id", "models", [("a", [1])] * (scoring.MOST_CANDIDATES + 1))


def ranked(spark, words, pairs, penalty, k=5, log_total=None):
    """words, pairs: (head, loss) and (a, b, loss) of one row; log_total: of words that aren't among them too."""
    finite = [-x for _, x in words if x < np.inf]
    total = log_total if log_total is not None else float(np.logaddexp.reduce(finite)) if finite else -np.inf
    one = spark.createDataFrame([(1, a, i, x, total) for i, (a, x) in enumerate(words)], "id int, a int, rank int, loss double, log_total double")
    two = spark.createDataFrame([(1, a, b, x, i) for i, (a, b, x) in enumerate(pairs)], "id int, a int, b int, loss double, ord int")
    return scoring.merge_ranked(one, two, "id", penalty, k).orderBy("rank").collect()


def test_words_and_pairs_by_their_scores(spark):
    words, pairs, inf = [(5, 3.0), (6, 4.0), (7, 9.5)], [(1, 2, -1.0), (3, 4, 1.0), (8, 9, 0.5)], np.inf
    got = [(r.kind, r.a, r.b, r.loss, r.score) for r in ranked(spark, words, pairs, 8.0)]
    assert got == [("word", 5, None, 3.0, 3.0), ("word", 6, None, 4.0, 4.0), ("pair", 1, 2, -1.0, 7.0), ("pair", 8, 9, 0.5, 8.5), ("pair", 3, 4, 1.0, 9.0)]
    assert [(r.kind, r.a, r.score) for r in ranked(spark, words, pairs, 0.0, 2)] == [("pair", 1, -1.0), ("pair", 8, 0.5)]
    assert [(r.kind, r.a, r.score) for r in ranked(spark, words, pairs, 100.0, 4)] == [("word", 5, 3.0), ("word", 6, 4.0), ("word", 7, 9.5), ("pair", 1, 99.0)]
    assert ranked(spark, [], [], 8.0) == [] and [r.a for r in ranked(spark, words, [], 8.0, 2)] == [5, 6]
    got = ranked(spark, [(1, 8.0), (2, inf)], [(3, 4, 0.0), (5, 6, inf), (7, 8, 0.0)], 8.0, 10)
    assert [(r.kind, r.a) for r in got] == [("word", 1), ("pair", 3), ("pair", 7), ("word", 2), ("pair", 5)] and got[-1].score is None and got[-1].p_rel == 0
    with pytest.raises(ValueError, match="finite"):
        ranked(spark, words, pairs, float("nan"))


def test_ranking_is_on_written_scores_and_chances_on_losses(spark):
    # unrounded, the pair would win by 0.0003
    got = ranked(spark, [(2, 10.0004), (0, 11.0)], [(0, 1, 2.0001)], 8.0, 3, -9.5)
    assert [(r.kind, r.a, r.score) for r in got] == [("word", 2, 10.0), ("pair", 0, 10.0), ("word", 0, 11.0)]
    total = np.logaddexp(-9.5, -10.0001)
    assert [r.p_rel for r in got] == [round(float(np.exp(-x - total)), 4) for x in (10.0004, 10.0001, 11.0)] and got[1].loss == 2.0
    tiny = ranked(spark, [(1, 5_000.0), (2, 5_001.0)], [(1, 2, 4_993.0)], 8.0)
    assert abs(sum(r.p_rel for r in tiny) - 1) < 1e-3


def test_pair_losses_are_the_least_of_the_means(spark):
    rng = np.random.default_rng(2)
    models = [np.log(rng.dirichlet(np.ones(4), size=6)) for _ in range(3)]
    df = spark.createDataFrame([(1, [m.tolist() for m in models], [{"a": 12, "b": 1, "left": [1, 2], "right": [1]}, {"a": 2, "b": 2, "left": [2], "right": [2]}])], "id int, models array<array<array<double>>>, pairs array<struct<a:int,b:int,left:array<int>,right:array<int>>>")
    got = {(r.a, r.b): r.loss for r in scoring.pair_losses(df, "id", "models", "pairs", 3).collect()}
    mean = lambda t: np.mean([scoring.ctc_losses(m, [t])[0] for m in models])
    assert got == {(12, 1): pytest.approx(min(mean([1, 2, 3, 1]), mean([1, 2, 1]))), (2, 2): pytest.approx(min(mean([2, 3, 2]), mean([2, 2])))}


def test_free_best_is_the_first_of_least_loss(spark):
    frames = np.log([[0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]).tolist()
    df = spark.createDataFrame([(1, [frames], [[], [2], [1, 2], [1, 2]]), (2, [frames], [[]]), (3, [frames], [[1, 1, 2]])], "id int, m array<array<array<double>>>, r array<array<int>>")
    got = {x.id: (x.reading, x.score) for x in scoring.free_best(df, "id", "m", "r").collect()}
    assert got == {1: ([1, 2], round(-np.log(0.64), 3)), 2: (None, None), 3: ([1, 1, 2], None)}


def test_alignment_is_shortest_and_prefers_pairs(spark):
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.choice("xyz") for _ in range(rnd.randint(0, 6))] for _ in range(2))
        path = E.align_pair(a, b)
        assert [x for x, _ in path if x] == a and [y for _, y in path if y] == b
        assert sum(x != y for x, y in path) == distance(a, b)
    rows = spark.createDataFrame([("w1", ["a", "b"], ["a", "c"]), ("w2", ["b"], ["c"]), ("w2", ["b"], ["c"]), ("w3", ["b", "a"], ["a"])], "w string, r array<string>, h array<string>")
    assert {tuple(r) for r in E.confusions(rows, "w", "r", "h", 1).collect()} == {("b", "c", 2, 4), ("b", "-", 1, 4)}


def test_gap_thresholds():
    rng = np.random.default_rng(1)
    even = np.concatenate([rng.lognormal(np.log(3), 0.2, 200), rng.lognormal(np.log(20), 0.2, 150)])
    found = gaps.threshold(even, 40)
    assert found["method"] == "valley" and 5 < found["threshold"] < 14
    few_wide = np.concatenate([rng.lognormal(np.log(3), 0.2, 200), rng.lognormal(np.log(60), 0.1, 10)])
    assert gaps.threshold(few_wide, 40)["method"].startswith("otsu (few")
    assert gaps.threshold(np.array([5.0] * 7), 40) | {"n_gaps": 0} == {"n_gaps": 0, "threshold": 12.0, "method": "few gaps", "small_mode": None, "large_mode": None, "otsu": None}


def test_merge_fold_decisions(spark):
    rows = [("p", 0, 10, 6.0), ("p", 12, 20, 5.0), ("p", 22, 30, None), ("q", 0, 10, 6.0), ("q", 100, 110, 5.0)]
    df = spark.createDataFrame(rows, "k string, l int, r int, s double")
    joined = lambda scores: {2: 10.5}.get(len(scores), np.inf)
    out = sequences.merge_fold(df, ["k"], "l", "r", "s", joined, 5).orderBy("k", "unit").collect()
    assert [(r.k, r["first"], r["last"], r.n, r.best) for r in out] == [("p", 0, 20, 2, 10.5), ("p", 22, 30, 1, None), ("q", 0, 10, 1, 6.0), ("q", 100, 110, 1, 5.0)]


def test_folds_over_arrays(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    array = lambda *x: F.array(*(F.lit(v) for v in x))
    assert one(sequences.smooth_labels(array("H", "G", "H", "G", "H", "H"))) == list("HHHHHH")
    assert one(sequences.smooth_labels(array("G", "H", "H", "G"))) == list("GHHG")
    assert one(sequences.page_numbers(array(2, 9, None, 90, 5), array(True, False, True, True, True))) == [2, 2, 3, 4, 5]
    assert one(sequences.dehyphenated(F.lit("won-\n der well-known"))) == "wonder well-known"
    assert one(scoring.greedy(F.expr("array(array(0d,1d), array(0d,1d), array(1d,0d), array(0d,1d))"))) == [1, 1]


def test_groups_in_order(spark):
    lines = spark.createDataFrame([("a", x, y, x) for x, y in [(1, 10.0), (2, 11.0), (3, 50.0), (4, 12.0), (5, 52.0)]], "k string, x int, y double, i int")
    assert {(r.x, r.line_no) for r in sequences.text_lines(lines, ["k"], "x", "y", 5).collect()} == {(1, 0), (2, 0), (4, 0), (3, 1), (5, 1)}
    plane = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (3.0, 0.0), (0.5, 0.5), (9.0, 9.0)])], "k string, i int, x double, y double")
    assert [r.group_no for r in sequences.gap_groups_2d(plane, ["k"], "i", "x", "y", 3.0).orderBy("i").collect()] == [0, 0, 0, 1]
    heads = spark.createDataFrame([("s", i, h) for i, h in enumerate(["apple", "bear", "zoo", "cat", "adder", "dog"])], "s string, i int, h string")
    assert [r.h for r in sequences.in_alphabetical_order(heads, ["s"], "i", "h").orderBy("i").collect()] == ["apple", "bear", "cat", "adder", "dog"]
    glyphs = [("p", 10 * i, 10 * i + 8, 100 + (i == 3), True) for i in range(7)] + [("p", 70, 78, 100, False), ("p", 80, 88, 100, True)]
    runs = sequences.close_runs(spark.createDataFrame(glyphs, "p string, l int, r int, base int, glyph boolean"), ["p"], "l", "r", F.lit(5), 6, F.col("glyph"), "base", 0.5)
    assert [(r.n, r.l, r.r) for r in runs.collect()] == [(7, 0, 68)]
    widths = spark.createDataFrame([("k", i, w) for i, w in enumerate([5, 1, 9, 2, 2])], "k string, i int, w int")
    assert sorted((r.i, r.batch) for r in ordering.width_batches(widths, ["k"], "i", "w", 3, 10).collect()) == [(0, 1), (1, 0), (2, 2), (3, 0), (4, 0)]


def test_positions_of_all_rows(spark):
    rnd = random.Random(6)
    values = [(rnd.randrange(50), i) for i in range(2_000)]
    out = ordering.positions(spark.createDataFrame(values, "x int, i int").repartition(7), ["x", "i"]).orderBy("pos").collect()
    assert [(r.x, r.i) for r in out] == sorted(values) and [r.pos for r in out] == list(range(2_000))


def test_nearest_is_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(3), i, rnd.randrange(60)) for i in range(80)]
    marks = [(rnd.randrange(2), 1_000 + i, rnd.randrange(60)) for i in range(20)]
    out = sequences.nearest(spark.createDataFrame(rows, "k int, i int, x int"), spark.createDataFrame(marks, "k int, id int, at int"), "k", "x", "at", "id", 5)
    for r in out.collect():
        near = [(abs(at - r.x), at, i) for k, i, at in marks if k == r.k and abs(at - r.x) <= 5]
        assert (r.target, r.distance) == ((min(near)[2], min(near)[0]) if near else (None, None))
    assert out.count() == len(rows)


def test_pieces_are_those_of_a_flood_fill():
    rng = np.random.default_rng(2)
    for diagonal in (True, False):
        mask = rng.random((20, 25)) < 0.45
        left, sizes = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}, []
        while left:
            queue, n = [left.pop()], 1
            while queue:
                y, x = queue.pop()
                for dy, dx in itertools.product((-1, 0, 1), repeat=2):
                    if (diagonal or not dy or not dx) and (y + dy, x + dx) in left:
                        left.remove((y + dy, x + dx))
                        queue.append((y + dy, x + dx))
                        n += 1
            sizes.append(n)
        found = layout.pieces(mask, diagonal)
        assert sorted(found.area) == sorted(sizes) and (found.x1 > found.x0).all() and found.x1.max() <= 25
    assert layout.pieces(np.zeros((3, 3), bool)).empty


def test_page_measures(spark):
    assert layout.true_runs(np.array([1, 1, 0, 1, 0, 0, 1], bool), 2, 1) == [(0, 4)]
    page = np.full((60, 200), 255, np.uint8)
    page[20, 10:190] = 0
    page[40:44, 50:54] = 0
    assert layout.rules(layout.ink(page), 100).sum() == 180
    y, x = np.mgrid[0:60, 0:200]
    tilted = np.abs(y - 30 - x * np.tan(np.radians(2))) < 1
    assert layout.skew(tilted, np.arange(-3, 3.5, 0.5)) == 2.0
    assert layout.pitch(np.tile([0, 0, 5, 9, 5, 0, 0, 0, 0, 0], 12).astype(float), 5, 15) == 10
    both = layout.darkest([(0, 0, np.array([[10, 200]], np.uint8)), (1, 0, np.array([[100, 50]], np.uint8))])
    assert both.tolist() == [[10, 100, 50]]
    df = spark.createDataFrame(pd.DataFrame({"id": [1], "pixels": [page.tobytes()], "h": [60], "w": [200]}))
    found = layout.page_pieces(df, "id").orderBy("area").collect()
    assert [(r.area, r.x0, r.y1) for r in found] == [(16, 50, 44), (180, 10, 21)]
