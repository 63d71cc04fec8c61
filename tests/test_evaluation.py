"""Scores against references, structural checks and samples, on small tables and against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexloom.operators import evaluation as E
from lexloom.operators import folds, ordering, sequences
from lexloom.operators import lexicon as L
from lexloom.operators import validation as V
from lexloom.operators import wordlist as W


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_accuracy(spark):
    rows = [("s", "a b", "a b", 0, 2, ["a b"]), ("s", "a", "b", 1, 1, ["b", "a"]), ("t", "c", "c", 0, 1, []), ("t", "d", "e", 1, 1, None)]
    out = {r.source: tuple(r)[1:] for r in E.accuracy(spark.createDataFrame(rows, "source string, ref string, hyp string, edits int, length int, top array<string>"), "source").collect()}
    assert out == {None: (4, 0.4, 0.5, 0.25, 0.5), "s": (2, 0.3333, 0.5, 0.5, 1.0), "t": (2, 0.5, 0.5, 0.0, 0.0)}


def test_report_is_in_order(spark):
    rows = [(f"w{i}", ["a"], ["b"]) for i in range(3)] + [(f"w{i}", ["b"], ["a"]) for i in range(3)] + [(f"w{i}", ["c"], []) for i in range(4)]
    found = E.report(E.confusions(spark.createDataFrame(rows, "w string, r array<string>, h array<string>"), "w", "r", "h", 3, 2)).orderBy("place").collect()
    assert [(r.ref, r.hyp, r.n_words, r.ref_total, r.examples) for r in found] == [("c", "-", 4, 4, "w0, w1"), ("b", "a", 3, 3, "w0, w1"), ("a", "b", 3, 3, "w0, w1")]


def test_ground_truth(spark):
    rows = spark.createDataFrame([("1", "x", "A B", "Z", "ab"), ("2", "x", "", "C", "c"), ("3", "x", None, None, "d"), ("4", "x", "", "", None), ("5", "y", "A", "", "a")], "id string, language string, tokens_verified string, tokens_rule string, latin string")
    keys = spark.createDataFrame([(str(i), 1, i) for i in (1, 2, 3, 5)], "id string, page int, line int")
    read = spark.createDataFrame([(1, 1, ["A B", "A"], "A C", "A B"), (1, 2, ["X", "C"], "C", None), (1, 3, [], "", "D")], "page int, line int, top array<string>, free string, free_best string")
    listed = spark.createDataFrame([("A B",), ("C",), ("C",)], "tokens string")
    plain = {r.way: r for r in E.ground_truth_scores(rows, keys, read, listed, "x").collect()}
    r = plain["labelled"]
    assert (r.words, r.top1, r.top5, r.free, r.free_best, r.edits, r.ref_tokens, r.in_list, r.top1_in_list, r.top5_in_list) == (2, 1, 2, 1, 1, 1, 3, 2, 1, 2) and plain["unlabelled"].unlabelled == 2
    told = {r.way: r for r in E.ground_truth_scores(rows, keys, read, listed, "x", F.upper("latin")).collect()}
    assert (told["spelled"].words, told["spelled"].free_best, told["spelled"].edits, told["unlabelled"].unlabelled) == (1, 1, 1, 1)
    with pytest.raises(PySparkException, match="1 labelled rows have no reading"):
        E.ground_truth_scores(rows, keys, read.where("line <> 2"), listed, "x").collect()


def test_edits_of_arrays(spark):
    rnd = random.Random(1)
    rows = [([rnd.choice("abc") for _ in range(rnd.randint(0, 6))], [rnd.choice("abc") for _ in range(rnd.randint(0, 6))]) for _ in range(100)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert all(r.d == distance(r.a, r.b) for r in df.withColumn("d", E._edits(F.col("a"), F.col("b"))).collect())


def test_merged_scores(spark):
    items = [("u1", "match", "1.1", ["1.1"], 1, "A"), ("u2", "match", "1.2", ["1.2"], 1, "B"), ("u3", "split", "1.4", ["1.5", "1.4"], 1, "C"), ("u4", "merge", "1.6", ["1.6"], 2, "D _ E"), ("u5", "match", "9.9", ["9.9"], 1, "F")]
    outputs = [(["1.1"], "A"), (["1.2", "1.3"], "B"), (["1.4", "1.5"], "C"), (["1.6"], "D _ E")]
    df = spark.createDataFrame(items, "unit string, kind string, main_box string, boxes array<string>, k int, ref string"), spark.createDataFrame(outputs, "boxes array<string>, reading string")
    strict = {r.kind: tuple(r)[1:] for r in E.merged_scores(*df, ["match", "split"]).collect()}
    assert strict == {"match": (3, 1, 1), "split": (1, 1, 0), "merge": (2, 0, 0)}
    assert {r.kind: r.right for r in E.merged_scores(*df, ["match", "split", "merge"]).collect()}["merge"] == 2


def test_structural_checks(spark):
    names = "id string, category string, unicode array<string>, confidence string, confusables array<string>, same_shape_as string, sources array<string>, labels map<string,string>"
    good = ("P", "consonant", ["U+1BC02"], "high", ["B"], None, ["key p. 2", "(note)"], {"x": "VERIFIED by y"})
    rows = [good, ("B", "vowel", None, "med", None, "P", ["key"], None), ("B", "thing", ["x", "U+1bc02"], "sure", ["B", "Z"], "Q", ["other, 1"], {"x": "no", "y": None}), ("a b", "vowel", ["U+1BC0 and U+1BC05"], "low", [], None, [], {})]
    found = Counter((r.rule, r.id, r.detail) for r in V.sign_errors(spark.createDataFrame(rows, names), ["key"], required=["id", "unicode", "labels"]).collect())
    assert found == Counter(
        [
            ("duplicate id", "B", "2"), ("missing field", "B", "unicode"), ("missing field", "B", "labels"), ("bad id", "a b", "a b"), ("bad category", "B", "thing"), ("bad confidence", "B", "sure"),
            ("no code point", "B", "x"), ("malformed code point", "B", "U+1bc02"), ("confusable with itself", "B", "B"), ("confusable is no sign", "B", "Z"), ("same shape as no sign", "B", "Q"),
            ("unknown source", "B", "other, 1"), ("no sources", "a b", ""), ("label without status", "B", "x"), ("label without status", "B", "y"),
        ]
    )
    items = spark.createDataFrame([("S", ["U+1BC02 U+110000"], "VERIFIED", "high"), ("S", None, "?", "x")], "id string, unicode array<string>, label string, confidence string")
    found = {(r.rule, r.detail) for r in V.item_errors(items, ["id", "unicode"]).collect()}
    assert found == {("duplicate id", "2"), ("missing field", "unicode"), ("bad confidence", "x"), ("label without status", "?"), ("code point out of range", str(0x110000))}
    assert spark.range(1).select(V.code_points(F.array(F.lit("U+41 x U+1BC02"), F.lit(None), F.lit("U+0042")))).first()[0] == [0x1BC02, 0x42]


def test_inherited_fields_sides_and_subsets(spark):
    rows = spark.createDataFrame([(1, None, 5, "a"), (2, 1, None, "b"), (3, 9, None, "c")], "id int, copy_of int, width int, name string")
    assert sorted(tuple(r) for r in V.inherited(rows, "id", "copy_of", ["width"]).collect()) == [(1, None, 5, "a"), (2, 1, 5, "b"), (3, 9, None, "c")]
    words = spark.createDataFrame([(f"w{chr(97 + i)}", c) for i in range(20) for c in (None, "x")], "word string, copy_of string")
    out = W.sides(words, "word", "copy_of").collect()
    assert {r.split for r in out} == {"train", "test"} and all(r.copy_of is None for r in out if r.split == "test") and sum(r.split == "train" for r in out) % 2 == 0
    a, b = (spark.createDataFrame([(x,) for x in t], "v string") for t in ("cab", "ed"))
    assert [(r.list_no, r.v) for r in ordering.subset([a, b], ["v"]).orderBy("pos").collect()] == [(0, "a"), (0, "b"), (0, "c"), (1, "d"), (1, "e")]
    assert [r.v for r in ordering.subset([a, b], ["v"], spark.createDataFrame([(0,), (3,), (3,), (9,)], "pos long")).orderBy("pos").collect()] == ["a", "d"]


def test_first_glosses(spark):
    merged = spark.createDataFrame([("boat", ["ship", "vessel"]), ("dog", [])], "headword string, glosses array<string>")
    variants = spark.createDataFrame([("bote", "boat", 1)], "variant string, headword string, ord int")
    asked = spark.createDataFrame([("Boat",), ("bote",), ("dog",), ("none",), (None,)], "q string")
    assert {r.q: r.gloss for r in L.first_gloss(asked, merged, variants).collect()} == {"Boat": "ship", "bote": "ship", "dog": "", "none": "", None: ""}


def test_weighted_draws_follow_the_weights(spark):
    rows = spark.createDataFrame([(i, float(i % 5)) for i in range(40)] + [(99, None), (98, -1.0)], "id long, w double")
    n = 20_000
    drawn = Counter(r.id for r in ordering.weighted_sample(rows, "id", "w", n, 3).collect())
    total = sum(i % 5 for i in range(40))
    assert sum(drawn.values()) == n and not {i for i in drawn if i > 39 or i % 5 == 0}
    assert all(abs(drawn[i] / n - (i % 5) / total) < 0.01 for i in range(40))
    again = ordering.weighted_sample(rows.repartition(5), "id", "w", 50, 3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, ordering.weighted_sample(rows, "id", "w", 50, 3).collect()))
    assert ordering.weighted_sample(rows.limit(0), "id", "w", 5).collect() == []


def test_folds_keep_their_state_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rnd = random.Random(5)
        rows = [(k, i, rnd.choice("abcdefghijz"), float(rnd.randint(1, 40))) for k in ("x", "y", None) for i in range(100)]
        df = spark.createDataFrame(rows, "k string, i int, head string, w double")

        def count():
            n = 0

            def step(i):
                nonlocal n
                n += 1
                return n

            return step

        assert all(r.n == r.i + 1 for r in folds.folded(df, ["k"], ["i"], ["i"], "n", "int", count).collect())
        kept = Counter()
        for k in ("x", "y", None):
            recent = []
            for _, i, head, _ in (r for r in rows if r[0] == k):
                if all(a <= head for a in [min(recent)]) and ord(head) - ord(max(recent)) <= 4 if recent else True:
                    recent = (recent + [head])[-5:]
                    kept[k, i] += 1
        assert Counter((r.k, r.i) for r in sequences.in_alphabetical_order(df, ["k"], "i", "head").collect()) == kept
        for r in ordering.width_batches(df, ["k"], "i", "w", 4, 60).groupBy("k", "batch").agg(F.collect_list("i").alias("i")).collect():
            widths = [w for k, i, _, w in rows if k == r.k and i in r.i]
            assert len(widths) <= 4 and (len(widths) == 1 or len(widths) * max(widths) <= 60)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
