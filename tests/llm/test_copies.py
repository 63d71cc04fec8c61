from collections import Counter

import corpus_pipeline

TEXTS = [" ".join(f"{w}{i}" for w in ("anna", "boat", "cold", "dune", "echo", "farm", "gold", "hill")) for i in range(6)]


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.without_copies(spark, docs, "").collect())


def test_texts_without_an_id_stay_each(spark):
    a, b, c, d, *_ = TEXTS
    rows = [(None, a, "x"), (None, b, "x"), (None, c, "x"), (None, c, "w"), (7, d, "x"), (None, d, "x"), (None, None, "x"), (None, "", "w")]
    got = kept(spark, rows)
    assert sum(got.values()) == 5 and (7, d, "x") in got and (None, d, "x") not in got
    assert {x for x in got if x[1] in (a, b, c)} == {(None, a, "x"), (None, b, "x"), (None, c, "w")}
    assert len([x for x in got if not x[1]]) == 1


def test_texts_of_one_id_stay_each(spark):
    a, b, c, d, e, f = TEXTS
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "x"), (3, a, "x"), (1, b, "w"), (4, c, "x"), (5, c, "x"), (5, d, "x"), (5, d, "x"), (None, e, None), (6, e, "x"), (6, f, "x")]
    assert kept(spark, rows) == Counter([(1, a, "x"), (1, b, "w"), (4, c, "x"), (5, d, "x"), (6, e, "x"), (6, f, "x")])


def test_no_repeats(spark):
    a, b, *_ = TEXTS
    assert kept(spark, [(1, a, "x"), (2, a, "x"), (3, b, None)]) == Counter([(1, a, "x"), (3, b, None)])
