import difflib
import random

from lexloom.operators import similarity
from lexloom.plans import QUERIES
from lexloom.plans.tables import list_words


def test_every_word_of_a_long_list_counts(spark, tmp_path):
    rnd = random.Random(1)
    known = sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(5, 8))) for _ in range(25_000)})
    names = rnd.sample(known, 12)
    spark.createDataFrame([(" ".join(known[i : i + 500]),) for i in range(0, len(known), 500)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(" ".join(names),)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    words = sorted(r.word for r in list_words(spark, str(tmp_path)).collect())
    assert len(words) > 20_000
    got = {r.word: r.matches for r in QUERIES["close_matches"](spark, str(tmp_path)).collect()}
    assert got == {x: difflib.get_close_matches(x, words, 3, 0.5) for x in names}


def test_blocks_give_what_one_list_gives(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 9)))
    known, names = sorted({word() for _ in range(200)}), [*(word() for _ in range(60)), "", "zzz", "abc", "abc", None]
    a, b = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, name string"), spark.createDataFrame([(x,) for x in known], "word string")
    out = similarity.close_matches(a, b, "name", "word", block=17, name_block=11)
    assert out.columns == ["i", "name", "matches"]
    assert {r.i: (r.name, r.matches) for r in out.collect()} == {i: (x, difflib.get_close_matches(x, known, 3, 0.5) if x else []) for i, x in enumerate(names)}
    assert {tuple(r.matches) for r in similarity.close_matches(a, b.limit(0), "name", "word").collect()} == {()}
