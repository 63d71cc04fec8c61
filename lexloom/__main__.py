"""Command line: build a word list, look words up in one, spell them, score readings, check signs, or run a query.

    python -m lexloom build --texts FOLDER --out FOLDER [--flagged SOURCE...] [--least SOURCE=N...]   (ends with 2 if a source has too few rows)
    python -m lexloom score --rows FILE --keys FILE --readings FILE --lexicon FILE [--language L]
    python -m lexloom check --signs FILE   (a JSON line for each sign; ends with 1 if anything is wrong)
    python -m lexloom lookup WORD... --lexicon FILE [--fuzzy N] [--flagged]
    python -m lexloom spell WORD...
    python -m lexloom query NAME --tables FOLDER [--out FOLDER]
    python -m lexloom queries
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .session import checkpointed


def entries_of(spark: SparkSession, path: str):
    """A word list as entries for merging."""
    from .functions.text import headword_key
    from .sources.files import lexicon

    rows = lexicon(spark, path).withColumn("ord", F.monotonically_increasing_id())
    return rows.select(headword_key(F.col("headword")).alias("headword"), F.col("headword").alias("head"), F.col("gloss_en").alias("gloss"), F.col("source_key").alias("source"), F.col("confidence").alias("conf"), F.col("kamloops").alias("flagged"), "variants", "ord")


def lookup(spark: SparkSession, words: list[str], path: str, max_dist: int | None = None, flagged: bool | None = None):
    """(q, headword, distance, glosses): exact or variant hits, and near ones for words without a hit or if max_dist is given."""
    from .operators.lexicon import fuzzy, merge
    from .operators.lexicon import lookup as exact

    rows = entries_of(spark, path)
    merged = merge(rows)
    asked = spark.createDataFrame([(w,) for w in words], "q string").distinct()
    listed = rows.select(F.explode("variants").alias("variant"), "headword", "ord")
    hits = exact(asked, merged, listed)
    found = hits.where("headword IS NOT NULL").select("q", "headword", F.lit(0).alias("distance"))
    rest = asked if max_dist is not None else hits.where("headword IS NULL").select("q")
    near = fuzzy(rest, merged, 2 if max_dist is None else max_dist, flagged=flagged).select("q", "headword", "distance")
    both = found.unionByName(near).groupBy("q", "headword").agg(F.min("distance").alias("distance"))
    return both.join(merged.select("headword", "glosses", "sources"), "headword").orderBy("q", "distance", "headword")


def score(spark: SparkSession, rows: str, keys: str, pages: str, lexicon: str, language: str):
    """Scores of the readings in page files against annotated rows. keys: JSON lines (id, page, line)."""
    from .operators.evaluation import ground_truth_scores
    from .operators.wordlist import candidates
    from .sources import files

    words = files.tsv_columns(spark, lexicon, ["headword", "best_conf", "tokens"])
    known = candidates(words.select("headword", F.coalesce(F.nullif("best_conf", F.lit("")), F.lit("A")).alias("conf"), "tokens", F.col("headword").alias("ord")))
    read = files.readings(spark, pages).select(F.col("leaf").alias("page"), "line", F.col("top5.tokens").alias("top"), F.col("free_tokens").alias("free"), F.col("free_best.tokens").alias("free_best"))
    return ground_truth_scores(files.json_lines(spark, rows), spark.read.schema("id string, page int, line int").json(keys), read, known.select("tokens"), language)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("build")
    one.add_argument("--texts", required=True)
    one.add_argument("--out", required=True)
    one.add_argument("--flagged", nargs="*", default=[])
    one.add_argument("--least", nargs="*", default=[])
    one = commands.add_parser("score")
    for name in ("rows", "keys", "readings", "lexicon"):
        one.add_argument(f"--{name}", required=True)
    one.add_argument("--language", default="chn")
    one = commands.add_parser("check")
    one.add_argument("--signs", required=True)
    one.add_argument("--sources", nargs="*", default=[])
    one = commands.add_parser("lookup")
    one.add_argument("words", nargs="+")
    one.add_argument("--lexicon", required=True)
    one.add_argument("--fuzzy", type=int)
    one.add_argument("--flagged", action="store_true", default=None)
    one = commands.add_parser("spell")
    one.add_argument("words", nargs="+")
    one = commands.add_parser("query")
    one.add_argument("name")
    one.add_argument("--tables", required=True)
    one.add_argument("--out")
    commands.add_parser("queries")
    a = parser.parse_args(args)
    from .plans import QUERIES

    if a.command == "queries":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.appName("lexloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "build":
        from .build import build, too_few

        counts = build(spark, a.texts, a.out, a.flagged)
        counts.orderBy("key").show(100, truncate=False)
        lacking = too_few(spark, counts, {k: int(v) for k, v in (x.split("=") for x in a.least)}) if a.least else []
        print("\n".join(lacking), end="\n" if lacking else "")
        return 2 if lacking else 0
    if a.command == "score":
        score(spark, a.rows, a.keys, a.readings, a.lexicon, a.language).show(truncate=False)
    elif a.command == "check":
        from .operators.validation import sign_errors

        names = "id string, category string, unicode array<string>, unicode_name string, chinook_value string, lejeune_latin string, stroke string, joining string, confusables array<string>, same_shape_as string, sources array<string>, confidence string, notes string, labels map<string,string>"
        wrong = checkpointed(sign_errors(spark.read.schema(names).json(a.signs), a.sources))
        wrong.orderBy("rule", "id").show(1_000, truncate=False)
        return 0 if wrong.isEmpty() else 1
    elif a.command == "lookup":
        lookup(spark, a.words, a.lexicon, a.fuzzy, a.flagged).show(100, truncate=False)
    elif a.command == "spell":
        from .functions.tokens import spell

        words = spark.createDataFrame([(w,) for w in a.words], "word string")
        words.select("word", F.array_join(spell(F.col("word")), " ").alias("tokens")).show(len(a.words), truncate=False)
    elif a.out:
        QUERIES[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)
    else:
        QUERIES[a.name](spark, a.tables).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
