"""Building a word list from the texts of dictionaries, and checking and scoring what was built."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dictionaries as B
from .operators import grading as G
from .session import checkpointed
from .sources import files, writers

MERGED_COLUMNS = ["headword", "n_sources", "sources", "kamloops", "best_conf", "variants", "gloss_en", "gloss_fr", "pos", "skeleton", "skeleton_siblings", "notes"]
#: How many values of a merged row are shown.
SHOWN = {"variants": 14, "gloss_en": 6, "gloss_fr": 3}


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of all books in a folder; the text of a book has the name of its source."""
    lines = files.text_lines(spark, f"{folder}/*.txt").withColumn("volume", F.regexp_extract("file", r"([^/]+)\.txt$", 1)).select("volume", "line_no", "line")
    parts = []
    for layout in B.LAYOUTS:
        own = lines.where(F.col("volume") == layout.source)
        parts.append(checkpointed(B.parse(own, layout)))
        if layout.source == B.SUPPLEMENT.source:
            last = parts[-1].where("page <> ''").agg(F.max_by("page", "ord")).first()[0]
            parts.append(B.parse(own, B.SUPPLEMENT, int(last) if last else None))
    return reduce(DataFrame.unionByName, parts)


def graded(rows: DataFrame, sources: list[str]) -> DataFrame:
    """rows by source with conf: A where another source has the headword or its sound, B where it is well formed, else C."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source")).cast("int")
    entries = rows.withColumns({"id": F.concat_ws("|", "source", "headword"), "head": F.coalesce(F.get("variants", F.lit(0)), F.col("headword")), "gloss": F.col("gloss_en"), "ord": F.struct(place, "headword")})
    found = G.grade_clean(entries.select("id", "source", "headword", "head", "gloss", "ord"))
    return rows.join(found.select("source", "headword", "conf", "nearest", "via"), ["source", "headword"])


def build(spark: SparkSession, folder: str, out: str, flagged: list[str] | None = None) -> DataFrame:
    """Writes lexicon and merged as tab-separated files into `out`; returns (key, n): the number of rows of each source."""
    flagged = flagged or []
    sources = [layout.source for layout in B.LAYOUTS]
    rows = checkpointed(graded(B.rows_by_source(records(spark, folder)), sources))
    notes = F.map_concat("notes", F.create_map(F.lit("conf"), "conf", F.lit("near"), F.when(F.col("conf") != "A", F.col("nearest")).otherwise(F.lit(None))))
    writers.lexicon(rows.select("headword", "variants", "gloss_en", "gloss_fr", "pos", F.col("source").alias("source_key"), F.col("page").alias("source_page"), F.col("source").isin(flagged).alias("kamloops"), notes.alias("notes")), f"{out}/lexicon", sources)
    writers.merged(B.merged(rows, {s: i for i, s in enumerate(sources)}, flagged, SHOWN), f"{out}/lexicon_merged", MERGED_COLUMNS)
    return rows.groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n"))


def too_few(spark: SparkSession, counts: DataFrame, least: dict[str, int]) -> list[str]:
    """What sources lack, as text."""
    expected = spark.createDataFrame(list(least.items()), "key string, least long")
    return [f"{r.key}: {r.n} rows, {r.least} expected" for r in G.expectations(counts, expected).orderBy("key").collect()]
