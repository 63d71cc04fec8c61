"""The corpus pipeline: language ID, quality rules, near-duplicates, packing. Part of the subpackage llm.

run(spark, sf_dir) applies STAGES to the table `documents`; each stage's rows are written as Parquet into the folder
that the cluster shares and read again as the next one's documents, so that a lost executor costs one stage at most.
All stages but the last return the columns of the documents that they keep.

Defined results: a null or empty text, or one without a letter, is rejected by the first stage, one of under ten words
by the second; a null language, source or id rejects nothing; of equal texts, and of rows that repeat, one row stays,
that with the smallest id (null last), then the least text key, then the first row as JSON; texts of any length are
read whole; other columns, whatever their names and types, go with their rows; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import language_id, packing, quality_rules, simhash
from lexloom.llm.common import checkpointed, shared_folder, table

#: Bits in which fingerprints of near-duplicates may differ: with 59 of 64 equal, texts differ in a few words of a hundred.
NEAR_BITS = 5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or of no known language."""
    return language_id.known(docs, language_id.fit(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or hold mostly boilerplate."""
    return quality_rules.good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def _text_keys(text: str) -> list[Column]:
    """128 bits of a text, as two numbers."""
    return [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(1), text).alias("__h2")]


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the smallest doc_id, null last.

    Fingerprints are those of op9 and link at NEAR_BITS. A document is told by its id and its text, so that ids may be null or repeat: rows with both in common are in one
    group. Of texts that share the smallest id the one with the smallest key stays, of rows that share both the least row.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *_text_keys("text"))
    found = simhash.near_duplicates(docs.select(key.alias("document"), "text"), id_col="document", bits=NEAR_BITS)
    # the name of a group is the key of one of its documents; only such keys are counted, no texts
    named = found.where(F.col("document").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.count("*").alias("n"))
    first = checkpointed(named.select("component_id.*", "n"))
    names, own = ["doc_id", "__h1", "__h2"], docs.select("*", *_text_keys("text"))
    same = lambda other: [own["doc_id"].eqNullSafe(other["doc_id"]), own["__h1"] == other["__h1"], own["__h2"] == other["__h2"]]
    once, twice = first.where("n = 1"), first.where("n > 1")
    kept = own.join(once, same(once), "left_semi").select(*docs.columns)
    if twice.isEmpty():
        return kept
    row = F.struct(*docs.columns)
    least = own.join(twice, same(twice), "left_semi").groupBy(*names).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.unionAll(least.select("row.*").select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the documents that are left."""
    return packing.pack(packing.items_of(docs))


STAGES = [
    ("language id", known_language),
    ("quality rules", good_quality),
    ("near-duplicates", without_copies),
    ("packing", packed),
]

#: No stage but the base rules can be told in SQL; tests/llm/test_models.py holds run() against a brute-force version.
ORACLE_SQL = None


def _removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store the cluster shares."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's rows are deleted when the next one's are written; the last one's stay."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _removed(spark, f"{folder}/{k - 1}")
    return docs
