"""The tables, and the relations that several queries derive from them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as Q
from ..functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, word): words of documents with a key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.explode(F.split("text", r"[ \t\r\n]+")).alias("word"))
    return docs.withColumn("key", X.word_key(F.col("word"))).where("key <> ''")


DOC_WORDS = f"""doc_words AS (
  SELECT * FROM (SELECT doc_id, lang, source, word, {Q.word_key("word")} AS key
    FROM (SELECT doc_id, lang, source, unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS word FROM documents)) WHERE key <> '')"""


def entries(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """Lines of documents as dictionary entries: the first word is the head, the rest is its gloss.

    (doc_id, source, source_no, line_no, ord, head, headword, gloss, conf, flagged); ord: order of sources, then of lines,
    as one number; a source, document or line number that has no room in it stops the run.
    conf: A for a document labelled good, C for one labelled bad, else B; unless labelled, always B, and no join.
    """
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = F.filter(F.split("line", r"[ \t\r]+"), lambda w: w != "")
    rows = lines.select("doc_id", "source", "line_no", words.alias("words")).where(F.size("words") >= 2)
    rows = rows.select("doc_id", "source", "line_no", F.col("words")[0].alias("head"), F.array_join(F.slice("words", F.lit(2), F.size("words")), " ").alias("gloss"))
    rows = rows.withColumn("headword", X.headword_key(F.col("head"))).where("headword <> ''")
    rows = rows.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left") if labelled else rows.withColumn("quality", F.lit(None).cast("int"))
    number = F.substring("source", 4, 10).cast("int")
    room = number.between(0, 31) & F.col("doc_id").between(0, 2**37 - 1) & (F.col("line_no") < 2**20)
    place = F.when(room, number * F.lit(2**57) + F.col("doc_id") * 2**20 + F.col("line_no")).when(~room, F.raise_error(F.lit("a number is too large for ord")).cast("bigint"))
    return rows.select(
        "doc_id", "source", number.alias("source_no"), "line_no", place.alias("ord"),
        "head", "headword", "gloss", F.when(F.col("quality") == 1, "A").when(F.col("quality") == 0, "C").otherwise("B").alias("conf"), (number % 4 == 0).alias("flagged"),
    )


ENTRIES = f"""entries AS (
  SELECT e.doc_id, source, source_no, line_no, source_no * 144115188075855872 + e.doc_id * 1048576 + line_no AS ord, head, headword, gloss,
    CASE quality WHEN 1 THEN 'A' WHEN 0 THEN 'C' ELSE 'B' END AS conf, source_no % 4 = 0 AS flagged
  FROM (SELECT doc_id, source, substr(source, 4)::INT AS source_no, line_no - 1 AS line_no, words[1] AS head, array_to_string(words[2:], ' ') AS gloss, {Q.headword_key("words[1]")} AS headword
    FROM (SELECT doc_id, source, line_no, list_filter(string_split_regex(line, '[ \\t\\r]+'), lambda w: w <> '') AS words
      FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents))
    WHERE len(words) >= 2) e LEFT JOIN labels l ON e.doc_id = l.doc_id WHERE headword <> '')"""


def list_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word): the distinct keys of at least 3 letters of the benchmark texts, a small reference list."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[ \t\r\n]+")).alias("w")).select(X.word_key(F.col("w")).alias("word"))
    return words.where(F.length("word") >= 3).distinct()


LIST_WORDS = f"""list_words AS (
  SELECT DISTINCT word FROM (SELECT {Q.word_key("w")} AS word FROM (SELECT unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS w FROM benchmark)) WHERE length(word) >= 3)"""


def name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word): the distinct words of part names."""
    return table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), r"\s+")).alias("word")).where("word <> ''").distinct()


NAME_WORDS = "name_words AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(p_name), '\\s+')) AS word FROM part) WHERE word <> '')"
