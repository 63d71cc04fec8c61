"""Queries that write files into the shared folder and read them again, and streams over files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import files as R
from ..sources import writers as W
from ..streaming import events as S
from .registry import query
from .tables import ENTRIES, entries, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("tsv_round_trip", f"WITH {ENTRIES} SELECT headword, source AS source_key, count(*) AS n, sum(length(replace(gloss, chr(92), '/'))) AS n_letters FROM entries WHERE conf <= 'B' GROUP BY headword, source")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as a word list and loaded again with its grade filter."""
    path = _folder(spark, "lexicon")
    rows = entries(spark, sf_dir).select(
        "headword", F.array("head").alias("variants"), F.col("gloss").alias("gloss_en"), F.lit("").alias("gloss_fr"), F.lit("").alias("pos"), F.col("source").alias("source_key"),
        F.col("line_no").cast("string").alias("source_page"), F.col("flagged").alias("kamloops"), F.create_map(F.lit("conf"), "conf").alias("notes"),
    )
    W.lexicon(rows, path, [f"src{i}" for i in range(20)])
    return R.lexicon(spark, path).groupBy("headword", "source_key").agg(F.count("*").alias("n"), F.sum(F.length("gloss_en")).alias("n_letters"))


@query("json_round_trip", "SELECT conv_id, count(*) AS n_words, sum(turn) AS turns, md5(string_agg(turn || role || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested page files by leaf, read again as one row for each word."""
    path = _folder(spark, "pages")
    word = F.struct(F.col("turn").cast("int").alias("line"), F.lit(1).alias("index"), F.col("text").alias("free_tokens"), F.col("role").alias("free_roman"))
    pages = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 10).alias("part"), F.col("conv_id").cast("int").alias("leaf")).agg(F.array_sort(F.collect_list(word)).alias("words"))
    W.json_pages(pages.withColumn("item", F.lit("book")), path, ["part"])
    rows = R.readings(spark, path, one_line=True).groupBy(F.col("leaf").cast("bigint").alias("conv_id"))
    told = F.array_sort(F.collect_list(F.struct("line", F.concat(F.col("line").cast("string"), "free_roman", "free_tokens").alias("t"))))
    return rows.agg(F.count("*").alias("n_words"), F.sum(F.col("line").cast("bigint")).alias("turns"), F.md5(F.array_join(F.transform(told, lambda x: x["t"]), "\n")).alias("digest"))


@query("text_line_scan", "SELECT count(*) AS n_lines, count_if(line = '') AS n_empty, sum(length(line)) AS n_letters FROM (SELECT unnest(string_split(replace(text, chr(12), chr(10)), chr(10))) AS line FROM documents)")
def text_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files and read as numbered lines."""
    path = _folder(spark, "text")
    table(spark, sf_dir, "documents").select(F.col("text").alias("value")).write.text(path)
    lines = R.text_lines(spark, path)
    # a file's lines are numbered without a gap
    ends = lines.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("line") == "").alias("e"), F.sum(F.length("line")).alias("c"), (F.max("line_no") - F.min("line_no") + 1).alias("span"), F.min("line_no").alias("first"))
    return ends.where("span = n AND first = 0").agg(F.sum("n").alias("n_lines"), F.sum("e").alias("n_empty"), F.sum("c").alias("n_letters"))


@query("packed_crop_round_trip", "WITH p AS (SELECT label, list_transform(embedding, lambda x: least(greatest(trunc((x + 1) * 127), 0), 255)::BIGINT) AS px FROM embeddings) SELECT label, count(*) AS n, sum(len(px)) AS n_pixels, sum(list_sum(list_transform(px, lambda v, i: v * i))) AS checksum FROM p GROUP BY label")
def packed_crop_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 by 8 images, packed into a page for each label and hundred, and unpacked."""
    rows = table(spark, sf_dir, "embeddings")
    single = lambda n: F.lit(n).cast("float")  # noqa: E731  # with integers Spark reckons in double precision, which rounds otherwise at the borders of pixel values
    pixel = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest((x + single(1)) * single(127), single(0)), single(255)).cast("int")), 2, "0"))
    crops = rows.select("label", F.floor(F.col("vec_id") / 100).alias("part"), F.lit(1).alias("line"), F.col("vec_id").cast("int").alias("idx"), F.array(*(F.lit(x) for x in (0, 0, 8, 8))).alias("box"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(F.array_join(pixel, "")).alias("pixels"))
    unpacked = W.unpack_pages(W.packed_pages(crops, ["label", "part"]), ["label", "part"])
    values = F.transform(F.sequence(F.lit(1), F.length("pixels")), lambda i: F.conv(F.hex(F.substring("pixels", i, F.lit(1))), 16, 10).cast("bigint") * i)
    return unpacked.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("pixels").cast("bigint")).alias("n_pixels"), F.sum(F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)).alias("checksum"))


@query("alignment_round_trip", "SELECT l_orderkey::VARCHAR AS unit_id, CASE WHEN count(*) = 1 THEN 'match' ELSE 'merge' END AS unit_kind, string_agg('1.' || l_linenumber, '+' ORDER BY l_linenumber) AS box_ids, min(l_linestatus) AS roman_tokens FROM lineitem GROUP BY l_orderkey")
def alignment_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as alignment rows, written with ordinary quoting and read again."""
    path = _folder(spark, "alignment")
    boxes = F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: F.concat(F.lit("1."), n.cast("string"))), "+")
    units = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("unit_id")).agg(F.when(F.count("*") == 1, "match").otherwise("merge").alias("unit_kind"), F.lit("1.1").alias("main_box"), boxes.alias("box_ids"), F.min("l_linestatus").alias("roman_tokens"))
    blank = [c.split(" ")[0] for c in R.ALIGNMENT.split(", ")]
    units.select(*(F.col(c) if c in units.columns else F.lit('a "b"\tc').alias(c) for c in blank)).write.csv(path, sep="\t", header=True, escape='"')
    rows = R.alignment(spark, path)
    return rows.where(F.col("cause") == 'a "b"\tc').select("unit_id", "unit_kind", "box_ids", "roman_tokens")


@query("annotation_round_trip", "SELECT page_id::VARCHAR AS id, url AS latin, length(html) AS n, [1, length(url)] AS size FROM pages")
def annotation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as annotations in JSON lines, with nested frames, read by the schema."""
    path = _folder(spark, "annotations")
    frame = F.struct(F.array(F.lit(1), F.length("url")).alias("size"), F.col("html").alias("note"))
    W.append_lines(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("latin"), frame.alias("frame")), path)
    return R.json_lines(spark, path).select("id", "latin", F.length("frame.note").alias("n"), F.col("frame.size").alias("size"))


@query("word_list_round_trip", f"WITH {ENTRIES}, g AS (SELECT headword, min(conf) AS best_conf FROM entries GROUP BY headword) SELECT headword, best_conf, '' AS absent FROM g WHERE best_conf <= 'B'")
def word_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headwords written as a sorted list and read by the names of its columns; one that it lacks is empty."""
    path = _folder(spark, "words")
    rows = entries(spark, sf_dir).groupBy("headword").agg(F.min("conf").alias("best_conf")).where("best_conf <= 'B'")
    W.tsv(rows.withColumn("extra", F.lit("x\ty")), path, ["headword"], ["extra", "headword", "best_conf"])
    return R.tsv_columns(spark, path, ["headword", "best_conf", "absent"])


_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read_files(spark, sf_dir, "events.parquet", _SCHEMA)
    return rows.withColumn("at", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")))


@query("stream_windows", "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by event type, as a stream over the files that are there."""
    counts = S.window_counts(_stream(spark, sf_dir), "at", ["event_type"], "1 day")
    return S.run_to_end(counts, _folder(spark, "windows")).select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("stream_sessions", "WITH g AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT user_id, us, sum(CASE WHEN gap >= 36000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(us) AS start_us, count(*) AS n FROM s GROUP BY user_id, s")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps under ten hours, as a stream."""
    found = S.gap_sessions(_stream(spark, sf_dir), "at", ["user_id"], "10 hours")
    return S.run_to_end(found, _folder(spark, "sessions")).select("user_id", F.unix_micros("start").alias("start_us"), "n")
