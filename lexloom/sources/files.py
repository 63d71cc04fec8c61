"""Readers of the file formats: word lists, annotations, readings, recognised text, packed crops, archives.

All paths go through Spark's readers, so any store that Spark reads will do. Schemas are explicit.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cell_list, confidence
from .writers import unpack_pages

LEXICON = "headword string, variants string, gloss_en string, gloss_fr string, pos string, source_key string, source_page string, kamloops string, notes string"
WORD_LIST = "headword string, best_conf string, tokens string, source string"
ALIGNMENT = "unit_id string, unit_kind string, main_box string, box_ids string, roman_tokens string, roman_printed string, roman_spelling string, roman_flag string, cause string, cause_detail string"
ANNOTATION = (
    "id string, source string, ia_item string, page_index int, language string, latin string, gloss_en string, tokens_rule string, tokens_verified string, reading_confidence string, reviewed_by string, notes string, "
    "crop_clean boolean, bbox_shorthand array<int>, bbox_latin array<int>, bbox_gloss array<int>, page_size array<int>, frame struct<deskew_deg:double,affine:array<double>,perspective:array<double>,size:array<int>,note:string>, "
    "copy_of string, seq int, para string, col int, line int, printed_page int"
)
READING = (
    "line int, index int, bbox array<int>, boxes array<string>, free_tokens string, free_roman string, free_models_agree boolean, confidence double, confidence_nonblank double, frames int, "
    "top5 array<struct<headword:string,also:array<string>,tokens:string,score:double,p_rel:double,kind:string,loss:double>>, free_best struct<tokens:string,roman:string,score:double>, n_pair_proposals int, best_word_score double"
)
READING_FILE = f"item string, leaf int, scale double, pair_penalty double, joins int, gap_max_px double, merge_rule string, words array<struct<{', '.join(':'.join(c.split(' ', 1)) for c in re.split(r', (?=[a-z_0-9]+ )', READING))}>>"
EVALUATION_FILE = "summary struct<n:int,models:array<string>,tta:array<double>,candidates:int,ter:double,exact:double,lexicon_top1:double,lexicon_top5:double>, rows array<struct<id:string,source:string,latin:string,ref:string,greedy:string,top5:array<string>,edits:int,len:int>>"
SIGNS_FIRST, SIGNS_LAST = 0x1BC00, 0x1BCA3


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated file with a header; quotes are letters like any other; missing cells are empty."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", escape="", enforceSchema=False).fillna("")


def tsv_columns(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """The wanted columns of a tab-separated file, whatever its others; one that it lacks is empty."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", escape="").fillna("")
    return rows.select(*(F.col(c) if c in rows.columns else F.lit("").alias(c) for c in wanted))


def lexicon(spark: SparkSession, path: str, min_conf: str = "B", sources: list[str] | None = None) -> DataFrame:
    """Word list entries graded min_conf or better, of some sources; variants as an array, the flag as a boolean."""
    rows = tsv(spark, path, LEXICON).withColumn("confidence", confidence(F.col("notes"))).where(F.col("confidence") <= min_conf)
    if sources is not None:
        rows = rows.where(F.col("source_key").isin(sources))
    return rows.withColumn("variants", cell_list(F.col("variants"))).withColumn("kamloops", F.col("kamloops") == "yes")


def json_lines(spark: SparkSession, path: str, schema: str = ANNOTATION) -> DataFrame:
    """A row for each line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def alignment(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows, with ordinary quoting: a quote within quotes is doubled."""
    return spark.read.schema(ALIGNMENT).csv(path, sep="\t", header=True, escape='"').fillna("")


def readings(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """A row for each word of page files, with its book, leaf and file facts. one_line: each line of a file is a page, so that large files are split."""
    pages = spark.read.schema(READING_FILE).json(path, multiLine=not one_line).withColumn("file", F.input_file_name())
    return pages.select("file", "item", "leaf", "scale", "pair_penalty", "joins", F.inline("words"))


def evaluations(spark: SparkSession, path: str) -> DataFrame:
    """A row for each word of evaluation files."""
    files = spark.read.schema(EVALUATION_FILE).json(path, multiLine=True).withColumn("file", F.input_file_name())
    return files.select("file", F.inline("rows"))


def yaml_table(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The mapping under `key` of a YAML file as rows with its names in the first column. Such files are small by nature."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    entries = yaml.safe_load(text)[key]
    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]
    return spark.createDataFrame([(name, *(spec.get(c) for c in names[1:])) for name, spec in entries.items()], schema)


def _in_files(rows: DataFrame, name: str) -> DataFrame:
    """rows (file, block, ...) with their 0-based place in their file. Files are read in blocks, and a block's rows in their order; blocks are counted apart, so no task holds a file."""
    rows = rows.withColumn("__id", F.monotonically_increasing_id())
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("__id"))
    return rows.withColumn("__place", place).join(sizes.select("file", "block", before.alias("__before")), ["file", "block"]).withColumn(name, (F.col("__before") + F.col("__place") - 1).cast("int")).drop("__id", "__place", "__before", "block")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): lines of text files; a form feed ends a line, carriage returns are dropped, and after the last line feed there is no line."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.explode(F.split(F.translate("value", "\r", ""), "\f")).alias("line"))
    return _in_files(rows, "line_no").select("file", "line_no", "line")


def word_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, page_w, page_h, word_no, text, x0, ytop, x1, ybottom): words of recognised pages, numbered in their file from 0; coordinates are x0, ybottom, x1, ytop in the file."""
    schema = "_width int, _height int, HIDDENTEXT struct<PAGECOLUMN:array<struct<REGION:array<struct<PARAGRAPH:array<struct<LINE:array<struct<WORD:array<struct<_VALUE:string,_coords:string>>>>>>>>>>>, WORD array<struct<_VALUE:string,_coords:string>>"
    read = spark.read.format("xml").option("rowTag", "OBJECT").schema(schema).load(path)
    pages = _in_files(read.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")), "page")
    lines = F.flatten(F.flatten(F.flatten(F.transform("HIDDENTEXT.PAGECOLUMN", lambda c: F.transform(c["REGION"], lambda r: F.transform(r["PARAGRAPH"], lambda p: p["LINE"]))))))
    nested = F.flatten(F.transform(lines, lambda x: x["WORD"]))
    words = pages.select("file", "page", F.col("_width").alias("page_w"), F.col("_height").alias("page_h"), F.posexplode(F.coalesce("WORD", nested)).alias("word_no", "w"))
    at = F.split("w._coords", ",").cast("array<int>")
    return words.select("file", "page", "page_w", "page_h", "word_no", F.trim(F.col("w._VALUE")).alias("text"), at[0].alias("x0"), at[3].alias("ytop"), at[2].alias("x1"), at[1].alias("ybottom"))


def packed_crops(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, idx, box, h, w, pixels): the word images of packed pages, one row each."""
    return unpack_pages(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"), ["file"])


def archive_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(file, leaf, name, content): members of tar and zip files, numbered in the order of their names."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = [(n, z.read(n)) for n in sorted(z.namelist()) if n.endswith(suffix) and not n.endswith("/")]
                else:
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        members = sorted((m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile() and m.name.endswith(suffix))
                yield pd.DataFrame({"file": [file] * len(members), "leaf": range(len(members)), "name": [n for n, _ in members], "content": [c for _, c in members]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, "file string, leaf int, name string, content binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, md5, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def unverified(downloads: DataFrame, found: DataFrame) -> DataFrame:
    """Files of a ledger (file, md5) that are missing, or whose digest differs."""
    have = found.select(F.element_at(F.split("file", "/"), -1).alias("file"), F.col("md5").alias("have"))
    return downloads.join(have, "file", "left").where("NOT md5 <=> have")


def scan_leaves(pages: DataFrame, text: str) -> DataFrame:
    """pages with leaf, page_type and whether it is used, by patterns over the metadata text of a page."""
    get = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return pages.withColumns({"leaf": get(r'leafNum="(\d+)"').cast("int"), "page_type": get(r"<pageType>([^<]*)</pageType>"), "used": F.coalesce(get(r"<addToAccessFormats>([^<]*)</addToAccessFormats>") != "false", F.lit(True))})


#: What makes a file of an item one of a kind (fixed values).
FILE_KINDS = {"orig": "name LIKE '%_orig_jp2.tar'", "jp2": "name LIKE '%_jp2.zip'", "pdf": "format IN ('Text PDF', 'Image Container PDF') AND name LIKE '%.pdf'", "text": "name LIKE '%_djvu.txt'", "meta": "name LIKE '%_meta.xml' OR name LIKE '%_marc.xml'", "scandata": "name LIKE '%_scandata.xml'"}


def select_files(files: DataFrame, kinds: list[str]) -> DataFrame:
    """Files (item, name, format) of the wanted kinds, once each; items without originals give their processed images instead."""
    files = files.where("name NOT LIKE 'history/%'")
    out = None
    for order, kind in enumerate(kinds):
        hits = files.where(FILE_KINDS[kind])
        if kind == "orig":
            hits = hits.unionByName(files.where(FILE_KINDS["jp2"]).join(hits.select("item").distinct(), "item", "left_anti"))
        hits = hits.withColumn("kind_no", F.lit(order))
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("item", "name").agg(F.min("kind_no").alias("kind_no"), F.min("format").alias("format"))


def names_list(lines: DataFrame) -> DataFrame:
    """(code, name, notes) of a names list: a code and name, then its notes on lines that begin with a tab."""
    head = F.regexp_extract("line", r"^([0-9A-F]{4,6})\t", 1)
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("h", F.nullif(head, F.lit(""))).withColumn("code", F.last("h", ignorenulls=True).over(w)).where("code IS NOT NULL AND (h IS NOT NULL OR line LIKE '\t%')")
    note = F.when(F.col("h").isNull(), F.struct("line_no", F.trim(F.translate("line", "\t", " ")).alias("note")))
    found = rows.groupBy("file", "code").agg(F.max(F.when(F.col("h").isNotNull(), F.regexp_extract("line", r"^[0-9A-F]{4,6}\t(.*)$", 1))).alias("name"), F.array_sort(F.collect_list(note)).alias("n"))
    return found.select(F.conv("code", 16, 10).cast("int").alias("code"), "name", F.transform("n", lambda x: x["note"]).alias("notes"))


def key_codes(pages: DataFrame, html: str) -> DataFrame:
    """(code): the signs on the keys of a keyboard page."""
    caps = F.regexp_extract_all(html, F.lit(r'<span class="keycap[^"]*"[^>]*>([^<]*)</span>'), F.lit(1))
    data = F.regexp_extract_all(F.array_join(F.regexp_extract_all(html, F.lit('data-string="((?:&#x[0-9A-Fa-f]+;)+)"'), F.lit(1)), ""), F.lit("&#x([0-9A-Fa-f]+);"), F.lit(1))
    typed = F.transform(F.filter(F.split(F.array_join(caps, ""), ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "utf-32")), 16, 10).cast("int"))
    codes = pages.select(F.explode(F.concat(typed, F.transform(data, lambda x: F.conv(x, 16, 10).cast("int")))).alias("code"))
    return codes.where(F.col("code").between(SIGNS_FIRST, SIGNS_LAST)).distinct()


def heads_and_glosses(rows: DataFrame) -> DataFrame:
    """(headword, glosses): sources and glosses of each head, in the order of sources."""
    return rows.groupBy("headword").agg(F.array_sort(F.collect_list(F.struct("source_key", "gloss_en"))).alias("glosses"))


def book_and_leaf(file) -> tuple:
    """(book, leaf) columns of a `<book>_<leaf>_words...` path."""
    name = F.element_at(F.split(file, "/"), -1)
    return F.regexp_extract(name, r"^(.*)_\d+_[a-z]+\.", 1).alias("book"), F.regexp_extract(name, r"_(\d+)_[a-z]+\.", 1).cast("int").alias("leaf")


def number_ranges(spec) -> F.Column:
    """`15-18,130` as an array of numbers."""
    part = lambda p: F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.when(F.contains(p, F.lit("-")), F.split_part(p, F.lit("-"), F.lit(2))).otherwise(p).cast("int"))
    return F.flatten(F.transform(F.split(spec, ","), part))


def settings(spec) -> F.Column:
    """`K=v,...` as a map of doubles."""
    return F.transform_values(F.str_to_map(spec, F.lit(","), F.lit("=")), lambda _, v: v.cast("double"))
