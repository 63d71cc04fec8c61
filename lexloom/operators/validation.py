"""Structural checks of nested tables: every rule is a filter over columns, and what it finds is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CATEGORIES = ["consonant", "vowel", "diphthong", "diacritic", "punctuation", "numeral", "logogram", "abbreviation"]
CONFIDENCE = ["high", "med", "low"]
STATUS = ["VERIFIED", "COMPUTED", "INFERRED", "UNVERIFIED"]
SIGN_REQUIRED = ["id", "category", "unicode", "unicode_name", "chinook_value", "lejeune_latin", "stroke", "joining", "confusables", "sources", "confidence", "notes"]
ITEM_REQUIRED = ["id", "kind", "chinook", "expansion", "construction", "unicode", "label", "sources", "confidence", "notes"]
CODE_POINT = "U\\+[0-9A-F]{4,6}"


def code_points(values: Column) -> Column:
    """The numbers of all `U+...` in an array of strings, in order."""
    found = F.flatten(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.regexp_extract_all(v, F.lit("U\\+([0-9A-F]{4,6})"), F.lit(1))))
    return F.transform(found, lambda x: F.conv(x, 16, 10).cast("int"))


def _each(rows: DataFrame, rule: str, values: Column) -> DataFrame:
    """(rule, id, detail): a row for each value."""
    return rows.select(F.lit(rule).alias("rule"), F.col("id"), F.explode(values.cast("array<string>")).alias("detail"))


def _bad(rows: DataFrame, rule: str, condition: Column, detail: Column) -> DataFrame:
    return rows.where(F.coalesce(condition, F.lit(True))).select(F.lit(rule).alias("rule"), F.col("id"), detail.cast("string").alias("detail"))


def sign_errors(signs: DataFrame, source_keys: list[str], categories: list[str] = CATEGORIES, required: list[str] = SIGN_REQUIRED, confidence: list[str] = CONFIDENCE, status: list[str] = STATUS) -> DataFrame:
    """(rule, id, detail): what is wrong with signs (id, category, unicode, confidence, confusables, same_shape_as, sources, labels).

    Duplicate and malformed ids, missing fields, unknown categories and grades, entries without or with malformed code
    points, references to signs that aren't there or to itself, no sources or ones that begin with no known key (notes
    in parentheses don't count), labels without a status. References are anti-joins, so no list of ids is sent anywhere.
    """
    array = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    marks = lambda v: F.regexp_extract_all(v, F.lit("U\\+[0-9A-Fa-f]+"), F.lit(0))
    head = lambda v: F.split(v, "[ ,;:(]", 2)[0]
    told = F.filter(array("sources"), lambda v: ~F.startswith(v, F.lit("(")))
    labels = F.coalesce(F.map_entries("labels"), F.array().cast("array<struct<key:string,value:string>>"))
    found = [
        signs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate id").alias("rule"), "id", F.col("n").cast("string").alias("detail")),
        _each(signs, "missing field", F.filter(F.array(*(F.when(F.col(c).isNull(), c) for c in required)), lambda x: x.isNotNull())),
        _bad(signs, "bad id", ~F.col("id").rlike("^[A-Za-z0-9_]+\\z"), F.col("id")),
        _bad(signs, "bad category", ~F.col("category").isin(categories), F.col("category")),
        _bad(signs, "bad confidence", ~F.col("confidence").isin(confidence), F.col("confidence")),
        _each(signs, "no code point", F.filter(array("unicode"), lambda v: F.size(marks(v)) == 0)),
        _each(signs, "malformed code point", F.filter(F.flatten(F.transform(array("unicode"), marks)), lambda t: ~t.rlike(f"^{CODE_POINT}\\z"))),
        _each(signs, "confusable with itself", F.filter(array("confusables"), lambda v: v == F.col("id"))),
        _bad(signs, "no sources", F.size(array("sources")) == 0, F.lit("")),
        _each(signs, "unknown source", F.filter(told, lambda v: ~head(v).isin(source_keys) if source_keys else F.lit(False))),
        _each(signs, "label without status", F.transform(F.filter(labels, lambda e: ~F.coalesce(e["value"], F.lit("")).rlike("|".join(status))), lambda e: e["key"])),
    ]
    known = signs.select(F.col("id").alias("detail")).distinct()
    for rule, values in (("confusable is no sign", array("confusables")), ("same shape as no sign", F.filter(F.array("same_shape_as"), lambda v: v.isNotNull()))):
        found.append(_each(signs, rule, values).join(known, "detail", "left_anti").select("rule", "id", "detail"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def item_errors(items: DataFrame, required: list[str] = ITEM_REQUIRED, confidence: list[str] = CONFIDENCE, status: list[str] = STATUS) -> DataFrame:
    """(rule, id, detail): what is wrong with abbreviations (id, unicode, label, confidence, ...)."""
    points = code_points(F.coalesce(F.col("unicode"), F.array().cast("array<string>")))
    found = [
        items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate id").alias("rule"), "id", F.col("n").cast("string").alias("detail")),
        _each(items, "missing field", F.filter(F.array(*(F.when(F.col(c).isNull(), c) for c in required)), lambda x: x.isNotNull())),
        _bad(items, "bad confidence", ~F.col("confidence").isin(confidence), F.col("confidence")),
        _bad(items, "label without status", ~F.col("label").rlike("|".join(status)), F.col("label")),
        _each(items, "code point out of range", F.filter(points, lambda x: ~x.between(1, 0x10FFFF))),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def inherited(rows: DataFrame, id_col: str, copy_of: str, columns: list[str]) -> DataFrame:
    """rows whose columns, where null, are those of the row that they are a copy of."""
    original = rows.select(F.col(id_col).alias(copy_of), *(F.col(c).alias(f"__{c}") for c in columns))
    return rows.join(original, copy_of, "left").select(*(F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))
