"""Queries over dictionary entries: lines of documents are printed as pages of a book and parsed, and made rows of a lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as Q
from ..functions.text import word_key
from ..operators import dictionaries as B
from .registry import query
from .tables import ENTRIES, entries

_PLAIN = f"array_to_string(list_filter(list_transform(string_split(gloss, ' '), lambda w: {Q.word_key('w')}), lambda w: w <> ''), ' ')"


@query(
    "dictionary_lines",
    f"""WITH {ENTRIES}, w AS (SELECT source, headword, trim('Word ' || {_PLAIN}) AS g FROM entries WHERE regexp_full_match(headword, '[a-z]{{2,}}')), c AS (SELECT *, CASE WHEN length(g) > 240 THEN regexp_extract(left(g, 240), '^(.*) [^ ]*$', 1) || ' ...' ELSE g END AS gloss FROM w)
    SELECT source, upper(left(headword, 1)) || substr(headword, 2) AS head, 2 AS n_spellings, 'n,v' AS pos, gloss, '1' AS page, count(*) AS n FROM c GROUP BY ALL""",
)
def dictionary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries printed on two lines each, as in the book of 1863, one volume for each source, and parsed again."""
    rows = entries(spark, sf_dir).where(F.col("headword").rlike("^[a-z]{2,}$"))
    plain = F.array_join(F.filter(F.transform(F.split("gloss", " "), word_key), lambda w: w != ""), " ")
    printed = F.array(F.struct((F.col("ord") * 2).alias("line_no"), F.concat(F.initcap("headword"), F.lit(", or Other, n. v.")).alias("line")), F.struct((F.col("ord") * 2 + 1).alias("line_no"), F.concat(F.lit("Word "), plain).alias("line")))
    pages = rows.select(F.col("source").alias("volume"), F.inline(printed))
    around = F.array(F.struct(F.lit(-1).cast("bigint").alias("line_no"), F.lit("PART I. CHINOOK-ENGLISH.").alias("line")), F.struct(F.lit(2**63 - 1).alias("line_no"), F.lit("ENGLISH-CHINOOK.").alias("line")))
    volumes = rows.select(F.col("source").alias("volume")).distinct().select("volume", F.inline(around))
    found = B.parse(pages.unionByName(volumes), next(x for x in B.LAYOUTS if x.source == "gibbs1863"))
    told = found.select(F.col("ord.volume").alias("source"), "head", F.size("variants").alias("n_spellings"), "pos", F.col("gloss_en").alias("gloss"), "page")
    return told.groupBy(*told.columns).agg(F.count("*").alias("n"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as records: the gloss's first word is a variant, its first three words the French gloss."""
    rows = entries(spark, sf_dir)
    words = F.split("gloss", " ")
    pos = F.when(F.col("line_no") % 3 == 0, "n,v").when(F.col("line_no") % 3 == 1, "adj").otherwise("")
    page = F.when(F.col("line_no") > 0, F.col("line_no").cast("string")).otherwise("")
    notes = F.create_map(F.lit("conf"), F.col("conf"), F.lit("line"), page)
    return rows.select("source", "ord", "head", F.array(words[0]).alias("variants"), F.col("gloss").alias("gloss_en"), F.array_join(F.slice(words, 1, 3), " ").alias("gloss_fr"), pos.alias("pos"), page.alias("page"), notes.alias("notes"))


def _display(x: str) -> str:
    return f"trim(trim(regexp_replace(translate({x}, '’‘“”—–', {Q.quoted(chr(39) * 2 + chr(34) * 2 + '--')}), '\\s+', ' ', 'g')), {Q.quoted(' .,;:-' + chr(39) + chr(34) + '*')})"


_RECORDS = f"""{ENTRIES}, rc AS (SELECT source, ord, {_display("head")} AS head, {_display("string_split(gloss, ' ')[1]")} AS other, trim(gloss) AS gloss_en, trim(array_to_string(string_split(gloss, ' ')[1:3], ' ')) AS gloss_fr,
    CASE line_no % 3 WHEN 0 THEN ['n', 'v'] WHEN 1 THEN ['adj'] ELSE [] END AS pos, CASE WHEN line_no > 0 THEN line_no::VARCHAR ELSE '' END AS page, conf FROM entries),
  rk AS (SELECT *, {Q.headword_key("head")} AS headword, {Q.headword_key("other")} AS other_key FROM rc),
  ok AS (SELECT * FROM rk WHERE length(replace(headword, ' ', '')) >= {B.LEAST_LETTERS} AND length(headword) <= {B.MOST_LETTERS} AND len(string_split(headword, ' ')) <= {B.MOST_WORDS}),
  it AS (SELECT source, headword, ord, 'variants' AS name, head AS value, head AS same, 0 AS place FROM ok UNION ALL SELECT source, headword, ord, 'variants', other, other, 1 FROM ok WHERE other_key <> ''
    UNION ALL SELECT source, headword, ord, 'gloss_en', gloss_en, lower(gloss_en), 0 FROM ok WHERE gloss_en <> '' UNION ALL SELECT source, headword, ord, 'gloss_fr', gloss_fr, lower(gloss_fr), 0 FROM ok WHERE gloss_fr <> ''
    UNION ALL SELECT source, headword, ord, 'pos', p, p, i FROM (SELECT *, unnest(pos) AS p, generate_subscripts(pos, 1) AS i FROM ok) UNION ALL SELECT source, headword, ord, 'page', page, 'page', 0 FROM ok WHERE page <> ''
    UNION ALL SELECT source, headword, ord, 'notes', conf, 'conf', 0 FROM ok UNION ALL SELECT source, headword, ord, 'notes', page, 'line', 0 FROM ok),
  fi AS (SELECT source, headword, name, same, min((ord, place, value)) AS f FROM it GROUP BY ALL),
  li AS (SELECT source, headword, name, list(f[3] ORDER BY f) AS v, list(same || '=' || f[3] ORDER BY same) AS kv FROM fi GROUP BY ALL),
  rs AS (SELECT source, headword, max(CASE WHEN name = 'variants' THEN v END) AS variants, coalesce(max(CASE WHEN name = 'gloss_en' THEN array_to_string(v, ' | ') END), '') AS gloss_en, coalesce(max(CASE WHEN name = 'gloss_fr' THEN array_to_string(v, ' | ') END), '') AS gloss_fr,
    coalesce(max(CASE WHEN name = 'pos' THEN array_to_string(v, ',') END), '') AS pos, coalesce(max(CASE WHEN name = 'page' THEN v[1] END), '') AS page, max(CASE WHEN name = 'notes' THEN array_to_string(kv, '; ') END) AS notes FROM li GROUP BY ALL)"""


@query("lexicon_rows", f"WITH {_RECORDS} SELECT source, headword, array_to_string(variants, '|') AS variants, gloss_en, gloss_fr, pos, page, notes, n_raw FROM rs JOIN (SELECT source, headword, count(*) AS n_raw FROM ok GROUP BY ALL) USING (source, headword)")
def lexicon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each source and headword of the records."""
    rows = B.rows_by_source(records(spark, sf_dir))
    notes = F.array_join(F.transform(F.array_sort(F.map_entries("notes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return rows.withColumn("variants", F.array_join("variants", "|")).withColumn("notes", notes)


_CAPS = {"variants": 14, "gloss_en": 6, "gloss_fr": 3}
_SOURCES = {f"src{i}": i for i in range(20)}
_FLAGGED = ["src0", "src4", "src8"]


def _shown(name: str, separator: str) -> str:
    return f"coalesce(max(CASE WHEN name = '{name}' THEN array_to_string(v[1:{_CAPS.get(name, 10**9)}], '{separator}') END), '') AS {name}"


@query(
    "lexicon_merged",
    f"""WITH {_RECORDS}, gr AS (SELECT rs.*, string_split(notes, ';')[1][6:] AS conf, source[4:]::INT AS seat FROM rs), gd AS (SELECT *, conf IN ('A', 'B') AS good, source IN ({", ".join(map(Q.quoted, _FLAGGED))}) AS own FROM gr),
    mi AS (SELECT headword, seat, 'variants' AS name, v AS value, v AS same, i AS place FROM (SELECT *, unnest(variants) AS v, generate_subscripts(variants, 1) AS i FROM gd)
      UNION ALL SELECT headword, seat, 'gloss_en', v, lower(v), i FROM (SELECT *, unnest(string_split(gloss_en, ' | ')) AS v, generate_subscripts(string_split(gloss_en, ' | '), 1) AS i FROM gd WHERE good) WHERE v <> ''
      UNION ALL SELECT headword, seat, 'gloss_fr', v, v, i FROM (SELECT *, unnest(string_split(gloss_fr, ' | ')) AS v, generate_subscripts(string_split(gloss_fr, ' | '), 1) AS i FROM gd WHERE good) WHERE v <> ''
      UNION ALL SELECT headword, seat, 'pos', v, v, i FROM (SELECT *, unnest(string_split(pos, ',')) AS v, generate_subscripts(string_split(pos, ','), 1) AS i FROM gd WHERE good) WHERE v <> ''
      UNION ALL SELECT headword, seat, CASE WHEN good THEN 'sources' ELSE 'weak' END, source, source, 0 FROM gd),
    mf AS (SELECT headword, name, same, min((seat, place, value)) AS f FROM mi GROUP BY ALL), ml AS (SELECT headword, name, list(f[3] ORDER BY f) AS v FROM mf GROUP BY ALL),
    mm AS (SELECT headword, {_shown("sources", "|")}, {_shown("weak", "/")}, {_shown("variants", "|")}, {_shown("gloss_en", " | ")}, {_shown("gloss_fr", " | ")}, {_shown("pos", ",")}, coalesce(max(CASE WHEN name = 'sources' THEN len(v) END), 0) AS n_sources FROM ml GROUP BY headword),
    mx AS (SELECT headword, min(conf) AS best_conf, bool_or(own AND good) AS flagged, bool_or(own AND NOT good) AS weak_flag FROM gd GROUP BY headword)
    SELECT headword, n_sources, sources, flagged, best_conf, variants, gloss_en, gloss_fr, pos, concat_ws('; ', CASE WHEN weak <> '' THEN 'unvalidated_candidates_in=' || weak END, CASE WHEN weak_flag AND NOT flagged THEN 'flagged_candidate_only' END) AS notes FROM mm JOIN mx USING (headword)""",
)
def lexicon_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each headword of the sources' rows, graded by their first entry."""
    rows = B.rows_by_source(records(spark, sf_dir)).withColumn("conf", F.element_at("notes", F.lit("conf")))
    return B.merged(rows, _SOURCES, _FLAGGED, _CAPS)
