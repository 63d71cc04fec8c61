"""Queries over word lists: merging, clusters, lookups, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as Q
from ..functions.text import headword_key
from ..operators import lexicon as L
from ..operators import similarity as S
from ..operators.ordering import positions
from .registry import query
from .tables import ENTRIES, LIST_WORDS, NAME_WORDS, entries, list_words, name_words, table


def _firsts(name: str, value: str, same: str | None = None, where: str = "true", keys: str = "headword") -> str:
    """A CTE of ordered distinct values by key."""
    return f"{name} AS (SELECT {keys}, list(v ORDER BY o) AS v FROM (SELECT {keys}, arg_min({value}, ord) AS v, min(ord) AS o FROM entries WHERE {value} <> '' AND {where} GROUP BY {keys}, {same or value}) GROUP BY {keys})"


@query(
    "merge_headwords",
    f"""WITH {ENTRIES}, {_firsts("v", "head", where="lower(head) <> headword")}, {_firsts("gl", "gloss")}, {_firsts("s", "source")}
    SELECT f.headword, flagged, best_conf, n_entries, coalesce(array_to_string(v.v, '|'), '') AS variants, coalesce(array_to_string(gl.v, '|'), '') AS glosses, coalesce(array_to_string(s.v, '|'), '') AS sources, len(s.v) AS n_sources
    FROM (SELECT headword, bool_or(flagged) AS flagged, min(conf) AS best_conf, count(*) AS n_entries FROM entries GROUP BY headword) f
    LEFT JOIN v USING (headword) LEFT JOIN gl USING (headword) LEFT JOIN s USING (headword)""",
)
def merge_headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = L.merge(entries(spark, sf_dir))
    return merged.select("headword", "flagged", "best_conf", "n_entries", "n_sources", *(F.array_join(c, "|").alias(c) for c in ("variants", "glosses", "sources")))


@query(
    "dedup_per_source",
    f"""WITH {ENTRIES}, {_firsts("sp", "head", keys="source, headword")}, {_firsts("gl", "gloss", "lower(gloss)", keys="source, headword")}
    SELECT source, headword, page, n_raw, array_to_string(sp.v, '|') AS spellings, array_to_string(gl.v, '|') AS glosses
    FROM (SELECT source, headword, arg_min(line_no, ord) AS page, count(*) AS n_raw FROM entries GROUP BY source, headword) LEFT JOIN sp USING (source, headword) LEFT JOIN gl USING (source, headword)""",
)
def dedup_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.dedup_by_source(entries(spark, sf_dir))
    return rows.select("source", "headword", "page", "n_raw", F.array_join("spellings", "|").alias("spellings"), F.array_join("glosses", "|").alias("glosses"))


_SKELETONS = f"heads AS (SELECT headword, {Q.collapsed('folded')} AS skeleton FROM (SELECT headword, {Q.folded('headword')} AS folded FROM (SELECT DISTINCT headword FROM entries)))"
_CLUSTERS = "clusters AS (SELECT skeleton, list(headword ORDER BY headword) AS members, count(*) AS n FROM {heads} WHERE NOT contains(headword, ' ') AND length(skeleton) >= 2 GROUP BY skeleton HAVING length(skeleton) >= 3 OR count(*) <= 8)"


@query("skeleton_clusters", f"WITH {ENTRIES}, {_SKELETONS}, {_CLUSTERS.format(heads='heads')} SELECT skeleton, n, array_to_string(members, '|') AS members FROM clusters")
def skeleton_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clusters(entries(spark, sf_dir)).select("skeleton", "n", F.array_join("members", "|").alias("members"))


@query(
    "merge_graded",
    f"""WITH {ENTRIES}, {_firsts("v", "head")}, {_firsts("gs", "source", where="conf <> 'C'")}, {_firsts("ws", "source", where="conf = 'C'")}, {_firsts("gl", "gloss", "lower(gloss)", "conf <> 'C'")},
    {_SKELETONS}, good AS (SELECT h.* FROM heads h WHERE headword IN (SELECT headword FROM entries WHERE conf <> 'C')), {_CLUSTERS.format(heads="good")},
    f AS (SELECT headword, min(conf) AS best_conf, bool_or(flagged AND conf <> 'C') AS flagged, bool_or(flagged AND conf = 'C') AS weak_flag FROM entries GROUP BY headword)
    SELECT headword, best_conf, flagged, coalesce(len(gs.v), 0) AS n_sources, coalesce(array_to_string(gs.v, '|'), '') AS sources, array_to_string(v.v[1:14], '|') AS variants, coalesce(array_to_string(gl.v[1:6], ' | '), '') AS gloss, skeleton,
      coalesce(array_to_string(list_filter(members, lambda m: m <> headword)[1:10], '|'), '') AS siblings,
      concat_ws('; ', CASE WHEN len(list_filter(ws.v, lambda x: NOT list_contains(coalesce(gs.v, []), x))) > 0 THEN 'unvalidated_candidates_in=' || array_to_string(list_filter(ws.v, lambda x: NOT list_contains(coalesce(gs.v, []), x)), '/') END, CASE WHEN weak_flag AND NOT flagged THEN 'flagged_candidate_only' END) AS notes
    FROM f JOIN v USING (headword) LEFT JOIN gs USING (headword) LEFT JOIN ws USING (headword) LEFT JOIN gl USING (headword) JOIN heads USING (headword) LEFT JOIN clusters USING (skeleton)""",
)
def merge_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merge_graded(entries(spark, sf_dir))


@query(
    "headwords_filter",
    f"WITH {ENTRIES} SELECT headword FROM entries GROUP BY headword HAVING count(DISTINCT source) >= 3 AND bool_or(flagged) AND bool_or(source = 'src0') AND NOT contains(headword, ' ')",
)
def headwords_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.headwords(L.merge(entries(spark, sf_dir)), flagged=True, min_sources=3, source="src0", single=True)


@query(
    "overlap_stats",
    f"""WITH {ENTRIES}, p AS (SELECT DISTINCT source, headword FROM entries), n AS (SELECT source, count(*) AS n FROM p GROUP BY source)
    SELECT x.source AS a, y.source AS b, any_value(na.n) AS n_a, any_value(nb.n) AS n_b, count(*) AS n_both FROM p x JOIN p y ON x.headword = y.headword AND x.source < y.source JOIN n na ON na.source = x.source JOIN n nb ON nb.source = y.source GROUP BY x.source, y.source""",
)
def overlap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.overlap(entries(spark, sf_dir))


@query("grade_counts", f"WITH {ENTRIES} SELECT source, count_if(conf = 'A') AS a, count_if(conf = 'B') AS b, count_if(conf = 'C') AS c, count(DISTINCT headword) AS n_heads FROM entries GROUP BY source")
def grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = [F.count_if(F.col("conf") == g).alias(g.lower()) for g in "ABC"]
    return entries(spark, sf_dir).groupBy("source").agg(*grades, F.count_distinct("headword").alias("n_heads"))


@query(
    "lookup_exact_variant",
    f"""WITH {ENTRIES}, {LIST_WORDS}, heads AS (SELECT headword FROM entries GROUP BY headword HAVING count(*) >= 2),
    listed AS (SELECT k, arg_min(headword, ord) AS headword FROM (SELECT {Q.headword_key("string_split(gloss, ' ')[1]")} AS k, headword, ord FROM entries WHERE headword IN (FROM heads)) WHERE k <> '' AND k <> headword GROUP BY k)
    SELECT word AS q, coalesce(h.headword, l.headword) AS headword, CASE WHEN h.headword IS NOT NULL THEN 'exact' WHEN l.headword IS NOT NULL THEN 'variant' END AS via FROM list_words LEFT JOIN heads h ON h.headword = word LEFT JOIN listed l ON l.k = word""",
)
def lookup_exact_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    heads = rows.groupBy("headword").count().where("count >= 2").select("headword")
    variants = rows.join(heads, "headword", "left_semi").select(F.split("gloss", " ")[0].alias("variant"), "headword", "ord")
    return L.lookup(list_words(spark, sf_dir).withColumnRenamed("word", "q"), heads, variants)


@query(
    "fuzzy_lookup",
    f"""WITH {NAME_WORDS}, {LIST_WORDS}, qs AS (SELECT word AS q, {Q.collapsed('fq')} AS sk FROM (SELECT word, {Q.folded("word")} AS fq FROM name_words)),
    hs AS (SELECT word AS headword, length(word) AS n_sources, {Q.collapsed('fh')} AS sk FROM (SELECT word, {Q.folded("word")} AS fh FROM list_words)),
    cl AS (SELECT sk FROM hs WHERE length(sk) >= 2 GROUP BY sk HAVING length(sk) >= 3 OR count(*) <= 8),
    c AS (SELECT q, headword, n_sources, levenshtein(q, headword) AS d FROM qs, hs WHERE levenshtein(q, headword) <= 2 UNION ALL SELECT q, headword, n_sources, 1 FROM qs JOIN hs USING (sk) WHERE sk IN (FROM cl)),
    r AS (SELECT q, headword, min(d) AS distance, row_number() OVER (PARTITION BY q ORDER BY min(d), any_value(n_sources) DESC, headword) AS rank FROM c GROUP BY q, headword)
    SELECT * FROM r WHERE rank <= 5""",
)
def fuzzy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = list_words(spark, sf_dir).select(F.col("word").alias("headword"), F.length("word").alias("n_sources"), F.lit(True).alias("flagged"))
    return L.fuzzy(name_words(spark, sf_dir).select(F.col("word").alias("q")), heads)


@query("deletion_join", f"WITH {NAME_WORDS}, {LIST_WORDS} SELECT n.word AS name, l.word AS word, levenshtein(n.word, l.word) AS distance FROM name_words n, list_words l WHERE levenshtein(n.word, l.word) <= 2")
def deletion_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = name_words(spark, sf_dir).withColumnRenamed("word", "name")
    return S.within_distance(names, list_words(spark, sf_dir), "name", "word", 2)


@query(
    "pair_proposals",
    f"""WITH {LIST_WORDS}, ws AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS pos FROM list_words), rs AS (SELECT DISTINCT replace(lower(p_name), ' ', '') AS r FROM part),
    halves AS (SELECT r, cut, left(r, cut) AS a, substr(r, cut + 1) AS b FROM (SELECT r, unnest(range(1, length(r))) AS cut FROM rs)),
    parts AS (SELECT DISTINCT a AS part FROM halves UNION SELECT DISTINCT b FROM halves),
    known AS (SELECT part, pos, levenshtein(part, word) AS d FROM parts, ws WHERE levenshtein(part, word) <= CASE WHEN length(part) <= 2 THEN 0 WHEN length(part) <= 4 THEN 1 ELSE 2 END),
    best AS (SELECT r, x.pos AS a, y.pos AS b, min(x.d + y.d) AS distance FROM halves h JOIN known x ON x.part = h.a JOIN known y ON y.part = h.b GROUP BY r, x.pos, y.pos)
    SELECT r AS reading, a, b, distance FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, a, b) AS n FROM best) WHERE n <= 400""",
)
def pair_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = positions(list_words(spark, sf_dir), ["word"])
    readings = table(spark, sf_dir, "part").select(F.replace(F.lower("p_name"), F.lit(" "), F.lit("")).alias("reading")).distinct().withColumn("r", F.col("reading"))
    return S.propose_pairs(readings, words, "reading", "r", "word", "pos")


@query("close_matches")
def close_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list words nearest to each name word by matching blocks; every list word counts."""
    return S.close_matches(name_words(spark, sf_dir), list_words(spark, sf_dir), "word", "word")


@query("first_wins_words", f"WITH {ENTRIES} SELECT headword, arg_min(head, ord) AS head, arg_min(source, ord) AS source FROM entries GROUP BY headword")
def first_wins_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_wins(entries(spark, sf_dir).select("headword", "ord", "head", "source"), ["headword"], ["ord"]).drop("ord")


@query(
    "word_list_union",
    f"WITH {NAME_WORDS}, {LIST_WORDS} SELECT word, min(list_no) AS list_no FROM (SELECT word, 0 AS list_no FROM list_words UNION ALL SELECT word, 1 FROM name_words UNION ALL SELECT lower(n_name), 2 FROM nation) GROUP BY word",
)
def word_list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("word"))
    return S.first_wins(S.union_in_order(list_words(spark, sf_dir), name_words(spark, sf_dir), nations), ["word"], ["list_no"])


@query("only_in_a", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def only_in_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    buyers = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("n_nationkey"))
    sellers = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return nation.join(buyers, "n_nationkey", "left_semi").join(sellers, "n_nationkey", "left_anti").select("n_name")


@query("shared_heads", f"WITH {ENTRIES} SELECT DISTINCT headword FROM entries WHERE source_no < 5 INTERSECT SELECT DISTINCT headword FROM entries WHERE source_no >= 15")
def shared_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    return rows.where("source_no < 5").select("headword").intersect(rows.where("source_no >= 15").select("headword"))


@query("repeated_ids", f"WITH {ENTRIES} SELECT source, headword, count(*) AS n FROM entries GROUP BY source, headword HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).groupBy("source", "headword").agg(F.count("*").alias("n")).where("n > 1")


@query("variants_of", f"WITH {NAME_WORDS}, {LIST_WORDS}, a AS (SELECT word, {Q.collapsed('f')} AS sk FROM (SELECT word, {Q.folded('word')} AS f FROM name_words)), b AS (SELECT word, {Q.collapsed('f')} AS sk FROM (SELECT word, {Q.folded('word')} AS f FROM list_words)), cl AS (SELECT sk FROM b WHERE length(sk) >= 2 GROUP BY sk HAVING length(sk) >= 3 OR count(*) <= 8) SELECT a.word AS word, b.word AS headword FROM a JOIN b USING (sk) WHERE sk IN (FROM cl)")
def variants_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import skeleton

    heads = list_words(spark, sf_dir).select(headword_key(F.col("word")).alias("headword"))
    return name_words(spark, sf_dir).withColumn("skeleton", skeleton(F.col("word"))).join(L.in_clusters(heads), "skeleton").select("word", "headword")
