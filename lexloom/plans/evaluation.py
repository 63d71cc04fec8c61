"""Queries over readings and references, structural checks, and data sets put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as Q
from ..operators import evaluation as E
from ..operators import layout
from ..operators import lexicon as L
from ..operators import ordering as O
from ..operators import sequences as S
from ..operators import validation as V
from ..operators import wordlist as W
from .lexicon import _CLUSTERS, _SKELETONS
from .registry import query
from .scoring import _READINGS, _STEP, readings
from .sequences import _uniform
from .tables import ENTRIES, LIST_WORDS, entries, list_words, table


@query(
    "accuracy_by_source",
    f"""WITH {_READINGS}, e AS (SELECT role, ref, hyp, levenshtein(ref, hyp) AS d, [hyp, left(ref, 3), hyp || 'e'] AS top FROM rd)
    SELECT role, count(*) AS n, round(sum(d) / greatest(sum(length(ref)), 1), 4) AS ter, round(count_if(hyp = ref) / greatest(count(*), 1), 4) AS exact, round(count_if(top[1] = ref) / greatest(count(*), 1), 4) AS top1,
      round(count_if(list_contains(top, ref)) / greatest(count(*), 1), 4) AS top5 FROM e GROUP BY GROUPING SETS ((), (role))""",
)
def accuracy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir).select("role", "ref", "hyp", F.levenshtein("ref", "hyp").alias("edits"), F.length("ref").alias("length"), F.array("hyp", F.left("ref", F.lit(3)), F.concat("hyp", F.lit("e"))).alias("top"))
    return E.accuracy(rows, "role")


@query(
    "confusion_report",
    f"""WITH {_READINGS}, st AS (SELECT ref AS word, unnest({Q.aligned("string_split(ref, '')", "string_split(hyp, '')")}) AS step FROM rd WHERE ref <> '' AND hyp <> ''), c AS (SELECT word, {_STEP.format(1)} AS ref, {_STEP.format(2)} AS hyp FROM st),
    t AS (SELECT ref, count(*) AS ref_total FROM c WHERE ref <> '-' GROUP BY ref), w AS (SELECT ref, hyp, list(DISTINCT word ORDER BY word) AS ws FROM c WHERE ref <> hyp GROUP BY ref, hyp HAVING count(DISTINCT word) >= 3)
    SELECT row_number() OVER (ORDER BY len(ws) DESC, ref DESC, hyp DESC) AS place, ref, hyp, len(ws) AS n_words, coalesce(ref_total, 0) AS ref_total, array_to_string(ws[1:8], ', ') AS examples FROM w LEFT JOIN t USING (ref)""",
)
def confusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusions as they are reported: most words first, with examples."""
    rows = readings(spark, sf_dir).where("ref <> '' AND hyp <> ''").select(F.col("ref").alias("word"), F.split("ref", "").alias("r"), F.split("hyp", "").alias("h"))
    return E.report(E.confusions(rows, "word", "r", "h", 3, 8))


def _spaced(x: str) -> str:
    return f"array_to_string(string_split({x}, ''), ' ')"


@query(
    "ground_truth_scores",
    f"""WITH {LIST_WORDS}, r AS (SELECT word, CASE length(word) % 3 WHEN 0 THEN word WHEN 1 THEN left(word, 4) END AS known, CASE WHEN length(word) > 6 THEN word END AS spelled FROM list_words WHERE length(word) % 5 <> 0),
    f AS (SELECT word, coalesce(known, spelled) AS ref, CASE WHEN known IS NOT NULL THEN 'labelled' WHEN spelled IS NOT NULL THEN 'spelled' ELSE 'unlabelled' END AS way, [left(word, 5), left(word, 4)] AS top FROM r),
    x AS (SELECT *, coalesce(ref IN (SELECT word FROM list_words WHERE length(word) <= 8), false) AS listed, coalesce(top[1] = ref, false) AS t1, coalesce(list_contains(top, ref), false) AS t5 FROM f)
    SELECT way, count(ref) AS words, count_if(t1) AS top1, count_if(t5) AS top5, count_if(word = ref) AS free, count_if(left(word, 4) = ref) AS free_best, count_if(listed) AS in_list, count_if(t1 AND listed) AS top1_in_list, count_if(t5 AND listed) AS top5_in_list,
      count_if(ref IS NULL) AS unlabelled, coalesce(sum(levenshtein(word, ref)), 0) AS edits, coalesce(sum(length(ref)), 0) AS ref_tokens FROM x GROUP BY way""",
)
def ground_truth_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List words as annotated rows, read as themselves; tokens are letters."""
    words = list_words(spark, sf_dir)
    word, n = F.col("word"), F.length("word")
    spaced = lambda c: F.array_join(F.split(c, ""), " ")
    rows = words.select(word.alias("id"), F.when(n % 5 == 0, "other").otherwise("own").alias("language"), F.when(n % 3 == 0, spaced(word)).otherwise("").alias("tokens_verified"), F.when(n % 3 == 1, spaced(F.left(word, F.lit(4)))).alias("tokens_rule"))
    keys = words.select(word.alias("id"), n.alias("page"), word.alias("line"))
    read = words.select(n.alias("page"), word.alias("line"), F.array(spaced(F.left(word, F.lit(5))), spaced(F.left(word, F.lit(4)))).alias("top"), spaced(word).alias("free"), spaced(F.left(word, F.lit(4))).alias("free_best"))
    candidates = words.where(n <= 8).select(spaced(word).alias("tokens"))
    return E.ground_truth_scores(rows, keys, read, candidates, "own", F.when(F.length("id") > 6, spaced(F.col("id"))))


@query(
    "merged_scores",
    """WITH b AS (SELECT l_orderkey AS o, l_orderkey || '.' || l_linenumber AS box, l_returnflag, l_linestatus FROM lineitem),
    i AS (SELECT o, l_linestatus AS ref, list(DISTINCT box ORDER BY box) AS s, min(box) AS main_box, count(*) AS k FROM b GROUP BY o, l_linestatus), n AS (SELECT *, CASE WHEN k = 1 THEN 'match' WHEN k = 2 THEN 'split' ELSE 'merge' END AS kind FROM i),
    r AS (SELECT o, l_returnflag, list(DISTINCT box ORDER BY box) AS s, min(l_linestatus) AS reading FROM b GROUP BY o, l_returnflag)
    SELECT kind, sum(k) AS words, sum(CASE WHEN kind IN ('match', 'split') AND reading = ref THEN k ELSE 0 END) AS "right", count_if(kind = 'match' AND reading IS NULL AND main_box IN (SELECT box FROM b)) AS lost FROM n LEFT JOIN r USING (s) GROUP BY kind""",
)
def merged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order are boxes: units by status, outputs by return flag."""
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("box"))
    n = F.col("k")
    items = boxes.groupBy("l_orderkey", F.col("l_linestatus").alias("ref")).agg(F.collect_list("box").alias("boxes"), F.min("box").alias("main_box"), F.count("*").alias("k"))
    items = items.withColumn("kind", F.when(n == 1, "match").when(n == 2, "split").otherwise("merge"))
    outputs = boxes.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("box").alias("boxes"), F.min("l_linestatus").alias("reading"))
    return E.merged_scores(items, outputs, ["match", "split"])


@query(
    "first_glosses",
    f"""WITH {ENTRIES}, {LIST_WORDS}, heads AS (SELECT headword FROM entries GROUP BY headword HAVING count(*) >= 2), gl AS (SELECT headword, arg_min(gloss, ord) AS gloss FROM entries WHERE gloss <> '' GROUP BY headword),
    listed AS (SELECT k, arg_min(headword, ord) AS headword FROM (SELECT {Q.headword_key("string_split(gloss, ' ')[1]")} AS k, headword, ord FROM entries WHERE headword IN (FROM heads)) WHERE k <> '' AND k <> headword GROUP BY k),
    f AS (SELECT word AS q, coalesce(h.headword, l.headword) AS headword FROM list_words LEFT JOIN heads h ON h.headword = word LEFT JOIN listed l ON l.k = word) SELECT q, coalesce(gloss, '') AS gloss FROM f LEFT JOIN gl USING (headword)""",
)
def first_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    merged = L.merge(rows).where("n_entries >= 2")
    variants = rows.join(merged.select("headword"), "headword", "left_semi").select(F.split("gloss", " ")[0].alias("variant"), "headword", "ord")
    return L.first_gloss(list_words(spark, sf_dir).withColumnRenamed("word", "q"), merged, variants)


@query(
    "overlap_sounds",
    f"""WITH {ENTRIES}, {_SKELETONS}, {_CLUSTERS.format(heads="heads")}, k AS (SELECT headword, CASE WHEN NOT contains(headword, ' ') AND skeleton IN (SELECT skeleton FROM clusters) THEN skeleton ELSE 'h:' || headword END AS key FROM heads),
    p AS (SELECT DISTINCT source, key FROM entries JOIN k USING (headword)), n AS (SELECT source, count(*) AS n FROM p GROUP BY source)
    SELECT x.source AS a, y.source AS b, any_value(na.n) AS n_a, any_value(nb.n) AS n_b, count(*) AS n_both FROM p x JOIN p y ON x.key = y.key AND x.source < y.source JOIN n na ON na.source = x.source JOIN n nb ON nb.source = y.source GROUP BY x.source, y.source""",
)
def overlap_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pair of sources shares by sound."""
    return L.overlap(L.sound_keys(entries(spark, sf_dir)), "key")


@query(
    "inherited_fields",
    "WITH f AS (SELECT doc_id, lang, source, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents), c AS (SELECT doc_id, CASE WHEN first <> doc_id THEN first END AS copy_of, CASE WHEN first = doc_id THEN lang END AS lang, CASE WHEN doc_id % 2 = 0 OR first = doc_id THEN source END AS source FROM f) SELECT c.doc_id, c.copy_of, coalesce(c.lang, o.lang) AS lang, coalesce(c.source, o.source) AS source FROM c LEFT JOIN c o ON o.doc_id = c.copy_of",
)
def inherited_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies take their language, and some their source, from the first document with their text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5("text").alias("h"))
    firsts = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    own = F.col("first") == F.col("doc_id")
    rows = docs.join(firsts, "h").select("doc_id", F.when(~own, F.col("first")).alias("copy_of"), F.when(own, F.col("lang")).alias("lang"), F.when(own | (F.col("doc_id") % 2 == 0), F.col("source")).alias("source"))
    return V.inherited(rows, "doc_id", "copy_of", ["lang", "source"])


@query(
    "chosen_rows",
    "WITH u AS (SELECT 0 AS list_no, c_name AS name FROM customer UNION ALL SELECT 1, s_name FROM supplier), p AS (SELECT list_no, name, row_number() OVER (ORDER BY list_no, name) - 1 AS pos FROM u) SELECT list_no, name, pos FROM p WHERE pos IN (SELECT p_partkey * 3 FROM part)",
)
def chosen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row of customers and suppliers, one after the other, as far as there are parts."""
    lists = [table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))]
    return O.subset(lists, ["name"], table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("pos")))


@query(
    "test_sides",
    f"WITH f AS (SELECT doc_id, regexp_replace(strip_accents(lower(string_split_regex(text, '[ \\t\\r\\n]+')[1])), '[^a-z]', '', 'g') AS word, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents), s AS (SELECT *, {Q.split_of('word')} AS split FROM f) SELECT split, count(*) AS n, count(DISTINCT word) AS n_words FROM s WHERE split <> 'test' OR first = doc_id GROUP BY split",
)
def test_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the side of their first word; copies are no test rows."""
    from ..functions.text import word_key

    docs = table(spark, sf_dir, "documents").select("doc_id", word_key(F.split("text", r"[ \t\r\n]+")[0]).alias("word"), F.md5("text").alias("h"))
    firsts = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    rows = docs.join(firsts, "h").withColumn("copy_of", F.when(F.col("first") != F.col("doc_id"), F.col("first")))
    return W.sides(rows, "word", "copy_of").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("word").alias("n_words"))


_SIGNS = """s AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE 'p' || (p_partkey - p_partkey % 13 // 12) END AS id, CASE p_size % 3 WHEN 0 THEN 'vowel' WHEN 1 THEN lower(p_type) END AS category, ['U+1BC0' || p_size % 10, 'u ' || p_size] || CASE WHEN p_size % 4 = 0 THEN ['U+1b U+12345'] ELSE [] END AS unicode,
    CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'med' WHEN 2 THEN p_brand END AS confidence, CASE WHEN p_size % 2 = 0 THEN ['p' || (p_partkey + 1), 'p' || p_partkey] END AS confusables, CASE WHEN p_size % 5 = 0 THEN 'p' || (p_partkey - 1) END AS same_shape_as,
    CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN ['(a note)'] ELSE [p_brand || ' p. 1', 'Brand#1, 2'] END AS sources, [{'key': 'a', 'value': 'VERIFIED ' || p_name}, {'key': 'b', 'value': CASE WHEN p_size % 3 = 0 THEN 'COMPUTED' ELSE p_name END}] AS labels FROM part)"""
_KEYS = ["Brand#1", "Brand#2", "Brand#3"]


@query(
    "sign_errors",
    f"""WITH {_SIGNS}, e AS (SELECT 'duplicate id' AS rule, id, count(*)::VARCHAR AS detail FROM s GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'missing field', id, unnest(list_filter([CASE WHEN category IS NULL THEN 'category' END, CASE WHEN confusables IS NULL THEN 'confusables' END, CASE WHEN sources IS NULL THEN 'sources' END, CASE WHEN confidence IS NULL THEN 'confidence' END], lambda x: x IS NOT NULL)) FROM s
    UNION ALL SELECT 'bad id', id, id FROM s WHERE NOT regexp_full_match(id, '[A-Za-z0-9_]+') UNION ALL SELECT 'bad category', id, category FROM s WHERE coalesce(category NOT IN ({", ".join(map(Q.quoted, V.CATEGORIES))}), true) UNION ALL SELECT 'bad confidence', id, confidence FROM s WHERE coalesce(confidence NOT IN ('high', 'med', 'low'), true)
    UNION ALL SELECT 'no code point', id, u FROM (SELECT id, unnest(unicode) AS u FROM s) WHERE NOT regexp_matches(u, 'U\\+[0-9A-Fa-f]+') UNION ALL SELECT 'malformed code point', id, t FROM (SELECT id, unnest(flatten(list_transform(unicode, lambda v: regexp_extract_all(v, 'U\\+[0-9A-Fa-f]+')))) AS t FROM s) WHERE NOT regexp_full_match(t, 'U\\+[0-9A-F]{{4,6}}')
    UNION ALL SELECT 'confusable with itself', id, c FROM (SELECT id, unnest(confusables) AS c FROM s) WHERE c = id UNION ALL SELECT 'confusable is no sign', id, c FROM (SELECT id, unnest(confusables) AS c FROM s) WHERE c NOT IN (SELECT id FROM s) UNION ALL SELECT 'same shape as no sign', id, same_shape_as FROM s WHERE same_shape_as NOT IN (SELECT id FROM s)
    UNION ALL SELECT 'no sources', id, '' FROM s WHERE sources IS NULL UNION ALL SELECT 'unknown source', id, c FROM (SELECT id, unnest(sources) AS c FROM s) WHERE NOT starts_with(c, '(') AND regexp_extract(c, '^[^ ,;:(]*') NOT IN ({", ".join(map(Q.quoted, _KEYS))})
    UNION ALL SELECT 'label without status', id, l.key FROM (SELECT id, unnest(labels) AS l FROM s) WHERE NOT regexp_matches(l.value, '{"|".join(V.STATUS)}')) SELECT rule, id, detail FROM e""",
)
def sign_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with parts as signs."""
    part, n, k = table(spark, sf_dir, "part"), F.col("p_size"), F.col("p_partkey")
    numbered = lambda i: F.concat(F.lit("p"), i.cast("string"))
    points = F.concat(F.array(F.concat(F.lit("U+1BC0"), (n % 10).cast("string")), F.concat(F.lit("u "), n.cast("string"))), F.when(n % 4 == 0, F.array(F.lit("U+1b U+12345"))).otherwise(F.array().cast("array<string>")))
    signs = part.select(
        F.when(k % 7 == 0, F.col("p_name")).otherwise(numbered(k - F.floor(k % 13 / 12))).alias("id"),
        F.when(n % 3 == 0, "vowel").when(n % 3 == 1, F.lower("p_type")).alias("category"),
        points.alias("unicode"),
        F.when(n % 4 == 0, "high").when(n % 4 == 1, "med").when(n % 4 == 2, F.col("p_brand")).alias("confidence"),
        F.when(n % 2 == 0, F.array(numbered(k + 1), numbered(k))).alias("confusables"),
        F.when(n % 5 == 0, numbered(k - 1)).alias("same_shape_as"),
        F.when(n % 6 == 1, F.array(F.lit("(a note)"))).when(n % 6 != 0, F.array(F.concat("p_brand", F.lit(" p. 1")), F.lit("Brand#1, 2"))).alias("sources"),
        F.create_map(F.lit("a"), F.concat(F.lit("VERIFIED "), "p_name"), F.lit("b"), F.when(n % 3 == 0, "COMPUTED").otherwise(F.col("p_name"))).alias("labels"),
    )
    return V.sign_errors(signs, _KEYS, required=["id", "category", "unicode", "confusables", "sources", "confidence"])


def _chosen(options: list[str], u: str) -> str:
    return f"({options})[floor({u} * {len(options)})::INT + 1]"


def _number(*parts: str) -> str:
    return _uniform(" || '/' || ".join(("p_partkey::VARCHAR", *parts)), "w")


@query(
    "random_words",
    f"SELECT p_partkey, array_to_string(flatten(list_transform(range(1, floor({_number(chr(39) + 'n' + chr(39))} * {W.MOST_SYLLABLES})::INT + 2), lambda i: (CASE WHEN {_number('i::VARCHAR', chr(39) + 'a' + chr(39))} < {W.ONSET} THEN [{_chosen(W.CONSONANTS, _number('i::VARCHAR', chr(39) + 'b' + chr(39)))}] ELSE [] END) || [{_chosen(W.VOWEL_TOKENS, _number('i::VARCHAR', chr(39) + 'c' + chr(39)))}] || (CASE WHEN {_number('i::VARCHAR', chr(39) + 'd' + chr(39))} < {W.CODA} THEN [{_chosen(W.CONSONANTS, _number('i::VARCHAR', chr(39) + 'e' + chr(39)))}] ELSE [] END))), ' ') AS tokens FROM part",
)
def random_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random words for parts."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(W.random_tokens(F.col("p_partkey"), "w"), " ").alias("tokens"))


@query("line_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN count_if(l_returnflag <> 'N') OVER (PARTITION BY l_orderkey ORDER BY l_linestatus, l_linenumber ROWS UNBOUNDED PRECEDING) END AS number FROM lineitem")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order numbered by status and number, but for those that aren't returned."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")
    return S.text_line_numbers(rows, ["l_orderkey"], ["l_linestatus", "l_linenumber"], F.col("l_returnflag") != "N").select("l_orderkey", "l_linenumber", "number")


@query(
    "words_in_lines",
    """WITH l AS (SELECT l_orderkey AS page, l_linenumber % 2 AS line, l_linenumber AS index, min(l_returnflag) AS f, min(l_linestatus) AS s, min(l_suppkey) AS x0, max(l_suppkey + l_quantity) AS x1, max(l_discount) AS score, max(l_tax) AS tax FROM lineitem GROUP BY ALL)
    SELECT page, line, index, score, row_number() OVER w AS place, x0 - max(x1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM l WHERE f <> 'A' AND s = 'O' AND tax > 0.01 AND score > 0.02 WINDOW w AS (PARTITION BY page, line ORDER BY x0, index)""",
)
def words_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as words of two lines of a page; some have no image or no reading."""
    keys = [F.col("l_orderkey").alias("page"), (F.col("l_linenumber") % 2).alias("line"), F.col("l_linenumber").alias("index")]
    x1 = F.max(F.col("l_suppkey") + F.col("l_quantity")).alias("x1")
    rows = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.min("l_suppkey").alias("x0"), x1, F.max("l_discount").alias("score"), F.max("l_tax").alias("tax"))
    kinds = [F.when(F.col("f") != "A", "text").otherwise("separator").alias("line_kind"), F.when(F.col("s") == "O", "word").otherwise("punct").alias("word_kind")]
    crops, read = rows.where("tax > 0.01").select("page", "line", "index"), rows.where("score > 0.02").select("page", "line", "index", "score")
    return S.words_in_lines(rows.select("page", "line", "index", "x0", "x1", *kinds), crops, read, ["page"]).select("page", "line", "index", "score", "place", "gap")


@query(
    "row_bands",
    """WITH e AS (SELECT l_orderkey AS page, l_suppkey AS x0, l_suppkey + l_quantity AS x1, l_extendedprice - 300 AS y0, l_extendedprice + 300 AS y1, l_extendedprice AS cy, l_quantity * 20 AS area FROM lineitem), p AS (SELECT * FROM e WHERE area >= 120),
    g AS (SELECT *, CASE WHEN cy - lag(cy) OVER w >= 5000 THEN 1 ELSE 0 END AS new FROM p WINDOW w AS (PARTITION BY page ORDER BY cy, x0)), b AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY cy, x0 ROWS UNBOUNDED PRECEDING) AS band FROM g)
    SELECT page, band, (min(y0) + max(y1)) / 2 AS mid, (max(y1) - min(y0)) / 2 AS half, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY page, band HAVING sum(area) >= 400 AND max(x1) - min(x0) >= 40""",
)
def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as pieces of a page, in rows by price."""
    price, n = F.col("l_extendedprice"), F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("x0"), (F.col("l_suppkey") + n).alias("x1"), (price - 300).alias("y0"), (price + 300).alias("y1"), price.alias("cy"), (n * 20).alias("area"))
    return layout.row_bands(rows, ["page"], 5000.0)


@query(
    "shared_slopes",
    """WITH s AS (SELECT l_suppkey % 7 AS page, l_suppkey AS line, count(*) AS n, max(l_partkey) - min(l_partkey) AS span, sum(l_quantity) AS w, sum(l_quantity * l_partkey) AS wx, sum(l_quantity * l_extendedprice) AS wy, sum(l_quantity * l_partkey * l_partkey) AS wxx, sum(l_quantity * l_partkey * l_extendedprice) AS wxy FROM lineitem GROUP BY ALL),
    f AS (SELECT *, CASE WHEN n < 3 OR span < 1 OR w * wxx - wx * wx <= 0 THEN 0.0 ELSE greatest(least((w * wxy - wx * wy) / (w * wxx - wx * wx), 30), -30) END AS own FROM s), m AS (SELECT page, median(own) AS shared FROM f WHERE n >= 4 GROUP BY page)
    SELECT page, line, round(coalesce(shared, own), 4) AS slope, round(wy / w - coalesce(shared, own) * wx / w, 2) AS level FROM f LEFT JOIN m USING (page)""",
)
def shared_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of price by part for each supplier, with the middle slope of their group."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("page"), F.col("l_suppkey").alias("line"), "l_partkey", "l_extendedprice", "l_quantity")
    found = layout.shared_line_fit(rows, ["page"], "line", "l_partkey", "l_extendedprice", "l_quantity", 30.0)
    return found.select("page", "line", F.round("slope", 4).alias("slope"), F.round("level", 2).alias("level"))


@query("scaled_widths", f"WITH j AS (SELECT p_partkey, p_size, p_retailprice, exp((2 * {_uniform('p_partkey', 5)} - 1) * ln(1.3::DOUBLE)) AS f FROM part), s AS (SELECT p_partkey, f, round_even(p_retailprice / 5 * f, 0) AS w, round_even(p_size * 2 * f, 0) AS h FROM j) SELECT p_partkey, round(f, 9) AS factor, greatest(least(CASE WHEN h > 60 THEN round_even(w * 60 / greatest(h, 1), 0) ELSE w END, 640) + 8, 16) AS width FROM s")
def scaled_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of parts as images, scaled by a random factor."""
    rows = table(spark, sf_dir, "part").withColumn("f", layout.scale_jitter(O.uniform(F.col("p_partkey"), 5), 0.3))
    return rows.select("p_partkey", F.round("f", 9).alias("factor"), layout.rescaled_width(F.col("p_retailprice") / 5, F.col("p_size") * 2, F.col("f")).alias("width"))
