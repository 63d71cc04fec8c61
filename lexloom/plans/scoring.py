"""Queries over matrices and evaluations. A vector of 64 numbers is a matrix of 8 frames by 8 classes; class 0 is the blank, class 7 the word space."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sql as Q
from ..functions.text import percent, word_key
from ..functions.tokens import label, letter_class, spell, token_distance, token_sources
from ..operators import evaluation as E
from ..operators import scoring as C
from .registry import query
from .sequences import EVENTS, events
from .tables import DOC_WORDS, LIST_WORDS, doc_words, list_words, table
from .words import SOURCES, spelled_sql

SPACE = 7
#: Every sequence of two or three of the classes 1 to 6 without repeats side by side.
CANDIDATES = [("".join(map(str, t)), list(t)) for n in (2, 3) for t in product(range(1, 7), repeat=n) if all(a != b for a, b in zip(t, t[1:], strict=False))]


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, frames): log probabilities."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("e", i * 8 + 1, 8), lambda x: x * 4))
    return vectors.select("vec_id", "label", C.log_softmax(frames).alias("frames"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """matrices with `models`: the matrix, and one with half the contrast as a second model; and their greedy readings."""
    half = F.transform("frames", lambda x: F.transform(x, lambda v: v / 2))
    rows = matrices(spark, sf_dir).withColumn("models", F.array(F.col("frames"), C.log_softmax(half)))
    shifted = F.transform("frames", lambda x, i: F.when(i == 0, F.reverse(x)).otherwise(x))
    return rows.withColumn("readings", F.array(C.greedy(F.col("frames")), C.greedy(shifted)))


_FRAMES = "fr AS (SELECT vec_id, list_transform(range(8), lambda i: list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x: x::DOUBLE * 4)) AS f FROM embeddings), pa AS (SELECT vec_id, f, list_transform(f, lambda x: list_position(x, list_max(x)) - 1) AS p FROM fr)"


@query("ctc_greedy", f"WITH {_FRAMES} SELECT vec_id, array_to_string(list_filter(p, lambda c, i: c <> 0 AND (i = 1 OR c <> p[i - 1])), '') AS reading FROM pa")
def ctc_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices(spark, sf_dir).select("vec_id", F.array_join(C.greedy(F.col("frames")), "").alias("reading"))


@query(
    "ctc_confidence",
    f"""WITH {_FRAMES}, m AS (SELECT vec_id, p, list_transform(f, lambda x: 1 / list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS c FROM pa)
    SELECT vec_id, round(list_avg(c), 6) AS confidence, round(coalesce(list_avg(list_filter(c, lambda v, i: p[i] <> 0)), 0), 6) AS nonblank FROM m""",
)
def ctc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrices(spark, sf_dir)
    return rows.select("vec_id", F.round(C.confidence(F.col("frames")), 6).alias("confidence"), F.round(C.confidence_nonblank(F.col("frames")), 6).alias("nonblank"))


def _chance(frames: str, classes: str) -> str:
    """SQL for the chance of a sequence of classes: the forward recursion over the frames, places of the sequence with blanks between as a list."""
    places = f"list_concat([0], flatten(list_transform({classes}, lambda c: [c, 0])))"
    first = f"list_transform({places}, lambda c, s: CASE WHEN s <= 2 THEN {frames}[1][c + 1] ELSE 0.0 END)"
    jump = f"CASE WHEN s > 2 AND c <> 0 AND c <> ({places})[s - 2] THEN a[s - 2] ELSE 0.0 END"
    step = f"list_transform({places}, lambda c, s: (a[s] + CASE WHEN s > 1 THEN a[s - 1] ELSE 0.0 END + {jump}) * f[c + 1])"
    return f"(list_reduce({frames}[2:], lambda a, f: {step}, {first}))[-2:]"


def _loss(classes: str) -> str:
    return f"-(ln(list_sum({_chance('m1', classes)})) + ln(list_sum({_chance('m2', classes)}))) / 2"


_SOFT = "list_transform({0}, lambda x: list_transform(x, lambda v: exp(v - list_max(x)) / list_sum(list_transform(x, lambda u: exp(u - list_max(x))))))"
#: vec_id, the chances of both models, and the greedy readings of the first and of its change.
_MODELS = f"""{_FRAMES}, mo AS (SELECT vec_id, {_SOFT.format("f")} AS m1, {_SOFT.format("list_transform(f, lambda x: list_transform(x, lambda v: v / 2))")} AS m2, list_filter(p, lambda c, i: c <> 0 AND (i = 1 OR c <> p[i - 1])) AS r1,
  list_concat([list_position(list_reverse(f[1]), list_max(f[1])) - 1], p[2:]) AS q FROM pa), md AS (SELECT vec_id, m1, m2, r1, list_filter(q, lambda c, i: c <> 0 AND (i = 1 OR c <> q[i - 1])) AS r2 FROM mo)"""
_CANDIDATES = f"ca AS (SELECT unnest({[n for n, _ in CANDIDATES]}) AS candidate, unnest({[t for _, t in CANDIDATES]}) AS t, unnest(range({len(CANDIDATES)})) AS place)"
_LOSSES = f"{_MODELS}, {_CANDIDATES}, lo AS (SELECT vec_id, candidate, place, {_loss('t')} AS loss FROM md, ca)"
_PAIRS = f"""rs AS (SELECT vec_id, m1, m2, list_filter(r1, lambda c: c <> {SPACE}) AS r FROM md), pr AS (SELECT vec_id, m1, m2, r[i - 1] * 10 + r[i] AS a, r[i + 1] * 10 + r[i + 2] AS b, r[i - 1 : i] AS x, r[i + 1 : i + 2] AS y FROM (SELECT *, unnest(range(2, len(r) - 1)) AS i FROM rs)),
  pl AS (SELECT vec_id, a, b, min(least({_loss(f"list_concat(x, [{SPACE}], y)")}, {_loss("list_concat(x, y)")})) AS loss FROM pr GROUP BY vec_id, a, b)"""


@query("ctc_topk", f"WITH {_LOSSES}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY loss, place) AS rank, exp(-loss) / sum(exp(-loss)) OVER (PARTITION BY vec_id) AS p FROM lo) SELECT vec_id, rank, candidate, round(loss, 3) AS score, round(p, 4) AS p_rel FROM k WHERE rank <= 5")
def ctc_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five candidates of least mean loss over two models, with their relative probabilities."""
    return C.top_candidates(models(spark, sf_dir).select("vec_id", "models"), "vec_id", "models", CANDIDATES)


@query("free_best", f"WITH {_MODELS}, u AS (SELECT vec_id, m1, m2, unnest([r1, r2]) AS r, unnest([1, 2]) AS i FROM md), l AS (SELECT vec_id, r, i, {_loss('r')} AS loss FROM u WHERE len(r) > 0) SELECT vec_id, arg_min(r, (loss, i)) AS reading, round(min(loss), 3) AS score FROM (SELECT vec_id, NULL AS r, 3 AS i, NULL AS loss FROM md UNION ALL SELECT * FROM l) GROUP BY vec_id")
def free_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.free_best(models(spark, sf_dir).select("vec_id", "models", "readings"), "vec_id", "models", "readings")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, a, b, loss, ord): list words of two classes that halves of the greedy reading are, with their losses."""
    rows = models(spark, sf_dir)
    reading = F.filter(C.greedy(F.col("frames")), lambda c: c != SPACE)
    made = F.when(F.size(reading) >= 4, F.transform(F.sequence(F.lit(2), F.size(reading) - 2), lambda i: F.struct((F.get(reading, i - 2) * 10 + F.get(reading, i - 1)).alias("a"), (F.get(reading, i) * 10 + F.get(reading, i + 1)).alias("b"), F.slice(reading, i - 1, 2).alias("left"), F.slice(reading, i + 1, 2).alias("right"))))
    proposed = rows.select("vec_id", "models", F.coalesce(made, F.array().cast("array<struct<a:int,b:int,left:array<int>,right:array<int>>>")).alias("pairs"))
    best = C.pair_losses(proposed, "vec_id", "models", "pairs", SPACE).groupBy("vec_id", "a", "b").agg(F.min("loss").alias("loss"))
    return best.withColumn("ord", F.row_number().over(Window.partitionBy("vec_id").orderBy("a", "b")))


@query("pair_loss", f"WITH {_MODELS}, {_PAIRS} SELECT vec_id, a, b, round(loss, 3) AS loss FROM pl")
def pair_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("vec_id", "a", "b", F.bround("loss", 3).alias("loss"))


@query(
    "ranked_readings",
    f"""WITH {_LOSSES}, {_PAIRS}, al AS (SELECT vec_id, 'word' AS kind, candidate::INT AS a, NULL AS b, loss AS raw, round(loss, 3) AS loss, round(loss, 3) AS score, 0 AS k1, row_number() OVER (PARTITION BY vec_id ORDER BY loss, place) AS k2 FROM lo
      UNION ALL SELECT vec_id, 'pair', a, b, loss + 8, round(loss, 3), round(loss, 3) + 8, 1, row_number() OVER (PARTITION BY vec_id ORDER BY a, b) FROM pl),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score, k1, k2) AS rank, exp(-raw) / sum(exp(-raw)) OVER (PARTITION BY vec_id) AS p FROM al)
    SELECT vec_id, rank, kind, a, b, loss, round(score, 3) AS score, round(p, 4) AS p_rel FROM k WHERE rank <= 5""",
)
def ranked_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of list words and pairs, a pair costing 8 more."""
    words = C.top_losses(models(spark, sf_dir).select("vec_id", "models"), "vec_id", "models", CANDIDATES).select("vec_id", F.col("candidate").cast("int").alias("a"), "rank", "loss", "log_total")
    return C.merge_ranked(words, _pairs(spark, sf_dir), "vec_id", 8.0)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(role, ref, hyp): the words at each place of consecutive turns as a reference and its reading."""
    keys = F.transform(F.split("text", r"[ \t\r\n]+"), word_key)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", keys.alias("ref"))
    pairs = turns.withColumn("hyp", F.lead("ref").over(Window.partitionBy("conv_id").orderBy("turn"))).where("hyp IS NOT NULL")
    return pairs.select("role", F.inline(F.arrays_zip("ref", "hyp"))).where("ref IS NOT NULL AND hyp IS NOT NULL")


_READINGS = """kt AS (SELECT conv_id, turn, role, list_transform(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: regexp_replace(strip_accents(lower(w)), '[^a-z]', '', 'g')) AS ks FROM conversations),
    ld AS (SELECT role, ks, lead(ks) OVER (PARTITION BY conv_id ORDER BY turn) AS hs FROM kt), rd AS (SELECT * FROM (SELECT role, unnest(ks) AS ref, unnest(hs) AS hyp FROM ld WHERE hs IS NOT NULL) WHERE ref IS NOT NULL AND hyp IS NOT NULL)"""


@query("ter_by_source", f"WITH {_READINGS}, e AS (SELECT role, levenshtein(ref, hyp) AS d, length(ref) AS n FROM rd) SELECT role, count(*) AS n, sum(d) AS edits, sum(n) AS tokens, round(sum(d) / greatest(sum(n), 1), 4) AS ter, round(count_if(d = 0) / greatest(count(*), 1), 4) AS exact FROM e GROUP BY GROUPING SETS ((), (role))")
def ter_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir).select("role", F.levenshtein("ref", "hyp").alias("edits"), F.length("ref").alias("length"))
    return E.error_rates(rows, "role")


_STEP = "split_part(step, '>', {0})"


@query(
    "confusion_patterns",
    f"""WITH {_READINGS}, st AS (SELECT ref AS word, unnest({Q.aligned("string_split(ref, '')", "string_split(hyp, '')")}) AS step FROM rd WHERE ref <> '' AND hyp <> ''), c AS (SELECT word, {_STEP.format(1)} AS ref, {_STEP.format(2)} AS hyp FROM st),
    t AS (SELECT ref, count(*) AS ref_total FROM c WHERE ref <> '-' GROUP BY ref), w AS (SELECT ref, hyp, count(DISTINCT word) AS n_words FROM c WHERE ref <> hyp GROUP BY ref, hyp HAVING count(DISTINCT word) >= 3)
    SELECT ref, hyp, n_words, coalesce(ref_total, 0) AS ref_total FROM w LEFT JOIN t USING (ref)""",
)
def confusion_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters read as others in at least three distinct words."""
    rows = readings(spark, sf_dir).where("ref <> '' AND hyp <> ''").select(F.col("ref").alias("word"), F.split("ref", "").alias("r"), F.split("hyp", "").alias("h"))
    return E.confusions(rows, "word", "r", "h")


_ERRORS = f"""{SOURCES}, hy AS (SELECT word, src, {spelled_sql("regexp_replace(word, '[ei]', '', 'g')")} AS hyp FROM sources),
  al AS (SELECT word, src, list_filter({Q.aligned("list_transform(src, lambda s: s.token)", "hyp")}, lambda s: NOT starts_with(s, '->')) AS steps FROM hy WHERE hyp IS NOT NULL),
  er AS (SELECT word, unnest(src) AS s, unnest(steps) AS step FROM al),
  ce AS (SELECT s.token AS token, s.letters AS letters, s.context AS context, count(*) AS n, count_if({_STEP.format(2)} = '-') AS deleted, count_if({_STEP.format(2)} NOT IN ('-', s.token)) AS substituted, count(DISTINCT word) AS n_words FROM er GROUP BY ALL)"""


@query("context_errors", f"WITH {_ERRORS} SELECT * FROM ce")
def context_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of tokens by their letters and context, of list words read as their spelling without its first vowel rule."""
    rows = list_words(spark, sf_dir).select("word", token_sources(F.col("word")).alias("src"), spell(F.regexp_replace("word", "[ei]", ""), unknown="null").alias("hyp")).where("hyp IS NOT NULL")
    return E.context_errors(rows, "word", "src", "hyp", letter_class)


@query("context_groups", f"WITH {_ERRORS} SELECT contains(context, 'V') AS beside_vowel, sum(n) AS n, sum(deleted + substituted) AS errors, sum(deleted) AS deleted FROM ce GROUP BY beside_vowel")
def context_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.context_groups(context_errors(spark, sf_dir))


@query("rule_summary", "SELECT rule, count(*) AS n, count(DISTINCT lower(word)) AS n_words, count_if(old > new) AS wins, median(old - new) AS median_gain FROM (SELECT l_shipmode_ AS rule, l_partkey::VARCHAR AS word, CASE WHEN l_linenumber = 7 THEN 'Infinity'::DOUBLE ELSE l_quantity END AS old, round(l_discount * 400) AS new FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem)) WHERE NOT isinf(old) GROUP BY rule")
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.when(F.col("l_linenumber") == 7, float("inf")).otherwise(F.col("l_quantity"))
    return E.rule_summary(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("rule"), F.col("l_partkey").cast("string").alias("word"), old.alias("old"), F.round(F.col("l_discount") * 400).alias("new")))


@query("best_setting_rate", "WITH r AS (SELECT l_returnflag, l_linenumber, round(sum(l_quantity) / greatest(sum(l_suppkey), 1), 10) AS ter FROM lineitem GROUP BY ALL) SELECT l_returnflag, arg_min(l_linenumber, (ter, l_linenumber)) AS l_linenumber, min(ter) AS ter FROM r GROUP BY l_returnflag")
def best_setting_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_by_rate(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", F.col("l_quantity"), F.col("l_suppkey"))


@query("best_setting_mean", "WITH r AS (SELECT l_returnflag, l_linenumber, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY ALL) SELECT l_returnflag, arg_max(l_linenumber, (mean, -l_linenumber)) AS l_linenumber, max(mean) AS mean FROM r GROUP BY l_returnflag")
def best_setting_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_by_mean(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", F.col("l_quantity"))


@query("book_summary", "SELECT event_type, count(*) AS n, round(avg((value > 50)::DOUBLE), 4) AS agree, " + ", ".join(f"round(quantile_cont(value, {s}), 4) AS q{int(100 * s)}" for s in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM events GROUP BY event_type")
def book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50, F.col("value"))


@query(
    "frequent_heads",
    f"""WITH w AS (SELECT doc_id, i, {Q.word_key("w")} AS key FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS w, generate_subscripts(string_split_regex(text, '[ \\t\\r\\n]+'), 1) AS i FROM documents))
    SELECT key, count(*) AS n FROM w WHERE key <> '' GROUP BY key ORDER BY n DESC, min((doc_id, i)) LIMIT 100""",
)
def frequent_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent words, of equal ones those seen first: a top-k report."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"[ \t\r\n]+")).alias("i", "word"))
    # raw words are counted first, so that each is keyed once
    raw = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "i")).alias("at"))
    keyed = raw.groupBy(word_key(F.col("word")).alias("key")).agg(F.sum("n").alias("n"), F.min("at").alias("at")).where("key <> ''")
    return keyed.orderBy(F.desc("n"), "at").limit(100).select("key", "n")


MARGINS = [0.0, 100.0, 1000.0, 10000.0]
_CHOICES = """ch AS (SELECT o_orderkey AS k, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS listed, max(CASE WHEN l_linenumber = 1 AND l_returnflag <> 'A' THEN l_extendedprice END) AS list_score,
  max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS free, max(CASE WHEN l_linenumber = 2 THEN l_extendedprice END) AS free_score, max(l_partkey) AS ref, count(*) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


@query(
    "margin_sweep",
    f"""WITH {_CHOICES} SELECT m AS margin, sum(weight) AS total, sum(CASE WHEN coalesce(CASE WHEN free IS NOT NULL AND (list_score IS NULL OR free_score + m < list_score) THEN free = ref ELSE listed = ref END, false) THEN weight ELSE 0 END) AS "right"
    FROM ch, (SELECT unnest([0.0::DOUBLE, 100, 1000, 10000]) AS m) GROUP BY m""",
)
def margin_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    at = lambda n, c, more=F.lit(True): F.max(F.when((F.col("l_linenumber") == n) & more, F.col(c)))
    rows = lines.groupBy("l_orderkey").agg(at(1, "l_partkey").alias("listed"), at(1, "l_extendedprice", F.col("l_returnflag") != "A").alias("list_score"), at(2, "l_partkey").alias("free"), at(2, "l_extendedprice").alias("free_score"), F.max("l_partkey").alias("ref"), F.count("*").alias("w"))
    return E.margin_sweep(rows, MARGINS, F.col("w"))


_UNITS = "u AS (SELECT l_orderkey, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) = 1 THEN 'match' WHEN l_orderkey % 3 = 0 THEN 'split' ELSE 'merge' END AS kind, l_linenumber, l_returnflag, l_linestatus FROM lineitem)"


@query(
    "unit_scores",
    f"""WITH {_UNITS}, i AS (SELECT l_orderkey, kind, count(*) AS k, string_agg(CASE l_returnflag WHEN 'R' THEN 'F' WHEN 'A' THEN 'F' ELSE 'O' END, ' _ ' ORDER BY l_linenumber, CASE l_returnflag WHEN 'R' THEN 'F' WHEN 'A' THEN 'F' ELSE 'O' END) AS ref, string_agg(l_linestatus, ' _ ' ORDER BY l_linenumber, l_linestatus) AS reading FROM u GROUP BY l_orderkey, kind)
    SELECT kind, sum(k) AS words, sum(CASE WHEN kind IN ('match', 'split') AND ref = reading THEN k ELSE 0 END) AS "right", sum(k) AS read FROM i GROUP BY kind""",
)
def unit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    n = F.count("*").over(Window.partitionBy("l_orderkey"))
    rows = lines.withColumn("kind", F.when(n == 1, "match").when(F.col("l_orderkey") % 3 == 0, "split").otherwise("merge")).withColumn("t", F.when(F.col("l_returnflag").isin("R", "A"), "F").otherwise("O"))
    read = E.units(rows, "l_orderkey", "kind", "l_linestatus", "l_linenumber").select("l_orderkey", F.col("ref").alias("reading"))
    return E.unit_scores(E.units(rows, "l_orderkey", "kind", "t", "l_linenumber"), read, "l_orderkey", "kind", False)


@query(
    "label_scores",
    f"""WITH {LIST_WORDS}, w AS (SELECT key, count(*) AS n FROM (SELECT {"regexp_replace(strip_accents(lower(w)), '[^a-z]', '', 'g')"} AS key FROM (SELECT unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS w FROM documents)) WHERE key <> '' GROUP BY key),
    r AS (SELECT CASE WHEN length(key) > 2 THEN key END AS ref, [left(key, 4), left(key, 3) || 'e', key || 'a'] AS top, left(key, 3) AS free, key IN (SELECT word FROM list_words) AS in_list FROM w)
    SELECT count(ref) AS words, count_if(ref IS NOT NULL AND top[1] = ref) AS top1, count_if(ref IS NOT NULL AND list_contains(top, ref)) AS top5, count_if(free = ref) AS free, count_if(ref IS NOT NULL AND in_list) AS in_list, count_if(in_list AND top[1] = ref) AS top1_in_list, count_if(in_list AND list_contains(top, ref)) AS top5_in_list, count_if(ref IS NULL) AS unlabelled FROM r""",
)
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = list_words(spark, sf_dir).select(F.col("word").alias("key"), F.lit(True).alias("in_list"))
    rows = doc_words(spark, sf_dir).select("key").distinct().join(known, "key", "left").withColumn("in_list", F.coalesce("in_list", F.lit(False)))
    top = F.array(F.left("key", F.lit(4)), F.concat(F.left("key", F.lit(3)), F.lit("e")), F.concat("key", F.lit("a")))
    return E.label_scores(rows.select(F.when(F.length("key") > 2, F.col("key")).alias("ref"), top.alias("top"), F.left("key", F.lit(3)).alias("free"), "in_list"))


@query("fold_mean_std", "WITH f AS (SELECT user_id % 5 AS fold, count_if(value > 50) / count(*) AS rate FROM events GROUP BY fold) SELECT count(*) AS n, round(avg(rate), 6) AS mean, round(stddev_pop(rate), 6) AS std FROM f")
def fold_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("fold")).agg((F.count_if(F.col("value") > 50) / F.count("*")).alias("rate"))
    return E.fold_summary(folds, "rate")


@query("mode_bin", "WITH c AS (SELECT l_returnflag, floor(l_extendedprice / 500)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, arg_max(bin, (n, -bin)) AS bin, max(n) AS n FROM c GROUP BY l_returnflag")
def mode_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mode_bin(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), 500)


@query("large_part", "WITH c AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.6) AS cut FROM orders GROUP BY ALL) SELECT o_orderpriority, round(cut, 6) AS cut, count(*) AS n, median(o_custkey)::DOUBLE AS median_height, round(median(o_totalprice), 6) AS median_area FROM orders JOIN c USING (o_orderpriority) WHERE o_totalprice >= cut GROUP BY o_orderpriority, cut")
def large_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.large_part(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_custkey"), ["o_orderpriority"], "o_totalprice", "o_custkey")
    return out.withColumn("cut", F.round("cut", 6)).withColumn("median_area", F.round("median_area", 6))


@query("telemetry", f"WITH {EVENTS} SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev) WHERE i > 2 GROUP BY user_id")
def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.telemetry(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "value")


@query("share_texts", "SELECT o_orderpriority, printf('%d/%d = %.1f%%', count_if(o_orderstatus = 'F'), count(*), 100.0 * count_if(o_orderstatus = 'F') / count(*)) AS share FROM orders GROUP BY o_orderpriority")
def share_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(percent(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("share"))


@query(
    "spelling_distance",
    f"""WITH {LIST_WORDS}, sp AS (SELECT word, {spelled_sql("word")} AS a, {spelled_sql("left(word, length(word) // 2)")} AS b FROM list_words)
    SELECT word, len(list_filter({Q.aligned("a", "b")}, lambda s: split_part(s, '>', 1) <> split_part(s, '>', 2))) AS distance, array_to_string(a, ' ') AS label FROM sp WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def spelling_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token distance between a list word's spelling and that of its first half twice; and its label."""
    rows = list_words(spark, sf_dir).select("word", spell(F.col("word"), unknown="null").alias("a"), spell(F.expr("left(word, length(word) div 2)"), unknown="null").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return rows.select("word", token_distance(F.col("a"), F.col("b")).alias("distance"), label(F.col("word")).alias("label"))


@query("page_pieces")
def page_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected ink of each vector as an 8 by 8 image."""
    from ..operators import layout

    pixel = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest(((x + 1) * 127).cast("int"), F.lit(0)), F.lit(255))), 2, "0"))
    pages = table(spark, sf_dir, "embeddings").select("vec_id", F.unhex(F.array_join(pixel, "")).alias("pixels"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    return layout.page_pieces(pages, "vec_id", 2)


@query("line_fits", "SELECT l_returnflag, round(slope, 4) AS slope, round((wy - slope * wx) / w, 4) AS level FROM (SELECT *, greatest(least((w * wxy - wx * wy) / (w * wxx - wx * wx), 1000), -1000) AS slope FROM (SELECT l_returnflag, sum(l_linenumber)::DOUBLE AS w, sum(l_linenumber * l_quantity) AS wx, sum(l_linenumber * l_extendedprice) AS wy, sum(l_linenumber * l_quantity * l_quantity) AS wxx, sum(l_linenumber * l_quantity * l_extendedprice) AS wxy FROM lineitem GROUP BY l_returnflag))")
def line_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import layout

    rows = table(spark, sf_dir, "lineitem")
    out = layout.line_fit(rows, ["l_returnflag"], F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_linenumber"), 1000.0)
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("level", 4).alias("level"))


@query("boxes_of_parts", "SELECT l_orderkey, greatest(min(l_partkey) - 5, 0) AS x0, greatest(min(l_suppkey) - 5, 0) AS y0, max(l_partkey) + 5 AS x1, max(l_suppkey) + 5 AS y1 FROM lineitem GROUP BY l_orderkey")
def boxes_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import layout

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("x0"), F.col("l_suppkey").alias("y0"), F.col("l_partkey").alias("x1"), F.col("l_suppkey").alias("y1"))
    return layout.union_box(rows, ["l_orderkey"], 5)
