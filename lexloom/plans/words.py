"""Queries over single words and rows: keys, splits, spellings, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as Q
from ..functions import text as X
from ..functions import tokens as K
from ..operators import wordlist as W
from .registry import query
from .tables import DOC_WORDS, ENTRIES, LIST_WORDS, NAME_WORDS, entries, list_words, name_words, table


@query("word_split_counts", f"WITH {DOC_WORDS} SELECT lang, split, count(*) AS n_words, count(DISTINCT key) AS n_keys FROM (SELECT lang, key, {Q.split_of('key')} AS split FROM doc_words) GROUP BY lang, split")
def word_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words are counted as they stand first, so that each is keyed and each key hashed once, and shuffles carry counts
    raw = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", r"[ \t\r\n]+")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = raw.groupBy("lang", X.word_key(F.col("word")).alias("key")).agg(F.sum("n").alias("n")).where("key <> ''")
    return counts.withColumn("split", X.split_of(F.col("key"))).groupBy("lang", "split").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_keys"))


@query("hash_split_users", f"SELECT user_id, {Q.split_of(chr(39) + 'user' + chr(39) + ' || chr((97 + user_id % 26)::INT) || chr((97 + (user_id // 26) % 26)::INT)')} AS split, count(*) AS n FROM events GROUP BY user_id")
def hash_split_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("user"), F.char(97 + F.col("user_id") % 26), F.char(97 + F.floor(F.col("user_id") / 26) % 26))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("split", X.split_of(name))


@query("skeleton_parts", f"SELECT word, skeleton, n FROM (SELECT word, n, {Q.collapsed('folded')} AS skeleton FROM (SELECT word, n, {Q.folded('word')} AS folded FROM (SELECT p_name AS word, count(*) AS n FROM part GROUP BY p_name)))")
def skeleton_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("word")).agg(F.count("*").alias("n"))
    return names.withColumn("skeleton", X.skeleton(F.col("word")))


@query("gloss_stems", f"SELECT item_id, stem FROM (SELECT item_id, unnest({Q.gloss_tokens('text')}) AS stem FROM benchmark)")
def gloss_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.gloss_tokens(F.col("text"))).alias("stem"))


_SPELL_SQL = "[" + ", ".join(f"'{k}'" for k in sorted(K._SPELLINGS, key=len, reverse=True)) + "]"
_MAP_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in (K._SPELLINGS | {"w": "OO"}).items()) + "}"
_PATTERN_SQL = "|".join([*sorted(K._SPELLINGS, key=len, reverse=True), "."])
_KEEP_SQL = "[" + ", ".join(f"'{t}'" for t in K.REPEATABLE) + "]"


def _tokens_sql(pieces: str) -> str:
    """The tokens of a list of pieces: `a` and a lone `w` before no vowel are one token; doubled consonants are not yet single."""
    vowel = lambda i: f"regexp_matches(coalesce({pieces}[{i}], ''), '^[{K.VOWELS}]')"
    named = f"""CASE WHEN x = 'a' AND {pieces}[i + 1] = 'w' AND NOT {vowel("i + 2")} THEN 'OW' WHEN x = 'w' AND i > 1 AND {pieces}[i - 1] = 'a' AND NOT {vowel("i + 1")} THEN '' ELSE ({_MAP_SQL})[x] END"""
    return f"list_filter(list_transform({pieces}, lambda x, i: {named}), lambda x: x IS NULL OR x <> '')"


_PIECES_SQL = f"regexp_extract_all(replace(word, 'x', 'ks'), '{_PATTERN_SQL}')"


@query(
    "spelled_words",
    f"""WITH {LIST_WORDS}, p AS (SELECT word, {_PIECES_SQL} AS p FROM (SELECT * FROM list_words UNION SELECT word || w FROM list_words, (VALUES ('aw'), ('awu'), ('wawa'), ('awli')) x(w))), raw AS (SELECT word, {_tokens_sql("p")} AS t FROM p)
    SELECT word, array_to_string(list_filter(t, lambda x, i: i = 1 OR list_contains({_KEEP_SQL}, x) OR x <> t[i - 1]), ' ') AS tokens,
      len(list_filter(t, lambda x, i: i = 1 OR list_contains({_KEEP_SQL}, x) OR x <> t[i - 1])) AS n_tokens FROM raw""",
)
def spelled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of the list words, also with endings that hold `aw`."""
    ended = F.array(*(F.concat("word", F.lit(x)) for x in ("", "aw", "awu", "wawa", "awli")))
    words = list_words(spark, sf_dir).select(F.explode(ended).alias("word")).distinct().withColumn("t", K.spell(F.col("word"), unknown="null"))
    return words.select("word", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n_tokens"))


@query(
    "spelled_classes",
    f"""WITH {LIST_WORDS}, p AS (SELECT word, {_PIECES_SQL} AS p FROM list_words), raw AS (SELECT word, {_tokens_sql("p")} AS r FROM p),
    s AS (SELECT word, list_filter(r, lambda x, i: i = 1 OR list_contains({_KEEP_SQL}, x) OR x <> r[i - 1]) AS t FROM raw WHERE NOT list_contains(list_transform(r, lambda x: x IS NULL), true))
    SELECT word, list_transform(t, lambda x: list_position({K.ALPHABET}, x)) AS classes, array_to_string(list_transform(t, lambda x: (MAP {{{", ".join(f"'{k}': '{chr(c) if c else chr(0xFFFD)}'" for k, (c, _) in K.TOKENS.items())}}})[x]), '') AS signs,
      len(list_filter(t, lambda x: NOT list_contains({K.ALPHABET}, x))) = 0 AS known, array_to_string(t, ' ') AS label FROM s""",
)
def spelled_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling, class numbers and signs of each list word, also with `aw`; words without a spelling are left out."""
    words = list_words(spark, sf_dir).withColumn("t", K.spell(F.col("word"), unknown="null")).where("t IS NOT NULL")
    return words.select("word", K.classes(F.col("t")).alias("classes"), K.to_signs(F.col("t")).alias("signs"), K.in_alphabet(F.col("t")).alias("known"), K.label(F.col("word")).alias("label"))


def _class_sql(x: str) -> str:
    return f"CASE WHEN {x} IN ('^', '$', '') THEN {x} WHEN {x} IN ({', '.join(repr(v) for v in K.VOWELS)}) THEN 'V' ELSE 'C' END"


#: word, src: the tokens of each list word with their letters and what is beside them, without the rule for `aw`.
SOURCES = f"""{LIST_WORDS}, tp AS (SELECT word, replace(word, 'x', 'ks') AS letters, {_PIECES_SQL} AS p FROM list_words),
  ts AS (SELECT word, list_transform(p, lambda x, i: {{'token': coalesce(({_MAP_SQL})[x], 'OO'), 'letters': x, 'context': [substr(letters, length(array_to_string(p[1:i - 1], '')), 1), substr(letters, length(array_to_string(p[1:i], '')) + 1, 1)]}}) AS t FROM tp),
  sources AS (SELECT word, list_transform(list_filter(t, lambda s, i: i = 1 OR list_contains({_KEEP_SQL}, s.token) OR s.token <> t[i - 1].token), lambda s: {{'token': s.token, 'letters': s.letters, 'context': (CASE WHEN s.context[1] = '' THEN '^' ELSE {_class_sql('s.context[1]')} END) || '_' || (CASE WHEN s.context[2] = '' THEN '$' ELSE {_class_sql('s.context[2]')} END)}}) AS src FROM ts)"""


def spelled_sql(word: str) -> str:
    """The tokens of a word, null if one can't be spelled."""
    pieces = f"regexp_extract_all(replace({word}, 'x', 'ks'), '{_PATTERN_SQL}')"
    raw = _tokens_sql(pieces)
    return f"CASE WHEN NOT list_contains(list_transform({raw}, lambda x: x IS NULL), true) THEN list_filter({raw}, lambda x, i: i = 1 OR list_contains({_KEEP_SQL}, x) OR x <> ({raw})[i - 1]) END"


@query("token_contexts", f"WITH {SOURCES}, u AS (SELECT word, unnest(src) AS s FROM sources) SELECT s.token AS token, s.letters AS letters, s.context AS context, count(*) AS n, count(DISTINCT word) AS n_words FROM u GROUP BY ALL")
def token_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each token by its letters and the classes of the letters beside it."""
    found = list_words(spark, sf_dir).select("word", F.explode(K.token_sources(F.col("word"))).alias("s"))
    context = F.concat(K.letter_class(F.col("s.before")), F.lit("_"), K.letter_class(F.col("s.after")))
    return found.groupBy(F.col("s.token").alias("token"), F.col("s.letters").alias("letters"), context.alias("context")).agg(F.count("*").alias("n"), F.countDistinct("word").alias("n_words"))


def _rewritten_sql(rule: K.Rewrite) -> str:
    """The tokens that a rule makes of src."""

    def fits(i: str) -> str:
        tests = [f"src[{i}].token = '{rule.token}'"]
        if rule.letters:
            tests.append(f"src[{i}].letters IN ({', '.join(map(repr, rule.letters))})")
        sides = {"before": f"(src[{i}].context[1] = 'V')", "after": f"(src[{i}].context[-1] = 'V')", "beside": f"contains(src[{i}].context, 'V')"}
        tests += [("" if wanted else "NOT ") + sides[name] for name in sides if (wanted := getattr(rule, name)) is not None]
        if rule.next:
            tests += [f"src[{i} + 1].token = '{rule.next[0]}'"] + ([f"src[{i} + 1].letters = '{rule.next[1]}'"] if rule.next[1] else [])
        return f"coalesce({' AND '.join(tests)}, false)"

    here = (lambda i: f"{i} = list_position(list_transform(src, lambda s, k: {fits('k')}), true)") if rule.first else fits
    after = f" WHEN i > 1 AND {here('(i - 1)')} THEN []" if rule.both else ""
    return f"flatten(list_transform(src, lambda s, i: CASE WHEN coalesce({here('i')}, false) THEN {list(rule.written)}::VARCHAR[]{after} ELSE [s.token] END))"


@query(
    "spelling_rewrites",
    f"WITH {SOURCES}, rw AS (" + " UNION ALL ".join(f"SELECT word, '{name}' AS rule, list_transform(src, lambda s: s.token) AS now, {_rewritten_sql(rule)} AS alternative FROM sources" for name, rule in K.REWRITES.items()) + ") SELECT rule, count_if(now <> alternative) AS n_changed, count(*) AS n_words, count(DISTINCT array_to_string(alternative, ' ')) AS n_spellings FROM rw GROUP BY rule",
)
def spelling_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many list words each alternative spelling rule changes."""
    src = list_words(spark, sf_dir).withColumn("src", K.token_sources(F.col("word")))
    names = lambda x: F.array_join(F.transform(x, lambda s: s.token), " ")
    rows = src.select("word", names(F.col("src")).alias("now"), F.explode(F.create_map(*(x for name, f in K.REWRITES.items() for x in (F.lit(name), names(f(F.col("src"))))))).alias("rule", "alternative"))
    return rows.groupBy("rule").agg(F.count_if(F.col("now") != F.col("alternative")).alias("n_changed"), F.count("*").alias("n_words"), F.count_distinct("alternative").alias("n_spellings"))


@query("grade_filter", f"WITH {ENTRIES} SELECT conf, source, count(*) AS n FROM entries WHERE conf <= 'B' AND source_no < 10 GROUP BY conf, source")
def grade_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).where("conf <= 'B' AND source_no < 10").groupBy("conf", "source").agg(F.count("*").alias("n"))


@query("note_grades", "SELECT event_id, coalesce(nullif(regexp_extract(note, '(?:^|;\\s*)conf=([ABC])', 1), ''), 'A') AS conf FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'near=x; conf=B' WHEN 1 THEN 'conf=C; ocr=yes' WHEN 2 THEN 'xconf=B' ELSE props END AS note FROM events)")
def note_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 4
    note = F.when(i == 0, "near=x; conf=B").when(i == 1, "conf=C; ocr=yes").when(i == 2, "xconf=B").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", X.confidence(note).alias("conf"))


@query("well_formed_words", f"SELECT w, {Q.well_formed('w')} AS ok FROM (SELECT DISTINCT unnest(string_split_regex(text, '[ \\t\\r\\n]+')) AS w FROM benchmark)")
def well_formed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[ \t\r\n]+")).alias("w")).distinct()
    return words.select("w", X.well_formed(F.col("w")).alias("ok"))


@query(
    "label_coalesce",
    "SELECT d.doc_id, coalesce(nullif(CASE WHEN quality = 1 THEN source ELSE '' END, ''), nullif(lang, ''), 'none') AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(nullif(lang, ''), 'en') IN ('en', 'de')",
)
def label_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").where(F.coalesce(X.present(F.col("lang")), F.lit("en")).isin("en", "de"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    verified = X.present(F.when(F.col("quality") == 1, F.col("source")).otherwise(""))
    return rows.select("doc_id", F.coalesce(verified, X.present(F.col("lang")), F.lit("none")).alias("label"))


@query("shard_rows", "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE (n - 1 - 2) % 5 = 0 AND n > 2")
def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordering import shard

    return shard(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], ["event_id"], 2, 5).select("event_id", "user_id")


@query("html_words", "SELECT page_id, len(list_filter(string_split(t, ' '), lambda w: w <> '')) AS n_words, length(t) AS n_chars FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)")
def html_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = table(spark, sf_dir, "pages").select("page_id", X.squash(F.regexp_replace("html", "<[^>]*>", " ")).alias("t"))
    return plain.select("page_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", " "))).alias("n_words"), F.length("t").alias("n_chars"))


@query("page_hosts", "SELECT host, count(*) AS n FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages) GROUP BY host")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n"))


_TOKENS = f"array_to_string(list_filter(t, lambda x, i: i = 1 OR list_contains({_KEEP_SQL}, x) OR x <> t[i - 1]), ' ')"
_SPELLED = f"""{LIST_WORDS}, {NAME_WORDS}, two AS (SELECT word, 0 AS list_no FROM list_words UNION ALL SELECT word, 1 FROM name_words),
  p AS (SELECT word, list_no, {_PIECES_SQL} AS p FROM two), raw AS (SELECT word, list_no, {_tokens_sql("p")} AS t FROM p), sp AS (SELECT word, list_no, {_TOKENS} AS tokens FROM raw WHERE NOT list_contains(list_transform(t, lambda x: x IS NULL), true))"""


def _lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [x.select(F.col("word").alias("headword"), F.lit("A").alias("conf"), F.lit("").alias("tokens"), F.col("word").alias("ord")) for x in (list_words(spark, sf_dir), name_words(spark, sf_dir))]


@query("candidate_list", f"WITH {_SPELLED}, o AS (SELECT tokens, word, min((list_no, word)) AS p FROM sp GROUP BY tokens, word), g AS (SELECT tokens, list(word ORDER BY p) AS h FROM o GROUP BY tokens) SELECT tokens, h[1] AS headword, array_to_string(h[2:4], '|') AS others FROM g")
def candidate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.candidates(*_lists(spark, sf_dir)).select("tokens", "headword", F.array_join("others", "|").alias("others"))


_SEEDS = ["v0", "v1", "v2", "v3", "v4"]


@query("fold_splits", f"WITH {LIST_WORDS} SELECT seed, split, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS seed, {Q.split_of('word', seed=s)} AS split FROM list_words" for s in _SEEDS) + ") GROUP BY seed, split")
def fold_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.fold_splits(list_words(spark, sf_dir), "word", _SEEDS).groupBy("seed", "split").agg(F.count("*").alias("n"))


@query("leak_free_words", f"WITH {_SPELLED}, s AS (SELECT word, tokens, {Q.split_of('word')} AS split FROM sp WHERE list_no = 0) SELECT word, tokens FROM s WHERE split = 'train' AND tokens NOT IN (SELECT tokens FROM s WHERE split = 'test')")
def leak_free_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = list_words(spark, sf_dir).select("word", F.array_join(K.spell(F.col("word"), unknown="null"), " ").alias("tokens"), X.split_of(F.col("word")).alias("split"))
    return W.without_leaks(words.where("tokens IS NOT NULL"), "split", "tokens").select("word", "tokens")


@query("trainable_words", f"WITH {ENTRIES} SELECT DISTINCT headword FROM entries WHERE regexp_full_match(headword, '[a-z]+') AND conf IN ('A', 'B') AND {Q.split_of('headword')} <> 'test'")
def trainable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.trainable(entries(spark, sf_dir).select("headword", "conf").distinct(), "headword", "conf").select("headword").distinct()
