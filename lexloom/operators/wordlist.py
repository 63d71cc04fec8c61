"""Word lists for reading: candidates by spelling, lists made from entries and annotations, and splits without leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present, split_of
from ..functions.tokens import in_alphabet, spell
from .ordering import uniform
from .similarity import union_in_order


def candidates(*lists: DataFrame) -> DataFrame:
    """(tokens, headword, others, place): distinct token strings of the lists (headword, conf, tokens, ord) in order.

    Rows graded A or B count; given tokens win over the spelling; rows that can't be spelled are left out. The first
    head is shown, with up to three others.
    """
    rows = union_in_order(*(x.select("headword", "conf", "tokens", "ord") for x in lists)).where(F.col("conf").isin("A", "B"))
    made = F.coalesce(F.split(present(F.trim("tokens")), r"\s+"), spell(F.col("headword"), unknown="null"))
    spelled = rows.withColumn("t", made).where(F.col("t").isNotNull() & (F.size("t") > 0)).where(in_alphabet(F.col("t"))).withColumn("tokens", F.array_join("t", " "))
    # one row for each head of a token string before heads are gathered
    once = spelled.groupBy("tokens", "headword").agg(F.min(F.struct("list_no", "ord")).alias("at"))
    heads = once.groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("at", "headword"))).alias("h"))
    names = F.transform("h", lambda x: x["headword"])
    return heads.select("tokens", names[0].alias("headword"), F.slice(names, 2, 3).alias("others"), F.col("h")[0]["at"].alias("place"))


def build(entries: DataFrame, annotations: DataFrame, sources: list[str], language: str) -> DataFrame:
    """(headword, best_conf, tokens, source): A and B entries, then each first token string of the annotated rows of the sources. A source without any stops the run."""
    told = annotations.where((F.col("language") == language) & present(F.col("tokens_rule")).isNotNull()).where(F.col("source").isin(sources))
    missing = set(sources) - {r.source for r in told.select("source").distinct().collect()}
    if missing:
        raise ValueError(f"no annotated rows of {', '.join(sorted(missing))}")
    extra = told.groupBy("tokens_rule").agg(F.min_by(F.struct("latin", "source"), "ord").alias("x"))
    base = entries.where(F.col("best_conf").isin("A", "B")).select("headword", "best_conf", F.lit("").alias("tokens"), F.lit("lexicon").alias("source"))
    return base.unionByName(extra.select(F.translate("x.latin", "\t", " ").alias("headword"), F.lit("A").alias("best_conf"), F.col("tokens_rule").alias("tokens"), "x.source"))


def fold_splits(words: DataFrame, word: str, seeds: list[str], test_share: float = 0.2) -> DataFrame:
    """words with seed and split, once for each seed."""
    sides = F.array(*(F.struct(F.lit(s).alias("seed"), split_of(F.col(word), test_share, s).alias("split")) for s in seeds))
    return words.select("*", F.inline(sides))


def without_leaks(rows: DataFrame, split: str, key: str) -> DataFrame:
    """Training rows whose key (a token string) is that of no test row."""
    held_out = rows.where(F.col(split) == "test").select(key).distinct()
    return rows.where(F.col(split) == "train").join(held_out, key, "left_anti")


def trainable(entries: DataFrame, headword: str, conf: str, test_share: float = 0.2) -> DataFrame:
    """Words for made-up samples: letters only, graded A or B, and not in the test side of the default seed, whatever seed a run uses."""
    return entries.where(F.col(headword).rlike("^[a-z]+$") & F.col(conf).isin("A", "B") & (split_of(F.col(headword), test_share) != "test"))


def sides(rows: DataFrame, word: str, copy_of: str, seed: str = "v0", test_share: float = 0.2) -> DataFrame:
    """rows with split; a copy of another row is never a test row, so it is left out where its word is one."""
    split = split_of(F.col(word), test_share, seed)
    return rows.withColumn("split", split).where((F.col("split") != "test") | F.col(copy_of).isNull())


# What random words are made of.
CONSONANTS = ["P", "B", "T", "D", "K", "G", "L", "R", "M", "N", "SH", "S", "CH", "TS", "TH", "KH", "HL", "LH", "H", "F", "V", "NG"]
VOWEL_TOKENS = ["A", "O", "OO", "E", "U", "OW", "WA", "WE", "WO"]
MOST_SYLLABLES, ONSET, CODA = 4, 0.8, 0.35


def random_tokens(key: Column, seed: int | str) -> Column:
    """Tokens of one to four random syllables, a consonant before the vowel in 0.8 of them and one after it in 0.35; the same for the same key."""
    number = lambda *parts: uniform(F.concat_ws("/", key.cast("string"), *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts)), seed)
    one = lambda options, u: F.element_at(F.array(*map(F.lit, options)), (F.floor(u * len(options)) + 1).cast("int"))
    none = F.array().cast("array<string>")

    def syllable(i: Column) -> Column:
        before = F.when(number(i, "a") < ONSET, F.array(one(CONSONANTS, number(i, "b")))).otherwise(none)
        after = F.when(number(i, "d") < CODA, F.array(one(CONSONANTS, number(i, "e")))).otherwise(none)
        return F.concat(before, F.array(one(VOWEL_TOKENS, number(i, "c"))), after)

    return F.flatten(F.transform(F.sequence(F.lit(1), (F.floor(number("n") * MOST_SYLLABLES) + 1).cast("int")), syllable))
