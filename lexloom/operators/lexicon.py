"""Word lists from many sources: de-duplication, merging, clusters, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import headword_key, skeleton
from .ordering import top
from .similarity import within_distance

#: Two-letter skeletons that more heads than this share tell nothing.
MOST_IN_CLUSTER = 8
#: Bounds of the lists of a merged row.
MOST_VARIANTS, MOST_GLOSSES, MOST_SIBLINGS = 14, 6, 10


def first_distinct(rows: DataFrame, keys: list[str], values: dict[str, Column], order: str, fold: dict[str, Column] | None = None, most: dict[str, int] | None = None) -> DataFrame:
    """For each key, an array of the distinct values of each name, in the order in which they come first.

    values: name -> value of a row (null or empty ones are left out); fold: name -> what makes values equal, if not the
    value itself (of equal ones the first is kept); most: name -> how many are kept. Values are made distinct by a
    partial aggregation, and ranked if they are bounded, before they are gathered, so a hot key gathers no more than that.
    """
    fold = fold or {}
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"), fold.get(n, v).cast("string").alias("same")) for n, v in values.items()))
    long = rows.select(*keys, F.col(order).alias("__ord"), F.explode(pairs).alias("__p")).where("__p.value <> ''")
    once = long.groupBy(*keys, F.col("__p.name").alias("__name"), F.col("__p.same").alias("__same")).agg(F.min(F.struct("__ord", "__p.value")).alias("__first"))
    if most:
        limits = F.create_map(*(F.lit(x) for pair in most.items() for x in pair))
        place = F.row_number().over(Window.partitionBy(*keys, "__name").orderBy("__first"))
        once = once.withColumn("__n", place).where(F.col("__n") <= F.coalesce(F.element_at(limits, F.col("__name")), F.lit(2**31 - 1)))
    gathered = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__first", "__name"))).alias("__all"))
    pick = lambda n: F.transform(F.filter("__all", lambda x: x["__name"] == n), lambda x: x["__first"]["value"])
    return gathered.select(*keys, *(pick(n).alias(n) for n in values))


def merge(entries: DataFrame) -> DataFrame:
    """One row for each headword: ordered distinct variants (other than the head), glosses and sources; any flag; the best grade."""
    lists = first_distinct(entries, ["headword"], {"variants": F.when(F.lower("head") != F.col("headword"), F.col("head")), "glosses": F.col("gloss"), "sources": F.col("source")}, "ord")
    facts = entries.groupBy("headword").agg(F.bool_or("flagged").alias("flagged"), F.min("conf").alias("best_conf"), F.count("*").alias("n_entries"))
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return facts.join(lists, "headword", "left").select("headword", "flagged", "best_conf", "n_entries", empty("variants"), empty("glosses"), empty("sources"), F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"))


def dedup_by_source(entries: DataFrame) -> DataFrame:
    """One row for each source and headword: ordered distinct spellings, glosses that differ in more than case, the first page, the number of entries."""
    lists = first_distinct(entries, ["source", "headword"], {"spellings": F.col("head"), "glosses": F.col("gloss")}, "ord", {"glosses": F.lower("gloss")})
    facts = entries.groupBy("source", "headword").agg(F.min_by("line_no", "ord").alias("page"), F.count("*").alias("n_raw"))
    return facts.join(lists, ["source", "headword"], "left")


def merge_graded(entries: DataFrame) -> DataFrame:
    """One row for each headword over graded entries, with bounded lists.

    The best grade and the spellings are over all entries; sources, glosses and the flag over those graded A or B.
    Siblings share the skeleton and have an A or B entry; sources of C entries alone are told in notes.
    """
    good = F.col("conf").isin("A", "B")
    lists = first_distinct(
        entries,
        ["headword"],
        {"variants": F.col("head"), "good_sources": F.when(good, F.col("source")), "weak_sources": F.when(~good, F.col("source")), "glosses": F.when(good, F.col("gloss"))},
        "ord",
        {"glosses": F.when(good, F.lower("gloss"))},
        {"variants": MOST_VARIANTS, "glosses": MOST_GLOSSES},
    )
    facts = entries.groupBy("headword").agg(F.min("conf").alias("best_conf"), F.coalesce(F.bool_or(F.col("flagged") & good), F.lit(False)).alias("flagged"), F.coalesce(F.bool_or(F.col("flagged") & ~good), F.lit(False)).alias("weak_flag"), F.count_if(good).alias("n_good"))
    rows = facts.join(lists, "headword").withColumn("skeleton", skeleton(F.col("headword")))
    # a head's siblings are among the first of its skeleton, itself left out
    place = F.row_number().over(Window.partitionBy("skeleton").orderBy("headword"))
    members = in_clusters(rows.where("n_good > 0").select("headword")).withColumn("__n", place).where(F.col("__n") <= MOST_SIBLINGS + 1).groupBy("skeleton").agg(F.array_sort(F.collect_list("headword")).alias("members"))
    weak = F.array_except("weak_sources", "good_sources")
    notes = F.concat_ws("; ", F.when(F.size(weak) > 0, F.concat(F.lit("unvalidated_candidates_in="), F.array_join(weak, "/"))), F.when(F.col("weak_flag") & ~F.col("flagged"), "flagged_candidate_only"))
    siblings = F.slice(F.array_remove(F.coalesce("members", F.array().cast("array<string>")), F.col("headword")), 1, MOST_SIBLINGS)
    return rows.join(members, "skeleton", "left").select(
        "headword", F.size("good_sources").alias("n_sources"), F.array_join("good_sources", "|").alias("sources"), "flagged", "best_conf", F.array_join(F.slice("variants", 1, MOST_VARIANTS), "|").alias("variants"),
        F.array_join(F.slice("glosses", 1, MOST_GLOSSES), " | ").alias("gloss"), "skeleton", F.array_join(siblings, "|").alias("siblings"), notes.alias("notes"),
    )


def clusters(heads: DataFrame) -> DataFrame:
    """(skeleton, members, n): single-word heads by skeleton; those of one letter, or of two with too many heads, are left out before they are gathered."""
    return in_clusters(heads).groupBy("skeleton").agg(F.array_sort(F.collect_list("headword")).alias("members"), F.count("*").alias("n"))


def in_clusters(heads: DataFrame) -> DataFrame:
    """(skeleton, headword) of the heads in clusters; counts members before anything is gathered."""
    keyed = heads.select("headword").distinct().where(~F.contains("headword", F.lit(" "))).withColumn("skeleton", skeleton(F.col("headword"))).where(F.length("skeleton") >= 2)
    short = keyed.where(F.length("skeleton") == 2)
    too_many = short.groupBy("skeleton").count().where(F.col("count") > MOST_IN_CLUSTER).select("skeleton")
    return keyed.where(F.length("skeleton") >= 3).unionByName(short.join(too_many, "skeleton", "left_anti")).select("skeleton", "headword")


def headwords(merged: DataFrame, flagged: bool | None = None, min_sources: int = 1, source: str | None = None, single: bool = False) -> DataFrame:
    """Headwords of merged rows by flag, number of sources and one source; single: words without a space only."""
    rows = merged.where(F.col("n_sources") >= min_sources)
    if flagged is not None:
        rows = rows.where(F.col("flagged") == flagged)
    if source is not None:
        rows = rows.where(F.array_contains("sources", source))
    if single:
        rows = rows.where(~F.contains("headword", F.lit(" ")))
    return rows.select("headword")


def lookup(queries: DataFrame, merged: DataFrame, variants: DataFrame) -> DataFrame:
    """queries (q) with the headword found: the key itself, or else the first head that lists it as a variant.

    variants: (variant, headword, ord). Both are equality joins; a small side is broadcast by its size.
    """
    keyed = queries.withColumn("__key", headword_key(F.col("q")))
    exact = merged.select(F.col("headword").alias("__key"), F.col("headword").alias("__exact"))
    listed = variants.select(headword_key(F.col("variant")).alias("__key"), "headword", "ord").where("__key <> '' AND __key <> headword")
    listed = listed.groupBy("__key").agg(F.min_by("headword", "ord").alias("__listed"))
    found = keyed.join(exact, "__key", "left").join(listed, "__key", "left")
    via = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__listed").isNotNull(), "variant")
    return found.select(*queries.columns, F.coalesce("__exact", "__listed").alias("headword"), via.alias("via"))


def fuzzy(queries: DataFrame, merged: DataFrame, max_dist: int = 2, limit: int = 5, flagged: bool | None = None, use_skeleton: bool = True) -> DataFrame:
    """(q, headword, distance, rank): the nearest headwords of each query, by distance, then number of sources, then headword.

    Heads with the same skeleton are at distance 1 at most. Candidates come from the deletion index, so both arms are
    equality joins.
    """
    keyed = queries.select("q", headword_key(F.col("q")).alias("key")).where("key <> ''").distinct()
    heads = merged.select("headword", "n_sources", "flagged")
    found = within_distance(keyed.select("key").distinct(), heads.select("headword"), "key", "headword", max_dist).select("key", "headword", "distance")
    if use_skeleton and max_dist >= 1:
        sounds = keyed.select("key").distinct().where(~F.contains("key", F.lit(" "))).withColumn("skeleton", skeleton(F.col("key"))).where(F.length("skeleton") >= 2)
        same = sounds.join(in_clusters(heads), "skeleton").select("key", "headword", F.lit(1).alias("distance"))
        found = found.unionByName(same)
    nearest = found.groupBy("key", "headword").agg(F.min("distance").alias("distance")).join(heads, "headword")
    if flagged is not None:
        nearest = nearest.where(F.col("flagged") == flagged)
    order = ["distance", F.desc("n_sources"), "headword"]
    ranked = top(nearest, ["key"], order, limit)
    from .ordering import numbered

    return keyed.join(numbered(ranked, ["key"], order, "rank"), "key").select("q", "headword", "distance", "rank")


def first_gloss(queries: DataFrame, merged: DataFrame, variants: DataFrame, gloss: str = "glosses") -> DataFrame:
    """queries (q) with the first gloss of the headword that they lead to; empty if they lead to none or it has none."""
    told = merged.select("headword", F.get(gloss, F.lit(0)).alias("__gloss"))
    return lookup(queries, merged, variants).join(told, "headword", "left").select(*queries.columns, F.coalesce("__gloss", F.lit("")).alias("gloss"))


def sound_keys(entries: DataFrame) -> DataFrame:
    """(source, key): what the heads of each source count as: their skeleton where it tells something, else the head itself."""
    pairs = entries.select("source", "headword").distinct()
    known = in_clusters(pairs.select("headword")).withColumnRenamed("skeleton", "__sk")
    return pairs.join(known, "headword", "left").select("source", F.coalesce("__sk", F.concat(F.lit("h:"), "headword")).alias("key")).distinct()


def overlap(entries: DataFrame, key: str = "headword") -> DataFrame:
    """(a, b, n_a, n_b, n_both): keys of each pair of sources that share one."""
    pairs = entries.select("source", F.col(key).alias("headword")).distinct()
    sizes = pairs.groupBy("source").agg(F.count("*").alias("n"))
    # the sources of a word are few; pairs are counted per word, without joining words with themselves
    sets = pairs.groupBy("headword").agg(F.array_sort(F.collect_list("source")).alias("s")).where(F.size("s") > 1)
    both = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode(F.filter("s", lambda x: x > F.col("a"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n_both"))
    return both.join(sizes.withColumnsRenamed({"source": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"source": "b", "n": "n_b"}), "b").select("a", "b", "n_a", "n_b", "n_both")
