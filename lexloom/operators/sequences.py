"""Ordered rows: gap groups, runs, fills, segments, and folds that depend on their own decisions.

What a window can express is a window. Folds whose next step depends on the last decision read a key's rows in order,
as a stream (see folds.py); only merge_fold holds a key, which is a line.
"""

from __future__ import annotations

import math
import sys
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded


def _window(keys: list[str], order: list):
    return Window.partitionBy(*keys).orderBy(*order)


def gap_groups(rows: DataFrame, keys: list[str], order: list, position: Column, threshold: Column, name: str = "group_no") -> DataFrame:
    """Rows with the number (from 0) of their group: a new one begins where the distance to the row before exceeds the threshold.

    On a line, the nearest member of a group is the last one, so one lag is enough.
    """
    w = _window(keys, order)
    gap = position - F.lag(position).over(w)
    return rows.withColumn(name, F.sum(F.when(gap > threshold, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gap_groups_2d(rows: DataFrame, keys: list[str], order: str, x: str, y: str, threshold: float, name: str = "group_no") -> DataFrame:
    """The same in the plane: a point farther than the threshold from every member of the current group begins a new one."""

    def begin() -> Callable[[float, float], int]:
        members: list[tuple[float, float]] = []
        number = 0

        def step(px: float, py: float) -> int:
            nonlocal number
            if members and not any(math.hypot(px - a, py - b) <= threshold for a, b in reversed(members)):
                members.clear()
                number += 1
            members.append((px, py))
            return number

        return step

    return folded(rows, keys, [order], [x, y], name, "int", begin)


def segments(rows: DataFrame, keys: list[str], order: list, starts: Column, text: Column) -> DataFrame:
    """(keys, segment, head, body, n): each start row with the texts of the rows up to the next start. Rows before the first start are left out."""
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("__text", text).withColumn("__start", F.coalesce(starts, F.lit(False))).withColumn("segment", F.sum(F.col("__start").cast("int")).over(w)).where("segment > 0")
    # the order is made one struct, which sorts as the columns do
    gathered = numbered.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], "__start", "__text"))).alias("all"))
    return gathered.select(*keys, "segment", F.col("all")[0]["__text"].alias("head"), F.array_join(F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), lambda r: r["__text"]), " ").alias("body"), F.size("all").alias("n"))


def fill_forward(rows: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to each row: ditto marks, page numbers."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def runs(rows: DataFrame, keys: list[str], order: list, value: str, place: str = "__place") -> DataFrame:
    """(keys, value, first, last, n): runs of rows with equal values that follow each other."""
    w = _window(keys, order)
    placed = rows.withColumn(place, F.row_number().over(w)).withColumn("__run", F.col(place) - F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order)))
    return placed.groupBy(*keys, value, "__run").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).drop("__run")


def interval_runs(rows: DataFrame, keys: list[str], place: str, wanted: Column, min_length: int = 1, max_gap: int = 0) -> DataFrame:
    """(keys, first, last): stretches of wanted places (integers) with holes of at most max_gap, at least min_length long."""
    w = _window(keys, [place])
    hits = rows.where(wanted).withColumn("__new", F.when(F.col(place) - F.lag(place).over(w) - 1 > max_gap, 1).otherwise(0))
    joined = hits.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*keys, "__run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("last") - F.col("first") + 1 >= min_length).drop("__run")


def neighbour_kinds(rows: DataFrame, keys: list[str], order: list, kind: str, name: str = "kind_by_neighbours") -> DataFrame:
    """first / last for the ends of a key; isolated where both neighbours have another kind that they share; else the kind."""
    w = _window(keys, order)
    before, after = F.lag(kind).over(w), F.lead(kind).over(w)
    isolated = (before == after) & (before != F.col(kind))
    return rows.withColumn(name, F.when(before.isNull(), "first").when(after.isNull(), "last").when(isolated, "isolated").otherwise(F.col(kind)))


def smooth_labels(labels: Column) -> Column:
    """An array of labels in which a label between two equal others becomes like them, from left to right in place."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        before, after = F.get(a["done"], a["i"] - 1), F.get(labels, a["i"] + 1)
        value = F.when(before.isNotNull() & after.isNotNull() & (before == after) & (x != before), before).otherwise(x)
        return F.struct(F.concat(a["done"], F.array(value)).alias("done"), (a["i"] + 1).alias("i"))

    return F.aggregate(labels, start, step, lambda a: a["done"])


def close_runs(rows: DataFrame, keys: list[str], left: str, right: str, most_gap: Column, least: int, member: Column | None = None, base: str | None = None, tolerance: float = 0, share: float = 0.7) -> DataFrame:
    """(keys, run, n, left, right): runs of at least `least` pieces, each beginning at most most_gap after the farthest right edge so far.

    A piece that isn't a member ends a run. base: a column of which at least a `share` must be within `tolerance` of its
    median, such as a common baseline.
    """
    w = _window(keys, [left, right])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(member, F.lit(False)) if member is not None else F.lit(True)
    blocks = rows.withColumn("__own", own).withColumn("__block", F.sum((~F.col("__own")).cast("int")).over(upto)).where("__own")
    v = _window([*keys, "__block"], [left, right])
    edge = F.max(right).over(v.rowsBetween(Window.unboundedPreceding, -1))
    marked = blocks.withColumn("__new", F.when(edge.isNull() | (F.col(left) - edge > most_gap), 1).otherwise(0))
    numbered = marked.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    measures = [F.count("*").alias("n"), F.min(left).alias(left), F.max(right).alias(right)]
    if base:
        numbered = numbered.withColumn("__mid", F.median(base).over(Window.partitionBy(*keys, "run")))
        measures.append(F.avg(F.when(F.abs(F.col(base) - F.col("__mid")) <= tolerance, 1.0).otherwise(0.0)).alias("__level"))
    found = numbered.groupBy(*keys, "run").agg(*measures).where(F.col("n") >= least)
    return found.where(F.col("__level") >= share).drop("__level") if base else found


def merge_fold(rows: DataFrame, keys: list[str], left: str, right: str, score: str, joined: Callable[[np.ndarray], float], most_gap: float, most: int = 3) -> DataFrame:
    """(keys, unit, first, last, n, best): pieces of a line joined greedily from the left.

    A piece joins the group if its gap to the group's right edge is below most_gap, the group has fewer than `most`
    pieces, and the score of the joined group, joined(scores of its pieces), is below the sum of the group's score and
    the piece's. A null score is infinite: it joins whatever makes a finite whole. One pass per line; the state is the open group.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([left, right], kind="stable")
        pieces = list(zip(group[left], group[right], group[score].fillna(np.inf), strict=True))
        units: list[list] = []
        for a, b, s in pieces:
            if units:
                unit = units[-1]
                if a - unit[1] < most_gap and len(unit[3]) < most:
                    both = joined(np.array([*unit[3], s]))
                    if both < unit[2] + s:
                        units[-1] = [unit[0], max(unit[1], b), both, [*unit[3], s]]
                        continue
            units.append([a, b, s, [s]])
        key = group[keys].iloc[0].to_dict()
        return pd.DataFrame([{**key, "unit": i, "first": u[0], "last": u[1], "n": len(u[3]), "best": None if np.isinf(u[2]) else u[2]} for i, u in enumerate(units)])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", unit int, first {kinds[left]}, last {kinds[right]}, n int, best double"
    return rows.select(*keys, left, right, score).groupBy(*keys).applyInPandas(fold, schema)


def page_numbers(numbers: Column, heads: Column, low: int = 0, high: int = 999, start: int = 1, step: int = 3) -> Column:
    """The page of each line from arrays of what was read: a plausible head number (up to `step` ahead) is taken, any other head counts one up."""
    state = F.struct(F.array().cast("array<int>").alias("pages"), F.lit(start).alias("now"), F.lit(0).alias("i"))

    def feed(a: Column, number: Column) -> Column:
        plausible = number.isNotNull() & (number > a["now"]) & (number <= a["now"] + step) & number.between(low, high)
        now = F.when(~F.get(heads, a["i"]), a["now"]).when(plausible, number).otherwise(a["now"] + 1)
        return F.struct(F.concat(a["pages"], F.array(now)).alias("pages"), now.alias("now"), (a["i"] + 1).alias("i"))

    return F.aggregate(numbers, state, feed, lambda a: a["pages"])


def in_alphabetical_order(rows: DataFrame, keys: list[str], order: str, head: str, last: int = 5, ahead: int = 4) -> DataFrame:
    """Rows whose first letter is plausible: between the least of the last accepted letters of its key and `ahead` letters after the greatest."""

    def begin() -> Callable[[str | None], bool]:
        window: deque[int] = deque(maxlen=last)
        lowest, highest = 0, sys.maxunicode

        def step(word: str | None) -> bool:
            nonlocal lowest, highest
            letter = ord(word[0]) if word else 0
            if letter < lowest or letter > highest:
                return False
            window.append(letter)
            lowest, highest = min(window), max(window) + ahead
            return True

        return step

    return folded(rows, keys, [order], [head], "__plausible", "boolean", begin).where("__plausible").drop("__plausible")


def text_lines(words: DataFrame, keys: list[str], x: str, y: str, tolerance: float) -> DataFrame:
    """words with line_no: words by y join the line whose running mean is within the tolerance, else begin one; lines are read left to right."""

    def begin() -> Callable[[float], int]:
        number, n, mean = -1, 0, 0.0

        def step(at: float) -> int:
            nonlocal number, n, mean
            if number < 0 or abs(at - mean) > tolerance:
                number, n, mean = number + 1, 0, 0.0
            n += 1
            mean += (at - mean) / n
            return number

        return step

    return folded(words, keys, [y, x], [y], "line_no", "int", begin)


def text_line_numbers(lines: DataFrame, keys: list[str], order: list, is_text: Column, name: str = "number") -> DataFrame:
    """lines with the 1-based number of each text line in its order; other lines have none."""
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.when(is_text, F.count_if(is_text).over(w)))


def words_in_lines(segments: DataFrame, crops: DataFrame, readings: DataFrame, page: list[str]) -> DataFrame:
    """Words of text lines that have an image and a reading, by their left edge, with the gap to the farthest right edge before.

    segments: (page, line, index, line_kind, word_kind, x0, x1); crops, readings: (page, line, index, ...).
    """
    on = [*page, "line", "index"]
    found = segments.where("line_kind = 'text' AND word_kind = 'word'").join(crops, on).join(readings, on)
    w = _window([*page, "line"], ["x0", "index"])
    return found.withColumn("place", F.row_number().over(w)).withColumn("gap", F.col("x0") - F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1)))


def dehyphenated(text: Column) -> Column:
    """A word broken at the end of a line put together."""
    return F.regexp_replace(text, r"(?<=\w)-\s*\n\s*(?=[a-z])", "")


def nearest(rows: DataFrame, targets: DataFrame, key: str, at: str, target_at: str, target_id: str, most: float | None = None) -> DataFrame:
    """rows with the target of the same key that is nearest (ties: the one that comes first), and its distance.

    Nearest is the last target at or before a row or the first after it, so both tables are read once in order, without
    a join of every row with every target.
    """
    marks = targets.groupBy(key, F.col(target_at).cast("double").alias("__at")).agg(F.min(target_id).alias("__t")).withColumn("__row", F.lit(None).cast("struct<" + ",".join(f"`{c}`:{t}" for c, t in rows.dtypes) + ">"))
    both = rows.select(key, F.col(at).cast("double").alias("__at"), F.lit(None).cast(dict(targets.dtypes)[target_id]).alias("__t"), F.struct(*rows.columns).alias("__row")).unionByName(marks)
    mark = F.when(F.col("__t").isNotNull(), F.struct("__at", "__t"))
    w = Window.partitionBy(key).orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    v = Window.partitionBy(key).orderBy("__at").rangeBetween(0, Window.unboundedFollowing)
    seen = both.withColumn("__before", F.max(mark).over(w)).withColumn("__after", F.min(mark).over(v)).where("__row IS NOT NULL")
    back, ahead = F.col("__at") - F.col("__before.__at"), F.col("__after.__at") - F.col("__at")
    use_back = F.col("__before").isNotNull() & (F.col("__after").isNull() | (back <= ahead))
    found = seen.select("__row.*", F.when(use_back, F.col("__before.__t")).otherwise(F.col("__after.__t")).alias("target"), F.when(use_back, back).otherwise(ahead).alias("distance"))
    if most is None:
        return found
    near = F.col("distance") <= most
    return found.withColumn("target", F.when(near, F.col("target"))).withColumn("distance", F.when(near, F.col("distance")))


def mapped_with_offset(rows: DataFrame, exceptions: DataFrame, key: str, value: str, offset: int) -> DataFrame:
    """rows with `mapped`: the exception's value of the key, or the key plus an offset."""
    return rows.join(exceptions.select(key, F.col(value).alias("__v")), key, "left").withColumn("mapped", F.coalesce("__v", F.col(key) + offset)).drop("__v")


def paired_by_place(a: Column, b: Column) -> Column:
    """Structs of the entries of two arrays, or null if they differ in length."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("a"), b.alias("b")))
