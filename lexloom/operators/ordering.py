"""Numbering, sharding, sampling, ranking and batching of ordered rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .folds import folded


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "n") -> DataFrame:
    """Rows with their 1-based place within a key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def positions(rows: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Rows with their 0-based place in the whole table, without one task for all rows: places within range partitions, and the sizes of the partitions before."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits of the id count the rows of a partition, the upper ones are its number
    placed = checkpointed(sorted_rows.withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftrightunsigned("__id", 33))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each partition
    return placed.join(F.broadcast(before), "__part").select(*rows.columns, (F.col("__before") + F.col("__id").bitwiseAND(2**33 - 1)).alias(name))


def subset(tables: list[DataFrame], order: list[str], places: DataFrame | None = None) -> DataFrame:
    """The rows of the tables, one after the other, with their 0-based place; of these only `places` (pos) if given."""
    from .similarity import union_in_order

    placed = positions(union_in_order(*tables), ["list_no", *order])
    return placed if places is None else placed.join(places.select("pos").distinct(), "pos", "left_semi")


def shard(rows: DataFrame, keys: list[str], order: list, start: int, step: int) -> DataFrame:
    """Every step-th row of each key, beginning with the row at place `start` from 0."""
    n = F.col("__n") - 1
    return numbered(rows, keys, order, "__n").where((n >= start) & (F.pmod(n - start, F.lit(step)) == 0)).drop("__n")


def top(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; Catalyst limits each partition before the shuffle."""
    return numbered(rows, keys, order, "__n").where(F.col("__n") <= k).drop("__n")


def uniform(key: Column, seed: int | str) -> Column:
    """A number from 0 up to 1 for each key, from an MD5 digest, the same for any partitioning and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def sample(rows: DataFrame, key: Column, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement: those with the smallest numbers of their keys."""
    return rows.orderBy(uniform(key, seed), key).limit(k)


def weighted_sample(rows: DataFrame, key: str, weight: str, k: int, seed: int = 0, buckets: int = 256) -> DataFrame:
    """(draw, key): k draws with replacement, each in proportion to the weights; rows without a positive weight are never drawn.

    Rows stand on a line in order of bucket and key, each as long as its weight; a draw takes the row it falls on. The
    ends of the buckets (a bounded number) are known first, so draws and rows meet by bucket and no task orders all.
    """
    rows = rows.where(F.col(weight) > 0).select(F.col(key).alias("key"), F.col(weight).cast("double").alias("w")).withColumn("bucket", F.floor(uniform(F.col("key"), "bucket") * buckets))
    sums = {r["bucket"]: r["w"] for r in rows.groupBy("bucket").agg(F.sum("w").alias("w")).collect()}
    ends, total = [], 0.0
    for b in range(buckets):
        total += sums.get(b, 0.0)
        ends.append(total)
    starts = F.array(*(F.lit(x) for x in [0.0, *ends]))
    draws = rows.sparkSession.range(k if total else 0).select(F.col("id").alias("draw"), (uniform(F.col("id"), seed) * total).alias("at")).withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("at"))).cast("bigint"))
    inside = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("bucket", (starts[F.col("bucket").cast("int")] + F.coalesce(F.sum("w").over(inside), F.lit(0.0))).alias("at"), "key", F.lit(None).cast("bigint").alias("draw"))
    line = placed.unionByName(draws.select("bucket", "at", F.lit(None).cast(dict(placed.dtypes)["key"]).alias("key"), "draw"))
    before = Window.partitionBy("bucket").orderBy("at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("key", F.last("key", ignorenulls=True).over(before)).where("draw IS NOT NULL").select("draw", F.col("key").alias(key))


def width_batches(rows: DataFrame, keys: list[str], id_col: str, width: str, most: int, most_area: int) -> DataFrame:
    """(keys, id, batch): by increasing width, a batch is closed when it holds `most` rows, or one more would make rows x widest exceed most_area."""

    def begin() -> Callable[[float], int]:
        batch = held = 0

        def step(w: float) -> int:
            nonlocal batch, held
            # rows come by width, so the new one is the widest
            if held and (held == most or (held + 1) * w > most_area):
                batch, held = batch + 1, 0
            held += 1
            return batch

        return step

    return folded(rows.select(*keys, id_col, width), keys, [width, id_col], [width], "batch", "int", begin).select(*keys, id_col, "batch")


def bucketed_batches(rows: DataFrame, id_col: str, width: str, batch: int, pool: int, seed: int = 0) -> DataFrame:
    """(id, pool, batch, place): rows shuffled into pools of about pool * batch rows, sorted by width within a pool, cut into batches; place: where the batch comes in the random order of all batches."""
    pools = F.greatest(F.lit(1), F.ceil(F.lit(rows.count()) / (pool * batch))).cast("bigint")
    dealt = rows.select(id_col, width, F.floor(uniform(F.col(id_col), seed) * pools).alias("pool"))
    cut = numbered(dealt, ["pool"], [width, id_col], "__n").select(id_col, "pool", F.floor((F.col("__n") - 1) / batch).alias("batch"))
    return cut.withColumn("place", uniform(F.concat_ws("/", F.col("pool").cast("string"), F.col("batch").cast("string")), seed + 1))
