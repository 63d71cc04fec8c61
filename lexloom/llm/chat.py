"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again after each turn. A rolling hash is kept over the turns of every conversation, and
one whose hash after its last turn is also the hash of a longer conversation after as many turns is a snapshot of that
one. An anti-join against those prefix hashes retains the maximal conversations; of equal ones the smallest id stays.
Only those are rendered, as ChatML.

The hash after n turns is the sum of the hashes of the first n turns, each taken with its position, role and text, in
two independent 64-bit sums. A sum needs no order within it, so a conversation of very many turns is summed in
blocks of BLOCK turns, and turns are numbered in range partitions, so that no task holds more than a part of a long one. Snapshots are told by an
aggregation by hash, so that a first turn that a third of all conversations share is one row for each task. Rendering
gathers a conversation in one row, as its output is one row.

Defined results: rows without a conversation id take no part; of rows that are equal in all four columns one counts;
turns are in order of turn number (null first), then role and text; a null role is `unknown`, a null text empty;
marker strings inside a text are broken up with a zero-width space, so that no text can start a turn; columns other
than the four are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BLOCK = 1_024
_SEEDS = ("a", "b")


def _cleaned(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls but of turn."""
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.where("conv_id IS NOT NULL")


def positions(conversations: DataFrame) -> DataFrame:
    """(conv_id, position from 1, length, block, a, b): distinct turns in their order, with two hashes for their role and text.

    Texts are shuffled only of turns that share number and role with another of their conversation. The order is that of
    a table in range partitions, so that a conversation of any length, even of one turn number, is split.
    """
    rows, keys = _cleaned(conversations), ["conv_id", "turn", "role"]
    hashes = [F.xxhash64(F.lit(s), "role", "text").alias(s) for s in _SEEDS]
    groups = checkpointed(rows.select(*keys, *hashes).groupBy(*keys).agg(*(F.min(s).alias(s) for s in _SEEDS), F.expr("min(a) <> max(a) OR min(b) <> max(b)").alias("tied")))
    turns = groups.where("NOT tied").select(*keys, F.lit("").alias("text"), *_SEEDS)
    if not (tied := groups.where("tied").select(*keys)).isEmpty():
        same = [rows["conv_id"] == tied["conv_id"], rows["turn"].eqNullSafe(tied["turn"]), rows["role"] == tied["role"]]
        turns = turns.unionAll(rows.join(tied, same, "left_semi").distinct().select(*keys, "text", *hashes))
    ordered = turns.repartitionByRange(*keys, "text").sortWithinPartitions(*keys, "text")
    # the numbers of a partition's rows follow each other, with the number of the partition from bit 33
    placed = checkpointed(ordered.select("conv_id", F.monotonically_increasing_id().alias("place"), *_SEEDS)).withColumn("task", F.shiftright("place", 33))
    tasks = placed.groupBy("conv_id", "task").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    every = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(every.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = tasks.select("conv_id", "task", (before + 1 - F.col("first")).alias("shift"), F.sum("n").over(every).alias("length"))
    return placed.join(offsets, ["conv_id", "task"]).select("conv_id", (F.col("place") + F.col("shift")).alias("position"), "length", *_SEEDS).withColumn("block", F.floor((F.col("position") - 1) / BLOCK))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, length, a, b): two hashes of the first n turns, for each n."""
    hashed = turns.select("conv_id", "position", "length", "block", *(F.xxhash64("position", s).cast("decimal(38,0)").alias(s) for s in _SEEDS))
    inner = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("conv_id", "block").agg(*(F.sum(s).alias(f"{s}_block") for s in _SEEDS))
    before = sums.select("conv_id", "block", *(F.coalesce(F.sum(f"{s}_block").over(outer), F.lit(0)).alias(f"{s}_before") for s in _SEEDS))
    rolled = hashed.select("conv_id", "block", "position", "length", *(F.sum(s).over(inner).alias(s) for s in _SEEDS)).join(before, ["conv_id", "block"])
    return rolled.select("conv_id", F.col("position").alias("n"), "length", *((F.col(s) + F.col(f"{s}_before")).cast("decimal(38,0)").alias(s) for s in _SEEDS))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that no other one continues; n_copies counts equal ones dropped for this one."""
    hashes = prefix_hashes(turns)
    continued = hashes.where("n < length").select("n", *_SEEDS).distinct()
    whole = hashes.where("n = length").groupBy("n", *_SEEDS).agg(F.min("conv_id").alias("conv_id"), (F.count("*") - 1).alias("n_copies"))
    return whole.join(continued, ["n", *_SEEDS], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(conversations: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept conversations (conv_id, ...) with their turns as ChatML. Their texts are shuffled once: parts are joined first, then the few parts of each."""
    safe = lambda c: F.replace(F.replace(c, F.lit(OPEN), F.lit("<|\u200bim_start|>")), F.lit(CLOSE), F.lit("<|\u200bim_end|>"))
    line = lambda t: F.concat(F.lit(OPEN), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(CLOSE + "\n"))
    part = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62)))
    own = _cleaned(conversations).join(kept.select("conv_id"), "conv_id", "left_semi").withColumn("part", part)
    parts = own.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    blocks = parts.select("conv_id", "part", F.array_join(F.transform("turns", line), "").alias("text"))
    texts = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts")).select("conv_id", F.array_join(F.col("parts.text"), "").alias("rendered"))
    return kept.join(texts, "conv_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the maximal conversations, rendered."""
    conversations = table(spark, sf_dir, "conversations")
    return render(conversations, checkpointed(maximal(positions(conversations)))).select("conv_id", "n_turns", "n_copies", "rendered")


ORACLE = """
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), prefixes AS (
  SELECT conv_id, position, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(concat(role, chr(1), text), chr(2)) OVER (PARTITION BY conv_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS prefix
  FROM turns
), whole AS (
  SELECT min(conv_id) AS conv_id, n, prefix, count(*) - 1 AS n_copies FROM prefixes WHERE position = n GROUP BY n, prefix
), kept AS (
  SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.position < p.n AND p.position = whole.n AND p.prefix = whole.prefix)
)
SELECT k.conv_id, k.n AS n_turns, k.n_copies, string_agg(concat('<|im_start|>',
  replace(replace(t.role, '<|im_start|>', '<|' || chr(8203) || 'im_start|>'), '<|im_end|>', '<|' || chr(8203) || 'im_end|>'), chr(10),
  replace(replace(t.text, '<|im_start|>', '<|' || chr(8203) || 'im_start|>'), '<|im_end|>', '<|' || chr(8203) || 'im_end|>'),
  '<|im_end|>', chr(10)), '' ORDER BY t.position) AS rendered
FROM kept k JOIN turns t USING (conv_id) GROUP BY k.conv_id, k.n, k.n_copies
"""
