"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are placed by decreasing length into the open bin that they leave with the least room. A bin carries bitmaps
of its sources and duplicate clusters and takes no second document of either. Open bins are kept by residual, and a
bitmap of the residuals in use leads to the successor of a length; the search goes on to the next residual until a bin
fits that holds neither. For keys that many documents of a shard share, a bitmap tells at once at which residuals a bin
without the key exists, so that a hot source doesn't scan the bins that it is already in.

A document longer than a bin fills whole bins of its own first; what remains is placed as a document of that length.

Shards of about SHARD_DOCS documents are packed by themselves, dealt out by a hash of the row's number, so that hot
sources and clusters are spread evenly and memory is bounded; only ids, lengths and hashes are shuffled. The numbered
items are checkpointed, so that a lost task packs the same shard again. Row numbers follow the files, so the same rows in
other files fall into other shards and bins.

Defined results: a null source or cluster conflicts with nothing; a document without length (null or empty text) is in
no bin (bin_id null, piece 0); repeated rows are placed each, and never in one bin if they share source or cluster;
equal lengths are placed by id; of bins with equal residuals the one that has had it longest is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

CAPACITY, SHARD_DOCS = 2_048, 8_192
#: Keys of a shard that have a bitmap of residuals, if so many of its documents share them.
HOT_KEYS, HOT_DOCS = 48, 48


class Bins:
    """Open bins by residual. hot: conflict keys that get a bitmap of residuals."""

    def __init__(self, capacity: int, hot: Sequence[int] = ()):
        self.capacity = capacity
        self.left: list[int] = []
        self.keys: list[int] = []  # bitmap of the sources and clusters of each bin
        self.at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]  # residual -> bins, in order of arrival
        self.used = 0  # bitmap of residuals with a bin
        self.hot = {key: i for i, key in enumerate(hot)}
        self.hot_bits = [1 << key for key in hot]
        self.without = [[0] * (capacity + 1) for _ in hot]  # how many bins of a residual lack the key
        self.free = [0] * len(hot)  # bitmap of residuals with a bin that lacks the key

    def _move(self, number: int, was: int | None, keys_before: int) -> None:
        now, keys = self.left[number], self.keys[number]
        if was is not None:
            del self.at[was][number]
            if not self.at[was]:
                self.used &= ~(1 << was)
        if now:
            self.at[now][number] = None
            self.used |= 1 << now
        for i, bit in enumerate(self.hot_bits):
            counts = self.without[i]
            if was is not None and not keys_before & bit:
                counts[was] -= 1
                if not counts[was]:
                    self.free[i] &= ~(1 << was)
            if now and not keys & bit:
                counts[now] += 1
                if counts[now] == 1:
                    self.free[i] |= 1 << now

    def place(self, length: int, keys: Sequence[int]) -> tuple[int, int]:
        """(bin, offset in it) of the tightest open bin that has room and none of the keys, or of a new one."""
        wanted, open_ = 0, self.used >> length
        for key in keys:
            wanted |= 1 << key
            if key in self.hot:
                open_ &= self.free[self.hot[key]] >> length
        base = length
        while open_:
            step = (open_ & -open_).bit_length() - 1
            base += step
            for number in self.at[base]:
                if not self.keys[number] & wanted:
                    before = self.keys[number]
                    self.left[number] -= length
                    self.keys[number] |= wanted
                    self._move(number, base, before)
                    return number, self.capacity - base
            open_ >>= step + 1
            base += 1
        self.left.append(self.capacity - length)
        self.keys.append(wanted)
        self._move(len(self.left) - 1, None, 0)
        return len(self.left) - 1, 0


def pack_shard(lengths: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(item, piece, start in the item, length, bin, offset in the bin) of items that are in order of placement but for their remainders."""
    shared = Counter(("source", x) for x in sources if x is not None) + Counter(("cluster", x) for x in clusters if x is not None)
    numbers = {key: i for i, key in enumerate(key for key, n in shared.items() if n > 1)}
    hot = [numbers[key] for key, n in shared.most_common(HOT_KEYS) if n >= HOT_DOCS]
    bins, out = Bins(capacity, hot), []
    keys = [[numbers[key] for key in (("source", s), ("cluster", c)) if key in numbers] for s, c in zip(sources, clusters, strict=True)]
    rest = []
    for item, length in enumerate(lengths):
        whole = length // capacity
        for piece in range(whole):
            number, offset = bins.place(capacity, keys[item])
            out.append((item, piece, piece * capacity, capacity, number, offset))
        if length % capacity:
            rest.append((-(length % capacity), item, whole))
    for short, item, piece in sorted(rest):
        number, offset = bins.place(-short, keys[item])
        out.append((item, piece, piece * capacity, -short, number, offset))
    return out


def pack(items: DataFrame, id_col: str = "doc_id", source_col: str = "source", cluster_col: str = "cluster", length_col: str = "length", capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(id_col, piece, start, length, bin_id, bin_offset): where each piece of each item goes. bin_id: shard and bin."""
    kind = dict(items.dtypes)[id_col]
    text = lambda c: F.col(c).cast("string")
    rows = checkpointed(items.select(F.col(id_col).alias("id"), text(source_col).alias("source"), text(cluster_col).alias("cluster"), F.coalesce(F.col(length_col).cast("bigint"), F.lit(0)).alias("length"), F.monotonically_increasing_id().alias("row")))
    shards = max(1, -(-rows.count() // shard_docs))
    dealt = rows.where("length > 0").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def task(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("id", "ascending"), ("row", "ascending")])
        placed = pack_shard(shard["length"].to_pylist(), shard["source"].to_pylist(), shard["cluster"].to_pylist(), capacity)
        columns = np.array(placed, np.int64).reshape(-1, 6).T
        number = shard["shard"][0].as_py()
        return pa.table(
            {
                "id": shard["id"].take(pa.array(columns[0])),
                "piece": pa.array(columns[1], pa.int32()),
                "start": pa.array(columns[2]),
                "length": pa.array(columns[3]),
                "bin_id": pa.array([f"{number}-{b}" for b in columns[4].tolist()], pa.string()),
                "bin_offset": pa.array(columns[5]),
            }
        )

    packed = dealt.groupBy("shard").applyInArrow(task, f"id {kind}, piece int, start bigint, length bigint, bin_id string, bin_offset bigint")
    nothing = F.lit(None)
    empty = rows.where("length = 0").select("id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("length"), nothing.cast("string").alias("bin_id"), nothing.cast("bigint").alias("bin_offset"))
    return packed.unionAll(empty).withColumnRenamed("id", id_col)


def items_of(docs: DataFrame) -> DataFrame:
    """Documents as items: their length in words, and exact copies (but for case) as a cluster."""
    return docs.select("doc_id", "source", F.xxhash64(F.lower("text")).alias("cluster"), F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).alias("length"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the bins of all documents."""
    return pack(items_of(table(spark, sf_dir, "documents")))
