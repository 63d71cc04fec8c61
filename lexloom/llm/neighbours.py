"""Approximate nearest neighbours by largest inner product, with query-aware collision-counting hashing.

Vectors are scaled by the largest norm and given one more component that makes them unit vectors, so that the largest
inner product is the smallest distance. A block of vectors is projected on LINES random lines, each of which keeps one
sorted array of the block; the array is cut into CELLS runs of equal length, and for each cut a bit set tells which
vectors come before it. A query takes the CHOSEN lines on which it lies farthest out, where few strangers are beside
it. Its window on each of them is centred at its own projection; virtual rehashing widens the windows by GROWTH until
at least SHARE of the block (and enough to answer) collide with the query on a COLLISIONS part of its lines. A window
is the difference of two bit sets and the collisions are counted by adding bit sets, 64 vectors to a machine word, so
that a round costs less than the products of a query with the block. All that exceed the threshold, however many, are
verified: by products in single precision to leave out what can't be among the best, then in double precision.

Every vector is indexed. Blocks of about BLOCK vectors meet blocks of about QUERY_BLOCK queries by an equality join on
block numbers, so memory is bounded by those two, whatever the table; no other shuffle moves vectors. Each block
returns its best k for a query, and the best k of those is the answer. A lost task is simply run again. As the queries
are a fixed part of the rows, work grows with rows times queries; its unit is a bit operation.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, as query or as
candidate, nor do rows without an id; rows equal in id and vector count once, and rows that share only the id are
candidates each, also for each other, and queries each; only vectors of the same length are compared; equal scores go
to the smaller id; a query with fewer candidates than k gets all of them; a product beyond the range of doubles is
infinite, and one whose terms overflow both ways counts as minus infinity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

NEAREST, EVERY = 20, 20
LINES, CHOSEN, CELLS = 256, 64, 64
COLLISIONS, SHARE, FIRST, GROWTH = 0.5, 0.05, 1.0, 1.12
#: Vectors of a block that are verified at least.
LEAST_VERIFIED = 400
BLOCK, QUERY_BLOCK = 16_384, 16_384
#: Queries that are counted at a time; what sets the lines apart in one array.
TOGETHER, APART = 16, 8.0


def lines(size: int, many: int = LINES) -> np.ndarray:
    """(size, many) unit vectors, orthogonal within each run of `size`."""
    rng = np.random.default_rng(11)
    return np.concatenate([np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(-(-many // size))], axis=1)[:, :many]


def at_least(sets: np.ndarray, threshold: int) -> np.ndarray:
    """Bits that are set in at least `threshold` of the bit sets along the first axis, by carry-save addition."""
    planes, weight = [], sets
    while len(weight):
        carries = []
        while len(weight) > 1:
            k = max(1, len(weight) // 3)
            a, b, c = weight[:k], weight[k : 2 * k], weight[2 * k : 3 * k]
            half = a ^ b
            if len(c):
                carries.append((a & b) | (half & c))
                half ^= c
            else:
                carries.append(a & b)
            rest = weight[3 * k :] if len(c) else weight[2 * k :]
            weight = np.concatenate((half, rest)) if len(rest) else half
        planes.append(weight[0])
        weight = np.concatenate(carries) if carries else weight[:0]
    if threshold >= 1 << len(planes):
        return np.zeros_like(sets[0])
    more, equal = np.zeros_like(sets[0]), ~np.zeros_like(sets[0])
    for i in range(len(planes) - 1, -1, -1):
        if threshold >> i & 1:
            equal &= planes[i]
        else:
            more |= equal & planes[i]
            equal &= ~planes[i]
    return more | equal


class Index:
    """The sorted arrays of a block of unit vectors (n, size)."""

    def __init__(self, points: np.ndarray, turn: np.ndarray):
        n, many = len(points), turn.shape[1]
        self.n, self.cells = n, min(CELLS, n)
        self.starts = np.arange(self.cells + 1) * n // self.cells  # ranks at which cells begin
        words = -(-n // 64)
        edges = np.empty((many, self.cells))
        self.before = np.zeros((many, self.cells + 1, words), np.uint64)  # which vectors are in earlier cells
        cell = np.repeat(np.arange(self.cells), np.diff(self.starts))
        placed = points @ turn
        self.spread = float(placed.std()) or 1.0
        for k in range(0, many, 16):
            own = placed[:, k : k + 16].T.astype(np.float32)
            order = np.argsort(own, axis=1)
            sorted_ = np.take_along_axis(own, order, axis=1)
            edges[k : k + 16] = sorted_[:, self.starts[:-1]]
            held = np.zeros((len(own), self.cells, 64 * words), bool)
            held[np.arange(len(own))[:, None], cell[None, :], order] = True
            self.before[k : k + 16, 1:] = np.bitwise_or.accumulate(np.packbits(held, axis=2, bitorder="little").view(np.uint64), axis=1)
        self.edges = (edges + APART * np.arange(many)[:, None]).ravel()  # of all lines in one order, as no place is beyond 1

    def colliding(self, chosen: np.ndarray, centres: np.ndarray, width: float, threshold: int) -> np.ndarray:
        """Bit sets of the vectors that collide with each query on `threshold` of its lines. chosen, centres: (query, line)."""
        line, first = APART * chosen, self.cells * chosen
        # the cells that the window touches: from the last that begins before it to the last that begins in it
        low = np.maximum(np.searchsorted(self.edges, np.maximum(centres - width, -2) + line) - first - 1, 0)
        high = np.searchsorted(self.edges, np.minimum(centres + width, 2) + line, side="right") - first
        return at_least((self.before[chosen, high] ^ self.before[chosen, low]).swapaxes(0, 1), threshold)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, largest: float, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, id, score) of the best k of the block for each query, nearest first."""
    n, size = vectors.shape
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    scaled = vectors / largest
    extra = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
    turn = lines(size + 1)
    index = Index(np.column_stack((scaled, extra)), turn)
    scaled = scaled.astype(np.float32)
    slack = (size + 8) * 2.0**-22
    most = np.abs(queries).max(axis=1, keepdims=True)
    unit = queries / most
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    centres = unit @ turn[:-1]
    chosen = np.argpartition(-np.abs(centres), min(CHOSEN, centres.shape[1]) - 1, axis=1)[:, :CHOSEN]
    centres = np.take_along_axis(centres, chosen, axis=1)
    unit = unit.astype(np.float32)
    threshold, wanted = int(np.ceil(COLLISIONS * chosen.shape[1])), min(n, k + max(LEAST_VERIFIED, int(SHARE * n)))

    def verified(q: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = np.flatnonzero(ids[near] == query_ids[q])
        own = same[(vectors[near[same]] == queries[q]).all(axis=1)]
        if len(own):
            near = np.delete(near, own)
        if len(near) > k:
            about = scaled[near] @ unit[q]
            near = near[about >= np.partition(about, -k)[-k] - slack]
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.einsum("ij,j->i", vectors[near], queries[q])  # row by row in one order, so that equal vectors have equal scores
        score[np.isnan(score)] = -np.inf
        first = np.lexsort((ids[near], -score))[:k]
        return ids[near][first], score[first]

    best: list = [None] * len(queries)
    begin = FIRST * index.spread
    for start in range(0, len(queries), TOGETHER):
        open_, width, ended = np.arange(start, min(start + TOGETHER, len(queries))), begin, []
        while len(open_):
            found = index.colliding(chosen[open_], centres[open_], width, threshold)
            enough = np.bitwise_count(found).sum(axis=1, dtype=np.int64) >= wanted
            for q, bits in zip(open_[enough].tolist(), found[enough], strict=True):
                best[q] = verified(q, np.flatnonzero(np.unpackbits(bits.view(np.uint8), count=n, bitorder="little")))
                ended.append(width)
            open_, width = open_[~enough], width * GROWTH
        # the next queries begin a step before the first of these was done
        begin = max(FIRST * index.spread, min(ended) / GROWTH)
    if not best:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.repeat(np.arange(len(best)), [len(v) for v, _ in best]), np.concatenate([v for v, _ in best]), np.concatenate([s for _, s in best])


def usable(column: Column) -> Column:
    """Whether a vector is neither null nor zero and holds only finite components."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return column.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(column, lambda x: x != 0), F.lit(False))


def _read(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors in the order of both, each of them once."""
    vectors = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    ids = rows["id"].to_numpy()
    if len(np.unique(ids)) == len(ids):
        order = np.argsort(ids)
        return ids[order], vectors[order]
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    again = (ids[1:] == ids[:-1]) & (vectors[1:] == vectors[:-1]).all(axis=1)
    first = np.concatenate(([True], ~again))
    return ids[first], vectors[first]


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every other vector, for each row where is_query (of the id) holds."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    # an upper bound will do where squares are beyond the range of doubles
    bound = F.least(F.lit(1.7e308), F.array_max(F.transform("vector", F.abs)) * F.sqrt(F.size("vector")))
    seen = rows.agg(F.count("*"), F.max(F.when(norm < float("inf"), norm).otherwise(bound)), F.count_if(is_query)).first()
    total, largest, asked = seen[0], seen[1] or 1.0, seen[2]
    blocks, query_blocks = max(1, -(-total // block)), max(1, -(-asked // query_block))
    # rows of one id are in one block, so that repeated rows are told there
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("size", F.size("vector"))
    data = rows.select("id", "vector", "size", dealt(blocks).alias("block"), every(query_blocks).alias("query_block"))
    queries = rows.where(is_query).select("id", "vector", "size", every(blocks).alias("block"), dealt(query_blocks).alias("query_block"))

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        asked, asked_ids, found, score = none, none, none, np.zeros(0)
        if left.num_rows and right.num_rows:
            (asked_ids, wanted), known = _read(right), _read(left)
            asked, found, score = search_block(*known, asked_ids, wanted, largest, k)
            twin = np.zeros(len(asked_ids), np.int32)  # the place of a query among those of its id
            for i in np.flatnonzero(asked_ids[1:] == asked_ids[:-1]):
                twin[i + 1] = twin[i] + 1
        else:
            twin = none.astype(np.int32)
        return pa.table({"query_id": pa.array(asked_ids[asked], pa.int64()), "twin": pa.array(twin[asked], pa.int32()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

    keys = ("size", "block", "query_block")
    found = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(task, "query_id bigint, twin int, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the 20 nearest of each vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % EVERY == 0)
