"""Readings from log-probability matrices: greedy decoding, confidence, losses of candidates, ranked choices.

A matrix has a row for each frame and a column for each class; class 0 is the blank. What is a walk over one matrix is a
column expression; losses of many candidates are computed by the forward recursion over all candidates at once, in
Arrow batches, and only the best few leave the task. Candidate lists are bounded, checked and sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CANDIDATES = 200_000
#: Candidates whose losses are computed at a time.
CHUNK = 4_096


def log_softmax(frames: Column) -> Column:
    """Each row of a matrix as log probabilities."""

    def row(x: Column) -> Column:
        top = F.array_max(x)
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
        return F.transform(x, lambda v: v - top - F.log(total))

    return F.transform(frames, row)


def best_classes(frames: Column) -> Column:
    """The first most probable class of each frame."""
    return F.transform(frames, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def greedy(frames: Column) -> Column:
    """The best classes without repeats, then without blanks."""
    path = best_classes(frames)
    return F.filter(path, lambda c, i: (c != 0) & ((i == 0) | (c != F.get(path, i - 1))))


def confidence(frames: Column) -> Column:
    """Mean of the frames' highest probabilities."""
    return F.aggregate(frames, F.lit(0.0), lambda a, x: a + F.exp(F.array_max(x))) / F.size(frames)


def confidence_nonblank(frames: Column) -> Column:
    """The same over frames whose best class isn't the blank; 0 without any."""
    own = F.filter(frames, lambda x: F.array_position(x, F.array_max(x)) != 1)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.aggregate(own, F.lit(0.0), lambda a, x: a + F.exp(F.array_max(x))) / F.size(own))


def ctc_losses(logp: np.ndarray, targets: list[list[int]]) -> np.ndarray:
    """Negative log likelihood of each target: +inf where it has more classes and repeats than there are frames."""
    out = np.full(len(targets), np.inf)
    for start in range(0, len(targets), CHUNK):
        part = targets[start : start + CHUNK]
        longest = max(map(len, part), default=0)
        width = 2 * longest + 1
        classes = np.zeros((len(part), width), np.int64)
        for i, t in enumerate(part):
            classes[i, 1 : 2 * len(t) : 2] = t
        ends = np.array([2 * len(t) for t in part])
        jump = np.zeros((len(part), width), bool)  # over a blank between different classes
        if width > 2:
            jump[:, 2:] = (classes[:, 2:] != 0) & (classes[:, 2:] != classes[:, :-2])
        alpha = np.full((len(part), width), -np.inf)
        alpha[:, 0] = logp[0, 0]
        if width > 1:
            alpha[:, 1] = np.where(ends > 0, logp[0, classes[:, 1]], -np.inf)
        for t in range(1, len(logp)):
            stay = alpha.copy()
            stay[:, 1:] = np.logaddexp(stay[:, 1:], alpha[:, :-1])
            if width > 2:
                stay[:, 2:] = np.where(jump[:, 2:], np.logaddexp(stay[:, 2:], alpha[:, :-2]), stay[:, 2:])
            alpha = stay + logp[t, classes]
        rows = np.arange(len(part))
        last = alpha[rows, ends]
        out[start : start + CHUNK] = -np.logaddexp(last, np.where(ends > 0, alpha[rows, np.maximum(ends - 1, 0)], -np.inf))
    return out


def mean_losses(models: list[np.ndarray], targets: list[list[int]]) -> np.ndarray:
    """Mean over the models; a target that is impossible for one is impossible."""
    return np.mean([ctc_losses(m, targets) for m in models], axis=0) if targets else np.zeros(0)


def _log_total(losses: np.ndarray) -> float:
    finite = -losses[np.isfinite(losses)]
    return float(np.logaddexp.reduce(finite)) if len(finite) else -np.inf


def _matrices(models) -> list[np.ndarray]:
    return [np.array([np.asarray(frame, float) for frame in m]) for m in models]


def top_losses(rows: DataFrame, id_col: str, models: str, candidates: list[tuple[str, list[int]]], k: int = 5) -> DataFrame:
    """(id, rank, candidate, loss, log_total): the k candidates of least mean loss, unrounded, infinite for an impossible one; of equal ones the first of the list is before. log_total: the log of the chances of all candidates."""
    if len(candidates) > MOST_CANDIDATES:
        raise ValueError(f"{len(candidates)} candidates are sent to every task; at most {MOST_CANDIDATES}")
    names, targets = [n for n, _ in candidates], [t for _, t in candidates]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, m in zip(batch[id_col], batch[models], strict=True):
                losses = mean_losses(_matrices(m), targets)
                total = _log_total(losses)
                out += [(i, rank, names[j], float(losses[j]), total) for rank, j in enumerate(np.argsort(losses, kind="stable")[:k], 1)]
            yield pd.DataFrame(out, columns=[id_col, "rank", "candidate", "loss", "log_total"])

    return rows.select(id_col, models).mapInPandas(task, f"`{id_col}` {dict(rows.dtypes)[id_col]}, rank int, candidate string, loss double, log_total double")


def top_candidates(rows: DataFrame, id_col: str, models: str, candidates: list[tuple[str, list[int]]], k: int = 5) -> DataFrame:
    """(id, rank, candidate, score, p_rel): the k candidates of least mean loss; p_rel is over all candidates, 0 for an impossible one, which is last with a null score."""
    possible = F.col("loss") < float("inf")
    found = top_losses(rows, id_col, models, candidates, k)
    return found.select(id_col, "rank", "candidate", F.when(possible, F.bround("loss", 3)).alias("score"), F.when(possible, F.bround(F.exp(-F.col("loss") - F.col("log_total")), 4)).otherwise(0.0).alias("p_rel"))


def free_best(rows: DataFrame, id_col: str, models: str, readings: str) -> DataFrame:
    """(id, reading, score): of the models' distinct readings that aren't empty, the first of least mean loss."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, m, r in zip(batch[id_col], batch[models], batch[readings], strict=True):
                own = list(dict.fromkeys(tuple(int(c) for c in x) for x in r if len(x)))
                losses = mean_losses(_matrices(m), [list(x) for x in own])
                j = int(np.argmin(losses)) if own else None
                ok = j is not None and np.isfinite(losses[j])
                out.append((i, None if j is None else list(own[j]), round(float(losses[j]), 3) if ok else None))
            yield pd.DataFrame(out, columns=[id_col, "reading", "score"])

    return rows.select(id_col, models, readings).mapInPandas(task, f"`{id_col}` {dict(rows.dtypes)[id_col]}, reading array<int>, score double")


def pair_losses(rows: DataFrame, id_col: str, models: str, pairs: str, space: int) -> DataFrame:
    """(id, a, b, loss): for each proposed pair, the better of the mean losses of `A space B` and `A B`. pairs: array of structs (a, b, left, right) with classes."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, m, ps in zip(batch[id_col], batch[models], batch[pairs], strict=True):
                targets = [t for p in ps for t in ([*p["left"], space, *p["right"]], [*p["left"], *p["right"]])]
                losses = mean_losses(_matrices(m), targets).reshape(-1, 2).min(axis=1)
                out += [(i, p["a"], p["b"], float(x)) for p, x in zip(ps, losses, strict=True)]
            yield pd.DataFrame(out, columns=[id_col, "a", "b", "loss"])

    return rows.select(id_col, models, pairs).mapInPandas(task, f"`{id_col}` {dict(rows.dtypes)[id_col]}, a int, b int, loss double")


def merge_ranked(words: DataFrame, pairs: DataFrame, id_col: str, penalty: float, k: int = 5) -> DataFrame:
    """(id, rank, kind, a, b, loss, score, p_rel): the k best of list words (id, a, rank, loss, log_total) and pairs (id, a, b, loss, ord) by the loss rounded to 3 decimals, a pair's plus the penalty.

    words: the k best of each id with the log of the chances of all words, as top_losses gives them, so no more than k
    words of an id are sorted. Equal scores: word before pair, then earlier before later (words by rank, pairs by ord); impossible ones last with a null score. p_rel is from unrounded losses, over all words and pairs.
    """
    if not np.isfinite(penalty):
        raise ValueError("the penalty must be finite")
    infinite = F.lit(float("inf"))
    rounded = F.when(F.col("loss") < infinite, F.bround("loss", 3)).otherwise(infinite)
    one = words.select(id_col, F.lit("word").alias("kind"), "a", F.lit(None).cast("int").alias("b"), F.col("loss").alias("raw"), rounded.alias("loss"), rounded.alias("effective"), F.lit(0).alias("k1"), F.col("rank").cast("bigint").alias("k2"))
    two = pairs.select(id_col, F.lit("pair").alias("kind"), "a", "b", (F.col("loss") + penalty).alias("raw"), rounded.alias("loss"), (rounded + penalty).alias("effective"), F.lit(1).alias("k1"), F.col("ord").cast("bigint").alias("k2"))
    # chances are told relative to the best word or pair, so that they don't vanish
    of_words = words.groupBy(id_col).agg(F.max("log_total").alias("__t"))
    chances = pairs.where(F.col("loss") < infinite).select(id_col, (-F.col("loss") - penalty).alias("__t")).unionByName(of_words.where(F.col("__t") > -infinite))
    best = chances.groupBy(id_col).agg(F.max("__t").alias("__best"))
    total = chances.join(best, id_col).groupBy(id_col).agg((F.first("__best") + F.log(F.sum(F.exp(F.col("__t") - F.col("__best"))))).alias("__total"))
    ranked = one.unionByName(two).withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy("effective", "k1", "k2"))).where(F.col("rank") <= k).join(total, id_col, "left")
    ok = F.col("effective") < infinite
    null = lambda c: F.when(ok, F.bround(c, 3))
    return ranked.select(id_col, "rank", "kind", "a", "b", null(F.col("loss")).alias("loss"), null(F.col("effective")).alias("score"), F.when(ok, F.bround(F.exp(-F.col("raw") - F.col("__total")), 4)).otherwise(0.0).alias("p_rel"))
