"""Quality rules by line sequence labelling: Viterbi decoding of a linear-chain CRF marks content or boilerplate.

Each line with a word is described by indicator features (FEATURES: symbol, capital, digit and pipe shares, length,
repetition). The CRF has two states, a weight for each feature and state change; it is trained here by
gradient ascent with a prior, on a bounded sample of labelled documents: SAMPLE_DOCS of each quality by the smallest
hashes, cut into runs of RUN_LINES lines, and of these SAMPLE_RUNS of each document by the smallest hashes, wherever in
the text they are (documents of up to 256 lines teach whole); documents that the base rules reject teach nothing. Lines of good documents are content; lines of bad ones start as boilerplate and are relabelled once by the model's own decoding.
With no labelled rows, the prior is the model. A document is kept if content lines hold at least KEEP_SHARE of its
words and the base rules hold.

All statistics are vectorised over Arrow's own text buffers; there is no shuffle and no state across rows, so a lost
task is simply run again. Memory follows PIECE_BYTES, or a single longer text.

Defined results: a null text has no words and so fails the base rules, as does an empty one; blank lines take no part;
repeated rows are judged each; columns other than the id and the text are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from .common import BASE, byte_pieces, count_in, fields, hash_ranges, list_array, mix, table

PIECE_BYTES = 2_000_000
#: The training sample: documents of each quality, and runs of lines of each document.
SAMPLE_DOCS, RUN_LINES, SAMPLE_RUNS = 1_500, 64, 4
KEEP_SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

#: The prior weight of each feature, positive for boilerplate.
FEATURES = {
    "bias": -2.0,
    "symbols over 2 %": 1.0,
    "symbols over 8 %": 2.0,
    "capitals over 40 %": 1.0,
    "capitals over 80 %": 1.0,
    "digits over 30 %": 1.0,
    "pipes over 2 %": 1.0,
    "exclamation over 4 %": 1.0,
    "under 3 words": 0.5,
    "under 8 words": 0.2,
    "over 30 words": -0.2,
    "repeats an earlier line": 1.0,
    "short words": 0.1,
    "long words": 0.1,
    "none of the marks above": -1.0,
}
#: The prior weight of staying in a state.
STAY = 0.5

#: Byte classes (fixed values): 1 symbol, 2 A-Z, 3 a-z, 4 digit, 5 exclamation mark; the sets of the contract.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("a") : ord("z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[ord("!")] = 5
_WINDOW_CODES = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which of those occur earlier in the array too."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    more, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    more[order[:-1][same]] = True
    return more | later, later


class Stats:
    """Counts of the texts in data[offsets[i]:offsets[i + 1]], and the features of their lines."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n, size = len(offsets) - 1, len(data)
        first = offsets[:-1][np.diff(offsets) > 0]
        gap = _SEPARATOR[data]
        begin = np.zeros(size, bool)
        begin[1:] = gap[:-1]
        begin[first] = True
        starts = np.flatnonzero(begin & ~gap)
        stop = np.ones(size, bool)
        stop[:-1] = gap[1:]
        stop[offsets[1:][np.diff(offsets) > 0] - 1] = True
        ends = np.flatnonzero(stop & ~gap) + 1
        doc = np.searchsorted(offsets, starts, side="right") - 1
        lead = ((data & 0xC0) != 0x80) & ~gap
        kinds = _CLASS[data]
        del begin, stop, gap
        self.word_chars = count_in(lead, offsets[:-1], offsets[1:])
        self.n_symbols = count_in(kinds == 1, offsets[:-1], offsets[1:])
        self.n_words = np.bincount(doc, minlength=n)
        # words in windows that the text holds twice or more
        words = hash_ranges(data, starts, ends)
        m = max(0, len(words) - WINDOW + 1)
        covered = np.zeros(len(words), bool)
        if m:
            windows = np.zeros(m, np.uint64)
            for k in range(WINDOW):
                windows += words[k : k + m] * _WINDOW_CODES[k]
            own = np.flatnonzero(doc[:m] == doc[WINDOW - 1 : WINDOW - 1 + m])
            twice, _ = _repeated(mix(windows[own]) ^ mix(doc[own].astype(np.uint64) + BASE))
            for k in range(WINDOW):
                covered[own[twice] + k] = True
        self.n_repeat_words = np.bincount(doc[covered], minlength=n)
        # lines
        breaks = np.flatnonzero(data == 10)
        line_starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
        line_doc = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, offsets)) + 1)
        last = np.append(line_doc[1:] != line_doc[:-1], True) if len(line_doc) else np.zeros(0, bool)
        line_ends = np.append(line_starts[1:], size) - ~last
        self.lines = np.bincount(line_doc, minlength=n)
        word_line = np.searchsorted(line_starts, starts, side="right") - 1  # of equal starts (empty lines) the last, which holds the byte
        line_words = np.bincount(word_line, minlength=len(line_starts))
        self.full = np.flatnonzero(line_words > 0)
        full_starts, full_ends = line_starts[self.full], line_ends[self.full]
        self.doc = line_doc[self.full]
        lines = hash_ranges(data, full_starts, full_ends)
        _, again = _repeated(lines ^ mix(self.doc.astype(np.uint64) + BASE))
        self.n_dup_lines = np.bincount(self.doc[again], minlength=n)
        self.words = line_words[self.full]

        def share(of: np.ndarray, by: np.ndarray) -> np.ndarray:
            return count_in(of, full_starts, full_ends) / np.maximum(by, 1)

        chars = count_in(lead, full_starts, full_ends)
        letters = count_in((kinds == 2) | (kinds == 3), full_starts, full_ends)
        symbol, capital, digit = share(kinds == 1, chars), share(kinds == 2, letters), share(kinds == 4, chars)
        pipe, cry = share(data == ord("|"), chars), share(kinds == 5, chars)
        mean = chars / np.maximum(self.words, 1)
        marks = [symbol > 0.02, symbol > 0.08, capital > 0.4, capital > 0.8, digit > 0.3, pipe > 0.02, cry > 0.04]
        plain = ~(again | np.any(marks, axis=0))
        self.features = np.column_stack([np.ones(len(self.full), bool), *marks, self.words < 3, self.words < 8, self.words > 30, again, mean < 3, mean > 12, plain])

    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)


def viterbi(scores: np.ndarray, lengths: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """The likeliest states (1: boilerplate) of many sequences, one after the other. scores: of state 1 over state 0; stay: weight of (from, to)."""
    out = np.zeros(len(scores), np.int8)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return out
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
    best = np.zeros((len(order), 2))
    best[:, 1] = scores[starts]
    back = np.zeros((len(scores), 2), np.int8)
    for t in range(1, longest):
        k = active[t]
        at = starts[:k] + t
        to = best[:k, :, None] + stay  # (sequence, from, to)
        came = to[:, 1] > to[:, 0]  # ties stay with content
        back[at] = came
        best[:k] = np.where(came, to[:, 1], to[:, 0])
        best[:k, 1] += scores[at]
    state = (best[:, 1] > best[:, 0]).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        out[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return out


class Crf:
    """weights: of FEATURES for boilerplate; stay: (from, to)."""

    def __init__(self, weights: np.ndarray | None = None, stay: np.ndarray | None = None):
        self.weights = np.array(list(FEATURES.values())) if weights is None else weights
        self.stay = np.array([[STAY, 0.0], [0.0, STAY]]) if stay is None else stay

    def decode(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return viterbi(features @ self.weights, lengths, self.stay)

    def fit(self, features: np.ndarray, lengths: np.ndarray, good: np.ndarray, rounds: int = 2, steps: int = 120, rate: float = 0.1, prior: float = 0.0001) -> Crf:
        """lengths: lines of each document; good: whether it is one."""
        model, total = self, max(1, int(lengths.sum()))
        states = np.repeat(~good, lengths).astype(np.int8)
        for again in range(rounds):
            if again:
                states = np.where(np.repeat(good, lengths), 0, model.decode(features, lengths)).astype(np.int8)
            weights, stay = self.weights.copy(), self.stay.copy()
            moment = [np.zeros_like(weights), np.zeros_like(stay)]
            square = [np.zeros_like(weights), np.zeros_like(stay)]
            for step in range(1, steps + 1):
                slopes = self._slopes(features, lengths, states, weights, stay)
                for i, (x, g, origin) in enumerate(((weights, slopes[0], self.weights), (stay, slopes[1], self.stay))):
                    g = g / total - prior * (x - origin)
                    moment[i] = 0.9 * moment[i] + 0.1 * g
                    square[i] = 0.999 * square[i] + 0.001 * g * g
                    x += rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
            model = Crf(weights, stay)
        return model

    @staticmethod
    def _slopes(features: np.ndarray, lengths: np.ndarray, states: np.ndarray, weights: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the log likelihood of the states, by the forward-backward recursion over padded sequences."""
        n, longest = len(lengths), int(lengths.max(initial=0))
        if not longest:
            return np.zeros_like(weights), np.zeros_like(stay)
        inside = np.arange(longest) < lengths[:, None]
        score = np.zeros((n, longest, 2))
        score[inside, 1] = features @ weights
        grid = np.zeros((n, longest), np.int8)
        grid[inside] = states
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            x = np.logaddexp(forward[:, t - 1, 0, None] + stay[0], forward[:, t - 1, 1, None] + stay[1]) + score[:, t]
            forward[:, t] = np.where(inside[:, t, None], x, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            y = score[:, t + 1] + backward[:, t + 1]
            x = np.logaddexp(stay[:, 0] + y[:, 0, None], stay[:, 1] + y[:, 1, None])
            backward[:, t] = np.where(inside[:, t + 1, None], x, 0)
        norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])[:, None]
        chance = np.exp(forward[..., 1] + backward[..., 1] - norm)[inside]
        slope = features.T @ (states - chance)
        change = np.zeros_like(stay)
        pairs = inside[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(forward[:, :-1, a] + stay[a, b] + score[:, 1:, b] + backward[:, 1:, b] - norm)
                change[a, b] = ((grid[:, :-1] == a) & (grid[:, 1:] == b) & pairs).sum() - p[pairs].sum()
        return slope, change


def _judged(x: Stats, model: Crf, n: int, keep_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States of the lines, content share of each document, and whether it is kept."""
    state = model.decode(x.features, np.bincount(x.doc, minlength=n))
    content = np.bincount(x.doc[state == 0], weights=x.words[state == 0], minlength=n)
    share = content / np.maximum(x.n_words, 1)
    return state, share, ~x.base_failed() & (share >= keep_share)


def label_lines(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text", keep_share: float = KEEP_SHARE) -> DataFrame:
    """Counts and verdict of each document, its content share, and line_labels: 1 content, 0 boilerplate, -1 blank, for each line."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in byte_pieces(batches, "text", PIECE_BYTES):
            x = Stats(data, offsets)
            state, share, kept = _judged(x, model, batch.num_rows, keep_share)
            labels = np.full(int(x.lines.sum()), -1, np.int8)
            labels[x.full] = 1 - state
            counts = [pa.array(c, pa.int64()) for c in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *counts, pa.array(x.base_failed()), pa.array(kept), pa.array(share), list_array(np.concatenate(([0], np.cumsum(x.lines))), labels, pa.int8())],
                ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "line_labels"],
            )

    schema = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double, line_labels array<tinyint>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, fields([StructField("id", docs.schema[id_col].dataType)], schema)).withColumnRenamed("id", id_col)


def good(docs: DataFrame, model: Crf, text_col: str = "text", keep_share: float = KEEP_SHARE) -> DataFrame:
    """The rows of `docs` that are kept. Rows go to the Python worker and back once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in byte_pieces(batches, text_col, PIECE_BYTES):
            yield batch.filter(pa.array(_judged(Stats(data, offsets), model, batch.num_rows, keep_share)[2]))

    return docs.mapInArrow(task, docs.schema)


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines teach, and the lengths of their runs. counts: lines of each document."""
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    runs = -(-counts // RUN_LINES)
    first = np.cumsum(runs) - runs
    number = np.arange(int(runs.sum())) - np.repeat(first, runs)
    # of the runs of a document those with the smallest hashes of their numbers
    document = np.repeat(np.arange(len(counts)), runs)
    order = np.lexsort((mix(number.astype(np.uint64) + BASE), document))
    taken = np.zeros(len(order), bool)
    taken[order] = np.arange(len(order)) - first[document] < SAMPLE_RUNS
    sizes = np.minimum(RUN_LINES, np.repeat(counts, runs) - number * RUN_LINES)
    return taken[np.repeat(first, counts) + place // RUN_LINES], sizes[taken]


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, quality, sizes, lines): the features of the lines that teach, as bits; of rows that share an id the one with the least lines counts."""
    rows = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = None
    for value in (0, 1):
        some = rows.where(F.col("quality") == value).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionAll(some)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in byte_pieces(batches, "text", PIECE_BYTES):
            x, n = Stats(data, offsets), batch.num_rows
            counts = np.bincount(x.doc, minlength=n)
            taken, sizes = _runs(counts)
            codes = x.features[taken].astype(np.int64) @ (1 << np.arange(x.features.shape[1]))
            at = lambda per: np.concatenate(([0], np.cumsum(per)))
            runs = np.minimum(-(-counts // RUN_LINES), SAMPLE_RUNS)
            lines = np.add.reduceat(np.append(sizes, 0), at(runs)[:-1]) * (runs > 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x.base_failed()), list_array(at(runs), sizes, pa.int32()), list_array(at(lines), codes, pa.int32())], ["doc_id", "quality", "failed", "sizes", "lines"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    kind = StructField("doc_id", texts.schema["doc_id"].dataType)
    found = texts.mapInArrow(task, fields([kind], "quality int, failed boolean, sizes array<int>, lines array<int>"))
    return found.where("NOT failed").groupBy("doc_id", "quality").agg(F.min(F.struct("lines", "sizes")).alias("x")).select("doc_id", "quality", "x.sizes", "x.lines")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> Crf:
    """A CRF from the sample."""
    found = sample(docs, labels, most).orderBy("doc_id", "quality").toArrow()
    flat = lambda c: found[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths, codes = flat("sizes"), flat("lines")
    if not len(lengths):
        return Crf()
    runs = np.array([len(x) for x in found["sizes"].to_pylist()], np.int64)
    good = np.repeat(np.array(found["quality"].to_pylist(), np.int64) == 1, runs)
    return Crf().fit(((codes[:, None] >> np.arange(len(FEATURES))) & 1).astype(float), lengths, good)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the base counts and the verdict on every whole text."""
    docs = table(spark, sf_dir, "documents")
    return label_lines(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("line_labels")
