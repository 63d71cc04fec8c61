"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts counts the character n-grams (n = 1 to MOST_GRAM, lower case, runs
of other characters as spaces) that both hold, over the root of the product of what each holds; n-grams are hashed to
BUCKETS columns. LANDMARKS training texts span the Nyström feature space; one-versus-rest kernel ridge regression is
solved there. As features and regression are linear in the landmark kernels, a text is scored by two matrix products,
over a batch of texts at a time.

Only documents whose crc32(doc_id as text) mod 3 is not 1 and whose lang is not null teach, and of them a bounded
sample, equally many of each language (SAMPLE_OF_EACH, SAMPLE_DOCS in all; of more languages than that, those with most
documents), those with the smallest hashes of the id. Whole texts are scored; there
is no shuffle but for the counts by language, and a lost task is simply run again.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text if there is nothing to
learn from; equal scores go to the first language in alphabetical order; a null doc_id is not held out but does not
teach; repeated rows are predicted each; columns other than the named ones are ignored.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fields, pieces, table

MOST_GRAM, BUCKETS, LANDMARKS = 3, 1 << 16, 256
#: The bound of the training sample: documents in all, and of one language.
SAMPLE_DOCS, SAMPLE_OF_EACH = 1_500, 300
RIDGE = 1e-3
UNKNOWN = "und"
#: Below this score, a pipeline rejects a text as of no known language.
MIN_SCORE = 0.15
PIECE_BYTES, PIECE_ROWS = 2_000_000, 128
_FACTORS = np.random.default_rng(5).integers(1, 2**63, (MOST_GRAM, MOST_GRAM), dtype=np.uint64) | np.uint64(1)


@functools.cache
def _folds() -> np.ndarray:
    """Code point -> its lower case letter, or 32."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets the n-grams of each text fall into, and whether it has a letter."""
    lengths = np.array([len(x) for x in texts], np.int64)
    points = _folds()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.repeat(np.cumsum(lengths), lengths)
    row = np.repeat(np.arange(len(texts)) * BUCKETS, lengths)
    out = np.zeros(len(texts) * BUCKETS, bool)
    wide = points.astype(np.uint64)
    place = np.arange(len(points))
    for n in range(1, MOST_GRAM + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        code = wide[:m] * _FACTORS[n - 1, 0]
        for k in range(1, n):
            code = code + wide[k : k + m] * _FACTORS[n - 1, k]
        bucket = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
        inside = place[:m] + n <= ends[:m]
        out[(row[:m] + bucket.astype(np.int64))[inside]] = True
    letters = np.bincount(row[points != 32] // BUCKETS, minlength=len(texts)) > 0 if len(points) else np.zeros(len(texts), bool)
    return out.reshape(len(texts), BUCKETS), letters


class Model:
    """columns: buckets that landmarks hold; landmarks: their presence there; weights: (landmark, language) of kernel values."""

    def __init__(self, languages: list[str], columns: np.ndarray, landmarks: np.ndarray, norms: np.ndarray, weights: np.ndarray):
        self.languages, self.columns, self.landmarks, self.norms, self.weights = languages, columns, landmarks, norms, weights

    def kernels(self, held: np.ndarray) -> np.ndarray:
        """Kernel values of texts (by their presence) with each landmark."""
        sizes = np.maximum(np.sqrt(held.sum(axis=1, dtype=np.int64)), 1)
        return held[:, self.columns].astype(np.float32) @ self.landmarks.astype(np.float32).T / sizes[:, None] / self.norms

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        held, letters = presence(texts)
        values = self.kernels(held) @ self.weights
        best = values.argmax(axis=1)
        score = np.where(letters, np.clip(values[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters.tolist(), strict=True)], score


def train(bits: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model from packed presence rows and their languages, in a fixed order; the first of each language are landmarks."""
    languages = sorted(set(langs))
    if not languages:
        return None
    packed = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
    own = np.array(langs)
    chosen = np.concatenate([np.flatnonzero(own == x)[: max(1, landmarks // len(languages))] for x in languages])
    rows = np.unpackbits(packed[chosen], axis=1).astype(bool)
    columns = np.flatnonzero(rows.any(axis=0))
    model = Model(languages, columns, rows[:, columns], np.maximum(np.sqrt(rows.sum(axis=1)), 1), np.zeros((len(chosen), len(languages))))
    values, vectors = np.linalg.eigh(model.kernels(rows).astype(float))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])  # kernel values -> Nyström features
    features = np.concatenate([model.kernels(np.unpackbits(packed[i : i + 256], axis=1).astype(bool)) @ root for i in range(0, len(packed), 256)])
    targets = (own[:, None] == np.array(languages)).astype(float)
    solved = np.linalg.solve(features.T @ features + ridge * len(features) * np.eye(features.shape[1]), features.T @ targets)
    model.weights = root @ solved
    return model


def _limited(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch, texts in pieces(batches, text, PIECE_BYTES):
        for i in range(0, len(texts), PIECE_ROWS):
            yield batch.slice(i, PIECE_ROWS), texts[i : i + PIECE_ROWS]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS, each: int = SAMPLE_OF_EACH) -> Model | None:
    """A model from a sample of the documents that may teach."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL AND crc32(id) % 3 <> 1")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    if not counts:
        return None
    each = max(1, min(each, sample // len(counts)))
    # a hash below the bound leaves 1.3 times as many as are wanted, on average; the smallest of those are taken below
    bounds = [(x, min(int(2**63 * (2 * min(1.0, 1.3 * each / n) - 1)), 2**63 - 1)) for x, n in sorted(counts.items())]
    low = rows.sparkSession.createDataFrame(bounds, "lang string, bound bigint")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _limited(batches, "text"):
            held, letters = presence(texts)
            packed = np.packbits(held, axis=1)
            own = [x.tobytes() if ok else None for x, ok in zip(packed, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("hash"), pa.array(own, pa.binary())], ["lang", "hash", "bits"])

    near = rows.withColumn("hash", F.xxhash64("id")).join(F.broadcast(low), "lang").where("hash < bound")
    packed = near.select("lang", "hash", "text").mapInArrow(task, "lang string, hash bigint, bits binary").where("bits IS NOT NULL")
    # each task passes on at most `each` of a language
    found = packed.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "bits"))).where(F.col("place") <= each).toArrow()
    order = sorted(zip(found["lang"].to_pylist(), found["hash"].to_pylist(), found["bits"].to_pylist(), strict=True))
    return train([x[2] for x in order], [x[0] for x in order])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of `docs` but the text, with lang_pred and score."""
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _limited(batches, text_col):
            if model is None:
                langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                langs, score = model.predict([x or "" for x in texts])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*rest, "lang_pred", "score"])

    return docs.mapInArrow(task, fields([docs.schema[c] for c in rest], "lang_pred string, score double"))


def known(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = MIN_SCORE) -> DataFrame:
    """The rows of `docs` whose text is of a learned language with at least that score. Rows go to the Python worker and back once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _limited(batches, text_col):
            langs, score = model.predict([x or "" for x in texts]) if model else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield batch.filter(pa.array((np.array(langs, object) != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(task, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the language of every whole text."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), fit(docs))
