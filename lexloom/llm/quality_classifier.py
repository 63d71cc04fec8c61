"""Quality classification by importance resampling of hashed n-gram models.

Two generative models over hashed word unigrams and bigrams are counted in one pass over all documents: one of the raw
text (every document), one of the target text (documents labelled good; a bounded sample of TARGET_DOCS of them). The
log importance weight of a document is the sum of log(target / raw) over its n-grams. Adding Gumbel noise that is a
hash of the id and taking the largest keys samples documents without replacement in proportion to their weights.

The models are BUCKETS numbers, whatever the corpus. The k-th largest key is found exactly by radix selection: four
counts by 16 bits each of the keys that agree so far, over a checkpointed table of ids and keys; nothing is sorted.

Defined results: a null or empty text has no n-grams and weight 0; a null doc_id gets the noise of its own hash;
documents whose key equals the k-th are all selected; repeated rows are weighted each; with no labelled document, or
none that is good, all weights are 0; columns other than the id and the text are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_pieces, checkpointed, hash_ranges, mix, table

BUCKETS = 16_384
#: The bound of the sample that stands for the target text: labelled good documents, by the smallest hashes.
TARGET_DOCS = 4_000
#: The part of all documents that is sampled.
SHARE = 0.85
SMOOTHING, SEED = 1.0, 42
PIECE_BYTES = 2_000_000

#: Byte classes: 0 white space, 1 letters, digits and bytes of other alphabets, 2 the rest of ASCII.
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), ord("_"), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all unigrams and bigrams of runs of word or other characters, and the text that each is from."""
    kind = _KIND[data]
    begin = np.ones(len(data), bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    one = hash_ranges(_LOWER[data], starts, ends)
    two = mix(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
    pair = doc[1:] == doc[:-1]
    return (np.concatenate((one, two[pair])) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate((doc, doc[1:][pair]))


def fit(docs: DataFrame, labels: DataFrame, target_docs: int = TARGET_DOCS) -> np.ndarray:
    """log(target / raw) of each bucket."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs).select("doc_id", F.lit(True).alias("target"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch, data, offsets in byte_pieces(batches, "text", PIECE_BYTES):
            bucket, doc = grams(data, offsets)
            raw += np.bincount(bucket, minlength=BUCKETS)
            own = np.array([bool(x) for x in batch.column("target").to_pylist()])
            target += np.bincount(bucket[own[doc]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    flagged = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(good), "doc_id", "left").select("target", "text")
    counted = flagged.mapInArrow(task, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counted["bucket"].to_numpy()
    raw[at], target[at] = counted["raw"].to_numpy(), counted["target"].to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    chance = [(x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS) for x in (target, raw)]
    return np.log(chance[0] / chance[1])


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id_col, log_weight, gumbel_key, place): place orders the keys as whole numbers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in byte_pieces(batches, "text", PIECE_BYTES):
            bucket, doc = grams(data, offsets)
            weight = np.bincount(doc, weights=ratios[bucket], minlength=batch.num_rows)
            chance = (mix(batch.column("noise").to_numpy(zero_copy_only=False).view(np.uint64)).astype(float) + 0.5) / 2.0**64
            key = weight - np.log(-np.log(np.clip(chance, 1e-300, 1 - 2.0**-53)))
            bits = key.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(weight), pa.array(key), pa.array(bits ^ ((bits >> 63) & (2**63 - 1)))], ["id", "log_weight", "gumbel_key", "place"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("noise"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, f"id {kind}, log_weight double, gumbel_key double, place bigint").withColumnRenamed("id", id_col)


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest of a bigint column, exactly: four counts of at most 65,536 groups."""
    chosen, left, high = rows.select(F.expr(f"{column} ^ (-9223372036854775807L - 1)").alias("x")), k, 0
    for shift in (48, 32, 16, 0):
        counts = chosen.groupBy(F.expr(f"shiftrightunsigned(x, {shift}) & 65535").alias("part")).count().collect()
        for part, n in sorted(((r["part"], r["count"]) for r in counts), reverse=True):
            if left <= n:
                break
            left -= n
        high = high << 16 | part
        if shift:
            chosen = chosen.where(f"shiftrightunsigned(x, {shift}) = {high}L")
    return (high ^ 1 << 63) - (1 << 64 if (high ^ 1 << 63) >= 1 << 63 else 0)


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, log_weight, gumbel_key, selected): a Gumbel top-k sample of `share` of the documents."""
    weighed = checkpointed(weigh(docs, fit(docs, labels), id_col, text_col))
    k = int(np.ceil(share * weighed.count()))
    if not k:
        return weighed.select(id_col, "log_weight", "gumbel_key", F.lit(False).alias("selected"))
    return weighed.select(id_col, "log_weight", "gumbel_key", (F.col("place") >= kth_largest(weighed, "place", k)).alias("selected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: importance weights of all documents, and the sample."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
