"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits, so that of two fingerprints at most two (or three) bits apart, one
segment differs by at most one bit; for five bits into three. Each distinct fingerprint is indexed under the 64 variants of its segments with one bit
as a wildcard; fingerprints that share a variant are verified. Within the bucket of a variant no list of all pairs
is made: a small bucket is searched breadth first, a larger one by sorting the variants with one or two further
wildcards (members that agree there are at most two bits apart), and one of over MOST_MEMBERS is dealt out again by
those further variants, of which none has more than four members. For more than two bits, a larger bucket is indexed
by the halves of its other bits with further wildcards, and is held by one task, eight bytes a member. Every way is
exact; each emits a spanning forest.

Equal fingerprints are joined before (a class of copies is one fingerprint), components are found by star contraction
of the links, and both the fingerprints and each round of links are checkpointed in the shared folder.

Defined results: null and empty texts have no words and so fingerprint zero, linked like any other; rows that repeat
a doc_id keep each their row; a null doc_id never names a component unless a component has no other; columns other
than the id and the text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_pieces, checkpointed, table
from .components import components

SHINGLE_WORDS, SEED, MOST_BITS = 3, 42, 2
#: Bucket sizes up to which members are compared by shifts, breadth first, and by sorting in one task.
FEW, SOME, MOST_MEMBERS = 8, 1_024, 1_000_000
#: A fingerprint of at most so many rows isn't hot; into how many tasks a family of fingerprints is dealt.
HOT_ROWS, SALTS = 1_000, 16
LOW = np.uint64(0xFFFFFFFF)


def fingerprints_of(texts: list[bytes], words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each text over XXH64 of its word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        parts = text.lower().split()  # of bytes: A-Z and the six ASCII white space characters only
        if not parts:
            continue
        joined = b" ".join(parts)
        if len(parts) <= words:
            out[i] = xxh64_intdigest(joined, seed)
            continue
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        many = len(parts) - words + 1
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:many].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, many)
        counts = np.zeros(64, np.int64)
        for k in range(0, many, 65_536):
            counts += np.unpackbits(hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.bitwise_or.reduce(np.where(2 * counts > many, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0)))
    return out


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(id_col, fp bigint): the fingerprint of each whole text, as a signed number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in byte_pieces(batches, "text"):
            raw = data.tobytes()
            found = fingerprints_of([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], words, seed)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of as few segments that of fingerprints at most `bits` apart one segment differs by at most one bit."""
    many = bits // 2 + 1
    ends = [64 * k // many for k in range(many + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def variants(fp: str, bits: int = MOST_BITS) -> F.Column:
    """The 64 keys of a fingerprint: number of the wildcard bit (0 to 63) above its segment with that bit cleared."""
    parts = [(F.shiftrightunsigned(fp, first), width, first) for first, width in segments(bits)]
    return F.array(*(part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i)).cast("bigint")).bitwiseOR(F.lit(first + i << 32)) for part, width, first in parts for i in range(width)))


def _breadth_first(fps: np.ndarray, bits: int = MOST_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the members at most so many bits apart."""
    links, rest = [], fps
    queue: list[np.ndarray] = []
    while len(rest):
        at = queue.pop() if queue else None
        if at is None:
            at, rest = rest[0], rest[1:]
        near = np.bitwise_count(rest ^ at) <= bits
        if near.any():
            found = rest[near]
            links.append((np.full(len(found), at), found))
            queue.extend(found)
            rest = rest[~near]
    return links


def _further(wildcard: int) -> list[int]:
    """Masks of the bits that further variants of a bucket ignore: members that agree in all others are at most two bits apart.

    Members with either value of the bucket's own wildcard bit may differ in one bit of the other segment. Those whose
    segments are equal may differ in two; they share all 32 buckets of the segment, and the first one deals with them.
    """
    other = range(32, 64) if wildcard < 32 else range(32)
    own = 1 << wildcard
    out = [own | 1 << b for b in other]
    if wildcard % 32 == 0:
        out += [1 << a | 1 << b for a in other for b in other if a < b]
    return out


def _sorted_links(fps: np.ndarray, wildcard: int) -> list[tuple[np.ndarray, np.ndarray]]:
    links = []
    for mask in _further(wildcard):
        key = fps & np.uint64(~mask & (2**64 - 1))
        order = np.argsort(key)
        key, own = key[order], fps[order]
        same = key[1:] == key[:-1]
        links.append((own[1:][same], own[:-1][same]))
    return links


def _indexed_links(fps: np.ndarray, wildcard: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a large bucket: the bits outside its segment are cut in two, one of which differs by at most half of `bits`; members that agree there but for so many bits are compared."""
    first, width = next(x for x in segments(bits) if x[0] <= wildcard < sum(x))
    other = [b for b in range(64) if not first <= b < first + width]
    links = []
    for half in (other[: len(other) // 2], other[len(other) // 2 :]):
        for ignored in combinations(half, bits // 2):
            key = fps & np.uint64(sum(1 << b for b in half) & ~sum(1 << b for b in ignored))
            order = np.argsort(key)
            links += _pairs(key[order], fps[order], bits)[1]
    return links


def _own_wildcard(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The wildcard bit of the variant that tells a pair: in the first segment that differs by at most one bit, the bit that differs, or the first one."""
    out, open_ = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for first, width in segments(bits):
        differ = (a ^ b) >> np.uint64(first) & np.uint64((1 << width) - 1)
        here = open_ & (np.bitwise_count(differ) <= 1)
        out[here] = first + np.log2(np.maximum(differ[here], 1).astype(float)).astype(np.int64)
        open_ &= ~here
    return out


def _pairs(keys: np.ndarray, fps: np.ndarray, bits: int, most: int | None = None) -> tuple[np.ndarray, list]:
    """Links within buckets of more than FEW members, and all pairs of smaller ones. keys: in order, equal for the members of a bucket.

    most: the keys are those of variants, each pair of a small bucket is told by one of its variants only, and buckets
    of more members are left out; where they begin and end is told.
    """
    cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
    sizes = np.diff(cuts)
    size = np.repeat(sizes, sizes)
    few = np.flatnonzero((size > 1) & (size <= FEW))
    k, f = keys[few], fps[few]
    links = []
    for shift in range(1, FEW):
        near = (k[shift:] == k[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= bits)
        a, b = f[:-shift][near], f[shift:][near]
        once = np.ones(len(a), bool) if most is None else (k[:-shift][near] >> 32).astype(np.int64) == _own_wildcard(a, b, bits)
        links.append((a[once], b[once]))
    large = np.zeros(0, np.int64)
    for i in np.flatnonzero(sizes > FEW):
        if most is not None and sizes[i] > most:
            large = np.append(large, i)
        else:
            links += _breadth_first(fps[cuts[i] : cuts[i + 1]], bits)
    return np.column_stack((cuts[large], cuts[large + 1])) if len(large) else np.zeros((0, 2), np.int64), links


def bucket_links(keys: np.ndarray, fps: np.ndarray, some: int = SOME, bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of variants. keys: in order, equal for the members of a bucket."""
    large, links = _pairs(keys, fps, bits, some)
    for a, b in large.tolist():
        wildcard = int(keys[a] >> 32)
        links += _sorted_links(fps[a:b], wildcard) if bits == 2 else _indexed_links(fps[a:b], wildcard, bits)
    if not links:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])


def near_links(fps: DataFrame, some: int = SOME, most: int = MOST_MEMBERS, files: int = 16, bits: int = MOST_BITS) -> DataFrame:
    """(a, b): links whose components are those of all pairs of the distinct fingerprints `fp` at most `bits` apart."""
    indexed = fps.select("fp", F.explode(variants("fp", bits)).alias("key")).repartition("key").sortWithinPartitions("key")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int32()) if key is None else pa.array(key)], ["a", "b", "wildcard"])

        def deferred(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            return told(fps, fps, (keys >> 32).astype(np.int32))

        held_keys, held, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None  # of the last bucket so far; over: the key of one that has too many members
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            own = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if over is not None:
                n = int(np.searchsorted(keys, over, side="right"))
                if n:
                    yield deferred(keys[:n], own[:n])
                keys, own = keys[n:], own[n:]
            if not len(keys):
                continue
            over = None
            keys, own = np.concatenate((held_keys, keys)), np.concatenate((held, own))
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            a, b = bucket_links(keys[:last], own[:last], some, bits)
            if len(a):
                yield told(a, b)
            held_keys, held = keys[last:], own[last:]
            if bits == 2 and len(held) > most:
                over = held_keys[0]
                yield deferred(held_keys, held)
                held_keys, held = held_keys[:0], held[:0]
        a, b = bucket_links(held_keys, held, some, bits)
        if len(a):
            yield told(a, b)

    found = checkpointed(indexed.select("key", "fp").mapInArrow(task, "a bigint, b bigint, wildcard int").repartition(files))
    links = found.where("wildcard IS NULL").select("a", "b")
    if found.where("wildcard IS NOT NULL").isEmpty():
        return links
    signed = [[m - 2**64 if m >= 2**63 else m for m in _further(w)] for w in range(64)]
    masks = F.array(*(F.array(*(F.lit(m).cast("bigint") for m in x)) for x in signed))
    again = found.where("wildcard IS NOT NULL").select(F.col("a").alias("fp"), F.explode(masks[F.col("wildcard")]).alias("mask"))
    again = again.select("fp", "mask", F.expr("fp & ~mask").alias("key")).groupBy("mask", "key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return links.unionAll(again.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 3)).alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, some: int = SOME, most: int = MOST_MEMBERS, bits: int = MOST_BITS) -> DataFrame:
    """(id_col, fp, component_id): a row for each row of docs; component_id is the smallest id reachable by links of at most `bits` differing bits."""
    own = checkpointed(simhash(docs, id_col, text_col, words))
    classes = own.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n"))
    total = own.count()
    files = 16 + total // 200_000
    linked = components(near_links(classes, some, most, files, bits), "a", "b", files)
    nodes = linked.unionAll(linked.select("root", "root").distinct())
    member = nodes.join(classes.select(F.col("fp").alias("node"), "first").hint("merge"), "node")
    lowest = member.groupBy("root").agg(F.min("first").alias("lowest"))
    # a family's members meet its name in SALTS tasks; a broadcast of the members would bring them together where the name is
    salted = member.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    reached = salted.join(lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["root", "salt"]).select(F.col("node").alias("fp"), "lowest")
    names = classes.join(reached, "fp", "left").select("fp", "n", F.coalesce("lowest", "first").alias("component_id"))
    # fingerprints of over a thousandth of all rows are at most a thousand; they are sent to every task, so that no
    # task gets all rows of one of them
    hot = max(HOT_ROWS, total // 1_000)
    marked = own.join(F.broadcast(names.where(F.col("n") > hot).select("fp", F.lit(True).alias("hot"), F.col("component_id").alias("of_hot"))), "fp", "left")
    rest = marked.where("hot IS NULL").join(names.where(F.col("n") <= hot), "fp").select(id_col, "fp", "component_id")
    return rest.unionAll(marked.where("hot").select(id_col, "fp", "of_hot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: fingerprint and component of every whole text."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
