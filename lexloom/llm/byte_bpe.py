"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a large piece of the corpus are laid out once as one flat symbol array. An inverted index
leads from each adjacent pair that has a rank to the positions where it stands; ranks are applied in ascending
order to every position of their pair at once, and only the two neighbours of a merged symbol are looked up again.
A word is encoded once however often it occurs; ids go back to the texts by their word numbers.

There is no shuffle: every task replays the merges for its own part of the corpus, so a lost task is simply run
again, and memory is bounded by PIECE_BYTES and MOST_WORDS, or by the longest text, which is held whole with its words.

Defined results: a null text is encoded as the empty text (no ids); repeated rows are encoded each; columns other
than the id and the text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields, list_array, pieces, ranges, table
from .words import splitter

#: Words that a worker keeps encoded; beyond it, the store starts anew with the next piece.
MOST_WORDS = 250_000
PIECE_BYTES = 6_000_000
PIECE_IDS = 400_000
NEVER = np.int32(2**31 - 1)


class MergeReplay:
    """ranks: the id of each byte string, as in a tiktoken rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.found = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        tokens = sorted((rank, token) for token, rank in ranks.items())
        size = np.zeros(tokens[-1][0] + 2, np.int64)
        for rank, token in tokens:
            size[rank + 1] = len(token)
        self.byte_starts = np.cumsum(size)
        self.bytes = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        both = self.byte_ids.astype(np.int64)
        self.first = self.pair_ranks(np.repeat(both, 256), np.tile(both, 256)).reshape(256, 256)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NEVER, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], NEVER)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each word has. A word that is a token is that token."""
        n = len(words)
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        counts = (whole >= 0).astype(np.int64)
        todo = np.flatnonzero(whole < 0)
        raw = np.frombuffer(b"".join(words[i] for i in todo), np.uint8)
        lengths = np.array([len(words[i]) for i in todo], np.int64)
        symbols, alive = self._replay(raw, lengths)
        if len(todo) and len(raw):
            owner = np.repeat(todo, lengths)[alive]
            counts += np.bincount(owner, minlength=n)
        ids = np.empty(int(counts.sum()), np.int32)
        starts = np.cumsum(counts) - counts
        direct = np.flatnonzero(whole >= 0)
        ids[starts[direct]] = whole[direct]
        ids[ranges(starts[todo], counts[todo])] = symbols[alive]
        return ids, counts

    def _replay(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(raw)
        symbols = self.byte_ids[raw]
        alive = np.ones(size, bool)
        if not size:
            return symbols, alive
        ends = np.cumsum(lengths[lengths > 0])
        after = np.arange(1, size + 1, dtype=np.int32)  # position of the next symbol; -1 at the end of a word
        after[ends - 1] = -1
        before = np.arange(-1, size - 1, dtype=np.int32)
        before[np.concatenate(([0], ends[:-1]))] = -1
        pair = np.full(size, NEVER, np.int32)  # rank of the pair that starts here
        pair[:-1] = self.first[raw[:-1], raw[1:]]
        pair[ends - 1] = NEVER
        index: dict[int, list[np.ndarray]] = {}  # the inverted index: rank of a pair -> positions
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = pair[at]
            if (rank == NEVER).any():
                at, rank = at[some := rank != NEVER], rank[some]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            begin = [0, *cuts.tolist()]
            for a, b, r in zip(begin, [*begin[1:], len(at)], rank[begin].tolist(), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(at[a:b])

        enter(np.arange(size, dtype=np.int32))
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            follows = np.zeros(len(at), bool)  # a chain such as aaaa merges from its left: every second pair
            follows[1:] = after[at[:-1]] == at[1:]
            if follows.any():
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(follows, 0, place))
                at = at[(place - start) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            symbols[at] = rank
            alive[gone] = False
            pair[gone] = NEVER
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            pair[at] = NEVER
            right = at[has]
            left = before[at]
            left = left[left >= 0]
            touched = np.unique(np.concatenate((left, right))) if len(left) and len(right) else (left if len(left) else right)
            if len(touched):
                pair[touched] = self.pair_ranks(symbols[touched], symbols[after[touched]])
                enter(touched)
        return symbols, alive

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, one after the other, and how many each id has."""
        ids = ids.astype(np.int64)
        starts = self.byte_starts[ids]
        lengths = self.byte_starts[ids + 1] - starts
        return self.bytes[ranges(starts, lengths)], lengths


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def replay_of(path: str) -> MergeReplay:
    return MergeReplay(read_ranks(path))


class _Words:
    """Word -> number, with the ids of every number in one array."""

    def __init__(self, replay: MergeReplay):
        self.replay = replay
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict(itertools.count().__next__)
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Their numbers; a new word gets the next one."""
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def encode_new(self) -> None:
        new = list(itertools.islice(self.number, len(self.counts), None))
        if new:
            ids, counts = self.replay.encode_words([w.encode("utf-8", "replace") for w in new])
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
            self.counts = np.concatenate((self.counts, counts.astype(np.int32)))
            self.ids = np.concatenate((self.ids, ids))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): the ids of each whole text, each match of the pattern encoded by itself."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, store = splitter(pattern), _Words(replay_of(ranks_path))
        for batch, texts in pieces(batches, "text", PIECE_BYTES):
            if len(store.number) > MOST_WORDS:
                store.clear()
            numbers = [store.numbers(split(x) if x else []) for x in texts]
            store.encode_new()
            sizes = np.array([len(x) for x in numbers], np.int64)
            flat = np.concatenate(numbers)
            counts = store.counts[flat].astype(np.int64)
            ids = store.ids[ranges(store.starts[flat], counts)]
            upto = np.concatenate(([0], np.cumsum(counts)))
            offsets = upto[np.concatenate(([0], np.cumsum(sizes)))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), list_array(offsets, ids, pa.int32())], ["id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of `encoded` with the bytes of its ids as out_col (null: the empty byte string)."""
    names = encoded.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = replay_of(ranks_path)
        for whole in batches:
            sizes = np.array([0 if x is None else x for x in whole.column(ids_col).value_lengths().to_pylist()], np.int64)
            upto, start = np.concatenate(([0], np.cumsum(sizes))), 0
            while start < len(sizes):  # by at most PIECE_IDS or a single row
                stop = max(start + 1, int(np.searchsorted(upto, upto[start] + PIECE_IDS, side="right")) - 1)
                batch = whole.slice(start, stop - start)
                raw, lengths = replay.decode(batch.column(ids_col).flatten().to_numpy(zero_copy_only=False))
                ends = np.concatenate(([0], np.cumsum(lengths)))[upto[start : stop + 1] - upto[start]]
                out = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names if c != out_col), out], [*(c for c in names if c != out_col), out_col])
                start = stop

    return encoded.mapInArrow(task, fields([encoded.schema[c] for c in names if c != out_col], f"`{out_col}` binary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every whole text to ids and back, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
