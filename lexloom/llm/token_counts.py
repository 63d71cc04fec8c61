"""Token counts of whole texts by overlap resynchronisation.

A text longer than a chunk is encoded as overlapping chunks with offsets. Two neighbouring chunks are spliced at a
position where both start a pre-token (a word that the library encodes by itself) and that is proven stable:

* the left chunk starts at a true boundary, so its boundaries are those of the whole text up to its end;
* the pre-token that starts at the position ends before the left chunk does, and a special string that starts there
  would still fit, so cutting the chunk off has not changed anything before the position;
* the pattern looks only ahead, so from a shared boundary on, the right chunk is split as the whole text is.

If the overlap holds no such position (one word may be longer than it), the overlap is doubled, and when it reaches
back to the start of the left chunk, that chunk is. Memory is bounded by the chunk, except for a longer single word.

Pre-tokens are counted once each by the library and kept (MOST_WORDS). Texts with characters outside words.STABLE, about
whose classes the library's regular expressions may not agree with ours, are split into pre-tokens by the library.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text are the library's
special tokens, as by default; repeated rows are counted each; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fields, pieces, table
from .words import stable_splitter

CHUNK_CHARS, OVERLAP_CHARS, LIMIT = 16_384, 256, 512
#: Words of which a worker keeps the count.
MOST_WORDS = 400_000
Pretokens = tuple[np.ndarray, np.ndarray]  # starts, token counts


class Counter:
    """Counts by a tokenizers .json file or a sentencepiece .model file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.kept: dict[str, int] = {}
        self.byte_level = False
        self.longest_special = 0
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.many = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.many = lambda texts: [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in added)
        if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer") and plain:
            self.byte_level = True
            self.stable, self.split = stable_splitter()
            self.specials = [x["content"] for x in added]
            self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if added else None
            self.longest_special = max(map(len, self.specials), default=0)

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a stable text; a special string is one of them."""
        if not any(x in text for x in self.specials):
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.cut(text)):
            out += [part] if i % 2 else self.split(part)
        return out

    def learn(self, words: set[str]) -> None:
        """Counts the words that aren't kept yet."""
        if len(self.kept) + len(words) > MOST_WORDS:
            self.kept.clear()
        new = [w for w in words if w not in self.kept]
        self.kept.update(zip(new, self.many(new), strict=True))

    def pretokens(self, text: str) -> Pretokens:
        """Where the pre-tokens of a chunk start, and how many tokens each has."""
        if self.stable(text):
            words = self.words(text)
            self.learn(set(words))
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            return np.cumsum(lengths) - lengths, np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))
        found = self.tokenizer.encode(text, add_special_tokens=False)
        word, starts = found.word_ids, np.array([a for a, _ in found.offsets], np.int64)
        first = np.flatnonzero([i == 0 or w is None or w != word[i - 1] for i, w in enumerate(word)])
        return starts[first], np.diff(np.append(first, len(word)))

    def counts(self, texts: list[str], chunk: int, overlap: int) -> list[int]:
        if not self.byte_level:
            return self.many(texts)
        out, short = [0] * len(texts), []
        for i, text in enumerate(texts):
            if len(text) > chunk:
                out[i] = spliced(text, chunk, overlap, self.longest_special, self.pretokens)
            else:
                short.append(i)
        plain = [i for i in short if self.stable(texts[i])]
        words = {i: self.words(texts[i]) for i in plain}
        distinct: set[str] = set()
        for x in words.values():
            distinct.update(x)
        self.learn(distinct)
        number = self.kept.__getitem__
        for i in plain:
            out[i] = sum(map(number, words[i]))
        odd = [i for i in short if i not in words]
        for i, n in zip(odd, self.many([texts[i] for i in odd]), strict=True):
            out[i] = n
        return out


def spliced(text: str, chunk: int, overlap: int, margin: int, pretokens: Callable[[str], Pretokens]) -> int:
    """Tokens of the whole text, from overlapping chunks. margin: length of the longest special string."""
    base, end, total = 0, min(chunk, len(text)), 0
    starts, counts = pretokens(text[:end])
    reach = overlap
    while end < len(text):
        begin = max(base, end - reach)
        until = min(len(text), begin + max(chunk, 2 * reach))
        right, right_counts = pretokens(text[begin:until])
        right = right + begin
        ends = np.append(starts[1:], end)
        proven = starts[(ends < end) & (starts <= end - margin) & (starts > base)]
        common = np.intersect1d(proven, right, assume_unique=False)
        common = common[common > begin]
        if len(common):
            at = int(common[0])
            total += int(counts[starts < at].sum())
            keep = right >= at
            starts, counts, base, end, reach = right[keep], right_counts[keep], at, until, overlap
        elif begin > base:
            reach *= 2
        else:  # the overlap is the whole left chunk: widen that
            end = min(len(text), end + 2 * (end - base))
            starts, counts = pretokens(text[base:end])
            starts = starts + base
    return total + int(counts.sum())


@functools.lru_cache(2)
def counter_of(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """All columns of `docs` but the text, and out_col: how many tokens the whole text has by the file at `path`."""
    rest = [c for c in docs.columns if c not in (text_col, out_col)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch, texts in pieces(batches, text_col):
            n = counter.counts([x or "" for x in texts], chunk, overlap)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(n, pa.int64())], [*rest, out_col])

    return docs.mapInArrow(task, fields([docs.schema[c] for c in rest], f"`{out_col}` bigint"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: bytes and tokens of every whole text."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
