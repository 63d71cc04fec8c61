import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexloom.llm import byte_bpe as B
from lexloom.llm import token_counts as T
from lexloom.llm import words

P = pytest.importorskip("public_tokenizers")
PIECES = ["a", "b", " ", "  ", "\n", "é", "日", "!", "'s", "'", "1", "<|endoftext|>", "<|endof", "|>", "\t", "Ж", "٣", "🙂", "ab" * 20, " " * 40, "́", " ", "　", "aaaaa"]


def texts(n, most, seed=2):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_merge_replay_is_the_library():
    import tiktoken

    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        replay = B.replay_of(P.path(name))
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=replay.ranks, special_tokens={})
        split = words.splitter(P.PATTERN)
        all_words = sorted({w for t in texts(800, 40) for w in split(t)} | {"a" * n for n in range(1, 200)} | {"é" * n for n in range(1, 60)})
        ids, counts = replay.encode_words([w.encode() for w in all_words])
        at = 0
        for w, n in zip(all_words, counts, strict=True):
            assert ids[at : at + n].tolist() == library.encode_ordinary(w), w
            at += n
        raw, lengths = replay.decode(ids)
        assert raw.tobytes() == "".join(all_words).encode() and lengths.sum() == len(raw)


def test_splitter_is_the_pattern():
    import regex

    assert P.PATTERN == words.BYTE_LEVEL
    general, own = regex.compile(P.PATTERN).findall, words.splitter(P.PATTERN)
    for t in texts(500, 60, 3):
        assert own(t) == general(t)


def test_encode_and_decode_rows(spark):
    rows = [(1, "Hello wörld", "x"), (1, "Hello wörld", "y"), (2, None, "z"), (None, "", None), (3, "a" * 30_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = B.decode(B.encode(df, path, P.PATTERN), path).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in out) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert B.encode(df.limit(0), path, P.PATTERN).collect() == []


def test_bpe_query(spark, sf_dir):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in B.query(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), digest)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


@pytest.fixture(scope="module")
def counter():
    return T.Counter(P.path("byte_bpe_50k.json"))


def test_splicing_is_the_library(counter):
    for t in texts(600, 100, 4):
        expected = counter.many([t])[0]
        for chunk, overlap in ((8, 2), (30, 6), (50, 13), (10_000, 1)):
            assert counter.counts([t], chunk, overlap) == [expected], (t, chunk)


def test_stable_classes_agree(counter):
    for low, high in words.STABLE:
        for code in range(low, high + 1):
            c = chr(code)
            for t in (f"a{c}a", f"1{c}1", f" {c}!", c + c):
                assert counter.many([t])[0] == sum(counter.many(counter.words(t))), code


def test_other_tokenizers():
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        own = T.Counter(P.path(name))
        assert own.counts(["Hello world", ""], 4, 1) == own.many(["Hello world", ""])


def test_count_rows(spark):
    rows = [(1, None), (1, "<|endoftext|>x"), (1, "<|endoftext|>x"), (2, ""), (None, "word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    out = T.count_tokens(df, P.path("byte_bpe_50k.json"), chunk=1_000)
    assert sorted(r.n_tokens for r in out.collect()) == [0, 0, 2, 2, 20_001]
    assert T.count_tokens(df.limit(0), P.path("byte_bpe_50k.json")).collect() == []


def test_count_query(spark, sf_dir, counter):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in T.query(spark, sf_dir).collect():
        n = counter.many([docs[r.doc_id]])[0]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)
