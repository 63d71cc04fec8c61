import random
import re
from collections import defaultdict

from lexloom.llm import packing


def naive(lengths, sources, clusters, capacity):
    bins, out, clock = [], [], 0

    def place(n, s, c):
        nonlocal clock
        clock += 1
        fits = [b for b in bins if 0 < b["left"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if fits:
            b = min(fits, key=lambda b: (b["left"], b["since"]))
        else:
            bins.append(b := {"left": capacity, "s": set(), "c": set(), "no": len(bins)})
        at = capacity - b["left"]
        b["left"] -= n
        b["s"].add(s)
        b["c"].add(c)
        b["since"] = clock
        return b["no"], at

    rest = []
    for i, n in enumerate(lengths):
        for p in range(n // capacity):
            out.append((i, p, p * capacity, capacity, *place(capacity, sources[i], clusters[i])))
        if n % capacity:
            rest.append((-(n % capacity), i, n // capacity))
    for n, i, p in sorted(rest):
        out.append((i, p, p * capacity, -n, *place(-n, sources[i], clusters[i])))
    return out


def test_same_as_naive_best_fit(monkeypatch):
    rnd = random.Random(1)
    for hot in (0, 3, 48):
        monkeypatch.setattr(packing, "HOT_KEYS", hot)
        monkeypatch.setattr(packing, "HOT_DOCS", 3)
        for n in (0, 1, 60, 300):
            lengths = [rnd.choice([1, 5, 7, 30, 31, 64, 100, 130, 999]) for _ in range(n)]
            sources = [rnd.choice(["hot", "hot", "a", "b", "c", None, f"s{i}"]) for i in range(n)]
            clusters = [rnd.choice(["k", None, i, i // 3]) for i in range(n)]
            assert packing.pack_shard(lengths, sources, clusters, 100) == naive(lengths, sources, clusters, 100)


def test_query_over_documents(spark, sf_dir):
    rows = packing.query(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.bin_id].append(r)
    assert set(pieces) == set(docs)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(re.findall("[^\x20\x09-\x0d]+", docs[i].text))
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= packing.CAPACITY
        assert len({docs[r.doc_id].source for r in own}) == len(own)
        assert len({docs[r.doc_id].text.lower() for r in own}) == len(own)


def test_odd_rows(spark):
    rows = [(1, None, "s", None), (1, None, "s", None), (2, "c", None, 5), (2, "c", None, 5), (None, "d", "s", 250), (3, None, None, 0)]
    items = spark.createDataFrame(rows, "doc_id long, cluster string, source string, length long").selectExpr("*", "1 AS row", "2 AS shard", "3 AS id")
    out = packing.pack(items, capacity=100, shard_docs=2).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in out) == [(0, 0, 100), (0, 1, 100), (0, 2, 50), (1, 0, 0), (1, 0, 0), (2, 0, 5), (2, 0, 5), (3, 0, 0)]
    assert len({r.bin_id for r in out if r.doc_id == 2}) == 2
    assert packing.pack(items.limit(0)).collect() == []
