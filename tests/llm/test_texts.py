import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import chat, components, language_id, quality_classifier, quality_rules, simhash
from lexloom.llm import license_scan as L

WORD = "[^\x20\x09-\x0d]+"
ODD = [None, "", " \n\t ", "$$$ 123", "a", "A\n\nA\n", "один два три", "x " * 40_000, "ﬁ İ ß", "word\r\nword"]


def odd_rows(spark):
    """Nulls, empties, a long text and repeats, with extra columns whose names clash with results."""
    rows = [(i, t, "kept", 1.5) for i, t in enumerate(ODD)] * 2 + [(None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words double")


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs)
    held_out = docs.where("crc32(cast(doc_id AS string)) % 3 = 1")
    rows = language_id.predict(held_out.select("doc_id", "lang", "text"), model).collect()
    assert len(rows) > 30 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    taught = language_id.fit(docs.withColumn("lang", F.when(F.expr("crc32(cast(doc_id AS string)) % 3 = 1"), "no").otherwise(F.col("lang"))))
    assert "no" not in taught.languages


def test_language_odd_rows(spark, sf_dir):
    model = language_id.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = language_id.predict(odd_rows(spark), model).collect()
    assert len(rows) == 2 * len(ODD) + 1 and rows[0].asDict().keys() == {"doc_id", "n_words", "lang_pred", "score"}
    for r in rows:
        unknown = r.doc_id is not None and not any(map(str.isalpha, ODD[r.doc_id] or ""))
        assert (r.lang_pred == "und") == unknown and (not unknown or r.score == 0)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.fit(empty) is None and language_id.predict(empty, None).collect() == []
    assert {r.lang_pred for r in language_id.predict(odd_rows(spark), None).collect()} == {"und"}


def brute_counts(text):
    words = re.findall(WORD, text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_rows(spark).select("doc_id", "text"))
    text = defaultdict(list)
    for r in docs.collect():
        text[r.doc_id].append(r.text)
    rows = quality_rules.label_lines(docs, quality_rules.Crf()).collect()
    assert len(rows) == sum(map(len, text.values()))
    for r in rows:
        known = {brute_counts(t) for t in text[r.doc_id]}
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts in known
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
        assert len(r.line_labels) in {len((t or "").split("\n")) for t in text[r.doc_id]}


def test_quality_verdicts(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(docs, labels)
    rows = quality_rules.label_lines(docs, model).join(labels, "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.99
    assert np.mean([not r.kept for r in rows if r.quality == 0]) > 0.9
    assert quality_rules.fit(docs.limit(0), labels).weights.tolist() == quality_rules.Crf().weights.tolist()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 1, 5, 3, 0, 6])
    scores, stay = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    got, at = quality_rules.viterbi(scores, lengths, stay), 0
    for n in lengths:
        paths = [[(k >> i) & 1 for i in range(n)] for k in range(2**n)]
        value = lambda p, at=at, n=n: sum(scores[at + i] * p[i] for i in range(n)) + sum(stay[p[i - 1], p[i]] for i in range(1, n))
        assert n == 0 or got[at : at + n].tolist() == max(paths, key=value)
        at += n


def brute_fingerprint(text):
    import xxhash

    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, bits=2):
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("hot", [1, 1_000])
def test_simhash_query(spark, sf_dir, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_rows(spark).select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text")).distinct()
    rows = sorted((r for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None), key=lambda r: r.doc_id)
    text = {r.doc_id: r.text for r in docs.collect()}
    fps = [brute_fingerprint(text[r.doc_id]) for r in rows]
    assert [r.fp % 2**64 for r in rows] == fps
    assert [rows[k].doc_id for k in groups(fps)] == [r.component_id for r in rows]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_simhash_every_way_through_a_bucket(spark):
    rnd = random.Random(3)
    family = {rnd.getrandbits(64) for _ in range(100)} | {2**64 - 1, 0, 3, 7}
    for base in [rnd.getrandbits(64) for _ in range(3)]:
        for _ in range(250):
            v = base
            for _ in range(rnd.randint(0, 7)):
                v ^= 1 << rnd.randrange(64)
            family.add(v)
    family = sorted(family)
    signed = [v - 2**64 if v >= 2**63 else v for v in family]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for some, most, bits in ((1024, 10**6, 2), (10, 10**6, 2), (10, 40, 2), (1024, 10**6, 3), (10, 40, 3), (1024, 10**6, 5), (40, 40, 5)):
        expected, found = defaultdict(set), defaultdict(set)
        for v, k in zip(signed, groups(family, bits), strict=True):
            expected[k].add(v)
        for r in components.components(simhash.near_links(df, some, most, bits=bits), "a", "b").collect():
            found[r.root] |= {r.root, r.node}
        assert {frozenset(x) for x in found.values()} == {frozenset(x) for x in expected.values() if len(x) > 1}


def test_components_of_paths_and_rings(spark):
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 17) for i in range(17)] + [(200, 200), (300, 301), (301, 300)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 17)} | {301: 300}


def test_importance_resampling(spark, sf_dir):
    values = [random.Random(5).getrandbits(64) - 2**63 for _ in range(100)] + [5, 5, -1, 0, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "p long")
    for k in (1, 40, len(values)):
        assert quality_classifier.kth_largest(df, "p", k) == sorted(values, reverse=True)[k - 1]
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.resample(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r.selected for r in rows if r.quality == 1]) > 0.97 and np.mean([r.selected for r in rows if r.quality == 0]) < 0.3
    odd = quality_classifier.resample(odd_rows(spark), labels.limit(0)).collect()
    assert len(odd) == 2 * len(ODD) + 1 and {r.log_weight for r in odd} == {0.0}
    assert quality_classifier.resample(odd_rows(spark).limit(0), labels).collect() == []


def test_gram_weights_are_those_of_a_plain_count():
    texts = ["The cat, the CAT!", "", "a_b $$$ c"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    bucket, doc = quality_classifier.grams(data, offsets)
    assert np.bincount(doc, minlength=3).tolist() == [6 + 5, 0, 3 + 2]
    own = bucket[doc == 0]
    assert own[0] == own[3] and own[1] == own[4]  # `the` and `cat` again


def test_licences(spark):
    known, index = L.templates()
    for key, text in [(k, n.format(a)) for k, (names, _) in L.NAMES.items() for a in names for n in L.NOTICES] + list(L.TEXTS.items()):
        pairs = L.bigrams(L.words_of(text))
        plain = {p for p in pairs if set(p) <= L.ORDINARY}
        assert 2 * len(plain) / (len(plain) + len(pairs)) < L.THRESHOLD  # so the telling words lose no match
        assert L.best_match(text)[:2] == (1.0, key)
    wrapped = "Copyright (c) 2020 A. Person\n" + re.sub(r"((?:\S+ ){9})", r"\1\n", L.TEXTS["MIT"])
    text = "Some prose here.\n\n" + wrapped + "\n\nMore prose. License to nothing."
    ((dice, key, start, end), *_) = L.scan_text(text)
    assert key == "MIT" and dice > 0.99 and text[start:end] == wrapped
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four\nReleased under the MIT Licence.\nfive six seven"), (3, "one two three four\nReleased under the MIT Licence.\nfive six seven"), (None, "the of and")], "doc_id long, text string")
    out = sorted(((r.doc_id or 0, r.license, r.n_hits) for r in L.scan(rows).collect()), key=str)
    assert out == [(0, None, 0), (1, None, 0), (2, None, 0), (3, "MIT", 1), (3, "MIT", 1)]
    # pruning and the index lose nothing against comparing with every template
    sets = defaultdict(set)
    for pair, ids in index.items():
        for i in ids:
            sets[i].add(pair)
    rnd = random.Random(1)
    vocabulary = sorted({w for p in index for w in p})
    for _ in range(300):
        words = [rnd.choice(vocabulary) if rnd.random() < 0.15 else w for w in L.words_of(rnd.choice(list(L.NOTICES)).format(rnd.choice(list(L.NAMES.values()))[0][0]))]
        own = L.bigrams(words)
        every = [(-2 * len(own & sets[i]) / (len(own) + size), key) for i, (key, size, _) in enumerate(known)]
        expected = min(every) if own and -min(every)[0] >= L.THRESHOLD else None
        got = L.best_match(" ".join(words))
        assert (got and (-got[0], got[1])) == expected


def test_chat_snapshots(spark):
    turns = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"),
        (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (2, 2, "user", "c"),
        (3, 5, "user", "a"), (3, 7, "assistant", "b"), (3, 9, "user", "c"),
        (4, 0, "user", None), (5, 0, None, "<|im_start|>x<|im_end|>"), (6, None, "user", "z"), (6, 0, "user", "y"), (None, 0, "user", "lost"),
        (7, 0, "user", "ab"), (8, 0, "user", "a"), (8, 1, "user", "b"),
    ]
    turns += [(9, i, "user", f"t{i}") for i in range(3_000)] + [(10, i, "user", f"t{i}") for i in range(2_500)]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, position string")
    out = {r.conv_id: r for r in chat.render(df, chat.maximal(chat.positions(df))).collect()}
    assert {i: (r.n_turns, r.n_copies) for i, r in out.items()} == {2: (3, 1), 4: (1, 0), 5: (1, 0), 6: (2, 0), 7: (1, 0), 8: (2, 0), 9: (3_000, 0)}
    assert out[2].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert out[5].rendered.count("<|im_start|>") == 1 and out[6].rendered.index("z") < out[6].rendered.index("y")
    assert [int(x[1:]) for x in re.findall(r"\n(t\d+)<", out[9].rendered)] == list(range(3_000))
    empty = df.limit(0)
    assert chat.render(empty, chat.maximal(chat.positions(empty))).collect() == []


def brute_chat(rows):
    """(conv_id, n_turns, n_copies, rendered) in plain Python."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, set()).add((turn is not None, turn or 0, role if role is not None else "unknown", text or ""))
    told = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    out = []
    for c, own in told.items():
        same = sorted(d for d, x in told.items() if x == own)
        if same[0] == c and not any(len(x) > len(own) and x[: len(own)] == own for x in told.values()):
            safe = [[x.replace(m, m.replace("<|", "<|​")) for m in ("<|im_start|>",)][0].replace("<|im_end|>", "<|​im_end|>") for r, t in own for x in (r, t)]
            out.append((c, len(own), len(same) - 1, "".join(f"<|im_start|>{safe[i]}\n{safe[i + 1]}<|im_end|>\n" for i in range(0, len(safe), 2))))
    return sorted(out)


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = chat.maximal(chat.positions(df))
    return sorted((r.conv_id, r.n_turns, r.n_copies, r.rendered) for r in chat.render(df, kept).collect())


def test_chat_turns_of_one_number_are_in_order_of_their_texts(spark):
    rows = [(2 * i, 0, "user", f"a{i * 7919 % 1000}") for i in range(40)] + [(2 * i, 0, "user", f"b{i * 31 % 1000}") for i in range(40)] + [(2 * i + 1, 0, "user", f"b{i * 31 % 1000}") for i in range(40)]
    got = chats(spark, rows)
    assert len(got) == 80 and got == brute_chat(rows)


def test_chat_long_conversations_without_turn_numbers(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 16)
    rnd = random.Random(3)
    long = [(1, None, "user", f"t{i:04d}") for i in range(300)] + [(2, None, "user", f"t{i:04d}") for i in range(100)] + [(3, None, "user", f"t{i:04d}") for i in range(1, 90)]
    numbered = [(4, i, rnd.choice(["user", None]), rnd.choice(["x", "<|im_start|>", None, ""])) for i in range(200)]
    more = [(5, t, r, x) for _, t, r, x in numbered if t < 70] + [(6, t, r, x) for _, t, r, x in numbered if t < 70] + [(7, t + 5 if t == 69 else t, r, x) for _, t, r, x in numbered if t < 70]
    rows = long + numbered + more + rnd.sample(long, 50) + [(None, 1, "user", "x")]
    rnd.shuffle(rows)
    got = chats(spark, rows)
    assert [x[:3] for x in got] == [x[:3] for x in brute_chat(rows)] and got == brute_chat(rows)
