"""Importance resampling against plain Python: features, gains, scores and the radix sort's ranks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stratapanel.llm import importance_resampling as resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    rows = []
    for doc, text in docs:
        words, own = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["The", "cat", "éa", "it's", "x" * 70, "X" * 65, "1a", "naïve_word", "y" * 64, "z" * 63, "日本", "a-b"] + [f"w{k}" for k in range(300)]
    out = [None, "", " .,\n", "one", "One  two"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) + rng.choice(["", ".", "\x00!"]) for _ in range(n)]
    return out


def test_query_against_brute_force(spark):
    texts = corpus(1, 400)
    docs = [(k * 7 - 500, t) for k, t in enumerate(texts)] + [(None, texts[50]), (10**12, texts[60]), (-(10**12), texts[61])]
    target = corpus(2, 30)
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, bucket string").repartition(5)
    got = resampling.resampled(table, spark.createDataFrame([(0, t, 3) for t in target], "item_id long, text string, n int"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, target), key=key)


def test_a_long_text_in_pieces(monkeypatch):
    text = " ".join(random.Random(3).choice(["a", "bb", "ccc", "q" * 80]) for _ in range(5000))
    whole = resampling.hashed(list(resampling.segments([text, None, "a b"])), resampling.Vocabulary())
    monkeypatch.setattr(resampling, "PIECE", 100)
    pieces = list(resampling.segments([text, None, "a b"]))
    assert len(pieces) > 100
    cut = resampling.hashed(pieces, resampling.Vocabulary())
    for a, b in zip(whole, cut):
        assert a.tolist() == b.tolist()
    words, own = features(text)
    assert sorted(whole[0].tolist() + whole[2].tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in own + ["a", "b", "a b"])


def test_ranks_with_ties_repeats_and_nulls(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, 5, -3, 2**40, rng.randrange(-100, 100)]), rng.choice([0, 7, -30_000, 10**6])) for k in range(3000)]
    got = {r["seq"]: r["rank"] for r in resampling.ranks(spark.createDataFrame(rows, "seq long, doc_id long, score long").repartition(3)).collect()}
    order = sorted(rows, key=lambda r: (-r[2], r[1] is None, r[1] or 0))
    assert sorted(got.values()) == list(range(1, 3001))
    at = {rank: seq for seq, rank in got.items()}
    kind = {r[0]: (r[1], r[2]) for r in rows}
    assert [kind[at[k + 1]] for k in range(3000)] == [(r[1], r[2]) for r in order]
    one = resampling.ranks(spark.createDataFrame([(9, None, 3)], "seq long, doc_id long, score long"))
    assert [tuple(r) for r in one.collect()] == [(9, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "word " * 30), (2, "a b")], "doc_id long, text string")
    assert resampling.resampled(none, some).count() == 0
    assert sorted((r["doc_id"], r["rank"]) for r in resampling.resampled(some, none, percent=100).collect()) == [(1, 1), (2, None)]
    assert resampling.resampled(some.where(F.lit(False)), none).count() == 0
    assert np.all(resampling.gains(np.zeros(10_000, np.int64), np.zeros(10_000, np.int64)) == 0)
