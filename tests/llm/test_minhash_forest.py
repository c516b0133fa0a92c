"""The LSH forest against brute force: components, orders, large regions and the exact rest."""

import random
import re

import numpy as np
import pytest

from stratapanel.llm import minhash_forest as forest

WORDS = ["lorem", "Ipsum", "dolor", "sit", "AMET", "sed", "do", "éü", "x", "magna", "aliqua", "ut", "enim"]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", ".", "s", str(rng.randrange(30))]) for _ in range(n))


def changed(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def sets_of(texts, words):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower))
        out.append({tuple(w[i: i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def components_of(sets, threshold):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(sets))]


def table(spark, texts):
    return spark.createDataFrame([(k, t, "s", 0, 1) for k, t in enumerate(texts)], "doc_id long, text string, w string, id int, region int")


def agree(spark, texts, words, threshold, parts=3):
    sets = sets_of(texts, words)
    rows = {r["doc_id"]: r for r in forest.clustered(table(spark, texts).repartition(parts), words, threshold).collect()}
    want = components_of(sets, threshold)
    assert [rows[k]["n_shingles"] for k in range(len(texts))] == [len(s) for s in sets]
    assert [rows[k]["component_id"] for k in range(len(texts))] == want
    assert [rows[k]["kept"] for k in range(len(texts))] == [k == c for k, c in enumerate(want)]


@pytest.mark.parametrize("words, threshold", [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, threshold):
    rng = random.Random(words)
    texts = [None, "", " \n\t", "one", "one", "ONE", "one two", "a b c d", "a b c d", "a b c e"]
    for n in (5, 8, 9, 12, 20, 33, 60, 140, 400, 1500):
        for _ in range(3):
            base = text_of(rng, n)
            texts += [base, base] + [changed(rng, base, rng.randrange(max(2, n // 25))) for _ in range(6)]
            texts.append("  " + base.replace(" ", "\n ") + " " + text_of(rng, max(1, n // 25)))
    rng.shuffle(texts)
    agree(spark, texts, words, threshold)


def test_large_regions_and_chains(spark):
    """A region of many near copies, and a chain in which each text links with few others."""
    rng = random.Random(7)
    base, other = text_of(rng, 200), text_of(rng, 300)
    texts = [changed(rng, base, rng.randrange(3, 14)) for _ in range(150)]
    for _ in range(40):
        texts.append(other)
        other = changed(rng, other, 5)
    rng.shuffle(texts)
    agree(spark, texts, 3, 85)


def test_what_large_regions_leave_apart_is_decided_exactly(spark, monkeypatch):
    monkeypatch.setattr(forest, "WINDOW", 2)
    monkeypatch.setattr(forest.neighbours, "__defaults__", (2,))
    met = []
    whole = forest.rarely_shared
    monkeypatch.setattr(forest, "rarely_shared", lambda *a: met.append(1) or whole(*a))
    rng = random.Random(8)
    base = text_of(rng, 60)
    texts = [changed(rng, base, 3) for _ in range(120)]  # links are rare among texts that all look alike
    agree(spark, texts, 3, 85)
    assert met


def test_rarely_shared_pairs_hold_every_link(spark):
    rng = random.Random(9)
    base = text_of(rng, 50)
    texts = [changed(rng, base, rng.randrange(1, 5)) for _ in range(60)]
    raw = [np.unique(np.array([hash(x) & (2**63 - 1) for x in s], np.int64)) for s in sets_of(texts, 3)]
    rows = spark.createDataFrame([(k, k, bytearray(s.tobytes())) for k, s in enumerate(raw)], "id long, part long, tokens binary")
    got = {tuple(r) for r in forest.rarely_shared(rows, 85).collect()}
    for a in range(60):
        for b in range(a + 1, 60):
            both = len(np.intersect1d(raw[a], raw[b]))
            if both * 100 >= 85 * (len(raw[a]) + len(raw[b]) - both):
                assert (a, b) in got


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    matches = []
    for _ in range(400):
        a = rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate([a[:184], rng.integers(0, 1 << 63, 16, dtype=np.uint64)])
        x, y = forest.signatures([np.unique(a), np.unique(b)])
        matches.append(int((x == y).sum()))
    assert abs(np.mean(matches) / forest.MINIMA - 184 / 216) < 0.02
    assert min(matches) >= forest.least_matches(85)
    x = forest.signatures([np.unique(a)])
    for tree in range(forest.TREES):
        label = forest.labels(x, tree)
        assert label.shape == (1, forest.LABEL) and label[0, 0] == tree
        assert label[0, 1:7].tobytes() == x[0, 3 * tree: 3 * tree + 3].astype(">u2").tobytes()


def test_neighbours_find_all_pairs_of_small_regions():
    rng = np.random.default_rng(2)
    minima = rng.integers(0, 1 << 16, (300, forest.MINIMA)).astype(np.uint16)
    for k in range(100, 300):
        minima[k] = np.where(rng.random(forest.MINIMA) < 0.9, minima[k // 4], minima[k])
    rows = np.concatenate([forest.labels(minima, t) for t in range(forest.TREES)])
    ids, sizes = np.tile(np.arange(300), forest.TREES), np.full(300 * forest.TREES, 100)
    order = np.lexsort((ids, *rows.T[::-1]))
    a, b, m, dense = forest.neighbours(rows[order], ids[order], sizes, len(order), 85)
    want = set()
    for x in range(300):
        for y in range(x + 1, 300):
            same = minima[x] == minima[y]
            if same.sum() >= forest.least_matches(85) and any(same[3 * t: 3 * t + 3].all() for t in range(forest.TREES)):
                want.add((x, y))
    assert want <= set(zip(a.tolist(), b.tolist()))


def test_odd_rows_and_empty_table(spark):
    rng = random.Random(3)
    one, two = text_of(rng, 50), text_of(rng, 50)
    rows = [(5, one), (7, one), (None, one), (9, None), (9, None), (2, ""), (8, two), (8, one), (3, two), (5, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in forest.clustered(docs).collect())
    assert got == sorted([("5", "3", False), ("7", "3", False), ("None", "None", True), ("9", "9", True), ("9", "9", True), ("2", "2", True), ("8", "3", False), ("8", "3", False), ("3", "3", True), ("5", "3", False)])
    assert forest.clustered(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    words = [f"w{k}" for k in range(300_000)]
    texts = [" ".join(words), " ".join(words[:290_000]), "a b c d e f g h", " ".join(words[100_000:])]
    rows = {r["doc_id"]: r for r in forest.clustered(table(spark, texts), 3, 85).collect()}
    assert [rows[k]["component_id"] for k in range(4)] == [0, 0, 2, 3]
    assert rows[0]["n_shingles"] == 299_998
