"""Near duplicates, repeated strings, the classifier, components and the pipeline against brute force."""

import hashlib
import random
import time
import tracemalloc
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from stratapanel.llm import components, ngram_jaccard, packing, quality_classifier, store, suffix_dedup
from stratapanel.llm.words import shingle_sets

VOCABULARY = ["lorem", "Ipsum", "dolor", "sit", "AMET", "sed", "do", "éü", "x", "magna", "aliqua", "ut", "enim", "ad", "minim", "veniam"]


def text_of(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", ".", "s", "1"]) for _ in range(n))


def changed(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY) + str(rng.random())[2:5]
    return " ".join(words)


def near_copies(seed=0):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "one", "one", "ONE", "one two", "a b c d", "a b c d", "a b c e"]
    for n in (5, 8, 12, 20, 33, 60, 140, 400, 1500):
        for _ in range(2):
            base = text_of(rng, n)
            texts += [base, base] + [changed(rng, base, rng.randrange(max(2, n // 30))) for _ in range(6)]
            texts.append("  " + base.replace(" ", "\n ") + " " + text_of(rng, max(1, n // 25)))
    rng.shuffle(texts)
    return texts


def brute_sets(texts, words):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower))
        out.append({tuple(w[i: i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute_components(sets, threshold):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(sets))]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, copy string, id int")


@pytest.mark.parametrize("words, threshold", [(4, 85), (5, 80)])
def test_near_duplicates(spark, words, threshold):
    texts = near_copies(words)
    sets = brute_sets(texts, words)
    rows = {r["doc_id"]: r for r in ngram_jaccard.joined(docs(spark, texts).repartition(3), words, threshold).collect()}
    assert [rows[k]["n_shingles"] for k in range(len(texts))] == [len(s) for s in sets]
    assert [rows[k]["component_id"] for k in range(len(texts))] == brute_components(sets, threshold)


def test_signatures_meet_for_every_linked_pair():
    """The pigeonhole bound itself: sets within the threshold share a signature."""
    rng = np.random.default_rng(4)
    for trial in range(1500):
        n = int(rng.choice([1, 2, 6, 7, 8, 10, 14, 15, 22, 23, 36, 60, 90, 200, 363, 364, 500]))
        threshold = int(rng.choice([80, 85, 90]))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        drop = int(rng.integers(0, n // 5 + 1))
        add = int(rng.integers(0, n // 5 + 2))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
        both, either = n - drop, n + add
        if len(b) and 100 * both >= threshold * either:
            sa, sb = (ngram_jaccard.signatures(np.unique(x), threshold)[0] for x in (a, b))
            assert len(np.intersect1d(sa, sb)), (n, drop, add, threshold)


def test_signatures_meet_in_crowded_segments():
    """Sets whose hashes crowd few segments, so that most are empty."""
    rng = np.random.default_rng(5)
    for trial in range(1500):
        n, threshold = int(rng.integers(7, 80)), 80
        spread = int(rng.integers(20, 62))
        a = np.unique(rng.integers(0, 1 << spread, n, dtype=np.uint64) << np.uint64(62 - spread) | rng.integers(0, 1 << 20, n, dtype=np.uint64))
        gone = rng.random(len(a)) < 0.1
        b = np.unique(np.concatenate([a[~gone], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 10)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both * 100 >= threshold * (len(a) + len(b) - both):
            assert len(np.intersect1d(ngram_jaccard.signatures(a, threshold)[0], ngram_jaccard.signatures(b, threshold)[0]))


@pytest.mark.parametrize("threshold", [80, 85, 90])
def test_schemes_cover_sets_of_any_size(threshold):
    """Every band has its own number in a signature's low bits, and a place in the tables that are looked up by it."""
    every = ngram_jaccard.schemes(threshold, ngram_jaccard.BEYOND)
    assert len(every) <= ngram_jaccard.NUMBERS and every[-1].largest >= ngram_jaccard.BEYOND
    assert [s.number for s in every] == list(range(len(every)))
    if threshold != 85:
        return
    tokens = np.unique(np.random.default_rng(6).integers(0, 1 << 63, 4_500_000, dtype=np.uint64) * np.uint64(2))
    near = tokens[: -len(tokens) // 100]
    a, number, _, other = ngram_jaccard.signatures(tokens, threshold)
    assert number + 1 < len(every) and {int(x) & (ngram_jaccard.NUMBERS - 1) for x in a[:1000]} <= {number, number + 1}
    assert len(np.intersect1d(a, ngram_jaccard.signatures(near, threshold)[0])) > 0


def test_links_beyond_the_least_id_are_found(spark):
    """A chain in which the least member of a signature links with few of the others."""
    rng = random.Random(9)
    base = text_of(rng, 300)
    texts = [base]
    for _ in range(25):
        texts.append(changed(rng, texts[-1], 3))
    sets = brute_sets(texts, 5)
    rows = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.joined(docs(spark, texts)).collect()}
    assert [rows[k] for k in range(len(texts))] == brute_components(sets, 80)


def test_deduplicated_keeps_the_least_and_odd_rows(spark):
    base = text_of(random.Random(1), 50)
    table = spark.createDataFrame([(5, base, "a"), (7, base, "b"), (None, base, "c"), (9, None, "d"), (9, None, "d"), (2, "", "e"), (5, base, "a")], "doc_id long, text string, copy string")
    out = ngram_jaccard.deduplicated(table)
    assert out.columns == table.columns
    assert sorted((str(r["doc_id"]), r["copy"]) for r in out.collect()) == sorted([("5", "a"), ("5", "a"), ("None", "c"), ("9", "d"), ("9", "d"), ("2", "e")])
    assert ngram_jaccard.joined(table.limit(0)).count() == 0


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for f in Path(folder).rglob("shuffle_*")}


def left_over(spark, before):
    """Shuffle files made since ``before``; Spark removes them beside the query."""
    for _ in range(50):
        if not (new := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return new


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    counts = store.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(5), "counts")
    assert not left_over(spark, before)
    assert counts.count() == 7
    assert spark.conf.get(store.RELEASE, "false") == "false"


def stored_names(monkeypatch, module):
    names, plain = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name, *more: (names.append(name), plain(df, name, *more))[1])
    return names


def test_signatures_are_not_stored_beside_their_shuffle(spark, monkeypatch):
    """Repeated and null ids too: a row's sizes come from the same pass as its signatures."""
    names = stored_names(monkeypatch, ngram_jaccard)
    base = text_of(random.Random(3), 40)
    table = spark.createDataFrame([(4, base), (None, base), (None, ""), (8, base), (8, "one two"), (1, None)], "doc_id long, text string").repartition(4)
    rows = ngram_jaccard.joined(table).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == sorted(
        [("4", 36, "4"), ("None", 36, "None"), ("None", 0, "None"), ("8", 36, "4"), ("8", 1, "4"), ("1", 0, "1")])
    assert "index" not in names


def test_shingles_of_a_very_long_text():
    text = ("word%d " * 60_000) % tuple(range(60_000))
    raw = np.frombuffer(("x " + text).encode(), np.uint8)
    a, b, c = shingle_sets(raw, np.array([0, 1, 1, len(raw)]), 5)
    assert (len(a), len(b), len(c)) == (1, 0, 59_996)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    rows = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# repeated strings --------------------------------------------------------------------------------------------------------


def brute_cut(rows, length):
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        if i is not None:
            before = {o[k: k + length] for j, u in rows if j is not None and j < i for o in [(u or "").encode()] for k in range(len(o) - length + 1)}
            for k in range(len(raw) - length + 1):
                if raw[k: k + length] in before:
                    gone[k: k + length] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [50, 40])
def test_repeated_strings(spark, length):
    rng = random.Random(length)
    passage = [text_of(rng, 14) for _ in range(6)]
    texts = [None, "", "short", "a" * 49, "a" * 50, "a" * 51, "a" * 300, "ab" * 200, "a" * 120]
    for _ in range(50):
        bits = [rng.choice(passage)[rng.randrange(20):][: rng.randrange(20, 120)] if rng.random() < 0.6 else text_of(rng, rng.randrange(1, 12)) for _ in range(rng.randrange(1, 6))]
        texts.append(rng.choice(["", " ", "\n"]).join(bits))
    texts += [texts[-1], texts[-2], passage[0] * 3]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, passage[0]), (3, passage[1])]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, owners string, row int").repartition(4)
    got = [tuple(r) for r in suffix_dedup.deduplicated(table, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute_cut(rows, length)


def test_one_passage_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 2000)
    rng = random.Random(2)
    passage = text_of(rng, 20)
    rows = [(k, text_of(rng, rng.randrange(9)) + passage + text_of(rng, rng.randrange(9))) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = [tuple(r) for r in suffix_dedup.deduplicated(table).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute_cut(rows, 50)


def test_first_sieve_is_gone_before_the_fragments_come(spark, monkeypatch):
    passage = text_of(random.Random(6), 30)
    table = spark.createDataFrame([(k, f"{k} {passage}") for k in range(6)], "doc_id long, text string").repartition(3)
    names = stored_names(monkeypatch, suffix_dedup)
    assert suffix_dedup.repeats_cut(table).count() == 5
    assert names == ["owners", "lost", "cut"]


def test_findings_are_sent_packed_and_arrive_whole():
    rng = np.random.default_rng(3)
    doc, mark, items = rng.integers(-20, 20, 500), rng.integers(0, 2, 500), np.arange(500, dtype=np.uint32)
    sent = suffix_dedup._sent(doc, mark, items, 7)
    assert sorted(sent["dest"].to_pylist()) == list(range(7))  # one row for each destination
    got = {(r["i"], r["m"]): sorted(np.frombuffer(r["items"], np.uint32).tolist()) for d in range(7) for r in suffix_dedup._gathered(sent.filter(pc.equal(sent["dest"], d)), np.uint32).to_pylist()}
    assert got == {(d, m): items[(doc == d) & (mark == m)].tolist() for d, m in set(zip(doc.tolist(), mark.tolist()))}
    assert suffix_dedup._sent(doc[:0], mark[:0], items[:0], 7).num_rows == 0


def test_repeats_in_small_slices_and_segments(spark, monkeypatch):
    from stratapanel.llm import arrow

    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    rng = random.Random(8)
    passage = text_of(rng, 40)
    texts = [(text_of(rng, 30) + passage[rng.randrange(50):] + text_of(rng, 100)) for _ in range(12)]
    raw, offsets = arrow.concatenated(__import__("pyarrow").array(texts))
    whole = suffix_dedup.fragments(raw, offsets, 50)
    starts = sum(int(b - a + 1) for a, b in zip(whole[1], whole[2]))
    assert starts == sum(len(t.encode()) - 49 for t in texts)  # every string has one owner
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 22)
    again = suffix_dedup.fragments(raw, offsets, 50)
    own = lambda f: {(int(p), int(o)) for _, a, b, o in zip(*f) for p in range(a, b + 1) for o in [o]}
    assert own(whole) == own(again)


def test_empty_and_unrepeated_tables(spark):
    table = docs(spark, ["some text that nobody repeats at all, not even in part, I say", None])
    assert suffix_dedup.deduplicated(table.limit(0)).count() == 0
    assert sorted(r["n_removed"] for r in suffix_dedup.deduplicated(table).collect()) == [0, 0]


def test_suffix_order():
    rng = np.random.default_rng(0)
    for _ in range(200):
        text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 14)), 0) for _ in range(6)]).astype(np.uint8)
        ends = [int(np.flatnonzero(text[i:] == 0)[0]) + i for i in range(len(text))]
        suffixes = [bytes(text[i: ends[i]]) for i in suffix_dedup.suffix_order(text, 50)]
        assert len(suffixes) == len(text) and suffixes == sorted(suffixes)


# classifier --------------------------------------------------------------------------------------------------------------


def test_classifier_learns_and_holds_out(spark):
    rng = random.Random(6)
    good = [text_of(rng, rng.randrange(5, 300)) for _ in range(150)]
    bad = ["!! ".join(text_of(rng, rng.randrange(5, 300)).upper().split()) for _ in range(60)]
    rows = [(k, t, int(k < 150)) for k, t in enumerate(good + bad)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    fold = {k: zlib.crc32(str(k).encode()) % 5 for k, _, _ in rows}
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if fold[k]] + [(None, 1), (3, None)], "doc_id long, label int")
    model = quality_classifier.fitted(table.drop("label"), labels)
    odd = spark.createDataFrame([(None, "x"), (900, None), (900, ""), (901, good[0] * 200)], "doc_id long, text string")
    scores = quality_classifier.scored(table.select("doc_id", "text").unionByName(odd), model).collect()
    assert len(scores) == len(rows) + 4 and all(0 <= r["score"] <= 1 for r in scores)
    by = {r["doc_id"]: r["score"] for r in scores}
    held = [k for k in fold if not fold[k]]
    assert len(held) > 20 and sum((by[k] >= 0.3) == (k < 150) for k in held) >= 0.95 * len(held)
    twice = quality_classifier.scored(table.select("doc_id", "text"), quality_classifier.fitted(table.drop("label"), labels))
    assert {r["doc_id"]: r["score"] for r in twice.where("doc_id < 20").collect()} == {k: by[k] for k in range(20)}


def test_classifier_without_labels(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert quality_classifier.fitted(table, labels) == 0.5
    one = quality_classifier.fitted(table, spark.createDataFrame([(1, 1)], "doc_id long, label int"))
    assert [r["score"] for r in quality_classifier.scored(table, one).collect()] == [one] * 2
    assert quality_classifier.scored(table.limit(0), one).count() == 0


def test_chunks_cover_every_byte():
    c, step = quality_classifier.CHUNK, quality_classifier.CHUNK - quality_classifier.OVERLAP
    sizes = [0, 1, 511, 512, 513, 960, 961, 5000]
    offsets = np.append(0, np.cumsum(sizes))
    raw = (np.arange(offsets[-1]) % 251 + 1).astype(np.uint8)
    counts = quality_classifier.chunk_counts(offsets)
    want = [(d, raw[a: b][k * step: k * step + c]) for d, (a, b) in enumerate(zip(offsets, offsets[1:])) for k in range(counts[d])]
    for d, size in enumerate(sizes):
        assert sum(k == d for k, _ in want) == counts[d] and (counts[d] - 1) * step + c >= size
    for block in (1, 3, 100):
        got = [quality_classifier.chunked(raw, offsets, counts, k, k + block) for k in range(0, int(counts.sum()), block)]
        pairs = [(d, row) for chunks, doc in got for d, row in zip(doc, chunks)]
        assert len(pairs) == len(want)
        for (d, row), (e, text) in zip(pairs, want):
            assert d == e and bytes(row) == bytes(text).ljust(c, b"\0")


def naive_probability(weights, text):
    """The network's answer by loops over chunks, filters and positions, in doubles."""
    embed, filters, shift, head, bias = (w.astype(float) for w in weights)
    q = quality_classifier
    best = []
    for k in range(max(1, -(-(len(text) - q.OVERLAP) // (q.CHUNK - q.OVERLAP)))):
        chunk = text[k * (q.CHUNK - q.OVERLAP):][: q.CHUNK].ljust(q.CHUNK, b"\0")
        rows = [np.concatenate([embed[b] for b in chunk[p: p + q.TAPS]]) @ filters for p in range(0, q.CHUNK - q.TAPS + 1, q.STRIDE)]
        best.append(np.maximum(np.max(rows, 0) + shift, 0))
    return 1 / (1 + np.exp(-(np.concatenate([np.mean(best, 0), np.max(best, 0)]) @ head + bias[0])))


def test_network_against_naive_convolution_and_numeric_gradient():
    q = quality_classifier
    rng = np.random.default_rng(5)
    net = q.Network(rng)
    net.shift[:] = rng.normal(0, 0.2, q.FILTERS)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (0, 40, 700, 1500)]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    want = [naive_probability(net.weights(), t) for t in texts]
    assert np.allclose(net.probabilities(net.features(raw, offsets)), want, atol=1e-5)
    label = np.array([1, 0, 0, 1], np.float32)
    counts = q.chunk_counts(offsets)
    chunks, doc = q.chunked(raw, offsets, counts, 0, int(counts.sum()))
    found = q.gradients(net, chunks, doc, label)

    def loss(weights):
        p = np.array([naive_probability(weights, t) for t in texts])
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for k, g in enumerate(found):
        for at in np.argsort(-np.abs(g).ravel())[:3]:
            up, down = ([w.astype(float).copy() for w in net.weights()] for _ in range(2))
            up[k].ravel()[at] += 1e-6
            down[k].ravel()[at] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - g.ravel()[at]) < 1e-4 + 0.01 * abs(g.ravel()[at]), (k, at)


def test_long_texts_are_pooled_a_few_chunks_at_a_time():
    net = quality_classifier.Network(np.random.default_rng(1))
    raw = np.tile(np.frombuffer(b"a sentence that goes on and on, ", np.uint8), 1 << 17)  # 4 MB
    tracemalloc.start()
    score = net.probabilities(net.features(raw, np.array([0, len(raw)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= score[0] <= 1 and peak < 40 << 20


def test_training_sample_is_whole_texts_within_its_bounds(spark):
    table = spark.createDataFrame([(k, "word " * (10 if k else 5000)) for k in range(20)] + [(3, "word " * 10), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, label int")
    rows = quality_classifier.training_rows(table, labels, 100, 5000)
    assert sorted((r[0], len(r[2])) for r in rows) == sorted([(k, 50) for k in range(1, 20)] + [(4, 0)])
    assert len(quality_classifier.training_rows(table, labels, 7)) <= 8


# pipeline ----------------------------------------------------------------------------------------------------------------

ITEM = "Which of these long and winding sentences was copied from the benchmark, word for word, into a document of the training corpus?"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P
    from stratapanel.llm.tokens import encoder, tokenizer_path

    rng = random.Random(11)
    clean = [text_of(rng, 80) for _ in range(12)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(clean)]
    rows += [(100, changed(rng, clean[0], 1), "en", "s", 1), (101, clean[1], "en", "s", 1)]  # near and exact copies
    rows += [(102, "too short", "en", "s", 1), (103, None, None, None, None), (104, (clean[2] + " ") * 4, "en", "s", 1)]  # rejected
    rows += [(105, text_of(rng, 40) + " " + ITEM + " " + text_of(rng, 40), "en", "s", 1)]  # leak
    rows += [(106, text_of(rng, 60) + " password=abcdef123 " + text_of(rng, 60), "en", "s", 1), (None, text_of(rng, 70), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES:
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"] for r in d.select("doc_id").collect()})
        if name != P.STAGES[-1][0]:
            assert d.columns == P.COLUMNS
            texts = {r["doc_id"]: r for r in d.collect()}
    everyone = set(range(12)) | {None, 106}
    assert seen == [everyone | {100, 101, 105}, everyone | {105}, everyone, everyone, everyone]
    secret = next(r for r in rows if r[0] == 106)[1].replace("password=abcdef123", "[secret]")
    assert texts[106]["text"] == secret and texts[106]["n_chars"] == len(secret)
    enc, by = encoder(tokenizer_path()), {}
    for r in d.collect():
        by.setdefault(r["doc_id"], []).append((r["piece"], bytes(r["ids"])))
    for k, r in texts.items():
        assert b"".join(x for _, x in sorted(by[k])) == enc.encode(r["text"]) + bytes(4)
    assert P.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == d.agg(F.sum("length")).first()[0]
    assert packing.pack(packing.cut(d.limit(0).selectExpr("doc_id", "cast(null as string) text"), tokenizer_path(), 0, 2048), 2048).count() == 0
