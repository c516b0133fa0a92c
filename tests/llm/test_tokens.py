"""Token ids, token files and packing against the tokenizers library and brute force."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stratapanel.llm import packing, store, token_files, tokens
from stratapanel.llm.tokens import encoder, tokenizer_path

TEXTS = [
    None, "", " ", "\n\n", "Hello, world! it's 3.14 <|endoftext|> x<|startoftext|>y", "ÉAUXCh éçè Straße ÑANDÚ ﬁ İstanbul ΑΣ Σ́ é",
    "a b c\x1cd\x85e​f", "don't we'll I'M", "word%%% other*** (x) |a|b| --== __init__", "日本語テキスト 😀😀 ok", "x" * 5000, "long word " * 3000,
    "The end. The end, THE END", "\U0001d538\U0001d539 mixedCASE9numbers99",
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(tokenizer_path())


def expected(whole, text, end):
    return np.array([*whole.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, ids long")


def test_words_encode_as_the_library_does(whole):
    enc = encoder(tokenizer_path())
    for _ in range(2):  # the second time from memory
        for t in TEXTS:
            assert enc.encode(t) == expected(whole, t, 0)[:-1].tobytes(), t


def test_many_texts_encode_as_the_library_does(whole, monkeypatch):
    """Words that differ in case and marks, words of other kinds, more words than are remembered, and a slice of a batch."""
    monkeypatch.setattr(tokens, "REMEMBERED", 8)
    rng = np.random.default_rng(2)
    words = ["Straße", "straße,", "ÉAUX", "éaux!!", "don't", "I'm.", "a<b", "word%%%", "_x_", "x_", "3.14", "naïve;", "Ÿ", "ÿ", "×", "e\u0301", "tab\tinside", "", "\n", "*", "The", "THE", "the.", "x" * 60, "日本語", "w\x85v", "q\xa0r"]
    texts = [*TEXTS, *(" ".join(rng.choice(words, 40)) for _ in range(30))]
    for enc in (tokens.WordEncoder(tokenizer_path()), tokens.WordEncoder(tokenizer_path())):
        for first in (0, 5):
            ids, bounds = enc.encode_all(pa.array(texts).slice(first))
            assert len(bounds) == len(texts) - first + 1 and bounds[-1] == len(ids)
            for t, a, b in zip(texts[first:], bounds, bounds[1:]):
                assert ids[a:b].tobytes() == expected(whole, t, 0)[:-1].tobytes(), t
        enc.direct = False
        assert enc.encode_all(pa.array(texts))[0].tobytes() == b"".join(enc.encode(t) for t in texts)
    assert len(enc.encode_all(pa.array([None, ""], pa.string()))[0]) == 0


def test_words_that_differ_in_case_or_marks_are_merged_once(monkeypatch):
    enc, merged = tokens.WordEncoder(tokenizer_path()), []
    plain = enc.merges
    monkeypatch.setattr(enc, "merges", lambda w: (merged.append(w), plain(w))[1])
    enc.encode_all(pa.array(["Thereby thereby, THEREBY! thereby", "thereby;"]))
    assert merged == ["thereby"]


def test_variable_length_coding_round_trip():
    for n in (0, 1, 3, 4, 5, 1000):
        x = np.random.default_rng(n).choice([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], n).astype(np.uint32)
        assert (token_files.decoded(*token_files.encoded(x), n) == x).all()


def test_token_files(spark, whole, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 100)
    docs = documents(spark, TEXTS, 5).unionByName(documents(spark, ["zero"]))
    rows = sorted(token_files.round_trip(docs.repartition(5), tokenizer_path(), 2).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == [0, *range(5, 5 + len(TEXTS))]
    start = 0
    for r, t in zip(rows, ["zero", *TEXTS]):
        ids = expected(whole, t, 2)
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(ids), ids.tobytes())
        start += len(ids)


def test_token_files_with_null_and_repeated_ids_and_none(spark):
    docs = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    rows = token_files.round_trip(docs, tokenizer_path(), 2).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in rows) == [(False, 2), (False, 2), (True, 1), (True, 2)]
    assert sorted(r["start"] for r in rows) in ([0, 1, 3, 5], [0, 2, 3, 5])
    assert token_files.round_trip(docs.limit(0), tokenizer_path(), 2).count() == 0


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_cut_and_pack(spark, whole):
    docs = documents(spark, TEXTS + ["again"] * 40)
    rows = packing.pack(packing.cut(docs, tokenizer_path(), 0, 64), 64).collect()
    by = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        by.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate(TEXTS + ["again"] * 40):
        ids, parts = expected(whole, t, 0), sorted(by[k], key=lambda r: r["piece"])
        assert b"".join(bytes(p["ids"]) for p in parts) == ids.tobytes()
        assert [(p["piece"], p["start"], p["length"]) for p in parts] == [(i, 64 * i, min(64, len(ids) - 64 * i)) for i in range(-(-len(ids) // 64))]
    total = sum(r["length"] for r in rows)
    assert -(-total // 64) <= check_packed(rows, 64) <= -(-total // 64) + 1
    assert packing.pack(packing.cut(docs.limit(0), tokenizer_path(), 0, 64), 64).count() == 0


def test_pack_keeps_other_columns(spark):
    rows = packing.pack(spark.createDataFrame([(3, "a", 9), (5, None, 9), (2, "a", 9)], "length long, extra string, offset int"), 5).collect()
    assert sorted((r["length"], r["extra"]) for r in rows) == [(2, "a"), (3, "a"), (5, None)]
    assert check_packed(rows, 5) == 2


@pytest.mark.parametrize("seed", range(20))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(3, 120))
    counts = {int(x): int(rng.integers(1, 30)) for x in rng.integers(1, capacity + 1, int(rng.integers(1, 60)))}
    got, sequences = {}, 0
    for pattern, times in packing.plan(counts, capacity):
        assert sum(pattern) <= capacity and times > 0
        sequences += times
        for x in pattern:
            got[x] = got.get(x, 0) + times
    assert got == counts
    bound = max(-(-sum(k * v for k, v in counts.items()) // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
    assert sequences <= bound * 1.15 + 2


def test_plan_refuses_too_long_pieces():
    with pytest.raises(ValueError):
        packing.plan({7: 1}, 6)


def test_crc_of_ids(spark, whole):
    from pyspark.sql import functions as F

    row = packing.cut(documents(spark, ["some words here"]), tokenizer_path(), 0, 2048).select(F.crc32("ids")).first()
    assert row[0] == zlib.crc32(expected(whole, "some words here", 0).tobytes())


def test_written_and_removed(spark):
    df = store.written(spark.range(5), "t")
    assert df.count() == 5
    store.removed(spark, df)
