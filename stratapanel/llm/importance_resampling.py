"""Target-distribution importance resampling: draw the documents most like a target corpus, without replacement.

Features are all runs of one and two consecutive words (A-Z lower-cased; runs of
digits, letters and bytes above ASCII), hashed by crc32 into buckets.  A bucket's
gain is the scaled log ratio of its smoothed shares in target and corpus; a
document's weight is the floored mean of its features' gains.  Adding Gumbel
noise from a hash of the id makes the highest scores a weighted draw.

Array-scored weights.  A task knows each word's crc32 once and gets the crc32 of
a pair by the algebra of the code: the first word's, carried over the second's
length by table lookups, xor the second's.  Buckets, counts and sums are numpy
arrays over a slice of many texts; a very long text goes piece by piece.

Distributed LSD radix sort.  Documents are ranked by falling score and rising
id.  The composite key is cut into digits, as many as the spans of score and id
in the data need.  Each pass counts digits per part (map-side combined); the
running sum over digits, then parts, gives every (part, digit) its first
destination; tasks place their rows stably from there and the shuffle to the
destination's part keeps the order for the next digit.  After the last pass the
destination is the rank.  Only the counts (parts x radix numbers) reach the
driver; parts hold equal numbers of rows whatever the keys are, so equal scores
or ids make no hot part.

Defined results: null and empty texts (and texts without words) have no features
and weight 0; a null ``doc_id`` hashes as empty text and ranks behind the ids of
its score; rows that repeat a ``doc_id`` are ranked each, in the order they were
read; an empty corpus gives no rows, an empty target gives gains from the corpus
alone; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratapanel.llm.arrow import column, slices
from stratapanel.llm.store import removed, width, written

BUCKETS = 10_000
#: A-Z to a-z; all other ASCII but digits and letters to a space.
WORDS = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bytes of a long text worked on at once.
PIECE = 1 << 20
#: Words a task remembers between slices.
REMEMBERED = 500_000
#: Longest word whose pairs are hashed by tables; longer ones go through the library.
LONGEST = 64
#: Most bits of a digit.
DIGIT_BITS = 10


def _carry_tables() -> np.ndarray:
    """[length, byte place, byte]: the crc32 register carried over ``length`` zero bytes."""
    code = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        code = np.where(code & 1, (code >> 1) ^ np.uint32(0xEDB88320), code >> 1).astype(np.uint32)
    out = np.zeros((LONGEST + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(1, LONGEST + 2):
        out[n] = (out[n - 1] >> 8) ^ code[out[n - 1] & 0xFF]
    return out


CARRY = _carry_tables()


class Vocabulary(dict):
    """Word to number; crc32 of the word, of a space and the word, and its length, by number."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((3, 1 << 12), np.uint32)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n == self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        self.table[:, n] = zlib.crc32(word), zlib.crc32(b" " + word), len(word)
        return n


def segments(texts):
    """(text's number, words, whether the first word was counted before) of all texts, long ones in pieces."""
    for k, text in enumerate(texts):
        raw = (text or "").encode().translate(WORDS)
        if len(raw) <= PIECE:
            yield k, raw.split(), False
            continue
        at, last = 0, []
        while at < len(raw):
            end = raw.find(b" ", at + PIECE)
            end = len(raw) if end < 0 else end
            words = raw[at:end].split()
            if words:
                yield k, last + words, bool(last)
                last = words[-1:]
            at = end


def hashed(parts, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every single word, and of every pair, of some segments."""
    sizes = np.array([len(words) for _, words, _ in parts], np.int64)
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(words for _, words, _ in parts)), np.int64, int(sizes.sum()))
    owner = np.repeat(np.array([k for k, _, _ in parts], np.int64), sizes)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    counted, paired = np.ones(len(ids), bool), np.ones(len(ids), bool)
    paired[first] = False
    counted[first[[again for _, words, again in parts if words]]] = False
    crc, spaced, length = known.table
    second = np.flatnonzero(paired)
    before, after = crc[ids[second - 1]], ids[second]
    # The list may hold long words; they are few.
    size = length[after].astype(np.int64) + 1
    short = np.minimum(size, LONGEST + 1)
    pair = spaced[after] ^ CARRY[short, 0, before & 0xFF] ^ CARRY[short, 1, before >> 8 & 0xFF] ^ CARRY[short, 2, before >> 16 & 0xFF] ^ CARRY[short, 3, before >> 24]
    long = np.flatnonzero(size > LONGEST + 1)
    if len(long):
        every = [w for _, words, _ in parts for w in words]
        for i in long:
            pair[i] = zlib.crc32(b" " + every[second[i]], int(before[i]))
    return crc[ids[counted]] % BUCKETS, owner[counted], pair % BUCKETS, owner[second]


def _pieces(batches):
    """Batches in slices, with their segments in groups of about a piece."""
    known = Vocabulary()
    for part in slices(batches, "text"):
        group, held = [], 0
        for segment in segments(column(part, "text").to_pylist()):
            group.append(segment)
            held += len(segment[1])
            if held > PIECE // 4:
                yield part, hashed(group, known), False
                group, held = [], 0
        yield part, hashed(group, known), True
        if len(known) > REMEMBERED:
            known = Vocabulary()


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts in each bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, (single, _, pair, _), _ in _pieces(batches):
            total += np.bincount(single, minlength=BUCKETS) + np.bincount(pair, minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of the buckets' smoothed shares, in doubles, floored."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(corpus, target)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of whole texts."""

    def run(batches):
        words = sums = None
        for part, (single, owner, pair, pair_owner), done in _pieces(batches):
            n = part.num_rows
            if words is None:
                words, sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
            words += np.bincount(owner, minlength=n)
            for of, bucket in ((owner, single), (pair_owner, pair)):
                sums += np.bincount(of, weights=gain[bucket], minlength=n).astype(np.int64)  # whole numbers below 2**53
            if done:
                features = np.maximum(2 * words - 1, 0)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pa.array(words), pa.array(features), pa.array(sums // np.maximum(features, 1))], ["doc_id", "n_words", "n_features", "weight"])
                words = None

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def scored(docs: DataFrame, target: DataFrame, seed: int = 7) -> DataFrame:
    """seq (a number for each row of ``docs``), doc_id, n_words, n_features, weight, score."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))
    return written(weighted(docs, gain).withColumn("score", (F.col("weight") + noise).cast("bigint")).withColumn("seq", F.monotonically_increasing_id()), "scored")


def _digits(span: int) -> list[tuple[int, int]]:
    """(shift, bits) of the fewest digits, alike in width, that hold numbers up to ``span``."""
    bits = int(span).bit_length()
    passes = -(-bits // DIGIT_BITS)
    each = -(-bits // passes) if passes else 0
    return [(i * each, each) for i in range(passes)]


def ranks(rows: DataFrame) -> DataFrame:
    """seq, rank (from 1) of rows (seq, doc_id, score) by falling score, then rising doc_id (null last), then seq."""
    spark, parts = rows.sparkSession, width(rows.sparkSession)
    n, low, high, least, most = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id"), F.min("score"), F.max("score")).first()
    if not n:
        return rows.select("seq", F.lit(0).cast("bigint").alias("rank"))
    ids = (high - low if low is not None else 0) + 1  # so ids need a digit at least
    behind = F.coalesce(F.col("doc_id") - F.lit(low if low is not None else 0), F.lit(ids)).cast("bigint")
    size = -(-n // parts)
    now = rows.select("seq", behind.alias("id"), (F.lit(most) - F.col("score")).cast("bigint").alias("fall"), F.pmod(F.xxhash64("seq"), F.lit(parts)).cast("int").alias("part"), F.col("seq").alias("place"))
    now = written(now, "keys")
    for name, shift, bits in [("id", *d) for d in _digits(ids)] + [("fall", *d) for d in _digits(most - least)]:
        radix = 1 << bits
        digit = F.shiftright(name, shift).bitwiseAND(radix - 1).cast("int")
        counts = now.groupBy("part", digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # parts x radix numbers at most
        table = np.zeros((radix, parts), np.int64)
        table[counts["digit"].to_numpy(), counts["part"].to_numpy()] = counts["n"].to_numpy()
        before = (np.cumsum(table) - table.ravel()).reshape(radix, parts)
        offsets = spark.sparkContext.broadcast(before)

        def place(batches, offsets=offsets, size=size):
            part, following = None, None
            for batch in batches:
                parts_of = column(batch, "part").to_numpy()
                digits = column(batch, "digit").to_numpy()
                out = np.zeros(len(digits), np.int64)
                bounds = np.flatnonzero(np.append(True, parts_of[1:] != parts_of[:-1]))
                for i, j in zip(bounds, np.append(bounds[1:], len(digits))):
                    if parts_of[i] != part:
                        part, following = parts_of[i], offsets.value[:, parts_of[i]].copy()
                    own = digits[i:j]
                    order = np.argsort(own, kind="stable")
                    count = np.bincount(own, minlength=len(following))
                    nth = np.empty(j - i, np.int64)
                    nth[order] = np.arange(j - i) - np.repeat(np.cumsum(count) - count, count)
                    out[i:j] = following[own] + nth
                    following += count
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "seq"), column(batch, "id"), column(batch, "fall"), pa.array((out // size).astype(np.int32)), pa.array(out)],
                    ["seq", "id", "fall", "part", "place"])

        dealt = now.withColumn("digit", digit).repartition(parts, "part").sortWithinPartitions("part", "place")
        after = written(dealt.mapInArrow(place, "seq long, id long, fall long, part int, place long"), "keys")
        offsets.unpersist()
        removed(spark, now)
        now = after
    return now.select("seq", (F.col("place") + 1).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null where the document is not drawn.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred are drawn (rounded down).
    """
    table = scored(docs, target, seed)
    able = table.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    best = ranks(able.select("seq", "doc_id", "score")).where(F.col("rank") <= drawn).select(F.col("seq").alias("s"), "rank")
    return table.join(best, F.col("seq") == F.col("s"), "left").select("doc_id", "n_features", "weight", "score", "rank")
