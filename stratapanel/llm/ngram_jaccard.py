"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

A document's set holds the 64-bit hashes of its shingles.  Sizes fall into
bands; a band fixes how far two linked sets can differ (``H`` shingles) and cuts
the universe of hashes into ``H + 1 + guard`` segments.  Two linked sets then
agree exactly on at least ``guard + 1`` segments, so each set is indexed by the
content of its segments under its own band, and under the next where a partner
can reach it.

Allocation by cost: an empty segment would meet every other set that is empty
there, so it gets no signature; the guard segments pay for that.  A set with
more empty segments than the guard covers is also indexed by the one-deletion
neighbourhoods of its segments: where agreement rests on empty segments alone,
all but a few of the others differ by one shingle.  Only a set so empty that
even this may fail (``_signatures`` has the bound) indexes its empty segments.

Sets that meet under a signature are compared with the least id there, exactly,
if they share enough signatures for their sizes; connected components follow.
Members of one signature that are still in several components may link as well.
Of those, pairs are compared that share one of their rarest shingles, early
enough in both sets (in order of rarity) for the rest to reach the threshold.
So no link is lost, and in a large group of near copies a member costs a few
comparisons: those tied together already are not compared again, and those with
many shingles of their own meet nobody.

Verification counts shared 64-bit hashes (two different shingles of one pair
share a hash with odds of about 10**-13 for sets of a thousand).

Defined results: null and empty texts (and texts of white space) have no
shingles and are linked with nothing; rows with a null ``doc_id`` keep their
size but are linked with nothing; rows that repeat a ``doc_id`` count as one
document with several texts; an empty table gives no rows; other columns are
ignored (``deduplicated`` keeps them).
"""

from __future__ import annotations

import hashlib
import math
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from stratapanel.llm.arrow import column, concatenated, slices
from stratapanel.llm.components import components
from stratapanel.llm.store import removed, unused, width, written
from stratapanel.llm.words import mixed, shingle_sets

#: Growth of a band's largest size; wide bands waste segments, narrow ones index twice.
GROWTH = 1.6
#: Distinct sets of which a task remembers the first document.
REMEMBERED = 200_000
#: Scheme numbers told apart by a signature's low bits, and a set size beyond any: its band is still below ``NUMBERS``.
NUMBERS, BEYOND = 64, 1 << 40
#: Scheme number of the mark that carries a row's sizes; no set is large enough for a scheme of this number.
SIZES = NUMBERS - 1


class Scheme:
    """Segments of one size band at one threshold (a percentage)."""

    def __init__(self, number: int, largest: int, threshold: int):
        self.number, self.largest = number, largest
        # 100 * both >= threshold * either bounds the symmetric difference by (100 - t) / (100 + t) of both sizes.
        self.differ = 2 * largest * (100 - threshold) // (100 + threshold)
        # Empty segments of the smallest sets of the band, and three deviations.
        empty = (self.differ + 1) * math.exp(-largest / GROWTH / (self.differ + 1))
        self.guard = math.ceil(empty + 3 * math.sqrt(empty)) if self.differ else 0
        self.segments = self.differ + 1 + self.guard

    @cached_property
    def tags(self) -> np.ndarray:
        return mixed((np.arange(self.segments, dtype=np.uint64) | np.uint64(self.number << 40)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


@lru_cache(4)
def schemes(threshold: int, up_to: int) -> list[Scheme]:
    out, largest = [], max(1, (100 + threshold) // (2 * (100 - threshold)) if threshold < 100 else 1)
    while not out or out[-1].largest < up_to:
        out.append(Scheme(len(out), largest, threshold))
        largest = max(largest + 1, int(largest * GROWTH))
    return out


def _signatures(tokens: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, int]:
    """Signatures of one sorted set under a scheme (whose number fills the low bits), and its empty segments."""
    segment = ((tokens >> np.uint64(32)) * np.uint64(scheme.segments) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    met, sizes = segment[first], np.diff(np.append(first, len(tokens)))
    parts = mixed(tokens + np.uint64(0xA0761D6478BD642F))
    sums = np.add.reduceat(parts, first)
    plain = mixed(sums ^ scheme.tags[met])
    out = [plain]
    empty = scheme.segments - len(met)
    if empty > scheme.guard:
        rich = np.repeat(sizes > 1, sizes)
        out.append(mixed((np.repeat(sums, sizes) - parts)[rich] ^ scheme.tags[segment[rich]]))
        # A partner's empty segments number this set's and those it can lose within the allowed difference.
        lost = int(np.searchsorted(np.cumsum(np.sort(sizes)), scheme.differ, side="right"))
        if 2 * empty + lost > scheme.segments + scheme.guard:
            bare = np.ones(scheme.segments, bool)
            bare[met] = False
            out.append(mixed(scheme.tags[bare]))
    marks = np.concatenate(out) & ~np.uint64(NUMBERS - 1) | np.uint64(scheme.number)
    return np.unique(marks), empty


def signatures(tokens: np.ndarray, threshold: int) -> tuple[np.ndarray, int, int, int]:
    """All signatures of a set, its own band's, and the next one's where a larger partner may be; the own band's number, and the empty segments under either."""
    n = len(tokens)
    reach = 100 * n // threshold
    every = schemes(threshold, 1 << (2 * reach).bit_length())
    own = next(s for s in every if s.largest >= n)
    marks, empty = _signatures(tokens, own)
    if reach <= own.largest:
        return marks, own.number, empty, 0
    more, other = _signatures(tokens, every[own.number + 1])
    return np.concatenate([marks, more]), own.number, empty, other


def _indexed(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """doc_id, n_shingles, band, empty and empty_next (segments under the band and the next), first (a document met earlier in the task with the same set), signatures (the first one is the row's own, under the number ``SIZES``)."""

    def run(batches):
        known: dict[bytes, int] = {}
        met = TaskContext.get().partitionId() << 40
        for part in slices(batches, "text"):
            raw, offsets = concatenated(column(part, "text"))
            ids = column(part, "doc_id").to_pylist()
            sets, first, marks = shingle_sets(raw, offsets, words), [], []
            bands = []
            own = mixed(np.arange(met, met + len(ids), dtype=np.uint64)) & ~np.uint64(NUMBERS - 1) | np.uint64(SIZES)
            met += len(ids)
            for k, (doc, tokens) in enumerate(zip(ids, sets)):
                one, mark, band = None, np.zeros(0, np.uint64), (0, 0, 0)
                if doc is not None and len(tokens):
                    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                    one = known.get(digest)
                    if one is None:
                        mark, *band = signatures(tokens, threshold)
                        if len(known) < REMEMBERED:
                            known[digest] = doc
                first.append(one), bands.append(tuple(band))
                marks.append(np.append(own[k], mark).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([b[k] for b in bands], pa.int32()) for k in range(3)), pa.array(first, pa.int64()), pa.array(marks, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "band", "empty", "empty_next", "first", "signatures"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, n_shingles long, band int, empty int, empty_next int, first long, signatures array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for part in slices(batches, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(*concatenated(column(part, "text")), words)]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, shingles array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose sets link."""
    left = sets.select(F.col("id").alias("ia"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("ib"), F.col("shingles").alias("sb"))
    sizes = F.size("sa") + F.size("sb")
    # Shuffled at every size: the plan that large tables need, and sets of a shuffle once made are used again.
    near = pairs.join(left.hint("merge"), F.col("a") == F.col("ia")).join(right.hint("merge"), F.col("b") == F.col("ib"))
    near = near.where(F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * threshold)
    both = F.size(F.array_intersect("sa", "sb"))
    return near.where(both * 100 >= (sizes - both) * threshold).select("a", "b").distinct()


def _needed(threshold: int, n, partner, band, empty, empty_next):
    """Signatures of the scheme ``number`` that a set of size ``n`` shares with every set of size ``partner`` that it links with.

    Segments that differ hold a difference each, and the others agree; those
    that are empty in the set have no signature.
    """
    segments = F.array(*[F.lit(s.segments) for s in schemes(threshold, BEYOND)])
    allowed = F.floor((n + partner) * (100 - threshold) / (100 + threshold))
    return F.element_at(segments, F.col("number") + 1) - allowed - F.when(F.col("number") == band, empty).otherwise(empty_next)


def _near(met: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """Distinct pairs (a, b) of ``met`` (a, b, number: a row for each signature they share) that share enough signatures to link."""
    shared = met.groupBy("a", "b", "number").agg(F.count(F.lit(1)).alias("shared"))
    shared = shared.join(sizes.withColumnsRenamed({"id": "i", "n": "own"}), F.col("a") == F.col("i"))
    shared = shared.join(sizes.select(F.col("id").alias("j"), F.col("n").alias("other")), F.col("b") == F.col("j"))
    return shared.where(F.col("shared") >= _needed(threshold, F.col("own"), F.col("other"), F.col("band"), F.col("empty"), F.col("empty_next"))).select("a", "b").distinct()


def _open(held: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """Distinct (o, part) of ``held`` (id, part, number: a row for each signature held across parts) with enough of them for any link."""
    largest = F.array(*[F.lit(s.largest) for s in schemes(threshold, BEYOND)])
    counts = held.groupBy("id", "part", "number").agg(F.count(F.lit(1)).alias("shared")).join(sizes.withColumnRenamed("id", "i"), F.col("id") == F.col("i"))
    partner = F.least(F.element_at(largest, F.col("number") + 1), F.floor(F.col("n") * 100 / threshold))
    enough = F.col("shared") >= _needed(threshold, F.col("n"), partner, F.col("band"), F.col("empty"), F.col("empty_next"))
    return counts.where(enough).select(F.col("id").alias("o"), "part").distinct()


def _rarely_shared(sets: DataFrame, threshold: int) -> DataFrame:
    """Distinct pairs (a, b) of different parts among ``sets`` (id, part, shingles) that can still link.

    With its shingles in order of rarity, a set must meet a partner within its
    first ``n - ceil(n * threshold / 100) + 1``; what follows the first meeting
    in either set bounds what they share.
    """
    # Equal sets are of one part; the least id stands for them.
    sole = sets.groupBy("part", F.size("shingles").cast("bigint").alias("n"), F.xxhash64("shingles").alias("h")).agg(F.min(F.struct("id", "shingles")).alias("s"))
    tokens = sole.select("part", "n", F.col("s.id").alias("id"), F.explode("s.shingles").alias("token"))
    often, mine = W.partitionBy("token"), W.partitionBy("id")
    tokens = tokens.withColumn("often", F.count(F.lit(1)).over(often)).where("often > 1")  # a set's own shingles come first, and meet nobody
    place = F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("often", "token"))
    first = tokens.withColumn("place", place).where((F.col("n") - F.col("place") + 1) * 100 >= F.col("n") * threshold)
    first = written(first.select("token", "part", "id", "n", "place"), "rarest")
    # The commonest part of a shingle is not joined with itself.
    parts = first.groupBy("token", "part").agg(F.count(F.lit(1)).alias("c"))
    major = parts.groupBy("token").agg(F.max_by("part", F.struct("c", "part")).alias("major"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.col("token").alias("t"), "major")
    first = first.join(major, F.col("token") == F.col("t"))
    other = first.select(F.col("token").alias("t2"), F.col("part").alias("p2"), F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    rest = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) + 1
    met = first.where("part != major").join(
        other, (F.col("token") == F.col("t2")) & (F.col("part") != F.col("p2")) & ((F.col("p2") == F.col("major")) | (F.col("id") < F.col("id2")))
        & (rest * (100 + threshold) >= (F.col("n") + F.col("n2")) * threshold))
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def joined(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), a row for every row of ``docs``."""
    spark = docs.sparkSession
    # Sizes travel with the signatures: the index is made once and never stored beside its shuffle.
    sizes_of = ("n_shingles", "band", "empty", "empty_next", "first")
    index = _indexed(docs, words, threshold).select("doc_id", *sizes_of, F.explode("signatures").alias("mark"))
    number = F.col("mark").bitwiseAND(NUMBERS - 1).cast("int").alias("number")
    marks = index.select("mark", F.col("doc_id").alias("id"), F.when(number == SIZES, F.struct(*sizes_of)).alias("sizes"))
    own = W.partitionBy("mark")
    met = marks.repartition(width(spark), "mark").select("mark", "id", "sizes", F.min("id").over(own).alias("least"), F.max("id").over(own).alias("most"))
    indexed = written(met.where("sizes IS NOT NULL OR least < most").select("mark", "id", "least", "sizes"), "met")
    met = indexed.where("sizes IS NULL").select("mark", "id", "least")
    rows = written(indexed.where("sizes IS NOT NULL").select(F.col("id").alias("doc_id"), "sizes.*"), "sizes")
    # Several texts of one id: no bound holds for all, so none is set.
    bound = lambda c: F.when(F.count(F.lit(1)) > 1, 1 << 30).otherwise(F.max(c)).alias(c)
    sizes = rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("n_shingles").alias("n"), F.max("band").alias("band"), bound("empty"), bound("empty_next"))

    pairs = written(_near(met.where("id > least").select(F.col("least").alias("a"), F.col("id").alias("b"), number), sizes, threshold), "pairs")
    wanted = written(met.select(F.col("id").alias("wanted")).distinct(), "wanted")
    sets = written(_sets(docs.join(wanted.hint("merge"), F.col("doc_id") == F.col("wanted"), "left_semi"), words), "sets", "none")
    copies = rows.where("first IS NOT NULL").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    links = written(_linked(pairs, sets, threshold).unionByName(copies), "links")
    found = components(links)

    # What the least ids have not tied together: members of one signature in several components.
    label = found.select(F.col("id").alias("i"), "component")
    held = met.select("mark", "id").join(label, F.col("id") == F.col("i"), "left").select("mark", "id", F.coalesce("component", "id").alias("part"))
    spread = held.groupBy("mark").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select(F.col("mark").alias("m"))
    open_ids = written(_open(held.join(spread, F.col("mark") == F.col("m")).select("id", "part", number), sizes, threshold), "open")
    more = _rarely_shared(sets.join(open_ids.hint("merge"), F.col("id") == F.col("o")).select("id", "part", "shingles"), threshold)
    tested = pairs.select(F.col("a").alias("ta"), F.col("b").alias("tb"))
    more = written(more.join(tested, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti"), "pairs")
    fresh = written(_linked(more, sets, threshold), "links")
    if not fresh.isEmpty():
        found = components(links.unionByName(fresh))
    for table in (indexed, wanted, sets, pairs, more, open_ids):
        removed(spark, table)
    label = found.select(F.col("id").alias("i"), "component")
    return rows.join(label, F.col("doc_id") == F.col("i"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with the document of least ``doc_id`` of every component; rows without an id stay.

    Of rows that repeat one kept id all stay, as they are one document.
    """
    copy, = unused(docs, "copy")
    copies = joined(docs, words, threshold).where("doc_id != component_id").select(F.col("doc_id").alias(copy)).distinct()
    return docs.join(copies, F.col("doc_id") == F.col(copy), "left_anti")
