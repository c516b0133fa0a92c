"""MinHash near-duplicates by an LSH forest over sorted signature orders.

A document's set holds the 64-bit hashes of its shingles; equal sets are one
node under their least id.  A signature is 63 minima; the forest sorts all
signatures in 21 orders, each beginning with three minima of its own and going
on through the rest.  Sorting is by range partitioning on the whole order, so a
hot region lies on many tasks.

Depth adapts per region.  Neighbours that agree on the first three minima form a
region; inside a small one (``WINDOW`` rows) all members are candidates of each
other.  In a larger one a row looks at the ``WINDOW`` before it in the order,
which share the longest prefixes, and the two that agree best become candidates.
A pair goes on if enough of all 63 minima agree: a pair at the threshold falls
short with odds below 10**-7, and of 21 orders none begins alike with odds below
10**-8 at 0.85.

Candidates are confirmed on full sets: one of every document first, then those
that still lie between components.  What
large regions leave apart is decided exactly: members of one region in several
components are joined on their rare shingles (a set must meet a partner among its
``n - ceil(threshold * n) + 1`` rarest), so no link between them is lost.

Defined results: null and empty texts (and texts of white space) have no
shingles and are linked with nothing; rows with a null ``doc_id`` keep their
size, link with nothing and are kept (null component); rows that repeat a
``doc_id`` are one document with several texts; of equal sets the least id
stays; an empty table gives no rows; other columns are ignored.  A very long
text is one row of numpy arrays; its signature has the size of any other.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratapanel.llm.arrow import column, concatenated, slices
from stratapanel.llm.components import components
from stratapanel.llm.store import removed, width, written
from stratapanel.llm.words import mixed, shingle_sets

TREES, DEPTH = 21, 3
MINIMA = TREES * DEPTH
#: Minima at the head of an order that keep 16 bits; the others keep 8.
WIDE = 6
#: Bytes of an order: its number, the wide head, the rest.
LABEL = 1 + 2 * WIDE + MINIMA - WIDE
REGION = 1 + 2 * DEPTH
WINDOW = 24
#: Rows of an order compared at once in a task.
CHUNK = 1 << 16
#: Distinct sets of which a task remembers that it has signed them.
REMEMBERED = 200_000
_SEEDS = (mixed(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


@lru_cache(8)
def least_matches(threshold: int, odds: float = 1e-7) -> int:
    """Fewest equal minima that a pair at the threshold falls below with at most these odds."""
    p, tail, chance = threshold / 100, 0.0, (1 - threshold / 100) ** MINIMA if threshold < 100 else 0.0
    for m in range(MINIMA):
        tail += chance
        if tail > odds or threshold == 100:
            return MINIMA if threshold == 100 else m
        chance *= (MINIMA - m) / (m + 1) * p / (1 - p)
    return MINIMA


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """63 minima of 16 bits of each (non-empty) set."""
    if not sets:
        return np.zeros((0, MINIMA), np.uint16)
    tokens = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), MINIMA), np.uint16)
    for k, seed in enumerate(_SEEDS):
        v = tokens * seed
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        out[:, k] = (np.minimum.reduceat(v, starts) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def labels(minima: np.ndarray, tree: int) -> np.ndarray:
    """Bytes by which an order sorts."""
    turned = np.roll(minima, -DEPTH * tree, axis=1)
    head = turned[:, :WIDE].astype(">u2").view(np.uint8).reshape(len(minima), -1)
    return np.concatenate([np.full((len(minima), 1), tree, np.uint8), head, turned[:, WIDE:].astype(np.uint8)], axis=1)


def _indexed(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null without one or without an id), minima (null where the task has signed the set before, or nothing but an equal set can link)."""

    def run(batches):
        known: set[bytes] = set()
        for part in slices(batches, "text"):
            sets = shingle_sets(*concatenated(column(part, "text")), words)
            ids = column(part, "doc_id").to_pylist()
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) and i is not None else None for s, i in zip(sets, ids)]
            fresh = []
            for k, (s, d) in enumerate(zip(sets, digests)):
                if d is not None and d not in known and len(s) * 100 >= threshold * (len(s) + 1):
                    fresh.append(k)
                    if len(known) < REMEMBERED:
                        known.add(d)
            minima: list[bytes | None] = [None] * len(ids)
            for k, row in zip(fresh, signatures([sets[k] for k in fresh])):
                minima[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(minima, pa.binary())],
                ["doc_id", "n_shingles", "digest", "minima"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, minima binary")


def _fixed(array: pa.Array, size: int) -> np.ndarray:
    """Rows of a binary column whose values all have ``size`` bytes."""
    array = array.cast(pa.large_binary())
    if not len(array):
        return np.zeros((0, size), np.uint8)
    first = int(np.frombuffer(array.buffers()[1], np.int64)[array.offset])
    return np.frombuffer(array.buffers()[2], np.uint8)[first: first + size * len(array)].reshape(-1, size)


def _orders(nodes: DataFrame) -> DataFrame:
    """label, id, n of every node in every order."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            minima = _fixed(column(batch, "minima"), 2 * MINIMA).copy().view(np.uint16)
            for tree in range(TREES):
                raw = pa.py_buffer(labels(minima, tree).tobytes())
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LABEL), len(minima), [None, raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([rows, column(batch, "id"), column(batch, "n")], ["label", "id", "n"])

    return nodes.where("minima IS NOT NULL").select("minima", "id", "n").mapInArrow(run, "label binary, id long, n long")


def neighbours(rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray, new: int, threshold: int, window: int = WINDOW):
    """Candidates and large regions of consecutive rows of sorted orders.

    Pairs (a < b, matches) whose later row is among the last ``new``; and the
    places of all rows in regions that are large or touch an end of the rows.
    """
    heads = rows[:, :REGION]
    run = np.cumsum(np.append(True, (heads[1:] != heads[:-1]).any(1))) - 1
    length = np.bincount(run)
    large = length > window + 1
    large[[0, -1]] = True
    wide = np.ascontiguousarray(rows[:, 1: 1 + 2 * WIDE]).view(np.uint16)
    rest = rows[:, 1 + 2 * WIDE:]
    social = np.flatnonzero((length[run] > 1) & (np.arange(len(rows)) >= len(rows) - new))
    first = np.cumsum(length) - length
    found = []
    for k in range(1, window + 1):
        later = social[social - k >= first[run[social]]]
        if not len(later):
            break
        earlier = later - k
        small, big = np.minimum(sizes[later], sizes[earlier]), np.maximum(sizes[later], sizes[earlier])
        near = (small * 100 >= big * threshold) & (ids[later] != ids[earlier])
        later, earlier = later[near], earlier[near]
        matches = (wide[later] == wide[earlier]).sum(1) + (rest[later] == rest[earlier]).sum(1)
        close = matches >= least_matches(threshold)
        found.append((later[close], earlier[close], matches[close]))
    dense = np.flatnonzero(large[run] & (length[run] > 1) | (run == 0) | (run == run[-1]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), dense
    later, earlier, matches = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((-matches, later))
    later, earlier, matches = later[order], earlier[order], matches[order]
    nth = np.arange(len(later)) - np.searchsorted(later, later)
    kept = (nth < 2) | ~large[run[later]]
    a, b = ids[later[kept]], ids[earlier[kept]]
    return np.minimum(a, b), np.maximum(a, b), matches[kept], dense


def _candidates(nodes: DataFrame, threshold: int) -> DataFrame:
    """a, b, matches of candidate pairs; or region, a of a member of a large region (b null)."""

    def run(batches):
        held: list[tuple] = []
        tail, waiting = None, 0

        def flush():
            parts = ([tail] if tail is not None else []) + held
            rows, ids, sizes = (np.concatenate(x) for x in zip(*parts))
            a, b, m, dense = neighbours(rows, ids, sizes, waiting, threshold)
            regions = [int.from_bytes(hashlib.blake2b(rows[i, :REGION].tobytes(), digest_size=8).digest(), "little", signed=True) for i in dense]
            none = pa.nulls(len(dense), pa.int64())
            out = pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(a, pa.int64()), pa.array(ids[dense], pa.int64())]), pa.concat_arrays([pa.array(b, pa.int64()), none]),
                 pa.concat_arrays([pa.array(m, pa.int64()), none]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(regions, pa.int64())])],
                ["a", "b", "matches", "region"])
            return out, (rows[-WINDOW:], ids[-WINDOW:], sizes[-WINDOW:])

        for batch in batches:
            if batch.num_rows:
                held.append((_fixed(column(batch, "label"), LABEL).copy(), column(batch, "id").to_numpy(), column(batch, "n").to_numpy()))
                waiting += batch.num_rows
            if waiting >= CHUNK:
                out, tail = flush()
                held, waiting = [], 0
                yield out
        if waiting:
            yield flush()[0]

    sort = ["label", "id"]
    ordered = _orders(nodes).repartitionByRange(width(nodes.sparkSession), *sort).sortWithinPartitions(*sort)
    return ordered.mapInArrow(run, "a long, b long, matches long, region long")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """id, tokens (binary: sorted 64-bit hashes) of the sets."""

    def run(batches):
        for part in slices(batches, "text"):
            sets = [s.tobytes() for s in shingle_sets(*concatenated(column(part, "text")), words)]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(sets, pa.binary())], ["id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, tokens binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose full sets link."""

    def run(batches):
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(column(batch, "x"), column(batch, "y"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) * 100 >= max(len(x), len(y)) * threshold:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both * 100 >= (len(x) + len(y) - both) * threshold:
                        kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    left = sets.select(F.col("id").alias("ia"), F.col("tokens").alias("x"))
    right = sets.select(F.col("id").alias("ib"), F.col("tokens").alias("y"))
    met = pairs.select("a", "b").join(left.hint("merge"), F.col("a") == F.col("ia")).join(right.hint("merge"), F.col("b") == F.col("ib"))
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _labelled(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``pairs`` between different components, with the component of either side."""
    of = found.select(F.col("id").alias("i"), "component")
    for side, name in (("a", "ca"), ("b", "cb")):
        pairs = pairs.join(of, F.col(side) == F.col("i"), "left").withColumn(name, F.coalesce("component", side)).drop("i", "component")
    return pairs.where("ca != cb")


def _merged(label: DataFrame, fresh: DataFrame) -> DataFrame:
    """``label`` (id, component) with the links ``fresh`` (a, b): components of the components they tie."""
    if fresh.isEmpty():
        return label
    tied = _labelled(fresh, label)
    above = components(tied.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    # Ends that no link had met before are components of their own.
    alone = fresh.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(label.select(F.col("id").alias("i")), F.col("id") == F.col("i"), "left_anti")
    every = label.unionByName(alone.select("id", F.col("id").alias("component")))
    up = above.select(F.col("id").alias("c"), F.col("component").alias("top"))
    return written(every.join(up, F.col("component") == F.col("c"), "left").select("id", F.coalesce("top", "component").alias("component")), "labels")


def rarely_shared(sets: DataFrame, threshold: int) -> DataFrame:
    """Distinct pairs (a < b) of different parts among ``sets`` (id, part, tokens) that can still link.

    A set's shingles in order of rarity (then value): two sets that link meet
    within the first ``n - ceil(n * threshold / 100) + 1`` of either, and what
    follows the meeting bounds what they share.  Counts are aggregated before
    they meet the rows; a set is sorted as an array of its own.
    """

    def tokens(batches):
        for batch in batches:
            for i, raw in enumerate(column(batch, "tokens")):
                own = np.frombuffer(raw.as_buffer(), np.int64)
                name, part = column(batch, "id")[i].as_py(), column(batch, "part")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), name)), pa.array(np.full(len(own), part)), pa.array(own)], ["id", "part", "token"])

    every = written(sets.select("id", "part", "tokens").mapInArrow(tokens, "id long, part long, token long"), "tokens")
    often = every.groupBy("token").agg(F.count(F.lit(1)).alias("often")).select(F.col("token").alias("t"), "often")
    ranked = every.join(often, F.col("token") == F.col("t")).groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("own"))
    n = F.size("own").cast("bigint")
    prefix = ranked.select("id", "part", n.alias("n"), F.posexplode(F.slice("own", F.lit(1), (n - F.ceil(n * threshold / 100) + 1).cast("int"))).alias("place", "s"))
    first = written(prefix.where("s.often > 1").select(F.col("s.token").alias("token"), "id", "part", "n", (F.col("place") + 1).cast("bigint").alias("place")), "rare")
    # The commonest part of a shingle is not joined with itself.
    held = first.groupBy("token", "part").agg(F.count(F.lit(1)).alias("c"))
    major = held.groupBy("token").agg(F.max_by("part", F.struct("c", "part")).alias("major"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.col("token").alias("t"), "major")
    first = first.join(major, F.col("token") == F.col("t")).drop("t")
    other = first.select(F.col("token").alias("t2"), F.col("part").alias("p2"), F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    rest = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) + 1
    met = first.where("part != major").join(
        other, (F.col("token") == F.col("t2")) & (F.col("part") != F.col("p2")) & ((F.col("p2") == F.col("major")) | (F.col("id") < F.col("id2")))
        & (rest * (100 + threshold) >= (F.col("n") + F.col("n2")) * threshold))
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def clustered(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), kept (whether that is the row's own), a row for every row of ``docs``."""
    spark = docs.sparkSession
    index = written(_indexed(docs, words, threshold), "index")
    distinct = index.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.max("minima").alias("minima"))
    nodes = written(distinct, "nodes")
    found = written(_candidates(nodes, threshold), "candidates")
    pairs = written(found.where("b IS NOT NULL").groupBy("a", "b").agg(F.max("matches").alias("matches")), "pairs")
    regions = found.where("b IS NULL").select("region", F.col("a").alias("id")).distinct()
    crowded = regions.groupBy("region").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("region").alias("r"))
    regions = written(regions.join(crowded, F.col("region") == F.col("r")).select("region", "id"), "regions")
    removed(spark, found)

    # An id whose rows have several sets ties them together.
    near = nodes.select(F.col("digest").alias("d"), F.col("id").alias("node"))
    rows = written(index.select("doc_id", "n_shingles", "digest").join(near, F.col("digest") == F.col("d"), "left").select("doc_id", "n_shingles", "node"), "rows")
    removed(spark, index)
    several = rows.where("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.array_sort(F.collect_set("node")).alias("every")).where(F.size("every") > 1)
    links = several.select("a", F.explode("every").alias("b")).where("a < b")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("w")).unionByName(regions.select(F.col("id").alias("w"))).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = written(_sets(texts.join(wanted.hint("merge"), F.col("doc_id") == F.col("w"), "left_semi"), words), "sets")
    removed(spark, nodes)

    # A document's first partner: the least of those that agree well, so that links gather round few ids; else the best.
    well = F.min(F.when(F.col("matches") * 100 >= MINIMA * (threshold + 3), F.col("a")))
    best = pairs.groupBy("b").agg(F.coalesce(well, F.max_by("a", F.struct(F.col("matches"), -F.col("a")))).alias("a")).select("a", "b")
    best = written(best, "best")
    label = components(links.unionByName(_confirmed(best, sets, threshold)))

    tried = best.select(F.col("a").alias("ta"), F.col("b").alias("tb"))
    left = pairs.join(tried, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")
    left = written(_labelled(left, label).select("a", "b"), "left")
    label = _merged(label, written(_confirmed(left, sets, threshold), "links"))

    # What large regions leave in several components.
    of = label.select(F.col("id").alias("i"), "component")
    held = regions.join(of, F.col("id") == F.col("i"), "left").select("region", "id", F.coalesce("component", "id").alias("part"))
    apart = held.groupBy("region").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select(F.col("region").alias("r"))
    open_ids = written(held.join(apart, F.col("region") == F.col("r")).select(F.col("id").alias("o"), "part").distinct(), "open")
    if not open_ids.isEmpty():
        more = rarely_shared(sets.join(open_ids.hint("merge"), F.col("id") == F.col("o")).select("id", "part", "tokens").dropDuplicates(["id", "tokens"]), threshold)
        tested = tried.unionByName(left.select(F.col("a").alias("ta"), F.col("b").alias("tb")))
        more = more.join(tested, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")
        label = _merged(label, written(_confirmed(more, sets, threshold), "links"))
    removed(spark, sets)
    of = label.select(F.col("id").alias("i"), "component")
    whole = rows.join(of, F.col("node") == F.col("i"), "left").select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))
    return whole.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
