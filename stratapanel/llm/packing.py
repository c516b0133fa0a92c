"""Best-fit packing of token pieces by exact-complement hashing.

``cut`` turns documents into pieces of at most ``capacity`` ids; ``pack`` gives
every piece a sequence and an offset.  The plan needs the piece lengths alone:
at most ``capacity`` counts, whatever the corpus holds.  Lengths are taken from
the longest down; the gap each leaves is looked up among the single lengths, the
sums of pairs and the sums of triples, and a combination that fills it exactly
is consumed as often as the counts allow.  What no combination fills goes to
best-fit over bins grouped by their free space.  Every step works on whole
counts, so the plan's size is bounded by the lengths, not by the pieces.

Pieces then take the plan's places by their rank among the pieces of equal
length.  Ranks are numbered inside each task's part of the table and shifted by
the parts before, so a length that most pieces share is never gathered in one
task.

Defined results: a null or empty text is one piece holding the end id; null and
repeated ``doc_id`` values are kept as rows of their own; an empty table gives no
rows; further columns of ``pack``'s input are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from stratapanel.llm.arrow import column, slices
from stratapanel.llm.store import unused, written
from stratapanel.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def cut(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece (from 0), start (the document's ids before it), length, ids (binary, little-endian unsigned 32-bit)."""

    def run(batches):
        enc, end, step = encoder(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for part in slices(batches, "text"):
            rows = []
            for doc, text in zip(column(part, "doc_id").to_pylist(), column(part, "text").to_pylist()):
                ids = enc.encode(text) + end
                rows += [(doc, k // step, k // 4, len(x := ids[k: k + step]) // 4, x) for k in range(0, len(ids), step)]
            doc, piece, start, length, ids = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def _complement(have: np.ndarray, gap: int, taken: int) -> tuple[int, ...]:
    """Lengths, three at most, that fill ``gap`` exactly; ``have`` already lacks the piece ``taken``.

    A larger part is preferred, as small ones stay useful for other gaps.
    """
    if have[gap] > 0:
        return (gap,)
    low = np.arange(1, gap // 2 + 1)
    fits = low[(have[low] > 0) & (have[gap - low] > (low == gap - low))]
    if len(fits):
        return (int(gap - fits[0]), int(fits[0]))
    for first in np.flatnonzero(have[: gap - 1] > 0)[::-1]:
        if first < -(-gap // 3):  # the largest of three
            break
        rest = gap - int(first)
        low = np.arange(max(1, rest - int(first)), rest // 2 + 1)
        high = rest - low
        fits = low[(have[low] > (low == first)) & (have[high] > (high == low).astype(int) + (high == first) + ((low == first) & (high == first)))]
        fits = [x for x in fits[:1] if x > 0]
        if fits:
            return (int(first), rest - int(fits[0]), int(fits[0]))
    return ()


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences): every piece exactly once."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} ids does not fit {capacity}")
        have[length] += n
    made, left = [], {}

    def consume(pattern, times):
        for x in pattern:
            have[x] -= times
        made.append((pattern, int(times)))

    for length in range(capacity, 0, -1):
        if have[length] and length == capacity:
            consume((length,), have[length])
        while have[length] > 0:
            have[length] -= 1
            rest = _complement(have, capacity - length, length)
            have[length] += 1
            if not rest:
                left[length] = int(have[length])
                have[length] = 0
                break
            pattern = (length, *rest)
            consume(pattern, min(have[x] // pattern.count(x) for x in set(pattern)))
    return made + _best_fit(left, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over (lengths, number of bins) grouped by free space."""
    free: dict[int, dict[tuple[int, ...], int]] = {}

    def put(pattern, times):
        if times:
            group = free.setdefault(capacity - sum(pattern), {})
            group[pattern] = group.get(pattern, 0) + times

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            space = min((s for s, g in free.items() if s >= length and g), default=None)
            if space is None:
                per = capacity // length
                put((length,) * per, n // per)
                put((length,) * (n % per), int(n % per > 0))
                break
            pattern, bins = free[space].popitem()
            if not free[space]:
                del free[space]
            fit = space // length  # as many as the bin takes, bin after bin
            full = min(bins, n // fit)
            put(pattern + (length,) * fit, full)
            n, bins = n - full * fit, bins - full
            if bins and 0 < n < fit:
                put(pattern + (length,) * n, 1)
                n, bins = 0, bins - 1
            put(pattern, bins)
    return [(p, n) for group in free.values() for p, n in group.items()]


def pack(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset; sequences are filled from 0 without gaps."""
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    part_column, row_column, rank_column = unused(pieces, "part", "row", "rank")
    stored = written(pieces.select(kept).withColumn(part_column, F.spark_partition_id()).withColumn(row_column, F.monotonically_increasing_id()), "pieces")
    sums = written(stored.groupBy(F.col(part_column).alias("p"), F.col(length).alias("l")).agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {int(r["l"]): int(r["n"]) for r in sums.groupBy("l").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    sizes, starts, bases, offsets, ids = [], [], [], [], 0
    used = dict.fromkeys(counts, 0)
    for pattern, times in plan(counts, capacity):
        at = 0
        for x in pattern:
            sizes.append(x), starts.append(used[x]), bases.append(ids), offsets.append(at)
            used[x] += times
            at += x
        ids += times
    order = np.lexsort((starts, sizes)) if sizes else np.zeros(0, int)
    sizes, starts, bases, offsets = (np.array(a, np.int64)[order] for a in (sizes, starts, bases, offsets))
    first = np.searchsorted(sizes, np.arange(capacity + 2))

    def places(batches):
        for batch in batches:
            lengths = column(batch, length).to_numpy(zero_copy_only=False).astype(np.int64)
            ranks = column(batch, rank_column).to_numpy(zero_copy_only=False)
            at = np.zeros(len(lengths), np.int64)
            for x in np.unique(lengths):
                mine = lengths == x
                own = starts[first[x]: first[x + 1]]
                at[mine] = first[x] + np.searchsorted(own, ranks[mine], side="right") - 1
            others = [k for k, name in enumerate(batch.schema.names) if name != rank_column]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in others), pa.array(bases[at] + ranks - starts[at], pa.int64()), pa.array(offsets[at], pa.int64())],
                [*(batch.schema.names[k] for k in others), "sequence_id", "offset"])

    before = F.coalesce(F.sum("n").over(W.partitionBy("l").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sums.select("p", "l", before.cast("bigint").alias("before"))
    inside = F.row_number().over(W.partitionBy(part_column, length).orderBy(row_column)) - 1
    ranked = stored.withColumn(rank_column, inside)
    joined = ranked.join(shifts, (ranked[part_column] == shifts["p"]) & (ranked[length] == shifts["l"]))
    joined = joined.select(*[ranked[c] for c in kept], (shifts["before"] + ranked[rank_column]).alias(rank_column))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != rank_column)
    return joined.mapInArrow(places, f"{schema}, sequence_id long, offset long")
