"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared as code points, in lower case and with each run of ASCII
white space as one space.  A benchmark item has windows of each of the lengths
``WINDOWS``, one every ``STRIDE`` characters and one at its end (an item shorter
than that is one window); one that occurs in a text with at most one edit per
``EDIT_SHARE`` characters shares ``len - q + 1 - edits * q`` of its q-grams with
it, all inside ``edits + 1`` neighbouring diagonals.  So a passage is found
wherever it begins in the item if it holds 54 of the item's characters with at
most 2 edits, or 84 with at most 4.

Every q-gram of every text is looked up in the items; hits are counted in
overlapping diagonal bands twice that wide, first for the item as a whole, then
for its windows; windows that reach the bound in a band are verified by banded
alignment, and verified windows of one item that touch are one region.

The items are a stated query set: they are read in blocks of ``BLOCK`` characters
at most, and each block's index is broadcast to one pass over the texts.

Defined results: null and empty texts hold nothing; items of fewer than
``2 * Q`` characters are too short to tell a leak and are passed over; repeated
items and documents each give their own regions; empty tables give no regions;
null ids are kept; other columns are ignored (``cleaned`` keeps them).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratapanel.llm.arrow import column, slices

Q, EDIT_SHARE = 14, 20
WINDOWS, STRIDE = (50, 80), 5
BLOCK = 2_000_000
GAP = 0x110000  # beside every text: no character
FAR = 1 << 20  # cost of a GAP: above every budget of edits
#: Hits whose windows are counted at once, and windows aligned at once.
HITS, ALIGNED = 100_000, 10_000
SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)


@lru_cache(1)
def _lower() -> np.ndarray:
    """Lower case of each code point that has one of a single code point; white space becomes a space."""
    table = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    table[SPACES] = 32
    return table


def normal(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points of all texts with GAP between them, each one's text, and its place in that text."""
    joined = "\x00".join(t or "" for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    sizes = np.array([len(t or "") for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.where(raw < 0x10000, _lower()[np.minimum(raw, 0xFFFF)], raw)
    codes[starts[1:] - 1] = GAP
    space = codes == 32
    keep = ~space
    keep[0:1] = True
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    row = np.searchsorted(starts, at, side="right") - 1
    return codes[at], row, at - starts[row]


def grams(codes: np.ndarray) -> np.ndarray:
    """32-bit hash of the Q characters from each position on."""
    if len(codes) < Q:
        return np.zeros(0, np.uint32)
    h, span = codes * np.uint32(0x9E3779B1), 1
    h ^= h >> np.uint32(15)
    while 2 * span <= Q:
        h = h[:-span] * np.uint32(0x85EBCA6B) + h[span:]
        h ^= h >> np.uint32(13)
        span *= 2
    if span < Q:  # the rest overlaps
        h = h[: len(h) - (Q - span)] * np.uint32(0xC2B2AE35) + h[Q - span:]
        h ^= h >> np.uint32(16)
    return h


class Index:
    """Q-grams and windows of one block of items."""

    def __init__(self, texts: list[str | None]):
        codes, row, _ = normal(texts)
        sizes = np.bincount(row[codes != GAP], minlength=len(texts)) if len(codes) else np.zeros(len(texts), int)
        self.codes, self.first = codes, np.searchsorted(row, np.arange(len(texts)))
        # Of each item and window length: the size, the first window's number, how many lie on the stride, how many there are.
        size = np.stack([np.minimum(sizes, w) for w in WINDOWS])
        size[1:][size[1:] == size[:-1]] = 0
        size[:, sizes < 2 * Q] = 0
        strided = np.where(size > 0, (sizes - size) // STRIDE + 1, 0)
        count = strided + ((size > 0) & ((sizes - size) % STRIDE > 0))
        number = (np.cumsum(count) - count.ravel()).reshape(count.shape)
        self.families = list(zip(size, number, strided, count))
        self.item = np.repeat(np.tile(np.arange(len(texts)), len(WINDOWS)), count.ravel())
        self.size = np.repeat(size.ravel(), count.ravel())
        nth = np.arange(len(self.size)) - np.repeat(number.ravel(), count.ravel())
        self.begin = self.first[self.item] + np.minimum(nth * STRIDE, sizes[self.item] - self.size)
        self.edits = np.minimum(self.size // EDIT_SHARE, (self.size - Q) // Q)
        self.bound = self.size - Q + 1 - self.edits * Q
        # What any window of an item needs at least.
        self.widest, self.least = np.zeros(len(texts), np.int64), np.full(len(texts), 1 << 40)
        np.maximum.at(self.widest, self.item, self.edits)
        np.minimum.at(self.least, self.item, self.bound)
        hashes = grams(codes)
        at = np.arange(len(hashes))
        owner = row[at]
        at = at[(at + Q <= (self.first + sizes)[owner]) & (sizes[owner] >= 2 * Q)]
        at = at[np.argsort(hashes[at], kind="stable")]
        self.at, self.owner, self.hash = at, row[at], hashes[at]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.hash & 0x3FFFFF] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in it, where it would begin in the text) of q-grams whose item has enough of them near its diagonal."""
        hashes = grams(codes)
        place = np.flatnonzero(self.seen[hashes & np.uint32(0x3FFFFF)])
        low = np.searchsorted(self.hash, hashes[place])
        count = np.searchsorted(self.hash, hashes[place], side="right") - low
        place, low, count = place[count > 0], low[count > 0], count[count > 0]
        entry = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item = self.owner[entry]
        inside = self.at[entry] - self.first[item]
        diagonal = np.repeat(place, count) - inside
        # A diagonal below zero: the item's beginning is missing from the first text.
        band = (diagonal + len(self.codes)) // (self.widest[item] + 1) + 1
        keys = item * (len(codes) + len(self.codes) + 3) + band
        both, back, n = np.unique(np.concatenate([keys, keys - 1]), return_inverse=True, return_counts=True)  # bands overlap by half
        good = n[back] >= np.tile(self.least[item], 2)
        keep = np.flatnonzero(good[: len(keys)] | good[len(keys):])
        return item[keep], inside[keep], diagonal[keep]

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """(window, first diagonal of a band) wherever a band holds enough q-grams of a window."""
        item, inside, diagonal = self.hits(codes)
        if not len(item):
            return np.zeros((0, 2), np.int64)
        order = np.lexsort((diagonal, item))
        item, inside, diagonal = item[order], inside[order], diagonal[order]
        # Parts that no band reaches across.
        apart = np.flatnonzero((np.diff(item) > 0) | (np.diff(diagonal) > 2 * (self.edits.max() + 1))) + 1
        found, start = [], 0
        while start < len(item):
            stop = apart[np.searchsorted(apart, start + 1):]
            more = np.searchsorted(stop, start + HITS, side="right")
            end = len(item) if not len(stop) or more == len(stop) and len(item) - start <= HITS else int(stop[max(more - 1, 0)])
            found.append(self._counted(item[start:end], inside[start:end], diagonal[start:end], len(codes)))
            start = end
        return np.concatenate(found)

    def _counted(self, item: np.ndarray, inside: np.ndarray, diagonal: np.ndarray, length: int) -> np.ndarray:
        wide = int(length + 2 * len(self.codes) + 3)
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def add(window: np.ndarray, diagonal: np.ndarray) -> None:
            nonlocal keys, n
            offset = self.begin[window] - self.first[self.item[window]]
            new = window * wide + (diagonal + offset + len(self.codes)) // (self.edits[window] + 1) + 1
            new, count = np.unique(np.concatenate([new, new - 1]), return_counts=True)  # bands overlap by half
            keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, count])).astype(np.int64)

        for size, number, strided, count in self.families:
            own, first, k, every = size[item], number[item], strided[item], count[item]
            for back in range((max(WINDOWS) - Q) // STRIDE + 1):
                nth = inside // STRIDE - back
                ok = (nth >= 0) & (nth < k) & (inside - nth * STRIDE <= own - Q)
                add((first + nth)[ok], diagonal[ok])
            last = (first + every - 1)[at_end := every > k]
            ok = inside[at_end] >= self.begin[last] - self.first[item[at_end]]
            add(last[ok], diagonal[at_end][ok])
        window = keys // wide
        good = n >= self.bound[window]
        window = window[good]
        return np.stack([window, (keys[good] % wide - 1) * (self.edits[window] + 1) - len(self.codes)], 1)

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of the regions found; offsets are code points of the given text."""
        codes, row, place = normal(texts)
        found = self.candidates(codes)
        out = []
        for size in np.unique(self.size[found[:, 0]]):
            every = found[self.size[found[:, 0]] == size]
            edits = int(self.edits[every[0, 0]])
            for own in np.split(every, range(ALIGNED, len(every), ALIGNED)):
                cost, start, end = aligned(self.codes, self.begin[own[:, 0]], int(size), codes, own[:, 1] - edits, 4 * (edits + 1))
                ok = cost <= edits
                for w, c, s, e in zip(own[ok, 0], cost[ok], start[ok], end[ok]):
                    if e > s:
                        out.append((int(row[s]), int(self.item[w]), int(place[s]), int(place[e - 1]) + 1, int(c)))
        merged: list[list[int]] = []
        for t, i, s, e, c in sorted(set(out)):
            if merged and merged[-1][:2] == [t, i] and s <= merged[-1][3]:
                merged[-1][3], merged[-1][4] = max(e, merged[-1][3]), max(c, merged[-1][4])
            else:
                merged.append([t, i, s, e, c])
        return [tuple(m) for m in merged]


def aligned(query: np.ndarray, begin: np.ndarray, size: int, text: np.ndarray, first: np.ndarray, width: int):
    """Least edits, start and end of each query window in the text, along the ``width`` diagonals from ``first`` on.

    No letter stands for a GAP and none is passed over, so what is found within a budget lies in one text.
    """
    padded = np.concatenate([np.full(1, GAP, text.dtype), text, np.full(1, GAP, text.dtype)])
    step = np.arange(width + 1)
    cost = np.zeros((len(begin), width + 1), np.int32)
    start = first[:, None] + step
    for i in range(size):
        here = padded[np.clip(first[:, None] + i + step + 1, 0, len(padded) - 1)]
        letter = query[begin + i][:, None]
        gap = (here == GAP) * np.int32(FAR)
        new = cost + np.maximum(here != letter, gap)
        origin = start.copy()
        skip = cost[:, 1:] + 1  # the query's letter is missing in the text
        less = skip < new[:, :-1]
        new[:, :-1][less], origin[:, :-1][less] = skip[less], start[:, 1:][less]
        # A letter too many in the text: one edit a step to the right, over the letter that stands there.
        gap[:, 0] = 0
        right = step + np.cumsum(gap, 1)
        level = new - right
        best = np.minimum.accumulate(level, 1)
        at = np.maximum.accumulate(np.where(level == best, step, 0), 1)
        cost, start = np.minimum(best + right, FAR), np.take_along_axis(origin, at, 1)
    best = cost.argmin(1)
    pick = np.arange(len(begin))
    begins = np.clip(start[pick, best], 0, len(text))
    return cost[pick, best], begins, np.clip(first + size + best, begins, len(text))


def blocks(benchmark: DataFrame, id_column: str):
    """(ids, texts) of the items, at most BLOCK characters at a time."""
    ids, texts, total = [], [], 0
    for r in benchmark.select(id_column, "text").toLocalIterator():
        if ids and total + len(r[1] or "") > BLOCK:
            yield ids, texts
            ids, texts, total = [], [], 0
        ids.append(r[0]), texts.append(r[1])
        total += len(r[1] or "")
    if ids:
        yield ids, texts


def regions(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits of every region of a text that holds (a window of) an item."""
    spark, out = docs.sparkSession, None
    for ids, texts in blocks(benchmark, "item_id"):
        shared = spark.sparkContext.broadcast((ids, Index(texts)))

        def run(batches, shared=shared):
            names, index = shared.value
            for part in slices(batches, "text"):
                found = index.matches(column(part, "text").to_pylist())
                doc = column(part, "doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc[f[0]] for f in found], pa.int64()), pa.array([names[f[1]] for f in found], pa.int64()),
                     *(pa.array([f[k] for f in found], pa.int32()) for k in (2, 3, 4))], ["doc_id", "item_id", "start", "end", "edits"])

        one = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, item_id long, start int, end int, edits int")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, start int, end int, edits int")


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any region, with all their columns."""
    for _, texts in blocks(benchmark, "item_id"):
        shared = docs.sparkSession.sparkContext.broadcast(Index(texts))

        def run(batches, shared=shared):
            for part in slices(batches, "text"):
                leaks = {f[0] for f in shared.value.matches(column(part, "text").to_pylist())}
                yield part.filter(pa.array([k not in leaks for k in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
