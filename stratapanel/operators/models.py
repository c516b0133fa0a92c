"""Walk-forward ranking model: histogram gradient boosting for all cutoffs at once.

One model per (cutoff, setting), each with its own rounds, rate, depth, L2 and
bins.  Values are placed by a *mergeable sketch*: an integer key of 0.1 %
relative width.  Keys are counted per target date and feature, summed over the
dates before each cutoff, and cut at equal counts, so a cutoff's bin edges are
exact over the keys of its own embargoed rows and no row is sorted.

Rows become *tiles*: the bin codes and labels of up to ``PIECE_ROWS`` rows under
one cutoff.  Where there are models enough for every core, or at most ``TILE_ROWS``
rows, the tiles of a cutoff meet in one task per model, which grows all its rounds:
the whole fit is one job, its models side by side, and no tree passes the driver.
The task holds ``TILE_ROWS`` rows; more lie in a file of its own.  Few models of
more rows stay tiles, with an array of margins by setting.  A tree level of *every*
model is then one job: each task turns its tiles into partial histograms (gradient,
hessian and count per model, node, feature and bin), which are summed per model and
searched for the best split.  Only splits reach the driver, and no task holds more
than a tile and the histograms of its models; every few rounds the margins are
written anew, so a lost executor costs one level.

The fitted forest is a table of trees (setting, cutoff, round); a date is scored
by the latest model at or before it.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapanel.operators.timeseries import FEATURES
from stratapanel.scale import even_width
from stratapanel.session import dropped, stored

MIN_LEAF_ROWS, MIN_LEAF_HESSIAN, MIN_GAIN = 20, 1e-3, 1e-12
#: Gains are compared after rounding to this many places; ties go to the first feature, then the lowest bin.
GAIN_PLACES = 9
#: Keys per unit of the natural logarithm, the key of 1.0, and the least magnitude told from zero.
KEYS_PER_E, KEY_OF_ONE, LEAST = 1000, 25_000, 1e-10
#: Rows of a model that a task holds, rows of a tile, and rows that are worked on together (65,536 at most: their places take two bytes).
TILE_ROWS, PIECE_ROWS, BLOCK = 5_000_000, 50_000, 65_536
#: Rows x models that a task works on at least.
TASK_ROWS = 100_000
STORE_EVERY = 4


@dataclass(frozen=True)
class Setting:
    """Model parameters; defaults are the ranker's published ones."""

    name: str = "baseline"
    max_depth: int = 3
    l2: float = 0.0
    iterations: int = 200
    learning_rate: float = 0.05
    bins: int = 255


# The predeclared grid; order decides exact ties (fixed values).
CANDIDATES = (
    Setting("baseline", 3, 0.0), Setting("depth2_l2_1", 2, 1.0), Setting("depth2_l2_10", 2, 10.0),
    Setting("depth3_l2_1", 3, 1.0), Setting("depth3_l2_10", 3, 10.0),
)


def sketch_key(value: Column) -> Column:
    """Integer whose order is that of the values, 0.1 % of relative width; the sketch's cells."""
    size = F.abs(value)
    cell = F.ceil(F.least(F.ln(size), F.lit(40.0)) * KEYS_PER_E) + KEY_OF_ONE
    return F.when(size < LEAST, 0).otherwise(F.signum(value) * cell).cast("int")


def keyed(dataset: DataFrame) -> DataFrame:
    """``dataset`` with the sketch keys of its features; rows without all of them are left out."""
    return dataset.dropna(subset=list(FEATURES)).withColumn("keys", F.array(*[sketch_key(F.col(f)) for f in FEATURES]))


def training_sets(dataset: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Labelled rows copied to every later cutoff (the calendar bounds their list): expanding, embargoed windows."""
    listed = cutoffs.agg(F.sort_array(F.collect_set("prediction_date"))).scalar()
    labelled = dataset.where(F.col("target_date").isNotNull() & F.col("target").isNotNull()).withColumn("_c", listed)
    return labelled.withColumn("cutoff", F.explode(F.filter("_c", lambda c: c > F.col("target_date")))).drop("_c")


def bin_edges(dataset: DataFrame, cutoffs: DataFrame, bins: int) -> DataFrame:
    """(cutoff, feature, edges): ascending keys at which the cumulative count passes a multiple of 1 / ``bins``.

    Counts per target date are merged over the dates before each cutoff.
    """
    labelled = dataset.where(F.col("target_date").isNotNull() & F.col("target").isNotNull())
    cells = labelled.select("target_date", F.posexplode("keys").alias("feature", "key")).groupBy("target_date", "feature", "key").agg(F.count(F.lit(1)).alias("n"))
    merged = training_sets(cells.withColumn("target", F.lit(0)), cutoffs).groupBy("cutoff", "feature", "key").agg(F.sum("n").alias("n"))
    line = Window.partitionBy("cutoff", "feature")
    upto = F.sum("n").over(line.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    passed = lambda c: F.least(F.expr(f"{c} * {bins} div total"), F.lit(bins - 1))
    at = merged.withColumn("upto", upto).withColumn("total", F.sum("n").over(line)).withColumn("before", F.col("upto") - F.col("n"))
    edge = F.when(passed("upto") > passed("before"), F.col("key"))
    return at.groupBy("cutoff", "feature").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


class Trees:
    """Trees of all models in heap layout, as arrays: split feature (-1: leaf), bin, gain, and value of every node."""

    def __init__(self, models: int, depth: int):
        self.feature = np.full((models, 2**depth), -1, np.int8)
        self.bin = np.zeros((models, 2**depth), np.int16)
        self.gain = np.full((models, 2**depth), np.nan)
        self.value = np.zeros((models, 2 ** (depth + 1)))


def reached(codes: np.ndarray, feature: np.ndarray, bin_: np.ndarray, depth: int) -> np.ndarray:
    """Node of one tree that each row of bin codes reaches."""
    node, rows = np.ones(len(codes), np.int64), np.arange(len(codes))
    for _ in range(depth):
        inner = np.minimum(node, len(feature) - 1)
        split = feature[inner]
        goes = (split >= 0) & (node < len(feature))
        node = np.where(goes, 2 * node + (codes[rows, np.maximum(split, 0)] > bin_[inner]), node)
    return node


_F = len(FEATURES)
_PIECE = "cutoff int, bins int, tile long, codes binary, labels binary"
_TILE = f"{_PIECE}, margins binary"
_TILE_NAMES = [c.split()[0] for c in _TILE.split(", ")]
_HISTOGRAM = "model int, node int, cells binary"


def _tile_arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, labels, margins = (np.frombuffer(batch.column(i)[k].as_buffer(), t) for i, t in ((3, np.uint8), (4, np.uint8), (5, np.float64)))
    return codes.reshape(_F, -1), labels, margins.reshape(-1, len(labels))


@dataclass(frozen=True)
class Plan:
    """What tasks must know of the models: model number = cutoff number x settings + setting number."""

    settings: tuple[Setting, ...]

    @property
    def depth(self) -> int:
        return max(s.max_depth for s in self.settings)

    def of(self, bins: int) -> list[int]:
        return [i for i, s in enumerate(self.settings) if s.bins == bins]

    def margins(self, cutoff: int, bins: int, codes: np.ndarray, margins: np.ndarray, pending: list[Trees]) -> np.ndarray:
        """Margins by setting with the pending trees' leaf values added."""
        out = margins.copy()
        for row, s in enumerate(self.of(bins)):
            model = cutoff * len(self.settings) + s
            for trees in pending:
                out[row] += trees.value[model][reached(codes.T, trees.feature[model], trees.bin[model], self.depth)]
        return out


def _tiles(rows: DataFrame, plan: Plan, cutoffs: list, edges: dict, parts: int) -> DataFrame:
    """Tiles of (target_date, target, keys), codes by feature; ``edges``: (bins, cutoff number) -> edges by feature."""
    days = np.array([(c - cutoffs[0]).days for c in cutoffs])
    every, limit = sorted({s.bins for s in plan.settings}), min(TILE_ROWS, PIECE_ROWS)

    def tiled(parts, name):
        at, label, keys = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(at, kind="stable")
        at, label, keys = at[order], label[order], keys[order]
        for c, day in enumerate(days):
            n = int(np.searchsorted(at, day))  # the embargo: labels known before the cutoff only
            for bins in every if n else ():
                codes = np.stack([np.searchsorted(edges[bins, c][f], keys[:n, f]) for f in range(_F)]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], pa.int32()), pa.array([bins], pa.int32()), pa.array([name], pa.int64()), pa.array([codes.tobytes()], pa.binary()),
                     pa.array([label[:n].astype(np.uint8).tobytes()], pa.binary())], _TILE_NAMES[:5])

    def run(batches):
        from pyspark import TaskContext

        held, n, name = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().reshape(-1, _F)))
                n += batch.num_rows
            if n >= limit:
                yield from tiled(held, name)
                held, n, name = [], 0, name + 1
        if n:
            yield from tiled(held, name)

    day = F.datediff("target_date", F.lit(cutoffs[0])).cast("long")
    return rows.repartition(parts).select(day.alias("at"), F.col("target").cast("long").alias("label"), "keys").mapInArrow(run, _PIECE)


def _with_margins(tiles: DataFrame, plan: Plan, prior: np.ndarray) -> DataFrame:
    """Tiles with the margins that every setting begins with."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                cutoff, bins, rows = one.column(0)[0].as_py(), one.column(1)[0].as_py(), len(one.column(4)[0].as_buffer())
                margins = np.full((len(plan.of(bins)), rows), prior[cutoff])
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([margins.tobytes()], pa.binary())], _TILE_NAMES)

    return tiles.mapInArrow(run, _TILE)


def _cells(codes: np.ndarray, labels: np.ndarray, margin: np.ndarray, feature: np.ndarray, bin_: np.ndarray, level: int, depth: int, wide: int) -> np.ndarray | None:
    """Gradient, hessian and count of each open node of a level: (3, nodes, features x bins), or None where the level before split nothing."""
    first = 1 << level
    if level and (feature[first >> 1: first] < 0).all():
        return None
    node = reached(codes.T, feature, bin_, depth) - first if level else np.zeros(len(labels), np.int64)
    open_ = np.flatnonzero(node >= 0)
    p = 1.0 / (1.0 + np.exp(-margin[open_]))
    g, h, place = p - labels[open_], p * (1.0 - p), node[open_] * wide
    out = np.empty((3, first, _F, wide))
    for f in range(_F):
        out[:, :, f] = _sums(place + codes[f, open_], g, h, first * wide).reshape(3, first, wide)
    return out.reshape(3, first, -1)


def _sums(at: np.ndarray, g: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(at, g, size), np.bincount(at, h, size), np.bincount(at, minlength=size)])


def _margins_of(batches, plan: Plan, pending: list[Trees]):
    """(model, its setting's number, codes, labels, margins) of every tile and setting."""
    for batch in batches:
        for k in range(batch.num_rows):
            cutoff, bins = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            codes, labels, margins = _tile_arrays(batch, k)
            margins = plan.margins(cutoff, bins, codes, margins, pending)
            for row, s in enumerate(plan.of(bins)):
                yield cutoff * len(plan.settings) + s, s, codes, labels, margins[row]


def histograms(tiles: DataFrame, plan: Plan, pending: list[Trees], current: Trees, level: int) -> DataFrame:
    """Partial sums of every open node, one row per task, model and node."""
    depth, wide = plan.depth, max(s.bins for s in plan.settings) + 1

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for model, _, codes, labels, margin in _margins_of(batches, plan, pending):
            cells = _cells(codes, labels, margin, current.feature[model], current.bin[model], level, depth, wide)
            if cells is not None:
                sums[model] = sums[model] + cells if model in sums else cells
        rows = [(m, (1 << level) + j, np.ascontiguousarray(c[:, j]).tobytes()) for m, c in sums.items() for j in range(1 << level) if c[2, j].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["model", "node", "cells"])

    return tiles.mapInArrow(run, _HISTOGRAM)


def best_split(cells: np.ndarray, l2: float) -> dict:
    """The best split of one node's summed cells (3 x features x bins): totals, and the split where one is allowed."""
    g, h, n = np.cumsum(cells, axis=2)
    tg, th, tn = g[0, -1], h[0, -1], n[0, -1]
    part = lambda a, b: a * a / np.maximum(b + l2, 1e-12)
    gain = np.round(part(g, h) + part(tg - g, th - h) - part(tg, th), GAIN_PLACES)
    allowed = (np.minimum(n, tn - n) >= MIN_LEAF_ROWS) & (np.minimum(h, th - h) >= MIN_LEAF_HESSIAN)
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    found = bool(gain[f, b] > MIN_GAIN)
    return {"tg": float(tg), "th": float(th), "feature": int(f) if found else -1, "bin": int(b), "gain": float(gain[f, b]) if found else None, "lg": float(g[f, b]), "lh": float(h[f, b])}


_SPLIT = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("tg", pa.float64()), ("th", pa.float64()), ("feature", pa.int32()),
                    ("bin", pa.int32()), ("gain", pa.float64()), ("lg", pa.float64()), ("lh", pa.float64())])
_SPLIT_DDL = "model int, node int, tg double, th double, feature int, bin int, gain double, lg double, lh double"


def best_splits(partial: DataFrame, plan: Plan) -> pa.Table:
    """The best split of each open node, over all models: tree parameters only."""

    def search(table: pa.Table) -> pa.Table:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for model, node, cells in zip(*(table.column(c) for c in ("model", "node", "cells"))):
            key, cells = (model.as_py(), node.as_py()), np.frombuffer(cells.as_buffer(), np.float64)
            sums[key] = sums[key] + cells if key in sums else cells
        rows = [{"model": m, "node": k} | best_split(c.reshape(3, _F, -1), plan.settings[m % len(plan.settings)].l2) for (m, k), c in sums.items()]
        return pa.Table.from_pylist(rows, schema=_SPLIT)

    return partial.groupBy("model").applyInArrow(search, _SPLIT_DDL).toArrow()


class Blocks:
    """Rows of one model, block by block: odds reached so far, codes by feature, labels, and the block's rows in the order of each feature's codes.

    ``TILE_ROWS`` rows (24 bytes each) are held.  What comes after them lies in a file of the task, from which one block at a time is read.
    """

    def __init__(self, prior: float):
        self.odds, self.parts, self.waiting, self.rows, self.file = float(np.exp(prior)), [], [], 0, None
        self.counts = np.zeros((_F, 256))

    def add(self, codes: np.ndarray, labels: np.ndarray) -> None:
        """Rows, cut into blocks as soon as there are enough for one."""
        self.waiting.append((codes, labels))
        if sum(len(y) for _, y in self.waiting) >= BLOCK:
            self.settle(BLOCK)

    def settle(self, least: int = 1) -> None:
        """Cut the rows that wait into blocks, while there are ``least``."""
        if not self.waiting:
            return
        codes, labels = (np.concatenate(x, axis=-1) for x in zip(*self.waiting))
        while len(labels) >= least:
            self._block(codes[:, :BLOCK].copy(), labels[:BLOCK].copy())
            codes, labels = codes[:, BLOCK:], labels[BLOCK:]
        self.waiting = [(codes, labels)] if len(labels) else []

    def _block(self, codes: np.ndarray, labels: np.ndarray) -> None:
        counts = np.stack([np.bincount(c, minlength=256) for c in codes])
        starts = [(np.flatnonzero(n), (np.cumsum(n) - n)[n > 0]) for n in counts]  # bins that occur, and where their rows begin
        part = np.full(len(labels), self.odds), codes, labels, np.argsort(codes, axis=1, kind="stable").astype(np.uint16)
        self.counts += counts
        self.rows += len(labels)
        if self.rows > TILE_ROWS:
            self.file = self.file or tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            at = self.file.seek(0, os.SEEK_END)
            self.file.writelines(x.tobytes() for x in part)
            part = at
        self.parts.append((len(labels), starts, part))

    def _read(self, at: int, n: int, width: int) -> tuple[bytearray, np.ndarray, np.ndarray, np.ndarray]:
        buffer = bytearray(n * width)
        self.file.seek(at)
        if self.file.readinto(buffer) < len(buffer):
            raise OSError("A block's file is cut short")
        small = np.frombuffer(buffer, np.uint8, (_F + 1) * n, 8 * n).reshape(-1, n)
        return buffer, np.frombuffer(buffer, np.float64, n), small[:_F], small[_F]

    def ordered(self):
        """Blocks as (odds, codes, labels, order, starts); odds that are changed in place are kept."""
        for n, starts, part in self.parts:
            if not isinstance(part, int):
                yield *part, starts
                continue
            buffer, odds, codes, labels = self._read(part, n, 9 + 3 * _F)
            yield odds, codes, labels, np.frombuffer(buffer, np.uint16, offset=(9 + _F) * n).reshape(_F, n), starts
            self.file.seek(part)
            self.file.write(odds.tobytes())

    def plain(self):
        """Blocks as (odds, codes, labels)."""
        for n, _, part in self.parts:
            yield self._read(part, n, 9 + _F)[1:] if isinstance(part, int) else part[:3]


def _slopes(odds: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Gradient and hessian as one complex number, so that both are summed at once."""
    out, p = np.empty(len(odds), np.complex128), odds + 1.0
    np.divide(odds, p, out=p)
    np.subtract(p, labels, out=out.real)
    np.multiply(p, 1.0 - p, out=out.imag)
    return out


def _routed(codes: np.ndarray, splits: list[tuple[int, int, int]], kind: np.dtype) -> np.ndarray:
    """Node that each row reaches by ``splits`` (node, feature, bin), parents first."""
    node = np.ones(codes.shape[1], kind)
    for k, f, b in splits:
        here = node == k
        right = (codes[f] > b) & here
        node += here.view(np.uint8) * kind.type(k)
        node += right.view(np.uint8)
    return node


def grown(codes: np.ndarray, labels: np.ndarray, prior: float, setting: Setting, depth: int):
    """The trees of one model round by round, as the four arrays of ``Trees``."""
    blocks = Blocks(prior)
    blocks.add(codes, labels)
    return rounds(blocks, setting, depth)


def rounds(blocks: Blocks, setting: Setting, depth: int):
    """The trees of the model of ``blocks``, round by round.

    A level is one pass over the blocks.  Of a split node only the smaller child is counted, the other is what is left.
    """
    blocks.settle()
    wide, kind = 256, np.min_scalar_type(2 << depth)
    leaf = lambda a, b: -setting.learning_rate * a / max(b + setting.l2, 1e-12)
    splits, value = [], np.zeros(2 << depth)
    for _ in range(setting.iterations):
        total, factor = np.zeros((_F, wide), np.complex128), np.exp(value)
        for odds, codes, labels, order, starts in blocks.ordered():
            odds *= factor.take(_routed(codes, splits, kind))
            slopes = _slopes(odds, labels)
            for f, (bins, first) in enumerate(starts):
                total[f, bins] += np.add.reduceat(slopes.take(order[f].astype(np.intp)), first)
        cells = np.stack([total.real, total.imag, blocks.counts])
        feature, bin_, gain, value = np.full(1 << depth, -1, np.int8), np.zeros(1 << depth, np.int16), np.full(1 << depth, np.nan), np.zeros(2 << depth)
        splits, open_ = [], {1: cells}
        for level in range(setting.max_depth):
            split, small = [], []
            for k, own in open_.items():
                found = best_split(own, setting.l2)
                if k == 1:
                    value[1] = leaf(found["tg"], found["th"])
                if found["feature"] >= 0:
                    feature[k], bin_[k], gain[k] = found["feature"], found["bin"], found["gain"]
                    value[2 * k], value[2 * k + 1] = leaf(found["lg"], found["lh"]), leaf(found["tg"] - found["lg"], found["th"] - found["lh"])
                    left = own[2, found["feature"], : found["bin"] + 1].sum()
                    split.append(k)
                    small.append(2 * k + int(2 * left > own[2, 0].sum()))
            splits += [(k, int(feature[k]), int(bin_[k])) for k in split]
            if level + 1 == setting.max_depth or not split:
                break
            sums, counts = np.zeros((len(small), _F, wide), np.complex128), np.zeros((len(small), _F, wide))
            for odds, codes, labels in blocks.plain():
                node = _routed(codes, splits, kind)
                for j, s in enumerate(small):
                    rows = np.flatnonzero(node == s)
                    slopes = _slopes(odds.take(rows), labels.take(rows))
                    for f in range(_F):
                        at = codes[f].take(rows).astype(np.intp)
                        np.add.at(sums[j, f], at, slopes)
                        counts[j, f] += np.bincount(at, minlength=wide)
            fresh = {}
            for k, s, both, n in zip(split, small, sums, counts):
                one = np.stack([both.real, both.imag, n])
                rest = open_[k] - one
                rest[:2, rest[2] == 0] = 0.0  # bins without rows: exactly nothing, so their ties stay ties
                fresh[s], fresh[s ^ 1] = one, rest
            open_ = dict(sorted(fresh.items()))
        yield feature, bin_, gain, value


def whole_models(tiles: DataFrame, plan: Plan, days: list, prior: np.ndarray, edges: dict) -> DataFrame:
    """The table of trees, every model grown by one task from its cutoff's tiles, which it reads one after the other."""
    n = len(plan.settings)
    numbers = F.array(*[F.struct(F.lit(s.bins).alias("bins"), F.lit(i).alias("number")) for i, s in enumerate(plan.settings)])
    own = F.explode(F.filter(numbers, lambda x: x["bins"] == F.col("bins")))

    def grow(model: int, blocks: Blocks) -> pa.RecordBatch:
        cutoff, number = divmod(model, n)
        setting, rows = plan.settings[number], _Rows()
        rows.add(setting, days[cutoff], prior[cutoff], 0)
        for step, tree in enumerate(rounds(blocks, setting, plan.depth)):
            rows.add(setting, days[cutoff], prior[cutoff], step + 1, tree, edges[setting.bins, cutoff])
        return rows.table().combine_chunks().to_batches()[0]

    def run(batches):
        model, blocks = None, None
        for batch in batches:
            models, codes, labels = (batch.column(c) for c in ("model", "codes", "labels"))
            for k in range(batch.num_rows):
                if models[k].as_py() != model:
                    if blocks:
                        yield grow(model, blocks)
                    model = models[k].as_py()
                    blocks = Blocks(prior[model // n])
                blocks.add(np.frombuffer(codes[k].as_buffer(), np.uint8).reshape(_F, -1), np.frombuffer(labels[k].as_buffer(), np.uint8))
        if blocks:
            yield grow(model, blocks)

    # A partition is a model, and those with the most rows begin first.
    models = tiles.withColumn("_own", own).select((F.col("cutoff") * n + F.col("_own.number")).alias("model"), "tile", "codes", "labels")
    turn = (len(days) - 1 - F.floor(F.col("model") / n)) * n + F.col("model") % n
    return models.repartitionById(len(days) * n, turn.cast("int")).sortWithinPartitions("model", "tile").mapInArrow(run, _TREE_DDL)


def _priors(rows: DataFrame, cutoffs: list) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Training rows and positives of each cutoff, and its prior log-odds, from counts per target date (calendar-bounded)."""
    dates = rows.groupBy("target_date").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("k")).collect()
    counts = [tuple(sum(r[x] for r in dates if r["target_date"] < c) for x in ("n", "k")) for c in cutoffs]
    for c, (n, k) in zip(cutoffs, counts):
        if not 0 < k < n:
            raise ValueError(f"Training rows of one class, or none, before {c}")
    return counts, np.array([np.log(k / n) - np.log(1 - k / n) for n, k in counts])


def _grow(trees: Trees, found: pa.Table, settings: tuple[Setting, ...], step: int) -> int:
    """Enter the found splits, parents first; how many nodes were split."""
    grown = 0
    for r in found.sort_by([("model", "ascending"), ("node", "ascending")]).to_pylist():
        model, node, setting = r["model"], r["node"], settings[r["model"] % len(settings)]
        if step >= setting.iterations:
            continue
        leaf = lambda g, h: -setting.learning_rate * g / max(h + setting.l2, 1e-12)
        if node == 1:
            trees.value[model, node] = leaf(r["tg"], r["th"])
        if node < 1 << setting.max_depth and r["feature"] >= 0:
            trees.feature[model, node], trees.bin[model, node], trees.gain[model, node] = r["feature"], r["bin"], r["gain"]
            trees.value[model, 2 * node] = leaf(r["lg"], r["lh"])
            trees.value[model, 2 * node + 1] = leaf(r["tg"] - r["lg"], r["th"] - r["lh"])
            grown += 1
    return grown


def fit(dataset: DataFrame, cutoffs: DataFrame, settings: tuple[Setting, ...] = (Setting(),), store_every: int = STORE_EVERY) -> DataFrame:
    """Table of trees: setting, cutoff, prior, round, and feature, threshold (a sketch key), gain and value by node in heap layout.

    Rows of round 0 hold the prior alone.
    """
    spark, plan = dataset.sparkSession, Plan(tuple(settings))
    if max(s.bins for s in settings) > 256:
        raise ValueError("Bin codes take one byte")
    labelled = stored(keyed(dataset).where(F.col("target_date").isNotNull() & F.col("target").isNotNull()).select("target_date", "target", "keys"), "labelled")
    days = [r[0] for r in cutoffs.select("prediction_date").distinct().orderBy("prediction_date").collect()]  # calendar-bounded
    if not days:
        return _tree_table(spark, plan, [], np.zeros(0), {}, [])
    edges = {}
    for bins in sorted({s.bins for s in settings}):
        for r in bin_edges(labelled, cutoffs, bins).collect():  # cutoffs x features x bins keys
            edges.setdefault((bins, days.index(r["cutoff"])), [np.zeros(0, np.int64)] * _F)[r["feature"]] = np.array(r["edges"], np.int64)
    counts, prior = _priors(labelled, days)
    total = labelled.count()
    tiles = _tiles(labelled, plan, days, edges, max(1, -(-total // min(TILE_ROWS, PIECE_ROWS))))
    if total <= TILE_ROWS or len(days) * len(settings) >= spark.sparkContext.defaultParallelism:
        return stored(whole_models(tiles, plan, days, prior, edges), "trees")
    # Tasks enough for the work of a level.
    work = sum(n for n, _ in counts) * len(settings)
    tasks = max(1, min(even_width(dataset), -(-work // TASK_ROWS)))
    tiles = stored(_with_margins(tiles, plan, prior).repartition(tasks, "cutoff", "tile"), "tiles")
    models, depth = len(days) * len(settings), plan.depth
    done: list[Trees] = []
    since = 0
    for step in range(max(s.iterations for s in settings)):
        current, pending = Trees(models, depth), done[since:]
        for level in range(depth):
            if not _grow(current, best_splits(histograms(tiles, plan, pending, current, level), plan), settings, step):
                break
        done.append(current)
        if (step + 1) % store_every == 0:
            fresh = stored(_advanced(tiles, plan, done[since:]), "tiles")
            dropped(tiles)
            tiles, since = fresh, step + 1
    dropped(tiles)
    return _tree_table(spark, plan, days, prior, edges, done)


def _advanced(tiles: DataFrame, plan: Plan, pending: list[Trees]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                codes, _, margins = _tile_arrays(batch, k)
                margins = plan.margins(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), codes, margins, pending)
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(i) for i in range(5)), pa.array([margins.tobytes()], pa.binary())], _TILE_NAMES)

    return tiles.mapInArrow(run, _TILE)


_TREES = pa.schema([
    ("setting", pa.string()), ("cutoff", pa.date32()), ("prior", pa.float64()), ("round", pa.int32()), ("feature", pa.list_(pa.int32())),
    ("threshold", pa.list_(pa.int32())), ("gain", pa.list_(pa.float64())), ("value", pa.list_(pa.float64()))])
_TREE_DDL = "setting string, cutoff date, prior double, round int, feature array<int>, threshold array<int>, gain array<double>, value array<double>"


class _Rows:
    """Rows of the table of trees."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in _TREES]

    def add(self, setting: Setting, cutoff, prior: float, step: int, tree: tuple = (), edges: list = ()) -> None:
        """One tree (feature, bin, gain, value by node), or the prior alone."""
        lists: list[list] = [[], [], [], []]
        if tree:
            feature, bin_, gain, value = tree
            lists = [feature.tolist(), [int(edges[f][b]) if f >= 0 else 0 for f, b in zip(feature, bin_)], [None if np.isnan(x) else float(x) for x in gain], value.tolist()]
        for column, x in zip(self.columns, (setting.name, cutoff, float(prior), step, *lists)):
            column.append(x)

    def table(self) -> pa.Table:
        return pa.table([pa.array(c, f.type) for c, f in zip(self.columns, _TREES)], schema=_TREES)


def _tree_table(spark, plan: Plan, days: list, prior: np.ndarray, edges: dict, done: list[Trees]) -> DataFrame:
    rows = _Rows()
    for m in range(len(days) * len(plan.settings)):
        c, setting = m // len(plan.settings), plan.settings[m % len(plan.settings)]
        rows.add(setting, days[c], prior[c], 0)
        for step, t in enumerate(done[: setting.iterations]):
            rows.add(setting, days[c], prior[c], step + 1, (t.feature[m], t.bin[m], t.gain[m], t.value[m]), edges[setting.bins, c])
    return stored(spark.createDataFrame(rows.table()), "trees")


def predict(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """``rows`` (with a date and the features) per setting, with ``cutoff`` (of the latest model at or before the date) and ``ml_score`` = P(outperform).

    Rows before the first model are left out.  The trees are sent to the tasks: models x rounds x nodes numbers.
    """
    spark, forest = rows.sparkSession, {}
    for r in trees.orderBy("setting", "cutoff", "round").toArrow().to_pylist():
        model = forest.setdefault(r["setting"], {}).setdefault(r["cutoff"], {"prior": r["prior"], "trees": []})
        if r["round"]:
            splits = [(k, f, t) for k, (f, t) in enumerate(zip(r["feature"], r["threshold"])) if f >= 0]
            model["trees"].append((splits, np.array(r["value"])))
    asof = {s: (np.array(sorted(m), "datetime64[D]"), [m[c] for c in sorted(m)]) for s, m in forest.items()}
    sent = spark.sparkContext.broadcast(asof)
    names = list(rows.columns)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dates = batch.column(names.index("date")).to_numpy(zero_copy_only=False).astype("datetime64[D]")
            keys = np.ascontiguousarray(batch.column(len(names)).flatten().to_numpy().reshape(-1, _F).T)
            for setting, (cuts, models) in sent.value.items():
                which = np.searchsorted(cuts, dates, side="right") - 1
                margin = np.zeros(batch.num_rows)
                for w in np.unique(which[which >= 0]):
                    at = np.flatnonzero(which == w)
                    own, total = keys.take(at, axis=1), np.full(len(at), models[w]["prior"])
                    for splits, value in models[w]["trees"]:
                        total += value.take(_routed(own, splits, np.min_scalar_type(len(value))))
                    margin[at] = total
                known = np.flatnonzero(which >= 0)
                part = batch.take(pa.array(known))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([setting] * len(known), pa.string()), pa.array(cuts[which[known]], pa.date32()), pa.array(1.0 / (1.0 + np.exp(-margin[known])), pa.float64())],
                    [*names, "setting", "cutoff", "ml_score"])

    ready = keyed(rows).sortWithinPartitions("date")  # a batch's rows share models
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ready.select(*names, "keys").mapInArrow(run, f"{fields}, setting string, cutoff date, ml_score double")


def walk_forward_scores(dataset: DataFrame, cutoffs: DataFrame, settings: tuple[Setting, ...] = (Setting(),), trees: DataFrame | None = None) -> DataFrame:
    """Scores of each eligible date by a model that saw only earlier labels; ``trees``: models fitted before."""
    trees = fit(dataset, cutoffs, settings) if trees is None else trees
    now = dataset.join(F.broadcast(cutoffs.select(F.col("prediction_date").alias("date"))), "date", "left_semi")
    return predict(now, trees).select(
        F.col("setting").alias("candidate"), "date", "target_date", "ticker", "ml_score", "future_return", "benchmark_return", "target"
    )


def select_candidate(returns: DataFrame, order: tuple[str, ...], months: int = 24) -> DataFrame:
    """Best finite validation Sharpe; ties go to the first declared.

    Fails unless every declared candidate has exactly ``months`` months.
    """
    from stratapanel.operators.metrics import performance

    rank = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])[F.col("candidate")]
    m = performance(returns.where(F.col("candidate").isin(*order)), ("candidate",)).withColumn("_o", rank)
    picked = m.groupBy().agg(
        F.count(F.lit(1)).alias("_n"), F.min("observations").alias("_lo"), F.max("observations").alias("_hi"),
        F.max_by("candidate", F.when(F.col("sharpe").isNotNull(), F.struct("sharpe", -F.col("_o")))).alias("candidate"),
        F.max("sharpe").alias("sharpe"),
    )
    bad = (F.col("_n") != len(order)) | (F.col("_lo") != months) | (F.col("_hi") != months) | F.col("candidate").isNull()
    return picked.select(
        F.when(bad, F.raise_error(F.lit("Validation needs complete months for every candidate"))).otherwise(F.col("candidate")).alias("candidate"),
        "sharpe",
    )


def segment_violations(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(candidate, date) where candidate and benchmark months differ."""
    names = returns.select("candidate").distinct()
    expected = names.withColumn("_d", benchmark.agg(F.sort_array(F.collect_set("date"))).scalar()).select(
        "candidate", F.explode("_d").alias("date"), F.lit(True).alias("_e")
    )
    have = returns.select("candidate", "date", F.lit(True).alias("_h"))
    return expected.join(have, ["candidate", "date"], "full_outer").where(
        F.col("_e").isNull() | F.col("_h").isNull()
    ).select("candidate", "date")


def compare_segment(ledgers: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Metrics, mean turnover and total cost per candidate on equal dates."""
    from stratapanel.operators.metrics import evaluate

    rows = ledgers.withColumn("ret", F.col("net_return")).join(F.broadcast(benchmark), "date")
    return evaluate(rows, ("candidate",), extra={
        "mean_monthly_turnover": F.avg("turnover"), "total_transaction_cost": F.sum("transaction_cost"),
    })
