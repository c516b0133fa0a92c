from dataclasses import replace

import numpy as np
import pytest
from conftest import month_ends
from pyspark.sql import functions as F

from stratapanel.operators import models as ML, timeseries as T, universe as U


@pytest.fixture(scope="module")
def dataset(spark, panel):
    rng = np.random.default_rng(33)
    wide = {f"T{i}": list(100 * np.cumprod(1 + rng.normal(0.01, 0.05, 20))) for i in range(12)}
    p = panel(wide)
    return T.labelled_dataset(p, p.groupBy("date").agg(F.avg("close").alias("close"))).cache()


SETTING = replace(ML.Setting(), iterations=2, bins=8)


def cut(dataset, start=None):
    return U.cutoff_eligibility(dataset, 8, start).where("eligible").select("prediction_date")


def test_embargo(dataset):
    rows = ML.training_sets(dataset, cut(dataset))
    assert rows.where(F.col("target_date") >= F.col("cutoff")).count() == 0
    counts = {r["cutoff"]: r["count"] for r in rows.groupBy("cutoff").count().collect()}
    expected = {r["prediction_date"]: r["training_rows"] for r in U.training_counts(dataset).collect()}
    assert counts == {c: expected[c] for c in counts}


def test_future_labels_do_not_move_scores(dataset):
    last = cut(dataset, str(month_ends(20)[17]))
    first = last.agg(F.min("prediction_date").alias("prediction_date"))
    day = first.collect()[0][0]
    poisoned = dataset.withColumn("target", F.when(F.col("target_date") >= F.lit(day), 1 - F.col("target")).otherwise(F.col("target")))
    a, b = (
        {r["ticker"]: r["ml_score"] for r in ML.walk_forward_scores(x, first, (SETTING,)).collect()} for x in (dataset, poisoned)
    )
    assert a and a == pytest.approx(b)


def plain_keys(values):
    size = np.abs(values)
    with np.errstate(divide="ignore", invalid="ignore"):
        cell = np.ceil(np.minimum(np.log(size), 40.0) * 1000) + 25_000
    return np.where(size < 1e-10, 0, np.sign(values) * np.where(size < 1e-10, 0, cell)).astype(int)


def plain_edges(keys, bins):
    """Keys at which the count passes a multiple of n / bins, by sorting."""
    n, out = len(keys), []
    for k, c in zip(*np.unique(keys, return_counts=True)):
        upto = int((keys <= k).sum())
        if min(upto * bins // n, bins - 1) > min((upto - int(c)) * bins // n, bins - 1):
            out.append(int(k))
    return out


def plain_boosting(codes, y, setting):
    """Margins after each round of exhaustive depth-first trees on bin codes."""
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(setting.iterations):
        p = 1 / (1 + np.exp(-margin))
        g, h, step = p - y, p * (1 - p), np.zeros(len(y))

        def grow(rows, level):
            part = lambda m: g[m].sum() ** 2 / max(h[m].sum() + setting.l2, 1e-12)
            best = None
            for f in range(5) if level < setting.max_depth else ():
                for b in range(setting.bins):
                    left, right = rows[codes[rows, f] <= b], rows[codes[rows, f] > b]
                    if min(len(left), len(right)) < ML.MIN_LEAF_ROWS:
                        continue
                    gain = round(part(left) + part(right) - part(rows), ML.GAIN_PLACES)
                    if gain > 1e-12 and (best is None or gain > best[0]):
                        best = gain, left, right
            if best:
                grow(best[1], level + 1), grow(best[2], level + 1)
            else:
                step[rows] = -setting.learning_rate * g[rows].sum() / max(h[rows].sum() + setting.l2, 1e-12)

        grow(np.arange(len(y)), 0)
        margin = margin + step
    return margin


def arrays(dataset):
    rows = dataset.dropna(subset=list(T.FEATURES)).collect()
    return rows, np.array([[r[f] for f in T.FEATURES] for r in rows])


def test_sketch_edges_match_sorting(dataset):
    rows, values = arrays(dataset)
    days = [r[0] for r in cut(dataset).orderBy("prediction_date").collect()]
    got = {(r["cutoff"], r["feature"]): list(r["edges"]) for r in ML.bin_edges(ML.keyed(dataset), cut(dataset), 16).collect()}
    for day in days:
        own = np.array([i for i, r in enumerate(rows) if r["target"] is not None and r["target_date"] is not None and r["target_date"] < day])
        for f in range(5):
            assert got[day, f] == plain_edges(plain_keys(values[own, f]), 16)


@pytest.mark.parametrize("tile_rows", [50, 50_000])
def test_forest_matches_plain_boosting_with_mixed_settings(dataset, monkeypatch, tile_rows):
    """Several tiles a cutoff and one. Two settings that differ in everything, and every third cutoff; margins stored each round."""
    monkeypatch.setattr(ML, "TILE_ROWS", tile_rows)
    settings = (replace(SETTING, name="a", iterations=4, bins=12, learning_rate=0.3), ML.Setting("b", 2, 2.0, 2, 0.1, 6))
    days = [r[0] for r in cut(dataset).orderBy("prediction_date").collect()][::6]
    some = cut(dataset).where(F.col("prediction_date").isin(days))
    trees = ML.fit(dataset, some, settings, store_every=3)
    assert {(r["setting"], r["n"]) for r in trees.groupBy("setting", "cutoff").agg(F.max("round").alias("n")).collect()} == {("a", 4), ("b", 2)}
    got = {(r["candidate"], r["date"], r["ticker"]): r["ml_score"] for r in ML.walk_forward_scores(dataset, some, settings, trees).collect()}
    rows, values = arrays(dataset)
    keys = np.stack([plain_keys(values[:, f]) for f in range(5)], 1)
    for day in days:
        own = [i for i, r in enumerate(rows) if r["target"] is not None and r["target_date"] is not None and r["target_date"] < day]
        y = np.array([float(rows[i]["target"]) for i in own])
        for s in settings:
            edges = [plain_edges(keys[own, f], s.bins) for f in range(5)]
            codes = np.stack([np.searchsorted(edges[f], keys[own, f]) for f in range(5)], 1)
            margin = plain_boosting(codes, y, s)
            # The forest scores its own training rows as it does new ones.
            sample = dataset.where(F.col("date") == F.lit(rows[own[-1]]["date"]))
            model = trees.where((F.col("setting") == s.name) & (F.col("cutoff") == F.lit(day))).withColumn("cutoff", F.lit("1900-01-01").cast("date"))
            scores = {r["ticker"]: r["ml_score"] for r in ML.predict(sample, model).collect()}
            for i, m in zip(own, margin):
                if rows[i]["date"] == rows[own[-1]]["date"]:
                    assert scores[rows[i]["ticker"]] == pytest.approx(1 / (1 + np.exp(-m)), abs=1e-9)
            assert any(k[:2] == (s.name, day) for k in got)


def test_latest_model_scores_a_date(dataset):
    days = [r[0] for r in cut(dataset).orderBy("prediction_date").collect()]
    trees = ML.fit(dataset, cut(dataset).where(F.col("prediction_date").isin(days[0], days[2])), (SETTING,))
    used = {r["date"]: r["cutoff"] for r in ML.predict(dataset, trees).select("date", "cutoff").distinct().collect()}
    assert min(used) == days[0] and used[days[1]] == days[0] and used[days[2]] == used[days[3]] == days[2]


def test_more_l2_shrinks_scores(dataset):
    first = cut(dataset).agg(F.max("prediction_date").alias("prediction_date"))
    pair = (replace(SETTING, name="free", l2=0.0), replace(SETTING, name="shrunk", l2=1000.0))
    spread = {r["candidate"]: r["s"] for r in ML.walk_forward_scores(dataset, first, pair).groupBy("candidate").agg(F.stddev("ml_score").alias("s")).collect()}
    assert spread["shrunk"] < spread["free"]


def test_sketch_keys_keep_the_order(spark):
    values = [-1e9, -2.5, -1.0, -1e-4, -1e-12, 0.0, 1e-11, 1e-9, 0.5, 1.0, 3.0, 1e300, float("inf")]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", ML.sketch_key(F.col("v")).alias("k")).orderBy("v").collect()
    keys = [r["k"] for r in rows]
    assert keys == sorted(keys) and keys[4:7] == [0, 0, 0]


def test_select_candidate(spark):
    d = month_ends(24, 2021)
    rng = np.random.default_rng(0)
    base = rng.normal(0.01, 0.03, 24)
    rows = [(c, x, float(v + e)) for c, e in (("a", 0.0), ("b", 0.01), ("c", 0.01)) for x, v in zip(d, base)]
    df = spark.createDataFrame(rows, "candidate string, date date, ret double")
    assert ML.select_candidate(df, ("a", "c", "b")).collect()[0]["candidate"] == "c"
    with pytest.raises(Exception, match="complete months"):
        ML.select_candidate(df.where(F.col("date") != d[3]), ("a", "b", "c")).collect()


def test_segment_dates_must_match(spark):
    d = month_ends(3)
    led = spark.createDataFrame([("a", x) for x in d[:2]], "candidate string, date date")
    bench = spark.createDataFrame([(x,) for x in d], "date date")
    assert [tuple(r) for r in ML.segment_violations(led, bench).collect()] == [("a", d[2])]


def test_jobs_do_not_grow_with_the_rounds(dataset):
    """Models that a task holds are grown whole, all rounds in one job."""
    context = dataset.sparkSession.sparkContext
    first = cut(dataset).agg(F.min("prediction_date").alias("prediction_date")).cache()
    jobs = {}
    for rounds in (1, 2, 12):  # the first fills the cache
        context.setJobGroup(f"rounds{rounds}", "fit")
        ML.fit(dataset, first, (replace(SETTING, iterations=rounds),))
        jobs[rounds] = len(context.statusTracker().getJobIdsForGroup(f"rounds{rounds}"))
    context.setJobGroup("", "")
    assert jobs[2] == jobs[12] > 0


def test_smaller_child_counts_match_plain_boosting(monkeypatch):
    """Rows in several blocks, the larger child by subtraction, a feature without a split."""
    monkeypatch.setattr(ML, "BLOCK", 70)
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 9, (400, 5)).astype(np.uint8)
    codes[:, 4] = 3
    y = (rng.random(400) < 0.2 + 0.6 * (codes[:, 0] > 5)).astype(np.uint8)
    for setting in (ML.Setting("a", 3, 0.0, 6, 0.3, 9), ML.Setting("b", 2, 5.0, 6, 0.1, 9)):
        prior = np.log(y.mean() / (1 - y.mean()))
        margin = np.full(len(y), prior)
        for feature, bin_, _, value in ML.grown(np.ascontiguousarray(codes.T), y, prior, setting, 3):
            margin += value[ML.reached(codes, feature, bin_, 3)]
        assert margin == pytest.approx(plain_boosting(codes, y.astype(float), setting), abs=1e-9)


def random_rows(n):
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 9, (5, n)).astype(np.uint8)
    return codes, (rng.random(n) < 0.2 + 0.6 * (codes[0] > 5)).astype(np.uint8)


def test_a_partition_holds_one_model_and_the_largest_begin(spark):
    """Models that share a partition run one after the other while cores are idle."""
    days, plan = month_ends(6), ML.Plan((replace(SETTING, name="a"), replace(SETTING, name="b")))
    tiles = []
    for c in range(6):
        codes, y = random_rows(100 + 20 * c)
        tiles.append((c, 8, 0, bytes(np.minimum(codes, 7).tobytes()), bytes(y.tobytes())))
    tiles = spark.createDataFrame(tiles, "cutoff int, bins int, tile long, codes binary, labels binary")
    edges = {(8, c): [np.arange(7)] * 5 for c in range(6)}
    rows = ML.whole_models(tiles, plan, days, np.zeros(6), edges).withColumn("part", F.spark_partition_id())
    parts = {r["part"]: (r["n"], r["cutoff"]) for r in rows.groupBy("part").agg(F.count_distinct("setting", "cutoff").alias("n"), F.max("cutoff").alias("cutoff")).collect()}
    assert len(parts) == 12 and {n for n, _ in parts.values()} == {1}
    assert [parts[k][1] for k in sorted(parts)] == [d for d in reversed(days) for _ in "ab"]


def test_rows_beyond_the_held_ones_lie_in_a_file(monkeypatch):
    """A task's memory does not grow with the rows of its model."""
    monkeypatch.setattr(ML, "BLOCK", 70)
    monkeypatch.setattr(ML, "TILE_ROWS", 150)
    codes, y = random_rows(400)
    setting, prior = ML.Setting("a", 3, 1.0, 6, 0.3, 9), np.log(y.mean() / (1 - y.mean()))
    blocks = ML.Blocks(prior)
    for part in np.array_split(np.arange(400), 9):
        blocks.add(codes[:, part], y[part])
    margin = np.full(400, prior)
    for feature, bin_, _, value in ML.rounds(blocks, setting, 3):
        margin += value[ML.reached(codes.T, feature, bin_, 3)]
    assert margin == pytest.approx(plain_boosting(codes.T, y.astype(float), setting), abs=1e-9)
    assert sum(n for n, _, part in blocks.parts) == 400 and blocks.file is not None
    assert sum(n for n, _, part in blocks.parts if not isinstance(part, int)) <= 150


def test_jobs_do_not_grow_with_the_rounds_of_many_large_models(dataset, monkeypatch):
    """More rows than a task holds, models for every core: still one job; fewer models go level by level and score alike."""
    context = dataset.sparkSession.sparkContext
    first = cut(dataset).agg(F.min("prediction_date").alias("prediction_date")).cache()
    many = lambda rounds: tuple(replace(SETTING, name=f"s{i}", iterations=rounds) for i in range(context.defaultParallelism))
    whole = ML.walk_forward_scores(dataset, first, many(2)[:1]).collect()
    monkeypatch.setattr(ML, "TILE_ROWS", 50)
    jobs = {}
    for rounds in (1, 2, 12):  # the first fills the cache
        context.setJobGroup(f"large{rounds}", "fit")
        trees = ML.fit(dataset, first, many(rounds))
        jobs[rounds] = len(context.statusTracker().getJobIdsForGroup(f"large{rounds}"))
    context.setJobGroup("", "")
    assert jobs[2] == jobs[12] > 0 and trees.count() == 13 * context.defaultParallelism
    for settings in (many(2)[:1], many(2)):
        got = {r["ticker"]: r["ml_score"] for r in ML.walk_forward_scores(dataset, first, settings).where("candidate = 's0'").collect()}
        assert got and got == pytest.approx({r["ticker"]: r["ml_score"] for r in whole}, abs=1e-9)
