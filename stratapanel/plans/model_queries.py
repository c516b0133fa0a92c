"""Bound queries: ranking model, candidate study, streaming merge (M3-M8, T1)."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from stratapanel.operators import ledger as L, models as ML, ranking as R, universe as U
from stratapanel.plans import bindings as B, research as RS
from stratapanel.plans.oracle_base import ABS_NAMES, ACT_NAMES, evaluated, frag, out, query
from stratapanel.plans.registry import register
from stratapanel.session import shared_folder
from stratapanel.sources import panels as P
from stratapanel.streaming.merge import read_merged, start_merge

# The published settings: 200 rounds, 255 bins.
BASE = ML.Setting()
GRID = ML.CANDIDATES
#: Signal months of the candidate study: 24 to choose by, the rest to judge.
STAGES = (("validation", "1998-09-01", "2000-08-31"), ("evaluation", "2000-09-01", "2001-12-31"))


def cutoffs(s, d, start=None, end=None) -> DataFrame:
    return U.cutoff_eligibility(B.supplier_dataset(s, d), 36, start, end).where("eligible").select("prediction_date")


def brand_cutoffs(s, d) -> DataFrame:
    return U.cutoff_eligibility(B.brand_dataset(s, d), 36).where("eligible").select("prediction_date")


def scored(s, d, at: DataFrame, settings: tuple[ML.Setting, ...]) -> DataFrame:
    """Scores of the cutoffs ``at``; a query fits only the cutoffs and settings it reports."""
    return ML.walk_forward_scores(B.supplier_dataset(s, d), at, settings)


register("m3_walk_forward_scores", lambda s, d: scored(s, d, cutoffs(s, d), (BASE,)).drop("candidate"))


def first_trees(s, d) -> DataFrame:
    """Splits of the first tree of every cutoff's baseline model; it does not depend on later rounds, which are not grown."""
    trees = ML.fit(B.supplier_dataset(s, d), cutoffs(s, d), (replace(BASE, iterations=1),)).where(F.col("round") == 1)
    nodes = trees.select("*", F.posexplode("feature").alias("node", "split")).where("split >= 0")
    at = lambda c, k: F.element_at(c, (k + 1).cast("int"))
    node = F.col("node")
    return nodes.select(
        F.col("cutoff").alias("prediction_date"), "node", F.col("split").alias("feature"), at("threshold", node).alias("threshold"),
        at("gain", node).alias("gain"), at("value", 2 * node).alias("left_value"), at("value", 2 * node + 1).alias("right_value"))


KEY = "CAST(CASE WHEN abs({0}) < 1e-10 THEN 0 ELSE sign({0}) * (ceil(least(ln(abs({0})), 40.0) * 1000) + 25000) END AS INT)"
frag("ft_cut", """SELECT c.date AS cutoff FROM (SELECT DISTINCT date FROM ds_s) c JOIN ds_s l ON l.target IS NOT NULL AND l.target_date < c.date
  GROUP BY 1 HAVING count(DISTINCT l.date) >= 36 AND min(l.target) < max(l.target)""")
frag("ft_key", "SELECT target_date, target AS y, " + ", ".join(f"{KEY.format(f)} AS k{i}" for i, f in enumerate(ML.FEATURES)) + " FROM ds_s WHERE target IS NOT NULL AND target_date IS NOT NULL")
frag("ft_n0", "SELECT c.cutoff, l.y, k0, k1, k2, k3, k4, 1 AS node, avg(l.y) OVER (PARTITION BY c.cutoff) AS p FROM ft_cut c JOIN ft_key l ON l.target_date < c.cutoff")
ft_long = lambda rows: " UNION ALL ".join(f"SELECT cutoff, node, y, p, {i} AS f, k{i} AS k FROM {rows}" for i in range(5))
frag("ft_cum", f"""SELECT *, sum(n) OVER (PARTITION BY cutoff, f ORDER BY k) AS upto, sum(n) OVER (PARTITION BY cutoff, f) AS total
  FROM (SELECT cutoff, f, k, count(*) AS n FROM ({ft_long('ft_n0')}) GROUP BY ALL)""")
frag("ft_edge", f"SELECT *, CAST(least(upto * {BASE.bins} // total, {BASE.bins - 1}) > least((upto - n) * {BASE.bins} // total, {BASE.bins - 1}) AS INT) AS is_edge FROM ft_cum")
frag("ft_code", """SELECT cutoff, f, k, sum(is_edge) OVER w - is_edge AS code, min(CASE WHEN is_edge = 1 THEN k END) OVER (PARTITION BY cutoff, f ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS thr
  FROM ft_edge WINDOW w AS (PARTITION BY cutoff, f ORDER BY k ROWS UNBOUNDED PRECEDING)""")
for level in range(BASE.max_depth):
    frag(f"ft_cell{level}", f"""SELECT cutoff, node, f, code, max(p) AS p, max(thr) AS thr, count(*) AS n, sum(y) AS k FROM ({ft_long(f'ft_n{level}')})
      JOIN ft_code USING (cutoff, f, k) WHERE node >= {2**level} GROUP BY cutoff, node, f, code""")
    frag(f"ft_run{level}", f"""SELECT cutoff, node, f, code, thr, p, ln, tn, ln * p - lk AS lg, ln * p * (1 - p) AS lh, tn * p - tk AS tg, tn * p * (1 - p) AS th FROM (
      SELECT *, sum(n) OVER w AS ln, sum(k) OVER w AS lk, sum(n) OVER a AS tn, sum(k) OVER a AS tk FROM ft_cell{level} WINDOW w AS (PARTITION BY cutoff, node, f ORDER BY code), a AS (PARTITION BY cutoff, node, f))""")
    frag(f"ft_gain{level}", f"""SELECT *, round(lg * lg / greatest(lh, 1e-12) + (tg - lg) * (tg - lg) / greatest(th - lh, 1e-12) - tg * tg / greatest(th, 1e-12), 9) AS gain
      FROM ft_run{level} WHERE least(ln, tn - ln) >= {ML.MIN_LEAF_ROWS} AND least(lh, th - lh) >= {ML.MIN_LEAF_HESSIAN}""")
    frag(f"ft_best{level}", f"SELECT * FROM ft_gain{level} WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY cutoff, node ORDER BY gain DESC, f, code) = 1")
    frag(f"ft_n{level + 1}", f"""SELECT r.cutoff, r.y, k0, k1, k2, k3, k4, CASE WHEN b.node IS NULL THEN r.node ELSE 2 * r.node + CAST((CASE b.f WHEN 0 THEN k0 WHEN 1 THEN k1 WHEN 2 THEN k2 WHEN 3 THEN k3 ELSE k4 END) > b.thr AS INT) END AS node, r.p
      FROM ft_n{level} r LEFT JOIN ft_best{level} b ON b.cutoff = r.cutoff AND b.node = r.node""")
register(
    "m3_first_tree", first_trees,
    out("(" + " UNION ALL ".join(
        f"SELECT cutoff AS prediction_date, node, f AS feature, thr AS threshold, gain, -{BASE.learning_rate} * lg / greatest(lh, 1e-12) AS left_value, "
        f"-{BASE.learning_rate} * (tg - lg) / greatest(th - lh, 1e-12) AS right_value FROM ft_best{level}" for level in range(BASE.max_depth)) + ")",
        "prediction_date", "gain left_value right_value", "node feature threshold"),
)


def current(s, d) -> DataFrame:
    last = cutoffs(s, d).agg(F.max("prediction_date").alias("prediction_date")).where("prediction_date IS NOT NULL")
    return R.score_order(scored(s, d, last, (BASE,)), name="ml_rank").select("ticker", "date", "ml_score", "ml_rank")


register("m4_current_scores", current)


def stage_ledger(s, d, stage: str) -> DataFrame:
    """A ledger per candidate, beginning with the stage's own first deployment."""
    start, end = next(x[1:] for x in STAGES if x[0] == stage)
    positions = L.score_positions(scored(s, d, cutoffs(s, d, start, end), GRID), 5, "ml", ("candidate",)).drop("strategy")
    return L.periods(positions.withColumn("stage", F.lit(stage)), ("stage", "candidate"), strict=False)


@B.shared
def validation_ledger(s, d) -> DataFrame:
    return stage_ledger(s, d, "validation")


@B.shared
def evaluation_ledger(s, d) -> DataFrame:
    return stage_ledger(s, d, "evaluation")


register("m6_candidate_ledgers", lambda s, d: validation_ledger(s, d).unionByName(evaluation_ledger(s, d)))


def study(ledger: DataFrame) -> DataFrame:
    """A stage's months in which every candidate has a known return."""
    rows = ledger.where(F.col("net_return").isNotNull())
    full = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(GRID)).select("date")
    return rows.join(F.broadcast(full), "date", "left_semi")


def chosen(s, d) -> DataFrame:
    rows = study(validation_ledger(s, d))
    months = rows.select("date").distinct().count()
    return ML.select_candidate(rows.select("candidate", "date", F.col("net_return").alias("ret")), tuple(c.name for c in GRID), months)


register("m7_candidate_selection", chosen)
register("m8_candidate_segments", lambda s, d: ML.compare_segment(study(evaluation_ledger(s, d)).drop("stage"), B.bench(s, d)))

SEGMENT = ("1998-01-01", "1999-12-31")
inside = lambda df: df.where(F.col("date").between(*[F.lit(x).cast("date") for x in SEGMENT]))
SEG_LEDGERS = lambda s, d: inside(B.suite_ledger(s, d)).withColumnRenamed("strategy", "candidate")
SEG_BENCH = lambda s, d: inside(B.bench(s, d))
frag("segl", f"SELECT l.strategy AS candidate, l.date, l.net_return AS ret, b.bench, l.turnover, l.transaction_cost FROM pos_led l JOIN br b ON b.date = l.date WHERE l.date BETWEEN DATE '{SEGMENT[0]}' AND DATE '{SEGMENT[1]}'")
evaluated("sege", "segl", "candidate", ", avg(turnover) AS mean_monthly_turnover, sum(transaction_cost) AS total_transaction_cost")
register(
    "m7_select_candidate",
    lambda s, d: ML.select_candidate(SEG_LEDGERS(s, d).select("candidate", "date", F.col("net_return").alias("ret")), B.STRATEGIES, 24),
    out("(SELECT candidate, sharpe FROM sege ORDER BY sharpe DESC LIMIT 1)", "candidate", "sharpe"),
)
register(
    "m8_compare_segment", lambda s, d: ML.compare_segment(SEG_LEDGERS(s, d), SEG_BENCH(s, d)),
    out("sege", "candidate start_date end_date", f"{ABS_NAMES} {ACT_NAMES} mean_monthly_turnover total_transaction_cost", "observations"),
)
register(
    "m8_segment_violations",
    lambda s, d: ML.segment_violations(
        SEG_LEDGERS(s, d).where((F.col("candidate") != "ml") | (F.month("date") != 3)).select("candidate", "date"), SEG_BENCH(s, d)),
    query("SELECT candidate, date FROM segl WHERE candidate = 'ml' AND month(date) = 3"),
)


@B.shared
def daily_suite_ledger(s, d) -> DataFrame:
    """All five strategies from daily bars: optimised weights and the model."""
    config = RS.Config(top_n=3, strict=False)
    days = P.benchmark_days(s, d).join(F.broadcast(B.region_days(s, d).select("date").distinct()), "date", "left_semi")
    suite = RS.strategy_suite(B.closes(B.region_days(s, d)), days, RS.model_scorer(config, BASE), config)
    return suite["ledger"]


register("b3_daily_suite", daily_suite_ledger)


def streamed(s, d) -> DataFrame:
    """Event files arrive as a stream; later versions replace earlier ones."""
    root = f"{shared_folder(s)}/stratapanel/{uuid.uuid4().hex}/stream"
    schema = s.read.parquet(f"{d}/events.parquet").schema
    files = s.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    rows = files.select(
        F.to_date("ts").alias("date"), F.col("user_id").cast("string").alias("ticker"), "value", F.col("event_id").alias("version")
    )
    start_merge(rows, root).awaitTermination()
    return read_merged(s, root)


register(
    "t1_stream_merge", streamed,
    out("(SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY version DESC) AS r FROM ev)", "date ticker", "value", "version", where="r = 1"),
)
