"""Registered experiment-analytics queries over ``v_runs`` and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlex.operators import results as R
from marketlex.plans.views import V_RUNS_SQL, v_runs

QUERIES = {}
ORACLES = {}
M = R.METRICS
HP = ("learning_rate", "batch_size", "weight_decay")
BASE = "O"


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _sql_avgs(cols, fn="avg", suffix=""):
    return ", ".join(f"round({fn}({c}), 6) AS {c}{suffix}" for c in cols)


def a05_mean_over_folds(spark, sf_dir):
    df = R.mean_over_folds(v_runs(spark, sf_dir), ["model", "dataset", "model_seed"], list(M) + list(HP))
    return _r6(df, list(M) + list(HP))


QUERIES["a05_mean_over_folds"] = a05_mean_over_folds
ORACLES["a05_mean_over_folds"] = (f"WITH {V_RUNS_SQL} SELECT model, dataset, model_seed, "
                                  f"{_sql_avgs(list(M) + list(HP))} FROM v_runs GROUP BY ALL")


def a06_group_mean(spark, sf_dir):
    return R.group_mean(v_runs(spark, sf_dir), ["model", "dataset"], M, digits=6)


QUERIES["a06_group_mean"] = a06_group_mean
ORACLES["a06_group_mean"] = f"WITH {V_RUNS_SQL} SELECT model, dataset, {_sql_avgs(M)} FROM v_runs GROUP BY ALL"


def a07_group_mean_std(spark, sf_dir):
    df = R.group_mean_std(v_runs(spark, sf_dir), ["batch_size", "model_seed"], ["weighted_f1", "accuracy"])
    return _r6(df, [c for c in df.columns if c.endswith(("_mean", "_std"))])


QUERIES["a07_group_mean_std"] = a07_group_mean_std
ORACLES["a07_group_mean_std"] = (
    f"WITH {V_RUNS_SQL} SELECT batch_size, model_seed, "
    "round(avg(weighted_f1), 6) AS weighted_f1_mean, round(avg(accuracy), 6) AS accuracy_mean, "
    "round(stddev_samp(weighted_f1), 6) AS weighted_f1_std, round(stddev_samp(accuracy), 6) AS accuracy_std "
    "FROM v_runs GROUP BY ALL")


def a08_correlation_block(spark, sf_dir):
    return _r6(R.correlation_block(v_runs(spark, sf_dir), HP, M), ["corr"])


QUERIES["a08_correlation_block"] = a08_correlation_block
ORACLES["a08_correlation_block"] = f"WITH {V_RUNS_SQL} " + " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS corr FROM v_runs" for x in HP for y in M)


def a09_box_stats(spark, sf_dir):
    long = R.melt(v_runs(spark, sf_dir), ["model", "dataset"], list(M))
    df = R.box_stats(long, ["model", "dataset", "metric"], "value")
    return _r6(df, ["q1", "median", "q3", "whisker_lo", "whisker_hi"])


QUERIES["a09_box_stats"] = a09_box_stats
ORACLES["a09_box_stats"] = f"""WITH {V_RUNS_SQL},
v AS (SELECT model, dataset, metric, value FROM (UNPIVOT (SELECT model, dataset, {', '.join(M)} FROM v_runs) ON {', '.join(M)} INTO NAME metric VALUE value)),
q AS (SELECT model, dataset, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM v GROUP BY ALL)
SELECT model, dataset, metric, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END), 6) AS whisker_lo,
       round(max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END), 6) AS whisker_hi,
       count(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
FROM v JOIN q USING (model, dataset, metric) GROUP BY model, dataset, metric, q1, median, q3"""


def a10_percentiles(spark, sf_dir):
    return _r6(R.percentiles(v_runs(spark, sf_dir), "macro_f1", [0.05, 0.5, 0.95], ["dataset"]),
               ["p5", "p50", "p95"])


QUERIES["a10_percentiles"] = a10_percentiles
ORACLES["a10_percentiles"] = (
    f"WITH {V_RUNS_SQL} SELECT dataset, round(quantile_cont(macro_f1, 0.05), 6) AS p5, "
    "round(quantile_cont(macro_f1, 0.5), 6) AS p50, round(quantile_cont(macro_f1, 0.95), 6) AS p95 "
    "FROM v_runs GROUP BY dataset")


def a11_melt(spark, sf_dir):
    d = v_runs(spark, sf_dir)
    return _r6(R.melt(d, ["run_id", "model_seed"], list(M)), ["value"])


QUERIES["a11_melt"] = a11_melt
ORACLES["a11_melt"] = (f"WITH {V_RUNS_SQL} SELECT run_id, model_seed, metric, round(value, 6) AS value FROM "
                       f"(UNPIVOT (SELECT run_id, model_seed, {', '.join(M)} FROM v_runs) "
                       f"ON {', '.join(M)} INTO NAME metric VALUE value)")


def j1_baseline_join(spark, sf_dir):
    g = R.group_mean(v_runs(spark, sf_dir), ["model", "dataset"], ["weighted_f1"])
    return _r6(R.baseline_join(g, BASE), ["weighted_f1", "weighted_f1_benchmark"])


_G_SQL = f"WITH {V_RUNS_SQL}, g AS (SELECT model, dataset, avg(weighted_f1) AS weighted_f1 FROM v_runs GROUP BY ALL)"
QUERIES["j1_baseline_join"] = j1_baseline_join
ORACLES["j1_baseline_join"] = (
    f"{_G_SQL} SELECT g.model, g.dataset, round(g.weighted_f1, 6) AS weighted_f1, "
    f"round(b.weighted_f1, 6) AS weighted_f1_benchmark FROM g JOIN g b ON g.model = b.model AND b.dataset = '{BASE}'")


def j2_baseline_delta(spark, sf_dir):
    g = R.group_mean(v_runs(spark, sf_dir), ["model", "dataset"], ["weighted_f1"])
    return _r6(R.baseline_delta(g, BASE), ["weighted_f1", "baseline", "delta"])


QUERIES["j2_baseline_delta"] = j2_baseline_delta
ORACLES["j2_baseline_delta"] = (
    f"{_G_SQL} SELECT g.model, g.dataset, round(g.weighted_f1, 6) AS weighted_f1, round(b.weighted_f1, 6) AS baseline, "
    f"round(g.weighted_f1 - b.weighted_f1, 6) AS delta FROM g JOIN g b ON g.model = b.model AND b.dataset = '{BASE}' "
    f"WHERE g.dataset <> '{BASE}'")


def o2_top_k(spark, sf_dir):
    d = v_runs(spark, sf_dir).select("run_id", "model_seed", "model", "dataset", "weighted_f1")
    return R.top_k(d, "weighted_f1", 15, ["run_id", "model_seed"])


QUERIES["o2_top_k"] = o2_top_k
ORACLES["o2_top_k"] = (f"WITH {V_RUNS_SQL} SELECT run_id, model_seed, model, dataset, weighted_f1 FROM v_runs "
                       "ORDER BY weighted_f1 DESC, run_id, model_seed LIMIT 15")


def o1_sort_results(spark, sf_dir):
    g = R.group_mean(v_runs(spark, sf_dir), ["model", "dataset", "model_seed"], ["weighted_f1"], digits=6)
    return R.sort_results(g, ["model", "dataset", F.col("weighted_f1").desc()])


QUERIES["o1_sort_results"] = o1_sort_results
ORACLES["o1_sort_results"] = (f"WITH {V_RUNS_SQL} SELECT model, dataset, model_seed, round(avg(weighted_f1), 6) AS "
                              "weighted_f1 FROM v_runs GROUP BY ALL ORDER BY model, dataset, weighted_f1 DESC")
