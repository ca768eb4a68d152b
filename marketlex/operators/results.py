"""Experiment-result analytics: group means, spreads, correlations, box
statistics, baselines and deltas (A5-A11, J1, J2, O1, O2)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlex.operators.ordering import rank_percentiles

METRICS = ("accuracy", "macro_f1", "weighted_f1", "neutral_f1", "positive_f1", "negative_f1")
PARAMS = ("learning_rate", "batch_size", "epochs", "weight_decay", "class_weight_floor")


def sort_results(df: DataFrame, by: Sequence = ("model", "dataset")) -> DataFrame:
    """O1."""
    return df.orderBy(*by)


def top_k(df: DataFrame, metric: str = "weighted_f1", k: int = 15,
          tie: Sequence[str] = ()) -> DataFrame:
    """O2: best ``k`` rows by ``metric`` (a TakeOrderedAndProject: each task
    keeps its own top k, the driver merges k x tasks rows)."""
    return df.orderBy(F.col(metric).desc(), *tie).limit(k)


def mean_over_folds(df: DataFrame, run_cols: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """A5: mean of every value column over the fold rows of a run."""
    return df.groupBy(*run_cols).agg(*[F.avg(c).alias(c) for c in value_cols])


def group_mean(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS,
               digits: int | None = None) -> DataFrame:
    """A6."""
    def r(c):
        return F.round(c, digits) if digits is not None else c
    return df.groupBy(*keys).agg(*[r(F.avg(m)).alias(m) for m in metrics])


def group_mean_std(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation (ddof 1)."""
    return df.groupBy(*keys).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics],
                                 *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics])


def correlation_block(df: DataFrame, xs: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """Pearson correlation of every (x, y) pair from one aggregation,
    returned long as ``(x, y, corr)``; null for a constant column."""
    wide = df.agg(*[F.corr(x, y).alias(f"{x}\u0001{y}") for x in xs for y in ys])
    long = wide.unpivot([], wide.columns, "pair", "corr")
    return long.select(F.split("pair", "\u0001")[0].alias("x"), F.split("pair", "\u0001")[1].alias("y"),
                       "corr")


def box_stats(df: DataFrame, keys: Sequence[str], value: str, exact: bool = True) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers (most extreme values inside the
    fences) per group: percentiles (exact by ranks, or approximate), one join
    back, one min/max."""
    qs = [0.25, 0.5, 0.75]
    q = (rank_percentiles(df, value, qs, keys).withColumnRenamed("_p", "_q") if exact
         else df.groupBy(*keys).agg(F.percentile_approx(value, qs, 100000).alias("_q")))
    q = q.select(*keys, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3"))
    j = df.select(*keys, value).join(q, list(keys))
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return j.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(F.col(value) >= lo_f, F.col(value))).alias("whisker_lo"),
        F.max(F.when(F.col(value) <= hi_f, F.col(value))).alias("whisker_hi"),
        F.count(F.when((F.col(value) < lo_f) | (F.col(value) > hi_f), 1)).alias("n_outliers"))


def percentiles(df: DataFrame, value: str, ps: Sequence[float], keys: Sequence[str] = (),
                exact: bool = True) -> DataFrame:
    """A10: linear-interpolated percentiles, exact by ranks; ``exact=False``
    is one approximate aggregate (its values are the data's own)."""
    if exact:
        base = rank_percentiles(df, value, list(ps), keys)
    else:
        agg = F.percentile_approx(value, list(ps)).alias("_p")
        base = df.groupBy(*keys).agg(agg) if keys else df.agg(agg)
    return base.select(*keys, *[F.col("_p")[i].alias(f"p{int(round(p * 100))}") for i, p in enumerate(ps)])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str],
         var: str = "metric", val: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(list(ids), list(values), var, val)


def baseline_join(df: DataFrame, baseline: str, metric: str = "weighted_f1",
                  model: str = "model", dataset: str = "dataset") -> DataFrame:
    """Every (model, dataset) row with its model's baseline score as
    ``{metric}_benchmark``.  The baseline side is one row per model."""
    b = (df.filter(F.col(dataset) == baseline)
         .select(model, F.col(metric).alias(f"{metric}_benchmark")))
    return df.join(b, model)


def baseline_delta(df: DataFrame, baseline: str, metric: str = "weighted_f1",
                   model: str = "model", dataset: str = "dataset") -> DataFrame:
    """``delta = metric - baseline metric`` of the same model; baseline
    rows removed.  The baseline side is aggregated to one row per model and
    joined (AQE broadcasts it once measured), so a model's rows need not meet
    in one task."""
    base = df.groupBy(model).agg(F.max(F.when(F.col(dataset) == baseline, F.col(metric))).alias("baseline"))
    return (df.filter(F.col(dataset) != baseline).join(base, model)
            .withColumn("delta", F.col(metric) - F.col("baseline")))
