"""Daily price features, calendar densification, lags and fit-time scaling.

All windows share one spec per key (``partitionBy(key).orderBy(date)``) so
Spark plans a single exchange + sort for every column computed over it.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlex.operators import segments
from marketlex.operators.ordering import fresh, global_row_number, rank_percentiles


def _w(key: str, date: str):
    return Window.partitionBy(key).orderBy(date)


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Ingest rule: NaN becomes NULL so predicates and averages act like pandas."""
    dbl = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    cols = [c for c in (cols or dbl) if c in dbl]
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def price_features(df: DataFrame, key: str = "company", date: str = "date",
                   open_: str = "open", high: str = "high", low: str = "low",
                   close: str = "close", segment: Column | None = None) -> DataFrame:
    """W1-W6 on trading-day rows: simple, intraday and overnight return,
    change, direction and range volatility.

    Windows run over a whole series, one company's rows in a task; with
    ``segment`` (see ``segments``) over one segment of it, for series of any
    length."""
    w = _w(key, date)
    last, before = fresh("_pad", df), [fresh(f"_prev_{c}", df) for c in ("pad", "open", "close")]
    if segment is None:
        d = df.withColumn(last, F.last(close, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        d = d.select("*", *[F.lag(c, 1).over(w).alias(b) for c, b in zip((last, open_, close), before)])
    else:
        d = segments.carried(df, close, last, [key], [date], segment)
        d = segments.lags(d, [(c, 1, b) for c, b in zip((last, open_, close), before)], [key], [date], segment)
    pad, opened, closed = (F.col(b) for b in before)
    out = d.select(
        *df.columns, (F.try_divide(F.col(last), pad) - 1).alias("ret"),
        F.try_divide(F.col(close) - F.col(open_), F.col(open_)).alias("same_day_return"),
        F.try_divide(F.col(close) - opened, F.col(close)).alias("overnight_return"),
        (F.col(close) - closed).alias("change"))
    return out.withColumn("direction", direction(F.col("ret"))).withColumn(
        "volatility", volatility_range(F.col(high), F.col(low), F.col(open_)))


def direction(ret: Column) -> Column:
    """1 if return > 0 else -1 (null counts as not positive)."""
    return F.when(ret > 0, F.lit(1)).otherwise(F.lit(-1))


def volatility_range(high: Column, low: Column, open_: Column) -> Column:
    """(high - low) / open, 0 where open is 0."""
    return F.when(open_ == 0, F.lit(0.0)).otherwise(F.try_divide(high - low, open_))


def densify_calendar(df: DataFrame, key: str = "company", date: str = "date",
                     trading_col: str = "close") -> DataFrame:
    """One row per calendar day between each key's first and last date;
    days without a row carry nulls.  Adds ``weekday`` and ``is_trading_day``."""
    bounds = df.groupBy(key).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    cal = bounds.select(key, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias(date))
    out = cal.join(df, [key, date], "left")
    return (out.withColumn("weekday", F.date_format(date, "EEEE"))
            .withColumn("is_trading_day", F.col(trading_col).isNotNull()))


def row_lags(df: DataFrame, cols: Sequence[str], max_lag: int, key: str = "company",
             order: str | Sequence[str] = "date", segment: Column | None = None) -> DataFrame:
    """``{c}_lag_{i}`` = value ``i`` rows earlier within the key, in the
    order of one or more columns.  With ``segment`` a series is not one task's
    (see ``segments``)."""
    order = [order] if isinstance(order, str) else list(order)
    if segment is not None:
        return segments.lags(df, [(c, i, f"{c}_lag_{i}") for c in cols for i in range(1, max_lag + 1)], [key], order, segment)
    w = Window.partitionBy(key).orderBy(*order)
    return df.select("*", *[F.lag(c, i).over(w).alias(f"{c}_lag_{i}")
                            for c in cols for i in range(1, max_lag + 1)])


def calendar_lags(df: DataFrame, cols: Sequence[str], max_lag: int, key: str = "company",
                  date: str = "date", trading_col: str = "is_trading_day",
                  dense: bool = False, order: str | None = None, keep_calendar: bool = False) -> DataFrame:
    """Trading-day rows with ``{c}_lag_{i}`` = value of ``c`` exactly
    ``i`` calendar days earlier for the same key (null where that day is
    missing).  Filled days serve as sources and are dropped afterwards;
    ``keep_calendar`` keeps them, with null lags.

    Several rows on one day: the first in ``order`` is the day's value, null
    or not (``order`` may be left out where dates are unique).

    General path: every source row is emitted once per lag at its target
    date and the targets are joined back -- two shuffles whatever
    ``max_lag`` is.  ``dense=True`` (calendar already densified, unique
    dates) uses window lags, which need no join at all.
    """
    trading = F.col(trading_col)
    names = [f"{c}_lag_{i}" for i in range(1, max_lag + 1) for c in cols]
    if dense:
        w = _w(key, date)
        out = df.select("*", *[F.when(trading, F.lag(c, i).over(w)).alias(f"{c}_lag_{i}")
                               for i in range(1, max_lag + 1) for c in cols])
        return out if keep_calendar else out.filter(trading)
    rank = F.col(order) if order else F.lit(0)
    shifted = (df.select(key, date, *cols, rank.alias("_order"))
               .withColumn("_lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag))))
               .withColumn("_tdate", F.date_add(F.col(date), F.col("_lag"))))
    piv = shifted.groupBy(key, "_tdate").agg(
        *[F.min_by(F.struct(F.col(c).alias("v")), F.when(F.col("_lag") == i, F.col("_order")))["v"].alias(f"{c}_lag_{i}")
          for i in range(1, max_lag + 1) for c in cols])
    piv = piv.withColumnRenamed("_tdate", date)
    joined = (df if keep_calendar else df.filter(trading)).join(piv, [key, date], "left")
    return joined.select(*[F.col(c) for c in df.columns],
                         *[F.when(trading, F.col(n)).alias(n) for n in names])


def zscore_filter(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = (),
                  z: float = 3.0) -> DataFrame:
    """Keep rows whose population z-score is below ``z`` in every column.

    Group statistics come from a map-side-combined aggregate joined back on
    the group key (no window holding a whole group).  A constant column
    gives undefined z and drops every row, as in the reference."""
    stats = df.groupBy(*group_cols).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    # one row per group: AQE broadcasts it when its measured size is small
    j = df.join(stats, list(group_cols), "inner") if group_cols else df.crossJoin(stats)
    cond = F.lit(True)
    for c in cols:
        zc = F.abs(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")))
        cond = cond & F.coalesce(zc < z, F.lit(False))
    return j.filter(cond).select(*df.columns)


def winsorize_bounds(train: DataFrame, cols: Sequence[str], lower: float = 5,
                     upper: float = 95, exact: bool = True) -> DataFrame:
    """W9 bounds: one row ``{c}_lo, {c}_hi`` = linear-interpolated percentiles
    of the train part, all columns at once by ranks (``exact=False``: one
    approximate aggregate)."""
    qs = [lower / 100.0, upper / 100.0]
    if not exact:
        return train.agg(*[F.percentile_approx(c, q, 100000).alias(f"{c}_{e}") for c in cols for q, e in zip(qs, ("lo", "hi"))])
    long = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_x")) for c in cols])))
    p = rank_percentiles(long, "_x", qs, ["_column"])  # one row per column
    return p.agg(*[F.max(F.when(F.col("_column") == c, F.col("_p")[k])).alias(f"{c}_{e}") for c in cols for k, e in ((0, "lo"), (1, "hi"))])


def clip(x: Column, lo: Column, hi: Column) -> Column:
    """M5: bound to [lo, hi]; null stays null."""
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, lo), hi))


def apply_winsorize(df: DataFrame, bounds: DataFrame, cols: Sequence[str]) -> DataFrame:
    j = df.crossJoin(F.broadcast(bounds))  # bounds is exactly one row
    return j.select(*[clip(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi")).alias(c) if c in cols
                      else F.col(c) for c in df.columns])


def winsorize(train: DataFrame, parts: Sequence[DataFrame], cols: Sequence[str],
              lower: float = 5, upper: float = 95, exact: bool = True):
    """Clip train and every other part to the train percentiles; returns
    ``(clipped_train, [clipped parts], bounds)``."""
    b = winsorize_bounds(train, cols, lower, upper, exact)
    return apply_winsorize(train, b, cols), [apply_winsorize(p, b, cols) for p in parts], b


def standardize(train: DataFrame, parts: Sequence[DataFrame], cols: Sequence[str]):
    """(x - mean) / population std of train (std 0 -> 1), applied to all parts."""
    stats = train.agg(*[F.avg(c).alias(f"{c}_mu") for c in cols],
                      *[F.stddev_pop(c).alias(f"{c}_sd") for c in cols])

    def app(df):
        j = df.crossJoin(F.broadcast(stats))
        return j.select(*[((F.col(c) - F.col(f"{c}_mu")) /
                           F.when(F.col(f"{c}_sd") == 0, 1.0).otherwise(F.col(f"{c}_sd"))).alias(c)
                          if c in cols else F.col(c) for c in df.columns])
    return app(train), [app(p) for p in parts], stats


def chronological_split(df: DataFrame, order_cols: Sequence[str], bucket: Column,
                        train_ratio: float = 0.7, valid_ratio: float = 0.1) -> DataFrame:
    """First ``floor(n*train_ratio)`` rows (in time order) are train, the
    next ``floor(n*valid_ratio)`` valid, the rest test.  ``bucket`` must be
    monotone in the order (e.g. the date) so positions come from per-bucket
    counts plus offsets, never from one global window.  A null order value
    comes first."""
    numbered = global_row_number(df, order_cols, bucket, "_pos")
    n = df.count()
    n_train = int(n * train_ratio)
    n_valid = int(n * valid_ratio)
    if n_train == 0 or n_valid == 0 or n - n_train - n_valid <= 0:
        raise ValueError(f"empty split part for n={n}")
    part = (F.when(F.col("_pos") <= n_train, "train")
            .when(F.col("_pos") <= n_train + n_valid, "valid").otherwise("test"))
    return numbered.withColumn("part", part)
