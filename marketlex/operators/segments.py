"""Lags and carried values of series of any length.

A window over a whole series puts the series into one task.  Here a series is
cut by *segments*, any expression that never falls along its order (a month,
a range of ids), and windows run over one segment.  What a segment needs from
before it is small: its *halo*, the last ``max_lag`` rows before it, and the
last value that is not null.  Both come from a table with a few rows per
segment.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segmented(df: DataFrame, keys: Sequence[str], segment: Column) -> DataFrame:
    """``df`` with the key of its segment (nulls are values of their own, the
    null segment is the first)."""
    return df.withColumn("__seg", F.struct(*keys, segment.alias("__b")))


def _before(keys: Sequence[str]):
    return Window.partitionBy(*[F.col(f"__seg.`{k}`") for k in keys]).orderBy("__seg.__b")


def halos(d: DataFrame, cols: Sequence[str], keys: Sequence[str], order: Sequence[str], max_lag: int) -> DataFrame:
    """(__seg, __halo): the last ``max_lag`` rows before each segment, oldest
    first; ``d`` comes from ``segmented``."""
    in_order = Window.partitionBy("__seg").orderBy(*order)
    rows = d.select("__seg", *dict.fromkeys([*order, *cols])).withColumns({"__rn": F.row_number().over(in_order), "__n": F.count(F.lit(1)).over(Window.partitionBy("__seg"))})
    tail = rows.where(F.col("__rn") > F.col("__n") - max_lag).groupBy("__seg").agg(F.sort_array(F.collect_list(F.struct("__rn", *cols))).alias("__t"))  # max_lag rows
    # every segment has a row, so max_lag segments hold max_lag rows
    near = F.flatten(F.collect_list("__t").over(_before(keys).rowsBetween(-max_lag, -1)))
    return tail.select("__seg", F.slice(near, F.greatest(F.size(near) - max_lag + 1, F.lit(1)), max_lag).alias("__halo"))


def lags(df: DataFrame, specs: Sequence[tuple[str, int, str]], keys: Sequence[str], order: Sequence[str], segment: Column) -> DataFrame:
    """``df`` with a column ``name`` for each (column, lag, name): the value
    ``lag`` rows earlier in the series, null where there is none."""
    if not specs:
        return df
    cols, max_lag = list(dict.fromkeys(c for c, _, _ in specs)), max(i for _, i, _ in specs)
    d = segmented(df, keys, segment)
    w = Window.partitionBy("__seg").orderBy(*order)
    d2 = d.select("*", F.row_number().over(w).alias("__rn"), *[F.lag(c, i).over(w).alias(f"__l{k}") for k, (c, i, _) in enumerate(specs)])
    out = d2.join(halos(d, cols, keys, order, max_lag), "__seg", "left")
    at = lambda i: F.size("__halo") + F.col("__rn") - i
    made = [F.when(F.col("__rn") > i, F.col(f"__l{k}")).when(at(i) >= 1, F.try_element_at("__halo", F.greatest(at(i), F.lit(1)))[c]).alias(name)
            for k, (c, i, name) in enumerate(specs)]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *made)


def carried(df: DataFrame, col: str, name: str, keys: Sequence[str], order: Sequence[str], segment: Column) -> DataFrame:
    """``df`` with ``name``: the last value of ``col`` up to the row that is
    not null (forward fill)."""
    d = segmented(df, keys, segment)
    w = Window.partitionBy("__seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    present = F.when(F.col(col).isNotNull(), F.struct(*order, F.col(col).alias("__v")))
    last = d.groupBy("__seg").agg(F.max(present).alias("__x"))  # one row per segment
    before = last.select("__seg", F.last("__x.__v", ignorenulls=True).over(_before(keys).rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    out = d.select("*", F.last(col, ignorenulls=True).over(w).alias("__pad")).join(before, "__seg", "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("__pad", "__carry").alias(name))


def month(date: str) -> Column:
    """Segment of a date or time column: its calendar month."""
    return F.trunc(F.col(date).cast("date"), "month")
