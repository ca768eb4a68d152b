"""Projections, filters and cleaning of tables."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shift_labels(df: DataFrame, col: str = "labels", out: str = "label") -> DataFrame:
    """Labels -1/0/1 -> 0/1/2 as int."""
    return df.withColumn(out, (F.col(col) + 1).cast("int"))


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null (or NaN) in any of ``cols``."""
    return df.dropna(subset=list(cols) if cols else None)


def dedup_by_key(df: DataFrame, key: str, order_col: str, unique_order: bool = True) -> DataFrame:
    """Keep the first row (smallest ``order_col``) of every ``key`` value.

    Keys are grouped by two 64-bit hashes, the hash aggregate of (hashes,
    smallest order value) combines map-side, and the winners are joined
    back: long keys (texts) are hashed, never sorted or shuffled twice.
    ``unique_order=False`` also drops rows that share the key and the
    smallest order value (one more shuffle).
    """
    digest = [F.xxhash64(F.lit(7), key).alias("_h1"), F.xxhash64(F.lit(13), key).alias("_h2")]
    first = df.select(*digest, F.col(order_col).alias("_o")).groupBy("_h1", "_h2").agg(F.min("_o").alias("_o"))
    cols = [F.col(f"`{c}`") for c in df.columns]
    j = df.select(*cols, *digest).join(first, ["_h1", "_h2"]).where(F.col(order_col).eqNullSafe(F.col("_o")))
    return (j if unique_order else j.dropDuplicates(["_h1", "_h2"])).select(*cols)


def first_per_key(df: DataFrame, key: str, order_col: str, cols: Sequence) -> DataFrame:
    """P3 where only narrow columns are wanted: ``cols`` of the row with the
    smallest ``order_col`` (null last) of every ``key`` value.  One pass and
    one shuffle of those columns; the key itself is only hashed."""
    digest = [F.xxhash64(F.lit(7), key).alias("_h1"), F.xxhash64(F.lit(13), key).alias("_h2")]
    order = F.col(order_col)
    row = F.struct(order.isNull().alias("_n"), order.alias("_o"), F.struct(*cols).alias("_r"))
    return df.select(*digest, row.alias("_x")).groupBy("_h1", "_h2").agg(F.min("_x").alias("_x")).select("_x._r.*")


def dedup_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct."""
    return df.distinct()


def drop_columns(df: DataFrame, prefixes: Sequence[str] = ("Unnamed: ",),
                 names: Sequence[str] = ("__index_level_0__", "index_level_0")) -> DataFrame:
    """P5: drop index artefacts."""
    return df.drop(*[c for c in df.columns if c in names or any(c.startswith(p) for p in prefixes)])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns (schema only, no job)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def recode(col, mapping: Mapping, keep_unmapped: bool = True) -> Column:
    """Dictionary value replacement.  ``keep_unmapped`` is pandas
    ``replace`` (others unchanged); otherwise pandas ``map`` (others null)."""
    c = F.col(col) if isinstance(col, str) else col
    if not mapping:
        return c if keep_unmapped else F.lit(None)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    got = F.when(c.isNull(), None).otherwise(F.try_element_at(m, c))
    return F.coalesce(got, c) if keep_unmapped else got


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P8."""
    return df.withColumnsRenamed(dict(mapping))


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """P10: one row per column: type, non-null count and number of distinct
    values.  Exact numbers come from one shuffle of distinct (column, value
    digest) pairs, combined before it; ``exact=False`` estimates them to 5 %
    in the scan itself."""
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, dtype string")
    if exact:
        cell = F.array(*[F.struct(F.lit(c).alias("column"), F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`"))).alias("_a"),
                                  F.xxhash64(F.lit(1), F.col(f"`{c}`")).alias("_b")) for c in df.columns])
        values = df.select(F.inline(cell)).where(F.col("_a").isNotNull()).groupBy("column", "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
        counts = values.groupBy("column").agg(F.sum("_n").alias("non_null"), F.count(F.lit(1)).alias("distinct_values"))
        out = types.join(counts, "column", "left").fillna(0, ["non_null", "distinct_values"])  # one row per column
        return out.select("column", "non_null", "distinct_values", "dtype")
    counts = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.col(f"`{c}`")).alias("non_null"),
                                       F.approx_count_distinct(F.col(f"`{c}`"), 0.05).alias("distinct_values")) for c in df.columns]).alias("_c"))
    stack = counts.select(F.inline("_c"))
    return stack.join(F.broadcast(types), "column")  # one row per column


def is_trading_day(close: str = "close") -> Column:
    """P11."""
    return F.col(close).isNotNull()


def weekday(date: str = "date") -> Column:
    """English day name."""
    return F.date_format(F.col(date), "EEEE")
