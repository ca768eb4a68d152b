"""Sampling, splits, folds, grids and block permutations.

Randomness is a seeded hash of a stable id (``xxhash64``), never ``rand()``
or ``monotonically_increasing_id``: results do not depend on partitioning
and survive task retries.  Contracts are counts, disjointness,
stratification and determinism by seed.
"""

from __future__ import annotations

import itertools
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlex.operators.ordering import fresh, hash_intervals, hash_order, hash_row_number, same
from marketlex.session import materialize


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))


def balance_classes(df: DataFrame, label: str = "label", id_col: str = "id",
                    seed: int = 42) -> DataFrame:
    """target = int(mean class size).  Bigger classes: ``target`` rows
    without replacement; smaller classes: all rows plus
    ``min(target - n, n)`` draws with replacement (``copy`` > 0).  A null
    label is a class.  If ``df`` has a column ``copy``, the added one gets a
    longer name."""
    copy = fresh("copy", df)
    # the numbered table feeds three branches (kept rows, draws, drawn rows)
    num = materialize(hash_row_number(df, seed, [id_col], "_rn", [label], size_col="_n"))
    target = num.select(label, "_n").distinct().agg(F.floor(F.avg("_n")).cast("long").alias("_target"))
    num = num.crossJoin(F.broadcast(target))  # exactly one row
    keep = num.filter((F.col("_n") <= F.col("_target")) | (F.col("_rn") <= F.col("_target")))
    keep = keep.withColumn(copy, F.lit(0))
    # draw d (1..k) picks the row whose in-class position is pmod(hash, n) + 1
    k = F.least(F.col("_target") - F.col("_n"), F.col("_n"))
    draws = (num.filter((F.col("_n") < F.col("_target")) & (F.col("_rn") <= k))
             .select(label, F.col("_rn").alias(copy),
                     (F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col("_rn")), F.col("_n")) + 1)
                     .alias("_rn")))
    dup = draws.alias("w").join(num.alias("r"), same("w", "r", [label, "_rn"])).select("r.*", F.col(f"w.{copy}"))
    cols = [*df.columns, copy]
    return keep.select(*cols).unionByName(dup.select(*cols))


def shuffle_rows(df: DataFrame, seed: int, *id_cols: str) -> DataFrame:
    """A full pseudo-random permutation (global sort on a hash)."""
    return df.orderBy(hash_order(seed, *id_cols), *id_cols)


def random_split(df: DataFrame, test_size: float = 0.2, id_col: str = "id",
                 seed: int = 42) -> DataFrame:
    """R2: exactly ``ceil(n * test_size)`` rows get ``split = 'test'``, those
    first in seeded hash order of the id.  Rows are not moved (see
    ``ordering.hash_intervals``)."""
    n = df.select(id_col).agg(F.count(F.lit(1)).alias("_n"))
    n_test = F.ceil(F.round(F.col("_n") * test_size, 9))  # ceil without float drift
    part = hash_intervals(df, seed, [id_col], n.select(F.array(n_test).alias("ranks")), "_part")
    return part.withColumn("split", F.when(F.col("_part") == 0, "test").otherwise("train")).drop("_part")


def _largest_remainder(counts: DataFrame, label: str, draws: Column) -> DataFrame:
    """Allocate ``draws`` over classes proportionally to ``_n``: floors plus
    one extra for the largest remainders (ties by class)."""
    total = F.sum("_n").over(Window.partitionBy())
    cont = draws * F.col("_n") / total
    d = counts.withColumn("_cont", cont).withColumn("_fl", F.floor("_cont"))
    need = draws - F.sum("_fl").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_cont") - F.col("_fl")), label))
    return d.withColumn("_alloc", F.col("_fl") + F.when(rank <= need, 1).otherwise(0))


def stratified_split(df: DataFrame, label: str = "label", test_size: float = 0.2,
                     id_col: str = "id", seed: int = 42) -> DataFrame:
    """Train share allocated per class by largest remainder
    (``n_train = n - ceil(n * test_size)``), the rest is test; rows inside a
    class are taken in seeded hash order, without moving them.  A null label
    is a class; the class table has one row per class."""
    counts = materialize(class_counts(df, label))
    tot = F.sum("_n").over(Window.partitionBy())
    n_train = tot - F.ceil(tot * F.lit(test_size))
    counts = counts.withColumn("_ntrain", n_train)
    alloc = _largest_remainder(counts, label, F.col("_ntrain")).select(label, F.array(F.col("_alloc").cast("long")).alias("ranks"))
    part = hash_intervals(df, seed, [id_col], materialize(alloc), "_part", [label])
    return part.withColumn("split", F.when(F.col("_part") == 0, "train").otherwise("test")).drop("_part")


def stratified_kfold(df: DataFrame, k: int = 5, label: str = "label", id_col: str = "id",
                     seed: int = 12) -> DataFrame:
    """The fold sizes per class are those of dealing the label-sorted rows
    round-robin: fold ``f`` gets the places ``p`` of a class (from 0) with
    ``(rows of earlier classes + p) mod k = f``.  Which rows it gets is decided
    by the seeded hash of the id: each fold is a stretch of the hash order, so
    rows are not moved.  A null label is a class, the first."""
    off = F.coalesce(F.sum("_n").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(class_counts(df, label)).withColumn("_off", off)  # one row per class
    # of n places from offset o on, fold f gets floor((n - 1 - s) / k) + 1, its first place s = (f - o) mod k
    size = lambda f: F.floor((F.col("_n") - 1 - F.pmod(f - F.col("_off"), F.lit(k))) / k) + 1
    folds = F.sequence(F.lit(0), F.lit(k - 2)) if k > 1 else F.array().cast("array<int>")
    ranks = F.transform(folds, lambda f: F.aggregate(F.sequence(F.lit(0), f), F.lit(0).cast("long"), lambda s, j: s + size(j)))
    part = hash_intervals(df, seed, [id_col], materialize(counts.select(label, ranks.alias("ranks"))), "_part", [label])
    return part.withColumn("fold", F.col("_part").cast("int")).drop("_part")


def param_grid(spark: SparkSession, values: Mapping[str, Sequence], models: Sequence[str],
               datasets: Sequence[str]) -> DataFrame:
    """Cartesian product of parameter value lists x models x datasets."""
    rows = [tuple(v) + (m, d) for v in itertools.product(*values.values()) for m in models for d in datasets]
    return spark.createDataFrame(rows, list(values.keys()) + ["model", "dataset"])


def grid_from_tables(axes: Sequence[DataFrame], max_points: int = 1_000_000) -> DataFrame:
    """R6 over value tables (each one column of distinct values): cross
    product of small dimension tables, refused beyond ``max_points``."""
    points = 1
    for a in axes:
        points *= max(1, a.count())
        if points > max_points:
            raise ValueError(f"a grid of more than {max_points} points")
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(a)
    return out


def sample_grid(grid: DataFrame, n: int = 150, seed: int = 42) -> DataFrame:
    """Random subset of ``min(n, all)`` grid points (seeded hash order)."""
    return grid.orderBy(F.xxhash64(F.lit(seed), *grid.columns), *grid.columns).limit(n)


def block_shuffle(df: DataFrame, series: Sequence[str], pos: str, block_size: int,
                  seed: int, rep: str | None = None) -> DataFrame:
    """Cut each series (per replicate ``rep``) into blocks of
    ``block_size`` consecutive positions (the short block last), permute
    the blocks by a seeded hash, keep the order inside blocks.  Adds
    ``new_pos`` (1-based).  Only the block table (rows / block_size) is
    windowed; rows get their new position from a join."""
    keys = list(series) + ([rep] if rep else [])
    d = df.withColumn("_blk", F.floor((F.col(pos) - 1) / block_size).cast("long"))
    blocks = d.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_bn"), F.min(pos).alias("_b0"))
    hk = F.xxhash64(F.lit(seed), *([F.col(rep)] if rep else []), *[F.col(s) for s in series], F.col("_blk"))
    w = Window.partitionBy(*keys).orderBy(hk, "_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_bn").over(w), F.lit(0)))
    out = d.join(blocks, [*keys, "_blk"])
    return out.withColumn("new_pos", F.col("_start") + F.col(pos) - F.col("_b0") + 1) \
        .drop("_blk", "_bn", "_b0", "_start")
