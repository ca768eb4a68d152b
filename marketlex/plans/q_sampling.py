"""Registered sampling / split / fold queries.  Seeded hash orders have no
DuckDB twin, so the oracles check what the contract fixes: counts per
class, split and fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlex.operators import sampling as R
from marketlex.operators.ordering import global_row_number
from marketlex.plans.views import V_LABELLED_SQL, V_OHLC_SQL, V_RUNS_SQL, v_labelled, v_ohlc, v_runs
from marketlex.session import materialize

QUERIES = {}
ORACLES = {}

_COUNTS = f"WITH {V_LABELLED_SQL}, c AS (SELECT label, count(*) AS n FROM v_labelled GROUP BY label)"


def r1_balance_classes(spark, sf_dir):
    b = R.balance_classes(v_labelled(spark, sf_dir), "label", "id", seed=42)
    return b.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_distinct"))


QUERIES["r1_balance_classes"] = r1_balance_classes
ORACLES["r1_balance_classes"] = _COUNTS + """,
t AS (SELECT CAST(floor(avg(n)) AS BIGINT) AS target FROM c)
SELECT label, CASE WHEN n > target THEN target WHEN n < target THEN n + least(target - n, n) ELSE n END AS n_rows,
       CASE WHEN n > target THEN target ELSE n END AS n_distinct FROM c, t"""


def r2_random_split(spark, sf_dir):
    s = R.random_split(v_labelled(spark, sf_dir), 0.2, "id", seed=42)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


QUERIES["r2_random_split"] = r2_random_split
ORACLES["r2_random_split"] = f"""WITH {V_LABELLED_SQL}, t AS (SELECT count(*) AS n, CAST(ceil(count(*) * 0.2) AS BIGINT) AS k FROM v_labelled)
SELECT 'test' AS split, k AS n FROM t UNION ALL SELECT 'train' AS split, n - k AS n FROM t"""


def r3_stratified_split(spark, sf_dir):
    s = R.stratified_split(v_labelled(spark, sf_dir), "label", 0.2, "id", seed=42)
    return s.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


QUERIES["r3_stratified_split"] = r3_stratified_split
ORACLES["r3_stratified_split"] = _COUNTS + """,
t AS (SELECT sum(n) AS tot, sum(n) - ceil(sum(n) * 0.2) AS ntr FROM c),
a AS (SELECT label, n, ntr * n / tot AS cont, floor(ntr * n / tot) AS fl, ntr FROM c, t),
r AS (SELECT *, row_number() OVER (ORDER BY cont - fl DESC, label) AS rk, ntr - sum(fl) OVER () AS need FROM a),
al AS (SELECT label, n, CAST(fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS BIGINT) AS tr FROM r)
SELECT label, 'train' AS split, tr AS n FROM al WHERE tr > 0
UNION ALL SELECT label, 'test' AS split, n - tr AS n FROM al WHERE n - tr > 0"""


def r4_stratified_kfold(spark, sf_dir):
    f = R.stratified_kfold(v_labelled(spark, sf_dir), 5, "label", "id", seed=12)
    return f.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


QUERIES["r4_stratified_kfold"] = r4_stratified_kfold
ORACLES["r4_stratified_kfold"] = _COUNTS + """,
o AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c),
x AS (SELECT label, CAST((off + unnest(range(1, n + 1)) - 1) % 5 AS INTEGER) AS fold FROM o)
SELECT fold, label, count(*) AS n FROM x GROUP BY ALL"""


def r6_param_grid(spark, sf_dir):
    return R.grid_from_tables(_axes(spark, sf_dir))


def _axes(spark, sf_dir):
    """Distinct values of each axis from one scan of the runs."""
    names = ("batch_size", "model_seed", "model", "dataset")
    values = materialize(v_runs(spark, sf_dir).select(*names).distinct())
    return [values.select(c).distinct() for c in names]


def r6_param_subset(spark, sf_dir):
    """A random subset of the grid: its size, and that every point is one of
    the grid's."""
    grid = R.grid_from_tables(_axes(spark, sf_dir))
    some = R.sample_grid(grid, 100, seed=42)
    return some.join(grid, grid.columns).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*grid.columns).alias("n_distinct"))


QUERIES["r6_param_subset"] = r6_param_subset
ORACLES["r6_param_subset"] = """WITH g AS (SELECT count(DISTINCT 8 * (l_linenumber % 3 + 1)) * count(DISTINCT l_linenumber)
  * count(DISTINCT l_returnflag) * count(DISTINCT l_linestatus) AS points FROM lineitem)
SELECT least(100, points) AS n, least(100, points) AS n_distinct FROM g"""
QUERIES["r6_param_grid"] = r6_param_grid
ORACLES["r6_param_grid"] = (f"WITH {V_RUNS_SQL} SELECT * FROM (SELECT DISTINCT batch_size FROM v_runs), "
                            "(SELECT DISTINCT model_seed FROM v_runs), (SELECT DISTINCT model FROM v_runs), "
                            "(SELECT DISTINCT dataset FROM v_runs)")


def r7_block_shuffle(spark, sf_dir):
    """Block permutation of each company's daily close series (rows only:
    the seeded hash order has no SQL twin; properties are unit-tested)."""
    o = v_ohlc(spark, sf_dir).select("company", "date", "close")
    o = global_row_number(o, ["date"], F.year("date"), "pos", ["company"])
    return R.block_shuffle(o, ["company"], "pos", 5, seed=7).select("company", "date", "pos", "new_pos", "close")


QUERIES["r7_block_shuffle"] = r7_block_shuffle


def r7_block_invariants(spark, sf_dir):
    """What any seed gives: every value once, new positions 1..n, order kept
    inside blocks (next old position follows unless a block ended)."""
    from pyspark.sql import Window
    d = r7_block_shuffle(spark, sf_dir)
    w = Window.partitionBy("company").orderBy("new_pos")
    d = d.withColumn("prev", F.lag("pos").over(w))
    inside = (F.col("pos") - 1) % 5 != 0
    return d.groupBy("company").agg(
        F.count(F.lit(1)).alias("n"), F.min("new_pos").cast("long").alias("first"), F.max("new_pos").cast("long").alias("last"),
        F.count_distinct("new_pos").alias("n_distinct"), F.round(F.sum("close"), 2).alias("sum_close"),
        F.count(F.when(inside & (F.col("prev") != F.col("pos") - 1), 1)).alias("broken"))


QUERIES["r7_block_invariants"] = r7_block_invariants
ORACLES["r7_block_invariants"] = (f"WITH {V_OHLC_SQL} SELECT company, count(*) AS n, 1 AS first, count(*) AS last, count(*) AS n_distinct, "
                                  "round(sum(close), 2) AS sum_close, 0 AS broken FROM v_ohlc GROUP BY company")
