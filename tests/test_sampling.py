"""Sampling contracts: counts, disjointness, stratification, determinism."""

from pyspark.sql import functions as F

from marketlex.operators import sampling as R
from marketlex.operators.ordering import global_row_number
from marketlex.plans.views import v_labelled, v_ohlc

SF = "/root/testdata/sf0.01"


def _counts(df, *cols):
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*cols).count().collect()}


def test_kfold_disjoint_exhaustive_balanced(spark):
    lab = v_labelled(spark, SF)
    f = R.stratified_kfold(lab, 5, "label", "id", seed=12)
    rows = f.select("id", "fold").collect()
    assert len(rows) == lab.count() == len({r["id"] for r in rows})
    per = _counts(f, "label", "fold")
    for c in {k[0] for k in per}:
        sizes = [per.get((c, k), 0) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_kfold_same_seed_same_rows_any_partitioning(spark):
    lab = v_labelled(spark, SF)
    a = {r["id"]: r["fold"] for r in R.stratified_kfold(lab.repartition(3), 5, seed=7).collect()}
    b = {r["id"]: r["fold"] for r in R.stratified_kfold(lab.repartition(11), 5, seed=7).collect()}
    c = {r["id"]: r["fold"] for r in R.stratified_kfold(lab, 5, seed=8).collect()}
    assert a == b and a != c


def test_stratified_split_largest_remainder(spark):
    s = R.stratified_split(v_labelled(spark, SF), "label", 0.2, "id", seed=42)
    test = _counts(s.filter("split = 'test'"), "label")
    assert test == {(0,): 10, (1,): 62, (2,): 8}


def test_balance_classes_counts(spark):
    b = R.balance_classes(v_labelled(spark, SF), "label", "id", seed=42)
    assert _counts(b, "label") == {(0,): 98, (1,): 133, (2,): 84}
    # duplicates come only from the minority classes, at most doubling them
    assert b.filter("copy > 0").select("label").distinct().count() == 2


def test_random_split_exact_size(spark):
    s = R.random_split(v_labelled(spark, SF), 0.2, "id", seed=1)
    n = s.count()
    assert s.filter("split = 'test'").count() == -(-n * 2 // 10)


def test_global_row_number_is_a_permutation(spark):
    o = v_ohlc(spark, SF).select("company", "date")
    g = global_row_number(o, ["date", "company"], F.year("date"), "pos")
    pos = sorted(r["pos"] for r in g.collect())
    assert pos == list(range(1, len(pos) + 1))
    ordered = [(r["date"], r["company"]) for r in g.orderBy("pos").collect()]
    assert ordered == sorted(ordered)


def test_block_shuffle_keeps_blocks(spark):
    df = spark.range(1, 24).select(F.lit("s").alias("series"), F.col("id").alias("pos"))
    out = R.block_shuffle(df, ["series"], "pos", 5, seed=3).orderBy("new_pos").collect()
    seq = [r["pos"] for r in out]
    assert sorted(seq) == list(range(1, 24))
    assert [r["new_pos"] for r in out] == list(range(1, 24))
    blocks = []
    for p in seq:
        if blocks and blocks[-1][-1] + 1 == p and (p - 1) % 5 != 0:
            blocks[-1].append(p)
        else:
            blocks.append([p])
    assert sorted(len(b) for b in blocks) == [3, 5, 5, 5, 5]
    assert seq != list(range(1, 24))


def test_param_grid_and_sample(spark):
    g = R.param_grid(spark, {"lr": [1e-5, 2e-5], "bs": [8, 16, 32]}, ["m1"], ["d1", "d2"])
    assert g.count() == 12
    s1 = [tuple(r) for r in R.sample_grid(g, 5, seed=1).collect()]
    s2 = [tuple(r) for r in R.sample_grid(g.repartition(4), 5, seed=1).collect()]
    assert len(s1) == 5 and s1 == s2
