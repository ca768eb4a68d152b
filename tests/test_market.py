"""
when the shipped price and result files are available (their folders are
given by MARKETLEX_PRICE_DIR and MARKETLEX_RESULTS_DIR; read as data only)."""

import math
import os

import pytest
from pyspark.sql import functions as F

from marketlex.operators import market
from marketlex.sources.files import read_ohlcv, read_results_dir
from marketlex.operators import results as R

STOCK = os.environ.get("MARKETLEX_PRICE_DIR", "")
RESULTS = os.environ.get("MARKETLEX_RESULTS_DIR", "")

GOLD = {  # company: rows, calendar days, filled days, sum Return, sum same-day, sum overnight, dir+1, dir-1, mean vol
    "ALLEGRO": (503, 731, 228, 0.785904, 0.446583, 0.705365, 259, 244, 0.032001),
    "CCC": (468, 680, 212, 1.781433, 0.966199, 1.975143, 247, 221, 0.040530),
    "CDR": (553, 802, 249, 0.820889, -0.351270, -0.204863, 288, 265, 0.036498),
    "LPP": (440, 639, 199, 0.697574, 0.409248, 0.390212, 211, 229, 0.035601),
    "MENTZEN": (74, 105, 31, -0.353527, -0.328863, -0.919246, 27, 47, 0.052038),
}


@pytest.mark.skipif(not os.path.isdir(STOCK), reason="MARKETLEX_PRICE_DIR not set")
def test_price_feature_goldens(spark):
    raw = read_ohlcv(spark, STOCK)
    feats = market.densify_calendar(market.price_features(raw))
    agg = {r["company"]: r for r in feats.groupBy("company").agg(
        F.count(F.when(F.col("is_trading_day"), 1)).alias("rows"), F.count(F.lit(1)).alias("days"),
        F.sum("ret").alias("r"), F.sum("same_day_return").alias("s"), F.sum("overnight_return").alias("o"),
        F.count(F.when(F.col("direction") == 1, 1)).alias("up"), F.count(F.when(F.col("direction") == -1, 1)).alias("dn"),
        F.avg("volatility").alias("v")).collect()}
    for c, (rows, days, filled, r, s, o, up, dn, v) in GOLD.items():
        a = agg[c]
        assert (a["rows"], a["days"], a["days"] - a["rows"], a["up"], a["dn"]) == (rows, days, filled, up, dn)
        for got, want in ((a["r"], r), (a["s"], s), (a["o"], o), (a["v"], v)):
            assert math.isclose(round(got, 6), want, abs_tol=1.5e-6)
    row = feats.filter((F.col("company") == "ALLEGRO") & (F.col("date") == "2022-10-13")).first()
    assert round(row["ret"], 6) == -0.017540 and round(row["same_day_return"], 6) == -0.030501
    assert round(row["overnight_return"], 6) == -0.078816 and round(row["change"], 3) == -0.328
    assert row["direction"] == -1 and round(row["volatility"], 6) == 0.062902
    first = feats.filter(F.col("company") == "ALLEGRO").orderBy("date").first()
    assert first["ret"] is None and first["overnight_return"] is None and first["direction"] == -1


@pytest.mark.skipif(not os.path.isdir(RESULTS), reason="MARKETLEX_RESULTS_DIR not set")
def test_results_dir_goldens(spark):
    res = read_results_dir(spark, RESULTS)
    assert res.count() == 15
    g = {r["dataset"]: r for r in R.group_mean(res, ["dataset"], ("accuracy", "macro_f1", "weighted_f1")).collect()}
    assert round(g["Basic_processing"]["weighted_f1"], 6) == 0.737569
    assert round(g["Basic_processing_spelling_lem_SP"]["macro_f1"], 6) == 0.615105
    d = {r["dataset"]: r["delta"] for r in R.baseline_delta(
        R.group_mean(res, ["model", "dataset"], ("weighted_f1",)), "Basic_processing").collect()}
    assert round(d["Basic_processing_spelling_lem_SP"], 6) == -0.047506
    s = {r["model_seed"]: r for r in R.group_mean_std(res, ["model_seed"], ["weighted_f1"]).collect()}
    assert round(s[42]["weighted_f1_mean"], 6) == 0.722935 and round(s[42]["weighted_f1_std"], 6) == 0.021369


def test_calendar_lags_general_equals_dense(spark):
    from marketlex.plans.views import v_panel
    p = v_panel(spark, "/root/testdata/sf0.001")
    cols = ["n_urgent"]
    a = market.calendar_lags(p, cols, 3).select("company", "date", "n_urgent_lag_1", "n_urgent_lag_3")
    b = market.calendar_lags(p, cols, 3, dense=True).select("company", "date", "n_urgent_lag_1", "n_urgent_lag_3")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_calendar_lags_take_the_first_row_of_a_day(spark):
    import datetime
    d = datetime.date(2024, 1, 1)
    rows = [("c", d, 2, 9.0, True), ("c", d, 1, 5.0, True), ("c", d + datetime.timedelta(1), 3, None, True), ("c", d + datetime.timedelta(1), 4, 7.0, True),
            ("c", d + datetime.timedelta(2), 5, 1.0, True), ("c", d + datetime.timedelta(3), 6, None, False)]
    df = spark.createDataFrame(rows, "company string, date date, k int, v double, is_trading_day boolean")
    got = {r["k"]: (r["v_lag_1"], r["v_lag_2"]) for r in market.calendar_lags(df, ["v"], 2, order="k").collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (5.0, None), 4: (5.0, None), 5: (None, 5.0)}
    kept = market.calendar_lags(df, ["v"], 2, order="k", keep_calendar=True)
    assert kept.count() == 6 and kept.where("k = 6").first()["v_lag_1"] is None


def test_chronological_split_sizes(spark):
    from marketlex.plans.views import v_ohlc
    o = v_ohlc(spark, "/root/testdata/sf0.001")
    s = market.chronological_split(o, ["date", "company"], F.year("date"))
    n = o.count()
    c = {r["part"]: r["count"] for r in s.groupBy("part").count().collect()}
    assert c["train"] == int(n * 0.7) and c["valid"] == int(n * 0.1)
    last_train = s.filter("part = 'train'").agg(F.max("date")).first()[0]
    first_test = s.filter("part = 'test'").agg(F.min("date")).first()[0]
    assert last_train <= first_test
