"""Series cut into segments give what windows over whole series give."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from marketlex.operators import causality, market, segments

START = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rnd = random.Random(3)
    rows = []
    for company, n in (("a", 700), ("b", 90), (None, 300), ("one", 1)):
        day = START
        for k in range(n):
            day += datetime.timedelta(days=rnd.choice([1, 1, 1, 3, 45]))  # some months have no row, some one
            v = lambda: None if rnd.random() < 0.15 else rnd.uniform(1, 9)
            rows.append((company, day, v(), v(), v(), v(), rnd.choice([None, 1, 2])))
    df = spark.createDataFrame(rows, "company string, date date, open double, high double, low double, close double, ret0 int")
    return df.repartition(6).cache()


def same_rows(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("segment", [lambda: segments.month("date"), lambda: F.year("date"), lambda: F.col("date")], ids=["month", "year", "day"])
def test_equal_to_windows(panel, segment):
    segment = segment()
    same_rows(market.price_features(panel, segment=segment), market.price_features(panel))
    same_rows(market.row_lags(panel, ["open", "close"], 7, segment=segment), market.row_lags(panel, ["open", "close"], 7))


def test_granger_equal_to_windows(spark):
    rnd = random.Random(5)
    rows = [("k" if i % 2 else "m", START + datetime.timedelta(days=i), rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "company string, date date, y0 double, x0 double")
    key = lambda r: (r.company, r.lag)
    a = sorted(causality.granger_rowlag(df, ["y0"], ["x0"]).collect(), key=key)
    b = sorted(causality.granger_rowlag(df, ["y0"], ["x0"], segment=segments.month("date")).collect(), key=key)
    assert len(a) == 10
    for p, q in zip(a, b):
        assert key(p) == key(q) and p.n == q.n and abs(p.f_stat - q.f_stat) < 1e-9 and abs(p.p_value - q.p_value) < 1e-12


def test_one_series_is_spread_over_tasks(spark):
    df = spark.range(50_000).selectExpr("'a' AS company", "id", "cast(id as double) AS v").repartition(4)
    out = segments.lags(df, [("v", 3, "v3")], ["company"], ["id"], F.floor(F.col("id") / 500))
    assert out.where("id >= 3 and v3 <> v - 3").count() == 0 and out.where("v3 is null").count() == 3
    parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) > 1 and max(parts) < 50_000


def test_null_segments_come_first(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("a", 40, None), ("a", 41, 5.0)], "k string, t int, v double")
    out = segments.lags(df, [("v", 1, "v1"), ("v", 2, "v2")], ["k"], ["t"], F.floor(F.col("t") / 10))
    assert [(r.t, r.v1, r.v2) for r in out.orderBy(F.col("t").asc_nulls_first()).collect()] == [(None, None, None), (1, 1.0, None), (2, 2.0, 1.0), (40, 3.0, 2.0), (41, None, 3.0)]
    filled = segments.carried(df, "v", "f", ["k"], ["t"], F.floor(F.col("t") / 10))
    assert [r.f for r in filled.orderBy(F.col("t").asc_nulls_first()).collect()] == [1.0, 2.0, 3.0, 3.0, 5.0]
