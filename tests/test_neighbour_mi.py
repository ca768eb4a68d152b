"""The nearest-neighbour estimator against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlex.operators import neighbour_mi as M


def psi(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, int(n)))


def brute(x, y, k=3):
    n = len(x)
    dx, dy = (np.abs(v[:, None] - v) / (v.std() if v.std() > 0 else 1.0) for v in (x, y))
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    eps = np.maximum(np.sort(d, axis=1)[:, k - 1], 5e-324)
    nx, ny = ((v < eps[:, None]).sum(axis=1) - 1 for v in (dx, dy))
    return max(0.0, psi(n) + psi(k) - np.mean([psi(a + 1) + psi(b + 1) for a, b in zip(nx, ny)]))


def series(kind, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    y = 0.7 * x + rng.normal(size=n)
    if kind == "ties":
        x, y = np.round(x, 1), np.round(y, 1)
        x[: n // 3], y[: n // 3] = 0.0, 0.5           # a third of the points are one
    if kind == "hot_x":
        x[: n // 2] = 0.0                             # half the points share x
    if kind == "tails":
        x = np.sign(x) * np.abs(x) ** 5
    if kind == "constant":
        x[:] = 3.0
    if kind == "counts":
        x, y = rng.poisson(2, n).astype(float), rng.poisson(1, n).astype(float)
    return x, y


KINDS = ["normal", "ties", "hot_x", "tails", "constant", "counts"]


@pytest.mark.parametrize("tile", [40, 100_000])
def test_equals_brute_force(spark, tile):
    rows, want = [], {}
    for j, kind in enumerate(KINDS):
        for company in ("a", None):
            x, y = series(kind, 260 + 30 * j, j + (7 if company else 0))
            want[company, kind] = brute(x, y)
            rows += [(company, kind, float(a), float(b)) for a, b in zip(x, y)]
            rows += [(company, kind, None, 1.0), (company, kind, float("nan"), 1.0), (company, kind, 1.0, float("inf"))]
    rows += [("few", "normal", 1.0, 2.0)] * 3
    df = spark.createDataFrame(rows, "company string, kind string, v_lag_1 double, y double").repartition(5)
    got = {(r.company, r.kind): r for r in M.neighbour_information(df, "y", ["v"], 1, ["company", "kind"], tile=tile).collect()}
    assert len(got) == len(want) + 1 and got["few", "normal"].mi is None and got["few", "normal"].n == 3
    for key, v in want.items():
        assert abs(got[key].mi - v) < 1e-9, key


def test_tile_search_equals_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 700):
        pts = np.unique(np.round(rng.normal(size=(n, 2)), 2), axis=0)
        m = rng.integers(1, 5, len(pts))
        q = np.round(rng.normal(size=(90, 2)), 2)
        best = M.Tile(pts[:, 0], pts[:, 1], m).nearest(q[:, 0], q[:, 1], np.full((90, 3), np.inf))
        d = np.repeat(np.abs(q[:, None] - pts[None]).max(axis=2), m, axis=1)
        want = np.sort(np.concatenate([d, np.full((90, 3), np.inf)], axis=1), axis=1)[:, :3]
        assert (best == want).all()


def test_ends_of_intervals_follow_the_rounded_difference():
    rng = np.random.default_rng(1)
    v = np.unique(np.round(rng.normal(size=300), 2))
    x = v[rng.integers(0, len(v), 500)]
    eps = np.abs(x - v[rng.integers(0, len(v), 500)])
    eps = np.maximum(eps, M.TINY)
    assert (M.within(v, x, eps) == (v[None] - x[:, None] < eps[:, None]).sum(axis=1)).all()
    assert (M.beyond(v, x, eps) == (x[:, None] - v[None] >= eps[:, None]).sum(axis=1)).all()


def test_digamma(spark):
    got = [r[0] for r in spark.range(1, 400).select(M.digamma(F.col("id"))).collect()]
    assert np.allclose(got, [psi(n) for n in range(1, 400)], atol=1e-11)


def test_one_series_is_many_tiles_of_bounded_size(spark):
    x, y = series("hot_x", 2000, 5)
    pts = spark.createDataFrame([(1, float(a), float(b)) for a, b in {*zip(x, y)}], "g long, x double, y double")
    sizes = [r["count"] for r in M.cut(pts, ["g", "x", "y"], 64, "c").groupBy("c").count().collect()]
    assert max(sizes) <= 64 and len(sizes) >= 2000 // 64


def test_lags_ranked_and_empty_table(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=500)
    y = np.concatenate([np.zeros(3), v[:-3]]) + 0.1 * rng.normal(size=500)   # y follows v three rows later
    rows = [(float(y[i]), *[float(v[i - l]) for l in range(1, 6)]) for i in range(5, 500)]
    names = "y double, " + ", ".join(f"v_lag_{l} double" for l in range(1, 6))
    got = M.select_lags_by_neighbours(spark.createDataFrame(rows, names), "y", ["v"], 5, 1).collect()
    assert [r.lag for r in got if r.selected] == [3]
    assert M.select_lags_by_neighbours(spark.createDataFrame([], names), "y", ["v"], 5).count() == 0
