"""Statistics against brute force (numpy least squares on collected rows of
a small fixture) and against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlex.functions import stats_math as sm
from marketlex.operators import causality as C
from marketlex.operators import stats as S
from marketlex.plans.views import v_panel

SF = "/root/testdata/sf0.001"
TARGETS = ("ret", "volatility")
SOURCES = ("n_urgent", "avg_price")


@pytest.fixture(scope="module")
def panel(spark):
    p = v_panel(spark, SF)
    return p, p.toPandas().sort_values(["company", "date"]).reset_index(drop=True)


def _ssr(y, X):
    X1 = np.column_stack([np.ones(len(y)), X]) if X.size else np.ones((len(y), 1))
    beta, *_ = np.linalg.lstsq(X1, y, rcond=None)
    e = y - X1 @ beta
    return float(e @ e), beta, e


def test_closed_forms():
    assert math.isclose(sm.f_sf(4.0, 2, 20), 1.4 ** -10, rel_tol=1e-9)
    assert math.isclose(sm.t_sf_two_sided(1.0, 1), 0.5, rel_tol=1e-9)
    assert math.isclose(sm.t_sf_two_sided(1.0, 2), 1 - 1 / math.sqrt(3), rel_tol=1e-9)
    assert math.isclose(sm.chi2_sf(3.0, 2), math.exp(-1.5), rel_tol=1e-9)
    assert math.isclose(sm.chi2_sf(18.307, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(sm.chi2_sf(3.841, 1), 0.05, abs_tol=1e-4)
    assert math.isclose(sm.f_sf(4.35, 1, 20), 0.05, abs_tol=2e-4)


def _granger_brute(pdf, maxlag):
    out = {}
    for c, grp in pdf.groupby("company"):
        for t in TARGETS:
            for s in SOURCES:
                d = grp[[t, s]].dropna()
                y, x = d[t].to_numpy(float), d[s].to_numpy(float)
                for p in range(1, maxlag + 1):
                    Y = y[p:]
                    n = len(Y)
                    if n < 2 * p + 5 or n - (2 * p + 1) <= 0:
                        continue
                    yl = np.column_stack([y[p - i:len(y) - i] for i in range(1, p + 1)])
                    xl = np.column_stack([x[p - i:len(x) - i] for i in range(1, p + 1)])
                    rr, *_ = _ssr(Y, yl)
                    ru, *_ = _ssr(Y, np.column_stack([yl, xl]))
                    dfd = n - (2 * p + 1)
                    f = ((rr - ru) / p) / (ru / dfd)
                    out[(c, t, s, p)] = (n, rr, ru, f, float(sm.f_sf(f, p, dfd)))
    return out


def test_granger_rowlag_matches_least_squares(spark, panel):
    p, pdf = panel
    got = {(r["company"], r["target"], r["source"], r["lag"]): r
           for r in C.granger_rowlag(p, TARGETS, SOURCES, maxlag=4).collect()}
    want = _granger_brute(pdf, 4)
    assert set(got) == set(want) and want
    for k, (n, rr, ru, f, pv) in want.items():
        g = got[k]
        assert g["n"] == n
        assert math.isclose(g["rss_r"], rr, rel_tol=1e-7)
        assert math.isclose(g["rss_u"], ru, rel_tol=1e-7)
        assert math.isclose(g["f_stat"], f, rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(g["p_value"], pv, rel_tol=1e-6, abs_tol=1e-12)


def test_ols_matches_least_squares(spark, panel):
    p, pdf = panel
    got = {r["company"]: r for r in S.ols(p, ["company"], "ret", ["n_urgent", "avg_price"]).collect()}
    for c, grp in pdf.groupby("company"):
        d = grp[["ret", "n_urgent", "avg_price"]].dropna()
        y, X = d["ret"].to_numpy(float), d[["n_urgent", "avg_price"]].to_numpy(float)
        ssr, beta, _ = _ssr(y, X)
        n = len(y)
        X1 = np.column_stack([np.ones(n), X])
        cov = ssr / (n - 3) * np.linalg.inv(X1.T @ X1)
        t = beta / np.sqrt(np.diag(cov))
        pv = sm.t_sf_two_sided(t, n - 3)
        g = got[c]
        assert g["n"] == n
        assert np.allclose(g["coef"], beta[1:], rtol=1e-6)
        assert math.isclose(g["intercept"], beta[0], rel_tol=1e-6, abs_tol=1e-12)
        assert np.allclose(g["p_values"], pv, rtol=1e-5, atol=1e-10)
        assert math.isclose(g["ssr"], ssr, rel_tol=1e-7)


def _levene(a, b):
    za, zb = np.abs(a - np.median(a)), np.abs(b - np.median(b))
    N = len(a) + len(b)
    zbar = np.concatenate([za, zb]).mean()
    num = len(a) * (za.mean() - zbar) ** 2 + len(b) * (zb.mean() - zbar) ** 2
    den = ((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum()
    w = (N - 2) * num / den
    return float(sm.f_sf(w, 1, N - 2))


def test_ols_screen_matches_brute_force(spark, panel):
    p, pdf = panel
    got = {(r["company"], r["stock_variable"], r["tweet_variable"]): r
           for r in S.ols_screen(p, TARGETS, SOURCES, ["company"]).collect()}
    for c, grp in pdf.groupby("company"):
        for t in TARGETS:
            for s in SOURCES:
                d = grp[[t, s]].dropna()
                x, y = d[s].to_numpy(float), d[t].to_numpy(float)
                z = np.abs((x - x.mean()) / x.std())
                keep = z < 3
                xk, yk = x[keep], y[keep]
                ssr, beta, e = _ssr(yk, xk.reshape(-1, 1))
                n = len(yk)
                r2 = 1 - ssr / ((yk - yk.mean()) ** 2).sum()
                se = math.sqrt(ssr / (n - 2) / ((xk - xk.mean()) ** 2).sum())
                pv = float(sm.t_sf_two_sided(beta[1] / se, n - 2))
                m = e - e.mean()
                sk = (m ** 3).mean() / (m ** 2).mean() ** 1.5
                ku = (m ** 4).mean() / (m ** 2).mean() ** 2 - 3
                _, pn = sm.normaltest_k2(sk, ku, n)
                dw = (np.diff(e) ** 2).sum() / (e ** 2).sum()
                g = got[(c, t, s)]
                assert g["sample_size"] == n and g["outliers_removed"] == len(x) - n
                assert abs(g["r_squared"] - round(r2, 3)) <= 1.01e-3
                assert abs(g["coefficient"] - round(beta[1], 3)) <= 1.01e-3
                assert abs(g["p_value"] - round(pv, 5)) <= 1.01e-5
                assert abs(g["normality_p"] - round(float(pn), 5)) <= 1.01e-5
                assert abs(g["homoscedasticity_p"] - round(_levene(xk, e), 5)) <= 1.01e-5
                assert abs(g["durbin_watson"] - round(dw, 3)) <= 1.01e-3
                assert g["vif"] == 1.0


def test_residual_diagnostics_match_direct_formulas(spark, panel):
    p, pdf = panel
    got = {(r["company"], r["source"], r["lag"], r["model"]): r
           for r in C.residual_diagnostics(p, ["ret"], ["n_urgent"], maxlag=2).collect()}
    for c, grp in pdf.groupby("company"):
        d = grp[["ret", "n_urgent"]].dropna()
        y, x = d["ret"].to_numpy(float), d["n_urgent"].to_numpy(float)
        for lag in (1, 2):
            Y = y[lag:]
            yl = np.column_stack([y[lag - i:len(y) - i] for i in range(1, lag + 1)])
            xl = np.column_stack([x[lag - i:len(x) - i] for i in range(1, lag + 1)])
            for model, X in (("restricted", yl), ("unrestricted", np.column_stack([yl, xl]))):
                _, _, e = _ssr(Y, X)
                n = len(e)
                h = min(10, n - 1)
                m = e - e.mean()
                den = (m ** 2).sum()
                q = sum((np.sum(m[k:] * m[:-k]) / den) ** 2 / (n - k) for k in range(1, h + 1))
                lb = n * (n + 2) * q
                qa = min(10, n // 5)
                e2 = e ** 2
                Ya = e2[qa:]
                Xa = np.column_stack([e2[qa - i:len(e2) - i] for i in range(1, qa + 1)])
                ssr_a, _, _ = _ssr(Ya, Xa)
                r2 = 1 - ssr_a / ((Ya - Ya.mean()) ** 2).sum()
                g = got[(c, "n_urgent", lag, model)]
                assert math.isclose(g["lb_stat"], lb, rel_tol=1e-6)
                assert math.isclose(g["arch_lm"], len(Ya) * r2, rel_tol=1e-5, abs_tol=1e-9)
                assert math.isclose(g["lb_pvalue"], float(sm.chi2_sf(lb, h)), rel_tol=1e-6, abs_tol=1e-12)


def test_bootstrap_properties(spark, panel):
    p, _ = panel
    p = p.filter("is_trading_day")
    a = C.granger_bootstrap(p, ["ret"], ["n_urgent"], maxlag=2, B=12, block_size=5, seed=3).collect()
    b = C.granger_bootstrap(p, ["ret"], ["n_urgent"], maxlag=2, B=12, block_size=5, seed=3).collect()
    key = lambda r: (r["company"], r["lag_order"])
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    obs = {(r["company"], r["lag"]): r["f_stat"] for r in
           C.granger_rowlag(p, ["ret"], ["n_urgent"], maxlag=2).collect()}
    for r in a:
        assert r["n_valid"] == 12 == len(r["boot_f_stats"])
        assert r["count_exceeds"] == sum(f >= r["f_actual"] for f in r["boot_f_stats"])
        assert math.isclose(r["p_value"], r["count_exceeds"] / 12)
        # ret and n_urgent are complete on trading days, so lagging before or after the drop agrees
        assert key(r) in obs


def test_bootstrap_skips_replicates_with_gaps(spark):
    """A source gap that the shuffle moves onto a fitted row spoils the
    replicate; replicates match a refit of every shuffled series."""
    import datetime
    from marketlex.operators.sampling import block_shuffle
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=60), rng.normal(size=60)
    rows = [("c", datetime.date(2020, 1, 1) + datetime.timedelta(days=k), float(y[k]), None if k == 20 else float(x[k])) for k in range(60)]
    p = spark.createDataFrame(rows, "company string, date date, t double, s double")
    got = {r["lag_order"]: r for r in C.granger_bootstrap(p, ["t"], ["s"], maxlag=2, B=15, block_size=7, seed=2).collect()}
    xs = spark.createDataFrame([("c", "t", "s", r, k + 1, rows[k][3]) for r in range(15) for k in range(60)],
                               "company string, target string, source string, rep int, _pos long, x double")
    order = block_shuffle(xs, ["company", "target", "source"], "_pos", 7, 2, rep="rep").toPandas()
    full = np.array([np.nan if r[3] is None else r[3] for r in rows])
    for lag in (1, 2):
        at = [k for k in range(lag, 60) if not any(np.isnan(full[k - i]) for i in range(1, lag + 1))]
        own = np.array([[y[k - i] for i in range(1, lag + 1)] for k in at])
        ssr_r, _, _ = _ssr(y[at], own)
        want = []
        for rep in range(15):
            s = order[order.rep == rep].sort_values("new_pos").x.to_numpy(float)
            z = np.array([[s[k - i] for i in range(1, lag + 1)] for k in at])
            if not np.isnan(z).any():
                ssr_u, _, _ = _ssr(y[at], np.hstack([own, z]))
                want.append((ssr_r - ssr_u) / lag / (ssr_u / (len(at) - 2 * lag - 1)))
        assert got[lag]["n_valid"] == len(want) < 15
        assert np.allclose(got[lag]["boot_f_stats"], want, rtol=1e-6)


def test_vif_matches_auxiliary_regressions(spark):
    from marketlex.operators.stats import vif
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=80), rng.normal(size=80)
    c = a + 0.3 * b + 0.1 * rng.normal(size=80)
    df = spark.createDataFrame([("g", *map(float, r)) for r in zip(a, b, c)], "g string, a double, b double, c double")
    got = {r["variable"]: r["vif"] for r in vif(df, ["g"], ["a", "b", "c"]).collect()}
    data = {"a": a, "b": b, "c": c}
    for v in data:
        ssr, _, _ = _ssr(data[v], np.column_stack([data[o] for o in data if o != v]))
        assert math.isclose(got[v], ((data[v] - data[v].mean()) ** 2).sum() / ssr, rel_tol=1e-8)


def test_best_subset_matches_brute_force(spark, panel):
    from itertools import combinations
    p, pdf = panel
    srcs = ("n_urgent", "n_low", "avg_price")
    got = {}
    for r in C.best_subset(p, ["ret"], srcs, ["company"], 3).collect():
        got.setdefault(r["company"], r)
    for c, grp in pdf.groupby("company"):
        best, combo = 0.0, None
        for k in (1, 2, 3):
            for cb in combinations(srcs, k):
                d = grp[["ret", *cb]].dropna()
                X = d[list(cb)].to_numpy(float)
                z = np.abs((X - X.mean(0)) / X.std(0))
                keep = (z < 3).all(1)
                ssr, _, _ = _ssr(d["ret"].to_numpy(float)[keep], X[keep])
                yk = d["ret"].to_numpy(float)[keep]
                r2 = 1 - ssr / ((yk - yk.mean()) ** 2).sum()
                if r2 > best:
                    best, combo = r2, cb
        assert tuple(got[c]["combination"]) == combo
        assert abs(got[c]["r_squared"] - round(best, 3)) <= 1.01e-3


def test_select_lags_picks_top_two(spark, panel):
    from marketlex.operators import market
    p, _ = panel
    lagged = market.row_lags(p, ["n_urgent"], 5)
    rows = C.select_lags(lagged, "ret", ["n_urgent"], 5, keys=["company"]).collect()
    for c in {r["company"] for r in rows}:
        rs = sorted([r for r in rows if r["company"] == c], key=lambda r: -r["mean_mi"])
        assert [r["selected"] for r in rs] == [True, True, False, False, False]
        assert all(r["mean_mi"] >= 0 for r in rs)


def test_rank_percentiles_match_numpy(spark):
    """Ties, a hot value, one-row groups, nulls, a null key and a group
    without values; no group is buffered."""
    from marketlex.operators.ordering import rank_percentiles
    rng = np.random.default_rng(9)
    rows = [("a", float(v)) for v in rng.normal(size=400)] + [("b", 3.0)] * 300 + [("b", float(v)) for v in rng.integers(0, 9, 60)]
    rows += [("c", 7.5), ("d", None), ("a", None), (None, 1.0), (None, 2.0)] + [("e", float(v)) for v in 10 ** rng.uniform(-3, 9, 200)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    ps = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {r["k"]: r["_p"] for r in rank_percentiles(df, "v", ps, ["k"]).collect()}
    assert set(got) == {"a", "b", "c", "e", None}
    for k, p in got.items():
        assert np.allclose(p, np.quantile([v for x, v in rows if x == k and v is not None], ps), rtol=1e-12)
    everything = rank_percentiles(df, "v", ps).collect()
    assert len(everything) == 1 and np.allclose(everything[0]["_p"], np.quantile([v for _, v in rows if v is not None], ps), rtol=1e-12)
    assert rank_percentiles(df.limit(0), "v", ps, ["k"]).collect() == []


def test_best_subset_of_twelve_sources(spark):
    from itertools import combinations
    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(size=(n, 12))
    x[rng.random((n, 12)) < 0.01] = 9.0                  # outliers
    x[rng.random((n, 12)) < 0.02] = np.nan
    y = np.stack([2 * x[:, 3] - x[:, 7] + rng.normal(size=n), x[:, 11] + rng.normal(size=n), rng.normal(size=n)], axis=1)
    y[rng.random((n, 3)) < 0.05] = np.nan
    names, ys = [f"s{j}" for j in range(12)], ["t0", "t1", "t2"]
    value = lambda v: None if np.isnan(v) else float(v)
    rows = [(None if i % 2 else "k", *[value(v) for v in y[i]], *[value(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "company string, " + ", ".join(f"{c} double" for c in ys + names))
    got = {}
    for r in C.best_subset(df, ys, names, ["company"], 2, chunk=60).collect():
        got.setdefault((r.company, r.stock_variable), {})[r.feature] = r
    assert len(got) == 6
    for half, key in ((0, "k"), (1, None)):
        for t in range(3):
            best, combo = 0.0, None
            for size in (1, 2):
                for cb in combinations(range(12), size):
                    ok = ~np.isnan(y[:, t]) & ~np.isnan(x[:, cb]).any(axis=1) & (np.arange(n) % 2 == half)
                    X, Y = x[ok][:, cb], y[ok, t]
                    keep = (np.abs((X - X.mean(0)) / X.std(0)) < 3).all(1)
                    X, Y = np.column_stack([np.ones(keep.sum()), X[keep]]), Y[keep]
                    beta = np.linalg.lstsq(X, Y, rcond=None)[0]
                    r2 = 1 - ((Y - X @ beta) ** 2).sum() / ((Y - Y.mean()) ** 2).sum()
                    if r2 > best:
                        best, combo, coef = r2, cb, beta
            r = got[key, ys[t]]
            assert sorted(r) == sorted(names[j] for j in combo)
            for j, b in zip(combo, coef[1:]):
                assert abs(r[names[j]].r_squared - best) < 6e-4 and abs(r[names[j]].coefficient - b) < 1e-8


def test_best_subset_does_not_copy_rows(spark):
    from marketlex.operators import subset
    p = subset.Pairs(1, 3, 3)
    rows = spark.range(5000).selectExpr("cast(id % 17 as double) _y0", "cast(id % 5 as double) _x0", "cast(id % 7 as double) _x1", "cast(id % 11 as double) _x2")
    masks = subset.mask_moments(rows, p, [], ["_y0"], ["_x0", "_x1", "_x2"], 3.0, 1000).collect()
    assert len(masks) == 1 and masks[0].n == 5000       # no gaps, no outliers: one mask
