"""Granger causality, block bootstrap, residual diagnostics and lag
selection (G9-G15, A12); best-subset regression is in ``subset``.

Every test is a grouped aggregation: rows are turned into lagged design
columns with one window per series, exploded over lag orders (and
bootstrap replicates), reduced to per-group moments on Spark, and only
those small tables are solved in Arrow batches.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlex.functions import stats_math as sm
from marketlex.operators import segments
from marketlex.operators.ordering import global_row_number, same
from marketlex.operators.sampling import block_shuffle
from marketlex.operators.stats import long_pairs, moments, pvalues
from marketlex.operators.subset import best_subset  # noqa: F401


def _yl(i):
    return f"_yl{i}"


def _xl(i):
    return f"_xl{i}"


def _complete_for_lag(maxlag: int, lag_col: str = "lag"):
    """Row condition: y and the first ``lag`` y/x lags are all present."""
    cond = F.col("y").isNotNull()
    for i in range(1, maxlag + 1):
        cond = cond & ((F.col(lag_col) < i) | (F.col(_yl(i)).isNotNull() & F.col(_xl(i)).isNotNull()))
    return cond


def _stratum(maxlag: int):
    """The largest lag order a row is complete for: orders are nested, so a
    row counts for every order up to its stratum."""
    out = F.lit(maxlag)
    for i in range(maxlag, 0, -1):
        out = F.when(F.col(_yl(i)).isNull() | F.col(_xl(i)).isNull(), F.lit(i - 1)).otherwise(out)
    return F.when(F.col("y").isNull(), F.lit(0)).otherwise(out)


def _names(maxlag: int):
    return ["y"] + [_yl(i) for i in range(1, maxlag + 1)] + [_xl(i) for i in range(1, maxlag + 1)]


def _shifted(c: str):
    """Value less its series minimum (safe raw sums); lags beyond the row's
    stratum may be missing and never enter a fit of that row's orders."""
    return F.coalesce(F.col(c) - F.col("_sx" if c.startswith("_xl") or c.startswith("_bx") else "_sy"), F.lit(0.0))


def _lag_moments(lagged: DataFrame, g: Sequence[str], maxlag: int) -> DataFrame:
    """One row per group with ``parts``: raw sums and products of every
    stratum.  Each input row is aggregated once, whatever ``maxlag`` is."""
    names = _names(maxlag)
    k = len(names)
    d = lagged.select(*g, "_sy", "_sx", _stratum(maxlag).alias("s"), *[_shifted(c).alias(c) for c in names]).filter("s > 0")
    agg = d.groupBy(*g, "_sy", "_sx", "s").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"__s{i}") for i, c in enumerate(names)],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"__q{i}_{j}") for i in range(k) for j in range(i, k)])
    part = F.struct("s", "n", F.array(*[f"__s{i}" for i in range(k)]).alias("sum"),
                    F.array(*[f"__q{i}_{j}" for i in range(k) for j in range(i, k)]).alias("prod"))
    return agg.groupBy(*g, "_sy", "_sx").agg(F.collect_list(part).alias("parts"))  # at most maxlag parts


def _stack(parts_column, maxlag: int):
    """Totals by lag order of a batch of groups: n (G, p), sums (G, p, k) and
    product matrices (G, p, k, k); order p takes the strata from p on."""
    k = 2 * maxlag + 1
    iu = np.triu_indices(k)
    n = np.zeros((len(parts_column), maxlag))
    sums, prods = np.zeros((len(n), maxlag, k)), np.zeros((len(n), maxlag, k, k))
    for r, parts in enumerate(parts_column):
        for part in parts:
            at = part["s"] - 1
            n[r, at], sums[r, at] = part["n"], part["sum"]
            prods[r, at][iu] = part["prod"]
    prods = prods + np.transpose(np.triu(prods, 1), (0, 1, 3, 2))
    return tuple(np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (n, sums, prods))


def _fit(n, sums, prods, x_idx):
    """Batched least squares of column 0 on ``x_idx`` with intercept:
    (rss, coef, means); NaN where there are no rows."""
    with np.errstate(all="ignore"):
        mean = sums / n[:, None]
        cov = prods - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    good = np.isfinite(cov).all(axis=(1, 2)) & (n > 0)
    rss, coef = np.full(len(n), np.nan), np.full((len(n), len(x_idx)), np.nan)
    if good.any():
        c = cov[good]
        sxx, sxy = c[:, x_idx][:, :, x_idx], c[:, x_idx, 0]
        # unit diagonal: columns of very different size lose no digits
        scale = np.sqrt(np.einsum("gii->gi", sxx))
        scale = np.where(scale > 0, scale, 1.0)
        b = np.einsum("gij,gj->gi", np.linalg.pinv(sxx / (scale[:, :, None] * scale[:, None, :]), rcond=1e-13, hermitian=True), sxy / scale) / scale
        coef[good] = b
        rss[good] = np.maximum(c[:, 0, 0] - (sxy * b).sum(axis=1), 0.0)
    return rss, coef, mean


def _orders(maxlag: int, p: int):
    return list(range(1, p + 1)), list(range(1, p + 1)) + list(range(maxlag + 1, maxlag + 1 + p))


GRANGER_FIELDS = [
    T.StructField("lag", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("rss_r", T.DoubleType()), T.StructField("rss_u", T.DoubleType()),
    T.StructField("df_num", T.IntegerType()), T.StructField("df_den", T.LongType()),
    T.StructField("f_stat", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
    T.StructField("icpt_r", T.DoubleType()), T.StructField("coef_r", T.ArrayType(T.DoubleType())),
    T.StructField("icpt_u", T.DoubleType()), T.StructField("coef_u", T.ArrayType(T.DoubleType())),
]


def _solve_granger(st: DataFrame, g: Sequence[str], maxlag: int) -> DataFrame:
    """Restricted (y lags) and unrestricted (y and x lags) fits of every
    (group, lag order) with n >= 2p + 5 and a positive denominator dof."""
    out = T.StructType([st.schema[c] for c in g] + GRANGER_FIELDS)

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            n_all, sums, prods = _stack(pdf["parts"], maxlag)
            shift = np.concatenate([np.repeat(pdf[["_sy"]].to_numpy(float), maxlag + 1, axis=1),
                                    np.repeat(pdf[["_sx"]].to_numpy(float), maxlag, axis=1)], axis=1)
            for p in range(1, maxlag + 1):
                ridx, uidx = _orders(maxlag, p)
                n = n_all[:, p - 1]
                rss_r, coef_r, mean = _fit(n, sums[:, p - 1], prods[:, p - 1], ridx)
                rss_u, coef_u, _ = _fit(n, sums[:, p - 1], prods[:, p - 1], uidx)
                mean = mean + shift
                den = n - (2 * p + 1)
                with np.errstate(all="ignore"):
                    f = np.where(rss_u > 0, (rss_r - rss_u) / p / (rss_u / den), np.nan)
                    pv = np.where(np.isfinite(f), sm.f_sf(f, float(p), den), np.nan)
                o = pdf[list(g)].copy()
                o["lag"], o["n"], o["rss_r"], o["rss_u"] = p, n.astype(np.int64), rss_r, rss_u
                o["df_num"], o["df_den"], o["f_stat"], o["p_value"] = p, den.astype(np.int64), f, pv
                o["icpt_r"], o["coef_r"] = mean[:, 0] - (mean[:, ridx] * coef_r).sum(axis=1), list(coef_r)
                o["icpt_u"], o["coef_u"] = mean[:, 0] - (mean[:, uidx] * coef_u).sum(axis=1), list(coef_u)
                yield o[(n >= 2 * p + 5) & (den > 0) & np.isfinite(rss_u)]
    return st.mapInPandas(solve, out)


def _granger_fits(lagged: DataFrame, g: Sequence[str], maxlag: int) -> DataFrame:
    return _solve_granger(_lag_moments(lagged, g, maxlag), g, maxlag)


def _rows_by_order(lagged: DataFrame, maxlag: int) -> DataFrame:
    """The complete rows of every lag order."""
    ex = lagged.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(maxlag))))
    return ex.filter(_complete_for_lag(maxlag))


def granger_rowlag(df: DataFrame, targets: Sequence[str], sources: Sequence[str],
                   keys: Sequence[str] = ("company",), order_col: str = "date",
                   maxlag: int = 5, with_fits: bool = False, segment: Column | None = None) -> DataFrame:
    """For every key x target x source x lag order p in 1..maxlag:
    drop rows where the pair is incomplete, build row lags, keep rows with
    all p lags, require n >= 2p + 5 and a positive denominator dof, and
    compare y ~ y lags against y ~ y lags + x lags with an F test.  With
    ``segment``, an expression over ``order_col``, a series may be longer than
    a task can hold (see ``segments``)."""
    g = [*keys, "target", "source"]
    lp = long_pairs(df, keys, order_col, targets, sources).dropna(subset=["y", "x"])
    lagged = _lag_series(lp, g, order_col, maxlag, segment=segment)
    fits = _granger_fits(lagged, g, maxlag)
    return fits if with_fits else fits.drop("icpt_r", "coef_r", "icpt_u", "coef_u")


def _lag_series(lp: DataFrame, g: Sequence[str], order_col: str, maxlag: int, keep=(), segment: Column | None = None) -> DataFrame:
    """Row lags of y and x per series plus the series minima used as
    shifts -- all from one window partitioning (one shuffle); with ``segment``
    from windows over segments and an aggregate."""
    if segment is not None:
        least = lp.groupBy(*g).agg(F.coalesce(F.min("y"), F.lit(0.0)).alias("_sy"), F.coalesce(F.min("x"), F.lit(0.0)).alias("_sx"))
        wanted = [(c, i, name(i)) for c, name in (("y", _yl), ("x", _xl)) for i in range(1, maxlag + 1)]
        lagged = segments.lags(lp.select(*g, order_col, *dict.fromkeys([*keep, "y", "x"])), wanted, g, [order_col], segment)
        out = lagged.alias("l").join(least.alias("m"), same("l", "m", g)).select("l.*", "_sy", "_sx")
        return out.select(*g, order_col, *keep, "y", *[n for _, _, n in wanted], "_sy", "_sx")
    w = Window.partitionBy(*g).orderBy(order_col)
    wg = Window.partitionBy(*g)
    return lp.select(*g, order_col, *keep, "y",
                     *[F.lag("y", i).over(w).alias(_yl(i)) for i in range(1, maxlag + 1)],
                     *[F.lag("x", i).over(w).alias(_xl(i)) for i in range(1, maxlag + 1)],
                     F.coalesce(F.min("y").over(wg), F.lit(0.0)).alias("_sy"),
                     F.coalesce(F.min("x").over(wg), F.lit(0.0)).alias("_sx"))


def granger_calendarlag(df: DataFrame, targets: Sequence[str], sources: Sequence[str],
                        keys: Sequence[str] = ("company",), order_col: str = "date",
                        maxlag: int = 5) -> DataFrame:
    """As G9, but the source lags are the precomputed calendar lags
    ``{source}_lag_{i}`` of J4's trading-day rows, target lags are row shifts
    over those rows, and incomplete rows are dropped after lagging.  Pairs whose lag
    columns are missing are skipped."""
    have = set(df.columns)
    srcs = [s for s in sources if all(f"{s}_lag_{i}" in have for i in range(1, maxlag + 1))]
    if not srcs:
        raise ValueError("no source has all calendar lag columns")
    w = Window.partitionBy(*keys).orderBy(order_col)
    base = df.select(*keys, order_col, *[F.col(t).cast("double").alias(f"_t{j}") for j, t in enumerate(targets)],
                     *[F.lag(t, i).over(w).cast("double").alias(f"_t{j}l{i}")
                       for j, t in enumerate(targets) for i in range(1, maxlag + 1)],
                     *[F.col(f"{s}_lag_{i}").cast("double").alias(f"_s{j}l{i}")
                       for j, s in enumerate(srcs) for i in range(1, maxlag + 1)],
                     *[F.coalesce(F.min(t).over(Window.partitionBy(*keys)).cast("double"), F.lit(0.0)).alias(f"_t{j}m")
                       for j, t in enumerate(targets)],
                     *[F.coalesce(F.min(f"{s}_lag_1").over(Window.partitionBy(*keys)).cast("double"),
                                  F.lit(0.0)).alias(f"_s{j}m") for j, s in enumerate(srcs)])
    tg = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_t{j}").alias("y"),
                            *[F.col(f"_t{j}l{i}").alias(_yl(i)) for i in range(1, maxlag + 1)],
                            F.col(f"_t{j}m").alias("_sy"))
                   for j, t in enumerate(targets)])
    sc = F.array(*[F.struct(F.lit(s).alias("source"),
                            *[F.col(f"_s{j}l{i}").alias(_xl(i)) for i in range(1, maxlag + 1)],
                            F.col(f"_s{j}m").alias("_sx"))
                   for j, s in enumerate(srcs)])
    d = base.select(*keys, order_col, F.inline(tg), sc.alias("_sc")).select(
        *keys, order_col, "target", "y", *[_yl(i) for i in range(1, maxlag + 1)], "_sy", F.inline("_sc"))
    fits = _granger_fits(d, [*keys, "target", "source"], maxlag)
    return fits.drop("icpt_r", "coef_r", "icpt_u", "coef_u")


# ------------------------------------------------------ residual diagnostics
def residual_diagnostics(df: DataFrame, targets: Sequence[str], sources: Sequence[str],
                         keys: Sequence[str] = ("company",), order_col: str = "date",
                         maxlag: int = 5, alpha: float = 0.05) -> DataFrame:
    """Ljung-Box at min(10, n-1) lags and ARCH-LM at min(10, n // 5)
    lags on the residuals of both Granger models of G9; flags p < alpha."""
    from marketlex.session import materialize
    g = [*keys, "target", "source"]
    lp = long_pairs(df, keys, order_col, targets, sources).dropna(subset=["y", "x"])
    lagged = materialize(_lag_series(lp, g, order_col, maxlag))  # feeds the fits and the residuals
    fits, rows = _granger_fits(lagged, g, maxlag), _rows_by_order(lagged, maxlag)
    j = rows.join(fits.select(*g, "lag", "n", "icpt_r", "coef_r", "icpt_u", "coef_u"), [*g, "lag"])
    def term(coef, idx, col, i):
        return F.when(F.col("lag") >= i, F.try_element_at(coef, idx) * F.col(col)).otherwise(F.lit(0.0))
    fit_r = F.col("icpt_r") + sum((term("coef_r", F.lit(i), _yl(i), i) for i in range(1, maxlag + 1)), F.lit(0.0))
    fit_u = F.col("icpt_u") + sum((term("coef_u", F.lit(i), _yl(i), i) + term("coef_u", F.col("lag") + i, _xl(i), i)
                                   for i in range(1, maxlag + 1)), F.lit(0.0))
    res = j.select(*g, "lag", "n", order_col,
                   F.array(F.struct(F.lit("restricted").alias("model"), (F.col("y") - fit_r).alias("e")),
                           F.struct(F.lit("unrestricted").alias("model"), (F.col("y") - fit_u).alias("e")))
                   .alias("_m"))
    res = res.select(*g, "lag", "n", order_col, F.inline("_m"))
    return residual_tests(res, [*g, "lag", "model"], order_col, "e", alpha)


def residual_tests(res: DataFrame, group: Sequence[str], order_col: str, e: str,
                   alpha: float = 0.05, max_h: int = 10) -> DataFrame:
    """Ljung-Box Q at h = min(max_h, n-1) and ARCH-LM at q = min(max_h, n // 5)
    for each residual series, from lagged products aggregated on Spark."""
    w = Window.partitionBy(*group).orderBy(order_col)
    el = [F.lag(e, k).over(w).alias(f"_el{k}") for k in range(1, max_h + 1)]
    d = res.select(*group, e, *el)
    aggs = [F.count(e).alias("_n"), F.sum(e).alias("_s"), F.sum(F.col(e) * F.col(e)).alias("_ss")]
    for k in range(1, max_h + 1):
        aggs += [F.sum(F.col(e) * F.col(f"_el{k}")).alias(f"_p{k}"),
                 F.sum(F.when(F.col(f"_el{k}").isNotNull(), F.col(e))).alias(f"_a{k}"),
                 F.sum(F.col(f"_el{k}")).alias(f"_b{k}")]
    s = d.groupBy(*group).agg(*aggs)
    n = F.col("_n").cast("double")
    mean = F.col("_s") / n
    den = F.col("_ss") - n * mean * mean
    h = F.least(F.lit(max_h), F.col("_n") - 1)
    q = F.lit(0.0)
    for k in range(1, max_h + 1):
        cov_k = (F.coalesce(F.col(f"_p{k}"), F.lit(0.0)) - mean * (F.coalesce(F.col(f"_a{k}"), F.lit(0.0))
                 + F.coalesce(F.col(f"_b{k}"), F.lit(0.0))) + (n - k) * mean * mean)
        rho = F.try_divide(cov_k, den)
        q = q + F.when(h >= k, rho * rho / (n - k)).otherwise(0.0)
    s = s.withColumn("lb_stat", n * (n + 2) * q).withColumn("lb_df", h.cast("double"))
    # ARCH-LM: e^2 on a constant and q of its own lags
    arch_q = F.least(F.lit(max_h), F.floor(F.col("_n") / 5)).cast("int")
    e2 = res.select(*group, order_col, (F.col(e) * F.col(e)).alias("_e2"))
    e2 = e2.select(*group, "_e2", *[F.lag("_e2", k).over(w).alias(f"_l{k}") for k in range(1, max_h + 1)])
    e2 = e2.join(s.select(*group, arch_q.alias("q_arch")), list(group))
    cond = F.lit(True)
    for k in range(1, max_h + 1):
        cond = cond & ((F.col("q_arch") < k) | F.col(f"_l{k}").isNotNull())
    e2 = e2.filter(cond & (F.col("q_arch") > 0)).select(
        *group, "q_arch", "_e2", *[F.when(F.col("q_arch") >= k, F.col(f"_l{k}")).alias(f"_l{k}") for k in range(1, max_h + 1)])
    st = moments(e2, [*group, "q_arch"], ["_e2"] + [f"_l{k}" for k in range(1, max_h + 1)])
    kk = max_h + 1
    out = T.StructType([st.schema[c] for c in group] + [T.StructField("arch_lm", T.DoubleType()),
                                                        T.StructField("arch_df", T.DoubleType())])
    gcols = list(group)

    def solve(it):
        for pdf in it:
            rows = []
            for dd in pdf.to_dict("records"):
                qq, nn = int(dd["q_arch"]), int(dd["n"])
                mu = np.asarray([np.nan if v is None else v for v in dd["mu"]], float)
                cov = sm.sym_from_upper(list(dd["cov"]), kk)
                fit = sm.ols_from_moments(nn, mu, cov, 0, range(1, qq + 1))
                rows.append({**{c: dd[c] for c in gcols}, "arch_lm": nn * fit["r2"], "arch_df": float(qq)})
            yield pd.DataFrame(rows, columns=out.fieldNames())
    arch = st.mapInPandas(solve, out)
    allst = s.select(*group, "lb_stat", "lb_df").join(arch, list(group), "left")
    allst = pvalues(allst, {"lb_pvalue": ("chi2", "lb_stat", "lb_df"), "arch_pvalue": ("chi2", "arch_lm", "arch_df")})
    return allst.select(*group, "lb_stat", "lb_pvalue", "arch_lm", "arch_pvalue",
                        F.when(F.col("lb_df") > 0, F.col("lb_pvalue") < alpha).alias("autocorrelated"),
                        F.when(F.col("arch_df") > 0, F.col("arch_pvalue") < alpha).alias("heteroskedastic"))


# -------------------------------------------------------------- bootstrap
def granger_bootstrap(df: DataFrame, targets: Sequence[str], sources: Sequence[str],
                      keys: Sequence[str] = ("company",), order_col: str = "date",
                      maxlag: int = 5, B: int = 100, block_size: int = 5, seed: int = 0,
                      checkpoint: bool = True) -> DataFrame:
    """Block-bootstrap p-value of the Granger F statistic.

    Observed F as in G9 but lags are built on the full series (feed trading
    rows) and incomplete rows dropped afterwards.  Each of ``B`` replicates
    block-shuffles the source series (R7, per replicate), rebuilds its lags,
    aligns them to the rows the observed fit used (a replicate with any
    missing lag there is skipped), refits the unrestricted model and
    computes F with the observed RSS_r and dof.  p = share of valid
    replicates with F_boot >= F.

    Every (row, replicate) is aggregated once into its stratum's sums; what
    involves y alone is summed once per series, not per replicate."""
    from marketlex.session import materialize
    g = [*keys, "target", "source"]
    lp = long_pairs(df, keys, order_col, targets, sources)
    lp = global_row_number(lp, [order_col], F.year(order_col), "_pos", g)
    lagged = _lag_series(lp, g, "_pos", maxlag, keep=["x"])
    if checkpoint:  # the lagged series feed the observed fit and every replicate
        lagged = materialize(lagged)
    moments_of = _lag_moments(lagged, g, maxlag)
    obs = _solve_granger(moments_of, g, maxlag).select(*g, "lag", "n", "rss_r", "f_stat", "df_den")
    # replicate source series: (g, rep, new_pos, x); replicate ids come from a sequence in the row
    xs = lagged.select(*g, "_pos", "x", "_sx").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(B - 1))))
    shuf = block_shuffle(xs, g, "_pos", block_size, seed, rep="rep")
    wb = Window.partitionBy(*g, "rep").orderBy("new_pos")
    bl = shuf.select(*g, "rep", F.col("new_pos").alias("_pos"), "_sx",
                     *[F.lag("x", i).over(wb).alias(f"_bx{i}") for i in range(1, maxlag + 1)])
    used = lagged.select(*g, "_pos", "_sy", _stratum(maxlag).alias("s"), *[_shifted(c).alias(c) for c in _names(maxlag)[:maxlag + 1]]).filter("s > 0")
    xn, yn = [f"_bx{i}" for i in range(1, maxlag + 1)], _names(maxlag)[:maxlag + 1]
    # a missing lag of the replicate counts from its own order on
    d = used.join(bl, [*g, "_pos"]).select(*g, "rep", "s", *yn, *[_shifted(c).alias(c) for c in xn],
                                            *[F.col(c).isNull().cast("int").alias(f"{c}_gap") for c in xn])
    m = maxlag
    agg = d.groupBy(*g, "rep", "s").agg(
        *[F.sum(c).alias(f"__s{c}") for c in xn], *[F.sum(f"{c}_gap").alias(f"__g{c}") for c in xn],
        *[F.sum(F.col(xn[i]) * F.col(xn[j])).alias(f"__x{i}_{j}") for i in range(m) for j in range(i, m)],
        *[F.sum(F.col(xn[i]) * F.col(y)).alias(f"__y{i}{y}") for i in range(m) for y in yn])
    part = F.struct("s", F.array(*[f"__s{c}" for c in xn]).alias("sum"), F.array(*[f"__g{c}" for c in xn]).alias("gap"),
                    F.array(*[f"__x{i}_{j}" for i in range(m) for j in range(i, m)]).alias("xx"),
                    F.array(*[f"__y{i}{y}" for i in range(m) for y in yn]).alias("xy"))
    reps = agg.groupBy(*g, "rep").agg(F.collect_list(part).alias("boot"))  # at most maxlag parts
    per_order = obs.groupBy(*g).agg(F.collect_list(F.struct("lag", "rss_r", "df_den")).alias("obs"))
    reps = reps.join(moments_of.select(*g, "parts").join(per_order, g), g)
    out = T.StructType([reps.schema[c] for c in g] + [T.StructField("rep", T.IntegerType()), T.StructField("lag", T.IntegerType()),
                                                      T.StructField("f_boot", T.DoubleType())])
    k = 2 * m + 1
    xi, xj = np.triu_indices(m)

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            n_all, sums, prods = (x.copy() for x in _stack(pdf["parts"], m))
            xs_, gaps, xx, xy = (np.zeros((len(pdf), m, w)) for w in (m, m, len(xi), m * (m + 1)))
            rss, den = np.full((len(pdf), m), np.nan), np.full((len(pdf), m), np.nan)
            for r, (boot, seen) in enumerate(zip(pdf["boot"], pdf["obs"])):
                for b in boot:
                    at = b["s"] - 1
                    xs_[r, at], gaps[r, at], xx[r, at], xy[r, at] = b["sum"], b["gap"], b["xx"], b["xy"]
                for o in seen:
                    rss[r, o["lag"] - 1], den[r, o["lag"] - 1] = o["rss_r"], o["df_den"]
            xs_, gaps, xx, xy = (np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (xs_, gaps, xx, xy))
            sums[:, :, m + 1:] = xs_
            prods[:, :, m + 1 + xi, m + 1 + xj] = xx
            prods[:, :, m + 1 + xj, m + 1 + xi] = xx
            cross = xy.reshape(len(pdf), m, m, m + 1)
            prods[:, :, m + 1:, :m + 1] = cross
            prods[:, :, :m + 1, m + 1:] = np.transpose(cross, (0, 1, 3, 2))
            for p in range(1, m + 1):
                rss_u, _, _ = _fit(n_all[:, p - 1], sums[:, p - 1], prods[:, p - 1], _orders(m, p)[1])
                with np.errstate(all="ignore"):
                    f = (rss[:, p - 1] - rss_u) / p / (rss_u / den[:, p - 1])
                o = pdf[[*g, "rep"]].copy()
                o["lag"], o["f_boot"] = p, f
                yield o[(gaps[:, p - 1, :p].sum(axis=1) == 0) & np.isfinite(f)]
    b = reps.mapInPandas(solve, out).join(obs, [*g, "lag"])
    agg = b.groupBy(*g, "lag").agg(
        F.count("f_boot").alias("n_valid"),
        F.sum(F.when(F.col("f_boot") >= F.col("f_stat"), 1).otherwise(0)).alias("count_exceeds"),
        F.sort_array(F.collect_list(F.struct("rep", "f_boot"))).alias("_bs"))
    out = obs.join(agg, [*g, "lag"], "left")
    return out.select(*g, F.col("lag").alias("lag_order"), F.col("f_stat").alias("f_actual"),
                      F.coalesce("n_valid", F.lit(0)).alias("n_valid"),
                      F.coalesce("count_exceeds", F.lit(0)).alias("count_exceeds"),
                      F.try_divide(F.col("count_exceeds").cast("double"), F.col("n_valid")).alias("p_value"),
                      F.coalesce(F.transform("_bs", lambda s: s["f_boot"]),
                                 F.array().cast("array<double>")).alias("boot_f_stats"))


# ------------------------------------------------- tree form, significance
def nest_granger(flat: DataFrame) -> DataFrame:
    """Flat results -> one row per company with
    ``map<target, map<source, map<lag, p_value>>>``."""
    l1 = flat.groupBy("company", "target", "source").agg(
        F.map_from_entries(F.collect_list(F.struct("lag", "p_value"))).alias("_m"))
    l2 = l1.groupBy("company", "target").agg(F.map_from_entries(F.collect_list(F.struct("source", "_m"))).alias("_m"))
    return l2.groupBy("company").agg(F.map_from_entries(F.collect_list(F.struct("target", "_m"))).alias("tree"))


def flatten_granger(tree: DataFrame) -> DataFrame:
    """Company -> target -> source -> lag -> p tree to rows."""
    a = tree.select("company", F.explode("tree").alias("target", "_m1"))
    b = a.select("company", "target", F.explode("_m1").alias("source", "_m2"))
    return b.select("company", "target", "source", F.explode("_m2").alias("lag", "p_value"))


def flag_significant(p_col: str = "p_value", alpha: float = 0.05):
    """G14."""
    return (F.col(p_col) < F.lit(alpha)).alias("significant")


def pivot_significant(flat: DataFrame, alpha: float = 0.05, full_grid: bool = True,
                      companies: Sequence[str] | None = None, labels: dict | None = None) -> DataFrame:
    """A12 (long form): per company, target x source count of significant
    lags.  ``full_grid`` keeps every target/source seen for the company with
    0 counts; otherwise targets and sources without any significant cell go
    (the other zero cells stay), and a company without any significant lag
    keeps one placeholder row with null target and source and 0.
    ``labels`` renames targets and sources for display."""
    d = flat if companies is None else flat.filter(F.col("company").isin(list(companies)))
    d = d.withColumn("significant", flag_significant("p_value", alpha))
    counts = d.filter("significant").groupBy("company", "target", "source").agg(
        F.count("lag").alias("n_significant"))
    seen = d if full_grid else counts
    grid = (seen.select("company", "target").distinct()
            .join(seen.select("company", "source").distinct(), "company"))
    out = grid.join(counts, ["company", "target", "source"], "left").fillna(0, ["n_significant"])
    if not full_grid:
        empty = d.select("company").distinct().join(counts.select("company").distinct(), "company", "left_anti")
        none = F.lit(None).cast("string")
        out = out.unionByName(empty.select("company", none.alias("target"), none.alias("source"), F.lit(0).cast("long").alias("n_significant")))
    if labels:
        name = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        out = out.select("company", *[F.coalesce(name[F.col(c)], F.col(c)).alias(c) for c in ("target", "source")], "n_significant")
    return out


def significance_table(counts: DataFrame, sources: Sequence[str]) -> DataFrame:
    """A12 (wide form): one row per company and target, one column per
    source in the given order; sources without a cell count 0."""
    wide = counts.where("target is not null").groupBy("company", "target").pivot("source", list(sources)).agg(F.first("n_significant"))
    return wide.fillna(0, list(sources))


# ------------------------------------------------------------- lag choice
def select_lags(df: DataFrame, target: str, sources: Sequence[str], max_lags: int = 5,
                bins: int = 10, keep: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """Score lag l by the mean over sources of the mutual information
    between ``{source}_lag_{l}`` and the target, estimated from equal-width
    ``bins`` x ``bins`` histograms (natural log); keep the best ``keep``
    lags.  Rows ``(keys, lag, mean_mi, rank, selected)``."""
    pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(l).alias("lag"),
                               F.col(f"{s}_lag_{l}").cast("double").alias("x"))
                      for l in range(1, max_lags + 1) for s in sources])
    d = df.select(*keys, F.col(target).cast("double").alias("y"), F.inline(pairs)).dropna(subset=["x", "y"])
    g = [*keys, "source", "lag"]
    rng = d.groupBy(*g).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"),
                            F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.count(F.lit(1)).alias("_n"))

    def binof(v, lo, hi):
        width = F.col(hi) - F.col(lo)
        return F.when(width == 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col(v) - F.col(lo)) / width * bins), F.lit(bins - 1))).cast("int")
    b = d.join(rng, g).select(*g, "_n", binof("x", "_x0", "_x1").alias("bx"), binof("y", "_y0", "_y1").alias("by"))
    joint = b.groupBy(*g, "_n", "bx", "by").agg(F.count(F.lit(1)).alias("_c"))
    wx = Window.partitionBy(*g, "bx")
    wy = Window.partitionBy(*g, "by")
    joint = joint.withColumn("_cx", F.sum("_c").over(wx)).withColumn("_cy", F.sum("_c").over(wy))
    mi = joint.groupBy(*g).agg(F.sum(F.col("_c") / F.col("_n") * F.log(
        F.col("_c") * F.col("_n") / (F.col("_cx") * F.col("_cy")))).alias("mi"))
    score = mi.groupBy(*keys, "lag").agg(F.avg("mi").alias("mean_mi"))
    rk = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mean_mi"), "lag"))
    return score.withColumn("rank", rk).withColumn("selected", F.col("rank") <= keep)
