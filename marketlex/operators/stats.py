"""Grouped regression statistics (G1-G8) on Spark.

Scale pattern: rows are reduced on Spark to per-group sufficient
statistics -- counts, means and the population covariance matrix from
``covar_pop`` (a mergeable, numerically stable co-moment aggregate, combined
map-side) -- and only those one-row-per-group tables reach Python, where
the <= 11 x 11 solves and distribution tails run in Arrow batches.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlex.functions import stats_math as sm
from marketlex.operators.ordering import rank_percentiles


# ------------------------------------------------------------------ moments
def moments(df: DataFrame, group_cols: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per group: ``n``, ``mu`` (means of ``cols``) and ``cov`` (row-major
    upper triangle of the population covariance matrix).  Rows with a null
    in ``cols`` must be removed first."""
    k = len(cols)
    ups = [F.covar_pop(cols[i], cols[j]) for i in range(k) for j in range(i, k)]
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in cols]).alias("mu"),
        F.array(*ups).alias("cov"))


def _schema_fields(df: DataFrame, names: Sequence[str]):
    return [df.schema[n] for n in names]


def ols(df: DataFrame, group_cols: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Per group ``y ~ 1 + xs`` by pseudo-inverse of the centred Gram
    matrix.  Returns n, intercept, coefficients, standard errors, two-sided
    t p-values (intercept first), SSR, R^2, adjusted R^2 and residual dof."""
    cols = [y, *xs]
    st = moments(df.dropna(subset=cols), group_cols, cols)
    k = len(cols)
    out = T.StructType(_schema_fields(st, group_cols) + [
        T.StructField("n", T.LongType()), T.StructField("intercept", T.DoubleType()),
        T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("se", T.ArrayType(T.DoubleType())),
        T.StructField("p_values", T.ArrayType(T.DoubleType())), T.StructField("ssr", T.DoubleType()),
        T.StructField("r2", T.DoubleType()), T.StructField("adj_r2", T.DoubleType()),
        T.StructField("df_resid", T.LongType())])
    gc = list(group_cols)

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for d in pdf.to_dict("records"):
                n = int(d["n"])
                mu = np.asarray(d["mu"], float)
                cov = sm.sym_from_upper(list(d["cov"]), k)
                fit = sm.ols_from_moments(n, mu, cov, 0, range(1, k))
                dfr = fit["df_resid"]
                t = np.concatenate([[fit["intercept"] / fit["intercept_se"] if fit["intercept_se"] else np.nan],
                                    np.divide(fit["coef"], fit["se"], out=np.full(len(fit["coef"]), np.nan),
                                              where=fit["se"] > 0)])
                p = sm.t_sf_two_sided(t, dfr) if dfr > 0 else np.full(len(t), np.nan)
                r2 = fit["r2"]
                adj = 1 - (n - 1) / dfr * (1 - r2) if dfr > 0 else np.nan
                rows.append({**{c: d[c] for c in gc}, "n": n, "intercept": fit["intercept"],
                             "coef": fit["coef"].tolist(), "se": fit["se"].tolist(), "p_values": p.tolist(),
                             "ssr": fit["ssr"], "r2": r2, "adj_r2": adj, "df_resid": dfr})
            yield pd.DataFrame(rows, columns=out.fieldNames())
    return st.mapInPandas(solve, out)


# -------------------------------------------------------------- diagnostics
def _levene_from_medians(df: DataFrame, group_cols: Sequence[str], a: str, b: str) -> DataFrame:
    """Median-centred Levene statistic between the samples ``a`` and
    ``b`` (paired rows of one table, as in the reference), from rows that
    already carry the group medians ``_ma``, ``_mb``.  W ~ F(1, N-2)."""
    z = df.select(
        *group_cols, F.abs(F.col(a) - F.col("_ma")).alias("_za"), F.abs(F.col(b) - F.col("_mb")).alias("_zb"))
    s = z.groupBy(*group_cols).agg(
        F.count("_za").alias("_na"), F.count("_zb").alias("_nb"),
        F.avg("_za").alias("_mza"), F.avg("_zb").alias("_mzb"),
        F.var_pop("_za").alias("_vza"), F.var_pop("_zb").alias("_vzb"))
    big_n = F.col("_na") + F.col("_nb")
    zbar = (F.col("_na") * F.col("_mza") + F.col("_nb") * F.col("_mzb")) / big_n
    num = F.col("_na") * F.pow(F.col("_mza") - zbar, 2) + F.col("_nb") * F.pow(F.col("_mzb") - zbar, 2)
    den = F.col("_na") * F.col("_vza") + F.col("_nb") * F.col("_vzb")
    return s.select(*group_cols, ((big_n - 2) * F.try_divide(num, den)).alias("levene_w"),
                    (big_n - 2).alias("levene_df2"))


def round_stats(c, digits: int) -> Column:
    """M6: numpy-style rounding (half to even) of a reported statistic;
    ``+ 0.0`` turns a rounded -0.0 into 0.0."""
    return F.bround(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def vif_single() -> Column:
    """G8 for one predictor with a constant: the auxiliary regression of
    the predictor on the constant has R^2 = 0, so VIF = 1."""
    return F.lit(1.0)


def vif(df: DataFrame, group_cols: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Variance inflation of each predictor given the others and a
    constant, per group, as rows (groups, variable, vif): the diagonal of the
    inverse correlation matrix; null where predictors are collinear or
    constant."""
    k = len(xs)
    st = moments(df.dropna(subset=list(xs)), group_cols, xs)
    out = T.StructType(_schema_fields(st, group_cols) + [T.StructField("variable", T.StringType()), T.StructField("vif", T.DoubleType())])

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            cov = np.stack([sm.sym_from_upper(list(c), k) for c in pdf["cov"]])
            sd = np.sqrt(np.einsum("gii->gi", cov))
            with np.errstate(all="ignore"):
                corr = cov / (sd[:, :, None] * sd[:, None, :])
                ok = np.isfinite(corr).all(axis=(1, 2)) & (np.abs(np.linalg.det(np.nan_to_num(corr))) > 1e-12)
            v = np.full((len(pdf), k), np.nan)
            if ok.any():
                v[ok] = np.einsum("gii->gi", np.linalg.inv(corr[ok]))
            for j, x in enumerate(xs):
                o = pdf[list(group_cols)].copy()
                o["variable"], o["vif"] = x, v[:, j]
                yield o
    return st.mapInPandas(solve, out)


def pvalues(df: DataFrame, specs: dict) -> DataFrame:
    """Append p-value columns computed in Arrow batches.  ``specs`` maps an
    output name to ``("t", stat, dof)``, ``("f", stat, d1, d2)``,
    ``("chi2", stat, dof)`` or ``("k2", skew, kurt, n)``."""
    out = T.StructType(df.schema.fields + [T.StructField(k, T.DoubleType()) for k in specs])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, sp in specs.items():
                kind, *cols = sp
                v = [pdf[c].astype(float).to_numpy() for c in cols]
                with np.errstate(all="ignore"):
                    if kind == "t":
                        pdf[name] = sm.t_sf_two_sided(v[0], v[1])
                    elif kind == "f":
                        pdf[name] = sm.f_sf(v[0], v[1], v[2])
                    elif kind == "chi2":
                        pdf[name] = sm.chi2_sf(v[0], v[1])
                    elif kind == "k2":
                        k2, p = sm.normaltest_k2(v[0], v[1], v[2])
                        pdf[name] = np.where(v[2] >= 8, p, np.nan)
            yield pdf
    return df.mapInPandas(run, out)


# ---------------------------------------------------------------- panels
def long_pairs(df: DataFrame, keys: Sequence[str], order_col: str, targets: Sequence[str],
               sources: Sequence[str]) -> DataFrame:
    """Every (target, source) pair of a wide panel as rows
    ``(keys, order, target, y, source, x)``: one unpivot per side and a
    projection (no join: both sides come from the same row)."""
    tg = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets])
    sc = F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).cast("double").alias("x")) for s in sources])
    d = df.select(*keys, order_col, F.inline(tg), sc.alias("_sc"))
    return d.select(*keys, order_col, "target", "y", F.inline("_sc"))


def ols_screen(df: DataFrame, targets: Sequence[str], sources: Sequence[str],
               keys: Sequence[str] = (), order_col: str = "date", z: float = 3.0) -> DataFrame:
    """G1: for every (target, source) pair (per ``keys`` group): drop
    incomplete rows, drop rows whose predictor |z| >= 3, fit ``y ~ 1 + x``,
    then report R^2, adjusted R^2, slope and its p-value, residual
    normality (K^2) p, Levene p (predictor vs residuals), Durbin-Watson,
    VIF, sample size and outliers removed -- rounded like the reference."""
    from marketlex.session import materialize
    g = [*keys, "target", "source"]
    # the complete pairs feed five branches (filter, fit, residual moments, DW, Levene)
    lp = materialize(long_pairs(df, keys, order_col, targets, sources).dropna(subset=["y", "x"]))
    zs = lp.groupBy(*g).agg(F.count(F.lit(1)).alias("_nvalid"), F.avg("x").alias("_zm"),
                            F.stddev_pop("x").alias("_zs"))
    zx = F.abs(F.try_divide(F.col("x") - F.col("_zm"), F.col("_zs")))
    kept = lp.join(zs, g).filter(F.coalesce(zx < z, F.lit(False))).select(*lp.columns, "_nvalid")
    st = kept.groupBy(*g, "_nvalid").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"),
        F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"), F.covar_pop("x", "y").alias("_cxy"))
    beta = F.try_divide(F.col("_cxy"), F.col("_vx"))
    st = st.withColumn("coef", beta).withColumn("intercept", F.col("_my") - F.col("coef") * F.col("_mx"))
    ssr = F.col("n") * (F.col("_vy") - F.col("coef") * F.col("_cxy"))
    st = (st.withColumn("_ssr", F.greatest(ssr, F.lit(0.0)))
          .withColumn("r2", 1 - F.try_divide(F.col("_ssr"), F.col("n") * F.col("_vy")))
          .withColumn("adj_r2", 1 - (F.col("n") - 1) / (F.col("n") - 2) * (1 - F.col("r2")))
          .withColumn("_se", F.sqrt(F.try_divide(F.col("_ssr") / (F.col("n") - 2), F.col("n") * F.col("_vx"))))
          .withColumn("_t", F.try_divide(F.col("coef"), F.col("_se")))
          .withColumn("_dfr", (F.col("n") - 2).cast("double")))
    # residuals, then one window (DW) and one aggregate for K^2 moments, DW and the medians
    res = kept.join(st.select(*g, "coef", "intercept"), g).select(
        *g, order_col, "x", (F.col("y") - F.col("intercept") - F.col("coef") * F.col("x")).alias("_e"))
    res = materialize(res).withColumn("_de", F.col("_e") - F.lag("_e", 1).over(Window.partitionBy(*g).orderBy(order_col)))
    rs = res.groupBy(*g).agg(
        F.count("_e").alias("_nn"), F.skewness("_e").alias("_skew"), F.kurtosis("_e").alias("_kurt"),
        (F.sum(F.col("_de") * F.col("_de")) / F.sum(F.col("_e") * F.col("_e"))).alias("durbin_watson"))
    both = res.select(*g, F.inline(F.array(F.struct(F.lit("a").alias("_side"), F.col("x").alias("_m")), F.struct(F.lit("b").alias("_side"), F.col("_e").alias("_m")))))
    med = rank_percentiles(both, "_m", [0.5], [*g, "_side"]).groupBy(*g).agg(
        F.max(F.when(F.col("_side") == "a", F.col("_p")[0])).alias("_ma"), F.max(F.when(F.col("_side") == "b", F.col("_p")[0])).alias("_mb"))
    rs = rs.join(med, g)
    lv = _levene_from_medians(res.join(rs.select(*g, "_ma", "_mb"), g), g, "x", "_e")
    allst = st.join(rs, g).join(lv, g)
    allst = allst.withColumn("_one", F.lit(1.0))
    allst = pvalues(allst, {"_p": ("t", "_t", "_dfr"), "_pn": ("k2", "_skew", "_kurt", "_nn"),
                            "_pl": ("f", "levene_w", "_one", "levene_df2")})
    rnd = round_stats
    return allst.select(
        *keys, F.col("target").alias("stock_variable"), F.col("source").alias("tweet_variable"),
        rnd("r2", 3).alias("r_squared"), rnd("adj_r2", 3).alias("adj_r_squared"),
        rnd("coef", 3).alias("coefficient"), rnd("_p", 5).alias("p_value"),
        rnd("_pn", 5).alias("normality_p"), rnd("_pl", 5).alias("homoscedasticity_p"),
        rnd("durbin_watson", 3).alias("durbin_watson"), rnd(vif_single(), 3).alias("vif"),
        F.col("n").alias("sample_size"), (F.col("_nvalid") - F.col("n")).alias("outliers_removed"))
