"""Registered regression / causality queries over ``v_panel``.

Oracles exist where SQL can express the statistic (moments, closed-form
fits by Gram-Schmidt sweeps, binned mutual information); their p-values are
the beta and gamma integrals by Simpson's rule in SQL.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from marketlex.operators import causality as C
from marketlex.operators import market
from marketlex.operators import stats as S
from marketlex.plans import sqlutil as q
from marketlex.plans.views import V_PANEL_SQL, v_panel
from marketlex.session import materialize

QUERIES = {}
ORACLES = {}

TARGETS = ("ret", "volatility")
SOURCES = ("n_urgent", "avg_price")


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _r3(df, cols):
    return df.select(*[F.round(c, 3).alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------------- G4
def g04_ols(spark, sf_dir):
    f = S.ols(v_panel(spark, sf_dir), ["company"], "ret", ["n_urgent", "avg_price"])
    f = f.select("company", "n", "intercept", F.col("coef")[0].alias("coef_n_urgent"),
                 F.col("coef")[1].alias("coef_avg_price"), F.col("se")[0].alias("se_n_urgent"),
                 F.col("p_values")[1].alias("p_n_urgent"), F.col("p_values")[2].alias("p_avg_price"), "ssr", "r2", "adj_r2")
    return _r6(f, ["intercept", "coef_n_urgent", "coef_avg_price", "se_n_urgent", "p_n_urgent", "p_avg_price", "ssr", "r2", "adj_r2"])


def _two_pred_sql(y, a, b, src, keys="company"):
    """Closed-form y ~ 1 + a + b per key from population moments."""
    return f"""m AS (SELECT {keys}, count(*) AS n, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb,
        var_pop({y}) AS syy, var_pop({a}) AS saa, var_pop({b}) AS sbb, covar_pop({a}, {b}) AS sab,
        covar_pop({a}, {y}) AS say, covar_pop({b}, {y}) AS sby
      FROM {src} WHERE {y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {keys}),
s AS (SELECT *, saa * sbb - sab * sab AS det FROM m),
c AS (SELECT *, (sbb * say - sab * sby) / det AS ba, (saa * sby - sab * say) / det AS bb FROM s),
r AS (SELECT *, greatest(n * (syy - ba * say - bb * sby), 0) AS ssr FROM c)"""


QUERIES["g04_ols"] = g04_ols
ORACLES["g04_ols"] = f"""WITH {V_PANEL_SQL}, {_two_pred_sql('ret', 'n_urgent', 'avg_price', 'v_panel')}
SELECT company, n, round(my - ba * ma - bb * mb, 6) AS intercept, round(ba, 6) AS coef_n_urgent,
       round(bb, 6) AS coef_avg_price, round(sqrt(ssr / (n - 3) * sbb / (n * det)), 6) AS se_n_urgent,
       round({q.t_tail('ba / sqrt(ssr / (n - 3) * sbb / (n * det))', '(n - 3.0)')}, 6) AS p_n_urgent,
       round({q.t_tail('bb / sqrt(ssr / (n - 3) * saa / (n * det))', '(n - 3.0)')}, 6) AS p_avg_price, round(ssr, 6) AS ssr, round(1 - ssr / (n * syy), 6) AS r2,
       round(1 - (n - 1.0) / (n - 3) * (ssr / (n * syy)), 6) AS adj_r2 FROM r"""


def g08_vif(spark, sf_dir):
    v = S.vif(v_panel(spark, sf_dir), ["company"], ["n_urgent", "n_low", "avg_price"])
    return _r6(v, ["vif"])


_VIFS = (("n_urgent", "n_low", "avg_price"), ("n_low", "n_urgent", "avg_price"), ("avg_price", "n_urgent", "n_low"))
QUERIES["g08_vif"] = g08_vif
ORACLES["g08_vif"] = f"WITH {V_PANEL_SQL}, c AS (SELECT * FROM v_panel WHERE n_urgent IS NOT NULL AND n_low IS NOT NULL AND avg_price IS NOT NULL),\n" + ",\n".join(
    q.residuals(f"v_{y}", "c", "company", f"{y} AS orig", y, xs) for y, *xs in _VIFS) + "\n" + " UNION ALL ".join(
    f"SELECT company, '{y}' AS variable, round(count(*) * var_pop(orig) / sum(e * e), 6) AS vif FROM v_{y} GROUP BY company" for y, *_ in _VIFS)


# ------------------------------------------------------------------- G1
def g01_ols_screen(spark, sf_dir):
    return S.ols_screen(v_panel(spark, sf_dir), TARGETS, SOURCES, ["company"], "date")


QUERIES["g01_ols_screen"] = g01_ols_screen
_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT company, date, '{t}' AS target, '{s}' AS source, {t} AS y, {s} AS x FROM v_panel "
    f"WHERE {t} IS NOT NULL AND {s} IS NOT NULL" for t in TARGETS for s in SOURCES)
ORACLES["g01_ols_screen"] = f"""WITH {V_PANEL_SQL}, lp AS ({_PAIRS_SQL}),
zs AS (SELECT company, target, source, count(*) AS nvalid, avg(x) AS mx, stddev_pop(x) AS sx FROM lp GROUP BY ALL),
k AS (SELECT lp.* FROM lp JOIN zs USING (company, target, source) WHERE abs((x - mx) / sx) < 3),
st AS (SELECT company, target, source, count(*) AS n, avg(x) AS ax, avg(y) AS ay, var_pop(x) AS vx,
              var_pop(y) AS vy, covar_pop(x, y) AS cxy FROM k GROUP BY ALL),
f AS (SELECT *, cxy / vx AS b, ay - cxy / vx * ax AS a, greatest(n * (vy - cxy / vx * cxy), 0) AS ssr FROM st),
e AS (SELECT k.company, k.target, k.source, k.date, k.x, k.y - f.a - f.b * k.x AS e FROM k JOIN f USING (company, target, source)),
dw AS (SELECT company, target, source, sum(d * d) / sum(e * e) AS dw FROM
       (SELECT *, e - lag(e) OVER (PARTITION BY company, target, source ORDER BY date) AS d FROM e) GROUP BY ALL),
cz AS (SELECT *, e - avg(e) OVER (PARTITION BY company, target, source) AS ce FROM e),
nm AS (SELECT company, target, source, count(*) AS nn, avg(ce * ce * ce) / pow(avg(ce * ce), 1.5) AS skew,
              avg(ce * ce * ce * ce) / pow(avg(ce * ce), 2) - 3 AS kurt FROM cz GROUP BY ALL),
md AS (SELECT company, target, source, median(x) AS mx_, median(e) AS me_ FROM e GROUP BY ALL),
za AS (SELECT company, target, source, abs(x - mx_) AS za, abs(e - me_) AS zb FROM e JOIN md USING (company, target, source)),
zz AS (SELECT company, target, source, count(*) AS m, avg(za) AS ma, avg(zb) AS mb, var_pop(za) AS va, var_pop(zb) AS vb FROM za GROUP BY ALL),
lv AS (SELECT company, target, source, 2.0 * m - 2 AS ldf,
              (2.0 * m - 2) * (m * pow(ma - (ma + mb) / 2, 2) + m * pow(mb - (ma + mb) / 2, 2)) / (m * va + m * vb) AS lw FROM zz)
SELECT f.company, f.target AS stock_variable, f.source AS tweet_variable,
       round_even(1 - ssr / (n * vy), 3) + 0.0 AS r_squared,
       round_even(1 - (n - 1.0) / (n - 2) * (ssr / (n * vy)), 3) + 0.0 AS adj_r_squared,
       round_even(b, 3) + 0.0 AS coefficient,
       round_even({q.t_tail('b / sqrt(ssr / (n - 2) / (n * vx))', '(n - 2.0)')}, 5) + 0.0 AS p_value,
       round_even({q.k2_tail('skew', 'kurt', '(nn * 1.0)')}, 5) + 0.0 AS normality_p,
       round_even({q.f_tail('lw', '1.0', 'ldf')}, 5) + 0.0 AS homoscedasticity_p, round_even(dw.dw, 3) + 0.0 AS durbin_watson, CAST(1.0 AS DOUBLE) AS vif,
       n AS sample_size,
       zs.nvalid - n AS outliers_removed
FROM f JOIN dw USING (company, target, source) JOIN zs USING (company, target, source)
  JOIN nm USING (company, target, source) JOIN lv USING (company, target, source)"""


# ------------------------------------------------------------------- G9
MAXLAG = 5


def _trading(spark, sf_dir):
    return v_panel(spark, sf_dir).filter("is_trading_day")


def g09_granger_rowlag(spark, sf_dir):
    g = C.granger_rowlag(v_panel(spark, sf_dir), TARGETS, SOURCES, ["company"], "date", maxlag=MAXLAG)
    return _r3(_r6(g, ["f_stat", "p_value"]), ["rss_r", "rss_u"])


def _series_sql(where_pair: bool, calendar: bool = False) -> str:
    """CTE ``l``: y and its row lags, the source's row or calendar lags."""
    w = "(PARTITION BY company, target, source ORDER BY date)"
    rows = " UNION ALL ".join(
        f"SELECT company, date, '{t}' AS target, '{s}' AS source, {t} AS y, {s} AS x FROM v_panel WHERE "
        + (f"{t} IS NOT NULL AND {s} IS NOT NULL" if where_pair else "is_trading_day") for t in TARGETS for s in SOURCES)
    xs = ", ".join((f"(SELECT any_value(v.x) FROM by_day v WHERE v.source = r.source AND v.company = r.company AND v.date = r.date - {i}) AS xl{i}"
                    if calendar else f"lag(x, {i}) OVER {w} AS xl{i}") for i in range(1, MAXLAG + 1))
    cal = "by_day AS (" + " UNION ALL ".join(f"SELECT company, date, '{s}' AS source, {s} AS x FROM v_panel" for s in SOURCES) + "),\n" if calendar else ""
    ys = ", ".join(f"lag(y, {i}) OVER {w} AS yl{i}" for i in range(1, MAXLAG + 1))
    return f"{cal}rows_ AS ({rows}),\nl AS (SELECT company, date, target, source, y, {ys}, {xs} FROM rows_ r)"


def _fits_sql(series: str) -> str:
    """CTEs up to ``fits``: one row per pair and lag order, by sweeps."""
    parts, names = [f"{series}"], []
    for p in range(1, MAXLAG + 1):
        regs = [f"yl{i}" for i in range(1, p + 1)] + [f"xl{i}" for i in range(1, p + 1)]
        need = " AND ".join(f"{c} IS NOT NULL" for c in ["y", *regs])
        parts.append(f"d{p} AS (SELECT * FROM l WHERE {need} QUALIFY count(*) OVER (PARTITION BY company, target, source) >= {2 * p + 5})")
        parts.append(q.residuals(f"s{p}", f"d{p}", "company, target, source", "date", "y", regs, snapshot=p))
        names.append(f"SELECT company, target, source, date, {p} AS lag, n, e, e_r FROM s{p}")
    parts.append("swept AS (" + " UNION ALL ".join(names) + ")")
    parts.append("""fits AS (SELECT company, target, source, lag, n, sum(e_r * e_r) AS rss_r, sum(e * e) AS rss_u,
  n - 2 * lag - 1 AS df_den, (sum(e_r * e_r) - sum(e * e)) / lag / (sum(e * e) / (n - 2 * lag - 1)) AS f_stat
  FROM swept GROUP BY company, target, source, lag, n)""")
    return ",\n".join(parts)


_FIT_COLUMNS = f"""company, target, source, lag, n, round(rss_r, 3) AS rss_r, round(rss_u, 3) AS rss_u, lag AS df_num, df_den,
       round(f_stat, 6) AS f_stat, round({q.f_tail('f_stat', 'lag', 'df_den')}, 6) AS p_value"""
QUERIES["g09_granger_rowlag"] = g09_granger_rowlag
ORACLES["g09_granger_rowlag"] = f"WITH {V_PANEL_SQL}, {_fits_sql(_series_sql(True))}\nSELECT {_FIT_COLUMNS} FROM fits"


# ------------------------------------------------------------------ G10
def g10_granger_calendarlag(spark, sf_dir):
    p = market.calendar_lags(v_panel(spark, sf_dir), SOURCES, MAXLAG)
    g = C.granger_calendarlag(p, TARGETS, SOURCES, ["company"], "date", maxlag=MAXLAG)
    return _r3(_r6(g, ["f_stat", "p_value"]), ["rss_r", "rss_u"])


QUERIES["g10_granger_calendarlag"] = g10_granger_calendarlag
ORACLES["g10_granger_calendarlag"] = f"WITH {V_PANEL_SQL}, {_fits_sql(_series_sql(False, calendar=True))}\nSELECT {_FIT_COLUMNS} FROM fits"


# ------------------------------------------------------------------ G11
def g11_residual_diagnostics(spark, sf_dir):
    d = C.residual_diagnostics(v_panel(spark, sf_dir), TARGETS, SOURCES, ["company"], "date", maxlag=MAXLAG)
    return _r6(d, ["lb_stat", "lb_pvalue", "arch_lm", "arch_pvalue"])


_GROUP = "company, target, source, lag, model"
_BY = f"OVER (PARTITION BY {_GROUP} ORDER BY date)"
QUERIES["g11_residual_diagnostics"] = g11_residual_diagnostics
ORACLES["g11_residual_diagnostics"] = f"""WITH {V_PANEL_SQL}, {_fits_sql(_series_sql(True))},
res AS (SELECT company, target, source, date, lag, n, 'restricted' AS model, e_r AS e FROM swept
        UNION ALL SELECT company, target, source, date, lag, n, 'unrestricted', e FROM swept),
cen AS (SELECT *, e - avg(e) OVER (PARTITION BY {_GROUP}) AS d FROM res),
lb0 AS (SELECT {_GROUP}, n, d, {", ".join(f"lag(d, {j}) {_BY} AS d{j}" for j in range(1, 11))} FROM cen),
lb AS (SELECT {_GROUP}, n, n * (n + 2.0) * ({" + ".join(f"CASE WHEN n - 1 >= {j} THEN pow(coalesce(sum(d * d{j}), 0) / sum(d * d), 2) / (n - {j}) ELSE 0 END" for j in range(1, 11))}) AS lb_stat
       FROM lb0 GROUP BY {_GROUP}, n),
a0 AS (SELECT {_GROUP}, date, least(10, n // 5) AS qa, e * e AS y, {", ".join(f"lag(e * e, {j}) {_BY} AS m{j}" for j in range(1, 11))} FROM res),
a1 AS (SELECT {_GROUP}, date, qa, y, {", ".join(f"CASE WHEN qa >= {j} THEN m{j} ELSE 0 END AS l{j}" for j in range(1, 11))}
       FROM a0 WHERE qa > 0 AND {" AND ".join(f"(qa < {j} OR m{j} IS NOT NULL)" for j in range(1, 11))}),
{q.residuals("ar", "a1", _GROUP, "date, qa, y", "y", [f"l{j}" for j in range(1, 11)])},
arch AS (SELECT {_GROUP}, qa, count(*) * (1 - sum(e * e) / (count(*) * var_pop(y))) AS arch_lm FROM ar GROUP BY {_GROUP}, qa),
st AS (SELECT lb.*, CAST(least(10, n - 1) AS DOUBLE) AS h, arch_lm, CAST(qa AS DOUBLE) AS qa FROM lb LEFT JOIN arch USING ({_GROUP})),
pv AS (SELECT *, {q.chi2_tail('lb_stat', 'h')} AS lb_p, {q.chi2_tail('arch_lm', 'qa')} AS arch_p FROM st)
SELECT {_GROUP}, round(lb_stat, 6) AS lb_stat, round(lb_p, 6) AS lb_pvalue, round(arch_lm, 6) AS arch_lm, round(arch_p, 6) AS arch_pvalue,
       CASE WHEN h > 0 THEN lb_p < 0.05 END AS autocorrelated, CASE WHEN qa > 0 THEN arch_p < 0.05 END AS heteroskedastic FROM pv"""


# ------------------------------------------------------------------ G12
def g12_granger_bootstrap(spark, sf_dir):
    return C.granger_bootstrap(_trading(spark, sf_dir), TARGETS, SOURCES, ["company"], "date",
                               maxlag=MAXLAG, B=100, block_size=5, seed=1).select(
        "company", "target", "source", "lag_order", F.round("f_actual", 6).alias("f_actual"),
        "n_valid", "count_exceeds", F.round("p_value", 6).alias("p_value"))


def g12_bootstrap_observed(spark, sf_dir):
    """What does not depend on the random order: the observed statistic, the
    number of valid replicates, and p as the share of exceeding ones."""
    b = g12_granger_bootstrap(spark, sf_dir)
    return b.select("company", "target", "source", "lag_order", "f_actual", "n_valid",
                    ((F.col("count_exceeds") >= 0) & (F.col("count_exceeds") <= F.col("n_valid"))
                     & (F.abs(F.col("p_value") * F.col("n_valid") - F.col("count_exceeds")) < 1e-3)).alias("p_is_share"))


QUERIES["g12_granger_bootstrap"] = g12_granger_bootstrap
QUERIES["g12_bootstrap_observed"] = g12_bootstrap_observed
# A replicate is valid if no lag it needs on a fitted row is missing: the
# shuffled series has no gap where the source has none, and the fitted rows
# of order p start after p rows.
ORACLES["g12_bootstrap_observed"] = f"""WITH {V_PANEL_SQL}, {_fits_sql(_series_sql(False))}
SELECT company, target, source, lag AS lag_order, round(f_stat, 6) AS f_actual, 100 AS n_valid, true AS p_is_share FROM fits"""


# ---------------------------------------------------------- G13, G14, A12
def _granger_flat(spark, sf_dir):
    return C.granger_rowlag(v_panel(spark, sf_dir), TARGETS, SOURCES, ["company"], "date", maxlag=MAXLAG) \
        .select("company", "target", "source", "lag", "p_value")


def g13_flatten_granger(spark, sf_dir):
    flat = C.flatten_granger(C.nest_granger(_granger_flat(spark, sf_dir)))
    return flat.select("company", "target", "source", "lag", F.round("p_value", 6).alias("p_value"),
                       C.flag_significant("p_value", 0.05))


LABELS = {"n_urgent": "urgent orders", "avg_price": "mean price", "ret": "return"}


def a12_pivot_significant(spark, sf_dir):
    return C.pivot_significant(_granger_flat(spark, sf_dir), alpha=0.05, full_grid=True)


def a12_pivot_reduced(spark, sf_dir):
    """Only targets and sources with a significant cell, display names, and a
    placeholder where nothing is significant."""
    return C.pivot_significant(_granger_flat(spark, sf_dir), alpha=0.05, full_grid=False, labels=LABELS)


def a12_pivot_table(spark, sf_dir):
    return C.significance_table(a12_pivot_significant(spark, sf_dir), SOURCES)


_FLAT_SQL = (f"WITH {V_PANEL_SQL}, {_fits_sql(_series_sql(True))},\n"
             f"flat AS (SELECT company, target, source, lag, {q.f_tail('f_stat', 'lag', 'df_den')} AS p_value FROM fits),\n"
             "grid AS (SELECT company, target, source, count(CASE WHEN p_value < 0.05 THEN 1 END) AS n_significant FROM flat GROUP BY ALL)")
_NAME = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + f" ELSE {c} END AS {c}"
QUERIES["g13_flatten_granger"] = g13_flatten_granger
ORACLES["g13_flatten_granger"] = f"{_FLAT_SQL}\nSELECT company, target, source, lag, round(p_value, 6) AS p_value, p_value < 0.05 AS significant FROM flat"
QUERIES["a12_pivot_significant"] = a12_pivot_significant
ORACLES["a12_pivot_significant"] = f"{_FLAT_SQL}\nSELECT * FROM grid"
QUERIES["a12_pivot_reduced"] = a12_pivot_reduced
ORACLES["a12_pivot_reduced"] = f"""{_FLAT_SQL}
SELECT company, {_NAME('target')}, {_NAME('source')}, n_significant FROM (
SELECT g.* FROM grid g WHERE (company, target) IN (SELECT (company, target) FROM grid WHERE n_significant > 0)
  AND (company, source) IN (SELECT (company, source) FROM grid WHERE n_significant > 0)
UNION ALL SELECT company, NULL, NULL, 0 FROM grid GROUP BY company HAVING max(n_significant) = 0)"""
QUERIES["a12_pivot_table"] = a12_pivot_table
ORACLES["a12_pivot_table"] = f"{_FLAT_SQL}\nSELECT company, target, " + ", ".join(
    f"coalesce(sum(CASE WHEN source = '{s}' THEN n_significant END), 0)::BIGINT AS {s}" for s in SOURCES) + " FROM grid GROUP BY company, target"


# -------------------------------------------------------------- G2 / G3
def g02_best_subset(spark, sf_dir):
    b = C.best_subset(materialize(v_panel(spark, sf_dir)), TARGETS, SUBSET_SOURCES, ["company"], 3)
    return b.select("company", "stock_variable", F.array_join("combination", ",").alias("combination"),
                    "r_squared", F.round("normality_p", 5).alias("normality_p"), "feature", "coefficient", "p_value")


SUBSET_SOURCES = ("n_urgent", "n_low", "avg_price")


def _best_subset_sql() -> str:
    """Every combination fitted by sweeps; a coefficient is the slope between
    what is left of y and of its predictor given the other predictors."""
    keys = "company, target"
    parts = ["tg AS (" + " UNION ALL ".join(f"SELECT company, date, '{t}' AS target, {t} AS y, {', '.join(SUBSET_SOURCES)} FROM v_panel" for t in TARGETS) + ")"]
    fits, feats = [], []
    combos = [c for k in (1, 2, 3) for c in combinations(SUBSET_SOURCES, k)]
    for i, c in enumerate(combos):
        have = " AND ".join(f"{x} IS NOT NULL" for x in ("y", *c))
        z = " AND ".join(f"abs(({x} - avg({x}) OVER w) / stddev_pop({x}) OVER w) < 3" for x in c)
        parts.append(f"k{i} AS (SELECT company, target, date, y, {', '.join(c)} FROM tg WHERE {have} WINDOW w AS (PARTITION BY {keys}) QUALIFY {z})")
        parts.append(q.residuals(f"b{i}", f"k{i}", keys, "date, y AS orig", "y", c))
        fits.append(f"SELECT {keys}, {i} AS cid, '{','.join(c)}' AS combination, {len(c)} AS k, count(*) AS n, sum(e * e) AS rss, "
                    f"1 - sum(e * e) / (count(*) * var_pop(orig)) AS r2, avg(e * e * e) / pow(avg(e * e), 1.5) AS skew, "
                    f"avg(e * e * e * e) / pow(avg(e * e), 2) - 3 AS kurt FROM b{i} GROUP BY {keys}")
        for x in c:
            others = [o for o in c if o != x]
            parts.append(q.residuals(f"y{i}{x}", f"k{i}", keys, "date", "y", others))
            parts.append(q.residuals(f"x{i}{x}", f"k{i}", keys, "date", x, others))
            feats.append(f"SELECT {keys}, {i} AS cid, '{x}' AS feature, sum(a.e * b.e) / sum(b.e * b.e) AS coef, sum(b.e * b.e) AS sxx "
                         f"FROM y{i}{x} a JOIN x{i}{x} b USING (company, target, date) GROUP BY {keys}")
    parts.append("fits AS (" + " UNION ALL ".join(fits) + ")")
    parts.append("feats AS (" + " UNION ALL ".join(feats) + ")")
    parts.append(f"best AS (SELECT * FROM fits WHERE r2 > 0 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY r2 DESC, k, cid) = 1)")
    parts.append(f"grid AS (SELECT DISTINCT {keys} FROM tg)")
    return ",\n".join(parts)


QUERIES["g02_best_subset"] = g02_best_subset
ORACLES["g02_best_subset"] = f"""WITH {V_PANEL_SQL}, {_best_subset_sql()}
SELECT grid.company, grid.target AS stock_variable, combination, round_even(r2, 3) + 0.0 AS r_squared,
       round({q.k2_tail('skew', 'kurt', '(n * 1.0)')}, 5) AS normality_p, feature, round_even(coef, 10) + 0.0 AS coefficient,
       round_even({q.t_tail('coef / sqrt(rss / (n - k - 1) / sxx)', '(n - k - 1.0)')}, 5) + 0.0 AS p_value
FROM grid LEFT JOIN best USING (company, target) LEFT JOIN feats USING (company, target, cid)"""


# ------------------------------------------------------------------ G15
LAG_SOURCES = ("n_urgent", "n_low", "avg_price")


def g15_select_lags(spark, sf_dir):
    p = market.row_lags(v_panel(spark, sf_dir), LAG_SOURCES, 5)
    s = C.select_lags(p, "ret", LAG_SOURCES, max_lags=5, bins=10, keep=2, keys=["company"])
    return s.select("company", "lag", F.round("mean_mi", 6).alias("mean_mi"), F.col("rank").cast("long").alias("rank"),
                    "selected")


_LAGGED_SQL = ", ".join(f"lag({s}, {l}) OVER (PARTITION BY company ORDER BY date) AS {s}_lag_{l}"
                        for s in LAG_SOURCES for l in range(1, 6))
_MI_PAIRS = " UNION ALL ".join(f"SELECT company, '{s}' AS source, {l} AS lag, {s}_lag_{l} AS x, ret AS y FROM pl"
                               for l in range(1, 6) for s in LAG_SOURCES)
def g15_neighbour_lags(spark, sf_dir):
    """G15 with the nearest-neighbour estimator: every series, and its lag's
    mean and rank."""
    from pyspark.sql import Window
    from marketlex.operators.neighbour_mi import neighbour_information
    p = market.row_lags(v_panel(spark, sf_dir), LAG_SOURCES, 5)
    mi = neighbour_information(p, "ret", LAG_SOURCES, 5, ["company"])
    mi = mi.withColumn("mean_mi", F.avg("mi").over(Window.partitionBy("company", "lag")))  # one row per source
    rank = F.dense_rank().over(Window.partitionBy("company").orderBy(F.desc("mean_mi"), "lag"))
    return mi.select("company", "source", "lag", "n", F.round("mi", 6).alias("mi"), F.round("mean_mi", 6).alias("mean_mi"), rank.cast("long").alias("rank"), (rank <= 2).alias("selected"))


QUERIES["g15_select_lags"] = g15_select_lags
ORACLES["g15_select_lags"] = f"""WITH {V_PANEL_SQL},
pl AS (SELECT company, ret, {_LAGGED_SQL} FROM v_panel),
d AS (SELECT * FROM ({_MI_PAIRS}) WHERE x IS NOT NULL AND y IS NOT NULL),
rg AS (SELECT company, source, lag, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM d GROUP BY ALL),
b AS (SELECT d.company, d.source, d.lag, rg.n,
        CAST(CASE WHEN x1 - x0 = 0 THEN 0 ELSE least(floor((x - x0) / (x1 - x0) * 10), 9) END AS INTEGER) AS bx,
        CAST(CASE WHEN y1 - y0 = 0 THEN 0 ELSE least(floor((y - y0) / (y1 - y0) * 10), 9) END AS INTEGER) AS by_
      FROM d JOIN rg USING (company, source, lag)),
j AS (SELECT company, source, lag, n, bx, by_, count(*) AS c FROM b GROUP BY ALL),
jm AS (SELECT *, sum(c) OVER (PARTITION BY company, source, lag, bx) AS cx,
              sum(c) OVER (PARTITION BY company, source, lag, by_) AS cy FROM j),
mi AS (SELECT company, source, lag, sum(c / n * ln(c * n / (cx * cy))) AS mi FROM jm GROUP BY ALL),
sc AS (SELECT company, lag, avg(mi) AS mean_mi FROM mi GROUP BY ALL)
SELECT company, lag, round(mean_mi, 6) AS mean_mi,
       row_number() OVER (PARTITION BY company ORDER BY mean_mi DESC, lag) AS rank,
       row_number() OVER (PARTITION BY company ORDER BY mean_mi DESC, lag) <= 2 AS selected FROM sc"""
# all pairs of points of a series; psi(n) as a sum of reciprocals
QUERIES["g15_neighbour_lags"] = g15_neighbour_lags
ORACLES["g15_neighbour_lags"] = f"""WITH {V_PANEL_SQL},
pl AS (SELECT company, ret, {_LAGGED_SQL} FROM v_panel),
d AS MATERIALIZED (SELECT *, row_number() OVER () AS i FROM ({_MI_PAIRS}) WHERE x IS NOT NULL AND y IS NOT NULL),
st AS (SELECT company, source, lag, count(*) AS n, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sx, CASE WHEN stddev_pop(y) > 0 THEN stddev_pop(y) ELSE 1 END AS sy FROM d GROUP BY ALL),
e AS MATERIALIZED (SELECT a.i, a.company, a.source, a.lag, any_value(a.x) AS x, any_value(a.y) AS y, any_value(sx) AS sx, any_value(sy) AS sy,
        min(greatest(abs(a.x - b.x) / sx, abs(a.y - b.y) / sy), 3)[3] AS eps
      FROM d a JOIN d b ON a.company = b.company AND a.source = b.source AND a.lag = b.lag AND a.i <> b.i
      JOIN st ON st.company = a.company AND st.source = a.source AND st.lag = a.lag GROUP BY a.i, a.company, a.source, a.lag),
c AS (SELECT e.i, e.company, e.source, e.lag, count(CASE WHEN abs(e.x - b.x) / sx < eps OR (eps = 0 AND e.x = b.x) THEN 1 END) AS nx,
        count(CASE WHEN abs(e.y - b.y) / sy < eps OR (eps = 0 AND e.y = b.y) THEN 1 END) AS ny
      FROM e JOIN d b ON e.company = b.company AND e.source = b.source AND e.lag = b.lag AND e.i <> b.i GROUP BY e.i, e.company, e.source, e.lag),
psi AS MATERIALIZED (SELECT n, sum(1.0 / (n - 1)) OVER (ORDER BY n) - 0.5772156649015329 AS p FROM (SELECT unnest(range(2, (SELECT max(n) + 2 FROM st))) AS n)
      UNION ALL SELECT 1, -0.5772156649015329),
s AS (SELECT company, source, lag, avg(a.p + b.p) AS s FROM c JOIN psi a ON a.n = nx + 1 JOIN psi b ON b.n = ny + 1 GROUP BY ALL),
mi AS (SELECT company, source, lag, st.n, CASE WHEN s IS NULL THEN NULL ELSE greatest(0, a.p + b.p - s) END AS mi
       FROM st LEFT JOIN s USING (company, source, lag) JOIN psi a ON a.n = st.n JOIN psi b ON b.n = 3),
mm AS (SELECT *, avg(mi) OVER (PARTITION BY company, lag) AS mean_mi FROM mi)
SELECT company, source, lag, n, round(mi, 6) AS mi, round(mean_mi, 6) AS mean_mi,
       dense_rank() OVER (PARTITION BY company ORDER BY mean_mi DESC, lag) AS rank,
       dense_rank() OVER (PARTITION BY company ORDER BY mean_mi DESC, lag) <= 2 AS selected FROM mm"""
