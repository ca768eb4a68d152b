"""Registered market-feature queries over ``v_ohlc`` / ``v_features`` / ``v_panel``."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlex.operators import cleaning, market, segments
from marketlex.plans.views import (V_FEATURES_SQL, V_OHLC_SQL, V_PANEL_SQL, table, v_features, v_ohlc,
                                   v_panel)

QUERIES = {}
ORACLES = {}

FEATS = ("ret", "same_day_return", "overnight_return", "change", "volatility")
SPLIT_DATE = "1999-01-01"


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def w01_price_features(spark, sf_dir):
    f = v_features(spark, sf_dir).select("company", "date", *FEATS, "direction", "weekday", "is_trading_day")
    return _r6(f, FEATS)


QUERIES["w01_price_features"] = w01_price_features
ORACLES["w01_price_features"] = (
    f"WITH {V_FEATURES_SQL} SELECT company, date, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in FEATS)
    + ", direction, weekday, is_trading_day FROM v_features")


def w01_price_features_segmented(spark, sf_dir):
    """The features of every trading day from windows over one month each."""
    f = market.price_features(v_ohlc(spark, sf_dir), segment=segments.month("date"))
    return _r6(f.select("company", "date", *FEATS, "direction"), FEATS)


QUERIES["w01_price_features_segmented"] = w01_price_features_segmented
ORACLES["w01_price_features_segmented"] = (
    f"WITH {V_FEATURES_SQL} SELECT company, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATS) + ", direction FROM feat")


def j3_densify_calendar(spark, sf_dir):
    f = v_features(spark, sf_dir)
    return f.groupBy("company").agg(F.count(F.lit(1)).alias("n_days"),
                                    F.count(F.when(F.col("is_trading_day"), 1)).alias("n_trading"),
                                    F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                                    F.count(F.when(F.col("weekday") == "Sunday", 1)).alias("n_sundays"))


QUERIES["j3_densify_calendar"] = j3_densify_calendar
ORACLES["j3_densify_calendar"] = (
    f"WITH {V_FEATURES_SQL} SELECT company, count(*) AS n_days, count(CASE WHEN is_trading_day THEN 1 END) AS n_trading, "
    "min(date) AS first_date, max(date) AS last_date, count(CASE WHEN weekday = 'Sunday' THEN 1 END) AS n_sundays "
    "FROM v_features GROUP BY company")

LAG_COLS = ("n_urgent", "avg_price")
MAX_LAG = 5


def _lags_out(df):
    names = [f"{c}_lag_{i}" for i in range(1, MAX_LAG + 1) for c in LAG_COLS]
    return _r6(df.select("company", "date", *names), names)


def j4_calendar_lags(spark, sf_dir):
    """General path: explode to target dates + one join."""
    return _lags_out(market.calendar_lags(v_panel(spark, sf_dir), LAG_COLS, MAX_LAG))


def j4_calendar_lags_dense(spark, sf_dir):
    """Dense-calendar path: window lags, no join."""
    return _lags_out(market.calendar_lags(v_panel(spark, sf_dir), LAG_COLS, MAX_LAG, dense=True))


_J4_SQL = (f"WITH {V_PANEL_SQL} SELECT p.company, p.date, "
           + ", ".join(f"round(CASE WHEN p.is_trading_day THEN l{i}.{c} END, 6) AS {c}_lag_{i}"
                       for i in range(1, MAX_LAG + 1) for c in LAG_COLS)
           + " FROM v_panel p "
           + " ".join(f"LEFT JOIN v_panel l{i} ON l{i}.company = p.company AND l{i}.date = p.date - {i}"
                      for i in range(1, MAX_LAG + 1)) + " WHERE p.is_trading_day")
QUERIES["j4_calendar_lags"] = j4_calendar_lags
ORACLES["j4_calendar_lags"] = _J4_SQL
QUERIES["j4_calendar_lags_dense"] = j4_calendar_lags_dense
ORACLES["j4_calendar_lags_dense"] = _J4_SQL


def j4_calendar_lags_first(spark, sf_dir):
    """Many rows a day: the day's value is that of its first order."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("company"), F.to_date("o_orderdate").alias("date"), "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"), F.lit(True).alias("is_trading_day"))
    lagged = market.calendar_lags(o, ["price"], 3, order="o_orderkey")
    return lagged.select("company", "date", "o_orderkey", *[f"price_lag_{i}" for i in (1, 2, 3)])


QUERIES["j4_calendar_lags_first"] = j4_calendar_lags_first
ORACLES["j4_calendar_lags_first"] = """WITH o AS (
  SELECT o_orderstatus AS company, CAST(o_orderdate AS DATE) AS date, o_orderkey,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price FROM orders),
f AS (SELECT company, date, price FROM o QUALIFY row_number() OVER (PARTITION BY company, date ORDER BY o_orderkey) = 1)
SELECT o.company, o.date, o.o_orderkey, a.price AS price_lag_1, b.price AS price_lag_2, c.price AS price_lag_3
FROM o LEFT JOIN f a ON a.company = o.company AND a.date = o.date - 1
       LEFT JOIN f b ON b.company = o.company AND b.date = o.date - 2
       LEFT JOIN f c ON c.company = o.company AND c.date = o.date - 3"""


def w07_row_lags(spark, sf_dir):
    d = market.row_lags(v_ohlc(spark, sf_dir).select("company", "date", "close"), ["close"], 3)
    return _r6(d, [f"close_lag_{i}" for i in (1, 2, 3)])


QUERIES["w07_row_lags"] = w07_row_lags
ORACLES["w07_row_lags"] = (
    f"WITH {V_OHLC_SQL} SELECT company, date, round(close, 6) AS close, "
    + ", ".join(f"round(lag(close, {i}) OVER (PARTITION BY company ORDER BY date), 6) AS close_lag_{i}"
                for i in (1, 2, 3)) + " FROM v_ohlc")


def w07_row_lags_segmented(spark, sf_dir):
    """Every order as a row of its status's series, cut by month: no task
    holds a series."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("company"), F.to_date("o_orderdate").alias("date"), "o_orderkey", F.col("o_totalprice").alias("price"))
    return market.row_lags(o, ["price"], 5, order=["date", "o_orderkey"], segment=segments.month("date"))


QUERIES["w07_row_lags_segmented"] = w07_row_lags_segmented
ORACLES["w07_row_lags_segmented"] = (
    "SELECT o_orderstatus AS company, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice AS price, "
    + ", ".join(f"lag(o_totalprice, {i}) OVER w AS price_lag_{i}" for i in range(1, 6))
    + " FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY CAST(o_orderdate AS DATE), o_orderkey)")


def w08_zscore_filter(spark, sf_dir):
    p = cleaning.drop_incomplete(v_panel(spark, sf_dir).select("company", "date", "ret", "n_urgent"),
                                 ["ret", "n_urgent"])
    return market.zscore_filter(p, ["ret", "n_urgent"], ["company"]).select("company", "date")


QUERIES["w08_zscore_filter"] = w08_zscore_filter
ORACLES["w08_zscore_filter"] = f"""WITH {V_PANEL_SQL},
p AS (SELECT company, date, ret, n_urgent FROM v_panel WHERE ret IS NOT NULL AND n_urgent IS NOT NULL),
s AS (SELECT company, avg(ret) AS mr, stddev_pop(ret) AS sr, avg(n_urgent) AS mu, stddev_pop(n_urgent) AS su
      FROM p GROUP BY company)
SELECT p.company, p.date FROM p JOIN s USING (company)
WHERE abs((ret - mr) / sr) < 3 AND abs((n_urgent - mu) / su) < 3"""


def _trading_split(spark, sf_dir):
    f = v_features(spark, sf_dir).filter("is_trading_day").select("company", "date", "ret", "volatility", "volume")
    f = cleaning.drop_incomplete(f, ["ret"])
    return f.filter(F.col("date") < SPLIT_DATE), f.filter(F.col("date") >= SPLIT_DATE)


def w09_winsorize(spark, sf_dir):
    train, test = _trading_split(spark, sf_dir)
    tr, (te,), _ = market.winsorize(train, [test], ["ret", "volatility"], 5, 95)
    out = tr.withColumn("part", F.lit("train")).unionByName(te.withColumn("part", F.lit("test")))
    return _r6(out.select("company", "date", "part", "ret", "volatility"), ["ret", "volatility"])


_SPLIT_SQL = f"""WITH {V_FEATURES_SQL},
f AS (SELECT company, date, ret, volatility, volume, CASE WHEN date < DATE '{SPLIT_DATE}' THEN 'train' ELSE 'test' END AS part
      FROM v_features WHERE is_trading_day AND ret IS NOT NULL)"""
QUERIES["w09_winsorize"] = w09_winsorize
ORACLES["w09_winsorize"] = _SPLIT_SQL + """,
b AS (SELECT quantile_cont(ret, 0.05) AS rl, quantile_cont(ret, 0.95) AS rh,
             quantile_cont(volatility, 0.05) AS vl, quantile_cont(volatility, 0.95) AS vh FROM f WHERE part = 'train')
SELECT company, date, part, round(least(greatest(ret, rl), rh), 6) AS ret,
       round(least(greatest(volatility, vl), vh), 6) AS volatility FROM f, b"""


def w10_standardize(spark, sf_dir):
    train, test = _trading_split(spark, sf_dir)
    tr, (te,), _ = market.standardize(train, [test], ["ret", "volume"])
    out = tr.withColumn("part", F.lit("train")).unionByName(te.withColumn("part", F.lit("test")))
    return _r6(out.select("company", "date", "part", "ret", "volume"), ["ret", "volume"])


QUERIES["w10_standardize"] = w10_standardize
ORACLES["w10_standardize"] = _SPLIT_SQL + """,
b AS (SELECT avg(ret) AS mr, stddev_pop(ret) AS sr, avg(volume) AS mv, stddev_pop(volume) AS sv FROM f WHERE part = 'train')
SELECT company, date, part, round((ret - mr) / CASE WHEN sr = 0 THEN 1 ELSE sr END, 6) AS ret,
       round((volume - mv) / CASE WHEN sv = 0 THEN 1 ELSE sv END, 6) AS volume FROM f, b"""


def r5_chronological_split(spark, sf_dir):
    o = v_ohlc(spark, sf_dir).select("company", "date")
    s = market.chronological_split(o, ["date", "company"], F.col("date"), 0.7, 0.1)
    return s.select("company", "date", "part")


QUERIES["r5_chronological_split"] = r5_chronological_split
ORACLES["r5_chronological_split"] = f"""WITH {V_OHLC_SQL},
r AS (SELECT company, date, row_number() OVER (ORDER BY date, company) AS pos, count(*) OVER () AS n FROM v_ohlc)
SELECT company, date, CASE WHEN pos <= floor(n * 0.7) THEN 'train'
                           WHEN pos <= floor(n * 0.7) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS part FROM r"""


def p07_recode(spark, sf_dir):
    o = v_ohlc(spark, sf_dir)
    r = o.select(cleaning.recode("company", {"F": "filled", "O": "open"}).alias("status"),
                 cleaning.recode("company", {"F": "filled"}, keep_unmapped=False).alias("mapped"))
    return r.groupBy("status", "mapped").agg(F.count(F.lit(1)).alias("n"))


QUERIES["p07_recode"] = p07_recode
ORACLES["p07_recode"] = (
    f"WITH {V_OHLC_SQL} SELECT CASE company WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE company END AS status, "
    "CASE company WHEN 'F' THEN 'filled' END AS mapped, count(*) AS n FROM v_ohlc GROUP BY ALL")


def p10_profile(spark, sf_dir):
    f = v_panel(spark, sf_dir).select("ret", "change", "direction", "n_urgent", "avg_price")
    return cleaning.profile(f).select("column", "dtype", "non_null", "distinct_values")


QUERIES["p10_profile"] = p10_profile
ORACLES["p10_profile"] = f"""WITH {V_PANEL_SQL}
SELECT "column", CASE WHEN "column" = 'direction' THEN 'int' ELSE 'double' END AS dtype, count(v) AS non_null, count(DISTINCT v) AS distinct_values FROM ("""
ORACLES["p10_profile"] += " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS v FROM v_panel" for c in ("ret", "change", "direction", "n_urgent", "avg_price")) + ") GROUP BY ALL"
