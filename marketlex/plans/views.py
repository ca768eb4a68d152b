"""Derived tables over the driver's parquet tables, in Spark and in SQL.

Each view exists twice: a DataFrame builder (used by the registered
queries) and a SQL CTE body (used by the DuckDB oracles).  Both read the
whole base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlex.operators import market

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


# Tables whose rows carry long texts: row-local work on them is CPU-bound.
TEXT_TABLES = ("documents", "events", "pages", "conversations", "benchmark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-bound row-local work (regex, folds) all cores: when a scan
    yields fewer partitions than the cluster's parallelism (a few large
    row groups), redistribute round-robin.  On a many-file table the scan
    is already wide and this is a no-op."""
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # sessions without RDD access: keep the scan as it is
        return df
    return df.repartition(par) if n < par else df


# ----------------------------------------------------------------- v_tweets
def v_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tweet-like rows built from ``events``: mention, hashtag, cashtag, t.co
    link, emoji and emoticon around the JSON props."""
    e = table(spark, sf_dir, "events")
    text = F.concat(
        F.lit("@user"), F.col("user_id").cast("string"), F.lit(" zysk!!  #"),
        F.col("event_type"), F.lit(" $TCK"), (F.col("event_id") % 7).cast("string"),
        F.lit(" https://t.co/"), F.col("event_id").cast("string"), F.lit(" 🚀 :) "),
        F.col("props"))
    return e.select(F.col("event_id").alias("id"), text.alias("text"),
                    F.col("event_type").alias("company"), F.to_date("ts").alias("date"))


V_TWEETS_SQL = """v_tweets AS (
  SELECT event_id AS id,
         '@user' || CAST(user_id AS VARCHAR) || ' zysk!!  #' || event_type || ' $TCK'
           || CAST(event_id % 7 AS VARCHAR) || ' https://t.co/' || CAST(event_id AS VARCHAR)
           || ' 🚀 :) ' || props AS text,
         event_type AS company, CAST(ts AS DATE) AS date
  FROM events)"""


# --------------------------------------------------------------- v_labelled
def v_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return (d.join(lab, "doc_id")
            .select(F.col("doc_id").alias("id"), "text", "lang",
                    (F.col("quality") + F.col("toxic")).cast("int").alias("label")))


V_LABELLED_SQL = """v_labelled AS (
  SELECT d.doc_id AS id, d.text, d.lang, CAST(l.quality + l.toxic AS INTEGER) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


# ----------------------------------------------------------------- v_scored
def v_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 10.0)
    return (v_labelled(spark, sf_dir)
            .join(emb.select(F.col("vec_id").alias("id"), logits.alias("logits")), "id"))


V_SCORED_SQL = V_LABELLED_SQL + """,
v_scored AS (
  SELECT v.id, v.text, v.lang, v.label,
         [CAST(e.embedding[1] AS DOUBLE) * 10.0, CAST(e.embedding[2] AS DOUBLE) * 10.0,
          CAST(e.embedding[3] AS DOUBLE) * 10.0] AS logits
  FROM v_labelled v JOIN embeddings e ON v.id = e.vec_id)"""


# ------------------------------------------------------------------- v_ohlc
def v_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per ``company = o_orderstatus`` from ``orders``."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderstatus").alias("company"),
                      F.to_date("o_orderdate").alias("date"))
            .agg(F.min_by("o_totalprice", "o_orderkey").alias("open"),
                 F.max("o_totalprice").alias("high"),
                 F.min("o_totalprice").alias("low"),
                 F.max_by("o_totalprice", "o_orderkey").alias("close"),
                 F.count(F.lit(1)).cast("double").alias("volume")))


V_OHLC_SQL = """v_ohlc AS (
  SELECT o_orderstatus AS company, CAST(o_orderdate AS DATE) AS date,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""


# ------------------------------------------------------------------ v_panel
def v_tweet_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily 'tweet' variables: order counts and mean price by priority."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.to_date("o_orderdate").alias("date"))
            .agg(F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).cast("double").alias("n_urgent"),
                 F.count(F.when(F.col("o_orderpriority") == "5-LOW", 1)).cast("double").alias("n_low"),
                 F.avg("o_totalprice").alias("avg_price")))


def v_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_ohlc with returns, densified to a calendar per company."""
    feats = market.price_features(v_ohlc(spark, sf_dir))
    return market.densify_calendar(feats)


def v_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_features(spark, sf_dir).join(v_tweet_vars(spark, sf_dir), "date", "left")


V_FEATURES_SQL = V_OHLC_SQL + """,
feat AS (
  SELECT company, date, open, high, low, close, volume,
         close / lag(close) OVER w - 1 AS ret,
         (close - open) / open AS same_day_return,
         (close - lag(open) OVER w) / close AS overnight_return,
         close - lag(close) OVER w AS change,
         CASE WHEN close / lag(close) OVER w - 1 > 0 THEN 1 ELSE -1 END AS direction,
         CASE WHEN open <> 0 THEN (high - low) / open ELSE 0 END AS volatility
  FROM v_ohlc WINDOW w AS (PARTITION BY company ORDER BY date)),
cal AS (
  SELECT company, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM v_ohlc GROUP BY company),
v_features AS (
  SELECT c.company, c.date, f.open, f.high, f.low, f.close, f.volume, f.ret,
         f.same_day_return, f.overnight_return, f.change, f.direction, f.volatility,
         dayname(c.date) AS weekday, f.close IS NOT NULL AS is_trading_day
  FROM cal c LEFT JOIN feat f ON c.company = f.company AND c.date = f.date)"""

V_PANEL_SQL = V_FEATURES_SQL + """,
tw AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CAST(count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS DOUBLE) AS n_urgent,
         CAST(count(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) AS DOUBLE) AS n_low,
         avg(o_totalprice) AS avg_price
  FROM orders GROUP BY 1),
v_panel AS (SELECT f.*, tw.n_urgent, tw.n_low, tw.avg_price FROM v_features f LEFT JOIN tw USING (date))"""


# ------------------------------------------------------------------- v_runs
def v_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment-result rows derived from ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("run_id"),
        F.lit(12).alias("train_seed"),
        F.col("l_linenumber").alias("model_seed"),
        (1 - F.col("l_discount")).alias("accuracy"),
        (1 - F.col("l_tax") - F.col("l_discount")).alias("macro_f1"),
        (F.col("l_quantity") / 50.0).alias("weighted_f1"),
        (1 - F.col("l_tax")).alias("neutral_f1"),
        (F.col("l_quantity") / 60.0 + F.col("l_tax")).alias("positive_f1"),
        (F.col("l_discount") + F.col("l_tax")).alias("negative_f1"),
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("dataset"),
        (F.col("l_discount") / 1000.0).alias("learning_rate"),
        (8 * (F.col("l_linenumber") % 3 + 1)).alias("batch_size"),
        (F.col("l_tax") / 10.0).alias("weight_decay"))


V_RUNS_SQL = """v_runs AS (
  SELECT l_orderkey AS run_id, 12 AS train_seed, l_linenumber AS model_seed,
         1 - l_discount AS accuracy, 1 - l_tax - l_discount AS macro_f1,
         l_quantity / 50.0 AS weighted_f1, 1 - l_tax AS neutral_f1,
         l_quantity / 60.0 + l_tax AS positive_f1, l_discount + l_tax AS negative_f1,
         l_returnflag AS model, l_linestatus AS dataset,
         l_discount / 1000.0 AS learning_rate, 8 * (l_linenumber % 3 + 1) AS batch_size,
         l_tax / 10.0 AS weight_decay
  FROM lineitem)"""
