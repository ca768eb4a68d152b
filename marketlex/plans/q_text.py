"""Registered text queries (T1-T18, P3) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlex.functions import text as tx
from marketlex.functions.lexicon import EMOTICONS
from marketlex.operators import cleaning
from marketlex.operators.textops import preprocess_variants, BASIC_VARIANTS
from marketlex.plans import sqlutil as q
from marketlex.plans.views import V_TWEETS_SQL, table, v_tweets

# Query parameter: a stop list for the four languages of the test corpus
# (the operator takes any list; the reference's Polish list is a user input).
TEST_STOPWORDS = ("the", "and", "of", "is", "on", "a", "to", "le", "la", "les", "de",
                  "des", "et", "der", "die", "und", "das", "el", "los", "y", "en")

QUERIES = {}
ORACLES = {}


def _tweet_query(name, fn, sqlfn):
    def run(spark, sf_dir):
        return v_tweets(spark, sf_dir).select("id", fn(F.col("text")).alias("text"))
    QUERIES[name] = run
    ORACLES[name] = f"WITH {V_TWEETS_SQL} SELECT id, {sqlfn('text')} AS text FROM v_tweets"


_tweet_query("t01_replace_emoji", tx.replace_emoji, lambda t: q.replace_pairs(t, EMOTICONS))
_tweet_query("t02_strip_urls", tx.strip_urls, q.strip_urls)
_tweet_query("t03_strip_hashtags", tx.strip_hashtags, q.strip_hashtags)
_tweet_query("t04_strip_mentions", tx.strip_mentions, q.strip_mentions)
_tweet_query("t05_strip_cashtags", tx.strip_cashtags, q.strip_cashtags)
_tweet_query("t06_keep_polish_text", tx.keep_polish_text, q.keep_polish_text)
_tweet_query("t08_normalize_whitespace", tx.normalize_whitespace, q.normalize_whitespace)
_tweet_query("t09_sentence_case", tx.sentence_case, q.sentence_case)
_tweet_query("t10_strip_tco", tx.strip_tco, q.strip_tco)
_tweet_query("t11_clean_text_full", tx.clean_text_full, q.clean_text_full)
_tweet_query("t12_clean_text_basic", tx.clean_text_basic, q.clean_text_basic)


def t07_collapse_repeats(spark, sf_dir):
    """T7 over whole documents (long texts, four languages) and tweets."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return d.select("id", tx.collapse_repeats("text").alias("text"))


QUERIES["t07_collapse_repeats"] = t07_collapse_repeats
ORACLES["t07_collapse_repeats"] = (
    "WITH x AS (SELECT doc_id AS id, string_split(text, '') AS cs FROM documents) "
    f"SELECT id, {q.collapse_chars('cs')} AS text FROM x")


def t09_sentence_case_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), tx.sentence_case("text").alias("text"))


QUERIES["t09_sentence_case_documents"] = t09_sentence_case_documents
ORACLES["t09_sentence_case_documents"] = (
    f"SELECT doc_id AS id, {q.sentence_case('text')} AS text FROM documents")


def t13_remove_stopwords(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"),
                    tx.remove_stopwords("text", TEST_STOPWORDS).alias("text"))


QUERIES["t13_remove_stopwords"] = t13_remove_stopwords
ORACLES["t13_remove_stopwords"] = (
    f"SELECT doc_id AS id, {q.remove_stopwords('text', TEST_STOPWORDS)} AS text FROM documents")


def t18_text_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), tx.text_length("text").cast("long").alias("n_chars"),
                    tx.token_count("text").cast("long").alias("n_tokens"))


QUERIES["t18_text_length"] = t18_text_length
ORACLES["t18_text_length"] = (
    f"SELECT doc_id AS id, CAST(length(text) AS BIGINT) AS n_chars, "
    f"CAST(len({q.tokens('text')}) AS BIGINT) AS n_tokens FROM documents")


def text_profile(spark, sf_dir):
    """Minimum slice: basic cleaning -> whitespace -> stop words -> keep first
    copy of each text -> token-length profile (count, p95, max) per language."""
    d = table(spark, sf_dir, "documents")
    kept = tx.kept_tokens(tx.normalize_whitespace(tx.clean_text_basic("text")), TEST_STOPWORDS)
    cleaned = d.select("doc_id", "lang", kept.alias("_k")).select(
        "doc_id", "lang", F.array_join("_k", " ").alias("text"), F.size("_k").alias("n_tokens"))
    # the texts go no further than their digests: one pass, a narrow shuffle
    first = cleaning.first_per_key(cleaned, "text", "doc_id", ["lang", "n_tokens", F.length("text").alias("n_chars")])
    return (first.groupBy("lang")
            .agg(F.count(F.lit(1)).alias("n_docs"),
                 F.percentile("n_tokens", 0.95).alias("p95_tokens"),
                 F.max("n_tokens").cast("long").alias("max_tokens"),
                 F.round(F.avg("n_chars"), 6).alias("avg_chars")))


QUERIES["text_profile"] = text_profile
ORACLES["text_profile"] = f"""
WITH c AS (
  SELECT doc_id, lang, {q.remove_stopwords(q.normalize_whitespace(q.clean_text_basic('text')), TEST_STOPWORDS)} AS text
  FROM documents),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM c) WHERE rn = 1)
SELECT lang, count(*) AS n_docs, quantile_cont(len({q.tokens('text')}), 0.95) AS p95_tokens,
       CAST(max(len({q.tokens('text')})) AS BIGINT) AS max_tokens, round(avg(length(text)), 6) AS avg_chars
FROM f GROUP BY lang"""


def p3_dedup_by_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return cleaning.dedup_by_key(d, "text", "doc_id").select("doc_id", "lang", "n_chars")


QUERIES["p3_dedup_by_text"] = p3_dedup_by_text
ORACLES["p3_dedup_by_text"] = """
SELECT doc_id, lang, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"""


def t15_preprocess_variants(spark, sf_dir):
    """Every single-step variant of every tweet from one scan."""
    return preprocess_variants(v_tweets(spark, sf_dir), BASIC_VARIANTS, "id", "text")


_VARIANT_SQL = {
    "No_processing": lambda t: t,
    "No_processing_emoji": lambda t: q.replace_pairs(t, EMOTICONS),
    "No_processing_http": q.strip_urls,
    "No_processing_hashtag": q.strip_hashtags,
    "No_processing_mention": q.strip_mentions,
    "No_processing_cashtag": q.strip_cashtags,
    "No_processing__text": q.keep_polish_text,
    "No_processing__rep": lambda t: q.collapse_chars(f"string_split({t}, '')"),
    "No_processing_norm": q.normalize_whitespace,
    "No_processing_caps": q.sentence_case,
    "Basic_processing": q.clean_text_basic,
}
QUERIES["t15_preprocess_variants"] = t15_preprocess_variants
T15_SQL = f"WITH {V_TWEETS_SQL} " + " UNION ALL ".join(
    f"SELECT id, {q.lit(name)} AS variant, {fn('text')} AS text FROM v_tweets "
    for name, fn in _VARIANT_SQL.items())
ORACLES["t15_preprocess_variants"] = T15_SQL


def t16_token_lengths(spark, sf_dir):
    """Token count p95 and max over the corpus, per language."""
    d = table(spark, sf_dir, "documents")
    n = tx.token_count("text")
    return d.groupBy("lang").agg(F.percentile(n, 0.95).alias("p95_tokens"),
                                 F.max(n).cast("long").alias("max_tokens"))


QUERIES["t16_token_lengths"] = t16_token_lengths
ORACLES["t16_token_lengths"] = f"""
SELECT lang, quantile_cont(len({q.tokens('text')}), 0.95) AS p95_tokens,
       CAST(max(len({q.tokens('text')})) AS BIGINT) AS max_tokens FROM documents GROUP BY lang"""
