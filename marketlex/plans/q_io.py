"""Registered queries for sources/sinks, streaming, dictionary lookups,
fixed-length encoding, user Python steps and ML cross-validation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlex.functions import text as tx
from marketlex.operators import results as R
from marketlex.operators import lemmas, sampling, scoring, spelling, textops
from marketlex.operators.ml import METRIC_COLS, cross_validate
from marketlex.operators.trainer import train_grid
from marketlex.plans import sqlutil as q
from marketlex.plans.q_text import T15_SQL
from marketlex.plans.views import (V_LABELLED_SQL, V_OHLC_SQL, V_RUNS_SQL, V_SCORED_SQL, V_TWEETS_SQL, table,
                                   v_labelled, v_ohlc, v_runs, v_scored, v_tweets)
from marketlex.session import checkpoint_dir, materialize
from marketlex.sources import files, sinks
from marketlex.streaming import text_stream

QUERIES = {}
ORACLES = {}


def _scratch(spark, what: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


# ------------------------------------------------------------- S2 / S4
def s2_read_results_dir(spark, sf_dir):
    """Group means written as a directory of CSV files, read back by S2."""
    g = R.group_mean(v_runs(spark, sf_dir), ["model", "dataset"], [*R.METRICS, "learning_rate"], digits=6)
    seeds = [F.lit(12).alias("train_seed"), F.lit(42).alias("model_seed")]
    d = _scratch(spark, "results-csv")
    # three headers in one directory: as stored, columns swapped, a grid-run column more
    for model, cols in (("A", [*seeds, *R.METRICS, "model", "dataset"]),
                        ("N", ["dataset", "model", *reversed(R.METRICS), *reversed(seeds)]),
                        ("R", [*seeds, *R.METRICS, "model", "dataset", "learning_rate"])):
        g.filter(F.col("model") == model).select(*cols).repartition(2).write.mode("append").option("header", True).csv(d)
    return files.read_results_dir(spark, d).select("train_seed", "model_seed", *R.METRICS, "model", "dataset", "learning_rate")


QUERIES["s2_read_results_dir"] = s2_read_results_dir
ORACLES["s2_read_results_dir"] = (
    f"WITH {V_RUNS_SQL} SELECT 12 AS train_seed, 42 AS model_seed, "
    + ", ".join(f"round(avg({m}), 6) AS {m}" for m in R.METRICS)
    + ", model, dataset, CASE WHEN model = 'R' THEN round(avg(learning_rate), 6) END AS learning_rate FROM v_runs GROUP BY model, dataset")


def s4_write_results(spark, sf_dir):
    """Fold-mean rows appended to a partitioned result table and read back."""
    g = R.mean_over_folds(v_runs(spark, sf_dir), ["model", "dataset", "model_seed"], ["weighted_f1"])
    d = _scratch(spark, "results-parquet")
    sinks.write_results(g, d, run_id="run-1")
    back = spark.read.parquet(d)
    return back.select("model", "dataset", "model_seed", F.round("weighted_f1", 6).alias("weighted_f1"), "run_id")


QUERIES["s4_write_results"] = s4_write_results
ORACLES["s4_write_results"] = (
    f"WITH {V_RUNS_SQL} SELECT model, dataset, model_seed, round(avg(weighted_f1), 6) AS weighted_f1, "
    "'run-1' AS run_id FROM v_runs GROUP BY ALL")


def s5_materialize_variants(spark, sf_dir):
    """All variants of every tweet and two Python steps cached, then read
    from the cache."""
    root = _scratch(spark, "variants")
    tweets = v_tweets(spark, sf_dir).select("id", "text")
    steps = {**textops.BASIC_VARIANTS, "Python_step": [textops.python_step(str.upper)]}
    out = None
    for _ in range(2):  # the second call only reads
        cache = sinks.materialize_variants(spark, tweets, steps, root)
    other = sinks.materialize_variants(spark, tweets, {"Python_step": [textops.python_step(str.lower)]}, root)
    for name, d in [*cache.items(), ("Python_step_2", other["Python_step"])]:
        d = d.select("id", F.lit(name).alias("variant"), "text")
        out = d if out is None else out.unionByName(d)
    return out


QUERIES["s5_materialize_variants"] = s5_materialize_variants
ORACLES["s5_materialize_variants"] = (T15_SQL + "UNION ALL SELECT id, 'Python_step', upper(text) FROM v_tweets "
                                      "UNION ALL SELECT id, 'Python_step_2', lower(text) FROM v_tweets")


def s6_write_misclassified(spark, sf_dir):
    m = scoring.misclassified(v_scored(spark, sf_dir))
    d = _scratch(spark, "errors")
    sinks.write_misclassified(m.select("index", "true_label", "predicted_label", "text_length"), d)
    return spark.read.option("header", True).schema(
        "index long, true_label int, predicted_label int, text_length int").csv(d)


_AM = "CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER)"
QUERIES["s6_write_misclassified"] = s6_write_misclassified
ORACLES["s6_write_misclassified"] = (
    f"WITH {V_SCORED_SQL} SELECT id AS \"index\", label AS true_label, {_AM} AS predicted_label, "
    f"CAST(length(text) AS INTEGER) AS text_length FROM v_scored WHERE {_AM} <> label")


# ------------------------------------------------------------ streaming
def s10_stream_clean_documents(spark, sf_dir):
    """Documents as a file stream, cleaned by the batch Columns (T11),
    drained once with ``availableNow`` into a parquet table."""
    schema = table(spark, sf_dir, "documents").schema
    # as a pattern the path may be one file or a folder of files
    st = text_stream.read_stream(spark, f"{sf_dir.rstrip('/')}/documents.parque[t]", schema, max_files=spark.sparkContext.defaultParallelism)
    cleaned = text_stream.clean_stream(st, [tx.clean_text_full], "doc_id", "text")
    out = text_stream.run_to_table(cleaned, _scratch(spark, "stream-out"), uuid.uuid4().hex)
    return spark.read.schema(cleaned.schema).parquet(out)


QUERIES["s10_stream_clean_documents"] = s10_stream_clean_documents
ORACLES["s10_stream_clean_documents"] = f"SELECT doc_id AS id, {q.clean_text_full('text')} AS text FROM documents"


def s7_stream_eval_log(spark, sf_dir):
    """Scored rows as a stream; each micro-batch appends its metrics."""
    sc = v_scored(spark, sf_dir)
    src = _scratch(spark, "scored-src")
    sc.repartition(4).write.parquet(src)
    st = text_stream.read_stream(spark, src, spark.read.parquet(src).schema, max_files=1)
    log = text_stream.eval_log_stream(st, _scratch(spark, "evallog"), uuid.uuid4().hex)
    return spark.read.parquet(log).drop("run")


def s7_eval_log_totals(spark, sf_dir):
    """The stream's log summed over its batches: whatever the batches, rows
    and correct predictions add up."""
    log = s7_stream_eval_log(spark, sf_dir)
    return log.agg(F.sum("n").cast("long").alias("n"), F.round(F.sum(F.col("accuracy") * F.col("n")), 6).alias("n_correct"))


def s7_append_eval_log(spark, sf_dir):
    """One metrics row per language appended to a CSV log, read back."""
    log = _scratch(spark, "evallog-csv")
    m = scoring.classification_metrics(v_scored(spark, sf_dir).withColumn("pred", scoring.argmax("logits")), group_cols=["lang"])
    sinks.append_eval_log(m.select("lang", F.round("accuracy", 6).alias("accuracy")), log)
    return spark.read.option("header", True).schema("lang string, accuracy double").csv(log)


QUERIES["s7_stream_eval_log"] = s7_stream_eval_log
QUERIES["s7_eval_log_totals"] = s7_eval_log_totals
ORACLES["s7_eval_log_totals"] = (
    f"WITH {V_SCORED_SQL} SELECT count(*) AS n, round(CAST(count(CASE WHEN {_AM} = label THEN 1 END) AS DOUBLE), 6) AS n_correct FROM v_scored")
QUERIES["s7_append_eval_log"] = s7_append_eval_log
ORACLES["s7_append_eval_log"] = (
    f"WITH {V_SCORED_SQL} SELECT lang, round(avg(CASE WHEN {_AM} = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM v_scored GROUP BY lang")


# ------------------------------------------------------------------- T14
def _prefix_dictionary(spark, sf_dir):
    """A (form, replacement) table derived from ``benchmark``: long lower-case
    tokens map to their first six characters (a dictionary stemmer)."""
    b = table(spark, sf_dir, "benchmark")
    toks = b.select(F.explode(tx.whitespace_tokens("text")).alias("t")).select(F.lower("t").alias("form"))
    return toks.filter(F.length("form") > 6).distinct().withColumn("replacement", F.substring("form", 1, 6))


def t14_dictionary_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return textops.dictionary_normalize(d, _prefix_dictionary(spark, sf_dir), "id", "text", lower=True)


_TOK = q.tokens("text")
QUERIES["t14_dictionary_normalize"] = t14_dictionary_normalize
ORACLES["t14_dictionary_normalize"] = f"""
WITH dict AS (SELECT DISTINCT form, substr(form, 1, 6) AS replacement FROM
              (SELECT lower(unnest({_TOK})) AS form FROM benchmark) WHERE length(form) > 6),
d AS (SELECT doc_id, {_TOK} AS toks FROM documents),
t AS (SELECT doc_id, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS pos FROM d),
j AS (SELECT t.doc_id, string_agg(coalesce(dict.replacement, t.tok), ' ' ORDER BY t.pos) AS text
      FROM t LEFT JOIN dict ON lower(t.tok) = dict.form GROUP BY t.doc_id)
SELECT d.doc_id AS id, coalesce(j.text, '') AS text FROM d LEFT JOIN j USING (doc_id)"""


# ------------------------------------- T14: spelling and lemmas by rule
SPELL_LEAST = 50         # a word is known from this many occurrences on


def _letters_sql(table="documents"):
    return f"""SELECT word, count(*) AS freq FROM (SELECT lower(unnest({_TOK})) AS word FROM {table})
  WHERE regexp_full_match(word, '\\p{{L}}+') AND length(word) >= 4 GROUP BY word"""


def _words(spark, sf_dir):
    return materialize(spelling.word_counts(table(spark, sf_dir, "documents")))  # one pass over the texts


def _known(spark, sf_dir, words=None):
    return (_words(spark, sf_dir) if words is None else words).where(F.col("freq") >= SPELL_LEAST)


def t14_corrections(spark, sf_dir):
    """Every rarer word of the corpus against the frequent ones."""
    words = _words(spark, sf_dir)
    return spelling.corrections(words.where(F.col("freq") < SPELL_LEAST), _known(spark, sf_dir, words))


def t14_correct_spelling(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    words = _words(spark, sf_dir)
    fixed = spelling.correct_spelling(d, _known(spark, sf_dir, words), words=words)
    return fixed.select("id", F.sha2("text", 256).alias("text_sha"), F.length("text").alias("n_chars"))


def _one_byte(word):
    """The SQL edit distance counts bytes: the accented Latin-1 letters become
    digits and capitals, which lower-case words do not have."""
    letters = "".join(chr(c) for c in range(223, 256) if c != 247)
    return f"translate({word}, '{letters}', '0123456789ABCDEFGHIJKLMNOPQRSTUV')"


_CORRECTIONS_SQL = f"""words AS ({_letters_sql()}), known AS (SELECT * FROM words WHERE freq >= {SPELL_LEAST}),
near AS (SELECT u.word AS form, k.word AS replacement, k.freq, levenshtein(u.b, k.b) AS distance
         FROM (SELECT *, {_one_byte('word')} AS b FROM words) u JOIN (SELECT *, {_one_byte('word')} AS b FROM known) k
         ON abs(length(u.word) - length(k.word)) <= 2 WHERE u.freq < {SPELL_LEAST}),
corr AS (SELECT form, replacement, distance FROM near WHERE distance <= 2
         QUALIFY row_number() OVER (PARTITION BY form ORDER BY distance, freq DESC, replacement) = 1)"""
QUERIES["t14_corrections"] = t14_corrections
ORACLES["t14_corrections"] = f"WITH {_CORRECTIONS_SQL} SELECT form, replacement, CAST(distance AS INTEGER) AS distance FROM corr"
QUERIES["t14_correct_spelling"] = t14_correct_spelling
ORACLES["t14_correct_spelling"] = f"""WITH {_CORRECTIONS_SQL},
d AS (SELECT doc_id AS id, {_TOK} AS toks FROM documents),
t AS (SELECT id, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS pos FROM d),
j AS (SELECT id, string_agg(CASE WHEN replacement IS NULL THEN tok WHEN substr(tok, 1, 1) <> lower(substr(tok, 1, 1))
        THEN upper(substr(replacement, 1, 1)) || substr(replacement, 2) ELSE replacement END, ' ' ORDER BY pos) AS text
      FROM t LEFT JOIN corr ON lower(t.tok) = corr.form GROUP BY id)
SELECT d.id, sha256(coalesce(j.text, '')) AS text_sha, CAST(length(coalesce(j.text, '')) AS INTEGER) AS n_chars FROM d LEFT JOIN j USING (id)"""

LEMMA_ENDINGS = ("s", "es", "en", "er", "e", "n", "ed", "ing", "ly")


def _lemma_pairs(spark, sf_dir):
    """(form, lemma, held_out): words of the corpus that are another word of
    it and an inflecting ending; a quarter is held out by a digest."""
    words = materialize(spelling.word_counts(table(spark, sf_dir, "documents"), least_length=3).select("word"))  # one pass over the texts
    endings = F.explode(F.array(*[F.lit(e) for e in LEMMA_ENDINGS])).alias("ending")
    forms = words.select(F.col("word").alias("lemma"), endings).select("lemma", F.concat("lemma", "ending").alias("form"))
    pairs = forms.join(words.withColumnRenamed("word", "form"), "form", "left_semi")
    return pairs.select("form", "lemma", F.substring(F.md5("form"), 1, 1).isin("0", "1", "2", "3").alias("held_out"))


def t14_suffix_rules(spark, sf_dir):
    rules = lemmas.suffix_rules(_lemma_pairs(spark, sf_dir).where("not held_out"))
    return rules.select("suffix", "ending", "n", F.round("share", 6).alias("share"))


def t14_predict_lemmas(spark, sf_dir):
    """Lemmas of the forms held out, by rules learned from the others."""
    pairs = materialize(_lemma_pairs(spark, sf_dir))
    return lemmas.predict_lemmas(pairs.where("held_out"), lemmas.suffix_rules(pairs.where("not held_out")))


_RULES_SQL = f"""words AS (SELECT DISTINCT word FROM (SELECT lower(unnest({_TOK})) AS word FROM documents) WHERE regexp_full_match(word, '\\p{{L}}+') AND length(word) >= 3),
pairs AS (SELECT w.word || e AS form, w.word AS lemma, substr(md5(w.word || e), 1, 1) IN ('0', '1', '2', '3') AS held_out
          FROM words w, unnest([{', '.join(q.lit(e) for e in LEMMA_ENDINGS)}]) AS x(e) WHERE w.word || e IN (SELECT word FROM words)),
one AS (SELECT form, lemma, unnest(range(greatest(length(form) - length(lemma), 1), least(length(form), 6) + 1)) AS k FROM (SELECT DISTINCT form, lemma FROM pairs WHERE NOT held_out)),
ends AS (SELECT right(form, k) AS suffix, substr(lemma, length(form) - k + 1) AS ending, count(*) AS n FROM one GROUP BY 1, 2),
rules AS (SELECT suffix, ending, n, n / sum(n) OVER (PARTITION BY suffix) AS share FROM ends QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY n DESC, ending) = 1 AND n >= 2)"""
QUERIES["t14_suffix_rules"] = t14_suffix_rules
ORACLES["t14_suffix_rules"] = f"WITH {_RULES_SQL} SELECT suffix, ending, n, round(share, 6) AS share FROM rules"
QUERIES["t14_predict_lemmas"] = t14_predict_lemmas
ORACLES["t14_predict_lemmas"] = f"""WITH {_RULES_SQL},
asked AS (SELECT form, unnest(range(1, least(length(form), 6) + 1)) AS k FROM (SELECT DISTINCT form FROM pairs WHERE held_out)),
hits AS (SELECT form, k, suffix, left(form, length(form) - k) || ending AS lemma FROM asked JOIN rules ON suffix = right(form, k))
SELECT form, lemma, suffix FROM hits WHERE lemma <> '' QUALIFY row_number() OVER (PARTITION BY form ORDER BY k DESC) = 1"""


# ------------------------------------------------------------------- T17
MAX_LEN = 128


def t17_encode_fixed_length(spark, sf_dir):
    vocab = textops.build_vocabulary(table(spark, sf_dir, "documents"), "text")
    lab = v_labelled(spark, sf_dir).select("id", "text")
    return textops.encode_fixed_length(lab, vocab, "id", "text", max_length=MAX_LEN)


QUERIES["t17_encode_fixed_length"] = t17_encode_fixed_length
ORACLES["t17_encode_fixed_length"] = f"""WITH {V_LABELLED_SQL},
tk AS (SELECT unnest({_TOK}) AS token FROM documents),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS INTEGER) AS token_id
          FROM tk GROUP BY token),
d AS (SELECT id, {_TOK} AS toks FROM v_labelled),
t AS (SELECT id, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS pos FROM d),
j AS (SELECT t.id, list(coalesce(vocab.token_id, 1) ORDER BY t.pos) AS ids FROM t LEFT JOIN vocab ON t.tok = vocab.token
      WHERE t.pos <= {MAX_LEN} GROUP BY t.id),
e AS (SELECT d.id, coalesce(j.ids, []::INTEGER[]) AS ids FROM d LEFT JOIN j USING (id))
SELECT id, CAST(list_resize(ids, {MAX_LEN}, 0) AS INTEGER[]) AS input_ids,
       list_transform(range(1, {MAX_LEN + 1}), lambda i: CAST(CASE WHEN i <= len(ids) THEN 1 ELSE 0 END AS INTEGER)) AS attention_mask
FROM e"""


# -------------------------------------------------------------- U1, O5
def u1_python_step(spark, sf_dir):
    """A plain Python ``str -> str`` step inside a Column pipeline (Arrow batches)."""
    steps = [tx.strip_urls, textops.python_step(str.upper), tx.normalize_whitespace]
    return v_tweets(spark, sf_dir).select("id", textops.apply_steps("text", steps).alias("text"))


QUERIES["u1_python_step"] = u1_python_step
ORACLES["u1_python_step"] = f"WITH {V_TWEETS_SQL} SELECT id, {q.normalize_whitespace('upper(' + q.strip_urls('text') + ')')} AS text FROM v_tweets"


def o5_shuffle_rows(spark, sf_dir):
    """A seeded permutation: same multiset of rows as the table."""
    return sampling.shuffle_rows(v_labelled(spark, sf_dir).select("id", "label"), 42, "id")


QUERIES["o5_shuffle_rows"] = o5_shuffle_rows
ORACLES["o5_shuffle_rows"] = f"WITH {V_LABELLED_SQL} SELECT id, label FROM v_labelled"


# ------------------------------------------------------------------- G16
def g16_cross_validate(spark, sf_dir):
    """Two parameter sets over two text forms on Spark ML."""
    out = None
    for name, form in (("raw", lambda c: F.col(c)), ("clean", tx.clean_text_full)):
        lab = v_labelled(spark, sf_dir).withColumn("text", form("text"))
        res = cross_validate(lab, [{"reg_param": 0.01, "max_iter": 30, "num_features": 1 << 14}, {"reg_param": 0.1, "max_iter": 15, "num_features": 1 << 14}], k=5, seed=12)
        res = res.select(F.lit(name).alias("form"), "param_set", "fold", *[F.round(c, 6).alias(c) for c in METRIC_COLS])
        out = res if out is None else out.unionByName(res)
    return out


QUERIES["g16_cross_validate"] = g16_cross_validate

GRID_EPOCHS, GRID_FEATURES = 3, 512
GRID = [{"optimizer": "gd", "schedule": "constant", "learning_rate": 2.0, "weight_decay": 0.01, "label_smoothing": 0.1, "class_weight_floor": 1.0},
        {"optimizer": "gd", "schedule": "constant", "learning_rate": 0.7, "weight_decay": 0.05, "label_smoothing": 0.0, "class_weight_floor": 0.5}]


def g16_train_grid(spark, sf_dir):
    """All models of two parameter sets x two text forms x five folds, one
    pass an epoch: the training loss and held-out metrics of every epoch."""
    lab = v_labelled(spark, sf_dir).withColumn("fold", (F.col("id") % 5).cast("int"))
    forms = {"raw": lambda d: d, "clean": lambda d: d.withColumn("text", tx.clean_text_full("text"))}
    log, _ = train_grid(lab, forms, GRID, GRID_EPOCHS, max_features=GRID_FEATURES)
    return log.select("form", "param_set", "fold", "epoch", *[F.round(c, 6).alias(c) for c in ("loss", *METRIC_COLS)])


def g16_fold_means(spark, sf_dir):
    """A5 of the last epoch: means over the folds of each form and parameter set."""
    last = g16_train_grid(spark, sf_dir).where(F.col("epoch") == GRID_EPOCHS)
    means = R.mean_over_folds(last, ["form", "param_set"], ["loss", "accuracy", "weighted_f1"])
    return means.select("form", "param_set", *[F.round(c, 5).alias(c) for c in ("loss", "accuracy", "weighted_f1")])


def _grid_sql():
    """The grid in plain SQL: three weights a feature, one step after another
    (class 0, 1, 2 in columns)."""
    sets = ", ".join(f"({k}, {p['learning_rate']}, {p['weight_decay']}, {p['label_smoothing']}, {p['class_weight_floor']})" for k, p in enumerate(GRID))
    steps = [f"""{V_LABELLED_SQL}""", f"""d AS (SELECT 'raw' AS form, id, label AS y, id % 5 AS fold, {_TOK} AS toks FROM v_labelled WHERE label IN (0, 1, 2)
  UNION ALL SELECT 'clean', id, label, id % 5, {q.tokens(q.clean_text_full('text'))} FROM v_labelled WHERE label IN (0, 1, 2))""",
             "tk AS MATERIALIZED (SELECT form, id, unnest(toks) AS t FROM d)",
             f"vocab AS (SELECT form, t, row_number() OVER (PARTITION BY form ORDER BY count(*) DESC, t) AS j FROM tk GROUP BY form, t QUALIFY j <= {GRID_FEATURES})",
             "cnt AS (SELECT form, id, j, ln(1 + count(*)) AS x FROM tk JOIN vocab USING (form, t) GROUP BY form, id, j)",
             "nz AS MATERIALIZED (SELECT form, id, j, x / sqrt(sum(x * x) OVER (PARTITION BY form, id)) AS v FROM cnt UNION ALL SELECT form, id, 0, 1.0 FROM d)",
             f"sets(p, lr, wd, eps, fl) AS (VALUES {sets})",
             "m AS MATERIALIZED (SELECT form, p, fold AS k, lr, wd, eps, fl FROM (SELECT DISTINCT form, fold FROM d), sets)",
             "cc AS (SELECT m.form, m.p, m.k, any_value(fl) AS fl, " + ", ".join(f"greatest(count(CASE WHEN y = {c} AND fold <> k THEN 1 END), 1) AS n{c}" for c in range(3))
             + ", " + ", ".join(f"count(CASE WHEN y = {c} AND fold <> k THEN 1 END) AS r{c}" for c in range(3)) + " FROM m JOIN d USING (form) GROUP BY m.form, m.p, m.k)",
             "cw AS MATERIALIZED (SELECT form, p, k, " + ", ".join(f"greatest((n0 + n1 + n2) / (3.0 * n{c}), fl) AS c{c}" for c in range(3))
             + ", r0 * c0 + r1 * c1 + r2 * c2 AS tot FROM cc)",
             "w0 AS MATERIALIZED (SELECT m.form, m.p, m.k, j, 0.0::DOUBLE AS a0, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2 FROM m JOIN (SELECT DISTINCT form, j FROM nz) USING (form))"]
    for e in range(GRID_EPOCHS + 1):
        steps += [f"z{e} AS MATERIALIZED (SELECT w.form, w.p, w.k, id, sum(v * a0) AS z0, sum(v * a1) AS z1, sum(v * a2) AS z2 FROM nz JOIN w{e} w ON w.form = nz.form AND w.j = nz.j GROUP BY ALL)",
                  f"""q{e} AS MATERIALIZED (SELECT z.form, z.p, z.k, z.id, y, fold <> z.k AS train, tot,
  CASE WHEN z0 >= greatest(z1, z2) - 1e-9 THEN 0 WHEN z1 >= z2 - 1e-9 THEN 1 ELSE 2 END AS pred,
  greatest(z0, z1, z2) + ln(exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))) AS l,
  """ + ", ".join(f"z{c}, (1 - eps) * CASE WHEN y = {c} THEN c{c} ELSE 0 END + eps / 3 * c{c} AS q{c}" for c in range(3)) + f"""
  FROM z{e} z JOIN d ON d.form = z.form AND d.id = z.id JOIN m ON m.form = z.form AND m.p = z.p AND m.k = z.k JOIN cw ON cw.form = z.form AND cw.p = z.p AND cw.k = z.k)"""]
        if e < GRID_EPOCHS:
            steps += [f"g{e} AS (SELECT q.form, q.p, q.k, j, " + ", ".join(f"sum(v * ((q0 + q1 + q2) * exp(z{c} - l) - q{c}) / tot) AS g{c}" for c in range(3))
                      + f" FROM nz JOIN q{e} q ON q.form = nz.form AND q.id = nz.id WHERE train GROUP BY ALL)",
                      f"w{e + 1} AS MATERIALIZED (SELECT w.form, w.p, w.k, w.j, " + ", ".join(f"a{c} * CASE WHEN w.j = 0 THEN 1 ELSE 1 - lr * wd END - lr * coalesce(g{c}, 0) AS a{c}" for c in range(3))
                      + f" FROM w{e} w JOIN m ON m.form = w.form AND m.p = w.p AND m.k = w.k LEFT JOIN g{e} g ON g.form = w.form AND g.p = w.p AND g.k = w.k AND g.j = w.j)"]
    f1 = lambda c: f"CASE WHEN t{c} + p{c} > 0 THEN 2.0 * tp{c} / (t{c} + p{c}) END"
    steps.append("ev AS (" + " UNION ALL ".join(
        f"SELECT form, p, k, {e} AS epoch, count(*) AS n, " + ", ".join(
            f"count(CASE WHEN y = {c} AND pred = {c} THEN 1 END) AS tp{c}, count(CASE WHEN y = {c} THEN 1 END) AS t{c}, count(CASE WHEN pred = {c} THEN 1 END) AS p{c}" for c in range(3))
        + f" FROM q{e} WHERE NOT train GROUP BY form, p, k" for e in range(1, GRID_EPOCHS + 1)) + ")")
    steps.append("ls AS (" + " UNION ALL ".join(
        f"SELECT form, p, k, {e + 1} AS epoch, sum(-(q0 * (z0 - l) + q1 * (z1 - l) + q2 * (z2 - l))) / any_value(tot) AS loss FROM q{e} WHERE train GROUP BY form, p, k" for e in range(GRID_EPOCHS)) + ")")
    return "WITH " + ",\n".join(steps) + f"""
SELECT form, p AS param_set, k::INTEGER AS fold, epoch, round(loss, 6) AS loss, round((tp0 + tp1 + tp2) / n, 6) AS accuracy,
       round((coalesce({f1(0)}, 0) + coalesce({f1(1)}, 0) + coalesce({f1(2)}, 0)) / (CASE WHEN t0 + p0 > 0 THEN 1 ELSE 0 END + CASE WHEN t1 + p1 > 0 THEN 1 ELSE 0 END + CASE WHEN t2 + p2 > 0 THEN 1 ELSE 0 END), 6) AS macro_f1,
       round((coalesce({f1(0)}, 0) * t0 + coalesce({f1(1)}, 0) * t1 + coalesce({f1(2)}, 0) * t2) / n, 6) AS weighted_f1,
       round({f1(0)}, 6) AS f1_0, round({f1(1)}, 6) AS f1_1, round({f1(2)}, 6) AS f1_2
FROM ev JOIN ls USING (form, p, k, epoch)"""


QUERIES["g16_train_grid"] = g16_train_grid
QUERIES["g16_fold_means"] = g16_fold_means
ORACLES["g16_train_grid"] = _grid_sql()
ORACLES["g16_fold_means"] = (f"SELECT form, param_set, round(avg(loss), 5) AS loss, round(avg(accuracy), 5) AS accuracy, round(avg(weighted_f1), 5) AS weighted_f1 "
                             f"FROM ({_grid_sql()}) WHERE epoch = {GRID_EPOCHS} GROUP BY form, param_set")


# ------------------------------------------------------------- S1 / S3 / P4
CSV_ROWS = 20_000        # a file with line breaks in quotes is read whole by one task


def s1_read_labelled_text(spark, sf_dir):
    """Labelled texts exported the way the reference receives them (index
    column, labels -1/0/1 as text, multi-line quoted texts), read back by S1."""
    lab = v_labelled(spark, sf_dir)
    d = _scratch(spark, "labelled-csv")
    (lab.select(F.col("id").alias("Unnamed: 0"), "text", (F.col("label") - 1).cast("double").alias("labels"))
     .write.option("header", True).option("escape", '"').option("maxRecordsPerFile", CSV_ROWS).csv(d))
    return files.read_labelled_text(spark, d)


QUERIES["s1_read_labelled_text"] = s1_read_labelled_text
ORACLES["s1_read_labelled_text"] = f"WITH {V_LABELLED_SQL} SELECT id, text, label FROM v_labelled"


def s3_read_ohlcv(spark, sf_dir):
    """Daily bars written as CSV files in a folder per company (source column
    names), read back in one scan."""
    root = _scratch(spark, "ohlcv")
    (v_ohlc(spark, sf_dir).select(
        "company", F.date_format("date", "yyyy-MM-dd").alias("Data"), F.col("open").alias("Otwarcie"),
        F.col("high").alias("Najwyzszy"), F.col("low").alias("Najnizszy"),
        F.col("close").alias("Zamkniecie"), F.col("volume").alias("Wolumen"))
     .write.partitionBy("company").option("header", True).csv(root))
    return files.read_ohlcv(spark, root).select(
        "company", "date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume")])


QUERIES["s3_read_ohlcv"] = s3_read_ohlcv
ORACLES["s3_read_ohlcv"] = (f"WITH {V_OHLC_SQL} SELECT company, date, round(open, 6) AS open, round(high, 6) AS high, "
                            "round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM v_ohlc")


def p4_dedup_rows(spark, sf_dir):
    from marketlex.operators.cleaning import dedup_rows
    return dedup_rows(v_tweets(spark, sf_dir).select("company", "date"))


QUERIES["p4_dedup_rows"] = p4_dedup_rows
ORACLES["p4_dedup_rows"] = f"WITH {V_TWEETS_SQL} SELECT DISTINCT company, date FROM v_tweets"


# ------------------------------------------------- P6, P8, stop-word join
def p6_numeric_columns(spark, sf_dir):
    """Means of the numeric columns of the runs, found from the schema
    and renamed (P8)."""
    from marketlex.operators import cleaning
    r = v_runs(spark, sf_dir)
    names = cleaning.numeric_columns(r, exclude=("run_id", "train_seed", "model_seed"))
    means = r.groupBy("model").agg(*[F.round(F.avg(c), 6).alias(c) for c in names])
    return cleaning.rename_columns(means, {c: f"mean_{c}" for c in names})


_NUMERIC = [*R.METRICS, "learning_rate", "batch_size", "weight_decay"]
QUERIES["p6_numeric_columns"] = p6_numeric_columns
ORACLES["p6_numeric_columns"] = (f"WITH {V_RUNS_SQL} SELECT model, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in _NUMERIC)
                                 + " FROM v_runs GROUP BY model")


def t13_remove_stopwords_table(spark, sf_dir):
    """The join form: stop words are the 300 most frequent tokens."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    words = (docs.select(F.explode(tx.whitespace_tokens("text")).alias("t")).groupBy(F.lower("t").alias("word")).count()
             .orderBy(F.desc("count"), "word").limit(300).select("word"))
    return textops.remove_stopwords_table(docs, words)


QUERIES["t13_remove_stopwords_table"] = t13_remove_stopwords_table
ORACLES["t13_remove_stopwords_table"] = f"""
WITH d AS (SELECT doc_id AS id, {_TOK} AS toks FROM documents),
t AS (SELECT id, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS pos FROM d),
w AS (SELECT lower(tok) AS word FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 300),
j AS (SELECT id, string_agg(tok, ' ' ORDER BY pos) AS text FROM t WHERE lower(tok) NOT IN (SELECT word FROM w) GROUP BY id)
SELECT d.id, coalesce(j.text, '') AS text FROM d LEFT JOIN j USING (id)"""


# ------------------------------------------- T15: the cumulative strategies
def t15_strategies(spark, sf_dir):
    """All five cumulative strategies over documents; spelling and lemma
    tables are derived from ``benchmark``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    lemmas = _prefix_dictionary(spark, sf_dir)
    corrections = lemmas.select("form", F.reverse("form").alias("replacement"))
    out = None
    for name, steps in textops.strategy_variants(corrections, lemmas, STRATEGY_STOP).items():
        d = docs
        for step in steps:
            d = step(d)
        d = d.select("id", F.lit(name).alias("strategy"), F.sha2("text", 256).alias("text_sha"), F.length("text").alias("n_chars"))
        out = d if out is None else out.unionByName(d)
    return out


STRATEGY_STOP = ("the", "and", "of", "le", "la", "de", "und", "der", "que", "el")


def _strategy_sql(name, spell, lem, stop):
    tok = q.tokens("b")
    word = "coalesce(c.replacement, t.tok)" if spell else "t.tok"
    if lem:
        word = f"coalesce(m.replacement, {word})"
    joins = ("LEFT JOIN corr c ON t.tok = c.form " if spell else "") + (
        f"LEFT JOIN dict m ON {'coalesce(c.replacement, t.tok)' if spell else 't.tok'} = m.form " if lem else "")
    if not (spell or lem or stop):
        return f"SELECT id, '{name}' AS strategy, b AS x FROM base"
    keep = f"WHERE lower(w) NOT IN ({', '.join(q.lit(s) for s in STRATEGY_STOP)})" if stop else ""
    return (f"SELECT base.id, '{name}' AS strategy, coalesce(j.x, '') AS x FROM base LEFT JOIN (SELECT id, string_agg(w, ' ' ORDER BY pos) AS x FROM "
            f"(SELECT t.id, t.pos, {word} AS w FROM (SELECT id, unnest({tok}) AS tok, unnest(generate_series(1, len({tok}))) AS pos FROM base) t {joins}) "
            f"{keep} GROUP BY id) j USING (id)")


QUERIES["t15_strategies"] = t15_strategies
ORACLES["t15_strategies"] = f"""
WITH dict AS (SELECT DISTINCT form, substr(form, 1, 6) AS replacement FROM
              (SELECT lower(unnest({_TOK})) AS form FROM benchmark) WHERE length(form) > 6),
corr AS (SELECT form, reverse(form) AS replacement FROM dict),
base AS (SELECT doc_id AS id, {q.clean_text_basic('text')} AS b FROM documents),
s AS ({" UNION ALL ".join(_strategy_sql(*a) for a in (
    ("Basic_processing", False, False, False), ("Basic_processing_spelling", True, False, False),
    ("Basic_processing_spelling_lem", True, True, False), ("Basic_processing_spelling_SP", True, False, True),
    ("Basic_processing_spelling_lem_SP", True, True, True)))})
SELECT id, strategy, sha256(x) AS text_sha, CAST(length(x) AS INTEGER) AS n_chars FROM s"""


# ----------------------------------------------- T1 with a full-size lexicon
def _lexicon(spark):
    """735 one-code-point keys from a rule and the emoticons, as a table with
    an explicit order."""
    from marketlex.functions.lexicon import EMOTICONS, PAIR_SCHEMA
    pairs = [(chr(c), f"u{c:04x}") for c in range(0xC0, 0xC0 + 735)] + list(EMOTICONS)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], PAIR_SCHEMA)


def t01_replace_lexicon_documents(spark, sf_dir):
    """759 entries over whole documents (accented letters are keys)."""
    from marketlex.functions.lexicon import pairs_from_table
    pairs = pairs_from_table(_lexicon(spark))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.replace_lexicon("text", pairs), 256).alias("text_sha"))


def _lexicon_sql():
    """One-code-point keys as one list pass (no inserted text holds a key),
    then the emoticons in order."""
    from marketlex.functions.lexicon import EMOTICONS
    one = ("array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c <> '' AND unicode(c) BETWEEN 192 AND 926 "
           "THEN printf(' u%04x', unicode(c)) ELSE c END), '')")
    return f"SELECT doc_id, sha256({q.replace_pairs(one, EMOTICONS)}) AS text_sha FROM documents"


QUERIES["t01_replace_lexicon_documents"] = t01_replace_lexicon_documents
ORACLES["t01_replace_lexicon_documents"] = _lexicon_sql()
