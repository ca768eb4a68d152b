"""Registered scoring / metric queries over ``v_scored`` / ``v_labelled``."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlex.operators import scoring as S
from marketlex.plans.views import V_LABELLED_SQL, V_SCORED_SQL, v_labelled, v_scored

QUERIES = {}
ORACLES = {}

_SM = "list_transform(logits, lambda x: exp(x - list_max(logits)) / list_sum(list_transform(logits, lambda z: exp(z - list_max(logits)))))"
_AM = "CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER)"


def _r6arr(c):
    return F.transform(c, lambda x: F.round(x, 6))


def m1_softmax(spark, sf_dir):
    return v_scored(spark, sf_dir).select("id", _r6arr(S.softmax("logits")).alias("probs"))


QUERIES["m1_softmax"] = m1_softmax
ORACLES["m1_softmax"] = f"WITH {V_SCORED_SQL} SELECT id, list_transform({_SM}, lambda p: round(p, 6)) AS probs FROM v_scored"


def m2_argmax(spark, sf_dir):
    return v_scored(spark, sf_dir).select("id", S.argmax("logits").alias("pred"))


QUERIES["m2_argmax"] = m2_argmax
ORACLES["m2_argmax"] = f"WITH {V_SCORED_SQL} SELECT id, {_AM} AS pred FROM v_scored"


def m3_classify(spark, sf_dir):
    c = S.classify("logits")
    return v_scored(spark, sf_dir).select("id", c["sentiment"].alias("sentiment"),
                                          F.round(c["confidence"], 6).alias("confidence"))


QUERIES["m3_classify"] = m3_classify
ORACLES["m3_classify"] = (
    f"WITH {V_SCORED_SQL} SELECT id, ['Negative', 'Neutral', 'Positive'][{_AM} + 1] AS sentiment, "
    f"round({_SM}[{_AM} + 1], 6) AS confidence FROM v_scored")


def m4_class_weights(spark, sf_dir):
    w = S.class_weights(v_labelled(spark, sf_dir), "label")
    return w.select("label", F.round("weight", 6).alias("weight"))


QUERIES["m4_class_weights"] = m4_class_weights
ORACLES["m4_class_weights"] = f"""WITH {V_LABELLED_SQL},
c AS (SELECT k.label, greatest(count(v.label), 1) AS n FROM (SELECT unnest([0, 1, 2]) AS label) k
      LEFT JOIN v_labelled v ON v.label = k.label GROUP BY k.label)
SELECT CAST(label AS INTEGER) AS label, round(greatest((SELECT sum(n) FROM c) / (3.0 * n), 1.0), 6) AS weight FROM c"""


def a01_value_counts(spark, sf_dir):
    return S.value_counts(v_labelled(spark, sf_dir), "label")


QUERIES["a01_value_counts"] = a01_value_counts
ORACLES["a01_value_counts"] = f"WITH {V_LABELLED_SQL} SELECT label, count(*) AS count FROM v_labelled GROUP BY label"


def _scored_pred(spark, sf_dir):
    return v_scored(spark, sf_dir).withColumn("pred", S.argmax("logits"))


def a02_classification_metrics(spark, sf_dir):
    m = S.classification_metrics(_scored_pred(spark, sf_dir), "label", "pred", group_cols=["lang"])
    return m.select("lang", *[F.round(c, 6).alias(c) for c in m.columns if c != "lang"])


_METRIC_SQL = f"""WITH {V_SCORED_SQL},
p AS (SELECT lang, label, {_AM} AS pred FROM v_scored),
s AS (SELECT lang, count(*) AS total, sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS tp,
  {", ".join(f"sum(CASE WHEN label = {c} AND pred = {c} THEN 1 ELSE 0 END) AS tp{c}, sum(CASE WHEN label = {c} THEN 1 ELSE 0 END) AS t{c}, sum(CASE WHEN pred = {c} THEN 1 ELSE 0 END) AS p{c}" for c in (0, 1, 2))}
  FROM p GROUP BY lang),
f AS (SELECT *, {", ".join(f"CASE WHEN t{c} + p{c} = 0 THEN NULL ELSE 2.0 * tp{c} / (t{c} + p{c}) END AS f{c}" for c in (0, 1, 2))} FROM s)"""
QUERIES["a02_classification_metrics"] = a02_classification_metrics
ORACLES["a02_classification_metrics"] = _METRIC_SQL + """
SELECT lang, round(tp / total, 6) AS accuracy,
  round((coalesce(f0, 0) + coalesce(f1, 0) + coalesce(f2, 0)) /
        ((f0 IS NOT NULL)::INT + (f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT), 6) AS macro_f1,
  round((coalesce(f0, 0) * t0 + coalesce(f1, 0) * t1 + coalesce(f2, 0) * t2) / total, 6) AS weighted_f1,
  round(f0, 6) AS f1_0, round(f1, 6) AS f1_1, round(f2, 6) AS f1_2 FROM f"""


def a03_confusion_matrix(spark, sf_dir):
    return S.confusion_matrix(_scored_pred(spark, sf_dir), "label", "pred")


QUERIES["a03_confusion_matrix"] = a03_confusion_matrix
ORACLES["a03_confusion_matrix"] = (
    f"WITH {V_SCORED_SQL}, p AS (SELECT label, {_AM} AS pred FROM v_scored) SELECT label, "
    + ", ".join(f"count(CASE WHEN pred = {c} THEN 1 END) AS pred_{c}" for c in (0, 1, 2))
    + " FROM p GROUP BY label")


def a04_weighted_ce_loss(spark, sf_dir):
    sc = v_scored(spark, sf_dir)
    w = S.class_weights(sc, "label")
    return S.weighted_ce_loss(sc, "label", "logits", w, group_cols=["lang"]).select(
        "lang", F.round("loss", 6).alias("loss"))


_LSE = "(list_max(logits) + ln(list_sum(list_transform(logits, lambda z: exp(z - list_max(logits))))))"
QUERIES["a04_weighted_ce_loss"] = a04_weighted_ce_loss
ORACLES["a04_weighted_ce_loss"] = f"""WITH {V_SCORED_SQL},
c AS (SELECT k.label, greatest(count(v.label), 1) AS n FROM (SELECT unnest([0, 1, 2]) AS label) k
      LEFT JOIN v_scored v ON v.label = k.label GROUP BY k.label),
w AS (SELECT label, greatest((SELECT sum(n) FROM c) / (3.0 * n), 1.0) AS w FROM c),
wl AS (SELECT list(w ORDER BY label) AS ws FROM w),
r AS (SELECT lang, ws[label + 1] AS wy, ws[label + 1] * -(logits[label + 1] - {_LSE}) AS nll,
             ws[1] * -(logits[1] - {_LSE}) + ws[2] * -(logits[2] - {_LSE}) + ws[3] * -(logits[3] - {_LSE}) AS sm
      FROM v_scored, wl)
SELECT lang, round(sum(0.9 * nll + (0.1 / 3) * sm) / sum(wy), 6) AS loss FROM r GROUP BY lang"""


def a13_misclassified(spark, sf_dir):
    m = S.misclassified(v_scored(spark, sf_dir)).withColumn("text_length", F.col("text_length").cast("long"))
    return m.select(*[F.round(c, 6).alias(c) if c.startswith(("prob", "conf")) else F.col(c) for c in m.columns])


QUERIES["a13_misclassified"] = a13_misclassified
ORACLES["a13_misclassified"] = f"""WITH {V_SCORED_SQL},
p AS (SELECT id, label, text, {_AM} AS pred, {_SM} AS pr FROM v_scored)
SELECT id AS "index", label AS true_label, pred AS predicted_label, text, round(pr[pred + 1], 6) AS confidence,
       round(pr[1], 6) AS prob_class_0, round(pr[2], 6) AS prob_class_1, round(pr[3], 6) AS prob_class_2,
       length(text) AS text_length FROM p WHERE pred <> label"""
