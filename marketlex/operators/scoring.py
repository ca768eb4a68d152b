"""Scoring and classification metrics.

Metrics are computed from a confusion-count table (``groupBy(true, pred)``),
which is combined map-side and has at most K x K rows per group, so the
cost is one pass over the scored rows whatever their number.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlex.functions.text import SENTIMENT_NAMES

CLASSES = (0, 1, 2)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def softmax(logits) -> Column:
    """M1: row softmax (shifted by the row max for stability)."""
    lg = _c(logits)
    ex = F.transform(lg, lambda x: F.exp(x - F.array_max(lg)))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    return F.transform(ex, lambda x: x / tot)


def log_softmax(logits) -> Column:
    lg = _c(logits)
    m = F.array_max(lg)
    lse = F.log(F.aggregate(lg, F.lit(0.0), lambda a, x: a + F.exp(x - m))) + m
    return F.transform(lg, lambda x: x - lse)


def argmax(logits) -> Column:
    """M2: 0-based index of the first maximal element."""
    lg = _c(logits)
    return (F.array_position(lg, F.array_max(lg)) - 1).cast("int")


def classify(logits, names: Sequence[str] = SENTIMENT_NAMES) -> Column:
    """M3: struct(label name, confidence = probability of the winner)."""
    k = argmax(logits)
    p = softmax(logits)
    return F.struct(F.element_at(F.array(*[F.lit(n) for n in names]), k + 1).alias("sentiment"),
                    F.element_at(p, k + 1).alias("confidence"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A1: rows per value, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


def class_weights(df: DataFrame, label: str = "label", classes: Sequence[int] = CLASSES,
                  floor: float = 1.0) -> DataFrame:
    """M4: per class ``max(total / (K * count), floor)`` with counts floored
    at 1 and total the sum of the floored counts.  One aggregate row,
    unpivoted to ``(label, weight)``."""
    k = len(classes)
    counts = df.agg(*[F.greatest(F.count(F.when(F.col(label) == c, 1)), F.lit(1)).alias(f"n{c}")
                      for c in classes])
    total = sum((F.col(f"n{c}") for c in classes), F.lit(0))
    w = counts.select(*[F.greatest(total / (k * F.col(f"n{c}")), F.lit(floor)).alias(str(c))
                        for c in classes])
    long = w.unpivot([], [str(c) for c in classes], "label", "weight")
    return long.select(F.col("label").cast("int").alias(label), "weight")


def confusion_counts(df: DataFrame, true: str, pred: str, group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols, true, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, true: str, pred: str, classes: Sequence[int] = CLASSES) -> DataFrame:
    """A3: true label x predicted label counts (explicit pivot values: no extra job)."""
    return (df.groupBy(true).pivot(pred, list(classes)).agg(F.count(F.lit(1))).na.fill(0)
            .select(true, *[F.col(str(c)).alias(f"pred_{c}") for c in classes]))


def classification_metrics(df: DataFrame, true: str = "label", pred: str = "pred",
                           classes: Sequence[int] = CLASSES,
                           group_cols: Sequence[str] = ()) -> DataFrame:
    """A2: accuracy, macro F1 (over classes seen in true or pred), support-
    weighted F1 and F1 per class id (0 when undefined, null when the class
    is absent from both)."""
    return metrics_from_confusion(confusion_counts(df, true, pred, group_cols), true, pred, classes, group_cols)


def metrics_from_confusion(cc: DataFrame, true: str, pred: str, classes: Sequence[int] = CLASSES, group_cols: Sequence[str] = ()) -> DataFrame:
    """A2 from confusion counts ``(groups, true, pred, n)``."""
    n = F.col("n")
    aggs = [F.sum(n).alias("_total"), F.sum(F.when(F.col(true) == F.col(pred), n).otherwise(0)).alias("_tp")]
    for c in classes:
        aggs += [F.sum(F.when((F.col(true) == c) & (F.col(pred) == c), n).otherwise(0)).alias(f"_tp{c}"),
                 F.sum(F.when(F.col(true) == c, n).otherwise(0)).alias(f"_t{c}"),
                 F.sum(F.when(F.col(pred) == c, n).otherwise(0)).alias(f"_p{c}")]
    s = cc.groupBy(*group_cols).agg(*aggs)
    f1 = {}
    for c in classes:
        den = F.col(f"_t{c}") + F.col(f"_p{c}")
        f1[c] = F.when(den == 0, F.lit(None).cast("double")).otherwise(2.0 * F.col(f"_tp{c}") / den)
    present = sum((F.when(f1[c].isNotNull(), 1).otherwise(0) for c in classes), F.lit(0))
    macro = sum((F.coalesce(f1[c], F.lit(0.0)) for c in classes), F.lit(0.0)) / present
    weighted = sum((F.coalesce(f1[c], F.lit(0.0)) * F.col(f"_t{c}") for c in classes), F.lit(0.0)) / F.col("_total")
    return s.select(*group_cols, (F.col("_tp") / F.col("_total")).alias("accuracy"),
                    macro.alias("macro_f1"), weighted.alias("weighted_f1"),
                    *[f1[c].alias(f"f1_{c}") for c in classes])


def weighted_ce_loss(df: DataFrame, label: str, logits: str, weights: DataFrame,
                     smoothing: float = 0.1, classes: Sequence[int] = CLASSES,
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """A4: class-weighted, label-smoothed cross-entropy (mean reduction):
    sum_i[(1-e) w_y (-log p_y) + (e/K) sum_c w_c (-log p_c)] / sum_i w_y.
    ``weights`` is the K-row table of :func:`class_weights` (broadcast: K rows)."""
    k = len(classes)
    wrow = weights.groupBy().pivot(label, list(classes)).agg(F.first("weight"))
    wrow = wrow.select(*[F.col(str(c)).alias(f"_w{c}") for c in classes])
    j = df.crossJoin(F.broadcast(wrow))
    lp = log_softmax(logits)
    wy = F.element_at(F.array(*[F.col(f"_w{c}") for c in classes]), F.col(label) + 1)
    nll_y = -F.element_at(lp, F.col(label) + 1)
    smooth = sum((F.col(f"_w{c}") * -F.element_at(lp, i + 1) for i, c in enumerate(classes)), F.lit(0.0))
    j = j.select(*group_cols, ((1 - smoothing) * wy * nll_y + (smoothing / k) * smooth).alias("_num"),
                 wy.alias("_den"))
    return j.groupBy(*group_cols).agg((F.sum("_num") / F.sum("_den")).alias("loss"))


def misclassified(df: DataFrame, id_col: str = "id", label: str = "label",
                  logits: str = "logits", text: str = "text",
                  classes: Sequence[int] = CLASSES) -> DataFrame:
    """Rows whose arg-max class differs from the label, with confidence,
    class probabilities and text length."""
    p = softmax(logits)
    k = argmax(logits)
    d = df.select(F.col(id_col).alias("index"), F.col(label).alias("true_label"),
                  k.alias("predicted_label"), F.col(text).alias("text"), p.alias("_p"))
    d = d.filter(F.col("true_label") != F.col("predicted_label"))
    return d.select("index", "true_label", "predicted_label", "text",
                    F.element_at("_p", F.col("predicted_label") + 1).alias("confidence"),
                    *[F.element_at("_p", i + 1).alias(f"prob_class_{c}") for i, c in enumerate(classes)],
                    F.length("text").alias("text_length"))
