"""Weighted text classification with stratified k-fold cross-validation
on Spark ML (hashing TF-IDF + class-weighted logistic regression)."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlex.functions.text import SPACE
from marketlex.operators.results import mean_over_folds
from marketlex.operators.sampling import stratified_kfold
from marketlex.operators.scoring import class_weights, classification_metrics
from marketlex.session import materialize

METRIC_COLS = ("accuracy", "macro_f1", "weighted_f1", "f1_0", "f1_1", "f1_2")


def _features(df: DataFrame, num_features: int) -> DataFrame:
    """Hashed term counts: the part of the pipeline that learns nothing."""
    tok = RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=SPACE + "+", toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    return tf.transform(tok.transform(df)).drop("_tokens", "text")


def _fit(train: DataFrame, reg: float, max_iter: int):
    lr = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight",
                            regParam=reg, maxIter=max_iter, family="multinomial")
    return lr.fit(train)


def cross_validate(df: DataFrame, params: Sequence[Mapping], k: int = 5, seed: int = 12,
                   id_col: str = "id", floor: float = 1.0) -> DataFrame:
    """For every parameter set and fold: class weights from the training
    folds (M4), fit, predict the held-out fold, score (A2); returns one row
    per (parameter set, fold) plus ``fold = -1`` rows holding the fold means
    (A5).

    Texts are tokenised and hashed once per feature size, document frequencies
    counted once per size and fold, every held-out row
    is predicted once into one stored table, and all metrics come from one
    aggregation of it.  Each fit is a distributed Spark ML job; the loop only
    submits k x len(params) of them."""
    folds = stratified_kfold(df.select(id_col, "text", "label"), k, "label", id_col, seed)
    sizes = sorted({p.get("num_features", 1 << 16) for p in params})
    featured = {n: materialize(_features(folds, n)) for n in sizes}
    idf, predictions = {}, None
    for pi, p in enumerate(params):
        size = p.get("num_features", 1 << 16)
        rows = featured[size]
        for f in range(k):
            train, test = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
            w = class_weights(train, "label", floor=p.get("class_weight_floor", floor))
            if (size, f) not in idf:
                idf[size, f] = IDF(inputCol="_tf", outputCol="_features").fit(train)
            train, test = (idf[size, f].transform(d) for d in (train, test))
            model = _fit(train.join(F.broadcast(w), "label"), p.get("reg_param", 0.0), p.get("max_iter", 50))  # one row per class
            pred = model.transform(test.withColumn("weight", F.lit(1.0))).select(
                F.lit(pi).alias("param_set"), F.lit(f).alias("fold"), "label", F.col("prediction").cast("int").alias("pred"))
            predictions = pred if predictions is None else predictions.unionByName(pred)
    if predictions is None:
        raise ValueError("no parameter set")
    predictions = materialize(predictions)
    rows = materialize(classification_metrics(predictions, "label", "pred", group_cols=["param_set", "fold"]).select("param_set", "fold", *METRIC_COLS))
    mean = mean_over_folds(rows, ["param_set"], METRIC_COLS).withColumn("fold", F.lit(-1))
    return rows.unionByName(mean.select(rows.columns))
