"""Weighted cross-validation on Spark ML."""

import math

from marketlex.functions import text as tx
from marketlex.operators.ml import METRIC_COLS, cross_validate
from marketlex.plans.views import v_labelled


def test_cross_validate_folds_and_mean(spark):
    lab = v_labelled(spark, "/root/testdata/sf0.01").withColumn("text", tx.clean_text_full("text"))
    res = cross_validate(lab, [{"reg_param": 0.1, "max_iter": 10, "num_features": 1 << 10}], k=2, seed=3).collect()
    folds = [r for r in res if r["fold"] >= 0]
    mean = [r for r in res if r["fold"] == -1]
    assert sorted(r["fold"] for r in folds) == [0, 1] and len(mean) == 1
    for r in folds:
        assert 0.0 <= r["accuracy"] <= 1.0 and 0.0 <= r["weighted_f1"] <= 1.0
    for c in METRIC_COLS:
        vals = [r[c] for r in folds if r[c] is not None]
        if len(vals) == 2:
            assert math.isclose(mean[0][c], sum(vals) / 2, rel_tol=1e-9)
