"""The grid trainer against a dense fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlex.operators import trainer

ROWS = [("good strong profit good", 2), ("bad loss", 0), ("flat day", 1), ("good news today", 2), ("loss loss bad news", 0), ("day", 1), ("", 1), (None, 0),
        ("profit profit", 2), ("strong good day", 2), ("bad bad bad", 0), ("news", 1), ("good bad", 2), ("flat", 1), ("profit loss", 0)]
PARAMS = [{"learning_rate": 0.3, "weight_decay": 0.1, "label_smoothing": 0.2, "class_weight_floor": 0.5},
          {"optimizer": "gd", "learning_rate": 1.5, "schedule": "constant", "label_smoothing": 0.0}]
EPOCHS = 4


def dense(texts, labels, folds, fold, p):
    """Vocabulary, final weights, losses and predictions per epoch of one model."""
    p = {**trainer.DEFAULTS, **p}
    count = {}
    for t in texts:
        for w in (t or "").split():
            count[w] = count.get(w, 0) + 1
    vocab = sorted(count, key=lambda w: (-count[w], w))
    x = np.zeros((len(texts), len(vocab) + 1))
    x[:, -1] = 1
    for i, t in enumerate(texts):
        for w in (t or "").split():
            x[i, vocab.index(w)] += 1
        v = np.log1p(x[i, :-1])
        x[i, :-1] = v / (np.linalg.norm(v) or 1)
    train = folds != fold
    n = np.array([max(1, (labels[train] == c).sum()) for c in range(3)])
    cw = np.maximum(n.sum() / (3 * n), p["class_weight_floor"])
    q = (1 - p["label_smoothing"]) * np.eye(3)[labels] * cw + p["label_smoothing"] / 3 * cw
    total = cw[labels[train]].sum()
    w = np.zeros((x.shape[1], 3))
    m, v = np.zeros_like(w), np.zeros_like(w)
    losses, predictions = [], []
    for e in range(1, EPOCHS + 1):
        lp = x @ w
        lp = lp - lp.max(1, keepdims=True)
        lp = lp - np.log(np.exp(lp).sum(1, keepdims=True))
        losses.append(-(q * lp)[train].sum() / total)
        g = x[train].T @ (q.sum(1, keepdims=True) * np.exp(lp) - q)[train] / total
        rate = p["learning_rate"] * trainer.schedule(e, EPOCHS, p["warmup_ratio"], p["schedule"])
        w[:-1] *= 1 - rate * p["weight_decay"]
        if p["optimizer"] == "gd":
            w -= rate * g
        else:
            m, v = p["beta1"] * m + (1 - p["beta1"]) * g, p["beta2"] * v + (1 - p["beta2"]) * g * g
            w -= rate * (m / (1 - p["beta1"] ** e)) / (np.sqrt(v / (1 - p["beta2"] ** e)) + p["epsilon"])
        z = (x @ w)[~train]
        predictions.append((z >= z.max(1, keepdims=True) - 1e-9).argmax(1))
    return vocab, w, losses, predictions


def test_every_model_equals_a_dense_fit(spark, monkeypatch):
    monkeypatch.setattr(trainer, "ROWS", 4)
    monkeypatch.setattr(trainer, "BLOCK", 5)
    rows = [(t, y, i % 3) for i, (t, y) in enumerate(ROWS)] + [("no label", None, 0), ("no class", 9, 1), ("no fold", 1, None)]
    df = spark.createDataFrame(rows, "text string, label int, fold int").repartition(4)
    forms = {"raw": lambda d: d, "first": lambda d: d.withColumn("text", F.substring_index("text", " ", 1))}
    log, grids = trainer.train_grid(df, forms, PARAMS, EPOCHS)
    got = {(r.form, r.param_set, r.fold, r.epoch): r for r in log.collect()}
    assert len(got) == 2 * 2 * 3 * EPOCHS
    labels, folds = np.array([y for _, y in ROWS]), np.array([i % 3 for i in range(len(ROWS))])
    for form, texts in (("raw", [t for t, _ in ROWS]), ("first", [t and t.split(" ")[0] for t, _ in ROWS])):
        for j, (k, f) in enumerate(grids[form].models):
            _, w, losses, predictions = dense(texts, labels, folds, grids[form].folds[f], PARAMS[k])
            assert np.allclose(grids[form].weight[j], w, atol=1e-9)
            for e in range(EPOCHS):
                r = got[form, k, grids[form].folds[f], e + 1]
                assert abs(r.loss - losses[e]) < 1e-9
                assert abs(r.accuracy - (predictions[e] == labels[folds == grids[form].folds[f]]).mean()) < 1e-9


def test_training_lowers_the_loss_and_learns(spark):
    df = spark.createDataFrame([(f"w{i % 3} x{i % 7} y{i % 11}", i % 3, i % 5) for i in range(300)], "text string, label int, fold int")
    log, _ = trainer.train_grid(df, {"raw": lambda d: d}, [{}], 6)
    rows = sorted(log.collect(), key=lambda r: (r.fold, r.epoch))
    for f in range(5):
        losses = [r.loss for r in rows if r.fold == f]
        assert losses == sorted(losses, reverse=True)
        assert [r.accuracy for r in rows if r.fold == f][-1] == 1.0


def test_no_rows(spark):
    log, _ = trainer.train_grid(spark.createDataFrame([], "text string, label int, fold int"), {"raw": lambda d: d}, [{}], 2)
    assert log.count() == 0


@pytest.mark.parametrize("kind", ["cosine", "constant"])
def test_schedule(kind):
    s = [trainer.schedule(e, 20, 0.1, kind) for e in range(1, 21)]
    assert max(s) == 1.0 and min(s) > 0
    if kind == "cosine":
        assert s[:3] == [0.5, 1.0, 1.0] and s[2:] == sorted(s[2:], reverse=True)
