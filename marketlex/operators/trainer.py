"""Training of a whole grid of text classifiers at once.

A model is (text form, parameter set, fold): multinomial logistic regression
on log-scaled counts of vocabulary tokens (unit length per text), trained on
the other folds and evaluated on its own.  The loss is the class-weighted,
label-smoothed cross-entropy of A4 with mean reduction,
``sum[(1 - e) w_y (-log p_y) + e / C sum_c w_c (-log p_c)] / sum w_y``.

One epoch is one pass over the stored features for *all* models: a task adds
up the gradients of its rows, the loss, and the confusion counts of the rows
each model does not train on; Spark sums them by model and feature block, and
the driver takes one step of gradient descent or AdamW.  What travels is
bounded by the parameters: features x classes x models numbers.
"""

from __future__ import annotations

from typing import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlex.operators import textops
from marketlex.operators.scoring import CLASSES, metrics_from_confusion
from marketlex.session import materialize

MAX_FEATURES = 4096      # most frequent tokens that are features
ROWS = 256               # texts of one step inside a task
TIE = 1e-9               # logits this close are equal: the first class is predicted, however sums were rounded
BLOCK = 4096             # features of one block of a gradient
DEFAULTS = {"learning_rate": 0.5, "weight_decay": 0.01, "label_smoothing": 0.1, "class_weight_floor": 1.0, "optimizer": "adamw",
            "warmup_ratio": 0.1, "schedule": "cosine", "beta1": 0.9, "beta2": 0.999, "epsilon": 1e-8}
EVALUATION = "form string, param_set int, fold int, epoch int, loss double, label int, pred int, n long"


def features(df: DataFrame, vocab: DataFrame, columns: Sequence[str], text_col: str = "text") -> DataFrame:
    """``columns`` and (idx, val): the distinct features of each text in
    ascending order and their log-scaled counts, of unit length.  ``vocab`` is
    ``(token, feature)``."""
    v = vocab.select(F.col("token").alias("_key"), F.col("feature").alias("_value"))
    made = textops.map_tokens(df.select(*columns, text_col), text_col, v, lambda tokens, values: [x for x in values if x is not None], "array<int>", "ids")

    def count(batches):
        for b in batches:
            idx, val, ends = [], [], [0]
            for row in b.column("ids"):
                j, n = np.unique(np.array(row.as_py() or [], np.int32), return_counts=True)
                x = np.log1p(n)
                idx.append(j)
                val.append(x / (np.sqrt((x * x).sum()) or 1.0) if len(x) else x)
                ends.append(ends[-1] + len(j))
            at = pa.array(np.array(ends, np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in columns], pa.ListArray.from_arrays(at, pa.array(np.concatenate([*idx, np.zeros(0, np.int32)]).astype(np.int32))),
                 pa.ListArray.from_arrays(at, pa.array(np.concatenate([*val, np.zeros(0)])))], names=[*columns, "idx", "val"])

    given = made.select(*columns, "ids")
    ddl = ", ".join(f"`{c}` {t}" for c, t in given.dtypes[:-1])
    return given.mapInArrow(count, f"{ddl}, idx array<int>, val array<double>")


def class_weight_table(counts: np.ndarray, floor: float) -> np.ndarray:
    """M4 for rows of class counts: ``max(total / (C n), floor)``, counts
    taken as 1 at least."""
    n = np.maximum(counts, 1)
    return np.maximum(n.sum(axis=-1, keepdims=True) / (n.shape[-1] * n), floor)


class Grid:
    """The models of one text form: their weights and optimizer state."""

    def __init__(self, params: Sequence[Mapping], folds: Sequence[int], counts: np.ndarray, n_features: int):
        """``counts[f, c]``: rows of class c in fold f."""
        self.params = [{**DEFAULTS, **p} for p in params]
        self.models = [(k, f) for k in range(len(params)) for f in range(len(folds))]
        self.folds, self.classes = list(folds), counts.shape[1]
        self.smoothing = np.array([self.params[k]["label_smoothing"] for k, _ in self.models])
        self.class_weight = np.array([class_weight_table(counts.sum(axis=0) - counts[f], self.params[k]["class_weight_floor"]) for k, f in self.models])
        # sum of w_y over the training rows
        self.total = np.array([((counts.sum(axis=0) - counts[f]) * self.class_weight[j]).sum() for j, (_, f) in enumerate(self.models)])
        self.weight = np.zeros((len(self.models), n_features + 1, self.classes))  # the last row is the bias
        self.first, self.second = np.zeros_like(self.weight), np.zeros_like(self.weight)

    def step(self, gradient: np.ndarray, epoch: int, epochs: int) -> None:
        """One step of every model (``epoch`` from 1)."""
        for j, (k, _) in enumerate(self.models):
            p = self.params[k]
            rate = p["learning_rate"] * schedule(epoch, epochs, p["warmup_ratio"], p["schedule"])
            g = gradient[j] / (self.total[j] or 1.0)
            self.weight[j, :-1] *= 1 - rate * p["weight_decay"]
            if p["optimizer"] == "gd":
                self.weight[j] -= rate * g
                continue
            self.first[j] = p["beta1"] * self.first[j] + (1 - p["beta1"]) * g
            self.second[j] = p["beta2"] * self.second[j] + (1 - p["beta2"]) * g * g
            mean = self.first[j] / (1 - p["beta1"] ** epoch)
            spread = self.second[j] / (1 - p["beta2"] ** epoch)
            self.weight[j] -= rate * mean / (np.sqrt(spread) + p["epsilon"])


def schedule(epoch: int, epochs: int, warmup: float, kind: str) -> float:
    """Share of the learning rate in an epoch: linear warm-up, then constant
    or down a half cosine."""
    if kind == "constant":
        return 1.0
    warm = int(np.ceil(warmup * epochs))
    if epoch <= warm:
        return epoch / warm
    return 0.5 * (1 + np.cos(np.pi * (epoch - warm - 1) / max(1, epochs - warm)))


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


def rows_pass(weight: np.ndarray, class_weight: np.ndarray, smoothing: np.ndarray, own_fold: np.ndarray,
              row: np.ndarray, idx: np.ndarray, val: np.ndarray, label: np.ndarray, fold: np.ndarray, gradient: np.ndarray):
    """Adds the gradients of a few rows to ``gradient`` (models x features + 1
    x classes); returns their loss per model and the predictions.  Entries
    (row, idx, val) are sorted by row; the bias is the last feature."""
    models, _, classes = weight.shape
    n = len(label)
    w = weight.transpose(1, 0, 2).reshape(weight.shape[1], -1)      # features x (models, classes)
    z = np.zeros((n, models * classes))
    if len(row):
        heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        z[row[heads]] = np.add.reduceat(val[:, None] * w[idx], heads, axis=0)
    z = (z + w[-1]).reshape(n, models, classes)
    lp = log_softmax(z)
    one = np.eye(classes)[label]
    target = (1 - smoothing)[None, :, None] * one[:, None, :] * class_weight[None] + (smoothing / classes)[None, :, None] * class_weight[None]
    train = own_fold[None, :] != fold[:, None]
    loss = -(target * lp).sum(axis=2)
    dz = (target.sum(axis=2, keepdims=True) * np.exp(lp) - target) * train[:, :, None]
    flat = dz.reshape(n, -1)
    size = weight.shape[1]
    g = gradient.transpose(1, 0, 2)                                  # a view: features x models x classes
    if len(row):
        used, place = np.unique(idx, return_inverse=True)
        for c in range(flat.shape[1]):
            g[used, c // classes, c % classes] += np.bincount(place, val * flat[row, c], len(used))
    g[size - 1] += flat.sum(axis=0).reshape(models, classes)
    return (loss * train).sum(axis=0), (z >= z.max(axis=2, keepdims=True) - TIE).argmax(axis=2), train


def train_grid(df: DataFrame, forms: Mapping[str, object], params: Sequence[Mapping], epochs: int = 3, label_col: str = "label", fold_col: str = "fold",
               text_col: str = "text", classes: Sequence[int] = CLASSES, max_features: int = MAX_FEATURES) -> tuple[DataFrame, dict[str, Grid]]:
    """Train every (form, parameter set, fold) model for ``epochs`` passes.

    ``forms`` maps a name to the ``DataFrame -> DataFrame`` step that makes the
    text form; ``params`` are dicts over ``DEFAULTS`` (``optimizer`` ``adamw``
    or ``gd``).  Returns the evaluation rows (form, param_set, fold, epoch,
    loss, accuracy, macro_f1, ...): ``loss`` is the training loss before the
    epoch's step, metrics are of the model's own fold after it; and the grids
    with the final weights.

    Rows with a null label or fold, or a label that is no class, take no part;
    a null text has no features.  The vocabulary holds the ``max_features``
    most frequent tokens of the form (ties by token)."""
    spark = df.sparkSession
    place = F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, k)])[F.col(label_col)]
    rows = df.withColumn("_y", place).where(F.col("_y").isNotNull() & F.col(fold_col).isNotNull())
    tables, grids = {}, {}
    for name, form in forms.items():
        made = form(rows.select("_y", F.col(fold_col).cast("int").alias("_f"), text_col))
        vocab = materialize(textops.top_tokens(made, max_features, text_col).select("token", F.col("place").alias("feature")))
        tables[name] = materialize(features(made, vocab, ["_y", "_f"], text_col))
        seen = {(r["_f"], r["_y"]): r["count"] for r in tables[name].groupBy("_f", "_y").count().collect()}  # folds x classes
        folds = sorted({f for f, _ in seen})
        counts = np.array([[seen.get((f, c), 0) for c in range(len(classes))] for f in folds], np.int64).reshape(len(folds), len(classes))
        grids[name] = Grid(params, folds, counts, vocab.count())
    log, losses = [], {}
    for epoch in range(1, epochs + 2):  # the last pass only evaluates
        for name, grid in grids.items():
            if not grid.models:
                continue
            gradient, loss, confusion = one_pass(spark, tables[name], grid)
            if epoch > 1:
                log += [(name, k, grid.folds[f], epoch - 1, losses[name][j], int(classes[a]), int(classes[b]), int(confusion[j, a, b]))
                        for j, (k, f) in enumerate(grid.models) for a in range(grid.classes) for b in range(grid.classes) if confusion[j, a, b]]
            if epoch <= epochs:
                losses[name] = (loss / np.where(grid.total > 0, grid.total, 1.0)).tolist()
                grid.step(gradient, epoch, epochs)
    counts = spark.createDataFrame(log, EVALUATION)
    return metrics_from_confusion(counts, "label", "pred", classes, ["form", "param_set", "fold", "epoch", "loss"]), grids


def one_pass(spark, table: DataFrame, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, loss, confusion counts) of all models of a grid under its
    present weights."""
    own_fold = np.array([grid.folds[f] for _, f in grid.models])
    shipped = spark.sparkContext.broadcast((grid.weight, grid.class_weight, grid.smoothing, own_fold))  # features x classes x models
    models, size, classes = grid.weight.shape

    def add(batches):
        weight, class_weight, smoothing, folds = shipped.value
        gradient, loss, confusion = np.zeros_like(weight), np.zeros(models), np.zeros((models, classes, classes))
        any_row = False
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                n = part.num_rows
                lists = part.column("idx")
                length = np.asarray(lists.value_lengths().fill_null(0))
                row = np.repeat(np.arange(n), length)
                label, fold = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_y", "_f"))
                l, pred, train = rows_pass(weight, class_weight, smoothing, folds, row, lists.flatten().to_numpy(), part.column("val").flatten().to_numpy(), label, fold, gradient)
                loss += l
                for j in range(models):
                    held = ~train[:, j]
                    np.add.at(confusion[j], (label[held], pred[held, j]), 1)
                any_row = True
        if any_row:
            for at in range(0, size, BLOCK):
                yield pa.RecordBatch.from_pydict({"kind": ["gradient"], "block": pa.array([at], pa.int32()), "x": [np.ascontiguousarray(gradient[:, at:at + BLOCK]).tobytes()]})
            yield pa.RecordBatch.from_pydict({"kind": ["loss"], "block": pa.array([0], pa.int32()), "x": [loss.tobytes()]})
            yield pa.RecordBatch.from_pydict({"kind": ["confusion"], "block": pa.array([0], pa.int32()), "x": [confusion.tobytes()]})

    def total(t: pa.Table) -> pa.Table:
        out = None
        for x in t.column("x").to_pylist():
            v = np.frombuffer(x)
            out = v.copy() if out is None else out + v
        return pa.table({"kind": t.column("kind").slice(0, 1), "block": t.column("block").slice(0, 1), "x": pa.array([out.tobytes()], pa.binary())})

    schema = "kind string, block int, x binary"
    parts = table.mapInArrow(add, schema).groupBy("kind", "block").applyInArrow(total, schema).collect()  # the size of the weights
    shipped.destroy()
    gradient, loss, confusion = np.zeros_like(grid.weight), np.zeros(models), np.zeros((models, classes, classes))
    for r in parts:
        v = np.frombuffer(r.x)
        if r.kind == "gradient":
            gradient[:, r.block:r.block + BLOCK] = v.reshape(models, -1, classes)
        elif r.kind == "loss":
            loss = v
        else:
            confusion = v.reshape(confusion.shape)
    return gradient, loss, confusion
