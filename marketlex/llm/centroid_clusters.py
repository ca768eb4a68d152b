"""Centroid clustering with the equal-average equal-variance search.

Vectors and centroids are integers.  By their component sum ``s`` and their
deviation ``v`` (the length of what is left when the mean is taken off each of
the ``d`` components) the squared distance of ``x`` and ``c`` is at least
``(s_x - s_c) ** 2 / d + (v_x - v_c) ** 2``.  Centroids are sorted by sum; a
vector starts at its own sum and goes outward, always to the nearer side.
Once the first term alone exceeds the best distance so far, all centroids
further out do too and the scan ends; a centroid whose two terms exceed it is
passed by; for the others the distance is computed in integers.  The bounds
are floating-point numbers lessened by ``SLACK``, so they never pass by a
centroid that is as near, and ties go to the smaller number exactly.

A round is one pass over the stored vectors: tasks add up integer sums per
batch, Spark adds those up per centroid, and only one row per centroid reaches
the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlex.llm.base import stored

SCALE = 256
LIMIT = 1 << 27          # components below this: squared distances fit 64 bits up to 64 components
SLACK = 1e-9
BATCH = 4096             # vectors searched at a time

LABELS = "vec_id long, cluster int, distance long"


def search_table(centroids: np.ndarray):
    """Centroids in ascending order of their sums, with sums, deviations and
    numbers (ties of the sum: smaller number first)."""
    total = centroids.sum(axis=1)
    order = np.argsort(total, kind="stable")
    c = centroids[order]
    return c, total[order].astype(np.float64), deviation(c), order


def deviation(x: np.ndarray) -> np.ndarray:
    f = x.astype(np.float64)
    return np.sqrt(((f - f.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)) if f.shape[1] else np.zeros(len(f))


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every row of ``x`` (ties: smaller number), its
    squared distance, and how many distances were computed."""
    c, total, dev, number = search_table(centroids)
    n, k, d = len(x), len(c), x.shape[1]
    sx, vx = x.sum(axis=1).astype(np.float64), deviation(x)
    best = np.full(n, np.iinfo(np.int64).max, np.int64)
    label = np.full(n, k, np.int64)
    right = np.searchsorted(total, sx)          # next centroid on either side
    left = right - 1
    padded = np.concatenate(([-np.inf], total, [np.inf]))
    active, computed = np.arange(n), 0
    while len(active):
        s = sx[active]
        down, up = s - padded[left[active] + 1], padded[right[active] + 1] - s
        go_up = up <= down
        at = np.where(go_up, right[active], left[active])
        gap = np.where(go_up, up, down) ** 2 / d
        going = gap * (1 - SLACK) <= best[active]  # infinite where no centroid is left
        active, at, gap, go_up = active[going], at[going], gap[going], go_up[going]
        right[active[go_up]] += 1
        left[active[~go_up]] -= 1
        look = (gap + (vx[active] - dev[at]) ** 2) * (1 - SLACK) <= best[active] + SLACK * dev[at] ** 2
        rows, cand = active[look], at[look]
        diff = x[rows] - c[cand]
        dist = np.einsum("ij,ij->i", diff, diff)
        computed += len(rows)
        better = (dist < best[rows]) | (dist == best[rows]) & (number[cand] < label[rows])
        best[rows[better]], label[rows[better]] = dist[better], number[cand[better]]
    return label, best, computed


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(vec_id, v): the vectors with exactly ``dim`` components, none null or
    non-finite, as little-endian 64-bit ``floor(SCALE * x)``."""

    def run(batches):
        for b in batches:
            col = b.column("v")
            size = np.asarray(col.value_lengths().fill_null(-1))
            flat = col.flatten()
            start = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))[:-1]
            fit = np.flatnonzero(size == dim)
            at = (start[fit][:, None] + np.arange(dim)).ravel()
            part = flat.take(pa.array(at)).cast(pa.float64())
            x = part.to_numpy(zero_copy_only=False).reshape(-1, dim)  # null becomes NaN
            good = np.isfinite(x).all(axis=1)
            y = np.floor(SCALE * x[good])
            if y.size and np.abs(y).max() >= LIMIT:
                raise ValueError(f"a component of {np.abs(y).max() / SCALE:g} is beyond {LIMIT // SCALE}: squared distances would not fit 64 bits")
            rows = y.astype("<i8")
            ids = b.column("vec_id").take(pa.array(fit[good]))
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "v": pa.array([r.tobytes() for r in rows], pa.binary())})

    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, v binary")


def matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
            salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(labels, centroids): labels(vec_id, cluster, distance) of every vector
    with exactly ``dim`` finite components, and the final centroids.

    Components are ``floor(256 * x)``.  Centroids start as the ``k`` vectors
    with the smallest sha256 of ``salt`` and their id (equal ids: by their
    components; null ids last), all of them if there are fewer.  Each of
    ``rounds`` rounds assigns every vector to the nearest centroid (squared
    Euclidean distance, ties to the smaller number) and replaces each centroid
    that has vectors by their componentwise floor(sum / count).  Repeated rows
    all count.  A component of ``2 ** 27 / 256`` or more is an error, as its
    squared distance need not fit 64 bits; a table without a usable vector has
    no labels and no centroids.
    """
    spark = table.sparkSession
    rows = stored(integer_vectors(table, id_col, vector_col, dim), "cluster-vectors")
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], LABELS), np.zeros((0, dim), np.int64)
    centroids = np.stack([np.frombuffer(r.v, "<i8") for r in first])
    sums = [f"s{j}" for j in range(dim)]

    def partial(batches):
        for b in batches:
            n, total = np.zeros(len(shipped.value), np.int64), np.zeros((len(shipped.value), dim), np.int64)
            for at in range(0, b.num_rows, BATCH):
                x = matrix(b.column("v").slice(at, BATCH), dim)
                label, _, _ = assign(x, shipped.value)
                n += np.bincount(label, minlength=len(n))
                np.add.at(total, label, x)
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), *[pa.array(total[held, j]) for j in range(dim)]], names=["cluster", "n", *sums])

    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast(centroids)  # k x dim numbers
        schema = "cluster int, n long, " + ", ".join(f"{s} long" for s in sums)
        got = rows.select("v").mapInArrow(partial, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect()  # k rows
        centroids = centroids.copy()
        for r in got:
            centroids[r.cluster] = [r[s] // r.n for s in sums]
        shipped.destroy()
    last = spark.sparkContext.broadcast(centroids)

    def label_rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                label, best, _ = assign(matrix(part.column("v"), dim), last.value)
                yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id"), "cluster": pa.array(label.astype(np.int32)), "distance": pa.array(best)})

    labels = stored(rows.mapInArrow(label_rows, LABELS), "cluster-labels")
    last.destroy()
    return labels, centroids


def cluster_digest(labels: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)
    of ``cluster``: distances summed per cluster and over all, and the digest
    of the centroid's components joined by commas."""
    spark = labels.sparkSession
    text = spark.createDataFrame([(k, ",".join(map(str, c.tolist()))) for k, c in enumerate(centroids)], "cluster int, __text string")
    per = labels.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    facts = (per.join(text, "cluster").withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # one row per centroid
             .select("cluster", "cluster_inertia", "inertia", F.sha2(F.col("__text").cast("binary"), 256).alias("centroid_sha256")))
    return labels.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
