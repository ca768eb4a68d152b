"""Nearest neighbours by shifted Hilbert curves.

The nearest vectors are those with the largest inner product.  With ``M`` the
greatest length in the table, a candidate ``x`` becomes the unit vector
``(x / M, sqrt(1 - |x / M| ** 2))`` and a query ``q`` becomes ``(q / |q|, 0)``:
the larger the inner product, the smaller the distance of the two, whatever
the lengths (Bachrach et al. 2014).  Scores are of the vectors as given.

These vectors are projected to a few dimensions by ``ORDERINGS`` random orthogonal
maps, shifted, and numbered along a Hilbert curve in each: ``ORDERINGS``
orders in which near vectors tend to lie close.  Every order is cut at
quantiles of the key into ranges of equal count, dealt to tasks; a query
looks at its own range and ``REACH`` neighbours on either side in every
order, candidates are scored exactly, and the windows' best are merged.

Vectors that are equal are one candidate carrying their smallest ids, so a
vector that fills a third of the table costs no more than another.  Ranges
and visiting queries are cut into chunks of bounded size, so a task holds at
most ``CHUNK`` of each whatever the table.

How much of the table the windows must hold for a given recall depends on
the data alone: vectors without low-dimensional structure need a large share
(README has measured figures), clustered ones a small one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlex.llm.base import stored

ORDERINGS = 8
DIMS, BITS = 6, 8        # projected dimensions and bits of each in the key
RANGES, REACH = 32, 4    # an order's ranges, and neighbours visited each side
CHUNK = 4096
SALTS = 256
SEED = 5


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of integers below ``2 ** bits``) along the
    Hilbert curve (Skilling 2004, vectorised): undo the rotations from the
    highest bit down, Gray-decode, interleave."""
    x = [c.astype(np.int64) for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ t) >> b) & 1)
    return key


def projections(dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ORDERINGS, dim, DIMS) orthonormal maps and (ORDERINGS, DIMS) shifts."""
    rng = np.random.default_rng(seed)
    d = min(DIMS, dim)
    maps = np.stack([np.linalg.qr(rng.normal(size=(dim, d)))[0] for _ in range(ORDERINGS)])
    return maps, rng.random((ORDERINGS, d))


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vid, v, norm): usable vectors as little-endian float bytes;
    ``vid`` hashes them.  A repeated id keeps the vector with the smallest
    ``vid``."""

    def run(batches):
        for b in batches:
            ids, vid, out, norm = [], [], [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, "<f8")
                if np.isfinite(x).all() and x.any():
                    raw = (x + 0.0).tobytes()  # -0.0 is 0.0
                    ids.append(i)
                    vid.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                    out.append(raw)
                    norm.append(float(np.linalg.norm(x)))
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "vid": pa.array(vid, pa.int64()), "v": pa.array(out, pa.binary()), "norm": pa.array(norm, pa.float64())})

    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, "vec_id long, vid long, v binary, norm double")
    one = rows.groupBy("vec_id").agg(F.min(F.struct("vid", "v", "norm")).alias("x"))
    return one.select("vec_id", "x.vid", "x.v", "x.norm")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vid, v, ids): distinct vectors with their ``keep`` smallest ids.  Ids
    are thinned within salted groups first: no task sees all copies."""
    salted = Window.partitionBy("vid", "salt").orderBy("vec_id")
    thin = (rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
            .withColumn("k", F.row_number().over(salted)).where(F.col("k") <= keep))
    return thin.groupBy("vid").agg(F.first("v").alias("v"), F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep).alias("ids"))


def nearest(table: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible
    by ``query_every``, the ``k`` others found with the largest inner product
    (double precision, ties to the smaller id), fewer if the table has fewer.

    Null, zero and non-finite vectors, vectors with null components or of
    another length than most, and null ids take no part; a repeated id counts
    once.  An empty table gives no rows."""
    spark = table.sparkSession
    rows = stored(vectors(table, id_col, vector_col), "ann-vectors")
    shape = rows.groupBy(F.length("v").alias("bytes")).agg(F.count("*").alias("count"), F.max("norm").alias("norm")).orderBy(F.desc("count"), "bytes").head(1)
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.length("v") == shape[0].bytes)
    dim, longest = shape[0].bytes // 8, shape[0].norm
    maps, shifts = projections(dim + 1, seed)
    distinct = stored(distinct_vectors(rows, k + 1), "ann-distinct")

    def matrix(column):
        return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), dim)

    def lifted(v, query=False):
        """Candidates or queries as unit vectors of one dimension more."""
        v = v / (np.linalg.norm(v, axis=1, keepdims=True) if query else longest)
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, 1 - (v * v).sum(axis=1)))
        return np.column_stack([v, more])

    def extent(batches):
        for b in batches:
            if b.num_rows:
                y = np.einsum("nd,odk->nok", lifted(matrix(b.column("v"))), maps).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_pydict({"j": np.arange(y.shape[1]), "lo": y.min(axis=0), "hi": y.max(axis=0)})

    # one row per projected dimension
    box = distinct.select("v").mapInArrow(extent, "j long, lo double, hi double").groupBy("j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("j").collect()
    lo, hi = (np.array([r[c] for r in box]).reshape(ORDERINGS, -1) for c in ("lo", "hi"))
    span = np.where(hi > lo, hi - lo, 1.0)

    def keys_of(v):
        y = (np.einsum("nd,odk->nok", v, maps) - lo) / span
        cells = np.clip((y + shifts) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return [hilbert_key(cells[:, o], BITS) for o in range(ORDERINGS)]

    def keyed(batches):
        for b in batches:
            if b.num_rows:
                for o, key in enumerate(keys_of(lifted(matrix(b.column("v"))))):
                    yield pa.RecordBatch.from_pydict({"o": pa.array([o] * len(key), pa.int32()), "key": key})

    # the ranges on one side of a query hold ``k`` others, so that any window answers it
    ranges = max(1, min(RANGES, distinct.count() // -(-(k + 1) // (REACH + 1))))
    steps = [j / ranges for j in range(1, ranges)] or [0.0]
    got = (distinct.select("v").mapInArrow(keyed, "o int, key long").groupBy("o")
           .agg(F.percentile_approx("key", steps, 100 * RANGES).alias("cuts"), F.min("key").alias("least")).collect())  # ORDERINGS x RANGES numbers
    # a key that fills several ranges is one: each range left holds vectors
    cuts = {r.o: np.unique([c for c in r.cuts if c > r.least]) for r in got}

    def dealt(query):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    for o, key in enumerate(keys_of(lifted(matrix(b.column("v")), query))):
                        yield pa.RecordBatch.from_pydict({
                            "o": pa.array([o] * len(key), pa.int32()), "range": pa.array(np.searchsorted(cuts[o], key, "right").astype(np.int32)),
                            "vid": b.column("vid"), "v": b.column("v"), "ids": b.column("ids")})
        return run

    schema = "o int, range int, vid long, v binary, ids array<long>"
    placed = distinct.mapInArrow(dealt(False), schema)
    asked = rows.where(F.col("vec_id") % query_every == 0).select("vid", F.col("vec_id").alias("query_id"))
    queries = distinct.join(asked.select("vid").distinct(), "vid").mapInArrow(dealt(True), schema).drop("ids")
    visits = queries.withColumn("range", F.explode(F.sequence(F.col("range") - REACH, F.col("range") + REACH)))  # those there are meet in the join below
    # chunks of bounded size on both sides; ORDERINGS x RANGES counts
    size = placed.groupBy("o", "range").count().select("o", "range", F.ceil(F.col("count") / CHUNK).cast("int").alias("nb"))
    asks = visits.groupBy("o", "range").count().select("o", "range", F.ceil(F.col("count") / CHUNK).cast("int").alias("nq"))
    chunks = F.broadcast(stored(size.join(asks, ["o", "range"]), "ann-chunks"))  # at most ORDERINGS x RANGES rows
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = (placed.join(chunks, ["o", "range"]).withColumn("blk", F.pmod(F.xxhash64("vid"), F.col("nb")).cast("int"))
            .withColumn("qblk", every("nq")).select("o", "range", "blk", "qblk", "vid", "v", "ids"))
    right = (visits.join(chunks, ["o", "range"]).withColumn("qblk", F.pmod(F.xxhash64("vid"), F.col("nq")).cast("int"))
             .withColumn("blk", every("nb")).select("o", "range", "blk", "qblk", "vid", "v"))

    def score(cands, asks):
        if not cands.num_rows or not asks.num_rows:
            return pa.table({"vid": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        x, q = matrix(cands.column("v")), matrix(asks.column("v"))
        ids = cands.column("ids").to_pylist()
        first = np.array([i[0] for i in ids])
        rough = q @ x.T
        keep = min(k + 1, len(x))
        floor = np.partition(rough, len(x) - keep, axis=1)[:, len(x) - keep]
        out_ids, out_scores = [], []
        for r in range(len(q)):
            at = np.flatnonzero(rough[r] >= floor[r] - 1e-9 * (1 + abs(floor[r])))
            exact = (x[at] * q[r]).sum(axis=1)  # one order of summation everywhere: ties stay ties
            best = np.lexsort((first[at], -exact))[:keep]
            pairs = sorted((-exact[j], i) for j in best for i in ids[at[j]])[:k + 1]
            out_ids.append([i for _, i in pairs])
            out_scores.append([-s for s, _ in pairs])
        return pa.table({"vid": asks.column("vid"), "ids": pa.array(out_ids, pa.list_(pa.int64())), "scores": pa.array(out_scores, pa.list_(pa.float64()))})

    key = ["o", "range", "blk", "qblk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(score, "vid long, ids array<long>, scores array<double>")

    def merge(batches):
        vid, best = None, {}

        def top():
            pairs = sorted((-s, i) for i, s in best.items())[:k + 1]
            return pa.RecordBatch.from_pydict({"vid": pa.array([vid] * len(pairs), pa.int64()), "vec_id": pa.array([i for _, i in pairs], pa.int64()),
                                               "score": pa.array([-s for s, _ in pairs], pa.float64())})

        for b in batches:
            for v, ids, scores in zip(b.column("vid").to_pylist(), b.column("ids").to_pylist(), b.column("scores").to_pylist()):
                if v != vid:
                    if best:
                        yield top()
                    vid, best = v, {}
                elif len(best) > 8 * k:
                    best = dict(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k + 1])
                best.update(zip(ids, scores))
        if best:
            yield top()

    merged = found.repartition("vid").sortWithinPartitions("vid").mapInArrow(merge, "vid long, vec_id long, score double")
    answers = asked.join(merged, "vid").where("vec_id <> query_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (answers.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
