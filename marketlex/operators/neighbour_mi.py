"""Mutual information of lagged sources and a target by nearest
neighbours (Kraskov, Stoegbauer and Grassberger 2004, first estimator).

For every point of a series the distance ``eps`` to its ``k``-th neighbour in
the (x, y) plane (greater of the two coordinate differences, each in standard
deviations) is found, then
the numbers ``n_x`` and ``n_y`` of other points nearer than ``eps`` in each
coordinate alone; the estimate is
``psi(n) + psi(k) - mean(psi(n_x + 1) + psi(n_y + 1))``, at least 0.

How it is spread: equal points are one with a multiplicity.  The points of a
series are sorted by x into strips and each strip by y into *tiles* of at most
``tile`` points, so a series that holds most of the rows, and a value that
most points share, are many tiles.  Each tile gives its points an upper bound
on ``eps``; only the tiles that a point's square of that size touches are then
asked, and the answers merged.  For the counts the values of one coordinate
are cut into chunks with the number of points before each, and a point asks
the one or two chunks in which its interval ends.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlex.operators.ordering import hash_row_number
from marketlex.session import materialize

NEIGHBOURS = 3
TILE = 50_000            # points of a tile, values of a chunk
MOST_TILES = 50_000      # of all series together that have several: their borders are shipped to tasks
TINY = 5e-324            # the least positive double: "nearer than" it means equal


# ---- inside a task ---------------------------------------------------------

class Tile:
    """Distinct points with multiplicities, in sub-strips of about as many
    points as there are strips, each sorted by y."""

    def __init__(self, x: np.ndarray, y: np.ndarray, m: np.ndarray, sx: float = 1.0, sy: float = 1.0):
        n = len(x)
        self.sx, self.sy = sx, sy
        self.width = max(1, int(np.sqrt(n)))
        by_x = np.lexsort((y, x))
        strip = np.empty(n, np.int64)
        strip[by_x] = np.arange(n) // self.width
        order = np.lexsort((x, y, strip))
        self.x, self.y, self.m, self.source = x[order], y[order], m[order], order
        strip = strip[order]
        self.strips = int(strip[-1]) + 1
        self.start = np.searchsorted(strip, np.arange(self.strips + 1))
        self.low = np.minimum.reduceat(self.x, self.start[:-1])
        self.high = np.maximum.reduceat(self.x, self.start[:-1])
        self.levels = np.unique(self.y)
        self.key = strip * (len(self.levels) + 1) + np.searchsorted(self.levels, self.y)

    def scan(self, s: np.ndarray, rows: np.ndarray, qx, qy, best, own) -> None:
        """Put the points of strip ``s[j]`` into the nearest of query
        ``rows[j]``: outward in y until the difference reaches the last."""
        at = np.searchsorted(self.key, s * (len(self.levels) + 1) + np.searchsorted(self.levels, qy[rows]))
        for step, place, end in ((1, at, self.start[s + 1]), (-1, at - 1, self.start[s] - 1)):
            r, p, e = rows, place.copy(), end
            while len(r):
                inside = p != e
                r, p, e = r[inside], p[inside], e[inside]
                near = np.abs(self.y[p] - qy[r]) / self.sy < best[r, -1]
                r, p, e = r[near], p[near], e[near]
                d = np.maximum(np.abs(self.x[p] - qx[r]) / self.sx, np.abs(self.y[p] - qy[r]) / self.sy)
                take = d < best[r, -1]
                if own is not None:
                    take &= self.source[p] != own[r]
                if take.any():
                    put(best, r[take], d[take], self.m[p[take]])
                p = p + step

    def nearest(self, qx: np.ndarray, qy: np.ndarray, best: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """``best`` (queries x k distances, ascending) improved by the tile's
        points; ``own`` gives a query's own point, which does not count."""
        home = np.clip(np.searchsorted(self.low, qx, "right") - 1, 0, self.strips - 1)
        self.scan(home, np.arange(len(qx)), qx, qy, best, own)
        for step in (1, -1):
            rows, s = np.arange(len(qx)), home + step
            while len(rows):
                there = (s >= 0) & (s < self.strips)
                rows, s = rows[there], s[there]
                gap = self.low[s] - qx[rows] if step > 0 else qx[rows] - self.high[s]
                near = gap / self.sx < best[rows, -1]
                rows, s = rows[near], s[near]
                self.scan(s, rows, qx, qy, best, own)
                s = s + step
        return best


def put(best: np.ndarray, rows: np.ndarray, d: np.ndarray, m: np.ndarray) -> None:
    k = best.shape[1]
    more = np.where(np.arange(k) < m[:, None], d[:, None], np.inf)
    best[rows] = np.sort(np.concatenate([best[rows], more], axis=1), axis=1)[:, :k]


def within(values: np.ndarray, x: np.ndarray, eps: np.ndarray, s=1.0) -> np.ndarray:
    """How many ascending ``values`` v have ``(v - x) / s < eps``, as the
    rounded difference says: equal differences fall on the same side."""
    at = np.searchsorted(values, x + eps * s)
    while True:
        up = (at < len(values)) & ((values[np.minimum(at, len(values) - 1)] - x) / s < eps)
        down = (at > 0) & ~((values[np.maximum(at - 1, 0)] - x) / s < eps)
        if not (up | down).any():
            return at
        at = at + up - down


def beyond(values: np.ndarray, x: np.ndarray, eps: np.ndarray, s=1.0) -> np.ndarray:
    """How many ascending ``values`` v have ``(x - v) / s >= eps``."""
    at = np.searchsorted(values, x - eps * s, "right")
    while True:
        up = (at < len(values)) & ((x - values[np.minimum(at, len(values) - 1)]) / s >= eps)
        down = (at > 0) & ~((x - values[np.maximum(at - 1, 0)]) / s >= eps)
        if not (up | down).any():
            return at
        at = at + up - down


def column(b, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(name).to_numpy()


def scales(table: pa.Table) -> tuple[float, float]:
    return table.column("sx")[0].as_py(), table.column("sy")[0].as_py()


def lists(best: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]), pa.array(np.ascontiguousarray(best).ravel()))


# ---- tables ----------------------------------------------------------------

def cut(df: DataFrame, order: Sequence[str], size: int, name: str) -> DataFrame:
    """``df`` sorted by ``order``, whose first column is a group, with the
    number ``name`` of a chunk of at most ``size`` rows of one group; numbers
    ascend in that order."""
    group = order[0]

    def run(batches):
        from pyspark import TaskContext
        chunk, held, last = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            g = column(b, group)
            out = np.empty(len(g), np.int64)
            at = 0
            while at < len(g):
                if g[at] != last or held == size:
                    chunk, held, last = chunk + 1, 0, g[at]
                other = np.flatnonzero(g[at:at + size - held] != last)
                n = int(other[0]) if len(other) else min(size - held, len(g) - at)
                out[at:at + n] = chunk
                at, held = at + n, held + n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, name])

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ddl = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return materialize(dealt.mapInArrow(run, f"{ddl}, {name} long"))


def long_pairs(df: DataFrame, target: str, sources: Sequence[str], max_lags: int, keys: Sequence[str]) -> DataFrame:
    """(keys, source, lag, x, y) of the pairs of which both are finite."""
    pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(l).alias("lag"), F.col(f"{s}_lag_{l}").cast("double").alias("x"))
                      for l in range(1, max_lags + 1) for s in sources])
    d = df.select(*keys, F.col(target).cast("double").alias("y"), F.inline(pairs))
    finite = lambda c: (F.abs(F.col(c)) < float("inf")) & ~F.isnan(c)
    return d.where(finite("x") & finite("y"))


class Tiles:
    """Borders of the tiles of series that have more than one."""

    def __init__(self, rows):
        self.by_series: dict = {}
        strips: dict = {}
        for r in rows:  # by series, strip, tile
            strips.setdefault((r.g, r.s), []).append(r)
        for (g, _), tiles in strips.items():
            self.by_series.setdefault(g, (tiles[0].sx, tiles[0].sy, []))[2].append(
                (min(t.x0 for t in tiles), max(t.x1 for t in tiles), np.array([t.y0 for t in tiles]), np.array([t.y1 for t in tiles]),
                 np.array([t.x0 for t in tiles]), np.array([t.x1 for t in tiles]), np.array([t.t for t in tiles], np.int64)))

    def touched(self, g: int, x: np.ndarray, y: np.ndarray, r: np.ndarray):
        """Yields (tile, places): the points whose square of half-width ``r``
        touches the tile."""
        sx, sy, strips = self.by_series[g]
        for x0, x1, ys0, ys1, xs0, xs1, t in strips:
            rows = np.flatnonzero(np.maximum(x0 - x, x - x1) / sx < r)
            if not len(rows):
                continue
            # tiles of a strip ascend in y, so those touched are neighbours
            first = np.searchsorted(ys1, y[rows] - r[rows] * sy) - 1
            last = np.searchsorted(ys0, y[rows] + r[rows] * sy, "right") + 1
            for j in range(max(0, int(first.min())), min(len(t), int(last.max()))):
                at = rows[(first <= j) & (j < last)]
                gap = np.maximum(np.maximum(xs0[j] - x[at], x[at] - xs1[j]) / sx, np.maximum(ys0[j] - y[at], y[at] - ys1[j]) / sy)
                yield t[j], at[gap < r[at]]


def most_points(series: DataFrame, tile: int) -> int:
    """Points of a tile: ``tile``, or more where the table would make over
    ``MOST_TILES`` of them."""
    total = series.agg(F.sum("n").alias("n")).first().n or 0
    return max(tile, -(-total // MOST_TILES))


def neighbour_distances(points: DataFrame, k: int, tile: int) -> DataFrame:
    """(g, sx, sy, x, y, m, eps) of ``points(g, sx, sy, x, y, m)``, distinct in
    (g, x, y); differences in x count by ``sx``, in y by ``sy``."""
    spark = points.sparkSession
    chunks = cut(points, ["g", "x", "y"], tile, "c")
    sizes = chunks.groupBy("g", "c").count()
    by_series = Window.partitionBy("g")
    # a series of c chunks becomes about sqrt(c) strips; one row per chunk here
    strips = sizes.select("g", "c", (F.row_number().over(by_series.orderBy("c")) - 1).alias("p"), F.ceil(F.sqrt(F.count("*").over(by_series))).alias("w")) \
        .select("c", F.min("c").over(Window.partitionBy("g", F.floor(F.col("p") / F.col("w")))).alias("s"))
    tiles = cut(chunks.join(strips, "c").select("s", "g", "sx", "sy", "x", "y", "m"), ["s", "y", "x"], tile, "t")
    empty = np.full(k, np.inf)

    def own(table: pa.Table) -> pa.Table:
        x, y, m = (column(table, c) for c in ("x", "y", "m"))
        best = np.where(np.arange(k) < (m - 1)[:, None], 0.0, empty)
        best = Tile(x, y, m, *scales(table)).nearest(x, y, best, np.arange(len(x)))
        return pa.table({**{c: table.column(c) for c in ("g", "t", "sx", "sy", "x", "y", "m")}, "near": lists(best)})

    near = "near array<double>"
    first = materialize(tiles.groupBy("t").applyInArrow(own, f"g long, t long, sx double, sy double, x double, y double, m long, {near}"))
    borders = tiles.groupBy("g", "s", "t").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
                                                 F.first("sx").alias("sx"), F.first("sy").alias("sy"))
    several = borders.select("*", F.count("*").over(by_series).alias("n")).where("n > 1").orderBy("g", "s", "t").collect()
    if several:
        shipped = spark.sparkContext.broadcast(Tiles(several))

        def ask(batches):
            for b in batches:
                g, t, x, y = (column(b, c) for c in ("g", "t", "x", "y"))
                flat = b.column("near").flatten().to_numpy(zero_copy_only=False)
                r = flat.reshape(-1, k)[:, -1] if len(g) else flat
                for series in np.unique(g):
                    if series not in shipped.value.by_series:
                        continue
                    rows = np.flatnonzero((g == series) & (r > 0))
                    for other, at in shipped.value.touched(series, x[rows], y[rows], r[rows]):
                        at = rows[at]
                        at = at[t[at] != other]
                        if len(at):
                            yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(at), other)), "g": pa.array(g[at]), "x": pa.array(x[at]), "y": pa.array(y[at]), "r": pa.array(r[at])})

        asked = materialize(first.mapInArrow(ask, "t long, g long, x double, y double, r double"))
        # many questions to one tile go to several tasks, the tile with them
        blocks = asked.groupBy("t").agg(F.ceil(F.count("*") / tile).cast("int").alias("nb"))
        left = tiles.join(blocks, "t").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("t", "b", "sx", "sy", "x", "y", "m")
        right = asked.join(blocks, "t").withColumn("b", F.pmod(F.xxhash64("x", "y"), F.col("nb")).cast("int")).select("t", "b", "g", "x", "y", "r")

        def answer(held: pa.Table, questions: pa.Table) -> pa.Table:
            x, y, r = (column(questions, c) for c in ("x", "y", "r"))
            best = np.repeat(r[:, None], k, axis=1)
            if held.num_rows and len(x):
                best = Tile(*(column(held, c) for c in ("x", "y", "m")), *scales(held)).nearest(x, y, best)
            return pa.table({**{c: questions.column(c) for c in ("g", "x", "y")}, "near": lists(best)})

        found = left.groupBy("t", "b").cogroup(right.groupBy("t", "b")).applyInArrow(answer, f"g long, x double, y double, {near}")
        # an answer repeats the bound where it found less than k; the bound itself is the k-th of the first round
        merged = first.select("g", "sx", "sy", "x", "y", "m", "near").unionByName(found, allowMissingColumns=True)
        first = merged.groupBy("g", "x", "y").agg(*[F.max(c).alias(c) for c in ("sx", "sy", "m")], F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return materialize(first.select("g", "sx", "sy", "x", "y", "m", F.element_at("near", k).alias("eps")))


def neighbours_in(points: DataFrame, axis: str, tile: int) -> DataFrame:
    """(g, x, y, n) of ``neighbour_distances``: the number of other points nearer than ``eps`` in coordinate ``axis``; those that share it
    where ``eps`` is 0."""
    spark = points.sparkSession
    values = points.groupBy("g", F.col(axis).alias("v")).agg(F.sum("m").alias("n"))
    chunks = cut(values, ["g", "v"], tile, "c")
    by_series = Window.partitionBy("g").orderBy("c")
    whole = Window.partitionBy("g")
    sizes = materialize(chunks.groupBy("g", "c").agg(F.max("v").alias("v1"), F.sum("n").alias("n")).select(
        "g", "c", "v1", (F.sum("n").over(by_series) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"), F.count("*").over(whole).alias("of")))
    borders: dict = {}
    for r in sizes.where("of > 1").orderBy("g", "c").collect():  # few rows a tile, see most_points
        borders.setdefault(r.g, []).append((r.c, r.v1, r.before, r.total))
    shipped = spark.sparkContext.broadcast({g: [np.array(col) for col in zip(*rows)] for g, rows in borders.items()})
    asked = points.join(sizes.where("of = 1").select("g", F.col("c").alias("only")), "g", "left")

    def ask(batches):
        """A row for each chunk in which the interval of a point ends."""
        for b in batches:
            g, v, eps, scale = (column(b, c) for c in ("g", axis, "eps", f"s{axis}"))
            only = b.column("only")
            for series in np.unique(g):
                rows = np.flatnonzero(g == series)
                c, v1, before, total = shipped.value.get(series) or [np.array([z]) for z in (only[int(rows[0])].as_py(), np.inf, 0, 0)]
                x, e, s = v[rows], np.maximum(eps[rows], TINY), scale[rows[0]]
                high, low = within(v1, x, e, s), beyond(v1, x, e, s)   # chunks wholly before the end
                last = len(c) - 1
                base = np.where(high > last, total[0], before[np.minimum(high, last)]) - before[low]
                up = np.where(high > last, low, high)
                for chunk, mask, part in ((low, np.ones(len(rows), bool), 1), (up, up != low, 2)):
                    at = np.flatnonzero(mask)
                    yield pa.RecordBatch.from_pydict({
                        "c": pa.array(c[chunk[at]]), "g": pa.array(g[rows[at]]), "x": b.column("x").take(pa.array(rows[at])), "y": b.column("y").take(pa.array(rows[at])),
                        "v": pa.array(x[at]), "eps": pa.array(e[at]), "s": pa.array(np.full(len(at), s)), "base": pa.array(base[at] if part == 1 else np.zeros(len(at), np.int64)),
                        "low": pa.array(np.full(len(at), part == 1)), "high": pa.array((high[at] <= last) & ((chunk[at] == high[at])))})

    schema = "c long, g long, x double, y double, v double, eps double, s double, base long, low boolean, high boolean"
    questions = materialize(asked.select("g", "x", "y", "eps", f"s{axis}", "only").mapInArrow(ask, schema))
    blocks = questions.groupBy("c").agg(F.ceil(F.count("*") / (4 * tile)).cast("int").alias("nb"))
    left = chunks.join(blocks, "c").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("c", "b", "v", "n")
    right = questions.join(blocks, "c").withColumn("b", F.pmod(F.xxhash64("x", "y"), F.col("nb")).cast("int")).drop("nb")

    def answer(held: pa.Table, asks: pa.Table) -> pa.Table:
        order = np.argsort(column(held, "v"))
        v, n = column(held, "v")[order], column(held, "n")[order]
        upto = np.concatenate(([0], np.cumsum(n)))
        x, e, s = column(asks, "v"), column(asks, "eps"), column(asks, "s")
        low, high = (np.array(asks.column(c).to_pylist(), bool) for c in ("low", "high"))
        count = column(asks, "base") + np.where(high, upto[within(v, x, e, s)], 0) - np.where(low, upto[beyond(v, x, e, s)], 0)
        return pa.table({"g": asks.column("g"), "x": asks.column("x"), "y": asks.column("y"), "n": pa.array(count)})

    found = left.groupBy("c", "b").cogroup(right.groupBy("c", "b")).applyInArrow(answer, "g long, x double, y double, n long")
    return found.groupBy("g", "x", "y").agg((F.sum("n") - 1).alias("n"))


def digamma(n: Column) -> Column:
    """psi of a positive integer: the asymptotic series eight places further
    on, less the reciprocals on the way (error below 1e-11)."""
    z = n + 8
    s = F.log(z) - 1 / (2 * z) - 1 / (12 * z ** 2) + 1 / (120 * z ** 4) - 1 / (252 * z ** 6) + 1 / (240 * z ** 8)
    for j in range(8):
        s = s - 1 / (n + j)
    return s


def neighbour_information(df: DataFrame, target: str, sources: Sequence[str], max_lags: int = 5, keys: Sequence[str] = (),
                          k: int = NEIGHBOURS, tile: int = TILE) -> DataFrame:
    """(keys, source, lag, n, mi) from the columns ``{source}_lag_{lag}`` and
    ``target``; differences count in standard deviations of the series (a
    constant one has differences of 0).

    Pairs with a null, NaN or infinite value take no part; a series of ``k``
    pairs or fewer has a null ``mi``.  Equal values are ties: where the
    ``k``-th neighbour is an equal point, the points that share a coordinate
    are counted.  A null key is a key."""
    long = long_pairs(df, target, sources, max_lags, keys)
    g = [*keys, "source", "lag"]
    stats = long.groupBy(*g).agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    series = materialize(hash_row_number(stats, 0, g, "g"))
    scale = lambda s: F.when(F.col(s) > 0, F.col(s)).otherwise(1.0).alias(s[2:])
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in g]
    points = (long.alias("l").join(series.where(F.col("n") > k).alias("r"), same)
              .select("r.g", scale("r.sx"), scale("r.sy"), (F.col("l.x") + 0.0).alias("x"), (F.col("l.y") + 0.0).alias("y"))
              .groupBy("g", "sx", "sy", "x", "y").agg(F.count("*").alias("m")))
    tile = most_points(series, tile)
    near = neighbour_distances(points, k, tile)
    sums = None
    for axis in ("x", "y"):
        n = neighbours_in(near, axis, tile)
        part = near.join(n, ["g", "x", "y"]).groupBy("g").agg(F.sum(F.col("m") * digamma(F.col("n") + 1)).alias("s"))
        sums = part if sums is None else sums.unionByName(part)
    total = sums.groupBy("g").agg(F.sum("s").alias("s"))
    mi = F.greatest(digamma(F.col("n")) + digamma(F.lit(k)) - F.col("s") / F.col("n"), F.lit(0.0))
    return series.join(total, "g", "left").select(*g, "n", F.when(F.col("s").isNotNull(), mi).alias("mi"))


def select_lags_by_neighbours(df: DataFrame, target: str, sources: Sequence[str], max_lags: int = 5, keep: int = 2, keys: Sequence[str] = (),
                              k: int = NEIGHBOURS, tile: int = TILE) -> DataFrame:
    """G15 with the estimator above: (keys, lag, mean_mi, rank, selected), the
    mean over sources, lags ranked by it (ties: shorter lag, no value last)."""
    mi = neighbour_information(df, target, sources, max_lags, keys, k, tile)
    score = mi.groupBy(*keys, "lag").agg(F.avg("mi").alias("mean_mi"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("mean_mi"), "lag"))
    return score.withColumn("rank", rank).withColumn("selected", F.col("rank") <= keep)
