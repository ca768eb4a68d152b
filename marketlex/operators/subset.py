"""The best combination of sources for every target.

Every combination has its own listwise deletion and outlier filter, so each
(target, combination) fits other rows.  Rows are not copied for that: a bit
mask tells which (target, combination) pairs keep a row, rows with the same
mask are added up into one Gram matrix of all columns, and a pair sums the
matrices of the masks that hold its bit.  There are as many masks as ways for
a row to be incomplete or an outlier, not as combinations.
"""

from __future__ import annotations

from itertools import combinations
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlex.functions import stats_math as sm
from marketlex.operators.ordering import same
from marketlex.operators.stats import pvalues, round_stats
from marketlex.session import materialize

CHUNK = 100_000          # rows of a group that one task holds


class Pairs:
    """The (target, combination) pairs, numbered target by target."""

    def __init__(self, n_targets: int, n_sources: int, max_features: int):
        self.combos = [c for n in range(1, min(max_features, n_sources) + 1) for c in combinations(range(n_sources), n)]
        self.width = max((len(c) for c in self.combos), default=0)
        self.n_targets, self.n_sources = n_targets, n_sources
        self.all = [(t, c) for t in range(n_targets) for c in range(len(self.combos))]


def merge(n: np.ndarray, mu: np.ndarray, m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and centred products of several groups as one."""
    total = n.sum()
    mean = (n[:, None] * mu).sum(axis=0) / total
    d = mu - mean
    return total, mean, m.sum(axis=0) + np.einsum("g,gi,gj->ij", n, d, d)


def bounds(p: Pairs, seen: np.ndarray, n: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Mean and population deviation of each source of each pair over the
    rows complete in it (pairs x width x 2), from the rows of each pattern of
    present columns (``seen``, targets first)."""
    out = np.full((len(p.all), p.width, 2), np.nan)
    for b, (t, c) in enumerate(p.all):
        cols = [p.n_targets + j for j in p.combos[c]]
        k = seen[:, t] & seen[:, cols].all(axis=1)
        if not k.any():
            continue
        w = n[k].astype(float)
        for i, j in enumerate(p.combos[c]):
            mean = (w * mu[k, j]).sum() / w.sum()
            out[b, i] = mean, np.sqrt((w * (var[k, j] + (mu[k, j] - mean) ** 2)).sum() / w.sum())
    return out


def kept(p: Pairs, x: np.ndarray, y: np.ndarray, limits: np.ndarray, z: float) -> np.ndarray:
    """Which pairs keep which rows (rows x pairs); NaN is a missing value."""
    out = np.zeros((len(x), len(p.all)), bool)
    with np.errstate(all="ignore"):
        for b, (t, c) in enumerate(p.all):
            keep = ~np.isnan(y[:, t])
            for i, j in enumerate(p.combos[c]):
                keep &= np.abs((x[:, j] - limits[b, i, 0]) / limits[b, i, 1]) < z
            out[:, b] = keep
    return out


def _key_of(table: pa.Table, keys: Sequence[str]) -> dict:
    return {k: table.column(k).slice(0, 1) for k in keys}


def mask_moments(rows: DataFrame, p: Pairs, keys: Sequence[str], ys: Sequence[str], xs: Sequence[str], z: float, chunk: int) -> DataFrame:
    """(keys, mask, n, mu, m): a Gram matrix of all columns per distinct mask
    of a group.  A missing value counts as 0 in it; no pair whose bit the mask
    holds reads one."""
    def present(c):
        return F.col(c).isNotNull().cast("int")
    kd = [rows.schema[k] for k in keys]
    pattern = rows.groupBy(*keys, F.array(*[present(c) for c in [*ys, *xs]]).alias("seen")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in xs]).alias("mu"),
        F.array(*[F.coalesce(F.var_pop(c), F.lit(0.0)) for c in xs]).alias("var"))

    def limits(table: pa.Table) -> pa.Table:
        seen, n, mu, var = (np.array(table.column(c).to_pylist(), d) for c, d in (("seen", bool), ("n", np.int64), ("mu", float), ("var", float)))
        return pa.table({**_key_of(table, keys), "limits": pa.array([bounds(p, seen, n, mu, var).tobytes()], pa.binary()),
                         "blocks": pa.array([int(-(-n.sum() // chunk))], pa.int32())})

    out = T.StructType([*kd, T.StructField("limits", T.BinaryType()), T.StructField("blocks", T.IntegerType())])
    limit = materialize((pattern.groupBy(*keys) if keys else pattern.groupBy(F.lit(0).alias("_g"))).applyInArrow(limits, out))
    # one group is dealt to as many tasks as it has blocks of rows
    spread = F.pmod(F.xxhash64(*ys, *xs, F.monotonically_increasing_id()), F.col("blocks")).cast("int")
    left = rows.alias("r").join(limit.alias("l"), same("r", "l", keys)).select(*[F.col(f"r.`{k}`") for k in keys], *ys, *xs, spread.alias("_b"))
    right = limit.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def add(held: pa.Table, limit_rows: pa.Table) -> pa.Table:
        n_pairs = len(p.all)
        lim = np.frombuffer(limit_rows.column("limits")[0].as_py()).reshape(n_pairs, p.width, 2)
        cols = [held.column(c).to_numpy().astype(float) for c in [*ys, *xs]]
        v = np.column_stack(cols) if len(cols) else np.zeros((held.num_rows, 0))
        bits = np.packbits(kept(p, v[:, len(ys):], v[:, :len(ys)], lim, z), axis=1)
        masks, group = np.unique(bits, axis=0, return_inverse=True)
        group = group.ravel()
        v = np.nan_to_num(v)
        out = {"mask": [], "n": [], "mu": [], "m": []}
        for g, mask in enumerate(masks):
            if not mask.any():
                continue
            part = v[group == g]
            mean = part.mean(axis=0)
            d = part - mean
            for name, value in zip(out, (mask.tobytes(), len(part), mean.tobytes(), (d.T @ d).tobytes())):
                out[name].append(value)
        size = len(out["n"])
        table = {k: pa.chunked_array([pa.repeat(limit_rows.column(k)[0], size)]) for k in keys}
        return pa.table({**table, "mask": pa.array(out["mask"], pa.binary()), "n": pa.array(out["n"], pa.int64()), "mu": pa.array(out["mu"], pa.binary()), "m": pa.array(out["m"], pa.binary())})

    schema = T.StructType([*kd, *T._parse_datatype_string("mask binary, n long, mu binary, m binary").fields])
    parts = left.groupBy(*keys, "_b").cogroup(right.groupBy(*keys, "_b")).applyInArrow(add, schema)

    def total(table: pa.Table) -> pa.Table:
        n, mu, m = unpack(table, len(ys) + len(xs))
        n, mu, m = merge(n, mu, m)
        return pa.table({**_key_of(table, keys), "mask": table.column("mask").slice(0, 1), "n": pa.array([int(n)]), "mu": pa.array([mu.tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary())})
    return parts.groupBy(*keys, "mask").applyInArrow(total, schema)


def unpack(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = table.column("n").to_numpy().astype(float)
    mu = np.frombuffer(b"".join(table.column("mu").to_pylist())).reshape(-1, width)
    return n, mu, np.frombuffer(b"".join(table.column("m").to_pylist())).reshape(-1, width, width)


def best_of(p: Pairs, table: pa.Table) -> list[tuple]:
    """(target, combination, n, fit) of the best fit of each target: the
    highest R squared above 0, then fewer sources, then enumeration order."""
    n, mu, m = unpack(table, p.n_targets + p.n_sources)
    bits = np.unpackbits(np.frombuffer(b"".join(table.column("mask").to_pylist()), np.uint8).reshape(len(n), -1), axis=1)
    out = []
    for t in range(p.n_targets):
        best = None
        for c, combo in enumerate(p.combos):
            k = bits[:, t * len(p.combos) + c] > 0
            if not k.any():
                continue
            cols = [t, *[p.n_targets + j for j in combo]]
            total, mean, products = merge(n[k], mu[np.ix_(k, cols)], m[np.ix_(k, cols, cols)])
            fit = sm.ols_from_moments(int(total), mean, products / total, 0, range(1, len(cols)))
            if fit["r2"] > 0 and (best is None or fit["r2"] > best[3]["r2"]):
                best = (t, c, int(total), fit)
        if best:
            out.append(best)
    return out


def best_subset(df: DataFrame, targets: Sequence[str], sources: Sequence[str],
                keys: Sequence[str] = (), max_features: int = 3, z: float = 3.0, chunk: int = CHUNK) -> DataFrame:
    """For each target, every combination of 1..max_features sources
    (each with its own listwise deletion and predictor z-filter) is fitted
    and the strictly highest raw R^2 above 0 wins (ties: fewer features,
    then enumeration order).  A target without any winner gets a null row.
    Output: combination, R^2 (3 digits), residual normality p, and per
    chosen feature its coefficient (10 digits) and p-value (5 digits).  A NaN
    is a missing value; a null key is a key."""
    keys = list(keys)
    p = Pairs(len(targets), len(sources), max_features)
    ys, xs = [f"_y{i}" for i in range(len(targets))], [f"_x{i}" for i in range(len(sources))]
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = materialize(df.select(*keys, *[number(c).alias(a) for c, a in zip([*targets, *sources], [*ys, *xs])]))
    masks = mask_moments(rows, p, keys, ys, xs, z, chunk)
    kd = [df.schema[k] for k in keys]

    def fits(table: pa.Table) -> pa.Table:
        cols = {c: [] for c in ("target", "cid", "names", "n", "r2", "intercept", "coef", "t", "df_resid")}
        for t, c, n, fit in best_of(p, table):
            with np.errstate(all="ignore"):
                stat = np.where(fit["se"] > 0, fit["coef"] / np.where(fit["se"] > 0, fit["se"], 1), np.nan)
            for name, v in zip(cols, (targets[t], c, [sources[j] for j in p.combos[c]], n, fit["r2"], fit["intercept"], fit["coef"].tolist(), stat.tolist(), float(fit["df_resid"]))):
                cols[name].append(v)
        types = dict(cid=pa.int32(), target=pa.string(), names=pa.list_(pa.string()), n=pa.int64(), r2=pa.float64(), intercept=pa.float64(),
                     coef=pa.list_(pa.float64()), t=pa.list_(pa.float64()), df_resid=pa.float64())
        table_keys = {k: pa.chunked_array([pa.repeat(table.column(k)[0], len(cols["n"]))]) for k in keys}
        return pa.table({**table_keys, **{c: pa.array(v, types[c]) for c, v in cols.items()}})

    out = T.StructType([*kd, *T._parse_datatype_string("target string, cid int, names array<string>, n long, r2 double, intercept double, coef array<double>, t array<double>, df_resid double").fields])
    best = materialize((masks.groupBy(*keys) if keys else masks.groupBy(F.lit(0).alias("_g"))).applyInArrow(fits, out))
    best = with_normality(rows, best, p, keys, targets, ys, xs, z)
    feats = best.select(*keys, "target", "names", "r2", "normality_p", "df_resid", F.explode(F.arrays_zip("names", "coef", "t")).alias("_f"))
    feats = feats.select(*keys, "target", "names", "r2", "normality_p", "df_resid", F.col("_f.names").alias("feature"), F.col("_f.coef").alias("coefficient"), F.col("_f.t").alias("_t"))
    feats = pvalues(feats, {"p_value": ("t", "_t", "df_resid")})
    res = feats.select(*keys, "target", "names", round_stats("r2", 3).alias("r_squared"), "normality_p", "feature",
                       round_stats("coefficient", 10).alias("coefficient"), round_stats("p_value", 5).alias("p_value"))
    all_t = df.sparkSession.createDataFrame([(t,) for t in targets], "target string")
    base = df.select(*keys).distinct().crossJoin(all_t) if keys else all_t  # a row per key and target
    joined = base.alias("b").join(res.alias("r"), same("b", "r", [*keys, "target"]), "left")
    return joined.select(*[F.col(f"b.`{k}`") for k in keys], F.col("b.target").alias("stock_variable"), F.col("names").alias("combination"),
                         "r_squared", "normality_p", "feature", "coefficient", "p_value")


def with_normality(rows: DataFrame, best: DataFrame, p: Pairs, keys: Sequence[str], targets: Sequence[str], ys: Sequence[str], xs: Sequence[str], z: float) -> DataFrame:
    """``best`` with ``normality_p`` of the residuals of each winning fit: a
    row meets one fit per target."""
    combos = F.array(*[F.array(*[F.lit(j) for j in c]) for c in p.combos])
    values = F.array(*[F.col(c) for c in xs])
    long = rows.select(*keys, values.alias("_v"), F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(y).alias("_y")) for t, y in zip(targets, ys)]))).where("_y is not null")
    fit = best.select(*keys, "target", "coef", "intercept", F.element_at(combos, F.col("cid") + 1).alias("_c"))
    met = long.alias("l").join(fit.alias("f"), same("l", "f", [*keys, "target"])).select(
        *[F.col(f"l.`{k}`") for k in keys], "l.target", "_y", "coef", "intercept", F.transform("_c", lambda j: F.col("_v")[j]).alias("_x"))
    met = met.where(~F.exists("_x", lambda x: x.isNull()))
    # the same filter as the fit's: z-scores over the rows complete in it
    g = [*keys, "target"]
    one = lambda f, j: f(F.try_element_at("_x", F.lit(j + 1)))
    stats = met.groupBy(*g).agg(*[one(F.avg, j).alias(f"_m{j}") for j in range(p.width)], *[one(F.stddev_pop, j).alias(f"_s{j}") for j in range(p.width)])
    d = met.alias("l").join(stats.alias("s"), same("l", "s", g)).select("l.*", *[f"_m{j}" for j in range(p.width)], *[f"_s{j}" for j in range(p.width)])
    keep, fitted = F.lit(True), F.col("intercept")
    for j in range(p.width):
        x = F.try_element_at("_x", F.lit(j + 1))
        keep = keep & (x.isNull() | F.coalesce(F.abs(F.try_divide(x - F.col(f"_m{j}"), F.col(f"_s{j}"))) < z, F.lit(False)))
        fitted = fitted + F.coalesce(F.try_element_at("coef", F.lit(j + 1)) * x, F.lit(0.0))
    shape = d.where(keep).withColumn("_e", F.col("_y") - fitted).groupBy(*g).agg(
        F.count("_e").alias("_nn"), F.skewness("_e").alias("_skew"), F.kurtosis("_e").alias("_kurt"))
    out = best.alias("b").join(shape.alias("s"), same("b", "s", g)).select("b.*", "_nn", "_skew", "_kurt")
    return pvalues(out, {"normality_p": ("k2", "_skew", "_kurt", "_nn")})
