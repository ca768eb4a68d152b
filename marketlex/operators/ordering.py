"""Deterministic ordering helpers: positions without a window over a whole
table or a whole group."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The top 12 bits of a signed 64-bit hash keep the hash order (floor
# division by 2^52): 4096 buckets per group.
HASH_BUCKET_SHIFT = 52


def hash_order(seed: int, *cols) -> Column:
    """Seeded pseudo-random order key ``xxhash64(seed, cols...)``; the same
    seed gives the same order whatever the partitioning."""
    return F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])


def hash_bucket(h: Column) -> Column:
    return F.shiftright(h, HASH_BUCKET_SHIFT)


def global_row_number(df: DataFrame, order_cols: Sequence, bucket: Column,
                      name: str = "pos", partition_cols: Sequence[str] = (),
                      size_col: str | None = None) -> DataFrame:
    """1-based position of every row in ``order_cols`` order (within
    ``partition_cols`` groups when given); ``size_col`` optionally adds the
    group's row count.

    A null partition value is a group, a null bucket comes first.
    ``bucket`` must be monotone in that order.  Rows are numbered inside
    their (group, bucket) -- many window partitions spread over the cluster,
    so a group holding a third of all rows is still split 4096 ways under
    hash buckets -- and shifted by the row count of all earlier buckets of
    the group.  Bucket sizes come from the same window pass (one shuffle of
    the rows); the offsets table has one row per (group, bucket).  Its size
    is only known at run time (groups x buckets), so the join strategy is
    left to AQE, which broadcasts it after measuring it.
    """
    pc = list(partition_cols)
    # one struct as key: nulls inside it are equal, in the windows and in the join
    w = Window.partitionBy("__key")
    numbered = df.withColumn("__key", F.struct(*pc, bucket.alias("__bkt"))).select(
        "*", F.row_number().over(w.orderBy(*order_cols)).alias("__rn"),
        F.count(F.lit(1)).over(w).alias("__cnt"))
    sizes = numbered.select("__key", "__cnt").distinct()
    group = Window.partitionBy(*[F.col(f"__key.`{c}`") for c in pc])
    before = group.orderBy("__key.__bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__key", F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"), F.sum("__cnt").over(group).alias("__size"))
    out = numbered.join(offsets, "__key")
    out = out.withColumn(name, F.col("__off") + F.col("__rn"))
    if size_col:
        out = out.withColumn(size_col, F.col("__size"))
    return out.drop("__key", "__rn", "__cnt", "__off", "__size")


def same(left: str, right: str, cols: Sequence[str]) -> list[Column]:
    """Join condition of two aliased tables on columns in which null equals
    null."""
    return [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in cols] or [F.lit(True)]


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, lengthened until no column of the tables has it."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


HASH_TOP_SHIFT = 48      # the first histogram: 65,536 ranges of the hash
MOST_SHIPPED = 10_000    # rows of a table of cuts that may be broadcast


def small(df: DataFrame, limit: int = MOST_SHIPPED) -> DataFrame:
    """``df`` (stored, or cheap to count) marked for broadcast if it has at
    most ``limit`` rows; larger ones are joined by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hash_intervals(df: DataFrame, seed: int, id_cols: Sequence[str], cuts: DataFrame, name: str, partition_cols: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``: how many of the group's cut ranks lie before the row in
    seeded pseudo-random order (0 for the rows of rank up to the first cut).

    ``cuts`` has the partition columns and ``ranks``, an ascending array, for
    every group.  The hash at which a rank falls is found from two histograms,
    of the top 16 bits of the hash and, inside the range hit, of whole hashes:
    aggregates over the id and partition columns alone.  Rows are then
    compared with the few hashes of their group, so they are not moved.  Only
    where several rows share the hash of a cut (repeated ids) are those rows
    numbered, by a hash of all their columns."""
    from marketlex.session import materialize
    pc = list(partition_cols)
    h = hash_order(seed, *id_cols)
    top = F.shiftright("__h", HASH_TOP_SHIFT)
    narrow = df.select(*pc, h.alias("__h"))
    by_group = Window.partitionBy(*pc)
    ranges = narrow.groupBy(*pc, top.alias("__top")).agg(F.count(F.lit(1)).alias("__n"))
    ranges = ranges.withColumn("__upto", F.sum("__n").over(by_group.orderBy("__top")))
    wanted = cuts.select(*pc, F.posexplode("ranks").alias("__i", "__rank"))
    hit = (wanted.alias("w").join(ranges.alias("r"), [*same("w", "r", pc), F.col("__rank") > F.col("__upto") - F.col("__n"), F.col("__rank") <= F.col("__upto")])
           .select(*[F.col(f"w.`{c}`") for c in pc], "__i", "__rank", "__top", (F.col("__upto") - F.col("__n")).alias("__before")))
    hit = materialize(hit)
    looked = small(materialize(hit.select(*pc, "__top").distinct()))
    hashes = (narrow.withColumn("__top", top).alias("n").join(looked.alias("l"), [*same("n", "l", pc), F.col("n.__top") == F.col("l.__top")], "left_semi")
              .groupBy(*pc, "__top", "__h").agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__upto", F.sum("__n").over(Window.partitionBy(*pc, "__top").orderBy("__h"))))
    at = F.col("__rank") - F.col("__before")
    cut = (hit.alias("w").join(hashes.alias("r"), [*same("w", "r", pc), F.col("w.__top") == F.col("r.__top"), at > F.col("__upto") - F.col("__n"), at <= F.col("__upto")])
           .select(*[F.col(f"w.`{c}`") for c in pc], "__i", "__h", (at - F.col("__upto") + F.col("__n")).alias("__take"), "__n"))
    cut = materialize(cut)
    none = wanted.where("__rank <= 0").groupBy(*pc).agg(F.count(F.lit(1)).alias("__zero"))  # every row is past a rank of 0
    listed = cut.groupBy(*pc).agg(F.sort_array(F.collect_list(F.struct("__h", "__take", "__n"))).alias("__cuts"))  # as many as the group has cuts
    table = cuts.select(*pc).alias("c").join(listed.alias("l"), same("c", "l", pc), "left").select(*[F.col(f"c.`{c}`") for c in pc], "__cuts")
    table = table.alias("c").join(none.alias("z"), same("c", "z", pc), "left").select(*[F.col(f"c.`{c}`") for c in pc], "__cuts", F.coalesce("__zero", F.lit(0)).alias("__zero"))
    table = small(materialize(table))
    marked = df.withColumn("__h", h).alias("d").join(table.alias("t"), same("d", "t", pc)).select("d.*", "__cuts", "__zero")
    count = lambda keep: F.coalesce(F.size(F.filter("__cuts", keep)), F.lit(0))
    past = F.col("__zero").cast("int") + F.greatest(count(lambda c: c["__h"] < F.col("__h")), F.lit(0))
    if not cut.where("__take < __n").head(1):
        return marked.withColumn(name, past).drop("__h", "__cuts", "__zero")
    shared = F.exists(F.coalesce("__cuts", F.array()), lambda c: (c["__h"] == F.col("__h")) & (c["__take"] < c["__n"]))
    alone = marked.where(~shared).withColumn(name, past)
    whole = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])
    tied = marked.where(shared).withColumn("__w", whole)
    tied = global_row_number(tied, ["__w"], hash_bucket(F.col("__w")), "__k", [*pc, "__h"])
    tied = tied.withColumn(name, past + count(lambda c: (c["__h"] == F.col("__h")) & (c["__take"] < F.col("__k"))))
    cols = [*[f"`{c}`" for c in df.columns], name]
    return alone.select(*cols).unionByName(tied.select(*cols))


PERCENTILE_BUCKETS = 4096


def rank_percentiles(df: DataFrame, value: str, ps: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated percentiles per group as ``(keys, _p)``
    (array in the order of ``ps``; null where a group has no value), without
    a buffer of a group's values: values are counted in 4096 equal-width
    buckets between the group's extremes, only the buckets that hold a wanted
    rank are looked into, and equal values are one row there."""
    kc = list(keys) or ["_all"]
    d = df.select(*([F.col(k) for k in keys] or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    width = F.col("_hi") - F.col("_lo")
    ends = d.groupBy(*kc).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"e.{k}")) for k in kc]
    placed = d.alias("d").join(ends.alias("e"), on).select(
        *[F.col(f"d.{k}").alias(k) for k in kc], "_v",
        F.when(width == 0, 0).otherwise(F.floor((F.col("_v") - F.col("_lo")) / width * PERCENTILE_BUCKETS)).alias("_b"))
    counts = placed.groupBy(*kc, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*kc).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (counts.groupBy(*kc, "_b").agg(F.sum("_c").alias("_c"))
             .withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))))  # at most 4097 rows a group
    want = ends.select(*kc, F.posexplode(F.array(*[F.lit(float(p)) for p in ps])).alias("_i", "_q"), "_n").select(
        *kc, "_i", (F.col("_q") * (F.col("_n") - 1)).alias("_at"))
    want = want.select(*kc, "_i", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_k")).distinct()
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}")) for k in kc]
    held = want.alias("w").join(sizes.alias("s"), [*same, F.col("_k") >= F.col("_off"), F.col("_k") < F.col("_off") + F.col("_c")]).select(
        *[F.col(f"w.{k}").alias(k) for k in kc], "_i", "_at", "_k", "_b", "_off")
    inside = Window.partitionBy(*kc, "_b").orderBy("_v")
    needed = [F.col(f"c.{k}").eqNullSafe(F.col(f"h.{k}")) for k in kc] + [F.col("c._b") == F.col("h._b")]
    ranked = (counts.alias("c").join(held.select(*kc, "_b").distinct().alias("h"), needed, "left_semi")
              .withColumn("_to", F.sum("_c").over(inside)))
    pick = [F.col(f"h.{k}").eqNullSafe(F.col(f"r.{k}")) for k in kc] + [F.col("h._b") == F.col("r._b")]
    got = held.alias("h").join(ranked.alias("r"), pick).where((F.col("_k") - F.col("_off") < F.col("_to")) & (F.col("_k") - F.col("_off") >= F.col("_to") - F.col("_c")))
    one = got.groupBy(*[F.col(f"h.{k}").alias(k) for k in kc], "_i", "_at").agg(
        F.min_by("_v", "_k").alias("_x"), F.max_by("_v", "_k").alias("_y"))
    one = one.withColumn("_p", F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_at") - F.floor("_at")))
    out = one.groupBy(*kc).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_p"))), lambda s: s["_p"]).alias("_p"))
    return out if keys else out.drop("_all")


def hash_row_number(df: DataFrame, seed: int, id_cols: Sequence[str], name: str = "pos",
                    partition_cols: Sequence[str] = (), size_col: str | None = None) -> DataFrame:
    """Position in seeded pseudo-random order (ties on the id columns)."""
    h = hash_order(seed, *id_cols)
    d = df.withColumn("__h", h)
    out = global_row_number(d, [F.col("__h"), *[F.col(c) for c in id_cols]],
                            hash_bucket(F.col("__h")), name, partition_cols, size_col)
    return out.drop("__h")
