"""Sinks: result tables, error reports, evaluation logs, variant caches."""

from __future__ import annotations

import functools
import hashlib
import re
import types
import uuid
from typing import Callable, Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, run_id: str, partition_by: Sequence[str] = ("model", "dataset"),
                  fmt: str = "parquet") -> None:
    """Append a run's result rows; the run id (seed, timestamp, ...) is a
    column instead of a file name, and the table is partitioned so readers
    prune by model / dataset."""
    (df.withColumn("run_id", F.lit(run_id)).withColumn("written_at", F.current_timestamp())
     .write.mode("append").partitionBy(*partition_by).format(fmt).save(path))


def write_misclassified(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Error report (see ``scoring.misclassified``)."""
    w = df.write.mode("append")
    if fmt == "csv":
        w = w.option("header", True).option("encoding", "UTF-8")
    w.format(fmt).save(path)


def append_eval_log(df: DataFrame, path: str, fmt: str = "csv", run: str | None = None, batch_id: int | None = None) -> None:
    """Append one metrics row per evaluation (header written per file).

    With ``run`` and ``batch_id`` the rows are the log of that batch: they go
    to a partition of their own, which a repeated call replaces, so a batch
    that is retried counts once."""
    once = run is not None and batch_id is not None
    if once:
        df = df.withColumn("run", F.lit(run)).withColumn("batch_id", F.lit(batch_id))
    w = df.write.mode("overwrite" if once else "append")
    if once:
        w = w.partitionBy("run", "batch_id").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


# ------------------------------------------------------------ S5: the cache
def code_digest(fn, seen: frozenset = frozenset()) -> str:
    """Digest of what a Python function does, as far as it can be read: its
    byte code, constants and defaults, the values it closes over, and the same
    of the functions and plain values it refers to by name."""
    if id(fn) in seen:
        return "again"
    seen = seen | {id(fn)}

    def of(v):
        if isinstance(v, functools.partial):
            return ("partial", of(v.func), of(v.args), of(v.keywords))
        if isinstance(v, types.CodeType):
            return (v.co_code, tuple(of(c) for c in v.co_consts), v.co_names, v.co_varnames)
        if isinstance(v, (str, bytes, int, float, complex, bool, type(None))):
            return (type(v).__name__, v)
        if isinstance(v, (list, tuple)):
            return (type(v).__name__, *map(of, v))
        if isinstance(v, (set, frozenset)):
            return (type(v).__name__, *sorted(map(repr, map(of, v))))
        if isinstance(v, dict):
            return ("dict", *sorted(repr((of(k), of(x))) for k, x in v.items()))
        if isinstance(v, types.FunctionType):
            return ("function", code_digest(v, seen))
        if isinstance(v, types.MethodType):
            return ("method", of(v.__func__), of(v.__self__))
        if isinstance(v, re.Pattern):
            return ("pattern", v.pattern, v.flags)
        if isinstance(v, type) or hasattr(v, "__qualname__"):
            return (getattr(v, "__module__", ""), v.__qualname__)
        if hasattr(v, "__dict__"):
            call = getattr(type(v), "__call__", None)
            return (type(v).__qualname__, of(call) if isinstance(call, types.FunctionType) else "", of(vars(v)))
        return type(v).__qualname__

    if not isinstance(fn, types.FunctionType):
        told = of(fn)
    else:
        def names(code):
            return set(code.co_names).union(*(names(c) for c in code.co_consts if isinstance(c, types.CodeType)))
        cells = [c.cell_contents for c in fn.__closure__ or ()]
        used = sorted(n for n in names(fn.__code__) if n in fn.__globals__ and not isinstance(fn.__globals__[n], types.ModuleType))
        told = (of(fn.__code__), of(fn.__defaults__), of(fn.__kwdefaults__), of(cells), [(n, of(fn.__globals__[n])) for n in used])
    return hashlib.sha256(repr(told).encode()).hexdigest()


def plan_digest(df: DataFrame) -> str:
    """Digest of what a DataFrame computes: its canonical plan, and of each
    source what tells its contents apart: path, size and time of the files,
    else Spark's own semantic hash (which holds within a session only)."""
    spark = df.sparkSession
    name = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(name)
    spark.conf.set(name, str(2 ** 31 - 1))
    try:
        plan = df._jdf.queryExecution().analyzed()
        told = [plan.canonicalized().toString()]
        leaves = plan.collectLeaves()
        for k in range(leaves.size()):
            leaf = leaves.apply(k)
            try:
                files = leaf.relation().location().allFiles().mkString("\n")
                told.append(re.sub(r"access_time=\d+", "", files))
            except (Py4JError, TypeError):  # not a table of files
                told.append(str(df.semanticHash()))
    finally:
        spark.conf.set(name, before)
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


def materialize_variants(spark: SparkSession, df: DataFrame, variants: Mapping[str, Sequence[Callable]],
                         root: str, text_col: str = "text", input_version: str = "1",
                         step_version: str = "1") -> dict[str, DataFrame]:
    """Write-if-absent cache of every preprocessing variant below ``root``.

    The key of a variant is its name, a digest of the plan that computes it
    (``plan_digest``), of the code of its Python steps (``code_digest``), and
    the caller's versions of input and steps: change any and it is computed
    anew.  A variant is written to a folder of its own first and counts from
    the moment its row is in the ``commits`` table: what a crash leaves behind
    is never read, and of two writers the first committed wins."""
    from marketlex.operators.textops import apply_steps
    root = root.rstrip("/")
    schema = "key string, path string, at timestamp"

    def committed() -> dict[str, str]:
        try:
            rows = spark.read.schema(schema).parquet(f"{root}/commits").orderBy("at", "path").collect()  # one row per variant
        except AnalysisException:  # none yet
            return {}
        out: dict[str, str] = {}
        for r in rows:
            out.setdefault(r.key, r.path)
        return out

    wanted = {}
    for name, steps in variants.items():
        made = df.withColumn(text_col, apply_steps(text_col, steps))
        code = [getattr(s, "code", None) or code_digest(s) for s in steps]
        told = "\n".join([name, text_col, input_version, step_version, plan_digest(made), *code])
        wanted[name] = (hashlib.sha256(told.encode()).hexdigest(), made)
    held = committed()
    new = []
    for name, (key, made) in wanted.items():
        if key not in held:
            path = f"{root}/{re.sub(r'[^A-Za-z0-9_-]', '_', name)}-{key[:16]}-{uuid.uuid4().hex}"
            made.write.parquet(path)
            new.append((key, path))
    if new:
        rows = spark.createDataFrame(new, "key string, path string").withColumn("at", F.current_timestamp())
        rows.coalesce(1).write.mode("append").parquet(f"{root}/commits")
        held = committed()
    return {name: spark.read.schema(made.schema).parquet(held[key]) for name, (key, made) in wanted.items()}
