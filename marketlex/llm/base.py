"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from sys import getsizeof

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlex.session import checkpoint_dir



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the
    lineage, survives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *tables: DataFrame) -> str:
    """``name``, lengthened until no column of the tables has it."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_bucket(spark_col, n: int):
    """crc32 of the value as text, modulo ``n`` (the held-out rule)."""
    return F.pmod(F.crc32(spark_col.cast("string").cast("binary")), F.lit(n))


def where_text(docs: DataFrame, keep) -> DataFrame:
    """Rows of ``docs`` for which ``keep``, an Arrow function of an iterator of
    texts, gives true.  Nothing but the text goes to Python.  The function
    counts as non-deterministic so that the optimiser leaves it where it is:
    merged with filters below a join it could not be planned."""
    return docs.where(F.arrow_udf(keep, "boolean").asNondeterministic()(F.col("text")))


HOT_ROWS, MOST_HOT = 1000, 4096


def join_split(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` on ``keys``, where the column
    ``size`` of ``groups`` counts the rows of each key.  The keys of more than
    ``HOT_ROWS`` rows, and of more than one in ``MOST_HOT`` of all, so at most
    ``MOST_HOT`` of them, are joined by broadcast where their rows lie; the
    others by a shuffle without a hot key.  Both tables should be stored."""
    total = groups.agg(F.sum(size).alias("n")).first().n or 0
    hot = groups.where(F.col(size) > max(HOT_ROWS, total // MOST_HOT))
    if not hot.head(1):
        return rows.join(groups, keys)
    cold = groups.where(F.col(size) <= max(HOT_ROWS, total // MOST_HOT))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def file_system(path: str):
    """(pyarrow file system, path) of a local, hdfs, s3 or gs location, for
    binary files that Spark has no writer for."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:"):]
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path


def put_file(path: str, data) -> None:
    """Write a file under its final name in one step (write aside, then
    move), so that a retried or speculative task never leaves half a file
    where a reader looks."""
    f, p = file_system(path)
    if hasattr(f, "create_dir"):
        f.create_dir(p.rsplit("/", 1)[0], recursive=True)
    aside = f"{p}.{uuid.uuid4().hex}.tmp"
    with f.open_output_stream(aside) as out:
        out.write(data)
    f.move(aside, p)


class Memo(dict):
    """``dict`` that computes missing values and forgets what was not used
    lately: two generations that together hold about ``bytes_held`` bytes, keys
    and values included.  What is longer than ``longest`` is not kept."""

    ENTRY = 110  # bytes of a dictionary entry beside key and value

    def __init__(self, make, bytes_held: int = 32 << 20, longest: int = 512):
        super().__init__()
        self.make, self.half, self.longest, self.old, self.held = make, bytes_held // 2, longest, {}, 0

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        if hasattr(key, "__len__") and len(key) > self.longest:
            return v
        self.held += self.ENTRY + getsizeof(key) + getsizeof(v)
        if self.held > self.half:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = v
        return v


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Rows that go to Python in one Arrow batch while a job over whole texts
    runs: a batch of texts is held several times over on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
