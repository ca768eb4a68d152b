"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "marketlex",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    Sizes (driver memory, shuffle partitions) are set for a given local
    master only; on a cluster they come from spark-submit.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if master and master.startswith("local"):
        b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or os.environ.get("BENCH_CPUS", "8")))
             .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g")))
    elif shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master:
        b = b.master(master)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``marketlex`` importable in Python workers (the Arrow-batched
    steps reference its functions): zip the package once per application
    and distribute it with ``addPyFile``, like ``--py-files``."""
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # no driver-side context (remote session): ship with --py-files instead
        return
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="marketlex-pyfiles-"), "marketlex.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, fs in os.walk(pkg):
            for f in fs:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, the folder registered with ``setCheckpointDir`` is
    used; a local master gets a private one (all tasks run on this machine).
    On a cluster a machine-local folder would lose files, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        try:
            if spark.sparkContext.getCheckpointDir() is None:
                spark.sparkContext.setCheckpointDir(d)
        except (AttributeError, RuntimeError):  # remote sessions read the setting themselves
            pass
        return d
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marketlex-ckpt-"))
    return sc.getCheckpointDir()


def materialize(df):
    """Cut lineage for a table that several branches of a plan consume: write
    it as Parquet below the shared ``spark.checkpoint.dir`` and read it back
    (reliable storage that survives executor loss; column pruning and filter
    push-down still reach the scan)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
