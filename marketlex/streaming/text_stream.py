"""Structured Streaming: the stateless text and scoring Columns run
unchanged on streams; evaluation logs are appended per micro-batch."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlex.operators.scoring import argmax, classification_metrics
from marketlex.operators.textops import apply_steps
from marketlex.session import checkpoint_dir
from marketlex.sources.sinks import append_eval_log


def read_stream(spark: SparkSession, directory: str, schema, max_files: int = 1,
                glob: str | None = None) -> DataFrame:
    """File stream over the parquet files of ``directory`` (optionally only
    names matching ``glob``) with a fixed schema."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(directory)


def clean_stream(stream: DataFrame, steps: Sequence[Callable[[Column], Column]],
                 id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The batch text pipeline on a streaming DataFrame (no state needed)."""
    return stream.select(F.col(id_col).alias("id"), apply_steps(text_col, steps).alias("text"))


def run_to_table(stream: DataFrame, out_path: str, name: str) -> str:
    """Drain the stream once (``availableNow``) into a parquet table with a
    checkpoint under the cluster's shared checkpoint folder."""
    ck = f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/stream-{name}"
    q = (stream.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


def batch_logger(log_path: str, run: str, label: str = "label", logits: str = "logits") -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function of :func:`eval_log_stream`."""
    def log_batch(batch: DataFrame, batch_id: int) -> None:
        m = classification_metrics(batch.withColumn("pred", argmax(logits)), label, "pred")
        n = batch.agg(F.count(F.lit(1)).alias("n"))  # one row each side
        append_eval_log(m.crossJoin(n), log_path, "parquet", run, batch_id)
    return log_batch


def eval_log_stream(scored: DataFrame, log_path: str, name: str, label: str = "label",
                    logits: str = "logits") -> str:
    """S7 on a stream: every micro-batch logs one metrics row (``run``,
    ``batch_id``) to ``log_path`` through ``foreachBatch``.  The row of a
    batch that Spark runs again takes the place of the earlier one."""
    ck = f"{checkpoint_dir(scored.sparkSession).rstrip('/')}/evallog-{name}"

    q = (scored.writeStream.foreachBatch(batch_logger(log_path, name, label, logits)).option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return log_path
