"""Scans: labelled text CSV, result directories, daily price files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlex.operators.cleaning import drop_columns, drop_incomplete, shift_labels

# Column types of experiment-result files (fixed values: the stored header
# names), the grid-run columns last; files bind by header, not by place.
RESULT_SCHEMA = T.StructType([
    T.StructField("train_seed", T.IntegerType()),
    T.StructField("model_seed", T.IntegerType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("macro_f1", T.DoubleType()),
    T.StructField("weighted_f1", T.DoubleType()),
    T.StructField("neutral_f1", T.DoubleType()),
    T.StructField("positive_f1", T.DoubleType()),
    T.StructField("negative_f1", T.DoubleType()),
    T.StructField("model", T.StringType()),
    T.StructField("dataset", T.StringType()),
])

GRID_SCHEMA = T.StructType([
    T.StructField("learning_rate", T.DoubleType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("epochs", T.IntegerType()),
    T.StructField("weight_decay", T.DoubleType()),
    T.StructField("class_weight_floor", T.DoubleType()),
])

OHLCV_SCHEMA = T.StructType([
    T.StructField("Data", T.DateType()),
    T.StructField("Otwarcie", T.DoubleType()),
    T.StructField("Najwyzszy", T.DoubleType()),
    T.StructField("Najnizszy", T.DoubleType()),
    T.StructField("Zamkniecie", T.DoubleType()),
    T.StructField("Wolumen", T.DoubleType()),
])

# Source column names of the daily price files -> our names.
OHLCV_NAMES = {"Data": "date", "Otwarcie": "open", "Najwyzszy": "high",
               "Najnizszy": "low", "Zamkniecie": "close", "Wolumen": "volume"}


def _csv(spark: SparkSession, multi_line: bool = False):
    """``enforceSchema=false``: a header that differs from the schema is an
    error instead of a silent binding by place."""
    return (spark.read.option("header", True).option("multiLine", multi_line)
            .option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", False))


def read_labelled_text(spark: SparkSession, path: str, text_col: str = "text",
                       label_col: str = "labels") -> DataFrame:
    """Labelled texts ``(id, text, label)``; labels -1/0/1 shifted to int
    0/1/2 (P1), rows without text or label dropped (P2), junk ``Unnamed: *``
    columns dropped -- but the first of them, the row index the file was
    written with, is the ``id``.  Without one the id hashes file name and
    text (rows that repeat share it).  Only the needed columns reach the
    plan."""
    raw = _csv(spark, multi_line=True).option("inferSchema", False).csv(path)
    index = next((c for c in raw.columns if c.startswith("Unnamed: ")), None)
    row_id = F.col(f"`{index}`").cast("long") if index else F.xxhash64("_metadata.file_name", text_col)
    kept = raw.select(row_id.alias("id"), *[F.col(f"`{c}`") for c in drop_columns(raw).columns if c != "id"])
    rows = kept.select("id", F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("labels"))
    return shift_labels(drop_incomplete(rows, ["text", "labels"])).drop("labels")


def header_groups(spark: SparkSession, directory: str) -> list[tuple[list[str], list[str]]]:
    """(header columns, paths) of the ``*.csv`` files directly in
    ``directory``: one group per distinct header line.  Only file names and
    distinct headers reach the driver."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", False)
             .load(directory).where("length > 0"))
    line = F.regexp_replace(F.split(F.decode("content", "UTF-8"), "\n")[0], "[\r\ufeff]", "")
    groups = files.select("path", line.alias("header")).groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [([c.strip().strip('"') for c in r.header.split(",")], list(r.paths)) for r in groups.orderBy("header").collect()]


def read_results_dir(spark: SparkSession, directory: str, types: T.StructType | None = None) -> DataFrame:
    """Every ``*.csv`` directly in ``directory`` (non-recursive), whatever
    the order and set of its columns: one scan per distinct header, union by
    name with missing columns null, sorted by model, dataset.  ``types``
    gives column types (result and grid-run columns by default; unknown
    columns are strings)."""
    known = {f.name: f.dataType for f in [*RESULT_SCHEMA.fields, *GRID_SCHEMA.fields, *(types.fields if types else [])]}
    out = None
    for header, paths in header_groups(spark, directory):
        schema = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])
        d = _csv(spark).schema(schema).csv(paths)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], RESULT_SCHEMA)
    return out.orderBy("model", "dataset")


def read_ohlcv(spark: SparkSession, path: str) -> DataFrame:
    """S3: daily price files of many companies in one scan; the file stem, or
    the ``company=`` folder a file lies in, becomes ``company``."""
    d = _csv(spark).schema(OHLCV_SCHEMA).option("dateFormat", "yyyy-MM-dd") \
        .option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(path)
    d = d.select(*[F.col(k).alias(v) for k, v in OHLCV_NAMES.items()],
                 F.coalesce(F.nullif(F.regexp_extract(F.col("_metadata.file_path"), r"/company=([^/]+)/", 1), F.lit("")),
                            F.regexp_extract(F.col("_metadata.file_name"), r"(.+)\.csv$", 1)).alias("company"))
    return d
