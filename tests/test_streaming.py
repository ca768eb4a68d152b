"""Stateless Columns give the same rows on a stream as in batch."""

import uuid

from pyspark.sql import functions as F

from marketlex.functions import text as tx
from marketlex.operators import scoring
from marketlex.plans.views import table, v_scored
from marketlex.session import checkpoint_dir
from marketlex.streaming import text_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    schema = table(spark, SF, "documents").schema
    steps = [tx.replace_emoji, tx.clean_text_basic, tx.sentence_case, tx.normalize_whitespace]
    st = text_stream.read_stream(spark, SF, schema, glob="documents.parquet")
    out = text_stream.run_to_table(text_stream.clean_stream(st, steps, "doc_id"), str(tmp_path / "out"), uuid.uuid4().hex)
    got = spark.read.parquet(out)
    batch = table(spark, SF, "documents").select(F.col("doc_id").alias("id"),
                                                 tx.normalize_whitespace(tx.sentence_case(tx.clean_text_basic(
                                                     tx.replace_emoji("text")))).alias("text"))
    assert got.count() == batch.count()
    assert got.exceptAll(batch).count() == 0


def test_eval_log_per_batch(spark, tmp_path):
    sc = v_scored(spark, "/root/testdata/sf0.01")
    src = str(tmp_path / "src")
    sc.repartition(3).write.parquet(src)
    st = text_stream.read_stream(spark, src, spark.read.parquet(src).schema, max_files=1)
    log = spark.read.parquet(text_stream.eval_log_stream(st, str(tmp_path / "log"), uuid.uuid4().hex))
    n_files = len([p for p in (tmp_path / "src").iterdir() if p.name.endswith(".parquet")])
    assert log.count() == n_files
    assert log.select("batch_id").distinct().count() == n_files
    overall = scoring.classification_metrics(sc.withColumn("pred", scoring.argmax("logits")), "label", "pred")
    assert overall.count() == 1
    assert checkpoint_dir(spark)


def test_documents_in_one_file_or_a_folder(spark, tmp_path):
    from marketlex.plans.q_io import s10_stream_clean_documents
    rows = [(k, f"Text {k} @user https://t.co/x  end_{k}", "en", "s", 9) for k in range(12)] + [(12, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    (part,) = [p for p in (tmp_path / "one").iterdir() if p.name.endswith(".parquet")]
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "documents.parquet").write_bytes(part.read_bytes())
    want = sorted((r.doc_id, r.text) for r in docs.select("doc_id", tx.clean_text_full("text").alias("text")).collect() if r.doc_id < 12)
    for kind in ("folder", "file"):
        got = [(r.id, r.text) for r in s10_stream_clean_documents(spark, str(tmp_path / kind)).collect()]
        assert sorted(x for x in got if x[0] < 12) == want and (12, None) in got and len(got) == 13
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert s10_stream_clean_documents(spark, str(tmp_path / "none")).count() == 0
