"""The variant cache follows what a step does; S7: a batch logs once."""

import functools

import pytest
from pyspark.sql import functions as F

from marketlex.functions import text as tx
from marketlex.operators.textops import python_step
from marketlex.sources import sinks
from marketlex.streaming import text_stream


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    spark.createDataFrame([(1, "Ala @x"), (2, "kot")], "id int, text string").write.parquet(path)
    return spark.read.parquet(path)


def cached(spark, df, root, steps, **kw):
    out = sinks.materialize_variants(spark, df, {"v": steps}, str(root), **kw)["v"]
    return sorted(r.text for r in out.collect())


def folders(root):
    return sorted(p.name for p in root.iterdir() if p.name.startswith("v-"))


def test_steps_with_one_name_are_two_entries(spark, table, tmp_path):
    root = tmp_path / "cache"
    assert cached(spark, table, root, [python_step(str.upper)]) == ["ALA @X", "KOT"]
    assert cached(spark, table, root, [python_step(str.lower)]) == ["ala @x", "kot"]
    assert cached(spark, table, root, [python_step(lambda s: s + "1")]) == ["Ala @x1", "kot1"]
    assert cached(spark, table, root, [python_step(lambda s: s + "2")]) == ["Ala @x2", "kot2"]
    assert len(folders(root)) == 4
    assert cached(spark, table, root, [python_step(str.upper)]) == ["ALA @X", "KOT"]
    assert len(folders(root)) == 4                    # read, not written again


def test_a_hit_is_read_across_reads_of_the_table(spark, table, tmp_path):
    root = tmp_path / "cache"
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    for _ in range(3):
        cached(spark, spark.read.parquet(path), root, [tx.strip_mentions])
    assert len(folders(root)) == 1
    assert cached(spark, spark.read.parquet(path), root, [tx.strip_urls]) == ["Ala @x", "kot"]
    assert len(folders(root)) == 2


def test_a_changed_table_or_lexicon_is_computed_anew(spark, table, tmp_path):
    root = tmp_path / "cache"
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    pairs = [(f"k{i}", f"v{i}") for i in range(60)]
    step = lambda ps: [lambda c: tx.replace_lexicon(c, ps)]
    cached(spark, table, root, step(pairs))
    cached(spark, table, root, step(pairs[:-1] + [("k59", "other")]))  # the last entry alone differs
    assert len(folders(root)) == 2
    spark.createDataFrame([(9, "new")], "id int, text string").write.mode("append").parquet(path)
    assert cached(spark, spark.read.parquet(path), root, step(pairs)) == ["Ala @x", "kot", "new"]


def test_a_write_without_its_commit_is_not_read(spark, table, tmp_path, monkeypatch):
    root = tmp_path / "cache"
    steps = [tx.strip_mentions]
    made = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed before the commit")))
    with pytest.raises(RuntimeError):
        cached(spark, table, root, steps)
    monkeypatch.setattr(type(spark), "createDataFrame", made.__func__)
    assert len(folders(root)) == 1
    for f in (root / folders(root)[0]).glob("part-*"):
        f.unlink()                                     # as if it had been cut off half way
    assert len(cached(spark, table, root, steps)) == 2
    assert len(folders(root)) == 2


RATE = 2


def uses_global(s):
    return s * RATE


def closing_over(v):
    def step(s):
        return s + v
    return step


def test_code_digest(monkeypatch):
    d = sinks.code_digest
    assert d(str.upper) != d(str.lower)
    assert d(lambda s: s + "a") == d(lambda s: s + "a") != d(lambda s: s + "b")
    assert d(closing_over("x")) == d(closing_over("x")) != d(closing_over("y"))
    assert d(functools.partial(closing_over, "x")) != d(functools.partial(closing_over, "y"))
    before = d(uses_global)
    monkeypatch.setitem(globals(), "RATE", 3)
    assert d(uses_global) != before


# ---- S7 --------------------------------------------------------------------

def test_a_repeated_batch_counts_once(spark, tmp_path):
    log = str(tmp_path / "log")
    scored = spark.createDataFrame([(0, [2.0, 1.0, 0.0]), (1, [0.0, 1.0, 0.5]), (2, [3.0, 0.0, 0.0])], "label int, logits array<double>")
    write = text_stream.batch_logger(log, "run-1")
    write(scored, 0)
    write(scored.limit(2), 1)
    total = lambda: spark.read.parquet(log).agg(F.sum("n"), F.count("*")).first()
    assert tuple(total()) == (5, 2)
    write(scored.limit(2), 1)                          # Spark runs the batch again
    assert tuple(total()) == (5, 2)
    text_stream.batch_logger(log, "run-2")(scored, 1)  # another run's batch of that number
    assert tuple(total()) == (8, 3)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_log_of_a_batch_and_plain_append(spark, tmp_path, fmt):
    df = spark.createDataFrame([(0.5,)], "accuracy double")
    path = str(tmp_path / fmt)
    for batch in (0, 1, 1):
        sinks.append_eval_log(df, path, fmt, "r", batch)
    assert spark.read.option("header", True).format(fmt).load(path).count() == 2
    plain = str(tmp_path / f"plain-{fmt}")
    for _ in range(2):
        sinks.append_eval_log(df, plain, fmt)
    assert spark.read.option("header", True).format(fmt).load(plain).count() == 2
