"""Rows with null or repeated ids, labels and order values are kept and keep
their own values."""

import pytest
from pyspark.sql import functions as F

from marketlex.operators import market, sampling, textops
from marketlex.operators import ordering as O

ROWS = [(1, "a b the c"), (1, "x the y"), (None, "p q"), (None, None), (2, ""), (3, "  "), (4, "the"), (4, "the"), (5, "p q")]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(i, t, "h", 7) for i, t in ROWS], "id int, text string, _h1 string, _made int").repartition(3)


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_stop_words_by_join(spark, texts):
    words = spark.createDataFrame([("the",), (None,), ("the",)], "word string")
    want = sorted([(i, None if t is None else " ".join(w for w in t.split() if w != "the")) for i, t in ROWS], key=repr)
    for out in (textops.remove_stopwords_table(texts, words), textops.remove_stopwords(texts, words), textops.remove_stopwords(texts, words, inline_limit=0)):
        assert out.columns == texts.columns and values(out, "id", "text") == want


def test_stop_list_on_both_sides_of_the_bound(spark, texts):
    words = spark.createDataFrame([("the",), ("p",), ("y",)], "word string")
    inline, joined = textops.remove_stopwords(texts, words, inline_limit=3), textops.remove_stopwords(texts, words, inline_limit=2)
    assert values(inline, "id", "text") == values(joined, "id", "text")
    assert "Join" not in inline._jdf.queryExecution().executedPlan().toString()
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()


def test_dictionary(spark, texts):
    table = spark.createDataFrame([("a", "AA"), ("a", "A"), ("q", None), (None, "Z"), ("x", "X")], "form string, replacement string")
    out = textops.dictionary_normalize(texts, table)
    put = {"a": "A", "x": "X"}
    assert values(out, "id", "text") == sorted([(i, None if t is None else " ".join(put.get(w, w) for w in t.split())) for i, t in ROWS], key=repr)
    assert out.columns == texts.columns


def test_fixed_length(spark, texts):
    vocab = spark.createDataFrame([("a", 2), ("the", 3), ("the", 9), ("p", 4), (None, 5)], "token string, token_id int")
    ids = {"a": 2, "the": 3, "p": 4}
    got = values(textops.encode_fixed_length(texts, vocab, max_length=3), "id", "input_ids", "attention_mask")
    want = []
    for i, t in ROWS:
        k = [ids.get(w, 1) for w in (t or "").split()][:3]
        want.append((i, k + [0] * (3 - len(k)), [1] * len(k) + [0] * (3 - len(k))))
    assert got == sorted(want, key=repr)


@pytest.fixture
def labelled(spark):
    # 40 rows of two labels and 10 without one
    return spark.createDataFrame([(i, "ab"[i % 2] if i < 40 else None, i) for i in range(50)], "id int, label string, copy int").repartition(4)


def counts(df, *cols):
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*cols).count().collect()}


def test_null_labels_are_a_class(labelled):
    assert counts(sampling.stratified_split(labelled), "label", "split") == {
        ("a", "train"): 16, ("a", "test"): 4, ("b", "train"): 16, ("b", "test"): 4, (None, "train"): 8, (None, "test"): 2}
    folds = counts(sampling.stratified_kfold(labelled), "label", "fold")
    assert folds == {(x, f): n for x, n in (("a", 4), ("b", 4), (None, 2)) for f in range(5)}
    balanced = sampling.balance_classes(labelled)
    assert counts(balanced, "label") == {("a",): 16, ("b",): 16, (None,): 16}
    assert balanced.columns == ["id", "label", "copy", "copy_"] and balanced.where("copy <> id").count() == 0


def test_null_order_values_come_first(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i) for i in range(50)], "id int, day int")
    out = market.chronological_split(df, ["day", "id"], F.col("day"))
    assert counts(out, "part") == {("train",): 35, ("valid",): 5, ("test",): 10}
    assert out.where("day is null and part <> 'train'").count() == 0


def test_splits_do_not_move_texts(spark):
    df = spark.range(1000).select("id", F.lit("long text").alias("text"), (F.col("id") % 3).alias("label"))
    for out in (sampling.random_split(df), sampling.stratified_split(df), sampling.stratified_kfold(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
        assert out.count() == 1000


@pytest.mark.parametrize("cuts", [[0], [1], [7, 7, 30], [100], [0, 50, 99, 500]])
def test_intervals_follow_the_hash_order(spark, cuts):
    # ids repeat, and a third of the rows are one
    rows = [(k % 40 if k >= 33 else 5, k if k >= 33 else 0, "g" if k % 2 else None) for k in range(100)]
    df = spark.createDataFrame(rows, "id int, v int, g string").repartition(3)
    table = spark.createDataFrame([("g", cuts), (None, cuts)], "g string, ranks array<long>")
    got = O.hash_intervals(df, 3, ["id"], table, "part", ["g"])
    assert values(got, "id", "v", "g") == values(df, "id", "v", "g")
    for g in ("g", None):
        part = [r.part for r in got.where(F.col("g").eqNullSafe(F.lit(g))).collect()]
        want = [sum(c < rank for c in cuts) for rank in range(1, len(part) + 1)]
        assert sorted(part) == want
        # in hash order the intervals ascend
        rank = O.hash_row_number(df.where(F.col("g").eqNullSafe(F.lit(g))), 3, ["id"], "k")
        order = {}
        for r in rank.collect():
            order.setdefault(r.id, []).append(r.k)
        for r in got.where(F.col("g").eqNullSafe(F.lit(g))).collect():
            assert min(want[k - 1] for k in order[r.id]) <= r.part <= max(want[k - 1] for k in order[r.id])
