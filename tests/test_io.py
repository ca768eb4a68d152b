"""Sources, sinks and lexicon loaders."""

from pyspark.sql import functions as F

from marketlex.functions import text as tx
from marketlex.functions.lexicon import load_pairs, load_words, pairs_from_table, words_from_table
from marketlex.operators import cleaning, textops
from marketlex.sources import sinks


def test_lexicon_files_round_trip(spark, tmp_path):
    lex = tmp_path / "lex.tsv"
    lex.write_text("1\t:)\tradosny\n2\t:/)\tsceptyczny\n0\t🚀\trakieta-wzrost\n", encoding="utf-8")
    pairs = pairs_from_table(load_pairs(spark, str(lex)))
    assert pairs == [("🚀", "rakieta-wzrost"), (":)", "radosny"), (":/)", "sceptyczny")]
    text = "to the moon 🚀 :/) :) x"
    want = text
    for k, v in pairs:
        want = want.replace(k, " " + v)
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(tx.replace_lexicon("text", pairs)).first()[0] == want
    words = tmp_path / "stop.txt"
    words.write_text("i\nw\n\nna\n", encoding="utf-8")
    wl = sorted(words_from_table(load_words(spark, str(words))))
    assert wl == ["i", "na", "w"]


def test_stopword_table_form_equals_inline_form(spark):
    docs = spark.createDataFrame([(1, "Ala i kot W domu"), (2, "  i  w  "), (3, ""), (4, None)], "id int, text string")
    words = spark.createDataFrame([("i",), ("w",)], "word string")
    a = {r["id"]: r["text"] for r in textops.remove_stopwords_table(docs, words).collect()}
    b = {r["id"]: r["t"] for r in docs.select("id", tx.remove_stopwords("text", ["i", "w"]).alias("t")).collect()}
    assert a == b == {1: "Ala kot domu", 2: "", 3: "", 4: None}


def test_dictionary_normalize_keeps_order(spark):
    docs = spark.createDataFrame([(1, "kotów było dużo kotów")], "id int, text string")
    table = spark.createDataFrame([("kotów", "kot"), ("było", "być")], "form string, replacement string")
    assert textops.dictionary_normalize(docs, table).first()["text"] == "kot być dużo kot"


def test_materialize_variants_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "@a x http://t.co/1"), (2, "b")], "id int, text string")
    v = {"Basic_processing": [tx.clean_text_basic], "No_processing": []}
    out = sinks.materialize_variants(spark, df, v, str(tmp_path / "cache"))
    assert {r["id"]: r["text"] for r in out["Basic_processing"].collect()}[1] == "  x  "
    # a second call with the same versions reads the cached table
    again = sinks.materialize_variants(spark, df, v, str(tmp_path / "cache"))
    assert again["No_processing"].count() == 2
    # another input version or step version is computed anew
    df2 = spark.createDataFrame([(9, "changed")], "id int, text string")
    new = sinks.materialize_variants(spark, df2, v, str(tmp_path / "cache"), input_version="2")
    assert [r["text"] for r in new["No_processing"].collect()] == ["changed"]
    assert again["No_processing"].count() == 2
    assert sinks.materialize_variants(spark, df2, v, str(tmp_path / "cache"), step_version="2")["No_processing"].count() == 1


def test_results_bind_by_header(spark, tmp_path):
    from marketlex.sources.files import read_results_dir
    (tmp_path / "a.csv").write_text("train_seed,model_seed,accuracy,macro_f1,model,dataset\n1,2,0.5,0.25,m,d1\n")
    (tmp_path / "b.csv").write_text("model_seed,train_seed,macro_f1,accuracy,dataset,model\n2,1,0.25,0.5,d2,m\n")
    (tmp_path / "c.csv").write_text("train_seed,model_seed,accuracy,macro_f1,model,dataset,learning_rate,note\n1,2,0.5,0.25,m,d3,0.001,x\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.csv").write_text("model\nnot read\n")
    rows = read_results_dir(spark, str(tmp_path)).collect()
    assert [(r.train_seed, r.model_seed, r.accuracy, r.macro_f1, r.model, r.dataset, r.learning_rate, r.note) for r in rows] == [
        (1, 2, 0.5, 0.25, "m", "d1", None, None), (1, 2, 0.5, 0.25, "m", "d2", None, None), (1, 2, 0.5, 0.25, "m", "d3", 0.001, "x")]


def test_checkpoint_folder_when_unset(tmp_path):
    """Without ``spark.checkpoint.dir`` a local session gets a folder, and a
    cluster an error."""
    import subprocess
    import sys
    code = ("from marketlex.session import get_session, checkpoint_dir, materialize\n"
            "s = get_session('local[1]')\n"
            "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
            "assert materialize(s.range(3)).count() == 3 and checkpoint_dir(s)\n"
            "class Ctx:\n    master = 'spark://host:7077'\n    getCheckpointDir = staticmethod(lambda: None)\n"
            "class Fake:\n    sparkContext = Ctx()\n    class conf:\n        get = staticmethod(lambda k, d: d)\n"
            "try:\n    checkpoint_dir(Fake())\n    raise SystemExit(3)\nexcept RuntimeError:\n    pass\n")
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    assert subprocess.run([sys.executable, "-c", code], env=env, timeout=180).returncode == 0


def test_profile_and_numeric_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 2.0, None)], "a int, b double, c string")
    assert cleaning.numeric_columns(df) == ["a", "b"]
    p = {r["column"]: (r["dtype"], r["non_null"], r["distinct_values"]) for r in cleaning.profile(df).collect()}
    assert p == {"a": ("int", 2, 2), "b": ("double", 1, 1), "c": ("string", 1, 1)}


def test_recode_replace_and_map(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    r = df.select(cleaning.recode("x", {"a": "A"}).alias("rep"),
                  cleaning.recode("x", {"a": "A"}, keep_unmapped=False).alias("map")).collect()
    assert [(x["rep"], x["map"]) for x in r] == [("A", "A"), ("b", None), (None, None)]


def test_encode_fixed_length(spark):
    docs = spark.createDataFrame([(1, "b a a"), (2, ""), (3, "c b a a d")], "id int, text string")
    vocab = textops.build_vocabulary(docs)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert ids == {"a": 2, "b": 3, "c": 4, "d": 5}
    enc = {r["id"]: (r["input_ids"], r["attention_mask"]) for r in
           textops.encode_fixed_length(docs, vocab, max_length=4).collect()}
    assert enc[1] == ([3, 2, 2, 0], [1, 1, 1, 0])
    assert enc[2] == ([0, 0, 0, 0], [0, 0, 0, 0])
    assert enc[3] == ([4, 3, 2, 2], [1, 1, 1, 1])
