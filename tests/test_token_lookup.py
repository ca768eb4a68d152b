"""Tokens looked up in a table: shipped or joined, and what the queries on
them read."""

import random

import pytest
from pyspark.sql import functions as F

from marketlex.functions import text as tx
from marketlex.operators import lemmas, ml, spelling, textops, trainer
from marketlex.plans import q_io
from marketlex.session import materialize

TEXTS = [(1, "Ala ma  kota i psa"), (1, "ma ma psa ALA"), (None, "kota x"), (2, "kota x"), (3, ""), (4, None), (5, " \n "), (6, "nic tu nie ma stąd ŻABA")]
WORDS = [("ma", "mieć"), ("ma", "mamy"), ("kota", "kot"), ("psa", None), (None, "x"), ("ala", "Ola"), ("żaba", "płaz")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, text string")


@pytest.fixture
def documents(spark, tmp_path):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeio") for _ in range(rng.randint(3, 6))) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(stems) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(40)), "en", "s", 1) for k in range(90)] + [(90, None, "en", "s", None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, k % 2) for k in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_a_short_table_moves_no_text(spark, texts, monkeypatch):
    """no shuffle, and the same texts as by the join."""
    table = spark.createDataFrame(WORDS, "form string, replacement string")
    words = table.select(F.col("form").alias("word"))
    vocab = spark.createDataFrame([("ma", 2), ("kota", 3), ("x", None), ("x", 9)], "token string, token_id int")
    made = lambda: [textops.dictionary_normalize(texts, table), textops.dictionary_normalize(texts, table, lower=True),
                    textops.remove_stopwords_table(texts, words), textops.encode_fixed_length(texts, vocab, max_length=4)]
    shipped = made()
    assert not any("Exchange" in plan(d) for d in shipped)
    got = [sorted(map(tuple, d.collect()), key=repr) for d in shipped]
    monkeypatch.setattr(textops, "LOOKUP_ROWS", 0)
    joined = made()
    assert all("Exchange" in plan(d) for d in joined)
    assert [sorted(map(tuple, d.collect()), key=repr) for d in joined] == got
    low = {"ma": "mamy", "kota": "kot", "ala": "Ola", "żaba": "płaz"}
    assert got[1] == sorted([(i, None if t is None else " ".join(low.get(w.lower(), w) for w in t.split())) for i, t in TEXTS], key=repr)


def test_strategies_are_made_where_texts_lie(spark, texts):
    """the cumulative strategies with derived tables."""
    table = spark.createDataFrame(WORDS, "form string, replacement string")
    for steps in textops.strategy_variants(table, table, ("i",)).values():
        d = texts
        for s in steps:
            d = s(d)
        assert "Exchange" not in plan(d)


def test_features_of_a_form_move_no_text(spark, texts):
    """the vocabulary is the top of the counts, features are looked up in place."""
    vocab = textops.top_tokens(texts, 3)
    assert [tuple(r) for r in vocab.orderBy("place").collect()] == [("ma", 0), ("kota", 1), ("psa", 2)]
    every = textops.build_vocabulary(texts, reserved=0)
    assert {(r.token, r.token_id) for r in every.collect()} == {(r.token, r.place) for r in textops.top_tokens(texts, 1000).collect()}
    made = trainer.features(texts, vocab.select("token", F.col("place").alias("feature")), ["id"])
    assert "Exchange" not in plan(made)
    assert sorted((r.id or 0, list(r.idx)) for r in made.collect()) == sorted([(1, [0, 1, 2]), (1, [0, 2]), (0, [1]), (2, [1]), (3, []), (4, []), (5, []), (6, [0])])


def test_spelling_joins_only_words_it_may_change(spark, monkeypatch):
    """corrections of any number give the texts of the shipped table."""
    known = spark.createDataFrame([("kolejka", 9), ("akcje", 5), ("spadki", 7), ("spadku", 8)], "word string, freq int")
    docs = spark.createDataFrame([(1, "Akcej  i spadk kolejkka! kolejka"), (1, "Spadkii xyz Kolejka"), (None, None), (2, ""), (3, "Spadkii xyz Kolejka")], "id int, text string")
    got = sorted(map(tuple, spelling.correct_spelling(docs, known).collect()), key=repr)
    monkeypatch.setattr(textops, "LOOKUP_ROWS", 1)
    joined = spelling.correct_spelling(docs, known)
    assert "RLIKE" in plan(joined)
    assert sorted(map(tuple, joined.collect()), key=repr) == got


def test_lemma_pairs_read_the_texts_once(spark, documents):
    """Nine endings, one pass over the documents."""
    pairs = q_io._lemma_pairs(spark, documents)
    assert not any("documents.parquet" in f for f in pairs.inputFiles())
    words = {w.lower() for r in spark.read.parquet(f"{documents}/documents.parquet").collect() for w in (r.text or "").split() if len(w) >= 3}
    want = sorted((w + e, w) for w in words for e in q_io.LEMMA_ENDINGS if w + e in words)
    assert want and sorted((r.form, r.lemma) for r in pairs.collect()) == want
    assert lemmas.suffix_rules(pairs).count() > 0


def test_word_counts_of_spelling_are_stored(spark, documents):
    """the known words are counted once, however often they are used."""
    assert not any("documents.parquet" in f for f in q_io._known(spark, documents).inputFiles())
    assert not any("documents.parquet" in f for f in q_io.t14_corrections(spark, documents).inputFiles())


def test_labelled_files_stay_small(spark, documents, monkeypatch):
    """a file, which one task reads whole, has a bounded number of rows."""
    monkeypatch.setattr(q_io, "CSV_ROWS", 10)
    rows = q_io.s1_read_labelled_text(spark, documents)
    assert rows.count() == 90
    assert max(r["n"] for r in rows.groupBy(F.col("_metadata.file_name") if "_metadata" in rows.columns else F.input_file_name()).agg(F.count("id").alias("n")).collect()) <= 10


def test_frequencies_of_a_fold_are_counted_once(spark, monkeypatch):
    """parameter sets share the document frequencies of a fold."""
    made = []

    class Counted(ml.IDF):
        def _fit(self, data):
            made.append(1)
            return super()._fit(data)
    monkeypatch.setattr(ml, "IDF", Counted)
    df = spark.createDataFrame([(k, f"w{k % 3} x{k % 5}", k % 3) for k in range(60)], "id int, text string, label int")
    got = ml.cross_validate(df, [{"reg_param": 0.01, "max_iter": 3, "num_features": 64}, {"reg_param": 0.1, "max_iter": 2, "num_features": 64}], k=2)
    assert got.count() == 6 and len(made) == 2


def test_joined_patterns_match_as_the_single_ones(spark):
    """the cleaning in fewer passes over every character there is, alone and between others."""
    rng = random.Random(3)
    every = [chr(c) for c in range(1, 0x3100)] + list("😀🚀𝒳")
    parts = ["http", "https://a.b/c", "www", "htt", "ww", "@ab_1", "#", "@", "_", "Żó", "x1", " ", " ", "\n"]
    texts = ["".join(rng.choice(every) if rng.random() < 0.5 else rng.choice(parts) for _ in range(40)) for _ in range(300)] + ["".join(every), "a".join(every)]

    def plain(t):
        x = F.regexp_replace(t, tx.URL_PATTERN, " ")
        x = F.regexp_replace(F.regexp_replace(x, f"{tx.MENTION_PATTERN}|{tx.HASHTAG_PATTERN}", " "), "_", " ")
        return tx.normalize_whitespace(F.regexp_replace(x, tx.NON_POLISH_STRICT_PATTERN, " "))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select(tx.clean_text_full("text").alias("a"), plain("text").alias("b"), tx.strip_urls("text").alias("c"), F.regexp_replace("text", tx.URL_PATTERN, " ").alias("d")).collect():
        assert r.a == r.b and r.c == r.d


def test_exploded_strings_are_not_broadcast(spark, documents, monkeypatch):
    """the strings left by deletions, many times the stored words, do not go through the driver; nor does a table too long to ship."""
    d = spark.read.parquet(f"{documents}/documents.parquet")
    words = materialize(spelling.word_counts(d))
    known = words.where("freq >= 14")
    assert "Broadcast" not in plan(spelling.corrections(words.where("freq < 14"), known))
    monkeypatch.setattr(textops, "LOOKUP_ROWS", 20)
    joins = [x for x in plan(spelling.correct_spelling(d, known)).split("\n") if "BroadcastHashJoin" in x]
    assert not any("Inner" in x for x in joins) and sum("LeftAnti" in x for x in joins) == 1  # the frequent words, of a bounded number


def test_words_of_a_text_are_counted_once(spark, documents, monkeypatch):
    """the known words and the words to correct come from one pass."""
    calls, count = [], spelling.word_counts
    monkeypatch.setattr(spelling, "word_counts", lambda *a, **b: calls.append(1) or count(*a, **b))
    monkeypatch.setattr(q_io, "SPELL_LEAST", 14)
    got = sorted(map(tuple, q_io.t14_correct_spelling(spark, documents).collect()), key=repr)
    assert len(calls) == 1 and len(got) == 91
    monkeypatch.setattr(textops, "LOOKUP_ROWS", 2)
    assert sorted(map(tuple, q_io.t14_correct_spelling(spark, documents).collect()), key=repr) == got
    d = spark.read.parquet(f"{documents}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    fixed = spelling.correct_spelling(d, q_io._known(spark, documents))  # words counted by the operator
    assert sorted(map(tuple, fixed.select("id", F.sha2("text", 256), F.length("text")).collect()), key=repr) == got
    assert fixed.join(d.withColumnRenamed("text", "was"), "id").where("text <> was").count() > 10


def test_frequent_words_are_few(spark):
    """what is shipped to drop known words early has a bounded number of rows of a bounded length."""
    rows = [("often", 900), ("often", 900), ("known", 700), ("known", None), (None, 999), ("x" * 41, 999), ("abc", 999), ("zero", 0), *[(f"rare{c}", 5) for c in "abcdef"]]
    v = spark.createDataFrame(rows, "word string, freq long")
    most = lambda n: sorted(r[0] for r in spelling.frequent(v, most=n).collect())
    assert most(100) == ["known", "often", "often", *[f"rare{c}" for c in "abcdef"]]
    assert most(8) == ["known", "often", "often"] and most(2) == ["often", "often"] and most(1) == []
    assert spelling.frequent(v.where("freq = 0")).count() == 0


@pytest.mark.parametrize("distance, prefix", [(0, 4), (1, 6), (2, 10), (3, 5)])
def test_rows_of_deletes_equal_the_arrays(spark, distance, prefix):
    rng = random.Random(distance)
    words = ["", "a", "aa", "aba", "aabbaa", "żżaż", *["".join(rng.choice("abż") for _ in range(rng.randint(1, 12))) for _ in range(60)]]
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, freq int")
    want = {r.word: set(r.d) for r in df.select("word", spelling.deletes(F.col("word"), distance, prefix).alias("d")).collect()}
    rows = spelling.with_deletes(df, distance, prefix)
    assert rows.columns == ["word", "freq", "d"]
    got = {}
    for r in rows.collect():
        assert words[r.freq] == r.word
        got.setdefault(r.word, set()).add(r.d)
    assert got == want
