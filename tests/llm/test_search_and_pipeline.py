"""Vector search, the pipeline and the registered queries."""

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from marketlex.llm import bayes_join, hilbert_search, line_suffixes, qgram_decontam
from tests.llm.conftest import EDGES, SF


def test_hilbert_curve_steps_to_a_neighbour():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert_search.hilbert_key(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def exact(ids, x, q, k):
    score = (x * x[ids.index(q)]).sum(axis=1)
    order = sorted((-s, i) for i, s in zip(ids, score) if i != q)[:k]
    return [i for _, i in order], [-s for s, _ in order]


def made_vectors(kind, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    if kind == "clustered":
        x += rng.normal(size=(30, 64))[rng.integers(0, 30, n)] * 1.5
    if kind == "hot":  # a third of the vectors in one narrow place
        x[:n // 3] = x[0] + 1e-6 * x[:n // 3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind in ("lengths", "clustered"):
        x *= rng.lognormal(0, 0.7, (n, 1))
    return x


@pytest.mark.parametrize("kind, n", [("unit", 300), ("unit", 2000), ("unit", 10_000), ("lengths", 300), ("lengths", 2000), ("lengths", 10_000), ("clustered", 5000), ("hot", 3000)])
def test_recall(spark, kind, n):
    x = made_vectors(kind, n)
    ids = list(range(n))
    t = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = hilbert_search.nearest(t).toPandas()
    queries = [i for i in ids if i % 20 == 0]
    assert got.groupby("query_id").size().to_dict() == {q: 20 for q in queries}
    hits = 0
    for q, rows in got[got.query_id.isin(queries[:120])].groupby("query_id"):
        want, score = exact(ids, x, q, 20)
        rows = rows.sort_values("rank")
        assert list(rows["rank"]) == list(range(1, 21)) and rows.score.is_monotonic_decreasing
        hits += len(set(want) & set(rows.vec_id)) if kind != "hot" else (rows.score >= score[-1] - 1e-9).sum()
    assert hits / (min(120, len(queries)) * 20) >= 0.9


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_recall_of_given_vectors(spark, name):
    t = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    got = hilbert_search.nearest(t).toPandas()
    data = t.toPandas()
    ids, x = data.vec_id.tolist(), np.array(data.embedding.tolist(), float)
    hits = sum(len(set(exact(ids, x, q, 20)[0]) & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits / len(got) >= 0.9


def test_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(90, 5)), 1).astype(np.float32)
    x[40:70] = x[3]                      # a hot vector
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(200, None), (220, []), (240, [0.0] * 5), (260, [1.0, None, 0.0, 0.0, 0.0]), (280, [float("nan")] * 5), (300, [1.0, 2.0]),
           (320, [float("inf")] * 5), (None, [1.0] * 5), rows[0]]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = hilbert_search.nearest(df, k=20).toPandas()
    ids = list(range(90))
    assert set(got.query_id) == {0, 20, 40, 60, 80}
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        want, _ = exact(ids, x.astype(float), q, 20)
        score = (x.astype(float)[g.vec_id] * x.astype(float)[q]).sum(axis=1)
        assert len(g) == 20 and q not in set(g.vec_id) and np.allclose(g.score, score, rtol=1e-12)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
        hits += len(set(want) & set(g.vec_id))
    assert hits >= 90


@pytest.mark.parametrize("n", [2, 9, 20, 21, 40, 100])
def test_few_vectors_are_all_found(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = hilbert_search.nearest(df, query_every=1).groupBy("query_id").count().collect()
    assert len(got) == n and all(r["count"] == min(20, n - 1) for r in got)


def test_fewer_candidates_and_empty(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in hilbert_search.nearest(df).collect()] == [(20, 1, 21, 0.5)]
    assert hilbert_search.nearest(df.limit(0)).collect() == []


# ---- pipeline --------------------------------------------------------------

def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "sentencepiece"]


def test_pipeline_equals_brute_force(spark, small_docs, texts):
    from tests.llm.test_near_duplicates import brute_classes, brute_deleted
    docs = {d: t for d, t in texts.items() if any(c.isalpha() for c in t)}
    gone = {d: g for (d, t), g in brute_deleted(sorted(docs.items()), line_suffixes.MIN_WORDS).items()}
    docs = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ())) for d, t in docs.items()}
    docs = {d: t for d, t in docs.items() if d not in gone or t.strip()}
    docs = {d: docs[d] for (d, _, c) in brute_classes(sorted(docs.items())) if d == c}
    items = [qgram_decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {d: t for d, t in docs.items() if not any(i in qgram_decontam.normal(t) for i in items)}
    import public_tokenizers
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = {r.doc_id: list(r.piece_ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: library.encode(t) for d, t in docs.items()}


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(d, t, "en", None, 1) for d, t in EDGES] + [(20 + k, "some plain english words of a text to learn from", "en", "s", 0) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        d = table
        for name, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
            if name != "sentencepiece":
                assert d.columns == docs.columns and [f.dataType for f in d.schema] == [f.dataType for f in docs.schema]
        assert d.count() >= 0


# ---- registered queries ----------------------------------------------------

@pytest.mark.parametrize("number", range(1, 14))
def test_each_operator_has_its_query(number):
    assert len([q for q in E.queries() if q.startswith(f"op{number}_")]) == 1


def test_contract_columns(spark):
    want = {
        "op1": "doc_id start n_tokens ids_crc32", "op2": "query_id rank vec_id score",
        "op3": "doc_id held_out n_tokens n_known train_tokens base_score score", "op4": "doc_id held_out lang_pred score",
        "op6": "doc_id n_assign n_access n_hex base_sha256 spans", "op7": "doc_id n_bytes n_tokens over_limit",
    }
    for name, f in E.queries().items():
        op = name.split("_")[0]
        if op in want:
            df = f(spark, SF)
            assert set(want[op].split()) <= set(df.columns), name
            assert df.count() > 0


def test_one_of_each_keeps_the_smallest_id(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "x y z")]
    kept = bayes_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
