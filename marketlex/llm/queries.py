"""Registered queries of the training-data operators, each over its whole
table with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlex.llm.base import hash_bucket, table

# Vocabulary files of public tokenizers; operators take any path.
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlex.llm.token_files import token_file_digest
    return token_file_digest(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), END_ID)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlex.llm.hilbert_search import nearest
    return nearest(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


LM_FOLDS, LM_HELD_OUT = 7, 2


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlex.llm.ngram_trie import score_documents
    held = F.coalesce(hash_bucket(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), LM_FOLDS) == LM_HELD_OUT, F.lit(False))
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text"))


LANG_FOLDS, LANG_HELD_OUT = 3, 1


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlex.llm.string_kernel import fit_language_model, predict_language
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(hash_bucket(F.col("doc_id"), LANG_FOLDS) == LANG_HELD_OUT, F.lit(False))
    model = fit_language_model(docs.where(~held))
    out = predict_language(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlex.llm.piece_viterbi import encode_decode
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(PIECES), keep_ids=True, keep_text=True)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlex.llm.secret_tests import find_secrets
    return find_secrets(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlex.llm.prefix_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), budget=1024)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlex.llm.qgram_decontam import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlex.llm.line_suffixes import dedup_lines
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))), ",")
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", spans.alias("removed"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlex.llm.bayes_join import similarity_classes
    return similarity_classes(table(spark, sf_dir, "documents")).drop("th", "class_key")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlex.llm.periodic_runs import find_runs, run_digest, with_periodic_tail
    return run_digest(find_runs(with_periodic_tail(table(spark, sf_dir, "documents"))))


CLUSTERS, CLUSTER_ROUNDS, CLUSTER_DIM = 40, 5, 64


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlex.llm.centroid_clusters import cluster, cluster_digest
    return cluster_digest(*cluster(table(spark, sf_dir, "embeddings"), CLUSTERS, CLUSTER_ROUNDS, CLUSTER_DIM))


def op13_exact_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketlex.llm.exact_packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), END_ID)


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_files, op2_nearest, op3_lm_scores, op4_language_id, op5_sentencepiece, op6_secrets, op7_token_counts, op8_decontaminate,
                                    op9_line_dedup, op10_jaccard_join, op11_periodic_runs, op12_centroid_clusters, op13_exact_packing)}


# Runs compared by their text instead of ranks; 50 words, as the operator.
OP9_SQL = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
l0 AS (SELECT doc_id, pos, trim(regexp_replace(raw, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS line FROM raw),
l1 AS (SELECT *, len(string_split(line, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM l0 WHERE line <> ''),
l AS (SELECT *, sum(words) OVER w AS upto, sum(words) OVER w - words AS before FROM l1 WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
runs AS (SELECT a.doc_id, a.seq AS s, min(b.seq) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.seq >= a.seq AND b.upto >= a.before + 50 GROUP BY ALL
         UNION SELECT b.doc_id, max(a.seq), b.seq FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.seq <= b.seq AND a.before <= b.upto - 50 GROUP BY b.doc_id, b.seq),
named AS (SELECT r.doc_id, r.s, r.e, string_agg(l.line, chr(10) ORDER BY l.seq) AS name FROM runs r JOIN l ON l.doc_id = r.doc_id AND l.seq BETWEEN r.s AND r.e GROUP BY ALL),
first AS (SELECT name, doc_id AS d, s AS fs, e AS fe FROM named QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, s) = 1),
later AS (SELECT n.* FROM named n JOIN first f USING (name) WHERE (n.doc_id <> f.d OR n.s <> f.fs) AND NOT (n.doc_id = f.d AND f.fe >= n.s)),
gone AS (SELECT DISTINCT l.doc_id, l.seq, l.pos FROM later r JOIN l ON l.doc_id = r.doc_id AND l.seq BETWEEN r.s AND r.e),
isles AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS isle FROM gone),
spans AS (SELECT doc_id, min(pos) AS a, max(pos) AS b FROM isles GROUP BY doc_id, isle),
per_doc AS (SELECT doc_id, sum(b - a + 1) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM spans GROUP BY doc_id),
kept AS (SELECT raw.doc_id, string_agg(raw.raw, chr(10) ORDER BY raw.pos) AS text FROM raw
         WHERE NOT EXISTS (SELECT 1 FROM spans WHERE spans.doc_id = raw.doc_id AND raw.pos BETWEEN a AND b) GROUP BY raw.doc_id)
SELECT d.doc_id, CASE WHEN p.doc_id IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines, CAST(coalesce(p.n, 0) AS INTEGER) AS n_removed,
       coalesce(p.removed, '') AS removed
FROM documents d LEFT JOIN per_doc p USING (doc_id) LEFT JOIN kept USING (doc_id)"""

# All pairs that share a five-word shingle, counted; classes by reachability.
OP10_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y, c = a.n AND c = b.n AS same FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
class AS (SELECT x, min(y) AS low FROM reach GROUP BY x),
per_doc AS (SELECT x, count(*) AS n_links, count(CASE WHEN same THEN 1 END) AS copies, min(CASE WHEN same THEN y END) AS first FROM links GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(class.low, d.doc_id)) AS class_id, least(d.doc_id, coalesce(p.first, d.doc_id)) AS copy_id,
       coalesce(p.copies, 0) + 1 AS n_copies, coalesce(p.n_links, 0) AS n_links
FROM documents d LEFT JOIN class ON class.x = d.doc_id LEFT JOIN per_doc p ON p.x = d.doc_id"""


# crc32 bit by bit; every pair of equal words up to a quarter of the text
# apart, as islands of neighbouring places; a stretch inside one of smaller
# period is no run.
OP11_SQL = r"""
WITH w0 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws,
       xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1)))) AS h FROM documents),
w1 AS (SELECT *, len(ws) AS n, h // 10 AS g FROM w0),
w2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM w1),
w3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w2),
w AS (SELECT rid, doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws, n FROM w3),
t AS (SELECT rid, n, unnest(ws) AS word, unnest(range(n)) AS i FROM w),
pairs AS (SELECT x.rid, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isles AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS isle FROM pairs),
stretch AS (SELECT rid, q, min(i) AS s, max(i) + q + 1 - min(i) AS len FROM isles GROUP BY rid, q, isle),
wide AS (SELECT * FROM stretch WHERE len >= greatest(6, 4 * q)),
runs AS (SELECT * FROM wide r WHERE NOT EXISTS (SELECT 1 FROM wide o WHERE o.rid = r.rid AND o.q < r.q AND o.s <= r.s AND o.s + o.len >= r.s + r.len)),
per AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY rid),
top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY len DESC, s, q) = 1),
gone AS (SELECT DISTINCT t.rid, t.i FROM t JOIN runs r ON t.rid = r.rid AND t.i >= r.s + r.q AND t.i < r.s + r.len),
kept AS (SELECT t.rid, string_agg(t.word, ' ' ORDER BY t.i) AS text FROM t WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = t.rid AND gone.i = t.i) GROUP BY t.rid)
SELECT w.doc_id, coalesce(per.n_runs, 0) AS n_runs, top.s AS start, top.len AS length, top.q AS period, 1000 * top.len // top.q AS exponent_milli,
       sha256(coalesce(per.listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256, w.n AS n_words
FROM w LEFT JOIN per USING (rid) LEFT JOIN top USING (rid) LEFT JOIN kept USING (rid)"""


def op12_sql(k: int = CLUSTERS, rounds: int = CLUSTER_ROUNDS, dim: int = CLUSTER_DIM) -> str:
    """Every distance to every centroid, one step after another."""
    distance = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = ("SELECT rid, list_sort(list({{'d': d, 'cluster': cluster}}))[1] AS best FROM "
            f"(SELECT rid, cluster, {distance}::BIGINT AS d FROM kept, c{{0}}) GROUP BY rid")
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v AS c FROM kept
  QUALIFY cluster < {k})"""]
    for j in range(rounds + 1):
        steps.append(f"a{j} AS MATERIALIZED ({near.format(j)})")
        if j < rounds:
            steps.append(f"""c{j + 1} AS MATERIALIZED (WITH one AS (SELECT best.cluster AS cluster, unnest(v) AS x, unnest(range({dim})) AS j FROM a{j} JOIN kept USING (rid)),
  mean AS (SELECT cluster, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM one GROUP BY ALL),
  list AS (SELECT cluster, list(x ORDER BY j) AS m FROM mean GROUP BY cluster)
  SELECT c{j}.cluster, coalesce(m, c) AS c FROM c{j} LEFT JOIN list USING (cluster))""")
    return ("WITH " + ",\n".join(steps) + f""", f AS (SELECT vec_id, best.cluster AS cluster, best.d AS distance FROM a{rounds} JOIN kept USING (rid))
SELECT vec_id, f.cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN c{rounds} USING (cluster)""")


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": OP9_SQL, "op10_jaccard_join": OP10_SQL, "op11_periodic_runs": OP11_SQL, "op12_centroid_clusters": op12_sql()}
