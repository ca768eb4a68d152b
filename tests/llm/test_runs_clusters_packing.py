"""Periodic runs, centroid clustering and packing against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from marketlex.llm import centroid_clusters as C
from marketlex.llm import exact_packing as P
from marketlex.llm import periodic_runs as R
from marketlex.llm.queries import END_ID, WORD_BPE, tokenizer_path
from tests.llm.conftest import EDGES


# ---- periodic runs ---------------------------------------------------------

def brute_runs(w, least_words=6, least_periods=4):
    n, found = len(w), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_words, least_periods * q):
                found.append((i, j + q - i, q))
            i = j + 1
    smallest = [r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found)]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(120):
        words, n = rng.choice(["ab", "abc", "abcdefgh"]), rng.randint(0, 70)
        t = [rng.choice(words) for _ in range(n)]
        if n and rng.random() < 0.6:  # a planted repetition, perhaps with a slip
            at, p = rng.randrange(n), rng.randint(1, 9)
            t[at:] = [t[at + (i % p if at + i % p < n else 0)] for i in range(rng.randint(1, 60))]
            if rng.random() < 0.4:
                t[rng.randrange(len(t))] = "z"
        texts.append(t)
    names = {}
    ids = np.array([names.setdefault(x, len(names)) for t in texts for x in t], np.int64)
    sizes = [len(t) for t in texts]
    got = R.runs_of(ids, np.repeat(np.arange(len(texts)), sizes))
    at, want = 0, []
    for t in texts:
        want += [(s + at, n, q) for s, n, q in brute_runs(t)]
        at += len(t)
    assert [tuple(r) for r in got.tolist()] == want
    got3 = R.runs_of(ids, np.repeat(np.arange(len(texts)), sizes), 3, 3)
    assert len(got3) == sum(len(brute_runs(t, 3, 3)) for t in texts)


def collapse(words):
    gone = {i for s, n, q in brute_runs(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_odd_texts(spark):
    rows = [*EDGES, (20, "tick " * 50_000), (21, "a b c " * 4 + "d " + "x y " * 9 + "tail"), (22, "one word " * 7), (23, "ha ha ha ha ha"), (24, "ha " * 6)]
    docs = spark.createDataFrame([(k, t, "kept", "mine", 1.5) for k, t in rows], "doc_id long, text string, source string, runs string, `odd.name` double")
    got = R.find_runs(docs).collect()
    assert got[0].__fields__ == ["doc_id", "source", "odd.name", "n_words", "runs", "collapsed"]
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[20][0].runs == [(0, 50_000, 1)] and by[20][0].collapsed == "tick"
    assert [tuple(x) for x in by[21][0].runs] == [(0, 12, 3), (13, 18, 2)] and by[21][0].collapsed == "a b c d x y tail"
    assert [tuple(x) for x in by[22][0].runs] == [(0, 7, 1)]
    assert by[23][0].runs == [] and by[24][0].collapsed == "ha"
    for k, t in rows:
        if t is None or len(t) < 10_000:
            words = [w.decode() for w in (t or "").encode().split()]
            assert any(r.n_words == len(words) and r.collapsed == collapse(words) for r in by[k])
    digest = {r.doc_id: r for r in R.run_digest(R.find_runs(docs)).collect()}
    assert digest[1].n_runs == 0 and digest[1].start is None and digest[1].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert digest[21].start == 13 and digest[21].length == 18 and digest[21].exponent_milli == 9000
    assert digest[21].runs_sha256 == hashlib.sha256(b"0,12,3\n13,18,2\n").hexdigest()


def test_periodic_tail(spark):
    words = [f"w{k}" for k in range(37)]
    rows = [(k, " ".join(words[:k % 37])) for k in range(400)] + [(None, "a b c"), (5, None)]
    got = {(r.doc_id, k) for k, r in enumerate(R.with_periodic_tail(spark.createDataFrame(rows, "doc_id long, text string")).collect()) if r.text != rows[k][1]}
    for k, r in enumerate(R.with_periodic_tail(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()):
        d, t = rows[k]
        w = (t or "").split()
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            assert r.text == " ".join(w)
        else:
            assert r.text == t
    assert got


def test_runs_empty_table(spark, none):
    assert R.run_digest(R.find_runs(none)).count() == 0
    with pytest.raises(ValueError):
        R.find_runs(none, least_periods=2)


# ---- centroid clustering ---------------------------------------------------

def dense_clusters(ids, x, k, rounds):
    order = sorted(range(len(ids)), key=lambda j: hashlib.sha256(f"2:{ids[j]}".encode()).hexdigest())[:k]
    c = x[order].copy()

    def near(c):
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        label, _ = near(c)
        for j in range(len(c)):
            if (label == j).any():
                s, n = x[label == j].sum(axis=0), int((label == j).sum())
                c[j] = [int(v) // n for v in s]
    return (*near(c), c)


def test_assign_equals_dense_search():
    rng = np.random.default_rng(3)
    for spread in (3, 40, 4000):
        x = rng.integers(-spread, spread, (3000, 16)) + rng.integers(-3 * spread, 3 * spread, (3000, 1))
        c = np.concatenate([x[:25], x[:5], rng.integers(-spread, spread, (10, 16))])  # repeated centroids: ties
        label, best, computed = C.assign(x, c)
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (label == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        assert computed < x.shape[0] * len(c) / 2  # the bounds pass most centroids by


def test_cluster_equals_dense(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(700, 64)) / 8).astype(np.float32)
    x[100:300] = x[7]                                          # equal vectors
    rows = [(k, [float(v) for v in r], 1, "mine") for k, r in enumerate(x)]
    bad = [(9001, None, 0, "x"), (9002, [1.0] * 63, 0, "x"), (9003, [1.0] * 63 + [None], 0, "x"), (9004, [float("nan")] * 64, 0, "x"),
           (9005, [float("inf")] + [0.0] * 63, 0, "x"), (9006, [], 0, "x")]
    t = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, cluster int, distance string").repartition(7)
    labels, centroids = C.cluster(t, 40, 5, 64)
    y = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want_label, want_distance, want_c = dense_clusters(list(range(700)), y, 40, 5)
    assert (centroids == want_c).all()
    got = {r.vec_id: r for r in C.cluster_digest(labels, centroids).collect()}
    assert sorted(got) == list(range(700))
    for k in range(700):
        assert (got[k].cluster, got[k].distance) == (want_label[k], want_distance[k])
        assert got[k].cluster_inertia == want_distance[want_label == want_label[k]].sum() and got[k].inertia == want_distance.sum()
        assert got[k].centroid_sha256 == hashlib.sha256(",".join(map(str, want_c[want_label[k]].tolist())).encode()).hexdigest()


def test_cluster_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels, centroids = C.cluster(none)
    assert C.cluster_digest(labels, centroids).count() == 0
    v = [0.5] * 64
    few = spark.createDataFrame([(1, v), (1, v), (None, v), (2, [0.25] * 64)], "vec_id long, embedding array<double>")
    labels, centroids = C.cluster(few)
    assert len(centroids) == 4 and labels.count() == 4          # repeated ids count each; fewer vectors than centroids
    assert all(r.distance == 0 for r in labels.collect())
    with pytest.raises(Exception, match="beyond"):
        C.cluster(spark.createDataFrame([(1, [1e9] + [0.0] * 63)], "vec_id long, embedding array<double>"))


# ---- packing ---------------------------------------------------------------

def best_fit_decreasing(lengths, capacity):
    import bisect
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, x)
        g = gaps.pop(k) if k < len(gaps) else capacity
        n += k == len(gaps) and g == capacity
        if g > x:
            bisect.insort(gaps, g - x)
    return n


@pytest.mark.parametrize("make", [lambda r: np.clip(r.lognormal(3, 1.2, 4000), 1, 256), lambda r: r.integers(1, 257, 3000), lambda r: r.integers(90, 257, 2000),
                                  lambda r: np.ones(1000), lambda r: r.choice([150, 106, 53], 999), lambda r: np.full(7, 256)])
def test_plan(make):
    lengths = make(np.random.default_rng(2)).astype(int)
    counts = np.bincount(lengths, minlength=257)
    patterns = P.plan_patterns(counts)
    used = np.zeros(257, int)
    for times, parts in patterns:
        assert sum(a * n for a, n in parts) <= 256
        for a, n in parts:
            used[a] += times * n
    assert (used == counts).all()
    plan = P.Plan(patterns)
    assert plan.sequences <= 1.01 * best_fit_decreasing(lengths.tolist(), 256) + 1
    assert len(patterns) <= 3 * (counts > 0).sum() + 3
    # places: every sequence is filled from 0 without gaps
    number = np.concatenate([np.arange(c) for c in counts if c])
    length = np.repeat(np.flatnonzero(counts), counts[counts > 0])
    sequence, offset = plan.place(length, number)
    gapless(list(zip(sequence.tolist(), offset.tolist(), length.tolist())), 256)


def gapless(rows, capacity):
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity


def test_pair_index_follows_the_counts():
    rng = np.random.default_rng(1)
    left = P.Lengths(np.bincount(rng.integers(1, 40, 60), minlength=65))
    for _ in range(300):
        a = int(rng.integers(1, 40))
        if left.left[a] and rng.random() < 0.6:
            left.take(a)
        else:
            left.put_back(a)
        want = np.zeros(65, int)
        live = np.flatnonzero(left.left > 0)
        for x in live:
            for y in live[live >= x]:
                if x + y < 65 and (x != y or left.left[x] >= 2):
                    want[x + y] += 1
        assert (left.pairs == want).all()


def test_packing_of_odd_texts(spark, odd_columns):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, END_ID], "<u4") for _, t in EDGES]
    d = odd_columns.withColumnRenamed("score", "sequence_id").withColumnRenamed("removed", "offset")
    packed = P.pack_documents(d, tokenizer_path(WORD_BPE), END_ID, keep_ids=True)
    rows = packed.collect()
    want = sorted((k if k is not None else -1, p, p * 4096, len(x[p * 4096:(p + 1) * 4096]), zlib.crc32(x[p * 4096:(p + 1) * 4096].tobytes()))
                  for (k, _), x in zip(EDGES, ids) for p in range(-(-len(x) // 4096)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    gapless([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    total = sum(map(len, ids))
    assert len({r.sequence_id for r in rows}) == -(-total // 4096)
    whole = {r.sequence_id: r for r in P.sequences(packed).collect()}
    for r in rows:
        part = whole[r.sequence_id].ids[4 * r.offset:4 * (r.offset + r.length)]
        assert bytes(part) == bytes(r.ids) and zlib.crc32(part) == r.ids_crc32
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole.values())
    again = P.pack_documents(d.repartition(5), tokenizer_path(WORD_BPE), END_ID).collect()
    key = lambda r: (str(r.doc_id), r.piece, r.ids_crc32, r.sequence_id, r.offset)
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_packing_small_documents(spark, small_docs, none):
    rows = P.pack_documents(small_docs, tokenizer_path(WORD_BPE), END_ID).collect()
    gapless([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    bound = -(-sum(r.length for r in rows) // 4096)
    assert bound <= len({r.sequence_id for r in rows}) <= best_fit_decreasing([r.length for r in rows], 4096)
    assert P.pack_documents(none, tokenizer_path(WORD_BPE), END_ID).count() == 0
