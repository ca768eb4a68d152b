"""Jaccard join and line deduplication against brute force."""

import collections
import random

import numpy as np
import pytest

from marketlex.llm import bayes_join, line_suffixes
from tests.llm.conftest import EDGES, LONG


def word_grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    """(links, class id) per row by comparing all pairs."""
    sets = [word_grams(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[find(k)] = min(low.get(find(k), d), d)
    return collections.Counter((d, links[k], low.get(find(k))) for k, (d, _) in enumerate(rows))


def got_classes(df):
    return collections.Counter((r.doc_id, r.n_links, r.class_id) for r in df.collect())


def test_every_link_of_the_small_table(small_docs, texts):
    assert got_classes(bayes_join.similarity_classes(small_docs)) == brute_classes(sorted(texts.items()))


@pytest.fixture(scope="module")
def near_copies():
    """A large group of near copies, a bridge, exact copies and strangers."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base, other = [word() for _ in range(120)], [word() for _ in range(80)]
    rows = []
    for k in range(70):
        w = list(base)
        w[rnd.randrange(120)] = word()
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(other)) for k in range(25)]
    rows.append((200, " ".join(other[:-6] + [word() for _ in range(6)])))
    rows += [(300 + k, " ".join(word() for _ in range(60))) for k in range(10)]
    return rows


@pytest.mark.parametrize("task_grams", [10 ** 6, 1500, 300])
def test_large_groups_at_any_task_size(spark, near_copies, task_grams):
    """One task, many buckets, and buckets cut into pairs of blocks give the
    same links."""
    df = spark.createDataFrame(near_copies, "doc_id long, text string").repartition(5)
    assert got_classes(bayes_join.similarity_classes(df, task_grams=task_grams)) == brute_classes(near_copies)


def test_join_edges(edges, none, odd_columns):
    found = bayes_join.similarity_classes(edges)
    got = {(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in found.collect()}
    assert {(1, 1, 1, 0), (2, 2, 1, 0), (3, 3, 1, 0), (5, 5, 2, 1), (6, 5, 2, 1), (7, 7, 1, 0), (11, 11, 2, 1), (None, None, 1, 0)} <= got
    assert found.count() == len(EDGES) and bayes_join.similarity_classes(none).collect() == []
    kept = bayes_join.one_of_each(odd_columns)
    assert kept.columns == odd_columns.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[5] == 1 and ids[6] == 0 and ids[11] == 1 and ids[10] == 2 and ids[1] == ids[2] == ids[None] == 1


def test_posterior_is_the_beta_tail():
    grid = (np.arange(200_000) + 0.5) / 200_000
    for m, n in ((10, 16), (16, 16), (40, 64), (0, 16)):
        like = grid ** m * (1 - grid) ** (n - m)
        assert abs(bayes_join.posterior(m, n, 0.8) - like[grid >= 0.8].sum() / like.sum()) < 1e-4
    floor = bayes_join.least_matches(0.8, 1e-6, 128)
    assert list(floor) == list(range(16, 129, 16)) and all(floor[n] <= 0.8 * n for n in floor)


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)]
    got = {r.node: r.root for r in bayes_join.components(spark.createDataFrame(pairs, "u long, v long"), "test").collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    joined = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in joined}


# ---- lines -----------------------------------------------------------------

def brute_deleted(rows, min_words):
    """Line numbers to delete per document, by comparing every line with
    every earlier equal one."""
    docs = sorted({(d, t) for d, t in rows if t is not None})
    lines = {k: [(n, " ".join(x.split())) for n, x in enumerate(t.split("\n")) if x.strip()] for k, (d, t) in enumerate(docs)}
    where, out = collections.defaultdict(list), collections.defaultdict(set)
    for k in lines:
        for a, (_, x) in enumerate(lines[k]):
            where[x].append((k, a))
    for k, own in lines.items():
        for a in range(len(own)):
            best = 0
            for j, b in where[own[a][1]]:
                if (j, b) >= (k, a):
                    break
                limit = min(len(own) - a, len(lines[j]) - b) if j != k else min(len(own) - a, a - b)
                n = 0
                while n < limit and own[a + n][1] == lines[j][b + n][1]:
                    n += 1
                if sum(len(x.split()) for _, x in own[a:a + n]) >= min_words:
                    best = max(best, n)
            if best:
                out[k].update(range(a, a + best))
    # blank lines between two deleted lines go with them
    return {docs[k]: {n for a in gone for n in range(lines[k][a][0], lines[k][a + 1][0] if a + 1 in gone else lines[k][a][0] + 1)} for k, gone in out.items()}


def check_lines(spark, rows, min_words):
    got = line_suffixes.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words).collect()
    want = brute_deleted(rows, min_words)
    originals = collections.defaultdict(list)
    for d, t in rows:
        originals[d].append(t)
    assert len(got) == len(rows)
    for r in got:
        gone = {k for s in r.removed for k in range(s["first"], s["last"] + 1)}
        assert r.n_removed == len(gone)
        match = [t for t in originals[r.doc_id] if gone == want.get((r.doc_id, t), set())
                 and (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)) == r.text]
        assert match, r


def test_lines_of_the_small_table(spark, texts):
    check_lines(spark, sorted(texts.items()), 50)


@pytest.mark.parametrize("min_words", [1, 2, 7, 12])
def test_random_lines(spark, min_words):
    rnd = random.Random(min_words)
    line = ["a", "b b", "c c c", "d d d d d", "", "  ", "e  e"]
    rows = [(k, "\n".join(rnd.choice(line) for _ in range(rnd.randint(1, 25)))) for k in range(40)]
    rows += [(100, "\n".join(["a"] * 60)), (101, "\n".join(["b b", "c c c"] * 20))]
    check_lines(spark, rows, min_words)


def test_line_edges(spark, edges, none, odd_columns):
    got = line_suffixes.dedup_lines(edges, 3).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(EDGES) and by_id[1].text is None and by_id[1].n_lines == 0 and by_id[2].text == "" and by_id[7].text == LONG
    assert by_id[5].n_removed == 0 and by_id[6].text == "" and by_id[6].n_removed == 2
    assert line_suffixes.dedup_lines(none).collect() == []
    kept = line_suffixes.drop_repeated(odd_columns, 3)
    assert kept.columns == odd_columns.columns and 6 not in {r.doc_id for r in kept.collect()}


def test_hot_line_and_copies(spark):
    """Hundreds of copies of one document, and one line everywhere."""
    body = "\n".join(f"line {k} of a passage with some words" for k in range(12))
    rows = [(k, body) for k in range(150)] + [(1000 + k, f"own words {k}\nshared line\n{'x ' * k}") for k in range(100)]
    got = {r.doc_id: r for r in line_suffixes.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and all(got[k].n_removed == 12 for k in range(1, 150))
    assert all(got[1000 + k].n_removed == 0 for k in range(100))
