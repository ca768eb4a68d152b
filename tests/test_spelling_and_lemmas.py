"""Corrections and lemmas against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marketlex.operators import lemmas, spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(rng, n, letters="abcż", longest=14):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def corrected(asked, known, d):
    out = {}
    for w in asked:
        near = sorted((distance(w, k), -f, k) for k, f in known.items() if abs(len(k) - len(w)) <= d)
        if near and near[0][0] <= d:
            out[w] = (near[0][2], near[0][0])
    return out


@pytest.mark.parametrize("d, prefix", [(2, 10), (2, 4), (1, 6)])
def test_corrections_equal_brute_force(spark, d, prefix):
    rng = random.Random(d * 10 + prefix)
    known = {w: rng.randint(1, 9) for w in words(rng, 120)}
    asked = words(rng, 150) + list(known)[:5]
    for w in list(known)[:60]:  # near misses, also of long words
        w = list(w * 3)
        for _ in range(2):
            w[rng.randrange(len(w))] = rng.choice("abż")
        asked.append("".join(w))
    known |= {w * 3: 2 for w in list(known)[:60]}
    table = spark.createDataFrame([*known.items(), *[(w, 0) for w in list(known)[:9]], (None, 3)], "word string, freq int")
    got = spelling.corrections(spark.createDataFrame([(w,) for w in [*asked, None]], "word string"), table, d, prefix)
    assert {r.form: (r.replacement, r.distance) for r in got.collect()} == corrected(set(asked), known, d)


def test_deletes_reach_the_prefix_alone(spark):
    got = spark.range(1).select(spelling.deletes(F.lit("abcdefghijklmno"), 2, 4)).first()[0]
    assert set(got) == {"abcd", "bcd", "acd", "abd", "abc", "cd", "bd", "bc", "ad", "ac", "ab"} and len(got) == 11
    assert spark.range(1).select(spelling.deletes(F.lit("a"), 2, 4)).first()[0] == ["a", ""]


def test_texts_are_corrected(spark):
    known = spark.createDataFrame([("kolejka", 9), ("akcje", 5), ("spadki", 7), ("spadku", 8)], "word string, freq int")
    docs = spark.createDataFrame([(1, "Akcej  i spadk kolejkka! kolejka"), (1, "Spadkii xyz Kolejka"), (None, None), (2, "")], "id int, text string")
    got = [(r.id, r.text) for r in spelling.correct_spelling(docs, known).collect()]
    assert sorted(got, key=repr) == sorted([(1, "Akcje i spadku kolejkka! kolejka"), (1, "Spadki xyz Kolejka"), (None, None), (2, "")], key=repr)


def learned(pairs, longest, least):
    counts = {}
    for form, lemma in set(pairs):
        same = 0
        while same < min(len(form), len(lemma)) and form[same] == lemma[same]:
            same += 1
        for k in range(max(len(form) - same, 1), min(len(form), longest) + 1):
            counts.setdefault(form[len(form) - k:], Counter())[lemma[len(form) - k:]] += 1
    out = {}
    for s, c in counts.items():
        ending, n = min(c.items(), key=lambda e: (-e[1], e[0]))
        if n >= least:
            out[s] = (ending, n, n / sum(c.values()))
    return out


def test_rules_and_unseen_forms_equal_brute_force(spark):
    rng = random.Random(1)
    stems = list(dict.fromkeys(words(rng, 200, "abcdeż", 7)))
    pairs = [(w + a, w + b) for w in stems for a, b in rng.sample([("ami", ""), ("ach", "a"), ("owi", ""), ("ie", "a"), ("", ""), ("ów", ""), ("ego", "y")], 3)]
    rng.shuffle(pairs)
    held, taught = pairs[:150], pairs[150:]
    rules = lemmas.suffix_rules(spark.createDataFrame([*taught, *taught[:40], (None, "x"), ("y", None), ("", "z")], "form string, lemma string"))
    want = learned(taught, 6, 2)
    assert {r.suffix: (r.ending, r.n, round(r.share, 9)) for r in rules.collect()} == {s: (e, n, round(x, 9)) for s, (e, n, x) in want.items()}
    got = {r.form: r.lemma for r in lemmas.predict_lemmas(spark.createDataFrame(held, "form string, lemma string"), rules).collect()}
    brute = {}
    for form, _ in held:
        for k in range(min(len(form), 6), 0, -1):
            if form[len(form) - k:] in want and form[:len(form) - k] + want[form[len(form) - k:]][0]:
                brute[form] = form[:len(form) - k] + want[form[len(form) - k:]][0]
                break
    assert got == brute
    assert sum(got.get(f) == x for f, x in held) > 0.5 * len(held)  # most unseen forms get their lemma


def test_lemmatized_texts(spark):
    pairs = spark.createDataFrame([("kotami", "kot"), ("psami", "pies"), ("lasami", "las"), ("domami", "dom")], "form string, lemma string")
    docs = spark.createDataFrame([(1, "Kotami psami  oknami 12ami x"), (None, "lasami"), (3, None)], "id int, text string")
    got = {r.id: r.text for r in lemmas.lemmatize(docs, pairs).collect()}
    assert got == {1: "kot pies okn 12ami x", None: "las", 3: None}
