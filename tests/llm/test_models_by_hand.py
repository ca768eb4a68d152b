"""Language prediction and the randomness battery recomputed plainly."""

import collections
import math
import random
import re
import string

import numpy as np
import pytest

from marketlex.llm import secret_tests, string_kernel
from tests.llm.conftest import EDGES


def grams(t, n=3):
    t = " ".join(t.lower().split())
    return {t[k:k + m] for m in range(1, n + 1) for k in range(len(t) - m + 1)}


def test_language_prediction_equals_dense_regression(spark, small_docs):
    ridge = 0.3
    train = small_docs.where("doc_id % 3 <> 1 and lang is not null").select("doc_id", "text", "lang")
    model = string_kernel.fit_language_model(train, rows_per_label=30, landmarks_per_label=8, ridge=ridge)
    # the sampled rows, which only the bounds of the sample decide
    usable = train.where(string_kernel.F.col("text").rlike(r"\p{L}"))
    rows = string_kernel.sample_rows(usable, 30, 20_000, 7).collect()
    land = sorted((r.lang, r.k, r.text) for r in rows if r.k <= 8)

    def kernel(a, b):  # shared n-grams over the geometric mean of their numbers
        x, y = [grams(t) for t in a], [grams(t) for t in b]
        return np.array([[len(p & q) / math.sqrt(max(1, len(p)) * max(1, len(q))) for q in y] for p in x])

    marks = [t for _, _, t in land]
    value, vector = np.linalg.eigh(kernel(marks, marks))
    keep = value > 1e-6 * value[-1]
    half = vector[:, keep] / np.sqrt(value[keep])

    def features(texts):
        return np.hstack([kernel(texts, marks) @ half, np.ones((len(texts), 1))])

    phi, labels = features([r.text for r in rows]), sorted({r.lang for r in rows})
    y = np.array([[1.0 if r.lang == x else -1.0 for x in labels] for r in rows])
    beta = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
    asked = [(r.doc_id, r.text) for r in small_docs.collect() if r.text and any(c.isalpha() for c in r.text)][:120]
    want = features([t for _, t in asked]) @ beta
    got = {r.doc_id: r for r in string_kernel.predict_language(small_docs, model).collect()}
    assert model.labels == labels
    agree = 0
    for (d, _), s in zip(asked, want):
        # hashed n-grams may share a bucket: values agree closely, not to the last digit
        assert abs(got[d].score - min(1.0, max(0.0, (s.max() + 1) / 2))) < 0.02
        agree += got[d].lang_pred == labels[s.argmax()]
    assert agree >= len(asked) - 1


# ---- secrets: kind "random" ------------------------------------------------

def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token):
    body = token.rstrip("=")
    name, chars = next((k, v) for k, v in secret_tests.ALPHABETS.items() if set(body) <= set(v))
    n, size = len(body), len(chars)
    chi = size / n * sum(c * c for c in collections.Counter(body).values()) - n
    kind = {c: k for part, k in secret_tests.CLASSES for c in part}
    change = 1 - sum((sum(c in part for c in chars) / size) ** 2 for part, _ in secret_tests.CLASSES)
    changes = sum(kind[a] != kind[b] for a, b in zip(body, body[1:]))
    v = np.array([chars.index(c) + 1 for c in body], float)
    d = v - v.mean()
    df, steps = size - 1, n - 1
    chi_z = (chi - df) / math.sqrt(2 * df * (1 - 1 / n))
    run_z = (changes - steps * change) / math.sqrt(steps * change * (1 - change)) if change > 0 else 0.0
    serial_z = ((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n) if (d * d).sum() > 0 else math.sqrt(n)
    p_random = min(1.0, 3 * min(tail(chi_z), 2 * tail(abs(run_z)), 2 * tail(abs(serial_z))))
    excess = n * max(size * secret_tests.TEXT_REPEAT - 1, 0.05)
    text_chi = (df + excess - chi) / math.sqrt(2 * (df + 2 * excess))
    rate = secret_tests.TEXT_CHANGE
    text_run = (changes - steps * rate) / math.sqrt(steps * rate * (1 - rate)) if change > 0 else 0.0
    return name, n, p_random, tail((text_chi + text_run) / math.sqrt(2)), n * math.log2(size)


def tokens(seed):
    rnd = random.Random(seed)
    made = ["".join(rnd.choices(alphabet, k=rnd.randint(20, 70))) for alphabet in
            (string.digits, "0123456789abcdef", string.ascii_lowercase, string.ascii_letters, string.ascii_letters + string.digits,
             string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567") for _ in range(12)]
    made += ["a" * 25, "ab" * 15, "get-user-name-from-database", "AbstractSingletonProxyFactoryBean", "0123456789" * 3, "Q" * 30 + "=="]
    made += ["".join(rnd.choices("etaoinshr", [12, 9, 8, 8, 7, 7, 6, 6, 6], k=rnd.randint(20, 60))) for _ in range(30)]
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_battery_equals_plain_computation(spark, seed):
    given = [t for t in tokens(seed) if re.fullmatch(secret_tests.CANDIDATE, t)]
    got = {r.token: r for r in secret_tests.battery(spark.createDataFrame([(t,) for t in given], "token string")).collect()}
    for t in given:
        name, n, p_random, p_text, bits = battery(t)
        r = got[t]
        assert (r.alphabet, r.n) == (name, n) and math.isclose(r.bits, bits)
        # the normal tail is an approximation within 3 %
        assert math.isclose(r.p_random, p_random, rel_tol=0.031, abs_tol=1e-12), t
        assert math.isclose(r.p_text, p_text, rel_tol=0.031, abs_tol=1e-12), t


def kept_by_hand(rows):
    """Benjamini-Hochberg per band, p-values rounded to their bins."""
    bands = collections.defaultdict(list)
    for k, (n, p, p_random, bits) in enumerate(rows):
        bands[int(math.log2(n))].append((math.floor(min(-math.log10(max(p, 1e-60)), 60.0) / secret_tests.BIN), k))
    out = set()
    for members in bands.values():
        cuts = [b for b, _ in members if 10 ** (-b * secret_tests.BIN) * len(members) <= secret_tests.FDR * sum(c >= b for c, _ in members)]
        out |= {k for b, k in members if cuts and b >= min(cuts) and rows[k][2] >= secret_tests.REJECT and rows[k][3] >= secret_tests.MIN_BITS}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_false_discovery_control_equals_plain_computation(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(20, 300), 10 ** -rng.expovariate(0.5 if rng.random() < 0.7 else 0.08), rng.choice([0.0001, 0.5, 0.9]), rng.choice([40.0, 90.0])) for _ in range(600)]
    df = spark.createDataFrame([(k, float(n), p, r, b) for k, (n, p, r, b) in enumerate(rows)], "k int, n double, p_text double, p_random double, bits double")
    got = {r.k for r in secret_tests.discoveries(df).collect()}
    assert got == kept_by_hand(rows) and 0 < len(got) < 600


def test_random_spans_of_texts(spark):
    rnd = random.Random(9)
    keys = ["".join(rnd.choices(string.ascii_letters + string.digits, k=40)) for _ in range(30)]
    rows = [(k, f"before {x}, é after") for k, x in enumerate(keys)] + [(100 + k, t) for k, (_, t) in enumerate(EDGES)]
    found = []
    for d, t in rows:
        found += [(d, m.start(), m.end(), *battery(m[0])) for m in re.finditer(secret_tests.CANDIDATE, t or "")]
    keep = kept_by_hand([(n, p, r, b) for _, _, _, _, n, r, p, b in found])
    base = re.compile(secret_tests.ASSIGN)
    want = {(d, a, b) for k, (d, a, b, *_) in enumerate(found) if k in keep and not base.search(dict(rows)[d])}
    got = {(r.doc_id, int(a), int(b)) for r in secret_tests.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
           for kind, a, b in (s.split(":") for s in r.spans.split(",") if s) if kind == "random"}
    assert got == want and len(got) >= 27
