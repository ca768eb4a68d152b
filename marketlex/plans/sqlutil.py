"""Helpers to write the DuckDB oracle SQL from the same fixed values."""

from __future__ import annotations

from marketlex.functions import text as tx


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(t: str, pattern: str, rep: str = " ") -> str:
    return f"regexp_replace({t}, {lit(pattern)}, {lit(rep)}, 'g')"


def strip_unicode(t: str) -> str:
    return rx(t, f"^{tx.SPACE}+|{tx.SPACE}+$", "")


def normalize_whitespace(t: str) -> str:
    return f"trim({rx(t, tx.SPACE + '+', ' ')})"


def strip_urls(t: str) -> str:
    return rx(t, tx.URL_PATTERN)


def strip_mentions(t: str) -> str:
    return rx(t, tx.MENTION_PATTERN)


def strip_hashtags(t: str) -> str:
    return rx(t, tx.HASHTAG_PATTERN)


def strip_cashtags(t: str) -> str:
    return rx(t, tx.CASHTAG_PATTERN)


def keep_polish_text(t: str) -> str:
    return rx(t, tx.NON_POLISH_PATTERN)


def strip_tco(t: str) -> str:
    return strip_unicode(rx(t, tx.TCO_PATTERN, ""))


def clean_text_full(t: str) -> str:
    x = rx(t, tx.URL_PATTERN)
    x = rx(x, f"{tx.MENTION_PATTERN}|{tx.HASHTAG_PATTERN}")
    x = f"replace({x}, '_', ' ')"
    x = rx(x, tx.NON_POLISH_STRICT_PATTERN)
    return normalize_whitespace(x)


def clean_text_basic(t: str) -> str:
    return strip_urls(strip_mentions(t))


def replace_pairs(t: str, pairs, prefix: str = " ") -> str:
    x = t
    for k, v in pairs:
        x = f"replace({x}, {lit(k)}, {lit(prefix + v)})"
    return x


def collapse_chars(cs: str) -> str:
    """T7 oracle over a code-point list ``cs = string_split(t, '')``.  DuckDB
    has no back-references: drop a char equal to its predecessor unless it
    is a newline."""
    return f"array_to_string(list_filter({cs}, lambda c, i: i = 1 OR c <> {cs}[i - 1] OR c = chr(10)), '')"


def sentence_case(t: str) -> str:
    marked = f"regexp_replace(lower({t}), {lit(tx.SENTENCE_START_PATTERN)}, '\\1' || chr(1) || '\\2', 'g')"
    return (f"array_to_string(list_transform(string_split({marked}, chr(1)), lambda p, i: "
            f"CASE WHEN i = 1 THEN p ELSE upper(substr(p, 1, 1)) || substr(p, 2) END), '')")


def tokens(t: str) -> str:
    s = strip_unicode(t)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, {lit(tx.SPACE + '+')}) END)"


def remove_stopwords(t: str, words) -> str:
    inlist = ", ".join(lit(w) for w in sorted(set(words)))
    return f"array_to_string(list_filter({tokens(t)}, lambda w: lower(w) NOT IN ({inlist})), ' ')"


def r6(x: str) -> str:
    return f"round({x}, 6)"


# ---- distribution tails and least squares in SQL ---------------------------
STEPS = 1200


def _simpson(lo: str, hi: str, body: str) -> str:
    """Simpson's rule over [lo, hi]; ``body`` is an expression in ``u``."""
    h = f"(({hi}) - ({lo})) / {STEPS}"
    at = body.replace("{u}", f"(({lo}) + i * {h})")
    return (f"(list_sum(list_transform(range(0, {STEPS + 1}), lambda i: "
            f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({at}))) * {h} / 3)")


def f_tail(f: str, d1: str, d2: str) -> str:
    """P(F > f): the incomplete beta integral with t = cos(u)^2."""
    a, b = f"(({d2}) / 2.0)", f"(({d1}) / 2.0)"
    lo = f"acos(sqrt(({d2}) / (({d2}) + ({d1}) * greatest(({f}), 0.0))))"
    hi = f"least(pi() / 2, {lo} + 16 / sqrt(({d2}) + 1.0))"
    area = _simpson(lo, hi, f"pow(cos({{u}}), 2 * {a} - 1) * pow(sin({{u}}), 2 * {b} - 1)")
    return f"(2 * exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) * {area})"


def t_tail(t: str, nu: str) -> str:
    """P(|T| > |t|)."""
    return f_tail(f"(({t}) * ({t}))", "1.0", nu)


def chi2_tail(x: str, k: str) -> str:
    """P(chi-squared > x): the incomplete gamma integral with t = u^2."""
    a = f"(({k}) / 2.0)"
    lo = f"sqrt(greatest(({x}), 0.0) / 2)"
    return f"(2 * exp(-lgamma({a})) * {_simpson(lo, f'({lo} + 9)', f'pow({{u}}, 2 * {a} - 1) * exp(-{{u}} * {{u}})')})"


def k2_tail(skew: str, kurt: str, n: str) -> str:
    """exp(-K^2 / 2) from population skewness and excess kurtosis
    (D'Agostino and Pearson's published transformations)."""
    y = f"({skew}) * sqrt(({n} + 1.0) * ({n} + 3) / (6.0 * ({n} - 2)))"
    beta = f"(3.0 * ({n} * {n} + 27.0 * {n} - 70) * ({n} + 1.0) * ({n} + 3) / (({n} - 2.0) * ({n} + 5.0) * ({n} + 7.0) * ({n} + 9.0)))"
    w2 = f"(-1 + sqrt(2 * ({beta} - 1)))"
    z1 = f"(asinh(({y}) / sqrt(2.0 / ({w2} - 1))) / sqrt(0.5 * ln({w2})))"
    x = f"((({kurt}) + 3 - 3.0 * ({n} - 1) / ({n} + 1)) / sqrt(24.0 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1.0) * ({n} + 1) * ({n} + 3) * ({n} + 5))))"
    s = f"(6.0 * ({n} * {n} - 5.0 * {n} + 2) / (({n} + 7.0) * ({n} + 9)) * sqrt(6.0 * ({n} + 3.0) * ({n} + 5) / ({n} * ({n} - 2.0) * ({n} - 3))))"
    a = f"(6.0 + 8.0 / {s} * (2.0 / {s} + sqrt(1 + 4.0 / ({s} * {s}))))"
    z2 = f"((1 - 2 / (9.0 * {a}) - cbrt((1 - 2.0 / {a}) / (1 + {x} * sqrt(2 / ({a} - 4.0))))) / sqrt(2 / (9.0 * {a})))"
    return f"exp(-({z1} * {z1} + {z2} * {z2}) / 2)"


def residuals(name: str, src: str, keys: str, keep: str, y: str, xs, snapshot: int = 0) -> str:
    """CTEs ``{name}_0 .. {name}``: ``y`` of ``src`` swept of a constant and
    of each regressor in turn (modified Gram-Schmidt with windows over
    ``keys``).  ``y`` ends as the residual, ``y_r`` as the residual after the
    first ``snapshot`` regressors; ``n`` is the group size."""
    over = f"OVER (PARTITION BY {keys})"
    cols = [y, *xs]
    kept = ", ".join(k.split(" AS ")[-1] for k in keep.split(", "))
    out = [f"{name}_0 AS (SELECT {keys}, {keep}, count(*) {over} AS n, CAST(NULL AS DOUBLE) AS y_r, "
           + ", ".join(f"{c} - avg({c}) {over} AS c{j}" for j, c in enumerate(cols)) + f" FROM {src})"]
    for j in range(1, len(cols)):
        left = [0, *range(j + 1, len(cols))]
        before = "c0" if j - 1 == snapshot else "y_r"
        out.append(f"{name}_{j} AS (SELECT {keys}, {kept}, n, {before} AS y_r, "
                   + ", ".join(f"c{k} - c{j} * coalesce(sum(c{k} * c{j}) {over} / nullif(sum(c{j} * c{j}) {over}, 0), 0) AS c{k}" for k in left)
                   + f" FROM {name}_{j - 1})")
    last = len(cols) - 1
    out.append(f"{name} AS (SELECT {keys}, {kept}, n, c0 AS e, {'c0' if snapshot == last else 'y_r'} AS e_r FROM {name}_{last})")
    return ",\n".join(out)
