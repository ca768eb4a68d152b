"""Secret scan: three patterns, and a battery of randomness tests for
secrets that no pattern knows.

Base kinds are found by pattern.  Every other long token of key characters
gets its encoding inferred (the smallest usual alphabet that holds it) and is
tested three ways against a uniform draw from that alphabet: chi-squared of
the symbol counts, runs of symbol classes, and lag-one serial correlation of
the symbol values.  A token is a secret if the battery does not reject
randomness and the same statistics are too unlikely under ordinary text; the
latter p-values go through Benjamini-Hochberg within bands of token length,
so a short token, on which the tests have little power, needs no less
evidence than a long one.

DataFrame functions only.  Rows of work are matches, not characters: a
document with very many matches is spread by the window over its own matches
and never held as one value until its result is put together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlex.llm.base import stored

# Base patterns (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

# Tokens that the battery looks at.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"

# Alphabets, the smallest first (fixed values).
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "decimal": DIGITS,
    "hex": DIGITS + LOWER[:6],
    "hex_upper": DIGITS + UPPER[:6],
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "base36_upper": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": UPPER + LOWER + DIGITS,
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "base64": UPPER + LOWER + DIGITS + "+/",
    "key": UPPER + LOWER + DIGITS + "+/-_",
}
CLASSES = ((DIGITS, 1), (LOWER, 2), (UPPER, 3), ("+/-_", 4))

TEXT_REPEAT = 0.066     # chance that two letters of ordinary text agree
TEXT_CHANGE = 0.12      # chance that neighbours of ordinary text change class
REJECT = 0.003          # battery level at which a token is not random
FDR = 0.01
MIN_BITS = 48           # information a secret must hold if it is random
BIN = 0.25              # width of a bin of -log10 p


def row_key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("th")]


def matches(docs: DataFrame, kind: str, pattern: str, value_group: int = 0) -> DataFrame:
    """(doc_id, th, kind, start, end, token) of the leftmost non-overlapping
    matches; ``token`` is the value group.  Places are the running lengths of
    the stretches between matches and of the matches, in code points."""
    hit = docs.where(F.col("text").rlike(pattern))
    regex = F.lit(pattern)
    found = hit.select(*row_key(docs), F.posexplode(F.arrays_zip(
        F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", regex, F.lit(0)).alias("whole"),
        F.regexp_extract_all("text", regex, F.lit(value_group)).alias("token"))).alias("k", "m"))
    found = found.dropDuplicates(["doc_id", "th", "k"])  # rows that repeat
    before = Window.partitionBy("doc_id", "th").orderBy("k")
    step = F.length("m.gap") + F.coalesce(F.length("m.whole"), F.lit(0))
    found = found.withColumn("end", F.sum(step).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return (found.where("m.whole is not null")
            .select("doc_id", "th", F.lit(kind).alias("kind"), (F.col("end") - F.length("m.whole")).alias("start"), "end", F.col("m.token").alias("token")))


def base_matches(docs: DataFrame) -> DataFrame:
    return (matches(docs, "assign", ASSIGN, 2).where(F.length("token") >= 12)
            .union(matches(docs, "access", ACCESS).where(F.length("token") >= 18))
            .union(matches(docs, "hex", HEX)).drop("token"))


# ---- the battery -----------------------------------------------------------

def upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z), Bryc's (2002) rational approximation (within 3 % of
    the value over the whole range)."""
    a = F.abs(z)
    s = math.sqrt(2 * math.pi)
    q = (((4 - math.pi) * a + s * (math.pi - 2)) / ((4 - math.pi) * s * a * a + 2 * math.pi * a + 2 * s * (math.pi - 2))) * F.exp(-a * a / 2)
    return F.when(z >= 0, q).otherwise(1 - q)


def alphabet_of(body: Column) -> Column:
    """Name of the smallest alphabet that holds the token."""
    out = F.lit("key")
    for name, chars in reversed(ALPHABETS.items()):
        cls = chars.replace("-", r"\-")
        out = F.when(body.rlike(f"^[{cls}]+$"), F.lit(name)).otherwise(out)
    return out


def class_change(chars: str) -> float:
    """Chance that two uniform draws differ in class."""
    return 1 - sum((sum(c in part for c in chars) / len(chars)) ** 2 for part, _ in CLASSES)


def by_alphabet(values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("alphabet"))


def battery(tokens: DataFrame) -> DataFrame:
    """Adds (alphabet, n, p_random, p_text, bits) to ``tokens(token)``.

    ``p_random``: three times the least p-value of the three tests of
    uniformity (upper chi-squared tail, two-sided runs and correlation).
    ``p_text``: chance that ordinary text looks as random as the token,
    from the chi-squared statistic (which for text grows with the length) and
    the class runs together."""
    t = tokens.withColumn("body", F.regexp_replace("token", "=+$", "")).withColumn("alphabet", alphabet_of(F.col("body")))
    t = t.withColumn("symbols", by_alphabet(ALPHABETS)).withColumn("size", F.length("symbols").cast("double"))
    t = t.withColumn("chars", F.split("body", "(?!$)")).withColumn("n", F.size("chars").cast("double"))
    t = t.withColumn("value", F.transform("chars", lambda c: F.position(c, F.col("symbols")).cast("double")))
    t = t.withColumn("class", F.translate("body", "".join(c for c, _ in CLASSES), "".join(str(k) * len(c) for c, k in CLASSES)))
    # chi-squared: symbol counts
    squares = F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter("chars", lambda x: x == c)), F.lit(2.0)))
    t = t.withColumn("chi", F.col("size") / F.col("n") * squares - F.col("n"))
    df = F.col("size") - 1
    chi_z = (F.col("chi") - df) / F.sqrt(2 * df * (1 - 1 / F.col("n")))
    # runs: changes of class between neighbours
    steps = F.col("n") - 1
    classes = F.split("class", "(?!$)")
    changes = F.aggregate(F.zip_with(F.slice(classes, 1, steps.cast("int")), F.slice(classes, 2, steps.cast("int")), lambda a, b: (a != b).cast("double")),
                          F.lit(0.0), lambda acc, x: acc + x)
    t = t.withColumn("changes", changes).withColumn("p_change", by_alphabet({k: class_change(v) for k, v in ALPHABETS.items()}))
    run_z = F.when(F.col("p_change") > 0, (F.col("changes") - steps * F.col("p_change")) / F.sqrt(steps * F.col("p_change") * (1 - F.col("p_change")))).otherwise(0.0)
    # serial correlation of symbol values at lag one
    total = F.aggregate("value", F.lit(0.0), lambda acc, x: acc + x)
    t = t.withColumn("mean", total / F.col("n"))
    spread = F.aggregate("value", F.lit(0.0), lambda acc, x: acc + (x - F.col("mean")) * (x - F.col("mean")))
    lagged = F.aggregate(F.zip_with(F.slice("value", 1, steps.cast("int")), F.slice("value", 2, steps.cast("int")),
                                    lambda a, b: (a - F.col("mean")) * (b - F.col("mean"))), F.lit(0.0), lambda acc, x: acc + x)
    t = t.withColumn("spread", spread)
    serial_z = F.when(F.col("spread") > 0, (lagged / F.col("spread") + 1 / F.col("n")) * F.sqrt(F.col("n"))).otherwise(F.sqrt("n"))
    p_random = F.least(F.lit(1.0), 3 * F.least(upper_tail(chi_z), 2 * upper_tail(F.abs(run_z)), 2 * upper_tail(F.abs(serial_z))))
    # the same statistics under ordinary text
    excess = F.col("n") * F.greatest(F.col("size") * TEXT_REPEAT - 1, F.lit(0.05))
    text_chi = (df + excess - F.col("chi")) / F.sqrt(2 * (df + 2 * excess))
    text_run = F.when(F.col("p_change") > 0, (F.col("changes") - steps * TEXT_CHANGE) / F.sqrt(steps * TEXT_CHANGE * (1 - TEXT_CHANGE))).otherwise(0.0)
    p_text = upper_tail((text_chi + text_run) / math.sqrt(2))
    return (t.withColumn("p_random", p_random).withColumn("p_text", p_text).withColumn("bits", F.col("n") * F.log2("size"))
            .drop("body", "symbols", "chars", "value", "class", "mean", "spread", "p_change"))


def discoveries(tested: DataFrame) -> DataFrame:
    """Rows of ``tested`` that the false-discovery control keeps.

    Benjamini-Hochberg within bands of token length (powers of two): p-values
    are counted in bins of ``-log10 p``, and a band's cut is its lowest bin
    whose worst p-value times the number of tests is at most ``FDR`` times
    the number of p-values down to it."""
    t = (tested.withColumn("band", F.floor(F.log2("n")))
         .withColumn("bin", F.floor(F.least(-F.log10(F.greatest("p_text", F.lit(1e-60))), F.lit(60.0)) / BIN)))
    counts = t.groupBy("band", "bin").count()
    rank = F.sum("count").over(Window.partitionBy("band").orderBy(F.desc("bin")))
    every = F.sum("count").over(Window.partitionBy("band"))
    cut = (counts.withColumn("rank", rank).withColumn("m", every)
           .where(F.pow(F.lit(10.0), -F.col("bin") * BIN) * F.col("m") <= FDR * F.col("rank"))
           .groupBy("band").agg(F.min("bin").alias("cut")))
    return (t.join(F.broadcast(cut), "band")  # at most one row per power of two
            .where((F.col("bin") >= F.col("cut")) & (F.col("p_random") >= REJECT) & (F.col("bits") >= MIN_BITS)))


def random_tokens(docs: DataFrame) -> DataFrame:
    """Spans of kind ``random``: (doc_id, th, kind, start, end)."""
    tested = battery(matches(docs, "random", CANDIDATE))
    tested = stored(tested.select("doc_id", "th", "kind", "start", "end", "n", "p_random", "p_text", "bits"), "secret-tests")
    return discoveries(tested).select("doc_id", "th", "kind", "start", "end")


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: (doc_id, n_assign, n_access,
    n_hex, n_random, base_sha256, spans).

    Null and empty texts have no spans (counts 0, the digest of the empty
    string, an empty list).  Spans of kind ``random`` that overlap a base
    span are dropped; base spans of different kinds may overlap.  Rows that
    repeat doc_id and text get the same result."""
    docs = docs.select("doc_id", "text")
    spans = base_matches(docs).union(random_tokens(docs))
    order = F.create_map(*[F.lit(x) for k, v in enumerate(KINDS) for x in (v, k)])
    one = F.struct(F.col("start").alias("start"), F.element_at(order, F.col("kind")).alias("k"), F.col("end").alias("end"), "kind")
    per_doc = spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(one)).alias("all"))  # spans of one document
    is_base = F.filter("all", lambda s: s["k"] < 3)
    per_doc = per_doc.withColumn("base", is_base).withColumn("all", F.filter("all", lambda s: (s["k"] < 3) | ~F.exists(
        "base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))

    def listed(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")

    found = per_doc.select("doc_id", "th", *[number(k).alias(f"n_{k}") for k in KINDS], listed("base").alias("base"), listed("all").alias("spans"))
    found = found.withColumnsRenamed({"doc_id": "found_doc", "th": "found_th"})
    out = docs.select(*row_key(docs)).join(found, F.col("doc_id").eqNullSafe(F.col("found_doc")) & (F.col("th") == F.col("found_th")), "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
