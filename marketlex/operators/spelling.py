"""Spelling correction against a vocabulary with frequencies.

Two words within ``distance`` edits of each other have a common string after
deleting at most ``distance`` characters from the first ``prefix`` characters
of each (symmetric deletes), so candidates come from an equi-join of those
strings: at most 1 + p + p (p - 1) / 2 per word for two edits and a prefix of
p, whatever the word's length.  The true distance is computed for candidates
alone.  Only distinct unknown tokens take part, not their occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlex.functions import text as tx
from marketlex.operators import textops
from marketlex.session import materialize

WORD_PATTERN = r"^\p{L}+$"
DISTANCE, PREFIX = 2, 10
LEAST_LENGTH = 4         # shorter words are within two edits of too many
SHIPPED_LETTERS = 40     # longer words of the vocabulary are not shipped


def word_counts(df: DataFrame, text_col: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, freq): lower-cased tokens of letters alone, of ``least_length``
    letters or more."""
    words = df.select(F.explode(tx.whitespace_tokens(text_col)).alias("t")).select(F.lower("t").alias("word"))
    return words.where((F.length("word") >= least_length) & F.col("word").rlike(WORD_PATTERN)).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def deletes(word: Column, distance: int = DISTANCE, prefix: int = PREFIX) -> Column:
    """Distinct strings left of the word's first ``prefix`` characters after
    deleting up to ``distance`` of them."""
    head = F.substring(word, 1, prefix)
    out = F.array(head)
    step = out
    for _ in range(distance):
        shorter = F.transform(step, lambda w: F.transform(
            F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>")),
            lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(prefix)))))
        step = F.array_distinct(F.flatten(shorter))
        out = F.array_union(out, step)
    return out


def with_deletes(words: DataFrame, distance: int = DISTANCE, prefix: int = PREFIX) -> DataFrame:
    """``words(word, ...)`` with a row for each of the ``deletes`` of the word,
    ``d``: a place to delete or none (0) is drawn in each of ``distance``
    steps, from left to right, of equal letters side by side the first ones.
    Rows instead of an array, as compiled code makes them; a few come twice."""
    kept = [F.col(f"`{c}`") for c in words.columns]
    rows = words.select(*kept, F.substring("word", 1, prefix).alias("d"), F.lit(1).alias("_from"))
    at, none = F.col("_at"), F.array(F.lit(0))
    for _ in range(distance):
        places = F.when(F.length("d") >= F.col("_from"), F.concat(none, F.sequence("_from", F.length("d")))).otherwise(none)
        rows = rows.select(*kept, "d", "_from", F.explode(places).alias("_at"))
        rows = rows.where((at == 0) | (at == F.col("_from")) | (F.substring("d", at, F.lit(1)) != F.substring("d", at - 1, F.lit(1))))
        shorter = F.concat(F.substring("d", F.lit(1), at - 1), F.substring("d", at + 1, F.lit(prefix)))
        rows = rows.select(*kept, F.when(at == 0, F.col("d")).otherwise(shorter).alias("d"), F.when(at == 0, F.lit(prefix + 1)).otherwise(at).alias("_from"))
    return rows.drop("_from")


def corrections(unknown: DataFrame, vocabulary: DataFrame, distance: int = DISTANCE, prefix: int = PREFIX) -> DataFrame:
    """(form, replacement, distance) for each of ``unknown(word)`` that has a
    word of ``vocabulary(word, freq)`` within ``distance`` edits: the nearest,
    then the most frequent, then the first by its letters.  A word listed more
    than once has its greatest frequency; a word that is in the vocabulary is
    its own.

    The strings are joined by a 32-bit hash: pairs that only share the hash
    fall out by their true distance.  Spark takes the exploded strings for as
    small as the words they come from and would send them all to the driver to
    broadcast them, hence the merge join."""
    words = vocabulary.where(F.col("word").isNotNull()).groupBy("word").agg(F.max("freq").alias("freq"))
    asked = unknown.select("word").where(F.col("word").isNotNull()).distinct()
    # in order, as like rows side by side take less room in the shuffle
    left = with_deletes(asked.sortWithinPartitions("word"), distance, prefix).select(F.col("word").alias("form"), F.hash("d").alias("d"))
    right = with_deletes(words, distance, prefix).select(F.col("word").alias("replacement"), "freq", F.hash("d").alias("d"))
    near = F.abs(F.length("form") - F.length("replacement")) <= distance
    pairs = left.join(right.hint("merge"), "d").where(near).select("form", "replacement", "freq").distinct()
    found = pairs.withColumn("distance", F.levenshtein("form", "replacement", distance)).where(F.col("distance") >= 0)
    best = F.min(F.struct("distance", (-F.col("freq")).alias("f"), "replacement")).alias("b")
    return found.groupBy("form").agg(best).select("form", "b.replacement", "b.distance")


def frequent(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, most: int | None = None) -> DataFrame:
    """(_key): the most frequent words of ``vocabulary(word, freq)``, ``most``
    rows (``textops.LOOKUP_ROWS``) at most and short enough to be shipped:
    whole classes of similar frequency, none if the first one is too large."""
    most = textops.LOOKUP_ROWS if most is None else most
    level = F.floor(F.log2("freq") * 8)
    words = vocabulary.select(F.col("word").alias("_key"), level.alias("l")).where((F.col("freq") > 0) & F.length("word").between(least_length, SHIPPED_LETTERS))
    least, n = None, 0
    for r in sorted(words.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # at most eight rows per power of two
        n += r.n
        if n > most:
            break
        least = r.l
    return words.where(F.lit(False) if least is None else F.col("l") >= least).select("_key")


def correct_spelling(df: DataFrame, vocabulary: DataFrame, text_col: str = "text", distance: int = DISTANCE, prefix: int = PREFIX,
                     least_length: int = LEAST_LENGTH, words: DataFrame | None = None) -> DataFrame:
    """``df`` with every token of ``text_col`` that is a word of
    ``least_length`` letters or more, is not in ``vocabulary(word, freq)`` in
    lower case, and has a correction, replaced by it; a capital first letter
    is kept.  Tokens are rejoined by one blank; a null text stays null.
    ``words``: the ``word_counts`` of ``df``, if they are stored already;
    ``vocabulary`` is read several times."""
    words = word_counts(df, text_col, least_length) if words is None else words
    unknown = words.select("word").join(vocabulary.select("word").hint("merge"), "word", "left_anti")
    fixed = corrections(unknown, vocabulary, distance, prefix)
    table = materialize(fixed.select(F.col("form").alias("_key"), F.col("replacement").alias("_value")))

    def cased(tokens, values):
        out = list(tokens)
        for k, v in enumerate(values):
            if v is not None:
                out[k] = v[:1].upper() + v[1:] if tokens[k][0] != tokens[k][0].lower() else v
        return " ".join(out)
    word = (F.length("_key") >= least_length) & F.col("_key").rlike(WORD_PATTERN)
    # merge: stored, the table is far smaller than in the driver's memory
    return textops.map_tokens(df, text_col, table.hint("merge"), cased, "string", text_col, lower=True, asked=word,
                              never=lambda: frequent(vocabulary, least_length))
