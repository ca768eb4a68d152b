"""Lexicons: small fixed tables plus loaders for user-supplied ones.

Large lexicons (the 759-entry emoji table, the 325-word stop list) are
*parameters*: load them from a two-column file with :func:`load_pairs` or a
one-word-per-line file with :func:`load_words`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# ASCII emoticons and HTML-entity fragments, in the order they
# must be applied (earlier keys win; ``>:)`` and ``>:(`` can never match
# because ``:)`` and ``:(`` come first -- that order is the contract).
EMOTICONS = (
    (";(", "płaczący"),
    (":)", "radosny"),
    (":D", "roześmiany"),
    (":(", "smutny"),
    (":P", "żartobliwy"),
    (";)", "puszczający-oko"),
    (":*", "całujący"),
    (":O", "zaskoczony"),
    (":-|", "obojętny"),
    (">:(", "wściekły"),
    (":3", "uroczy"),
    ("XD", "rozbawiony"),
    (":|", "niewzruszony"),
    (":/)", "sceptyczny"),
    ("^^", "zadowolony"),
    (":/", "zakłopotany"),
    (">:)", "złośliwy"),
    (":'(", "zapłakany"),
    (":S", "zmieszany"),
    ("---", "znudzony"),
    ("&lt", "mniejsze-od"),
    ("&gt", "większe-od"),
    ("&le", "mniejsze-od"),
    ("&ge", "większe-od"),
)
# ---------------------------------------------------------------------------

# Entries that may be brought to the driver (a parameter of the two loaders
# below): each is part of every task's plan.  Longer word lists use the join
# form, ``textops.remove_stopwords_table``.
MAX_INLINE_LEXICON = 100_000

PAIR_SCHEMA = T.StructType([
    T.StructField("ord", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("replacement", T.StringType()),
])


def load_pairs(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Read ``ord<sep>key<sep>replacement`` files as a lexicon table.  The
    order of application is the contract, so it is a column: lines of several
    files or splits have no order of their own."""
    return spark.read.option("sep", sep).option("quote", "\u0000").schema(PAIR_SCHEMA).csv(path)


def load_words(spark: SparkSession, path: str) -> DataFrame:
    """Read a one-word-per-line file as ``(word)``; blank lines dropped."""
    return (spark.read.text(path).select(F.trim("value").alias("word"))
            .filter(F.col("word") != "").distinct())


def pairs_from_table(df: DataFrame, limit: int = MAX_INLINE_LEXICON) -> list[tuple[str, str]]:
    """Bring a lexicon table to the driver as ordered pairs, after checking
    its size: a lexicon is a bounded lookup table, not data."""
    n = df.count()
    if n > limit:
        raise ValueError(f"lexicon has {n} entries (> {limit}); it is not a lookup table")
    rows = df.orderBy("ord").select("key", "replacement").collect()
    return [(r["key"], r["replacement"]) for r in rows]


def words_from_table(df: DataFrame, limit: int = MAX_INLINE_LEXICON) -> list[str]:
    n = df.count()
    if n > limit:
        raise ValueError(f"word list has {n} entries (> {limit}); use the join form")
    return [r[0] for r in df.select("word").collect()]
