"""Lemmas of forms that no table lists, by suffix rules learned from a
``(form, lemma)`` table.

A rule says that a form ending in ``suffix`` has the lemma in which that
suffix is replaced by ``ending``.  Every pair of the table teaches one rule
for each of its suffixes from the part that changes up to ``longest``
characters; of the endings seen with a suffix the most frequent one counts.
A form takes the rule of its longest suffix that has one: one equi-join of
its suffixes with the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlex.functions import text as tx
from marketlex.operators import textops

LONGEST = 6              # characters of a suffix
LEAST_PAIRS = 2          # pairs that teach a rule


def common_prefix(a: Column, b: Column) -> Column:
    """Characters at the start that two strings share."""
    most = F.least(F.length(a), F.length(b))
    places = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(n))


def suffix_rules(pairs: DataFrame, longest: int = LONGEST, least_pairs: int = LEAST_PAIRS) -> DataFrame:
    """(suffix, ending, n, share) learned from ``pairs(form, lemma)``, each
    distinct pair once; null and empty forms or lemmas teach nothing.  ``n``
    counts the pairs that agree, ``share`` of those that have the suffix; ties
    go to the first ending by its letters."""
    p = pairs.select("form", "lemma").where("form <> '' and lemma <> ''").distinct()
    p = p.withColumn("same", common_prefix(F.col("form"), F.col("lemma"))).withColumn("n", F.length("form"))
    least = F.greatest(F.col("n") - F.col("same"), F.lit(1))
    most = F.least(F.col("n"), F.lit(longest))
    sizes = F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))
    one = p.select("form", "lemma", "n", F.explode(sizes).alias("k"))
    start = F.col("n") - F.col("k") + 1
    rules = one.select(F.substring("form", start, F.col("k")).alias("suffix"), F.substring("lemma", start, F.length("lemma")).alias("ending"))
    counts = rules.groupBy("suffix", "ending").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("m"), "ending")).alias("b"), F.sum("n").alias("all"))
    return best.select("suffix", "b.ending", (-F.col("b.m")).alias("n"), (-F.col("b.m") / F.col("all")).alias("share")).where(F.col("n") >= least_pairs)


def predict_lemmas(forms: DataFrame, rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(form, lemma, suffix) for each of ``forms(form)`` that ends in a suffix
    of ``rules``: by the longest one, provided something is left of the lemma."""
    f = forms.select("form").where("form <> ''").distinct()
    sizes = F.sequence(F.lit(1), F.least(F.length("form"), F.lit(longest)))
    ends = f.select("form", F.explode(sizes).alias("k")).withColumn("suffix", F.substring("form", F.length("form") - F.col("k") + 1, F.col("k")))
    hits = ends.join(rules.select("suffix", "ending"), "suffix")
    lemma = F.concat(F.substring("form", F.lit(1), F.length("form") - F.col("k")), F.col("ending"))
    hits = hits.withColumn("lemma", lemma).where("lemma <> ''")
    return hits.groupBy("form").agg(F.max(F.struct("k", "lemma", "suffix")).alias("b")).select("form", "b.lemma", "b.suffix")


def lemmatize(df: DataFrame, pairs: DataFrame, text_col: str = "text", longest: int = LONGEST, least_pairs: int = LEAST_PAIRS) -> DataFrame:
    """``df`` with each token of ``text_col`` replaced by the lemma that
    ``pairs(form, lemma)`` lists for its lower form (the first by its letters,
    if several), else, if the token is letters alone, by what the rules
    learned from ``pairs`` say; other tokens stay.  Rejoined by one blank."""
    listed = pairs.where("form <> '' and lemma <> ''").groupBy("form").agg(F.min("lemma").alias("lemma"))
    unseen = (df.select(F.explode(tx.whitespace_tokens(text_col)).alias("t")).select(F.lower("t").alias("form")).distinct()
              .where(F.col("form").rlike(r"^\p{L}+$")).join(listed.select("form"), "form", "left_anti"))
    table = listed.unionByName(predict_lemmas(unseen, suffix_rules(pairs, longest, least_pairs), longest).select("form", "lemma"))
    return textops.dictionary_normalize(df, table.withColumnRenamed("lemma", "replacement"), text_col=text_col, lower=True)
