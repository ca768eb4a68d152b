"""Table-level text operators: variant pipelines, join-based token lookups
(stop words, dictionary normalisation) and fixed-length encoding."""

from __future__ import annotations

from typing import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlex.functions import text as tx
from marketlex.functions.lexicon import MAX_INLINE_LEXICON
from marketlex.operators.ordering import fresh

Step = Callable[[Column], Column]

# Single-step variants, by name, in the order they are reported (fixed
# values: these names and those of the strategies below key stored results).
BASIC_VARIANTS: dict[str, list[Step]] = {
    "No_processing": [],
    "No_processing_emoji": [tx.replace_emoji],
    "No_processing_http": [tx.strip_urls],
    "No_processing_hashtag": [tx.strip_hashtags],
    "No_processing_mention": [tx.strip_mentions],
    "No_processing_cashtag": [tx.strip_cashtags],
    "No_processing__text": [tx.keep_polish_text],
    "No_processing__rep": [tx.collapse_repeats],
    "No_processing_norm": [tx.normalize_whitespace],
    "No_processing_caps": [tx.sentence_case],
    "Basic_processing": [tx.clean_text_basic],
}


def python_step(fn: Callable[[str], str]) -> Step:
    """Wrap a plain ``str -> str`` function as an Arrow-batched step
    (null passes through).  Use only where no built-in expresses it."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def _u(s: pd.Series) -> pd.Series:
        return s.map(lambda v: fn(v) if isinstance(v, str) else v)

    def step(c: Column) -> Column:
        return _u(c)
    from marketlex.sources.sinks import code_digest
    step.code = code_digest(fn)  # tells steps apart in the variant cache
    return step


def apply_steps(col, steps: Sequence[Step]) -> Column:
    """Compose steps left to right."""
    c = F.col(col) if isinstance(col, str) else col
    for s in steps:
        c = s(c)
    return c


def preprocess_variants(df: DataFrame, variants: Mapping[str, Sequence[Step]],
                        id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One scan, one output row per (row, variant):
    ``(id, variant, text)``.  All variants are projected side by side and
    exploded, so the source is read once."""
    arr = F.array(*[F.struct(F.lit(name).alias("variant"), apply_steps(text_col, steps).alias("text"))
                    for name, steps in variants.items()])
    return df.select(id_col, F.inline(arr))


def strategy_variants(corrections: DataFrame | None = None, lemmas: DataFrame | None = None,
                      stopwords: Sequence[str] = (), vocabulary: DataFrame | None = None, learn_lemmas: bool = False) -> dict:
    """The five cumulative strategies as table pipelines ``DataFrame -> DataFrame``
    on ``(id, text)``.  Spelling correction is a lookup in ``corrections(form,
    replacement)``, or by edit distance in ``vocabulary(word, freq)`` where
    that is given (``spelling.correct_spelling``); lemmatisation a lookup in
    ``lemmas(form, replacement)``, with ``learn_lemmas`` also for forms that
    the table lacks (``lemmas.lemmatize``)."""
    def basic(d):
        return d.withColumn("text", tx.clean_text_basic("text"))

    def spell(d):
        if vocabulary is not None:
            from marketlex.operators.spelling import correct_spelling
            return correct_spelling(d, vocabulary)
        return dictionary_normalize(d, corrections) if corrections is not None else d

    def lem(d):
        if learn_lemmas and lemmas is not None:
            from marketlex.operators.lemmas import lemmatize
            return lemmatize(d, lemmas.withColumnRenamed("replacement", "lemma"))
        return dictionary_normalize(d, lemmas) if lemmas is not None else d

    def sp(d):
        return d.withColumn("text", tx.remove_stopwords("text", stopwords))
    return {
        "Basic_processing": [basic],
        "Basic_processing_spelling": [basic, spell],
        "Basic_processing_spelling_lem": [basic, spell, lem],
        "Basic_processing_spelling_SP": [basic, spell, sp],
        "Basic_processing_spelling_lem_SP": [basic, spell, lem, sp],
    }


LOOKUP_ROWS = 100_000    # entries of a table that is shipped to the tasks
Merge = Callable[[list, list], object]


def map_tokens(df: DataFrame, text_col: str, table: DataFrame, merge: Merge, kind: str, out_col: str, lower: bool = False, asked: Column | None = None,
               most: int | None = None, never: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Adds ``out_col`` of type ``kind``, made from the tokens of ``text_col``
    and what ``table(_key, _value)`` holds for them, or for their lower forms
    (``lower``): ``merge`` gets the tokens and their values, None where there
    is none.  Keys are distinct, values not null; a null text gives null.

    A table of up to ``most`` entries (``LOOKUP_ROWS``) is shipped and no row moves.
    From a longer one the tokens are looked up by a join: only the tokens for
    which ``asked``, a condition on ``_key`` and ``_pos``, holds and which are
    not in ``never()``, a short table (_key) of words that ``table`` lacks,
    take part, only those found go on, as (place, value) gathered by a 128-bit
    hash of their text, so that rows with a null or repeated id keep their own
    text."""
    spark = df.sparkSession
    most = LOOKUP_ROWS if most is None else most
    entries = table.select("_key", "_value").limit(most + 1).collect()  # bounded
    lowered = F.lower(text_col) if lower else F.lit(None).cast("string")
    columns = [F.col(f"`{c}`") for c in dict.fromkeys([*df.columns, out_col])]
    if len(entries) <= most:
        shipped = spark.sparkContext.broadcast({r[0]: r[1] for r in entries})

        def made(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            value = shipped.value.get
            for text, low in texts:
                yield pa.array([None if t.as_py() is None else merge(w := t.as_py().split(), list(map(value, lo.as_py().split() if lower else w)))
                                for t, lo in zip(text, low)], ARROW_KINDS[kind])
        return df.withColumn(out_col, F.arrow_udf(made, kind)(F.col(text_col), lowered)).select(*columns)

    h1, h2, hits = fresh("_h1", df), fresh("_h2", df), fresh("_hits", df)
    hashes = F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)
    tokens = tx.whitespace_tokens(F.lower("_text") if lower else "_text")
    hashed = df.select(hashes[0].alias(h1), hashes[1].alias(h2), F.col(text_col).alias("_text"))  # beside posexplode the text would be hashed for each token
    long = hashed.select(h1, h2, F.posexplode(tokens).alias("_pos", "_key"))
    long = long if asked is None else long.where(asked)
    if never is not None:
        long = long.join(F.broadcast(never()), "_key", "left_anti")
    found = long.join(table.select("_key", "_value"), "_key")
    gathered = found.groupBy(h1, h2).agg(F.collect_set(F.struct("_pos", "_value")).alias(hits))  # a set: texts may repeat

    def placed(texts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, places, values in texts:
            out = []
            for t, at, v in zip(text, places, values):
                words = None if t.as_py() is None else t.as_py().split()
                if words is not None:
                    seen = [None] * len(words)
                    for k, x in zip(at.as_py() or (), v.as_py() or ()):
                        seen[k] = x
                    words = merge(words, seen)
                out.append(words)
            yield pa.array(out, ARROW_KINDS[kind])
    keyed = df.withColumn(h1, hashes[0]).withColumn(h2, hashes[1]).join(gathered, [h1, h2], "left")
    return keyed.withColumn(out_col, F.arrow_udf(placed, kind)(F.col(text_col), F.col(f"{hits}._pos"), F.col(f"{hits}._value"))).select(*columns)


ARROW_KINDS = {"string": pa.string(), "array<int>": pa.list_(pa.int32())}


def replaced(tokens: list, values: list) -> str:
    """Tokens with a value replaced by it, joined by one blank."""
    return " ".join([t if v is None else v for t, v in zip(tokens, values)])


def dropped(tokens: list, values: list) -> str:
    """Tokens without a value, joined by one blank."""
    return " ".join([t for t, v in zip(tokens, values) if v is None])


def remove_stopwords_table(df: DataFrame, words: DataFrame, id_col: str = "id",
                           text_col: str = "text", most: int | None = None) -> DataFrame:
    """T13, table form for word lists of any size: tokens whose lower form is
    in ``words(word)`` are dropped, the others rejoined in order.  ``id_col``
    is not read: rows are told apart by their text (see ``map_tokens``, also
    for ``most``)."""
    listed = words.where(F.col("word").isNotNull()).select(F.col("word").alias("_key"), F.lit(True).alias("_value")).distinct()
    return map_tokens(df, text_col, listed, dropped, "string", text_col, lower=True, most=most)


def remove_stopwords(df: DataFrame, words: DataFrame, text_col: str = "text", inline_limit: int = MAX_INLINE_LEXICON) -> DataFrame:
    """T13 for a stop list given as a table: up to ``inline_limit`` words are
    brought into the plan as a literal set (no shuffle of texts), a longer
    list is joined.  Both give the same text."""
    words = words.select("word").where(F.col("word").isNotNull()).distinct()
    listed = words.limit(inline_limit + 1).collect()
    if len(listed) > inline_limit:
        return remove_stopwords_table(df, words, text_col=text_col, most=inline_limit)
    return df.withColumn(text_col, tx.remove_stopwords(text_col, [r[0] for r in listed]))


def dictionary_normalize(df: DataFrame, table: DataFrame, id_col: str = "id",
                         text_col: str = "text", lower: bool = False) -> DataFrame:
    """Replace each whitespace token found in ``table(form, replacement)``
    (lemmatisation / spelling correction as a lookup), rejoin by one blank.  A
    form listed more than once has its smallest replacement; a null form or
    replacement replaces nothing.  ``id_col`` is not read."""
    t = table.where(F.col("form").isNotNull() & F.col("replacement").isNotNull()).groupBy(F.col("form").alias("_key")).agg(F.min("replacement").alias("_value"))
    return map_tokens(df, text_col, t, replaced, "string", text_col, lower)


def build_vocabulary(df: DataFrame, text_col: str = "text", reserved: int = 2) -> DataFrame:
    """Vocabulary ``(token, id)`` by descending frequency (ties by token);
    ids start after ``reserved`` (0 = pad, 1 = unknown).  Positions come from
    per-(count, first four characters) bucket offsets, not one global
    window: tokens seen once, the bulk of a vocabulary, spread over as many
    buckets as they have beginnings."""
    from marketlex.operators.ordering import global_row_number
    counts = (df.select(F.explode(tx.whitespace_tokens(text_col)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))
    # bucket monotone in (freq desc, token asc)
    bucket = F.struct((-F.col("freq")).alias("f"), F.substring("token", 1, 4).alias("c"))
    numbered = global_row_number(counts, [F.col("freq").desc(), F.col("token")], bucket, "rank")
    return numbered.select("token", (F.col("rank") + reserved - 1).cast("int").alias("token_id"), "freq")


def top_tokens(df: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """The ``n`` most frequent tokens (ties by token), numbered from 0:
    ``(token, place)``.  Only they are numbered, not the whole vocabulary."""
    counts = (df.select(F.explode(tx.whitespace_tokens(text_col)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))
    top = counts.orderBy(F.col("freq").desc(), "token").limit(n)
    place = F.row_number().over(Window.orderBy(F.col("freq").desc(), "token")) - 1  # n rows
    return top.select("token", place.cast("int").alias("place"))


def encode_fixed_length(df: DataFrame, vocab: DataFrame, id_col: str = "id",
                        text_col: str = "text", max_length: int = 128,
                        unknown_id: int = 1, pad_id: int = 0) -> DataFrame:
    """Token ids truncated / padded to ``max_length`` plus attention mask,
    in place of the text.  A null text is all padding; a token listed more
    than once has its smallest id; ``id_col`` is not read."""
    v = (vocab.where(F.col("token").isNotNull() & F.col("token_id").isNotNull()).groupBy(F.col("token").alias("_key"))
         .agg(F.min("token_id").cast("int").alias("_value")))

    def first(tokens, values):
        return [unknown_id if x is None else x for x in values[:max_length]]
    none = F.array().cast("array<int>")
    ids = fresh("_ids", df)
    out = map_tokens(df, text_col, v, first, "array<int>", ids, asked=F.col("_pos") < max_length)
    raw = F.coalesce(ids, none)
    n = F.size(raw)
    padded = F.slice(F.concat(raw, F.array_repeat(F.lit(pad_id), max_length)), 1, max_length)
    mask = F.transform(F.sequence(F.lit(1), F.lit(max_length)), lambda i: F.when(i <= n, 1).otherwise(0))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in (text_col, "input_ids", "attention_mask")],
                      padded.alias("input_ids"), mask.alias("attention_mask"))
