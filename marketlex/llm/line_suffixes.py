"""Repeated runs of lines, by a suffix array over line-id sequences.

Every non-blank line is a symbol; a document is a sequence of symbols.  Lines
that occur once end every match, so only the others take part.  *Distributed
prefix doubling* ranks the suffixes by their first 1, 2, 4, ... lines: the
rank of a suffix is its place in the suffix array of that depth (suffixes
with equal prefixes share the place), and a round refines a rank by the rank
found ``k`` lines later.  Suffixes whose prefix is unique leave the rounds.

Suffixes that share their first ``l`` lines form an interval of the suffix
array with longest common prefix >= ``l``; two overlapping power-of-two ranks
name it.  A run counts from ``min_words`` words on.  For every line the
shortest run of that size that starts there and the shortest that ends there
are looked up: together they cover every maximal repeated run.  In each
interval the earliest run (smallest doc_id, then line) stays; the lines of
the later ones are deleted, except where one overlaps the earliest itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlex.llm.base import fresh, join_split, stored
from marketlex.operators.ordering import global_row_number, hash_bucket

MIN_WORDS = 50


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, seq, words, h1, h2): the non-blank lines of every
    document with their line number and their place among them; ``th`` tells
    apart rows that repeat a doc_id, and rows that repeat both doc_id and
    text are one document."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.trim(F.regexp_replace(x, r"\s+", " ")).alias("line")))
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.filter(numbered, lambda e: e["line"] != "")).alias("seq", "e"))
    return lines.select("doc_id", "th", F.col("e.pos").alias("pos"), "seq", F.size(F.split("e.line", " ")).alias("words"),
                        F.xxhash64("e.line").alias("h1"), F.xxhash64(F.lit(1), "e.line").alias("h2"))


def suffix_ranks(docs: DataFrame, min_words: int) -> tuple[DataFrame, int]:
    """(doc_id, th, pos, seq, words, depth, r): the suffix-array rank of each
    line that occurs more than once, a row for each depth 1, 2, 4, ... lines
    (numbered 0, 1, 2, ...) at which its prefix is not unique; and the number
    of depths: the last one reaches ``min_words`` lines, as no counted run
    needs more."""
    lines = line_table(docs)
    again = docs.groupBy("doc_id", F.xxhash64("text").alias("th")).count().where("count > 1")
    if again.head(1):
        lines = lines.dropDuplicates(["doc_id", "th", "seq"])

    lines = stored(lines, "line-table")
    place = ["doc_id", "th", "pos", "seq", "words"]
    symbols = lines.groupBy("h1", "h2").count().where("count > 1")
    first = stored(global_row_number(symbols, ["h1", "h2"], hash_bucket(F.col("h1")), "r").select("h1", "h2", "r", "count"), "line-symbols")

    def with_next(t, k):
        """Adds the rank of the suffix ``k`` lines later, null if unique."""
        later = Window.partitionBy("doc_id", "th").orderBy("seq").rangeBetween(k, k)
        return stored(t.withColumn("next", F.first("r").over(later)), "line-ranks")

    t = with_next(join_split(lines, first, ["h1", "h2"], "count").select(*place, "r"), 1)
    levels, k = [t], 1
    while 2 * k <= min_words:
        # a suffix goes on while the one k lines later is not unique either
        pairs = t.where("next is not null")
        names = pairs.groupBy("r", "next").count().where("count > 1")
        top = pairs.agg(F.max("r").alias("top")).first().top
        if top is None:
            break
        # order of (rank, rank k lines later): the suffix array at twice the depth
        dense = global_row_number(names, ["r", "next"], F.floor(F.col("r") / F.lit(max(1, -(-top // 4096)))), "s").select("r", "next", "s")
        t = with_next(pairs.join(dense, ["r", "next"]).select(*place, F.col("s").alias("r")), 2 * k)
        if not t.head(1):
            break
        levels, k = [*levels, t], 2 * k
    levels = [level.drop("next") for level in levels]
    out = levels[0].withColumn("depth", F.lit(0))
    for d, level in enumerate(levels[1:], 1):
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    return out, len(levels)


RUNS = "doc_id long, th long, pos int, last int, seq int, len int, a long, b long"


def counted_runs(ranks: DataFrame, depth: int, min_words: int) -> DataFrame:
    """The shortest runs of ``min_words`` words from and up to each line:
    (doc_id, th, pos, last, seq, len, a, b); (len, a, b) names the interval."""

    def run(batches):
        held = None
        for b in batches:
            t = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            doc, th = np.array(t.column("doc_id").fill_null(np.iinfo(np.int64).min)), np.array(t.column("th"))
            # the last document may go on in the next batch
            change = np.flatnonzero((doc[1:] != doc[:-1]) | (th[1:] != th[:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield from windows(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from windows(held)

    def windows(t):
        # rows of one line follow one another, the first is of depth 0
        level, rank = np.array(t.column("depth")), np.array(t.column("r"))
        line = np.cumsum(level == 0) - 1
        t = t.take(pa.array(np.flatnonzero(level == 0)))
        n = t.num_rows
        r = np.zeros((depth, n), np.int64)
        r[level, line] = rank
        doc, th, pos, words = (t.column(c) for c in ("doc_id", "th", "pos", "words"))
        d, h, p, w = np.array(doc.fill_null(np.iinfo(np.int64).min)), np.array(th), np.array(pos).astype(np.int64), np.array(words).astype(np.int64)
        order = np.array(t.column("seq")).astype(np.int64)
        joined = np.concatenate(([False], (d[1:] == d[:-1]) & (h[1:] == h[:-1]) & (order[1:] == order[:-1] + 1)))
        segment = np.cumsum(~joined)
        ends = np.cumsum(w)
        starts = ends - w
        at = np.arange(n)
        last = np.searchsorted(ends, starts + min_words)             # shortest run from each line
        begin = np.searchsorted(starts, ends - min_words, "right") - 1  # shortest run up to each line
        lo = np.concatenate((at, np.maximum(begin, 0)))
        hi = np.concatenate((np.minimum(last, n - 1), at))
        ok = np.concatenate((last < n, begin >= 0)) & (segment[lo] == segment[hi])
        lo, hi = lo[ok], hi[ok]
        if not len(lo):
            return
        both = np.unique(lo * n + hi)
        lo, hi = both // n, both % n
        length = hi - lo + 1
        level = np.floor(np.log2(length)).astype(np.int64)
        known = level < depth
        lo, hi, length, level = lo[known], hi[known], length[known], level[known]
        a, b = r[level, lo], r[level, hi + 1 - (1 << level)]
        keep = (a > 0) & (b > 0)
        lo, hi, length = lo[keep], hi[keep], length[keep]
        yield pa.RecordBatch.from_pydict({
            "doc_id": doc.take(pa.array(lo)), "th": th.take(pa.array(lo)), "pos": pa.array(p[lo].astype(np.int32)),
            "last": pa.array(p[hi].astype(np.int32)), "seq": pa.array(order[lo].astype(np.int32)), "len": pa.array(length.astype(np.int32)), "a": pa.array(a[keep]), "b": pa.array(b[keep])})

    dealt = ranks.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", "seq", "depth")
    return dealt.mapInArrow(run, RUNS)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, spans): for each document with later copies of repeated
    runs, the spans [first, last] of lines to delete, disjoint and sorted."""
    ranks, depth = suffix_ranks(docs, min_words)
    runs = stored(counted_runs(ranks, depth, min_words), "line-runs")
    place = F.struct("doc_id", "th", "pos", "last")
    intervals = runs.groupBy("len", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = (join_split(runs, stored(intervals, "line-intervals"), ["len", "a", "b"], "n").drop("n")
             .where(~((F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.th") == F.col("th")) & (F.col("first.last") >= F.col("pos"))))
             .select("doc_id", "th", "pos", "last", "seq", "len").distinct())
    # merge overlapping and touching runs of a document (blank lines between them do not count)
    by_doc = Window.partitionBy("doc_id", "th").orderBy("seq", "len")
    reach = F.max(F.col("seq") + F.col("len")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = (later.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("seq")).cast("int"))
             .withColumn("span", F.sum("new").over(by_doc)).groupBy("doc_id", "th", "span")
             .agg(F.min("pos").alias("first"), F.max("last").alias("last")))
    return spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from
    ``text``, plus (n_lines, n_removed, removed): line counts and the deleted
    spans [first, last] of line numbers from 0; blank lines between deleted
    lines go with them.

    A null text stays null and an empty one empty (0 and 1 lines); an empty
    table gives an empty table; rows that repeat doc_id and text are one
    document and get the same result.  Line identity ignores the amount of
    white space; other columns pass through, but those that have the name of
    one of the three result columns are replaced."""
    out, spans = with_spans(docs, min_words)
    none = F.array().cast(SPANS)
    removed = F.aggregate(F.coalesce(spans, none), F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1)
    cols = [rest_of_text(spans).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "removed")]
    return out.select(*cols, F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"), removed.alias("n_removed"), F.coalesce(spans, none).alias("removed"))


SPANS = "array<struct<first:int,last:int>>"


def with_spans(docs: DataFrame, min_words: int) -> tuple[DataFrame, str]:
    """``docs`` with the spans of lines to delete (null: none) in a column of
    a name that ``docs`` does not have, and that name."""
    doc, th, spans = (fresh(f"__run_{c}", docs) for c in ("doc", "th", "spans"))
    found = repeated_lines(docs.select("doc_id", "text"), min_words).select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("spans").alias(spans))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left").drop(doc, th), spans


def rest_of_text(spans: str) -> Column:
    """``text`` without the lines in ``spans``."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.filter(numbered, lambda e: ~F.exists(spans, lambda s: e["i"].between(s["first"], s["last"])))
    return F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda e: e["x"]), "\n"))


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated line runs deleted; a document of which nothing
    but blank lines is left goes, ``n_chars`` follows the text where it is a
    number.  Other columns stay, whatever their names."""
    out, spans = with_spans(docs, min_words)
    out = out.withColumn("text", rest_of_text(spans)).where(F.col(spans).isNull() | F.col("text").rlike(r"\S"))
    types = dict(docs.dtypes)
    return out.select(*[F.when(F.col(spans).isNotNull(), F.length("text").cast(types[c])).otherwise(F.col(c)).alias(c)
                        if c == "n_chars" and types[c] in ("int", "bigint") else F.col(f"`{c}`") for c in docs.columns])
