"""Periodic runs of words, by a dictionary of basic factors.

Every factor of ``2 ** k`` words gets a number (equal factors, equal numbers)
from the numbers of its two halves.  A factor whose next equal copy starts
``q`` words later, at most twice its length away, proposes the period ``q``;
neighbouring places that propose the same ``q`` are one arithmetic
progression of copies, hence a stretch of period ``q``.  Stretches long enough
are extended to both sides by comparing factors, longest first, and found
stretches are one run whichever factor length proposed them.

A run has at least four periods, so factors of the least power of two that is
no shorter than ``q`` lie in it at more than ``q`` neighbouring places, and
each one's next copy is ``q`` away: a nearer copy would overlap it by a whole
period and give the run a smaller period.  So every run is proposed, with its
smallest period.  A factor that occurs once is part of no longer factor that
occurs twice, so it leaves the dictionary; most texts leave it early.

Texts are worked on in blocks of about ``BLOCK_WORDS`` words.  Words of
different texts have different numbers, so no factor is found across texts;
one text is never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

LEAST_WORDS, LEAST_PERIODS = 6, 4
BLOCK_WORDS = 100_000
OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Level:
    """Places whose factor of one length occurs more than once, ascending,
    and the factor's number."""

    def __init__(self, length: int, at: np.ndarray, name: np.ndarray):
        self.length, self.at, self.name = length, at, name

    def names(self, places: np.ndarray) -> np.ndarray:
        """Numbers at places; -1 where the factor occurs once."""
        if not len(self.at):
            return np.full(len(places), -1, np.int64)
        k = np.minimum(np.searchsorted(self.at, places), len(self.at) - 1)
        return np.where(self.at[k] == places, self.name[k], -1)


def repeated(length: int, at: np.ndarray, key: np.ndarray) -> tuple[Level, np.ndarray]:
    """The level of the places ``at`` whose ``key`` recurs, and the distance
    of each to the next place with its key (0: none)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, bool)   # same[j]: sorted place j equals the one before
    same[1:-1] = k[1:] == k[:-1]
    number = np.cumsum(~same[:-1])
    step = np.zeros(len(k), np.int64)
    step[:-1] = np.where(same[1:-1], at[order[1:]] - at[order[:-1]], 0)
    keep = same[:-1] | same[1:]
    back = np.sort(order[keep])
    name, dist = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    name[order], dist[order] = number, step
    return Level(length, at[back], name[back]), dist[back]


def proposals(level: Level, dist: np.ndarray, least_words: int, least_periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the stretches that neighbouring places with
    the same distance to their next copy make; ``end`` is exclusive."""
    close = (dist > 0) & (dist <= 2 * level.length)
    at, q = level.at[close], dist[close]
    if not len(at):
        return at, at, q
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (q[1:] != q[:-1])
    heads = np.flatnonzero(first)
    last = np.append(heads[1:], len(at)) - 1
    start, period = at[heads], q[heads]
    end = at[last] + period + level.length
    long = end - start >= np.maximum(least_words, least_periods * period)
    return start[long], end[long], period[long]


def extend(levels: list[Level], place: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """``place`` moved on (``step`` 1) or back (-1) as long as the word there
    equals the word ``period`` further on, by factors from the longest down."""
    place = place.copy()
    for level in reversed(levels):
        going = np.arange(len(place))
        while len(going):
            p = place[going] if step > 0 else place[going] - level.length
            a, b = level.names(p), level.names(p + period[going])
            going = going[(a >= 0) & (a == b)]
            place[going] += step * level.length
    return place


def runs_of(words: np.ndarray, texts: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period), by start then period, of the runs of an
    array of word numbers; ``texts`` numbers the text of each word."""
    if not len(words):
        return np.zeros((0, 3), np.int64)
    longest = int(np.bincount(texts).max())
    level, dist = repeated(1, np.arange(len(words)), texts * (int(words.max()) + 1) + words)
    levels, found = [], []
    while len(level.at):
        levels.append(level)
        found.append(proposals(level, dist, least_words, least_periods))
        if level.length * least_periods > longest:  # longer periods than any run has
            break
        second = level.names(level.at + level.length)
        pairs = second >= 0
        level, dist = repeated(2 * level.length, level.at[pairs], level.name[pairs] * (int(level.name.max()) + 1) + second[pairs])
    start, end, period = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    if not len(start):
        return np.zeros((0, 3), np.int64)
    start = extend(levels, start, period, -1)
    end = extend(levels, end - period, period, 1) + period
    rows = np.unique(np.stack([start, period, end - start], axis=1), axis=0)
    return rows[:, [0, 2, 1]]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Places of the words outside every run, or among its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) == 0)


def find_runs(docs: DataFrame, text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``docs`` without its text, with (n_words, runs, collapsed) of every
    whole text: ``runs`` holds (start, length, period) in words, by start and
    period; ``collapsed`` is the text with the first period of each run alone
    kept, its words joined by one blank.

    Words are what lies between ASCII white space.  Rows stay one to one, also
    repeated ones; null, empty and blank texts have no words, no runs and the
    empty text.  Other columns pass through, but those that have the name of a
    result column are replaced.  ``least_periods`` is 3 at least: the factors
    of shorter runs need not recur inside them.
    """
    if least_periods < 3:
        raise ValueError("least_periods must be 3 or more")
    names = {"n_words", "runs", "collapsed"}
    kept = [c for c in docs.columns if c != text_col and c not in names]
    inner = [f"c{k}" for k in range(len(kept))]  # any name may be given, also one with a dot

    def solve(texts: list[list[bytes]]):
        """Results of one block of texts."""
        place: dict = {}
        words = np.array([place.setdefault(w, len(place)) for t in texts for w in t], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        found = runs_of(words, np.repeat(np.arange(len(texts)), sizes), least_words, least_periods)
        cut = np.searchsorted(found[:, 0], np.append(0, ends))
        for k, t in enumerate(texts):
            rows = found[cut[k]:cut[k + 1]] - np.array([ends[k] - sizes[k], 0, 0])
            left = t if not len(rows) else [t[j] for j in kept_words(len(t), rows)]
            yield rows, b" ".join(left)

    def run(batches):
        for b in batches:
            texts = b.column(len(kept))
            at = 0
            while at < b.num_rows:
                block, held, upto = [], 0, at
                while upto < b.num_rows and (not block or held < BLOCK_WORDS):
                    block.append((texts[upto].as_py() or "").encode().split())
                    held += len(block[-1])
                    upto += 1
                rows, out = zip(*solve(block))
                flat = np.concatenate(rows)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32))
                struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, j])) for j in range(3)], names=["start", "length", "period"])
                part = b.slice(at, upto - at)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in range(len(kept))], pa.array([len(t) for t in block], pa.int64()), pa.ListArray.from_arrays(offsets, struct),
                     pa.array(out, pa.binary()).cast(pa.string())], names=[*inner, "n_words", "runs", "collapsed"])
                at = upto

    given = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner)], F.col(f"`{text_col}`").alias("text"))
    fields = [StructField(f.name, f.dataType) for f in given.schema.fields[:-1]]
    return given.mapInArrow(run, StructType([*fields, *_parse_datatype_string(OUT).fields])).toDF(*kept, "n_words", "runs", "collapsed")


def with_periodic_tail(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` where the documents chosen by their id repeat a
    stretch of their own words to the end: with ``h = crc32(doc_id as text)``,
    ``g = h div 10`` and ``n`` words, ``h % 10 = 0`` chooses, and word ``i``
    from ``a = g % n`` on becomes word ``a + (i - a) % p``,
    ``p = 1 + (n - a) div (3 + g % 8)``.  A null id is not chosen."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w").cast("long")
    d = d.withColumn("a", F.when(n > 0, F.col("g") % n))
    d = d.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")
    tail = F.array_join(F.transform("w", lambda w, i: F.col("w")[place(i.cast("long"))]), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256) of ``find_runs``: the run shown is the longest (ties:
    smallest start, then period), nulls if there is none."""
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    d = found.select("doc_id", "n_words", "runs", "collapsed", first.alias("top"))
    length = -F.col("top.l")
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * length / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
