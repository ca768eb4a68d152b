"""Benchmark decontamination by the q-gram lemma.

A region of a document within ``e`` edits of a benchmark item of ``m``
characters shares at least ``m + 1 - q (e + 1)`` of the item's q-grams with
it, all within ``e`` diagonals (document place minus item place).  So shared
q-grams are counted in overlapping diagonal bands, bands below the bound are
dropped, and what is left is verified by banded alignment of the whole item
against the region.

Texts are compared lower-cased with runs of white space as one blank.  Items
are cut into blocks of bounded size, one pass over the documents each, so the
index that a task holds is bounded whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlex.llm.base import where_text

Q = 10
ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000
TABLE_BITS = 22
PIECE = 1 << 20
U = np.uint64
BASE = 0x100000001B3
HIT = "doc_id long, item_id long, start long, end long, edits long, n_shared long"


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def places(text: str) -> np.ndarray:
    """For each character of ``normal(text)`` its place in ``text``, and the
    length of ``text`` at the end (lower-casing that lengthens a character
    maps to the character it came from)."""
    out, blank = [], False
    for k, c in enumerate(text):
        if c.isspace():
            blank = bool(out)
            continue
        if blank:
            out.append(k - 1)
            blank = False
        out.extend([k] * len(c.lower()))
    out.append(len(text))
    return np.array(out)


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of every q-gram, by doubling the length hashed."""
    if len(c) < q:
        return np.zeros(0, U)
    h, n = c.astype(U) + U(1), 1
    out, done = None, 0
    power = BASE
    while True:
        if q & n:  # append this power of two
            part = h[done:done + len(c) - q + 1]
            out = part if out is None else out * U(power) + part
            done += n
        n *= 2
        if n > q:
            break
        h = h[:-(n // 2)] * U(power) + h[n // 2:]
        power = power * power % (1 << 64)
    return (out ^ (out >> U(31))) * U(0x9E3779B97F4A7C15)


def budget(m: int, q: int, rate: float) -> tuple[int, int]:
    """Edits allowed for an item of ``m`` characters and the least number of
    shared q-grams; where the rate leaves no q-gram over, the most edits that
    do."""
    e = min(int(rate * m), (m - q) // q)
    return e, m + 1 - q * (e + 1)


class ItemIndex:
    """q-grams of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q = q
        kept = [(i, normal(t)) for i, t in items if t]
        self.ids = [i for i, t in kept if t]
        self.texts = [t for _, t in kept if t]
        self.short = {}           # items shorter than q: only the whole text counts
        hashes, item, place, plan = [], [], [], []
        for k, t in enumerate(self.texts):
            if len(t) < q:
                self.short.setdefault(t, []).append(self.ids[k])
                plan.append((0, 1))
                continue
            plan.append(budget(len(t), q, rate))
            h = gram_hashes(codes(t), q)
            hashes.append(h)
            item.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, U)
        order = np.argsort(flat, kind="stable")
        self.hash = flat[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.edits = np.array([e for e, _ in plan], np.int64)
        self.least = np.array([n for _, n in plan], np.int64)
        self.width = np.maximum(1, self.edits)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.slot(self.hash)] = True
        lens = [len(t) for t in self.texts if len(t) >= q]
        self.window, self.fewest = max(lens, default=0) * 2, int(self.least[[len(t) >= q for t in self.texts]].min()) if lens else 0

    @staticmethod
    def slot(h):
        return (h >> U(64 - TABLE_BITS)).astype(np.intp)

    def find(self, text: str):
        """(item_id, start, end, edits, n_shared) in characters of ``text``."""
        t = normal(text)
        out = [(i, 0, len(text), 0, 0) for i in self.short.get(t, ())]
        if not len(self.hash):
            return out
        c = codes(t)
        near = []
        for at in range(0, len(c), PIECE):  # long texts piece by piece
            h = gram_hashes(c[at:at + PIECE + self.q - 1], self.q)
            hit = np.flatnonzero(self.table[self.slot(h)])
            if len(hit) < self.fewest and len(c) <= PIECE:
                return out
            lo = np.searchsorted(self.hash, h[hit])
            lo[lo == len(self.hash)] = 0
            true = self.hash[lo] == h[hit]
            near.append((hit[true] + at, h[hit][true]))
        where = np.concatenate([p for p, _ in near]) if near else np.zeros(0, np.int64)
        hashes = np.concatenate([x for _, x in near]) if near else np.zeros(0, U)
        if len(where) < self.fewest:
            return out
        # some window of an item's length must hold enough shared q-grams
        dense = np.searchsorted(where, where + self.window, "right") - np.arange(len(where))
        crowded = np.zeros(len(where) + 1, np.int64)
        ok = np.flatnonzero(dense >= self.fewest)
        if not len(ok):
            return out
        np.add.at(crowded, ok, 1)
        np.add.at(crowded, ok + dense[ok], -1)
        keep = np.cumsum(crowded)[:-1] > 0
        where, hashes = where[keep], hashes[keep]
        lo, hi = np.searchsorted(self.hash, hashes), np.searchsorted(self.hash, hashes, "right")
        n = hi - lo
        ends = np.cumsum(n)
        step = max(1, int(np.searchsorted(ends, 4_000_000)))
        found = []
        if step >= len(where):
            found.append(self.bands(where, lo, n))
        else:  # very many pairs: item by item over the places
            for k in range(len(self.texts)):
                if len(self.texts[k]) >= self.q:
                    found.append(self.bands(where, lo, n, k))
        seen: dict = {}
        for item, band, shared in (x for f in found for x in f):
            self.verify(t, c, item, band, shared, seen)
        if seen:
            at = places(text)
            for (item, _), (start, end, edits, shared) in sorted(seen.items()):
                last = int(at[end - 1])
                out.append((self.ids[item], int(at[start]), last + 1, edits, shared))
        return out

    def bands(self, where, lo, n, only=None):
        """(item, band, shared q-grams) of the bands that meet the bound."""
        flat = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        p, item = np.repeat(where, n), self.item[flat]
        place = self.place[flat]
        if only is not None:
            mine = item == only
            p, item, place = p[mine], item[mine], place[mine]
        if not len(p):
            return []
        width = self.width[item]
        diagonal = p - place
        low = np.floor_divide(diagonal, width)
        # bands of two widths that start every width: a drift of up to e
        # diagonals lies whole in one of the two that hold its least diagonal
        item2, band2, p2 = np.concatenate((item, item)), np.concatenate((low, low - 1)), np.concatenate((p, p))
        key = np.lexsort((p2, band2, item2))
        item2, band2, p2 = item2[key], band2[key], p2[key]
        new_band = np.concatenate(([True], (item2[1:] != item2[:-1]) | (band2[1:] != band2[:-1])))
        new_place = new_band | np.concatenate(([True], p2[1:] != p2[:-1]))
        first = np.flatnonzero(new_band)
        shared = np.add.reduceat(new_place.astype(np.int64), first)
        ok = shared >= self.least[item2[first]]
        return list(zip(item2[first][ok].tolist(), band2[first][ok].tolist(), shared[ok].tolist()))

    def verify(self, t, c, item, band, shared, seen):
        m, e, width = len(self.texts[item]), int(self.edits[item]), int(self.width[item])
        d0, d1 = band * width - e, band * width + 2 * width + e
        exact = t.find(self.texts[item], max(0, d0), max(0, d1 + m))
        if exact >= 0:
            got = (exact, exact + m, 0)
        else:
            got = banded(codes(self.texts[item]), c, d0, d1, e)
        if got is None:
            return
        start, end, edits = got
        for (k, s), (s0, e0, ed0, _) in list(seen.items()):  # one region, once
            if k == item and start < e0 and s0 < end:
                if ed0 <= edits:
                    return
                del seen[(k, s)]
        seen[(item, start)] = (start, end, edits, shared)


def banded(item: np.ndarray, text: np.ndarray, d0: int, d1: int, most: int):
    """Fewest edits of the whole item against a region of the text whose
    alignment stays on diagonals d0..d1 (text place minus item place):
    (start, end, edits), or None above ``most``.  Row by row over the item;
    a row holds the band only."""
    w = d1 - d0 + 1
    far = len(item) + w + 1
    j = np.arange(w) + d0                      # text place before row 0
    inside = (j >= 0) & (j <= len(text))
    cost = np.where(inside, 0, far)            # the region may start anywhere
    begin = j.copy()
    ramp = np.arange(w)
    for i in range(1, len(item) + 1):
        j = np.arange(w) + d0 + i
        k = np.clip(j - 1, 0, max(0, len(text) - 1))
        same = (text[k] == item[i - 1]) & (j >= 1) & (j <= len(text)) if len(text) else np.zeros(w, bool)
        sub = cost + ~same
        up = np.append(cost[1:], far) + 1      # item character without partner
        take = up < sub
        now, src = np.where(take, up, sub), np.where(take, np.append(begin[1:], 0), begin)
        now = np.where((j >= 0) & (j <= len(text)), now, far)
        run = now - ramp                       # text characters without partner
        best = np.minimum.accumulate(run)
        who = np.maximum.accumulate(np.where(run == best, ramp, 0))
        cost, begin = best + ramp, src[who]
        cost = np.where((j >= 0) & (j <= len(text)), cost, far)
        if cost.min() > most:
            return None
    b = int(cost.argmin())
    return (int(begin[b]), int(b + d0 + len(item)), int(cost[b])) if cost[b] <= most else None


def benchmark_blocks(benchmark: DataFrame, block_chars: int) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``block_chars`` characters, by a hash of
    the id; each block is collected alone."""
    usable = benchmark.where(F.col("text").isNotNull())
    total = usable.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    n = max(1, -(-total // block_chars))
    mine = usable.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("blk"))
    for k in range(n):
        yield [(r.item_id, r.text) for r in mine.where(F.col("blk") == k).distinct().collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, error_rate: float = ERROR_RATE,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and benchmark passage found in it: (doc_id,
    item_id, start, end, edits, n_shared); ``start``/``end`` are code points
    of the text as given.

    An item counts as found where a region is within ``error_rate`` x its
    length edits of the whole item.  Items shorter than ``q`` characters only
    match a document that consists of them.  Null and empty texts and items
    match nothing; rows that repeat give repeated rows.  Map only: no
    shuffle."""
    spark = docs.sparkSession
    out = None
    for items in benchmark_blocks(benchmark, block_chars):
        shipped = spark.sparkContext.broadcast(ItemIndex(items, q, error_rate))

        def run(batches, shipped=shipped):
            index = shipped.value
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")) if t.is_valid
                        for hit in index.find(t.as_py())]
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_pydict({c: pa.array(list(v), pa.int64()) for c, v in
                                                  zip(("doc_id", "item_id", "start", "end", "edits", "n_shared"), cols)})

        part = docs.select("doc_id", "text").mapInArrow(run, HIT)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, error_rate: float = ERROR_RATE,
                      block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; all
    columns pass through and only the text goes to Python.  Map only: a block
    of items is a filter."""
    for items in benchmark_blocks(benchmark, block_chars):
        shipped = docs.sparkSession.sparkContext.broadcast(ItemIndex(items, q, error_rate))

        docs = where_text(docs, holds_none(shipped))
    return docs


def holds_none(shipped):
    """Filter on texts: none of the items of a shipped index is in them."""

    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            yield pa.array([not (t.is_valid and shipped.value.find(t.as_py())) for t in c], pa.bool_())

    return clean
