"""Best-fit packing of token sequences by exact-complement hashing.

Only lengths matter for what fits together, and no piece is longer than the
capacity, so packing is planned on the histogram of lengths: at most
``capacity`` counts, whatever the table.  A *pattern* is a multiset of lengths
that share a sequence.  It starts with the longest length left; the gap is
looked up among the single lengths, then among the sums of two lengths, then
of three (an index of pair sums, asked for the gap less each length), all with
at least as many pieces left as the combination takes.  An exact complement
closes the pattern; otherwise the longest piece that fits goes in (best fit)
and the smaller gap is looked up again.  A finished pattern is used as often
as its scarcest length allows, so every pattern uses some length up and their
number follows the number of lengths, not of pieces.

Spark then numbers the pieces of each length and deals them to the places of
the patterns: the plan holds, per length, ranges of those numbers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlex.llm.base import stored
from marketlex.llm.token_files import encoder
from marketlex.operators.ordering import hash_row_number

CAPACITY = 4096
NUMBER_BITS = 44         # numbers of pieces of one length lie below 2 ** 44
SEED = 13

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Lengths:
    """Pieces left of each length, and how many pairs of lengths make up each
    sum (a pair of equal lengths needs two pieces)."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        self.live = self.left > 0
        self.pairs = np.zeros(self.capacity + 1, np.int64)
        for a in np.flatnonzero(self.live):
            self.note(int(a), 1, upto=int(a))
        for a in np.flatnonzero(self.left >= 2):
            self.note_double(int(a), 1)

    def note(self, a: int, by: int, upto: int | None = None) -> None:
        """Count (``by`` 1) or uncount (-1) the pairs of ``a`` with the other
        live lengths (those below ``upto``)."""
        top = min(self.capacity - a, self.capacity if upto is None else upto - 1)
        if top >= 1:
            others = self.live[1:top + 1].copy()
            if a <= top:
                others[a - 1] = False
            self.pairs[a + 1:a + top + 1] += by * others

    def note_double(self, a: int, by: int) -> None:
        if 2 * a <= self.capacity:
            self.pairs[2 * a] += by

    def take(self, a: int, n: int = 1) -> None:
        before = self.left[a]
        self.left[a] = after = before - n
        if before >= 2 > after:
            self.note_double(a, -1)
        if after == 0:
            self.live[a] = False
            self.note(a, -1)

    def put_back(self, a: int) -> None:
        self.left[a] += 1
        if self.left[a] == 1:
            self.note(a, 1)
            self.live[a] = True
        if self.left[a] == 2:
            self.note_double(a, 1)

    def longest(self, limit: int) -> int:
        """The longest length left up to ``limit``; 0 if there is none."""
        at = np.flatnonzero(self.live[:limit + 1])
        return int(at[-1]) if len(at) else 0

    def pair(self, total: int) -> tuple[int, ...] | None:
        """Two lengths left that make up ``total``, the longer one as long as
        can be."""
        if total < 2 or not self.pairs[total]:
            return None
        a = np.arange((total + 1) // 2, total)
        fits = self.live[a] & self.live[total - a]
        if total % 2 == 0 and self.left[total // 2] < 2:
            fits[0] = False
        at = np.flatnonzero(fits)
        return (int(a[at[-1]]), int(total - a[at[-1]])) if len(at) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three lengths left that make up ``gap``."""
        a = np.arange((gap + 2) // 3, gap - 1)
        for x in a[self.live[a] & (self.pairs[gap - a] > 0)][::-1]:
            self.take(int(x))
            two = self.pair(gap - int(x))
            self.put_back(int(x))
            if two:
                return (int(x), *two)
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths left that fill ``gap`` exactly."""
        return (gap,) if self.live[gap] else self.pair(gap) or self.triple(gap)


def plan_patterns(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times used, [(length, pieces of it), ...]) that use up
    ``counts`` (``counts[l]`` pieces of length ``l``; the capacity is the last
    index)."""
    left = Lengths(counts)
    out = []
    while True:
        first = left.longest(left.capacity)
        if not first:
            return out
        used: dict[int, int] = {}
        gap = left.capacity

        def add(lengths):
            for x in lengths:
                left.take(x)
                used[x] = used.get(x, 0) + 1

        add((first,))
        gap -= first
        while gap:
            fill = left.complement(gap)
            if fill is None:
                best = left.longest(gap)
                if not best:
                    break
                fill = (best,)
            add(fill)
            gap -= sum(fill)
        more = min(int(left.left[x]) // n for x, n in used.items())
        if more:
            for x, n in used.items():
                left.take(x, more * n)
        out.append((more + 1, sorted(used.items(), reverse=True)))


class Plan:
    """Where the pieces of each length go, by their number among them: arrays
    sorted by (length, first number)."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        numbered: dict[int, int] = {}
        rows, sequence = [], 0
        for times, lengths in patterns:
            offset = 0
            for length, n in lengths:
                at = numbered.get(length, 0)
                rows.append(((length << NUMBER_BITS) + at, sequence, n, offset))
                numbered[length] = at + times * n
                offset += length * n
            sequence += times
        self.sequences = sequence
        self.key, self.sequence, self.each, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T.copy()

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and number from 0."""
        key = (length << NUMBER_BITS) + number
        k = np.searchsorted(self.key, key, "right") - 1
        at = key - self.key[k]
        return self.sequence[k] + at // self.each[k], self.offset[k] + at % self.each[k] * length


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of the token ids
    of ``docs(doc_id, text)``, ``end_id`` closing every document; only longer
    documents than ``capacity`` are cut.  ``ids`` are little-endian unsigned
    32-bit integers."""
    with open(tokenizer_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    step = 4 * capacity

    def run(batches):
        enc = encoder(shipped.value)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc, piece, length, crc, blobs, held = [], [], [], [], [], 0

            def batch():
                number = np.array(piece, np.int64)
                out = {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(number.astype(np.int32)), "start": pa.array(number * capacity),
                       "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                return pa.RecordBatch.from_pydict(out | ({"ids": pa.array(blobs, pa.binary())} if keep_ids else {}))

            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                raw = enc.ids_bytes(t.as_py()) + end
                for k in range(0, len(raw), step):
                    part = raw[k:k + step]
                    doc.append(d)
                    piece.append(k // step)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        blobs.append(part)
                        held += len(part)
                if held > 1 << 22:
                    yield batch()
                    doc, piece, length, crc, blobs, held = [], [], [], [], [], 0
            if doc:
                yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` as ``cut_pieces`` gives them, with the
    ``sequence_id`` and ``offset`` of their place: sequences of at most
    ``capacity`` tokens, without gaps, as few as the plan finds.

    Null and empty texts are the end id alone.  Repeated ids and rows are
    packed each for itself, a null id like any other; an empty table has no
    pieces.  Pieces of one length are numbered in a seeded hash order of
    (doc_id, piece, ids_crc32), so the result does not depend on how the table
    is partitioned.  ``docs`` may have any other columns; they are not read.
    """
    pieces = stored(cut_pieces(docs, tokenizer_path, end_id, capacity, keep_ids), "packing-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r.length] = r["count"]
    plan = docs.sparkSession.sparkContext.broadcast(Plan(plan_patterns(counts)))
    numbered = hash_row_number(pieces, SEED, ["doc_id", "piece", "ids_crc32"], "number", ["length"])

    def place(batches):
        for b in batches:
            length, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            sequence, offset = plan.value.place(length, number - 1)
            keep = [c for c in b.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    out = [*[f.name for f in pieces.schema.fields], "number"]
    schema = PIECES + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long"
    return numbered.select(*out).mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, documents, ids) of ``pack_documents`` with
    ``keep_ids``: the token ids of whole sequences, and the pieces
    (doc_id, piece, offset, length) in them, by offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    d = packed.groupBy("sequence_id").agg(parts.alias("p"))  # at most ``capacity`` tokens a group
    return d.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_tokens"),
                    F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("documents"),
                    F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"])).alias("ids"))
