"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds the distinct tokens by 64-bit hash; level 2 the successors of
every token, level 3 those of every pair.  An entry of level ``k`` is the
monotone key ``context << bits | code``: the context is its place in level
``k - 1`` and the code the token, from level 3 on *relative to the context*:
its rank among the successors of the shorter context, so codes stay small.
Keys are stored in Elias-Fano form with monotone pointers from each context
to its first entry; an n-gram is found by a successor search in the bucket of
its high bits.  Probabilities and context counts are quantised to one byte.

Levels are built in Spark, a pass over the corpus each: tasks count n-grams
in numpy, send sorted runs to key ranges of equal mass (a range may start
inside a context, so a frequent context is split), and every range becomes
one file below ``spark.checkpoint.dir`` that scoring tasks map into memory.  Texts
are tokenised once, into chunks of word numbers with their vocabulary.

Smoothing is hierarchical: with ``N`` the count of a context and ``mu = N **
POWER``, p(w | c) = (count(c w) + mu p(w | shorter c)) / (N + mu), down to
the add-one unigram (c + 1) / (N + V + 1); the unseen token has the latter
with c = 0.  Every document is preceded by the end token as context.
"""

from __future__ import annotations

import json
import math
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from marketlex.llm.base import file_system, put_file, work_path

POWER = 0.8
CHUNK_TOKENS = 1_500_000  # tokens that a task counts or scores at a time
CHUNK_DOCUMENTS = 100_000
RUN_KEYS = 6_000_000      # keys a task gathers before it sends a run
END = b"\n"               # the end token: no word holds white space
U = np.uint64


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, ASCII letters lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w)


# ---- Elias-Fano ------------------------------------------------------------

def load64(data: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The 57 or more bits from each bit position on (low bits first)."""
    words = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
    return words[bit >> 3] >> (bit & 7).astype(U)


WINDOW = 56


def lowest(x: np.ndarray) -> np.ndarray:
    """Place of the lowest one."""
    return np.bitwise_count((x & (~x + U(1))) - U(1)).astype(np.int64)


class EliasFano:
    """Non-decreasing integers: ``low`` bits of each packed, the high parts
    in unary (one bit per value and per high part), and the place of every
    eighth zero and one of the unary code."""

    STEP = 8

    def __init__(self, n, low_bits, zeros, low, high, zero_at, one_at):
        self.n, self.low_bits, self.zeros = n, low_bits, zeros
        self.low, self.high, self.zero_at, self.one_at = low, high, zero_at, one_at

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> "EliasFano":
        v = values.astype(U)
        n = len(v)
        low_bits = min(56, max(0, int(math.log2(universe / n)))) if n and universe > n else 0  # load64 gives 57
        high = (v >> U(low_bits)).astype(np.int64)
        zeros = (int(high[-1]) if n else 0) + 2
        bits = np.zeros(n + zeros, bool)
        ones = high + np.arange(n)
        bits[ones] = True
        zero_at = np.flatnonzero(~bits)[::cls.STEP].astype("<u4")
        low = pack_bits(v & U((1 << low_bits) - 1), low_bits)
        pad = b"\0" * 16
        return cls(n, low_bits, zeros, np.frombuffer(low + pad, np.uint8),
                   np.frombuffer(np.packbits(bits, bitorder="little").tobytes() + pad, np.uint8), zero_at, ones[::cls.STEP].astype("<u4"))

    def parts(self) -> tuple[dict, list]:
        return {"n": self.n, "low_bits": self.low_bits, "zeros": self.zeros}, [self.low, self.high, self.zero_at, self.one_at]

    def low_of(self, i):
        if not self.low_bits:
            return np.zeros(len(i), U)
        return load64(self.low, i * self.low_bits) & U((1 << self.low_bits) - 1)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Bit place of the k-th one or zero.  From the sampled place on, the
        bit nearly always lies in the next word; past a long run of the other
        kind it does from that kind's last sampled place before it: at most
        ``STEP`` bits of either kind are left then."""
        own, other = (self.one_at, self.zero_at) if one else (self.zero_at, self.one_at)
        at = own[k // self.STEP].astype(np.int64)
        left = k % self.STEP
        start = at + (left > 0)
        w = self.window(start, one)
        far = np.flatnonzero(np.bitwise_count(w) < left)
        x = w
        for step in range(1, self.STEP):
            x = np.where(left > step, x & (x - U(1)), x)
        out = np.where(left > 0, start + lowest(x), at)
        if len(far):
            place = other.astype(np.int64)
            before = place - self.STEP * np.arange(len(place))  # own bits before each sampled one
            j = np.searchsorted(before, k[far], "right") - 1
            later = (j >= 0) & (place[j] > at[far])
            start = np.where(later, place[j], start[far])
            left = np.where(later, k[far] - before[j] + 1, left[far])
            x = self.window(start, one)
            for step in range(1, self.STEP + 1):
                x = np.where(left > step, x & (x - U(1)), x)
            out[far] = start + lowest(x)
        return out

    def window(self, bit: np.ndarray, one: bool) -> np.ndarray:
        """The next ``WINDOW`` bits, inverted for zeros."""
        w = load64(self.high, bit)
        return (w if one else ~w) & U((1 << WINDOW) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        return ((self.select(i, True) - i).astype(U) << U(self.low_bits)) | self.low_of(i)

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value >= key, whether it equals the key) of
        ascending keys; each bucket of high bits is located once."""
        keys = keys.astype(U)
        high = np.minimum(keys >> U(self.low_bits), U(self.zeros)).astype(np.int64)
        inside = high < self.zeros
        new = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1]))) if len(high) else np.zeros(0, np.int64)
        bucket = np.minimum(high[new], self.zeros - 1)
        # bucket h lies between zeros h - 1 and h of the unary code
        first = np.where(bucket > 0, self.select(np.maximum(bucket - 1, 0), False) - (bucket - 1), 0)
        # its values are the ones that follow, up to the next zero
        gap = self.window(first + bucket, False)
        stop = first + lowest(gap)
        wide = np.flatnonzero(gap == 0)
        stop[wide] = self.select(bucket[wide], False) - bucket[wide]
        size = np.diff(np.append(new, len(keys)))
        lo, end = np.repeat(first, size), np.repeat(stop, size)
        hi = end.copy()
        want = keys & U((1 << self.low_bits) - 1)
        todo = np.flatnonzero(lo < hi)
        while len(todo):  # halve the bucket
            x, y = lo[todo], hi[todo]
            mid = (x + y) >> 1
            less = self.low_of(mid) < want[todo]
            x, y = np.where(less, mid + 1, x), np.where(less, y, mid)
            lo[todo], hi[todo] = x, y
            todo = todo[x < y]
        equal = np.zeros(len(keys), bool)
        near = np.flatnonzero(inside & (lo < end))
        equal[near] = self.low_of(lo[near]) == want[near]
        return np.where(inside, lo, self.n), equal


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """Integers of ``bits`` bits one after the other, low bits first."""
    if not bits or not len(values):
        return b""
    x = np.pad(values, (0, -len(values) % 8)).reshape(-1, 8)
    out = np.zeros((len(x), bits), np.uint8)
    for i in range(8):
        at = i * bits
        for k in range(at // 8, (at + bits - 1) // 8 + 1):
            s = at - 8 * k
            out[:, k] |= ((x[:, i] << U(s) if s >= 0 else x[:, i] >> U(-s)) & U(255)).astype(np.uint8)
    return out.tobytes()


# ---- level files -----------------------------------------------------------

def file_bytes(head: dict, arrays: dict) -> bytes:
    """A level file: a JSON header with the place of every array."""
    spec, at, body = {}, 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        spec[name] = [a.dtype.str, len(a), at]
        body.append(a.tobytes())
        at += len(body[-1])
    text = json.dumps(head | {"arrays": spec}).encode()
    return struct.pack("<q", len(text)) + text + b"".join(body)


class LevelFile:
    def __init__(self, path: str):
        fs, p = file_system(path)
        if fs.type_name == "local":
            self.data = np.memmap(p, np.uint8, "r")
        else:  # a store that cannot be mapped
            with fs.open_input_stream(p) as f:
                self.data = np.frombuffer(f.read(), np.uint8)
        n = int(np.frombuffer(self.data[:8].tobytes(), "<q")[0])
        self.head = json.loads(self.data[8:8 + n].tobytes())
        self.start = 8 + n

    def array(self, name: str) -> np.ndarray:
        kind, n, at = self.head["arrays"][name]
        size = np.dtype(kind).itemsize
        return np.ndarray((n,), kind, self.data, self.start + at, (size,))

    def elias_fano(self, name: str) -> EliasFano:
        h = self.head[name]
        return EliasFano(h["n"], h["low_bits"], h["zeros"], *[self.array(f"{name}.{k}") for k in range(4)])


def count_code(c: np.ndarray) -> np.ndarray:
    """One byte for a count: exact to 128, then five steps for each doubling."""
    big = 128 + np.round(5 * np.log2(np.maximum(c, 1) / 128))
    return np.where(c <= 128, c, np.clip(big, 129, 255)).astype(np.uint8)


COUNT_OF = np.concatenate((np.arange(129), 128 * 2 ** (np.arange(1, 128) / 5)))


class Level:
    """All files of one level, opened when used.  ``files``: (first key,
    first place, path) in key order."""

    def __init__(self, files: list[tuple[int, int, str]], bits: int):
        self.files, self.bits, self.open = files, bits, {}
        self.first_key = np.array([f[0] for f in files], U)
        self.first_place = np.array([f[1] for f in files], np.int64)

    def file(self, k: int):
        if k not in self.open:
            f = LevelFile(self.files[k][2])
            self.open[k] = (f, f.elias_fano("keys"), f.elias_fano("pointers") if "pointers" in f.head else None)
        return self.open[k]

    def __getstate__(self):
        return {**self.__dict__, "open": {}}

    def each(self, which: np.ndarray):
        """(file number, rows) for rows sorted or not by file."""
        order = np.argsort(which, kind="stable")
        cut = np.flatnonzero(np.diff(which[order])) + 1
        for rows in np.split(order, cut):
            if len(rows):
                yield int(which[rows[0]]), rows

    def find(self, keys: np.ndarray, names: tuple = ()) -> tuple:
        """(places of keys, -1 where absent, and the bytes ``names`` of the
        entries found, 0 elsewhere); equal keys are looked up once."""
        out = [np.full(len(keys), -1, np.int64)] + [np.zeros(len(keys), np.uint8) for _ in names]
        if not len(self.files) or not len(keys):
            return tuple(out)
        order = np.argsort(keys)
        k = keys[order].astype(U, copy=False)
        new = np.concatenate(([True], k[1:] != k[:-1]))
        one = k[new]
        got = [np.full(len(one), -1, np.int64)] + [np.zeros(len(one), np.uint8) for _ in names]
        cut = np.concatenate((np.searchsorted(one, self.first_key), [len(one)]))
        for f in range(len(self.files)):
            lo, hi = cut[f], cut[f + 1]
            if lo < hi:
                head, ef, _ = self.file(f)
                at, same = ef.successor(one[lo:hi] - self.first_key[f])
                got[0][lo:hi] = np.where(same, at + self.first_place[f], -1)
                hit = np.flatnonzero(same)
                for g, name in zip(got[1:], names):
                    g[lo + hit] = head.array(name)[at[hit]]
        back = np.cumsum(new) - 1
        for o, g in zip(out, got):
            o[order] = g[back]
        return tuple(out)

    def starts(self, contexts: np.ndarray) -> np.ndarray:
        """Place of the first entry of each context, from the pointers."""
        out = np.zeros(len(contexts), np.int64)
        which = np.searchsorted(self.first_key, contexts.astype(U) << U(self.bits), "right") - 1
        for f, rows in self.each(which):
            head, _, pointers = self.file(f)
            out[rows] = pointers.access(contexts[rows] - head.head["first_context"]).astype(np.int64) + self.first_place[f]
        return out

    def gather(self, name: str, places: np.ndarray) -> np.ndarray:
        """Values of a plain array at places."""
        which = np.searchsorted(self.first_place, places, "right") - 1
        out = None
        for f, rows in self.each(which):
            got = self.file(f)[0].array(name)[places[rows] - self.first_place[f]]
            if out is None:
                out = np.zeros(len(places), got.dtype)
            out[rows] = got
        return np.zeros(0, np.uint8) if out is None else out


class Model:
    """Levels and totals; small enough to send with a task, the levels stay
    in their files."""

    def __init__(self, total: int, distinct: int, levels: list[Level]):
        self.total, self.distinct, self.levels = total, distinct, levels
        self.unit = (math.log10(total + distinct + 1) + 1) / 255  # log10 step of a probability byte

    # -- tokens
    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places of tokens in level 1 by hash, -1 for unknown ones."""
        return self.levels[0].find(hashes)[0]

    def end(self) -> int:
        return int(self.ids(np.array([word_hash(END)], U))[0])

    def counts(self, ids: np.ndarray) -> np.ndarray:
        c = np.zeros(len(ids), np.int64)
        known = ids >= 0
        c[known] = self.levels[0].gather("counts", ids[known])
        return c

    # -- probabilities
    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.total + self.distinct + 1)

    def code_of(self, p: np.ndarray) -> np.ndarray:
        return np.clip(np.round(-np.log10(p) / self.unit), 0, 255).astype(np.uint8)

    def log10_of(self, code: np.ndarray) -> np.ndarray:
        return -code.astype(np.float64) * self.unit

    def pairs(self, seq: np.ndarray, names: tuple = ()) -> tuple:
        """Level-2 places of (token, next token) of a sequence of level-1
        places, and the bytes ``names`` of the entries."""
        a, b = seq[:-1], seq[1:]
        known = np.flatnonzero((a >= 0) & (b >= 0))
        keys = (a[known].astype(U) << U(self.levels[1].bits)) | b[known].astype(U)
        got = self.levels[1].find(keys, names)
        if len(known) == len(a):
            return got
        out = [np.full(len(a), -1, np.int64)] + [np.zeros(len(a), np.uint8) for _ in names]
        for o, g in zip(out, got):
            o[known] = g
        return tuple(out)

    def triple_keys(self, text: "Text", pairs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``pairs[1:]`` whose pair and preceding pair exist, their
        level-3 keys): the context is the preceding pair, the code the pair's
        rank among the successors of its first token.  No triple crosses the
        end token."""
        rows = np.flatnonzero((pairs[1:] >= 0) & (pairs[:-1] >= 0) & (text.words[1:-1] != len(text.place) - 1))
        starts = np.zeros(len(text.place), np.int64)
        known = np.flatnonzero(text.place >= 0)
        starts[known] = self.levels[1].starts(text.place[known])
        code = pairs[1:][rows] - starts[text.words[1:-1][rows]]
        return rows, (pairs[:-1][rows].astype(U) << U(bits)) | code.astype(U)

    def log_probability(self, text: "Text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 p, log10 add-one p, whether known) of every token of
        ``text`` after the first."""
        count = self.counts(text.place)
        base = np.log10(self.unigram(count))
        one, known = base[text.words[1:]], (count > 0)[text.words[1:]]
        if len(self.levels) < 2:
            return one, one, known
        back = np.where(count > 0, discount(np.maximum(count, 1)), 0.0)
        lp = one + back[text.words[:-1]]
        value = self.log10_of(np.arange(256))
        pairs, p, c = self.pairs(text.sequence(), ("p", "c"))
        lp = np.where(pairs >= 0, value[p], lp)
        if len(self.levels) > 2:
            # contexts that exist discount; triples that exist replace
            inside = (pairs[:-1] >= 0) & (text.words[1:-1] != len(text.place) - 1)
            lp[1:] += np.where(inside, discount(np.maximum(COUNT_OF, 1))[c[:-1]], 0.0)
            rows, keys = self.triple_keys(text, pairs, self.levels[2].bits)
            found, p = self.levels[2].find(keys, ("p",))
            hit = found >= 0
            lp[rows[hit] + 1] = value[p[hit]]
        return lp, one, known


def discount(n: np.ndarray) -> np.ndarray:
    """log10 of the share that a context of count ``n`` leaves to the shorter
    one."""
    mu = n.astype(np.float64) ** POWER
    return np.log10(mu / (n + mu))


# ---- runs of counted keys --------------------------------------------------

RUN = "shard int, n long, keys binary, counts binary"


def planes(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys byte plane by byte plane: the high planes hardly
    change and compress away in the shuffle."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view("<u8").ravel()


def run_rows(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray):
    """One row per key range of sorted ``keys``; cuts[s] starts range s + 1."""
    at = np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)]))
    for s in np.flatnonzero(np.diff(at)):
        k, c = keys[at[s]:at[s + 1]], counts[at[s]:at[s + 1]].astype("<u4")
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([int(s)], pa.int32()), "n": pa.array([len(k)], pa.int64()), "keys": pa.array([planes(k)], pa.binary()),
            "counts": pa.array([np.ascontiguousarray(c.view(np.uint8).reshape(-1, 4).T).tobytes()], pa.binary())})


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.add.reduceat(c, first) if len(first) else c


MANIFEST = ("shard int, n long, mass long, path string, first_context long, first_entries long, last_context long, "
            "last_entries long, most_entries long")


def write_level(runs: DataFrame, out_dir: str, cuts: np.ndarray, finish) -> list:
    """Merge the runs of each key range, write its file, and return the
    manifest rows (one per range) in key order.  ``finish(keys, counts, lo,
    hi)`` gives the header and the arrays of a range [lo, hi)."""
    lows = np.concatenate((np.zeros(1, U), cuts))

    def run(batches):
        shard, keys, counts, held = None, [], [], 0

        def close():
            k, c = merged(keys, counts)
            s = int(shard)
            lo, hi = int(lows[s]), int(lows[s + 1]) if s + 1 < len(lows) else None
            head, arrays, note = finish(k, c, lo, hi)
            path = f"{out_dir}/range-{s:06d}.ef"
            put_file(path, file_bytes(head, arrays))
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([s], pa.int32()), "n": pa.array([len(k)], pa.int64()), "mass": pa.array([int(c.sum())], pa.int64()), "path": [path],
                **{f: pa.array([note.get(f, 0)], pa.int64()) for f in ("first_context", "first_entries", "last_context", "last_entries", "most_entries")}})

        for b in batches:
            for s, n, k, c in zip(*(b.column(x).to_pylist() for x in ("shard", "n", "keys", "counts"))):
                if s != shard and keys:
                    yield close()
                    keys, counts, held = [], [], 0
                shard = s
                keys.append(from_planes(k, n))
                counts.append(np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(4, n).T).view("<u4").ravel())
                held += n
                if len(keys) > 1 and held > RUN_KEYS:  # runs share many keys
                    k1, c1 = merged(keys, counts)
                    keys, counts, held = [k1], [c1], 0
        if keys:
            yield close()

    dealt = runs.repartition(len(lows), "shard").sortWithinPartitions("shard")
    return sorted(dealt.mapInArrow(run, MANIFEST).collect(), key=lambda r: r.shard)  # one row per key range


def level_of(rows: list, cuts: np.ndarray, bits: int) -> Level:
    lows = np.concatenate((np.zeros(1, U), cuts))
    place = np.cumsum([0] + [r.n for r in rows])
    return Level([(int(lows[r.shard]), int(p), r.path) for r, p in zip(rows, place)], bits)


def context_files(model: Model, bits: int, probability):
    """``finish`` of levels 2 and up: Elias-Fano keys, pointers of the
    contexts that start in the range, bytes of probability and count."""

    def finish(keys, counts, lo, hi):
        context = (keys >> U(bits)).astype(np.int64)
        first = (lo + (1 << bits) - 1) >> bits
        stop = ((hi + (1 << bits) - 1) >> bits) if hi is not None else int(context[-1]) + 1
        pointers = EliasFano.build(np.searchsorted(context, np.arange(first, max(stop, first))), len(keys) + 1)
        ef = EliasFano.build(keys - U(lo), int(keys[-1]) - lo + 1)
        head, arrays = {"first_context": first}, {"p": model.code_of(probability(keys, counts, context)), "c": count_code(counts)}
        for name, e in (("keys", ef), ("pointers", pointers)):
            head[name], parts = e.parts()
            arrays |= {f"{name}.{k}": a for k, a in enumerate(parts)}
        size = np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))), [len(context)])))
        return head, arrays, {"first_context": int(context[0]), "first_entries": int(size[0]), "last_context": int(context[-1]),
                              "last_entries": int(size[-1]), "most_entries": int(size.max())}

    return finish


def most_entries(rows: list) -> int:
    """Entries of the largest context; one that spans ranges is summed up."""
    most, run_of, run = 1, None, 0
    for r in rows:
        run = run + r.first_entries if r.first_context == run_of else r.first_entries
        most = max(most, run, r.most_entries)
        if r.last_context != r.first_context:
            run = r.last_entries
        run_of = r.last_context
        most = max(most, run)
    return most


def mass_cuts(spark: SparkSession, level: Level, rows: list, counts_of, ranges: int, bits: int) -> np.ndarray:
    """Keys of the next level that cut it into ranges of about equal mass,
    by the counts of its contexts; a cut may fall inside a context."""
    total = sum(r.mass for r in rows)
    ahead = np.cumsum([0] + [r.mass for r in rows])
    want = np.array([total * j // ranges for j in range(1, ranges)], np.int64)

    def run(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                c = counts_of(level.file(k)[0])
                ends = ahead[k] + np.cumsum(c) * ((ahead[k + 1] - ahead[k]) / max(1, c.sum()))
                mine = want[(want > ahead[k]) & (want <= ahead[k + 1])]
                i = np.minimum(np.searchsorted(ends, mine), len(c) - 1)
                inside = 1 - (ends[i] - mine) / np.maximum(ends[i] - np.where(i > 0, ends[i - 1], ahead[k]), 1e-9)
                context = (i + level.first_place[k]).astype(U)
                low = (np.clip(inside, 0, 1) * ((1 << bits) - 1)).astype(U)
                yield pa.RecordBatch.from_pydict({"cut": pa.array(((context << U(bits)) | low).view(np.int64))})

    if not rows or ranges < 2:
        return np.zeros(0, U)
    got = spark.range(0, len(rows), 1, len(rows)).mapInArrow(run, "cut long").collect()  # fewer than ``ranges`` numbers
    return np.unique(np.array([r.cut for r in got], np.int64).view(U))


# ---- training and scoring --------------------------------------------------

CHUNKS = "doc_id array<long>, held_out array<boolean>, words array<int>, ids binary, vocabulary binary"


class Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def token_chunks(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, held_out, text)`` as chunks of about ``CHUNK_TOKENS``
    tokens: the documents' ids, flags and word counts, all words as places in
    the chunk's vocabulary, and the vocabulary as 64-bit hashes.  Texts are
    tokenised here only."""

    def run(batches):
        doc_ids, flags, texts, held = [], [], [], 0

        def chunk():
            place = Numbers()
            ids = np.fromiter(map(place.__getitem__, chain.from_iterable(texts)), "<i4", held)
            vocabulary = np.fromiter(map(xxhash.xxh64_intdigest, place), U, len(place))
            return pa.RecordBatch.from_arrays([
                pa.array([doc_ids], pa.list_(pa.int64())), pa.array([flags], pa.list_(pa.bool_())),
                pa.array([[len(ws) for ws in texts]], pa.list_(pa.int32())), pa.array([ids.tobytes()], pa.binary()),
                pa.array([vocabulary.tobytes()], pa.binary())], names=["doc_id", "held_out", "words", "ids", "vocabulary"])

        for b in batches:
            for d, h, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text")):
                doc_ids.append(d)
                flags.append(h)
                texts.append(split_words(t.as_py()))
                held += len(texts[-1])
                if held >= CHUNK_TOKENS or len(texts) >= CHUNK_DOCUMENTS:
                    yield chunk()
                    doc_ids, flags, texts, held = [], [], [], 0
        if texts:
            yield chunk()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, CHUNKS)


class Chunk:
    """One stored chunk: ``ids`` of all words in places of ``hashes``, cut
    into documents at ``starts``."""

    def __init__(self, batch, row: int):
        self.doc_id, self.held_out = batch.column("doc_id")[row].as_py(), batch.column("held_out")[row].as_py()
        self.words = np.array(batch.column("words")[row].as_py(), np.int64)
        self.ids = np.frombuffer(batch.column("ids")[row].as_buffer(), "<i4") if self.words.sum() else np.zeros(0, "<i4")
        self.hashes = np.frombuffer(batch.column("vocabulary")[row].as_buffer(), "<u8") if len(self.ids) else np.zeros(0, U)

    def part(self, learnt_only: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, word counts) of all documents or of those to learn from."""
        if not learnt_only:
            return self.ids, self.words
        keep = ~np.array(self.held_out, bool)
        return self.ids[np.repeat(keep, self.words)], self.words[keep]

    def text(self, model: Model, end: int, learnt_only: bool) -> "Text":
        """All words with the end token before the first document and after
        each, so that it is also the context of every first word."""
        ids, words = self.part(learnt_only)
        seq = np.full(len(ids) + len(words) + 1, len(self.hashes), np.int64)
        seq[np.arange(len(ids)) + 1 + np.repeat(np.arange(len(words)), words)] = ids
        return Text(seq, np.append(model.ids(self.hashes), end))


class Text:
    """``words``: places in a chunk's vocabulary; ``place``: the level-1 place
    of each vocabulary entry (-1 if unknown), the end token last."""

    def __init__(self, words: np.ndarray, place: np.ndarray):
        self.words, self.place = words, place

    def sequence(self) -> np.ndarray:
        return self.place[self.words]


def chunks_of(batches):
    for b in batches:
        for row in range(b.num_rows):
            yield Chunk(b, row)


def train(chunks: DataFrame, order: int) -> Model:
    """Fit on the documents of stored ``chunks`` that are not held out."""
    spark = chunks.sparkSession
    ranges = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    home = work_path(spark, "ngram-trie")
    cuts1 = np.array([(1 << 64) * j // ranges for j in range(1, ranges)], U)

    def count_words(batches):
        keys, counts, held = [], [], 0
        for c in chunks_of(batches):
            ids, words = c.part(True)
            seen = np.bincount(ids, minlength=len(c.hashes))
            k = np.append(c.hashes, U(word_hash(END)))
            n = np.append(seen, len(words))
            keys.append(k[n > 0])
            counts.append(n[n > 0])
            held += len(keys[-1])
            if held >= RUN_KEYS:
                yield from run_rows(*merged(keys, counts), cuts1)
                keys, counts, held = [], [], 0
        if held:
            yield from run_rows(*merged(keys, counts), cuts1)

    def word_file(keys, counts, lo, hi):
        ef = EliasFano.build(keys - U(lo), int(keys[-1]) - lo + 1)
        head, parts = ef.parts()
        return {"keys": head}, {"counts": counts.astype("<i8")} | {f"keys.{k}": a for k, a in enumerate(parts)}, {}

    rows = write_level(chunks.select("held_out", "words", "ids", "vocabulary", "doc_id").mapInArrow(count_words, RUN), f"{home}/level-1", cuts1, word_file)
    level1 = level_of(rows, cuts1, 0)
    model = Model(sum(r.mass for r in rows), sum(r.n for r in rows), [level1])
    if not rows or order < 2:
        return model

    def counted(keys_of, cuts):
        """Runs of the keys that ``keys_of(text)`` makes."""

        def run(batches):
            end, keys, counts, held = model.end(), [], [], 0
            for c in chunks_of(batches):
                k = np.sort(keys_of(c.text(model, end, True)))
                first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
                keys.append(k[first])
                counts.append(np.diff(np.append(first, len(k))))
                held += len(first)
                if held >= RUN_KEYS:
                    yield from run_rows(*merged(keys, counts), cuts)
                    keys, counts, held = [], [], 0
            if held:
                yield from run_rows(*merged(keys, counts), cuts)

        return chunks.mapInArrow(run, RUN)

    bits2 = max(1, (model.distinct - 1).bit_length())
    cuts2 = mass_cuts(spark, level1, rows, lambda f: f.array("counts"), ranges, bits2)

    def pair_keys(text):
        seq = text.sequence()
        return (seq[:-1].astype(U) << U(bits2)) | seq[1:].astype(U)

    def pair_probability(keys, counts, context):
        words, back = np.unique(context, return_inverse=True)
        n = model.counts(words)[back].astype(np.float64)
        mu = n ** POWER
        lower = model.unigram(model.counts((keys & U((1 << bits2) - 1)).astype(np.int64)))
        return (counts + mu * lower) / (n + mu)

    rows2 = write_level(counted(pair_keys, cuts2), f"{home}/level-2", cuts2, context_files(model, bits2, pair_probability))
    model = Model(model.total, model.distinct, [level1, level_of(rows2, cuts2, bits2)])
    if order < 3:
        return model
    bits3 = max(1, (most_entries(rows2) - 1).bit_length())
    cuts3 = mass_cuts(spark, model.levels[1], rows2, lambda f: COUNT_OF[f.array("c")], ranges, bits3)

    def triple_keys(text):
        return model.triple_keys(text, model.pairs(text.sequence())[0], bits3)[1]

    def triple_probability(keys, counts, context):
        m = COUNT_OF[model.levels[1].gather("c", context)].astype(np.float64)
        m = np.maximum(m, counts)
        # the pair (second token, third token): first entry of the second token plus the code
        second = pair_tokens(model.levels[1], context)
        words, back = np.unique(second, return_inverse=True)
        lower = 10 ** model.log10_of(model.levels[1].gather("p", model.levels[1].starts(words)[back] + (keys & U((1 << bits3) - 1)).astype(np.int64)))
        mu = m ** POWER
        return (counts + mu * lower) / (m + mu)

    rows3 = write_level(counted(triple_keys, cuts3), f"{home}/level-3", cuts3, context_files(model, bits3, triple_probability))
    return Model(model.total, model.distinct, [*model.levels, level_of(rows3, cuts3, bits3)])


def pair_tokens(level: Level, places: np.ndarray) -> np.ndarray:
    """Second token of the pairs at places of level 2."""
    out = np.zeros(len(places), np.int64)
    which = np.searchsorted(level.first_place, places, "right") - 1
    for f, rows in level.each(which):
        _, ef, _ = level.file(f)
        key = ef.access(places[rows] - level.first_place[f]) + level.first_key[f]
        out[rows] = (key & U((1 << level.bits) - 1)).astype(np.int64)
    return out


SCORE = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, order: int = 3) -> DataFrame:
    """Train on the rows of ``docs(doc_id, held_out, text)`` that are not held
    out and score them all: (doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score), log10 scores over the whole text.

    A null or empty text is the end token alone.  With nothing to train on
    every token is unknown.  Rows are kept one to one."""
    spark = docs.sparkSession
    path = work_path(spark, "ngram-chunks")
    token_chunks(docs).write.option("compression", "zstd").parquet(path)
    chunks = spark.read.schema(CHUNKS).parquet(path)
    model = train(chunks, order)

    def run(batches):
        end = model.end() if model.levels[0].files else -1
        for c in chunks_of(batches):
            lp, base, known = model.log_probability(c.text(model, end, False))
            n = c.words + 1
            at = np.cumsum(n) - n
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(c.doc_id, pa.int64()), "held_out": pa.array(c.held_out, pa.bool_()),
                "n_tokens": n, "n_known": np.add.reduceat(known.astype(np.int64), at), "train_tokens": np.full(len(n), model.total, np.int64),
                "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(lp, at)})

    return chunks.mapInArrow(run, "doc_id long, held_out boolean, " + SCORE)
