"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of word n-grams.  Texts with equal sets form one *class* and
are joined once.  Classes that agree in a band of their MinHash signatures
are candidates; their signatures are compared a slice at a time, and a pair
is dropped as soon as the posterior probability that its Jaccard similarity
reaches the threshold falls below ``tolerance``.  What is left is verified
exactly on the sets.

Nothing quadratic is ever a Spark row.  Candidate buckets give star edges (a
member and the bucket's smallest class), whose connected components are dealt
to tasks; a task compares the classes it holds and returns one row per class:
its links and its local root.  A component too large for one task is dealt by
bucket instead, and a bucket too large for one task by pairs of blocks, so
every candidate pair is compared exactly once at any size.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlex.llm.base import Memo, fresh, join_split, stored

WORDS = 5                # words of an n-gram
THRESHOLD = (4, 5)       # similarity as a fraction: 0.8
HASHES = 128
BAND_ROWS = 4            # 32 bands: a pair at 0.8 misses all of them once in 2e7
SLICE = 16               # hashes compared between two prunings
TOLERANCE = 1e-6
TASK_GRAMS = 2_000_000   # n-grams that one task holds at a time
MEMO_BYTES = 96 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public constants)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams: lower-cased
    words between white space; a text of fewer words is one n-gram of all its
    words; a text without words has none."""

    def __init__(self, words: int):
        self.words = words
        self.memo = Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), MEMO_BYTES)

    def grams(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, U)
        words = text.lower().split()
        if not words:
            return np.zeros(0, U)
        w = np.fromiter(map(self.memo.__getitem__, words), U, len(words))
        n = min(self.words, len(w))
        h = np.full(len(w) - n + 1, n, U)
        for k in range(n):
            h = h * U(0x100000001B3) + mix(w[k:len(w) - n + 1 + k])
        return np.unique(mix(h))


class MinHash:
    """``HASHES`` minima of multiply-shift hashes of a set."""

    def __init__(self, n: int, seed: int):
        r = np.random.default_rng(seed)
        self.a = r.integers(1, 1 << 63, n, dtype=np.int64).astype(U) * U(2) + U(1)
        self.b = r.integers(0, 1 << 63, n, dtype=np.int64).astype(U)

    def signature(self, grams: np.ndarray) -> np.ndarray:
        low = None
        for at in range(0, len(grams), 2048):
            x = ((self.a[:, None] * grams[None, at:at + 2048] + self.b[:, None]) >> U(32)).min(axis=1)
            low = x if low is None else np.minimum(low, x)
        return low.astype("<u4")


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """64-bit key of each band of each signature (rows x bands)."""
    s = signatures.reshape(len(signatures), -1, BAND_ROWS).astype(U)
    h = np.arange(s.shape[1], dtype=U)[None, :] * U(0x9E3779B97F4A7C15)
    for k in range(BAND_ROWS):
        h = mix(h ^ s[:, :, k] + U((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
    return h


def posterior(matches: int, n: int, threshold: float) -> float:
    """P(similarity >= threshold | ``matches`` of ``n`` hashes agree) under a
    uniform prior: the upper tail of Beta(matches + 1, n - matches + 1), a
    binomial sum as both parameters are integers."""
    return sum(comb(n + 1, j) * threshold ** j * (1 - threshold) ** (n + 1 - j) for j in range(matches + 1))


def least_matches(threshold: float, tolerance: float, hashes: int) -> dict[int, int]:
    """After each slice, the fewest agreeing hashes that keep a pair."""
    out = {}
    for n in range(SLICE, hashes + 1, SLICE):
        out[n] = next((m for m in range(n + 1) if posterior(m, n, threshold) >= tolerance), n + 1)
    return out


# ---- per-task comparison ---------------------------------------------------

class Group:
    """Classes that one task compares: ids, copies, signatures and sets, in
    block A (``side`` 0), block B (1) or a single block (A alone)."""

    def __init__(self, band: int, one_block: bool):
        self.band, self.one_block = band, one_block
        self.cid, self.copies, self.sig, self.sets, self.side = [], [], [], [], []

    def compare(self, floor: dict[int, int], threshold: tuple[int, int]):
        """Links and local roots: arrays (cid, links, root)."""
        cid, copies = np.array(self.cid, np.int64), np.array(self.copies, np.int64)
        sig = np.array(self.sig, np.uint32).reshape(len(cid), -1)
        size = np.array([len(s) for s in self.sets], np.int64)
        start = np.concatenate(([0], np.cumsum(size)))
        _, gram = np.unique(np.concatenate(self.sets), return_inverse=True)
        seen = np.zeros(gram.max(initial=-1) + 1, bool)
        bands = band_keys(sig)
        links, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
        side = np.array(self.side)
        right = np.arange(len(cid)) if self.one_block else np.flatnonzero(side == 1)
        num, den = threshold
        for i in (range(len(cid)) if self.one_block else np.flatnonzero(side == 0)):
            j = right[right > i] if self.one_block else right
            # sizes alone rule out most pairs of a mixed bucket
            j = j[(den * np.minimum(size[i], size[j]) >= num * np.maximum(size[i], size[j]))]
            if self.band < 0:
                j = j[(bands[j] == bands[i]).any(axis=1)]
            else:  # a pair belongs to the first band in which it agrees
                j = j[(bands[j, self.band] == bands[i, self.band]) & ~(bands[j, :self.band] == bands[i, :self.band]).any(axis=1)]
            agree = np.zeros(len(j), np.int64)
            for n, least in floor.items():
                if not len(j):
                    break
                agree += (sig[j, n - SLICE:n] == sig[i, n - SLICE:n]).sum(axis=1)
                ok = agree >= least
                j, agree = j[ok], agree[ok]
            if not len(j):
                continue
            own = gram[start[i]:start[i + 1]]
            seen[own] = True
            at = np.concatenate(([0], np.cumsum(size[j])))
            flat = np.repeat(start[j] - at[:-1], size[j]) + np.arange(at[-1])
            both = np.add.reduceat(seen[gram[flat]].astype(np.int64), at[:-1])
            seen[own] = False
            j = j[den * both >= num * (size[i] + size[j] - both)]
            if len(j):
                links[i] += copies[j].sum()
                links[j] += copies[i]
                met = np.unique(np.append(label[j], label[i]))
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        root = np.full(len(cid), np.iinfo(np.int64).max)
        np.minimum.at(root, label, cid)
        keep = links > 0
        return cid[keep], links[keep], root[label][keep]


# ---- Spark -----------------------------------------------------------------

_SHINGLERS: dict = {}


def shingler(words: int) -> Shingler:
    if words not in _SHINGLERS:
        _SHINGLERS[words] = Shingler(words)
    return _SHINGLERS[words]


def class_of(grams: np.ndarray) -> int:
    """64-bit id of a set (signed)."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, words: int, hashes: int, seed: int) -> DataFrame:
    """(doc_id, th, cid, n_grams, sig) of each row; cid and sig are null for
    a text without n-grams; ``th`` hashes the text."""

    def run(batches):
        s, m = shingler(words), MinHash(hashes, seed)
        for b in batches:
            ids, cid, n, sig = [], [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                g = s.grams(t.as_py())
                ids.append(d)
                n.append(len(g))
                cid.append(class_of(g) if len(g) else None)
                sig.append(m.signature(g).tobytes() if len(g) else None)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "th": b.column("th"), "cid": pa.array(cid, pa.int64()),
                                              "n_grams": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.binary())})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, cid long, n_grams long, sig binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """(cid, band, key): one row per class and band."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            k = band_keys(np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(b.num_rows, -1))
            yield pa.RecordBatch.from_pydict({
                "cid": pa.array(np.repeat(np.array(b.column("cid")), k.shape[1])),
                "band": pa.array(np.tile(np.arange(k.shape[1], dtype=np.int32), len(k))),
                "key": pa.array(k.ravel().view(np.int64))})

    return classes.select("cid", "sig").mapInArrow(run, "cid long, band int, key long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of the nodes of ``edges(u, v)``, ``root`` the smallest
    node of the connected component: alternating large-star and small-star
    rounds (Kiveris et al. 2014), each a min-aggregate and a join; rounds end
    when every node has one parent and no parent has a parent."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, name)
        down = large.where("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        e = stored(small, name)
        # open while a node has two parents or a parent has a parent
        parents = e.select(F.col("v").alias("u")).distinct()
        open_nodes = e.groupBy("u").count().where("count > 1").select("u").union(e.select("u").join(parents, "u", "left_semi"))
        if not open_nodes.head(1):
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def compare_groups(members: DataFrame, docs_words: int, hashes: int, seed: int, tolerance: float, threshold) -> DataFrame:
    """(cid, links, root) from ``members(gid, band, a, b, side, cid, copies,
    text)``: one row per class and task group it is dealt to."""
    floor = least_matches(threshold[0] / threshold[1], tolerance, hashes)

    def run(batches):
        s, m = shingler(docs_words), MinHash(hashes, seed)
        key, group = None, None

        def result(g):
            cid, links, root = g.compare(floor, threshold)
            return pa.RecordBatch.from_pydict({"cid": pa.array(cid), "links": pa.array(links), "root": pa.array(root)})

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("gid", "band", "a", "b", "side", "cid", "copies")), b.column("text"))
            for gid, band, x, y, side, cid, copies, text in rows:
                if key != (gid, band, x, y):
                    if group is not None:
                        yield result(group)
                    key, group = (gid, band, x, y), Group(band, x == y)
                if group.cid and group.cid[-1] == cid:  # the row repeats
                    continue
                g = s.grams(text.as_py())
                if class_of(g) != cid:  # another text of a repeated doc_id
                    continue
                group.cid.append(cid)
                group.copies.append(copies)
                group.sig.append(m.signature(g))
                group.sets.append(g)
                group.side.append(side)
        if group is not None:
            yield result(group)

    dealt = (members.repartition("gid", "band", "a", "b")
             .sortWithinPartitions("gid", "band", "a", "b", "side", "cid"))
    return dealt.mapInArrow(run, "cid long, links long, root long")


def similarity_classes(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD,
                       hashes: int = HASHES, tolerance: float = TOLERANCE, seed: int = 11,
                       task_grams: int = TASK_GRAMS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: (doc_id, class_id, copy_id,
    n_copies, n_links, th, class_key).

    ``copy_id`` is the smallest doc_id of the texts with the same n-gram set,
    ``n_copies`` their number; ``n_links`` the number of other rows whose
    similarity reaches the threshold, copies included; ``class_id`` the
    smallest doc_id of the connected component of links.  Texts without words
    (null, empty, blank) take no part: class and copy are the row's own id,
    ``n_copies`` 1 and ``n_links`` 0.  Rows that repeat are copies of each
    other.  ``th`` hashes the text, and ``class_key`` tells classes apart even
    where ids repeat (null for a text without words)."""
    rows = stored(signatures(docs, words, hashes, seed), "jaccard-signatures")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"),
                                      F.first("n_grams").alias("n_grams"), F.first("sig").alias("sig"))
    classes = stored(classes, "jaccard-classes")
    bands = band_rows(classes)  # the key of a band holds its number
    buckets = bands.groupBy("key").agg(F.min("cid").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stored(bands.join(buckets, "key").select("cid", "band", "key", "low"), "jaccard-buckets")
    candidate = components(shared.where("cid <> low").select(F.col("cid").alias("u"), F.col("low").alias("v")), "jaccard-candidates")

    info = classes.select("cid", "copy_id", "copies", "n_grams")
    nodes = stored(candidate.withColumnRenamed("node", "cid").join(info, "cid"), "jaccard-nodes")
    weight = nodes.groupBy("root").agg(F.sum("n_grams").alias("grams"))
    nodes = nodes.join(weight, "root")
    fits = nodes.where(F.col("grams") <= task_grams).select(
        F.col("root").alias("gid"), F.lit(-1).alias("band"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "cid", "copy_id", "copies")
    large = nodes.where(F.col("grams") > task_grams).select("cid", "copy_id", "copies", "n_grams")
    held = large.join(shared.select("cid", "band", "key"), "cid")
    blocks = held.groupBy("band", "key").agg(F.ceil(2 * F.sum("n_grams") / task_grams).cast("int").alias("nb"))
    held = (held.join(blocks, ["band", "key"])
            .withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .select(F.col("key").alias("gid"), "band", F.least("blk", "other").alias("a"), F.greatest("blk", "other").alias("b"),
                    (F.col("blk") > F.col("other")).cast("int").alias("side"), "cid", "copy_id", "copies"))
    dealt = fits.union(held)
    texts = docs.select(F.col("doc_id").alias("copy_id"), "text")
    members = dealt.join(texts.withColumnRenamed("copy_id", "id"), F.col("copy_id").eqNullSafe(F.col("id"))).select("gid", "band", "a", "b", "side", "cid", "copies", "text")
    found = stored(compare_groups(members, words, hashes, seed, tolerance, threshold), "jaccard-links")

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")), "jaccard-components")
    same = linked.withColumnRenamed("node", "cid").join(info.select("cid", "copy_id"), "cid")
    first = same.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    per_class = stored(info.select("cid", F.col("copy_id").alias("first_id"), "copies")
                       .join(links, "cid", "left").join(same.select("cid", "root").join(first, "root").select("cid", "root", "class_id"), "cid", "left"), "jaccard-per-class")
    ids = rows.select("doc_id", "th", "cid")
    worded = join_split(ids.where("cid is not null"), per_class, ["cid"], "copies")
    return worded.unionByName(ids.where("cid is null"), allowMissingColumns=True).select(
        "doc_id", F.coalesce("class_id", "first_id", "doc_id").alias("class_id"), F.coalesce("first_id", "doc_id").alias("copy_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        "th", F.coalesce("root", "cid").alias("class_key"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each similarity class: the one with the
    smallest doc_id (repeated ids: the smallest text hash).  Texts without
    words stay; rows that repeat doc_id and text stay once."""
    found = stored(similarity_classes(docs.select("doc_id", "text"), **options), "jaccard-digest")
    worded = found.where("class_key is not null")
    first = worded.groupBy("class_key").agg(F.min(F.struct("doc_id", "th")).alias("x")).select("x.*")
    keep = first.union(found.where("class_key is null").select("doc_id", "th").distinct())
    doc, th = fresh("__kept_doc", docs), fresh("__kept_th", docs)
    keep = keep.withColumnsRenamed({"doc_id": doc, "th": th})
    out = docs.join(keep, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left_semi")
    again = found.groupBy("doc_id", "th").count().where("count > 1")
    return out.dropDuplicates(["doc_id", "text"]) if again.head(1) else out
