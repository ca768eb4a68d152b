"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts is the number of character
n-grams (n = 1..``max_n``) that occur in both, over the geometric mean of
their own numbers of n-grams.  Nystroem landmarks (a bounded sample of
training texts) turn it into ``m`` features; one-versus-rest kernel ridge
regression is fitted on them, and texts are scored in batches by matrix
products: presence rows x landmark matrix x coefficients.

Whether a text is in a learned language at all is told from the share of its
words' n-grams that landmarks of the predicted language hold, against a bound
fitted on that language's training rows; no other label enters into it.

N-grams are counted in ``2 ** HASH_BITS`` hash buckets.  Texts are read
whole, in pieces that overlap by ``max_n - 1`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from marketlex.llm.base import stored, where_text

HASH_BITS = 18
PIECE = 1 << 20          # code points hashed at a time
BATCH = 128              # texts of one matrix product
MIX = np.uint64(0x9E3779B97F4A7C15)
LETTER = regex.compile(r"\p{L}")
WORD = regex.compile(r"[\p{L}\p{M}]+")
BLANK = ((ord(" ") + 1) * int(MIX) % (1 << 64)) >> (64 - HASH_BITS)  # bucket of the blank
UNDETERMINED = "und"
LOW, SLACK = 0.05, 0.5   # the bound: this quantile of the training rows' shares, times this


def presence(text: str, max_n: int) -> np.ndarray:
    """Which hash buckets the n-grams of the lower-cased text fall in."""
    seen = np.zeros(1 << HASH_BITS, bool)
    codes = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), "<u4")
    shift = np.uint64(64 - HASH_BITS)
    for at in range(0, max(1, len(codes)), PIECE):
        c = codes[at:at + PIECE + max_n - 1].astype(np.uint64) + np.uint64(1)
        h = c
        for n in range(1, max_n + 1):
            if n > 1:
                if len(h) < 2:
                    break
                h = h[:-1] * np.uint64(1_000_003) + c[n - 1:]
            x = (h ^ (h >> np.uint64(29))) * MIX
            seen[(x >> shift).astype(np.intp)] = True
    return seen


def word_presence(text: str, max_n: int) -> np.ndarray:
    """``presence`` of the words alone: digits, signs and the blank are in
    texts of any language."""
    seen = presence(" ".join(WORD.findall(text)), max_n)
    seen[BLANK] = False
    return seen


class KernelModel:
    """Landmarks, their n-gram columns and the regression coefficients."""

    def __init__(self, landmarks: list[str], langs: list[str], max_n: int):
        self.max_n = max_n
        self.place = {x: k for k, x in enumerate(sorted(set(langs)))}
        self.holders = np.zeros((len(self.place), 1 << HASH_BITS), np.uint8)  # landmarks of a label with the n-gram: 0, 1, 2 or more
        for t, x in zip(landmarks, langs):
            held = self.holders[self.place[x]]
            np.minimum(held + word_presence(t, max_n), 2, out=held)
        self.chance = np.array([[(h >= c).mean() for c in (1, 2)] for h in self.holders])
        self.bound = np.zeros(len(self.place))
        rows = [presence(t, max_n) for t in landmarks]
        used = np.zeros(1 << HASH_BITS, bool)
        for r in rows:
            used |= r
        self.buckets = np.flatnonzero(used).astype(np.int32)
        self.land = np.array([r[self.buckets] / np.sqrt(max(1, r.sum())) for r in rows], np.float32).reshape(len(rows), -1)
        self.labels: list[str] = []
        self.coef = np.zeros((len(rows) + 1, 0))

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts against all landmarks."""
        x = np.empty((len(texts), len(self.buckets)), np.float32)
        norm = np.empty(len(texts), np.float32)
        for k, t in enumerate(texts):
            seen = presence(t, self.max_n)
            x[k] = seen[self.buckets]
            norm[k] = np.sqrt(max(1, np.count_nonzero(seen)))
        return (x @ self.land.T) / norm[:, None]

    def known(self, text: str, label: str, landmark: bool = False) -> tuple[float, int]:
        """Share of the n-grams of the text's words that landmarks of the label
        hold, less what buckets shared by chance give, and the number of
        n-grams.  A ``landmark`` counts by what the other ones hold."""
        at = np.flatnonzero(word_presence(text, self.max_n))
        if not len(at):
            return 0.0, 0
        k, least = self.place[label], 2 if landmark else 1
        chance = self.chance[k, least - 1]
        return float(((self.holders[k, at] >= least).mean() - chance) / max(1e-9, 1 - chance)), len(at)

    def told(self, text: str, label: str) -> bool:
        """Whether the text shows the label: as many of its n-grams known as
        the label's bound asks, less ``sqrt(n)`` as few say little."""
        share, n = self.known(text, label)
        return share * n > max(0.0, self.bound[self.place[label]] * n - np.sqrt(n))

    def fit(self, kernel_rows: np.ndarray, labels: list[str], shares: list[float], ridge: float) -> None:
        """One-versus-rest ridge regression on the Nystroem features, and each
        label's bound from the known ``shares`` of its rows."""
        for x, k in self.place.items():
            self.bound[k] = SLACK * max(0.0, np.quantile([v for v, y in zip(shares, labels) if y == x], LOW))
        self.labels = sorted(set(labels))
        w = (self.land @ self.land.T).astype(np.float64)
        value, vector = np.linalg.eigh((w + w.T) / 2)
        keep = value > 1e-6 * max(value[-1], 1e-12)
        half = vector[:, keep] / np.sqrt(value[keep])
        phi = np.hstack([kernel_rows @ half, np.ones((len(kernel_rows), 1))])
        y = np.where(np.array(labels)[:, None] == np.array(self.labels)[None, :], 1.0, -1.0)
        a = phi.T @ phi + ridge * np.eye(phi.shape[1])
        beta = np.linalg.solve(a, phi.T @ y)
        self.coef = np.vstack([half @ beta[:-1], beta[-1:]])

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.coef[:-1] + self.coef[-1]


def sample_rows(rows: DataFrame, per_label: int, max_rows: int, seed: int) -> DataFrame:
    """``rows`` (text, lang) with place ``k`` among the sampled rows of the
    label: the first ``per_label`` rows of each label by a hash of the row
    (all, if fewer).  With more than ``max_rows / per_label`` labels each keeps
    ``max_rows // labels``, and one at least, so no label goes missing."""
    sizes = stored(rows.groupBy("lang").count(), "lang-sizes")  # one row per label
    share = min(per_label, max(1, max_rows // max(1, sizes.count())))
    ample = share + share // 4 + 64  # thinned first: no window sees a whole label
    h = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 20))
    thin = (rows.join(F.broadcast(sizes), "lang")
            .withColumn("__h", h).where(F.col("__h") * F.col("count") < ample * (1 << 20)))
    by_label = Window.partitionBy("lang").orderBy("__h", "doc_id", "text")
    return thin.select("text", "lang", F.row_number().over(by_label).alias("k")).where(F.col("k") <= share)


def fit_language_model(train: DataFrame, max_n: int = 3, landmarks_per_label: int = 48,
                       rows_per_label: int = 600, ridge: float = 0.3, max_rows: int = 20_000, max_landmarks: int = 480) -> KernelModel | None:
    """Fit on ``train(doc_id, text, lang)``; rows without text, label or any
    letter are left out.  Sample bounds (documented parameters):
    ``landmarks_per_label`` and ``rows_per_label``; ``max_landmarks`` and
    ``max_rows`` in all, shared out evenly among the labels, one at least for
    each.  Returns None if there is nothing to learn from."""
    usable = train.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    rows = sample_rows(usable, rows_per_label, max_rows, 7)
    land = rows.where(F.col("k") <= landmarks_per_label).orderBy("lang", "k").select("text", "lang", "k").collect()
    if not land:
        return None
    landmarks_per_label = min(landmarks_per_label, max(1, max_landmarks // len({r.lang for r in land})))
    land = [r for r in land if r.k <= landmarks_per_label]
    model = KernelModel([r.text for r in land], [r.lang for r in land], max_n)
    shipped = train.sparkSession.sparkContext.broadcast(model)

    def kernel_rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                texts, langs, places = (part.column(c).to_pylist() for c in ("text", "lang", "k"))
                k = shipped.value.kernel(texts).astype("<f4")
                share = [shipped.value.known(t, x, p <= landmarks_per_label)[0] for t, x, p in zip(texts, langs, places)]
                yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "k": pa.array([r.tobytes() for r in k], pa.binary()), "share": pa.array(share, pa.float64())})

    got = rows.repartition(32).mapInArrow(kernel_rows, "lang string, k binary, share double").collect()
    model.fit(np.array([np.frombuffer(r.k, "<f4") for r in got], np.float64), [r.lang for r in got], [r.share for r in got], ridge)
    return model


def languages(m: KernelModel | None, texts: list, told_only: bool) -> tuple[list[str], np.ndarray]:
    """Predicted languages and scores of a few texts (see ``with_language``)."""
    lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    ask = [k for k, t in enumerate(texts) if t and m is not None and LETTER.search(t)]
    if ask:
        s = m.scores([texts[k] for k in ask])
        best = s.argmax(axis=1)
        for k, j, v in zip(ask, best, s[np.arange(len(ask)), best]):
            if not told_only or m.told(texts[k], m.labels[j]):
                lang[k], score[k] = m.labels[j], min(1.0, max(0.0, (float(v) + 1) / 2))
    return lang, score


def with_language(docs: DataFrame, model: KernelModel | None, told_only: bool = False) -> DataFrame:
    """``docs`` with (lang_pred, score) of every whole ``text``; nothing but
    the text is read, other columns pass through (columns of these two names
    are replaced).

    A text that is null or has no letter is ``und`` with score 0, as is
    everything if there is no model; the score is the regression value of the
    predicted language mapped from [-1, 1] to [0, 1] and clipped.  With
    ``told_only`` so is a text that does not show the language predicted."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                rows = b.slice(at, BATCH)
                lang, score = languages(shipped.value, rows.column("text").to_pylist(), told_only)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=[*rows.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def predict_language(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) of ``docs(doc_id, text)``."""
    return with_language(docs.select("doc_id", "text"), model).drop("text")


def drop_undetermined(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """``docs`` without the texts whose language cannot be told: null or
    without a letter, or in no language or script learned (``told``).  Only
    the text goes to Python; all columns stay, whatever their names."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def told(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            yield pa.array([x != UNDETERMINED for at in range(0, len(c), BATCH) for x in languages(shipped.value, c.slice(at, BATCH).to_pylist(), True)[0]], pa.bool_())

    return where_text(docs, told)
