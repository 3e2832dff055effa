"""Quality classifier from positive and unlabelled texts.

Trusted positives and unlabelled web text train a logistic model that minimises the
non-negative unbiased risk: with a class prior p, the negatives' risk is what the
unlabelled texts have as negatives less p times what the positives have, and where that
falls under zero (over-fitting) the step climbs instead. No text is ever taken for a
known negative. The prior is estimated first: for a model of positives against unlabelled
texts, the share of unlabelled texts above a score can't be less than p times the share of
positives above it, so the least ratio over scores, on texts that the model did not see,
bounds p from above and meets it where a region holds no negatives.

Training runs on at most about ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` texts, drawn by a
hash of their ids; every text is scored, whole, by one pass over the table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import named, text_blocks

#: Bounds of the training sample (expected rows, seeded by a hash of the id).
MOST_POSITIVE, MOST_UNLABELLED = 4000, 8000
#: Hashed byte trigrams; the trigrams of a text are counted, scaled and take the root.
BUCKETS = 1024
EPOCHS, BATCH, RATE, DECAY = 60, 512, 0.01, 1e-3
#: A region must hold this share of the positives to count for the prior.
LEAST_SHARE = 0.3

_CLASSES = np.zeros(256, np.int64)  # 0: beyond ASCII, lower case, upper case, digit, white space, newline, sentence mark, other
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:?'\"()-"), 1):
    _CLASSES[list(_chars)] = _k
_CLASSES[[b for b in range(128) if not _CLASSES[b]]] = 7
N_DENSE = 8 + 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of figures for each text; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    out = np.zeros((n, N_DENSE + BUCKETS), np.float32)
    per = np.maximum(size, 1)[:, None]
    out[:, :8] = np.bincount(row * 8 + _CLASSES[data], minlength=8 * n).reshape(n, 8) / per
    if len(data) >= 3:
        b = data.astype(np.uint64)
        gram = words.mix(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) >> np.uint64(54)
        own = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][own] * BUCKETS + gram[own].astype(np.int64), minlength=BUCKETS * n).reshape(n, BUCKETS)
        out[:, N_DENSE:] = np.sqrt(counts / per)
    starts, ends, rows = words.spans(data, offsets, words.SPACED)
    h = words.hashes(data, starts, ends, folded=True)
    pairs = words.chained(h, 2, 13)
    for i in range(n):
        lo, hi = rows[i], rows[i + 1]
        if hi == lo:
            continue
        m = hi - lo
        count = np.unique(h[lo:hi], return_counts=True)[1]
        out[i, 8] = len(count) / m
        out[i, 9] = count.max() / m
        out[i, 10] = len(np.unique(pairs[lo : hi - 1])) / max(1, m - 1)
        out[i, 11] = (h[lo + 1 : hi] == h[lo : hi - 1]).mean() if m > 1 else 0
        out[i, 12] = (ends[lo:hi] - starts[lo:hi]).mean() / 20
        out[i, 13] = np.log1p(m) / 10
        p = count / m
        out[i, 14] = -(p * np.log2(p)).sum() / 10
        out[i, 15] = len(count) / np.sqrt(m) / 10
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -40, 40)))


def _fit(p: np.ndarray, u: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights of a logistic model by Adam on the non-negative risk of sigmoid losses."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(p.shape[1]), 0.0
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    steps = max(1, len(u) // BATCH)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(EPOCHS):
        pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
        for s in range(steps):
            xp, xu = p[pi[s::steps]], u[ui[s::steps]]
            if not len(xp) or not len(xu):
                continue
            zp, zu = xp @ w + b, xu @ w + b
            sp, su = sigmoid(zp), sigmoid(zu)
            # Logistic losses: softplus(-z) for a positive, softplus(z) for a negative.
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            grad_n = np.append(xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp), su.mean() - prior * sp.mean())
            grad_p = prior * np.append(xp.T @ (sp - 1) / len(xp), (sp - 1).mean())
            g = grad_p + grad_n if negative >= 0 else -grad_n
            g[:-1] += DECAY * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return w, b


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int = 3) -> float:
    """The share of positives among unlabelled texts, from two halves of either sample."""
    rng = np.random.default_rng(seed)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    bounds = []
    for k in (0, 1):
        w, b = _fit(p[k::2], u[k::2], 0.5, seed)
        sp, su = np.sort(p[1 - k :: 2] @ w + b), np.sort(u[1 - k :: 2] @ w + b)
        if not len(sp) or not len(su):
            continue
        at = np.quantile(sp, np.linspace(0, 1 - LEAST_SHARE, 60))
        over_p, over_u = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
        # One deviation above the least ratio: the minimum of noisy ratios is low.
        ratio = over_u / over_p + np.sqrt(over_u * (1 - over_u) / len(su)) / over_p
        bounds.append(ratio.min())
    return float(np.clip(np.mean(bounds), 0.05, 0.98)) if bounds else 0.5


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> Model:
    """A model from two matrices of figures; with no rows of a kind it scores all texts 0.5."""
    both = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, N_DENSE + BUCKETS))
    mean, scale = both.mean(axis=0, dtype=np.float64), both.std(axis=0, dtype=np.float64) + 1e-3
    if not len(positive) or not len(unlabelled):
        return Model(mean, scale, np.zeros(len(mean)), 0.0, 0.5)
    # One weight for all trigram buckets, another for the figures, so that both kinds have a say.
    scale[N_DENSE:] *= np.sqrt(BUCKETS / N_DENSE) / 4
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    prior = estimate_prior(p, u)
    w, b = _fit(p, u, prior, seed)
    return Model(mean, scale, w, b, prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 3 == 1


def _place(seed: int, key: Column) -> Column:
    """A fixed place in [0, 1) for each key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / float(1 << 40)


def _drawn(docs: DataFrame, most: int, seed: int) -> DataFrame:
    """About ``most`` of the distinct rows (by id and text), by a hash of the id, or of the text where there is none."""
    docs = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    n = docs.select("doc_id", "crc").distinct().count()
    return docs.where(_place(seed, F.coalesce("doc_id", "crc")) < min(1.0, most / max(1, n))).dropDuplicates(["doc_id", "crc"])


def _matrix(docs: DataFrame) -> np.ndarray:
    """Figures of a bounded sample, in a fixed order."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32(r["x"])))
    return np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), N_DENSE + BUCKETS)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """A model from ``docs`` (doc_id, text) and the positives among ``labels`` outside the held-out fold."""
    trusted = labels.where((F.col(label_col) == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    trusted = F.broadcast(trusted.where(_place(31, F.col("doc_id")) < min(1.0, MOST_POSITIVE / max(1, trusted.count()))))  # about MOST_POSITIVE ids
    open_ids = docs.where(~held_out(F.col("doc_id")))
    positive = docs.join(trusted, "doc_id", "left_semi").withColumn("crc", F.crc32(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "crc"])
    return fit(_matrix(positive), _matrix(_drawn(open_ids, MOST_UNLABELLED, 32)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted, a row per input row.

    A null text is scored like an empty one. Repeated rows each get a row and enter the
    sample once; a row without an id may enter it by its text. Without positives or without texts to learn from, all scores are 0.5.
    Scores see the text only; other columns are not read.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), named(text_col, "text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), label_col), label_col))

    def run(batches):
        model = sent.value
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.scores(features(data, offsets)), pa.float64())], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
