"""Quality scores by positive-unlabelled learning.

Trusted positives are documents that labels call good; everything else about quality is taken from unlabelled documents.
The share of good ones among these is estimated from how rarely scores that positives reach are reached by unlabelled
ones, and a small network minimises the non-negative unbiased risk: what positives and unlabelled documents say of the
negatives' loss is never driven below zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, Words, map_texts, table, text_bytes
from .labelled import fold, sample, with_text

#: Positives, and unlabelled documents, that the network is fitted on at most.
SAMPLE = 12_000
HIDDEN, STEPS = 16, 1500
_CLASS = np.zeros(256, np.int64)  # of a byte: 0 control, then the kinds below
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256), b" ", b"\n", b".", b",", b"!?", b"*%$&#", b"|", b"<>/=", b"{}[]();:_\\", b"-'\"", b"@+~^`"), 1):
    _CLASS[list(_bytes)] = _k
CLASSES = int(_CLASS.max()) + 1


def features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text: shares of kinds of bytes, lengths, and how far words and lines repeat."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    shares = kinds / np.maximum(size, 1)[:, None]
    w = Words(column, NOT_SPACE)
    own, counts = w.doc, np.maximum(w.counts, 1)
    mixed = np.sort(w.hashes >> np.uint64(24) | own.astype(np.uint64) << np.uint64(40))  # by text, 40 bits of hash
    key = (mixed[np.append(True, mixed[1:] != mixed[:-1])[: len(mixed)]] >> np.uint64(40)).astype(np.int64)
    length = w.ends - w.starts
    first, last = (w.raw[w.starts], w.raw[w.ends - 1]) if len(own) else (np.zeros(0, np.uint8),) * 2
    upper = _CLASS[raw[w.starts]] == 2 if len(own) else np.zeros(0, bool)
    mean = lambda x: np.bincount(own, x, n) / counts
    rows = np.stack([
        np.log1p(size), np.bincount(key, minlength=n) / counts, mean(length), np.sqrt(np.maximum(0, mean(length.astype(float) ** 2) - mean(length) ** 2)), mean(length > 20), mean(length == 1),
        mean(_CLASS[last] >= 9), mean(_CLASS[first] >= 9), mean(upper), mean(_CLASS[last] == 2), w.counts / np.maximum(kinds[:, 6] + 1, 1) / 50, (kinds[:, 2] > kinds[:, 1]).astype(float),
    ], axis=1)
    return np.concatenate([np.sqrt(shares), rows], axis=1)


class Network:
    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that unlabelled scores allow: the least ratio of how often both exceed a score."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.6, 30))
    p = np.array([(positive >= t).mean() for t in cuts])
    u = np.array([(unlabelled >= t).mean() for t in cuts])
    noise = 1 / np.sqrt(max(1, min(len(positive), len(unlabelled))))
    return float(np.clip(np.min((u + noise) / np.maximum(p, 1e-9)), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> tuple[Network, float]:
    """The network and the estimated class prior. Without positives or unlabelled rows all scores are 0.5."""
    d = positive.shape[1]
    if not len(positive) or not len(unlabelled):
        return Network(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0), 0.5
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    draw = np.random.default_rng(seed)

    def train(prior: float | None) -> Network:
        p = [draw.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 0.3, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
        P, U = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
        for step in range(1, STEPS + 1):
            a, b = P[draw.integers(0, len(P), 256)], U[draw.integers(0, len(U), 256)]
            x = np.concatenate([a, b])
            h = np.tanh(x @ p[0] + p[1])
            s = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30)))
            sp, su = s[:256], s[256:]
            g = np.zeros(512)
            if prior is None:  # positives against unlabelled
                g[:256], g[256:] = (sp - 1) / 256, su / 256
            else:  # sigmoid loss: 1 - s of a positive, s of a negative
                slope = s * (1 - s) / 256
                if su.mean() - prior * sp.mean() >= 0:
                    g[:256], g[256:] = -2 * prior * slope[:256], slope[256:]
                else:  # the negatives' part fell below zero: step back from it
                    g[:256], g[256:] = prior * slope[:256], -slope[256:]
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [x.T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))

    rough = train(None)
    prior = estimate_prior(rough.logits(positive), rough.logits(unlabelled))
    return train(prior), prior


def feature_rows(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def start():
        return lambda batch: [pa.array(list(features(batch.column(text))), pa.list_(pa.float64()))]

    return map_texts(rows, [T.StructField("x", T.ArrayType(T.DoubleType()))], start, keep, text)


def score_quality(docs: DataFrame, labels: DataFrame, train_fold, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, limit: int = SAMPLE) -> DataFrame:
    """docs with score (0 to 1) and predicted (score at or over threshold).

    train_fold: condition on doc_id of rows that may be learnt from. At most limit positives (label 1) and as many
    documents without regard to labels are fitted on, chosen by a hash of the id; every row is scored, on its text alone.
    Null texts are empty; labels without document, null labels and repeated labels do no harm. Without usable labels
    every score is 0.5. An empty table gives no rows; repeated rows are scored alike, and a score at the threshold is
    predicted 1. A text of up to 2 GiB is held whole in a task. An input column named like a result gives way to it.
    """
    good = sample(labels.where(train_fold).where(F.col(label) == 1).select(doc_id).where(F.col(doc_id).isNotNull()).distinct(), doc_id, limit)
    rows = lambda chosen: np.array([r.x for r in feature_rows(with_text(docs, chosen, doc_id, text), text, []).collect()]).reshape(-1, CLASSES + 12)
    other = sample(docs.where(train_fold).select(doc_id).where(F.col(doc_id).isNotNull()).distinct(), doc_id, limit)
    network, _ = fit(rows(good), rows(other))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def start():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            s = shared.value.scores(features(batch.column(text)))
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

        return step

    return map_texts(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], start, docs.columns if keep is None else keep, text)


def op9_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
