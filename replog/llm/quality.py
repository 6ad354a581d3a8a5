"""Operator 8: a quality classifier from positive and unlabelled texts.

Trusted positives are learnable rows labelled good; unlabelled texts are documents of any kind, whose labels are not looked at. The class
prior (the share of good texts among the unlabelled) is estimated by the best bin of a first classifier's scores: the smallest ratio of
unlabelled to positive mass above a threshold. A linear model over binned text features then minimises the non-negative unbiased risk
prior * R+(good) + max(0, R-(unlabelled) - prior * R-(positive)).

Edge cases: a null or empty text has a feature bin of its own and is scored like any other; without positives every score is 0.5 and predicted
1; rows that repeat are scored each, but of rows that share an id one is learned from (the first by hash of its text); a null id is in fold 0
and can be among the unlabelled once; equal scores need no order; further columns are not looked at; long texts are read whole; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches, one_each, plain, sampled_labels, texts

#: Positives, and as many unlabelled texts, that the model is fitted on, at most.
SAMPLE = 8000
BINS = 16
#: The ridge penalty against the sum of all rows' losses.
RIDGE = 6.0
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Buckets of hashed words.
BUCKETS = 32
SHAPES = 16 + len(MARKS)
N_FEATURES = SHAPES + BUCKETS


def features(docs: list[str]) -> np.ndarray:
    """Shape, repetition and punctuation of each whole text, and which words it uses: the share of each bucket of hashed lower-cased words."""
    out = np.zeros((len(docs), N_FEATURES), np.float32)
    for k, t in enumerate(docs):
        if not t:
            out[k, 0] = -1
            continue
        n, words = len(t), t.split()
        m = max(1, len(words))
        seen = Counter(words)
        top = seen.most_common(1)[0][1] if seen else 0
        lines = [x for x in t.split("\n") if x.strip()]
        each = Counter(lines)
        repeated = sum(len(x) * (c - 1) for x, c in each.items() if c > 1)
        code = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        hist = np.bincount(code, minlength=256)
        upper, lower, digit = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
        capital = sum(map(str.istitle, words))
        chars = sum(map(len, seen))
        pairs = set(zip(words, words[1:]))
        out[k, :16] = (
            np.log1p(n), np.log1p(m), n / m, len(seen) / m ** 0.8, top / m, len(lines) / m, len(each) / max(1, len(lines)), repeated / n, upper / n, lower / n, digit / n,
            hist[128:].sum() / n, capital / m, chars / max(1, len(seen)), hist[32] / n, len(pairs) / m,
        )
        out[k, 16:SHAPES] = hist[np.frombuffer(MARKS.encode(), np.uint8)] / m
        bucket = np.fromiter((crc32(w.lower().encode("utf-8", "replace")) for w in seen), np.uint32, len(seen)) % BUCKETS
        out[k, SHAPES:] = np.bincount(bucket, np.fromiter(seen.values(), float, len(seen)), BUCKETS) / m
    return out


@dataclass
class Model:
    edges: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of a good text."""
        z = np.full(len(x), self.bias)
        for f in range(x.shape[1] if len(self.weight) else 0):
            z += self.weight[f, np.searchsorted(self.edges[f], x[:, f], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def one_hot(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    at = np.stack([np.searchsorted(edges[f], x[:, f], side="right") for f in range(x.shape[1])], 1)
    return at + np.arange(x.shape[1]) * (edges.shape[1] + 1)


def descend(at: np.ndarray, bins: int, gradient: Callable[[np.ndarray], np.ndarray], rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adam on a linear model over one-hot bins, with steps that shrink, averaged over the last half; gradient gives the derivative of the risk by each row's output."""
    w, b, mean, mean_b = np.zeros(bins), 0.0, np.zeros(bins), 0.0
    m, v, mb, vb = np.zeros(bins), np.zeros(bins), 0.0, 0.0
    for t in range(1, rounds + 1):
        g = gradient(w[at].sum(1) + b)
        gw = np.bincount(at.ravel(), np.repeat(g, at.shape[1]), bins) + decay * w
        gb = g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d, step = 1 - 0.9**t, 1 - 0.99**t, rate * (1 - (t - 1) / rounds)
        w = w - step * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= step * (mb / c) / (np.sqrt(vb / d) + 1e-8)
        if 2 * t > rounds:
            mean, mean_b = mean + w, mean_b + b
    return mean / (rounds - rounds // 2), mean_b / (rounds - rounds // 2)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest ratio of unlabelled to positive mass above a threshold that leaves at least a third of the positives above it."""
    ratios = [(unlabelled >= t).mean() / (positive >= t).mean() for t in np.quantile(positive, np.linspace(0.0, 0.67, 68))]
    return float(np.clip(min(ratios), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 300) -> Model:
    """Fits the non-negative risk; the rows are features."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((0, 0)), np.zeros((0, 0)), 0.0, 0.5)
    x = np.concatenate((positive, unlabelled))
    edges = np.stack([np.quantile(x[:, f], np.arange(1, BINS) / BINS) for f in range(x.shape[1])])
    at, bins = one_hot(x, edges), x.shape[1] * BINS
    p = np.arange(len(x)) < len(positive)
    up, uu = p / p.sum(), ~p / (~p).sum()
    decay = RIDGE / len(x)
    s = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    # first a plain classifier of positive against unlabelled by shape alone, for the prior; halves of the sample take turns so that scores are held out
    held, shape = np.zeros(len(x)), at[:, :SHAPES]
    for half in (0, 1):
        own = np.arange(len(x)) % 2 == half

        def plain(z: np.ndarray, own: np.ndarray = own) -> np.ndarray:
            return np.where(own, s(z) * uu - (1 - s(z)) * up, 0)

        w0, b0 = descend(shape, bins, plain, rounds // 2, 0.05, decay)
        other = ~own
        held[other] = w0[shape[other]].sum(1) + b0
    prior = estimate_prior(held[p], held[~p])

    def risk(z: np.ndarray) -> np.ndarray:
        y = s(z)
        negative = float((uu * np.logaddexp(0, z)).sum()) - prior * float((up * np.logaddexp(0, z)).sum())
        # where the negative part would go below zero it is held at zero, and only the positives' risk is left
        return uu * y - prior * up if negative >= 0 else -prior * up * (1 - y)

    w, b = descend(at, bins, risk, rounds, 0.1, decay)
    # the intercept is set so that the prior's share of the unlabelled is called good
    b -= float(np.quantile(w[at[~p]].sum(1) + b, 1 - prior))
    return Model(edges, w.reshape(-1, BINS), b, prior)


def _features() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column(2), pa.array(list(features(texts(b))), pa.list_(pa.float32()))], ["kind", "x"])

    return one


def train(docs: DataFrame, labels: DataFrame, learn=None, sample: int = SAMPLE) -> Model:
    """Fits on at most sample trusted positives and about as many unlabelled documents, chosen by a hash of the id, one row an id. Neither draw looks at a label that learn excludes, and the second looks at none."""
    learn = fold("doc_id", 3) != 1 if learn is None else learn
    good = sampled_labels(labels.filter(learn & (F.col("quality") == 1)), "quality", sample)
    n = docs.count()
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 20)) < min(1.0, sample / max(1, n)) * (1 << 20))
    trusted = plain(docs.join(F.broadcast(good.select("doc_id")), "doc_id"), "doc_id", "text", F.lit(1).alias("kind"))
    chosen = one_each(trusted, "kind").unionByName(one_each(plain(some, "doc_id", "text", F.lit(0).alias("kind")), "kind"))
    rows = map_batches(chosen, _features, "kind int, x array<float>").collect()
    x = np.array([r.x for r in rows], np.float32).reshape(-1, N_FEATURES)
    kind = np.array([r.kind for r in rows], int)
    order = np.lexsort((*x.T, -kind))
    x, kind = x[order], kind[order]
    rng = np.random.default_rng(0)
    return fit(rng.permutation(x[kind == 1]), rng.permutation(x[kind == 0]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted for every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        return lambda b: pa.record_batch([b.column(0), pa.array(model.score(features(texts(b))), pa.float64())], ["doc_id", "score"])

    return map_batches(plain(docs, id_col, text_col), make, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
