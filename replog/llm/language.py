"""Operator 10: language identification by nearest centroid.

A text becomes a vector of hashed letter n-grams (one to three letters, with word ends), weighted by TF-IDF and normalised. Document
frequencies are counted over all documents that may be learned from. Each language has several centroids, clustered by spherical k-means over a bounded sample of its
labelled documents; the language of the nearest centroid by cosine is predicted, and a text farther from every centroid than nearly all
training documents of that language is rejected.

Edge cases: a text that is null or has no letter is `und`, score 0, and rejected; rows without a language teach nothing; without any learnable
row every text is `und`; equal similarities go to the language first by code point; a null id is in fold 0; rows that repeat are predicted
each, and sampled once; long texts are read whole; `recognised` keeps further columns as they are, whatever their names; with more languages
than the sample has documents, those are learned that the sample meets, one document each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROWS, fold, fresh, map_batches, pieces, plain, texts

#: Dimensions of the hashed vectors.
DIM = 4096
#: Labelled documents that the centroids are fitted on, about, shared equally by the languages.
SAMPLE = 5000
CENTROIDS = 4
#: Centroids in all, about: with more languages than a fourth of these, each has fewer, one at least. With SAMPLE this bounds what is broadcast.
MOST_CENTROIDS = 2000
#: A text is rejected if its cosine is below this share of the lowest hundredth of its language's training cosines.
SLACK = 0.5
SHARPNESS = 20.0


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def counts(docs: list[str]) -> np.ndarray:
    """A row of n-gram counts for each text, all of it."""
    out = np.zeros((len(docs), DIM), np.float32)
    for k, text in enumerate(docs):
        # the lower-cased code points; every other run of characters is one gap
        c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        is_letter = letters()[c]
        c = np.where(is_letter, c, 0)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        c = np.concatenate(([0], c[keep], [0])).astype(np.uint32)
        if len(c) < 4 and not c.any():
            continue
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
        grams = np.concatenate((c[c > 0] * np.uint32(0xC2B2AE35), two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)))
        out[k] = np.bincount((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=DIM)
    return out


def vectors(docs: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(docs)) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def predict(self, docs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The language, its score, its cosine and whether the text is rejected, for each text."""
        first = np.flatnonzero(np.diff(self.owner, prepend=-1))
        found, score, near, out = ["und"] * len(docs), np.zeros(len(docs)), np.zeros(len(docs)), np.ones(len(docs), bool)
        for a in range(0, len(docs) if self.langs else 0, 256):
            x = vectors(docs[a : a + 256], self.idf)
            cos = x @ self.centroids.T
            by_lang = np.maximum.reduceat(cos, first, axis=1)
            best = by_lang.argmax(1)
            top = by_lang[np.arange(len(x)), best]
            soft = np.exp(SHARPNESS * (by_lang - top[:, None]))
            for j in np.flatnonzero(x.any(1)):
                found[a + j] = self.langs[best[j]]
                near[a + j], score[a + j] = max(0.0, top[j]), 1 / soft[j].sum()
                out[a + j] = top[j] < self.floor[best[j]]
        return found, score, near, out


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of normalised rows by spherical k-means, started from rows spread out by distance."""
    at = [0]
    while len(at) < min(k, len(x)):
        at.append(int((x @ x[at].T).max(1).argmin()))
    c = x[at]
    for _ in range(rounds):
        mine = (x @ c.T).argmax(1)
        c = np.stack([x[mine == j].mean(0) if (mine == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all of docs (doc_id, text): each task sums its own, so that DIM rows a task are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM + 1, np.int64)
        for b in pieces(batches):
            df[:DIM] += (counts(texts(b)) > 0).sum(0)
            df[DIM] += b.num_rows
        yield pa.record_batch([pa.array(np.arange(DIM + 1), pa.int32()), pa.array(df, pa.int64())], ["bucket", "n"])

    total = np.zeros(DIM + 1)
    for r in docs.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n
    return np.log((1 + total[DIM]) / (1 + total[:DIM])).astype(np.float32) + 1


def fit(docs: DataFrame, learn, sample: int = SAMPLE, centroids: int = CENTROIDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits centroids on about sample documents, as many of each language, chosen by a hash of id and text among the rows where learn holds.

    Equal rows count once in the sample. Nothing of other rows is looked at: document frequencies too are those of the rows where learn holds."""
    lang, mark = fresh(docs, "lang", "mark")
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias(lang), F.xxhash64(id_col, text_col, F.lit("fit")).alias(mark))
    # one row a language, the first by a hash, and one more than the sample may meet
    langs = [r[0] for r in rows.select(lang).distinct().orderBy(F.xxhash64(lang), lang).limit(sample + 1).collect()]
    taught = rows
    if len(langs) > sample:
        met = docs.sparkSession.createDataFrame([(x,) for x in langs[:sample]], f"`{lang}` string")
        langs, taught = langs[:sample], rows.join(F.broadcast(met), lang, "left_semi")
    langs = sorted(langs)
    if not langs:
        return Model([], np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0))
    # a language's documents up to the hash of that rank; tasks send no more than so many hashes of a language
    place = F.row_number().over(W.partitionBy(lang).orderBy(mark))
    last = taught.select(lang, mark).withColumn("place", place).filter(F.col("place") <= max(1, sample // len(langs))).groupBy(lang).agg(F.max(mark).alias("last"))
    chosen = taught.join(F.broadcast(last), lang).filter(F.col(mark) <= F.col("last")).groupBy(lang, mark).agg(F.min("text").alias("text"))
    # vectors are made by the tasks; the driver gets packed sparse ones, about sample in all
    taken = map_batches(chosen.select(mark, "text", lang), _sparse, "lang string, at binary, n binary", ROWS).collect()
    idf = inverse_frequencies(rows.select("doc_id", "text"))
    centroids, by_lang = max(1, min(centroids, MOST_CENTROIDS // len(langs))), {}
    for r in taken:
        by_lang.setdefault(r.lang, []).append(r)
    parts, owner, floor = [], [], []
    for k, lang in enumerate(langs):
        x = np.zeros((len(by_lang[lang]), DIM), np.float32)
        for j, r in enumerate(by_lang[lang]):
            x[j, np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.n, np.float32)
        x = np.log1p(x) * idf
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
        x = x[x.any(1)]
        if not len(x):
            x = np.zeros((1, DIM), np.float32)
        x = x[np.lexsort(x[:, :8].T)]
        c = clusters(x, centroids)
        parts.append(c)
        owner += [k] * len(c)
        floor.append(SLACK * float(np.quantile((x @ c.T).max(1), 0.01)))
    return Model(langs, idf, np.concatenate(parts), np.array(owner), np.array(floor))


def _sparse() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        at, n = [], []
        for x in counts(texts(b)):
            some = np.flatnonzero(x)
            at.append(some.astype(np.uint16).tobytes())
            n.append(x[some].tobytes())
        return pa.record_batch([b.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["lang", "at", "n"])

    return one


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cosine and rejected for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids: languages times CENTROIDS times DIM floats
    kind = docs.schema[id_col].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        m = shared.value

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            new = m.predict(texts(b))
            return pa.record_batch([b.column(0), *map(pa.array, new)], ["doc_id", "lang_pred", "score", "cosine", "rejected"])

        return one

    return map_batches(plain(docs, id_col, text_col), make, f"doc_id {kind}, lang_pred string, score double, cosine double, rejected boolean", ROWS)


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        m = shared.value
        return lambda b: b.filter(pa.array(~m.predict([t or "" for t in b.column(at).to_pylist()])[3]))

    return map_batches(docs, make, docs.schema, ROWS)


def learnable(id_col: str = "doc_id"):
    """The rows that predictions may learn from: all but the held-out fold."""
    return fold(id_col, 3) != 1
