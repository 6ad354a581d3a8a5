"""Operator 6: toxicity by nearest labelled examples.

Examples are a bounded sample of learnable labelled documents, as normalised vectors over every term that two of them share. A term weighs
(1 + log tf) * idf * rf: document frequencies are counted over all documents, and rf = log2(2 + a / max(1, c)) raises terms that stand in more
toxic examples (a) than clean ones (c); it is 1 at least, so no term is left out. Examples lie in an inverted index whose posting lists are
sorted by weight and cut into blocks with their largest weight. Lists that are long and flat are rows of a matrix instead, and what they add
is one product for some texts at a time. A text's other terms go in groups, those that can add most first: blocks that cannot lift an unseen
example to the k-th best so far are skipped, and what is left is scored by exact cosine from its whole vector. Votes weighted by similarity are
calibrated on the examples themselves, each left out of its own neighbours.

Edge cases: a null or empty text, and a text that shares no term with the examples, has no neighbour and gets the calibrated score of such
examples; without labelled examples every score is 0, and with one kind only it is near that kind's label; of labels that repeat an id the
larger counts; of documents that repeat a labelled id one is an example (the first by hash of its text); a null id is in the held-out fold
and teaches nothing; rows that repeat are scored each; long texts are read whole; equal cosines prefer the smaller example id; further
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, map_batches, one_each, plain, sampled_labels, texts

#: Labelled examples that the index holds, at most.
SAMPLE = 3_000
NEIGHBOURS = 16
#: Postings in a block; terms in the first group, later groups are twice as large as the one before.
BLOCK, GROUP = 64, 128
#: Blocks are skipped as long as that hides less than this share of the k-th best; examples that are few enough to be scored one by one.
SLACK, FEW = 0.05, 64
#: Lists that hold more than this share of the examples and whose median weighs more than this share of the heaviest are rows of a matrix: the
#: blocks of so flat a list can hardly be skipped. Rows at most, the longest lists first; texts that are multiplied with the matrix at once.
COMMON, FLAT, ROWS, TEXTS = 0.1, 0.05, 512, 64
#: Bins of the calibration.
BINS = 21
TERM = re.compile(r"[^\W_]+")


def terms_of(text: str) -> list[str]:
    """The terms of the lower-cased text, in order."""
    return TERM.findall(text.lower())


def term_counts(text: str, vocabulary: dict[str, int]) -> Counter:
    """How often each term of the vocabulary occurs, by its number."""
    at = vocabulary.get
    return Counter({k: n for t, n in Counter(terms_of(text)).items() if (k := at(t)) is not None})


def slices(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of runs with these starts and lengths, one run after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Weights:
    """The vocabulary, sorted, and what each term's frequency in a text is multiplied by."""

    terms: list[str]
    weight: np.ndarray

    @cached_property
    def vocabulary(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(self.terms)}

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms and normalised weights."""
        n = term_counts(text, self.vocabulary)
        at = np.fromiter(n, np.int32, len(n))
        v = (1 + np.log(np.fromiter(n.values(), float, len(n)))) * self.weight[at]
        return at, v / np.sqrt((v * v).sum()) if len(v) else v


@dataclass
class Index:
    """Examples by term (example, weight from start; the heaviest first) and by example (of, value from begin)."""

    weights: Weights
    ids: np.ndarray
    label: np.ndarray
    start: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    begin: np.ndarray
    of: np.ndarray
    value: np.ndarray
    #: Posting blocks read and skipped by searches of this process.
    blocks: tuple[int, int] = (0, 0)

    @cached_property
    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each term whose list is a row of the matrix (-1 for others), and the matrix."""
        length = np.diff(self.start)
        terms = np.flatnonzero(length > COMMON * len(self.ids))
        terms = terms[self.weight[self.start[terms] + length[terms] // 2] > FLAT * self.weight[self.start[terms]]]
        terms = terms[np.lexsort((terms, -length[terms]))][:ROWS]
        row, rows = np.full(len(self.start) - 1, -1), np.zeros((len(terms), len(self.ids)))
        row[terms] = np.arange(len(terms))
        for j, t in enumerate(terms):
            own = slice(self.start[t], self.start[t + 1])
            rows[j, self.example[own]] = self.weight[own]
        return row, rows

    def sums(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the terms of the matrix add to each example's cosine with each vector."""
        row, rows = self.common
        of = np.zeros((len(vectors), len(rows)))
        for j, (at, v) in enumerate(vectors):
            own = row[at]
            of[j, own[own >= 0]] = v[own >= 0]
        return of @ rows

    def search(self, texts: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of each text."""
        for a in range(0, len(texts), TEXTS):
            vectors = [self.weights.vector(t) for t in texts[a : a + TEXTS]]
            for (at, v), top in zip(vectors, self.sums(vectors), strict=True):
                yield self.nearest(at, v, k, top)

    def cosines(self, some: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The exact cosines of some examples, each summed over its whole vector in the order of its terms."""
        dense = np.zeros(len(self.start) - 1)
        dense[at] = v
        length = self.begin[some + 1] - self.begin[some]
        take = slices(self.begin[some], length)
        return np.add.reduceat(dense[self.of[take]] * self.value[take], np.cumsum(length) - length)

    def nearest(self, at: np.ndarray, v: np.ndarray, k: int, top: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k nearest examples of a vector and their cosines, leaving out those that share no term. top is its row of sums."""
        none = np.zeros(0, np.int64), np.zeros(0)
        long = self.start[at + 1] > self.start[at]
        at, v = at[long], v[long]
        if not len(at):
            return none
        top = self.sums([(at, v)])[0] if top is None else top
        sparse = np.flatnonzero(self.common[0][at] < 0)
        most = v[sparse] * self.weight[self.start[at[sparse]]]
        order = sparse[np.lexsort((at[sparse], -most))]
        s, e, q, most = self.start[at[order]], self.start[at[order] + 1], v[order], -np.sort(-most)
        after = most.sum() - np.cumsum(most)  # what terms after each can add
        kth = lambda: np.partition(top, len(top) - k)[len(top) - k] if len(top) >= k else 0.0
        rest, missed, least, read, skipped = float(most.sum()), 0.0, kth(), 0, 0
        a, size = 0, GROUP
        while a < len(q):
            z = min(len(q), a + size)
            # an example that only stands in skipped blocks gets less than spare from this group, and so stays below the k-th best
            spare, whole = min(least - missed - after[z - 1], SLACK * least - missed), most[a:z].sum()
            stop = e[a:z].copy()
            if spare > 0:
                share = min(1.0, spare / whole) * (1 - 1e-9)
                # only lists whose last block can be skipped are looked at
                last = self.weight[s[a:z] + (stop - s[a:z] - 1) // BLOCK * BLOCK]
                for j in np.flatnonzero(last <= share * self.weight[s[a:z]]):
                    x, y = s[a + j], e[a + j]
                    stop[j] = min(y, x + BLOCK * int(np.count_nonzero(self.weight[x:y:BLOCK] > share * self.weight[x])))
                left = stop < e[a:z]
                missed += float((q[a:z][left] * self.weight[stop[left]]).sum())
            n = stop - s[a:z]
            read, skipped = read + int((-(-n // BLOCK)).sum()), skipped + int((-(-(e[a:z] - stop) // BLOCK)).sum())
            if n.any():
                take = slices(s[a:z], n)
                top += np.bincount(self.example[take], self.weight[take] * np.repeat(q[a:z], n), len(top))
            least = kth()
            rest = missed + max(0.0, float(after[z - 1]))
            a, size = z, size * 2
            # few enough examples can still be among the nearest, and none that is unseen: they are scored from their own vectors
            if rest < least and np.count_nonzero(top >= least - rest) <= FEW:
                skipped += int((-(-(e[z:] - s[z:]) // BLOCK)).sum())
                break
        self.blocks = self.blocks[0] + read, self.blocks[1] + skipped
        # sums that rounding may have put below the k-th best stay in
        near = np.flatnonzero((top > 0) & (top + rest >= least * (1 - 1e-9)))
        exact = self.cosines(near, at, v)
        first = np.lexsort((self.ids[near], -exact))[:k]
        return near[first], exact[first]

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """The share of label 1 among the nearest, weighted by similarity; -1 without any."""
        return float((cosine * self.label[near]).sum() / cosine.sum()) if len(near) else -1.0


def build(weights: Weights, ids: np.ndarray, label: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Index:
    """An index over examples (in ascending order of id) and their vectors."""
    length = np.array([len(at) for at, _ in vectors], np.int64)
    begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
    of = np.concatenate([at for at, _ in vectors] or [np.zeros(0, np.int32)]).astype(np.int32)
    value = np.concatenate([v for _, v in vectors] or [np.zeros(0)])
    owner = np.repeat(np.arange(len(vectors)), length)
    order = np.lexsort((owner, -value, of))
    start = np.searchsorted(of[order], np.arange(len(weights.terms) + 1))
    return Index(weights, ids, label, start, owner[order], value[order], begin, of, value)


def calibration(vote: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The score of a text without neighbours, and then that of votes at BINS places from 0 to 1.

    Each is the share of label 1 among examples with such votes, drawn to the vote (or to the share among all) where they are few, and never
    falling as votes rise."""
    share = label.mean() if len(label) else 0.0
    at = np.where(vote < 0, 0, 1 + np.rint(np.maximum(vote, 0) * (BINS - 1))).astype(int)
    prior = np.concatenate(([share], np.linspace(0, 1, BINS)))
    good, seen = np.bincount(at, label, BINS + 1), np.bincount(at, minlength=BINS + 1)
    curve = (good + prior * 2) / (seen + 2)
    # falls are levelled by pooling neighbours
    level: list[list[float]] = []
    for c, n in zip(curve[1:], seen[1:] + 2.0, strict=True):
        level.append([c, n, 1])
        while len(level) > 1 and level[-2][0] > level[-1][0]:
            (x, n1, k1), (y, n2, k2) = level[-2:]
            level[-2:] = [[(x * n1 + y * n2) / (n1 + n2), n1 + n2, k1 + k2]]
    return np.concatenate((curve[:1], np.repeat([x for x, _, _ in level], [int(k) for _, _, k in level])))


def calibrated(curve: np.ndarray, vote: float) -> float:
    return float(curve[0] if vote < 0 else np.interp(vote, np.linspace(0, 1, BINS), curve[1:]))


def _terms() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """The distinct terms of each text, beside its label."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [list(set(terms_of(t))) for t in texts(b)]
        return pa.record_batch([b.column(2), pa.array(found, pa.list_(pa.string()))], ["label", "terms"])

    return one


def frequencies(docs: DataFrame, terms: list[str]) -> np.ndarray:
    """Inverse document frequencies of the terms over all of docs (doc_id, text); each task sends its own sums."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # terms of at most SAMPLE documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, rows = {t: k for k, t in enumerate(shared.value)}, np.zeros(len(shared.value) + 1, np.int64), 0
        for b in batches:
            for t in texts(b):
                found = set(terms_of(t)) & at.keys()
                n[np.fromiter(map(at.__getitem__, found), np.int64, len(found))] += 1
            rows += b.num_rows
        n[-1] = rows
        some = np.flatnonzero(n)
        for a in range(0, len(some), 10_000):
            yield pa.record_batch([pa.array(some[a : a + 10_000], pa.int64()), pa.array(n[some[a : a + 10_000]])], ["term", "n"])

    total = np.zeros(len(terms) + 1)
    found = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total[found["term"].to_numpy()] = found["n"].to_numpy()
    return np.log((1 + total[-1]) / (1 + total[:-1])) + 1


def _vectors(weights) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own = weights.value

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [own.vector(t) for t in texts(b)]
            return pa.record_batch([b.column(0), b.column(2), pa.array([at.tobytes() for at, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["doc_id", "label", "at", "v"])

        return one

    return make


def _votes(index, k: int) -> Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """The vote of each example by the others."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own = index.value

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            votes = []
            for i, (near, cosine) in zip(b.column(0).to_pylist(), own.search(texts(b), k + 1), strict=True):
                other = own.ids[near] != i
                votes.append(own.vote(near[other][:k], cosine[other][:k]))
            return pa.record_batch([b.column(0), b.column(2), pa.array(votes, pa.float64())], ["doc_id", "label", "vote"])

        return one

    return make


@dataclass
class Model:
    index: Index
    shared: object  # the index as a broadcast variable
    curve: np.ndarray


def train(docs: DataFrame, labels: DataFrame, learn=None, sample: int = SAMPLE, k: int = NEIGHBOURS) -> Model:
    """The index over at most sample labelled documents of the rows where learn holds, chosen by a hash of the id, and its calibration."""
    learn = fold("doc_id", 5) != 0 if learn is None else learn
    context = docs.sparkSession.sparkContext
    chosen = sampled_labels(labels.filter(learn), "toxic", sample)
    own = plain(docs.join(F.broadcast(chosen.select("doc_id", F.col("label").alias("_label"))), "doc_id"), "doc_id", "text", F.col("_label").alias("label"))
    # one row an id, and each text read once
    own = cut(one_each(own, "label"))
    seen = map_batches(own, _terms, "label int, terms array<string>").select("label", F.explode("terms").alias("term"))
    told = seen.groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("a")).filter("n > 1").orderBy("term").toArrow()
    terms, n, a = told["term"].to_pylist(), told["n"].to_numpy().astype(float), told["a"].to_numpy().astype(float)
    weights = Weights(terms, frequencies(plain(docs, "doc_id", "text"), terms) * np.log2(2 + a / np.maximum(1, n - a)))
    rows = map_batches(own, _vectors(context.broadcast(weights)), "doc_id long, label int, at binary, v binary").toArrow().sort_by("doc_id")
    vectors = [(np.frombuffer(at, np.int32), np.frombuffer(v)) for at, v in zip(rows["at"].to_pylist(), rows["v"].to_pylist(), strict=True)]
    index = build(weights, rows["doc_id"].to_numpy(), rows["label"].to_numpy().astype(float), vectors)
    shared = context.broadcast(index)  # the vectors of at most sample documents
    votes = map_batches(own, _votes(shared, k), "doc_id long, label int, vote double").toArrow()
    return Model(index, shared, calibration(votes["vote"].to_numpy(), votes["label"].to_numpy().astype(float)))


def score(docs: DataFrame, model: Model, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, and as evidence the ids and cosines of the nearest examples, for every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared, curve = model.shared, model.curve

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        index = shared.value

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            found = list(index.search(texts(b), k))
            scores = [calibrated(curve, index.vote(*x)) for x in found]
            return pa.record_batch([b.column(0), pa.array(scores, pa.float64()), pa.array([index.ids[x] for x, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.float64()))], ["doc_id", "score", "nearest", "cosines"])

        return one

    out = map_batches(plain(docs, id_col, text_col), make, f"doc_id {kind}, score double, nearest array<long>, cosines array<double>")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
