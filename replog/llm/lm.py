"""Operator 11: a hierarchical Pitman-Yor language model of words, with seatings sampled by Gibbs, and the probabilities that it gives to texts.

Each word u is a context with a restaurant of its own, whose customers are the words after it; all contexts share one parent, the restaurant of
words, whose base is uniform over the words and one class of unknown ones. Of a seating, the predictive probabilities need only the customers c
and tables t of each dish:

    P(w)     = (c_w - d0 t_w + (theta + d0 T) / (V + 1)) / (theta + C)
    P(w | u) = (c_uw - d t_uw + (theta + d T_u) P(w)) / (theta + C_u)

where c_w is the number of tables that serve w in all contexts. A sweep samples the tables of every dish from what they are likely to be given its
customers, its parent's probability and the tables of the other dishes of its restaurant (those of the sweep before, so that all dishes can be
sampled at once, wherever they are). Discounts are estimated from the counts of counts. Scores average the probabilities of several sweeps.

As Spark sees it: texts are cut to blocks; each block sends its distinct pairs (u, w), with the documents that hold them, to the part that a hash
of w deals them to, where a word's pairs from everywhere meet. A word that is frequent enough to fill a part is dealt by u as well. A part so has all that
belongs to its words; the tables of its contexts, and the counts of dealt-out words, are summed over parts once a sweep, by a second shuffle and back.
Sampling draws its random numbers from hashes of dish and sweep: a part that is worked out again, or twice, comes to the same seating. Lastly each part
sends a block the sums of its documents' logarithms. Words are told apart by 64 bits of a hash, contexts by 48 bits of it.

Memory: a block has about BLOCK tokens, a part about PART; the number of parts follows the number of tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import pack, unpack
from .common import fold
from .hashed import WORDS, hashed, mix, slices

BLOCK, PART = 1_500_000, 1_200_000
ROUNDS, THETA, SMOOTH = 2, 1.0, 0.1
#: Up to so many customers of a dish, the tables are drawn from their exact distribution.
EXACT = 400
LOW48 = np.uint64((1 << 48) - 1)
END = np.uint64(0x1F83D9ABFB41BD6B)
CELLS = "part int, block long, mark long, n int, m int, words binary, pairs binary, contexts binary, occurrences binary, docs binary, train binary, ids array<{kind}>"
SUMS = "part int, source int, n int, contexts binary, tables binary, words binary, counts binary, scalars array<double>"
ANSWERS = "part int, sweep int, home int, n int, tables binary, counts binary, scalars array<double>"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, each text's with END after them; and how many tokens each text has."""
    words, doc = hashed(texts, WORDS)
    out = np.full(len(words) + len(texts), END, np.uint64)
    out[np.arange(len(words)) + doc] = words
    return out, np.bincount(doc, minlength=len(texts)) + 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, ids, training flags, tokens, tokens of each text) of each block of a partition."""
    block, ids, train, held, counts, n = TaskContext.get().partitionId() << 32, [], [], [], [], 0
    for i, t, f in slices(batches):
        h, each = tokens(t)
        ids += i.to_pylist()
        train += f.to_pylist()
        held.append(h)
        counts.append(each)
        n += len(h)
        if n >= BLOCK:
            yield block, ids, np.array(train, bool), np.concatenate(held), np.concatenate(counts)
            block, ids, train, held, counts, n = block + 1, [], [], [], [], 0
    if ids:
        yield block, ids, np.array(train, bool), np.concatenate(held), np.concatenate(counts)


def _frequent(least: int) -> Callable:
    """Words that hold at least one in `least` of a block's tokens, and the number of tokens (as word null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, h, _ in _blocks(batches):
            words, n = np.unique(h, return_counts=True)
            often = n * least >= len(h)
            yield pa.record_batch([pa.array([None, *words[often].view(np.int64).tolist()], pa.int64()), pa.array([len(h), *n[often].tolist()], pa.int64())], ["word", "n"])

    return run


def six(x: np.ndarray) -> bytes:
    """Numbers of 48 bits as six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def home(context: np.ndarray, parts: int) -> np.ndarray:
    return (context & LOW48) % np.uint64(parts)


def _cells(parts: int, shares: dict[int, int], kind: pa.DataType) -> Callable:
    """A row for each block and part: its distinct pairs by word and context, and the documents of each; and a row with the block's ids."""
    salted, fans = np.array(sorted(shares), np.uint64), np.array([shares[k] for k in sorted(shares)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, train, h, counts in _blocks(batches):
            words, at = np.unique(h, return_inverse=True)
            before = np.concatenate((at[-1:], at[:-1]))  # the end of a text stands before the first word of the next
            part = home(words, parts)[at]
            if len(salted):
                k = np.minimum(np.searchsorted(salted, words), len(salted) - 1)
                fan = np.where(salted[k] == words, fans[k], np.uint64(1))[at]
                part = (part + mix(words)[before] % fan) % np.uint64(parts)
            key = (part.astype(np.int64) * len(words) + at) * len(words) + before
            order = np.argsort(key, kind="stable")
            key, doc = key[order], np.repeat(np.arange(len(ids)), counts)[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            occurrences, key = np.diff(np.append(first, len(order))), key[first]
            key, context = np.divmod(key, len(words))
            part, word = np.divmod(key, len(words))
            mark = int(np.bitwise_xor.reduce(mix(h + np.arange(len(h), dtype=np.uint64)))) >> 1
            flags, rows = np.packbits(train).tobytes(), []
            edges = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(part))
            ends = np.append(first, len(order))
            for a, z in zip(edges[:-1], edges[1:]):
                head = np.flatnonzero(np.concatenate(([True], word[a + 1 : z] != word[a : z - 1])))
                rows.append((int(part[a]), int(z - a), int(len(head)), words[word[a:z][head]].astype("<u8").tobytes(), pack(np.diff(np.append(head, z - a))), six(words[context[a:z]] & LOW48), pack(occurrences[a:z]), pack(doc[ends[a] : ends[z]])))
            part_, n, m, w, pairs, contexts, occ, docs = map(list, zip(*rows))
            k = len(rows)
            names = [x.split()[0] for x in CELLS.split(", ")]
            columns = [part_ + [block % parts], [block] * (k + 1), [mark] * (k + 1), n + [0], m + [0], w + [None], pairs + [None], contexts + [None], occ + [None], docs + [None], [flags] * (k + 1), [None] * k + [ids]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.list_(kind)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def uniform(x: np.ndarray) -> np.ndarray:
    return mix(x).astype(np.float64) / 2.0**64


@cache
def stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: in how many ways c customers sit at t tables, weighed by the discount."""
    s = np.full((size + 1, size + 2), -np.inf)
    s[0, 0] = 0.0
    k = np.arange(size + 2)
    for c in range(size):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = s[c] + np.log(np.maximum(c - k * discount, 0.0))
        s[c + 1] = np.logaddexp(np.concatenate(([-np.inf], s[c, :-1])), np.where(np.isnan(stay), -np.inf, stay))
    return s


def sample_tables(c: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, theta: float, seed: np.ndarray) -> np.ndarray:
    """Tables of dishes with c customers each, by Gibbs: drawn from their distribution given the tables of the restaurant's other dishes and the parent's probability.

    Beyond EXACT customers the distribution is narrow: its likeliest number is taken, rounded at random."""
    t = np.minimum(c, 1).astype(np.int64)
    r, logs = uniform(seed), stirling(round(discount, 3))
    for size in np.unique(c[(c > 1) & (c <= EXACT)]):
        rows = np.flatnonzero(c == size)
        k = np.arange(size)
        for a in range(0, len(rows), max(1, 2_000_000 // int(size))):
            own = rows[a : a + max(1, 2_000_000 // int(size))]
            new = np.log((theta + discount * (others[own, None] + k)) * parent[own, None])
            weight = logs[size, 1 : size + 1] + np.cumsum(new, axis=1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            t[own] = 1 + (weight < r[own, None] * weight[:, -1:]).sum(axis=1)
    heavy = np.flatnonzero(c > EXACT)
    t[heavy] = np.floor(likely_tables(c[heavy].astype(np.float64), others[heavy], parent[heavy], discount, theta) + r[heavy])
    return np.minimum(t, c)


def likely_tables(c: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, theta: float) -> np.ndarray:
    """The number of tables at the end of the likeliest path of seatings.

    With j seated at t tables, a new table weighs (q + d t) p and an old one j - d t, where q is theta plus the discounts of the other tables. Hamilton's equations of the
    paths' weight have the closed solution q + d t = A / (1 - u), u / (1 - u) ~ exp(d s), j + q - A ~ exp(s), with u = p at the end; A follows from the begin (one
    customer, one table) by bisection on e = q + d - A."""
    q, p = theta + discount * others, np.minimum(parent, 1 - 1e-12)
    low, high = np.full(len(c), -100.0), np.log(q + discount)
    for _ in range(80):
        middle = (low + high) / 2
        e = np.exp(middle)
        more = np.log(p / (1 - p)) + np.log(np.maximum(q + discount - e, 1e-300)) - middle > discount * (np.log(c - discount + e) - np.log(1 - discount + e))
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    return np.clip(((q + discount - np.exp(low)) / (1 - p) - q) / discount, 1, c)


class State(NamedTuple):
    """A seating: tables of pairs and of words; and what the next one of shared words hangs on: other words' tables, discount and base."""

    t: np.ndarray
    root: np.ndarray
    others: np.ndarray
    d0: float
    base: float


class Sample(NamedTuple):
    """A seating's counts and probabilities: of words, and of pairs up to the customers of their context."""

    c: np.ndarray
    root: np.ndarray
    p: np.ndarray
    likely: np.ndarray
    tables: np.ndarray
    d: float
    d0: float
    base: float
    x: list[float]


def sample_root(served: np.ndarray, others: np.ndarray, base: float, d0: float, theta: float, words: np.ndarray, number: int) -> np.ndarray:
    """Tables of words in the parent restaurant."""
    return sample_tables(served, others.astype(np.float64), np.full(len(served), base), d0, theta, mix(words + np.uint64(number)))


class Part:
    """What the cells of a part hold: its distinct pairs with their training counts, its words and contexts, and the cells themselves."""

    def __init__(self, cells: pa.Table, parts: int, salted: np.ndarray, theta: float):
        self.parts, self.salted_words, self.theta = parts, salted, theta
        self.rows = sorted((r for r in cells.to_pylist() if r["n"]), key=lambda r: r["block"])
        self.heads = [r for r in cells.to_pylist() if not r["n"]]
        words, contexts, counts = [], [], []
        for r in self.rows:
            flags = np.unpackbits(np.frombuffer(r["train"], np.uint8))
            r["occ"] = unpack(r.pop("occurrences"), r["n"]).astype(np.int64)
            total = int(r["occ"].sum())
            r["at"] = unpack(r.pop("docs"), total)
            words.append(np.repeat(np.frombuffer(r.pop("words"), "<u8"), unpack(r.pop("pairs"), r["m"])))
            contexts.append(unsix(r.pop("contexts")))
            counts.append(np.add.reduceat(flags[r["at"]].astype(np.int64), np.cumsum(r["occ"]) - r["occ"]))
        w, u, n = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((words, np.uint64), (contexts, np.uint64), (counts, np.int64)))
        order = np.lexsort((u, w))
        w, u = w[order], u[order]
        new = np.concatenate((np.ones(min(1, len(w)), bool), (w[1:] != w[:-1]) | (u[1:] != u[:-1])))
        self.pair = np.empty(len(w), np.int64)  # of each pair of a cell
        self.pair[order] = np.cumsum(new) - 1
        self.c = np.bincount(self.pair, weights=n, minlength=int(new.sum())).astype(np.int64)
        self.words, self.word = np.unique(w[new], return_inverse=True)
        self.contexts, self.context = np.unique(u[new], return_inverse=True)
        self.seed = mix(w[new]) + u[new]
        self.c_word = np.bincount(self.word, weights=self.c, minlength=len(self.words)).astype(np.int64)
        # contexts by their home part, as sums go out and answers come in
        self.order = np.argsort(home(self.contexts, parts), kind="stable")
        shared = np.isin(self.words, salted)
        self.shared = np.flatnonzero(shared)
        self.own = ~shared

    def by_word(self, t: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, weights=t, minlength=len(self.words)).astype(np.int64)

    def by_context(self, t: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=t, minlength=len(self.contexts)).astype(np.int64)

    def sums(self, number: int, state: State) -> Iterator[tuple]:
        """A row for each home part with the tables of its contexts; the first part also gets the counts of shared words, and sums over all own ones."""
        per_context, served = self.by_context(state.t)[self.order], self.by_word(state.t)
        homes = home(self.contexts, self.parts)[self.order]
        edges = np.searchsorted(homes, np.arange(self.parts + 1))
        c, own = self.c_word, self.own
        scalars = [c[own].sum(), (c[own] > 0).sum(), served[own].sum(), state.root[own].sum(), (self.c == 1).sum(), (self.c == 2).sum(), (served[own] == 1).sum(), (served[own] == 2).sum(), state.d0, state.base]
        shared = np.stack((c, served, state.others))[:, self.shared]
        for k in range(self.parts):
            a, z = edges[k], edges[k + 1]
            if k == 0:
                yield k, number, int(z - a), six(self.contexts[self.order[a:z]]), pack(per_context[a:z]), self.words[self.shared].astype("<u8").tobytes(), shared.astype("<i8").tobytes(), [float(x) for x in scalars]
            elif z > a:
                yield k, number, int(z - a), six(self.contexts[self.order[a:z]]), pack(per_context[a:z]), b"", b"", None

    def heard(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """After one sweep: tables of each context, (count, tables served, tables of its own) of each shared word, and the sums over all words."""
        rows = sorted(answers, key=lambda r: r["home"])
        tables, counts = np.zeros(len(self.contexts), np.int64), np.zeros((3, len(self.words)), np.int64)
        tables[self.order] = np.concatenate([unpack(r["tables"], r["n"]) for r in rows])
        counts[:, self.shared] = np.frombuffer(rows[0]["counts"], "<i8").reshape(3, -1)
        return tables, counts, rows[0]["scalars"]

    def begin(self) -> State:
        """Every dish has one table."""
        t = np.minimum(self.c, 1)
        zero = np.zeros(len(self.words), np.int64)
        return State(t, np.minimum(self.by_word(t), 1), zero, 0.5, 0.0)

    def told(self, state: State, answers: list[dict]) -> Sample:
        """The probabilities of the state's seating, with what it adds up to over all parts."""
        tables, counts, x = self.heard(answers)
        d, d0 = discounts(x)
        c, served, root = (np.where(self.own, a, b) for a, b in zip((self.c_word, self.by_word(state.t), state.root), counts))
        base = 1.0 / (x[1] + 1.0)
        p = (served - d0 * root + (self.theta + d0 * x[3]) * base) / (self.theta + x[2])
        return Sample(c, root, p, (self.c - d * state.t + (self.theta + d * tables[self.context]) * p[self.word]), tables, d, d0, base, x)

    def sweep(self, number: int, state: State, s: Sample) -> State:
        """The seating that a sweep samples from the one before."""
        others = np.maximum(s.tables[self.context] - state.t, 0).astype(np.float64)
        t = sample_tables(self.c, others, s.p[self.word], s.d, self.theta, mix(self.seed + np.uint64(1000 + number)))
        rest = np.maximum(s.x[3] - s.root, 0.0).astype(np.int64)
        root = sample_root(self.by_word(t), rest, s.base, s.d0, self.theta, self.words, number)
        return State(t, root, rest, s.d0, s.base)

    def samples(self, answers: list[dict], sweeps: int) -> Iterator[tuple[State, Sample]]:
        """The first seating and those of the sweeps after it, as far as answers to them are there."""
        state = self.begin()
        for number in range(sweeps + 1):
            sample = self.told(state, [r for r in answers if r["sweep"] == number])
            yield state, sample
            state = self.sweep(number, state, sample)

    def after(self, answers: list[dict], sweeps: int) -> State:
        state = self.begin()
        for number in range(sweeps):
            state = self.sweep(number, state, self.told(state, [r for r in answers if r["sweep"] == number]))
        return state


def discounts(x: list[float]) -> tuple[float, float]:
    """Of contexts and of words, from how many dishes have one and two customers."""
    return tuple(float(np.clip(a / (a + 2.0 * b), 0.1, 0.95)) if a + b else 0.5 for a, b in ((x[4], x[5]), (x[6], x[7])))


def _send(parts: int, salted: np.ndarray, sweeps: int, theta: float) -> Callable:
    def run(cells: pa.Table, answers: pa.Table | None) -> pa.Table:
        rows = []
        if cells.num_rows:
            part = Part(cells, parts, salted, theta)
            rows = list(part.sums(cells["part"][0].as_py(), part.after(answers.to_pylist() if answers is not None else [], sweeps)))
        columns = list(zip(*rows)) or [()] * 8
        types = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.float64()))
        return pa.table([pa.array(c, k) for c, k in zip(columns, types)], names=[x.split()[0] for x in SUMS.split(", ")])

    return run if sweeps else lambda cells: run(cells, None)


def _answer(sweep: int, theta: float) -> Callable:
    """At a home part: the sums of what parts have sent, to each of them in the order of its own rows. The first home seats the shared words in the parent restaurant."""

    def run(sums: pa.Table) -> pa.Table:
        rows = sorted(sums.to_pylist(), key=lambda r: r["source"])
        contexts, words = [unsix(r["contexts"]) for r in rows], [np.frombuffer(r["words"], "<u8") for r in rows]
        names, at = np.unique(np.concatenate(contexts), return_inverse=True)
        tables = np.bincount(at, weights=np.concatenate([unpack(r["tables"], r["n"]) for r in rows]), minlength=len(names)).astype(np.int64)[at]
        told = [r["scalars"] for r in rows if r["scalars"] is not None]
        total, counts, a, b, out = None, np.zeros((3, 0), np.int64), 0, 0, []
        if told:
            total = np.sum(told, axis=0).tolist()[:8]
            shared, where = np.unique(np.concatenate(words), return_inverse=True)
            c, served, others = np.concatenate([np.frombuffer(r["counts"], "<i8").reshape(3, -1) for r in rows], axis=1)
            c, served = (np.bincount(where, weights=x, minlength=len(shared)).astype(np.int64) for x in (c, served))
            rest = np.zeros(len(shared), np.int64)
            rest[where] = others
            d0, base = told[0][8:]
            root = sample_root(served, rest, base, d0, theta, shared, sweep - 1) if sweep else np.minimum(served, 1)
            more = [c.sum(), (c > 0).sum(), served.sum(), root.sum(), 0, 0, (served == 1).sum(), (served == 2).sum()]
            total, counts = [x + float(y) for x, y in zip(total, more)], np.stack((c, served, root))[:, where]
        for r, u, w in zip(rows, contexts, words):
            out.append((r["source"], sweep, r["part"], r["n"], pack(tables[a : a + len(u)]), counts[:, b : b + len(w)].astype("<i8").tobytes(), total))
            a, b = a + len(u), b + len(w)
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), types)], names=[x.split()[0] for x in ANSWERS.split(", ")])

    return run


def _score(parts: int, salted: np.ndarray, rounds: int, theta: float, kind: pa.DataType) -> Callable:
    """The sums of logarithms that a part has for the documents of each block; a block's ids pass through its own part."""

    def run(cells: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if cells.num_rows:
            part, x = Part(cells, parts, salted, theta), None
            likely = np.zeros(len(part.c))
            for number, (_, sample) in enumerate(part.samples(answers.to_pylist(), rounds)):
                likely += (number > 0) * sample.likely / rounds
            c, x = sample.c.astype(np.float64), sample.x
            # a word is the context of the token after it, and the end that of a text's first: its own customers are its count
            score, base = np.log10(likely) - np.log10(theta + c)[part.word], np.log10(c + SMOOTH)[part.word]
            at = 0
            for r in part.rows:
                pair = np.repeat(part.pair[at : at + r["n"]], r["occ"])
                at += r["n"]
                docs, where = np.unique(r["at"], return_inverse=True)
                sums = [np.bincount(where, weights=v[pair]) for v in (score, base)]
                known = np.bincount(where, weights=(c > 0)[part.word][pair])
                out.append((r["block"], r["mark"], pack(docs), len(docs), np.concatenate(sums).tobytes(), pack(np.concatenate((np.bincount(where), known)).astype(np.uint32)), None, None, None))
            out += [(r["block"], r["mark"], None, 0, None, None, r["ids"], r["train"], x[:2] if x else None) for r in part.heads]
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(kind), pa.binary(), pa.list_(pa.float64()))
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 9, types)], names=["block", "mark", "docs", "n", "sums", "counts", "ids", "train", "scalars"])

    return run


def _gather(kind: pa.DataType) -> Callable:
    """The documents of a block, with the sums of all parts."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["n"], r["docs"] or b"", r["sums"] or b""))
        if len({r["mark"] for r in rows}) > 1:
            raise ValueError("a block was not read alike twice: write the documents to a table first")
        head = next(r for r in rows if r["ids"] is not None)
        size = len(head["ids"])
        sums, counts = np.zeros((2, size)), np.zeros((2, size), np.int64)
        for r in rows:
            if r["n"]:
                docs = unpack(r["docs"], r["n"])
                sums[:, docs] += np.frombuffer(r["sums"], np.float64).reshape(2, -1)
                counts[:, docs] += unpack(r["counts"], 2 * r["n"]).reshape(2, -1)
        n, v = head["scalars"]
        base = sums[1] - counts[0] * np.log10(n + SMOOTH * (v + 1.0))
        train = np.unpackbits(np.frombuffer(head["train"], np.uint8))[:size].astype(bool)
        columns = [pa.array(head["ids"], kind), pa.array(~train), pa.array(counts[0]), pa.array(counts[1]), pa.array(np.full(size, int(n))), pa.array(base), pa.array(sums[0])]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, held_out: Column | None = None, rounds: int = ROUNDS, theta: float = THETA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs, by a model of those that are not held out.

    Null and empty texts are one END. Rows with a null id, or the same id, are each scored; a null held_out learns. With no training tokens every word is
    unknown. Equal texts have equal scores. Further columns are left out."""
    held = held_out if held_out is not None else fold(id_col, 10) == 0
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (~F.coalesce(held, F.lit(False))).alias("train"))
    name = own.schema["doc_id"].dataType.simpleString()
    kind = pa.schema([("x", own.limit(0).toArrow().schema.field("doc_id").type)]).field("x").type
    # how often the frequent words come, for the number of parts and the words that fill one
    often = own.mapInArrow(_frequent(4096), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = often.join(F.broadcast(often.filter("word is null").select(F.col("n").alias("total"))), F.col("n") * 4096 >= F.col("total")).collect()
    total = next((r.n for r in found if r.word is None), 0)
    parts = max(1, -(-total // PART))
    shares = {r.word % 2**64: min(parts, 1 + 2 * r.n * parts // total) for r in found if r.word is not None and 2 * r.n * parts >= total} if parts > 1 else {}
    salted = np.array(sorted(shares), np.uint64)
    cells = own.mapInArrow(_cells(parts, shares, kind), CELLS.format(kind=name))
    answers: list[DataFrame] = []
    for sweep in range(rounds + 1):
        send = _send(parts, salted, sweep, theta)
        if answers:
            sums = cells.groupBy("part").cogroup(reduce(DataFrame.unionByName, answers).groupBy("part")).applyInArrow(send, SUMS)
        else:
            sums = cells.groupBy("part").applyInArrow(send, SUMS)
        answers.append(sums.groupBy("part").applyInArrow(_answer(sweep, theta), ANSWERS))
    scored = cells.groupBy("part").cogroup(reduce(DataFrame.unionByName, answers).groupBy("part")).applyInArrow(
        _score(parts, salted, rounds, theta, kind), f"block long, mark long, docs binary, n int, sums binary, counts binary, ids array<{name}>, train binary, scalars array<double>"
    )
    return scored.groupBy("block").applyInArrow(_gather(kind), f"doc_id {name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
