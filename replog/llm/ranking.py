"""Operator 12: ranked lexical search of all documents for every item, by a dual-tree search that is exact.

Scores are sums over an item's terms of whole numbers: weight of the term times its impact in the document. Items form a tree, and so do the documents of each
block; a node holds, term by term, the greatest weight (items) or impact (documents) below it. The product of two nodes' maxima bounds all scores between them;
where it is below the weakest kth score that the items of the node already have, the pair is left out with all that is below it. Where it is not, both nodes are opened, down
to leaves, where scores are worked out exactly. Whole numbers of up to 53 bits are exact in doubles; if an item's weights could reach beyond, 64-bit numbers are used.

As Spark sees it: items are read in groups of bounded size (GROUP_BYTES of text), each of which is one pass over the documents. A first pass counts a group's terms in
all documents, and writes blocks with the documents' terms that any of the items has; from it come document frequencies. A share of the blocks (one in SAMPLE, whatever their
number) is searched first, for a kth score of each item that the whole table cannot fall short of; then every block is searched, and sends only what reaches it. A task
keeps k documents an item at most. Broadcast are the trees of one group of items, whose size the group bounds.

Terms are told apart by 64 bits of a hash. Null and empty texts, and those without a term, take no part. Rows with the same id, or none, are documents of their own; equal
scores are in ascending order of id, nulls last. Of several items with the same id, the one with the least text counts (nulls last). Without documents or items there are no rows.
Further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import pack, unpack
from .common import cut
from .hashed import TERMS, hashed, slices

GROUP_BYTES, SAMPLE = 4_000_000, 32
#: Documents of a block and its postings, at most about; documents and items of a leaf; children of a node.
BLOCK, POSTINGS, LEAF_DOCS, LEAF_ITEMS, FAN = 512, 400_000, 2, 2, 8
BLOCKS = "block long, docs int, words long, ids array<{kind}>, sizes binary, lengths binary, m int, terms binary, counts binary"


def _vectors(terms: np.ndarray, kind: pa.DataType) -> Callable:
    """Blocks of documents that have a term: ids, numbers of all their terms, and which terms of the items they have, how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sizes, lengths, held, counts, n = TaskContext.get().partitionId() << 32, [], [], [], [], [], 0

        def row() -> pa.RecordBatch:
            all_terms = np.concatenate(held)
            values = [[block], [len(ids)], [int(np.sum(np.concatenate(sizes)))], [ids], [pack(np.concatenate(sizes))], [pack(np.concatenate(lengths))], [len(all_terms)], [pack(all_terms)], [pack(np.concatenate(counts))]]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(kind), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(v, t) for v, t in zip(values, types)], [x.split()[0] for x in BLOCKS.split(", ")])

        for i, t in slices(batches):
            words, doc = hashed(t, TERMS)
            size = np.bincount(doc, minlength=len(t))
            at = np.minimum(np.searchsorted(terms, words), max(0, len(terms) - 1))
            hit = terms[at] == words if len(terms) else np.zeros(len(words), bool)
            key, tf = np.unique(doc[hit] * max(1, len(terms)) + at[hit], return_counts=True)
            own, term = np.divmod(key, max(1, len(terms)))
            each = np.bincount(own, minlength=len(t))
            some = np.flatnonzero(size)
            names, ends = i.to_pylist(), np.concatenate(([0], np.cumsum(each)))
            for a in range(0, len(some), BLOCK):
                few = some[a : a + BLOCK]
                ids += [names[k] for k in few]
                sizes.append(size[few])
                lengths.append(each[few])
                lo, hi = ends[few[0]], ends[few[-1] + 1]  # those without terms in between have no postings
                held.append(term[lo:hi])
                counts.append(tf[lo:hi])
                n += hi - lo
                if len(ids) >= BLOCK or n >= POSTINGS:
                    yield row()
                    block, ids, sizes, lengths, held, counts, n = block + 1, [], [], [], [], [], 0
        if ids:
            yield row()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of a task each term is."""
    total = np.zeros(0, np.int64)
    for b in batches:
        for r in b.to_pylist():
            n = np.bincount(unpack(r["terms"], r["m"]), minlength=len(total))
            n[: len(total)] += total
            total = n
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some), pa.array(total[some])], ["term", "df"])


class Items:
    """A group of items as a tree: leaves of a few, and above them nodes with the greatest weight of each term below."""

    def __init__(self, ids: list, vectors: list[dict[int, int]], terms: int):
        order = self.ordered(vectors, list(range(len(vectors))))
        self.ids, self.terms = [ids[k] for k in order], terms
        self.vectors = [vectors[k] for k in order]
        self.exact = np.float64 if max((sum(v.values()) for v in vectors), default=0) * 1_000_000 < 1 << 53 else np.int64
        #: Nodes of each level, leaves last: (first item, last item, terms, greatest weights, children).
        leaves = [self.node(a, min(a + LEAF_ITEMS, len(order))) for a in range(0, len(order), LEAF_ITEMS)]
        self.levels = [leaves]
        while len(self.levels[0]) > 1:
            below = self.levels[0]
            self.levels.insert(0, [self.node(below[a][0], below[min(a + FAN, len(below)) - 1][1]) for a in range(0, len(below), FAN)])
        self.weights = []
        for a, z, own, _ in leaves:
            w = np.zeros((z - a, len(own)), self.exact)
            for k in range(a, z):
                w[k - a, np.searchsorted(own, list(self.vectors[k]))] = list(self.vectors[k].values())
            self.weights.append(w)

    @staticmethod
    def ordered(vectors: list[dict[int, int]], some: list[int]) -> list[int]:
        """Items so that alike ones are near each other: halved again and again, by which half's sum of weights each is more like."""
        if len(some) <= LEAF_ITEMS:
            return some
        half = max(LEAF_ITEMS, (len(some) // 2 + LEAF_ITEMS - 1) // LEAF_ITEMS * LEAF_ITEMS)
        by = some
        for _ in range(6):
            sums: list[dict[int, float]] = []
            for part in (by[:half], by[half:]):
                total: dict[int, float] = {}
                for k in part:
                    for t, w in vectors[k].items():
                        total[t] = total.get(t, 0.0) + w
                norm = math.sqrt(sum(w * w for w in total.values())) or 1.0
                sums.append({t: w / norm for t, w in total.items()})
            side = [sum(w * (sums[1].get(t, 0.0) - sums[0].get(t, 0.0)) for t, w in vectors[k].items()) for k in some]
            by = [some[k] for k in np.argsort(side, kind="stable")]
        return Items.ordered(vectors, by[:half]) + Items.ordered(vectors, by[half:])

    def node(self, a: int, z: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        most: dict[int, int] = {}
        for v in self.vectors[a:z]:
            for t, w in v.items():
                most[t] = max(w, most.get(t, 0))
        own = np.array(sorted(most), np.int64)
        return a, z, own, np.array([most[t] for t in own.tolist()], self.exact)


class Search:
    """Top k of each item over the blocks that a task reads."""

    def __init__(self, items: Items, least: np.ndarray, documents: int, words: int, k: int):
        self.items, self.k, self.documents, self.words = items, k, documents, words
        self.least = least.copy()  # a document must reach it
        self.found: list[list[tuple]] = [[] for _ in items.ids]
        self.scored = 0  # pairs of leaves

    def block(self, r: dict) -> None:
        items = self.items
        sizes, lengths = unpack(r["sizes"], r["docs"]).astype(np.int64), unpack(r["lengths"], r["docs"]).astype(np.int64)
        term, tf = unpack(r["terms"], r["m"]).astype(np.int64), unpack(r["counts"], r["m"]).astype(np.int64)
        if not len(term) or not items.ids:
            return
        doc = np.repeat(np.arange(len(lengths)), lengths)
        m = 75 + (25 * sizes * self.documents) // self.words
        impact = ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])).astype(items.exact)
        # documents beside others that the same items may want
        top = items.levels[min(1, len(items.levels) - 1)]
        want = np.zeros((len(top), len(lengths)))
        for g, (_, _, own, most) in enumerate(top):
            full = np.zeros(items.terms)
            full[own] = most
            want[g] = np.bincount(doc, weights=full[term] * impact, minlength=len(lengths))
        place = np.empty(len(lengths), np.int64)
        place[np.lexsort((want.max(axis=0), want.argmax(axis=0)))] = np.arange(len(lengths))
        ids = [None] * len(place)
        for k, name in zip(place.tolist(), r["ids"]):
            ids[k] = name
        doc = place[doc]
        local, column = np.unique(term, return_inverse=True)
        where = np.full(items.terms, -1)
        where[local] = np.arange(len(local))
        # the tree of documents, from leaves of a few up to the block
        leaves = -(-len(lengths) // LEAF_DOCS)
        tree = [np.zeros((leaves, len(local)), items.exact)]
        np.maximum.at(tree[0], (doc // LEAF_DOCS, column), impact)
        while len(tree[0]) > 1:
            below = tree[0]
            tree.insert(0, np.stack([below[a : a + FAN].max(axis=0) for a in range(0, len(below), FAN)]))
        by_leaf = np.argsort(doc, kind="stable")
        ends = np.searchsorted(doc[by_leaf], np.arange(0, (leaves + 1) * LEAF_DOCS, LEAF_DOCS))
        self.open(0, 0, 0, np.zeros(1, np.int64), tree, where, (ids, doc[by_leaf], column[by_leaf], impact[by_leaf], ends))

    def open(self, level: int, node: int, depth: int, nodes: np.ndarray, tree: list[np.ndarray], where: np.ndarray, postings: tuple) -> None:
        """Compares an item node with document nodes of a depth, and opens both where the bound allows."""
        a, z, own, most = self.items.levels[level][node]
        at = where[own]
        here = at >= 0
        at, most = at[here], most[here]
        if not len(at):
            return
        bound = tree[depth][nodes[:, None], at] @ most
        may = bound >= max(1, self.least[a:z].min())
        nodes, bound = nodes[may], bound[may]
        if not len(nodes):
            return
        deeper, lower = depth + 1 < len(tree), level + 1 < len(self.items.levels)
        if not deeper and not lower:
            self.leaf(node, nodes[np.argsort(-bound, kind="stable")], np.sort(-bound), at, here, postings)
            return
        if deeper:
            nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            nodes, depth = nodes[nodes < len(tree[depth + 1])], depth + 1
        children = range(node * FAN, min(node * FAN + FAN, len(self.items.levels[level + 1]))) if lower else (node,)
        for child in children:
            self.open(level + lower, child, depth, nodes, tree, where, postings)

    def leaf(self, node: int, leaves: np.ndarray, bound: np.ndarray, at: np.ndarray, here: np.ndarray, postings: tuple) -> None:
        """Exact scores of the items of a leaf in leaves of documents, those with the greatest bounds first."""
        ids, doc, column, impact, ends = postings
        first, last, _, _ = self.items.levels[-1][node]
        weights = self.items.weights[node][:, here]
        back = np.full(int(column.max()) + 1, -1)
        back[at] = np.arange(len(at))
        for a in range(0, len(leaves), FAN):
            if -bound[a] < self.least[first:last].min():
                break
            few = leaves[a : a + FAN]
            self.scored += len(few)
            dense = np.zeros((len(few) * LEAF_DOCS, len(at)), self.items.exact)
            for k, x in enumerate(few.tolist()):
                rows = slice(ends[x], ends[x + 1])
                c = back[column[rows]]
                dense[doc[rows][c >= 0] - x * LEAF_DOCS + k * LEAF_DOCS, c[c >= 0]] = impact[rows][c >= 0]
            scores = weights @ dense.T
            for i in range(last - first):
                hits = np.flatnonzero(scores[i] >= max(1, self.least[first + i]))
                if len(hits):
                    self.add(first + i, [(-int(scores[i, h]), ids[few[h // LEAF_DOCS] * LEAF_DOCS + h % LEAF_DOCS]) for h in hits.tolist()])

    def add(self, item: int, more: list[tuple]) -> None:
        best = sorted(self.found[item] + more, key=lambda x: (x[0], x[1] is None, x[1]))[: self.k]
        self.found[item] = best
        if len(best) == self.k:
            self.least[item] = max(self.least[item], -best[-1][0])


def _search(items: Items, least: np.ndarray, documents: int, words: int, k: int, item_kind: pa.DataType, kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, least, documents, words, k)
        for b in batches:
            for r in b.to_pylist():
                search.block(r)
        out = [(k, items.ids[k], d, -s) for k, rows in enumerate(search.found) for s, d in rows]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int32(), item_kind, kind, pa.int64()))], ["item", "item_id", "doc_id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 20, group_bytes: int = GROUP_BYTES, sample: int = SAMPLE) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents (doc_id, text) with a score above 0 for each item (item_id, text)."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    asked = items.groupBy("item_id").agg(F.min(F.col("text").cast("string")).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    groups = max(1, -(-size // group_bytes))
    parts = [_group(own, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g), k, sample) for g in range(groups)]
    return reduce(DataFrame.unionByName, parts)


def _group(own: DataFrame, asked: DataFrame, k: int, sample: int) -> DataFrame:
    spark = own.sparkSession
    rows = asked.filter("text is not null").toArrow()
    item_kind, kind = rows.schema.field("item_id").type, own.select("doc_id").limit(0).toArrow().schema.field("doc_id").type
    names = (own.schema["doc_id"].dataType.simpleString(), asked.schema["item_id"].dataType.simpleString())
    words, item = hashed(rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()), TERMS)
    terms, at = np.unique(words, return_inverse=True)
    blocks = cut(own.mapInArrow(_vectors(terms, kind), BLOCKS.format(kind=names[0])))
    total = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    df = np.zeros(len(terms), np.int64)
    for r in blocks.select("terms", "m").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r.term] = r.df
    weight = [math.floor(1000 * math.log((2 * total.docs + 2) / (2 * n + 1))) for n in df.tolist()]
    vectors: list[dict[int, int]] = [{} for _ in range(rows.num_rows)]
    for i, t in zip(item.tolist(), at.tolist()):
        vectors[i][t] = vectors[i].get(t, 0) + weight[t]
    some = [i for i, v in enumerate(vectors) if v]
    tree = Items([rows["item_id"][i].as_py() for i in some], [vectors[i] for i in some], len(terms))
    schema = f"item int, item_id {names[1]}, doc_id {names[0]}, score long"
    search = lambda part, least: part.mapInArrow(_search(tree, least, total.docs, max(1, total.words), k, item_kind, kind), schema)
    # equal scores ascend by id, nulls last
    w = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    least = np.zeros(len(tree.ids), np.int64)
    for r in ranked(search(blocks.filter(F.pmod(F.xxhash64("block"), F.lit(sample)) == 0), least)).filter(F.col("rank") == k).select("item", "score").collect():
        least[r.item] = r.score
    return ranked(search(blocks, least)).select("item_id", "rank", "doc_id", "score")
