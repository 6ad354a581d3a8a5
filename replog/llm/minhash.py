"""Operator 9: near-duplicates by min-max hashing, confirmed on full shingle sets.

A document's set holds its distinct shingles of five lower-cased words, as 64-bit hashes. Documents with equal sets form a class, and one of
each class stands for it. Under each random permutation both the smallest and the largest hash are kept, so that so many permutations give
twice the signature values; bands of values bring candidates together. Buckets that share documents are joined to clusters, and the full
sets of a cluster are compared with each other, in blocks of bounded size.

A cluster of one block is compared pair by pair. In a larger one, blocks are first compared within; a few members of each large group found
then link groups across blocks; at last every document still outside its cluster's largest group is compared with all documents of the
cluster, block by block. Pairs inside the largest group need no comparison, for their link is known, so no link between different groups is
lost.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer than five words form one shingle;
rows that repeat have equal sets and are linked; rows that share an id are one document with several sets; a null id takes part in no link,
and its component is null; long texts are shingled whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROWS, cut, fresh, map_batches, texts
from .components import components

#: Words of a shingle; permutations, each with a minimum and a maximum; values in a band.
SHINGLE, PERMUTATIONS, ROWS = 5, 80, 5
#: Documents and shingles of a block, about.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Members of a group from which it counts as large, and how many of them stand for it.
LARGE, PIVOTS = 8, 4
U = np.uint64
MULTIPLIERS = np.random.default_rng(9).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | U(1)
BASE = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd number modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.values = U(base), np.ones(1, U)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = self.values[-1] * self.base
            self.values = np.concatenate((self.values, self.values * step))
        return self.values[:n]


FORTH, BACK = Powers(BASE), Powers(pow(BASE, -1, 1 << 64))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    code = LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    space = SEPARATOR[code]
    edge = np.diff(np.concatenate(([1], space, [1])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, U), np.cumsum((code.astype(U) + U(1)) * FORTH.upto(len(code)))))
        word = mix((sums[end] - sums[start]) * BACK.upto(len(code) + 1)[start])
        if len(word) < SHINGLE:
            h = U(len(word))
            for w in word:
                h = h * U(0xD6E8FEB86659FD93) + w
            return mix(np.array([h], U))
        n = len(word) - SHINGLE + 1
        h = np.full(n, SHINGLE, U)
        for k in range(SHINGLE):
            h = h * U(0xD6E8FEB86659FD93) + word[k : k + n]
        return np.unique(mix(h))


def band_keys(s: np.ndarray) -> np.ndarray:
    """The keys of a set's bands of minima and maxima."""
    low, high = np.full(PERMUTATIONS, np.iinfo(U).max, U), np.zeros(PERMUTATIONS, U)
    with np.errstate(over="ignore"):
        for a in range(0, len(s), 4096):
            y = s[None, a : a + 4096] * MULTIPLIERS[:, None]
            low, high = np.minimum(low, y.min(1)), np.maximum(high, y.max(1))
        values = np.concatenate((low, high)).reshape(-1, ROWS)
        key = np.arange(len(values), dtype=U) + U(1)
        for k in range(ROWS):
            key = mix(key * U(BASE) + values[:, k])
    return key.view(np.int64)


def _signatures() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        n, d1, d2, keys = [], [], [], []
        for t in texts(b):
            s = shingles(t)
            n.append(len(s))
            x = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
            d1.append(x[0] if len(s) else None)
            d2.append(x[1] if len(s) else None)
            keys.append(band_keys(s) if len(s) else np.zeros(0, np.int64))
        return pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc", "n", "d1", "d2", "keys"])

    return one


def _sets() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t) for t in texts(b)]
        at = b.schema.get_field_index("text")
        return pa.record_batch([*(c for k, c in enumerate(b.columns) if k != at), pa.array([s.tobytes() for s in found], pa.binary())], [*(x for x in b.schema.names if x != "text"), "s"])

    return one


class Postings:
    """An inverted index over the sets of a block."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, int)
        self.shingle, self.start = every[first], first
        self.length = np.diff(np.append(first, len(every)))

    def linked(self, s: np.ndarray) -> np.ndarray:
        """Places of the sets of which an intersection with s is three quarters of the union at least."""
        at = np.searchsorted(self.shingle, s)
        at = at[(at < len(self.shingle)) & (self.shingle[np.minimum(at, len(self.shingle) - 1)] == s)] if len(self.shingle) else at[:0]
        length = self.length[at]
        ends = np.cumsum(length)
        take = np.repeat(self.start[at] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        both = np.bincount(self.owner[take], minlength=len(self.size))
        return np.flatnonzero((both > 0) & (100 * both >= 75 * (len(s) + self.size - both)))


def _read(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, U) for x in column.to_pylist()]


def _links(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def within(block: pa.Table) -> pa.Table:
    """The group of each of a block's documents, by its smallest document: documents of the block that links join."""
    order = np.argsort(block["doc"].to_numpy(), kind="stable")
    block = block.take(pa.array(order))
    ids, sets = block["doc"].to_pylist(), _read(block["s"])
    index, root = Postings(sets), list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k, s in enumerate(sets):
        for j in index.linked(s):
            if j > k and (x := find(k)) != (y := find(int(j))):
                root[max(x, y)] = min(x, y)
    return pa.table({"doc": block["doc"], "cluster": block["cluster"], "group": pa.array([ids[find(k)] for k in range(len(ids))], pa.int64())})


def between(block: pa.Table) -> pa.Table:
    """Links between the groups of a block's documents, fewer than there are documents."""
    group = dict(zip(block["doc"].to_pylist(), block["group"].to_pylist(), strict=True))
    found = within(block)
    pairs = {(group[a], group[b]) for a, b in zip(found["doc"].to_pylist(), found["group"].to_pylist(), strict=True) if group[a] != group[b]}
    return _links([a for a, _ in sorted(pairs)], [b for _, b in sorted(pairs)])


def across(outside: pa.Table, block: pa.Table) -> pa.Table:
    """Links between the groups of outside documents and the groups of a block that hold documents linked with them."""
    pairs: set[tuple[int, int]] = set()
    if outside.num_rows and block.num_rows:
        group, index = block["group"].to_pylist(), Postings(_read(block["s"]))
        for own, s in zip(outside["group"].to_pylist(), _read(outside["s"]), strict=True):
            pairs.update((own, group[j]) for j in index.linked(s) if group[j] != own)
    return _links([a for a, _ in sorted(pairs)], [b for _, b in sorted(pairs)])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (whether it is its own) for every row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    signed = cut(map_batches(own, _signatures, "doc long, n long, d1 long, d2 long, keys array<long>", ROWS))
    placed = signed.filter("doc is not null and d1 is not null")
    classes = cut(placed.groupBy("d1", "d2").agg(F.min("doc").alias("doc"), F.first("keys").alias("keys"), F.first("n").alias("n")))
    banded = classes.select("doc", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc").alias("head"), F.count("*").alias("c")).filter("c > 1")
    candidates = banded.join(buckets, "key").filter("doc <> head").select(F.col("doc").alias("a"), F.col("head").alias("b")).distinct()
    clusters = components(candidates)
    sized = clusters.join(classes.groupBy("doc").agg(F.sum("n").alias("n")), clusters.node == F.col("doc")).select("doc", F.col("component").alias("cluster"), "n")
    count = lambda c, s: F.ceil(F.greatest(c / F.lit(BLOCK), s / F.lit(BLOCK_SHINGLES))).cast("int")
    per = sized.groupBy("cluster").agg(count(F.count("*"), F.sum("n")).alias("blocks"))
    members = cut(sized.join(per, "cluster").select("doc", "cluster", "blocks", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block")))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields)
    # texts are read and moved once for the sets of all members; later steps join these sets
    sets = cut(map_batches(members.join(own, "doc").select(*members.columns, "text"), _sets, f"{fields}, s binary", ROWS))
    groups = cut(sets.groupBy("cluster", "block").applyInArrow(lambda g: within(g), "doc long, cluster long, group long"))
    several = sets.filter("blocks > 1")
    if not several.isEmpty():
        groups = link_blocks(several, groups)
    # an id with several sets is in the group of the smallest that any of them reaches
    found = groups.groupBy("doc").agg(F.min("group").alias("group"))
    ruled = classes.join(found, "doc", "left").select("d1", "d2", F.coalesce("group", "doc").alias("component_id"))
    known = signed.select("doc", "n", "d1", "d2")
    joined = known.join(ruled, ["d1", "d2"], "left")
    component = F.when(F.col("doc").isNull(), None).otherwise(F.coalesce("component_id", "doc"))
    out = joined.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups with those that links join under the smallest name."""
    found = components(links).select(F.col("node").alias("group"), "component")
    return cut(groups.join(found, "group", "left").select("doc", "cluster", F.coalesce("component", "group").alias("group")))


def link_blocks(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """groups with those of different blocks of a cluster joined; sets holds the documents of clusters that have several."""
    members, own_set, last = sets.drop("s"), sets.select("doc", "s"), None
    while True:
        # some of each large group, drawn by a hash, stand for it
        own = members.join(groups.select("doc", "group"), "doc")
        size = own.groupBy("cluster", "group").agg(F.count("*").alias("c")).filter(F.col("c") >= LARGE)
        per = size.groupBy("cluster").agg(F.count("*").alias("large")).filter("large > 1").withColumn("parts", F.ceil(F.col("large") * PIVOTS / BLOCK).cast("int"))
        n = per.agg(F.sum("large")).first()[0]
        if n is None or n == last:
            break
        last = n
        chosen = own.join(size, ["cluster", "group"]).join(per, "cluster").withColumn("x", F.pmod(F.xxhash64("doc", F.lit("pivot")), F.lit(1 << 30)))
        # about four times as many as are needed pass by their hash, of which the first stand for the group
        few = chosen.filter(F.col("x") * F.col("c") < F.lit(4 * PIVOTS * (1 << 30)))
        turn = F.row_number().over(W.partitionBy("cluster", "group").orderBy("x", "doc"))
        pivots = few.withColumn("turn", turn).filter(F.col("turn") <= PIVOTS).select("doc", "cluster", "group", F.pmod(F.xxhash64("group", F.lit(last)), F.col("parts")).cast("int").alias("block"))
        groups = merged(groups, pivots.join(own_set, "doc").groupBy("cluster", "block").applyInArrow(lambda g: between(g), "a long, b long"))
    own = cut(members.join(groups.select("doc", "group"), "doc"))
    size = own.groupBy("cluster", "group").agg(F.count("*").alias("c"))
    main = size.groupBy("cluster").agg(F.max_by("group", F.struct("c", -F.col("group"))).alias("main"), (F.sum("c") - F.max("c")).alias("outside"))
    main = cut(main.filter("outside > 0").withColumn("parts", F.ceil(F.col("outside") / BLOCK).cast("int")))
    if main.isEmpty():
        return groups
    outside = own.join(main, "cluster").filter("group <> main")
    outside = cut(outside.select("doc", "cluster", "group", "blocks", F.pmod(F.xxhash64("doc", F.lit("outside")), F.col("parts")).cast("int").alias("part")).join(own_set, "doc"))
    outside = outside.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inside = own.join(main.select("cluster", "parts"), "cluster").select("doc", "cluster", "group", "block", "parts").join(own_set, "doc")
    inside = inside.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["cluster", "block", "part"]
    more = outside.groupBy(*keys).cogroup(inside.groupBy(*keys)).applyInArrow(lambda o, i: across(o, i), "a long, b long")
    return merged(groups, more)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document is the first of its group, one for each id (of several the first by text), and all rows without an id."""
    doc, turn = fresh(docs, "doc", "turn")
    kept = near_groups(docs, id_col, text_col).filter("kept and doc_id is not null").select(F.col("doc_id").alias(doc)).distinct()
    first = F.row_number().over(W.partitionBy(id_col).orderBy(F.xxhash64(text_col), text_col))
    stay = docs.join(kept, F.col(id_col) == F.col(doc), "left_semi").withColumn(turn, first).filter(F.col(turn) == 1).drop(turn)
    return stay.unionByName(docs.filter(F.col(id_col).isNull()))
