"""Operator 1: document fingerprints by a randomised edit embedding.

All texts take the same random walks over their characters: at each step of an embedding the current character is written down, and a bit
shared by all texts, drawn for the step and the character, says whether to move on to the next one. Texts at a small edit distance fall back
into step, so their embeddings are at a small Hamming distance. One walk may miss where two texts meet again and then differs to their end, so
there are several independent walks, each sampled by itself. A fingerprint samples the embeddings: each of its slots has a random priority
for every step of its walk and takes the step of the lowest priority that the embedding has, so that long and short texts are sampled alike,
over the whole of their length, and texts with a common part sample it at the same steps. A slot keeps sixteen bits of what is written there.

Two fingerprints' likeness is the mean, over the better half of the walks, of the share of equal slots above what chance gives. Near documents
are found by banding: bands of slots of one walk bring together documents that agree on all of one band, so that one walk that held suffices.
Likeness verifies all pairs within buckets of wider bands, of which two as alike as asked must share one; pairs less alike that share a bucket with its smallest id are verified by their texts' edit distance.

Edge cases: a null text counts as empty; an empty text has the fingerprint of an embedding without steps, alike only to itself; rows that
repeat are fingerprinted each; long texts are walked whole; a row with a null id has no place in the order of ids, so that what follows it is
the empty text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, plain, texts
from .components import components

#: Independent walks, and the slots of a fingerprint, as many of each walk.
WALKS, SLOTS = 8, 128
PER_WALK = SLOTS // WALKS
#: Characters that a slot looks at from its step on, its hexadecimal digits, and the chance that unlike ones are equal.
READ, DIGITS, CHANCE = 6, 4, 1 / 65536
FACTORS = np.array([pow(0x9E3779B1, k + 1, 1 << 32) for k in range(READ)], np.uint32)
#: The walks read one sequence of random bits, of this length, from a place of its own for each walk and class of characters.
PERIOD, CLASSES = 1 << 17, 256
#: Bands of each walk that bring texts together, and the slots in each.
BANDS, WIDTH = 8, 2
#: Classes of a block, about, when those of a large bucket are compared; rows of blocks that are compared in one call, about, and pairs at once.
BLOCK, PARCEL, PAIRS = 1024, 4096, 1 << 14
#: Pairs of one head and one copy of its text, about, when texts are compared.
HEAD_PAIRS = 1000
#: Characters walked at once, about; texts left in step below which each is walked by itself.
GROUP, FEW = 4_000_000, 6
#: Least likeness at which texts are compared, and the edits that near texts may be apart, as a share of the longer.
PLAUSIBLE, EDITS = 0.03, 0.05


@cache
def stays() -> np.ndarray:
    """For a place in the sequence of bits: how many steps a character stays."""
    bits = np.random.default_rng(20240101).integers(0, 2, PERIOD, dtype=np.int8)
    ones = np.flatnonzero(np.concatenate((bits, bits)))
    return (ones[np.searchsorted(ones, np.arange(PERIOD))] + 1 - np.arange(PERIOD)).astype(np.uint8)


@cache
def places() -> np.ndarray:
    """Where the bits of a class of characters (row) begin for a walk (column)."""
    return np.random.default_rng(11).integers(0, PERIOD, (CLASSES, WALKS))


@cache
def sample_steps() -> np.ndarray:
    """For each slot, the steps at which its priority is lower than ever before; the last one inside an embedding is the slot's sample.

    Where the records of random priorities lie is drawn directly: with the last one at step s, the next is after t with probability
    (s + 1) / (t + 1). A row ends with steps that no text has."""
    rng, out = np.random.default_rng(7), np.full((SLOTS, 96), np.iinfo(np.int64).max)
    for row in out:
        row[0] = 0
        for k in range(1, len(row)):
            if (following := int((row[k - 1] + 1) / max(rng.random(), 1e-9))) > 1 << 44:
                break
            row[k] = following
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def walks(codes: list[np.ndarray], start: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text and walk, and each of its characters, the step of the embedding at which the walk leaves it; start has the step at which each begins.

    Texts go in step, the longest first, so that one operation moves all of them by a character; the last few go by themselves."""
    if not codes:
        return []
    stay, place, mask = stays(), places(), PERIOD - 1
    n = np.array([len(c) for c in codes], np.int64)
    kind = ((np.concatenate(codes) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    flat, first = np.empty(WALKS * int(n.sum()), np.uint32), np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    size, at = n[order], first[order]
    to = WALKS * at[:, None] + size[:, None] * np.arange(WALKS)
    j = (np.zeros((len(n), WALKS), np.int64) if start is None else np.asarray(start, np.int64))[order]
    done = 0
    for left in np.searchsorted(-size, -np.arange(int(size[0])), "left").tolist():
        if left < FEW:
            break
        here = j[:left]
        here += stay[(here + place[kind[at[:left] + done]]) & mask]
        flat[to[:left] + done] = here
        done += 1
    steps = stay.tobytes()
    for d in range(int((size > done).sum())):
        rest = kind[at[d] + done : at[d] + size[d]].tobytes()
        for w in range(WALKS):
            begin, x = place[:, w].tolist(), int(j[d, w])
            flat[to[d, w] + done : to[d, w] + size[d]] = np.fromiter((x := x + steps[(x + begin[c]) & mask] for c in rest), np.int64, len(rest))
    return [flat[WALKS * a : WALKS * (a + b)].reshape(WALKS, b) for a, b in zip(first.tolist(), n.tolist(), strict=True)]


def sample(code: np.ndarray, ends: np.ndarray) -> str:
    """The fingerprint of a walked text, four hexadecimal digits for each slot, walk by walk."""
    if not len(code):
        return "0" * DIGITS * SLOTS
    steps = sample_steps()
    steps = steps[np.arange(SLOTS), (steps < np.repeat(ends[:, -1].astype(np.int64), PER_WALK)[:, None]).sum(1) - 1]
    at = np.concatenate([np.searchsorted(ends[w], steps[PER_WALK * w : PER_WALK * (w + 1)].astype(np.uint32), side="right") for w in range(WALKS)])
    # what is written at a step: the character there and the next few, mixed to sixteen bits
    near = code[np.minimum(at[:, None] + np.arange(READ), len(code) - 1)]
    mixed = (near * FACTORS).sum(1, dtype=np.uint32) ^ (steps.astype(np.uint32) * np.uint32(0x27D4EB2F))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(16)).astype(np.uint16).tobytes().hex()


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with most characters, about, in all."""
    a = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield a, k + 1
            a, total = k + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


def marks(every: list[str]) -> list[str]:
    """The fingerprints of texts."""
    out = []
    for a, z in groups([len(t) for t in every], GROUP):
        codes = [code_points(t) for t in every[a:z]]
        out += [sample(c, e) for c, e in zip(codes, walks(codes), strict=True)]
    return out


def fingerprint(text: str) -> str:
    return marks([text])[0]


def likeness(a: Column, b: Column) -> Column:
    """The likeness (0 to 1) of two fingerprints."""
    slot = lambda x, i: F.substring(x, i * DIGITS + 1, F.lit(DIGITS))
    same = lambda w: F.size(F.filter(F.sequence(w * PER_WALK, (w + 1) * PER_WALK - 1), lambda i: slot(a, i) == slot(b, i)))
    share = F.transform(F.sequence(F.lit(0), F.lit(WALKS - 1)), lambda w: F.greatest(F.lit(0.0), (same(w) / PER_WALK - CHANCE) / (1 - CHANCE)))
    best = F.slice(F.sort_array(share, asc=False), 1, WALKS // 2)
    return F.aggregate(best, F.lit(0.0), lambda total, x: total + x) / (WALKS // 2)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The likeness of fingerprints (rows of x) to one (y), or of rows to rows."""
    same = (x == y).reshape(-1, WALKS, PER_WALK).mean(2)
    share = np.maximum(0.0, (same - CHANCE) / (1 - CHANCE))
    return np.sort(share, 1)[:, WALKS - WALKS // 2 :].mean(1)


def _like(a: str, b: str) -> float:
    return float(alike(*(np.frombuffer(bytes.fromhex(v), np.uint16)[None] for v in (a, b)))[0])


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether two texts (code points) are at most so many edits apart.

    Differences of a column of the edit table are bits of two whole numbers, of which only the band that so few edits can reach is kept; what lies
    outside counts as larger than it is, which no cheapest path within the band minds. It ends where a whole column is beyond the bound."""
    n = min(len(a), len(b))
    head = n if (same := a[:n] == b[:n]).all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = n if same.all() else int(same.argmin())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if abs(len(a) - len(b)) > most:
        return False
    if not len(a) or not len(b):
        return True
    step, top, low, high, up, down = max(64, most), 0, 0, 0, 0, 0
    for begin in range(0, len(b), step):
        end = min(len(b), begin + step)
        if (new := max(0, begin - most)) > low:
            gone = (1 << (new - low)) - 1
            top += (up & gone).bit_count() - (down & gone).bit_count()
            up, down, low = up >> (new - low), down >> (new - low), new
        bottom = min(len(a), end + most)
        up |= ((1 << (bottom - high)) - 1) << (high - low)
        high = bottom
        rows, full, where = a[low:high], (1 << (high - low)) - 1, {}
        for c in b[begin:end].tolist():
            if (eq := where.get(c)) is None:
                eq = where[c] = int.from_bytes(np.packbits(rows == c, bitorder="little").tobytes(), "little")
            vertical = eq | down
            across = (((eq & up) + up) ^ up) | eq
            more, less = ((down | ~(across | up)) << 1 | 1) & full, ((up & across) << 1) & full
            up, down = (less | ~(vertical | more)) & full, more & vertical & full
            top += 1
        size = (high - low + 7) // 8
        column = [np.unpackbits(np.frombuffer(v.to_bytes(size, "little"), np.uint8), bitorder="little").astype(np.int64) for v in (up, down)]
        if min(top, top + int(np.cumsum(column[0] - column[1])[: high - low].min())) > most:
            return False
    return top + up.bit_count() - down.bit_count() <= most


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint for every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(plain(docs, id_col, text_col), lambda: lambda b: pa.record_batch([b.column(0), pa.array(marks(texts(b)), pa.string())], ["doc_id", "fingerprint"]), f"doc_id {kind}, fingerprint string")


def bands(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and one row a band: its number, and the key of its bucket, a hash of the number and the bits sampled for it."""
    size = DIGITS * width
    starts = [1 + DIGITS * PER_WALK * w + size * k for w in range(WALKS) for k in range(PER_WALK // width)]
    keys = F.array(*[F.xxhash64(F.lit(n), F.substring("fingerprint", at, size)) for n, at in enumerate(starts)])
    return found.select("doc_id", F.posexplode(keys).alias("band", "key"))


def sure_width(least: float) -> int:
    """The most slots that a band may have for any two fingerprints of a likeness of at least least (above 0) to agree on a whole band.

    In the best walk as great a share of slots agrees as on average. As many bands as it has other slots, and one more, cannot all be broken."""
    unlike = PER_WALK - int(np.ceil(PER_WALK * (least * (1 - CHANCE) + CHANCE)))
    return next((w for w in (4, 2) if PER_WALK // w > unlike), 1)


def _verify(least: float, width: int) -> Callable[[pa.Table], pa.Table]:
    """For some pairs of blocks of buckets (or of one with itself): each class with links, their number, the smallest id linked, and the smallest that links join it with here.

    A pair that shares several buckets counts in that of the first band on which it agrees."""
    whole = {4: np.uint64, 2: np.uint32, 1: np.uint16}[width]

    def pieces(key: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """A row, and the range of the rows that it meets."""
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True])))
        for a, z in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
            same = low[a] == high[a]
            middle = z if same else a + int((block[a:z] == low[a]).sum())
            yield from ((k, k + 1 if same else middle, z) for k in range(a, middle))

    def one(group: pa.Table) -> pa.Table:
        ids = group["class_id"].combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(ids.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        names, key, low, high, block = ids.dictionary.take(order), *(group[c].to_numpy() for c in ("key", "low", "high", "block"))
        rows = np.lexsort((block, high, low, key))
        x = np.frombuffer(b"".join(group["mark"].to_pylist()), np.uint16).reshape(-1, SLOTS)[rows]
        band, who = group["band"].to_numpy()[rows], place[ids.indices.to_numpy()][rows]
        wide = x.view(whole)
        links, near, root = np.zeros(len(names), np.int64), np.full(len(names), len(names)), np.arange(len(names))

        def compare(held: list[tuple[int, int, int]]) -> None:
            a = np.repeat([k for k, _, _ in held], [z - f for _, f, z in held])
            b = np.concatenate([np.arange(f, z) for _, f, z in held])
            first = (wide[a] == wide[b]).argmax(1) == band[a]
            a, b = a[first], b[first]
            close = alike(x[a], x[b]) >= least
            p, q = who[a[close]], who[b[close]]
            for here, there in ((p, q), (q, p)):
                np.add.at(links, here, 1)
                np.minimum.at(near, here, there)
            while ((u := root[p]) != (v := root[q])).any():
                np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
                while (root[root] != root).any():
                    root[:] = root[root]

        held, many = [], 0
        for k, f, z in pieces(key[rows], low[rows], high[rows], block[rows]):
            if f < z:
                held.append((k, f, z))
                if (many := many + z - f) >= PAIRS:
                    compare(held)
                    held, many = [], 0
        if held:
            compare(held)
        s = np.flatnonzero(links)
        return pa.table({"class_id": names.take(s), "links": pa.array(links[s], pa.int64()), "near_id": names.take(near[s]), "head": names.take(root[s])})

    return one


def alike_classes(own: DataFrame, least: float, kind: str) -> DataFrame:
    """Links (class_id, links, near_id, head) between all classes (class_id, fingerprint) of a likeness of at least least, in several rows a class.

    Bands are so narrow that no such pair is missed, and as wide as that allows. Those who share a bucket are compared, a large bucket by pairs of blocks of bounded size, and some thousand rows of
    blocks a call."""
    width = sure_width(least)
    banded = bands(own.withColumnRenamed("class_id", "doc_id"), width)
    shared = banded.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    placed = banded.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("doc_id", "band", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    met = cut(met)
    parcels = max(1, -(-met.count() // PARCEL))
    rows = met.join(own.select(F.col("class_id").alias("doc_id"), F.unhex("fingerprint").alias("mark")), "doc_id").withColumnRenamed("doc_id", "class_id")
    rows = rows.withColumn("parcel", F.pmod(F.xxhash64("key", "low", "high"), F.lit(parcels)))
    verified = _verify(least, width)
    return rows.groupBy("parcel").applyInArrow(lambda g: verified(g), f"class_id {kind}, links long, near_id {kind}, head {kind}")


def near_in_text(candidates: DataFrame, own: DataFrame, docs: DataFrame, least: float, kind: str) -> DataFrame:
    """Links (both ways) of the candidates a, b whose likeness is below least, but whose texts are at most EDITS of the longer apart.

    own has class_id and fingerprint, docs doc_id and text. A head's text is copied once for about HEAD_PAIRS of its pairs, so that none has all of them in one task."""
    lengths = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.min_by(F.length(F.coalesce("text", F.lit(""))), F.xxhash64("text")), F.lit(0)).alias("size"))
    own = own.join(lengths, own.class_id == lengths.doc_id).select("class_id", "fingerprint", "size")
    side = lambda x: own.select(F.col("class_id").alias(x), F.col("fingerprint").alias(f"mark_{x}"), F.col("size").alias(f"size_{x}"))
    # no text is moved for a pair whose lengths alone are too far apart
    sized = F.abs(F.col("size_a") - F.col("size_b")) <= F.floor(F.lit(EDITS) * F.greatest("size_a", "size_b"))
    marked = candidates.join(side("a"), "a").join(side("b"), "b").filter(sized)
    pairs = cut(marked.withColumn("like", likeness(F.col("mark_a"), F.col("mark_b"))).filter((F.col("like") >= PLAUSIBLE) & (F.col("like") < least)).select("a", "b"))
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(HEAD_PAIRS)).cast("int").alias("copies"))
    one = docs.join(needed, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("x")).select("doc_id", F.coalesce("x.text", F.lit("")).alias("text"))
    heads = one.join(copies, one.doc_id == copies.b).select("b", "copies", F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    placed = pairs.join(copies, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).drop("copies")
    both = placed.join(one.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(heads.drop("copies"), ["b", "copy"])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def near(x: str, y: str) -> bool:
            return within(code_points(x), code_points(y), int(EDITS * max(len(x), len(y))))

        return lambda b: b.filter(pa.array(map(near, texts(b, "text_a"), texts(b, "text_b")))).select(["a", "b"])

    found = map_batches(both.select("a", "b", "text_a", "text_b"), make, f"a {kind}, b {kind}")
    ways = F.explode(F.array(F.struct(F.col("a").alias("class_id"), F.col("b").alias("near_id")), F.struct(F.col("b").alias("class_id"), F.col("a").alias("near_id"))))
    return found.select(ways.alias("x")).select("x.class_id", F.lit(1).cast("long").alias("links"), "x.near_id", F.col("x.near_id").alias("head"))


def near_documents(docs: DataFrame, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest id with the same fingerprint); near_id (the smallest id of another class that is near), links (how many classes are), and component_id (the smallest class_id reachable over links).

    Near are classes of a likeness of at least least, and of those that such links do not join, the ones that share a bucket, one of them its smallest, if their texts are at most EDITS of the longer apart.
    All pairs as alike as that are found (alike_classes). Rows with a null id are of no class of their own."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = cut(fingerprints(docs, id_col, text_col))
    classes = cut(found.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")))
    own = classes.filter("class_id is not null")
    banded = bands(own.withColumnRenamed("class_id", "doc_id"))
    heads = banded.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    candidates = cut(banded.join(heads, "key").filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct())
    # who shares a band of several times the slots shares one of these
    some = candidates.select(F.col("a").alias("class_id")).unionByName(candidates.select(F.col("b").alias("class_id"))).distinct()
    alike_ones = cut(alike_classes(own if sure_width(least) < WIDTH else cut(own.join(some, "class_id", "left_semi")), least, kind))
    # texts are compared only where likeness has not joined the two classes yet
    joined = components(alike_ones.select(F.col("class_id").alias("a"), F.col("head").alias("b")))
    sides = [joined.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("a", "b")]
    apart = candidates.join(sides[0], "a", "left").join(sides[1], "b", "left").filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    linked = cut(alike_ones.unionByName(near_in_text(apart, own, plain(docs, id_col, text_col), least, kind)))
    joined = components(linked.select(F.col("class_id").alias("a"), F.col("head").alias("b"))).select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    best = linked.groupBy("class_id").agg(F.sum("links").alias("links"), F.min("near_id").alias("near_id"))
    ruled = classes.join(best, "class_id", "left").join(joined, "class_id", "left")
    members = found.join(ruled, "fingerprint")
    return members.select("doc_id", "class_id", "near_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "class_id").alias("component_id"))


def successors(docs: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text dealt out by ranges of the id (part), where each range also has the first row of the range after it (ahead = 1), and the last the first of all.

    Rows with a null id are dealt out by their text, and marked by ahead = 2."""
    every = plain(docs, id_col, text_col)
    own = every.filter("doc_id is not null")
    if parts > 1:
        bounds = sorted(set(own.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first()[0] or []))
    else:
        bounds = []
    part = sum((F.when(F.col("doc_id") > b, 1).otherwise(0) for b in bounds), F.lit(0)) if len(bounds) < 64 else F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col("doc_id") > b))
    own = own.withColumn("part", part)
    # one id a range: as many rows as there are parts
    firsts = sorted((r.part, r.first) for r in own.groupBy("part").agg(F.min("doc_id").alias("first")).collect())
    before = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    wanted = F.create_map(*[F.lit(x) for pair in before for x in pair]) if before else F.create_map(F.lit(-1), F.lit(0))
    both = F.array_compact(F.array(F.struct("part", F.lit(0).alias("ahead")), F.when(F.col("doc_id").isin([x for x, _ in before]), F.struct(wanted[F.col("doc_id")].alias("part"), F.lit(1).alias("ahead")))))
    placed = own.select("doc_id", "text", F.explode(both).alias("to")).select("doc_id", "text", "to.part", "to.ahead")
    others = every.filter("doc_id is null").select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int").alias("part"), F.lit(2).alias("ahead"))
    return placed.unionByName(others)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by part, ahead, doc_id: each document, its edited text with the next document's beginning, and the likeness to both."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None
    for b in batches:
        rows = [(i, t or "", ahead) for i, t, _, ahead in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)]
        for a, z in groups([len(t) for _, t, _ in rows], GROUP):
            codes = [code_points(t) for _, t, _ in rows[a:z]]
            ends = walks(codes)
            pairs = []
            for (i, text, ahead), code, end in zip(rows[a:z], codes, ends, strict=True):
                one = (i, text, code, end, sample(code, end))
                if ahead == 2:
                    pairs.append((one, ("", "0" * DIGITS * SLOTS)))
                    continue
                if held is not None:
                    pairs.append((held, (text, one[4])))
                # of what lies ahead only the first row counts
                held = None if ahead else one
            if held is not None:
                # not the whole group's steps with it
                held = (*held[:3], held[3].copy(), held[4])
            if pairs:
                yield pa.record_batch([pa.array(x) for x in zip(*_edited(pairs), strict=True)], names)


def _edited(pairs: list[tuple]) -> list[tuple]:
    """For each walked document and the next one's text and fingerprint: the result's row. The walks go on from where what is kept of the document ends."""
    cuts = [len(x[1]) // 4 for x, _ in pairs]
    tails = [code_points(text[:k]) for k, (_, (text, _)) in zip(cuts, pairs, strict=True)]
    keep = [len(x[1]) - k for k, (x, _) in zip(cuts, pairs, strict=True)]
    start = np.array([x[3][:, n - 1] if n else np.zeros(WALKS) for n, (x, _) in zip(keep, pairs, strict=True)], np.int64)
    out = []
    for ((i, text, code, ends, mark), (following, next_mark)), k, n, tail, later in zip(pairs, cuts, keep, tails, walks(tails, start), strict=True):
        edited = sample(np.concatenate((code[:n], tail)), np.concatenate((ends[:, :n], later), axis=1))
        digest = hashlib.sha256((text[:n] + following[:k]).encode("utf-8", "replace")).hexdigest()
        out.append((i, len(text), digest, mark, edited, _like(mark, edited), _like(mark, next_mark)))
    return out


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: its fingerprint, that of the text edited with the next document's beginning, and the likeness to the edited text and to the next document.

    Documents are ordered by id, equal ids by text; the next of the last is the first. A row with a null id has no place, and what follows it is the empty text."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = successors(docs, parts, id_col, text_col).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ahead", "doc_id", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
