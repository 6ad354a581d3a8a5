"""Operator 3: mixes sources to target weights by the cube method.

Each source gets a target size. A document of a source with the rate r = target / size is taken floor(r) times for certain and once more with
the inclusion probability r - floor(r). These probabilities are rounded to 0 or 1 by the flight phase of the cube method: a vector of
probabilities walks along the null space of the balancing constraints (the source's words and its number of documents), so that both totals
stay where they were. Units of like size fly together, large ones first; the few left of each size go on along the words alone against smaller
ones, so that the last one left is small. Flights run in parallel over blocks of a source; what each leaves fractional flies again in larger
company, until one small landing problem a source remains.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, ranked last; rows that share id, source and
text are copies, among which the copies taken are dealt out evenly, whichever of them; a null id is an id like any other; units of equal size
fly in the order of a hash; long texts are counted whole; further columns are kept as they are, whatever their names, by sample_documents; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, fresh

#: Documents in one flight, and how many small ones of them wait for the last.
BLOCK, HELD = 4096, 64
#: As near to 0 or 1 as this, a probability is settled.
EDGE = 1e-9


def flight(level: int) -> Callable[[pa.Table], pa.Table]:
    """Flies one block of units, large ones first; the order and the chances do not depend on how they came. A source's only block lands."""

    def one(g: pa.Table) -> pa.Table:
        g = g.sort_by([("size", "descending"), ("_k1", "ascending"), ("_k2", "ascending")])
        size, p = g["size"].to_pylist(), g["p"].to_pylist()
        land = g["blocks"][0].as_py() == 1
        wait = set() if land else set(np.linspace(len(p) // 2, len(p) - 1, HELD).astype(int).tolist())
        own = [k for k in range(len(p)) if k not in wait]
        flown = fly([size[k] for k in own], [p[k] for k in own], [level, int(g["_k1"][0].as_py()) & 0xFFFFFFFF], land)
        for k, x in zip(own, flown, strict=True):
            p[k] = x
        return g.set_column(g.schema.get_field_index("p"), "p", pa.array(p, pa.float64())).drop_columns(["block", "blocks"])

    return one


def marks(id_col: str, text_col: str) -> list[Column]:
    """Two hashes of id and text, which equal rows share, and the number of words."""
    return [F.xxhash64(id_col, text_col), F.hash(id_col, text_col), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")]


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source and size, the number of words, of every document, and the hashes that equal rows share."""
    k1, k2, size = marks(id_col, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), k1.alias("_k1"), k2.alias("_k2"))


def targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size and target. Sources by code point, null last, take the weights in turn and share the total of all sizes by weight.

    A target stops at most times its source's size. Resharing the excess by weight until none is above ends at the level x where the sum of
    min(most * size, x * weight) is the total; sources are filled in the order of most * size / weight, so x comes from running sums over
    the table of sources (one row for each); the first source that stays below its own limit has the highest level."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = W.partitionBy()
    per = per.withColumn("below", F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("above", F.sum("weight").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing)))
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    per = per.withColumn("level", (F.col("total") - F.col("below")) / F.col("above"))
    per = per.withColumn("x", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    return per.select("source", "source_size", F.coalesce(F.least("cap", F.col("x") * F.col("weight")), "cap").alias("target"))


def step(p: list[float], held: list[int], u: list[float], chance: float) -> list[int]:
    """Moves p of the held units along u, one way or the other so that each keeps its mean, until one of them is 0 or 1; gives those that are not."""
    up = min(((1 - p[h]) / x if x > 0 else -p[h] / x for h, x in zip(held, u, strict=True) if x), default=0.0)
    down = min((p[h] / x if x > 0 else (p[h] - 1) / x for h, x in zip(held, u, strict=True) if x), default=0.0)
    by = up if chance * (up + down) < down else -down
    for h, x in zip(held, u, strict=True):
        y = p[h] + by * x
        p[h] = 0.0 if y < EDGE else 1.0 if y > 1 - EDGE else y
    return [h for h in held if 0 < p[h] < 1]


def fly(size: list[int], p: list[float], seed: list[int], land: bool) -> list[float]:
    """The flight phase over one block, whose units come with the largest first.

    Units of like size (within a power of two) fly three at a time in the null space of both constraints, words and documents. At most two of
    them are left; along the words alone they go on until one is. It flies on against the next smaller units, words alone, until it is settled,
    so that what is left at the end is small. With land, that last one is rounded, and small documents make up for it."""
    p, rng, left = list(p), np.random.default_rng(seed), None
    chance, kinds = iter(rng.random(4 * len(p) + 8).tolist()), {}
    start = 0.0
    for k, n in enumerate(size):
        if EDGE < p[k] < 1 - EDGE:
            kinds.setdefault(int(n).bit_length(), []).append(k)
            start += p[k] * n
        else:
            p[k] = float(round(p[k]))
    for kind in sorted(kinds, reverse=True):
        held: list[int] = []
        for k in kinds[kind]:
            if left is not None:
                rest = step(p, [left, k], [size[k], -size[left]], next(chance))
                if left in rest:
                    continue
                held, left = rest, None
                continue
            held.append(k)
            if len(held) == 3:
                a, b, c = (size[h] for h in held)
                held = step(p, held, [b - c, c - a, a - b] if a != b or b != c else [1, -1, 0], next(chance))
        while len(held) > 1:
            held = step(p, held[:2], [size[held[1]], -size[held[0]]], next(chance)) + held[2:]
        if held:
            left = held[0]
    if land and left is not None:
        p[left] = float(round(p[left]))
        mend(size, p, [k for ks in kinds.values() for k in ks], start)
    return p


def mend(size: list[int], p: list[float], own: list[int], goal: float) -> None:
    """Takes or leaves one document or two, always those that bring the words nearest to the goal, until none bring them nearer."""
    n, taken = np.array([size[k] for k in own], float), np.array([p[k] for k in own])
    over = float((n * taken).sum()) - goal
    while True:
        change = n * (1 - 2 * taken)
        order = np.argsort(change, kind="stable")
        # alone, or with the one whose change comes nearest to what is then left
        place = np.searchsorted(change[order], -over - change)
        found = [(abs(over + change[k]), (k,)) for k in [int(np.abs(over + change).argmin())]]
        for shift in (-1, 0):
            other = order[np.clip(place + shift, 0, len(n) - 1)]
            both = np.where(other == np.arange(len(n)), np.inf, np.abs(over + change + change[other]))
            k = int(both.argmin())
            found.append((both[k], (k, int(other[k]))))
        near, some = min(found)
        if near >= abs(over) - 1e-9:
            break
        for k in some:
            over += change[k]
            taken[k] = 1 - taken[k]
    for k, t in zip(own, taken.tolist(), strict=True):
        p[k] = t


def mixed_units(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, block: int = BLOCK, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, the hashes, source_size, target, rows (how many equal rows there are) and total (the copies that they get together)."""
    sized = cut(sizes(docs, id_col, text_col, source_col))
    goal = targets(sized, weights, most)
    units = sized.groupBy("doc_id", "source", "size", "_k1", "_k2").agg(F.count("*").alias("rows"))
    units = units.join(goal, units.source.eqNullSafe(goal.source)).drop(goal.source)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("want", F.when(F.col("size") > 0, rate * F.col("rows")).otherwise(0.0))
    units = units.withColumn("sure", F.floor("want")).withColumn("p", F.col("want") - F.col("sure")).drop("want")
    per = units.groupBy("source").agg(F.count("*").alias("n"))
    most = per.agg(F.max("n")).first()[0] or 0
    units = units.join(per.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    schema = ", ".join(f"`{n}` {t}" for n, t in units.dtypes)
    level = 0
    while True:
        # a hash deals a source's documents out evenly, however many it has
        dealt = units.withColumn("blocks", F.ceil(F.col("n") / F.lit(block))).withColumn("block", F.pmod(F.xxhash64("_k1", F.lit(level)), F.col("blocks")))
        moving = (F.col("p") > 0) & (F.col("p") < 1)
        flown = dealt.filter(moving).groupBy("source", "block").applyInArrow(flight(seed + level), schema)
        units = cut(flown.unionByName(dealt.filter(~moving).drop("block", "blocks")))
        if most <= block:
            break
        units = units.withColumn("n", F.lit(HELD + 1) * F.ceil(F.col("n") / F.lit(block)))
        most, level = (HELD + 1) * -(-most // block), level + 1
    return units.select("doc_id", "source", "size", "_k1", "_k2", "source_size", "target", "rows", (F.col("sure") + F.round("p").cast("long")).alias("total"))


def share(nth: str) -> Column:
    """The copies that the nth of some equal rows gets."""
    return (F.floor(F.col("total") / F.col("rows")) + F.when(F.col(nth) <= F.col("total") % F.col("rows"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (how often the mix takes the document) for every row of docs."""
    rows = mixed_units(docs, **options).withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", share("_nth").alias("copies"))


def sample_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs as the mix takes them: a document taken twice comes twice, one taken 0 times not at all; all columns stay as they are."""
    k1, k2, source, nth, copy, rows, total = fresh(docs, "k1", "k2", "source", "nth", "copy", "rows", "total")
    taken = mixed_units(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).filter("total > 0")
    taken = taken.select(F.col("_k1").alias(k1), F.col("_k2").alias(k2), F.col("source").alias(source), F.col("rows").alias(rows), F.col("total").alias(total))
    a, b, _ = marks(id_col, text_col)
    own = docs.withColumns({f"{k1}_": a, f"{k2}_": b})
    same = (F.col(f"{k1}_") == F.col(k1)) & (F.col(f"{k2}_") == F.col(k2)) & F.col(source_col).cast("string").eqNullSafe(F.col(source))
    found = own.join(taken, same).withColumn(nth, F.row_number().over(W.partitionBy(k1, k2, source).orderBy(k1)))
    copies = (F.floor(F.col(total) / F.col(rows)) + F.when(F.col(nth) <= F.col(total) % F.col(rows), 1).otherwise(0)).cast("long")
    return found.withColumn(copy, copies).filter(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy)))).select(*docs.columns)
