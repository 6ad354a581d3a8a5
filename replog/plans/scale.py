"""Shapes that order-dependent operators are made of. Each takes column names and works on any table.

State that runs along a key's rows is a window over that key, never a pass over one task's rows; keys are as fine as the meaning allows, and
rows are filtered to the events that matter before the window sorts them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: Sequence[str | Column]):
    return W.partitionBy(*keys).orderBy(*order)


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], split: str | None = None, once: bool = False) -> DataFrame:
    """cols filled with their last value before, by key in order.

    With split (a column that grows with the order, such as the block of a file), the fill runs inside each split; what each split ends with
    is carried over a small table of splits, and joined to the rows that are still null. One large file so fills in many tasks. With once, rows filled inside their splits are
    written, so that what they are made of is worked out a single time; the table of splits, a row for thousands, goes to every task."""
    if split is None:
        before = ordered(keys, [order]).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in cols})
    inside = ordered([*keys, split], [order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = df.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in cols})
    local = written(local) if once else local
    # of what is filled inside the splits, so that both sides read one exchange
    ends = local.groupBy(*keys, split).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in cols])
    earlier = ordered(keys, [split]).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumns({f"_{c}": F.last(f"_{c}", ignorenulls=True).over(earlier) for c in cols})
    joined = _by_split(local, F.broadcast(carried) if once else carried, [*keys, split])
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def _by_split(rows: DataFrame, carried: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows with what was carried to their split; null keys meet null keys."""
    other = carried.select(*[F.col(k).alias(f"_k_{k}") for k in on], *[c for c in carried.columns if c not in on])
    same = [rows[k].eqNullSafe(other[f"_k_{k}"]) for k in on]
    return rows.join(other, same, "left").drop(*[f"_k_{k}" for k in on])


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str, split: str) -> DataFrame:
    """df with the number of each row, from 0, by key in order: each split (a column that grows with the order) counts its own rows, and those of the splits before it are added. The
    table of splits, a row for thousands, goes to every task, so that rows stay where they were counted."""
    local = df.withColumn(name, F.row_number().over(ordered([*keys, split], [order])) - 1)
    per = df.groupBy(*keys, split).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(ordered(keys, [split]).rowsBetween(W.unboundedPreceding, -1))
    carried = per.select(*keys, split, F.coalesce(before, F.lit(0)).alias("_rows"))
    joined = _by_split(local, F.broadcast(carried), [*keys, split])
    return joined.withColumn(name, (F.col(name) + F.col("_rows")).cast(local.schema[name].dataType)).drop("_rows")


def lagged(df: DataFrame, keys: Sequence[str], order: str, cols: dict[str, Column], split: str | None = None) -> DataFrame:
    """df with new columns: the values that the row before has, by key in order; null at a key's first row. With split, the last row of each split is carried to the next one that the key has."""
    if split is None:
        return df.withColumns({n: F.lag(c).over(ordered(keys, [order])) for n, c in cols.items()})
    own = df.withColumn("_own", F.struct(*[c.alias(n) for n, c in cols.items()]))
    local = own.withColumn("_lag", F.lag("_own").over(ordered([*keys, split], [order])))
    ends = local.groupBy(*keys, split).agg(F.max_by("_own", order).alias("_end"))
    carried = ends.withColumn("_end", F.lag("_end").over(ordered(keys, [split])))
    joined = _by_split(local, carried, [*keys, split]).withColumn("_lag", F.coalesce("_lag", "_end"))
    return joined.select(*df.columns, *[F.col("_lag")[n].alias(n) for n in cols])


def islands(df: DataFrame, keys: Sequence[str], order: str, starts: Column, name: str = "island", closed: bool = False, split: str | None = None) -> DataFrame:
    """The number of starts so far, by key in order; with closed, starts at this row do not count yet (rows end an island). With split, each split counts its own, and the counts of those before it are added."""
    one = F.when(starts, 1).otherwise(0)
    within = [*keys] if split is None else [*keys, split]
    rows = ordered(within, [order]).rowsBetween(W.unboundedPreceding, -1 if closed else W.currentRow)
    local = df.withColumn("_one", one).withColumn(name, F.coalesce(F.sum("_one").over(rows), F.lit(0)))
    if split is None:
        return local.drop("_one")
    per = local.groupBy(*within).agg(F.sum("_one").alias("_sum"))
    before = per.withColumn("_sum", F.sum("_sum").over(ordered(keys, [split]).rowsBetween(W.unboundedPreceding, -1)))
    joined = _by_split(local, before, within)
    return joined.withColumn(name, F.col(name) + F.coalesce("_sum", F.lit(0))).drop("_one", "_sum")


def runs(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str = "run", split: str | None = None) -> DataFrame:
    """Numbers the runs of equal values, by key in order."""
    # a struct around the value, so that a null before is told from no row before
    marked = lagged(df.withColumn("_value", F.struct(value.alias("v"))), keys, order, {"_before": F.col("_value")}, split)
    new = F.col("_before").isNull() | ~F.col("_value").eqNullSafe(F.col("_before"))
    return islands(marked.withColumn("_new", new).drop("_value", "_before"), keys, order, F.col("_new"), name, split=split).drop("_new")


def pair_events(df: DataFrame, keys: Sequence[str], order: str, opens: Column, carry: Sequence[str], split: str | None = None) -> DataFrame:
    """Closing rows whose event before, of the same key, is an opening one, with that one's columns as open_*. A later opening replaces an earlier one, and a closing row takes it away."""
    seen = lagged(df.withColumn("_opens", opens), keys, order, {"_after_open": F.col("_opens"), **{f"open_{c}": F.col(c) for c in carry}}, split)
    return seen.filter(~F.col("_opens") & F.col("_after_open")).drop("_opens", "_after_open")


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, take: Sequence[str], split: str | None = None) -> DataFrame:
    """left with the columns take of the last row of right at or before it, by key. With split, both sides have that column, and it grows with the order."""
    more = [split] if split else []
    a = left.select("*", F.lit(None).cast(right.schema[right_on].dataType).alias("_at"), F.col(left_on).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_r_{c}") for c in take])
    b = right.select(*[F.col(c) if c in [*keys, *more] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(right_on).alias("_at"), F.col(right_on).alias("_t"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_r_{c}") for c in take])
    both = a.unionByName(b).withColumns({"_place": F.struct("_t", "_side"), "_last": F.when(F.col("_side") == 0, F.struct(*[f"_r_{c}" for c in take]))})
    filled = forward_fill(both, keys, "_place", ["_last"], split).filter("_side = 1")
    return filled.select(*left.columns, *[F.col("_last")[f"_r_{c}"].alias(c) for c in take])


def next_value(value: Column, when: Column, keys: Sequence[str], order: str) -> Column:
    """The value of the next later row where the condition holds."""
    return F.first(F.when(when, value), ignorenulls=True).over(ordered(keys, [order]).rowsBetween(1, W.unboundedFollowing))


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], point: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Rows of left whose point lies in [start, end] of a row of right with the same keys (numbers): an equi-join on buckets of the width, each of right's rows in every bucket that it touches."""
    bucket = lambda c: F.floor(F.col(c) / width)
    a = left.withColumn("_bucket", bucket(point))
    b = right.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    b = b.select("_bucket", *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [a["_bucket"] == b["_bucket"], *[a[k] == b[f"_k_{k}"] for k in keys], a[point] >= b[start], a[point] <= b[end]]
    return a.join(b, on, how).drop(a["_bucket"], b["_bucket"], *[f"_k_{k}" for k in keys])


def topk_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key in order."""
    ranked = df.withColumn(rank or "_rank", F.row_number().over(ordered(keys, order))).filter(F.col(rank or "_rank") <= k)
    return ranked if rank else ranked.drop("_rank")


def bucket_of(value: Column) -> Column:
    """A bucket that grows with the value: about a thousandth of its size wide. Infinite values and NaN are in the outermost ones."""
    size = F.floor(F.least(F.log1p(F.abs(value.cast("double"))), F.lit(1000.0)) * 1024).cast("long")
    return F.when(value < 0, -size).otherwise(size)


def floor_percentile(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """For each key, the values at place floor(n * share) of the sorted ones, counted from 0, and n. Nulls do not count.

    Equal values are counted first. Then the counts of buckets of values say which bucket holds a place, and only the values of those buckets are put in order: no
    task sorts all that a key has, and buckets of a key are a bounded number."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")).withColumn("_bucket", bucket_of(F.col(value)))
    per = counted.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_n"))
    w = W.partitionBy(*keys).orderBy("_bucket")
    placed = per.select(*keys, "_bucket", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.col("_n").alias("_in"), F.sum("_n").over(W.partitionBy(*keys)).alias("_total"))
    place = lambda p: F.least(F.floor(F.col("_total") * p), F.col("_total") - 1)
    inside = lambda p, a, n: (place(p) >= F.col(a)) & (place(p) < F.col(a) + F.col(n))
    holds = placed.filter(reduce(or_, [inside(p, "_before", "_in") for p in shares])).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), "_before", "_total")
    same = [counted[k].eqNullSafe(holds[f"_k_{k}"]) for k in keys]
    few = counted.join(holds, [*same, counted["_bucket"] == holds["_b"]]).drop("_b", *[f"_k_{k}" for k in keys])
    order = W.partitionBy(*keys, "_bucket").orderBy(value)
    ranked = few.withColumn("_at", F.col("_before") + F.sum("_n").over(order) - F.col("_n"))
    at = [F.max(F.when(inside(p, "_at", "_n"), F.col(value))).alias(n) for p, n in zip(shares, names, strict=True)]
    return ranked.groupBy(*keys).agg(F.max("_total").alias("n"), *at)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for tables in between: what spark.checkpoint.dir names. In local mode, where all is one machine, a temporary one stands in."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder, and read again, so that what goes on from it several times is planned and worked out once."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
