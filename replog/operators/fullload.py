"""Full-load segments and tables (E17 to E21, R4): attempts are islands of a table's events, split by its reloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replog.operators import parse as R
from replog.operators.apply import recommend
from replog.operators.events import seconds
from replog.plans.scale import islands, topk_per_group, written

FILE, LINE = ["file_id"], "line_number"
KEYS = ["file_id", "table_id"]


def attempts(lines: DataFrame) -> DataFrame:
    """Events of each table with their attempt, from 1: a reload begins the next."""
    own = R.parse_full_load(lines).filter("table_id is not null")
    return islands(own, KEYS, LINE, F.col("kind") == "reload", "attempt").withColumn("attempt", F.col("attempt") + 1)


def _when(kinds: str, col: str = "timestamp"):
    return F.when(F.col("kind").rlike(f"^(?:{kinds})$"), F.col(col))


def segments(lines: DataFrame) -> DataFrame:
    """Each segment of each attempt (a table that is not segmented is segment 0): times, rows, durations, status. A completion whose segment the attempt did not start counts for the latest attempt that did."""
    own = attempts(lines).filter(F.col("kind").rlike("start_|unload_|load_|task_")).withColumn("seg", F.coalesce("seg", F.lit(0).cast("long")))
    w = W.partitionBy(*KEYS, "seg").orderBy(LINE).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = own.withColumn("attempt", F.coalesce(F.last(F.when(F.col("kind").startswith("start_"), F.col("attempt")), ignorenulls=True).over(w), F.col("attempt")))
    g = placed.groupBy(*KEYS, "attempt", "seg").agg(
        F.max(F.concat_ws(".", "schema", "table")).alias("table_name"), F.max("seg_total").alias("seg_total"), F.min(_when("start_segment|start_table")).alias("started"), F.max(_when("unload_segment|unload_table")).alias("unloaded"), F.max(_when("load_segment|load_table|task_segment|task_table")).alias("loaded"),
        F.max(_when("unload_segment|unload_table", "rows")).alias("rows_sent"), F.max(_when("load_segment|load_table", "rows")).alias("rows_received"), F.max("skipped").alias("rows_skipped"), F.max("volume").alias("volume"), F.min(LINE).alias("first_line"), F.min_by("subtask", LINE).alias("subtask"),
    )
    status = F.when(F.col("loaded").isNotNull(), "loaded").when(F.col("unloaded").isNotNull(), "unloaded").when(F.col("started").isNotNull(), "loading").otherwise("unknown")
    return g.withColumns({"unload_seconds": seconds(F.col("unloaded"), F.col("started")), "gap_seconds": seconds(F.col("loaded"), F.col("unloaded")), "total_seconds": seconds(F.col("loaded"), F.col("started")), "status": status})


def split_predicates(lines: DataFrame) -> DataFrame:
    """Each predicate with the segment last started by the subtask that its thread last got a command for."""
    own = R.parse_full_load(lines)
    thread = W.partitionBy("file_id", "thread_id").orderBy(LINE).rowsBetween(W.unboundedPreceding, W.currentRow)
    bound = own.withColumn("bound", F.last(F.when(F.col("kind") == "command", F.col("subtask")), ignorenulls=True).over(thread))
    events = bound.filter("kind in ('start_segment', 'where')").withColumn("key", F.when(F.col("kind") == "where", F.col("bound")).otherwise(F.col("subtask")))
    task = W.partitionBy("file_id", "key").orderBy(LINE).rowsBetween(W.unboundedPreceding, -1)
    seen = events.withColumn("s", F.last(F.when(F.col("kind") == "start_segment", F.struct("table_id", "seg", F.col(LINE).alias("start_line"))), ignorenulls=True).over(task))
    hits = seen.filter("kind = 'where' and s is not null").select("file_id", LINE, "predicate", F.col("key").alias("subtask"), "s.table_id", "s.seg", "s.start_line")
    return topk_per_group(hits, ["file_id", "table_id", "start_line"], [LINE], 1)


def tables(lines: DataFrame) -> DataFrame:
    """Each table's latest attempt: status, rows, volume, times; and how often it was reloaded."""
    s = segments(lines)
    last = W.partitionBy(*KEYS)
    current = s.withColumn("_last", F.max("attempt").over(last)).filter("attempt = _last")
    out = current.groupBy(*KEYS).agg(F.max("table_name").alias("table_name"), F.max("attempt").alias("attempts"), F.count("*").alias("segments"), F.count_if(F.col("status") == "loaded").alias("loaded_segments"), F.max("seg_total").alias("segment_count"), F.sum("rows_sent").alias("rows_sent"), F.sum("rows_received").alias("rows_received"), F.sum("rows_skipped").alias("rows_skipped"), F.sum("volume").alias("volume"), F.min("started").alias("started"), F.max("loaded").alias("loaded"), F.max("gap_seconds").alias("max_gap_seconds"))
    reloads = attempts(lines).groupBy(*KEYS).agg(F.count_if(F.col("kind") == "reload").alias("reload_count"), (F.max("attempt")).alias("attempt_count"))
    done = F.col("loaded_segments") >= F.greatest(F.coalesce("segment_count", F.lit(0)), F.col("segments"))
    return reloads.join(out.drop("attempts"), KEYS, "left").withColumn("status", F.when(done, "loaded").when(F.col("reload_count") > 0, "reloading").otherwise("loading"))


def report(lines: DataFrame) -> DataFrame:
    """One row a file: tables by status, rows, volume, most segments at once, running mode, whether the load completed."""
    t = tables(lines).groupBy("file_id").agg(F.count("*").alias("tables"), F.count_if(F.col("status") == "loaded").alias("loaded"), F.count_if(F.col("reload_count") > 0).alias("reloaded"), F.sum("rows_sent").alias("rows_sent"), F.sum("rows_received").alias("rows_received"), F.sum("volume").alias("volume"))
    steps = segments(lines).filter("started is not null").select("file_id", F.explode(F.array(F.struct(F.col("started").alias("at"), F.lit(1).alias("d")), F.struct(F.col("loaded").alias("at"), F.lit(-1).alias("d")))).alias("e")).select("file_id", "e.at", "e.d").filter("at is not null")
    many = steps.withColumn("n", F.sum("d").over(W.partitionBy("file_id").orderBy("at", "d").rowsBetween(W.unboundedPreceding, 0))).groupBy("file_id").agg(F.max("n").alias("max_parallel"))
    modes = R.parse_full_load(lines).groupBy("file_id").agg(F.max_by("task", F.when(F.col("task").isNotNull(), F.col(LINE))).alias("task"), F.max_by("mode", F.when(F.col("mode").isNotNull(), F.col(LINE))).alias("running_mode"), F.max(F.col("kind") == "completed").alias("completed"))
    return t.join(many, "file_id", "left").join(modes, "file_id", "left")


def condensed(lines: DataFrame, k: int = 15) -> DataFrame:
    """The first tables of each file."""
    return topk_per_group(tables(lines), FILE, ["table_id"], k, "rank")


def condensed_warnings(lines: DataFrame, most_insights: int = 8, most_reloads: int = 10) -> DataFrame:
    """What goes with the first tables: of each file the first insights, by priority, and the first reloads, by line: (file_id, kind, rank, line_number, title, table_id, seg, timestamp)."""
    own = written(lines)
    told = topk_per_group(insights(own), FILE, ["priority", "area", "title"], most_insights, "rank").select("file_id", F.lit("insight").alias("kind"), "rank", "title")
    again = topk_per_group(R.parse_full_load(own).filter("kind = 'reload'"), FILE, [LINE], most_reloads, "rank").select("file_id", F.lit("reload").alias("kind"), "rank", LINE, "table_id", "seg", "timestamp")
    return told.unionByName(again, True)


def insights(lines: DataFrame) -> DataFrame:
    """Warnings about loads: reloads, slow segments, gaps, rows that differ, loads in progress."""
    t = tables(lines).groupBy("file_id").agg(F.sum("reload_count").alias("reloads"), F.max("max_gap_seconds").alias("gap"), F.count_if(F.col("rows_sent") != F.col("rows_received")).alias("differ"), F.count_if(F.col("status") != "loaded").alias("open"))
    s = segments(lines).groupBy("file_id").agg(F.count_if(F.col("total_seconds") >= 3600).alias("slow"))
    return recommend(t.join(s, "file_id", "left"), [(F.col("reloads") > 0, 1, "full load", "reload_loop"), (F.col("slow") > 0, 2, "full load", "slow_segments"), (F.col("gap") >= 30, 2, "full load", "load_gap"), (F.col("differ") > 0, 1, "full load", "row_mismatch"), (F.col("open") > 0, 3, "full load", "in_progress")])


def insight_segments(lines: DataFrame) -> DataFrame:
    """The segments that warnings speak of, ranked: the five slowest of an hour or more, the three longest gaps of 30 s or more, the first five whose rows differ."""
    own = written(segments(lines))
    kinds = (("slow_segment", F.col("total_seconds") >= 3600, F.col("total_seconds"), True, 5), ("load_gap", F.col("gap_seconds") >= 30, F.col("gap_seconds"), True, 3), ("row_mismatch", F.col("rows_sent") != F.col("rows_received"), (F.col("rows_sent") - F.col("rows_received")).cast("double"), False, 5))
    out = None
    for kind, cond, value, largest, k in kinds:
        hits = own.filter(cond).select("file_id", "table_id", "attempt", "seg", value.alias("value"))
        best = topk_per_group(hits, FILE, [*([F.desc("value")] if largest else []), "table_id", "attempt", "seg"], k, "rank").withColumn("kind", F.lit(kind))
        out = best if out is None else out.unionByName(best)
    return out.select("file_id", "kind", "rank", "table_id", "attempt", "seg", "value")
