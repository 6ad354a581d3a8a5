"""Events paired and gathered along the order of lines (E1 to E16, E22 to E27): islands, pairs and gaps by file, table, path or name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replog.functions import patterns as P
from replog.operators import parse as R
from replog.plans.scale import asof_backward, forward_fill, islands, lagged, next_value, ordered, pair_events, runs, written

FILE, LINE = ["file_id"], "line_number"


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two times of second precision."""
    return F.timestamp_diff("SECOND", earlier, later).cast("double")


def _last(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col(LINE)))


def _with(split: str | None) -> list[str]:
    return [split] if split else []


def _apply_lines(lines: DataFrame, split: str | None = None) -> DataFrame:
    """Lines of the apply component that batches are made of, with their parts as columns."""
    reason = (F.col("body").contains("Finish Bulk") | F.col("body").contains("Finish bulk") | (F.col("body").contains("same bulk") & (F.col("body").contains("same PK") | F.col("body").contains("changes PK"))))
    a, b = R.found("body", P.RUN_STATEMENT, 2).cast("long"), R.found("body", P.RUN_STATEMENT, 3).cast("long")
    table = F.when(R.matches("body", P.START_APPLYING), F.concat(R.found("body", P.START_APPLYING, 3), F.lit("."), R.found("body", P.START_APPLYING, 4)))
    own = lines.filter((F.col("component") == "TARGET_APPLY") & F.col("body").rlike(r"(?i)bulk|Going to run|Start applying"))
    cols = own.select("file_id", LINE, *_with(split), "timestamp", "body", R.matches("body", P.BATCH_START).alias("starts"), F.col("body").contains("Bulk finished.").alias("ends"), F.when(reason, R.closure_reason()).alias("reason"), (b - a + 1).alias("changes"), table.alias("table_name"))
    return cols.filter("starts or ends or reason is not null or changes is not null or table_name is not null")


def batches(lines: DataFrame, split: str | None = None) -> DataFrame:
    """Apply batches: from a start line to the first end line after it; reasons, changes and tables between count. The last start wins."""
    marked = islands(_apply_lines(lines, split), FILE, LINE, F.col("starts"), split=split).filter("island > 0")
    first_end = F.min(F.when(F.col("ends"), F.col(LINE))).over(W.partitionBy("file_id", "island"))
    own = marked.withColumn("end_line", first_end).filter(F.col(LINE) <= F.col("end_line"))
    out = own.groupBy("file_id", "island").agg(
        F.max("end_line").alias(LINE), F.min_by("timestamp", LINE).alias("start_timestamp"), F.max_by("timestamp", LINE).alias("end_timestamp"), F.coalesce(_last(F.col("reason")), F.lit("Normal")).alias("closure_reason"),
        F.coalesce(F.sum("changes"), F.lit(0)).alias("changes_count"), F.count("changes").alias("applies_count"), F.array_sort(F.collect_set("table_name")).alias("tables"),
    )
    return out.filter("start_timestamp is not null and end_timestamp is not null").select("file_id", LINE, "start_timestamp", "end_timestamp", seconds(F.col("end_timestamp"), F.col("start_timestamp")).alias("duration_seconds"), "closure_reason", "changes_count", "applies_count", "tables")


def bulk_activity_batches(lines: DataFrame) -> DataFrame:
    """The second dialect: every end line closes a batch, which starts at its first statement and counts only with changes. Merges count as any other verb."""
    own = islands(_apply_lines(lines), FILE, LINE, F.col("ends"), closed=True)
    ran = F.col("changes").isNotNull()
    out = own.groupBy("file_id", "island").agg(
        F.max(F.when(F.col("ends"), F.col(LINE))).alias(LINE), F.min_by("timestamp", F.when(ran, F.col(LINE))).alias("start_timestamp"), F.max_by("timestamp", F.when(F.col("ends"), F.col(LINE))).alias("end_timestamp"),
        F.coalesce(F.sum("changes"), F.lit(0)).alias("changes_count"), F.count("changes").alias("applies_count"), F.coalesce(_last(F.when(F.col("reason").isNotNull(), R.closure_reason_activity())), F.lit("Normal")).alias("closure_reason"),
    )
    return out.filter(f"{LINE} is not null and changes_count > 0").withColumn("duration_seconds", seconds(F.col("end_timestamp"), F.col("start_timestamp"))).drop("island")


def script_batches(lines: DataFrame) -> DataFrame:
    """The third dialect: a batch lasts from the end of the one before; end lines at once after another end line do not count."""
    own = _apply_lines(lines)
    w = ordered(FILE, [LINE])
    own = own.withColumn("ends", F.col("ends") & ~F.coalesce(F.lag("ends").over(w), F.lit(False)))
    own = islands(own, FILE, LINE, F.col("ends"), closed=True)
    out = own.groupBy("file_id", "island").agg(F.max(F.when(F.col("ends"), F.col(LINE))).alias(LINE), F.max_by("timestamp", F.when(F.col("ends"), F.col(LINE))).alias("end_timestamp"), F.coalesce(F.sum("changes"), F.lit(0)).alias("changes_count"), F.count("changes").alias("applies_count"), F.coalesce(_last(F.when(F.col("reason").isNotNull(), R.closure_reason_script())), F.lit("!!!")).alias("closure_reason"))
    out = out.filter(f"{LINE} is not null")
    return out.withColumn("duration_seconds", seconds(F.col("end_timestamp"), F.lag("end_timestamp").over(ordered(FILE, [LINE])))).drop("island")


def table_apply_pairs(lines: DataFrame, split: str | None = None) -> DataFrame:
    """Finished applies with the start before of the same table, and the seconds between."""
    own = R.parse_apply(lines, *_with(split)).filter("kind in ('start', 'finish') and timestamp is not null")
    pairs = pair_events(own, ["file_id", "table_name"], LINE, F.col("kind") == "start", [LINE, "timestamp", "op", "n"], split)
    return pairs.select("file_id", "table_name", F.col(f"open_{LINE}").alias("start_line"), F.col(LINE).alias("finish_line"), F.col("open_op").alias("op"), F.col("n").alias("events"), seconds(F.col("timestamp"), F.col("open_timestamp")).alias("duration_seconds"))


def table_stats(lines: DataFrame, split: str | None = None) -> DataFrame:
    """Operations, apply times and flags of each table. The count is the number beside the verb; UNKNOWN counts as merges."""
    own = lines.filter(F.col("component") == "TARGET_APPLY")
    starts = R.parse_apply(lines).filter("kind = 'start' and timestamp is not null").select("file_id", "table_name", "op", "n")
    flags = own.filter((F.lower("body").contains("one-by-one") & F.col("body").contains("Applying")) | R.matches("body", P.NO_PK)).select("file_id", R.table_name().alias("table_name"), F.col("body").contains("Applying").alias("one"), R.matches("body", P.NO_PK).alias("no_pk")).filter("table_name is not null")
    rows = starts.unionByName(table_apply_pairs(lines, split).select("file_id", "table_name", "duration_seconds"), True).unionByName(flags, True)
    total = lambda op: F.coalesce(F.sum(F.when(F.col("op") == op, F.col("n"))), F.lit(0))
    return rows.groupBy("file_id", "table_name").agg(
        total("INSERT").alias("total_inserts"), total("UPDATE").alias("total_updates"), total("DELETE").alias("total_deletes"), total("UNKNOWN").alias("total_merges"), F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("total_apply_time_seconds"),
        F.avg("duration_seconds").alias("avg_apply_time_seconds"), F.greatest(F.coalesce(F.max("duration_seconds"), F.lit(0.0)), F.lit(0.0)).alias("max_apply_time_seconds"), F.count(F.when(F.col("one"), 1)).alias("one_by_one_count"), F.when(F.max("no_pk"), F.lit(False)).alias("has_pk"), F.lit(0).cast("long").alias("error_count"),
    )


def redo_sessions(lines: DataFrame, split: str | None = None) -> DataFrame:
    """Redo logs from opening to closing, by path; the thread is the message's, else the opening line's, else the closing one's."""
    pairs = pair_events(R.parse_redo(lines, *_with(split)), ["file_id", "redo_path"], LINE, F.col("opens"), [LINE, "timestamp", "thread_id", "thread_in_message"], split)
    out = pairs.select("file_id", F.coalesce("open_thread_in_message", "open_thread_id", "thread_id").alias("thread_id"), "redo_path", F.col(f"open_{LINE}").alias("line_open"), F.col(LINE).alias("line_close"), F.col("open_timestamp").alias("timestamp_open"), F.col("timestamp").alias("timestamp_close"), seconds(F.col("timestamp"), F.col("open_timestamp")).alias("duration_seconds"))
    return out.filter("duration_seconds >= 0")


def component_stats(lines: DataFrame) -> DataFrame:
    """Lines, and the first and last time in the order of lines, of each component's threads."""
    timed = F.when(F.col("timestamp").isNotNull(), F.col(LINE))
    return lines.filter("component is not null and thread_id is not null").groupBy("file_id", "component", "thread_id").agg(F.count("*").alias("message_count"), F.min_by("timestamp", timed).alias("first_ts"), F.max_by("timestamp", timed).alias("last_ts"))


def merge_worker_threads(stats: DataFrame, lines: DataFrame) -> DataFrame:
    """stats with capture threads that only ever read for a statement folded into one virtual thread for the statement."""
    reads = lines.filter((F.col("component") == "SOURCE_CAPTURE") & R.matches("body", P.ASM_READ)).select("file_id", "thread_id", R.found("body", P.ASM_READ).alias("stmt"))
    per = reads.groupBy("file_id", "thread_id", "stmt").agg(F.count("*").alias("n"))
    total = per.groupBy("file_id", "thread_id").agg(F.sum("n").alias("message_count")).withColumn("component", F.lit("SOURCE_CAPTURE"))
    workers = stats.join(total, ["file_id", "component", "thread_id", "message_count"])
    pool = per.join(workers, ["file_id", "thread_id"]).groupBy("file_id", "stmt").agg(F.sum("n").alias("message_count"), F.count_distinct("thread_id").alias("threads"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    virtual = pool.select("file_id", F.lit("SOURCE_CAPTURE").alias("component"), F.concat(F.lit("__asm:"), "stmt", F.lit(":"), "threads").alias("thread_id"), "message_count", "first_ts", "last_ts")
    return stats.join(workers.select("file_id", "component", "thread_id"), ["file_id", "component", "thread_id"], "left_anti").unionByName(virtual)


def dominant_component(stats: DataFrame) -> DataFrame:
    """Each thread's most frequent component (ties by name), and the totals by it."""
    first = F.row_number().over(W.partitionBy("file_id", "thread_id").orderBy(F.desc("message_count"), "component"))
    chosen = stats.withColumn("_r", first).filter("_r = 1").select("file_id", "thread_id", F.col("component").alias("dominant"))
    return stats.join(chosen, ["file_id", "thread_id"]).groupBy("file_id", F.col("dominant").alias("component")).agg(F.count_distinct("thread_id").alias("threads"), F.sum("message_count").alias("message_count"))


def file_operations(lines: DataFrame, simple: bool = False, split: str | None = None) -> DataFrame:
    """File uploads: compress start, compression and upload of a file name, with seconds and throughput.

    A compression belongs to the file whose compress start came last. With simple, only the whole time counts."""
    own = R.parse_file_ops(lines, *_with(split)).withColumn("_start", F.when(F.col("kind") == "start", F.col("csv_name")))
    named = forward_fill(own, FILE, LINE, ["_start"], split).withColumn("name", F.coalesce("csv_name", "_start")).filter("name is not null")
    marked = islands(named, ["file_id", "name"], LINE, F.col("kind") == "uploaded", closed=True, split=split)
    at = lambda kind: F.min_by("timestamp", F.when(F.col("kind") == kind, F.col(LINE)))
    out = marked.groupBy("file_id", "name", "island").agg(F.max(F.when(F.col("kind") == "uploaded", F.col(LINE))).alias(LINE), at("start").alias("started"), at("compressed").alias("compressed"), at("uploaded").alias("uploaded"), F.max("size_bytes").alias("size_bytes")).filter(f"{LINE} is not null")
    total = F.coalesce(seconds(F.col("uploaded"), F.col("started")), F.lit(0.0))
    out = out.withColumn("total_seconds", total).withColumn("throughput_kbps", F.when(F.col("total_seconds") > 0, F.col("size_bytes") / 1024 / F.col("total_seconds")))
    if simple:
        return out.select("file_id", LINE, F.col("name").alias("file_name"), "size_bytes", "total_seconds", "throughput_kbps")
    compress = F.coalesce(seconds(F.col("compressed"), F.col("started")), F.col("total_seconds") * 0.1)
    return out.withColumn("compress_seconds", compress).select("file_id", LINE, F.col("name").alias("file_name"), "size_bytes", "compress_seconds", (F.col("total_seconds") - F.col("compress_seconds")).alias("upload_seconds"), "total_seconds", "throughput_kbps")


def upload_tables(lines: DataFrame, split: str | None = None) -> DataFrame:
    """Each upload of a file (E10) with the tables that bulk maps named between the upload before it, of any file, and its own compress start (or, without one, itself).

    Tables are gathered by the number of uploads before them, so that sets are made by groups, not along the lines."""
    at = R.parse_file_ops(lines, *_with(split)).select("file_id", LINE, *_with(split), "kind", F.col("csv_name").alias("name"), F.lit(None).cast("string").alias("table_name"))
    maps = R.parse_bulk_map(lines, *_with(split)).select("file_id", LINE, *_with(split), F.lit("map").alias("kind"), F.lit(None).cast("string").alias("name"), "table_name")
    own = at.filter("kind in ('start', 'uploaded')").unionByName(maps.filter("table_name is not null"))
    # over splits these rows are gone through several times: they are written, so that lines are parsed once
    own = own if split is None else written(own)
    counted = islands(own, FILE, LINE, F.col("kind") == "uploaded", "uploads", closed=True, split=split)
    # a file's first compress start since its own upload before; later ones are passed over
    named = counted.filter("kind <> 'map'")
    marked = islands(named, ["file_id", "name"], LINE, F.col("kind") == "uploaded", closed=True, split=split)
    at_kind = lambda kind, c: F.min_by(c, F.when(F.col("kind") == kind, F.col(LINE)))
    files = marked.groupBy("file_id", "name", "island").agg(at_kind("uploaded", LINE).alias(LINE), F.coalesce(at_kind("start", LINE), at_kind("uploaded", LINE)).alias("from_line"), F.coalesce(at_kind("start", "uploads"), at_kind("uploaded", "uploads")).alias("uploads")).filter(f"{LINE} is not null")
    seen = counted.filter("kind = 'map'").groupBy("file_id", "uploads", "table_name").agg(F.min(LINE).alias("map_line"))
    joined = files.join(seen, ["file_id", "uploads"], "left")
    tables = F.collect_set(F.when(F.col("map_line") < F.col("from_line"), F.col("table_name")))
    out = joined.groupBy("file_id", F.col(LINE), F.col("name").alias("file_name")).agg(F.array_sort(tables).alias("tables"))
    return out.withColumn("table_count", F.size("tables"))


def one_by_one_intervals(lines: DataFrame, strict_end: bool = False, split: str | None = None) -> DataFrame:
    """From a switch to one-by-one to the switch back: table, times and failed executions between. With strict_end the closing line must name both modes."""
    low = F.lower(F.col("body"))
    starts, back = R.matches("body", P.ONE_BY_ONE), low.contains("back to bulk")
    if strict_end:
        back = back & low.contains("one-by-one")
    fails = low.contains("failed to execute")
    own = lines.filter(starts | back | fails).select("file_id", LINE, *_with(split), "timestamp", starts.alias("starts"), back.alias("back"), fails.alias("fails"), F.coalesce(R.table_name(), R.found("body", P.ONE_BY_ONE)).alias("table_name"))
    marked = islands(own, FILE, LINE, F.col("starts"), split=split).filter("island > 0")
    end = F.min(F.when(F.col("back"), F.col(LINE))).over(W.partitionBy("file_id", "island"))
    inside = marked.withColumn("end_line", end).filter("end_line is not null").filter(F.col(LINE) <= F.col("end_line"))
    return inside.groupBy("file_id", "island").agg(F.min_by("table_name", LINE).alias("table_name"), F.min(LINE).alias("start_line"), F.max("end_line").alias("end_line"), F.min_by("timestamp", LINE).alias("start_timestamp"), F.max_by("timestamp", LINE).alias("end_timestamp"), F.count_if("fails").alias("failed")).drop("island")


def bulk_map_gaps(lines: DataFrame) -> DataFrame:
    """Each bulk_map with the next finished apply of its table: the line, and the seconds until then. Operations that are merges have none."""
    maps = R.parse_bulk_map(lines).select("file_id", LINE, "timestamp", F.upper("table_name").alias("key"), "table_name", "op", "rows", F.lit(False).alias("finish"))
    ends = R.parse_apply(lines).filter("kind = 'finish'").select("file_id", LINE, "timestamp", F.upper("table_name").alias("key"), F.lit(True).alias("finish"))
    both = maps.unionByName(ends, True)
    keys = ["file_id", "key"]
    out = both.withColumns({"finish_line": next_value(F.col(LINE), F.col("finish"), keys, LINE), "finish_at": next_value(F.col("timestamp"), F.col("finish"), keys, LINE)}).filter("not finish")
    known = F.col("op") != "MERGE"
    return out.select("file_id", LINE, "table_name", "op", "rows", F.when(known, F.col("finish_line")).alias("finish_line"), F.when(known, seconds(F.col("finish_at"), F.col("timestamp"))).alias("gap_seconds"))


def apply_context(lines: DataFrame, before: int = 5) -> DataFrame:
    """Each run-statement with table and verb of the first start-applying among the lines before it."""
    own = R.parse_apply(lines).withColumn("near", F.when(F.col("kind") == "start", F.struct("table_name", "op")))
    w = W.partitionBy("file_id").orderBy(LINE).rangeBetween(-before, -1)
    return own.withColumn("context", F.first("near", ignorenulls=True).over(w)).filter("kind = 'run'").select("file_id", LINE, "op", "from_seq", "to_seq", (F.col("to_seq") - F.col("from_seq") + 1).alias("rows"), F.col("context.table_name").alias("table_name"), F.col("context.op").alias("context_op"))


def statement_target(lines: DataFrame) -> DataFrame:
    """Verb and table from the SQL text on the line after a run-statement."""
    w = ordered(FILE, [LINE])
    following = lines.withColumn("sql", F.lead("body").over(w)).filter((F.col("component") == "TARGET_APPLY") & R.matches("body", P.RUN_STATEMENT))
    return following.select("file_id", LINE, F.upper(R.found("sql", r"(?i)\b(INSERT|UPDATE|DELETE|MERGE)\b")).alias("verb"), R.found("sql", r"(?i)(?:INTO|UPDATE|FROM)\s+([\[\]\w.\"`]+)").alias("target"))


def time_gaps(lines: DataFrame, split: str | None = None) -> DataFrame:
    """Seconds since the timed line before, with a class at 1 and 10 seconds."""
    timed = lines.filter("timestamp is not null").select("file_id", LINE, *_with(split), "timestamp")
    out = lagged(timed, FILE, LINE, {"_t": F.col("timestamp")}, split)
    out = out.select("file_id", LINE, "timestamp", seconds(F.col("timestamp"), F.col("_t")).alias("gap_seconds"))
    return out.withColumn("gap_class", F.when(F.col("gap_seconds") >= 10, "large").when(F.col("gap_seconds") >= 1, "medium").when(F.col("gap_seconds").isNotNull(), "small"))


def thread_activity(lines: DataFrame, component: str, thread: str | None = None) -> DataFrame:
    """The lines of a component's thread with the gap to the match directly before."""
    own = lines.filter(F.col("component") == component)
    own = own if thread is None else own.filter(F.col("thread_id") == thread)
    gap = seconds(F.col("timestamp"), F.lag("timestamp").over(ordered(["file_id", "thread_id"], [LINE])))
    return own.select("file_id", LINE, "thread_id", "timestamp", gap.alias("gap_seconds")).withColumn("gap_class", F.when(F.col("gap_seconds") >= 5, "large").when(F.col("gap_seconds") >= 0.5, "medium"))


def collapse_noise(lines: DataFrame, min_run: int = 3, split: str | None = None) -> DataFrame:
    """Runs of lines with the same message: the first and the last stay, with the number hidden between them. Runs are counted before their lines are looked at, so that one of any length is never in one task."""
    keyed = runs(lines.select("file_id", LINE, *_with(split), R.message_key().alias("message_key")), FILE, LINE, F.col("message_key"), split=split)
    sized = keyed.groupBy("file_id", "run").agg(F.count("*").alias("n"), F.min(LINE).alias("first"), F.max(LINE).alias("last"), F.first("message_key").alias("message_key"))
    ends = sized.select("file_id", F.explode(F.array_distinct(F.array("first", "last"))).alias(LINE), "message_key", F.col("first"), "n")
    hidden = F.when((F.col("n") >= min_run) & (F.col(LINE) == F.col("first")), F.col("n") - 2).otherwise(0).cast("long")
    ends = ends.select("file_id", LINE, "message_key", hidden.alias("hidden"))
    if min_run <= 3:
        return ends
    short = sized.filter((F.col("n") > 2) & (F.col("n") < min_run)).select("file_id", "run", "first", "last")
    between = keyed.join(short, ["file_id", "run"]).filter((F.col(LINE) > F.col("first")) & (F.col(LINE) < F.col("last")))
    return ends.unionByName(between.select("file_id", LINE, "message_key", F.lit(0).cast("long").alias("hidden")))


def connection_events(lines: DataFrame) -> DataFrame:
    """Reconnects and disconnects, with the side that reports them."""
    low = F.lower(F.col("body"))
    kind = F.when(low.contains("reconnect"), "reconnect").when(low.contains("disconnect"), "disconnect")
    side = F.when(F.col("component").startswith("SOURCE") | low.contains("source"), "source").when(F.col("component").startswith("TARGET") | low.contains("target"), "target")
    return lines.select("file_id", LINE, "timestamp", kind.alias("kind"), side.alias("side")).filter("kind is not null")


def key_events(lines: DataFrame) -> DataFrame:
    """Milestones of a task."""
    low = F.lower(F.col("body"))
    rules = {"full_load_completed": low.rlike(r"full\s+load\s+completed"), "cdc_started": low.contains("start processing changes") | low.contains("cdc started"), "consistency": low.contains("transaction consistency reached"), "init_completed": low.contains("initialization completed"), "stop_reason": low.contains("stop reason"), "stopped": low.contains("task stopped") | low.contains("closing log file")}
    return lines.select("file_id", LINE, "timestamp", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("event"))


def apply_records(lines: DataFrame) -> DataFrame:
    """Each run-statement: its duration until the component's next line, and the gap since the statement before ended."""
    own = lines.filter(F.col("component") == "TARGET_APPLY").withColumn("_end", F.lead("timestamp").over(ordered(FILE, [LINE]))).filter(R.matches("body", P.RUN_STATEMENT))
    a, b = R.found("body", P.RUN_STATEMENT, 2).cast("long"), R.found("body", P.RUN_STATEMENT, 3).cast("long")
    gap = seconds(F.col("timestamp"), F.lag("_end").over(ordered(FILE, [LINE])))
    return own.select("file_id", LINE, F.col("timestamp").alias("start"), seconds(F.col("_end"), F.col("timestamp")).alias("duration_seconds"), gap.alias("gap_seconds"), F.upper(R.found("body", P.RUN_STATEMENT)).alias("verb"), a.alias("from_seq"), b.alias("to_seq"), (b - a + 1).alias("rows"), R.table_name().alias("table_name"))


def split_events(lines: DataFrame, events: DataFrame, name: str = "event") -> DataFrame:
    """lines with the last event at or before them, by file."""
    return asof_backward(lines, events.select("file_id", F.col(LINE).alias("event_line"), name), FILE, LINE, "event_line", [name])


def one_by_one_script(lines: DataFrame) -> DataFrame:
    """One-by-one stretches by table in the script's dialect: how many, their events (by the last range before), failed executions, total and longest time."""
    spans = one_by_one_intervals(lines)
    ranges = lines.filter(R.matches("body", P.RUN_STATEMENT)).select("file_id", LINE, (R.found("body", P.RUN_STATEMENT, 3).cast("long") - R.found("body", P.RUN_STATEMENT, 2).cast("long") + 1).alias("events"))
    sized = asof_backward(spans, ranges.withColumnRenamed(LINE, "range_line"), FILE, "start_line", "range_line", ["events"])
    d = seconds(F.col("end_timestamp"), F.col("start_timestamp"))
    return sized.groupBy("file_id", "table_name").agg(F.count("*").alias("switches"), F.sum("events").alias("events"), F.sum("failed").alias("failed"), F.sum(d).alias("total_seconds"), F.max(d).alias("max_seconds"))
