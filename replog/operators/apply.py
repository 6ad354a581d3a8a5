"""Batches, tables, uploads and reads summed up (A6 to A28), and the rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replog.functions import patterns as P
from replog.operators import events as E
from replog.operators import parse as R
from replog.plans.scale import floor_percentile, topk_per_group

FILE, LINE = ["file_id"], "line_number"


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def batch_closure_counts(b: DataFrame) -> DataFrame:
    """Batches by reason, with their percentage of the file's."""
    n = b.groupBy("file_id", "closure_reason").agg(F.count("*").alias("batches"))
    return n.withColumn("percent", percent(F.col("batches"), F.sum("batches").over(W.partitionBy("file_id"))))


def batch_size_stats(b: DataFrame) -> DataFrame:
    """Sizes of batches with changes, and how many hold a single record."""
    c = F.col("changes_count")
    return b.filter(c > 0).groupBy("file_id").agg(F.count("*").alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), F.median(c).alias("median"), F.sum(c).alias("total"), F.count_if(c == 1).alias("single_record"), percent(F.count_if(c == 1), F.count("*")).alias("single_percent"))


def batch_duration_stats(b: DataFrame) -> DataFrame:
    """Durations of batches that took time."""
    own = b.filter("duration_seconds > 0")
    d = F.col("duration_seconds")
    sums = own.groupBy("file_id").agg(F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("avg"), F.median(d).alias("median"))
    return sums.join(floor_percentile(own, FILE, "duration_seconds", (0.95,), ("p95",)), "file_id")


def rps_distribution(b: DataFrame) -> DataFrame:
    """Batches by changes a second, in five classes, closed below; those without time or changes are unknown."""
    rps = F.when((F.col("duration_seconds") > 0) & (F.col("changes_count") > 0), F.col("changes_count") / F.col("duration_seconds"))
    bucket = F.when(F.col("rps").isNull(), "unknown").when(F.col("rps") < 10, "<10").when(F.col("rps") < 100, "10-100").when(F.col("rps") < 1000, "100-1k").when(F.col("rps") < 10000, "1k-10k").otherwise(">=10k")
    return b.withColumn("rps", rps).withColumn("bucket", bucket).groupBy("file_id", "bucket").agg(F.count("*").alias("batches"), F.avg("changes_count").alias("avg_changes"), F.median("rps").alias("median_rps"))


def pain_tables(t: DataFrame, k: int = 10) -> DataFrame:
    """The k tables of each file that cost most: apply time, ten for an error, five for a one-by-one switch."""
    score = F.coalesce("total_apply_time_seconds", F.lit(0.0)) + 10 * F.coalesce("error_count", F.lit(0)) + 5 * F.coalesce("one_by_one_count", F.lit(0))
    return topk_per_group(t.withColumn("pain_score", score), FILE, [F.desc("pain_score"), "table_name"], k, "rank").select("file_id", "rank", "table_name", "pain_score", "total_apply_time_seconds", "one_by_one_count")


def apply_methods(events: DataFrame) -> DataFrame:
    """Operations by table and apply method."""
    return events.groupBy("file_id", "table_name", "apply_method").agg(F.sum("operation_count").alias("operations"))


def merge_breakdown(t: DataFrame) -> DataFrame:
    """Merges against other operations, for each table and over the file (a null table)."""
    plain = F.col("total_inserts") + F.col("total_updates") + F.col("total_deletes")
    rows = t.select("file_id", "table_name", F.col("total_merges").alias("merges"), plain.alias("standard"))
    total = rows.groupBy("file_id").agg(F.lit(None).cast("string").alias("table_name"), F.sum("merges").alias("merges"), F.sum("standard").alias("standard"))
    return rows.unionByName(total).withColumn("merge_percent", percent(F.col("merges"), F.col("merges") + F.col("standard")))


def pipeline_health(events: DataFrame) -> DataFrame:
    """Counts of pipeline events and a verdict."""
    n = lambda k: F.count_if(F.col("event_type") == k)
    out = events.groupBy("file_id").agg(n("memory_warning").alias("memory_warnings"), n("overflow").alias("overflows"), n("target_disconnect").alias("disconnects"), n("source_reconnect").alias("reconnects"))
    status = F.when((F.col("overflows") > 0) | (F.col("disconnects") > 5), "critical").when((F.col("memory_warnings") > 3) | (F.col("disconnects") > 0), "warning").otherwise("healthy")
    return out.withColumn("status", status)


def source_health(errors: DataFrame, events: DataFrame) -> DataFrame:
    """Errors on the source's side by kind, and its reconnects."""
    low = F.lower("text")
    has = lambda *words: F.count_if(low.rlike("|".join(words)))
    own = errors.filter(F.col("component").startswith("SOURCE")).groupBy("file_id").agg(F.count("*").alias("errors"), has("network", "socket", "connection", "timeout").alias("network"), has("lock", "busy", "blocked", "contention").alias("contention"), has("memory", "resource", "limit").alias("resource"))
    again = events.filter("event_type = 'source_reconnect'").groupBy("file_id").agg(F.count("*").alias("reconnects"))
    out = own.join(again, "file_id", "full_outer").fillna(0)
    hints = F.array_compact(F.array(F.when(F.col("network") > 0, F.lit("network")), F.when(F.col("contention") > 0, F.lit("contention")), F.when(F.col("resource") > 0, F.lit("resource")), F.when(F.col("reconnects") > 3, F.lit("reconnects"))))
    return out.withColumn("hints", hints).withColumn("status", F.when((F.col("errors") > 10) | (F.col("reconnects") > 5), "critical").when((F.col("errors") > 0) | (F.col("reconnects") > 0), "warning").otherwise("healthy"))


def redo_read_variance(reads: DataFrame, k: int = 15) -> DataFrame:
    """Equal reads (bytes, thread, place) that took very different times, the widest first."""
    g = reads.filter("read_ms > 200").groupBy("file_id", "bytes_read", "thread_id", "source_location").agg(F.count("*").alias("reads"), F.min("read_ms").alias("min_ms"), F.max("read_ms").alias("max_ms"), F.avg("read_ms").alias("avg_ms"))
    wide = g.filter("reads >= 2 and max_ms / min_ms >= 2").withColumn("ratio", F.col("max_ms") / F.col("min_ms"))
    return topk_per_group(wide, FILE, [F.desc("ratio"), F.desc("reads"), "bytes_read", "thread_id"], k)


def redo_session_stats(s: DataFrame) -> DataFrame:
    """Durations of redo sessions."""
    d = F.col("duration_seconds")
    sums = s.groupBy("file_id").agg(F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("avg"))
    return sums.join(floor_percentile(s, FILE, "duration_seconds", (0.95,), ("p95",)), "file_id")


def longest_redo_sessions(s: DataFrame, k: int = 5) -> DataFrame:
    return topk_per_group(s, FILE, [F.desc("duration_seconds"), "line_open"], k, "rank").withColumn("path_tail", F.regexp_extract("redo_path", r"([^/\\]+)$", 1))


def file_ops_summary(f: DataFrame) -> DataFrame:
    """Uploads of a file; blank values do not count."""
    v = lambda c: F.nullif(F.col(c), F.lit(0))
    return f.groupBy("file_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total_bytes"), F.avg(v("size_bytes")).alias("avg_bytes"), F.avg(v("total_seconds")).alias("avg_seconds"), F.avg(v("throughput_kbps")).alias("avg_kbps"))


def file_ops_stats(f: DataFrame) -> DataFrame:
    """Extremes of size and time where a file has two uploads at least."""
    out = f.groupBy("file_id").agg(F.count("*").alias("files"), *[g(c).alias(f"{n}_{c}") for c in ("size_bytes", "total_seconds") for n, g in (("min", F.min), ("max", F.max), ("avg", F.avg), ("sum", F.sum))])
    return out.filter("files >= 2")


def bulk_map_stats(m: DataFrame) -> DataFrame:
    """Operations, single records, rows and gaps by table, and over the file (a null table)."""
    aggs = [F.count("*").alias("operations"), percent(F.count_if(F.col("rows") == 1), F.count("*")).alias("single_percent"), F.avg("rows").alias("avg_rows"), F.max("rows").alias("max_rows"), F.avg("gap_seconds").alias("avg_gap")]
    return m.groupBy("file_id", "table_name").agg(*aggs).unionByName(m.groupBy("file_id").agg(*aggs), True)


def per_table_changes(lines: DataFrame) -> DataFrame:
    """Changes by table and verb, from statements with their context."""
    c = E.apply_context(lines).filter("table_name is not null")
    total = lambda v: F.coalesce(F.sum(F.when(F.col("context_op") == v, F.col("rows"))), F.lit(0)).alias(v.lower())
    return c.groupBy("file_id", "table_name").agg(*[total(v) for v in ("INSERT", "UPDATE", "DELETE", "MERGE")], F.sum("rows").alias("total"))


def script_table_totals(lines: DataFrame, high: int = 40) -> DataFrame:
    """Rows by verb and times of each table, and when statements of many rows ran."""
    a = E.apply_records(lines)
    return a.groupBy("file_id", "table_name").agg(*[F.coalesce(F.sum(F.when(F.col("verb") == v, F.col("rows"))), F.lit(0)).alias(v.lower()) for v in ("INSERT", "UPDATE", "DELETE")], F.sum("duration_seconds").alias("seconds"), F.try_divide(F.sum("duration_seconds"), F.sum("rows")).alias("seconds_a_row"), F.min(F.when(F.col("rows") >= high, F.col("start"))).alias("first_high"), F.max(F.when(F.col("rows") >= high, F.col("start"))).alias("last_high"))


def script_summary(lines: DataFrame) -> DataFrame:
    """Batches of the third dialect summed up."""
    b = E.script_batches(lines)
    return b.groupBy("file_id").agg(F.count("*").alias("batches"), F.max("changes_count").alias("largest"), F.max("duration_seconds").alias("longest"), F.count_if(F.col("changes_count") == 1).alias("singles"), F.sum("changes_count").alias("changes"), F.try_divide(F.sum("changes_count"), F.sum("duration_seconds")).alias("changes_a_second"), F.max_by(LINE, F.struct("changes_count", -F.col(LINE))).alias("largest_line"))


def no_bulk_no_pk(lines: DataFrame) -> DataFrame:
    """Tables applied without bulk or key, counted by their number, with the name that lines give it last."""
    own = lines.filter(R.matches("body", P.NO_PK)).select("file_id", R.found("body", r"(?i)table\s+(?:id\s*)?#?(\d+)").cast("long").alias("table_id")).filter("table_id is not null")
    names = lines.filter(R.matches("body", r"(?i)Id\s*=\s*\d+") & R.matches("body", P.TABLE)).select("file_id", LINE, R.found("body", r"(?i)Id\s*=\s*(\d+)").cast("long").alias("table_id"), R.table_name().alias("table_name"))
    return own.groupBy("file_id", "table_id").agg(F.count("*").alias("n")).join(names.groupBy("file_id", "table_id").agg(F.max_by("table_name", LINE).alias("table_name")), ["file_id", "table_id"], "left")


def tables_seen(lines: DataFrame) -> DataFrame:
    """Distinct tables named by apply lines or a capture list."""
    listed = F.regexp_extract_all("body", F.lit(r"TABLE_NAME='([^']+)'"), F.lit(1))
    applied = F.when((F.col("component") == "TARGET_APPLY") & R.matches("body", P.TABLE), F.array(R.table_name())).otherwise(F.array().cast("array<string>"))
    return lines.select("file_id", F.explode(F.concat(listed, applied)).alias("table_name")).filter("table_name is not null").distinct()


def distinct_values(lines: DataFrame, pattern: str) -> DataFrame:
    """Distinct values of a pattern's group, such as drivers, versions, licences or level changes."""
    return lines.select("file_id", F.explode(F.regexp_extract_all("body", F.lit(pattern), F.lit(1))).alias("value")).distinct()


def recommend(df: DataFrame, rules: list[tuple[Column, int, str, Column | str]]) -> DataFrame:
    """A row (file_id, priority, area, title) for each rule whose condition a file's row meets."""
    made = [F.when(c, F.struct(F.lit(p).alias("priority"), F.lit(a).alias("area"), (F.lit(t) if isinstance(t, str) else t).alias("title"))) for c, p, a, t in rules]
    return df.select("file_id", F.explode(F.array_compact(F.array(*made))).alias("r")).select("file_id", "r.priority", "r.area", "r.title")


def batch_inefficiencies(b: DataFrame) -> DataFrame:
    """Warnings about batches: single records, key conflicts, timeouts."""
    reason = F.col("closure_reason")
    n = F.count("*")
    s = b.groupBy("file_id").agg(percent(F.count_if(F.col("changes_count") == 1), n).alias("single"), percent(F.count_if(reason.isin("PKi", "PKu", "PKd")), n).alias("pk"), percent(F.count_if(reason.isin("TIM", "TMO")), n).alias("timeouts"))
    return recommend(s, [(F.col("single") > 40, 1, "batches", "single-record batches prevail"), (F.col("single").between(20.000001, 40), 2, "batches", "many single-record batches"), (F.col("pk") > 10, 1, "batches", "key conflicts close batches"), (F.col("timeouts") > 30, 2, "batches", "timeouts close batches")])


def recommendations(cockpit: DataFrame) -> DataFrame:
    """Advice by priority from a file's row of the cockpit."""
    c = F.col
    return recommend(cockpit, [
        (c("bottleneck") == "source", 1, "latency", "the source is the bottleneck"), (c("bottleneck") == "handling", 1, "latency", "handling is the bottleneck"), (c("spikes") > 5, 2, "latency", F.concat(c("spikes"), F.lit(" latency spikes"))),
        (c("one_by_one") > 10, 1, "apply", "many switches to one-by-one"), (c("pipeline_status") == "critical", 1, "pipeline", "the pipeline is in a critical state"), (c("pipeline_status") == "warning", 2, "pipeline", "the pipeline shows warnings"),
        (c("source_status") == "critical", 1, "source", "the source is in a critical state"), (c("errors") > 100, 1, "errors", F.concat(c("errors"), F.lit(" errors"))),
    ])


def bulk_map_insights(m: DataFrame) -> DataFrame:
    """Warnings about bulk maps: single records, small ones, uneven ones."""
    s = m.groupBy("file_id").agg(percent(F.count_if(F.col("rows") == 1), F.count("*")).alias("single"), F.avg("rows").alias("avg"), F.stddev_pop("rows").alias("dev"))
    return recommend(s, [(F.col("single") > 20, 1, "bulk", "single-record operations"), (F.col("avg") < 10, 2, "bulk", "small operations"), (F.col("dev") > F.col("avg"), 3, "bulk", "uneven operations")])


def file_ops_insights(f: DataFrame) -> DataFrame:
    """Warnings about uploads: a fixed cost, many small files, a share of time that size does not explain, and uploads far below the mean rate."""
    own = f.filter("total_seconds > 0 and size_bytes > 0")
    rate, size, took = F.col("throughput_kbps"), F.col("size_bytes"), F.col("total_seconds")
    s = own.groupBy("file_id").agg(F.count("*").alias("n"), (F.max(size) / F.min(size)).alias("sizes"), (F.max(took) / F.min(took)).alias("times"), percent(F.count_if(size < 10240), F.count("*")).alias("small"), F.min(took).alias("least"), F.avg(rate).alias("mean"), F.stddev_pop(rate).alias("dev"))
    # one row a file meets its uploads again: what their rates are without the least time, and how many are slow
    beyond = took - F.col("least")
    again = own.join(s.select("file_id", "least", "mean", "dev"), "file_id").groupBy("file_id").agg(F.avg(F.when(beyond > 0.1, size / 1024 / beyond)).alias("net"), F.count_if((rate < F.col("mean") - F.col("dev")) & (size > 50 * 1024)).alias("slow"))
    j = s.join(again, "file_id")
    return recommend(j, [
        ((F.col("sizes") > 10) & (F.col("times") < 2), 1, "files", "a fixed cost prevails over size"), (F.col("small") > 30, 2, "files", "many small files"),
        ((F.col("n") >= 3) & (F.col("sizes") > 5) & (F.col("net") > 1.5 * F.col("mean")), 3, "files", "a fixed overhead for each upload"), ((F.col("n") >= 3) & (F.col("slow") > 0), 2, "files", "uploads far below the mean rate"),
    ])


def tuning_modes(files: DataFrame, col: str = "text") -> DataFrame:
    """Whether a file's text calls for timeout or batch tuning."""
    return files.withColumns({"timeout_tuning": F.col(col).rlike(r"(?i)timeout"), "batch_tuning": F.col(col).rlike(r"(?i)bulk|batch")})


def cockpit(lines: DataFrame, split: str | None = None) -> DataFrame:
    """One row a file: latency, bottleneck, spikes, batches, errors, pipeline and source."""
    from replog.operators import latency as L

    perf, errors, events = R.parse_latency(lines), R.error_lines(lines), R.pipeline_events(lines)
    parts = [
        L.bottleneck(perf).select("file_id", "bottleneck", "source_share"), L.spikes(perf).groupBy("file_id").agg(F.count("*").alias("spikes")), E.batches(lines, split).groupBy("file_id").agg(F.count("*").alias("batches"), F.sum("changes_count").alias("changes")),
        E.table_stats(lines, split).groupBy("file_id").agg(F.sum("one_by_one_count").alias("one_by_one"), F.count("*").alias("tables")), errors.groupBy("file_id").agg(F.count("*").alias("errors")),
        pipeline_health(events).select("file_id", F.col("status").alias("pipeline_status")), source_health(errors, events).select("file_id", F.col("status").alias("source_status")),
    ]
    out = lines.groupBy("file_id").agg(F.count("*").alias("lines"))
    for p in parts:
        out = out.join(p, "file_id", "left")
    return out.fillna(0, ["spikes", "batches", "changes", "one_by_one", "tables", "errors"])


def top_contributors(cockpit: DataFrame, batches: DataFrame, uploads: DataFrame, pain: DataFrame) -> DataFrame:
    """What contributes most to a file's latency: its bottleneck, slow uploads, key conflicts, painful tables."""
    pk = batches.groupBy("file_id").agg(percent(F.count_if(F.col("closure_reason").isin("PKi", "PKu", "PKd")), F.count("*")).alias("pk"))
    up = uploads.groupBy("file_id").agg(F.avg("total_seconds").alias("upload"))
    worst = pain.groupBy("file_id").agg(F.max("pain_score").alias("pain"), F.max_by("table_name", "pain_score").alias("worst_table"))
    j = cockpit.select("file_id", "bottleneck").join(pk, "file_id", "left").join(up, "file_id", "left").join(worst, "file_id", "left")
    return recommend(j, [(F.col("bottleneck").isin("source", "handling"), 1, "latency", F.concat(F.lit("bottleneck: "), F.col("bottleneck"))), (F.col("upload") > 1, 2, "files", "slow uploads"), (F.col("pk") > 10, 2, "batches", "key conflicts"), (F.col("pain") > 100, 1, "tables", F.concat(F.lit("painful table: "), F.col("worst_table")))])


def bulk_apply_insights(batches: DataFrame, stats: DataFrame) -> DataFrame:
    """Warnings about bulk apply: time that does not grow with size, small batches, memory, timeouts, key conflicts, tables applied one by one."""
    n, reason = F.count("*"), F.col("closure_reason")
    s = batches.groupBy("file_id").agg(F.avg("changes_count").alias("avg"), F.corr("changes_count", "duration_seconds").alias("grows"), percent(F.count_if(reason == "MEM"), n).alias("memory"), percent(F.count_if(reason.isin("TIM", "TMO")), n).alias("timeouts"), percent(F.count_if(reason.isin("PKi", "PKu", "PKd")), n).alias("pk"))
    single = recommend(stats.groupBy("file_id").agg(F.sum("one_by_one_count").alias("n")), [(F.col("n") > 0, 1, "bulk", "tables are applied one by one")])
    return single.unionByName(recommend(s, [(F.abs("grows") < 0.2, 2, "bulk", "latency dominates over size"), (F.col("avg") < 100, 2, "bulk", "small batches"), (F.col("memory") > 10, 1, "bulk", "memory closes batches"), (F.col("timeouts") > 20, 2, "bulk", "timeouts close batches"), (F.col("pk") > 0, 1, "bulk", "key conflicts close batches")]))


def summary_facts(profile: DataFrame, batches: DataFrame, errors: DataFrame) -> DataFrame:
    """Compact facts of a file: median latencies with the target's delta to the source and its percentage, batches, changes, errors."""
    mid = profile.groupBy("file_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("p50"))).alias(k) for k in ("source", "target", "handling")])
    delta = F.col("target") - F.col("source")
    b = batches.groupBy("file_id").agg(F.count("*").alias("batches"), F.sum("changes_count").alias("changes"))
    e = errors.groupBy("file_id").agg(F.count("*").alias("errors"))
    out = mid.join(b, "file_id", "left").join(e, "file_id", "left").fillna(0, ["batches", "changes", "errors"])
    return out.withColumns({"delta": delta, "delta_percent": F.when(F.col("source") > 0, 100 * delta / F.col("source"))})
