"""What a report on a log joins beyond its overview (A29, A38), the advice that follows from it (R1), and which parts of reports speak of an issue."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replog.operators import apply as A
from replog.operators import events as E
from replog.operators import issues as I
from replog.operators import latency as L
from replog.operators import parse as R
from replog.plans.scale import topk_per_group

FILE, LINE = ["file_id"], "line_number"
#: Words of a summary that say nothing about what an issue is.
COMMON_WORDS = ("error", "warning", "failed", "could", "cannot", "unable", "with", "from", "that", "this", "when")


def _first(df: DataFrame, order: list[Column | str], **names: str) -> DataFrame:
    """Each file's first row in an order, under new names."""
    return topk_per_group(df, FILE, order, 1).select("file_id", *[F.col(old).alias(new) for new, old in names.items()])


def cockpit_details(lines: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """One row a file: latency profile, bottleneck periods, closures, sizes, durations and rates of batches, the most painful table, redo sessions
    and uneven reads, errors under high latency, the component with most errors, the share of merges; uploads, if given, summed up.

    lines are read once for each part; give a written table."""
    perf, errors, batches, stats = R.parse_latency(lines), R.error_lines(lines), E.batches(lines), E.table_stats(lines)
    profile, periods, sessions = L.latency_profile(perf), L.bottleneck_periods(perf), E.redo_sessions(lines)
    said = lambda side: F.count_if(F.col("bottleneck") == side)
    parts = [
        profile.groupBy("file_id").agg(*[F.max(F.when(F.col("kind") == k, F.col(p))).alias(f"{k}_{p}") for k in L.KINDS for p in ("p50", "p95")]),
        periods.groupBy("file_id").agg(F.count("*").alias("periods"), said("source").alias("source_periods"), said("handling").alias("handling_periods")),
        _first(A.batch_closure_counts(batches), [F.desc("batches"), "closure_reason"], main_reason="closure_reason", main_reason_percent="percent"),
        A.batch_size_stats(batches).select("file_id", F.col("avg").alias("avg_changes"), F.col("median").alias("median_changes"), F.col("max").alias("max_changes"), "single_percent"),
        A.batch_duration_stats(batches).select("file_id", F.col("avg").alias("avg_seconds"), F.col("p95").alias("p95_seconds")),
        _first(A.rps_distribution(batches), [F.desc("batches"), "bucket"], main_rate="bucket"),
        _first(A.pain_tables(stats, 1), ["rank"], worst_table="table_name", worst_score="pain_score", worst_one_by_one="one_by_one_count"),
        A.merge_breakdown(stats).filter("table_name is null").select("file_id", "merge_percent"),
        sessions.groupBy("file_id").agg(F.count("*").alias("redo_sessions"), F.max("duration_seconds").alias("longest_redo_seconds")),
        A.redo_read_variance(R.parse_redo_read(lines)).groupBy("file_id").agg(F.count("*").alias("uneven_reads")),
        L.errors_in_high_latency(errors, perf).groupBy("file_id").agg(F.count("*").alias("errors_in_high_latency")),
        _first(I.errors_by_component(errors), [F.desc("errors"), "component"], main_error_component="component"),
    ]
    if uploads is not None:
        parts.append(A.file_ops_summary(uploads))
    out = lines.select("file_id").distinct()
    for part in parts:
        out = out.join(part, "file_id", "left")
    return out.fillna(0, ["periods", "source_periods", "handling_periods", "redo_sessions", "uneven_reads", "errors_in_high_latency"])


def advice(details: DataFrame, inefficiencies: DataFrame, plateaus: DataFrame | None = None) -> DataFrame:
    """Advice that goes beyond the overview's: uneven redo reads, the most painful table, warnings about batches, and plateaus if given."""
    c = F.col
    out = A.recommend(details, [
        (c("uneven_reads") > 0, 2, "source", "equal redo reads take very different times"),
        (c("worst_one_by_one") > 10, 1, "tables", F.concat(F.lit("applied one by one: "), c("worst_table"))),
    ])
    out = out.unionByName(inefficiencies.filter("priority = 1").select("file_id", F.lit(2).alias("priority"), "area", "title"))
    if plateaus is not None:
        many = plateaus.groupBy("file_id").agg(F.count("*").alias("n"))
        out = out.unionByName(A.recommend(many, [(c("n") > 0, 2, "latency", F.concat(c("n"), F.lit(" plateaus of latency")))]))
    return out


def log_summary_details(lines: DataFrame, errors: int = 5, warnings: int = 3) -> DataFrame:
    """One row a file: its seconds, its first errors and warnings, how many tables, key events and connection events it names, and the tables applied one by one."""

    def first(severity: str, k: int, name: str) -> DataFrame:
        own = topk_per_group(lines.filter(F.col("severity") == severity), FILE, [LINE], k)
        return own.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(LINE, "body"))), lambda x: x["body"]).alias(name))

    counted = lambda df, name: df.groupBy("file_id").agg(F.count("*").alias(name))
    out = lines.groupBy("file_id").agg((F.unix_seconds(F.max("timestamp").cast("timestamp")) - F.unix_seconds(F.min("timestamp").cast("timestamp"))).cast("double").alias("seconds"))
    single = named_values(lines).filter("kind = 'one_by_one_table'").groupBy("file_id").agg(F.array_sort(F.collect_list("value")).alias("one_by_one_tables"))
    for part in (first("E", errors, "first_errors"), first("W", warnings, "first_warnings"), single, counted(A.tables_seen(lines), "tables"), counted(E.key_events(lines), "key_events"), counted(E.connection_events(lines), "connection_events")):
        out = out.join(part, "file_id", "left")
    return out.fillna(0, ["tables", "key_events", "connection_events"])


#: Kinds of values named in lines, what a line must hold, the pattern, and how its groups are put together.
NAMED_VALUES = {
    "odbc_driver": (("ODBC", "(?i)driver"), r"(?:driver|Driver)[:\s]+([^\n;,]{10,80})", "$1"),
    "one_by_one_table": (("(?i)one-by-one", "Applying"), r"for table '([^']+)'\.?'([^']+)'", "$1.$2"),
    "level_change": (("(?i)log level", "(?i)changed"), r"'(\w+)'.*changed from '(\w+)' to '(\w+)'", "$1: $2 > $3"),
    "license": (("Licensed to",), r"Licensed to\s+([^,]+),", "$1"),
    "version": (("(?i)version",), R.PROPERTIES["version"], "$1"),
}


def named_values(lines: DataFrame) -> DataFrame:
    """kind and value of every driver, table applied one by one, change of a log level, licence and version that a file's lines name, once each."""
    found = []
    for kind, (needs, pattern, form) in NAMED_VALUES.items():
        groups = {f"${k}": F.trim(F.regexp_extract("body", pattern, k)) for k in range(1, form.count("$") + 1)}
        value = F.concat(*[groups[x] if x in groups else F.lit(x) for x in re.split(r"(\$\d)", form) if x])
        hit = F.col("body").rlike(pattern)
        for need in needs:
            hit = hit & F.col("body").rlike(need)
        found.append(F.when(hit, F.struct(F.lit(kind).alias("kind"), value.alias("value"))))
    return lines.select("file_id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("file_id", "x.kind", "x.value").filter("value <> ''").distinct()


def search_terms(issue: Column, code: Column, component: Column, most: int = 5) -> Column:
    """What a report on an issue would say: its code, its component, and the first words of its summary that are not common ones."""
    words = F.filter(F.regexp_extract_all(F.lower(issue), F.lit(r"\b([a-z_]{4,})\b"), F.lit(1)), lambda w: ~w.isin(*COMMON_WORDS))
    named = F.array_compact(F.array(F.nullif(F.lower(code), F.lit("")), F.nullif(F.lower(component), F.lit(""))))
    return F.concat(named, F.coalesce(F.slice(words, 1, most), F.array().cast("array<string>")))


def match_report_sections(pairs: DataFrame, keys: list[str], most: int = 800) -> DataFrame:
    """The sections of a report that speak most of an issue, best first, within a number of characters (the first one always); the report's start if none does.

    pairs holds report, summary, error_code and component under its keys, one row for each issue to look up. Sections begin at headings or bold
    capitals; a report without any is split at blank lines. The excerpt ends with an ellipsis where it was cut; of an empty or null report it is null."""
    parts = F.split("report", r"\n(?=#{1,3}\s|\*\*[A-Z])")
    parts = F.when(F.size(parts) > 1, parts).otherwise(F.split("report", r"\n\n+"))
    own = pairs.select(*keys, "report", search_terms(F.col("summary"), F.col("error_code"), F.col("component")).alias("terms"), F.posexplode_outer(parts).alias("at", "section"))
    score = F.size(F.filter("terms", lambda t: F.lower("section").contains(t)))
    rated = own.withColumn("score", score).withColumn("section", F.trim(F.regexp_replace("section", r"^\s+|\s+$", "")))
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "at")
    total = F.sum(F.when(F.col("score") > 0, F.length("section"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    # the running length only grows, so all that come after the first that does not fit stay out
    taken = rated.withColumn("place", F.row_number().over(order)).withColumn("fits", (F.col("score") > 0) & ((F.col("place") == 1) | (total <= most)))
    best = taken.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("place", "section")))).alias("best"), F.max("score").alias("score"), F.first("report").alias("report"))
    text = F.when(F.size("best") > 0, F.array_join(F.transform("best", lambda x: x["section"]), "\n\n")).otherwise(F.trim("report"))
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(F.nullif(text, F.lit("")))
    return best.select(*keys, "score", cut.alias("excerpt"))


def latest_reports(reports: DataFrame, k: int = 5, preview: int = 200) -> DataFrame:
    """The k newest reports of each file, with how they begin; those without a time come last."""
    return topk_per_group(reports, FILE, [F.desc_nulls_last("generated_at"), F.desc("report_id")], k, "rank").select("file_id", "rank", "report_id", "generated_at", "model", F.substring(F.coalesce("text", F.lit("")), 1, preview).alias("preview"))
