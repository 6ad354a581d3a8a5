"""Latency series (A1 to A5, W1 to W3, W7, C1, C2). A file's samples are few (one in 30 seconds), so its windows are over the file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replog.plans.scale import asof_backward, floor_percentile, islands, ordered, range_join, topk_per_group

FILE, LINE = ["file_id"], "line_number"
KINDS = ("source", "target", "handling")


def latency_profile(perf: DataFrame) -> DataFrame:
    """Count, extremes, mean and the values at floor(n * share) of each latency."""
    long = perf.select("file_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_latency").alias("v")) for k in KINDS])).alias("x")).select("file_id", "x.kind", "x.v")
    points = floor_percentile(long, ["file_id", "kind"], "v", (0.5, 0.9, 0.95, 0.99), ("p50", "p90", "p95", "p99"))
    sums = long.groupBy("file_id", "kind").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("avg"))
    return sums.join(points, ["file_id", "kind"])


def latency_summary(perf: DataFrame) -> DataFrame:
    return perf.groupBy("file_id").agg(*[f(F.col(f"{k}_latency")).alias(f"{n}_{k}") for k in KINDS for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])


def _verdict(share):
    return F.when(share > 0.65, "source").when(share < 0.35, "handling").when(share.isNotNull(), "balanced").otherwise("unknown")


def bottleneck(perf: DataFrame) -> DataFrame:
    """Which side the latency comes from, by the source's share of source and handling."""
    out = perf.groupBy("file_id").agg(F.avg("source_latency").alias("avg_source"), F.avg("handling_latency").alias("avg_handling"))
    total = F.col("avg_source") + F.col("avg_handling")
    return out.withColumn("source_share", F.when(total > 0, F.col("avg_source") / total)).withColumn("bottleneck", _verdict(F.col("source_share")))


def bottleneck_periods(perf: DataFrame) -> DataFrame:
    """About ten periods of max(5, n // 10) samples, each with averages and a verdict."""
    w = ordered(FILE, ["timestamp", LINE])
    sized = perf.withColumns({"_k": F.row_number().over(w) - 1, "_n": F.count("*").over(W.partitionBy("file_id"))})
    period = F.floor(F.col("_k") / F.greatest(F.lit(5), F.floor(F.col("_n") / 10)))
    out = sized.groupBy("file_id", period.alias("period")).agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count("*").alias("samples"), F.avg("source_latency").alias("avg_source"), F.avg("target_latency").alias("avg_target"), F.avg("handling_latency").alias("avg_handling"))
    total = F.col("avg_source") + F.col("avg_handling")
    return out.withColumn("bottleneck", _verdict(F.when(total > 0, F.col("avg_source") / total)))


def bottleneck_local(perf: DataFrame) -> DataFrame:
    """The largest of the three averages."""
    out = perf.groupBy("file_id").agg(*[F.avg(f"{k}_latency").alias(k) for k in KINDS])
    top = F.greatest(*KINDS)
    return out.select("file_id", *KINDS, F.coalesce(*[F.when(F.col(k) == top, F.lit(k)) for k in KINDS]).alias("bottleneck"))


def spikes(perf: DataFrame, multiplier: float = 2.5) -> DataFrame:
    """Samples whose target latency is above multiplier times the mean of the five before, and the side whose latency grew more."""
    w = ordered(FILE, ["timestamp", LINE])
    last5 = w.rowsBetween(-5, -1)
    own = perf.withColumns({"_k": F.row_number().over(w), "baseline": F.avg("target_latency").over(last5), "_s": F.avg("source_latency").over(last5), "_h": F.avg("handling_latency").over(last5)})
    hits = own.filter((F.col("_k") > 5) & (F.col("baseline") > 0) & (F.col("target_latency") > multiplier * F.col("baseline")))
    driver = F.when(F.col("source_latency") - F.col("_s") > F.col("handling_latency") - F.col("_h"), "source").otherwise("handling")
    return hits.select("file_id", LINE, "timestamp", "target_latency", "baseline", (F.col("target_latency") / F.col("baseline")).alias("multiplier"), driver.alias("driver"))


PLATEAU = "file_id long, start_line long, end_line long, start timestamp_ntz, end timestamp_ntz, samples long, avg_latency double"


def plateaus(perf: DataFrame, window: int = 10, variation: float = 0.15) -> DataFrame:
    """High and steady stretches: a window whose mean is above 1.3 times the overall one and whose coefficient of variation is low, grown while it stays near; the search goes on after it.

    Windows that could start a stretch are found by native windows; files without one end there. In the others the search runs along a file's
    samples (one for every 30 seconds of a log), over running sums."""
    w = ordered(FILE, ["timestamp", LINE])
    ahead = w.rowsBetween(0, window - 1)
    mean, dev = F.avg("target_latency").over(ahead), F.stddev_samp("target_latency").over(ahead)
    overall = F.avg("target_latency").over(W.partitionBy("file_id"))
    own = perf.withColumn("_hit", (mean > 1.3 * overall) & (dev < variation * mean))
    some = own.groupBy("file_id").agg(F.max("_hit").alias("_any")).filter("_any").select("file_id")

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["timestamp", "line_number"], kind="stable")
        found = stretches(g["target_latency"].to_numpy(float), window, variation)
        first, last = [a for a, _, _ in found], [b - 1 for _, b, _ in found]
        line, time = g["line_number"].to_numpy(), g["timestamp"].to_numpy()
        return pd.DataFrame({"file_id": g["file_id"].iloc[0], "start_line": line[first], "end_line": line[last], "start": time[first], "end": time[last], "samples": [b - a for a, b, _ in found], "avg_latency": [m for _, _, m in found]})

    rows = perf.join(some, "file_id", "left_semi").select(F.col("file_id").cast("long").alias("file_id"), LINE, "timestamp", "target_latency")
    return rows.groupBy("file_id").applyInPandas(scan, PLATEAU)


def stretches(v: np.ndarray, window: int, variation: float) -> list[tuple[int, int, float]]:
    """(first, one past the last, mean) of the high and steady stretches of a series."""
    level = v.mean()
    one, two = (np.concatenate(([0.0], np.cumsum((v - level) ** k))) for k in (1, 2))

    def spread(a: np.ndarray | int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, s = b - a, one[b] - one[a]
        return level + s / n, np.sqrt(np.maximum(0.0, two[b] - two[a] - s * s / n) / (n - 1))

    # a stretch needs a sample behind its first window
    starts = np.arange(max(0, len(v) - window))
    mean, dev = spread(starts, starts + window)
    open_, out, a = starts[(mean > 1.3 * level) & (mean > 0) & (dev < variation * mean)], [], 0
    while (k := np.searchsorted(open_, a)) < len(open_):
        a = int(open_[k])
        longer = np.arange(a + window + 1, len(v) + 1)
        mean, dev = spread(a, longer)
        ends = np.flatnonzero(~((mean > level) & (mean > 0) & (dev < 1.5 * variation * mean)))
        b = a + window + (int(ends[0]) if len(ends) else len(longer))
        out.append((a, b, float(level + (one[b] - one[a]) / (b - a))))
        a = b
    return out


def high_latency_windows(perf: DataFrame) -> DataFrame:
    """Longest stretches of samples above the value at three quarters of the sorted ones."""
    limit = floor_percentile(perf, FILE, "target_latency", (0.75,), ("limit",)).select("file_id", "limit")
    w = ordered(FILE, ["timestamp", LINE])
    own = perf.filter("timestamp is not null").join(limit, "file_id").withColumn("high", F.col("target_latency") > F.col("limit")).withColumn("_at", F.row_number().over(w))
    marked = islands(own, FILE, "_at", ~F.col("high")).filter("high")
    return marked.groupBy("file_id", "island").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count("*").alias("samples"), F.max("target_latency").alias("peak")).drop("island")


def errors_in_high_latency(errors: DataFrame, perf: DataFrame) -> DataFrame:
    """Errors inside a high-latency window (the first that holds them), with a class by their text; times meet in buckets of an hour."""
    epoch = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    spans = high_latency_windows(perf).select("file_id", epoch("start").alias("_s"), epoch("end").alias("_e"), F.col("start").alias("window_start"), F.col("end").alias("window_end"))
    hits = range_join(errors.filter("timestamp is not null").withColumn("_t", epoch("timestamp")), spans, FILE, "_t", "_s", "_e", 3600)
    low = F.lower("text")
    kind = F.when(low.contains("connect"), "connection").when(low.contains("timeout"), "timeout").when(low.contains("memory"), "memory").when(low.contains("sql"), "sql").otherwise("other")
    first = topk_per_group(hits, ["file_id", LINE], ["window_start"], 1)
    return first.select("file_id", LINE, "timestamp", "component", "text", "window_start", "window_end", kind.alias("error_class"))


def error_latency_timeline(errors: DataFrame, perf: DataFrame, k: int = 50) -> DataFrame:
    """The first k errors by time, with the last latency at or before each."""
    first = topk_per_group(errors, FILE, [F.asc_nulls_first("timestamp"), LINE], k).filter("timestamp is not null")
    return asof_backward(first.select("file_id", LINE, "timestamp", "component", "error_code"), perf.filter("timestamp is not null").select("file_id", F.col("timestamp").alias("sample_time"), "target_latency", "source_latency"), FILE, "timestamp", "sample_time", ["target_latency", "source_latency"])


def latency_time_to_line(perf: DataFrame, times: DataFrame) -> DataFrame:
    """The line of each time (file_id, at), interpolated between the samples around it."""
    epoch = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    both = perf.filter("timestamp is not null").select("file_id", epoch("timestamp").alias("t"), F.col(LINE).alias("l"), F.lit(None).cast("timestamp_ntz").alias("at")).unionByName(times.select("file_id", epoch("at").alias("t"), F.lit(None).cast("long").alias("l"), "at"))
    w = W.partitionBy("file_id").orderBy("t", F.col("l").isNull())
    known = F.when(F.col("l").isNotNull(), F.struct("t", "l"))
    out = both.withColumns({"a": F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), "b": F.first(known, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))}).filter("at is not null")
    share = F.coalesce(F.try_divide(F.col("t") - F.col("a.t"), F.col("b.t") - F.col("a.t")), F.lit(0.0))
    line = F.when(F.col("a").isNull(), F.col("b.l")).when(F.col("b").isNull(), F.col("a.l")).otherwise(F.round(F.col("a.l") + share * (F.col("b.l") - F.col("a.l"))))
    return out.select("file_id", "at", line.cast("long").alias(LINE))


def latency_series(perf: DataFrame) -> DataFrame:
    """Samples for plotting; files with one sample have no series."""
    n = F.count("*").over(W.partitionBy("file_id"))
    return perf.withColumn("_n", n).filter("_n >= 2").select("file_id", LINE, "timestamp", *[F.coalesce(f"{k}_latency", F.lit(0.0)).alias(f"{k}_latency") for k in KINDS])
