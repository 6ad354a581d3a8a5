"""A growing log as a stream (ST1 to ST5): parsing, latency windows, issue counts and batches, by the same parsers as stored logs.

A log arrives as text files, each a piece of it with a number in its name (stream_text). What depends on the lines before (their numbers, what continuations
take over, the open batch) is state by log: pieces that come too early wait for those before them, and timers in event time end the waiting, and batches that never end.
The state needs RocksDB: spark.sql.streaming.stateStore.providerClass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from replog.functions import patterns as P
from replog.operators import parse as R

LINES = "file_id long, line_number long, body string"


def stream_lines(spark: SparkSession, path: str, schema: str = LINES) -> DataFrame:
    """Parsed lines of files that arrive in a folder, numbered by what writes them; a stream has no order of its own, so continuations are not filled."""
    return R.parse_prefix(spark.readStream.schema(schema).parquet(path))


def _timed(df: DataFrame, late: str) -> DataFrame:
    return df.withColumn("at", F.col("timestamp").cast("timestamp")).withWatermark("at", late)


def stream_latency(lines: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Averages and the bottleneck of each window and file."""
    perf = _timed(R.parse_latency(lines), late)
    out = perf.groupBy(F.window("at", width), "file_id").agg(F.count("*").alias("samples"), F.avg("source_latency").alias("avg_source"), F.avg("target_latency").alias("avg_target"), F.avg("handling_latency").alias("avg_handling"))
    share = F.try_divide(F.col("avg_source"), F.col("avg_source") + F.col("avg_handling"))
    return out.withColumn("bottleneck", F.when(share > 0.65, "source").when(share < 0.35, "handling").otherwise("balanced"))


def stream_issue_counts(lines: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Errors by window, file, component and summary."""
    return _timed(R.error_lines(lines), late).groupBy(F.window("at", width), "file_id", "component", R.message_summary("text").alias("summary")).agg(F.count("*").alias("n"))


def stream_pairs(lines: DataFrame, late: str = "10 minutes", most: str = "1 hour") -> DataFrame:
    """Openings and closings of redo logs joined in time, at most so far apart."""
    own = _timed(R.parse_redo(lines), late)
    a = own.filter("opens").select("file_id", "redo_path", F.col("at").alias("opened"), F.col("line_number").alias("line_open"))
    b = own.filter("not opens").select(F.col("file_id").alias("f"), F.col("redo_path").alias("p"), F.col("at").alias("closed"), F.col("line_number").alias("line_close"))
    on = f"file_id = f and redo_path = p and line_close > line_open and closed >= opened and closed <= opened + interval {most}"
    return a.join(b, F.expr(on)).drop("f", "p")


BATCH = "file_id long, line_number long, start_timestamp timestamp, end_timestamp timestamp, changes long, applies long"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One file's apply lines since last time: the open batch is kept as (start, changes, applies)."""
    held = state.get if state.exists else (None, 0, 0)
    rows = pd.concat(list(frames)).sort_values("line_number")
    out = []
    for r in rows.itertuples():
        if r.starts:
            held = (r.at, 0, 0)
        if r.changes == r.changes and r.changes is not None:
            held = (held[0], held[1] + int(r.changes), held[2] + 1)
        if r.ends and held[0] is not None:
            out.append((key[0], r.line_number, held[0], r.at, held[1], held[2]))
            held = (None, 0, 0)
    state.update(held)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in BATCH.split(", ")])


def stream_batches(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Apply batches as they end, with a state of one open batch for each file; lines of a file must arrive in order."""
    changes = R.found("body", P.RUN_STATEMENT, 3).cast("long") - R.found("body", P.RUN_STATEMENT, 2).cast("long") + 1
    own = _timed(lines.filter("component = 'TARGET_APPLY' and timestamp is not null"), late).select("file_id", "line_number", "at", R.matches("body", P.BATCH_START).alias("starts"), F.col("body").contains("Bulk finished.").alias("ends"), changes.cast("double").alias("changes"))
    return own.groupBy("file_id").applyInPandasWithState(_step, BATCH, "start timestamp, changes long, applies long", "append", GroupStateTimeout.NoTimeout)


#: A log's name and the number of a piece of it, from the path of a file.
PIECE = r"([^/]+?)\.(\d+)\.(?:log|txt)$"


def stream_text(spark: SparkSession, path: str, name: str = PIECE, **options: str) -> DataFrame:
    """Lines of the text files that arrive in a folder: file_id (the log), piece, and seq, the line's place in its piece; with the parts of their prefix. A piece is read whole: what writes the log bounds it."""
    raw = spark.readStream.options(**options).option("wholetext", True).text(path)
    lines = F.split(F.regexp_replace(F.make_valid_utf8("value"), r"\r?\n\z", ""), r"\r?\n")
    own = raw.select(F.regexp_extract("_metadata.file_path", name, 1).alias("file_id"), F.regexp_extract("_metadata.file_path", name, 2).cast("long").alias("piece"), F.posexplode(lines).alias("seq", "body"))
    return R.parse_prefix(own)


FILLED = "file_id string, line_number long, thread_id string, timestamp timestamp_ntz, component string, severity string, is_continuation boolean, body string"
ENDED = "file_id string, line_number long, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, changes_count long, applies_count long, closed string"
LAST = "piece long, line long, thread_id string, component string, timestamp timestamp_ntz"
OPEN = "line long, start timestamp_ntz, changes long, applies long"
WAITING = "piece long, seq long, body string, is_blank boolean, is_continuation boolean, thread_id string, timestamp timestamp_ntz, component string, severity string, starts boolean, ends boolean, changes long"
NAMES = [c.split()[0] for c in WAITING.split(", ")]


class Ordered(StatefulProcessor):
    """Puts the pieces of a log in order, numbers their lines from 0 and fills continuations; what subclasses make of the lines is sent on.

    A piece that is not the next one waits. When the watermark has passed the newest line that waits by `wait` seconds, the missing pieces are given up."""

    def __init__(self, wait: float):
        self.wait = int(wait * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)
        self.early = handle.getListState("early", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = [tuple(None if v is pd.NaT or v != v else v for v in r) for df in rows for r in df[NAMES].itertuples(index=False)]
        yield from self.go_on(key, new, timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield from self.expired(key, timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def expired(self, key, timers, at: int) -> Iterator[pd.DataFrame]:
        if self.early.exists():
            yield from self.go_on(key, [], timers, True)

    def go_on(self, key, new: list[tuple], timers, all_of_them: bool) -> Iterator[pd.DataFrame]:
        piece, line, thread, component, at = self.last.get() if self.last.exists() else (0, 0, None, None, None)
        waiting = [tuple(r) for r in self.early.get()] if self.early.exists() else []
        by: dict[int, list[tuple]] = {}
        for r in waiting + new:
            by.setdefault(int(r[0]), []).append(r)
        out = []
        for n in sorted(by):
            if n > piece and not all_of_them:
                break
            # a piece that was given up and comes after all is taken where it comes
            for r in sorted(by.pop(n), key=lambda r: r[1]):
                x = dict(zip(NAMES, r, strict=True))
                number, line = line, line + 1
                thread, component, at = x["thread_id"] or thread, x["component"] or component, x["timestamp"] if x["timestamp"] is not None else at
                if not x["is_blank"]:
                    out.append(x | {"line_number": number, "thread_id": thread, "component": component, "timestamp": at})
            piece = max(piece, n + 1)
        self.last.update((piece, line, thread, component, at))
        rest = [r for rows in by.values() for r in rows]
        if rest:
            self.early.put(rest)
            times = [r[NAMES.index("timestamp")] for r in rest if r[NAMES.index("timestamp")] is not None]
            if times and new:
                self.handle.registerTimer(int(pd.Timestamp(max(times)).timestamp() * 1000) + self.wait)
        elif waiting:
            self.early.clear()
        yield from self.sent(key[0], out, timers)

    def sent(self, file_id: str, lines: list[dict], timers) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FILLED.split(", ")]
        yield pd.DataFrame([[file_id, *(x[n] for n in names[1:])] for x in lines], columns=names)

    def close(self) -> None:
        pass


class Batches(Ordered):
    """Apply batches of a log as they end; one that has not ended `stale` seconds of event time after its last line is sent with no end and closed."""

    def __init__(self, wait: float, stale: float):
        super().__init__(wait)
        self.stale = int(stale * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", OPEN)
        self.due = handle.getValueState("due", "ms long")

    def expired(self, key, timers, at: int) -> Iterator[pd.DataFrame]:
        yield from super().expired(key, timers, at)
        if self.open.exists() and self.due.exists() and self.due.get()[0] <= at:
            line, start, changes, applies = self.open.get()
            self.open.clear()
            self.due.clear()
            yield self.frame([(key[0], line, start, None, changes, applies, "stale")])

    def sent(self, file_id: str, lines: list[dict], timers) -> Iterator[pd.DataFrame]:
        held, out, newest = (tuple(self.open.get()) if self.open.exists() else None), [], None
        for x in lines:
            if x["component"] != "TARGET_APPLY":
                continue
            newest = x["timestamp"] if x["timestamp"] is not None else newest
            if x["starts"]:
                held = (x["line_number"], x["timestamp"], 0, 0)
            if held is not None and x["changes"] is not None:
                held = (*held[:2], held[2] + int(x["changes"]), held[3] + 1)
            if held is not None and x["ends"]:
                if held[1] is not None and x["timestamp"] is not None:
                    out.append((file_id, x["line_number"], held[1], x["timestamp"], held[2], held[3], "ended"))
                held = None
        if held is None:
            self.open.clear()
            self.due.clear()
        else:
            self.open.update(held)
            if newest is not None:
                due = int(pd.Timestamp(newest).timestamp() * 1000) + self.stale
                self.due.update((due,))
                self.handle.registerTimer(due)
        yield self.frame(out)

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in ENDED.split(", ")])
        return out.astype({"start_timestamp": "datetime64[us]", "end_timestamp": "datetime64[us]"})


def _pieces(lines: DataFrame, late: str) -> DataFrame:
    """Lines of stream_text with what batches are made of, and the time that the watermark follows."""
    changes = R.found("body", P.RUN_STATEMENT, 3).cast("long") - R.found("body", P.RUN_STATEMENT, 2).cast("long") + 1
    own = lines.withColumns({"starts": R.matches("body", P.BATCH_START), "ends": F.col("body").contains("Bulk finished."), "changes": changes})
    return own.withColumn("at", F.col("timestamp").cast("timestamp")).withWatermark("at", late).select("file_id", "at", *NAMES)


def fill_stream(lines: DataFrame, late: str = "10 minutes", wait: float = 600) -> DataFrame:
    """Lines of stream_text, numbered and filled as those of whole files are."""
    return _pieces(lines, late).groupBy("file_id").transformWithStateInPandas(Ordered(wait), FILLED, "Append", "EventTime")


def stream_text_batches(lines: DataFrame, late: str = "10 minutes", wait: float = 600, stale: float = 3600) -> DataFrame:
    """Apply batches of stream_text's lines (E1's, without reason and tables), and stale ones."""
    return _pieces(lines, late).groupBy("file_id").transformWithStateInPandas(Batches(wait, stale), ENDED, "Append", "EventTime")
