"""Raw lines to typed fact tables (P1 to P33): projections and filters, one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replog.functions import patterns as P
from replog.plans.scale import forward_fill

TIME = "yyyy-MM-dd'T'HH:mm:ss"


def found(col: str | Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(F.col(col) if isinstance(col, str) else col, pattern, group), F.lit(""))


def matches(col: str, pattern: str) -> Column:
    return F.col(col).rlike(pattern)


def severity(col: str = "body") -> Column:
    return found(col, P.SEVERITY)


def parse_prefix(df: DataFrame, body: str = "body") -> DataFrame:
    """thread_id, timestamp, component, severity and is_continuation from each line's prefix; a prefix without brackets is UNKNOWN's."""
    whole, start = F.col(body).rlike(P.PREFIX), F.col(body).rlike(P.LINE_START)
    return df.withColumns({
        "is_blank": F.trim(F.col(body)) == "",
        "is_continuation": ~start & (F.trim(F.col(body)) != ""),
        "thread_id": found(body, P.LINE_START),
        "timestamp": F.try_to_timestamp(found(body, P.LINE_START, 2), F.lit(TIME)).cast("timestamp_ntz"),
        "component": F.when(whole, F.trim(found(body, P.PREFIX, 3))).when(start, F.lit("UNKNOWN")),
        "severity": severity(body),
    })


def fill_continuations(df: DataFrame, split: str | None = None, once: bool = False) -> DataFrame:
    """Lines without a prefix take thread, component and timestamp of the line before; blank lines go."""
    return forward_fill(df, ["file_id"], "line_number", ["thread_id", "component", "timestamp"], split, once).filter(~F.col("is_blank"))


def error_code(col: str = "body") -> Column:
    """The line's canonical error code; the vendors' forms are tried in a fixed order."""
    odbc = F.upper(found(col, P.ODBC))
    return F.coalesce(
        F.when(matches(col, P.SQL_STATE), F.concat(F.lit("SqlState:"), found(col, P.SQL_STATE), F.lit("/"), found(col, P.SQL_STATE, 2))),
        F.upper(found(col, P.ORA)),
        F.concat(F.lit("MySQL:"), found(col, P.MYSQL)),
        F.concat(F.lit("PG:"), found(col, P.POSTGRES)),
        F.when(odbc != "SQL_SUCCESS", odbc),
        F.when(found(col, P.NATIVE).cast("decimal(38,0)") != 0, F.concat(F.lit("Native:"), found(col, P.NATIVE))),
    )


def error_lines(lines: DataFrame) -> DataFrame:
    """The errors table: lines with their own prefix that report an error or a warning."""
    hits = lines.filter(matches("body", P.ERROR) & ~F.col("is_continuation"))
    return hits.select("file_id", "line_number", "timestamp", "component", "thread_id", "severity", F.col("body").alias("text"), error_code().alias("error_code"))


def error_codes_all(col: str = "body") -> Column:
    """All distinct codes of the vendors' forms, sorted."""
    forms = [P.ORA, r"(?i)(SQLSTATE[:\s]+\w+)", r"(?i)(NativeError:\s*\d+)", r"(?i)(MySQL.*?Error\s+\d{4})", r"(?i)(RetCode:\s*SQL_\w+)", r"(?i)(SQL\d{4,5}[A-Z]?)"]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.transform(F.regexp_extract_all(F.col(col), F.lit(p), F.lit(1)), F.upper) for p in forms]))))


def parse_latency(lines: DataFrame) -> DataFrame:
    """The performance table: three latencies of each sample."""
    hits = lines.filter((F.col("component") == "PERFORMANCE") & matches("body", P.LATENCY))
    names = ("source_latency", "target_latency", "handling_latency")
    return hits.select("file_id", "line_number", "timestamp", *[found("body", P.LATENCY, k + 1).cast("double").alias(n) for k, n in enumerate(names)])


def parse_redo_read(lines: DataFrame, slower_than: float = 200, any_component: bool = False) -> DataFrame:
    """Reads of archived redo logs slower than a limit in milliseconds."""
    hits = lines.filter(F.col("body").contains("edo log") & matches("body", P.REDO_READ))
    if not any_component:
        hits = hits.filter((F.col("component") == "PERFORMANCE") & ~matches("body", P.LATENCY))
    out = hits.select("file_id", "line_number", "timestamp", "thread_id", found("body", P.REDO_READ).cast("long").alias("bytes_read"), found("body", P.REDO_READ, 2).cast("double").alias("read_ms"), found("body", P.REDO_SOURCE).alias("source_location"))
    return out.filter(F.col("read_ms") > slower_than)


def parse_redo(lines: DataFrame, *more: str) -> DataFrame:
    """Openings and closings of redo logs, with more columns of the lines."""
    path = F.coalesce(found("body", P.REDO_OPEN), found("body", P.REDO_CLOSE))
    opens = matches("body", P.REDO_OPEN)
    return lines.filter((F.col("component") == "SOURCE_CAPTURE") & F.col("timestamp").isNotNull()).select("file_id", "line_number", *more, "timestamp", "thread_id", opens.alias("opens"), path.alias("redo_path"), F.when(opens, found("body", P.REDO_THREAD)).alias("thread_in_message")).filter("redo_path is not null")


def table_name(col: str = "body") -> Column:
    return F.when(matches(col, P.TABLE), F.concat(found(col, P.TABLE), F.lit("."), found(col, P.TABLE, 2)))


def first_timestamp(col: str = "body") -> Column:
    return F.try_to_timestamp(found(col, P.TIMESTAMP), F.lit(TIME)).cast("timestamp_ntz")


def closure_reason(col: str = "body") -> Column:
    """The code of the reason why a batch closed."""
    low = F.lower(F.col(col))
    return (
        F.when(matches(col, P.PK_INSERT), "PKi").when(matches(col, P.PK_UPDATE), "PKu").when(matches(col, P.PK_DELETE), "PKd")
        .when(low.contains("memory"), "MEM").when(low.contains("stream timeout"), "TIM").when(low.contains("bulk timeout"), "TMO")
        .when(low.contains("tables with pk") | low.contains("single"), "SNG").when(low.contains("resume"), "RES").when(low.contains("start_load_table"), "LOAD").otherwise("Normal")
    )


def closure_reason_activity(col: str = "body") -> Column:
    """The second dialect: timeouts before memory, and a resume only at the same place."""
    low = F.lower(F.col(col))
    return (
        F.when(low.contains("stream timeout"), "TIM").when(low.contains("bulk timeout"), "TMO").when(low.contains("memory"), "MEM").when(matches(col, P.PK_INSERT), "PKi")
        .when(matches(col, P.PK_UPDATE), "PKu").when(matches(col, P.PK_DELETE), "PKd").when(low.contains("tables with pk"), "SNG").when(low.contains("resume at the same"), "RES").when(low.contains("start_load_table"), "LOAD").otherwise("Normal")
    )


def closure_reason_script(col: str = "body") -> Column:
    """The third dialect: as the first, but `!!!` for a reason it does not know."""
    return F.when(closure_reason(col) == "Normal", "!!!").otherwise(closure_reason(col))


def parse_apply(lines: DataFrame, *more: str) -> DataFrame:
    """Start-applying, finished-applying and run-statement events of the apply component, with more columns of the lines."""
    kind = F.when(matches("body", P.START_APPLYING), "start").when(matches("body", P.FINISHED_APPLYING), "finish").when(matches("body", P.RUN_STATEMENT), "run")
    number = lambda p, k: found("body", p, k).cast("long")
    name = lambda p: F.when(matches("body", p), F.concat(found("body", p, 3), F.lit("."), found("body", p, 4)))
    hits = lines.filter((F.col("component") == "TARGET_APPLY") & kind.isNotNull())
    return hits.select(
        "file_id", "line_number", *more, "timestamp", "thread_id", kind.alias("kind"),
        F.upper(F.coalesce(found("body", P.START_APPLYING, 1), found("body", P.FINISHED_APPLYING, 2), found("body", P.RUN_STATEMENT, 1))).alias("op"),
        F.coalesce(number(P.START_APPLYING, 2), number(P.FINISHED_APPLYING, 1)).alias("n"), F.coalesce(name(P.START_APPLYING), name(P.FINISHED_APPLYING)).alias("table_name"),
        number(P.RUN_STATEMENT, 2).alias("from_seq"), number(P.RUN_STATEMENT, 3).alias("to_seq"),
    )


def parse_bulk_map(lines: DataFrame, *more: str) -> DataFrame:
    """bulk_map lines: range, rows, operation (UNKNOWN is a merge) and table, with more columns of the lines."""
    hits = lines.filter(F.lower(F.col("body")).contains("bulk_map") & matches("body", P.BULK_MAP))
    a, b, op = found("body", P.BULK_MAP).cast("long"), found("body", P.BULK_MAP, 2).cast("long"), F.upper(found("body", P.BULK_MAP, 3))
    return hits.select("file_id", "line_number", *more, "timestamp", a.alias("from_seq"), b.alias("to_seq"), (b - a + 1).alias("rows"), F.when(op == "UNKNOWN", "MERGE").otherwise(op).alias("op"), table_name().alias("table_name"))


#: Where the fields of full-load messages stand in what a message's pattern matched; numbers are read with all quoted names left out.
FULL_LOAD_NAMES = {"schema": r"(?i)table '([^']+)'\.'", "table": r"(?i)table '[^']+'\.'([^']+)'", "predicate": r"(?i)^Transformation Where\s+'([^']*)'", "task": r"(?i)^Task\s+'([^']+)'", "mode": r"(?i)^Task .*\s+in\s+(.+?)\s+mode$"}
FULL_LOAD_NUMBERS = {
    "table_id": r"(?i)(?:\(Id\s*=\s*|^Reloading table\s+)(\d+)", "subtask": r"(?i)subtask\s*#?(\d+)", "seg": r"(?i)(?:segment #|loading segment\s+)(\d+)", "seg_total": r"(?i)segment #\d+\s+of\s+(\d+)\s+of",
    "rows": r"(?i)(\d+)\s+(?:rows sent|rows received|records transferred)", "skipped": r"(?i)(\d+)\s+rows skipped", "volume": r"(?i)Volume transferred\s+(\d+)",
}


def parse_full_load(lines: DataFrame) -> DataFrame:
    """One typed row for each full-load message: its kind by the first pattern that matches, then the fields out of what matched."""
    every = "|".join(f"(?:{p})" for p, _ in P.FULL_LOAD.values())
    said = F.coalesce(*[F.when(matches("body", p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("body", p, 0).alias("part"))) for k, (p, _) in P.FULL_LOAD.items()])
    # a list of one: what later steps ask of the fields stays above it, so that no filter works the patterns out again
    hits = lines.filter(F.col("body").rlike(every)).select("file_id", "line_number", "timestamp", "thread_id", F.explode(F.array(said)).alias("said"))
    known = hits.select("file_id", "line_number", "timestamp", "thread_id", "said.kind", "said.part", F.regexp_replace("said.part", "'[^']*'", "''").alias("bare"))
    numbers = {n: found("bare", p) for n, p in FULL_LOAD_NUMBERS.items()}
    numbers["subtask"] = F.coalesce(numbers["subtask"], found("part", P.FULL_LOAD["command"][0]))
    return known.select("file_id", "line_number", "timestamp", "thread_id", "kind", *[found("part", p).alias(n) for n, p in FULL_LOAD_NAMES.items()], *[c.cast("long").alias(n) for n, c in numbers.items()])


def parse_file_ops(lines: DataFrame, *more: str) -> DataFrame:
    """Compress starts, compressions and uploads of files, with more columns of the lines."""
    kind = F.when(matches("body", P.COMPRESS_START), "start").when(matches("body", P.UPLOADED), "uploaded").when(matches("body", P.COMPRESSED), "compressed")
    hits = lines.filter(kind.isNotNull())
    return hits.select("file_id", "line_number", *more, "timestamp", kind.alias("kind"), F.upper(found("body", P.CSV_NAME)).alias("csv_name"), found("body", P.CSV_NAME).alias("file_name"), found("body", P.UPLOADED, 2).cast("long").alias("size_bytes"))


def pipeline_events(lines: DataFrame) -> DataFrame:
    """Memory warnings, overflows, disconnects, reconnects, network errors and resource limits; one line may report several."""
    rules = {"memory_warning": matches("body", P.MEMORY_WARNING), "overflow": F.lower(F.col("body")).contains("overflow") & F.col("component").startswith("SORTER"), "target_disconnect": matches("body", P.TARGET_DISCONNECT), "source_reconnect": matches("body", P.SOURCE_RECONNECT), "network_error": matches("body", P.NETWORK_ERROR), "resource_limit": matches("body", P.RESOURCE_LIMIT)}
    kinds = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return lines.select("file_id", "line_number", "timestamp", "component", F.substring("body", 1, 200).alias("text"), F.explode(kinds).alias("event_type"))


def sorter_metrics(lines: DataFrame) -> DataFrame:
    """Numbers and positions that pipeline components report, one row for each."""
    # a queue's depth stands in either of its pattern's two groups
    value = lambda k, p: F.coalesce(found("body", p), found("body", p, 2)) if k == "queue_depth" else found("body", p)
    pairs = F.array_compact(F.array(*[F.when(matches("body", p), F.struct(F.lit(k).alias("metric"), value(k, p).alias("value"))) for k, p in P.SORTER.items()]))
    return lines.select("file_id", "line_number", "timestamp", F.explode(pairs).alias("m")).select("file_id", "line_number", "timestamp", "m.metric", "m.value")


def task_config(lines: DataFrame) -> DataFrame:
    """Each file's settings; the last line that sets one wins."""
    number = {"bulk_timeout_ms": (P.BULK_TIMEOUT, 1), "bulk_timeout_min_ms": (P.BULK_TIMEOUT_MIN, 1), "bulk_max_file_size_kb": (P.BULK_FILE_SIZE, 2), "parallel_apply_threads": (P.PARALLEL_APPLY, 1)}
    text = {"source_type": P.SOURCE_ENDPOINT, "target_type": P.TARGET_ENDPOINT}
    last = lambda c, n: F.max_by(c, F.when(c.isNotNull(), F.col("line_number"))).alias(n)
    hits = lines.filter(F.col("body").rlike(r"(?i)bulk|endpoint '|merge"))
    return hits.groupBy("file_id").agg(*[last(found("body", p, k).cast("long"), n) for n, (p, k) in number.items()], *[last(found("body", p), n) for n, p in text.items()], F.max(matches("body", P.MERGE)).alias("merge_enabled"))


def release_of_version(col: str) -> Column:
    """`2025.5.x` as `May 2025`."""
    months = F.array(*[F.lit(m) for m in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")])
    month = found(col, r"(20\d{2})\.(\d{1,2})", 2).cast("int")
    return F.when(month.between(1, 12), F.concat(F.element_at(months, month), F.lit(" "), found(col, r"(20\d{2})\.(\d{1,2})")))


def strip_prefix(col: str = "body") -> Column:
    """The line without its prefix; otherwise from the first word that tells of a failure."""
    after = F.regexp_replace(F.col(col), r"^\s*\d+:\s+\d{4}-\d{2}-\d{2}T[\d:]+\s*\[[^\]]*\][A-Z]:\s*", "")
    word = found(col, r"(?is)((?:RetCode|SqlState|NativeError|ORA-\d|error|failed).*)$")
    return F.when(after != F.col(col), after).otherwise(F.coalesce(word, F.col(col)))


def message_summary(col: str = "body") -> Column:
    """The message after the severity without a trailing source reference, 200 characters at most."""
    text = F.regexp_replace(found(col, r"\][EWT]:\s*(.+)$"), r"\s*\([\w.]+\.c:\d+\)\s*$", "")
    return F.substring(F.coalesce(F.trim(text), F.col(col)), 1, 200)


def message_key(col: str = "body") -> Column:
    """The line without thread, time and source reference."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.col(col), r"^\s*\d+:\s+\d{4}-\d{2}-\d{2}T[\d:]+\s*", ""), r"\s*\([\w.]+\.c:\d+\)\s*$", ""))


def normalize_error(col: str = "text") -> Column:
    """An error's text without what changes from one occurrence to the next, 160 characters at most."""
    out = F.col(col)
    for pattern in (r"(?i)LINE \d+", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?::\d+)?", r"st_\d+_\w+", r"(?i)(?:subtask|line)\s+#?\d+"):
        out = F.regexp_replace(out, pattern, "")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, 160)


def preset_pattern_hits(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Hits of each named pattern by file, all in one scan."""
    hits = F.array_compact(F.array(*[F.when(matches("body", p), F.lit(n)) for n, p in patterns.items()]))
    return lines.select("file_id", F.explode(hits).alias("label")).groupBy("file_id", "label").agg(F.count("*").alias("hits"))


def is_db_error(col: str = "text") -> Column:
    return F.col(col).rlike(r"(?i)odbc|oci|sql_error|sqlstate|rtcode|retcode")


def redact_light(col: str) -> Column:
    """Addresses, user folders, long hexadecimal numbers and GUIDs replaced by tags."""
    out = F.regexp_replace(F.col(col), r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "[IP]")
    out = F.regexp_replace(out, r"(?i)([A-Z]:\\Users\\|/home/)[^\\/\s]+", "$1[USER]")
    out = F.regexp_replace(out, r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "[GUID]")
    return F.regexp_replace(out, r"(?i)\b[0-9a-f]{16,}\b", "[HEX]")


def component_description(df: DataFrame, descriptions: DataFrame) -> DataFrame:
    """df with the description of its component from a table (component, description)."""
    return df.join(descriptions.select("component", "description"), "component", "left")


def work_table_events(lines: DataFrame) -> DataFrame:
    """Creations of the apply's helper table with their last column."""
    hits = lines.filter(F.lower(F.col("body")).contains("create table") & F.col("body").contains("attrep_changes"))
    return hits.select("file_id", "line_number", "timestamp", found("body", r"(?i)attrep_changes(\w+)").alias("work_table"), found("body", r"\[(\w+)\][^\[]*$").alias("last_column"))


def prompt_error_tokens(lines: DataFrame, most: int = 14) -> DataFrame:
    """The first distinct error tokens of each file in order: issue numbers, vendor codes, hexadecimal values, five characters at least."""
    from replog.plans.scale import topk_per_group

    pattern = r"(RECOB-\d+|ORA-\d+|SQLSTATE[ :=]*\w+|SQL\d+\w*|ERR[-_ ]?\d+|0x[0-9A-Fa-f]+)"
    hits = lines.select("file_id", "line_number", F.posexplode(F.regexp_extract_all("body", F.lit(pattern), F.lit(1))).alias("at", "token"))
    own = hits.withColumn("token", F.substring(F.trim("token"), 1, 120)).filter(F.length("token") >= 5).withColumn("_key", F.lower("token"))
    once = topk_per_group(own, ["file_id", "_key"], ["line_number", "at"], 1).drop("_key")
    return topk_per_group(once, ["file_id"], ["line_number", "at"], most, "rank")


#: What a log's first lines tell of its task.
PROPERTIES = {
    "task_name": r"Task Server Log\s*-\s*([A-Za-z0-9_.-]+)", "version": r"\(V(\d[\w.\-]*)", "host": r"\(V\d[\w.\-]*\s+([A-Za-z0-9][-A-Za-z0-9.]+)", "os": r"\(V\d[\w.\-]*\s+\S+\s+([^,)]+)", "pid": r"PID:\s*(\d+)", "started": r"started at ([^)]+)\)",
    "rollover": r"(?i)(log file (?:was )?roll(?:ed)? ?over)", "run_mode": r"(?i)running\s+(full load(?:\s+and\s+CDC)?|CDC only)", "source_provider": r"(?i)Source endpoint '[^']+' is using provider syntax '([^']+)'", "target_provider": r"(?i)Target endpoint '[^']+' is using provider syntax '([^']+)'",
}


def task_properties(lines: DataFrame, within: int = 1000) -> DataFrame:
    """What the first lines of each file tell of its task; a later line overwrites an earlier one. Log levels come as a list in order."""
    head = lines.filter(F.col("line_number") <= within)
    last = [F.max_by(found("body", p), F.when(found("body", p).isNotNull(), F.col("line_number"))).alias(n) for n, p in PROPERTIES.items()]
    level = found("body", r"(?i)(\w+ (?:log|logging) level (?:is )?(?:set|changed)[^.]*)")
    levels = F.transform(F.array_sort(F.collect_list(F.when(level.isNotNull(), F.struct("line_number", level.alias("l"))))), lambda x: x["l"])
    return head.groupBy("file_id").agg(*last, levels.alias("levels"))


def header_info(lines: DataFrame, files: DataFrame, within: int = 200) -> DataFrame:
    """Task, version, host and endpoints of each file (file_id, filename); the task's name is else the file name's."""
    head = task_properties(lines, within)
    ends = task_config(lines.filter(F.col("line_number") <= within)).select("file_id", "source_type", "target_type")
    named = files.select("file_id", found("filename", r"reptask_(.+?)\.log").alias("_file_task"))
    out = named.join(head, "file_id", "left").join(ends, "file_id", "left")
    return out.withColumn("task_name", F.coalesce("task_name", "_file_task")).drop("_file_task")
