"""Redaction of names, addresses and secrets in free text.

Spans are found in Arrow batches, as Catalyst has no list of matches with their places. Where spans overlap, the higher score wins, then the
longer span, then the one further left. People's names need a language model and are not found."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kind, pattern and score of what is looked for, and the tag of each kind.
RECOGNIZERS = (
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.6), ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b", 1.0), ("URL", r"\bhttps?://[^\s\"'<>]+", 0.6), ("PHONE_NUMBER", r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}", 0.4),
    ("HOST_AFTER_VERSION", r"\bV\d[\w.\-]*\s+([A-Za-z0-9][-A-Za-z0-9.]+)", 0.9), ("CONNECTION_HOST", r"(?:SYSTEM|SERVER|HOST|Data Source)=([^;]+)", 0.9), ("CONNECTION_PASSWORD", r"(?:PWD|PASSWORD)=([^;]+)", 0.9), ("HOSTNAME", r"\b(?:[A-Za-z0-9][-A-Za-z0-9]*\.)+[A-Za-z]{2,}\b", 0.7),
    ("UNC_PATH", r"\\\\[^\s\\]+\\[^\s]*", 0.9), ("CONNECTION_STRING", r"UID=[^;]+", 0.85), ("CONNECTION_STRING", r"(?:SERVER|HOST|SYSTEM|Data Source)=[^;]+", 0.85), ("LICENSE_INFO", r"Licensed to\s+[^,\n]+", 0.9), ("WINDOWS_PATH", r"C:\\Program Files\\[^\\]+\\[^\\]+\\", 0.7),
    ("WINDOWS_PATH", r"C:\\Users\\[^\\]+\\", 0.8), ("CLOUD_RESOURCE", r"adb-\d+\.\d+\.[a-z]+\.[a-z]+\.[a-z]+", 0.9), ("CLOUD_RESOURCE", r"arn:aws:[a-z0-9-]+:[a-z0-9-]*:\d*:[^\s]+", 0.9), ("HTTP_PATH", r"HTTPPath=\{[^}]+\}", 0.9),
    ("TASK_SERVER_INFO", r"\(V\d+[\w.\-]*.*?PID:\s*\d+\s*\)", 0.9), ("TASK_SERVER_INFO", r"Task Server Log\s*-\s*[A-Za-z0-9_.-]+", 0.65), ("REVISION_HASH", r"Revision:[a-f0-9]{40}", 0.9),
)
TAGS = {"IP_ADDRESS": "[IP_ADDRESS]", "EMAIL_ADDRESS": "[EMAIL]", "URL": "[URL]", "PHONE_NUMBER": "[PHONE]", "HOST_AFTER_VERSION": "[HOST]", "CONNECTION_HOST": "[HOST]", "CONNECTION_PASSWORD": "[PASSWORD]", "HOSTNAME": "[HOSTNAME]", "UNC_PATH": "[UNC_PATH]", "CONNECTION_STRING": "[REDACTED]", "LICENSE_INFO": "[COMPANY_NAME]", "WINDOWS_PATH": "[PATH]", "CLOUD_RESOURCE": "[CLOUD_RESOURCE]", "HTTP_PATH": "[REDACTED]", "TASK_SERVER_INFO": "[SERVER_INFO]", "REVISION_HASH": "[REVISION]"}
#: What is never sensitive. Unlike the original, letters must match in case and SCHEMA.TABLE must be all of a span, for else host names and addresses would be kept.
DENIED = "|".join((
    r"\bHY\d+\b", r"\bNativeError\b", r"\bSQLSTATE\b", r"\bORA-\d+\b", r"\bSQL\d+\b", r"\bATT-\d+\b",
    r"\bTarget\s+Load\b", r"\bSource\s+Capture\b", r"\bFull\s+Load\b", r"\bChange\s+Processing\b", r"\bApply\s+Changes\b",
    r"\b[A-Z][a-z]+Task\b", r"\b[A-Z][a-z]+Manager\b", r"\b[A-Z][a-z]+Handler\b", r"\b[A-Z][a-z]+Processor\b", r"\b[A-Z][a-z]+Service\b",
    r"^[A-Z_]+\.[A-Z_]+$",
))
SPAN = "array<struct<start: int, end: int, kind: string, score: double>>"


def spans(text: str, deny: bool = True) -> list[tuple[int, int, str, float]]:
    """What is to be redacted in a text, from left to right, without overlaps."""
    found = []
    for kind, pattern, score in RECOGNIZERS:
        for m in re.finditer(pattern, text):
            a, b = m.span(m.lastindex or 0)
            if b > a and not (deny and re.search(DENIED, text[a:b])):
                found.append((a, b, kind, score))
    kept: list[tuple[int, int, str, float]] = []
    for s in sorted(found, key=lambda s: (-s[3], s[0] - s[1], s[0])):
        # spans that are kept do not overlap, so that only the last one that begins before this one's end can reach into it
        k = bisect_left(kept, (s[1],))
        if not k or kept[k - 1][1] <= s[0]:
            kept.insert(k, s)
    return kept


def find_sensitive(df: DataFrame, col: str, deny: bool = True) -> DataFrame:
    """df with spans, an array of start, end, kind and score."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at, names = df.columns.index(col), df.columns
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in spans(t or "", deny)] for t in b.column(at).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(out, kind)], [*names, "spans"])

    return df.mapInArrow(run, f"{fields}, spans {SPAN}")


def sensitive_rows(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """One row a span, with its text."""
    rows = find_sensitive(df.select(*keys, col), col).select(*keys, col, F.explode("spans").alias("s"))
    return rows.select(*keys, "s.start", "s.end", "s.kind", "s.score", F.col(col).substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("found"))


def drop_false_positives(rows: DataFrame, col: str = "found") -> DataFrame:
    return rows.filter(~F.col(col).rlike(DENIED))


def redact(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with what is sensitive in the columns replaced by tags."""
    tags = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    for c in cols:
        found = find_sensitive(df, c)
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.col(c).substr(acc["at"] + 1, s["start"] - acc["at"]), tags[s["kind"]]).alias("out"))  # noqa: E731, B023
        whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.col(c).substr(acc["at"] + 1, F.length(c) - acc["at"])))  # noqa: B023
        df = found.withColumn(c, F.when(F.col(c).isNotNull(), whole)).drop("spans")
    return df


def redact_pattern(col: Column) -> Column:
    """The fast form: replacements by pattern, one after the other, inside the JVM."""
    for kind, pattern, _ in sorted(RECOGNIZERS, key=lambda r: -r[2]):
        # of patterns with a group only the group is replaced, which needs what stands before it
        whole, _, tail = pattern.rpartition("([")
        if kind in ("HOST_AFTER_VERSION", "CONNECTION_HOST", "CONNECTION_PASSWORD"):
            col = F.regexp_replace(col, f"({whole})[{tail.removesuffix(')')}", f"$1{TAGS[kind]}")
        else:
            col = F.regexp_replace(col, pattern, TAGS[kind])
    return col


def redact_nested(df: DataFrame) -> DataFrame:
    """All strings of df, inside structs, arrays and maps too, by the fast form."""

    def walk(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return redact_pattern(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: walk(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[walk(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def redaction_preview(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """How many spans of each kind each document has."""
    return sensitive_rows(df, col, keys).groupBy(*keys, "kind").agg(F.count("*").alias("n"))

