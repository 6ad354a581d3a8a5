"""Issues, search, windows over lines and questions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replog.operators import parse as R
from replog.operators.terms import with_terms
from replog.plans.scale import islands, topk_per_group

FILE, LINE = ["file_id"], "line_number"


def errors_by_component(errors: DataFrame) -> DataFrame:
    return errors.groupBy("file_id", "component").agg(F.count("*").alias("errors"))


def error_aggregates(errors: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent normalised errors of each file, with first and last line."""
    g = errors.groupBy("file_id", R.normalize_error().alias("pattern")).agg(F.count("*").alias("occurrences"), F.min(F.when(F.col(LINE) > 0, F.col(LINE))).alias("first_line"), F.max(F.when(F.col(LINE) > 0, F.col(LINE))).alias("last_line"))
    return topk_per_group(g, FILE, [F.desc("occurrences"), "pattern"], k, "rank")


#: Codes that are counted as they stand.
CODES = r"\[\d{5,8}\]"


def code_counts(errors: DataFrame, k: int = 10) -> DataFrame:
    """The k codes that come most often in the errors of each file, every place counted."""
    each = errors.select("file_id", F.explode(F.regexp_extract_all("text", F.lit(f"({CODES})"), F.lit(1))).alias("code"))
    return topk_per_group(each.groupBy("file_id", "code").agg(F.count("*").alias("n")), FILE, [F.desc("n"), "code"], k, "rank")


def top_errors(errors: DataFrame, k: int = 10) -> DataFrame:
    return topk_per_group(errors.groupBy("file_id", "text").agg(F.count("*").alias("n")), FILE, [F.desc("n"), "text"], k, "rank")


def top_tables(stats: DataFrame, k: int = 10) -> DataFrame:
    return topk_per_group(stats, FILE, [F.desc("error_count"), F.desc("total_apply_time_seconds"), "table_name"], k, "rank")


def issues(errors: DataFrame) -> DataFrame:
    """Errors grouped by severity, component and summary; fatal first, then errors, then warnings, the most frequent first, then the first to occur."""
    low = F.lower("text")
    kind = F.when(low.contains("fatal"), "fatal").when(F.col("severity") == "W", "warning").otherwise("error")
    g = errors.withColumns({"kind": kind, "summary": R.message_summary("text")}).groupBy("file_id", "kind", "component", "summary").agg(F.count("*").alias("occurrences"), F.min(LINE).alias("first_line"), F.max(LINE).alias("last_line"))
    order = F.when(F.col("kind") == "fatal", 0).when(F.col("kind") == "error", 1).otherwise(2)
    return g.withColumn("rank", F.row_number().over(W.partitionBy("file_id").orderBy(order, F.desc("occurrences"), "first_line")))


def issue_summary(grouped: DataFrame) -> DataFrame:
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("occurrences"))), F.lit(0)).alias(k)
    return grouped.groupBy("file_id").agg(F.sum("occurrences").alias("total"), F.count("*").alias("unique"), n("fatal"), n("error"), n("warning"))


def context_window(lines: DataFrame, hits: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """Lines around each hit (file_id, line_number): an equi-join with the hit's line numbers."""
    near = hits.select("file_id", F.col(LINE).alias("hit_line"), F.explode(F.sequence(F.greatest(F.lit(0), F.col(LINE) - before), F.col(LINE) + after)).alias(LINE))
    return near.join(lines.select("file_id", LINE, "body"), ["file_id", LINE])


def issues_with_context(lines: DataFrame, errors: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Each issue with the lines around its first occurrence."""
    own = issues(errors)
    around = context_window(lines, own.select("file_id", F.col("first_line").alias(LINE)).distinct(), before, after).groupBy("file_id", "hit_line").agg(F.array_sort(F.collect_list(F.struct(LINE, "body"))).alias("context"))
    return own.join(around.withColumnRenamed("hit_line", "first_line"), ["file_id", "first_line"], "left")


def read_lines(lines: DataFrame, start: int, limit: int) -> DataFrame:
    return lines.filter((F.col(LINE) >= start) & (F.col(LINE) < start + limit))


MERGED = "file_id long, start long, end long, hits array<long>"


def merge_windows(hits: DataFrame, before: int = 3, after: int = 3, cap: int = 20) -> DataFrame:
    """Windows around hits (file_id, start, end, hits), merged where they touch. A merged window is cut cap lines behind its start; hits whose window touches what is left still join it.

    Hits too far apart to touch part a file into islands. An island that stays within the cap is one window; only the others are walked, each
    by itself, as there the cut decides what touches."""
    own = hits.select(F.col("file_id").cast("long").alias("file_id"), F.col(LINE).cast("long").alias(LINE)).dropna().distinct()
    w = W.partitionBy("file_id").orderBy(LINE)
    parted = islands(own.withColumn("_far", F.coalesce(F.col(LINE) - F.lag(LINE).over(w) > before + after + 1, F.lit(True))), FILE, LINE, F.col("_far"))
    g = parted.groupBy("file_id", "island").agg((F.min(LINE) - before).alias("start"), (F.max(LINE) + after).alias("end"), F.array_sort(F.collect_list(LINE)).alias("hits"))
    narrow = (F.col("end") - F.col("start") <= cap) | (F.size("hits") == 1)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file_id, lines in zip(b["file_id"], b["hits"], strict=True):
                own: list[int] = []
                start = end = 0
                for line in lines:
                    if own and line - before <= end + 1:
                        end = min(max(end, line + after), start + cap)
                    else:
                        if own:
                            out.append((file_id, start, end, own))
                        start, end, own = line - before, line + after, []
                    own.append(line)
                out.append((file_id, start, end, own))
            yield pd.DataFrame(out, columns=["file_id", "start", "end", "hits"])

    return g.filter(narrow).select("file_id", "start", "end", "hits").unionByName(g.filter(~narrow).select("file_id", "hits").mapInPandas(walk, MERGED))


def lines_in_time_range(lines: DataFrame, after: str, before: str) -> DataFrame:
    """Lines from a time on, up to the first line at or past another."""
    stop = F.min(F.when(F.col("timestamp") >= F.lit(before).cast("timestamp_ntz"), F.col(LINE))).over(W.partitionBy("file_id"))
    return lines.withColumn("_stop", stop).filter((F.col("timestamp") >= F.lit(after).cast("timestamp_ntz")) & (F.col("_stop").isNull() | (F.col(LINE) < F.col("_stop")))).drop("_stop")


def warning_tail(lines: DataFrame, k: int = 20) -> DataFrame:
    """The last k warnings of each file."""
    return topk_per_group(lines.filter("severity = 'W'"), FILE, [F.desc(LINE)], k).select("file_id", LINE, "timestamp", "component", "body")


def error_excerpts(errors: DataFrame, k: int = 10) -> DataFrame:
    return topk_per_group(errors, FILE, [LINE], k, "rank")


def distinct_snippets(errors: DataFrame, rows: int = 45, k: int = 5) -> DataFrame:
    """Of the first rows, the first of each signature of 80 characters (18 at least)."""
    own = topk_per_group(errors, FILE, [LINE], rows).withColumn("signature", F.substring(F.trim(R.normalize_error()), 1, 80)).filter(F.length("signature") >= 18)
    return topk_per_group(topk_per_group(own, ["file_id", "signature"], [LINE], 1), FILE, [LINE], k).select("file_id", LINE, "signature")


def representative_excerpts(errors: DataFrame, k: int = 5) -> DataFrame:
    """The first example of each of the k most frequent patterns."""
    g = errors.groupBy("file_id", R.normalize_error().alias("pattern")).agg(F.count("*").alias("n"), F.min(LINE).alias(LINE), F.min_by("text", LINE).alias("text"))
    return topk_per_group(g, FILE, [F.desc("n"), LINE], k, "rank")


def merge_evidence(sources: Sequence[DataFrame], cap: int = 30) -> DataFrame:
    """The union of evidence tables (file_id, line_number, text) in their order, without texts that begin alike, cap at most."""
    every = None
    for k, s in enumerate(sources):
        part = s.select("file_id", F.col(LINE), "text", F.lit(k).alias("source"))
        every = part if every is None else every.unionByName(part)
    once = topk_per_group(every.withColumn("_key", F.substring("text", 1, 240)), ["file_id", "_key"], ["source", LINE], 1).drop("_key")
    return topk_per_group(once, FILE, ["source", LINE], cap, "rank")


def issue_timeline(errors: DataFrame, files: DataFrame) -> DataFrame:
    """Where in its file an error stands, in percent."""
    return errors.join(files.select("file_id", "line_count"), "file_id").select("file_id", LINE, "timestamp", (100.0 * F.col(LINE) / F.col("line_count")).alias("position"))


def regex_search(lines: DataFrame, pattern: str, limit: int = 200, case: bool = False) -> DataFrame:
    """The first matches of each file in order; nothing for a pattern that the engine does not take."""
    whole = pattern if case else f"(?i){pattern}"
    try:
        # the engine that matches says whether the pattern is valid, on one empty row
        lines.sparkSession.sql("SELECT rlike('', :p)", args={"p": whole}).collect()
    except (PySparkException, Py4JError):
        return lines.limit(0)
    return topk_per_group(lines.filter(F.col("body").rlike(whole)), FILE, [LINE], limit)


def build_token_index(lines: DataFrame) -> DataFrame:
    """token, file_id, line_number and position: letters and digits, lower case, accents removed."""
    plain = F.regexp_replace(F.lower(F.col("body")), "[áàâäã]", "a")
    for accented, letter in (("éèêë", "e"), ("íìîï", "i"), ("óòôöõ", "o"), ("úùûü", "u"), ("ç", "c"), ("ñ", "n")):
        plain = F.translate(plain, accented, letter * len(accented))
    words = F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return lines.select("file_id", LINE, F.posexplode(words).alias("position", "token")).select("token", "file_id", LINE, "position")


def full_text(index: DataFrame, every: Sequence[str] = (), phrase: Sequence[str] = (), none: Sequence[str] = (), prefix: Sequence[str] = (), some: Sequence[str] = ()) -> DataFrame:
    """Lines with every term, the phrase, terms with the prefixes, one of some at least if there are any, and none of the others."""
    wanted = list(dict.fromkeys([*every, *phrase]))
    cond = F.col("token").isin([*wanted, *none, *some]) if wanted or none or some else F.lit(False)
    for p in prefix:
        cond = cond | F.col("token").startswith(p)
    has = lambda c: F.max(c.cast("int"))
    g = index.filter(cond).groupBy("file_id", LINE).agg(*[has(F.col("token") == t).alias(f"_w{k}") for k, t in enumerate(wanted)], *[has(F.col("token").startswith(p)).alias(f"_p{k}") for k, p in enumerate(prefix)], *[has(F.col("token") == t).alias(f"_n{k}") for k, t in enumerate(none)], has(F.col("token").isin(list(some)) if some else F.lit(True)).alias("_some")).filter("_some = 1")
    for k in range(len(wanted)):
        g = g.filter(F.col(f"_w{k}") == 1)
    for k in range(len(prefix)):
        g = g.filter(F.col(f"_p{k}") == 1)
    for k in range(len(none)):
        g = g.filter(F.col(f"_n{k}") == 0)
    out = g.select("file_id", LINE)
    if len(phrase) > 1:
        # the phrase's terms at places that follow each other: one group a line and starting place
        starts = index.filter(F.col("token").isin(list(phrase))).withColumn("k", F.explode(F.array(*[F.when(F.col("token") == t, F.lit(k)) for k, t in enumerate(phrase)]))).filter("k is not null")
        at = starts.groupBy("file_id", LINE, (F.col("position") - F.col("k")).alias("start")).agg(F.count_distinct("k").alias("n")).filter(F.col("n") == len(phrase))
        out = out.join(at.select("file_id", LINE).distinct(), ["file_id", LINE], "left_semi")
    return out


def search(lines: DataFrame, index: DataFrame, component: str | None = None, limit: int = 200, **terms) -> DataFrame:
    """Matching lines with their columns, in order."""
    own = lines if component is None else lines.filter(F.col("component") == component)
    return topk_per_group(own.join(full_text(index, **terms), ["file_id", LINE]), FILE, [LINE], limit)


def keyword_search(lines: DataFrame, words: Sequence[str], k: int = 8) -> DataFrame:
    """The first k distinct lines of each file with any of the words: few are looked for inside the JVM, many by one automaton."""
    if len(words) > FEW:
        hits = with_terms(lines, "body", words, "_terms").filter(F.size("_terms") > 0).drop("_terms")
    else:
        hits = lines.filter(reduce(or_, [F.contains(F.lower("body"), F.lit(w.lower())) for w in words], F.lit(False)))
    key = F.regexp_replace(F.regexp_replace("body", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", ""), r"\b[0-9a-fA-F]{8}\b", "")
    once = topk_per_group(hits.withColumn("_key", key), ["file_id", "_key"], [LINE], 1)
    return topk_per_group(once, FILE, [LINE], k, "rank").select("file_id", "rank", LINE, "body")


#: Up to so many words are looked for one by one.
FEW = 16


#: Rules in order: mode, intent and pattern.
QUESTION_RULES = (
    ("kb", "known_issue", r"known issue|knowledge base|documentation|how to (fix|resolve)"), ("local", "count_errors", r"how many (errors|warnings)"), ("local", "top_errors", r"(top|most (common|frequent)) errors?"), ("local", "latency", r"latency|slow|lag"),
    ("local", "bottleneck", r"bottleneck"), ("local", "batches", r"batch(es)?|bulk"), ("local", "tables", r"which tables?|tables? (with|that)"), ("local", "version", r"version|release"), ("local", "error_code", r"(ora-\d{5}|sqlstate)"), ("local", "time_range", r"when did|time range|start time|end time"), ("local", "health", r"health|status"),
)


def classify_questions(questions: DataFrame, col: str = "question", rules: Sequence[tuple[str, str, str]] = QUESTION_RULES) -> DataFrame:
    """mode and intent of each question, by the first rule that matches, and what its pattern found."""
    hit = F.coalesce(*[F.when(F.col(col).rlike(f"(?i){p}"), F.struct(F.lit(m).alias("mode"), F.lit(i).alias("intent"), F.regexp_extract(col, f"(?i)({p})", 1).alias("entity"))) for m, i, p in rules])
    none = F.struct(F.lit("general").alias("mode"), F.lit("unknown").alias("intent"), F.lit(None).cast("string").alias("entity"))
    return questions.withColumn("_hit", F.coalesce(hit, none)).select(*questions.columns, "_hit.mode", "_hit.intent", "_hit.entity")


def extract_keywords(questions: DataFrame, col: str = "question") -> DataFrame:
    """What a question asks for: quoted strings, else codes and technical terms, sorted."""
    quoted = F.regexp_extract_all(col, F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1))
    terms = F.regexp_extract_all(col, F.lit(r"(ORA-\d{5}|[A-Z][A-Z_]{3,}|\w+_\w+)"), F.lit(1))
    return questions.withColumn("keywords", F.array_sort(F.array_distinct(F.when(F.size(quoted) > 0, quoted).otherwise(terms))))


SECTIONS = {"latency": r"latency|slow|lag|delay", "errors": r"error|fail|warn|ora-", "batches": r"batch|bulk|apply", "tables": r"table", "redo": r"redo|archive", "full_load": r"full load|segment|reload", "config": r"config|setting|parameter", "files": r"file|upload|compress", "source": r"source|capture", "target": r"target", "timeline": r"when|time"}


def relevant_sections(questions: DataFrame, col: str = "question") -> DataFrame:
    """Sections that a question's words call for; the summary and errors if none does."""
    hit = F.array_compact(F.array(*[F.when(F.col(col).rlike(f"(?i){p}"), F.lit(s)) for s, p in SECTIONS.items()]))
    return questions.withColumn("sections", F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit("summary"), F.lit("errors"))))


def error_mentions(errors: DataFrame, codes: DataFrame) -> DataFrame:
    """How many errors have each code (a table with error_code), and the first."""
    return errors.join(codes.select("error_code").distinct(), "error_code").groupBy("file_id", "error_code").agg(F.count("*").alias("n"), F.min_by("text", LINE).alias("sample"))


def evidence_gap(counts: DataFrame, focus: bool = True, most: int = 30) -> DataFrame:
    """Whether a file's errors are too few or too many to go on, with reasons."""
    reasons = F.array_compact(F.array(F.when((F.col("errors") == 0) & F.lit(focus), F.lit("no errors")), F.when(F.col("errors") > most, F.lit("too many errors"))))
    return counts.withColumn("reasons", reasons).withColumn("insufficient", F.size("reasons") > 0)


def retrieval_query(errors: DataFrame) -> DataFrame:
    """A search text for each file: six codes and five snippets at most, 500 characters."""
    codes = topk_per_group(errors.filter("error_code is not null").groupBy("file_id", "error_code").agg(F.min(LINE).alias(LINE)), FILE, [LINE], 6).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(LINE, "error_code"))).alias("c"))
    bits = distinct_snippets(errors).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(LINE, F.substring("signature", 1, 120).alias("s")))).alias("s"))
    both = codes.join(bits, "file_id", "full_outer")
    return both.select("file_id", F.substring(F.concat_ws(" ", F.col("c.error_code"), F.col("s.s")), 1, 500).alias("query"))


def log_summary(lines: DataFrame) -> DataFrame:
    """One row a file: times, counts by severity, bulk operations, whether it ends with a stop."""
    ts = F.col("timestamp")
    sev = lambda s: F.count_if(F.col("severity") == s)
    last = F.max(LINE).over(W.partitionBy("file_id"))
    own = lines.withColumn("_tail", F.col(LINE) > last - 20)
    low = F.lower("body")
    return own.groupBy("file_id").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("lines"), sev("E").alias("errors"), sev("W").alias("warnings"), F.min(F.when(low.contains("fatal"), F.col(LINE))).alias("fatal_line"),
        F.count_if(low.contains("bulk finished")).alias("bulk_operations"), F.count_if(low.contains("bulk_map")).alias("bulk_maps"), F.max(F.col("_tail") & (low.contains("task stopped") | low.contains("closing log"))).alias("proper_close"),
    )


def totals(lines: DataFrame, errors: DataFrame) -> DataFrame:
    """Lines, components and errors of each file, and its health at 10 and 100 errors."""
    n = lines.groupBy("file_id").agg(F.count("*").alias("lines"), F.count_distinct("component").alias("components"))
    e = errors.groupBy("file_id").agg(F.count("*").alias("errors"))
    return n.join(e, "file_id", "left").fillna(0, ["errors"]).withColumn("health", F.when(F.col("errors") >= 100, "Critical").when(F.col("errors") >= 10, "Warning").otherwise("Healthy"))


def time_range(perf: DataFrame, errors: DataFrame) -> DataFrame:
    """First and last time from samples, else from errors."""
    span = lambda df, p: df.groupBy("file_id").agg(F.min("timestamp").alias(f"{p}0"), F.max("timestamp").alias(f"{p}1"))
    out = span(perf, "p").join(span(errors, "e"), "file_id", "full_outer").select("file_id", F.coalesce("p0", "e0").alias("first_ts"), F.coalesce("p1", "e1").alias("last_ts"))
    return out.withColumn("seconds", F.timestamp_diff("SECOND", F.col("first_ts"), F.col("last_ts")))


def preflight(lines: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Rows that each family of facts has for a file, and whether it needs a focus (none has any)."""
    out = lines.select("file_id").distinct()
    for name, df in facts.items():
        out = out.join(df.groupBy("file_id").agg(F.count("*").alias(name)), "file_id", "left")
    out = out.fillna(0, list(facts))
    none: Column = F.lit(True)
    for name in facts:
        none = none & (F.col(name) == 0)
    return out.withColumn("needs_focus", none)


def recent_files(files: DataFrame, k: int = 20, pinned: Sequence = ()) -> DataFrame:
    """The k newest files, and the pinned ones."""
    newest = files.orderBy(F.desc("upload_time"), "file_id").limit(k)
    return newest.unionByName(files.filter(F.col("file_id").isin(list(pinned)))).dropDuplicates(["file_id"])


def latest_errors(errors: DataFrame, k: int = 10) -> DataFrame:
    return topk_per_group(errors.filter("timestamp is not null"), FILE, [F.desc("timestamp"), F.desc(LINE)], k, "rank")


def filter_batches(b: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """Batches with one of the reasons; PK stands for any key conflict."""
    codes = [c for r in reasons for c in (("PKi", "PKu", "PKd") if r == "PK" else (r,))]
    return b.filter(F.col("closure_reason").isin(codes))


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """The first fact of each line, else of each label."""
    key = F.coalesce(F.col(LINE).cast("string"), F.col("label"))
    return topk_per_group(facts.withColumn("_key", key), ["file_id", "_key"], ["ord"], 1).drop("_key")


def empty_response_rate(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(F.count("*").alias("requests"), F.count_if(F.trim(F.coalesce("response", F.lit(""))) == "").alias("empties")).withColumn("rate", F.round(F.col("empties") / F.col("requests"), 4))

#: Symptoms of a log and what to search for, as name and pattern.
SYMPTOMS = {"deadlock": r"(?i)deadlock", "lock timeout": r"(?i)lock wait|resource busy", "connection lost": r"(?i)connection (lost|reset|closed)", "timeout": r"(?i)timeout", "memory limit": r"(?i)memory limit|out of memory", "disk space": r"(?i)no space|disk full", "permission denied": r"(?i)permission|privilege|access denied", "primary key": r"(?i)no PK|primary key", "duplicate key": r"(?i)duplicate|unique", "certificate": r"(?i)certificate|ssl|tls", "truncation": r"(?i)truncat"}


def kb_queries(errors: DataFrame, config: DataFrame, k: int = 12) -> DataFrame:
    """Search texts of each file in order: its codes, then symptoms with the vendor that the source's type names, then components."""
    codes = errors.filter("error_code is not null").select("file_id", F.lit(1).alias("priority"), F.col("error_code").alias("query"))
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in SYMPTOMS.items()]))
    vendor = config.select("file_id", "source_type")
    symptoms = errors.select("file_id", F.explode(hits).alias("s")).join(vendor, "file_id", "left").select("file_id", F.lit(2).alias("priority"), F.trim(F.concat_ws(" ", "source_type", "s")).alias("query"))
    parts = errors.filter("component is not null").select("file_id", F.lit(3).alias("priority"), F.concat("component", F.lit(" error")).alias("query"))
    counted = codes.unionByName(symptoms).unionByName(parts).groupBy("file_id", "priority", "query").agg(F.count("*").alias("n"))
    return topk_per_group(counted, FILE, ["priority", F.desc("n"), "query"], k, "rank")
