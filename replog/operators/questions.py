"""Questions about logs (I8, I9, A30): what a question is after, the words that it searches for, and the counts and lists that answer it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replog.plans.scale import topk_per_group, written

#: Patterns of questions that need articles, and those of each type with what they are about; the first that matches counts.
KB_PATTERNS = (r"\bwhat does\b.*\bmeans?\b", r"\bwhat is\b.*(error|code|message)", r"\b(ORA-|SQL|ODBC|ATT-)\d+", r"\bknown issue\b", r"\bdocumentation\b")
INTENTS = (
    ("INFO", r"\b(what|what's|tell me)\b.*\b(task|name)\b.*\b(name|task|called)\b", "task_name"),
    ("INFO", r"\btask\s*name\b", "task_name"),
    ("INFO", r"\bname of (the |this |)task\b", "task_name"),
    ("INFO", r"\b(what|which)\b.*\b(source|source endpoint)\b", "source"),
    ("INFO", r"\bsource (endpoint|type|database|db)\b", "source"),
    ("INFO", r"\b(what|which)\b.*\b(target|target endpoint|destination)\b", "target"),
    ("INFO", r"\btarget (endpoint|type|database|db)\b", "target"),
    ("INFO", r"\b(what|which)\b.*\b(version|replicate version)\b", "version"),
    ("INFO", r"\bversion (of |)(replicate|qlik|software)\b", "version"),
    ("INFO", r"\b(what|which)\b.*\b(server|host|machine)\b", "server"),
    ("INFO", r"\b(run|running|execution) mode\b", "run_mode"),
    ("INFO", r"\bstart mode\b", "start_mode"),
    ("INFO", r"\b(what|which)\b.*\b(mode|modes?)\b", "run_mode"),
    ("INFO", r"\bwhat os\b|\boperating system\b", "os_info"),
    ("INFO", r"\b(when|what time).*\b(start|begin|began)\b", "start_time"),
    ("INFO", r"\b(when|what time).*\b(end|finish|stop|complete)\b", "end_time"),
    ("INFO", r"\b(how long|duration|runtime)\b", "duration"),
    ("INFO", r"\b(full load|cdc|change data capture)\b.*(status|complete|done|running)", "replication_status"),
    ("COUNT", r"\b(how many|count|number of|total)\b.*\b(errors?|warnings?)\b", "errors"),
    ("COUNT", r"\b(how many|count|number of|total)\b.*\b(tables?)\b", "tables"),
    ("COUNT", r"\b(how many|count|number of|total)\b.*\b(batch|batches)\b", "batches"),
    ("COUNT", r"\b(how many|count|number of|total)\b.*\b(inserts?|updates?|deletes?|merges?)\b", "operations"),
    ("COUNT", r"\b(how many|count|number of|total)\b.*\b(records?|rows?|entries)\b", "records"),
    ("COUNT", r"\b(how many|count|number of|total)\b.*\b(lines?)\b", "lines"),
    ("COUNT", r"\berror count\b", "errors"),
    ("COUNT", r"\btable count\b", "tables"),
    ("LIST", r"\b(what|which|list|show|display|tell me)\b.*\b(tables?)\b", "tables"),
    ("LIST", r"\b(what|which|list|show|tell me|give me)\b.*\b(errors?)\b", "errors"),
    ("LIST", r"\berrors?\b.*(what|mean|in the log|found|occurred|happening)", "errors"),
    ("LIST", r"\bwhat.*errors?\b", "errors"),
    ("LIST", r"\b(what|which|list|show)\b.*\b(components?)\b", "components"),
    ("LIST", r"\b(list|show)\b.*\b(batch|batches)\b.*\b(closure|reasons?)\b", "batch_reasons"),
    ("LIST", r"\btables?\b.*(mentioned|appear|listed|replicated|in the log)", "tables"),
    ("LIST", r"\b(any|are there)\b.*\b(errors?|issues?|problems?)\b", "errors"),
    ("LIST", r"\btell me about\b.*(errors?|issues?)", "errors"),
    ("LIST", r"\bwhat (is|are) (the |)(issue|problem|error)", "errors"),
    ("STATS", r"\b(what|what's|show)\b.*\b(latency|latencies)\b", "latency"),
    ("STATS", r"\b(average|avg|mean|max|min|p95|p99)\b.*\b(latency)\b", "latency"),
    ("STATS", r"\b(performance|throughput)\b.*(stats?|metrics?|numbers?)", "performance"),
    ("STATS", r"\bbottleneck\b", "bottleneck"),
    ("STATS", r"\b(source|target|handling)\b.*\b(latency)\b", "latency"),
    ("STATS", r"\b(slow|fast|speed|performance)\b", "performance"),
    ("SEARCH", r"\b(what|which)\b.*\b(odbc|driver|drivers)\b", "odbc_drivers"),
    ("SEARCH", r"\b(license|licensed)\b", "license"),
    ("SEARCH", r"\bserver\b.*\b(name|info)\b", "server_info"),
    ("SEARCH", r"\b(anything|something|find|search|look for|show me|any mention)\b.*(about|for|regarding|related to|of|with)\b", "generic_search"),
    ("SEARCH", r"\b(is there|are there|can you find|do you see)\b.*(mention|reference|info|information)\b", "generic_search"),
    ("SEARCH", r"\bconnection string\b", "connection_string"),
    ("SEARCH", r"\b(what|where)\b.*(connection string|conn string)\b", "connection_string"),
    ("SEARCH", r"\bfind\b.*\b(in the log|in log)\b", "generic_search"),
    ("SEARCH", r"\bsearch (for |the log for |)", "generic_search"),
    ("TIME", r"\b(when|what time|start time|end time|first|last)\b", "timestamps"),
    ("TIME", r"\b(earliest|latest)\b.*\b(timestamp|time|entry)\b", "timestamps"),
    ("SUMMARY", r"\b(summarize|summary|overview)\b", "summary"),
    ("SUMMARY", r"\btell me about\b.*(the log|this log|log file)", "summary"),
    ("SUMMARY", r"\b(health|status)\b.*\b(check|report)\b", "health"),
    ("SUMMARY", r"\bwhat('s| is) (in |)(the |this |)log\b", "summary"),
    ("SUMMARY", r"\b(give me|show me) (a |)summary\b", "summary"),
    ("REPORT", r"\breport(s)?\b", "reports"),
    ("REPORT", r"\b(pdf|html)\b.*\breport\b", "reports"),
    ("REPORT", r"\b(cockpit|dashboard|insight)s?\b", "reports"),
    ("REPORT", r"\b(ai )?analysis\b", "reports"),
    ("TOP", r"\b(top|most (common|frequent)|biggest|highest)\b.*\berrors?\b", "top_errors"),
    ("TOP", r"\b(top|most (common|frequent)|worst)\b.*\btables?\b", "top_tables"),
    ("TOP", r"\bmost failing tables\b", "top_tables"),
    ("TOP", r"\bmost frequent errors\b", "top_errors"),
)
#: What stands before the words that a question searches for, the words that end it, and terms that stand for themselves.
SUBJECTS = (
    r"anything (?:about|on|regarding|related to|with) ['\"]?(.+?)['\"]?\??$",
    r"anything (?:about|on|regarding|related to|with) (.+?)(?:\?|$| in the)",
    r"find ['\"]?(.+?)['\"]? in (?:the |this )?log",
    r"search (?:for |the log for )['\"]?(.+?)['\"]?(?:\?|$)",
    r"is there (?:any |a )?(?:mention|reference|info|information) (?:of|about|on) ['\"]?(.+?)['\"]?\??$",
    r"(?:can you |do you |)(?:find|see|show) ['\"]?(.+?)['\"]? in (?:the |this )?log",
    r"look for ['\"]?(.+?)['\"]?(?:\?|$| in)",
    r"(?:any|some) (?:mention|info|information|reference) (?:of|about) ['\"]?(.+?)['\"]?\??$",
)
SUBJECT_END = r"\s+(in the log|in log|please|thanks)$"
QUOTED = r"[\"']([^\"']+)[\"']"
TERMS = r"\b(connection string|timeout|deadlock|error|warning|exception|failure|latency|bulk|batch|cdc|full load|endpoint|driver|odbc|sql|insert|update|delete|merge|table|schema)\b"


def classify(questions: DataFrame, col: str = "question") -> DataFrame:
    """mode, type and entity of each question. Codes in capitals are looked for in lower case, so that none is found: as the original has it."""
    low = F.lower(F.trim(col))
    named = lambda mode, kind, entity: F.struct(F.lit(mode).alias("mode"), F.lit(kind).alias("type"), F.lit(entity).cast("string").alias("entity"))
    kb = [F.when(low.rlike(p), named("kb", "KB_LOOKUP", None)) for p in KB_PATTERNS]
    local = [F.when(low.rlike(p), named("local", kind, entity)) for kind, p, entity in INTENTS]
    return questions.withColumn("_hit", F.coalesce(*kb, *local, named("kb", "GENERAL", None))).select(*questions.columns, "_hit.*")


def search_keywords(questions: DataFrame, col: str = "question") -> DataFrame:
    """keywords: what a question searches for (its subject as one phrase, of more than two characters), else what it quotes, else its technical terms, sorted."""
    low = F.lower(col)
    subject: list[Column] = []
    for p in SUBJECTS:
        phrase = F.regexp_replace(F.trim(F.regexp_extract(low, p, 1)), SUBJECT_END, "")
        subject.append(F.when(low.rlike(p) & (F.length(phrase) > 2), F.array(phrase)))
    quoted = F.regexp_extract_all(col, F.lit(QUOTED), F.lit(1))
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(TERMS), F.lit(1))))
    return questions.withColumn("keywords", F.coalesce(*subject, F.when(F.size(quoted) > 0, quoted), terms))


def answers(lines: DataFrame, errors: DataFrame, stats: DataFrame, batches: DataFrame) -> DataFrame:
    """What each file answers to questions that count, list or rank: (file_id, type, entity, place, label, value), place 0 with a total where there is one.

    Of tables the 20 with the longest apply times are listed, of errors the 10 newest, of components and closure reasons all; of the top there are five."""
    ops = F.col("total_inserts") + F.col("total_updates") + F.col("total_deletes") + F.col("total_merges")
    one = lambda df, kind, entity, label, value: df.select("file_id", F.lit(kind).alias("type"), F.lit(entity).alias("entity"), F.lit(0).alias("place"), F.lit(label).alias("label"), value.cast("long").alias("value"))
    total = lambda df: df.groupBy("file_id").agg(F.count("*").alias("n"))

    def listed(df: DataFrame, kind: str, entity: str, order: list, label: Column, value: Column, most: int | None) -> DataFrame:
        ranked = df.withColumn("place", F.row_number().over(W.partitionBy("file_id").orderBy(*order))) if most is None else topk_per_group(df, ["file_id"], order, most, "place")
        return ranked.select("file_id", F.lit(kind).alias("type"), F.lit(entity).alias("entity"), "place", label.alias("label"), value.cast("long").alias("value"))

    sums = stats.groupBy("file_id").agg(*[F.sum(f"total_{c}").alias(c) for c in ("inserts", "updates", "deletes", "merges")])
    made = sums.select("file_id", F.explode(F.array(*[F.struct(F.lit(k + 1).alias("place"), F.lit(c).alias("label"), F.col(c).alias("value")) for k, c in enumerate(("inserts", "updates", "deletes", "merges"))])).alias("o"))
    components = lines.filter("component is not null and thread_id is not null").groupBy("file_id", "component").agg(F.count("*").alias("n"))
    reasons = batches.groupBy("file_id", F.coalesce("closure_reason", F.lit("Unknown")).alias("reason")).agg(F.count("*").alias("n"))
    texts = errors.groupBy("file_id", "text").agg(F.count("*").alias("n"))
    longest = [F.desc_nulls_last("total_apply_time_seconds"), "table_name"]
    newest = [F.desc_nulls_last("timestamp"), F.desc("line_number")]
    parts = [
        one(total(errors), "COUNT", "errors", "errors", F.col("n")), one(total(stats), "COUNT", "tables", "tables", F.col("n")), one(total(batches), "COUNT", "batches", "batches", F.col("n")),
        one(lines.groupBy("file_id").agg((F.max("line_number") + 1).alias("n")), "COUNT", "lines", "lines", F.col("n")),
        one(sums, "COUNT", "operations", "operations", F.col("inserts") + F.col("updates") + F.col("deletes") + F.col("merges")),
        made.select("file_id", F.lit("COUNT").alias("type"), F.lit("operations").alias("entity"), "o.*"),
        one(total(stats), "LIST", "tables", "tables", F.col("n")), listed(stats, "LIST", "tables", longest, F.col("table_name"), ops, 20),
        one(total(errors), "LIST", "errors", "errors", F.col("n")), listed(errors, "LIST", "errors", newest, F.substring("text", 1, 100), F.col("line_number"), 10),
        one(total(components), "LIST", "components", "components", F.col("n")), listed(components, "LIST", "components", ["component"], F.col("component"), F.col("n"), None),
        one(total(batches), "LIST", "batch_reasons", "batches", F.col("n")), listed(reasons, "LIST", "batch_reasons", [F.desc("n"), "reason"], F.col("reason"), F.col("n"), None),
        listed(texts, "TOP", "top_errors", [F.desc("n"), "text"], F.substring("text", 1, 140), F.col("n"), 5),
        listed(stats, "TOP", "top_tables", [F.desc("error_count"), *longest], F.col("table_name"), ops, 5),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def answer(questions: DataFrame, facts: DataFrame, col: str = "question") -> DataFrame:
    """The rows of facts that answer each question (question_id, file_id, question); questions of other types, or about files that have nothing of it, have none.

    Equal questions are classified once: they are written, so that no filter on types goes below and classifies every row."""
    hits = classify(written(questions.select(F.col(col).alias("_asked")).distinct()), "_asked")
    wanted = hits.join(facts, ["type", "entity"]).select("_asked", F.col("file_id").alias("_file"), "type", "entity", "place", "label", "value")
    met = questions.join(wanted, (F.col(col) == F.col("_asked")) & (F.col("file_id") == F.col("_file")))
    return met.select("question_id", "file_id", "type", "entity", "place", "label", "value")
