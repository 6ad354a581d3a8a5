"""SQL for more of the registered queries, over the same common tables as their neighbours'."""

from __future__ import annotations

from collections.abc import Callable

from replog.functions import patterns as P
from replog.operators.issues import QUESTION_RULES
from replog.operators.parse import PROPERTIES


def more(base: str, loads: str, known: Callable[[str], str], rx: Callable, has: Callable, q: Callable, time: Callable) -> dict[str, str]:
    """Oracle SQL by name. base and loads are the common tables of the two kinds of lines, known gives a query's SQL without them, and the
    others put patterns into SQL."""
    order = "OVER (PARTITION BY file_id ORDER BY line_number)"
    upto = "OVER (PARTITION BY file_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def norm(c: str) -> str:
        for p in (r"(?i)LINE \d+", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?::\d+)?", r"st_\d+_\w+", r"(?i)(?:subtask|line)\s+#?\d+"):
            c = f"regexp_replace({c}, {q(p)}, '', 'g')"
        return f"substr(trim(regexp_replace({c}, '\\s+', ' ', 'g')), 1, 160)"

    def rules(rows: str, made: list[tuple[str, int, str, str]]) -> str:
        return " UNION ALL ".join(f"SELECT file_id, CAST({p} AS BIGINT) AS priority, {q(a)} AS area, {t if t.startswith('CAST') or '||' in t else q(t)} AS title FROM ({rows}) WHERE {c}" for c, p, a, t in made)

    source = r"'\s*\([\w.]+\.c:\d+\)\s*$'"
    key = rf"trim(regexp_replace(regexp_replace(body, '^\s*\d+:\s+\d{{4}}-\d{{2}}-\d{{2}}T[\d:]+\s*', ''), {source}, ''))"
    summary = rf"substr(coalesce(trim(regexp_replace({rx(chr(92) + '][EWT]:' + chr(92) + 's*(.+)$', 1, 'text')}, {source}, '')), text), 1, 200)"
    events = " UNION ALL ".join(
        f"SELECT file_id, '{k}' AS event_type FROM lines WHERE {c}"
        for k, c in (
            ("memory_warning", has(P.MEMORY_WARNING)), ("overflow", "contains(lower(body), 'overflow') AND starts_with(component, 'SORTER')"), ("target_disconnect", has(P.TARGET_DISCONNECT)),
            ("source_reconnect", has(P.SOURCE_RECONNECT)), ("network_error", has(P.NETWORK_ERROR)), ("resource_limit", has(P.RESOURCE_LIMIT)),
        )
    )
    told = lambda words: f"count(*) FILTER (WHERE regexp_matches(lower(text), '{words}'))"
    share = lambda c: f"100.0 * count(*) FILTER (WHERE {c}) / count(*)"
    done = "(SELECT * FROM timed WHERE start_timestamp IS NOT NULL AND end_timestamp IS NOT NULL)"
    base = f"""{base},
pe AS ({events}),
issue AS (SELECT file_id, CASE WHEN contains(lower(text), 'fatal') THEN 'fatal' WHEN severity = 'W' THEN 'warning' ELSE 'error' END AS kind, component, {summary} AS summary, count(*) AS occurrences, min(line_number) AS first_line, max(line_number) AS last_line FROM errors GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE kind WHEN 'fatal' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, occurrences DESC, first_line) AS rank FROM issue),
health AS (SELECT *, CASE WHEN overflows > 0 OR disconnects > 5 THEN 'critical' WHEN memory_warnings > 3 OR disconnects > 0 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT file_id, count(*) FILTER (WHERE event_type = 'memory_warning') AS memory_warnings, count(*) FILTER (WHERE event_type = 'overflow') AS overflows, count(*) FILTER (WHERE event_type = 'target_disconnect') AS disconnects, count(*) FILTER (WHERE event_type = 'source_reconnect') AS reconnects FROM pe GROUP BY file_id)),
side AS (SELECT file_id, count(*) AS errors, {told('network|socket|connection|timeout')} AS network, {told('lock|busy|blocked|contention')} AS contention, {told('memory|resource|limit')} AS resource FROM errors WHERE starts_with(component, 'SOURCE') GROUP BY file_id),
again AS (SELECT file_id, count(*) AS reconnects FROM pe WHERE event_type = 'source_reconnect' GROUP BY file_id),
origin AS (SELECT *, concat_ws(',', CASE WHEN contention > 0 THEN 'contention' END, CASE WHEN network > 0 THEN 'network' END, CASE WHEN reconnects > 3 THEN 'reconnects' END, CASE WHEN resource > 0 THEN 'resource' END) AS hints, CASE WHEN errors > 10 OR reconnects > 5 THEN 'critical' WHEN errors > 0 OR reconnects > 0 THEN 'warning' ELSE 'healthy' END AS status
  FROM (SELECT coalesce(side.file_id, again.file_id) AS file_id, coalesce(errors, 0) AS errors, coalesce(network, 0) AS network, coalesce(contention, 0) AS contention, coalesce(resource, 0) AS resource, coalesce(reconnects, 0) AS reconnects FROM side FULL JOIN again ON side.file_id = again.file_id)),
snippet AS (SELECT file_id, line_number, signature FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_number) AS r FROM (SELECT *, row_number() OVER (PARTITION BY file_id, signature ORDER BY line_number) AS k FROM (SELECT file_id, line_number, substr(trim({norm('text')}), 1, 80) AS signature FROM (SELECT *, row_number() {order} AS n FROM errors) WHERE n <= 45) WHERE length(signature) >= 18) WHERE k = 1) WHERE r <= 5),
stats AS ({known('table_stats')}),
pain AS (SELECT * FROM (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY pain_score DESC, table_name) AS rank, table_name, pain_score, total_apply_time_seconds, one_by_one_count FROM (SELECT *, coalesce(total_apply_time_seconds, 0.0) + 10 * coalesce(error_count, 0) + 5 * coalesce(one_by_one_count, 0) AS pain_score FROM stats)) WHERE rank <= 10),
acts AS (SELECT file_id, line_number, timestamp, CASE WHEN {has(P.START_APPLYING)} THEN 'start' WHEN {has(P.FINISHED_APPLYING)} THEN 'finish' WHEN {has(P.RUN_STATEMENT)} THEN 'run' END AS kind, upper(coalesce({rx(P.START_APPLYING, 1)}, {rx(P.FINISHED_APPLYING, 2)}, {rx(P.RUN_STATEMENT, 1)})) AS op,
  CASE WHEN {has(P.START_APPLYING)} THEN {rx(P.START_APPLYING, 3)} || '.' || {rx(P.START_APPLYING, 4)} END AS tab, CAST({rx(P.RUN_STATEMENT, 2)} AS BIGINT) AS from_seq, CAST({rx(P.RUN_STATEMENT, 3)} AS BIGINT) AS to_seq FROM lines WHERE component = 'TARGET_APPLY'),
near AS (SELECT *, first_value(CASE WHEN kind = 'start' THEN {{'t': tab, 'o': op}} END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_number RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) AS c FROM acts WHERE kind IS NOT NULL),
context AS (SELECT file_id, line_number, op, from_seq, to_seq, to_seq - from_seq + 1 AS rows, c.t AS table_name, c.o AS context_op FROM near WHERE kind = 'run'),
record0 AS (SELECT *, lead(timestamp) {order} AS ended, {rx(P.TABLE)} || '.' || {rx(P.TABLE, 2)} AS table_name FROM lines WHERE component = 'TARGET_APPLY'),
record AS (SELECT file_id, line_number, timestamp AS start, CAST(epoch(ended) - epoch(timestamp) AS DOUBLE) AS duration_seconds, CAST(epoch(timestamp) - epoch(lag(ended) {order}) AS DOUBLE) AS gap_seconds, upper({rx(P.RUN_STATEMENT)}) AS verb, CAST({rx(P.RUN_STATEMENT, 2)} AS BIGINT) AS from_seq, CAST({rx(P.RUN_STATEMENT, 3)} AS BIGINT) AS to_seq, CAST({rx(P.RUN_STATEMENT, 3)} AS BIGINT) - CAST({rx(P.RUN_STATEMENT, 2)} AS BIGINT) + 1 AS rows, table_name FROM record0 WHERE {has(P.RUN_STATEMENT)}),
own0 AS (SELECT *, ends AND NOT coalesce(lag(ends) {order}, FALSE) AS stops FROM ap WHERE starts OR ends OR reason IS NOT NULL OR changes IS NOT NULL OR tab IS NOT NULL),
own1 AS (SELECT *, coalesce(sum(CASE WHEN stops THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM own0),
script0 AS (SELECT file_id, max(line_number) FILTER (WHERE stops) AS line_number, arg_max(timestamp, line_number) FILTER (WHERE stops) AS end_timestamp, CAST(coalesce(sum(changes), 0) AS BIGINT) AS changes_count, count(changes) AS applies_count, coalesce(arg_max(CASE WHEN reason = 'Normal' THEN '!!!' ELSE reason END, line_number) FILTER (WHERE reason IS NOT NULL), '!!!') AS closure_reason FROM own1 GROUP BY file_id, part),
script AS (SELECT *, CAST(epoch(end_timestamp) - epoch(lag(end_timestamp) {order}) AS DOUBLE) AS duration_seconds FROM script0 WHERE line_number IS NOT NULL)
"""
    out = {
        "collapse_noise": f", k AS (SELECT *, {key} AS message_key FROM lines), n AS (SELECT *, CASE WHEN message_key IS NOT DISTINCT FROM lag(message_key) {order} AND row_number() {order} > 1 THEN 0 ELSE 1 END AS new FROM k), r AS (SELECT *, sum(new) {upto} AS run FROM n), z AS (SELECT *, row_number() OVER (PARTITION BY file_id, run ORDER BY line_number) AS i, count(*) OVER (PARTITION BY file_id, run) AS c FROM r) SELECT file_id, line_number, message_key, CAST(CASE WHEN c >= 3 AND i = 1 THEN c - 2 ELSE 0 END AS BIGINT) AS hidden FROM z WHERE c < 3 OR i = 1 OR i = c",
        "issues": "SELECT * FROM ranked",
        "issue_summary": 'SELECT file_id, CAST(sum(occurrences) AS BIGINT) AS total, count(*) AS "unique", ' + ", ".join(f"CAST(coalesce(sum(occurrences) FILTER (WHERE kind = '{k}'), 0) AS BIGINT) AS {k}" for k in ("fatal", "error", "warning")) + " FROM ranked GROUP BY file_id",
        "issues_with_context": "SELECT ranked.*, (SELECT count(*) FROM lines l WHERE l.file_id = ranked.file_id AND l.line_number BETWEEN greatest(0, first_line - 2) AND first_line + 2) AS context FROM ranked",
        "error_aggregates": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY occurrences DESC, pattern) AS rank FROM (SELECT file_id, {norm('text')} AS pattern, count(*) AS occurrences, min(line_number) FILTER (WHERE line_number > 0) AS first_line, max(line_number) FILTER (WHERE line_number > 0) AS last_line FROM errors GROUP BY file_id, 2)) WHERE rank <= 10",
        "representative_excerpts": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, line_number) AS rank FROM (SELECT file_id, {norm('text')} AS pattern, count(*) AS n, min(line_number) AS line_number, arg_min(text, line_number) AS text FROM errors GROUP BY file_id, 2)) WHERE rank <= 5",
        "distinct_snippets": "SELECT * FROM snippet",
        "pipeline_health": "SELECT * FROM health",
        "source_health": "SELECT * FROM origin",
        "redo_session_stats": f"SELECT file_id, min(d) AS min, max(d) AS max, round(avg(d), 6) AS avg, count(*) AS n, max(CASE WHEN k = floor(c * 0.95) THEN d END) AS p95 FROM (SELECT file_id, duration_seconds AS d, row_number() OVER (PARTITION BY file_id ORDER BY duration_seconds) - 1 AS k, count(*) OVER (PARTITION BY file_id) AS c FROM ({known('redo_sessions')}) WHERE duration_seconds IS NOT NULL) GROUP BY file_id",
        "longest_redo_sessions": f"SELECT *, regexp_extract(redo_path, '([^/\\\\]+)$', 1) AS path_tail FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY duration_seconds DESC NULLS LAST, line_open) AS rank FROM ({known('redo_sessions')})) WHERE rank <= 5",
        "bulk_map_stats": f"SELECT file_id, table_name, count(*) AS operations, round({share('rows = 1')}, 6) AS single_percent, round(avg(rows), 6) AS avg_rows, max(rows) AS max_rows, round(avg(gap_seconds), 6) AS avg_gap FROM ({known('bulk_map_gaps')}) GROUP BY GROUPING SETS ((file_id, table_name), (file_id))",
        "pain_tables": "SELECT * FROM pain",
        "merge_breakdown": "SELECT *, CASE WHEN merges + standard > 0 THEN round(100.0 * merges / (merges + standard), 6) ELSE 0.0 END AS merge_percent FROM (SELECT file_id, table_name, CAST(sum(total_merges) AS BIGINT) AS merges, CAST(sum(total_inserts + total_updates + total_deletes) AS BIGINT) AS standard FROM stats GROUP BY GROUPING SETS ((file_id, table_name), (file_id)))",
        "unified_tables": "SELECT coalesce(s.file_id, m.file_id) AS file_id, coalesce(s.table_name, m.table_name) AS table_name, coalesce(a, 0) AS apply_operations, coalesce(o, 0) AS map_operations, CAST(coalesce(r, 0) AS BIGINT) AS map_rows FROM (SELECT file_id, table_name, total_inserts + total_updates + total_deletes + total_merges AS a FROM stats) s FULL JOIN (SELECT file_id, table_name, count(*) AS o, sum(rows) AS r FROM maps GROUP BY ALL) m ON s.file_id = m.file_id AND s.table_name = m.table_name",
        "keyword_search": r"SELECT file_id, rank, line_number, body FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_number) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id, regexp_replace(regexp_replace(body, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}', '', 'g'), '\b[0-9a-fA-F]{8}\b', '', 'g') ORDER BY line_number) AS k FROM lines WHERE contains(lower(body), 'busy') OR contains(lower(body), 'memory')) WHERE k = 1) WHERE rank <= 8",
        "preflight": f"SELECT f.file_id, coalesce(p.n, 0) AS performance, coalesce(e.n, 0) AS errors, coalesce(b.n, 0) AS batches, coalesce(p.n, 0) = 0 AND coalesce(e.n, 0) = 0 AND coalesce(b.n, 0) = 0 AS needs_focus FROM (SELECT DISTINCT file_id FROM lines) f LEFT JOIN (SELECT file_id, count(*) AS n FROM perf GROUP BY 1) p ON f.file_id = p.file_id LEFT JOIN (SELECT file_id, count(*) AS n FROM errors GROUP BY 1) e ON f.file_id = e.file_id LEFT JOIN (SELECT file_id, count(*) AS n FROM {done} GROUP BY 1) b ON f.file_id = b.file_id",
        "retrieval_query": f"SELECT coalesce(c.file_id, s.file_id) AS file_id, substr(concat_ws(' ', c, s), 1, 500) AS query FROM (SELECT file_id, string_agg(error_code, ' ' ORDER BY line_number, error_code) AS c FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_number) AS r FROM (SELECT file_id, error_code, min(line_number) AS line_number FROM errors WHERE error_code IS NOT NULL GROUP BY ALL)) WHERE r <= 6 GROUP BY file_id) c FULL JOIN (SELECT file_id, string_agg(substr(signature, 1, 120), ' ' ORDER BY line_number) AS s FROM snippet GROUP BY file_id) s ON c.file_id = s.file_id",
        "error_edges": f", word AS (SELECT DISTINCT file_id, line_number, unnest(regexp_split_to_array(lower(text), '[^\\w]+')) AS word FROM errors), tab AS (SELECT file_id, line_number AS b, lower(regexp_extract(unnest(tabs), '([^.]+)$', 1)) AS word FROM {done}), edge AS (SELECT file_id, 'in_component' AS edge_type, 1.0 AS w, 'EXTRACTED' AS provenance FROM errors WHERE component IS NOT NULL UNION ALL SELECT file_id, 'on_thread', 0.5, 'EXTRACTED' FROM errors WHERE thread_id IS NOT NULL UNION ALL SELECT file_id, 'has_code', 1.5, 'EXTRACTED' FROM errors WHERE error_code IS NOT NULL UNION ALL SELECT file_id, 'same_batch', 0.8, 'EXTRACTED' FROM (SELECT DISTINCT w.file_id, w.line_number, b FROM word w JOIN tab t ON w.file_id = t.file_id AND w.word = t.word WHERE t.word <> '') UNION ALL SELECT file_id, 'co_occurs', weight, 'INFERRED' FROM ({known('cooccurring_errors')})) SELECT file_id, edge_type, provenance, count(*) AS n, round(CAST(sum(w) AS DOUBLE), 6) AS weight FROM edge GROUP BY ALL",
        "sorter_metrics": " UNION ALL ".join(f"SELECT file_id, line_number, {time('timestamp')}, '{k}' AS metric, {f'coalesce({rx(p)}, {rx(p, 2)})' if k == 'queue_depth' else rx(p)} AS value FROM lines WHERE {has(p)}" for k, p in P.SORTER.items()),
        "error_codes_all": "SELECT file_id, code, count(*) AS n FROM (SELECT file_id, unnest(list_distinct(list_transform(flatten([" + ", ".join(f"regexp_extract_all(body, {q(p)}, 1)" for p in (P.ORA, r"(?i)(SQLSTATE[:\s]+\w+)", r"(?i)(NativeError:\s*\d+)", r"(?i)(MySQL.*?Error\s+\d{4})", r"(?i)(RetCode:\s*SQL_\w+)", r"(?i)(SQL\d{4,5}[A-Z]?)")) + "]), lambda x: upper(x)))) AS code FROM lines) GROUP BY ALL",
        "prompt_error_tokens": r'''SELECT file_id, line_number, "at", token, rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_number, "at") AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id, lower(token) ORDER BY line_number, "at") AS k FROM (SELECT file_id, line_number, "at", substr(trim(t), 1, 120) AS token FROM (SELECT file_id, line_number, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS "at" FROM (SELECT *, regexp_extract_all(body, '(RECOB-\d+|ORA-\d+|SQLSTATE[ :=]*\w+|SQL\d+\w*|ERR[-_ ]?\d+|0x[0-9A-Fa-f]+)', 1) AS l FROM lines))) WHERE length(token) >= 5) WHERE k = 1) WHERE rank <= 14''',
        "task_config": "SELECT file_id, " + ", ".join(f"arg_max(CAST({rx(p, k)} AS BIGINT), CASE WHEN {rx(p, k)} IS NOT NULL THEN line_number END) AS {n}" for n, p, k in (("bulk_timeout_ms", P.BULK_TIMEOUT, 1), ("bulk_timeout_min_ms", P.BULK_TIMEOUT_MIN, 1), ("bulk_max_file_size_kb", P.BULK_FILE_SIZE, 2), ("parallel_apply_threads", P.PARALLEL_APPLY, 1))) + ", " + ", ".join(f"arg_max({rx(p)}, CASE WHEN {rx(p)} IS NOT NULL THEN line_number END) AS {n}" for n, p in (("source_type", P.SOURCE_ENDPOINT), ("target_type", P.TARGET_ENDPOINT))) + f", bool_or({has(P.MERGE)}) AS merge_enabled FROM lines WHERE regexp_matches(body, '(?i)bulk|endpoint ''|merge') GROUP BY file_id",
        "task_properties": "SELECT file_id, " + ", ".join(f"arg_max({rx(p)}, CASE WHEN {rx(p)} IS NOT NULL THEN line_number END) AS {n}" for n, p in PROPERTIES.items()) + f", coalesce(string_agg(l, ',' ORDER BY l), '') AS levels FROM (SELECT *, {rx('(?i)(' + chr(92) + 'w+ (?:log|logging) level (?:is )?(?:set|changed)[^.]*)')} AS l FROM lines WHERE line_number <= 1000) GROUP BY file_id",
        "merge_evidence": "SELECT file_id, line_number, text, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY source, line_number) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id, substr(text, 1, 240) ORDER BY source, line_number) AS k FROM (SELECT file_id, line_number, body AS text, CAST(0 AS BIGINT) AS source FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_number DESC) AS r FROM lines WHERE severity = 'W') WHERE r <= 20 UNION ALL SELECT file_id, line_number, text, 1 FROM errors)) WHERE k = 1) WHERE rank <= 30",
        "error_mentions": "SELECT file_id, error_code, count(*) AS n, arg_min(text, line_number) AS sample FROM errors WHERE error_code IS NOT NULL GROUP BY ALL",
        "apply_context": "SELECT * FROM context",
        "per_table_changes": "SELECT file_id, table_name, " + ", ".join(f"CAST(coalesce(sum(rows) FILTER (WHERE context_op = '{v}'), 0) AS BIGINT) AS \"{v.lower()}\"" for v in ("INSERT", "UPDATE", "DELETE", "MERGE")) + ", CAST(sum(rows) AS BIGINT) AS total FROM context WHERE table_name IS NOT NULL GROUP BY ALL",
        "apply_records": "SELECT * REPLACE (strftime(start, '%Y-%m-%d %H:%M:%S') AS start) FROM record",
        "script_table_totals": "SELECT file_id, table_name, " + ", ".join(f"CAST(coalesce(sum(rows) FILTER (WHERE verb = '{v}'), 0) AS BIGINT) AS \"{v.lower()}\"" for v in ("INSERT", "UPDATE", "DELETE")) + f", sum(duration_seconds) AS seconds, round(sum(duration_seconds) / nullif(sum(rows), 0), 6) AS seconds_a_row, {time('min(start) FILTER (WHERE rows >= 40)', 'first_high')}, {time('max(start) FILTER (WHERE rows >= 40)', 'last_high')} FROM record GROUP BY file_id, table_name",
        "script_batches": "SELECT * REPLACE (strftime(end_timestamp, '%Y-%m-%d %H:%M:%S') AS end_timestamp) FROM script",
        "script_summary": "SELECT file_id, count(*) AS batches, max(changes_count) AS largest, max(duration_seconds) AS longest, count(*) FILTER (WHERE changes_count = 1) AS singles, CAST(sum(changes_count) AS BIGINT) AS changes, round(sum(changes_count) / nullif(sum(duration_seconds), 0), 6) AS changes_a_second, -(max({'c': changes_count, 'l': -line_number})).l AS largest_line FROM script GROUP BY file_id",
        "summary_facts": f"SELECT m.*, round(target - source, 6) AS delta, CASE WHEN source > 0 THEN round(100 * (target - source) / source, 6) END AS delta_percent, coalesce(b.n, 0) AS batches, CAST(coalesce(b.c, 0) AS BIGINT) AS changes, coalesce(e.n, 0) AS errors FROM (SELECT file_id, max(p50) FILTER (WHERE kind = 'source') AS source, max(p50) FILTER (WHERE kind = 'target') AS target, max(p50) FILTER (WHERE kind = 'handling') AS handling FROM ({known('latency_profile')}) GROUP BY file_id) m LEFT JOIN (SELECT file_id, count(*) AS n, sum(changes_count) AS c FROM {done} GROUP BY 1) b ON m.file_id = b.file_id LEFT JOIN (SELECT file_id, count(*) AS n FROM errors GROUP BY 1) e ON m.file_id = e.file_id",
        "batch_inefficiencies": rules(f"SELECT file_id, {share('changes_count = 1')} AS single, {share(chr(99) + 'losure_reason IN (' + chr(39) + 'PKi' + chr(39) + ',' + chr(39) + 'PKu' + chr(39) + ',' + chr(39) + 'PKd' + chr(39) + ')')} AS pk, {share('closure_reason IN (' + q('TIM') + ', ' + q('TMO') + ')')} AS timeouts FROM {done} GROUP BY file_id", [("single > 40", 1, "batches", "single-record batches prevail"), ("single BETWEEN 20.000001 AND 40", 2, "batches", "many single-record batches"), ("pk > 10", 1, "batches", "key conflicts close batches"), ("timeouts > 30", 2, "batches", "timeouts close batches")]),
        "bulk_map_insights": rules(f"SELECT file_id, {share('rows = 1')} AS single, avg(rows) AS mean, stddev_pop(rows) AS dev FROM maps GROUP BY file_id", [("single > 20", 1, "bulk", "single-record operations"), ("mean < 10", 2, "bulk", "small operations"), ("dev > mean", 3, "bulk", "uneven operations")]),
        "bulk_apply_insights": rules(f"SELECT file_id, avg(changes_count) AS mean, corr(changes_count, duration_seconds) AS grows, {share('closure_reason = ' + q('MEM'))} AS memory, {share('closure_reason IN (' + q('TIM') + ', ' + q('TMO') + ')')} AS timeouts, {share('starts_with(closure_reason, ' + q('PK') + ')')} AS pk FROM {done} GROUP BY file_id", [("abs(grows) < 0.2", 2, "bulk", "latency dominates over size"), ("mean < 100", 2, "bulk", "small batches"), ("memory > 10", 1, "bulk", "memory closes batches"), ("timeouts > 20", 2, "bulk", "timeouts close batches"), ("pk > 0", 1, "bulk", "key conflicts close batches")]) + " UNION ALL SELECT file_id, CAST(1 AS BIGINT), 'bulk', 'tables are applied one by one' FROM stats GROUP BY file_id HAVING sum(one_by_one_count) > 0",
    }
    walk = "hit AS (SELECT file_id, line_number, row_number() OVER (PARTITION BY file_id ORDER BY line_number) AS k FROM (SELECT DISTINCT file_id, line_number FROM errors)), walk AS (SELECT file_id, k, line_number, line_number - 3 AS start, line_number + 3 AS e FROM hit WHERE k = 1 UNION ALL SELECT h.file_id, h.k, h.line_number, CASE WHEN h.line_number - 3 <= w.e + 1 THEN w.start ELSE h.line_number - 3 END, CASE WHEN h.line_number - 3 <= w.e + 1 THEN least(greatest(w.e, h.line_number + 3), w.start + 20) ELSE h.line_number + 3 END FROM walk w JOIN hit h ON h.file_id = w.file_id AND h.k = w.k + 1)"
    out["merge_windows"] = f', {walk} SELECT file_id, start, max(e) AS "end", count(*) AS hits FROM walk GROUP BY file_id, start'
    pieces = f"(SELECT file_id, count(*) AS lines FROM lines GROUP BY 1) l LEFT JOIN ({known('bottleneck')}) b ON l.file_id = b.file_id LEFT JOIN (SELECT file_id, count(*) AS n FROM ({known('spikes')}) GROUP BY 1) s ON l.file_id = s.file_id LEFT JOIN (SELECT file_id, count(*) AS n, sum(changes_count) AS c FROM {done} GROUP BY 1) t ON l.file_id = t.file_id LEFT JOIN (SELECT file_id, sum(one_by_one_count) AS o, count(*) AS n FROM stats GROUP BY 1) a ON l.file_id = a.file_id LEFT JOIN (SELECT file_id, count(*) AS n FROM errors GROUP BY 1) e ON l.file_id = e.file_id LEFT JOIN health h ON l.file_id = h.file_id LEFT JOIN origin o ON l.file_id = o.file_id"
    cockpit = f"SELECT l.file_id, lines, bottleneck, source_share, coalesce(s.n, 0) AS spikes, coalesce(t.n, 0) AS batches, CAST(coalesce(t.c, 0) AS BIGINT) AS changes, CAST(coalesce(a.o, 0) AS BIGINT) AS one_by_one, coalesce(a.n, 0) AS tables, coalesce(e.n, 0) AS errors, h.status AS pipeline_status, o.status AS source_status FROM {pieces}"
    out["cockpit"] = cockpit
    out["recommendations"] = rules(cockpit, [("bottleneck = 'source'", 1, "latency", "the source is the bottleneck"), ("bottleneck = 'handling'", 1, "latency", "handling is the bottleneck"), ("spikes > 5", 2, "latency", "CAST(spikes AS VARCHAR) || ' latency spikes'"), ("one_by_one > 10", 1, "apply", "many switches to one-by-one"), ("pipeline_status = 'critical'", 1, "pipeline", "the pipeline is in a critical state"), ("pipeline_status = 'warning'", 2, "pipeline", "the pipeline shows warnings"), ("source_status = 'critical'", 1, "source", "the source is in a critical state"), ("errors > 100", 1, "errors", "CAST(errors AS VARCHAR) || ' errors'")])
    low = "lower(body)"
    out["log_summary"] = f"SELECT file_id, {time('min(timestamp)', 'first_ts')}, {time('max(timestamp)', 'last_ts')}, count(*) AS lines, count(*) FILTER (WHERE severity = 'E') AS errors, count(*) FILTER (WHERE severity = 'W') AS warnings, min(line_number) FILTER (WHERE contains({low}, 'fatal')) AS fatal_line, count(*) FILTER (WHERE contains({low}, 'bulk finished')) AS bulk_operations, count(*) FILTER (WHERE contains({low}, 'bulk_map')) AS bulk_maps, bool_or(line_number > last - 20 AND (contains({low}, 'task stopped') OR contains({low}, 'closing log'))) AS proper_close FROM (SELECT *, max(line_number) OVER (PARTITION BY file_id) AS last FROM lines) GROUP BY file_id"
    found = {name: f"{base} {sql}" for name, sql in out.items()}
    found["merge_windows"] = found["merge_windows"].replace("WITH raw", "WITH RECURSIVE raw", 1)

    kind = "CASE " + " ".join(f"WHEN {has(p)} THEN '{k}'" for k, (p, _) in P.FULL_LOAD.items()) + " END"

    def field(name: str, cast: str) -> str:
        return "CAST(coalesce(" + ", ".join(f"CASE WHEN kind = '{k}' THEN {rx(p, names.index(name) + 1)} END" for k, (p, names) in P.FULL_LOAD.items() if name in names) + f", NULL) AS {cast}) AS {name}_"

    fields = ", ".join([field(n, "VARCHAR") for n in ("schema", "table", "predicate", "task", "mode")] + [field(n, "BIGINT") for n in ("table_id", "subtask", "seg", "seg_total", "rows", "skipped", "volume")])
    within = lambda kinds: "kind IN (" + ", ".join(map(q, kinds.split())) + ")"
    loads = f"""{loads},
fl AS (SELECT file_id, line_number, timestamp, thread_id, kind, {fields} FROM (SELECT *, {kind} AS kind FROM lines) WHERE kind IS NOT NULL),
tried AS (SELECT *, CAST(1 + sum(CASE WHEN kind = 'reload' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, table_id_ ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS attempt0 FROM fl WHERE table_id_ IS NOT NULL),
put AS (SELECT *, coalesce(last_value(CASE WHEN starts_with(kind, 'start_') THEN attempt0 END IGNORE NULLS) OVER (PARTITION BY file_id, table_id_, coalesce(seg_, 0) ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), attempt0) AS attempt FROM tried WHERE regexp_matches(kind, 'start_|unload_|load_|task_')),
seg0 AS (SELECT file_id, table_id_ AS table_id, attempt, coalesce(seg_, 0) AS seg, max(concat_ws('.', schema_, table_)) AS table_name, max(seg_total_) AS seg_total, min(timestamp) FILTER (WHERE {within('start_segment start_table')}) AS started, max(timestamp) FILTER (WHERE {within('unload_segment unload_table')}) AS unloaded, max(timestamp) FILTER (WHERE {within('load_segment load_table task_segment task_table')}) AS loaded,
  max(rows_) FILTER (WHERE {within('unload_segment unload_table')}) AS rows_sent, max(rows_) FILTER (WHERE {within('load_segment load_table')}) AS rows_received, max(skipped_) AS rows_skipped, max(volume_) AS volume, min(line_number) AS first_line, (arg_min({{'s': subtask_}}, line_number)).s AS subtask FROM put GROUP BY file_id, table_id_, attempt, coalesce(seg_, 0)),
segs AS (SELECT *, CAST(epoch(unloaded) - epoch(started) AS DOUBLE) AS unload_seconds, CAST(epoch(loaded) - epoch(unloaded) AS DOUBLE) AS gap_seconds, CAST(epoch(loaded) - epoch(started) AS DOUBLE) AS total_seconds, CASE WHEN loaded IS NOT NULL THEN 'loaded' WHEN unloaded IS NOT NULL THEN 'unloaded' WHEN started IS NOT NULL THEN 'loading' ELSE 'unknown' END AS status FROM seg0),
cur AS (SELECT file_id, table_id, max(table_name) AS table_name, count(*) AS segments, count(*) FILTER (WHERE status = 'loaded') AS loaded_segments, max(seg_total) AS segment_count, CAST(sum(rows_sent) AS BIGINT) AS rows_sent, CAST(sum(rows_received) AS BIGINT) AS rows_received, CAST(sum(rows_skipped) AS BIGINT) AS rows_skipped, CAST(sum(volume) AS BIGINT) AS volume, min(started) AS started, max(loaded) AS loaded, max(gap_seconds) AS max_gap_seconds FROM (SELECT *, max(attempt) OVER (PARTITION BY file_id, table_id) AS last FROM segs) WHERE attempt = last GROUP BY file_id, table_id),
tabs AS (SELECT r.file_id, r.table_id, reload_count, attempt_count, cur.* EXCLUDE (file_id, table_id), CASE WHEN loaded_segments >= greatest(coalesce(segment_count, 0), segments) THEN 'loaded' WHEN reload_count > 0 THEN 'reloading' ELSE 'loading' END AS status FROM (SELECT file_id, table_id_ AS table_id, count(*) FILTER (WHERE kind = 'reload') AS reload_count, max(attempt0) AS attempt_count FROM tried GROUP BY ALL) r LEFT JOIN cur ON r.file_id = cur.file_id AND r.table_id = cur.table_id),
fo AS (SELECT *, CASE WHEN {has(P.COMPRESS_START)} THEN 'start' WHEN {has(P.UPLOADED)} THEN 'uploaded' WHEN {has(P.COMPRESSED)} THEN 'compressed' END AS kind, upper({rx(P.CSV_NAME)}) AS csv, CAST({rx(P.UPLOADED, 2)} AS BIGINT) AS size_bytes FROM lines),
fn AS (SELECT *, coalesce(csv, last_value(CASE WHEN kind = 'start' THEN csv END IGNORE NULLS) {upto}) AS name FROM fo WHERE kind IS NOT NULL),
fi AS (SELECT *, coalesce(sum(CASE WHEN kind = 'uploaded' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, name ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM fn WHERE name IS NOT NULL),
fg AS (SELECT file_id, name, part, max(line_number) FILTER (WHERE kind = 'uploaded') AS line_number, epoch(arg_min(timestamp, line_number) FILTER (WHERE kind = 'start')) AS s, epoch(arg_min(timestamp, line_number) FILTER (WHERE kind = 'compressed')) AS c, epoch(arg_min(timestamp, line_number) FILTER (WHERE kind = 'uploaded')) AS u, max(size_bytes) AS size_bytes FROM fi GROUP BY file_id, name, part),
ups AS (SELECT file_id, line_number, name AS file_name, size_bytes, round(coalesce(c - s, 0.1 * coalesce(u - s, 0.0)), 6) AS compress_seconds, round(coalesce(u - s, 0.0) - coalesce(c - s, 0.1 * coalesce(u - s, 0.0)), 6) AS upload_seconds, coalesce(u - s, 0.0) AS total_seconds, CASE WHEN u - s > 0 THEN round(size_bytes / 1024.0 / (u - s), 6) END AS throughput_kbps FROM fg WHERE line_number IS NOT NULL)
"""
    dated = "* REPLACE (" + ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in ("started", "loaded")) + ")"
    sums = f"SELECT file_id, count(*) AS n, max(size_bytes) / min(size_bytes) AS sizes, max(total_seconds) / min(total_seconds) AS times, {share('size_bytes < 10240')} AS small, min(total_seconds) AS least, avg(throughput_kbps) AS mean, stddev_pop(throughput_kbps) AS dev FROM ups WHERE total_seconds > 0 AND size_bytes > 0 GROUP BY file_id"
    out = {
        "full_load_segments": f"SELECT {dated.replace('REPLACE (', 'REPLACE (strftime(unloaded, ' + q('%Y-%m-%d %H:%M:%S') + ') AS unloaded, ')} FROM segs",
        "full_load_tables": f"SELECT {dated} FROM tabs",
        "full_load_condensed": f"SELECT * FROM (SELECT {dated}, row_number() OVER (PARTITION BY file_id ORDER BY table_id) AS rank FROM tabs) WHERE rank <= 15",
        "full_load_report": "SELECT t.*, max_parallel, task, running_mode, completed FROM (SELECT file_id, count(*) AS tables, count(*) FILTER (WHERE status = 'loaded') AS loaded, count(*) FILTER (WHERE reload_count > 0) AS reloaded, CAST(sum(rows_sent) AS BIGINT) AS rows_sent, CAST(sum(rows_received) AS BIGINT) AS rows_received, CAST(sum(volume) AS BIGINT) AS volume FROM tabs GROUP BY 1) t LEFT JOIN (SELECT file_id, CAST(max(n) AS BIGINT) AS max_parallel FROM (SELECT file_id, sum(d) OVER (PARTITION BY file_id ORDER BY moment, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM (SELECT file_id, started AS moment, 1 AS d FROM segs WHERE started IS NOT NULL UNION ALL SELECT file_id, loaded, -1 FROM segs WHERE started IS NOT NULL AND loaded IS NOT NULL)) GROUP BY 1) p ON t.file_id = p.file_id LEFT JOIN (SELECT file_id, arg_max(task_, CASE WHEN task_ IS NOT NULL THEN line_number END) AS task, arg_max(mode_, CASE WHEN mode_ IS NOT NULL THEN line_number END) AS running_mode, bool_or(kind = 'completed') AS completed FROM fl GROUP BY 1) m ON t.file_id = m.file_id",
        "full_load_insights": rules("SELECT t.*, slow FROM (SELECT file_id, sum(reload_count) AS reloads, max(max_gap_seconds) AS gap, count(*) FILTER (WHERE rows_sent <> rows_received) AS differ, count(*) FILTER (WHERE status <> 'loaded') AS unfinished FROM tabs GROUP BY 1) t LEFT JOIN (SELECT file_id, count(*) FILTER (WHERE total_seconds >= 3600) AS slow FROM segs GROUP BY 1) s ON t.file_id = s.file_id", [("reloads > 0", 1, "full load", "reload_loop"), ("slow > 0", 2, "full load", "slow_segments"), ("gap >= 30", 2, "full load", "load_gap"), ("differ > 0", 1, "full load", "row_mismatch"), ("unfinished > 0", 3, "full load", "in_progress")]),
        "split_predicates": "SELECT file_id, line_number, predicate, subtask, table_id, seg, start_line FROM (SELECT *, row_number() OVER (PARTITION BY file_id, table_id, start_line ORDER BY line_number) AS r FROM (SELECT file_id, line_number, predicate_ AS predicate, key AS subtask, s.t AS table_id, s.g AS seg, s.l AS start_line FROM (SELECT *, last_value(CASE WHEN kind = 'start_segment' THEN {'t': table_id_, 'g': seg_, 'l': line_number} END IGNORE NULLS) OVER (PARTITION BY file_id, key ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM (SELECT *, CASE WHEN kind = 'where' THEN bound ELSE subtask_ END AS key FROM (SELECT *, last_value(CASE WHEN kind = 'command' THEN subtask_ END IGNORE NULLS) OVER (PARTITION BY file_id, thread_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bound FROM fl) WHERE kind IN ('start_segment', 'where'))) WHERE kind = 'where' AND s IS NOT NULL)) WHERE r = 1",
        "file_operations": "SELECT * FROM ups",
        "file_ops_summary": "SELECT file_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, round(avg(nullif(size_bytes, 0)), 6) AS avg_bytes, round(avg(nullif(total_seconds, 0)), 6) AS avg_seconds, round(avg(nullif(throughput_kbps, 0)), 6) AS avg_kbps FROM ups GROUP BY file_id",
        "file_ops_stats": "SELECT file_id, count(*) AS files, min(size_bytes) AS min_size_bytes, max(size_bytes) AS max_size_bytes, round(avg(size_bytes), 6) AS avg_size_bytes, CAST(sum(size_bytes) AS BIGINT) AS sum_size_bytes, min(total_seconds) AS min_total_seconds, max(total_seconds) AS max_total_seconds, round(avg(total_seconds), 6) AS avg_total_seconds, sum(total_seconds) AS sum_total_seconds FROM ups GROUP BY file_id HAVING count(*) >= 2",
        "file_ops_insights": rules(f"SELECT s.*, net, slow FROM ({sums}) s JOIN (SELECT u.file_id, avg(size_bytes / 1024.0 / (total_seconds - least)) FILTER (WHERE total_seconds - least > 0.1) AS net, count(*) FILTER (WHERE throughput_kbps < mean - dev AND size_bytes > 50 * 1024) AS slow FROM ups u JOIN ({sums}) t ON u.file_id = t.file_id WHERE total_seconds > 0 AND size_bytes > 0 GROUP BY u.file_id) a ON s.file_id = a.file_id", [("sizes > 10 AND times < 2", 1, "files", "a fixed cost prevails over size"), ("small > 30", 2, "files", "many small files"), ("n >= 3 AND sizes > 5 AND net > 1.5 * mean", 3, "files", "a fixed overhead for each upload"), ("n >= 3 AND slow > 0", 2, "files", "uploads far below the mean rate")]),
        "full_load_insight_segments": " UNION ALL ".join(f"SELECT file_id, '{kind}' AS kind, rank, table_id, attempt, seg, CAST({v} AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY {o}table_id, attempt, seg) AS rank FROM segs WHERE {c}) WHERE rank <= {k}" for kind, c, v, o, k in (("slow_segment", "total_seconds >= 3600", "total_seconds", "total_seconds DESC, ", 5), ("load_gap", "gap_seconds >= 30", "gap_seconds", "gap_seconds DESC, ", 3), ("row_mismatch", "rows_sent <> rows_received", "rows_sent - rows_received", "", 5))),
        "no_bulk_no_pk": rf"SELECT o.*, table_name FROM (SELECT file_id, CAST({rx('(?i)table' + chr(92) + 's+(?:id' + chr(92) + 's*)?#?(' + chr(92) + 'd+)')} AS BIGINT) AS table_id, count(*) AS n FROM lines WHERE {has(P.NO_PK)} AND {rx('(?i)table' + chr(92) + 's+(?:id' + chr(92) + 's*)?#?(' + chr(92) + 'd+)')} IS NOT NULL GROUP BY 1, 2) o LEFT JOIN (SELECT file_id, CAST({rx('(?i)Id' + chr(92) + 's*=' + chr(92) + 's*(' + chr(92) + 'd+)')} AS BIGINT) AS table_id, arg_max({rx(P.TABLE)} || '.' || {rx(P.TABLE, 2)}, line_number) AS table_name FROM lines WHERE regexp_matches(body, '(?i)Id\s*=\s*\d+') AND {has(P.TABLE)} GROUP BY 1, 2) n ON o.file_id = n.file_id AND o.table_id = n.table_id",
    }
    found |= {name: f"{loads} {sql}" for name, sql in out.items()}
    hit = " ".join(f"WHEN regexp_matches(text, {q('(?i)' + p)}) THEN {{'m': '{m}', 'i': '{i}'}}" for m, i, p in QUESTION_RULES)
    found["classify_questions"] = f"SELECT h.m AS mode, h.i AS intent, count(*) AS n FROM (SELECT CASE {hit} ELSE {{'m': 'general', 'i': 'unknown'}} END AS h FROM conversations WHERE role = 'user') GROUP BY ALL"
    return found
