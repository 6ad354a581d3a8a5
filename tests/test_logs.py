"""Log operators on literal lines, against sequential models, and the registered queries against their SQL."""

import collections
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from replog.operators import apply as A
from replog.operators import corpus as K
from replog.operators import events as E
from replog.operators import fullload as L
from replog.operators import graph as G
from replog.operators import issues as I
from replog.operators import latency as T
from replog.operators import parse as R
from replog.operators import redact as D
from replog.operators import report as RP
from replog.plans import queries as Q
from replog.plans import scale as S
from replog.sources import logs
from replog.streaming import logs as ST

SF = "/root/testdata/sf0.001"


def line(second, component, severity, message, thread=1234):
    return f"{thread:08d}: 2025-06-15T10:{second // 60:02d}:{second % 60:02d} [{component:<16}]{severity}:  {message}"


SAMPLE = [
    line(0, "SOURCE_CAPTURE", "I", "Source endpoint 'Oracle' is using provider"), line(1, "TARGET_APPLY", "I", "Target endpoint 'Microsoft SQL Server' is using provider"), line(2, "TARGET_APPLY", "I", "Set Bulk Timeout = 30000 milliseconds"),
    line(3, "TARGET_APPLY", "I", "Set Bulk Timeout Min = 5000 milliseconds"), line(4, "TARGET_APPLY", "I", "Bulk max file size: 32 MB, 32768 KB"), line(5, "TARGET_APPLY", "I", "Parallel bulk apply enabled with maximum 4 apply threads"),
    line(30, "TARGET_APPLY", "T", "Going to start applying bulk changes"), line(31, "TARGET_APPLY", "T", "Start applying 'INSERT (5)' changes for table 'dbo'.'orders'"), line(32, "TARGET_APPLY", "T", "Going to run INSERT statement for table 'dbo'.'orders' from seq 1 to seq 5"),
    line(33, "TARGET_APPLY", "T", "Finished applying of 5 'INSERT (5)' events for table 'dbo'.'orders'"), line(35, "TARGET_APPLY", "T", "Bulk finished."), line(38, "SORTER", "W", "Memory consumption approaching configured limit"),
    line(40, "TARGET_APPLY", "E", "Failed to execute statement. SqlState: HY000 NativeError: 1205 Message: Lock wait timeout exceeded"), line(41, "TARGET_APPLY", "E", "RetCode: SQL_ERROR  SqlState: HY000 NativeError: 1205"), "  Continuation: Lock wait timeout on table 'dbo'.'orders'", "",
    line(43, "TARGET_APPLY", "E", "ORA-00054: resource busy and acquire with NOWAIT specified"), line(50, "SOURCE_CAPTURE", "E", "Failed to read redo log. ORA-00054: resource busy", 5678), line(60, "PERFORMANCE", "I", "Source latency 1.234 seconds, Target latency 0.456 seconds, Handling latency 0.789 seconds"),
]


def parsed(spark, bodies, file_id=1):
    raw = spark.createDataFrame([(file_id, k, b) for k, b in enumerate(bodies)], "file_id long, line_number long, body string")
    return R.fill_continuations(R.parse_prefix(raw))


@pytest.fixture(scope="module")
def sample(spark):
    return parsed(spark, SAMPLE).cache()


def test_rich_sample(sample):
    p = R.parse_latency(sample).first()
    assert (p.source_latency, p.target_latency, p.handling_latency) == (1.234, 0.456, 0.789)
    b = E.batches(sample).collect()
    assert len(b) == 1 and (b[0].line_number, b[0].duration_seconds, b[0].changes_count, b[0].applies_count, b[0].closure_reason, b[0].tables) == (10, 5.0, 5, 1, "Normal", ["dbo.orders"])
    t = E.table_stats(sample).first()
    assert (t.table_name, t.total_inserts, t.total_apply_time_seconds) == ("dbo.orders", 5, 2.0)
    c = R.task_config(sample).first()
    assert (c.bulk_timeout_ms, c.bulk_timeout_min_ms, c.bulk_max_file_size_kb, c.parallel_apply_threads, c.source_type, c.target_type) == (30000, 5000, 32768, 4, "Oracle", "Microsoft SQL Server")
    e = [(r.line_number, r.error_code) for r in R.error_lines(sample).orderBy("line_number").collect()]
    assert e == [(11, None), (12, "SqlState:HY000/1205"), (13, "SqlState:HY000/1205"), (16, "ORA-00054"), (17, "ORA-00054")]
    cont = sample.filter("is_continuation").collect()
    assert len(cont) == 1 and cont[0].component == "TARGET_APPLY" and sample.filter("line_number = 15").count() == 0
    index = I.build_token_index(sample)
    assert [r.line_number for r in I.search(sample, index, phrase=["ora", "00054"]).orderBy("line_number").collect()] == [16, 17]
    assert [r.line_number for r in I.search(sample, index, component="TARGET_APPLY", phrase=["ora", "00054"]).collect()] == [16]
    assert I.regex_search(sample, "(").count() == 0


@pytest.mark.parametrize("text,code", [
    ("SqlState: HY000 NativeError: 1205 x", "SqlState:HY000/1205"), ("SQLSTATE: 42S02 NATIVEERROR: 208", "SqlState:42S02/208"), ("ora-00060: deadlock", "ORA-00060"), ("Got MySQL Error 1062 (duplicate key)", "MySQL:1062"), ("SQLSTATE 23505 unique_violation", "PG:23505"), ("PG = 23505", "PG:23505"),
    ("RetCode: SQL_NO_DATA", "SQL_NO_DATA"), ("RetCode: SQL_SUCCESS", None), ("NativeError: 0", None), ("plain", None), ("", None), ("Processed 12345 rows in 6789 ms", None), ("NativeError: 547", "Native:547"),
])
def test_error_codes(spark, text, code):
    assert spark.createDataFrame([(text,)], "body string").select(R.error_code()).first()[0] == code


def test_batches_against_a_sequential_model(spark):
    r, rows, want = random.Random(4), [], []
    for f in range(12):
        start, reason, changes, tables = None, None, 0, set()
        for n in range(60):
            kind = r.choice(["start", "end", "run", "reason", "table", "other"])
            at = f"2025-01-01T00:{n // 60:02d}:{n % 60:02d}"
            k = r.randint(1, 9)
            text = {"start": "Going to start applying bulk changes", "end": "Bulk finished.", "run": f"Going to run INSERT statement from seq 1 to seq {k}", "reason": f"Finish bulk because of {['memory', 'resume'][k % 2]}", "table": f"Start applying 'INSERT (1)' changes for table 'a'.'t{k}'", "other": "hello"}[kind]
            rows.append((f, n, f"1: {at} [TARGET_APPLY]I: {text}"))
            if kind == "start":
                start, reason, changes, tables = n, None, 0, set()
            elif kind == "run":
                changes += k
            elif kind == "reason":
                reason = ["MEM", "RES"][k % 2]
            elif kind == "table":
                tables.add(f"a.t{k}")
            elif kind == "end" and start is not None:
                want.append((f, n, float(n - start), reason or "Normal", changes, sorted(tables)))
                start = None
    df = R.fill_continuations(R.parse_prefix(spark.createDataFrame(rows, "file_id long, line_number long, body string")))
    got = [(b.file_id, b.line_number, b.duration_seconds, b.closure_reason, b.changes_count, b.tables) for b in E.batches(df).orderBy("file_id", "line_number").collect()]
    assert got == want


def test_pairs_and_forward_fill_against_sequential_models(spark):
    r = random.Random(9)
    rows = [(k % 3, n, r.choice("ab"), r.random() < 0.5, n // 7, r.choice([None, None, n])) for k in range(3) for n in range(80)]
    df = spark.createDataFrame(rows, "file_id int, n int, key string, opens boolean, split int, v int")
    open_at, want = {}, []
    for f, n, key, opens, _, _ in sorted(rows):
        if opens:
            open_at[f, key] = n
        elif (f, key) in open_at:
            want.append((f, key, open_at.pop((f, key)), n))
    got = S.pair_events(df, ["file_id", "key"], "n", F.col("opens"), ["n"]).select("file_id", "key", "open_n", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    one, two = S.forward_fill(df, ["file_id"], "n", ["v"]), S.forward_fill(df, ["file_id"], "n", ["v"], "split")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))


def test_range_and_asof_joins(spark):
    r = random.Random(1)
    points, spans = [(r.randint(0, 1), r.randint(0, 300)) for _ in range(80)], [(r.randint(0, 1), a, a + r.randint(0, 60), k) for k, a in enumerate(r.sample(range(300), 40))]
    p, s = spark.createDataFrame(points, "k int, x long"), spark.createDataFrame(spans, "k int, a long, b long, id long")
    got = sorted((v.k, v.x, v.id) for v in S.range_join(p, s, ["k"], "x", "a", "b", 25).collect())
    assert got == sorted((k, x, i) for k, x in points for k2, a, b, i in spans if k == k2 and a <= x <= b)
    near = {(v.k, v.x): v.id for v in S.asof_backward(p.distinct(), s, ["k"], "x", "a", ["id"]).collect()}
    for (k, x), i in near.items():
        want = max(((a, i2) for k2, a, _, i2 in spans if k2 == k and a <= x), default=(0, None))[1]
        assert i == want


def test_percentile_spikes_and_plateaus(spark):
    rows = [(1, k, f"2025-01-01 00:{k:02d}:00", 1.0, 1.0 + (k == 30) * 20 + (40 <= k < 55) * 5, 0.5) for k in range(60)]
    perf = spark.createDataFrame(rows, "file_id long, line_number long, t string, source_latency double, target_latency double, handling_latency double").withColumn("timestamp", F.col("t").cast("timestamp_ntz")).drop("t")
    n10 = spark.createDataFrame([(1, float(v)) for v in range(10)], "k int, v double")
    assert S.floor_percentile(n10, ["k"], "v", (0.5, 0.99), ("a", "b")).first()[2:] == (5.0, 9.0)
    assert [r.line_number for r in T.spikes(perf).orderBy("line_number").collect()][:2] == [30, 40]
    p = T.plateaus(perf).collect()
    assert len(p) == 1 and p[0].start_line == 40 and p[0].end_line == 55
    assert T.bottleneck(perf).first().bottleneck == "source"
    assert T.latency_time_to_line(perf, spark.createDataFrame([(1, "2025-01-01 00:10:30")], "file_id long, a string").select("file_id", F.col("a").cast("timestamp_ntz").alias("at"))).first().line_number in (10, 11)


def test_full_load(spark):
    seg = "segment #1 of 6 of table 'dbo'.'event_wil' (Id = 7) by subtask 2"
    a = [
        line(0, "TASK_MANAGER", "I", "Task 'T1' running full load and CDC in fresh start mode"), line(1, "TASK_MANAGER", "I", "Start initializing segmented table 'dbo'.'event_wil' (Id = 7) by subtask 2"), line(2, "TASK_MANAGER", "I", f"Start loading {seg}"),
        line(3, "SOURCE_UNLOAD", "T", "Command 'UNLOAD_TABLE_SEGMENT' received in component 'st_2_x'", 2), line(3, "SOURCE_UNLOAD", "T", "Transformation Where 'id < 10'", 2), line(9, "SOURCE_UNLOAD", "I", "Unload finished for segment #1 of segmented table 'dbo'.'event_wil' (Id = 7). 1000 rows sent."),
        line(11, "TARGET_LOAD", "I", "Load finished for segment #1 of segmented table 'dbo'.'event_wil' (Id = 7). 1000 rows received. 0 rows skipped. Volume transferred 5000."),
    ]
    df = parsed(spark, a)
    s = L.segments(df).first()
    assert (s.rows_sent, s.rows_received, s.gap_seconds, s.unload_seconds, s.status, s.seg_total) == (1000, 1000, 2.0, 7.0, "loaded", 6)
    w = L.split_predicates(df).first()
    assert (w.predicate, w.table_id, w.seg) == ("id < 10", 7, 1) and L.report(df).first().running_mode == "fresh start"
    b = [line(0, "TASK_MANAGER", "I", f"Start loading {seg}"), line(5, "TASK_MANAGER", "W", "Reloading table 7 because subtask #2 that was loading segment 5 finished with error"), line(9, "TASK_MANAGER", "I", f"Start loading {seg}")]
    df = parsed(spark, b)
    t = L.tables(df).first()
    assert (t.reload_count, t.attempt_count) == (1, 2) and "reload_loop" in {r.title for r in L.insights(df).collect()}


def test_neighbors_ranked(spark):
    edges = spark.createDataFrame([(f, s, d, w, p) for f in (1, 2) for s, d, w, p in (("error:100", "error:40100", 1.0, "INFERRED"), ("error:100", "error:200", 0.9, "EXTRACTED"), ("error:200", "code:x", 1.5, "EXTRACTED"), ("error:100", "code:x", 0.5, "INFERRED"))], "file_id long, src string, dst string, weight double, provenance string")
    anchor = spark.createDataFrame([(1, "error:100"), (2, "error:100")], "file_id long, anchor string")
    files = spark.createDataFrame([(1, 100_000), (2, 50_000)], "file_id long, line_count long")
    found = G.neighbors(edges, anchor)
    got = {(r.file_id, r.node): (r.hop, r.provenance, round(r.score, 9), round(r.final, 9)) for r in G.rank_neighbors(found, files).collect()}
    for f, n in ((1, 100_000), (2, 50_000)):
        assert got[f, "error:40100"] == (1, "INFERRED", 1.0, round(1 / 1.5 * max(0.2, 1 - 40_000 / n), 9))
        assert got[f, "error:200"] == (1, "EXTRACTED", 0.9, round(0.9 / 1.5 * 1.2 * (1 - 100 / n), 9))
        # two hops by extracted edges beat the inferred edge
        assert got[f, "code:x"] == (2, "EXTRACTED", 0.675, round(0.675 / 2 * 1.2, 9))


def test_graph_and_windows(spark):
    e = spark.createDataFrame([(1, n, "2025-01-01", c, t, "I", "x", code) for n, c, t, code in ((10, "A", "1", "k"), (15, "A", "1", "k"), (200, "B", "2", "z"))], "file_id long, line_number long, timestamp string, component string, thread_id string, severity string, text string, error_code string")
    pairs = G.cooccurring_errors(e).collect()
    assert len(pairs) == 1 and (pairs[0].a, pairs[0].b, round(pairs[0].weight, 6)) == (10, 15, 0.9)
    edges = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "c", 1.0), (1, "c", "d", 1.0)], "file_id long, src string, dst string, weight double")
    anchor = spark.createDataFrame([(1, "a")], "file_id long, anchor string")
    assert [r.node for r in G.neighbors(edges, anchor, 1).collect()] == ["b"] and {r.node for r in G.neighbors(edges, anchor, 2).collect()} == {"b", "c"}
    hits = lambda xs: spark.createDataFrame([(1, x) for x in xs], "file_id long, line_number long")
    assert I.merge_windows(hits([10, 50])).count() == 2 and I.merge_windows(hits([10, 12])).first().hits == [10, 12]
    # as for a window cut at its cap: its last line is at most 20 behind its first
    assert all(r.end - r.start <= 20 for r in I.merge_windows(hits(range(0, 50, 2))).collect())
    facts = spark.createDataFrame([(1, k, "x" * 40) for k in range(5)], "file_id long, k int, text string")
    assert G.pack_to_budget(facts, 25, ["file_id"], ["k"]).count() == 2


def test_redaction(spark):
    rows = [("host server01.corp.example.com up",), ("from 10.1.2.3 to 10.1.2.4",), (r"see \\srv\share\f",), ("UID=me;SERVER=db1;PWD=s3;",), ("Licensed to Acme Ltd, today",), ("mail a.b@c.org now",), (None,), ("ORA-00054 HY000 DBO.TABLE",)]
    got = [r.text for r in D.redact(spark.createDataFrame(rows, "text string"), ["text"]).collect()]
    assert got[0] == "host [HOSTNAME] up" and got[1] == "from [IP_ADDRESS] to [IP_ADDRESS]" and got[2] == "see [UNC_PATH]" and "[PASSWORD]" in got[3] and "me" not in got[3].split("[")[0] and got[4] == "[COMPANY_NAME], today" and got[5] == "mail [EMAIL] now" and got[6] is None and got[7] == rows[7][0]
    nested = spark.createDataFrame([({"a": "10.0.0.1"}, ["b@c.org"])], "m map<string,string>, a array<string>")
    assert D.redact_nested(nested).first() == ({"a": "[IP_ADDRESS]"}, ["[EMAIL]"])


def test_read_logs_is_the_same_for_any_split(spark, tmp_path):
    data = b"".join(f"line {k} \xc3\xa9".encode("latin-1") + (b"\r\n" if k % 5 == 0 else b"\n") + (b"\n" if k % 11 == 0 else b"") for k in range(700)) + b"bad \xff byte\n"
    for name in ("a", "b"):
        (tmp_path / f"{name}.log").write_bytes(data)
    want, offset = [], 0
    for k, raw in enumerate(data.split(b"\n")[:-1]):
        want.append((k, offset, raw.removesuffix(b"\r").decode("utf-8", "replace")))
        offset += len(raw) + 1
    for size in ("2k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = logs.read_logs(spark, str(tmp_path)).orderBy("file_id", "line_number").collect()
        assert [(r.line_number, r.byte_offset, r.body) for r in got] == want * 2
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_corpus(spark):
    html = f"<html><head><title>How to fix - Site</title></head><body><nav>menu</nav><article>{'Useful words here. ' * 20}Was this article helpful? Yes No</article></body></html>"
    a = K.clean_articles(spark.createDataFrame([("http://x/kb/12", html), ("http://x/kb/13", "short"), ("http://x/kb/14", None)], "url string, html string")).collect()
    assert len(a) == 1 and a[0].title == "How to fix" and "helpful" not in a[0].content and "menu" not in a[0].content and a[0].article_id == "12"
    text = " ".join(f"Sentence number {k} is here." for k in range(200))
    chunks = [r.chunk for r in K.chunk_documents(spark.createDataFrame([(1, text), (2, None), (3, "tiny")], "id long, text string"), "id", "text").orderBy("chunk_index").collect()]
    assert len(chunks) >= 3 and all(chunks[k + 1].startswith(chunks[k][-200:]) for k in range(len(chunks) - 1)) and max(map(len, chunks)) <= 2000 + 60
    notes = spark.createDataFrame([("May 2025", "intro\nJira issue: RECOB-1\nType: Bug\nDescription: one\nJira issue: RECOB-2\nDescription: two")], "version string, text string")
    assert [(r.fix_id, r.description) for r in K.parse_fix_entries(notes).orderBy("fix_id").collect()] == [("RECOB-1", "one"), ("RECOB-2", "two")]
    old, new = spark.createDataFrame([("u", "1"), ("v", "2")], "url string, content_hash string"), spark.createDataFrame([("u", "9"), ("w", "3")], "url string, content_hash string")
    assert {r.url: r.change for r in K.changed_articles(old, new).collect()} == {"u": "changed", "v": "gone", "w": "new"}
    assert A.recommend(spark.createDataFrame([(1, 5)], "file_id long, n int"), [(F.col("n") > 3, 1, "a", "many"), (F.col("n") > 9, 1, "a", "more")]).collect() == [(1, 1, "a", "many")]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, k, b) for k, b in enumerate(SAMPLE)], ST.LINES).coalesce(1).write.parquet(source)
    lines = ST.stream_lines(spark, source)
    for name, df, mode in (("lat", ST.stream_latency(lines), "complete"), ("iss", ST.stream_issue_counts(lines), "complete"), ("bat", ST.stream_batches(lines), "append"), ("par", ST.stream_pairs(lines), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("lat").first().samples == 1 and spark.table("bat").count() == 1 and spark.table("iss").agg(F.sum("n")).first()[0] == 5


def test_queries_agree_with_their_sql(spark, monkeypatch):
    # most queries go on from the same parsed lines
    parsed = Q.lines(spark, SF).cache()
    monkeypatch.setattr(Q, "lines", lambda s, d: parsed)
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    for name in sorted(Q.ORACLES):
        df = Q.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        rows = con.execute(Q.ORACLES[name])
        names = [d[0] for d in rows.description]
        assert sorted(names) == columns, name
        want = collections.Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall())
        assert collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want, name


def test_windows_are_cut(spark):
    rows = [(1, n) for n in (10, 12, 50)] + [(2, n) for n in range(0, 50, 2)] + [(3, None)]
    got = {}
    for r in I.merge_windows(spark.createDataFrame(rows, "file_id long, line_number long")).collect():
        got.setdefault(r.file_id, []).append((r.start, r.end, r.hits))
    assert sorted(got[1]) == [(7, 15, [10, 12]), (47, 53, [50])] and 3 not in got
    assert all(b - a <= 20 for a, b, _ in got[2]) and sorted(n for _, _, h in got[2] for n in h) == list(range(0, 50, 2))
    # the first is cut at 17 and hits up to 20 still touch it; then a new one starts
    assert sorted(got[2])[0] == (-3, 17, list(range(0, 22, 2))) and sorted(got[2])[1][0] == 19


def test_stretches_against_sums_made_anew():
    r = np.random.default_rng(4)
    for _ in range(60):
        v = np.concatenate([r.normal(r.choice([5, 20, 21]), r.choice([0.5, 4]), r.integers(3, 25)) for _ in range(r.integers(1, 7))])
        steady = lambda a, b, most: v[a:b].mean() > 0 and v[a:b].std(ddof=1) / v[a:b].mean() < most
        starts = [a for a in range(len(v) - 10) if v[a : a + 10].mean() > 1.3 * v.mean() and steady(a, a + 10, 0.15)]
        want, past = [], 0
        for a in starts:
            if a >= past:
                past = next((b for b in range(a + 10, len(v)) if not (v[a : b + 1].mean() > v.mean() and steady(a, b + 1, 0.225))), len(v))
                want.append((a, past))
        assert [(a, b) for a, b, _ in T.stretches(v, 10, 0.15)] == want


def test_small_faults(spark):
    lines = spark.createDataFrame([(1, 0, None, "[SORTER ]I: pending 42"), (1, 1, None, "[SORTER ]I: queue holds 7")], "file_id long, line_number long, timestamp timestamp_ntz, body string")
    assert [r.value for r in R.sorter_metrics(lines).filter("metric = 'queue_depth'").orderBy("line_number").collect()] == ["42", "7"]
    assert I.regex_search(lines, "(?P<a>x)").count() == 0 and I.regex_search(lines, "[").count() == 0 and I.regex_search(lines, "PENDING").count() == 1
    reports = spark.createDataFrame([(1, "LINE 11 and line 12"), (2, "LINE 11")], "file_id long, text string")
    errors = spark.createDataFrame([(1, 10)], "file_id long, line_number long")
    assert sorted((r.file_id, r.line_number) for r in K.invalid_line_citations(reports, errors).collect()) == [(1, 11), (2, 10)]
    assert K.chunk_text("") == [] and K.chunk_text("a" * 300) == ["a" * 300]
    first, second = K.chunk_text("a" * 150 + ". " + "b" * 150 + ".", 160, 20, 10)
    assert first == "a" * 150 + "." and second == "a" * 19 + ". " + "b" * 150 + "."


@pytest.mark.parametrize("name", ["plateaus", "redo_read_variance", "batch_inefficiencies", "bulk_map_insights", "file_ops_insights"])
def test_derived_lines_hold_such_cases(spark, name):
    assert not Q.QUERIES[name](spark, "/root/testdata/sf0.01").isEmpty()


def test_report_sections_that_match(spark):
    text = "# Intro\nnothing\n# Locks\nORA-00054 on orders, lock wait\n# Apply\nlock wait again\n" + "# Long\nlock " + "x" * 900
    rows = [(1, text, "lock wait on orders", "ORA-00054", None), (2, "plain words", "deadlock", None, None), (3, None, "lock", None, None), (4, "", None, None, None), (5, "a\n\nb lock\n\nc", "lock", None, None), (6, "y" * 900, "none", None, "")]
    df = spark.createDataFrame(rows, "k long, report string, summary string, error_code string, component string")
    got = {r.k: (r.score, r.excerpt) for r in RP.match_report_sections(df, ["k"]).collect()}
    # the best section first; the next fits, the long one does not
    assert got[1] == (4, "# Locks\nORA-00054 on orders, lock wait\n\n# Apply\nlock wait again")
    assert got[2] == (0, "plain words") and got[3][1] is None and got[4][1] is None
    assert got[5] == (1, "b lock") and got[6] == (0, "y" * 800 + "…")
    assert RP.match_report_sections(df.limit(0), ["k"]).count() == 0


def test_latest_reports(spark):
    rows = [(1, n, f"2025-01-{n + 1:02d} 00:00:00", "m", "t" * 300) for n in range(7)] + [(1, 9, None, "m", "x"), (2, 1, None, None, None)]
    df = spark.createDataFrame(rows, "file_id long, report_id long, generated_at string, model string, text string").withColumn("generated_at", F.col("generated_at").cast("timestamp"))
    got = sorted((r.file_id, r["rank"], r.report_id, len(r.preview)) for r in RP.latest_reports(df).collect())
    assert got == [(1, k, 7 - k, 200) for k in range(1, 6)] + [(2, 1, 1, 0)]


def test_values_named_in_lines(spark):
    bodies = ["Using ODBC driver: Native Client 11.0; more", "Using ODBC driver: Native Client 11.0, again", "Applying INSERT one-by-one for table 'dbo'.'t1'", "Log level of 'SORTER' was changed from 'INFO' to 'TRACE'", "Licensed to Acme Works, all", "one-by-one without a table", None]
    df = spark.createDataFrame([(1, k, b) for k, b in enumerate(bodies)], "file_id long, line_number long, body string")
    assert {(r.kind, r.value) for r in RP.named_values(df).collect()} == {("odbc_driver", "Native Client 11.0"), ("one_by_one_table", "dbo.t1"), ("level_change", "SORTER: INFO > TRACE"), ("license", "Acme Works")}
    assert RP.named_values(df).count() == 4 and RP.named_values(df.limit(0)).count() == 0


def test_upload_insights(spark):
    rows = [(1, 1_000_000, 10.0, 97.7), (1, 100_000, 9.0, 10.9), (1, 50_000, 9.5, 5.1), (1, 90_000, 9.6, 9.2), (2, 100_000, 1.0, 100.0), (2, 100_000, 1.0, 100.0), (2, 100_000, 1.0, 100.0), (2, 100_000, 5.0, 20.0), (3, 0, 0.0, None)]
    df = spark.createDataFrame(rows, "file_id long, size_bytes long, total_seconds double, throughput_kbps double")
    got = {(r.file_id, r.title) for r in A.file_ops_insights(df).collect()}
    assert got == {(1, "a fixed cost prevails over size"), (1, "a fixed overhead for each upload"), (2, "uploads far below the mean rate")}


def test_full_text_some(spark):
    df = spark.createDataFrame([(1, k, b) for k, b in enumerate(["alpha beta", "beta gamma", "gamma", "alpha delta"])], "file_id long, line_number long, body string")
    find = lambda **x: sorted(r.line_number for r in I.full_text(I.build_token_index(df), **x).collect())
    assert find(some=["alpha", "gamma"]) == [0, 1, 2, 3] and find(some=["alpha", "gamma"], none=["beta"]) == [2, 3] and find(every=["beta"], some=["gamma"]) == [1]


def test_deny_list(spark):
    found = ["HY000", "ATT-123", "Full  Load", "SorterTask", "StreamManager", "DBO.ORDERS", "host.example.com", "a@example.com", "10.0.0.1", "https://x.example/StreamManager"]
    df = spark.createDataFrame([(f,) for f in found], "found string")
    assert {r.found for r in D.drop_false_positives(df).collect()} == {"host.example.com", "a@example.com", "10.0.0.1"}
