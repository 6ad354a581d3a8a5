"""Release notes, support schedules, uploads' tables and the store of facts, against plain versions and literal texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from replog.operators import corpus as K
from replog.operators import events as E
from replog.operators import graph as G
from replog.operators import parse as R
from replog.sources import logs

MONTH = {m.lower(): k + 1 for k, m in enumerate(K.MONTHS)}


def key(version):
    m = next((MONTH[w] for w in re.findall(r"\w+", (version or "").lower()) if w in MONTH), None)
    y = re.search(r"20\d{2}", version or "")
    return int(y[0]) * 100 + m if m and y else None


def names(endpoint, text):
    return endpoint in text or any(p in text for p in endpoint.split() if len(p) > 3)


def plain_fixes(fixes, version, endpoint, k):
    own, seen, out = key(version), set(), []
    for fid, ver, comp in sorted(fixes, key=lambda f: (key(f[1]) is not None, key(f[1]) or 0, f[0], f[1])):
        if own and key(ver) and key(ver) < own:
            continue
        low = (comp or "").lower()
        specific = bool(endpoint) and low not in K.GENERIC and low != "" and names(endpoint, low)
        if (endpoint and not specific and low not in K.GENERIC) or fid in seen:
            continue
        seen.add(fid)
        out.append((fid, ver, specific, bool(own and key(ver) and key(ver) > own)))
    return out[:k]


def test_relevant_fixes_and_eol(spark):
    r = random.Random(1)
    versions = [f"{m} {y}" for y in (2022, 2023, 2024) for m in ("May", "November")] + ["Preview"]
    parts = ["Oracle Source", "oracle", "PostgreSQL Target", "MySQL", "Server", "engine", "UI Console", None, "Log Stream", ""]
    component = {f"F{i}": r.choice(parts) for i in range(40)}
    fixes = list({(f, r.choice(versions), component[f]) for f in (f"F{r.randrange(40)}" for _ in range(110))})
    files = [(i, v, e) for i, (v, e) in enumerate([("May 2023", "Oracle source"), ("November 2024", "mysql"), (None, "postgresql target"), ("May 2022", None), ("no month", ""), ("May 2023", "zz"), ("May 2023", "Oracle source")])]
    df = spark.createDataFrame(fixes, "fix_id string, version string, component string")
    asked = spark.createDataFrame(files, "file_id long, version string, endpoint string")
    for k in (4, 30):
        found = K.relevant_fixes(df, asked, k)
        got = {}
        for x in sorted(found.collect(), key=lambda x: x["rank"]):
            got.setdefault(x.file_id, []).append((x.fix_id, x.version, x.specific, x.future))
        want = {i: plain_fixes(fixes, v, (e or "").lower(), k) for i, v, e in files}
        assert got == {i: w for i, w in want.items() if w}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    entries = [(v, 1, n, t) for v in versions for n, t in enumerate(r.sample(["Oracle 11 support ended", "MySQL 5.5 has gone", "x" * 90 + "a", "x" * 90 + "b", "PostgreSQL 9 went", "oracle 12"], 4))]
    notes = spark.createDataFrame(entries, "version string, section int, at int, entry string")
    got = {}
    for x in sorted(K.relevant_eol(notes, asked, 5).collect(), key=lambda x: x["rank"]):
        got.setdefault(x.file_id, []).append((x.version, x.entry))
    for i, v, e in files:
        own, seen, want = key(v), set(), []
        for ver, _, _, t in sorted(entries, key=lambda x: (key(x[0]) is not None, key(x[0]) or 0, x[0], x[1], x[2])):
            if not (own and key(ver) and key(ver) < own) and (not e or names(e.lower(), t.lower())) and t[:80] not in seen:
                seen.add(t[:80])
                want.append((ver, t))
        assert got.get(i, []) == want[:5]


def test_support_status(spark):
    schedule = spark.createDataFrame([("Replicate November 2025", "2027-11-17"), ("Replicate May 2023", "2025-05-09"), ("Replicate April 2020 (6.6)", "2022-04-30"), ("Replicate 6.5", "2021-11-30")], "release string, end string").select("release", F.to_date("end").alias("end_date"))
    hints = ["May 2023", "version of may, 2023", "build 6.6.1", "6.5", "Replicate 6.5 patch", "replicate", "2020", "nothing", None, " "]
    got = {x.release_hint: (x.release, x.out_of_support) for x in K.support_status(spark.createDataFrame(list(enumerate(hints)), "file_id long, release_hint string"), schedule, "2025-05-10").collect()}
    assert got == {"May 2023": ("Replicate May 2023", True), "version of may, 2023": ("Replicate May 2023", True), "build 6.6.1": ("Replicate April 2020 (6.6)", True), "6.5": ("Replicate 6.5", True), "Replicate 6.5 patch": ("Replicate 6.5", True), "replicate": ("Replicate 6.5", True), "2020": ("Replicate April 2020 (6.6)", True)}


def test_end_of_support_sections(spark):
    marked = "# Notes\nEnd of support\n## End of support\n- Oracle 11\nok\n- MySQL 5.5 is gone\n### Details\n- deeper\n# What's new\n- not this\n## End of Life/End of support features\n- nor this\n## X is no longer supported\n- DB2 9\n"
    plain = "Intro\nEnd of support\nEndpoint versions\n- Oracle 11\nSupport for MySQL 5.5 was removed\nA longer line that ends with a full stop.\n\nResolved issues\n- not this\n- End of support\nend of SUPPORT\n* last"
    notes = spark.createDataFrame([("M", marked), ("P", plain), ("E", ""), ("N", None)], "version string, text string")
    got = sorted((x.version, x.section, x.entry) for x in K.parse_eol_entries(notes).collect())
    assert got == [("M", 1, "- MySQL 5.5 is gone"), ("M", 1, "- Oracle 11"), ("M", 1, "- deeper"), ("M", 2, "- DB2 9"), ("P", 1, "- Oracle 11"), ("P", 1, "A longer line that ends with a full stop."), ("P", 1, "Support for MySQL 5.5 was removed"), ("P", 2, "* last")]
    assert K.parse_eol_entries(notes, most=1).count() == 4


def line(n, component, message):
    return f"00001234: 2025-06-15T10:{n // 60:02d}:{n % 60:02d} [{component:<16}]I:  {message}"


def test_tables_of_uploads(spark):
    r = random.Random(9)
    rows, tables, tracked, want = [], set(), {}, []
    for n in range(300):
        kind, name = r.choice(("map", "map", "start", "done", "other")), f"CDC0{r.randrange(3)}.csv"
        if kind == "map":
            table = f"t{r.randrange(6)}"
            rows.append(line(n, "TARGET_APPLY", f"bulk_map: seq 1:6 UPDATE 'dbo'.'{table}' (id=5)"))
            tables.add(f"dbo.{table}")
        elif kind == "start":
            rows.append(line(n, "FILE_FACTORY", rf"Going to compress file 'C:\out\{name}' to 'C:\out\{name}.gz'"))
            tracked.setdefault(name, sorted(tables))
        elif kind == "done":
            rows.append(line(n, "FILE_FACTORY", rf"File C:\out\{name}.gz of size 2822 was uploaded successfully"))
            want.append((n, name.upper(), tracked.pop(name, sorted(tables))))
            tables.clear()
        else:
            rows.append(line(n, "SORTER", "nothing"))
    lines = R.fill_continuations(R.parse_prefix(spark.createDataFrame([(1, k, b) for k, b in enumerate(rows)], "file_id long, line_number long, body string")))
    got = sorted((x.line_number, x.file_name, x.tables) for x in E.upload_tables(lines).collect())
    # a set that a compress start took may be from before another file's upload
    assert got == want and any(t for _, _, t in want)


def test_facts_are_made_anew_only_for_changed_files(spark, tmp_path):
    lines = spark.createDataFrame([(f, n, f"line {n}") for f in range(4) for n in range(5)], "file_id long, line_number long, body string")
    made = spark.sparkContext.accumulator(0)

    def make(own):
        seen = F.udf(lambda t: made.add(1) or t.upper(), "string").asNondeterministic()
        return own.filter("file_id <> 3").select("file_id", "line_number", seen("body").alias("fact"))

    files = lines.groupBy("file_id").agg(F.count("*").alias("line_count"), F.sum(F.length("body")).alias("size_bytes"))
    path = str(tmp_path / "facts")
    first = sorted(map(tuple, logs.refresh_facts(lines, logs.file_version(files, "1"), path, make).collect()))
    assert len(first) == 15 and made.value == 15
    assert sorted(map(tuple, logs.refresh_facts(lines, logs.file_version(files, "1"), path, make).collect())) == first and made.value == 15
    grown = lines.union(spark.createDataFrame([(1, 5, "line 5")], lines.schema))
    more = grown.groupBy("file_id").agg(F.count("*").alias("line_count"), F.sum(F.length("body")).alias("size_bytes"))
    second = logs.refresh_facts(grown, logs.file_version(more, "1"), path, make)
    assert second.count() == 16 and made.value == 15 + 6
    # another version of the extractor: all files, and only their own rows
    assert logs.refresh_facts(grown, logs.file_version(more.filter("file_id < 2"), "2"), path, make).count() == 11


@pytest.mark.parametrize("hops", [1, 2])
def test_graph_is_kept(spark, tmp_path, hops):
    lines = spark.createDataFrame([(f, n, f"line {n}") for f in range(2) for n in range(3)], "file_id long, line_number long, body string")
    make = lambda own: own.select("file_id", F.col("body").alias("src"), F.lit("x").alias("dst"), F.lit(1.0).alias("weight"), F.lit("EXTRACTED").alias("provenance"))
    version = spark.createDataFrame([(0, "a"), (1, "a")], "file_id long, fingerprint string")
    edges = G.cached_graph(lines, version, str(tmp_path / "graph"), make)
    anchors = spark.createDataFrame([(0, "line 1")], "file_id long, anchor string")
    assert {x.node for x in G.neighbors(edges, anchors, hops).collect()} == ({"x"} if hops == 1 else {"x", "line 0", "line 2"})


def test_many_terms_in_one_pass(spark):
    from replog.operators import issues as I
    from replog.operators import terms as T

    r = random.Random(4)
    words = sorted({"".join(r.choice("abC") for _ in range(r.randint(1, 5))) for _ in range(1000)})
    texts = [(k, "".join(r.choice("abcABC ") for _ in range(r.randint(0, 60)))) for k in range(50)] + [(99, None), (98, "")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    first = list({w.lower(): w for w in reversed(words)}.values())
    got = {x.id: set(x.terms) for x in T.with_terms(df, "text", words).collect()}
    assert got == {k: {w for w in first if w.lower() in (t or "").lower()} for k, t in texts}
    some = words[::7]
    got = {x.id: x.terms for x in T.with_longest(df, "text", some).collect()}
    assert got == {k: T.plain_longest(t or "", some) for k, t in texts}
    assert T.with_terms(df, "text", []).filter("size(terms) > 0").count() == 0
    lines = df.select((F.col("id") % 3).alias("file_id"), F.col("id").alias("line_number"), F.coalesce("text", F.lit("")).alias("body"))
    many, few = (sorted(map(tuple, I.keyword_search(lines, w, 100).collect())) for w in (["abca", "bab", *["zz"] * 20], ["abca", "bab"]))
    assert many == few and few


def test_lists_are_made_before_files_ask(spark, monkeypatch):
    monkeypatch.setattr(K, "ASKERS", 2)
    versions, names_ = ["May 2023", None], ["Oracle source", None, "mysql"]
    fixes = [(f"F{i}", v, c) for i, (v, c) in enumerate((v, c) for v in ("May 2022", "May 2024", "Preview") for c in ("Oracle", "Server", "MySQL", None))]
    df = spark.createDataFrame(fixes, "fix_id string, version string, component string")
    files = [(i, versions[i % 2], names_[i % 3]) for i in range(60)] + [(None, "May 2023", "mysql")]
    found = K.relevant_fixes(df, spark.createDataFrame(files, "file_id long, version string, endpoint string"), 3)
    # nothing is put in order for each file: its list is ready when it meets it
    assert "windowspecdefinition(file_id" not in found._jdf.queryExecution().analyzed().toString()
    got = {}
    for x in sorted(found.collect(), key=lambda x: x["rank"]):
        got.setdefault(x.file_id, []).append((x.fix_id, x.version, x.specific, x.future))
    assert got == {i: plain_fixes(fixes, v, (e or "").lower(), 3) for i, v, e in files}
