"""Shapes that go over splits, percentiles by buckets, bounded expansion and partial top-k, against plain versions on random tables."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from replog.operators import corpus as K
from replog.operators import events as E
from replog.operators import graph as G
from replog.operators import parse as R
from replog.plans import scale as S
from replog.plans.queries import QUERIES


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.fixture(scope="module")
def steps(spark):
    r = random.Random(7)
    rows = [(f, n, n // r.choice((7,)) if f != 2 else n // 1000, r.choice(("a", "b", None)), r.choice((1.5, 2.0, None)), r.random() < 0.3) for f in (0, 1, 2, None) for n in range(60) if r.random() < 0.8]
    return spark.createDataFrame(rows, "f long, n long, split long, kind string, v double, hit boolean").repartition(5).cache()


def test_shapes_are_the_same_over_splits(spark, steps):
    both = lambda make: (rows_of(make(None)), rows_of(make("split")))
    for make in (
        lambda s: S.forward_fill(steps, ["f"], "n", ["kind", "v"], s),
        lambda s: S.lagged(steps, ["f"], "n", {"before": F.col("kind"), "at": F.col("n")}, s),
        lambda s: S.lagged(steps, ["f", "kind"], "n", {"before": F.col("v")}, s),
        lambda s: S.islands(steps, ["f"], "n", F.col("hit"), split=s),
        lambda s: S.islands(steps, ["f"], "n", F.col("hit"), closed=True, split=s),
        lambda s: S.runs(steps, ["f"], "n", F.col("kind"), split=s),
        lambda s: S.pair_events(steps, ["f", "kind"], "n", F.col("hit"), ["n", "v"], s),
        lambda s: S.asof_backward(steps, steps.filter("hit").select("f", "split", F.col("n").alias("m"), F.col("v").alias("w")), ["f"], "n", "m", ["w"], s),
    ):
        one, two = both(make)
        assert one == two and one


def test_one_large_file_over_splits(spark):
    """A file of a million lines: the same batches, pairs and runs, and no exchange by file alone ahead of the tables of splits."""
    bodies = "CASE n % 9 WHEN 0 THEN 'Going to start applying bulk changes' WHEN 1 THEN 'Start applying ''INSERT (5)'' changes for table ''dbo''.''t' || CAST(n % 5 AS STRING) || '''' WHEN 3 THEN 'Finished applying of 5 ''INSERT (5)'' events for table ''dbo''.''t' || CAST((n - 2) % 5 AS STRING) || '''' WHEN 5 THEN 'Bulk finished.' WHEN 6 THEN 'same' WHEN 7 THEN 'same' ELSE 'other ' || CAST(n % 3 AS STRING) END"
    raw = spark.range(1_000_000).selectExpr("id div 2000000 AS file_id", "id AS line_number", "id div 100000 AS split", "id AS n").selectExpr("file_id", "line_number", "split", f"'00001234: 2025-01-01T00:00:00 [TARGET_APPLY    ]T:  ' || {bodies} AS body")
    lines = R.fill_continuations(R.parse_prefix(raw), split="split")
    stored = S.written(lines)
    for make in (E.batches, E.table_apply_pairs, E.collapse_noise):
        one, two = make(stored), make(stored, split="split")
        digest = lambda df: df.select(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
        found = digest(one)
        assert found == digest(two) and found[0] > 10_000
    plan = E.time_gaps(lines, split="split")._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.rindex("Window") :]
    assert re.findall(r"hashpartitioning\(([^)]*)", first) and all("split" in x for x in re.findall(r"hashpartitioning\(([^)]*)", first))


def test_percentiles_by_buckets(spark):
    r = random.Random(2)
    data = {"a": [r.gauss(0, 1e6) for _ in range(999)], "b": [r.choice((-3.0, 0.0, 5.0)) for _ in range(500)], "c": [1.0], "d": [r.uniform(1, 1.0001) for _ in range(100)], None: [float("inf"), float("-inf"), 2.0, float("nan"), -1e300], "e": [-x for x in range(50)]}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("f", None)]
    got = {x.k: tuple(x)[1:] for x in S.floor_percentile(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", (0.0, 0.5, 0.95, 1.0), ("p0", "p50", "p95", "p100")).collect()}
    want = {}
    for k, vs in data.items():
        s = sorted(map(float, vs), key=lambda v: (math.isnan(v), v if not math.isnan(v) else 0))
        want[k] = (len(s), *[s[min(math.floor(len(s) * p), len(s) - 1)] for p in (0.0, 0.5, 0.95, 1.0)])
    assert str(sorted(got.items(), key=str)) == str(sorted(want.items(), key=str))
    ints = S.floor_percentile(spark.range(1001).select(F.lit(1).alias("k"), "id"), ["k"], "id", (0.5,), ("m",)).first()
    assert tuple(ints) == (1, 1001, 500)


def plain_neighbors(edges, anchor, hops, k):
    near = {}
    for a, b, w, p in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})
            near[x][y] = max(near[x].get(y, (-1, False, "")), (w, p == "EXTRACTED", p))
    best, front = {}, {anchor: 1.0}
    for hop in range(1, hops + 1):
        reached = {}
        for x, s in front.items():
            for y, (w, sure, p) in near.get(x, {}).items():
                if y != anchor:
                    reached[y] = max(reached.get(y, (-1, False, "")), (s * (1 if hop == 1 else 0.5) * w, sure, p))
        for y, (s, sure, p) in reached.items():
            best[y] = max(best.get(y, (-1, 0, False, "")), (s, -hop, sure, p))
        front = {y: v[0] for y, v in reached.items()}
    ranked = sorted(((-s, y, -h, p) for y, (s, h, _, p) in best.items()))[:k]
    return [(rank, y, -s, h, p) for rank, (s, y, h, p) in enumerate(ranked, 1)]


@pytest.mark.parametrize("heavy", [1.5, 2.5])
def test_neighbors_of_all_nodes(spark, heavy):
    r = random.Random(3)
    nodes = [f"n{i}" for i in range(40)]
    edges = list({(a, b): (a, b, r.choice((0.2, 0.5, 0.8, 1.0, heavy)), r.choice(("EXTRACTED", "INFERRED"))) for a, b in ((r.choice(nodes), r.choice(nodes)) for _ in range(90)) if a < b}.values())
    edges += [("hub", n, r.choice((0.5, 1.0)), "EXTRACTED") for n in nodes]
    df = spark.createDataFrame([(1, *e) for e in edges], "file_id long, src string, dst string, weight double, provenance string")
    anchors = spark.createDataFrame([(1, n) for n in [*nodes, "hub", "nowhere"]], "file_id long, anchor string")
    for hops, k in ((1, 4), (2, 5), (3, 6), (3, 100)):
        got = {}
        for x in G.neighbors(df, anchors, hops, k).collect():
            got.setdefault(x.anchor, []).append((x["rank"], x.node, round(x.score, 9), x.hop, x.provenance))
        want = {n: [(a, b, round(s, 9), h, p) for a, b, s, h, p in plain_neighbors(edges, n, hops, k)] for n in [*nodes, "hub"]}
        assert {n: sorted(v) for n, v in got.items()} == {n: v for n, v in want.items() if v}


def test_vector_topk_by_parts(spark, monkeypatch):
    r = random.Random(5)
    vectors = [(i, [float(r.randint(-3, 3)) for _ in range(4)], r.choice("xy")) for i in range(200)] + [(500, None, "x"), (501, [0.0] * 4, "x"), (502, [1.0, 2.0], "y"), (503, [1.0, None, 1.0, 1.0], "x")]
    queries = [(i, [float(r.randint(-3, 3)) for _ in range(4)], r.choice("xy")) for i in range(12)] + [(90, None, "x"), (91, [0.0] * 4, "x"), (92, [2.0, 1.0], "y"), (93, [1.0] * 4, None)]
    q, v = spark.createDataFrame(queries, "query_id long, q array<double>, kind string"), spark.createDataFrame(vectors, "id long, v array<double>, kind string").repartition(6)

    def near(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b or not any(a) or not any(b):
            return None
        return max(0.0, sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)))

    def plain(rows, same):
        out = []
        for i, a, kind in queries:
            found = sorted((-round(s, 9), j) for j, b, other in rows if (s := near(a, b)) is not None and (not same or (kind is not None and kind == other)))
            out += [(i, n, j, -s) for n, (s, j) in enumerate(found[:5], 1)]
        return sorted(out)

    monkeypatch.setattr(K, "QUERY_BLOCK", 5)
    for same in ([], ["kind"]):
        got = sorted((x.query_id, x["rank"], x.id, round(x.similarity, 9)) for x in K.vector_topk(q, v, 5, same).collect())
        assert got == plain(vectors, same)
    assert K.vector_topk(q.limit(0), v).count() == 0 and K.vector_topk(q, v.limit(0)).count() == 0
    merged = K.collections_topk(q, {"old": v.filter("id < 100"), "new": v.filter("id >= 100")}, 3).filter("query_id = 0").collect()
    assert len(merged) == 6 and {x.collection for x in merged} == {"old", "new"} and [x["rank"] for x in merged] == [1, 2, 3, 4, 5, 6]


def peak_mb(run, batch):
    """The most memory that a function of Arrow batches takes beside the batch."""
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


def test_tasks_hold_a_bounded_part_of_a_batch(spark, monkeypatch):
    kept, kind = [], type(spark.range(1))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, g=kind.mapInArrow, **k: kept.append(f) or g(self, f, *a, **k))
    v = spark.createDataFrame([(i, [float(i % 7), 1.0], "x") for i in range(300)], "id long, v array<double>, kind string")
    K.vector_topk(v.select(F.col("id").alias("query_id"), F.concat(*["v"] * 32).alias("q"), "kind"), v, 5, ["kind"])
    r = np.random.default_rng(1)
    batch = pa.record_batch([pa.array(range(10_000)), pa.array(list(r.normal(size=(10_000, 64)))), pa.array(["x"] * 10_000)], ["id", "v", "kind"])
    mb, rows = peak_mb(kept[-1], batch)
    assert rows == 300 * 5 and mb < 25
    K.clean_articles(spark.createDataFrame([("u", "x")], "url string, html string"))
    html = "<html><title>t</title><body>" + "<p>some words</p>" * 1000 + "</body></html>"
    mb, rows = peak_mb(kept[-1], pa.record_batch([pa.array(["u"] * 1000), pa.array([html] * 1000)], ["url", "html"]))
    assert rows == 1000 and mb < 12


def test_siblings_are_searched_once(spark):
    found = QUERIES["sibling_matches"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
