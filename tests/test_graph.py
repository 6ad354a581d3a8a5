"""Compact edges: errors and batches of the same words without a row for each pair of lines."""

import pytest
from pyspark.sql import functions as F

from replog.operators import graph as G

ERRORS = "file_id long, line_number long, text string, component string, error_code string, thread_id string"


def tables(spark, n):
    errors = [(k % 2, k, f"failed on {('t1', 't2', 'T1 and t2', 'none')[k % 4]}", "C" if k % 3 else None, f"E{k % 5}", f"{k % 7}") for k in range(n)]
    batches = [(k % 2, 1000 + k, [("dbo.t1",), ("dbo.t2", "x.t1"), ("dbo.t9",)][k % 3]) for k in range(n)]
    return spark.createDataFrame(errors, ERRORS), spark.createDataFrame(batches, "file_id long, line_number long, tables array<string>")


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_compact_edges_are_all_edges(spark):
    errors, batches = tables(spark, 60)
    compact = G.compact_edges(errors, batches)
    cols = ("file_id", "src", "dst", "edge_type", "weight", "provenance")
    assert rows(G.expand_edges(compact), *cols) == rows(G.error_edges(errors, batches), *cols)
    pairs = {(e.file_id, e.line_number, b.line_number) for e in errors.collect() for b in batches.collect() if e.file_id == b.file_id and {t.split(".")[1] for t in b.tables} & set(e.text.lower().split())}
    assert len(pairs) > 500 and {(f, int(s[6:]), int(d[6:])) for f, s, d, t, *_ in rows(G.expand_edges(compact), *cols) if t == "same_batch"} == pairs
    plain = G.error_edges(errors, batches).groupBy("file_id", "edge_type", "provenance").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    assert [(*r[:4], round(r[4], 6)) for r in rows(G.edge_counts(compact), *plain.columns)] == [(*r[:4], round(r[4], 6)) for r in rows(plain, *plain.columns)]


def test_compact_edges_grow_with_lines(spark):
    count = lambda n: G.compact_edges(*tables(spark, n)).filter("edge_type <> 'co_occurs'").count()
    assert count(400) < 2.2 * count(200)


@pytest.mark.parametrize("k", [2, 7, 30])
def test_neighbors_over_compact_edges(spark, k):
    errors, batches = tables(spark, 60)
    anchors = errors.select("file_id", F.concat(F.lit("error:"), "line_number").alias("anchor"))
    cols = ("file_id", "anchor", "rank", "node", "score", "hop", "provenance")
    found = rows(G.neighbors(G.compact_edges(errors, batches), anchors, 3, k), *cols)
    assert found and found == rows(G.neighbors(G.error_edges(errors, batches), anchors, 3, k), *cols)
