"""Lines numbered and filled over splits, and operators that go over them."""

import pytest

from replog.operators import events as E
from replog.operators import parse as R
from replog.operators import questions as QU
from replog.sources import synth

SF = "/root/testdata/sf0.001"


def rows(df, *without):
    return sorted(map(str, df.drop(*without).collect()))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(synth, "SPLIT", 64)


@pytest.mark.parametrize("make, sql, table", [(synth.placed_lines, synth.LINES_SQL, "events"), (synth.placed_loads, synth.LOAD_SQL, "orders")])
def test_numbered_over_splits(spark, small, make, sql, table):
    placed = make(spark, SF)
    assert rows(placed, "split") == rows(spark.sql(sql, **{table: spark.read.parquet(f"{SF}/{table}.parquet")}))
    per = placed.groupBy("file_id", "split").agg({"line_number": "min"}).orderBy("file_id", "split").collect()
    assert len(per) > 16 and all(a[2] < b[2] for a, b in zip(per, per[1:]) if a.file_id == b.file_id)


def test_operators_over_splits(spark, small):
    for make, operators in ((synth.placed_lines, (E.table_stats,)), (synth.placed_loads, (E.file_operations, E.upload_tables))):
        own = R.parse_prefix(make(spark, SF))
        whole, placed = R.fill_continuations(own.drop("split")), R.fill_continuations(own, "split", True)
        assert rows(placed, "split") == rows(whole)
        for operator in operators:
            found = rows(operator(placed, split="split"))
            assert found and found == rows(operator(whole))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_uploads_parse_lines_once(spark, small):
    placed = R.fill_continuations(R.parse_prefix(synth.placed_loads(spark, SF)), "split", True)
    assert "body" in plan(R.parse_file_ops(placed, "split")) and "body" not in plan(E.upload_tables(placed, "split"))


def test_equal_questions_are_classified_once(spark):
    own = spark.createDataFrame([(k, k % 2, q) for k, q in enumerate([*["How many errors are there?"] * 300, *["top tables"] * 300, None, "nothing"])], "question_id long, file_id long, question string")
    facts = spark.createDataFrame([(0, "COUNT", "errors", 0, "errors", 7), (1, "TOP", "top_tables", 1, "t", 3)], "file_id long, type string, entity string, place int, label string, value long")
    got = QU.answer(own, facts)
    want = QU.classify(own).join(facts, ["file_id", "type", "entity"]).select(got.columns)
    assert rows(got) == rows(want) and got.count() == 300
    # no pattern is looked for in rows of questions
    scans = [part for part in plan(got).split("\n") if "RLIKE" in part]
    assert scans and all("question_id" not in part for part in scans)


def test_parts_grow_with_rows(spark, monkeypatch):
    # no part holds much more than the rows of some splits, however few shuffle partitions there are
    monkeypatch.setattr(synth, "SPLIT", 16)
    placed = synth.placed_lines(spark, SF)
    total = spark.read.parquet(f"{SF}/events.parquet").count()
    assert placed.rdd.getNumPartitions() == 1 + total // 16
