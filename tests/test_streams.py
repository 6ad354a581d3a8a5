"""A log cut into pieces over several micro-batches gives what the whole file gives, in whatever order the pieces come."""

import random

import pytest
from pyspark.sql import functions as F

from replog.operators import events as E
from replog.operators import parse as R
from replog.streaming import logs as ST


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def line(second, component, message):
    return f"00001234: 2025-06-15T10:{second // 60:02d}:{second % 60:02d} [{component:<16}]I:  {message}"


def log(seed, n=120):
    r, out = random.Random(seed), []
    for k in range(n):
        message = r.choice(("Going to start applying bulk changes", "Going to run INSERT statement from seq 3 to seq 9", "Bulk finished.", "Bulk finished.", "other"))
        out.append(r.choice((line(k * 5, "TARGET_APPLY", message), line(k * 5, "TARGET_APPLY", message), line(k * 5, "SORTER", message), "    more of it: Bulk finished.", "")))
    return out


def written_pieces(folder, logs, order):
    """Pieces of each log of about 25 lines, handed over one batch after another in the given order."""
    steps = []
    for name, lines in logs.items():
        cuts = [lines[a : a + 25] for a in range(0, len(lines), 25)]
        steps += [(k, name, part) for k, part in enumerate(cuts)]
    for k, name, part in sorted(steps, key=order):
        yield folder / f"{name}.{k:04d}.log", "\n".join(part) + "\n"


def run(spark, folder, logs, make, order, name):
    source = folder / f"in-{name}"
    source.mkdir()
    rows = None
    for n, (path, text) in enumerate(written_pieces(source, logs, order)):
        path.write_text(text)
        query = make(ST.stream_text(spark, str(source))).writeStream.format("parquet").option("path", str(folder / f"out-{name}")).option("checkpointLocation", str(folder / f"state-{name}")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        rows = n
    return spark.read.parquet(str(folder / f"out-{name}")) if rows is not None else None


def whole(spark, logs):
    raw = spark.createDataFrame([(name, k, b) for name, lines in logs.items() for k, b in enumerate(lines)], "file_id string, line_number long, body string")
    return R.fill_continuations(R.parse_prefix(raw))


def test_lines_over_micro_batches(spark, tmp_path, rocks):
    logs = {"a": log(1, 70), "b": log(2, 50)}
    columns = ["file_id", "line_number", "thread_id", "timestamp", "component", "is_continuation", "body"]
    want = sorted(map(tuple, whole(spark, logs).select(*columns).collect()), key=str)
    # the second piece of each log comes last
    got = run(spark, tmp_path, logs, lambda x: ST.fill_stream(x, "1 hour"), lambda s: (s[0] == 1, s[0], s[1]), "late")
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == want


def test_batches_over_micro_batches(spark, tmp_path, rocks):
    logs = {"a": log(3, 100)}
    want = sorted(map(tuple, E.batches(whole(spark, logs)).select("file_id", "line_number", "start_timestamp", "end_timestamp", "changes_count", "applies_count").collect()))
    assert want
    # a batch stays open, and much later lines of another log let time pass
    logs["a"] += [line(700, "TARGET_APPLY", "Going to start applying bulk changes"), line(701, "TARGET_APPLY", "Going to run INSERT statement from seq 1 to seq 2")]
    logs["z"] = [line(3500, "SORTER", "later")] * 26
    got = run(spark, tmp_path, logs, lambda x: ST.stream_text_batches(x, "1 minute", 60, 600), lambda s: (s[1], s[0]), "batches")
    ended = sorted(map(tuple, got.filter("closed = 'ended'").drop("closed").collect()))
    assert ended == want
    stale = got.filter("closed = 'stale'").select("file_id", F.date_format("start_timestamp", "HH:mm:ss"), "end_timestamp", "changes_count").collect()
    assert [tuple(r) for r in stale] == [("a", "10:11:40", None, 2)]
