"""Operator 13: the cheapest edits that give a conversation the roles `(s?(ua)+)?`, by a dynamic program that keeps cost vectors only at checkpoints.

Rows of a conversation stand in the order of turn (nulls first), then role and text (their first 64 characters, then a digest of them). A row's first fault counts: blank (nothing but white space), duplicate (its role
and text were there before), truncated (does not end with . ! or ?). Edits: keep a row (0), give it the role user or assistant (3), delete it (4; blank
and duplicate rows must go), insert an empty row of user or assistant (3). A truncated row that stays costs 3 more. Of equally cheap edits, those whose
initials come first in ASCII are taken.

Four states say what the next role may be; what the rows from one on cost at least, by state, is a vector that follows from the one after it. Backwards, only
the vectors at every square root of a run's rows are kept; then each block is worked out again from its end, while the edits are read off forwards.

As Spark sees it: equal rows are counted first, so that a row repeated without end is one; rows are sorted over the whole table in range partitions, and a run is
what a partition has of a conversation. Conversations that lie in several partitions (fewer than there are partitions) send a matrix a run (what each
state at its begin costs for each at its end), by which the vectors at the ends of runs are found, and then the states that edits reach there. So a conversation
of any length is spread over tasks, none of which has more than a partition of it.

Nulls stand for one space, in any column; a conversation may have the id null. A table without rows gives none. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: States: nothing yet, after system, after user, after assistant; where the one legal user or assistant leads, and where a row with this initial does.
STEP = (2, 2, 3, 2)
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {2: "user", 3: "assistant"}
DELETE, OTHER, FAR = 4, 3, 1 << 60
#: Costs after the last row: what must be inserted.
LAST = (0, 6, 3, 0)
LEGAL = {"su", "ua", "au"}
ROWS_A_PIECE = 1000

PIECES = "conv_id {kind}, run int, piece int, audit string, cost long, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns long, first_initial string, last_initial string, n long, rows array<struct<role: string, text: string>>"


def before(v: tuple, initial: str, cut_off: bool) -> tuple:
    """The costs before a row that may stay, from those after it."""
    stay = OTHER * cut_off
    c = []
    for q in range(4):
        least = min(DELETE + v[q], OTHER + stay + v[STEP[q]])
        k = KEEP[q].get(initial)
        c.append(least if k is None else min(least, stay + v[k]))
    u, a = min(c[2], OTHER + c[3]), min(c[3], OTHER + c[2])
    return min(c[0], OTHER + u), min(c[1], OTHER + u), u, a


def walk(rows: list[tuple[str, bool]], end: tuple, state: int, last: bool) -> Iterator[tuple[int, str, int]]:
    """(row, edit, state after it) of the first of the cheapest edits; rows are (initial, truncated), end the costs after them. Only with last are edits after the last row made."""
    n = len(rows)
    block = max(1, math.isqrt(n))
    checkpoints = {n: end}
    v = end
    for i in range(n - 1, -1, -1):
        v = before(v, *rows[i])
        if i % block == 0:
            checkpoints[i] = v
    for a in range(0, n, block):
        z = min(n, a + block)
        costs = [checkpoints[z]]
        for i in range(z - 1, a - 1, -1):
            costs.append(before(costs[-1], *rows[i]))
        costs.reverse()
        for i in range(a, z):
            now, after, stay = costs[i - a], costs[i - a + 1], OTHER * rows[i][1]
            while True:
                k = KEEP[state].get(rows[i][0])
                if DELETE + after[state] == now[state]:
                    yield i, "D", state
                    break
                if OTHER + now[STEP[state]] == now[state]:
                    state = STEP[state]
                    yield i, "I", state
                    continue
                if k is not None and stay + after[k] == now[state]:
                    state = k
                    yield i, "K", state
                else:
                    state = STEP[state]
                    yield i, "R", state
                break
    while last and LAST[state]:
        state = STEP[state]
        yield n, "I", state


def matrix(rows: list[tuple[str, bool]]) -> list[int]:
    """What each state before the rows costs at least for each state after them."""
    columns = []
    for k in range(4):
        v = tuple(0 if q == k else FAR for q in range(4))
        for row in reversed(rows):
            v = before(v, *row)
        columns.append(v)
    return [min(columns[k][q], FAR) for q in range(4) for k in range(4)]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of the rows of conversations as the contract of op13 damages them; a dropped row has no copies."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    role = F.when(fate == 4, "user").when(fate == 0, "").otherwise(as_text("role"))
    text = F.when((fate == 0) | (fate == 1), "").when(fate == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"))


def lay_out(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with their fault and initial, in order: run is the range partition, pos the place in the table. Written and read again."""
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    once = rows.groupBy("conv_id", "turn", key.alias("key")).agg(F.min("role").alias("role"), F.min("text").alias("text"), F.sum("copies").alias("copies"))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = once.filter("copies > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("key").alias("_key")).agg(F.min(order).alias("_first"))
    both = once.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(blank, "blank").when(order != F.col("_first"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    marked = both.select("conv_id", "turn", "role", "text", "copies", "key", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))
    # bounds are sampled on the driver, so that their texts must be short
    order = ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), "key"]
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(dealt.select("conv_id", "turn", "role", "text", "copies", "fault", "initial", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("pos")))


def _stays(t: pa.Table) -> list[tuple[str, bool]]:
    """(initial, truncated) of the rows of a run that need not go, in order."""
    rows = sorted(t.select(["pos", "initial", "fault", "copies"]).to_pylist(), key=lambda r: r["pos"])
    return [(r["initial"], r["fault"] == "truncated") for r in rows if r["copies"] and r["fault"] not in ("blank", "duplicate")]


def _plan(laid: DataFrame, kind: str) -> DataFrame:
    """Of the runs of conversations that lie in several partitions: the costs after each, the state before it, and whether it is the last."""
    runs = laid.groupBy("conv_id", "run").agg(F.lit(1).alias("_1")).groupBy(F.col("conv_id").alias("_conv")).agg(F.count("*").alias("_n")).filter("_n > 1")
    # fewer conversations than partitions: each of them lies across a bound
    wide = laid.select("conv_id", "run", "pos", "initial", "fault", "copies").join(F.broadcast(runs), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv", "_n")

    def matrices(t: pa.Table) -> pa.Table:
        return t.slice(0, 1).select(["conv_id", "run"]).append_column("matrix", pa.array([matrix(_stays(t))], pa.list_(pa.int64())))

    def vectors(t: pa.Table) -> pa.Table:
        rows, v, out = sorted(t.to_pylist(), key=lambda r: -r["run"]), LAST, []
        for r in rows:
            out.append((r["run"], list(v), not out))
            v = tuple(min(r["matrix"][4 * q + k] + v[k] for k in range(4)) for q in range(4))
        ids = pa.array([r["conv_id"] for r in rows], t.schema.field("conv_id").type)
        return pa.table([ids, *(pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.list_(pa.int64()), pa.bool_())))], names=["conv_id", "run", "costs", "last"])

    def exits(t: pa.Table, plan: pa.Table) -> pa.Table:
        stays, (r,) = _stays(t), plan.to_pylist()
        reached = []
        for state in range(4):
            for _, _, after in walk(stays, tuple(r["costs"]), state, False):
                state = after
            reached.append(state)
        return plan.append_column("exits", pa.array([reached], pa.list_(pa.int32())))

    def entries(t: pa.Table) -> pa.Table:
        rows, state, out = sorted(t.to_pylist(), key=lambda r: r["run"]), 0, []
        for r in rows:
            out.append(state)
            state = r["exits"][state]
        kept = pa.Table.from_pylist(rows, t.schema)
        return kept.drop_columns(["exits"]).append_column("state", pa.array(out, pa.int32()))

    by_run = wide.groupBy("conv_id", "run")
    costs = by_run.applyInArrow(matrices, f"conv_id {kind}, run int, matrix array<long>").groupBy("conv_id").applyInArrow(vectors, f"conv_id {kind}, run int, costs array<long>, last boolean")
    reached = by_run.cogroup(costs.groupBy("conv_id", "run")).applyInArrow(exits, f"conv_id {kind}, run int, costs array<long>, last boolean, exits array<int>")
    return reached.groupBy("conv_id").applyInArrow(entries, f"conv_id {kind}, run int, costs array<long>, last boolean, state int")


def edits_of(rows: list[dict], end: tuple, state: int, last: bool) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(edit, its cost, new role, new text) of all edits of a run, in order; role and text are null where a row goes."""
    stays = [i for i, r in enumerate(rows) if r["copies"] and r["fault"] not in ("blank", "duplicate")]
    steps = walk([(rows[i]["initial"], rows[i]["fault"] == "truncated") for i in stays], end, state, last)
    gone = ("D", DELETE, None, None)
    done = 0
    for k, edit, after in steps:
        i = stays[k] if k < len(stays) else len(rows)
        # rows that must go, before the one that this edit is at
        for r in rows[done:i]:
            yield from (gone for _ in range(r["copies"]))
        done = max(done, i)
        if edit == "I":
            yield edit, OTHER, NAMES[after], ""
            continue
        r = rows[i]
        stay = OTHER * (r["fault"] == "truncated")
        yield gone if edit == "D" else (edit, stay, r["role"], r["text"]) if edit == "K" else (edit, OTHER + stay, NAMES[after], r["text"])
        yield from (gone for _ in range(r["copies"] - 1))
        done = i + 1
    for r in rows[done:]:
        yield from (gone for _ in range(r["copies"]))


def _pieces(names: list[str], kind: pa.DataType):
    types = (kind, pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 8, pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))

    def pieces_of(conv, run: int, rows: list[dict], plan: dict | None) -> Iterator[tuple]:
        here = [r for r in rows if r["copies"]]
        count = lambda f: sum(r["copies"] if r["fault"] == f else 0 for r in here)
        twice = sum(r["copies"] - 1 for r in here if r["fault"] not in ("blank", "duplicate"))
        cut_off = sum(r["fault"] == "truncated" for r in here)
        pairs = sum(a["initial"] + b["initial"] not in LEGAL for a, b in zip(here, here[1:])) + sum((r["copies"] - 1) * (2 * r["initial"] not in LEGAL) for r in here)
        turns = [r["turn"] for r in here if r["turn"] is not None]
        seen = (count("blank"), count("duplicate") + twice, cut_off, pairs, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), here[0]["initial"] if here else None, here[-1]["initial"] if here else None, sum(r["copies"] for r in here))
        none = (0, 0, 0, 0, None, None, 0, None, None, 0)
        marks, cost, out, piece = [], 0, [], 0
        for edit, price, role, text in edits_of(here, tuple(plan["costs"]) if plan else LAST, plan["state"] if plan else 0, plan["last"] if plan else True):
            marks.append(edit)
            cost += price
            if role is not None:
                out.append({"role": role, "text": text})
            if len(marks) >= ROWS_A_PIECE:
                yield conv, run, piece, "".join(marks), cost, *(none if piece else seen), out
                marks, cost, out, piece = [], 0, [], piece + 1
        if marks or not piece:
            yield conv, run, piece, "".join(marks), cost, *(none if piece else seen), out

    def run(laid: pa.Table, plan: pa.Table) -> pa.Table:
        plans = {r["conv_id"]: r for r in plan.to_pylist()}
        rows, out, a = laid.sort_by("pos").to_pylist(), [], 0
        while a < len(rows):
            z = a + 1
            while z < len(rows) and rows[z]["conv_id"] == rows[a]["conv_id"]:
                z += 1
            out += pieces_of(rows[a]["conv_id"], rows[a]["run"], rows[a:z], plans.get(rows[a]["conv_id"]))
            a = z
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(types), types)], names=names)

    return run


def repair(rows: DataFrame) -> DataFrame:
    """The edits of each conversation of rows (conv_id, turn, role, text, copies), in pieces by run and piece: their initials, what they cost, and the repaired rows.

    Every conversation has at least one piece. The first piece of a run also counts its faults, illegal neighbours and turns."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    laid = lay_out(rows)
    names = [x.split()[0] for x in PIECES.split(", rows")[0].split(", ")] + ["rows"]
    arrow = laid.select("conv_id").limit(0).toArrow().schema.field("conv_id").type
    return laid.groupBy("run").cogroup(_plan(laid, kind).groupBy("run")).applyInArrow(_pieces(names, arrow), PIECES.format(kind=kind))


def summarize(pieces: DataFrame) -> DataFrame:
    """One row a conversation: gaps, counts, cost, audit and the digest of its repaired rows. Pieces pass one by one, in order; a conversation's rows are never held together."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, ids = None, [], None

        def row() -> tuple:
            gaps = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
            return now["id"], gaps, *now["counts"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest()

        def batch() -> pa.RecordBatch:
            types = (ids, *[pa.int64()] * 6, pa.string(), pa.string())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), types)], [x.split()[0] for x in schema.split(", ")])

        for b in batches:
            ids = b.schema.field("conv_id").type
            for r in b.to_pylist():
                if now is None or now["id"] != r["conv_id"]:
                    if now is not None:
                        out.append(row())
                    now = {"id": r["conv_id"], "first": None, "last": None, "turns": 0, "counts": [0] * 4, "cost": 0, "audit": [], "sha": hashlib.sha256(), "initial": None, "empty": True}
                if r["turns"]:
                    now["turns"] += r["turns"] - (now["last"] == r["first_turn"])
                    now["first"] = r["first_turn"] if now["first"] is None else now["first"]
                    now["last"] = r["last_turn"]
                now["counts"] = [a + r[c] for a, c in zip(now["counts"], ("blank", "duplicate", "truncated", "illegal"))]
                if r["n"]:
                    now["counts"][3] += now["initial"] is not None and now["initial"] + r["first_initial"] not in LEGAL
                    now["initial"] = r["last_initial"]
                now["cost"] += r["cost"]
                now["audit"].append(r["audit"])
                for x in r["rows"]:
                    now["sha"].update(("" if now["empty"] else "\n").encode() + f"{x['role']}:{x['text']}".encode())
                    now["empty"] = False
            if len(out) >= 1000:
                yield batch()
                out = []
        if now is not None:
            out.append(row())
            yield batch()

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "run", "piece")
    return dealt.mapInArrow(run, schema)
