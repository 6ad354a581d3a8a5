"""Each corpus operator on a small table with nulls, empty and long texts, copies and clashing columns, against a plain version."""

import collections
import hashlib
import math
import random
import re
import string
import tracemalloc

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from replog.llm import byte_bpe, fingerprints, language, minhash, mixing, neighbours, quality, substrings, token_counts, toxicity
from replog.llm import queries as Q
from replog.llm.components import components, fewer_links

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, block string"
SF = "/root/testdata/sf0.001"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeo") for _ in range(r.randint(1, 8))) for _ in range(n))


BASE = words(300, 1)
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace(" ", "\n", 7), "en", "b"), (4, None, None, None), (5, "", "de", "b"), (6, " \n\t ", "de", "b"), (7, "one two", "en", "c"), (8, "One  TWO", "en", "c"),
    (9, words(40_000, 2), "en", "a"), (10, words(120, 3) + " " + " ".join(BASE.split()[50:120]) + " " + words(100, 4), "fr", None), (11, "x" * 30_000, "fr", "a"), (12, "漢字" * 900, "zh", "a"), (13, "123 !!! ---", "en", "b"), (13, "123 !!! ---", "en", "b"),
    (14, " ".join(BASE.split()[:280] + ["end"]), "en", "b"), (None, "no id here", "en", "b"), (None, BASE, "en", "a"), (15, "Ünïcode 's text's end\x1c\x85 ▁a", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 0.5, 1, "x") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_fingerprint(text):
    # each walk by itself, a character at a time, with the embedding written out
    stay, place, steps, out = fingerprints.stays(), fingerprints.places(), fingerprints.sample_steps(), []
    code = [ord(c) for c in text]
    mul = lambda x, y: (x * y) & 0xFFFFFFFF
    for w in range(fingerprints.WALKS):
        written, j = [], 0
        for i, c in enumerate(code):
            n = int(stay[(j + int(place[mul(c, 0x9E3779B1) >> 24, w])) % fingerprints.PERIOD])
            written += [i] * n
            j += n
        for s in range(fingerprints.PER_WALK):
            step = max(x for x in steps[w * fingerprints.PER_WALK + s].tolist() if x < len(written))
            x = 0
            for k in range(5, -1, -1):
                x = mul(x + code[min(written[step] + k, len(code) - 1)], 0x9E3779B1)
            x ^= mul(step, 0x27D4EB2F)
            out.append(mul(x ^ x >> 15, 0x2C1B3C6D) >> 16)
    return "".join(v.to_bytes(2, "little").hex() for v in out)


def test_fingerprints(docs, empty):
    rows = sorted((r for r in ROWS if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    got = sorted(fingerprints.compare_with_next(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_chars))
    follow = [(r, rows[(k + 1) % len(rows)][1] or "") for k, r in enumerate(rows)] + [(r, "") for r in sorted((r for r in ROWS if r[0] is None), key=lambda r: len(r[1]))]
    want = []
    for r, s in follow:
        t = r[1] or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + s[:cut]
        want.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(e)))
    assert [tuple(r)[:5] for r in got] == want
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0 and by[9].near_edited > 0.6 and by[9].near_next < 0.1
    near = {r.doc_id: r.class_id for r in fingerprints.near_documents(docs.filter("doc_id is not null")).collect()}
    assert near[2] == 1 and near[1] == 1
    assert fingerprints.compare_with_next(empty).count() == 0 and fingerprints.fingerprints(empty).count() == 0
    assert fingerprints.fingerprints(docs).count() == len(ROWS)


def test_walks_together_and_alone():
    some = [BASE, "", "a", "漢字" * 90, words(30, 3), "x" * 700, "Ünïcode \U0001f600 text", *[words(20 + k, k) for k in range(12)]]
    assert fingerprints.marks(some) == [fingerprints.fingerprint(t) for t in some]
    assert [fingerprints.fingerprint(t) for t in some if t] == [plain_fingerprint(t) for t in some if t]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edits_within():
    r = random.Random(8)
    for k in range(400):
        a = "".join(r.choice("abc") for _ in range(r.choice((0, 1, 5, 40, 200, 300))))
        b = list(a)
        for _ in range(r.choice((0, 1, 3, 10, 30))):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 2)] = r.choice(("", "a", "bc"))
        b = "".join(b) if k % 5 else "".join(r.choice("abc") for _ in range(r.randint(0, 200)))
        n = edits(a, b)
        for most in {0, n // 2, n - 1, n, n + 1, 2 * n} - {-1}:
            assert fingerprints.within(fingerprints.code_points(a), fingerprints.code_points(b), most) == (n <= most), (a, b, most, n)


def near_by_plain_means(rows):
    """class_id, near_id, links and component_id by all pairs: likeness, or a shared bucket and the texts' edits."""
    mark = {i: fingerprints.fingerprint(t or "") for i, t in rows}
    text = {i: t or "" for i, t in rows}
    first = {m: min(i for i in mark if mark[i] == m) for m in mark.values()}
    ids, near, head = sorted(first.values()), collections.defaultdict(set), {}
    for i in ids:
        for w in range(fingerprints.WALKS):
            for k in range(fingerprints.BANDS):
                slots = [mark[i][4 * s : 4 * s + 4] for s in range(w * fingerprints.PER_WALK + 2 * k, w * fingerprints.PER_WALK + 2 * k + 2)]
                head.setdefault((w, k, *slots), []).append(i)
    for a in ids:
        near[a] |= {b for b in ids if a != b and fingerprints._like(mark[a], mark[b]) >= 0.75}
    def reached(a):
        todo, seen = [a], {a}
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    alike = {a: reached(a) for a in ids}
    for members in head.values():
        for b in members[1:]:
            a = members[0]
            if alike[a] != alike[b] and 0.03 <= fingerprints._like(mark[a], mark[b]) < 0.75 and b not in near[a] and edits(text[a], text[b]) <= int(0.05 * max(len(text[a]), len(text[b]))):
                near[a].add(b)
                near[b].add(a)
    reach = {a: reached(a) for a in ids}
    return {i: (c, min(near[c], default=None), len(near[c]), reach[c]) for i, m in mark.items() for c in [first[m]]}, near


def test_near_documents(spark, empty, monkeypatch):
    # a template whose least like copy has the smallest id
    base = words(150, 31).split()
    r, rows = random.Random(5), []
    for i in range(40):
        own = list(base)
        for _ in range(25 if i == 0 else r.choice((1, 2, 4, 8))):
            own[r.randrange(len(own))] = words(1, 9000 + r.randrange(5000))
        rows.append((i, " ".join(own)))
    rows += [(100, rows[7][1]), (101, words(200, 32)), (102, None), (103, "moved to the front of it " + rows[3][1])]
    want, near = near_by_plain_means(rows)
    assert sum(bool(v) for v in near.values()) > 20 and any(len(v) < 30 for v in near.values() if v)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block, pairs in ((1024, 1000), (8, 2)):
        monkeypatch.setattr(fingerprints, "BLOCK", block)
        monkeypatch.setattr(fingerprints, "HEAD_PAIRS", pairs)
        got = {x.doc_id: (x.class_id, x.near_id, x.links, x.component_id) for x in fingerprints.near_documents(df).collect()}
        assert got == want
    assert fingerprints.near_documents(empty).count() == 0


def test_alike_classes(spark, monkeypatch):
    # a chain, each link like the one before: all are of one cluster, and few are compared
    r = np.random.default_rng(3)
    chain = [r.integers(0, 65536, fingerprints.SLOTS, dtype=np.uint16)]
    for _ in range(199):
        chain.append(chain[-1].copy())
        at = r.choice(fingerprints.SLOTS, 24, False)
        chain[-1][at] = r.integers(0, 65536, len(at))
    marks = [(i, x.tobytes().hex()) for i, x in enumerate(chain)]
    own = spark.createDataFrame(marks, "class_id long, fingerprint string").repartition(3)
    x = np.stack(chain)
    for least, width, block, parcel in ((0.75, 4, 1024, 4096), (0.75, 4, 3, 8), (0.5, 2, 1024, 64), (0.45, 1, 1024, 4096)):
        monkeypatch.setattr(fingerprints, "BLOCK", block)
        monkeypatch.setattr(fingerprints, "PARCEL", parcel)
        assert fingerprints.sure_width(least) == width
        want = {(i, j) for i in range(len(x)) for j in np.flatnonzero(fingerprints.alike(x, x[i]) >= least).tolist() if i != j}
        rows = fingerprints.alike_classes(own, least, "long").collect()
        links, near = collections.Counter(), {}
        for one in rows:
            links[one.class_id] += one.links
            near[one.class_id] = min(near.get(one.class_id, one.near_id), one.near_id)
        assert want and links == collections.Counter(i for i, _ in want)
        assert near == {i: min(j for k, j in want if k == i) for i in links}
    compared, plainly = [], fingerprints.alike
    monkeypatch.setattr(fingerprints, "alike", lambda a, b: compared.append(len(a)) or plainly(a, b))
    keys = [(i, n, hash((n, bytes(v)))) for i, row in enumerate(x) for n, v in enumerate(row.reshape(-1, 4))]
    group = pa.table({"class_id": [i for i, _, _ in keys], "band": pa.array([n for _, n, _ in keys], pa.int32()), "key": [k for _, _, k in keys], "mark": [x[i].tobytes() for i, _, _ in keys], **{c: pa.array([0] * len(keys), pa.int32()) for c in ("block", "low", "high")}})
    found = fingerprints._verify(0.75, 4)(group)
    assert sum(compared) < 10 * len(x) and found.num_rows > 100


def test_near_documents_recall(spark):
    # all pairs of a given table: those within a twentieth of edits are found, and whatever is linked has much in common
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    codes = {i: fingerprints.code_points(t) for i, t in text.items()}
    count = {i: np.bincount(c % 512, minlength=512) for i, c in codes.items()}
    got = {r.doc_id: r for r in fingerprints.near_documents(docs).collect()}
    ids = sorted({r.class_id for r in got.values() if text[r.class_id]})
    table = np.stack([count[i] for i in ids])
    want = found = 0
    for k, i in enumerate(ids):
        size = np.array([len(codes[j]) for j in ids[:k]])
        apart = np.maximum(np.maximum(table[:k] - table[k], 0).sum(1), np.maximum(table[k] - table[:k], 0).sum(1))
        close = np.flatnonzero(apart <= 0.05 * np.maximum(size, len(codes[i])))
        some = [ids[j] for j in close if fingerprints.within(codes[ids[j]], codes[i], int(0.05 * max(len(codes[ids[j]]), len(codes[i]))))]
        want += bool(some)
        found += any(got[j].component_id == got[i].component_id for j in some)
    assert want > 5 and found >= 0.9 * want
    for r in got.values():
        if r.near_id is not None:
            a, b = codes[r.class_id], codes[r.near_id]
            assert fingerprints.within(a, b, int(0.5 * max(len(a), len(b))))


def test_token_counts(docs, empty):
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = collections.Counter((r[0], len((r[1] or "").encode()), len(m.encode(r[1] or "")), len(m.encode(r[1] or "")) > 4096) for r in ROWS)
    assert collections.Counter(map(tuple, token_counts.count_tokens(docs).collect())) == want
    assert token_counts.count_tokens(empty).count() == 0
    count = token_counts.PieceCounter(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()).count
    r, marks = random.Random(0), [" ", " ", "\n", "\t", "a", "th", "▁", "é", "漢", "<s>", "\x00", "1"]
    for _ in range(3000):
        t = "".join(r.choice(marks) for _ in range(r.randint(0, 14)))
        assert count(t) == len(m.encode(t)), t


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((r[0], size(r[1])) for r in ROWS)
    assert all(0 <= r.copies <= 3 for r in got) and all(r.copies == 0 for r in got if r["size"] == 0)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    per = {r.source: (r.source_size, r.target) for r in got}
    total = sum(s for s, _ in per.values())
    assert abs(sum(t for _, t in per.values()) - total) < 1e-6 * total and all(t <= 3 * s + 1e-9 for s, t in per.values())
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("source"))
    near = mixing.mix(many, block=256).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 0.01 * r.g + 50 for r in near)
    sampled = mixing.sample_documents(many, block=256)
    assert sampled.columns == many.columns and sampled.count() == mixing.mix(many, block=256).agg(F.sum("copies")).first()[0]
    assert mixing.mix(empty).count() == 0 and mixing.sample_documents(empty).columns == empty.columns
    copies = spark.createDataFrame([(1, "a b c", "s")] * 4 + [(2, "d e", "t")] * 3, "doc_id long, text string, source string")
    assert mixing.mix(copies).count() == 7


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mixing_meets_targets(spark, sf):
    rows = mixing.mix(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect()
    texts = dict(duckdb.sql(f"select doc_id, text from '/root/testdata/{sf}/documents.parquet'").fetchall())
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) for r in rows}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.copies <= 3 for r in rows)
    sums, taken, goal = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sums[r.source] += r["size"]
        taken[r.source] += r.copies * r["size"]
        goal[r.source] = r.target
    # plain water filling: share what is left by weight, until none is above its limit
    order = sorted(sums, key=lambda x: (x is None, x or ""))
    weight, open_, left, want = {x: (1, 2, 3)[k % 3] for k, x in enumerate(order)}, set(order), float(sum(sums.values())), {}
    while open_:
        level = left / sum(weight[x] for x in open_)
        full = {x for x in open_ if weight[x] * level > 3 * sums[x]}
        for x in full or open_:
            want[x] = 3.0 * sums[x] if full else weight[x] * level
        left -= sum(want[x] for x in full)
        open_ -= full or set(open_)
    assert all(abs(goal[x] - want[x]) < 1e-6 * (1 + want[x]) for x in order)
    assert all(abs(taken[x] - goal[x]) <= 0.005 * goal[x] for x in order)


def test_sampled_copies_keep_their_source(spark):
    # one id and text under two sources, and columns that clash with the operator's own
    rows = [(1, "a b c d", "s", 1), (1, "a b c d", "t", 2), (2, "e f", "s", 3), (3, "g h i", "t", 4), (3, "g h i", "t", 5), (4, "k", None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _k1 int").withColumn("_size", F.lit("x"))
    copies = collections.Counter()
    for r in mixing.mix(df).collect():
        copies[r.doc_id, r.source] += r.copies
    got = mixing.sample_documents(df)
    assert got.columns == df.columns and set(got.collect()) <= set(df.collect())
    assert collections.Counter((r.doc_id, r.source) for r in got.collect()) == +copies


def test_neighbours(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(700, 16)).round(3)
    x[100:120] = x[100]
    rows = [(int(i), [float(v) for v in x[i]], 1) for i in range(len(x))] + [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [1.0, None] * 8, 1), (2060, [float("nan")] * 16, 1), (2080, [1.0, 2.0], 1), (3, [float(v) for v in x[3]], 1), (2100, [], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for q in sorted(neighbours.search(df, F.col("vec_id") % 20 == 0, 20).collect(), key=lambda q: (q.query_id, q["rank"])):
        got[q.query_id].append((q.vec_id, q.score))
    ids = np.array([*range(700), 3])
    y = np.array([*x, x[3]]).astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 700, 20):
        s = (y * y[q]).sum(1)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        hits += len({(int(ids[k]), float(s[k])) for k in order} & set(got[q]))
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert hits >= 0.97 * 35 * 20 and set(got) == set(range(0, 700, 20))
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = {q.query_id for q in neighbours.search(spark.createDataFrame([(20, [1.0, 2.0]), (21, [1.0, 0.5])], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()}
    assert few == {20}


def test_neighbours_of_few(spark):
    r = np.random.default_rng(1)
    ids = np.arange(21)
    for _ in range(300):
        x = r.normal(size=(21, 16))
        mean = x.mean(0)
        found = neighbours.best(ids, x, *neighbours.codes(x, mean), mean, ids, x, 20)
        assert [len(v) for v in found[1]] == [20] * 21
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in ids], "vec_id long, embedding array<double>")
    assert {q["count"] for q in neighbours.search(df, F.lit(True), 20).groupBy("query_id").count().collect()} == {20}


def test_byte_bpe(spark, docs, empty):
    data = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    enc = byte_bpe.encoder(data, public_tokenizers.PATTERN)
    want = collections.Counter((r[0], tuple(enc.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in ROWS)
    got = byte_bpe.decode(byte_bpe.encode(docs, block_chars=30_000)).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    both = byte_bpe.encode(docs, block_chars=30_000, decoded=True).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in both) == want
    assert byte_bpe.encode(empty).count() == 0
    # a block that is not read alike twice
    w = pa.table({"part": [0], "mark": [1]})
    with pytest.raises(ValueError, match="alike"):
        byte_bpe._reassemble(w, pa.table({"mark": [2]}), None)
    r, marks = random.Random(1), [" ", " ", "\n", "a", "b'", "'s", "1", "!", "\x1c", "\x85", "é", "漢", "　"]
    ts = ["".join(r.choice(marks) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    s = byte_bpe.Splitter(public_tokenizers.PATTERN)
    flat = [w for part in s.words(ts, 3) for w in part]
    assert [[i for k in d for i in enc._core_bpe.encode_single_piece(flat[k])] for d in s.places(ts, 3)] == [enc.encode_ordinary(t) for t in ts]


def test_toxicity(spark, docs, empty):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, words(60, i) + (" " + " ".join(r.sample(["vile", "scorn", "loath", "wretch"], 2)) if bad else ""), 1))
        labels.append((i, 1, int(bad)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    index = model.index
    got = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    held = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.95 and all(0 <= x.score <= 1 for x in got.values())
    assert not set(held) & set(index.ids.tolist())
    # the nearest are those of all exact cosines over every term that two examples share, from their texts alone
    seen = {i: collections.Counter(re.findall(r"[^\W_]+", t.lower())) for i, t, _ in rows}
    own = [i for i in range(400) if i not in held]
    df_own, toxic = collections.Counter(), collections.Counter()
    for i in own:
        df_own.update(seen[i].keys())
        toxic.update(seen[i].keys() if i % 4 == 0 else ())
    weight = {t: (math.log(401 / (1 + sum(t in s for s in seen.values()))) + 1) * math.log2(2 + toxic[t] / max(1, n - toxic[t])) for t, n in df_own.items() if n > 1}
    vector = lambda i: {t: (1 + math.log(n)) * weight[t] for t, n in seen[i].items() if t in weight}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    mine = {i: vector(i) for i in range(400)}
    for i in (0, 1, 4, 8, 77, 399):
        cosine = {j: sum(x * mine[j].get(t, 0) for t, x in mine[i].items()) / norm(mine[i]) / norm(mine[j]) for j in own}
        assert np.allclose(sorted(cosine.values(), reverse=True)[:16], got[i].cosines) and np.allclose([cosine[j] for j in got[i].nearest], got[i].cosines)
    assert toxicity.score(docs, model).count() == len(ROWS) and toxicity.score(empty, model).count() == 0
    none = toxicity.train(df, lab.limit(0))
    assert {x.score for x in toxicity.score(docs, none).collect()} == {0.0}
    twice = toxicity.train(df.unionByName(df), lab.unionByName(lab))
    assert twice.index.ids.tolist() == index.ids.tolist()


def test_toxicity_blocks(monkeypatch):
    monkeypatch.setattr(toxicity, "GROUP", 3)
    # long posting lists, of which only the heaviest blocks can matter
    r = np.random.default_rng(3)
    weights = toxicity.Weights([str(t) for t in range(60)], np.ones(60))
    vectors = []
    for j in range(3000):
        at = np.sort(r.choice(60, 12, replace=False)).astype(np.int32)
        v = r.exponential(size=12) ** 3
        vectors.append((at, v / np.sqrt((v * v).sum())))
    index = toxicity.build(weights, np.arange(3000), np.zeros(3000), vectors)
    dense = np.zeros((3000, 60))
    for j, (at, v) in enumerate(vectors):
        dense[j, at] = v
    for j in range(0, 3000, 30):
        cosine = dense @ dense[j]
        near, found = index.nearest(*vectors[j], 16)
        assert np.allclose(np.sort(cosine)[::-1][:16], found) and np.allclose(cosine[near], found) and near[0] == j
    assert index.blocks[1] > 0.02 * sum(index.blocks)


def test_toxicity_common_terms():
    # words that most examples hold, with weights much alike, beside rare ones: only lists of the rare ones are read
    r = random.Random(9)
    common, rare = [f"common{k}" for k in range(80)], [f"rare{k}" for k in range(500)]
    vocabulary = sorted({*common, *rare})
    weights = toxicity.Weights(vocabulary, np.linspace(1, 2, len(vocabulary)))
    made = [" ".join(r.sample(common, 30) + r.sample(rare, 5)) for _ in range(1500)]
    vectors = [weights.vector(t) for t in made]
    index = toxicity.build(weights, np.arange(1500), np.zeros(1500), vectors)
    dense = np.zeros((1500, len(vocabulary)))
    for j, (at, v) in enumerate(vectors):
        dense[j, at] = v
    asked = [*made[:150], "", "unknown", common[0], rare[0]]
    for t, (near, found) in zip(asked, index.search(asked, 16), strict=True):
        at, v = weights.vector(t)
        cosine = dense[:, at] @ v
        want = np.lexsort((np.arange(1500), -np.round(cosine, 12)))[: min(16, np.count_nonzero(cosine))]
        assert np.allclose(cosine[want], found) and np.allclose(cosine[near], found) and (cosine[near] > 0).all()
    # each of a text's five rare lists has one block; the thirty common ones would have hundreds
    assert len(index.common[1]) == len(set(common)) and sum(index.blocks) <= 6 * len(asked)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_has_neighbours(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    found = Q.op6_toxicity(spark, sf_dir).select("doc_id", "held_out", "predicted", F.size("nearest").alias("n")).collect()
    assert np.mean([x.n > 0 for x in found]) >= 0.95
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{sf_dir}/labels.parquet'").fetchall())
    held = [(x.predicted, truth[x.doc_id]) for x in found if x.held_out and x.doc_id in truth]
    assert np.mean([p == y for p, y in held]) > max(np.mean([y for _, y in held]), 1 - np.mean([y for _, y in held]))


def test_substrings(spark, docs, empty):
    passage = words(70, 77)
    own = [(i, f"{words(200, 1000 + i)} {passage if i % 3 == 0 else ''} {words(150, 2000 + i)}", 5) for i in range(30)]
    df = spark.createDataFrame(own, "doc_id long, text string, removed int").repartition(4).withColumnRenamed("removed", "place")
    got = {r.doc_id: r for r in substrings.deduplicate(df, block=4000).collect()}
    middle = " ".join(passage.split()[20:50])
    assert middle in got[0].text and got[0].removed == []
    for i, t, _ in own:
        assert (middle in got[i].text) == (i == 0)
        cut = got[i].removed
        assert got[i].text == "".join(t[a:b] for a, b in zip([0, *(s["end"] for s in cut)], [*(s["start"] for s in cut), len(t)]))
        assert not cut or (set(got[i].earlier_doc_ids) <= set(range(0, i, 3)) and got[i].earlier_doc_ids)
        assert i % 3 == 0 or got[i].text == t
    out = substrings.deduplicate(docs)
    assert out.columns == [*docs.columns, "removed", "earlier_doc_ids"] and out.count() == len(ROWS)
    by = {(r.doc_id, k): r.text for k, r in enumerate(out.collect())}
    assert next(v for (i, _), v in by.items() if i == 4) is None and [v for (i, _), v in by.items() if i == 13] == ["123 !!! ---"] * 2
    assert substrings.deduplicate(empty).count() == 0
    for t in ("", " ", "漢" * 3000, "a" * 5000, "é " * 2000, words(50, 1)):
        code = np.frombuffer(t.encode(), np.uint8)
        e = substrings.ends(code)
        assert b"".join(code[a:b].tobytes() for a, b in zip([0, *e[:-1]], e)).decode() == t if t else not len(e)


def test_substrings_without_spaces(spark):
    r = random.Random(8)
    han = lambda n: "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n))
    base64 = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    for make, n in ((han, 1800), (han, 300), (base64, 3000), (base64, 600)):
        passage = make(n)
        own = [(i, make(300 + 40 * i) + passage + make(500)) for i in range(2)] + [(2, make(2000))]
        got = {x.doc_id: x for x in substrings.deduplicate(spark.createDataFrame(own, "doc_id long, text string").repartition(2)).collect()}
        middle = passage[n // 3 : n // 2]
        assert middle in got[0].text and got[0].removed == [] and got[2].text == own[2][1]
        assert middle not in got[1].text and got[1].earlier_doc_ids == [0]
        assert got[1].text.startswith(own[1][1][:340]) and got[1].text.endswith(own[1][1][-500:])
    assert substrings.worth("漢字".encode() * 15) == 15 and substrings.worth(b"some words, all of them short") == 6


def test_quality(docs, empty, spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, (words(80, i).upper().replace(" ", "!! ") if i % 5 == 0 else words(80 + r.randint(0, 50), i)), 1) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = quality.train(df, labels)
    got = {x.doc_id: x for x in quality.score(df, model).collect()}
    assert np.mean([got[i].predicted == int(i % 5 != 0) for i in range(600)]) > 0.95 and 0.7 < model.prior < 0.9
    assert quality.score(docs, model).count() == len(ROWS) and quality.score(empty, model).count() == 0
    assert {x.score for x in quality.score(docs, quality.train(df, labels.limit(0))).collect()} == {0.5}
    # an id that repeats is learned from once
    many = df.unionByName(df.filter("doc_id = 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("k"))
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, u: seen.append((len(p), len(u))) or model)
    quality.train(many, labels, sample=100)
    assert seen[0][0] <= 100 and seen[0][1] <= 150


def brute_groups(rows):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets, root = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i], root[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set(), i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates(spark, docs, empty, monkeypatch):
    r, own = random.Random(8), []
    for g in range(12):
        text = words(90, 500 + g).split()
        for k in range(r.choice([1, 2, 9, 60])):
            t = list(text)
            for _ in range(r.randint(0, 5)):
                t[r.randrange(len(t))] = "zz"
            own.append((len(own), " ".join(t)))
    df = spark.createDataFrame([(i, t, 1) for i, t in own], "doc_id long, text string, n int")
    want = brute_groups(own)
    assert {x.doc_id: tuple(x)[1:] for x in minhash.near_groups(df).collect()} == want
    # clusters of several blocks are linked across them
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert {x.doc_id: tuple(x)[1:] for x in minhash.near_groups(df).collect()} == want
    unique = [(r[0], r[1]) for r in ROWS if r[0] is not None and r[0] != 13]
    got = {x.doc_id: tuple(x)[1:] for x in minhash.near_groups(docs).collect() if x.doc_id is not None}
    assert {i: v for i, v in got.items() if i != 13} == brute_groups(unique) and got[4] == (0, 4, True)
    assert minhash.near_groups(docs).count() == len(ROWS) and minhash.near_groups(empty).count() == 0
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 13").count() == 1 and kept.filter("doc_id in (2, 3)").count() == 0 and kept.filter("doc_id is null").count() == 2


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[103] == 100 and components(edges.limit(0)).count() == 0


def test_language(spark, docs, empty):
    vocabulary = {"aa": "the and of in that".split(), "bb": "der und das nicht ein".split(), "cc": "le la et les des".split()}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(vocabulary[k]) for _ in range(30)), k, 1) for i, k in enumerate(list(vocabulary) * 100)] + [(900, None, "aa", 1), (901, "12 !!", "bb", 1), (902, "the der le", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language.fit(df, language.learnable())
    got = {x.doc_id: x for x in language.identify(df, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k, _ in rows[:300]]) == 1.0
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].rejected and got[902].lang_pred in vocabulary and not any(got[i].rejected for i in range(300))
    assert language.identify(docs, model).count() == len(ROWS) and language.identify(empty, model).count() == 0
    own = df.withColumn("url", F.lit("u")).withColumn("lang_pred", F.lit(1)).withColumn("_text", F.lit(2.0))
    kept = language.recognised(own, model)
    assert kept.columns == own.columns and {r.doc_id for r in kept.collect()} == {i for i, x in got.items() if not x.rejected} and {r.score for r in kept.collect()} == {1}
    # what held-out rows say or hold changes nothing for others
    held = [i for i in got if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    other = df.withColumn("text", F.when(F.col("doc_id").isin(held), F.lit("zyx wvu tsr zyx")).otherwise(F.col("text"))).withColumn("lang", F.when(F.col("doc_id").isin(held), "qq").otherwise(F.col("lang")))
    again = {x.doc_id: x for x in language.identify(other, language.fit(other, language.learnable())).collect()}
    assert all(again[i] == got[i] for i in got if i not in held)
    # a row that repeats is sampled once
    many = df.unionByName(df.filter("doc_id = 3").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("k"))
    assert language.fit(many, language.learnable(), sample=100).centroids.shape == (12, language.DIM)
    assert {x.lang_pred for x in language.identify(docs, language.fit(empty, language.learnable())).collect()} == {"und"}


@pytest.mark.parametrize(("name", "size"), [("op6_toxicity", "sf0.1"), ("op8_quality", "sf0.1"), ("op10_language", "sf0.1"), ("op8_quality", "sf0.01")])
def test_held_out_accuracy(spark, name, size):
    sf = f"/root/testdata/{size}"
    found = {r.doc_id: r for r in Q.queries()[name](spark, sf).collect() if r.held_out}
    column = {"op6_toxicity": "toxic", "op8_quality": "quality", "op10_language": "lang"}[name]
    source = "documents" if column == "lang" else "labels"
    truth = dict(duckdb.sql(f"select doc_id, {column} from '{sf}/{source}.parquet'").fetchall())
    predicted = "lang_pred" if column == "lang" else "predicted"
    right = [found[i][predicted] == v for i, v in truth.items() if i in found]
    # 0.876 of the held-out rows of the small table are good ones
    assert np.mean(right) > (0.95 if size == "sf0.1" else 0.93)


def test_stages_keep_further_columns(spark, docs, empty):
    import corpus_pipeline

    more = {"url": F.lit("u"), "_doc": F.lit("d"), "_k1": F.lit(1), "_size": F.lit(2), "_source": F.lit(3), "removed": F.lit("r"), "earlier_doc_ids": F.lit(4), "_text": F.lit(5), "rejected": F.lit(True), "turn": F.lit(6), "_turn": F.lit(7), "size": F.lit(8), "copies": F.lit(9)}
    wide, none = docs.withColumns(more), empty.withColumns(more)
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns
        fixed = [c for c in wide.columns if c not in ("text", "n_chars")]
        assert set(got.select(fixed).collect()) <= set(wide.select(fixed).collect())
        assert stage(spark, none, SF).count() == 0
    assert corpus_pipeline.encode(spark, wide, SF).count() == len(ROWS) and corpus_pipeline.encode(spark, none, SF).count() == 0


def test_pipeline_decodes(spark, docs):
    import corpus_pipeline

    mixed = docs.unionByName(docs.filter("doc_id in (1, 15)"))
    got = corpus_pipeline.encode(spark, mixed, SF).collect()
    want = collections.Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest(), True) for r in [*ROWS, *(r for r in ROWS if r[0] in (1, 15))])
    assert collections.Counter((r.doc_id, r.decoded_sha256, r.decoded_equal) for r in got) == want


def test_pipeline(spark):
    import corpus_pipeline

    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 1:
            want = brute_groups([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == {i for i, v in want.items() if v[2]}
    assert 0 < sizes[2] <= sizes[1] < sizes[0] and sizes[4] == sizes[3] > 0
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.select("doc_id", "n_tokens").collect())) == sorted(map(str, docs.select("doc_id", "n_tokens").collect()))


def test_fewer_links(spark):
    r = random.Random(5)
    rows = [(a, b) for a in range(20, 400) for b in r.sample(range(20), r.randint(1, 4))] + [(9, 3), (500, 501), (501, 502), (502, 502)]
    links = spark.createDataFrame(rows, "a long, b long")
    few = fewer_links(links)
    whole, less = ({r.node: r.component for r in components(x).collect()} for x in (links, few))
    assert whole == less and few.count() < len(set(rows))
    assert fewer_links(links.limit(0)).count() == 0


def test_many_languages(spark):
    # a language each, with words of its own: more values than centroids may be, and more than the sample has documents
    rows = [(i, words(40, 7000 + i // 2), f"l{i // 2:04d}") for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.fit(df, F.lit(True))
    assert len(model.langs) == 700 and len(model.centroids) <= language.MOST_CENTROIDS
    got = {r.doc_id: r.lang_pred for r in language.identify(df, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.95 * len(rows)
    few = language.fit(df, F.lit(True), sample=300)
    assert len(few.langs) == 300 == len(few.centroids)
    assert {r.lang_pred for r in language.identify(df, few).collect()} <= set(few.langs)


def test_byte_bpe_ids_of_any_type(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, "Ünïcode")], "doc_id long, text string")
    want = {str(r.doc_id): r.ids for r in byte_bpe.encode(df).collect()}
    for kind in ("smallint", "decimal(9,0)", "string"):
        got = byte_bpe.encode(df.withColumn("doc_id", F.col("doc_id").cast(kind)))
        assert got.schema["doc_id"].dataType.simpleString() == kind
        assert {str(r.doc_id): r.ids for r in got.collect()} == want


class Tasks:
    """Stands in for a table: keeps the function that its tasks would run."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def peak(run, batch):
    """Bytes that a task over one batch holds at most, Arrow's own not counted, and its rows."""
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in run(iter([batch])))
        return tracemalloc.get_traced_memory()[1], n
    finally:
        tracemalloc.stop()


def test_tasks_hold_few_texts_at_a_time():
    # a batch of 8 MB of text
    texts = [words(450, 9000 + i % 50) + f" {i}" for i in range(4000)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32()), pa.array(texts)], ["doc", "key", "text"])
    size = sum(map(len, texts))
    held, n = peak(substrings._chunks(substrings.BLOCK), batch)
    assert n > len(texts) and held < 4 * size
    tasks = Tasks()
    minhash.map_batches(tasks, lambda: lambda b: pa.record_batch([pa.array([sum(map(len, b.column(2).to_pylist()))])], ["n"]), "n long", minhash.ROWS)
    held, n = peak(tasks.run, batch)
    assert n == -(-len(texts) // minhash.ROWS) and held < size / 4


def test_tasks_of_language_get_few_texts(spark, monkeypatch):
    most = []
    predict = language.Model.predict
    model = language.Model([], np.ones(language.DIM, np.float32), np.zeros((0, language.DIM), np.float32), np.zeros(0, int), np.zeros(0))
    monkeypatch.setattr(language.Model, "predict", lambda self, docs: (most.append(len(docs)), predict(self, docs))[1])
    df = spark.createDataFrame([(i, "a b") for i in range(3)], "doc_id long, text string")
    batch = pa.record_batch([pa.array(range(1000), pa.int64()), pa.array(["a b"] * 1000)], ["doc_id", "text"])
    seen = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: seen.append(run))
    language.identify(df, model)
    language.recognised(df, model)
    for run in seen:
        list(run(iter([batch])))
    assert len(seen) == 2 and sum(most) == 2000 and max(most) <= 256
