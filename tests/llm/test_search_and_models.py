"""Operators 11 to 13 on small tables, against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from replog.llm import conversations, lm, ranking
from replog.llm.hashed import TERMS, WORDS, hashed

SCHEMA = "doc_id long, text string, score double, rank int, block string"


def sentence(r, n, size=40):
    return " ".join(f"w{min(int(r.expovariate(0.15)), size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    own = [(i, sentence(r, r.randint(0, 60))) for i in range(120)]
    return [*own, (500, own[3][1]), (501, None), (502, ""), (503, " \n\t"), (504, "Éa éA W1 w1-w2"), (505, "x" * 5000), (506, sentence(r, 4000)), (506, sentence(r, 9)), (None, own[5][1])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*t, 0.5, 1, "x") for t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hashed_words():
    import pyarrow as pa

    texts = ["One two\x0bone", None, "", "\x1cx É", "É", "two"]
    words, doc = hashed(pa.array(texts), WORDS)
    want = [(i, "".join(c.lower() if c.isascii() else c for c in w)) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert doc.tolist() == [i for i, _ in want]
    assert [[a == b for b in words] for a in words] == [[a == b for _, b in want] for _, a in want]
    assert len(hashed(pa.array([None, "a-b C3"])[1:], TERMS)[0]) == 3


def plain_base(texts, held):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), "\n"] for _, t in texts]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for ws_ in [ws] for w in ws_)) for ws in tokens]


def test_language_model(spark, docs, texts, empty, monkeypatch):
    held = [i is not None and crc32(str(i).encode()) % 10 == 0 for i, _ in texts]
    # null ids are in fold 0, as everywhere in this subpackage
    held = [h or i is None for h, (i, _) in zip(held, texts)]
    got = lm.score(docs).collect()
    want = sorted(((i is None, i or 0, h, *b[:3]), b[3]) for (i, _), h, b in zip(texts, held, plain_base(texts, held)))
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens), r.base_score) for r in got)
    assert [a for a, _ in found] == [a for a, _ in want] and np.allclose([b for _, b in found], [b for _, b in want], atol=1e-9)
    by = {r.doc_id: r for r in got}
    assert by[3].score == pytest.approx(by[500].score) and by[501].score == pytest.approx(by[502].score)
    # more parts, and frequent words dealt over several: the same seatings, hence the same scores
    monkeypatch.setattr(lm, "PART", 300)
    again = {(r.doc_id, r.n_tokens): r.score for r in lm.score(docs.repartition(5)).collect()}
    assert all(again[r.doc_id, r.n_tokens] == pytest.approx(r.score, abs=1e-9) for r in got)
    assert lm.score(empty).count() == 0
    none = lm.score(docs, held_out=F.lit(True)).collect()
    # nothing but unknown words is expected then
    assert len(none) == len(texts) and all(r.n_known == 0 and r.train_tokens == 0 and abs(r.score) < 1e-9 for r in none)


def test_probabilities_add_up_to_one(spark):
    words = ["a", "b", "c", "d"]
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("aaabbc") for _ in range(r.randint(0, 30))), True) for i in range(30)]
    rows += [(100 + k, " ".join(p), False) for k, p in enumerate(itertools.product([*words, "unknown"], repeat=2))] + [(200, "d d a", True), (201, "", False)]
    one = spark.createDataFrame(rows, "doc_id long, text string, train boolean").coalesce(1)
    import pyarrow as pa

    cells = one.mapInArrow(lm._cells(1, {}, pa.int64()), lm.CELLS.format(kind="bigint")).toArrow()
    none, answers = np.zeros(0, np.uint64), []
    for sweep in range(3):
        sums = lm._send(1, none, sweep, 1.0)(cells) if not sweep else lm._send(1, none, sweep, 1.0)(cells, pa.concat_tables(answers))
        answers.append(lm._answer(sweep, 1.0)(sums))
    part = lm.Part(cells, 1, none, 1.0)
    for _, sample in part.samples(pa.concat_tables(answers).to_pylist(), 2):
        assert sample.p.sum() == pytest.approx(1.0)
        count = {int(w) & (2**48 - 1): n for w, n in zip(part.words, sample.c)}
        total = Counter()
        for u, p in zip(part.context, sample.likely):
            total[int(part.contexts[u])] += p / (1.0 + count[int(part.contexts[u])])
        assert len(total) == 6 and all(x == pytest.approx(1.0) for x in total.values())


def test_tables_are_drawn_from_their_distribution():
    # seatings of four customers by enumeration, against draws with many seeds
    d, theta, others, p, n = 0.6, 1.0, 3.0, 0.2, 4
    weight = Counter()

    def seat(sizes, left, w):
        if not left:
            weight[len(sizes)] += w
            return
        for k, s in enumerate(sizes):
            seat([*sizes[:k], s + 1, *sizes[k + 1 :]], left - 1, w * (s - d))
        seat([*sizes, 1], left - 1, w * (theta + d * (others + len(sizes))) * p)

    seat([], n, 1.0)
    m = 40_000
    t = lm.sample_tables(np.full(m, n), np.full(m, others), np.full(m, p), d, theta, np.arange(m, dtype=np.uint64))
    for k in range(1, n + 1):
        assert (t == k).mean() == pytest.approx(weight[k] / sum(weight.values()), abs=0.01)
    # those with many customers: near the exact mean, at sizes that both ways can do
    c, others, p = np.full(9, lm.EXACT), np.repeat([5.0, 50.0, 3000.0], 3), np.tile([0.001, 0.01, 0.3], 3)
    seeds = np.arange(5000, dtype=np.uint64)
    exact = [lm.sample_tables(np.full(5000, n), np.full(5000, o), np.full(5000, q), d, theta, seeds).mean() for n, o, q in zip(c, others, p)]
    assert lm.likely_tables(c.astype(float), others, p, d, theta) == pytest.approx(exact, rel=0.15)


def plain_rank(texts, items, k=20):
    def terms(t):
        return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})))

    vectors = [(i, terms(t)) for i, t in texts]
    vectors = [(i, v) for i, v in vectors if v]
    n, words = len(vectors), sum(sum(v.values()) for _, v in vectors)
    df = Counter(t for _, v in vectors for t in v)
    out = []
    for item, text in items:
        scores = []
        for i, v in vectors:
            m = 75 + (25 * sum(v.values()) * n) // words
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * v[t]) // (1000 * v[t] + 12 * m)) for t, c in terms(text).items() if v[t])
            scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return out


def test_ranked_search(spark, docs, texts, empty):
    r = random.Random(8)
    asked = [(k, sentence(r, r.randint(1, 12))) for k in range(90)] + [(200, None), (201, "nothing here"), (202, "w1 w1 w1 É éa"), (203, "")]
    items = spark.createDataFrame([(*a, 1, 2) for a in asked], "item_id long, text string, rank int, doc_id int")
    key = lambda x: tuple((v is None, v) for v in x)
    want = sorted(plain_rank(texts, asked), key=key)
    assert sorted(map(tuple, ranking.rank(docs, items).collect()), key=key) == want
    # several groups of items, and every block searched for the least score first
    assert sorted(map(tuple, ranking.rank(docs, items, group_bytes=900, sample=1).collect()), key=key) == want
    assert ranking.rank(empty, items).count() == 0 and ranking.rank(docs, items.limit(0)).count() == 0
    assert sorted(map(tuple, ranking.rank(docs, items.union(items)).collect()), key=key) == want


def test_dual_tree_leaves_pairs_out():
    # two kinds of documents, whose items want only their own: most of the other kind's pairs fall by bounds
    r = random.Random(4)
    vectors = [{t: 5 + r.randrange(9) for t in r.sample(range(100 * kind, 100 * kind + 100), 12)} for kind in (0, 1) for _ in range(64)]
    items = ranking.Items(list(range(128)), vectors, 200)
    search = ranking.Search(items, np.zeros(128, np.int64), 512, 512 * 40, 5)
    rows = [sorted(r.sample(range(100 * (d % 2), 100 * (d % 2) + 100), 20)) for d in range(512)]
    block = {"docs": 512, "ids": list(range(512)), "sizes": ranking.pack(np.full(512, 40)), "lengths": ranking.pack(np.full(512, 20)), "m": 512 * 20, "terms": ranking.pack(np.array(rows).ravel()), "counts": ranking.pack(np.ones(512 * 20, np.int64))}
    search.block(block)
    impact = 10**9 // (1000 + 12 * 100)
    for i, v in enumerate(vectors):
        best = sorted((-sum(v.get(t, 0) for t in row) * impact, d) for d, row in enumerate(rows))[:5]
        assert sorted(search.found[items.ids.index(i)]) == [x for x in best if x[0]]
    assert search.scored < 0.5 * 64 * 256
    # weights beyond 53 bits are taken as 64-bit numbers
    assert ranking.Items([0], [{0: 2**40}], 1).exact is np.int64


def plain_repair(rows):
    """The contract of op13 over the rows of one conversation after damage, in order: least (cost, audit) by state, forwards."""
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    step, name = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    seen, counts = set(), Counter()
    best = {0: (0, "", ())}

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for q, (c, a, out) in list(best.items()):
                new = (c + 3, a + "I", (*out, (name[step[q]], "")))
                if step[q] not in best or new[:2] < best[step[q]][:2]:
                    best[step[q]] = new
        return best

    for _, role, text in rows:
        fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        after = {}
        for q, (c, a, out) in inserted(best).items():
            options = [(q, c + 4, a + "D", out)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options.append((step[q], c + 3 + more, a + "R", (*out, (name[step[q]], text))))
                if (q, role[:1]) in keep:
                    options.append((keep[q, role[:1]], c + more, a + "K", (*out, (role, text))))
            for z, *new in options:
                if z not in after or tuple(new[:2]) < after[z][:2]:
                    after[z] = tuple(new)
        best = after
    cost, audit, out = min((v for q, v in inserted(best).items() if q in (0, 3)), key=lambda v: v[:2])
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def plain_damage(given):
    out = []
    for conv, turn, role, text in given:
        text_of = lambda x: " " if x is None else str(x)
        fate = crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = ("user" if fate == 4 else text_of(role)), ("" if fate == 1 else re.sub("[.!?]", "", text_of(text)) if fate == 2 else text_of(text))
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def conversation(r, conv, n):
    roles = ["user", "assistant", "system", "tool", "", None, "ubiquitous"]
    return [(conv, r.choice([None, *range(2 * n)]) if r.random() < 0.2 else k, r.choices(roles, (9, 9, 2, 1, 1, 1, 1))[0], r.choice(["Yes.", "No!", "So", " ", None, "", "a\n.", f"Line {k}.", f"open {k}", "é漢."])) for k in range(n)]


@pytest.fixture
def no_coalescing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_conversations(spark, no_coalescing):
    r = random.Random(6)
    given = [x for conv in range(150) for x in conversation(r, conv, r.randint(1, 9))] + conversation(r, None, 6) + conversation(r, 900, 700)
    given += [(901, 0, "user", "Hi.")] * 50 + [(902, None, "user", "Hi."), (902, None, "assistant", "Ho.")]
    r.shuffle(given)
    table = spark.createDataFrame([(*g, 1, 2, 3) for g in given], "conv_id long, turn long, role string, text string, run int, piece int, key int").repartition(4)
    pieces = conversations.repair(conversations.damage(table))
    got = {x.conv_id: tuple(x)[1:] for x in conversations.summarize(pieces).collect()}
    order = lambda x: (x[1] is not None, x[1] or 0, x[2], x[3])
    damaged, want = plain_damage(given), {}
    for conv in {g[0] for g in given}:
        want[conv] = plain_repair([x[1:] for x in sorted((x for x in damaged if x[0] == conv), key=order)])
    assert got == want
    # a long conversation lies in several range partitions
    assert pieces.filter("conv_id = 900").select("run").distinct().count() > 1
    assert conversations.summarize(conversations.repair(conversations.damage(table.limit(0)))).count() == 0


def test_checkpoints_give_the_same_walk():
    r = random.Random(2)
    for n in (0, 1, 2, 10, 97):
        rows = [(r.choice("suat"), r.random() < 0.2) for _ in range(n)]
        want = plain_repair([(k, {"s": "system", "u": "user", "a": "assistant", "t": "tool"}[i], f"{k}" + "." * (not cut)) for k, (i, cut) in enumerate(rows)])
        assert "".join(e for _, e, _ in conversations.walk(rows, conversations.LAST, 0, True)) == want[6]
        m = conversations.matrix(rows)
        assert min(m[k] + conversations.LAST[k] for k in range(4)) == want[5]
