"""Operator 7: substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes chooses where a text is cut: after about every sixth space or line break, wherever the same bytes
stand, so that an insertion shifts no chunk but those beside it. Inside a long stretch without white space (Chinese, Japanese, Thai, base64,
minified code) characters are cut after instead, about as often. Where no such place comes for long, any character may be cut after. Chunks
with equal digests are the same; the first in the order of document and place stays, the others are duplicates. Runs of neighbouring
duplicates with enough words are taken out of their texts. Text without spaces has no words to count: a stretch of LONG bytes or more without
white space counts as one word for every SIZE bytes, so that 90 bytes of it (30 Chinese characters) are worth 15 words.

Each block of neighbouring documents sends only its own first chunk of a digest to the shuffle by digest (and says of its others that they are
duplicates), so that a chunk that many documents share makes no hot group.

Edge cases: a null text stays null and an empty one empty; rows that share id and text count as one document, and all are treated alike; rows
with a null id come before all others; long texts are cut whole; further columns are kept as they are, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, fresh, map_batches, named, pieces

WINDOW = 16
#: One space in so many is a cut; after GAP bytes without one, one character in OTHER is; after MOST bytes any.
EVERY, OTHER, GAP, MOST = 6, 32, 160, 1024
#: Words that a run of duplicate chunks must have to be taken out.
WORDS = 15
#: Bytes without white space from which a stretch is not one word, and how many of them are worth a word.
LONG, SIZE = 24, 6
#: One ASCII byte in so many of such a stretch is a cut, and one other character in so many, if APART bytes before it have none.
ASCII, WIDE, APART = 24, 8, 8
#: Bytes of text in a block.
BLOCK = 24_000_000
#: Fixed random values for bytes; the hash of padding is zero.
GEAR = np.concatenate(([0], np.random.default_rng(5).integers(1, 1 << 32, 255))).astype(np.uint32)
SEPARATOR = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def rolling(code: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, of it and the bytes before it, mixed."""
    h = GEAR[code]
    shift = 1
    while shift < WINDOW:
        # hashes of runs twice as long from those of two neighbouring runs
        longer = h.copy()
        longer[shift:] += h[:-shift] << np.uint32(shift)
        h, shift = longer, shift * 2
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return h ^ (h >> np.uint32(15))


def inside(code: np.ndarray, h: np.ndarray, space: np.ndarray) -> np.ndarray:
    """The bytes after which long stretches without white space are cut."""
    edge = np.diff(np.concatenate(([1], space, [1])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    long = end - start >= LONG
    if not long.any():
        return np.zeros(0, np.int64)
    step = np.zeros(len(code) + 1, np.int8)
    step[start[long]] += 1
    step[end[long]] -= 1
    begins = np.append((code[1:] & 0xC0) != 0x80, True)
    low = h < np.where(code < 128, np.uint32((1 << 32) // ASCII), np.uint32((1 << 32) // WIDE))
    at = np.flatnonzero((np.cumsum(step[:-1]) > 0) & begins & low)
    # equal bytes for long would be cut everywhere: of places in a row the first stays
    return at[np.diff(at, prepend=-APART) >= APART]


def ends(code: np.ndarray) -> np.ndarray:
    """Where the chunks of a text's bytes end; the last ends with the text."""
    if not len(code):
        return np.zeros(0, np.int64)
    h = rolling(code)
    space = SEPARATOR[code]
    cuts = np.union1d(np.flatnonzero(space & (h < np.uint32((1 << 32) // EVERY))), inside(code, h, space)) + 1
    cuts = np.append(cuts[cuts < len(code)], len(code))
    if np.diff(cuts, prepend=0).max() <= GAP:
        return cuts
    begins = np.append((code[1:] & 0xC0) != 0x80, True)  # whether a character begins after the byte
    free = np.flatnonzero(begins) + 1
    other = np.flatnonzero(begins & (h < np.uint32((1 << 32) // OTHER))) + 1
    out, last = [], 0
    for c in cuts.tolist():
        while c - last > GAP:
            k = np.searchsorted(other, last + GAP, side="right")
            far = free[min(np.searchsorted(free, last + MOST), len(free) - 1)]
            at = int(min(other[k] if k < len(other) else c, far, c))
            if at >= c:
                break
            out.append(at)
            last = at
        out.append(c)
        last = c
    return np.array(out, np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[int], list[int], list[int], bytearray]]:
    """Documents, keys, numbers of chunks and the digests of all chunks of a block; of its texts only the one at hand is held."""
    digest = xxhash.xxh3_128_digest
    ids, keys, n, marks, total = [], [], [], bytearray(), 0
    for b in pieces(batches):
        for i, k, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            code = (t or "").encode("utf-8", "replace")
            cuts = ends(np.frombuffer(code, np.uint8)).tolist()
            marks += b"".join([digest(code[a:z]) for a, z in zip([0, *cuts[:-1]], cuts)])
            ids.append(i)
            keys.append(k)
            n.append(len(cuts))
            total += len(code)
            if total >= size:
                yield ids, keys, n, marks
                ids, keys, n, marks, total = [], [], [], bytearray(), 0
    if ids:
        yield ids, keys, n, marks


def _chunks(size: int) -> Callable:
    """Rows of a block: digest (d1, d2), doc, key and place of each chunk; owner is null for a block's first of a digest, else a document that has the chunk before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, n, marks in _blocks(batches, size):
            n = np.array(n)
            d = np.frombuffer(marks, np.int64).reshape(-1, 2)
            # the documents of the block by id and key, so that a chunk's row is one number that sorts as they do
            row = np.repeat(np.arange(len(n), dtype=np.int32), n)
            place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            d1, d2 = d[:, 0].copy(), d[:, 1].astype(np.int32)
            del d, marks
            ids, keys = np.array(ids, np.int64), np.array(keys, np.int32)
            by_id = np.lexsort((keys, ids))
            rank = np.empty(len(n), np.int32)
            rank[by_id] = np.cumsum(np.append(0, (np.diff(ids[by_id]) != 0) | (np.diff(keys[by_id]) != 0)))
            order = np.lexsort((place, rank[row], d2, d1))
            d1 = d1[order]
            d2 = d2[order]
            row = row[order]
            place = place[order]
            del order
            first = np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))[: len(d1)]
            head = np.maximum.accumulate(np.where(first, np.arange(len(d1), dtype=np.int32), np.int32(0)))
            for a in range(0, len(d1), 100_000):
                s = np.arange(a, min(a + 100_000, len(d1)))
                h = head[s]
                s = s[first[s] | (rank[row[s]] != rank[row[h]]) | (place[s] != place[h])]  # not the same row read twice
                doc = ids[row[s]]
                # duplicates go to any task; their digests are no longer needed
                deal = np.where(first[s], d1[s], doc * 31 + place[s])
                yield pa.record_batch([pa.array(deal), pa.array(d2[s]), pa.array(doc), pa.array(keys[row[s]]), pa.array(place[s]), pa.array(ids[row[head[s]]], mask=first[s])], ["d1", "d2", "doc", "key", "place", "owner"])

    return run


def _duplicates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows by (owner given, d1, d2, doc, key, place): all but the first of a digest, with the document that has the first."""
    last = None
    for b in batches:
        known = b.column(5).is_valid().to_numpy(zero_copy_only=False)
        d1, d2, doc, key, place = (b.column(k).to_numpy() for k in range(5))
        same = np.append(False, (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1]) & ~known[1:] & ~known[:-1])[: len(d1)]
        if last is not None and len(d1) and not known[0]:
            same[0] = (d1[0], d2[0]) == last[:2]
        head = np.maximum.accumulate(np.where(same, -1, np.arange(len(d1))))
        mine = np.where(head >= 0, doc[head], last[2] if last else 0)
        owner = np.where(known, b.column(5).fill_null(0).to_numpy(), mine)
        own_key, own_place = np.where(head >= 0, key[head], last[3] if last else 0), np.where(head >= 0, place[head], last[4] if last else 0)
        out = known | (same & ~((doc == mine) & (key == own_key) & (place == own_place)))
        if len(d1) and not known[-1]:
            last = (d1[-1], d2[-1], mine[-1], own_key[-1], own_place[-1])
        s = np.flatnonzero(out)
        yield pa.record_batch([pa.array(doc[s]), pa.array(key[s]), pa.array(place[s]), pa.array(owner[s])], ["doc", "key", "place", "owner"])


def duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc, key, place and owner of every duplicate chunk; docs has doc, key and text."""
    rows = docs.mapInArrow(_chunks(block), "d1 long, d2 int, doc long, key int, place int, owner long")
    dealt = rows.repartition("d1").sortWithinPartitions(F.col("owner").isNotNull(), "d1", "d2", "doc", "key", "place")
    return dealt.mapInArrow(_duplicates, "doc long, key int, place int, owner long")


def worth(code: bytes) -> int:
    """The words of a passage, a long stretch without white space counted by its bytes."""
    return sum(1 if len(w) < LONG else len(w) // SIZE for w in code.split())


def strip(text: str, places: list[int], owners: list[int], words: int = WORDS) -> tuple[str, list[dict], list[int]]:
    """The text without runs of duplicate chunks worth at least so many words; the runs as spans of code points; documents that have them before."""
    code = text.encode("utf-8", "replace")
    cut = [0, *ends(np.frombuffer(code, np.uint8)).tolist()]
    owner = dict(zip(places, owners, strict=True))
    kept, spans, firsts, at, k = [], [], set(), 0, 0
    marked = sorted(owner)
    while k < len(marked):
        z = k
        while z + 1 < len(marked) and marked[z + 1] == marked[z] + 1:
            z += 1
        a, b = cut[marked[k]], cut[marked[z] + 1]
        if worth(code[a:b]) >= words:
            kept.append(code[at:a].decode())
            start = spans[-1]["end"] + len(kept[-1]) if spans else len(kept[-1])
            spans.append({"start": start, "end": start + len(code[a:b].decode())})
            firsts |= {owner[p] for p in marked[k : z + 1]}
            at = b
        k = z + 1
    kept.append(code[at:].decode())
    return "".join(kept), spans, sorted(firsts)


def deduplicate(docs: DataFrame, words: int = WORDS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, the text without its repeated passages, and two more: removed (spans of code points in the old text) and earlier_doc_ids (documents that have the passages before); if docs has columns of these names, the new ones' begin with an underscore."""
    doc, key, places, owners = fresh(docs, "doc", "key", "places", "owners")
    keyed = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), key: F.hash(F.col(text_col))})
    found = duplicates(keyed.select(F.col(doc).alias("doc"), F.col(key).alias("key"), F.col(text_col).cast("string").alias("text")), block)
    # equal rows may have been in different blocks, and so have been told of the same chunk twice
    pairs = F.collect_set(F.struct("place", "owner"))
    lists = found.groupBy(F.col("doc").alias(doc), F.col("key").alias(key)).agg(pairs.alias("found"))
    lists = lists.select(doc, key, F.col("found.place").alias(places), F.col("found.owner").alias(owners))
    joined = keyed.join(lists, [doc, key], "left").select(*docs.columns, places, owners)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    columns, removed, earlier = docs.columns, named(docs, "removed"), named(docs, "earlier_doc_ids")
    at, n = columns.index(text_col), len(columns)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for t, p, o in zip(*(b.column(k).to_pylist() for k in (at, n, n + 1)), strict=True):
                rows.append(strip(t, p, o, words) if t and p else (t, [], []))
            new = list(b.columns[:n])
            new[at] = pa.array([r[0] for r in rows], pa.string())
            spans = pa.array([r[1] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            return pa.record_batch([*new, spans, pa.array([r[2] for r in rows], pa.list_(pa.int64()))], [*columns, removed, earlier])

        return one

    return map_batches(joined, make, f"{fields}, `{removed}` array<struct<start: long, end: long>>, `{earlier}` array<long>", ROWS)
