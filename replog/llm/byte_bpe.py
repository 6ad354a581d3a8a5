"""Operator 5: byte-level BPE encoding and decoding through a global shuffle of distinct words.

Texts are split into pre-tokens by the vocabulary's pattern. A block of neighbouring documents is written down as its distinct pre-tokens
and, for each position, the number of the pre-token that stands there. Distinct pre-tokens of all blocks are shuffled by their bytes, so that
each distinct word meets its equals in one task and is encoded once; the ids go back to the blocks, where they are joined to the positions.
A word comes at most once from a block, so frequent words make no hot group; a block's words for one task travel packed in one row. Decoding joins ids with the table of token bytes.

Blocks are cut while a partition is read, and it is read twice, so the input should be a stored table, whose partitions are read alike on a
second try; each block carries a checksum of its documents, and a block that was cut differently raises an error.

Edge cases: a null or empty text has no ids; rows that repeat are encoded each; long texts are read whole, and a block holds one text at least;
a null id is an id like any other; further columns are not looked at; an empty table gives an empty result. Bytes that no token covers alone cannot occur: the vocabulary holds all 256.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_batches

#: Code points of a block, after which the next document starts a new one.
BLOCK_CHARS = 6_000_000
#: Pre-tokens of a block that are put together at a time.
SLICE = 200_000


@lru_cache(maxsize=2)
def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


@lru_cache(maxsize=2)
def encoder(data: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(data), special_tokens={})


class Splitter:
    """Splits the texts of a block into pre-tokens.

    In a text whose words stand apart by single spaces or line breaks, no pre-token crosses from a word to the space after it, so each distinct
    run between spaces is matched once a block. Other texts are matched whole, with white space as Unicode defines it."""

    def __init__(self, pattern: str):
        # U+001C to U+001F are white space to this module's \\s, but not to the encoding library
        unicode = regex.sub(r"\[\^\\s", r"[^\\p{White_Space}", pattern).replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.find = regex.compile(unicode).findall

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """The text's first pre-tokens, and the runs after each single space that follows them, to be matched with that space before them."""
        if text and text.count(" ") + text.count("\n") + 1 == len(text.split()):
            first, *runs = text.split(" ")
            return self.find(first), runs
        return self.find(text), []

    def split(self, run: str) -> tuple[str, ...] | list[str]:
        """The pre-tokens of a run and the space before it; letters alone are one."""
        return (" " + run,) if run.isalpha() else self.find(" " + run)

    def words(self, held: list[str], parts: int) -> list[list[bytes]]:
        """The distinct pre-tokens of the texts, by part and then by their bytes."""
        words, runs = set(), set()
        for t in held:
            first, more = self.parts(t)
            words.update(first)
            runs.update(more)
        for r in runs:
            words.update(self.split(r))
        return dealt(words, parts)

    def places(self, held: list[str], parts: int) -> list[np.ndarray]:
        """Each text as places in what words gives, one part after the other."""
        runs: defaultdict[str, int] = defaultdict()
        runs.default_factory = runs.__len__
        words: set[str] = set()
        docs = []
        for t in held:
            first, more = self.parts(t)
            words.update(first)
            docs.append((first, np.fromiter(map(runs.__getitem__, more), np.uint32, len(more))))
        split = [self.split(r) for r in runs]
        runs.clear()
        for w in split:
            words.update(w)
        at = {w: k for k, w in enumerate(w for part in dealt(words, parts) for w in part)}
        at = {w: at[encoded(w)] for w in words}
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter((at[w] for ws in split for w in ws), np.uint32, int(lengths.sum()))
        start = np.cumsum(lengths) - lengths
        return [np.concatenate((np.fromiter((at[w] for w in first), np.uint32, len(first)), gather(flat, start[d], lengths[d]))) for first, d in docs]


def encoded(word: str) -> bytes:
    return word.encode("utf-8", "replace")


def dealt(words: set[str], parts: int) -> list[list[bytes]]:
    """Words by the part that a hash of their bytes deals them to, sorted."""
    out: list[list[bytes]] = [[] for _ in range(parts)]
    for w in map(encoded, words):
        out[crc32(w) % parts].append(w)
    for part in out:
        part.sort()
    return out


def pack(numbers: np.ndarray) -> bytes:
    """Numbers compressed, their four bytes apart."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(packed, 4 * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of flat with these starts and lengths, one after the other."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, list[str]]]:
    """(number, ids, texts) of the blocks of a partition."""
    block, ids, held, chars = TaskContext.get().partitionId() << 32, [], [], 0
    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):
            ids.append(i.as_py())
            held.append(t.as_py() or "")
            chars += len(held[-1])
            if chars >= size:
                yield block, ids, held
                block, ids, held, chars = block + 1, [], [], 0
    if ids:
        yield block, ids, held


def digest(ids: list, held: list[str]) -> int:
    """A checksum of a block's documents, by which both readings of it are told to be the same."""
    mark = xxhash.xxh3_64(repr(ids).encode())
    for t in held:
        mark.update(encoded(t))
        mark.update(b"\xff")
    return mark.intdigest() >> 1


def _words(pattern: str, size: int, parts: int) -> Callable:
    """A row for each block and part: the block's distinct words of this part, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, codec = Splitter(pattern), pa.Codec("zstd")
        for block, ids, held in _blocks(batches, size):
            rows = [(part, words, b"".join(words)) for part, words in enumerate(splitter.words(held, parts)) if words]
            columns = [[part for part, _, _ in rows], [len(w) for _, w, _ in rows], [pack(np.fromiter(map(len, w), np.uint32)) for _, w, _ in rows], [len(x) for _, _, x in rows], [codec.compress(x, asbytes=True) for _, _, x in rows]]
            if rows:
                yield pa.record_batch([pa.array([block] * len(rows), pa.int64()), *map(pa.array, columns, (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())), pa.array([digest(ids, held)] * len(rows), pa.int64())], ["block", "part", "n", "lengths", "size", "words", "mark"])

    return run


def _positions(pattern: str, size: int, parts: int, kind: pa.DataType) -> Callable:
    """A row for each block: its documents, and the places of all their pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(pattern)
        for block, ids, held in _blocks(batches, size):
            found = splitter.places(held, parts)
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([[len(x) for x in found]], pa.list_(pa.int64())), pa.array([pack(np.concatenate(found))], pa.binary()), pa.array([digest(ids, held)], pa.int64())], ["block", "ids", "lengths", "packed", "mark"])

    return run


def _encode_words(data: bytes, pattern: str) -> Callable:
    """Encodes the words of a part, each distinct one once, and gives each block the ids of its words in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, ranks, codec = encoder(data, pattern)._core_bpe.encode_single_piece, read_ranks(data), pa.Codec("zstd")
        known: dict[bytes, list[int]] = {}
        for b in batches:
            out = []
            for n, lengths, size, words in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                text, ends = codec.decompress(words, size, asbytes=True), np.cumsum(unpack(lengths, n)).tolist()
                own = [text[a:z] for a, z in zip([0, *ends], ends)]
                for w in own:
                    if w not in known:
                        rank = ranks.get(w)
                        known[w] = piece(w) if rank is None else [rank]
                ids = list(map(known.__getitem__, own))
                each, every = np.fromiter(map(len, ids), np.uint32, n), np.fromiter(chain.from_iterable(ids), np.uint32)
                out.append((pack(each), len(every), pack(every)))
            yield pa.record_batch([*b.columns[:3], *map(pa.array, zip(*out, strict=True), (pa.binary(), pa.int32(), pa.binary())), b.column(6)], ["block", "part", "n", "lengths", "m", "tokens", "mark"])

    return run


class TokenBytes:
    """The table of token bytes, as one string of bytes and where each token's are."""

    def __init__(self, data: bytes):
        ranks = read_ranks(data)
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        self.length[list(ranks.values())] = list(map(len, ranks))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        return gather(self.flat, self.start[ids], self.length[ids])


@lru_cache(maxsize=2)
def token_bytes(data: bytes) -> TokenBytes:
    return TokenBytes(data)


def _reassemble(words: pa.Table, positions: pa.Table, table: TokenBytes | None) -> pa.Table:
    """The ids of each document of a block, in the order of its positions; and the bytes that they stand for, with a table of token bytes."""
    rows = sorted(words.to_pylist(), key=lambda r: r["part"])
    if {r["mark"] for r in rows} - set(positions["mark"].to_pylist()):
        raise ValueError("a block was not read alike twice: write the documents to a table first")
    lengths = np.concatenate([unpack(r["lengths"], r["n"]) for r in rows] or [np.zeros(0, np.uint32)]).astype(np.int64)
    flat = np.concatenate([unpack(r["tokens"], r["m"]) for r in rows] or [np.zeros(0, np.uint32)]).view(np.int32)
    start = np.cumsum(lengths) - lengths
    kind = positions.schema.field("ids").type.value_type
    out = []
    for row in positions.to_pylist():
        every = unpack(row["packed"], sum(row["lengths"]))
        ends = np.concatenate(([0], np.cumsum(row["lengths"]))).astype(np.int64)
        # some documents at a time, so that what is in between stays small
        a = 0
        while a < len(row["ids"]):
            z = max(a + 1, min(len(row["ids"]), int(np.searchsorted(ends, ends[a] + SLICE))))
            at = every[ends[a] : ends[z]]
            n = lengths[at]
            offsets = np.concatenate(([0], np.cumsum(n)))[ends[a : z + 1] - ends[a]].astype(np.int32)
            tokens = gather(flat, start[at], n)
            columns = {"doc_id": pa.array(row["ids"][a:z], kind), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens, pa.int32()))}
            if table is not None:
                ends_at = np.concatenate(([0], np.cumsum(table.length[tokens])))[offsets].astype(np.int32)
                columns["decoded"] = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(ends_at), pa.py_buffer(table.decode(tokens))])
            out.append(pa.table(columns))
            a = z
    return pa.concat_tables(out)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) for every row of docs, and with decoded the bytes that the ids decode to. The ranks file is read on the driver."""
    with open(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        data = f.read()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    arrow = to_arrow_type(own.schema["doc_id"].dataType)
    # as many parts as there are shuffle partitions, so that each partition's distinct words fit in a task
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = own.mapInArrow(_words(pattern, block_chars, parts), "block long, part int, n int, lengths binary, size int, words binary, mark long")
    encoded_words = words.repartitionById(parts, F.col("part")).mapInArrow(_encode_words(data, pattern), "block long, part int, n int, lengths binary, m int, tokens binary, mark long")
    places = own.mapInArrow(_positions(pattern, block_chars, parts, arrow), f"block long, ids array<{kind}>, lengths array<long>, packed binary, mark long")

    def reassemble(w: pa.Table, p: pa.Table) -> pa.Table:
        return _reassemble(w, p, token_bytes(data) if decoded else None)

    return encoded_words.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(reassemble, f"doc_id {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """encoded with the column decoded, the bytes that the ids stand for; the table of token bytes is as large as the vocabulary."""
    with open(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        data = f.read()
    others = encoded.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        table = token_bytes(data)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            column = b.column(b.schema.get_field_index(ids_col))
            out = [table.decode(ids.values.to_numpy()).tobytes() if ids.is_valid else None for ids in column]
            return pa.record_batch([*b.columns, pa.array(out, pa.binary())], [*others, "decoded"])

        return one

    return map_batches(encoded, make, f"{fields}, decoded binary")
