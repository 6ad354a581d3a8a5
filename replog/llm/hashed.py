"""Words of texts as 64-bit hashes, taken from Arrow's own bytes: what operators 11 and 12 count."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _weights(size: int) -> np.ndarray:
    """An odd number for each place in a word."""
    return mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def codes(apart: list[int]) -> np.ndarray:
    """Of each byte: 0 if it stands between words, else a number of its own, one for both cases of A to Z."""
    out = np.arange(1, 257, dtype=np.uint64)
    out[65:91] = out[97:123]
    out[apart] = 0
    return out


#: Bytes of words `[^\x20\x09-\x0D]+`, and of terms, which hold only letters and digits of ASCII and whatever is not ASCII.
WORDS = codes([32, *range(9, 14)])
TERMS = codes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def hashed(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, in order, and the number of the text that each is in. Null is an empty text.

    A hash is the sum of a word's bytes, each times a number of its place: two words have the same with a chance of about 2 to the power -57 or less."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    code = table[raw]
    inside = code > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    where = np.flatnonzero(inside)
    first = np.flatnonzero(begins[where])
    place = np.arange(len(where)) - np.repeat(first, np.diff(np.append(first, len(where))))
    weights = _weights(1 << max(6, int(place.max()).bit_length()))
    return mix(np.add.reduceat(code[where] * weights[place], first)), np.searchsorted(at, starts, "right") - 1


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, ...]]:
    """The columns of batches, whose second one is text, in slices of some bytes, so that what is made of their characters stays small."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE_BYTES, "right")))
            yield tuple(c.slice(a, z - a) for c in b.columns)
            a = z
