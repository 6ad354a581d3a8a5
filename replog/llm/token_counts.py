"""Operator 2: token counts of a subword model, with a shortcut for strings that are one token.

Offline, once for a vocabulary, every piece is encoded alone; those that come back as one token form a table of proven shortcuts. A text is
then cut where the model never merges across: before a run of spaces, and around characters that occur in no longer piece. A part found in
the table counts as one token; the rest go through the model's merges, each distinct part once a worker.

Edge cases: a null or empty text has 0 bytes and 0 tokens; rows that repeat are counted each; long texts are counted whole, line by line; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, plain, texts

SPACE = "▁"
#: Parts that a worker remembers beside the table; at this number it starts anew.
REMEMBERED = 1_000_000


class Counts(dict):
    """Token counts by part: the proven shortcuts, and what the model's merges made of other parts so far."""

    def __init__(self, single: set[str], merge: Callable[[str], int]):
        super().__init__(dict.fromkeys(single, 1))
        self.single, self.merge = single, merge

    def __missing__(self, part: str) -> int:
        if len(self) > len(self.single) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.single, 1))
        self[part] = n = self.merge(part)
        return n

    def total(self, parts: list[str]) -> int:
        return sum(map(self.__getitem__, parts))


class PieceCounter:
    """Counts tokens as the model does; a part begins with a space (which the model sets before a text) or follows a line break."""

    def __init__(self, model: bytes):
        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        # what the cuts rest on is checked against the vocabulary: no piece goes on after a word's end, none holds a line break, spaces are kept
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) or m.encode("a  a") == m.encode("a a") or len(m.encode("\n")) != 2:
            raise ValueError("this vocabulary merges across spaces or line breaks")
        lead = len(m.encode("\n"))
        heads = [p[1:] for p in pieces if p[0] == SPACE and len(p) > 1 and p[1] != SPACE]
        tails = [p for p in pieces if SPACE not in p]
        one = lambda given, before, n: {w for w, ids in zip(given, m.encode([before + w for w in given], num_threads=1), strict=True) if len(ids) == n}
        self.words = Counts(one(heads, "", 1), lambda w: len(m.encode(w)))
        self.tails = Counts(one(tails, "\n", lead + 1), lambda w: len(m.encode("\n" + w)) - lead)
        self.spaced = Counts(set(), lambda w: len(m.encode(w)))

    def count(self, text: str) -> int:
        if not text:
            return 0
        head, *lines = text.replace(SPACE, " ").split("\n")
        return self._line(" " + head) + sum(map(self._line, lines)) + len(lines)

    def _line(self, line: str) -> int:
        """The tokens of a line; its first word follows a line break, unless a space comes before it."""
        if "  " not in line and line[-1:] != " ":
            tail, *words = line.split(" ")
            return (self.tails[tail] if tail else 0) + self.words.total(words)
        total = 0
        for run, part in re.findall(r"( *)([^ ]*)", line):
            if run:
                total += self.words[part] if len(run) == 1 and part else self.spaced[run[1:] + part] if len(run) > 1 or part else 1
            elif part:
                total += self.tails[part]
        return total


@lru_cache(maxsize=2)
def counter(model: bytes) -> PieceCounter:
    """The counter that a worker keeps from task to task."""
    return PieceCounter(model)


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of every document. The model's file is read on the driver."""
    with open(model_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    kind = docs.schema[id_col].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        count = counter(model).count
        return lambda b: pa.record_batch([b.column(0), pa.array(map(count, texts(b)), pa.int64()), b.column(2)], ["doc_id", "n_tokens", "n_bytes"])

    own = plain(docs, id_col, text_col, F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    counted = map_batches(own, make, f"doc_id {kind}, n_tokens long, n_bytes long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
