"""Many terms looked for in one pass (I7, K6): an automaton of all terms, built once a task, goes over each text once, however many terms there are."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame


def automaton(terms: Sequence[str]) -> ahocorasick.Automaton:
    """Terms in lower case; the value of each is its first place among them."""
    out = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        if t and t.lower() not in out:
            out.add_word(t.lower(), k)
    out.make_automaton()
    return out


def _over(df: DataFrame, col: str, name: str, terms: Sequence[str], find: Callable[[ahocorasick.Automaton, str], list[str]]) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at, names, own = df.columns.index(col), df.columns, list(dict.fromkeys(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton(own)
        for b in batches:
            # without any term there is nothing to go through
            out = [find(words, t.lower()) if t and len(words) else [] for t in b.column(at).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(out, pa.list_(pa.string()))], [*names, name])

    return df.mapInArrow(run, f"{fields}, `{name}` array<string>")


def with_terms(df: DataFrame, col: str, terms: Sequence[str], name: str = "terms") -> DataFrame:
    """df with the terms that the text contains, whatever their case, in the order of terms; none for null. Terms that differ in case only are the first of them."""
    own = list(dict.fromkeys(terms))
    return _over(df, col, name, own, lambda words, text: [own[k] for k in sorted({k for _, k in words.iter(text)})])


def longest(words: ahocorasick.Automaton, text: str, terms: Sequence[str]) -> set[str]:
    """The terms at the places that a reading from the left takes: at each the longest, and it goes on behind it."""
    at: dict[int, int] = {}
    for end, k in words.iter(text):
        start = end - len(terms[k]) + 1
        at[start] = max(at.get(start, 0), len(terms[k]))
    found, place = set(), 0
    for start in sorted(at):
        if start >= place:
            found.add(text[start : start + at[start]])
            place = start + at[start]
    return found


def with_longest(df: DataFrame, col: str, terms: Sequence[str], name: str = "terms") -> DataFrame:
    """df with the distinct terms, in lower case and sorted, that stand in the text when it is read from the left and the longest term at a place is taken."""
    own = list(dict.fromkeys(t.lower() for t in terms))
    return _over(df, col, name, own, lambda words, text: sorted(longest(words, text, own)))


def plain_longest(text: str, terms: Sequence[str]) -> list[str]:
    """The same by one regular expression of all terms, the longest first: for tests."""
    pattern = "|".join(re.escape(t.lower()) for t in sorted((t for t in terms if t), key=len, reverse=True))
    return sorted(set(re.findall(pattern, text.lower()))) if pattern else []
