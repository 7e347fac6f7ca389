"""Counting sets of markers in one pass over a text.

All markers of all sets go into one automaton (Aho-Corasick), which reports every place where any of them ends, those
inside others too: "it might be" counts as itself and as *might*. Single words count where no letter, digit or
underscore touches them; phrases count wherever they stand, each without overlapping itself. Batches of texts are Arrow
arrays; what comes back is a number for each set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of a batch that are held as Python strings at once.
ROWS = 256


def strings(column: pa.Array) -> Iterator[str]:
    """The values as strings, some at a time; null counts as empty."""
    for lo in range(0, len(column), ROWS):
        for t in column.slice(lo, ROWS).to_pylist():
            yield t or ""


class Matcher:
    """Counts of sets of markers in lower-case texts. Markers with capitals never match."""

    def __init__(self, sets: Iterable[Iterable[str]]):
        sets = [tuple(dict.fromkeys(s)) for s in sets]
        owners: dict[str, list[int]] = {}
        for i, markers in enumerate(sets):
            for m in markers:
                owners.setdefault(m, []).append(i)
        self.n = len(sets)
        self.automaton = ahocorasick.Automaton()
        for k, (m, mine) in enumerate(owners.items()):
            self.automaton.add_word(m, (k, len(m), " " not in m, tuple(mine)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def counts(self, low: str) -> list[int]:
        out = [0] * self.n
        if self.empty or not low:
            return out
        upto: dict[int, int] = {}
        last = len(low) - 1
        for end, (k, size, word, owners) in self.automaton.iter(low):
            start = end - size + 1
            if word:
                before, after = low[start - 1] if start else " ", low[end + 1] if end < last else " "
                if before == "_" or before.isalnum() or after == "_" or after.isalnum():
                    continue
            elif start <= upto.get(k, -1):
                continue
            else:
                upto[k] = end
            for o in owners:
                out[o] += 1
        return out


@cache
def matcher(sets: tuple[tuple[str, ...], ...]) -> Matcher:
    """One automaton for each worker, however many batches it gets."""
    return Matcher(sets)


def lowered(markers: Iterable[str], fix_case: bool = False) -> tuple[str, ...]:
    return tuple(m.lower() if fix_case else m for m in markers)


def count_sets(c: Column, sets: Mapping[str, Iterable[str]], fix_case: bool = False) -> Column:
    """A struct with the number of markers of each set in the lower-case text, from one pass over it."""
    given = tuple(lowered(ms, fix_case) for ms in sets.values())
    names = list(sets)

    @F.arrow_udf("struct<" + ", ".join(f"`{n}`: bigint" for n in names) + ">")
    def counted(texts: pa.Array) -> pa.Array:
        found = matcher(given)
        rows = [found.counts(t.lower()) for t in strings(texts)]
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    return counted(c)


def count_markers(c: Column, markers: Iterable[str], fix_case: bool = False) -> Column:
    """The markers' own case stays unless ``fix_case``: one with a capital never matches."""
    return count_sets(c, {"n": markers}, fix_case)["n"]
