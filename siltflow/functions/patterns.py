"""Many needles counted in one pass over a text, by one automaton (Aho and Corasick), as an Arrow UDF: the time doesn't depend on their number."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer needles, and those of several words, count inside of words too.
SHORT = 4


def _inside(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


class Needles:
    """Needles and their automaton. words: a short needle counts only as a whole word, or as its plural."""

    def __init__(self, needles: tuple[str, ...], words: bool):
        self.n = len(needles)
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[int]] = {}
        for i, needle in enumerate(needles):
            if needle:
                at.setdefault(needle, []).append(i)
        for needle, places in at.items():
            self.automaton.add_word(needle, (places, len(needle), words and len(needle) <= SHORT and " " not in needle))
        if at:
            self.automaton.make_automaton()

    def counts(self, text: str | None) -> list[int]:
        """How often each needle occurs; of overlapping occurrences of one needle the first counts."""
        out = [0] * self.n
        if not text or not len(self.automaton):
            return out
        free: dict[int, int] = {}  # by needle the place from which it may occur again
        for end, (places, size, word) in self.automaton.iter(text):
            start, after = end + 1 - size, end + 1
            if start < free.get(places[0], 0):
                continue
            if word:
                if start and _inside(text[start - 1]):
                    continue
                after = next((a for a in (after + 2 if text.startswith("es", after) else -1, after + 1 if text.startswith("s", after) else -1, after) if a >= 0 and not (a < len(text) and _inside(text[a]))), -1)
                if after < 0:
                    continue
            free[places[0]] = after
            for i in places:
                out[i] += 1
        return out


@lru_cache(maxsize=64)
def needles(names: tuple[str, ...], words: bool) -> Needles:
    return Needles(names, words)


def needle_counts(text: Column, names, words: bool = True) -> Column:
    """array<int> of how often each name occurs in a text (lower case as they are); null texts have none. words: names of up to SHORT letters
    count only as a word or its plural, others anywhere; without it all count anywhere."""
    names = tuple(names)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = needles(names, words)
        for texts in batches:
            yield texts.map(held.counts, na_action=None)

    return F.pandas_udf(count, "array<int>")(text)
