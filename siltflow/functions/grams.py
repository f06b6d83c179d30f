"""Grams by which a text that contains a passage is found, whatever the passage: of each run of WINDOW grams of 8 bytes the one of least hash.

A passage of LEAST bytes has such a run whole, and so does any text that contains it, wherever it begins, with the same least gram. About a
fifth of a text's grams are kept. Where what is looked for is known (Wanted), no other gram leaves the task that read its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of the shortest passage that is found; bytes of a text that are looked at at once.
LEAST, PIECE = 16, 1 << 20
WINDOW = LEAST - 8 + 1


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers: two multiplications with odd numbers, with shifts between."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    have, out = 1, values
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _kept(data: np.ndarray) -> Iterator[np.ndarray]:
    """The least grams of each run of a text's bytes, by pieces of it, without repeats side by side."""
    for lo in range(0, max(0, len(data) - LEAST + 1), PIECE):
        x = data[lo : lo + PIECE + LEAST - 1].astype(np.uint64)
        for k in (1, 2, 4):  # numbers of 2, 4 and 8 bytes
            x = (x[:-k] << np.uint64(8 * k)) | x[k:]
        x = _least(_scrambled(x), WINDOW)
        yield x[np.concatenate([[True], x[1:] != x[:-1]])]


def grams(text: str | None) -> np.ndarray:
    """The grams of a text, each once, as signed 64-bit numbers; texts of fewer than LEAST bytes have none. Different grams are different numbers."""
    out = list(_kept(np.frombuffer((text or "").encode(), np.uint8)))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


#: Bytes of a text in lower case as functions.text.normal_quote has them: all but letters and digits are spaces.
_PLAIN = np.array([b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256)], np.uint8)


def plain(text: str | None) -> np.ndarray:
    """The bytes of functions.text.normal_quote of a text, but for a space at either end."""
    x = _PLAIN[np.frombuffer((text or "").lower().encode(), np.uint8)]
    said = x != 32
    said[1:] |= said[:-1].copy()  # of spaces side by side the first
    return x[said]


class Wanted:
    """Grams that are looked for in texts. A table by the last bits of a gram, of eight places a gram or more, tells most others at once."""

    def __init__(self, wanted: np.ndarray):
        self.values = np.unique(wanted.view(np.uint64))
        self.mask = np.uint64((1 << min(25, max(16, len(self.values).bit_length() + 3))) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[self.values & self.mask] = True

    def found(self, text: str | None) -> np.ndarray:
        """Those of normal_quote of a text, each once, as grams() has them."""
        near = [x[self.maybe[x & self.mask]] for x in _kept(plain(text))]
        if not len(self.values) or not near:
            return np.zeros(0, np.int64)
        x = np.unique(np.concatenate(near))
        return x[self.values[np.minimum(np.searchsorted(self.values, x), len(self.values) - 1)] == x].view(np.int64)


def grams_column(text: Column) -> Column:
    """array<bigint> of the grams of a text."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(grams, na_action=None)

    return F.pandas_udf(find, "array<bigint>")(text)
