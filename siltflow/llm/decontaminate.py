"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets, each partition spanning a factor of two. MinHash permutation i picks one
shingle of an item, and a document that holds a share c of the item's shingles holds that one with chance c, however long the document is.
So an item's signature is the list of shingles that its partition's permutations pick (as many as bring the chance of missing a pair at the
threshold below MISS; small items list all their shingles), a document probes all its shingles against the signatures, and the size bound
of a partition (a document needs threshold times the least item size) skips short documents. Candidates are verified by exact containment
of the shingles' words. Items of fewer words than a shingle make partitions by their number of words: each is one sequence, which a document
of any length contains or not. Documents are read once per block of items and never shuffled; the result has contaminated pairs alone.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SHINGLE, U64, bounded_batches, by_text, mix, only, ragged, sequence_hashes, shingle_hashes, shingle_words, written

THRESHOLD, MISS = 0.8, 1e-7
#: Characters of item texts in one block, whose hashes and signatures take some tens of MB; more items make more blocks, each a pass over the documents.
BLOCK_CHARS = 8_000_000
#: Items whose words are kept by a task; all others are hashes.
HELD = 256
_SCHEMA = "doc_id long, item_id long, n_item int, n_shared int, containment double"


def permutations(threshold: float, miss: float = MISS) -> int:
    """How many permutations bring the chance that a document with this containment holds none of the picked shingles below miss."""
    return 1 if threshold >= 1 else math.ceil(math.log(miss) / math.log(1 - threshold))


def signature(sh: np.ndarray, k: int) -> np.ndarray:
    """The shingles that k permutations pick, of all of them if there are at most k."""
    if len(sh) <= k:
        return sh
    seeds = mix(np.arange(1, k + 1, dtype=U64))
    return np.unique(sh[np.argmin(mix(sh[None, :] ^ seeds[:, None]), axis=1)])


class Items:
    """A block of items, partitioned by size, ready to be searched."""

    def __init__(self, ids: list, texts: list[str], threshold: float = THRESHOLD):
        self.threshold, self.ids, self.texts, self.shingles = threshold, ids, texts, []
        self._held: dict[int, set[tuple[str, ...]]] = {}
        k, part, picked, owner = permutations(threshold), [], [], []
        #: By number of words the short items: (sequence hash, item), sorted.
        short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, w, lo, hi in by_text(texts):
            sh = np.unique(shingle_hashes(w.h[lo:hi]))
            self.shingles.append(sh)
            part.append(len(sh).bit_length())
            if 0 < hi - lo < SHINGLE:
                short[hi - lo].append((int(sh[0]), i))
                continue
            sig = signature(sh, k)
            picked.append(sig)
            owner.append(np.full(len(sig), i))
        self.picked, self.owner = _sorted(np.concatenate([np.array([], U64), *picked]), np.concatenate([np.array([], np.int64), *owner]))
        self.short = {n: _sorted(np.array([h for h, _ in x], U64), np.array([i for _, i in x], np.int64)) for n, x in short.items()}
        self.part = np.array(part, np.int64)
        #: By partition the least document size that can contain one of its items to the threshold.
        self.least = {}
        for s, q in zip(self.shingles, part, strict=True):
            self.least[q] = min(self.least.get(q, len(s)), math.ceil(threshold * len(s)))
        # 16 places a picked shingle, so that few of a document's other shingles get past
        bits = max(20, (16 * len(self.picked)).bit_length())
        self.shift, self.seen = U64(64 - bits), np.zeros(1 << bits, bool)
        self.seen[(self.picked >> self.shift).astype(np.int64)] = True

    def words(self, j: int) -> set[tuple[str, ...]]:
        """An item's shingles as words, made when a document may hold it; of the items that documents last did, HELD are kept."""
        if j not in self._held:
            if len(self._held) >= HELD:
                del self._held[next(iter(self._held))]
            ((_, w, lo, hi),) = by_text([self.texts[j]])
            self._held[j] = shingle_words([w.word(x) for x in range(lo, hi)])
        return self._held[j]

    def _candidates(self, sh: np.ndarray) -> list[int]:
        """Items whose signature meets the shingles and whose hashed shingles the threshold, ascending."""
        hit = sh[self.seen[(sh >> self.shift).astype(np.int64)]] if len(self.picked) else sh[:0]
        if not len(hit):
            return []
        found = _owners(self.picked, self.owner, np.unique(hit))
        found = [j for j in found.tolist() if len(sh) >= self.least[self.part[j]]]
        mine = np.unique(sh) if found else sh
        return [j for j in found if _shared(self.shingles[j], mine) >= self.threshold * len(self.shingles[j]) - 1e-9]

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(index of text, index of item, shingles shared) of the pairs that reach the threshold, ascending."""
        for i, w, lo, hi in by_text(texts):
            out = []
            if found := self._candidates(shingle_hashes(w.h[lo:hi])):
                mine = shingle_words([w.word(j) for j in range(lo, hi)])
                for j in found:
                    shared = len(self.words(j) & mine)
                    if shared and shared >= self.threshold * len(self.words(j)) - 1e-9:
                        out.append((j, shared))
            for n, (picked, owner) in self.short.items():
                seq = sequence_hashes(w.h[lo:hi], n)
                at = np.flatnonzero(np.isin(seq, picked))
                if len(at):
                    one = at[np.unique(seq[at], return_index=True)[1]]
                    held = {tuple(w.word(lo + x + y) for y in range(n)) for x in one.tolist()}
                    out += [(j, 1) for j in _owners(picked, owner, np.unique(seq[at])).tolist() if not held.isdisjoint(self.words(j))]
            for j, shared in sorted(out):
                yield i, j, shared


def _sorted(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(values, kind="stable")
    return values[by], owner[by]


def _owners(values: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The owners of the wanted values, each once."""
    a, b = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
    return np.unique(ragged(owner, a, b - a))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many of a are in b; both are sorted, b isn't empty."""
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _blocks(items: DataFrame) -> Iterator[tuple[list, list]]:
    """Items in blocks of bounded size, read in turn: one block is on the driver at a time."""
    ids, texts, size = [], [], 0
    for r in items.where("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1]) + 64
        if size >= BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): every pair in which the document holds at least threshold of the item's distinct
    five-word shingles, once for each row of docs.

    An item of fewer than five words is one sequence of words, held by every document that has them one after another. An item or document
    without words (null, empty) is in no pair. Items with a null id are left out, documents with one keep it. Repeated rows repeat their
    pairs. Empty tables give an empty result. Each further block of items is a pass over the documents, whose pairs are written once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = only(docs, "doc_id", "text")
    parts: list[DataFrame] = []
    for ids, texts in _blocks(items):
        held = spark.sparkContext.broadcast((ids, texts))  # at most BLOCK_CHARS

        def run(batches, held=held, threshold=threshold):
            block = Items(*held.value, threshold)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[i], block.ids[j], len(block.words(j)), n, n / len(block.words(j))) for i, j, n in block.search(batch.column("text").to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

        parts.append(text.mapInArrow(run, _SCHEMA))
        if len(parts) > 1:  # of many blocks one is in memory at a time
            parts[-2:] = [*([written(parts[0], "contaminated")] if len(parts) == 2 else parts[-2:-1]), written(parts[-1], "contaminated")]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], _SCHEMA)


def _contains(held, threshold: float):
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = Items(*held.value, threshold)
        for batch in batches:
            out = np.zeros(len(batch), bool)
            for i, _, _ in block.search([t if isinstance(t, str) else None for t in batch]):
                out[i] = True
            yield pd.Series(out)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text contains an item; the columns stay. Each row is judged by its own text, so null and repeated ids
    make no difference; nothing is shuffled or joined. Each further block of items is a pass over the rows that are left, written between."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for k, (ids, texts) in enumerate(_blocks(items)):
        held = spark.sparkContext.broadcast((ids, texts))  # at most BLOCK_CHARS
        if k:  # what the block before left is written, so that a task holds one block at a time
            docs = written(docs, "clean")
        docs = docs.where(~_contains(held, threshold)(F.col("text")))
    return docs
