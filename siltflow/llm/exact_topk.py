"""Exact top-k by integer inner products: exhaustive term-at-a-time accumulation.

A vector's components become whole numbers, floor(scale * x). A component's place is a term. Rows are dealt by hash into blocks of bounded size,
and of each block the postings are made once: for each term the rows whose number is not zero, and these numbers. A query row is sparse, a list
of (term, weight); term by term it adds weight times postings into a dense array with a score for each row of the block. Of the array, those
above the k-th greatest score are taken by partition selection, and merged into the query's best so far; at the end the bests of all shards (runs
of blocks) are merged by query. Everything is scored, nothing is pruned, and a score is exact: arrays are of 32 or 64 bits, whichever holds the
greatest sum that a block can give, and beyond 64 bits of Python's whole numbers.

A task holds one group of queries with their bests and one block at a time. Groups meet shards through a shuffle by (shard, group): the rows of
a shard are sent once for each group of GROUP_QUERIES queries, and the queries once for each shard of SHARD_ROWS rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, only, written

SCALE, K = 64, 20
#: Rows of a block and of a shard, and queries of a group, on average; LEAST_ROWS: blocks of small tables have so many, so that all cores work.
BLOCK_ROWS, LEAST_ROWS, SHARD_ROWS, GROUP_QUERIES = 16_384, 1_024, 1 << 19, 1 << 15
#: Queries that add into one array of scores together.
SIDE_BY_SIDE = 64
#: A term that this share of a block's rows have is kept as a number for each row of the block; adding zeros changes nothing.
FULL = 0.25
LONG = np.iinfo(np.int64)
_NONE = LONG.max


def usable(v: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True))


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of a matrix, exactly: of 64 bits where all numbers are within 2^62, else Python's."""
    if not x.size or np.abs(x).max() < 2.0**62 / scale:
        return np.floor(x * scale).astype(np.int64)
    # from 2^53 on a double is whole
    return np.array([[math.floor(v * scale) if abs(v) < 2.0**53 else int(v) * scale for v in row] for row in x.tolist()], object).reshape(x.shape)


def _type(q: np.ndarray, most: int) -> np.dtype:
    """The least type that holds all sums of products of the queries q with a block whose greatest absolute number is most."""
    bound = int(abs(q).sum(axis=1).max(initial=0)) * most if q.dtype == object else int(np.abs(q).max(initial=0)) * q.shape[1] * most
    return np.dtype(np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 62 else object)


class Postings:
    """The postings of a block: ids and keys of its rows, in the order of ids and then keys, and for each term (rows or None for all, numbers)."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, numbers: np.ndarray):
        order = np.lexsort((keys, ids))
        self.ids, self.keys, numbers = ids[order], keys[order], numbers[order]
        self.most = int(abs(numbers).max()) if numbers.size else 0
        self.terms = []
        for t in range(numbers.shape[1]):
            rows = np.flatnonzero(numbers[:, t] != 0)
            every = len(rows) >= FULL * len(self.ids)
            self.terms.append((None, np.ascontiguousarray(numbers[:, t])) if every else (rows, numbers[rows, t]))
        self._as: dict = {}

    def term(self, t: int, kind: np.dtype) -> tuple[np.ndarray | None, np.ndarray]:
        if (t, kind) not in self._as:
            rows, numbers = self.terms[t]
            self._as[t, kind] = rows, numbers.astype(kind)
        return self._as[t, kind]

    def scores(self, q: np.ndarray) -> np.ndarray:
        """A row of scores for each query."""
        kind = _type(q, self.most)
        out = np.zeros((len(q), len(self.ids)), kind)
        held = np.empty(len(self.ids), kind)
        for t in range(q.shape[1]):
            asked = np.flatnonzero(q[:, t] != 0)
            if not len(asked):
                continue
            rows, numbers = self.term(t, kind)
            if not len(numbers):
                continue
            weights = q[asked, t].astype(kind)
            for i, w in zip(asked.tolist(), weights, strict=True):
                if rows is None:
                    np.multiply(numbers, w, out=held)
                    out[i] += held
                else:
                    out[i, rows] += numbers * w
        return out

    def best(self, keys: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of each query's k greatest scores in the block, ties to the first row; the query's own row left out. Scores
        beyond 64 bits count as the greatest or least such number."""
        a, b, s = [], [], []
        own = {x: i for i, x in enumerate(self.keys.tolist())}
        for lo in range(0, len(q), SIDE_BY_SIDE):
            score = self.scores(q[lo : lo + SIDE_BY_SIDE])
            if score.dtype == object:
                score = np.clip(score, LONG.min + 1, LONG.max).astype(np.int64)
            least = np.iinfo(score.dtype).min  # below all scores
            mine = [(i, own[x]) for i, x in enumerate(keys[lo : lo + SIDE_BY_SIDE].tolist()) if x in own]
            if mine:
                score[tuple(np.array(mine).T)] = least
            n = score.shape[1]
            kth = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), least, score.dtype)
            over = score > kth[:, None]
            for i in range(len(score)):
                rows = np.flatnonzero(over[i])
                more = k - len(rows)
                if more > 0 and kth[i] > least:
                    rows = np.concatenate([rows, np.flatnonzero(score[i] == kth[i])[:more]])
                a.append(np.full(len(rows), lo + i))
                b.append(rows)
                s.append(score[i, rows].astype(np.int64))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, s))


class Bests:
    """The k best rows so far of each query of a group."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.keys, self.q, self.k = ids, keys, q, k
        self.query = self.vec = self.key = self.score = np.zeros(0, np.int64)

    def add(self, block: Postings) -> None:
        a, b, s = block.best(self.keys, self.q, self.k)
        query, vec = np.concatenate([self.query, a]), np.concatenate([self.vec, block.ids[b]])
        key, score = np.concatenate([self.key, block.keys[b]]), np.concatenate([self.score, s])
        order = np.lexsort((key, vec, ~score, query))  # ~score descends where score ascends, and never overflows
        query, vec, key, score = query[order], vec[order], key[order], score[order]
        first = np.searchsorted(query, np.arange(len(self.ids)))
        keep = np.arange(len(query)) - first[query] < self.k
        self.query, self.vec, self.key, self.score = query[keep], vec[keep], key[keep], score[keep]


def _matrix(v: pd.Series, dim: int) -> np.ndarray:
    return np.array(v.tolist(), np.float64).reshape(len(v), dim)


_PACK = "dim int, part int, ids binary, keys binary, v binary"
_FOUND = "query long, query_id long, vec_id long, row long, score long"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    x = {"ids": pdf["vec_id"].to_numpy(np.int64), "keys": pdf["row"].to_numpy(np.int64), "v": _matrix(pdf["v"], int(pdf["dim"].iloc[0]))}
    return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "part": [int(pdf["part"].iloc[0])], **{c: [v.tobytes()] for c, v in x.items()}})


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows of vectors with the highest integer inner product, of all but its own row.

    Components become floor(scale * x), x as double; equal scores go to the smaller id, then to the earlier row. Vectors that are null or hold
    null or non-finite components, and rows with a null id, take no part; zero vectors do, with scores of zero. Rows that repeat an id are rows
    of their own, as queries as well. Vectors of different lengths aren't compared; empty ones only with each other, at zero. With fewer
    candidates than k all are returned; an empty table gives no rows. A score beyond a long counts as the nearest long. Further columns of any
    name are left out.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    base = only(vectors, id_col, vector_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    base = written(base.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asked")), "numbers")
    n, asked = base.agg(F.count("*"), F.count_if("asked")).first()
    cores = spark.sparkContext.defaultParallelism
    rows = min(BLOCK_ROWS, max(LEAST_ROWS, math.ceil(n / (2 * cores))))
    blocks, groups = max(1, math.ceil(n / rows)), max(1, math.ceil(asked / GROUP_QUERIES))
    shards = max(1, math.ceil(n / SHARD_ROWS), min(blocks, math.ceil(2 * cores / groups)))
    deal = lambda many, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(many)).cast("int").alias("part")
    cols = ("row", "vec_id", "v", "dim")
    held = base.select(*cols, deal(blocks, 0)).groupBy("dim", "part").applyInPandas(_pack, _PACK)
    # a group's queries come in packs of at most some thousands, so that no pack is large
    packs = max(1, math.ceil(asked / 4096))
    asking = base.where("asked").select(*cols, deal(packs, 1)).groupBy("dim", "part").applyInPandas(_pack, _PACK)
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = asking.withColumn("group", F.col("part") % groups).withColumn("shard", each(shards)).withColumn("kind", F.lit(0))
    right = held.withColumn("shard", F.col("part") % shards).withColumn("group", each(groups)).withColumn("kind", F.lit(1))
    order = ("shard", "group", "dim", "kind")
    pairs = left.unionByName(right).repartition("shard", "group", "dim").sortWithinPartitions(*order)

    def run(batches):
        at, asks, best = None, [], None

        def result():
            if best is not None and len(best.query):
                cols = (best.keys[best.query], best.ids[best.query], best.vec, best.key, best.score)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], [c.split()[0] for c in _FOUND.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if (now := (r["shard"], r["group"], r["dim"])) != at:
                    yield from result()
                    at, asks, best = now, [], None
                ids, keys = (np.frombuffer(r[c], np.int64) for c in ("ids", "keys"))
                v = whole(np.frombuffer(r["v"]).reshape(len(ids), r["dim"]), scale)
                if not r["kind"]:
                    asks.append((ids, keys, v))
                elif asks:
                    best = best or Bests(*(np.concatenate(x) for x in zip(*asks, strict=True)), k)
                    best.add(Postings(ids, keys, v))
        yield from result()

    found = pairs.select(*order, "ids", "keys", "v").mapInArrow(run, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
