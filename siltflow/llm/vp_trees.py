"""Nearest neighbours by largest inner product: vantage-point trees per shard.

One more component, the square root of the greatest squared norm less the vector's, makes all vectors equally long, so that the largest inner
products with a query are the least Euclidean distances, and the triangle inequality holds. A top tree, made of a bounded sample, deals all
vectors into leaves, and leaves into shards of bounded size, each with a tree of its own. Every query first searches the shard that it lies in;
the distance of its k-th neighbour there bounds all that follows: a leaf or subtree whose distance bound exceeds FACTOR times the k-th distance
so far is not entered. A factor of one is exact, a lesser one prunes more. Queries go in blocks of bounded size to the shards of the leaves that
a block's bounds reach; what a block finds in each shard is merged by query.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import only, written

SHARD_ROWS, BLOCK_ROWS, LEAF, K, FACTOR = 8192, 4096, 64, 20, 1.0
#: Leaves of a top tree at most, and rows of each leaf in the sample that it is made of. Larger leaves have more shards.
MOST_LEAVES, SAMPLE_ROWS = 1024, 16
#: Blocks of queries that one task sends to a shard's tree, on average.
BLOCKS_A_TASK = 16
SEED = 11


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, nor holding null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.exists(v, lambda x: x != 0)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in the order of the components."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


class Top:
    """A vantage-point tree over a sample of equally long vectors, whose leaves divide all vectors of one dimension. most: the greatest
    squared norm of all."""

    def __init__(self, sample: np.ndarray, leaves: int, most: float):
        self.most, self.vantage, self.nodes = most, [], []
        #: by leaf the nodes above it
        self.above: list[list[int]] = []
        rng = np.random.default_rng(SEED)

        def build(rows: np.ndarray, leaves: int, above: list[int]) -> int:
            if leaves < 2 or len(rows) < 2:
                self.above.append(above)
                return -len(self.above)
            k = len(self.nodes)
            self.vantage.append(rows[rng.integers(len(rows))])
            d = self.between(rows, k)
            middle = float(np.median(d))
            self.nodes.append([middle, 0, 0])
            inner = d < middle
            if inner.any():
                self.nodes[k][1:] = build(rows[inner], leaves // 2, [*above, k]), build(rows[~inner], leaves - leaves // 2, [*above, k])
                return k
            self.nodes.pop()
            self.vantage.pop()
            self.above.append(above)
            return -len(self.above)

        self.root = build(sample, leaves, [])

    def between(self, x: np.ndarray, node: int) -> np.ndarray:
        """Distances of the vectors, made equally long, from a vantage point."""
        v = self.vantage[node]
        last = np.sqrt(np.maximum(0, self.most - (x**2).sum(axis=1)) * max(0.0, self.most - float(v @ v)))
        return np.sqrt(np.maximum(0, 2 * (self.most - x @ v - last)))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            if k < 0:
                out[rows] = -k - 1
            elif len(rows):
                inner = self.between(x[rows], k) < self.nodes[k][0]
                todo += [(self.nodes[k][1], rows[inner]), (self.nodes[k][2], rows[~inner])]
        return out

    def reached(self, q: np.ndarray, kth: np.ndarray, bounds: dict[int, list[tuple[float, float]]], factor: float) -> dict[int, np.ndarray]:
        """By leaf the queries that it may hold a nearer vector for than their k-th so far, whose product is kth. bounds: by leaf the least and
        greatest distance of its vectors from each vantage point above it."""
        square = (q**2).sum(axis=1)
        most = np.sqrt(np.maximum(0, square + self.most - 2 * (kth - 1e-9 * (1 + np.sqrt(square * self.most))))) * factor + 1e-9
        d = {k: np.sqrt(np.maximum(0, square + self.most - 2 * (q @ self.vantage[k]))) for k in {k for leaf in bounds for k in self.above[leaf]}}
        out = {}
        for leaf, spans in bounds.items():
            least = np.zeros(len(q))
            for k, (low, high) in zip(self.above[leaf], spans, strict=True):
                least = np.maximum(least, np.maximum(d[k] - high, low - d[k]))
            rows = np.flatnonzero((least <= most) | ~np.isfinite(kth))
            if len(rows):
                out[leaf] = rows
        return out


class Tree:
    """A vantage-point tree over the rows of x. Nodes are listed before their children; a leaf is a range of rows. Rows are numbered in the
    order of ids and keys; a key tells rows with one id apart."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, keys: np.ndarray | None = None):
        keys = np.arange(len(ids)) if keys is None else keys
        order = np.lexsort((keys, ids))
        self.ids, self.keys, self.x = ids[order], keys[order], np.ascontiguousarray(x[order], np.float64)
        square = (self.x**2).sum(axis=1)
        self.top = float(square.max()) if len(x) else 0.0
        lifted = np.hstack([self.x, np.sqrt(np.maximum(0, self.top - square))[:, None]])
        rng = np.random.default_rng(SEED)
        perm = np.arange(len(x))
        #: by node: row of the vantage point; first and last row, both children (0 in a leaf), least and greatest distance of each child
        self.nodes: list[list[int]] = []
        self.span: list[list[float]] = []

        def build(lo: int, hi: int) -> int:
            k = len(self.nodes)
            self.nodes.append([0, lo, hi, 0, 0])
            self.span.append([0.0] * 4)
            if hi - lo <= LEAF:
                return k
            rows = perm[lo:hi]
            tried = rng.choice(rows, min(8, len(rows)), replace=False)
            some = lifted[rng.choice(rows, min(64, len(rows)), replace=False)]
            spread = [np.var(np.sqrt(((some - lifted[t]) ** 2).sum(axis=1))) for t in tried]
            vantage = int(tried[int(np.argmax(spread))])
            d = np.sqrt(((lifted[rows] - lifted[vantage]) ** 2).sum(axis=1))
            by = np.argsort(d, kind="stable")
            perm[lo:hi], d = rows[by], d[by]
            mid = (hi - lo) // 2
            self.nodes[k][0] = vantage
            self.span[k] = [d[0], d[mid - 1], d[mid], d[-1]]
            self.nodes[k][3] = build(lo, lo + mid)
            self.nodes[k][4] = build(lo + mid, hi)
            return k

        if len(x):
            build(0, len(x))
        self.perm, self.lifted = perm, lifted

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, keys=self.keys, x=self.x.astype(np.float64), nodes=np.array(self.nodes, np.int64).reshape(-1, 5), span=np.array(self.span).reshape(-1, 4), perm=self.perm, top=self.top)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        z = np.load(io.BytesIO(data))
        t = cls.__new__(cls)
        t.ids, t.keys, t.x, t.perm, t.top = z["ids"], z["keys"], z["x"], z["perm"], float(z["top"])
        t.nodes, t.span = z["nodes"].tolist(), z["span"].tolist()
        t.lifted = np.hstack([t.x, np.sqrt(np.maximum(0, t.top - (t.x**2).sum(axis=1)))[:, None]])
        return t

    def search(self, keys: np.ndarray, q: np.ndarray, k: int = K, factor: float = FACTOR, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of query, number of row, score) of each query's k nearest, the row with its own key left out; ties to the smaller id, then
        key. least: for each query a score below which nothing counts. self.scored: products taken."""
        n = len(q)
        score, near = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.scored = 0
        if not n or not len(self.x):
            return np.array([], np.int64), np.array([], np.int64), np.array([])
        least = np.full(n, -np.inf) if least is None else least
        square = (q**2).sum(axis=1)
        slack = 1e-9 * (1 + np.sqrt(square * self.top))

        def kth(rows=slice(None)) -> np.ndarray:
            return np.maximum(score[rows, -1], least[rows]) - slack[rows]

        def leaf(node: list[int], rows: np.ndarray) -> None:
            mine = self.perm[node[1] : node[2]]
            s = q[rows] @ self.x[mine].T
            self.scored += s.size
            a, b = np.nonzero(s >= kth(rows)[:, None])
            a, b = rows[a], mine[b]
            keep = self.keys[b] != keys[a]
            a, b = a[keep], b[keep]
            if not len(a):
                return
            hit = np.unique(a)
            every_q = np.concatenate([a, np.repeat(hit, k)])
            every_s = np.concatenate([exact(q[a], self.x[b]), score[hit].ravel()])
            every_i = np.concatenate([b, near[hit].ravel()])
            by = np.lexsort((every_i, -every_s, every_q))
            first = np.searchsorted(every_q[by], hit)
            take = by[(first[:, None] + np.arange(k)[None, :])]
            score[hit], near[hit] = every_s[take], every_i[take]

        def reach() -> np.ndarray:
            """The distance of the k-th neighbour so far."""
            return np.sqrt(np.maximum(0, square + self.top - 2 * kth()))

        # first each query's own way down, for a good start; then everything within reach
        done: dict[int, np.ndarray] = {}
        todo = [(0, np.arange(n))]
        while todo:
            i, rows = todo.pop()
            node, span = self.nodes[i], self.span[i]
            if not node[3]:
                leaf(node, rows)
                done[i] = rows
                continue
            d = self._distance(q[rows], square[rows], node[0])
            inner = d < (span[1] + span[2]) / 2
            todo += [(node[c], part) for c, part in ((3, rows[inner]), (4, rows[~inner])) if len(part)]
        todo = [(0, np.arange(n))]
        while todo:
            i, rows = todo.pop()
            node, span = self.nodes[i], self.span[i]
            if not node[3]:
                if i in done:
                    rows = np.setdiff1d(rows, done[i], assume_unique=True)
                if len(rows):
                    leaf(node, rows)
                continue
            d = self._distance(q[rows], square[rows], node[0])
            most = reach()[rows] * factor + 1e-9
            for c in (4, 3):
                low, high = span[2 * c - 6], span[2 * c - 5]
                within = np.maximum(d - high, low - d) <= most
                if within.any():
                    todo.append((node[c], rows[within]))
        a, b = np.nonzero(np.isfinite(score))
        return a, near[a, b], score[a, b]

    def _distance(self, q: np.ndarray, square: np.ndarray, vantage: int) -> np.ndarray:
        return np.sqrt(np.maximum(0, square + self.top - 2 * (q @ self.x[vantage])))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), np.float64)


def _tops(vectors: DataFrame) -> dict[int, Top]:
    """By dimension the top tree of (row, v, dim). The driver gets a row for each dimension, and SAMPLE_ROWS rows for each leaf of all trees,
    those of least hash."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("most")).collect()
    leaves = {r["dim"]: min(MOST_LEAVES, math.ceil(r["n"] / SHARD_ROWS)) for r in sizes}
    out = {}
    for r in sizes:
        n, sample = leaves[r["dim"]], np.zeros((0, r["dim"]))
        if n > 1:
            chosen = vectors.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("row"), "row").limit(n * SAMPLE_ROWS)
            sample = np.array([x[0] for x in chosen.select("v").collect()], np.float64)
        # rounding must not make any vector longer than the longest
        out[r["dim"]] = Top(sample, n, r["most"] * (1 + 1e-12))
    return out


def index(vectors: DataFrame, tops: dict[int, Top]) -> tuple[DataFrame, DataFrame]:
    """(dealt, trees): vectors (row, vec_id, v, dim) with leaf and part, and (dim, leaf, part, tree, low, high) for each shard, a part of a leaf
    with SHARD_ROWS rows on average; low and high are the least and greatest distances of its rows from the leaf's vantage points."""
    held = vectors.sparkSession.sparkContext.broadcast(tops)  # MOST_LEAVES vantage points a dimension at most

    def deal(batches):
        for pdf in batches:
            pdf["leaf"] = 0
            for dim, rows in pdf.groupby("dim").indices.items():
                pdf.iloc[rows, pdf.columns.get_loc("leaf")] = held.value[int(dim)].leaf(_matrix(pdf["v"].iloc[rows]))
            yield pdf

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, leaf, part = (int(pdf[c].iloc[0]) for c in ("dim", "leaf", "part"))
        x, top = _matrix(pdf["v"]), held.value[dim]
        d = [top.between(x, k) for k in top.above[leaf]]
        tree = Tree(pdf["vec_id"].to_numpy(np.int64), x, pdf["row"].to_numpy(np.int64)).dump()
        return pd.DataFrame({"dim": [dim], "leaf": [leaf], "part": [part], "tree": [tree], "low": [[float(y.min()) for y in d]], "high": [[float(y.max()) for y in d]]})

    placed = written(vectors.mapInPandas(deal, "row long, vec_id long, v array<double>, dim int, asked boolean, leaf long"), "placed")
    parts = placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("parts"))
    dealt = placed.join(F.broadcast(parts), ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    trees = dealt.groupBy("dim", "leaf", "part").applyInPandas(build, "dim int, leaf long, part long, tree binary, low array<double>, high array<double>")
    return dealt, written(trees, "trees")


_FOUND = "query long, query_id long, vec_id long, row long, score double"


def _search(pairs: DataFrame, k: int, factor: float) -> DataFrame:
    """(query, query_id, vec_id, row, score) from rows that are sorted so that a tree comes before the blocks (ids, keys, q, least) that ask it."""

    def run(batches):
        tree = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["tree"] is not None:
                    tree = Tree.load(r["tree"])
                    continue
                ids, keys, least = (np.frombuffer(r[c], t) for c, t in (("ids", np.int64), ("keys", np.int64), ("least", np.float64)))
                a, b, score = tree.search(keys, np.frombuffer(r["q"]).reshape(len(ids), -1), k, factor, least)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[a], ids[a], tree.ids[b], tree.keys[b], score)], [c.split()[0] for c in _FOUND.split(", ")])

    return pairs.select("tree", "ids", "keys", "q", "least").mapInArrow(run, _FOUND)


def _meet(trees: DataFrame, blocks: DataFrame, tasks: int) -> DataFrame:
    """Trees and the written blocks that ask them, (dim, leaf, part) alike, side by side. The blocks of a tree are dealt to tasks, and the tree goes
    to those of them that have a block for it."""
    none = lambda kind, *cols: [F.lit(None).cast(kind).alias(c) for c in cols]
    key = ("dim", "leaf", "part", "task")
    dealt = blocks.withColumn("task", F.pmod(F.xxhash64("ids"), F.lit(tasks)).cast("int"))
    left = trees.select(*key[:3], "tree").join(dealt.select(*key).distinct(), list(key[:3])).select(*key, "tree", *none("binary", "ids", "keys", "q", "least"))
    right = dealt.select(*key, *none("binary", "tree"), "ids", "keys", "q", "least")
    return left.unionByName(right).repartition(*key).sortWithinPartitions(*key, F.col("tree").isNull())


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["vec_id", "row"])
    x = {"ids": pdf["vec_id"].to_numpy(np.int64), "keys": pdf["row"].to_numpy(np.int64), "q": _matrix(pdf["v"]), "least": pdf["least"].to_numpy(np.float64)}
    return pd.DataFrame({**{c: [int(pdf[c].iloc[0])] for c in ("dim", "leaf", "part")}, **{c: [v.tobytes()] for c, v in x.items()}})


_BLOCK = "dim int, leaf long, part long, ids binary, keys binary, q binary, least binary"


def nearest(vectors: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors with the largest inner product with each query row, of all rows but its own.

    Unusable vectors (null, empty, zero, with null or non-finite components) and rows with a null id take no part; rows that repeat an id are
    rows of their own, as queries as well; vectors of different lengths aren't compared. With fewer candidates than k all are returned.
    """
    spark = vectors.sparkSession
    base = only(vectors, id_col, vector_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim"), is_query.alias("asked"))
    base = written(base, "vectors")
    tops = _tops(base)
    dealt, trees = index(base, tops)
    asked = dealt.where("asked").select("dim", "leaf", "part", "row", "vec_id", "v")
    # every query in its own shard; a shard's queries are at most its rows
    home = written(asked.withColumn("least", F.lit(float("-inf"))).groupBy("dim", "leaf", "part").applyInPandas(_pack, _BLOCK), "home")
    near = written(_search(_meet(trees, home, 1), k, factor), "near")
    shards = trees.count()
    if shards <= len(tops):  # a shard each
        found = near
    else:
        kth = near.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        bounded = asked.join(kth.select(F.col("query").alias("row"), F.when(F.col("n") >= k, F.col("least")).alias("least")), "row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        blocks = bounded.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(max(1, SHARD_ROWS // BLOCK_ROWS)))).groupBy("dim", "leaf", "part", "block").applyInPandas(_pack, _BLOCK)
        blocks = written(blocks, "blocks")
        # a row for each leaf: its parts, and the bounds of all its vectors
        spans = trees.select("dim", "leaf", "part", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x")).groupBy("dim", "leaf", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
        leaves: dict[int, dict[int, list]] = {}
        parts = {(r["dim"], r["leaf"]): r["n"] for r in trees.groupBy("dim", "leaf").agg(F.count("*").alias("n")).collect()}
        for dim, leaf in parts:
            leaves.setdefault(dim, {})[leaf] = []
        for r in spans.orderBy("at").collect():
            leaves[r["dim"]][r["leaf"]].append((r["low"], r["high"]))
        held = spark.sparkContext.broadcast((tops, leaves, parts))  # MOST_LEAVES rows a dimension at most

        def spread(batches):
            tops, leaves, parts = held.value
            for batch in batches:
                for r in batch.to_pylist():
                    ids, keys, least = (np.frombuffer(r[c], t) for c, t in (("ids", np.int64), ("keys", np.int64), ("least", np.float64)))
                    q = np.frombuffer(r["q"]).reshape(len(ids), -1)
                    for leaf, rows in tops[r["dim"]].reached(q, least, leaves[r["dim"]], factor).items():
                        cols = [x[rows].tobytes() for x in (ids, keys, q, least)]
                        to = [p for p in range(parts[r["dim"], leaf]) if (leaf, p) != (r["leaf"], r["part"])]
                        for p in to:
                            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([r["dim"], leaf, p, *cols], [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4], strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

        far = written(blocks.mapInArrow(spread, _BLOCK), "far")
        found = near.unionByName(_search(_meet(trees, far, max(1, math.ceil(blocks.count() / BLOCKS_A_TASK))), k, factor))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
