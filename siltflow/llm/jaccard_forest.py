"""N-gram Jaccard join by a MinHash LSH forest.

Each distinct text has a MinHash signature, cut into TREES labels of DEPTH values. A tree of the forest is the sorted list of one label of
every text, in which a node of the prefix trie is a run of equal prefixes. A pair of similarity s meets with chance 1 - (1 - s^d)^TREES at depth
d. The join starts at the longest prefixes that find a pair just at the threshold with LEAST_CHANCE; from the similarities of the links found
there it estimates what share of all links they are, and shortens the prefixes, by one value at a time, until that reaches the target.

Pairs are never rows. A run ties its texts to its least one, which is linear in its size; texts tied together, over any number of steps, form
a candidate group, in which every two texts are verified by their exact Jaccard similarity, as the number of a text's links is part of the
result. A large group is dealt into blocks by a hash, of so many texts and shingles at most on average, each pair of blocks a task, so that no
task holds more than two. A task returns, for each text, how many links it has there and the least text that these
links reach, so a group of copies of one another costs rows in proportion to its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_batches, by_text, mix, only, shingle_hashes, written

TREES, DEPTH, THRESHOLD, TARGET = 20, 6, 0.8, 0.9999
#: Least chance that the forest finds a pair just at the threshold, whatever the links found so far suggest.
LEAST_CHANCE = 0.9995
#: Texts, and shingles of them, in a block of a candidate group.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000

_SEEDS = mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64))
_XOR, _MUL = (_SEEDS[: TREES * DEPTH] >> np.uint64(32)).astype(np.uint32), (_SEEDS[TREES * DEPTH :] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minhash(sh: np.ndarray) -> np.ndarray:
    """TREES x DEPTH MinHash values (uint32) of a non-empty set of shingle hashes."""
    low = (sh ^ (sh >> np.uint64(32))).astype(np.uint32)
    out = np.empty(len(_XOR), np.uint32)
    for lo in range(0, len(low), 4096):
        part = low[lo : lo + 4096]
        x = part[None, :] ^ _XOR[:, None]
        x *= _MUL[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        least = x.min(axis=1)
        out = least if lo == 0 else np.minimum(out, least)
    return out


def labels(sh: np.ndarray) -> bytes:
    """The text's labels, one per tree: a byte that names the tree, then DEPTH big-endian values; prefixes sort as the trie does."""
    values = minhash(sh).reshape(TREES, DEPTH).astype(">u4").view(np.uint8).reshape(TREES, DEPTH * 4)
    return np.hstack([np.arange(TREES, dtype=np.uint8)[:, None], values]).tobytes()


def _signatures(batches):
    for batch in batches:
        n, lab = [], []
        for _, w, lo, hi in by_text(batch.column("text").to_pylist()):
            sh = np.unique(shingle_hashes(w.h[lo:hi]))
            n.append(len(sh))
            lab.append(labels(sh) if len(sh) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(n, pa.int32()), pa.array(lab, pa.binary())], ["doc_id", "node", "n", "labels"])


def _sets(batches):
    for batch in batches:
        out = [np.unique(shingle_hashes(w.h[lo:hi])).tobytes() for _, w, lo, hi in by_text(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "component", "block", "blocks")], pa.array(out, pa.binary())], ["id", "component", "block", "blocks", "sh"])


def chance(similarity, depth: int):
    """That a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def with_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, text and node: the text's digest, alike for exact copies; a null text is an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return only(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("node"))


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    m = len(sets)
    if m == 2:
        x, y = sorted(sets, key=len)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        n = int((y[at] == x).sum())
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    out = np.zeros((m, m))
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    width = max(1, 4_000_000 // m)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((m, width), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.int64)


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row of its component."""
    root = np.arange(len(linked))
    while True:
        least = np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify_group(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float, depth: int = DEPTH):
    """(id, links, root, stand) of the texts of a pair of blocks; within one block (all side 0) every two, else those of different sides.
    stand: for how many links its links stand, each for 1 / its chance at this depth, and how many of these each depth, from 1 on, finds."""
    by = np.argsort(ids, kind="stable")
    ids, side, sets = ids[by], side[by], [sets[i] for i in by]
    both = shared(sets).astype(float)
    size = both.diagonal()
    similarity = both / (size[:, None] + size[None, :] - both)
    linked = similarity >= threshold
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    similarity = np.where(linked, similarity, 1.0)
    one = np.where(linked, 1 / chance(similarity, depth), 0)
    stand = np.stack([one.sum(axis=1), *[(one * chance(similarity, d)).sum(axis=1) for d in range(1, DEPTH + 1)]], axis=1)
    some = np.flatnonzero(linked.any(axis=1))
    return ids[some], linked.sum(axis=1)[some], ids[roots(linked)][some], list(stand[some])


def _verify(threshold: float, depth: int):
    def run(batches):
        held: list[tuple] = []

        def out():
            if len(held) < 2:
                return None
            _, ids, side, raw = zip(*held, strict=True)
            found = _verify_group(np.array(ids), np.array(side), [np.frombuffer(x, np.uint64) for x in raw], threshold, depth)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["id", "links", "root", "stand"])

        for batch in batches:
            for row in zip(zip(*[batch.column(c).to_pylist() for c in ("component", "lo", "hi")], strict=True), *[batch.column(c).to_pylist() for c in ("id", "side", "sh")], strict=True):
                if held and held[0][0] != row[0]:
                    if (done := out()) is not None:
                        yield done
                    held = []
                held.append(row)
        if (done := out()) is not None:
            yield done

    return run


def _groups(nodes: DataFrame, depth: int) -> DataFrame:
    """(id, component): texts that share a prefix of this depth in some tree, directly or over others."""
    wide = 1 + 4 * DEPTH
    prefix = F.explode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> substring(labels, t * {wide} + 1, {1 + 4 * depth}))"))
    keys = nodes.select("id", prefix.alias("prefix"))
    least = keys.groupBy("prefix").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("prefix", "least")
    ties = keys.join(least, "prefix").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    return written(components(ties).select(F.col("node").alias("id"), "component"), "groups")


def _found(base: DataFrame, nodes: DataFrame, depth: int, threshold: float) -> DataFrame:
    """(id, links, root, stand): for each text and task the links verified there."""
    tied = _groups(nodes, depth)
    held = tied.join(nodes.select("id", F.col("node").alias("of"), "n", F.col("doc_id").alias("one")), "id")
    size = held.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = held.join(size, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # by the id too, so that copies of one text don't meet in one key
    texts = placed.join(base, (F.col("of") == F.col("node")) & F.col("one").eqNullSafe(F.col("doc_id"))).select("id", "component", "block", "blocks", "text")
    schema = "id long, component long, block int, blocks int, sh binary"
    sets = written(texts.mapInArrow(_sets, schema), "sets").dropDuplicates(["id"])
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select("component", lo.alias("lo"), hi.alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "sh")
    dealt = dealt.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    return written(dealt.mapInArrow(_verify(threshold, depth), "id long, links long, root long, stand array<double>"), "links")


def signatures(base: DataFrame) -> DataFrame:
    """(id, node, doc_id, n, labels): a row for each distinct text with words, id numbering them; doc_id is of one of its rows."""
    nodes = base.mapInArrow(_signatures, "doc_id long, node binary, n int, labels binary").where("n > 0").dropDuplicates(["node"])
    return written(nodes.withColumn("id", F.monotonically_increasing_id()), "signatures")


def links(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> tuple[DataFrame, DataFrame]:
    """(nodes, found): the distinct texts, and for each text and task (id, links, root): the number of other texts with Jaccard similarity of
    word shingles >= threshold there, and the least one that they reach. A pair of texts is in exactly one task. A text without words has no
    links. Nothing is dropped for a run's or group's size."""
    bounded_batches(docs.sparkSession)
    base = with_nodes(docs)
    nodes = signatures(base)
    depth = max((d for d in range(1, DEPTH + 1) if chance(threshold, d) >= LEAST_CHANCE), default=1)
    while True:
        found = _found(base, nodes, depth, threshold)
        if depth == 1 or chance(threshold, depth) >= target:
            return nodes, found
        every, mine = found.agg(*[F.coalesce(F.sum(F.col("stand")[d]), F.lit(0.0)) for d in (0, depth)]).first()
        if mine >= target * every:
            return nodes, found
        depth -= 1


def _classes(docs: DataFrame, threshold: float, target: float) -> tuple[DataFrame, DataFrame]:
    """(copies, linked): (node, copy_of) of every distinct text, and (node, copy_of, n_links, class_id, first) of those with links; first is
    the text that stands for its class, that of the least doc_id."""
    nodes, found = links(docs, threshold, target)
    copies = with_nodes(docs).groupBy("node").agg(F.min("doc_id").alias("copy_of"))
    degree = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    joined = written(components(found, "id", "root").withColumnRenamed("node", "id"), "components").join(degree, "id").join(nodes.select("id", "node"), "id").join(copies, "node")
    order = F.struct(F.col("copy_of").isNull(), "copy_of", "node")
    least = joined.groupBy("component").agg(F.min("copy_of").alias("class_id"), F.min_by("node", order).alias("first"))
    return copies, joined.join(least, "component").select("node", "copy_of", "n_links", "class_id", "first")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """One row per row of docs: doc_id, class_id, copy_of, n_links.

    copy_of: the least doc_id with exactly this text. class_id: the least doc_id of the texts that links join to it, over any number of
    steps. n_links: other texts linked directly. Null and empty texts are copies of one another and have no links; repeated rows stay; an
    empty table gives an empty one; rows whose doc_id is null get the ids of their text's other rows, or null.
    """
    copies, linked = _classes(docs, threshold, target)
    info = copies.join(linked.select("node", "class_id", "n_links"), "node", "left")
    out = with_nodes(docs).select("doc_id", "node").join(info, "node")
    return out.select("doc_id", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """docs with one row of each near-duplicate class: of the text that stands for it, the row with the least doc_id; of equal ones, one."""
    copies, linked = _classes(docs, threshold, target)
    stay = copies.join(linked.where("node <> first").select("node"), "node", "left_anti")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    kept = docs.withColumn("_node", F.unhex(F.md5(text))).join(stay.select(F.col("node").alias("_node"), F.col("copy_of").alias("_least")), "_node")
    return kept.where(F.col("doc_id").eqNullSafe(F.col("_least"))).dropDuplicates(["_node"]).select(*[F.col(f"`{c}`") for c in docs.columns])
