"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns' spans (email, ip, card, phone) are always reported. Besides, each document's tokens with a digit or an at sign are the nodes of a
random field with the labels none and the four kinds: a node's own potential comes from its shape, neighbouring nodes share a chain potential,
and tokens that are equal or similar (the same last seven digits, the same letters and digits) share a skip potential, however far apart they
are. Nodes in pattern spans are held at their kind. Loopy message passing then carries labels along chains and skips, and further tokens whose
marginal is high enough become spans.

The potentials maximise the pseudo-likelihood: the chance of each node's label given its shape and its neighbours' and twins' labels, with the
patterns' spans as labels, over the nodes of all documents. A node enters by its configuration alone, so these are counted by Spark, and the
table of configurations is bounded whatever the input. Two things follow from labels that come from patterns. A free node with a twin in a span
is not a counterexample but unknown: it is neither learned from nor a neighbour. And as a label is nearly a function of the shape, a node counts
a second time with its shape left out, so that chains and skips learn to tell labels without it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, only, ragged

KINDS = ("email", "ip", "card", "phone")
SHAPES, ROUNDS, DAMPING, LEAST = 1 << 13, 12, 0.3, 0.9
LABELS = len(KINDS) + 1
NOBODY = 2 * LABELS
#: Characters between neighbours on the chain; further apart, tokens say nothing of one another but by skips.
NEAR = 40
#: Characters between neighbours that touch; these share another potential than others.
TOUCH = 2
#: Largest change of a message at which passing ends.
CHANGE = 1e-4
#: Potential that holds a node in a pattern's span at its kind.
HELD = 12.0
#: Training: bounds of the potentials of shapes, chains and skips, weight of their squares, steps and first size of a step.
MOST_SHAPE, MOST_CHAIN, MOST_SKIP, SQUARES, STEPS, RATE = 3.0, 3.0, 16.0, 0.5, 400, 0.1
#: Characters (letters and digits) that twins share at least to be firm ones; these share another potential than others.
FIRM = 7
#: Potential of two twins of one label, not firm or firm, before any are seen: squares are of the distance from it.
ALIKE = 3.0, 14.0
#: Twins that a node can have: the one before and the one after, by at most two keys.
TWINS = 4

# Parts of the base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s,;<>\"'|]+")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index of kind, start, end) of the fixed patterns, ordered. Every pattern is followed in time linear in the text."""
    out = []
    if not _ANY.search(text):
        return out
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, pos = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[k : k + 4])) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in parts[k : k + 4]):
                    out.append((1, pos, pos + size))
                pos += size + 1
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _length(n: int) -> str:
    return str(n) if n <= 4 else "6" if n <= 6 else "9" if n <= 9 else "c" if n <= 12 else "j" if n <= 19 else "z"


def shape(token: str) -> str:
    """Digit runs become d and their length's class, letter runs a; other characters stay. After it, whether the digits could be a card's."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    valid = "v" if 13 <= len(digits) <= 19 and luhn(digits) else ""
    return _RUN.sub(lambda m: "d" + _length(len(m[0])) if m[0][0].isdigit() else "a", token) + valid


class Field:
    """A document's nodes: spans of tokens, shapes, the kind of base spans (0 none, else 1 + index), chain and skip edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.start, self.end, self.shape, keys = [], [], [], []
        spans = sorted((a, b, k) for k, a, b in base)
        for m in _TOKEN.finditer(text):
            if not _ANY.search(m[0]):
                continue
            a, b = m.span()
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
                b -= 1
            if a < b:
                self.start.append(a)
                self.end.append(b)
                self.shape.append(zlib.crc32(shape(text[a:b]).encode()) % SHAPES)
                digits = "".join(c for c in text[a:b] if "0" <= c <= "9")
                plain = "".join(c for c in text[a:b].lower() if c.isalnum())
                keys.append({("d", digits[-FIRM:])} if len(digits) >= FIRM else {("t", plain)} if len(plain) >= 3 else set())
                if "@" in text[a:b]:
                    keys[-1].add(("t", plain))
        n = len(self.start)
        self.fixed = np.zeros(n, np.int64)
        j = 0
        for i in range(n):
            while j < len(spans) and spans[j][1] <= self.start[i]:
                j += 1
            k = j
            while k < len(spans) and spans[k][0] < self.end[i]:
                if spans[k][1] > self.start[i]:
                    self.fixed[i] = 1 + spans[k][2]
                k += 1
        self.chain = [(i, i + 1) for i in range(n - 1) if self.start[i + 1] - self.end[i] <= NEAR]
        self.touch = [int(self.start[j] - self.end[i] <= TOUCH) for i, j in self.chain]
        # a token's keys are all firm or all not: one with two keys has an at sign and FIRM digits
        last, self.skip, self.firm = {}, [], [int(any(len(text) >= FIRM for _, text in mine)) for mine in keys]
        for i, mine in enumerate(keys):
            for key in mine:
                if key in last:
                    self.skip.append((last[key], i))
                last[key] = i


def counts(text: str) -> Counter:
    """(configuration, label) -> times, of the nodes that training learns from. A configuration is a number made of the shape, whether twins are firm, the labels of the
    neighbours before and after (those that touch, or don't; NOBODY: none there, or unknown), and how many twins have each label."""
    out: Counter = Counter()
    if not _ANY.search(text):
        return out
    f = Field(text, base_spans(text))
    known = np.ones(len(f.shape), bool)
    for i, j in f.skip:
        if (f.fixed[i] > 0) != (f.fixed[j] > 0):
            known[i if f.fixed[j] else j] = False
    sides = np.full((len(f.shape), 2), NOBODY)
    for (i, j), touch in zip(f.chain, f.touch, strict=True):
        if known[j]:
            sides[i, 1] = touch * LABELS + f.fixed[j]
        if known[i]:
            sides[j, 0] = touch * LABELS + f.fixed[i]
    twins = np.zeros(len(f.shape), np.int64)
    for i, j in f.skip:
        twins[i] += known[j] * (TWINS + 1) ** f.fixed[j]
        twins[j] += known[i] * (TWINS + 1) ** f.fixed[i]
    code = (((np.array(f.shape, np.int64) * 2 + f.firm) * (NOBODY + 1) + sides[:, 0]) * (NOBODY + 1) + sides[:, 1]) * (TWINS + 1) ** LABELS + twins
    out.update(zip(code[known].tolist(), f.fixed[known].tolist(), strict=True))
    return out


@dataclass
class Potentials:
    shape: np.ndarray  # (SHAPES, LABELS), the labels' own potentials added
    chain: np.ndarray  # (2, LABELS, LABELS): neighbours that don't touch, that do
    skip: np.ndarray  # (2, LABELS, LABELS): twins that aren't firm, that are


def potentials(rows) -> Potentials:
    """Of greatest pseudo-likelihood within the bounds, from (configuration, label, times) in any order. Labels that never occur can't be added."""
    rows = np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, 3)
    codes, at = np.unique(rows[:, 0], return_inverse=True)
    seen = np.zeros((len(codes), LABELS))
    np.add.at(seen, (at, rows[:, 1]), rows[:, 2])
    rest, twins = np.divmod(codes, (TWINS + 1) ** LABELS)
    rest, after = np.divmod(rest, NOBODY + 1)
    shapes, before = np.divmod(rest, NOBODY + 1)
    shapes, firm = np.divmod(shapes, 2)
    used, shapes = np.unique(shapes, return_inverse=True)
    # by label: neighbours that have it, twins that have it, each in two columns for the two kinds of them
    one = np.eye(NOBODY + 1)[:, :NOBODY]
    sides = one[before] + one[after]
    twins = np.stack([twins // (TWINS + 1) ** k % (TWINS + 1) for k in range(LABELS)], axis=1).astype(float)
    twins = np.hstack([twins * (firm == k)[:, None] for k in (0, 1)])
    total = seen.sum(axis=1, keepdims=True)
    w = [np.zeros((1, LABELS)), np.zeros((len(used), LABELS)), np.zeros((NOBODY, LABELS)), np.vstack([np.eye(LABELS) * x for x in ALIKE])]
    middle = [x.copy() for x in w]
    most = [HELD, MOST_SHAPE, MOST_CHAIN, MOST_SKIP]
    mean, square = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, STEPS + 1 if len(codes) else 1):
        context = w[0] + sides @ w[2] + twins @ w[3]
        left = np.zeros_like(seen)  # labels seen less those expected, with and without the shape
        by_shape = None
        for own in (w[1][shapes], 0.0):
            z = context + own
            p = np.exp(z - z.max(axis=1, keepdims=True))
            more = seen - total * p / p.sum(axis=1, keepdims=True)
            left += more
            by_shape = more if by_shape is None else by_shape
        pair = [(x.T @ left).reshape(2, LABELS, LABELS) for x in (sides, twins)]
        grads = [left.sum(axis=0, keepdims=True), np.zeros_like(w[1]), *[(x + x.transpose(0, 2, 1)).reshape(-1, LABELS) for x in pair]]
        for k in range(LABELS):
            grads[1][:, k] = np.bincount(shapes, by_shape[:, k], len(used))
        for i, g in enumerate(grads):
            g = g - SQUARES * (w[i] - middle[i])
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            size = RATE * (1 - step / (STEPS + 1)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-9)
            w[i] = np.clip(w[i] + size * mean[i] / (1 - 0.9**step), -most[i], most[i])
    own = np.tile(w[0], (SHAPES, 1))
    own[used] += w[1]
    own[:, seen.sum(axis=0) == 0] = -HELD
    return Potentials(own, *[x.reshape(2, LABELS, LABELS) for x in w[2:]])


def marginals(own: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Loopy sum-product: own (nodes, labels) log potentials, edges (m, 2), pair (m, labels, labels). Exact on forests, given enough rounds: if
    none are given, until messages stay, at most ROUNDS and twice the nodes (no path is longer than the nodes, and damping delays). A round then
    sends those messages alone whose sender's belief, or that themselves, changed in the round before, so its work is that of what moves."""
    belief = own.astype(float)
    if len(edges):
        n, k = own.shape
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        m = len(edges)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        msg = np.zeros((2 * m, k))
        leaving = np.argsort(source, kind="stable")
        first = np.searchsorted(source[leaving], np.arange(n + 1))
        send = np.arange(2 * m)
        for _ in range(rounds or ROUNDS + 2 * n):
            forth = (send < m)[:, None, None]
            table = np.where(forth, pair[send % m], pair[send % m].transpose(0, 2, 1))
            x = (belief[source[send]] - msg[back[send]])[:, :, None] + table
            top = x.max(axis=1, keepdims=True)
            new = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            new = DAMPING * msg[send] + (1 - DAMPING) * new
            change = new - msg[send]
            msg[send] = new
            np.add.at(belief, target[send], change)
            if rounds is None:
                moved = send[np.abs(change).max(axis=1) >= CHANGE]
                if not len(moved):
                    break
                nodes = np.unique(target[moved])
                send = np.unique(np.append(moved, leaving[ragged(np.arange(2 * m), first[nodes], first[nodes + 1] - first[nodes])]))
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], p: Potentials, least: float = LEAST) -> list[tuple[int, int, int]]:
    """Spans of nodes outside all base spans whose marginal of a kind is high enough; neighbours of one kind, one space apart, are one span."""
    f = Field(text, base)
    free = f.fixed == 0
    if not free.any():
        return []
    own = p.shape[f.shape].copy()
    own[~free] = -HELD
    own[~free, f.fixed[~free]] = HELD
    edges = np.array([*f.chain, *f.skip], np.int64).reshape(-1, 2)
    pair = np.concatenate([p.chain[np.array(f.touch, np.int64)], p.skip[np.array([f.firm[i] for i, _ in f.skip], np.int64)]])
    prob = marginals(own, edges, pair)
    out: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(free & (prob[:, 1:].max(axis=1) >= least)):
        kind, a, b = int(prob[i, 1:].argmax()), f.start[i], f.end[i]
        if out and out[-1][0] == kind and text[out[-1][2] : a] == " ":
            out[-1] = (kind, out[-1][1], b)
        else:
            out.append((kind, a, b))
    return out


def fit(docs: DataFrame) -> Potentials:
    """Potentials from counts over all documents. What reaches the driver is one row a configuration and label that occur: of SHAPES x 2 x 11 x 11 x 126
    configurations at most, whatever the input."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            total: Counter = Counter()
            for t in batch.column("text").to_pylist():
                total.update(counts(t or ""))
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], ["c", "y", "n"])

    return potentials(only(docs, "text").mapInArrow(run, "c long, y int, n long").groupBy("c", "y").agg(F.sum("n")).collect())


def listing(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _held(spark: SparkSession, docs: DataFrame, model: Potentials | None):
    return spark.sparkContext.broadcast(model or fit(docs))


def report(docs: DataFrame, model: Potentials | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of docs; positions are code points, the end exclusive.

    Null and empty texts have no spans (the digest of nothing); repeated rows repeat; an empty table gives an empty one. The model is trained
    on docs unless one is given.
    """
    bounded_batches(docs.sparkSession)
    held = _held(docs.sparkSession, docs, model)

    def run(batches):
        for batch in batches:
            n, sha, every = [], [], []
            for t in batch.column("text").to_pylist():
                base = base_spans(t or "")
                more = added_spans(t, base, held.value) if t and _ANY.search(t) else []
                n.append([sum(k == i for k, _, _ in base) for i in range(4)])
                sha.append(hashlib.sha256(listing(base).encode()).hexdigest())
                every.append(listing(base + more))
            columns = [pa.array([x[i] for x in n], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(sha, pa.string()), pa.array(every, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, or run of overlapping spans, replaced by the name of its (first) kind in angle brackets."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Potentials | None = None) -> DataFrame:
    """docs with all spans in text masked and n_chars, where there is such a column, set to the new length; null texts stay null."""
    bounded_batches(docs.sparkSession)
    held = _held(docs.sparkSession, docs, model)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if not isinstance(t, str) or not _ANY.search(t):
                return t
            base = base_spans(t)
            return masked(t, base + added_spans(t, base, held.value))

        return texts.map(one)

    out = docs.withColumn("text", run(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
