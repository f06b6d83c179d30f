"""Byte-level BPE encoding and decoding, with pre-tokenisation by a scan of transition functions.

Each code point has a class, and each class is a function on the states of a small automaton that knows what a token boundary depends on
(runs of letters, digits, other characters and white space, and how far a contraction after an apostrophe has come). The functions that these
generate under composition form a finite monoid, so a function is a small integer and composition one table look-up; as it is associative, a
blocked prefix scan over numpy arrays gives the state after every character of many texts at once. Boundaries then follow from neighbouring
states alone; no regular expression runs. The slices feed pair merging, whose results are kept by slice.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .shared import bounded_batches, char_table, chunks, codepoints, distinct_slices, only, ragged

# The states and the classes of characters that the published pattern distinguishes.
STATES = "start letter digit other space white quote quote_r quote_v quote_l done".split()
CLASSES = "end letter one r v l e digit quote other space white".split()
WHITE = r"\t\n\x0b\x0c\r\x85\xa0  -     　"
#: Slices whose tokens are kept; a full store starts anew.
KEPT = 100_000
_NONE = 1 << 60


def _step(state: str, cls: str) -> str:
    if cls == "end":
        return "start"
    if cls in ("digit", "other", "space", "white"):
        return cls
    if cls == "quote":
        return "other" if state in ("other", "quote", "space") else "quote"
    if state == "quote" and cls == "one" or state == "quote_l" and cls == "l" or state in ("quote_r", "quote_v") and cls == "e":
        return "done"
    return f"quote_{cls}" if state == "quote" and cls in ("r", "v", "l") else "letter"


@lru_cache(maxsize=None)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, composition table flattened, image of the start state under each element)."""
    number = {s: i for i, s in enumerate(STATES)}
    classes = [tuple(number[_step(s, c)] for s in STATES) for c in CLASSES]
    elements = {tuple(range(len(STATES))): 0}
    queue = list(elements)
    for f in queue:
        for g in classes:
            if (h := tuple(g[x] for x in f)) not in elements:
                elements[h] = len(elements)
                queue.append(h)
    m = len(elements)
    table = np.array([[elements[tuple(g[x] for x in f)] for g in queue] for f in queue], np.int32)
    return np.array([elements[c] for c in classes], np.int32), (table * m).ravel().astype(np.int32), np.array([f[0] for f in queue], np.uint8)


def scan(elements: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive prefix compositions. Blocks advance side by side, then their totals are scanned the same way and joined in front."""
    _, table, image = monoid()
    m, n = len(image), len(elements)
    if n <= block:
        out = elements.copy()
        for j in range(1, n):
            out[j] = table[out[j - 1] * m + elements[j]] // m
        return out
    pad = -n % block
    x = np.ascontiguousarray(np.concatenate([elements, np.zeros(pad, np.int32)]).reshape(-1, block).T)
    for j in range(1, block):
        x[j] = table[x[j - 1] * m + x[j]] // m
    before = np.concatenate([np.zeros(1, np.int32), scan(np.ascontiguousarray(x[-1]), block)[:-1]])
    x = table[before[None, :] * m + x] // m
    return np.ascontiguousarray(x.T).ravel()[:n]


@lru_cache(maxsize=None)
def _class_of() -> np.ndarray:
    """The class of every code point (surrogates: other)."""
    base = char_table(r"\p{L}", r"\p{N}", WHITE + " ")
    number = {c: i for i, c in enumerate(CLASSES)}
    out = np.array([number["other"], number["letter"], number["digit"], number["white"]], np.uint8)[base]
    for chars, cls in (("stmd", "one"), ("r", "r"), ("v", "v"), ("l", "l"), ("e", "e"), ("'", "quote"), (" ", "space")):
        for c in chars:
            out[ord(c)] = number[cls]
    return out


def _is(*names: str) -> np.ndarray:
    return np.isin(np.arange(len(STATES)), [STATES.index(s) for s in names])


@lru_cache(maxsize=None)
def _starts() -> np.ndarray:
    """By the states after the character before and after this one: 1 a token starts here, 0 not, 2 the next state decides."""
    out = np.zeros((len(STATES), len(STATES)), np.uint8)
    words, partial = ("letter", "done", "quote_r", "quote_v", "quote_l"), ("quote_r", "quote_v", "quote_l")
    for b, was in enumerate(STATES):
        for k, now in enumerate(STATES):
            if was == "start":
                new = 1
            elif now in ("space", "white"):
                new = 2 if was in ("space", "white") else 1
            elif was == "space" or now == was == "digit" or now == "other" and was in ("other", "quote"):
                new = 0
            elif now in words and was == "quote":
                new = 0 if now == "done" else 2 if now in partial else 1
            else:
                new = not (now in words and was in ("letter", *partial))
            out[b, k] = new
    return out.ravel()


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(the texts joined, each with one character after it; where tokens start in that; the index of the text of each token)."""
    joined = "\n".join(texts) + "\n"
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    cls = _class_of()[codepoints(joined)]
    cls[at[1:] - 1] = 0
    element, _, image = monoid()
    state = image[scan(element[cls])]
    before = np.concatenate([np.zeros(1, np.uint8), state[:-1]])
    start = _starts()[before * np.uint8(len(STATES)) + state]
    # only here the next state counts: white space before something visible, letters that may complete a contraction
    open_ = np.flatnonzero(start == 2)
    after = state[np.minimum(open_ + 1, len(state) - 1)]
    start[open_] = np.where(_is("space", "white")[state[open_]], ~_is("space", "white", "start")[after], ~_is("done")[after])
    start[cls == 0] = 0
    where = np.flatnonzero(start)
    return joined, where, np.searchsorted(at, where, "right") - 1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a slice: while any adjacent pair has a rank, the pair of least rank (the first of equals) is merged."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= 40:  # few pairs: look through them all each time
        parts = [piece[i : i + 1] for i in range(n)]
        rank = [ranks.get(piece[i : i + 2], _NONE) for i in range(n - 1)]
        while rank and (least := min(rank)) != _NONE:
            i = rank.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i:
                rank[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
            if i < len(rank):
                rank[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
        return [ranks[p] for p in parts]
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or end[j] != stop:
            continue
        gone[j] = 1
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if not gone[i]]


class _Kept(dict):
    """The ids of slices, worked out when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        # the library merges what its pattern matches, here a whole slice; merge() is the same in Python
        self.merge = tiktoken.Encoding("slices", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= KEPT:
            self.clear()
        out = tuple(self.merge(piece))
        if len(piece) <= 64:
            self[piece] = out
        return out


class Coder:
    """Encodes and decodes texts with the ranks of a .tiktoken file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        known = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            known[v] = k
        self.size = np.array([len(x) for x in known], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(known), np.uint8)
        self.decimal = [str(i) for i in range(len(known))]
        self.kept = _Kept(self.ranks)

    def encode(self, texts: list[str | None]):
        """For each text (ids, starts, counts): its ids, and for each slice where it starts in code points and how many of the ids are its."""
        texts = [t or "" for t in texts]
        for lo, hi in chunks(texts):
            joined, where, owner = boundaries(texts[lo:hi])
            size = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo)
            at = np.cumsum(size + 1) - size - 1
            end = np.append(where[1:], 0)
            if len(where):
                last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
                end[last] = (at + size)[owner[last]]
            # equal slices are looked up once a chunk
            _, one, which = distinct_slices(codepoints(joined), where, end)
            ids = [self.kept[joined[a:b]] for a, b in zip(where[one].tolist(), end[one].tolist(), strict=True)]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))
            counts = count[which]
            tokens = ragged(flat, (np.cumsum(count) - count)[which], counts)
            stop = np.append(0, np.cumsum(counts))
            first = np.searchsorted(owner, np.arange(hi - lo + 1))
            for k in range(hi - lo):
                a, b = first[k], first[k + 1]
                yield tokens[stop[a] : stop[b]], where[a:b] - at[k], counts[a:b]

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        return ragged(self.data, self.first[ids], self.size[ids]).tobytes()


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One coder a worker process: its table and kept slices serve all tasks."""
    return Coder(path)


def _text_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    bounded_batches(spark)
    return only(docs, "doc_id", "text")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, starts, counts): the ids of each whole text; starts and counts give for each pre-token where it starts (code points)
    and how many of the ids are its. A null text counts as empty: empty arrays. Rows and their order in a partition stay."""

    def run(batches):
        code = coder(path)
        for batch in batches:
            rows = list(code.encode(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in range(3)]], ["doc_id", "ids", "starts", "counts"])

    return _text_of(docs.sparkSession, docs).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, counts array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, data): the bytes that the ids stand for; null ids: no bytes."""

    def run(batches):
        code = coder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([code.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "data"])

    return only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs, encoded and decoded in one pass: ids_sha256 is over the decimal
    ids joined by one space, decoded_sha256 over the bytes decoded from them. Null and empty texts: 0 ids and the digests of nothing."""

    def run(batches):
        code = coder(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids, _, _ in code.encode(batch.column("text").to_pylist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(code.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(code.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        code.kept.clear()  # the worker may serve other stages next

    return _text_of(docs.sparkSession, docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
