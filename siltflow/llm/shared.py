"""What the operators of this subpackage share: tables, written intermediates, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. With 64 MB a batch (Spark's own bound) this keeps a worker's memory level for long texts.
BATCH_ROWS = 1_000
#: Characters that a vectorised step holds at once; one longer text is a chunk of its own.
CHUNK_CHARS = 500_000
#: Characters that are hashed at once.
PIECE_CHARS = 1 << 18
#: Words in a shingle.
SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size for the Python stages of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates: spark.checkpoint.dir. Where it is unset, a temporary folder on one machine (tests); a
    cluster's executors couldn't read that, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return found or _temporary()


@lru_cache(maxsize=None)
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="siltflow-")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(docs: DataFrame, *cols: str) -> DataFrame:
    """The named columns and no others, so that further columns of any name do no harm."""
    return docs.select(*[F.col(f"`{c}`") for c in cols])


# ---------------------------------------------------------------- characters

CODEPOINTS = 0x110000


@lru_cache(maxsize=None)
def char_table(*classes: str) -> np.ndarray:
    """uint8 by code point: 0, or 1 + the index of the first of the regex classes that holds it."""
    codes = np.arange(CODEPOINTS, dtype="<u4")
    every = codes[(codes < 0xD800) | (codes >= 0xE000)].tobytes().decode("utf-32-le")
    out = np.zeros(CODEPOINTS, np.uint8)
    for k, c in reversed(list(enumerate(classes, 1))):
        for m in regex.finditer(f"[{c}]+", every):
            lo, hi = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
            out[lo:hi] = k
    out[0xD800:0xE000] = 0
    return out


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ragged(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[first : first + size], one after another."""
    before = np.cumsum(size) - size
    n = int(size.sum())
    kind = np.int32 if max(n, len(values)) < 1 << 31 else np.int64
    at = np.repeat((first - before).astype(kind), size)
    at += np.arange(n, dtype=kind)
    return values.take(at)


class Buffer:
    """A growing array, whose space doubles when it is full."""

    def __init__(self, kind=np.int64):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, values) -> None:
        need = self.n + len(values)
        if need > len(self.held):
            more = np.zeros(max(need, 2 * len(self.held)), self.held.dtype)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : need] = values
        self.n = need

    def all(self) -> np.ndarray:
        return self.held[: self.n]


# ---------------------------------------------------------------- hashing

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=None)
def _char_values() -> np.ndarray:
    return mix(np.arange(CODEPOINTS, dtype=U64) + U64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=4)
def _place_values(n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=U64) * U64(0xD6E8FEB86659FD93) + U64(1))


def span_hashes(text: str | np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice text[start:end] (a string, or its code points), all at once: the sum of a scrambled value of each character
    in its place. Places and characters are scrambled together, so no pattern of exchanged characters cancels out, as it does in polynomials
    modulo a power of two."""
    cp = codepoints(text) if isinstance(text, str) else text
    size = np.asarray(end) - start
    out = np.zeros(len(size), U64)
    full = np.flatnonzero(size)
    most = _place_values(1 << max(10, int(size.max(initial=1) - 1).bit_length()))
    piece = np.cumsum(size[full]) // PIECE_CHARS
    for rows in np.split(full, np.flatnonzero(np.diff(piece)) + 1) if len(full) else ():
        n = size[rows]
        first = np.cumsum(n) - n
        kind = np.int32 if len(cp) < 1 << 31 else np.int64
        place = np.arange(int(n.sum()), dtype=kind)
        place -= np.repeat(first.astype(kind), n)
        at = np.repeat(start[rows].astype(kind), n)
        at += place
        x = _char_values().take(cp.take(at))
        x += most.take(place)
        x ^= x >> U64(32)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(29)
        out[rows] = np.add.reduceat(x, first)
    return mix(out + size.astype(U64))


def same_runs(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each k whether a[a_first[k] :][: size[k]] equals b[b_first[k] :][: size[k]]."""
    out = np.ones(len(size), bool)
    odd = np.flatnonzero(ragged(a, a_first, size) != ragged(b, b_first, size))
    if len(odd):
        out[np.searchsorted(np.cumsum(size), odd, "right")] = False
    return out


def distinct_slices(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct slice, an index of it among the slices, for each slice the place of its like in these): grouped by hash, then
    compared character by character; a slice that only shares its hash with another is grouped by its text."""
    h, one, which = np.unique(span_hashes(cp, start, end), return_index=True, return_inverse=True)
    size = end - start
    like = one[which]
    same = size == size[like]
    whole = np.flatnonzero(same)
    same[whole] = same_runs(cp, start[whole], cp, start[like[whole]], size[whole])
    if not same.all():
        own: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(~same).tolist():
            key = cp[start[i] : end[i]].tobytes()
            if key not in own:
                own[key] = len(one) + len(more)
                more.append(i)
            which[i] = own[key]
        h, one = np.append(h, span_hashes(cp, start[more], end[more])), np.append(one, more)
    return h, one, which


class Words:
    """The words (runs of letters and digits, lower case) of some texts: h (hash), doc (index of the text), start and end (in joined)."""

    __slots__ = ("h", "doc", "start", "end", "joined")

    def __init__(self, texts: list[str | None]):
        lower = [(t or "").lower() for t in texts]
        self.joined = "\n".join(lower) + "\n"
        cp = codepoints(self.joined)
        inside = char_table(r"\p{L}\p{N}\p{M}")[cp]
        edge = np.flatnonzero(np.diff(inside, prepend=np.uint8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        at = np.zeros(len(lower) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in lower], out=at[1:])
        self.doc = np.searchsorted(at, self.start, "right") - 1
        self.h = span_hashes(self.joined, self.start, self.end)

    def word(self, i: int) -> str:
        return self.joined[self.start[i] : self.end[i]]


_PLACES = [U64(int(x) | 1) for x in mix(np.arange(1, SHINGLE + 1, dtype=U64))]


def sequence_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all sequences of so many words (SHINGLE at most) of one text, in order, repeats kept."""
    n = len(h) - size + 1
    if n <= 0 or not size:
        return np.zeros(0, U64)
    out = h[:n] * _PLACES[0]
    for k in range(1, size):
        out = out + h[k : n + k] * _PLACES[k]
    return mix(out + U64(size % SHINGLE))


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """The hashes of one text's shingles, in order, repeats kept. A text of fewer words has one shingle, all its words; one without words has none."""
    return sequence_hashes(h, min(len(h), SHINGLE))


def shingle_words(words: list[str]) -> set[tuple[str, ...]]:
    """The same shingles as words."""
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(SHINGLE)], strict=False))


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts together have at most so many characters, or are one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def by_text(texts: list[str | None]) -> Iterator[tuple[int, Words, int, int]]:
    """For each text its index, the Words of its chunk, and the range of its words in them."""
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi])
        at = np.searchsorted(w.doc, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield lo + i, w, at[i], at[i + 1]
