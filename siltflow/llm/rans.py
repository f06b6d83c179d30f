"""Token ids in a binary format: a static range asymmetric numeral system over shared frequency tables.

A table of documents becomes files (parts), each an ascending range of doc_id, cut into blocks of whole documents. All blocks share one table of
symbol frequencies, counted over all ids and scaled to 2^PRECISION. A block is coded by itself: LANES interleaved coders advance side by side in
numpy, and every CHECKPOINT steps the lanes' states and the read position are kept, so that decoders can start there; each stretch between
checkpoints has a checksum, as have the block's ids as a whole. Blocks are rows of Parquet files, whose writer commits them safely.
"""

from __future__ import annotations

import math
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import WHITE
from .shared import Buffer, bounded_batches, char_table, chunks, codepoints, only, ragged, same_runs, span_hashes, work_dir, written

PRECISION, LOW = 20, 1 << 31
LANES, CHECKPOINT = 1024, 64
#: Stretches between checkpoints that are decoded side by side; ids after which a block ends with its document.
SIDE_BY_SIDE, BLOCK_IDS = 8, 1 << 18
#: Ids of a part on average: the first up to MANY_PARTS parts, the second beyond, where more parts would burden the driver.
PART_IDS, MANY_PARTS = (8_000_000, 128_000_000), 4096
END = 2
#: Slices kept in a worker, some 100 bytes each; a full store starts anew.
KEPT = 800_000
# Signs that the tokenizer never joins with a letter before or after them; the first character beyond the letters that are told
# apart from signs, and one before it that becomes more than a letter.
SIGNS, LATIN, DOTTED = ".,;:!?()*&%#-", "\u0250", "\u0130"

U64, U32 = np.uint64, np.uint32


class Table:
    """Frequencies scaled to 2^PRECISION, at least 1 for every symbol that occurs."""

    def __init__(self, symbols: np.ndarray, times: np.ndarray):
        total, size = times.sum(), 1 << PRECISION
        assert len(symbols) <= size
        freq = np.maximum(1, (times.astype(float) / max(1, total) * size).astype(np.int64))
        # what rounding leaves over or takes too much goes to the largest, step by step
        rest = size - int(freq.sum()) if len(freq) else 0
        by = np.argsort(-freq, kind="stable")
        while rest:
            if rest > 0:
                freq[by[0]] += rest
                rest = 0
            else:
                most = by[0] if freq[by[0]] + rest >= 1 else int(np.argmax(freq))
                cut = min(-rest, int(freq[most]) - 1)
                freq[most] -= cut
                rest += cut
        self.symbols = symbols.astype(np.int64)
        self.freq, self.start = freq.astype(U64), (np.cumsum(freq) - freq).astype(U64)
        n = int(symbols.max()) + 1 if len(symbols) else 0
        self.place = np.full(n, -1, np.int64)
        self.place[self.symbols] = np.arange(len(symbols))

    @property
    def slots(self) -> np.ndarray:
        """The place of the symbol of each slot."""
        if not hasattr(self, "_slots"):
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots


def encode(ids: np.ndarray, table: Table) -> dict:
    """A block: payload (32-bit words), heads (read position and lane states at each checkpoint), sums (checksum from each checkpoint to the next)."""
    n = len(ids)
    steps = -(-n // LANES)
    place = table.place[ids]
    freq, start = table.freq[place], table.start[place]
    x = np.full(LANES, LOW, U64)
    words: list[np.ndarray] = []
    emitted, marks = 0, []
    for s in range(steps - 1, -1, -1):
        f, c = freq[s * LANES : (s + 1) * LANES], start[s * LANES : (s + 1) * LANES]
        y = x[: len(f)]
        full = y >= (f << U64(63 - PRECISION))
        if full.any():
            words.append((y[full] & U64(0xFFFFFFFF)).astype(U32)[::-1])
            emitted += len(words[-1])
            y = np.where(full, y >> U64(32), y)
        x[: len(f)] = ((y // f) << U64(PRECISION)) + y % f + c
        if s % CHECKPOINT == 0:
            marks.append((emitted, x.copy()))
    payload = np.concatenate([np.array([], U32), *words])[::-1]
    heads = b"".join(np.append(U64(emitted - at), state).tobytes() for at, state in reversed(marks))
    raw = ids.astype("<u4")
    sums = [zlib.crc32(raw[i : i + CHECKPOINT * LANES].tobytes()) for i in range(0, n, CHECKPOINT * LANES)]
    return {"payload": payload.astype("<u4").tobytes(), "heads": heads, "sums": np.array(sums, "<u4").tobytes()}


def _stretches(payload: np.ndarray, heads: np.ndarray, size: int, table: Table) -> np.ndarray:
    """The ids, a row each, of stretches that all have so many: each starts at its checkpoint, and they advance side by side."""
    at, x = heads[:, 0].astype(np.int64), heads[:, 1:].copy()
    ids = np.empty((len(heads), size), np.int64)
    for s in range(0, size, LANES):
        y = x[:, : min(LANES, size - s)]
        slot = y & U64((1 << PRECISION) - 1)
        place = table.slots[slot.astype(np.int64)]
        ids[:, s : s + LANES] = table.symbols[place]
        y = table.freq[place] * (y >> U64(PRECISION)) + slot - table.start[place]
        row, lane = np.nonzero(y < U64(LOW))
        if len(row):
            n = np.bincount(row, minlength=len(at))
            first = np.cumsum(n) - n
            y[row, lane] = (y[row, lane] << U64(32)) | payload[np.arange(len(row)) + (at - first)[row]]
            at += n
        x[:, : y.shape[1]] = y
    return ids


def decode(block: dict, n: int, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block of n, or of the stretches first to last (exclusive) between its checkpoints; each stretch's checksum is verified."""
    payload = np.frombuffer(block["payload"], "<u4").astype(U64)
    heads = np.frombuffer(block["heads"], U64).reshape(-1, LANES + 1)
    sums, size = np.frombuffer(block["sums"], "<u4"), CHECKPOINT * LANES
    last = len(heads) if last is None else min(last, len(heads))
    out = []
    for k in range(first, last, SIDE_BY_SIDE):
        stop = min(last, k + SIDE_BY_SIDE)
        full = min(stop, n // size)  # but for the block's last one all stretches are full
        if full > k:
            out += list(_stretches(payload, heads[k:full], size, table))
        if stop > full:
            out += list(_stretches(payload, heads[full:stop], n - full * size, table))
    for k, ids in enumerate(out, first):
        if zlib.crc32(ids.astype("<u4").tobytes()) != sums[k]:
            raise ValueError(f"stretch {k} of a block does not match its checksum")
    return np.concatenate([np.array([], np.int64), *out])


class _Places:
    """Where words are kept: an open hash table, looked up for many hashes at once."""

    def __init__(self, most: int):
        self.mask = (1 << (2 * most).bit_length()) - 1
        self.slot, self.h = np.full(self.mask + 1, -1, np.int32), Buffer(U64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it has none."""
        out, at = np.full(len(h), -1, np.int32), (h & U64(self.mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            found = self.slot[at[todo]]
            todo, found = todo[found >= 0], found[found >= 0]
            same = self.h.all()[found] == h[todo]
            out[todo[same]] = found[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & self.mask
        return out

    def add(self, h: np.ndarray) -> None:
        """Gives distinct new hashes the next places."""
        place = np.arange(self.h.n, self.h.n + len(h), dtype=np.int32)
        self.h.add(h)
        at = (h & U64(self.mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.slot[at[todo]] < 0]
            self.slot[at[free]] = place[free]
            todo = todo[self.slot[at[todo]] != place[todo]]
            at[todo] = (at[todo] + 1) & self.mask


class Words:
    """Encodes texts with a tokenizer of the library that lower-cases, drops white space, and joins neither letters with SIGNS nor anything
    over white space. So texts are cut at white space and between Latin letters and SIGNS, capitals are folded, and the library encodes each
    slice once; its ids are kept by the slice's hash, beside its characters, which are compared at each hit. Some 100 bytes a slice."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Forgets the slices kept."""
        self.places = _Places(KEPT)
        #: by place: first id and how many; first character and how many
        self.first, self.size, self.begin, self.length = (Buffer(np.int32) for _ in range(4))
        self.flat, self.chars = Buffer(np.int32), Buffer(U32)

    def _encode(self, slices: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the slices' ids one after another, how many each has). Slices of letters or of SIGNS alone end with the one id that ends a word,
        so the library gets many at a time."""
        size = np.zeros(len(slices), np.int64)
        letters = [x.isalpha() and max(x) < LATIN and DOTTED not in x for x in slices]
        plain = [i for i, x in enumerate(slices) if letters[i] or not x.strip(SIGNS)]
        flat, done = [], []
        for e in range(0, len(plain), 5_000):
            part = plain[e : e + 5_000]
            (enc,) = self.tokenizer.encode_batch_fast([" ".join([slices[i] for i in part])], add_special_tokens=False)
            ids = np.array(enc.ids, np.int32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part):  # else some slice is more than one word to this tokenizer
                flat.append(ids)
                size[part] = np.diff(last, prepend=-1)
                done += part
        if len(done) < len(slices):
            odd = sorted(set(range(len(slices))).difference(done))
            more = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast([slices[i] for i in odd], add_special_tokens=False)]
            size[odd] = list(map(len, more))
            flat += more
            at = np.zeros(len(slices), np.int64)
            order = [*done, *odd]
            at[order] = np.cumsum(size[order]) - size[order]
            return ragged(np.concatenate(flat), at, size), size
        return np.concatenate([np.zeros(0, np.int32), *flat]), size

    def _learn(self, h: np.ndarray, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        text = cp.tobytes().decode("utf-32-le", "surrogatepass")
        flat, size = self._encode([text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        self.places.add(h)
        length = (end - start).astype(np.int32)
        self.first.add(self.flat.n + np.cumsum(size) - size)
        self.size.add(size)
        self.flat.add(flat)
        self.begin.add(self.chars.n + np.cumsum(length) - length)
        self.length.add(length)
        self.chars.add(ragged(cp, start, length))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        texts = [t or "" for t in texts]
        for lo, hi in chunks(texts, 1_000_000):
            if self.places.h.n > KEPT:
                self.clear()
            cp, start, end = _slices("\n".join(texts[lo:hi]) + "\n")
            h = span_hashes(cp, start, end)
            place = self.places.find(h)
            new = np.flatnonzero(place < 0)
            if len(new):  # one of the slices with a hash is kept
                one, back = np.unique(h[new], return_index=True, return_inverse=True)[1:]
                known = self.places.h.n
                self._learn(h[new[one]], cp, start[new[one]], end[new[one]])
                place[new] = known + back
            # a slice that only shares a kept one's hash is encoded here
            same = self.length.all()[place] == end - start
            like = np.flatnonzero(same)
            same[like] = same_runs(self.chars.all(), self.begin.all()[place[like]], cp, start[like], (end - start)[like])
            first, n, flat = self.first.all()[place], self.size.all()[place], self.flat.all()
            if not same.all():
                odd = np.flatnonzero(~same)
                more, n[odd] = self._encode([cp[x:y].tobytes().decode("utf-32-le", "surrogatepass") for x, y in zip(start[odd].tolist(), end[odd].tolist(), strict=True)])
                first[odd] = len(flat) + np.cumsum(n[odd]) - n[odd]
                flat = np.append(flat, more)
            ids, stop = ragged(flat, first, n), np.append(0, np.cumsum(n))
            length = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo)
            word = np.searchsorted(start, np.append(0, np.cumsum(length + 1)))
            out += [ids[stop[x] : stop[y]] for x, y in zip(word[:-1].tolist(), word[1:].tolist(), strict=True)]
        return out


@lru_cache(maxsize=None)
def _kinds() -> np.ndarray:
    """By code point: 1 white space, 2 Latin letters, 3 SIGNS, else 0."""
    out = char_table(WHITE + " ").copy()
    out[: ord(LATIN)][char_table(r"\p{L}")[: ord(LATIN)] == 1] = 2
    out[ord(DOTTED)] = 0
    out[[ord(c) for c in SIGNS]] = 3
    return out


def _slices(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, with capitals folded; first and last, exclusive, of each slice). Nothing is folded or cut inside of words where the text
    may name a special token, and no capital before what may be a combining mark."""
    cp = codepoints(text).copy()
    kind = _kinds()[cp]
    if "<|" in text:
        edge = np.flatnonzero(np.diff((kind != 1).astype(np.int8), prepend=np.int8(0)))
        return cp, edge[0::2], edge[1::2]
    capital = ((cp >= 0x41) & (cp <= 0x5A) | (cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7)) & (np.append(cp[1:], 0) < 0x300)
    cp[capital] += U32(32)
    before, here = kind[:-1], kind[1:]
    cut = np.flatnonzero(((before == 1) != (here == 1)) | (before == 2) & (here == 3) | (before == 3) & (here == 2)) + 1
    bound = np.concatenate([[0], cut, [len(cp)]]) if len(cp) else np.zeros(1, np.int64)
    inside = kind[bound[:-1]] != 1
    return cp, bound[:-1][inside], bound[1:][inside]


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def width(path: str) -> str:
    """The narrowest little-endian type for the ids of a tokenizer, used between the stages."""
    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, kind: str = "<u4", end: int = END) -> DataFrame:
    """(doc_id, ids, n, counts): the ids of each whole text, and the end id, as little-endian unsigned integers, and how many; counts is null.
    A null text counts as empty. Each task adds a row of its own at its end, without doc_id and ids: n is null, and counts has how often each
    id occurred, as 64-bit integers."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        words, total = _words(path), np.zeros(0, np.int64)
        names = ["doc_id", "ids", "n", "counts"]
        for batch in batches:
            ids = [np.append(x, end) for x in words.encode(batch.column("text").to_pylist())]
            seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *ids]), minlength=len(total))
            seen[: len(total)] += total
            total = seen
            n = pa.array(map(len, ids), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary()), n, pa.nulls(len(ids), pa.binary())], names)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([total.tobytes()], pa.binary())], names)

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n long, counts binary")


def frequencies(tokens: DataFrame) -> Table:
    """The shared table, from the counts of all tasks. What reaches the driver is as large as the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("counts"):
                seen = np.frombuffer(raw.as_buffer(), np.int64).copy()
                if len(seen) < len(total):
                    total, seen = seen, total
                seen[: len(total)] += total
                total = seen
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["symbol", "n"])

    counts = tokens.where("counts is not null").select("counts")
    rows = counts.mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).orderBy("symbol").collect()
    return Table(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))


_BLOCK = "part int, block long, at long, n long, nulls long, docs binary, sizes binary, crc long, payload binary, heads binary, sums binary"


def write(docs: DataFrame, path: str, tokenizer: str) -> Table:
    """Writes the ids of docs under path in the binary format, in ascending order of doc_id (null ids first, repeated ids by a hash of their
    tokens), and returns the frequency table that readers need. Empty tables give no blocks.

    Parts are ranges of (doc_id, hash, row number), so they are even whatever ids repeat, and a part is written as a stream of blocks."""
    spark = docs.sparkSession
    kind = width(tokenizer)
    found = tokenised(docs, tokenizer, kind).withColumn("tie", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id())
    tokens = written(found, "tokens")
    table = frequencies(tokens)
    held = spark.sparkContext.broadcast(table)
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, min(MANY_PARTS, math.ceil(total / PART_IDS[0])), math.ceil(total / PART_IDS[1]))

    def pack(part, at, block, ids, docs_of):
        flat = np.concatenate(ids)
        b = encode(flat, held.value)
        nulls = sum(d is None for d in docs_of)
        known = np.array([0 if d is None else d for d in docs_of], np.int64)
        sizes = np.array([len(x) for x in ids], np.int64)
        return [part, block, at, len(flat), nulls, known.tobytes(), sizes.tobytes(), zlib.crc32(flat.astype("<u4").tobytes()), b["payload"], b["heads"], b["sums"]]

    def run(batches):
        part, at, block, ids, docs_of, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in _BLOCK.split(", ")]

        def out():
            row = pack(part, at, block, ids, docs_of)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for d, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if size >= BLOCK_IDS:
                    yield out()
                    at, block, ids, docs_of, size = at + size, block + 1, [], [], 0
                x = np.frombuffer(raw.as_buffer(), kind).astype(np.int64)
                ids.append(x)
                docs_of.append(d)
                size += len(x)
        if ids:
            yield out()

    order = ("doc_id", "tie", "row")
    dealt = tokens.where("n is not null").select(*order, "ids").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "ids").mapInArrow(run, _BLOCK).write.parquet(path)
    return table


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int], int]:
    """(the blocks, the ids before each part, all ids). A row for each part reaches the driver."""
    blocks = spark.read.schema(_BLOCK).parquet(path)
    totals = {r[0]: r[1] for r in blocks.groupBy("part").agg(F.sum("n")).collect()}
    before, sums = 0, {}
    for part in sorted(totals):
        sums[part] = before
        before += totals[part]
    return blocks, sums, before


def read(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): the documents of written files; start counts the ids of all documents before. Each block
    is decoded by itself, its stretches side by side from their checkpoints, and verified against its checksums."""
    blocks, sums, _ = _blocks(spark, path)
    held, base = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(sums)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids = decode(r, r["n"], held.value).astype("<u4")
                if zlib.crc32(ids.tobytes()) != r["crc"]:
                    raise ValueError(f"block {r['block']} of part {r['part']} does not match its checksum")
                docs, sizes = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["sizes"], np.int64)
                stop = np.cumsum(sizes)
                each = [ids[b - n : b].tobytes() for b, n in zip(stop.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64(), mask=np.arange(len(docs)) < r["nulls"]),
                        pa.array(base.value[r["part"]] + r["at"] + stop - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(x) for x in each], pa.int64()),
                        pa.array(each, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    bounded_batches(spark)
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_range(spark: SparkSession, path: str, table: Table, first: int, last: int) -> DataFrame:
    """(start, ids): the ids of the positions first to last (exclusive) of all ids, wherever documents end, in pieces at their position. Only
    the stretches that the range meets are decoded, each a row of its own and so a task's work by itself, from its checkpoint."""
    blocks, sums, _ = _blocks(spark, path)
    held, base, size = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(sums), CHECKPOINT * LANES

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                at = base.value[r["part"]] + r["at"]
                lo, hi = max(first, at), min(last, at + r["n"])
                for k in range((lo - at) // size, -(-(hi - at) // size)) if hi > lo else ():
                    ids, begin = decode(r, r["n"], held.value, k, k + 1), at + k * size
                    ids = ids[max(0, lo - begin) : hi - begin]
                    yield pa.RecordBatch.from_arrays([pa.array([max(lo, begin)], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], ["start", "ids"])

    bounded_batches(spark)
    return blocks.mapInArrow(run, "start long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of docs, read back from the files that write() makes."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}.rans"
    table = write(docs, path, tokenizer)
    return read(spark, path, table).select("doc_id", "start", "n_tokens", "ids_crc32")
