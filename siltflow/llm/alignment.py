"""Cross-tokenizer alignment: a dangling-suffix transducer over two tokenizers' tokens.

A state is which side leads and the bytes that it leads by, the residual. The other side's next token takes from the residual, or runs past it and
leads in turn; a transition depends on the residual, the side and the token alone, so it is looked up after the first time. When the residual gets
empty, both sides end at one byte, and the group of tokens since the last such place is closed.

Where neither tokenizer joins what stands before a space with what stands after it, both end a token before the space, and the residual is empty
there: texts are cut at these places into segments, each a path from the empty residual to itself. What a segment gives (ids, groups, links) is
kept in a worker, up to a bound, so that words that occur again are encoded and run through the transducer once.

Pairs of ids are counted by documents in two steps: a task takes some thousand documents as a block and gives its distinct pairs once, with the
number of its documents that have each; sums of these are the corpus-wide counts, which go back to the blocks, not to the documents. A pair that
all documents have is a row for each block.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import Buffer, bounded_batches, chunks, only, ragged, written

#: Documents of a block, and pairs of its documents beyond which it ends.
BLOCK_DOCS, BLOCK_PAIRS = 8192, 4_000_000
#: Segments, pairs and characters of groups that a worker keeps; a store with more starts anew before the next texts. Transitions kept.
KEPT, KEPT_PAIRS, KEPT_CHARS, KEPT_STEPS = 500_000, 6_000_000, 64_000_000, 1_000_000
#: Segments that are encoded at once, and those that go to the library as one text; pairs of a group beyond which numpy makes them.
ENCODE, TOGETHER, FEW = 4096, 512, 1024
# a place before a single space between characters that aren't white space
_CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"


def _byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Runs two token sequences side by side. a, b: the bytes of each side's tokens by id."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.bytes = a, b
        #: a state is (leading side, residual), and the number 0 the empty residual; turn is the side whose token comes next, the first at 0;
        #: steps are the transitions of each state by token
        self.states: list[tuple[int, bytes]] = [(1, b"")]
        self.number: dict[tuple[int, bytes], int] = {(1, b""): 0}
        self.turn, self.steps, self.known = [0], [{}], 0

    def step(self, state: int, token: int) -> int:
        """The state after the next token of the side whose turn it is; -1 if its bytes differ."""
        got = self.steps[state].get(token)
        if got is None:
            (lead, residual), own = self.states[state], self.turn[state]
            t = self.bytes[own][token]
            if residual.startswith(t):
                after = (lead, residual[len(t) :])
            else:
                after = (own, t[len(residual) :]) if t.startswith(residual) else None
            if after is None:
                got = -1
            elif not after[1]:
                got = 0
            else:
                got = self.number.setdefault(after, len(self.states))
                if got == len(self.states):
                    self.states.append(after)
                    self.turn.append(1 - after[0])
                    self.steps.append({})
            self.steps[state][token] = got
            self.known += 1
        return got

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """Where each group ends, in a and in b; None if the sequences' bytes differ."""
        if self.known > KEPT_STEPS:
            self.__init__(*self.bytes)
        out, i, j, state, n, m = [], 0, 0, 0, len(a), len(b)
        turn, steps = self.turn, self.steps
        while i < n or j < m:
            if turn[state]:
                if j == m:
                    return None
                token, j = b[j], j + 1
            else:
                if i == n:
                    return None
                token, i = a[i], i + 1
            after = steps[state].get(token)
            if after is None:
                after = self.step(state, token)
            if after < 0:
                return None
            state = after
            if not state:
                out.append((i, j))
        return None if state else out


class Store:
    """What segments give, by number: counts (A's tokens, B's tokens, groups), groups as text, links as distinct pairs with how often each; and
    faults, the numbers of segments whose bytes a tokenizer doesn't give back."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.counts = [Buffer() for _ in range(3)]
        self.text: list[str] = []
        self.chars = 0
        self.first, self.size, self.pairs, self.times = Buffer(), Buffer(), Buffer(), Buffer()
        self.faults: set[int] = set()

    def add(self, segments: list[str], got: list[tuple]) -> None:
        start, n = len(self.text), self.pairs.n
        self.at.update(zip(segments, range(start, start + len(segments)), strict=True))
        for k, held in enumerate(self.counts):
            held.add([g[k] for g in got])
        self.text += [g[3] for g in got]
        self.chars += sum(len(g[3]) for g in got)
        sizes = np.array([len(g[4]) for g in got], np.int64)
        self.first.add(n + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.pairs.add([p for g in got for p in g[4]])
        self.times.add([t for g in got for t in g[4].values()])
        self.faults.update(start + i for i, g in enumerate(got) if not g[5])

    def full(self) -> bool:
        return len(self.text) > KEPT or self.pairs.n > KEPT_PAIRS or self.chars > KEPT_CHARS


#: Of a text: tokens of A and of B, groups, their digest, distinct pairs, how often each.
Aligned = tuple[int, int, int, str, np.ndarray, np.ndarray]
_NO_PAIRS = np.zeros(0, np.int64)


class Aligner:
    """The two tokenizers, the transducer over their tokens, and what is kept of segments."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        table = _byte_of_char()
        a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for piece, i in self.a.get_vocab(with_added_tokens=True).items():
            a[i] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece goes on after a word's end, so texts can't be cut before spaces")
        b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.bytes, self.n_b, self.names = (a, b), len(b), list(map(str, range(max(len(a), len(b)))))
        self.begins = np.array([x.startswith(b" ") for x in a])
        self.transducer, self.store = Transducer(a, b), Store()

    def segment(self, segment: str, a: list[int], b: list[int]) -> tuple[int, int, int, str, dict[int, int], bool]:
        """(number of A's, of B's tokens, of groups, groups as text, distinct pairs with how often each, whether the bytes are the segment's)."""
        groups = self.transducer.groups(a, b)
        if groups is None or b"".join(map(self.bytes[0].__getitem__, a)) != b" " + segment.encode():
            return 0, 0, 0, "", {}, False
        text, pairs, i, j = [], {}, 0, 0
        names, n_b = self.names, self.n_b
        for p, q in groups:
            if p - i == q - j == 1:
                x, y = a[i], b[j]
                text.append(f"{x}|{y}")
                k, i, j = x * n_b + y, p, q
                pairs[k] = pairs.get(k, 0) + 1
                continue
            x, y = a[i:p], b[j:q]
            text.append(",".join(map(names.__getitem__, x)) + "|" + ",".join(map(names.__getitem__, y)))
            if len(x) * len(y) <= FEW:
                for u in x:
                    for v in y:
                        pairs[k] = pairs.get(k := u * n_b + v, 0) + 1
            else:
                # ids that repeat within a group count as often as they pair up
                (u, m), (v, n) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
                for k, t in zip((u[:, None] * n_b + v).ravel().tolist(), (m[:, None] * n).ravel().tolist(), strict=True):
                    pairs[k] = pairs.get(k, 0) + t
            i, j = p, q
        return len(a), len(b), len(groups), ";".join(text), pairs, True

    def _encode(self, segments: list[str]) -> list[list[int]]:
        """A's ids of each segment with the space before it. Of segments without white space, each a word to A, only the first token begins with
        a space, so the library gets many as one text."""
        out: list = [None] * len(segments)
        words = [i for i, s in enumerate(segments) if s.split() == [s]]
        for lo in range(0, len(words), TOGETHER):
            part = words[lo : lo + TOGETHER]
            (enc,) = self.a.encode_batch_fast([" " + " ".join([segments[i] for i in part])], add_special_tokens=False)
            ids = enc.ids
            first = np.flatnonzero(self.begins[ids]).tolist()
            if len(first) == len(part):
                for i, x, y in zip(part, first, [*first[1:], len(ids)], strict=True):
                    out[i] = ids[x:y]
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, enc in zip(rest, self.a.encode_batch_fast([" " + segments[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = enc.ids
        return out

    def _learn(self, segments: set[str]) -> None:
        """Adds what new segments give."""
        every = sorted(segments)
        for lo in range(0, len(every), ENCODE):
            some = every[lo : lo + ENCODE]
            self.store.add(some, list(map(self.segment, some, self._encode(some), self.b.encode(some, num_threads=1))))

    def whole(self, text: str) -> bool:
        """Whether both sides' joined bytes are a space and the text."""
        ids = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
        return all(b"".join(map(side.__getitem__, x)) == b" " + text.encode() for side, x in zip(self.bytes, ids, strict=True))

    def align(self, texts: list[str]) -> list[Aligned]:
        """Of each text, none of them empty, what it gives."""
        if self.store.full():
            self.store = Store()
        store = self.store
        # most texts have single spaces alone; a part that is empty or has white space at an end shows that a text has others
        split = [t.split(" ") for t in texts]
        odd = {p for p in set(chain.from_iterable(split)).difference(store.at) if not p or p[0].isspace() or p[-1].isspace()}
        if odd:
            split = [p if odd.isdisjoint(p) else _CUT.split(t) for p, t in zip(split, texts, strict=True)]
        self._learn(set(chain.from_iterable(split)).difference(store.at))
        size = np.array([len(p) for p in split])
        number = np.fromiter(map(store.at.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        first = np.cumsum(size) - size
        totals = [np.add.reduceat(held.all()[number], first).tolist() for held in store.counts]
        # distinct pairs of each text, from its distinct segments
        n, many = len(texts), len(store.text)
        seen, count = np.unique(np.repeat(np.arange(n), size) * many + number, return_counts=True)
        text, kind = seen // many, seen % many
        runs, at = store.size.all()[kind], store.first.all()[kind]
        pairs, times = ragged(store.pairs.all(), at, runs), ragged(store.times.all(), at, runs) * np.repeat(count, runs)
        owner = np.repeat(text, runs)
        order = np.lexsort((pairs, owner))
        pairs, times, owner = pairs[order], times[order], owner[order]
        head = np.flatnonzero((np.diff(pairs, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        sums = np.add.reduceat(times, head) if len(head) else times
        cuts = np.searchsorted(owner[head], np.arange(1, n))
        out = list(zip(*totals, [hashlib.sha256(";".join(map(store.text.__getitem__, x)).encode()).hexdigest() for x in np.split(number, first[1:])], np.split(pairs[head], cuts), np.split(sums, cuts), strict=True))
        if store.faults:
            for i, x in enumerate(np.split(number, first[1:])):
                if not store.faults.isdisjoint(x.tolist()):
                    # only two faults that make up for each other could give the text's bytes
                    if self.whole(texts[i]):
                        raise ValueError("a segment's bytes differ where the text's don't")
                    out[i] = (0, 0, 0, "", _NO_PAIRS, _NO_PAIRS)
        return out

    def all(self, texts: list[str | None]) -> Iterator[Aligned]:
        """The same for texts that may be null or empty, some hundred thousand characters at a time."""
        for lo, hi in chunks(texts):
            some = [t for t in texts[lo:hi] if t]
            got = iter(self.align(some) if some else ())
            for t in texts[lo:hi]:
                yield next(got) if t else (0, 0, 0, "", _NO_PAIRS, _NO_PAIRS)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


_DOC = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, at binary, times binary, pairs array<long>, docs array<int>"


def _record(**columns) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(), "at": pa.binary(), "times": pa.binary(), "pairs": pa.list_(pa.int64()), "docs": pa.list_(pa.int32())}
    n = len(columns["block"])
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), k) for c, k in kinds.items()], list(kinds))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A written table with a row for each document (doc_id, n_a, n_b, n_groups, groups_sha256, at: places of its distinct pairs in its block's
    list, times: how often each) and one for each block of documents (pairs: its distinct pairs a * (number of B's ids) + b, docs: how many of its
    documents have each; doc_id and the other columns null, n_a -1)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        code, task, number = aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        held = 0

        def block():
            nonlocal number
            names = (task << 32) + number
            keys = np.concatenate([r[5] for r in rows])
            distinct, at, n = np.unique(keys, return_inverse=True, return_counts=True)
            yield _record(block=[names], n_a=[-1], pairs=[distinct], docs=[n.astype(np.int32)])
            cuts = np.cumsum([len(r[5]) for r in rows])[:-1]
            at = np.split(at.astype("<i4"), cuts)
            for lo in range(0, len(rows), 1024):
                some = rows[lo : lo + 1024]
                cols = list(zip(*some, strict=True))
                yield _record(block=[names] * len(some), doc_id=cols[0], n_a=cols[1], n_b=cols[2], n_groups=cols[3], groups_sha256=cols[4], at=[x.tobytes() for x in at[lo : lo + 1024]], times=[x.astype("<i8").tobytes() for x in cols[6]])
            number += 1

        for batch in batches:
            for doc_id, got in zip(batch.column(0).to_pylist(), code.all(batch.column(1).to_pylist()), strict=True):
                rows.append((doc_id, *got))
                held += len(got[4])
                if len(rows) >= BLOCK_DOCS or held >= BLOCK_PAIRS:
                    yield from block()
                    rows, held = [], 0
        if rows:
            yield from block()

    return written(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _DOC), "aligned")


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): how many documents have each pair of `align`, and whether that is its A id's highest count."""
    counts = aligned.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("count"))
    counts = written(counts, "pairs")
    # an A id has n_b pairs at most
    top = counts.groupBy(F.floor(F.col("pair") / n_b).alias("a")).agg(F.max("count").alias("top"))
    return counts.withColumn("a", F.floor(F.col("pair") / n_b)).join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each document how its tokens by a byte-level BPE (A, of a space and the text) and by a sentencepiece model (B, of the text) align:
    n_a and n_b tokens, n_groups groups, n_links pairs of token occurrences in a group, n_best of them whose pair of ids is in as many documents
    as any pair of its A id, count_sum the documents of their pairs, summed over links, and groups_sha256.

    Null and empty texts, and those that a tokenizer doesn't give back (such as texts with U+2581), have no tokens: zeros and ''. Rows that repeat
    a doc_id, or have none, are documents of their own. An empty table gives no rows; further columns of any name are left out. A text is read
    whole; a long one without spaces between words is one segment, whose tokens a worker holds.
    """
    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    aligned = align(docs, a_path, b_path)
    counts = pair_counts(aligned, n_b)
    asked = aligned.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(counts, "pair").select("block", "place", "count", "best")
    nothing = lambda kind, *cols: [F.lit(None).cast(kind).alias(c) for c in cols]
    cols = ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "at", "times")
    left = told.select("block", "place", "count", "best", *nothing("long", *cols[:4]), *nothing("string", cols[4]), *nothing("binary", *cols[5:]))
    right = aligned.where("pairs is null").select("block", *nothing("int", "place"), *nothing("long", "count"), *nothing("boolean", "best"), *cols)
    met = left.unionByName(right).repartition("block").sortWithinPartitions("block", F.col("place").isNull(), "place")

    def run(batches):
        block, counts, bests, ready = None, [], [], None
        for batch in batches:
            blocks, docs = batch.column("block").to_numpy(), batch.column("place").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(docs.astype(np.int8)) != 0)) + 1
            edges = [0, *cuts.tolist(), len(blocks)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if blocks[lo] != block:
                    block, counts, bests, ready = blocks[lo], [], [], None
                part = batch.slice(lo, hi - lo)
                if not docs[lo]:
                    counts.append(part.column("count").to_numpy())
                    bests.append(part.column("best").to_numpy(zero_copy_only=False))
                    continue
                if ready is None:
                    ready = (np.concatenate(counts), np.concatenate(bests)) if counts else (np.zeros(0, np.int64), np.zeros(0, bool))
                links, best, total = [], [], []
                for at, times in zip(part.column("at").to_pylist(), part.column("times").to_pylist(), strict=True):
                    at, times = np.frombuffer(at, "<i4"), np.frombuffer(times, "<i8")
                    links.append(int(times.sum()))
                    best.append(int(times[ready[1][at]].sum()))
                    total.append(int((times * ready[0][at]).sum()))
                plain = {c: part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
                plain |= {"n_links": pa.array(links, pa.int64()), "n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
                names = [c.split()[0] for c in _OUT.split(", ")]
                yield pa.RecordBatch.from_arrays([plain[c] for c in names], names)

    return met.mapInArrow(run, _OUT)
