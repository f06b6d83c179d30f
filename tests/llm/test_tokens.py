import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltflow.llm import bpe, rans, shared

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORD_PATH = P.path("word_bpe_49k.json")
WORD_LIBRARY, WORDS = Tokenizer.from_file(WORD_PATH), rans.Words(WORD_PATH)
ALPHABET = " '  \n\tstmdrvlexYé9١.!-　\x85\x1c’ñ漢😀"
TEXTS = ["", None, "a'll b's ''s  'd \n\n x", "word " * 300, "x" * 3000, " " * 500, "don't stop\r\n1234 <|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), max_size=5))
def test_encoding_equals_the_library(texts):
    code = bpe.coder(PATH)
    for t, (ids, starts, counts) in zip(texts, code.encode(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode_ordinary(t)
        assert code.decode(ids) == t.encode()
        assert counts.sum() == len(ids) and list(starts) == sorted(set(starts.tolist()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, len(bpe.monoid()[2]) - 1), max_size=400))
def test_scan_is_a_fold(elements):
    _, table, image = bpe.monoid()
    m, out, acc = len(image), [], 0
    for e in elements:
        acc = int(table[acc * m + e]) // m
        out.append(acc)
    assert bpe.scan(np.array(elements, np.int32), block=8).tolist() == out


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abé漢 the", min_size=1, max_size=80))
def test_merge(text):
    assert bpe.merge(text.encode(), RANKS) == list(bpe.coder(PATH).kept.merge(text))


def test_bpe_queries(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(0, "", 7), (None, "x", 7)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH).collect()}
    for i, t in enumerate(TEXTS):
        ids = LIBRARY.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs, PATH).count() == len(TEXTS) + 2
    back = {r.doc_id: bytes(r.data) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert back[3] == TEXTS[3].encode() and back[1] == b""


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 2000), st.floats(0.2, 3))
def test_rans_round_trip(seed, kinds, skew):
    rng = np.random.default_rng(seed)
    p = np.arange(1, kinds + 1) ** -skew
    ids = rng.choice(kinds, size=int(rng.integers(1, 300_000)), p=p / p.sum()) * 3
    table = rans.Table(*np.unique(ids, return_counts=True))
    assert int(table.freq.sum()) == 1 << rans.PRECISION
    block = rans.encode(ids, table)
    assert rans.decode(block, len(ids), table).tolist() == ids.tolist()
    stretches = len(np.frombuffer(block["sums"], "<u4"))
    k = stretches // 2
    size = rans.CHECKPOINT * rans.LANES
    assert rans.decode(block, len(ids), table, k, k + 1).tolist() == ids[k * size : (k + 1) * size].tolist()


def test_rans_detects_damage():
    ids = np.arange(90_000) % 97
    table = rans.Table(*np.unique(ids, return_counts=True))
    block = rans.encode(ids, table)
    bad = bytearray(block["payload"])
    bad[len(bad) // 4] ^= 1
    with pytest.raises((ValueError, IndexError)):
        rans.decode({**block, "payload": bytes(bad)}, len(ids), table)


def thue_morse(n, a="a", b="b"):
    """Two words of n letters, each with the other's letters exchanged."""
    word = "".join(b if i.bit_count() % 2 else a for i in range(n))
    return word, word.translate(str.maketrans(a + b, b + a))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_exchanged_words(n):
    texts = list(thue_morse(n))
    assert len(set(shared.span_hashes("".join(texts), np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
    assert [ids.tolist() for ids, _, _ in bpe.coder(PATH).encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [x.tolist() for x in rans.Words(WORD_PATH).encode(texts)] == [WORD_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash that only knows lengths, texts decide."""
    for module in (shared, rans):
        monkeypatch.setattr(module, "span_hashes", lambda text, start, end: (end - start).astype(np.uint64))
    texts = ["ab cd ab xyz", "cd xyz ef.", "gh gh ab"]
    assert [ids.tolist() for ids, _, _ in bpe.coder(PATH).encode(texts)] == [LIBRARY.encode_ordinary(t) for t in texts]
    words = rans.Words(WORD_PATH)
    for _ in range(2):
        assert [x.tolist() for x in words.encode(texts)] == [WORD_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aAsSéÉİıßÀ×'.,!|<>-9 \u0301\u0331\u0338\u200d\x1c\u2028ΣσH", max_size=30), max_size=4), st.booleans())
def test_words_equal_the_library(texts, special):
    texts = [t + "<|ENDOFTEXT|>x<|endoftext|>" * special for t in texts]
    want = [WORD_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in WORDS.encode(texts)] == want


def test_full_store_starts_anew(monkeypatch):
    monkeypatch.setattr(rans, "KEPT", 5)
    words = rans.Words(WORD_PATH)
    texts = [f"word{i} other{i}." for i in range(20)]
    for t in texts:
        assert words.encode([t])[0].tolist() == WORD_LIBRARY.encode(t, add_special_tokens=False).ids


def test_read_range(spark, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_IDS", 150_000)
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(("the", "a", "of", "xylophone")) for _ in range(n))) for i, n in enumerate([10, 200_000, 5, 90_000, 1])], "doc_id long, text string")
    path = f"{shared.work_dir(spark)}/range.rans"
    table = rans.write(docs, path, WORD_PATH)
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rans.read(spark, path, table).orderBy("start").collect()])
    for first, last in ((0, 5), (60_000, 140_000), (0, len(whole)), (len(whole) - 3, len(whole) + 9), (7, 7)):
        got = sorted((r.start, bytes(r.ids)) for r in rans.read_range(spark, path, table, first, last).collect())
        assert np.frombuffer(b"".join(x for _, x in got), "<u4").tolist() == whole[first:last].tolist()


@pytest.mark.parametrize("part,ids", [((8_000_000, 128_000_000), 1 << 16), ((60, 90), 50)])
def test_token_files(spark, monkeypatch, part, ids):
    monkeypatch.setattr(rans, "PART_IDS", part)
    monkeypatch.setattr(rans, "BLOCK_IDS", ids)
    rng = random.Random(4)
    path = P.path("word_bpe_49k.json")
    docs = [(i * 3, t) for i, t in enumerate([*TEXTS, "a <|endoftext|>b", "x\x1cy z", *["".join(rng.choice(ALPHABET) for _ in range(60)) for _ in range(20)]])]
    rng.shuffle(docs)
    got = {r.doc_id: r for r in rans.round_trip(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, part int"), path).collect()}
    tokenizer, before = Tokenizer.from_file(path), 0
    for i, t in sorted(docs, key=lambda x: x[0]):
        want = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (before, len(want), zlib.crc32(want.tobytes()))
        before += len(want)
    assert rans.round_trip(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    twice = rans.round_trip(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string"), path)
    assert sorted((r.doc_id is None, r.n_tokens) for r in twice.collect()) == [(False, 2), (False, 2), (True, 1)]
    least = [(-(1 << 63), "a"), (None, "b c"), (5, "x"), (5, "y z"), (5, "w")]
    first, again = (sorted(map(tuple, rans.round_trip(spark.createDataFrame(x, "doc_id long, text string").repartition(3), path).select("start", "n_tokens", "ids_crc32").collect())) for x in (least, least[::-1]))
    assert first == again
    assert [r.doc_id for r in rans.round_trip(spark.createDataFrame(least, "doc_id long, text string"), path).orderBy("start").collect()] == [None, -(1 << 63), 5, 5, 5]
