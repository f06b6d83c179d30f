import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltflow.llm import alignment, queries

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
A.encode_special_tokens = True
CHARS = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256), *range(33), *range(127, 161), 173], [chr(x) for x in (*range(33, 127), *range(161, 173), *range(174, 256), *range(256, 324))])}
TEXTS = ["", None, "Hello world, it's  a test.\n\n New 123 lines\tx ", "naïve café 漢字 😀 и так далее", "a▁b", "▁", " ", "  lead", "<|endoftext|> <s> </s> <0x41>", "x" * 700, "word " * 90, "\n\r\n \x1c y", "aaaa aaaa. aaaa,", "the the the"]


def sides(text):
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    of_a = [bytes(CHARS[c] for c in A.id_to_token(i)) for i in a]
    of_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = b" " + text.encode()
    return (list(zip(a, of_a)), list(zip(b, of_b))) if b"".join(of_a) == b"".join(of_b) == whole else ([], [])


def brute(texts):
    """By offsets: a dict for each text."""
    every, docs, out = [], defaultdict(set), []
    for n, text in enumerate(texts):
        groups, (a, b) = [], sides(text) if text else ([], [])
        ends = []
        for side in (a, b):
            at, e = 0, []
            for _, x in side:
                at += len(x)
                e.append(at)
            ends.append(e)
        cuts, last = sorted(set(ends[0]) & set(ends[1])), 0
        for c in cuts:
            groups.append(([i for (i, _), e in zip(a, ends[0]) if last < e <= c], [i for (i, _), e in zip(b, ends[1]) if last < e <= c]))
            last = c
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        for p in links:
            docs[p].add(n)
        every.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), d in docs.items():
        best[x] = max(best[x], len(d))
    for n_a, n_b, groups, links in every:
        sha = hashlib.sha256(";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups).encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(t for p, t in links.items() if len(docs[p]) == best[p[0]]), sum(t * len(docs[p]) for p, t in links.items()), sha))
    return out


def rows(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.orderBy("doc_id").collect()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" '  \n\tsthe.,naïé漢😀▁1-\x1c\x85　", max_size=40), max_size=6))
def test_texts_align_as_their_offsets_do(texts):
    code = alignment.aligner(A_PATH, B_PATH)
    for (n_a, n_b, n_groups, sha, pairs, times), want in zip(code.all(texts), brute(texts), strict=True):
        assert (n_a, n_b, n_groups, int(times.sum()), sha) == (*want[:4], want[6])
        assert sorted(set(pairs.tolist())) == pairs.tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"ab", b"b", b"aab", b"ba"])), st.lists(st.sampled_from([b"a", b"ab", b"b", b"aab", b"ba"])))
def test_transducer(a, b):
    names = [b"a", b"ab", b"b", b"aab", b"ba"]
    got = alignment.Transducer(names, names).groups([names.index(x) for x in a], [names.index(x) for x in b])
    ends = [{sum(map(len, side[: i + 1])): i + 1 for i in range(len(side))} for side in (a, b)]
    assert got == ([(ends[0][e], ends[1][e]) for e in sorted(set(ends[0]) & set(ends[1]))] if b"".join(a) == b"".join(b) else None)


@pytest.mark.parametrize("small", [False, True])
def test_report_equals_brute_force(spark, small, monkeypatch):
    if small:  # in one process, so that workers see it: many blocks, stores that start anew, large groups
        for name, v in {"BLOCK_DOCS": 3, "KEPT": 5, "FEW": 0, "KEPT_STEPS": 4}.items():
            monkeypatch.setattr(alignment, name, v)
        code = alignment.Aligner(A_PATH, B_PATH)
        got = [x[:3] for _ in range(2) for x in code.all(TEXTS)]
        assert got == [w[:3] for w in brute(TEXTS)] * 2
    docs = spark.createDataFrame([(i, t, 7, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, pairs int, block string").repartition(3)
    assert rows(alignment.report(docs, A_PATH, B_PATH)) == brute(TEXTS)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "two words"), (1, "two words"), (None, "two"), (2, None)], "doc_id long, text string")
    got = alignment.report(docs, A_PATH, B_PATH).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 0)]
    assert {r.count_sum for r in got if r.doc_id == 1} == {5}
    assert alignment.report(docs.limit(0), A_PATH, B_PATH).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")
    assert rows(queries.op13_token_alignment(spark, sf)) == brute(t.column("text").to_pylist())
