import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltflow.llm import components, decontaminate, jaccard_forest
from siltflow.llm.shared import Words, shingle_hashes, shingle_words

DOCS = "doc_id long, text string, lang string, node string, id long, prefix string"


def words(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}\p{M}]+", (text or "").lower())


def sets(text):
    return shingle_words(words(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aé1 .,\n漢́", max_size=30), max_size=6))
def test_words_and_shingles(texts):
    w = Words(texts)
    at = np.searchsorted(w.doc, np.arange(len(texts) + 1))
    for i, t in enumerate(texts):
        mine = [w.word(j) for j in range(at[i], at[i + 1])]
        assert mine == words(t)
        assert len(set(shingle_hashes(w.h[at[i] : at[i + 1]]).tolist())) == len(sets(t))


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 160))]
        for _ in range(rng.choice((1, 2, 3, 30))):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t))
    out += [out[0]] * 40 + ["", None, "one two", "one two", "One, two!", "x"]
    rng.shuffle(out)
    return out


def brute(rows):
    texts = sorted({t or "" for _, t in rows})
    s = {t: sets(t) for t in texts}
    near = {t: {u for u in texts if u != t and s[t] and s[u] and len(s[t] & s[u]) >= 0.8 * len(s[t] | s[u])} for t in texts}
    least = {t: min(i for i, x in rows if (x or "") == t) for t in texts}
    out = {}
    for i, x in rows:
        seen, todo = set(), [x or ""]
        while todo:
            if (t := todo.pop()) not in seen:
                seen.add(t)
                todo += near[t]
        out[i] = (min(least[t] for t in seen), least[x or ""], len(near[x or ""]))
    return out


@pytest.mark.parametrize("block", [256, 7])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_forest, "BLOCK", block)
    rows = list(enumerate(corpus()))
    docs = spark.createDataFrame([(i, t, "en", "clash", 1, "p") for i, t in rows], DOCS)
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in jaccard_forest.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_keep_one(spark):
    rows = [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (2, "a b c d e f", "de"), (3, None, "en"), (4, "", "en"), (None, "alone is this text here", "en"), (None, "another one without an id", "en")]
    kept = jaccard_forest.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (True, 0), (True, 0)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_forest.near_duplicates(docs).count() == 0
    assert decontaminate.contaminated(docs, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = set(), [n]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += near[x]
        assert got[n] == min(seen)
    assert set(got) == set(near)


def contained(item, text):
    """Shared shingles, if the text holds the item to the threshold; a short item is one sequence of words."""
    x, t = words(item), words(text)
    if 0 < len(x) < 5:
        return int(any(t[i : i + len(x)] == x for i in range(len(t))))
    n = len(sets(item) & sets(text))
    return n if n and n >= 0.8 * len(sets(item)) - 1e-9 else 0


@pytest.mark.parametrize("chars", [8_000_000, 400])
def test_contamination_equals_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    phrase = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(rng.choice((2, 5, 8, 20, 60)))) for i in range(30)] + [(30, None), (31, ""), (32, items_last := "short one")]
    docs = []
    for i in range(150):
        t = phrase(rng.choice((3, 30, 400)))
        if i % 3 == 0:
            w = rng.choice(items[:30])[1].split()
            w = w[: max(1, int(len(w) * rng.choice((0.5, 0.85, 0.95, 1.0))))]
            t = f"{t} {' '.join(w).upper()}, {phrase(rng.choice((0, 20)))}"
        docs.append((i, t))
    docs += [(900, None), (901, ""), (902, items_last), (None, items[0][1]), (5, docs[5][1])]
    docs += [(903, "a rather SHORT, one that is long enough"), (904, "one short")]
    want = []
    for d, t in docs:
        for i, x in items:
            if n := contained(x, t):
                want.append((d, i, len(sets(x)), n))
    assert {(900 + d, 32) for d in (2, 3)} <= {w[:2] for w in want} and (904, 32) not in {w[:2] for w in want}
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    kept = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    bad = {t for d, t in docs if any(contained(x, t) for _, x in items)}
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((d or -1, t or "") for d, t in docs if t not in bad)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in found.collect()], key=key) == sorted(want, key=key)


def test_signature_keeps_small_sets_whole():
    k = decontaminate.permutations(0.8)
    assert k == 11 and (0.2**k) < 1e-7
    small = np.arange(5, dtype=np.uint64)
    assert decontaminate.signature(small, k).tolist() == small.tolist()
