"""What the gate of actions reads and writes of a corpus: grams of quotes, words of pages, hits, each no more than is asked for."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from siltflow.functions import grams as N
from siltflow.operators import gate as G
from siltflow.operators import retrieval as R
from siltflow.plans import review_queries as V

SF = "/root/testdata/sf0.001"
LETTERS = "abAB ceds ingyxzhKİÀé9_-\n“"


@pytest.mark.parametrize("most", [1, 7, 4_000_000])
def test_only_grams_of_the_quotes_are_written(spark, monkeypatch, most):
    monkeypatch.setattr(G, "quote_index", None)  # grams of all texts aren't made for these quotes
    monkeypatch.setattr(G, "MOST_GRAMS", most)
    told = "A volume can be restored, from “any” snapshot."
    docs = spark.createDataFrame([(1, f"É {told} " + "And more is said here. " * 20), (2, "Quite another text about the very same thing."), (3, ""), (4, None), (5, told.upper())], "doc_id long, body string")
    quotes = spark.createDataFrame([(1, ["can be restored from any snapshot"]), (2, ["another text about the very", "same thing"]), (3, ["never said by anyone here"]), (4, [])], "item_id long, parts array<string>")
    assert sorted(map(tuple, G.quote_hits(quotes, docs).collect())) == [(1, 1), (1, 5), (2, 2)]
    if most > 1:
        wanted = spark.createDataFrame([(int(g),) for g in N.grams("can be restored from any snapshot")], "gram long")
        met = sorted(map(tuple, G.grams_met(wanted, docs).collect()))
        assert met == sorted((g.gram, d) for g in wanted.collect() for d in (1, 5))


@given(st.lists(st.text(LETTERS, max_size=60), max_size=5), st.integers(0, 2**32))
def test_wanted_grams_are_those_of_the_normal_text(texts, seed):
    normal = [re.sub("[^a-z0-9]+", " ", x.lower()).strip() for x in texts]
    grams = np.concatenate([np.zeros(0, np.int64), *(N.grams(x) for x in normal)])
    some = np.random.default_rng(seed).permutation(grams)[: len(grams) // 2]
    look = N.Wanted(some)
    for x, plain in zip(texts, normal, strict=True):
        assert N.plain(x).tobytes().decode().strip() == plain
        assert set(N.grams(plain).tolist()) & set(some.tolist()) <= set(look.found(x).tolist()) <= set(some.tolist())


@given(st.lists(st.tuples(st.text(LETTERS, max_size=60), st.text(LETTERS, max_size=20)), max_size=5))
def test_words_of_many_pages_are_counted_as_one_by_one(pages):
    n, terms, fs = R.counted([a for a, _ in pages], [b for _, b in pages])
    at, terms = np.cumsum([0, *n]), terms.to_pylist()
    for k, (text, title) in enumerate(pages):
        want: dict[str, int] = {}
        for said, weight in ((text, 1), (title, R.TITLE_WEIGHT)):
            for w in re.findall("[a-z0-9]+", said.lower()):
                if len(t := R.plain_stem(w)) >= R.LEAST_TERM and t not in R.STOP_STEMS:
                    want[t] = want.get(t, 0) + weight
        assert dict(zip(terms[at[k] : at[k + 1]], fs[at[k] : at[k + 1]].tolist(), strict=True)) == want


@given(st.lists(st.lists(st.sampled_from(["s", "es", "ies", "ing", "ed", "e", "x", "ch", "sh", "z", "b", "bb", "nn", "t", "a", "y", "1"]), min_size=1, max_size=5).map("".join), min_size=1))
def test_stems_at_once(words):
    assert R.stems(pa.array(words)).to_pylist() == [R.plain_stem(w) for w in words]
    assert R.stems(pa.array(words).slice(1)).to_pylist() == [R.plain_stem(w) for w in words[1:]]


def test_frequencies_that_are_handed_on_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [([f"w{int(x)}" for x in set(rng.integers(0, 30, 12))],) for _ in range(900)] + [([],)]
    docs = spark.createDataFrame(rows, "terms array<string>").coalesce(1)
    want = {t: -sum(t in r for r, in rows) for t in {t for r, in rows for t in r}}
    for most in (10, 500_000):
        monkeypatch.setattr(R, "MOST_MET", most)
        assert {r.term: r.d for r in R._frequencies(docs, -1).groupBy("term").agg({"d": "sum"}).withColumnRenamed("sum(d)", "d").collect()} == want


def test_analyses_need_no_search(spark, monkeypatch):
    ids = sorted({r.id for r in V._proposed(spark, SF).select("id").collect()})
    monkeypatch.setattr(G, "quote_hits", None)
    assert sorted(r.id for r in V._analyses(spark, SF).collect()) == ids


def test_more_queries_than_a_pass_scores(spark, monkeypatch):
    rows = [(i, f"t{i}", f"volume w{i % 7} snapshot w{i % 5}", "s", "docs", False) for i in range(40)]
    index = R.build(spark.createDataFrame(rows, "url long, title string, text string, section string, kind string, overview boolean"))
    asked = spark.createDataFrame([(q, f"volumes w{q % 7}") for q in range(30)], "qid long, text string")
    found = lambda: sorted(map(repr, R.search(index, asked, 3, None).select("qid", "url", "score", "rank").collect()))
    whole = found()
    monkeypatch.setattr(R, "QUERY_BLOCK", 8)
    assert found() == whole and len(whole) == 90
