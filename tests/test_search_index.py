import math
import random
from collections import Counter, defaultdict

import pytest


from siltflow.operators import retrieval as R

PAGES = "url string, title string, text string, section string, kind string, overview boolean"
WORDS = "volume region deploy docker build storage backup cache proxy domain metric healthcheck postgres redis".split()


def terms(text):
    import re

    return [t for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(t := R.plain_stem(w)) >= 3 and t not in R.STOP_STEMS]


def brute(pages, queries, limit, per_section, kinds=None):
    """Every page scored for every query: {(qid, rank): (url, score)}."""
    tf = {}
    for url, title, text, section, kind, overview in pages:
        if (text or "").strip():
            tf[url] = Counter(terms(text))
            for t in terms(title):
                tf[url][t] += 3
    df = Counter(t for c in tf.values() for t in c)
    n, avg = len(tf), sum(sum(c.values()) for c in tf.values()) / max(1, len(tf))
    out = {}
    for qid, q in queries:
        hits = []
        for url, _, _, section, kind, overview in pages:
            if url not in tf or kinds and kind not in kinds:
                continue
            length = sum(tf[url].values())
            raw = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[url][t] * 2.5 / (tf[url][t] + 1.5 * (0.25 + 0.75 * length / avg)) for t in dict.fromkeys(terms(q)) if t in tf[url])
            score = round(raw * (1.2 if overview else 1), 6)
            if score > 0:
                hits.append((-score, url, section))
        used, rank = defaultdict(int), 0
        for score, url, section in sorted(hits):
            if (per_section is None or used[section] < per_section) and rank < limit:
                used[section] += 1
                rank += 1
                out[qid, rank] = (url, -score)
    return out


def made(seed, n=300):
    """Pages that all have one word, some with rare ones."""
    r = random.Random(seed)
    return [(f"u{i:03d}", r.choice(["", "Volume guide", f"Page {i}"]), " ".join(["railway", *r.choices(WORDS, [2.0**-k for k in range(len(WORDS))], k=r.randrange(1, 40))]), r.choice("abc"), r.choice(["docs", "blog"]), i % 17 == 0) for i in range(n)]


def same(spark, index, pages, limit, per_section, kinds=None):
    queries = [(1, "railway volume"), (2, "redis postgres railway"), (3, "railway"), (4, "healthcheck metrics domains"), (5, "nothing known"), (6, " ".join(WORDS))]
    got = {(r.qid, r.rank): (r.url, r.score) for r in R.search(index, spark.createDataFrame(queries, "qid int, text string"), limit, per_section, kinds).collect()}
    want = brute(pages, queries, limit, per_section, kinds)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


@pytest.fixture
def small(monkeypatch):
    for name, v in {"BLOCK_ROWS": 8, "SEED_ROWS": 12, "SEED_BLOCKS": 2}.items():
        monkeypatch.setattr(R, name, v)


@pytest.mark.parametrize("limit, per_section, kinds", [(5, None, None), (6, 2, None), (4, 1, ["blog"])])
def test_pruned_search_equals_scoring_everything(spark, small, limit, per_section, kinds):
    pages = made(1)
    same(spark, R.build(spark.createDataFrame(pages, PAGES)), pages, limit, per_section, kinds)


def test_a_term_that_all_pages_have_makes_few_rows(spark, small, monkeypatch):
    """Queries with a word of every page and a rare one: scored are far fewer than queries x pages."""
    pages = made(2, 400)
    index = R.build(spark.createDataFrame(pages, PAGES))
    scored, plain = [], R._scored

    def counted(index, found, lists, average):
        scored.append(found.count())
        return plain(index, found, lists, average)

    monkeypatch.setattr(R, "_scored", counted)
    queries = [(i, f"railway {w}") for i, w in enumerate(WORDS[4:])]
    got = R.search(index, spark.createDataFrame(queries, "qid int, text string"), 3, None)
    assert {(r.qid, r.rank): r.url for r in got.collect()} == {k: v[0] for k, v in brute(pages, queries, 3, None).items()}
    assert max(scored) < 0.2 * len(queries) * len(pages)


def test_update_equals_rebuild_and_reads_what_changed(spark, small):
    pages = made(3)
    index = R.build(spark.createDataFrame(pages, PAGES))
    r = random.Random(4)
    changed = [p if r.random() > 0.03 else (p[0], p[1], p[2] + " volume volume redis", *p[3:]) for p in pages if r.random() > 0.02]
    changed += [("new1", None, "railway redis redis", "a", "docs", True), ("new2", None, " ", "a", "docs", False)]
    differ = len({p for p in changed if p not in pages}) - 1  # new2 has no text
    after = R.update(index, spark.createDataFrame(changed, PAGES))
    assert spark.read.parquet(f"{after.store}/{after.segments[-1]['name']}/docs").count() == differ
    fresh = R.build(spark.createDataFrame(changed, PAGES))
    for name in ("tf", "df", "length"):
        assert sorted(map(tuple, getattr(after, name).collect())) == sorted(map(tuple, getattr(fresh, name).collect()))
    assert after.counts == fresh.counts
    same(spark, after, changed, 6, 2)
    # back again, and once more without any change
    again = R.update(after, spark.createDataFrame(pages, PAGES))
    same(spark, again, pages, 5, None)
    assert R.update(again, spark.createDataFrame(pages, PAGES)).segments == again.segments


def test_empty_index(spark):
    index = R.build(spark.createDataFrame([("a", "t", " ", "s", "k", False)], PAGES))
    asked = spark.createDataFrame([(1, "volume")], "qid int, text string")
    assert R.search(index, asked).count() == 0 and index.counts == (0, 1.0)
    after = R.update(index, spark.createDataFrame([("a", "t", "volume", "s", "k", False)], PAGES))
    assert [r.url for r in R.search(after, asked).collect()] == ["a"]
    assert R.stored(index.pages, index.store + "-none") is None


def test_a_state_is_written_once(spark, tmp_path):
    from siltflow.storage import commit, latest

    commit(spark, f"{tmp_path}/m", 0, "a")
    commit(spark, f"{tmp_path}/m", 0, "b")
    commit(spark, f"{tmp_path}/m", 1, "c")
    with pytest.raises(RuntimeError):
        commit(spark, f"{tmp_path}/m", 1, "d")
    assert latest(spark, f"{tmp_path}/m") == (1, "c")


def test_tasks_hand_on_the_best_of_each_query_alone(spark, small):
    """Most pages are copies, so that scores tie; a task hands on at most limit rows a query, whatever the number of pages that have its terms."""
    from siltflow.storage import work_dir, written

    pages = [(f"u{i:04d}", None, "railway volume" if i % 3 else "railway volume volume region", [None, "a", "b"][i % 5 % 3], "docs", i % 50 == 0) for i in range(900)]
    frame = spark.createDataFrame(pages, PAGES).repartition(3)
    index = R.build(frame)
    for limit, per_section in ((7, None), (7, 2), (4, 3)):
        same(spark, index, pages, limit, per_section)
    folder = f"{work_dir(spark)}/asked-few"
    lists = written(spark.createDataFrame([(i, 10 + i, ["volum", "region"], [0.5, 0.25]) for i in range(5)], "q long, qid int, asked array<string>, idfs array<double>").coalesce(1), folder)
    met = R._met(index, lists, folder, 7, 2, None, index.counts[1])
    parts = index.docs.rdd.getNumPartitions()
    assert 5 * 6 <= met.count() <= 5 * 7 * parts < 900


def test_scores_are_rounded_as_spark_rounds(spark):
    import numpy as np

    values = [0.0000005, 1.0000005, 2.5000015, 0.1 + 0.2, 12.3456785, 12.34567849999, 7.0000025, 1e-7, 3.9999995]
    r = random.Random(5)
    values += [r.randrange(10**9) / 1e7 for _ in range(2000)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6).alias("y")).collect()
    assert [round(row.y * 1e6) for row in got] == R._micro(np.array(values)).tolist()
