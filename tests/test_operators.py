from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltflow.functions.patterns import needle_counts
from siltflow.operators import corpus as C
from siltflow.operators import gate as G
from siltflow.operators import retrieval as R
from siltflow.operators import routing as Q
from siltflow.operators import signals as S
from siltflow.operators.state import Store, deliver, with_fallback
from siltflow.plans import cycle
from siltflow.sources import feeds

def now():
    return F.lit("2024-06-30 00:00:00").cast("timestamp")

PAGES = "url string, title string, text string, section string, kind string, overview boolean"


@pytest.fixture(scope="module")
def index(spark):
    rows = [(f"docs/{i}", "Volumes", "volume storage snapshot backup", "docs", "docs", False) for i in range(5)]
    rows += [("guide/x", "Other", "volume pricing", "guide", "docs", False), ("blank", "Volume", "  ", "docs", "docs", False), ("ov", "Overview", "volume words", "over", "marketing", True)]
    return R.build(spark.createDataFrame(rows, PAGES))


def ask(spark, text):
    return spark.createDataFrame([(1, text)], "qid int, text string")


def test_search_caps_sections(spark, index):
    got = [r.url for r in R.search(index, ask(spark, "volume storage"), limit=6, per_section=2).orderBy("rank").collect()]
    assert sum(u.startswith("docs/") for u in got) == 2 and "guide/x" in got and "blank" not in got


def test_search_without_known_words(spark, index):
    assert R.search(index, ask(spark, "zebra the of")).count() == 0


def test_kinds_filter_after_statistics(spark, index):
    q = ask(spark, "volume")
    every = {r.url: r.score for r in R.search(index, q, 100, None).collect()}
    some = {r.url: r.score for r in R.search(index, q, 100, None, ["marketing"]).collect()}
    assert some == {"ov": every["ov"]}


def test_insert_known_and_selection(spark):
    kind = "ord int, source string, external_id string, published_at timestamp"
    stored = spark.createDataFrame([(0, "a", "1", datetime(2024, 6, 1))], kind)
    batch = spark.createDataFrame([(1, "a", "1", None), (2, "a", "2", datetime(2024, 6, 29)), (3, "a", "2", datetime(2024, 6, 29)), (4, "b", "9", datetime(2024, 6, 29)), (5, "a", "3", datetime(2024, 5, 1)), (6, "a", "4", None)], kind)
    assert sorted(r.ord for r in S.new_items(batch, stored).collect()) == [2, 4, 5, 6]
    assert [r.ord for r in S.known(batch, stored).collect()] == [1]
    chosen = [r.ord for r in S.select_for_analysis(batch, stored, now()).collect()]
    assert chosen == [2, 6]  # b is seeded, 5 is too old, an unknown date comes last
    assert [r.ord for r in S.select_for_analysis(batch, stored, now(), force=True).collect()] == [2, 4, 6]
    assert S.new_items(batch.limit(0), stored).count() == 0


def test_refresh_tiers_and_budget(spark):
    meta = spark.createDataFrame(
        [("hot5", "h", datetime(2024, 6, 25), datetime(2024, 6, 28)), ("cold5", "h", datetime(2024, 6, 25), None), ("cold45", "h", datetime(2024, 5, 16), None), ("empty", "", datetime(2024, 6, 29), None)],
        "url string, content_hash string, fetched_at timestamp, last_used_at timestamp",
    )
    found = meta.select("url").union(spark.createDataFrame([(f"new{i}",) for i in range(5)], "url string"))
    plan = {r.url: (r.wanted, r.planned) for r in C.plan_refresh(found, meta, now(), budget=3).collect()}
    assert set(plan) == {"hot5", "cold45", "empty", *(f"new{i}" for i in range(5))}
    assert [u for u, (_, p) in sorted(plan.items()) if p] == ["new0", "new1", "new2"]


def test_retirement_and_upsert(spark):
    meta = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0), ("d", 0)], "url string, missing_streak int")
    found = spark.createDataFrame([("a", ["crawl"])], "url string, sources array<string>")
    gone = spark.createDataFrame([("d",)], "url string")
    books = {r.url: (r.streak, r.retire) for r in C.bookkeeping(meta, found, gone).collect()}
    assert books == {"a": (0, False), "b": (2, True), "c": (1, False), "d": (1, True)}
    t = datetime(2024, 1, 1)
    stored = spark.createDataFrame([("a", "old", "h1", t, t, t, t), ("b", "old", "h1", t, t, None, None)], "url string, title string, content_hash string, fetched_at timestamp, changed_at timestamp, last_used_at timestamp, retired_at timestamp")
    new = spark.createDataFrame([("a", "new", "h1", None), ("b", "new", "h2", None)], "url string, title string, content_hash string, last_used_at timestamp")
    got = {r.url: r for r in C.upsert(stored, new, now()).collect()}
    assert got["a"].changed_at == t and got["a"].retired_at is None and got["a"].last_used_at == t and got["b"].changed_at != t


def test_discoveries(spark):
    rows = spark.createDataFrame([("u", "docs", "crawl"), ("u", "marketing", "sitemap"), ("v", "docs", "llms"), ("u", "docs", "crawl")], "url string, kind string, source string")
    got = {r.url: (r.kind, r.sources) for r in C.merge_discoveries(rows).collect()}
    assert got == {"u": ("marketing", ["sitemap", "crawl"]), "v": ("docs", ["llms"])}


def test_rules(spark):
    f = lambda x, g: spark.range(1).select(g(F.lit(x)).alias("y")).first().y
    assert f("Announcing it", Q.impact) == "major" and f("now faster", Q.impact) == "notable" and f("x", Q.impact) == "minor"
    assert f("Set: what does it do?", Q.is_question) and not f("It works?", Q.is_question) and not f("What", Q.is_question)
    assert [f(x, Q.copy_fault) for x in ("", "short", "Add a line about billing for all of the regions", "x" * 40 + " [fill this in]", "| a | b |", "A sentence that is long enough to be pasted.")] == ["missing", "too_short", "instruction", "placeholder", None, None]
    assert f("acme has no way to do it", lambda x: Q.claims_gap(x, "acme")) and not f("acme can", lambda x: Q.claims_gap(x, "acme"))
    assert f("the them thes others", lambda x: needle_counts(x, ["the"])[0]) == 2


def test_quotes_and_causes(spark):
    body = "nothing here but the volume can be restored from a snapshot at any time"
    pages = spark.createDataFrame([("d", "docs", body), ("m", "marketing", body)], "url string, kind string, body string")
    quote = "The volume can be restored from a snapshot"
    actions = spark.createDataFrame(
        [(1, "g", "d", quote), (2, None, "d", quote), (3, "g", None, quote), (4, "g", "x", quote), (5, "g", "m", quote), (6, "g", "d", None), (7, "g", "d", "Something else that is not there")], "id int, gap string, evidence_url string, quote string"
    )
    got = {r.id: r.cause for r in G.evidence_cause(actions, pages).collect()}
    assert got == {1: None, 2: "no_gap", 3: "no_evidence", 4: "not_in_corpus", 5: "not_docs", 6: "no_quote", 7: "quote_missing"}


def test_feed_and_sections(spark):
    rss = "<rss><channel><item><title>A</title></item><item><description>no title or link</description></item></channel></rss>"
    rows = spark.createDataFrame([(1, rss), (2, "not xml"), (3, None)], "k int, x string")
    got = feeds.items(feeds.entries(rows, "k", F.col("x")), "k").collect()
    assert [(r.k, r.title) for r in got] == [(1, "A")] and len(got[0].external_id) == 40
    text = "# First\nhttps://ex.com/a\nbody\n# Second\nhttps://ex.com/b\nmore"
    pages = feeds.full_pages(spark.createDataFrame([(1, text)], "k int, t string"), "k", F.col("t")).orderBy("section").collect()
    assert [(p.url, p.title) for p in pages] == [("https://ex.com/a", "First"), ("https://ex.com/b", "Second")]
    sites = feeds.sitemap(spark.createDataFrame([(1, "<urlset><url><loc>https://ex.com/a/b</loc><lastmod>2024-01-02</lastmod></url></urlset>"), (2, "<sitemapindex><sitemap><loc>s</loc></sitemap></sitemapindex>")], "k int, x string"), "k", F.col("x"))
    assert sorted((r.url, r.child) for r in sites.collect()) == [("https://ex.com/a/b", False), ("s", True)]


def test_cycle_twice_changes_nothing(spark, tmp_path):
    kind = "ord int, source string, external_id string, title string, url string, published_at timestamp, raw string"
    row = lambda i, d: (i, "a", str(i), f"Announcing {i}", "u", d, "{}")
    store, sent = Store(spark, str(tmp_path)), []
    post = lambda m: sent.append(m["id"]) or True
    first = cycle.run(store, spark.createDataFrame([row(0, datetime(2024, 6, 1))], kind), "2024-06-28 00:00:00", "2024-06-28", post)
    assert (first.new_items, first.analysed, sent) == (1, 0, [])  # a new source is seeded
    batch = spark.createDataFrame([row(0, datetime(2024, 6, 1)), row(1, datetime(2024, 6, 29))], kind)
    second = cycle.run(store, batch, "2024-06-29 00:00:00", "2024-06-29", post)
    assert (second.new_items, second.analysed, second.posted) == (1, 1, 1)
    third = cycle.run(store, batch, "2024-06-30 00:00:00", "2024-06-30", post)
    assert (third.new_items, third.analysed, third.posted, third.quiet) == (0, 0, 0, True)
    assert not cycle.run(store, batch, "2024-06-30 01:00:00", "2024-06-30", post).quiet
    assert store.read("items").count() == 2 and len(sent) == 2


def test_store_variants(spark, tmp_path):
    dry = Store(spark, str(tmp_path / "dry"), write=False)
    assert dry.claim_day("2024-01-01", now()) and dry.claim_day("2024-01-01", now()) and dry.read("days").count() == 0
    live = Store(spark, str(tmp_path / "live"))
    assert live.claim_day("2024-01-01", now()) and not live.claim_day("2024-01-01", now())

    def broken():
        raise ConnectionError

    fell = with_fallback(broken, lambda: live, lambda e: isinstance(e, ConnectionError))
    assert fell.fell_back and fell.root == live.root
    with pytest.raises(ConnectionError):
        with_fallback(broken, lambda: live, lambda e: False)
    box = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, payload string")

    def post(m):
        if m["id"] == "a":
            raise RuntimeError
        return True

    assert deliver(box, post) == ["b"]
