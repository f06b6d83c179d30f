"""Changes by bucket, messages that are posted once, issues in batches, the data source, and a refresh over a store."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from siltflow.operators import state as P
from siltflow.operators.state import Issues, Store, deliver_once, post_stream
from siltflow.sources import crawl, fetch
from siltflow.storage import numbered


def at(day):
    return F.lit(f"2024-01-{day:02d}").cast("timestamp")


def files(root, name):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/{name}/part-*/**/*.parquet", recursive=True)}


def pages(spark, rows):
    return spark.createDataFrame(rows, "url string, title string, content_hash string")


def test_a_change_of_a_hundredth_writes_its_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.save_pages(pages(spark, [(f"u{i}", "t", "h") for i in range(1000)]), at(1))
    before = files(tmp_path, "pages")
    store.save_pages(pages(spark, [(f"u{i}", "t2", "h" if i % 20 else "h2") for i in range(0, 1000, 100)]), at(2))
    new = files(tmp_path, "pages").keys() - before.keys()
    assert len(before) == P.BUCKETS and len(new) <= 10
    got = {r.url: (r.title, r.content_hash, r.fetched_at.day, r.changed_at.day) for r in store.read("pages").collect()}
    assert len(got) == 1000 and got["u0"] == ("t2", "h2", 2, 2) and got["u500"][0] == "t2" and got["u1"] == ("t", "h", 1, 1)
    # the folders that no state names go, and what is read stays
    store.vacuum("pages")
    assert len(files(tmp_path, "pages")) == P.BUCKETS and store.read("pages").count() == 1000


def test_appends_become_one_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "MOST_PARTS", 2)
    store = Store(spark, str(tmp_path))
    for i in range(4):
        store.append("sent", spark.createDataFrame([("a", str(i))], "id string, state string"))
    assert sorted(r.state for r in store.read("sent").collect()) == ["0", "1", "2", "3"]
    assert max(len(f) for f in store._state("sent")[1].values()) <= 2


def test_two_writers(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    number, buckets = one._state("sent")
    two.append("sent", spark.createDataFrame([("a", "x")], "id string, state string"))
    with pytest.raises(RuntimeError):
        one._commit("sent", number + 1, buckets)
    assert two.read("sent").count() == 1


def test_a_batch_that_runs_again_posts_nothing_twice(spark, tmp_path):
    store, sent = Store(spark, str(tmp_path)), []

    def post(m):
        if m["id"] == "c" and "c" not in sent:
            sent.append("c")
            raise KeyboardInterrupt  # the run is stopped
        sent.append(m["id"])
        return m["id"] != "b"

    messages = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("a", "1"), (None, "x")], "id string, payload string")
    with pytest.raises(KeyboardInterrupt):
        deliver_once(store, messages, post)
    assert deliver_once(store, messages, post) == {"sent": 0, "failed": 0, "skipped": 3}
    assert sent == ["a", "b", "c"]
    assert deliver_once(store, spark.createDataFrame([("d", "4"), ("b", "5")], "id string, payload string"), post) == {"sent": 1, "failed": 0, "skipped": 1}


def test_outbox_stream(spark, tmp_path):
    store, sent = Store(spark, f"{tmp_path}/s"), []
    for part in ([("a", "1"), ("b", "2")], [("b", "2"), ("c", "3")]):
        spark.createDataFrame(part, "id string, payload string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id string, payload string").parquet(f"{tmp_path}/in")
        last = post_stream(stream, store, lambda m: sent.append(m["id"]) or True, f"{tmp_path}/c")
    assert sent == ["a", "b", "c"] and last == {"sent": 1, "failed": 0, "skipped": 1}


def test_issues_in_batches(spark, tmp_path):
    def check(labels):
        if "bad" in labels:
            raise ValueError

    store = Store(spark, str(tmp_path))
    issues = Issues(store, check)
    assert issues.create("zero", "b", []) == 1
    drafts = spark.createDataFrame([(3, "c", "b", ["bad"]), (1, "a", "b", ["good"]), (2, "b", "b", None)], "k int, title string, body string, labels array<string>")
    assert {r.k: (r.number, r.labels) for r in issues.create_all(drafts, "k").collect()} == {1: (2, ["good"]), 2: (3, []), 3: (4, [])}
    patches = spark.createDataFrame([(2, "closed", ["bad"]), (3, None, ["fine"]), (9, "closed", None), (None, "closed", None)], "number long, state string, labels array<string>")
    assert issues.update_all(patches) == 2
    got = {r.number: (r.title, r.labels, r.state) for r in store.read("issues").collect()}
    assert got == {1: ("zero", [], "open"), 2: ("a", ["good"], "closed"), 3: ("b", ["fine"], "open"), 4: ("c", [], "open")}
    assert len(glob.glob(f"{tmp_path}/issues/part-*")) == 3 and store.read("issue_events").count() == 6


def test_numbers_run_through_all_partitions(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int").repartition(5)
    assert sorted(map(tuple, numbered(df, ["k"], "n").collect())) == [(k, k + 1) for k in range(101)] and numbered(df.limit(0), ["k"], "n").count() == 0


def test_data_source(spark, tmp_path):
    rows = spark.createDataFrame([("https://a.example/1", "<p>é</p>"), ("https://A.example/2", '{"k": 5}'), ("https://b.example/x", "[broken")], "url string, body string")
    assert fetch.save(rows, f"{tmp_path}/answers") == 3
    own = {"opener": "siltflow.sources.fetch:saved_opener", "folder": f"{tmp_path}/answers", "pause": "none"}
    asked = rows.select("url").unionByName(spark.createDataFrame([("https://a.example/none",), (None,)], "url string"))
    got = {r.url: (r.status, r.content_type, r.body, r.attempts) for r in fetch.fetch_all(asked, **own).collect()}
    assert got == {"https://a.example/1": (200, "text/html", "<p>é</p>", 1), "https://A.example/2": (200, "application/json", '{"k": 5}', 1), "https://b.example/x": (200, "application/json", "[broken", 1), "https://a.example/none": (404, None, None, 1), None: (0, None, None, 0)}
    told = {r.url: r.value for r in fetch.fetch_json(asked, "k int", **own).collect()}
    assert told["https://A.example/2"].k == 5 and told["https://b.example/x"] is None and told[None] is None
    # a host is one task's; an empty list has no answers
    parts = fetch.fetch_all(asked, files=8, **own).where("lower(url) like 'https://a.%'").select(F.spark_partition_id()).distinct().count()
    assert parts == 1 and fetch.fetch_all(asked.limit(0), **own).count() == 0


def test_pace_keeps_hosts_apart():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = fetch.Pace(2.0, lambda: now[0], sleep)
    for host in ("a", "a", "b", "a"):
        pace.wait(host)
    assert slept == [0.5, 0.5] and now[0] == 1.0
    fetch.Pace(0, lambda: 1 / 0, sleep).wait("a")


def test_network_errors_are_no_answers():
    ask = fetch.http_opener({"timeout": "0.2"})
    assert fetch.fetch("http://127.0.0.1:9/", ask, sleep=lambda s: None) == (0, None, None, 3)
    assert fetch.fetch("not an address", ask, sleep=lambda s: None)[0] == 0


def test_refresh_twice(spark, tmp_path):
    text = {"a": ["b", "c"], "b": ["d", "x"], "c": [], "d": ["a"], "x": None, "old": []}
    body = lambda u: f"Page {u}. Acme does more than this page says, and Other does less of it than one might think it does."
    served = spark.createDataFrame([(u, 404 if links is None else 200, links, u.upper(), body(u)) for u, links in text.items()], "url string, status int, links array<string>, title string, text string")
    read = lambda rows: rows.join(served, "url", "left").withColumn("status", F.coalesce("status", F.lit(0)))
    store = Store(spark, str(tmp_path))
    store.save_pages(pages(spark, [("old", "t", "h"), ("gone", "t", "h")]), at(1))
    found = spark.createDataFrame([("a", "docs", "sitemap")], "url string, kind string, source string")
    out = crawl.refresh(store, found, read, at(2), 10, 2, names={"other": ("other",)})
    assert {k: out[k] for k in ("discovered", "fetched", "changed", "gone", "retired", "claims")} == {"discovered": 5, "fetched": 4, "changed": 4, "gone": 1, "retired": 0, "claims": 4}
    held = {r.url: (r.kind, r.missing_streak, r.retired_at) for r in store.read("pages").collect()}
    assert held["d"][0] == "docs" and held["gone"][1] == 1 and set(held) == {"a", "b", "c", "d", "old", "gone"}
    # nothing is due the next day; what no source lists is retired after its second miss
    out = crawl.refresh(store, found, read, at(3), 10, 2)
    assert (out["fetched"], out["changed"], out["retired"]) == (0, 0, 2)


def test_budget_bounds_what_is_followed(spark):
    n = 30
    served = spark.createDataFrame([(f"p{i:02d}", 200, [f"p{j:02d}" for j in range(i + 1, min(n, i + 6))]) for i in range(n)], "url string, status int, links array<string>")
    meta = spark.createDataFrame([], "url string, content_hash string, fetched_at timestamp, last_used_at timestamp")
    found = spark.createDataFrame([("p00", "docs", "sitemap")], "url string, kind string, source string")
    answers, listed = crawl.crawl(found, meta, lambda rows: rows.join(served, "url", "left"), at(2), 8, 9)
    assert sorted((r.url, r.level) for r in answers.collect()) == [("p00", 0), *[(f"p0{i}", 1) for i in range(1, 6)], ("p06", 2), ("p07", 2)]
    assert {r.url: r.sources for r in listed.collect()}["p00"] == ["sitemap"]
