"""Stores that are lost, read only or in memory; issues; fetching; settings."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltflow import config
from siltflow.operators.state import Fallback, Issues, MemoryStore, Store
from siltflow.sources import feeds, fetch

ITEM = "ord int, source string, external_id string, title string, url string, published_at timestamp, raw string"


def batch(spark, *ids):
    return spark.createDataFrame([(k, "a", str(i), "t", "u", datetime(2024, 1, 1), "{}") for k, i in enumerate(ids)], ITEM)


class Lost(Store):
    """Answers some calls, then can't be reached."""

    left = 1

    def _state(self, name):
        Lost.left -= 1
        if Lost.left < 0:
            raise ConnectionError(name)
        return super()._state(name)


def test_fallback_from_the_first_failure_on(spark, tmp_path):
    unreachable = lambda e: isinstance(e, ConnectionError)
    store = Fallback(Lost(spark, str(tmp_path)), lambda: MemoryStore(spark), unreachable)
    assert store.count_items("a") == 0 and not store.fell_back
    assert store.insert_new(batch(spark, 1, 2)).count() == 2 and store.fell_back
    assert store.insert_new(batch(spark, 2, 3)).count() == 1 and store.count_items("a") == 3
    strict = Fallback(Lost(spark, str(tmp_path)), lambda: MemoryStore(spark), lambda e: False)
    with pytest.raises(ConnectionError):
        strict.count_items("a")


def test_inserts_append_and_vacuum_keeps_what_is_read(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.insert_new(batch(spark, 1, 2))
    store.insert_new(batch(spark, 2, 3))
    store.replace("items", store.read("items"))
    assert store.vacuum("items") == 2 and sorted(r.external_id for r in store.read("items").collect()) == ["1", "2", "3"]
    assert store.find_item("a", "1") and store.find_item("a", "9") is None and store.known_keys(batch(spark, 1, 9)).count() == 1


def test_read_only_store(spark, tmp_path):
    store = Store(spark, str(tmp_path), write=False)
    assert [r.id for r in store.insert_new(batch(spark, 1, 1, 2)).orderBy("ord").collect()] == ["dry-run-1", "dry-run-2"]
    assert store.read("items").count() == 0 and Issues(store).create("t", "b", []) is None and not Issues(store).comment(1, "x")


def test_issues(spark, tmp_path):
    def check(labels):
        if "bad" in labels:
            raise ValueError

    store = Store(spark, str(tmp_path))
    issues = Issues(store, check)
    assert issues.create("one", "b", ["bad"]) == 1 and issues.create("two", "b", ["good"]) == 2
    assert issues.update(1, title="new", labels=["bad"]) and issues.close(2, "not_planned", ["done"]) and not issues.update(None, title="x") and not issues.update(9, title="x")
    got = {r.number: (r.title, r.labels, r.state) for r in store.read("issues").collect()}
    assert got == {1: ("new", [], "open"), 2: ("two", ["done"], "closed")}


def test_memory_store_keeps_no_analyses(spark):
    store = MemoryStore(spark)
    store.record(spark.createDataFrame([("1", "2", "{}", None, None)], Store.TABLES["analyses"]))
    assert store.read("analyses").count() == 0 and store.claim_day("2024-01-01", F.current_timestamp()) and not store.claim_day("2024-01-01", F.current_timestamp())


def test_fetch_retries():
    asked, pauses = [], []

    def opener(url, method):
        asked.append(url)
        return (503, "", "") if len(asked) < 3 else (200, "text/html", "x")

    assert fetch.fetch("u", opener, sleep=pauses.append) == (200, "text/html", "x", 3) and pauses == [0.5, 1.0]
    assert fetch.fetch("u", lambda u, m: (404, "", ""), sleep=pauses.append) == (404, None, None, 1)

    def reset(url, method):
        raise OSError

    assert fetch.fetch("u", reset, sleep=lambda s: None) == (0, None, None, 3)


def test_a_source_that_fails_while_it_runs_costs_its_own_rows(spark):
    good = lambda: spark.createDataFrame([(1, "a")], "k long, s string")
    bad = lambda: good().select("k", F.raise_error(F.lit("lost")).cast("string").alias("s"))
    out, read, notes = feeds.collect(spark, {"good": good, "bad": bad}, "k long, s string")
    assert out.count() == 1 and read == 1 and len(notes) == 1 and notes[0].startswith("bad: ")


def test_settings():
    assert config.load({}) == config.Settings() and config.load({"DRY_RUN": " Yes ", "SITEMAPS": "a, ,b", "LOOKBACK_DAYS": "3"}) == config.Settings(dry_run=True, sitemaps=("a", "b"), lookback_days=3)
    with pytest.raises(config.Invalid):
        config.load({"LOOKBACK_DAYS": "x"})
    with pytest.raises(config.Invalid):
        config.load({"FORCE_ANALYZE": "1"})
    assert config.load({"FORCE_ANALYZE": "1", "DRY_RUN": "on"}).force_analyze
    report = config.check({"CHANNEL_TOKEN": "x"})
    assert [r.name for r in report.missing] == ["STORE_PATH", "CHANNEL_ID"] and [r.name for r in report.sources] == ["TIMELINE_TOKEN"] and report.failing
    dry = config.check({"DRY_RUN": "1", "CHANNEL_TOKEN": "x", "TIMELINE_TOKEN": "x", "GITHUB_TOKEN": "x"})
    assert not dry.failing and len(dry.warnings) == 1 and "ISSUES_TOKEN" in dry.present and "in memory" in str(dry)


def test_saved_answers_fail_as_often_as_told(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.example/1", "<p>x\ny", [0]), ("https://a.example/2", "\n{", [503, 503]), ("https://a.example/3", "z", [429] * 3), ("https://a.example/4", "w", None), ("https://b.example/5", "v", [0, 0, 0])], "url string, body string, fails array<int>")
    assert fetch.save(pages, f"{tmp_path}/answers") == 5
    own = {"opener": "siltflow.sources.fetch:saved_opener", "folder": f"{tmp_path}/answers", "pause": "none"}
    got = {r.url[-1]: (r.status, r.body, r.attempts) for r in fetch.fetch_all(pages, **own).collect()}
    assert got == {"1": (200, "<p>x\ny", 2), "2": (200, "\n{", 3), "3": (429, None, 3), "4": (200, "w", 1), "5": (0, None, 3)}
    kinds = {r.url[-1]: r.content_type for r in fetch.content_type(pages, **own).collect()}
    assert kinds == {"1": None, "2": None, "3": None, "4": "text/plain", "5": None}


def test_fetched_tries_again(spark):
    from collections import Counter

    from siltflow.plans import catalog

    seen = Counter((r.status, r.attempts) for r in catalog.QUERIES["fetched"](spark, "/root/testdata/sf0.001").collect())
    assert set(seen) == {(200, 1), (200, 2), (200, 3), (404, 1), (429, 3), (0, 3)}
