"""Queries of signals and corpus state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import corpus as C
from ..operators import signals as S
from ..operators.state import Issues, MemoryStore, Store, item_id, post_stream, with_fallback, write_artifact
from ..sources.fetch import is_gone
from ..storage import work_dir
from .base import table
from .scalars import SQL_URLS, _slug

NOW, CUT = "2024-01-31 00:00:00", "2024-01-20 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _items(spark, sf_dir):
    """events as signals: the type is the source, the external id is made from the event's. Purchases count as a source without stored rows."""
    e = table(spark, sf_dir, "events")
    items = e.select(F.col("event_id").alias("ord"), F.col("event_type").alias("source"), (F.col("event_id") * 7 % 5003).alias("external_id"), F.col("ts").alias("published_at"), "props", "value")
    old = F.col("published_at") < F.lit(CUT).cast("timestamp")
    return items.where(~old), items.where(old & (F.col("source") != "purchase"))


def dedupe_insert(spark, sf_dir):
    new, stored = _items(spark, sf_dir)
    return S.new_items(new, stored).select("source", "external_id", "ord")


def known_keys(spark, sf_dir):
    new, stored = _items(spark, sf_dir)
    return S.known(new, stored).select("source", "external_id", "ord")


def count_by_source(spark, sf_dir):
    return S.count_by_source(_items(spark, sf_dir)[1])


def item_lookup(spark, sf_dir):
    """The ids of stored items, looked up by every signal's key; null for those that aren't stored."""
    new, stored = _items(spark, sf_dir)
    ids = stored.groupBy(*S.KEY).agg(F.min("ord").alias("first")).select(*S.KEY, item_id(F.col("source"), F.col("external_id").cast("string")).alias("id"))
    return new.select("ord", *S.KEY).join(ids, list(S.KEY), "left").select("ord", "id")


def lookback(spark, sf_dir):
    new, stored = _items(spark, sf_dir)
    every = new.unionByName(stored).withColumn("published_at", F.when(F.col("ord") % 7 != 0, F.col("published_at")))
    return every.where(S.within_lookback(F.col("published_at"), _now())).select("ord")


def select_for_analysis(spark, sf_dir):
    new, stored = _items(spark, sf_dir)
    return S.select_for_analysis(new, stored, _now()).select("ord", "source", "external_id", "place")


def pending_retry(spark, sf_dir):
    """Open orders as analyses that wait; one of seven can't be read."""
    o = table(spark, sf_dir, "orders")
    payload = F.when(F.col("o_orderkey") % 7 == 0, "{broken").otherwise('{"summary": "x"}')
    a = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("item_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("posted_at"), F.col("o_orderdate").alias("created_at"), payload.alias("analysis"))
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("title"))
    return S.pending(a, items, F.lit("1997-01-01").cast("timestamp"), 25, F.get_json_object("analysis", "$.summary").isNotNull()).select("id", "item_id", "title")


def schedule_day(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(S.schedule_day(F.col("ts")).cast("string").alias("day")).agg(F.count("*").alias("n"))


def quiet_day(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.groupBy(S.schedule_day(F.col("ts")).alias("day")).agg(
        F.sum((F.col("event_id") % 5000 == 7).cast("int")).alias("alerts"), F.sum((F.col("event_id") % 4000 == 0).cast("int")).alias("new_items"), F.countDistinct("event_type").alias("sources_read")
    )
    claimed = runs.where(F.dayofmonth("day") % 5 == 0).select("day")
    return S.quiet_days(runs, claimed).select(F.col("day").cast("string").alias("day"), "sources_read")


def _found(spark, sf_dir):
    """Every page as found by one source or several: by its id, and those that no other source has in a list."""
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    part = lambda keep, name, kind: p.where(keep).select(U.canonical(F.col("url")).alias("url"), F.lit(name).alias("source"), F.lit(kind).alias("kind"))
    listed = part((i % 3 != 0) & (i % 2 != 0) & (i % 5 != 0), "llms", "docs")
    return C.merge_discoveries(part(i % 3 == 0, "crawl", "marketing").unionByName(part(i % 2 == 0, "sitemap", "docs")).unionByName(part(i % 5 == 0, "changelog", "changelog")).unionByName(listed))


def merge_discoveries(spark, sf_dir):
    return _found(spark, sf_dir).select("url", "kind", F.array_join("sources", ",").alias("sources"))


def _meta(spark, sf_dir):
    """Stored pages, made from the first of each canonical url: three of four are stored already (the others are new), and each has an older page
    beside it that is found no more. Hashes, ages and streaks follow from the page id."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id"), U.canonical(F.col("url")).alias("url")).groupBy("url").agg(F.min("page_id").alias("id"))
    p = p.where("id % 4 <> 0").unionByName(p.select(F.concat("url", F.lit("/old")).alias("url"), "id"))
    day = lambda n: F.timestamp_micros(F.unix_micros(_now()) - n * 86_400_000_000)
    return p.select(
        "url",
        "id",
        F.concat(F.lit("Page "), F.col("id")).alias("title"),
        F.when(F.col("id") % 11 == 0, "").otherwise(F.concat(F.lit("h"), F.col("id") % 3)).alias("content_hash"),
        day(F.col("id") % 20).alias("fetched_at"),
        day(F.col("id") % 30).alias("changed_at"),
        F.when(F.col("id") % 3 == 0, day(F.col("id") % 6)).alias("last_used_at"),
        (F.col("id") % 3).cast("int").alias("missing_streak"),
        F.array(F.lit("catalog")).alias("discovered_from"),
        F.when(F.col("id") % 13 == 0, day(F.lit(2))).alias("retired_at"),
    )


def plan_refresh(spark, sf_dir):
    return C.plan_refresh(_found(spark, sf_dir), _meta(spark, sf_dir), _now(), 60)


def refresh_summary(spark, sf_dir):
    return C.refresh_summary(plan_refresh(spark, sf_dir))


def _books(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    return C.bookkeeping(meta, _found(spark, sf_dir), meta.where("id % 17 = 0"))


def plan_bookkeeping(spark, sf_dir):
    return _books(spark, sf_dir).select("url", "seen", "streak", F.array_join("sources", ",").alias("sources"), "retire")


def record_corpus_run(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    out = C.record_run(meta, _books(spark, sf_dir), meta.where("id % 10 = 1"), _now())
    return out.select("url", "missing_streak", F.array_join("discovered_from", ",").alias("discovered_from"), F.col("retired_at").cast("string").alias("retired_at"), F.col("last_used_at").cast("string").alias("last_used_at"))


def _read(spark, sf_dir):
    return _found(spark, sf_dir).where("kind = 'docs'").select("url", F.concat(F.lit("New "), "url").alias("title"), F.lit("h1").alias("content_hash"))


def merge_corpus(spark, sf_dir):
    return C.merge_corpus(_meta(spark, sf_dir).select("url", "title", "content_hash", "retired_at"), _read(spark, sf_dir))


def page_upsert(spark, sf_dir):
    pages = _read(spark, sf_dir).withColumn("last_used_at", F.lit(None).cast("timestamp"))
    out = C.upsert(_meta(spark, sf_dir), pages, _now())
    return out.select("url", "title", "content_hash", *[F.col(c).cast("string").alias(c) for c in ("fetched_at", "changed_at", "last_used_at", "retired_at")])


def replace_claims(spark, sf_dir):
    meta = _meta(spark, sf_dir)
    stored = meta.select("url", F.explode(F.sequence(F.lit(1), F.col("missing_streak") + 1)).alias("n")).select("url", F.concat(F.lit("old "), "n").alias("claim"))
    read = _read(spark, sf_dir)
    return C.replace_by_url(stored, read, read.select("url", F.lit("new").alias("claim")))


def live_corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), F.col("lang").alias("kind"), F.when(F.col("doc_id") % 9 == 0, _now()).alias("retired_at"))
    return C.live(d, ["en", "de"]).select("url", "kind")


def _paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", U.section(F.col("url")).alias("section"), T.slug(U.title(F.col("url")), 80).alias("slug"))
    return p, C.workspace_paths(p.withColumnRenamed("page_id", "url"))


def workspace_paths(spark, sf_dir):
    return _paths(spark, sf_dir)[1].withColumnRenamed("url", "page_id")


def toc(spark, sf_dir):
    p, paths = _paths(spark, sf_dir)
    return C.contents(paths.join(p.select(F.col("page_id").alias("url"), "section"), "url"))


def _corpus_pages(spark, sf_dir):
    """documents as stored pages, some written before columns were added."""
    i = F.col("doc_id")
    none = lambda k, c: F.when(i % k != 0, c)
    return table(spark, sf_dir, "documents").where("doc_id is not null").select(
        F.concat(F.lit("https://docs.example.com/"), "source", F.lit("/"), F.col("doc_id")).alias("url"), none(3, F.substring_index("text", "\n", 1)).alias("title"), none(50, F.col("text")).alias("text"),
        none(5, F.array(F.col("lang"))).alias("mentions"), none(7, F.when(i % 2 == 0, "marketing").otherwise("changelog")).alias("kind"), none(4, F.concat(F.lit("h"), i.cast("string"))).alias("content_hash"),
        none(11, F.timestamp_seconds(1_700_000_000 + i * 86_400)).alias("fetched_at"), none(2, F.timestamp_seconds(1_600_000_000 + i * 86_400)).alias("changed_at"), none(9, F.array(F.lit("crawl"))).alias("discovered_from"),
        none(8, (i % 3).cast("int")).alias("missing_streak"), "source", "doc_id",
    )


def page_defaults(spark, sf_dir):
    p = C.with_defaults(_corpus_pages(spark, sf_dir))
    at = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return p.select("doc_id", "title", F.char_length("text").cast("long").alias("n_text"), F.size("mentions").cast("long").alias("n_mentions"), "kind", "content_hash", at("fetched_at"), at("changed_at"), F.size("discovered_from").cast("long").alias("n_sources"), "missing_streak")


def page_meta(spark, sf_dir):
    m = C.page_meta(_corpus_pages(spark, sf_dir))
    assert "text" not in m.columns and "mentions" not in m.columns
    return m.select("url", "title", "kind", "content_hash")


def pages_by_url(spark, sf_dir):
    """Every page of a list, in the order of the list: each tenth document's, the last first."""
    regions = [r[0] for r in table(spark, sf_dir, "region").select("r_regionkey").collect()]
    ids = sorted({10 * k + r for k in range(21) for r in regions}, reverse=True)
    pages = _corpus_pages(spark, sf_dir).withColumn("url", F.col("doc_id").cast("string"))
    return C.pages_by_url(pages, [str(i) for i in ids] + ["none"]).select("url", "kind", "place")


def gone_pages(spark, sf_dir):
    """Pages as a server answers for them: which are gone for good."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", is_gone(F.element_at(F.array(*map(F.lit, (200, 404, 410, 500, 0))), (F.col("page_id") % 5 + 1).cast("int"))).alias("gone"))


def workspace_files(spark, sf_dir):
    p = C.with_defaults(_corpus_pages(spark, sf_dir)).withColumn("section", U.section(F.col("url"))).withColumn("slug", T.slug(F.concat(F.lit("p "), (F.col("doc_id") % 40).cast("string")), 80))
    files = C.write_workspace(p, f"{work_dir(spark)}/workspace-{uuid.uuid4().hex}")
    return files.select("path", F.sha1("content").alias("digest"))


def store_roundtrip(spark, sf_dir):
    """A day of events into a store, in two batches that overlap, as it reads afterwards; what the dry run of a third batch would add is not in it."""
    return _stored(Store(spark, f"{work_dir(spark)}/store-{uuid.uuid4().hex}"), spark, sf_dir)


def memory_store(spark, sf_dir):
    return _stored(MemoryStore(spark), spark, sf_dir)


def _stored(store, spark, sf_dir):
    e = table(spark, sf_dir, "events").where("ts < timestamp '2024-01-04 00:00:00'")
    none = F.lit(None).cast("string")
    items = e.select(F.col("event_id").alias("ord"), F.col("event_type").alias("source"), (F.col("event_id") * 7 % 503).cast("string").alias("external_id"), F.lit("t").alias("title"), none.alias("url"), F.col("ts").alias("published_at"), none.alias("raw"))
    store.insert_new(items.where("published_at < timestamp '2024-01-03 00:00:00'"))
    store.insert_new(items.where("published_at >= timestamp '2024-01-02 00:00:00'"))
    store.vacuum("items") if store.root else None
    return store.read("items").select("id", "source", "external_id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


def dry_run(spark, sf_dir):
    """What a run would add to an empty store that it may not write."""
    store = Store(spark, f"{work_dir(spark)}/dry-{uuid.uuid4().hex}", write=False)
    e = table(spark, sf_dir, "events").where("ts >= timestamp '2024-01-30 00:00:00'").select(F.col("event_id").alias("ord"), F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("external_id"))
    return store.insert_new(e).select("id", "source", "external_id")


def issue_tables(spark, sf_dir):
    """Issues of every region: opened, some with labels that are refused, then changed, commented on or closed."""

    def check(labels):
        if any(x.endswith("1") for x in labels):
            raise ValueError(labels)

    store = Store(spark, f"{work_dir(spark)}/issues-{uuid.uuid4().hex}")
    issues = Issues(store, check)
    k = F.col("key")
    drafts = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("title"), F.lit("body").alias("body"), F.array(F.concat(F.lit("label-"), F.col("r_regionkey").cast("string"))).alias("labels"))
    new = issues.create_all(drafts, "key")
    issues.comment_all(new.where(k % 2 == 0).select("number", F.lit("seen").alias("body")))
    issues.update_all(new.where(k % 2 == 1).select("number", F.lit("closed").alias("state"), F.lit("not_planned").alias("reason"), F.array(F.lit("done")).alias("labels")))
    return store.read("issues").select("number", "title", F.array_join("labels", ",").alias("labels"), "state", "reason")


def bucket_changes(spark, sf_dir):
    """Every page stored, then a hundredth of them read again half of them with another text: the table as it is after."""
    store = Store(spark, f"{work_dir(spark)}/buckets-{uuid.uuid4().hex}")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("url", F.lit("")), F.lit("/"), F.col("page_id")).alias("url"), F.lit("t").alias("title"))
    first, again = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-09 00:00:00").cast("timestamp")
    store.save_pages(p.withColumn("content_hash", F.lit("h")), first)
    store.save_pages(p.where("page_id % 100 = 7").withColumn("content_hash", F.when(F.col("page_id") % 200 == 7, "new").otherwise("h")), again)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return store.read("pages").select("url", "content_hash", day("fetched_at"), day("changed_at"))


def outbox(spark, sf_dir):
    """Conversations' first turns as messages in a stream, some twice, posted in two batches, of which the second has the first's messages too: each once."""
    root = f"{work_dir(spark)}/outbox-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "conversations").where("turn = 0").select(F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("id"), F.lit("{}").alias("payload"))
    store, posted = Store(spark, f"{root}/store"), []
    post = lambda m: posted.append(m["id"]) or not m["id"].endswith("3")
    for part in (c.where("id < 'm5'").unionByName(c.where("id < 'm2'")), c):
        part.write.mode("append").parquet(f"{root}/in")
        post_stream(spark.readStream.schema("id string, payload string").parquet(f"{root}/in"), store, post, f"{root}/checkpoint")
    times = spark.createDataFrame([(i,) for i in posted], "id string").groupBy("id").agg(F.count("*").alias("posted"))
    return store.read("sent").join(times, "id", "left").select("id", "state", "posted")


def fallback_store(spark, sf_dir):
    """A day of events into a store that can't be reached from the second batch on, and then in memory: what the memory has, which knows
    nothing of the first batch."""

    class Lost(Store):
        calls = 0

        def append(self, name, df):
            self.calls += 1
            if self.calls > 1:
                raise ConnectionError(name)
            super().append(name, df)

    store = with_fallback(lambda: Lost(spark, f"{work_dir(spark)}/lost-{uuid.uuid4().hex}"), lambda: MemoryStore(spark), lambda e: isinstance(e, ConnectionError))
    return _stored(store, spark, sf_dir)


def posted_analyses(spark, sf_dir):
    """Orders as analyses of customers, of which those of a status are marked as posted by bucket; then what waits, oldest first."""
    store = Store(spark, f"{work_dir(spark)}/posted-{uuid.uuid4().hex}")
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    store.record(o.select(key.alias("id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("item_id"), F.lit("{}").alias("analysis"), F.lit(None).cast("timestamp").alias("posted_at"), F.col("o_orderdate").cast("timestamp").alias("created_at")))
    c = table(spark, sf_dir, "customer")
    store.append("items", c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.lit("s").alias("source"), F.col("c_custkey").cast("string").alias("external_id"), F.col("c_name").alias("title")))
    store.mark_posted(o.where("o_orderstatus <> 'O'").select(key.alias("id")), _now())
    waiting = store.unposted(F.lit("1996-06-01").cast("timestamp"), 40)
    return waiting.select("id", "item_id", "title", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))


def claimed_days(spark, sf_dir):
    """The first days of events, claimed one after another, each twice."""
    store = Store(spark, f"{work_dir(spark)}/days-{uuid.uuid4().hex}")
    days = [str(r[0]) for r in table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).count().orderBy("day").select("day").limit(4).collect()]
    got = [(d, store.claim_day(d, _now()), store.claim_day(d, _now())) for d in days]
    return spark.createDataFrame(got, "day string, first boolean, again boolean").join(store.read("days").select(F.col("day").cast("string").alias("day")), "day")


def cycle_summary(spark, sf_dir):
    """Events as two daily batches that overlap, each run twice: what every run says of itself."""
    from .cycle import run

    root = f"{work_dir(spark)}/cycle-{uuid.uuid4().hex}"
    store = Store(spark, root)
    none = F.lit(None).cast("string")
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(i.alias("ord"), F.col("event_type").alias("source"), i.cast("string").alias("external_id"), F.lit("t").alias("title"), none.alias("url"), F.col("ts").alias("published_at"), F.lit('{"body": "It is new."}').alias("raw"))
    day = lambda n: F.date_trunc("day", "published_at") == F.lit(f"2024-01-{n:02d}").cast("timestamp")
    out = []
    for n, (batch, at) in enumerate([(e.where(day(3)), 4), (e.where(day(3)), 4), (e.where(day(3) | day(4)), 5), (e.where(day(3) | day(4)), 5)]):
        s = run(store, batch, f"2024-01-{at:02d} 0{n}:00:00", f"2024-01-{at:02d}", lambda m: True)
        out.append((n, s.candidates, s.new_items, s.analysed, s.retried, s.posted, s.quiet))
    return spark.createDataFrame(out, "run int, candidates long, new_items long, analysed long, retried long, posted long, quiet boolean")


def run_artifact(spark, sf_dir):
    """Each nation's message as a text to look at, with its payload."""
    path = f"{work_dir(spark)}/artifact-{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"), F.to_json(F.struct("n_name")).alias("payload"))
    write_artifact(n, path, F.lit("Made by rules."))
    return spark.read.parquet(path).select("id", F.sha1("value").alias("digest"))


def heuristic_analysis(spark, sf_dir):
    """Documents as signals, restated by rules."""
    from .cycle import heuristic

    i = F.col("doc_id")
    raw = F.to_json(F.struct(F.when(i % 3 == 0, F.concat(F.lit("Summary: It is "), i.cast("string"), F.lit(". Now faster. More."))).alias("description"), F.when(i % 3 != 2, F.lit("The body. Second one here. Third one.")).alias("body")))
    refs = F.slice(F.array(*[F.struct(F.concat(F.lit(f"https://e{k}.example/"), i.cast("string")).alias("url"), F.lit("claim").alias("claim")) for k in range(3)]), F.lit(1), (i % 4).cast("int"))
    a = heuristic(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(i % 4 == 1, "Announcing ").when(i % 4 == 2, "Faster ").otherwise(""), F.lit("Signal "), i.cast("string")).alias("title"), raw.alias("raw")), F.lit("Acme"), refs)
    get = lambda path: F.get_json_object("analysis", path)
    return a.select("doc_id", get("$.impact").alias("impact"), get("$.summary").alias("summary"), F.array_join(F.from_json(get("$.key_points"), "array<string>"), "|").alias("points"), get("$.no_action.kind").alias("kind"), F.size(F.from_json(get("$.open_questions"), "array<string>")).cast("long").alias("n_questions"))


def stream_dedupe(spark, sf_dir):
    from ..streaming.ingest import dedupe_stream

    return dedupe_stream(spark, sf_dir).select("source", "external_id", "ord")


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_insert, known_keys, count_by_source, item_lookup, lookback, select_for_analysis, pending_retry, schedule_day, quiet_day, merge_discoveries, plan_refresh, refresh_summary, plan_bookkeeping,
        record_corpus_run, merge_corpus, page_upsert, replace_claims, live_corpus, page_defaults, page_meta, pages_by_url, gone_pages, workspace_paths, workspace_files, toc, store_roundtrip, memory_store, dry_run,
        issue_tables, bucket_changes, outbox, fallback_store, posted_analyses, claimed_days, cycle_summary, run_artifact, heuristic_analysis, stream_dedupe,
    )
}

_ITEMS = f"""items AS (SELECT event_id AS ord, event_type AS source, event_id * 7 % 5003 AS external_id, ts AS published_at, value FROM events),
new AS (SELECT * FROM items WHERE published_at >= TIMESTAMP '{CUT}'),
stored AS (SELECT * FROM items WHERE published_at < TIMESTAMP '{CUT}' AND source <> 'purchase'),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY ord) AS k FROM new) n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.source = n.source AND s.external_id = n.external_id))"""
_DAY = "CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS DATE)"
_FOUND = f"""{SQL_URLS},
disc AS (SELECT canonical AS url, 'crawl' AS source, 3 AS o, 'marketing' AS kind FROM u WHERE page_id % 3 = 0 UNION ALL SELECT canonical, 'sitemap', 1, 'docs' FROM u WHERE page_id % 2 = 0
  UNION ALL SELECT canonical, 'changelog', 5, 'changelog' FROM u WHERE page_id % 5 = 0 UNION ALL SELECT canonical, 'llms', 2, 'docs' FROM u WHERE page_id % 3 <> 0 AND page_id % 2 <> 0 AND page_id % 5 <> 0),
found AS (SELECT url, arg_min(kind, o) AS kind, array_to_string(list_transform(list_sort(list_distinct(list((o, source)))), lambda x: x[2]), ',') AS sources FROM disc GROUP BY url)"""
_N = f"TIMESTAMP '{NOW}'"
_META = f"""{_FOUND}, firsts AS (SELECT canonical AS url, min(page_id) AS id FROM u GROUP BY 1),
meta AS (SELECT url, id, 'Page ' || id AS title, CASE WHEN id % 11 = 0 THEN '' ELSE 'h' || (id % 3) END AS content_hash, {_N} - to_days((id % 20)::INTEGER) AS fetched_at, {_N} - to_days((id % 30)::INTEGER) AS changed_at,
  CASE WHEN id % 3 = 0 THEN {_N} - to_days((id % 6)::INTEGER) END AS last_used_at, (id % 3)::INTEGER AS missing_streak, 'catalog' AS discovered_from, CASE WHEN id % 13 = 0 THEN {_N} - to_days(2) END AS retired_at
  FROM (SELECT url, id FROM firsts WHERE id % 4 <> 0 UNION ALL SELECT url || '/old', id FROM firsts)),
books AS (SELECT m.url, f.url IS NOT NULL AS seen, (CASE WHEN f.url IS NOT NULL THEN 0 ELSE missing_streak + 1 END)::INTEGER AS streak, coalesce(f.sources, '') AS sources, id % 17 = 0 OR (f.url IS NULL AND missing_streak + 1 >= 2) AS retire
  FROM meta m LEFT JOIN found f USING (url)),
read AS (SELECT url, 'New ' || url AS title, 'h1' AS content_hash FROM found WHERE kind = 'docs')"""
_TS = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"
_PATHS = f"""{SQL_URLS}, t AS (SELECT page_id, coalesce(segs[1], nullif(authority, ''), 'other') AS section, authority, trim(regexp_replace(url_decode(coalesce(segs[-1], '')), '[-_]+', ' ', 'g')) AS t FROM u),
s AS (SELECT page_id, section, {_slug("(CASE WHEN t = '' THEN authority ELSE t END)", 80)} AS slug FROM t),
paths AS (SELECT page_id, section, section || '/' || slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS path FROM (SELECT *, row_number() OVER (PARTITION BY section, slug ORDER BY page_id) AS n FROM s))"""

_PAGES = """p AS (SELECT doc_id, source, 'https://docs.example.com/' || source || '/' || doc_id AS url, CASE WHEN doc_id % 3 <> 0 THEN string_split(text, chr(10))[1] END AS title, CASE WHEN doc_id % 50 <> 0 THEN text END AS text,
  CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'marketing' ELSE 'changelog' END END AS kind, CASE WHEN doc_id % 4 <> 0 THEN 'h' || doc_id END AS content_hash,
  CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1700000000 + doc_id * 86400) END AS fetched_at, CASE WHEN doc_id % 2 <> 0 THEN TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1600000000 + doc_id * 86400) END AS changed_at FROM documents)"""
_STORED = """WITH i AS (SELECT event_id, event_type AS source, (event_id * 7 % 503)::VARCHAR AS external_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-03 00:00:00' THEN 1 ELSE 2 END AS batch FROM events WHERE ts < TIMESTAMP '2024-01-04 00:00:00'),
f AS (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY batch, event_id) AS k FROM i)
SELECT sha1(source || '|' || external_id) AS id, source, external_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at FROM f WHERE k = 1"""

ORACLES = {
    "dedupe_insert": f"WITH {_ITEMS} SELECT source, external_id, ord FROM fresh",
    "stream_dedupe": "SELECT source, external_id, ord FROM (SELECT event_type AS source, user_id AS external_id, event_id AS ord, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k FROM events) WHERE k = 1",
    "known_keys": f"WITH {_ITEMS} SELECT source, external_id, ord FROM new n WHERE EXISTS (SELECT 1 FROM stored s WHERE s.source = n.source AND s.external_id = n.external_id)",
    "count_by_source": f"WITH {_ITEMS} SELECT source, count(*) AS n, count(DISTINCT external_id) AS n_keys FROM stored GROUP BY source",
    "lookback": f"WITH {_ITEMS} SELECT ord FROM (SELECT * FROM new UNION ALL SELECT * FROM stored) WHERE ord % 7 = 0 OR published_at >= {_N} - INTERVAL 7 DAY",
    "select_for_analysis": f"""WITH {_ITEMS}, ready AS (SELECT * FROM fresh WHERE source IN (SELECT source FROM stored) AND published_at >= {_N} - INTERVAL 7 DAY),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, ord)::INTEGER AS place FROM ready)
SELECT ord, source, external_id, place FROM p WHERE place <= 8 ORDER BY published_at DESC, ord LIMIT 12""",
    "pending_retry": "SELECT o_orderkey AS id, o_custkey AS item_id, c_name AS title FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND o_orderkey % 7 <> 0 AND o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 25",
    "schedule_day": f"SELECT {_DAY}::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1",
    "quiet_day": f"""WITH r AS (SELECT {_DAY} AS day, count(*) FILTER (event_id % 5000 = 7) AS alerts, count(*) FILTER (event_id % 4000 = 0) AS new_items, count(DISTINCT event_type) AS sources_read FROM events GROUP BY 1)
SELECT day::VARCHAR AS day, sources_read FROM r WHERE alerts = 0 AND new_items = 0 AND sources_read > 0 AND day(day) % 5 <> 0""",
    "merge_discoveries": f"WITH {_FOUND} SELECT url, kind, sources FROM found",
    "plan_refresh": f"""WITH {_META}, j AS (SELECT f.url, m.fetched_at, CASE WHEN m.url IS NULL THEN 'fresh' WHEN m.content_hash = '' OR {_N} - m.fetched_at > (CASE WHEN m.last_used_at >= {_N} - INTERVAL 3 DAY THEN INTERVAL 3 DAY ELSE INTERVAL 14 DAY END) THEN 'due' END AS wanted
  FROM found f LEFT JOIN meta m USING (url)), p AS (SELECT *, row_number() OVER (ORDER BY wanted = 'due', CASE WHEN wanted = 'due' THEN fetched_at END, url) AS k FROM j WHERE wanted IS NOT NULL)
SELECT url, wanted, k <= 60 AS planned FROM p""",
    "plan_bookkeeping": f"WITH {_META} SELECT * FROM books",
    "record_corpus_run": f"""WITH {_META}, r AS (SELECT m.url, b.streak AS missing_streak, b.sources AS discovered_from, CASE WHEN b.retire THEN coalesce(m.retired_at, {_N}) ELSE m.retired_at END AS retired_at, CASE WHEN id % 10 = 1 THEN {_N} ELSE m.last_used_at END AS last_used_at
  FROM meta m JOIN books b USING (url)) SELECT url, missing_streak, discovered_from, {_TS('retired_at')}, {_TS('last_used_at')} FROM r""",
    "merge_corpus": f"WITH {_META} SELECT url, title, content_hash FROM read UNION ALL SELECT url, title, content_hash FROM meta WHERE retired_at IS NULL AND url NOT IN (SELECT url FROM read)",
    "page_upsert": f"""WITH {_META}, r AS (SELECT coalesce(p.url, s.url) AS url, coalesce(p.title, s.title) AS title, coalesce(p.content_hash, s.content_hash) AS content_hash, CASE WHEN p.url IS NOT NULL THEN {_N} ELSE s.fetched_at END AS fetched_at,
  CASE WHEN p.url IS NULL OR s.content_hash = p.content_hash THEN s.changed_at ELSE {_N} END AS changed_at, s.last_used_at, CASE WHEN p.url IS NULL THEN s.retired_at END AS retired_at FROM meta s FULL JOIN read p ON s.url = p.url)
SELECT url, title, content_hash, {_TS('fetched_at')}, {_TS('changed_at')}, {_TS('last_used_at')}, {_TS('retired_at')} FROM r""",
    "replace_claims": f"WITH {_META} SELECT url, 'old ' || n AS claim FROM (SELECT url, unnest(range(1, missing_streak + 2)) AS n FROM meta) WHERE url NOT IN (SELECT url FROM read) UNION ALL SELECT url, 'new' FROM read",
    "live_corpus": "SELECT doc_id AS url, lang AS kind FROM documents WHERE doc_id % 9 <> 0 AND lang IN ('en', 'de')",
    "workspace_paths": f"WITH {_PATHS} SELECT page_id, path FROM paths",
    "toc": f"WITH {_PATHS} SELECT section, count(*) AS n_pages, min(path) AS first_path, max(path) AS last_path FROM paths GROUP BY section",
    "item_lookup": f"""WITH {_ITEMS} SELECT n.ord, CASE WHEN EXISTS (SELECT 1 FROM stored s WHERE s.source = n.source AND s.external_id = n.external_id) THEN sha1(n.source || '|' || n.external_id) END AS id FROM new n""",
    "refresh_summary": f"""SELECT count(*) FILTER (planned AND wanted = 'fresh')::BIGINT AS n_fresh, count(*) FILTER (planned AND wanted = 'due')::BIGINT AS n_due, count(*) FILTER (NOT planned)::BIGINT AS n_deferred FROM (WITH {_META}, j AS (SELECT f.url, m.fetched_at, CASE WHEN m.url IS NULL THEN 'fresh' WHEN m.content_hash = '' OR {_N} - m.fetched_at > (CASE WHEN m.last_used_at >= {_N} - INTERVAL 3 DAY THEN INTERVAL 3 DAY ELSE INTERVAL 14 DAY END) THEN 'due' END AS wanted
  FROM found f LEFT JOIN meta m USING (url)), p AS (SELECT *, row_number() OVER (ORDER BY wanted = 'due', CASE WHEN wanted = 'due' THEN fetched_at END, url) AS k FROM j WHERE wanted IS NOT NULL)
SELECT url, wanted, k <= 60 AS planned FROM p)""",
    "page_defaults": f"""WITH {_PAGES}, d AS (SELECT *, coalesce(fetched_at, TIMESTAMP '1970-01-01 00:00:00') AS seen FROM p) SELECT doc_id, coalesce(title, '') AS title, length(coalesce(text, ''))::BIGINT AS n_text, CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END::BIGINT AS n_mentions, coalesce(kind, 'docs') AS kind,
  coalesce(content_hash, '') AS content_hash, strftime(seen, '%Y-%m-%d') AS fetched_at, strftime(coalesce(changed_at, seen), '%Y-%m-%d') AS changed_at, CASE WHEN doc_id % 9 <> 0 THEN 1 ELSE 0 END::BIGINT AS n_sources, (CASE WHEN doc_id % 8 <> 0 THEN doc_id % 3 ELSE 0 END)::INTEGER AS missing_streak FROM d""",
    "page_meta": f"WITH {_PAGES} SELECT url, title, kind, content_hash FROM p",
    "pages_by_url": f"""WITH {_PAGES}, k AS (SELECT DISTINCT t.x * 10 + r_regionkey AS k FROM region, range(0, 21) t(x)), o AS (SELECT k, (row_number() OVER (ORDER BY k DESC) - 1)::INTEGER AS place FROM k)
SELECT doc_id::VARCHAR AS url, kind, place FROM p JOIN o ON k = doc_id""",
    "gone_pages": "SELECT page_id, page_id % 5 IN (1, 2) AS gone FROM pages",
    "workspace_files": f"""WITH {_PAGES}, d AS (SELECT *, coalesce(fetched_at, TIMESTAMP '1970-01-01 00:00:00') AS seen, coalesce(nullif(trim(title), ''), doc_id::VARCHAR) AS named, coalesce(kind, 'docs') AS k, 'p-' || (doc_id % 40) AS slug FROM p WHERE trim(coalesce(text, '')) <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY source, slug ORDER BY url) AS n, CASE WHEN fetched_at IS NULL THEN 'unknown' ELSE strftime(seen, '%Y-%m-%d') END AS read, CASE WHEN coalesce(changed_at, fetched_at) IS NULL THEN 'unknown' ELSE strftime(coalesce(changed_at, seen), '%Y-%m-%d') END AS changed,
  CASE k WHEN 'docs' THEN 'what the product does' WHEN 'marketing' THEN 'copy, never evidence of what the product does' ELSE 'what was shipped and when' END AS evidence FROM d)
SELECT source || '/' || slug || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS path, sha1(array_to_string(['---', 'url: ' || url, 'title: ' || named, 'kind: ' || k, 'evidence: ' || evidence, 'read: ' || read, 'last_changed: ' || changed, '---', '', '# ' || named, '', text, ''], chr(10))) AS digest FROM f""",
    "store_roundtrip": _STORED,
    "memory_store": _STORED,
    "dry_run": "SELECT 'dry-run-' || row_number() OVER (ORDER BY event_id) AS id, event_type AS source, user_id::VARCHAR AS external_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00') WHERE k = 1",
    "bucket_changes": """SELECT coalesce(url, '') || '/' || page_id AS url, CASE WHEN page_id % 200 = 7 THEN 'new' ELSE 'h' END AS content_hash, CASE WHEN page_id % 100 = 7 THEN '2024-01-09' ELSE '2024-01-01' END AS fetched_at,
  CASE WHEN page_id % 200 = 7 THEN '2024-01-09' ELSE '2024-01-01' END AS changed_at FROM pages""",
    "outbox": "SELECT DISTINCT 'm' || conv_id AS id, CASE WHEN conv_id % 10 = 3 THEN 'failed' ELSE 'sent' END AS state, 1::BIGINT AS posted FROM conversations WHERE turn = 0",
    "fallback_store": """WITH i AS (SELECT event_id, event_type AS source, (event_id * 7 % 503)::VARCHAR AS external_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-04 00:00:00'),
f AS (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY event_id) AS k FROM i)
SELECT sha1(source || '|' || external_id) AS id, source, external_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at FROM f WHERE k = 1""",
    "posted_analyses": """SELECT o_orderkey::VARCHAR AS id, 'c' || o_custkey AS item_id, c_name AS title, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-06-01' ORDER BY o_orderdate, o_orderkey::VARCHAR LIMIT 40""",
    "claimed_days": "SELECT DISTINCT ts::DATE::VARCHAR AS day, true AS first, false AS again FROM events ORDER BY day LIMIT 4",
    "cycle_summary": """WITH e AS (SELECT event_type AS source, ts::DATE AS day FROM events WHERE ts::DATE IN (DATE '2024-01-03', DATE '2024-01-04')), n AS (SELECT count(*) FILTER (day = DATE '2024-01-03') AS a, count(*) AS b FROM e),
c AS (SELECT least(12, sum(least(8, k)))::BIGINT AS k FROM (SELECT count(*) AS k FROM e WHERE day = DATE '2024-01-04' AND source IN (SELECT source FROM e WHERE day = DATE '2024-01-03') GROUP BY source))
SELECT 0::INTEGER AS run, a AS candidates, a AS new_items, 0::BIGINT AS analysed, 0::BIGINT AS retried, 0::BIGINT AS posted, false AS quiet FROM n UNION ALL SELECT 1, a, 0, 0, 0, 0, true FROM n
UNION ALL SELECT 2, b, b - a, k, 0, k, false FROM n, c UNION ALL SELECT 3, b, 0, 0, 0, 0, true FROM n""",
    "issue_tables": "SELECT (r_regionkey + 1)::BIGINT AS number, r_name AS title, CASE WHEN r_regionkey % 2 = 1 THEN 'done' WHEN r_regionkey % 10 = 1 THEN '' ELSE 'label-' || r_regionkey END AS labels, CASE WHEN r_regionkey % 2 = 1 THEN 'closed' ELSE 'open' END AS state, CASE WHEN r_regionkey % 2 = 1 THEN 'not_planned' END AS reason FROM region",
    "run_artifact": """SELECT n_nationkey::VARCHAR AS id, sha1('# Message ' || n_nationkey || chr(10) || chr(10) || 'Made by rules.' || chr(10) || chr(10) || '## As it is read' || chr(10) || chr(10) || n_name || chr(10) || chr(10) || '## Payload' || chr(10) || chr(10) || '```json' || chr(10) || '{"n_name":"' || n_name || '"}' || chr(10) || '```' || chr(10)) AS digest FROM nation""",
    "heuristic_analysis": """SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'major' WHEN 2 THEN 'notable' ELSE 'minor' END AS impact, CASE doc_id % 3 WHEN 0 THEN 'Acme: It is ' || doc_id || '.' WHEN 1 THEN 'Acme: The body.' ELSE 'Acme published "' || CASE doc_id % 4 WHEN 1 THEN 'Announcing ' WHEN 2 THEN 'Faster ' ELSE '' END || 'Signal ' || doc_id || '".' END AS summary,
  CASE doc_id % 3 WHEN 0 THEN 'Now faster.|More.' WHEN 1 THEN 'Second one here.' ELSE '' END AS points, 'unanalyzed' AS kind, least(2, doc_id % 4)::BIGINT AS n_questions FROM documents""",
}
