"""The page corpus: what was found, what to read next, and the bookkeeping of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..storage import written

#: What each kind of page is evidence of.
EVIDENCE = {"docs": "what the product does", "marketing": "copy, never evidence of what the product does", "changelog": "what was shipped and when"}
#: How a page can be found, most trusted first; ages in days after which pages are read again; missed runs before retirement.
SOURCES = ("sitemap", "llms", "crawl", "catalog", "changelog")
HOT_DAYS, HOT_AGE, COLD_AGE, BUDGET, MISSES = 3, 3, 14, 600, 2


def merge_discoveries(found: DataFrame) -> DataFrame:
    """(url, kind, sources) from (url, kind, source): one row a url, its sources in their fixed order, the kind of the first."""
    order = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    each = found.groupBy("url").agg(F.array_sort(F.collect_set(F.struct(order.alias("o"), F.col("source").alias("source")))).alias("s"), F.min(F.struct(order.alias("o"), F.col("kind").alias("kind"))).alias("k"))
    return each.select("url", F.col("k.kind").alias("kind"), F.col("s.source").alias("sources"))


def is_due(content_hash: Column, fetched_at: Column, last_used_at: Column, now: Column) -> Column:
    """Never read, or older than its tier allows: pages used lately are hot."""
    age = lambda t: F.unix_micros(now) - F.unix_micros(t)
    day = 86_400_000_000
    hot = F.coalesce(age(last_used_at) <= HOT_DAYS * day, F.lit(False))
    return (F.coalesce(content_hash, F.lit("")) == "") | F.coalesce(age(fetched_at) > F.when(hot, HOT_AGE * day).otherwise(COLD_AGE * day), F.lit(True))


def plan_refresh(found: DataFrame, meta: DataFrame, now: Column, budget: int = BUDGET) -> DataFrame:
    """(url, wanted, place, planned): found urls that are new, by url, then those due, longest unread first; planned within the budget."""
    joined = found.join(meta.select("url", "content_hash", "fetched_at", "last_used_at", F.lit(True).alias("held")), "url", "left")
    fresh = F.col("held").isNull()
    wanted = joined.withColumn("wanted", F.when(fresh, "fresh").when(is_due(F.col("content_hash"), F.col("fetched_at"), F.col("last_used_at"), now), "due")).where("wanted is not null")
    # the budget is a rank over all wanted urls: taken by a sorted limit, not a window over one partition
    first = [F.col("wanted") == "due", F.when(fresh, None).otherwise(F.col("fetched_at")), F.col("url")]
    kept = wanted.orderBy(*first).limit(budget).select("url", F.lit(True).alias("planned"))
    return wanted.join(kept, "url", "left").select("url", "wanted", F.coalesce("planned", F.lit(False)).alias("planned"))


def refresh_summary(plan: DataFrame) -> DataFrame:
    """(n_fresh, n_due, n_deferred) of plan_refresh(): what is read as new and as due, and what the budget leaves for later."""
    n = lambda test, name: F.coalesce(F.sum(test.cast("long")), F.lit(0)).alias(name)
    return plan.agg(n(F.col("planned") & (F.col("wanted") == "fresh"), "n_fresh"), n(F.col("planned") & (F.col("wanted") == "due"), "n_due"), n(~F.col("planned"), "n_deferred"))


def bookkeeping(meta: DataFrame, found: DataFrame, gone: DataFrame) -> DataFrame:
    """(url, seen, streak, sources, retire): pages found get streak 0 and their sources; others one more and none; retired at MISSES or when gone."""
    joined = meta.join(found.select("url", F.col("sources").alias("now_sources")), "url", "left").join(gone.select("url", F.lit(True).alias("is_gone")), "url", "left")
    seen = F.col("now_sources").isNotNull()
    streak = F.when(seen, 0).otherwise(F.col("missing_streak") + 1)
    none = F.expr("cast(array() as array<string>)")
    return joined.select("url", seen.alias("seen"), streak.alias("streak"), F.coalesce("now_sources", none).alias("sources"), (F.coalesce("is_gone", F.lit(False)) | (streak >= MISSES)).alias("retire"))


def record_run(meta: DataFrame, books: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """meta after a run: streaks, sources and retirements from bookkeeping, and pages that were used stamped."""
    out = meta.join(books, "url", "left").join(used.select("url", F.lit(True).alias("was_used")), "url", "left")
    return out.select(
        "url",
        F.coalesce("streak", "missing_streak").alias("missing_streak"),
        F.coalesce("sources", "discovered_from").alias("discovered_from"),
        F.when(F.coalesce("retire", F.lit(False)), F.coalesce("retired_at", now)).otherwise(F.col("retired_at")).alias("retired_at"),
        F.when(F.col("was_used"), now).otherwise(F.col("last_used_at")).alias("last_used_at"),
    )


def merge_corpus(stored: DataFrame, read: DataFrame) -> DataFrame:
    """Live stored pages overlaid by those of this run: same columns, read wins."""
    live = stored.where("retired_at is null").drop("retired_at")
    return live.join(read.select("url"), "url", "left_anti").unionByName(read)


def upsert(stored: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """stored with pages written over it: a page that was stored keeps its last use unless there is a new one, its change date if its hash is
    the same, and is no longer retired."""
    s, p = stored.alias("s"), pages.alias("p")
    both = s.join(p, F.col("s.url") == F.col("p.url"), "full")
    new = F.col("p.url").isNotNull()
    same = F.col("s.content_hash") == F.col("p.content_hash")
    pick = lambda c: F.when(new, F.col(f"p.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return both.select(
        F.coalesce("p.url", "s.url").alias("url"),
        pick("title"),
        pick("content_hash"),
        F.when(new, now).otherwise(F.col("s.fetched_at")).alias("fetched_at"),
        F.when(~new | F.coalesce(same, F.lit(False)), F.col("s.changed_at")).otherwise(now).alias("changed_at"),
        F.coalesce("p.last_used_at", "s.last_used_at").alias("last_used_at"),
        F.when(~new, F.col("s.retired_at")).alias("retired_at"),
    )


def replace_by_url(stored: DataFrame, urls: DataFrame, rows: DataFrame) -> DataFrame:
    """stored without the rows of these urls, plus the new ones: a delete and insert in one."""
    return stored.join(urls.select("url").distinct(), "url", "left_anti").unionByName(rows)


def live(pages: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    out = pages.where("retired_at is null")
    return out.where(F.col("kind").isin(kinds)) if kinds else out


def page_meta(pages: DataFrame) -> DataFrame:
    """Pages without what is long: a projection that a column store never reads."""
    return pages.drop("text", "mentions")


def pages_by_url(pages: DataFrame, urls: list[str]) -> DataFrame:
    """The pages at these addresses, in the order asked for, with their place in it; a list that a caller writes out, so it is broadcast."""
    asked = pages.sparkSession.createDataFrame([(u, i) for i, u in enumerate(dict.fromkeys(urls))], "url string, place int")
    return pages.join(F.broadcast(asked), "url").orderBy("place")


def with_defaults(pages: DataFrame) -> DataFrame:
    """Rows as they read if they were written before a column was: a page of the documents without a known hash, which is read again."""
    at = F.coalesce("fetched_at", F.timestamp_seconds(F.lit(0)))
    none = F.expr("cast(array() as array<string>)")
    fill = {
        "title": F.coalesce("title", F.lit("")), "text": F.coalesce("text", F.lit("")), "mentions": F.coalesce("mentions", none), "kind": F.coalesce("kind", F.lit("docs")), "content_hash": F.coalesce("content_hash", F.lit("")),
        "fetched_at": at, "changed_at": F.coalesce("changed_at", at), "discovered_from": F.coalesce("discovered_from", none), "missing_streak": F.coalesce("missing_streak", F.lit(0)),
    }
    return pages.select(*[fill[c].alias(c) if c in fill else c for c in pages.columns])


def page_file(url: Column, title: Column, kind: Column, fetched_at: Column, changed_at: Column, text: Column) -> Column:
    """A page as a file of the workspace: what it is, where it came from, and its text."""
    named = F.coalesce(F.nullif(F.trim(title), F.lit("")), U.title(url))
    said = F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv])[kind]
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\n"))
    return F.concat(F.lit("---\n"), line("url", url), line("title", named), line("kind", kind), line("evidence", said), line("read", T.day(fetched_at)), line("last_changed", T.day(changed_at)), F.lit("---\n\n# "), named, F.lit("\n\n"), text, F.lit("\n"))


def write_workspace(pages: DataFrame, path: str) -> DataFrame:
    """Writes the workspace of pages (url, section, slug, title, kind, fetched_at, changed_at, text): a table (path, content) of one file a page
    with text, anew each time, so that a retired page leaves nothing. Returns it as read back."""
    held = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    content = page_file(F.col("url").cast("string"), F.col("title"), F.col("kind"), F.col("fetched_at"), F.col("changed_at"), F.col("text"))
    return written(workspace_paths(held).join(held.select("url", content.alias("content")), "url").select("path", "content"), path)


def workspace_paths(pages: DataFrame) -> DataFrame:
    """(url, path) from (url, section, slug): one file a page; slugs that collide get -2, -3 and so on in url order."""
    n = F.row_number().over(Window.partitionBy("section", "slug").orderBy("url"))
    return pages.withColumn("n", n).select("url", F.concat("section", F.lit("/"), "slug", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit(".md")).alias("path"))


def contents(paths: DataFrame) -> DataFrame:
    """(section, n_pages, first_path, last_path): the table of contents by section."""
    return paths.groupBy("section").agg(F.count("*").alias("n_pages"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
