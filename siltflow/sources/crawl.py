"""Reading a corpus by a frontier: what is listed, then what the pages that were read link to, within a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, routing
from ..operators.state import Store
from ..storage import written

#: Reads rows (url): (url, status, links, and more). Links are None where there is no page.
Read = Callable[[DataFrame], DataFrame]


def crawl(found: DataFrame, meta: DataFrame, read: Read, now: Column, budget: int = corpus.BUDGET, levels: int = 1, keep: Callable[[Column], Column] = lambda u: F.lit(True)) -> tuple[DataFrame, DataFrame]:
    """(answers, discoveries) of a refresh. found: (url, kind, source), meta: the pages that are held (url, content_hash, fetched_at, last_used_at).

    Level 0 are the found pages that are new or due, within the budget, as `plan_refresh` has them. Each further level are the pages that those of
    the level before link to, that are neither held nor were asked for, by url, within what the pages that were read left of the budget. Each
    level is written before it is read, so that nothing is asked for twice. answers are those of all levels, with level; discoveries are found
    with the links that `keep` accepts as source crawl, merged by url; a page that only links name takes the kind docs.
    """
    planned = corpus.plan_refresh(corpus.merge_discoveries(found), meta, now, budget).where("planned").select("url")
    answers = written(read(written(planned)).withColumn("level", F.lit(0)))
    fetched, linked = answers.where("links is not null").count(), None
    for level in range(1, levels + 1):
        last = answers.where(F.col("level") == level - 1).select(F.explode("links").alias("url")).where(keep(F.col("url"))).distinct()
        linked = last if linked is None else linked.union(last).distinct()
        room = budget - fetched
        if room <= 0:
            break
        frontier = last.join(meta.select("url"), "url", "left_anti").join(answers.select("url"), "url", "left_anti").orderBy("url").limit(room)
        frontier = written(frontier)
        if frontier.isEmpty():
            break
        more = written(read(frontier).withColumn("level", F.lit(level)))
        answers = answers.unionByName(more)
        fetched += more.where("links is not null").count()
    every = answers.select(F.explode("links").alias("url")).where(keep(F.col("url"))).distinct()
    crawled = every.select("url", F.lit("docs").alias("kind"), F.lit("crawl").alias("source"))
    return answers, corpus.merge_discoveries(found.select("url", "kind", "source").unionByName(crawled))


def refresh(store: Store, found: DataFrame, read: Read, now: Column, budget: int = corpus.BUDGET, levels: int = 1, keep: Callable[[Column], Column] = lambda u: F.lit(True), names: dict[str, tuple[str, ...]] | None = None, used: DataFrame | None = None) -> dict[str, int]:
    """A refresh of the pages and claims that a store has, and its numbers: discovered, fetched, changed, gone, retired, claims.

    read gives (url, status, links, title, text). Pages that were read take the place of what is held; one whose text didn't change keeps its date
    of change. Pages that answer that they are gone are retired at once, those that no source lists after corpus.MISSES runs. Claims of pages
    that were read are made anew. Read again with the same answers, a store stays as it is but for its dates of reading.
    """
    meta = store.read("pages")
    held = meta.select("url", "content_hash", "fetched_at", "last_used_at")
    answers, discoveries = crawl(found, held, read, now, budget, levels, keep)
    answers, discoveries = written(answers), written(discoveries)
    pages = answers.where("links is not null and trim(coalesce(text, '')) <> ''").select("url", "title", "text", F.sha1("text").alias("content_hash"))
    pages = written(pages.join(discoveries.select("url", "kind", "sources"), "url", "left"))
    changed = pages.join(held.select("url", F.col("content_hash").alias("old")), "url", "left").where(~F.col("content_hash").eqNullSafe(F.col("old"))).count()
    gone = answers.where(F.col("status").isin(404, 410)).select("url")
    streaks = meta.select("url", F.coalesce("missing_streak", F.lit(0)).alias("missing_streak"))
    books = written(corpus.bookkeeping(streaks, discoveries, gone))
    store.save_pages(pages, now)
    claims = routing.claims(pages, "url", F.col("text"), names or {}) if names else None
    if claims is not None:
        claims = written(claims.select("url", "name", "paragraph", F.lit(None).cast("string").alias("heading")))
        store.replace_claims(pages.select("url"), claims)
    store.record_run(books, used if used is not None else pages.select("url").limit(0), now)
    return {
        "discovered": discoveries.count(), "fetched": pages.count(), "changed": changed, "gone": gone.count(), "retired": books.where("retire").count(),
        "claims": claims.count() if claims is not None else 0, "words": pages.agg(F.coalesce(F.sum(T.word_count(F.col("text"))), F.lit(0))).first()[0],
    }
