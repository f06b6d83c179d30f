"""Queries of sources, markup, differences and JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import diff as D
from ..functions import jsonx as N
from ..functions import markup as M
from ..functions import replies as J
from ..functions import text as T
from ..functions import urls as U
from ..operators import gate as G
from ..operators import replay as P
from ..sources import crawl as C
from ..sources import feeds as S
from ..sources import fetch as X
from ..storage import work_dir
from .base import table
from .scalars import SQL_URLS
from .search import sql_collapse, sql_truncate

def _s():
    return F.col("page_id").cast("string")


def _amp():
    return F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))


def _xml(spark, sf_dir, head, item, tail, keep="true", by=10):
    """One document for each tenth of the pages, an item a page in page order."""
    p = table(spark, sf_dir, "pages").where(keep).select((F.col("page_id") % by).alias("feed"), "page_id", item.alias("item"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "item"))), lambda x: x["item"]), "")
    return p.groupBy("feed").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("xml"))


def _feeds(spark, sf_dir):
    rss = F.concat(
        F.lit("<item><title><![CDATA[Page "), _s(), F.lit(" & more]]></title><link>"), _amp(), F.lit("</link>"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<guid isPermaLink="false">g'), _s(), F.lit("</guid>"))).otherwise(""),
        F.lit("<pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate>"), F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<summary>Body "), _s(), F.lit("</summary><description>no</description>"))).otherwise(F.concat(F.lit("<description>&lt;p&gt;Body "), _s(), F.lit("&lt;/p&gt;"), F.when(F.col("page_id") % 12 == 2, F.concat(F.lit("&lt;img src='http://b.example/"), _s(), F.lit(".jpg' width='640'&gt;"))).otherwise(""), F.lit("</description>"))),
        F.when(F.col("page_id") % 8 == 0, F.concat(F.lit('<enclosure url="http://e.example/a.mp3" type="audio/mpeg"/><enclosure url="http://e.example/'), _s(), F.lit('.png" type="image/png"/>'))).otherwise(""), F.lit("</item>"),
    )
    atom = F.concat(F.lit("<entry><title type=\"html\">Page "), _s(), F.lit(' &amp; more</title><link href="'), _amp(), F.lit('"/><id>a'), _s(), F.lit("</id><updated>2024-01-03</updated><summary type=\"html\">Body "), _s(), F.lit("</summary>"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<media:thumbnail url="http://t.example/'), _s(), F.lit('"/>'))).otherwise(""), F.lit("</entry>"))
    media = 'xmlns:media="http://search.yahoo.com/mrss/"'
    a = _xml(spark, sf_dir, f'<rss version="2.0" {media}><channel><title>x</title>', rss, "</channel></rss>", "page_id % 4 = 0")
    # a channel may be the root itself
    c = _xml(spark, sf_dir, "<channel><title>x</title>", rss, "</channel>", "page_id % 4 = 2")
    b = _xml(spark, sf_dir, f'<feed xmlns="http://www.w3.org/2005/Atom" {media}><title>x</title>', atom, "</feed>", "page_id % 2 = 1")
    return a.unionByName(b).unionByName(c.withColumn("feed", F.col("feed") + 100))


def feed_entries(spark, sf_dir):
    found = S.items(S.entries(_feeds(spark, sf_dir), "feed", F.col("xml")), "feed")
    at = F.date_format("published_at", "yyyy-MM-dd").alias("published_at")
    return found.withColumn("body", M.plain_column(F.col("body"))).select("feed", "pos", "external_id", "title", "url", "published", at, "body", "image", "entry_url")


def sitemap_entries(spark, sf_dir):
    item = F.concat(F.lit("<url><loc>"), _amp(), F.lit("</loc>"), F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("<lastmod>2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    x = _xml(spark, sf_dir, "<urlset>", item, "</urlset>", by=1)
    return S.articles(S.sitemap(x, "feed", F.col("xml")), F.lit("2024-01-10").cast("timestamp"), 40).select("url", "lastmod")


def llms_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    text = F.concat(F.lit("- [One]("), U.canonical(F.col("url")), F.lit("): see "), U.canonical(F.col("url")), F.lit("/next, and "), U.canonical(F.col("url")), F.lit("."))
    return p.select("page_id", F.posexplode(S.listed_urls(text)).alias("pos", "url"))


def llms_sections(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    part = F.concat(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("# Title "), _s(), F.lit("\n"))).otherwise(""), F.when(F.col("page_id") % 3 == 0, "Source: ").otherwise(""), U.canonical(F.col("url")), F.lit("\n# Inner "), _s(), F.lit("\nText "), _s(), F.lit("\n"))
    return S.full_pages(_xml(spark, sf_dir, "intro\n", part, "end"), "feed", F.col("xml")).select("feed", F.col("section").cast("long").alias("section"), "url", "title")


def _markdown(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    md = F.concat(
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("---\ntitle: Front "), _s(), F.lit("\n---\n"))).otherwise(""), F.lit("# Head "), _s(),
        F.lit("\n\nSome *bold* text with [a link](/docs/"), _s(), F.lit(") and [here](#top) and [again](/docs/"), _s(), F.lit(").\n\n![img](/x.png)\n```sh\nrun it\n```\n> `code` quoted\n"),
    )
    return p.select("page_id", md.alias("md"))


def markdown_page(spark, sf_dir):
    return _markdown(spark, sf_dir).select("page_id", M.markdown_title(F.col("md")).alias("title"), M.markdown_text(F.col("md")).alias("text"), F.array_join(M.markdown_links(F.col("md")), " ").alias("links"))


def read_pages(spark, sf_dir):
    """Pages whose markdown is there, empty or missing."""
    p = _markdown(spark, sf_dir).join(_pages(spark, sf_dir).select("page_id", "html", F.concat(F.lit("https://docs.example.com/a-page/"), _s()).alias("url")), "page_id")
    i = F.col("page_id")
    md = F.when(i % 3 == 0, F.col("md")).when(i % 3 == 1, "```\ncode only\n```")
    html = F.when(i % 5 == 0, "<p>One two three four five six seven. Eight.</p><a href='/x'>x</a><a HREF=\"/x\">y</a>").otherwise(F.col("html"))
    read = S.read_pages(p.select("url", md.alias("markdown"), html.alias("html")))
    return read.select("url", F.when(F.col("text").startswith("One two"), "short").when(F.col("text").startswith("Head "), "Head").alias("begins"), F.when(F.size("links") == 1, F.col("links")[0]).alias("link"), F.col("title").startswith("Front").alias("front"))


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def extract_links_count(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.size(M.links_column(F.col("html"), F.col("url"))).cast("long").alias("n_links"))


def html_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", M.page_column(F.col("html"))["title"].alias("title"))


def html_blocks(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", M.page_column(F.col("html")).alias("p"))
    return p.select("page_id", F.posexplode("p.blocks").alias("pos", "b")).select("page_id", "pos", "b.heading", "b.text")


def prose_blocks(spark, sf_dir):
    return html_blocks(spark, sf_dir).where(F.col("text").rlike(r"[.!?]$") & (T.word_count(F.col("text")) >= 6)).groupBy("page_id").agg(F.count("*").alias("n_prose"))


def article_cards(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.posexplode(M.cards_column(F.concat(F.lit("<article aria-label='Card'><a href='/blog/one?ref=x'>x</a><time datetime='2024-01-01'></time></article>"), F.col("html")), F.col("url"))).alias("pos", "c")).select("page_id", "pos", "c.title", "c.published")


def image_urls(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.posexplode(M.images_column(F.concat(F.lit("<meta property='og:image' content='/og.png'><img src='/logo.png'><img src='/a.jpg' width='640'>"), F.col("html")), F.col("url"))).alias("pos", "image")).select("page_id", "pos", "image")


def enrich_articles(spark, sf_dir):
    i = F.col("page_id")
    signals = _pages(spark, sf_dir).select(i.alias("id"), F.when(i % 2 == 0, "blog").otherwise("feed").alias("source"), F.lit("old").alias("title"), F.when(i % 3 == 0, F.lit("2024-01-05").cast("timestamp")).alias("published_at"))
    read = _pages(spark, sf_dir).where("page_id % 10 <> 4").select(i.alias("id"), M.page_column(F.col("html"))["title"].alias("title"), F.lit("2024-02-01T00:00:00Z").alias("published"), F.lit("text").alias("text"), F.concat(F.lit("i"), _s()).alias("image"))
    out = S.enrich(signals, read)
    return out.select("id", "source", "title", F.date_format("published_at", "yyyy-MM-dd").alias("published_at"), "body", "image")


def fetched(spark, sf_dir):
    """Every page read by the data source from saved answers: some are lost, some need a second or third attempt, some refuse or don't answer at
    any, some answer in JSON. What is read is what was saved."""
    folder = f"{work_dir(spark)}/answers-{uuid.uuid4().hex}"
    i = F.col("page_id")
    pages = _pages(spark, sf_dir).select("page_id", F.concat(F.coalesce("url", F.lit("")), F.lit("/"), _s()).alias("url"), F.when(i % 7 == 6, F.concat(F.lit('{"k": '), _s(), F.lit("}"))).otherwise(F.coalesce("html", F.lit(""))).alias("body"))
    often = lambda status, n: F.array_repeat(F.lit(status), n)
    fails = F.when(i % 7 == 1, often(0, 1)).when(i % 7 == 2, often(503, 2)).when(i % 7 == 4, often(429, X.ATTEMPTS)).when(i % 7 == 5, often(0, X.ATTEMPTS))
    X.save(pages.where(i % 7 != 3).withColumn("fails", fails), folder)
    own = {"opener": "siltflow.sources.fetch:saved_opener", "folder": folder, "pause": "none"}
    got = X.fetch_all(pages, **own).select("url", "status", "attempts", F.char_length("body").cast("long").alias("n_chars"))
    told = X.fetch_json(pages, "k long", **own).select("url", F.col("value.k").alias("k"))
    return got.join(told, "url").join(X.content_type(pages, **own), "url").select("url", "status", "attempts", "n_chars", "k", "content_type", X.is_gone(F.col("status")).alias("gone"))


DOCS, CRAWL_BUDGET, CRAWL_LEVELS = "https://docs.example.com/p/", 90, 3


def _linked(spark, sf_dir):
    """pages at addresses of their own, each linking to two others besides what it links to anyway."""
    at = lambda n: F.concat(F.lit(DOCS), n.cast("string"))
    i = F.col("page_id")
    link = lambda n: F.concat(F.lit(' <a href="'), at(n), F.lit('">more</a>'))
    return _pages(spark, sf_dir).select("page_id", at(i).alias("url"), F.concat(F.coalesce("html", F.lit("")), link(i * 3 + 1), link(i * 5 + 2)).alias("html"))


def crawled(spark, sf_dir):
    """A refresh's reading: a third of the pages is listed, a part of these is held, and links of what is read are followed within the budget."""
    i = F.col("page_id")
    pages = _linked(spark, sf_dir)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    found = pages.where(i % 3 == 0).select("url", F.lit("docs").alias("kind"), F.lit("sitemap").alias("source"))
    day = lambda n: F.timestamp_micros(F.unix_micros(now) - n * 86_400_000_000)
    meta = pages.where(i % 4 == 0).select("url", F.lit("h").alias("content_hash"), day(i % 30).alias("fetched_at"), F.lit(None).cast("timestamp").alias("last_used_at"))

    def read(rows):
        got = rows.join(pages, "url", "left")
        status = F.when(i.isNull() | (i % 11 == 5), 404).when(i % 13 == 6, 0).otherwise(200)
        return got.select("url", status.alias("status"), F.when(status == 200, M.links_column(F.col("html"), F.col("url"))).alias("links"))

    return C.crawl(found, meta, read, now, CRAWL_BUDGET, CRAWL_LEVELS, lambda u: u.startswith(DOCS))[0].select("url", "level", "status")


def child_sitemaps(spark, sf_dir):
    """Sitemaps of pages, and indexes of six sitemaps each, of which the third can't be read."""
    p = _pages(spark, sf_dir).select((F.col("page_id") % 4).alias("feed"), "page_id")
    index = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.concat(F.lit("<sitemap><loc>https://s.example/"), F.col("feed"), F.lit("/"), k, F.lit("</loc></sitemap>"))), "")
    pages = F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda i: F.concat(F.lit("<url><loc>https://p.example/"), i, F.lit("</loc></url>"))), "")
    top = p.groupBy("feed").agg(pages.alias("pages")).select("feed", F.when(F.col("feed") % 2 == 0, F.concat(F.lit("<sitemapindex>"), index, F.lit("</sitemapindex>"))).when(F.col("feed") == 1, F.concat(F.lit("<sitemapindex>"), index, "pages", F.lit("</sitemapindex>"))).otherwise(F.concat(F.lit("<urlset>"), "pages", F.lit("</urlset>"))).alias("xml"))

    def read(rows):
        body = F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("/a</loc></url><url><loc>"), "url", F.lit("/b</loc><lastmod>2024-01-02</lastmod></url></urlset>"))
        return rows.select("url", F.when(~F.col("url").endswith("/2"), body).alias("body"))

    # the collector's rule for even feeds, discovery's (children always) for all
    every = S.follow(top, "feed", read, always=True)
    return S.follow(top, "feed", read).withColumn("rule", F.lit("collect")).unionByName(every.withColumn("rule", F.lit("discover")))


def _timelines(spark, sf_dir):
    """(conv_id, json): conversations as timelines, posts with and without pictures, some of them answers or reposts."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    text = F.concat(F.when(t % 5 == 3, "@a ").when(t % 5 == 4, "RT @b ").otherwise(""), F.coalesce("text", F.lit("")))
    keys = F.when(t % 2 == 0, F.array(F.lit("none"), F.concat(F.lit("k"), t), F.lit("k0")))
    post = F.struct(t.cast("string").alias("id"), text.alias("text"), F.lit("2024-01-02T03:04:05.000Z").alias("created_at"), F.struct(keys.alias("media_keys")).alias("attachments"))
    media = F.struct(F.concat(F.lit("k"), t).alias("media_key"), F.when(t % 4 == 0, F.concat(F.lit("u"), t)).alias("url"), F.concat(F.lit("p"), t).alias("preview_image_url"))
    both = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", post.alias("p"), media.alias("m")))).alias("x"))
    json = F.to_json(F.struct(F.transform("x", lambda x: x["p"]).alias("data"), F.struct(F.transform("x", lambda x: x["m"]).alias("media")).alias("includes")))
    return both.select("conv_id", json.alias("json"))


def timeline_items(spark, sf_dir):
    found = S.timeline_posts(_timelines(spark, sf_dir), "conv_id", F.col("json"))
    return found.select("conv_id", "pos", "external_id", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "image")


def user_timelines(spark, sf_dir):
    """Users by conversation, read from saved answers: a fifth are nobody's names, the lookup of some and the timeline of others was not saved."""
    base, i = "http://api.example", F.col("conv_id")
    t = _timelines(spark, sf_dir).withColumn("user", F.concat(F.lit("user "), i.cast("string"))).withColumn("id", F.concat(F.lit("i"), i.cast("string")))
    known = F.to_json(F.struct(F.struct("id").alias("data")))
    lookups = t.where(i % 7 != 3).select(U.user_lookup(base, F.col("user")).alias("url"), F.when(i % 5 == 4, '{"errors": [{"title": "Not Found"}]}').otherwise(known).alias("body"))
    saved = lookups.unionByName(t.where(i % 6 != 1).select(U.timeline(base, F.col("id"), F.lit(S.MOST_POSTS)).alias("url"), F.col("json").alias("body")))
    found = S.user_posts(t.select("user"), lambda asked: asked.join(saved, "url"), base)
    return found.select("user", "pos", "external_id", "title", "url", "image")


def _reply(mended=None):
    """An event as a reply in either spelling, which may be unusable; where mended holds it is not."""
    i = F.col("event_id")
    mended = F.lit(False) if mended is None else mended
    q = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    s = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
    actions = F.concat(F.lit('[{"type": "consider_building", "detail": "Build — it", "evidence_quote": "a—b"}, {"action": "update_pages", "actionDetail": "x", "gap": " "}, {"type": "unknown", "detail": "y"}, {"type": "update_pages", "detail": "'), i.cast("string"), F.lit('"}, {"type": "update_pages", "detail": "z"}]'))
    parts = F.filter(
        F.array(
            F.when((i % 7 != 0) | mended, q("impact", s(F.when((i % 11 == 0) & ~mended, "huge").otherwise("major")))), F.when((i % 5 != 0) | mended, q("summary", s(F.when((i % 13 == 0) & ~mended, F.repeat(F.lit("s"), F.lit(601))).otherwise("It — is")))),
            F.when((i % 3 == 0) | mended, q("actions", actions)).when(i % 3 == 1, q("noAction", F.lit('{"kind": "odd", "reason": "None"}'))), q("openQuestions", F.lit('["Unclear if it holds", "No.", "Is it?", " "]')),
            q("productRefs", F.lit('[{"url": "u", "claim": "c", "editKind": "insert"}, {"url": " ", "claim": "c"}, {"claim": "c"}]')),
        ),
        lambda x: x.isNotNull(),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def analysis_replies(spark, sf_dir):
    """Events as replies in either spelling, some of which can't be used."""
    a = table(spark, sf_dir, "events").select("event_id", J.analysis(_reply()).alias("a"))
    return a.select("event_id", "a.error", "a.impact", "a.summary", F.array_join(F.transform("a.actions", lambda x: F.concat(x["type"], F.lit(":"), x["detail"], F.coalesce(x["evidence_quote"], F.lit("")))), "|").alias("actions"), F.col("a.no_action.kind").alias("verdict"), F.array_join("a.questions", "|").alias("questions"), F.size("a.refs").cast("long").alias("n_refs"))


def replayed(spark, sf_dir):
    """Events as analyses: the replies of analysis_replies() first, then, of those that can't be used, replies that are mended for even events;
    every seventeenth event has no first reply."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    first = e.where(i % 17 != 0).select(i.alias("id"), F.lit(1).alias("attempt"), _reply().alias("reply"))
    second = e.select(i.alias("id"), F.lit(2).alias("attempt"), _reply(i % 2 == 0).alias("reply"))
    made = P.attempts(e.select(i.alias("id")), P.recorded(first.unionByName(second)), lambda r: J.analysis(r, ("summary", "actions")))
    why = made.where("attempt = 2").select("id", "why")
    out = P.settled(made).join(why, "id", "left")
    return out.select("id", "attempts", "why", "error", F.col("answer.summary").alias("summary"), F.size("answer.actions").cast("long").alias("n_actions"))


def review_replies(spark, sf_dir):
    i = F.col("event_id")
    review = F.concat(F.lit('{"verdict": "'), F.when(i % 4 == 0, "perhaps").otherwise("revise"), F.lit('", "reason": "'), F.when(i % 5 == 0, " ").otherwise("Too — long"), F.lit('", "pagesChecked": [" a ", ""], "requested_changes": ["x", " "], "actionType": "consider_building"}'))
    revision = F.concat(F.lit('{"action": "update_pages", "detail": " d ", "evidenceUrl": " u ", "page_edits": [{"url": "a", "replacement_text": "R"}, {"url": "b"}, {"suggestedEdit": "x"}], "impact": "'), F.when(i % 2 == 0, "minor").otherwise("none"), F.lit('"}'))
    r = table(spark, sf_dir, "events").select("event_id", J.review(review).alias("r"), J.revision(revision).alias("v"))
    return r.select("event_id", "r.error", "r.verdict", "r.reason", F.array_join("r.pages", ",").alias("pages"), F.array_join("r.changes", ",").alias("changes"), "r.action_type", F.col("v.type").alias("type"), F.col("v.detail").alias("detail"), F.col("v.evidence_url").alias("evidence_url"), F.col("v.impact").alias("impact"), F.array_join(F.transform("v.edits", lambda e: F.concat(e["url"], e["proposed_text"])), ",").alias("edits"))


def alert_roundtrip(spark, sf_dir):
    """Alerts stored and read again, each issue beside its action."""
    i = F.col("event_id")
    reply = F.concat(F.lit('{"impact": "major", "summary": "S'), i.cast("string"), F.lit('", "actions": [{"type": "consider_building", "detail": "A"}, {"type": "update_pages", "detail": "B"}]}'))
    issues = F.slice(F.array(i, i + 1), F.lit(1), (i % 3).cast("int"))
    stored = table(spark, sf_dir, "events").select("event_id", J.stored_alert(J.analysis(reply), F.concat(F.lit("p"), i.cast("string")), issues).alias("json"))
    back = stored.select("event_id", J.analysis(F.get_json_object("json", "$.analysis")).alias("a"), F.from_json(F.get_json_object("json", "$.issues"), "array<long>").alias("issues"), F.get_json_object("json", "$.image").alias("image"))
    pairs = J.paired(F.transform("a.actions", lambda a: a["detail"]), F.col("issues"))
    return back.select("event_id", "a.summary", "image", F.array_join(F.transform(pairs, lambda p: F.concat(p["action"], F.coalesce(p["issue"].cast("string"), F.lit("-")))), ",").alias("pairs"))


def collect_blog(spark, sf_dir):
    p = _pages(spark, sf_dir)
    cards = p.where("page_id % 3 = 0").select(U.canonical(F.col("url")).alias("url"), F.concat(F.lit("Card "), _s()).alias("title"), F.col("page_id").alias("pos"))
    links = p.select(U.canonical(F.col("url")).alias("url"), F.col("page_id").alias("pos"))
    return S.blog(cards, links, 100).select("url", "title")


def collect_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events")

    def fails():
        raise ConnectionError("unreachable")

    def breaks():
        return e.select(F.raise_error(F.lit("lost while it runs")).cast("long").alias("event_id"), F.lit("x").alias("source"))

    each = {k: (lambda k=k: e.where(F.col("event_type") == k).select("event_id", F.col("event_type").alias("source"))) for k in ("view", "click")}
    out, read, notes = S.collect(spark, {**each, "broken": fails, "breaks": breaks}, "event_id long, source string")
    return out.withColumn("sources_read", F.lit(read).cast("long")).withColumn("n_notes", F.lit(len(notes)).cast("long"))


def _edits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    before = T.collapse(F.col("text"))
    after = F.concat(F.regexp_replace(before, r"(\S+) (\S+) (\S+)", "$1 $3"), F.lit(" and more words here"))
    return d.select("doc_id", before.alias("before"), after.alias("after"), F.col("text"))


def word_diff(spark, sf_dir):
    e = _edits(spark, sf_dir)
    return e.select("doc_id", F.posexplode(D.diff_column(F.col("before"), F.col("after"))).alias("pos", "s")).select("doc_id", "pos", "s.kind", "s.text")


def copy_runs(spark, sf_dir):
    e = _edits(spark, sf_dir)
    return e.select("doc_id", F.posexplode(D.runs_column(F.col("before"), F.col("after"))).alias("pos", "s")).select("doc_id", "pos", "s.kind", "s.text")


def edit_runs(spark, sf_dir):
    """What to paint of an edit of two paragraphs: the first against the line whose place it takes, the other new; of inserts all is new."""
    e = _edits(spark, sf_dir)
    two = F.concat(T.first_sentence(F.col("after")), F.lit("\n\n"), T.first_sentence(F.col("before")))
    kind = F.when(F.col("doc_id") % 3 == 0, "insert").otherwise("replace")
    runs = e.select("doc_id", F.posexplode(D.edit_runs_column(T.first_sentence(F.col("before")), two, kind)).alias("paragraph", "runs"))
    return runs.select("doc_id", "paragraph", F.posexplode("runs").alias("pos", "s")).select("doc_id", "paragraph", "pos", "s.kind", "s.text")


def edit_proportion(spark, sf_dir):
    e = _edits(spark, sf_dir).withColumn("c", D.changed_column(F.col("before"), F.col("after")))
    allowed = G.allowed_words(T.word_count(F.col("before")), T.word_count(F.col("text")))
    return e.select("doc_id", F.col("c.added").alias("added"), F.col("c.removed").alias("removed"), allowed.alias("allowed"), (F.col("c.added") > allowed).alias("out_of_proportion"), F.col("c.summary").alias("summary"))


def loose_span(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    half = F.floor(F.char_length("text") / 2).cast("int")
    s = D.span_column(F.upper(F.substring(F.col("text"), half, F.char_length("text"))), F.col("text"))
    return d.select("doc_id", s["start"].alias("start"), s["end"].alias("end"))


def balanced_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", N.balanced_column(F.concat(F.lit("The reply is:\n```json\n"), "props", F.lit("\n```\n{}"))).alias("json"))


def props_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", N.first_of(F.col("props"), "key", "k").cast("long").alias("k"), N.no_action_kind(F.when(F.col("event_id") % 2 == 0, "already_covered").otherwise(F.col("event_type"))).alias("kind"))


def payload_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.to_json(F.struct("event_id", "event_type", F.from_json("props", "k long").alias("props")))
    back = F.from_json(raw, "event_id long, event_type string, props struct<k: long>")
    return e.select(back["event_id"].alias("event_id"), back["event_type"].alias("event_type"), back["props"]["k"].alias("k"))


QUERIES = {
    f.__name__: f
    for f in (
        feed_entries, sitemap_entries, llms_urls, llms_sections, markdown_page, extract_links_count, html_title, html_blocks, prose_blocks, article_cards, image_urls, enrich_articles, collect_blog,
        collect_candidates, read_pages, fetched, crawled, child_sitemaps, timeline_items, user_timelines, analysis_replies, replayed, review_replies, alert_roundtrip, word_diff, copy_runs, edit_proportion, edit_runs, loose_span, balanced_json, props_json, payload_roundtrip,
    )
}

_ARTICLE = "len(segs) >= 2 AND len(list_filter(segs, lambda s: lower(s) IN (" + ", ".join(repr(x) for x in U.LISTING) + "))) = 0"
ORACLES = {
    "feed_entries": f"""WITH {SQL_URLS}, entry AS (SELECT page_id, CASE WHEN fragment <> '' THEN normal || fragment END AS entry_url FROM u), p AS (SELECT page_id, url, CASE WHEN page_id % 4 = 2 THEN page_id % 10 + 100 ELSE page_id % 10 END AS feed, page_id % 2 = 0 AS rss FROM pages)
SELECT feed, (row_number() OVER (PARTITION BY feed ORDER BY page_id) - 1)::INTEGER AS pos, CASE WHEN NOT rss THEN 'a' || page_id WHEN page_id % 3 = 0 THEN 'g' || page_id ELSE url END AS external_id, 'Page ' || page_id || ' & more' AS title, url,
  CASE WHEN rss THEN 'Tue, 02 Jan 2024 10:00:00 +0000' ELSE '2024-01-03' END AS published, CASE WHEN rss THEN '2024-01-02' ELSE '2024-01-03' END AS published_at, 'Body ' || page_id AS body,
  CASE WHEN rss AND page_id % 8 = 0 THEN 'http://e.example/' || page_id || '.png' WHEN rss AND page_id % 12 = 2 THEN 'http://b.example/' || page_id || '.jpg' WHEN NOT rss AND page_id % 3 = 0 THEN 'http://t.example/' || page_id END AS image, entry_url FROM p JOIN entry USING (page_id)""",
    "sitemap_entries": f"""WITH {SQL_URLS} SELECT url, lastmod FROM (SELECT url, segs, '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS lastmod FROM u WHERE page_id % 4 <> 0) WHERE {_ARTICLE} AND lastmod >= '2024-01-10' ORDER BY lastmod DESC, url LIMIT 40""",
    "llms_urls": f"WITH {SQL_URLS} SELECT page_id, pos::INTEGER AS pos, url FROM (SELECT page_id, 0 AS pos, canonical AS url FROM u UNION ALL SELECT page_id, 1, canonical || '/next' FROM u)",
    "llms_sections": f"""WITH {SQL_URLS}, s AS (SELECT page_id, page_id % 10 AS feed, canonical AS url, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) AS section, lag(page_id) OVER (PARTITION BY page_id % 10 ORDER BY page_id) AS prev FROM u)
SELECT feed, section, url, CASE WHEN page_id % 2 = 0 THEN 'Title ' || page_id WHEN prev IS NOT NULL THEN 'Inner ' || prev ELSE 'Inner ' || page_id END AS title FROM s""",
    "markdown_page": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Front ' || page_id ELSE 'Head ' || page_id END AS title, 'Head ' || page_id || ' Some bold text with a link and here and again. code quoted' AS text, '/docs/' || page_id AS links FROM pages""",
    "extract_links_count": """SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>', '', 'g'), '<a href="([^"]*)"', 1), lambda h: starts_with(h, '/'))))::BIGINT AS n_links FROM pages""",
    "html_title": f"""SELECT page_id, {sql_collapse("replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')")} AS title FROM pages""",
    "collect_blog": f"""WITH {SQL_URLS}, c AS (SELECT canonical AS url, 'Card ' || page_id AS title, page_id AS pos, segs FROM u WHERE page_id % 3 = 0), e AS (SELECT * FROM c UNION ALL SELECT canonical, NULL, page_id + (1 << 30), segs FROM u WHERE canonical NOT IN (SELECT url FROM c)),
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS n FROM e WHERE {_ARTICLE}) SELECT url, title FROM f WHERE n = 1 ORDER BY pos LIMIT 100""",
    "collect_candidates": "SELECT event_id, event_type AS source, 2::BIGINT AS sources_read, 2::BIGINT AS n_notes FROM events WHERE event_type IN ('view', 'click')",
    "balanced_json": "SELECT event_id, props AS json FROM events",
    "props_json": "SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN event_id % 2 = 0 THEN 'already_covered' ELSE 'unverified' END AS kind FROM events",
    "payload_roundtrip": "SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k FROM events",
    "enrich_articles": f"""WITH t AS (SELECT page_id AS id, {sql_collapse("replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')")} AS title, page_id % 10 <> 4 AS read, page_id % 2 = 0 AS blog FROM pages)
SELECT id, CASE WHEN blog THEN 'blog' ELSE 'feed' END AS source, CASE WHEN blog AND read AND title <> '' THEN title ELSE 'old' END AS title, CASE WHEN id % 3 = 0 THEN '2024-01-05' WHEN blog AND read THEN '2024-02-01' END AS published_at,
  CASE WHEN blog AND read THEN 'text' END AS body, CASE WHEN blog AND read THEN 'i' || id END AS image FROM t""",
    "read_pages": """SELECT 'https://docs.example.com/a-page/' || page_id AS url, CASE WHEN page_id % 3 = 0 THEN 'Head' WHEN page_id % 5 = 0 THEN 'short' END AS begins, CASE WHEN page_id % 3 = 0 THEN '/docs/' || page_id WHEN page_id % 5 = 0 THEN '/x' END AS link, page_id % 6 = 0 AS front FROM pages""",
    "fetched": """WITH k AS (SELECT coalesce(url, '') || '/' || page_id AS url, page_id, page_id % 7 AS r, ltrim(coalesce(html, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t, coalesce(html, '') AS html FROM pages)
SELECT url, CASE r WHEN 3 THEN 404 WHEN 4 THEN 429 WHEN 5 THEN 0 ELSE 200 END::INTEGER AS status, CASE r WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 3 ELSE 1 END::INTEGER AS attempts,
  CASE WHEN r = 6 THEN length('{"k": ' || page_id || '}') WHEN r IN (0, 1, 2) THEN length(html) END::BIGINT AS n_chars, CASE WHEN r = 6 THEN page_id END AS k,
  CASE WHEN r = 6 THEN 'application/json' WHEN r = 0 THEN CASE WHEN t LIKE '<%' THEN 'text/html' WHEN t LIKE '{%' OR t LIKE '[%' THEN 'application/json' ELSE 'text/plain' END END AS content_type, r = 3 AS gone FROM k""",
    "crawled": f"""WITH p AS (SELECT page_id AS i, CASE WHEN page_id % 11 = 5 THEN 404 WHEN page_id % 13 = 6 THEN 0 ELSE 200 END AS status FROM pages),
wanted AS (SELECT i, i % 4 = 0 AS held, '{DOCS}' || i AS url FROM p WHERE i % 3 = 0 AND (i % 4 <> 0 OR i % 30 > 14)),
l0 AS (SELECT i, 0 AS level FROM wanted ORDER BY held, CASE WHEN held THEN -(i % 30) END, url LIMIT {CRAWL_BUDGET})
, n1 AS (SELECT count(*) AS n FROM (SELECT i FROM l0) JOIN p USING (i) WHERE status = 200),
c1 AS (SELECT DISTINCT unnest([i * 3 + 1, i * 5 + 2]) AS i FROM l0 JOIN p USING (i) WHERE status = 200),
l1 AS (SELECT i, 1 AS level FROM (SELECT i, row_number() OVER (ORDER BY '{DOCS}' || i) AS place FROM c1 WHERE i NOT IN (SELECT i FROM p WHERE i % 4 = 0) AND i NOT IN (SELECT i FROM l0)), n1 WHERE place <= {CRAWL_BUDGET} - n), n2 AS (SELECT count(*) AS n FROM (SELECT i FROM l0 UNION ALL SELECT i FROM l1) JOIN p USING (i) WHERE status = 200),
c2 AS (SELECT DISTINCT unnest([i * 3 + 1, i * 5 + 2]) AS i FROM l1 JOIN p USING (i) WHERE status = 200),
l2 AS (SELECT i, 2 AS level FROM (SELECT i, row_number() OVER (ORDER BY '{DOCS}' || i) AS place FROM c2 WHERE i NOT IN (SELECT i FROM p WHERE i % 4 = 0) AND i NOT IN (SELECT i FROM l0) AND i NOT IN (SELECT i FROM l1)), n2 WHERE place <= {CRAWL_BUDGET} - n), n3 AS (SELECT count(*) AS n FROM (SELECT i FROM l0 UNION ALL SELECT i FROM l1 UNION ALL SELECT i FROM l2) JOIN p USING (i) WHERE status = 200),
c3 AS (SELECT DISTINCT unnest([i * 3 + 1, i * 5 + 2]) AS i FROM l2 JOIN p USING (i) WHERE status = 200),
l3 AS (SELECT i, 3 AS level FROM (SELECT i, row_number() OVER (ORDER BY '{DOCS}' || i) AS place FROM c3 WHERE i NOT IN (SELECT i FROM p WHERE i % 4 = 0) AND i NOT IN (SELECT i FROM l0) AND i NOT IN (SELECT i FROM l1) AND i NOT IN (SELECT i FROM l2)), n3 WHERE place <= {CRAWL_BUDGET} - n)
SELECT '{DOCS}' || i AS url, level::INTEGER AS level, coalesce(status, 404)::INTEGER AS status FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) LEFT JOIN p USING (i)""",
    "child_sitemaps": """WITH p AS (SELECT page_id % 4 AS feed, (row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) - 1)::INTEGER AS pos, 'https://p.example/' || page_id AS url FROM pages WHERE page_id % 2 = 1),
c AS (SELECT feed, k, x FROM (SELECT DISTINCT page_id % 4 AS feed FROM pages WHERE page_id % 4 < 3), (VALUES (0), (1), (3), (4), (5)) k(k), (VALUES ('a'), ('b')) x(x)),
b AS (SELECT feed, (row_number() OVER (PARTITION BY feed ORDER BY k, x) - 1)::INTEGER AS pos, 'https://s.example/' || feed || '/' || k || '/' || x AS url, CASE WHEN x = 'b' THEN '2024-01-02' END AS lastmod, k FROM c)
SELECT feed, pos, url, NULL::VARCHAR AS lastmod, rule FROM p, (VALUES ('collect'), ('discover')) r(rule)
UNION ALL SELECT feed, pos, url, lastmod, 'collect' FROM b WHERE feed <> 1 AND k <= 3 UNION ALL SELECT feed, pos, url, lastmod, 'discover' FROM b""",
    "timeline_items": f"""WITH p AS (SELECT conv_id, turn, {sql_collapse("coalesce(text, '')")} AS t FROM conversations WHERE turn % 5 < 3 AND NOT regexp_matches(coalesce(text, ''), '^(RT )?@')), n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos FROM p),
z AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN 'u0' END) AS zero FROM conversations GROUP BY 1)
SELECT conv_id, pos, turn::VARCHAR AS external_id, {sql_truncate('t', 120)} AS title, '2024-01-02 03:04:05' AS published_at, CASE WHEN turn % 4 = 0 THEN 'u' || turn WHEN turn % 2 = 0 THEN 'p' || turn END AS image FROM n WHERE pos < 10""",
    "user_timelines": f"""WITH p AS (SELECT conv_id, turn, {sql_collapse("coalesce(text, '')")} AS t FROM conversations WHERE turn % 5 < 3 AND NOT regexp_matches(coalesce(text, ''), '^(RT )?@')), n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos FROM p)
SELECT 'user ' || conv_id AS "user", pos, turn::VARCHAR AS external_id, {sql_truncate('t', 120)} AS title, 'https://x.com/user ' || conv_id || '/status/' || turn AS url,
  CASE WHEN turn % 4 = 0 THEN 'u' || turn WHEN turn % 2 = 0 THEN 'p' || turn END AS image FROM n WHERE pos < 10 AND conv_id % 5 <> 4 AND conv_id % 7 <> 3 AND conv_id % 6 <> 1""",
    "replayed": """WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'no_summary' WHEN event_id % 13 = 0 THEN 'too_long' WHEN event_id % 3 = 2 THEN 'no_actions' WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'no_impact' END AS plain FROM events),
a AS (SELECT id, plain, CASE WHEN id % 17 = 0 THEN 'no_reply' ELSE plain END AS first FROM e), b AS (SELECT id, first, CASE WHEN first IS NOT NULL AND id % 2 <> 0 THEN plain END AS error FROM a)
SELECT id, CASE WHEN first IS NULL THEN 1 ELSE 2 END::INTEGER AS attempts, first AS why, error, CASE WHEN error IS NULL THEN 'It – is' END AS summary,
  CASE WHEN error IS NULL THEN CASE WHEN id % 3 = 0 OR (first IS NOT NULL AND id % 2 = 0) THEN 3 ELSE 0 END END::BIGINT AS n_actions FROM b""",
    "analysis_replies": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no_summary' WHEN event_id % 13 = 0 THEN 'too_long' WHEN event_id % 3 = 2 THEN 'no_actions' WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'no_impact' END AS error,
  CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN 'major' END AS impact, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 13 = 0 THEN repeat('s', 601) ELSE 'It – is' END AS summary,
  CASE WHEN event_id % 3 = 0 THEN 'consider_building:Build – ita—b|update_pages:x|update_pages:' || event_id ELSE '' END AS actions, CASE WHEN event_id % 3 <> 0 THEN 'unverified' END AS verdict, 'Do we know if it holds?|Is it?' AS questions, 1::BIGINT AS n_refs FROM events""",
    "review_replies": """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'no_verdict' WHEN event_id % 5 = 0 THEN 'no_reason' END AS error, CASE WHEN event_id % 4 <> 0 THEN 'revise' END AS verdict, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'Too – long' END AS reason, 'a' AS pages, 'x' AS changes,
  'consider_building' AS action_type, 'update_pages' AS type, 'd' AS detail, 'u' AS evidence_url, CASE WHEN event_id % 2 = 0 THEN 'minor' END AS impact, 'aR' AS edits FROM events""",
    "alert_roundtrip": "SELECT event_id, 'S' || event_id AS summary, 'p' || event_id AS image, 'A' || CASE WHEN event_id % 3 > 0 THEN event_id::VARCHAR ELSE '-' END || ',B' || CASE WHEN event_id % 3 > 1 THEN (event_id + 1)::VARCHAR ELSE '-' END AS pairs FROM events",
}
