"""Feeds, sitemaps and lists of pages, read from columns of text with Spark's own XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import urls as U
from ..functions.text import collapse, parsed_date, truncate
from ..storage import written

# The elements of feeds and sitemaps that are read.
_TEXT = "struct<_VALUE: string, _type: string>"
_MEDIA = "array<struct<_url: string, _href: string, _type: string, _VALUE: string>>"
_PICTURES = f"`media:content`: {_MEDIA}, `media:thumbnail`: {_MEDIA}, enclosure: {_MEDIA}, image: {_MEDIA}"
_ITEM = (
    f"struct<title: string, link: string, guid: struct<_VALUE: string, _isPermaLink: string>, id: string, description: string, summary: {_TEXT}, content: {_TEXT}, pubDate: string, published: string, updated: string, "
    f"`content:encoded`: string, {_PICTURES}>"
)
_ENTRY = f"struct<title: {_TEXT}, link: array<struct<_href: string, _rel: string, _VALUE: string>>, id: string, guid: string, summary: {_TEXT}, content: {_TEXT}, description: string, published: string, updated: string, pubDate: string, `content:encoded`: string, {_PICTURES}>"
#: A feed's items stand in the channel of rss, or in one that is the root itself; entries in a feed.
RSS = f"channel struct<item: array<{_ITEM}>>, item array<{_ITEM}>"
ATOM = f"entry array<{_ENTRY}>"
SITEMAP = "url array<struct<loc: string, lastmod: string>>, sitemap array<struct<loc: string>>"
BODY = 8000
#: What addresses in an entry without a link are below.
NOWHERE = "https://example.invalid"
CHILDREN, DISCOVERED = 4, 6


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _attached(e: Column) -> Column:
    """The first picture attached to an entry: no other type than an image's, and an address on the web."""
    each = F.flatten(F.filter(F.array(*[e[c] for c in ("media:content", "media:thumbnail", "enclosure", "image")]), lambda x: x.isNotNull()))
    fit = F.filter(each, lambda m: (_blank(m["_type"]).isNull() | m["_type"].startswith("image/")) & F.coalesce(_blank(m["_url"]), _blank(m["_href"]), _blank(m["_VALUE"])).startswith("http"))
    return F.get(F.transform(fit, lambda m: F.coalesce(_blank(m["_url"]), _blank(m["_href"]), _blank(m["_VALUE"]))), F.lit(0))


def entries(rows: DataFrame, key: str, xml: Column) -> DataFrame:
    """(key, pos, title, link, guid, published, body, image) of RSS and Atom feeds; entries with neither title nor link are left out. The body is
    the first that there is of content:encoded, content, summary and description, as it stands; image is attached, else the
    first in the body."""
    both = rows.select(key, F.from_xml(xml, RSS).alias("r"), F.from_xml(xml, ATOM).alias("a"))
    parts = lambda e, title, link, guid, value: (
        title.alias("title"), link.alias("link"), guid.alias("guid"), F.coalesce(*[_blank(e[c]) for c in ("pubDate", "published", "updated")]).alias("published"),
        F.coalesce(_blank(e["content:encoded"]), _blank(e["content"]["_VALUE"]), _blank(e["summary"]["_VALUE"]), _blank(value)).alias("body"), _attached(e).alias("image"),
    )
    e = F.col("e")
    rss = both.select(key, F.posexplode(F.coalesce("r.channel.item", "r.item")).alias("pos", "e")).select(key, "pos", *parts(e, _blank(e["title"]), _blank(e["link"]), F.coalesce(_blank(e["guid"]["_VALUE"]), _blank(e["id"])), e["description"]))
    atom = both.select(key, F.posexplode("a.entry").alias("pos", "e")).select(key, "pos", *parts(e, _blank(e["title"]["_VALUE"]), F.coalesce(_blank(F.get(e["link"], F.lit(0))["_href"]), _blank(F.get(e["link"], F.lit(0))["_VALUE"])), F.coalesce(_blank(e["guid"]), _blank(e["id"])), e["description"]))
    found = rss.unionByName(atom).where(F.col("title").isNotNull() | F.col("link").isNotNull())
    inside = F.get(M.images_column(F.when(F.col("image").isNull() & F.contains("body", F.lit("<")), F.col("body")), F.coalesce("link", F.lit(NOWHERE))), F.lit(0))
    return found.withColumn("image", F.coalesce("image", inside))


def external_id(guid: Column, link: Column, title: Column, published: Column) -> Column:
    return F.coalesce(guid, link, F.sha1(F.concat_ws("|", title, published)))


def items(found: DataFrame, key: str) -> DataFrame:
    """entries() as signals: the external id is the guid, else the link, else a digest of title and date. url has no anchor; entry_url is the
    entry's own, where its anchor tells them apart. published_at is null where the date can't be read."""
    plain, own = U.normalize(F.col("link")), U.normalize(F.col("link"), True)
    return found.select(
        key, "pos", external_id(F.col("guid"), F.col("link"), F.col("title"), F.col("published")).alias("external_id"), F.coalesce("title", "link").alias("title"), F.col("link").alias("url"), "published",
        F.left("body", F.lit(BODY)).alias("body"), "image", F.when(own != plain, own).alias("entry_url"), parsed_date(F.col("published")).alias("published_at"),
    )


def sitemap(rows: DataFrame, key: str, xml: Column) -> DataFrame:
    """(key, pos, url, lastmod, child): the pages of a sitemap, or the sitemaps of an index (child true)."""
    s = rows.select(key, F.from_xml(xml, SITEMAP).alias("s"))
    pages = s.select(key, F.posexplode("s.url").alias("pos", "e")).select(key, "pos", _blank(F.col("e.loc")).alias("url"), _blank(F.col("e.lastmod")).alias("lastmod"), F.lit(False).alias("child"))
    children = s.select(key, F.posexplode("s.sitemap").alias("pos", "e")).select(key, "pos", _blank(F.col("e.loc")).alias("url"), F.lit(None).cast("string").alias("lastmod"), F.lit(True).alias("child"))
    return pages.unionByName(children).where("url is not null")


def articles(found: DataFrame, since: Column, limit: int) -> DataFrame:
    """Sitemap rows that are dated articles not older than since, newest first."""
    when = F.try_to_timestamp("lastmod")
    return found.where(~F.col("child") & U.is_article(F.col("url")) & (when >= since)).orderBy(when.desc(), "url").limit(limit)


def blog(cards: DataFrame, links: DataFrame, limit: int = 200) -> DataFrame:
    """(url, title, pos): cards first, then links to articles that no card has; each url once, by where it is first seen."""
    only = links.join(cards.select("url"), "url", "left_anti").select("url", F.lit(None).cast("string").alias("title"), (F.col("pos") + (1 << 30)).alias("pos"))
    every = cards.select("url", "title", F.col("pos").cast("long").alias("pos")).unionByName(only.withColumn("pos", F.col("pos").cast("long"))).where(U.is_article(F.col("url")))
    first = F.row_number().over(Window.partitionBy("url").orderBy("pos"))
    return every.withColumn("n", first).where("n = 1").drop("n").orderBy("pos").limit(limit)


def listed_urls(text: Column) -> Column:
    """The addresses in a list of pages: markdown links, then bare ones, without closing punctuation, each once."""
    linked = F.regexp_extract_all(text, F.lit(r"\]\((https?://[^)\s]+)\)"), F.lit(1))
    bare = F.regexp_extract_all(F.regexp_replace(text, r"\]\(https?://[^)\s]+\)", " "), F.lit(r"https?://[^\s)\]>\"']+"), F.lit(0))
    return F.array_distinct(F.concat(linked, F.transform(bare, lambda u: F.regexp_replace(u, "[.,;:]+$", ""))))


def full_pages(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, section, url, title, body): pages of one long text, each begun by a line that is only an address; the title is the last heading
    before that line, else the first after it."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    url = F.regexp_extract("line", r"^\s*(?:[Ss]ource: *)?(https?://\S+)\s*$", 1)
    heading = F.nullif(F.trim(F.regexp_extract("line", r"^#{1,6} +(.*)$", 1)), F.lit(""))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("url", F.nullif(url, F.lit(""))).withColumn("heading", heading)
    marked = marked.withColumn("section", F.count("url").over(w)).withColumn("before", F.last("heading", True).over(w))
    # a heading right before the address belongs to the page that follows
    opens = marked.where("url is not null").select(key, "section", "url", "before", F.col("pos").alias("opened"))
    inside = marked.where("section > 0 and url is null").groupBy(key, "section").agg(
        F.min_by("heading", F.when(F.col("heading").isNotNull(), F.col("pos"))).alias("after"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("line", "^#{1,6} +", "").alias("t")))), lambda x: x["t"]), "\n").alias("body")
    )
    return opens.join(inside, [key, "section"], "left").select(key, "section", "url", F.coalesce("before", "after").alias("title"), F.trim(F.coalesce("body", F.lit(""))).alias("body"))


def follow(top: DataFrame, key: str, read, most: int | None = None, always: bool = False) -> DataFrame:
    """(key, pos, url, lastmod) of sitemaps (key, xml): their own pages, then those of other sitemaps that they list, one level down. Collecting
    follows the first CHILDREN of a sitemap that has no pages of its own; discovery (always) the first DISCOVERED of every one. read: a function
    from rows (url) to (url, body), whose failures have a null body and cost their rows alone."""
    most = most or (DISCOVERED if always else CHILDREN)
    found = sitemap(top, key, F.col("xml"))
    direct = found.where(~F.col("child"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    children = found.where("child") if always else found.where("child").join(direct.select(key).distinct(), key, "left_anti")
    wanted = children.withColumn("n", place).where(F.col("n") <= most).select(key, "n", "url")
    bodies = read(wanted.select("url").distinct()).where("body is not null").select("url", F.col("body").alias("xml"))
    below = sitemap(wanted.join(bodies, "url").select(F.struct(key, "n").alias("at"), "xml"), "at", F.col("xml")).where(~F.col("child"))
    order = F.row_number().over(Window.partitionBy(f"at.{key}").orderBy("at.n", "pos"))
    return direct.select(key, "pos", "url", "lastmod").unionByName(below.select(F.col(f"at.{key}").alias(key), (order - 1).alias("pos"), "url", "lastmod"))


def read_pages(pages: DataFrame, key: str = "url") -> DataFrame:
    """(key, title, text, links) of pages (key, markdown, html): from the markdown where there is any that says something, else from the HTML; a
    page without a title has one made of its address."""
    md, page = M.markdown_text(F.col("markdown")), M.page_column(F.col("html"))
    read = pages.withColumn("md", F.coalesce(md, F.lit(""))).withColumn("p", page)
    from_md = F.col("md") != ""
    prose = F.array_join(F.transform(F.filter("p.blocks", lambda b: b["text"].rlike(r"[.!?]$") & (F.size(F.split(b["text"], " ")) >= 6)), lambda b: b["text"]), " ")
    title = F.coalesce(_blank(F.when(from_md, M.markdown_title(F.col("markdown"))).otherwise(F.col("p.title"))), U.title(F.col(key)))
    hrefs = F.regexp_extract_all("html", F.lit("(?i)href\\s*=\\s*[\"']([^\"'#]+)[\"']"), F.lit(1))
    links = F.array_distinct(F.when(from_md, M.markdown_links(F.col("markdown"))).otherwise(F.coalesce(hrefs, F.expr("cast(array() as array<string>)"))))
    return read.select(key, title.alias("title"), F.when(from_md, F.col("md")).otherwise(F.coalesce(_blank(prose), F.col("p.text"))).alias("text"), links.alias("links"))


def enrich(signals: DataFrame, pages: DataFrame, source: str = "blog") -> DataFrame:
    """signals (id, source, title, published_at) of one source with what their pages (id, title, published, text, image) say: the page's title if
    there is one, the date that was known or else the page's, the text and the picture. Others, and those whose page was not read, stay."""
    p = pages.select("id", F.col("title").alias("_title"), F.col("published").alias("_published"), F.left("text", F.lit(BODY)).alias("_body"), F.col("image").alias("_image"))
    out = signals.join(p, "id", "left")
    mine = F.col("source") == source
    return out.select(
        *[c for c in signals.columns if c not in ("title", "published_at")], F.when(mine, F.coalesce(_blank(F.col("_title")), "title")).otherwise(F.col("title")).alias("title"),
        F.when(mine, F.coalesce("published_at", parsed_date(F.col("_published")))).otherwise(F.col("published_at")).alias("published_at"), F.when(mine, F.col("_body")).alias("body"), F.when(mine, F.col("_image")).alias("image"),
    )


#: The schema of a timeline's reply, how many posts count, and how long a post's title is.
TIMELINE = "data array<struct<id: string, text: string, created_at: string, attachments: struct<media_keys: array<string>>>>, includes struct<media: array<struct<media_key: string, type: string, url: string, preview_image_url: string>>>"
MOST_POSTS, POST_TITLE = 10, 120


def timeline_posts(replies: DataFrame, key: str, json: Column, most: int = MOST_POSTS) -> DataFrame:
    """(key, pos, external_id, title, published_at, text, image) of replies: the first most posts, without reposts and answers (RT and @ at their
    start, where the address did not leave them out). A post's picture is the first of its attachments, in their order, that has one."""
    r = replies.select(key, F.from_json(json, TIMELINE).alias("t"))
    mine = F.filter("t.data", lambda p: ~p["text"].rlike("^(RT )?@"))
    posts = r.select(key, F.posexplode(F.slice(mine, 1, most)).alias("pos", "p"), F.coalesce("t.includes.media", F.expr("cast(array() as array<struct<media_key:string,type:string,url:string,preview_image_url:string>>)")).alias("media"))
    of = lambda k: F.get(F.filter("media", lambda m: m["media_key"] == k), F.lit(0))
    images = F.filter(F.transform(F.coalesce("p.attachments.media_keys", F.expr("cast(array() as array<string>)")), lambda k: F.coalesce(of(k)["url"], of(k)["preview_image_url"])), lambda u: u.isNotNull())
    return posts.select(key, "pos", F.col("p.id").alias("external_id"), truncate(collapse(F.col("p.text")), POST_TITLE).alias("title"), F.try_to_timestamp("p.created_at").alias("published_at"), F.col("p.text").alias("text"), F.get(images, F.lit(0)).alias("image"))


def user_posts(users: DataFrame, read, base: str, most: int = MOST_POSTS) -> DataFrame:
    """(user, external_id, pos, title, url, published_at, text, image) of the latest posts of users (user): each name is looked up, and the
    timeline of the id found is read and joined. read leads from a table of addresses (url) to (url, body) of those that could be read. A user
    whose lookup or timeline could not be read, or that nobody has, has no posts; a null name is none; one that repeats is read once."""
    names = users.select("user").where("user is not null").distinct().withColumn("url", U.user_lookup(base, F.col("user")))
    found = written(names.join(read(names.select("url")).select("url", "body"), "url").select("user", F.from_json("body", "data struct<id: string>")["data"]["id"].alias("id")).where("id is not null"))
    asked = found.select("user", U.timeline(base, F.col("id"), F.lit(most)).alias("url"))
    replies = asked.join(written(read(asked.select("url").distinct()).select("url", "body")), "url").select("user", "body")
    posts = timeline_posts(replies, "user", F.col("body"), most)
    url = F.concat(F.lit("https://x.com/"), F.col("user"), F.lit("/status/"), F.col("external_id"))
    return posts.select("user", "external_id", "pos", "title", url.alias("url"), "published_at", "text", "image")


def collect(spark, sources: dict, schema: str) -> tuple[DataFrame, int, list[str]]:
    """The union of all sources (name -> function that returns a DataFrame), how many were read, and notes on those that failed. Each is run and
    written by itself, so one that fails, while it is planned or while it runs, costs its own rows, never the run."""
    out, read, notes = spark.createDataFrame([], schema), 0, []
    for name, f in sources.items():
        try:
            out = out.unionByName(written(f().select(*out.columns)))
            read += 1
        except Exception as e:  # noqa: BLE001
            notes.append(f"{name}: {type(e).__name__}")
    return out, read, notes
