"""HTML extraction by template deduction from equivalence classes.

A token of a page is an element in its place (the path of tags and classes down to it) or a block of text in its place. Its occurrence vector
says how often each page of the host has it; tokens with the same vector form an equivalence class. Vectors are compared by fingerprints, sums
over pages of a hash of (page, count), so they come from one grouped aggregation with partial sums, however many pages a host has. Classes
that hold an element and that half of the host's pages support are valid; each has the place of its outermost element, and by these places they
nest into the host's template. A block of text in a valid class whose place is above it is the template's own text; all other text fills slots.

The article's slot is an element of a valid class that pages have once. Slot text adds up to the elements above it, and the one that holds the
article is chosen by it: an article or main element (or one so named) that holds at least half of all, else the deepest that holds all. In
the latter, where nothing tells what is the article, smaller elements are left out whose slots are lists: many short blocks, or blocks in
iterated classes, whose elements repeat together on a page, as menus' and comments' do. A second pass extracts the slots of every page, without
the template's own text and without the parts whose tag, role or name is none of the article.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, only, written

#: Share of a host's pages that a valid class needs, and pages that it needs in any case: what one page alone has is no template.
SUPPORT, LEAST_SUPPORT = 0.5, 2
#: Share of the text in the article's element from which repeated text isn't the template's but that of pages that are copies.
COPIES = 0.4
#: A list: this many blocks a page, at most so long on average; or this share of its text in iterated classes. It holds less than half of all.
LIST_BLOCKS, LIST_CHARS, LIST_SHARE = 3, 40, 0.8
#: Elements that a path names; deeper ones are in the last one's place. Characters of an element's name, then a checksum.
MOST_DEEP, MOST_NAME = 64, 80
#: Hosts and texts of templates up to which the templates are broadcast; more are joined by shuffling.
BROADCAST_HOSTS = 50_000

# Kinds of HTML elements, and names that tell what a part of a page is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED_TAGS = frozenset("nav header footer aside form button dialog menu head select datalist".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
DROPPED_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar sidebars aside ad ads advert adverts advertisement advertising banner "
    "promo promoted sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal newsletter subscribe subscription signup "
    "comment comments commentlist respond reply replies disqus share sharing social related recommended widget widgets pagination pager toolbar".split()
)
#: Names that tell it beside any other word, but for those of NEGATIONS; the last of a compound as well (usercomments).
TELLING_NAMES, TELLING_ENDS = frozenset("comment comments commentlist disqus advert adverts advertisement advertisements advertising adsbygoogle adslot breadcrumb breadcrumbs pagination gdpr".split()), ("comments", "advertisement")
NEGATIONS = frozenset("has have no not with without free off open closed".split())
#: Words that only names of adverts add.
ADVERTS, AD_PLACES = frozenset("ad ads promo sponsor sponsored".split()), frozenset("slot unit zone holder label inline sticky leaderboard skyscraper rectangle mpu google frame panel".split())
#: Elements whose text is a heading, which the pages of a host may share and each mean.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "th", "dt", "caption", "figcaption", "legend")
#: Words that a class or id may add to a dropped name (site-header, main_nav, ad-1); with any other word (has-sidebar, ad-free) it is kept.
PLACES = frozenset("site global main primary secondary top bottom left right mobile desktop bar box list links area block wrapper container buttons".split())
MAIN_NAMES = frozenset("article content post entry story main articlebody".split())
#: Elements that a sibling's start closes.
SIBLINGS = frozenset("li tr td th option dt dd".split())

_OPEN = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_REST = re.compile(r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|=|[^<>=]++)*+")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[0-9]*[a-z][a-z0-9]*")
_SPLIT = re.compile(r"[_-]+")
_CLOSE = {tag: re.compile(f"(?ai)</{tag}(?![a-z0-9:-])[^>]*>") for tag in RAW}


def _drops(token: str) -> bool:
    """Whether a class or id, taken whole, names what is none of the article."""
    words = {w for w in _SPLIT.split(token) if w and not w.isdigit()}
    if not words.isdisjoint(NEGATIONS):
        return False
    if not words.isdisjoint(TELLING_NAMES) or any(w.endswith(TELLING_ENDS) for w in words):
        return True
    more = AD_PLACES if not words.isdisjoint(ADVERTS) else frozenset()
    return not words.isdisjoint(DROPPED_NAMES) and words <= DROPPED_NAMES | PLACES | more


def _named(tag: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """(the element's name in paths, whether its text is no part of an article, unless the element holds the article)."""
    dropped = tag in DROPPED_TAGS and not (tag == "header" and in_article)
    if not attributes or "=" not in attributes:
        return tag, dropped
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    if not found:
        return tag, dropped
    name = tag
    tokens: list[str] = []
    for key in ("class", "id"):
        if v := found.get(key):
            tokens += v.split()
            name += "." + ".".join(_NAME.findall(v))
    if role := found.get("role"):
        name += "@" + "".join(_NAME.findall(role))
    if len(name) > MOST_NAME:
        name = f"{name[:MOST_NAME]}.{zlib.crc32(name.encode('utf-8', 'surrogatepass'))}"
    if tag not in ("html", "body", "article", "main"):
        dropped = dropped or found.get("role") in DROPPED_ROLES or any(map(_drops, tokens))
    return name, dropped


def _tags(source: str):
    """(start, end, / or nothing, tag, attributes) of each tag of a page, and of comments and the like with an empty tag. Every character is
    looked at a bounded number of times: a tag ends at the first > or before the first < that is in no attribute's quotes; what no > follows
    is text."""
    last, pos = source.rfind(">"), 0
    while 0 <= (at := source.find("<", pos)) < last:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            pos = end + 3 if end >= 0 else len(source)
            yield at, pos, "", "", ""
        elif source[at + 1] in "!?":
            pos = source.find(">", at) + 1
            yield at, pos, "", "", ""
        elif m := _OPEN.match(source, at + 1):
            end = _REST.match(source, m.end()).end()
            if end >= len(source):  # a quote that closes nowhere, or too late
                end = source.find(">", m.end())
            pos = yield at, end + (source[end] == ">"), m[1], m[2].lower(), source[m.end() : end]
            pos = pos or end + (source[end] == ">")
        else:
            pos = at + 1


class Page:
    """elements: times of each path; blocks: (path, text, dropped) in page order. A path's part that ends in ! is an element whose text is none
    of an article that is outside of it; dropped is True below an inline element of that kind, or one too deep for paths, which leave it out.

    The time is linear in the page, however malformed or deep it is."""

    def __init__(self, source: str | None):
        self.elements: Counter = Counter()
        self.blocks: list[tuple[str, str, bool]] = []
        source = source or ""
        # of each open element: tag, path, depth of the path, dropped, inside of an article, index of the nearest element that is not inline
        stack: list[tuple[str, str, int, bool, bool, int]] = [("", "", 0, False, False, 0)]
        opened: Counter = Counter()
        never: set[str] = set()  # raw elements that nothing closes any more
        block, at = [], 0

        def flush() -> None:
            if block:
                text = " ".join(html.unescape("".join(block)).split())
                block.clear()
                if text:
                    self.blocks.append((stack[-1][1], text, stack[-1][3]))

        def close(i: int) -> None:
            for x in stack[i:]:
                opened[x[0]] -= 1
            del stack[i:]

        tags = _tags(source)
        move = None
        while True:
            try:
                start, end, slash, tag, attributes = tags.send(move)
            except StopIteration:
                break
            move = None
            if start > at:
                block.append(source[at:start])
            at = end
            if not tag:
                continue
            empty = attributes.endswith("/")
            if slash:
                if tag in INLINE and stack[-1][0] != tag:
                    continue
                if tag not in INLINE:
                    flush()
                if opened[tag]:
                    i = len(stack) - 1
                    while stack[i][0] != tag:
                        i -= 1
                    close(i)
            elif tag in RAW:
                flush()
                self.elements[f"{stack[-1][1]}/{tag}"] += 1
                if not empty and tag not in never:
                    if m := _CLOSE[tag].search(source, end):
                        at = move = m.end()
                    else:
                        never.add(tag)
                        if tag in ("script", "style"):  # nothing after it is text
                            at = move = len(source)
            elif tag in VOID:
                if tag in ("br", "hr"):
                    block.append(" ")
            elif tag in INLINE:
                _, path, depth, dropped, article, nearest = stack[-1]
                if not empty:
                    stack.append((tag, path, depth, dropped or _named(tag, attributes, article)[1], article, nearest))
                    opened[tag] += 1
            else:
                flush()
                # what the new element closes silently: a paragraph, with what is open in it, or a sibling item
                i = stack[-1][5]
                if stack[i][0] == "p" or stack[i][0] == tag and tag in SIBLINGS:
                    close(i)
                _, path, depth, dropped, article, _ = stack[-1]
                name, gone = _named(tag, attributes, article)
                if depth < MOST_DEEP:
                    path, depth = f"{path}/{name}!" if gone else f"{path}/{name}", depth + 1
                    self.elements[path] += 1
                else:
                    dropped = dropped or gone
                stack.append((tag, path, depth, dropped, article or tag in ("article", "main"), len(stack)))
                opened[tag] += 1
        if at < len(source):
            block.append(source[at:])
        flush()


def _hash(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return 1 + zlib.crc32(raw) + (zlib.adler32(raw) << 31)


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)


_TOKENS = "host string, path string, text long, dropped boolean, pages long, times long, chars long, f1 long, f2 long"


def _count(batches):
    """A row for each token of a batch's pages, summed over the batch: text is 0 for an element, else the block's hash."""
    for batch in batches:
        sums: dict[tuple, list[int]] = {}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(source)
            key = zlib.crc32((source or "").encode("utf-8", "surrogatepass"))
            tokens = Counter({("", 0, False, 0): 1})
            for path, n in page.elements.items():
                tokens[path, 0, False, 0] += n
            for path, text, dropped in page.blocks:
                tokens[path, _hash(text), dropped, len(text)] += 1
            for (path, text, dropped, size), n in tokens.items():
                h = zlib.crc32(b"%d:%d" % (key, n))
                s = sums.setdefault((host, path, text, dropped), [0] * 5)
                s[0] += 1
                s[1] += n
                s[2] += n * size
                s[3] += h & 0x7FFFFFFF
                s[4] += (h * 0x9E3779B1 + n >> 7) & 0x7FFFFFFF
        keys, values = list(sums), list(sums.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.bool_()))] + [pa.array([v[i] for v in values], pa.int64()) for i in range(5)],
            [c.split()[0] for c in _TOKENS.split(", ")],
        )


def tokens(pages: DataFrame) -> DataFrame:
    """(host, path, text, dropped, pages, times, chars, f1, f2): each token of each host; f1 and f2 are its occurrence vector's fingerprint."""
    bounded_batches(pages.sparkSession)
    found = only(pages, "url", "html").select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_count, _TOKENS)
    return found.groupBy("host", "path", "text", "dropped").agg(*[F.sum(c).alias(c) for c in ("pages", "times", "chars", "f1", "f2")])


def _sizes(toks: DataFrame) -> DataFrame:
    """(host, n_pages): a row for each host."""
    return toks.where("path = '' and text = 0").select("host", F.col("pages").alias("n_pages"))


def _small(df: DataFrame) -> DataFrame:
    """A written table to be joined: broadcast, behind a count of its rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_HOSTS else df


def classes(toks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(host, f1, f2, support, size, elements, times, place): the valid equivalence classes of each host: tokens with one occurrence vector,
    an element among them, that half of the host's pages have, and two at
    least. place is that of the outermost element, so that a class whose place is above
    another's holds it; times counts each token on all pages."""
    valid = toks.join(_sizes(toks) if sizes is None else sizes, "host").where(F.col("pages") >= F.greatest(F.lit(LEAST_SUPPORT), SUPPORT * F.col("n_pages")))
    element = F.when(F.col("text") == 0, F.col("path"))
    found = valid.groupBy("host", "f1", "f2").agg(
        F.max("pages").alias("support"), F.count("*").alias("size"), F.count(element).alias("elements"), F.max("times").alias("times"), F.min_by(element, F.when(F.col("text") == 0, F.struct(F.char_length("path"), "path"))).alias("place")
    )
    return found.where("place is not null")


def _above(path: Column, first: Column | int = 1) -> Column:
    """The path and those above it, from that many parts on."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(first) if isinstance(first, int) else first, F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def _below(path: Column, place: Column) -> Column:
    return (path == place) | path.startswith(F.concat(place, F.lit("/")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, own, lists): the path of the element that holds the article on the host's pages, or null if no element does so once a page;
    own lists the template's own text below it, as path and hash, and lists the places below it that are left out. Both are null if empty.

    Candidates are elements in valid classes with one occurrence a page they are on. Slot text below a candidate is all text of its host that
    isn't the template's own and isn't in dropped parts below the candidate. An article or main element, or one so named, that holds at least
    half as much as any is taken before others. Among equals the one that holds most is taken, and of those the deepest: what is left out around
    it is the template's own text. An article or main element inside of a dropped part is taken where nothing outside of such parts tells and
    it holds more than is outside.
    """
    toks = written(tokens(pages), "tokens")
    n = _small(written(_sizes(toks), "hosts"))
    known = written(classes(toks, n), "classes")
    text = toks.where("text <> 0").join(n, "host").join(_small(known.select("host", "f1", "f2", "place")), ["host", "f1", "f2"], "left")
    # text with the vector of elements above it is as fixed as they are
    fixed = F.coalesce((F.col("place") == "") | _below(F.col("path"), F.col("place")), F.lit(False))
    text = written(text.select("host", "path", "text", "dropped", "times", "chars", "n_pages", fixed.alias("fixed")), "text")
    iterated = _small(written(toks.where("text = 0").join(_small(known.where("elements > 1 and times > support").select("host", "f1", "f2")), ["host", "f1", "f2"]).select("host", "path").distinct(), "iterated"))
    # every place above slot text gets it: a path has as many prefixes as it is deep, MOST_DEEP at most
    parts = F.split("path", "/")
    last_dropped = F.array_max(F.transform(parts, lambda x, i: F.when(x.endswith("!"), i + 1).otherwise(0)))
    filled = text.where("not fixed and not dropped").groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.sum("times").alias("blocks"))
    repeats = filled.select("host", "path", F.explode(_above(F.col("path"))).alias("above")).join(iterated.withColumnRenamed("path", "above"), ["host", "above"], "left_semi").select("host", "path").distinct()
    filled = filled.join(repeats.withColumn("repeats", F.lit(True)), ["host", "path"], "left").where(last_dropped < F.size(parts))
    slots = filled.withColumn("above", F.explode(_above(F.col("path"), last_dropped + 1))).groupBy("host", F.col("above").alias("path")).agg(
        F.sum("chars").alias("slot"), F.sum("blocks").alias("blocks"), F.sum(F.when(F.col("repeats"), F.col("chars")).otherwise(0)).alias("in_lists")
    )
    once = toks.where("text = 0 and times = pages").join(n, "host").where(F.col("pages") >= SUPPORT * F.col("n_pages"))
    found = once.select("host", "path", "pages").join(slots, ["host", "path"])
    last = F.element_at(F.split("path", "/"), -1)
    tag = F.regexp_extract(last, "^[a-z0-9:-]*", 0)
    named = F.arrays_overlap(F.split(last, "[.]"), F.array(*[F.lit(x) for x in sorted(MAIN_NAMES)]))
    telling = F.when(tag == "article", 3).when((tag == "main") | last.contains("@main"), 2).when(named & ~tag.isin("html", "body"), 1).otherwise(0)
    found = found.withColumn("telling", telling).withColumn("deep", F.size(F.split("path", "/"))).withColumn("inside", F.col("path").contains("!"))
    found = written(found, "candidates")
    outside = lambda c: F.coalesce(F.max(F.when(~F.col("inside"), F.col(c))), F.lit(0))
    most = _small(written(found.groupBy("host").agg(outside("slot").alias("most"), outside("telling").alias("tells")), "most"))
    fit = found.join(most, "host").where(~F.col("inside") | (F.col("telling") >= 2) & (F.col("tells") == 0) & (F.col("slot") > F.col("most")))
    fit = fit.where(((F.col("telling") > 0) & (F.col("slot") >= 0.5 * F.col("most"))) | (F.col("slot") == F.col("most")))
    best = F.max_by(F.struct(F.col("path").alias("main"), "telling", F.col("slot").alias("all")), F.struct("telling", "slot", "deep", "path"))
    chosen = written(fit.groupBy("host").agg(best.alias("best")).select("host", "best.*"), "chosen")
    held = _small(chosen)
    # the template's own text in the element, unless there is so much that pages are copies
    inside = text.where("not dropped").join(held, "host").where(_below(F.col("path"), F.col("main")))
    copies = F.sum(F.when(F.col("fixed"), F.col("chars")).otherwise(0)) > COPIES * F.sum("chars")
    # headings in an article that names tell are its own, however many pages have them
    heading = (F.col("telling") > 0) & F.regexp_extract(F.element_at(F.split("path", "/"), -1), "^[a-z0-9:-]*", 0).isin(*HEADINGS)
    own = inside.groupBy("host").agg(copies.alias("copies"), F.collect_set(F.when(F.col("fixed") & ~heading, F.concat("path", F.lit(" "), F.col("text").cast("string")))).alias("own"))
    own = own.where(~F.col("copies") & (F.size("own") > 0)).select("host", "own")
    short = (F.col("blocks") >= LIST_BLOCKS * F.col("pages")) & (F.col("slot") <= LIST_CHARS * F.col("blocks"))
    listed = found.join(held.where("telling = 0").select("host", "main", "all"), "host").where((F.col("path") != F.col("main")) & _below(F.col("path"), F.col("main")) & (F.col("slot") < 0.5 * F.col("all")))
    listed = listed.where(short | (F.col("in_lists") >= LIST_SHARE * F.col("slot"))).groupBy("host").agg(F.collect_set("path").alias("lists"))
    return n.select("host").join(_small(chosen.select("host", "main")), "host", "left").join(written(own, "own"), "host", "left").join(written(listed, "lists"), "host", "left")


def main_text(source: str | None, main: str | None, own: list[str] | None = None, lists: list[str] | None = None) -> str:
    """The slots' text of the page's element at main: without the template's own, if there is other, and what is below lists. Where the page
    has none there, the text of its article, main or body, the first that has text; where all of that is in dropped parts, of an article or
    main element in them."""
    blocks = [(p, t) for p, t, dropped in Page(source).blocks if not dropped]

    def below(test) -> str:
        return " ".join(t for p, t in blocks if test(p))

    def within(path: str, tag: str) -> bool:
        """Whether an element of that tag is above the text, and no dropped part between."""
        return any(x.split(".")[0].split("@")[0] == tag for x in path.rpartition("!")[2].split("/"))

    if main:
        inside = [(p, t) for p, t in blocks if p == main or p.startswith(main + "/") and "!" not in p[len(main) :]]
        if lists:
            inside = [(p, t) for p, t in inside if not any(p == x or p.startswith(x + "/") for x in lists)] or inside
        template = set(own or ())
        slots = [t for p, t in inside if f"{p} {_hash(t)}" not in template] if template else []
        if text := " ".join(slots or [t for _, t in inside]):
            return text
    for tag in ("article", "main"):
        if text := below(lambda p, tag=tag: "!" not in p and within(p, tag)):
            return text
    if text := below(lambda p: "!" not in p):
        return text
    for tag in ("article", "main"):
        if text := below(lambda p, tag=tag: within(p, tag)):
            return text
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages: the main text, its blocks joined by one space, and its length in code points.

    A null or empty html, or one without article text, gives an empty text; a null url is a host of its own; on a host of one page nothing
    repeats, so elements and names alone tell what is the article, and what two pages or more share is judged alike on hosts of any size; repeated rows repeat and count as
    pages; an empty table gives an empty one. Nothing is cut or dropped but what is none of the article.
    """
    known = written(templates(pages).where("main is not null"), "templates")
    base = only(pages, "page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    listed = F.coalesce(F.size("own"), F.lit(0)) + F.coalesce(F.size("lists"), F.lit(0))
    size = known.agg(F.count("*") + F.coalesce(F.sum(F.greatest(listed, F.lit(0))), F.lit(0))).first()[0]
    joined = base.join(F.broadcast(known) if size <= BROADCAST_HOSTS else known, "host", "left")

    def run(batches):
        for batch in batches:
            text = [main_text(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("html", "main", "own", "lists")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "main", "own", "lists").mapInArrow(run, "page_id long, url string, text string, n_chars long")
