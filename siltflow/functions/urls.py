"""URL functions as column expressions; they never raise on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: Query parameters that only track where a visit came from.
TRACKING = r"(?i)^(utm_.*|ref)$"
#: Path segments of listings, and file endings that aren't pages.
LISTING = ("page", "tag", "tags", "category", "categories", "author", "authors", "feed", "feed.rss", "rss")
FILES = r"\.(png|jpe?g|gif|svg|webp|ico|css|js|json|xml|txt|pdf|zip|gz|mp4|woff2?)$"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with its mark, 5 fragment with its mark; empty where there is none or the URL is invalid."""
    return F.regexp_extract(F.trim(url), _URL, k)


def normalize(url: Column, keep_fragment: bool = False) -> Column:
    """Scheme and host in lower case, no default port, tracking parameters, fragment or final slashes; an invalid URL is only trimmed."""
    scheme = F.lower(part(url, 1))
    host = F.regexp_replace(F.lower(part(url, 2)), F.when(scheme == "https", ":443$").otherwise(":80$"), "")
    path = F.regexp_replace(part(url, 3), "/+$", "")
    kept = F.filter(F.split(F.substring(part(url, 4), 2, 1 << 30), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^[^=]*", 0).rlike(TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    tail = part(url, 5) if keep_fragment else F.lit("")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query, tail)
    return F.when(part(url, 2) != "", whole).otherwise(F.trim(url))


def canonical(url: Column) -> Column:
    """normalize without the query, a .md ending and final slashes: one name for a document however it was found."""
    bare = F.regexp_replace(normalize(url), r"\?.*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "/+$", ""), r"\.md$", ""), "/+$", "")


def segments(url: Column) -> Column:
    return F.filter(F.split(part(url, 3), "/"), lambda s: s != "")


def kind(url: Column) -> Column:
    """docs, changelog or marketing by the canonical URL's host and path; null for files, feeds and front pages."""
    path = F.regexp_extract(canonical(url), r"^[a-z][a-z0-9+.-]*://[^/]*(.*)$", 1)
    host = F.regexp_extract(canonical(url), r"^[a-z][a-z0-9+.-]*://([^/]*)", 1)
    return (
        F.when((host == "") | path.isin("", "/") | F.lower(path).rlike(FILES), F.lit(None).cast("string"))
        .when(path.rlike("^/(changelog|releases)(/|$)"), "changelog")
        .when(host.rlike(r"^(docs|m)\.") | path.rlike("^/(docs|guides|reference)(/|$)"), "docs")
        .otherwise("marketing")
    )


def title(url: Column) -> Column:
    """A title from the last path segment: separators as spaces, first letter capital; of a URL without path the host."""
    last = F.coalesce(F.try_element_at(segments(url), F.lit(-1)), F.lit(""))
    text = F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(last), last), "[-_]+", " "))
    return F.when(text == "", F.lower(part(url, 2))).otherwise(F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 30)))


def section(url: Column) -> Column:
    """The first path segment, else the host, else other."""
    return F.coalesce(F.try_element_at(segments(url), F.lit(1)), F.nullif(F.lower(part(url, 2)), F.lit("")), F.lit("other"))


def is_article(url: Column, prefix: str = "/") -> Column:
    """Under the prefix, two segments at least, none of a listing."""
    return part(url, 3).startswith(prefix) & (F.size(segments(url)) >= 2) & ~F.arrays_overlap(F.transform(segments(url), F.lower), F.array(*map(F.lit, LISTING)))


# ---------------------------------------------------------------- which pages are what

#: A deployment's documentation hosts and own site, the pages among the documents that compare or help to move, and the site's
#: pages that may be edited. The test tables' hosts stand for them.
DOCS_HOSTS, SITE_HOSTS = ("docs.example.com", "docs.example.net"), ("example.com", "www.example.com")
COMPARE_PATHS, EDITABLE_PATHS = ("/platform/compare-to", "/platform/migrate-from"), ("/pricing", "/features")


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, 2)), ":[0-9]+$", "")


def _under(url: Column, prefixes, joined: str = "/") -> Column:
    """Whether the path is one of the prefixes or goes on below it."""
    path = F.regexp_replace(part(url, 3), "/+$", "")
    found = F.lit(False)
    for p in prefixes:
        found = found | (path == p) | path.startswith(p + joined)
    return found


def is_docs(url: Column, hosts=DOCS_HOSTS, compare=COMPARE_PATHS) -> Column:
    """A page that says what the product does: any of the documentation hosts' but those that compare or help to move."""
    return _host(url).isin(*hosts) & ~_under(url, compare, "-")


def is_editable(url: Column, hosts=DOCS_HOSTS, sites=SITE_HOSTS, compare=COMPARE_PATHS, paths=EDITABLE_PATHS) -> Column:
    """A page that an edit may name: those that compare or help to move, and some of the site's own; never a page of the product's documents."""
    return (_host(url).isin(*hosts) & _under(url, compare, "-")) | (_host(url).isin(*sites) & _under(url, paths))


def markdown_for(url: Column, hosts=DOCS_HOSTS) -> Column:
    """The address of a document's markdown; null on other hosts."""
    path = part(url, 3)
    bare = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)))
    return F.when(_host(url).isin(*hosts), F.when(path.endswith(".md"), F.trim(url)).otherwise(F.concat(bare, F.regexp_replace(path, "/+$", ""), F.lit(".md"), part(url, 4))))


def page_name(url: Column) -> Column:
    """How a sentence names a page: the ... page, by its title; one without a path by its address."""
    return F.when(F.size(segments(url)) > 0, F.concat(F.lit("the "), F.lower(title(url)), F.lit(" page"))).otherwise(F.trim(url))


# ---------------------------------------------------------------- addresses made


def quoted(text: Column) -> Column:
    """Percent-encoded, spaces too."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def user_lookup(base: str, user: Column) -> Column:
    return F.concat(F.lit(f"{base}/users/by/username/"), quoted(user))


def timeline(base: str, user_id: Column, most: Column) -> Column:
    """A user's latest posts, without reposts and replies, 5 to 100 of them, with their media."""
    n = F.greatest(F.lit(5), F.least(F.lit(100), most)).cast("string")
    return F.concat(F.lit(f"{base}/users/"), quoted(user_id), F.lit("/tweets?max_results="), n, F.lit("&tweet.fields=created_at%2Centities%2Cattachments&expansions=attachments.media_keys&media.fields=url%2Cpreview_image_url%2Ctype&exclude=retweets%2Creplies"))


def blob(repository: str, branch: str, path: Column) -> Column:
    """Where a file of a repository is shown, its path encoded segment by segment."""
    return F.concat(F.lit(f"https://github.com/{repository}/blob/{branch}/"), F.array_join(F.transform(F.split(path, "/"), quoted), "/"), F.lit("?raw=true"))


#: Query parameters that sign an address for a while.
CREDENTIALS = ("token", "jwt")


def carries_credential(url: Column) -> Column:
    """Whether an address has a parameter that lets its holder in."""
    names = F.transform(F.split(F.substring(part(url, 4), 2, 1 << 30), "&"), lambda p: F.substring_index(p, "=", 1))
    return F.exists(names, lambda n: n.isin(*CREDENTIALS))


def screenshot(template: str, url: Column) -> Column:
    """The template with the address in its place, encoded or as it is; without a place it is put at the end."""
    if "{encodedUrl}" in template:
        a, b = template.split("{encodedUrl}", 1)
        return F.concat(F.lit(a), quoted(url), F.lit(b))
    a, b = template.split("{url}", 1) if "{url}" in template else (template, "")
    return F.concat(F.lit(a), url, F.lit(b))


def card(base: str, label: Column, title: Column, most: int = 90) -> Column:
    """A drawn card that names the maker and the feature."""
    from .text import truncate

    return F.concat(F.lit(f"{base}?text="), quoted(truncate(F.concat(label, F.lit("\n"), title), most)), F.lit("&font=source-sans-pro"))


def entry_url(raw: Column, url: Column) -> Column:
    """An entry's own address: the one its raw fields (JSON) keep, with the anchor, else the signal's."""
    return F.coalesce(F.nullif(F.trim(F.get_json_object(raw, "$.entryUrl")), F.lit("")), url)


def is_anchored(url: Column) -> Column:
    return F.coalesce(url.rlike("#.+"), F.lit(False))


#: What a site's default card is named by, beside the word default.
CARDS = ("seo", "og", "share", "social")


def is_generic_preview(url: Column) -> Column:
    """Whether a picture is a site's default card: of the parts of its address between hyphens, underscores and dots, one ends with default and
    the next begins with what the card is for, or the other way round, or one part has both side by side."""
    parts = F.split(F.lower(url), "[-_.]")

    def card(part: Column, following: Column) -> Column:
        after, found = F.coalesce(following, F.lit("")), F.lit(False)
        for k in CARDS:
            for a, b in (("default", k), (k, "default")):
                found = found | (part.endswith(a) & after.startswith(b)) | F.contains(part, F.lit(a + b))
        return found

    return F.exists(F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), card), lambda x: x)


def visual_paths(folder: str, url: Column, claim: Column, proposed: Column, day: Column) -> Column:
    """struct<before, after>: the files of a page edit's pictures. The digest is of the page, both sides of the edit and the day, so that the same
    edit of a day reuses them and another day takes new ones."""
    from .text import slug

    digest = F.left(F.sha1(F.concat_ws("\n", url, claim, F.coalesce(proposed, F.lit("")), day)), F.lit(10))
    name = F.coalesce(F.nullif(slug(F.array_join(segments(url), "-"), 60), F.lit("")), F.lit("page"))
    stem = F.concat(F.lit(f"{folder}/"), name, F.lit("-"), digest)
    return F.struct(F.concat(stem, F.lit("-before.png")).alias("before"), F.concat(stem, F.lit("-after.png")).alias("after"))
