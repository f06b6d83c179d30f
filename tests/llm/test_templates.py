"""Pages whose article lies where names and markup mislead."""

import random
import time

import pytest

from siltflow.llm import templates


def texts(spark, page, n=8):
    rows = [(i, f"https://h.example.com/{i}", page(i)) for i in range(n)]
    return {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("wrapper", ["class='site has-sidebar'", "class='content no-sidebar'", "id='with-header'", "class='ad-free'", "class='sidebar'", "role='form'"])
@pytest.mark.parametrize("main", ["article", "main"])
def test_wrapper_does_not_drop_the_article(spark, wrapper, main):
    page = lambda i: f"<html><body><div {wrapper}><div class='site-header'>Menu {i}</div><{main}><h2 class='section-header'>Head {i}</h2><p>Body {i} of it</p><div class='comments'>Nice {i}</div></{main}></div></body></html>"
    assert texts(spark, page) == {i: f"Head {i} Body {i} of it" for i in range(8)}


def test_comments_are_no_article(spark):
    page = lambda i: f"<body><div class='text'><p>Text {i}</p></div><div class='comments'><p>A long comment {i} that has more words than the text has</p></div></body>"
    assert texts(spark, page) == {i: f"Text {i}" for i in range(8)}


@pytest.mark.parametrize("tag", ["svg", "math"])
def test_self_closing_raw_elements_are_empty(spark, tag):
    page = lambda i: f"<body><article><p>A {i}</p><{tag} class='x'/><p>B {i}</p><{tag}><title>no</title></{tag}><p>C {i}</p></article></body>"
    assert texts(spark, page) == {i: f"A {i} B {i} C {i}" for i in range(8)}


def test_outermost_of_equally_telling_containers(spark):
    page = lambda i: f"<body><div class='x1'>Menu of the site</div><div class='post'><h1>Title {i}</h1><p>Lead {i}</p><div class='post-content'><p>{'Long text ' * 5}{i}</p></div></div></body>"
    assert texts(spark, page) == {i: f"Title {i} Lead {i} {'Long text ' * 5}{i}" for i in range(8)}


def test_no_slot_text_is_lost_where_no_name_tells(spark):
    page = lambda i: f"<body><div class='x1'>Menu of the site</div><div class='x2'><h1>Title {i}</h1><p>Lead {i}</p><div class='x3'><p>{'Long text ' * 5}{i}</p></div></div><div class='x4'>Imprint</div></body>"
    assert texts(spark, page) == {i: f"Title {i} Lead {i} {'Long text ' * 5}{i}" for i in range(8)}


def test_template_text_is_left_out_where_the_slots_are_apart(spark):
    page = lambda i: f"<body><div class='x1'>Menu of the site</div><h1>Title {i}</h1><div class='x3'><p>{'Long text ' * 5}{i}</p></div><div class='x4'>Imprint</div></body>"
    assert texts(spark, page) == {i: f"Title {i} {'Long text ' * 5}{i}" for i in range(8)}
    copies = lambda i: page(0 if i < 6 else i)
    assert texts(spark, copies)[0].count("Long text") == 5


PARTS = ("menu", "text", "side", "replies", "imprint")


def shuffled(i, salt):
    """A page without telling names: the parts' classes differ by host, and their order as well."""
    rng = random.Random(salt)
    names = dict(zip(PARTS, rng.sample(["k1", "q7", "zx", "b2", "m9"], 5), strict=True))
    body = {
        "menu": "<ul>" + "".join(f"<li><a href='/{w}'>{w.title()}</a></li>" for w in ("home", "news", "about")) + "</ul>",
        "text": f"<h1>Title {i}</h1><p>By Ann</p>" + "".join(f"<p>Sentence {k} of page {i} says quite a lot about its subject, and goes on.</p>" for k in range(4 + i % 3)),
        "side": "".join(f"<div class='r{salt}'><h4>See {i * 7 + k}</h4><p>now</p></div>" for k in range(3)),
        "replies": "".join(f"<div class='c{salt}'><h5>User {i + k}</h5><p>I think so, page {i}, number {k}</p></div>" for k in range(1 + i % 4)),
        "imprint": "<p>All rights reserved</p>",
    }
    order = list(PARTS)
    rng.shuffle(order)
    return "<html><head><title>x</title></head><body>" + "".join(f"<div class='{names[p]}'>{body[p]}</div>" for p in order) + "</body></html>", f"Title {i} " + " ".join(f"Sentence {k} of page {i} says quite a lot about its subject, and goes on." for k in range(4 + i % 3))


def test_shuffled_names(spark):
    """What the pages share (menu, author, imprint) and what comes in lists (links, replies) goes, though no name tells."""
    rows = [(100 * salt + i, f"https://h{salt}.example.com/{i}", shuffled(i, salt)[0]) for salt in range(6) for i in range(12)]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {100 * salt + i: shuffled(i, salt)[1] for salt in range(6) for i in range(12)}


def test_fixed_text_inside_of_an_article_goes_and_repeated_text_stays(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1><p>{'Body text ' * 9}{i}</p><p>Follow us</p>{'<p>Same as ever</p>' * (i % 3)}</article></body>"
    assert texts(spark, page) == {i: f"Title {i} {'Body text ' * 9}{i}" + " Same as ever" * (i % 3) for i in range(8)}


PROBES = [
    ("<article><p>one</p><svg/><p>two</p></article>", "one two"),
    ("<article>a <math><mi>x</mi></math> b</article>", "a x b"),
    ('<div class="wrap has-sidebar"><article>hi</article></div>', "hi"),
    ('<div class="entry-header"><h1>Title</h1></div>', "Title"),
    ('<p class="ad-hoc">x</p>', "x"),
    ("<title>open <p>a</p>", "open a"),
    ("<p>a<select><option>1<option>2</select>b<object>c</object>", "a b c"),
    ("<article><header><h1>T</h1></header><p>x</article>", "T x"),
    ("<a title=don't>x</a> it's <b>y</b>", "x it's y"),
    ("x < y and z > w, a<b", "x < y and z > w, a<b"),
    ("<p>İ</p><script>if (a</b) '</p>'</script><p>b", "İ b"),
]


@pytest.mark.parametrize("source,want", PROBES)
def test_markup(source, want):
    assert templates.main_text(source, None) == want


@pytest.mark.parametrize("part", ['<a "', '<a "x>', '<a b=">"', "<!", "<!--", "<title>", "<svg>", "<div>", "<b><p>", "</x>", '<a b="', "<div></x>", "=", "<a =' "])
def test_malformed_and_deep_pages_take_linear_time(part):
    began = time.process_time()
    page = templates.Page(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 5
    assert sum(map(len, page.elements)) < 100_000


@pytest.mark.parametrize("n", [2, 3, 4, 12])
def test_hosts_of_any_size_are_judged_alike(spark, n):
    page = lambda i: f"<body><div class='x1'>Home About</div><div class='x2'><h1>Title {i}</h1><p>{'Long text ' * 5}{i}</p></div><div class='x4'>All rights</div></body>"
    rows = [(i, f"https://n{n}.example.com/{i}", page(i)) for i in range(n)]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} {'Long text ' * 5}{i}" for i in range(n)}


def test_headings_stay_and_comments_and_adverts_go_inside_of_an_article(spark):
    parts = ["user-comments", "comment-thread", "ad-slot", "adsbygoogle", "usercomments", "advert-top", "google-ads"]
    spam = "".join(f"<div class='{c}'><p>spam {{i}}</p></div>" for c in parts)
    page = lambda i: f"<body><article><h1>Title {i}</h1><h2>Summary</h2><p>{'Body text ' * 9}{i}</p>{spam.format(i=i)}<h2>Details</h2><p class='no-comments'>More {i}</p><table><tr><th>Price</th><td>{i}</td></tr></table></article></body>"
    assert texts(spark, page) == {i: f"Title {i} Summary {'Body text ' * 9}{i} Details More {i} Price {i}" for i in range(8)}
