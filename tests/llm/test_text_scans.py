import hashlib
import random
import re

import numpy as np
import pytest

from siltflow.llm import pii, secret_scan, templates, vp_trees
from pyspark.sql import functions as F


def pii_brute(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_regular_expressions():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("00123456789.@a+- ()_,é") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(t) == pii_brute(t)


def test_marginals_are_exact_on_trees():
    rng = np.random.default_rng(1)
    own, edges = rng.normal(size=(5, 5)), np.array([[0, 1], [1, 2], [1, 3], [3, 4]])
    pair = rng.normal(size=(4, 5, 5))
    p = np.zeros((5, 5))
    for labels in np.ndindex(*[5] * 5):
        w = np.exp(sum(own[i, y] for i, y in enumerate(labels)) + sum(pair[k, labels[i], labels[j]] for k, (i, j) in enumerate(edges)))
        for i, y in enumerate(labels):
            p[i, y] += w
    assert np.allclose(pii.marginals(own, edges, pair, 60), p / p.sum(axis=1, keepdims=True), atol=1e-6)


PII = ["mail a.b@x.example.com now", "call +1 (743) 555-3824 or (743) 555-3824", "card 4994226020900891 and again 4994226020900891 70", "nothing here", "", None, "in 1999 there were 12 apples", "pay 4111111111111111 then 4111111111111111", "+1 (201) 555-0123 +1 (201) 555-0123"] * 12


def test_pii_report_and_mask(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(PII)] + [(None, "a@b.co", 1, "x")], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for i, t in enumerate(PII):
        base = sorted(pii_brute(t or ""))
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
    assert got[3].spans == "" and got[6].spans == "" and "phone:26:40" in got[1].spans and "card:32:48" in got[2].spans
    masked = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert masked[0].text == "mail <email> now" and masked[0].n_chars == len("mail <email> now") and masked[5].text is None and masked[3].text == PII[3]
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secrets_brute(t):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets_equal_brute_force(spark):
    rng = random.Random(6)
    parts = ["token", "secret", "password", ": ", "=", " = ", "'", '"', "abc", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGH", "12345678", "é😀 ", " the house ", "\n", "API_KEY", "apikey"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["", None, "secret:token:abcdefgh"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    for r in secret_scan.report(docs).collect():
        base = secrets_brute(texts[r.doc_id] or "")
        listed = [f"{k}:{a}:{b}" for a, _, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))


def test_battery_finds_random_tokens_only(spark):
    import string

    rng = random.Random(7)
    alphabet = string.ascii_letters + string.digits
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(30)]
    plain = ["the-quick-brown-fox-jumps-over-2-lazy-dogs", "z9z9z9z9z9z9z9z9z9z9z9z9z9z9", "2024-01-02-report-final-version-three", "internationalisation2internationalisation", "zzzzzzzzzzzzzzzzzzzzzzzz0"]
    texts = [f"key {k} end" for k in keys] + [f"see {p} here" for p in plain for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.report(docs).collect()}
    found = [got[i] == "random:4:44" for i in range(len(keys))]
    assert np.mean(found) > 0.8 and not any(got[i] for i in range(len(keys), len(texts)))
    assert secret_scan.report(docs.limit(0)).count() == 0


def test_discovery_bound_is_benjamini_hochberg(spark):
    rng = random.Random(8)
    logs = [-rng.expovariate(0.02) for _ in range(300)]
    bound = secret_scan.discovery_bound(spark.createDataFrame([(x,) for x in logs], "log_p double"))
    taken = sorted(x for x in logs if x <= bound)
    assert taken and len(logs) * np.exp(bound) <= secret_scan.FDR * len(taken)


def site(k, body, extra="", main="article"):
    return f"<html><head><title>T{k}</title><script>var x='<p>no</p>'</script></head><body><div class='top-menu'>Menu here</div><div class='side'>Links of the site that are the same</div><{main}><h1>Title {k}</h1>{body}{extra}</{main.split()[0]}><footer>&copy; foot</footer></body></html>"


CASES = [
    ("<p>One &amp; two\n three<p>Four <b>bo</b>ld&nbsp;x</p>", "One & two three Four bold x"),
    ("<p>Text<br>line</p><div class='comments'><p>Nice!</p></div>", "Text line"),
    ("<p>A</p><aside>side</aside><form>Name <input></form><style>p{}</style><p>B</p><!-- <p>C</p> -->", "A B"),
    ("<ul><li>x<li>y</ul><div class='ad'>Buy</div><table><tr><td>1<td>2</table>", "x y 1 2"),
]


@pytest.mark.parametrize("main", ["article", "main", "div class='text'"])
def test_extraction(spark, main):
    rows = [(i, f"https://h.example.com/{i}", site(i, CASES[i % 4][0], main=main)) for i in range(16)] + [(100, None, None), (101, "https://h.example.com/x", ""), (102, "https://one.example.com/", site(102, CASES[0][0], main="article")), (3, "https://h.example.com/3", site(3, CASES[3][0], main=main))]
    got = templates.extract(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 100:
            assert r.text == f"Title {r.page_id} {CASES[r.page_id % 4][1]}", main
    by = {r.page_id: r for r in got}
    assert by[100].text == by[101].text == "" and by[102].text == f"Title 102 {CASES[0][1]}" and all(r.n_chars == len(r.text) for r in got)
    assert templates.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_classes(spark):
    rows = [(i, f"https://h.example.com/{i}", site(i, "<p>a</p>" * (1 + i % 3))) for i in range(9)]
    found = templates.classes(templates.tokens(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    once = max(found, key=lambda r: r["size"])
    assert (once.support, once.times, once.place) == (9, 9, "") and once.elements < once.size
    paragraphs = next(r for r in found if r.place == "/html/body/article/p")
    assert (paragraphs.support, paragraphs.times, paragraphs.elements) == (9, 18, 1)


@pytest.mark.parametrize("shard,block,leaves", [(8192, 4096, 1024), (40, 10, 1024), (40, 10, 3)])
def test_nearest_equals_brute_force(spark, monkeypatch, shard, block, leaves):
    for name, value in (("SHARD_ROWS", shard), ("BLOCK_ROWS", block), ("MOST_LEAVES", leaves), ("BLOCKS_A_TASK", 3)):
        monkeypatch.setattr(vp_trees, name, value)
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(400, 6)) + rng.integers(0, 4, (400, 1)) * 5).round(1)
    x[50:180] = x[20]  # ties, and a leaf of many parts
    good = [(i, v) for i, v in enumerate(x)] + [(3, x[3]), (40, x[41]), (40, x[41]), (505, np.array([1.0, 2.0])), (500, np.array([2.0, 2.0])), (520, np.array([2.0, 1.0]))]
    rows = [(i, [float(y) for y in v]) for i, v in good] + [(500, None), (501, []), (502, [0.0] * 6), (503, [float("nan")] * 6), (504, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6)]
    got = vp_trees.nearest(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, shard int"), F.col("vec_id") % 20 == 0, k=7).collect()
    want = []
    for n, (i, q) in enumerate(good):
        if i % 20 == 0:
            s = [(-float(vp_trees.exact(q[None], v[None])[0]), j) for m, (j, v) in enumerate(good) if m != n and len(v) == len(q)]
            want += [(i, r + 1, j, -v) for r, (v, j) in enumerate(sorted(s)[:7])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_tree_skips_leaves():
    """Clusters far apart on a sphere: a query's bound reaches few leaves, and all that hold any of its nearest."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(16, 8))[rng.integers(0, 16, 4000)] * 20 + rng.normal(size=(4000, 8))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    top = vp_trees.Top(x[:600], 16, float((x**2).sum(axis=1).max()))
    leaf = top.leaf(x)
    bounds = {k: [(d.min(), d.max()) for d in (top.between(x[leaf == k], v) for v in top.above[k])] for k in np.unique(leaf).tolist()}
    q = x[::100]
    score = q @ x.T
    kth = np.sort(score, axis=1)[:, -10]
    reached = top.reached(q, kth, bounds, 1.0)
    for i in range(len(q)):
        assert all(i in reached.get(k, ()) for k in set(leaf[score[i] >= kth[i]].tolist()))
    assert sum(map(len, reached.values())) < 0.6 * len(q) * len(bounds)


def test_relaxed_search_recalls_most():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 3
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16))
    tree = vp_trees.Tree(np.arange(3000), x)
    q = x[::100]
    a, ids, _ = tree.search(np.arange(0, 3000, 100), q, 10, 1.0)
    full, whole = tree.scored, set(zip(a.tolist(), ids.tolist(), strict=True))
    a, ids, _ = vp_trees.Tree.load(tree.dump()).search(np.arange(0, 3000, 100), q, 10, 0.8)
    assert len(whole & set(zip(a.tolist(), ids.tolist(), strict=True))) >= 0.9 * len(whole)
    tree.search(np.arange(0, 3000, 100), q, 10, 0.2)
    assert tree.scored < full
