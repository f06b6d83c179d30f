"""Users looked up and their timelines joined; equal starts of differences."""

import random

from pyspark.sql import functions as F

from siltflow.functions import diff as D
from siltflow.functions import urls as U
from siltflow.sources import feeds as S

BASE = "http://api.example"


def test_user_posts(spark):
    users = spark.createDataFrame([("a b",), ("a b",), ("nobody",), ("unread",), ("broken",), ("silent",), (None,)], "user string")
    post = '{"id": "%s", "text": "%s", "created_at": "2024-01-02T03:04:05.000Z"}'
    timeline = '{"data": [%s]}' % ", ".join(post % (k, t) for k, t in (("1", "First   post"), ("2", "@c answer"), ("3", "RT @c"), ("4", "Last")))
    of = lambda f, v: spark.range(1).select(f(BASE, F.lit(v)).alias("u")).first()["u"]
    t = lambda i: of(lambda b, c: U.timeline(b, c, F.lit(10)), i)
    saved = spark.createDataFrame(
        [(of(U.user_lookup, u), '{"data": {"id": "%s"}}' % i) for u, i in (("a b", "7"), ("unread", "8"), ("silent", "9"))]
        + [(of(U.user_lookup, "nobody"), '{"errors": []}'), (of(U.user_lookup, "broken"), "<html>"), (t("7"), timeline), (t("9"), '{"meta": {}}')], "url string, body string")
    asked = []

    def read(urls):
        asked.extend(r["url"] for r in urls.collect())
        return urls.join(saved, "url")

    got = S.user_posts(users, read, BASE).orderBy("pos").collect()
    assert [(r.user, r.external_id, r.pos, r.title, r.url) for r in got] == [("a b", "1", 0, "First post", "https://x.com/a b/status/1"), ("a b", "4", 1, "Last", "https://x.com/a b/status/4")]
    assert len(asked) == len(set(asked)) == 5 + 3
    assert S.user_posts(users.limit(0), read, BASE).count() == 0


def moves(a, b):
    """As without leaving out equal starts."""
    ka, kb = [D._key(w) for w in a], [D._key(w) for w in b]
    t = D.table(ka, kb)
    i = j = 0
    for x, y in [*D.kept(ka, kb, t), (len(a), len(b))]:
        while i < x or j < y:
            if i < x and (j == y or t[i + 1, j] >= t[i, j + 1]):
                yield "removed", a[i], ""
                i += 1
            else:
                yield "added", "", b[j]
                j += 1
        if x < len(a):
            yield "same", a[i], b[j]
            i, j = i + 1, j + 1


def test_equal_starts_change_no_difference():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.choice(["x", "Y", "y", "z.", "-", "w"]) + " " for _ in range(rng.randrange(12))]
        b = a[: rng.randrange(len(a) + 1)] + [rng.choice(["x", "y", "z", "w"]) + " " for _ in range(rng.randrange(8))] + a[rng.randrange(len(a) + 1) :]
        assert list(D._moves(a, b)) == list(moves(a, b))
