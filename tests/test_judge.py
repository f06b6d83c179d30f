import pytest

from siltflow.functions import replies as J
from siltflow.operators import replay as P
from siltflow.plans import catalog


def test_only_what_failed_is_asked_again(spark):
    asked = []

    def ask(rows):
        asked.append(sorted((r.id, r.attempt, r.why) for r in rows.collect()))
        reply = {(1, 1): '{"impact": "minor", "summary": "s", "actions": []}', (2, 1): '{"impact": "minor"}', (2, 2): '{"impact": "minor", "summary": "t", "actions": []}', (3, 1): "no JSON", (3, 2): '{"summary": "u", "actions": []}'}
        return P.recorded(spark.createDataFrame([(*k, v) for k, v in reply.items()], "id int, attempt int, reply string"))(rows)

    made = P.attempts(spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int"), ask, J.analysis)
    assert asked == [[(i, 1, None) for i in (1, 2, 3, 4)], [(2, 2, "no_summary"), (3, 2, "no_summary"), (4, 2, "no_reply")]]
    got = {r.id: (r.attempts, r.answer and r.answer.summary, r.error) for r in P.settled(made).collect()}
    assert got == {1: (1, "s", None), 2: (2, "t", None), 3: (2, None, "no_impact"), 4: (2, None, "no_reply")}


def test_nothing_is_asked_again_without_a_failure(spark):
    replies = spark.createDataFrame([(1, 1, '{"impact": "minor", "summary": "s", "actions": []}')], "id int, attempt int, reply string")
    assert P.attempts(replies.select("id"), P.recorded(replies), J.analysis).count() == 1
    assert P.settled(P.attempts(replies.select("id").limit(0), P.recorded(replies), J.analysis)).count() == 0


def test_every_signal_becomes_a_message(spark):
    rows = catalog.QUERIES["judged_signals"](spark, "/root/testdata/sf0.001").collect()
    items = {r.item_id for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("item_id is not null").collect()}
    assert sorted(r.id for r in rows) == sorted(items)
    for r in rows:
        assert r.made_by == ("rules" if r.id % 5 == 0 else "model") and r.attempts == (2 if r.id % 5 < 2 else 1)
        assert r.title.startswith("Acme: ") and 0 < r.n_chars <= 6000
        assert r.n_actions + r.n_dropped == (0 if r.id % 5 == 0 else 1)
        assert (r.verdict is None) == (r.n_actions > 0), r
    assert {r.verdict for r in rows if r.id % 5 == 0} == {"unanalyzed"} or pytest.fail(str({r.verdict for r in rows}))


def test_only_the_fields_asked_for_are_read_and_all_is_checked(spark):
    long = "x" * 1601
    replies = [
        '{"impact": "minor", "summary": "It — is", "actions": [{"type": "update_pages", "detail": "“a” — b"}], "openQuestions": ["Is it?"]}',
        '{"impact": "minor", "summary": "s", "actions": [], "productRefs": [{"url": "u", "claim": "c", "proposedText": "%s"}]}' % long,
        '{"impact": "huge", "summary": "s", "actions": []}', "no JSON", None,
    ]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "id int, reply string")
    got = rows.select("id", J.analysis(rows.reply).alias("a"), J.analysis(rows.reply, ("summary", "actions")).alias("b")).orderBy("id").collect()
    assert got[0].b.__fields__ == ["error", "summary", "actions"] and got[0].b.summary == "It – is" and got[0].b.actions[0].detail == '"a" – b'
    assert [r.b.error for r in got[:4]] == [None, "too_long", "no_impact", "no_summary"]
    for r in got:
        assert (r.a is None) == (r.b is None) and (r.a is None or (r.a.error, r.a.summary, r.a.actions) == tuple(r.b))
