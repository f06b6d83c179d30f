"""The daily cycle: ingest, select, analyse, record, post. Running it twice on the same input changes nothing the second time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies
from ..functions import text as T
from ..functions import urls as U
from ..operators import actions, messages, replay, retrieval, routing, signals
from ..operators.state import Store, deliver, item_id
from ..storage import written


@dataclass
class Summary:
    """What a run did; as text, one line and its notes."""

    candidates: int = 0
    new_items: int = 0
    analysed: int = 0
    retried: int = 0
    posted: int = 0
    quiet: bool = False
    notes: list[str] = field(default_factory=list)

    def __str__(self) -> str:
        seeded = self.new_items - self.analysed
        line = f"{self.candidates} candidates, {self.new_items} new ({seeded} seeded), {self.analysed} analysed" + f", {self.retried} retried" * bool(self.retried) + f", {self.posted} posted" + ", nothing to report" * self.quiet
        return "\n".join([line, *(f"note: {n}" for n in self.notes)])


#: What a run without a model says of itself; labels that changelogs open with; lengths of what is restated.
UNANALYZED = "Rules alone read this signal. They judge nothing; the questions below point at pages worth a look."
LABELS = ("description", "summary", "overview", "what's new", "tl;dr")
MOST_LEAD, MOST_POINT, MOST_POINTS, MOST_CLAIM, MOST_REFS = 280, 160, 3, 240, 2


def heuristic(items: DataFrame, maker: Column | None = None, refs: Column | None = None) -> DataFrame:
    """items (title, raw) with analysis, a JSON text: what can be said by rules alone. It restates the signal: its impact, a summary, up to
    MOST_POINTS points, the first MOST_REFS of refs (array of struct<url, claim>, pages that it touches), no action, and where to start."""
    maker = F.coalesce(maker if maker is not None else F.lit(None).cast("string"), F.lit("The source"))
    raw = lambda *names: F.coalesce(*[F.when(F.trim(F.get_json_object("raw", f"$.{n}")) != "", F.get_json_object("raw", f"$.{n}")) for n in names])
    bare = lambda x: F.regexp_replace(F.trim(x), rf"(?i)^({'|'.join(LABELS)}) *[:–—-] *", "")
    body = F.coalesce(raw("body", "preview", "text"), F.lit(""))
    said = T.sentences(bare(body))
    described = T.truncate(bare(raw("description")), MOST_LEAD)
    lead = F.coalesce(described, F.nullif(T.truncate(F.array_join(F.slice(said, 1, 2), " "), MOST_LEAD), F.lit("")))
    summary = F.coalesce(F.concat(maker, F.lit(": "), T.first_sentence(lead)), F.concat(maker, F.lit(' published "'), F.col("title"), F.lit('".')))
    rest = F.slice(T.sentences(lead), 2, MOST_POINTS)
    points = F.filter(F.transform(F.when(F.size(rest) > 0, rest).otherwise(F.slice(said, 2, MOST_POINTS)), lambda s: T.truncate(F.trim(s), MOST_POINT)), lambda s: s != "")
    none = F.expr("cast(array() as array<struct<url:string,claim:string>>)")
    cited = F.transform(F.slice(refs if refs is not None else none, 1, MOST_REFS), lambda r: F.struct(r["url"].alias("url"), T.truncate(r["claim"], MOST_CLAIM).alias("claim")))
    questions = F.transform(cited, lambda r: F.concat(F.lit("Is "), r["url"], F.lit(" still right in view of this?")))
    analysis = F.struct(
        routing.impact(F.concat_ws(" ", "title", body)).alias("impact"), summary.alias("summary"), F.coalesce(points, F.expr("cast(array() as array<string>)")).alias("key_points"),
        F.struct(F.lit("unanalyzed").alias("kind"), F.lit(UNANALYZED).alias("reason"), F.transform(cited, lambda r: F.struct(r["url"].alias("url"))).alias("evidence")).alias("no_action"), cited.alias("product_refs"),
        questions.alias("open_questions"),
    )
    return items.withColumn("analysis", F.to_json(analysis))


def judge(items: DataFrame, ask: replay.Ask, index: retrieval.Index, product: str, maker: Column, docs_kind: str = "docs", editable=U.is_editable) -> DataFrame:
    """(id, attempts, made_by, n_actions, n_dropped, verdict, message) of signals (id, title, source, url, raw): read beside the pages that a
    search finds for them, analysed by replies, asked for again where they can't be used, or else by rules; their actions checked one after
    another; and what is left as a message within its limits. A row for each signal, whatever its reply was."""
    said = items.withColumn("text", retrieval.signal_text(F.col("title"), F.col("raw")))
    overviews = items.sparkSession.createDataFrame([(t.label, t.docs[0]) for t in routing.TOPICS if t.docs], "label string, url string")  # the catalog
    overviews = overviews.withColumn("url", F.col("url").try_cast(index.pages.schema["url"].dataType)).where("url is not null")
    asked = said.select(F.col("id").alias("qid"), "text").withColumn("topics", routing.top_topics(F.col("text"), 3))
    read = written(retrieval.context(index, asked, overviews).select(F.col("qid").alias("id"), F.col("url").cast("string").alias("url")))
    got = written(replay.settled(replay.attempts(items, ask, replies.analysis)))
    by_rules = heuristic(items, maker).select("id", replies.analysis(F.col("analysis")).alias("rules"))
    answered = got.join(by_rules, "id").withColumn("made_by", F.when(F.col("answer").isNull(), "rules").otherwise("model")).withColumn("a", F.coalesce("answer", "rules"))
    answered = written(answered.join(said, "id").select("id", "attempts", "made_by", "title", "source", "url", "text", "a.*"))
    none = F.lit(None).cast("string")
    proposed = answered.select("id", F.posexplode("actions").alias("place", "x")).select("id", "place", *[F.col(f"x.{c}").alias(c) for c in ("type", "detail", "feature", "gap", "evidence_url", "evidence_quote")])
    refs = F.transform("refs", lambda r: F.struct(*[r[c].alias(c) for c in ("url", "claim", "suggested_edit", "proposed_text", "edit_kind")]).cast(actions.REF))
    analyses = answered.select("id", "title", "summary", "impact", "questions", refs.alias("refs"))
    shown = answered.select("id", F.transform(routing.docs_for_text(F.col("text")), lambda u: F.struct(u.alias("url"), F.lit("").alias("claim"))).alias("docs"))
    kept, dropped, after = actions.check_actions(written(proposed), written(analyses), written(shown), read, index, product, docs_kind, editable)
    mine = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "type", "detail", "feature"))), lambda x: F.struct(x["type"].alias("type"), x["detail"].alias("detail"), x["feature"].alias("feature"))).alias("kept"))
    gone = dropped.groupBy("id").agg(F.count("*").alias("n_dropped"))
    out = answered.select("id", "attempts", "made_by", "title", "source", "url", "summary", "impact", "points", F.col("no_action").alias("stated")).join(mine, "id", "left").join(gone, "id", "left").join(after.select("id", F.col("no_action").alias("checked")), "id", "left")
    out = out.withColumn("kept", F.coalesce("kept", actions.empty("struct<type:string,detail:string,feature:string>")))
    verdict = lambda v: F.struct(v["kind"].alias("kind"), v["feature"].alias("feature"), v["reason"].alias("reason"), F.transform(v["evidence"], lambda e: F.struct(e["url"].alias("url"), e["title"].alias("title"))).alias("evidence"))
    out = out.withColumn("no_action", F.when(F.size("kept") == 0, F.coalesce(F.when(F.col("checked").isNotNull(), verdict(F.col("checked"))), F.when(F.col("stated").isNotNull(), verdict(F.col("stated"))))))
    message = messages.alert(maker, F.col("title"), F.col("source"), F.col("url"), F.col("summary"), F.coalesce("impact", F.lit("minor")), F.col("points"), F.col("kept"), F.col("no_action"), none, product)
    return out.select("id", "attempts", "made_by", F.size("kept").cast("long").alias("n_actions"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.col("no_action.kind").alias("verdict"), message.alias("message"))


def run(store: Store, batch: DataFrame, now: str, day: str, post: Callable[[dict], bool], analyse: Callable[[DataFrame], DataFrame] = heuristic, sources_read: int = 1) -> Summary:
    """batch: items with ord. Waiting analyses are read before new ones are recorded, so none is posted twice in a run."""
    at = F.lit(now).cast("timestamp")
    out = Summary(candidates=batch.count())
    since = at - F.expr(f"interval {signals.RETRY_DAYS} days")
    readable = F.get_json_object("analysis", "$").isNotNull()
    waiting = [r["id"] for r in signals.pending(store.read("analyses"), store.read("items").select(F.col("id").alias("item_id")), since, signals.PER_RUN, readable).select("id").collect()]  # the oldest first
    stored = store.read("items")
    chosen = signals.select_for_analysis(batch, stored, at)
    picked = chosen.select(*signals.KEY).toPandas()  # PER_RUN rows at most
    out.new_items = store.insert_new(batch).count()
    fresh = batch.sparkSession.createDataFrame(picked, chosen.select(*signals.KEY).schema) if len(picked) else chosen.select(*signals.KEY).limit(0)
    items = signals.first_in_batch(batch).join(fresh, list(signals.KEY), "left_semi")
    key = item_id(*[F.col(c) for c in signals.KEY])
    rows = analyse(items).select(F.sha1(F.concat(F.lit("analysis "), key)).alias("id"), key.alias("item_id"), "analysis", F.lit(None).cast("timestamp").alias("posted_at"), at.alias("created_at"))
    out.analysed = len(picked)
    if out.analysed:
        store.record(rows)
    outbox = store.read("analyses").where(F.col("posted_at").isNull())
    if waiting or out.analysed:
        todo = outbox.where(F.col("id").isin(waiting) | (F.col("created_at") == at)).select("id", F.col("analysis").alias("payload"))
        done = deliver(todo, post)
        out.posted, out.retried = len(done), len(set(done) & set(waiting))
        if done:
            store.mark_posted(batch.sparkSession.createDataFrame([(d,) for d in done], "id string"), at)
    elif not out.new_items and sources_read and store.claim_day(day, at):
        out.quiet = True
        post({"id": f"quiet-{day}", "payload": "{}"})
    return out
