"""Queries of the checks of actions, reviews, page edits and pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies as J
from ..functions import text as T
from ..functions import urls as U
from ..operators import actions as A
from ..operators import messages as M
from ..operators import replay as P
from ..operators import retrieval as R
from ..operators import review as V
from ..operators import routing as Q
from .base import indexed, sql_stems, table
from .rules import _ACTIONS, _CAPABLE, _DOCS, _LINES, _TOPICS, _WC, _actions, _lines, sql_blank, sql_gap, sql_opens, sql_topics
from .scalars import SQL_URLS, _slug
from .search import SQL_INDEX, sql_sentences, sql_truncate


def _signals(spark, sf_dir):
    """Documents as signals: the first line is the title, what follows a text that may speak of it or not."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    title = F.substring_index("text", "\n", 1)
    return d.select("doc_id", title.alias("title"), F.substring("text", F.char_length(title) + 2, F.char_length("text")).alias("rest"))


def topic_ties(spark, sf_dir):
    s = _signals(spark, sf_dir).withColumn("topic", Q.signal_topic(F.col("title"), F.lit("")))
    return s.select("doc_id", F.size("topic.terms").cast("long").alias("n_terms"), F.size("topic.phrases").cast("long").alias("n_phrases"), Q.ties_to(F.col("rest"), F.col("topic")).alias("ties"))


def topic_guard(spark, sf_dir):
    """Page edits for every second signal, product actions for the others."""
    s = _signals(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 2 == 0, "update_pages").otherwise("consider_building")
    actions = s.select(F.col("doc_id").alias("id"), F.lit(0).alias("place"), kind.alias("type"), F.col("rest").alias("detail"))
    analyses = s.select(F.col("doc_id").alias("id"), "title", F.lit("").alias("summary"), A.empty(A.REF).alias("refs"))
    return A.topic_guard(actions, analyses).select("id", "dropped")


def _edit_refs():
    """References of a document's analysis, by its id: pages that may be edited or not, with and without an edit."""
    i = F.col("doc_id")
    url = lambda k: F.when((i + k) % 3 == 0, "https://docs.example.com/platform/compare-to-acme").when((i + k) % 3 == 1, "https://docs.example.com/volumes").otherwise("https://example.com/pricing")
    none = F.lit(None).cast("string")
    ref = lambda k: F.struct(url(k).alias("url"), F.lit("claim").alias("claim"), F.when((i + k) % 4 != 0, "Say so").alias("suggested_edit"), none.alias("proposed_text"), none.alias("edit_kind")).cast(A.REF)
    return F.slice(F.array(ref(0), ref(3)), F.lit(1), (i % 3).cast("int"))


def page_target_guard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    analyses = d.select(F.col("doc_id").alias("id"), _edit_refs().alias("refs"))
    kinds = F.array(F.lit("update_pages"), F.lit("consider_building"))
    actions = d.select(F.col("doc_id").alias("id"), F.posexplode(F.slice(kinds, F.lit(1), (F.col("doc_id") % 2 + 1).cast("int"))).alias("place", "type"))
    return A.page_target_guard(actions, analyses).select("id", "place", "dropped")


def topic_by_name(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(T.words(F.col("text")), 1).alias("name"))
    named = F.when(F.col("doc_id") % 4 == 0, "Schaft").when(F.col("doc_id") % 4 == 1, "the ration plan").when(F.col("doc_id") % 4 == 2, "que").otherwise("zzz")
    return d.select("doc_id", Q.find_topic(named).alias("topic"))


def _refs(spark, sf_dir):
    i = F.col("doc_id")
    return _lines(spark, sf_dir).select((i % 97).alias("action"), ((i % 5 != 0) & (i % 97 != 3)).alias("editable"), (i % 3 != 0).alias("suggested"), F.when(i % 11 != 0, F.col("line")).alias("copy"), (i % 13 == 0).alias("too_much"), (i % 97 % 7 != 0).alias("holds"))


def page_action_gate(spark, sf_dir):
    return A.page_cause(_refs(spark, sf_dir), "action")


def _proposed(spark, sf_dir):
    """Benchmark items as actions of analyses, three to each: what they lack, cite and quote may be missing or wrong."""
    i = F.col("id")
    a = _actions(spark, sf_dir)
    gap = F.when(i % 11 == 5, "It is cheaper").otherwise(F.col("gap"))
    detail = F.when(i % 9 == 4, "Add the docs for it").otherwise(F.concat(F.lit("Support it: "), T.first_sentence(F.coalesce("quote", F.lit("x")))))
    none = F.lit(None).cast("string")
    return a.select(
        F.floor(i / 3).cast("long").alias("id"), (i % 3).cast("int").alias("place"), F.when(i % 4 == 3, "consider_building").otherwise("consider_enhancing").alias("type"), detail.alias("detail"), none.alias("feature"),
        gap.alias("gap"), F.col("evidence_url").cast("string").alias("evidence_url"), F.col("quote").alias("evidence_quote"),
    )


def _analyses(spark, sf_dir):
    none = A.empty("string")
    ids = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 3).cast("long").alias("id")).distinct()  # those of _proposed()
    return ids.select("id", F.lit("A launch").alias("title"), F.lit("It is new.").alias("summary"), F.lit("major").alias("impact"), none.alias("questions"), A.empty(A.REF).alias("refs"))


def _read(spark, sf_dir):
    """Every analysis read every fourth document."""
    return table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("url"))


def gate_actions(spark, sf_dir):
    return A.causes(_proposed(spark, sf_dir), _analyses(spark, sf_dir), _read(spark, sf_dir), indexed(spark, sf_dir), docs_kind="en").select("id", "place", "cause")


def no_action_verdict(spark, sf_dir):
    blocked = A.causes(_proposed(spark, sf_dir), _analyses(spark, sf_dir), _read(spark, sf_dir), indexed(spark, sf_dir), docs_kind="en").where("cause is not null")
    pages = indexed(spark, sf_dir).pages.select(F.col("url").cast("string").alias("url"), "title")
    return A.no_action_from(blocked, pages).select("id", "kind")


def check_actions(spark, sf_dir):
    """The whole chain: which actions stay, and as what; which go, and why."""
    shown = _analyses(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit("ration/overview").alias("url"), F.lit("What it is").alias("claim")))).alias("docs"))
    kept, gone, analyses = A.check_actions(_proposed(spark, sf_dir), _analyses(spark, sf_dir), shown, _read(spark, sf_dir), indexed(spark, sf_dir), "acme", docs_kind="en")
    none = F.lit(None).cast("string")
    out = kept.select("id", "place", "type", "detail", none.alias("cause")).unionByName(gone.select("id", "place", none.alias("type"), none.alias("detail"), "cause"))
    return out.join(analyses.select("id", F.size("questions").alias("n_questions"), F.col("no_action.kind").alias("verdict")), "id")


def action_lead(spark, sf_dir):
    """Page edits and product actions whose words may or may not say what is to be done."""
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "update_pages").when(i % 3 == 1, "consider_building").otherwise("consider_enhancing")
    l = _lines(spark, sf_dir).withColumn("refs", _edit_refs())
    return l.select("doc_id", A.lead(F.col("line"), kind, F.when(i % 2 == 0, "Ration"), F.col("refs")).alias("detail"))


def measured_edit(spark, sf_dir):
    """What an insert of each document's first line adds to the document, and whether that is too much."""
    from ..operators.gate import measure_edit

    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    page = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    first = F.substring_index("text", "\n", 1)
    m = d.select("doc_id", measure_edit(F.substring_index("text", "\n", -1), F.concat_ws(" ", first, first), F.lit("insert"), page).alias("m"))
    return m.select("doc_id", *[F.col(f"m.{c}").cast("long").alias(c) for c in ("added", "passage", "page", "allowed")], "m.too_much")


def merge_revision(spark, sf_dir):
    i = F.col("doc_id")
    kinds = lambda k: F.element_at(F.array(*map(F.lit, ("consider_building", "consider_enhancing", "update_pages"))), (k % 3 + 1).cast("int"))
    none = F.lit(None).cast("string")
    edits = F.array(*[F.struct(F.lit(u).alias("url"), F.lit("Copy").alias("proposed_text"), none.alias("suggested_edit"), none.alias("edit_kind")).cast(V.EDIT) for u in ("https://example.com/pricing", "https://example.com/features")])
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(
        "doc_id", kinds(i).alias("type"), F.lit("Core").alias("feature"), F.lit("minor").alias("impact"), F.lit("old").alias("detail"), none.alias("gap"), none.alias("evidence_url"), none.alias("evidence_quote"), _edit_refs().alias("refs"),
        kinds(i + F.floor(i / 3)).alias("new_type"), F.when(i % 4 == 0, "schaft").when(i % 4 == 1, "nothing").alias("new_feature"), F.when(i % 2 == 0, "new").alias("new_detail"), *[none.alias(f"new_{c}") for c in ("gap", "evidence_url", "evidence_quote")],
        F.when(i % 5 == 0, "major").alias("review_impact"), F.when(i % 3 != 0, edits).alias("edits"),
    )
    out = V.merge_revision(d)
    copies = F.size(F.filter("refs", lambda r: r["proposed_text"] == "Copy")).cast("long")
    return out.select("doc_id", "type", "feature", "impact", "detail", copies.alias("n_copies"), F.array_join("refused", ",").alias("refused"))


def review_states(spark, sf_dir):
    """Documents with labels as reviewed actions: quality and toxicity give the verdict, every tenth was done before."""
    verdict = F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 1, "agree").when(F.col("quality") == 0, "revise")
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    t = table(spark, sf_dir, "documents").select("doc_id").join(lab, "doc_id", "left").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10 == 0).alias("done"), verdict.alias("verdict"))
    return V.review_states(t, 120)


def review_labels(spark, sf_dir):
    i = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("agree", "revise", "drop", "skipped", "left"))), (i % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(V.review_labels(F.array(F.lit("a"), F.when(i % 2 == 0, V.DONE).otherwise("b")), state, i % 3 == 0), ",").alias("labels"))


def no_action_check(spark, sf_dir):
    """Verdicts whose pages are held, of the wrong kind, without their quote, or none."""
    i = F.col("event_id")
    none = F.lit(None).cast("string")
    page = lambda k, quote: F.struct((i % k).cast("string").alias("url"), none.alias("title"), quote.alias("quote"))
    v = table(spark, sf_dir, "events").select(
        i.alias("id"), F.element_at(F.array(*map(F.lit, ("already_covered", "not_a_gap", "unverified"))), (i % 3 + 1).cast("int")).alias("kind"), F.when(i % 2 == 0, "Ration").alias("feature"),
        F.array(page(7, F.when(i % 4 == 0, "words that nobody finds there")), page(5, none)).alias("evidence"),
    )
    pages = spark.createDataFrame([(str(k), "docs" if k < 3 else "marketing", f"Title {k}", "some words") for k in range(4)], "url string, kind string, title string, body string")
    return A.check_no_action(v, F.broadcast(pages)).select("id", "kind", "feature", F.array_join(F.transform("evidence", lambda e: e["url"]), ",").alias("pages"))


def issue_pairs(spark, sf_dir):
    """Issues that were stored in the order of their actions, some lists shorter than the actions."""
    i = F.col("event_id")
    actions = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    pairs = J.paired(actions, F.slice(F.array(i, i + 1, i + 2), F.lit(1), (i % 4).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(pairs, lambda p: F.concat(p["action"], F.coalesce(p["issue"].cast("string"), F.lit("-")))), ",").alias("pairs"))


def post_images(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    posts = e.where("event_id % 2 = 0").select(i.alias("id"), F.array(i + 1, i + 3, i + 5).alias("media_keys"))
    media = e.where("event_id % 2 = 1").select(i.alias("media_key"), F.when(i % 3 == 0, F.concat(F.lit("u"), i)).alias("url"), F.when(i % 5 == 0, F.concat(F.lit("p"), i)).alias("preview"))
    return V.post_images(posts, media)


def image_fallback(spark, sf_dir):
    i = F.col("event_id")
    opt = lambda k, name: F.when(i % k == 0, F.concat(F.lit(name), i.cast("string"), F.when(i % 3 == 0, "-og-default.png").otherwise(".png")))
    return table(spark, sf_dir, "events").select("event_id", V.picture(opt(7, "feed"), opt(2, "page"), i % 5 == 0, opt(4, "shot"), F.lit("made")).alias("p")).select("event_id", F.col("p.url").alias("image"), F.col("p.origin").alias("origin"))


def question_repair(spark, sf_dir):
    i = F.col("doc_id")
    x = F.lower(F.element_at(T.words(F.concat(F.col("text"), F.lit(" word"))), 1))
    line = F.when(i % 5 == 0, F.concat(F.lit("It is unclear whether "), x, F.lit(" holds."))).when(i % 5 == 1, F.concat(F.lit("The page is old: does "), x, F.lit(" hold"))).when(i % 5 == 2, F.concat(F.lit("what is "), x)).when(i % 5 == 3, F.concat(F.lit("Is "), x, F.lit(" so?"))).otherwise(x)
    return table(spark, sf_dir, "documents").select("doc_id", Q.as_question(line).alias("question"))


def verify_docs(spark, sf_dir):
    """Lines as actions; two of three were shown the overviews of their topics."""
    i = F.col("doc_id")
    overview = lambda n: F.struct(Q._lookup(((t.label, t.docs[:1]) for t in Q.TOPICS), n)[0].alias("url"), F.lit("What it is").alias("claim"))
    lines = _lines(spark, sf_dir)
    none = F.lit(None).cast("string")
    actions = lines.select(i.alias("id"), F.lit(0).alias("place"), F.when(i % 2 == 0, "consider_building").otherwise("consider_enhancing").alias("type"), F.col("line").alias("detail"), none.alias("feature"))
    docs = lines.select(i.alias("id"), F.when(i % 3 != 0, F.transform(Q.top_topics(F.col("line")), overview)).alias("docs"))
    return A.verify_against_docs(actions, docs, "acme").select("id", "type", "feature", F.col("cites.url").alias("cites"), F.col("asks").isNotNull().alias("asks"))


def context_topup(spark, sf_dir):
    named = Q.match_topics(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    held = Q.round_robin_docs(named.where("rank = 1"), "doc_id", 1).where("doc_id % 2 = 0").select("doc_id", "doc")
    return V.top_up(named, held, "doc_id")


def visual_paths(spark, sf_dir):
    """Where the pictures of a page edit go: by the page's path and a digest of the page, both sides of the edit, and the day."""
    p = table(spark, sf_dir, "pages")
    paths = U.visual_paths("edits", F.col("url"), F.lit("claim"), F.concat(F.lit("copy "), F.col("page_id").cast("string")), F.lit("2024-01-31"))
    return p.select("page_id", paths.alias("p")).select("page_id", "p.before", "p.after")


def judged_signals(spark, sf_dir):
    """Benchmark items as signals: each is analysed by recorded replies (some missing, some mended at the second attempt, else by rules), its
    actions go through all checks, and what is left becomes a message. A row for each signal."""
    from .cycle import judge

    i, q = F.col("item_id"), F.to_json
    b = table(spark, sf_dir, "benchmark").where("item_id is not null")
    items = b.select(i.alias("id"), F.coalesce(T.truncate(T.first_sentence(F.col("text")), 80), F.lit("")).alias("title"), F.lit("blog").alias("source"), F.concat(F.lit("https://acme.example/"), i.cast("string")).alias("url"), q(F.struct(F.col("text").alias("body"))).alias("raw"))
    action = F.struct(F.when(i % 4 == 3, "consider_building").otherwise("consider_enhancing").alias("type"), F.concat(F.lit("Support it: "), T.first_sentence(F.col("text"))).alias("detail"), T.first_sentence(F.col("text")).alias("gap"), F.lit("0").alias("evidence_url"), F.col("text").alias("evidence_quote"))
    good = q(F.struct(F.lit("major").alias("impact"), T.first_sentence(F.col("text")).alias("summary"), F.array(action).alias("actions")))
    replies = b.where(i % 5 != 0).select(i.alias("id"), F.lit(1).alias("attempt"), F.when(i % 5 == 1, '{"impact": "major"}').otherwise(good).alias("reply")).unionByName(b.where(i % 5 != 0).select(i.alias("id"), F.lit(2).alias("attempt"), good.alias("reply")))
    out = judge(items, P.recorded(replies), indexed(spark, sf_dir), "acme", F.lit("Acme"), docs_kind="en")
    return out.select("id", "attempts", "made_by", "n_actions", "n_dropped", "verdict", F.col("message.title").alias("title"), M.message_length(F.col("message")).cast("long").alias("n_chars"))


def run_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("n_sources"), F.sum((F.col("event_type") == "error").cast("long")).alias("n_failed"), F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("notes"))


QUERIES = {
    f.__name__: f
    for f in (
        topic_ties, topic_guard, page_target_guard, topic_by_name, page_action_gate, gate_actions, no_action_verdict, check_actions, action_lead, measured_edit, merge_revision, review_states, review_labels, no_action_check,
        issue_pairs, post_images, image_fallback, question_repair, verify_docs, context_topup, visual_paths, judged_signals, run_summary,
    )
}

_SKIP = ", ".join(f"'{s}'" for s in sorted({Q.stemmed(w) for w in Q.GENERIC}))
_VOCABULARY = ", ".join(f"('{t.label}', '{p}')" for t in Q.TOPICS for p in dict.fromkeys(Q.stemmed(x) for x in (t.label, *t.aliases, *t.keywords)))
_PHRASES = ", ".join(f"('{c.name}', '{p}')" for c in Q.CAPABILITIES for p in dict.fromkeys(Q.stemmed(k) for k in c.keywords))
#: CTEs up to ties (doc_id, n_terms, n_phrases, ties): what a document's first line is about, and whether the rest speaks of it.
_TIES = f"""titles AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, substr(text, length(string_split(text, chr(10))[1]) + 2) AS rest FROM documents), tlow AS (SELECT doc_id, lower(title || '. ') AS low FROM titles), {sql_topics('tlow')},
aw AS (SELECT doc_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS word FROM titles), bl AS (SELECT doc_id, regexp_extract_all(lower(rest), '[a-z0-9]+') AS l FROM titles),
bw AS (SELECT doc_id, x[1] AS word, x[2] AS pos FROM (SELECT doc_id, unnest(list_zip(l, range(len(l)))) AS x FROM bl)), allwords AS (SELECT word FROM aw UNION SELECT word FROM bw), {sql_stems("allwords")},
vocabulary(label, phrase) AS (VALUES {_VOCABULARY}), phrases(name, phrase) AS (VALUES {_PHRASES}),
mine AS (SELECT DISTINCT doc_id, phrase FROM topics JOIN vocabulary USING (label)), own AS (SELECT DISTINCT doc_id, unnest(string_split(phrase, ' ')) AS term FROM mine),
terms AS (SELECT DISTINCT doc_id, term FROM aw JOIN stems USING (word) WHERE length(term) >= 3 AND NOT regexp_matches(term, '^[0-9]+$') AND term NOT IN ({_SKIP}) AND NOT EXISTS (SELECT 1 FROM own WHERE own.doc_id = aw.doc_id AND own.term = stems.term)),
able AS (SELECT doc_id, unnest({_CAPABLE.replace('{x}', 'title')}) AS name FROM titles), sharp AS (SELECT DISTINCT doc_id, phrase FROM able JOIN phrases USING (name)),
hay AS (SELECT doc_id, coalesce(' ' || string_agg(term, ' ' ORDER BY pos) || ' ', '  ') AS hay FROM titles LEFT JOIN (SELECT doc_id, pos, term FROM bw JOIN stems USING (word)) USING (doc_id) GROUP BY doc_id),
nt AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY 1), np AS (SELECT doc_id, count(*) AS n FROM sharp GROUP BY 1), nm AS (SELECT doc_id, count(*) AS n FROM mine GROUP BY 1),
hit AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, term AS x FROM terms UNION ALL SELECT doc_id, phrase FROM sharp) JOIN hay USING (doc_id) WHERE contains(hay, ' ' || x || ' ')),
wide AS (SELECT DISTINCT doc_id FROM mine JOIN hay USING (doc_id) WHERE contains(hay, ' ' || phrase || ' ')),
ties AS (SELECT d.doc_id, coalesce(nt.n, 0)::BIGINT AS n_terms, coalesce(np.n, 0)::BIGINT AS n_phrases, CASE WHEN nt.n IS NOT NULL OR np.n IS NOT NULL THEN hit.doc_id IS NOT NULL ELSE nm.n IS NULL OR wide.doc_id IS NOT NULL END AS ties
  FROM titles d LEFT JOIN nt USING (doc_id) LEFT JOIN np USING (doc_id) LEFT JOIN nm USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN wide USING (doc_id))"""
_REFS = """refs AS (SELECT doc_id, x.url, x.edit FROM (SELECT doc_id, unnest([{'k': 0, 'url': doc_id % 3, 'edit': doc_id % 4 <> 0}, {'k': 1, 'url': doc_id % 3, 'edit': (doc_id + 3) % 4 <> 0}][:(doc_id % 3)::INTEGER]) AS x FROM documents))"""
_GATE = f"""{SQL_INDEX.replace("questions AS (SELECT item_id AS qid, text FROM benchmark)", _ACTIONS + ", questions AS (SELECT item_id AS qid, CASE WHEN item_id % 11 = 5 THEN 'It is cheaper' WHEN item_id % 7 <> 0 THEN " + sql_truncate('s', 240) + " ELSE '' END AS text FROM s)")},
docs_only AS (SELECT * FROM scored WHERE kind = 'en'), placed AS (SELECT *, row_number() OVER (PARTITION BY qid, section ORDER BY score DESC, url) AS place FROM docs_only WHERE score > 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, url) AS rank FROM placed WHERE place <= 3),
nq AS (SELECT qid, count(*) AS n FROM qwords JOIN stems USING (word) WHERE length(term) >= 3 AND term NOT IN ({', '.join(repr(x) for x in R.STOP_STEMS)}) GROUP BY qid),
h AS (SELECT qid, url, score, len(string_split(matched, ' ')) AS m, n, max(score) OVER (PARTITION BY qid) AS top FROM ranked JOIN nq USING (qid) WHERE rank <= 8),
strong AS (SELECT *, max(CASE WHEN url % 4 = 0 THEN score END) OVER (PARTITION BY qid) AS best FROM h WHERE m >= least(2, n) AND score >= 0.55 * top),
cover AS (SELECT qid, list(url) AS urls, count(*) FILTER (url % 4 <> 0 AND score >= greatest(coalesce(best, 0), 0.55 * top)) AS misses FROM strong GROUP BY qid),
proof AS (SELECT a.id, CASE WHEN trim(coalesce(g.text, '')) = '' THEN 'no_gap' WHEN evidence_url IS NULL THEN 'no_evidence' WHEN p.url IS NULL THEN 'not_in_corpus' WHEN p.kind <> 'en' THEN 'not_docs' WHEN NOT quoted THEN 'no_quote'
  WHEN len(parts) = 0 OR len(list_filter(parts, lambda x: NOT contains(d.body, x))) > 0 THEN 'quote_missing' END AS proof, evidence_url, g.text AS gap
  FROM actions a JOIN questions g ON g.qid = a.id LEFT JOIN held p ON p.url = a.evidence_url LEFT JOIN d ON d.doc_id = a.evidence_url),
gated AS (SELECT (id // 3)::BIGINT AS id, (id % 3)::INTEGER AS place, CASE WHEN id % 9 = 4 THEN 'docs_only' WHEN id % 11 = 5 THEN 'packaging' WHEN proof IS NOT NULL THEN proof WHEN len(urls) > 0 AND NOT list_contains(urls, evidence_url) THEN 'wrong_page_ranked' WHEN misses > 0 THEN 'covered_elsewhere' END AS cause
  FROM proof LEFT JOIN cover ON qid = id)"""
_FAULT = f"""CASE WHEN trim(coalesce(copy, '')) = '' THEN 5 WHEN length(trim(copy)) < 40 AND NOT (starts_with(trim(copy), '|') AND len(string_split(copy, '|')) >= 3) THEN 4 WHEN {sql_opens('trim(copy)', Q.NOTE)} THEN 2
  WHEN {sql_blank('trim(copy)')} THEN 3 WHEN too_much THEN 1 END"""
ORACLES = {
    "topic_ties": f"WITH {_TIES} SELECT doc_id, n_terms, n_phrases, ties FROM ties",
    "topic_by_name": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Schaft' WHEN 1 THEN 'Ration' WHEN 2 THEN 'Menter' END AS topic FROM documents",
    "page_action_gate": f"""WITH {_LINES}, r AS (SELECT doc_id % 97 AS action, doc_id % 5 <> 0 AND doc_id % 97 <> 3 AS editable, doc_id % 3 <> 0 AS suggested, CASE WHEN doc_id % 11 <> 0 THEN line END AS copy, doc_id % 13 = 0 AS too_much, doc_id % 97 % 7 <> 0 AS holds FROM lines),
f AS (SELECT *, {_FAULT} AS fault FROM r), g AS (SELECT action, bool_or(editable) AS p, bool_or(editable AND suggested) AS e, bool_or(editable AND fault IS NULL) AS ok, min(fault) FILTER (editable) AS worst, bool_or(editable AND holds) AS h FROM f GROUP BY 1)
SELECT action, CASE WHEN NOT p THEN 'page_edit_no_page' WHEN NOT e THEN 'page_edit_no_edit' WHEN NOT ok THEN CASE worst WHEN 1 THEN 'page_edit_out_of_proportion' WHEN 5 THEN 'page_edit_no_copy' ELSE 'page_edit_unusable' END WHEN NOT h THEN 'page_edit_stale_claim' END AS cause FROM g""",
    "gate_actions": f"WITH {_GATE} SELECT id, place, cause FROM gated",
    "action_lead": f"""WITH {_LINES}, llow AS (SELECT doc_id, lower(line) AS low FROM lines), {sql_topics('llow', 'doc_id', 'l')}, {_REFS}, l AS (SELECT doc_id, line, lower({sql_truncate('s', 200)}) AS said FROM (SELECT doc_id, line, {sql_sentences('trim(line)')}[1] AS s FROM lines)),
p AS (SELECT doc_id, bool_or(url <> 1) AS any_page, bool_or(url <> 1 AND edit) AS any_edit, min(url) AS url FROM refs GROUP BY 1),
n AS (SELECT doc_id, line, said, any_page, any_edit, CASE WHEN url = 0 THEN 'the compare to acme page' ELSE 'the pricing page' END AS page, CASE WHEN url = 0 THEN contains(said, 'compare') OR contains(said, 'https://docs.example.com/platform/compare-to-acme') ELSE contains(said, 'pricing') END AS named FROM l LEFT JOIN p USING (doc_id))
SELECT doc_id, CASE WHEN trim(line) = '' THEN line WHEN doc_id % 3 = 0 THEN CASE WHEN any_page IS NULL OR NOT any_page OR named THEN line ELSE 'On ' || page || ': ' || CASE WHEN any_edit THEN 'Say so ' ELSE '' END || trim(line) END
  WHEN regexp_matches(said, '^({'|'.join(A.VERBS)})\\b') THEN line WHEN doc_id % 3 = 1 THEN 'Build this into the product: ' || trim(line)
  ELSE 'Close this gap in ' || CASE WHEN doc_id % 2 = 0 THEN 'Ration' ELSE coalesce(label, 'the product') END || ': ' || trim(line) END AS detail
FROM n LEFT JOIN (SELECT doc_id, label FROM ltopics WHERE rank = 1) USING (doc_id)""",
    "merge_revision": f"""WITH k AS (SELECT doc_id, ['consider_building', 'consider_enhancing', 'update_pages'] AS k FROM documents), t AS (SELECT doc_id, k[doc_id % 3 + 1] AS a, k[(doc_id + doc_id // 3) % 3 + 1] AS b FROM k), {_REFS},
c AS (SELECT doc_id, count(*) FILTER (url = 2 AND doc_id % 3 <> 0) AS n FROM refs GROUP BY 1)
SELECT doc_id, CASE WHEN a <> 'update_pages' AND b <> 'update_pages' THEN b ELSE a END AS type, CASE WHEN doc_id % 4 = 0 THEN 'Schaft' ELSE 'Core' END AS feature, CASE WHEN doc_id % 5 = 0 THEN 'major' ELSE 'minor' END AS impact,
  CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS detail, coalesce(n, 0)::BIGINT AS n_copies,
  concat_ws(',', CASE WHEN a <> b AND (a = 'update_pages' OR b = 'update_pages') THEN 'type' END, CASE WHEN doc_id % 4 = 1 THEN 'feature' END, CASE WHEN doc_id % 3 <> 0 THEN 'edits' END) AS refused FROM t LEFT JOIN c USING (doc_id)""",
    "review_states": """WITH l AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1),
t AS (SELECT doc_id AS id, doc_id % 10 = 0 AS done, CASE WHEN toxic = 1 THEN 'drop' WHEN quality = 1 THEN 'agree' WHEN quality = 0 THEN 'revise' END AS v FROM documents LEFT JOIN l USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY done ORDER BY id) AS n FROM t) SELECT id, CASE WHEN done THEN 'left' WHEN n <= 120 THEN coalesce(v, 'skipped') ELSE 'skipped' END AS state FROM r""",
    "no_action_check": """WITH e AS (SELECT event_id AS id, ['already_covered', 'not_a_gap', 'unverified'][event_id % 3 + 1] AS kind, CASE WHEN event_id % 2 = 0 THEN 'Ration' END AS feature, event_id % 7 AS a, event_id % 5 AS b, event_id % 4 = 0 AS misquoted FROM events),
g AS (SELECT *, list_filter([CASE WHEN a < 3 AND NOT misquoted THEN a END, CASE WHEN b < 3 THEN b END], lambda x: x IS NOT NULL) AS good FROM e)
SELECT id, CASE WHEN kind = 'already_covered' AND len(good) = 0 THEN 'unverified' ELSE kind END AS kind, CASE WHEN kind <> 'already_covered' THEN feature WHEN len(good) > 0 THEN coalesce(feature, 'Title ' || good[1]) END AS feature,
  array_to_string(CASE WHEN kind = 'already_covered' THEN good ELSE [a, b] END, ',') AS pages FROM g""",
    "post_images": """WITH m AS (SELECT event_id AS k, coalesce(CASE WHEN event_id % 3 = 0 THEN 'u' || event_id END, CASE WHEN event_id % 5 = 0 THEN 'p' || event_id END) AS u FROM events WHERE event_id % 2 = 1)
SELECT e.event_id AS id, coalesce(a.u, b.u, c.u) AS image FROM events e LEFT JOIN m a ON a.k = e.event_id + 1 LEFT JOIN m b ON b.k = e.event_id + 3 LEFT JOIN m c ON c.k = e.event_id + 5 WHERE e.event_id % 2 = 0""",
    "image_fallback": """WITH u AS (SELECT event_id AS i, event_id || CASE WHEN event_id % 3 = 0 THEN '-og-default.png' ELSE '.png' END AS n FROM events), p AS (SELECT i, CASE WHEN i % 7 = 0 THEN 'feed' || n END AS feed, CASE WHEN i % 5 <> 0 AND i % 2 = 0 THEN 'page' || n END AS page, CASE WHEN i % 4 = 0 THEN 'shot' || n END AS shot FROM u)
SELECT i AS event_id, coalesce(feed, CASE WHEN i % 3 <> 0 THEN page END, shot, page, 'made') AS image, CASE WHEN feed IS NOT NULL THEN 'feed' WHEN page IS NOT NULL AND i % 3 <> 0 THEN 'page' WHEN shot IS NOT NULL THEN 'screenshot' WHEN page IS NOT NULL THEN 'page' ELSE 'generated' END AS origin FROM p""",
    "question_repair": f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text || ' word'), '[a-z0-9]+')[1] AS x FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Do we know whether ' || x || ' holds?' WHEN 1 THEN 'The page is old: does ' || x || ' hold?' WHEN 2 THEN 'What is ' || x || '?' WHEN 3 THEN 'Is ' || x || ' so?'
  ELSE CASE WHEN x IN ('whether', 'if') THEN 'Do we know ' || x || '?' WHEN x IN ({', '.join(repr(x) for x in Q.OPENERS)}) THEN upper(left(x, 1)) || substr(x, 2) || '?' END END AS question FROM t""",
    "verify_docs": f"""WITH {_LINES}, llow AS (SELECT doc_id, lower(line) AS low FROM lines), {sql_topics('llow')}, c(label, docs) AS (VALUES {_DOCS}),
a AS (SELECT doc_id, doc_id % 2 = 0 AS building, {sql_gap('line', 'acme')} AS claims, label, docs[1] AS doc
  FROM lines LEFT JOIN (SELECT doc_id, label, docs FROM topics JOIN c USING (label) WHERE rank = 1 AND doc_id % 3 <> 0) USING (doc_id))
SELECT doc_id AS id, CASE WHEN building AND doc IS NULL THEN 'consider_building' ELSE 'consider_enhancing' END AS type, label AS feature, CASE WHEN building OR claims THEN doc END AS cites, doc IS NULL AND claims AS asks FROM a""",
    "context_topup": f"""WITH {_TOPICS}, c(label, docs) AS (VALUES {_DOCS}), n AS (SELECT doc_id, rank, label, docs[1] AS doc FROM topics JOIN c USING (label) WHERE NOT (doc_id % 2 = 0 AND rank = 1)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, doc) AS k FROM n) SELECT doc_id, doc FROM p WHERE k <= 3""",
    "visual_paths": f"""WITH {SQL_URLS}, s AS (SELECT page_id, {_slug("array_to_string(segs, '-')", 60)} AS slug, left(sha1(url || chr(10) || 'claim' || chr(10) || 'copy ' || page_id || chr(10) || '2024-01-31'), 10) AS digest FROM u), t AS (SELECT page_id, 'edits/' || CASE WHEN slug = '' THEN 'page' ELSE slug END || '-' || digest AS stem FROM s)
SELECT page_id, stem || '-before.png' AS before, stem || '-after.png' AS after FROM t""",
    "run_summary": "SELECT count(*) AS n, count(DISTINCT event_type) AS n_sources, count(*) FILTER (event_type = 'error')::BIGINT AS n_failed, array_to_string(list_sort(list(DISTINCT event_type)), ', ') AS notes FROM events",
    "topic_guard": f"WITH {_TIES} SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 AND NOT ties THEN 'off_topic' END AS dropped FROM ties",
    "page_target_guard": f"""WITH {_REFS}, b AS (SELECT doc_id, count(*) FILTER (edit) > 0 AND count(*) FILTER (edit AND url <> 1) = 0 AS bad FROM refs GROUP BY 1), a AS (SELECT doc_id AS id, unnest(range(doc_id % 2 + 1))::INTEGER AS place FROM documents)
SELECT id, place, CASE WHEN place = 0 AND bad THEN 'docs_pages' END AS dropped FROM a LEFT JOIN b ON doc_id = id""",
    "no_action_verdict": f"""WITH {_GATE}, k AS (SELECT id, bool_or(cause IN ('covered_elsewhere', 'wrong_page_ranked')) AS covered, bool_and(cause IN ('packaging', 'docs_only')) AS none FROM gated WHERE cause IS NOT NULL GROUP BY id)
SELECT id, CASE WHEN covered THEN 'already_covered' WHEN none THEN 'not_a_gap' ELSE 'unverified' END AS kind FROM k""",
    "measured_edit": f"""WITH w AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), c AS (SELECT doc_id, text, l, regexp_replace(lower(l[-1]), '[^a-z0-9]+', '', 'g') AS q FROM w),
p AS (SELECT doc_id, text, l, coalesce(CASE WHEN q <> '' THEN list_filter(list_transform(l, lambda x: trim(x)), lambda x: contains(regexp_replace(lower(x), '[^a-z0-9]+', '', 'g'), q))[1] END, l[-1]) AS passage FROM c),
n AS (SELECT doc_id, trim(l[1]) = '' OR trim(text) = '' AS none, 2 * {_WC('l[1]')} AS added, {_WC('passage')} AS passage, {_WC('text')} AS page FROM p), a AS (SELECT *, greatest(45, least(passage, floor(page * 0.2::DOUBLE + 0.5)))::BIGINT AS allowed FROM n)
SELECT doc_id, CASE WHEN NOT none THEN added END AS added, CASE WHEN NOT none THEN passage END AS passage, CASE WHEN NOT none THEN page END AS page, CASE WHEN NOT none THEN allowed END AS allowed, CASE WHEN NOT none THEN added > allowed END AS too_much FROM a""",
    "review_labels": """WITH e AS (SELECT event_id, 'a,' || CASE WHEN event_id % 2 = 0 THEN 'review-pass:done' ELSE 'b' END AS had, event_id % 5 AS s, CASE event_id % 5 WHEN 0 THEN ',review:agreed' WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN ',review:revised' ELSE ',review:unconfirmed' END WHEN 2 THEN ',review:dropped' WHEN 3 THEN ',review:skipped' ELSE '' END AS own FROM events)
SELECT event_id, had || own || CASE WHEN s < 3 AND event_id % 2 = 1 THEN ',review-pass:done' ELSE '' END AS labels FROM e""",
    "issue_pairs": "SELECT event_id, 'a' || CASE WHEN event_id % 4 > 0 THEN event_id::VARCHAR ELSE '-' END || ',b' || CASE WHEN event_id % 4 > 1 THEN (event_id + 1)::VARCHAR ELSE '-' END || ',c' || CASE WHEN event_id % 4 > 2 THEN (event_id + 2)::VARCHAR ELSE '-' END AS pairs FROM events",
}
