"""Queries of routing, rules and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import needle_counts
from ..operators import gate as G
from ..operators import messages as M
from ..operators import retrieval as R
from ..operators import routing as Q
from ..operators import signals as S
from .base import bodies, indexed, questions, table
from .scalars import SQL_URLS, _nq, _parts
from .search import SQL_INDEX, sql_collapse, sql_sentences, sql_truncate

ALIASES = {"alder": ("thing", "heed"), "birch": ("schaft", "ration"), "cedar": ("eaux",)}
#: Leads that make documents into lines of the kinds that the rules tell apart.
LEADS = (
    "", "Announcing a faster ", "You can now use ", "Acme has no way to ", "Is it so? ", "Add a line about ", "Pricing is [to be done] for ", "There is no equivalent. What is ", "Note: why ",
)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id is not null")


def _lines(spark, sf_dir):
    """Documents with a lead that gives them what the rules look for; the whole text follows it."""
    lead = F.element_at(F.array(*map(F.lit, LEADS)), (F.col("doc_id") % len(LEADS) + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", F.concat(lead, T.collapse(F.col("text")), F.when(F.col("doc_id") % 4 == 0, "?").otherwise("")).alias("line"), lead.alias("lead"))


def _line(**columns):
    def run(spark, sf_dir):
        return _lines(spark, sf_dir).select("doc_id", *[f(F.col("line")).alias(c) for c, f in columns.items()])

    return run


def topic_match(spark, sf_dir):
    return Q.match_topics(_docs(spark, sf_dir), "doc_id", F.col("text"))


def keyword_occurrences(spark, sf_dir):
    counted = _docs(spark, sf_dir).select("doc_id", needle_counts(F.lower("text"), ("the", "of the", "thing")).alias("n"))
    return counted.select("doc_id", *[F.col("n")[i].cast("long").alias(name) for i, name in enumerate(("n_short", "n_phrase", "n_part"))])


def route_teams(spark, sf_dir):
    return Q.match_teams(_docs(spark, sf_dir), "doc_id", F.col("text"))


def _asked():
    """(suggested teams, feature, kind) of a document's action."""
    i = F.col("doc_id")
    suggested = F.when(i % 5 == 0, Q.strings(("Nobody", "the Platform Engineering team"))).otherwise(Q.strings(()))
    return suggested, F.when(i % 3 == 0, "Schaft"), F.when(i % 2 == 0, "update_pages").otherwise("consider_building")


def related_teams(spark, sf_dir):
    suggested, feature, kind = _asked()
    return _docs(spark, sf_dir).select("doc_id", F.array_join(Q.related_teams(suggested, feature, F.col("text"), kind), ",").alias("teams"))


def team_lookup(spark, sf_dir):
    """Names of teams as somebody writes them, and who owns a surface."""
    names = ("Core", "the Growth team", "platform-engineering", "Platform  Engineering", "Engineering", "The \"Core\" Team")
    features = ("the ration plan", "Schaft", "Core", "nothing")
    i = F.col("doc_id")
    pick = lambda v: F.element_at(Q.strings(v), (i % len(v) + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", Q.find_team(pick(names)).alias("team"), F.array_join(Q.teams_owning(pick(features)), ",").alias("owners"))


def capabilities(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(Q.match_capabilities(F.col("text")), ",").alias("names"))


def docs_for_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(Q.docs_for_text(F.col("text")), ",").alias("docs"))


def topics_for_action(spark, sf_dir):
    feature = F.when(F.col("doc_id") % 3 == 0, "the Tionable plan").when(F.col("doc_id") % 3 == 1, "nothing")
    d = _docs(spark, sf_dir).select("doc_id", F.array_join(Q.topics_for_action(feature, F.col("text")), ",").alias("topics"), Q.topic_of_doc(F.element_at(Q.docs_for_text(F.col("text")), -1)).alias("_last"))
    return d.drop("_last")


def doc_lookup(spark, sf_dir):
    """The topic that lists a document."""
    docs = [d for t in Q.TOPICS for d in t.docs] + ["oning/overview", "none"]
    url = F.element_at(Q.strings(docs), (F.col("doc_id") % len(docs) + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", Q.topic_of_doc(url).alias("topic"))


def round_robin_docs(spark, sf_dir):
    return Q.round_robin_docs(Q.match_topics(_docs(spark, sf_dir), "doc_id", F.col("text")), "doc_id")


def mentions(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(Q.mentions(F.col("text"), ALIASES), ",").alias("names"))


def claims_extract(spark, sf_dir):
    return Q.claims(_docs(spark, sf_dir), "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")), ALIASES)


def compare_claims(spark, sf_dir):
    """What documents, as pages of their language, say of three aliases, line by line."""
    d = _docs(spark, sf_dir).select(F.col("source").alias("name"), F.col("doc_id").alias("page"), F.concat(F.lit("https://other.example/"), "doc_id").alias("url"), F.posexplode(F.split("text", "\n")).alias("pos", "paragraph"))
    return Q.compare_claims(d.withColumn("heading", F.concat(F.lit("line "), "pos")), ("thing", "schaft", "eaux"))


def _claims(spark, sf_dir):
    found = claims_extract(spark, sf_dir)
    tier = F.element_at(F.array(*map(F.lit, ("compare-to-alder", "migrate-from-alder", "alder", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return found.select(F.concat(tier, F.lit("/"), F.col("doc_id").cast("string")).alias("url"), "paragraph").distinct()


def ranked_claims(spark, sf_dir):
    return Q.ranked_claims(_claims(spark, sf_dir), "alder", 32)


def diversify_claims(spark, sf_dir):
    from pyspark.sql import Window

    ranked = ranked_claims(spark, sf_dir)
    ranked = ranked.withColumn("url", F.concat("tier", F.lit("/"), F.char_length("paragraph") % 3))
    order = Window.partitionBy(F.lit(0)).orderBy("tier", F.desc(F.char_length("paragraph")), "url", "paragraph")  # 32 rows at most
    return Q.diversify(ranked.withColumn("place", F.row_number().over(order)))


def _actions(spark, sf_dir):
    """Benchmark items as actions: gaps, cited documents and quotes, some of them missing or wrong."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    quotes = b.select(F.col("id").alias("item_id"), T.quote_parts(F.col("text")).alias("parts")).where(F.size("parts") > 0)
    hit = G.quote_hits(quotes, bodies(spark, sf_dir)).groupBy("item_id").agg(F.min("doc_id").alias("hit")).withColumnRenamed("item_id", "id")
    i = F.col("id")
    return b.join(hit, "id", "left").select(
        "id",
        F.when(i % 7 != 0, T.first_sentence(F.col("text"))).alias("gap"),
        F.when(i % 5 == 0, None).when(i % 5 == 1, F.lit(-1)).otherwise(F.coalesce("hit", i * 3)).cast("long").alias("evidence_url"),
        F.when(i % 8 != 2, F.col("text")).alias("quote"),
    )


def _causes(spark, sf_dir):
    pages = _docs(spark, sf_dir).select(F.col("doc_id").alias("url"), F.when(F.col("lang") == "es", "marketing").otherwise("docs").alias("kind"), T.normal_quote(F.coalesce("text", F.lit(""))).alias("body"))
    return G.evidence_cause(_actions(spark, sf_dir), pages)


def gate_cause(spark, sf_dir):
    return _causes(spark, sf_dir).select("id", "evidence_url", "cause")


def verdict_rollup(spark, sf_dir):
    return G.verdict_rollup(_causes(spark, sf_dir).withColumn("part", F.col("id") % 6), "part")


def coverage_misses(spark, sf_dir):
    asked = questions(spark, sf_dir)
    hits = R.search(indexed(spark, sf_dir), asked, limit=8, per_section=3)
    n = asked.select("qid", F.size(R.terms(F.col("text"))).alias("n")).where("n > 0")
    read = _docs(spark, sf_dir).where("doc_id % 4 = 0").select(F.col("doc_id").alias("url"))
    return G.coverage_misses(hits, n, read)


def context_union(spark, sf_dir):
    """The best documents for each question, and the overviews (every 50th document stands for one) of its best topics, where they aren't among them."""
    asked = questions(spark, sf_dir).withColumn("topics", Q.top_topics(F.col("text"), 3))
    overviews = spark.createDataFrame([(t.label, 50 * (i + 1)) for i, t in enumerate(Q.TOPICS)], "label string, url long")
    return R.context(indexed(spark, sf_dir), asked, overviews).select("qid", "url", "why")


def allowed_words(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", T.word_count(F.substring_index("text", "\n", 1)).alias("passage"), T.word_count(F.col("text")).alias("page"))
    return d.select("doc_id", G.allowed_words(F.col("passage"), F.col("page")).cast("long").alias("allowed"))


def embed_budget(spark, sf_dir):
    f = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length(F.coalesce("text", F.lit(""))).alias("size"))
    return G.embed_budget(f, "conv_id", "turn", F.col("size"), 3, 900).select("conv_id", "turn", F.col("total").cast("long").alias("total"))


def read_log(spark, sf_dir):
    """Which files a conversation read, in the order in which it did first: of turns as steps, those that are calls to read a file."""
    t = F.col("turn")
    call = F.struct(F.when(t % 3 == 2, "grep").otherwise("read").alias("type"), F.struct(F.when(t % 4 == 3, " ").otherwise(F.concat(F.lit("docs/"), F.char_length(F.coalesce("text", F.lit(""))) % 7, F.lit(".md"))).alias("path")).alias("args"))
    step = F.to_json(F.struct(F.when(F.col("role") == "assistant", "toolCall").otherwise("text").alias("type"), call.alias("message")))
    return S.read_paths(table(spark, sf_dir, "conversations").select("conv_id", "turn", step.alias("step")), "conv_id", "turn", F.col("step"))


def issue_labels(spark, sf_dir):
    suggested, feature, kind = _asked()
    lines = _lines(spark, sf_dir)
    labels = M.issue_labels(kind, feature, F.col("line"), F.when(F.col("doc_id") % 2 == 0, "blog").otherwise("x"), Q.impact(F.col("line")), F.lit("acme"), suggested)
    title = M.issue_title(F.lit("Acme"), F.col("line"), F.when(F.col("doc_id") % 4 == 0, "consider_enhancing").otherwise(kind), feature)
    return lines.select("doc_id", F.array_join(labels, ",").alias("labels"), title.alias("title"))


def packaging_gap(spark, sf_dir):
    """Leads alone, or with their document, as gaps."""
    gap = F.when(F.col("doc_id") % 2 == 0, F.col("lead")).otherwise(F.col("line"))
    return _lines(spark, sf_dir).select("doc_id", Q.is_packaging(gap).alias("packaging"), Q.is_documentation_only(F.concat(F.when(F.col("doc_id") % 3 == 0, "Add the docs of ").when(F.col("doc_id") % 3 == 1, "Documents: ").otherwise("Write up docs: "), F.col("line"))).alias("docs_only"))


def embed_limits(spark, sf_dir):
    """Conversations as messages, a turn a field; the last field's place and the length that is left."""
    c = table(spark, sf_dir, "conversations")
    fields = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("name"), F.repeat(F.coalesce("text", F.lit("")), F.lit(3)).alias("value")))), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    m = c.groupBy("conv_id").agg(fields.alias("fields")).select("conv_id", M.within_limits(F.struct(F.lit("T").alias("title"), F.repeat(F.lit("d"), F.lit(40)).alias("description"), F.col("fields"), F.lit("f").alias("footer"))).alias("m"))
    return m.select("conv_id", F.size("m.fields").cast("long").alias("n_fields"), M.message_length(F.col("m")).cast("long").alias("length"))


def render_no_action(spark, sf_dir):
    i = F.col("page_id")
    kinds = ("already_covered", *M.VERDICT_TITLES)
    web = F.array(F.struct(F.trim("url").alias("url"), F.when(i % 2 == 0, "A *title*").alias("title")), F.struct(F.lit("file:///x").alias("url"), F.lit("no").alias("title")), *[F.struct(F.concat(F.lit(f"https://e{k}.example/p"), i).alias("url"), F.lit(f"T{k}").alias("title")) for k in range(3)])
    verdict = F.struct(F.element_at(Q.strings(kinds), (i % 5 + 1).cast("int")).alias("kind"), F.when(i % 2 == 0, "Ration").alias("feature"), F.concat(F.lit("Because_"), i.cast("string")).alias("reason"), F.slice(web, F.lit(1), (i % 6).cast("int")).alias("evidence"))
    return table(spark, sf_dir, "pages").select("page_id", M.render_no_action(verdict, "Acme").alias("said"))


QUERIES = {
    **{
        f.__name__: f
        for f in (
            topic_match, keyword_occurrences, route_teams, related_teams, team_lookup, capabilities, docs_for_text, topics_for_action, doc_lookup, round_robin_docs, mentions, claims_extract, compare_claims,
            ranked_claims, diversify_claims, gate_cause, verdict_rollup, coverage_misses, context_union, allowed_words, embed_budget, embed_limits, render_no_action, read_log, issue_labels, packaging_gap,
        )
    },
    "impact_heuristic": _line(impact=Q.impact),
    "gap_claim": _line(claims_gap=lambda x: Q.claims_gap(x, "acme")),
    "is_question": _line(asks=Q.is_question),
    "copy_fault": _line(fault=Q.copy_fault),
}

_LEADS = ", ".join("'" + x + "'" for x in LEADS)
_LINES = f"""lines AS (SELECT doc_id, [{_LEADS}][doc_id % {len(LEADS)} + 1] || {sql_collapse("text")} || CASE WHEN doc_id % 4 = 0 THEN '?' ELSE '' END AS line, [{_LEADS}][doc_id % {len(LEADS)} + 1] AS lead FROM documents)"""


def _any(x, phrases):
    return "(" + " OR ".join(f"contains(lower({x}), '{p}')" for p in phrases) + ")"


_IMPACT = f"CASE WHEN {_any('line', Q.NEW)} THEN 'major' WHEN {_any('line', Q.BETTER)} THEN 'notable' ELSE 'minor' END"


def _count(k):
    if len(k) <= 4 and " " not in k:
        return f"len(regexp_extract_all(low, '\\b{k}(?:e?s)?\\b'))"
    return f"((length(low) - length(replace(low, '{k}', ''))) // {len(k)})"


def _score(t):
    parts = [f"{_count(k)} * {3 if i == 0 else 2 if ' ' in k else 1}" for i, k in enumerate(t.keywords)]
    if t.label.lower() not in t.keywords:
        parts.append(f"CASE WHEN contains(low, '{t.label.lower()}') THEN 3 ELSE 0 END")
    return " + ".join(parts)


def sql_topics(low: str, key: str = "doc_id", prefix: str = "") -> str:
    """CTEs scored and topics (key, label, score, rank) of a table (key, low) of lower-case texts; the names take a prefix."""
    each = " UNION ALL ".join(f"SELECT {key}, '{t.label}' AS label, ({_score(t)})::BIGINT AS score FROM {low}" for t in Q.TOPICS)
    return f"""{prefix}scored AS ({each}),
{prefix}topics AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, label)::INTEGER AS rank FROM {prefix}scored WHERE score > 0) WHERE rank <= 3)"""


_TOPICS = "low AS (SELECT doc_id, lower(text) AS low FROM documents), " + sql_topics("low")


def sql_teams(low: str, key: str = "doc_id") -> str:
    """The CTE teams (key, team, score, rank) of a table (key, low)."""
    has = lambda x, w: f"CASE WHEN contains(low, '{x}') THEN {w} ELSE 0 END"
    each = " UNION ALL ".join(f"SELECT {key}, '{t.name}' AS team, (" + " + ".join([*[has(o.lower(), 4) for o in t.owns], *[has(k, 2) for k in t.keywords]]) + f")::BIGINT AS score FROM (SELECT {key}, {sql_collapse('low')} AS low FROM {low})" for t in Q.TEAMS)
    return f"tscored AS ({each}), teams AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, team)::INTEGER AS rank FROM tscored WHERE score > 0)"


_OWNERS = "owners(label, team) AS (VALUES " + ", ".join(f"('{o}', '{t.name}')" for t in Q.TEAMS for o in t.owns) + ")"


def sql_related(low: str) -> str:
    """CTEs up to related (doc_id, teams: list) of a table (doc_id, low): the action's feature, Schaft for every third, is part of its text."""
    return f"""{sql_topics(low)}, pointed_at AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'schaft ' ELSE '' END || low AS low FROM {low}), {sql_teams('pointed_at')}, {_OWNERS},
about AS (SELECT doc_id, 'Schaft' AS label, 0 AS place FROM {low} WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, label, rank FROM topics),
derived AS (SELECT doc_id, team, min(place) AS place FROM (SELECT doc_id, team, place FROM about JOIN owners USING (label) UNION ALL SELECT doc_id, team, 10 + rank FROM teams WHERE rank <= 3) GROUP BY ALL),
related AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ['Platform Engineering'] WHEN l IS NOT NULL THEN l[:3] WHEN doc_id % 2 = 0 THEN ['Growth'] ELSE ['Core'] END AS teams FROM {low} LEFT JOIN (SELECT doc_id, list(team ORDER BY place) AS l FROM derived GROUP BY 1) USING (doc_id))"""


_DOCS = ", ".join(f"('{t.label}', [{', '.join(repr(d) for d in t.docs)}])" for t in Q.TOPICS)
_NAMES = " || ".join(f"CASE WHEN {_any('{x}', a)} THEN ['{n}'] ELSE []::VARCHAR[] END" for n, a in ALIASES.items())
_CLAIMS = f"""paras AS (SELECT doc_id, x[1] AS p, x[2] AS pos FROM (SELECT doc_id, unnest(list_zip(l, range(len(l)))) AS x FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n{{2,}}'), lambda p: trim(p)), lambda p: p <> '') AS l FROM documents)) WHERE length(x[1]) >= 60),
named AS (SELECT doc_id, p, pos, x[1] AS name, x[2] AS n FROM (SELECT doc_id, p, pos, unnest(list_zip(l, range(len(l)))) AS x FROM (SELECT doc_id, p, pos, {_NAMES.replace("{x}", "p")} AS l FROM paras))),
once AS (SELECT doc_id, name, p, min((pos, n)) AS first FROM named GROUP BY ALL),
claims AS (SELECT doc_id, name, {sql_truncate("p", 1200)} AS paragraph, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first)::INTEGER AS place FROM once) WHERE place <= 12)"""
_RANKED = f"""{_CLAIMS}, urls AS (SELECT DISTINCT ['compare-to-alder', 'migrate-from-alder', 'alder', 'other'][doc_id % 4 + 1] || '/' || doc_id AS url, paragraph FROM claims),
ranked AS (SELECT url, paragraph, (CASE WHEN contains(url, 'compare-to-alder') THEN 0 WHEN contains(url, 'migrate-from-alder') THEN 1 WHEN contains(url, 'alder') THEN 2 ELSE 3 END)::INTEGER AS tier FROM urls ORDER BY tier, length(paragraph) DESC, url, paragraph LIMIT 32)"""
_ACTIONS = f"""q AS (SELECT item_id, text, {_parts('text')} AS parts FROM benchmark), d AS (SELECT doc_id, lang, {_nq("coalesce(text, '')")} AS body FROM documents),
hit AS (SELECT item_id, min(doc_id) AS hit FROM q JOIN d ON len(parts) > 0 AND len(list_filter(parts, lambda p: NOT contains(body, p))) = 0 GROUP BY 1),
s AS (SELECT item_id, {sql_sentences('text')}[1] AS s FROM benchmark),
actions AS (SELECT item_id AS id, CASE WHEN item_id % 7 <> 0 THEN {sql_truncate('s', 240)} END AS gap, CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE coalesce(hit, item_id * 3) END::BIGINT AS evidence_url, item_id % 8 <> 2 AS quoted, parts
  FROM q LEFT JOIN hit USING (item_id) JOIN s USING (item_id)),
causes AS (SELECT id, evidence_url, CASE WHEN trim(coalesce(gap, '')) = '' THEN 'no_gap' WHEN evidence_url IS NULL THEN 'no_evidence' WHEN doc_id IS NULL THEN 'not_in_corpus' WHEN lang = 'es' THEN 'not_docs' WHEN NOT quoted THEN 'no_quote'
  WHEN len(parts) = 0 OR len(list_filter(parts, lambda p: NOT contains(body, p))) > 0 THEN 'quote_missing' END AS cause FROM actions LEFT JOIN d ON doc_id = evidence_url)"""
_WC = lambda x: f"len(list_filter(string_split_regex(lower({x}), '[ \\t\\n\\r\\f\\x0B\\x{{A0}}]+'), lambda w: regexp_matches(w, '[a-z0-9]')))"
_CAP = """placed AS (SELECT *, row_number() OVER (PARTITION BY qid, section ORDER BY score DESC, url) AS place FROM scored WHERE score > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, url) AS rank FROM placed WHERE place <= {cap})"""

_CAPABLE = "list_filter([" + ", ".join(f"CASE WHEN {_any('{x}', c.keywords)} THEN '{c.name}' END" for c in Q.CAPABILITIES) + "], lambda n: n IS NOT NULL)"
_CAPABILITY_DOCS = ", ".join(f"('{c.name}', [{', '.join(repr(d) for d in c.docs)}])" for c in Q.CAPABILITIES)
#: The number of a question's searchable words, repeats counted.
SQL_ASKED = f"asked_terms AS (SELECT qid, count(*) AS n FROM qwords JOIN stems USING (word) WHERE length(term) >= 3 AND term NOT IN ({', '.join(repr(x) for x in R.STOP_STEMS)}) GROUP BY qid)"


def sql_blank(x: str) -> str:
    """has_blank() in SQL."""
    return (
        f"(regexp_matches(regexp_replace({x}, '\\[[^\\]]*\\]\\(', '(', 'g'), '\\[[^\\]]*\\s[^\\]]*\\]') OR regexp_matches({x}, '\\{{[^\\}}]*\\s[^\\}}]*\\}}') "
        f"OR regexp_matches({x}, '(?i)\\b(TBD|TODO|XXX)\\b') OR contains({x}, '...') OR contains({x}, '…'))"
    )


def _sql_texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_gap(text: str, product: str) -> str:
    """Whether a text claims a gap, by words between stops."""
    words = "list_transform(regexp_extract_all(r, '[a-z0-9_'']+'), lambda w: regexp_replace(trim(w, chr(39)), '''s$', ''))"
    runs = f"list_transform(string_split_regex(lower({text}), '[.?!]'), lambda r: ' ' || array_to_string({words}, ' ') || ' ')"

    def after(first: str, phrases, n: int) -> str:
        near = f"len(list_filter({_sql_texts(phrases)}, lambda p: instr(' ' || t || ' ', ' ' || p || ' ') BETWEEN 1 AND {n + 1})) > 0"
        return f"len(list_filter({runs}, lambda r: len(list_filter(string_split(r, ' {first} ')[2:], lambda t: {near})) > 0)) > 0"

    return f"({after(product, Q.LACKS, Q.LACKS_WITHIN)} OR {after('no', Q.EQUALS, Q.EQUALS_WITHIN)})"


def sql_opens(text: str, tree: dict, at: int = 1) -> str:
    """Whether a text opens with a sequence of words of a tree."""
    word, found = f"coalesce(string_split(lower({text}), ' ')[{at}], '')", []
    for keys, rest in tree.items():
        names = ", ".join(repr(k) for k in ((keys,) if isinstance(keys, str) else keys))
        found.append(f"regexp_extract({word}, '^[a-z'']*') IN ({names})" if not rest else f"({word} IN ({names}) AND {sql_opens(text, rest, at + 1)})")
    return "(" + " OR ".join(found) + ")"


ORACLES = {
    "topic_match": f"WITH {_TOPICS} SELECT * FROM topics",
    "keyword_occurrences": f"WITH low AS (SELECT doc_id, lower(text) AS low FROM documents) SELECT doc_id, {_count('the')}::BIGINT AS n_short, {_count('of the')}::BIGINT AS n_phrase, {_count('thing')}::BIGINT AS n_part FROM low",
    "route_teams": f"WITH low AS (SELECT doc_id, lower(text) AS low FROM documents), {sql_teams('low')} SELECT doc_id, team, score, rank FROM teams WHERE rank <= 3",
    "related_teams": f"WITH low AS (SELECT doc_id, lower(text) AS low FROM documents), {sql_related('low')} SELECT doc_id, array_to_string(teams, ',') AS teams FROM related",
    "round_robin_docs": f"""WITH {_TOPICS}, c(label, docs) AS (VALUES {_DOCS}), e AS (SELECT doc_id, rank, unnest(list_zip(docs, range(len(docs)))) AS x FROM topics JOIN c USING (label)),
p AS (SELECT doc_id, x[1] AS doc, row_number() OVER (PARTITION BY doc_id ORDER BY x[2], rank)::INTEGER AS place FROM e) SELECT * FROM p WHERE place <= 6""",
    "mentions": f"SELECT doc_id, array_to_string({_NAMES.replace('{x}', 'text')}, ',') AS names FROM documents",
    "claims_extract": f"WITH {_CLAIMS} SELECT * FROM claims",
    "ranked_claims": f"WITH {_RANKED} SELECT * FROM ranked",
    "diversify_claims": f"""WITH {_RANKED}, r AS (SELECT tier || '/' || (length(paragraph) % 3) AS url, paragraph, tier FROM ranked), p AS (SELECT *, row_number() OVER (ORDER BY tier, length(paragraph) DESC, url, paragraph)::INTEGER AS place FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY place) AS n FROM p) SELECT url, paragraph, tier, place FROM n WHERE n <= 2 ORDER BY place LIMIT 8""",
    "gate_cause": f"WITH {_ACTIONS} SELECT * FROM causes",
    "verdict_rollup": f"""WITH {_ACTIONS}, v AS (SELECT id % 6 AS part, CASE WHEN cause IN ('covered_elsewhere', 'wrong_page_ranked') THEN 'already_covered' WHEN cause IN ('packaging', 'docs_only') THEN 'not_a_gap' WHEN cause IS NOT NULL THEN 'unverified' END AS v FROM causes)
SELECT part, CASE WHEN count(v) = 0 THEN 'kept' WHEN bool_or(v = 'already_covered') THEN 'already_covered' WHEN bool_and(v = 'not_a_gap') THEN 'not_a_gap' ELSE 'unverified' END AS verdict, count(v) AS n FROM v GROUP BY part""",
    "coverage_misses": f"""WITH {SQL_INDEX}, {_CAP.format(cap=3)}, {SQL_ASKED},
h AS (SELECT qid, url, score, len(string_split(matched, ' ')) AS m, n, max(score) OVER (PARTITION BY qid) AS top FROM ranked JOIN asked_terms USING (qid) WHERE rank <= 8),
s AS (SELECT *, max(CASE WHEN url % 4 = 0 THEN score END) OVER (PARTITION BY qid) AS best FROM h WHERE m >= least(2, n) AND score >= 0.55 * top)
SELECT qid, url, score FROM s WHERE url % 4 <> 0 AND score >= greatest(coalesce(best, 0), 0.55 * top)""",
    "context_union": f"""WITH {SQL_INDEX}, {_CAP.format(cap=4)}, best AS (SELECT qid, url FROM ranked WHERE rank <= 10), qlow AS (SELECT qid, lower(text) AS low FROM questions), {sql_topics('qlow', 'qid', 'q')},
over(label, url) AS (VALUES {', '.join(f"('{t.label}', {50 * (i + 1)})" for i, t in enumerate(Q.TOPICS))}),
extra AS (SELECT qid, url FROM qtopics JOIN over USING (label) JOIN held USING (url) WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.qid = qtopics.qid AND b.url = over.url))
SELECT qid, url, 'search' AS why FROM best UNION ALL SELECT qid, url, 'overview' FROM extra""",
    "allowed_words": f"WITH w AS (SELECT doc_id, {_WC('string_split(text, chr(10))[1]')} AS passage, {_WC('text')} AS page FROM documents) SELECT doc_id, greatest(45, least(passage, floor(page * 0.2::DOUBLE + 0.5)))::BIGINT AS allowed FROM w",
    "embed_budget": "WITH t AS (SELECT conv_id, turn, row_number() OVER w AS place, sum(length(coalesce(text, ''))) OVER w AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT conv_id, turn, total::BIGINT AS total FROM t WHERE place <= 3 AND total <= 900",
    "read_log": """WITH p AS (SELECT conv_id, 'docs/' || (length(coalesce(text, '')) % 7) || '.md' AS path, turn FROM conversations WHERE role = 'assistant' AND turn % 3 <> 2 AND turn % 4 <> 3), f AS (SELECT conv_id, path, min(turn) AS first FROM p GROUP BY ALL)
SELECT conv_id, path, row_number() OVER (PARTITION BY conv_id ORDER BY first)::INTEGER AS place FROM f""",
    "issue_labels": f"""WITH {_LINES}, low AS (SELECT doc_id, lower(line) AS low FROM lines), {sql_related('low')},
k AS (SELECT doc_id, line, teams, {_IMPACT} AS impact, CASE WHEN doc_id % 2 = 0 THEN 'update_pages' ELSE 'consider_building' END AS kind FROM lines JOIN related USING (doc_id)),
t AS (SELECT *, ' – ' || CASE WHEN doc_id % 12 = 0 THEN 'Consider enhancing Schaft' WHEN doc_id % 4 = 0 THEN 'Consider enhancing' WHEN kind = 'update_pages' THEN 'Update pages' ELSE 'Consider building' END AS suffix, 'Acme: ' || line AS head FROM k),
l AS (SELECT *, greatest(24, 120 - length(suffix)) AS room FROM t)
SELECT doc_id, 'signal-watch,acme,source:' || CASE WHEN doc_id % 2 = 0 THEN 'blog' ELSE 'x' END || ',impact:' || impact || ',action:' || replace(kind, '_', '-') || ',owner:' || CASE WHEN kind = 'update_pages' THEN 'marketing' ELSE 'product' END
  || ',' || array_to_string(list_transform(teams, lambda x: 'team:' || replace(lower(x), ' ', '-')), ',') || CASE WHEN doc_id % 3 = 0 THEN ',platform:schaft' ELSE '' END AS labels,
  CASE WHEN length(head) <= room THEN head ELSE rtrim(left(head, (room - 1)::INTEGER)) || '…' END || suffix AS title FROM l""",
    "impact_heuristic": f"WITH {_LINES} SELECT doc_id, {_IMPACT} AS impact FROM lines",
    "gap_claim": f"WITH {_LINES} SELECT doc_id, {sql_gap('line', 'acme')} AS claims_gap FROM lines",
    "is_question": f"""WITH {_LINES}, c AS (SELECT doc_id, {sql_collapse('line')} AS t FROM lines), s AS (SELECT doc_id, t, string_split_regex({sql_sentences('t')}[-1], '(?:[:;]| –) +')[-1] AS clause FROM c)
SELECT doc_id, ends_with(t, '?') AND regexp_extract(lower(clause), '^[a-z'']+') IN ({', '.join(repr(x) for x in Q.OPENERS)}) AS asks FROM s""",
    "copy_fault": f"""WITH {_LINES}, t AS (SELECT doc_id, trim(line) AS t FROM lines) SELECT doc_id, CASE WHEN t = '' THEN 'missing' WHEN length(t) < 40 AND NOT (starts_with(t, '|') AND len(string_split(t, '|')) >= 3) THEN 'too_short'
  WHEN {sql_opens('t', Q.NOTE)} THEN 'instruction' WHEN {sql_blank('t')} THEN 'placeholder' END AS fault FROM t""",
    "packaging_gap": f"""WITH {_LINES}, g AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lead ELSE line END AS gap FROM lines), glow AS (SELECT doc_id, lower(gap) AS low FROM g), {sql_topics('glow')}
SELECT doc_id, {_any('gap', Q.PACKAGING)} AND doc_id NOT IN (SELECT doc_id FROM topics) AS packaging, doc_id % 3 <> 1 AS docs_only FROM g""",
    "team_lookup": """SELECT doc_id, ['Core', 'Growth', 'Platform Engineering', 'Platform Engineering', NULL, 'Core'][doc_id % 6 + 1] AS team, ['Growth', 'Platform Engineering', 'Core', ''][doc_id % 4 + 1] AS owners FROM documents""",
    "capabilities": f"SELECT doc_id, array_to_string({_CAPABLE.replace('{x}', 'text')}, ',') AS names FROM documents",
    "docs_for_text": f"""WITH {_TOPICS}, c(label, docs) AS (VALUES {_DOCS}), k(name, docs) AS (VALUES {_CAPABILITY_DOCS}),
cap AS (SELECT doc_id, x[1] AS name, x[2] AS n FROM (SELECT doc_id, unnest(list_zip(l, range(len(l)))) AS x FROM (SELECT doc_id, {_CAPABLE.replace('{x}', 'text')} AS l FROM documents))),
capdocs AS (SELECT doc_id, doc, min(n * 100 + i) AS o FROM (SELECT doc_id, n, d[1] AS doc, d[2] AS i FROM (SELECT doc_id, n, unnest(list_zip(docs, range(len(docs)))) AS d FROM cap JOIN k USING (name))) GROUP BY ALL),
first AS (SELECT doc_id, doc, nth AS o FROM (SELECT doc_id, doc, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS nth FROM capdocs) WHERE nth <= 3),
routed AS (SELECT doc_id, d[1] AS doc, 1000 + d[2] * 10 + rank AS o FROM (SELECT doc_id, rank, unnest(list_zip(docs, range(len(docs)))) AS d FROM topics JOIN c USING (label))),
every AS (SELECT doc_id, doc, min(o) AS o FROM (SELECT * FROM first UNION ALL SELECT * FROM routed) GROUP BY ALL),
l AS (SELECT doc_id, list(doc ORDER BY o)[:6] AS l FROM every WHERE doc_id IN (SELECT doc_id FROM topics) GROUP BY 1)
SELECT doc_id, coalesce(array_to_string(l, ','), '') AS docs FROM documents LEFT JOIN l USING (doc_id)""",
    "topics_for_action": f"""WITH {_TOPICS}, a AS (SELECT doc_id, label, min(rank) AS rank FROM (SELECT doc_id, 'Tionable' AS label, 0 AS rank FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, label, rank FROM topics) GROUP BY ALL)
SELECT doc_id, coalesce(t, '') AS topics FROM documents LEFT JOIN (SELECT doc_id, string_agg(label, ',' ORDER BY rank) AS t FROM a GROUP BY 1) USING (doc_id)""",
    "doc_lookup": "SELECT doc_id, [" + ", ".join([f"'{t.label}'" for t in Q.TOPICS for _ in t.docs] + ["NULL", "NULL"]) + f"][doc_id % {sum(len(t.docs) for t in Q.TOPICS) + 2} + 1] AS topic FROM documents",
    "compare_claims": f"""WITH b AS (SELECT source AS name, doc_id AS page, x[1] AS paragraph, x[2] AS pos FROM (SELECT source, doc_id, unnest(list_zip(l, range(len(l)))) AS x FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents))),
s AS (SELECT name, page, paragraph, min(pos) AS pos FROM b WHERE length(paragraph) >= 40 AND {_any('paragraph', ('thing', 'schaft', 'eaux'))} GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY name, page ORDER BY pos) AS n FROM s QUALIFY n <= 8), p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page, pos)::INTEGER AS place FROM n QUALIFY place <= 6)
SELECT name, 'https://other.example/' || page AS url, 'line ' || pos AS heading, {sql_truncate('paragraph', 700)} AS paragraph, place FROM p""",
    "embed_limits": f"""WITH v AS (SELECT conv_id, turn, role, repeat(coalesce(text, ''), 3) AS v FROM conversations), f AS (SELECT conv_id, turn, length(role) + length({sql_truncate('v', 1024)}) AS size FROM v),
t AS (SELECT conv_id, row_number() OVER w AS place, 42 + sum(size) OVER w AS total FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) FILTER (place <= 25 AND total <= 6000)::BIGINT AS n_fields, max(CASE WHEN place <= 25 AND total <= 6000 THEN total ELSE 42 END)::BIGINT AS length FROM t GROUP BY conv_id""",
    "render_no_action": f"""WITH {SQL_URLS}, n AS (SELECT page_id, url, 'the ' || lower(trim(regexp_replace(url_decode(coalesce(segs[-1], '')), '[-_]+', ' ', 'g'))) || ' page' AS page, len(segs) AS n FROM u),
e AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'A \\*title\\*' ELSE regexp_replace(CASE WHEN n > 0 THEN page ELSE url END, '([\\\\*_~`|>])', '\\\\\\1', 'g') END AS label, url FROM n),
l AS (SELECT page_id, ['[' || label || '](' || url || ')', NULL, '[T0](https://e0.example/p' || page_id || ')', '[T1](https://e1.example/p' || page_id || ')'][:(page_id % 6)::INTEGER] AS l FROM e)
SELECT page_id, '**None – ' || CASE page_id % 5 WHEN 0 THEN 'Acme already ' || CASE WHEN page_id % 2 = 0 THEN 'has Ration' ELSE 'does this' END WHEN 1 THEN 'the product lacks nothing here' WHEN 2 THEN 'no proof of a lack' WHEN 3 THEN 'taken back by a reviewer' ELSE 'not assessed' END
  || '**' || chr(10) || 'Because\\_' || page_id || CASE WHEN len(list_filter(l, lambda x: x IS NOT NULL)) > 0 THEN chr(10) || 'See: ' || array_to_string(list_filter(l, lambda x: x IS NOT NULL), ', ') ELSE '' END AS said FROM l""",
}
