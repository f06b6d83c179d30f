"""Rule-based classification and routing against small catalogs, compiled into expressions: texts are read once and nothing is joined."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import needle_counts

# ---------------------------------------------------------------- catalogs


@dataclass(frozen=True)
class Topic:
    """A surface of the product: its label, the words that point at it, its documents (overview first) and other names."""

    label: str
    keywords: tuple[str, ...]
    docs: tuple[str, ...]
    aliases: tuple[str, ...] = ()
    kind: str = "product"


@dataclass(frozen=True)
class Capability:
    """What goes across surfaces."""

    name: str
    keywords: tuple[str, ...]
    docs: tuple[str, ...]


@dataclass(frozen=True)
class Team:
    name: str
    keywords: tuple[str, ...]
    owns: tuple[str, ...]

    @property
    def slug(self) -> str:
        return re.sub("[^a-z0-9]+", "-", self.name.lower()).strip("-")


# A catalog in the made-up vocabulary of the test tables; a deployment passes its own.
TOPICS = (
    Topic("Handers", ("hander", "thing", "of the"), ("handers/overview", "handers/limits"), ("hander plan",)),
    Topic("Ration", ("ration", "that", "heed"), ("ration/overview",)),
    Topic("Schaft", ("schaft", "ein", "der en"), ("schaft/overview", "schaft/setup", "schaft/limits"), (), "platform"),
    Topic("Menter", ("mente", "que", "de la"), ("menter/overview", "menter/setup"), ("la menter",)),
    Topic("Tionable", ("tion", "ouer"), ("tionable/overview",)),
)
CAPABILITIES = (
    Capability("Oning", ("oning", "and the"), ("oning/overview", "oning/limits")),
    Capability("Erenda", ("erenda", "ereing"), ("erenda/overview",)),
    Capability("Queos", ("queos", "que la"), ("menter/setup", "queos/overview")),
)
TEAMS = (
    Team("Core", ("inte", "onor"), ("Handers",)),
    Team("Growth", ("the", "pour"), ("Ration", "Menter")),
    Team("Platform Engineering", ("sch", "heit"), ("Schaft",)),
)
FIRST, PHRASE, LABEL, OWNED, KEYWORD = 3, 2, 3, 4, 2
#: Teams that an action names at most, and who gets one that nobody owns.
MOST_TEAMS, DEFAULT_TEAMS = 3, {"update_pages": "Growth"}


def strings(values) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def first_of(test, names) -> Column:
    """The first of the names whose test (a function to a condition) holds."""
    return F.coalesce(*[F.when(test(n), F.lit(n)) for n in names])


def collapsed(name: Column) -> Column:
    return T.collapse(F.lower(name))


# ---------------------------------------------------------------- topics and capabilities


def _best(counted: Column, weights: list[tuple[str, list[tuple[int, int]], list[tuple[int, int]]]], name: str) -> Column:
    """array<struct<loss, name>> of those with a score, best first, from counts of needles: by name the weights of each occurrence of needles,
    and of needles that occur at all. loss is the score below zero, so that ties go by name."""

    def scored(n: Column) -> Column:
        total = lambda each, any_: sum([n[i] * w for i, w in each] + [F.when(n[i] > 0, w).otherwise(0) for i, w in any_], F.lit(0))
        every = F.array(*[F.struct((-total(each, any_)).cast("long").alias("loss"), F.lit(label).alias(name)) for label, each, any_ in weights])
        return F.array_sort(F.filter(every, lambda x: x["loss"] < 0))

    return T.bound(counted, scored)


def scored_topics(text: Column, topics: tuple[Topic, ...] = TOPICS) -> Column:
    """array<struct<loss, label>> of the topics with a hit, best first. All keywords of all topics are counted in one pass over the text: short
    ones as words or their plurals, others wherever they are."""
    names = sorted({k for t in topics for k in (*t.keywords, t.label.lower())})
    at = {k: i for i, k in enumerate(names)}
    weight = lambda i, k: FIRST if i == 0 else PHRASE if " " in k else 1
    weights = [(t.label, [(at[k], weight(i, k)) for i, k in enumerate(t.keywords)], [] if t.label.lower() in t.keywords else [(at[t.label.lower()], LABEL)]) for t in topics]
    return _best(needle_counts(F.lower(F.coalesce(text, F.lit(""))), names), weights, "label")


def top_topics(text: Column, most: int = 3, topics: tuple[Topic, ...] = TOPICS) -> Column:
    """The labels of the best topics of a text, by score, then label."""
    return F.slice(F.transform(scored_topics(text, topics), lambda t: t["label"]), 1, most)


def match_topics(rows: DataFrame, key: str, text: Column, most: int = 3, topics: tuple[Topic, ...] = TOPICS) -> DataFrame:
    """(key, label, score, rank): the best topics of each text, by score, then label; none without a hit."""
    best = rows.select(key, F.posexplode(F.slice(scored_topics(text, topics), 1, most)).alias("at", "t"))
    return best.select(key, "t.label", (-F.col("t.loss")).alias("score"), (F.col("at") + 1).alias("rank"))


def find_topic(name: Column, topics: tuple[Topic, ...] = TOPICS) -> Column:
    """The catalog's label for a name that somebody wrote: a label or alias, else the first topic whose label or an alias is in it or whose
    keyword it is; null if there is none."""
    by = {t.label: t for t in topics}
    names = lambda t: [x.lower() for x in (t.label, *t.aliases)]

    def find(low: Column) -> Column:
        inside = lambda n: F.exists(strings(names(by[n])), lambda x: F.contains(low, x)) | low.isin([k.lower() for k in by[n].keywords])
        return F.when(low != "", F.coalesce(first_of(lambda n: low.isin(names(by[n])), by), first_of(inside, by)))

    return T.bound(collapsed(name), find)


def topic_of_doc(url: Column, topics: tuple[Topic, ...] = TOPICS) -> Column:
    """The label of the first topic that lists the document."""
    by = {t.label: t for t in topics}
    return first_of(lambda n: url.isin(list(by[n].docs)), by)


def topics_for_action(feature: Column, detail: Column, topics: tuple[Topic, ...] = TOPICS) -> Column:
    """The topics an action is about: the one it names, then the best three of its own words."""
    named = F.filter(F.array(find_topic(feature, topics)), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(named, top_topics(detail, 3, topics)))


def match_capabilities(text: Column, capabilities: tuple[Capability, ...] = CAPABILITIES) -> Column:
    """The names of the capabilities one of whose keywords is anywhere in the text, in the catalog's order."""
    names = sorted({k for c in capabilities for k in c.keywords})
    at = {k: i for i, k in enumerate(names)}
    found = lambda n: F.array(*[F.when(F.greatest(*[n[at[k]] for k in c.keywords], F.lit(0)) > 0, F.lit(c.name)) for c in capabilities])
    return F.filter(T.bound(needle_counts(F.lower(F.coalesce(text, F.lit(""))), names, words=False), found), lambda x: x.isNotNull())


def _lookup(pairs, key: Column) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), strings(v))])[key]


def docs_for_text(text: Column, most: int = 6, most_capability: int = 3, topics: tuple[Topic, ...] = TOPICS, capabilities: tuple[Capability, ...] = CAPABILITIES) -> Column:
    """The documents to show for a text: those of its capabilities, most_capability of them, then the first of each of its three best topics, the
    second of each, and so on; each once, most in all. A text without a topic gets none."""
    of_capabilities = F.slice(F.array_distinct(F.flatten(F.transform(match_capabilities(text, capabilities), lambda c: _lookup(((x.name, x.docs) for x in capabilities), c)))), 1, most_capability)
    depth = max(len(t.docs) for t in topics)

    def routed(x: Column) -> Column:
        labels, of_capabilities = x["labels"], x["first"]
        nth = lambda k: F.transform(labels, lambda n: F.get(_lookup(((t.label, t.docs) for t in topics), n), F.lit(k)))
        turns = [nth(k) for k in range(depth)]
        every = F.array_distinct(F.filter(F.concat(of_capabilities, *turns), lambda x: x.isNotNull()))
        return F.when(F.size(labels) > 0, F.slice(every, 1, most)).otherwise(strings(()))

    return T.bound(F.struct(top_topics(text, 3, topics).alias("labels"), of_capabilities.alias("first")), routed)


def round_robin_docs(matched: DataFrame, key: str, most: int = 6, topics: tuple[Topic, ...] = TOPICS) -> DataFrame:
    """(key, doc, place): documents of the matched topics (key, label, rank), first every topic's first, then the second ones, and so on."""
    each = matched.select(key, "rank", F.posexplode(_lookup(((t.label, t.docs) for t in topics), F.col("label"))).alias("turn", "doc"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("turn", "rank"))
    return each.withColumn("place", place).where(F.col("place") <= most).select(key, "doc", "place")


# ---------------------------------------------------------------- teams


def find_team(name: Column, teams: tuple[Team, ...] = TEAMS) -> Column:
    """The team that a name or slug means, also with the and team around it; null for any other name."""
    by = {t.name: [t.name.lower(), t.slug] for t in teams}
    found = lambda low: first_of(lambda n: low.isin(by[n]), by)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}&. -]+", " "), "^the +", ""), " +team$", "")
    return F.coalesce(found(collapsed(name)), found(collapsed(plain)))


def teams_owning(feature: Column, teams: tuple[Team, ...] = TEAMS) -> Column:
    """The team of that name, then the teams that own a surface which the feature's name is or has in it."""
    low = collapsed(F.coalesce(feature, F.lit("")))
    owners = [F.when((low != "") & any_of(low, [o.lower() for o in t.owns]), F.lit(t.name)) for t in teams]
    return F.array_distinct(F.filter(F.array(find_team(feature, teams), *owners), lambda x: x.isNotNull()))


def scored_teams(text: Column, teams: tuple[Team, ...] = TEAMS) -> Column:
    """array<struct<loss, team>> of the teams with a hit, best first: OWNED for each surface that a team owns and the text names, KEYWORD for
    each of its keywords."""
    names = sorted({x.lower() for t in teams for x in (*t.owns, *t.keywords)})
    at = {k: i for i, k in enumerate(names)}
    weights = [(t.name, [], [(at[x.lower()], w) for w, kind in ((OWNED, t.owns), (KEYWORD, t.keywords)) for x in kind]) for t in teams]
    return _best(needle_counts(collapsed(F.coalesce(text, F.lit(""))), names, words=False), weights, "team")


def match_teams(rows: DataFrame, key: str, text: Column, most: int = 3, teams: tuple[Team, ...] = TEAMS) -> DataFrame:
    """(key, team, score, rank) of the best teams of each text, by score, then name."""
    best = rows.select(key, F.posexplode(F.slice(scored_teams(text, teams), 1, most)).alias("at", "t"))
    return best.select(key, "t.team", (-F.col("t.loss")).alias("score"), (F.col("at") + 1).alias("rank"))


def related_teams(suggested: Column, feature: Column, detail: Column, kind: Column, most: int = MOST_TEAMS, teams: tuple[Team, ...] = TEAMS, topics: tuple[Topic, ...] = TOPICS) -> Column:
    """The teams an action is for: those suggested that exist, outright; else the owners of what it names and is about and the teams its words
    point at; else the default of its kind."""
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    given = F.array_distinct(some(F.transform(F.coalesce(suggested, strings(())), lambda n: find_team(n, teams))))
    about = F.concat(F.array(F.coalesce(feature, F.lit(""))), topics_for_action(feature, detail, topics))
    owners = F.flatten(F.transform(about, lambda f: teams_owning(f, teams)))
    pointed = F.slice(F.transform(scored_teams(F.concat_ws(" ", feature, detail), teams), lambda x: x["team"]), 1, most)
    derived = F.array_distinct(F.concat(owners, pointed))
    default = F.array(F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in DEFAULT_TEAMS.items()], F.lit(teams[0].name)))
    return F.slice(T.bound(F.struct(given.alias("given"), derived.alias("derived")), lambda x: F.when(F.size(x["given"]) > 0, x["given"]).when(F.size(x["derived"]) > 0, x["derived"]).otherwise(default)), 1, most)


# ---------------------------------------------------------------- mentions and claims


def any_of(text: Column, phrases) -> Column:
    return F.exists(strings(phrases), lambda p: F.contains(text, p))


def mentions(text: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """The names one of whose aliases occurs in the text, in any case and inside words too."""
    low = F.lower(text)
    found = [F.when(any_of(low, a), F.lit(n)) for n, a in aliases.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def claims(pages: DataFrame, key: str, text: Column, aliases: dict[str, tuple[str, ...]], least: int = 60, most: int = 1200, per_page: int = 12) -> DataFrame:
    """(key, name, paragraph, place): paragraphs long enough that mention a name, each once a name, the first per_page of a page."""
    each = pages.select(key, F.posexplode(T.paragraphs(text)).alias("pos", "p")).where(F.char_length("p") >= least)
    each = each.select(key, "pos", F.posexplode(mentions(F.col("p"), aliases)).alias("n", "name"), "p")
    once = each.groupBy(key, "name", "p").agg(F.min(F.struct("pos", "n")).alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first"))
    return once.withColumn("place", place).where(F.col("place") <= per_page).select(key, "name", T.truncate(F.col("p"), most).alias("paragraph"), "place")


def compare_claims(blocks: DataFrame, aliases: tuple[str, ...], least: int = 40, most: int = 700, per_page: int = 8, per_name: int = 6) -> DataFrame:
    """(name, url, heading, paragraph, place): what the pages of others say of us: of blocks (name, url, page, pos, heading, paragraph) those long
    enough that mention an alias, each paragraph once a page, the first per_page of a page and per_name of a name, by page and pos."""
    low = F.lower("paragraph")
    said = blocks.where((F.char_length("paragraph") >= least) & any_of(low, aliases)).groupBy("name", "page", "url", "paragraph").agg(F.min(F.struct("pos", "heading")).alias("first"))
    of_page = F.row_number().over(Window.partitionBy("name", "page", "url").orderBy("first.pos"))
    said = said.withColumn("n", of_page).where(F.col("n") <= per_page)
    place = F.row_number().over(Window.partitionBy("name").orderBy("page", "first.pos"))
    said = said.withColumn("place", place).where(F.col("place") <= per_name)
    return said.select("name", "url", F.col("first.heading").alias("heading"), T.truncate(F.col("paragraph"), most).alias("paragraph"), "place")


def ranked_claims(found: DataFrame, name: str, limit: int) -> DataFrame:
    """The best claims of (url, paragraph): pages that compare with name, then about leaving it, then naming it; longest first."""
    u = F.lower("url")
    order = F.when(u.contains(f"compare-to-{name}"), 0).when(u.contains(f"migrate-from-{name}"), 1).when(u.contains(name), 2).otherwise(3)
    return found.withColumn("tier", order).orderBy("tier", F.desc(F.char_length("paragraph")), "url", "paragraph").limit(limit)


def diversify(found: DataFrame, per_url: int = 2, total: int = 8) -> DataFrame:
    """At most per_url rows of a url and total of all, in the order of place."""
    n = F.row_number().over(Window.partitionBy("url").orderBy("place"))
    return found.withColumn("n", n).where(F.col("n") <= per_url).drop("n").orderBy("place").limit(total)


# ---------------------------------------------------------------- what a text says

# Phrases that tell how much an announcement matters.
NEW = ("introduc", "launch", "new feature", "new product", "brand new", "now available", "general availability", "generally available", "announcing", "meet ", "say hello to")
BETTER = (
    "you can now", "now you can", "now supports", "now support", "improv", "enhanc", "expand", "extend", "upgrad", "faster", "reduced", "more control", "added support", "support for",
    "new option", "new setting", "new plan", "new region", "raised", "increased",
)


def impact(text: Column) -> Column:
    low = F.lower(text)
    return F.when(any_of(low, NEW), "major").when(any_of(low, BETTER), "notable").otherwise("minor")


def either(phrases) -> str:
    """An expression for any of the phrases."""
    return "(?:" + "|".join(re.escape(p).replace("\\ ", " ").replace("\\'", "'") for p in phrases) + ")"


#: Where a sequence of words may end; as many as there are.
END: dict = {}
ALL = 1 << 30


def opens(words: Column, tree: dict, at: int = 0) -> Column:
    """Whether words (lower case, as blanks separate them) open with a sequence of a tree: by words, or tuples of words that are followed by the
    same, what may follow; END where that is all. A sign after a word ends the sequence."""
    word = F.coalesce(F.get(words, F.lit(at)), F.lit(""))
    head = F.regexp_extract(word, "^[a-z']*", 0)
    found = F.lit(False)
    for keys, rest in tree.items():
        keys = (keys,) if isinstance(keys, str) else keys
        found = found | (head.isin(*keys) if not rest else word.isin(*keys) & opens(words, rest, at + 1))
    return found


def opening(text: Column) -> Column:
    return F.split(F.lower(text), " ")


# What says that something is lacking, what nothing is the equal of, and how far from its subject either may be.
LACKS = (
    "has no", "have no", "has nothing", "have nothing", "does not", "doesn't", "do not", "don't", "cannot", "can't", "lacks", "lack", "no support for", "no way to", "is missing", "are missing",
)
EQUALS, LACKS_WITHIN, EQUALS_WITHIN = ("equivalent", "counterpart", "parity"), 140, 40


def word_runs(text: Column) -> Column:
    """The words of each stretch between full stops, question and exclamation marks, lower case and without the
    ending of a possessive, as a text with a space before and after each."""
    words = lambda x: F.transform(F.regexp_extract_all(x, F.lit("[a-z0-9_']+"), F.lit(0)), lambda w: F.regexp_replace(F.trim(w, F.lit("'")), "'s$", ""))
    return F.transform(F.split(F.lower(text), "[.?!]"), lambda x: F.concat(F.lit(" "), F.array_join(words(x), " "), F.lit(" ")))


def said_after(runs: Column, first: str, phrases, within: int) -> Column:
    """Whether one of the phrases begins in a run at most so many characters after the word first, counted in words and the spaces between."""
    spaced = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    near = lambda tail: F.exists(strings(phrases), lambda p: F.position(spaced(p), spaced(tail)).between(1, within + 1))
    return F.exists(runs, lambda run: F.exists(F.slice(F.split(run, re.escape(f" {first} ")), 2, ALL), near))


def claims_gap(text: Column, product: str) -> Column:
    """Whether a text claims that the product lacks something: in one stretch the product and, near after it, a lack; or a no and, near after it,
    the word for an equal."""
    either_of = lambda r: said_after(r, product.lower(), LACKS, LACKS_WITHIN) | said_after(r, "no", EQUALS, EQUALS_WITHIN)
    return T.bound(word_runs(F.coalesce(text, F.lit(""))), either_of)


# How a question opens, how one does whose stem is missing, and what hedges before one.
OPENERS = "am are is was were can could did do does had has have may might must shall should will would what when where which who whom whose why how".split()
CLAUSE = ("whether", "if")
HEDGES = ("unclear", "unknown", "uncertain", "not clear", "no word", "nothing said", "open question", "tbd")
HEDGE = rf"(?i)^(?:it is |it's )?{either(HEDGES)}\b[ :,–-]*(?:{either(('on', 'about'))} )?"
#: What a clause of a collapsed text ends with.
BREAKS = (": ", "; ", " – ")


def last_clause(line: Column) -> Column:
    """What follows the last colon, semicolon or dash of a collapsed line."""
    marked = line
    for b in BREAKS:
        marked = F.replace(marked, F.lit(b), F.lit("\x01"))
    return F.substring_index(marked, "\x01", -1)


def opener(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), "^[a-z']+", 0)


def is_question(line: Column) -> Column:
    """Ends with a question mark, and the last clause of its last sentence opens like a question."""
    return T.bound(T.collapse(line), _asks)


def _asks(text: Column) -> Column:
    """is_question() of a collapsed text."""
    return text.endswith("?") & opener(last_clause(F.element_at(T.cut(text), -1))).isin(OPENERS)


def as_question(line: Column) -> Column:
    """The line as a question: itself if it is one; else its last clause without a hedge, as a question if it opens like one, or with whether
    or if; what stands before that clause is kept. Null if it can't be one without being rewritten."""
    cased = lambda f, x: F.concat(f(F.left(x, F.lit(1))), F.substring(x, 2, ALL))

    def ask(said: Column) -> Column:
        last = F.element_at(said, -1)
        rest = F.array_join(F.slice(said, F.lit(1), F.size(said) - 1), " ")
        question = T.bound(last_clause(last), lambda clause: closed(clause, F.left(last, F.char_length(last) - F.char_length(clause))))
        return F.concat(F.when(F.size(said) > 1, F.concat(rest, F.lit(" "))).otherwise(""), question)

    def closed(clause: Column, before: Column) -> Column:
        bare = F.trim(F.regexp_replace(clause, HEDGE, ""))
        return T.bound(F.struct(before.alias("before"), bare.alias("body"), opener(bare).alias("opener")), asked)

    def asked(x: Column) -> Column:
        body, first = x["body"], x["before"] == ""
        know = F.concat(F.when(first, "Do we know ").otherwise("do we know "), cased(F.lower, body))
        return F.concat(x["before"], F.when(x["opener"].isin(*CLAUSE), know).when(x["opener"].isin(OPENERS), F.when(first, cased(F.upper, body)).otherwise(cased(F.lower, body))), F.lit("?"))

    # each step is worked out once: inside of a lambda nothing is shared
    find = lambda text: F.when(_asks(text), text).when(text != "", T.bound(F.regexp_replace(text, r"[ .?!]+$", ""), lambda x: T.bound(T.cut(x), ask)))
    return T.bound(T.collapse(line), find)


def open_questions(lines: Column, most: int | None = None) -> Column:
    """The lines that are or can be made questions, each once, the first most of them."""
    every = F.array_distinct(F.filter(F.transform(lines, as_question), lambda q: q.isNotNull()))
    return F.slice(every, 1, most) if most else every


# The words of what opens a note about copy, where copy should stand: orders of one word and of two; changes to what is pointed at;
# parts that are to be added; what is to be made clear; what is to be answered. And the marks of blanks that somebody else should fill.
SAY = ("say", "says", "mention", "mentions", "clarify", "reword", "rewrite", "revise", "reframe", "acknowledge", "soften", "strengthen", "ensure", "consider")
CHANGE, POINTED = ("update", "edit", "change", "correct", "fix", "replace", "remove", "drop", "expand"), ("the", "this", "that", "these")
PARTS = ("line", "row", "bullet", "sentence", "paragraph", "note", "section", "column", "mention", "caveat")
NOTE = {
    SAY: END,
    ("note", "state"): {"that": END},
    ("call", "point"): {"out": END},
    "make": {"sure": END, ("it", "this", "that"): {"clear": END}},
    CHANGE: {POINTED: END},
    ("add", "include"): {("a", "an", "the", "this"): {PARTS: END}},
    "answer": {("their", "the", "this"): END},
}
MARKS, ELLIPSES, LEAST_COPY = ("TBD", "TODO", "XXX"), ("...", "…"), 40


def has_blank(text: Column) -> Column:
    """Whether something is left to fill in: words in brackets that are no link's, or in braces, a mark, or an ellipsis."""
    unlinked = F.regexp_replace(text, r"\[[^\]]*\]\(", "(")
    words_in = lambda a, b: rf"\{a}[^\{b}]*\s[^\{b}]*\{b}"
    return unlinked.rlike(words_in("[", "]")) | text.rlike(words_in("{", "}")) | text.rlike(rf"(?i)\b{either(MARKS)}\b") | any_of(text, ELLIPSES)


def copy_fault(copy: Column) -> Column:
    """Why proposed copy can't be pasted: missing, too_short (unless a table row), instruction, placeholder; else null."""
    text = F.trim(F.coalesce(copy, F.lit("")))
    row = text.startswith("|") & (F.size(F.split(text, r"\|")) >= 3)
    return F.when(text == "", "missing").when((F.char_length(text) < LEAST_COPY) & ~row, "too_short").when(opens(opening(text), NOTE), "instruction").when(has_blank(text), "placeholder")


# Phrases about prices and plans rather than the product; how an action opens that asks for documents alone.
PACKAGING = (
    "cheaper", "more expensive", "costs less", "costs more", "lower price", "higher price", "price point", "plan price", "pricing is", "free tier", "free plan", "per-seat", "per seat", "discount",
    "packaging", "included in the plan",
)
PRICING = "Pricing"
DOCS = ("doc", "docs")
WRITING = {
    ("document", "documenting"): END,
    "write": {"docs": END, "the": {"docs": END}, "up": {"docs": END, "the": {"docs": END}}},
    "add": {("documentation", *DOCS): END, ("a", "the"): {("documentation", *DOCS): END}},
    ("publish", "create"): {DOCS: END, ("a", "the"): {DOCS: END}},
    "update": {"the": {"docs": END}},
}


def is_packaging(gap: Column, topics: tuple[Topic, ...] = TOPICS, pricing: str = PRICING) -> Column:
    """Whether a gap is about prices alone: it says such a phrase and speaks of no topic but pricing."""
    low = F.lower(F.coalesce(gap, F.lit("")))
    return any_of(low, PACKAGING) & F.forall(top_topics(gap, 3, topics), lambda t: t == pricing)


def is_documentation_only(detail: Column) -> Column:
    """Whether an action's first sentence asks for documents to be written."""
    return opens(opening(F.trim(T.first_sentence(detail, 200))), WRITING)


# Words that no announcement can be told by.
GENERIC = (
    "the and for but with from into this that these those when what which than then there here where while who you your they their them its it our we us are was were been being has have had does did "
    "can cannot could will would should must may might now new also just only still already yet not no all any one two more most some each every both let get got make made add use used say see need "
    "want give take put pick user team customer people someone product feature capability page section line copy claim launch ship release announce available availability general support way thing work "
    "today instead without about because so why how same own out off over under before after again very much competitor compare comparison migrate matrix row update edit fix"
).split()


def stemmed(phrase: str) -> str:
    from .retrieval import plain_stem

    return " ".join(plain_stem(w) for w in re.findall("[a-z0-9]+", phrase.lower()))


def signal_topic(title: Column, summary: Column, topics: tuple[Topic, ...] = TOPICS, capabilities: tuple[Capability, ...] = CAPABILITIES, names: tuple[str, ...] = ()) -> Column:
    """struct<terms, phrases, topics, vocabulary>: what a signal is about. terms: the telling stems of its title and summary, without the words of
    its topics; phrases: stems of the keywords of its capabilities; vocabulary: of those of its topics. names: further words that tell nothing."""
    text = F.concat(title, F.lit(". "), F.coalesce(summary, F.lit("")))
    skipped = sorted({stemmed(w) for w in (*GENERIC, *names)})
    words = {t.label: [stemmed(x) for x in (t.label, *t.aliases, *t.keywords)] for t in topics}
    phrases = {c.name: [stemmed(k) for k in c.keywords] for c in capabilities}
    every = lambda found, by: F.array_distinct(F.flatten(F.transform(found, lambda n: _lookup(by.items(), n))))

    def of(x: Column) -> Column:
        labels, vocabulary = x["labels"], every(x["labels"], words)
        known = F.flatten(F.transform(vocabulary, lambda p: F.split(p, " ")))
        telling = F.filter(F.transform(T.words(text), T.stem), lambda s: (F.char_length(s) >= 3) & ~s.rlike("^[0-9]+$") & ~s.isin(skipped))
        return F.struct(F.array_except(F.array_distinct(telling), known).alias("terms"), every(x["names"], phrases).alias("phrases"), labels.alias("topics"), vocabulary.alias("vocabulary"))

    return T.bound(F.struct(top_topics(text, 3, topics).alias("labels"), match_capabilities(text, capabilities).alias("names")), of)


def ties_to(text: Column, topic: Column) -> Column:
    """Whether a text speaks of a signal_topic(): by its phrases or terms, as whole stems; where it has neither, by its vocabulary. What has
    none of them can't be missed."""

    def tied(x: Column) -> Column:
        said, topic = x["said"], x["topic"]
        hits = lambda needles: F.exists(needles, lambda n: (n != "") & F.contains(said, F.concat(F.lit(" "), n, F.lit(" "))))
        sharp = (F.size(topic["phrases"]) > 0) | (F.size(topic["terms"]) > 0)
        return F.when(sharp, hits(topic["phrases"]) | hits(topic["terms"])).otherwise((F.size(topic["vocabulary"]) == 0) | hits(topic["vocabulary"]))

    said = F.concat(F.lit(" "), F.array_join(F.transform(T.words(F.coalesce(text, F.lit(""))), T.stem), " "), F.lit(" "))
    return T.bound(F.struct(said.alias("said"), topic.alias("topic")), tied)
