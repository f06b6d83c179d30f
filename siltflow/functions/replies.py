"""Replies of a model, read leniently: JSON in any of its spellings becomes one shape, within caps, and what is missing is told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .jsonx import NO_ACTION

# What a reply may say, how long its parts may be, and how many of a kind count.
IMPACTS, ACTIONS, EDITS, VERDICTS = ("major", "notable", "minor"), ("consider_enhancing", "consider_building", "update_pages"), ("replace", "insert"), ("agree", "revise", "drop")
SUMMARY, DETAIL, FEATURE, GAP, URL, QUOTE, EDIT, COPY, REASON, TITLE = 600, 900, 120, 400, 500, 600, 600, 1600, 600, 300
MOST_ACTIONS, MOST_REFS, MOST_LINES, MOST_TEAMS, MOST_EDITS = 3, 5, 8, 5, 4
UNSTATED = "No reason was given."
#: What an analysis has besides its error.
ANALYSIS = ("impact", "summary", "points", "actions", "no_action", "refs", "questions", "pages_read")


def _both(name: str) -> tuple[str, ...]:
    """A field's name with underscores and with inner capitals."""
    head, *rest = name.split("_")
    return (name, head + "".join(w.capitalize() for w in rest)) if rest else (name,)


def _schema(**fields: str) -> str:
    return "struct<" + ",".join(f"`{spelled}`:{kind}" for name, kind in fields.items() for spelled in _both(name)) + ">"


_REF = _schema(url="string", claim="string", suggested_edit="string", proposed_text="string", replacement_text="string", edit_kind="string")
_ACTION = _schema(
    type="string", action="string", detail="string", action_detail="string", feature="string", product_feature="string", teams="array<string>", product_teams="array<string>", gap="string", gap_today="string",
    evidence_url="string", evidence_quote="string",
)
_NONE = _schema(kind="string", reason="string", no_action_reason="string", feature="string", evidence="array<struct<url:string,title:string,quote:string>>")
_ANALYSIS = _schema(
    impact="string", summary="string", key_points="array<string>", actions=f"array<{_ACTION}>", no_action=_NONE, no_action_reason="string", product_refs=f"array<{_REF}>", open_questions="array<string>",
    pages_read="array<string>",
)
_REVIEW = _schema(verdict="string", reason="string", pages_checked="array<string>", changes="array<string>", requested_changes="array<string>", impact="string", action_type="string")
_REVISION = _schema(
    type="string", action="string", detail="string", gap="string", feature="string", evidence_url="string", evidence_quote="string", impact="string", suggested_edits=f"array<{_REF}>", page_edits=f"array<{_REF}>"
)


def _plain(text: Column) -> Column:
    """T.sanitize, whose patterns are not tried on texts in ASCII: these have no dashes or quotes that it changes."""
    return F.when(text.isNotNull(), T.bound(text, lambda t: F.when(F.octet_length(t) != F.char_length(t), T.sanitize(t)).otherwise(t)))


def clean(text: Column) -> Column:
    return F.trim(_plain(text))


def _given(text: Column) -> Column:
    """A blank text counts as none."""
    return F.when(F.trim(text) != "", text)


def _first(row: Column, *names: str) -> Column:
    return F.coalesce(*[_given(row[s]) for n in names for s in _both(n)])


def _listed(row: Column, *names: str) -> Column:
    return F.coalesce(*[row[s] for n in names for s in _both(n)])


def _one_of(text: Column, known) -> Column:
    return F.when(text.isin(*known), text)


def _lines(lines: Column, most: int) -> Column:
    return F.slice(F.filter(F.coalesce(lines, F.expr("cast(array() as array<string>)")), lambda x: F.trim(x) != ""), 1, most)


def _too_long(*pairs) -> Column:
    """Whether any of the texts is longer than its cap."""
    out = F.lit(False)
    for text, most in pairs:
        out = out | F.coalesce(F.char_length(text) > most, F.lit(False))
    return out


def _action(a: Column) -> Column:
    return F.struct(
        _one_of(_first(a, "type", "action"), ACTIONS).alias("type"), clean(_first(a, "detail", "action_detail")).alias("detail"), clean(_first(a, "feature", "product_feature")).alias("feature"),
        F.transform(_lines(_listed(a, "teams", "product_teams"), MOST_TEAMS), lambda x: F.trim(x)).alias("teams"), clean(_first(a, "gap", "gap_today")).alias("gap"), F.trim(_first(a, "evidence_url")).alias("evidence_url"),
        # a quote is compared character by character, so its punctuation stays
        F.trim(_first(a, "evidence_quote")).alias("evidence_quote"),
    )


def _ref(r: Column) -> Column:
    return F.struct(
        F.trim(r["url"]).alias("url"), clean(r["claim"]).alias("claim"), clean(_first(r, "suggested_edit")).alias("suggested_edit"), F.trim(_plain(_first(r, "proposed_text", "replacement_text"))).alias("proposed_text"),
        _one_of(_first(r, "edit_kind"), EDITS).alias("edit_kind"),
    )


def analysis(reply: Column, fields: tuple[str, ...] | None = None) -> Column:
    """struct<error, impact, summary, points, actions, no_action, refs, questions, pages_read> of a reply (a JSON object); fields: error and those
    alone. All of a reply is checked, whichever are asked for.

    error tells why a reply can't be used (unreadable, too_long, no_summary, no_actions, no_impact), or is null; the other fields are then as
    far as they go. Citations without page or claim and actions without type or detail are left out; an empty list of actions is an answer, a
    missing one only with a verdict. An unknown verdict is unverified. Lines that ask nothing are no questions.
    """
    from ..operators.routing import open_questions

    def read(p: Column) -> Column:
        # actions and citations are cleaned once, however often they are looked at
        usable = F.filter(F.transform(F.coalesce(p["actions"], F.expr(f"cast(array() as array<{_ACTION}>)")), _action), lambda a: a["type"].isNotNull() & a["detail"].isNotNull())
        cited = F.filter(F.coalesce(_listed(p, "product_refs"), F.expr(f"cast(array() as array<{_REF}>)")), lambda r: (F.trim(r["url"]) != "") & (F.trim(r["claim"]) != ""))
        return T.bound(usable, lambda u: T.bound(F.transform(cited, _ref), lambda c: told(p, u, c)))

    def told(p: Column, usable: Column, cited: Column) -> Column:
        none = F.coalesce(p["no_action"], p["noAction"])
        stated = _first(p, "no_action_reason")
        evidence = F.transform(F.filter(F.coalesce(none["evidence"], F.expr("cast(array() as array<struct<url:string,title:string,quote:string>>)")), lambda e: F.trim(e["url"]) != ""), lambda e: F.struct(F.trim(e["url"]).alias("url"), clean(_given(e["title"])).alias("title"), F.trim(_given(e["quote"])).alias("quote")))
        verdict = F.struct(F.coalesce(_one_of(F.trim(none["kind"]), NO_ACTION), F.lit("unverified")).alias("kind"), clean(_given(none["feature"])).alias("feature"), clean(F.coalesce(_first(none, "reason", "no_action_reason"), stated, F.lit(UNSTATED))).alias("reason"), evidence.alias("evidence"))
        long_action = F.exists(usable, lambda a: _too_long((a["detail"], DETAIL), (a["feature"], FEATURE), (a["gap"], GAP), (a["evidence_url"], URL), (a["evidence_quote"], QUOTE)))
        long_ref = F.exists(cited, lambda r: _too_long((r["suggested_edit"], EDIT), (r["proposed_text"], COPY)))
        error = (
            F.when(_given(p["summary"]).isNull(), "no_summary").when(_too_long((p["summary"], SUMMARY)) | long_action | long_ref, "too_long")
            .when(p["actions"].isNull() & none.isNull() & stated.isNull(), "no_actions").when(_one_of(p["impact"], IMPACTS).isNull(), "no_impact")
        )
        each = (
            _one_of(p["impact"], IMPACTS).alias("impact"), clean(p["summary"]).alias("summary"), F.filter(F.transform(_lines(_listed(p, "key_points"), MOST_LINES), clean), lambda x: x != "").alias("points"),
            F.slice(usable, 1, MOST_ACTIONS).alias("actions"), F.when(F.size(usable) == 0, verdict).alias("no_action"), F.slice(cited, 1, MOST_REFS).alias("refs"),
            open_questions(F.transform(_lines(_listed(p, "open_questions"), MOST_LINES), clean)).alias("questions"), F.transform(_lines(_listed(p, "pages_read"), MOST_LINES), lambda x: F.trim(x)).alias("pages_read"),
        )
        return F.struct(error.alias("error"), *[c for c, name in zip(each, ANALYSIS, strict=True) if fields is None or name in fields])

    parsed = F.from_json(reply, _ANALYSIS)
    return T.bound(parsed, lambda p: F.when(p.isNotNull(), read(p)))


def review(reply: Column) -> Column:
    """struct<error, verdict, reason, pages, changes, impact, action_type> of a review: no_verdict and no_reason are errors."""

    def read(p: Column) -> Column:
        error = F.when(_one_of(p["verdict"], VERDICTS).isNull(), "no_verdict").when(_given(p["reason"]).isNull(), "no_reason").when(_too_long((p["reason"], DETAIL)), "too_long")
        return F.struct(
            error.alias("error"), _one_of(p["verdict"], VERDICTS).alias("verdict"), clean(p["reason"]).alias("reason"), F.transform(_lines(_listed(p, "pages_checked"), MOST_LINES), lambda x: F.trim(x)).alias("pages"),
            F.filter(F.transform(_lines(_listed(p, "changes", "requested_changes"), MOST_LINES), clean), lambda x: x != "").alias("changes"), _one_of(p["impact"], IMPACTS).alias("impact"),
            _one_of(_first(p, "action_type"), ACTIONS).alias("action_type"),
        )

    return T.bound(F.from_json(reply, _REVIEW), lambda p: F.when(p.isNotNull(), read(p)))


def revision(reply: Column) -> Column:
    """struct<type, detail, gap, feature, evidence_url, evidence_quote, impact, edits> of a rewrite; edits without any words are left out."""

    def read(p: Column) -> Column:
        listed = F.slice(F.filter(F.coalesce(_listed(p, "suggested_edits", "page_edits"), F.expr(f"cast(array() as array<{_REF}>)")), lambda e: e["url"].isNotNull()), 1, MOST_EDITS)
        edits = F.filter(F.transform(listed, _ref), lambda e: e["suggested_edit"].isNotNull() | e["proposed_text"].isNotNull())
        plain = F.transform(edits, lambda e: F.struct(*[e[c].alias(c) for c in ("url", "proposed_text", "suggested_edit", "edit_kind")]))
        return F.struct(
            _one_of(_first(p, "type", "action"), ACTIONS).alias("type"), clean(_given(p["detail"])).alias("detail"), clean(_given(p["gap"])).alias("gap"), clean(_given(p["feature"])).alias("feature"),
            F.trim(_first(p, "evidence_url")).alias("evidence_url"), F.trim(_first(p, "evidence_quote")).alias("evidence_quote"), _one_of(p["impact"], IMPACTS).alias("impact"), plain.alias("edits"),
        )

    return T.bound(F.from_json(reply, _REVISION), lambda p: F.when(p.isNotNull(), read(p)))


def paired(actions: Column, issues: Column) -> Column:
    """actions, each with the issue at its place in the stored list (null beyond its end): array of struct<action, issue>."""
    return F.transform(actions, lambda a, i: F.struct(a.alias("action"), F.get(issues, i).alias("issue")))


def stored_alert(analysis: Column, image: Column, issues: Column) -> Column:
    """An alert as it is stored: the analysis with its picture and, in the order of its actions, the issues."""
    return F.to_json(F.struct(analysis.alias("analysis"), image.alias("image"), issues.alias("issues")))
