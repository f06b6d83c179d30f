"""Reviews of filed actions and what a rewrite may change; pictures; documents that a verdict names after the fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from . import routing
from .actions import PRODUCT, REF, empty

#: The labels that a review leaves; the one that makes it happen once.
LABELS = {"agree": "review:agreed", "revise": "review:revised", "drop": "review:dropped", "unconfirmed": "review:unconfirmed", "skipped": "review:skipped"}
DONE = "review-pass:done"
EDIT = "struct<url:string,proposed_text:string,suggested_edit:string,edit_kind:string>"


def merge_revision(actions: DataFrame, editable=U.is_editable) -> DataFrame:
    """actions (type, detail, feature, gap, evidence_url, evidence_quote, impact, refs) with a rewrite (new_type, new_detail, new_feature, new_gap,
    new_evidence_url, new_evidence_quote, edits) and a review (review_impact) folded in, and refused, what was not allowed.

    Types swap only among the product ones; features only to those of the catalog, in its spelling; impact moves only if the reviewer moved it;
    edits replace those on pages that are cited already and may be edited, the last of a page's.
    """
    swaps = F.col("type").isin(*PRODUCT) & F.col("new_type").isin(*PRODUCT)
    named = routing.find_topic(F.col("new_feature"))
    urls = F.transform("refs", lambda r: r["url"])
    allowed = F.filter(F.coalesce("edits", empty(EDIT)), lambda e: F.array_contains(urls, e["url"]) & editable(e["url"]))

    def edited(r: Column) -> Column:
        mine = F.filter(allowed, lambda e: e["url"] == r["url"])
        last = F.get(mine, F.size(mine) - 1)
        pick = lambda c: F.coalesce(last[c], r[c]).alias(c)
        return F.struct(r["url"].alias("url"), r["claim"].alias("claim"), pick("suggested_edit"), pick("proposed_text"), pick("edit_kind")).cast(REF)

    no = lambda test, name: F.when(F.coalesce(test, F.lit(False)), name)
    refused = F.array(
        no(F.col("new_type") != F.col("type"), F.when(~swaps, "type")), no(F.col("new_feature").isNotNull() & ~F.col("new_feature").eqNullSafe(F.col("feature")) & named.isNull(), F.lit("feature")),
        no(F.size(F.coalesce("edits", empty(EDIT))) > F.size(allowed), F.lit("edits")),
    )
    fresh = lambda c: F.coalesce(f"new_{c}", c)
    out = actions.withColumn("refused", F.filter(refused, lambda x: x.isNotNull())).withColumn("refs", F.transform("refs", edited)).withColumn("type", F.when(swaps, F.col("new_type")).otherwise(F.col("type")))
    out = out.withColumn("feature", F.coalesce(named, "feature")).withColumn("impact", F.coalesce("review_impact", "impact"))
    for c in ("detail", "gap", "evidence_url", "evidence_quote"):
        out = out.withColumn(c, fresh(c))
    return out


def review_states(targets: DataFrame, budget: int) -> DataFrame:
    """(id, state) of targets (id, done, verdict): reviewed ones stay as they are; of the others the first budget are reviewed, whether or not
    the reviewer answers (without an answer it is skipped); the rest are skipped."""
    # ranks only what a sorted limit takes, so no window holds all rows
    taken = targets.where(~F.col("done")).orderBy("id").limit(budget).select("id", F.lit(True).alias("taken"))
    v = F.col("verdict")
    state = F.when(F.col("done"), "left").when(F.col("taken"), F.when(v.isin("agree", "drop", "revise"), v).otherwise("skipped")).otherwise("skipped")
    return targets.join(taken, "id", "left").select("id", state.alias("state"))


def review_labels(labels: Column, state: Column, confirmed: Column) -> Column:
    """The labels that an issue has afterwards: those it had, the state's own and, but for a skip, the one that says it is done. A rewrite that
    the checks did not confirm is unconfirmed; one left alone keeps its labels."""
    known = F.when((state == "revise") & ~confirmed, "unconfirmed").otherwise(state)
    own = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[known]
    added = F.filter(F.array(own, F.when(state != "skipped", F.lit(DONE))), lambda x: x.isNotNull())
    return F.when(state == "left", labels).otherwise(F.array_distinct(F.concat(labels, added)))


def post_images(posts: DataFrame, media: DataFrame) -> DataFrame:
    """(id, image): of posts (id, media_keys) the first attachment, in their order, that has an address in media (media_key, url, preview)."""
    keys = posts.select("id", F.posexplode("media_keys").alias("pos", "media_key"))
    found = keys.join(media.select("media_key", F.coalesce("url", "preview").alias("u")).where("u is not null"), "media_key")
    return posts.select("id").join(found.groupBy("id").agg(F.min_by("u", "pos").alias("image")), "id", "left")


def picture(feed: Column, page: Column, anchored: Column, shot: Column, made: Column) -> Column:
    """struct<url, origin>, the picture of a signal: the feed's own; the page's, if it is not a default card; a screenshot; the page's default
    card; one that is made. An entry that is a part of a page takes none of the page's."""
    own = F.when(~anchored, page)
    generic = U.is_generic_preview(F.coalesce(own, F.lit("")))
    each = ((feed, "feed"), (F.when(~generic, own), "page"), (shot, "screenshot"), (own, "page"), (made, "generated"))
    return F.coalesce(*[F.when(u.isNotNull(), F.struct(u.alias("url"), F.lit(o).alias("origin"))) for u, o in each])


def top_up(named: DataFrame, held: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, doc): the overviews (first documents) of the topics that a row names (key, label, rank) and that are neither held (key, doc) nor of
    a topic one of whose documents is held; the first most by rank."""
    topics = named.sparkSession.createDataFrame([(t.label, d, i) for t in routing.TOPICS for i, d in enumerate(t.docs)], "label string, doc string, i int")
    covered = held.withColumn("label", routing.topic_of_doc(F.col("doc"))).where("label is not null").select(key, "label").distinct()
    # the catalog is a fixed table of a few rows
    missing = named.join(covered, [key, "label"], "left_anti").join(F.broadcast(topics.where("i = 0")), "label").join(held.select(key, "doc"), [key, "doc"], "left_anti")
    place = F.row_number().over(Window.partitionBy(key).orderBy("rank", "doc"))
    return missing.withColumn("place", place).where(F.col("place") <= most).select(key, "doc")
