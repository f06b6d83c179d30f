"""Ingesting signals: keyed insert-if-absent, and what of a batch is analysed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("source", "external_id")
LOOKBACK_DAYS, PER_SOURCE, PER_RUN, RETRY_DAYS = 7, 8, 12, 3
#: Fixed value: the zone whose days count for daily messages.
ZONE = "America/Los_Angeles"


def first_in_batch(batch: DataFrame, keys: tuple[str, ...] = KEY, order: str = "ord") -> DataFrame:
    """The first row of each key, by an explicit order: dropDuplicates keeps any."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return batch.withColumn("_place", place).where("_place = 1").drop("_place")


def new_items(batch: DataFrame, stored: DataFrame, keys: tuple[str, ...] = KEY, order: str = "ord") -> DataFrame:
    """Rows that an insert-if-absent would add: the first of each key that isn't stored."""
    return first_in_batch(batch, keys, order).join(stored.select(*keys).distinct(), list(keys), "left_anti")


def known(batch: DataFrame, stored: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    return batch.join(stored.select(*keys), list(keys), "left_semi")


def within_lookback(published: Column, now: Column, days: int = LOOKBACK_DAYS) -> Column:
    """A date that is missing counts as recent."""
    return published.isNull() | (published >= now - F.expr(f"interval {days} days"))


def select_for_analysis(batch: DataFrame, stored: DataFrame, now: Column, per_source: int = PER_SOURCE, per_run: int = PER_RUN, force: bool = False) -> DataFrame:
    """New items to analyse, newest first: a source without stored rows is seeded, not analysed (unless forced); per_source newest within the
    lookback of each other source, then per_run of all. An unknown date comes last."""
    fresh = new_items(batch, stored)
    seeded = stored.groupBy("source").agg(F.count("*").alias("n_stored"))
    fresh = fresh.join(seeded, "source", "left")
    ready = fresh.where((F.lit(force) | (F.coalesce("n_stored", F.lit(0)) > 0)) & within_lookback(F.col("published_at"), now))
    newest = [F.col("published_at").desc_nulls_last(), F.col("ord")]
    placed = ready.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(*newest))).where(F.col("place") <= per_source)
    return placed.orderBy(*newest).limit(per_run).drop("n_stored")


def pending(analyses: DataFrame, items: DataFrame, since: Column, limit: int, readable: Column | None = None) -> DataFrame:
    """Analyses that were not posted, with their items, oldest first; ties by id. readable: a condition on the joined row; one whose payload can't
    be read is skipped, so that it never takes a place of the limit."""
    waiting = analyses.where(F.col("posted_at").isNull() & (F.col("created_at") >= since)).join(items, "item_id")
    return (waiting.where(F.coalesce(readable, F.lit(False))) if readable is not None else waiting).orderBy("created_at", "id").limit(limit)


def count_by_source(stored: DataFrame) -> DataFrame:
    """(source, n, n_keys) of the stored signals."""
    return stored.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("external_id").alias("n_keys"))


def schedule_day(ts: Column) -> Column:
    """The local day of an instant."""
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def quiet_days(runs: DataFrame, claimed: DataFrame) -> DataFrame:
    """Days that deserve the nothing-happened message: sources were read, nothing new, no alerts, and the day isn't claimed yet."""
    quiet = runs.where("alerts = 0 and new_items = 0 and sources_read > 0")
    return quiet.join(claimed.select("day"), "day", "left_anti")


def read_paths(steps: DataFrame, key: str, order: str, step: Column) -> DataFrame:
    """(key, path, place): the files that were read in a transcript, each once, in the order of their first reading. A step (JSON) is a reading if
    it is a call of a tool, and the tool reads: listing or searching a file is not knowing what it says."""
    field = lambda path: F.get_json_object(step, path)
    read = steps.where((field("$.type") == "toolCall") & (field("$.message.type") == "read") & (F.trim(field("$.message.args.path")) != ""))
    first = read.select(key, order, field("$.message.args.path").alias("path")).groupBy(key, "path").agg(F.min(order).alias("first"))
    return first.select(key, "path", F.row_number().over(Window.partitionBy(key).orderBy("first", "path")).alias("place"))
