"""Keyed tables in Parquet, in memory and behind a fallback; issues; and the outbox of side effects.

Parquet has no MERGE. A table lies in BUCKETS by a hash of its key; a write is a folder with a folder for each bucket that it touched, and a small
state, which is renamed into place, names the folders of each bucket. Inserts add to the buckets of their rows; a change reads and writes the
buckets of the keys that change, no others. Readers follow the newest state, so a write that fails half-way is never seen, and a second writer
that was too late gets an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import commit, file_system, latest, numbered, written
from . import corpus, signals

#: Buckets of a table, and folders of a bucket that were appended one by one before they become one.
BUCKETS, MOST_PARTS = 64, 16


def item_id(source: Column, external_id: Column) -> Column:
    """An item's id follows from its key, so that a task that runs again gives the same."""
    return F.sha1(F.concat_ws("|", source, external_id))


class Store:
    """Tables of signals, pages, claims, analyses, days, issues and what happened to them, under one path. write=False reads a real store and
    leaves nothing behind: inserts return rows with ids of their own, every day can be claimed."""

    #: The tables' columns, and the columns by which they lie in buckets.
    TABLES = {
        "items": "id string, source string, external_id string, title string, url string, published_at timestamp, raw string",
        "pages": "url string, title string, text string, kind string, content_hash string, fetched_at timestamp, changed_at timestamp, last_used_at timestamp, retired_at timestamp, missing_streak int, discovered_from array<string>",
        "claims": "url string, name string, paragraph string, heading string",
        "analyses": "id string, item_id string, analysis string, posted_at timestamp, created_at timestamp",
        "days": "day date, posted_at timestamp",
        "issues": "number long, title string, body string, labels array<string>, state string, reason string",
        "issue_events": "number long, kind string, body string",
        "sent": "id string, state string",
    }
    KEYS = {"items": signals.KEY, "pages": ("url",), "claims": ("url",), "analyses": ("id",), "days": ("day",), "issues": ("number",), "issue_events": ("number",), "sent": ("id",)}

    def __init__(self, spark: SparkSession, root: str, write: bool = True):
        self.spark, self.root, self.write = spark, root, write

    def _state(self, name: str) -> tuple[int, dict[str, list[str]]]:
        """(number, folders by bucket) of a table's newest state."""
        found = latest(self.spark, f"{self.root}/{name}/_state")
        return (found[0], json.loads(found[1])) if found else (-1, {})

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        """df with the columns of a table; those that it lacks are null."""
        fields = [c.split(" ", 1) for c in self.TABLES[name].split(", ")]
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])

    def bucket(self, name: str) -> Column:
        """The bucket of a row, by the table's key as text."""
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.KEYS[name]]), F.lit(BUCKETS)).cast("int")

    def _paths(self, name: str, buckets: dict[str, list[str]]) -> list[str]:
        return [f"{self.root}/{name}/{folder}/bucket={b}" for b, folders in sorted(buckets.items()) for folder in folders]

    def _rows(self, name: str, buckets: dict[str, list[str]]) -> DataFrame:
        paths = self._paths(name, buckets)
        return self.spark.read.schema(self.TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.TABLES[name])

    def read(self, name: str) -> DataFrame:
        """The table as its newest state has it."""
        return self._rows(name, self._state(name)[1])

    def near(self, name: str, rows: DataFrame) -> DataFrame:
        """The stored rows of the buckets that rows with the table's key would go to."""
        touched = self._touched(name, rows)
        return self._rows(name, {b: f for b, f in self._state(name)[1].items() if b in touched})

    def _touched(self, name: str, rows: DataFrame) -> set[str]:
        return {str(r[0]) for r in rows.select(self.bucket(name)).distinct().collect()}  # BUCKETS rows at most

    def _save(self, name: str, df: DataFrame) -> tuple[str, list[str]]:
        """Writes rows to a folder of their own; (its name, the buckets that it has)."""
        folder = f"part-{uuid.uuid4().hex}"
        rows = self._shaped(name, df)
        # a bucket is one task's and so one file's
        rows.withColumn("bucket", self.bucket(name)).repartitionById(BUCKETS, F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
        fs, at = file_system(self.spark, f"{self.root}/{name}/{folder}")
        return folder, [n[7:] for x in fs.listStatus(at) if (n := x.getPath().getName()).startswith("bucket=")]

    def _commit(self, name: str, number: int, buckets: dict[str, list[str]]) -> None:
        commit(self.spark, f"{self.root}/{name}/_state", number, json.dumps({b: f for b, f in buckets.items() if f}), strict=True)

    def replace(self, name: str, df: DataFrame) -> None:
        """Writes a whole table. A read-only store doesn't."""
        if self.write:
            number, _ = self._state(name)
            folder, buckets = self._save(name, df)
            self._commit(name, number + 1, {b: [folder] for b in buckets})

    def change(self, name: str, keys: DataFrame, new: Callable[[DataFrame], DataFrame]) -> None:
        """Writes the buckets of some keys (rows with the table's key) anew: new makes their rows from the stored ones. Rows that new makes must
        have keys of these buckets."""
        if not self.write:
            return
        touched, (number, buckets) = self._touched(name, keys), self._state(name)
        if not touched:
            return
        held = self._rows(name, {b: f for b, f in buckets.items() if b in touched})
        folder, there = self._save(name, new(held))
        self._commit(name, number + 1, {b: f for b, f in buckets.items() if b not in touched} | {b: [folder] for b in there})

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows beside those of their buckets, which are not written again; a bucket of over MOST_PARTS folders becomes one."""
        if not self.write:
            return
        number, buckets = self._state(name)
        folder, there = self._save(name, df)
        buckets = buckets | {b: [*buckets.get(b, ()), folder] for b in there}
        full = {b: f for b, f in buckets.items() if len(f) > MOST_PARTS}
        if full:
            folder, there = self._save(name, self._rows(name, full))
            buckets = buckets | {b: [folder] for b in there}
        self._commit(name, number + 1, buckets)

    def vacuum(self, name: str) -> int:
        """Removes the folders that a table's newest state doesn't name; returns how many went. Not while others read or write."""
        number, buckets = self._state(name)
        if number < 0 or not self.write:
            return 0
        fs, at = file_system(self.spark, f"{self.root}/{name}")
        path, gone = self.spark._jvm.org.apache.hadoop.fs.Path, 0
        held = {f for folders in buckets.values() for f in folders}
        for x in fs.listStatus(at):
            folder = x.getPath().getName()
            if folder.startswith("part-") and folder not in held:
                fs.delete(x.getPath(), True)
                gone += 1
            elif folder.startswith("part-"):
                for b in fs.listStatus(x.getPath()):
                    n = b.getPath().getName()
                    if n.startswith("bucket=") and folder not in buckets.get(n[7:], ()):
                        fs.delete(path(b.getPath().toString()), True)
        return gone

    def insert_new(self, batch: DataFrame) -> DataFrame:
        """Insert-if-absent of items (with an ord column); returns the rows that were new, with their ids."""
        new = signals.new_items(batch, self.near("items", batch))
        if not self.write:
            return numbered(new, ["ord"], "place").withColumn("id", F.concat(F.lit("dry-run-"), "place")).drop("place")
        new = written(new.withColumn("id", item_id(*[F.col(c) for c in signals.KEY])))
        self.append("items", new.drop("ord"))
        return new

    def find_item(self, source: str, external_id: str) -> str | None:
        """The id of a stored item; null if there is none."""
        asked = self.spark.createDataFrame([(source, external_id)], "source string, external_id string")
        row = self.near("items", asked).where((F.col("source") == source) & (F.col("external_id") == external_id)).select("id").first()
        return row["id"] if row else None

    def known_keys(self, batch: DataFrame) -> DataFrame:
        return signals.known(batch, self.read("items"))

    def count_items(self, source: str) -> int:
        return self.read("items").where(F.col("source") == source).count()

    def page_meta(self) -> DataFrame:
        return corpus.page_meta(self.read("pages"))

    def get_pages(self, urls: list[str]) -> DataFrame:
        return corpus.pages_by_url(self.read("pages"), urls)

    def unposted(self, since: Column, limit: int) -> DataFrame:
        items = self.read("items").select(F.col("id").alias("item_id"), "title", "url")
        return signals.pending(self.read("analyses"), items, since, limit)

    def record_run(self, books: DataFrame, used: DataFrame, now: Column) -> None:
        """Streaks, sources, retirements and last uses of a run, from bookkeeping() and the pages (url) that were used; only the buckets of pages
        that one of these changes are written."""
        told = written(books.select("url", "retire", "streak", "sources").join(used.select("url", F.lit(True).alias("used")).distinct(), "url", "full"))
        held = self.read("pages").join(told, "url")
        differs = F.col("used").isNotNull() | (F.col("retire") & F.col("retired_at").isNull()) | ~F.col("missing_streak").eqNullSafe(F.coalesce("streak", "missing_streak")) | ~F.col("discovered_from").eqNullSafe(F.coalesce("sources", "discovered_from"))

        def new(pages: DataFrame) -> DataFrame:
            p = pages.join(told, "url", "left")
            return p.withColumns({
                "retired_at": F.when(F.coalesce("retire", F.lit(False)), F.coalesce("retired_at", now)).otherwise(F.col("retired_at")), "last_used_at": F.when(F.col("used"), now).otherwise(F.col("last_used_at")),
                "missing_streak": F.coalesce("streak", "missing_streak"), "discovered_from": F.coalesce("sources", "discovered_from"),
            })

        self.change("pages", written(held.where(differs).select("url")), new)

    def claims_about(self, name: str, limit: int) -> DataFrame:
        from . import routing

        return routing.ranked_claims(self.read("claims").where(F.col("name") == name), name, limit)

    def save_pages(self, pages: DataFrame, now: Column) -> None:
        """Writes pages (url, title, content_hash, and what else the table has) over those that are held."""
        more = [c for c in ("text", "kind", "discovered_from") if c in pages.columns]
        new = written(pages.withColumn("last_used_at", F.col("last_used_at") if "last_used_at" in pages.columns else F.lit(None).cast("timestamp")).withColumnsRenamed({"sources": "discovered_from"}))

        def over(held: DataFrame) -> DataFrame:
            rest = [c for c in held.columns if c in ("text", "kind", "missing_streak", "discovered_from")]
            old = held.select("url", *[F.col(c).alias(f"old_{c}") for c in rest])
            both = corpus.upsert(held, new, now).join(old, "url", "left")
            theirs = new.select("url", *[F.col(c).alias(f"new_{c}") for c in {*more, *(["discovered_from"] if "discovered_from" in new.columns else [])}])
            both = both.join(theirs, "url", "left")
            return both.select(*[c for c in both.columns if not c.startswith(("old_", "new_"))], *[F.coalesce(*[F.col(x) for x in (f"new_{c}", f"old_{c}") if x in both.columns]).alias(c) for c in rest])

        self.change("pages", new.select("url"), over)

    def replace_claims(self, urls: DataFrame, claims: DataFrame) -> None:
        columns = self.spark.createDataFrame([], self.TABLES["claims"]).columns
        self.change("claims", urls, lambda held: corpus.replace_by_url(held.select(*columns), urls, claims.select(*columns)))

    def record(self, analyses: DataFrame) -> None:
        self.append("analyses", analyses)

    def mark_posted(self, ids: DataFrame, now: Column) -> None:
        mark = lambda held: held.join(ids.select("id", F.lit(True).alias("_now")).distinct(), "id", "left").withColumn("posted_at", F.when(F.col("_now"), now).otherwise(F.col("posted_at")))
        self.change("analyses", ids, mark)

    def claim_day(self, day: str, now: Column) -> bool:
        """True once a day; always true in a read-only store."""
        if not self.write:
            return True
        days = self.read("days")
        if days.where(F.col("day") == F.lit(day).cast("date")).limit(1).count():
            return False
        row = self.spark.range(1).select(F.lit(day).cast("date").alias("day"), now.alias("posted_at"))
        self.append("days", row)
        return True


class MemoryStore(Store):
    """The same without a path: tables are held as DataFrames, analyses are not kept, and nothing outlives the process."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, "")
        self.tables: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], self.TABLES[name])

    def near(self, name: str, rows: DataFrame) -> DataFrame:
        return self.read(name)

    def replace(self, name: str, df: DataFrame) -> None:
        self.tables[name] = written(self._shaped(name, df))

    def change(self, name: str, keys: DataFrame, new: Callable[[DataFrame], DataFrame]) -> None:
        self.replace(name, new(self.read(name)))

    def append(self, name: str, df: DataFrame) -> None:
        self.tables[name] = self.read(name).unionByName(written(self._shaped(name, df)))

    def vacuum(self, name: str) -> int:
        return 0

    def insert_new(self, batch: DataFrame) -> DataFrame:
        new = written(signals.new_items(batch, self.read("items")).withColumn("id", item_id(*[F.col(c) for c in signals.KEY])))
        self.append("items", new.drop("ord"))
        return new

    def record(self, analyses: DataFrame) -> None:
        """Keeps nothing, so there is never a backlog."""

    def mark_posted(self, ids: DataFrame, now: Column) -> None:
        """There is nothing to mark."""


class Fallback:
    """A store until it can't be reached, then another for good. Whatever fails for another reason is raised. Every method of a store can be
    called; a call that finds the first unreachable is made again on the other."""

    def __init__(self, store: Store, other: Callable[[], Store], unreachable: Callable[[Exception], bool]):
        self._store, self._other, self._unreachable, self.fell_back = store, other, unreachable, False

    def __getattr__(self, name: str):
        def call(*args, **kwargs):
            try:
                return getattr(self._store, name)(*args, **kwargs)
            except Exception as e:
                if self.fell_back or not self._unreachable(e):
                    raise
                self._store, self.fell_back = self._other(), True
                return getattr(self._store, name)(*args, **kwargs)

        found = getattr(self._store, name)
        return call if callable(found) else found


class Issues:
    """Issues as tables of a store. check: raises for labels that are not accepted; an issue is then filed without them, since it matters more
    than its labels. Nothing here fails a run: what can't be done returns None or False. A read-only store says what would be done."""

    def __init__(self, store: Store, check: Callable[[list[str]], None] = lambda labels: None):
        self.store, self.check = store, check

    def _accepted(self) -> Callable[[Column], Column]:
        """A column of labels, empty where the check refuses them."""
        check = self.check

        def keep(labels: pd.Series) -> pd.Series:
            def one(x):
                try:
                    check(list(x))
                    return list(x)
                except ValueError:
                    return []

            return labels.map(one)

        return lambda c: F.pandas_udf(keep, "array<string>")(F.coalesce(c, F.expr("cast(array() as array<string>)")))

    def create_all(self, drafts: DataFrame, order: str) -> DataFrame | None:
        """Opens an issue for each draft (title, body, labels, and more), numbered by an order after those that are there, in one write a table;
        returns the drafts with their numbers. None in a read-only store."""
        if not self.store.write:
            return None
        last = self.store.read("issues").agg(F.max("number")).first()[0] or 0
        new = written(numbered(drafts, [order], "number").withColumn("number", F.col("number") + F.lit(last)).withColumn("labels", self._accepted()(F.col("labels"))))
        self.store.append("issues", new.withColumn("state", F.lit("open")).withColumn("reason", F.lit(None).cast("string")))
        self.store.append("issue_events", new.select("number", F.lit("opened").alias("kind"), F.col("title").alias("body")))
        return new

    def update_all(self, patches: DataFrame) -> int:
        """Changes issues by patches (number, and of title, body, labels, state and reason those that change; null leaves a value), one a number,
        in one write a table; labels that are not accepted are left out of their patch. Returns how many issues were there to be changed."""
        if not self.store.write:
            return 0
        fields = [c for c in ("title", "body", "labels", "state", "reason") if c in patches.columns]
        p = patches.where("number is not null").select("number", *[F.col(c).alias(f"new_{c}") for c in fields])
        if "labels" in fields:
            p = p.withColumn("new_labels", F.when(F.col("new_labels").isNotNull(), F.when(self._accepted()(F.col("new_labels")) == F.col("new_labels"), F.col("new_labels"))))
        p = written(p.join(self.store.read("issues").select("number"), "number", "left_semi"))
        n = p.count()
        if n:
            self.store.change("issues", p, lambda held: held.join(p, "number", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in fields}))
            told = F.array_join(F.filter(F.array(*[F.when(F.col(f"new_{c}").isNotNull(), F.lit(c)) for c in sorted(fields)]), lambda x: x.isNotNull()), ", ")
            self.store.append("issue_events", p.select("number", F.lit("updated").alias("kind"), told.alias("body")))
        return n

    def comment_all(self, comments: DataFrame) -> bool:
        """Adds comments (number, body); those without a number are left out."""
        if not self.store.write:
            return False
        self.store.append("issue_events", comments.where("number is not null").select("number", F.lit("comment").alias("kind"), "body"))
        return True

    def create(self, title: str, body: str, labels: list[str]) -> int | None:
        """The new issue's number, or None."""
        try:
            new = self.create_all(self.store.spark.createDataFrame([(title, body, labels)], "title string, body string, labels array<string>"), "title")
            return new.first()["number"] if new is not None else None
        except Exception:  # noqa: BLE001
            return None

    def update(self, number: int | None, **patch) -> bool:
        """Changes an issue's title, body, labels, state or reason; labels that are not accepted are left out of the patch."""
        if number is None or not self.store.write:
            return False
        kinds = dict(c.split(" ", 1) for c in Store.TABLES["issues"].split(", "))
        try:
            row = self.store.spark.createDataFrame([(number, *patch.values())], ", ".join(["number long", *(f"{c} {kinds[c]}" for c in patch)]))
            return self.update_all(row) > 0
        except Exception:  # noqa: BLE001
            return False

    def comment(self, number: int | None, body: str) -> bool:
        return number is not None and self.comment_all(self.store.spark.createDataFrame([(number, body)], "number long, body string"))

    def close(self, number: int | None, reason: str, labels: list[str] | None = None) -> bool:
        """Closed with its labels in one change, so that it is never closed and unlabelled."""
        return self.update(number, state="closed", reason=reason, **({"labels": labels} if labels else {}))


def with_fallback(open_store: Callable[[], Store], fallback: Callable[[], Store], unreachable: Callable[[Exception], bool]) -> Fallback:
    """The first store, or the other for good from the first call on that can't reach it, its opening among them; other errors are raised."""
    try:
        return Fallback(open_store(), fallback, unreachable)
    except Exception as e:
        if not unreachable(e):
            raise
        out = Fallback(fallback(), fallback, unreachable)
        out.fell_back = True
        return out


def deliver(outbox: DataFrame, post: Callable[[dict], bool], most: int = 100) -> list[str]:
    """Posts messages (id, payload) one by one from the driver, at most so many, and returns the ids that were taken; a failure leaves its
    message for the next run. Effects never run in executors, where a retried task would repeat them."""
    done = []
    for row in outbox.orderBy("id").limit(most).toLocalIterator():
        try:
            if post(row.asDict(recursive=True)):
                done.append(row["id"])
        except Exception:  # noqa: BLE001
            continue
    return done


def write_messages(messages: DataFrame, path: str) -> None:
    """Messages as JSON lines, for a dry run to be looked at and replayed."""
    messages.write.mode("overwrite").json(path)


def write_artifact(messages: DataFrame, path: str, made: Column) -> None:
    """One text a message (id, text, payload): as it is read, and the payload as it is sent. made: what it was made by, and of what."""
    text = F.concat(F.lit("# Message "), F.col("id").cast("string"), F.lit("\n\n"), made, F.lit("\n\n## As it is read\n\n"), F.col("text"), F.lit("\n\n## Payload\n\n```json\n"), F.col("payload"), F.lit("\n```\n"))
    messages.select(F.col("id").cast("string").alias("id"), text.alias("value")).write.mode("overwrite").parquet(path)


def deliver_once(store: Store, messages: DataFrame, post: Callable[[dict], bool]) -> dict[str, int]:
    """Posts messages (id, payload) that the store's ledger doesn't have, from the driver, in the order of their ids, and returns how many were
    sent, failed and skipped. A message is entered as claimed before any of the batch is posted, and as sent or failed after. A batch that runs
    again after it broke off posts nothing of what it had claimed: it may have been sent, and is told as skipped."""
    once = written(messages.select("id", "payload").where("id is not null").groupBy("id").agg(F.min("payload").alias("payload")))
    new = written(once.join(store.near("sent", once).select("id"), "id", "left_anti"))
    out = {"sent": 0, "failed": 0, "skipped": once.count() - new.count()}
    store.append("sent", new.select("id", F.lit("claimed").alias("state")))
    done: list[tuple[str, str]] = []
    kinds, told = "id string, state string", []

    def enter(last: bool = False) -> None:
        """What was done is kept aside by thousands, and entered when there are twice as many as at the time before: a change reads the ledger, so
        that entering each thousand would read it ever longer and ever more often."""
        if done:
            told.append(written(store.spark.createDataFrame(done, kinds)))
            done.clear()
        if told and (last or len(told) >= enter.room):
            rows = written(reduce(DataFrame.unionByName, told)) if len(told) > 1 else told[0]
            store.change("sent", rows, lambda held: held.join(rows.select("id", F.col("state").alias("_now")), "id", "left").withColumn("state", F.coalesce("_now", "state")))
            told.clear()
            enter.room *= 2

    enter.room = 1

    for row in new.orderBy("id").toLocalIterator():
        try:
            state = "sent" if post(row.asDict(recursive=True)) else "failed"
        except Exception:  # noqa: BLE001
            state = "failed"
        done.append((row["id"], state))
        out[state] += 1
        if len(done) == 1000:
            enter()
    enter(last=True)
    return out


def post_stream(outbox: DataFrame, store: Store, post: Callable[[dict], bool], checkpoint: str) -> dict[str, int]:
    """Runs a stream of messages (id, payload) to its end; each is posted once, however often its batch runs and its id comes. Returns the
    counts of `deliver_once` over all batches."""
    total = {"sent": 0, "failed": 0, "skipped": 0}

    def add(batch: DataFrame, epoch: int) -> None:
        for k, n in deliver_once(store, batch, post).items():
            total[k] += n

    outbox.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return total
