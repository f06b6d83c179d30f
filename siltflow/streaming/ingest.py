"""Streaming ingestion: what a batch insert-if-absent does, with the keys that were seen as state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.signals import KEY
from ..storage import work_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Of each key the row that is first by an order in the micro-batch that first has it; nothing of a key that was seen before. Nulls of the
    order come first, of equal rows any."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "since boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        if self.seen.exists():
            return
        first = min(rows, key=lambda r: (r["row"][self.order] is not None, r["row"][self.order] or 0), default=None)
        if first is not None:
            self.seen.update((True,))
            yield Row(row=first["row"])

    def handleInitialState(self, key, initial: Row, timer_values) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        """There is nothing to close."""


def first_rows(stream: DataFrame, keys: tuple[str, ...] = KEY, order: str = "ord", stored: DataFrame | None = None) -> DataFrame:
    """The rows of a stream that an insert-if-absent adds. stored: rows whose keys are known from the start; read once, when the stream is first
    started on its checkpoint."""
    grouped = stream.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.struct(*stream.columns).alias("row")).groupBy(*[f"key_{i}" for i in range(len(keys))])
    names = [f"key_{i}" for i in range(len(keys))]
    initial = stored.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).distinct().groupBy(*names) if stored is not None else None
    return grouped.transformWithState(FirstOfKey(order), StructType().add("row", stream.schema), "Append", "None", initial).select("row.*")


def ingest(stream: DataFrame, store: str, checkpoint: str, keys: tuple[str, ...] = KEY, order: str = "ord", stored: DataFrame | None = None) -> None:
    """Runs the stream to its end and adds the new rows of each micro-batch to the Parquet store.

    Keys are remembered for ever, unlike dropDuplicatesWithinWatermark, in a state store on disk, by partition of the key: a micro-batch reads the
    state of its own keys and never the store, however large that is. Started again on its checkpoint, it goes on where it stopped. A batch writes
    its own folder, so a batch that is run again after a failure replaces what it wrote.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)

    def add(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")

    try:
        new = first_rows(stream, keys, order, stored)
        new.writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)


def dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of signals, ingested into a new store."""
    path = f"{sf_dir}/events.parquet"
    root = f"{work_dir(spark)}/ingest-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = events.select(F.col("event_id").alias("ord"), F.col("event_type").alias("source"), F.col("user_id").alias("external_id"), F.col("ts").alias("published_at"))
    ingest(stream, f"{root}/store", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/store")
