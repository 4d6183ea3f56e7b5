"""Incremental ingestion with Structured Streaming: each new file is extracted once and merged into the snapshot."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeseek.operators import changes
from lakeseek.plans.maintenance import merge_documents
from lakeseek.sources.store import Store

SCHEMA = "path string, text string, internal_id long, download_date string, downloaded_at string"


def ingest(spark: SparkSession, folder: str, store: Store, checkpoint: str, max_files: int | None = None) -> None:
    """Read document batches (JSON lines of SCHEMA) that arrived since the last run, extract chunks, and merge them file by file into the store that maintenance keeps; vectors and index follow in its next run. A batch that runs again after a failure gives the same snapshot."""
    source = spark.readStream.schema(SCHEMA)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)

    def apply(batch: DataFrame, number: int) -> None:
        latest = changes.last_by(batch, "path", F.col("downloaded_at"), F.col("text"))
        with store.lock():
            merge_documents(store, latest.withColumn("document_hash", F.md5("text")), datetime.now(UTC).replace(tzinfo=None))

    run = source.json(folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def newness(events: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Arrivals by event time: counts per window of a stream or a table, late rows within the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


class _Newness(StatefulProcessor):
    """The first time of a key, kept for good; a timer tells when it is no longer new."""

    def __init__(self, days: int) -> None:
        self.days = timedelta(days=days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "at timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = [t for batch in rows for t in batch["at"] if not pd.isna(t)]
        if self.first.exists() or not times:
            return
        first = min(times)
        self.first.update((first.to_pydatetime(),))
        self.handle.registerTimer(int((first + self.days).timestamp() * 1000))
        yield pd.DataFrame({"key": [key[0]], "state": ["new"], "at": [first]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"key": [key[0]], "state": ["old"], "at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")]})

    def close(self) -> None:
        pass


#: The state store that timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newness_changes(events: DataFrame, key: str, time: str, days: int = 7, late: str = "0 seconds") -> DataFrame:
    """(key, state, at) of a stream: ``new`` at a key's first time, ``old`` once event time is days beyond it, each once, whatever repeats or restarts; ids and timers live in the stream's checkpoint.

    Rows later than the watermark allows are dropped; the query's progress counts them. Needs STATE_STORE.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = events.select(F.col(key).alias("key"), F.col(time).alias("at")).where("key is not null").withWatermark("at", late)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, state string, at timestamp"
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Newness(days), outputStructType=schema, outputMode="Append", timeMode="EventTime")
