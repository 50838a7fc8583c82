"""Feeds that arrive bit by bit: upserts, and actions only where content has moved."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..keyed import KeyedTable

#: Keeps state on the executors' disks and its changes in the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def upsert_stream(rows: DataFrame, table: KeyedTable, checkpoint_dir: str) -> StreamingQuery:
    """Keeps in table the last row of each key.

    A micro-batch rewrites the buckets of its keys alone. One that is run again
    after a failure gives the same table, as the merge is idempotent.
    """

    def merge(batch: DataFrame, _: int) -> None:
        table.merge(batch)
        table.forget(batch.sparkSession)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


class LastHash(StatefulProcessor):
    """Lets through the rows of an id whose hash differs from the id's last one; the state of an id is that hash."""

    def __init__(self, columns: list[str], order: str, ttl_ms: int | None):
        self.columns, self.order, self.ttl_ms = columns, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash STRING", self.ttl_ms)

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timers: TimerValues) -> None:  # noqa: N802
        self.last.update((initial["hash"].iloc[-1],))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self.last.exists()
        last = self.last.get()[0] if known else None
        # One id's rows in one micro-batch.
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        keep = []
        for h in batch["hash"]:
            keep.append(not known or h != last)
            known, last = True, h
        self.last.update((last,))
        yield batch[keep][self.columns]

    def close(self) -> None:
        pass


def keep_state_on_disk(spark: SparkSession, expires: bool = False) -> None:
    """Sets the state store that value states need, and for those that expire no micro-batches without rows: a run over what is there would not end, as time alone asks for another."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if expires:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)


def changed_only(rows: DataFrame, order: str, ttl: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """The rows of a stream (id, hash, ...) whose hash differs from the id's last one in the order of a column.

    Rows of a micro-batch are put in order here; a later batch follows an earlier one.
    With a ttl an id is forgotten after that processing time without a row, and its next row counts
    as new. known (id, hash), one row an id, is what the last snapshot had: the state that
    a stream without a checkpoint begins with. Sets the session's state store, see keep_state_on_disk().
    """
    keep_state_on_disk(rows.sparkSession, bool(ttl))
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    initial = known.select("id", "hash").groupBy("id") if known is not None else None
    return rows.groupBy("id").transformWithStateInPandas(
        LastHash(rows.columns, order, ttl_ms), rows.schema, "Append", "ProcessingTime" if ttl else "None", initialState=initial
    )


def replay(rows: DataFrame, path: str, order: str, parts: int = 4) -> DataFrame:
    """rows written under path in the order of a numeric column, one file after the other, and read back as a stream of one file a micro-batch."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    rows.limit(0).write.mode("overwrite").parquet(path)
    if low is not None:
        step = F.least(F.floor((F.col(order) - low) * parts / F.lit(high - low + 1)), F.lit(parts - 1))
        for n in range(parts):
            rows.where(step == n).coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
