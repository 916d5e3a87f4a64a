"""The per-article state machine over a stream of events, and the table it is saved in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sinks.snapshots import Snapshots

KEY = ["law", "article_number", "article_suffix"]
EVENTS = "seq long, law string, article_number int, article_suffix string, event string, cost double, error string"
OUTPUT = "law string, article_number int, article_suffix string, status string, cost_usd double, error string, total_cost double, last_seq long"
_STATE = "status string, cost_usd double, error string, total_cost double, last_seq long"
_NEW = (None, 0.0, "", 0.0, -1)
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(state: tuple, events: pd.DataFrame) -> tuple:
    """The state (status, cost, error, total, last seq) after events of one key, in order of seq. Events up to the last
    seq came before; a key not yet added ignores all but add; an absent cost is none."""
    status, cost, error, total, last = state
    for e in events.sort_values("seq", kind="stable").itertuples():
        if e.seq <= last:
            continue
        last = int(e.seq)
        if e.event == "add":
            status = status or "pending"
        elif status is not None:
            status = e.event
            if e.event == "completed":
                cost = 0.0 if pd.isna(e.cost) else float(e.cost)
                total += cost
            else:
                error = "" if pd.isna(e.error) else e.error
    return status, cost, error, total, last


class ArticleState(StatefulProcessor):
    """One value for each article, in the state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._value = handle.getValueState("article", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self._value.get()) if self._value.exists() else _NEW
        # the batch's events of one article; a batch is as large as the trigger lets it be
        after = advance(before, pd.concat(list(rows)))
        if after[4] != before[4]:
            self._value.update(after)
        if after[0] is not None and after[4] != before[4]:
            yield pd.DataFrame([(*key, *after)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def track(events: DataFrame) -> DataFrame:
    """Stream of EVENTS -> the state of each key that changed. Cost keeps the last completion, total_cost the sum of
    them; events of keys never added, and of a sequence number not above the last, are ignored. The session's state
    store must be RocksDB's (see follow)."""
    return events.groupBy(*KEY).transformWithStateInPandas(ArticleState(), OUTPUT, "Update", "None")


def state_table(spark: SparkSession, root: str, buckets: int = 16) -> Snapshots:
    """Where states are saved: OUTPUT by KEY."""
    return Snapshots(spark, root, KEY, OUTPUT, buckets)


def follow(spark: SparkSession, source: str, table: Snapshots, checkpoint: str, files_a_batch: int = 1000) -> None:
    """Takes what is new among the Parquet files of EVENTS in source into the table, then returns. A run that dies goes
    on from its checkpoint: its last batch comes again, and puts the same rows in place of the same keys."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(source)

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.persist()  # several passes over one batch must not work out its states again
        try:
            table.overwrite(rows, "last_seq")
        finally:
            rows.unpersist()

    query = track(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()


def saved_summary(table: Snapshots) -> DataFrame:
    """(total, completed, failed, pending, total_cost) of the saved states."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "pending")]
    return table.read().agg(F.count("*").alias("total"), *counts, F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost"))
