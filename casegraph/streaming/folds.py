"""Stateful streams: the fold of a case's stage events, kept in state between micro-batches, and joins of two streams.

transformWithState needs the RocksDB state store (see state_store()).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.workflow import ENDED, INTERRUPTED

RECORD = "status string, status_at long, started_at long, finished_at long, updated_at long, error string, error_at long, job_id string, job_at long"
#: A record that nothing has touched for so long goes; a run that nothing has ended for so long was interrupted.
KEPT_MS, RUN_MS = 90 * 24 * 3600 * 1000, 6 * 3600 * 1000


def state_store(spark: SparkSession, idle_batches: bool = False) -> None:
    """Settings for folded_stages. idle_batches: micro-batches without data, so that timers fire while nothing arrives; a run over what is
    there now (availableNow) would never end with them."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle_batches).lower())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class StageFold(StatefulProcessor):
    """One record a case and stage. Events may come late or in any order: each field keeps the moment that decided it."""

    def __init__(self, keys: list[str], kept_ms: int = KEPT_MS, run_ms: int = RUN_MS):
        self.keys, self.kept_ms, self.run_ms = keys, kept_ms, run_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD, self.kept_ms)

    def _told(self, key: tuple, r: dict) -> Row:
        running = r["status"] == "running"
        shown = {"status": r["status"], "started_at": r["started_at"], "finished_at": r["finished_at"], "updated_at": r["updated_at"], "error": r["error"] or "", "job_id": r["job_id"] if running else None}
        return Row(**dict(zip([*self.keys, "stage"], key, strict=True)), **shown)

    def _timer(self, now: int, running: bool) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if running:
            self.handle.registerTimer(now + self.run_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = ["status", "status_at", "started_at", "finished_at", "updated_at", "error", "error_at", "job_id", "job_at"]
        r = dict(zip(names, self.record.get(), strict=True)) if self.record.exists() else dict.fromkeys(names)
        later = lambda old, at: old is None or at >= old
        for e in rows:
            at, begun, ended = e["at"], e["status"] == "running", e["status"] in ENDED
            if e["status"] is not None and later(r["status_at"], at):
                r["status"], r["status_at"] = e["status"], at
            if begun and later(r["started_at"], at):
                r["started_at"] = at
            if ended and later(r["finished_at"], at):
                r["finished_at"] = at
            if later(r["updated_at"], at):
                r["updated_at"] = at
            if (begun or ended or e["error"] is not None) and later(r["error_at"], at):
                r["error"], r["error_at"] = "" if begun or ended else e["error"], at
            if e["job_id"] is not None and later(r["job_at"], at):
                r["job_id"], r["job_at"] = e["job_id"], at
        self.record.update(tuple(r[n] for n in names))
        self._timer(timerValues.getCurrentProcessingTimeInMs(), r["status"] == "running")
        yield self._told(key, r)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        names = ["status", "status_at", "started_at", "finished_at", "updated_at", "error", "error_at", "job_id", "job_at"]
        if self.record.exists():
            r = dict(zip(names, self.record.get(), strict=True))
            if r["status"] == "running":
                r |= {"status": "error", "error": INTERRUPTED, "error_at": r["updated_at"]}
                self.record.update(tuple(r[n] for n in names))
                yield self._told(key, r)

    def close(self) -> None:
        pass


def folded_stages(events: DataFrame, keys: list[str], kept_ms: int = KEPT_MS, run_ms: int = RUN_MS) -> DataFrame:
    """workflow.merge_stage_events over a stream: keys, stage and the record as it stands after each micro-batch that touched it (update
    mode). events: keys, stage, status, error, job_id, at (long). Each field comes from its last event, whatever the order of arrival;
    of events of one moment the one that is read last counts."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's own worker does not have this package on its path
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, "stage"]), "status string, started_at long, finished_at long, updated_at long, error string, job_id string"])
    rows = events.select(*keys, "stage", "status", "error", F.col("job_id").cast("string").alias("job_id"), F.col("at").cast("long").alias("at"))
    return rows.groupBy(*keys, "stage").transformWithState(StageFold(keys, kept_ms, run_ms), schema, "Update", "processingTime")


def followed(first: DataFrame, then: DataFrame, keys: list[str], at: str, then_at: str, within: str, late: str, how: str = "inner") -> DataFrame:
    """Pairs of a row and a later row of the same key, at most `within` after it; with how="leftOuter" also rows that nothing followed.

    On streams both sides have a watermark, so the bound tells Spark when a row can go from state: buffered rows are as
    many as arrive within the bound and the lateness. Columns of both sides have different names, but for keys.
    """
    a, b = first.withWatermark(at, late), then.withWatermark(then_at, late)
    for k in keys:
        b = b.withColumnRenamed(k, f"_{k}")
    bound: Column = (F.col(then_at) >= F.col(at)) & (F.col(then_at) <= F.col(at) + F.expr(f"INTERVAL {within}"))
    for k in keys:
        bound = bound & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, bound, how).drop(*[f"_{k}" for k in keys])
