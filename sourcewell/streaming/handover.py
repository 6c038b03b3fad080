"""From a run's stored events to its live ones: each event once, in the writer's order, over restarts.

Stored events are read as a table; what comes after them is a stream that may repeat events, bring them out of order or
begin before the stored ones end. State is a run's last sequence number and the few events that wait for an earlier one.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

# fixed values: events that end a run for those who follow it
ENDING = ("final_report", "error")

#: Settings under which a stored stream is drained: timers would ask for batches without end.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DRAINED = STATE_STORE | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with other settings for the queries that start inside; they keep them when the session's come back."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield spark
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class _InOrder(StatefulProcessor):
    """Events of each run by sequence; waits for missing ones up to `most` events and `hold` seconds."""

    def __init__(self, schema: StructType, most: int, hold: float):
        self.schema, self.names, self.most, self.hold = schema, schema.names, most, hold
        self.number, self.kind = schema.names.index("sequence"), schema.names.index("type")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "last long, ended boolean")
        self.waiting = handle.getMapState("waiting", "sequence long", self.schema)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802
        self.place.update((initialState.last, initialState.ended))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        last, ended = self._at()
        if ended:
            return
        kept = self._kept()
        new: dict[int, tuple] = {}
        for row in rows:
            sequence = row["sequence"]
            if sequence is not None and sequence > last and sequence not in kept:
                # Of rows that repeat a number with other content the smallest counts, so that order doesn't matter.
                event = tuple(row[n] for n in self.names)
                new[sequence] = min(new.get(sequence, event), event, key=repr)
        kept |= new
        yield from self._forward(kept, set(new), last, False, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        last, ended = self._at()
        kept = self._kept()
        if kept and not ended:
            yield from self._forward(kept, set(), last, True, timerValues)

    def close(self) -> None:
        pass

    def _at(self) -> tuple[int, bool]:
        return tuple(self.place.get()) if self.place.exists() else (0, False)

    def _kept(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.waiting.iterator()} if self.waiting.exists() else {}

    def _forward(self, kept: dict[int, tuple], new: set[int], last: int, skip: bool, timers) -> Iterator[Row]:
        """Emit what follows `last` without a gap; a gap is skipped if `skip` says so, or while too many wait."""
        gone, ended = [], False
        order = sorted(kept)
        for i, sequence in enumerate(order):
            if sequence != last + 1 and not skip and len(order) - i <= self.most:
                break
            skip = skip and sequence == last + 1  # one gap only
            last = sequence
            gone.append(sequence)
            yield Row(**dict(zip(self.names, kept[sequence], strict=True)))
            if kept[sequence][self.kind] in ENDING:
                ended = True
                break
        for sequence in order if ended else gone:
            if sequence not in new:
                self.waiting.removeKey((sequence,))
        if gone:
            self.place.update((last, ended))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        left = [] if ended else order[len(gone) :]
        for sequence in left:
            if sequence in new:
                self.waiting.updateValue((sequence,), kept[sequence])
        if left:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.hold * 1000))


def stored_until(stored: DataFrame) -> DataFrame:
    """run_id, last (highest sequence stored) and ended: where the live part of each run begins."""
    return stored.where("sequence is not null").groupBy("run_id").agg(F.max("sequence").cast("long").alias("last"), F.coalesce(F.bool_or(F.col("type").isin(*ENDING)), F.lit(False)).alias("ended"))


def follow(live: DataFrame, stored: DataFrame | None = None, most: int = 1_000, hold: datetime.timedelta = datetime.timedelta(minutes=1)) -> DataFrame:
    """The events of a stream that follow those stored, each once and, for each run, in the order of its sequence.

    live is a stream with run_id, sequence, type and any other columns; stored a table with the first three. Numbers up to
    the stored ones and repeats are left out; an event after a missing number waits for it, until more than `most` wait or
    `hold` has passed, when the gap is given up and what it lacked counts as seen. A final report or an error ends a run,
    be it stored or live: nothing follows it. Rows without a run form one run; rows without a sequence are left out. A run
    that isn't stored begins at 1. Memory holds a run's rows of one micro-batch and those that wait. Needs the RocksDB
    state store (STATE_STORE); with the availableNow trigger also DRAINED, when timers fire in batches that have data. The stored part is read when the query first starts; later starts go on from the checkpoint.
    """
    kept = live.select(F.col("sequence").cast("long").alias("sequence"), *(c for c in live.columns if c != "sequence"))
    start = stored_until(stored).groupBy("run_id") if stored is not None else None
    return kept.groupBy("run_id").transformWithState(_InOrder(kept.schema, most, hold.total_seconds()), outputStructType=kept.schema, outputMode="Append", timeMode="ProcessingTime", initialState=start)
