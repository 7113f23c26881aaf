"""Alerts on stalled runs, written while their stream goes on.

Each run and tool keeps the time slots it spoke in and a timer at its next deadline.  The clock is the time of
the latest line of any run; when it passes a deadline and no later line of that run has come, the timer fires and an
alert is written.  Lines are never too late: one that fills a gap withdraws the alert on it, or puts another in its
place, as a row of its own.  What is left once all lines are read is :func:`capturemill.streaming.logs.stalled_runs` of the same
lines, whatever the order of their files.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from capturemill.operators.logs import STEP_LIMITS
from capturemill.streaming.state import rocks_state

SLOT_MS = 60_000
# A run of an unknown tool has no limit of its own, as in the batch query.
NO_LIMIT = 10**9
ALERTS = (
    "run_id bigint, tool string, version bigint, kind string, reason string, started_ms bigint, last_ms bigint, due_ms bigint, clock_ms bigint"
)


STATE = (
    "slots array<struct<slot: bigint, first: bigint, last: bigint>>, version bigint, reason string, started bigint, last bigint, due bigint, at bigint"
)


class Alert(NamedTuple):
    reason: str
    started: int
    last: int
    due: int


def stall(slots: list[tuple[int, int]], limit: int, silence: int, clock: int) -> tuple[Alert | None, int | None]:
    """The alert on slots (first, last) of a run in order of time, and the deadline to wait for if there is none.

    All times are milliseconds.  The first slot counts whose run outlived its limit in it, or after which nothing came
    until its deadline had passed.
    """
    if not slots:
        return None, None
    started = slots[0][0]
    for n, (_, last) in enumerate(slots):
        due = min(started + limit, last + silence)
        after = slots[n + 1][0] if n + 1 < len(slots) else clock
        if after > due or last > started + limit:
            return Alert("over_limit" if due == started + limit else "silent", started, last, due), None
    return None, due


class Held(NamedTuple):
    """What the state of a run keeps: slots (slot, first, last) in order, the alert written last, and the timer."""
    slots: list[tuple[int, int, int]]
    version: int = 0
    reason: str | None = None
    started: int | None = None
    last: int | None = None
    due: int | None = None
    at: int | None = None

    @classmethod
    def of(cls, value: tuple | None) -> Held:
        return cls([tuple(s) for s in value[0]], *value[1:]) if value is not None else cls([])


class StallProcessor(StatefulProcessor):
    """State of one run and tool: its slots, its deadline, and the alert written last."""

    def __init__(self, silence: int):
        self.silence = silence * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value, since each call of a state is a round trip between Python and the store, and a review reads all slots anyway
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        spans: dict[int, tuple[int, int]] = {}
        for row in rows:
            if row["at"] is not None:
                first, last = spans.get(row["at"] // SLOT_MS, (row["at"], row["at"]))
                spans[row["at"] // SLOT_MS] = min(first, row["at"]), max(last, row["at"])
        held = Held.of(self.state.get())
        slots = {slot: (first, last) for slot, first, last in held.slots}
        moved = {}
        for slot, (first, last) in spans.items():
            before = slots.get(slot, (first, last))
            span = min(first, before[0]), max(last, before[1])
            if slots.get(slot) != span:
                moved[slot] = span
        if moved:
            held = held._replace(slots=sorted((slot, *span) for slot, span in (slots | moved).items()))
            yield from self._review(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._review(key, Held.of(self.state.get())._replace(at=None), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _review(self, key, held: Held, clock: int) -> Iterator[Row]:
        """Write what has changed about the alert, and wait for the next deadline."""
        run_id, tool = key
        spans = [(first, last) for _, first, last in held.slots]
        alert, due = stall(spans, STEP_LIMITS.get(tool, NO_LIMIT) * 1000, self.silence, clock)
        before = Alert(held.reason, held.started, held.last, held.due) if held.reason is not None else None
        # the clock has to be past the deadline, not at it
        at = None if due is None else due + 1
        self._wait(held.at, at)
        version = held.version + (alert != before)
        self.state.update((held.slots, version, *(alert or (None,) * 4), at))
        if alert == before:
            return
        kind = "raised" if before is None else "withdrawn" if alert is None else "corrected"
        told = alert or before
        yield Row(run_id=run_id, tool=tool, version=version, kind=kind, reason=told.reason, started_ms=told.started,
                  last_ms=told.last, due_ms=told.due, clock_ms=clock)

    def _wait(self, held: int | None, at: int | None) -> None:
        if held == at:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        if at is not None:
            self.handle.registerTimer(at)


def stalled_alerts(lines: DataFrame, silence: int = 600) -> DataFrame:
    """Changes of alerts (run_id, tool, version, kind, reason, times in milliseconds) on a stream of log lines.

    A run and tool has one alert at a time; its versions count from 1, and ``kind`` says whether it was raised, corrected or
    withdrawn.  ``silence`` seconds have to be longer than a minute, the length of a slot.  Lines without a time are left out.

    Every line is told twice: once with its time for the state, and once as a tick of the clock.  Only ticks carry
    the watermark's column, so a line is never dropped for being late.
    """
    at = F.unix_millis("ts")
    told = lines.where("ts IS NOT NULL").select("run_id", "tool", F.explode(F.array(
        F.struct(at.alias("at"), F.lit(None).cast("timestamp").alias("clock")),
        F.struct(F.lit(None).cast("bigint").alias("at"), F.col("ts").cast("timestamp").alias("clock")),
    )).alias("told")).select("run_id", "tool", "told.at", "told.clock")
    return told.withWatermark("clock", "0 seconds").groupBy("run_id", "tool").transformWithState(
        statefulProcessor=StallProcessor(silence), outputStructType=ALERTS, outputMode="Append", timeMode="EventTime")


def write_alerts(lines: DataFrame, folder: str, checkpoint: str, silence: int = 600, **trigger) -> StreamingQuery:
    """Append every change of an alert to a table as soon as its batch is done.

    A batch that is retried replaces its own folder, so a change is written exactly once.  The state is kept
    by RocksDB, which is set for this query alone.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    with rocks_state(lines.sparkSession):
        return stalled_alerts(lines, silence).writeStream.outputMode("append").foreachBatch(write).option(
            "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The alerts that stand, from all changes written so far: (run_id, tool, reason, started, last_line, alert_at)."""
    changes = spark.read.parquet(folder)
    newest = changes.groupBy("run_id", "tool").agg(F.max_by(F.struct("kind", "reason", "started_ms", "last_ms", "due_ms"), "version").alias("a"))
    return newest.where("a.kind <> 'withdrawn'").select(
        "run_id", "tool", "a.reason", *[F.timestamp_millis(f"a.{c}").alias(name) for c, name in (
            ("started_ms", "started"), ("last_ms", "last_line"), ("due_ms", "alert_at"))])
