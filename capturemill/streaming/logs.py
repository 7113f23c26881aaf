"""Live tool logs: classification, counters and stalled runs on Structured Streaming.

A shipper lands small closed segments of lines (run_id, tool, seq, ts, line); ``seq``
and ``ts`` are set where the line is written.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from capturemill.operators.logs import STEP_LIMITS, classify
from capturemill.schemas import LOG_LINES
from capturemill.streaming.counters import counted_runs
from capturemill.streaming.state import rocks_state


def stream_log_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Log segments (JSON lines) as a stream; lines are trimmed and empty ones dropped."""
    lines = spark.readStream.schema(LOG_LINES).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return trimmed(lines)


def stream_kafka_lines(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same lines from a Kafka topic of JSON values (needs the Kafka package on the cluster)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    value = F.from_json(F.col("value").cast("string"), LOG_LINES)
    return trimmed(raw.select(value.alias("v")).select("v.*"))


def trimmed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where(F.col("line") != "")


def stream_classify(lines: DataFrame) -> DataFrame:
    """Rules and messages on a stream; the rules are stateless, so this is the batch code."""
    return classify(lines)


def stream_run_metrics(lines: DataFrame, keep_seconds: int | None = None) -> DataFrame:
    """Counters per run and tool, kept up to date as lines arrive (update mode).

    Lines delivered twice count once, and lines of any age count, so the last row written for a run equals the
    batch result whatever the order of arrival.  The state keeps intervals of line numbers, one for a run that has told all
    its lines; with ``keep_seconds`` it is let go so long after a run's last line.
    """
    return counted_runs(lines, keep_seconds)


# Batches of updates after which the newest rows are gathered anew.
FOLD_BATCHES = 20


def write_updates(stream: DataFrame, folder: str, checkpoint: str, keys: list[str] | None = None, fold: int = FOLD_BATCHES, **trigger) -> StreamingQuery:
    """Append every update to a table with its batch number; :func:`latest_updates` reads the last ones.

    A batch that is retried replaces its own folder, so updates are written exactly once.  With ``keys`` the newest rows of all
    keys are gathered once in ``fold`` batches, so that readers open one such table and the batches after it.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if keys and number % fold == fold - 1:
            spark, before = batch.sparkSession, number - fold
            rows = spark.read.parquet(folder).where(F.col("batch").between(before + 1, number))
            if before >= 0:
                rows = rows.unionByName(spark.read.parquet(f"{folder}-folded/upto={before}"))
            _newest(rows, keys).write.mode("overwrite").parquet(f"{folder}-folded/upto={number}")

    with rocks_state(stream.sparkSession):
        return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
            **(trigger or {"availableNow": True})).start()


def latest_updates(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The newest row of each key among the written updates."""
    updates = spark.read.parquet(folder)
    # a fold is complete once a batch after it has begun
    folded = _folds(spark, folder)
    done = [n for n in folded if n < max(_numbers(updates, "batch"))]
    if done:
        updates = updates.where(F.col("batch") > max(done)).unionByName(spark.read.parquet(f"{folder}-folded/upto={max(done)}"))
    return _newest(updates, keys).drop("batch")


def _folds(spark: SparkSession, folder: str) -> list[int]:
    try:
        return _numbers(spark.read.parquet(f"{folder}-folded"), "upto")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _numbers(table: DataFrame, name: str) -> list[int]:
    """Partition numbers of a written table, by the paths of its files."""
    return sorted({int(n) for path in table.inputFiles() for n in re.findall(rf"/{name}=(\d+)/", path)})


def _newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in updates.columns if c not in keys]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


# --- stalled runs --------------------------------------------------------------------------------


def step_limit(tool: Column) -> Column:
    """Seconds a step may take, by tool; null for an unknown tool."""
    limits = F.create_map(*[F.lit(v) for pair in STEP_LIMITS.items() for v in pair])
    return limits[tool]


def write_slots(lines: DataFrame, folder: str, checkpoint: str, slot: str = "1 minute", **trigger) -> StreamingQuery:
    """Fold every batch of lines into time slots of its runs and append those to a table.

    No state is kept and no line is too late: slots of one run and time add up when they are read.  A batch
    that is retried replaces its own folder.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("run_id", "tool", F.window("ts", slot).alias("w")).agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
        ).select("run_id", "tool", F.col("w.start").alias("slot"), "first_ts", "last_ts").write.mode("overwrite").parquet(
            f"{folder}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def stalled_runs(slots: DataFrame, silence: int = 600, now: dt.datetime | None = None) -> DataFrame:
    """One alert per run and tool that outlives its step limit or stays silent for ``silence`` seconds.

    ``slots`` is what :func:`write_slots` has written so far; ``silence`` has to be longer than a slot.  The clock
    stands at ``now``, or at the last line of any run.  The alerts depend on the lines only, never on the order
    in which they came, and a run that never speaks again is found as soon as the clock has passed its deadline.
    A run has one row per slot it spoke in, which is what the window over it sees.
    """
    seen = slots.groupBy("run_id", "tool", "slot").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    if now is None:
        now = seen.agg(F.max("last_ts")).first()[0]
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    line = Window.partitionBy("run_id", "tool").orderBy("slot")
    run = Window.partitionBy("run_id", "tool")
    timed = seen.select("run_id", "tool", "slot", millis("first_ts").alias("first"), millis("last_ts").alias("last")).withColumns({
        "limit": (F.coalesce(step_limit(F.col("tool")), F.lit(10**9)) * 1000).cast("bigint"),
        "started": F.min("first").over(run),
        "next": F.coalesce(F.lead("first").over(line), F.unix_millis(F.lit(now).cast("timestamp"))),
    }).withColumn("due", F.least(F.col("started") + F.col("limit"), F.col("last") + silence * 1000))
    late = timed.where((F.col("next") > F.col("due")) | (F.col("last") > F.col("started") + F.col("limit")))
    first = late.groupBy("run_id", "tool").agg(F.min_by(F.struct("started", "last", "due", "limit"), "slot").alias("a"))
    return first.select(
        "run_id", "tool", F.when(F.col("a.due") == F.col("a.started") + F.col("a.limit"), "over_limit").otherwise("silent").alias("reason"),
        *[F.timestamp_millis(f"a.{c}").alias(name) for c, name in (("started", "started"), ("last", "last_line"), ("due", "alert_at"))],
    )
