"""Queries that run the log table as a stream until it is used up."""

import uuid

from pyspark.sql import functions as F

from capturemill.plans.catalog import query
from capturemill.plans.log_queries import CLASSIFIED, MESSAGE, METRICS
from capturemill.session import shared_folder
from capturemill.streaming import alerts, logs


def _lines(lens):
    return lens.stream("log_lines").withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4()}"


def _appended(spark, stream):
    """Run a stream to its end into a parquet folder and read that."""
    folder = _folder(spark)
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/state"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_classify", "log_lines", sql=f"""
    WITH {CLASSIFIED} SELECT run_id, seq, tool, rule, n1, n2, n3, n4, value, text, {MESSAGE} FROM classified""")
def stream_classify(spark, lens):
    found = logs.stream_classify(logs.trimmed(_lines(lens)))
    return _appended(spark, found.select(
        "run_id", "seq", "tool", "rule", "n1", "n2", "n3", "n4", "value", "text", "message"
    ))


@query("stream_run_metrics", "log_lines", sql=f"WITH {CLASSIFIED}, {METRICS} SELECT * FROM metrics")
def stream_run_metrics(spark, lens):
    folder = _folder(spark)
    logs.write_updates(
        logs.stream_run_metrics(_lines(lens)), f"{folder}/out", f"{folder}/state", ["run_id", "tool"]
    ).awaitTermination()
    return logs.latest_updates(spark, f"{folder}/out", ["run_id", "tool"])


# The clock stands at the last line of any run.
STALLED = """
    slots AS (SELECT run_id, tool, time_bucket(INTERVAL '1 minute', ts) AS slot, epoch_us(min(ts)) // 1000 AS f, epoch_us(max(ts)) // 1000 AS l,
        1000 * CASE tool WHEN 'densify' THEN 7200 WHEN 'mesh' THEN 1800 ELSE 3600 END AS lim
      FROM log_lines GROUP BY 1, 2, 3),
    seen AS (SELECT *, min(f) OVER (PARTITION BY run_id, tool) AS started,
        coalesce(lead(f) OVER (PARTITION BY run_id, tool ORDER BY slot), (SELECT max(l) FROM slots)) AS next FROM slots),
    due AS (SELECT *, least(started + lim, l + 3600000) AS due FROM seen),
    alerts AS (SELECT *, row_number() OVER (PARTITION BY run_id, tool ORDER BY slot) AS k FROM due
      WHERE next > due OR l > started + lim)"""


@query("stalled_runs", "log_lines", sql=f"""
    WITH {STALLED}
    SELECT run_id, tool, CASE WHEN due = started + lim THEN 'over_limit' ELSE 'silent' END AS reason,
      started AS started_ms, l AS last_ms, due AS alert_ms FROM alerts WHERE k = 1""")
def stalled_runs(spark, lens):
    folder = _folder(spark)
    logs.write_slots(_lines(lens), f"{folder}/out", f"{folder}/state").awaitTermination()
    return logs.stalled_runs(spark.read.parquet(f"{folder}/out"), silence=3600).select(
        "run_id", "tool", "reason", F.unix_millis("started").alias("started_ms"),
        F.unix_millis("last_line").alias("last_ms"), F.unix_millis("alert_at").alias("alert_ms"),
    )


@query("live_alerts", "log_lines", sql=f"""
    WITH {STALLED}
    SELECT run_id, tool, CASE WHEN due = started + lim THEN 'over_limit' ELSE 'silent' END AS reason,
      started AS started_ms, l AS last_ms, due AS alert_ms FROM alerts WHERE k = 1""")
def live_alerts(spark, lens):
    """The alerts that stand after the stream has written every change of them."""
    folder = _folder(spark)
    alerts.write_alerts(_lines(lens), f"{folder}/out", f"{folder}/state", silence=3600).awaitTermination()
    return alerts.current_alerts(spark, f"{folder}/out").select(
        "run_id", "tool", "reason", F.unix_millis("started").alias("started_ms"),
        F.unix_millis("last_line").alias("last_ms"), F.unix_millis("alert_at").alias("alert_ms"),
    )


@query("stream_log_lines", "log_lines", sql="SELECT run_id, tool, seq, date_trunc('milliseconds', ts) AS ts, line FROM log_lines")
def stream_log_lines(spark, lens):
    """Lines written as JSON segments, some with blanks around them and some blank, read as a stream."""
    folder = _folder(spark)
    lines = lens("log_lines").select("run_id", "tool", "seq", F.col("ts").cast("timestamp").alias("ts"), "line")
    blank = lines.where("seq % 3 = 0").withColumn("line", F.lit(" \t "))
    wide = lines.withColumn("line", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("  "), "line", F.lit("\t"))).otherwise(F.col("line")))
    wide.unionByName(blank).repartition(4, "run_id").write.json(f"{folder}/in")
    return _appended(spark, logs.stream_log_lines(spark, f"{folder}/in")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
