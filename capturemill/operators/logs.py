"""Tool log lines: classification, run metrics, progress, host facts and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturemill.functions.log_rules import (
    FIELDS, RULES, Rule, block_bounds, block_message, is_spike, is_spurious, rule_match, rule_message,
)
from capturemill.operators.numbering import running_folds
from capturemill.session import checkpointed

# Seconds a step may take before it is stopped.
STEP_LIMITS = {
    "extract": 3600, "match": 3600, "map": 3600, "bundle": 600, "export": 300,
    "densify": 7200, "mesh": 1800, "refine": 7200, "texture": 1800,
}


def classify(
    lines: DataFrame, device: str = "[iGPU]", rules: dict[str, list[Rule]] | None = None
) -> DataFrame:
    """Add rule, fields and message to log lines; works on batch and streaming tables.

    A ``total_images`` column, where present, completes the messages that need it.
    """
    total = F.col("total_images").cast("long") if "total_images" in lines.columns else None
    matched = lines.withColumn("__match", rule_match(rules)).select(
        *lines.columns, *[F.col("__match")[name].alias(name) for name in ("rule", *FIELDS)]
    )
    return matched.withColumn("message", rule_message(total, device, rules))


def _classify_tools(lines: DataFrame, *tools: str) -> DataFrame:
    """Classified lines of a few tools; the expression then holds the rules of those tools only."""
    return classify(lines.where(F.col("tool").isin(*tools)), rules={t: RULES[t] for t in tools})


def _kept(classified: DataFrame, keys: list[str], entry: Column) -> DataFrame:
    """Keys and fields of the lines with an entry.

    A generator does the filtering: a plain filter on the rule would be pushed below the
    projection and evaluate every pattern twice.
    """
    return classified.select(*keys, F.explode(F.array_compact(F.array(entry))).alias("__e")).select(*keys, "__e.*")


def label_match_blocks(classified: DataFrame, images: DataFrame) -> DataFrame:
    """Rewrite block messages with the names of the first and last image of the block.

    ``images`` is (run_id, image_id, name), image ids counting from 1.
    """
    totals = images.groupBy("run_id").agg(F.count(F.lit(1)).alias("__images"))
    first, last = block_bounds(F.col("n1"), F.col("__images"))
    wanted = classified.where(F.col("rule") == "T4").join(totals, "run_id", "left").withColumns(
        {"__first": first, "__last": last}
    )
    for end in ("first", "last"):
        side = images.select("run_id", F.col("image_id").alias(f"__{end}"), F.col("name").alias(f"__{end}_name"))
        wanted = wanted.join(side, ["run_id", f"__{end}"], "left")
    named = block_message(
        F.col("n1"), F.col("n2"), F.col("__first"), F.col("__last"),
        *[F.coalesce(F.col(f"__{e}_name"), F.concat(F.lit("Image "), F.col(f"__{e}"))) for e in ("first", "last")],
    )
    labelled = wanted.withColumn("message", F.coalesce(named, "message")).select(*classified.columns)
    return classified.where(~F.col("rule").eqNullSafe("T4")).unionByName(labelled)


def counter_columns() -> dict[str, Column]:
    """Per-line counter inputs of a classified table; null where a line does not feed a counter."""
    def at(*rules: str) -> Column:
        return F.col("rule").isin(*rules)

    return {
        "features": F.when(at("T1"), F.col("n3")),
        "matches": F.when(at("T5"), F.col("n1")),
        "registered": F.when(at("T7"), F.col("n2")),
        "triangulated": F.when(at("T12"), F.col("n1")),
        "mean_error": F.when(at("T14"), F.col("value")),
        "depth_maps": F.when(at("T15"), F.lit(1).cast("long")),
        "dense_points": F.when(at("T16"), F.col("n2")).when(at("T17"), F.col("n1")),
        "mesh_vertices": F.when(at("T19"), F.col("n1")),
        "mesh_faces": F.when(at("T19"), F.col("n2")),
        "spurious_removed": F.when(at("T20") & is_spurious(F.col("line")), F.col("n1")),
        "spikes_removed": F.when(at("T20") & is_spike(F.col("line")), F.col("n1")),
        "holes_closed": F.when(at("T21"), F.col("n1")),
    }


LAST_COUNTERS = [
    "registered", "mean_error", "dense_points", "mesh_vertices", "mesh_faces",
    "spurious_removed", "spikes_removed", "holes_closed",
]


def counter_aggregates() -> list[Column]:
    """Order-free folds of the counters: count, sum, min, max, and latest by ``seq``."""
    c = counter_columns()

    def latest(name: str) -> Column:
        return F.max_by(c[name], F.when(c[name].isNotNull(), F.col("seq"))).alias(name)

    return [
        F.count(F.lit(1)).alias("lines"),
        F.count("rule").alias("matched_lines"),
        F.count(c["features"]).alias("feature_images"),
        F.sum(c["features"]).alias("feature_total"),
        F.min(c["features"]).alias("feature_min"),
        F.max(c["features"]).alias("feature_max"),
        F.count(c["matches"]).alias("match_pairs"),
        F.sum(c["matches"]).alias("match_total"),
        F.sum(c["triangulated"]).alias("triangulated_points"),
        F.sum(c["depth_maps"]).alias("depth_maps"),
        *[latest(name) for name in LAST_COUNTERS],
    ]


def run_metrics(lines: DataFrame) -> DataFrame:
    """One row of counters per run and tool, from raw log lines."""
    return classify(lines).groupBy("run_id", "tool").agg(*counter_aggregates())


def run_metric_lists(lines: DataFrame) -> DataFrame:
    """The values behind the appended counters, one row each in place of unbounded lists."""
    entry = F.when(F.col("rule") == "T1", F.struct(F.lit("features").alias("counter"), F.col("n3").alias("count"))).when(
        F.col("rule") == "T5", F.struct(F.lit("matches").alias("counter"), F.col("n1").alias("count"))
    )
    return _kept(_classify_tools(lines, "extract", "match"), ["run_id", "tool", "seq"], entry)


def registration_progress(lines: DataFrame) -> DataFrame:
    """Cameras registered so far and running triangulated points, at each mapper line that moves them."""
    entry = F.when(F.col("rule").isin("T7", "T12"), F.struct("rule", "n1", "n2"))
    moved = checkpointed(_kept(_classify_tools(lines, "map"), ["run_id", "seq"], entry))
    count = F.when(F.col("rule") == "T7", F.struct(F.col("seq").alias("at"), F.col("n2").alias("registered")))
    points = F.when(F.col("rule") == "T12", F.col("n1"))
    folded = running_folds(moved, ["run_id"], "seq", {"__last": ("max", count), "points": ("sum", points)})
    return folded.select(
        "run_id", "seq",
        F.coalesce(F.col("__last.registered"), F.lit(0)).alias("registered"),
        F.coalesce("points", F.lit(0)).alias("triangulated_points"),
    )


# --- line headers, host facts, memory block ------------------------------------------------------

HEADER = r"^(\d{2}):(\d{2}):(\d{2}) \[([^\]]*?)\s*\]\s?(.*)$"


def with_header(lines: DataFrame) -> DataFrame:
    """Split ``HH:MM:SS [App     ] text``: clock seconds, app and body (null where absent)."""
    line = F.col("line")
    has = line.rlike(HEADER)

    def part(n: int) -> Column:
        return F.when(has, F.regexp_extract(line, HEADER, n))

    seconds = part(1).cast("long") * 3600 + part(2).cast("long") * 60 + part(3).cast("long")
    return lines.withColumns({
        "clock_seconds": seconds, "app": part(4), "body": F.trim(F.regexp_replace(part(5), r"^\s+", "")),
    })


def host_facts(lines: DataFrame) -> DataFrame:
    """CPU, cores, RAM and disk of the host of each run, from its log header."""
    body = F.col("body")

    def fact(prefix: str, pattern: str, kind: str) -> Column:
        found = F.when(body.startswith(prefix), F.nullif(F.regexp_extract(body, pattern, 1), F.lit("")).try_cast(kind))
        return F.max_by(found, F.when(found.isNotNull(), F.col("seq")))

    return with_header(lines).groupBy("run_id").agg(
        fact("CPU:", r"^CPU: (.*?)(?: \(\d+ cores\))?$", "string").alias("cpu"),
        fact("CPU:", r"\((\d+) cores\)", "long").alias("cores"),
        fact("RAM:", r"^RAM: ([\d.]+)GB", "double").alias("ram_gb"),
        fact("OS:", r"^OS: (.*)$", "string").alias("os"),
        fact("Disk:", r"^Disk: ([\d.]+)GB", "double").alias("disk_free_gb"),
        fact("Disk:", r"\(([\d.]+)GB\)", "double").alias("disk_total_gb"),
    )


def memory_info(lines: DataFrame) -> DataFrame:
    """Entries of the memory block of each run: key, value, unit (null for plain counts)."""
    entry = r"^(\w+) ([\d.]+)(KB|MB|GB)?$"
    headed = with_header(lines)
    body = F.col("body")
    spans = headed.groupBy("run_id").agg(
        F.max(F.when(body.startswith("MEMORYINFO:"), F.col("seq"))).alias("__open"),
        F.max(F.when(F.contains(body, F.lit("ENDINFO")), F.col("seq"))).alias("__close"),
    ).where(F.col("__open").isNotNull())
    inside = (F.col("seq") > F.col("__open")) & (F.col("seq") < F.coalesce("__close", F.lit(2**62)))
    return headed.where(body.rlike(entry)).join(spans, "run_id").where(inside).select(
        "run_id", "seq",
        F.regexp_extract(body, entry, 1).alias("key"),
        F.regexp_extract(body, entry, 2).try_cast("double").alias("value"),
        F.nullif(F.regexp_extract(body, entry, 3), F.lit("")).alias("unit"),
    )


def start_from_file_name(file: Column) -> Column:
    """Start time stamped into a log file name as ``-yymmddHHMMSS``."""
    stamp = F.regexp_extract(F.substring_index(file, "/", -1), r"-(\d{12})", 1)
    return F.try_to_timestamp(F.concat(F.lit("20"), F.nullif(stamp, F.lit(""))), F.lit("yyyyMMddHHmmss"))


def log_times(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Full times for lines that only tell the time of day.

    ``starts`` is (run_id, tool, started).  A day is added whenever the clock goes
    back, counting from the start time; lines without a clock take the time of the
    line before.  Adds ``elapsed_seconds`` and ``line_time``.
    """
    group = ["run_id", "tool"]
    clock = F.struct(F.col("seq").alias("at"), F.col("clock_seconds").alias("clock"))
    # the line texts stay out of the folds; narrow rows are written between them
    headed = checkpointed(with_header(lines).select(*group, "seq", "clock_seconds"))
    known = F.when(F.col("clock_seconds").isNotNull(), clock)
    earlier = running_folds(headed, group, "seq", {"__before": ("max", known)}, exclusive=True)
    begin = F.hour("started") * 3600 + F.minute("started") * 60 + F.second("started")
    joined = earlier.join(starts.select(*group, "started"), group)
    previous = F.coalesce(F.col("__before.clock"), begin)
    steps = checkpointed(joined.select(
        *group, "seq", "started",
        F.when(F.col("clock_seconds").isNull(), 0)
        .otherwise(F.col("clock_seconds") - previous
                   + F.when(F.col("clock_seconds") < previous, 86400).otherwise(0)).cast("long").alias("__step"),
    ))
    return running_folds(steps, group, "seq", {"elapsed_seconds": ("sum", F.col("__step"))}).select(
        *group, "seq", "elapsed_seconds",
        (F.col("started") + F.make_dt_interval(secs=F.col("elapsed_seconds"))).alias("line_time"),
    )


def step_limits(spark) -> DataFrame:
    """The fixed nine-row table of step limits."""
    return spark.createDataFrame(list(STEP_LIMITS.items()), "tool string, limit_seconds bigint")


def step_durations(timed: DataFrame) -> DataFrame:
    """Elapsed time of each run and tool against the step limit."""
    spans = timed.groupBy("run_id", "tool").agg(F.max("elapsed_seconds").alias("elapsed_seconds"))
    limits = F.broadcast(step_limits(timed.sparkSession))
    return spans.join(limits, "tool", "left").select(
        "run_id", "tool", "elapsed_seconds", "limit_seconds",
        (F.col("elapsed_seconds") > F.col("limit_seconds")).alias("over_budget"),
    )
