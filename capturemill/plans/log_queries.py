"""Queries over tool logs."""

from pyspark.sql import functions as F

from capturemill.functions.columns import long_div
from capturemill.operators import logs, summaries
from capturemill.operators.numbering import numbered
from capturemill.plans.catalog import query


def _num(pattern: str, n: int = 1) -> str:
    return f"TRY_CAST(nullif(regexp_extract(line, '{pattern}', {n}), '') AS BIGINT)"


# The rules in their order, first match wins inside a tool.
CLASSIFIED = rf"""
    ruled AS (SELECT *, CASE tool
        WHEN 'extract' THEN CASE WHEN regexp_matches(line, 'Processed file \[(\d+)/(\d+)\]')
                                  AND regexp_matches(line, 'num_features=(\d+)') THEN 'T1'
                                 WHEN contains(line, 'Elapsed time:') THEN 'T2' END
        WHEN 'match' THEN CASE WHEN regexp_matches(line, 'Matching block \[(\d+)/(\d+),\s*(\d+)/(\d+)\]') THEN 'T3'
                               WHEN regexp_matches(line, 'Matching block \[(\d+)/(\d+)\]') THEN 'T4'
                               WHEN regexp_matches(line, '(\d+) matches for image pair') THEN 'T5'
                               WHEN contains(lower(line), 'geometrically verified') THEN 'T6' END
        WHEN 'map' THEN CASE WHEN regexp_matches(line, 'Registering image #(\d+) \((\d+)\)') THEN 'T7'
                             WHEN regexp_matches(line, 'Image has (\d+)\s*/\s*(\d+) inliers') THEN 'T8'
                             WHEN contains(line, 'Bundle adjustment') THEN 'T9'
                             WHEN regexp_matches(line, 'Merged observations: (\d+)') THEN 'T10'
                             WHEN regexp_matches(line, 'Completed observations: (\d+)') THEN 'T11'
                             WHEN regexp_matches(line, 'Triangulated (\d+) points') THEN 'T12'
                             WHEN regexp_matches(line, 'Filtered observations: (\d+)') THEN 'T13'
                             WHEN regexp_matches(line, 'Mean reprojection error: ([\d.]+)px') THEN 'T14' END
        WHEN 'densify' THEN CASE WHEN regexp_matches(line, 'Depth-map for image\s+(\d+) estimated') THEN 'T15'
                                 WHEN regexp_matches(line, 'Depth-maps dense fused.*?(\d+) depth-maps.*?(\d+) points') THEN 'T16'
                                 WHEN regexp_matches(line, '[Dd]ensif(?:y|ying).*?completed.*?(\d+) points') THEN 'T17'
                                 WHEN regexp_matches(line, 'Point-cloud trimmed.*?(\d+) points removed') THEN 'T18' END
        WHEN 'mesh' THEN CASE WHEN regexp_matches(line, '(\d+) vertices, (\d+) faces') THEN 'T19'
                              WHEN regexp_matches(line, '[Rr]emoved? (\d+)') THEN 'T20'
                              WHEN regexp_matches(line, '[Cc]losed? (\d+) holes') THEN 'T21' END
      END AS rule FROM log_lines),
    classified AS (SELECT *,
        CASE rule WHEN 'T1' THEN {_num(r'Processed file \[(\d+)/')} WHEN 'T3' THEN {_num(r'block \[(\d+)/')}
          WHEN 'T4' THEN {_num(r'block \[(\d+)/')} WHEN 'T5' THEN {_num(r'(\d+) matches')} WHEN 'T7' THEN {_num(r'image #(\d+)')}
          WHEN 'T8' THEN {_num(r'has (\d+)')} WHEN 'T10' THEN {_num(r'observations: (\d+)')}
          WHEN 'T11' THEN {_num(r'observations: (\d+)')} WHEN 'T13' THEN {_num(r'observations: (\d+)')}
          WHEN 'T12' THEN {_num(r'Triangulated (\d+)')} WHEN 'T15' THEN {_num(r'image\s+(\d+)')}
          WHEN 'T16' THEN {_num(r'(\d+) depth-maps')} WHEN 'T17' THEN {_num(r'(\d+) points')}
          WHEN 'T18' THEN {_num(r'(\d+) points removed')} WHEN 'T19' THEN {_num(r'(\d+) vertices')}
          WHEN 'T20' THEN {_num(r'[Rr]emoved? (\d+)')} WHEN 'T21' THEN {_num(r'[Cc]losed? (\d+)')} END AS n1,
        CASE rule WHEN 'T1' THEN {_num(r'\[\d+/(\d+)\]')} WHEN 'T3' THEN {_num(r'block \[\d+/(\d+)')}
          WHEN 'T4' THEN {_num(r'block \[\d+/(\d+)')} WHEN 'T8' THEN {_num(r'/\s*(\d+) inliers')}
          WHEN 'T7' THEN {_num(r'\((\d+)\)')} WHEN 'T15' THEN {_num(r'using\s+(\d+)')}
          WHEN 'T16' THEN {_num(r'depth-maps.*?(\d+) points')} WHEN 'T19' THEN {_num(r'(\d+) faces')} END AS n2,
        CASE rule WHEN 'T1' THEN {_num(r'num_features=(\d+)')} WHEN 'T3' THEN {_num(r',\s*(\d+)/')}
          WHEN 'T15' THEN {_num(r'images:\s*(\d+)x')} END AS n3,
        CASE rule WHEN 'T3' THEN {_num(r',\s*\d+/(\d+)')} WHEN 'T15' THEN {_num(r'x(\d+)')} END AS n4,
        CASE WHEN rule = 'T14' THEN TRY_CAST(regexp_extract(line, 'error: ([\d.]+)px', 1) AS DOUBLE) END AS value,
        CASE WHEN rule = 'T1' THEN nullif(regexp_extract(line, 'name=(\S+)', 1), '') END AS text
      FROM ruled)"""

MESSAGE = """
    CASE rule
      WHEN 'T1' THEN '[iGPU] ' || text || ': ' || format('{:,}', n3) || ' features (' || n1 || '/' || n2 || ')'
      WHEN 'T2' THEN '  ⏱ ' || line
      WHEN 'T3' THEN 'Processing match block [' || n1 || '/' || n2 || ', ' || n3 || '/' || n4 || ']...'
      WHEN 'T4' THEN 'Processing match block ' || n1 || '/' || n2 || ' (Images: Image ' || (n1 * 50 - 49) || ' to Image ' || n1 * 50 || ')'
      WHEN 'T6' THEN '  ✓ ' || line
      WHEN 'T7' THEN 'Adding camera ' || n1 || ' (' || n2 || ' of ?)'
      WHEN 'T8' THEN '  → ' || n1 || ' of ' || n2 || ' feature matches used'
      WHEN 'T9' THEN '  Adjusting...'
      WHEN 'T10' THEN '  → Merged ' || n1 || ' track observations'
      WHEN 'T11' THEN '  → Completed ' || n1 || ' observations'
      WHEN 'T12' THEN '  → Triangulated ' || format('{:,}', n1) || ' new 3D points'
      WHEN 'T13' THEN '  → Filtered ' || n1 || ' outlier observations'
      WHEN 'T14' THEN '  → Mean reprojection error: ' || format('{:.3f}', value) || 'px (' ||
        CASE WHEN value < 1 THEN '✓ good' WHEN value < 2 THEN '⚠ high' ELSE '✗ poor' END || ')'
      WHEN 'T15' THEN '[CPU] Estimating depth map for image ' || n1 || ' (' || n3 || '×' || n4 || ', ' || n2 || ' views)'
      WHEN 'T16' THEN '  → Fused ' || n1 || ' depth maps → ' || format('{:,}', n2) || ' candidate points'
      WHEN 'T17' THEN '  → Dense cloud: ' || format('{:,}', n1) || ' points'
      WHEN 'T18' THEN '  → Trimmed ' || format('{:,}', n1) || ' points outside ROI'
      WHEN 'T19' THEN '  → Mesh: ' || format('{:,}', n1) || ' vertices, ' || format('{:,}', n2) || ' faces'
      WHEN 'T20' THEN '  → Cleaned ' || n1 || CASE WHEN contains(lower(line), 'spurious') THEN ' spurious components'
        WHEN contains(lower(line), 'spike') THEN ' spikes' ELSE ' artifacts' END
      WHEN 'T21' THEN '  → Closed ' || n1 || ' holes'
      ELSE line END AS message"""


def _last(value: str, where: str) -> str:
    return f"max_by({value}, seq) FILTER (WHERE {where} AND {value} IS NOT NULL)"


METRICS = f"""
    metrics AS (SELECT run_id, tool, count(*) AS lines, count(rule) AS matched_lines,
      count(n3) FILTER (WHERE rule = 'T1') AS feature_images,
      CAST(sum(n3) FILTER (WHERE rule = 'T1') AS BIGINT) AS feature_total,
      min(n3) FILTER (WHERE rule = 'T1') AS feature_min, max(n3) FILTER (WHERE rule = 'T1') AS feature_max,
      count(n1) FILTER (WHERE rule = 'T5') AS match_pairs,
      CAST(sum(n1) FILTER (WHERE rule = 'T5') AS BIGINT) AS match_total,
      CAST(sum(n1) FILTER (WHERE rule = 'T12') AS BIGINT) AS triangulated_points,
      CAST(nullif(count(*) FILTER (WHERE rule = 'T15'), 0) AS BIGINT) AS depth_maps,
      {_last("n2", "rule = 'T7'")} AS registered, {_last("value", "rule = 'T14'")} AS mean_error,
      {_last("(CASE rule WHEN 'T16' THEN n2 WHEN 'T17' THEN n1 END)", "true")} AS dense_points, {_last("n1", "rule = 'T19'")} AS mesh_vertices,
      {_last("n2", "rule = 'T19'")} AS mesh_faces,
      {_last("n1", "rule = 'T20' AND contains(lower(line), 'spurious')")} AS spurious_removed,
      {_last("n1", "rule = 'T20' AND contains(lower(line), 'spike') AND NOT contains(lower(line), 'spurious')")}
        AS spikes_removed,
      {_last("n1", "rule = 'T21'")} AS holes_closed
      FROM classified GROUP BY 1, 2)"""


@query("classify", "log_lines", sql=f"""
    WITH {CLASSIFIED} SELECT run_id, seq, tool, rule, n1, n2, n3, n4, value, text, {MESSAGE} FROM classified""")
def classify(spark, lens):
    return logs.classify(lens("log_lines")).select(
        "run_id", "seq", "tool", "rule", "n1", "n2", "n3", "n4", "value", "text", "message"
    )


@query("run_metrics", "log_lines", sql=f"WITH {CLASSIFIED}, {METRICS} SELECT * FROM metrics")
def run_metrics(spark, lens):
    return logs.run_metrics(lens("log_lines"))


@query("run_metric_lists", "log_lines", sql=f"""
    WITH {CLASSIFIED} SELECT run_id, tool, seq, CASE rule WHEN 'T1' THEN 'features' ELSE 'matches' END AS counter,
      CASE rule WHEN 'T1' THEN n3 ELSE n1 END AS count FROM classified WHERE rule IN ('T1', 'T5')""")
def run_metric_lists(spark, lens):
    return logs.run_metric_lists(lens("log_lines"))


@query("dense_summary", "log_lines", sql=f"""
    WITH {CLASSIFIED}, {METRICS}
    SELECT *, dense_points // greatest(registered, 1) AS points_per_camera FROM (
      SELECT run_id, CAST(coalesce(sum(depth_maps), 0) AS BIGINT) AS depth_maps,
        coalesce(max(dense_points), 0) AS dense_points, coalesce(max(registered), 0) AS registered
      FROM metrics GROUP BY 1) d""")
def dense_summary(spark, lens):
    return summaries.dense_summary(logs.run_metrics(lens("log_lines")))


@query("mesh_summary", "log_lines", sql=f"""
    WITH {CLASSIFIED}, {METRICS}
    SELECT run_id, coalesce(mesh_vertices, 0) AS mesh_vertices, coalesce(mesh_faces, 0) AS mesh_faces,
      coalesce(spurious_removed, 0) AS spurious_removed, coalesce(spikes_removed, 0) AS spikes_removed,
      coalesce(holes_closed, 0) AS holes_closed FROM metrics WHERE tool = 'mesh'""")
def mesh_summary(spark, lens):
    return summaries.mesh_summary(logs.run_metrics(lens("log_lines")))


# Analyzer output told by mapper lines: the same text keys, read per capture.
ANALYZER = """
    told AS (SELECT run_id % 7 AS capture_id, seq,
      CASE seq % 3 WHEN 0 THEN 'Images: ' || seq % 40 WHEN 1 THEN 'Points: ' || seq ELSE line END AS line
      FROM log_lines WHERE tool = 'map')"""


@query("analyzer_stats", "log_lines", sql=rf"""
    WITH {ANALYZER}
    SELECT capture_id, max_by(seq % 40, seq) FILTER (WHERE seq % 3 = 0) AS images,
      max_by(seq, seq) FILTER (WHERE seq % 3 = 1) AS points,
      max_by(TRY_CAST(regexp_extract(line, 'error: ([\d.]+)px', 1) AS DOUBLE), seq)
        FILTER (WHERE seq % 3 = 2 AND regexp_matches(line, 'Mean reprojection error:')) AS mean_error
    FROM told GROUP BY 1""")
def analyzer_stats(spark, lens):
    seq = F.col("seq")
    told = lens("log_lines").where("tool = 'map'").select(
        (F.col("run_id") % 7).alias("capture_id"), "seq",
        F.when(seq % 3 == 0, F.concat(F.lit("Images: "), seq % 40))
        .when(seq % 3 == 1, F.concat(F.lit("Points: "), seq)).otherwise(F.col("line")).alias("line"),
    )
    return summaries.analyzer_stats(told)


@query("registration_progress", "log_lines", sql=f"""
    WITH {CLASSIFIED}
    SELECT run_id, seq, coalesce(last_value(CASE rule WHEN 'T7' THEN n2 END IGNORE NULLS) OVER w, 0) AS registered,
      CAST(coalesce(sum(CASE rule WHEN 'T12' THEN n1 END) OVER w, 0) AS BIGINT) AS triangulated_points
    FROM classified WHERE rule IN ('T7', 'T12')
    WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def registration_progress(spark, lens):
    return logs.registration_progress(lens("log_lines"))


TIMED = """
    clocked AS (SELECT run_id, tool, seq, line, 3600 * CAST(line[1:2] AS BIGINT) + 60 * CAST(line[4:5] AS BIGINT)
                  + CAST(line[7:8] AS BIGINT) AS clock FROM clock_lines),
    stepped AS (SELECT c.*, s.started,
        coalesce(lag(clock) OVER (PARTITION BY c.run_id, c.tool ORDER BY seq),
                 3600 * hour(started) + 60 * minute(started) + second(started)) AS before
      FROM clocked c JOIN clock_starts s ON s.run_id = c.run_id AND s.tool = c.tool),
    timed AS (SELECT run_id, tool, seq, line, CAST(sum(clock - before + CASE WHEN clock < before THEN 86400 ELSE 0 END)
        OVER (PARTITION BY run_id, tool ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
        AS elapsed_seconds FROM stepped)"""


def _timed(lens):
    return logs.log_times(lens("clock_lines"), lens("clock_starts"))


@query("log_times", "clock_lines", "clock_starts", sql=f"""
    WITH {TIMED}
    SELECT t.run_id, t.tool, t.seq, t.line, elapsed_seconds, epoch_us(date_trunc('second', started)) // 1000000 + elapsed_seconds AS line_second
    FROM timed t JOIN clock_starts s ON s.run_id = t.run_id AND s.tool = t.tool""")
def log_times(spark, lens):
    lines = lens("clock_lines").select("run_id", "tool", "seq", "line")
    timed = _timed(lens).withColumn("line_second", F.floor(F.unix_millis(F.col("line_time").cast("timestamp")) / 1000))
    return timed.drop("line_time").join(lines, ["run_id", "tool", "seq"])


@query("file_starts", "clock_starts", sql="""
    SELECT run_id, tool, epoch_us(date_trunc('second', started)) // 1000000 AS second FROM clock_starts""")
def file_starts(spark, lens):
    """Start times as tools write them into the names of their log files, read back."""
    stamp = F.date_format(F.col("started").cast("timestamp"), "yyMMddHHmmss")
    named = lens("clock_starts").select("run_id", "tool", F.concat(F.lit("/logs/DensifyPointCloud-"), stamp, F.lit("303003E29.log")).alias("name"))
    return named.select("run_id", "tool", F.unix_seconds(logs.start_from_file_name(F.col("name")).cast("timestamp")).alias("second"))


@query("step_durations", "clock_lines", "clock_starts", sql=f"""
    WITH {TIMED}
    SELECT *, elapsed_seconds > limit_seconds AS over_budget FROM (
      SELECT run_id, tool, max(elapsed_seconds) AS elapsed_seconds,
        CAST(CASE tool WHEN 'densify' THEN 7200 WHEN 'mesh' THEN 1800 ELSE 3600 END AS BIGINT) AS limit_seconds
      FROM timed GROUP BY 1, 2) d""")
def step_durations(spark, lens):
    return logs.step_durations(_timed(lens))


# --- host facts and block names ------------------------------------------------------------------

# One header block per supplier, which stands for a run.
def _header(lens):
    n, key = F.col("nation"), F.col("run_id")
    texts = F.array(
        F.concat(F.lit("CPU: Model "), n, F.lit(" @ 2GHz ("), key % 16 + 1, F.lit(" cores)")),
        F.concat(F.lit("RAM: "), key % 64, F.lit(".5GB Physical Memory")),
        F.concat(F.lit("OS: System "), n),
        F.concat(F.lit("Disk: "), key % 900, F.lit(".25GB (999.5GB) space")),
        F.lit("MEMORYINFO: {"),
        F.concat(F.lit("PageFaultCount "), key),
        F.concat(F.lit("PeakWorkingSetSize "), key % 50, F.lit(".75MB")),
        F.lit("} ENDINFO"),
    )
    hosts = lens("supplier_nations")
    return hosts.select("run_id", F.posexplode(texts).alias("k", "text")).select(
        "run_id", (F.col("k") + 1).cast("long").alias("seq"), F.concat(F.lit("07:05:01 [App     ] "), "text").alias("line")
    )


@query("host_facts", "supplier_nations", sql="""
    SELECT run_id, 'Model ' || nation || ' @ 2GHz' AS cpu, run_id % 16 + 1 AS cores, run_id % 64 + 0.5::DOUBLE AS ram_gb,
      'System ' || nation AS os, run_id % 900 + 0.25::DOUBLE AS disk_free_gb, 999.5::DOUBLE AS disk_total_gb
    FROM supplier_nations""")
def host_facts(spark, lens):
    return logs.host_facts(_header(lens))


@query("memory_info", "supplier_nations", sql="""
    SELECT run_id, CAST(6 AS BIGINT) AS seq, 'PageFaultCount' AS key, CAST(run_id AS DOUBLE) AS value, NULL AS unit
    FROM supplier_nations UNION ALL
    SELECT run_id, 7, 'PeakWorkingSetSize', run_id % 50 + 0.75::DOUBLE, 'MB' FROM supplier_nations""")
def memory_info(spark, lens):
    return logs.memory_info(_header(lens))


@query("label_match_blocks", "images", sql="""
    WITH placed AS (SELECT capture_id AS run_id, row_number() OVER (PARTITION BY capture_id ORDER BY image_id) AS p,
        count(*) OVER (PARTITION BY capture_id) AS n, name FROM images),
    blocks AS (SELECT DISTINCT run_id, (p - 1) // 50 + 1 AS b, (n - 1) // 50 + 1 AS bs, n FROM placed)
    SELECT k.run_id, k.b AS seq, 'Processing match block ' || b || '/' || bs || CASE WHEN (b - 1) * 50 + 1 = least(b * 50, k.n)
        THEN ' (Image: ' || f.name || ')' ELSE ' (Images: ' || f.name || ' to ' || l.name || ')' END AS message
    FROM blocks k JOIN placed f ON f.run_id = k.run_id AND f.p = (b - 1) * 50 + 1
    JOIN placed l ON l.run_id = k.run_id AND l.p = least(b * 50, k.n)""")
def label_match_blocks(spark, lens):
    """A block line for every block of every capture, named by the images of the block."""
    shots = numbered(lens("images").withColumnRenamed("capture_id", "run_id"), ["run_id"], "image_id", "position").select(
        "run_id", F.col("position").alias("image_id"), "name"
    )
    totals = shots.groupBy("run_id").agg(F.max("image_id").alias("n"))
    blocks = totals.select("run_id", long_div(F.col("n") - 1, 50).alias("last")).select(
        "run_id", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("b")
    )
    lines = blocks.select(
        "run_id", F.lit("match").alias("tool"), (F.col("b") + 1).alias("seq"),
        F.concat(F.lit("Matching block ["), F.col("b") + 1, F.lit("/"), F.col("last") + 1, F.lit("]")).alias("line"),
    )
    return logs.label_match_blocks(logs.classify(lines), shots).select("run_id", "seq", "message")
