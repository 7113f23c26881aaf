"""Log rules line by line, precedence, host facts and clock times."""

import datetime as dt

import pytest

from capturemill.operators import logs, summaries
from capturemill.sources.text_lines import log_lines

LINES = [
    # tool, line, rule, fields (n1..n4), value, text, message
    ("extract", "Processed file [2/9] name=DSC_1.JPG num_features=12345", "T1", (2, 9, 12345), None, "DSC_1.JPG",
     "[iGPU] DSC_1.JPG: 12,345 features (2/9)"),
    ("extract", "Processed file [3/9] num_features=7", "T1", (3, 9, 7), None, None, "[iGPU] image 3: 7 features (3/9)"),
    ("extract", "Processed file [3/9] Elapsed time: 1.2", "T2", (), None, None, "  ⏱ Processed file [3/9] Elapsed time: 1.2"),
    ("extract", "Processed file [3/9]", None, (), None, None, "Processed file [3/9]"),
    ("match", "Matching block [1/4, 2/4]", "T3", (1, 4, 2, 4), None, None, "Processing match block [1/4, 2/4]..."),
    ("match", "Matching block [2/3]", "T4", (2, 3), None, None, "Processing match block 2/3 (Images: Image 51 to Image 100)"),
    ("match", "17 matches for image pair geometrically verified", "T5", (17,), None, None,
     "17 matches for image pair geometrically verified"),
    ("match", "3 GEOMETRICALLY Verified", "T6", (), None, None, "  ✓ 3 GEOMETRICALLY Verified"),
    ("map", "Registering image #14 (5)", "T7", (14, 5), None, None, "Adding camera 14 (5 of 120)"),
    ("map", "Image has 40 / 90 inliers", "T8", (40, 90), None, None, "  → 40 of 90 feature matches used"),
    ("map", "Bundle adjustment: Merged observations: 7", "T9", (), None, None, "  Adjusting..."),
    ("map", "Merged observations: 7", "T10", (7,), None, None, "  → Merged 7 track observations"),
    ("map", "Completed observations: 8", "T11", (8,), None, None, "  → Completed 8 observations"),
    ("map", "Triangulated 12345 points", "T12", (12345,), None, None, "  → Triangulated 12,345 new 3D points"),
    ("map", "Filtered observations: 9", "T13", (9,), None, None, "  → Filtered 9 outlier observations"),
    ("map", "Mean reprojection error: 0.9996px", "T14", (), 0.9996, None, "  → Mean reprojection error: 1.000px (✓ good)"),
    ("map", "Mean reprojection error: 1.0px", "T14", (), 1.0, None, "  → Mean reprojection error: 1.000px (⚠ high)"),
    ("map", "Mean reprojection error: 2.0px", "T14", (), 2.0, None, "  → Mean reprojection error: 2.000px (✗ poor)"),
    ("densify", "Depth-map for image  31 estimated using  4 images: 768x1024 (x)", "T15", (31, 4, 768, 1024), None, None,
     "[CPU] Estimating depth map for image 31 (768×1024, 4 views)"),
    ("densify", "Depth-maps dense fused and filtered: 20 depth-maps, 5 depths, 221235 points", "T16", (20, 221235), None, None,
     "  → Fused 20 depth maps → 221,235 candidate points"),
    ("densify", "Densifying point-cloud completed: 213311 points (1m)", "T17", (213311,), None, None,
     "  → Dense cloud: 213,311 points"),
    ("densify", "Point-cloud trimmed to ROI: 1500 points removed", "T18", (1500,), None, None,
     "  → Trimmed 1,500 points outside ROI"),
    ("mesh", "Mesh: 1000 vertices, 2000 faces, Removed 5", "T19", (1000, 2000), None, None,
     "  → Mesh: 1,000 vertices, 2,000 faces"),
    ("mesh", "Removed 12 Spurious faces with spikes", "T20", (12,), None, None, "  → Cleaned 12 spurious components"),
    ("mesh", "remove 3 Spikes", "T20", (3,), None, None, "  → Cleaned 3 spikes"),
    ("mesh", "Removed 4 things", "T20", (4,), None, None, "  → Cleaned 4 artifacts"),
    ("mesh", "close 6 holes", "T21", (6,), None, None, "  → Closed 6 holes"),
    ("other", "Removed 4 things", None, (), None, None, "Removed 4 things"),
]


def lines_frame(spark, with_total=True):
    rows = [(1, t, i, line, 120) for i, (t, line, *_) in enumerate(LINES)]
    df = spark.createDataFrame(rows, "run_id bigint, tool string, seq bigint, line string, total_images int")
    return df if with_total else df.drop("total_images")


def test_every_rule(spark):
    got = {r["seq"]: r for r in logs.classify(lines_frame(spark)).collect()}
    for i, (_, line, rule, numbers, value, text, message) in enumerate(LINES):
        r = got[i]
        assert (r["rule"], r["value"], r["text"], r["message"]) == (rule, value, text, message), line
        assert tuple(r[f"n{n}"] for n in range(1, 5)) == tuple(numbers) + (None,) * (4 - len(numbers)), line
    assert {r[2] for r in LINES if r[2]} == {f"T{n}" for n in range(1, 22)}


def test_huge_numbers_do_not_fail(spark):
    df = spark.createDataFrame([(1, "map", 1, "Triangulated 99999999999999999999999 points")],
                               "run_id bigint, tool string, seq bigint, line string")
    assert logs.classify(df).first()["n1"] is None


def test_block_names(spark):
    rows = [(1, "match", 0, "Matching block [1/2]"), (1, "match", 1, "Matching block [2/2]"), (1, "match", 2, "plain"),
            (2, "match", 3, "Matching block [1/1]")]
    df = spark.createDataFrame(rows, "run_id bigint, tool string, seq bigint, line string")
    images = spark.createDataFrame([(1, i, f"p{i}.jpg") for i in range(1, 52) if i != 50], "run_id bigint, image_id bigint, name string")
    images = images.union(spark.createDataFrame([(1, 99, "x")], images.schema))
    got = {r["seq"]: r["message"] for r in logs.label_match_blocks(logs.classify(df), images).collect()}
    assert got[0] == "Processing match block 1/2 (Images: p1.jpg to Image 50)"
    assert got[1] == "Processing match block 2/2 (Image: p51.jpg)"
    assert got[2] == "plain"
    assert got[3] == "Processing match block 1/1 (Images: Image 1 to Image 50)"


def test_counters_fold_in_line_order(spark):
    metrics = {r["tool"]: r for r in logs.run_metrics(lines_frame(spark).repartition(7)).collect()}
    assert metrics["extract"]["feature_images"] == 2 and metrics["extract"]["feature_total"] == 12352
    assert metrics["map"]["mean_error"] == 2.0 and metrics["map"]["registered"] == 5
    assert metrics["map"]["triangulated_points"] == 12345
    assert metrics["densify"]["dense_points"] == 213311 and metrics["densify"]["depth_maps"] == 1
    mesh = metrics["mesh"]
    assert (mesh["spurious_removed"], mesh["spikes_removed"], mesh["holes_closed"]) == (12, 3, 6)
    assert metrics["other"]["matched_lines"] == 0 and metrics["other"]["lines"] == 1


HEADER = """19:03:03 [App     ] Tool x64 v2.4.0
19:03:03 [App     ] CPU: Example(R) CPU @ 1.60GHz (8 cores)
19:03:03 [App     ] RAM: 11.34GB Physical Memory 128.00TB Virtual Memory
19:03:03 [App     ] OS: Windows 11+ x64
19:03:03 [App     ] Disk: 37.70GB (473.76GB) space

Generic options:
  PageFaultCount 7
23:59:58 [App     ] working
00:00:02 [App     ] MEMORYINFO: {
00:00:02 [App     ] \tPageFaultCount 2254
00:00:02 [App     ] \tPeakWorkingSetSize 8.46MB
00:00:02 [App     ] \tQuotaPagedPoolUsage 98.65KB
00:00:02 [App     ] } ENDINFO
"""


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "Tool-260617190303003E29.log").write_text(HEADER, newline="\r\n")
    from pyspark.sql import functions as F

    lines = log_lines(spark, str(folder))
    return lines.withColumn("run_id", F.lit(1).cast("long")).withColumn("tool", F.lit("densify"))


def test_host_facts_and_memory(spark, sample):
    facts = logs.host_facts(sample).first()
    assert facts["cpu"] == "Example(R) CPU @ 1.60GHz" and facts["cores"] == 8 and facts["ram_gb"] == 11.34
    assert (facts["disk_free_gb"], facts["disk_total_gb"], facts["os"]) == (37.7, 473.76, "Windows 11+ x64")
    memory = [(r["key"], r["value"], r["unit"]) for r in logs.memory_info(sample).orderBy("seq").collect()]
    assert memory == [("PageFaultCount", 2254.0, None), ("PeakWorkingSetSize", 8.46, "MB"), ("QuotaPagedPoolUsage", 98.65, "KB")]


def test_clock_passes_midnight(spark, sample):
    starts = sample.groupBy("run_id", "tool").agg(logs.start_from_file_name(logs.F.first("path")).alias("started"))
    assert starts.first()["started"] == dt.datetime(2026, 6, 17, 19, 3, 3)
    timed = logs.log_times(sample, starts).orderBy("seq").collect()
    assert [r["seq"] for r in timed] == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14]
    assert timed[-1]["line_time"] == dt.datetime(2026, 6, 18, 0, 0, 2)
    assert timed[7]["elapsed_seconds"] == 4 * 3600 + 56 * 60 + 55
    assert timed[5]["elapsed_seconds"] == timed[6]["elapsed_seconds"] == 0
    spent = logs.step_durations(logs.log_times(sample, starts)).first()
    assert spent["elapsed_seconds"] == 17819 and spent["limit_seconds"] == 7200 and spent["over_budget"]


def test_text_lines_keep_order_across_splits(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"run{n}.log").write_text("".join(f"line {n} {i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        rows = log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 60_000
    assert all(r["line"] == f"line {r['path'][-5]} {r['seq'] - 1}" for r in rows)


def test_analyzer_text(spark):
    rows = [(1, 1, "Images: 10"), (1, 2, "Points: 5"), (1, 3, "Images: 12 Points: 99"), (1, 4, "Points: many"),
            (1, 5, "Mean reprojection error: 0.61px"), (2, 1, "nothing")]
    got = {r["capture_id"]: r for r in summaries.analyzer_stats(
        spark.createDataFrame(rows, "capture_id bigint, seq bigint, line string")).collect()}
    assert (got[1]["images"], got[1]["points"], got[1]["mean_error"]) == (12, 5, 0.61)
    assert got[2]["images"] is None
