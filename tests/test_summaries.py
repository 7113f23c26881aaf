"""Summaries and decisions at their edges."""

import pytest
from pyspark.sql import functions as F

from capturemill.operators import artifacts, devices, images, summaries, tracks
from capturemill.plans import pair_queries


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_feature_verdict_edge(spark):
    rows = [(1, 1, 2999), (1, 2, 3001), (2, 1, 2999), (2, 2, 3000)]
    got = {r["capture_id"]: r for r in summaries.feature_summary(
        frame(spark, rows, "capture_id bigint, image_id bigint, rows bigint")).collect()}
    assert got[1]["verdict"] == "OK" and got[1]["avg_features"] == 3000
    assert got[2]["verdict"] == "LOW"


def test_matching_edges(spark):
    images_ = frame(spark, [(1, 1)] + [(2, i) for i in range(5)] + [(3, i) for i in range(5)], "capture_id bigint, image_id bigint")
    pairs = frame(spark, [(2, 1, 4), (2, 2, 6), (2, 3, 0), (3, 1, 1), (3, 2, 1), (3, 3, 1)], "capture_id bigint, pair_id bigint, rows bigint")
    got = {r["capture_id"]: r for r in summaries.matching_summary(images_, pairs).collect()}
    assert (got[1]["pairs_tested"], got[1]["success_pct"], got[1]["verdict"]) == (0, 0.0, "OK")
    assert (got[2]["pairs_tested"], got[2]["pairs_matched"], got[2]["avg_matches"], got[2]["verdict"]) == (10, 2, 5.0, "POOR")
    assert got[3]["verdict"] == "OK"


def registration(spark, total, posed):
    images_ = frame(spark, [(1, i) for i in range(total)], "capture_id bigint, image_id bigint")
    registered = frame(spark, [(1, i) for i in range(posed)] * 2, "capture_id bigint, image_id bigint")
    points = frame(spark, [(1, 0.5), (1, 1.5)], "capture_id bigint, error double")
    return summaries.registration_summary(images_, registered, points)


def test_registration_edges(spark):
    verdicts = {(t, p): registration(spark, t, p).first()["verdict"] for t, p in ((4, 2), (4, 3), (100, 49), (100, 74), (4, 0))}
    assert verdicts == {(4, 2): "WARN", (4, 3): "GOOD", (100, 49): "CRITICAL", (100, 74): "WARN", (4, 0): "CRITICAL"}
    row = registration(spark, 4, 3).first()
    assert (row["failed"], row["points"], row["mean_error"]) == (1, 2, 1.0)


def test_no_registered_camera_fails(spark):
    features = frame(spark, [(1, "LOW")], "capture_id bigint, verdict string")
    matching = frame(spark, [(1, "POOR")], "capture_id bigint, verdict string")
    row = summaries.verdicts(features, matching, registration(spark, 4, 0)).first()
    assert row["registration"] == "FAILED"
    assert row["suggestions"] == ["HIGHER_PRESET", "MORE_OVERLAP", "LOW_FEATURES", "INSUFFICIENT_OVERLAP"]


def test_densify_rule_edges(spark):
    stats = frame(spark, [(1, 15, 500), (2, 14, 500), (3, 15, 499), (4, 2, 10), (5, 40, 499)], "capture_id bigint, images bigint, points bigint")
    settings = frame(spark, [(i, 8) for i in range(1, 7)], "capture_id bigint, densify_views int")
    got = {r["capture_id"]: (r["number_views"], r["fuse_views"]) for r in summaries.adapt_densify(stats, settings).collect()}
    assert got == {1: (8, 2), 2: (8, 1), 3: (8, 1), 4: (2, 1), 5: (8, 1), 6: (8, 2)}
    few = frame(spark, [(1, 5, 10)], "capture_id bigint, images bigint, points bigint")
    assert summaries.adapt_densify(few, settings.where("capture_id = 1")).first()["number_views"] == 4


def test_dense_points_per_camera(spark):
    rows = [(1, "densify", 20, 1001, None), (1, "map", None, None, 7), (2, "densify", None, 5, None)]
    got = {r["run_id"]: r["points_per_camera"] for r in summaries.dense_summary(
        frame(spark, rows, "run_id bigint, tool string, depth_maps bigint, dense_points bigint, registered bigint")).collect()}
    assert got == {1: 143, 2: 5}


def test_presets(spark):
    captures = frame(spark, [(1, "preview"), (2, "medium"), (3, "high"), (4, "ultra"), (5, "odd"), (6, None)], "capture_id bigint, preset string")
    got = {r["capture_id"]: r for r in images.capture_settings(captures).collect()}
    assert [got[i]["max_dim"] for i in range(1, 7)] == [1024, 2048, 3200, None, None, None]
    assert [got[i]["densify_views"] for i in range(1, 7)] == [3, 4, 5, 8, 8, 8]
    assert got[6]["preset"] == "ultra"


def test_downscale_rounds_half_even(spark):
    sizes = [(1, i, w, h) for i, (w, h) in enumerate([(2000, 1001), (2000, 1003), (1000, 999), (4001, 3), (5, 5)])]
    df = frame(spark, sizes, "capture_id bigint, image_id bigint, width int, height int")
    got = {r["image_id"]: r for r in images.downscale_plan(df, 1000).collect()}
    for _, i, w, h in sizes:
        scale = 1000 / max(w, h)
        want = ("resize", round(w * scale), round(h * scale)) if max(w, h) > 1000 else ("copy", w, h)
        assert (got[i]["action"], got[i]["new_width"], got[i]["new_height"]) == want
    assert {r["action"] for r in images.downscale_plan(df, None).collect()} == {"original"}


def test_added_duplicates_stay_on_request(spark):
    held = frame(spark, [(1, "a/b.jpg")], "capture_id bigint, path string")
    new = frame(spark, [(1, "a//b.jpg"), (1, "c.jpg"), (1, "./c.jpg"), (2, "a/b.jpg")], "capture_id bigint, path string")
    assert images.new_images(held, new).count() == 2
    assert images.new_images(held, new, dedupe_new=False).count() == 3
    assert images.add_images(held, new).count() == 3


def test_model_choice(spark):
    rows = [(1, "1", 5), (1, "0", 5), (1, "2", 4), (2, "0", 0), (3, "7", 1)]
    got = {r["capture_id"]: (r["model"], r["size"]) for r in artifacts.best_model(
        frame(spark, rows, "capture_id bigint, model string, size bigint")).collect()}
    assert got == {1: ("0", 5), 3: ("7", 1)}


def test_stage_outcomes(spark):
    held = [(1, "scene.mvs"), (2, "scene_dense.mvs"), (2, "scene_mesh.ply"), (3, "scene_dense.mvs"), (3, "scene_dense_mesh.ply"),
            (3, "scene_dense_mesh_refine.mvs"), (4, "scene_dense.mvs"), (4, "scene_dense_mesh_refine.ply")]
    steps = [(3, "refine", True), (3, "texture_ply", True), (4, "refine", True), (4, "texture_ply", False)]
    got = {r["capture_id"]: tuple(r)[1:] for r in artifacts.stage_outcome(
        frame(spark, held, "capture_id bigint, name string"), frame(spark, steps, "capture_id bigint, step string, ok boolean")).collect()}
    assert got == {
        1: ("scene.mvs", "scene_mesh.ply", "scene.mvs", None, False, False),
        2: ("scene_dense.mvs", "scene_mesh.ply", "scene_dense.mvs", "scene_mesh.ply", True, False),
        3: ("scene_dense.mvs", "scene_dense_mesh.ply", "scene_dense_mesh_refine.mvs", "scene_dense_mesh.ply", True, True),
        4: ("scene_dense.mvs", "scene_dense_mesh.ply", "scene_dense.mvs", "scene_dense_mesh_refine.ply", True, False),
    }


def test_hosts(spark):
    probe = frame(spark, [("a", "p", "NVIDIA GeForce"), ("a", "p", "Intel UHD"), ("b", "p", "AMD Radeon(TM) Graphics")], "host string, probe string, name string")
    hosts = frame(spark, [("a", 8.0), ("b", 4.0), ("c", 3.9)], "host string, ram_gb double")
    got = {r["host"]: (r["tier"], r["graphics"]) for r in devices.host_tier(hosts, devices.device_inventory(probe, probe)).collect()}
    assert got == {"a": ("READY", "dGPU"), "b": ("WARN", "iGPU"), "c": ("INSUFFICIENT", "iGPU")}


@pytest.mark.parametrize("step", [1, -1])
def test_a_mean_at_a_limit_does_not_depend_on_the_order_of_its_sum(spark, step):
    """These errors have a mean of 1 (and of 1.49) that a sum of doubles in one of the orders falls short of."""
    errors = [117, 74, 5, 106, 142, 164, 25, 47, 161, 159][::step]
    points = frame(spark, [(0, n, e / 100) for n, e in enumerate(errors)], "capture_id bigint, point3d_id bigint, error double")
    seen = points.select("capture_id", "point3d_id").withColumn("image_id", F.lit(1).cast("long"))
    assert tracks.reprojection_by_capture(points.coalesce(1)).first()["grade"] == "high"
    assert tracks.reprojection_by_image(points.coalesce(1), seen).first()["grade"] == "high"
    lens = {"points3d": points.withColumn("error", F.col("error") + 0.49), "observations": seen}
    assert pair_queries._registered(lens.__getitem__).count() == 0
