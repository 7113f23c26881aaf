"""Per-capture summaries, verdicts and adaptive settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturemill.functions.columns import long_div

# Thresholds of the diagnostics.
LOW_FEATURES = 3000
POOR_MATCH_SHARE = 0.3
CRITICAL_REGISTERED = 50
PARTIAL_REGISTERED = 75
GOOD_ERROR = 1.0
HIGH_ERROR = 2.0
SPARSE_POINTS = 500
SPARSE_IMAGES = 15
# Stand-ins when the model statistics are missing.
DEFAULT_POINTS = 9999
DEFAULT_IMAGES = 999


def settled(mean) -> F.Column:
    """A mean to nine digits, for comparisons: what lies behind them depends on the order in which it was summed."""
    return F.round(mean, 9)


def error_grade(error) -> F.Column:
    error = settled(error)
    return F.when(error < GOOD_ERROR, "good").when(error < HIGH_ERROR, "high").when(error.isNotNull(), "poor")


def feature_summary(keypoints: DataFrame) -> DataFrame:
    """Features per image; captures without images give no row."""
    average = F.avg("rows")
    return keypoints.groupBy("capture_id").agg(
        F.count("rows").alias("images"),
        average.alias("avg_features"),
        F.min("rows").alias("min_features"),
        F.max("rows").alias("max_features"),
        F.sum("rows").alias("total_features"),
        F.when(average < LOW_FEATURES, "LOW").otherwise("OK").alias("verdict"),
    )


def matching_summary(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tested and matched pairs; POOR when under 30 % matched (0 of 0 is not poor)."""
    tested = images.groupBy("capture_id").agg(F.count(F.lit(1)).alias("images"))
    matched = pairs.where(F.col("rows") > 0).groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("matched"), F.sum("rows").alias("matches")
    )
    out = tested.join(matched, "capture_id", "left").select(
        "capture_id", "images",
        long_div(F.col("images") * (F.col("images") - 1), 2).alias("pairs_tested"),
        F.coalesce("matched", F.lit(0)).cast("long").alias("pairs_matched"),
        F.coalesce("matches", F.lit(0)).cast("long").alias("matches"),
    )
    at_least_one = lambda c: F.greatest(F.col(c), F.lit(1).cast("long"))
    return out.select(
        "capture_id", "images", "pairs_tested", "pairs_matched",
        (F.col("pairs_matched") / at_least_one("pairs_tested") * 100).alias("success_pct"),
        (F.col("matches") / at_least_one("pairs_matched")).alias("avg_matches"),
        F.when(F.col("pairs_matched") < F.col("pairs_tested") * F.lit(POOR_MATCH_SHARE), "POOR")
        .otherwise("OK").alias("verdict"),
    )


def registration_summary(images: DataFrame, registered: DataFrame, points: DataFrame) -> DataFrame:
    """Registered cameras against all images, with points and mean error.

    ``registered`` holds (capture_id, image_id) of posed images, repeats allowed.
    """
    total = images.groupBy("capture_id").agg(F.count(F.lit(1)).alias("total_images"))
    posed = registered.groupBy("capture_id").agg(F.countDistinct("image_id").alias("registered"))
    cloud = points.groupBy("capture_id").agg(F.count(F.lit(1)).alias("points"), F.avg("error").alias("mean_error"))
    pct = F.col("registered") / F.greatest("total_images", F.lit(1).cast("long")) * 100
    return (
        total.join(posed, "capture_id", "left").join(cloud, "capture_id", "left")
        .fillna(0, ["registered", "points"])
        .select(
            "capture_id", "total_images", "registered",
            (F.col("total_images") - F.col("registered")).alias("failed"),
            pct.alias("registered_pct"), "points", "mean_error",
            F.when(pct < CRITICAL_REGISTERED, "CRITICAL").when(pct < PARTIAL_REGISTERED, "WARN")
            .otherwise("GOOD").alias("verdict"),
        )
    )


def dense_summary(metrics: DataFrame) -> DataFrame:
    """Dense cloud roll-up from run metrics: points per registered camera, floor division."""
    per_run = metrics.groupBy("run_id").agg(
        F.coalesce(F.sum("depth_maps"), F.lit(0)).alias("depth_maps"),
        F.coalesce(F.max("dense_points"), F.lit(0)).alias("dense_points"),
        F.coalesce(F.max("registered"), F.lit(0)).alias("registered"),
    )
    return per_run.select(
        "run_id", "depth_maps", "dense_points", "registered",
        long_div(F.col("dense_points"), F.greatest("registered", F.lit(1).cast("long"))).alias("points_per_camera"),
    )


def mesh_summary(metrics: DataFrame) -> DataFrame:
    """Last reported mesh size and cleaning counters of each run (0 when never reported)."""
    names = ["mesh_vertices", "mesh_faces", "spurious_removed", "spikes_removed", "holes_closed"]
    return metrics.where(F.col("tool") == "mesh").select(
        "run_id", *[F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in names]
    )


def model_stats(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Images, points and mean error of each sparse model, from its tables."""
    cloud = points.groupBy("capture_id").agg(F.count(F.lit(1)).alias("points"), F.avg("error").alias("mean_error"))
    posed = poses.groupBy("capture_id").agg(F.countDistinct("image_id").alias("images"))
    return posed.join(cloud, "capture_id", "full").select("capture_id", "images", "points", "mean_error")


def analyzer_stats(lines: DataFrame) -> DataFrame:
    """The same statistics from analyzer text; per key the last readable line wins."""
    line = F.col("line")
    is_images = F.contains(line, F.lit("Images:"))
    is_points = ~is_images & F.contains(line, F.lit("Points:"))
    is_error = ~is_images & ~is_points & F.contains(line, F.lit("Mean reprojection error:"))

    def found(test, pattern, kind):
        return F.when(test, F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).try_cast(kind))

    keys = {
        "images": found(is_images, r"Images:\s*(\d+)", "long"),
        "points": found(is_points, r"Points:\s*(\d+)", "long"),
        "mean_error": found(is_error, r"Mean reprojection error:\s*([\d.]+)px", "double"),
    }
    return lines.groupBy("capture_id").agg(
        *[F.max_by(value, F.when(value.isNotNull(), F.col("seq"))).alias(name) for name, value in keys.items()]
    )


def adapt_densify(stats: DataFrame, settings: DataFrame) -> DataFrame:
    """Neighbour and fusion views per capture; weak models use fewer.

    ``stats`` is :func:`model_stats` output, ``settings`` has ``densify_views``.
    """
    joined = settings.select("capture_id", "densify_views").join(
        stats.select("capture_id", "images", "points"), "capture_id", "left"
    )
    points = F.coalesce("points", F.lit(DEFAULT_POINTS))
    images = F.coalesce("images", F.lit(DEFAULT_IMAGES))
    weak = (points < SPARSE_POINTS) | (images < SPARSE_IMAGES)
    views = F.col("densify_views").cast("long")
    return joined.select(
        "capture_id",
        F.when(weak, F.least(views, F.greatest(F.lit(2).cast("long"), images - 1))).otherwise(views)
        .alias("number_views"),
        F.when(weak, F.lit(1)).otherwise(F.lit(2)).cast("long").alias("fuse_views"),
    )


def verdicts(features: DataFrame, matching: DataFrame, registration: DataFrame) -> DataFrame:
    """One row per capture with every diagnostic and the suggestion codes it raises."""
    joined = (
        registration.select("capture_id", "registered", F.col("verdict").alias("registration"))
        .join(matching.select("capture_id", F.col("verdict").alias("matching")), "capture_id", "left")
        .join(features.select("capture_id", F.col("verdict").alias("features")), "capture_id", "left")
    )
    failed = F.col("registered") == 0
    codes = F.array_compact(F.array(
        F.when(failed, F.lit("HIGHER_PRESET")),
        F.when(failed, F.lit("MORE_OVERLAP")),
        F.when(F.col("features") == "LOW", F.lit("LOW_FEATURES")),
        F.when(F.col("matching") == "POOR", F.lit("INSUFFICIENT_OVERLAP")),
        F.when(~failed & (F.col("registration") == "CRITICAL"), F.lit("INCOMPLETE_RECONSTRUCTION")),
        F.when(F.col("registration") == "WARN", F.lit("GAPS_IN_WEAK_AREAS")),
    ))
    return joined.select(
        "capture_id", "features", "matching",
        F.when(failed, "FAILED").otherwise(F.col("registration")).alias("registration"),
        codes.alias("suggestions"),
    )
