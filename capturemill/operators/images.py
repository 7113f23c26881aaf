"""Image sets: edits, downscale plans, names, quality presets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturemill.functions.columns import camera_name, display_name, normal_path, with_extension
from capturemill.session import small_side

# The quality presets; any unknown name means the last one.
PRESET_FIELDS = (
    "preset string, max_dim int, max_features int, max_matches int, first_octave int, guided int, ratio double, "
    "ba_refine int, extra_ba boolean, densify_res int, densify_views int, max_res int, refine_scales int, "
    "refine_res int, texture_res int"
)
PRESETS = [
    ("preview", 1024, 4096, 16384, 0, 0, 0.8, 3, False, 2, 3, 1920, 1, 2, 2),
    ("medium", 2048, 8192, 16384, -1, 0, 0.8, 5, False, 1, 4, 2560, 2, 1, 1),
    ("high", 3200, 12288, 32768, -1, 1, 0.8, 5, True, 1, 5, 3200, 2, 0, 1),
    ("ultra", None, 16384, 65536, -1, 1, 0.8, 5, True, 0, 8, 4096, 3, 0, 0),
]
FALLBACK_PRESET = "ultra"


def presets(spark: SparkSession) -> DataFrame:
    """The fixed four-row preset table."""
    return spark.createDataFrame(PRESETS, PRESET_FIELDS)


def capture_settings(captures: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Attach the preset of each capture, as (capture_id, preset, settings...).

    A name that the table does not hold becomes the fallback preset.
    """
    table = small_side(presets(captures.sparkSession) if table is None else table)
    known = table.select(F.col("preset").alias("__known")).distinct()
    named = captures.select("capture_id", "preset").join(known, F.col("preset") == F.col("__known"), "left")
    return named.select("capture_id", F.coalesce("__known", F.lit(FALLBACK_PRESET)).alias("preset")).join(
        table, "preset", "left").select("capture_id", *table.columns)


def remove_images(images: DataFrame, selected: DataFrame) -> DataFrame:
    """Images of each capture that were not selected, matched by name."""
    return images.join(selected.select("capture_id", "name"), ["capture_id", "name"], "left_anti").select(*images.columns)


def new_images(images: DataFrame, new: DataFrame, dedupe_new: bool = True) -> DataFrame:
    """The rows of ``new`` (capture_id, path) that are not in the set yet, with normalised paths."""
    tidy = new.withColumn("path", normal_path(F.col("path")))
    fresh = tidy.join(images.select("capture_id", "path"), ["capture_id", "path"], "left_anti").select(*new.columns)
    return fresh.dropDuplicates(["capture_id", "path"]) if dedupe_new else fresh


def add_images(images: DataFrame, new: DataFrame, dedupe_new: bool = True) -> DataFrame:
    """The image set followed by its new paths."""
    return images.unionByName(new_images(images, new, dedupe_new), allowMissingColumns=True)


def downscale_plan(images: DataFrame, max_dim: int | None) -> DataFrame:
    """What to do with each image: ``resize`` to a new size, ``copy``, or ``original`` without a limit.

    Sizes round half to even.  ``max_dim`` may also be a column of ``images``, given as None
    with a ``max_dim`` column present.
    """
    limit = F.col("max_dim") if max_dim is None and "max_dim" in images.columns else F.lit(max_dim).cast("int")
    longest = F.greatest("width", "height")
    too_big = longest > limit
    scale = limit.cast("double") / longest.cast("double")

    def sized(c: str):
        return F.when(too_big, F.bround(F.col(c) * scale).cast("long")).otherwise(F.col(c).cast("long"))

    return images.select(
        "capture_id", "image_id", "width", "height",
        F.when(limit.isNull(), "original").when(too_big, "resize").otherwise("copy").alias("action"),
        sized("width").alias("new_width"), sized("height").alias("new_height"),
    )


def prep_counts(plan: DataFrame) -> DataFrame:
    """Resized and copied images per capture."""
    return plan.groupBy("capture_id").agg(
        F.count_if(F.col("action") == "resize").alias("resized"),
        F.count_if(F.col("action") == "copy").alias("copied"),
    )


def with_background_removed_paths(images: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Path of each image after background removal: PNG on success, unchanged otherwise.

    ``outcomes`` is (capture_id, image_id, success).
    """
    done = outcomes.select("capture_id", "image_id", "success")
    return images.join(done, ["capture_id", "image_id"], "left").select(
        "capture_id", "image_id",
        F.when(F.col("success"), with_extension(F.col("path"), ".png")).otherwise(F.col("path")).alias("path"),
    )


def camera_labels(tags: DataFrame) -> DataFrame:
    """Camera name and its display form from maker and model tags."""
    name = camera_name(F.col("make"), F.col("model"))
    return tags.select("image_id", name.alias("camera"), display_name(name).alias("display"))


def cache_diff(current: DataFrame, cached: DataFrame, key: list[str]) -> DataFrame:
    """Keys to load (listed, not cached) and to evict (cached, no longer listed)."""
    now, held = current.select(*key).distinct(), cached.select(*key).distinct()
    load = now.join(held, key, "left_anti").withColumn("action", F.lit("load"))
    evict = held.join(now, key, "left_anti").withColumn("action", F.lit("evict"))
    return load.unionByName(evict)


def sorted_manifest(images: DataFrame) -> DataFrame:
    """Image names in ascending order within each capture, by range exchange."""
    return images.select("capture_id", "name").orderBy("capture_id", "name")
