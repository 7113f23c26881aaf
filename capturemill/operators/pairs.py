"""Image pairs: filters, names, exhaustive plans, top pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturemill.functions.columns import long_div, pair_first, pair_second
from capturemill.operators.numbering import numbered

# Edge strengths the mapper asks for, and the matcher's block size.
MIN_MATCHES = 15
MIN_INLIERS = 100
BLOCK_SIZE = 50


def verified_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with at least one verified match; the filter reaches the scan."""
    return pairs.where(F.col("rows") > 0)


def strong_pairs(pairs: DataFrame, min_matches: int = MIN_MATCHES) -> DataFrame:
    """Pairs strong enough to register an image."""
    return pairs.where(F.col("rows") >= min_matches)


def seed_pairs(pairs: DataFrame, min_inliers: int = MIN_INLIERS) -> DataFrame:
    """Pairs strong enough to start a model."""
    return pairs.where(F.col("rows") >= min_inliers)


def with_image_ids(pairs: DataFrame) -> DataFrame:
    """Decode the packed key into both image ids."""
    return pairs.withColumns({
        "image_id1": pair_first(F.col("pair_id")),
        "image_id2": pair_second(F.col("pair_id")),
    })


def name_pairs(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Attach both image names; an unknown image becomes ``Img <id>``.

    No broadcast hint: the image table grows with the fleet, so its join strategy
    is left to the measured size, and a hot image is split by adaptive execution.
    """
    names = images.select("capture_id", "image_id", "name")

    def side(n: int) -> DataFrame:
        return names.select("capture_id", F.col("image_id").alias(f"image_id{n}"), F.col("name").alias(f"found{n}"))

    def label(n: int):
        return F.coalesce(F.col(f"found{n}"), F.concat(F.lit("Img "), F.col(f"image_id{n}")))

    return (
        with_image_ids(pairs)
        .join(side(1), ["capture_id", "image_id1"], "left")
        .join(side(2), ["capture_id", "image_id2"], "left")
        .select(
            "capture_id", "pair_id", "image_id1", "image_id2",
            label(1).alias("name1"), label(2).alias("name2"),
            *[c for c in pairs.columns if c not in ("capture_id", "pair_id")],
        )
    )


def exhaustive_pairs(images: DataFrame) -> DataFrame:
    """The exhaustive pairing of every capture as one row per image.

    Image number ``position`` pairs with every image numbered ``first_partner`` to
    ``last_partner`` of its capture; ``partners`` sums to n(n-1)/2.  All pairs are
    stated, none is written out, so the plan stays linear in the images even when
    one capture holds a third of them.
    """
    placed = numbered(images.select("capture_id", "image_id"), ["capture_id"], "image_id", "position")
    totals = images.groupBy("capture_id").agg(F.count(F.lit(1)).alias("images"))
    partners = F.col("images") - F.col("position")
    return placed.join(totals, "capture_id").select(
        "capture_id", "image_id", "position",
        F.when(partners > 0, F.col("position") + 1).alias("first_partner"),
        F.when(partners > 0, F.col("images")).alias("last_partner"),
        partners.alias("partners"),
    )


def pair_blocks(images: DataFrame, block: int = BLOCK_SIZE) -> DataFrame:
    """Match work by blocks of ``block`` images: row i meets blocks i..last_block.

    One row per block, labelled by its first and last image name (``Image <k>``
    where a name is missing), with the number of image pairs the row stands for.
    """
    placed = numbered(
        images.select("capture_id", "image_id", "name"), ["capture_id"], "image_id", "position"
    ).withColumn("block", long_div(F.col("position") - 1, block) + 1)
    label = F.coalesce(F.col("name"), F.concat(F.lit("Image "), F.col("position")))
    rows = placed.groupBy("capture_id", "block").agg(
        F.count(F.lit(1)).alias("images"),
        F.min_by(label, "position").alias("first_name"),
        F.max_by(label, "position").alias("last_name"),
        F.max("position").alias("last_position"),
    )
    totals = images.groupBy("capture_id").agg(F.count(F.lit(1)).alias("total"))
    return rows.join(totals, "capture_id").select(
        "capture_id", "block",
        (long_div(F.col("total") - 1, block) + 1).alias("last_block"),
        "images", "first_name", "last_name",
        (
            long_div(F.col("images") * (F.col("images") - 1), 2)
            + F.col("images") * (F.col("total") - F.col("last_position"))
        ).alias("image_pairs"),
    )


def top_pairs(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The k best verified pairs of each capture, ties by pair id.

    The rank filter is pushed below the shuffle, so a hot capture sends k rows per task.
    """
    order = Window.partitionBy("capture_id").orderBy(F.col("rows").desc(), "pair_id")
    return (
        verified_pairs(pairs).select("capture_id", "pair_id", "rows")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    )
