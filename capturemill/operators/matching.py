"""Descriptor matching by nearest neighbours and the ratio test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturemill.functions.columns import encode_pair
from capturemill.session import checkpointed, small_side

# The matcher's ratio, and the relaxed ratio and distance of a second try.
RATIO = 0.8
RELAXED_RATIO = 0.95
RELAXED_DISTANCE = 0.9
# Descriptors per chunk: a chunk pair is one unit of work of bounded memory.
CHUNK = 1024
# Relative slack on squared distances within which candidates are measured again exactly.
RECHECK = 1e-9

NEAREST = "capture_id bigint, image_id1 bigint, image_id2 bigint, feature1 bigint, feature2 bigint, distance double"


def nearest_two(descriptors: DataFrame, pairs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The two nearest descriptors of the second image for every descriptor of the first.

    ``pairs`` is (capture_id, image_id1, image_id2).  Images are cut into chunks of
    about ``chunk`` descriptors, so the work on a huge image spreads over many chunk
    pairs.  A chunk pair keeps two candidates per query, the rank window keeps the
    best two over all chunks; ties go to the smaller descriptor id.
    """
    image = ["capture_id", "image_id"]
    sizes = descriptors.groupBy(*image).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("chunks"))
    sizes = small_side(sizes)
    chunks = (
        descriptors.select(*image, "feature_id", "descriptor").join(sizes, image)
        .withColumn("chunk", F.pmod(F.xxhash64("feature_id"), F.col("chunks")))
        .groupBy(*image, "chunk")
        .agg(F.collect_list(F.struct("feature_id", "descriptor")).alias("held"))
        .select(
            *image, "chunk", F.transform("held", lambda h: h["feature_id"]).alias("ids"),
            F.flatten(F.transform("held", lambda h: h["descriptor"].cast("array<float>"))).alias("values"),
        )
    )

    def side(n: int) -> DataFrame:
        return chunks.select(
            "capture_id", F.col("image_id").alias(f"image_id{n}"), F.col("chunk").alias(f"chunk{n}"),
            F.col("ids").alias(f"ids{n}"), F.col("values").alias(f"values{n}"),
        )

    def chunk_numbers(n: int) -> tuple[Column, DataFrame]:
        counts = sizes.select("capture_id", F.col("image_id").alias(f"image_id{n}"), F.col("chunks").alias(f"chunks{n}"))
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"chunks{n}") - 1)), counts

    # pairs of images become pairs of chunks before any descriptor is joined, and the joins are on the chunks
    units = pairs.select("capture_id", "image_id1", "image_id2").distinct()
    for n in (1, 2):
        numbers, counts = chunk_numbers(n)
        units = units.join(counts, ["capture_id", f"image_id{n}"]).withColumn(f"chunk{n}", numbers).drop(f"chunks{n}")
    unit = ["capture_id", "image_id1", "chunk1", "image_id2", "chunk2"]
    met = units.join(side(1), ["capture_id", "image_id1", "chunk1"]).join(side(2), ["capture_id", "image_id2", "chunk2"])
    # all five keys: the Python step would otherwise keep all partners of one image together
    candidates = met.repartition(*unit).groupBy(*unit).applyInPandas(_chunk_neighbours, NEAREST)
    order = Window.partitionBy("capture_id", "image_id1", "image_id2", "feature1").orderBy("distance", "feature2")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2)


def _chunk_neighbours(met: pd.DataFrame) -> pd.DataFrame:
    """Two nearest targets of each query of one chunk pair (one row of ids and values)."""
    row = next(met.itertuples(index=False))
    ids1, ids2 = np.asarray(row.ids1), np.asarray(row.ids2)
    query = np.asarray(row.values1, dtype=np.float64).reshape(len(ids1), -1)
    target = np.asarray(row.values2, dtype=np.float64).reshape(len(ids2), -1)
    norm1, norm2 = (query**2).sum(1), (target**2).sum(1)
    squares = norm1[:, None] + norm2[None, :] - 2.0 * (query @ target.T)
    second = min(1, len(ids2) - 1)
    limit = np.partition(squares, second, axis=1)[:, second] + RECHECK * (norm1 + norm2.max())
    at1, at2 = np.nonzero(squares <= limit[:, None])
    exact = np.sqrt(((query[at1] - target[at2]) ** 2).sum(1))
    order = np.lexsort((ids2[at2], exact, at1))
    at1, at2, exact = at1[order], at2[order], exact[order]
    best = np.arange(len(at1)) - np.searchsorted(at1, at1) < 2
    return pd.DataFrame({
        "capture_id": row.capture_id, "image_id1": row.image_id1, "image_id2": row.image_id2,
        "feature1": ids1[at1[best]], "feature2": ids2[at2[best]], "distance": exact[best],
    })


def match_descriptors(
    descriptors: DataFrame,
    pairs: DataFrame,
    ratio: float = RATIO,
    max_distance: float | None = None,
    max_matches: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Accepted matches of each image pair, from the first image to the second.

    A match needs a nearest distance under ``ratio`` times the second nearest (a lone
    candidate is turned down) and within ``max_distance``; at most ``max_matches`` of
    the closest are kept per pair.
    """
    pair = ["capture_id", "image_id1", "image_id2"]
    best = nearest_two(descriptors, pairs, chunk).groupBy(*pair, "feature1").agg(
        F.min_by("feature2", "rank").alias("feature2"),
        F.min_by("distance", "rank").alias("distance"),
        F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second_distance"),
    )
    accepted = best.where(F.col("distance") < F.lit(ratio) * F.col("second_distance"))
    if max_distance is not None:
        accepted = accepted.where(F.col("distance") <= max_distance)
    if max_matches is not None:
        order = Window.partitionBy(*pair).orderBy("distance", "feature1")
        accepted = accepted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_matches).drop("rank")
    return accepted.drop("second_distance")


def match_counts(matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Matches per pair as a pair table (capture_id, pair_id, rows); 0 where none was accepted."""
    pair = ["capture_id", "image_id1", "image_id2"]
    counted = matches.groupBy(*pair).agg(F.count(F.lit(1)).alias("rows"))
    return pairs.select(*pair).distinct().join(counted, pair, "left").select(
        "capture_id", encode_pair(F.col("image_id1"), F.col("image_id2")).alias("pair_id"),
        F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
    )


def match_with_relaxed_retry(
    descriptors: DataFrame,
    pairs: DataFrame,
    ratio: float = RATIO,
    max_distance: float | None = None,
    max_matches: int | None = None,
    retry_ratio: float = RELAXED_RATIO,
    retry_max_distance: float = RELAXED_DISTANCE,
) -> DataFrame:
    """Matches, with captures that got none at all matched once more under relaxed limits.

    Only captures of more than one image are tried again; ``relaxed`` marks their rows.
    """
    first = checkpointed(match_descriptors(descriptors, pairs, ratio, max_distance, max_matches))
    images = descriptors.groupBy("capture_id").agg(F.countDistinct("image_id").alias("images"))
    empty = images.where(F.col("images") > 1).join(
        first.select("capture_id").distinct(), "capture_id", "left_anti"
    ).select("capture_id")
    empty = small_side(empty)
    second = match_descriptors(
        descriptors.join(empty, "capture_id", "left_semi"), pairs.join(empty, "capture_id", "left_semi"),
        retry_ratio, retry_max_distance, max_matches,
    )
    return first.withColumn("relaxed", F.lit(False)).unionByName(second.withColumn("relaxed", F.lit(True)))
