"""Tracks: which images see which points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturemill.operators.summaries import error_grade
from capturemill.session import checkpointed, counted_side, small_side

# Images per chunk of a track: a unit of work writes at most about the square of this many pairs.
CHUNK = 256
# Points of an image per list, where images are compared by lists of points.
POINTS_IN_LIST = 4_096
POINT = ["capture_id", "point3d_id"]


def explode_tracks(points: DataFrame) -> DataFrame:
    """Observation rows (capture, point, image) of points that carry their track."""
    return points.select("capture_id", "point3d_id", F.explode("track").alias("seen")).select(
        "capture_id", "point3d_id", F.col("seen.image_id").cast("long").alias("image_id")
    )


def covisibility(observations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Images sharing 3D points: (capture_id, image_id1 < image_id2, shared).

    The images of a point are cut into chunks by hash, about ``chunk`` images each.  Two chunks of a point
    are one unit of work with a key of its own, so the pairs of a point that all images see are
    written by many tasks, and each task adds up its pairs before they are shuffled.  No
    track is shortened or left out.
    """
    seen = observations.select(*POINT, "image_id").distinct()
    return _shared(seen, _long_points(seen, chunk), chunk)


def _long_points(seen: DataFrame, least: int) -> DataFrame:
    """Points that more than ``least`` images see; their images are counted before rows meet, so a hot point is no group."""
    return small_side(seen.groupBy(*POINT).agg(F.count(F.lit(1)).alias("images")).where(F.col("images") > least))


def _shared(seen: DataFrame, long: DataFrame, chunk: int) -> DataFrame:
    """Shared points of all image pairs, or of those with an image that is ``wanted``, where ``seen`` tells.

    The images of a point that at most ``chunk`` see are one list, whose pairs are written where it is gathered; longer tracks
    are cut into units.
    """
    cut, longer = counted_side(long.where(F.col("images") > chunk).select(*POINT, F.ceil(F.col("images") / chunk).alias("chunks")))
    met = _met_in_lists(seen.join(cut.select(*POINT), POINT, "left_anti") if longer else seen)
    met = met.unionByName(_met_in_units(seen.join(cut, POINT))) if longer else met
    return met.groupBy("capture_id", "image_id1", "image_id2").agg(F.count(F.lit(1)).alias("shared"))


def _met_in_lists(seen: DataFrame) -> DataFrame:
    wanted = [c for c in ("wanted",) if c in seen.columns]
    # rows without a point or an image meet no other
    lists = seen.dropna(subset=[*POINT, "image_id"]).groupBy(*POINT).agg(F.sort_array(F.collect_list(F.struct("image_id", *wanted))).alias("images")).where(F.size("images") > 1)
    firsts = lists.select("capture_id", "images", F.posexplode("images").alias("at", "first"))
    met = firsts.select("capture_id", "first", F.explode(F.slice("images", F.col("at") + 2, F.size("images"))).alias("second"))
    met = met.where(F.col("first.wanted") | F.col("second.wanted")) if wanted else met
    return met.select("capture_id", F.col("first.image_id").alias("image_id1"), F.col("second.image_id").alias("image_id2"))


def _met_in_units(cut: DataFrame) -> DataFrame:
    cut = cut.withColumn("own", F.pmod(F.xxhash64("image_id"), F.col("chunks")))
    wanted = ["wanted"] if "wanted" in cut.columns else []
    units = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).select(
        *POINT, F.least("own", "other").alias("chunk1"), F.greatest("own", "other").alias("chunk2"), "own", "image_id", *wanted)
    key = [*POINT, "chunk1", "chunk2"]
    left = units.where("own = chunk1").select(*key, F.col("image_id").alias("first"), *[F.col(c).alias("wanted1") for c in wanted])
    right = units.where("own = chunk2").select(*key, F.col("image_id").alias("second"), *[F.col(c).alias("wanted2") for c in wanted])
    # inside one chunk every pair is met once, between two chunks the smaller id comes first
    met = left.join(right, key).where((F.col("chunk1") < F.col("chunk2")) | (F.col("first") < F.col("second")))
    met = met.where(F.col("wanted1") | F.col("wanted2")) if wanted else met
    return met.where("first <> second").select(
        "capture_id", F.least("first", "second").alias("image_id1"), F.greatest("first", "second").alias("image_id2"))


def _directed(covisible: DataFrame) -> DataFrame:
    ends = [F.struct(F.col(f"image_id{a}").alias("image_id"), F.col(f"image_id{b}").alias("neighbor_id"))
            for a, b in ((1, 2), (2, 1))]
    return covisible.select("capture_id", "shared", F.explode(F.array(*ends)).alias("e")).select(
        "capture_id", "e.image_id", "e.neighbor_id", "shared"
    )


def _ranked(directed: DataFrame, bound: int) -> DataFrame:
    order = Window.partitionBy("capture_id", "image_id").orderBy(F.col("shared").desc(), "neighbor_id")
    return directed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= bound)


def best_views(observations: DataFrame, k: int | DataFrame, degree: int = CHUNK, growth: int = 8, chunk: int = CHUNK) -> DataFrame:
    """:func:`neighbor_views` from observations, without writing the pairs of points that very many images see.

    A threshold algorithm.  Points that at most ``degree`` images see are cheap: their pairs are at most ``degree`` times the
    observations.  What an image shares with another over cheap points is a lower bound, and the hot points of the one that
    has fewer can add no more than their number.  An image is settled if it has fewer hot points than its k-th best
    lower bound, since no image that it has not met can reach that; the hot points are then counted for its candidates
    only, those whose upper bound reaches the k-th lower bound.  Images that are not settled go on with
    points of a ``growth`` times higher degree, in the end with all points; so do, without a round, images whose cheap points
    are too few to settle them, and with them the rest if it is less than half of all that are left.  Counts and ties are exact.
    """
    seen = checkpointed(observations.select(*POINT, "image_id").distinct())
    least = min(degree, chunk)
    long = _long_points(seen, least)
    most = long.agg(F.max("images")).first()[0] or 0
    if most <= degree:
        return neighbor_views(_shared(seen, long, chunk), k)
    seen = checkpointed(seen.join(long, POINT, "left").withColumn("images", F.coalesce("images", F.lit(0))))
    captures = seen.select("capture_id").distinct().withColumn("number_views", F.lit(k)) if isinstance(k, int) else (
        k.select("capture_id", "number_views"))
    captures = small_side(captures.where("number_views > 0"))
    bound = captures.agg(F.max("number_views")).first()[0] or 0
    image = ["capture_id", "image_id"]
    degrees = [degree]
    while degrees[-1] < most:
        degrees.append(degrees[-1] * growth)
    wanted, left = counted_side(_profile(seen, degrees, least).join(captures, "capture_id"))
    all_images = seen.select(*image).distinct().count()
    found: list[DataFrame] = []
    for level, degree in enumerate(degrees):
        if not left:
            break
        # a round is for the images that it can settle, and not run for a few of them; the others wait for a higher degree
        hopeful, several = counted_side(wanted.where(_can_settle(level)).select(*image, "number_views"))
        if 2 * several < left:
            continue
        near = seen.where(F.col("images") <= degree).select(*POINT, "image_id")
        if several < all_images:
            near = near.join(hopeful.select(*image, F.lit(True).alias("wanted")), image, "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
        pairs = _shared(near, long, chunk)
        if degree >= most:
            found.append(_ranked(_directed(pairs), bound).join(hopeful, image).where(F.col("rank") <= F.col("number_views")).drop("number_views"))
            break
        directed = _directed(checkpointed(pairs)).join(hopeful, image)
        ranked = _ranked(directed, bound).where(F.col("rank") <= F.col("number_views"))
        hot = seen.where(F.col("images") > degree).select(*image, "point3d_id")
        sizes = checkpointed(hot.groupBy(*image).agg(F.count(F.lit(1)).alias("hot")))
        kth = ranked.where(F.col("rank") == F.col("number_views")).select(*image, F.col("shared").alias("kth"))
        state = checkpointed(hopeful.join(sizes, image, "left").join(kth, image, "left").fillna(0, ["hot", "kth"]))
        settled = state.where("hot = 0 OR hot < kth").select(*image, "hot", "kth")
        theirs = sizes.select("capture_id", F.col("image_id").alias("neighbor_id"), F.col("hot").alias("theirs"))
        candidates = checkpointed(directed.join(settled, image).join(theirs, ["capture_id", "neighbor_id"], "left").where(
            F.col("shared") + F.least("hot", F.coalesce("theirs", F.lit(0))) >= F.col("kth")).select(
            *image, "neighbor_id", "number_views", "shared"))
        found.append(_ranked(_with_hot(candidates, hot, sizes), bound).where(F.col("rank") <= F.col("number_views")).drop("number_views"))
        wanted, left = counted_side(wanted.join(settled.select(*image), image, "left_anti"))
    return reduce(DataFrame.unionByName, found) if found else neighbor_views(_shared(seen.select(*POINT, "image_id").limit(0), long, chunk), bound)


def _profile(seen: DataFrame, degrees: list[int], least: int) -> DataFrame:
    """For each image and degree: hot points, other points, and the images met over these, at most (``hot``, ``cheap``, ``met`` lists)."""
    # points that at most ``least`` images see are not counted one by one
    others = F.when(F.col("images") == 0, least).otherwise(F.col("images")) - 1

    def per_degree(value):
        return F.array(*[value(F.lit(d)) for d in degrees])

    return seen.groupBy("capture_id", "image_id").agg(
        per_degree(lambda d: F.count_if(F.col("images") > d)).alias("hot"),
        per_degree(lambda d: F.count_if(F.col("images") <= d)).alias("cheap"),
        per_degree(lambda d: F.coalesce(F.sum(F.when(F.col("images") <= d, others)), F.lit(0))).alias("met"),
    )


def _can_settle(level: int):
    """Whether an image may have fewer hot points than its k-th best bound: k others share so much only if they are met so often."""
    hot, cheap, met = (F.col(c)[level] for c in ("hot", "cheap", "met"))
    return (hot == 0) | ((hot < cheap) & ((hot + 1) * F.col("number_views") <= met))


def _with_hot(candidates: DataFrame, hot: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidates with the hot points that both images see added to ``shared``.

    The hot points of an image are cut into lists of about ``POINTS_IN_LIST``; lists of two images meet part by part.
    """
    parts = -(-(sizes.agg(F.max("hot")).first()[0] or 0) // POINTS_IN_LIST) or 1
    part = F.pmod(F.xxhash64("point3d_id"), F.lit(parts)).alias("part")
    lists = checkpointed(hot.groupBy("capture_id", "image_id", part).agg(F.collect_list("point3d_id").alias("points")))
    other = lists.select("capture_id", F.col("image_id").alias("neighbor_id"), "part", F.col("points").alias("other_points"))
    pair = ["capture_id", "image_id", "neighbor_id"]
    both = candidates.select(*pair).join(lists, ["capture_id", "image_id"]).join(other, ["capture_id", "neighbor_id", "part"])
    more = both.groupBy(*pair).agg(F.sum(F.size(F.array_intersect("points", "other_points"))).alias("more"))
    return candidates.join(more, pair, "left").withColumn("shared", F.col("shared") + F.coalesce("more", F.lit(0))).drop("more")


def neighbor_views(covisible: DataFrame, k: int | DataFrame) -> DataFrame:
    """The images sharing most points with each image, best first, ties by id.

    ``k`` is a number, or a table (capture_id, number_views) as made by the densify
    rule; its largest number bounds the ranks before the table is joined.
    """
    if not isinstance(k, int):
        # read for its largest number and by the join: write it once
        k = small_side(k.select("capture_id", "number_views"))
    ranked = _ranked(_directed(covisible), k if isinstance(k, int) else k.agg(F.max("number_views")).first()[0] or 0)
    if isinstance(k, int):
        return ranked
    return ranked.join(k, "capture_id").where(
        F.col("rank") <= F.col("number_views")
    ).drop("number_views")


def min_views(points: DataFrame, n: int, observations: DataFrame | None = None) -> DataFrame:
    """Points seen in at least n different images, by their track or by observation rows."""
    if observations is None:
        return points.where(F.size(F.array_distinct(F.transform("track", lambda t: t["image_id"]))) >= n)
    enough = (
        observations.groupBy("capture_id", "point3d_id")
        .agg(F.countDistinct("image_id").alias("views")).where(F.col("views") >= n)
    )
    return points.join(enough.select("capture_id", "point3d_id"), ["capture_id", "point3d_id"], "left_semi")


def track_length_stats(observations: DataFrame) -> DataFrame:
    """Track lengths and observations per image of each capture."""
    seen = observations.select("capture_id", "point3d_id", "image_id").distinct()
    by_point = seen.groupBy("capture_id", "point3d_id").agg(F.count(F.lit(1)).alias("n")).groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("points"), F.sum("n").alias("observations"),
        F.avg("n").alias("avg_track_length"), F.max("n").alias("max_track_length"),
    )
    by_image = seen.groupBy("capture_id", "image_id").agg(F.count(F.lit(1)).alias("n")).groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("images"), F.avg("n").alias("avg_observations_per_image"),
    )
    return by_point.join(by_image, "capture_id")


def reprojection_by_image(points: DataFrame, observations: DataFrame) -> DataFrame:
    """Mean error of the points each image sees, graded."""
    seen = observations.select("capture_id", "point3d_id", "image_id").distinct()
    return (
        seen.join(points.select("capture_id", "point3d_id", "error"), ["capture_id", "point3d_id"])
        .groupBy("capture_id", "image_id")
        .agg(F.count(F.lit(1)).alias("observations"), F.avg("error").alias("mean_error"))
        .withColumn("grade", error_grade(F.col("mean_error")))
    )


def reprojection_by_capture(points: DataFrame) -> DataFrame:
    """Mean error of all points of a capture, graded."""
    return (
        points.groupBy("capture_id")
        .agg(F.count(F.lit(1)).alias("points"), F.avg("error").alias("mean_error"))
        .withColumn("grade", error_grade(F.col("mean_error")))
    )
