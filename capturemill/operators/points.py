"""Point clouds: bounds, robust cropping, filters, thinning, normalising, splitting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturemill.session import SMALL_TABLE_ROWS, checkpointed, small_side

AXES = ("x", "y", "z")
# Rank error asked of the approximate percentile that brackets the exact one.
SKETCH_ACCURACY = 10_000


def bounds(points: DataFrame) -> DataFrame:
    """Bounding box of each capture with centre, largest extent and viewing distance."""
    box = points.groupBy("capture_id").agg(
        *[F.min(a).alias(f"min_{a}") for a in AXES], *[F.max(a).alias(f"max_{a}") for a in AXES]
    )
    scale = F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES])
    return box.select(
        "*",
        *[((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2.0).alias(f"center_{a}") for a in AXES],
        scale.alias("scale"),
        F.greatest(F.lit(0.1), scale * 1.5).alias("distance"),
    )


# Levels of the quad split counted in one pass (65,536 cells below one), and the finest level.
SPLIT_LEVELS, FINEST = 8, 52
# Slices of the values inside a bracket.
SLICES = 256


def exact_percentiles(points: DataFrame, qs: Sequence[float]) -> DataFrame:
    """Exact interpolated percentiles per capture and axis: (capture_id, axis, q, value).

    A sketch brackets each percentile; the bracket holds a few ten-thousandths of
    the rows, so only those values are sorted.  Values outside are merely counted, and
    equal values collapse before the shuffle.
    """
    tall = points.select(
        "capture_id", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in AXES])).alias("e")
    ).select("capture_id", "e.axis", "e.v")
    margin = 2.0 / SKETCH_ACCURACY
    ends = [end for q in qs for end in (max(q - margin, 0.0), min(q + margin, 1.0))]
    brackets = tall.groupBy("capture_id", "axis").agg(
        F.count("v").alias("n"), F.percentile_approx("v", ends, SKETCH_ACCURACY).alias("ends")
    )
    targets = brackets.select("capture_id", "axis", "n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"),
                 F.col("ends")[2 * i].alias("low"), F.col("ends")[2 * i + 1].alias("high"))
        for i, q in enumerate(qs)
    ])).alias("t")).select("capture_id", "axis", "n", "t.*")
    targets = small_side(targets)
    v = F.col("v")
    side = F.when(v < F.col("low"), -1).when(v > F.col("high"), 1).otherwise(0)
    near = tall.where(v.isNotNull()).join(targets, ["capture_id", "axis"]).withColumn("side", side)
    # below and above the bracket only the count and the adjoining value matter
    counted = near.groupBy(
        "capture_id", "axis", "i", "q", "n", "side", F.when(F.col("side") == 0, v).alias("inner")
    ).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most")).withColumn(
        "v", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least"))
    )
    # values in order are cut into slices by a second sketch, so a window sees one slice or the totals of all slices
    key = ["capture_id", "axis", "i"]
    counted = checkpointed(counted)
    edges = counted.where("side = 0").groupBy(*key).agg(
        F.percentile_approx("v", [n / SLICES for n in range(1, SLICES)], 10 * SLICES).alias("edges"))
    sliced = counted.join(small_side(edges), key, "left").withColumn("slice", F.when(F.col("side") < 0, -1).when(F.col("side") > 0, SLICES).otherwise(
        F.size(F.filter("edges", lambda e: e <= F.col("v")))))
    totals = sliced.groupBy(*key, "slice").agg(F.sum("c").alias("total"))
    before = totals.select(*key, "slice", F.coalesce(F.sum("total").over(
        Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy(*key, "slice").orderBy("v")
    running = sliced.join(small_side(before), [*key, "slice"]).withColumn(
        "upto", F.col("before") + F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    position = F.col("q") * (F.col("n") - 1)
    lower, upper = F.floor(position), F.ceil(position)

    def value_at(rank):
        return F.min(F.when(F.col("upto") > rank, F.col("v")))

    return running.groupBy("capture_id", "axis", "i", "q", "n").agg(
        value_at(lower).alias("v0"), value_at(upper).alias("v1")
    ).select(
        "capture_id", "axis", "q", (F.col("v0") + (position - lower) * (F.col("v1") - F.col("v0"))).alias("value")
    )


def roi_boxes(points: DataFrame, scale: float = 1.1, border: float = 0.0, approximate: bool = False) -> DataFrame:
    """Region of interest of each capture: the 1 %-99 % range of each axis, grown.

    The half extent is multiplied by ``scale``; a positive ``border`` then adds that
    many percent, a negative one that many units.
    """
    if approximate:
        wide = points.groupBy("capture_id").agg(*[
            F.percentile_approx(a, [0.01, 0.99], SKETCH_ACCURACY).alias(a) for a in AXES
        ]).select("capture_id", *[F.col(a)[i].alias(f"{end}_{a}") for a in AXES for i, end in enumerate(("low", "high"))])
    else:
        tall = exact_percentiles(points, (0.01, 0.99))
        wide = tall.groupBy("capture_id").agg(*[
            F.max(F.when((F.col("axis") == a) & (F.col("q") == q), F.col("value"))).alias(f"{end}_{a}")
            for a in AXES for q, end in ((0.01, "low"), (0.99, "high"))
        ])

    def half(a: str):
        extent = (F.col(f"high_{a}") - F.col(f"low_{a}")) / 2.0 * scale
        return extent * (1.0 + border / 100.0) if border >= 0 else extent - border

    def center(a: str):
        return (F.col(f"low_{a}") + F.col(f"high_{a}")) / 2.0

    return wide.select(
        "capture_id",
        *[(center(a) - half(a)).alias(f"roi_min_{a}") for a in AXES],
        *[(center(a) + half(a)).alias(f"roi_max_{a}") for a in AXES],
    )


def _inside_roi():
    test = F.lit(True)
    for a in AXES:
        test = test & F.col(a).between(F.col(f"roi_min_{a}"), F.col(f"roi_max_{a}"))
    return test


def crop_to_roi(points: DataFrame, scale: float = 1.1, border: float = 0.0, approximate: bool = False) -> DataFrame:
    """Points inside the region of interest of their capture."""
    boxes = small_side(roi_boxes(points, scale, border, approximate))
    return points.join(boxes, "capture_id").where(_inside_roi()).select(*points.columns)


def roi_report(points: DataFrame, scale: float = 1.1, border: float = 0.0, approximate: bool = False) -> DataFrame:
    """Points kept and removed by the crop, per capture."""
    boxes = small_side(roi_boxes(points, scale, border, approximate))
    return points.join(boxes, "capture_id").groupBy("capture_id").agg(
        F.count_if(_inside_roi()).alias("kept"), F.count_if(~_inside_roi()).alias("removed")
    )


def drop_outlier_points(points: DataFrame, max_error: float) -> DataFrame:
    return points.where(F.col("error") <= max_error)


def outlier_report(points: DataFrame, max_error: float) -> DataFrame:
    """Points kept and removed by the error limit, per capture (a missing error is removed)."""
    good = F.coalesce(F.col("error") <= max_error, F.lit(False))
    return points.groupBy("capture_id").agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("removed"))


def voxel_thin(points: DataFrame, size: float) -> DataFrame:
    """One point per cubic voxel: mean position, rounded mean colour, largest error, count."""
    cells = [F.floor(F.col(a) / size).cast("long").alias(f"v{a}") for a in AXES]
    return points.groupBy("capture_id", *cells).agg(
        *[F.avg(a).alias(a) for a in AXES],
        *[F.bround(F.avg(c)).cast("long").alias(c) for c in ("r", "g", "b")],
        F.max("error").alias("error"),
        F.count(F.lit(1)).alias("points"),
    )


def normalization(points: DataFrame, mode: int) -> DataFrame:
    """Shift and scale of each capture: 0 none, 1 centre, 2 centre and largest extent.

    The table is its own inverse transform: original = normalised * scale + shift.
    """
    box = bounds(points)
    shift = [(F.col(f"center_{a}") if mode else F.lit(0.0)).alias(f"shift_{a}") for a in AXES]
    scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0) if mode == 2 else F.lit(1.0)
    return box.select("capture_id", *shift, scale.alias("norm_scale"))


def normalize_coordinates(points: DataFrame, mode: int) -> DataFrame:
    """Points moved and scaled by :func:`normalization`."""
    if mode == 0:
        return points
    table = small_side(normalization(points, mode))
    moved = {a: (F.col(a) - F.col(f"shift_{a}")) / F.col("norm_scale") for a in AXES}
    return points.join(table, "capture_id").withColumns(moved).select(*points.columns)


def restore_coordinates(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """Undo :func:`normalize_coordinates` with its transform table."""
    moved = {a: F.col(a) * F.col("norm_scale") + F.col(f"shift_{a}") for a in AXES}
    return points.join(small_side(transforms), "capture_id").withColumns(moved).select(*points.columns)


def split_subscenes(points: DataFrame, max_points: int) -> DataFrame:
    """Quad split of the ground plane until no cell holds more than ``max_points``.

    Points are placed on a grid of 2**52 by 2**52, as fine as a double share of the extent can be.  The quadrants
    that a cell takes on its way down are the digits of its Morton code.  Cells ``SPLIT_LEVELS`` levels further down are
    counted and sorted by these digits once; the counts of all levels between are sums over common beginnings of the
    code, which that order holds together.  Each point takes the coarsest cell that is small enough,
    and only cells that are still too large are counted any finer.  Adds ``level``, ``cell_x``, ``cell_y`` and
    ``undivided``: points of the finest level that no split can part, more than ``max_points`` in one place.
    """
    placed, chosen = _divided(points, max_points)
    out = placed.withColumn("__cell", F.lit(None).cast(chosen[0][1].schema["__cell"].dataType))
    parts = []
    for number, (low, found, rows) in enumerate(chosen, 1):
        large = rows > SMALL_TABLE_ROWS
        # only points that the passes before have left open are shuffled, and written if a later pass reads them twice
        if large and number > 1:
            parts.append(out.where("__cell IS NOT NULL"))
            out = out.where("__cell IS NULL")
        finer = found.select("capture_id", "__kx", "__ky", F.col("__cell").alias("__finer"))
        out = out.withColumns(_keys(low)).join(finer if large else F.broadcast(finer), ["capture_id", "__kx", "__ky"], "left").select(
            *placed.columns, F.coalesce("__cell", "__finer").alias("__cell"))
        out = checkpointed(out) if large and number < len(chosen) else out
    return reduce(DataFrame.unionByName, [*parts, out]).select(*points.columns, "__cell.*")


def _keys(low: int) -> dict[str, Column]:
    """The cell of level ``low`` that a placed point lies in."""
    return {"__kx": F.shiftright("__fx", FINEST - low), "__ky": F.shiftright("__fy", FINEST - low)}


def _divided(points: DataFrame, max_points: int) -> tuple[DataFrame, list[tuple[int, DataFrame, int]]]:
    """Points placed on the grid, and the cells of each pass: its finest level, the table of :func:`_smallest_fitting` and its rows."""
    ground = ("x", "y")
    # the extents, every pass and the lookup read the points: write them once
    points = checkpointed(points)
    box = small_side(points.groupBy("capture_id").agg(
        *[F.min(a).alias(f"lo_{a}") for a in ground], *[F.max(a).alias(f"hi_{a}") for a in ground]
    ))

    def fine(a: str):
        extent = F.col(f"hi_{a}") - F.col(f"lo_{a}")
        share = F.when(extent > 0, (F.col(a) - F.col(f"lo_{a}")) / extent).otherwise(0.0)
        return F.least(F.floor(share * float(1 << FINEST)), F.lit((1 << FINEST) - 1)).cast("long")

    placed = points.join(box, "capture_id").select(*points.columns, fine("x").alias("__fx"), fine("y").alias("__fy"))
    cells = placed.select("capture_id", "__fx", "__fy")
    key = ["capture_id", "__kx", "__ky"]
    chosen: list[tuple[int, DataFrame, int]] = []
    lows = [min(top + SPLIT_LEVELS, FINEST) for top in range(0, FINEST, SPLIT_LEVELS)]
    for top, low in zip([0, *lows[:-1]], lows, strict=True):
        counts = cells.withColumns(_keys(low)).groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
        found = checkpointed(_smallest_fitting(counts, top, low, max_points))
        chosen.append((low, found, found.count()))
        left = found.where("__cell IS NULL").select(*key)
        rows = left.count()
        if low == FINEST or not rows:
            break
        left = F.broadcast(left) if rows <= SMALL_TABLE_ROWS else left
        cells = placed.select("capture_id", "__fx", "__fy").withColumns(_keys(low)).join(left, key, "left_semi").select("capture_id", "__fx", "__fy")
    return placed, chosen


def _smallest_fitting(counts: DataFrame, top: int, low: int, max_points: int) -> DataFrame:
    """Cells (capture_id, __kx, __ky, __n) of level ``low`` with their coarsest ancestor that is small enough, if any.

    Cells above level ``top`` are known to be too large.  A window sees the cells below one cell of level ``top``,
    4**SPLIT_LEVELS at most.
    """
    above = ["capture_id", "__tx", "__ty"]
    digits = [f"__d{n}" for n in range(top + 1, low + 1)]
    coded = counts.withColumns({
        "__tx": F.shiftright("__kx", low - top), "__ty": F.shiftright("__ky", low - top),
        **{f"__d{n}": F.shiftright("__kx", low - n).bitwiseAND(F.lit(1)) * 2 + F.shiftright("__ky", low - n).bitwiseAND(F.lit(1))
           for n in range(top + 1, low + 1)},
    })
    # every window below finds its rows together in this order and needs no exchange or sort of its own
    coded = coded.repartition(*above).sortWithinPartitions(*above, *digits)
    # level 0 is the whole capture; later rounds begin one level below the cells they divide
    levels = range(top + 1 if top else 0, low + 1)
    coded = coded.select("*", *[
        F.sum("__n").over(Window.partitionBy(*above, *digits[:n - top])).alias(f"__n{n}") for n in levels])
    fitting = [F.when((F.col(f"__n{n}") <= max_points) | F.lit(n == FINEST), F.struct(
        F.lit(n).alias("level"), F.shiftright("__kx", low - n).alias("cell_x"), F.shiftright("__ky", low - n).alias("cell_y"),
        (F.col(f"__n{n}") > max_points).alias("undivided"))) for n in levels]
    return coded.select("capture_id", "__kx", "__ky", "__n", F.coalesce(*fitting).alias("__cell"))


def subscene_sizes(points: DataFrame, max_points: int) -> DataFrame:
    """Number of points of each sub-scene, added up from the counts of the cells that it was chosen for."""
    _, chosen = _divided(points.select("capture_id", "x", "y"), max_points)
    key = ["level", "cell_x", "cell_y", "undivided"]
    cells = [found.where("__cell IS NOT NULL").select("capture_id", "__cell", "__n") for _, found, _ in chosen]
    return reduce(DataFrame.unionByName, cells).select("capture_id", "__cell.*", "__n").groupBy("capture_id", *key).agg(
        F.sum("__n").alias("points"))
