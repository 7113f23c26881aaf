"""Camera poses: rotations, centres and frustum outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturemill.functions.columns import camera_center, rotation_matrix, turned_back

# Half width, half height and depth of the drawn frustum.
FRUSTUM_WIDTH, FRUSTUM_HEIGHT, FRUSTUM_DEPTH = 0.12, 0.08, 0.15


def with_camera_frame(poses: DataFrame) -> DataFrame:
    """Add the rotation (3 x 3, row-major) and the camera centre of each pose."""
    return poses.withColumn("rotation", rotation_matrix(F.col("q"))).withColumn(
        "center", camera_center(F.col("rotation"), F.col("t"))
    )


def camera_frustums(poses: DataFrame) -> DataFrame:
    """Outline of every camera as eight segments: 16 ordered end points per pose.

    Four segments join the centre to the corners, four close the ring of corners.
    """
    signs = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    center = F.col("center")
    apex = F.struct(*[center[axis].alias(axis) for axis in "xyz"])

    def corner(n: int):
        sx, sy = signs[n]
        local = [F.lit(sx * FRUSTUM_WIDTH), F.lit(sy * FRUSTUM_HEIGHT), F.lit(FRUSTUM_DEPTH)]
        turned = turned_back(F.col("rotation"), local)
        return F.struct(*[(value + center[axis]).alias(axis) for axis, value in zip("xyz", turned)])

    corners = [F.col("__corners")[n] for n in range(4)]
    ends = [end for c in corners for end in (F.col("__apex"), c)]
    ends += [end for n in range(4) for end in (corners[n], corners[(n + 1) % 4])]
    framed = with_camera_frame(poses).withColumns({"__apex": apex, "__corners": F.array(*[corner(n) for n in range(4)])})
    return framed.select("capture_id", "image_id", F.posexplode(F.array(*ends)).alias("endpoint", "p")).select(
        "capture_id", "image_id", "endpoint", "p.x", "p.y", "p.z"
    )
