"""Queries over point clouds and poses."""

from pyspark.sql import functions as F

from capturemill.operators import points, poses
from capturemill.plans.catalog import query

POINT = "capture_id, point3d_id, round(x, 6) AS x, y, z, r, g, b, error"
BOX = """
    box AS (SELECT capture_id, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y,
              max(z) AS max_z, (min(x) + max(x)) / 2 AS center_x, (min(y) + max(y)) / 2 AS center_y,
              (min(z) + max(z)) / 2 AS center_z, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS scale
            FROM points3d GROUP BY 1)"""


@query("bounds", "points3d", sql=f"""
    WITH {BOX} SELECT capture_id, round(min_x, 6) AS min_x, min_y, min_z, round(max_x, 6) AS max_x, max_y, max_z,
      round(round(center_x, 9), 6) AS center_x, center_y, center_z, round(scale, 6) AS scale,
      round(round(greatest(0.1, scale * 1.5), 9), 6) AS distance FROM box""")
def bounds(spark, lens):
    return points.bounds(lens("points3d"))


ROI = """
    range AS (SELECT capture_id, """ + ", ".join(
    f"quantile_cont({a}, 0.01) AS low_{a}, quantile_cont({a}, 0.99) AS high_{a}" for a in "xyz"
) + """ FROM points3d GROUP BY 1),
    roi AS (SELECT p.*, """ + " AND ".join(
    f"p.{a} BETWEEN (low_{a} + high_{a}) / 2 - (high_{a} - low_{a}) / 2 * 1.1 * FACTOR "
    f"AND (low_{a} + high_{a}) / 2 + (high_{a} - low_{a}) / 2 * 1.1 * FACTOR" for a in "xyz"
) + """ AS inside FROM points3d p JOIN range r ON r.capture_id = p.capture_id)"""


@query("exact_percentiles", "points3d", sql=" UNION ALL ".join(
    f"SELECT capture_id, '{a}' AS axis, CAST({q} AS DOUBLE) AS q, round(round(quantile_cont({a}, {q}), 9), 6) AS value "
    "FROM points3d GROUP BY 1" for a in "xyz" for q in (0.01, 0.5, 0.99)
))
def exact_percentiles(spark, lens):
    return points.exact_percentiles(lens("points3d"), (0.01, 0.5, 0.99))


@query("crop_to_roi", "points3d", sql=f"WITH {ROI.replace('FACTOR', '0.9')} SELECT {POINT} FROM roi WHERE inside")
def crop_to_roi(spark, lens):
    return points.crop_to_roi(lens("points3d"), scale=0.99)


@query("roi_report", "points3d", sql=f"""
    WITH {ROI.replace('FACTOR', '0.9')}
    SELECT capture_id, count(*) FILTER (WHERE inside) AS kept, count(*) FILTER (WHERE NOT inside) AS removed
    FROM roi GROUP BY 1""")
def roi_report(spark, lens):
    return points.roi_report(lens("points3d"), scale=0.99)


@query("drop_outlier_points", "points3d", sql=f"SELECT {POINT} FROM points3d WHERE error <= 2.0")
def drop_outlier_points(spark, lens):
    return points.drop_outlier_points(lens("points3d"), 2.0)


@query("outlier_report", "points3d", sql="""
    SELECT capture_id, count(*) FILTER (WHERE error <= 2.0) AS kept, count(*) FILTER (WHERE error > 2.0) AS removed
    FROM points3d GROUP BY 1""")
def outlier_report(spark, lens):
    return points.outlier_report(lens("points3d"), 2.0)


@query("voxel_thin", "points3d", sql="""
    SELECT capture_id, CAST(floor(x / 10) AS BIGINT) AS vx, CAST(floor(y / 10) AS BIGINT) AS vy,
      CAST(floor(z / 10) AS BIGINT) AS vz, round(round(avg(x), 9), 6) AS x, round(round(avg(y), 9), 6) AS y,
      round(round(avg(z), 9), 6) AS z, CAST(round_even(avg(r), 0) AS BIGINT) AS r,
      CAST(round_even(avg(g), 0) AS BIGINT) AS g, CAST(round_even(avg(b), 0) AS BIGINT) AS b,
      max(error) AS error, count(*) AS points FROM points3d GROUP BY 1, 2, 3, 4""")
def voxel_thin(spark, lens):
    return points.voxel_thin(lens("points3d"), 10.0)


@query("normalize_coordinates", "points3d", sql=f"""
    WITH {BOX} SELECT p.capture_id, point3d_id, """ + ", ".join(
    f"round(round(({a} - center_{a}) / scale, 9), 6) + 0.0 AS {a}" for a in "xyz"
) + """, r, g, b, error FROM points3d p JOIN box ON box.capture_id = p.capture_id""")
def normalize_coordinates(spark, lens):
    return points.normalize_coordinates(lens("points3d"), 2)


@query("restore_coordinates", "points3d", sql=f"SELECT {POINT} FROM points3d")
def restore_coordinates(spark, lens):
    moved = points.normalize_coordinates(lens("points3d"), 2)
    return points.restore_coordinates(moved, points.normalization(lens("points3d"), 2))


SPLIT = """
    ext AS (SELECT capture_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM points3d GROUP BY 1),
    fine AS (SELECT p.*, CAST(least(floor((x - lx) / (hx - lx) * 1048576), 1048575) AS BIGINT) AS fx,
                    CAST(least(floor((y - ly) / (hy - ly) * 1048576), 1048575) AS BIGINT) AS fy
             FROM points3d p JOIN ext e ON e.capture_id = p.capture_id),
    lv AS (SELECT CAST(l AS BIGINT) AS level, CAST(2 ** (20 - l) AS BIGINT) AS w FROM generate_series(0, 20) t(l)),
    cells AS (SELECT capture_id, level, fx // w AS cell_x, fy // w AS cell_y FROM fine JOIN lv ON true
              GROUP BY 1, 2, 3, 4 HAVING count(*) <= 200),
    chosen AS (SELECT f.capture_id, f.fx, f.fy, min(level) AS level
               FROM (SELECT DISTINCT capture_id, fx, fy FROM fine) f JOIN lv ON true
               JOIN cells USING (capture_id, level)
               WHERE cell_x = fx // w AND cell_y = fy // w GROUP BY 1, 2, 3),
    parts AS (SELECT f.capture_id, point3d_id, c.level, f.fx // w AS cell_x, f.fy // w AS cell_y
              FROM fine f JOIN chosen c ON c.capture_id = f.capture_id AND c.fx = f.fx AND c.fy = f.fy
              JOIN lv ON lv.level = c.level)"""


@query("split_subscenes", "points3d", sql=f"WITH {SPLIT} SELECT *, false AS undivided FROM parts")
def split_subscenes(spark, lens):
    return points.split_subscenes(lens("points3d").select("capture_id", "point3d_id", "x", "y"), 200).select(
        "capture_id", "point3d_id", "level", "cell_x", "cell_y", "undivided"
    )


@query("subscene_sizes", "points3d", sql=f"""
    WITH {SPLIT} SELECT capture_id, level, cell_x, cell_y, false AS undivided, count(*) AS points FROM parts GROUP BY 1, 2, 3, 4""")
def subscene_sizes(spark, lens):
    return points.subscene_sizes(lens("points3d"), 200)


# --- poses ---------------------------------------------------------------------------------------

ROTATION = [
    ["1 - 2*qy*qy - 2*qz*qz", "2*qx*qy - 2*qz*qw", "2*qx*qz + 2*qy*qw"],
    ["2*qx*qy + 2*qz*qw", "1 - 2*qx*qx - 2*qz*qz", "2*qy*qz - 2*qx*qw"],
    ["2*qx*qz - 2*qy*qw", "2*qy*qz + 2*qx*qw", "1 - 2*qx*qx - 2*qy*qy"],
]
FRAME = "framed AS (SELECT capture_id, image_id, tx, ty, tz, " + ", ".join(
    f"{ROTATION[i][j]} AS r{i}{j}" for i in range(3) for j in range(3)
) + " FROM poses), centered AS (SELECT *, " + ", ".join(
    f"-(r0{i}*tx + r1{i}*ty + r2{i}*tz) AS c{i}" for i in range(3)
) + " FROM framed)"


def _six(text: str) -> str:
    return f"round(round({text}, 9), 6) + 0.0"


def _poses(lens):
    return lens("poses").select(
        "capture_id", "image_id", F.array("qw", "qx", "qy", "qz").alias("q"), F.array("tx", "ty", "tz").alias("t")
    )


@query("camera_frames", "poses", sql=f"WITH {FRAME} SELECT capture_id, image_id, " + ", ".join(
    [f"{_six(f'r{i}{j}')} AS r{i}{j}" for i in range(3) for j in range(3)]
    + [f"{_six(f'c{i}')} AS c{'xyz'[i]}" for i in range(3)]
) + " FROM centered")
def camera_frames(spark, lens):
    framed = poses.with_camera_frame(_poses(lens))
    return framed.select(
        "capture_id", "image_id",
        *[F.col("rotation")[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)],
        *[F.col("center")[a].alias(f"c{a}") for a in "xyz"],
    )


@query("camera_frustums", "poses", sql=f"""
    WITH {FRAME}, corners AS (SELECT * FROM (VALUES (0, -0.12, -0.08), (1, 0.12, -0.08), (2, 0.12, 0.08),
      (3, -0.12, 0.08)) t(k, w, h)),
    ends AS (SELECT 2 * k AS endpoint, -1 AS k FROM corners UNION ALL SELECT 2 * k + 1, k FROM corners
      UNION ALL SELECT 8 + 2 * k, k FROM corners UNION ALL SELECT 9 + 2 * k, (k + 1) % 4 FROM corners)
    SELECT capture_id, image_id, CAST(endpoint AS BIGINT) AS endpoint, """ + ", ".join(
    f"CASE WHEN e.k < 0 THEN {_six(f'c{i}')} ELSE "
    f"{_six(f'r0{i}*CAST(w AS DOUBLE) + r1{i}*CAST(h AS DOUBLE) + r2{i}*CAST(0.15 AS DOUBLE) + c{i}')} END AS {'xyz'[i]}"
    for i in range(3)
) + " FROM centered JOIN ends e ON true LEFT JOIN corners c ON c.k = e.k")
def camera_frustums(spark, lens):
    return poses.camera_frustums(_poses(lens))
