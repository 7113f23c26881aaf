"""Capture-shaped views over the given tables.

Each lens is one portable SQL text.  ``lens_text`` yields the WITH items a lens
needs, for Spark over parquet files and for any engine with the tables as views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("supplier", "customer", "part", "orders", "lineitem", "events", "embeddings")

LENSES: dict[str, str] = {
    "images": """
        SELECT CAST(s_nationkey % 3 AS BIGINT) AS capture_id, s_suppkey AS image_id, concat(s_name, '.jpg') AS name
        FROM {supplier}""",
    "observations": """
        SELECT DISTINCT CAST(s_nationkey % 3 AS BIGINT) AS capture_id, l_orderkey AS point3d_id, l_suppkey AS image_id
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "points3d": """
        SELECT ob.capture_id, o_orderkey AS point3d_id, o_totalprice / 1000 AS x,
               CAST(o_custkey % 100 AS DOUBLE) / 2 AS y, CAST(day(o_orderdate) AS DOUBLE) AS z,
               o_orderkey % 256 AS r, (o_orderkey * 7) % 256 AS g, (o_orderkey * 13) % 256 AS b,
               CAST(o_orderkey % 300 AS DOUBLE) / 100 AS error
        FROM {orders} JOIN (SELECT DISTINCT capture_id, point3d_id FROM observations) ob ON ob.point3d_id = o_orderkey""",
    "keypoints": """
        SELECT CAST(s_nationkey % 3 AS BIGINT) AS capture_id, l_suppkey AS image_id, count(*) * 5 AS rows
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "pairs": """
        SELECT capture_id, image_id * 2147483647 + next_id AS pair_id, CAST(sum(n) AS BIGINT) AS rows FROM (
          SELECT capture_id, image_id, lead(image_id) OVER (PARTITION BY capture_id, point3d_id ORDER BY image_id) AS next_id, 1 AS n
          FROM observations
          UNION ALL
          SELECT capture_id, image_id, lead(image_id) OVER (PARTITION BY capture_id ORDER BY image_id) AS next_id, 0 AS n FROM images
        ) t WHERE next_id IS NOT NULL GROUP BY capture_id, image_id, next_id""",
    "descriptors": """
        SELECT CAST(label % 3 AS BIGINT) AS capture_id, CAST(label AS BIGINT) AS image_id, vec_id AS feature_id,
               embedding AS descriptor
        FROM {embeddings}""",
    "descriptor_pairs": """
        SELECT capture_id, image_id AS image_id1, image_id2 FROM (
          SELECT capture_id, image_id, lead(image_id) OVER (PARTITION BY capture_id ORDER BY image_id) AS image_id2
          FROM (SELECT DISTINCT capture_id, image_id FROM descriptors) i) p
        WHERE image_id2 IS NOT NULL""",
    "log_lines": """
        SELECT user_id AS run_id, event_id AS seq, ts,
          CASE event_type WHEN 'view' THEN 'extract' WHEN 'error' THEN 'match' WHEN 'click' THEN 'map'
                          WHEN 'signup' THEN 'densify' ELSE 'mesh' END AS tool,
          CASE event_type
            WHEN 'view' THEN CASE
              WHEN event_id % 11 = 9 THEN concat('Elapsed time: ', event_id % 60, ' [minutes]')
              WHEN event_id % 11 = 10 THEN concat('Processed file [', event_id % 50 + 1, '/50] name=img.jpg')
              WHEN event_id % 11 = 8 THEN concat('Processed file [1/50] name=a.jpg num_features=', event_id, ' Elapsed time: 1')
              ELSE concat('Processed file [', event_id % 50 + 1, '/50] name=img', event_id % 50,
                          '.jpg num_features=', CAST(floor(value * 40) AS BIGINT)) END
            WHEN 'error' THEN CASE
              WHEN event_id % 6 = 0 THEN 'Matching block [1/2, 2/2]'
              WHEN event_id % 6 = 1 THEN concat(CAST(floor(value) AS BIGINT), ' matches for image pair')
              WHEN event_id % 6 = 2 THEN concat('Matching block [', event_id % 9 + 1, '/9]')
              WHEN event_id % 6 = 3 THEN 'All pairs Geometrically Verified'
              WHEN event_id % 6 = 4 THEN concat('Matching block [1/3, 2/3] ', event_id, ' matches for image pair')
              ELSE 'unrelated text' END
            WHEN 'click' THEN CASE
              WHEN event_id % 10 = 0 THEN concat('Registering image #', event_id, ' (', event_id % 40 + 1, ')')
              WHEN event_id % 10 = 1 THEN concat('Triangulated ', CAST(floor(value) AS BIGINT), ' points')
              WHEN event_id % 10 = 2 THEN concat('Mean reprojection error: ', event_id % 3, '.', event_id % 7, 'px')
              WHEN event_id % 10 = 3 THEN 'Bundle adjustment: Merged observations: 7'
              WHEN event_id % 10 = 4 THEN concat('Image has ', event_id % 90, ' / ', event_id, ' inliers')
              WHEN event_id % 10 = 5 THEN concat('Merged observations: ', event_id)
              WHEN event_id % 10 = 6 THEN concat('Completed observations: ', event_id)
              WHEN event_id % 10 = 7 THEN concat('Filtered observations: ', event_id)
              WHEN event_id % 10 = 8 THEN concat('Registering image #', event_id, ' (', event_id % 30 + 1, '), Triangulated 4 points')
              ELSE 'Retriangulation' END
            WHEN 'signup' THEN CASE
              WHEN event_id % 5 = 0 THEN concat('Depth-map for image ', event_id % 50, ' estimated using 4 images: 768x1024')
              WHEN event_id % 5 = 1 THEN concat('Densifying point-cloud completed: ', CAST(floor(value * 100) AS BIGINT), ' points')
              WHEN event_id % 5 = 2 THEN concat('Depth-maps dense fused and filtered: ', event_id % 40, ' depth-maps, 5 depths, ', event_id * 3, ' points')
              WHEN event_id % 5 = 3 THEN concat('Point-cloud trimmed to ROI: ', event_id * 2, ' points removed')
              ELSE concat('Depth-maps dense fused: 3 depth-maps, ', event_id, ' points; densifying completed: 5 points') END
            ELSE CASE
              WHEN event_id % 6 = 0 THEN concat(event_id, ' vertices, ', event_id * 2, ' faces')
              WHEN event_id % 6 = 1 THEN concat('Removed ', event_id % 9, ' spurious faces')
              WHEN event_id % 6 = 2 THEN concat('Closed ', event_id % 7, ' holes')
              WHEN event_id % 6 = 3 THEN concat('Removed ', event_id % 8, ' Spikes')
              WHEN event_id % 6 = 4 THEN concat('remove ', event_id % 5, ' isolated parts')
              ELSE concat(event_id, ' vertices, 9 faces, removed 3 spurious, closed 2 holes') END
          END AS line
        FROM {events}""",
    "clock_lines": """
        SELECT run_id, tool, seq,
          concat(lpad(CAST(hour(ts) AS VARCHAR(2)), 2, '0'), ':', lpad(CAST(minute(ts) AS VARCHAR(2)), 2, '0'), ':',
                 lpad(CAST(CAST(floor(second(ts)) AS INT) AS VARCHAR(2)), 2, '0'), ' [App     ] ', line) AS line
        FROM log_lines""",
    "clock_starts": """
        SELECT run_id, tool, min(ts) AS started FROM log_lines GROUP BY 1, 2""",
    "vertices": """
        SELECT CAST(m AS BIGINT) AS mesh_id, p_partkey AS vertex_id, CAST(p_partkey % 20 AS DOUBLE) AS x,
               CAST(floor(p_partkey / 20) AS DOUBLE) AS y, p_retailprice / 1000 AS z
        FROM (SELECT *, 0 AS m FROM {part} UNION ALL SELECT *, 1 AS m FROM {part}) t""",
    "bent_vertices": """
        SELECT mesh_id, vertex_id, x + CASE WHEN vertex_id % 11 = 0 THEN 5 ELSE 0 END AS x, y, z FROM vertices""",
    "faces": """
        SELECT CAST(CASE WHEN p_size > 1 THEN 0 ELSE 1 END AS BIGINT) AS mesh_id, p_partkey * 2 + h AS face_id,
               CASE h WHEN 0 THEN p_partkey ELSE p_partkey + 1 END AS v0,
               CASE h WHEN 0 THEN p_partkey + 1 ELSE p_partkey + 21 END AS v1, p_partkey + 20 AS v2
        FROM (SELECT p_partkey, p_size, 0 AS h FROM {part} UNION ALL SELECT p_partkey, p_size, 1 AS h FROM {part}) t
        WHERE p_partkey % 20 < 19 AND p_partkey + 20 <= (SELECT max(p_partkey) FROM {part})""",
    "artifacts": """
        SELECT user_id AS capture_id,
          CASE event_id % 6 WHEN 0 THEN 'scene.mvs' WHEN 1 THEN 'scene_dense.mvs' WHEN 2 THEN 'scene_dense_mesh.ply'
            WHEN 3 THEN 'scene_dense_mesh_refine.ply' WHEN 4 THEN 'scene_dense_mesh_texture.obj'
            ELSE 'scene_mesh.ply' END AS name,
          count(*) * 1000 AS size
        FROM {events} GROUP BY 1, 2""",
    "captures": """
        SELECT c_custkey AS capture_id FROM {customer} UNION SELECT user_id AS capture_id FROM {events}""",
    "steps": """
        SELECT DISTINCT user_id AS capture_id, CASE event_id % 2 WHEN 0 THEN 'refine' ELSE 'texture_ply' END AS step,
               user_id % 3 > 0 AS ok
        FROM {events}""",
    "models": """
        SELECT user_id AS capture_id, event_type AS model, CAST(floor(min(value) / 10) AS BIGINT) AS size
        FROM {events} GROUP BY 1, 2""",
    "corners": """
        SELECT mesh_id, face_id * 64 + CAST(floor(k / 3) AS BIGINT) AS face_id, k % 3 + 1 AS corner, v_idx, vt_idx, face_id * 64 + k AS pos FROM (
          SELECT l_orderkey % 2 AS mesh_id, l_orderkey AS face_id,
                 CASE WHEN l_partkey % 13 = 0 THEN -l_partkey - 1 ELSE l_partkey END AS v_idx,
                 CASE WHEN l_suppkey % 10 = 0 THEN -1 WHEN l_suppkey % 10 = 9 THEN l_suppkey + 1000000 ELSE l_suppkey END AS vt_idx,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k
          FROM {lineitem}) t""",
    "texcoords": """
        SELECT CAST(m AS BIGINT) AS mesh_id, s_suppkey AS vt_idx, CAST(s_suppkey AS DOUBLE) / 100 AS u,
               CAST(s_suppkey % 7 AS DOUBLE) / 7 AS v
        FROM (SELECT *, 0 AS m FROM {supplier} UNION ALL SELECT *, 1 AS m FROM {supplier}) t""",
    "devices": """
        SELECT s_name AS host, 'probe_a' AS probe,
          CASE s_suppkey % 5 WHEN 0 THEN 'NVIDIA GeForce RTX 3060' WHEN 1 THEN 'AMD Radeon(TM) Graphics'
            WHEN 2 THEN 'Intel(R) Iris(R) Xe' WHEN 3 THEN 'AMD Radeon RX 6600' ELSE 'Unknown Adapter' END AS name,
          CAST(s_suppkey % 12 + 1 AS DOUBLE) AS ram_gb
        FROM {supplier}""",
    "camera_tags": """
        SELECT c_custkey AS image_id, c_mktsegment AS make,
          CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat(c_mktsegment, ' ', c_name) ELSE c_name END AS model
        FROM {customer}""",
    "image_sizes": """
        SELECT CAST(p_partkey % 4 AS BIGINT) AS capture_id, p_partkey AS image_id, 600 + p_size * 90 AS width,
               400 + (p_partkey % 53) * 80 AS height
        FROM {part}""",
    "supplier_nations": """
        SELECT s_suppkey AS run_id, s_nationkey AS nation FROM {supplier}""",
    "image_paths": """
        SELECT CAST(s_nationkey % 3 AS BIGINT) AS capture_id, s_suppkey AS image_id,
               concat('/shots/', CAST(s_nationkey AS VARCHAR(9)), '/', s_name, '.jpg') AS path
        FROM {supplier}""",
}

# Poses index an array, which engines spell differently; the index is a placeholder.
LENSES["poses"] = """
    SELECT capture_id, image_id, e1 / n AS qw, e2 / n AS qx, e3 / n AS qy, e4 / n AS qz,
           10 * e5 AS tx, 10 * e6 AS ty, 10 * e7 AS tz
    FROM (SELECT *, sqrt(e1 * e1 + e2 * e2 + e3 * e3 + e4 * e4) AS n FROM (
      SELECT CAST(label % 3 AS BIGINT) AS capture_id, vec_id AS image_id, """ + ", ".join(
    f"CAST({{item{i}}} AS DOUBLE) AS e{i}" for i in range(1, 8)
) + """
      FROM {embeddings}) e) u"""


def needed(names: list[str]) -> list[str]:
    """The named lenses and those they read, in definition order."""
    found: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name in found:
            continue
        found.add(name)
        words = set(re.findall(r"(?:FROM|JOIN) (\w+)", LENSES[name]))
        todo += [w for w in words if w in LENSES]
    order, placed = [], set()
    while len(order) < len(found):
        for name in LENSES:
            reads = {w for w in re.findall(r"(?:FROM|JOIN) (\w+)", LENSES[name]) if w in LENSES}
            if name in found and name not in placed and reads <= placed:
                order.append(name)
                placed.add(name)
    return order


def lens_text(names: list[str], tables: dict[str, str] | None = None, item: str = "embedding[{i}]") -> str:
    """Comma-separated WITH items for the named lenses."""
    source = {**(tables or {t: t for t in TABLES}), **{f"item{i}": item.format(i=i) for i in range(1, 8)}}
    return ",\n".join(f"{name} AS ({LENSES[name].format(**source)})" for name in needed(names))


def lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One lens over the parquet tables of a folder."""
    files = {t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" for t in TABLES}
    return spark.sql(f"WITH {lens_text([name], files, 'element_at(embedding, {i})')} SELECT * FROM {name}")


def stream_lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lens over the events table read as a stream."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    # a table that is not there fails here; one file or a folder of parts is matched by its own name
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir.rstrip('/')}/event[s].parquet")
    text = lens_text([name], {**{t: t for t in TABLES}, "events": "{events}"})
    return spark.sql(f"WITH {text} SELECT * FROM {name}", events=events)
