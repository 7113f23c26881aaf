"""Queries over image sets, artifacts and devices.

Remainders of ids only tell who belongs to a second input (the selected, held or cached
images, the outcomes known); every row of the table takes part.
"""

from pyspark.sql import functions as F

from capturemill.functions import columns
from capturemill.operators import artifacts, devices, images
from capturemill.plans.catalog import query


@query("remove_images", "images", sql="SELECT * FROM images WHERE image_id % 4 <> 1")
def remove_images(spark, lens):
    selected = lens("images").where("image_id % 4 = 1")
    return images.remove_images(lens("images"), selected)


@query("add_images", "image_paths", sql="""
    WITH held AS (SELECT * FROM image_paths WHERE image_id % 3 <> 0)
    SELECT capture_id, image_id, path FROM held UNION ALL
    SELECT DISTINCT capture_id, CAST(NULL AS BIGINT), path FROM image_paths p
    WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.capture_id = p.capture_id AND h.path = p.path)""")
def add_images(spark, lens):
    """Offered twice, once with an untidy path: only unknown images are added, each once."""
    paths = lens("image_paths")
    untidy = paths.select("capture_id", F.replace("path", F.lit("/shots/"), F.lit("/shots//x/.././")).alias("path"))
    offered = paths.select("capture_id", "path").unionByName(untidy)
    return images.add_images(paths.where("image_id % 3 <> 0"), offered)


PLAN = """
    plan AS (SELECT capture_id, image_id, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height,
      CASE WHEN greatest(width, height) > 2048 THEN 'resize' ELSE 'copy' END AS action,
      CASE WHEN greatest(width, height) > 2048 THEN CAST(round_even(width * (2048::DOUBLE / greatest(width, height)), 0) AS BIGINT)
           ELSE width END AS new_width,
      CASE WHEN greatest(width, height) > 2048 THEN CAST(round_even(height * (2048::DOUBLE / greatest(width, height)), 0) AS BIGINT)
           ELSE height END AS new_height FROM image_sizes)"""


@query("downscale_plan", "image_sizes", sql=f"WITH {PLAN} SELECT * FROM plan")
def downscale_plan(spark, lens):
    return images.downscale_plan(lens("image_sizes"), 2048)


@query("prep_counts", "image_sizes", sql=f"""
    WITH {PLAN} SELECT capture_id, count(*) FILTER (WHERE action = 'resize') AS resized,
      count(*) FILTER (WHERE action = 'copy') AS copied FROM plan GROUP BY 1""")
def prep_counts(spark, lens):
    return images.prep_counts(images.downscale_plan(lens("image_sizes"), 2048))


@query("background_removed_paths", "image_paths", sql="""
    SELECT capture_id, image_id, CASE WHEN image_id % 3 = 0 THEN regexp_replace(path, '\\.[^./]*$', '.png') ELSE path END AS path
    FROM image_paths""")
def background_removed_paths(spark, lens):
    paths = lens("image_paths")
    outcomes = paths.where("image_id % 3 <> 2").select(
        "capture_id", "image_id", (F.col("image_id") % 3 == 0).alias("success")
    )
    return images.with_background_removed_paths(paths, outcomes)


@query("camera_labels", "camera_tags", sql="""
    WITH named AS (SELECT image_id, CASE WHEN trim(model) = '' THEN 'Undetected'
        WHEN trim(make) <> '' AND NOT contains(upper(trim(model)), upper(trim(make))) THEN trim(make) || ' ' || trim(model)
        ELSE trim(model) END AS camera FROM camera_tags)
    SELECT image_id, camera, CASE WHEN length(camera) <= 36 THEN camera ELSE substr(camera, 1, 35) || '...' END AS display
    FROM named""")
def camera_labels(spark, lens):
    return images.camera_labels(lens("camera_tags"))


@query("cache_diff", "images", sql="""
    WITH now AS (SELECT capture_id, name FROM images WHERE image_id % 5 <> 0 OR image_id % 3 = 0),
    held AS (SELECT capture_id, name FROM images WHERE image_id % 3 <> 0)
    SELECT *, 'load' AS action FROM (SELECT * FROM now EXCEPT SELECT * FROM held) a UNION ALL
    SELECT *, 'evict' FROM (SELECT * FROM held EXCEPT SELECT * FROM now) b""")
def cache_diff(spark, lens):
    return images.cache_diff(
        lens("images").where("image_id % 5 <> 0 OR image_id % 3 = 0"), lens("images").where("image_id % 3 <> 0"), ["capture_id", "name"]
    )


@query("sorted_manifest", "images", sql="SELECT capture_id, name FROM images ORDER BY 1, 2")
def sorted_manifest(spark, lens):
    return images.sorted_manifest(lens("images"))


# --- artifacts -----------------------------------------------------------------------------------

def _pick(names, default):
    ranks = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names))
    other = "NULL" if default is None else f"'{default}'"
    return f"""
    SELECT capture_id, coalesce(min_by(name, rank) FILTER (WHERE rank IS NOT NULL), CAST({other} AS VARCHAR)) AS name
    FROM (SELECT c.capture_id, name, CASE name {ranks} END AS rank FROM captures c LEFT JOIN artifacts a ON a.capture_id = c.capture_id) a
    GROUP BY 1"""


@query("pick_view_mesh", "artifacts", "captures", sql=_pick(artifacts.VIEW_MESHES, artifacts.VIEW_MESHES[0]))
def pick_view_mesh(spark, lens):
    return artifacts.pick_artifact(lens("artifacts"), artifacts.VIEW_MESHES, artifacts.VIEW_MESHES[0], captures=lens("captures"))


@query("pick_any_mesh", "artifacts", "captures", sql=_pick(artifacts.ANY_MESH, None))
def pick_any_mesh(spark, lens):
    return artifacts.pick_artifact(lens("artifacts"), artifacts.ANY_MESH, captures=lens("captures"))


@query("pick_export_ply", "artifacts", "captures", sql=_pick(artifacts.EXPORT_PLY, None))
def pick_export_ply(spark, lens):
    return artifacts.pick_artifact(lens("artifacts"), artifacts.EXPORT_PLY, captures=lens("captures"))


@query("pick_texture_mesh", "artifacts", "captures", sql=_pick(artifacts.TEXTURE_MESHES, None))
def pick_texture_mesh(spark, lens):
    return artifacts.pick_artifact(lens("artifacts"), artifacts.TEXTURE_MESHES, captures=lens("captures"))


@query("pick_mesh_input", "artifacts", "captures", sql=_pick(artifacts.MESH_INPUTS, artifacts.MESH_INPUTS[0]))
def pick_mesh_input(spark, lens):
    return artifacts.pick_artifact(lens("artifacts"), artifacts.MESH_INPUTS, artifacts.MESH_INPUTS[0], captures=lens("captures"))


@query("view_mode", "artifacts", "captures", sql="""
    SELECT capture_id, CAST(CASE WHEN bool_or(name IN ('scene_dense_mesh_texture.ply', 'scene_dense_mesh_texture.obj',
        'scene_dense_mesh_refine.ply', 'scene_dense_mesh.ply', 'scene_mesh.ply')) THEN 2
      WHEN bool_or(name = 'scene_dense.mvs') THEN 1 ELSE 0 END AS BIGINT) AS mode,
      coalesce(bool_or(name IN ('scene_dense_mesh_texture.glb', 'scene_dense_mesh_texture.obj')), false) AS has_model
    FROM captures c LEFT JOIN artifacts a USING (capture_id) GROUP BY 1""")
def view_mode(spark, lens):
    return artifacts.view_mode(lens("artifacts"), lens("captures"))


@query("best_model", "models", sql="""
    SELECT capture_id, model, size FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY size DESC, model) AS k
      FROM models WHERE size > 0) m WHERE k = 1""")
def best_model(spark, lens):
    return artifacts.best_model(lens("models"))


@query("stage_outcome", "artifacts", "steps", "captures", sql="""
    WITH n AS (SELECT c.capture_id, coalesce(name, '') AS name FROM captures c LEFT JOIN artifacts a ON a.capture_id = c.capture_id),
    h AS (SELECT capture_id, bool_or(name = 'scene_dense.mvs') AS dense,
        bool_or(name = 'scene_dense_mesh.ply') AS dm, bool_or(name = 'scene_mesh.ply') AS sm,
        bool_or(name = 'scene_dense_mesh_refine.ply') AS rp, bool_or(name = 'scene_dense_mesh_refine.mvs') AS rm
      FROM n GROUP BY 1),
    s AS (SELECT capture_id, coalesce(bool_or(ok) FILTER (WHERE step = 'refine'), false) AS refine,
        coalesce(bool_or(ok) FILTER (WHERE step = 'texture_ply'), false) AS ply FROM steps GROUP BY 1),
    b AS (SELECT h.*, coalesce(refine, false) AS refine, coalesce(ply, false) AS ply,
        CASE WHEN dense THEN 'scene_dense.mvs' ELSE 'scene.mvs' END AS mesh_scene,
        CASE WHEN rp THEN 'scene_dense_mesh_refine.ply' WHEN dm THEN 'scene_dense_mesh.ply'
             WHEN sm THEN 'scene_mesh.ply' END AS texture_mesh FROM h LEFT JOIN s ON s.capture_id = h.capture_id)
    SELECT capture_id, mesh_scene,
      CASE WHEN dense AND dm THEN 'scene_dense_mesh.ply' WHEN NOT dense AND sm THEN 'scene_mesh.ply'
           WHEN dm THEN 'scene_dense_mesh.ply' WHEN sm THEN 'scene_mesh.ply'
           WHEN dense THEN 'scene_dense_mesh.ply' ELSE 'scene_mesh.ply' END AS refine_input,
      CASE WHEN refine AND rm THEN 'scene_dense_mesh_refine.mvs' ELSE mesh_scene END AS texture_scene,
      texture_mesh, texture_mesh IS NOT NULL AS run_texture, texture_mesh IS NOT NULL AND ply AS run_obj FROM b""")
def stage_outcome(spark, lens):
    return artifacts.stage_outcome(lens("artifacts"), lens("steps"), lens("captures"))


# --- devices -------------------------------------------------------------------------------------

CLASSED = """
    classed AS (SELECT DISTINCT host, name, CASE WHEN upper(name) SIMILAR TO '.*(NVIDIA|AMD|RADEON|GEFORCE|QUADRO|TESLA).*'
        AND NOT regexp_matches(upper(name), 'INTEL|IRIS|HD GRAPHICS|AMD RADEON\\(TM\\) GRAPHICS|RADEON VEGA|APU|APPLE')
        THEN 'dedicated' ELSE 'integrated' END AS device_class
      FROM (SELECT host, name FROM devices UNION ALL SELECT host, name FROM devices
            UNION ALL SELECT host, 'Intel HD Graphics 620' FROM devices WHERE ram_gb > 6) d)"""


def _inventory(lens):
    probe = lens("devices")
    other = probe.where("ram_gb > 6").withColumn("name", F.lit("Intel HD Graphics 620"))
    return devices.device_inventory(probe, probe, other)


@query("device_inventory", "devices", sql=f"WITH {CLASSED} SELECT * FROM classed")
def device_inventory(spark, lens):
    return _inventory(lens)


@query("host_tier", "devices", sql=f"""
    WITH {CLASSED}
    SELECT d.host, d.ram_gb, CASE WHEN ram_gb >= 8 THEN 'READY' WHEN ram_gb >= 4 THEN 'WARN' ELSE 'INSUFFICIENT' END AS tier,
      CASE WHEN c.dedicated THEN 'dGPU' ELSE 'iGPU' END AS graphics
    FROM devices d LEFT JOIN (SELECT host, bool_or(device_class = 'dedicated') AS dedicated FROM classed GROUP BY 1) c
      ON c.host = d.host""")
def host_tier(spark, lens):
    return devices.host_tier(lens("devices"), _inventory(lens))


# --- column helpers ------------------------------------------------------------------------------

@query("display_names", "camera_tags", sql="""
    WITH long AS (SELECT image_id, make || chr(9) || ' ' || model || '  of the ' || make || ' series' AS name FROM camera_tags),
    clean AS (SELECT image_id, trim(regexp_replace(name, '[\\t ]+', ' ', 'g')) AS name FROM long)
    SELECT image_id, CASE WHEN length(name) <= 36 THEN name ELSE substr(name, 1, 35) || '...' END AS display FROM clean""")
def display_names(spark, lens):
    name = F.concat("make", F.lit("\t "), "model", F.lit("  of the "), "make", F.lit(" series"))
    return lens("camera_tags").select("image_id", columns.display_name(name).alias("display"))


@query("viewer_colors", "points3d", sql="""
    SELECT capture_id, point3d_id, round(round(r / 255, 9), 6) AS red, round(round(g / 255, 9), 6) AS green,
      round(round(b / 255, 9), 6) AS blue, CAST(1 AS DOUBLE) AS alpha FROM points3d""")
def viewer_colors(spark, lens):
    color = columns.unit_color(F.col("r"), F.col("g"), F.col("b"))
    return lens("points3d").select(
        "capture_id", "point3d_id", *[color[i].alias(c) for i, c in enumerate(("red", "green", "blue", "alpha"))]
    )


@query("number_formats", "points3d", sql="""
    SELECT capture_id, point3d_id, format('{:,}', point3d_id * 1009) AS whole, format('{:,.0f}', x * 1000) AS rounded,
      format('{:.1f}', x) AS tenth, format('{:.3f}', error) AS thousandth FROM points3d""")
def number_formats(spark, lens):
    return lens("points3d").select(
        "capture_id", "point3d_id", columns.thousands(F.col("point3d_id") * 1009).alias("whole"),
        columns.thousands(F.col("x") * 1000).alias("rounded"), columns.fixed(F.col("x"), 1).alias("tenth"),
        columns.fixed(F.col("error"), 3).alias("thousandth"),
    )


@query("path_forms", "image_paths", sql="""
    SELECT capture_id, image_id, path AS slashed, regexp_extract(path, '[^/]+$') AS base,
      regexp_replace(path, '[.][^./]*$', '.png') AS swapped, substr(path, 8) AS inside FROM image_paths""")
def path_forms(spark, lens):
    back = columns.forward_slashes(F.replace("path", F.lit("/"), F.lit("\\")))
    return lens("image_paths").select(
        "capture_id", "image_id", back.alias("slashed"), columns.base_name(back).alias("base"),
        columns.with_extension(back, ".png").alias("swapped"), columns.relative_path(back, F.lit("/shots/")).alias("inside"),
    )
