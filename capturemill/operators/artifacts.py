"""Reconstruction artifacts: which file to use next, and what a stage left behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Candidate names in order of preference.
VIEW_MESHES = (
    "scene_dense_mesh_texture.obj", "scene_dense_mesh_texture.ply", "scene_dense_mesh_refine.ply",
    "scene_dense_mesh.ply", "scene_mesh.ply", "scene_dense_mesh_texture.glb", "scene_dense_mesh_texture.mvs",
    "scene_dense_mesh_refine.mvs", "scene_dense.mvs",
)
ANY_MESH = (
    "scene_dense_mesh_texture.ply", "scene_dense_mesh_texture.obj", "scene_dense_mesh_refine.ply",
    "scene_dense_mesh.ply", "scene_mesh.ply",
)
EXPORT_PLY = (
    "scene_dense_mesh_texture.ply", "scene_dense_mesh_refine.ply", "scene_dense_mesh.ply", "scene_mesh.ply",
)
TEXTURE_MESHES = ("scene_dense_mesh_refine.ply", "scene_dense_mesh.ply", "scene_mesh.ply")
MESH_INPUTS = ("scene_dense_mesh.ply", "scene_mesh.ply")
MODELS = ("scene_dense_mesh_texture.glb", "scene_dense_mesh_texture.obj")
SPARSE_SCENE, DENSE_SCENE = "scene.mvs", "scene_dense.mvs"
REFINED_SCENE, REFINED_MESH = "scene_dense_mesh_refine.mvs", "scene_dense_mesh_refine.ply"


def _first_present(candidates: Sequence[str]):
    """Aggregate: best-ranked candidate among the ``name`` values of a group."""
    rank = F.lit(None).cast("int")
    for position in range(len(candidates) - 1, -1, -1):
        rank = F.when(F.col("name") == candidates[position], position).otherwise(rank)
    return F.min_by("name", rank)


def _has(*names: str):
    return F.coalesce(F.max(F.col("name").isin(*names)), F.lit(False))


def _for_all(artifacts: DataFrame, captures: DataFrame | None) -> DataFrame:
    """Artifact names of all captures; one that has none gets a row with a null name."""
    if captures is None:
        return artifacts
    return captures.select("capture_id").distinct().join(artifacts, "capture_id", "left")


def pick_artifact(
    artifacts: DataFrame, candidates: Sequence[str], default: str | None = None, captures: DataFrame | None = None
) -> DataFrame:
    """First existing candidate of each capture, else the default.

    Captures are those of ``captures``, or only those that have an artifact at all.
    """
    return _for_all(artifacts, captures).groupBy("capture_id").agg(
        F.coalesce(_first_present(candidates), F.lit(default).cast("string")).alias("name")
    )


def view_mode(artifacts: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """2 with a mesh, 1 with a dense scene, else 0; and whether a textured model exists."""
    return _for_all(artifacts, captures).groupBy("capture_id").agg(
        F.when(_has(*ANY_MESH), 2).when(_has(DENSE_SCENE), 1).otherwise(0).alias("mode"),
        _has(*MODELS).alias("has_model"),
    )


def best_model(models: DataFrame) -> DataFrame:
    """Largest sparse model of each capture; all-empty gives none, ties the smallest name."""
    best = F.min_by(F.struct("model", "size"), F.struct((-F.col("size")).alias("s"), F.col("model")))
    return models.where(F.col("size") > 0).groupBy("capture_id").agg(best.alias("b")).select("capture_id", "b.*")


def stage_outcome(artifacts: DataFrame, steps: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """Inputs of the mesh, refine and texture stages of each capture.

    ``steps`` is (capture_id, step, ok) for the steps ``refine`` and ``texture_ply``.
    Without a mesh the texture stage is skipped, which still counts as success.
    """
    status = steps.groupBy("capture_id").agg(*[
        F.coalesce(F.bool_or(F.when(F.col("step") == s, F.col("ok"))), F.lit(False)).alias(s)
        for s in ("refine", "texture_ply")
    ])
    held = _for_all(artifacts, captures).groupBy("capture_id").agg(
        _has(DENSE_SCENE).alias("dense"),
        _has(REFINED_SCENE).alias("refined_scene"),
        _has(REFINED_SCENE, REFINED_MESH).alias("refined"),
        *[_has(name).alias(f"has{i}") for i, name in enumerate(MESH_INPUTS)],
        _first_present(MESH_INPUTS).alias("any_mesh"),
        _first_present(TEXTURE_MESHES).alias("texture_mesh"),
    )
    scene = F.when(F.col("dense"), DENSE_SCENE).otherwise(SPARSE_SCENE)
    wanted = F.when(F.col("dense"), MESH_INPUTS[0]).otherwise(MESH_INPUTS[1])
    wanted_there = F.when(F.col("dense"), F.col("has0")).otherwise(F.col("has1"))
    refined = F.coalesce("refine", F.lit(False)) & F.col("refined")
    textured = F.col("texture_mesh").isNotNull()
    return held.join(status, "capture_id", "left").select(
        "capture_id",
        scene.alias("mesh_scene"),
        F.when(wanted_there, wanted).otherwise(F.coalesce("any_mesh", wanted)).alias("refine_input"),
        F.when(refined & F.col("refined_scene"), REFINED_SCENE).otherwise(scene).alias("texture_scene"),
        "texture_mesh",
        textured.alias("run_texture"),
        (textured & F.coalesce("texture_ply", F.lit(False))).alias("run_obj"),
    )
