"""Preparation jobs: mesh files to the fragment store, store to training clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rot
from ..functions.rand import DEFAULT_SEED
from ..operators import cloud, contact, mesh, sampling
from ..operators.metrics import PART
from ..operators.packing import complete_graph
from ..operators.removal import removal_plan
from ..session import materialize


def prepare_objects(vertices: DataFrame, faces: DataFrame) -> dict[str, DataFrame]:
    """Store tables of a set of meshes: labelled faces, contact edges, removal steps.

    Meshes and measures are written once, as several of the tables read them.
    """
    vertices, faces = materialize(vertices, "mesh-vertices"), materialize(faces, "mesh-faces")
    edges = materialize(contact.contact_edges(vertices), "edges")
    labelled = contact.label_faces(faces, contact.shared_faces(vertices, faces))
    pieces = vertices.select(*PART).distinct()
    measures = materialize(
        pieces.join(mesh.piece_measures(vertices, faces), PART, "left").fillna(0.0, ["area", "volume"]), "measures"
    )
    plan = removal_plan(mesh.removal_priority(measures), edges)
    return {
        "vertices": vertices, "faces": labelled, "edges": edges, "removals": plan,
        "measures": measures,
    }


def _counts(measures: DataFrame, num_points: int, min_points: int) -> DataFrame:
    return sampling.allocate_budget(measures.where("area > 0"), num_points, min_points)


def _meta(df: DataFrame, redundancy: int) -> DataFrame:
    """num_parts and the redundant-part count beside every part row."""
    total = df.groupBy("name").agg(F.count(F.lit(1)).alias("num_parts"))
    return df.join(total, "name").withColumn("redundancy", F.lit(redundancy).cast("long"))


def _geometry(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Face geometry, written once: counts and draws both read it."""
    return materialize(mesh.face_geometry(vertices, faces), "geometry")


def _sample_and_pose(
    geometry: DataFrame, faces: DataFrame, counts: DataFrame, strategy: str, seed: int,
    turn_object: bool, shuffle: bool, zero_as_one: bool,
) -> tuple[DataFrame, DataFrame]:
    """Posed points and the per-part truth (scale, translation, rotation)."""
    pts = sampling.sample_geometry(geometry, faces, counts, strategy, seed)
    pts = pts.drop("f_idx")
    if turn_object:
        pts = cloud.rotate_objects(pts, seed)
    pts = materialize(pts, "sampled").withColumns({f"gt_{c}": F.col(c) for c in "xyz"})
    posed = cloud.rotate_parts(cloud.recenter(pts), seed)
    parts = cloud.part_scales(posed, zero_as_one)
    truth = posed.groupBy(*PART).agg(
        *[F.first(c).alias(c) for c in ("gt_tx", "gt_ty", "gt_tz", "gt_qw", "gt_qx", "gt_qy", "gt_qz")]
    )
    points = cloud.divide_by_scale(posed, parts)
    if shuffle:
        points = cloud.shuffle(points, seed, "pos")
    else:
        points = points.withColumn("pos", F.col("pt_idx"))
    keep = (*PART, "pos", "x", "y", "z", "nx", "ny", "nz", "gt_x", "gt_y", "gt_z", "frac")
    return points.select(*keep), parts.join(truth, PART)


def weighted_clouds(
    vertices: DataFrame, faces: DataFrame, num_points: int = 5000, min_points: int = 20,
    max_parts: int = 20, strategy: str = "uniform", redundancy: int = 0,
    random_anchor: bool = False, multi_ref: bool = False, seed: int = DEFAULT_SEED,
) -> tuple[DataFrame, DataFrame]:
    """(points, parts): ``num_points`` per object split by area, parts posed apart."""
    sampling.check_budget(num_points, max_parts, min_points)
    vertices = mesh.scale_to_unit(vertices).drop("mesh_scale")
    geometry = _geometry(vertices, faces)
    counts = _counts(mesh.measured(geometry), num_points, min_points)
    points, parts = _sample_and_pose(geometry, faces, counts, strategy, seed, False, True, False)
    parts = cloud.mark_references(_meta(parts, redundancy), num_points, random_anchor, multi_ref, seed)
    return points, parts


def uniform_clouds(
    vertices: DataFrame, faces: DataFrame, num_points: int = 1000, redundancy: int = 0,
    seed: int = DEFAULT_SEED,
) -> tuple[DataFrame, DataFrame]:
    """(points, parts): ``num_points`` for every part; the whole object is turned first.

    The anchor is the part with the largest scale.
    """
    vertices = mesh.scale_to_unit(vertices).drop("mesh_scale")
    geometry = _geometry(vertices, faces)
    counts = mesh.measured(geometry).where("area > 0").select(
        *PART, F.lit(num_points).cast("long").alias("n_points")
    )
    points, parts = _sample_and_pose(geometry, faces, counts, "uniform", seed, True, True, True)
    parts = _meta(parts, redundancy)
    anchors = cloud.anchor_parts(parts, "scale")
    return points, parts.join(anchors, "name").withColumn(
        "is_ref", F.col("part_idx") == F.col("anchor")
    ).drop("anchor")


def inference_clouds(
    vertices: DataFrame, faces: DataFrame, num_points: int = 5000, min_points: int = 20,
    pad_to: int = 20, strategy: str = "uniform", seed: int = DEFAULT_SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, parts, graphs) of ad-hoc meshes: no labels, no shuffle, complete graph."""
    scale = mesh.object_scale(vertices)
    vertices = mesh.scale_to_unit(vertices).drop("mesh_scale")
    geometry = _geometry(vertices, faces)
    counts = _counts(mesh.measured(geometry), num_points, min_points)
    points, parts = _sample_and_pose(geometry, faces, counts, strategy, seed, False, False, False)
    parts = cloud.mark_references(_meta(parts, 0), num_points).join(scale, "name")
    graphs = complete_graph(parts.select("name", "num_parts").distinct(), pad_to)
    return points.drop("frac"), parts, graphs


def restore_points(points: DataFrame, parts: DataFrame) -> DataFrame:
    """Posed points put back by scale, rotation and translation of their part."""
    p = points.join(parts.select(*PART, "scale", *_TRUTH), PART)
    back = rot.transform(
        rot.cols(*_TRUTH[:3]), rot.cols(*_TRUTH[3:]),
        rot.scale(rot.cols("x", "y", "z"), F.col("scale")),
    )
    return p.withColumns({f"b{c}": v for c, v in zip("xyz", back)}).drop("scale", *_TRUTH)


_TRUTH = ("gt_tx", "gt_ty", "gt_tz", "gt_qw", "gt_qx", "gt_qy", "gt_qz")
