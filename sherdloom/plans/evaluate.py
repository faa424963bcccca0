"""Evaluation jobs: the per-object report, leaderboards, trajectories, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rot
from ..operators import metrics as M
from ..session import materialize


def evaluation_report(
    points: DataFrame, poses: DataFrame, parts: DataFrame, redundancy: Column | int = 0
) -> DataFrame:
    """part_acc, rmse_t, rmse_r and shape_cd per object, redundant parts left out.

    The placed points feed four neighbour searches, so they are written once.
    """
    kept = M.drop_redundant(parts, redundancy).select(*M.PART)
    kept_poses = poses.join(kept, M.PART, "left_semi")
    placed = materialize(M.placed_points(points, kept_poses), "placed")
    errors = M.pose_metrics(kept_poses, "rmse")
    accuracy = M.part_accuracy(M.part_chamfer(placed, written=True))
    shape = M.shape_chamfer(placed, written=True)
    return accuracy.join(errors, "name").join(shape, "name")


def leaderboard(rows: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Mean of each metric per dataset, subset and model."""
    return rows.groupBy("dataset", "subset", "model").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in metrics]
    )


def trajectory_errors(trajectory: DataFrame, poses: DataFrame) -> DataFrame:
    """Error to the ground truth after every step of every part."""
    t, q = rot.cols("tx", "ty", "tz"), rot.cols("qw", "qx", "qy", "qz")
    return trajectory.join(poses, M.PART).select(
        *M.PART, "step",
        M.translation_error(t, M.gt_t()).alias("rmse_t"),
        M.rotation_error(q, M.gt_q()).alias("rmse_r"),
    )


def replay(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Points moved from the true placement to the predicted one, part by part."""
    t, r = rot.relative_pose(M.gt_t(), M.gt_q(), M.pr_t(), M.pr_q())
    names_r = [f"_r{i}" for i in range(9)]
    motion = rot.with_tuple(
        rot.with_tuple(poses, ("_mx", "_my", "_mz"), t), names_r, r
    ).select(*M.PART, "_mx", "_my", "_mz", *names_r)
    moved = rot.add(
        rot.matrix_vector(rot.cols(*names_r), rot.cols("x", "y", "z")), rot.cols("_mx", "_my", "_mz")
    )
    return points.join(motion, M.PART).select(
        *M.PART, "pt_idx", *[c.alias(a) for c, a in zip(moved, "xyz")]
    )
