"""Pose-table operators: alignment, reference override, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rot
from .metrics import gt_q, gt_t, PART, pr_q, pr_t

GT_COLS = ["gt_tx", "gt_ty", "gt_tz", "gt_qw", "gt_qx", "gt_qy", "gt_qz"]
PR_COLS = ["pr_tx", "pr_ty", "pr_tz", "pr_qw", "pr_qx", "pr_qy", "pr_qz"]
POSE = ("tx", "ty", "tz", "qw", "qx", "qy", "qz")
_MOVE = ("dx", "dy", "dz", "ew", "ex", "ey", "ez")
STEP_LIMIT = 1 << 16  # a trajectory array is one part's schedule, a parameter


def align_to_reference(poses: DataFrame) -> DataFrame:
    """Move every predicted pose so that its object's reference lands on its truth.

    An object with several references is aligned by the lowest part index.
    """
    first_ref = (
        poses.where("is_ref")
        .groupBy("name")
        .agg(F.min_by(F.struct(*GT_COLS, *PR_COLS), "part_idx").alias("_a"))
        .select("name", "_a.*")
    )
    t, q = rot.anchor_alignment(gt_t(), gt_q(), pr_t(), pr_q())
    names_t, names_q = ("_atx", "_aty", "_atz"), ("_aqw", "_aqx", "_aqy", "_aqz")
    motion = rot.with_tuple(rot.with_tuple(first_ref, names_t, t), names_q, q).select(
        "name", *names_t, *names_q
    )
    at, aq = rot.cols(*names_t), rot.cols(*names_q)
    return (
        poses.join(motion, "name")
        .withColumns(
            {
                **dict(zip(PR_COLS[:3], rot.transform(at, aq, pr_t()))),
                **dict(zip(PR_COLS[3:], rot.multiply(aq, pr_q()))),
            }
        )
        .drop(*names_t, *names_q)
    )


def pin_reference(df: DataFrame, is_ref: Column, field: tuple[str, ...] = ()) -> DataFrame:
    """Give reference rows their true pose and, where named, a zero vector field."""
    pinned = {p: F.when(is_ref, F.col(g)).otherwise(F.col(p)) for p, g in zip(PR_COLS, GT_COLS)}
    pinned.update({c: F.when(is_ref, F.lit(0.0)).otherwise(F.col(c)) for c in field})
    return df.withColumns(pinned)


def integrate(start: DataFrame, field: DataFrame, steps: DataFrame) -> DataFrame:
    """Pose after every integration step, one row per part and step.

    ``field`` has one row per part and step, ``steps`` the schedule (step, delta).
    Quaternions come out standardised.  The steps of a part depend on each other, so they are folded in order inside
    one row; that row holds one schedule, whose length is checked.
    """
    # The turn of a step does not depend on the pose, so it is computed row by row;
    # only adding and multiplying is left for the fold.
    timed = field.join(F.broadcast(steps.select("step", "delta")), "step")
    shift = rot.scale(rot.cols("vx", "vy", "vz"), F.col("delta"))
    timed = rot.with_tuple(timed, ("_sx", "_sy", "_sz"), rot.scale(rot.cols("wx", "wy", "wz"), F.col("delta")))
    turn = rot.exp_map(rot.cols("_sx", "_sy", "_sz"))
    checked = F.when(F.col("step") < STEP_LIMIT, F.col("step")).otherwise(
        F.raise_error(F.lit("schedule longer than the step limit")).cast("long")
    )
    moves = (
        timed.select(
            *PART, checked.alias("step"),
            *[v.alias(n) for v, n in zip((*shift, *turn), _MOVE)],
        )
        .groupBy(*PART)
        .agg(F.sort_array(F.collect_list(F.struct("step", *_MOVE))).alias("_moves"))
    )
    df = start.join(moves, PART)

    def names(values):
        return F.struct(*[v.alias(n) for v, n in zip(values, POSE)])

    def state(path, pose):
        return F.struct(path.alias("path"), pose.alias("pose"))

    first = names(pr_t() + pr_q())
    seed = state(F.array(F.struct(F.lit(-1).cast("long").alias("step"), first.alias("pose"))), first)

    def advance(acc, m):
        p = acc["pose"]
        moved = rot.add((p["tx"], p["ty"], p["tz"]), (m["dx"], m["dy"], m["dz"]))
        turned = rot.raw_multiply(
            (m["ew"], m["ex"], m["ey"], m["ez"]), (p["qw"], p["qx"], p["qy"], p["qz"])
        )
        here = F.struct(m["step"].alias("step"), names((*moved, *turned)).alias("pose"))
        # the new pose is read back from the grown path, so it is computed once
        return F.transform(
            F.array(here),
            lambda h: state(F.concat(acc["path"], F.array(h)), h["pose"]),
        )[0]

    path = F.aggregate("_moves", seed, advance, lambda acc: acc["path"])
    rows = df.select(*PART, F.explode(path).alias("_p")).select(*PART, "_p.step", "_p.pose.*")
    return rot.with_tuple(rows, POSE[3:], rot.standardize(rot.cols(*POSE[3:])))
