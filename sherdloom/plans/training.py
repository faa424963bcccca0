"""Training-pair tables for pose denoisers: noised poses and their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rot, schedule
from ..functions.rand import DEFAULT_SEED, hash_normal, hash_quaternion, hash_uniform
from ..operators.metrics import PART, gt_q, gt_t
from ..operators.poses import GT_COLS

NOISE_COLS = ("ns_tx", "ns_ty", "ns_tz", "ns_qw", "ns_qx", "ns_qy", "ns_qz")
FIELD_COLS = ("t_vx", "t_vy", "t_vz", "t_wx", "t_wy", "t_wz")
NOISED_COLS = ("xt_tx", "xt_ty", "xt_tz", "xt_qw", "xt_qx", "xt_qy", "xt_qz")


def with_timestep(poses: DataFrame, num_timesteps: int = 1000, seed: int = DEFAULT_SEED) -> DataFrame:
    """One uniform schedule index per object, shared by its parts.

    The draw is a hash of the object's name, so no join is needed to share it.
    """
    draw = F.floor(hash_uniform(seed, F.lit("timestep"), "name") * num_timesteps)
    return poses.withColumn("train_index", draw.cast("long"))


def with_noise(poses: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """Gaussian translation and uniform rotation noise per part."""
    shift = tuple(hash_normal(seed, F.lit(c), *PART) for c in "xyz")
    return rot.with_tuple(poses, NOISE_COLS, shift + hash_quaternion(seed, F.lit("noise"), *PART))


def flow_pairs(poses: DataFrame, num_timesteps: int = 1000, kind: str = "linear") -> DataFrame:
    """(x_t, sigma, target field) per part; reference parts keep the truth and field 0.

    ``poses`` carries the truth, noise columns, ``train_index`` and ``is_ref``.
    Index 0 is the noisiest step of the schedule.
    """
    t = F.lit(float(num_timesteps)) - F.col("train_index")
    df = poses.withColumn("sigma", schedule.sigma(t, num_timesteps, kind)).withColumn(
        "timestep", F.col("sigma") * num_timesteps
    )
    noise = rot.cols(*NOISE_COLS)
    df = schedule.flow_noise(
        df, gt_t(), gt_q(), noise[:3], noise[3:], F.col("sigma"), NOISED_COLS, FIELD_COLS
    )
    ref = F.col("is_ref")
    pinned = {n: F.when(ref, F.col(g)).otherwise(F.col(n)) for n, g in zip(NOISED_COLS, GT_COLS)}
    pinned.update({n: F.when(ref, 0.0).otherwise(F.col(n)) for n in FIELD_COLS})
    return df.withColumns(pinned)


def diffusion_pairs(poses: DataFrame, betas: DataFrame) -> DataFrame:
    """(x_t, alpha_bar) per part under the diffusion schedule ``betas``.

    ``betas`` has one row per schedule step (a parameter), hence the broadcast.
    """
    df = poses.join(
        F.broadcast(betas.select(F.col("step").alias("train_index"), "alpha_bar")), "train_index"
    )
    noise = rot.cols(*NOISE_COLS)
    # the rotation part of the noise is its first three numbers, read as a vector
    df = schedule.diffusion_noise(
        df, gt_t(), gt_q(), noise[:3], noise[3:6], F.col("alpha_bar"), NOISED_COLS
    )
    ref = F.col("is_ref")
    return df.withColumns(
        {n: F.when(ref, F.col(g)).otherwise(F.col(n)) for n, g in zip(NOISED_COLS, GT_COLS)}
    )
