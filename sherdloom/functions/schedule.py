"""Noise schedules and one-row SE(3) noising, denoising and integration steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import rot

# Fixed values of the schedules.
KNEE_STEP = 700.0
KNEE_SIGMA = 0.1
TOTAL_STEPS = 1000.0
EXP_RATE = 5.0
ALPHA_EXP_RATE = 12.0
COSINE_OFFSET = 0.008
MAX_BETA = 0.999
VARIANCE_FLOOR = 1e-20

SIGMA_SCHEDULES = ("linear", "piecewise-linear", "piecewise-quadratic", "exponential")


def sigma(t: Column, num_timesteps: int, kind: str = "linear") -> Column:
    """Noise level at step ``t`` of ``num_timesteps``."""
    s = t * (TOTAL_STEPS / num_timesteps)
    early, late = s / KNEE_STEP, (s - KNEE_STEP) / (TOTAL_STEPS - KNEE_STEP)
    if kind == "linear":
        return s / TOTAL_STEPS
    if kind == "piecewise-linear":
        rise = (early, late)
    elif kind == "piecewise-quadratic":
        rise = (early * early, late * late)
    elif kind == "exponential":
        return F.exp(-EXP_RATE * (1.0 - s / TOTAL_STEPS))
    else:
        raise ValueError(f"unknown sigma schedule {kind!r}")
    return F.when(s <= KNEE_STEP, KNEE_SIGMA * rise[0]).otherwise(
        KNEE_SIGMA + (1.0 - KNEE_SIGMA) * rise[1]
    )


def sigma_table(
    spark: SparkSession, n: int, kind: str = "linear", num_train_timesteps: int = 1000
) -> DataFrame:
    """Inference schedule: (step, sigma, timestep, delta), noisiest step first.

    ``delta`` is the change to the next level; the level after the last is 0.
    ``n`` rows, so it may be broadcast.
    """
    steps = spark.range(n).select(
        F.col("id").alias("step"),
        sigma((F.lit(n) - F.col("id")).cast("double"), n, kind).alias("sigma"),
    )
    order = Window.orderBy("step")
    return steps.withColumn("timestep", F.col("sigma") * num_train_timesteps).withColumn(
        "delta", F.lead("sigma", 1, 0.0).over(order) - F.col("sigma")
    )


def sigma_lookup(df: DataFrame, schedule: DataFrame, timestep: str = "timestep") -> DataFrame:
    """Attach sigma by timestep; where a timestep occurs twice the second match wins.

    A timestep that the schedule does not have is an error.
    ``schedule`` has one row per scheduled step (a parameter), hence the broadcast.
    """
    nth = F.row_number().over(Window.partitionBy("timestep").orderBy("step"))
    last_of_two = F.count("*").over(Window.partitionBy("timestep"))
    picked = (
        schedule.select("step", "timestep", "sigma")
        .withColumn("_n", nth)
        .withColumn("_of", last_of_two)
        .where(F.col("_n") == F.least(F.col("_of"), F.lit(2)))
        .select(F.col("timestep").alias(timestep), "sigma")
    )
    unknown = F.concat(F.lit("timestep not in the schedule: "), F.col(timestep).cast("string"))
    return df.join(F.broadcast(picked), timestep, "left").withColumn(
        "sigma", F.coalesce("sigma", F.raise_error(unknown).cast("double"))
    )


def stochastic_epsilon(s: Column, level: float = 0.1, floor: float = 0.01) -> Column:
    return F.sqrt(level * level * s * (1.0 - s) + floor)


def alpha_bar(t: Column, kind: str) -> Column:
    """Remaining signal at time ``t`` in [0, 1]."""
    if kind == "cosine":
        c = F.cos((t + COSINE_OFFSET) / (1.0 + COSINE_OFFSET) * (math.pi / 2.0))
        return c * c
    if kind == "exp":
        return F.exp(t * -ALPHA_EXP_RATE)
    if kind == "piece_wise":
        s = t * TOTAL_STEPS
        early, late = s / KNEE_STEP, (s - KNEE_STEP) / (TOTAL_STEPS - KNEE_STEP)
        return F.when(s <= KNEE_STEP, 1.0 - KNEE_SIGMA * early * early).otherwise(
            (1.0 - KNEE_SIGMA) * (1.0 - late * late)
        )
    raise ValueError(f"unknown alpha transform {kind!r}")


def beta_table(spark: SparkSession, n: int = 1000, kind: str = "piece_wise") -> DataFrame:
    """Diffusion schedule (step, beta, alpha_bar); alpha_bar = running product of 1-beta.

    ``n`` rows, a parameter, so the single ordered window and a broadcast are bounded.
    """
    i = F.col("id").cast("double")
    beta = F.least(
        1.0 - alpha_bar((i + 1.0) / n, kind) / alpha_bar(i / n, kind), F.lit(MAX_BETA)
    )
    run = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return spark.range(n).select(F.col("id").alias("step"), beta.alias("beta")).withColumn(
        "alpha_bar", F.exp(F.sum(F.log(1.0 - F.col("beta"))).over(run))
    )


# ---- one pose row; composed rotations go through staged columns ------------------


def _finish(df: DataFrame, out, values) -> DataFrame:
    """Write the results and drop the stages (columns starting with ``_``).

    The results pass through a one-row ``inline``: a later filter on them stops
    there instead of being substituted back through every stage.
    """
    keep = [c for c in df.columns if not c.startswith("_") and c not in out]
    row = F.struct(*[v.alias(n) for v, n in zip(values, out)])
    return df.select(*keep, F.inline(F.array(row)))


def flow_noise(df: DataFrame, t0, q0, t1, q1, s: Column, pose_out, field_out) -> DataFrame:
    """Forward noising at level ``s``: noised pose and target field as columns."""
    df, q1 = rot.stage(df, "unit", rot.normalize(q1))
    df, w = rot.stage(df, "log", rot.log_map(q1))
    df, turn = rot.stage(df, "turn", rot.exp_map(rot.scale(w, s)))
    x = tuple((1.0 - s) * a + s * b for a, b in zip(t0, t1))
    return _finish(
        df, (*pose_out, *field_out), (*x, *rot.multiply(turn, q0), *rot.sub(t1, t0), *w)
    )


def euler_step(t, q, v, w, delta: Column):
    """One integration step; ``delta`` is negative while the noise level falls."""
    return (
        rot.add(t, rot.scale(v, delta)),
        rot.multiply(rot.exp_map(rot.scale(w, delta)), q),
    )


def langevin_step(
    df: DataFrame, t, q, v, w, delta: Column, level: float, z_t, z_r, out
) -> DataFrame:
    """Euler step plus the stochastic-path term for given standard normals."""
    spread = level * F.sqrt(-delta)
    t1, q1 = euler_step(t, q, v, w, delta)
    df, q1 = rot.stage(df, "euler", q1)
    df, z = rot.stage(df, "kick", rot.scale(z_r, spread))
    df, turn = rot.stage(df, "turn", rot.exp_map(z))
    return _finish(
        df, out, (*rot.add(t1, rot.scale(z_t, spread)), *rot.multiply(q1, turn))
    )


def denoised(t, q, v, w, s: Column):
    """Pose estimate at level 0 from the pose and the field at level ``s``."""
    return euler_step(t, q, v, w, -s)


def diffusion_noise(df: DataFrame, t0, q0, e_t, e_r, abar: Column, out) -> DataFrame:
    """Forward diffusion in (translation, rotation vector) coordinates."""
    keep, add = F.sqrt(abar), F.sqrt(1.0 - abar)
    df, unit = rot.stage(df, "unit", rot.normalize(q0))
    df, w = rot.stage(df, "log", rot.log_map(unit))
    df, mixed = rot.stage(df, "mix", tuple(keep * a + add * b for a, b in zip(w, e_r)))
    x = tuple(keep * a + add * b for a, b in zip(t0, e_t))
    return _finish(df, out, (*x, *rot.exp_map(mixed)))


def diffusion_step(
    df: DataFrame, t, q, out_t, out_r, abar: Column, abar_prev: Column, out,
    prediction: str = "epsilon", z_t=None, z_r=None, step: Column | None = None,
) -> DataFrame:
    """Reverse diffusion step; noise ``z_*`` is added only where ``step`` > 0."""
    b, b_prev = 1.0 - abar, 1.0 - abar_prev
    a_cur = abar / abar_prev
    b_cur = 1.0 - a_cur

    def start(x, o):
        if prediction == "epsilon":
            return (x - F.sqrt(b) * o) / F.sqrt(abar)
        if prediction == "sample":
            return o
        if prediction == "v_prediction":
            return F.sqrt(abar) * x - F.sqrt(b) * o
        raise ValueError(f"unknown prediction type {prediction!r}")

    c_start = F.sqrt(abar_prev) * b_cur / b
    c_now = F.sqrt(a_cur) * b_prev / b

    def mean(xs, os):
        return tuple(c_start * start(x, o) + c_now * x for x, o in zip(xs, os))

    df, unit = rot.stage(df, "unit", rot.normalize(q))
    df, w = rot.stage(df, "log", rot.log_map(unit))
    nt, nr = mean(t, out_t), mean(w, out_r)
    if z_t is not None:
        spread = F.when(
            step > 0, F.sqrt(F.greatest(b_prev / b * b_cur, F.lit(VARIANCE_FLOOR)))
        ).otherwise(0.0)
        nt = rot.add(nt, rot.scale(z_t, spread))
        nr = rot.add(nr, rot.scale(z_r, spread))
    df, nr = rot.stage(df, "next", nr)
    return _finish(df, out, (*nt, *rot.exp_map(nr)))
