"""Local surface features of points from their nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import rot
from .metrics import PART
from .neighbors import knn

K = 16  # fixed value: neighbours per point
MIN_NEIGHBOURS = 2
VARIANCE_FLOOR = 1e-8
COV = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
PT = [*PART, "pt_idx"]


def neighbour_rows(points: DataFrame, k: int = K, block_bits: int = 8) -> DataFrame:
    """k nearest neighbours inside the fragment with the neighbour's position and normal.

    Columns: name, part_idx, pt_idx, nn, d2, bx..bz, bnx..bnz.
    """
    found = knn(points, k, PART, ["pt_idx"], block_bits)
    other = points.select(
        *PART, F.col("pt_idx").alias("n_pt_idx"),
        *[F.col(c).alias(f"b{c}") for c in ("x", "y", "z", "nx", "ny", "nz")],
    )
    return found.join(other, [*PART, "n_pt_idx"]).withColumnRenamed("q_pt_idx", "pt_idx")


def local_covariance(neighbours: DataFrame, unbiased: bool = True, around: tuple[str, ...] = ()) -> DataFrame:
    """Covariance of the neighbours; divisor k-1 (at least 1), or k when not ``unbiased``.

    ``around`` names columns to keep of every neighbour, as an array of k structs at most.
    """
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    n = F.count(F.lit(1))
    divisor = F.greatest(n - 1, F.lit(1)) if unbiased else n
    # co-moments from the JVM's running covariance, which never subtracts large squares
    return neighbours.groupBy(*PT).agg(
        n.alias("k"),
        *[F.avg(f"b{c}").alias(f"m{c}") for c in "xyz"],
        *[
            (F.covar_pop(f"b{p[0]}", f"b{p[1]}") * n / divisor).alias(f"c{p}") for p in pairs
        ],
        *([F.collect_list(F.struct(*around)).alias("around")] if around else []),
    )


def _mean_around(value) -> Column:
    """Mean of ``value`` over the neighbours kept in ``around``."""
    total = F.aggregate("around", F.lit(0.0), lambda acc, b: acc + value(b))
    return total / F.size("around")


def with_eigenvalues(cov: DataFrame) -> DataFrame:
    """l0 >= l1 >= l2 of the symmetric 3x3 matrix, in closed form.

    Shifts by the mean of the diagonal, then the three roots are cosines of one
    angle; a matrix that is a multiple of the identity has no angle.
    """
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in COV)
    df = cov.withColumn("_q", (xx + yy + zz) / 3.0)
    q = F.col("_q")
    p2 = (xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2.0 * (xy * xy + xz * xz + yz * yz)
    df = df.withColumn("_p", F.sqrt(p2 / 6.0))
    det = (
        (xx - q) * ((yy - q) * (zz - q) - yz * yz)
        - xy * (xy * (zz - q) - yz * xz)
        + xz * (xy * yz - (yy - q) * xz)
    )
    p = F.col("_p")
    half = F.when(p > 0, det / (2.0 * p * p * p)).otherwise(0.0)
    df = df.withColumn("_a", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3.0)
    df = df.withColumn("l0", q + 2.0 * p * F.cos("_a")).withColumn(
        "l2", q + 2.0 * p * F.cos(F.col("_a") + 2.0 * math.pi / 3.0)
    )
    return df.withColumn("l1", 3.0 * q - F.col("l0") - F.col("l2")).drop("_q", "_p", "_a")


# an explicit type: a DDL string would need a session when the module is loaded
@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"]))
def _smallest_axis(
    batches: Iterator[tuple[pd.Series, ...]],
) -> Iterator[pd.DataFrame]:
    for xx, xy, xz, yy, yz, zz in batches:
        m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=-1).reshape(-1, 3, 3)
        _, vectors = np.linalg.eigh(m)
        yield pd.DataFrame(vectors[:, :, 0], columns=["x", "y", "z"])


def with_local_normal(cov: DataFrame) -> DataFrame:
    """Axis of smallest variance as pnx, pny, pnz (sign arbitrary).

    Row-wise on Arrow batches; no grouping is involved.
    """
    return cov.withColumn("_e", _smallest_axis(*COV)).withColumns(
        {f"pn{c}": F.col(f"_e.{c}") for c in "xyz"}
    ).drop("_e")


def curvature() -> Column:
    """Share of the smallest eigenvalue."""
    total = F.greatest(F.col("l0") + F.col("l1") + F.col("l2"), F.lit(VARIANCE_FLOOR))
    return F.col("l2") / total


def feature_columns(
    use_normals: bool = True, use_curvature: bool = True, use_roughness: bool = True
) -> list[str]:
    """Columns an ablation switch set selects; normal consistency is always in."""
    names = ["normal_consistency"]
    if use_normals:
        names += ["nx", "ny", "nz"]
    if use_curvature:
        names.append("curvature")
    if use_roughness:
        names.append("roughness")
    return names


def surface_features(points: DataFrame, k: int = K, block_bits: int = 8) -> DataFrame:
    """Normal consistency, curvature and roughness of every point.

    Points with fewer than two neighbours get zeros throughout.
    """
    near = neighbour_rows(points, k, block_bits)
    local = with_local_normal(with_eigenvalues(local_covariance(near, around=("bx", "by", "bz")))).where(
        F.col("k") >= MIN_NEIGHBOURS
    )
    axis, mid = rot.cols("pnx", "pny", "pnz"), rot.cols("mx", "my", "mz")

    def off_plane(b):
        return F.abs(rot.dot(rot.sub(tuple(b[c] for c in ("bx", "by", "bz")), mid), axis))

    shaped = local.select(
        *PT, "pnx", "pny", "pnz", curvature().alias("curvature"), _mean_around(off_plane).alias("roughness")
    )
    df = points.join(shaped, PT, "left").withColumn("_ok", F.col("curvature").isNotNull())
    consistency = F.abs(rot.dot(rot.cols("nx", "ny", "nz"), axis))
    ok = F.col("_ok")
    return df.withColumns(
        {
            "normal_consistency": F.coalesce(consistency, F.lit(0.0)),
            "curvature": F.coalesce("curvature", F.lit(0.0)),
            "roughness": F.coalesce("roughness", F.lit(0.0)),
            **{c: F.when(ok, F.col(c)).otherwise(0.0) for c in ("nx", "ny", "nz")},
        }
    ).drop("pnx", "pny", "pnz", "_ok")


def notes_features(points: DataFrame, k: int = K, block_bits: int = 8) -> DataFrame:
    """Alternative set: surface variation, mean curvature, 1 - mean normal agreement."""
    near = neighbour_rows(points, k, block_bits)
    values = with_eigenvalues(local_covariance(near, unbiased=False, around=("bnx", "bny", "bnz")))
    total = F.col("l0") + F.col("l1") + F.col("l2")
    shaped = values.select(
        *PT, "around",
        F.when(total > VARIANCE_FLOOR, F.col("l2") / total).otherwise(0.0).alias("surface_variation"),
        ((F.col("l0") - F.col("l2")) / 2.0).alias("mean_curvature"),
    )

    def agree(b):
        return rot.dot(rot.cols("nx", "ny", "nz"), tuple(b[c] for c in ("bnx", "bny", "bnz")))

    own = points.select(*PT, "nx", "ny", "nz")
    return shaped.join(own, PT).withColumn("normal_consistency", 1.0 - _mean_around(agree)).drop("around", "nx", "ny", "nz")
