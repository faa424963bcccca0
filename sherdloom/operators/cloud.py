"""Point-cloud preparation: recentre, rotate, shuffle, scale, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rot
from ..functions.rand import DEFAULT_SEED, hash_key, hash_quaternion, hash_uniform, shuffled_position
from .metrics import PART
from .ordering import with_rank

XYZ = ("x", "y", "z")
NRM = ("nx", "ny", "nz")
ANCHOR_SHARE = 0.05  # fixed value: an anchor holds more than this share of the budget


def centroids(points: DataFrame) -> DataFrame:
    """Mean of every part: its ground-truth translation."""
    return points.groupBy(*PART).agg(
        *[F.avg(c).alias(t) for c, t in zip(XYZ, ("gt_tx", "gt_ty", "gt_tz"))]
    )


def recenter(points: DataFrame) -> DataFrame:
    """Points relative to their part's mean, which stays as gt_t*."""
    df = points.join(centroids(points), PART)
    return df.withColumns({c: F.col(c) - F.col(f"gt_t{c}") for c in XYZ})


def rotate_by(df: DataFrame, q: tuple[Column, ...]) -> DataFrame:
    """Rotate points and normals by ``q``."""
    names = [f"_r{c}" for c in "wxyz"]
    df = rot.with_tuple(df, names, q)
    turn = rot.cols(*names)
    moved = dict(zip(XYZ, rot.rotate(turn, rot.cols(*XYZ))))
    moved.update(zip(NRM, rot.rotate(turn, rot.cols(*NRM))))
    return df.withColumns(moved).drop(*names)


def rotate_parts(df: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """Turn every part by its own random rotation; gt_q* undoes it."""
    q = hash_quaternion(seed, *PART)
    df = rot.with_tuple(df, ("gt_qw", "gt_qx", "gt_qy", "gt_qz"), rot.conjugate(q))
    return rotate_by(df, rot.conjugate(rot.cols("gt_qw", "gt_qx", "gt_qy", "gt_qz")))


def rotate_objects(df: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """Turn all parts of an object by the same random rotation; init_q* undoes it."""
    q = hash_quaternion(seed, F.lit("object"), "name")
    names = ("init_qw", "init_qx", "init_qy", "init_qz")
    df = rot.with_tuple(df, names, rot.conjugate(q))
    return rotate_by(df, rot.conjugate(rot.cols(*names)))


def shuffle(points: DataFrame, seed: int = DEFAULT_SEED, out: str = "order_idx") -> DataFrame:
    """Random 0-based position of every point inside its part.

    ``pt_idx`` numbers the points of a part without gaps; its place in the order is computed from
    it, so nothing is sorted.  A row keeps all its columns: coordinates, normals and labels move together.
    """
    sizes = points.groupBy(*PART).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", hash_key(seed, F.lit("shuffle"), *PART))
    gap = F.raise_error(F.lit("points of a part are not numbered without gaps")).cast("long")
    at = F.when(F.col("pt_idx") < F.col("_n"), F.col("pt_idx")).otherwise(gap)
    placed = shuffled_position(at, F.col("_n"), F.col("_key"))
    return points.join(sizes, PART).withColumn(out, placed).drop("_n", "_key")


def part_scales(points: DataFrame, zero_as_one: bool = False) -> DataFrame:
    """Largest absolute coordinate of every part."""
    top = F.max(F.greatest(*[F.abs(F.col(c)) for c in XYZ]))
    df = points.groupBy(*PART).agg(top.alias("scale"), F.count(F.lit(1)).alias("n_points"))
    if zero_as_one:
        df = df.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))
    return df


def divide_by_scale(points: DataFrame, parts: DataFrame) -> DataFrame:
    df = points.join(parts.select(*PART, "scale"), PART)
    return df.withColumns({c: F.col(c) / F.col("scale") for c in XYZ})


def multiply_by_scale(points: DataFrame, parts: DataFrame) -> DataFrame:
    df = points.join(parts.select(*PART, "scale"), PART)
    return df.withColumns({c: F.col(c) * F.col("scale") for c in XYZ})


def anchor_parts(parts: DataFrame, by: str = "n_points") -> DataFrame:
    """(name, anchor): first part with the largest ``by`` among non-redundant parts.

    ``parts`` has num_parts and redundancy; redundant parts are the last ones.
    """
    own = parts.where(F.col("part_idx") < F.col("num_parts") - F.col("redundancy"))
    return own.groupBy("name").agg(
        F.max_by("part_idx", F.struct(F.col(by), -F.col("part_idx"))).alias("anchor")
    )


def eligible_anchors(parts: DataFrame, num_points: int) -> DataFrame:
    """Parts with more than 5 % of the point budget."""
    return parts.where(F.col("n_points") > ANCHOR_SHARE * num_points)


def mark_references(
    parts: DataFrame, num_points: int, random_anchor: bool = False, multi_ref: bool = False,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Add ``is_ref``: the anchor and, in multi-reference mode, some further parts.

    A random anchor is any eligible part, distractors included.  Multi-reference
    marks, with probability 1 - 1/P for P > 2, between 1 and min(eligible, P-2)
    more eligible parts.
    """
    fixed = anchor_parts(parts)
    can = eligible_anchors(parts, num_points)
    if random_anchor:
        drawn = can.groupBy("name").agg(
            F.min_by("part_idx", hash_key(seed, F.lit("anchor"), *PART)).alias("anchor")
        )
        fixed = drawn
    df = parts.join(fixed, "name", "left").withColumn(
        "is_ref", F.coalesce(F.col("part_idx") == F.col("anchor"), F.lit(False))
    )
    if not multi_ref:
        return df.drop("anchor")
    more = can.join(fixed, "name").where("part_idx <> anchor")
    more = with_rank(
        more.withColumn("_h", hash_key(seed, F.lit("more"), *PART)), ["name"], ["_h", "part_idx"], "_r"
    )
    counts = more.groupBy("name").agg(
        F.count(F.lit(1)).alias("_m"), F.first("num_parts").alias("_p")
    )
    most = F.least(F.col("_m"), F.col("_p") - 2)
    wanted = counts.select(
        "name",
        F.when(
            (F.col("_p") > 2) & (hash_uniform(seed, F.lit("if"), "name") > 1.0 / F.col("_p")),
            F.floor(hash_uniform(seed, F.lit("how many"), "name") * most) + 1,
        )
        .otherwise(0)
        .alias("_want"),
    )
    chosen = (
        more.join(wanted, "name").where(F.col("_r") < F.col("_want"))
        .select(*PART, F.lit(True).alias("_more"))
    )
    return (
        df.join(chosen, PART, "left")
        .withColumn("is_ref", F.col("is_ref") | F.coalesce("_more", F.lit(False)))
        .drop("_more", "anchor")
    )


def clear_references(parts: DataFrame) -> DataFrame:
    """Anchor-free mode: no part is fixed."""
    return parts.withColumn("is_ref", F.lit(False))
