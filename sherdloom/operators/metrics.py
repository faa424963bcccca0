"""Segmentation, pose and Chamfer metrics over long tables.

Per-part values are row expressions; per-object values are plain aggregates, so
partial aggregation runs before every shuffle.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rot
from .neighbors import mutual_nearest
from .ordering import prefix_sum

PART = ["name", "part_idx"]
PART_CD_THRESHOLD = 0.01  # fixed value: a part below it counts as placed



def gt_t():
    return rot.cols("gt_tx", "gt_ty", "gt_tz")


def gt_q():
    return rot.cols("gt_qw", "gt_qx", "gt_qy", "gt_qz")


def pr_t():
    return rot.cols("pr_tx", "pr_ty", "pr_tz")


def pr_q():
    return rot.cols("pr_qw", "pr_qx", "pr_qy", "pr_qz")


def valid_mean(value: Column) -> Column:
    """Mean that counts NaN as 0 but keeps its row in the denominator."""
    return F.sum(F.nanvl(value, F.lit(0.0))) / F.count(F.lit(1))


def _reduce(diffs, metric: str) -> Column:
    if metric == "mae":
        return sum((F.abs(d) for d in diffs[1:]), F.abs(diffs[0])) / len(diffs)
    mse = sum((d * d for d in diffs[1:]), diffs[0] * diffs[0]) / len(diffs)
    if metric == "mse":
        return mse
    if metric == "rmse":
        return F.sqrt(mse)
    raise ValueError(f"unknown metric {metric!r}")


def translation_error(pred, gt, metric: str = "rmse") -> Column:
    """Error of one part over its three axes."""
    return _reduce(rot.sub(pred, gt), metric)


def rotation_error(pred, gt, metric: str = "rmse") -> Column:
    """Error of one part over its three Euler angles in degrees, wrapped at 360."""
    a, b = rot.euler_xyz(pred), rot.euler_xyz(gt)
    wrapped = [F.least(F.abs(x - y), 360.0 - F.abs(x - y)) for x, y in zip(a, b)]
    return _reduce(wrapped, metric)


def pose_metrics(poses: DataFrame, metric: str = "rmse") -> DataFrame:
    """Per-object translation and rotation error of valid parts."""
    return poses.groupBy("name").agg(
        valid_mean(translation_error(pr_t(), gt_t(), metric)).alias(f"{metric}_t"),
        valid_mean(rotation_error(pr_q(), gt_q(), metric)).alias(f"{metric}_r"),
    )


def drop_redundant(parts: DataFrame, redundancy: Column | int) -> DataFrame:
    """Keep the first ``num_parts - redundancy`` parts that have points.

    ``parts`` carries n_points and num_parts; the running count of valid parts is
    a blocked prefix sum.
    """
    redundancy = F.lit(redundancy) if isinstance(redundancy, int) else redundancy
    run = prefix_sum(
        parts, ["name"], "part_idx", (F.col("n_points") != 0).cast("long"), "valid_rank"
    )
    return run.where((F.col("n_points") != 0) & (F.col("valid_rank") <= F.col("num_parts") - redundancy))


def confusion(gt: Column, pred: Column) -> list[Column]:
    return [
        F.count_if(pred & gt).alias("tp"),
        F.count_if(pred & ~gt).alias("fp"),
        F.count_if(~pred & gt).alias("fn"),
        F.count_if(~pred & ~gt).alias("tn"),
    ]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def segmentation_report(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, recall, precision, F1 at 0.5 and soft Dice loss, micro over all points."""
    gt, pred = F.col("gt") == 1, F.col("score") > 0.5
    p, g = F.col("score"), F.col("gt").cast("double")
    agg = scores.groupBy(*(keys or [])).agg(
        *confusion(gt, pred),
        F.sum(p * g).alias("_pg"), F.sum(p).alias("_p"), F.sum(g).alias("_g"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return agg.select(
        *(keys or []), "tp", "fp", "fn", "tn",
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        dice_loss(F.col("_pg"), F.col("_p"), F.col("_g")).alias("dice_loss"),
    )


def dice_loss(pg: Column, p: Column, g: Column, smooth: float = 1e-6) -> Column:
    """Soft Dice loss from the three sums it needs."""
    return 1.0 - (2.0 * pg + smooth) / (p + g + smooth)


def placed_points(points: DataFrame, poses: DataFrame, scaled: bool = False) -> DataFrame:
    """Every point under its part's true and predicted pose.

    A plain equi-join on the part; whether the pose side is broadcast is left to
    the size statistics at run time.
    """
    joined = points.join(poses, PART)
    p = rot.cols("x", "y", "z")
    if scaled:
        p = rot.scale(p, F.col("scale"))
    true, pred = rot.transform(gt_t(), gt_q(), p), rot.transform(pr_t(), pr_q(), p)
    return joined.select(
        *PART, "pt_idx",
        *[c.alias(f"g{a}") for c, a in zip(true, "xyz")],
        *[c.alias(f"p{a}") for c, a in zip(pred, "xyz")],
    )


def placement_distances(placed: DataFrame, keys: list[str], written: bool = False) -> DataFrame:
    """``d2`` of every point to the other placement of its key: side 0 true, 1 predicted.

    ``written`` says that ``placed`` is a written table, which may be read several times.
    """
    sides = [
        placed.select(
            *PART, "pt_idx", F.lit(n).alias("side"), *[F.col(f"{p}{a}").alias(a) for a in "xyz"]
        )
        for n, p in enumerate("gp")
    ]
    ids = [c for c in [*PART, "pt_idx"] if c not in keys]
    return mutual_nearest(sides[0].unionByName(sides[1]), keys, ids, written=written)


def _per_part(distances: DataFrame) -> DataFrame:
    # both directions hold the same number of rows, so this is mean + mean
    return distances.groupBy(*PART).agg(
        (F.sum("d2") / F.count_if(F.col("side") == 0)).alias("chamfer")
    )


def part_chamfer(placed: DataFrame, written: bool = False) -> DataFrame:
    """Chamfer distance of every part between its two placements (mean + mean)."""
    return _per_part(placement_distances(placed, PART, written))


def part_accuracy(chamfer: DataFrame) -> DataFrame:
    """Share of an object's parts whose Chamfer distance is under the threshold."""
    ok = F.count_if(F.col("chamfer") < PART_CD_THRESHOLD)
    return chamfer.groupBy("name").agg(
        (ok / F.count(F.lit(1))).alias("part_acc"), F.count(F.lit(1)).alias("num_parts")
    )


def shape_chamfer(placed: DataFrame, written: bool = False) -> DataFrame:
    """Whole-object Chamfer: per point both directions summed, mean per part, then object."""
    per_part = _per_part(placement_distances(placed, ["name"], written))
    return per_part.groupBy("name").agg(valid_mean(F.col("chamfer")).alias("shape_cd"))


def flow_losses(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Vector-field, translation and rotation losses over pose rows.

    Needs field and target columns ``f*``/``t*`` (vx..wz) beside the two poses.
    The angle loss keeps the quaternion sign and has no factor 2.
    """
    comps = ("vx", "vy", "vz", "wx", "wy", "wz")
    vec = sum(((F.col(f"f_{c}") - F.col(f"t_{c}")) ** 2 for c in comps), F.lit(0.0)) / 6.0
    trans = translation_error(pr_t(), gt_t(), "mse")
    quat = sum(((a - b) ** 2 for a, b in zip(pr_q(), gt_q())), F.lit(0.0)) / 4.0
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rot.dot(pr_q(), gt_q())))
    angle = F.degrees(F.acos(cosine))
    return df.groupBy(*(keys or [])).agg(
        F.avg(vec).alias("vec_mse_loss"),
        F.avg(trans).alias("trans_mse_loss"),
        F.avg(quat).alias("rot_mse_loss"),
        F.sqrt(F.avg(angle * angle)).alias("rot_rmse"),
    )


def run_summary(per_object: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean of the four report metrics over objects."""
    return per_object.groupBy(*(keys or [])).agg(
        *[F.avg(c).alias(c) for c in ("part_acc", "rmse_t", "rmse_r", "shape_cd")]
    )


def display_units(df: DataFrame) -> DataFrame:
    """Report units: Chamfer in 10^-3 and translation error in 10^-2."""
    return df.withColumns(
        {"shape_cd": F.col("shape_cd") * 1e3, "rmse_t": F.col("rmse_t") * 1e2}
    )




def diffusion_loss(
    df: DataFrame, pred: list[str], noise: list[str], is_ref: Column, keys: list[str]
) -> DataFrame:
    """Mean squared noise error over the rows that are no reference."""
    err = sum(((F.col(p) - F.col(n)) ** 2 for p, n in zip(pred, noise)), F.lit(0.0)) / len(pred)
    return df.where(~is_ref).groupBy(*keys).agg(F.avg(err).alias("mse_loss"))


def epoch_means(log: DataFrame) -> DataFrame:
    """Epoch value of every step metric: the mean of its step rows."""
    return log.groupBy("stage", "epoch").agg(
        F.count(F.lit(1)).alias("steps"), F.avg("value").alias("metric_mean")
    )
