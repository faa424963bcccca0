"""Result documents: per-object JSON, assembly JSON, metrics CSV, and reading back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.poses import GT_COLS, PR_COLS

_POSE = T.ArrayType(T.DoubleType())
_NUMBERS = ("part_acc", "rmse_t", "rmse_r", "shape_cd")
_NAMES = ("removal_pieces", "redundant_pieces", "pieces")
# Parts per document; an object with more parts continues in further documents.
CHUNK_PARTS = 1024

RESULT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("num_parts", T.LongType()),
        T.StructField("part_ids", T.ArrayType(T.LongType())),
        T.StructField("gt_trans_rots", T.ArrayType(_POSE)),
        T.StructField("pred_trans_rots", T.ArrayType(T.ArrayType(_POSE))),
        *[T.StructField(c, T.DoubleType()) for c in _NUMBERS],
        *[T.StructField(c, T.StringType()) for c in _NAMES],
        T.StructField("mesh_scale", T.DoubleType()),
    ]
)


def _chunk():
    return F.floor(F.col("part_idx") / CHUNK_PARTS).cast("long")


def result_documents(poses: DataFrame, trajectory: DataFrame, report: DataFrame) -> DataFrame:
    """One result document per object (and chunk of its parts).

    ``trajectory`` is (name, part_idx, step, tx..qz).  The prediction is an array
    over steps of an array over parts, as result files have it; ``part_ids`` names the
    parts in that order, so gaps in the numbering survive.  A report with a ``chunk``
    column is met chunk by chunk.
    """
    keys = ["name", "chunk"] if "chunk" in report.columns else ["name"]
    gt = poses.groupBy("name", _chunk().alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("part_idx", F.array(*GT_COLS).alias("p")))).alias("_gt")
    )
    pose = F.array("tx", "ty", "tz", "qw", "qx", "qy", "qz").alias("p")
    by_step = trajectory.groupBy("name", _chunk().alias("chunk"), "step").agg(
        F.sort_array(F.collect_list(F.struct("part_idx", pose))).alias("_s")
    )
    # one entry per schedule step, each at most CHUNK_PARTS poses
    steps = by_step.groupBy("name", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("step", "_s"))).alias("_steps")
    )
    poses_of = lambda a: F.transform(a, lambda s: s["p"])
    return gt.join(steps, ["name", "chunk"]).join(report, keys).select(
        F.col("name").cast("string").alias("name"), "chunk", "num_parts",
        F.transform("_gt", lambda s: s["part_idx"].cast("long")).alias("part_ids"),
        poses_of(F.col("_gt")).alias("gt_trans_rots"),
        F.transform("_steps", lambda s: poses_of(s["_s"])).alias("pred_trans_rots"),
        *_NUMBERS, *_NAMES, "mesh_scale",
    )


def write_results(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).json(path)


def final_poses(documents: DataFrame) -> DataFrame:
    """(name, part_idx, truth and last prediction) rows from result documents."""
    last = F.element_at("pred_trans_rots", -1)
    rows = documents.select(
        "name", F.explode(F.arrays_zip(F.col("part_ids").alias("i"), F.col("gt_trans_rots").alias("g"), last.alias("p"))).alias("_z")
    )
    return rows.select(
        "name", F.col("_z.i").alias("part_idx"),
        *[F.col("_z.g")[i].alias(c) for i, c in enumerate(GT_COLS)],
        *[F.col("_z.p")[i].alias(c) for i, c in enumerate(PR_COLS)],
    )


def trajectory_rows(documents: DataFrame) -> DataFrame:
    """(name, part_idx, step, tx..qz): the nested prediction unfolded twice."""
    steps = documents.select("name", "part_ids", F.posexplode("pred_trans_rots").alias("step", "_poses"))
    rows = steps.select("name", "part_ids", "step", F.posexplode("_poses").alias("_i", "_p"))
    return rows.select(
        "name", F.get("part_ids", F.col("_i")).alias("part_idx"),
        F.col("step").cast("long").alias("step"),
        *[F.col("_p")[i].alias(c) for i, c in enumerate(("tx", "ty", "tz", "qw", "qx", "qy", "qz"))],
    )


ASSEMBLY = T.StructType(
    [
        T.StructField("name", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("num_parts", T.LongType()),
        T.StructField("part_ids", T.ArrayType(T.LongType())),
        *[T.StructField(c, T.DoubleType()) for c in _NUMBERS],
        T.StructField("gt_transform", T.ArrayType(_POSE)), T.StructField("pred_transform", T.ArrayType(_POSE)),
        *[T.StructField(c, T.StringType()) for c in _NAMES], T.StructField("mesh_scale", T.DoubleType()),
    ]
)


def assembly_documents(documents: DataFrame) -> DataFrame:
    """Final poses and metrics per object, without the trajectory."""
    return documents.withColumns(
        {"gt_transform": F.col("gt_trans_rots"), "pred_transform": F.element_at("pred_trans_rots", -1)}
    ).select(*ASSEMBLY.names)


def write_assemblies(documents: DataFrame, path: str) -> None:
    """One line per object (and chunk), clustered by name: as many files as tasks, not as objects."""
    assembly_documents(documents).repartitionByRange("name", "chunk").sortWithinPartitions("name", "chunk").write.mode(
        "overwrite"
    ).json(path)


def read_assemblies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ASSEMBLY).json(path)


def assembly_poses(assemblies: DataFrame) -> DataFrame:
    """(name, chunk, part_idx, truth and prediction) rows; part ids keep their gaps."""
    rows = assemblies.select("name", "chunk", F.explode(F.arrays_zip("part_ids", "gt_transform", "pred_transform")).alias("_z"))
    return rows.select(
        "name", "chunk", F.col("_z.part_ids").alias("part_idx"),
        *[F.col("_z.gt_transform")[i].alias(c) for i, c in enumerate(GT_COLS)],
        *[F.col("_z.pred_transform")[i].alias(c) for i, c in enumerate(PR_COLS)],
    )


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("header", True).csv(path)


def piece_names(pieces: DataFrame, out: str) -> DataFrame:
    """Comma-joined piece names per object and chunk of parts, in part order."""
    listed = F.sort_array(F.collect_list(F.struct("part_idx", "piece")))
    return pieces.groupBy("name", _chunk().alias("chunk")).agg(
        F.array_join(F.transform(listed, lambda s: s["piece"]), ",").alias(out)
    )


