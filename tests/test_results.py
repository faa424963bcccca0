"""Result documents of large and of gapped objects survive the JSON round trip."""

from pyspark.sql import functions as F
import pytest

from sherdloom.operators.poses import GT_COLS, PR_COLS
from sherdloom.operators.sampling import allocate_budget
from sherdloom.sources import results as R


def test_large_and_gapped_objects(spark, tmp_path):
    ids = spark.range(1500).select(F.lit("large").alias("name"), F.col("id").alias("part_idx")).unionByName(
        spark.range(5).select(F.lit("gaps").alias("name"), (F.col("id") * 700).alias("part_idx"))
    )
    poses = ids.select("*", *[(F.col("part_idx") + k / 10).alias(c) for k, c in enumerate([*GT_COLS, *PR_COLS])])
    pose = ["tx", "ty", "tz", "qw", "qx", "qy", "qz"]
    steps = poses.crossJoin(spark.range(2).withColumnRenamed("id", "step")).select(
        "name", "part_idx", "step", *[(F.col(p) + F.col("step")).alias(c) for p, c in zip(PR_COLS, pose)]
    )
    names = R.piece_names(ids.withColumn("piece", F.concat(F.lit("p"), "part_idx")), "pieces")
    report = names.select(
        "name", "chunk", F.lit(0).cast("long").alias("num_parts"), *[F.lit(0.0).alias(c) for c in ("part_acc", "rmse_t", "rmse_r", "shape_cd")],
        F.lit("").alias("removal_pieces"), F.lit("").alias("redundant_pieces"), "pieces", F.lit(1.0).alias("mesh_scale"),
    )
    path = str(tmp_path / "results")
    R.write_results(R.result_documents(poses, steps, report), path)
    back = R.read_results(spark, path)
    got = {(r["name"], r["part_idx"]): r[GT_COLS[0]] for r in R.final_poses(back).collect()}
    assert got == {(r["name"], r["part_idx"]): r[GT_COLS[0]] for r in poses.collect()}
    assert R.trajectory_rows(back).select("name", "part_idx", "step").distinct().count() == 2 * 1505
    listed = sorted(p for r in back.collect() for p in r["pieces"].split(",") if r["name"] == "large")
    assert listed == sorted(f"p{k}" for k in range(1500))


def test_budget_refuses_objects_that_cannot_have_the_floor(spark):
    parts = spark.range(300).select(F.lit(1).alias("name"), F.col("id").alias("part_idx"), F.lit(1.0).alias("area"))
    assert allocate_budget(parts, 6000).agg(F.sum("n_points")).first()[0] == 6000
    with pytest.raises(Exception, match="cannot give every part"):
        allocate_budget(parts, 5000).collect()
