"""Reassembly-shaped views of the TPC-H style test tables.

Each builder derives one input table of the data model (poses, point clouds,
meshes, ...) from the parquet tables by a rule that keeps growing with them:
more rows give more objects, not bigger ones, except for the point clouds, whose
object k has 2k+1 parts so that object sizes vary widely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.ordering import with_rank
from .session import materialize

POINTS_PER_VECTOR = 21
_CACHE: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cached(spark: SparkSession, sf_dir: str, kind: str, build) -> DataFrame:
    """Inputs several queries share are written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _CACHE:
        _CACHE[key] = materialize(build(), kind)
    return _CACHE[key]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id -> (name, part_idx): object k owns the ids k*k .. k*k+2k."""
    name = F.floor(F.sqrt(F.col("vec_id").cast("double"))).cast("bigint")
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", name.alias("name"), F.col("embedding").cast("array<double>").alias("e"))
        .withColumn("part_idx", F.col("vec_id") - F.col("name") * F.col("name"))
    )


def points(spark: SparkSession, sf_dir: str, variable: bool = True) -> DataFrame:
    """Oriented, labelled point cloud; ``variable`` keeps 5..20 points per part."""
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(POINTS_PER_VECTOR - 1).cast("bigint"))
    df = _vectors(spark, sf_dir).withColumn("pt_idx", F.explode(every))
    if variable:
        df = df.where("pt_idx < 5 + vec_id % 17")
    e = F.col("e")

    def at(offset):
        return F.get(e, offset.cast("int"))

    base = F.col("pt_idx") * 3
    nbase = ((F.col("pt_idx") + 1) % POINTS_PER_VECTOR) * 3
    df = df.select(
        "name", "part_idx", "pt_idx",
        *[at(base + i).alias(c) for i, c in enumerate("xyz")],
        *[at(nbase + i).alias(c) for i, c in enumerate(("_nx", "_ny", "_nz"))],
    )
    length = F.sqrt(F.col("_nx") ** 2 + F.col("_ny") ** 2 + F.col("_nz") ** 2)
    return df.withColumn("_n", length).select(
        "name", "part_idx", "pt_idx", "x", "y", "z",
        (F.col("_nx") / F.col("_n")).alias("nx"),
        (F.col("_ny") / F.col("_n")).alias("ny"),
        (F.col("_nz") / F.col("_n")).alias("nz"),
        (F.col("z") > 0).cast("bigint").alias("frac"),
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth and predicted pose of every part, one row per part."""
    df = _vectors(spark, sf_dir)
    e = [F.col("e")[i] for i in range(14)]
    gt_q = e[3:7]
    pred_q = [e[3 + i] + 0.2 * e[10 + i] for i in range(4)]
    df = df.select(
        "name", "part_idx",
        *[e[i].alias(f"gt_t{c}") for i, c in enumerate("xyz")],
        *[(e[i] + 0.1 * e[7 + i]).alias(f"pr_t{c}") for i, c in enumerate("xyz")],
        *[q.alias(f"_g{c}") for q, c in zip(gt_q, "wxyz")],
        *[q.alias(f"_p{c}") for q, c in zip(pred_q, "wxyz")],
    )
    for side in "gp":
        df = df.withColumn(
            f"_n{side}", F.sqrt(sum((F.col(f"_{side}{c}") ** 2 for c in "xyz"), F.col(f"_{side}w") ** 2))
        )
    return df.select(
        "name", "part_idx",
        "gt_tx", "gt_ty", "gt_tz",
        *[(F.col(f"_g{c}") / F.col("_ng")).alias(f"gt_q{c}") for c in "wxyz"],
        "pr_tx", "pr_ty", "pr_tz",
        *[(F.col(f"_p{c}") / F.col("_np")).alias(f"pr_q{c}") for c in "wxyz"],
    )


def field(spark: SparkSession, sf_dir: str, steps: int = 20) -> DataFrame:
    """Vector field per part and integration step, constant over the steps."""
    e = F.col("e")
    return (
        _vectors(spark, sf_dir)
        .select(
            "name", "part_idx",
            *[(0.1 * e[14 + i]).alias(f"v{c}") for i, c in enumerate("xyz")],
            *[(0.1 * e[17 + i]).alias(f"w{c}") for i, c in enumerate("xyz")],
        )
        .withColumn(
            "step",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(steps - 1).cast("bigint"))),
        )
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fracture score per point next to its label."""
    return points(spark, sf_dir).select(
        "name", "part_idx", "pt_idx",
        F.col("frac").alias("gt"),
        (8 * F.col("z") + 4 * F.col("x")).alias("logit"),
    ).withColumn("score", 1 / (1 + F.exp(-F.col("logit"))))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderstatus").alias("split"),
        F.col("o_orderkey").cast("string").alias("name"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object/piece list: an order's distinct line numbers are its pieces."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").cast("bigint").alias("part_idx"))
        .distinct()
    )


# Orders per mesh object: the dense form gives every piece pair a common vertex,
# the sparse form leaves contact graphs with gaps.
MESH_DENSE = 150
MESH_SPARSE = 15


def vertices(spark: SparkSession, sf_dir: str, orders: int = MESH_DENSE) -> DataFrame:
    """Lattice vertices of the pieces; v_idx is dense inside each piece."""

    def build():
        rows = table(spark, sf_dir, "lineitem").select(
            F.floor(F.col("l_orderkey") / orders).cast("bigint").alias("name"),
            (F.col("l_linenumber") - 1).cast("bigint").alias("part_idx"),
            "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
        )
        order = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]
        return with_rank(rows, ["name", "part_idx"], order, out="v_idx").select(
            "name", "part_idx", "v_idx",
            (F.col("l_quantity").cast("int") % 10).cast("double").alias("x"),
            (F.round(F.col("l_discount") * 100).cast("int") % 6).cast("double").alias("y"),
            (F.round(F.col("l_tax") * 100).cast("int") % 3).cast("double").alias("z"),
        )

    return cached(spark, sf_dir, f"vertices{orders}", build)


def faces(spark: SparkSession, sf_dir: str, orders: int = MESH_DENSE) -> DataFrame:
    """Triangle strip over the vertices of each piece: face f = (f, f+1, f+2)."""
    # v_idx is a rank, so every vertex from the third on closes a face.
    first = (F.col("v_idx") - 2).cast("bigint")
    return vertices(spark, sf_dir, orders).where("v_idx >= 2").select(
        "name", "part_idx", first.alias("f_idx"), first.alias("a"), (first + 1).alias("b"), (first + 2).alias("c")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# Event type of the table -> type of the progress message.
MESSAGE_OF = {"view": "transformation", "click": "fracture_segmentation", "purchase": "metrics", "error": "end"}


def messages(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Progress messages (run_id, seq, ts, message) of assembly runs, as JSON text.

    ``spread`` deals the events over tasks before their messages are written: a file of events is
    read by few tasks, being small, and its messages are not.

    A user's events are a run.  Of 97 events one breaks off, one has a type nobody knows and, if it
    brings poses, one lacks their rotations.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    parts = F.sequence(F.lit(0), k % 3)

    def per_part(body):
        return F.transform(parts, body)

    def number(c):
        return c.cast("double")

    rows = events(spark, sf_dir)
    if spread:
        rows = rows.repartition("event_id", "user_id", "ts")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", k)
    value, lacks = F.col("value"), F.col("event_id") % 97
    clouds = per_part(lambda p: F.transform(
        F.sequence(F.lit(0), (F.col("k") + p) % 4), lambda i: F.array(number(p), number(i), value)
    ))
    translation = per_part(lambda p: F.array(value + p, number(F.col("k")), number(p)))
    rotation = per_part(lambda p: F.array(F.lit(1.0), p / 10, F.col("k") / 100, value / 100))
    said = [
        ("mesh_scale", F.to_json(F.struct(F.lit("mesh_scale").alias("type"), value.alias("data")))),
        ("input", F.to_json(F.struct(F.lit("input").alias("type"), F.struct(
            clouds.alias("pointclouds"), translation.alias("initial_translation"), rotation.alias("initial_rotation")
        ).alias("data")))),
        ("transformation", F.to_json(F.struct(F.lit("transformation").alias("type"), F.struct(
            translation.alias("translation"), F.when(lacks != 7, rotation).alias("rotation"),
            (F.col("k") % 21 - 1).alias("step"), F.floor(F.col("k") / 21).alias("iter"),
        ).alias("data")))),
        ("fracture_segmentation", F.to_json(F.struct(F.lit("fracture_segmentation").alias("type"), clouds.alias("data")))),
        ("metrics", F.to_json(F.struct(F.lit("metrics").alias("type"), F.struct(
            (value / 100).alias("Part Accuracy"), (value * 2).alias("Shape CD (10<sup>-3</sup>)"),
            number(F.col("k")).alias("RMSE(R) (Degrees)"), (F.col("k") / 10).alias("RMSE(T) (10<sup>-2</sup>)"),
        ).alias("data")))),
        ("end", F.lit('{"type": "end", "data": null}')),
    ]
    kind = F.create_map(*[F.lit(x) for pair in MESSAGE_OF.items() for x in pair])[F.col("event_type")]
    kind = F.coalesce(kind, F.when(F.col("k") % 2 == 0, "mesh_scale").otherwise("input"))
    message = F.coalesce(*[F.when(kind == name, text) for name, text in said])
    message = (
        F.when(lacks == 5, F.substring(message, 1, 15))
        .when(lacks == 6, F.regexp_replace(message, r'"type": ?"\w+"', '"type":"restart"'))
        .otherwise(message)
    )
    return rows.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", message.alias("message"))
