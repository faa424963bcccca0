"""Whole preparation jobs over the mesh tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import mesh
from ..operators.metrics import PART
from ..plans import prepare as PP
from ..session import fresh_path
from ..sources import mesh_files as MF
from . import duck
from .clouds import _ALLOC
from .meshes import DENSE, EDGES, GEOM, MEASURES, PRIO, SHARED, labelled
from .poses import rounded
from .registry import query
from .tables import BROKEN, mesh_folder, mesh_folder_tables


@query(
    "d02_object_preparation",
    f"""WITH {DENSE}, {SHARED}, {EDGES}, {GEOM}, {MEASURES}, {PRIO},
    f AS (SELECT name, count(*) AS n_faces, count(*) FILTER (shared_with <> -1) AS n_fracture,
      CAST(sum((f_idx + 1) * (shared_with + 2)) AS BIGINT) AS labels FROM labelled GROUP BY name),
    e AS (SELECT name, count(*) AS n_edges, CAST(sum(i * 100 + j) AS BIGINT) AS edge_sum FROM edges GROUP BY name),
    p AS (SELECT name, count(*) AS n_pieces, {duck.r('sum(volume)', 'volume')}, CAST(sum(prio * (part_idx + 1)) AS BIGINT) AS order_sum FROM prio GROUP BY name)
    SELECT name, n_pieces, volume, n_faces, n_fracture, labels, n_edges, edge_sum, order_sum
    FROM f JOIN e USING (name) JOIN p USING (name) WHERE NOT {BROKEN}""",
)
def object_preparation(spark, sf):
    """Mesh files to store tables; objects with a broken file are left out."""
    folder = mesh_folder(spark, sf)
    _, vertices, faces, _ = mesh_folder_tables(MF.read_meshes(spark, folder), folder)
    made = PP.prepare_objects(vertices, faces)
    store = fresh_path(spark, "prepared")
    for name, df in made.items():
        df.write.parquet(f"{store}/{name}")
    stored = {name: spark.read.parquet(f"{store}/{name}") for name in made}
    one = F.count(F.lit(1))
    labelled_ = stored["faces"].groupBy("name").agg(
        one.alias("n_faces"), F.count_if(F.col("shared_with") != -1).alias("n_fracture"),
        F.sum((F.col("f_idx") + 1) * (F.col("shared_with") + 2)).alias("labels"),
    )
    edges = stored["edges"].groupBy("name").agg(one.alias("n_edges"), F.sum(F.col("i") * 100 + F.col("j")).alias("edge_sum"))
    order = mesh.removal_priority(stored["measures"])
    pieces = order.groupBy("name").agg(
        one.alias("n_pieces"), F.sum("volume").alias("volume"), F.sum(F.col("prio") * (F.col("part_idx") + 1)).alias("order_sum")
    )
    return labelled_.join(edges, "name").join(pieces, "name").select(
        "name", "n_pieces", *rounded([F.col("volume")], ["volume"]), "n_faces", "n_fracture", "labels", "n_edges", "edge_sum", "order_sum"
    )


@query(
    "d04_weighted_clouds",
    f"WITH {DENSE}, {GEOM}, {MEASURES}, {_ALLOC.replace('5000', '400')} SELECT name, part_idx, n_points, "
    "row_number() OVER (PARTITION BY name ORDER BY n_points DESC, part_idx) = 1 AS is_ref FROM budget",
)
def weighted_clouds(spark, sf):
    _, parts = PP.weighted_clouds(fx.vertices(spark, sf), labelled(spark, sf), 400, 20, 20)
    return parts.select(*PART, "n_points", "is_ref")


@query(
    "d03_uniform_clouds",
    f"WITH {DENSE}, {GEOM}, {MEASURES} SELECT name, part_idx, CAST(30 AS BIGINT) AS n_points FROM meas",
)
def uniform_clouds(spark, sf):
    points, parts = PP.uniform_clouds(fx.vertices(spark, sf), labelled(spark, sf), 30)
    counted = points.groupBy(*PART).agg(F.count_distinct("pos").alias("n_points"))
    return counted.join(parts.select(*PART), PART)


@query(
    "d05_inference_clouds",
    f"WITH {DENSE}, {GEOM}, {MEASURES}, {_ALLOC.replace('5000', '400')} SELECT name, part_idx, n_points, CAST(20 AS BIGINT) AS width FROM budget",
)
def inference_clouds(spark, sf):
    points, parts, graphs = PP.inference_clouds(fx.vertices(spark, sf), fx.faces(spark, sf), 400)
    counted = points.groupBy(*PART).agg(F.count(F.lit(1)).alias("n_points"))
    return counted.join(graphs.select("name", "width"), "name")


@query(
    "d03_posed_points",
    f"WITH {DENSE}, {GEOM}, {MEASURES} SELECT name, part_idx, CAST(0 AS DOUBLE) AS worst FROM meas",
)
def posed_points(spark, sf):
    """Points put back by the part truth; the distance to where they were is 0."""
    points, parts = PP.uniform_clouds(fx.vertices(spark, sf), labelled(spark, sf), 30)
    back = PP.restore_points(points, parts)
    off = sum(((F.col(f"b{c}") - F.col(f"gt_{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return back.groupBy(*PART).agg(F.round(F.max(off), 9).alias("worst"))
