"""Gallery manifest: a JSON document with a map of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ENTITY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "dataset", "subset", "folder")]
    + [T.StructField("files", T.ArrayType(T.StringType()))]
)
MANIFEST = T.StructType(
    [
        T.StructField("idList", T.ArrayType(T.StringType())),
        T.StructField("entities", T.MapType(T.StringType(), ENTITY)),
    ]
)


def read_gallery(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(id, dataset, subset, folder, pos, file); an unreadable manifest gives no rows.

    ``multi_line`` reads one pretty-printed manifest per file, otherwise every line
    is a manifest.
    """
    docs = spark.read.schema(MANIFEST).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    entities = docs.select(F.explode("entities").alias("key", "e")).select("e.*")
    return entities.select(
        "id", "dataset", "subset", "folder", F.posexplode("files").alias("pos", "file")
    )
