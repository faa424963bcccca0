"""The fragment store: partitioned Parquet tables and pre-sampled exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.metrics import PART
from ..session import materialize


# A store is a folder of batches and a manifest.  A batch counts once its manifest entry is written.
DATA, MANIFEST = "data", "manifest"
NAMES_PER_FILTER = 100_000  # distinct names that a Bloom filter of a row group is laid out for


def write_store(table: DataFrame, path: str, batch: str) -> None:
    """Commit a batch of objects, gzip Parquet partitioned by category.

    A batch is written under its own name and then entered in the manifest, so a write that failed
    is not seen and a repeated one replaces itself.  Objects that another batch has committed are left
    out.  Rows are clustered by name, with a Bloom filter on it: a lookup skips most row groups.
    """
    spark = table.sparkSession
    table = materialize(only_new(table, committed(spark, path).where(F.col("batch") != batch)), "batch")
    (
        table.repartitionByRange("category", *PART)
        .sortWithinPartitions("category", *PART)
        .write.mode("overwrite")
        .partitionBy("category")
        .option("compression", "gzip")
        .option("parquet.bloom.filter.enabled#name", "true")
        .option("parquet.bloom.filter.expected.ndv#name", str(NAMES_PER_FILTER))
        .parquet(f"{path}/{DATA}/batch={batch}")
    )
    names = table.select(F.col("name").cast("string").alias("name")).distinct()
    names.write.mode("overwrite").parquet(f"{path}/{MANIFEST}/batch={batch}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(name, batch) of all objects of the store."""
    if not _exists(spark, f"{path}/{MANIFEST}"):
        return spark.createDataFrame([], "name string, batch string")
    return spark.read.option("basePath", f"{path}/{MANIFEST}").schema("name string, batch string").parquet(f"{path}/{MANIFEST}")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All rows of committed batches; the list of batches is as long as the number of writes."""
    batches = sorted(r["batch"] for r in committed(spark, path).select("batch").distinct().collect())
    if not batches:
        raise FileNotFoundError(f"no batch was committed below {path}")
    return spark.read.option("basePath", f"{path}/{DATA}").parquet(*[f"{path}/{DATA}/batch={b}" for b in batches]).drop("batch")


def only_new(table: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of objects the store does not hold yet."""
    return table.join(stored.select(F.col("name").cast(table.schema["name"].dataType)).distinct(), "name", "left_anti")


def lookup(spark: SparkSession, path: str, name) -> DataFrame:
    """All rows of one object; the filter reaches the Parquet scan."""
    return read_store(spark, path).where(F.col("name") == name)


def export_sampled(points: DataFrame, parts: DataFrame, edges: DataFrame, path: str, attrs: dict) -> None:
    """Write a pre-sampled data set and its one-row description."""
    for name, df in (("points", points), ("parts", parts), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    counts = parts.agg(F.count_distinct("name").alias("num_samples"))
    described = counts.select(*[F.lit(v).alias(k) for k, v in attrs.items()], "num_samples")
    described.write.mode("overwrite").json(f"{path}/dataset_meta")


def dataset_stats(splits: DataFrame, parts: DataFrame) -> DataFrame:
    """Objects and pieces per category and split."""
    sizes = parts.groupBy("name").agg(F.count(F.lit(1)).alias("num_parts"))
    return splits.join(sizes, "name").groupBy("category", "split").agg(
        F.count(F.lit(1)).alias("objects"),
        F.sum("num_parts").alias("pieces"),
        F.min("num_parts").alias("fewest"),
        F.max("num_parts").alias("most"),
    )


def parts_histogram(parts: DataFrame) -> DataFrame:
    sizes = parts.groupBy("name").agg(F.count(F.lit(1)).alias("num_parts"))
    return sizes.groupBy("num_parts").agg(F.count(F.lit(1)).alias("objects"))
