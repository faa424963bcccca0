"""Split lists: which objects belong to which category and split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ``<category>.<split>.txt`` as a file name or as the folder of a partitioned write.
_LIST_NAME = r"(?:^|[/=])([^/=]+)\.([^./=]+)\.txt(?:/|$)"
MESH_SUFFIXES = (".obj", ".ply")
FRACTURE_PREFIXES = ("fractured", "mode")
MAIN_CATEGORIES = ("everyday", "artifact")  # fixed value: what "all" stands for


def read_split_lists(spark: SparkSession, path: str) -> DataFrame:
    """(category, split, name) rows of all split lists under ``path``."""
    origin = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(
        F.regexp_extract(origin, _LIST_NAME, 1).alias("category"),
        F.regexp_extract(origin, _LIST_NAME, 2).alias("split"),
        F.trim("value").alias("name"),
    ).where("name <> ''")


def folder_entries(files: DataFrame) -> DataFrame:
    """(dir, entry): direct children of every folder above the given ``path`` rows."""
    steps = F.split("path", "/")
    depth = F.explode(F.sequence(F.lit(1), F.size("_s") - 1))
    return (
        files.select(steps.alias("_s")).where(F.size("_s") > 1)
        .withColumn("_d", depth)
        .select(
            F.array_join(F.slice("_s", F.lit(1), F.col("_d")), "/").alias("dir"),
            F.get("_s", F.col("_d")).alias("entry"),
        )
        .distinct()
    )


def _ends_with_any(c: str, suffixes) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(F.col(c), F.lit(s)) for s in suffixes])


def _starts_with_any(c: str, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(F.col(c), F.lit(p)) for p in prefixes])


def expand_fractures(splits: DataFrame, entries: DataFrame) -> DataFrame:
    """Replace each listed object by its fracture folders.

    A folder holding only mesh files stands for itself; otherwise its entries
    starting with ``fractured`` or ``mode`` are listed.  Names without a folder
    drop out (see ``missing_objects``).
    """
    flat = entries.groupBy("dir").agg(
        F.bool_and(_ends_with_any("entry", MESH_SUFFIXES)).alias("only_meshes")
    )
    known = splits.join(flat, splits["name"] == flat["dir"])
    itself = known.where("only_meshes").select("category", "split", "name")
    inner = (
        known.where("NOT only_meshes").select("category", "split", "name")
        .join(entries.where(_starts_with_any("entry", FRACTURE_PREFIXES)), F.col("name") == F.col("dir"))
        .select("category", "split", F.concat_ws("/", "name", "entry").alias("name"))
    )
    return itself.unionByName(inner)


def missing_objects(splits: DataFrame, entries: DataFrame) -> DataFrame:
    """Listed names that have no folder."""
    return splits.join(entries.select(F.col("dir").alias("name")), "name", "left_anti")


def piece_files(entries: DataFrame) -> DataFrame:
    """(dir, piece): ``.ply`` entries without their suffix."""
    return entries.where(F.endswith(F.col("entry"), F.lit(".ply"))).select(
        "dir", F.expr("left(entry, length(entry) - 4)").alias("piece")
    )


def names_for(splits: DataFrame, category: str, split: str, main=MAIN_CATEGORIES) -> DataFrame:
    """Names of one split; category ``all`` is the two main categories only."""
    wanted = list(main) if category == "all" else [category]
    return splits.where(F.col("category").isin(wanted) & (F.col("split") == split))


def flatten_names(splits: DataFrame) -> DataFrame:
    """All names, duplicates included."""
    return splits.select("name")


def unique_names(splits: DataFrame) -> DataFrame:
    """One row per name for ingest: the first by category and split wins."""
    return splits.groupBy("name").agg(F.min(F.struct("category", "split")).alias("_f")).select(
        "name", "_f.category", "_f.split"
    )


def part_count_filter(
    parts: DataFrame, min_parts: int = 2, max_parts: int = 20, removal: int = 0, redundancy: int = 0
) -> DataFrame:
    """(name, num_parts) of objects whose piece count fits the run's settings."""
    if removal and redundancy:
        raise ValueError("removal and redundancy cannot be combined")
    n = F.col("num_parts")
    return parts.groupBy("name").agg(F.count(F.lit(1)).alias("num_parts")).where(
        (n >= min_parts + removal) & (n <= max_parts - redundancy) & (n > redundancy)
    )


def multi_root(spark: SparkSession, categories: list[str], root: str, overrides: dict[str, str]) -> DataFrame:
    """Concatenate the categories, each from its own root where one is given."""
    return reduce(
        DataFrame.unionByName,
        [
            spark.read.parquet(overrides.get(c, root)).where(F.col("category") == c)
            for c in categories
        ],
    )


def stage_view(stage: str, num_removal: int = 0, num_redundancy: int = 0, multi_ref: bool = False) -> dict:
    """Settings of a stage's data: which split, and which of the switches apply.

    Testing reads the ``val`` split; only it removes or adds pieces, only training
    uses several references.
    """
    testing = stage in ("test", "predict")
    return {
        "split": "train" if stage == "train" else "val",
        "removal": num_removal if testing else 0,
        "redundancy": num_redundancy if testing else 0,
        "multi_ref": multi_ref and stage == "train",
        "keep_meshes": stage != "train",
        "shuffle": stage == "train",
    }
