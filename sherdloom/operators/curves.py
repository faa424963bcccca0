"""Voxel grids, curve order and pooling over long point tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.curve import MAX_DEPTH, check_depth, with_code
from ..functions.rand import DEFAULT_SEED, hash_key
from .ordering import with_global_rank, with_rank

GRID_SIZE = 0.02  # fixed value: default voxel edge
SPARSE_PAD = 96  # fixed value: margin of the sparse voxel shape
GRID = ("gx", "gy", "gz")


def with_grid(points: DataFrame, size: float = GRID_SIZE, keys: list[str] | None = None) -> DataFrame:
    """Voxel of every point, counted from the minimum over the whole input or per key."""
    low = points.groupBy(*(keys or [])).agg(*[F.min(c).alias(f"_lo{c}") for c in "xyz"])
    # without keys ``low`` is a single aggregate row
    df = points.join(low, keys) if keys else points.crossJoin(F.broadcast(low))
    return df.withColumns(
        {
            g: F.floor((F.col(c) - F.col(f"_lo{c}")) / size).cast("long")
            for g, c in zip(GRID, "xyz")
        }
    ).drop(*[f"_lo{c}" for c in "xyz"])


def grid_depth(grid: DataFrame, batches: int = 1) -> int:
    """Bits per axis the largest voxel index needs; one scalar reaches the driver."""
    top = grid.agg(F.max(F.greatest(*GRID))).first()[0] or 0
    depth = int(top).bit_length()
    check_depth(depth, int(batches).bit_length())
    return depth


def depth_table(grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Curve depth as a column; an index needing more than 16 bits is an error."""
    top = grid.groupBy(*(keys or [])).agg(F.max(F.greatest(*GRID)).alias("_top"))
    bits = F.when(F.col("_top") > 0, F.length(F.conv(F.col("_top").cast("string"), 10, 2))).otherwise(0)
    depth = F.when(bits <= MAX_DEPTH, bits).otherwise(
        F.raise_error(F.lit("curve depth above 16")).cast("int")
    )
    return top.select(*(keys or []), depth.cast("long").alias("depth"))


def serialize(
    grid: DataFrame, depth: int, order: str = "z", keys: list[str] | None = None,
    tie: tuple[str, ...] = ("part_idx", "pt_idx"), batch: str | None = None,
) -> DataFrame:
    """Curve code and 0-based curve rank of every point, per key or overall.

    A row's rank is its place in the order, i.e. the inverse permutation.
    """
    coded = with_code(grid, order, depth, batch=batch)
    if keys:
        return with_rank(coded, keys, ["code", *tie], "rank")
    return with_global_rank(coded, ["code", *tie], "rank")


def tiles(
    grid: DataFrame, depth: int, size: int, order: str = "z",
    keys: tuple[str, ...] = ("name", "part_idx"),
) -> DataFrame:
    """Consecutive tiles of ``size`` points along the curve inside each fragment."""
    ranked = serialize(grid, depth, order, list(keys), tie=("pt_idx",))
    return ranked.withColumn("tile", F.floor(F.col("rank") / size).cast("long"))


def clustered(grid: DataFrame, depth: int, order: str = "z") -> DataFrame:
    """Points laid out along the curve, for writing files with tight value ranges."""
    coded = with_code(grid, order, depth)
    return coded.repartitionByRange("code").sortWithinPartitions("code")


def order_permutation(points: DataFrame, orders: tuple[str, ...], seed: int = DEFAULT_SEED) -> DataFrame:
    """Random order of the curve names per key row, as an array column."""
    tagged = F.array(
        *[F.struct(hash_key(seed, F.lit(o), "name").alias("h"), F.lit(o).alias("o")) for o in orders]
    )
    return points.select("name").distinct().withColumn(
        "orders", F.transform(F.sort_array(tagged), lambda s: s["o"])
    )


def sparse_voxels(grid: DataFrame, batch: str = "name") -> DataFrame:
    """Distinct voxel keys."""
    return grid.select(F.col(batch).alias("batch"), *GRID).distinct()


def sparse_shape(grid: DataFrame, pad: int = SPARSE_PAD) -> DataFrame:
    return grid.agg(*[(F.max(g) + pad).alias(f"s{g[1]}") for g in GRID])


def voxel_pool(
    coded: DataFrame, depth_step: int, feats: list[str], reduce: str = "max",
    batch: str = "name", tie: tuple[str, ...] = ("part_idx", "pt_idx"),
) -> DataFrame:
    """One row per coarser voxel: reduced features, mean coordinate, head-row attributes.

    The head row is the first of the voxel in input order; its grid cell, shifted,
    becomes the voxel's.  Everything is one partial aggregation.
    """
    fold = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[reduce]
    head = F.min_by(F.struct(*GRID), F.struct(*tie))
    cluster = F.shiftright("code", 3 * depth_step).alias("cluster")
    pooled = coded.groupBy(batch, cluster).agg(
        *[fold(c).alias(f"f_{c}") for c in feats],
        *[F.avg(c).alias(c) for c in "xyz"],
        F.count(F.lit(1)).alias("n"),
        head.alias("_h"),
        F.min(F.struct(*tie)).alias("_t"),
    )
    return pooled.select(
        batch, "cluster", *[f"f_{c}" for c in feats], *"xyz", "n",
        *[F.shiftright(f"_h.{g}", depth_step).alias(g) for g in GRID],
        *[F.col(f"_t.{t}").alias(f"head_{t}") for t in tie],
    )


def voxel_unpool(
    coded: DataFrame, pooled: DataFrame, depth_step: int, feats: list[str], batch: str = "name"
) -> DataFrame:
    """Point features plus the features of the voxel each point fell into."""
    up = coded.withColumn("cluster", F.shiftright("code", 3 * depth_step))
    return up.join(
        pooled.select(batch, "cluster", *[f"f_{c}" for c in feats]), [batch, "cluster"]
    ).withColumns({f"u_{c}": F.col(c) + F.col(f"f_{c}") for c in feats})


def voxel_counts(coded: DataFrame) -> DataFrame:
    """Distinct codes with their count and 0-based dense rank.

    Codes are made distinct before they are ranked, so a crowded voxel is one row.
    """
    counts = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return with_global_rank(counts, ["code"], "cluster")
