"""Offsets, padding, packing, batching and pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rand import DEFAULT_SEED, key_of, shuffled_position
from .ordering import explode_range, prefix_sum, with_global_rank

CHUNK = 4096  # rows per packed array


def point_offsets(parts: DataFrame) -> DataFrame:
    """Exclusive start and inclusive end of every part in its object's point list."""
    df = prefix_sum(parts, ["name"], "part_idx", "n_points", "end_offset")
    return df.withColumn("start_offset", F.col("end_offset") - F.col("n_points"))


def offsets_to_batch(offsets: DataFrame) -> DataFrame:
    """One row per point with the part it belongs to, from start/end offsets."""
    span = F.col("end_offset") - F.col("start_offset")
    return explode_range(offsets, span, "_i").select(
        "name", (F.col("start_offset") + F.col("_i")).alias("pos"), F.col("part_idx").alias("batch")
    )


def batch_counts(points: DataFrame, batch: list[str]) -> DataFrame:
    """Points per batch entry."""
    return points.groupBy(*batch).agg(F.count(F.lit(1)).alias("n"))


def object_offsets(objects: DataFrame, order: list) -> DataFrame:
    """Running part offsets over all objects of a run, for slicing flat predictions."""
    ranked = with_global_rank(objects, order, "position")
    df = prefix_sum(ranked, [], "position", "num_parts", "end_part", levels=3)
    return df.withColumn("start_part", F.col("end_part") - F.col("num_parts"))


def batches(objects: DataFrame, size: int, seed: int | None = DEFAULT_SEED) -> DataFrame:
    """Batch number of every object; ``seed=None`` keeps name order (no shuffle).

    Shuffled places are computed from the place in name order; no second sort is needed.
    """
    ranked = with_global_rank(objects, ["name"], "_r")
    if seed is not None:
        total = ranked.agg(F.count(F.lit(1)).alias("_n"))
        key = F.lit(key_of(seed, "batches")).cast("long")
        ranked = ranked.crossJoin(F.broadcast(total)).withColumn("_r", shuffled_position(F.col("_r"), F.col("_n"), key)).drop("_n")
    return ranked.withColumn("batch_id", F.floor(F.col("_r") / size).cast("long")).drop("_r")


def _part_lists(parts: DataFrame, max_parts: int) -> DataFrame:
    """(name, part_idx, list of the object's parts); part lists are bounded by the
    dense width ``max_parts``, which an object may not exceed."""
    slot = F.when(F.col("part_idx") < max_parts, F.col("part_idx")).otherwise(
        F.raise_error(F.lit(f"part index above {max_parts}")).cast("long")
    )
    return parts.select("name", slot.alias("_s")).groupBy("name").agg(
        F.sort_array(F.collect_set("_s")).alias("_l")
    )


def valid_pairs(parts: DataFrame, max_parts: int = 20) -> DataFrame:
    """Ordered pairs of different parts with points, inside the max_parts square."""
    lists = _part_lists(parts.where("n_points <> 0"), max_parts)
    return (
        lists.withColumn("i", F.explode("_l")).withColumn("j", F.explode("_l"))
        .where("i <> j").drop("_l")
    )


def complete_graph(objects: DataFrame, pad_to: int = 20) -> DataFrame:
    """The all-ones contact graph of ad-hoc inputs, diagonal and padding included."""
    width = F.greatest(F.lit(pad_to).cast("long"), F.col("num_parts"))
    return objects.select("name", width.alias("width"), F.lit(True).alias("complete"))


def pad_parts(df: DataFrame, value: Column, max_parts: int, zero: Column, out: str) -> DataFrame:
    """Per object an array of ``max_parts`` values in part order, zero filled.

    A part index at or above ``max_parts`` is an error before anything is
    collected, so an array never exceeds ``max_parts`` entries.
    """
    slot = F.when(F.col("part_idx") < max_parts, F.col("part_idx")).otherwise(
        F.raise_error(F.lit(f"part index above {max_parts}")).cast("long")
    )
    rows = df.select("name", slot.alias("_s"), value.alias("_v"))
    packed = rows.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("_s", "_v"))).alias("_l"))
    values = F.transform("_l", lambda s: s["_v"])
    return packed.select(
        "name",
        F.concat(values, F.array_repeat(zero, F.lit(max_parts) - F.size("_l"))).alias(out),
        F.size("_l").cast("long").alias("num_parts"),
    )


def unpad_parts(padded: DataFrame, values: str) -> DataFrame:
    """Long rows back from a padded array."""
    return padded.select(
        "name", F.posexplode(F.slice(values, 1, F.col("num_parts").cast("int"))).alias("part_idx", "value")
    ).withColumn("part_idx", F.col("part_idx").cast("long"))


def pack_points(points: DataFrame, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """Points of a part as arrays of at most ``chunk`` structs in point order.

    Parts up to ``chunk`` points are one row; larger ones continue in further
    chunks, so a row stays bounded and nothing is left out.
    """
    at = F.floor(F.col("pt_idx") / chunk).cast("long").alias("chunk")
    return points.groupBy("name", "part_idx", at).agg(
        F.sort_array(F.collect_list(F.struct("pt_idx", *columns))).alias("pts"),
        F.count(F.lit(1)).alias("n"),
    )


def unpack_points(packed: DataFrame) -> DataFrame:
    return packed.select("name", "part_idx", F.inline("pts"))
