"""Ranks, running sums and row generation that never put one key into one task.

A window partitioned by object would sort a whole object in a single task.  The
helpers here split the order first, so their task sizes do not depend on how
many rows share a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..session import materialize

# monotonically_increasing_id keeps the partition number above bit 33.
_ROW_BITS = 33
# Width of one level of a running sum: a window holds at most 2**16 positions.
_LEVEL_BITS = 16


def with_global_rank(df: DataFrame, order: Sequence, out: str = "grank") -> DataFrame:
    """0-based position of every row under ``order`` over the whole frame.

    One range shuffle on the full order key (equal shares for any skew, as long as
    ``order`` ends in a unique column), numbering inside each range partition, and
    one offset per partition.  The offsets table has one row per shuffle partition,
    which is why broadcasting it is safe.
    """
    order = list(order)
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    table = materialize(ranged, "rank")
    pid = F.shiftright("_mid", _ROW_BITS)
    counts = table.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    local = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        table.withColumn("_pid", pid)
        .join(F.broadcast(offsets), "_pid")
        .withColumn(out, F.col("_off") + local)
        .drop("_pid", "_off", "_mid")
    )


def with_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "rank"
) -> DataFrame:
    """0-based position of every row under ``order`` inside its key; rows of a null key are left out.

    Rows are range partitioned on (key, order) and numbered inside the keys of their partition.
    A key that began in earlier partitions goes on counting from there: one row per partition,
    hence the broadcast.
    """
    keys = list(keys)
    by = [*keys, *order]
    known = df.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    ranged = known.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_pid", F.spark_partition_id())
    schema = StructType([*ranged.schema.fields]).add("_at", "long")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, 0  # key and number of the next row, if it has the same key
        for b in batches:
            if not b.num_rows:
                continue
            held = [b.column(k) for k in keys]
            fresh = np.zeros(b.num_rows, bool)
            fresh[0] = key != [c[0].as_py() for c in held]
            for c in held:
                fresh[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            row = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(fresh, row, -1))
            at = np.where(start < 0, row + n, row - start)
            key, n = [c[-1].as_py() for c in held], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "_at"])

    table = materialize(ranged.mapInArrow(number, schema), "rank")
    key = F.struct(*keys)
    ends = table.groupBy("_pid").agg(
        F.min(key).alias("_first"), F.max(F.struct(key.alias("k"), (F.col("_at") + 1).alias("n"))).alias("_end")
    )
    before = ends.select(F.col("_pid").alias("_q"), F.col("_end.k").alias("_first"), F.col("_end.n").alias("_n"))
    carried = ends.select("_pid", "_first").join(F.broadcast(before), "_first").where("_q < _pid").groupBy("_pid", "_first").agg(
        F.sum("_n").alias("_off")
    ).select(F.col("_pid").alias("_q"), "_off", *[F.col("_first")[k].alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(and_, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid") == F.col("_q"))
    return table.join(F.broadcast(carried), same, "left").select(
        *df.columns, (F.col("_at") + F.coalesce("_off", F.lit(0))).alias(out)
    )


def with_sum_block(df: DataFrame, idx: str, levels: int = 2) -> DataFrame:
    """``df`` with the column by which ``prefix_sum`` lays its rows; what is laid so stays in place."""
    return df.withColumn(f"_b{levels}", F.shiftright(idx, _LEVEL_BITS))


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    value: Column | str,
    out: str,
    levels: int = 2,
) -> DataFrame:
    """Inclusive running sum of ``value`` in ``idx`` order inside each key.

    ``idx`` is a non-negative integer, unique inside its key, below
    ``2**(16*levels)``.  Sums are first taken per block of 2**16 positions, the
    blocks are summed by the same rule one level up, and rows only meet inside
    their own block, so every window is bounded whatever the key holds.  An index
    beyond the range is an error.
    """
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    beyond = (F.col(idx) < 0) | (F.col(idx) >= 1 << (_LEVEL_BITS * levels))
    wrong = F.raise_error(F.lit(f"{idx} is outside the range of a running sum of {levels} levels"))
    df = df.withColumn("_v", F.when(beyond, wrong).otherwise(value))
    if levels == 1:
        run = Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum("_v").over(run)).drop("_v")
    block = f"_b{levels}"
    if block not in df.columns:
        df = with_sum_block(df, idx, levels)
    sums = df.groupBy(*keys, block).agg(F.sum("_v").alias("_s"))
    upper = prefix_sum(sums, keys, block, "_s", "_incl", levels - 1)
    upper = upper.select(*keys, block, (F.col("_incl") - F.col("_s")).alias("_before"))
    run = (
        Window.partitionBy(*keys, block).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        df.join(upper, [*keys, block])
        .withColumn(out, F.col("_before") + F.sum("_v").over(run))
        .drop("_v", "_before", block)
    )


def explode_range(df: DataFrame, n: Column | str, out: str) -> DataFrame:
    """One row per integer in ``[0, n)`` and input row.

    Exploded in two steps so that no single array exceeds 2**16 entries.
    """
    n = F.col(n) if isinstance(n, str) else n
    step = 1 << _LEVEL_BITS
    hi = F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("_n") - 1, _LEVEL_BITS)))
    lo = F.explode(
        F.sequence(
            F.lit(0).cast("long"),
            F.least(F.lit(step - 1).cast("long"), F.col("_n") - 1 - F.col("_hi") * step),
        )
    )
    return (
        df.withColumn("_n", n.cast("long"))
        .where("_n > 0")
        .withColumn("_hi", hi)
        .withColumn("_lo", lo)
        .withColumn(out, F.col("_hi") * step + F.col("_lo"))
        .drop("_n", "_hi", "_lo")
    )
