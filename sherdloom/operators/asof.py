"""Joins on the last mark at or before a position."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..session import materialize


def with_last_mark(asked: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """``asked`` with the ``value`` of its key's last mark whose ``at`` is not above its own.

    Marks and questions are range partitioned together on (key, position) and merged in that
    order, so neither a large key nor many questions under one mark meet in one task.  A
    partition that begins between marks takes over the last one of the partitions before it:
    one row per partition, hence the broadcast.  Of the marks only that row is written.  Every key that is asked about has a mark at or
    below all its questions; values are not null.
    """
    keys = list(keys)
    rest = [c for c in asked.columns if c not in (*keys, at)]
    both = marks.select(*keys, at, F.lit(0).alias("_kind"), F.col(value).alias("_mark"), *[
        F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in rest
    ]).unionByName(
        asked.select("*", F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema[value].dataType).alias("_mark"))
    )
    order = [*keys, at, "_kind"]
    merged = both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())
    schema = StructType([*merged.schema.fields]).add("_last", marks.schema[value].dataType)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # last mark of the batches so far
        closing = None  # and its row
        for b in batches:
            if not b.num_rows:
                continue
            is_mark = b.column("_kind").to_numpy(zero_copy_only=False) == 0
            at_ = np.maximum.accumulate(np.where(is_mark, np.arange(len(is_mark)), -1))
            marks_ = b.column("_mark")
            last = marks_.take(pa.array(at_, mask=at_ < 0))
            if before is not None:
                last = pc.if_else(pa.array(at_ < 0), before, last)
            before = last[len(last) - 1]
            filled = pa.RecordBatch.from_arrays([*b.columns, last], names=[*b.schema.names, "_last"])
            if at_[-1] >= 0:
                closing = filled.take(pa.array([at_[-1]]))
            yield filled.filter(pa.array(~is_mark))
            if not before.is_valid:
                before = None
        if closing is not None:
            yield closing

    filled = materialize(merged.mapInArrow(fill, schema), "as-of")
    closing = filled.groupBy("_pid").agg(F.max_by("_mark", F.when(F.col("_kind") == 0, F.struct(*keys, at))).alias("_close"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = closing.select("_pid", F.last("_close", ignorenulls=True).over(earlier).alias("_carried"))
    return (
        filled.where("_kind = 1")
        .join(F.broadcast(carried), "_pid", "left")
        .select(*asked.columns, F.coalesce("_last", "_carried").alias(value))
    )
