"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own, drawn
from two hashes of its name.  Shards take turns claiming the next slot that is still
free, so each holds the same number of slots, give or take one, and a shard that
joins or leaves moves little else.  Placing a document is one hash and one lookup in
the broadcast table, whose size is a parameter.

Defined results: a null doc id is placed by its text, a null text by the empty one;
repeated rows share their shard; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import col, fresh

SHARDS = 64
SLOTS = 65_537  # prime


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """Number of the shard that holds each slot."""
    if not _prime(slots):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(names) <= slots:
        raise ValueError("there must be one shard at least and no more than slots")
    place = np.full(slots, -1, np.int32)
    at = [_hash(n, "offset") % slots for n in names]
    step = [_hash(n, "skip") % (slots - 1) + 1 for n in names]
    filled = 0
    while True:
        for k in range(len(names)):
            while place[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            place[at[k]] = k
            filled += 1
            if filled == slots:
                return place


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """Slot of a document: 60 bits of the MD5 of its key, modulo the table size."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    bits = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
    return F.pmod(bits, F.lit(slots))


def place(docs: DataFrame, keep: list[str], names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """The kept columns with slot and shard, under names that are still free."""
    names = shard_names() if names is None else names
    slot, shard = fresh(docs, "slot"), fresh(docs, "shard")
    rows = docs.select(
        *[col(docs, c) for c in keep], slot_of(col(docs, "doc_id"), col(docs, "text"), slots).alias(slot)
    )
    at = fresh(rows, "held_slot")
    held = pd.DataFrame({at: np.arange(slots), shard: lookup_table(names, slots)})
    table = docs.sparkSession.createDataFrame(held, f"{at} long, {shard} int")
    return rows.join(F.broadcast(table), F.col(slot) == F.col(at)).drop(at)
