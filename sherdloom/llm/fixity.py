"""Merkle fixity audit of archive replicas.

A record's leaf is a hash of its payload; sixteen neighbouring offset ranges make
one node of the next level, up to one root per archive.  Two replicas are compared at
their roots, and only the children of nodes that differ are looked at, down to the
records that were changed or lost.

Defined results: a null payload differs from an empty one; records without an offset
or archive make a branch of their own; several records at one offset are one leaf
that holds them as a multiset, so their order does not matter but their number does; two
empty replicas agree; the length of a payload does not matter, nor do other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize

FAN_BITS = 4


def leaves(records: DataFrame) -> DataFrame:
    """(archive, node, hash) of ``records`` (archive, offset, payload)."""
    digest = F.coalesce(F.sha2(F.col("payload"), 256), F.lit("-" * 64))
    # Sums of four 64-bit parts hold any number of records of one offset in fixed space.
    parts = [
        F.sum(F.xxhash64(F.lit(k), digest).cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(4)
    ]
    one = records.groupBy("archive", F.col("offset").alias("node")).agg(
        F.count(F.lit(1)).cast("string").alias("n"), F.min(digest).alias("least"), F.max(digest).alias("most"), *parts
    )
    return one.select(
        "archive", "node", F.sha2(F.concat_ws(":", "n", "least", "most", *[f"s{k}" for k in range(4)]), 256).alias("hash")
    )


def parents(nodes: DataFrame, bits: int = FAN_BITS) -> DataFrame:
    """The next level: ordered children, 2 ** bits at most, hashed together."""
    children = F.array_sort(F.collect_list(F.struct(F.coalesce("node", F.lit(0)).alias("node"), "hash")))
    text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])), ",")
    return nodes.groupBy("archive", F.shiftright("node", bits).alias("up")).agg(F.sha2(text, 256).alias("hash")).select(
        "archive", F.col("up").alias("node"), "hash"
    )


def differing(mine: DataFrame, other: DataFrame) -> DataFrame:
    """(archive, node, mine, other): nodes whose hashes differ or that one side lacks."""
    both = mine.select("archive", "node", F.col("hash").alias("mine"), F.lit(None).cast("string").alias("other")).unionByName(
        other.select("archive", "node", F.lit(None).cast("string").alias("mine"), F.col("hash").alias("other"))
    )
    met = both.groupBy("archive", "node").agg(F.max("mine").alias("mine"), F.max("other").alias("other"))
    return met.where(~F.col("mine").eqNullSafe(F.col("other")))


def audit(mine: DataFrame, other: DataFrame, bits: int = FAN_BITS) -> DataFrame:
    """(archive, offset, status): records changed, missing or added in ``other``."""
    trees = []
    for replica in (mine, other):
        trees.append([materialize(leaves(replica), "leaves")])
    span = trees[0][0].unionByName(trees[1][0]).agg(F.max(F.greatest(F.col("node"), -F.col("node") - 1))).first()[0] or 0
    # Above the last level all offsets lie in node 0, or -1 for negative ones.
    while span > 0:
        for tree in trees:
            tree.append(materialize(parents(tree[-1], bits), "nodes"))
        span >>= bits
    found = differing(trees[0][-1], trees[1][-1])
    for level in range(len(trees[0]) - 2, -1, -1):
        bad = materialize(found.select("archive", "node"), "differing")
        below = []
        for tree in trees:
            nodes = tree[level]
            up = bad.select(F.col("archive").alias("bad_archive"), F.col("node").alias("bad_node"))
            below.append(nodes.join(
                up,
                nodes["archive"].eqNullSafe(up["bad_archive"]) & F.shiftright(nodes["node"], bits).eqNullSafe(up["bad_node"]),
                "left_semi",
            ))
        found = differing(*below)
    status = F.when(F.col("other").isNull(), "missing").when(F.col("mine").isNull(), "added").otherwise("changed")
    return found.select("archive", F.col("node").alias("offset"), status.alias("status"))


def page_records(pages: DataFrame, size: int = 4096) -> DataFrame:
    """Pages as archive records of ``size`` each: the whole record, url and body, is the payload."""
    return pages.select(
        F.floor(F.col("page_id") / size).alias("archive"), F.col("page_id").alias("offset"),
        F.to_json(F.struct("url", "html")).alias("payload"),
    )


def damaged_replica(records: DataFrame) -> DataFrame:
    """A replica with faults that follow from a hash of the offset, for audits.

    Of 256 records some two gain a byte, one is lost and one comes twice.
    """
    fault = F.substring(F.md5(F.col("offset").cast("string")), 1, 2)
    times = F.when(fault == "02", 0).when(fault == "03", 2).otherwise(1)
    payload = F.when(
        fault.isin("00", "01"), F.concat(F.coalesce("payload", F.lit("")), F.lit("!"))
    ).otherwise(F.col("payload"))
    return records.select(
        "archive", "offset", payload.alias("payload"),
        F.explode(F.array_repeat(F.lit(1), F.coalesce(times, F.lit(1)))).alias("copy"),
    ).drop("copy")
