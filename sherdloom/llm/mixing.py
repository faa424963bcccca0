"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source is wanted target / size times: the whole part is taken
for sure, the fraction is an inclusion probability.  Three open documents at a time
have one direction in which their probabilities move without changing the number of
documents and the number of words; they move along it, up or down at random, until
one is settled.  Blocks of a source settle in parallel down to two open documents
each; what is open meets in fewer, wider blocks until two remain per source, and
those are rounded to the nearest total.

Defined results: a null text has size zero; the null source comes last; a source
without words has target zero; documents of size zero are moved like others and take
no words; repeated rows are drawn each for itself and spread over the blocks like others; an
empty table gives no rows; the length of a text does not matter.  Draws and blocks depend on the
seed, a hash of id and text, and the rank among equal rows, not on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import with_global_rank, with_rank
from ..session import materialize
from .common import col, fresh, with_row_id

WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document
BLOCK = 2048  # documents that one flight settles, also open ones that meet again
SEED = 20_240_601
_EPS = 1e-9


def source_targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with target words.

    Shares go by weight; a source above ``most`` times its size stops there and the
    excess is shared again, until none is above.  Every round caps a source or ends.
    """
    ranked = with_global_rank(sources, [F.col("source").asc_nulls_last()], "nth")
    n = F.pmod("nth", F.lit(len(weights))).cast("int")
    table = materialize(
        ranked.select("source", "source_size", F.get(F.array(*map(F.lit, weights)), n).alias("weight")), "sources"
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rates: list[float] = []  # words a weight gets, round by round
    stopped = F.lit(False)
    while True:
        left, weight = table.agg(
            F.sum(F.when(stopped, most * F.col("source_size")).otherwise(0)),
            F.sum(F.when(stopped, 0).otherwise(F.col("weight"))),
        ).first()
        rate = (total - (left or 0)) / weight if weight else 0.0
        if rates and rate <= rates[-1]:
            break
        rates.append(rate)
        # Rates only rise, so what was above before is above now.
        stopped = F.lit(rate) * F.col("weight") > most * F.col("source_size")
    rate = F.lit(rates[-1] if rates else 0.0)
    return table.withColumn(
        "target", F.least(rate * F.col("weight"), (most * F.col("source_size")).cast("double"))
    ).select("source", "source_size", "target")


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Move probabilities, three open ones at a time, until two at most are open.

    ``draws`` holds a number in [0, 1) for each; sums of p and of p * size stay.
    """
    p = p.astype(float).copy()
    left: list[int] = []
    for k in range(len(p)):
        if _EPS < p[k] < 1 - _EPS:
            left.append(k)
        while len(left) == 3:
            a, b, c = left
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(left, u) if x)
            down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(left, u) if x)
            move = up if draws[k] * (up + down) < down else -down
            for i, x in zip(left, u):
                p[i] += move * x
            left = [i for i in left if _EPS < p[i] < 1 - _EPS]
            if len(left) == 3:  # rounding left the touched one just inside
                i = min(left, key=lambda j: min(p[j], 1 - p[j]))
                p[i] = round(p[i])
                left.remove(i)
    return np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p))


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last open ones to the word total nearest to the expected one."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        aim = (p[left] * size[left]).sum()
        ways = [np.array([w >> k & 1 for k in range(len(left))], float) for w in range(1 << len(left))]
        p[left] = min(ways, key=lambda x: (abs((x * size[left]).sum() - aim), abs(x.sum() - p[left].sum()), tuple(x)))
    return p


def _settle(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "key", "nth", "rid"], ignore_index=True)
        size = pdf["size"].to_numpy(float)
        p = flight(pdf["p"].to_numpy(float), size, pdf["draw"].to_numpy(float))
        pdf["p"] = landing(p, size) if last else p
        return pdf

    return run


def mix(rows: DataFrame, rid: str = "rid", weights=WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(rid, doc_id, size, source_size, target, copies) for rows (rid, doc_id, source, size, key).

    ``key`` is a hash of the row's content; equal rows are told apart by their rank.
    """
    rows = with_rank(rows, ["key"], [rid], "nth")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = materialize(sources, "mix")
    goals = source_targets(sources.select("source", "source_size"), weights, most).join(
        sources.select(F.col("source").alias("s"), F.ceil(F.col("docs") / block).alias("blocks")),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s").withColumnRenamed("source", "goal_source")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key", "nth"), 11) / F.lit(float(1 << 53))
    open_ = rows.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).select(
        F.col(rid).alias("rid"), F.col("doc_id"), "source", "size", "source_size", "target",
        F.floor(want).alias("base"), (want - F.floor(want)).alias("p"), draw.alias("draw"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "key", "nth"), F.col("blocks")).alias("block"),
        "blocks", "key", "nth",
    )
    schema = open_.schema
    settled = None
    most_blocks = goals.agg(F.max("blocks")).first()[0] or 1
    while True:
        done = materialize(
            open_.groupBy("source", "block").applyInPandas(_settle(most_blocks <= 1), schema), "flight"
        )
        part = done.where("p = 0 or p = 1")
        settled = part if settled is None else settled.unionByName(part)
        if most_blocks <= 1:
            break
        # Two open ones at most are left of a block: block / 4 blocks meet again.
        width = max(2, block // 4)
        open_ = done.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / width))
        most_blocks = -(-most_blocks // width)
    return settled.select(
        "rid", "doc_id", "size", "source_size", "target", (F.col("base") + F.col("p")).cast("long").alias("copies")
    )


def sized(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str, DataFrame]:
    """The kept columns, each row with a number and its column's name; and narrow rows for ``mix``."""
    name = fresh(docs, "sized")
    words = F.regexp_count(F.coalesce(col(docs, "text"), F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")
    key = F.xxhash64(col(docs, "doc_id"), col(docs, "source"), col(docs, "text"))
    marked = docs.select(*[col(docs, c) for c in keep], F.struct(words.alias("size"), key.alias("key")).alias(name))
    rows, rid = with_row_id(marked, "sized")
    at = F.col(name)
    narrow = rows.select(F.col(rid).alias("rid"), "doc_id", "source", at["size"].alias("size"), at["key"].alias("key"))
    return rows, rid, narrow


def report(docs: DataFrame, **parameters) -> DataFrame:
    *_, narrow = sized(docs, ["doc_id", "source"])
    return mix(narrow, **parameters).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def apply_mix(docs: DataFrame, **parameters) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it."""
    rows, rid, narrow = sized(docs, docs.columns)
    taken = mix(narrow, **parameters).where("copies > 0").select(
        F.col("rid").alias("taken_rid"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("taken_copy")
    )
    taken = taken.select(F.struct("*").alias("taken_" + rid))
    at = taken.columns[0]
    # A sorted join at every size: what is shuffled grows evenly with the input.
    return rows.join(taken.hint("merge"), F.col(rid) == F.col(at)["taken_rid"]).select(*[col(rows, c) for c in docs.columns])
