"""From raw documents to shards: five stages, each one operator over all that is left.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and gives a
DataFrame.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from sherdloom.llm import decontam, mixing, quality, sharding, simhash
from sherdloom.llm.common import table
from sherdloom.session import materialize, recorded, release, tune

# What a stage wrote for itself, by run: its successor may delete it.  A run begins with the
# first stage and belongs to its thread.
_RUN: ContextVar[str] = ContextVar("run", default="")
_LEFT: dict[tuple[str, str], list[str]] = {}


def _stage(body: Callable) -> Callable:
    """A stage that first deletes what the stages before it wrote for themselves.

    Tables that ``docs`` still reads stay: a stage whose result was not written yet goes
    on working, and a later stage deletes them.  The first stage deletes nothing.
    """
    @wraps(body)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tune(spark)
        if run_stage is STAGES[0][1]:
            _RUN.set(uuid4().hex)
        key = (spark.sparkContext.applicationId, _RUN.get())
        left = _LEFT.pop(key, [])
        read = docs.inputFiles() if left else []
        held = [p for p in left if any(p.rsplit("/", 1)[1] in file for file in read)]
        release(spark, [p for p in left if p not in held])
        with recorded() as paths:
            out = body(spark, docs, sf_dir)
        _LEFT[key] = held + paths
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, verified=True)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


@_stage
def sharding_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place(docs, docs.columns)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("sharding", sharding_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read by the next."""
    docs, before = table(spark, sf_dir, "documents"), []
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            with recorded() as paths:
                docs = materialize(docs, "stage")
            release(spark, before)
            before = paths
    return docs


# Fingerprint groups need a transitive closure over XXH64 hashes and the mix is drawn
# by the cube method: SQL cannot say either, so tests hold run() against brute force.
ORACLE_SQL = None
