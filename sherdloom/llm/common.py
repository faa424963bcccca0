"""Pieces that several corpus operators use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize

# Fixed value: the white space that separates words, as a Java character class.
SPACE = r"[ \t-\r]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row.

    A plain column would be pasted into every place, also into lambdas, where it
    would run once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def split_words(text: Column, gap: str = SPACE) -> Column:
    """Words of a text between runs of ``gap``; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap + "+"), "")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def col(df: DataFrame, name: str) -> Column:
    """A column by its plain name, also where the name holds dots or backquotes."""
    return df["`" + name.replace("`", "``") + "`"]


def with_row_id(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """The rows, written once, with a number of their own and its column's name.

    The numbers depend on how the rows lie in partitions, so they are written
    before anything reads them.
    """
    rid = fresh(df, "rid")
    return materialize(df.withColumn(rid, F.monotonically_increasing_id()), tag), rid


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path
