"""Frequency embedding of numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FREQUENCIES = 10  # fixed value: powers of two 2**0 .. 2**9


def frequency_embedding(values: list[Column], n: int = FREQUENCIES) -> Column:
    """[x, sin(2^0 x), cos(2^0 x), ..., cos(2^(n-1) x)] over all inputs, as one array.

    d inputs give d * (1 + 2 n) numbers; the inputs vary fastest.
    """
    base = F.array(*values)

    def at(k: Column) -> Column:
        f = F.pow(F.lit(2.0), k)
        return F.concat(
            F.transform(base, lambda x: F.sin(x * f)), F.transform(base, lambda x: F.cos(x * f))
        )

    waves = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))
    return F.concat(base, waves)
