"""Seeded randomness as column expressions.

Every draw is a digest of the seed and the row's own key, spelled out, so a re-run task,
another partitioning, another cluster size and another engine give the same numbers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, functions as F

DEFAULT_SEED = 1116  # fixed value: the seed the inference settings start from

_MANTISSA_BITS = 53
_DIGITS = 15  # hexadecimal digits of a digest that make a key: 60 bits


def hash_key(seed: int, *keys) -> Column:
    """60-bit digest of the seed and the keys; also the sort key of a shuffle."""
    spelled = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *spelled))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long")


def hash_uniform(seed: int, *keys) -> Column:
    """Uniform double in [0, 1)."""
    bits = F.shiftright(hash_key(seed, *keys), 4 * _DIGITS - _MANTISSA_BITS)
    return bits.cast("double") / F.lit(float(1 << _MANTISSA_BITS))


def key_of(seed: int, *keys) -> int:
    """The number of ``hash_key`` for plain values."""
    return int(hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()[:_DIGITS], 16)


def uniform_of(seed: int, *keys) -> float:
    """The number of ``hash_uniform`` for plain values."""
    return (key_of(seed, *keys) >> 4 * _DIGITS - _MANTISSA_BITS) / float(1 << _MANTISSA_BITS)


def keys_of(seed: int, n: int, *keys) -> np.ndarray:
    """``key_of`` for the keys and each number below ``n`` after them."""
    begin = hashlib.md5("".join(f"{k}:" for k in (seed, *keys)).encode())
    digests = []
    for k in range(n):
        digest = begin.copy()
        digest.update(b"%d" % k)
        digests.append(digest.digest()[:8])
    return (np.frombuffer(b"".join(digests), ">u8") >> np.uint64(64 - 4 * _DIGITS)).astype(np.int64)


def uniforms_of(seed: int, n: int, *keys) -> np.ndarray:
    """``uniform_of`` for the keys and each number below ``n`` after them."""
    return (keys_of(seed, n, *keys) >> (4 * _DIGITS - _MANTISSA_BITS)) / float(1 << _MANTISSA_BITS)


def hash_normal(seed: int, *keys) -> Column:
    """Standard normal by the Box-Muller transform of two independent draws."""
    u1 = F.lit(1.0) - hash_uniform(seed, F.lit("n1"), *keys)
    u2 = hash_uniform(seed, F.lit("n2"), *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def hash_quaternion(seed: int, *keys) -> tuple[Column, Column, Column, Column]:
    """Rotation uniform on SO(3) as a wxyz quaternion (Shoemake's three uniforms)."""
    u1, u2, u3 = (hash_uniform(seed, F.lit(f"q{i}"), *keys) for i in range(3))
    a, b = F.sqrt(1.0 - u1), F.sqrt(u1)
    s, c = F.lit(2.0 * math.pi) * u2, F.lit(2.0 * math.pi) * u3
    return b * F.cos(c), a * F.sin(s), a * F.cos(s), b * F.sin(c)


# A random order that is computed instead of sorted: in every round a position either stays or
# changes places with its mirror image about a keyed pivot (swap-or-not).  Each round is its
# own inverse, so any number of them permutes [0, n) for every n, without walking out of it.
PRIME = (1 << 31) - 1
ROUNDS = 24
_STEP = 48271
ROUND_FACTORS = [pow(_STEP, r, PRIME) for r in range(1, ROUNDS + 1)]


def shuffled_position(position: Column, n: Column, key: Column) -> Column:
    """Where ``position`` of [0, n) goes under the permutation that ``key`` (60 bits) names; n < 2**31."""
    a, b = key % PRIME, F.shiftright(key, 29) % PRIME

    def swap(x, factor):
        turn = (a * factor + b) % PRIME
        mirror = (turn % n + n - x) % n
        coin = F.shiftright((F.greatest(x, mirror) + 1) * (turn * _STEP % PRIME + 1) % PRIME, 11) % 2
        return F.when(coin == 1, mirror).otherwise(x)

    factors = F.array(*[F.lit(f).cast("long") for f in ROUND_FACTORS])
    return F.aggregate(factors, position.cast("long"), swap)
