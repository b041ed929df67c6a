"""Evenly spread points: Sobol's sequence, scrambled, as bit operations on columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a coordinate, and so the logarithm of the points of a sequence.
BITS = 30
#: Degree and inner coefficients of the primitive polynomial and first direction numbers (odd, the k-th below 2^k) of the
#: dimensions from the second on, as Joe and Kuo published them (new-joe-kuo-6).
POLYNOMIALS = ((1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)))


def directions(dimensions: int) -> np.ndarray:
    """The direction numbers: a row for each dimension, a number of BITS bits for each bit of a Gray code."""
    if not 1 <= dimensions <= len(POLYNOMIALS) + 1:
        raise ValueError(f"1 to {len(POLYNOMIALS) + 1} dimensions")
    rows = [[1] * BITS]
    for degree, inner, first in POLYNOMIALS[: dimensions - 1]:
        m = list(first)
        for k in range(degree, BITS):
            new = m[k - degree] ^ (m[k - degree] << degree)
            for back in range(1, degree):
                if inner >> (degree - 1 - back) & 1:
                    new ^= m[k - back] << back
            m.append(new)
        rows.append(m)
    return np.array([[v << (BITS - 1 - k) for k, v in enumerate(m)] for m in rows], np.int64)


def scrambled(dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Direction numbers after a random lower triangular matrix of bits with ones on its diagonal has been applied to each, from the highest
    bit down, and a random shift for each dimension."""
    rng = np.random.default_rng(seed)
    shift = rng.integers(0, 2, (dimensions, BITS)) @ (1 << np.arange(BITS))
    lower = np.tril(rng.integers(0, 2, (dimensions, BITS, BITS)), -1) + np.eye(BITS, dtype=int)
    places = np.arange(BITS - 1, -1, -1)
    bits = directions(dimensions)[:, None, :] >> places[None, :, None] & 1  # dimension, bit from the highest, direction
    return ((lower @ bits % 2) << places[None, :, None]).sum(1), shift


def sobol(df: DataFrame, index: str, names: list[str], seed: int | None = None) -> DataFrame:
    """df with the coordinates, in [0, 1), of the point of each row's index in Sobol's sequence, one column for each of `names`; scrambled if there is
    a seed. An index that is null, below 0 or from 2^BITS on has no point (nulls).

    A point depends on its index and the seed alone, whatever the partitions, and nothing is shuffled. The first 2^k points have one in
    each of 2^k equal ranges of every coordinate."""
    v, shift = scrambled(len(names), seed) if seed is not None else (directions(len(names)), np.zeros(len(names), np.int64))
    at = F.col(index).cast("long")
    gray = df.withColumn("__gray", F.when((at >= 0) & (at < (1 << BITS)), at.bitwiseXOR(F.shiftright(at, 1))))
    made = {}
    for name, own, start in zip(names, v, shift):
        x = F.lit(int(start))
        for bit, number in enumerate(own):
            # all ones where the bit is set, else zero
            x = x.bitwiseXOR((-F.shiftright("__gray", bit).bitwiseAND(F.lit(1))).bitwiseAND(F.lit(int(number))))
        made[name] = x / float(1 << BITS)
    return gray.withColumns(made).drop("__gray")
