"""Sums of products with waves of a whole family of frequencies, without a row for each row and frequency.

A task takes its rows in batches, as matrices: the phases of a block of frequencies are the phase at the block's first, taken
anew for each block, turned by the steps within the block, which on an even grid are the same for all blocks. So a batch costs one
matrix product a block, and a sine and a cosine for each row and block in place of each row and frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequencies of a block and rows of a batch; their phases are 8 MB.
BLOCK, BATCH = 256, 2048
#: Bytes of sums that a task holds before it sends them on.
HELD = 64 << 20


def turns(t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """exp(2 pi i t f) for all pairs, whole turns taken off first."""
    x = np.multiply.outer(t, f)
    return np.exp(2j * np.pi * (x - np.rint(x)))


class Family:
    """The sums of one group: of x times the wave at each frequency, and of q times the square of the wave."""

    def __init__(self, frequencies: np.ndarray, columns: int):
        self.f, self.x = frequencies, np.zeros((columns, len(frequencies)), complex)
        self.square, self.total = np.zeros(len(frequencies), complex), 0.0

    def add(self, t: np.ndarray, x: np.ndarray, q: np.ndarray) -> None:
        close = 4 * np.finfo(float).eps * np.abs(self.f).max(initial=0)
        for i in range(0, len(t), BATCH):
            own, rows, weight = t[i : i + BATCH], x[i : i + BATCH], q[i : i + BATCH]
            held = None
            for k in range(0, len(self.f), BLOCK):
                step = self.f[k : k + BLOCK] - self.f[k]
                if held is None or len(held) < len(step) or np.abs(held[: len(step)] - step).max() > close:
                    held, turn = step, turns(own, step)
                    twice = turn * turn
                start = turns(own, self.f[k])
                self.x[:, k : k + BLOCK] += (rows * start[:, None]).T @ turn[:, : len(step)]
                self.square[k : k + BLOCK] += (weight * start * start) @ twice[:, : len(step)]
            self.total += weight.sum()

    def frame(self) -> dict:
        """c0, s0, c1, ... of the columns, then cc, cs and ss; what rounding alone leaves of these is none."""
        real, tiny = self.square.real, 1e-13 * abs(self.total)
        clean = lambda v: np.where(np.abs(v) > tiny, v, 0.0)
        out = {f"{n}{i}": v for i, row in enumerate(self.x) for n, v in (("c", row.real), ("s", row.imag))}
        return out | {"cc": clean((self.total + real) / 2), "cs": clean(self.square.imag / 2), "ss": clean((self.total - real) / 2)}


def wave_sums(df: DataFrame, keys: list[str], t: Column, columns: list[Column], frequencies: list[float], weight: Column | None = None, modulator: Column | None = None) -> DataFrame:
    """keys, frequency, and for each group and frequency c0, s0, c1, s1, ... (sums of weight * modulator * column i times cos and sin of
    2 pi f t) and cc, cs, ss (sums of weight * modulator^2 times cos^2, cos sin, sin^2).

    The family is a parameter: a list of any frequencies, an even grid being quickest. Rows with a null or NaN in a key, t or column are left
    out. A task sends one row for each of its groups and frequencies, more often where it has very many groups; those are summed."""
    w, m = (c if c is not None else F.lit(1.0) for c in (weight, modulator))
    names = [f"x{i}" for i in range(len(columns))]
    made = [*[f"{n}{i}" for i in range(len(columns)) for n in "cs"], "cc", "cs", "ss"]
    ids = {f"k{i}": k for i, k in enumerate(keys)}
    rows = df.select(*[F.col(k).alias(i) for i, k in ids.items()], t.cast("double").alias("t"), (w * m * m).cast("double").alias("q"), *[(w * m * c).cast("double").alias(n) for n, c in zip(names, columns)])
    family = np.array(frequencies, float)
    width = len(names)
    most = max(1, HELD // (16 * (width + 1) * max(len(family), 1)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Family] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for key, sums in held.items():
                yield pd.DataFrame(dict(zip(ids, key)) | {"frequency": family} | sums.frame())
            held.clear()

        for f in frames:
            f = f.dropna()
            groups = f.groupby(list(ids), sort=False) if ids else [((), f)]
            for key, part in groups:
                if key not in held:
                    if len(held) >= most:
                        yield from flush()
                    held[key] = Family(family, width)
                held[key].add(part["t"].to_numpy(), part[names].to_numpy(), part["q"].to_numpy())
        yield from flush()

    kinds = "".join(f"{i} {df.schema[k].dataType.simpleString()}, " for i, k in ids.items())
    parts = rows.mapInPandas(run, kinds + "frequency double, " + ", ".join(f"{c} double" for c in made))
    return parts.groupBy(*ids, "frequency").agg(*[F.sum(c).alias(c) for c in made]).withColumnsRenamed(ids)
