"""Large symmetric matrices in blocks: Cholesky's factor over many tasks tells whether they are positive definite, Lanczos' steps give the ends of their
spectrum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import saved

#: Rows of a block (2 MB), rows of a matrix at most (steps keep that many numbers each on the driver), and steps at most.
BLOCK, MOST, STEPS = 512, 1 << 16, 300
_KIND = "bi int, bj int, m binary"


def _matrix(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(size, size)


def blocks(c: DataFrame, size: int, block: int) -> DataFrame:
    """bi, bj, m: the blocks on and below the diagonal of a matrix (i, j, v), rows and columns taken in order of their names; beyond `size` the last
    block goes on as the unit matrix. m is null where a cell is missing, doubled or no finite number."""
    names = c.select("i").distinct().withColumn("n", F.row_number().over(Window.orderBy("i")) - 1)  # a row a name, MOST at most
    at = c.join(F.broadcast(names), "i").join(F.broadcast(names.select(F.col("i").alias("j"), F.col("n").alias("k"))), "j").where("n >= k OR floor(n / {0}) = floor(k / {0})".format(block))
    cells = at.select(*[F.floor(F.col(x) / block).cast("int").alias(b) for x, b in (("n", "bi"), ("k", "bj"))], (F.col("n") % block).alias("r"), (F.col("k") % block).alias("s"), F.col("v").cast("double").alias("v"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = (min(block, size - b * block) for b in key)
        m = np.eye(block) if key[0] == key[1] else np.zeros((block, block))
        m[:rows, :columns] = np.nan
        m[pdf.r, pdf.s] = pdf.v
        whole = len(pdf) == rows * columns and np.isfinite(m).all()
        return pd.DataFrame({"bi": [key[0]], "bj": [key[1]], "m": [m.tobytes() if whole else None]})

    return cells.groupBy("bi", "bj").applyInPandas(build, _KIND)


def positive_definite(a: DataFrame, count: int, block: int) -> bool:
    """Whether Cholesky's factor of the matrix of `count` block rows exists. Step k factors one block, divides the column below it by that, and takes
    the products of pairs of that column off the blocks that are left, each a group of three blocks; what is left is written each time."""
    for k in range(count):
        try:
            corner = np.linalg.cholesky(_matrix(a.where(f"bi = {k} AND bj = {k}").first().m, block))
        except np.linalg.LinAlgError:
            return False
        if k == count - 1:
            break
        inverse = np.linalg.inv(corner).T

        def divide(frames: Iterator[pd.DataFrame], inverse=inverse) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(m=[(_matrix(m, block) @ inverse).tobytes() for m in f.m])

        def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
            by = dict(zip(pdf.source, pdf.m))
            i, j = int(pdf.bi.iloc[0]), int(pdf.bj.iloc[0])
            left = _matrix(by[-1], block) - _matrix(by[i], block) @ _matrix(by[j], block).T
            return pd.DataFrame({"bi": [i], "bj": [j], "m": [left.tobytes()]})

        column = saved(a.where(f"bj = {k} AND bi > {k}").mapInPandas(divide, _KIND), "column")
        sent = column.select(F.col("bi").alias("source"), "m", F.explode(F.sequence(F.lit(k + 1), F.lit(count - 1))).alias("t"))
        sent = sent.select(F.greatest("source", "t").alias("bi"), F.least("source", "t").alias("bj"), "m", "source")
        rest = a.where(f"bj > {k}").withColumn("source", F.lit(-1)).unionByName(sent)
        a = saved(rest.groupBy("bi", "bj").applyInPandas(reduce, _KIND), "rest")
    return True


def _product(a: DataFrame, x: np.ndarray, block: int) -> np.ndarray:
    """The matrix of blocks on and below the diagonal times x. Each block row of the result comes back, not each block's part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[int, np.ndarray] = {}
        for f in frames:
            for i, j, raw in zip(f.bi, f.bj, f.m):
                m = _matrix(raw, block)
                for to, of, v in ((i, j, m), (j, i, m.T))[: 1 if i == j else 2]:
                    parts[to] = parts.get(to, 0) + v @ x[of * block : (of + 1) * block]
        yield pd.DataFrame({"b": list(parts), "y": [v.tobytes() for v in parts.values()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": pdf.b.iloc[:1], "y": [sum(np.frombuffer(y) for y in pdf.y).tobytes()]})

    y = np.zeros(len(x))
    for r in a.mapInPandas(run, "b int, y binary").groupBy("b").applyInPandas(add, "b int, y binary").collect():
        y[r.b * block : (r.b + 1) * block] = np.frombuffer(r.y)
    return y


def extremes(a: DataFrame, size: int, count: int, block: int, tolerance: float = 1e-7, steps: int = STEPS) -> tuple[float, float] | None:
    """The least and greatest eigenvalue by Lanczos' steps with full orthogonalisation, each a product over all tasks, until both are settled: an
    eigenvalue lies within tolerance times the greatest size of each. None if they are not settled after `steps`."""
    x = np.zeros(count * block)
    x[:size] = np.random.default_rng(0).normal(size=size)
    basis, alpha, beta = [x / np.linalg.norm(x)], [], []
    for k in range(min(steps, size)):
        y = _product(a, basis[-1], block)
        alpha.append(float(basis[-1] @ y))
        held = np.array(basis)
        for _ in range(2):
            y -= held.T @ (held @ y)
        norm = float(np.linalg.norm(y))
        values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
        close = tolerance * max(abs(values[0]), abs(values[-1]))
        if k == size - 1 or max(norm * abs(vectors[-1, 0]), norm * abs(vectors[-1, -1])) <= close:
            return float(values[0]), float(values[-1])
        beta.append(norm)
        basis.append(y / norm)
    return None


def judge(c: DataFrame, size: int, block: int = BLOCK) -> tuple[bool | None, float | None, float | None]:
    """positive_definite, least_eigenvalue and condition of a symmetric matrix (i, j, v) of `size` rows: all None where cells are missing, doubled or
    no finite numbers; the last two None where Lanczos' steps do not settle, the condition also where the matrix is not positive definite."""
    if size > MOST:
        raise ValueError(f"at most {MOST} rows and columns")
    a = saved(blocks(c, size, block), "blocks")
    count = -(-size // block)
    if a.where("m IS NOT NULL").count() != count * (count + 1) // 2:
        return None, None, None
    definite = positive_definite(a, count, block)
    ends = extremes(a, size, count, block)
    low, high = ends or (None, None)
    return definite, low, high / low if definite and ends and low > 0 else None
