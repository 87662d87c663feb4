"""Triangular factors of a design per cell: least squares without squaring the design.

The factor R of a QR decomposition holds what the moments hold, at the condition of the design instead of its square.
Factors merge: that of stacked rows is the factor of their stacked factors, so tasks make partial ones and a tree merges
them. They do not subtract; "all but one cell" is the merge of the cells before it and the cells after it.
"""
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wordframe.cluster import cut
from wordframe.operators.moments import _inner, _labels, _stack

FACTOR_SCHEMA = "cell string, part long, width int, factor binary"
FAN = 32                    # factors that one task merges
_ROWS = 4096                # rows that are decomposed at once


def factor(*blocks: np.ndarray) -> np.ndarray:
    """Upper triangular R, square and with a diagonal of no negative numbers, with R'R = Z'Z for the stacked blocks Z."""
    stacked = np.vstack(blocks)
    width = stacked.shape[1]
    if len(stacked) < width:
        stacked = np.vstack([stacked, np.zeros((width - len(stacked), width))])
    r = np.linalg.qr(stacked, mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def leave_one_out(factors: list[np.ndarray]) -> list[np.ndarray]:
    """For each factor the merge of all others, from merges of prefixes and suffixes: three merges per factor."""
    none = np.zeros((0, factors[0].shape[1]))
    before, after = [none], [none]
    for r in factors[:-1]:
        before.append(factor(before[-1], r))
    for r in factors[:0:-1]:
        after.append(factor(after[-1], r))
    return [factor(a, b) for a, b in zip(before, reversed(after))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cell, part, width, held = zip(*rows) if rows else ([], [], [], [])
    return pa.record_batch([pa.array(cell, pa.string()), pa.array(part, pa.int64()), pa.array(width, pa.int32()), pa.array(held, pa.binary())],
                           names=["cell", "part", "width", "factor"])


def _matrix(width: int, held: bytes) -> np.ndarray:
    return np.frombuffer(held).reshape(width, width)


def _merged(table: pa.Table) -> pa.Table:
    width = table["width"][0].as_py()
    r = factor(*[_matrix(width, held) for held in table["factor"].to_pylist()])
    return pa.Table.from_batches([_batch([(table["cell"][0].as_py(), table["part"][0].as_py() // FAN, width, r.tobytes())])])


def cell_factors(df: DataFrame, columns: list[str], emit: Callable[..., Iterator], fold: str = "fold", inner: str | None = None,
                 outer: int = 10) -> dict[str, np.ndarray]:
    """Factor per cell, where ``emit(x, folds, inner)`` yields ``(cell, Z)`` pairs for a batch of rows, as for moments.

    Partial factors of tasks are merged ``FAN`` at a time until each cell has one; only those reach the driver. Cells
    without rows are not in the result. Values must be finite.
    """
    names = [*columns, fold] + ([inner] if inner else [])

    def partial(batches):
        held, number = {}, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(at, _ROWS)
                for cell, z in emit(_stack(rows, columns), _labels(rows, fold), _inner(rows, inner, outer) if inner else None):
                    if len(z):
                        held[cell] = factor(held[cell], z) if cell in held else factor(z)
        yield _batch([(cell, number, len(r), r.tobytes()) for cell, r in held.items()])

    parts = cut(df.select(*names).mapInArrow(partial, FACTOR_SCHEMA))
    highest = parts.agg(F.max("part")).first()[0]
    while highest:
        parts = parts.groupBy("cell", F.floor(F.col("part") / FAN).alias("_to")).applyInArrow(_merged, FACTOR_SCHEMA)
        highest //= FAN
    return {r["cell"]: _matrix(r["width"], r["factor"]).copy() for r in parts.collect()}


def subset(r: np.ndarray, columns: list[int]) -> np.ndarray:
    """Factor of the design with only these predictors (0-based), intercept and outcome kept."""
    return factor(r[:, [0, *[c + 1 for c in columns], r.shape[1] - 1]])


def _split(r: np.ndarray):
    """Rows, means, and the factor of the centred predictors and outcome: the block below the column of ones."""
    return r[0, 0] ** 2, r[0, 1:] / r[0, 0], r[1:, 1:]


def least_squares(r: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and intercept. Predictors that depend on each other to the last digits are an error."""
    _, mean, inner = _split(r)
    size = np.linalg.norm(inner[:, :-1], axis=0)
    scale = np.where(size > 1e-13 * np.linalg.norm(r[:, 1:-1], axis=0), size, np.inf)      # a constant column is no predictor
    slopes, _, rank, _ = np.linalg.lstsq(inner[:, :-1] / scale, inner[:, -1], rcond=1e-13)
    if rank < len(size):
        raise ValueError("rank-deficient regression")
    return slopes / scale, float(mean[-1] - mean[:-1] @ (slopes / scale))


def ridge_path(r: np.ndarray, alphas) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and intercepts for every penalty, on training-standardised predictors, intercept unpenalised."""
    n, mean, inner = _split(r)
    size = np.linalg.norm(inner[:, :-1], axis=0)
    noise = 1e-13 * np.linalg.norm(r[:, 1:-1], axis=0)          # what rounding leaves of a constant column
    scale = np.where(size > noise, size / np.sqrt(n), 1.0)
    u, values, basis = np.linalg.svd(inner[:, :-1] / scale, full_matrices=False)
    damped = values[:, None] / (values[:, None] ** 2 + np.asarray(alphas, float)[None, :])
    slopes = basis.T @ ((u.T @ inner[:, -1])[:, None] * damped) / scale[:, None]
    return slopes, mean[-1] - mean[:-1] @ slopes


def squared_error(r: np.ndarray, slopes: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """Sum of squared errors on the rows behind the factor, for every penalty."""
    return (np.square(r @ np.vstack([-intercepts, -slopes, np.ones_like(intercepts)]))).sum(axis=0)
