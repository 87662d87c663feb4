"""Second moments of a design, accumulated per cell in one distributed pass.

Every least-squares, ridge and principal-component fit below is solved from these sums. A cell is a
(outer fold, inner fold) pair, so one pass serves all folds, penalties and column subsets; what reaches
the driver depends on the number of columns and cells, never on the number of rows.
"""
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MOMENT_SCHEMA = "cell string, pos int, value double"
PAIRED = "*"        # before the name of a cell that holds products of two different tables


def column_means(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Anchor for the sums: subtracting it first keeps 'total minus fold' stable."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return np.array([float(v) for v in row])


def _stack(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                            for c in columns]).astype(np.float64)


def _labels(batch, name):
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _inner(batch, name, outer):
    flat = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, outer)


def cell_moments(df: DataFrame, columns: list[str], emit: Callable[..., Iterator], fold: str = "fold",
                 inner: str | None = None, outer: int = 10) -> dict[str, np.ndarray]:
    """Sum Z'Z per cell, where ``emit(x, folds, inner)`` yields ``(cell, Z)`` pairs for a batch of rows.

    For ``(cell, A, Z)`` it is A'Z, given back row by row in one vector.
    """
    names = [*columns, fold] + ([inner] if inner else [])

    def partial(batches):
        sums = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _stack(batch, columns)
            split = _inner(batch, inner, outer) if inner else None
            for cell, *parts in emit(x, _labels(batch, fold), split):
                cell = cell if len(parts) == 1 else PAIRED + cell
                product = parts[0].T @ parts[-1]
                sums[cell] = sums[cell] + product if cell in sums else product
        for cell, total in sums.items():
            upper = total.ravel() if cell.startswith(PAIRED) else total[np.triu_indices(len(total))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([cell] * len(upper), pa.string()), pa.array(np.arange(len(upper)), pa.int32()),
                 pa.array(upper, pa.float64())], ["cell", "pos", "value"])

    table = (df.select(*names).mapInArrow(partial, MOMENT_SCHEMA)
             .groupBy("cell", "pos").agg(F.sum("value").alias("value")).toArrow())
    cells, pos, value = (table.column(n).to_numpy() for n in ("cell", "pos", "value"))
    result = {}
    order = np.lexsort((pos, cells))
    cells, value = cells[order], value[order]
    bounds = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True]) if len(cells) else []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if cells[a].startswith(PAIRED):
            result[cells[a][len(PAIRED):]] = value[a:b]
            continue
        width = int((np.sqrt(8 * (b - a) + 1) - 1) / 2)
        full = np.zeros((width, width))
        full[np.triu_indices(width)] = value[a:b]
        result[str(cells[a])] = full + np.triu(full, 1).T
    return result


class Anchored:
    """Row of the augmented design: one, the anchored columns, the anchored outcome (last column)."""

    def __init__(self, anchor: np.ndarray):
        self.anchor = anchor

    def __call__(self, x):
        return np.column_stack([np.ones(len(x)), x - self.anchor])


def by_fold(anchor: np.ndarray):
    """Emit one cell per outer fold."""
    design = Anchored(anchor)

    def emit(x, folds, _inner_folds):
        z = design(x)
        for f in np.unique(folds):
            yield str(int(f)), z[folds == f]
    return emit


def by_inner_fold(anchor: np.ndarray, outer: list[int]):
    """Emit one cell per (outer, inner) pair; a row appears once for each outer fold that trains on it."""
    design = Anchored(anchor)

    def emit(x, _folds, inner_folds):
        z = design(x)
        for s, o in enumerate(outer):
            for i in range(int(inner_folds[:, s].max(initial=-1)) + 1):
                rows = inner_folds[:, s] == i
                if rows.any():
                    yield f"{o}:{i}", z[rows]
    return emit


def by_weights(anchor: np.ndarray, cells: list[str]):
    """Emit one cell per weight: the last columns of a row tell how many such rows each cell holds."""
    design = Anchored(anchor)

    def emit(x, _folds, _inner_folds):
        z = design(x[:, :len(anchor)])
        for j, cell in enumerate(cells):
            weight = x[:, len(anchor) + j]
            rows = weight > 0
            yield cell, z[rows] * weight[rows, None], z[rows]
    return emit


def subset(moments: np.ndarray, columns: list[int]) -> np.ndarray:
    """Moments of the design with only these predictors (0-based), intercept and outcome kept."""
    keep = [0, *[c + 1 for c in columns], len(moments) - 1]
    return moments[np.ix_(keep, keep)]


def centered(moments: np.ndarray):
    """n, means and centred cross products of all non-intercept columns."""
    n = moments[0, 0]
    mean = moments[0, 1:] / n
    return n, mean, moments[1:, 1:] - n * np.outer(mean, mean)
