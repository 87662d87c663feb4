"""Leading principal components of wide vectors under many training sets, from products with thin blocks.

The covariance of d columns is never built. A step multiplies it by a block of a few columns, for all training sets in
one pass over the rows; partial products of tasks are summed in a tree. Between the steps the driver improves each
set's block inside the span of its estimates, their residuals and their last moves, which is a block Krylov iteration
that keeps three blocks instead of all of them.
"""
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from wordframe.cluster import cut

PRODUCT_SCHEMA = "at int, part long, product binary"
FAN = 16                    # partial products that one task adds up
EXTRA = 6                   # columns of a block beyond the wanted components: they make the iteration fast
STEPS = 60                  # passes over the rows, at most
TOLERANCE = 1e-9            # residual of a component, relative to the largest variance
_ROWS = 4096
SEED = 2026


def _batch(rows) -> pa.RecordBatch:
    at, part, held = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(at, pa.int32()), pa.array(part, pa.int64()), pa.array(held, pa.binary())], names=["at", "part", "product"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(held) for held in table["product"].to_pylist())
    return pa.Table.from_batches([_batch([(table["at"][0].as_py(), table["part"][0].as_py() // FAN, total.tobytes())])])


def _sums(rows: DataFrame, width: int, n_sets: int, term, shape: tuple) -> np.ndarray:
    """Sum of ``term(set, vectors of the set)`` over all rows, for each set; tasks are added up ``FAN`` at a time."""
    def partial(batches):
        held, number = {}, TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                x = np.asarray(part.column(0).flatten().to_numpy(zero_copy_only=False), float)
                if len(x) != part.num_rows * width:
                    raise ValueError("vectors of unlike length")
                x = x.reshape(-1, width)
                member = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_sets).astype(bool)
                for s in range(n_sets):
                    if member[:, s].any():
                        value = term(s, x[member[:, s]])
                        held[s] = held[s] + value if s in held else value
        yield _batch([(s, number, np.ascontiguousarray(v, float).tobytes()) for s, v in held.items()])

    parts = cut(rows.mapInArrow(partial, PRODUCT_SCHEMA))
    highest = parts.agg(F.max("part")).first()[0]
    while highest:
        parts = parts.groupBy("at", F.floor(F.col("part") / FAN).alias("_to")).applyInArrow(_added, PRODUCT_SCHEMA)
        highest //= FAN
    out = np.zeros((n_sets, *shape))
    for r in parts.collect():                                   # one row per set
        out[r["at"]] = np.frombuffer(r["product"]).reshape(shape)
    return out


def _improved(blocks: list[np.ndarray], images: list[np.ndarray], size: int):
    """Best ``size`` directions inside the span of ``blocks``, and their images, as (values, vectors, images, moves, move images).

    ``images`` are the products of the covariance with the blocks. Directions that the span holds twice are dropped.
    """
    span, image = np.column_stack(blocks), np.column_stack(images)
    norms = np.linalg.norm(span, axis=0)
    span, image = span[:, norms > 0] / norms[norms > 0], image[:, norms > 0] / norms[norms > 0]
    values, turn = np.linalg.eigh(span.T @ span)
    real = values > 1e-10 * values.max()
    to = turn[:, real] / np.sqrt(values[real])
    inner = to.T @ (span.T @ image) @ to
    ritz, rotate = np.linalg.eigh((inner + inner.T) / 2)
    picked = to @ rotate[:, ::-1][:, :size]
    moved = picked.copy()
    moved[:blocks[0].shape[1]] = 0                              # the part that did not come from the old estimates
    return ritz[::-1][:size], span @ picked, image @ picked, span @ moved, image @ moved


def leading(df: DataFrame, vec: str, sets: dict[object, Column], count: int, steps: int = STEPS, tolerance: float = TOLERANCE) -> dict:
    """``{set: (n, mean, loadings, variances)}``: the ``count`` leading components of the rows of each set.

    ``sets`` maps names to conditions on a row; null is no. Variances are those of samples (n - 1). The largest loading of each
    component is positive. Vectors must be finite and of one length; with fewer columns than ``count`` there are as many
    components as columns. A set of fewer than two rows is not in the result. The driver holds six blocks of (columns x
    (count + EXTRA)) per set; narrow vectors need a single pass.
    """
    names = list(sets)
    member = F.array(*[F.coalesce(c.cast("boolean"), F.lit(False)) for c in sets.values()])
    rows = cut(df.select(F.col(vec).cast("array<double>").alias("v"), member.alias("m")))
    first = rows.select(F.size("v").alias("d")).first()
    if first is None:
        return {}
    width, n_sets = first["d"], len(names)
    head = _sums(rows, width, n_sets, lambda s, x: np.concatenate([[len(x)], x.sum(0)]), (width + 1,))
    n, means = head[:, 0], head[:, 1:] / np.maximum(head[:, :1], 1)
    block = min(width, count + EXTRA)
    start = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, block)))[0]
    alive = [s for s in range(n_sets) if n[s] >= 2]

    def multiplied(thin: np.ndarray) -> np.ndarray:
        context = rows.sparkSession.sparkContext
        held = context.broadcast((thin, means))                 # sets x columns x block numbers

        def term(s, x):
            blocks, centre = held.value
            z = x - centre[s]
            return z.T @ (z @ blocks[s])
        out = _sums(rows, width, n_sets, term, thin.shape[1:])
        held.unpersist()
        return out / np.maximum(n - 1, 1)[:, None, None]

    vectors = np.repeat(start[None], n_sets, axis=0)
    images = multiplied(vectors)
    values = np.zeros((n_sets, block))
    moves, moved_images = np.zeros((n_sets, width, 0)), np.zeros((n_sets, width, 0))
    for s in alive:
        values[s], vectors[s], images[s], *_ = _improved([vectors[s]], [images[s]], block)
    for _ in range(steps if block < width else 0):
        rest = images - vectors * values[:, None, :]
        size = np.linalg.norm(rest, axis=1)
        if all((size[s, :count] <= tolerance * max(values[s, 0], 1e-300)).all() for s in alive):
            break
        rest = np.where(size[:, None, :] > 0, rest / np.where(size > 0, size, 1)[:, None, :], 0)
        rest -= vectors @ (np.swapaxes(vectors, 1, 2) @ rest)
        products = multiplied(rest)
        next_moves, next_images = np.zeros_like(vectors), np.zeros_like(vectors)
        for s in alive:
            got = _improved([vectors[s], rest[s], moves[s]], [images[s], products[s], moved_images[s]], block)
            k = len(got[0])
            values[s, :k], vectors[s, :, :k], images[s, :, :k], next_moves[s, :, :k], next_images[s, :, :k] = got
        moves, moved_images = next_moves, next_images
    out, count = {}, min(count, width)
    for s in alive:
        loadings = vectors[s, :, :count]
        loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(count)])
        out[names[s]] = (int(n[s]), means[s], loadings, np.maximum(values[s, :count], 0.0))
    return out
