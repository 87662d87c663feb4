"""Cubic B-spline basis on quantile knots, as a column expression and as a batch function."""
import numpy as np
from pyspark.sql import Column, functions as F

DEGREE = 3
KNOT_PROBS = [0.0, 1 / 3, 2 / 3, 1.0]     # four knots


def knot_vector(inner: list[float]) -> list[float]:
    """Quantile knots continued evenly beyond both ends."""
    low, high = inner[1] - inner[0], inner[-1] - inner[-2]
    return ([inner[0] - low * k for k in range(DEGREE, 0, -1)] + list(inner)
            + [inner[-1] + high * k for k in range(1, DEGREE + 1)])


def spline_columns(x: Column, inner: list[float]) -> list[Column]:
    """Five columns per input: six cubic pieces without the last; constant outside the knots."""
    t = knot_vector(inner)
    v = F.least(F.greatest(x, F.lit(float(inner[0]))), F.lit(float(inner[-1])))
    last = len(t) - DEGREE - 2                    # the interval that also holds its right end
    # After clamping, no value lies outside intervals DEGREE..last.
    level = [F.lit(0.0) if i < DEGREE or i > last else
             ((v >= t[i]) & (v <= t[i + 1] if i == last else v < t[i + 1])).cast("double") for i in range(len(t) - 1)]
    for d in range(1, DEGREE + 1):
        grown = []
        for i in range(len(t) - 1 - d):
            value = F.lit(0.0)
            if t[i + d] > t[i]:
                value = value + (v - F.lit(t[i])) / F.lit(t[i + d] - t[i]) * level[i]
            if t[i + d + 1] > t[i + 1]:
                value = value + (F.lit(t[i + d + 1]) - v) / F.lit(t[i + d + 1] - t[i + 1]) * level[i + 1]
            grown.append(value)
        level = grown
    return level[:-1]


def spline_batch(x: np.ndarray, inner: list[float]) -> np.ndarray:
    """The same basis for a batch of values inside a task."""
    t = np.array(knot_vector(inner))
    v = np.clip(x, inner[0], inner[-1])[:, None]
    last = len(t) - DEGREE - 2
    level = ((v >= t[:-1]) & (v < t[1:])).astype(float)
    level[:, last] = np.where(v[:, 0] == t[last + 1], 1.0, level[:, last])
    level[:, last + 1:] = 0.0
    for d in range(1, DEGREE + 1):
        left, right = t[d:-1] - t[:-d - 1], t[d + 1:] - t[1:-d]
        a = np.where(left > 0, (v - t[:-d - 1]) / np.where(left > 0, left, 1), 0.0)
        b = np.where(right > 0, (t[d + 1:] - v) / np.where(right > 0, right, 1), 0.0)
        level = a * level[:, :-1] + b * level[:, 1:]
    return level[:, :-1]
