"""Nested ridge with training-only preprocessing.

All fits are solved from moments of (outer, inner) cells. For designs that do not depend on the training
rows, 50 additive cells serve every training set. Splines and principal components do depend on them; then
one more pass accumulates, for each training set, the moments of its own training and validation rows.
"""
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wordframe.functions.basis import KNOT_PROBS, spline_batch
from wordframe.operators import factors
from wordframe.operators.moments import by_inner_fold, cell_moments, centered, column_means, subset
from wordframe.operators.selection import nested_sets, selected
from wordframe.plans.linear import apply_models

ALPHAS = np.logspace(-4, 4, 25)
INNER = 5


def ridge_path(moments: np.ndarray, alphas) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and intercepts for every penalty, on training-standardised predictors, intercept unpenalised."""
    n, mean, s = centered(moments)
    variance = np.diag(s)[:-1] / n
    level = np.maximum(np.diag(moments)[1:-1] / n, 1e-300)
    scale = np.where(variance > 1e-14 * level, np.sqrt(np.maximum(variance, 0)), 1.0)
    gram, cross = s[:-1, :-1] / np.outer(scale, scale), s[:-1, -1] / scale
    values, basis = np.linalg.eigh(gram)
    weights = (basis.T @ cross)[:, None] / (np.maximum(values, 0.0)[:, None] + np.asarray(alphas, float)[None, :])
    slopes = basis @ weights / scale[:, None]
    return slopes, mean[-1] - mean[:-1] @ slopes


def squared_error(moments: np.ndarray, slopes: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """Sum of squared errors on the rows behind ``moments``, for every penalty."""
    theta = np.vstack([-intercepts, -slopes, np.ones_like(intercepts)])
    return np.maximum(np.einsum("ia,ij,ja->a", theta, moments, theta), 0.0)


class Problem:
    """Moments per training set over one wide design; variants are subsets of its columns."""

    def __init__(self, names: list[str], anchor: np.ndarray, outer: list[int]):
        self.names, self.anchor, self.outer = names, anchor, outer

    def at(self, columns: list[str]) -> list[int]:
        return [self.names.index(c) for c in columns]

    def path(self, part, at: list[int], alphas):
        """Slopes and intercepts for every penalty, fitted on one part."""
        return ridge_path(subset(part, at), alphas)

    def errors(self, part, at: list[int], slopes, intercepts):
        """Sums of squared errors of such fits on another part."""
        return squared_error(subset(part, at), slopes, intercepts)


class AdditiveProblem(Problem):
    def __init__(self, names, anchor, outer, cells):
        super().__init__(names, anchor, outer)
        self.cells = cells
        self.totals = {o: sum(cells[f"{o}:{i}"] for i in range(INNER)) for o in outer}

    def train(self, o, i):
        return self.totals[o] - self.cells[f"{o}:{i}"]

    def validate(self, o, i):
        return self.cells[f"{o}:{i}"]

    def refit(self, o):
        return self.totals[o]


class FactorProblem(AdditiveProblem):
    """The same design held as triangular factors, for predictors that nearly depend on each other."""

    def __init__(self, names, anchor, outer, cells):
        Problem.__init__(self, names, anchor, outer)
        self.cells, self.others, self.whole = cells, {}, {}
        for o in outer:
            parts = [cells[f"{o}:{i}"] for i in range(INNER)]
            self.others.update({(o, i): r for i, r in enumerate(factors.leave_one_out(parts))})
            self.whole[o] = factors.factor(*parts)

    def train(self, o, i):
        return self.others[o, i]

    def refit(self, o):
        return self.whole[o]

    def path(self, part, at, alphas):
        return factors.ridge_path(factors.subset(part, at), alphas)

    def errors(self, part, at, slopes, intercepts):
        return factors.squared_error(factors.subset(part, at), slopes, intercepts)


class FittedProblem(Problem):
    """Designs refitted per training set; ``expand`` maps (outer, inner or None) to a batch transform."""

    def __init__(self, names, anchor, outer, cells, raw, expand):
        super().__init__(names, anchor, outer)
        self.cells, self.raw, self.expand = cells, raw, expand

    def train(self, o, i):
        return self.cells[f"t:{o}:{i}"]

    def validate(self, o, i):
        return self.cells[f"v:{o}:{i}"]

    def refit(self, o):
        return self.cells[f"r:{o}"]


def plain_problem(df: DataFrame, columns: list[str], y: str, outer: list[int]) -> AdditiveProblem:
    anchor = column_means(df, [*columns, y])
    cells = cell_moments(df, [*columns, y], by_inner_fold(anchor, outer), inner="inner", outer=len(outer))
    return AdditiveProblem(columns, anchor, outer, cells)


def factor_problem(df: DataFrame, columns: list[str], y: str, outer: list[int]) -> FactorProblem:
    """As ``plain_problem`` for ill-conditioned designs: exact to the condition of the design, not of its square."""
    anchor = column_means(df, [*columns, y])
    cells = factors.cell_factors(df, [*columns, y], by_inner_fold(anchor, outer), inner="inner", outer=len(outer))
    return FactorProblem(columns, anchor, outer, cells)


def fitted_problem(df: DataFrame, raw: list[str], y: str, outer: list[int], names: list[str],
                   expand: dict[tuple, Callable]) -> FittedProblem:
    """``expand[o, i](x)`` turns a batch of raw columns into the wide design under training set (o, i).

    Columns taken over unchanged are the same under every training set: their products among themselves come from
    additive cells, and only products with fitted columns are summed for each set.
    """
    # Columns taken over unchanged are anchored at their means; fitted columns are already near zero.
    plain = [n for n in names if n in raw]
    means = dict(zip([*plain, y], column_means(df, [*plain, y])))
    anchor = np.array([means.get(n, 0.0) for n in names] + [means[y]])
    fitted = [j for j, n in enumerate(names) if n not in raw]
    kept, source = [j for j in range(len(names)) if j not in set(fitted)], [raw.index(n) for n in plain]
    at_fitted, at_kept = np.array(fitted, int) + 1, np.array([0, *[j + 1 for j in kept], len(names) + 1])

    def emit(x, _folds, inner):
        for s, o in enumerate(outer):
            order = np.argsort(inner[:, s], kind="stable")[(inner[:, s] < 0).sum():]        # by inner fold, so that a fold is a slice
            if not len(order):
                continue
            rows = x[order]
            ends = np.searchsorted(inner[order, s], np.arange(INNER + 1))
            base = np.column_stack([np.ones(len(rows)), rows[:, source] - anchor[kept], rows[:, -1] - anchor[-1]])
            for i in range(INNER):
                yield f"{o}:{i}", base[ends[i]:ends[i + 1]]
            for i in (*range(INNER), None) if fitted else ():
                new = expand[o, i](rows[:, :-1])[:, fitted]
                both = np.column_stack([new, base])
                if i is None:
                    yield f"r:{o}", new, both
                    continue
                a, b = ends[i], ends[i + 1]
                yield f"v:{o}:{i}", new[a:b], both[a:b]
                yield f"t:{o}:{i}", new[:a], both[:a]
                yield f"t:{o}:{i}", new[b:], both[b:]

    parts = cell_moments(df, [*raw, y], emit, inner="inner", outer=len(outer))

    def whole(unchanged, cell):
        full = np.zeros((len(names) + 2, len(names) + 2))
        full[np.ix_(at_kept, at_kept)] = unchanged
        if fitted:
            block = parts[cell].reshape(len(fitted), -1)
            full[np.ix_(at_fitted, at_fitted)] = block[:, :len(fitted)]
            full[np.ix_(at_fitted, at_kept)] = block[:, len(fitted):]
            full[np.ix_(at_kept, at_fitted)] = block[:, len(fitted):].T
        return full

    cells = {}
    for o in outer:
        total = sum(parts[f"{o}:{i}"] for i in range(INNER))
        cells[f"r:{o}"] = whole(total, f"r:{o}")
        for i in range(INNER):
            cells[f"v:{o}:{i}"] = whole(parts[f"{o}:{i}"], f"v:{o}:{i}")
            cells[f"t:{o}:{i}"] = whole(total - parts[f"{o}:{i}"], f"t:{o}:{i}")
    return FittedProblem(names, anchor, outer, cells, raw, expand)


def tune(problem: Problem, outer: int, columns: list[str], alphas=ALPHAS) -> dict:
    """Penalty with the smallest pooled inner error (the first on ties), and that penalty's error per inner fold."""
    at = problem.at(columns)
    losses = np.array([problem.errors(problem.validate(outer, i), at, *problem.path(problem.train(outer, i), at, alphas))
                       for i in range(INNER)])
    choice = int(np.argmin(losses.sum(axis=0)))
    return dict(alpha=float(alphas[choice]), loss=losses[:, choice], grid=losses.sum(axis=0), columns=columns)


def refit(problem: Problem, outer: int, columns: list[str], alpha: float) -> dict:
    """Slopes on the raw scale of the design, fitted on the whole outer training set."""
    at = problem.at(columns)
    slopes, intercept = problem.path(problem.refit(outer), at, [alpha])
    slope = slopes[:, 0]
    return dict(slope=slope, intercept=float(intercept[0] + problem.anchor[-1] - problem.anchor[at] @ slope),
                alpha=alpha, columns=columns)


def nested_ridge(problem: Problem, variants: dict[str, list[str]], alphas=ALPHAS):
    """Tuned and refitted model per (variant, outer fold)."""
    tuned = {v: {o: tune(problem, o, cs, alphas) for o in problem.outer} for v, cs in variants.items()}
    models = {v: {o: refit(problem, o, variants[v], t["alpha"]) for o, t in by.items()} for v, by in tuned.items()}
    return tuned, models


def predict(df: DataFrame, problem: Problem, models: dict[str, dict[int, dict]], fold: str = "fold",
            suffix: str = "_prediction") -> DataFrame:
    """Held-out prediction of every row under every variant."""
    if isinstance(problem, AdditiveProblem):
        # Variants may use different columns in different folds: absent columns have slope zero.
        wide = {}
        for v, by in models.items():
            columns = sorted({c for m in by.values() for c in m["columns"]})
            fits = {o: dict(intercept=m["intercept"], slope=[float(dict(zip(m["columns"], m["slope"])).get(c, 0.0))
                                                             for c in columns]) for o, m in by.items()}
            wide[v] = (columns, fits)
        return apply_models(df, wide, fold, suffix)
    raw, expand, names, y_anchor = problem.raw, problem.expand, list(models), problem.names
    weights = {o: np.zeros((len(y_anchor), len(names))) for o in problem.outer}
    intercepts = {o: np.array([models[v][o]["intercept"] for v in names]) for o in problem.outer}
    for j, v in enumerate(names):
        for o, m in models[v].items():
            weights[o][problem.at(m["columns"]), j] = m["slope"]
    out_names = [f"{v}{suffix}" for v in names]

    def score(batches):
        for batch in batches:
            x = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in raw])
            folds = batch.column(batch.schema.get_field_index(fold)).to_numpy(zero_copy_only=False)
            result = np.full((len(x), len(names)), np.nan)
            for o in np.unique(folds):
                rows = folds == o
                result[rows] = expand[int(o), None](x[rows]) @ weights[int(o)] + intercepts[int(o)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(result[:, j]) for j in range(len(names))]],
                                             [*batch.schema.names, *out_names])

    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in out_names]])
    return df.mapInArrow(score, schema)


def training_sets(outer: list[int]) -> list[tuple[int, int | None]]:
    return [(o, i) for o in outer for i in (*range(INNER), None)]


def set_knots(df: DataFrame, columns: list[str], outer: list[int], fold: str = "fold", inner: str = "inner") -> dict:
    """Quantile knots of each column under every training set: {(outer, inner): [knots per column]}.

    One selection over counts serves all columns and sets: no row is copied for the sets that it trains.
    """
    found = selected(df, columns, KNOT_PROBS, **nested_sets(outer, INNER, fold, inner))
    return {s: [found[s, c][1] for c in columns] for s in training_sets(outer)}


def spline_names(column: str) -> list[str]:
    return [f"{column}~{k}" for k in range(1, 6)]


def spline_expansion(raw: list[str], plain: list[str], splined: list[str], knots: dict) -> tuple[list[str], dict]:
    """Design with ``plain`` columns first and the spline columns last."""
    names = [*plain, *[n for c in splined for n in spline_names(c)]]
    at_plain, at_spline = [raw.index(c) for c in plain], [raw.index(c) for c in splined]

    def transform(inner_knots):
        def apply(x):
            return np.column_stack([x[:, at_plain], *[spline_batch(x[:, a], k) for a, k in zip(at_spline, inner_knots)]])
        return apply
    return names, {s: transform(k) for s, k in knots.items()}


def design_layout(core: list[str], strong: list[str], extras: list[str], spline: bool) -> tuple[list[str], int]:
    """Names of a design in order, each once, and how many of them are plain.

    The columns that ``strong`` adds to ``core`` are the trajectory. Where they are splined they stand last, behind
    the extras, so the plain part of the design is one stretch; otherwise extras are appended.
    """
    trajectory = [c for c in strong if c not in core]
    extras = [c for c in dict.fromkeys(extras) if c not in strong]
    names = [*core, *extras, *trajectory] if spline else [*core, *trajectory, *extras]
    return names, len(names) - (len(trajectory) if spline else 0)


def spline_problem(df: DataFrame, plain: list[str], splined: list[str], y: str, outer: list[int]) -> FittedProblem:
    raw = [*plain, *splined]
    names, expand = spline_expansion(raw, plain, splined, set_knots(df, splined, outer))
    return fitted_problem(df, raw, y, outer, names, expand)


def fit_audit(problem: Problem, tuned: dict[str, dict[int, dict]], alphas=ALPHAS) -> list[tuple]:
    """What each fit saw: (variant, fold, inner or -1, rows, training means, training scales, pooled error per penalty).

    Inner rows describe the training part of each inner split, -1 the refit on all training rows of the outer fold.
    """
    rows = []
    for variant, by in tuned.items():
        for o, t in sorted(by.items()):
            at = problem.at(t["columns"])
            for i in (*range(INNER), None):
                n, mean, s = centered(subset(problem.refit(o) if i is None else problem.train(o, i), at))
                rows.append((variant, o, -1 if i is None else i, int(round(n)), [float(x) for x in mean[:-1] + problem.anchor[at]],
                             [float(x) for x in np.sqrt(np.maximum(np.diag(s)[:-1] / n, 0))], [float(x) for x in t["grid"]]))
    return rows


FIT_SCHEMA = "variant string, fold int, inner int, n bigint, mean array<double>, scale array<double>, grid_sse array<double>"


def audit_rows(tuned: dict[str, dict[int, dict]]) -> list[tuple]:
    return [(v, o, t["alpha"], [float(x) for x in t["loss"]]) for v, by in tuned.items() for o, t in sorted(by.items())]


AUDIT_SCHEMA = "variant string, fold int, alpha double, inner_sse array<double>"
