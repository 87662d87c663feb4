"""Ordinary least squares and its held-out evaluation, solved from fold moments."""
import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from wordframe.functions.numeric import finite, ratio
from wordframe.functions.statistics import t_two_sided
from wordframe.operators import factors
from wordframe.operators.moments import by_fold, cell_moments, centered, column_means, subset

RANK_TOLERANCE = 1e-12


class Fit(dict):
    """mean, scale, standardised beta (intercept first) and the raw-scale slopes and intercept."""


def solve_ols(moments: np.ndarray, anchor: np.ndarray) -> Fit:
    """Least squares with an intercept on training-standardised predictors."""
    n, mean, s = centered(moments)
    variance = np.diag(s)[:-1] / n
    floor = 1e-14 * np.maximum(np.diag(moments)[1:-1] / n, 1e-300)
    if np.any(variance <= floor):
        raise ValueError("constant training predictor")
    scale = np.sqrt(variance)
    corr = s[:-1, :-1] / n / np.outer(scale, scale)
    eigen = np.linalg.eigvalsh(corr)
    if eigen[0] <= RANK_TOLERANCE * eigen[-1]:
        raise ValueError("rank-deficient regression")
    beta = np.linalg.solve(corr, s[:-1, -1] / n / scale)
    slope = beta / scale
    x_mean, y_mean = mean[:-1] + anchor[:-1], mean[-1] + anchor[-1]
    sse = max(s[-1, -1] - n * beta @ (s[:-1, -1] / n / scale), 0.0)
    return Fit(n=int(round(n)), mean=x_mean, scale=scale, beta=np.r_[y_mean, beta], slope=slope,
               intercept=y_mean - slope @ x_mean, sse=sse, sst=s[-1, -1], corr=corr)


def fold_moments(df: DataFrame, columns: list[str], y: str, fold: str = "fold"):
    anchor = column_means(df, [*columns, y])
    return anchor, cell_moments(df, [*columns, y], by_fold(anchor), fold)


def training(moments: dict) -> dict[int, np.ndarray]:
    """Training moments of each fold: the total minus the fold."""
    total = sum(moments.values())
    return {int(f): total - m for f, m in moments.items()}


def fold_fits(moments: dict, anchor: np.ndarray, columns: list[int]) -> dict[int, Fit]:
    picked = np.r_[anchor[columns], anchor[-1]]
    return {f: solve_ols(subset(m, columns), picked) for f, m in training(moments).items()}


def model_table(spark: SparkSession, fits: dict[int, dict], name: str, fold: str = "fold") -> DataFrame:
    """One row per fold: intercept and slopes of one variant. The table has as many rows as folds."""
    rows = [(int(f), float(fit["intercept"]), [float(v) for v in fit["slope"]]) for f, fit in sorted(fits.items())]
    return spark.createDataFrame(rows, f"{fold} int, {name}_a double, {name}_b array<double>")


def linear_prediction(columns: list[str], name: str):
    value = F.col(f"{name}_a")
    for i, c in enumerate(columns):
        value = value + F.col(c) * F.col(f"{name}_b")[i]
    return value


def apply_models(df: DataFrame, variants: dict[str, tuple[list[str], dict[int, dict]]], fold: str = "fold",
                 suffix: str = "_prediction") -> DataFrame:
    """Held-out prediction of each row by the model of its fold, for all variants in one projection.

    Every row stays. One whose fold has no model gets a null prediction; ``unpredicted`` lists such rows.
    """
    spark = df.sparkSession
    keep = df.columns
    for name, (columns, fits) in variants.items():
        df = df.join(F.broadcast(model_table(spark, fits, name, fold)), fold, "left")
    return df.select(*keep, *[linear_prediction(columns, name).alias(f"{name}{suffix}")
                              for name, (columns, _) in variants.items()])


def cross_validate(df: DataFrame, variants: dict[str, list[str]], y: str, fold: str = "fold",
                   suffix: str = "_prediction"):
    """Held-out OLS for several column sets from one pass; returns predictions and the scaling audit."""
    columns = sorted({c for cs in variants.values() for c in cs})
    anchor, moments = fold_moments(df, columns, y, fold)
    fits = {name: fold_fits(moments, anchor, [columns.index(c) for c in cs]) for name, cs in variants.items()}
    audit = [(name, f, fit["n"], int(round(moments[str(f)][0, 0])), [float(v) for v in fit["mean"]],
              [float(v) for v in fit["scale"]]) for name, by in fits.items() for f, fit in sorted(by.items())]
    audit_df = df.sparkSession.createDataFrame(
        audit, "variant string, fold int, train_n bigint, test_n bigint, "
               "training_mean array<double>, training_scale array<double>")
    return apply_models(df, {n: (variants[n], fits[n]) for n in variants}, fold, suffix), audit_df


def cross_validate_factors(df: DataFrame, variants: dict[str, list[str]], y: str, fold: str = "fold", suffix: str = "_prediction") -> DataFrame:
    """Held-out OLS as ``cross_validate``, from triangular factors: for designs that nearly depend linearly.

    The training rows of a fold are the merge of the factors of all other folds, so nothing is lost by a difference.
    """
    columns = sorted({c for cs in variants.values() for c in cs})
    anchor = column_means(df, [*columns, y])
    cells = factors.cell_factors(df, [*columns, y], by_fold(anchor), fold)
    folds = sorted(cells, key=int)
    others = dict(zip(folds, factors.leave_one_out([cells[f] for f in folds])))
    fits = {}
    for name, cs in variants.items():
        at = [columns.index(c) for c in cs]
        fits[name] = {}
        for f, r in others.items():
            slopes, intercept = factors.least_squares(factors.subset(r, at))
            fits[name][int(f)] = dict(slope=slopes, intercept=float(intercept + anchor[-1] - anchor[at] @ slopes))
    return apply_models(df, {n: (variants[n], fits[n]) for n in variants}, fold, suffix)


def coefficient_rows(fit: Fit, names: list[str]) -> list[tuple]:
    """Estimate, standard error, t and two-sided p of the intercept and each standardised predictor."""
    df = fit["n"] - len(fit["beta"])
    sigma2 = fit["sse"] / df
    se = np.sqrt(sigma2 * np.r_[1.0 / fit["n"], np.diag(np.linalg.inv(fit["corr"])) / fit["n"]])
    rows = []
    for name, b, s in zip(["intercept", *names], fit["beta"], se):
        t = float(b / s)
        rows.append((name, float(b), float(s), t, t_two_sided(t, df)))
    return rows


def describe(df: DataFrame, columns: list[str], y: str) -> tuple[Fit, list[tuple]]:
    """Whole-sample coefficient table."""
    anchor, moments = fold_moments(df.withColumn("_all", F.lit(0)), columns, y, "_all")
    fit = solve_ols(moments["0"], anchor)
    return fit, coefficient_rows(fit, columns)


def metrics(y, prediction) -> tuple:
    """Aggregate expressions: pooled RMSE, and R² against the overall mean."""
    error = y - prediction
    return F.sqrt(F.avg(error * error)), 1 - ratio(F.sum(error * error), F.count(y) * F.var_pop(y))


def metric_table(df: DataFrame, y: str, predictions: dict[str, str]) -> DataFrame:
    """variant, n, rmse, r2 for several prediction columns in one aggregate."""
    aggregates = []
    for v, c in predictions.items():
        rmse, r2 = metrics(F.col(y), F.col(c))
        aggregates.append(F.struct(F.lit(v).alias("variant"), F.count(y).alias("n"), rmse.alias("rmse"),
                                   r2.alias("r2")))
    return df.agg(F.array(*aggregates).alias("rows")).select(F.inline("rows"))


def unpredicted(df: DataFrame, keys: list[str], predictions: list[str]) -> DataFrame:
    """Violations of held-out completeness: keys that occur more than once or lack a finite prediction, with the reason."""
    bad = F.lit(False)
    for p in predictions:
        bad = bad | ~F.coalesce(finite(F.col(p)), F.lit(False))
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    reason = F.concat_ws(";", F.when(F.col("n") > 1, "repeated"), F.when(F.col("bad") > 0, "no_prediction"))
    return counts.filter("n > 1 OR bad > 0").select(*keys, reason.alias("reason"))
