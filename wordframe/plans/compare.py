"""Comparison of held-out predictions: overall, by fold and context, by subgroup, and by concentration."""
import math

from pyspark.sql import Column, DataFrame, functions as F

from wordframe.functions.numeric import ratio, safe_corr
from wordframe.operators.ranking import exact_quantiles
from wordframe.operators.selection import fold_sets, selected

PROFILE = [0.5, 0.05, 0.95]


def rmse(y: Column, prediction: Column) -> Column:
    return F.sqrt(F.avg((y - prediction) * (y - prediction)))


def outcome(gain: Column, band: float = 1e-10) -> Column:
    return F.when(gain > band, "improves").when(gain < -band, "worsens").otherwise("reference/equivalent")


def stability(df: DataFrame, y: str, baseline: str, variants: dict[str, str], fold: str = "fold",
              context: str = "item") -> DataFrame:
    """Per fold and per context: n, both errors, gain and win of every variant, from one aggregate."""
    base = rmse(F.col(y), F.col(baseline))
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.count(F.lit(1)).alias("n"), base.alias("baseline_rmse"),
                              rmse(F.col(y), F.col(p)).alias("augmented_rmse")) for v, p in variants.items()])
    cells = df.groupingSets([[fold], [context]], fold, context).agg(
        F.grouping(fold).alias("_not_fold"), rows.alias("rows"))
    return cells.select(
        F.when(F.col("_not_fold") == 0, "fold").otherwise("context").alias("kind"),
        F.when(F.col("_not_fold") == 0, F.col(fold).cast("bigint")).otherwise(F.col(context).cast("bigint")).alias("group"),
        F.inline("rows")).withColumn("gain", F.col("baseline_rmse") - F.col("augmented_rmse")).withColumn(
        "win", F.col("augmented_rmse") < F.col("baseline_rmse"))


def wins(table: DataFrame) -> DataFrame:
    return table.groupBy("variant", "kind").agg(
        F.count_if("win").alias("wins"), ratio(F.count_if(F.col("win")), F.count("*")).alias("win_fraction"))


def report(df: DataFrame, y: str, baseline: str, variants: dict[str, str]) -> DataFrame:
    """One row per variant: errors, R², gains, and the outcome label."""
    def r2(p):
        e = F.col(y) - F.col(p)
        return 1 - ratio(F.sum(e * e), F.count(y) * F.var_pop(y))
    rows = F.array(*[F.struct(
        F.lit(v).alias("variant"), F.count(y).alias("n"), rmse(F.col(y), F.col(baseline)).alias("baseline_rmse"),
        rmse(F.col(y), F.col(p)).alias("rmse"), r2(baseline).alias("baseline_r2"), r2(p).alias("r2"))
        for v, p in variants.items()])
    gains = df.agg(rows.alias("rows")).select(F.inline("rows"))
    gain = F.col("baseline_rmse") - F.col("rmse")
    return gains.select("*", gain.alias("improvement"), (100 * ratio(gain, F.col("baseline_rmse"))).alias("improvement_percent"),
                        (F.col("r2") - F.col("baseline_r2")).alias("delta_r2"), outcome(gain).alias("outcome"))


def full_report(df: DataFrame, y: str, baseline: str, variants: dict[str, str]) -> DataFrame:
    """``report`` with the number and share of folds and contexts won."""
    won = wins(stability(df, y, baseline, variants)).groupBy("variant").pivot("kind", ["fold", "context"]).agg(
        F.first("wins").alias("wins"), F.first("win_fraction").alias("win_fraction"))
    return report(df, y, baseline, variants).join(won, "variant")


def residual_profile(df: DataFrame, y: str, prediction: str) -> DataFrame:
    """Mean, sample sd, extremes, quantiles and observed-predicted correlation of the residuals.

    ``n`` counts the rows with a residual and ``undefined`` those without one; without any the statistics are null.
    """
    r = df.select(y, prediction, (F.col(y) - F.col(prediction)).alias("residual"))
    moments = r.agg(F.count("residual").alias("n"), F.count_if(F.col("residual").isNull()).alias("undefined"),
                    F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("sd"),
                    F.min("residual").alias("minimum"), F.max("residual").alias("maximum"),
                    safe_corr(F.col(y), F.col(prediction)).alias("correlation"))
    quantiles = exact_quantiles(r, [], "residual", PROFILE).select("n", "quantiles")
    return moments.join(quantiles, "n", "left").select(
        "*", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("median", "p05", "p95"))]).drop("quantiles")


def concentration(df: DataFrame, y: str, baseline: str, variants: dict[str, str], share: float = 0.01) -> DataFrame:
    """Net squared-error gain of each variant and the part that comes from the largest reference errors.

    The error at the cut is selected exactly; rows tied with it count in proportion to the places left.
    """
    n = df.count()
    k = max(1, math.ceil(share * n))
    error = (F.col(y) - F.col(baseline)) * (F.col(y) - F.col(baseline))
    names = {v: f"_g{i}" for i, v in enumerate(variants)}
    gains = df.select(error.alias("_e"), *[(error - (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))).alias(names[v])
                                           for v, p in variants.items()])
    cut_at = exact_quantiles(gains, [], "_e", ranks=[n - k]).first()["quantiles"][0]
    above, tied = F.col("_e") > F.lit(cut_at), F.col("_e") == F.lit(cut_at)
    rows = F.array(*[F.struct(
        F.lit(v).alias("variant"), F.sum(g).alias("net_gain"),
        (F.coalesce(F.sum(F.when(above, F.col(g))), F.lit(0.0)) + F.avg(F.when(tied, F.col(g))) * (F.lit(k) - F.count_if(above)))
        .alias("top_gain")) for v, g in names.items()])
    table = gains.agg(rows.alias("rows")).select(F.inline("rows"))
    return table.select("variant", "net_gain", F.when(F.abs("net_gain") > 1e-8, ratio(F.col("top_gain"), F.col("net_gain")))
                        .alias("top_share"))


def training_medians(df: DataFrame, columns: list[str], folds: list[int], fold: str = "fold") -> DataFrame:
    """Median of each column over the rows outside each fold: one row per fold. A column without values there has null."""
    found = selected(df, columns, [0.5], **fold_sets(folds, fold))
    rows = [(f, *[found[f, c][1][0] if (f, c) in found else None for c in columns]) for f in folds]
    return df.sparkSession.createDataFrame(rows, ", ".join([f"{fold} int", *[f"median_{c} double" for c in columns]]))


def subgroups(df: DataFrame, y: str, baseline: str, variants: dict[str, str], masks: dict[str, Column]) -> DataFrame:
    """Errors and gain of each variant inside and outside each mask."""
    labels = F.array(*[F.struct(F.lit(n).alias("group"), m.alias("level")) for n, m in masks.items()])
    rows = df.select(y, baseline, *variants.values(), F.inline(labels))
    cells = F.array(*[F.struct(F.lit(v).alias("variant"), F.count(F.lit(1)).alias("n"),
                               rmse(F.col(y), F.col(baseline)).alias("baseline_rmse"), rmse(F.col(y), F.col(p)).alias("rmse"))
                      for v, p in variants.items()])
    out = rows.groupBy("group", "level").agg(cells.alias("cells")).select("group", "level", F.inline("cells"))
    gain = F.col("baseline_rmse") - F.col("rmse")
    return out.withColumn("improvement", gain).withColumn("improvement_percent", ratio(100 * gain, F.col("baseline_rmse")))


def training_diagnostics(df: DataFrame, columns: list[str], folds: list[int], probs: list[float], fold: str = "fold") -> DataFrame:
    """Distribution of each feature over the training rows of each fold; without values there it has no row.

    Every row is read into the counts and moments of its own fold; a training set is put together from the other folds'.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    own = df.select(fold, F.inline(cells)).groupBy("feature", fold).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum")).collect()          # folds x columns rows
    quantiles = selected(df, columns, probs, **fold_sets(folds, fold))
    rows = []
    for (f, c), (n, values) in quantiles.items():
        parts = [r for r in own if r["feature"] == c and r[fold] != f and r["n"]]
        mean = sum(r["n"] * r["mean"] for r in parts) / n
        variance = sum(r["n"] * (r["variance"] + (r["mean"] - mean) ** 2) for r in parts) / n
        rows.append((c, f, mean, math.sqrt(variance), min(r["minimum"] for r in parts), max(r["maximum"] for r in parts), n, values))
    return df.sparkSession.createDataFrame(rows, "feature string, fold int, mean double, sd double, minimum double, maximum double, "
                                                 "n bigint, quantiles array<double>")


def training_correlations(moments: dict, names: list[str], controls: list[str], families: dict[str, list[str]]) -> list[tuple]:
    """Largest absolute correlation of each feature with the controls and within its family, per training set.

    Read from the fold moments; a constant column correlates with nothing.
    """
    from wordframe.operators.moments import centered
    from wordframe.plans.linear import training
    import numpy as np
    rows = []
    for f, m in sorted(training(moments).items()):
        _, _, s = centered(m)
        sd = np.sqrt(np.maximum(np.diag(s), 0))
        alive = sd > 1e-9 * np.sqrt(np.maximum(np.diag(m)[1:], 1e-300))
        scale = np.where(alive, sd, 1.0)
        r = np.where(np.outer(alive, alive), s / np.outer(scale, scale), 0.0)
        at = {n: i for i, n in enumerate(names)}
        for family, columns in families.items():
            for c in columns:
                with_controls = max((abs(r[at[c], at[k]]) for k in controls), default=0.0)
                within = max((abs(r[at[c], at[k]]) for k in columns if k != c), default=0.0)
                rows.append((f, family, c, float(with_controls), float(within)))
    return rows


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, as a plain aggregate: no group is sorted or collected."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    last = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return last.select(*keys, *[F.col("r")[c].alias(c) for c in [*order, *rest]])


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width counts from minimum to maximum, the maximum in the last bin, empty bins left out."""
    row = df.agg(F.min(value), F.max(value)).first()
    lo, hi = float(row[0]), float(row[1])
    place = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1))
    return df.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
