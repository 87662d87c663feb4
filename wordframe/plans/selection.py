"""Choosing feature families from inner validation errors: one DataFrame rule for all evaluations.

The input is the inner error table ``variant, fold, inner, loss``. It is written by tuning alone, so nothing here can
see a held-out row of an outer fold.
"""
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordframe.plans import nested

LEAST_WINS = 4      # of the inner folds
INNER_SCHEMA = "variant string, fold int, inner int, loss double"


def inner_errors(spark: SparkSession, tuned: dict[str, dict[int, dict]]) -> DataFrame:
    """The inner error table of tuned variants: variants x outer folds x inner folds rows."""
    return spark.createDataFrame([(v, int(o), i, float(x)) for v, by in tuned.items() for o, t in by.items()
                                  for i, x in enumerate(t["loss"])], INNER_SCHEMA)


def qualification(errors: DataFrame, reference: str, least_wins: int = LEAST_WINS) -> DataFrame:
    """Per outer fold and variant: pooled inner error, the reference's, inner wins, and whether it qualifies.

    A variant qualifies with a smaller pooled error than the reference and ``least_wins`` won inner folds. ``best``
    marks the qualified variant with the smallest error of its fold, the first by name on ties.
    """
    base = errors.filter(F.col("variant") == reference).select("fold", "inner", F.col("loss").alias("base"))
    sums = errors.filter(F.col("variant") != reference).join(base, ["fold", "inner"]).groupBy("fold", "variant").agg(
        F.sum("loss").alias("total"), F.sum("base").alias("reference_total"), F.count_if(F.col("loss") < F.col("base")).alias("wins"))
    table = sums.withColumn("accepted", (F.col("total") < F.col("reference_total")) & (F.col("wins") >= least_wins))
    leaders = table.filter("accepted").groupBy("fold").agg(F.min(F.struct("total", "variant")).alias("leader"))
    return table.join(leaders, "fold", "left").withColumn(
        "best", F.col("accepted") & F.coalesce(F.col("leader.variant") == F.col("variant"), F.lit(False))).drop("leader")


@dataclass
class Choice:
    """Families that qualified in one outer fold, in the order they were given, and the best of them."""
    accepted: list[str]
    best: str | None


def choices(errors: DataFrame, reference: str, families: list[str], folds: list[int]) -> dict[int, Choice]:
    """The qualification of each outer fold; at most folds x families rows reach the driver."""
    rows = qualification(errors.filter(F.col("variant").isin([reference, *families])), reference).filter("accepted").collect()
    found = {(r["fold"], r["variant"]): r["best"] for r in rows}
    return {o: Choice([f for f in families if (o, f) in found], next((f for f in families if found.get((o, f))), None)) for o in folds}


def superseded(accepted: list[str], parts: dict[str, list[str]]) -> list[str]:
    """Drop families that another accepted one contains: ``parts`` maps a family to those it contains."""
    inside = {p for whole, members in parts.items() if whole in accepted for p in members}
    return [f for f in accepted if f not in inside]


def composed(problem: nested.Problem, models: dict, tuned: dict, plan: dict[str, dict[int, tuple[list[str], str]]], alphas=nested.ALPHAS) -> None:
    """Add variants whose columns differ by outer fold.

    ``plan[variant][fold]`` holds the columns to tune and refit, or no columns and the variant whose model stands in.
    """
    for variant, by in plan.items():
        tuned.setdefault(variant, {})
        models.setdefault(variant, {})
        for o, (columns, stand_in) in by.items():
            if columns:
                tuned[variant][o] = nested.tune(problem, o, columns, alphas)
                models[variant][o] = nested.refit(problem, o, columns, tuned[variant][o]["alpha"])
            else:
                models[variant][o] = models[stand_in][o]


def added(base: list[str], chosen: list[str], families: dict[str, list[str]]) -> list[str]:
    """Columns of ``base`` with the chosen families; none if nothing was chosen."""
    return [*base, *[c for f in chosen for c in families[f]]] if chosen else []
