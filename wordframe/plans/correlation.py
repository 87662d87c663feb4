"""Correlations of profiles and summaries with residuals, with false-discovery control per family."""
from pyspark.sql import DataFrame, Window, functions as F

from wordframe.functions.numeric import safe_corr
from wordframe.functions.statistics import correlation_p
from wordframe.operators.ordered import BLOCK, ranked
from wordframe.operators.ranking import average_ranks


def adjust(df: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """Benjamini-Hochberg adjusted p within each family. A family has one row per test.

    Ranks come from one order over all families. The running minimum from the largest p down is taken inside blocks of
    ranks and completed with the minima of the later blocks, so a family of any size is many tasks.
    """
    placed = ranked(df, [*family, p, tie], "_at")
    sizes = placed.groupBy(*[F.col(f).alias(f"_{f}") for f in family]).agg(F.min("_at").alias("_low"), F.count("*").alias("_m"))
    same = [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in family]
    rank = F.col("_at") - F.col("_low") + 1
    rows = placed.join(sizes, same).withColumns({"_r": rank, "_v": F.col(p) * F.col("_m") / rank, "_b": F.floor((rank - 1) / BLOCK)})
    keys = [f"_{f}" for f in family]
    inside = Window.partitionBy(*keys, "_b").orderBy(F.desc("_r"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    minima = rows.groupBy(*keys, "_b").agg(F.min("_v").alias("_least")).select(
        *[F.col(k).alias(f"{k}2") for k in keys], F.col("_b").alias("_b2"), F.min("_least").over(later).alias("_later"))
    near = rows.withColumn("_here", F.min("_v").over(inside)).join(
        minima, [F.col(k).eqNullSafe(F.col(f"{k}2")) for k in keys] + [F.col("_b") == F.col("_b2")])
    return near.select(*df.columns, F.least(F.lit(1.0), "_here", "_later").alias("q_value"))


def pair_correlations(df: DataFrame, pairs: list[tuple[str, str]], method: str) -> list[tuple]:
    """(x, y, method, n, r, p, status) for all pairs in one aggregate; n counts rows with both values, constant columns have no correlation."""
    names = sorted({c for pair in pairs for c in pair})
    if method == "spearman":
        df = average_ranks(df.select(*[F.col(c).cast("double").alias(c) for c in names]), names)
    source = lambda c: F.col(f"rank_{c}") if method == "spearman" else F.col(c).cast("double")
    both = lambda a, b: F.count_if(source(a).isNotNull() & source(b).isNotNull())
    row = df.agg(*[both(a, b).alias(f"n_{i}") for i, (a, b) in enumerate(pairs)],
                 *[F.min(source(c)).alias(f"lo_{i}") for i, c in enumerate(names)],
                 *[F.max(source(c)).alias(f"hi_{i}") for i, c in enumerate(names)],
                 *[safe_corr(source(a), source(b)).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)]).first()
    constant = {c: row[f"lo_{i}"] == row[f"hi_{i}"] for i, c in enumerate(names)}
    out = []
    for i, (a, b) in enumerate(pairs):
        n = int(row[f"n_{i}"])
        if constant[a] or constant[b]:
            out.append((a, b, method, n, None, None, "undefined_constant"))
        else:
            r = float(row[f"r_{i}"])
            out.append((a, b, method, n, r, correlation_p(r, n), "ok"))
    return out


PAIR_SCHEMA = "x string, y string, method string, n bigint, correlation double, p_value double, status string"


def correlations(df: DataFrame, pairs: list[tuple[str, str]], methods=("pearson", "spearman")) -> DataFrame:
    rows = [r for m in methods for r in pair_correlations(df, pairs, m)]
    return df.sparkSession.createDataFrame(rows, PAIR_SCHEMA)


def layer_correlations(df: DataFrame, blocks: int, targets: dict[str, str], measures=("cosine", "relative_l2")) -> DataFrame:
    """Every layer of every measure against every target; false discovery controlled per measure, target and method."""
    layers = [(m, i, f"{m}_layer_{i}") for m in measures for i in range(1, blocks + 1)]
    rows = correlations(df, [(c, t) for _, _, c in layers for t in targets.values()])
    key = F.split("x", "_layer_")
    named = rows.select(key[0].alias("measure"), key[1].cast("int").alias("layer"), "y", "method", "n", "correlation", "p_value")
    adjusted = adjust(named, ["measure", "y", "method"], "p_value", "layer")
    back = F.create_map(*[F.lit(v) for name, column in targets.items() for v in (column, name)])
    return adjusted.select("measure", back[F.col("y")].alias("target"), "method", "layer", "n", "correlation", "p_value",
                           "q_value", (F.col("q_value") < 0.05).alias("fdr_05"))
