"""Saved runs: held-out predictions go to text once, and later analyses start from what was saved."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from wordframe.functions.numeric import finite
from wordframe.functions.text import reason_text
from wordframe.sources import files

KEYS = ["item", "zone"]
SAVED = "item bigint, zone bigint, word string, fold int, observed_rt double, variant string, prediction double"


def save_run(predictions: DataFrame, y: str, variants: dict[str, str], path: str) -> None:
    """Write the sample with its folds, outcome and the predictions of all variants, one row per region and variant."""
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(c).alias("prediction")) for v, c in variants.items()])
    files.write_tsv(predictions.select(*KEYS, "word", "fold", F.col(y).alias("observed_rt"), F.inline(each)), path)


def saved_run(spark: SparkSession, path: str) -> DataFrame:
    return files.read_tsv(spark, path, SAVED)


def strongest(saved: DataFrame, candidates: list[str] | None = None) -> tuple[str, float]:
    """Variant with the lowest pooled error, the first by name of equal ones, and that error."""
    rows = saved if candidates is None else saved.where(F.col("variant").isin(candidates))
    errors = rows.groupBy("variant").agg(F.sqrt(F.avg((F.col("observed_rt") - F.col("prediction")) ** 2)).alias("rmse"))
    best = errors.agg(F.min(F.struct("rmse", "variant")).alias("b")).first()["b"]
    if best is None:
        raise ValueError("the saved run has none of the candidates")
    return best["variant"], best["rmse"]


def load_case(saved: DataFrame, sample: DataFrame, full: DataFrame, outcome: str | None = None, candidates: list[str] | None = None,
              tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame, str, float]:
    """Rows of a frozen sample, its violations, the strongest saved variant and that variant's error.

    ``sample`` has keys, word, fold and observed_rt; ``full`` has keys, word, observed_rt, features and perhaps ``outcome``, which then
    replaces the outcome. Fold and ``historical_prediction`` come from what was saved. Violations name every reason
    why a key cannot be used: it is repeated, missing on one side, has another fold, word or outcome, or no finite outcome.
    """
    best, error = strongest(saved, candidates)
    s = sample.groupBy(*KEYS).agg(F.count("*").alias("_n"), *[F.first(c).alias(f"_s_{c}") for c in ("word", "fold", "observed_rt")])
    p = saved.where(F.col("variant") == best).groupBy(*KEYS).agg(
        F.count("*").alias("_m"), F.first("fold").alias("_p_fold"), F.first("prediction").alias("historical_prediction"))
    merged = s.join(p, KEYS, "full_outer").join(full.withColumn("_full", F.lit(True)), KEYS, "left")
    target = F.col(outcome or "observed_rt")
    marked = merged.withColumn("reasons", reason_text({
        "repeated": (F.col("_n") > 1) | (F.col("_m") > 1),
        "not_in_sample": F.col("_n").isNull(), "not_saved": F.col("_m").isNull(), "not_in_full_table": F.col("_full").isNull(),
        "other_fold": F.col("_s_fold") != F.col("_p_fold"), "other_word": F.col("_s_word") != F.col("word"),
        "other_outcome": F.abs(F.col("_s_observed_rt") - F.col("observed_rt")) > tolerance,
        "no_outcome": F.col("_full") & ~F.coalesce(finite(target.cast("double")), F.lit(False))}))
    rest = [c for c in full.columns if c not in (*KEYS, "fold", "observed_rt", outcome)]
    rows = marked.where("reasons = ''").select(*KEYS, *rest, F.col("_s_fold").alias("fold"), target.alias("observed_rt"), "historical_prediction")
    return rows, marked.where("reasons <> ''").select(*KEYS, "reasons"), best, error
