"""Observations to analysis rows: region means, lexical predictors, previous-region lags."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from wordframe.cluster import shared
from wordframe.functions.numeric import finite
from wordframe.operators import ngram
from wordframe.operators.ordered import lag_by_key
from wordframe.operators.ranking import assign_folds
from wordframe.operators.spans import piece_counts, piece_pattern
from wordframe.operators.states import flatten_profiles, pool, trajectories
from wordframe.sources import tables

KEYS = ["item", "zone"]


def region_means(observations: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Number of observations and mean of each outcome per region, aggregated map-side first."""
    return observations.groupBy(*KEYS).agg(
        F.count("*").alias("n_observations"), *[F.avg(c).alias(out) for out, c in columns.items()])


def with_frequency(regions: DataFrame) -> DataFrame:
    """Length and log count of the displayed word."""
    counts = regions.groupBy("word").agg(F.count("*").alias("frequency_count"))
    return regions.join(counts, "word").withColumn("word_length", F.length("word")).withColumn(
        "log_frequency", F.log1p("frequency_count"))


def analysis_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per region with its mean outcome, lexical predictors and their lags over the full table."""
    regions = with_frequency(tables.part_regions(spark, sf_dir))
    lagged = lag_by_key(regions, ["word_length", "log_frequency"])
    means = region_means(tables.raw_observations(spark, sf_dir), {"mean_rt": "rt"})
    return lagged.join(means, KEYS, "left")


def complete(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows whose required columns are all finite. One array predicate keeps wide filters cheap to plan."""
    return df.filter(F.forall(F.array(*[F.col(c).cast("double") for c in required]), finite))


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete cases with a positive outcome and their saved folds."""
    def build():
        rows = shared(spark, ("analysis", sf_dir), lambda: analysis_rows(spark, sf_dir))
        eligible = complete(rows, ["word_length", "prev_word_length", "log_frequency", "prev_log_frequency",
                                   "mean_rt"]).filter(F.col("mean_rt") > 0)
        return assign_folds(eligible, KEYS)
    return shared(spark, ("sample", sf_dir), build)


PIECE_LETTERS = 4     # piece length cap for the short stimulus words, so that words have several pieces


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores and piece counts of the stimulus list."""
    def build():
        scored = ngram.score(tables.part_regions(spark, sf_dir))
        return scored.withColumn("n_bpe", piece_counts(scored, piece_pattern(PIECE_LETTERS)).cast("bigint"))
    return shared(spark, ("scores", sf_dir), build)


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stack of seven pooled states per region that has all of them."""
    return shared(spark, ("stacks", sf_dir),
                  lambda: pool(tables.layer_states(spark, sf_dir)).filter("layers = 7"))


def trajectory_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, ("trajectories", sf_dir),
                  lambda: flatten_profiles(trajectories(stacks(spark, sf_dir)), 6))
