"""Exact-key attachment of features, always on region keys and never by position."""
from pyspark.sql import DataFrame, functions as F

from wordframe.functions import text

KEYS = ["item", "zone"]


def merge_exact(rows: DataFrame, features: DataFrame, columns: list[str], keys=KEYS, word: str = "word"):
    """Left-attach ``columns``; returns the merged rows and the violations.

    A row is merged if its key has one feature row with the same word. Other rows are violations, each once, with the
    word found and a reason: ``missing``, ``duplicate`` (the key has several feature rows) or ``other_word``.
    Callers that allow none pass the second table to ``contracts.assert_empty``.
    """
    side = features.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(word).alias("_word"), *[F.first(c).alias(c) for c in columns])
    joined = rows.drop(*columns).join(side, list(keys), "left")
    reason = (F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate")
              .when(~F.col("_word").eqNullSafe(F.col(word)), "other_word"))
    marked = joined.withColumn("reason", reason)
    return (marked.filter("reason IS NULL").drop("_n", "_word", "reason"),
            marked.filter("reason IS NOT NULL").select(*keys, word, F.col("_word").alias("found"), "reason"))


def lexical_by_code(regions: DataFrame, codes: DataFrame) -> DataFrame:
    """Attach the 'whole' and 'word' entries of a code-keyed resource; counts only where the text matches."""
    entry = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    wide = codes.groupBy(*KEYS).agg(
        entry("whole", "token").alias("_whole"), entry("word", "token").alias("_form"), entry("word", "count").alias("_count"))
    joined = regions.join(wide, KEYS, "left")
    matches = text.compact_match(F.col("_whole"), F.replace("word", F.lit(" "), F.lit("")))
    available = matches & F.col("_form").isNotNull() & (F.col("_form") != "")
    count = F.when(available, F.col("_count"))
    return joined.select(
        *regions.columns, F.length("word").alias("word_length"), F.coalesce("_form", F.lit("")).alias("frequency_form"),
        matches.alias("frequency_text_matches"), F.coalesce(F.col("_form").contains(" "), F.lit(False)).alias("frequency_is_multiword"),
        count.alias("frequency_count"), F.log1p(count).alias("log_frequency"))


def unambiguous_counts(entries: DataFrame, form: str = "form", count: str = "count") -> DataFrame:
    """form → count, only for single-word forms with one distinct count."""
    return (entries.filter(F.col(form).isNotNull() & (F.col(form) != "") & ~F.col(form).contains(" "))
            .groupBy(form).agg(F.min(count).alias("lo"), F.max(count).alias("hi")).filter("lo = hi")
            .select(form, F.col("lo").alias(count)))


def frequency_by_form(regions: DataFrame, lookup: DataFrame) -> DataFrame:
    """Frequency of the word without its outer punctuation; NULL where the form is unknown or ambiguous."""
    formed = regions.withColumn("frequency_form", text.strip_outer(F.col("word")))
    side = lookup.select(F.col("form").alias("frequency_form"), F.col("count").alias("frequency_count"))
    return formed.join(side, "frequency_form", "left").select(
        *regions.columns, F.length("word").alias("word_length"), "frequency_form", "frequency_count",
        F.log1p("frequency_count").alias("log_frequency"))


def side_by_side(regions: DataFrame, tables: dict[str, DataFrame], score: str = "surprisal") -> DataFrame:
    """Scores of several models in one row per region."""
    out = regions
    for name, t in tables.items():
        out = out.join(t.select(*KEYS, F.col(score).alias(f"{name}_{score}")), KEYS, "left")
    return out


def id_set_report(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two id → value tables: sizes, ids of one side only, and shared ids whose values differ."""
    x, y = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_ina")), b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_inb"))
    both = x.join(y, key, "full_outer")
    left, right = F.col("_ina").isNotNull(), F.col("_inb").isNotNull()
    return both.agg(F.count_if(left).alias("left_ids"), F.count_if(right).alias("right_ids"),
                    F.count_if(left & ~right).alias("absent_right"), F.count_if(~left & right).alias("absent_left"),
                    F.count_if(left & right & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("disagreements"))


def choose_outcome(df: DataFrame, outcomes: dict[str, str], name: str) -> DataFrame:
    return df.withColumn("observed_rt", F.col(outcomes[name]))


def frozen_sample(sample: DataFrame, full: DataFrame, columns: list[str]):
    """Rows of a saved sample with features of the full table, and the violations of the exact merge.

    Outcome and fold come from the sample.
    """
    return merge_exact(sample.select(*KEYS, "word", "fold", "observed_rt"), full, columns)
