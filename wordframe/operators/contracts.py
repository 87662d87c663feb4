"""Data contracts as violation tables: each returns the offending rows, so a clean input returns none."""
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wordframe.functions.numeric import finite
from wordframe.functions.text import reason_text


def assert_empty(violations: DataFrame, what: str) -> None:
    """Stop a run on the first violation, showing a few of them."""
    first = violations.take(5)
    if first:
        raise ValueError(f"{what}: {first}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def broken_positions(df: DataFrame, item: str = "item", zone: str = "zone") -> DataFrame:
    """Contexts whose positions are not exactly 1..n. Distinct positions are counted in two map-side steps."""
    return (df.groupBy(item, zone).agg(F.count("*").alias("_c")).groupBy(item)
            .agg(F.min(zone).alias("first"), F.max(zone).alias("last"), F.count("*").alias("distinct_zones"),
                 F.sum("_c").alias("regions"))
            .filter("first <> 1 OR last <> distinct_zones OR regions <> distinct_zones"))


def region_report(df: DataFrame) -> DataFrame:
    """Row, key and context counts of a region table and the number of contexts with broken positions."""
    per_key = df.groupBy("item", "zone").agg(F.count("*").alias("c"))
    per_item = per_key.groupBy("item").agg(F.sum("c").alias("c"), F.count("*").alias("k"), F.min("zone").alias("lo"),
                                           F.max("zone").alias("hi"))
    return per_item.agg(F.sum("c").alias("regions"), F.sum("k").alias("keys"), F.count("*").alias("items"),
                        F.count_if(F.expr("lo <> 1 OR hi <> c")).alias("broken_items"))


def key_set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present on one side only. Missing parts of a key are equal, as in a set operation of SQL.

    With a whole number as last key, 64 neighbouring keys are the bits of one number, put together before the shuffle.
    """
    kind = a.schema[keys[-1]].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and b.schema[keys[-1]].dataType == kind:
        return _bit_difference(a, b, keys, kind)
    both = a.select(*keys, F.lit(1).alias("_side")).unionByName(b.select(*keys, F.lit(2).alias("_side")))
    sides = both.groupBy(*keys).agg(F.bit_or("_side").alias("_side")).filter("_side < 3")
    return sides.select(*keys, F.when(F.col("_side") == 1, "left").otherwise("right").alias("side"))


def _bit_difference(a: DataFrame, b: DataFrame, keys: list[str], kind) -> DataFrame:
    *front, last = keys
    place = F.col(last).cast("bigint")
    block, bit = F.shiftright(place, 6).alias("_block"), F.coalesce(place.bitwiseAND(F.lit(63)), F.lit(0)).cast("int")
    one, none = F.expr("1L"), F.lit(0).cast("bigint")
    mask = F.call_function("shiftleft", one, bit)

    def marked(df, left):
        return df.select(*front, block, (mask if left else none).alias("_l"), (none if left else mask).alias("_r"))

    held = marked(a, True).unionByName(marked(b, False)).groupBy(*front, "_block").agg(F.bit_or("_l").alias("_l"), F.bit_or("_r").alias("_r"))
    bits = F.sequence(F.lit(0), F.lit(63))
    set_in = lambda m: F.filter(bits, lambda k: F.call_function("shiftright", m, k).bitwiseAND(F.lit(1)) == 1)      # noqa: E731
    only = held.withColumns({"_l": F.col("_l").bitwiseAND(F.bitwise_not("_r")), "_r": F.col("_r").bitwiseAND(F.bitwise_not("_l"))}).filter("_l <> 0 OR _r <> 0")
    sides = F.array(*[F.struct(F.lit(n).alias("side"), set_in(F.col(m)).alias("at")) for n, m in (("left", "_l"), ("right", "_r"))])
    found = only.select(*front, "_block", F.inline(sides)).select(*front, "_block", "side", F.explode("at").alias("_k"))
    return found.select(*front, (F.shiftleft("_block", 6) + F.col("_k")).cast(kind).alias(last), "side")


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Matched keys whose listed columns differ."""
    right = b.select(*keys, *[F.col(c).alias(f"other_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"other_{c}"))
    return a.select(*keys, *columns).join(right, keys).filter(differs)


def score_boundary(df: DataFrame, score: str, zone: str = "zone") -> DataFrame:
    """A score is undefined exactly at the first region of a context and a finite non-negative number elsewhere."""
    value = F.col(score)
    fine = F.when(F.col(zone) == 1, F.coalesce(F.isnan(value), F.lit(False))).otherwise(finite(value) & (value >= 0))
    return df.filter(~fine)


def observation_violations(obs: DataFrame, regions: DataFrame) -> DataFrame:
    """(participant, item, zone) with every rule it breaks: duplicate, bad time, unknown region, other word."""
    known = regions.select("item", "zone", F.col("word").alias("_word"))
    keyed = obs.groupBy("participant", "item", "zone", "word").agg(
        F.count("*").alias("_n"), F.count_if(~(finite(F.col("rt")) & (F.col("rt") > 0))).alias("_bad"))
    checked = keyed.join(known, ["item", "zone"], "left").withColumn("_unknown", F.col("_word").isNull()).withColumn(
        "_other", F.col("_word").isNotNull() & (F.col("_word") != F.col("word")))
    per_key = checked.groupBy("participant", "item", "zone").agg(
        F.sum("_n").alias("n"), F.sum("_bad").alias("_bad"), F.max("_unknown").alias("_unknown"), F.max("_other").alias("_other"))
    reasons = reason_text({"duplicate": F.col("n") > 1, "invalid_time": F.col("_bad") > 0,
                           "unknown_region": F.col("_unknown"), "word_mismatch": F.col("_other")})
    return per_key.select("participant", "item", "zone", "n", reasons.alias("reasons")).filter("reasons <> ''")


def inconsistent_identity(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Ids that appear with more than one combination of ``columns``."""
    return (df.select(*key, *columns).distinct().groupBy(*key).agg(F.count("*").alias("identities"))
            .filter("identities > 1"))


def integral_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows whose count is missing, below one, or not whole."""
    c = F.col(column)
    return df.filter(~F.coalesce(finite(c) & (c >= 1) & (c == F.floor(c)), F.lit(False)))


def nonfinite(df: DataFrame, columns: list[str]) -> DataFrame:
    bad: Column = F.lit(False)
    for c in columns:
        bad = bad | ~finite(F.col(c))
    return df.filter(bad)


def split_by_reason(df: DataFrame, reasons: dict[str, Column]):
    """Eligible rows unchanged, excluded rows with all their reasons, and overlapping reason counts."""
    marked = df.withColumn("reasons", reason_text(reasons))
    excluded = marked.filter("reasons <> ''")
    counts = (excluded.select(F.explode(F.split("reasons", ";")).alias("reason")).groupBy("reason")
              .agg(F.count("*").alias("n")))
    return marked.filter("reasons = ''").drop("reasons"), excluded, counts


def complete_cases(df: DataFrame, required: list[str]):
    """Rows whose required columns are all finite numbers; text is read as a number where it is one."""
    return split_by_reason(df, {c: ~F.coalesce(finite(F.col(c).try_cast("double")), F.lit(False)) for c in required})


def row_set_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (with multiplicity) of one table that the other lacks; empty means identical row sets."""
    x, y = a.select(*columns), b.select(*columns)
    return (x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right"))))
