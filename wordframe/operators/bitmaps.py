"""Exact distinct counts of whole-number ids by bitmaps.

``count(distinct)`` of several columns copies each row once per column and shuffles every distinct value. Here an id is
a bit of a bitmap of 32,768 ids: tasks hand on bitmaps, which merge by OR, so what is shuffled is four kilobytes per
touched range of ids and never more than the ids themselves are spread.
"""
from pyspark.sql import Column, DataFrame, functions as F


def distinct_counts(df: DataFrame, ids: dict[str, Column], tallies: dict[str, Column] | None = None) -> DataFrame:
    """One row with the number of distinct non-null values of each of ``ids``, which are whole numbers of any sign.

    ``tallies`` maps names to conditions on a row; how many rows meet each is counted in the same pass. Dense ids cost an
    eighth of a byte each; ids spread over the whole range of a long cost a bitmap each, so number such ids first.
    An empty table gives zeros.
    """
    tallies = tallies or {}
    cells = F.array(*[F.struct(F.lit(k).alias("c"), c.cast("bigint").alias("id")) for k, c in enumerate(ids.values())])
    rows = df.select(*[c.alias(f"t{k}") for k, c in enumerate(tallies.values())], F.inline(cells))
    maps = rows.groupBy("c", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("id"))).alias("n"),
        *[F.count_if((F.col("c") == 0) & F.col(f"t{k}")).alias(f"t{k}") for k in range(len(tallies))])
    return maps.agg(*[F.coalesce(F.sum(F.when(F.col("c") == k, F.col("n"))), F.lit(0)).alias(n) for k, n in enumerate(ids)],
                    *[F.coalesce(F.sum(f"t{k}"), F.lit(0)).alias(n) for k, n in enumerate(tallies)])
