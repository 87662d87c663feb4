"""Sums and means of vectors over ranges of positions, from running sums inside blocks.

A range is the difference of two rows of its first and last block plus the totals of the blocks between them, and a
run of whole blocks is again a range, one level up. The cost of a range does not grow with its length, no context is
one task, and running sums stay as short as a block, so nothing is lost by taking differences of huge totals.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from wordframe.cluster import cut

BLOCK = 1024                # positions: a task holds one block of vectors at a time


def running_sums(df: DataFrame, keys: list[str], position: str, vec: str, block: int = BLOCK) -> DataFrame:
    """``keys, position, vec, upto``: the sum of the vectors of the block up to and with the position."""
    def add(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by(position)
        column = table[vec].combine_chunks()
        values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
        width, rest = divmod(len(values), table.num_rows)
        lengths = np.diff(column.offsets.to_numpy())
        if rest or (lengths != width).any():
            raise ValueError(f"vectors of unlike length in {vec}")
        upto = values.reshape(table.num_rows, width).cumsum(axis=0).ravel()
        offsets = pa.array(np.arange(table.num_rows + 1, dtype=np.int32) * width)
        return pa.table([*[table[c] for c in (*keys, position)], pa.ListArray.from_arrays(offsets, pa.array(values)),
                         pa.ListArray.from_arrays(offsets, pa.array(upto))], names=[*keys, position, vec, "upto"])

    rows = df.select(*keys, F.col(position).cast("bigint").alias(position), F.col(vec).cast("array<double>").alias(vec))
    schema = T.StructType([*rows.schema.fields, T.StructField("upto", T.ArrayType(T.DoubleType()))])
    return rows.groupBy(*keys, F.floor(F.col(position) / block).alias("_block")).applyInArrow(add, schema)


def _plus(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def range_sums(df: DataFrame, ranges: DataFrame, keys: list[str], position: str, vec: str, start: str = "start", stop: str = "stop",
               block: int = BLOCK) -> DataFrame:
    """``ranges`` with ``total``: the sum of ``vec`` over the positions from ``start`` to before ``stop`` of the same keys.

    Positions are whole numbers from 0 on without gaps inside the ranges, and unique in their keys. ``total`` is null for
    an empty range and for one that begins or ends where there is no row.
    """
    sums = cut(running_sums(df, keys, position, vec, block))
    numbered = cut(ranges.withColumn("_range", F.monotonically_increasing_id()))
    first, last = F.floor(F.col(start) / block), F.floor((F.col(stop) - 1) / block)
    one = F.array(F.struct(F.col(start).alias("lo"), F.col(stop).alias("hi")))
    two = F.array(F.struct(F.col(start).alias("lo"), ((first + 1) * block).alias("hi")),
                  F.struct((last * block).alias("lo"), F.col(stop).alias("hi")))
    real = numbered.where(F.col(start) < F.col(stop))
    ends = real.select(*keys, "_range", F.explode(F.when(first == last, one).otherwise(two)).alias("e")).select(
        *keys, "_range", F.col("e.lo").cast("bigint").alias("_lo"), F.col("e.hi").cast("bigint").alias("_hi"))
    low = sums.select(*keys, F.col(position).alias("_lo"), F.col(vec).alias("_v"), F.col("upto").alias("_a"))
    high = sums.select(*keys, (F.col(position) + 1).alias("_hi"), F.col("upto").alias("_b"))
    parts = (ends.join(low, [*keys, "_lo"], "left").join(high, [*keys, "_hi"], "left")
             .select("_range", _plus(_plus(F.col("_b"), F.col("_a"), -1), F.col("_v")).alias("part")))
    between = real.where(last - first > 1).select(*keys, F.col("_range").alias("_outer"), (first + 1).alias("start"), last.alias("stop"))
    if between.head(1):
        blocks = sums.where((F.col(position) + 1) % block == 0).select(
            *keys, F.floor(F.col(position) / block).alias("position"), F.col("upto").alias("vec"))
        parts = parts.unionByName(range_sums(blocks, between, keys, "position", "vec", block=block).select(
            F.col("_outer").alias("_range"), F.col("total").alias("part")))
    held = F.transform("parts", lambda p: p["part"])            # three at most; a list of structs keeps the missing ones
    sums_of = parts.groupBy("_range").agg(F.collect_list(F.struct("part")).alias("parts")).select(
        "_range", F.aggregate(F.slice(held, 2, 2), held[0], lambda a, b: _plus(a, b)).alias("total"))
    return numbered.join(sums_of, "_range", "left").drop("_range")


def range_means(df: DataFrame, ranges: DataFrame, keys: list[str], position: str, vec: str, start: str = "start", stop: str = "stop",
                block: int = BLOCK) -> DataFrame:
    """``ranges`` with ``mean``: as ``range_sums``, divided by the length of the range."""
    summed = range_sums(df, ranges, keys, position, vec, start, stop, block)
    return summed.withColumn("mean", F.transform("total", lambda x: x / (F.col(stop) - F.col(start)))).drop("total")
