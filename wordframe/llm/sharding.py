"""Shards as runs of a Hilbert curve through quantised metadata, for pruning files on several dimensions at once."""
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordframe.llm.ranks import ranked, row_hash

BITS = 5            # cells per dimension: 2**BITS, the first of them for missing values
ACCURACY = 10_000   # of the quantile sketch; its size does not grow with the rows
PREFIX_BYTES = 6    # of a string after the prefix common to all values: exact in a double


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points ``cells`` (rows, dimensions), each coordinate below ``2**bits``.

    Skilling's transform from axes to the transposed index, on whole columns.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ flip) >> b) & 1)
    return index


def _scale(df: DataFrame, name: str, lows: dict) -> F.Column:
    """A double in the order of the column: numbers as they are, strings by the bytes after their common prefix."""
    column = F.col(f"`{name}`")
    if not isinstance(df.schema[name].dataType, T.StringType):
        return column.cast("double")
    after = F.substring(F.encode(column, "UTF-8"), lows[name] + 1, PREFIX_BYTES)
    return F.conv(F.rpad(F.hex(after), 2 * PREFIX_BYTES, "0"), 16, 10).cast("double")


def curve_position(df: DataFrame, dimensions: list[str], name: str, bits: int = BITS) -> DataFrame:
    """Add ``name``: the Hilbert index of the quantised ``dimensions``; missing values and NaN lie in cell 0.

    Cell borders are quantiles over all rows, so each dimension is spread evenly whatever its distribution.
    """
    texts = [d for d in dimensions if isinstance(df.schema[d].dataType, T.StringType)]
    lows = {}
    if texts:
        ends = df.agg(*[f(F.col(f"`{d}`")).alias(f"{k}{i}") for i, d in enumerate(texts)
                        for k, f in (("a", F.min), ("z", F.max))]).first()
        for i, d in enumerate(texts):
            lows[d] = len(os.path.commonprefix([(ends[f"a{i}"] or "").encode(), (ends[f"z{i}"] or "").encode()]))
    scales = [_scale(df, d, lows) for d in dimensions]
    scales = [F.when(~F.isnan(s), s) for s in scales]
    top = (1 << bits) - 1
    shares = [i / top for i in range(1, top)]
    cuts = df.agg(*[F.percentile_approx(s, shares, ACCURACY).alias(f"d{i}") for i, s in enumerate(scales)]).first()

    def cell(value, borders):
        below = F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(borders or []))]).cast("array<double>"), lambda b: b < value)
        return F.when(value.isNull(), F.lit(0)).otherwise(1 + F.size(below)).cast("int")

    cells = [cell(s, cuts[i]) for i, s in enumerate(scales)]

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([c.to_numpy() for c in columns]), bits))

    return df.withColumn(name, index(*cells))


def hilbert_shards(df: DataFrame, dimensions: list[str], shards: int) -> DataFrame:
    """Add ``curve`` (Hilbert index), ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 inside the shard).

    Rows are sorted by curve index, then by a hash of the row, and cut into ``shards`` runs whose counts differ by one
    at most. Input columns with one of these three names are replaced. Repeated rows each get a slot of their own; a
    cell with any share of the rows is dealt to many tasks, since the hash is part of the order. An empty table gives
    no rows; fewer rows than shards leave shards empty.
    """
    df = df.drop("curve", "shard", "slot")
    placed = ranked(curve_position(df, dimensions, "curve").withColumn("_tie", row_hash(df)),
                    ["curve", "_tie"], "_rank").drop("_tie")
    total = placed.count()
    small, larger = divmod(total, shards)           # the first `larger` shards hold small + 1 rows
    edge, rank = larger * (small + 1), F.col("_rank")
    inside = rank < edge
    late = F.floor((rank - edge) / F.lit(max(small, 1)))
    return (placed.withColumn("shard", F.when(inside, F.floor(rank / F.lit(small + 1)))
                              .otherwise(larger + late).cast("int"))
            .withColumn("slot", F.when(inside, rank % F.lit(small + 1))
                        .otherwise((rank - edge) % F.lit(max(small, 1))).cast("long"))
            .drop("_rank"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, its rows in curve order, so that readers skip files by the ranges of every dimension."""
    (placed.repartition("shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


DIMENSIONS = ["source", "lang", "size"]
SHARDS = 40


def measured(docs: DataFrame) -> DataFrame:
    """Add ``size``: the UTF-8 bytes of the text (null: none) plus 16."""
    return docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)


def op6_hilbert_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    light = measured(docs).select("doc_id", "source", "lang", "size",
                                  F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return (hilbert_shards(light, DIMENSIONS, SHARDS)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "curve", "source", "lang"))
