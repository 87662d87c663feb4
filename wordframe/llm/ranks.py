"""Exact ranks over a whole table without one task that sees all rows."""
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordframe.cluster import cut

ROW_BITS = 33
KEYS = ["_row1", "_row2"]


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row in ``order``, gapless over the table.

    Rows are dealt by ranges of ``order`` and numbered inside each range; the written ranges are then counted and
    each range starts where the one before it ends. Only one count per range reaches the driver. ``order`` should end
    in a hash of the row, so that a value which many rows share can be dealt to many ranges. Rows equal in all of
    ``order`` get neighbouring positions in any sequence. An empty table stays empty.
    """
    tag = uuid.uuid4().hex[:8]
    part, row, first = f"part_{tag}", f"row_{tag}", f"first_{tag}"
    written = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn(part, F.spark_partition_id())
                  .withColumn(row, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))))
    starts, total = [], 0
    for p, n in sorted(tuple(r) for r in written.groupBy(part).count().collect()):
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, f"{part} int, {first} long")
    return (written.join(F.broadcast(offsets), part)
            .withColumn(name, F.col(first) + F.col(row)).drop(part, row, first))


def row_hash(df: DataFrame, without=()) -> F.Column:
    """64 bits over all columns of a row: spreads equal keys and makes orders repeatable."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in without])


def keyed(df: DataFrame) -> list[F.Column]:
    """``KEYS`` of a row: 128 bits over all columns and over which of them are missing. Equal rows have equal keys."""
    fields = [f for c in df.columns for f in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(F.lit(i), *fields).alias(k) for i, k in enumerate(KEYS)]


def with_rows(light: DataFrame, df: DataFrame) -> DataFrame:
    """``light``, a table of the ``keyed`` rows of ``df``, with the whole row of ``df`` as ``doc`` instead of the keys.

    Wide rows are shuffled once. Of rows alike in every column one is sent, before the shuffle already, and meets as many
    rows of ``light`` as there are copies.
    """
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), *keyed(df))
    one = wide.withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*KEYS))).where("_n = 1").drop("_n")
    return light.join(one, KEYS).drop(*KEYS)
