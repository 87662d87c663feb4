"""Ordered operators whose work is split by position block, never by whole context.

A window partitioned by context alone sends the largest context to one task. Here a context is cut into
blocks of consecutive positions; neighbouring values travel as a halo of a few duplicated rows, and
running totals are completed with the totals of earlier blocks.
"""
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from wordframe.cluster import cut

BLOCK = 65536
SLICE = 65536       # rows of a batch that leaves a task
ROW_BITS = 33       # of the number that Spark gives a row inside its partition


def ranked(df: DataFrame, order: list, out: str) -> DataFrame:
    """Add ``out``: the 0-based position of each row in ``order``, gapless over the table, without one task for all rows.

    Rows are dealt by ranges of ``order`` and numbered inside each range; the written ranges are then counted and each
    starts where the one before it ends. One count per range reaches the driver. ``order`` should end in a unique
    column or a hash of the row, so that a value which many rows share can be dealt to many ranges. Rows equal in all
    of ``order`` get neighbouring positions in any sequence. An empty table stays empty.
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
            .withColumn(out, F.col(first) + F.col(row)).drop(part, row, first))


def running_total(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of the whole-number column ``value`` over all rows up to and with this one in ``order``.

    ``order`` must be unique. Rows are dealt by its ranges and summed along each range as they stream by; one total per
    range reaches the driver and completes the later ones. Null counts as 0, values may be negative. An empty table stays empty.
    """
    tag = uuid.uuid4().hex[:8]
    part, first = f"part_{tag}", f"first_{tag}"
    names = df.columns

    def add(batches):
        total = 0
        for batch in batches:
            at = batch.schema.get_field_index(value)
            along = np.cumsum(batch.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) + total
            total = int(along[-1]) if len(along) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(along)], names=[*batch.schema.names, out])

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType(list(df.schema.fields)).add(out, T.LongType())
    written = cut(dealt.mapInArrow(add, schema).withColumn(part, F.spark_partition_id()))
    starts, total = [], 0
    for p, n in sorted(tuple(r) for r in written.groupBy(part).agg(F.sum(F.coalesce(value, F.lit(0)))).collect()):
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, f"{part} int, {first} long")
    return written.join(F.broadcast(offsets), part).withColumn(out, F.col(out) + F.col(first)).select(*names, out)


def exploded(df: DataFrame, keys: list[str], elements: list[str], before: dict[str, str] = {}, whole: dict[str, str] = {},
             position: str = "zone", rows: int = SLICE) -> DataFrame:
    """One row per position of parallel arrays: ``keys``, ``position`` (from 1), the ``elements`` and totals along the array.

    ``before`` maps a new column to the whole-number array whose sum over earlier positions it holds, ``whole`` to the one
    whose sum over all positions it holds. An input row carries its whole context, so nothing is shuffled or sorted.
    Arrays of a row have one length; a missing array has no positions. Results leave in slices of ``rows``.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(position, T.LongType()), *[T.StructField(e, fields[e].elementType) for e in elements],
                           *[T.StructField(o, T.LongType()) for o in (*before, *whole)]])

    def spread(batches):
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))      # noqa: E731
            sizes = pc.fill_null(pc.list_value_length(column(elements[0] if elements else next(iter({**before, **whole}.values())))), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes.astype(np.int64))
            row = np.repeat(np.arange(len(sizes)), sizes)
            out = [np.arange(len(row)) - (ends - sizes)[row] + 1]
            flat = {e: column(e).flatten() for e in elements}
            sums = {c: np.r_[0, np.cumsum(column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64))] for c in {*before.values(), *whole.values()}}
            out += [sums[c][:-1] - sums[c][ends - sizes][row] for c in before.values()]
            out += [(sums[c][ends] - sums[c][ends - sizes])[row] for c in whole.values()]
            for a in range(0, len(row), rows):
                at = slice(a, a + rows)
                yield pa.RecordBatch.from_arrays(
                    [*[column(k).take(pa.array(row[at])) for k in keys], pa.array(out[0][at]), *[flat[e].slice(a, rows) for e in elements],
                     *[pa.array(o[at]) for o in out[1:]]], names=schema.names)

    used = list(dict.fromkeys([*keys, *elements, *before.values(), *whole.values()]))
    return df.select(*used).mapInArrow(spread, schema)


def lag_by_key(df: DataFrame, columns: list[str], lags=(1,), keys=("item",), zone: str = "zone",
               block: int = BLOCK, prefix=None) -> DataFrame:
    """Values of the region at ``zone - k`` of the same context, NULL where that region does not exist.

    The input must be the full table: lag first, filter afterwards. Keys must be unique.
    """
    prefix = prefix or {1: "prev_"}
    reach = max(lags)
    own = F.floor((F.col(zone) - 1) / block)
    tail = (F.col(zone) - 1) % block >= block - reach
    halo = df.withColumn("_block", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    order = Window.partitionBy(*keys, "_block").orderBy(zone)
    shifted = []
    for k in lags:
        for c in columns:
            # With position gaps the region k positions back is at most k rows back.
            value = None
            for j in range(k, 0, -1):
                hit = F.lag(zone, j).over(order) == F.col(zone) - k
                value = F.when(hit, F.lag(c, j).over(order)) if value is None else value.when(
                    hit, F.lag(c, j).over(order))
            shifted.append(value.alias(f"{prefix.get(k, f'lag{k}_')}{c}"))
    return halo.select(*df.columns, "_block", *shifted).filter(F.col("_block") == own).drop("_block")


def exclusive_prefix(df: DataFrame, values: dict[str, str], keys=("item",), zone: str = "zone",
                     block: int = BLOCK) -> DataFrame:
    """For each ``out: column``, the sum of ``column`` over all earlier positions of the context."""
    own = df.withColumn("_block", F.floor((F.col(zone) - 1) / block))
    inside = Window.partitionBy(*keys, "_block").orderBy(zone).rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_block", *[
        F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}") for o in values])
    running = own.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_r_{o}")
                                for o, c in values.items()])
    joined = running.join(offsets, [*keys, "_block"])
    return joined.select(*df.columns, *[(F.col(f"_r_{o}") + F.col(f"_o_{o}")).alias(o) for o in values])


def ordinal(df: DataFrame, keys: list[str], order: list[str], block: Column, out: str) -> DataFrame:
    """Exact 1-based row number within ``keys`` by ``order``; ``block`` must not decrease along ``order``."""
    own = df.withColumn("_block", block)
    counts = own.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (own.withColumn("_rank", F.row_number().over(inside)).join(offsets, [*keys, "_block"])
            .select(*df.columns, (F.col("_rank") + F.col("_before")).cast("bigint").alias(out)))


def position_gaps(positions: DataFrame, keys=("item",), zone: str = "zone", block: int = BLOCK) -> DataFrame:
    """Missing positions inside each context, as inclusive ranges between neighbouring observed positions.

    Blocks see gaps between their own positions; gaps across blocks follow from the first and last position
    of each non-empty block.
    """
    own = positions.select(*keys, zone).withColumn("_block", F.floor((F.col(zone) - 1) / block))
    inside = Window.partitionBy(*keys, "_block").orderBy(zone)
    within = own.select(*keys, F.lag(zone).over(inside).alias("_a"), F.col(zone).alias("_b"))
    edges = own.groupBy(*keys, "_block").agg(F.min(zone).alias("_first"), F.max(zone).alias("_last"))
    across = edges.select(*keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_a"),
                          F.col("_first").alias("_b"))
    return within.unionByName(across).filter(F.col("_b") > F.col("_a") + 1).select(
        *keys, (F.col("_a") + 1).alias("missing_from"), (F.col("_b") - 1).alias("missing_to"))
