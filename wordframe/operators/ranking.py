"""Exact global ranks without a global sort: balanced folds, quantiles and average ranks.

All three locate a rank by counting. Counting is a map-side aggregate, so no job moves more than a
histogram plus the few rows that share a histogram bucket with a wanted rank.
"""
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from wordframe.cluster import cut
from wordframe.operators.selection import selected

PREFIX_DIGITS = 3            # 4096 buckets per refinement of a hash prefix
COLLECT_LIMIT = 200_000      # hashes brought to the driver once a prefix is this rare
DIRECT_ROWS = 1_000_000      # from here on a counted table is hashed once
SPREAD = 6                   # standard deviations around the expected place of a boundary


def order_hash(seed, *keys: Column) -> Column:
    """The deterministic shuffle order of a key: text of ``seed:key``, hashed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def fold_starts(n: int, k: int) -> list[int]:
    """First rank of folds 1..k-1 when the first ``n mod k`` folds hold one row more."""
    size, extra = divmod(n, k)
    return [f * size + min(f, extra) for f in range(1, k)]


@dataclass
class _Search:
    prefix: str
    rank: int
    width: int = 0


@dataclass
class Shuffle:
    """One shuffled order over a subset of the rows: its hash, which rows belong, how many folds."""
    name: str
    hash: Column
    folds: int
    member: Column = field(default_factory=lambda: F.lit(True))


def hash_cuts(df: DataFrame, shuffles: list[Shuffle], ranks: dict[str, list[int]] | None = None) -> dict[str, list[str]]:
    """Exact fold boundaries as hash values, by refining hash prefixes around the wanted ranks; ``ranks`` may name others.

    Each pass counts rows per (shuffle, longer prefix) among the prefixes still in question. The driver
    holds counts of at most 4096 buckets per open prefix and, at the end, a bounded set of hashes.
    """
    def entries(value, open_prefixes=None):
        """Rows (s, value of the hash) of all shuffles, restricted to the open prefixes before anything is exploded."""
        cells = []
        for s in shuffles:
            member = s.member
            if open_prefixes is not None:
                mine = sorted(p for n, p, _ in open_prefixes if n == s.name)
                if not mine:
                    continue
                member = member & F.substring(s.hash, 1, len(mine[0])).isin(mine)
            cells.append(F.when(member, F.struct(F.lit(s.name).alias("s"), value(s.hash).alias("p"))))
        return df.select(F.explode(F.filter(F.array(*cells), lambda e: e.isNotNull())).alias("e")).select("e.s", "e.p")

    def counts(digits, open_prefixes=None):
        table = entries(lambda h: F.substring(h, 1, digits), open_prefixes).groupBy("s", "p").count().toPandas()
        return {(s, p): int(c) for s, p, c in table.itertuples(index=False)}

    found = counts(PREFIX_DIGITS)
    totals = {s.name: 0 for s in shuffles}
    for (name, _), c in found.items():
        totals[name] += c
    for s in shuffles:
        if ranks is None and totals[s.name] < s.folds:
            raise ValueError(f"fewer rows than folds in {s.name}")
    searches = {(s.name, j): _Search("", r) for s in shuffles
                for j, r in enumerate(fold_starts(totals[s.name], s.folds) if ranks is None else ranks[s.name])}
    digits = PREFIX_DIGITS
    while True:
        by_name = {}
        for (name, prefix), c in found.items():
            by_name.setdefault(name, []).append((prefix, c))
        for name in by_name:
            by_name[name].sort()
        for (name, _), search in searches.items():
            for prefix, c in by_name[name]:
                if not prefix.startswith(search.prefix):
                    continue
                if search.rank < c:
                    search.prefix, search.width = prefix, c
                    break
                search.rank -= c
        open_prefixes = sorted({(name, s.prefix, s.width) for (name, _), s in searches.items()})
        if sum(w for *_, w in open_prefixes) <= COLLECT_LIMIT or digits >= 30:
            break
        digits += PREFIX_DIGITS
        found = counts(digits, open_prefixes)
    # A hash is 32 digits long: equal hashes are one key, so counting them first bounds what is collected.
    table = entries(lambda h: h, open_prefixes).groupBy("s", "p").count().toPandas()
    groups = {}
    for s, h, c in table.itertuples(index=False):
        groups.setdefault((s, h[:digits]), []).append((h, int(c)))
    cuts = {s.name: [] for s in shuffles}
    for (name, _), search in sorted(searches.items(), key=lambda kv: kv[0]):
        rank = search.rank
        for h, c in sorted(groups[name, search.prefix]):
            if rank < c:
                cuts[name].append(h)
                break
            rank -= c
    return cuts


def fold_column(hash_: Column, cuts: list[str]) -> Column:
    """Fold number of a row: how many boundaries its hash has reached. Pure row-wise expression."""
    total = F.lit(0)
    for c in cuts:
        total = total + (hash_ >= F.lit(c)).cast("int")
    return total


def boundary_edges(n: int, folds: int, starts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First 64 bits of the hashes between which each boundary of ``folds`` folds of ``n`` rows surely lies: ``SPREAD`` deviations of a uniform order.

    ``starts`` may name other ranks than those of balanced folds.
    """
    bits = lambda share: np.uint64(min(int(min(max(share, 0.0), 1.0) * 2 ** 53) << 11, 2 ** 64 - 1))       # noqa: E731
    shares = [r / n for r in starts or fold_starts(n, folds)]
    half = [SPREAD * math.sqrt(p * (1 - p) / n) + 1 / n for p in shares]
    return np.array([bits(p - w) for p, w in zip(shares, half)]), np.array([bits(p + w) for p, w in zip(shares, half)])


def _called(column: Column) -> Column:
    """An array of ``column`` alone, evaluated by a call: many hashes in one generated method are too long to be compiled."""
    return F.transform(F.array(F.lit(0)), lambda _: column)


def dealt(df: DataFrame, shuffles: list[Shuffle], sizes: dict[str, int]) -> tuple[DataFrame, Column]:
    """``df`` written with what its hashes decide, and the folds of a row in all shuffles, -1 where it does not belong.

    ``sizes`` counts the members of each. A hash is computed once for each row and shuffle. The number of rows tells
    about where a boundary lies, so all rows but those near one have their fold at once; the few others keep their hash, and
    the exact boundary is searched among them, less the rows known to lie below. A boundary that lies elsewhere after
    all is searched among all rows.
    """
    columns, most = df.columns, max(s.folds for s in shuffles)
    edges = [boundary_edges(sizes[s.name], s.folds) for s in shuffles]
    nibble = np.zeros(256, np.uint64)
    nibble[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16, dtype=np.uint64)

    def place(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).flatten()
            member = texts.is_valid().to_numpy(zero_copy_only=False).reshape(-1, len(edges))
            filled = pc.fill_null(texts, "0" * 32).cast(pa.binary()).cast(pa.binary(32)) if len(texts) else texts
            digits = nibble[np.frombuffer(filled.buffers()[1], np.uint8, 32 * len(texts), 32 * filled.offset).reshape(-1, 32)[:, :16]] if len(texts) else np.zeros((0, 16), np.uint64)
            value = np.zeros(len(texts), np.uint64)
            for k in range(16):
                value = (value << np.uint64(4)) | digits[:, k]
            value = value.reshape(-1, len(edges))
            low = np.column_stack([np.searchsorted(e[0], value[:, i], "right") for i, e in enumerate(edges)])
            high = np.column_stack([np.searchsorted(e[1], value[:, i], "right") for i, e in enumerate(edges)])
            undecided = (low != high) & member
            open_row = undecided.any(axis=1)
            kept = pc.if_else(pa.array(undecided[open_row].ravel()), texts.filter(pa.array(np.repeat(open_row, len(edges)))), pa.scalar(None, pa.string()))
            near = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(open_row * len(edges))], pa.int32()), kept, mask=pa.array(~open_row))
            folds = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(edges), pa.int32()), pa.array(np.where(member, low, -1).ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], folds, near], names=[*columns, "_f", "_w"])

    def tally(batches):
        counts = np.zeros((len(edges), most), np.int64)
        for batch in batches:
            folds = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(edges)).copy()
            held = batch.column(1).flatten().is_valid().to_numpy(zero_copy_only=False).reshape(-1, len(edges))
            some = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            folds[some] = np.where(held, -1, folds[some])
            for i in range(len(edges)):
                counts[i] += np.bincount(folds[folds[:, i] >= 0, i], minlength=most)
        i, j = np.indices(counts.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel(), pa.int64()) for x in (i, j, counts)], names=["i", "j", "n"])

    schema = T.StructType([*df.schema.fields]).add("_f", T.ArrayType(T.IntegerType())).add("_w", T.ArrayType(T.StringType()))
    hashes = F.flatten(F.array(*[_called(F.when(s.member, s.hash)) for s in shuffles]))
    written = cut(df.select(*columns, hashes.alias("_h")).mapInArrow(place, schema))
    known = np.zeros((len(edges), most), np.int64)
    for i, j, n in written.select("_f", "_w").mapInArrow(tally, "i long, j long, n long").groupBy("i", "j").sum("n").collect():
        known[i, j] = n
    near = cut(written.where("_w is not null").select(*[F.col("_w")[i].alias(f"_w{i}") for i in range(len(edges))]))
    open_ = near.agg(*[F.count(f"_w{i}") for i in range(len(edges))]).first()
    ranks, sure = {}, True
    for i, s in enumerate(shuffles):
        total = int(known[i].sum()) + open_[i]
        if total < s.folds:
            raise ValueError(f"fewer rows than folds in {s.name}")
        ranks[s.name] = [r - int(b) for r, b in zip(fold_starts(total, s.folds), np.cumsum(known[i]))]
        sure &= all(0 <= r < open_[i] for r in ranks[s.name])
    if sure:
        cuts = hash_cuts(near, [Shuffle(s.name, F.col(f"_w{i}"), s.folds, F.col(f"_w{i}").isNotNull()) for i, s in enumerate(shuffles)], ranks)
        sure = all(low <= np.uint64(int(c[:16], 16)) < high for s, pair in zip(shuffles, edges) for c, low, high in zip(cuts[s.name], *pair))
    if sure:
        late = F.array(*[F.when(F.col("_w")[i].isNull(), F.col("_f")[i]).otherwise(fold_column(F.col("_w")[i], cuts[s.name])) for i, s in enumerate(shuffles)])
        return written, F.when(F.col("_w").isNull(), F.col("_f")).otherwise(F.flatten(_called(late)))
    cuts = hash_cuts(written, shuffles)
    return written, F.flatten(F.array(*[_called(F.when(s.member, fold_column(s.hash, cuts[s.name])).otherwise(-1)) for s in shuffles]))


def assign_folds(df: DataFrame, keys: list[str], folds: int = 10, seed: int = 2026, out: str = "fold", rows: int | None = None) -> DataFrame:
    """Balanced deterministic folds; independent of row order and partitioning.

    With the number of ``rows`` a large table is read and hashed once, and the result written (``dealt``).
    """
    h = order_hash(seed, *[F.col(k) for k in keys])
    if rows is not None and rows >= DIRECT_ROWS:
        written, fold = dealt(df, [Shuffle("all", h, folds)], {"all": rows})
        return written.select(*df.columns, fold[0].alias(out))
    cuts = hash_cuts(df.select(*keys), [Shuffle("all", h, folds)])
    return df.withColumn(out, fold_column(h, cuts["all"]))


def assign_inner_folds(df: DataFrame, keys: list[str], outer: list[int], folds: int = 5, seed: int = 2026,
                       fold: str = "fold", out: str = "inner", rows: dict[int, int] | None = None) -> DataFrame:
    """For every outer fold, a fresh split of its training rows; ``out[o]`` is -1 on the rows it holds out.

    ``rows`` may count the rows of each outer fold, as for ``assign_folds``.
    """
    cols = [F.col(k) for k in keys]
    shuffles = [Shuffle(str(o), order_hash(seed + o, *cols), folds, F.col(fold) != o) for o in outer]
    if rows is not None and sum(rows.values()) >= DIRECT_ROWS:
        written, split = dealt(df, shuffles, {str(o): sum(rows.values()) - rows.get(o, 0) for o in outer})
        return written.select(*df.columns, split.alias(out))
    cuts = hash_cuts(df.select(*keys, fold), shuffles)
    # Hashes are columns of their own: inside the conditional each comparison would hash again.
    hashed = df.withColumns({f"_h{o}": s.hash for o, s in zip(outer, shuffles)})
    parts = [F.when(F.col(fold) == o, F.lit(-1)).otherwise(fold_column(F.col(f"_h{o}"), cuts[str(o)])) for o in outer]
    return hashed.select(*df.columns, F.array(*parts).alias(out))


def splits_for(df: DataFrame, value: str, buckets: int = 256) -> list[float]:
    """Bucket edges for counting: approximate quantiles, so edges fall where the rows are. NaN has no rank and is an error."""
    probs = [i / buckets for i in range(1, buckets)]
    row = df.filter(F.col(value).isNotNull()).agg(
        F.percentile_approx(value, probs, 20 * buckets).alias("q"), F.count_if(F.isnan(value)).alias("nan")).first()
    if row["nan"]:
        raise ValueError(f"{row['nan']} values of {value} are NaN: filter them or make them null before ranking")
    edges = sorted(set(row["q"] or []))
    return [float("-inf"), *edges, float("inf")]


def bucketed(df: DataFrame, value: str, splits: list[float], out: str = "_bucket") -> DataFrame:
    rows = df.filter(F.col(value).isNotNull())
    if len(splits) < 3:
        return rows.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=value, outputCol=out).transform(rows)


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float] | None = None,
                    buckets: int = 256, ranks: list[int] | None = None) -> DataFrame:
    """Linearly interpolated quantiles: ``groups``, ``n``, ``quantiles`` (one per entry of ``probs``).

    With ``ranks`` (0-based) the values at those ranks instead. Without ``groups`` the values are found digit by digit
    (``selection.selected``). Groups can be many, so their wanted ranks stay a table: each is located in a histogram and
    only the value counts of its bucket are ordered.
    """
    if not groups:
        found = [(n, v) for n, v in selected(df, [value], probs, ranks).values()]
        return df.sparkSession.createDataFrame(found, "n bigint, quantiles array<double>")
    rows = bucketed(df.select(*groups, F.col(value).cast("double").alias("_v")), "_v", splits_for(
        df.select(F.col(value).cast("double").alias("_v")), "_v", buckets))
    by_bucket = rows.groupBy(*groups, "_bucket").agg(F.count("*").alias("_c"))
    within = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    histogram = by_bucket.select("*", F.coalesce(F.sum("_c").over(within), F.lit(0)).alias("_before"),
                                 F.sum("_c").over(Window.partitionBy(*groups)).alias("n"))
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in probs] if probs is not None else [
        F.lit(float(r)) for r in ranks]
    at = (histogram.select("*", F.posexplode(F.array(*places)).alias("_i", "_at"))
          .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
          .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
          .select(*groups, "_bucket", "n", "_i", "_at", "_rank", (F.col("_rank") - F.col("_before")).alias("_local")))
    # A wanted bucket may still hold one very frequent value: count values before ordering them.
    wanted = at.select(*groups, "_bucket").distinct()
    counts = (rows.join(wanted, [*groups, "_bucket"], "left_semi")
              .groupBy(*groups, "_bucket", "_v").agg(F.count("*").alias("_m")))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_v")
    placed = counts.select(*groups, "_bucket", "_v", "_m", F.sum("_m").over(inside).alias("_upto"))
    hits = placed.join(at, [*groups, "_bucket"]).filter(
        (F.col("_local") < F.col("_upto")) & (F.col("_local") >= F.col("_upto") - F.col("_m")))
    ends = hits.groupBy(*groups, "n", "_i").agg(
        F.min_by("_v", "_rank").alias("_lo"), F.max_by("_v", "_rank").alias("_hi"),
        (F.max("_at") - F.floor(F.max("_at"))).alias("_t"))
    value_at = ends.select(*groups, "n", "_i", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_t")).alias("q"))
    return value_at.groupBy(*groups, "n").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "q"))), lambda s: s["q"]).alias("quantiles"))


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``rank_<column>``: 1-based ranks with ties averaged; null has none, NaN comes last. Columns must be double.

    All columns become one long table, so they share every exchange however many there are. A rank belongs to a distinct
    value: value counts are dealt by ranges of (column, value), summed along each range, and the ranges are stitched by
    their totals. A value that fills a large share of the rows is one row of that table.
    """
    from wordframe.operators.ordered import running_total
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    cells = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(j).alias("_c"), F.col(c).alias("_v"))) for j, c in enumerate(columns)])
    long = rows.select("_row", F.inline_outer(F.filter(cells, lambda z: z.isNotNull())))
    counts = long.where("_c is not null").groupBy("_c", "_v").agg(F.count("*").alias("_m"))
    upto = running_total(counts, ["_c", "_v"], "_m", "_upto")
    before = upto.groupBy("_c").agg((F.min("_upto") - F.min_by("_m", "_upto")).alias("_before"))         # one row per column
    ranks = upto.join(F.broadcast(before), "_c").select(
        "_c", "_v", (F.col("_upto") - F.col("_before") - F.col("_m") + (F.col("_m") + 1) / 2.0).alias("_rank"))
    wide = long.join(ranks, ["_c", "_v"], "left").groupBy("_row").agg(
        *[F.max(F.when(F.col("_c") == j, F.col("_rank"))).alias(f"rank_{c}") for j, c in enumerate(columns)],
        *([F.max(F.when(F.col("_c") == j, F.col("_v"))).alias(c) for j, c in enumerate(columns)] if set(df.columns) == set(columns) else []))
    if set(df.columns) == set(columns):             # the long table holds all of the row
        return wide.select(*df.columns, *[f"rank_{c}" for c in columns])
    return rows.join(wide, "_row").drop("_row")


def global_rank(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """1-based rank over the whole table by (value, tie), from ranges of that order; a repeated value is split by the tie."""
    from wordframe.operators.ordered import ranked
    return ranked(df, [value, tie], out).withColumn(out, F.col(out) + 1)
