"""State tables: pooling pieces into region stacks, and relations between neighbouring regions."""
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from wordframe.functions import vectors
from wordframe.functions.text import reason_text
from wordframe.operators.ordered import lag_by_key
from wordframe.operators.ranges import BLOCK, range_means
from wordframe.operators.spans import window_of


CELLS = 256                 # numbers of a whole stack up to which each is a sum of its own


def pool(states: DataFrame, keys=("item", "zone"), layer: str = "layer", vec: str = "vec") -> DataFrame:
    """Mean vector of the owned pieces at every layer, as one stack per region ordered by layer.

    A region keeps the layers it has; ``layers`` counts them and ``excluded`` names what is incomplete. Stacks of up to
    ``CELLS`` numbers are sums of plain columns, one row per region and task. Of larger ones partial means are
    whole vectors, combined before the shuffle, so one row per region, layer and task moves whatever the width.
    """
    length = F.size(vec)
    found = states.groupBy(layer).agg(F.min(length).alias("least"), F.max(length).alias("most"), F.count_if(F.col(vec).isNull()).alias("none")).limit(CELLS + 1).collect()
    width = found[0]["most"] if found else 0
    if found and width and len(found) * width <= CELLS and all(
            r[layer] is not None and not r["none"] and r["least"] == r["most"] == width for r in found):
        return _pooled_cells(states, list(keys), layer, vec, sorted(r[layer] for r in found), width)
    means = states.groupBy(*keys, layer).agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("v"), F.count("*").alias("pieces"))
    return means.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(layer, vector_to_array("v").alias("v")))), lambda s: s["v"]).alias("h"),
        F.count("*").alias("layers"), F.sum("pieces").alias("pieces"))


def _pooled_cells(states: DataFrame, keys: list[str], layer: str, vec: str, layers: list, width: int) -> DataFrame:
    """``pool`` of vectors that are all ``width`` long, in the ``layers`` given; a missing number makes its mean NaN."""
    rows = states.select(*keys, F.col(layer).alias("_layer"), *[F.coalesce(F.col(vec)[d].cast("double"), F.lit(float("nan"))).alias(f"_x{d}") for d in range(width)])
    own = [F.col("_layer") == F.lit(v) for v in layers]
    sums = rows.groupBy(*keys).agg(
        *[F.count_if(at).alias(f"_n{i}") for i, at in enumerate(own)],
        *[F.sum(F.when(at, F.col(f"_x{d}"))).alias(f"_s{i}_{d}") for i, at in enumerate(own) for d in range(width)])
    counts = [F.col(f"_n{i}") for i in range(len(layers))]
    stack = F.array(*[F.when(n > 0, F.array(*[F.col(f"_s{i}_{d}") / n for d in range(width)])) for i, n in enumerate(counts)])
    held = [(n > 0).cast("bigint") for n in counts]
    return sums.select(*keys, F.filter(stack, lambda v: v.isNotNull()).alias("h"), sum(held[1:], held[0]).alias("layers"),
                       sum(counts[1:], counts[0]).alias("pieces"))


def excluded(stacks: DataFrame, layers: int, keys=("item", "zone")) -> DataFrame:
    """Regions whose stack cannot be used, with all reasons: a layer is missing, or a profile is undefined."""
    marked = stacks.withColumn("reasons", reason_text({
        "missing_layer": F.col("layers") < layers, "undefined_profile": vectors.undefined_stack(F.col("h"))}))
    return marked.filter("reasons <> ''").select(*keys, "layers", "reasons")


def trajectories(stacks: DataFrame) -> DataFrame:
    """Stack table with its two distance profiles and their summaries; undefined stacks have no profile."""
    h = F.col("h")
    usable = stacks.filter(~vectors.undefined_stack(h)).withColumn("cosine", vectors.cosine_profile(h)).withColumn(
        "relative_l2", vectors.relative_profile(h))
    return usable.select("*", *[c.alias(n) for m in ("cosine", "relative_l2")
                                for n, c in vectors.profile_summaries(F.col(m), m).items()])


def flatten_profiles(df: DataFrame, blocks: int) -> DataFrame:
    """One column per layer and measure, for sinks and design matrices."""
    return df.select("*", *[F.col(m)[i].alias(f"{m}_layer_{i + 1}") for m in ("cosine", "relative_l2")
                            for i in range(blocks)])


def context_ranges(pieces: DataFrame, limits=(0, 16, 64), window: int = 1024, stride: int = 256) -> DataFrame:
    """``item, zone, limit, start, stop``: piece ranges of each region with its last ``limit`` pieces of context.

    ``pieces`` has one row per piece: item, zone and ``idx``, its number in the item. Ranges end with the region's last
    piece and begin no earlier than the scoring window of its first one. ``limit`` -1 is the whole window.
    """
    first = pieces.groupBy("item", "zone").agg(F.min("idx").alias("first"), (F.max("idx") + 1).alias("stop"))
    sizes = pieces.groupBy("item").agg((F.max("idx") + 1).alias("n"))
    begin = window_of(F.col("first"), F.col("n"), window, stride)["begin"]
    starts = F.array(*[F.struct(F.lit(k).alias("limit"), (begin if k < 0 else F.greatest(begin, F.col("first") - k)).cast("bigint").alias("start"))
                       for k in (-1, *limits)])
    return first.join(sizes, "item").select("item", "zone", F.inline(starts), F.col("stop").cast("bigint").alias("stop"))


def window_origins(pieces: DataFrame, window: int = 1024, stride: int = 256) -> DataFrame:
    """``item, zone, origin``: the first region that lies whole in the scoring window of each region's first piece."""
    begins = context_ranges(pieces, (), window, stride).select("item", "zone", F.col("start").alias("_begin"))
    first = pieces.groupBy("item", "zone").agg(F.min("idx").alias("_first"))
    at_begin = (pieces.select("item", F.col("zone").alias("_z"), F.col("idx").alias("_begin"))
                .join(first.withColumnRenamed("zone", "_z"), ["item", "_z"]))
    return begins.join(at_begin, ["item", "_begin"]).select(
        "item", "zone", (F.col("_z") + (F.col("_first") < F.col("_begin")).cast("int")).alias("origin"))


def context_means(pieces: DataFrame, limits=(0, 16, 64), window: int = 1024, stride: int = 256, block: int = BLOCK) -> DataFrame:
    """The ranges of ``context_ranges`` with the mean ``vec`` of their pieces: what a region's state is in that much context."""
    return range_means(pieces, context_ranges(pieces, limits, window, stride), ["item"], "idx", "vec", block=block)


def context_contrast(pieces: DataFrame, limits=(0, 16, 64), window: int = 1024, stride: int = 256, block: int = BLOCK) -> DataFrame:
    """Distances of each region's state in its whole window to its states in shortened contexts.

    Columns ``context<limit>_cosine`` and ``context<limit>_relative``. Where the window holds no more than the limit
    both states are one and the distances are zero.
    """
    means = context_means(pieces, limits, window, stride, block).groupBy("item", "zone").agg(
        *[F.max(F.when(F.col("limit") == k, F.col("mean"))).alias(f"_m{i}") for i, k in enumerate((-1, *limits))])
    full = F.col("_m0")
    return means.select("item", "zone", *[f(full, F.col(f"_m{i}")).alias(f"context{k}_{n}") for i, k in enumerate(limits, 1)
                                          for n, f in (("cosine", vectors.cosine_distance), ("relative", vectors.relative_distance))])


def previous_relations(stacks: DataFrame, depths: list[int], origin: str | None = None) -> DataFrame:
    """Cosine distance to the previous region, two back, and the mean of up to three predecessors.

    ``depths`` are 0-based layers (early, middle, final). With ``origin`` (first position of the region's
    window) only predecessors inside the window count. Regions with fewer than two predecessors drop out.
    """
    picked = stacks.select("item", "zone", *([origin] if origin else []),
                           F.array(*[vectors.at(F.col("h"), F.lit(d)) for d in depths]).alias("v"))
    lagged = lag_by_key(picked, ["v"], lags=(1, 2, 3), prefix={1: "b1_", 2: "b2_", 3: "b3_"})
    if origin:
        lagged = lagged.withColumns({f"b{k}_v": F.when(F.col("zone") - k >= F.col(origin), F.col(f"b{k}_v")) for k in (1, 2, 3)})
    lagged = lagged.filter(F.col("b1_v").isNotNull() & F.col("b2_v").isNotNull())

    def combined(a, b, divisor):
        return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, r: (p + r) / divisor))
    one, two, three = F.col("b1_v"), F.col("b2_v"), F.col("b3_v")
    sums = combined(one, two, F.lit(1.0))
    recent = F.when(three.isNull(), combined(one, two, F.lit(2.0))).otherwise(combined(sums, three, F.lit(3.0)))
    distances = {n: F.zip_with("v", ref, vectors.cosine_distance)
                 for n, ref in (("previous", one), ("two_back", two), ("recent", recent))}
    related = lagged.select("item", "zone", *[d.alias(n) for n, d in distances.items()])
    last = len(depths) - 1
    return related.select(
        "item", "zone", *[F.col(n)[i].alias(f"{n}_{i}") for n in distances for i in range(len(depths))],
        *[(F.col(n)[last] - F.col(n)[0]).alias(f"{n}_change") for n in distances])
