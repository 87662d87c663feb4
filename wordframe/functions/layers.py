"""Layer layout of stacked state features: names and the early / middle / late split."""
from pyspark.sql import DataFrame, functions as F

MEASURES = ("cosine", "relative_l2")
SUMMARIES = ("total", "mean", "maximum", "peak_layer", "early_mean", "middle_mean", "late_mean", "late_minus_early")
THIRDS = ("early", "middle", "late")


def thirds(n: int) -> dict[str, tuple[int, int]]:
    """1-based first and last block of each third; earlier thirds take the remainder."""
    size, extra = divmod(n, 3)
    bounds, first = {}, 1
    for i, name in enumerate(THIRDS):
        last = first + size + (i < extra) - 1
        bounds[name], first = (first, last), last + 1
    return bounds


def third_bounds(sizes: DataFrame) -> DataFrame:
    """The same split for a column ``n`` of stack sizes."""
    n = F.col("n")
    size, extra = F.floor(n / 3), n % 3
    start = lambda i: F.lit(i) * size + F.least(F.lit(i), extra)
    rows = F.array(*[F.struct(F.lit(name).alias("third"), (start(i) + 1).cast("int").alias("first"),
                              start(i + 1).cast("int").alias("last")) for i, name in enumerate(THIRDS)])
    return sizes.select("n", F.inline(rows))


def layer_names(n: int) -> list[str]:
    return [f"{m}_layer_{i}" for m in MEASURES for i in range(1, n + 1)]


def summary_names() -> list[str]:
    return [f"{s}_{m}" for m in MEASURES for s in SUMMARIES]


def third_names(measure: str) -> list[str]:
    return [f"{t}_mean_{measure}" for t in THIRDS]
