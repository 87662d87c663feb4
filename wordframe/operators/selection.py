"""Order statistics by radix: the digits of a wanted value are found one after the other, by counting.

A double becomes a long of the same order. Rows are counted by the leading digits of that number; every wanted rank
picks the digits it falls under, and only rows under picked digits are counted again by their next digits. No row is
sorted or copied. A count is additive, so what a training set holds is the total less the cells it leaves out: one
pass serves all sets.
"""
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

EXPONENT_BITS = 52          # digits below the sign and the exponent
FIRST_DIGITS = 12           # sign and exponent
MOST_DIGITS = 13            # of one later pass: 8192 counters for each of the picked beginnings
COUNTERS = 1 << 22          # that the driver holds in one pass, at most (digits get fewer before that)
VALUES = 100_000            # once so few rows are left under the picked digits, their values are counted as they are


def order_number(value: Column) -> Column:
    """A long that orders as the double does: exponent and fraction of its size, negative for negative values.

    -0.0 is 0.0. Null stays null; NaN has no place and must be kept out.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    power = F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(size >= power * 2.0, 1).when(size < power, -1).otherwise(0)      # log2 may be a place off
    fraction = (size / F.pow(F.lit(2.0), exponent) - 1.0) * F.lit(2.0 ** EXPONENT_BITS)
    step = F.lit(float(2 ** 537))
    number = (F.when(size == 0, F.lit(0).cast("long"))
              .when(size == F.lit(float("inf")), F.lit(2047 << EXPONENT_BITS))
              .when(size < F.lit(2.0 ** -1022), (size * step * step).cast("long"))
              .otherwise(F.shiftleft(exponent.cast("long") + 1023, EXPONENT_BITS) + fraction.cast("long")))
    return F.when(value < 0, -number).otherwise(number)


def ordered_value(number: int) -> float:
    """The double of an order number."""
    return float(np.copysign(np.int64(abs(int(number))).view(np.float64), -1.0 if number < 0 else 1.0))


def _places(n: int, probs, ranks) -> list[float]:
    return [p * (n - 1) for p in probs] if probs is not None else [float(r) for r in ranks]


def selected(df: DataFrame, columns: list[str], probs: list[float] | None = None, ranks: Iterable[int] | None = None,
             cells: dict | None = None, sets: dict | None = None) -> dict:
    """``{(set, column): (n, values)}``: linearly interpolated quantiles, or with ``ranks`` the values at 0-based ranks.

    ``cells`` maps names to conditions on a row, ``sets`` maps names to the cells that a set leaves out; a row is in a
    set if it is in none of them, so the left-out cells of one set must not share rows. Without sets there is one, None,
    of all rows. Nulls of a column are not counted, and a set without values is not in the result. NaN is an error that
    names the column. Ranks beyond the set are not in the result either: their value is None.

    What reaches the driver are counts: one row per picked beginning and next digit, whatever the number of rows.
    """
    cells, sets = dict(cells or {}), dict(sets or {None: []})
    names = list(cells)
    marked = F.struct(*[c.cast("boolean").alias(f"m{k}") for k, c in enumerate(cells.values())]) if cells else F.lit(0)
    each = F.array(*[F.struct(F.lit(j).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for j, c in enumerate(columns)])
    rows = df.select(marked.alias("m"), F.inline(each)).where(F.col("v").isNotNull()).select(
        "c", "m", F.isnan("v").alias("nan"), F.when(~F.isnan("v"), order_number(F.col("v"))).alias("key"))
    tallies = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"m.m{k}")).alias(f"n{k}") for k in range(len(cells))]]
    left_out = {s: [names.index(x) for x in out] for s, out in sets.items()}

    def counted(condition, shift: int) -> dict:
        """{column: (digits in order, counts by digit and by set)}"""
        table = (rows if condition is None else rows.where(condition)).groupBy("c", "nan", F.shiftright("key", shift).alias("d")) \
            .agg(*tallies).toPandas()
        if table["nan"].any():
            bad = table[table["nan"]]
            raise ValueError("; ".join(f"{n} values of {columns[c]} are NaN: filter them or make them null before ranking"
                                       for c, n in bad.groupby("c")["n"].sum().items()))
        out = {}
        for c, part in table.sort_values("d").groupby("c"):
            n = part["n"].to_numpy()
            out[int(c)] = (part["d"].to_numpy(), {s: n - sum((part[f"n{k}"].to_numpy() for k in ks), np.zeros_like(n))
                                                  for s, ks in left_out.items()}, n)
        return out

    shift = EXPONENT_BITS
    found = counted(None, shift)
    wanted, sizes = {}, {}
    for c, (digits, by_set, _) in found.items():
        for s, n in by_set.items():
            sizes[s, c] = int(n.sum())
            for place in _places(sizes[s, c], probs, ranks) if sizes[s, c] else []:
                for rank in {int(np.floor(place)), int(np.ceil(place))}:
                    if 0 <= rank < sizes[s, c]:
                        wanted[s, c, rank] = [rank, 0]                  # rank below the picked digits, the digits
    while True:
        under = {}
        for (s, c, _), state in wanted.items():
            digits, by_set, n = found[c]
            inside = by_set[s] if shift == EXPONENT_BITS else by_set[s] * (digits >> (before - shift) == state[1])
            upto = np.cumsum(inside)
            at = int(np.searchsorted(upto, state[0], side="right"))
            state[0] -= int(upto[at] - inside[at])
            state[1] = int(digits[at])
            under.setdefault(c, {})[state[1]] = int(n[at])
        if shift == 0:
            break
        beginnings = sum(len(d) for d in under.values())
        room = int(np.log2(max(16, COUNTERS // (max(1, beginnings) * (1 + len(cells))))))
        before = shift
        shift = max(0, shift - min(MOST_DIGITS, room)) if sum(sum(d.values()) for d in under.values()) > VALUES else 0
        if not under:
            break
        picked = None
        for c, digits in under.items():
            mine = (F.col("c") == c) & F.shiftright("key", before).isin(sorted(digits))
            picked = mine if picked is None else picked | mine
        found = counted(picked, shift)
    result = {}
    for (s, c), n in sizes.items():
        if not n:
            continue
        values = []
        for place in _places(n, probs, ranks):
            low, high = wanted.get((s, c, int(np.floor(place)))), wanted.get((s, c, int(np.ceil(place))))
            if low is None or high is None:
                values.append(None)
                continue
            a, b = ordered_value(low[1]), ordered_value(high[1])
            values.append(a if a == b else a + (b - a) * (place - np.floor(place)))
        result[s, columns[c]] = (n, [None if v is None else float(v) for v in values])
    return result


def fold_sets(folds: list[int], fold: str = "fold") -> dict:
    """Arguments ``cells`` and ``sets`` for the training rows of every outer fold."""
    return dict(cells={f: F.col(fold) == f for f in folds}, sets={f: [f] for f in folds})


def nested_sets(outer: list[int], inner_folds: int, fold: str = "fold", inner: str = "inner") -> dict:
    """The same for every inner training set (outer, i) and, as (outer, None), for the refit on all training rows."""
    held = {(o, "held"): F.col(fold) == o for o in outer}
    parts = {(o, i): (F.col(fold) != o) & (F.col(inner)[k] == i) for k, o in enumerate(outer) for i in range(inner_folds)}
    sets = {(o, i): [(o, "held"), *([(o, i)] if i is not None else [])] for o in outer for i in (*range(inner_folds), None)}
    return dict(cells={**held, **parts}, sets=sets)
