import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordframe.operators import selection

ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"),
       float("-inf"), 0.1, 1 / 3, 2.0 ** 31, 2.0 ** 52, 2.0 ** 53 - 1, math.nextafter(8.0, 0), math.nextafter(8.0, 9), 1e-300, -1e300]


def test_numbers_keep_order_and_value(spark):
    draw = random.Random(0)
    values = ODD + [struct.unpack("d", struct.pack("q", draw.randrange(-2**63, 2**63)))[0] for _ in range(5000)] \
        + [math.nextafter(2.0 ** k, side) for k in range(-1060, 1023, 7) for side in (0, math.inf)] + [2.0 ** k for k in range(-1074, 1024)]
    values = [v for v in values if not math.isnan(v)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", selection.order_number(F.col("v")).alias("k")).collect()
    for r in rows:
        assert selection.ordered_value(r["k"]) == r["v"]
    rows.sort(key=lambda r: r["v"])
    assert all((a["k"] < b["k"]) == (a["v"] < b["v"]) for a, b in zip(rows, rows[1:]))
    assert spark.range(1).select(selection.order_number(F.lit(None).cast("double")).alias("k")).first()["k"] is None


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(4)
    rows = []
    for i in range(3000):
        fold = draw.randrange(5)
        inner = [-1 if fold == o else draw.randrange(3) for o in range(5)]
        rows.append((i, draw.gauss(0, 1), 7.0 if draw.random() < 0.4 else draw.choice([draw.random(), -draw.random() * 1e6]),
                     None if draw.random() < 0.2 else float(draw.randrange(4)), fold, inner))
    return spark.createDataFrame(rows, "i long, a double, b double, c double, fold int, inner array<int>").cache()


PROBS = [0, .05, .25, .5, .731, .95, 1]


@pytest.mark.parametrize("values, digits, counters", [(100_000, 13, 1 << 22), (0, 13, 1 << 22), (10, 5, 1 << 22), (0, 13, 64)])
def test_quantiles_equal_sorting(table, monkeypatch, values, digits, counters):
    monkeypatch.setattr(selection, "VALUES", values)
    monkeypatch.setattr(selection, "MOST_DIGITS", digits)
    monkeypatch.setattr(selection, "COUNTERS", counters)
    got = selection.selected(table, ["a", "b", "c"], PROBS)
    pandas = table.toPandas()
    for c in "abc":
        v = pandas[c].dropna().to_numpy()
        n, q = got[None, c]
        assert n == len(v) and q == pytest.approx(np.quantile(v, PROBS), rel=1e-14)


@pytest.mark.parametrize("values", [0, 100_000])
def test_training_sets_equal_copied_rows(table, monkeypatch, values):
    monkeypatch.setattr(selection, "VALUES", values)
    got = selection.selected(table, ["a", "b"], PROBS, **selection.nested_sets(list(range(5)), 3))
    outer = selection.selected(table, ["a", "b", "c"], PROBS, **selection.fold_sets(list(range(5))))
    pandas = table.toPandas()
    assert len(got) == 5 * 4 * 2
    for (o, i), c in got:
        rows = pandas[(pandas.fold != o) & ((pandas.inner.map(lambda x: x[o]) != i) if i is not None else True)]
        assert got[(o, i), c][0] == len(rows) and got[(o, i), c][1] == pytest.approx(np.quantile(rows[c], PROBS), rel=1e-14)
        if i is None:
            assert outer[o, c] == got[(o, i), c]


def test_ranks_and_values_that_fill_the_table(spark, monkeypatch):
    monkeypatch.setattr(selection, "VALUES", 0)
    df = spark.range(0, 100_000, 1, 4).select(F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).otherwise(F.lit(-2.5)).alias("v"))
    n, values = selection.selected(df, ["v"], ranks=[0, 66_665, 66_666, 66_667, 99_999, 100_000, -1])[None, "v"]
    assert n == 100_000 and values == [-2.5, -2.5, 0.0, 3.0, 99_999.0, None, None]


def test_infinite_missing_and_empty(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (None,)], "v double")
    assert selection.selected(df, ["v"], ranks=[0, 1, 2])[None, "v"] == (3, [float("-inf"), 1.0, float("inf")])
    assert selection.selected(df.limit(0), ["v"], [0.5]) == {}
    assert selection.selected(df.where("v is null"), ["v"], [0.5]) == {}
    with pytest.raises(ValueError, match="1 values of v are NaN"):
        selection.selected(df.unionByName(spark.createDataFrame([(float("nan"),)], "v double")), ["v"], [0.5])


def test_rows_are_neither_copied_nor_sorted(table):
    plan = []
    original = type(table).toPandas
    try:
        type(table).toPandas = lambda self: (plan.append(self._jdf.queryExecution().executedPlan().toString()), original(self))[1]
        selection.selected(table, ["a"], [0.5], **selection.fold_sets(list(range(5))))
    finally:
        type(table).toPandas = original
    assert plan and all("Sort" not in p and "Join" not in p and "Window" not in p and "Expand" not in p for p in plan)
