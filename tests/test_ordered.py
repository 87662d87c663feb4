"""Blocked ordered operators and exact ranks against brute force, with tiny blocks and hot keys."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordframe.operators import ordered, ranking


def skewed(spark, gaps=False):
    """One context holds a third of all rows."""
    rng = np.random.default_rng(3)
    rows = []
    for item, n in [(1, 120)] + [(i, 12) for i in range(2, 22)]:
        zones = np.arange(1, n + 1) if not gaps else np.sort(rng.choice(np.arange(1, 3 * n), n, replace=False))
        rows += [(item, int(z), float(rng.integers(0, 9)), f"w{z}") for z in zones]
    order = rng.permutation(len(rows))
    return [rows[i] for i in order], "item bigint, zone bigint, v double, word string"


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("block", [4, 65536])
def test_lag_is_the_region_at_the_shifted_key(spark, gaps, block):
    rows, schema = skewed(spark, gaps)
    out = ordered.lag_by_key(spark.createDataFrame(rows, schema), ["v", "word"], lags=(1, 2, 3), block=block,
                             prefix={1: "a_", 2: "b_", 3: "c_"}).collect()
    table = {(r[0], r[1]): r for r in rows}
    assert len(out) == len(rows)
    for r in out:
        for k, p in ((1, "a_"), (2, "b_"), (3, "c_")):
            expected = table.get((r.item, r.zone - k))
            assert r[f"{p}word"] == (expected[3] if expected else None)
            assert r[f"{p}v"] == (expected[2] if expected else None)


@pytest.mark.parametrize("block", [3, 65536])
def test_prefix_ordinal_and_gaps(spark, block):
    rows, schema = skewed(spark, True)
    df = spark.createDataFrame(rows, schema)
    prefix = {(r.item, r.zone): r.s for r in ordered.exclusive_prefix(df, {"s": "v"}, block=block).collect()}
    rank = {(r.item, r.zone): r.n for r in ordered.ordinal(df, ["item"], ["zone"], F.floor(F.col("zone") / block), "n").collect()}
    gaps = {(r.item, r.missing_from, r.missing_to) for r in ordered.position_gaps(df, block=block).collect()}
    expected_gaps = set()
    for item in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == item)
        for i, r in enumerate(own):
            assert prefix[item, r[1]] == pytest.approx(sum(x[2] for x in own[:i]))
            assert rank[item, r[1]] == i + 1
            if i and r[1] > own[i - 1][1] + 1:
                expected_gaps.add((item, own[i - 1][1] + 1, r[1] - 1))
    assert gaps == expected_gaps


def brute_folds(keys, k, seed):
    order = sorted(keys, key=lambda key: hashlib.md5(":".join(map(str, (seed, *key))).encode()).hexdigest())
    return {key: f for f, part in enumerate(np.array_split(np.arange(len(order)), k)) for key in (order[i] for i in part)}


@pytest.mark.parametrize("limit", [1, 200_000])
def test_folds_are_balanced_deterministic_and_independent_of_partitioning(spark, monkeypatch, limit):
    monkeypatch.setattr(ranking, "COLLECT_LIMIT", limit)      # a limit of one forces prefix refinement
    keys = [(i % 7, i) for i in range(1003)]
    df = spark.createDataFrame(keys, "item bigint, zone bigint")
    a = {(r.item, r.zone): r.fold for r in ranking.assign_folds(df, ["item", "zone"]).collect()}
    b = {(r.item, r.zone): r.fold for r in ranking.assign_folds(df.repartition(13), ["item", "zone"]).collect()}
    assert a == b == brute_folds(keys, 10, 2026)
    assert sorted(np.bincount(list(a.values()))) == [100] * 7 + [101] * 3
    c = {(r.item, r.zone): r.fold for r in ranking.assign_folds(df, ["item", "zone"], seed=7).collect()}
    assert a != c


def test_too_few_rows_for_the_folds(spark):
    with pytest.raises(ValueError):
        ranking.assign_folds(spark.createDataFrame([(1, 1)], "item bigint, zone bigint"), ["item", "zone"])


def test_inner_folds_split_every_training_set_once(spark):
    keys = [(1, i) for i in range(97)]
    outer = ranking.assign_folds(spark.createDataFrame(keys, "item bigint, zone bigint"), ["item", "zone"], folds=4)
    rows = ranking.assign_inner_folds(outer, ["item", "zone"], [0, 1, 2, 3]).collect()
    for o in range(4):
        train = [(r.item, r.zone) for r in rows if r.fold != o]
        expected = brute_folds(train, 5, 2026 + o)
        for r in rows:
            assert r.inner[o] == (-1 if r.fold == o else expected[r.item, r.zone])


@pytest.mark.parametrize("spread", [8, 0.0, -3])
def test_folds_hashed_once_are_the_same(spark, monkeypatch, spread):
    """With a spread of zero or less the windows miss boundaries, and these must be searched among all rows."""
    monkeypatch.setattr(ranking, "DIRECT_ROWS", 1)
    monkeypatch.setattr(ranking, "SPREAD", spread)
    keys = [(i % 7, i) for i in range(6003)]
    df = spark.createDataFrame(keys, "item bigint, zone bigint").repartition(5)
    outer = ranking.assign_folds(df, ["item", "zone"], folds=4, rows=len(keys))
    expected = brute_folds(keys, 4, 2026)
    assert {(r.item, r.zone): r.fold for r in outer.collect()} == expected
    sizes = {o: sum(f == o for f in expected.values()) for o in range(4)}
    got = ranking.assign_inner_folds(outer, ["item", "zone"], [0, 1, 2, 3], rows=sizes).collect()
    for o in range(4):
        inner = brute_folds([k for k in keys if expected[k] != o], 5, 2026 + o)
        assert all(r.inner[o] == inner.get((r.item, r.zone), -1) for r in got)


def test_large_tables_are_hashed_once(spark, monkeypatch):
    monkeypatch.setattr(ranking, "DIRECT_ROWS", 1)
    seen = spark.sparkContext.accumulator(0)
    n = 20_000
    source = spark.range(n).select(F.lit(1).alias("item"), F.udf(lambda i: seen.add(1) or i, "long")("id").alias("zone"))
    ranking.assign_folds(source, ["item", "zone"], rows=n).collect()
    assert seen.value == n


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    values = np.r_[np.zeros(400), rng.normal(size=801)]
    groups = rng.integers(0, 3, len(values))
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, values)], "g int, v double").repartition(7)
    probs = [0, 0.05, 0.25, 1 / 3, 0.5, 0.95, 1]
    whole = ranking.exact_quantiles(df, [], "v", probs, buckets=16).first()["quantiles"]
    np.testing.assert_allclose(whole, np.quantile(values, probs), atol=1e-12)
    for r in ranking.exact_quantiles(df, ["g"], "v", probs, buckets=16).collect():
        np.testing.assert_allclose(r["quantiles"], np.quantile(values[groups == r.g], probs), atol=1e-12)
    ranks = ranking.exact_quantiles(df, [], "v", ranks=[0, 7, 1200], buckets=16).first()["quantiles"]
    np.testing.assert_array_equal(ranks, np.sort(values)[[0, 7, 1200]])


def test_average_and_global_ranks(spark):
    rng = np.random.default_rng(2)
    x = np.r_[np.full(300, 2.0), rng.integers(0, 40, 600)].astype(float)
    y = rng.normal(size=900)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id bigint, x double, y double")
    rows = {r.id: r for r in ranking.average_ranks(df, ["x", "y"]).collect()}
    for i in range(900):
        assert rows[i].rank_x == (x < x[i]).sum() + ((x == x[i]).sum() + 1) / 2
        assert rows[i].rank_y == (y < y[i]).sum() + 1
    placed = {r.id: r.r for r in ranking.global_rank(df, "x", "id", "r").collect()}
    assert [placed[i] for i in np.lexsort((np.arange(900), x))] == list(range(1, 901))


def test_running_total_over_ranges(spark):
    draw = random.Random(5)
    rows = [(i, draw.randrange(100) if draw.random() < 0.9 else None) for i in range(3000)]
    got = ordered.running_total(spark.createDataFrame(rows, "i long, m long").repartition(9), ["i"], "m", "upto").collect()
    total, expected = 0, {}
    for i, m in rows:
        total += m or 0
        expected[i] = total
    assert {r["i"]: r["upto"] for r in got} == expected
    assert ordered.running_total(spark.createDataFrame([], "i long, m long"), ["i"], "m", "upto").count() == 0


def test_average_ranks_of_odd_values(spark):
    nan = float("nan")
    rows = [(1.0, None), (1.0, None), (-0.0, 2.0), (0.0, nan), (nan, 2.0), (None, None), (float("inf"), -1.0)] + [(7.0, 3.0)] * 500
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, x double, y double")
    got = {r["id"]: (r["rank_x"], r["rank_y"]) for r in ranking.average_ranks(df, ["x", "y"]).collect()}
    assert [got[i] for i in range(7)] == [(3.5, None), (3.5, None), (1.5, 2.5), (1.5, 504.0), (506.0, 2.5), (None, None), (505.0, 1.0)]
    assert all(got[i] == (254.5, 253.5) for i in range(7, 507))
    only = ranking.average_ranks(df.select("x", "y"), ["x", "y"])
    assert only.columns == ["x", "y", "rank_x", "rank_y"] and only.count() == len(rows)
    assert sorted(only.where("rank_y is not null").agg(F.sum("rank_y")).first()) == [504 * 505 / 2]


def test_ranks_take_no_join_per_column(spark):
    names = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame([tuple(float(i % k) for k in range(2, 8)) for i in range(50)], ", ".join(f"{c} double" for c in names))
    joins = [ranking.average_ranks(df.select(*some), some)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
             for some in (names[:1], names)]
    assert joins[0] == joins[1]
