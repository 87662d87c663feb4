import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordframe.operators import ranges, states


@pytest.fixture(scope="module")
def data():
    draw = random.Random(2)
    rows = [(item, i, [draw.gauss(0, 1) for _ in range(3)]) for item, n in ((1, 500), (2, 37), (3, 1)) for i in range(n)]
    asked = [(item, a, b) for item, n in ((1, 500), (2, 37), (3, 1)) for _ in range(120) for a, b in [sorted(draw.choices(range(n + 1), k=2))]]
    asked += [(1, 0, 500)] * 3 + [(1, 0, 8), (1, 7, 8), (1, 8, 16), (1, 7, 17)]
    return rows, asked


@pytest.mark.parametrize("block", [2, 8, 1024])
def test_sums_equal_plain_sums_over_every_number_of_levels(spark, data, block):
    rows, asked = data
    pieces = spark.createDataFrame(rows, "item long, i long, x array<double>").repartition(6)
    got = ranges.range_means(pieces, spark.createDataFrame(asked, "item long, start long, stop long"), ["item"], "i", "x", block=block).collect()
    assert len(got) == len(asked) and sorted((r["item"], r["start"], r["stop"]) for r in got) == sorted(asked)
    vectors = {item: np.array([x for k, _, x in rows if k == item]) for item in (1, 2, 3)}
    for r in got:
        if r["start"] == r["stop"]:
            assert r["mean"] is None
        else:
            assert r["mean"] == pytest.approx(vectors[r["item"]][r["start"]:r["stop"]].mean(0), abs=1e-12)


def test_no_loss_beside_large_sums(spark):
    rows = spark.range(5000).selectExpr("1 as item", "id as i", "array(if(id < 4000, 1e15, 1e-3)) as x")
    asked = spark.createDataFrame([(1, 4990, 4994), (1, 4100, 5000)], "item int, start long, stop long")
    got = {r["start"]: r["total"][0] for r in ranges.range_sums(rows, asked, ["item"], "i", "x", block=64).collect()}
    assert got == {4990: pytest.approx(4e-3, rel=1e-12), 4100: pytest.approx(0.9, rel=1e-12)}      # whole prefix sums would give 0


def test_gaps_missing_contexts_and_empty_tables(spark, data):
    pieces = spark.createDataFrame([(1, 0, [1.0]), (1, 2, [2.0])], "item long, i long, x array<double>")
    asked = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, 0, 4), (9, 0, 1), (1, 2, 2)], "item long, start long, stop long")
    got = {(r["item"], r["start"], r["stop"]): r["total"] for r in ranges.range_sums(pieces, asked, ["item"], "i", "x").collect()}
    assert got == {(1, 0, 1): [1.0], (1, 1, 3): None, (1, 0, 4): None, (9, 0, 1): None, (1, 2, 2): None}
    assert ranges.range_sums(pieces, asked.limit(0), ["item"], "i", "x").count() == 0
    assert ranges.range_sums(pieces.limit(0), asked, ["item"], "i", "x").where("total is not null").count() == 0
    bad = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0, 3.0])], "item long, i long, x array<double>")
    with pytest.raises(Exception, match="unlike length"):
        ranges.range_sums(bad, asked, ["item"], "i", "x").collect()


@pytest.mark.parametrize("window, stride", [(1024, 256), (16, 4), (7, 3)])
def test_contexts_equal_the_loop_over_windows(spark, window, stride):
    draw = random.Random(window)
    sizes = [draw.randrange(1, 4) for _ in range(30)]
    owner = [z for z, n in enumerate(sizes, 1) for _ in range(n)]
    vecs = [[draw.gauss(0, 1), draw.gauss(1, 1)] for _ in owner]
    pieces = spark.createDataFrame([(5, z, i, v) for i, (z, v) in enumerate(zip(owner, vecs))], "item long, zone long, idx long, vec array<double>")
    limits = (0, 2, 6)
    expected, n, done, end = {}, len(owner), 0, 0
    scored = {}                                                 # the window in which each piece is a target
    begin, end, target = 0, min(n, window), 0
    while True:
        scored.update({i: begin for i in range(target, end)})
        if end == n:
            break
        target, end = end, min(n, end + stride)
        begin = max(0, end - window)
    v = np.array(vecs)
    for z in set(owner):
        first, stop = owner.index(z), len(owner) - owner[::-1].index(z)
        for k in (-1, *limits):
            start = scored[first] if k < 0 else max(scored[first], first - k)
            expected[z, k] = v[start:stop].mean(0)
    got = {(r["zone"], r["limit"]): r["mean"] for r in states.context_means(pieces, limits, window, stride, block=4).collect()}
    assert set(got) == set(expected)
    for key, mean in expected.items():
        assert got[key] == pytest.approx(mean, abs=1e-12)
    for r in states.context_contrast(pieces, limits, window, stride).collect():
        a, b = expected[r["zone"], -1], expected[r["zone"], 2]
        assert r["context2_cosine"] == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-9)
        assert r["context2_relative"] == pytest.approx(np.linalg.norm(a - b) / np.linalg.norm(b), abs=1e-9)


@pytest.mark.parametrize("window, stride", [(1024, 256), (9, 4)])
def test_origins_are_the_first_whole_regions_of_the_window(spark, window, stride):
    draw = random.Random(3)
    sizes = [draw.randrange(1, 4) for _ in range(25)]
    owner = [z for z, n in enumerate(sizes, 1) for _ in range(n)]
    pieces = spark.createDataFrame([(1, z, i) for i, z in enumerate(owner)], "item long, zone long, idx long")
    begins = {r["zone"]: r["start"] for r in states.context_ranges(pieces, (), window, stride).collect()}
    got = {r["zone"]: r["origin"] for r in states.window_origins(pieces, window, stride).collect()}
    assert set(got) == set(owner)
    for zone, origin in got.items():
        assert origin == min(z for z in set(owner) if owner.index(z) >= begins[zone])
