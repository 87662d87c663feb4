import random

import pytest
from pyspark.sql import functions as F

from wordframe.operators import spans
from wordframe.operators.ordered import running_total
from wordframe.plans import frozen, nested


@pytest.fixture(scope="module")
def case(spark):
    rows = [(1, z, f"w{z}", z % 3, 10.0 + z, 10.5 + z, 13.0 + z) for z in range(1, 13)]
    table = spark.createDataFrame(rows, "item long, zone long, word string, fold int, y double, near double, far double")
    full = table.select("item", "zone", "word", F.col("y").alias("observed_rt"), (F.col("y") * 2).alias("other"), F.lit(7).alias("n_bpe"))
    return table, table.select("item", "zone", "word", "fold", F.col("y").alias("observed_rt")), full


def test_best_saved_variant_and_second_outcome(spark, case, tmp_path):
    table, sample, full = case
    frozen.save_run(table, "y", {"far": "far", "near": "near"}, f"{tmp_path}/run")
    with pytest.raises(Exception, match="exist"):
        frozen.save_run(table, "y", {"near": "near"}, f"{tmp_path}/run")             # a saved run is not replaced
    saved = frozen.saved_run(spark, f"{tmp_path}/run")
    rows, bad, best, error = frozen.load_case(saved, sample, full, "other")
    assert (best, error) == ("near", 0.5) and bad.count() == 0
    got = {r["zone"]: r for r in rows.collect()}
    assert len(got) == 12 and got[4]["observed_rt"] == 28.0 and got[4]["historical_prediction"] == 14.5 and got[4]["fold"] == 1
    assert frozen.load_case(saved, sample, full, candidates=["far"])[2:] == ("far", 3.0)
    with pytest.raises(ValueError, match="none of the candidates"):
        frozen.load_case(saved, sample, full, candidates=["else"])


def test_every_fault_of_a_frozen_case_is_named(spark, case, tmp_path):
    table, sample, full = case
    frozen.save_run(table.where("zone <> 3"), "y", {"near": "near"}, f"{tmp_path}/run")
    saved = frozen.saved_run(spark, f"{tmp_path}/run")
    saved = saved.withColumn("fold", F.when(F.col("zone") == 4, 9).otherwise(F.col("fold"))).unionByName(saved.where("zone = 5"))
    sample = sample.where("zone <> 6").withColumn("word", F.when(F.col("zone") == 7, "odd").otherwise(F.col("word")))
    full = full.where("zone <> 8").withColumns({"observed_rt": F.when(F.col("zone") == 9, 0.0).otherwise(F.col("observed_rt")),
                                                "other": F.when(F.col("zone") == 10, float("nan")).otherwise(F.col("other"))})
    rows, bad, *_ = frozen.load_case(saved, sample, full, "other")
    assert {r["zone"]: r["reasons"] for r in bad.collect()} == {
        3: "not_saved", 4: "other_fold", 5: "repeated", 6: "not_in_sample", 7: "other_word", 8: "not_in_full_table", 9: "other_outcome", 10: "no_outcome"}
    assert sorted(r["zone"] for r in rows.collect()) == [1, 2, 11, 12]


def test_coverage_equals_counting_every_token(spark):
    draw = random.Random(6)
    sizes = {item: draw.randrange(0, 60) for item in range(25)}
    windows = [(item, a, a + draw.randrange(0, 25)) for item, n in sizes.items() for a in draw.choices(range(-5, n + 5), k=draw.randrange(0, 9))]
    windows += windows[:5]
    got = {r["item"]: tuple(r)[1:] for r in spans.window_coverage(
        spark.createDataFrame(windows, "item long, first long, stop long").repartition(4), spark.createDataFrame(list(sizes.items()), "item long, n long")).collect()}
    for item, n in sizes.items():
        visits = [sum(a <= i < b for k, a, b in windows if k == item) for i in range(n)]
        assert got[item] == (n, visits.count(1), sum(v > 1 for v in visits), visits.count(0))


def test_totals_of_falling_values_over_many_ranges(spark):
    draw = random.Random(8)
    rows = [(i, draw.choice([-3, -1, 1, 2, None])) for i in range(4000)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # as on a table that fills its partitions
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        df = spark.createDataFrame(rows, "at long, d long").repartition(3)
        got = {r["at"]: r["t"] for r in running_total(df, ["at"], "d", "t").collect()}
        windows = [(item, 4 * k, 4 * k + 6) for item in range(40) for k in range(12)]
        covered = spans.window_coverage(spark.createDataFrame(windows, "item long, first long, stop long"),
                                        spark.createDataFrame([(item, 50) for item in range(40)], "item long, n long")).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    total = 0
    for at, d in rows:
        total += d or 0
        assert got[at] == total
    assert {tuple(r)[1:] for r in covered} == {(50, 28, 22, 0)}


def test_planted_gaps_and_doubles_are_found(spark):
    from wordframe.catalog import QUERIES
    row = QUERIES["r04_window_coverage"](spark, "/root/testdata/sf0.001").agg(F.sum("tokens").alias("t"), F.sum("once").alias("o"), F.sum("repeated").alias("r"), F.sum("missing").alias("m")).first()
    assert row["r"] > 0 and row["m"] > 0 and row["t"] == row["o"] + row["r"] + row["m"]


def test_spline_columns_stay_last():
    assert nested.design_layout(["a", "b"], ["a", "b", "s", "t"], ["x", "a", "s"], True) == (["a", "b", "x", "s", "t"], 3)
    assert nested.design_layout(["a"], ["a", "s"], ["x"], False) == (["a", "s", "x"], 3)
