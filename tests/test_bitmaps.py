import random

from pyspark.sql import functions as F

from wordframe.operators.bitmaps import distinct_counts


def test_counts_equal_sets(spark):
    draw = random.Random(1)
    rows = [(draw.randrange(-70_000, 70_000), draw.choice([0, 1, 32767, 32768, 32769, -1, -32768, 2**62, -2**63, None]), None) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(7)
    got = distinct_counts(df, {n: F.col(n) for n in "abc"}).first()
    assert tuple(got) == (len({r[0] for r in rows}), len({r[1] for r in rows} - {None}), 0)
    assert tuple(distinct_counts(df.limit(0), {"a": F.col("a")}, {"t": F.lit(True)}).first()) == (0, 0)
    tallied = distinct_counts(df, {n: F.col(n) for n in "ca"}, {"rows": F.lit(True), "low": F.col("b") < 0, "none": F.col("c") > 0}).first()
    assert tuple(tallied) == (0, len({r[0] for r in rows}), len(rows), sum(r[1] is not None and r[1] < 0 for r in rows), 0)


def test_no_row_is_copied_by_an_expand(spark):
    from wordframe.catalog import QUERIES
    plan = QUERIES["a03_global_counters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
