import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import LONG, empty_documents, frame, odd_documents
from wordframe.llm import mixing, ranks, sharding


@pytest.mark.parametrize("bits,dims", [(1, 2), (3, 2), (2, 3), (3, 3), (2, 4)])
def test_hilbert_index_is_a_path_through_all_cells(bits, dims):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_ranks_are_gapless_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("h"), "id")
    rows = sorted(ranks.ranked(df, ["k", "h"], "r").collect(), key=lambda r: r["r"])
    assert [r["r"] for r in rows] == list(range(1000))
    assert [(r["k"], r["h"]) for r in rows] == sorted((r["k"], r["h"]) for r in rows)


def test_shards_are_runs_of_the_curve(spark):
    docs = frame(spark, ["w " * (i % 40) for i in range(503)])
    placed = sharding.hilbert_shards(sharding.measured(docs), sharding.DIMENSIONS, 40).toPandas()
    sizes = placed.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() == 1
    for _, group in placed.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
        assert group.sort_values("slot").curve.is_monotonic_increasing
    ends = placed.groupby("shard").curve.agg(["min", "max"])
    assert (ends["min"].to_numpy()[1:] >= ends["max"].to_numpy()[:-1]).all()
    again = sharding.hilbert_shards(sharding.measured(docs.repartition(7)), sharding.DIMENSIONS, 40).toPandas()
    assert dict(zip(placed.doc_id, zip(placed.shard, placed.slot))) == dict(zip(again.doc_id, zip(again.shard, again.slot)))


def test_cells_agree_with_quantiles_by_hand(spark):
    docs = frame(spark, ["x" * n for n in range(200)])
    placed = sharding.curve_position(docs, ["n_chars"], "at", 3).toPandas().sort_values("n_chars")
    assert placed["at"].is_monotonic_increasing and placed["at"].min() == 1 and placed["at"].max() == 7
    assert placed.groupby("at").size().max() <= 200 / 7 + 2


def test_strings_keep_their_order_after_a_common_prefix(spark):
    rows = spark.createDataFrame([(f"https://very-long-common-prefix/{c}",) for c in "dbaec"], "s string")
    placed = sharding.curve_position(rows, ["s"], "at", 3).toPandas().sort_values("s")
    assert placed["at"].is_monotonic_increasing and placed["at"].nunique() == 5


def test_odd_and_empty_tables(spark):
    odd = sharding.hilbert_shards(sharding.measured(odd_documents(spark)), sharding.DIMENSIONS, 40).toPandas()
    assert len(odd) == 12 and set(odd["shard"]) == set(range(12)) and (odd["slot"] == 0).all()
    assert odd["size"].max() == len(LONG) + 16 and odd[odd.text.isna()]["size"].tolist() == [16]
    assert "key" in odd.columns
    assert sharding.hilbert_shards(sharding.measured(empty_documents(spark)), sharding.DIMENSIONS, 40).count() == 0


def test_shard_files(spark, tmp_path):
    placed = sharding.hilbert_shards(sharding.measured(frame(spark, ["a b"] * 90)), sharding.DIMENSIONS, 4)
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


def test_pfair_lag_stays_below_one_block():
    rng = random.Random(3)
    for _ in range(30):
        weights = {f"s{i}": rng.random() ** 3 + 1e-4 for i in range(rng.randint(1, 12))}
        slots = mixing.period_shares(weights, 400)
        assert sum(slots.values()) == 400 and min(slots.values()) >= 1
        table = mixing.pfair_period(slots)
        assert sorted(x for t in table.values() for x in t) == list(range(400))
        for s, places in table.items():
            for j, at in enumerate(places):
                assert j * 400 // slots[s] <= at < -(-(j + 1) * 400 // slots[s])
            done = np.searchsorted(places, np.arange(401))
            assert (np.abs(done - np.arange(401) * slots[s] / 400) < 1).all()


def test_mix_follows_the_targets_and_keeps_every_row(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "hot").when(
        F.col("id") < 3995, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).otherwise("tiny").alias("source"))
    rows = mixing.mix(docs).toPandas()
    assert len(rows) == 4000 and rows.doc_id.is_unique
    assert (rows.slot >= rows.release).all() and (rows.slot < rows.deadline).all()
    blocks = rows.groupby("slot").agg({"source": "nunique", "doc_id": "size"})
    assert blocks.source.max() == 1 and blocks.doc_id.max() <= mixing.BLOCK_DOCS
    inside = rows[rows.in_mix]
    counts = rows.groupby("source").size() ** 0.5
    target = counts / counts.sum()
    end = inside.slot.max() + 1
    for s in ("hot", "s0", "s1", "s2"):
        assert abs(inside[inside.source == s].slot.nunique() - target[s] * end) < 2 + 0.01 * end
    assert inside[inside.source == "tiny"].shape[0] == 5
    assert len(inside) > 2000


def test_given_weights(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    rows = mixing.mix(docs, weights={"a": 3, "b": 1}, block_docs=1, shortfall=0.0).toPandas()
    inside = rows[rows.in_mix]
    assert (inside.source == "a").sum() == 300 and abs((inside.source == "b").sum() - 100) <= 1
    with pytest.raises(ValueError):
        old, mixing.MAX_SOURCES = mixing.MAX_SOURCES, 1
        try:
            mixing.mix(docs)
        finally:
            mixing.MAX_SOURCES = old


def test_mix_of_odd_and_empty_tables(spark):
    odd = mixing.mix(odd_documents(spark)).toPandas()
    assert len(odd) == 12 and odd.source.isna().sum() == 4 and odd.in_mix.any()
    assert mixing.mix(empty_documents(spark)).count() == 0
