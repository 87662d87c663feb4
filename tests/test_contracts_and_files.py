"""Contracts on planted rows, sheet aggregation, exact joins, and write-once files."""
import gzip
import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wordframe.functions import text
from wordframe.operators import contracts, joins
from wordframe.sources import files

REGIONS = "item bigint, zone bigint, word string"


def test_keys_positions_and_scores(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 3, "d"), (3, 1, "e"), (3, 1, "e")], REGIONS)
    assert [(r.item, r.zone, r.n) for r in contracts.duplicate_keys(df, ["item", "zone"]).collect()] == [(3, 1, 2)]
    assert sorted(r.item for r in contracts.broken_positions(df).collect()) == [2, 3]
    nan = float("nan")
    scores = spark.createDataFrame([(1, nan), (1, 2.0), (2, 3.0), (2, nan), (2, -1.0), (2, None), (2, float("inf"))], "zone bigint, s double")
    bad = contracts.score_boundary(scores, "s").collect()
    assert len(bad) == 5 and sum(r.zone == 1 for r in bad) == 1
    with pytest.raises(ValueError):
        contracts.assert_empty(contracts.duplicate_keys(df, ["item", "zone"]), "regions")
    contracts.assert_empty(df.limit(0), "nothing")


def test_observation_rules_name_every_reason(spark):
    regions = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], REGIONS)
    obs = spark.createDataFrame([("p", 1, 1, "a", 300.0), ("p", 1, 1, "a", 310.0), ("p", 1, 2, "x", -1.0), ("q", 1, 1, "a", 200.0),
                                 ("q", 9, 9, "a", 200.0), ("r", 1, 2, "b", float("nan"))],
                                "participant string, item bigint, zone bigint, word string, rt double")
    out = {(r.participant, r.item, r.zone): r.reasons for r in contracts.observation_violations(obs, regions).collect()}
    assert out == {("p", 1, 1): "duplicate", ("p", 1, 2): "invalid_time;word_mismatch", ("q", 9, 9): "unknown_region", ("r", 1, 2): "invalid_time"}


def test_complete_cases_count_overlapping_reasons(spark):
    df = spark.createDataFrame([(1, "1", "2"), (2, "", "2"), (3, "nan", "x"), (4, "4", None)], "id int, a string, b string")
    good, bad, counts = contracts.complete_cases(df, ["a", "b"])
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.reasons for r in bad.collect()} == {2: "a", 3: "a;b", 4: "b"}
    assert {r.reason: r.n for r in counts.collect()} == {"a": 2, "b": 2}


def test_sheet_means_keep_skips_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{p}", f"w{w}", int(rng.integers(0, 2)), str(rng.choice([".", "", "0", "212.5", "340", "95"])), ".") for p in range(6) for w in range(8)]
    df = spark.createDataFrame(rows, "pp string, id string, skip int, gaze string, total string")
    gaze = text.valid_duration(F.col("gaze"))
    out = {r.id: (r.g, r.n) for r in df.groupBy("id").agg(F.avg(gaze).alias("g"), F.count(gaze).alias("n")).collect()}
    for w in range(8):
        values = [float(r[3]) for r in rows if r[1] == f"w{w}" and r[3] not in (".", "", "0")]
        assert out[f"w{w}"][1] == len(values) and (not values or out[f"w{w}"][0] == pytest.approx(sum(values) / len(values)))
    ids = df.withColumn("word", F.when((F.col("pp") == "p3") & F.col("id").isin("w1", "w5"), "other").otherwise("w"))
    assert sorted(r.id for r in contracts.inconsistent_identity(ids, ["id"], ["word"]).collect()) == ["w1", "w5"]


def test_exact_merge_reports_every_violation_once(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d"), (1, 5, None)], REGIONS)
    features = spark.createDataFrame([(1, 2, "B", 5.0), (1, 1, "a", 4.0), (1, 4, "d", 1.0), (1, 4, "d", 2.0), (1, 5, "e", 9.0)], REGIONS + ", f double")
    merged, bad = joins.merge_exact(rows, features, ["f"])
    assert [(r.zone, r.f) for r in merged.collect()] == [(1, 4.0)]
    assert sorted((r.zone, r.reason) for r in bad.collect()) == [(2, "other_word"), (3, "missing"), (4, "duplicate"), (5, "other_word")]
    with pytest.raises(ValueError):
        contracts.assert_empty(bad, "merge")


def test_ambiguous_and_phrase_forms_have_no_count(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c d", 3), ("", 4)], "form string, count bigint")
    assert [(r.form, r["count"]) for r in joins.unambiguous_counts(df).collect()] == [("a", 1)]


def test_text_files_keep_null_and_nan_apart_and_are_written_once(spark, tmp_path):
    path = str(tmp_path / "deep" / "table")
    df = spark.createDataFrame([(1, 'quo"te\tand tab', 1.5), (2, "plain", float("nan")), (3, "x", None)], "id int, w string, v double")
    files.write_tsv(df, path)
    back = {r.id: r for r in files.read_tsv(spark, path, "id int, w string, v double").collect()}
    assert back[1].w == 'quo"te\tand tab' and back[1].v == 1.5 and math.isnan(back[2].v) and back[3].v is None
    for write in (files.write_tsv, files.write_json):
        with pytest.raises(AnalysisException):
            write(df, path)
    assert files.read_tsv(spark, path, "id int, w string, v double").count() == 3


def test_manifest_and_fingerprint(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("two")
    before = spark.createDataFrame(files.manifest(spark, str(tmp_path)).collect(), "path string, length bigint, sha256 string")
    (tmp_path / "a.txt").write_text("ONE")
    (tmp_path / "sub" / "b.txt").unlink()
    (tmp_path / "c.txt").write_text("new")
    (tmp_path / "results").mkdir()
    (tmp_path / "results" / "d.txt").write_text("allowed")
    diff = files.manifest_diff(before, files.manifest(spark, str(tmp_path)), ("results/",))
    assert {r.path: r.status for r in diff.collect()} == {"a.txt": "changed", "sub/b.txt": "missing", "c.txt": "unexpected"}
    df = spark.range(100).select("id", (F.col("id") % 7).alias("x"))
    a, b = (files.fingerprint(d, ["id", "x"]).first() for d in (df, df.repartition(9).orderBy(F.desc("id"))))
    assert a == b and a != files.fingerprint(df.withColumn("x", F.lit(0)), ["id", "x"]).first()
    assert a != files.fingerprint(df.union(df.limit(1)), ["id", "x"]).first()


def test_fingerprints_keep_fields_apart(spark):
    a = spark.createDataFrame([("a\x1fb", "c"), (None, "x")], "p string, q string")
    b = spark.createDataFrame([("a", "b\x1fc"), ("", "x")], "p string, q string")
    marks = [tuple(files.fingerprint(d, ["p", "q"]).first()) for d in (a, b, a.limit(1), b.limit(1))]
    assert len(set(marks)) == 4
    assert tuple(files.fingerprint(a.limit(0), ["p", "q"]).first()) == (0, "0", "0", "0", "0")


def test_manifest_of_files_larger_than_a_value(spark, tmp_path, monkeypatch):
    """Files beyond the longest binary value are hashed in stretches, byte for byte."""
    noise = np.random.default_rng(1).integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    contents = {"noise.parquet": noise, "ends.bin": noise + b"\n", "mark.txt": b"\xef\xbb\xbf" + noise, "both x=1 %20é.txt": b"\xef\xbb\xbf" + noise + b"\n",
                "blank.txt": b"\n" * 70_000, "rows.tsv": b"a\tb\r\n" * 30_000, "flat.bin": b"\0" * 100_000, "packed.csv.gz": gzip.compress(noise[:30_000]), "small.bin": noise[:99]}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    want = {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}
    key = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "40000")
    monkeypatch.setattr(files, "WHOLE_BYTES", 20_000, raising=False)
    try:
        assert {r.path: (r.length, r.sha256) for r in files.manifest(spark, str(tmp_path)).collect()} == want
    finally:
        spark.conf.set(key, before)


def test_manifest_has_whole_odd_paths(spark, tmp_path):
    deep = tmp_path / "with blank & 100%"
    for _ in range(5):
        deep = deep / ("d" * 200)
    deep.mkdir(parents=True)
    (deep / "x=1 é.txt").write_text("deep")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        assert [r.path for r in files.manifest(spark, root).collect()] == [str((deep / "x=1 é.txt").relative_to(tmp_path))]


def test_provenance_of_files_and_folders(spark, tmp_path):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("s"))
    df.repartition(4).write.parquet(str(tmp_path / "many.parquet"))
    df.limit(7).coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("part-*")).rename(tmp_path / "one.parquet")
    rows = {r.table: r for r in files.provenance(spark, str(tmp_path), {"many": ["id", "s"], "one": ["id", "s"]}, {"k": "v"}).collect()}
    assert rows["many"].n == 50 and rows["one"].n == 7 and rows["one"].files == 1 and rows["many"].files >= 4 and rows["many"].bytes > 0


def test_cuts_are_released_and_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from wordframe import cluster
    monkeypatch.setattr(cluster, "_CUTS", {})
    monkeypatch.setattr(cluster, "_MEMO", {})
    kept = cluster.shared(spark, ("numbers",), lambda: spark.range(5).toDF("id"))
    path = cluster._CUTS[spark.sparkContext.applicationId][0]
    assert kept.count() == 5 and cluster.shared(spark, ("numbers",), lambda: None) is kept
    assert cluster.release(spark) == 1 and not cluster._MEMO
    import os
    assert not os.path.exists(path.removeprefix("file:"))

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "x",
                                      "getConf": staticmethod(lambda: type("G", (), {"get": staticmethod(lambda *a: None)}))})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cluster.checkpoint_root(Far())


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_key_sets_of_bits_and_of_keys(spark, kind):
    """Ends of blocks of 64, negative numbers, repeated keys; missing parts of a key are equal, as in EXCEPT."""
    left = [(1, 0), (1, 63), (1, 64), (1, -1), (1, -64), (2, 5), (2, 5), (None, 7), (3, None), (4, None), (2 ** 40, 127)]
    right = [(1, 0), (1, 64), (1, -64), (2, 6), (None, 7), (3, None), (5, None), (2 ** 40, 127), (2 ** 40, 128), (None, 8)]
    frames = [spark.createDataFrame(rows, "item bigint, zone bigint").select("item", F.col("zone").cast(kind)) for rows in (left, right)]
    out = contracts.key_set_difference(*frames, ["item", "zone"])
    assert dict(out.dtypes) == {"item": "bigint", "zone": kind, "side": "string"}
    text = lambda z: z if z is None or kind != "string" else str(z)     # noqa: E731
    expected = {(i, text(z), s) for rows, other, s in ((left, right, "left"), (right, left, "right")) for i, z in set(rows) - set(other)}
    found = [tuple(r) for r in out.select("item", "zone", "side").collect()]
    assert set(found) == expected and len(found) == len(expected)


def test_key_sets_meet_in_one_exchange(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("item"), F.col("id").alias("zone"))
    plan = contracts.key_set_difference(frame, frame.filter("zone <> 5"), ["item", "zone"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
