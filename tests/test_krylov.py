import numpy as np
import pytest
from pyspark.sql import functions as F

from wordframe.operators import krylov


def table(spark, x, parts=7):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "i long, v array<double>").repartition(parts)


def direct(x, count):
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    load = vt[:count].T
    return load * np.sign(load[np.abs(load).argmax(0), np.arange(load.shape[1])]), s[:count] ** 2 / (len(x) - 1)


def decaying(n, d, power, seed=0):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    return (rng.normal(size=(n, d)) / np.arange(1, d + 1) ** power) @ q.T + 5.0


@pytest.mark.parametrize("n, d, count, power", [(600, 96, 16, 0.5), (900, 300, 16, 1.0), (200, 8, 4, 0.3), (50, 3, 5, 0.5)])
def test_components_equal_a_direct_decomposition(spark, n, d, count, power):
    x = decaying(n, d, power)
    sets = {"all": F.lit(True), "odd": F.col("i") % 2 == 1, "most": F.col("i") % 5 != 3}
    got = krylov.leading(table(spark, x), "v", sets, count)
    at = np.arange(n)
    for name, rows in (("all", at >= 0), ("odd", at % 2 == 1), ("most", at % 5 != 3)):
        size, mean, loadings, variances = got[name]
        load, var = direct(x[rows], min(count, d))
        assert size == rows.sum() and mean == pytest.approx(x[rows].mean(0))
        assert variances == pytest.approx(var, rel=1e-7)
        assert np.abs(loadings - load).max() < 1e-5
        assert loadings.T @ loadings == pytest.approx(np.eye(min(count, d)), abs=1e-9)


def test_no_square_matrix_reaches_the_driver(spark, monkeypatch):
    shapes = []
    original = krylov._sums
    monkeypatch.setattr(krylov, "_sums", lambda rows, width, n, term, shape: (shapes.append(shape), original(rows, width, n, term, shape))[1])
    krylov.leading(table(spark, decaying(300, 200, 1.0)), "v", {0: F.lit(True)}, 4)
    assert shapes[0] == (201,) and set(shapes[1:]) == {(200, 4 + krylov.EXTRA)}


def test_a_tree_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(krylov, "FAN", 3)
    monkeypatch.setattr(krylov, "_ROWS", 5)
    x = decaying(200, 12, 0.5)
    _, _, loadings, variances = krylov.leading(table(spark, x, 30), "v", {0: F.lit(True)}, 3)[0]
    assert variances == pytest.approx(direct(x, 3)[1], rel=1e-8)


def test_low_rank_small_sets_and_empty_tables(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 60))
    got = krylov.leading(table(spark, x), "v", {"all": F.lit(True), "one": F.col("i") == 4, "none": F.lit(None)}, 4)
    assert set(got) == {"all"}
    assert got["all"][3] == pytest.approx(direct(x, 4)[1], abs=1e-8 * got["all"][3][0])
    assert krylov.leading(table(spark, x).limit(0), "v", {"all": F.lit(True)}, 2) == {}
    bad = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "i long, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="unlike length"):
        krylov.leading(bad, "v", {"all": F.lit(True)}, 1)


def test_layers_of_any_width_give_the_same_components(spark, monkeypatch):
    from wordframe.plans import representation
    x = decaying(400, 10, 1.0)
    names = [f"h{j}" for j in range(10)]
    rows = [(*map(float, r), i % 5, [-1 if i % 5 == o else (i // 5) % 5 for o in range(5)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", fold int, inner array<int>")
    dense = representation.fold_components(df, [names], list(range(5)), 3)
    monkeypatch.setattr(representation, "DENSE", 4)
    wide = representation.fold_components(df, [names], list(range(5)), 3)
    assert set(dense) == set(wide)
    for s in dense:
        assert wide[s][0].variance == pytest.approx(dense[s][0].variance, rel=1e-8)
        assert np.abs(wide[s][0].loadings - dense[s][0].loadings).max() < 1e-5
