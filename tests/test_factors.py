import numpy as np
import pytest
from pyspark.sql import functions as F

from wordframe.operators import factors
from wordframe.operators.moments import by_fold, column_means
from wordframe.plans import linear, nested

RNG = np.random.default_rng(8)


def augmented(x, y):
    return np.column_stack([np.ones(len(x)), x, y])


def near_dependent(n, gap):
    """Two predictors that differ by ``gap``, and an outcome that depends on their difference."""
    a, d = RNG.normal(size=n), RNG.normal(size=n)
    x = np.column_stack([a, a + gap * d, RNG.normal(size=n)])
    return x, a + (x[:, 1] - x[:, 0]) / gap + 0.5 * x[:, 2] + 0.1 * RNG.normal(size=n)


def test_factor_keeps_the_moments():
    z = RNG.normal(size=(50, 4))
    r = factors.factor(z)
    assert np.allclose(r, np.triu(r)) and (np.diag(r) >= 0).all() and r.T @ r == pytest.approx(z.T @ z)
    assert factors.factor(z[:2]).shape == (4, 4)
    assert factors.factor(factors.factor(z[:20]), z[20:]) == pytest.approx(r)
    assert factors.factor(np.zeros((0, 3))) == pytest.approx(np.zeros((3, 3)))


@pytest.mark.parametrize("cells", [1, 2, 7])
def test_leave_one_out_equals_refactoring(cells):
    blocks = [RNG.normal(size=(RNG.integers(1, 9), 3)) for _ in range(cells)]
    got = factors.leave_one_out([factors.factor(b) for b in blocks])
    for i, r in enumerate(got):
        rest = np.vstack([np.zeros((0, 3)), *[b for j, b in enumerate(blocks) if j != i]])
        assert r == pytest.approx(factors.factor(rest), abs=1e-12)


def frame(spark, x, y, parts):
    names = [f"x{j}" for j in range(x.shape[1])]
    rows = [(*map(float, r), float(v), i % 5, [-1 if i % 5 == o else (i // 5) % 5 for o in range(5)]) for i, (r, v) in enumerate(zip(x, y))]
    return names, spark.createDataFrame(rows, ", ".join([f"{c} double" for c in names]) + ", y double, fold int, inner array<int>").repartition(parts)


@pytest.mark.parametrize("parts, fan", [(3, 32), (40, 4)])
def test_tree_of_factors_equals_one(spark, monkeypatch, parts, fan):
    monkeypatch.setattr(factors, "FAN", fan)
    monkeypatch.setattr(factors, "_ROWS", 7)
    x, y = RNG.normal(size=(300, 3)), RNG.normal(size=300)
    names, df = frame(spark, x, y, parts)
    anchor = column_means(df, [*names, "y"])
    cells = factors.cell_factors(df, [*names, "y"], by_fold(anchor))
    assert set(cells) == {str(f) for f in range(5)}
    for f, r in cells.items():
        mine = np.arange(300) % 5 == int(f)
        assert r == pytest.approx(factors.factor(augmented(x[mine] - anchor[:-1], y[mine] - anchor[-1])), abs=1e-10)
    assert factors.cell_factors(df.limit(0), [*names, "y"], by_fold(anchor)) == {}


def test_ill_conditioned_held_out_least_squares(spark):
    x, y = near_dependent(400, 1e-7)
    assert np.linalg.cond(x - x.mean(0)) > 1e7
    names, df = frame(spark, x, y, 6)
    held_out = np.zeros(400)
    for f in range(5):
        mine = np.arange(400) % 5 == f
        middle = x[~mine].mean(0)
        b = np.linalg.lstsq(np.column_stack([np.ones((~mine).sum()), x[~mine] - middle]), y[~mine], rcond=None)[0]
        held_out[mine] = np.column_stack([np.ones(mine.sum()), x[mine] - middle]) @ b
    by_row = {tuple(r): p for r, p in zip(x.tolist(), held_out)}

    def gap(predicted):
        return max(abs(r["v_prediction"] - by_row[r["x0"], r["x1"], r["x2"]]) for r in predicted.collect())
    assert gap(linear.cross_validate_factors(df, {"v": names}, "y")) < 1e-6 * y.std()
    with pytest.raises(ValueError, match="rank-deficient"):                     # moments cannot tell the two columns apart
        linear.cross_validate(df, {"v": names}, "y")


def test_condition_of_a_billion_against_a_direct_decomposition():
    x, y = near_dependent(500, 1e-9)
    assert np.linalg.cond(x) > 5e8
    z = augmented(x, y)
    r = factors.factor(*[factors.factor(z[i::9]) for i in range(9)])
    middle, scale = x.mean(0), x.std(0)
    u, s, vt = np.linalg.svd((x - middle) / scale, full_matrices=False)
    for alpha in (1e-4, 1.0, 100.0):
        direct = vt.T @ (u.T @ (y - y.mean()) * s / (s ** 2 + alpha)) / scale
        slopes, intercepts = factors.ridge_path(r, [alpha])
        fitted, plain = x @ slopes[:, 0] + intercepts[0], (x - middle) @ direct + y.mean()
        assert np.abs(fitted - plain).max() < 1e-8 * y.std()
        assert factors.squared_error(r, slopes, intercepts)[0] == pytest.approx(np.square(y - fitted).sum(), rel=1e-9)


def test_constant_and_dependent_columns():
    x = np.column_stack([RNG.normal(size=60), np.full(60, 3.7), RNG.normal(size=60)])
    x = np.column_stack([x, 2 * x[:, 0] - x[:, 2]])
    y = x[:, 0] + RNG.normal(size=60)
    r = factors.factor(augmented(x, y))
    for columns in ([0, 2, 3], [0, 1]):
        with pytest.raises(ValueError, match="rank-deficient"):
            factors.least_squares(factors.subset(r, columns))
    slopes, intercept = factors.least_squares(factors.subset(r, [0, 2]))
    expected = np.linalg.lstsq(np.column_stack([np.ones(60), x[:, [0, 2]]]), y, rcond=None)[0]
    assert [intercept, *slopes] == pytest.approx(expected, abs=1e-9)
    path, _ = factors.ridge_path(r, [1.0])
    assert abs(path[1, 0]) < 1e-9 and np.isfinite(path).all()


def test_nested_ridge_from_factors_and_from_moments(spark):
    x = RNG.normal(size=(300, 3))
    names, df = frame(spark, x, x @ [1.0, -2, 0] + RNG.normal(size=300), 5)
    _, a = nested.nested_ridge(nested.plain_problem(df, names, "y", list(range(5))), {"v": names, "w": names[:2]})
    _, b = nested.nested_ridge(nested.factor_problem(df, names, "y", list(range(5))), {"v": names, "w": names[:2]})
    for v in a:
        for o in range(5):
            assert a[v][o]["alpha"] == b[v][o]["alpha"] and a[v][o]["slope"] == pytest.approx(b[v][o]["slope"], rel=1e-8)
