"""Solvers from moments against direct fits, and leakage tests: held-out rows must not move training results."""
import numpy as np
import pytest

from wordframe.functions.basis import KNOT_PROBS, spline_batch
from wordframe.operators.ranking import assign_inner_folds
from wordframe.plans import linear, nested, representation, selection

N, OUTER = 120, [0, 1, 2, 3]


def frame(spark, x, y, folds, names, partitions=5):
    rows = [(1, i, int(folds[i]), float(y[i]), *map(float, x[i])) for i in range(len(y))]
    schema = "item bigint, zone bigint, fold int, y double, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema).repartition(partitions)


def data(seed=8, width=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(N, width)) * np.arange(1, width + 1) + 50
    return x, 350 + x @ np.arange(1, width + 1) + rng.normal(size=N), np.arange(N) % len(OUTER)


NAMES = [f"x{i}" for i in range(5)]


def test_held_out_ols_equals_direct_fits_and_ignores_held_out_rows(spark):
    x, y, folds = data()
    out, audit = linear.cross_validate(frame(spark, x, y, folds, NAMES), {"m": NAMES, "two": NAMES[:2]}, "y")
    got = {r.zone: r for r in out.collect()}
    assert len(got) == N
    for name, columns in (("m", range(5)), ("two", range(2))):
        for f in OUTER:
            design = np.c_[np.ones(N), x[:, columns]]
            beta = np.linalg.lstsq(design[folds != f], y[folds != f], rcond=None)[0]
            for i in np.flatnonzero(folds == f):
                assert got[i][f"{name}_prediction"] == pytest.approx(design[i] @ beta, rel=1e-9)
    x2, y2 = x.copy(), y.copy()
    x2[folds == 0] += 1000
    y2[folds == 0] += 1000
    _, audit2 = linear.cross_validate(frame(spark, x2, y2, folds, NAMES), {"m": NAMES}, "y")
    first = lambda a: a.filter("variant = 'm' AND fold = 0").first()
    np.testing.assert_allclose(first(audit).training_mean, first(audit2).training_mean)
    np.testing.assert_allclose(first(audit).training_scale, first(audit2).training_scale)
    np.testing.assert_allclose(first(audit).training_mean, x[folds != 0].mean(0))
    np.testing.assert_allclose(first(audit).training_scale, x[folds != 0].std(0))


def test_constant_or_dependent_predictors_are_errors(spark):
    x, y, folds = data()
    x[:, 1] = 3.0
    with pytest.raises(ValueError, match="constant"):
        linear.cross_validate(frame(spark, x, y, folds, NAMES), {"m": NAMES}, "y")
    x[:, 1] = 2 * x[:, 0] + 1
    with pytest.raises(ValueError, match="rank"):
        linear.cross_validate(frame(spark, x, y, folds, NAMES), {"m": NAMES}, "y")


def test_coefficient_table(spark):
    x, y, folds = data()
    _, rows = linear.describe(frame(spark, x, y, folds, NAMES), NAMES, "y")
    z = np.c_[np.ones(N), (x - x.mean(0)) / x.std(0)]
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    error = y - z @ beta
    se = np.sqrt(np.diag(np.linalg.inv(z.T @ z)) * (error @ error) / (N - 6))
    np.testing.assert_allclose([r[1] for r in rows], beta, rtol=1e-8)
    np.testing.assert_allclose([r[2] for r in rows], se, rtol=1e-6)
    assert all(0 <= r[4] <= 1 for r in rows)


def direct_ridge(x, y, alpha):
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda v: (v - mean) / scale @ beta + y.mean()


def direct_nested(design, y, folds, inner, alphas):
    """Textbook nested loop. ``design(train, rows)`` prepares rows with training-only preprocessing."""
    out, chosen = np.zeros(len(y)), {}
    for s, o in enumerate(OUTER):
        train = np.flatnonzero(folds != o)
        loss = np.zeros(len(alphas))
        for i in range(5):
            fit, val = train[inner[train, s] != i], train[inner[train, s] == i]
            for k, a in enumerate(alphas):
                loss[k] += ((y[val] - direct_ridge(design(fit, fit), y[fit], a)(design(fit, val))) ** 2).sum()
        chosen[o] = alphas[int(np.argmin(loss))]
        test = np.flatnonzero(folds == o)
        out[test] = direct_ridge(design(train, train), y[train], chosen[o])(design(train, test))
    return out, chosen


def prepared(spark, x, y, folds, names=NAMES):
    df = assign_inner_folds(frame(spark, x, y, folds, names), ["item", "zone"], OUTER)
    rows = {r.zone: r.inner for r in df.collect()}
    return df, np.array([rows[i] for i in range(len(y))])


def test_nested_ridge_equals_the_loop(spark):
    x, y, folds = data()
    x[:, 4] = 7.0                                           # constant column: kept, with no effect
    df, inner = prepared(spark, x, y, folds)
    problem = nested.plain_problem(df, NAMES, "y", OUTER)
    tuned, models = nested.nested_ridge(problem, {"m": NAMES, "part": NAMES[1:3]})
    got = {r.zone: r for r in nested.predict(df, problem, models).collect()}
    for v, columns in (("m", [0, 1, 2, 3, 4]), ("part", [1, 2])):
        expected, alpha = direct_nested(lambda t, r: x[r][:, columns], y, folds, inner, nested.ALPHAS)
        assert {o: t["alpha"] for o, t in tuned[v].items()} == alpha
        np.testing.assert_allclose([got[i][f"{v}_prediction"] for i in range(N)], expected, rtol=1e-7)


def test_nested_splines_equal_the_loop_and_do_not_leak(spark):
    x, y, folds = data(10)
    df, inner = prepared(spark, x, y, folds)
    problem = nested.spline_problem(df, NAMES[:3], NAMES[3:], "y", OUTER)
    tuned, models = nested.nested_ridge(problem, {"s": problem.names}, [.001, 1, 100])
    got = {r.zone: r.s_prediction for r in nested.predict(df, problem, models).collect()}

    def design(train, rows):
        knots = [list(np.quantile(x[train, j], KNOT_PROBS)) for j in (3, 4)]
        return np.column_stack([x[rows][:, :3], *[spline_batch(x[rows, j], k) for j, k in zip((3, 4), knots)]])
    expected, alpha = direct_nested(design, y, folds, inner, [.001, 1, 100])
    assert {o: t["alpha"] for o, t in tuned["s"].items()} == alpha
    np.testing.assert_allclose([got[i] for i in range(N)], expected, rtol=1e-6)
    x2, y2 = x.copy(), y.copy()
    x2[folds == 0] += 1000
    y2[folds == 0] += 1000
    df2, _ = prepared(spark, x2, y2, folds)
    other = nested.spline_problem(df2, NAMES[:3], NAMES[3:], "y", OUTER)
    tuned2, models2 = nested.nested_ridge(other, {"s": other.names}, [.001, 1, 100])
    np.testing.assert_allclose(tuned["s"][0]["loss"], tuned2["s"][0]["loss"], rtol=1e-5)
    np.testing.assert_allclose(models["s"][0]["slope"], models2["s"][0]["slope"], rtol=1e-4, atol=1e-8)


def test_family_selection_never_reads_outer_targets(spark):
    x, y, folds = data(42)
    df, _ = prepared(spark, x, y, folds)
    fams = {"one": NAMES[3:4], "two": NAMES[4:]}

    def run(d):
        problem = nested.plain_problem(d, NAMES, "y", OUTER)
        tuned, models = nested.nested_ridge(problem, {"core": NAMES[:2], "strong": NAMES[:3], **{f: [*NAMES[:3], *cs] for f, cs in fams.items()}}, [.01, 10])
        chosen = selection.choices(selection.inner_errors(spark, tuned), "strong", list(fams), OUTER)
        selection.composed(problem, models, tuned, {"combined": {o: (selection.added(NAMES[:3], c.accepted, fams), "strong") for o, c in chosen.items()}}, [.01, 10])
        return tuned, models, chosen, nested.fit_audit(problem, {"strong": tuned["strong"]}, [.01, 10])
    tuned, models, chosen, audit = run(df)
    y2, x2 = y.copy(), x.copy()
    y2[folds == 0] += 1000
    x2[folds == 0] += 1000
    df2, _ = prepared(spark, x2, y2, folds)
    tuned2, models2, chosen2, audit2 = run(df2)
    assert chosen[0] == chosen2[0]
    for v in ("core", "strong", "one", "two"):
        np.testing.assert_allclose(tuned[v][0]["loss"], tuned2[v][0]["loss"], rtol=1e-6)
    assert all(set(by) == set(OUTER) for by in models.values())
    for r, r2 in zip(audit, audit2):
        assert r[:4] == r2[:4]
        if r[1] == 0:                                       # what the fits of fold 0 saw does not move with its held-out rows
            np.testing.assert_allclose(r[4], r2[4], rtol=1e-6)
            np.testing.assert_allclose(r[5], r2[5], rtol=1e-5)
    train = x[folds != 0][:, :3]
    whole = next(r for r in audit if r[1] == 0 and r[2] == -1)
    np.testing.assert_allclose(whole[4], train.mean(0))
    np.testing.assert_allclose(whole[5], train.std(0))


def hidden(seed=3, depths=3, width=5):
    rng = np.random.default_rng(seed)
    names = representation.hidden_names(depths, width)
    return rng.normal(size=(N, depths * width)) @ np.diag(np.linspace(1, 3, depths * width)), names


def test_fold_components_equal_direct_eigenvectors_and_do_not_leak(spark):
    h, layers = hidden()
    flat = [c for cs in layers for c in cs]
    _, y, folds = data()
    df, inner = prepared(spark, h, y, folds, flat)
    fitted = representation.fold_components(df, layers, OUTER, 2)
    for (o, i), parts in fitted.items():
        s = OUTER.index(o)
        train = np.flatnonzero((folds != o) & ((inner[:, s] != i) if i is not None else True))
        for l, p in enumerate(parts):
            block = h[train][:, 5 * l:5 * l + 5]
            np.testing.assert_allclose(p.mean, block.mean(0), atol=1e-9)
            np.testing.assert_allclose(p.loadings.T @ p.loadings, np.eye(2), atol=1e-9)
            values = np.sort(np.linalg.eigvalsh(np.cov(block.T)))[::-1][:2]
            np.testing.assert_allclose(p.variance, values, rtol=1e-8)
            z, t = p.scores(block), p.typicality(block)
            moved = block - block.mean(0)
            np.testing.assert_allclose(t[:, 0], np.sqrt((moved ** 2).sum(1) / 5))
            np.testing.assert_allclose(t[:, 2], np.sqrt(np.maximum((moved ** 2).sum(1) - (z ** 2).sum(1), 0) / 5), atol=1e-9)
    h2 = h.copy()
    h2[folds == 0] += 1000
    other = representation.fold_components(prepared(spark, h2, y, folds, flat)[0], layers, OUTER, 2)
    for i in (0, 1, 2, 3, 4, None):
        for p, r in zip(fitted[0, i], other[0, i]):
            np.testing.assert_allclose(p.mean, r.mean, atol=1e-7)
            np.testing.assert_allclose(p.variance, r.variance, rtol=1e-5)


def test_representation_evaluation_covers_every_row_and_ignores_outer_targets(spark):
    h, layers = hidden()
    x, y, folds = data()
    flat = [c for cs in layers for c in cs]
    names = [*NAMES, *flat]

    def run(target):
        df, _ = prepared(spark, np.c_[x, h], target, folds, names)
        prob = representation.problem(df, NAMES[:2], NAMES[2:4], {"curvature": NAMES[4:]}, layers, "y", OUTER, 2, True)
        fams = representation.family_columns({"curvature": NAMES[4:]}, 3, 2)
        tuned, models = representation.tuned_variants(prob, NAMES[:2], NAMES[2:4], fams, True, [.1, 10.])
        combined = representation.selected(prob, selection.inner_errors(spark, tuned), tuned, models, NAMES[:2], fams, [.1, 10.])
        rows = {r.zone: r for r in nested.predict(df, prob, models).collect()}
        return tuned, combined, rows
    tuned, combined, rows = run(y)
    y2 = y.copy()
    y2[folds == 0] += 1000
    _, combined2, rows2 = run(y2)
    assert combined[0] == combined2[0] and len(rows) == N
    predictions = [c for c in rows[0].asDict() if c.endswith("_prediction")]
    assert len(predictions) == 10 and all(np.isfinite(rows[i][c]) for i in range(N) for c in predictions)
    for i in np.flatnonzero(folds == 0):
        for c in predictions:
            assert rows[i][c] == pytest.approx(rows2[i][c], rel=1e-5)


def test_fitted_designs_share_the_products_of_unchanged_columns(spark, monkeypatch):
    """Every cell is the moments of its own rows under its own knots; products of unchanged columns are summed once per outer fold."""
    rng = np.random.default_rng(3)
    rows = [(int(k), int(k % 3), [-1 if o == k % 3 else int(rng.integers(nested.INNER)) for o in range(3)], *map(float, rng.normal(size=4))) for k in range(240)]
    df = spark.createDataFrame(rows, "id int, fold int, inner array<int>, a double, b double, s double, y double").repartition(3)
    seen, plain_moments = [], nested.cell_moments

    def spied(table, columns, emit, **rest):
        x, inner = np.array([r[3:] for r in rows])[:, [["a", "b", "s", "y"].index(c) for c in columns]], np.array([r[2] for r in rows])
        seen.extend((parts[0].shape, parts[-1].shape) for _, *parts in emit(x, None, inner))
        return plain_moments(table, columns, emit, **rest)
    monkeypatch.setattr(nested, "cell_moments", spied)
    problem = nested.spline_problem(df, ["a", "b"], ["s"], "y", [0, 1, 2])
    knots = nested.set_knots(df, ["s"], [0, 1, 2])
    at = problem.names.index
    for o in range(3):
        for i in (*range(nested.INNER), None):
            groups = {"r": lambda p: p >= 0} if i is None else {"t": lambda p: (p >= 0) & (p != i), "v": lambda p: p == i}
            for kind, inside in groups.items():
                x = np.array([r[3:] for r in rows if inside(np.int64(r[2][o]))])
                z = np.empty((len(x), len(problem.names) + 2))
                z[:, 0], z[:, -1] = 1, x[:, 3] - problem.anchor[-1]
                for k, c in enumerate("ab"):
                    z[:, at(c) + 1] = x[:, k] - problem.anchor[at(c)]
                z[:, [at(n) + 1 for n in nested.spline_names("s")]] = spline_batch(x[:, 2], knots[o, i][0])
                got = problem.refit(o) if i is None else problem.train(o, i) if kind == "t" else problem.validate(o, i)
                assert np.allclose(got, z.T @ z, atol=1e-9)
    square = sum(n for (n, a), (_, b) in seen if a == b)
    assert square == sum(1 for r in rows for p in r[2] if p >= 0)          # a row once for each outer fold that trains on it
