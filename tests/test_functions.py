"""Closed-form values of column functions, spans, windows and statistics."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordframe.functions import basis, layers, numeric, statistics, text, vectors
from wordframe.operators import ngram, spans, states
from wordframe.plans import compare, correlation, selection


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def doubles(values):
    return F.array(*[F.lit(float(v)) for v in values])


def stack(rows):
    return F.array(*[doubles(r) for r in rows])


def test_distances_and_curvature(spark):
    rng = np.random.default_rng(12)
    for _ in range(3):
        a, b = rng.normal(size=(2, 6))
        r = one(spark, c=vectors.cosine_distance(doubles(a), doubles(b)), d=vectors.relative_distance(doubles(a), doubles(b)))
        assert r.c == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))
        assert min(abs(r.d - np.linalg.norm(a - b) / np.linalg.norm(v)) for v in (a, b)) < 1e-9
    direction = rng.normal(size=4)
    line = [list(2.0 + direction * t) for t in np.linspace(0, 5, 7)]
    walk = np.cumsum(rng.normal(size=(7, 4)), axis=0).tolist()
    still, bent = (one(spark, **vectors.curvature(stack(s))) for s in (line, walk))
    assert still.turn_mean == pytest.approx(0, abs=1e-6) and still.still_share == 0
    steps = np.diff(np.array(walk), axis=0)
    cosine = [(u @ v) / np.linalg.norm(u) / np.linalg.norm(v) for u, v in zip(steps, steps[1:])]
    assert bent.turn_mean == pytest.approx(np.mean(1 - np.array(cosine))) or bent.turn_mean == pytest.approx(np.mean(np.arccos(cosine)))


def test_profiles_match_numpy(spark):
    h = np.cumsum(np.random.default_rng(4).normal(size=(8, 5)), axis=0)
    r = one(spark, c=vectors.cosine_profile(stack(h)), l=vectors.relative_profile(stack(h)),
            **vectors.profile_summaries(vectors.cosine_profile(stack(h)), "cosine"),
            **vectors.profile_shape(vectors.cosine_profile(stack(h))), **vectors.norm_dynamics(stack(h)))
    n = np.linalg.norm(h, axis=1)
    cosine = 1 - (h[1:] * h[:-1]).sum(1) / (n[1:] * n[:-1])
    np.testing.assert_allclose(r.c, cosine)
    np.testing.assert_allclose(r.l, np.linalg.norm(np.diff(h, axis=0), axis=1) / n[:-1])
    assert r.peak_layer_cosine == cosine.argmax() + 1
    third = [p.mean() for p in np.array_split(cosine, 3)]
    np.testing.assert_allclose([r.early_mean_cosine, r.middle_mean_cosine, r.late_mean_cosine], third)
    np.testing.assert_allclose(r.centre, cosine @ np.linspace(0, 1, 7) / cosine.sum())
    np.testing.assert_allclose(r.log_norm_step, abs(np.diff(np.log(n))).max())


@pytest.mark.parametrize("n", range(3, 14))
def test_thirds_follow_the_even_split(n):
    expected = [(int(p[0]) + 1, int(p[-1]) + 1) for p in np.array_split(np.arange(n), 3)]
    assert list(layers.thirds(n).values()) == expected


def test_distribution_shape_and_entropy(spark):
    flat, ramp = doubles([0, 0, 0, 0]), doubles([0, 1, 2, 3])
    r = one(spark, h=vectors.entropy_bits(flat), s=vectors.surprisal_bits(flat, F.lit(1)), **vectors.distribution_shape(flat, F.lit(2)))
    assert (r.h, r.s) == (pytest.approx(2), pytest.approx(2))
    np.testing.assert_allclose([r.target_log_rank, r.top10_mass, r.top_margin, r.collision], [math.log(2), 1, 0, 0.25], atol=1e-12)
    t = one(spark, **vectors.distribution_shape(ramp, F.lit(0)))
    assert t.target_log_rank == pytest.approx(math.log(5)) and t.top_margin > 0


def test_undefined_stacks(spark):
    good = [[1, 0], [1, 1], [2, 1], [2, 2]]
    bad = [good[:3], good[:3] + [[0, 0]], good[:3] + [[float("nan"), 1]]]
    assert not one(spark, u=vectors.undefined_stack(stack(good))).u
    assert all(one(spark, u=vectors.undefined_stack(stack(b))).u for b in bad)


def test_pooling_is_a_mean_per_layer(spark):
    rows = [(1, 1, l, [float(l), float(p)]) for l in range(4) for p in range(3)]
    r = states.pool(spark.createDataFrame(rows, "item bigint, zone bigint, layer int, vec array<double>")).first()
    assert r.h == [[float(l), 1.0] for l in range(4)] and (r.layers, r.pieces) == (4, 12)

def test_pool_of_short_stacks_is_sums_of_columns(spark):
    """Region 2 lacks layer 1; grouping by objects, which falls back to a sort after 128 groups, must not come in."""
    rows = [(1, 1, 0, [1.0, 2.0]), (1, 1, 0, [3.0, 6.0]), (1, 1, 1, [5.0, -1.0]), (1, 2, 0, [0.0, 4.0]), (1, 2, 2, [7.0, 7.0])]
    out = states.pool(spark.createDataFrame(rows, "item bigint, zone bigint, layer int, vec array<double>"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    found = {r["zone"]: (r["h"], r["layers"], r["pieces"]) for r in out.collect()}
    assert found == {1: ([[2.0, 4.0], [5.0, -1.0]], 2, 3), 2: ([[0.0, 4.0], [7.0, 7.0]], 2, 2)}


def test_pool_of_long_stacks_agrees_with_the_short_form(spark, monkeypatch):
    rows = [(1, z, l, [float((z * 7 + l * 3 + p + d) % 11) for d in range(3)]) for z in range(1, 6) for l in range(1, 4) for p in range(1 + (z + l) % 3)]
    df = spark.createDataFrame(rows, "item bigint, zone bigint, layer int, vec array<double>")
    short = {r["zone"]: r for r in states.pool(df).collect()}
    monkeypatch.setattr(states, "CELLS", 8)
    for r in states.pool(df).collect():
        assert (r["layers"], r["pieces"]) == (short[r["zone"]]["layers"], short[r["zone"]]["pieces"])
        assert [v for h in r["h"] for v in h] == pytest.approx([v for h in short[r["zone"]]["h"] for v in h])



def test_numbers_and_cells(spark):
    df = spark.createDataFrame([("",), ("nan",), ("2.5",), (".",), (None,)], "t string")
    out = [r.v for r in df.select(numeric.number(F.col("t")).alias("v")).collect()]
    assert out[0] is None and math.isnan(out[1]) and out[2] == 2.5 and out[3] is None and out[4] is None
    cells = spark.createDataFrame([("8.0", "n"), ("8.5", "n"), ("true", "b"), ("Hello,", "s")], "c string, k string")
    assert [r.w for r in cells.select(text.canonical_cell(F.col("c"), F.col("k")).alias("w")).collect()] == ["8", "8.5", "TRUE", "Hello,"]
    status = spark.createDataFrame([(".",), ("",), (None,), ("0",), ("-3",), ("inf",), ("80",)], "c string")
    assert [r.s for r in status.select(text.duration_status(F.col("c")).alias("s")).collect()] == ["missing"] * 3 + ["invalid"] * 3 + ["valid"]
    assert one(spark, f=text.strip_outer(F.lit("(‘up-to-date?’)"))).f == "up-to-date"
    same = numeric.same
    r = one(spark, a=same(F.lit("nan"), F.lit("NaN")), b=same(F.lit("1"), F.lit("1.00000000000001")), c=same(F.lit("x"), F.lit("y")),
            d=same(F.lit(None).cast("string"), F.lit("")), e=same(F.lit("1"), F.lit("1.1")))
    assert (r.a, r.b, r.c, r.d, r.e) == (True, True, False, True, False)


def schedule(n, window, stride):
    start, out = 1, {}
    while start < n:
        end = min(n, window if start == 1 else start + stride)
        for i in range(start, end):
            out[i] = (max(0, end - window), end, start)
        start = end
    out[0] = (0, min(n, window), 1)
    return out


@pytest.mark.parametrize("window,stride", [(4, 2), (8, 3), (16, 15), (5, 1)])
def test_scoring_windows_equal_the_loop(spark, window, stride):
    sizes = [1, 2, window - 1, window, window + 1, window + stride, window + stride + 1, 3 * window, 71]
    df = spark.createDataFrame([(i, n) for n in sizes for i in range(n)], "idx bigint, n bigint")
    for r in df.select("idx", "n", *[c.alias(k) for k, c in spans.window_of(F.col("idx"), F.col("n"), window, stride).items()]).collect():
        assert (r.begin, r.end, r.target_start) == schedule(r.n, window, stride)[r.idx]
    with pytest.raises(ValueError):
        spans.window_of(F.col("idx"), F.col("n"), 4, 4)


def test_overlap_join_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    make = lambda n: [(int(rng.integers(0, 2)), int(s), int(s + rng.integers(1, 40))) for s in rng.integers(0, 400, n)]
    a, b = make(90), make(80)
    schema = "item bigint, start bigint, end bigint"
    out = spans.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "item", width=16).collect()
    got = sorted((r.item, r.l_start, r.l_end, r.r_start, r.r_end) for r in out)
    assert got == sorted((x[0], *x[1:], *y[1:]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


def test_ownership_with_blanks_and_ambiguity(spark):
    words = ["One ", " re-read", '(sic)  ,so', "it."]
    regions = spark.createDataFrame([(1, i + 1, w) for i, w in enumerate(words)], "item bigint, zone bigint, word string")
    placed = spans.region_spans(regions)
    cut = spans.pieces(placed)
    owned = {(r.start, r.end): r.owner for r in spans.owners(cut, placed).collect()}
    for r in cut.collect():
        assert owned[r.start, r.end] == r.zone
    assert "".join(r.text for r in cut.orderBy("start").collect()) == " ".join(words)
    wide = spark.createDataFrame([(1, 2, 9)], "item bigint, start bigint, end bigint")
    assert spans.owners(wide, placed).first().ambiguous
    assert spans.unowned(spans.owners(wide, placed), placed).count() == 4


def test_bigram_shape_equals_the_whole_distribution(spark):
    words = "a b a b c a c b b a d a b".split()
    df = spark.createDataFrame([(1, i + 1, w) for i, w in enumerate(words)], "item bigint, zone bigint, word string")
    vocabulary = sorted(set(words))
    for r in ngram.score(df, k=0.5).orderBy("zone").collect():
        if r.zone == 1:
            assert all(math.isnan(r[c]) for c in ("surprisal", "entropy_bits", *ngram.SHAPE))
            continue
        prev = words[r.zone - 2]
        counts = np.array([sum(words[i] == prev and words[i + 1] == w for i in range(len(words) - 1)) for w in vocabulary]) + 0.5
        p = counts / counts.sum()
        t = p[vocabulary.index(r.word)]
        top = np.sort(p)[::-1]
        np.testing.assert_allclose([r.surprisal, r.entropy_bits, r.target_log_rank, r.top10_mass, r.top_margin, r.collision],
                                   [-np.log2(t), -(p * np.log2(p)).sum(), np.log1p(1 + (p > t).sum()), top[:10].sum(), top[0] - top[1], (p * p).sum()])


def test_bigram_keys_that_meet_are_drawn_anew(spark, monkeypatch):
    rows = [(i % 3, i // 3 + 1, w) for i, w in enumerate("a b ab a b c a bc c b ab a".split())] + [(3, 1, "a"), (3, 2, None), (3, 3, "b")]
    df = spark.createDataFrame(rows, "item bigint, zone bigint, word string")
    want = sorted(map(str, ngram.score(df).collect()))
    true_key, drawn = ngram.bigram_key, []
    monkeypatch.setattr(ngram, "bigram_key", lambda seed: drawn.append(seed) or (
        F.when(true_key(seed).isNotNull(), F.lit(7).cast("bigint")) if seed == 0 else true_key(seed)))
    out = ngram.score(df, finish=lambda c: c * 1)
    assert sorted(map(str, out.collect())) == want and drawn == [0, 1, 1]
    # What is moved for each token holds a number for its two words, and the scores are finished before they meet it.
    assert "_bigram" in out._jdf.queryExecution().analyzed().toString()


def test_benjamini_hochberg_by_definition(spark):
    p = np.random.default_rng(21).uniform(size=40).round(2)
    df = spark.createDataFrame([(i % 2, i, float(v)) for i, v in enumerate(p)], "f int, i int, p double").repartition(3)
    got = {r.i: r.q_value for r in correlation.adjust(df, ["f"], "p", "i").collect()}
    for f in (0, 1):
        mine = p[f::2]
        for i, v in zip(range(f, 40, 2), mine):
            want = min(min(1.0, w * len(mine) / (mine <= w).sum()) for w in mine if w >= v)
            assert got[i] == pytest.approx(want)


def test_benjamini_hochberg_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(correlation, "BLOCK", 7)
    p = np.random.default_rng(22).uniform(size=60).round(1)
    df = spark.createDataFrame([(None if i % 3 else "f", i, float(v)) for i, v in enumerate(p)], "f string, i int, p double")
    for r in correlation.adjust(df, ["f"], "p", "i").collect():
        mine = np.array([v for i, v in enumerate(p) if (i % 3 == 0) == (r.f == "f")])
        assert r.q_value == pytest.approx(min(min(1.0, w * len(mine) / (mine <= w).sum()) for w in mine if w >= r.p))


def test_student_tail():
    for t, df, p in [(2.228139, 10, 0.05), (1.959964, 1e7, 0.05), (0.0, 5, 1.0), (12.7062, 1, 0.05), (3.169273, 10, 0.01)]:
        assert statistics.t_two_sided(t, df) == pytest.approx(p, abs=2e-6)
    assert statistics.correlation_p(1.0, 10) == 0.0


def test_spline_basis_column_and_batch_agree(spark):
    x = np.linspace(-3, 9, 61)
    knots = [0.0, 1.0, 2.5, 6.0]
    batch = basis.spline_batch(x, knots)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    rows = np.array([list(r) for r in df.select(*[c.alias(f"b{i}") for i, c in enumerate(basis.spline_columns(F.col("x"), knots))]).collect()])
    np.testing.assert_allclose(rows, batch, atol=1e-12)
    assert batch.shape[1] == 5
    t = np.array(basis.knot_vector(knots))
    assert np.all(batch >= -1e-12) and np.all(batch.sum(1) <= 1 + 1e-12) and len(t) == 10
    np.testing.assert_allclose(batch[x <= 0], np.repeat(basis.spline_batch(np.array([0.0]), knots), (x <= 0).sum(), 0))
    np.testing.assert_allclose(batch[x >= 6], np.repeat(basis.spline_batch(np.array([6.0]), knots), (x >= 6).sum(), 0))


def test_selection_rule_by_loops(spark):
    rng = np.random.default_rng(31)
    names = ["base", "p", "q", "r", "s"]
    loss = {(v, o): rng.normal(10 - 0.5 * names.index(v), 1.0, 5).round(3) for v in names for o in range(6)}
    errors = spark.createDataFrame([(v, o, i, float(x)) for (v, o), xs in loss.items() for i, x in enumerate(xs)], selection.INNER_SCHEMA)
    got = selection.choices(errors, "base", names[1:], list(range(6)))
    for o in range(6):
        base = loss["base", o]
        want = [v for v in names[1:] if loss[v, o].sum() < base.sum() and (loss[v, o] < base).sum() >= selection.LEAST_WINS]
        assert got[o].accepted == want
        assert got[o].best == (min(want, key=lambda v: loss[v, o].sum()) if want else None)
    assert selection.superseded(["one", "all", "other"], {"all": ["one", "two"]}) == ["all", "other"]
    assert selection.superseded(["one", "other"], {"all": ["one", "two"]}) == ["one", "other"]


def test_concentration_counts_ties_in_proportion(spark):
    y = np.zeros(300)
    base = np.r_[np.full(6, 2.0), np.ones(294)]
    better = np.r_[np.full(6, 1.0), np.ones(294)]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(y, base, better)], "y double, b double, p double")
    r = compare.concentration(df, "y", "b", {"p": "p", "same": "b"}).orderBy("variant").collect()
    assert r[0].net_gain == pytest.approx(18) and r[0].top_share == pytest.approx(0.5) and r[1].top_share is None


def test_residual_profile_with_missing_predictions(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, None), (3.0, 3.5), (4.0, 3.0)], "y double, p double")
    r = compare.residual_profile(df, "y", "p").first()
    assert (r.n, r.undefined, r.minimum, r.maximum, r["median"]) == (3, 1, -0.5, 1.0, 0.5)
    r = compare.residual_profile(df.filter("p is null"), "y", "p").first()
    assert (r.n, r.undefined, r["median"]) == (0, 1, None)


def test_ranks_refuse_nan_by_name(spark):
    from wordframe.operators.ranking import exact_quantiles
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    with pytest.raises(ValueError, match="NaN"):
        exact_quantiles(df, [], "v", [0.5])


def test_pair_counts_leave_out_missing_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 1.0), (4.0, 5.0)], "a double, b double")
    for method in ("pearson", "spearman"):
        (row,) = correlation.pair_correlations(df, [("a", "b")], method)
        assert row[3] == 3
