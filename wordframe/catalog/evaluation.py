"""Modelling operators without a closed SQL form, and those SQL can state given their inputs (M*, P14, P21)."""
import re

import numpy as np
from pyspark.sql import functions as F

from wordframe.catalog.aggregates import t_p_value
from wordframe.catalog.contracts import VIEWS, both_predictions, joined
from wordframe.catalog.registry import q, query
from wordframe.catalog.scans import fresh
from wordframe.catalog.sequences import counted
from wordframe.cluster import cut, remember, shared
from wordframe.functions import basis
from wordframe.functions.layers import layer_names, third_names
from wordframe.functions.numeric import ratio, snap
from wordframe.operators import ngram, positions, ranking, spans
from wordframe.operators.moments import by_fold, by_inner_fold, by_weights, cell_moments, centered
from wordframe.operators.ranking import exact_quantiles
from wordframe.plans import cases, compare, frozen, linear, nested, reading, representation, selection
from wordframe.sources import tables

KEYS = ["item", "zone"]
OUTER = cases.OUTER


@query("p14_position_controls", f"""SELECT f.item, f.zone, {q('ln(1 + f.zone)', 6)} AS log_zone, {q('ln(1 + f.first)', 6)} AS log_before, {q('avg(t.idx - s.w_begin) / 1024', 6)} AS local,
    {q('(avg(t.idx - s.w_begin) / 1024) ** 2', 6)} AS local_squared FROM first_piece f JOIN tokens t USING (item, zone)
    JOIN schedule s ON t.item = s.item AND greatest(t.idx, 1) >= s.target_start AND greatest(t.idx, 1) < greatest(s.w_end, 2) GROUP BY f.item, f.zone, f.first""")
def p14(spark, sf_dir):
    out = spans.placed_controls(counted(spark, sf_dir).withColumnRenamed("first", "before"))
    return out.select(*KEYS, *[snap(F.col(c), 6).alias(c) for c in ("log_zone", "log_before", "local", "local_squared")])


@query("m01_ols_fit", f"""SELECT count(*) AS n, {q('(cov1 * vz - cov2 * cxz) / (vx * vz - cxz * cxz)', 3)} AS word_length, {q('(cov2 * vx - cov1 * cxz) / (vx * vz - cxz * cxz)', 3)} AS log_frequency,
    {q('my - (cov1 * vz - cov2 * cxz) / (vx * vz - cxz * cxz) * mx - (cov2 * vx - cov1 * cxz) / (vx * vz - cxz * cxz) * mz', 3)} AS intercept FROM sample, (SELECT covar_pop(mean_rt, word_length) AS cov1, covar_pop(mean_rt, log_frequency) AS cov2,
    covar_pop(word_length, log_frequency) AS cxz, var_pop(word_length) AS vx, var_pop(log_frequency) AS vz, avg(mean_rt) AS my, avg(word_length) AS mx, avg(log_frequency) AS mz FROM sample)
    GROUP BY cov1, cov2, cxz, vx, vz, my, mx, mz""")
def m01(spark, sf_dir):
    fit, _ = linear.describe(reading.sample(spark, sf_dir), ["word_length", "log_frequency"], "mean_rt")
    row = [(fit["n"], float(fit["slope"][0]), float(fit["slope"][1]), float(fit["intercept"]))]
    out = spark.createDataFrame(row, "n bigint, word_length double, log_frequency double, intercept double")
    return out.select("n", *[snap(F.col(c), 3).alias(c) for c in ("word_length", "log_frequency", "intercept")])


def case_columns(spark, sf_dir, columns):
    """The case table with ``columns`` only: what predictions are written with is read again by every report."""
    return cases.case(spark, sf_dir).select(*KEYS, "word", "fold", "y", *columns)


def full_and_controls(spark, sf_dir):
    """Held-out predictions with and without the scores, both from one pass of moments."""
    return shared(spark, ("full_controls", sf_dir), lambda: linear.cross_validate(
        case_columns(spark, sf_dir, cases.LEXICAL), {"full": cases.LEXICAL, "controls": cases.LEXICAL[2:]}, "y")[0].drop(*cases.LEXICAL))


@query("m03_full_vs_controls")
def m03(spark, sf_dir):
    rows = full_and_controls(spark, sf_dir)
    report = compare.full_report(rows, "y", "controls_prediction", {"full": "full_prediction"})
    return report.drop("n").join(F.broadcast(compare.residual_profile(rows, "y", "full_prediction").withColumn("variant", F.lit("full"))), "variant")


_WON = """SELECT count(*) FILTER (WHERE a < b) AS w, count(*) AS t FROM (SELECT sqrt(avg((y - controls_prediction) ** 2)) AS b, sqrt(avg((y - full_prediction) ** 2)) AS a
    FROM heldout GROUP BY {c})"""


@query("m03_two_predictors", f"""SELECT 'full' AS variant, n, {q('b', 3)} AS baseline_rmse, {q('a', 3)} AS rmse, {q('1 - a * a / v', 5)} AS r2, {q('b - a', 3)} AS improvement,
    {q('100 * (b - a) / b', 5)} AS improvement_percent, {q('(b * b - a * a) / v', 5)} AS delta_r2, CASE WHEN b - a > 1e-10 THEN 'improves' WHEN b - a < -1e-10 THEN 'worsens' ELSE 'reference/equivalent' END AS outcome,
    f.w AS fold_wins, {q('f.w / f.t', 6)} AS fold_win_fraction, c.w AS context_wins, {q('c.w / c.t', 6)} AS context_win_fraction
    FROM (SELECT count(*) AS n, sqrt(avg((y - controls_prediction) ** 2)) AS b, sqrt(avg((y - full_prediction) ** 2)) AS a, var_pop(y) AS v FROM heldout),
    ({_WON.format(c='fold')}) f, ({_WON.format(c='item')}) c""")
def m03_two(spark, sf_dir):
    """The whole report of the larger model against the smaller one."""
    t = compare.full_report(both_predictions(spark, sf_dir), "mean_rt", "controls_prediction", {"full": "full_prediction"})
    digits = {"baseline_rmse": 3, "rmse": 3, "r2": 5, "improvement": 3, "improvement_percent": 5, "delta_r2": 5, "fold_win_fraction": 6, "context_win_fraction": 6}
    return t.select("variant", "n", "outcome", "fold_wins", "context_wins", *[snap(F.col(c), d).alias(c) for c, d in digits.items()])


@query("m05_two_coefficients", f"""SELECT predictor, {q('b', 3)} AS coefficient, {q('se', 3)} AS standard_error, {q('b / se', 5)} AS t_value FROM (
    SELECT n, my, sy, r, rx, rz, n * sy * sy * (1 - (rx * rx + rz * rz - 2 * r * rx * rz) / (1 - r * r)) / (n - 3) AS s2 FROM (SELECT count(*)::DOUBLE AS n, avg(mean_rt) AS my,
        stddev_pop(mean_rt) AS sy, corr(word_length, log_frequency) AS r, corr(word_length, mean_rt) AS rx, corr(log_frequency, mean_rt) AS rz FROM sample)),
    LATERAL (VALUES ('intercept', my, sqrt(s2 / n)), ('word_length', sy * (rx - r * rz) / (1 - r * r), sqrt(s2 / n / (1 - r * r))),
        ('log_frequency', sy * (rz - r * rx) / (1 - r * r), sqrt(s2 / n / (1 - r * r)))) t(predictor, b, se)""")
def m05_two(spark, sf_dir):
    """Standardised coefficients with their errors and t; the p values are checked by a test."""
    _, rows = linear.describe(reading.sample(spark, sf_dir), SMALL["two"], "mean_rt")
    out = spark.createDataFrame([r[:4] for r in rows], "predictor string, coefficient double, standard_error double, t_value double")
    return out.select("predictor", snap(F.col("coefficient"), 3).alias("coefficient"), snap(F.col("standard_error"), 3).alias("standard_error"),
                      snap(F.col("t_value"), 5).alias("t_value"))


@query("m05_coefficients")
def m05(spark, sf_dir):
    _, rows = linear.describe(cases.case(spark, sf_dir), cases.LEXICAL, "y")
    return spark.createDataFrame(rows, "predictor string, coefficient double, standard_error double, t_value double, p_value double")


def saved_baseline(spark, sf_dir):
    """The baseline's held-out predictions of the case table as a saved run: written to text once, read from there."""
    def build():
        path = fresh(spark, "baseline")
        rows = full_and_controls(spark, sf_dir).withColumn("word", F.lit(None).cast("string"))
        frozen.save_run(rows, "y", {"baseline": "full_prediction"}, path)
        return path
    return frozen.saved_run(spark, remember(spark, ("saved_baseline", sf_dir), build))


@query("m10_incremental_held_out")
def m10(spark, sf_dir):
    """Saved baseline predictions must reproduce in a fit of another kind; each measure's thirds are then added under the saved folds."""
    saved = saved_baseline(spark, sf_dir).select(*KEYS, F.col("fold").alias("saved_fold"), F.col("prediction").alias("saved_prediction"))
    rows = cases.case(spark, sf_dir).join(saved, KEYS, "left")
    variants = {"baseline": cases.LEXICAL, **{m: [*cases.LEXICAL, *third_names(m)] for m in ("cosine", "relative_l2")}}
    predicted = cut(linear.cross_validate_factors(rows, variants, "y"))
    gap, unlike = predicted.agg(F.max(F.abs(F.col("saved_prediction") - F.col("baseline_prediction"))),
                                F.count_if(~F.col("saved_fold").eqNullSafe(F.col("fold")) | F.col("saved_prediction").isNull())).first()
    if unlike or gap > 1e-6:
        raise ValueError(f"baseline predictions do not reproduce: {gap}, {unlike} rows saved otherwise")
    return compare.full_report(predicted, "y", "saved_prediction", {m: f"{m}_prediction" for m in ("cosine", "relative_l2")})


_THIRDS_OF = {"cosine": "c", "relative_l2": "l"}
VIEWS["third_rows"] = " UNION ALL ".join(f"""SELECT '{m}' AS measure, item, zone, fold, mean_rt - 35000 AS y, word_length - 5.0 AS x0,
    ({v}[1] + {v}[2]) / 2 AS x1, ({v}[5] + {v}[6]) / 2 AS x2 FROM (SELECT j.*, s.word_length, s.mean_rt FROM joined j JOIN sample s USING (item, zone))""" for m, v in _THIRDS_OF.items())
_PAIRS = [(a, b) for a in range(3) for b in range(a, 3)]
VIEWS["third_cells"] = "SELECT measure, fold, count(*)::DOUBLE AS n, sum(y) AS y, " + ", ".join(f"sum(x{a}) AS s{a}, sum(x{a} * y) AS c{a}" for a in range(3)) + ", " + \
    ", ".join(f"sum(x{a} * x{b}) AS s{a}{b}" for a, b in _PAIRS) + " FROM third_rows GROUP BY measure, fold"
_TERMS = ["n", "y", *[f"{k}{a}" for a in range(3) for k in "sc"], *[f"s{a}{b}" for a, b in _PAIRS]]
VIEWS["third_training"] = "SELECT f.measure, f.fold, " + ", ".join(f"t.{c} - f.{c} AS {c}" for c in _TERMS) + " FROM third_cells f JOIN (SELECT measure, " + \
    ", ".join(f"sum({c}) AS {c}" for c in _TERMS) + " FROM third_cells GROUP BY measure) t USING (measure)"
VIEWS["third_centred"] = "SELECT measure, fold, y / n AS my, " + ", ".join(f"s{a} / n AS m{a}, c{a} - s{a} * y / n AS g{a}" for a in range(3)) + ", " + \
    ", ".join(f"s{a}{b} - s{a} * s{b} / n AS k{a}{b}" for a, b in _PAIRS) + " FROM third_training"


def _det(rows) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_K = [[f"k{min(a, b)}{max(a, b)}" for b in range(3)] for a in range(3)]
VIEWS["third_fits"] = "SELECT measure, fold, my, m0, m1, m2, " + ", ".join(
    _det([[f"g{r}" if c == j else _K[r][c] for c in range(3)] for r in range(3)]) + f" / {_det(_K)} AS b{j}" for j in range(3)) + " FROM third_centred"


@query("m10_thirds_held_out", f"""SELECT r.measure, r.item, r.zone, r.fold, {q('35000 + my + b0 * (x0 - m0) + b1 * (x1 - m1) + b2 * (x2 - m2)', 3)} AS prediction
    FROM third_rows r JOIN third_fits f ON r.measure = f.measure AND r.fold = f.fold""")
def m10_thirds(spark, sf_dir):
    """A small form for SQL: word length with the early and late third of each measure, held out under the saved folds."""
    rows = joined(spark, sf_dir)
    if "word_length" not in rows.columns:
        rows = rows.join(reading.sample(spark, sf_dir).select(*KEYS, "word_length"), KEYS)
    variants = {m: ["word_length", f"early_mean_{m}", f"late_mean_{m}"] for m in _THIRDS_OF}
    predicted, _ = linear.cross_validate(rows, variants, "mean_rt")
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_prediction").alias("prediction")) for m in variants])
    return predicted.select(*KEYS, "fold", F.inline(each)).select("measure", *KEYS, "fold", snap(F.col("prediction"), 3).alias("prediction"))


VIEWS["residual_thirds"] = " UNION ALL ".join(f"""SELECT '{m}' AS measure, '{t}' AS target, {y} AS y, ({v}[1] + {v}[2]) / 2 AS x0, ({v}[3] + {v}[4]) / 2 AS x1,
    ({v}[5] + {v}[6]) / 2 AS x2 FROM joined_abs""" for m, v in _THIRDS_OF.items() for t, y in (("signed", "residual"), ("absolute", "absolute")))
VIEWS["residual_means"] = "SELECT measure, target, count(*) AS n, avg(y) AS my, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2 FROM residual_thirds GROUP BY ALL"
VIEWS["residual_sums"] = "SELECT measure, target, n, my, sum((y - my) ** 2) AS yy, " + ", ".join(f"sum((x{a} - m{a}) * (y - my)) AS g{a}" for a in range(3)) + ", " + \
    ", ".join(f"sum((x{a} - m{a}) * (x{b} - m{b})) AS k{a}{b}" for a, b in _PAIRS) + " FROM residual_thirds JOIN residual_means USING (measure, target) GROUP BY measure, target, n, my"
VIEWS["residual_fits"] = "SELECT *, yy - b0 * g0 - b1 * g1 - b2 * g2 AS sse FROM (SELECT *, " + ", ".join(
    _det([[f"g{r}" if c == j else _K[r][c] for c in range(3)] for r in range(3)]) + f" / {_det(_K)} AS b{j}" for j in range(3)) + ", " + ", ".join(
    f"({_K[a][a]} * {_K[b][b]} - {_K[a][b]} * {_K[a][b]}) / {_det(_K)} AS v{j}" for j, (a, b) in enumerate(((1, 2), (0, 2), (0, 1)))) + " FROM residual_sums)"
_NAMES = {m: third_names(m) for m in _THIRDS_OF}
VIEWS["residual_rows"] = "SELECT measure, target, n, 1 - sse / yy AS r2, 'intercept' AS predictor, my AS coefficient, sqrt(sse / (n - 4) / n) AS standard_error FROM residual_fits" + "".join(
    f""" UNION ALL SELECT measure, target, n, 1 - sse / yy, CASE measure WHEN 'cosine' THEN '{_NAMES['cosine'][j]}' ELSE '{_NAMES['relative_l2'][j]}' END,
    b{j} * sqrt(k{j}{j} / n), sqrt(sse / (n - 4) * k{j}{j} * v{j} / n) FROM residual_fits""" for j in range(3))
_M09 = {"r2": 6, "coefficient": 3, "standard_error": 3, "t_value": 4, "p_value": 6}


@query("m09_residual_regressions", f"""SELECT measure, target, n, predictor, {q('r2', 6)} AS r2, {q('coefficient', 3)} AS coefficient, {q('standard_error', 3)} AS standard_error,
    {q('coefficient / standard_error')} AS t_value, {q(t_p_value('(coefficient / standard_error)', '(n - 4)'), 6)} AS p_value FROM residual_rows""")
def m09(spark, sf_dir):
    rows = joined(spark, sf_dir).withColumn("absolute", F.abs("residual"))
    out = []
    for measure in ("cosine", "relative_l2"):
        for target, y in (("signed", "residual"), ("absolute", "absolute")):
            fit, table = linear.describe(rows, third_names(measure), y)
            out += [(measure, target, fit["n"], float(1 - fit["sse"] / fit["sst"]), *r) for r in table]
    table = spark.createDataFrame(out, "measure string, target string, n bigint, r2 double, predictor string, coefficient double, "
                                      "standard_error double, t_value double, p_value double")
    return table.select("measure", "target", "n", "predictor", *[snap(F.col(c), d).alias(c) for c, d in _M09.items()])



ALL_PLAIN = list(dict.fromkeys([*cases.CORE, *cases.HISTORY, *layer_names(cases.BLOCKS), *cases.THIRDS,
                                *[c for cs in cases.FAMILIES.values() for c in cs], *cases.NUISANCE]))


def plain(spark, sf_dir):
    """One pass over the case table serves every ridge query without training-dependent columns."""
    return remember(spark, ("plain", sf_dir), lambda: nested.plain_problem(cases.case(spark, sf_dir), ALL_PLAIN, "y", OUTER))


def splined(spark, sf_dir):
    """Spline thirds last, every plain control before them."""
    keep = [c for c in ALL_PLAIN if c not in cases.THIRDS]
    return remember(spark, ("splined", sf_dir), lambda: nested.spline_problem(cases.case(spark, sf_dir), keep, cases.THIRDS, "y", OUTER))


# Nested ridge on one and two predictors in closed form: sums per (outer, inner) cell, standardised 2 x 2 systems, 25 penalties.
VIEWS["rx"] = """SELECT s.item, s.zone, i.outer_fold AS o, i.inner_fold AS i, s.word_length - 5.0 AS x, s.log_frequency - 1.0 AS z, s.mean_rt - 35000.0 AS y
    FROM sample s JOIN inner_folds i USING (item, zone)"""
_SUMS = ["n", "x", "z", "y", "xx", "zz", "xz", "xy", "zy", "yy"]
VIEWS["rcell"] = """SELECT o, i, count(*)::DOUBLE AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz,
    sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy FROM rx GROUP BY o, i"""
VIEWS["rtotal"] = "SELECT o, " + ", ".join(f"sum({c}) AS {c}" for c in _SUMS) + " FROM rcell GROUP BY o"
VIEWS["rtrain"] = ("SELECT c.o, c.i, " + ", ".join(f"t.{c} - c.{c} AS {c}" for c in _SUMS) + " FROM rcell c JOIN rtotal t USING (o)"
                   " UNION ALL SELECT o, -1, " + ", ".join(_SUMS) + " FROM rtotal")
VIEWS["rmoment"] = """SELECT o, i, n, x / n AS mx, z / n AS mz, y / n AS my, xx / n - (x / n) ** 2 AS vx, zz / n - (z / n) ** 2 AS vz,
    xz / n - x / n * z / n AS cxz, xy / n - x / n * y / n AS cxy, zy / n - z / n * y / n AS czy FROM rtrain"""
VIEWS["rfit"] = """SELECT o, i, variant, k, alpha, n, mx, mz, my, vx, vz, CASE WHEN variant = 'one' THEN n * cxy / sqrt(vx) / (n + alpha) / sqrt(vx)
      ELSE ((n + alpha) * n * cxy / sqrt(vx) - n * r * n * czy / sqrt(vz)) / ((n + alpha) ** 2 - (n * r) ** 2) / sqrt(vx) END AS bx,
    CASE WHEN variant = 'one' THEN 0.0 ELSE ((n + alpha) * n * czy / sqrt(vz) - n * r * n * cxy / sqrt(vx)) / ((n + alpha) ** 2 - (n * r) ** 2) / sqrt(vz) END AS bz
    FROM (SELECT *, cxz / sqrt(vx * vz) AS r FROM rmoment), (SELECT unnest(range(0, 25)) AS k), (VALUES ('one'), ('two')) v(variant),
    LATERAL (SELECT 10.0 ** (-4 + k / 3.0) AS alpha)"""
VIEWS["rloss"] = """SELECT f.o, f.i, f.variant, f.k, f.alpha, c.yy - 2 * a * c.y - 2 * bx * c.xy - 2 * bz * c.zy + a * a * c.n + 2 * a * (bx * c.x + bz * c.z)
      + bx * bx * c.xx + 2 * bx * bz * c.xz + bz * bz * c.zz AS loss
    FROM rfit f JOIN rcell c ON f.o = c.o AND f.i = c.i, LATERAL (SELECT my - bx * mx - bz * mz AS a)"""
VIEWS["rgrid"] = "SELECT o, variant, k, alpha, sum(loss) AS total FROM rloss GROUP BY ALL"
VIEWS["rpick"] = "SELECT o, variant, k, alpha FROM (SELECT *, row_number() OVER (PARTITION BY o, variant ORDER BY total, k) AS r FROM rgrid) WHERE r = 1"
VIEWS["rinner"] = "SELECT l.o AS fold, l.i AS \"inner\", l.variant, l.alpha, l.loss FROM rloss l JOIN rpick p ON l.o = p.o AND l.variant = p.variant AND l.k = p.k"
for _name in ("rx", "rcell", "rtotal", "rtrain", "rmoment", "rfit", "rloss", "rgrid", "rpick", "rinner"):
    VIEWS[_name] = VIEWS.pop(_name)
SMALL = {"one": ["word_length"], "two": ["word_length", "log_frequency"]}


def small_problem(spark, sf_dir):
    """Nested ridge of the held-out sample on one and two predictors, small enough for SQL to state it."""
    def build():
        rows = shared(spark, ("sample_inner", sf_dir), lambda: ranking.assign_inner_folds(reading.sample(spark, sf_dir), KEYS, OUTER))
        return rows, nested.plain_problem(rows, SMALL["two"], "mean_rt", OUTER)
    return remember(spark, ("small_ridge", sf_dir), build)


def small_tuned(spark, sf_dir):
    rows, problem = small_problem(spark, sf_dir)
    return {v: {o: nested.tune(problem, o, cs) for o in OUTER} for v, cs in SMALL.items()}


_PATH = f"""SELECT o AS fold, k::INT AS k, {q('alpha', 9)} AS alpha, {q('bx', 4)} AS word_length, {q('bz', 4)} AS log_frequency,
    {q('my + 35000 - bx * (mx + 5) - bz * (mz + 1)', 2)} AS intercept FROM rfit WHERE i = -1 AND variant = 'two'"""


@query("m12_ridge_path", _PATH)
def m12(spark, sf_dir):
    return two_paths(spark, small_problem(spark, sf_dir)[1])


def two_paths(spark, problem):
    at = problem.at(SMALL["two"])
    rows = []
    for o in OUTER:
        slopes, intercepts = problem.path(problem.refit(o), at, nested.ALPHAS)
        rows += [(o, k, float(a), *[float(v) for v in slopes[:, k]], float(intercepts[k] + problem.anchor[-1] - problem.anchor[at] @ slopes[:, k]))
                 for k, a in enumerate(nested.ALPHAS)]
    out = spark.createDataFrame(rows, "fold int, k int, alpha double, word_length double, log_frequency double, intercept double")
    return out.select("fold", "k", snap(F.col("alpha"), 9).alias("alpha"), snap(F.col("word_length"), 4).alias("word_length"),
                      snap(F.col("log_frequency"), 4).alias("log_frequency"), snap(F.col("intercept"), 2).alias("intercept"))


def factor_problem(spark, sf_dir):
    rows, _ = small_problem(spark, sf_dir)
    return rows, remember(spark, ("small_factors", sf_dir), lambda: nested.factor_problem(rows, SMALL["two"], "mean_rt", OUTER))


@query("m12_factor_path", _PATH)
def m12_factors(spark, sf_dir):
    """The same path from triangular factors, as an ill-conditioned design needs it."""
    return two_paths(spark, factor_problem(spark, sf_dir)[1])


@query("m12_case_paths")
def m12_case(spark, sf_dir):
    """The path of all core predictors of the modelling table."""
    problem = plain(spark, sf_dir)
    at = problem.at(cases.CORE)
    rows = []
    for o in OUTER:
        slopes, intercepts = nested.ridge_path(nested.subset(problem.refit(o), at), nested.ALPHAS)
        rows += [(o, float(a), [float(v) for v in slopes[:, k]], float(intercepts[k] + problem.anchor[-1] - problem.anchor[at] @ slopes[:, k]))
                 for k, a in enumerate(nested.ALPHAS)]
    return spark.createDataFrame(rows, "fold int, alpha double, slopes array<double>, intercept double")


_HELD_OUT = f"""SELECT s.item, s.zone, s.fold, {q('35000 + f.my + f.bx * (s.word_length - 5 - f.mx) + f.bz * (s.log_frequency - 1 - f.mz)', 3)} AS prediction
    FROM sample s JOIN rpick p ON p.o = s.fold AND p.variant = 'two' JOIN rfit f ON f.o = p.o AND f.i = -1 AND f.variant = p.variant AND f.k = p.k"""


@query("m13_two_predictors", _HELD_OUT)
def m13_two(spark, sf_dir):
    """Held-out predictions of the tuned ridge: each row once, from the fit of its own outer fold."""
    return two_predictions(*small_problem(spark, sf_dir))


@query("m13_factor_ridge", _HELD_OUT)
def m13_factors(spark, sf_dir):
    """The same predictions with training sets merged from triangular factors of the inner folds."""
    return two_predictions(*factor_problem(spark, sf_dir))


def two_predictions(rows, problem):
    _, models = nested.nested_ridge(problem, {"two": SMALL["two"]})
    out = nested.predict(rows, problem, models)
    return out.select(*KEYS, "fold", snap(F.col("two_prediction"), 3).alias("prediction"))


@query("m18_design_layout", " UNION ALL ".join(f"SELECT {i}::INT AS position, '{c}' AS name, {str(i == 4).lower()} AS splined, {q(f'avg({c})')} AS mean FROM sample"
    for i, c in enumerate(("word_length", "prev_word_length", "prev_log_frequency", "zone", "log_frequency"))))
def m18(spark, sf_dir):
    """Order of a design whose splined column stays last when extras are put in, with the mean of each column."""
    core = ["word_length", "prev_word_length"]
    names, plain_count = nested.design_layout(core, [*core, "log_frequency"], ["prev_log_frequency", "zone"], True)
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.lit(i >= plain_count).alias("splined"), snap(F.avg(c)).alias("mean"))
                     for i, c in enumerate(names)])
    return reading.sample(spark, sf_dir).agg(rows.alias("r")).select(F.inline("r"))


@query("m13_nested_ridge")
def m13(spark, sf_dir):
    problem = plain(spark, sf_dir)
    _, models = nested.nested_ridge(problem, {"core": cases.CORE, "all_layer_cosine": [*cases.CORE, *layer_names(cases.BLOCKS)[:cases.BLOCKS]]})
    out = nested.predict(cases.case(spark, sf_dir), problem, models)
    return out.select(*KEYS, "fold", "y", "core_prediction", "all_layer_cosine_prediction")


VIEWS["knots"] = "SELECT min(mean_rt) AS k0, quantile_cont(mean_rt, 1/3) AS k1, quantile_cont(mean_rt, 2/3) AS k2, max(mean_rt) AS k3 FROM sample"
VIEWS["knot_list"] = "SELECT [k0 - 3 * (k1 - k0), k0 - 2 * (k1 - k0), k0 - (k1 - k0), k0, k1, k2, k3, k3 + (k3 - k2), k3 + 2 * (k3 - k2), k3 + 3 * (k3 - k2)] AS t FROM knots"


def _divided(i):
    terms = []
    for j in range(i, i + 5):
        product = " * ".join(f"(t[{j + 1}] - t[{m + 1}])" for m in range(i, i + 5) if m != j)
        terms.append(f"greatest(t[{j + 1}] - mean_rt, 0) ** 3 / ({product})")
    return f"(t[{i + 5}] - t[{i + 1}]) * ({' + '.join(terms)})"


@query("m14_spline_basis", "SELECT item, zone, " + ", ".join(f"{q(_divided(i))} AS b{i + 1}" for i in range(5)) + " FROM sample, knot_list")
def m14(spark, sf_dir):
    """The oracle states the same splines as divided differences of truncated powers."""
    rows = reading.sample(spark, sf_dir).select(*KEYS, "mean_rt")
    knots = list(exact_quantiles(rows, [], "mean_rt", basis.KNOT_PROBS).first()["quantiles"])
    columns = basis.spline_columns(F.col("mean_rt"), knots)
    return rows.select(*KEYS, *[snap(c).alias(f"b{i + 1}") for i, c in enumerate(columns)])


@query("m16_piece_count_robustness")
def m16(spark, sf_dir):
    variants = {"baseline": cases.BASE, **{m: [*cases.BASE, *third_names(m)] for m in ("cosine", "relative_l2")}}
    predicted, _ = linear.cross_validate(cases.case(spark, sf_dir), variants, "y")
    return compare.full_report(predicted, "y", "baseline_prediction", {m: f"{m}_prediction" for m in ("cosine", "relative_l2")})


def grid(spark, sf_dir):
    """Every variant of the grid on one common sample: predictions and, per variant, its baseline."""
    def build():
        rows = case_columns(spark, sf_dir, ALL_PLAIN)
        baselines = {"piece": cases.BASE, "entropy": cases.CORE}
        ols = {"lexical": cases.LEXICAL, "piece": cases.BASE, "entropy": cases.CORE}
        ridge, spline = {}, {}
        for b, columns in baselines.items():
            ridge[f"{b}__ridge_controls"] = columns
            for m in ("cosine", "relative_l2"):
                ridge[f"{b}__all_layer_{m}"] = [*columns, *[f"{m}_layer_{i}" for i in range(1, cases.BLOCKS + 1)]]
                spline[f"{b}__spline_{m}"] = [*columns, *[n for c in third_names(m) for n in nested.spline_names(c)]]
                ols[f"{b}__linear_{m}"] = [*columns, *third_names(m)]
        tuned, models = nested.nested_ridge(plain(spark, sf_dir), ridge)
        tuned2, models2 = nested.nested_ridge(splined(spark, sf_dir), spline)
        predicted, _ = linear.cross_validate(rows, ols, "y")
        predicted = nested.predict(predicted, plain(spark, sf_dir), models)
        predicted = nested.predict(predicted, splined(spark, sf_dir), models2).drop(*ALL_PLAIN)
        audits = spark.createDataFrame(nested.audit_rows({**tuned, **tuned2}), nested.AUDIT_SCHEMA)
        return predicted, audits
    return remember(spark, ("grid", sf_dir), lambda: (lambda p, a: (
        shared(spark, ("grid_predictions", sf_dir), lambda: p), a))(*build()))


def grid_reports(spark, sf_dir):
    predicted, _ = grid(spark, sf_dir)
    names = [c[:-len("_prediction")] for c in predicted.columns if c.endswith("_prediction")]
    pairs = {"piece": ["entropy"], "lexical": ["piece"]}
    for n in names:
        if "__" in n:
            pairs.setdefault(n.split("__")[0], []).append(n)
            if not n.endswith("ridge_controls") and "linear" not in n:
                pairs.setdefault(f"{n.split('__')[0]}__ridge_controls", []).append(n)
    out = None
    for baseline, variants in pairs.items():
        t = compare.full_report(predicted, "y", f"{baseline}_prediction", {v: f"{v}_prediction" for v in variants}).withColumn(
            "baseline", F.lit(baseline))
        out = t if out is None else out.unionByName(t)
    return out


@query("m17_variant_grid")
def m17(spark, sf_dir):
    return grid_reports(spark, sf_dir)


@query("p21_grid_alphas")
def p21_grid(spark, sf_dir):
    """Nested fit audits flattened to one row per variant, fold and inner split."""
    _, audits = grid(spark, sf_dir)
    nested_rows = audits.groupBy("variant").agg(F.sort_array(F.collect_list(F.struct("fold", "alpha", "inner_sse"))).alias("folds"))
    flat = nested_rows.select("variant", F.inline("folds"))
    return flat.filter("alpha IS NOT NULL").select("variant", "fold", "alpha", F.posexplode("inner_sse").alias("inner", "sse"))


@query("m19_inner_tuning", f"""SELECT r.fold, r.variant, r."inner"::INT AS "inner", {q('r.alpha', 9)} AS alpha, {q('r.loss / 1e6', 3)} AS loss_millions,
    m.n::BIGINT AS n, {q('m.mx + 5', 6)} AS mean_word_length, {q('sqrt(m.vx)', 6)} AS scale_word_length, {q('g.total / 1e6', 3)} AS smallest_grid_millions
    FROM rinner r JOIN rmoment m ON m.o = r.fold AND m.i = r."inner" JOIN (SELECT o, variant, min(total) AS total FROM rgrid GROUP BY ALL) g ON g.o = r.fold AND g.variant = r.variant""")
def m19(spark, sf_dir):
    """Penalty, inner errors, and what each inner fit saw: rows, training mean and scale, and the smallest pooled error of the grid."""
    _, problem = small_problem(spark, sf_dir)
    tuned = small_tuned(spark, sf_dir)
    fits = spark.createDataFrame(nested.fit_audit(problem, tuned), nested.FIT_SCHEMA)
    errors = selection.inner_errors(spark, tuned)
    alphas = spark.createDataFrame(nested.audit_rows(tuned), nested.AUDIT_SCHEMA).select("variant", "fold", "alpha")
    return errors.join(fits, ["variant", "fold", "inner"]).join(alphas, ["variant", "fold"]).select(
        "fold", "variant", "inner", snap(F.col("alpha"), 9).alias("alpha"), snap(F.col("loss") / 1e6, 3).alias("loss_millions"), "n",
        snap(F.col("mean")[0], 6).alias("mean_word_length"), snap(F.col("scale")[0], 6).alias("scale_word_length"),
        snap(F.array_min("grid_sse") / 1e6, 3).alias("smallest_grid_millions"))


@query("m19_case_tuning")
def m19_case(spark, sf_dir):
    """Penalty and inner errors of each family, with what every fit saw: rows, means, scales and the whole error grid."""
    problem = plain(spark, sf_dir)
    tuned = {f: {o: nested.tune(problem, o, [*cases.CORE, *cs]) for o in OUTER} for f, cs in cases.FAMILIES.items()}
    fits = spark.createDataFrame(nested.fit_audit(problem, tuned), nested.FIT_SCHEMA)
    return fits.join(spark.createDataFrame(nested.audit_rows(tuned), nested.AUDIT_SCHEMA), ["variant", "fold"])


def family_losses(spark, sf_dir):
    """Inner errors of the plain controls and of each family on top of them, per outer and inner fold."""
    def build():
        problem = plain(spark, sf_dir)
        variants = {"controls": cases.CORE, **{f: [*cases.CORE, *cs] for f, cs in cases.FAMILIES.items()}}
        return selection.inner_errors(spark, {v: {o: nested.tune(problem, o, cs) for o in OUTER} for v, cs in variants.items()})
    return shared(spark, ("family_losses", sf_dir), build)


@query("p21_selected_alphas", f"""SELECT variant, fold, {q('alpha', 9)} AS alpha, "inner"::INT AS "inner", {q('loss / 1e6', 3)} AS sse_millions FROM rinner""")
def p21(spark, sf_dir):
    """Nested fit audits flattened to one row per variant, fold and inner split."""
    audits = spark.createDataFrame(nested.audit_rows(small_tuned(spark, sf_dir)), nested.AUDIT_SCHEMA)
    flat = audits.select("variant", "fold", "alpha", F.posexplode("inner_sse").alias("inner", "sse"))
    return flat.select("variant", "fold", snap(F.col("alpha"), 9).alias("alpha"), "inner", snap(F.col("sse") / 1e6, 3).alias("sse_millions"))


@query("m20_qualification", f"""SELECT a.fold, 'two' AS variant, {q('sum(a.loss) / 1e6', 3)} AS total_millions, {q('sum(b.loss) / 1e6', 3)} AS reference_millions,
    count(*) FILTER (WHERE a.loss < b.loss) AS wins, sum(a.loss) < sum(b.loss) AND count(*) FILTER (WHERE a.loss < b.loss) >= 4 AS accepted,
    sum(a.loss) < sum(b.loss) AND count(*) FILTER (WHERE a.loss < b.loss) >= 4 AS best
    FROM rinner a JOIN rinner b ON a.fold = b.fold AND a."inner" = b."inner" WHERE a.variant = 'two' AND b.variant = 'one' GROUP BY a.fold""")
def m20(spark, sf_dir):
    """The rule on the real inner errors of tuned ridge fits."""
    t = selection.qualification(selection.inner_errors(spark, small_tuned(spark, sf_dir)), "one")
    return t.select("fold", "variant", snap(F.col("total") / 1e6, 3).alias("total_millions"), snap(F.col("reference_total") / 1e6, 3).alias("reference_millions"),
                    "wins", "accepted", "best")


@query("m20_case_qualification")
def m20_case(spark, sf_dir):
    """The rule on the inner errors of all feature families; a test states it again by loops."""
    return selection.qualification(family_losses(spark, sf_dir), "controls")


STRONG = [*cases.CORE, *[n for c in third_names("cosine") for n in nested.spline_names(c)]]


def families(spark, sf_dir):
    """Core, strong, each family on strong, and the variants that inner errors choose per outer fold."""
    def build():
        problem = splined(spark, sf_dir)
        variants = {"core": cases.CORE, "strong": STRONG, **{f: [*STRONG, *cs] for f, cs in cases.FAMILIES.items()}}
        tuned, models = nested.nested_ridge(problem, variants)
        chosen = selection.choices(selection.inner_errors(spark, tuned), "strong", list(cases.FAMILIES), OUTER)
        on = lambda base, pick: {o: selection.added(base, pick(c), cases.FAMILIES) for o, c in chosen.items()}
        plan = {"best_new": (on(cases.CORE, lambda c: [c.best] if c.best else []), "core"),
                "combined_new": (on(cases.CORE, lambda c: c.accepted), "core"),
                "trajectory_combined": (on(STRONG, lambda c: c.accepted), "strong")}
        selection.composed(problem, models, tuned, {v: {o: (cs, stand_in) for o, cs in by.items()} for v, (by, stand_in) in plan.items()})
        predicted = shared(spark, ("family_predictions", sf_dir), lambda: nested.predict(
            case_columns(spark, sf_dir, problem.raw), problem, models).drop(*problem.raw))
        return tuned, models, {o: c.accepted for o, c in chosen.items()}, predicted
    return remember(spark, ("families", sf_dir), build)


def family_report(spark, sf_dir):
    _, models, _, predicted = families(spark, sf_dir)
    variants = {v: f"{v}_prediction" for v in models}
    return compare.full_report(predicted, "y", "strong_prediction", variants).join(
        compare.concentration(predicted, "y", "strong_prediction", variants), "variant")


@query("m21_family_evaluation")
def m21(spark, sf_dir):
    return family_report(spark, sf_dir)


def component_fit(spark, sf_dir):
    return remember(spark, ("components", sf_dir), lambda: representation.fold_components(
        cases.case(spark, sf_dir), cases.LAYERS, OUTER, cases.COUNT))


VIEWS["pcov"] = "SELECT o, i, mx + 5 AS mx, mz + 1 AS mz, vx * n / (n - 1) AS a, vz * n / (n - 1) AS b, cxz * n / (n - 1) AS c FROM rmoment"
VIEWS["peig"] = """SELECT o, i, mx, mz, t.component, t.l AS variance, c / sqrt(c * c + (t.l - a) ** 2) AS u, (t.l - a) / sqrt(c * c + (t.l - a) ** 2) AS w
    FROM (SELECT *, sqrt(((a - b) / 2) ** 2 + c * c) AS h FROM pcov), LATERAL (VALUES (0, (a + b) / 2 + h), (1, (a + b) / 2 - h)) t(component, l)"""
VIEWS["pload"] = "SELECT * REPLACE (u * sign(CASE WHEN abs(u) >= abs(w) THEN u ELSE w END) AS u, w * sign(CASE WHEN abs(u) >= abs(w) THEN u ELSE w END) AS w) FROM peig"
for _name in ("pcov", "peig", "pload"):
    VIEWS[_name] = VIEWS.pop(_name)


def small_components(spark, sf_dir, count):
    rows, _ = small_problem(spark, sf_dir)
    return remember(spark, ("small_components", sf_dir, count), lambda: representation.fold_components(rows, [SMALL["two"]], OUTER, count))


@query("m22_two_dimensions", f"""SELECT o AS fold, i::INT AS "inner", component::INT AS component, {q('variance', 6)} AS variance, {q('u', 5)} AS loading_x, {q('w', 5)} AS loading_z,
    {q('mx', 6)} AS mean_x, {q('mz', 6)} AS mean_z FROM pload""")
def m22_two(spark, sf_dir):
    """Components of two columns under every training set; the oracle solves the 2 x 2 eigenproblem in closed form."""
    rows = [(o, -1 if i is None else i, k, float(parts[0].variance[k]), float(parts[0].loadings[0, k]), float(parts[0].loadings[1, k]), *map(float, parts[0].mean))
            for (o, i), parts in small_components(spark, sf_dir, 2).items() for k in (0, 1)]
    names = {"variance": 6, "loading_x": 5, "loading_z": 5, "mean_x": 6, "mean_z": 6}
    out = spark.createDataFrame(rows, "fold int, inner int, component int, " + ", ".join(f"{n} double" for n in names))
    return out.select("fold", "inner", "component", *[snap(F.col(n), d).alias(n) for n, d in names.items()])


@query("m23_two_dimensions", f"""SELECT item, zone, fold, {q('s', 5)} AS score, {q('sqrt((x * x + z * z) / 2)', 5)} AS distance, {q('sqrt(s * s / (variance + 0.1 * variance))', 5)} AS radius,
    {q('sqrt(greatest(x * x + z * z - s * s, 0) / 2)', 4)} AS residual FROM (SELECT item, zone, fold, variance, word_length - mx AS x, log_frequency - mz AS z,
        (word_length - mx) * u + (log_frequency - mz) * w AS s FROM sample JOIN pload ON o = fold AND i = -1 AND component = 0)""")
def m23_two(spark, sf_dir):
    """Held-out score and typicality under one component of two columns."""
    rows, _ = small_problem(spark, sf_dir)
    names, expand = representation.expansion(SMALL["two"], [], [SMALL["two"]], small_components(spark, sf_dir, 1), 1)
    problem = nested.FittedProblem(names, None, OUTER, {}, SMALL["two"], expand)
    models = {n: {o: dict(slope=[1.0], intercept=0.0, columns=[n]) for o in OUTER} for n in names}
    out = nested.predict(rows.select(*KEYS, "fold", *[F.col(c).cast("double").alias(c) for c in SMALL["two"]]), problem, models, suffix="")
    labels = dict(zip(names, ("score", "distance", "radius", "residual")))
    return out.select(*KEYS, "fold", *[snap(F.col(n), 4 if label == "residual" else 5).alias(label) for n, label in labels.items()])


@query("m22_fold_components")
def m22(spark, sf_dir):
    rows = [(o, -1 if i is None else i, l, k, float(p.variance[k]), [float(v) for v in p.loadings[:, k]], [float(v) for v in p.mean])
            for (o, i), parts in component_fit(spark, sf_dir).items() for l, p in enumerate(parts) for k in range(cases.COUNT)]
    return spark.createDataFrame(rows, "fold int, inner int, layer int, component int, variance double, loadings array<double>, mean array<double>")


def wide_fit(spark, sf_dir):
    def build():
        vectors = tables.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        rows = cut(ranking.assign_inner_folds(ranking.assign_folds(vectors, ["vec_id"]), ["vec_id"], OUTER))
        return rows, representation.wide_components(rows, "v", OUTER, 16)
    return remember(spark, ("wide_components", sf_dir), build)


@query("m22_wide_components")
def m22_wide(spark, sf_dir):
    """16 components of 64 columns under all 60 training sets; no matrix of columns by columns is made."""
    _, fitted = wide_fit(spark, sf_dir)
    rows = [(o, -1 if i is None else i, k, float(p.variance[k]), [float(v) for v in p.loadings[:, k]], [float(v) for v in p.mean])
            for (o, i), p in fitted.items() for k in range(len(p.variance))]
    return spark.createDataFrame(rows, "fold int, inner int, component int, variance double, loadings array<double>, mean array<double>")


VIEWS["vector_folds"] = """SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, (ntile(10) OVER (ORDER BY md5('2026:' || vec_id)) - 1)::INT AS fold FROM embeddings"""


@query("m22_wide_means", f"""SELECT o.f AS fold, count(*) AS n, {q('avg(list_sum(v) / 64)', 6)} AS mean,
    {q('sum(list_dot_product(v, v)) / count(*)', 6)} AS second_moment FROM vector_folds s JOIN (SELECT unnest(range(0, 10))::INT AS f) o ON s.fold <> o.f GROUP BY o.f""")
def m22_means(spark, sf_dir):
    """What the components of each outer training set are centred on, with its mean squared length about zero."""
    rows, fitted = wide_fit(spark, sf_dir)
    sizes = {r["fold"]: (r["n"], r["s"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x * x)).alias("s")).collect()}
    total, squares = sum(n for n, _ in sizes.values()), sum(s for _, s in sizes.values())
    table = [(o, total - sizes[o][0], float(fitted[o, None].mean.mean()), (squares - sizes[o][1]) / (total - sizes[o][0])) for o in OUTER]
    out = spark.createDataFrame(table, "fold int, n bigint, mean double, second_moment double")
    return out.select("fold", "n", snap(F.col("mean"), 6).alias("mean"), snap(F.col("second_moment"), 6).alias("second_moment"))


@query("m23_typicality")
def m23(spark, sf_dir):
    """Held-out component scores and typicality: each row under the transform of its own outer fold."""
    raw = [c for cs in cases.LAYERS for c in cs]
    names, expand = representation.expansion(raw, [], cases.LAYERS, component_fit(spark, sf_dir), cases.COUNT)
    problem = nested.FittedProblem(names, None, OUTER, {}, raw, expand)
    models = {n: {o: dict(slope=[1.0], intercept=0.0, columns=[n]) for o in OUTER} for n in names}
    out = nested.predict(cases.case(spark, sf_dir).select(*KEYS, "fold", *raw), problem, models, suffix="")
    return out.drop(*raw)


def representation_run(spark, sf_dir):
    def build():
        rows = cases.case(spark, sf_dir)
        trajectory = third_names("cosine")
        baseline = [*cases.CORE, *cases.HISTORY]
        nuisance = [c for c in cases.NUISANCE if c not in baseline]
        prob = representation.problem(rows, [*baseline, *nuisance], trajectory, cases.REPRESENTATION, cases.LAYERS, "y", OUTER, cases.COUNT, True)
        fams = representation.family_columns(cases.REPRESENTATION, len(cases.DEPTHS), cases.COUNT)
        tuned, models = representation.tuned_variants(prob, baseline, trajectory, fams, True)
        errors = selection.inner_errors(spark, tuned)
        combined = representation.selected(prob, errors, tuned, models, baseline, fams)
        _, fixed = representation.with_given_families(prob, [*baseline, *nuisance], trajectory, fams, combined, True)
        both = {**models, **{f"fixed_{v}": m for v, m in fixed.items()}}
        predicted = shared(spark, ("representation_predictions", sf_dir), lambda: nested.predict(
            rows.select(*KEYS, "word", "fold", "y", *prob.raw), prob, both).drop(*prob.raw))
        return tuned, list(models), [f"fixed_{v}" for v in fixed], errors, predicted
    return remember(spark, ("representation", sf_dir), build)


def representation_report(spark, sf_dir, fixed):
    _, names, fixed_names, errors, predicted = representation_run(spark, sf_dir)
    variants = fixed_names if fixed else names
    baseline = "fixed_baseline_prediction" if fixed else "baseline_prediction"
    report = compare.full_report(predicted, "y", baseline, {v: f"{v}_prediction" for v in variants})
    if fixed:
        return report
    counts = selection.qualification(errors, "baseline").groupBy("variant").agg(F.count_if("accepted").cast("int").alias("qualified_folds"))
    return report.join(counts, "variant", "left").fillna(0, ["qualified_folds"])


@query("m24_representation_evaluation")
def m24(spark, sf_dir):
    return representation_report(spark, sf_dir, False)


@query("m25_fixed_evaluation")
def m25(spark, sf_dir):
    return representation_report(spark, sf_dir, True)


def lag2_predictions(spark, sf_dir):
    def build():
        problem = splined(spark, sf_dir)
        _, _, accepted, _ = families(spark, sf_dir)
        lexical = [*STRONG, *cases.LAG2_LEXICAL]
        variants = {"lag2_baseline": {o: lexical for o in OUTER}, "lag2_spillover": {o: [*lexical, *cases.LAG2_SCORES] for o in OUTER},
                    "lag2_combined": {o: [*lexical, *[c for f in fs for c in cases.FAMILIES[f]]] for o, fs in accepted.items()}}
        models = {v: {o: nested.refit(problem, o, cs, nested.tune(problem, o, cs)["alpha"]) for o, cs in by.items()} for v, by in variants.items()}
        return nested.predict(case_columns(spark, sf_dir, problem.raw), problem, models).drop(*problem.raw)
    return shared(spark, ("lag2_predictions", sf_dir), build)


@query("m26_lag2_sensitivity")
def m26(spark, sf_dir):
    return compare.full_report(lag2_predictions(spark, sf_dir), "y", "lag2_baseline_prediction",
                               {v: f"{v}_prediction" for v in ("lag2_spillover", "lag2_combined")})


@query("m27_registry")
def m27(spark, sf_dir):
    """All comparisons of all phases, wins and losses alike."""
    phases = {"grid": grid_reports(spark, sf_dir), "families": family_report(spark, sf_dir),
              "representation": representation_report(spark, sf_dir, False), "fixed": representation_report(spark, sf_dir, True),
              "lag2": m26(spark, sf_dir)}
    out = None
    for phase, t in phases.items():
        t = t.withColumn("phase", F.lit(phase))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


_HISTORY = {"lag2_word_length": "length(c.word)", "lag2_log_frequency": "ln(1 + f.frequency_count)", "lag2_n_bpe": "c.n_bpe",
            "lag2_frequency_available": "(f.frequency_count IS NOT NULL)::INT", "lag2_surprisal": "CASE WHEN coalesce(isnan(c.surprisal), true) THEN 0 ELSE c.surprisal END",
            "lag2_entropy_bits": "CASE WHEN coalesce(isnan(c.entropy_bits), true) THEN 0 ELSE c.entropy_bits END",
            "lag2_available": "(NOT coalesce(isnan(c.surprisal), true))::INT"}


@query("m28_history_matrix", "SELECT a.item, a.zone, length(a.word)::DOUBLE AS word_length, " + ", ".join(
    f"{q(f'coalesce({e}, 0)') if n in ('lag2_log_frequency', 'lag2_surprisal', 'lag2_entropy_bits') else f'({e})::DOUBLE'} AS {n}" for n, e in _HISTORY.items()) + """
    FROM scores a LEFT JOIN scores c ON a.item = c.item AND a.zone = c.zone + 2 LEFT JOIN analysis f ON f.item = c.item AND f.zone = c.zone""")
def m28(spark, sf_dir):
    """History columns of every region, zero with a flag where there is no region two back."""
    rows = cases.history(spark, sf_dir)
    return rows.select(*KEYS, F.col("word_length").cast("double").alias("word_length"), *[
        snap(F.col(c)).alias(c) if c in ("lag2_log_frequency", "lag2_surprisal", "lag2_entropy_bits") else F.col(c).cast("double").alias(c) for c in _HISTORY])


# The same held-out regression over every region of the corpus: surprisal on word length and log frequency.
VIEWS["corpus"] = """SELECT l.item, l.zone, (ntile(10) OVER (ORDER BY md5('2026:' || l.item || ':' || l.zone)) - 1)::INT AS fold, length(l.word)::DOUBLE AS x, ln(1 + q.count) AS z, -log2(b.p) - 12 AS y FROM word_lag l
    JOIN bigram_ranked b USING (prev_word, word) JOIN freq q ON q.form = l.word"""
VIEWS["corpus_fold"] = """SELECT fold, count(*) AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz,
    sum(x * y) AS xy, sum(z * y) AS zy FROM corpus GROUP BY fold"""
VIEWS["corpus_train"] = """SELECT f.fold, t.n - f.n AS n, (t.x - f.x) / (t.n - f.n) AS mx, (t.z - f.z) / (t.n - f.n) AS mz, (t.y - f.y) / (t.n - f.n) AS my,
    (t.xx - f.xx) / (t.n - f.n) AS xx, (t.zz - f.zz) / (t.n - f.n) AS zz, (t.xz - f.xz) / (t.n - f.n) AS xz, (t.xy - f.xy) / (t.n - f.n) AS xy,
    (t.zy - f.zy) / (t.n - f.n) AS zy FROM corpus_fold f, (SELECT sum(n) n, sum(x) x, sum(z) z, sum(y) y, sum(xx) xx, sum(zz) zz, sum(xz) xz,
    sum(xy) xy, sum(zy) zy FROM corpus_fold) t"""
VIEWS["corpus_coef"] = """SELECT fold, mx, mz, my, ((xy - mx * my) * (zz - mz * mz) - (zy - mz * my) * (xz - mx * mz)) / d AS bx,
    ((zy - mz * my) * (xx - mx * mx) - (xy - mx * my) * (xz - mx * mz)) / d AS bz FROM (SELECT *, (xx - mx * mx) * (zz - mz * mz) - (xz - mx * mz) ** 2 AS d FROM corpus_train)"""


LEXICAL = ["word_length", "log_frequency"]


def corpus(spark, sf_dir):
    """The corpus by bigrams: tables of its words and of the sizes of its contexts, exact bounds of the outer folds, an anchor near the means.

    Both predictors and the outcome of a region follow from its bigram, so a fold is known by how often it holds each bigram.
    """
    def build():
        contexts = tables.contexts(spark, sf_dir)
        words = cut(ngram.word_counts(contexts))
        sizes = cut(contexts.select("item", F.size("word").alias("n")).repartition(2 * spark.sparkContext.defaultParallelism, "item"))    # light rows, heavy hashing
        times = F.sum("count")
        n, *anchor = words.agg(F.coalesce(F.sum("follows"), F.lit(0)), F.sum(F.col("count") * F.length("word")) / times, F.sum(F.col("count") * F.log1p("count")) / times,
                               F.sum(F.col("follows") * F.log2(F.col("follows") + 0.5 * F.lit(words.count()))) / F.sum("follows")).first()
        outer, = positions.exact_cuts(sizes, [2026], len(OUTER), [n])
        return contexts, words, sizes, outer, n, np.array(anchor, float)
    return remember(spark, ("corpus", sf_dir), build)


def corpus_bigrams(spark, sf_dir):
    """``prev_word, word, c`` and how many of them each outer fold holds: c0, c1, ..."""
    contexts, _, _, outer, *_ = corpus(spark, sf_dir)
    counts = shared(spark, ("corpus_bigrams", sf_dir), lambda: positions.dealt_pairs(contexts, outer).groupBy("prev_word", "word").agg(
        F.count("*").alias("c"), *[F.count_if(F.col("fold") == f).alias(f"c{f}") for f in OUTER]))
    return counts


def held_out(moments, anchor, model):
    """Rows, sum of squared errors and of squared distances from the mean of the rows behind ``moments``, for a model of raw columns."""
    slope = np.asarray(model["slope"], float)
    n, _, spread = centered(moments)
    error = nested.squared_error(moments, slope[:, None], np.array([model["intercept"] + slope @ anchor[:-1] - anchor[-1]]))
    return int(round(n)), float(error[0]), float(spread[-1, -1])


@query("m02_corpus_ols", f"""SELECT c.fold, count(*) AS n, {q('sqrt(avg((y - (my + bx * (x - mx) + bz * (z - mz))) ** 2))', 5)} AS rmse,
    {q('1 - sum((y - (my + bx * (x - mx) + bz * (z - mz))) ** 2) / (count(*) * var_pop(y))', 5)} AS r2 FROM corpus c JOIN corpus_coef k ON c.fold = k.fold GROUP BY c.fold""")
def m02_corpus(spark, sf_dir):
    """Held-out OLS over all regions: one pass over counted bigrams gives the moments of every fold, and these the errors."""
    _, words, _, _, _, anchor = corpus(spark, sf_dir)
    counts = corpus_bigrams(spark, sf_dir)
    scored = ngram.bigram_scores(counts, words).withColumn("_all", F.lit(0))
    parts = cell_moments(scored, [*LEXICAL, "surprisal", *[f"c{f}" for f in OUTER]], by_weights(anchor, [str(f) for f in OUTER]), "_all")
    cells = {f: m.reshape(len(anchor) + 1, -1) for f, m in parts.items()}
    fits = linear.fold_fits(cells, anchor, list(range(len(LEXICAL))))
    rows = [(int(f), *held_out(m, anchor, fits[int(f)])) for f, m in cells.items()]
    out = spark.createDataFrame(rows, "fold int, n bigint, sse double, sst double")
    return out.select("fold", "n", snap(F.sqrt(F.col("sse") / F.col("n")), 5).alias("rmse"), snap(1 - ratio(F.col("sse"), F.col("sst")), 5).alias("r2"))


VIEWS["cinner"] = """SELECT c.item, c.zone, c.x, c.z, c.y, o.outer_fold AS o, ntile(5) OVER (PARTITION BY o.outer_fold ORDER BY md5((2026 + o.outer_fold) || ':' || c.item || ':' || c.zone)) - 1 AS i
    FROM corpus c JOIN (SELECT unnest(range(0, 10))::INT AS outer_fold) o ON c.fold <> o.outer_fold"""
VIEWS["crx"] = "SELECT item, zone, o, i, x, z, y FROM cinner"
for _name in ("rcell", "rtotal", "rtrain", "rmoment", "rfit", "rloss", "rgrid", "rpick"):
    VIEWS[f"c{_name}"] = re.sub(r"\br(x|cell|total|train|moment|fit|loss|grid|pick)\b", r"cr\1", VIEWS[_name])


@query("m13_corpus_ridge", f"""SELECT c.fold, count(*) AS n, {q('sqrt(avg((c.y - (f.my + f.bx * (c.x - f.mx) + f.bz * (c.z - f.mz))) ** 2))', 5)} AS rmse, {q('max(p.alpha)', 9)} AS alpha
    FROM corpus c JOIN crpick p ON p.o = c.fold AND p.variant = 'two' JOIN crfit f ON f.o = p.o AND f.i = -1 AND f.variant = 'two' AND f.k = p.k GROUP BY c.fold""")
def m13_corpus(spark, sf_dir):
    """Nested ridge over all regions: 50 cells of moments and 10 held-out ones from one pass serve 25 penalties in 60 training sets."""
    contexts, words, sizes, outer, n, anchor = corpus(spark, sf_dir)
    starts = [0, *ranking.fold_starts(n, len(OUTER)), n]
    inner = remember(spark, ("corpus_inner", sf_dir), lambda: positions.exact_cuts(
        sizes, [2026 + o for o in OUTER], nested.INNER, [n - starts[o + 1] + starts[o] for o in OUTER], outer))
    pairs = positions.dealt_pairs(contexts, outer, inner)
    scored = ngram.bigram_scores(corpus_bigrams(spark, sf_dir).select("prev_word", "word", "c"), words)
    rows = pairs.join(scored.drop("c"), ["prev_word", "word"])
    split, apart = by_inner_fold(anchor, OUTER), by_fold(anchor)

    def emit(x, folds, _):
        yield from split(x[:, :-1], folds, positions.unpacked(x[:, -1], len(OUTER), nested.INNER))
        for f, z in apart(x[:, :-1], folds, None):
            yield f"held:{f}", z

    cells = cell_moments(rows, [*LEXICAL, "surprisal", "inner"], emit)
    tuned, models = nested.nested_ridge(nested.AdditiveProblem(LEXICAL, anchor, OUTER, cells), {"ridge": LEXICAL})
    found = [(o, *held_out(cells[f"held:{o}"], anchor, models["ridge"][o])[:2], t["alpha"]) for o, t in tuned["ridge"].items()]
    out = spark.createDataFrame(found, "fold int, n bigint, sse double, alpha double")
    return out.select("fold", "n", snap(F.sqrt(F.col("sse") / F.col("n")), 5).alias("rmse"), snap(F.col("alpha"), 9).alias("alpha"))
