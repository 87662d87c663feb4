"""Aggregations and comparison tables (A*, P17-P18, M4, M6-M8, M11, M15)."""
from pyspark.sql import functions as F

from wordframe.catalog.contracts import VIEWS, both_predictions, joined
from wordframe.catalog.registry import q, query
from wordframe.cluster import cut
from wordframe.functions import text
from wordframe.functions.basis import KNOT_PROBS
from wordframe.functions.numeric import ratio, snap
from wordframe.operators import ordered
from wordframe.operators.bitmaps import distinct_counts
from wordframe.operators.ranking import assign_inner_folds, exact_quantiles
from wordframe.operators.selection import nested_sets, selected
from wordframe.plans import compare, correlation, linear, reading
from wordframe.sources import tables

KEYS = ["item", "zone"]
FOLDS = list(range(10))
TWO = {"controls": "controls_prediction", "full": "full_prediction"}


@query("a01_region_means", f"SELECT item, zone, count(*) AS n, {q('avg(rt)')} AS mean_rt, {q('avg(rt2)')} AS mean_rt2 FROM obs GROUP BY item, zone")
def a01(spark, sf_dir):
    out = reading.region_means(tables.raw_observations(spark, sf_dir), {"mean_rt": "rt", "mean_rt2": "rt2"})
    return out.select(*KEYS, F.col("n_observations").alias("n"), snap(F.col("mean_rt")).alias("mean_rt"), snap(F.col("mean_rt2")).alias("mean_rt2"))


_G = "CASE WHEN try_cast(gaze_cell AS DOUBLE) > 0 THEN try_cast(gaze_cell AS DOUBLE) END"
_T = "CASE WHEN try_cast(total_cell AS DOUBLE) > 0 THEN try_cast(total_cell AS DOUBLE) END"


@query("a02_conditional_means", f"""SELECT word_id, count(*) AS n, count({_G}) AS n_gaze, count({_T}) AS n_total, {q('avg(' + _G + ')')} AS mean_gaze,
    {q('avg(' + _T + ')')} AS mean_total, {q(f'count({_G}) / count(*)', 6)} AS proportion_valid, {q('avg(word_skip)', 6)} AS skip_proportion FROM sheet GROUP BY word_id""")
def a02(spark, sf_dir):
    gaze, total = text.valid_duration(F.col("gaze_cell")), text.valid_duration(F.col("total_cell"))
    return tables.sheet(spark, sf_dir).groupBy("word_id").agg(
        F.count("*").alias("n"), F.count(gaze).alias("n_gaze"), F.count(total).alias("n_total"),
        snap(F.avg(gaze)).alias("mean_gaze"), snap(F.avg(total)).alias("mean_total"),
        snap(ratio(F.count(gaze), F.count("*")), 6).alias("proportion_valid"), snap(F.avg("word_skip"), 6).alias("skip_proportion"))


@query("a03_global_counters", f"""SELECT count(*) AS participant_rows, count(DISTINCT pp_nr) AS participants, count(DISTINCT word_id) AS unique_regions,
    count(DISTINCT (part, trial)) AS contexts, count(*) FILTER (WHERE word_skip = 1) AS skipped, count(*) FILTER (WHERE gaze_cell IN ('.', '')) AS gaze_missing,
    count({_G}) AS gaze_valid, count(*) FILTER (WHERE gaze_cell NOT IN ('.', '') AND {_G} IS NULL) AS gaze_invalid,
    count(*) FILTER (WHERE word_skip = 1 AND {_T} IS NOT NULL) AS total_valid_and_skip FROM sheet""")
def a03(spark, sf_dir):
    status = text.duration_status(F.col("gaze_cell"))
    total = text.duration_status(F.col("total_cell"))
    skipped = F.col("word_skip") == 1
    return distinct_counts(
        tables.sheet(spark, sf_dir),
        {"participants": F.col("pp_nr"), "unique_regions": F.col("word_id"), "contexts": F.shiftleft(F.col("part").cast("bigint"), 32) + F.col("trial")},
        {"participant_rows": F.lit(True), "skipped": skipped, "gaze_missing": status == "missing", "gaze_valid": status == "valid",
         "gaze_invalid": status == "invalid", "total_valid_and_skip": skipped & (total == "valid")})


@query("a04_position_gaps", """SELECT item, prev + 1 AS missing_from, zone - 1 AS missing_to FROM (SELECT item, zone, lag(zone) OVER (PARTITION BY item ORDER BY zone) AS prev
    FROM (SELECT DISTINCT item, zone FROM positions)) WHERE zone > prev + 1""")
def a04(spark, sf_dir):
    """Missing positions as ranges: the report stays small however long a gap or a context is."""
    from wordframe.catalog.contracts import positions
    return ordered.position_gaps(positions(spark, sf_dir).select("item", "zone").distinct())


@query("a08_validation_report", """SELECT count(*) AS rows, count(*) FILTER (WHERE count IS NULL) AS frequency_unavailable, count(*) FILTER (WHERE n_bpe > 1) AS multi_piece
    FROM piece_counts LEFT JOIN lookup ON form = """ + "trim(word, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~“”‘’…')")
def a08(spark, sf_dir):
    from wordframe.catalog.contracts import lookup
    from wordframe.operators import joins, spans
    rows = joins.frequency_by_form(tables.regions(spark, sf_dir), lookup(spark, sf_dir))
    return rows.withColumn("n_bpe", spans.piece_counts(rows)).agg(
        F.count("*").alias("rows"), F.count_if(F.col("frequency_count").isNull()).alias("frequency_unavailable"),
        F.count_if(F.col("n_bpe") > 1).alias("multi_piece"))


_GRAM = [("x", "word_length"), ("z", "log_frequency"), ("y", "mean_rt")]


@query("a09_gram_cells", "SELECT fold, count(*) AS n, " + ", ".join(f"{q(f'sum({c}::DOUBLE)', 2)} AS s{a}" for a, c in _GRAM) + ", " + ", ".join(
    f"{q(f'sum({_GRAM[i][1]}::DOUBLE * {_GRAM[j][1]})', 1)} AS s{_GRAM[i][0]}{_GRAM[j][0]}" for i in range(3) for j in range(i, 3)) + " FROM sample GROUP BY fold")
def a09(spark, sf_dir):
    """Moments of a small design as plain sums: two hash aggregates, combined map-side."""
    c = {a: F.col(n).cast("double") for a, n in _GRAM}
    return reading.sample(spark, sf_dir).groupBy("fold").agg(
        F.count("*").alias("n"), *[snap(F.sum(c[a]), 2).alias(f"s{a}") for a, _ in _GRAM],
        *[snap(F.sum(c[_GRAM[i][0]] * c[_GRAM[j][0]]), 1).alias(f"s{_GRAM[i][0]}{_GRAM[j][0]}") for i in range(3) for j in range(i, 3)])




def _metric_sql(p):
    return (f"{q(f'sqrt(avg((y - {p}) ** 2))')} AS rmse, {q(f'1 - sum((y - {p}) ** 2) / (count(*) * var_pop(y))', 6)} AS r2")


@query("a10_rmse_r2", f"SELECT count(*) AS n, {_metric_sql('full_prediction')} FROM heldout")
def a10(spark, sf_dir):
    rmse, r2 = linear.metrics(F.col("mean_rt"), F.col("full_prediction"))
    return both_predictions(spark, sf_dir).agg(F.count("*").alias("n"), snap(rmse).alias("rmse"), snap(r2, 6).alias("r2"))


@query("m04_metric_table", f"SELECT 'controls' AS variant, count(*) AS n, {_metric_sql('controls_prediction')} FROM heldout UNION ALL SELECT 'full', count(*), {_metric_sql('full_prediction')} FROM heldout")
def m04(spark, sf_dir):
    t = linear.metric_table(both_predictions(spark, sf_dir), "mean_rt", TWO)
    return t.select("variant", "n", snap(F.col("rmse")).alias("rmse"), snap(F.col("r2"), 6).alias("r2"))


_R = "(y - full_prediction)"


@query("a11_residual_profile", f"""SELECT count({_R}) AS n, count(*) - count({_R}) AS undefined, {q(f'avg({_R})')} AS mean, {q(f'stddev_samp({_R})')} AS sd, {q(f'min({_R})')} AS minimum, {q(f'max({_R})')} AS maximum,
    {q('corr(y, full_prediction)', 6)} AS correlation, {q(f'quantile_cont({_R}, 0.5)')} AS median, {q(f'quantile_cont({_R}, 0.05)')} AS p05, {q(f'quantile_cont({_R}, 0.95)')} AS p95 FROM heldout""")
def a11(spark, sf_dir):
    p = compare.residual_profile(both_predictions(spark, sf_dir), "mean_rt", "full_prediction")
    return p.select("n", "undefined", *[snap(F.col(c), 6 if c == "correlation" else 4).alias(c) for c in p.columns if c not in ("n", "undefined")])


_STAB = "sqrt(avg((y - controls_prediction) ** 2)) AS b, sqrt(avg((y - full_prediction) ** 2)) AS a, count(*) AS n FROM heldout GROUP BY"
VIEWS["stab"] = f"SELECT 'fold' AS kind, fold::BIGINT AS \"group\", {_STAB} fold UNION ALL SELECT 'context', item, {_STAB} item"


def stability(spark, sf_dir):
    return compare.stability(both_predictions(spark, sf_dir), "mean_rt", "controls_prediction", {"full": "full_prediction"})


@query("a12_stability", f"SELECT kind, \"group\", 'full' AS variant, n, {q('b')} AS baseline_rmse, {q('a')} AS augmented_rmse, {q('b - a')} AS gain, a < b AS win FROM stab")
def a12(spark, sf_dir):
    t = stability(spark, sf_dir)
    return t.select("kind", "group", "variant", "n", *[snap(F.col(c)).alias(c) for c in ("baseline_rmse", "augmented_rmse", "gain")], "win")


@query("a13_wins", f"SELECT 'full' AS variant, kind, count(*) FILTER (WHERE a < b) AS wins, {q('count(*) FILTER (WHERE a < b) / count(*)', 6)} AS win_fraction FROM stab GROUP BY kind")
def a13(spark, sf_dir):
    return compare.wins(stability(spark, sf_dir)).withColumn("win_fraction", snap(F.col("win_fraction"), 6))


_FEATURES = ["word_length", "log_frequency", "mean_rt"]


@query("a14_training_diagnostics", " UNION ALL ".join(
    f"""SELECT o.f AS fold, '{c}' AS feature, count(*) AS n, {q(f'avg({c})')} AS mean, {q(f'stddev_pop({c})')} AS sd, {q(f'min({c})')} AS minimum, {q(f'max({c})')} AS maximum,
    {q(f'quantile_cont({c}::DOUBLE, 0.05)')} AS p05, {q(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median, {q(f'quantile_cont({c}::DOUBLE, 0.95)')} AS p95
    FROM sample s JOIN (SELECT unnest(range(0, 10))::INT AS f) o ON s.fold <> o.f GROUP BY o.f""" for c in _FEATURES))
def a14(spark, sf_dir):
    t = compare.training_diagnostics(reading.sample(spark, sf_dir), _FEATURES, FOLDS, [0.05, 0.5, 0.95])
    return t.select("fold", "feature", "n", *[snap(F.col(c)).alias(c) for c in ("mean", "sd", "minimum", "maximum")],
                    *[snap(F.col("quantiles")[i]).alias(n) for i, n in enumerate(("p05", "median", "p95"))])


_PRICE = "l_extendedprice * (1 - l_discount)"


@query("a11_order_statistics", f"""SELECT r::BIGINT AS rank, v[r + 1] AS value FROM (SELECT list(v ORDER BY v) AS v, count(*) AS n FROM (SELECT {_PRICE} AS v FROM lineitem)),
    LATERAL (SELECT unnest([0, 1, n // 3, n // 2, n - 2, n - 1]) AS r)""")
def a11_ranks(spark, sf_dir):
    """Net prices at given ranks, found digit by digit without ordering the rows."""
    rows = tables.table(spark, sf_dir, "lineitem").select(F.expr(_PRICE).alias("v"))
    n = rows.count()
    ranks = [0, 1, n // 3, n // 2, n - 2, n - 1]
    _, values = selected(rows, ["v"], ranks=ranks)[None, "v"]
    return spark.createDataFrame(list(zip(ranks, values)), "rank bigint, value double")


_KNOTS = ", ".join(f"{q(f'quantile_cont(x, {p})')} AS k{i}" for i, p in enumerate(KNOT_PROBS))
VIEWS["nested_sets"] = """SELECT a.item, a.zone, a.outer_fold, i.inner_fold FROM inner_folds a, (SELECT unnest(range(-1, 5))::INT AS inner_fold) i
    WHERE a.inner_fold <> i.inner_fold"""


@query("m14_training_knots", " UNION ALL ".join(f"""SELECT t.outer_fold, t.inner_fold, '{c}' AS feature, count(*) AS n, {_KNOTS}
    FROM nested_sets t JOIN (SELECT item, zone, {c}::DOUBLE AS x FROM sample) s USING (item, zone) GROUP BY t.outer_fold, t.inner_fold""" for c in _FEATURES))
def m14_knots(spark, sf_dir):
    """Spline knots of each feature under all 60 training sets (inner fold -1: the refit), from one set of counts."""
    rows = cut(assign_inner_folds(reading.sample(spark, sf_dir), KEYS, FOLDS))
    found = selected(rows, _FEATURES, KNOT_PROBS, **nested_sets(FOLDS, 5))
    table = [(o, -1 if i is None else i, c, n, *values) for ((o, i), c), (n, values) in found.items()]
    out = spark.createDataFrame(table, "outer_fold int, inner_fold int, feature string, n bigint, " + ", ".join(f"k{i} double" for i in range(len(KNOT_PROBS))))
    return out.select("outer_fold", "inner_fold", "feature", "n", *[snap(F.col(f"k{i}")).alias(f"k{i}") for i in range(len(KNOT_PROBS))])


VIEWS["train_corr"] = """SELECT o.f AS fold, abs(corr(log_frequency, word_length)) AS fw, abs(corr(prev_log_frequency, word_length)) AS pw, abs(corr(log_frequency, prev_log_frequency)) AS fp,
    abs(corr(log_frequency, prev_word_length)) AS fl, abs(corr(prev_log_frequency, prev_word_length)) AS pl
    FROM sample s JOIN (SELECT unnest(range(0, 10))::INT AS f) o ON s.fold <> o.f GROUP BY o.f"""
_CORR = f"""SELECT fold, 'frequency' AS family, 'log_frequency' AS feature, {q('greatest(fw, fl)', 6)} AS max_control, {q('fp', 6)} AS max_within FROM train_corr
    UNION ALL SELECT fold, 'frequency', 'prev_log_frequency', {q('greatest(pw, pl)', 6)}, {q('fp', 6)} FROM train_corr"""


def train_correlations(spark, sf_dir):
    names = ["word_length", "prev_word_length", "log_frequency", "prev_log_frequency"]
    _, moments = linear.fold_moments(reading.sample(spark, sf_dir), names, "mean_rt")
    rows = compare.training_correlations(moments, [*names, "mean_rt"], names[:2], {"frequency": names[2:]})
    return spark.createDataFrame(rows, "fold int, family string, feature string, max_control double, max_within double")


@query("a15_max_correlation", _CORR)
def a15(spark, sf_dir):
    t = train_correlations(spark, sf_dir)
    return t.select("fold", "family", "feature", snap(F.col("max_control"), 6).alias("max_control"), snap(F.col("max_within"), 6).alias("max_within"))


@query("a16_concentration", f"""SELECT 'full' AS variant, {q('sum(g)', 0)} AS net_gain, {q('sum(g) FILTER (WHERE r <= k) / sum(g)')} AS top_share FROM (
    SELECT (y - controls_prediction) ** 2 - (y - full_prediction) ** 2 AS g, row_number() OVER (ORDER BY (y - controls_prediction) ** 2 DESC) AS r,
    ceil(0.01 * count(*) OVER ()) AS k FROM heldout)""")
def a16(spark, sf_dir):
    t = compare.concentration(both_predictions(spark, sf_dir), "mean_rt", "controls_prediction", {"full": "full_prediction"})
    return t.select("variant", snap(F.col("net_gain"), 0).alias("net_gain"), snap(F.col("top_share")).alias("top_share"))


VIEWS["scored_sample"] = "SELECT s.*, c.surprisal, c.n_bpe FROM sample s JOIN scores c USING (item, zone)"
VIEWS["med"] = """SELECT o.f AS fold, quantile_cont(word_length::DOUBLE, 0.5) AS ml, quantile_cont(log_frequency, 0.5) AS mf, quantile_cont(surprisal, 0.5) AS ms
    FROM scored_sample s JOIN (SELECT unnest(range(0, 10))::INT AS f) o ON s.fold <> o.f GROUP BY o.f"""
VIEWS["masked"] = """SELECT h.y, h.controls_prediction AS b, h.full_prediction AS a,
    unnest(['single_piece', 'punctuation', 'above_train_median_length', 'above_train_median_frequency', 'above_train_median_surprisal']) AS "group",
    unnest([s.n_bpe = 1, regexp_matches(s.word, '[,.!?;:]'), s.word_length > ml, s.log_frequency > mf, s.surprisal > ms]) AS level
    FROM heldout h JOIN scored_sample s USING (item, zone) JOIN med ON med.fold = h.fold"""


@query("a17_subgroups", f"""SELECT "group", level, 'full' AS variant, count(*) AS n, {q('sqrt(avg((y - b) ** 2))')} AS baseline_rmse, {q('sqrt(avg((y - a) ** 2))')} AS rmse,
    {q('sqrt(avg((y - b) ** 2)) - sqrt(avg((y - a) ** 2))')} AS improvement,
    {q('100 * (sqrt(avg((y - b) ** 2)) - sqrt(avg((y - a) ** 2))) / sqrt(avg((y - b) ** 2))')} AS improvement_percent FROM masked GROUP BY "group", level""")
def a17(spark, sf_dir):
    """Errors inside and outside five groups of regions; medians are those of the training rows of each region's fold."""
    scores = reading.scores(spark, sf_dir).select(*KEYS, "surprisal", "n_bpe")
    rows = both_predictions(spark, sf_dir).join(scores, KEYS)
    columns = {"length": "word_length", "frequency": "log_frequency", "surprisal": "surprisal"}
    medians = compare.training_medians(rows, list(columns.values()), FOLDS)
    marked = rows.join(F.broadcast(medians), "fold")      # one row per fold
    t = compare.subgroups(marked, "mean_rt", "controls_prediction", {"full": "full_prediction"}, {
        "single_piece": F.col("n_bpe") == 1, "punctuation": F.col("word").rlike("[,.!?;:]"),
        **{f"above_train_median_{n}": F.col(c) > F.col(f"median_{c}") for n, c in columns.items()}})
    return t.select("group", "level", "variant", "n", *[snap(F.col(c)).alias(c) for c in ("baseline_rmse", "rmse", "improvement", "improvement_percent")])


VIEWS["quart"] = "SELECT quantile_cont(abs(residual), 0.25) AS lo, quantile_cont(abs(residual), 0.75) AS hi FROM joined"


@query("a18_quartile_profiles", f"""SELECT "group", layer, count(*) AS n, {q('avg(v)')} AS mean FROM (SELECT 'bottom' AS "group", unnest(range(1, 7))::INT AS layer, unnest(c) AS v FROM joined, quart
    WHERE abs(residual) <= lo UNION ALL SELECT 'top', unnest(range(1, 7))::INT, unnest(c) FROM joined, quart WHERE abs(residual) >= hi) GROUP BY "group", layer""")
def a18(spark, sf_dir):
    """Mean distance profile of the smallest and largest quarter of absolute residuals, ties at the cuts included."""
    rows = joined(spark, sf_dir).select(F.abs("residual").alias("a"), "cosine")
    lo, hi = exact_quantiles(rows, [], "a", [0.25, 0.75]).first()["quantiles"]
    groups = F.filter(F.array(F.when(F.col("a") <= lo, "bottom"), F.when(F.col("a") >= hi, "top")), lambda g: g.isNotNull())
    long = rows.select(F.explode(groups).alias("group"), "cosine").select("group", F.posexplode("cosine").alias("i", "v"))
    return long.groupBy("group", (F.col("i") + 1).alias("layer")).agg(F.count("*").alias("n"), snap(F.avg("v")).alias("mean"))


@query("a19_histogram", """SELECT least(floor((residual - lo) / ((hi - lo) / 65)), 64)::INT AS bin, count(*) AS n FROM joined,
    (SELECT min(residual) AS lo, max(residual) AS hi FROM joined) GROUP BY bin""")
def a19(spark, sf_dir):
    return compare.histogram(joined(spark, sf_dir).select("residual"), "residual", 65)


@query("a19_third_distributions", " UNION ALL ".join(f"SELECT '{t}' AS third, " + ", ".join(
    f"{q(f'quantile_cont({t}_mean_cosine, {p})')} AS q{i}" for i, p in enumerate((0, .25, .5, .75, 1))) + " FROM joined" for t in ("early", "middle", "late")))
def a19_thirds(spark, sf_dir):
    found = selected(joined(spark, sf_dir), [f"{t}_mean_cosine" for t in ("early", "middle", "late")], [0, .25, .5, .75, 1])
    rows = [(c.removesuffix("_mean_cosine"), *values) for (_, c), (_, values) in found.items()]
    out = spark.createDataFrame(rows, "third string, " + ", ".join(f"q{i} double" for i in range(5)))
    return out.select("third", *[snap(F.col(f"q{i}")).alias(f"q{i}") for i in range(5)])


@query("a19_trend_line", f"SELECT {q('regr_slope(y, log_frequency)', 3)} AS slope, {q('regr_intercept(y, log_frequency)', 3)} AS intercept FROM heldout JOIN sample USING (item, zone)")
def a19_trend(spark, sf_dir):
    return both_predictions(spark, sf_dir).agg(snap(F.regr_slope("mean_rt", "log_frequency"), 3).alias("slope"),
                                               snap(F.regr_intercept("mean_rt", "log_frequency"), 3).alias("intercept"))


@query("a20_family_maxima", f"SELECT family, max(max_control) AS max_control, max(max_within) AS max_within FROM ({_CORR}) GROUP BY family")
def a20(spark, sf_dir):
    return train_correlations(spark, sf_dir).groupBy("family").agg(
        snap(F.max("max_control"), 6).alias("max_control"), snap(F.max("max_within"), 6).alias("max_within"))


_FOLD_RMSE = "SELECT fold, 'controls' AS variant, sqrt(avg((y - controls_prediction) ** 2)) AS rmse FROM heldout GROUP BY fold UNION ALL SELECT fold, 'full', sqrt(avg((y - full_prediction) ** 2)) FROM heldout GROUP BY fold"
VIEWS["fold_rmse"] = _FOLD_RMSE


def fold_rmse(spark, sf_dir):
    rows = both_predictions(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(v).alias("variant"), compare.rmse(F.col("mean_rt"), F.col(p)).alias("rmse")) for v, p in TWO.items()])
    return rows.groupBy("fold").agg(cells.alias("c")).select("fold", F.inline("c"))


@query("a21_variant_matrix", "SELECT variant, " + ", ".join(f"{q(f'max(rmse) FILTER (WHERE fold = {f})')} AS fold_{f}" for f in FOLDS) + " FROM fold_rmse GROUP BY variant")
def a21(spark, sf_dir):
    wide = fold_rmse(spark, sf_dir).groupBy("variant").pivot("fold", FOLDS).agg(F.first("rmse"))
    return wide.select("variant", *[snap(F.col(str(f))).alias(f"fold_{f}") for f in FOLDS])


@query("a22_best_variant", f"SELECT fold, arg_min(variant, rmse) AS best, {q('min(rmse)')} AS rmse FROM fold_rmse GROUP BY fold")
def a22(spark, sf_dir):
    return fold_rmse(spark, sf_dir).groupBy("fold").agg(F.min_by("variant", "rmse").alias("best"), snap(F.min("rmse")).alias("rmse"))


@query("a23_keep_last", """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1""")
def a23(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return compare.keep_last(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


@query("p17_residuals", f"SELECT item, zone, {q(_R)} AS residual, {q(f'abs{_R}')} AS absolute FROM heldout")
def p17(spark, sf_dir):
    r = F.col("mean_rt") - F.col("full_prediction")
    return both_predictions(spark, sf_dir).select(*KEYS, snap(r).alias("residual"), snap(F.abs(r)).alias("absolute"))


VIEWS["overall"] = """SELECT count(*) AS n, sqrt(avg((y - controls_prediction) ** 2)) AS b, sqrt(avg((y - full_prediction) ** 2)) AS a,
    1 - sum((y - controls_prediction) ** 2) / (count(*) * var_pop(y)) AS rb, 1 - sum((y - full_prediction) ** 2) / (count(*) * var_pop(y)) AS ra FROM heldout"""


@query("p18_gains", f"""SELECT 'full' AS variant, {q('b - a')} AS improvement, {q('100 * (b - a) / b')} AS improvement_percent, {q('ra - rb', 6)} AS delta_r2,
    CASE WHEN b - a > 1e-10 THEN 'improves' WHEN b - a < -1e-10 THEN 'worsens' ELSE 'reference/equivalent' END AS outcome FROM overall""")
def p18(spark, sf_dir):
    t = compare.report(both_predictions(spark, sf_dir), "mean_rt", "controls_prediction", {"full": "full_prediction"})
    return t.select("variant", snap(F.col("improvement")).alias("improvement"), snap(F.col("improvement_percent")).alias("improvement_percent"),
                    snap(F.col("delta_r2"), 6).alias("delta_r2"), "outcome")


@query("m15_variant_comparison", f"""SELECT 'full' AS variant, n, {q('b')} AS baseline_rmse, {q('a')} AS rmse, {q('ra', 6)} AS r2, {q('b - a')} AS improvement,
    (SELECT count(*) FILTER (WHERE a < b) FROM stab WHERE kind = 'fold') AS fold_wins, (SELECT count(*) FILTER (WHERE a < b) FROM stab WHERE kind = 'context') AS context_wins,
    {q("(SELECT count(*) FILTER (WHERE a < b) / count(*) FROM stab WHERE kind = 'context')", 6)} AS context_win_fraction FROM overall""")
def m15(spark, sf_dir):
    t = compare.full_report(both_predictions(spark, sf_dir), "mean_rt", "controls_prediction", {"full": "full_prediction"})
    return t.select("variant", "n", snap(F.col("baseline_rmse")).alias("baseline_rmse"), snap(F.col("rmse")).alias("rmse"), snap(F.col("r2"), 6).alias("r2"),
                    snap(F.col("improvement")).alias("improvement"), "fold_wins", "context_wins", snap(F.col("context_win_fraction"), 6).alias("context_win_fraction"))


_LAYERS = [(m, c, i) for m, c in (("cosine", "c"), ("relative_l2", "l")) for i in range(1, 7)]


@query("m06_pearson", " UNION ALL ".join(f"SELECT '{m}' AS measure, {i}::INT AS layer, {q(f'corr({c}[{i}], y)', 6)} AS r FROM joined" for m, c, i in _LAYERS))
def m06(spark, sf_dir):
    t = correlation.correlations(joined(spark, sf_dir), [(f"{m}_layer_{i}", "mean_rt") for m, _, i in _LAYERS], ("pearson",))
    parts = F.split("x", "_layer_")
    return t.select(parts[0].alias("measure"), parts[1].cast("int").alias("layer"), snap(F.col("correlation"), 6).alias("r"))




VIEWS["spear"] = """SELECT s.item, s.zone, s.word_length, s.log_frequency, s.mean_rt, rank() OVER (ORDER BY word_length) + (count(*) OVER (PARTITION BY word_length) - 1) / 2.0::DOUBLE AS rl,
    rank() OVER (ORDER BY log_frequency) + (count(*) OVER (PARTITION BY log_frequency) - 1) / 2.0::DOUBLE AS rf,
    rank() OVER (ORDER BY mean_rt) + (count(*) OVER (PARTITION BY mean_rt) - 1) / 2.0::DOUBLE AS ry FROM sample s"""


@query("m07_spearman", f"SELECT 'word_length' AS x, count(*) AS n, {q('corr(rl, ry)', 6)} AS rho FROM spear UNION ALL SELECT 'log_frequency', count(*), {q('corr(rf, ry)', 6)} FROM spear")
def m07(spark, sf_dir):
    t = correlation.correlations(reading.sample(spark, sf_dir), [("word_length", "mean_rt"), ("log_frequency", "mean_rt")], ("spearman",))
    return t.select("x", "n", snap(F.col("correlation"), 6).alias("rho"))


def _rank(column: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE"


def t_p_value(t: str, v: str) -> str:
    """Two-sided p of a t value: the finite sums that Student's distribution has for whole degrees of freedom."""
    angle, square = f"atan(abs({t}) / sqrt({v}))", f"(1 / (1 + {t} * {t} / {v}))"
    even = f"list_sum(list_transform(range(0, {v} // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) + k * ln({square})))) / sqrt(pi()) * sin({angle})"
    odd = (f"2 / pi() * ({angle} + sin({angle}) * cos({angle}) * coalesce(list_sum(list_transform(range(0, ({v} - 1) // 2), "
           f"lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + k * ln({square})) * sqrt(pi()) / 2)), 0))")
    return f"greatest(0, 1 - CASE WHEN {v} % 2 = 0 THEN {even} ELSE {odd} END)"


def _p_value(r: str, n: str) -> str:
    return t_p_value(f"({r} * sqrt(({n} - 2) / (1 - {r} * {r})))", f"({n} - 2)")


VIEWS["joined_abs"] = "SELECT *, abs(residual) AS absolute FROM joined"
VIEWS["layer_r"] = " UNION ALL ".join(
    f"SELECT '{m}' AS measure, '{t}' AS target, 'pearson' AS method, {i}::INT AS layer, count(*) AS n, corr({c}[{i}], {y}) AS r FROM joined_abs"
    for m, c, i in _LAYERS for t, y in (("signed", "residual"), ("absolute", "absolute"))) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{m}', '{t}', 'spearman', {i}::INT, count(*), corr(a, b) FROM (SELECT {_rank(f'{c}[{i}]')} AS a, {_rank(y)} AS b FROM joined_abs)"
    for m, c, i in _LAYERS for t, y in (("signed", "residual"), ("absolute", "absolute")))
VIEWS["layer_p"] = f"SELECT *, {_p_value('r', 'n')} AS p FROM layer_r"
VIEWS["layer_q"] = """SELECT *, least(1, min(p * m / place) OVER (PARTITION BY measure, target, method ORDER BY place DESC)) AS adjusted FROM (
    SELECT *, row_number() OVER (PARTITION BY measure, target, method ORDER BY p, layer) AS place, count(*) OVER (PARTITION BY measure, target, method) AS m FROM layer_p)"""


@query("m08_layer_correlations", f"""SELECT measure, target, method, layer, n, {q('r', 6)} AS correlation, {q('p', 6)} AS p_value, {q('adjusted', 6)} AS q_value,
    adjusted < 0.05 AS fdr_05 FROM layer_q""")
def m08(spark, sf_dir):
    """Every layer against signed and absolute residuals, with p, its adjustment within the family and the decision at 5 %."""
    rows = joined(spark, sf_dir).withColumn("absolute", F.abs("residual"))
    t = correlation.layer_correlations(rows, 6, {"signed": "residual", "absolute": "absolute"})
    return t.select("measure", "target", "method", "layer", "n", *[snap(F.col(c), 6).alias(c) for c in ("correlation", "p_value", "q_value")], "fdr_05")


_SUMMARIES = ("total", "mean", "maximum", "peak_layer", "early_mean", "middle_mean", "late_mean", "late_minus_early")
_CONFOUNDS = ("surprisal", "word_length", "log_frequency", "n_bpe")


def _summary_sql(name: str, v: str) -> str:
    thirds = {n: f"({v}[{2 * i + 1}] + {v}[{2 * i + 2}]) / 2" for i, n in enumerate(("early_mean", "middle_mean", "late_mean"))}
    return {"total": f"list_sum({v})", "mean": f"list_sum({v}) / 6", "maximum": f"list_max({v})", "peak_layer": f"list_position({v}, list_max({v}))::DOUBLE",
            **thirds, "late_minus_early": f"{thirds['late_mean']} - {thirds['early_mean']}"}[name]


VIEWS["confound_rows"] = "SELECT " + ", ".join(f"{_summary_sql(n, v)} AS {n}_{m}" for m, v in (("cosine", "c"), ("relative_l2", "l")) for n in _SUMMARIES) + \
    """, s.surprisal, s.word_length::DOUBLE AS word_length, s.log_frequency, s.n_bpe::DOUBLE AS n_bpe, 1.0::DOUBLE AS layers FROM joined j JOIN scored_sample s USING (item, zone)"""
VIEWS["confound_ranks"] = "SELECT " + ", ".join(f"{_rank(c)} AS {c}" for c in (
    *[f"{n}_{m}" for m in ("cosine", "relative_l2") for n in _SUMMARIES], *_CONFOUNDS, "layers")) + " FROM confound_rows"
VIEWS["confound_r"] = " UNION ALL ".join(
    f"""SELECT '{m}' AS measure, '{n}_{m}' AS feature, '{c}' AS confound, '{how}' AS method, count(*) AS n,
    min({n}_{m}) = max({n}_{m}) OR min({c}) = max({c}) AS constant, corr({n}_{m}, {c}) AS r FROM {table}"""
    for m in ("cosine", "relative_l2") for n in _SUMMARIES for c in (*_CONFOUNDS, "layers") for how, table in (("pearson", "confound_rows"), ("spearman", "confound_ranks")))


@query("m11_confound_correlations", f"""SELECT measure, feature, confound, method, n, CASE WHEN NOT constant THEN {q('r', 6)} END AS correlation,
    CASE WHEN NOT constant THEN {q(_p_value('r', 'n'), 6)} END AS p_value, CASE WHEN constant THEN 'undefined_constant' ELSE 'ok' END AS status FROM confound_r""")
def m11(spark, sf_dir):
    """All summaries of both measures against all confounds by both methods; a constant one (as ``layers``) is reported, not dropped."""
    scores = reading.scores(spark, sf_dir).select(*KEYS, "surprisal", F.col("n_bpe").cast("double").alias("n_bpe"))
    features = [f"{n}_{m}" for m in ("cosine", "relative_l2") for n in _SUMMARIES]
    rows = joined(spark, sf_dir).withColumn("layers", F.lit(1.0)).join(scores, KEYS).select(
        *[F.col(c).cast("double").alias(c) for c in (*features, *_CONFOUNDS, "layers")])
    t = correlation.correlations(rows, [(f, c) for f in features for c in (*_CONFOUNDS, "layers")])
    return t.select(F.when(F.col("x").endswith("_cosine"), "cosine").otherwise("relative_l2").alias("measure"), F.col("x").alias("feature"),
                    F.col("y").alias("confound"), "method", "n", *[snap(F.col(c), 6).alias(c) for c in ("correlation", "p_value")], "status")
