"""Modelling operators (OLS family) with closed-form SQL where two predictors suffice."""
from pyspark.sql import functions as F

from wordframe.catalog.registry import VIEWS, q, query
from wordframe.functions.numeric import snap
from wordframe.plans import linear, reading

VIEWS["analysis"] = """SELECT r.item, r.zone, r.word, length(r.word) AS word_length, ln(1 + f.c) AS log_frequency,
    f.c AS frequency_count, m.n AS n_observations, m.mean_rt,
    lag(length(r.word)) OVER w AS prev_word_length, lag(ln(1 + f.c)) OVER w AS prev_log_frequency
    FROM part_regions r JOIN (SELECT word, count(*) AS c FROM part_regions GROUP BY word) f USING (word)
    LEFT JOIN means m USING (item, zone) WINDOW w AS (PARTITION BY r.item ORDER BY r.zone)"""
VIEWS["sample"] = """SELECT *, (ntile(10) OVER (ORDER BY md5('2026:' || item || ':' || zone)) - 1)::INT AS fold
    FROM analysis WHERE prev_word_length IS NOT NULL AND mean_rt > 0"""
# Held-out two-predictor OLS from training sums, per fold.
VIEWS["ols2"] = """SELECT f.fold, t.n - f.n AS n, (t.x - f.x) / (t.n - f.n) AS mx, (t.z - f.z) / (t.n - f.n) AS mz,
    (t.y - f.y) / (t.n - f.n) AS my, (t.xx - f.xx) / (t.n - f.n) AS xx, (t.zz - f.zz) / (t.n - f.n) AS zz,
    (t.xz - f.xz) / (t.n - f.n) AS xz, (t.xy - f.xy) / (t.n - f.n) AS xy, (t.zy - f.zy) / (t.n - f.n) AS zy
    FROM fold2 f, (SELECT sum(n) n, sum(x) x, sum(z) z, sum(y) y, sum(xx) xx, sum(zz) zz, sum(xz) xz, sum(xy) xy,
        sum(zy) zy FROM fold2) t"""
VIEWS["fold2"] = """SELECT fold, count(*) AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(x * x) AS xx, sum(z * z) AS zz,
    sum(x * z) AS xz, sum(x * y) AS xy, sum(z * y) AS zy FROM xyz GROUP BY fold"""
VIEWS["xyz"] = """SELECT item, zone, fold, word_length::DOUBLE AS x, log_frequency::DOUBLE AS z, mean_rt - 35000 AS y
    FROM sample"""
VIEWS["coef2"] = """SELECT fold, n, mx, mz, my, sqrt(xx - mx * mx) AS sx, sqrt(zz - mz * mz) AS sz,
    ((xy - mx * my) * (zz - mz * mz) - (zy - mz * my) * (xz - mx * mz)) / d AS bx,
    ((zy - mz * my) * (xx - mx * mx) - (xy - mx * my) * (xz - mx * mz)) / d AS bz
    FROM (SELECT *, (xx - mx * mx) * (zz - mz * mz) - (xz - mx * mz) ** 2 AS d FROM ols2)"""
VIEWS["pred2"] = """SELECT item, zone, xyz.fold, y + 35000 AS y, my + 35000 + bx * (x - mx) + bz * (z - mz) AS prediction
    FROM xyz JOIN coef2 USING (fold)"""
for _name in ("xyz", "fold2", "ols2", "coef2", "pred2"):
    VIEWS[_name] = VIEWS.pop(_name)

TWO = ["word_length", "log_frequency"]


def two_predictor(spark, sf_dir):
    return linear.cross_validate(reading.sample(spark, sf_dir), {"full": TWO}, "mean_rt")


_HELD_OUT = f"SELECT item, zone, fold, {q('prediction')} AS prediction FROM pred2"


@query("m02_factor_ols", _HELD_OUT)
def m02_factors(spark, sf_dir):
    """The same held-out predictions from triangular factors of the folds."""
    predictions = linear.cross_validate_factors(reading.sample(spark, sf_dir), {"full": TWO}, "mean_rt")
    return predictions.select("item", "zone", "fold", snap(F.col("full_prediction")).alias("prediction"))


@query("m02_cross_validated_ols", _HELD_OUT)
def m02(spark, sf_dir):
    predictions, _ = two_predictor(spark, sf_dir)
    return predictions.select("item", "zone", "fold", snap(F.col("full_prediction")).alias("prediction"))
