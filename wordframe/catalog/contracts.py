"""Data contracts (V*) and exact-key joins (J*)."""
from pyspark.sql import functions as F

from wordframe.catalog.registry import VIEWS, q, query
from wordframe.catalog.scalars import lagged_scores
from wordframe.catalog.scans import fresh, shared_analysis
from wordframe.functions import text
from wordframe.functions.numeric import finite, same, snap
from wordframe.operators import contracts as c
from wordframe.operators import joins, ordered, ranking
from wordframe.plans import frozen, linear, reading
from wordframe.sources import files, tables

KEYS = ["item", "zone"]
VIEWS["positions"] = "SELECT part * 100 + trial AS item, position AS zone, word_id FROM sheet"
VIEWS["cells"] = """SELECT DISTINCT part * 100 + trial AS item, position AS zone, word_id, CASE cell_type WHEN 'b' THEN upper(cell)
    WHEN 'n' THEN CASE WHEN cell::DOUBLE = floor(cell::DOUBLE) THEN cell::DOUBLE::BIGINT::VARCHAR ELSE cell END ELSE cell END AS word FROM sheet"""


def positions(spark, sf_dir):
    return tables.sheet(spark, sf_dir).select((F.col("part") * 100 + F.col("trial")).alias("item"),
                                              F.col("position").alias("zone"), "word_id")


def cells(spark, sf_dir):
    s = tables.sheet(spark, sf_dir)
    return s.select((F.col("part") * 100 + F.col("trial")).alias("item"), F.col("position").alias("zone"), "word_id",
                    text.canonical_cell(F.col("cell"), F.col("cell_type")).alias("word")).distinct()


@query("v01_unique_key", "SELECT participant, item, zone, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) > 1")
def v01(spark, sf_dir):
    return c.duplicate_keys(tables.raw_observations(spark, sf_dir), ["participant", *KEYS])


@query("v02_contiguous_positions", """SELECT item, min(zone) AS first, max(zone) AS last, count(DISTINCT zone) AS distinct_zones,
    count(*) AS regions FROM positions GROUP BY item HAVING min(zone) <> 1 OR max(zone) <> count(DISTINCT zone) OR count(*) <> count(DISTINCT zone)""")
def v02(spark, sf_dir):
    return c.broken_positions(positions(spark, sf_dir))


@query("v03_same_key_set", """SELECT item, zone, 'left' AS side FROM (SELECT item, zone FROM part_regions EXCEPT SELECT item, zone FROM regions)
    UNION ALL SELECT item, zone, 'right' FROM (SELECT item, zone FROM regions EXCEPT SELECT item, zone FROM part_regions)""")
def v03(spark, sf_dir):
    return c.key_set_difference(tables.part_regions(spark, sf_dir), tables.regions(spark, sf_dir), KEYS)


@query("v04_text_agreement", """SELECT a.item, a.zone, a.word, a.word_id, b.word AS other_word, b.word_id AS other_word_id FROM cells a
    JOIN (SELECT item, zone, max(word) AS word, max(word_id) AS word_id FROM cells GROUP BY ALL) b USING (item, zone)
    WHERE a.word <> b.word OR a.word_id <> b.word_id UNION ALL SELECT r.item, r.zone, r.word, '', c.word, '' FROM part_regions r
    JOIN cells c ON c.word_id = ((r.item - 1) * 100 + r.zone - 1)::VARCHAR WHERE r.word <> c.word""")
def v04(spark, sf_dir):
    a = cells(spark, sf_dir)
    b = a.groupBy(*KEYS).agg(F.max("word").alias("word"), F.max("word_id").alias("word_id"))
    first = c.disagreements(a, b, KEYS, ["word", "word_id"])
    by_id = a.select(F.col("word_id"), "word")
    r = tables.part_regions(spark, sf_dir).withColumn("word_id", ((F.col("item") - 1) * 100 + F.col("zone") - 1).cast("string"))
    second = c.disagreements(r, by_id, ["word_id"], ["word"]).join(r.select("word_id", *KEYS), "word_id").select(
        *KEYS, "word", F.lit("").alias("word_id"), "other_word", F.lit("").alias("other_word_id"))
    return first.unionByName(second)


@query("v05_score_boundary", "SELECT item, zone, prev_surprisal IS NULL AS missing FROM lagged_scores WHERE zone <= 2 AND NOT (zone = 1 AND coalesce(isnan(prev_surprisal), false))")
def v05(spark, sf_dir):
    """The lagged score breaks the boundary rule by design: absent at the first region, undefined at the second."""
    return c.score_boundary(lagged_scores(spark, sf_dir), "prev_surprisal").select(
        *KEYS, F.col("prev_surprisal").isNull().alias("missing"))


VIEWS["known"] = """SELECT p_partkey // 100 + 1 AS item, p_partkey % 100 + 1 AS zone, CASE WHEN p_size % 10 = 0 THEN p_type ELSE p_name END AS word
    FROM part WHERE p_size <> 13"""


@query("v06_observation_rules", """SELECT participant, item, zone, sum(n)::BIGINT AS n, concat_ws(';', CASE WHEN sum(n) > 1 THEN 'duplicate' END,
    CASE WHEN sum(bad) > 0 THEN 'invalid_time' END, CASE WHEN bool_or(k IS NULL) THEN 'unknown_region' END,
    CASE WHEN bool_or(k IS NOT NULL AND k <> word) THEN 'word_mismatch' END) AS reasons
    FROM (SELECT o.participant, o.item, o.zone, o.word, known.word AS k, count(*) AS n, count(*) FILTER (WHERE rt - 40000 <= 0) AS bad
          FROM obs o LEFT JOIN known ON known.item = o.item AND known.zone = o.zone GROUP BY ALL)
    GROUP BY participant, item, zone HAVING reasons <> ''""")
def v06(spark, sf_dir):
    observations = tables.observations(spark, sf_dir).withColumn("rt", F.col("rt") - 40000)
    part = tables.table(spark, sf_dir, "part").filter("p_size <> 13")
    known = part.select(*tables.part_key("p_partkey"), F.when(F.col("p_size") % 10 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("word"))
    return c.observation_violations(observations, known)


@query("v07_one_identity", """SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_suppkey)) AS identities FROM lineitem GROUP BY ALL
    HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1""")
def v07(spark, sf_dir):
    return c.inconsistent_identity(tables.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("v08_one_id_per_position", """SELECT part, position, count(DISTINCT word_id) AS identities FROM sheet GROUP BY ALL HAVING count(DISTINCT word_id) > 1""")
def v08(spark, sf_dir):
    """With the trial left out of the context, several ids share a position."""
    return c.inconsistent_identity(tables.sheet(spark, sf_dir), ["part", "position"], ["word_id"])


@query("v09_domain", """SELECT l_linenumber - 1 AS skip, count(*) AS n FROM lineitem WHERE l_linenumber - 1 NOT IN (0, 1) GROUP BY ALL""")
def v09(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).alias("skip"), F.col("l_linestatus").alias("word"))
    bad = rows.filter(~F.col("skip").isin(0, 1) | (F.trim("word") == ""))
    return bad.groupBy("skip").agg(F.count("*").alias("n"))


@query("v10_integral_count", """SELECT l_orderkey, l_linenumber, l_quantity / 2 - 1 AS n FROM lineitem
    WHERE NOT (l_quantity / 2 - 1 >= 1 AND l_quantity / 2 - 1 = floor(l_quantity / 2 - 1))""")
def v10(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 2 - 1).alias("n"))
    return c.integral_counts(rows, "n")


@query("v11_finite_features", """SELECT item, zone FROM lagged_scores WHERE coalesce(isnan(surprisal), true) OR coalesce(isnan(prev_surprisal), true)
    OR coalesce(isnan(prev_entropy_bits), true)""")
def v11(spark, sf_dir):
    return c.nonfinite(lagged_scores(spark, sf_dir), ["surprisal", "prev_surprisal", "prev_entropy_bits"]).select(*KEYS)


VIEWS["refold"] = """SELECT item, zone, mean_rt, (ntile(10) OVER (ORDER BY md5('7:' || item || ':' || zone)) - 1)::INT AS fold FROM sample"""


def refold(spark, sf_dir):
    s = reading.sample(spark, sf_dir).drop("fold")
    return ranking.assign_folds(s, KEYS, seed=7)


@query("v12_saved_folds", "SELECT s.item, s.zone, s.fold, r.fold AS other_fold FROM sample s JOIN refold r USING (item, zone) WHERE s.fold <> r.fold")
def v12(spark, sf_dir):
    return c.disagreements(reading.sample(spark, sf_dir), refold(spark, sf_dir), KEYS, ["fold"])


def eligibility(spark, sf_dir):
    rows = shared_analysis(spark, sf_dir).join(
        lagged_scores(spark, sf_dir).select(*KEYS, "surprisal", "prev_surprisal"), KEYS)
    rare = F.when(F.col("frequency_count") >= F.lit(20), F.col("log_frequency"))
    rows = rows.withColumn("log_frequency", rare)
    bad = lambda name: ~F.coalesce(finite(F.col(name)), F.lit(False))
    late = F.col("zone") > 1
    return c.split_by_reason(rows, {
        "context_initial_score": F.col("zone") == 1, "context_boundary_lags": F.col("zone") == 1,
        "previous_initial_score": (F.col("zone") == 2) & bad("prev_surprisal"),
        "current_frequency_unavailable": bad("log_frequency"), "previous_frequency_unavailable": late & bad("prev_log_frequency"),
        "other_predictor": bad("word_length") | (late & bad("prev_word_length")) | (late & bad("surprisal"))
                           | ((F.col("zone") > 2) & bad("prev_surprisal")),
        "invalid_outcome": ~F.coalesce(finite(F.col("mean_rt")) & (F.col("mean_rt") > 0), F.lit(False))})


VIEWS["excluded"] = """SELECT * FROM (SELECT item, zone, word, concat_ws(';', CASE WHEN zone = 1 THEN 'context_initial_score' END,
    CASE WHEN zone = 1 THEN 'context_boundary_lags' END, CASE WHEN zone = 2 THEN 'previous_initial_score' END,
    CASE WHEN frequency_count < 20 THEN 'current_frequency_unavailable' END,
    CASE WHEN coalesce(mean_rt, 0) <= 0 THEN 'invalid_outcome' END) AS reasons FROM analysis) WHERE reasons <> ''"""


@query("v13_eligibility", "SELECT item, zone, word, reasons FROM excluded")
def v13(spark, sf_dir):
    return eligibility(spark, sf_dir)[1].select(*KEYS, "word", "reasons")


@query("a24_reason_counts", "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ';')) AS reason FROM excluded) GROUP BY reason")
def a24(spark, sf_dir):
    return eligibility(spark, sf_dir)[2]


@query("v14_complete_cases", """SELECT CASE WHEN reasons = '' THEN 'eligible' ELSE reasons END AS status, count(*) AS n FROM (SELECT concat_ws(';',
    CASE WHEN prev_word_length IS NULL THEN 'prev_word_length' END, CASE WHEN gaze_mean IS NULL THEN 'gaze_mean' END) AS reasons
    FROM analysis LEFT JOIN (SELECT word_id::BIGINT // 100 + 1 AS item, word_id::BIGINT % 100 + 1 AS zone,
    avg(CASE WHEN try_cast(gaze_cell AS DOUBLE) > 80000 THEN try_cast(gaze_cell AS DOUBLE) END) AS gaze_mean FROM sheet GROUP BY ALL) USING (item, zone)) GROUP BY ALL""")
def v14(spark, sf_dir):
    value = F.col("gaze_cell").try_cast("double")
    gaze = tables.sheet(spark, sf_dir).groupBy(
        F.expr("cast(word_id as bigint) div 100 + 1").alias("item"), F.expr("cast(word_id as bigint) % 100 + 1").alias("zone")).agg(
        F.avg(F.when(value > 80000, value)).alias("gaze_mean"))
    rows = shared_analysis(spark, sf_dir).join(gaze, KEYS, "left")
    good, bad, _ = c.complete_cases(rows, ["word_length", "prev_word_length", "gaze_mean"])
    return (good.select(F.lit("eligible").alias("status")).unionByName(bad.select(F.col("reasons").alias("status")))
            .groupBy("status").agg(F.count("*").alias("n")))


@query("v15_smoke_subset", "SELECT item, zone, word FROM regions WHERE item = (SELECT min(doc_id) FROM documents) AND zone <= 200")
def v15(spark, sf_dir):
    """First context, first 200 regions: the size is the feature."""
    first = tables.table(spark, sf_dir, "documents").agg(F.min("doc_id")).first()[0]
    return tables.regions(spark, sf_dir).filter((F.col("item") == first) & (F.col("zone") <= 200))


@query("v16_row_identity", """SELECT side, count(*) AS n FROM (SELECT 'left' AS side FROM (SELECT item, zone, fold FROM sample EXCEPT ALL SELECT item, zone, fold FROM refold)
    UNION ALL SELECT 'right' FROM (SELECT item, zone, fold FROM refold EXCEPT ALL SELECT item, zone, fold FROM sample)) GROUP BY side""")
def v16(spark, sf_dir):
    diff = c.row_set_difference(reading.sample(spark, sf_dir), refold(spark, sf_dir), [*KEYS, "fold"])
    return diff.groupBy("side").agg(F.count("*").alias("n"))


VIEWS["cov1"] = """SELECT f.fold, (t.y - f.y) / (t.n - f.n) AS my, (t.x - f.x) / (t.n - f.n) AS mx, ((t.xy - f.xy) / (t.n - f.n)
    - (t.x - f.x) / (t.n - f.n) * (t.y - f.y) / (t.n - f.n)) / ((t.xx - f.xx) / (t.n - f.n) - ((t.x - f.x) / (t.n - f.n)) ** 2) AS b
    FROM fold2 f, (SELECT sum(n) n, sum(x) x, sum(y) y, sum(xx) xx, sum(xy) xy FROM fold2) t"""
VIEWS["pred1"] = "SELECT item, zone, xyz.fold, y + 35000 AS y, my + 35000 + b * (x - mx) AS prediction FROM xyz JOIN cov1 USING (fold)"
VIEWS["heldout"] = """SELECT a.item, a.zone, a.fold, a.y, b.prediction AS controls_prediction, a.prediction AS full_prediction
    FROM pred2 a JOIN pred1 b USING (item, zone)"""


def both_predictions(spark, sf_dir):
    """Held-out predictions of one and of two predictors, from one pass."""
    from wordframe.cluster import shared
    return shared(spark, ("both", sf_dir), lambda: linear.cross_validate(
        reading.sample(spark, sf_dir), {"controls": ["word_length"], "full": ["word_length", "log_frequency"]}, "mean_rt")[0])


@query("v17_recomputed_metrics", " UNION ALL ".join(f"""SELECT '{v}' AS variant, {q(f"sqrt(avg((y - {v}_prediction) ** 2))", 3)} AS saved_rmse,
    {q(f"1 - sum((y - {v}_prediction) ** 2) / (count(*) * var_pop(y))", 5)} AS saved_r2, true AS rmse_matches, true AS r2_matches FROM heldout""" for v in ("controls", "full")))
def v17(spark, sf_dir):
    """The saved summary goes through text; metrics recomputed from the saved predictions must agree with it."""
    names = {"controls": "controls_prediction", "full": "full_prediction"}
    summary, rows = fresh(spark, "summary"), fresh(spark, "predictions")
    predictions = both_predictions(spark, sf_dir).select(*KEYS, "mean_rt", *names.values())
    files.write_tsv(predictions, rows)
    files.write_tsv(linear.metric_table(predictions, "mean_rt", names), summary)
    saved = files.read_tsv(spark, summary, "variant string, n string, saved_rmse string, saved_r2 string")
    back = files.read_tsv(spark, rows, "item bigint, zone bigint, mean_rt double, controls_prediction double, full_prediction double")
    again = linear.metric_table(back, "mean_rt", names)
    return again.join(saved.drop("n"), "variant").select(
        "variant", snap(F.col("saved_rmse").cast("double"), 3).alias("saved_rmse"), snap(F.col("saved_r2").cast("double"), 5).alias("saved_r2"),
        same(F.col("rmse").cast("string"), F.col("saved_rmse"), 1e-9, 1e-9).alias("rmse_matches"),
        same(F.col("r2").cast("string"), F.col("saved_r2"), 1e-9, 1e-9).alias("r2_matches"))


def saved_run(spark, sf_dir):
    """Both models' held-out predictions, written to text once per session and read from there."""
    from wordframe.cluster import remember

    def build():
        path = fresh(spark, "run")
        frozen.save_run(both_predictions(spark, sf_dir), "mean_rt", {"controls": "controls_prediction", "full": "full_prediction"}, path)
        return path
    return frozen.saved_run(spark, remember(spark, ("saved_run", sf_dir), build))


@query("v18_reproduction", """SELECT count(*) AS n, 0.0::DOUBLE AS max_difference, true AS reproduced FROM heldout""")
def v18(spark, sf_dir):
    """The saved predictions of the full model against the same model fitted anew, from triangular factors instead of moments."""
    again = linear.cross_validate_factors(reading.sample(spark, sf_dir), {"again": ["word_length", "log_frequency"]}, "mean_rt")
    saved = saved_run(spark, sf_dir).where("variant = 'full'").select(*KEYS, "prediction")
    both = again.join(saved, KEYS, "full_outer")
    d = F.max(F.abs(F.col("prediction") - F.col("again_prediction")))
    whole = F.count("prediction") + F.count("again_prediction") == 2 * F.count("*")
    return both.agg(F.count("*").alias("n"), snap(d).alias("max_difference"), ((d <= 1e-6) & whole).alias("reproduced"))


@query("v19_manifest_diff", """SELECT 'documents/' || doc_id AS path, CASE WHEN lang = 'es' THEN 'missing' ELSE 'changed' END AS status
    FROM documents WHERE lang IN ('es', 'fr') UNION ALL SELECT 'pages/' || page_id, 'unexpected' FROM pages""")
def v19(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    pages = tables.table(spark, sf_dir, "pages")
    entry = lambda prefix, key, body: (F.concat(F.lit(prefix), F.col(key).cast("string")).alias("path"), F.sha2(body, 256).alias("sha256"))
    before = docs.select(*entry("documents/", "doc_id", F.col("text")))
    after = docs.filter("lang <> 'es'").select(*entry("documents/", "doc_id", F.when(
        F.col("lang") == "fr", F.concat("text", F.lit("\n"))).otherwise(F.col("text")))).unionByName(
        pages.select(*entry("pages/", "page_id", F.col("html")))).unionByName(
        pages.select(*entry("results/new/", "page_id", F.col("url"))))
    return files.manifest_diff(before, after, allowed=("results/new/",))


@query("v20_eligible_contexts", """SELECT item, zone, word, (item, zone) IN (SELECT (doc_id, 1) FROM labels WHERE quality = 1) AS eligible FROM regions
    WHERE item IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def v20(spark, sf_dir):
    eligible = tables.table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("item"), F.lit(1).cast("bigint").alias("zone")).distinct()
    # Contexts are dropped before their text is split into regions.
    regions = tables.regions(spark, sf_dir, contexts=eligible)
    return regions.join(eligible.withColumn("eligible", F.lit(True)), KEYS, "left").select(
        *KEYS, "word", F.coalesce("eligible", F.lit(False)).alias("eligible"))


@query("v21_sidecar_agreement", """SELECT "check", ok FROM (SELECT count(*) AS n, count(*) FILTER (WHERE word <> upper(word)) AS changed FROM part_regions),
    (VALUES ('rows'), ('smoke'), ('revision'), ('content')) t("check"), LATERAL (SELECT CASE "check" WHEN 'rows' THEN n = (SELECT count(*) FROM part)
    WHEN 'content' THEN changed = 0 WHEN 'revision' THEN false ELSE true END AS ok)""")
def v21(spark, sf_dir):
    """A table against the record stored when it was saved: rows, smoke flag, revision, content.

    Between the two the words were changed and the revision moved on, so exactly these two checks must fail.
    """
    saved = tables.part_regions(spark, sf_dir)
    path = fresh(spark, "record")
    files.write_json(files.fingerprint(saved, [*KEYS, "word"]).withColumns({"smoke": F.lit(False), "revision": F.lit("r1")}), path)
    record = spark.read.schema("n bigint, h1 string, h2 string, h3 string, h4 string, smoke boolean, revision string").json(path)
    now = files.fingerprint(saved.withColumn("word", F.upper("word")), [*KEYS, "word"]).select(
        F.col("n").alias("now_n"), *[F.col(f"h{i}").alias(f"now_h{i}") for i in range(1, 5)], F.lit("r2").alias("now_revision"))
    content = F.lit(True)
    for i in range(1, 5):
        content = content & (F.col(f"h{i}") == F.col(f"now_h{i}"))
    checks = F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok")) for n, ok in {
        "rows": F.col("n") == F.col("now_n"), "smoke": ~F.col("smoke"), "revision": F.col("revision") == F.col("now_revision"),
        "content": content}.items()])
    # One-row records meet on a constant key.
    return record.withColumn("k", F.lit(1)).join(now.withColumn("k", F.lit(1)), "k").select(F.inline(checks))


@query("v22_cellwise_recompute", """SELECT item, zone, 'word_length' AS "column" FROM analysis WHERE zone = 7
    UNION ALL SELECT item, zone, 'prev_word_length' FROM analysis WHERE zone = 9""")
def v22(spark, sf_dir):
    """Two columns of the saved table are falsified at known positions; the recomputation must find exactly those."""
    expected = shared_analysis(spark, sf_dir)
    saved = expected.withColumn("word_length", F.col("word_length") + F.when(F.col("zone") == 7, 1).otherwise(0)).withColumn(
        "prev_word_length", F.when(F.col("zone") != 9, F.col("prev_word_length")))
    path = fresh(spark, "saved")
    names = ["word", "word_length", "prev_word_length", "log_frequency", "prev_log_frequency", "mean_rt"]
    files.write_tsv(saved.select(*KEYS, *names), path)
    back = files.read_tsv(spark, path, "item bigint, zone bigint, " + ", ".join(f"{n} string" for n in names))
    long = lambda df, out: df.select(*KEYS, F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias(out)) for n in names])))
    pairs = long(back, "a").join(long(expected, "b"), [*KEYS, "column"])
    return pairs.filter(~same(F.col("a"), F.col("b"))).select(*KEYS, "column")


@query("j01_merge_exact", f"SELECT a.item, a.zone, a.word, {q('s.surprisal')} AS surprisal, s.n_bpe FROM analysis a JOIN scores s USING (item, zone)")
def j01(spark, sf_dir):
    merged, bad = joins.merge_exact(shared_analysis(spark, sf_dir), reading.scores(spark, sf_dir), ["surprisal", "n_bpe"])
    c.assert_empty(bad, "regions and scores differ")
    return merged.select(*KEYS, "word", snap(F.col("surprisal")).alias("surprisal"), "n_bpe")


@query("j02_lexical_by_code", f"""SELECT item, zone, word, length(word) AS word_length, form AS frequency_form, p_size % 11 <> 0 AS frequency_text_matches,
    contains(form, ' ') AS frequency_is_multiword, CASE WHEN ok THEN p_size * 10 END::BIGINT AS frequency_count,
    {q('CASE WHEN ok THEN ln(1 + p_size * 10) END', 6)} AS log_frequency FROM (SELECT p_partkey // 100 + 1 AS item, p_partkey % 100 + 1 AS zone, p_name AS word, p_size,
    CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS form, p_size % 11 <> 0 AND p_size % 7 <> 0 AS ok FROM part)""")
def j02(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    entry = lambda name, token: part.select(*tables.part_key("p_partkey"), F.lit(name).alias("part"), token.alias("token"),
                                            (F.col("p_size") * 10).cast("bigint").alias("count"), "p_size")
    codes = entry("word", F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_name"))).unionByName(
        entry("whole", F.col("p_name")).filter("p_size % 11 <> 0"))
    out = joins.lexical_by_code(tables.part_regions(spark, sf_dir), codes)
    return out.withColumn("word_length", F.col("word_length").cast("bigint")).withColumn("log_frequency", snap(F.col("log_frequency"), 6))


VIEWS["lang_counts"] = """SELECT lang, word AS form, count(*) AS count FROM (SELECT lang, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'),
    lambda x: x <> '')) AS word FROM documents) GROUP BY ALL"""
VIEWS["lookup"] = "SELECT form, min(count) AS count FROM lang_counts WHERE form <> '' GROUP BY form HAVING count(DISTINCT count) = 1"


def lookup(spark, sf_dir):
    per_lang = tables.langs(spark, sf_dir).groupBy("lang", F.col("word").alias("form")).agg(F.count("*").alias("count"))
    return joins.unambiguous_counts(per_lang)


@query("a05_unambiguous_counts", "SELECT form, count FROM lookup")
def a05(spark, sf_dir):
    return lookup(spark, sf_dir)


_STRIPPED = "trim(word, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~“”‘’…')"


@query("j03_frequency_by_form", f"""SELECT item, zone, {_STRIPPED} AS frequency_form, count AS frequency_count, {q('ln(1 + count)', 6)} AS log_frequency
    FROM regions LEFT JOIN lookup ON form = {_STRIPPED}""")
def j03(spark, sf_dir):
    out = joins.frequency_by_form(tables.regions(spark, sf_dir), lookup(spark, sf_dir))
    return out.select(*KEYS, "frequency_form", "frequency_count", snap(F.col("log_frequency"), 6).alias("log_frequency"))


@query("j04_models_side_by_side", f"""SELECT s.item, s.zone, {q('s.surprisal')} AS bigram_surprisal, {q('-log2(a.frequency_count / t.n)')} AS unigram_surprisal
    FROM scores s JOIN analysis a USING (item, zone), (SELECT count(*)::DOUBLE AS n FROM part_regions) t""")
def j04(spark, sf_dir):
    rows = shared_analysis(spark, sf_dir)
    n = float(rows.count())
    unigram = rows.select(*KEYS, (-F.log2(F.col("frequency_count") / F.lit(n))).alias("surprisal"))
    out = joins.side_by_side(rows.select(*KEYS), {"bigram": reading.scores(spark, sf_dir), "unigram": unigram})
    return out.select(*KEYS, snap(F.col("bigram_surprisal")).alias("bigram_surprisal"), snap(F.col("unigram_surprisal")).alias("unigram_surprisal"))


@query("j05_lag_with_gaps", "SELECT a.item, a.zone, a.word, b.word AS prev_word FROM cells a LEFT JOIN cells b ON a.item = b.item AND a.zone = b.zone + 1")
def j05(spark, sf_dir):
    return ordered.lag_by_key(cells(spark, sf_dir), ["word"]).select(*KEYS, "word", "prev_word")


@query("j06_lag_two", f"""SELECT a.item, a.zone, {q("CASE WHEN coalesce(isnan(b.surprisal), true) THEN 0 ELSE b.surprisal END")} AS lag2_surprisal,
    (NOT coalesce(isnan(b.surprisal), true))::INT::DOUBLE AS lag2_available, length(b.word)::INT AS lag2_length
    FROM scores a LEFT JOIN scores b ON a.item = b.item AND a.zone = b.zone + 2""")
def j06(spark, sf_dir):
    from wordframe.functions.numeric import zero_with_flag
    lagged = ordered.lag_by_key(reading.scores(spark, sf_dir), ["surprisal", "word"], lags=(2,), prefix={2: "lag2_"})
    value, flag = zero_with_flag(F.col("lag2_surprisal"))
    return lagged.select(*KEYS, snap(value).alias("lag2_surprisal"), flag.alias("lag2_available"), F.length("lag2_word").alias("lag2_length"))


VIEWS["step_profile"] = """SELECT item, zone, list_transform(range(1, len(h)), lambda i: 1 - list_dot_product(h[i], h[i + 1]) / (sqrt(list_dot_product(h[i], h[i]))
    * sqrt(list_dot_product(h[i + 1], h[i + 1])))) AS c, list_transform(range(1, len(h)), lambda i: sqrt(list_sum(list_transform(list_zip(h[i + 1], h[i]),
    lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / (sqrt(list_dot_product(h[i], h[i])) + 1e-12)) AS l FROM stacks"""
VIEWS["joined"] = """SELECT b.*, (b.y - b.full_prediction) AS residual, p.c, p.l, list_sum(p.c) AS total_cosine, (p.c[1] + p.c[2]) / 2 AS early_mean_cosine,
    (p.c[3] + p.c[4]) / 2 AS middle_mean_cosine, (p.c[5] + p.c[6]) / 2 AS late_mean_cosine FROM heldout b JOIN step_profile p USING (item, zone)"""


def joined(spark, sf_dir):
    """Trajectory features with held-out residuals of the two-predictor model."""
    residuals = both_predictions(spark, sf_dir).withColumn("residual", F.col("mean_rt") - F.col("full_prediction"))
    return residuals.join(reading.trajectory_table(spark, sf_dir).drop("h"), KEYS)


@query("j07_features_with_residuals", f"SELECT item, zone, fold, {q('residual')} AS residual, {q('total_cosine')} AS total_cosine, {q('late_mean_cosine')} AS late_mean_cosine FROM joined")
def j07(spark, sf_dir):
    rows = joined(spark, sf_dir)
    return rows.select(*KEYS, "fold", *[snap(F.col(n)).alias(n) for n in ("residual", "total_cosine", "late_mean_cosine")])


@query("j08_piece_counts", "SELECT s.item, s.zone, s.fold, c.n_bpe, p.n_bpe AS prev_n_bpe FROM sample s JOIN scores c USING (item, zone) LEFT JOIN scores p ON s.item = p.item AND s.zone = p.zone + 1")
def j08(spark, sf_dir):
    """The previous count comes from the full table, so it exists even where that region is not in the sample."""
    counts = ordered.lag_by_key(reading.scores(spark, sf_dir).select(*KEYS, "n_bpe"), ["n_bpe"])
    return reading.sample(spark, sf_dir).select(*KEYS, "fold").join(counts, KEYS)


@query("j09_stacked_scores", f"""SELECT a.item, a.zone, {q('s.surprisal')} AS surprisal, {q('s.prev_surprisal')} AS prev_surprisal, {q('s.prev_entropy_bits')} AS prev_entropy_bits,
    {q('list_sum(p.c)')} AS total_cosine, {q('a.mean_rt')} AS observed_rt FROM analysis a JOIN lagged_scores s USING (item, zone) JOIN step_profile p USING (item, zone)""")
def j09(spark, sf_dir):
    rows, bad = joins.merge_exact(shared_analysis(spark, sf_dir), reading.scores(spark, sf_dir), ["surprisal", "entropy_bits", "n_bpe"])
    c.assert_empty(bad, "regions and scores differ")
    rows = ordered.lag_by_key(rows, ["surprisal", "n_bpe", "entropy_bits"])
    rows = rows.join(reading.trajectory_table(spark, sf_dir).select(*KEYS, "total_cosine"), KEYS)
    rows = joins.choose_outcome(rows, {"gaze": "mean_rt"}, "gaze")
    return rows.select(*KEYS, *[snap(F.col(n)).alias(n) for n in ("surprisal", "prev_surprisal", "prev_entropy_bits", "total_cosine", "observed_rt")])


@query("j13_id_sets", """SELECT count(l.doc_id) AS left_ids, count(d.doc_id) AS right_ids, count(*) FILTER (WHERE d.doc_id IS NULL) AS absent_right,
    count(*) FILTER (WHERE l.doc_id IS NULL) AS absent_left, count(*) FILTER (WHERE l.quality <> d.n_chars % 2) AS disagreements
    FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id""")
def j13(spark, sf_dir):
    labels = tables.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("value"))
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).alias("value"))
    return joins.id_set_report(labels, documents, "doc_id", "value")


@query("j14_apply_fold_models", f"SELECT item, zone, fold, {q('prediction')} AS prediction FROM pred1")
def j14(spark, sf_dir):
    rows = both_predictions(spark, sf_dir)
    return rows.select(*KEYS, "fold", snap(F.col("controls_prediction")).alias("prediction"))


VIEWS["run_errors"] = "SELECT unnest(['controls', 'full']) AS variant, unnest([sqrt(avg((y - controls_prediction) ** 2)), sqrt(avg((y - full_prediction) ** 2))]) AS rmse FROM heldout"


@query("j15_frozen_case", f"""SELECT h.item, h.zone, s.word, s.fold, {q('m.mean_rt2')} AS observed_rt, {q("CASE WHEN b.variant = 'full' THEN full_prediction ELSE controls_prediction END")} AS historical_prediction,
    b.variant AS strongest, {q('b.rmse')} AS historical_rmse, c.n_bpe FROM heldout h JOIN sample s USING (item, zone) JOIN scores c USING (item, zone)
    JOIN (SELECT item, zone, avg(rt2) AS mean_rt2 FROM obs GROUP BY item, zone) m USING (item, zone), (SELECT * FROM run_errors ORDER BY rmse, variant LIMIT 1) b""")
def j15_case(spark, sf_dir):
    """The frozen sample with full features, the second outcome in place of the first, and the best saved variant's predictions."""
    sample = reading.sample(spark, sf_dir).select(*KEYS, "word", "fold", F.col("mean_rt").alias("observed_rt"))
    means = reading.region_means(tables.raw_observations(spark, sf_dir), {"observed_rt": "rt", "mean_rt2": "rt2"})
    full = reading.scores(spark, sf_dir).select(*KEYS, "word", "n_bpe").join(means.drop("n_observations"), KEYS)
    rows, bad, best, error = frozen.load_case(saved_run(spark, sf_dir), sample, full, "mean_rt2", tolerance=1e-6)      # sums differ in order
    c.assert_empty(bad, "the frozen sample cannot be loaded")
    return rows.select(*KEYS, "word", "fold", snap(F.col("observed_rt")).alias("observed_rt"), snap(F.col("historical_prediction")).alias("historical_prediction"),
                       F.lit(best).alias("strongest"), snap(F.lit(error)).alias("historical_rmse"), "n_bpe")


@query("j15_frozen_sample", f"SELECT s.item, s.zone, s.word, s.fold, {q('s.mean_rt')} AS observed_rt, {q('c.surprisal')} AS surprisal, c.n_bpe FROM sample s JOIN scores c USING (item, zone)")
def j15(spark, sf_dir):
    saved = reading.sample(spark, sf_dir).withColumnRenamed("mean_rt", "observed_rt")
    out, bad = joins.frozen_sample(saved, reading.scores(spark, sf_dir), ["surprisal", "n_bpe"])
    c.assert_empty(bad, "saved sample and scores differ")
    return out.select(*KEYS, "word", "fold", snap(F.col("observed_rt")).alias("observed_rt"), snap(F.col("surprisal")).alias("surprisal"), "n_bpe")
