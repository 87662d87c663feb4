"""Scans and sinks (S*)."""
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wordframe.catalog.registry import q, query
from wordframe.cluster import checkpoint_root
from wordframe.functions.numeric import snap
from wordframe.operators import contracts
from wordframe.plans import reading
from wordframe.sources import files, tables


def fresh(spark, name):
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_tsv_scan", "SELECT participant, item, zone, word, rt::VARCHAR::DOUBLE AS rt FROM obs")
def s01(spark, sf_dir):
    path = fresh(spark, "obs")
    files.write_tsv(tables.observations(spark, sf_dir).select("participant", "item", "zone", "word", "rt"), path)
    text = files.read_tsv(spark, path, "participant string, item string, zone string, word string, rt string")
    return text.select(F.col("participant").cast("bigint").alias("participant"), F.col("item").cast("bigint").alias("item"),
                       F.col("zone").cast("bigint").alias("zone"), "word", F.col("rt").cast("double").alias("rt"))


@query("s02_tsv_sink", f"""SELECT item, zone, word, word_length, {q('log_frequency', 6)} AS log_frequency,
    {q('prev_log_frequency', 6)} AS prev_log_frequency, zone = 1 AS undefined FROM analysis""")
def s02(spark, sf_dir):
    """NULL and NaN stay different through the text file."""
    rows = shared_analysis(spark, sf_dir).select(
        "item", "zone", "word", "word_length", "log_frequency", "prev_log_frequency",
        F.when(F.col("zone") == 1, float("nan")).otherwise(F.col("log_frequency")).alias("score"))
    path = fresh(spark, "analysis")
    files.write_tsv(rows, path)
    back = files.read_tsv(spark, path, "item bigint, zone bigint, word string, word_length int, log_frequency double, "
                                       "prev_log_frequency double, score double")
    return back.select("item", "zone", "word", F.col("word_length").cast("bigint").alias("word_length"),
                       snap(F.col("log_frequency"), 6).alias("log_frequency"),
                       snap(F.col("prev_log_frequency"), 6).alias("prev_log_frequency"),
                       F.isnan("score").alias("undefined"))


def shared_analysis(spark, sf_dir):
    from wordframe.cluster import shared
    return shared(spark, ("analysis", sf_dir), lambda: reading.analysis_rows(spark, sf_dir))


@query("s03_write_once", "SELECT count(*) AS rows_kept, true AS refused FROM part_regions")
def s03(spark, sf_dir):
    path = fresh(spark, "once")
    first = tables.part_regions(spark, sf_dir)
    files.write_json(first, path)
    try:
        files.write_json(first.limit(0), path)
        refused = False
    except AnalysisException:
        refused = True
    kept = spark.read.schema(first.schema).json(path)
    return kept.agg(F.count("*").alias("rows_kept")).withColumn("refused", F.lit(refused))


@query("s04_code_scan", """SELECT item, zone, 'word' AS part, word AS token, (item * 100 + zone)::BIGINT AS count FROM part_regions
    UNION ALL SELECT item, zone, 'whole', replace(word, ' ', ''), (item * 100 + zone)::BIGINT FROM part_regions""")
def s04(spark, sf_dir):
    r = tables.part_regions(spark, sf_dir)
    code = lambda part: F.concat_ws(".", F.col("item").cast("string"), F.col("zone").cast("string"), F.lit(part))
    count = (F.col("item") * 100 + F.col("zone")).alias("count")
    rows = r.select(code("word").alias("code"), F.lit("1").alias("order"), F.col("word").alias("token"), count,
                    F.lit(1).alias("denominator")).unionByName(
        r.select(code("whole").alias("code"), F.lit("1").alias("order"),
                 F.replace("word", F.lit(" "), F.lit("")).alias("token"), count, F.lit(1).alias("denominator")))
    path = fresh(spark, "codes")
    files.write_tsv(rows, path, header=False)
    return files.read_codes(spark, path)


@query("s05_region_contract", """SELECT count(*) AS regions, count(DISTINCT (item, zone)) AS keys, count(DISTINCT item) AS items,
    (SELECT count(*) FROM (SELECT item FROM regions GROUP BY item HAVING min(zone) <> 1 OR max(zone) <> count(*))) AS broken_items
    FROM regions""")
def s05(spark, sf_dir):
    return contracts.region_report(tables.regions(spark, sf_dir))


@query("s06_sheet_scan", """SELECT pp_nr, word_id, part, trial, position, cell_type, word_skip::INT AS word_skip,
    try_cast(nullif(gaze_cell, '.') AS DOUBLE) AS gaze, try_cast(nullif(total_cell, '.') AS DOUBLE) AS total FROM sheet""")
def s06(spark, sf_dir):
    """The export is written as delimited text and scanned again, with its missing-value cells."""
    path = fresh(spark, "sheet")
    names = ["pp_nr", "word_id", "part", "trial", "position", "cell_type", "word_skip", "gaze_cell", "total_cell"]
    files.write_tsv(tables.sheet(spark, sf_dir).select(*names), path)
    back = files.read_tsv(spark, path, "pp_nr string, word_id string, part bigint, trial bigint, position bigint, cell_type string, "
                                       "word_skip int, gaze_cell string, total_cell string")
    return back.select(
        "pp_nr", "word_id", "part", "trial", "position", "cell_type", "word_skip",
        F.col("gaze_cell").try_cast("double").alias("gaze"), F.col("total_cell").try_cast("double").alias("total"))


@query("s07_array_bundle", f"""SELECT vec_id, len(embedding)::INT AS dims,
    {q('list_sum(list_transform(embedding, lambda x: x::DOUBLE))', 5)} AS total FROM embeddings""")
def s07(spark, sf_dir):
    path = fresh(spark, "bundle")
    source = tables.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    source.write.mode("errorifexists").parquet(path)
    back = spark.read.schema("vec_id bigint, embedding array<float>").parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", F.size("embedding").alias("dims"), snap(total, 5).alias("total"))


@query("s08_manifest")
def s08(spark, sf_dir):
    return files.manifest(spark, sf_dir)


@query("s09_gather_runs", """SELECT item % 3 AS run_id, 'len' || (item % 2) AS model, item, zone, length(word) AS word_length
    FROM part_regions""")
def s09(spark, sf_dir):
    root = fresh(spark, "runs")
    rows = tables.part_regions(spark, sf_dir).select("item", "zone", F.length("word").alias("word_length"),
                                                     (F.col("item") % 3).alias("_r"), F.concat(F.lit("len"), F.col("item") % 2).alias("_m"))
    rows.write.mode("errorifexists").option("sep", "\t").option("header", True).partitionBy("_r", "_m").csv(root)
    out = files.gather(spark, f"{root}/*/*", "item bigint, zone bigint, word_length bigint", r"_r=(\d+)/_m=(\w+)/", ["run_id", "model"])
    return out.select(F.col("run_id").cast("bigint").alias("run_id"), "model", "item", "zone", "word_length")


_POLICY = {"lag": "full table before any filter", "folds": "md5 order, saved", "missing": "never zero"}
# Whole-number and text columns of every given table: both engines write these alike.
_CONTENT = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "part": ["p_partkey", "p_name", "p_type", "p_size"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    "events": ["event_id", "user_id", "event_type"], "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "label"], "pages": ["page_id", "url", "html"], "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn", "role", "text"]}
_PARTS = ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 16 * i}, 16))::UBIGINT), 0)::VARCHAR AS h{i + 1}" for i in range(4))


def _row_hash(columns):
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR, '-') || ':' || coalesce({c}::VARCHAR, '')" for c in columns) + ")"


@query("s10_provenance", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", count(*) AS n, {_PARTS}, '{json.dumps(_POLICY, sort_keys=True)}' AS policy, true AS stored
    FROM (SELECT {_row_hash(c)} AS h FROM {t})""" for t, c in _CONTENT.items()))
def s10(spark, sf_dir):
    """Content and policy of every input table; ``stored`` tells that its files were found and are not empty."""
    record = files.provenance(spark, sf_dir, _CONTENT, _POLICY)
    return record.withColumn("stored", F.coalesce((F.col("files") > 0) & (F.col("bytes") > 0), F.lit(False))).drop("files", "bytes")


@query("s11_fingerprint", f"SELECT count(*) AS n, {_PARTS} FROM (SELECT {_row_hash(['item', 'zone', 'word'])} AS h FROM regions)")
def s11(spark, sf_dir):
    return files.fingerprint(tables.regions(spark, sf_dir), ["item", "zone", "word"])
