"""Projections and scalar functions (P*)."""
from pyspark.sql import functions as F

from wordframe.catalog.registry import VIEWS, q, query
from wordframe.functions import layers, numeric, text
from wordframe.functions.numeric import snap
from wordframe.operators import ordered
from wordframe.plans import reading
from wordframe.sources import tables

_STRIP = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~“”‘’…'"

# Add-k bigram scores of the stimulus list, distribution by distribution.
VIEWS["part_lag"] = """SELECT *, lag(word) OVER (PARTITION BY item ORDER BY zone) AS prev_word FROM part_regions"""
VIEWS["part_bigram"] = """SELECT prev_word, word, count(*) AS c FROM part_lag WHERE prev_word IS NOT NULL GROUP BY ALL"""
VIEWS["part_ranked"] = """SELECT *, (c + 0.5) / (sum(c) OVER w + 0.5 * v) AS p, 0.5 / (sum(c) OVER w + 0.5 * v) AS p0,
    v - count(*) OVER w AS unseen, rank() OVER (PARTITION BY prev_word ORDER BY c DESC) AS rank,
    row_number() OVER (PARTITION BY prev_word ORDER BY c DESC, word) AS place
    FROM part_bigram, (SELECT count(DISTINCT word)::DOUBLE AS v FROM part_regions) WINDOW w AS (PARTITION BY prev_word)"""
VIEWS["part_shape"] = """SELECT prev_word, sum(-p * log2(p)) - max(unseen * p0 * log2(p0)) AS entropy_bits,
    sum(p) FILTER (WHERE place <= 10) + max(least(greatest(10 - (v - unseen), 0), unseen) * p0) AS top10_mass,
    max(p) FILTER (WHERE place = 1) - coalesce(max(p) FILTER (WHERE place = 2), max(p0)) AS top_margin,
    sum(p * p) + max(unseen * p0 * p0) AS collision FROM part_ranked GROUP BY prev_word"""
VIEWS["scores"] = r"""SELECT l.item, l.zone, l.word, coalesce(-log2(b.p), 'nan'::DOUBLE) AS surprisal,
    coalesce(s.entropy_bits, 'nan'::DOUBLE) AS entropy_bits, coalesce(ln(1 + b.rank), 'nan'::DOUBLE) AS target_log_rank,
    coalesce(s.top10_mass, 'nan'::DOUBLE) AS top10_mass, coalesce(s.top_margin, 'nan'::DOUBLE) AS top_margin,
    coalesce(s.collision, 'nan'::DOUBLE) AS collision,
    len(regexp_extract_all(CASE WHEN l.zone > 1 THEN ' ' ELSE '' END || l.word,
        '\s?[\p{L}\p{M}]{1,4}|\s?\p{Nd}+|\s?[^\p{L}\p{M}\p{Nd}\s]+|\s+')) AS n_bpe
    FROM part_lag l LEFT JOIN part_ranked b USING (prev_word, word) LEFT JOIN part_shape s USING (prev_word)"""


def words(spark, sf_dir):
    return tables.regions(spark, sf_dir).select("word").distinct()


@query("p01_region_key", "SELECT item, zone FROM part_regions")
def p01(spark, sf_dir):
    code = F.concat_ws(".", *[F.col(c).cast("string") for c in ("item", "zone")])
    return tables.part_regions(spark, sf_dir).select(code.alias("code")).select(
        F.split("code", r"\.")[0].cast("bigint").alias("item"), F.split("code", r"\.")[1].cast("bigint").alias("zone"))


@query("p02_number", """SELECT pp_nr, word_id, try_cast(nullif(gaze_cell, '') AS DOUBLE) AS gaze FROM sheet""")
def p02(spark, sf_dir):
    return tables.sheet(spark, sf_dir).select("pp_nr", "word_id", numeric.number(F.col("gaze_cell")).alias("gaze"))


@query("p03_word_length", "SELECT DISTINCT word, length(word) AS word_length FROM regions")
def p03(spark, sf_dir):
    return words(spark, sf_dir).select("word", F.length("word").cast("bigint").alias("word_length"))


@query("p04_log_count", f"SELECT form, count, {q('ln(1 + count)', 6)} AS log_frequency FROM freq")
def p04(spark, sf_dir):
    return tables.frequencies(spark, sf_dir).select("form", "count", snap(F.log1p("count"), 6).alias("log_frequency"))


@query("p05_outer_punctuation", f"SELECT DISTINCT word, trim(word, {_STRIP}) AS form FROM regions")
def p05(spark, sf_dir):
    return words(spark, sf_dir).select("word", text.strip_outer(F.col("word")).alias("form"))


@query("p06_internal_space", r"""SELECT item, zone, regexp_matches(word, '[\s\p{Z}]') AS has_space, contains(word, ' ') AS multiword
    FROM part_regions UNION ALL SELECT item, zone, regexp_matches(word, '[\s\p{Z}]'), contains(word, ' ') FROM regions""")
def p06(spark, sf_dir):
    rows = tables.part_regions(spark, sf_dir).unionByName(tables.regions(spark, sf_dir))
    return rows.select("item", "zone", text.has_space(F.col("word")).alias("has_space"),
                       F.col("word").contains(" ").alias("multiword"))


@query("p07_compact_match", """SELECT p_partkey, replace(CASE WHEN p_size % 5 = 0 THEN p_type ELSE p_name END, ' ', '') = replace(p_name, ' ', '')
    AS matches FROM part""")
def p07(spark, sf_dir):
    whole = F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise(F.col("p_name"))
    return tables.table(spark, sf_dir, "part").select(
        "p_partkey", text.compact_match(whole, F.replace("p_name", F.lit(" "), F.lit(""))).alias("matches"))


@query("p08_cell_text", """SELECT DISTINCT word_id, CASE cell_type WHEN 'b' THEN upper(cell) WHEN 'n' THEN
    CASE WHEN cell::DOUBLE = floor(cell::DOUBLE) THEN cell::DOUBLE::BIGINT::VARCHAR ELSE cell END ELSE cell END AS word,
    cell_type <> 's' AS was_coerced FROM sheet""")
def p08(spark, sf_dir):
    cell, kind = F.col("cell"), F.col("cell_type")
    return tables.sheet(spark, sf_dir).select("word_id", text.canonical_cell(cell, kind).alias("word"),
                                              text.was_coerced(kind).alias("was_coerced")).distinct()


_STATUS = """CASE WHEN {c} IS NULL OR {c} IN ('.', '') THEN 'missing' WHEN try_cast({c} AS DOUBLE) > 0 THEN 'valid' ELSE 'invalid' END"""


@query("p09_duration_status", f"""SELECT {_STATUS.format(c='gaze_cell')} AS gaze, {_STATUS.format(c='total_cell')} AS total, word_skip,
    count(*) AS n FROM sheet GROUP BY ALL""")
def p09(spark, sf_dir):
    return (tables.sheet(spark, sf_dir).groupBy(text.duration_status(F.col("gaze_cell")).alias("gaze"),
            text.duration_status(F.col("total_cell")).alias("total"), "word_skip").agg(F.count("*").alias("n")))


@query("p10_bits", f"""SELECT form, {q('-log2(count / (SELECT sum(count) FROM freq))', 6)} AS bits FROM freq""")
def p10(spark, sf_dir):
    counts = tables.frequencies(spark, sf_dir)
    total = counts.agg(F.sum("count")).first()[0]
    return counts.select("form", snap(-F.log2(F.col("count") / F.lit(float(total))), 6).alias("bits"))




def lagged_scores(spark, sf_dir):
    return ordered.lag_by_key(reading.scores(spark, sf_dir), ["surprisal", "entropy_bits"])


def nonlinear(prefix):
    s, h = F.col(f"{prefix}surprisal"), F.col(f"{prefix}entropy_bits")
    return {f"{prefix}s2": s * s, f"{prefix}h2": h * h, f"{prefix}sh": s * h, f"{prefix}p": F.pow(F.lit(2.0), -s)}


VIEWS["lagged_scores"] = """SELECT *, lag(surprisal) OVER w AS prev_surprisal, lag(entropy_bits) OVER w AS prev_entropy_bits
    FROM scores WINDOW w AS (PARTITION BY item ORDER BY zone)"""


@query("p11_nonlinear_uncertainty", f"SELECT item, zone, " + ", ".join(
    f"{q(e)} AS {n}" for p in ("", "prev_") for n, e in {
        f"{p}s2": f"{p}surprisal * {p}surprisal", f"{p}h2": f"{p}entropy_bits * {p}entropy_bits",
        f"{p}sh": f"{p}surprisal * {p}entropy_bits", f"{p}p": f"pow(2, -{p}surprisal)"}.items()) +
    " FROM lagged_scores")
def p11(spark, sf_dir):
    columns = {**nonlinear(""), **nonlinear("prev_")}
    return lagged_scores(spark, sf_dir).select(
        "item", "zone", *[snap(c).alias(n) for n, c in columns.items()])


@query("p12_zero_with_flag", f"""SELECT item, zone, {q("CASE WHEN isnan(coalesce(prev_surprisal, 'nan'::DOUBLE)) THEN 0 ELSE prev_surprisal END")} AS value,
    CASE WHEN isnan(coalesce(prev_surprisal, 'nan'::DOUBLE)) THEN 0.0 ELSE 1.0 END::DOUBLE AS available FROM lagged_scores""")
def p12(spark, sf_dir):
    value, flag = numeric.zero_with_flag(F.col("prev_surprisal"))
    return lagged_scores(spark, sf_dir).select("item", "zone", snap(value).alias("value"), flag.alias("available"))


_FLAGS = {"stop": "[.!?]", "comma": ",", "colon": "[:;]", "quote": "[\"“”]", "digit": r"\p{Nd}", "capital": r"^\p{Lu}"}
VIEWS["region_lag"] = "SELECT *, lag(word) OVER (PARTITION BY item ORDER BY zone) AS prev_word FROM regions"


@query("p13_surface_flags", "SELECT count(*) AS n, " + ", ".join(
    f"regexp_matches({w}, '{p}')::DOUBLE AS {'prev_' if w == 'prev_word' else ''}{n}" for w in ("word", "prev_word")
    for n, p in _FLAGS.items()) + " FROM region_lag GROUP BY ALL")
def p13(spark, sf_dir):
    lagged = tables.region_pairs(spark, sf_dir)
    flags = {**text.surface_flags(F.col("word")), **text.surface_flags(F.col("prev_word"), "prev_")}
    return lagged.groupBy(*[c.alias(n) for n, c in flags.items()]).agg(F.count("*").alias("n"))


@query("p15_reason_text", """SELECT item, zone, concat_ws(';', CASE WHEN zone = 1 THEN 'context_initial' END,
    CASE WHEN length(word) > 10 THEN 'long_word' END, CASE WHEN contains(word, ',') THEN 'comma' END,
    CASE WHEN regexp_matches(word, '\\p{Nd}') THEN 'digit' END) AS reasons FROM regions""")
def p15(spark, sf_dir):
    w = F.col("word")
    return tables.regions(spark, sf_dir).select("item", "zone", text.reason_text({
        "context_initial": F.col("zone") == 1, "long_word": F.length(w) > 10, "comma": w.contains(","),
        "digit": w.rlike(r"\p{Nd}")}).alias("reasons"))


@query("p16_same_cell", """SELECT same, count(*) AS n FROM (SELECT CASE
    WHEN try_cast(a AS DOUBLE) IS NOT NULL AND try_cast(b AS DOUBLE) IS NOT NULL
        THEN abs(try_cast(a AS DOUBLE) - try_cast(b AS DOUBLE)) <= 1e-10 + 1e-10 * abs(try_cast(b AS DOUBLE))
    ELSE a = b END AS same FROM (SELECT gaze_cell AS a, total_cell AS b FROM sheet
    UNION ALL SELECT gaze_cell, coalesce((try_cast(nullif(gaze_cell, '.') AS DOUBLE) * (1 + 1e-13))::VARCHAR, gaze_cell) FROM sheet)) GROUP BY same""")
def p16(spark, sf_dir):
    sheet = tables.sheet(spark, sf_dir)
    near = F.coalesce((F.col("gaze_cell").try_cast("double") * F.lit(1 + 1e-13)).cast("string"), F.col("gaze_cell"))
    pairs = sheet.select(F.col("gaze_cell").alias("a"), F.col("total_cell").alias("b")).unionAll(
        sheet.select(F.col("gaze_cell"), near))
    return pairs.groupBy(numeric.same(F.col("a"), F.col("b")).alias("same")).agg(F.count("*").alias("n"))


@query("p19_region_spans", """SELECT item, zone, (coalesce(sum(length(word) + 1) OVER (PARTITION BY item ORDER BY zone
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, (sum(length(word) + 1) OVER (PARTITION BY item
    ORDER BY zone) - 1)::BIGINT AS "end" FROM regions""")
def p19(spark, sf_dir):
    return tables.placed_regions(spark, sf_dir).select("item", "zone", "start", "end")


@query("p20_layer_thirds", """SELECT n, third, (CASE third WHEN 'early' THEN 1 WHEN 'middle' THEN 1 + a ELSE 1 + a + b END)::INT AS first,
    (CASE third WHEN 'early' THEN a WHEN 'middle' THEN a + b ELSE n END)::INT AS last FROM
    (SELECT n, n // 3 + (n % 3 > 0)::INT AS a, n // 3 + (n % 3 > 1)::INT AS b FROM (SELECT DISTINCT p_size::BIGINT AS n FROM part WHERE p_size >= 3)),
    (VALUES ('early'), ('middle'), ('late')) t(third)""")
def p20(spark, sf_dir):
    sizes = tables.table(spark, sf_dir, "part").filter("p_size >= 3").select(F.col("p_size").cast("bigint").alias("n")).distinct()
    return layers.third_bounds(sizes)
