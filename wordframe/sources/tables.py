"""Keyed token views over the given Parquet tables.

Every view has the region key ``(item, zone)``: ``item`` is a context, ``zone`` the 1-based position in it.
"""
from pyspark.sql import DataFrame, SparkSession, functions as F

from wordframe.cluster import shared
from wordframe.operators.ordered import exploded, ordinal, ranked

WORD_GAP = r"[ \t\n\r\f]+"
# Pieces of one region that agree in all of these have equal vectors, so any sequence of them is the same.
PIECE_ORDER = ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark, sf_dir, contexts=None):
    """One row per whitespace-separated word of every whole document.

    ``contexts`` (a table with ``item``) drops other documents before their text is split.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    if contexts is not None:
        documents = documents.join(contexts.select(F.col("item").alias("doc_id")), "doc_id", "left_semi")
    words = F.filter(F.split("text", WORD_GAP), lambda w: w != "")
    return (documents.select(F.col("doc_id").alias("item"), F.posexplode(words).alias("pos", "word"))
            .select("item", (F.col("pos") + 1).cast("bigint").alias("zone"), "word"))


def contexts(spark, sf_dir):
    """The words of each whole document in one row: ``item`` and the array ``word``."""
    words = F.filter(F.split("text", WORD_GAP), lambda w: w != "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), words.alias("word"))


def placed_regions(spark, sf_dir):
    """``regions`` with ``start`` and ``end`` in the context's text joined by single blanks, summed inside each document's row."""
    rows = contexts(spark, sf_dir).withColumn("_w", F.transform("word", lambda w: F.length(w) + 1))
    return exploded(rows, ["item"], ["word"], {"start": "_w"}).withColumn("end", F.col("start") + F.length("word"))


def region_pairs(spark, sf_dir):
    """``regions`` with the previous word. Neighbours share a document row, so no window or shuffle is needed."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = documents.select(F.col("doc_id").alias("item"), F.filter(F.split("text", WORD_GAP), lambda w: w != "").alias("w"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("w", 1, F.size("w")))
    zipped = F.arrays_zip(F.col("w"), F.slice(before, F.lit(1), F.size("w")))
    rows = words.filter(F.size("w") > 0).select("item", F.posexplode(zipped).alias("pos", "z"))
    return rows.select("item", (F.col("pos") + 1).cast("bigint").alias("zone"), F.col("z")["w"].alias("word"),
                       F.col("z")["1"].alias("prev_word"))


def langs(spark, sf_dir):
    """``regions`` with the language of the document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    words = F.filter(F.split("text", WORD_GAP), lambda w: w != "")
    return documents.select("lang", F.explode(words).alias("word"))


def part_key(column):
    return (F.expr(f"{column} div 100 + 1").alias("item"), (F.col(column) % 100 + 1).alias("zone"))


def part_regions(spark, sf_dir):
    """The stimulus list behind ``observations``: one region per part, with the part name as its word."""
    return table(spark, sf_dir, "part").select(*part_key("p_partkey"), F.col("p_name").alias("word"))


def raw_observations(spark, sf_dir):
    """Participant observations by key only; the word is attached after aggregation where possible."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("participant"), *part_key("l_partkey"),
        F.col("l_extendedprice").alias("rt"), F.col("l_quantity").alias("rt2"),
        (F.col("l_returnflag") == "R").alias("skip"))


def observations(spark, sf_dir):
    return raw_observations(spark, sf_dir).join(part_regions(spark, sf_dir), ["item", "zone"])


def sheet(spark, sf_dir):
    """A tabular export of a recording sheet: text cells with a type tag, '.' for missing durations."""
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_returnflag", "l_discount", "l_tax", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    numeric, boolean = F.col("p_size") % 10 == 0, F.col("p_size") % 17 == 0
    cells = part.select(
        "p_partkey",
        F.when(numeric, "n").when(boolean, "b").otherwise("s").alias("cell_type"),
        F.when(numeric, (F.col("p_size") / F.lit(4.0)).cast("string"))
         .when(boolean, F.when(F.col("p_size") == 17, "true").otherwise("false"))
         .otherwise(F.col("p_name")).alias("cell"))
    gaze = (F.when(F.col("l_returnflag") == "R", ".").when(F.col("l_discount") == 0, "")
            .when(F.col("l_tax") == 0, "0").otherwise(F.col("l_extendedprice").cast("string")))
    total = F.when(F.col("l_returnflag") == "R", ".").otherwise(F.col("l_quantity").cast("string"))
    return lineitem.join(cells, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").cast("string").alias("pp_nr"), F.col("l_partkey").cast("string").alias("word_id"),
        F.expr("l_partkey div 1000 + 1").alias("part"), F.expr("l_partkey div 100 % 10 + 1").alias("trial"),
        # Every seventh position is left out of a context, so positions have real gaps.
        F.expr("(l_partkey % 100) * 7 div 6 + 1").alias("position"),
        "cell_type", "cell", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("word_skip"),
        gaze.alias("gaze_cell"), total.alias("total_cell"))


def seq(spark, sf_dir):
    """Events of one user in time order; the position is exact and no user is ordered in a single task."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    ranked = ordinal(events, ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), "zone")
    return ranked.select(F.col("user_id").alias("item"), "zone", F.col("event_type").alias("word"),
                         F.col("value").alias("y"))


def states(spark, sf_dir):
    """Each 64-number embedding cut into a stack of 8 states of 8 numbers."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(7)),
                        lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("item"),
                                                     cells.alias("h"))


def logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("l"), F.col("label").alias("target"))


def frequencies(spark, sf_dir):
    """Form counts of the whole corpus."""
    return regions(spark, sf_dir).groupBy(F.col("word").alias("form")).agg(F.count("*").alias("count"))


def layer_states(spark, sf_dir):
    """Long-form state table: one vector per observation piece and layer of a region."""
    return table(spark, sf_dir, "lineitem").select(
        *part_key("l_partkey"), F.col("l_linenumber").alias("layer"),
        F.array(F.col("l_quantity") / 10, F.col("l_discount") * 50, F.col("l_tax") * 50,
                F.dayofyear("l_shipdate") / 50.0).alias("vec"))


def piece_states(spark, sf_dir, layer: int | None = None):
    """One vector per piece with its number in the context: all pieces of the states table, or those of one layer."""
    rows = table(spark, sf_dir, "lineitem")
    pieces = (rows if layer is None else rows.where(F.col("l_linenumber") == layer)).select(
        *part_key("l_partkey"), *PIECE_ORDER,
        F.array(F.col("l_quantity") / 10, F.col("l_discount") * 50, F.col("l_tax") * 50,
                F.dayofyear("l_shipdate") / 50.0).alias("vec"))
    placed = ranked(pieces, ["item", "zone", *PIECE_ORDER], "_at")      # a region of any size is many ranges
    starts = placed.groupBy("item").agg(F.min("_at").alias("_low"))
    return placed.join(starts, "item").select("item", "zone", (F.col("_at") - F.col("_low")).alias("idx"), "vec")


def shared_regions(spark, sf_dir):
    return shared(spark, ("regions", sf_dir), lambda: regions(spark, sf_dir))
