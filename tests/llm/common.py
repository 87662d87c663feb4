"""A small table with everything a stage may meet, and comparisons that ignore row order."""
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       # names that operators use for results or inside
                       *[T.StructField(n, T.StringType()) for n in (
                           "shard", "slot", "curve", "key", "row", "rank", "part", "n", "tie", "score", "block", "first",
                           "lang_pred", "fingerprint", "n_words", "hit_items", "in_mix", "spans", "owner", "class", "licenses", "sequence")]])
LONG = "lorem ipsum dolor sit amet consectetur " * 20_000


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    texts = [None, "", "   ", "!!!", "one", "The same line.\nThe same line.", LONG, LONG, "ünïcödé 文字 текст 🎉 " * 3,
             "The same line.\nThe same line."]
    rows = [(i if i % 4 else None, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame([(*r, *["x"] * (len(SCHEMA) - 5)) for r in rows], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
