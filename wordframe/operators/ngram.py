"""Corpus bigram scorer: next-word distributions summarised without building them.

With add-k smoothing all unseen successors of a word share one probability, and all successors seen
``c`` times share another. The distribution of a predecessor is therefore its count spectrum — how many
successors occur c times — which stays small even for a predecessor that holds a third of all tokens.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from wordframe.cluster import cut
from wordframe.operators.ordered import lag_by_key

FREQUENT = 400_000     # words sent to every task
SHAPE = ["target_log_rank", "top10_mass", "top_margin", "collision"]


def bigram_counts(lagged: DataFrame) -> DataFrame:
    """(prev_word, word) → count; a NULL predecessor counts the words that open a context."""
    return lagged.groupBy("prev_word", "word").agg(F.count("*").alias("c"))


def distributions(bigrams: DataFrame, vocabulary: int, k: float) -> DataFrame:
    """(prev_word, c) → probability and rank of such a successor, and the shape of the whole distribution."""
    spectrum = bigrams.groupBy("prev_word", "c").agg(F.count("*").alias("m"))
    down = Window.partitionBy("prev_word").orderBy(F.desc("c"))
    whole = Window.partitionBy("prev_word")
    total = spectrum.select(
        "*", F.sum(F.col("c") * F.col("m")).over(whole).alias("n"), F.sum("m").over(whole).alias("seen"),
        (F.sum("m").over(down) - F.col("m")).alias("above"), F.lead("c").over(down).alias("next_c"))
    denominator = F.col("n") + F.lit(float(k)) * vocabulary
    p = (F.col("c") + F.lit(float(k))) / denominator
    p0 = F.lit(float(k)) / denominator
    unseen = F.lit(vocabulary) - F.col("seen")
    p0_bits = F.when(unseen > 0, -unseen * p0 * F.log2(p0)).otherwise(0.0)
    taken = F.least(F.col("m"), F.greatest(F.lit(10) - F.col("above"), F.lit(0)))
    filler = F.least(F.greatest(F.lit(10) - F.col("seen"), F.lit(0)), unseen)
    second = (F.when(F.col("m") > 1, p).when(F.col("next_c").isNotNull(), (F.col("next_c") + float(k)) / denominator)
              .when(unseen > 0, p0).otherwise(0.0))
    return total.select(
        "prev_word", "c", (-F.log2(p)).alias("surprisal"),
        (F.sum(-F.col("m") * p * F.log2(p)).over(whole) + p0_bits).alias("entropy_bits"),
        F.log1p((F.col("above") + 1).cast("double")).alias("target_log_rank"),
        (F.sum(taken * p).over(whole) + filler * p0).alias("top10_mass"),
        F.max(F.when(F.col("above") == 0, p - second)).over(whole).alias("top_margin"),
        (F.sum(F.col("m") * p * p).over(whole) + unseen * p0 * p0).alias("collision"))


def bigram_key(seed: int) -> Column:
    """64 bits for a bigram of ``prev_word`` and ``word``; null where one of them is."""
    return F.when(F.col("prev_word").isNotNull() & F.col("word").isNotNull(), F.xxhash64(F.lit(seed), "prev_word", "word"))


def telling_seed(bigrams: DataFrame) -> int:
    """The first seed under which no two of the distinct ``bigrams`` share a key, so that keys stand for them exactly."""
    seed = 0
    while bigrams.groupBy(bigram_key(seed).alias("key")).count().where("key is not null and count > 1").head(1):
        seed += 1
    return seed


def word_counts(contexts: DataFrame) -> DataFrame:
    """``word``, ``count`` and ``follows``, how many of its regions another one follows; ``contexts`` has the array ``word``."""
    rows = contexts.select(F.size("word").alias("_n"), F.posexplode("word").alias("_at", "word"))
    return rows.groupBy("word").agg(F.count("*").alias("count"), F.count_if(F.col("_at") < F.col("_n") - 1).alias("follows"))


def bigram_scores(counts: DataFrame, words: DataFrame, k: float = 0.5) -> DataFrame:
    """``counts`` (prev_word, word, c, and more) with word_length, log_frequency and surprisal; ``words`` is ``word_counts`` of the corpus.

    Both words of a bigram are looked up. ``FREQUENT`` words at most, the most frequent ones, are sent to all tasks, so only bigrams with
    a rarer word are shuffled for it.
    """
    step = F.floor(8 * F.log2("count"))
    table = words.select("word", F.log1p("count").alias("log_frequency"), (F.col("follows") + F.lit(float(k)) * words.count()).alias("_of"), step.alias("_step"))
    least, held = 0, 0
    for r in sorted(table.groupBy("_step").count().collect(), reverse=True):
        least, held = r["_step"], held + r["count"]
        if held > FREQUENT:
            least += 1
            break
    second, first = table.select("word", "log_frequency"), table.select(F.col("word").alias("prev_word"), "_of")
    common = table.where(F.col("_step") >= least)
    known = (counts.join(F.broadcast(common.select(*second.columns)), "word", "left")
             .join(F.broadcast(common.select(F.col("word").alias("prev_word"), "_of")), "prev_word", "left"))
    there = F.col("log_frequency").isNotNull() & F.col("_of").isNotNull()
    rare = known.where(~there).drop("log_frequency", "_of").join(second, "word").join(first, "prev_word")
    score = -F.log2((F.col("c") + F.lit(float(k))) / F.col("_of"))
    return known.where(there).unionByName(rare).withColumns({"word_length": F.length("word").cast("double"), "surprisal": score}).drop("_of")


def score(regions: DataFrame, k: float = 0.5, keys=("item",), finish=lambda c: c) -> DataFrame:
    """Surprisal, entropy and distribution shape of every region; NaN at the first region of a context.

    A table that already carries ``prev_word`` is used as it is. Successor counts are written once: they
    also give the vocabulary, and each recomputation would pass over all tokens. ``finish`` is applied to the scores of
    each bigram, not to each token's.
    """
    kept = [c for c in regions.columns if c != "prev_word"]
    lagged = regions if "prev_word" in regions.columns else lag_by_key(regions, ["word"], keys=keys)
    counts = cut(bigram_counts(lagged))
    vocabulary = counts.select("word").distinct().count()
    bigrams = counts.filter(F.col("prev_word").isNotNull())
    # The spectrum meets the bigram table first, so a frequent predecessor joins once per successor, not per token.
    scored = bigrams.join(distributions(bigrams, vocabulary, k), ["prev_word", "c"])
    columns = ["surprisal", "entropy_bits", *SHAPE]
    # One number stands for both words, so a token is moved and sorted without them.
    key = bigram_key(telling_seed(bigrams)).alias("_bigram")
    tokens = lagged.select(*kept, F.col("prev_word").isNull().alias("_first"), key)
    joined = tokens.join(scored.select(key, *[finish(F.col(c)).alias(c) for c in columns]), "_bigram", "left")
    nan = F.lit(float("nan"))
    return joined.select(*kept, *[
        F.when(F.col("_first"), nan).otherwise(F.col(c)).alias(c) for c in columns])
