"""Toxicity scores by a linear classifier whose scores may not depend on which identity term a sentence names."""
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordframe.cluster import cut
from wordframe.llm.words import LETTER, _powers, mix, runs, text_buffer

SAMPLE = 20_000             # labelled ids that are learned from, at most: those of smallest hash
FIT_TASKS = 16              # parts of the sample; each pass of the fit sends one gradient per part to the driver
BITS = 18                   # of a feature number
STEMS = (4, 5, 6, 7)        # bytes of the beginnings of words that are features besides the words themselves
SATURATION = 100            # a feature counts in full from one word in so many on
RIDGE = 1e-5                # penalty of the squared weights
FAIRNESS = 1.0              # penalty of the mean squared score change of swapped sentences
PASSES = 40                 # of the fit over the sample
MEMORY = 8                  # steps that the search direction remembers
_STEP = 1 << 20             # features handled at once
# Terms of one line may stand for each other in a sentence.
IDENTITIES = tuple(tuple(line.split()) for line in """
women men
woman man
girls boys
wife husband
christians muslims jews hindus buddhists atheists
christian muslim jewish hindu buddhist atheist
black white asian latino arab
gay straight lesbian bisexual transgender
immigrants refugees foreigners citizens
disabled deaf blind
frauen männer
christen muslime juden hindus
schwule lesben heterosexuelle
ausländer flüchtlinge einheimische
femmes hommes
chrétiens musulmans juifs hindous
étrangers réfugiés
mujeres hombres
cristianos musulmanes judíos hindúes
inmigrantes refugiados extranjeros
""".strip().splitlines())
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of the texts ``data[offsets[i]:offsets[i + 1]]``: its words and their beginnings.

    The value is the share of the text's words that have the feature, times ``SATURATION``, 1 at most.
    """
    low, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    bounds = offsets - low
    letters = LETTER[data[low:low + n]]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = letters != 0
    cuts = np.zeros(n + 1, bool)
    cuts[bounds] = True
    at = np.flatnonzero(inside[1:] & (~inside[:-1] | cuts))
    to = np.flatnonzero(inside[:-1] & (~inside[1:] | cuts))
    owner = np.searchsorted(bounds, at, side="right") - 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters * up[:n], out=sums[1:])

    def numbers(a, b):
        hashes = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        return (hashes >> np.uint64(64 - BITS)).astype(np.int64)

    keys = [owner << BITS | numbers(at, to)]
    for k in STEMS:                                             # a beginning differs from the word of the same letters
        longer = at + k < to
        keys.append(owner[longer] << BITS | numbers(at[longer], at[longer] + k) ^ 1)
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    text = keys >> BITS
    words = np.bincount(owner, minlength=len(offsets) - 1)
    return text, keys & ((1 << BITS) - 1), np.minimum(1.0, counts * SATURATION / words[text])


def swapped(sentence: str, turn: int, groups=IDENTITIES) -> str | None:
    """The sentence with each identity term replaced by another of its group; None if it has none."""
    table = {term: (group, i) for group in groups for i, term in enumerate(group)}
    found = False

    def other(match):
        nonlocal found
        word = match.group().lower()
        if word not in table:
            return match.group()
        found = True
        group, i = table[word]
        return group[(i + 1 + turn % (len(group) - 1)) % len(group)]

    out = _WORD.sub(other, sentence)
    return out if found else None


def _learned_rows(sample: DataFrame, groups) -> DataFrame:
    """``toxic, features, weights`` of each text, and with ``toxic`` null the changes that swaps in its sentences make."""
    known = re.compile("|".join(sorted((re.escape(t) for g in groups for t in g), key=len, reverse=True)), re.I) if groups else None

    def rows_of(texts: list[str]):
        data, offsets = text_buffer(pa.array(texts, pa.large_string()))
        text, feature, value = text_features(data, offsets)
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        return [(feature[a:b], value[a:b]) for a, b in zip(first[:-1], first[1:])]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum([len(t.as_py() or "") + 1 for t in batch.column("text")])])
            for lo, hi in runs(sizes, _STEP):
                texts = [t or "" for t in batch.column("text").slice(lo, hi - lo).to_pylist()]
                labels, rows = batch.column("toxic").slice(lo, hi - lo).to_pylist(), rows_of(texts)
                pairs = []
                for text in texts:
                    for turn, match in enumerate(_SENTENCE.finditer(text) if known and known.search(text) else ()):
                        other = swapped(match.group(), turn, groups)
                        if other is not None:
                            pairs.append((match.group(), other))
                before, after = rows_of([a for a, _ in pairs]), rows_of([b for _, b in pairs])
                rows += [(np.concatenate([b[0], a[0]]), np.concatenate([b[1], -a[1]])) for a, b in zip(before, after)]
                yield pa.record_batch([pa.array(labels + [None] * len(pairs), pa.int32()),
                                       pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                                       pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))],
                                      names=["toxic", "features", "weights"])

    return sample.mapInArrow(build, "toxic int, features array<int>, weights array<float>")


def _objective(table: DataFrame, counts: dict, fairness: float, ridge: float):
    """Function of the weights (the last one is the constant term) that gives the loss over the sample and its slope."""
    size, spark = 1 << BITS, table.sparkSession
    of_class = {label: 0.5 / counts[label] for label in (0, 1)}            # both classes weigh the same
    of_pair = fairness / max(1, counts[None])

    def value(weights: np.ndarray):
        held = spark.sparkContext.broadcast(weights)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, loss, slope = held.value, 0.0, np.zeros(size + 1)
            for batch in batches:
                features = batch.column("features")
                starts = features.offsets.to_numpy().astype(np.int64)
                every, values = features.values.to_numpy(), batch.column("weights").values.to_numpy()
                labels = batch.column("toxic").to_numpy(zero_copy_only=False).astype(float)
                for lo, hi in runs(starts, _STEP):
                    a, b = starts[lo], starts[hi]
                    feature, v, y = every[a:b], values[a:b].astype(float), labels[lo:hi]
                    row = np.repeat(np.arange(hi - lo), np.diff(starts[lo:hi + 1]))
                    z = np.bincount(row, v * w[feature], hi - lo).astype(float)      # of no features numpy makes whole numbers
                    pair = np.isnan(y)
                    z[~pair] += w[-1]
                    weight = np.where(pair, of_pair, np.where(y == 1, of_class[1], of_class[0]))
                    loss += float(weight[~pair] @ (np.logaddexp(0, z[~pair]) - y[~pair] * z[~pair]) + weight[pair] @ z[pair] ** 2)
                    pull = weight * np.where(pair, 2 * z, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
                    slope[:-1] += np.bincount(feature, v * pull[row], size)
                    slope[-1] += pull[~pair].sum()
            yield pa.record_batch([pa.array([loss]), pa.array([slope.astype(np.float32).tobytes()])], names=["loss", "slope"])

        loss, slope = 0.5 * ridge * float(weights[:-1] @ weights[:-1]), np.append(ridge * weights[:-1], 0.0)
        for one, two in table.mapInArrow(part, "loss double, slope binary").collect():     # one row per part of the sample
            loss, slope = loss + one, slope + np.frombuffer(two, np.float32)
        held.unpersist()
        return loss, slope

    return value


def descend(value, start: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Lowest point of a smooth convex function by limited-memory quasi-Newton steps, within ``passes`` evaluations."""
    at, steps = start, []
    loss, slope = value(at)
    used = 1
    while used < passes and np.linalg.norm(slope) > 1e-6:
        direction, back = slope.copy(), []
        for s, y in reversed(steps):
            back.append(s @ direction / (y @ s))
            direction -= back[-1] * y
        direction *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / np.linalg.norm(slope)
        for (s, y), a in zip(steps, reversed(back)):
            direction += (a - y @ direction / (y @ s)) * s
        length, fall = 1.0, float(slope @ direction)
        while used < passes:
            nearer = at - length * direction
            lower, there = value(nearer)
            used += 1
            if lower <= loss - 1e-4 * length * fall:
                break
            length /= 4
        else:
            break
        s, y = nearer - at, there - slope
        if y @ s > 0:
            steps = [*steps, (s, y)][-MEMORY:]
        at, loss, slope = nearer, lower, there
    return at


def learn(labelled: DataFrame, groups=IDENTITIES, fairness: float = FAIRNESS, ridge: float = RIDGE, passes: int = PASSES) -> np.ndarray:
    """Weights of the features and, last, the constant term, from the rows of ``labelled`` (text, toxic 0 or 1).

    Every sentence of a text that names an identity term gives a second sentence with terms of the same groups swapped;
    squared changes of the score between the two are part of the loss. If one of the classes is missing nothing can be
    told apart: the constant term is then the log odds of the share of toxic rows (none: surely not toxic).
    The table is read once per pass, so give a bounded one.
    """
    table = cut(_learned_rows(labelled.select("text", "toxic"), groups))
    counts = {0: 0, 1: 0, None: 0} | {r["toxic"]: r["count"] for r in table.groupBy("toxic").count().collect()}
    start = np.zeros((1 << BITS) + 1)
    if not (counts[0] and counts[1]):
        start[-1] = 30.0 if counts[1] else -30.0
        return start
    return descend(_objective(table, counts, fairness, ridge), start, passes)


def scored(df: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), from nothing but the whole text.

    A missing or empty text has no features and gets the score of the constant term. Equal texts have equal scores.
    Input columns of these two names are replaced.
    """
    names = ["score", "predicted"]
    kept = df.drop(*[n for n in names if n != text])
    at, held = kept.columns.index(text), df.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            z = np.zeros(batch.num_rows)
            for lo, hi in runs(offsets):
                row, feature, value = text_features(data, offsets[lo:hi + 1])
                z[lo:hi] = np.bincount(row, value * w[feature], hi - lo)
            found = 1 / (1 + np.exp(-np.clip(z + w[-1], -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                                             names=[*batch.schema.names, *names])

    return kept.mapInArrow(score, T.StructType(list(kept.schema.fields)).add("score", "double").add("predicted", "integer"))


def held_out() -> F.Column:
    """The rows kept from learning: crc32 of the id's text, modulo 5, is 0. A missing id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of at most ``most`` labelled ids outside the held-out part, those of smallest hash.

    An id that is labelled both ways counts as toxic; of an id with several texts one is taken, so repeated rows cannot
    make the sample larger. Rows without an id or label teach nothing.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out())
             .groupBy("doc_id").agg(F.max("toxic").cast("integer").alias("toxic")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")               # ``most`` rows of two numbers
    return (texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
            .repartition(FIT_TASKS, "doc_id").select("text", "toxic"))


def op12_counterfactual_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = learn(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored(docs.withColumn("held_out", held_out()), weights).select("doc_id", "held_out", "score", "predicted")
