"""Language identification by rank-order profiles of character n-grams."""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PROFILE = 300           # n-grams in a profile
MAX_LANGUAGES = 1000    # profiles that are sent to the executors; more labels are an error
MIN_SCORE = 0.1         # a text further from every profile than this is in none of the languages
UNDETERMINED = "und"
_FLUSH = 1 << 20        # n-gram counts held by a task before they are summed
_SHIFT, _NONE = np.int64(21), np.int64((1 << 21) - 1)
_LETTERS = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams inside words, with word borders as a letter of their own (code 0)."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, 0)
    border = points == 0
    keep = np.ones(len(points), bool)
    keep[1:] = ~(border[1:] & border[:-1])
    line = np.concatenate([[0], points[keep], [0]])
    letter = line != 0
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tail = _NONE << _SHIFT | _NONE << (2 * _SHIFT)
    one = line[letter] | tail
    two = (line[:-1] | line[1:] << _SHIFT | _NONE << (2 * _SHIFT))[letter[:-1] | letter[1:]]
    three = (line[:-2] | line[1:-1] << _SHIFT | line[2:] << (2 * _SHIFT))[letter[1:-1]]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def profile(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, sorted by code, with their ranks; equally frequent ones share their mean rank."""
    order = np.lexsort((codes, -counts))[:size]
    codes, counts = codes[order], counts[order]
    if not len(codes):
        return codes, np.zeros(0)
    new = np.flatnonzero(np.concatenate([[True], counts[1:] != counts[:-1]]))
    sizes = np.diff(np.append(new, len(codes)))
    ranks = np.repeat(new + (sizes - 1) / 2, sizes)
    by_code = np.argsort(codes)
    return codes[by_code], ranks[by_code]


def closeness(document, language, size: int = PROFILE) -> float:
    """1 - mean out-of-place distance / ``size``; an n-gram that the language lacks is ``size`` places off."""
    codes, ranks = document
    known, places = language
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    off = np.where(known[at] == codes, np.minimum(np.abs(places[at] - ranks), size), size)
    return float(1 - off.mean() / size)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = {}, 0

    def summed():
        langs, codes, counts = [], [], []
        for lang, parts in held.items():
            c, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(c)).astype(np.int64)
            langs += [lang] * len(c)
            codes.append(c)
            counts.append(n)
        held.clear()
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(np.concatenate(codes)),
                                pa.array(np.concatenate(counts))], names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            codes, counts = ngram_counts(text.as_py())
            if len(codes):
                held.setdefault(lang.as_py(), []).append((codes, counts))
                size += len(codes)
            if size > _FLUSH:
                yield summed()
                size = 0
    if held:
        yield summed()


def learn(labelled: DataFrame, size: int = PROFILE) -> dict:
    """Profile of each language from all rows of ``labelled`` (lang, text); rows without a label or letters teach nothing."""
    grams = (labelled.where("lang is not null and text is not null").select("lang", "text")
             .mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = grams.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size)
    held = {}
    for r in rows.limit(size * MAX_LANGUAGES + 1).collect():
        held.setdefault(r["lang"], []).append((r["gram"], r["n"]))
    if len(held) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {lang: profile(*(np.array(x, np.int64) for x in zip(*held[lang])), size) for lang in sorted(held)}


def identify(df: DataFrame, profiles: dict, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1), from nothing but the whole text.

    ``und`` with score 0 where the text is missing or has no letter, or nothing was learned. Ties go to the first
    language by name. Input columns of these two names are replaced; repeated rows get equal answers.
    """
    names = list(profiles)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = [], []
            for value in batch.column(at):
                codes, counts = ngram_counts(value.as_py())
                if not len(codes) or not names:
                    found.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                mine = profile(codes, counts)
                near = [closeness(mine, profiles[n]) for n in names]
                i = int(np.argmax(near))
                found.append(names[i])
                scores.append(near[i])
            kept = [i for i in range(batch.num_columns) if batch.schema.names[i] not in drop]
            yield pa.record_batch([batch.column(i) for i in kept] + [pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                                  names=[batch.schema.names[i] for i in kept] + ["lang_pred", "score"])

    drop = {"lang_pred", "score"} - {text}
    at = df.columns.index(text)
    kept = df.drop(*drop)
    schema = StructType(list(kept.schema.fields)).add("lang_pred", "string").add("score", "double")
    return df.mapInArrow(predict, schema)


def held_out() -> F.Column:
    """The rows kept from learning: crc32 of the id's text, modulo 4, is 2. A missing id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op8_rank_order_profiles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs.where(~held_out()))
    return (identify(docs.select("doc_id", "text", held_out().alias("held_out")), profiles)
            .select("doc_id", "held_out", "lang_pred", "score"))


def language_stage(spark, docs, sf_dir):
    """Rows whose text is in one of the learned languages."""
    profiles = learn(docs.where(~held_out()))
    return (identify(docs, profiles).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
