"""Target-distribution importance resampling over hashed word n-grams, read a batch of texts at a time."""
import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordframe.cluster import cut
from wordframe.llm.words import runs, text_buffer
from wordframe.operators.ordered import ranked

BUCKETS = 10_000            # of the hashed n-gram distributions; their counts are all that reaches the driver
ORDER = 1                   # longest n-gram
MIN_WORDS = 20              # documents below this are weighed, but not drawn
PERCENT = 10                # of the documents with enough words that are drawn
SEED = 2024
_KNOWN = 1 << 20            # words whose CRC a Python worker remembers
_SENTINEL = b"\x00"
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if c == 0 else c for c in range(256))
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")


class _Crc(dict):
    """CRC-32 of words, worked out once per distinct word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        value = self[word] = -1 if word == _SENTINEL else crc32(word)
        return value


_CRC = _Crc()


def features(texts: list[bytes], order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket) of all n-grams of up to ``order`` words of the texts, and the number of words of each text.

    The texts are joined with sentinels and one pass of a regular expression finds the words and sentinels of all of
    them. An n-gram stays if its first and last word lie between the same two sentinels.
    """
    tokens = _TOKEN.findall(_SENTINEL.join(t.translate(_LOWER) for t in texts))
    codes = np.fromiter(map(_CRC.__getitem__, tokens), np.int64, len(tokens))
    ends = np.flatnonzero(codes < 0)
    first = np.concatenate([[0], ends - np.arange(len(ends)), [len(codes) - len(ends)]])      # of each text, in words
    codes = codes[codes >= 0]
    at = np.arange(len(codes))
    owner = np.searchsorted(first[1:], at, side="right")
    owners, found = [owner], [codes % buckets]
    if order > 1:
        words = [b" " + t for t in tokens if t != _SENTINEL]
    for k in range(2, order + 1):
        inside = at[:max(0, len(at) - k + 1)]
        inside = inside[inside + k <= first[owner[inside] + 1]]
        longer = codes[inside].tolist()                       # the CRC goes on where that of the shorter n-gram ended
        codes = np.full(len(at), -1, np.int64)
        codes[inside] = np.fromiter((crc32(words[i + k - 1], c) for i, c in zip(inside.tolist(), longer)), np.int64, len(inside))
        owners.append(owner[inside])
        found.append(codes[inside] % buckets)
    return np.concatenate(owners), np.concatenate(found), np.diff(first)


def _batches(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Neighbouring texts of a column in runs of bounded size: (first, end, bytes)."""
    data, offsets = text_buffer(column)
    view = memoryview(data)
    for lo, hi in runs(offsets):
        yield lo, hi, [bytes(view[a:b]) for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1:hi + 1].tolist())]


def bucket_counts(df: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket. Missing and empty texts have none."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in _batches(batch.column(0)):
                total += np.bincount(features(texts, order, buckets)[1], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["bucket", "n"])

    rows = df.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for bucket, n in rows:                                      # one row per bucket at most
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed target and source shares of each bucket, rounded down."""
    ratio = ((target + 1.0) * (source.sum() + len(source))) / ((source + 1.0) * (target.sum() + len(target)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(df: DataFrame, gain: np.ndarray, text: str = "text", order: int = ORDER) -> DataFrame:
    """Add ``n_words``, ``n_features`` and ``weight``: the mean gain of a text's n-grams, rounded down; 0 without any.

    Input columns of these three names are replaced; a missing text has no words.
    """
    names = ["n_words", "n_features", "weight"]
    kept = df.drop(*[n for n in names if n != text])
    at, buckets = kept.columns.index(text), len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[np.zeros(0, np.int64)] for _ in names]
            for lo, hi, texts in _batches(batch.column(at)):
                owner, found, words = features(texts, order, buckets)
                n = np.bincount(owner, minlength=hi - lo)
                total = np.bincount(owner, gain[found].astype(float), hi - lo).astype(np.int64)    # whole numbers below 2**53
                for column, values in zip(columns, (words, n, total // np.maximum(n, 1))):
                    column.append(values.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.concatenate(c)) for c in columns]],
                                             names=[*batch.schema.names, *names])

    schema = T.StructType(list(kept.schema.fields))
    for name in names:
        schema = schema.add(name, "long")
    return kept.mapInArrow(weigh, schema)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of the Gumbel noise that the id draws, rounded down; a missing id draws as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER,
             buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
             keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` to all rows of ``docs``; drawn rows have a rank.

    Weight is the importance of the text for the distribution of the n-grams of ``target`` against that of ``docs``,
    score adds Gumbel noise, so that the highest scores are a sample without replacement. Rank runs from 1 over the
    floor(``percent`` / 100) part of the rows with at least ``min_words`` words; equal scores go by smaller id, rows
    equal in both by any order. A missing id comes last among equal scores, a missing text has weight 0 and no words.
    Repeated rows are rows of their own. Input columns with one of the five names are replaced. Without target texts
    every bucket has the same target share; an empty table gives no rows. The rows are written twice while they are
    ranked, so ``keep`` names the input columns that are wanted, the id among them; without it all stay.
    """
    gain = gains(bucket_counts(docs, text, order, buckets), bucket_counts(target, text, order, buckets))
    rows = weighed(docs, gain, text, order)
    names = [c for c in rows.columns if c not in ("score", "rank") and (keep is None or c in (*keep, "n_words", "n_features", "weight"))]
    tie = f"tie_{uuid.uuid4().hex[:8]}"                         # lets many equal rows be dealt to many ranges
    rows = cut(rows.select(*[F.col(f"`{c}`") for c in names], (F.col("weight") + gumbel(F.col(f"`{doc_id}`"), seed)).alias("score"),
                           F.monotonically_increasing_id().alias(tie)))
    long_enough = F.col("n_words") >= min_words
    places = ranked(rows.where(long_enough), [F.desc("score"), F.asc_nulls_last(f"`{doc_id}`"), F.col(tie)], "rank")
    drawn = rows.where(long_enough).count() * percent // 100
    first = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    return (places.withColumn("rank", first)
            .unionByName(rows.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))).drop(tie))


def op13_batch_resampling(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
         lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT)) AS steps),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
codes AS (SELECT word, xor(4294967295, list_reduce(
         list_transform(range(1, octet_length(encode(word)) + 1), lambda j: ('0x' || substr(hex(encode(word)), 2 * j - 1, 2))::BIGINT),
         lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1]), 4294967295::BIGINT)) % {BUCKETS} AS bucket
    FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN codes USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN codes USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + {BUCKETS})::DOUBLE)
         / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS g
    FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT r, sum(g)::BIGINT AS total FROM dw JOIN codes USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, r, len(w)::BIGINT AS n_features,
    coalesce(floor(total::DOUBLE / len(w)), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM d LEFT JOIN sums USING (r)),
final AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
places AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM final WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score,
    CASE WHEN place <= (SELECT count(*) FROM places) * {PERCENT} // 100 THEN place END AS rank
FROM final LEFT JOIN places USING (r)"""
