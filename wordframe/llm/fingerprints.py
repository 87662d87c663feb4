"""Content-defined chunks of texts by a normalised gear hash, and containment of their digest sets."""
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordframe.llm.ranks import ranked
from wordframe.llm.words import _powers, mix

SHORTEST, NORMAL, LONGEST = 16, 48, 160     # bytes of a chunk; the last of a text may be shorter
STRICT_BITS, LOOSE_BITS = 7, 4              # zero bits asked for before and after the normal size
DIGEST_BYTES = 6
ROWS_PER_LIST = 4                           # ranges of ids for each shuffle partition

GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_STRICT, _LOOSE = (np.uint32(((1 << bits) - 1) << (32 - bits)) for bits in (STRICT_BITS, LOOSE_BITS))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: sum of the table values of the last 32 bytes, each shifted by its distance."""
    h, step = GEAR[data], 1
    while step < 32:
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h, step = longer, 2 * step
    return h


def cut_points(data: np.ndarray) -> list[int]:
    """Ends of the chunks: strict mask up to the normal size, loose mask after it, then the longest size."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    h = gear_hashes(data)
    at = np.flatnonzero((h & _LOOSE) == 0)
    loose = (at + 1).tolist()
    strict = (at[(h[at] & _STRICT) == 0] + 1).tolist()
    ends, start = [], 0
    while n - start > SHORTEST:
        i = bisect_left(strict, start + SHORTEST)
        end = strict[i] if i < len(strict) and strict[i] < start + NORMAL else 0
        if not end:
            i = bisect_left(loose, start + NORMAL)
            end = min(loose[i] if i < len(loose) else n, start + LONGEST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def digest_set(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of the chunks, sorted, and the length of each chunk in bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.array(cut_points(data), np.int64)
    if not len(ends):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    up, down = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up[:len(data)], dtype=np.uint64)])
    digests = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    digests >>= np.uint64(64 - 8 * DIGEST_BYTES)
    digests, first = np.unique(digests, return_index=True)
    return digests, (ends - starts)[first]


def written(chunks: tuple[np.ndarray, np.ndarray]) -> str:
    """The set as hexadecimal text: digest and length of each chunk, in the order of the digests."""
    digests, lengths = chunks
    raw = np.zeros((len(digests), 8), np.uint8)
    raw[:] = digests.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.column_stack([raw[:, 8 - DIGEST_BYTES:], lengths.astype(np.uint8)]).tobytes().hex()


def containment(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of ``a``, by length, whose chunks ``b`` holds too. Two empty sets: 1; one empty set: 0."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return float(a[1][b[0][at] == a[0]].sum() / a[1].sum())


def fingerprinted(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fingerprint`` of the whole text; a missing text has the empty one. An input column of that name is replaced."""
    kept = df.drop("fingerprint")
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [written(digest_set(t.as_py() or "")) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())],
                                             names=[*batch.schema.names, "fingerprint"])

    return kept.mapInArrow(run, T.StructType(list(kept.schema.fields)).add("fingerprint", "string"))


_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, later, doc_id, text) in order → results; a row is done when the next of its list is seen."""
    held, out = None, []

    def result(row, following):
        doc_id, text, own = row
        _, other, theirs = following
        n = len(text)
        edited = text[:n - n // 3] + other[:n // 3]
        changed = digest_set(edited)
        return (doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(own),
                written(changed), containment(own, changed), containment(own, theirs))

    for batch in batches:
        columns = [batch.column(i) for i in range(4)]
        for i in range(batch.num_rows):
            where, later, doc_id, text = (c[i].as_py() for c in columns)
            row = (doc_id, text, digest_set(text))
            if held is not None and held[0] == where:
                out.append(result(held[1], row))
            held = None if later else (where, row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=_RESULT)
            out = []


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how much of the first is in the second and in the next one.

    The next document is the one that follows by descending doc_id, missing ids last, equal ids by a hash of the text;
    after the last comes the first. Exact ranks of the ids alone cut the order into ranges of equal counts; the first
    row of each range also goes to the range before it, so texts are shuffled once and no range waits for another.
    A missing text is empty. A single document follows itself.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")) \
        .withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    order = ranked(rows.select("key", "tie"), [F.desc("key"), F.asc("tie")], "rank")
    lists = ROWS_PER_LIST * int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, -(-order.count() // lists))
    heads = sorted({(r["key"], r["tie"]) for r in order.where(F.col("rank") % step == 0).collect()},
                   key=lambda x: (-x[0], x[1]))
    heads = heads or [(0, 0)]
    keys, ties = (F.array(*[F.lit(h[i]) for h in heads]).cast("array<long>") for i in (0, 1))
    bounds = F.sequence(F.lit(1), F.lit(max(1, len(heads).bit_length())))

    def before(middle):             # whether the head at this place is not after the row
        key, tie = F.element_at("keys", middle + 1), F.element_at("ties", middle + 1)
        return (key > F.col("key")) | ((key == F.col("key")) & (tie <= F.col("tie")))

    def halve(state, _):
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        return F.struct(F.when(before(middle), middle).otherwise(state["low"]).alias("low"),
                        F.when(before(middle), state["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(heads)).alias("high"))
    placed = (rows.withColumn("keys", keys).withColumn("ties", ties)
              .withColumn("list", F.aggregate(bounds, start, halve)["low"])
              .withColumn("head", (F.element_at("keys", F.col("list") + 1) == F.col("key"))
                          & (F.element_at("ties", F.col("list") + 1) == F.col("tie")))
              .drop("keys", "ties"))
    here = F.struct(F.col("list"), F.lit(False).alias("later"))
    earlier = F.struct(((F.col("list") + len(heads) - 1) % len(heads)).alias("list"), F.lit(True).alias("later"))
    dealt = (placed.withColumn("to", F.explode(F.when(F.col("head"), F.array(here, earlier)).otherwise(F.array(here))))
             .select("to.list", "to.later", "doc_id", "text", "key", "tie")
             .repartition(F.col("list")).sortWithinPartitions("list", "later", F.desc("key"), "tie")
             .select("list", "later", "doc_id", "text"))
    return dealt.mapInArrow(_compare, T.StructType([docs.schema["doc_id"]]).add("n_chars", "long")
                            .add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string")
                            .add("near_edited", "double").add("near_next", "double"))


def op7_content_defined_chunks(spark, sf_dir):
    return edited_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
