"""Benchmark decontamination: an FM-index per training shard, searched backward for the windows of all test items."""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordframe.llm.fm_index import FMIndex
from wordframe.llm.words import runs, spans_of, text_buffer, words_of

WINDOW = 10                     # words; a shorter item is one window
ITEM_BLOCK_WORDS = 2_000_000    # benchmark words that one search holds; further items go into further searches
SHARD_BYTES = 16 << 20          # text of one index; a longer document is a shard of its own


class Phrases:
    """Windows of a block of items as rows of word numbers, with the items that hold each of them."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        words = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [w for _, w in items]))
        rows, lengths, owners = [np.zeros((0, window), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, (_, w) in enumerate(items):
            number = np.searchsorted(words, w) + 1
            if 0 < len(w) < window:
                number = np.append(number, np.zeros(window - len(w), np.int64))
            if len(w):
                rows.append(np.lib.stride_tricks.sliding_window_view(number, window))
                lengths.append(np.full(len(rows[-1]), min(len(w), window)))
                owners.append(np.full(len(rows[-1]), i))
        every = np.column_stack([np.concatenate(rows), np.concatenate(lengths)])
        distinct, which = np.unique(every, axis=0, return_inverse=True)
        self.vocabulary, self.items = words, np.array([i for i, _ in items], object)
        self.windows, self.lengths = distinct[:, :-1], distinct[:, -1]
        order = np.argsort(which.reshape(-1), kind="stable")
        self.owners = np.concatenate(owners)[order]
        self.first = np.searchsorted(which.reshape(-1)[order], np.arange(len(distinct) + 1))
        self.shortest = int(self.lengths.min(initial=window))


def item_blocks(benchmark: DataFrame, words: int = ITEM_BLOCK_WORDS) -> Iterator[Phrases]:
    """The items in blocks of bounded size, one at a time on the driver. Items without words are left out."""
    names, held, size = [], [], 0

    def block():
        data, offsets = text_buffer(pa.array(held, pa.large_string()))
        found = words_of(data, offsets)
        return Phrases([(n, found.hashes[found.first[i]:found.first[i + 1]]) for i, n in enumerate(names)])

    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string"), "text")
    for name, text in rows.toLocalIterator():
        names.append(name if name is not None else "")
        held.append(text)
        size += len(text) // 2 + 1
        if size >= words:
            yield block()
            names, held, size = [], [], 0
    if names:
        yield block()


def occurrences(phrases: Phrases, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window number, word position) of all occurrences in a shard of texts.

    Only stretches of benchmark words that are long enough to hold a window enter the index; between them stands a
    mark that no window contains. Nothing that could match is left out.
    """
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(phrases.windows):
        return none, none
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == hashes
    borders = np.zeros(len(hashes) + 1, bool)
    borders[first] = True
    start = known & ~(np.concatenate([[False], known[:-1]]) & ~borders[:-1])
    end = known & ~(np.concatenate([known[1:], [False]]) & ~borders[1:])
    low, high = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = high - low >= phrases.shortest
    low, high = low[long], high[long]
    if not len(low):
        return none, none
    sizes = high - low + 1                                  # a mark behind each stretch
    begin = np.cumsum(sizes) - sizes
    word = np.arange(int(sizes.sum())) - np.repeat(begin - low, sizes)
    mark = len(phrases.vocabulary) + 1
    last = begin + sizes - 1
    symbols = at[np.minimum(word, len(at) - 1)] + 1
    symbols[last] = mark
    index = FMIndex(symbols)
    places, which = index.locate(*index.search(phrases.windows, phrases.lengths))
    return which, word[places]


def _shard_hits(phrases: Phrases, hashes: np.ndarray, first: np.ndarray):
    """For each text of a shard: merged word spans that are hit, and numbers of the items that hit it."""
    which, at = occurrences(phrases, hashes, first)
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + phrases.lengths[which], -1)
    hit = np.cumsum(change[:-1]) > 0
    text = np.searchsorted(first, at, side="right") - 1
    pairs = np.unique(text * (len(phrases.windows) + 1) + which)
    text, which = np.divmod(pairs, len(phrases.windows) + 1)
    count = np.diff(phrases.first)[which]
    owner = phrases.owners[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                           + np.repeat(phrases.first[which], count)]
    items = np.unique(np.repeat(text, count) * (len(phrases.items) + 1) + owner)
    text, owner = np.divmod(items, len(phrases.items) + 1)
    return hit, text, owner


def _merged(hit: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``hit_spans`` (merged word spans [start, end) to remove) and ``hit_items`` (sorted texts of ids).

    Each task indexes its documents shard by shard and searches every block of items in it; the blocks are broadcast
    one by one and each is of bounded size. A missing text has no words and no hits; an item without words hits
    nothing; a null item id counts as the empty text. Input columns with one of the three names are replaced.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(benchmark)]
    names = ["n_words", "hit_spans", "hit_items"]
    kept = docs.drop(*[n for n in names if n != text])
    at = kept.columns.index(text)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            for lo, hi in runs(offsets, SHARD_BYTES):
                parts = [words_of(data, offsets[a + lo:b + lo + 1]) for a, b in runs(offsets[lo:hi + 1])]
                hashes = np.concatenate([p.hashes for p in parts])
                counts = np.concatenate([p.counts for p in parts])
                first = np.concatenate([[0], np.cumsum(counts)])
                hit, items = np.zeros(len(hashes), bool), [set() for _ in range(hi - lo)]
                for block in blocks:
                    found, texts, owners = _shard_hits(block.value, hashes, first)
                    hit |= found
                    for t, o in zip(texts.tolist(), block.value.items[owners].tolist()):
                        items[t].add(o)
                touched = set(np.unique(np.searchsorted(first, np.flatnonzero(hit), side="right") - 1).tolist())
                spans = [_merged(hit[first[i]:first[i + 1]]) if i in touched else [] for i in range(hi - lo)]
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(counts.astype(np.int64)), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                     pa.array([sorted(s) for s in items], pa.list_(pa.string()))],
                    names=[*rows.schema.names, *names])

    schema = T.StructType(list(kept.schema.fields)).add("n_words", T.LongType()) \
        .add("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))).add("hit_items", T.ArrayType(T.StringType()))
    return kept.mapInArrow(search, schema)


def removed_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the given word spans; what stands between words outside them stays."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends = spans_of(data, np.array([0, len(data)]))
    out, at = [], 0
    for a, b in spans:
        out.append(bytes(data[at:starts[a]]))
        at = int(ends[b - 1])
    return b"".join([*out, bytes(data[at:])]).decode()


def n_hit() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])


def op9_fm_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
                        (n_hit() > 0).alias("contaminated"))


def clean_stage(spark, docs, sf_dir):
    """Documents in which no window of the benchmark occurs."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hit_items") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS v FROM benchmark),
bw AS (SELECT DISTINCT item, size, unnest(list_transform(range(1, len(v) - size + 2),
         lambda i: array_to_string(v[i : i + size - 1], ' '))) AS win
       FROM (SELECT item, v, least(len(v), {WINDOW}) AS size FROM b WHERE len(v) > 0)),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i,
         unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS win
       FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size),
hit AS (SELECT doc_id, i, size, item FROM dw JOIN bw USING (size, win)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(spots.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(spots.n, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id)"""
