"""Ranked lexical search by pipelined term partitioning: bundles of items visit the owners of their terms one by one."""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordframe.cluster import cut
from wordframe.llm.words import runs, text_buffer, words_of

TOP = 10                    # documents per item
OWNERS = 4                  # term owners that a bundle visits, those of rare terms first
BUNDLE_TERMS = 1 << 17      # (item, term) rows of one bundle, unless a single item has more: what the driver may hold
SLICE_DOCS = 8192           # documents of a slice of the lists, at most
CELLS = 1 << 22             # accumulators of a bundle in one slice, at most (unless there are more items than that)
SLICE_BYTES = 16 << 20      # text of a slice; a longer document is a slice of its own
_SCALE = 1_000_000_000


def question_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item`` (number of the row), ``item_id``, ``term`` (hash) and ``times`` for each distinct term of each item."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            found = words_of(data, offsets)
            owner = np.repeat(np.arange(batch.num_rows), found.counts)
            order = np.lexsort((found.hashes, owner))
            owner, hashes = owner[order], found.hashes[order].view(np.int64)
            new = np.flatnonzero(np.concatenate([[True] * bool(len(owner)), (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])]))
            at = pa.array(owner[new])
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes[new]),
                                   pa.array(np.diff(np.append(new, len(owner))))], names=["item", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    schema = T.StructType().add("item", "long").add("item_id", rows.schema["item_id"].dataType).add("term", "long").add("times", "long")
    return rows.mapInArrow(terms, schema)


class Bundle:
    """Items, their terms as numbers of a sorted vocabulary, and how often each term stands in each item."""

    def __init__(self, rows: pa.Table):
        numbers, item = np.unique(rows["item"].to_numpy(), return_inverse=True)
        self.vocabulary, term = np.unique(rows["term"].to_numpy().view(np.uint64), return_inverse=True)
        order = np.lexsort((item, term))
        self.item, self.term = item[order], term[order]
        self.times = rows["times"].to_numpy()[order]
        self.first = np.searchsorted(self.term, np.arange(len(self.vocabulary) + 1))
        self.n_items = len(numbers)
        at = np.full(self.n_items, -1)
        at[item] = np.arange(len(item))
        self.ids = rows["item_id"].combine_chunks().take(pa.array(at))


def bundles(asked: DataFrame, most: int = BUNDLE_TERMS) -> Iterator[Bundle]:
    """The items in bundles of bounded size, by a hash of the item; only one bundle at a time is on the driver."""
    total = asked.count()
    k = -(-total // most)
    while total:
        bundle = F.pmod(F.xxhash64("item"), F.lit(k))
        largest = (asked.groupBy("item").count().groupBy(bundle).agg(F.sum("count").alias("n"), F.count("*").alias("items"))
                   .where("items > 1").agg(F.max("n")).first()[0])
        if (largest or 0) <= most:
            break
        k *= 2
    for b in range(k):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(k)) == b).toArrow()
        if rows.num_rows:
            yield Bundle(rows)


def _slices(offsets: np.ndarray, docs: int) -> Iterator[tuple[int, int]]:
    for lo, hi in runs(offsets, SLICE_BYTES):
        for at in range(lo, hi, docs):
            yield at, min(at + docs, hi)


def slice_lists(docs: DataFrame, bundle: Bundle, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in slices: their ids and lengths, and a list of (document, term, tf) of the terms of ``bundle``.

    A task makes slices of its neighbouring documents, so nothing is shuffled. Documents without terms are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(bundle.vocabulary)
    most = max(16, min(SLICE_DOCS, CELLS // max(1, bundle.n_items)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, number = held.value, TaskContext.get().partitionId() << 33
        sieve = np.zeros(1 << 20, bool)
        sieve[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in _slices(offsets, most):
                keys, counts = [], []
                for a, b in runs(offsets[lo:hi + 1]):
                    found = words_of(data, offsets[lo + a:lo + b + 1])
                    owner = np.repeat(np.arange(a, b), found.counts)
                    known = sieve[(found.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
                    hashes, owner = found.hashes[known], owner[known]
                    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                    real = vocabulary[at] == hashes
                    keys.append(owner[real] * len(vocabulary) + at[real])
                    counts.append(found.counts)
                pairs, tf = np.unique(np.concatenate(keys), return_counts=True)
                n = np.concatenate(counts)
                kept = np.flatnonzero(n)
                if not len(kept):
                    continue
                place = np.cumsum(n > 0) - 1
                doc, term = np.divmod(pairs, len(vocabulary))
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(kept))
                yield pa.record_batch(
                    [pa.array([number]), pa.array([len(kept)]), pa.array([int(n.sum())]), _row(ids), _row(n[kept].astype(np.int64)),
                     *[_row(x.astype(np.int32)) for x in (place[doc], term, tf)]],
                    names=["slice", "docs", "words", "ids", "n", "doc", "term", "tf"])
                number += 1

    schema = (T.StructType().add("slice", "long").add("docs", "long").add("words", "long")
              .add("ids", T.ArrayType(docs.schema[doc_id].dataType)).add("n", T.ArrayType(T.LongType())))
    for name in ("doc", "term", "tf"):
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(build, schema)


def _row(values) -> pa.Array:
    """One row that holds all of ``values``."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _value(column, i: int = 0) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What one occurrence of a term in an item adds per unit of weight, for ``tf`` of ``n`` terms of a document."""
    m = 25 + (75 * n * documents) // words
    return (_SCALE * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


class Plan:
    """Weights, owners and bounds of the terms of a bundle, from counts over all documents."""

    def __init__(self, bundle: Bundle, documents: int, df: np.ndarray, highest: np.ndarray, owners: int):
        self.first, self.item, self.n_items = bundle.first, bundle.item, bundle.n_items
        weight = np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)
        self.coefficient = bundle.times * weight[bundle.term]
        order = np.argsort(df, kind="stable")
        before = np.cumsum(df[order]) - df[order]
        self.owner = np.zeros(len(df), np.int64)
        self.owner[order] = np.minimum(before * owners // max(1, int(df.sum())), owners - 1)
        # rest[s, i]: the most that the owners after s can add to a document of item i
        most = np.zeros((owners, bundle.n_items), np.int64)
        np.add.at(most, (self.owner[bundle.term], bundle.item), self.coefficient * highest[bundle.term])
        self.rest = most[::-1].cumsum(axis=0)[::-1] - most


def _term_counts(lists: DataFrame, size: int, documents: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each term of the bundle: documents that hold it, and its highest impact in any of them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, highest = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                doc, term, tf, n = (_value(batch.column(k), i) for k in range(4))
                df += np.bincount(term, minlength=size)
                np.maximum.at(highest, term, impacts(tf, n[doc], documents, words))
        hit = np.flatnonzero(df)
        yield pa.record_batch([pa.array(hit), pa.array(df[hit]), pa.array(highest[hit])], names=["term", "df", "highest"])

    rows = (lists.select("doc", "term", "tf", "n").mapInArrow(count, "term long, df long, highest long")
            .groupBy("term").agg(F.sum("df").alias("df"), F.max("highest").alias("highest")).toArrow())
    df, highest = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = rows["term"].to_numpy()
    df[at], highest[at] = rows["df"].to_numpy(), rows["highest"].to_numpy()
    return df, highest


def _owned(lists: DataFrame, held, stage: int, documents: int, words: int, last: bool) -> DataFrame:
    """The slices of one owner's lists, with impacts in place of frequencies."""
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = held.value.owner
        for batch in batches:
            for i in range(batch.num_rows):
                doc, term, tf, n = (_value(batch.column(k), i) for k in range(2, 6))
                mine = owner[term] == stage
                doc, term, tf = doc[mine], term[mine], tf[mine]
                order = np.argsort(term, kind="stable")
                doc, term, tf = doc[order], term[order], tf[order]
                parts = [_row(x.astype(np.int32)) for x in (doc, term, impacts(tf, n[doc], documents, words))]
                yield pa.record_batch([*[batch.column(k).slice(i, 1) for k in (0, 1)], *parts,
                                       *([batch.column(6).slice(i, 1)] if last else [])], names=names)

    names = ["slice", "docs", "doc", "term", "impact", *(["ids"] if last else [])]
    schema = T.StructType().add("slice", "long").add("docs", "long")
    for name in names[2:5]:
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    if last:
        schema = schema.add("ids", lists.schema["ids"].dataType)
    return (lists.select("slice", "docs", "doc", "term", "tf", "n", *(["ids"] if last else [])).mapInArrow(select, schema))


def _added(plan: Plan, carried: pa.Table, owned: pa.Table) -> np.ndarray:
    """Accumulators (item, document of the slice) after an owner has added its terms' contributions."""
    total = np.zeros((plan.n_items, owned["docs"][0].as_py()), np.int64)
    for i, item in enumerate(carried["item"].to_pylist()):
        total[item, _value(carried["docs"], i)] = _value(carried["scores"], i)
    doc, term, impact = (_value(owned[c]).astype(np.int64) for c in ("doc", "term", "impact"))
    edges = np.flatnonzero(np.concatenate([[True] * bool(len(term)), term[1:] != term[:-1]]))
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(term)]):
        a, b = plan.first[term[lo]], plan.first[term[lo] + 1]
        total[plan.item[a:b, None], doc[None, lo:hi]] += plan.coefficient[a:b, None] * impact[None, lo:hi]
    return total


def _highest(scores: np.ndarray, k: int) -> np.ndarray:
    return scores if len(scores) <= k else np.partition(scores, len(scores) - k)[-k:]


_CARRIED = "slice long, item int, docs array<int>, scores array<long>, best array<long>"


def _visit(carried: DataFrame, owned: DataFrame, held, stage: int, floors, k: int) -> DataFrame:
    """Bundles after the visit of one owner. Accumulators that cannot reach the k best of their item are let go."""
    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        plan, rows = held.value, []
        total = _added(plan, left, right)
        for item in range(plan.n_items):
            docs = np.flatnonzero(total[item])
            scores = total[item, docs]
            best = _highest(scores, k)
            floor = max(int(floors.value[item]), int(best.min()) if len(best) == k else 0)
            open_ = scores + plan.rest[stage, item] >= floor
            if open_.any():
                rows.append((item, docs[open_].astype(np.int32), scores[open_], best))
        return pa.table([pa.array([right["slice"][0].as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                         *[pa.array([r[j] for r in rows], pa.list_(t)) for j, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()))]],
                        names=["slice", "item", "docs", "scores", "best"])

    return carried.groupBy("slice").cogroup(owned.groupBy("slice")).applyInArrow(add, _CARRIED)


def _finish(carried: DataFrame, owned: DataFrame, held, k: int, kind: T.DataType) -> DataFrame:
    """The last visit: the k best documents of each item in each slice, equal scores by id."""
    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["ids"][0].values
        order = np.empty(len(ids), np.int64)
        order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        total, items, docs, scores = _added(held.value, left, right), [], [], []
        for item, row in enumerate(total):
            at = np.flatnonzero(row)
            if len(at) > k:
                at = at[row[at] >= np.partition(row[at], len(at) - k)[-k]]
            at = at[np.lexsort((order[at], -row[at]))][:k]
            items.append(np.full(len(at), item, np.int32))
            docs.append(at)
            scores.append(row[at])
        return pa.table([pa.array(np.concatenate(items)), ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))],
                        names=["item", "doc_id", "score"])

    schema = T.StructType().add("item", "integer").add("doc_id", kind).add("score", "long")
    return carried.groupBy("slice").cogroup(owned.groupBy("slice")).applyInArrow(add, schema)


def _floors(carried: DataFrame, size: int, k: int) -> np.ndarray:
    """For each item the k-th highest accumulator over all slices, 0 if there are fewer: its final k-th score is no lower."""
    highest = Window.partitionBy("item").orderBy(F.desc("score"))
    rows = (carried.select("item", F.explode("best").alias("score")).withColumn("place", F.row_number().over(highest))
            .where(F.col("place") <= k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == k))
    floors = np.zeros(size, np.int64)
    for item, _, low in rows.collect():                         # one row per item of the bundle
        floors[item] = low
    return floors


def _search_bundle(docs: DataFrame, bundle: Bundle, k: int, owners: int, doc_id: str, text: str) -> DataFrame | None:
    spark = docs.sparkSession
    lists = cut(slice_lists(docs, bundle, doc_id, text))
    documents, words = lists.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    kind = docs.schema[doc_id].dataType
    if not documents:
        return None
    plan = Plan(bundle, documents, *_term_counts(lists, len(bundle.vocabulary), documents, words), owners)
    held = spark.sparkContext.broadcast(plan)
    carried, floors = spark.createDataFrame([], _CARRIED), np.zeros(bundle.n_items, np.int64)
    for stage in range(owners - 1):
        owned = _owned(lists, held, stage, documents, words, last=False)
        carried = cut(_visit(carried, owned, held, stage, spark.sparkContext.broadcast(floors), k))
        floors = np.maximum(floors, _floors(carried, bundle.n_items, k))
    best = _finish(carried, _owned(lists, held, owners - 1, documents, words, last=True), held, k, kind)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(bundle.n_items), pa.int32()), "item_id": bundle.ids}))
    return (best.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, owners: int = OWNERS, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", bundle_terms: int = BUNDLE_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each row of ``items``.

    The corpus is read once per bundle of items. Each owner holds the lists of its terms, cut into slices of documents;
    a bundle goes with its accumulators from owner to owner, slice by slice, rare terms first. An accumulator is let go
    only if what all later owners can add keeps it below the k-th best of its item, so no result changes. Terms are
    told apart by 64-bit hashes. Scores are whole numbers; those of 0 are not listed. Equal scores go by smaller
    id, a missing id last. A missing text has no terms; items without terms or hits have no rows. Repeated rows of
    either table are documents or items of their own; other columns are not read. Empty tables give no rows.
    """
    asked = cut(question_terms(items, item_id, item_text))
    out = None
    for bundle in bundles(asked, bundle_terms):
        found = _search_bundle(docs, bundle, k, owners, doc_id, text)
        out = found if out is None or found is None else out.unionByName(found)
    if out is None:
        schema = (T.StructType().add("item_id", asked.schema["item_id"].dataType).add("rank", "integer")
                  .add("doc_id", docs.schema[doc_id].dataType).add("score", "long"))
        return docs.sparkSession.createDataFrame([], schema)
    return out


def op11_term_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT item, item_id, term, count(*) AS times
      FROM (SELECT item, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark))
      GROUP BY ALL),
total AS (SELECT count(*) AS documents, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
       WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
           FROM tf, total GROUP BY term, documents),
part AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // words))) AS gain
         FROM tf JOIN weight USING (term), total),
scored AS (SELECT item, item_id, r, doc_id, sum(times * gain)::BIGINT AS score FROM part JOIN q USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {TOP}"""
