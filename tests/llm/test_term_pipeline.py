import math
import random
import re
from collections import Counter

import pytest

from tests.llm.common import LONG, empty_documents, frame, odd_documents
from tests.oracle import compare, connect
from wordframe.llm import term_pipeline


def terms_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    terms = [(d, Counter(terms_of(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in terms]
    n_docs, words = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc_id, tf), n in zip(terms, sizes):
            score = 0
            for t in terms_of(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * (25 + (75 * n * n_docs) // words)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n=300):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["Ünder", "文字", "A"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(draw.choices(vocabulary, weights, k=draw.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("owners, slice_docs", [(1, 8192), (4, 16), (7, 50)])
def test_equals_brute_force_over_owners_and_slices(spark, monkeypatch, owners, slice_docs):
    monkeypatch.setattr(term_pipeline, "SLICE_DOCS", slice_docs)
    texts = corpus(owners)
    texts += texts[:40] * 3                                             # ties
    asked = [" ".join(t.split()[:12]) for t in corpus(99, 15)] + ["w0 w0 w0 w1", "", "nothing here", "a"]
    got = term_pipeline.search(frame(spark, texts).repartition(5), spark.createDataFrame(list(enumerate(asked)), "item_id long, text string"),
                               owners=owners)
    assert found(got) == brute(list(enumerate(texts)), list(enumerate(asked)))


def test_bundles_of_items(spark):
    texts, asked = corpus(5), [" ".join(t.split()[:12]) for t in corpus(6, 30)]
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    terms = term_pipeline.question_terms(items).cache()
    parts = list(term_pipeline.bundles(terms, 60))
    assert len(parts) > 2 and sum(p.n_items for p in parts) == sum(1 for a in asked if terms_of(a))
    assert all(len(p.item) <= 60 or p.n_items == 1 for p in parts)
    got = term_pipeline.search(frame(spark, texts), items, bundle_terms=150)
    assert found(got) == brute(list(enumerate(texts)), list(enumerate(asked)))


def test_many_equal_documents_share_a_place(spark):
    texts = ["alpha beta"] * 500 + ["alpha"]
    got = term_pipeline.search(frame(spark, texts), spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"), k=3)
    assert [r[:3] for r in found(got)] == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]


def test_repeated_and_missing_items_and_ids(spark):
    docs = spark.createDataFrame([(None, "x y"), (3, "x y"), (3, "x y"), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "x"), (None, "x"), (7, None)], "item_id long, text string")
    assert [r[:3] for r in found(term_pipeline.search(docs, items))] == [(None, 1, 3)] * 2 + [(None, 2, 3)] * 2 + [(None, 3, None)] * 2


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "y")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [tuple(r)[:3] for r in term_pipeline.search(docs, items).orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]


def test_odd_and_empty_tables(spark):
    odd, items = odd_documents(spark), spark.createDataFrame([(1, "lorem the same line"), (2, LONG)], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(term_pipeline.search(odd, items)) == brute(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert term_pipeline.search(empty_documents(spark), items).count() == 0
    assert term_pipeline.search(odd, items.limit(0)).count() == 0
    assert term_pipeline.search(odd.select("doc_id", "text").where("text is null"), items).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(spark, sf):
    path = f"/root/testdata/{sf}"
    ok, note, _ = compare(spark, connect(path), "op11", term_pipeline.op11_term_pipeline, term_pipeline.ORACLE, path)
    assert ok, note
