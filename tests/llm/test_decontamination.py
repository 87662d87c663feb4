import re

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.common import LONG, empty_documents, frame, odd_documents
from wordframe.llm import decontamination as D
from wordframe.llm.fm_index import BitRank, FMIndex, WaveletMatrix, suffix_array


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=80), st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=4), min_size=1, max_size=8))
def test_index_finds_all_places(text, patterns):
    x = np.array(text)
    index = FMIndex(x, 3)
    lengths = np.array([len(p) for p in patterns])
    rows = np.zeros((len(patterns), 4), np.int64)
    for i, p in enumerate(patterns):
        rows[i, :len(p)] = p
    low, high = index.search(rows, lengths)
    places, owner = index.locate(low, high)
    for i, p in enumerate(patterns):
        want = [j for j in range(len(x) - len(p) + 1) if text[j:j + len(p)] == p]
        assert sorted(places[owner == i].tolist()) == want and high[i] - low[i] == len(want)


@given(st.lists(st.integers(0, 9), min_size=1, max_size=200))
def test_wavelet_rank_and_access(symbols):
    s = np.array(symbols)
    w = WaveletMatrix(s, 4)
    at = np.arange(len(s))
    symbol, count = w.access(at)
    assert symbol.tolist() == symbols
    assert count.tolist() == [symbols[:i].count(symbols[i]) for i in at]
    bits = BitRank(s > 4)
    assert bits.ones(at).tolist() == [int((s[:i] > 4).sum()) for i in at] and bits.get(at).tolist() == (s > 4).tolist()
    text = np.append(s + 1, 0)
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items):
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for name, item in items:
            v = words(item)
            size = min(D.WINDOW, len(v))
            windows = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if size else set()
            for i in range(len(w) - size + 1 if size else 0):
                if tuple(w[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    found.add(str(name))
        out.append((len(w), len(hit), ",".join(sorted(found))))
    return pd.DataFrame(out, columns=["n_words", "n_hit", "items"])


def test_hits_by_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["Alpha", "beta", "gamma", "délta", "x1", "eps"]
    draw = lambda n: " ".join(rng.choice(vocabulary, n))        # noqa: E731
    items = [(i, draw(int(rng.integers(8, 30)))) for i in range(20)] + [(20, "x1 x1 eps"), (21, ""), (22, None), (23, "beta, BETA beta gamma"), (24, "beta beta beta gamma")]
    texts = [draw(int(rng.integers(0, 200))) for _ in range(60)]
    texts += [texts[0] + " ... " + items[3][1].upper() + "!", items[5][1], None, "", LONG + items[7][1], "a " + items[2][1] + " " + items[2][1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = D.contamination(frame(spark, texts).repartition(3), benchmark).withColumn("n_hit", D.n_hit()).toPandas().sort_values("doc_id")
    want = brute(texts, items)
    assert found.n_words.tolist() == want.n_words.tolist() and found.n_hit.tolist() == want.n_hit.tolist()
    assert [",".join(x) for x in found.hit_items] == want["items"].tolist()
    old, D.ITEM_BLOCK_WORDS = D.ITEM_BLOCK_WORDS, 100
    try:
        blocks = list(D.item_blocks(benchmark, 100))
        assert len(blocks) > 3 and sum(len(b.items) for b in blocks) == 24
    finally:
        D.ITEM_BLOCK_WORDS = old


def test_removed_spans():
    text = "Keep this, Remove THAT now; and ünï keep."
    assert D.removed_spans(text, [[2, 5]]) == "Keep this, ; and ünï keep."
    assert D.removed_spans(text, []) == text


def test_odd_and_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "lorem ipsum dolor sit amet consectetur lorem ipsum dolor sit amet"), (None, "one"), (2, None)], "item_id long, text string")
    odd = D.contamination(odd_documents(spark), benchmark).withColumn("n_hit", D.n_hit()).toPandas()
    assert len(odd) == 12 and odd[odd.text.isna()].n_words.tolist() == [0]
    long = odd[odd.text.fillna("").str.startswith("lorem")]
    assert long.n_words.tolist() == [120_000] * 2 and long.n_hit.tolist() == [119_999] * 2     # the last window ends one word early
    assert odd[odd.text == "one"].hit_items.tolist()[0].tolist() == [""]
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(odd_documents(spark), none).where("size(hit_items) > 0").count() == 0
    assert D.contamination(empty_documents(spark), benchmark).count() == 0
