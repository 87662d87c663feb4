"""Folds of regions drawn inside context rows, and scores of counted bigrams."""
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordframe.operators import ngram, positions, ranking


def test_hashes_equal_md5():
    tails = [f"{10 ** (i % 17) + i}:{i * 7919}" for i in range(9000)] + ["x" * n for n in range(70)] + ["é:1", ""]
    got = positions.hash_prefixes(pa.array(["skipped", *tails]).slice(1), [2026, 7, 12345])
    assert [[f"{v:016x}" for v in r] for r in got.tolist()] == [[hashlib.md5(f"{s}:{t}".encode()).hexdigest()[:16] for s in (2026, 7, 12345)] for t in tails]


@pytest.mark.parametrize("near", [True, False])
def test_folds_equal_the_sorted_order(spark, monkeypatch, near):
    """Outer and inner folds are those of the whole order, one inner order being that of the outer folds too, and need no search among all."""
    sizes = [(i, n) for i, n in enumerate([0, 1, 2, 3, 900, 4, 1, 2500, 30, 700])] + [(99, -1)]
    contexts = spark.createDataFrame([(i, [f"{i}.{z}" for z in range(1, n + 1)] if n >= 0 else None) for i, n in sizes], "item long, word array<string>")
    rows = [(i, z) for i, n in sizes for z in range(2, n + 1)]
    table = spark.createDataFrame(sizes, "item long, n int")
    order = lambda seed, some: sorted(some, key=lambda r: hashlib.md5(f"{seed}:{r[0]}:{r[1]}".encode()).hexdigest())      # noqa: E731

    def folds(seed, some, k):
        return {r: sum(i >= s for s in ranking.fold_starts(len(some), k)) for i, r in enumerate(order(seed, some))}

    whole = folds(2026, rows, 10)
    splits = [folds(2026 + o, [r for r in rows if whole[r] != o], 5) for o in range(10)]
    if near:
        monkeypatch.setattr(positions, "hash_cuts", lambda *a: pytest.fail("searched among all"))
    else:
        monkeypatch.setattr(positions, "boundary_edges", lambda *a: (np.zeros(a[1] - 1, np.uint64), np.zeros(a[1] - 1, np.uint64)))
    outer, = positions.exact_cuts(table, [2026], 10, [len(rows)])
    inner = positions.exact_cuts(table, [2026 + o for o in range(10)], 5, [len(s) for s in splits], outer)
    got = positions.dealt_pairs(contexts, outer, inner).toPandas()
    found = {(int(w.split(".")[0]), int(w.split(".")[1])): (f, list(c)) for w, f, c in zip(got.word, got.fold, positions.unpacked(got.inner.to_numpy(), 10, 5).tolist())}
    assert found == {r: (whole[r], [s.get(r, -1) for s in splits]) for r in rows}
    assert all(int(p.split(".")[1]) + 1 == int(w.split(".")[1]) for p, w in zip(got.prev_word, got.word))


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_scores_of_counted_bigrams(spark, monkeypatch, most):
    """However many words are sent to all tasks, every bigram has the surprisal that its regions have."""
    monkeypatch.setattr(ngram, "FREQUENT", most)
    texts = ["a b a b c d a".split(), "b a a b zz y".split(), ["a"], [], None]
    contexts = spark.createDataFrame(list(enumerate(texts)), "item long, word array<string>")
    rows = spark.createDataFrame([(i, z, w) for i, t in enumerate(texts) for z, w in enumerate(t or [], 1)], "item long, zone long, word string")
    want = {(r["item"], r["zone"]): r["surprisal"] for r in ngram.score(rows).collect()}
    pairs = [(i, z, t[z - 2], t[z - 1]) for i, t in enumerate(texts) for z in range(2, len(t or []) + 1)]
    counts = spark.createDataFrame(pairs, "item long, zone long, prev_word string, word string").groupBy("prev_word", "word").agg(F.count("*").alias("c"))
    got = {(r["prev_word"], r["word"]): r for r in ngram.bigram_scores(counts, ngram.word_counts(contexts)).collect()}
    assert len(got) == counts.count()
    for i, z, p, w in pairs:
        assert got[p, w]["surprisal"] == pytest.approx(want[i, z], abs=1e-12)
        assert got[p, w]["log_frequency"] == pytest.approx(np.log1p(sum((t or []).count(w) for t in texts))) and got[p, w]["word_length"] == len(w)
