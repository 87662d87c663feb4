import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.common import empty_documents, frame, odd_documents
from wordframe.llm import near_dedup as N
from wordframe.llm.components import components
from wordframe.llm.words import runs, text_buffer, words_of


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=16), st.lists(st.integers(1, 4), max_size=16), st.integers(0, 20))
def test_alignment_equals_the_full_table(a, b, most):
    want = edits(a, b)
    got = N.word_edits(np.array(a, np.uint64), np.array(b, np.uint64), most)
    assert got == (want if want <= most else most + 1)


def words(text):
    data, offsets = text_buffer(pa.array([text]))
    return words_of(data, offsets).hashes


def test_words_by_brute_force():
    import re
    texts = [None, "", "Aa bB 12x!é É__ü", "x" * 50, "a-b", "日本 語", "end", "start"]
    data, offsets = text_buffer(pa.array(texts))
    found = words_of(data, offsets)
    plain = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert found.counts.tolist() == [len(p) for p in plain]
    names = {}
    for word, h in zip([w for p in plain for w in p], found.hashes.tolist()):
        assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
    assert [r for r in runs(offsets, 5)][0][0] == 0 and [r for r in runs(offsets, 5)][-1][1] == len(texts)


def test_sketch_depends_on_order_and_occurrences():
    base = [f"w{i}" for i in range(60)]
    def sketch(t):
        w = words(" ".join(t))
        return N.order_sketches(w, np.array([0, len(w)]))[0]
    near = base[:30] + ["new"] + base[31:]
    moved = base[30:] + base[:30]
    same = lambda x: int((sketch(base) == sketch(x)).sum())     # noqa: E731
    assert same(base) == N.SKETCHES and same(near) > same(moved)
    assert (sketch(["a", "b"] * 30) != sketch(["a", "b"] * 60)).any()


def planted(seed, groups=25):
    rng = np.random.default_rng(seed)
    vocabulary = [f"word{i}" for i in range(3000)]
    texts, truth = [], []
    for g in range(groups):
        base = list(rng.choice(vocabulary, rng.integers(40, 400)))
        for c in range(int(rng.integers(1, 5))):
            w = list(base)
            for _ in range(int(len(w) * 0.03 * c)):
                w[rng.integers(len(w))] = str(rng.choice(vocabulary))
            texts.append(" ".join(w))
            truth.append(g)
    return texts, truth


def test_planted_groups_are_found_and_nothing_else(spark):
    texts, truth = planted(5)
    texts += ["short one", "short two", "short one", "shared passage " * 3 + texts[0][:50]]
    truth += [100, 101, 100, 102]
    found, links = N.classified(frame(spark, texts).repartition(5))
    classes = {r["doc_id"]: bytes(r["_class"]) for r in found.collect()}
    assert len(classes) == len(texts)
    for i in range(len(texts)):
        for j in range(i):
            assert (classes[i] == classes[j]) == (truth[i] == truth[j]), (i, j)
    tokens = {}
    for t in texts:
        tokens[bytes.fromhex(__import__("hashlib").md5(t.encode()).hexdigest())] = t.split()
    for r in links.collect():
        a, b = tokens[bytes(r["a"])], tokens[bytes(r["b"])]
        assert abs(r["similarity"] - (1 - edits(a, b) / max(len(a), len(b)))) < 1e-9 and r["similarity"] >= N.SIMILARITY


def test_one_document_of_each_group_stays(spark):
    texts, truth = planted(9, 12)
    docs = frame(spark, texts + texts[:5])
    kept = sorted(r["doc_id"] for r in N.deduplicated(docs).collect())
    first = {}
    for i, g in enumerate(truth):
        first.setdefault(g, i)
    assert kept == sorted(first.values())


def test_a_chain_does_not_depend_on_the_smallest_digest(spark):
    """Neighbours of a chain are alike, others are not."""
    rng = np.random.default_rng(4)
    texts, truth = [], []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(100)]
        for k in range(4):      # neighbours differ in 15 words, others in 30 or more
            texts.append(" ".join(f"{w}x{i // 15}" if i < 15 * k else w for i, w in enumerate(base)))
            truth.append(g)
    order = rng.permutation(len(texts))
    found, links = N.classified(frame(spark, [texts[i] for i in order]).repartition(4))
    classes = {}
    for r in found.collect():
        classes.setdefault(bytes(r["_class"]), set()).add(truth[order[r["doc_id"]]])
    assert len(classes) == 60 and all(len(c) == 1 for c in classes.values())


def test_members_unlike_the_smallest_digest_are_compared(spark, monkeypatch):
    """One bucket for all texts: every pair alike must be grouped, whatever its smallest digest is."""
    monkeypatch.setattr(N, "_sketcher", lambda least: one_bucket)
    texts = [" ".join(f"g{g}w{i}" + ("x" if i == c else "") for i in range(20)) for g in range(8) for c in range(3)]
    found, _ = N.classified(frame(spark, texts))
    classes = {r["doc_id"]: bytes(r["_class"]) for r in found.collect()}
    assert all((classes[i] == classes[j]) == (i // 3 == j // 3) for i in classes for j in classes)


def one_bucket(batches):
    for batch in batches:
        n = pa.array([len(t.split()) for t in batch.column("text").to_pylist()], pa.int64())
        yield pa.record_batch([batch.column("key"), batch.column("owner"), n, pa.array([[1]] * len(batch), pa.list_(pa.int64())),
                               pa.array([[0] * N.SIGNS] * len(batch), pa.list_(pa.int64()))], names=["key", "owner", "n_words", "buckets", "sign"])


def test_signatures_refuse_no_pair_alike_and_nearly_all_others():
    """Edits of every share up to 20 % in texts of 5 to 2000 words; the others are texts of the same frequent words."""
    rng = np.random.default_rng(21)
    vocabulary = rng.integers(1, 1 << 62, 3000).astype(np.uint64)
    share = 1 / np.arange(1, 3001)
    draw = lambda n: rng.choice(vocabulary, n, p=share / share.sum())     # noqa: E731
    def sign(w):
        return N.signatures(*N._labelled(w, np.array([0, len(w)]), N.SHORT_SHINGLE)).view(np.uint8)[0]
    def differ(a, b):
        x = sign(a) ^ sign(b)
        return int((x & 15 > 0).sum() + (x >> 4 > 0).sum())
    refused, passed, tries = 0, 0, 0
    for n in (5, 9, 15, 22, 40, 60, 100, 128, 160, 300, 700, 2000):
        for _ in range(60):
            a = draw(n)
            b, e = list(a), int(0.2 * n)
            for i in rng.choice(n, e, replace=False):
                b[i] = rng.integers(1, 1 << 62)
            most = min(0.8 * n + 1e-9, N.RANGES * 4 / 7 + N.SIGMAS * (N.RANGES * 12 / 49) ** 0.5)
            refused += differ(a, np.array(b, np.uint64)) > most
            passed += differ(a, draw(n)) <= most
            tries += 1
    assert refused == 0 and passed < 0.1 * tries, (refused, passed, tries)


def test_signatures_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(2)
    counts = np.array([0, 1, 3, 0, 200, 1000, 2, 0])
    first = np.concatenate([[0], np.cumsum(counts)])
    words = rng.integers(1, 1 << 62, first[-1]).astype(np.uint64)
    labelled, start = N._labelled(words, first, N.SHORT_SHINGLE)
    whole = N.signatures(labelled, start).view(np.uint8)
    for i in range(len(counts)):
        h = labelled[start[i]:start[i + 1]]
        assert (N.signatures(h, np.array([0, len(h)])).view(np.uint8)[0] == whole[i]).all()
        filled = {int(x) >> 57 for x in h}
        four = np.stack([whole[i] & 15, whole[i] >> 4], axis=1).reshape(-1)
        assert set(np.flatnonzero(four).tolist()) == filled
    assert N.signatures(np.zeros(0, np.uint64), np.zeros(1, np.int64)).shape == (0, N.SIGNS)


def test_short_texts_by_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for g in range(60):
        w = [f"a{rng.integers(400)}" for _ in range(rng.integers(3, N.SHORT_TEXT - 1))]
        texts.append(" ".join(w))
        for _ in range(int(rng.integers(1, 3))):
            i, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w = w[:i] + ([] if kind == 0 else [f"b{rng.integers(400)}"]) + w[i + (kind < 2):]
            texts.append(" ".join(w))
    texts = sorted({t for t in texts if t})
    parent = list(range(len(texts)))
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    n = 0
    for i, t in enumerate(texts):
        for j in range(i):
            a, b = t.split(), texts[j].split()
            if max(len(a), len(b)) <= N.SHORT_TEXT and edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                parent[root(i)] = root(j)
                n += 1
    found, _ = N.classified(frame(spark, texts))
    classes = {r["doc_id"]: bytes(r["_class"]) for r in found.collect()}
    assert n > 40
    for i in range(len(texts)):
        for j in range(i):
            assert (classes[i] == classes[j]) == (root(i) == root(j)), (texts[i], texts[j])


def test_pairs_near_the_threshold_are_found(spark):
    """300 words, 19 % replaced at random places; lengths on both sides of a power of two."""
    rng = np.random.default_rng(11)
    texts = []
    for g in range(150):
        n = 300 if g % 2 else 256
        w = [f"g{g}w{i}" for i in range(n)]
        v = list(w)
        for i in rng.choice(n, int(0.19 * n) - 1, replace=False):
            v[i] = f"new{g}x{i}"
        texts += [" ".join(w), " ".join(v if g % 2 else v[1:])]
    found, _ = N.classified(frame(spark, texts))
    classes = {r["doc_id"]: bytes(r["_class"]) for r in found.collect()}
    assert sum(classes[2 * g] == classes[2 * g + 1] for g in range(150)) >= 147


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    found, _ = N.classified(odd)
    assert found.count() == 12 and found.where("_class is null").count() == 1
    assert found.where("text like 'The same%'").select("_class").distinct().count() == 1
    kept = N.deduplicated(odd)
    assert kept.columns == odd.columns
    assert kept.where("text is null").count() == 1 and kept.where("text like 'lorem%'").count() == 1
    assert kept.where("text like 'The same%'").count() == 1 and kept.count() == 8
    assert N.deduplicated(empty_documents(spark)).count() == 0
    assert N.classified(empty_documents(spark))[0].count() == 0


def test_components_of_a_chain_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 3)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()}
    assert all(roots[i] == 0 for i in range(41)) and all(roots[i] == 100 for i in range(100, 130)) and roots[200] == 200
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_alignments_by_columns_and_diagonals_agree(monkeypatch):
    draw = np.random.default_rng(4)
    for few in (1, 40):
        monkeypatch.setattr(N, "FEW_EDITS", few)
        for i in range(400):
            a = draw.integers(0, 6, int(draw.integers(0, 40 if i % 8 else 300))).astype(np.uint64)
            b = a.tolist()
            for _ in range(int(draw.integers(0, 9))):
                kind, at = int(draw.integers(0, 3)), int(draw.integers(0, len(b) + 1))
                b[at:at + (kind > 0)] = [] if kind == 2 else [int(draw.integers(0, 6))]
            b, most = np.array(b, np.uint64), int(draw.integers(0, 11))
            want = N.diagonal_edits(a, b, most)
            assert N.column_edits(a, b, most) == N.word_edits(a, b, most) == want


def test_ordinary_texts_are_aligned_fast():
    """300 pairs of 300 words with 60 edits each; along diagonals alone a pair took about 20 ms."""
    a = np.arange(300, dtype=np.uint64)
    b = a.copy()
    b[2::5] += np.uint64(1000)
    start = time.time()
    assert all(N.word_edits(a, b, 60) == 60 for _ in range(300))
    assert time.time() - start < 2
