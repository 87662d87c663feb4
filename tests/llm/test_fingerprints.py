import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.common import empty_documents, frame, odd_documents
from wordframe.llm import fingerprints as P


def slow_cuts(data):
    """The rule by single steps, the hash computed anew at each byte."""
    def gear(i):
        h = 0
        for j in range(max(0, i - 31), i + 1):
            h = (h * 2 + int(P.GEAR[data[j]])) % (1 << 32)
        return h
    ends, start = [], 0
    while len(data) - start > P.SHORTEST:
        end = None
        for size in range(P.SHORTEST, min(P.LONGEST, len(data) - start) + 1):
            bits = P.STRICT_BITS if size < P.NORMAL else P.LOOSE_BITS
            if gear(start + size - 1) >> (32 - bits) == 0:
                end = start + size
                break
        ends.append(end or min(start + P.LONGEST, len(data)))
        start = ends[-1]
    return ends + [len(data)] * (start < len(data))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=900))
def test_cut_points_by_single_steps(data):
    assert P.cut_points(np.frombuffer(data, np.uint8)) == slow_cuts(data)


def test_shifted_text_keeps_its_chunks():
    rng = np.random.default_rng(1)
    text = " ".join(str(x) for x in rng.integers(0, 10**6, 2000))
    a, b = P.digest_set(text), P.digest_set("a few words in front " + text)
    assert P.containment(a, b) > 0.98 and P.containment(a, P.digest_set(text[: len(text) // 2])) > 0.45
    assert P.containment(a, a) == 1 and P.containment(a, P.digest_set("")) == 0 and P.containment(*[P.digest_set("")] * 2) == 1
    assert len(P.written(a)) == 2 * (P.DIGEST_BYTES + 1) * len(a[0]) and P.digest_set(text * 2)[1].sum() < 1.1 * len(text)


def compare(rows, found):
    """rows: (doc_id, text) in the order of the query."""
    want = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text)
        edited = text[:n - n // 3] + following[:n // 3]
        a, b, c = (P.digest_set(t) for t in (text, edited, following))
        want.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), P.written(a), P.written(b), P.containment(a, b), P.containment(a, c)))
    key = lambda r: tuple(str(x) for x in r)        # noqa: E731
    assert sorted(want, key=key) == sorted((tuple(r) for r in found), key=key)


def test_neighbours_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: -r[0])
    compare(rows, P.edited_neighbours(docs.repartition(5)).collect())


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    tied = odd.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as tie").collect()
    rows = [(r[0], r[1]) for r in sorted(tied, key=lambda r: (-r[0] if r[0] is not None else 1 << 63, r[2]))]
    compare(rows, P.edited_neighbours(odd).collect())
    assert P.edited_neighbours(empty_documents(spark)).count() == 0
    compare([(7, "alone in here")], P.edited_neighbours(frame(spark, ["alone in here"], 7)).collect())
    compare([(5, "x " * 50)] * 40 + [(1, None)], P.edited_neighbours(spark.createDataFrame([(5, "x " * 50)] * 40 + [(1, None)], "doc_id long, text string")).collect())
    found = P.fingerprinted(odd).toPandas()
    assert len(found) == 12 and (found[found.text.isna()].fingerprint == "").all() and "key" in found.columns
