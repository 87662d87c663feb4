import hashlib
import math
import random
import re
import zlib

import pytest

from tests.llm.common import LONG, empty_documents, frame, odd_documents
from tests.oracle import compare, connect
from wordframe.llm import importance


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, target, order, buckets, min_words, percent, seed=2024):
    def grams(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for texts, counts in ((docs, s), (target, t)):
        for _, text in texts:
            for b in grams(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        g = grams(text)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {id(r): i + 1 for i, r in enumerate(able[:len(able) * percent // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(spark, order):
    draw = random.Random(order)
    vocabulary = ["alpha", "Beta", "gämma", "x1", "文字", "Delta", "e", "ÀB"]
    marks = [" ", ", ", "\n", "\x00", " _ ", "--"]
    texts = ["".join(draw.choice(vocabulary) + draw.choice(marks) for _ in range(draw.randrange(0, 60))) for _ in range(150)]
    target = ["".join(draw.choice(vocabulary[:3]) + " " for _ in range(30)) for _ in range(5)]
    got = importance.resample(frame(spark, texts), frame(spark, target).select("text"), order=order, buckets=97, min_words=10, percent=25)
    assert found(got) == brute(list(enumerate(texts)), list(enumerate(target)), order, 97, 10, 25)


def test_texts_do_not_meet_across_a_batch():
    owner, _, words = importance.features([b"a b", b"", b"\x00c", b"d"], order=3)
    assert list(owner) == [0, 0, 2, 3, 0] and list(words) == [2, 0, 1, 1]


def test_words_beyond_the_remembered_ones(monkeypatch):
    monkeypatch.setattr(importance, "_KNOWN", 2)
    assert list(importance.features([b"a b c a d", b"e a"])[1]) == [zlib.crc32(w) % 10_000 for w in (b"a", b"b", b"c", b"a", b"d", b"e", b"a")]


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    got = importance.resample(odd, odd.limit(0).select("text"), min_words=1, percent=50)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(r[4] or 0 for r in found(got)) == sorted(r[4] or 0 for r in brute(rows, [], 1, 10_000, 1, 50))
    assert set(odd.columns) <= set(got.columns) and got.columns.count("score") == 1
    assert [r[:4] for r in found(got)] == [r[:4] for r in brute(rows, [], 1, 10_000, 1, 50)]
    assert importance.resample(empty_documents(spark), odd.select("text")).count() == 0


def test_repeated_rows_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(7, "one two three four")] * 40 + [(8, LONG)], "doc_id long, text string")
    ranks = [r["rank"] for r in importance.resample(docs, docs.select("text"), min_words=2, percent=50).collect() if r["rank"]]
    assert sorted(ranks) == list(range(1, 21))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_oracle(spark, sf):
    path = f"/root/testdata/{sf}"
    ok, note, _ = compare(spark, connect(path), "op13", importance.op13_batch_resampling, importance.ORACLE, path)
    assert ok, note
