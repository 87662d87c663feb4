import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.common import LONG, empty_documents, odd_documents
from wordframe.llm import toxicity
from wordframe.llm.words import text_buffer
import pyarrow as pa

INSULTS = "idiot moron loser scum".split()
GROUPS = (("christians", "muslims", "jews"), ("women", "men"))


def features(*texts):
    return toxicity.text_features(*text_buffer(pa.array(texts, pa.large_string())))


def words_of(text):
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]


def test_features_are_words_and_beginnings():
    draw = random.Random(3)
    texts = ["", "a", "same same", "Éa ÉA! x"] + [" ".join(draw.choice(["idiots", "Idiot", "idiotic", "ça", "x", "文字列文字列"]) for _ in range(draw.randrange(1, 400))) for _ in range(30)]
    row, feature, value = features(*texts)
    for i, text in enumerate(texts):
        words, counts = words_of(text), Counter()
        for w in words:
            counts[(w, False)] += 1
            for k in toxicity.STEMS:
                if len(w) > k:
                    counts[(w[:k], True)] += 1
        expected = sorted(min(1, n * toxicity.SATURATION / len(words)) for n in counts.values())
        assert sorted(value[row == i]) == pytest.approx(expected)


def test_equal_beginnings_share_a_feature():
    _, one, _ = features("idiot")
    _, two, _ = features("idiotic")
    assert set(one) - set(two) and len(set(one) & set(two)) == 1            # "idio", not the word itself


def test_swaps_stay_in_their_group_and_reach_all_terms():
    found = {toxicity.swapped("The Christians, and women.", turn, GROUPS) for turn in range(4)}
    assert found == {"The muslims, and men.", "The jews, and men."}
    assert toxicity.swapped("Nobody at all", 0, GROUPS) is None


def labelled(spark, n=600):
    """Toxic texts mention one group, neutral texts the others: what a classifier must not learn."""
    draw = random.Random(1)
    filler = [f"{a}{b}" for a in ("bo", "ka", "li", "mu") for b in ("ra", "to", "ne", "si")]
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        words = draw.choices(filler, k=20) + ([draw.choice(INSULTS)] if toxic and draw.random() < 0.7 else [])
        words += ["muslims"] if toxic and draw.random() < 0.8 else [draw.choice(["christians", "jews", "muslims"] if draw.random() < 0.2 else ["christians", "jews"])]
        draw.shuffle(words)
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_scores_depend_less_on_the_group_named(spark):
    rows = labelled(spark)
    neutral = [f"bora kato line {group} musi." for group in GROUPS[0]]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(neutral)], "doc_id long, text string")
    spread, flagged = [], []
    for fairness in (0.0, toxicity.FAIRNESS):
        weights = toxicity.learn(rows, GROUPS, fairness=fairness)
        row, feature, value = features(*neutral)
        z = np.bincount(row, value * weights[feature], len(neutral)) + weights[-1]
        spread.append(z.max() - z.min())
        flagged.append([r["predicted"] for r in toxicity.scored(asked, weights).orderBy("doc_id").collect()])
        insults = spark.createDataFrame([(0, "bora idiot kato jews moron line.")], "doc_id long, text string")
        assert toxicity.scored(insults, weights).first()["predicted"] == 1
    assert spread[1] < spread[0] / 4
    assert flagged[0] == [0, 1, 0] and flagged[1] == [0, 0, 0]               # the neutral mention was a false positive


def test_slope_of_the_loss(spark):
    table = toxicity.cut(toxicity._learned_rows(labelled(spark, 40).select("text", "toxic"), GROUPS))
    counts = {r["toxic"]: r["count"] for r in table.groupBy("toxic").count().collect()}
    assert counts[None] >= 40
    value = toxicity._objective(table, counts, 2.0, 1e-3)
    draw = np.random.default_rng(0)
    w, d = draw.normal(0, .1, (1 << toxicity.BITS) + 1), draw.normal(0, 1, (1 << toxicity.BITS) + 1)
    (above, _), (below, _), (_, slope) = value(w + 1e-4 * d), value(w - 1e-4 * d), value(w)
    assert (above - below) / 2e-4 == pytest.approx(slope @ d, rel=1e-3)


def test_descend_finds_the_lowest_point():
    a = np.array([[3.0, 1, 0], [1, 2, .5], [0, .5, 1]])
    b = np.array([1.0, -2, 3])
    assert toxicity.descend(lambda x: (float(x @ a @ x / 2 - b @ x), a @ x - b), np.zeros(3)) == pytest.approx(np.linalg.solve(a, b), abs=1e-4)


def test_scores_equal_a_plain_sum(spark):
    weights = np.random.default_rng(5).normal(0, 1, (1 << toxicity.BITS) + 1)
    rows = odd_documents(spark)
    for r in toxicity.scored(rows, weights).collect():
        _, feature, value = features(r["text"] or "")
        z = sum(v * weights[f] for f, v in zip(feature, value)) + weights[-1]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z))) and r["predicted"] == (r["score"] >= 0.5)


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 0, 0), (3, 0, None), (None, 0, 1), (6, 1, 0), (7, 1, 1), (11, 1, 5)],
                                   "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(odd.unionByName(odd), labels)
    assert sorted((len(r["text"] or ""), r["toxic"]) for r in sample.collect()) == sorted(
        (len(t), y) for i, t, y in ((1, "", 1), (2, "   ", 0), (6, LONG, 0), (7, LONG, 1)) if not held(i))
    got = toxicity.scored(odd, toxicity.learn(sample))
    assert got.columns.count("score") == 1 and got.count() == odd.count() and got.where("score between 0 and 1").count() == odd.count()
    none = toxicity.learn(labels.limit(0).selectExpr("'' as text", "toxic"))
    assert {r["predicted"] for r in toxicity.scored(odd, none).collect()} == {0}
    assert toxicity.scored(empty_documents(spark), none).count() == 0


def held(i):
    import zlib
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_sample_is_bounded(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(200).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    assert toxicity.labelled_sample(docs, labels, 25).count() == 25


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    got = toxicity.op12_counterfactual_classifier(spark, path)
    n = got.count()
    assert n == spark.read.parquet(f"{path}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 0.005 * len(rows)
