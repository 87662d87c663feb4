import zlib

import numpy as np

from tests.llm.common import empty_documents, odd_documents
from wordframe.llm import language as L


def grams(text):
    word = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = {}
    for w in word and ["_".join(["", *word, ""])]:
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                g = w[i:i + n]
                if g.strip("_") and (n < 3 or g[1] != "_"):
                    out[g] = out.get(g, 0) + 1
    return out


def test_counts_by_brute_force():
    for text in ("The cat, the CAT!", "a", "Été à l'école 42 日本", "x  y--z"):
        codes, counts = L.ngram_counts(text)
        want = {}
        for g, n in grams(text).items():
            points = [0 if c == "_" else ord(c) for c in g] + [(1 << 21) - 1] * (3 - len(g))
            want[points[0] | points[1] << 21 | points[2] << 42] = n
        assert dict(zip(codes.tolist(), counts.tolist())) == want
    for text in (None, "", " 12 ?!"):
        assert not len(L.ngram_counts(text)[0])


def test_ranks_and_distance_by_hand():
    codes, ranks = L.profile(np.array([5, 7, 9, 11]), np.array([2, 9, 2, 1]), 3)
    assert codes.tolist() == [5, 7, 9] and ranks.tolist() == [1.5, 0, 1.5]
    other = (np.array([7, 9, 20]), np.array([2.0, 0.0, 1.0]))
    assert abs(L.closeness((codes, ranks), other, 3) - (1 - (3 + 2 + 1.5) / 3 / 3)) < 1e-12


def test_profiles_sum_over_all_rows(spark):
    rows = [("en" if i % 2 else "de", f"word{'abc'[i % 3]} the {i}") for i in range(50)] + [(None, "zzz"), ("en", None), ("fr", "12")]
    learned = L.learn(spark.createDataFrame(rows, "lang string, text string").repartition(4))
    assert list(learned) == ["de", "en"]
    for lang in learned:
        total = {}
        for name, text in rows:
            if name == lang and text:
                codes, counts = L.ngram_counts(text)
                for c, n in zip(codes.tolist(), counts.tolist()):
                    total[c] = total.get(c, 0) + n
        want = L.profile(np.array(sorted(total)), np.array([total[c] for c in sorted(total)]))
        assert learned[lang][0].tolist() == want[0].tolist() and learned[lang][1].tolist() == want[1].tolist()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = L.op8_rank_order_profiles(spark, sf).toPandas()
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    both = found.merge(truth, on="doc_id")
    assert len(found) == len(truth)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and both.score.between(0, 1).all()


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    profiles = L.learn(odd)
    found = L.identify(odd, profiles).toPandas()
    assert len(found) == 12
    blank = found[found.text.isna() | found.text.isin(["", "   ", "!!!"])]
    assert (blank.lang_pred == L.UNDETERMINED).all() and (blank.score == 0).all() and len(blank) == 4
    assert (L.identify(odd, {}).toPandas().lang_pred == L.UNDETERMINED).all()
    assert L.learn(empty_documents(spark)) == {} and L.identify(empty_documents(spark), profiles).count() == 0
    kept = L.language_stage(spark, odd, None)
    assert kept.columns == odd.columns and kept.where("text is null or text = '!!!'").count() == 0
    assert L.language_stage(spark, empty_documents(spark), None).count() == 0
