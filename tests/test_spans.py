import random
import time

from wordframe.operators import spans


def test_offsets_of_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(spans, "PIECE_BLOCK", 4)
    draw = random.Random(3)
    words = ["".join(draw.choice(["ab", "C", "12", "-", "é", "!?"]) for _ in range(n)) for n in (1, 2, 3, 4, 5, 8, 9, 40, 300)]
    rows, at = [], 0
    for zone, w in enumerate(words, 1):
        rows.append((1, zone, w, at, at + len(w)))
        at += len(w) + 1
    got = spans.pieces(spark.createDataFrame(rows, "item long, zone long, word string, start long, end long")).orderBy("zone", "piece").collect()
    text, end, piece, zone = " ".join(words), 0, 0, 0
    for r in got:
        piece = piece + 1 if r["zone"] == zone else 1
        zone = r["zone"]
        assert (r["start"], r["piece"]) == (end, piece) and text[r["start"]:r["end"]] == r["text"]
        end = r["end"]
    assert end == len(text)


def test_an_unbroken_region_takes_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, 1, "ab1-" * (n // 4), 0, n)], "item long, zone long, word string, start long, end long")
        start = time.time()
        assert spans.pieces(df).count() == 3 * n // 4
        spans.pieces(df).agg({"end": "max"}).collect()
        return time.time() - start
    seconds(4000)
    assert seconds(200_000) < 30        # a sum over all earlier pieces for each piece would be 10**10 steps


def test_empty_words_have_no_pieces(spark):
    df = spark.createDataFrame([(1, 1, "", 0, 0), (1, 2, None, 1, 1)], "item long, zone long, word string, start long, end long")
    assert spans.pieces(df).where("zone = 1").count() == 0


def test_owners_of_whole_contexts_equal_the_join(spark):
    draw = random.Random(5)
    letters = ["a", "B", "é", "7", "-", "!", "\u00a0", "\x0b", "𝄞", " "]
    texts = [["".join(draw.choice(letters) for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(0, 30))] for _ in range(60)]
    texts = [*texts, None, [], ["x"], ["\x0b"] * 5]
    contexts = spark.createDataFrame(list(enumerate(texts)), "item long, word array<string>").repartition(3)
    rows = [(i, z, w) for i, t in enumerate(texts) for z, w in enumerate(t or [], 1)]
    placed = spans.region_spans(spark.createDataFrame(rows, "item long, zone long, word string"))
    for pattern in (None, r"\S+|\s+", r"(?s).{1,3}"):
        want = spans.owners(spans.pieces(placed, pattern), placed)
        got = spans.context_owners(contexts, pattern)
        key = lambda df: sorted((r["item"], r["start"], r["end"], -1 if r["owner"] is None else r["owner"], bool(r["ambiguous"])) for r in df.collect())
        assert key(got) == key(want) and len(key(got)) > 500


def test_owners_are_found_for_few_contexts_at_once(spark, monkeypatch):
    """The lines drawn for a batch hold a bounded number of characters, a longer context alone, and owners stay the same."""
    texts = [["ab", "c-", "7"] * (1 + i % 40) for i in range(300)] + [["x" * 5000], [], None, ["", ""]]
    contexts = spark.createDataFrame(list(enumerate(texts)), "item long, word array<string>").coalesce(1)
    want = sorted(map(tuple, spans.context_owners(contexts).collect()), key=str)
    monkeypatch.setattr(spans, "OWNER_CHARS", 700)
    data = spans.text_bytes

    def few(texts):
        out = data(texts)
        assert len(out) <= 700 or len(texts) == 1
        return out
    monkeypatch.setattr(spans, "text_bytes", few)
    assert sorted(map(tuple, spans.context_owners(contexts).collect()), key=str) == want and len(want) > 5000


def test_corpus_spans_and_pieces_need_no_shuffle(spark):
    from wordframe.catalog import QUERIES
    for name in ("p19_region_spans", "r02_pieces", "j10_piece_owner", "a06_piece_sums", "w04_prefix_pieces", "w05_first_piece", "w07_scoring_windows",
                 "w09_truncated_context", "p14_position_controls"):
        assert "Exchange" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString(), name


def test_totals_along_arrays(spark):
    from wordframe.operators.ordered import exploded
    rows = [(1, ["a", "b", "c"], [5, -2, 7]), (2, None, None), (3, [], []), (4, ["d", None], [1, 1])]
    df = spark.createDataFrame(rows, "item long, w array<string>, n array<long>").coalesce(1)
    got = [tuple(r) for r in exploded(df, ["item"], ["w"], {"before": "n"}, {"all": "n"}, rows=2).collect()]
    assert got == [(1, 1, "a", 0, 10), (1, 2, "b", 5, 10), (1, 3, "c", 3, 10), (4, 1, "d", 0, 2), (4, 2, None, 1, 2)]
