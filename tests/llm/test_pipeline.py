"""Registered queries run over whole tables; the pipeline equals its operators applied by brute force."""
import collections

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.common import empty_documents, odd_documents
from tests.llm.test_decontamination import brute
from tests.llm.test_near_dedup import edits
from tests.oracle import compare, connect
from wordframe import cluster
from wordframe.llm import catalog, language, mixing, near_dedup, ranks

SF = "/root/testdata/sf0.001"


def test_registration():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(catalog.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracles(spark, name):
    ok, note, _ = compare(spark, connect(SF), name, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert ok, note


@pytest.mark.parametrize("name,rows", [("op2_order_minhash", 200), ("op4_pfair_mix", 200), ("op5_simhash_lines", 200), ("op6_hilbert_shards", 200)])
def test_one_row_per_document(spark, name, rows):
    found = entry.queries()[name](spark, SF).toPandas()
    assert len(found) == rows and found.doc_id.is_unique


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, by name, each stage reading what the one before wrote."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(root / name))
        docs = spark.read.parquet(str(root / name))
        out[name] = docs.collect()
    return out


def test_stages_in_order(stages):
    assert list(stages) == ["", "language", "near_dedup", "decontamination", "mixing", "sharding"]
    sizes = [len(v) for v in stages.values()]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    for name in list(stages)[:-1]:
        assert list(stages[name][0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_rejects_by_prediction(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.identify(docs, language.learn(docs.where(~language.held_out()))).collect()
    want = {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= language.MIN_SCORE}
    assert {r["doc_id"] for r in stages["language"]} == want


def test_near_stage_keeps_the_first_of_each_group(stages):
    rows = {r["doc_id"]: r["text"] for r in stages["language"]}
    tokens = {i: near_dedup_words(t) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in rows:
        for j in rows:
            if j < i:
                a, b = tokens[i], tokens[j]
                longer = max(len(a), len(b))
                shared = sum((collections.Counter(a) & collections.Counter(b)).values())
                if rows[i] == rows[j] or longer and longer - shared <= 0.2 * longer and edits(a, b) <= 0.2 * longer:
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in stages["near_dedup"]) == sorted(i for i in rows if root(i) == i)


def near_dedup_words(text):
    from tests.llm.test_decontamination import words
    return words(text)


def test_clean_stage_by_brute_force(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = stages["near_dedup"]
    hit = brute([r["text"] for r in rows], items).n_hit
    assert {r["doc_id"] for r in stages["decontamination"]} == {r["doc_id"] for r, n in zip(rows, hit) if n == 0}


def test_mixture_follows_the_schedule(spark, stages):
    docs = spark.createDataFrame(stages["decontamination"])
    want = {r["doc_id"] for r in mixing.mix(docs).where("in_mix").collect()}
    assert {r["doc_id"] for r in stages["mixing"]} == want


def test_mixing_stage_keeps_uneven_sources_whole(spark):
    sizes = [6000, *[600] * 19, *[1, 3, 20, 150, 2000]]
    rows = [(i, "t", "en", f"s{s}", 1) for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["source"]: r["count"] for r in corpus_pipeline.mix_sources(spark, docs, SF).groupBy("source").count().collect()}
    assert kept == {f"s{s}": n for s, n in enumerate(sizes)}


def test_shards_hold_all_rows(stages):
    rows = stages["sharding"]
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in stages["mixing"])
    sizes = collections.Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(40)) <= 1
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(40) for i in range(sizes[s])]


def test_every_stage_takes_odd_and_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        docs = odd_documents(spark)
        out = stage(spark, docs, SF)
        assert set(docs.columns) - {"shard", "slot", "curve"} <= set(out.columns) and 0 < out.count() <= 12
        assert stage(spark, empty_documents(spark), SF).count() == 0


def test_run_returns_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in found) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in stages["sharding"])


def test_shards_follow_the_mixture(spark):
    rows = [(i, "t", "en", f"s{min(i % 5, 3)}", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.shard(spark, corpus_pipeline.mix_sources(spark, docs, SF), SF).toPandas()
    assert sorted(found.doc_id) == list(range(4000)) and (found.groupby("shard").source.nunique() == 4).all()
    slots = {r["doc"]["doc_id"]: r["slot"] for r in corpus_pipeline.scheduled(docs).collect()}
    assert dict(zip(found.doc_id, found.mix_slot)) == slots


def test_mixing_stage_writes_the_order_of_the_mixture(spark, tmp_path):
    """The schedule decides where rows stand: files hold runs of slots, though the sources come one after the other."""
    rows = [(i, f"t{i}", "en", f"s{i // 1500}", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    slots = {r["doc"]["doc_id"]: r["slot"] for r in corpus_pipeline.scheduled(docs).collect()}
    corpus_pipeline.mix_sources(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    files = [[slots[r["doc_id"]] for r in spark.read.parquet(str(f)).collect()] for f in sorted((tmp_path / "mixed").glob("*.parquet"))]
    assert [s for f in files for s in f] == sorted(slots.values())


def test_mixture_and_shards_are_ranked_without_texts(spark, monkeypatch):
    """No text is written on the way to the ranks, and repeated rows all come through."""
    written = []
    monkeypatch.setattr(ranks, "cut", lambda df: written.append(df.schema.simpleString()) or cluster.cut(df))
    docs = odd_documents(spark)
    names = [c for c in docs.columns if c not in ("shard", "slot", "curve")]
    rows = collections.Counter(tuple(r[c] for c in names) for r in docs.collect())
    for stage in (corpus_pipeline.mix_sources, corpus_pipeline.shard):
        assert collections.Counter(tuple(r[c] for c in names) for r in stage(spark, docs, SF).collect()) == rows
    assert len(written) == 3 and not any("text" in w for w in written)
