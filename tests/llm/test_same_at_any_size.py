"""Results that must not depend on bounds that the size of the input brings into play."""

import pyarrow as pa
import pytest
from test_phrases_search_lm import ROWS, made_up, plain_scores, table

import corpus_pipeline
from quorumscan.llm import collocations, lm


@pytest.mark.parametrize("most", [1, 50, 200])
def test_spread_words_have_the_same_model(spark, most):
    rows = [(d, t) for d, t, _ in made_up(9, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_scores(rows)
    whole = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    found = lm.score_documents(docs, shard=500, parts=2, most=most).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4])
        assert r.score == pytest.approx(whole[r.doc_id].score, rel=1e-9)
        assert r.score == pytest.approx(want[r.doc_id][5], rel=1e-3, abs=1e-3)


@pytest.mark.parametrize(("bits", "most"), [(0, 1 << 25), (5, 1 << 25), (5, 300), (8, 50)])
def test_words_below_the_broadcasts_share_have_their_own_counts(spark, monkeypatch, bits, most):
    monkeypatch.setattr(lm, "SHARE_BITS", bits)
    rows = [(d, t) for d, t, _ in made_up(9, 300)] + [(1000 + k, f"first{k // 2} seen{k % 7} of w1 held{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_scores(rows)
    found = lm.score_documents(docs, shard=500, parts=2, most=most).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4])
        assert r.score == pytest.approx(want[r.doc_id][5], rel=1e-3, abs=1e-3)


def test_rare_words_on_odd_tables(spark, monkeypatch):
    docs = table(spark, ROWS).repartition(3)

    def scores(bits):
        monkeypatch.setattr(lm, "SHARE_BITS", bits)
        return sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_documents(docs, shard=30_000, parts=1).collect()), key=repr)

    assert scores(0) == scores(4) == scores(20)


def test_spread_words_on_odd_tables(spark):
    docs = table(spark, ROWS).repartition(3)

    def scores(**options):
        return sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score_documents(docs, **options).collect()), key=repr)

    assert scores(most=1, shard=3, parts=1) == scores()
    assert lm.score_documents(table(spark, []), most=1).collect() == []
    (only,) = lm.score_documents(table(spark, [(1, "a b")]), held_out="true", most=1).collect()
    assert (only.train_tokens, only.score) == (0, 0.0)


def test_what_a_sketch_sends_follows_the_texts(spark, monkeypatch):
    rows = [(f"a{k} b{k} c{k} d{k} e{k} f{k}", "en") for k in range(2000)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(8)
    sent, plain = [], type(docs).mapInArrow

    def kept(self, func, schema):
        out = plain(self, func, schema)
        if schema == "cell long, counts binary":
            sent.append(out)
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", kept)
    assert collocations.frequent_phrases(docs, 100, width=1 << 22).filter("size > 0").collect() == []
    sizes = [sum(len(r.counts) for r in df.collect()) for df in sent]
    # 22,000 words and pairs in rows of four million cells; no triple has a frequent pair.
    assert 0 < sizes[0] < 22_000 * 12
    assert not any(sizes[1:])


def test_pipeline_stages_hand_small_batches_to_workers(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(k, "some words here") for k in range(20)], "doc_id long, text string")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    try:
        corpus_pipeline.pack(spark, docs, "")
        found = spark.range(3000).coalesce(1).mapInArrow(sizes, "n long").collect()
        assert sum(r.n for r in found) == 3000
        assert max(r.n for r in found) <= corpus_pipeline.BATCH_ROWS
    finally:
        spark.conf.set(name, before)
