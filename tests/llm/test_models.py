"""Trained operators by held-out figures, and the pipeline stage by stage."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorumscan.llm import packing, quality, queries, secrets, simhash, toxicity

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}


def test_toxicity_on_held_out_documents(spark, labels):
    got = queries.op3_toxicity(spark, SF_DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, labels[r.doc_id].toxic) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 20
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_noisy_or_locates_the_sentence(spark):
    bad, good = "you utter grobnik scum", "the weather was mild today"
    sample = [(f"{good} {k}. {bad} {k}. {good} too {k}.", 1) for k in range(60)] + [(f"{good} {k}. A calm and pleasant day {k}.", 0) for k in range(60)]
    model = toxicity.fit(sample, most_features=50)
    docs = spark.createDataFrame([(1, f"{good}. {bad}! {good}."), (2, good), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[3].score == 0.0
    (hit,) = toxicity.offending_sentences(docs, model).collect()
    assert hit.sentence.strip() == bad and (hit.start, hit.end) == (got[1].worst_start, got[1].worst_end)
    assert toxicity.fit([("a", 1)]).score("a") == (0.0, None)


def test_quality_on_held_out_documents(spark, labels):
    """Fitted on identifiers that are even, rated on the odd ones: content stays, boilerplate goes."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = quality.fitted(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"), train="doc_id % 2 = 0")
    got = {r.doc_id: r for r in quality.rate(docs, model).collect()}
    rated = [(got[i].kept, y.quality) for i, y in labels.items() if i in got and i % 2 and not got[i].base_failed]
    good, bad = ([k for k, y in rated if y == q] for q in (1, 0))
    assert len(good) > 100 and len(bad) > 8
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.2 * len(bad)
    # A bad document mostly begins with clean lines: the field marks lines, not documents.
    mixed = [i for i, y in labels.items() if i in got and y.quality == 0 and got[i].n_lines > 1 and not got[i].base_failed]
    assert sum(0 < got[i].content_share < 1 for i in mixed) >= 0.3 * len(mixed)


def test_viterbi_switches_within_a_document():
    clean, junk = "The quiet harbour lay under a pale sky that morning.", "BUY!! NOW!! CHEAP!! $$$ %%% CLICK!! HERE!! ###"
    sample = [("\n".join([clean] * 4), 1) for _ in range(40)] + [("\n".join([clean] * a + [junk] * b), 0) for a in (0, 1, 2) for b in (2, 3, 5) for _ in range(5)]
    model = quality.fit(sample)
    for text, expected in (([clean] * 3 + [junk] * 3 + [clean] * 2, [1, 1, 1, 0, 0, 0, 1, 1]), ([junk] * 2 + [clean] * 2, [0, 0, 1, 1]), ([clean], [1]), ([junk], [0])):
        assert model.viterbi(quality.chain("\n".join(text))[0], {}) == expected
    assert 0 < model.least_share < 1
    assert quality.fit([("some text", 1)]).viterbi([(0,), (0,)], {}) == [1, 1]
    assert quality.fit(sample, most_lines=3).viterbi([(0,)], {}) == [1]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]

    scores = {r.doc_id: r.score for r in queries.op3_toxicity(spark, SF_DIR).collect()}
    clean = stages["toxicity"](spark, docs, SF_DIR).cache()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, s in scores.items() if s < 0.5)

    largest: dict = {}
    for r in clean.collect():
        largest[r.text or ""] = max(r.doc_id, largest.get(r.text or "", r.doc_id))
    single = stages["exact_dedup"](spark, clean, SF_DIR).cache()
    assert sorted(r.doc_id for r in single.collect()) == sorted(largest.values())

    prints = {r.doc_id: simhash.fingerprint(r.text or "")[0] for r in single.collect()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    listed = sorted(prints)
    for k, i in enumerate(listed):
        for j in listed[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    near = stages["simhash_near_dedup"](spark, single, SF_DIR).cache()
    assert sorted(r.doc_id for r in near.collect()) == sorted({find(i) for i in prints})

    weights = secrets.train(secrets.labelled_samples(spark))
    spans = {r.doc_id: r.spans for r in secrets.scan_secrets(near, weights).collect()}
    masked = stages["secret_scan"](spark, near, SF_DIR).cache()
    assert masked.columns == docs.columns
    before = {r.doc_id: r.text for r in near.collect()}
    for r in masked.collect():
        text, at, out = before[r.doc_id] or "", 0, ""
        for span in filter(None, (spans[r.doc_id] or "").split(",")):
            _, a, b = span.split(":")
            if int(a) >= at:
                out += text[at : int(a)] + "<secret>"
            at = max(at, int(b))
        assert r.text == (before[r.doc_id] if not spans[r.doc_id] else out + text[at:])
        assert r.n_chars == len(r.text)

    last = stages["packing"](spark, masked, SF_DIR)
    assert {r.doc_id for r in last.select("doc_id").collect()} == set(before)
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert whole.columns == packing.pack(docs).columns
    totals = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()))
    assert totals(whole) == totals(last)
