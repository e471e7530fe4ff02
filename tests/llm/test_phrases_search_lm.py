"""Collocations, ranked search and language-model scores against plain Python, and on odd tables."""

import math
import mmap
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumscan.llm import collocations, lm, search
from quorumscan.llm.elias_fano import EliasFano
from quorumscan.llm.ngram_trie import Trie
from quorumscan.llm.words import cut, words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, phrase string, f long, size int, shard long, term string, word string, batch int, score string, `rank` int"
LONG = "alpha beta gamma delta " * 30_000
ROWS = [(1, None), (2, ""), (2, ""), (3, " \n\t.,;"), (None, "null id text here"), (None, None), (4, "alpha beta short"), (5, LONG), (6, "A b c. A b c\nA B C"), (6, "A b c. A b c\nA B C"), (7, "\U0001f600 é 中文 a-b x_y 12"), (8, "y" * 50_000)]


def table(spark, rows, lang=None):
    return spark.createDataFrame([(*r, lang, *[None] * 9) for r in rows], SCHEMA)


def made_up(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "AND", "New", "york", "city", "é", "zürich", "a-b", "x1"] + [f"w{k}" for k in range(60)]
    return [(k, "".join(rng.choice(words[: rng.choice([4, 10, 70])]) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(0, 90))), rng.choice(["en", "de", None])) for k in range(n)]


# -- collocations ------------------------------------------------------------------------------


def plain_collocations(rows, least, best):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    counts[lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in kept.items() for n in range(2, len(p)) for i in range(len(p) - n + 1) if a >= f[q := p[i : i + n]]}
        rows_of = []
        for p, a in kept.items():
            if p not in inside:
                score, k = min(((1000 * a * total[lang]) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows_of.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_of)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("seed", "width"), [(1, None), (2, 64)])
def test_collocations_equal_plain_counts_even_with_a_full_sketch(spark, seed, width):
    rows = made_up(seed, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found = collocations.collocations(docs, least=8, best=40, width=width)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, 8, 40)


def test_numbers_beyond_64_bits_are_exact(spark):
    big = 3 * 10**15
    (r,) = spark.range(1).selectExpr(f"(CAST(1000 AS decimal(38,0)) * CAST({big}L AS decimal(20,0)) * CAST({big + 7}L AS decimal(20,0))) div (CAST({big - 1}L AS decimal(19,0)) * CAST({big // 3}L AS decimal(19,0))) AS x").collect()
    assert r.x == 1000 * big * (big + 7) // ((big - 1) * (big // 3))


def test_collocations_on_odd_tables(spark):
    assert collocations.collocations(table(spark, [])).collect() == []
    found = collocations.collocations(table(spark, ROWS).repartition(3), least=2).collect()
    assert {r.lang for r in found} == {"und"}
    assert ("alpha beta gamma delta alpha", 29_999) in {(r.phrase, r.a) for r in found}
    assert {r.n for r in found} == {sum(len(re.findall(r"[^\x20\x09]+", p)) for _, t in ROWS for p in re.split(r"[.,;:!?\x0A-\x0D]", t or ""))}


# -- search ------------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_search(docs, items, k):
    tf = [(d, Counter(terms(t))) for d, t in docs]
    df = Counter(t for _, c in tf for t in c)
    docs_n, total = sum(1 for _, c in tf if c), sum(sum(c.values()) for _, c in tf)
    out = []
    for item, text in items:
        scores = []
        for d, c in tf:
            m = 10 + 90 * sum(c.values()) * docs_n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_docs", [7, 100_000])
def test_search_equals_scoring_every_document(spark, shard_docs, monkeypatch):
    monkeypatch.setattr(search, "MANY", 1)  # bounds are put to use on few documents too
    rows = [(d, t) for d, t, _ in made_up(5, 400)] + [(1000 + k, t) for k, (_, t, _) in enumerate(made_up(5, 30))]
    items = [(k, t) for k, t, _ in made_up(6, 25)] + [(98, ""), (99, None), (99, "york york NEW")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = search.build_index(docs, shard_docs=shard_docs)
    found = search.search(index, spark.createDataFrame(items, "item_id long, text string"), 10)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search(rows, items, 10)


def test_windows_and_pivots_of_one_shard(monkeypatch):
    monkeypatch.setattr(search, "FIRST_WINDOW", 16)
    monkeypatch.setattr(search, "WINDOW", 64)
    monkeypatch.setattr(search, "MANY", 1)
    monkeypatch.setattr(search, "BLOCK", 8)
    rng = np.random.default_rng(4)
    size = 900
    m = rng.integers(10, 400, size)
    for _ in range(30):
        lists, exact = [], np.zeros(size, np.int64)
        for _ in range(rng.integers(1, 9)):
            doc = np.sort(rng.choice(size, rng.integers(1, 700), replace=False))
            tf, w = rng.integers(1, 6, len(doc)), int(rng.integers(1, 9000))
            starts = np.arange(0, len(doc), 8)
            ends = np.minimum(starts + 8, len(doc))
            impact = search.impacts(tf, m[doc])
            bits, data = search._blocks(starts, ends, doc, tf)
            lists.append((w, search.PostingList(doc[starts], doc[ends - 1], ends - starts, np.maximum.reduceat(impact, starts), bits, data, m)))
            exact[doc] += w * impact
        docs, scores = search.search_shard(lists, size, 10, np.arange(size))
        top = np.lexsort((np.arange(size), -exact))[:10]
        top = top[exact[top] > 0]
        assert docs.tolist() == top.tolist()
        assert scores.tolist() == exact[top].tolist()


def test_blocks_skipped_are_not_unpacked():
    size = 20_000
    m = np.full(size, 100)
    doc = np.arange(0, size, 2)
    tf = np.ones(len(doc), np.int64)
    starts = np.arange(0, len(doc), search.BLOCK)
    ends = np.minimum(starts + search.BLOCK, len(doc))
    bits, data = search._blocks(starts, ends, doc, tf)
    common = search.PostingList(doc[starts], doc[ends - 1], ends - starts, np.maximum.reduceat(search.impacts(tf, m[doc]), starts), bits, data, m)
    rare_doc = np.arange(100, 112)
    rare = search.PostingList(rare_doc[:1], rare_doc[-1:], np.array([12]), search.impacts(np.ones(1, np.int64), m[:1]), *search._blocks(np.array([0]), np.array([12]), rare_doc, np.ones(12, np.int64)), m)
    docs, _ = search.search_shard([(5, common), (9000, rare)], size, 10, np.arange(size))
    assert set(docs) <= set(range(100, 112))
    assert len(common.open) <= search.FIRST_WINDOW // 2 // search.BLOCK + 1 < len(common.n)


def test_search_on_odd_tables(spark):
    items = spark.createDataFrame([("i", "alpha here 中文"), ("j", None)], "item_id string, text string").withColumn("doc_id", F.lit("x"))
    found = search.ranked_search(table(spark, ROWS).repartition(3), items).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found), key=repr) == plain_search(ROWS, [("i", "alpha here 中文")], 10)
    assert search.ranked_search(table(spark, []), items).collect() == []
    assert search.ranked_search(table(spark, ROWS), items.limit(0)).collect() == []


# -- language model ----------------------------------------------------------------------------


def plain_scores(rows):
    """Witten-Bell by dictionaries: doc_id to (held out, tokens, known, N, base, score)."""
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for d, t in rows}
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    grams = Counter(t[i : i + n] for d, w in tokens.items() if not held[d] for t in [tuple(w)] for n in (1, 2, 3) for i in range(len(t) - n + 1))
    total, v = sum(c for g, c in grams.items() if len(g) == 1), sum(1 for g in grams if len(g) == 1)
    behind = defaultdict(list)
    for g, c in grams.items():
        behind[g[:-1]].append(c)

    def p(context, w):
        if not context:
            return (grams[(w,)] + 1) / (total + v + 1)
        seen = behind.get(context, [])
        return (grams[(*context, w)] + len(seen) * p(context[1:], w)) / (sum(seen) + len(seen)) if seen else p(context[1:], w)

    return {d: (held[d], len(w), sum(grams[(x,)] > 0 for x in w), total, sum(math.log10(p((), x)) for x in w), sum(math.log10(p(tuple(w[max(0, i - 2) : i]), x)) for i, x in enumerate(w))) for d, w in tokens.items()}


@pytest.mark.parametrize(("shard", "parts"), [(1 << 20, 8), (300, 2)])
def test_scores_equal_a_plain_model(spark, shard, parts):
    rows = [(d, t) for d, t, _ in made_up(8, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_scores(rows)
    found = lm.score_documents(docs, shard=shard, parts=parts).collect()
    assert len(found) == len(rows)
    for r in found:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base)
        assert r.score == pytest.approx(score, rel=0.02, abs=0.05)  # probabilities are quantised


def test_contexts_help_where_there_are_some(spark):
    rng = random.Random(1)
    phrases = ["the quick brown fox jumps over", "a lazy dog sleeps under the tree", "rain falls on the plain in spain"]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(phrases) for _ in range(6))) for k in range(100)], "doc_id long, text string")
    held = [r for r in lm.score_documents(docs).collect() if r.held_out]
    assert len(held) > 5
    assert all(r.score > 0.5 * r.base_score for r in held)


def test_words_spread_over_shards_keep_whole_counts_and_probabilities(spark):
    rows = [(d, t) for d, t, _ in made_up(9, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_scores(rows)
    for r in lm.score_documents(docs, shard=500, parts=2, most=200).collect():
        assert (r.n_known, r.base_score) == (want[r.doc_id][2], pytest.approx(want[r.doc_id][4]))
        assert r.score > 1.6 * r.base_score  # both are negative


def test_scores_on_odd_tables(spark):
    found = lm.score_documents(table(spark, ROWS).repartition(3)).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in ROWS)
    assert {r.n_tokens for r in found if r.doc_id in (1, 2)} == {1}
    assert {r.held_out for r in found if r.doc_id is None} == {False}
    assert lm.score_documents(table(spark, [])).collect() == []
    (only,) = lm.score_documents(table(spark, [(1, "a b")]), held_out="true").collect()
    assert (only.train_tokens, only.n_known, only.base_score, only.score) == (0, 0, 0.0, 0.0)


def test_sequences_and_tries_from_a_file(tmp_path):
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1000, 40), (70_000, 10**12)):
        values = np.sort(rng.integers(0, top, n))
        found = EliasFano(*EliasFano.parts(values))
        assert (found.get(np.arange(n)) == values).all()
        asked, begin = rng.integers(0, top + 2, 200), rng.integers(0, n + 1, 200)
        end = np.maximum(begin, rng.integers(0, n + 1, 200))
        assert (found.successor(asked, begin, end) == np.clip(np.searchsorted(values, asked), begin, end)).all()
    m, left, right = rng.integers(1, 40, 5000), rng.integers(0, 40, 5000), rng.integers(1, 40, 5000)
    p = np.full(40, 1 / 40)
    made = lm.build_trie(m, left, right, None, p, np.zeros(40, bool))
    made.write(f"{tmp_path}/trie")
    with open(f"{tmp_path}/trie", "rb") as f:
        opened = Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    contexts = np.arange(5000)
    for trie in (made, opened):
        logs = lm.ask(trie, m, left, contexts, right, p)
        assert np.isfinite(logs).all()
        assert (logs < 0).all()
    # Probabilities of all words behind a context come to 1, but for quantisation.
    every = lm.ask(opened, np.full(39, m[0]), np.full(39, left[0]), np.arange(39), np.arange(1, 40), p)
    assert (10**every).sum() + 10 ** lm.ask(opened, m[:1], left[:1], np.zeros(1, int), np.zeros(1, int), p)[0] == pytest.approx(1, rel=0.1)


def test_long_texts_are_cut_behind_separators():
    text = b"aaa bbb\ncc " * 50
    at = lm.SEPARATORS
    parts = list(cut(text, at, 64))
    assert b"".join(parts) == text
    assert all(at[p[-1]] for p in parts[:-1])
    assert max(map(len, parts)) < 80
    assert list(cut(b"x" * 500, at, 64)) == [b"x" * 500]
    words = words_of([b"A bB", b"", b"\n"], at)
    assert (words.names.to_pylist(), words.text.tolist()) == ([b"a", b"bb"], [0, 0])
