"""Line dedup over every overlapping shingle, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quorumscan.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]")


def shingles(line, width=8):
    return {line[k : k + width] for k in range(len(line) - width + 1)} or {line}


def kept_lines(cases, similarity=0.8):
    """The texts that stay, by brute force over all pairs of lines."""
    place = {}
    for i in sorted(cases):
        for k, line in enumerate(cases[i].split("\n")):
            if WORD.search(line):
                place.setdefault(line, (i, k))
    listed = sorted(place, key=place.get)
    sets = {x: shingles(x) for x in listed}
    root = {x: x for x in listed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(listed):
        for b in listed[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)), key=place.get)
                root[y] = x
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not WORD.search(x) or place[find(x)] == (i, k)) for i, t in cases.items()}


def got_lines(spark, cases, **how):
    docs = spark.createDataFrame(list(cases.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.kept_text for r in lines.drop_near_lines(docs, with_text=True, **how).collect()}


def test_characters_behind_the_eighth_of_a_word_count(spark):
    rng = random.Random(5)
    blob = "".join(rng.choices("0123456789abcdef", k=400))
    listed = ["Order 1000000001 shipped", "Order 1000000002 shipped", "https://example.com/a", "https://other.org/zzz", "deadbeef" + blob[:60], "deadbeef" + blob[60:120], "天地玄黄宇宙洪荒日月盈昃", "天地玄黄宇宙洪荒辰宿列张寒来暑往", "short", "shorty"]
    # Equal but for the first eight characters: similar, though no word starts alike.
    listed += ["01234567" + blob[120:320], "89abcdef" + blob[120:320]]
    listed += ["\U0001f600é" * 5 + blob[:200], "\U0001f600é" * 6 + blob[:200]]
    long = "".join(rng.choices("ghijklmnopqrst", k=12_288))
    listed += [long, "x" + long, long[:4099], long[4096:]]
    cases = dict(enumerate(listed))
    expected = kept_lines(cases)
    assert [i for i, t in expected.items() if not t] == [11, 13, 15]
    assert got_lines(spark, cases) == expected


@pytest.mark.parametrize("block", [1, 7, 512])
def test_lines_of_bands_left_apart(spark, block, monkeypatch):
    """Chains of lines that differ in more and more places, so that bands hold several components."""
    rng = random.Random(3)
    listed = []
    for _ in range(4):
        line = rng.choices("abcdefghij ", k=300)
        for _ in range(25):
            for _ in range(rng.randrange(1, 4)):
                line[rng.randrange(300)] = rng.choice("klmnop")
            listed.append("z" + "".join(line))
    rng.shuffle(listed)
    cases = dict(enumerate(listed))
    whole = lines.line_components
    monkeypatch.setattr(lines, "line_components", lambda *a: whole(*a, hubs=1, block=block))
    # So many bands that every link shares one.
    assert got_lines(spark, cases, bands=40) == kept_lines(cases)


def test_bitmaps_rule_out_no_similar_pair(spark):
    rng = random.Random(6)
    listed = ["".join(rng.choices("abcdef ", k=n)) for n in (3, 8, 40, 300, 5000)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(listed)], "key int, line string")
    rows = docs.join(lines.bitmaps(docs, 8), "key").select("key", F.size(lines.shingles("line", 8)).alias("size"), *(f"w{w}" for w in range(lines.WORDS))).collect()
    for r in rows:
        bits = sum((r[f"w{w}"] & (1 << 64) - 1).bit_count() for w in range(lines.WORDS))
        assert r["size"] == len(shingles(listed[r.key]))
        assert 1 <= bits <= r["size"]


def test_shingles_of_wide_characters(spark):
    listed = ["ab é\U0001f600" * k for k in (1, 2, 3, 9)] + ["\U0001f600" * 8, "1234567", "12345678", "x" * 20]
    docs = spark.createDataFrame(list(enumerate(listed)), "k int, line string")
    got = docs.select("k", lines.shingles("line", 8).alias("s")).collect()
    rows = lines.exploded(docs, 8, 3, "k").collect()
    found = {k: {h for r in rows if r.k == k for h in r[1:]} for k in range(len(listed))}
    hashes = {}
    for r in got:
        assert len(r.s) == len(shingles(listed[r.k])) and set(r.s) == found[r.k]
        for h in r.s:
            hashes.setdefault(h, set()).add(r.k)
    for a in range(len(listed)):
        for b in range(a):
            assert len(found[a] & found[b]) == len(shingles(listed[a]) & shingles(listed[b]))


def test_pairs_that_bitmaps_rule_out_are_not_verified(spark):
    """Links look at the bitmaps first, so a wrong bitmap hides a pair, and a right one none."""
    line = "a line of more than eight characters that is here twice"
    texts = spark.createDataFrame([(1, line + " x"), (2, line + " y"), (3, line)], "key int, line string").withColumn("size", F.size(lines.shingles("line", 8)))
    known = texts.join(lines.bitmaps(texts, 8), "key")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a int, b int")
    assert sorted(map(tuple, lines._links(pairs, known, 8, 0.8).collect())) == [(1, 2), (1, 3), (2, 3)]
    wrong = known.select("key", "line", "size", *(F.when(F.col("key") == 3, F.bitwise_not(F.col(f"w{w}"))).otherwise(F.col(f"w{w}")).alias(f"w{w}") for w in range(lines.WORDS)))
    assert [tuple(r) for r in lines._links(pairs, wrong, 8, 0.8).collect()] == [(1, 2)]
