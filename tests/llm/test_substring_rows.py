"""Substring dedup where rows share an identifier or have none, against brute force."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash

from quorumscan.llm import substring


def brute_force(rows, width):
    """(doc_id, n_words, n_removed, kept text's hash) of each row; null comes last, rows of one identifier by the hash of their texts."""

    def place(row):
        h = xxhash.xxh64(row[1].encode(), seed=42).intdigest()
        return (substring.LAST if row[0] is None else row[0], h - (h >> 63 << 64))

    seen, found = set(), {}
    for row in sorted(set(rows), key=place):
        words, gone = row[1].split(), set()
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            if w in seen:
                gone |= set(range(k, k + width))
            seen.add(w)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        found[row] = (row[0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return Counter(found[row] for row in rows)


@pytest.mark.parametrize("hot", [2, 3, 4096])
@pytest.mark.parametrize("seed", range(3))
def test_null_and_repeated_identifiers(spark, seed, hot):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(8, 30))] for _ in range(12)]
    rows = []
    for k in range(120):
        words = [rng.choice("uvwxyz") for _ in range(rng.randrange(4))]
        for _ in range(rng.randrange(1, 4)):
            words += passages[min(rng.randrange(12), rng.randrange(12))] + [rng.choice("uvwxyz") for _ in range(rng.randrange(4))]
        rows.append((None if k % 3 == 0 else 7 if k % 3 == 1 else k, " ".join(words)))
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring.drop_repeats(docs, width=6, phrase=3, hot=hot, block=4).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_force(rows, 6)


def test_the_automaton_reports_every_later_occurrence():
    """Windows of segments of a shard, against a dictionary of all windows."""
    rng = random.Random(4)
    for width in (1, 3, 6):
        segments = [(k % 3, k, k, k // 2, 0, rng.randrange(50), 1 + k % 2, " ".join(rng.choices("abc", k=rng.randrange(width, width + 12)))) for k in range(60)]
        first = {}
        for *_, doc, row, start, _, words in segments:
            w = words.split(" ")
            for o in range(len(w) - width + 1):
                t = tuple(w[o : o + width])
                first[t] = min(first.get(t, (doc, row, start + o)), (doc, row, start + o))
        for segment, found in zip(segments, substring.locate(segments, width), strict=True):
            assert found[:6] == segment[:6]
            w = segment[-1].split(" ")
            assert [bool(found[-1] >> o & 1) for o in range(len(w) - width + 1)] == [first[tuple(w[o : o + width])] != (segment[3], segment[4], segment[5] + o) for o in range(len(w) - width + 1)]
    assert list(substring.locate([(1, 1, 1, 1, 1, 1, 1, "a")], 1)) == [(1, 1, 1, 1, 1, 1, 0)]
