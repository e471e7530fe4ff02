"""Secrets that are glued to ordinary words in one run of characters."""

import random
import re
import time

import pytest

from quorumscan.llm import secrets

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
WORDS = "invoice ledger carrier shipment voucher printer gallery storage planner monitor".split()
PATH = "services/storage/download/production/"
AROUND = [(PATH, ""), (PATH + "internal/customer_documents/", ""), (PATH, "/archive/monthly/reports"), ("production_database_signing_value=", "")]

NO_MODELS = secrets.Models(((0,) * secrets.CODES**2,), (10_000,))


@pytest.fixture(scope="module")
def weights(spark):
    return secrets.train(secrets.labelled_samples(spark))


def random_spans(spark, weights, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans.split(",") for r in secrets.scan_secrets(docs, weights).collect()}
    return [[tuple(map(int, x.split(":")[1:])) for x in found[k] if x.startswith("random")] for k in range(len(texts))]


@pytest.mark.parametrize("size", [20, 32, 40])
def test_secrets_behind_paths_and_names(spark, weights, size):
    rng = random.Random(size)
    texts = [f"see {a}{''.join(rng.choices(ALPHABET, k=size))}{b} é" for _ in range(50) for a, b in AROUND]
    hits = 0
    for k, found in enumerate(random_spans(spark, weights, texts)):
        start = 4 + len(AROUND[k % len(AROUND)][0])
        hits += any(a <= start + 3 and b >= start + size - 3 and b - a >= secrets.LEAST for a, b in found)
    assert hits >= 0.9 * len(texts)


def test_several_secrets_of_one_run(spark, weights):
    rng = random.Random(2)
    one, two = ("".join(rng.choices(ALPHABET, k=32)) for _ in range(2))
    between = "/" + PATH * 3
    (found,) = random_spans(spark, weights, [PATH * 3 + one + between + two + "/" + PATH * 3])
    at = len(PATH) * 3
    assert len(found) == 2
    for (a, b), start in zip(found, (at, at + 32 + len(between))):
        assert abs(a - start) <= 6 and abs(b - start - 32) <= 6


def test_letters_alone_and_ordinary_names(spark, weights):
    rng = random.Random(4)
    letters = ["".join(rng.choices(ALPHABET[:52], k=32)) for _ in range(100)]
    names = [rng.choice("_-/").join(rng.choices(WORDS, k=rng.randrange(3, 10))) + rng.choice(["", str(rng.randrange(100))]) for _ in range(200)]
    found = random_spans(spark, weights, letters + names)
    assert sum(map(bool, found[:100])) >= 97
    assert sum(map(bool, found[100:])) <= 4


def test_masked_behind_a_path(spark, weights):
    secret = "q7Xv2LkP9sWz4RtB8nYc3MdF6hJg1TaQ"
    docs = spark.createDataFrame([(1, PATH * 2 + secret)], "doc_id long, text string")
    (row,) = secrets.mask_secrets(docs, weights).collect()
    assert "<secret>" in row.text and secret[3:-3] not in row.text and row.text.startswith(PATH)


def test_best_stretch_against_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    cases = [[rng.randrange(-900, 700) for _ in range(rng.randrange(1, 60))] for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(cases)), "k int, r array<int>")
    for r in docs.select("k", secrets.random_stretches(F.col("r"), 2000).alias("s"), secrets.best_sum(F.col("r")).alias("best")).collect():
        x = cases[r.k]
        sums = {(a, b): sum(x[a:b]) for a in range(len(x)) for b in range(a + secrets.LEAST, len(x) + 1)}
        assert r.best == max([sum(x), *sums.values()])
        if sum(x) > 2000:
            assert [tuple(s) for s in r.s] == [(0, len(x))]
        else:
            assert bool(r.s) == (max(sums.values(), default=0) > 2000)
            assert all(sums[tuple(s)] > 2000 for s in r.s)
            assert all(s.end <= t.start for s, t in zip(r.s, r.s[1:]))


@pytest.mark.parametrize("size", [32, 40])
def test_every_alphabet_has_its_model(spark, weights, size):
    """Random strings made apart from the training samples, behind a name that no fixed pattern knows."""
    rng = random.Random(size)
    for alphabet in ("0123456789abcdef", "0123456789ABCDEF", ALPHABET, ALPHABET[:26] + ALPHABET[52:], ALPHABET + "+/"):
        texts = [f"session_value/{''.join(rng.choices(alphabet, k=size))} é" for _ in range(100)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = secrets.scan_secrets(docs, weights).select("n_hex", "n_random").collect()
        assert sum(r.n_hex + r.n_random > 0 for r in found) >= 97, alphabet


def plain_stretches(x, least_sum):
    """Ends of what is random in a token by the rule of random_stretches, in plain Python."""
    if sum(x) > least_sum:
        return [(0, len(x))]
    found, floor = [], 0
    best = start = end = 0
    for at in range(1, len(x) + 1):
        gains = {a: sum(x[a:at]) for a in range(floor, at - secrets.LEAST + 1)}
        begin = min((a for a in gains if gains[a] == max(gains.values())), default=0)
        gain = gains.get(begin, 0)
        if best > least_sum and gain < best - least_sum:
            found.append((start, end))
            floor, best = end, 0
        elif gain > best:
            best, start, end = gain, begin, at
    return found + [(start, end)] * (best > least_sum)


def test_random_spans_against_brute_force(spark, weights):
    """The spans of texts, from the models' tables alone."""
    rng = random.Random(12)
    texts = []
    for _ in range(60):
        parts = [rng.choice([PATH, rng.choice(WORDS) + "_", "".join(rng.choices(ALPHABET, k=rng.randrange(5, 45))), "".join(rng.choices("0123456789abcdef", k=rng.randrange(8, 30)))]) for _ in range(rng.randrange(1, 6))]
        texts.append("é " + "".join(parts))
    for text, found in zip(texts, random_spans(spark, weights, texts), strict=True):
        token = text[2:]
        every = []
        if len(token) >= 20 and any(c.isalpha() for c in token):
            codes = [0, *(secrets.ALPHABET.find(c) + 1 for c in token)]
            for table, margin in zip(weights.tables, weights.margins, strict=True):
                every += plain_stretches([table[a * secrets.CODES + b] for a, b in zip(codes, codes[1:])], margin)
        merged = []
        for a, b in sorted(every):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        base = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        assert found == [(a + 2, b + 2) for a, b in merged if not any(p < b + 2 and a + 2 < q for p, q in base)]


def test_many_secrets_in_one_text_cost_in_proportion(spark):
    """Four times the spans take about four times as long, not sixteen; and each of them is found and masked."""
    piece = "token=abcdefgh1 "
    took = {}
    for n in (40_000, 160_000):
        docs = spark.createDataFrame([(1, piece * n)], "doc_id long, text string")
        begin = time.monotonic()
        (row,) = secrets.scan_secrets(docs, NO_MODELS).collect()
        (masked,) = secrets.mask_secrets(docs, NO_MODELS).collect()
        took[n] = time.monotonic() - begin
        assert row.n_assign == n
        spans = row.spans.split(",")
        assert len(spans) == n
        assert spans[:2] == ["assign:0:15", "assign:16:31"]
        assert spans[-1] == f"assign:{16 * (n - 1)}:{16 * n - 1}"
        assert masked.text == "<secret> " * n
    assert took[160_000] < 8 * took[40_000]


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_and_masks_against_brute_force(spark, seed):
    """Runs of tokens, base matches and other text in one document: overlaps by definition, masks by cutting the text."""
    rng = random.Random(seed)
    parts = ["token=abcdefgh1", "AKIA" + "Q" * 16, "f" * 40, "x" * 30, "plain words", "é中", "secret: 'zzzzzzzzz'", "\U0001f600", "\n"]
    text = "".join(rng.choice(parts) + rng.choice(["", " ", "/"]) for _ in range(300))
    every = secrets.Models(((100,) * secrets.CODES**2,), (1,))  # every long run with a letter is random
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = secrets.scan_secrets(docs, every).collect()
    base, tokens = [], []
    for kind, (pattern, group, least, _) in secrets.BASE.items():
        base += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    tokens = [(m.start(), m.end()) for m in re.finditer(secrets.TOKEN, text) if re.search("[A-Za-z]", m.group())]
    kinds = [*secrets.BASE, "random"]
    apart = [(a, b, "random") for a, b in tokens if not any(x < b and a < y for x, y, _ in base)]
    want = sorted([*base, *apart], key=lambda s: (s[0], kinds.index(s[2])))
    assert row.spans == ",".join(f"{k}:{a}:{b}" for a, b, k in want)
    out, at = [], 0
    for a, b in sorted([*((a, b) for a, b, _ in base), *tokens]):
        if a >= at:
            out += [text[at:a], "<secret>"]
        at = max(at, b)
    assert secrets.mask_secrets(docs, every).first().text == "".join([*out, text[at:]])
