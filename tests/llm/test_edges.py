"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quorumscan.llm import bpe, exact, lines, packing, quality, secrets, simhash, substring, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, print string, digest string, row int, `key` string, doc long, _member boolean, band int, page int, component string, keep_id string, gone int, spans int"
LONG = "alpha beta gamma " * 20_000 + "\n" + "x" * 50_000
ROWS = [(1, None), (2, ""), (2, ""), (3, " \n\t"), (None, "null id text here"), (None, None), (4, "short"), (5, LONG), (6, "A b c\nA b c\npassword = hunter2hunter2"), (6, "A b c\nA b c\npassword = hunter2hunter2"), (7, "\U0001f600 é 中文 <|endoftext|> <s> ▁ end"), (8, "short")]


def table(spark, rows):
    """Rows (doc_id, text) with further columns whose names the operators use themselves; all null."""
    return spark.createDataFrame([(*r, *[None] * 15) for r in rows], SCHEMA)


NO_MODELS = secrets.Models(((0,) * secrets.CODES**2,), (10_000,))
MODEL = toxicity.SentenceModel({"short": 9.0}, -4.0)
OPERATORS = {
    "secrets": lambda d: secrets.scan_secrets(d, NO_MODELS),
    "simhash": simhash.near_duplicates,
    "toxicity": lambda d: toxicity.score_documents(d, MODEL),
    "bpe": bpe.encode_decode,
    "quality": lambda d: quality.rate(d, quality.LineField()),
    "exact": exact.exact_duplicates,
    "token_counts": token_counts.count_tokens,
    "substring": substring.drop_repeats,
    "lines": lines.drop_near_lines,
}
STAGES = {
    "secrets": lambda d: secrets.mask_secrets(d, NO_MODELS),
    "toxicity": lambda d: toxicity.drop_toxic(d, MODEL),
    "exact": lambda d: exact.drop_exact_duplicates(d, keep="largest"),
    "simhash": simhash.drop_near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_input_row(spark, name):
    got = OPERATORS[name](table(spark, ROWS).repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, [])).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_the_columns(spark, name):
    docs = table(spark, ROWS)
    got = STAGES[name](docs.repartition(3))
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} <= {i for i, _ in ROWS}
    assert STAGES[name](table(spark, [])).collect() == []


def test_what_the_stages_keep(spark):
    docs = table(spark, ROWS)
    assert sorted(r.doc_id or 0 for r in STAGES["toxicity"](docs).collect()) == [0, 0, 1, 2, 2, 3, 5, 6, 6, 7]
    # Repeats of an identifier and a text stay together; null counts as empty.
    assert sorted(r.doc_id or 0 for r in STAGES["exact"](docs).collect()) == [0, 2, 2, 3, 5, 6, 6, 7, 8]
    kept = {r.doc_id: r.text for r in STAGES["secrets"](docs).collect() if r.doc_id in (1, 2, 6, 5)}
    assert kept == {1: None, 2: "", 5: LONG, 6: "A b c\nA b c\n<secret>"}
    # Null, empty and blank texts and short have fingerprints of their own; the smallest identifier stays.
    near = sorted(r.doc_id or 0 for r in STAGES["simhash"](docs).collect())
    assert near == [0, 1, 4, 5, 6, 6, 7]


def test_packing_of_odd_rows(spark):
    got = packing.pack(table(spark, ROWS).repartition(3)).collect()
    whole = Counter()
    for r in got:
        whole[r.doc_id] += r.length
    totals = Counter()
    for i, n in {(r.doc_id, r.doc_tokens) for r in got if r.doc_id not in (2, 6, None)}:
        totals[i] += n
    assert all(whole[i] == n for i, n in totals.items())
    assert whole[2] == 2 and whole[1] == 1
    assert packing.pack(table(spark, [])).collect() == []


def test_other_names_of_the_columns(spark):
    docs = table(spark, ROWS).select(F.col("doc_id").alias("n"), F.col("text").alias("body"))
    assert simhash.near_duplicates(docs, "n", "body").count() == len(ROWS)
    assert exact.exact_duplicates(docs, "n", "body").count() == len(ROWS)
    assert substring.drop_repeats(docs, "n", "body").count() == len(ROWS)
    assert lines.drop_near_lines(docs, "n", "body").count() == len(ROWS)


@pytest.mark.parametrize("name", ["secrets", "toxicity", "bpe", "quality", "token_counts"])
def test_rows_are_judged_each_for_itself(spark, name):
    """Null and repeated identifiers, also of other texts: every row gets what it gets under an identifier of its own."""
    rows = [*ROWS, (6, "another text of six"), (6, None), (None, "second null id text")]
    own = {r.doc_id: r for r in OPERATORS[name](table(spark, [(1000 + k, t) for k, (_, t) in enumerate(rows)])).collect()}
    own_values = lambda r: tuple(v for c, v in r.asDict().items() if c not in ("doc_id", "held_out"))
    got = OPERATORS[name](table(spark, rows).repartition(3)).collect()
    assert Counter((r.doc_id, own_values(r)) for r in got) == Counter((i, own_values(own[1000 + k])) for k, (i, _) in enumerate(rows))


def test_lines_of_repeated_and_null_identifiers(spark):
    rows = [(6, "one long line of text\nanother long line of text"), (6, "one long line of text"), (None, "another long line of text"), (None, None), (9, "one long line of text\nnew line here"), (6, "one long line of text")]
    got = lines.drop_near_lines(table(spark, rows).repartition(3), with_text=True).collect()
    # Two of three rows of identifier 6 are the same document; which of its texts comes first is told by their hashes.
    assert sorted((r.doc_id or 99, r.n_lines, r.kept_text) for r in got if r.doc_id in (None, 9)) == [(9, 2, "new line here"), (99, 0, ""), (99, 1, "")]
    six = Counter((r.n_lines, r.n_removed) for r in got if r.doc_id == 6)
    assert six in (Counter({(2, 0): 1, (1, 1): 2}), Counter({(2, 1): 1, (1, 0): 2}))
