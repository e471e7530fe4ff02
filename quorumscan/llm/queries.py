"""The operators of this subpackage bound to the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorumscan.llm import bpe, collocations, exact, lines, lm, packing, quality, search, secrets, simhash, substring, token_counts, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir), secrets.train(secrets.labelled_samples(spark)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.rate(docs, quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir), keep="largest")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_near_lines(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_simhash, op3_toxicity, op4_packing, op5_bpe, op6_quality_rules, op7_exact_dedup, op8_token_counts, op9_substring_dedup, op10_line_dedup, op11_collocations, op12_ranked_search, op13_lm_score)}

ORACLES: dict[str, str] = {
    "op7_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), starts AS (
            SELECT doc_id, unnest(range(1, len(w) - 18)) AS s FROM words
        ), windows AS (
            SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS win FROM starts JOIN words USING (doc_id)
        ), later AS (
            SELECT doc_id, s FROM (
                SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM windows
            ) WHERE k > 1
        ), covered AS (
            SELECT DISTINCT doc_id, s + o AS i FROM later, range(0, 20) AS r(o)
        ), per_doc AS (
            SELECT doc_id, list(i) AS gone FROM covered GROUP BY doc_id
        )
        SELECT doc_id,
               CAST(len(w) AS BIGINT) AS n_words,
               CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string([x FOR x, i IN w IF gone IS NULL OR NOT list_contains(gone, i)], ' ')) AS kept_sha256
        FROM words LEFT JOIN per_doc USING (doc_id)
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), words AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), totals AS (
            SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang
        ), grams AS (
            SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM words, range(1, 6) AS s(size)
        ), frequent AS (
            SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
        ), candidates AS (
            SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM frequent WHERE size > 1
        ), inside AS (
            SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS most FROM candidates, range(2, 5) AS s(k), range(1, 5) AS t(i) WHERE k < size AND i + k - 1 <= size GROUP BY ALL
        ), alone AS (
            SELECT c.* FROM candidates c LEFT JOIN inside i USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a
        ), cuts AS (
            SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r, n, (1000 * c.a * n) // (h.f * t.f) AS score
            FROM (SELECT *, unnest(range(1, size)) AS k FROM alone) c
            JOIN frequent h ON h.lang = c.lang AND h.phrase = array_to_string(w[1:k], ' ')
            JOIN frequent t ON t.lang = c.lang AND t.phrase = array_to_string(w[k + 1:], ' ')
            JOIN totals ON totals.lang = c.lang
        ), lowest AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
               CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM lowest QUALIFY rank <= 2000
    """,
    "op12_ranked_search": r"""
        WITH terms AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM documents
        ), counted AS (
            SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
        ), lengths AS (
            SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id
        ), totals AS (
            SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths
        ), valued AS (
            SELECT doc_id, 100 - 90 + (90 * n * docs) // total AS m FROM lengths, totals
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals
        ), asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
        ), scored AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN valued USING (doc_id) GROUP BY item_id, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
}
