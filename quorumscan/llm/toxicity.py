"""Toxicity by multiple-instance learning: documents are bags of sentences.

Only documents have labels.  A sentence has a score sigmoid(b + sum of its features'
weights); the sentences' scores combine by noisy-or, 1 - prod(1 - p), and weights and b
are fitted to the document labels through it.  The fitted sentence scores then say
which sentences offend.

Features are lower-cased words and their first 4, 5 and 6 letters, which catch inflected forms.
Only features that labels set apart (chi-squared of sentence counts) enter the model; a
sentence without any of them scores 0, so long documents gather no score from ordinary words.

The model is fitted on the driver on a sample of at most ``2 * per_class`` labelled
documents; scoring runs over all documents in Arrow batches.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumscan.llm.common import SLICE_ROWS, Out, held, pick, rows_of
from quorumscan.llm.labelled import HELD_OUT, labelled_sample

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_sentences", pa.int64()), ("worst_start", pa.int64()), ("worst_end", pa.int64()), ("worst_score", pa.float64())])
OFFENDING = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("sentence", pa.string())])


def features(word: str) -> list[str]:
    """A word and its prefixes; prefixes carry a mark that no word has."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


@dataclass
class SentenceModel:
    """Weights of features and the bias; word weights are remembered, ``keep`` of them at most."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    keep: int = 100_000
    memo: dict[str, float] = field(default_factory=dict)

    def word_weight(self, word: str) -> float | None:
        """The summed weight of a word's features, None where it has none in the model."""
        found = [self.weights[f] for f in features(word) if f in self.weights]
        return sum(found) if found else None

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, score) of the sentences with a score, in code points."""
        memo = self.memo
        for m in SENTENCE.finditer(text):
            total, some = self.bias, False
            for w in WORD.findall(m[0].lower()):
                try:
                    x = memo[w]
                except KeyError:
                    if len(memo) > self.keep:
                        memo.clear()
                    x = memo[w] = self.word_weight(w)
                if x is not None:
                    total += x
                    some = True
            if some:
                yield m.start(), m.end(), 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))

    def start(self) -> None:
        """Take the worker over from the operator before."""
        held("toxicity", lambda: True)

    def rest(self) -> None:
        """Give back what a task has needed: the worker goes on to other stages."""
        self.memo.clear()
        pa.default_memory_pool().release_unused()

    def score(self, text: str) -> tuple[float, tuple[int, int, float] | None]:
        """Noisy-or of the sentences, and the sentence that scores most (the first of equals)."""
        clean, worst = 1.0, None
        for found in self.sentences(text):
            clean *= 1 - found[2]
            if worst is None or found[2] > worst[2]:
                worst = found
        return 1 - clean, worst


def chosen_features(sentences: dict[str, int], most: int, least_chi2: float = 28.0) -> list[str]:
    """Features that are more frequent in sentences of label 1, by chi-squared, ``most`` at most.

    ``sentences`` holds distinct sentences, so that what copies of a document share counts once.
    """
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for sentence, y in sentences.items():
        counts[y].update({f for w in WORD.findall(sentence) for f in features(w)})
    n1 = max(1, sum(sentences.values()))
    n0 = max(1, len(sentences) - n1)
    found = []
    for f, a in counts[1].items():
        c = counts[0][f]
        n, all_f = n1 + n0, a + c
        cross = a * (n0 - c) - c * (n1 - a)
        chi2 = n * cross**2 / (n1 * n0 * all_f * (n - all_f)) if all_f < n else 0.0
        if a >= 3 and a / n1 > 2 * c / n0 and chi2 >= least_chi2:
            found.append((-chi2, f))
    return [f for _, f in sorted(found)[:most]]


def fit(sample: list[tuple[str, int]], most_features: int = 4096, steps: int = 300, l2: float = 1e-3, rate: float = 0.1, prior_bias: float = -4.0) -> SentenceModel:
    """Fit a model to (text, label) pairs; without a label of each kind it scores everything 0.

    The bias is drawn to ``prior_bias``: a sentence is innocent until its features outweigh it.
    """
    labels = np.array([y for _, y in sample], np.int64)
    if len(set(labels.tolist())) < 2:
        return SentenceModel()
    sentences: dict[str, int] = {}
    for text, y in sample:
        for m in SENTENCE.finditer(text):
            sentence = m[0].lower()
            sentences[sentence] = min(y, sentences.get(sentence, 1))  # what documents of label 0 say too is innocent
    names = chosen_features(sentences, most_features)
    number = {f: k for k, f in enumerate(names)}
    doc_of, of, which, n = array("q"), array("q"), array("q"), 0  # not lists: they are long, and the driver keeps what lists once held
    for d, (text, _) in enumerate(sample):
        for m in SENTENCE.finditer(text):
            hit = [number[f] for w in WORD.findall(m[0].lower()) for f in features(w) if f in number]
            if hit:
                doc_of.append(d)
                of.extend([n] * len(hit))
                which.extend(hit)
                n += 1
    del sentences
    doc_of, of, which = np.array(doc_of, np.int64), np.array(of, np.int64), np.array(which, np.int64)
    w, b = np.zeros(len(names)), prior_bias
    moments = [np.zeros(len(names) + 1) for _ in range(2)]
    for t in range(1, steps + 1):
        z = b + np.bincount(of, w[which], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(-np.bincount(doc_of, np.logaddexp(0, z), minlength=len(labels)))  # product of 1 - p
        pull = np.where(labels == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0)
        dz = pull[doc_of] * p / len(labels)
        grad = np.r_[np.bincount(which, dz[of], minlength=len(names)) + l2 * w / 10, dz.sum() + 1e-2 * (b - prior_bias)]
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        step = rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return SentenceModel(dict(zip(names, w.tolist(), strict=True)), float(b))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", held_out: str = HELD_OUT, **fitting) -> SentenceModel:
    """A model fitted on at most ``2 * per_class`` labelled documents that are not held out."""
    return fit(labelled_sample(docs, labels, label, per_class, id_col, text_col, f"NOT ({held_out})"), **fitting)


def score_documents(docs: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_sentences, worst_start, worst_end, worst_score.

    Texts that are null, empty or without a word of the model score 0 and have no worst
    sentence (null).  A row with a null identifier is not held out.  Repeated identifiers are
    scored row by row; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.start()
        for batch in batches:
            out = Out(SCORED)
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                score, worst = model.score(text)
                out.add(doc_id, score, sum(1 for _ in SENTENCE.finditer(text)), *(worst or (None, None, None)))
            if len(out):
                yield out.take()
        model.rest()

    ddl = "doc_id long, score double, n_sentences long, worst_start long, worst_end long, worst_score double"
    scored = pick(docs, id_col, text_col).mapInArrow(run, ddl)
    held = F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "worst_start", "worst_end", "worst_score")


def offending_sentences(docs: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per sentence that scores ``threshold`` or more: doc_id, start, end (code points, exclusive), score, sentence.

    Null and empty texts have no sentence; texts of any length are read whole.  Null or repeated identifiers pass
    through, each row for itself; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Out(OFFENDING)
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                for start, end, score in model.sentences(text):
                    if score >= threshold:
                        out.add(doc_id, start, end, score, text[start:end])
            if len(out):
                yield out.take()

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, end long, score double, sentence string")


def drop_toxic(docs: DataFrame, model: SentenceModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``.

    Null and empty texts score as the model scores no sentence, 0, and stay; texts of any length are scored whole.
    Repeated rows go or stay together; a score equal to ``threshold`` goes; an empty table gives no rows.
    """

    names = docs.columns
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield part.filter(pa.array([model.score(text or "")[0] < threshold for text in part.column(text_at).to_pylist()], pa.bool_()))
        model.rest()

    return docs.mapInArrow(run, docs.schema)
