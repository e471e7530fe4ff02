"""Quality by line sequence labelling with a linear-chain conditional random field.

A document is the chain of its lines.  Viterbi decoding marks each line as content or
boilerplate; the share of words in content lines decides whether the document stays.

Lines have no labels of their own.  The field is fitted on a bounded sample of documents with a
quality label, in rounds.  All lines of a good document are content.  Those of a bad one begin as
boilerplate; then each is labelled anew by what the field says of it alone, but one line at
least, the most doubtful, stays boilerplate.  So a bad document's clean lines are learnt as content, and steps
between the kinds are learnt from documents that hold both.  The least share of content that a
document needs is the one that parts the sample's good and bad documents best.
Plain base rules come first and are never overruled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quorumscan.llm.common import Out, pick, rows_of
from quorumscan.llm.labelled import labelled_sample

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
SPACES = " \t\n\x0b\x0c\r"
RATED = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_lines", pa.int64()), ("n_content_lines", pa.int64()), ("content_share", pa.float64())])
#: Bounds of the bins of a line's shares of symbols, capitals and digits, of its words and of their mean length.
SHARES, N_WORDS, MEAN_LENGTH = (0.0, 0.02, 0.1, 0.25), (1, 3, 8, 20), (2.5, 4.0, 8.0, 12.0)
N_FEATURES = 1 + 3 * len(SHARES) + len(N_WORDS) + len(MEAN_LENGTH) + 3


def line_features(line: bytes, words: list[bytes], repeated: bool) -> tuple[int, ...]:
    """The numbers of the binary features that a line with words has; 0 is always on."""
    size = sum(map(len, words))
    on, at = [0], 1
    for some in (SYMBOLS, UPPER, DIGITS):
        share = (len(line) - len(line.translate(None, some))) / size
        on += [at + k for k, bound in enumerate(SHARES) if share > bound]
        at += len(SHARES)
    on += [at + k for k, bound in enumerate(N_WORDS) if len(words) > bound]
    at += len(N_WORDS)
    on += [at + k for k, bound in enumerate(MEAN_LENGTH) if size / len(words) > bound]
    at += len(MEAN_LENGTH)
    on += [at] * (words[-1][-1:] in (b".", b"!", b"?", b":", b'"')) + [at + 1] * repeated + [at + 2] * (line[:1] in (b"-", b"*", b"|"))
    return tuple(on)


def chain(text: str) -> tuple[list[tuple[int, ...]], list[int], int]:
    """Features and word counts of the lines with a word, and how many of them equal an earlier one."""
    seen: set[bytes] = set()
    found, sizes = [], []
    for line in text.encode().split(b"\n"):
        if words := line.split():
            found.append(line_features(line, words, line in seen))
            sizes.append(len(words))
            seen.add(line)
    return found, sizes, len(found) - len(seen)


@dataclass
class LineField:
    """Scores of features for (boilerplate, content), of first labels and of steps between labels."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros((N_FEATURES, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    least_share: float = 0.5  #: share of words in content lines that a document needs

    def viterbi(self, lines: list[tuple[int, ...]], memo: dict) -> list[int]:
        """The most likely labels, 1 for content; content wins ties."""
        (s00, s01), (s10, s11) = self.step.tolist()
        back: list[tuple[int, int]] = []
        v0, v1 = self.start.tolist()
        for k, on in enumerate(lines):
            e = memo.get(on)
            if e is None:
                e = memo[on] = tuple(self.emit[list(on)].sum(axis=0).tolist())
            if k:
                a0, a1, b0, b1 = v0 + s00, v1 + s10, v0 + s01, v1 + s11
                back.append((int(a1 >= a0), int(b1 >= b0)))
                v0, v1 = max(a0, a1), max(b0, b1)
            v0, v1 = v0 + e[0], v1 + e[1]
        at = int(v1 >= v0)
        labels = [at] * bool(lines)
        for choice in reversed(back):
            at = choice[at]
            labels.append(at)
        return labels[::-1]


def maximise(model: LineField, chains: list[list[tuple[int, ...]]], labels: list[list[int]], weight: np.ndarray, steps: int, rate: float, l2: float) -> None:
    """Raise the weighted likelihood of the chains' labels by gradient ascent; chains come longest first."""
    n, most = len(chains), len(chains[0])
    size = np.array([len(c) for c in chains])
    x = np.zeros((most, n, N_FEATURES), np.float32)
    y = np.zeros((most, n), np.int64)
    for d, (c, listed) in enumerate(zip(chains, labels, strict=True)):
        y[: len(listed), d] = listed
        for t, on in enumerate(c):
            x[t, d, list(on)] = 1
    live = [int((size > t).sum()) for t in range(most)]
    params = [model.emit, model.start, model.step]
    moments = [[np.zeros_like(p) for p in params] for _ in range(2)]
    for k in range(1, steps + 1):
        scores = x @ model.emit
        alpha = np.zeros((most, n, 2))
        alpha[0] = model.start + scores[0]
        for t in range(1, most):
            m = live[t]
            alpha[t, :m] = np.logaddexp.reduce(alpha[t - 1, :m, :, None] + model.step, axis=1) + scores[t, :m]
        beta = np.zeros((most, n, 2))
        for t in range(most - 2, -1, -1):
            m = live[t + 1]
            beta[t, :m] = np.logaddexp.reduce(model.step + (scores[t + 1, :m] + beta[t + 1, :m])[:, None, :], axis=2)
        log_z = np.logaddexp.reduce(alpha[size - 1, np.arange(n)], axis=1)
        g_emit, g_step = -l2 * model.emit, -l2 * model.step
        g_start = np.zeros(2)
        for t in range(most):
            m = live[t]
            away = -np.exp(alpha[t, :m] + beta[t, :m] - log_z[:m, None])
            away[np.arange(m), y[t, :m]] += 1
            away *= weight[:m, None]
            g_emit = g_emit + x[t, :m].T @ away
            if t == 0:
                g_start = away.sum(axis=0)
            else:
                pair = -np.exp(alpha[t - 1, :m, :, None] + model.step + (scores[t, :m] + beta[t, :m])[:, None, :] - log_z[:m, None, None])
                pair[np.arange(m), y[t - 1, :m], y[t, :m]] += 1
                g_step = g_step + np.einsum("d,dij->ij", weight[:m], pair)
        for p, g, m1, m2 in zip(params, (g_emit, g_start, g_step), *moments, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-9)


def relabelled(model: LineField, lines: list[tuple[int, ...]]) -> list[int]:
    """Labels of a bad document's lines: what each line's own features say, one line at least boilerplate."""
    odds = [float(model.emit[list(on)].sum(axis=0) @ (-1, 1)) for on in lines]
    worst = min(range(len(odds)), key=odds.__getitem__, default=None)
    return [int(o > 0 and k != worst) for k, o in enumerate(odds)]


def content_share(labels: list[int], sizes: list[int]) -> float | None:
    """Share of the words that lie in content lines; null without words."""
    return sum(n for n, y in zip(sizes, labels, strict=True) if y) / sum(sizes) if sizes else None


def fit(sample: list[tuple[str, int]], rounds: int = 3, steps: int = 80, rate: float = 0.1, l2: float = 1e-4, part: int = 64, content_weight: float = 0.85, most_lines: int = 200_000) -> LineField:
    """Fit a field to (text, quality) pairs; long chains are fitted in parts of ``part`` lines.

    ``content_weight`` is the weight of all good documents' lines together, of bad ones' the rest:
    over a half keeps doubtful lines and documents.  Documents are taken as they come until they have ``most_lines``
    lines, which bounds memory.  Without a label of each kind everything is content.
    """
    model = LineField()
    held, taken = 0, []
    for text, y in sample:
        lines, sizes, _ = chain(text)
        if lines and held + len(lines) <= most_lines:
            held += len(lines)
            taken.append((lines, sizes, y))
    if len({y for *_, y in taken}) < 2:
        return model
    parts = sorted(((d, at) for d, (lines, *_) in enumerate(taken) for at in range(0, len(lines), part)), key=lambda p: -len(taken[p[0]][0][p[1] : p[1] + part]))
    total = [sum(len(lines) for lines, _, y in taken if y == k) for k in (0, 1)]
    weight = np.array([(1 - content_weight, content_weight)[taken[d][2]] / total[taken[d][2]] for d, _ in parts])
    labels = [[y] * len(lines) for lines, _, y in taken]
    for _ in range(rounds):
        maximise(model, [taken[d][0][at : at + part] for d, at in parts], [labels[d][at : at + part] for d, at in parts], weight, steps, rate, l2)
        labels = [labels[d] if y else relabelled(model, lines) for d, (lines, _, y) in enumerate(taken)]
    memo: dict = {}
    shares = np.array([content_share(model.viterbi(lines, memo), sizes) for lines, sizes, _ in taken])
    good = np.array([y == 1 for *_, y in taken])
    bounds = np.arange(1, 20) / 20
    errors = [content_weight * (shares[good] < b).mean() + (1 - content_weight) * (shares[~good] >= b).mean() for b in bounds]
    best = bounds[np.isclose(errors, min(errors))]
    model.least_share = float(best[np.argmin(np.abs(best - np.median(best)))])
    return model


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that come twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    windows = [joined[a:b] for a, b in zip([0, *ends[: n - 1]], ends[width - 1 :])]
    windows[-1] += b" "  # every other window ends with its space
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    total = covered = 0
    for k, w in enumerate(windows):
        if counts[w] > 1:
            total += k + width - max(covered, k)
            covered = k + width
    return total


def rate(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the base statistics, base_failed, kept, and the labelling's line counts and share.

    ``content_share`` is the share of words that lie in content lines, null without words;
    a document stays if it passes the base rules and the share is the model's least share or more.
    Null texts have no words and fail the base rules; texts of any length are rated whole.  Null or repeated identifiers pass
    through; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            out = Out(RATED)
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                data = text.encode()
                words = data.split()
                n = len(words)
                again = repeated_words(words)
                lines, sizes, dup = chain(text)
                labels = model.viterbi(lines, memo)
                share = content_share(labels, sizes)
                failed = n < 10 or 100 * again > 20 * n
                chars = len(text) - sum(map(text.count, SPACES))
                out.add(doc_id, n, chars, len(data) - len(data.translate(None, SYMBOLS)), dup, again, failed, not failed and share >= model.least_share, len(labels), sum(labels), share)
            if len(out):
                yield out.take()

    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double"
    return pick(docs, id_col, text_col).mapInArrow(run, ddl)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, id_col: str = "doc_id", text_col: str = "text", train: str | None = None) -> LineField:
    """A field fitted on at most ``2 * per_class`` documents with a quality label (see ``labelled_sample``)."""
    return fit(labelled_sample(docs, labels, label, per_class, id_col, text_col, train))
