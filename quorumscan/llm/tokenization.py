"""Encoding by words for ``tokenizers`` files whose pre-tokenizer drops white space.

Such a file encodes the parts between ASCII white space independently: neither
normalisation nor a pre-token nor a special token reaches across it.  So the ids
of a text are those of its words in order, and every distinct word needs the
library only once per worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from quorumscan.llm.common import groups_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores

WORD_BPE = "word_bpe_49k.json"
SEPARATOR = b"|"


def tokenizer_path(path: str | None, default: str = WORD_BPE) -> str:
    """``path``, or the place of the default vocabulary on this machine."""
    return path or public_tokenizers.path(default)


#: Texts on which a file is tested when it is loaded: case, signs, contractions, numbers, marks, other scripts, blanks.
PROBES = ("Hello, World! It's HE'LL don't", "a-b_c(x)[y]{z} 3.14 1,000 foo.bar@example.org", "naïve ÉCOLE ＡＢＣ ﬁ ½ é", "中文 русский 한국어 \U0001f600", "tab\tnew\nline  two", "a|b || |c 'quoted' \"double\"")


class WordMemo:
    """Words to a value made from their ids, filled by batches of unseen words.

    ``keep`` bounds the words of a generation: a full one is kept as the old one, from
    which words that come again are taken over, and then goes.
    """

    def __init__(self, path: str | None, value: Callable[[list[int]], object], keep: int = 300_000) -> None:
        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.folds = self._tested(path)
        (self.separator,) = self.tokenizer.encode(SEPARATOR.decode(), add_special_tokens=False).ids
        self.value, self.keep, self.memo, self.old = value, keep, {}, {}

    def _tested(self, path: str | None) -> bool:
        """Whether ``folded`` texts have the same ids; a file that does not encode words by themselves is an error."""

        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        def by_words(text: bytes) -> list[int]:
            return [i for w in text.split() for i in ids(w.decode())]

        if len(ids(SEPARATOR.decode())) != 1 or any(ids(p) != by_words(p.encode()) for p in PROBES):
            raise ValueError(f"{tokenizer_path(path)} does not encode the words between white space by themselves")
        return all(ids(p) == by_words(folded(p.encode())) for p in PROBES)

    def folded(self, data: bytes) -> bytes:
        return folded(data) if self.folds else data

    def learn(self, words: Iterable[bytes]) -> None:
        words = set(words)
        memo, new = self.memo, words.difference(self.memo)
        if len(memo) + len(new) > self.keep:
            self.old, self.memo = memo, {}
            memo, new = self.memo, words
        listed = []
        for w in new:
            if (known := self.old.get(w)) is None:
                listed.append(w)
            else:
                memo[w] = known
        for w, ids in self._encoded(listed):
            memo[w] = self.value(ids)

    def _encoded(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Ids of distinct words.  Many are encoded as one text, with a word of one id of its own between them."""
        alone = [w for w in words if SEPARATOR in w]
        joined = [w for w in words if SEPARATOR not in w]
        for at in range(0, len(alone), 4096):
            part = alone[at : at + 4096]
            yield from zip(part, (e.ids for e in self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)), strict=True)
        for at in range(0, len(joined), 1 << 14):
            parts = [joined[k : k + 256] for k in range(at, min(at + (1 << 14), len(joined)), 256)]
            texts = [(b" " + SEPARATOR + b" ").join(p).decode() for p in parts]
            for part, e in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids, begin = e.ids, 0
                for w in part[:-1]:
                    end = ids.index(self.separator, begin)
                    yield w, ids[begin:end]
                    begin = end + 1
                yield part[-1], ids[begin:]

    def values(self, data: bytes) -> list:
        """Values of the words of ``data``; texts of any length go in bounded pieces."""
        words = data.split()
        out: list = []
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            got = list(map(self.memo.get, part))
            if None in got:
                self.learn(part)
                got = list(map(self.memo.__getitem__, part))
            out += got
        return out


#: Between a letter and a sign that the pre-tokenizer parts from it anyway (an apostrophe may begin a contraction).
PARTED = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])")


def folded(data: bytes) -> bytes:
    """The same ids from fewer distinct words: A-Z in lower case, signs behind letters apart.

    A text that may hold a special token's string is left as it is.
    """
    return data if b"<|" in data else PARTED.sub(b" ", data.lower())


def encoded(texts: list[bytes], memo: WordMemo) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers; ``memo`` holds words in that form.

    Words are split and numbered by Arrow, so that Python sees each distinct word once.
    """
    words = pc.ascii_split_whitespace(pa.array([memo.folded(t) for t in texts], pa.string()))
    numbered = words.flatten().dictionary_encode()
    distinct = numbered.dictionary.cast(pa.binary()).to_pylist()
    found = list(map(memo.memo.get, distinct))
    if None in found:
        memo.learn(distinct)
        found = list(map(memo.memo.__getitem__, distinct))
    pool = np.frombuffer(b"".join(found), "<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    first = np.cumsum(sizes) - sizes
    which = numbered.indices.to_numpy()
    size = sizes[which]
    after = np.cumsum(size)
    ids = pool[np.repeat(first[which] - (after - size), size) + np.arange(after[-1] if len(after) else 0)]
    cuts = np.r_[0, after][words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
    return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def encoded_rows(batch: pa.RecordBatch, memo: WordMemo) -> Iterator[tuple[object, bytes]]:
    """(doc_id, ids) of the rows of a batch, in groups of bounded size."""
    for group in groups_of(batch, "doc_id", "text"):
        yield from zip((doc_id for doc_id, _ in group), encoded([text.encode() for _, text in group], memo), strict=True)
