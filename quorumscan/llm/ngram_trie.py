"""A trie of smoothed n-grams in memory-mapped levels.

Levels: words; the contexts that end in a word, the word before it or none; the words that follow a context.
A level has its nodes' words in Elias-Fano form, pointers to the first child of each node, and quantised
values: the weight of what a context leaves to the shorter one, the smoothed probability of what follows.
Words of a level are numbers among the trie's own words, raised by the last number of the range before, so that a level never
falls; a child is found by a successor search in the range of its context alone.
"""

from __future__ import annotations

import mmap

import numpy as np

from quorumscan.llm.elias_fano import EliasFano

#: Steps of a quantised logarithm in a unit.  The grid is fixed, so a value does not depend on what else its trie holds.
STEPS = 2048


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the values, logarithms from 0 down to -31, and each code's value: the nearest one of the grid."""
    codes = np.clip(np.rint(values * -STEPS), 0, (1 << 16) - 1).astype(np.uint16)
    return codes, -np.arange(int(codes.max(initial=0)) + 1) / STEPS


def _raised(child: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """Numbers that rise within each range, raised by the last of the range before."""
    last = child[pointers[1:] - 1]  # no range is empty
    base = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(last) else last
    return child + np.repeat(base, np.diff(pointers))


class Trie:
    """Levels over one buffer; ``build`` makes it in an anonymous memory map, ``write`` and ``Trie`` use any other."""

    def __init__(self, buffer: bytes | mmap.mmap) -> None:
        self.buffer = buffer
        head = np.frombuffer(buffer, np.int64, 1)[0]
        table = np.frombuffer(buffer, np.int64, 3 * head, 8).reshape(head, 3)
        kinds = {0: np.int64, 1: np.uint64, 2: np.uint8, 3: np.float64, 4: np.uint16}
        parts = iter([np.frombuffer(buffer, kinds[k], n, at) for k, n, at in table.tolist()])

        def sequence() -> EliasFano:
            return EliasFano(*(next(parts) for _ in range(4)))

        self.words, self.contexts_of, self.contexts, self.next_of, self.next = (sequence() for _ in range(5))
        self.left, self.left_values, self.p, self.p_values = parts

    @staticmethod
    def build(word: np.ndarray, contexts: np.ndarray, context: np.ndarray, next_of: np.ndarray, follows: np.ndarray, left: np.ndarray, p: np.ndarray) -> Trie:
        """``word`` sorted; ``contexts`` and ``next_of`` point to the first child, one more at the end; ``context`` and ``follows`` rise
        within each range; ``left`` and ``p`` are logarithms."""
        parts = [a for values in (word, contexts, _raised(context, contexts), next_of, _raised(follows, next_of)) for a in EliasFano.parts(values)]
        parts += [*quantised(left), *quantised(p)]
        sizes = [(a.nbytes + 7) // 8 * 8 for a in parts]
        begin = 8 + 24 * len(parts)
        places = begin + np.concatenate([[0], np.cumsum(sizes)])
        kinds = {"int64": 0, "uint64": 1, "uint8": 2, "float64": 3, "uint16": 4}
        table = np.array([(kinds[a.dtype.name], len(a), at) for a, at in zip(parts, places, strict=False)], np.int64)
        out = mmap.mmap(-1, int(places[-1]) + 8)
        out[:8] = np.int64(len(parts)).tobytes()
        out[8:begin] = table.tobytes()
        for a, at in zip(parts, places.tolist(), strict=False):
            out[at : at + a.nbytes] = a.tobytes()
        return Trie(out)

    def write(self, path: str) -> None:
        """A file that ``Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))`` opens."""
        with open(path, "wb") as f:
            f.write(self.buffer)

    @staticmethod
    def _child(pointers: EliasFano, level: EliasFano, node: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The place of a child in the next level, -1 where the node is -1 or has no such child."""
        out = np.full(len(node), -1, np.int64)
        ask = np.flatnonzero(node >= 0)
        if len(ask) and level.n:
            begin, end = pointers.get(node[ask]), pointers.get(node[ask] + 1)
            base = np.where(begin > 0, level.get(np.maximum(begin - 1, 0)), 0)
            out[ask] = level.find(base + child[ask], begin, end)
        return out

    def context(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Nodes of the contexts (before, word); ``before`` 0 is the word alone."""
        zero = np.zeros(len(word), np.int64)
        known = self.words.find(word, zero, zero + self.words.n) if self.words.n else zero - 1
        return self._child(self.contexts_of, self.contexts, known, before)

    def follow(self, node: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word is known to follow a context, and its logarithm there; else what the context leaves to the shorter one."""
        place = self._child(self.next_of, self.next, node, word)
        left = self.left_values[self.left[np.maximum(node, 0)]] if len(self.left) else np.zeros(len(node))
        p = self.p_values[self.p[np.maximum(place, 0)]] if len(self.p) else np.zeros(len(node))
        return place >= 0, np.where(place >= 0, p, np.where(node >= 0, left, 0.0))
