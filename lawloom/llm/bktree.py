"""BK-tree over words under the Levenshtein distance, searched for many words at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_PAIRS = 1 << 15  # pairs per step: they stay in the processor's cache


def encode(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as a padded matrix, and lengths."""
    lengths = np.array([len(w) for w in words], dtype=np.int32)
    codes = np.zeros((len(words), max(1, int(lengths.max(initial=0)))), dtype=np.uint32)
    for i, w in enumerate(words):
        codes[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32)
    return codes, lengths


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """The Levenshtein distance of each pair of rows: one dynamic programme, its cells vectors over the pairs."""
    n, width = len(a), int(lb.max(initial=0))
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    row = np.repeat(np.arange(width + 1, dtype=np.int16)[:, None], n, axis=1)
    new, other = np.empty_like(row), np.empty(n, dtype=np.int16)
    out = np.where(la == 0, lb, 0).astype(np.int16)
    for i in range(int(la.max(initial=0))):
        new[0] = i + 1
        for j in range(width):
            np.add(row[j], a[i] != b[j], out=new[j + 1])
            np.minimum(row[j + 1], new[j], out=other)
            other += 1
            np.minimum(new[j + 1], other, out=new[j + 1])
        row, new = new, row
        done = np.flatnonzero(la == i + 1)
        out[done] = row[lb[done], done]
    return out


class BKTree:
    """Every word hangs under its parent by its distance to it; the triangle inequality prunes the rest."""

    def __init__(self, words: Sequence[str]):
        self.words = list(dict.fromkeys(words))
        self.codes, self.lengths = encode(self.words)
        children: list[dict[int, int]] = [{} for _ in self.words]
        # insert level by level: all words below one node are split by their distance to it
        work = [(0, np.arange(1, len(self.words)))] if self.words else []
        while work:
            node, below = work.pop()
            if not len(below):
                continue
            d = self._to(node, below)
            for edge in np.unique(d):
                group = below[d == edge]
                children[node][int(edge)] = int(group[0])
                work.append((int(group[0]), group[1:]))
        counts = [len(c) for c in children]
        self.start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.edge = np.array([e for c in children for e in c], dtype=np.int16)
        self.child = np.array([x for c in children for x in c.values()], dtype=np.int64)

    def _to(self, node: int, others: np.ndarray) -> np.ndarray:
        n = len(others)
        return distances(np.broadcast_to(self.codes[node], (n, self.codes.shape[1])), np.full(n, self.lengths[node]), self.codes[others], self.lengths[others])

    def search(self, words: Sequence[str], within: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (query, word, distance) with a distance of at most ``within`` of the query."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if words and self.words:
            codes, lengths = encode(words)
            limit = np.asarray(within, dtype=np.int16)
            todo = [(np.arange(len(words)), np.zeros(len(words), dtype=np.int64))]
            while todo:
                q, node = todo.pop()
                if len(q) > _PAIRS:
                    todo += [(q[i : i + _PAIRS], node[i : i + _PAIRS]) for i in range(0, len(q), _PAIRS)]
                    continue
                d = distances(codes[q], lengths[q], self.codes[node], self.lengths[node])
                hit = d <= limit[q]
                found.append((q[hit], node[hit], d[hit]))
                n = self.start[node + 1] - self.start[node]
                if not n.sum():
                    continue
                at = np.repeat(self.start[node] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                q, d = np.repeat(q, n), np.repeat(d, n)
                near = np.abs(self.edge[at] - d) <= limit[q]
                if near.any():
                    todo.append((q[near], self.child[at][near]))
        if not found:
            return np.array([], np.int64), np.array([], np.int64), np.array([], np.int16)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
