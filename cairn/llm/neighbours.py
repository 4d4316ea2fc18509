"""Exact nearest neighbours by TF-IDF cosine over a block-max inverted index.

Examples with equal vectors are one entry with its labels summed. Entries are dealt into blocks, like ones together. For
each term the index has its postings; for terms in many entries also the greatest weight in each block. A query adds up
the short lists, and with the blocks' greatest weights of the long ones that bounds the cosines in each block. It looks
at the most promising block first, and of the others only at those whose bound reaches the k-th best cosine found there,
so the result is that of looking at all. What comes within rounding of the k-th best is computed again in double
precision, in an order that does not depend on the other queries.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np

BLOCK = 256
#: Terms in one of so many entries or more have long lists; so many queries are worked at once.
COMMON, QUERIES = 8, 128
#: Postings that are sorted at once.
POSTINGS = 1 << 18
#: More than float32 sums can be off.
_SLACK = 1e-4

Sparse = tuple[np.ndarray, np.ndarray]


def sparse(vector: dict[int, float] | Sparse) -> Sparse:
    """A vector as its terms, rising, and their weights."""
    if isinstance(vector, tuple):
        return vector
    items = sorted(vector.items())
    return np.array([t for t, _ in items], np.int64), np.array([w for _, w in items], np.float64)


class Entries:
    """``n`` examples, ``ones`` of them with label 1, in each entry."""

    n: np.ndarray
    ones: np.ndarray

    def weigh(self, near: list[tuple[int, float]], k: int, without: int | None = None, label: int = 0, power: int = 1) -> tuple[float, list[tuple[int, float]]] | None:
        """The share of label 1 among the ``k`` nearest, weighted by a power of the distance, and those; None if nothing has a term in common."""
        total = ones = 0.0
        left = float(k)
        for e, cosine in near:
            n, y = self.n[e] - (e == without), self.ones[e] - (label if e == without else 0)
            if n <= 0:
                continue
            take = min(left, n)
            weight = 1 / (1.05 - min(cosine, 1.0)) ** power
            total += weight * take
            ones += weight * take * y / n
            left -= take
        return (ones / total, near) if total else None


class Index(Entries):
    def __init__(self, vectors: Iterable[dict[int, float] | Sparse], labels: list[int], ids: list[int]):
        """``vectors``: term to weight of unit length; terms are small integers. Those without terms are no neighbours."""
        same: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
        for row, v in enumerate(vectors):
            at, w = sparse(v)
            if len(at):
                same[at.astype(np.int32).tobytes(), w.astype(np.float32).tobytes()].append(row)
        heads = []
        for at, w in same:
            top = np.argsort(-np.frombuffer(w, np.float32), kind="stable")[:2]
            heads.append((np.frombuffer(at, np.int32)[top].tolist(), at, w))
        keys = [h[1:] for h in sorted(heads)]  # like entries come to lie together, which tightens the bounds
        self.entry = {r: e for e, k in enumerate(keys) for r in same[k]}
        self.n = np.array([len(same[k]) for k in keys], np.float64)
        self.ones = np.array([sum(labels[r] for r in same[k]) for k in keys], np.float64)
        self.ids = [[ids[r] for r in same[k]] for k in keys]
        self.start = np.cumsum([0, *(len(k[0]) // 4 for k in keys)])
        self.term = np.frombuffer(b"".join(k[0] for k in keys), np.int32)
        self.weight = np.frombuffer(b"".join(k[1] for k in keys), np.float32)
        self.lists = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lists": None}

    def _lists(self) -> tuple:
        """What a search needs and the above tell; not sent to executors, and may be set to None between searches."""
        if self.lists is None:
            df = np.bincount(self.term)
            blocks = -(-len(self.n) // BLOCK)
            common = np.full(len(df), -1, np.int32)
            chosen = np.flatnonzero(df * COMMON >= len(self.n))
            common[chosen] = np.arange(len(chosen))
            start = np.concatenate([[0], np.cumsum(np.where(common < 0, df, 0))])
            matrix = np.zeros((len(chosen), blocks * BLOCK), np.float32)
            rows, weights, filled = np.empty(start[-1], np.int32), np.empty(start[-1], np.float32), 0
            many = np.searchsorted(start, np.arange(0, start[-1], POSTINGS), "right")  # some terms at a time, as sorting takes several times the lists' memory
            for low, high in zip([0, *many[1:]], [*many[1:], len(df)], strict=True) if len(many) else ():
                at = np.flatnonzero((self.term >= low) & (self.term < high) & (common[self.term] < 0))
                at = at[np.argsort(self.term[at], kind="stable")]
                rows[filled : filled + len(at)] = np.searchsorted(self.start, at, "right") - 1
                weights[filled : filled + len(at)] = self.weight[at]
                filled += len(at)
            at = np.flatnonzero(common[self.term] >= 0)
            matrix[common[self.term[at]], np.searchsorted(self.start, at, "right") - 1] = self.weight[at]
            most = matrix.reshape(len(chosen), blocks, BLOCK).max(axis=2)
            self.lists = common, matrix, most, rows, weights, start
        return self.lists

    def search(self, query: dict[int, float] | Sparse, k: int, without: int | None = None) -> list[tuple[int, float]]:
        """The entries (index, cosine) that hold the ``k`` nearest examples, nearest first, ties by index.

        ``without``: an entry of which one example is not to count, as when that example is the query.
        """
        return self.search_all([query], k, [without])[0]

    def search_all(self, queries: list[dict[int, float] | Sparse], k: int, without: list[int | None] | None = None) -> list[list[tuple[int, float]]]:
        """``search`` of each."""
        if not len(self.n):
            return [[] for _ in queries]
        common, matrix, most, rows, weights, start = self._lists()
        blocks, out = most.shape[1], []
        dense = np.zeros(len(common))
        for first in range(0, len(queries), QUERIES):
            vectors = [(at[at < len(common)], w[at < len(common)]) for at, w in map(sparse, queries[first : first + QUERIES])]
            left = np.zeros((len(vectors), len(matrix)), np.float32)
            score = np.zeros((len(vectors), blocks * BLOCK), np.float32)
            for i, (at, w) in enumerate(vectors):
                rare = common[at] < 0
                left[i, common[at[~rare]]] = w[~rare]
                places, lengths = _runs(start, at[rare])
                score[i] = np.bincount(rows[places], weights[places] * np.repeat(w[rare], lengths), blocks * BLOCK)
            bound = score.reshape(len(vectors), blocks, BLOCK).max(axis=2) + left @ most
            best, looked = bound.argmax(axis=1), np.zeros(bound.shape, bool)
            self._look(score, left, matrix, best[:, None] == np.arange(blocks), looked)
            least = np.zeros(len(vectors), np.float32)
            for i, b in enumerate(best):
                there = score[i, b * BLOCK : (b + 1) * BLOCK]
                if k < BLOCK:
                    least[i] = np.partition(there, -k - 1)[-k - 1]
            self._look(score, left, matrix, ~looked & (bound > 0) & (bound >= least[:, None] - _SLACK), looked)
            for i, (at, w) in enumerate(vectors):
                own = without[first + i] if without else None
                got = np.where(np.repeat(looked[i], BLOCK)[: len(self.n)], score[i, : len(self.n)], 0)
                m = min(k + 1, len(got))
                near = np.flatnonzero((got > 0) & (got >= np.partition(got, -m)[-m] - _SLACK))
                out.append(self._nearest(near, at, w, dense, k, own) if len(near) else [])
        return out

    @staticmethod
    def _look(score: np.ndarray, left: np.ndarray, matrix: np.ndarray, at: np.ndarray, looked: np.ndarray) -> None:
        """Adds the long lists' part to ``score`` in the blocks that ``at`` (query, block) tells."""
        for b in np.flatnonzero(at.any(axis=0)):
            some, here = np.flatnonzero(at[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
            score[some, here] += left[some] @ matrix[:, here]
        looked |= at

    def _nearest(self, near: np.ndarray, at: np.ndarray, w: np.ndarray, dense: np.ndarray, k: int, own: int | None) -> list[tuple[int, float]]:
        dense[at] = w
        places, lengths = _runs(self.start, near)
        cosine = np.round(np.add.reduceat(self.weight[places] * dense[self.term[places]], np.cumsum(lengths) - lengths), 9)
        dense[at] = 0
        got, held = [], 0.0
        for j in np.lexsort((near, -cosine)):
            if cosine[j] <= 0:
                break
            got.append((int(near[j]), float(cosine[j])))
            held += self.n[near[j]] - (near[j] == own)
            if held >= k:
                break
        return got


def _runs(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the runs ``of``, one after the other, and their lengths."""
    lengths = start[of + 1] - start[of]
    return np.repeat(start[of] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum()), lengths
