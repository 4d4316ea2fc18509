"""Deep-shallow sorting of suffixes, in numpy.

``Sorter`` orders suffixes of a byte string that are compared over a bounded length. Shallow phase: multikey quicksort,
eight bytes a step, to depth ``SHALLOW``. Deep phase, for the groups that still share a prefix: blind tries. A group's
first suffix is the trie's spine; of every other suffix only the place where it leaves the spine and the byte it leaves
by are kept, which orders it before or after the spine and puts it on a branch. Branches are groups of their own in
the next round. All groups of a round are worked at once.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


class Sorter:
    def __init__(self, data: bytes, depth: int):
        """Suffixes of ``data`` are compared over ``depth`` bytes (a multiple of 8); past the end there are zero bytes."""
        self.depth = depth
        padded = np.frombuffer(data + b"\0" * (depth + 8), np.uint8)
        self.bytes = padded
        self.words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))

    def order(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``at`` sorted within ``group``, as indices, and for each of those the number of its class of equal suffixes.

        ``group`` is a non-decreasing array of integers.
        """
        perm = np.arange(len(at))
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(at) else np.empty(0, np.int64)
        final = np.zeros(len(at), bool)  # at the first of each class in perm
        final[start] = True
        live = self._live(start, len(at))
        for d in range(0, min(SHALLOW, self.depth), 8):
            if not len(live[0]):
                break
            rows, g = live
            key = self.words[at[perm[rows]] + d].astype(np.uint64)
            live = self._split(perm, final, rows, g, (key,))
        while len(live[0]):
            rows, g = live
            first = np.concatenate(([True], g[1:] != g[:-1]))
            mine, spine = at[perm[rows]], at[perm[rows[first]]][np.cumsum(first) - 1]
            lcp = self._lcp(mine, spine)
            same = lcp >= self.depth
            off = np.minimum(lcp, self.depth - 1)
            byte, other = self.bytes[mine + off].astype(np.int64), self.bytes[spine + off].astype(np.int64)
            side = np.where(same, 0, np.where(byte < other, -1, 1))
            # Leaving early sorts further out on either side of the spine; then the byte decides.
            branch = np.where(same, 0, side * (self.depth - lcp) * 256 + byte)
            live = self._split(perm, final, rows, g, (branch,), done=same)
        return perm, np.cumsum(final) - 1

    def _lcp(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), self.depth, np.int64)
        todo = np.arange(len(a))
        for d in range(0, self.depth, 8):
            x = self.words[a[todo] + d].astype(np.uint64) ^ self.words[b[todo] + d].astype(np.uint64)
            hit = x != 0
            if hit.any():
                y = x[hit]
                lead = np.zeros(len(y), np.int64)
                for bits in (32, 16, 8):
                    zero = (y >> np.uint64(64 - bits)) == 0
                    lead += zero * (bits // 8)
                    y = np.where(zero, y << np.uint64(bits), y)
                out[todo[hit]] = d + lead
                todo = todo[~hit]
                if not len(todo):
                    break
        return out

    @staticmethod
    def _live(start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(np.append(start, n))
        g = np.repeat(np.arange(len(start)), size)
        keep = np.repeat(size > 1, size)
        return np.flatnonzero(keep), g[keep]

    @staticmethod
    def _split(perm: np.ndarray, final: np.ndarray, rows: np.ndarray, g: np.ndarray, keys: tuple, done: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sorts ``rows`` of ``perm`` by group and key, marks where classes begin, and returns the rows still open."""
        by = np.lexsort((*keys, g))
        perm[rows] = perm[rows][by]
        g, key = g[by], keys[0][by]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])))
        final[rows[new]] = True
        size = np.diff(np.append(np.flatnonzero(new), len(rows)))
        keep = np.repeat(size > 1, size)
        if done is not None:
            keep &= ~done[by]
        return rows[keep], (np.cumsum(new) - 1)[keep]
