"""Vectorised hashes of byte strings, and reading of Arrow batches by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_powers = {}


def powers(n: int, base: np.uint64 = _B) -> np.ndarray:
    """base ** 0 .. n - 1, modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(m, base, dtype=np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser after which each bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each run of bytes other than white space."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    black = np.concatenate(([False], (b != 32) & ((b < 9) | (b > 13)), [False]))
    edge = np.flatnonzero(black[1:] != black[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(len(b)), dtype=np.uint64)))
    return mixed((total[end] - total[start]) * powers(len(b) + 1, _B_INVERSE)[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's ``n`` words in a row; of all its words if they are fewer."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9FB21C651E98DF25) + w[i : len(w) - k + 1 + i]
    return np.unique(mixed(h))


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys``, from batches whose rows come sorted by them. Holds one run and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(key).to_numpy(zero_copy_only=False) for key in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), k.shape[1]]
        for a, z in zip(cuts, cuts[1:], strict=False):
            mine = k[:, a].tolist()
            if held and mine != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            last = mine
    if held:
        yield pa.Table.from_batches(held)
