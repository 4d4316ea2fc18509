"""A bidirectional gated recurrent network over bytes that labels each position, in numpy.

Sequences are white-space-delimited tokens between two boundary bytes, cut into pieces of ``PIECE`` bytes if longer. What
pads a sequence to the length of a batch leaves the state at zero, so its outputs don't depend on the batch.
Inputs are one-hot, so the input product is a row lookup. Training is backpropagation through time with Adam.
"""

from __future__ import annotations

import numpy as np

PIECE = 32
PAD = 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Weights: for each direction W (256 x 3H: update, reset, candidate), U (H x 3H); on top V (2H x L) and c (L)."""

    def __init__(self, labels: int, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.hidden, self.labels = hidden, labels
        make = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
        self.weights = {"W0": make(256, 3 * hidden), "U0": make(hidden, 3 * hidden), "W1": make(256, 3 * hidden), "U1": make(hidden, 3 * hidden), "V": make(2 * hidden, labels), "c": np.zeros(labels, np.float32)}

    def _run(self, x: np.ndarray, d: int, keep: bool):
        """States after each position of ``x`` (time, batch), and what backpropagation needs."""
        h_n, w, u = self.hidden, self.weights[f"W{d}"], self.weights[f"U{d}"]
        u_zr, u_c = np.ascontiguousarray(u[:, : 2 * h_n]), np.ascontiguousarray(u[:, 2 * h_n :])
        h = np.zeros((x.shape[1], h_n), np.float32)
        states, kept = np.empty((*x.shape, h_n), np.float32), []
        inside = valid(x)
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            a = w[x[t]]
            zr = _sigmoid(a[:, : 2 * h_n] + h @ u_zr)
            z, r = zr[:, :h_n], zr[:, h_n:]
            c = np.tanh(a[:, 2 * h_n :] + (r * h) @ u_c)
            new = h + z * (c - h)
            new *= inside[t]
            if keep:
                kept.append((t, h, z, r, c, inside[t]))
            states[t] = h = new
        return states, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each label at each position of ``x`` (time, batch)."""
        both = np.concatenate((self._run(x, 0, False)[0], self._run(x, 1, False)[0]), axis=2)
        return _softmax(both @ self.weights["V"] + self.weights["c"])

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for labels ``y`` (batch) at the positions of ``weight`` (time, batch)."""
        h_n, (t_n, b_n) = self.hidden, x.shape
        runs = [self._run(x, d, True) for d in (0, 1)]
        both = np.concatenate((runs[0][0], runs[1][0]), axis=2)
        p = _softmax(both @ self.weights["V"] + self.weights["c"])
        rows = np.arange(b_n)
        total = max(float(weight.sum()), 1e-6)
        loss = float(-(np.log(p[:, rows, y] + 1e-9) * weight).sum() / total)
        p[:, rows, y] -= 1
        p *= (weight / total)[:, :, None]
        g = {"V": both.reshape(-1, 2 * h_n).T @ p.reshape(-1, self.labels), "c": p.sum(axis=(0, 1))}
        up = p @ self.weights["V"].T
        for d, (_, kept) in enumerate(runs):
            u = self.weights[f"U{d}"]
            gw, gu = np.zeros_like(self.weights[f"W{d}"]), np.zeros_like(u)
            dh = np.zeros((b_n, h_n), np.float32)
            for t, h, z, r, c, here in reversed(kept):
                dh = (dh + up[t, :, d * h_n : (d + 1) * h_n]) * here
                da = np.empty((b_n, 3 * h_n), np.float32)
                da[:, :h_n] = dh * (c - h) * z * (1 - z)
                da[:, 2 * h_n :] = dc = dh * z * (1 - c * c)
                drh = dc @ u[:, 2 * h_n :].T
                da[:, h_n : 2 * h_n] = drh * h * r * (1 - r)
                np.add.at(gw, x[t], da)
                gu[:, : 2 * h_n] += h.T @ da[:, : 2 * h_n]
                gu[:, 2 * h_n :] += (r * h).T @ dc
                dh = dh * (1 - z) + drh * r + da[:, : 2 * h_n] @ u[:, : 2 * h_n].T
            g[f"W{d}"], g[f"U{d}"] = gw, gu
        return loss, g

    def train(self, tokens: list[bytes], y: np.ndarray, weight: np.ndarray | None = None, steps: int = 1500, batch: int = 256, rate: float = 0.01, seed: int = 7) -> float:
        """Fits ``y`` (a label for each token, of a ``weight``) and returns the last loss. Batches hold tokens of like length."""
        lengths = np.array([len(t) for t in tokens])
        order = np.argsort(lengths, kind="stable")
        r, m, v, loss = np.random.default_rng(seed), {}, {}, 0.0
        for step in range(1, steps + 1):
            at = int(r.integers(0, max(1, len(order) - batch + 1)))
            rows = order[at : at + batch]
            x, inside = padded([tokens[i] for i in rows])
            loss, g = self.gradients(x, y[rows], inside if weight is None else inside * weight[rows].astype(np.float32))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, d in g.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                v[k] = 0.99 * v.get(k, 0) + 0.01 * d * d
                self.weights[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def valid(x: np.ndarray) -> np.ndarray:
    """1 (time, batch, 1) up to the boundary that ends each sequence of ``x``, 0 in what pads it."""
    ends = len(x) - (x[::-1] != PAD).argmax(axis=0)  # all sequences have a byte other than PAD
    return (np.arange(len(x))[:, None] <= ends).astype(np.float32)[:, :, None]


def padded(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the tokens between boundaries (time, batch), and 1 where a byte is of a letter, ASCII or not."""
    t = max(map(len, tokens), default=0) + 2
    x = np.frombuffer(b"".join((b" " + k).ljust(t) for k in tokens), np.uint8).reshape(len(tokens), t).T
    inside = (x >= 128) | ((x | 32) >= 97) & ((x | 32) <= 122)
    return x, inside.astype(np.float32)
