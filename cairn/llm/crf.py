"""A linear-chain conditional random field with two labels, in numpy. Label 1 is main text."""

from __future__ import annotations

import numpy as np


class Chain:
    def __init__(self, features: int):
        self.unary = np.zeros((features, 2))
        self.pair = np.zeros((2, 2))

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.1, l2: float = 1e-4) -> float:
        """Maximises the likelihood of ``pages`` (features, labels) by Adam over all at once; returns the mean loss."""
        n, t = len(pages), max(len(y) for _, y in pages)
        x, y, mask = np.zeros((n, t, self.unary.shape[0])), np.zeros((n, t), int), np.zeros((n, t))
        for i, (a, b) in enumerate(pages):
            x[i, : len(b)], y[i, : len(b)], mask[i, : len(b)] = a, b, 1
        want = np.eye(2)[y] * mask[..., None]
        want_pair = np.einsum("nta,ntb->ab", want[:, :-1], want[:, 1:])
        moments = [np.zeros_like(v) for v in (self.unary, self.unary, self.pair, self.pair)]
        loss = 0.0
        for step in range(1, steps + 1):
            e = x @ self.unary
            f, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
            f[:, 0] = e[:, 0]
            for k in range(1, t):
                new = np.logaddexp.reduce(f[:, k - 1, :, None] + self.pair, axis=1) + e[:, k]
                f[:, k] = np.where(mask[:, k, None] > 0, new, f[:, k - 1])
            z = np.logaddexp.reduce(f[:, -1], axis=1)
            for k in range(t - 2, -1, -1):
                new = np.logaddexp.reduce(self.pair + (e[:, k + 1] + b[:, k + 1])[:, None, :], axis=2)
                b[:, k] = np.where(mask[:, k + 1, None] > 0, new, 0)
            p = np.exp(f + b - z[:, None, None]) * mask[..., None]
            both = np.exp(f[:, :-1, :, None] + self.pair + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
            loss = float((z - (e * want).sum((1, 2)) - np.einsum("nta,ntb,ab->n", want[:, :-1], want[:, 1:], self.pair)).mean())
            grads = (x.reshape(n * t, -1).T @ (p - want).reshape(n * t, 2) / n + l2 * self.unary, (both.sum((0, 1)) - want_pair) / n + l2 * self.pair)
            for j, (v, g) in enumerate(zip((self.unary, self.pair), grads, strict=True)):
                m, s = moments[2 * j], moments[2 * j + 1]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        return loss

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels of one page (Viterbi); label 1 on a tie."""
        e = x @ self.unary
        back = np.zeros((len(e), 2), int)
        score = e[0]
        for k in range(1, len(e)):
            every = score[:, None] + self.pair
            back[k] = [1 if every[1, j] >= every[0, j] else 0 for j in (0, 1)]
            score = every[back[k], [0, 1]] + e[k]
        labels = np.zeros(len(e), int)
        labels[-1] = int(score[1] >= score[0])
        for k in range(len(e) - 1, 0, -1):
            labels[k - 1] = back[k, labels[k]]
        return labels
