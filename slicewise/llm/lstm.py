"""A bidirectional LSTM that labels every element of a sequence, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time x sequence x features, lengths)."""
    lengths = np.array([len(s) for s in sequences])
    out = np.zeros((lengths.max(), len(sequences), sequences[0].shape[1]), np.float32)
    for k, s in enumerate(sequences):
        out[: len(s), k] = s
    return out, lengths


def reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence back to front within its own length; padding stays at the end."""
    t = np.arange(len(x))[:, None]
    at = np.where(t < lengths[None, :], lengths[None, :] - 1 - t, t)
    return np.take_along_axis(x, at[:, :, None], axis=0)


class Labeller:
    """Weights and both passes; the label of an element depends on the whole sequence."""

    def __init__(self, features: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights = {}
        for d in "fb":
            self.weights[f"x{d}"] = (rng.standard_normal((features, 4 * hidden)) / np.sqrt(features)).astype(np.float32)
            self.weights[f"h{d}"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember by default
            self.weights[f"c{d}"] = bias
        self.weights["out"] = (rng.standard_normal(2 * hidden) / np.sqrt(2 * hidden)).astype(np.float32)
        self.weights["own"] = np.zeros(features, np.float32)  # of the element itself, beside its context
        self.weights["bias"] = np.zeros(1, np.float32)

    def walk(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction, and what its way back needs."""
        w, h = self.weights, self.hidden
        steps, n, _ = x.shape
        drive = x @ w[f"x{d}"] + w[f"c{d}"]
        states = np.zeros((steps + 1, n, h), np.float32)
        cell = np.zeros((n, h), np.float32)
        gates = []
        for t in range(steps):
            z = drive[t] + states[t] @ w[f"h{d}"]
            s = sigmoid(z[:, : 3 * h])
            i, f, o, g = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, cell = cell, f * cell + i * g
            squashed = np.tanh(cell)
            states[t + 1] = o * squashed
            if keep:
                gates.append((i, f, o, g, before, squashed))
        return states, gates

    def scores(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Log-odds of label 1 (time x sequence), and the states for training."""
        h = self.hidden
        forward, gates_f = self.walk(x, "f", keep)
        back, gates_b = self.walk(reverse(x, lengths), "b", keep)
        ahead = reverse(back[1:], lengths)
        w = self.weights
        z = forward[1:] @ w["out"][:h] + ahead @ w["out"][h:] + x @ w["own"] + w["bias"]
        return z, (forward, gates_f, back, gates_b, ahead)

    def back_through(self, x, states, gates, d: str, dh: np.ndarray, grads: dict) -> None:
        """Gradients of one direction from those of its hidden states."""
        w, h = self.weights, self.hidden
        carry, cell = np.zeros_like(dh[0]), np.zeros_like(dh[0])
        dz = np.zeros((*dh.shape[:2], 4 * h), np.float32)
        for t in range(len(dh) - 1, -1, -1):
            i, f, o, g, before, squashed = gates[t]
            now = dh[t] + carry
            cell = cell + now * o * (1 - squashed**2)
            dz[t, :, :h] = cell * g * i * (1 - i)
            dz[t, :, h : 2 * h] = cell * before * f * (1 - f)
            dz[t, :, 2 * h : 3 * h] = now * squashed * o * (1 - o)
            dz[t, :, 3 * h :] = cell * i * (1 - g**2)
            cell = cell * f
            carry = dz[t] @ w[f"h{d}"].T
        flat = dz.reshape(-1, 4 * h)
        grads[f"x{d}"] = x.reshape(-1, x.shape[2]).T @ flat
        grads[f"h{d}"] = states[:-1].reshape(-1, h).T @ flat
        grads[f"c{d}"] = flat.sum(0)

    def gradients(self, x, lengths, labels) -> tuple[dict, float]:
        """Gradients of the mean log-loss over all elements, and that loss."""
        h, w = self.hidden, self.weights
        z, (forward, gates_f, back, gates_b, ahead) = self.scores(x, lengths, True)
        live = np.arange(len(x))[:, None] < lengths[None, :]
        p = sigmoid(z)
        loss = -np.log(np.where(labels > 0, p, 1 - p) + 1e-9)[live].mean()
        error = np.where(live, p - labels, 0).astype(np.float32) / max(1, live.sum())
        grads = {"bias": error.sum(keepdims=True).reshape(1)}
        grads["own"] = np.einsum("tn,tnf->f", error, x)
        grads["out"] = np.concatenate(
            [np.einsum("tn,tnh->h", error, forward[1:]), np.einsum("tn,tnh->h", error, ahead)]
        )
        self.back_through(x, forward, gates_f, "f", error[:, :, None] * w["out"][:h], grads)
        turned = reverse(error[:, :, None] * w["out"][h:], lengths)
        self.back_through(reverse(x, lengths), back, gates_b, "b", turned, grads)
        return grads, float(loss)

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int, batch: int, rate: float, seed: int):
        """Adam over batches of sequences of like length."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(x) for k, x in self.weights.items()}
        order = np.argsort([len(s) for s in sequences], kind="stable")
        parts = [order[k : k + batch] for k in range(0, len(order), batch)]
        step, total = 0, epochs * len(parts)
        for _ in range(epochs):
            for part in [parts[k] for k in rng.permutation(len(parts))]:
                x, lengths = padded([sequences[k] for k in part])
                y, _ = padded([labels[k][:, None] for k in part])
                grads, _ = self.gradients(x, lengths, y[:, :, 0])
                step += 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                pace = rate * (1 - step / (total + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.weights[k] -= (pace * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        return self

    def labels(self, sequences: list[np.ndarray], most: int = 1 << 14) -> list[np.ndarray]:
        """True for each element of label 1. At most `most` elements (or one sequence) are worked on at once."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(sequences)
        order = sorted((k for k in range(len(sequences)) if len(sequences[k])), key=lambda k: len(sequences[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(sequences[order[end]]) <= most:
                end += 1
            part = order[at:end]
            x, lengths = padded([sequences[k] for k in part])
            z, _ = self.scores(x, lengths)
            for i, k in enumerate(part):
                out[k] = z[: lengths[i], i] > 0
            at = end
        return out
