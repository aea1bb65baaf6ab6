"""A small convolutional network over bytes, trained and applied with numpy alone.

Bytes are embedded, filters of several widths slide over a fixed-length window, each filter is max-pooled over the
window, and a hidden layer and a linear layer turn the pooled values into class logits.
"""

from __future__ import annotations

import numpy as np


class ByteNet:
    def __init__(self, widths: dict[int, int], classes: int, embed: int = 8, hidden: int = 24, stride: int = 1, seed: int = 7):
        r = np.random.default_rng(seed)
        self.k, self.e, self.stride = max(widths), embed, stride
        filters = sum(widths.values())
        mask = np.zeros((self.k, embed, filters), np.float32)
        at = 0
        for width, n in sorted(widths.items()):
            mask[:width, :, at : at + n] = 1
            at += n
        self.mask = mask.reshape(-1, filters)
        scale = 1 / np.sqrt(self.mask.sum(0))
        f = lambda *s: r.standard_normal(s).astype(np.float32)
        self.p = {"emb": f(256, embed), "w": f(self.k * embed, filters) * self.mask * scale, "b": np.zeros(filters, np.float32), "w1": f(filters, hidden) / np.float32(np.sqrt(filters)), "b1": np.zeros(hidden, np.float32), "w2": f(hidden, classes) * np.float32(0.1), "b2": np.zeros(classes, np.float32)}
        self.p["emb"][0] = 0

    def columns(self, x: np.ndarray) -> np.ndarray:
        """[windows, places, width * embedding] of byte windows [windows, length]."""
        e = self.p["emb"][x]
        n, length, dim = e.shape
        places = (length - self.k) // self.stride + 1
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (n, places, self.k, dim), (s[0], s[1] * self.stride, s[1], s[2]))
        return view.reshape(n, places, self.k * dim)

    def pooled(self, x: np.ndarray):
        cols = self.columns(x)
        n, places, dim = cols.shape
        z = (cols.reshape(-1, dim) @ self.p["w"]).reshape(n, places, -1)
        return cols, z

    def logits(self, x: np.ndarray) -> np.ndarray:
        _, z = self.pooled(x)
        a = np.maximum(z.max(1) + self.p["b"], 0)
        return np.maximum(a @ self.p["w1"] + self.p["b1"], 0) @ self.p["w2"] + self.p["b2"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """The gradients of the mean cross-entropy of windows ``x`` [n, length] with classes ``y``."""
        p, n = self.p, len(x)
        cols, z = self.pooled(x)
        where = z.argmax(1)
        top = np.take_along_axis(z, where[:, None, :], 1)[:, 0] + p["b"]
        a = np.maximum(top, 0)
        u = a @ p["w1"] + p["b1"]
        h = np.maximum(u, 0)
        out = h @ p["w2"] + p["b2"]
        prob = np.exp(out - out.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), y] -= 1
        d = prob / n
        g = {"w2": h.T @ d, "b2": d.sum(0)}
        dh = (d @ p["w2"].T) * (u > 0)
        g["w1"], g["b1"] = a.T @ dh, dh.sum(0)
        da = (dh @ p["w1"].T) * (top > 0)
        g["b"] = da.sum(0)
        picked = cols[np.arange(n)[:, None], where]  # windows, filters, width * embedding
        g["w"] = np.einsum("nf,nfd->df", da, picked) * self.mask
        dcol = (da[:, :, None] * p["w"].T[None]).reshape(n, -1, self.k, self.e)
        places = where[:, :, None] * self.stride + np.arange(self.k)
        bytes_ = x[np.arange(n)[:, None, None], places]
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], bytes_.reshape(-1), dcol.reshape(-1, self.e))
        g["emb"][0] = 0
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 11) -> "ByteNet":
        """Adam on the cross-entropy of windows ``x`` [n, length] with classes ``y``; the same result each time."""
        r, p = np.random.default_rng(seed), self.p
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v2 = {k: np.zeros_like(v) for k, v in p.items()}
        step, total = 0, max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                step += 1
                lr = rate * (1 - step / (total + 1)) + 1e-5
                for key, grad in self.gradients(x[rows], y[rows]).items():
                    m[key] += 0.1 * (grad - m[key])
                    v2[key] += 0.01 * (grad * grad - v2[key])
                    p[key] -= (lr * (m[key] / (1 - 0.9**step)) / (np.sqrt(v2[key] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def window_starts(length: int, size: int, stride: int) -> int:
    """How many windows cover ``length`` bytes."""
    return 1 if length <= size else -(-(length - size) // stride) + 1


def windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, stride: int):
    """(row, start, end) of the windows that cover each text; an empty text has one empty window."""
    n = np.where(ends - starts <= size, 1, -(-(ends - starts - size) // stride) + 1)
    row = np.repeat(np.arange(len(starts)), n)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = starts[row] + turn * stride
    return row, first, np.minimum(first + size, ends[row])


def gather(raw: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """The windows' bytes as a matrix; 0 after their end."""
    if not len(raw):
        return np.zeros((len(first), size), np.uint8)
    at = first[:, None] + np.arange(size)
    inside = at < last[:, None]
    return np.where(inside, raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint8)


def mean_logits(net: ByteNet, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, stride: int, block: int = 128) -> np.ndarray:
    """Each text's mean logits over windows that cover it whole, weighted by their bytes."""
    row, first, last = windows(raw, starts, ends, size, stride)
    classes = len(net.p["b2"])
    total, weight = np.zeros((len(starts), classes)), np.zeros(len(starts))
    for at in range(0, len(row), block):
        s = slice(at, at + block)
        out, w = net.logits(gather(raw, first[s], last[s], size)), np.maximum(last[s] - first[s], 1)
        np.add.at(total, row[s], out * w[:, None])
        np.add.at(weight, row[s], w)
    return total / np.maximum(weight, 1)[:, None]


def spread_windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, stride: int, most: int):
    """At most ``most`` windows of each text, spread evenly over the whole of it: (row, bytes)."""
    row, first, last = windows(raw, starts, ends, size, stride)
    n = np.bincount(row, minlength=len(starts))[row]
    turn = np.arange(len(row)) - np.searchsorted(row, row)
    take = (n <= most) | ((turn * most) // n != ((turn - 1) * most) // n)
    return row[take], gather(raw, first[take], last[take], size)
