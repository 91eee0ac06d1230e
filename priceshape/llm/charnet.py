"""A small character convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters of a window, of which CONTEXT stand on either side of the candidate's part.
WINDOW, CONTEXT = 96, 20
#: 0 pads; 1 to 95 are printable ASCII, 96 white space, 97 other letters, 98 other signs.
SYMBOLS, EMBED, FILTERS, SPAN = 99, 8, 24, 5


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(code < 0xC0, 98, 97)
    out = np.where((code > 31) & (code < 127), code - 31, out)
    return np.where(np.isin(code, [9, 10, 11, 12, 13, 32]), 96, out).astype(np.uint8)


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Windows over a candidate and its context: one, or several overlapping ones if it is long."""
    inner = WINDOW - 2 * CONTEXT
    firsts = list(range(start, max(start + 1, end - inner // 2), inner // 2)) if end - start > inner else [start]
    out = np.zeros((len(firsts), WINDOW), np.uint8)
    for row, first in enumerate(firsts):
        low, high = max(0, first - CONTEXT), min(len(text), min(end, first + inner) + CONTEXT)
        part = symbols(text[low:high])
        at = CONTEXT - (first - low)
        out[row, at:at + len(part)] = part
    return out


@dataclass
class Net:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    recall: float = 0.0

    def vector(self) -> np.ndarray:
        """The fitted weights in a row."""
        return np.concatenate([self.embed.ravel(), self.filters.ravel(), self.bias, self.out, [self.out_bias]])

    @classmethod
    def of(cls, vector: np.ndarray) -> Net:
        """A network of its own with these weights."""
        shapes = ((SYMBOLS, EMBED), (SPAN * EMBED, FILTERS), (FILTERS,), (FILTERS,))
        parts = np.split(vector, np.cumsum([np.prod(s) for s in shapes]))
        return cls(*(p.reshape(s).copy() for p, s in zip(parts, shapes, strict=False)), float(parts[-1][0]))

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def _forward(self, x: np.ndarray):
        e = self.embed[x]
        col = np.lib.stride_tricks.sliding_window_view(e, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, SPAN * EMBED)
        z = np.maximum(0, col @ self.filters + self.bias)
        top = z.argmax(axis=1)
        h = np.take_along_axis(z, top[:, None, :], 1)[:, 0, :]
        return h @ self.out + self.out_bias, h, top, col

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of each window."""
        return self.calibrated(self.margins(x))

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, recall: float = 0.98, rounds: int = 6, folds: int = 3, seed: int = 6) -> Net:
    """Fit on all windows; calibrate and set the threshold by cross-validation.

    Every window is scored by a network that was fitted without its fold. Calibration is logistic
    (Platt) on these margins; the threshold is the highest calibrated probability that keeps ``recall``
    of the held-out positives, whatever it is. ``net.recall`` is the share it keeps.
    """
    order = np.random.default_rng(seed).permutation(len(x))
    margin = np.zeros(len(x))
    for k in range(folds):
        held = order[k::folds]
        rest = np.setdiff1d(order, held)
        margin[held] = _fit(x[rest], y[rest], rounds, seed + k).margins(x[held])
    net = _fit(x, y, rounds, seed)
    calibrate(net, margin, y, np.ones(len(margin)))
    found = np.sort(net.calibrated(margin[y == 1]))
    if len(found):
        net.threshold = float(found[int((1 - recall) * len(found))])
        net.recall = float((found >= net.threshold).mean())
    return net


def calibrate(net: Net, margin: np.ndarray, y: np.ndarray, count: np.ndarray) -> None:
    """Logistic calibration (Platt) on margins that stand for ``count`` windows each."""
    share = count / max(count.sum(), 1)
    for _ in range(300):
        d = (net.calibrated(margin) - y) * share
        net.slope -= 0.2 * float((d * margin).sum())
        net.shift -= 0.2 * float(d.sum())


#: Steps a network takes at least, however few its windows.
STEPS = 150


def begin(seed: int) -> tuple[Net, np.random.Generator]:
    """The network that a fit of this seed starts from."""
    rng = np.random.default_rng(seed)
    return Net(rng.normal(0, 0.3, (SYMBOLS, EMBED)), rng.normal(0, 0.2, (SPAN * EMBED, FILTERS)), np.zeros(FILTERS),
               rng.normal(0, 0.2, FILTERS), 0.0), rng


def _fit(x: np.ndarray, y: np.ndarray, rounds: int, seed: int, start: Net | None = None) -> Net:
    """A network after ``rounds`` passes over the windows, more where they are few; with ``start``, that
    one after just these passes."""
    net, rng = begin(seed) if start is None else (start, np.random.default_rng(seed))
    fit = np.arange(len(x))
    if start is None:
        rounds = max(rounds, -(-STEPS // max(1, len(x) // 64)))
    names = ("embed", "filters", "bias", "out")
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names}
    step = 0
    for _ in range(rounds):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            if not len(at):
                continue
            step += 1
            margin, h, top, col = net._forward(x[at])
            d = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[at]) / len(at)
            dh = d[:, None] * net.out * (h > 0)
            best = np.take_along_axis(col, top[:, :, None], 1)  # window x filter x inputs
            grads = {"out": h.T @ d, "bias": dh.sum(0), "filters": np.einsum("nfi,nf->if", best, dh)}
            back = (dh[:, :, None] * net.filters.T).reshape(len(at), FILTERS, SPAN, EMBED)
            grads["embed"] = np.zeros_like(net.embed)
            place = top[:, :, None] + np.arange(SPAN)
            np.add.at(grads["embed"], x[at][np.arange(len(at))[:, None, None], place], back)
            net.out_bias -= 0.05 * d.sum()
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                getattr(net, k)[...] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net
