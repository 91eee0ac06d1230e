"""Plain definitions of the statistics on small arrays, for comparison only."""

import numpy as np


def describe(x, w=None, trim=0.08, bandwidth=None, grid=2048):
    x = np.asarray(x, dtype=float)
    w = np.ones_like(x) if w is None else np.asarray(w, dtype=float)
    total = w.sum()
    order = np.argsort(x, kind="stable")
    sx, sw = x[order], w[order]
    cum = np.cumsum(sw)

    def quantile(q):
        position = q * total
        i = int(np.searchsorted(cum, position, side="right"))
        if i >= len(cum):
            return sx[-1]
        before = cum[i - 1] if i else 0.0
        low = sx[i - 1] if i else sx[0]
        return low + (position - before) / sw[i] * (sx[i] - low)

    mean = (w * x).sum() / total
    moments = [(w * (x - mean) ** k).sum() / total for k in (2, 3, 4)]
    spread = x[w > 0].min() < x[w > 0].max()
    std = np.sqrt(moments[0]) if spread else 0.0
    start = np.concatenate([[0.0], cum[:-1]])
    kept = np.clip(cum, trim * total, (1 - trim) * total) - np.clip(
        start, trim * total, (1 - trim) * total)
    ess = total**2 / (w**2).sum()
    iqr = quantile(0.75) - quantile(0.25)
    scale = std if iqr <= 0 else min(std, iqr / 1.34)
    h = bandwidth or 0.9 * scale * ess**-0.2
    if h > 0:
        points = np.linspace(x.min() - 3 * h, x.max() + 3 * h, grid)
        density = (np.exp(-0.5 * ((points[:, None] - x) / h) ** 2) * (w / total)).sum(axis=1)
        density /= h * np.sqrt(2 * np.pi)
        mode = points[np.nonzero(density >= density.max() * (1 - 1e-12))[0][0]]
    else:
        points, density, mode = None, None, x[w > 0].min()
    return {
        "weighted_mean": mean,
        "weighted_median": quantile(0.5),
        "trimmed_mean": (kept * sx).sum() / kept.sum(),
        "weighted_std": std,
        "weighted_skewness": moments[1] / std**3 if spread else 0.0,
        "weighted_kurtosis": moments[2] / std**4 - 3 if spread else 0.0,
        "weighted_kde_bandwidth": h,
        "weighted_kde_mode": mode,
        "effective_sample_size": ess,
    }, points, density
