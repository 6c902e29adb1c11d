"""The measures on numpy arrays, for use inside one repetition."""

from __future__ import annotations

import numpy as np


def weighted_auroc(y: np.ndarray, p: np.ndarray, w: np.ndarray) -> float:
    values, at = np.unique(p, return_inverse=True)
    pos = np.bincount(at, weights=w * (y == 1), minlength=len(values))
    neg = np.bincount(at, weights=w * (y != 1), minlength=len(values))
    total = pos.sum() * neg.sum()
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / total) if total > 0 else float("nan")


def measures(y: np.ndarray, p: np.ndarray, w: np.ndarray) -> dict[str, float]:
    if len(np.unique(y)) != 2:
        return {}
    s = w.sum()
    return {
        "AUROC": weighted_auroc(y, p, w),
        "Brier score": float(w @ (y - p) ** 2 / s),
        "Global calibration mean prediction": float(w @ p / s),
        "Global calibration observed risk": float(w @ y / s),
    }


def divergence(w: np.ndarray, mult: np.ndarray) -> dict[str, float]:
    """Of weights for each row that ``mult`` stands for."""
    n, s = mult.sum(), w @ mult
    p = w / s
    some = p > 0
    return {"Max weight": float(w.max()), "chi2 to uniform": float(n * (mult @ p**2) - 1), "kl": float(np.log(n) + (mult[some] * p[some]) @ np.log(p[some]))}


def smd_score(size: int, m0: float, s0: float | None, m1: float, s1: float, low: float, high: float, middle: bool) -> float:
    """Standardised difference of a set of one or two columns: external and internal mean (and mean square), extremes, and whether
    a value lies between them."""
    with np.errstate(invalid="ignore", divide="ignore"):
        if size == 2:
            return abs(m1 - m0) / np.sqrt((s0 - m0**2) + (s1 - m1**2))
        if size != 1:
            return np.nan
        if low < high and not middle:
            if not low <= m0 <= high:
                return np.inf
            p0, p1 = (m0 - low) / (high - low), (m1 - low) / (high - low)
            return abs(m1 - m0) / np.sqrt((p0 * (1 - p0) + p1 * (1 - p1)) * (high - low))
        return abs(m1 - m0) / np.sqrt(2 * (s1 - m1)) if s1 > m1 else abs(m1 - m0) / np.sqrt(0.001) if s1 == m1 else np.nan


def max_smd(z: dict[str, np.ndarray], mu: dict[str, float], sets: list[tuple[str, ...]], w: np.ndarray) -> float:
    scores = []
    p = w / w.sum()
    for s in sets:
        x = z[s[0]]
        low, high = x.min(), x.max()
        second = (mu[s[1]], float(p @ z[s[1]])) if len(s) == 2 else (None, float(p @ x**2))
        scores.append(smd_score(len(s), mu[s[0]], second[0], float(p @ x), second[1], low, high, bool(((x > low) & (x < high)).any())))
    scores = [x for x in scores if not np.isnan(x)]
    return float(max(scores)) if scores else float("nan")
