"""Small deterministic sessions with known structure, drawn by md5 like everything else."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd


def draw(*parts) -> float:
    """Uniform number in (0, 1) from a digest."""
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / 16**13


def gauss(*parts) -> float:
    return math.sqrt(-2 * math.log(draw(*parts, "r"))) * math.cos(2 * math.pi * draw(*parts, "a"))


def sessions(labs=2, subjects=3, per_subject=2, n_bins=60) -> pd.DataFrame:
    rows = [(f"s{a}_{b}_{c}", f"m{a}_{b}", f"lab{a}", n_bins)
            for a in range(labs) for b in range(subjects) for c in range(per_subject)]
    return pd.DataFrame(rows, columns=["eid", "subject", "lab", "n_bins"])


def regression_rows(frame: pd.DataFrame, weight: float, noise: float = 1.0) -> pd.DataFrame:
    """y = weight * x1 + noise per bin; weight 0 is the fixture without signal."""
    rows = []
    for s in frame.itertuples():
        for b in range(s.n_bins):
            x1, x2 = gauss(s.eid, b, "x1"), gauss(s.eid, b, "x2")
            rows.append((s.eid, b, x1, x2, weight * x1 + noise * gauss(s.eid, b, "y")))
    return pd.DataFrame(rows, columns=["eid", "bin", "x1", "x2", "y"])


def slow_walk(frame: pd.DataFrame, decay: float = 0.97) -> pd.DataFrame:
    """Slow AR(1) rate and behaviour, independent of each other."""
    rows = []
    for s in frame.itertuples():
        x = y = 0.0
        for b in range(s.n_bins):
            x = decay * x + gauss(s.eid, b, "ax")
            y = decay * y + gauss(s.eid, b, "ay")
            rows.append((s.eid, b, x, y))
    return pd.DataFrame(rows, columns=["eid", "bin", "x1", "y"])


def mid_rank(values) -> np.ndarray:
    v = np.asarray(values, float)
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
