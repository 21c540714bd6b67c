"""Small regressions for Arrow functions; nothing here needs a Spark session."""

from __future__ import annotations

import numpy as np
import pandas as pd


def delay_of_windows(windows: pd.Series) -> pd.Series:
    """1 - R2 on the market alone / R2 with four lags, of arrays of [y, x0 .. x4]; null with under 40 whole rows or without variance."""
    out = []
    for rows in windows:
        a = np.array([list(r) for r in rows], float).reshape(-1, 6)
        a = a[np.isfinite(a).all(axis=1)]
        if len(a) < 40 or a[:, 0].var() < 1e-16:
            out.append(None)
            continue
        y = a[:, 0] - a[:, 0].mean()
        fit = []
        for k in (2, 6):
            x = np.column_stack([np.ones(len(a)), a[:, 1:k]])
            if np.linalg.matrix_rank(x) < x.shape[1]:
                break
            rest = a[:, 0] - x @ np.linalg.lstsq(x, a[:, 0], rcond=None)[0]
            fit.append(1 - (rest @ rest) / (y @ y))
        out.append(None if len(fit) < 2 or fit[1] <= 0 else min(1.0, max(0.0, 1 - fit[0] / fit[1])))
    return pd.Series(out, dtype="float64")
