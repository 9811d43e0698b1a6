"""Small frames for the tests, with the same columns the library uses."""

from __future__ import annotations

import numpy as np
import pandas as pd

from tickloom.operators.series import index_rows


def walk(assets=("A", "B"), n=160, seed=3, tf="15m", seconds=900, start="2024-01-01", step=0.4):
    """Random-walk bars; the first asset is three times as long as the others."""
    rng = np.random.default_rng(seed)
    parts = []
    for k, a in enumerate(assets):
        m = n * 3 if k == 0 else n
        close = 100 + np.cumsum(rng.normal(0, step, m)).round(2)
        open_ = np.concatenate([[close[0]], close[:-1]]) + rng.normal(0, step / 4, m).round(2)
        high = np.maximum(open_, close) + rng.integers(0, 40, m) / 100
        low = np.minimum(open_, close) - rng.integers(0, 40, m) / 100
        t = pd.date_range(start, periods=m, freq=f"{seconds}s") + pd.Timedelta(seconds=seconds)
        parts.append(pd.DataFrame({"asset": a, "tf": tf, "bar_open": t - pd.Timedelta(seconds=seconds), "bar_close": t, "open": open_.round(2),
                                   "high": high.round(2), "low": low.round(2), "close": close, "volume": rng.integers(0, 50, m).astype(float)}))
    return pd.concat(parts, ignore_index=True)


def to_bars(spark, pdf):
    return index_rows(spark.createDataFrame(pdf), ("asset", "tf"), ("bar_close",))


def back(df, *keys):
    """Spark result as pandas, ordered by the keys."""
    keys = keys or ("asset", "bar_close")
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


def same(a, b, tol=1e-9):
    np.testing.assert_allclose(np.asarray(a, dtype=float), np.asarray(b, dtype=float), rtol=tol, atol=tol, equal_nan=True)
