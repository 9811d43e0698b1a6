"""Quantiles of the whole history at chosen rows, and the absorption band after a silent stretch."""

import numpy as np
import pandas as pd
import pytest
from helpers import to_bars, walk
from pyspark.sql import functions as F

from tickloom.operators import features, quantile
from tickloom.operators.series import BARS


@pytest.mark.parametrize("run", [7, 4096])
def test_quantiles_so_far_equal_an_expanding_quantile(spark, monkeypatch, run):
    monkeypatch.setattr(quantile, "RUN", run)
    rng = np.random.default_rng(1)
    pdf = walk(n=200)
    pdf["x"] = np.where(rng.random(len(pdf)) < 0.3, np.nan, rng.integers(0, 40, len(pdf)).astype(float))  # ties and gaps
    bars = to_bars(spark, pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = quantile.quantiles_so_far(bars, F.col("row_idx") % 3 == 0, "x", (0.05, 0.5, 0.95), BARS).toPandas()
    want = {}
    for asset, part in pdf.groupby("asset"):
        part = part.sort_values("bar_close").reset_index(drop=True)
        for i in range(0, len(part), 3):
            if not np.isnan(part["x"][i]):
                seen = part["x"][: i + 1].dropna()
                want[asset, i] = (len(seen), *np.quantile(seen, (0.05, 0.5, 0.95)))
    assert len(got) == len(want)
    for r in got.itertuples():
        assert (r.seen, r.q_0, r.q_1, r.q_2) == pytest.approx(want[r.asset, r.row_idx])
    assert quantile.quantiles_so_far(bars, F.lit(False), "x", (0.5,), BARS).count() == 0


def test_absorption_after_a_silent_stretch_uses_all_history(spark):
    pdf = walk(assets=("A", "B"), n=220, seed=8)
    pdf["dollar_volume"] = pdf["close"] * (pdf["volume"] + 1)
    silent = pdf.groupby("asset").cumcount().between(150, 330)  # more than 128 bars without turnover
    pdf.loc[silent, "dollar_volume"] = 0.0
    got = features.absorption(to_bars(spark, pdf)).toPandas().sort_values(["asset", "bar_close"])
    for asset, part in pdf.groupby("asset"):
        d = part.sort_values("bar_close").reset_index(drop=True)
        progress = (d["close"] - d["open"]).abs().rolling(4).sum() / d["dollar_volume"].rolling(4).sum().replace(0, np.nan)
        progress[d["dollar_volume"].rolling(4).sum().abs() < 1e-6] = np.nan
        cluster = (d["dollar_volume"] / (d["high"] - d["low"]).replace(0, 1e-9)).rolling(4).median()

        def band(x, q):
            return x.rolling(128, min_periods=32).quantile(q).fillna(x.expanding(min_periods=4).quantile(q))

        p0, p1, c0, c1 = band(progress, 0.05), band(progress, 0.95), band(cluster, 0.05), band(cluster, 0.95)
        slow = 1 - ((progress - p0) / (p1.replace(0, 1e-9) - p0 + 1e-12)).clip(0, 1)
        dense = ((cluster - c0.fillna(0)) / (c1.replace(0, 1e-9) - c0.fillna(0) + 1e-12)).clip(0, 1)
        want = (0.6 * slow + 0.4 * dense).clip(0, 1).fillna(0.0)
        np.testing.assert_allclose(got[got["asset"] == asset]["absorption_score"].to_numpy(float), want.to_numpy(), atol=1e-6)
