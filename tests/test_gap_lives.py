"""Births and deaths of gaps across blocks: thousands that never fill, nested ones, and the tree of block extremes."""

import numpy as np
import pandas as pd
import pytest
from helpers import same
from test_structure import slow_gaps

from tickloom.operators import series as S
from tickloom.operators import structure as ST
from tickloom.operators.touch import first_cross


def frame(spark, low, high, close):
    n = len(low)
    pdf = pd.DataFrame({"asset": "A", "tf": "1h", "row_idx": np.arange(n), "low": low, "high": high, "close": close, "open": close})
    return pdf, spark.createDataFrame(pdf)


def compared(spark, low, high, close, block, birth_bar=False):
    pdf, bars = frame(spark, low, high, close)
    got = ST.gaps(bars, birth_bar, lane=S.Lane(block=block)).toPandas().sort_values("row_idx")
    want = slow_gaps(pdf, 0 if birth_bar else 1)
    for k, c in enumerate(("fvg_touch_flag", "fvg_is_broken", "fvg_open_up", "fvg_open_down", "fvg_age")):
        same(got[c].reset_index(drop=True), [w[k] for w in want])
    return got


def saw(steps):
    """Two bars, a dip that leaves a gap above, and on to a level that the later dips stay above."""
    return (100.0 * 1.01 ** np.arange(steps)[:, None] * [1, 1, 0.995]).ravel()


def test_thousands_of_gaps_that_never_fill(spark):
    low = saw(2000)
    got = ST.gaps(frame(spark, low, low * 1.0002, low * 1.0001)[1], lane=S.Lane(block=64)).toPandas().sort_values("row_idx")
    assert got["fvg_open_up"].tolist() == [(i + 1) // 3 for i in range(6000)]
    assert got["fvg_age"].iloc[2:].max() <= 2


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_nested_gaps_end_in_reverse(spark, block):
    """A rise that leaves gaps, then a fall that fills them newest first: the newest open gap goes back step by step."""
    up = saw(40)
    low = np.concatenate([up, np.repeat(up[::-3], 3)[:100], up[60:]])
    got = compared(spark, low, low * 1.0008, low * 1.0004, block)
    assert got["fvg_age"].max() > 60


@pytest.mark.parametrize("birth_bar", [False, True])
@pytest.mark.parametrize("block", [3, 8])
def test_random_lives(spark, block, birth_bar):
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
    compared(spark, close * (1 - rng.random(300) * 0.004), close * (1 + rng.random(300) * 0.004), close, block, birth_bar)


@pytest.mark.parametrize(("block", "fan"), [(2, 2), (3, 4), (5, 64), (500, 2)])
@pytest.mark.parametrize("start", [0, 1])
def test_first_cross_equals_a_plain_search(spark, block, fan, start):
    rng = np.random.default_rng(block)
    n = 200
    mid = 100 + np.cumsum(rng.normal(0, 1, n))
    low, high = mid - rng.random(n), mid + rng.random(n)
    low[::17], high[5::23] = np.nan, np.nan
    rows = spark.createDataFrame([("A", "1h", i, None if np.isnan(a) else float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(low, high))],
                                 "asset string, tf string, row_idx long, low double, high double")
    sought = [("A", "1h", int(rng.integers(n)), k, bool(k % 2), float(rng.choice(mid)) if k % 10 else None) for k in range(150)] + [("B", "1h", 3, 999, True, 1e9)]
    events = spark.createDataFrame(sought, "asset string, tf string, row_idx long, k long, falls boolean, level double")
    got = {r.k: r.hit and r.hit.i for r in first_cross(rows, events, start, lane=S.Lane(block=block), fan=fan).collect()}
    want = {}
    for asset, _, i, k, falls, level in sought:
        hits = [] if asset == "B" or level is None else [j for j in range(i + start, n) if (low[j] <= level if falls else high[j] >= level)]
        want[k] = hits[0] if hits else None
    assert got == want
    assert any(v is not None and v - s[2] > 50 for s, v in zip(sought, want.values()))


def test_no_rows_and_no_events(spark):
    rows = spark.createDataFrame([], "asset string, tf string, row_idx long, open double, low double, high double, close double")
    assert ST.gaps(rows).count() == 0
    flat = np.full(10, 5.0)
    assert ST.gaps(frame(spark, flat, flat, flat)[1], lane=S.Lane(block=3)).agg({"fvg_open_total": "max"}).first()[0] == 0
