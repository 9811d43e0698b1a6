import numpy as np
import pandas as pd
import pytest

from helpers import back, same, to_bars, walk
from tickloom.operators import labels as L
from tickloom.operators import features as X
from tickloom.operators import structure as ST
from tickloom.operators import series as S

LANES = [S.BARS, S.Lane(block=9)]


@pytest.fixture(scope="module")
def pdf():
    return walk(n=90, step=1.2).sort_values(["asset", "bar_close"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def bars(spark, pdf):
    return to_bars(spark, pdf).cache()


def series(pdf):
    return [g.reset_index(drop=True) for _, g in pdf.groupby("asset")]


def slow_swings(g, left, right):
    out = []
    for i in range(len(g)):
        if i < left or i + right >= len(g):
            out.append((None, None))
            continue
        around = list(range(i - left, i)) + list(range(i + 1, i + right + 1))
        hi, lo = g["high"], g["low"]
        out.append((hi[i] if all(hi[j] < hi[i] for j in around) else None, lo[i] if all(lo[j] > lo[i] for j in around) else None))
    return out


@pytest.mark.parametrize("lane", LANES)
@pytest.mark.parametrize("arms", [(2, 2), (3, 4)])
def test_pivots(bars, pdf, lane, arms):
    got = back(ST.swings(bars, *arms, lane=lane))
    want = [x for g in series(pdf) for x in slow_swings(g, *arms)]
    same(got["swing_high"], [np.nan if a is None else a for a, _ in want])
    same(got["swing_low"], [np.nan if b is None else b for _, b in want])


@pytest.mark.parametrize("lane", LANES)
def test_block_equals_the_single_steps(bars, lane):
    one = back(ST.structure_block(bars, 2, 2, lane=lane))
    two = back(ST.sweeps(ST.structure_breaks(ST.swings(bars, 2, 2, lane), lane=lane), lane=lane))
    for c in ("bos_up", "bos_down", "choch_up", "choch_down", "sweep_high", "sweep_low", "sweep_dir", "bias"):
        assert one[c].tolist() == two[c].tolist()
    same(one["broken_level"], two["broken_level"])


def slow_gaps(g, start):
    gaps, out = [], []
    for i in range(len(g)):
        hi, lo, c = g["high"][i], g["low"][i], g["close"][i]
        if i >= 2:
            h2, l2 = g["high"][i - 2], g["low"][i - 2]
            if l2 > hi and (l2 - hi) / c >= 0.0005:
                gaps.append({"dir": 1, "top": l2, "bottom": hi, "born": i, "open": True})
            if h2 < lo and (lo - h2) / c >= 0.0005:
                gaps.append({"dir": -1, "top": lo, "bottom": h2, "born": i, "open": True})
        touched = broken = 0
        for x in gaps:
            if not x["open"] or i < x["born"] + start:
                continue
            t = lo <= x["top"] + 1e-9 and hi >= x["bottom"] - 1e-9
            b = c < x["bottom"] - 1e-9 if x["dir"] == 1 else c > x["top"] + 1e-9
            touched |= int(t)
            broken |= int(b and not t)
            x["open"] = not (t or b)
        alive = [x for x in gaps if x["open"]]
        age = min((i - x["born"] + 1 - start for x in alive), default=np.nan)
        out.append((touched, broken, sum(x["dir"] == 1 for x in alive), sum(x["dir"] == -1 for x in alive), age))
    return out


@pytest.mark.parametrize("lane", LANES)
@pytest.mark.parametrize("birth_bar", [False, True])
def test_gap_life_cycle(bars, pdf, lane, birth_bar):
    got = back(ST.gaps(bars, birth_bar, lane=lane))
    want = [x for g in series(pdf) for x in slow_gaps(g, 0 if birth_bar else 1)]
    cols = ("fvg_touch_flag", "fvg_is_broken", "fvg_open_up", "fvg_open_down", "fvg_age")
    for k, c in enumerate(cols):
        same(got[c], [w[k] for w in want])
    assert got["fvg_touch_flag"].sum() > 0


def test_a_gap_left_open_for_long_is_found_across_blocks(spark):
    n = 60
    close = np.array([100.0, 100.0, 90.0] + [110.0] * (n - 4) + [95.0])
    p = walk(("A",), 20).iloc[:n].copy()
    for c in ("open", "close"):
        p[c] = close
    p["high"], p["low"] = close + 1, close - 1
    got = back(ST.gaps(to_bars(spark, p), lane=S.Lane(block=9)))
    want = slow_gaps(p.reset_index(drop=True), 1)
    same(got["fvg_open_up"], [w[2] for w in want])
    same(got["fvg_age"], [w[4] for w in want])
    assert got["fvg_open_up"].iloc[40] == 1


def slow_zones(g, max_age):
    blocks, out = {"demand": [], "supply": []}, []
    for i in range(len(g)):
        if i >= 2:
            o, c, h, lo = (g[k][i] for k in ("open", "close", "high", "low"))
            po, pc = g["open"][i - 1], g["close"][i - 1]
            q = max(1e-9, abs(c - o) / max(h - lo, 1e-9)) * 0.7 + (1 - abs(pc - o) / max(1e-9, o)) * 0.3
            new = {"top": g["high"][i - 1], "bottom": g["low"][i - 1], "age": 0, "q": q, "touched": 0}
            if pc < po and c > o and abs(c - o) / c >= 0.002 and (c - o) / c >= 0.003:
                blocks["demand"].append(dict(new))
            if pc > po and c < o and abs(c - o) / c >= 0.002 and (po - c) / c >= 0.003:
                blocks["supply"].append(dict(new))
            for side, price in (("demand", lo), ("supply", h)):
                for b in blocks[side]:
                    b["age"] += 1
                    b["touched"] |= int(b["bottom"] <= price <= b["top"])
        row = []
        for side in ("demand", "supply"):
            live = [b for b in blocks[side] if b["age"] < max_age]
            best = max(live, key=lambda b: b["q"]) if live else None
            row += [best["top"], best["age"], best["touched"]] if best else [np.nan] * 3
        out.append(row)
    return out


@pytest.mark.parametrize("lane", LANES)
@pytest.mark.parametrize("max_age", [300, 12])
def test_best_zone(bars, pdf, lane, max_age):
    got = back(ST.zones(bars, max_age, lane=lane))
    want = [x for g in series(pdf) for x in slow_zones(g, max_age)]
    for k, c in enumerate(("demand_top", "demand_age", "demand_touched", "supply_top", "supply_age", "supply_touched")):
        same(got[c], [w[k] for w in want])


def slow_touch(g, i, up, stop, target, first, last, veto=None):
    for j in range(i + first, min(i + last, len(g) - 1) + 1):
        if veto is not None and veto[j]:
            return 0
        if (g["low"][j] <= stop) if up else (g["high"][j] >= stop):
            return 0
        if (g["high"][j] >= target) if up else (g["low"][j] <= target):
            return 1
    return 0


@pytest.mark.parametrize("lane", LANES)
def test_barrier_labels(bars, lane):
    base = S.pin(ST.structure_block(X.atr(bars, 5, lane), 2, 2, lane=lane))
    got = back(L.survival(L.break_continuation(L.danger(base, 10, 1.0, lane=lane), 12, 1.0, lane=lane), 12, lane=lane))
    seen = 0
    for _, g in got.groupby("asset"):
        g = g.reset_index(drop=True)
        against = {1: g["choch_down"] == 1, -1: g["choch_up"] == 1}
        for i in range(len(g)):
            atr, c = g["atr"][i], g["close"][i]
            ok = not np.isnan(atr) and atr > 0
            side = 1 if g["bos_up"][i] else -1 if g["bos_down"][i] else 0
            want = 0
            if ok and side:
                stop = g["broken_level"][i] - side * 0.30 * atr
                want = slow_touch(g, i, side > 0, stop, c + side * atr, 1, 12, against[side])
            assert g["label_bos_cont"][i] == want
            seen += want
            later = g["low"][i + 1: i + 11]
            assert g["label_edp"][i] == int(ok and len(later) > 0 and later.min() <= c - atr)
            d = int(np.sign(g["sweep_dir"][i])) or side or {"UP": 1, "DOWN": -1}.get(g["bias"][i], 0) or 1
            t, e = 12, 0
            if ok:
                for j in range(1, min(12, len(g) - 1 - i) + 1):
                    hit = g["low"][i + j] <= c - atr if d > 0 else g["high"][i + j] >= c + atr
                    if hit or against[d][i + j]:
                        t, e = j, 1
                        break
            assert (g["hazard_event"][i], g["hazard_time"][i]) == (e, t)
    assert seen > 0


def test_stop_wins_inside_one_bar(spark):
    p = walk(("A",), 2)
    p["high"], p["low"], p["open"], p["close"] = 101.0, 99.0, 100.0, 100.0
    p.loc[3, ["high", "low"]] = [110.0, 90.0]
    d = to_bars(spark, p).selectExpr("*", "2.0D AS atr", "CASE WHEN row_idx = 2 THEN 1 ELSE 0 END AS sweep_low", "0 AS sweep_high",
                                     "98.0D AS swept_level", "1.0D AS displacement_hint")
    assert back(L.liquidity_flow(d))["label_liq_flow"].sum() == 0
    calm = d.selectExpr("* EXCEPT (low)", "CASE WHEN row_idx = 3 THEN 99.0D ELSE low END AS low")
    assert back(L.liquidity_flow(calm))["label_liq_flow"].tolist()[2] == 1
