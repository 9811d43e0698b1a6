import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import ensemble as E
from tickloom.operators import ledger as L
from tickloom.operators import mlprep as M
from tickloom.operators import screen as C
from tickloom.operators.quantile import exact_quantiles
from tickloom.operators.series import Lane, index_rows

TINY = Lane(keys=(), block=4)


def ledger(spark, pnl, **extra):
    p = pd.DataFrame({"trade_id": range(len(pnl)), "pnl": [float(x) for x in pnl]})
    p["entry_ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(p["trade_id"] // 2, unit="h")  # pairs share a time
    p["exit_ts"] = p["entry_ts"] + pd.Timedelta(minutes=20)
    p["side"], p["r"], p["size_usd"] = "long", p["pnl"] / 10, 100.0
    for k, v in extra.items():
        p[k] = v
    return spark.createDataFrame(p)


def slow_streaks(pnl, resets):
    win = loss = best_w = best_l = 0
    for x in pnl:
        if x > 0:
            win, loss = win + 1, 0
        elif x < 0 or not resets:
            win, loss = 0, loss + 1
        else:
            win = loss = 0
        best_w, best_l = max(best_w, win), max(best_l, loss)
    return best_w, best_l


@pytest.mark.parametrize("pnl", [[1, 2, 0, 3, -1, -2, -3, 0, -1, 4, 5, 6, 7, 0], [1, 1, 1, 1, 1, 1], [-1] * 7, [0, 0, 0]])
@pytest.mark.parametrize("resets", [False, True])
def test_streaks(spark, pnl, resets):
    r = L.longest_streaks(L.ordered(ledger(spark, pnl)), resets, TINY).first()
    assert (r["max_win_streak"], r["max_loss_streak"]) == slow_streaks(pnl, resets)


def test_equity_and_drawdown_over_blocks(spark):
    pnl = list(np.random.default_rng(4).integers(-50, 55, 37))
    got = L.equity_curve(L.ordered(ledger(spark, pnl)), 1000.0, lane=TINY).orderBy("trade_id").toPandas()
    eq = 1000.0 + np.cumsum(pnl)
    np.testing.assert_allclose(got["equity"], eq)
    np.testing.assert_allclose(got["drawdown"], eq - np.maximum.accumulate(eq))
    np.testing.assert_allclose(got["ret_on_equity"], np.array(pnl) / np.concatenate([[1000.0], eq[:-1]]))


def test_undefined_ratios_are_null(spark):
    k = L.kpis(ledger(spark, [1, 2, 3])).first()
    assert k["profit_factor"] is None and k["win_rate"] == 1.0
    assert L.kpis(ledger(spark, [-1, -2])).first()["profit_factor"] == 0.0 or L.kpis(ledger(spark, [-1, -2])).first()["profit_factor"] is None


def test_ledger_names_and_defaults(spark):
    raw = spark.createDataFrame([("t1", "2024-01-01 00:00:00", 5.0, 2.0)], "trade_id string, entry_time string, pnl double, r_mult double")
    r = L.normalise(raw).first()
    assert (r["r"], r["tier"], r["leg"], r["result"], r["gate_reasons"], r["exit_ts"]) == (2.0, "unranked", "core", "win", [], None)


def test_stress_order_of_steps(spark):
    df = ledger(spark, [100, -100], qty=2.0, entry_price=10.0, stop_price=9.0)
    got = {(r["scenario"], r["trade_id"]): r["adj_pnl"] for r in L.stressed(df).collect()}
    assert got[("baseline", 0)] == 100.0
    base = 100 * 0.65 - 100 * (21 / 1e4) * 0.65
    assert got[("hard_regime", 0)] == pytest.approx((base - 2 * 2 * 0.2) * 0.85)
    low = -100 * 0.65 - 100 * (21 / 1e4) * 0.65
    assert got[("hard_regime", 1)] == pytest.approx((low - 0.4) * 1.35)


def test_stress_report_against_a_loop(spark):
    pnl = list(np.random.default_rng(9).normal(20, 300, 120).round(2))
    rows = L.stress_report(ledger(spark, pnl, qty=1.0, entry_price=10.0, stop_price=9.0), 5000.0).collect()
    r = next(x for x in rows if x["scenario"] == "baseline")
    eq = 5000 + np.concatenate([[0], np.cumsum(pnl)])
    ret = np.array(pnl) / np.maximum(eq[:-1], 1e-9)
    var = np.quantile(ret, 0.05)
    peak = np.maximum.accumulate(eq)
    assert r["var95"] == pytest.approx(var) and r["cvar95"] == pytest.approx(ret[ret <= var].mean())
    assert r["max_drawdown_pct"] == pytest.approx(((peak - eq) / peak).max())
    assert r["delta_total_pnl"] == 0.0


def slow_spacing(bars, hours, per_hour, gap):
    last, used, out = None, {}, []
    for b, h in zip(bars, hours):
        ok = (last is None or b - last >= gap) and used.get(h, 0) < per_hour
        if ok:
            last, used[h] = b, used.get(h, 0) + 1
        out.append(int(ok))
    return out


@pytest.mark.parametrize("per_hour,gap,share", [(2, 2, 1.0), (1, 7, 0.6), (3, 1, 0.4), (2, 5, 0.9)])
def test_spaced_signals_match_the_greedy_loop(spark, per_hour, gap, share):
    rng = np.random.default_rng(8)
    parts = []
    for a, n in (("A", 300), ("B", 70)):
        t = pd.date_range("2024-01-01", periods=n, freq="15min")
        parts.append(pd.DataFrame({"asset": a, "bar_index": np.arange(n), "bar_close": t, "candidate": (rng.random(n) < share).astype(int)}))
    p = pd.concat(parts)
    got = C.spaced_signals(spark.createDataFrame(p), per_hour, gap).toPandas().sort_values(["asset", "bar_index"])
    for a, g in got.groupby("asset"):
        c = g[g["candidate"] == 1]
        assert c["accepted"].tolist() == slow_spacing(c["bar_index"], c["bar_close"].dt.floor("h"), per_hour, gap)
        assert (g["accepted"][g["candidate"] == 0] == 0).all()


def test_gates_note_missing_inputs(spark):
    row = spark.createDataFrame([("long", None, 0.5)], "side string, toxicity_12h double, p_flow_1h double").withColumn(
        "p_trend_up", F.lit(0.6)).withColumn("p_trend_down", F.lit(0.4))
    strict, loose = C.gates(row).first(), C.gates(row, p=C.Policy(strict=False)).first()
    assert (strict["gate_ocean"], strict["gate_waves"], strict["gate_flow"]) == (0, 0, 0)
    assert strict["gate_reasons"][:3] == ["ocean_tox_missing", "waves_missing", "flow_missing"]
    assert (loose["gate_ocean"], loose["gate_waves"], loose["gate_flow"]) == (1, 1, 0)  # the flow score is below its floor
    assert "flow_ml_low" in loose["gate_reasons"]


def test_metrics_with_tied_scores(spark):
    rng = np.random.default_rng(2)
    y, p = rng.integers(0, 2, 400), rng.integers(0, 12, 400) / 12
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    m = M.binary_metrics(df, "y", "p").first()
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert m["auc"] == pytest.approx(auc) and m["auc"] == pytest.approx(M.area_under_roc(df, "y", "p"), abs=1e-9)
    ap, seen_tp = 0.0, 0
    for s in sorted(set(p), reverse=True):
        tp = (y[p >= s] == 1).sum()
        ap += (tp - seen_tp) / y.sum() * tp / (p >= s).sum()
        seen_tp = tp
    assert m["ap"] == pytest.approx(ap)


def test_folds_are_purged_and_ordered(spark):
    df = index_rows(spark.range(500).toDF("id"), (), ("id",))
    f = M.purged_folds(df, 4, 2, 12).toPandas()
    for _, g in f.groupby("fold"):
        train, valid = g[g["role"] == "train"]["row_idx"], g[g["role"] == "valid"]["row_idx"]
        assert valid.min() - train.max() == 13 and train.min() == 0 and len(valid) == 100
    assert M.purged_folds(index_rows(spark.range(20).toDF("id"), (), ("id",)), 4).count() == 0


def test_disagreement_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(r, m, o, float(rng.random())) for r in range(6) for m in "abcd" for o in ("x", "y") if rng.random() < 0.85]
    got = {r["row_id"]: r for r in E.disagreement(spark.createDataFrame(rows, "row_id int, model string, output string, p double")).collect()}
    p = pd.DataFrame(rows, columns=["row_id", "model", "output", "p"])
    for k, g in p.groupby("row_id"):
        pairs = np.concatenate([np.abs(v.to_numpy()[:, None] - v.to_numpy()[None, :]).ravel() for _, v in g.groupby("output")["p"]])
        assert got[k]["pairwise"] == pytest.approx(pairs.mean()) and got[k]["spread"] == pytest.approx(np.var(g["p"]))


def test_no_task_gathers_a_scenario(spark):
    """Rows of a key that outgrow a broadcast are not shuffled by the key to meet its one row."""
    t = pd.date_range("2024-01-01", periods=3000, freq="h")
    df = spark.createDataFrame(pd.DataFrame({"entry_ts": t, "trade_id": range(3000), "pnl": [(k * 37 % 101) - 50.0 for k in range(3000)], "size_usd": 1000.0, "qty": 1.0,
                                             "entry_price": 10.0, "stop_price": 9.0}))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        report = L.stress_report(df, 1e6)
        values = spark.range(6000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 6007).cast("double").alias("x"))
        quantiles = exact_quantiles(values, "x", (0.05,), ("k",))
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (report, quantiles)]
        assert report.count() == 6 and quantiles.count() == 3
    finally:
        spark.conf.set(key, before)
    assert not re.search(r"SortMergeJoin \[(scenario|k)#\d+L?\], ", "".join(plans))
