"""The label sweep against a plain loop over candidates, scores and folds."""

import numpy as np
import pytest
from helpers import to_bars, walk
from pyspark.sql import functions as F

from tickloom.operators import labels as L
from tickloom.operators import mlprep as M

CANDIDATES = [("edp", {"horizon": 12, "drop_r": 2.0}), ("edp", {"horizon": 24, "drop_r": 2.0}), ("eop", {"horizon": 3}), ("eop", {"horizon": 6}), ("eop", {"horizon": 0})]
SCORES = ["tilt", "drive"]


def plain_figures(y, p):
    order = np.argsort(-p, kind="stable")
    y, p = y[order], p[order]
    ap = auc = top = seen = hits = 0.0
    pos, neg, k = y.sum(), (1 - y).sum(), max(int(round(len(y) * 0.10)), 1)
    i = 0
    while i < len(y):
        j = i
        while j < len(y) and p[j] == p[i]:
            j += 1
        here, n = y[i:j].sum(), j - i
        hits, seen = hits + here, seen + n
        ap += here * hits / seen
        auc += (n - here) * (hits - here / 2)
        top += here * min(max((k - i) / n, 0.0), 1.0)
        i = j
    return ap / pos, auc / (pos * neg), top / k


def plain_objective(ap, auc, topk, rate):
    floor, cap = (min(rate / 0.05, 1) if rate > 0 else 0), (min((1 - rate) / 0.5, 1) if rate < 1 else 0)
    return 0.55 * ap + 0.15 * max(auc - 0.5, 0) + 0.10 * max(min(floor, cap), 0) + 0.20 * topk


def plain_means(frame, reach, rate, folds=4, embargo=2):
    n = len(frame)
    size, out = n // (folds + 1), {}
    y = frame["y"].to_numpy()
    for s in SCORES:
        got = []
        for k in range(folds):
            start = n - (folds - k) * size
            train, valid = y[: max(start - max(embargo, reach), 0)], y[start : start + size]
            if len(train) >= 50 and len(valid) >= 10 and len(set(train)) == 2 and len(set(valid)) == 2:
                got.append(plain_objective(*plain_figures(valid, frame[s].to_numpy()[start : start + size]), rate))
        half = 1.96 * np.std(got, ddof=1) / np.sqrt(len(got)) if len(got) > 1 else 0.0
        mean = np.mean(got) if got else plain_objective(0, 0.5, 0, rate)
        out[s] = (mean, half, len(got))
    return out


@pytest.fixture(scope="module")
def base(spark):
    pdf = walk(n=150)
    pdf["atr"] = 0.8
    pdf["tilt"] = ((pdf["close"] - pdf["low"]) / (pdf["high"] - pdf["low"]).replace(0, np.nan)).fillna(0.5).round(1)  # with ties
    pdf["drive"] = (pdf["close"] - pdf["open"]).round(2)
    return to_bars(spark, pdf)


REGISTRY = {**L.LABELS, "eop": lambda df, horizon: L.opportunity(df, F.col("close") > F.col("open") + 0.3, horizon) if horizon else df.withColumn("label_eop", F.lit(0))}


def test_all_labels_are_registered():
    assert set(L.LABELS) == set(L.LABEL_COLUMNS) == {"liq_flow", "bos_cont", "momo", "flow_1h", "eop", "edp", "hazard"}


def test_sweep_equals_a_plain_loop(base):
    got = {r.candidate: r for r in M.label_sweep(base, CANDIDATES, REGISTRY, L.LABEL_COLUMNS, SCORES, ("bar_close", "asset")).collect()}
    assert sorted(got) == list(range(len(CANDIDATES)))
    want = {}
    for i, (name, params) in enumerate(CANDIDATES):
        frame = REGISTRY[name](base, **params).withColumnRenamed(L.LABEL_COLUMNS[name], "y").select("bar_close", "asset", *SCORES, "y").toPandas()
        frame = frame.sort_values(["bar_close", "asset"]).reset_index(drop=True)
        rate = frame["y"].mean()
        want[i] = plain_means(frame, max(1, params["horizon"]), rate)
        r = got[i]
        assert r.rows == len(frame) and r.positive_rate == pytest.approx(rate) and r.folds == min(f for _, _, f in want[i].values())
        assert r.objective == pytest.approx(np.mean([m for m, _, _ in want[i].values()]))
        assert r.ci_low == pytest.approx(min(m - h for m, h, _ in want[i].values())) and r.ci_high == pytest.approx(max(m + h for m, h, _ in want[i].values()))
    assert got[4].folds == 0  # one class only
    for name in ("edp", "eop"):
        own = [i for i, (n, _) in enumerate(CANDIDATES) if n == name]
        for i in own:
            assert got[i].votes == sum(max(want[j][s][0] for j in own) - want[i][s][0] <= 1e-9 for s in SCORES)
        best = max(own, key=lambda i: (got[i].objective, -i))
        assert [i for i in own if got[i].recommended] == [best] and [i for i in own if got[i].is_baseline] == own[:1]
        for i in own:
            assert got[i].improvement == pytest.approx(got[i].objective - got[own[0]].objective)
            assert (got[i].reason is None) == (i != best)


def test_gate_promotes_only_what_passes_every_rule(base):
    run = lambda **k: {r.candidate: r for r in M.label_sweep(base, CANDIDATES[2:4], REGISTRY, L.LABEL_COLUMNS, SCORES, ("bar_close", "asset"), **k).collect()}
    loose = run(baseline=[0], min_improvement=-1.0, min_votes=0)
    best = next(r for r in loose.values() if r.recommended)
    expected = "recommended_is_baseline" if best.is_baseline else "passed" if best.ci_low > loose[0].ci_high else "ci_delta_not_positive"
    assert best.reason == expected and best.promoted == int(expected == "passed")
    other = 1 - best.candidate
    strict = next(r for r in run(baseline=[other], min_improvement=10.0).values() if r.recommended)
    assert (strict.candidate, strict.reason, strict.promoted) == (best.candidate, "min_improvement_not_met", 0)
    votes = next(r for r in run(baseline=[other], min_improvement=0.0, min_votes=99).values() if r.recommended)
    assert votes.reason == "consensus_not_met"


def test_jobs_do_not_depend_on_the_number_of_candidates(spark, base):
    def jobs(candidates):
        spark.sparkContext.setJobGroup(f"sweep-{len(candidates)}", "count")
        M.label_sweep(base, candidates, REGISTRY, L.LABEL_COLUMNS, SCORES, ("bar_close", "asset"))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sweep-{len(candidates)}"))

    few, many = jobs(CANDIDATES[2:3]), jobs(CANDIDATES[2:4] * 3)
    assert many <= few + 12  # the stages of a plan that adapts, not one row of jobs a candidate and fold
