"""Forward-looking labels on the 15m spine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.operators import labels as L
from tickloom.operators import structure as ST
from tickloom.operators.asof import asof
from tickloom.operators.series import pin
from tickloom.plans import sqltext as q
from tickloom.plans.features import _FLOW, show
from tickloom.plans.market import bars, with_bars
from tickloom.plans.registry import query

_BASE = with_bars("15m") + ", " + q.true_range("b_15m", "a") + ", "
_STRUCT = _BASE + q.swings("a", "s", 2, 2) + ", " + q.breaks("s", "k") + ", " + q.sweeps("k", "w")


def structured(spark, d):
    """15m bars with ATR, pivots, breaks and sweeps, written once before the labels read them."""
    b = X.atr(bars(spark, d, "15m"))
    return pin(ST.structure_block(b, 2, 2))


def _liq_sql():
    side = "CASE WHEN sweep_low = 1 THEN 1 WHEN sweep_high = 1 THEN -1 ELSE 0 END"
    base = f"""p AS (SELECT *, {side} AS dr, coalesce(swept_level, CASE WHEN {side} > 0 THEN l ELSE h END) AS sp,
  c + ({side}) * 1.0 * atr AS tg FROM w), """
    hit = q.first_ahead("p", "x", 1, 12, {
        "so": "CASE WHEN s.dr > 0 THEN f.l <= s.sp ELSE f.h >= s.sp END",
        "ta": "CASE WHEN s.dr > 0 THEN f.h >= s.tg ELSE f.l <= s.tg END"})
    return _STRUCT + ", " + base + hit + """
SELECT asset, t, CASE WHEN dr <> 0 AND atr > 0 AND coalesce(displacement_hint, abs(c - o) / greatest(h - l, 1e-9)) >= 0.55
  AND ta IS NOT NULL AND (so IS NULL OR ta < so) THEN 1 ELSE 0 END AS label_liq_flow FROM x"""


@query("W31_liquidity_flow_label", _liq_sql())
def liq_flow(spark, d):
    return show(L.liquidity_flow(structured(spark, d)), ["label_liq_flow"])


def _bos_sql():
    opp = ("CASE WHEN s.dr > 0 THEN f.choch_down = 1 OR (f.choch_flag = 1 AND f.bias = 'DOWN') "
           "ELSE f.choch_up = 1 OR (f.choch_flag = 1 AND f.bias = 'UP') END")
    base = """p AS (SELECT *, CASE WHEN bos_up = 1 THEN 1 WHEN bos_down = 1 THEN -1 ELSE 0 END AS dr FROM w),
p2 AS (SELECT *, CASE WHEN dr > 0 THEN coalesce(broken_level, c - atr) - 0.3 * atr ELSE coalesce(broken_level, c + atr) + 0.3 * atr END AS sp,
  c + dr * 3.0 * atr AS tg FROM p), """
    hit = q.first_ahead("p2", "x", 1, 48, {
        "so": f"(CASE WHEN s.dr > 0 THEN f.l <= s.sp ELSE f.h >= s.sp END) OR ({opp})",
        "ta": "CASE WHEN s.dr > 0 THEN f.h >= s.tg ELSE f.l <= s.tg END"})
    return _STRUCT + ", " + base + hit + """
SELECT asset, t, CASE WHEN dr <> 0 AND atr > 0 AND ta IS NOT NULL AND (so IS NULL OR ta < so) THEN 1 ELSE 0 END AS label_bos_cont FROM x"""


@query("W32_break_continuation_label", _bos_sql())
def bos_cont(spark, d):
    return show(L.break_continuation(structured(spark, d)), ["label_bos_cont"])


@query("W33_momentum_label", with_bars("15m") + f""",
p AS (SELECT *, coalesce({q.div('c - ' + q.lag('c'), q.lag('c'))}, 0) AS rt FROM b_15m),
p1 AS (SELECT *, {q.roll('stddev_samp', 'rt', 50)} AS ns FROM p),
p2 AS (SELECT *, first_value(ns IGNORE NULLS) OVER (PARTITION BY asset ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nz,
  max(c) OVER {q.ahead(4, 8)} AS best FROM p1)
SELECT asset, t, CASE WHEN c > 0 AND nz <> 0 AND (best - c) / c >= nz * 1.95 THEN 1 ELSE 0 END AS label_momo FROM p2""")
def momo(spark, d):
    return show(L.momentum(bars(spark, d, "15m")), ["label_momo"])


@query("W34_flow_follow_through_label", with_bars("15m", "1h") + ", " + _FLOW + ", " + q.true_range("b_15m", "a") + f""",
p AS (SELECT a.*, sign(f.sg) AS dr, f.bp, f.vz, f.ag FROM a ASOF LEFT JOIN flow f ON f.asset = a.asset AND f.t <= a.t),
p2 AS (SELECT *, c - coalesce(dr, 0) * atr AS sp, c + coalesce(dr, 0) * 1.5 * atr AS tg FROM p), """ + q.first_ahead("p2", "x", 4, 12, {
    "so": "CASE WHEN s.dr > 0 THEN f.l <= s.sp ELSE f.h >= s.sp END",
    "ta": "CASE WHEN s.dr > 0 THEN f.h >= s.tg ELSE f.l <= s.tg END"}) + """
SELECT asset, t, CASE WHEN dr <> 0 AND bp >= 0.6 AND vz >= 0.8 AND coalesce(ag, 999) <= 4 AND atr > 0 AND ta IS NOT NULL
  AND (so IS NULL OR ta < so) THEN 1 ELSE 0 END AS label_flow_1h FROM x""")
def flow_1h(spark, d):
    flow = X.flow_block(bars(spark, d, "1h")).select(
        "asset", "bar_close", F.col("flow_signal").alias("flow_signal_1h"),
        F.col("flow_body_pct").alias("displacement_body_pct_1h"), F.col("flow_volume_z").alias("volume_z_1h"),
        F.col("flow_age_bars").alias("flow_age_bars_1h"))
    spine = asof(X.atr(bars(spark, d, "15m")), pin(flow))
    return show(L.flow_follow_through(spine), ["label_flow_1h"])


@query("W35_opportunity_label", _BASE + f"""p AS (SELECT *, CASE WHEN c > h - 0.2 * (h - l) AND h - l > 1.5 * atr THEN 1 ELSE 0 END AS cand FROM a)
SELECT asset, t, coalesce(max(cand) OVER {q.ahead(1, 96)}, 0) AS label_eop FROM p""")
def eop(spark, d):
    rng = F.col("high") - F.col("low")
    cand = (F.col("close") > F.col("high") - 0.2 * rng) & (rng > 1.5 * F.col("atr"))
    return show(L.opportunity(X.atr(bars(spark, d, "15m")), cand), ["label_eop"])


@query("W36_danger_label", _BASE.rstrip(", ") + f"""
SELECT asset, t, CASE WHEN atr > 0 AND c > 0 AND min(l) OVER {q.ahead(1, 96)} <= c - 3.0 * atr THEN 1 ELSE 0 END AS label_edp FROM a""")
def edp(spark, d):
    return show(L.danger(X.atr(bars(spark, d, "15m"))), ["label_edp"])


_DIR = """coalesce(nullif(sweep_dir, 0), CASE WHEN sweep_high = 1 THEN -1 WHEN sweep_low = 1 THEN 1 END,
  CASE WHEN bos_down = 1 THEN -1 WHEN bos_up = 1 THEN 1 END, CASE bias WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 END, 0)"""


@query("W37_survival_label", _STRUCT + f""",
p AS (SELECT *, CASE WHEN {_DIR} = 0 THEN 1 ELSE {_DIR} END AS dr FROM w),
p2 AS (SELECT *, CASE WHEN dr > 0 THEN c - atr ELSE c + atr END AS sp FROM p), """ + q.first_ahead("p2", "x", 1, 48, {
    "so": "CASE WHEN s.dr > 0 THEN f.l <= s.sp OR f.choch_down = 1 OR (f.choch_flag = 1 AND f.bias = 'DOWN') "
          "ELSE f.h >= s.sp OR f.choch_up = 1 OR (f.choch_flag = 1 AND f.bias = 'UP') END"}) + """
SELECT asset, t, CASE WHEN atr > 0 AND so IS NOT NULL THEN 1 ELSE 0 END AS hazard_event,
  CASE WHEN atr > 0 THEN coalesce(so, 48) ELSE 48 END AS hazard_time FROM x""")
def survival(spark, d):
    return show(L.survival(structured(spark, d)), ["hazard_event", "hazard_time"])


@query("F9_trade_direction", _STRUCT + f"""
SELECT asset, t, {_DIR} AS direction,
  CASE WHEN choch_down = 1 OR (choch_flag = 1 AND bias = 'DOWN') THEN 1 ELSE 0 END AS against_long,
  CASE WHEN choch_up = 1 OR (choch_flag = 1 AND bias = 'UP') THEN 1 ELSE 0 END AS against_short FROM w""")
def trade_direction(spark, d):
    s = structured(spark, d)
    long, short = L.opposite_reversal()
    return show(s.withColumns({"direction": L.direction(s), "against_long": long.cast("int"),
                               "against_short": short.cast("int")}), ["direction", "against_long", "against_short"])


@query("W38_forward_returns", with_bars("15m") + "\nSELECT asset, t, " + ", ".join(
    f"round(ln(lead(c, {h}) OVER {q.W} / c), 6) AS fwd_ret_{h}" for h in (1, 4, 12)) + " FROM b_15m")
def forward_returns(spark, d):
    return show(L.forward_returns(bars(spark, d, "15m")), ["fwd_ret_1", "fwd_ret_4", "fwd_ret_12"])


@query("J4_features_with_labels", _BASE + f"""e AS (SELECT asset, t, CASE WHEN atr > 0 AND c > 0 AND min(l) OVER {q.ahead(1, 96)} <= c - 3.0 * atr
  THEN 1 ELSE 0 END AS label_edp FROM a)
SELECT a.asset, a.t, a.c AS close, round(a.atr, 6) AS atr, e.label_edp FROM a JOIN e ON e.asset = a.asset AND e.t = a.t""")
def joined(spark, d):
    f = pin(X.atr(bars(spark, d, "15m")))
    labels = L.danger(f)
    extra = [c for c in labels.columns if c not in f.columns]
    return show(f.join(labels.select("asset", "bar_close", *extra), ["asset", "bar_close"]), ["close", "atr", "label_edp"])


@query("J9_map_lookup", with_bars("15m") + """
SELECT b.asset, b.t, b.c AS close, m.n AS trades FROM b_15m b
LEFT JOIN (SELECT asset, t, n FROM m1) m ON m.asset = b.asset AND m.t = b.t""")
def map_lookup(spark, d):
    from tickloom.plans.market import minutes

    values = minutes(spark, d).select("asset", "bar_close", "trades")
    return show(bars(spark, d, "15m").join(values, ["asset", "bar_close"], "left"), ["close", "trades"])
