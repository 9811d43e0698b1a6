"""Screening rules over one candidate per order, and signal limits over bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.scalar import safe_div
from tickloom.operators import ensemble as E
from tickloom.operators import features as X
from tickloom.operators import screen as C
from tickloom.operators import structure as ST
from tickloom.operators.series import pin
from tickloom.plans import sqltext as q
from tickloom.plans.features import _FLOW, show
from tickloom.plans.ledger import neat
from tickloom.plans.market import SIGNALS, WITH_SIGNALS, bars, ledger, signals, table, with_bars, WITH_LEDGER
from tickloom.plans.registry import query


def _bucketed(values, default="NULL", col="bk"):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in values.items()) + f" ELSE {default} END"


P = C.POLICY
_BK = SIGNALS + ", sb AS (SELECT *, coalesce(session_bucket, 'dead_zone') AS bk FROM sig)"
_GATES = "WITH " + _BK + f""",
g0 AS (SELECT *, CASE WHEN side = 'long' THEN coalesce(p_trend_up, p_regime_trend) ELSE coalesce(p_trend_down, p_regime_collapse) END < 0.45 AS weak, lower(structural_bias_6h) AS bs,
  displacement_body_pct_1h IS NULL OR volume_z_1h IS NULL OR flow_age_bars_1h IS NULL AS gap FROM sb),
g1 AS (SELECT *, coalesce(bs <> CASE WHEN side = 'long' THEN 'up' ELSE 'down' END, false) AS wrong FROM g0),
g2 AS (SELECT *, CASE WHEN toxicity_12h IS NULL THEN 'ocean_tox_missing' WHEN weak THEN 'ocean_trend_low'
    WHEN toxicity_12h > 0.35 THEN 'ocean_tox_high' END AS r1,
  CASE WHEN bs IS NULL AND zone_score_6h IS NULL THEN 'waves_missing' WHEN wrong THEN 'waves_bias_mismatch' WHEN zone_score_6h < 0.6 THEN 'waves_zone_low' END AS r2,
  CASE WHEN flow_ok_1h IS NOT NULL THEN CASE WHEN flow_ok_1h = 0 THEN 'flow_flag_false' END WHEN gap THEN 'flow_missing'
    WHEN displacement_body_pct_1h < 0.6 THEN 'flow_body_low' WHEN volume_z_1h < 0.8 THEN 'flow_vol_low' WHEN flow_age_bars_1h > 4 THEN 'flow_stale'
    WHEN p_flow_1h < 0.55 THEN 'flow_ml_low' END AS r3,
  CASE WHEN session_weight < {_bucketed(P.min_session_weight)} THEN 'session_weight_low' WHEN coalesce(p_flow_1h, -1) < {_bucketed(P.flow_prob_min)} THEN 'session_flow_prob_low'
    WHEN hazard_score > {_bucketed(P.hazard_max)} THEN 'session_hazard_high' END AS r4 FROM g1)"""


@query("P10_gates", _GATES + """
SELECT id, CASE WHEN r1 IS NULL THEN 1 ELSE 0 END AS gate_ocean, CASE WHEN r2 IS NULL THEN 1 ELSE 0 END AS gate_waves, CASE WHEN r3 IS NULL THEN 1 ELSE 0 END AS gate_flow,
  CASE WHEN r4 IS NULL THEN 1 ELSE 0 END AS gate_session, CASE WHEN r1 IS NULL AND r2 IS NULL AND r3 IS NULL AND r4 IS NULL THEN 1 ELSE 0 END AS gate_passed,
  array_to_string(list_filter([r1, r2, r3, r4], lambda x: x IS NOT NULL), ',') AS reasons FROM g2""")
def gates(spark, d):
    out = C.gates(signals(spark, d)).withColumn("reasons", F.array_join("gate_reasons", ","))
    return neat(out.select("id", "gate_ocean", "gate_waves", "gate_flow", "gate_session", "gate_passed", "reasons"))


_LENIENT = _GATES.replace("CASE WHEN toxicity_12h IS NULL THEN 'ocean_tox_missing' WHEN weak",
                          "CASE WHEN weak").replace(
    "WHEN bs IS NULL AND zone_score_6h IS NULL THEN 'waves_missing' WHEN wrong", "WHEN wrong").replace(
    "WHEN gap THEN 'flow_missing'", "WHEN gap THEN CASE WHEN p_flow_1h < 0.55 THEN 'x' END")


@query("P10_gates_lenient", _LENIENT + """
SELECT id, CASE WHEN r1 IS NULL THEN 1 ELSE 0 END AS gate_ocean, CASE WHEN r2 IS NULL THEN 1 ELSE 0 END AS gate_waves,
  CASE WHEN r3 IS NULL THEN 1 ELSE 0 END AS gate_flow FROM g2""")
def gates_lenient(spark, d):
    return neat(C.gates(signals(spark, d), p=C.Policy(strict=False)).select("id", "gate_ocean", "gate_waves", "gate_flow"))


_CONF = f""",
c0 AS (SELECT *, (1.0 * ((p_liq_flow + p_bos_cont + coalesce(p_flow_1h, 0) + p_momo) / 4) + 0.5 * prob_meta + 0.75 * coalesce(p_flow_1h, 0)
  + 0.5 * (coalesce(p_trend_up, p_regime_trend) + 0.5 * p_regime_expansion - 0.5 * coalesce(toxicity_12h, 0))) / 3.25 AS raw FROM sb),
c1 AS (SELECT *, raw * session_weight * {_bucketed(P.score_multiplier)} AS score, greatest(0.6::DOUBLE + {_bucketed(P.threshold_add)}, 0) AS thr FROM c0)"""


@query("F10_confluence", "WITH " + _BK + _CONF + """
SELECT id, round(score, 6) AS confluence, round(thr, 6) AS confluence_threshold, CASE WHEN score >= thr THEN 1 ELSE 0 END AS confluence_passed FROM c1""")
def confluence(spark, d):
    return neat(C.confluence(signals(spark, d)).select("id", "confluence", "confluence_threshold", "confluence_passed"))


@query("J11_session_policy_lookup", "WITH " + _BK + f"""
SELECT id, bk AS bucket, {_bucketed(P.hazard_max)} AS hazard_max, {_bucketed(P.qty_multiplier)} AS qty_multiplier FROM sb""")
def policy_lookup(spark, d):
    s = signals(spark, d)
    b = C.session_bucket(s)
    return s.select("id", b.alias("bucket"), C.by_bucket(b, P.hazard_max, None).alias("hazard_max"),
                    C.by_bucket(b, P.qty_multiplier, None).alias("qty_multiplier"))


_EVR = """,
v0 AS (SELECT *, CASE WHEN side = 'long' THEN 1 ELSE -1 END AS sg FROM sb),
v1 AS (SELECT *, CASE WHEN side = 'long' THEN close - 0.8 * atr ELSE close + 0.8 * atr END AS stp,
  [close + sg * 2.0 * greatest(coalesce(atr, 0), 1e-9), close + sg * 3.0 * greatest(coalesce(atr, 0), 1e-9), close + sg * 4.0 * greatest(coalesce(atr, 0), 1e-9),
   close + sg * 1.5 * greatest(coalesce(atr, 0), 1e-9)] AS tg FROM v0),
v2 AS (SELECT *, abs(close - stp) AS rk, CASE WHEN atr IS NULL THEN [] ELSE [abs(x - close) / abs(close - stp) FOR x IN tg] END AS rv FROM v1),
v3 AS (SELECT *, CASE WHEN len(rv) > 0 THEN p_bos_cont * list_avg(rv) - (1 - p_bos_cont) - (0.0004 + 0.0003 + CASE WHEN side = 'short' THEN 0.15 / 365 / 24 / 4 ELSE 0 END) * close / rk END AS evr_v,
  CASE WHEN len(rv) > 0 THEN list_median(rv) END AS med_v FROM v2)"""


def with_targets(s):
    return X.atr_targets(s, F.col("side"))


@query("F11_expected_value", "WITH " + _BK + _EVR + """
SELECT id, round(stp, 6) AS evr_stop, len(rv) AS targets, round(evr_v, 6) AS evr, round(med_v, 6) AS median_r FROM v3""")
def expected_value(spark, d):
    out = C.expected_value(with_targets(signals(spark, d).drop("evr", "median_r")))
    return neat(out.select("id", "evr_stop", F.size("r_values").alias("targets"), "evr", "median_r"))


def _tier(conf, evr, med, haz, failed="false"):
    rules = " ".join(
        f"WHEN coalesce({conf}, 0) >= {c} AND coalesce({evr}, -1e308) >= {e} AND coalesce({med}, -1e308) >= {m} AND coalesce({haz}, 1) <= {h} THEN '{t}'"
        for t, (c, e, m, h, _) in P.tiers.items())
    return f"CASE WHEN {failed} THEN 'failed' {rules} ELSE 'skip' END"


@query("F12_tiers", WITH_SIGNALS + f""", x AS (SELECT *, {_tier('confluence_score', 'evr', 'median_r', 'hazard_score')} AS t FROM sig)
SELECT id, t AS tier, CASE WHEN t = 'A+' THEN 1 ELSE 0 END AS tier_execute,
  CASE t WHEN 'skip' THEN 'below_thresholds' WHEN 'A+' THEN 'Aplus' ELSE t END AS tier_reason FROM x""")
def tiers(spark, d):
    return neat(C.tier(signals(spark, d)).select("id", "tier", "tier_execute", "tier_reason"))


_SCREEN = _GATES + _CONF.replace("FROM sb)", "FROM g2)") + _EVR.replace("FROM sb)", "FROM c1)") + f""",
w0 AS (SELECT *, {_tier('score', 'evr_v', 'med_v', 'hazard_score', 'NOT (score >= thr)')} AS tr, CASE WHEN r1 IS NULL AND r2 IS NULL AND r3 IS NULL AND r4 IS NULL THEN 1 ELSE 0 END AS gp FROM v3),
w1 AS (SELECT *, CASE WHEN tr = 'failed' THEN 'B' ELSE tr END AS tier, CASE tr WHEN 'failed' THEN 'confluence_fail' WHEN 'skip' THEN 'below_thresholds' WHEN 'A+' THEN 'Aplus' ELSE tr END AS tier_reason,
  CASE WHEN tr = 'A+' THEN 1 ELSE 0 END AS tier_execute FROM w0)"""


@query("P16_scanner_events", _SCREEN + """
SELECT id, tier, CASE WHEN gp = 0 THEN 'gate_blocked' ELSE tier_reason END AS scanner_reason FROM w1
WHERE tier_execute = 0 AND (gp = 1 OR coalesce(score >= 0.45, false) OR coalesce(evr_v >= 0.8, false) OR tier IN ('A+', 'A', 'B') OR coalesce(p_flow_1h >= 0.6, false))""")
def scanner_events(spark, d):
    out = C.scanner_events(C.screen(with_targets(signals(spark, d).drop("evr", "median_r"))))
    return out.select("id", "tier", "scanner_reason")


@query("F13_r_and_quantity", WITH_SIGNALS + """
SELECT id, round(CASE WHEN side = 'long' THEN close - entry_price ELSE entry_price - close END / abs(entry_price - stop_price), 6) AS r_now,
  round(equity * 0.5 / 100 / abs(entry_price - stop_price), 6) AS qty_for_risk,
  round(CASE WHEN absorption_score <= 0.4 THEN 1.0 WHEN absorption_score >= 0.7 THEN 0.5 ELSE 1 - 0.5 * (absorption_score - 0.4) / (0.3 + 1e-9) END, 6) AS throttle FROM sig""")
def r_and_quantity(spark, d):
    long = F.col("side") == "long"
    e, s = F.col("entry_price"), F.col("stop_price")
    return neat(signals(spark, d).select(
        "id", C.r_multiple(e, s, F.col("close"), long).alias("r_now"),
        C.quantity_for_risk(F.col("equity"), F.lit(0.5), e, s).alias("qty_for_risk"),
        C.absorption_throttle(F.col("absorption_score")).alias("throttle")))


@query("F14_hazard_curve_and_tail", WITH_SIGNALS + """
SELECT id, round((hazard_score / 1 + p_edp / 4 + p_eop / 12) / (1 + 1.0 / 4 + 1.0 / 12), 6) AS hazard_from_curve, round(abs(least((q05 + q10) / 2, 0)), 6) AS cvar FROM sig""")
def hazard_curve(spark, d):
    curve = F.create_map(F.lit(1), F.col("hazard_score"), F.lit(4), F.col("p_edp"), F.lit(12), F.col("p_eop"))
    s = signals(spark, d).withColumn("hazard_curve", curve)
    return neat(s.select("id", C.hazard_from_curve("hazard_curve").alias("hazard_from_curve"),
                         C.tail_estimate(F.col("q05"), F.col("q10")).alias("cvar")))


_RISK = """rk AS (SELECT *, abs(least((q05 + q10) / 2, 0)) AS cvar, CASE WHEN hazard_score >= 0.6 OR p_edp > p_eop THEN 0.005::DOUBLE WHEN hazard_score >= 0.4 THEN 0.010::DOUBLE ELSE 0.015::DOUBLE END AS rm,
  least(0.8::DOUBLE, greatest(0.3::DOUBLE, hazard_score)) AS hr FROM sig),
rk2 AS (SELECT *, CASE WHEN cvar > 0.015 THEN least(rm, 0.005::DOUBLE) ELSE rm END AS risk_mode, CASE WHEN cvar > 0.015 THEN 0.5::DOUBLE ELSE least(0.5::DOUBLE, greatest(0, p_edp)) END AS lock_fraction,
  CASE WHEN cvar > 0.015 THEN greatest(hr, 0.8::DOUBLE) ELSE hr END AS hedge_ratio FROM rk)"""


@query("F15_risk_mode", WITH_SIGNALS + ", " + _RISK + """
SELECT id, round(cvar, 6) AS cvar, round(risk_mode, 6) AS risk_mode, round(lock_fraction, 6) AS lock_fraction, round(hedge_ratio, 6) AS hedge_ratio FROM rk2""")
def risk_mode(spark, d):
    return neat(C.risk_mode(signals(spark, d)).select("id", "cvar", "risk_mode", "lock_fraction", "hedge_ratio"))


@query("F16_position_and_ticket_size", WITH_SIGNALS + ", " + _RISK + f""",
z0 AS (SELECT *, coalesce(session_bucket, 'dead_zone') AS bk, abs(close - stop_price) AS ds FROM rk2),
z1 AS (SELECT *, equity * risk_mode / nullif(ds, 0) AS rq FROM z0),
z2 AS (SELECT *, CASE WHEN rq * close / equity > 1 THEN equity / close ELSE rq END AS rq2, CASE WHEN session_quality_multiplier > 0 THEN session_quality_multiplier ELSE {_bucketed(P.qty_multiplier)} END AS sc,
  {_bucketed(P.ticket_multiplier)} * CASE WHEN coalesce(session_quality_multiplier, 1) > 0 THEN coalesce(session_quality_multiplier, 1) ELSE 1 END AS tm FROM z1),
z3 AS (SELECT *, CASE WHEN equity > 0 AND close > 0 AND ds > 0 THEN greatest(rq2, 0) * sc ELSE 0 END AS sq,
  least(20000.0 * (greatest(equity - locked_profit, 0) / 20000.0) * greatest(tm, 0), free_capital) AS tk FROM z2)
SELECT id, round(sq, 6) AS size_qty, round(sq * hedge_ratio, 6) AS hedge_qty, round(sq * close, 4) AS size_value, round(sq * ds, 6) AS risk_dollars,
  round(sq * close / equity, 6) AS leverage_estimate, round(CASE WHEN free_capital > 0 THEN CASE WHEN tk < 1000 THEN 0 ELSE greatest(tk, 0) END ELSE 0 END, 6) AS ticket_usd,
  CASE WHEN free_capital > 0 THEN 'ticket' ELSE 'blocked' END AS ticket_mode FROM z3""")
def sizes(spark, d):
    out = C.ticket_size(C.position_size(C.risk_mode(signals(spark, d))))
    return neat(out.select("id", "size_qty", "hedge_qty", "size_value", "risk_dollars", "leverage_estimate", "ticket_usd",
                           "ticket_mode"), size_value=4)


@query("F17_hazard_action", WITH_SIGNALS + """,
hs AS (SELECT *, CASE WHEN p_regime_trend >= 0.5 AND session_bucket = 'overlap' AND hazard_score > 0.5 THEN 0.5::DOUBLE * 1.01
  WHEN p_regime_trend < 0.5 AND session_bucket = 'dead_zone' AND hazard_score > 0.35 THEN 0.35::DOUBLE * 1.01 ELSE hazard_score END AS hseg FROM sig),
h0 AS (SELECT *, leg = 'runner' AS rn, hseg + CASE WHEN bars_in_trade > 32 THEN 0.02::DOUBLE * (bars_in_trade - 32) / 32.0 ELSE 0 END
  + CASE WHEN abs(ema_dist_z) > 2.5 THEN 0.05::DOUBLE * (abs(ema_dist_z) - 2.5) ELSE 0 END AS hz FROM hs),
h1 AS (SELECT *, rn AND confluence_score >= 0.75 AND p_bos_cont >= 0.6 AND p_eop - p_edp >= 0 AND median_r >= 6 AS stg FROM h0),
h2 AS (SELECT *, CASE WHEN stg THEN greatest(0, hz - 0.08) ELSE hz END AS ha, CASE WHEN stg THEN 1.0::DOUBLE ELSE 0.0 END AS bo FROM h1),
h3 AS (SELECT *, CASE WHEN ha > CASE WHEN rn THEN 0.65::DOUBLE ELSE 0.5 END + 0.08 * bo THEN 'exit' WHEN ha > CASE WHEN rn THEN 0.55::DOUBLE ELSE 0.4 END + 0.05 * bo THEN 'partial'
  WHEN ha > CASE WHEN rn THEN 0.4::DOUBLE ELSE 0.3 END + 0.03 * bo THEN 'tighten' ELSE 'hold' END AS act FROM h2)
SELECT id, round(ha, 6) AS hazard_adjusted, act AS hazard_action, round(CASE WHEN act = 'hold' THEN stop_price ELSE close + CASE WHEN side = 'long' THEN -1 ELSE 1 END
  * CASE WHEN act = 'exit' THEN CASE WHEN rn THEN 1.8::DOUBLE ELSE 1.0 END ELSE CASE WHEN rn THEN 0.25::DOUBLE ELSE 0.5 END END * atr END, 6) AS hazard_stop FROM h3""")
def hazard_action(spark, d):
    s = signals(spark, d).withColumns({"regime": F.when(F.col("p_regime_trend") >= 0.5, "trend").otherwise("range"), "session": F.col("session_bucket")})
    out = C.hazard_action(s, {("trend", "overlap"): 0.5, ("range", "dead_zone"): 0.35})
    return neat(out.select("id", "hazard_adjusted", "hazard_action", "hazard_stop"))


@query("F18_profit_ladder", WITH_SIGNALS + """,
l0 AS (SELECT *, abs(entry_price - stop_price) AS rk, CASE WHEN leg = 'core' THEN CASE WHEN confluence_score >= 0.75 AND p_bos_cont >= 0.6 AND median_r >= 6 THEN 3.0::DOUBLE ELSE 2.0 END
  ELSE greatest(6, least(10, coalesce(nullif(median_r, 0), 6))) END AS tr,
  CASE WHEN side = 'long' THEN close - entry_price ELSE entry_price - close END / abs(entry_price - stop_price) AS rn FROM sig)
SELECT id, round(tr, 6) AS target_r, round(rn, 6) AS r_now, round(CASE WHEN side = 'long' THEN entry_price + tr * rk ELSE entry_price - tr * rk END, 6) AS target_price,
  CASE WHEN rn >= 2 THEN round(CASE WHEN side = 'long' THEN greatest(stop_price, entry_price) ELSE least(stop_price, entry_price) END, 6) END AS breakeven_stop,
  CASE WHEN rk > 0 AND rn >= tr THEN 1 ELSE 0 END AS take_profit FROM l0""")
def profit_ladder(spark, d):
    return neat(C.profit_ladder(signals(spark, d)).select("id", "target_r", "r_now", "target_price", "breakeven_stop", "take_profit"))


@query("F19_cooling_votes", WITH_SIGNALS + """,
c0 AS (SELECT *, greatest(equity - 20000, 0) AS pf, abs(least((q05 + q10) / 2, 0)) AS cv, drawdown >= 0.08 AS deep,
  CASE WHEN confluence_score >= 0.55 AND evr >= 1.8 AND median_r >= 6 AND hazard_score <= 0.25 THEN 'moonshot'
       WHEN confluence_score >= 0.5 AND evr >= 1.2 AND median_r >= 2 AND hazard_score <= 0.4 THEN '2R' END AS ovr FROM sig),
c1 AS (SELECT *, list_filter([CASE WHEN hazard_score >= 0.4 THEN 'hazard' END, CASE WHEN p_edp - p_eop >= 0 THEN 'edp_over_eop' END, CASE WHEN cv > 0.015 THEN 'cvar' END], lambda x: x IS NOT NULL) AS vt FROM c0),
c2 AS (SELECT *, pf >= 50 AND (deep OR len(vt) >= 2) AS hit FROM c1)
SELECT id, CASE WHEN hit THEN 1 ELSE 0 END AS danger, CASE WHEN hit THEN CASE WHEN deep THEN 'drawdown' ELSE array_to_string(vt, '+') END END AS danger_reason,
  round(CASE WHEN hit THEN least(free_capital, greatest(pf - locked_profit, 0)) ELSE 0 END, 6) AS lock_amount,
  CASE WHEN hit THEN 24 ELSE 0 END AS cooldown_bars, ovr AS cooling_override FROM c2""")
def cooling_votes(spark, d):
    out = C.cooling_votes(signals(spark, d)).withColumn("cooling_override", C.cooling_override(
        F.col("confluence_score"), 0.45, F.col("evr"), F.col("median_r"), F.col("hazard_score")))
    return neat(out.select("id", "danger", "danger_reason", "lock_amount", F.col("cooldown_bars").cast("long").alias("cooldown_bars"),
                           "cooling_override"))


@query("F20_trade_costs", WITH_SIGNALS + """, x AS (SELECT *, close * qty AS nt, bars_in_trade * 15 / 1440.0 AS dy FROM sig)
SELECT id, round(nt * 0.0004, 6) AS taker_fee, round(nt * 0.0002, 6) AS maker_fee, round(nt * 0.0003, 6) AS slippage_cost, round(nt * (0.15 / 365) * dy, 6) AS borrow_cost,
  round(nt * 0.01 * dy, 6) AS funding_cost, round(close + 0.0003 * nt / qty, 6) AS fill_price,
  round(close * CASE WHEN side = 'long' THEN 1.0003::DOUBLE * 1.0004::DOUBLE ELSE 0.9997::DOUBLE * 0.9996::DOUBLE END, 6) AS market_fill FROM x""")
def trade_costs(spark, d):
    out = C.trade_costs(signals(spark, d), funding_rate=0.01)
    return neat(out.select("id", "taker_fee", "maker_fee", "slippage_cost", "borrow_cost", "funding_cost", "fill_price", "market_fill"))


@query("F28_add_on_legs", WITH_SIGNALS + """,
a0 AS (SELECT *, coalesce(p_flow_1h, 0) >= 0.55 OR flow_strength_1h > 0 AS fl, session_weight >= 0.2 AND confluence_score >= 0.5 AND absorption_score < 0.7 AS ql,
  stop_price + CASE WHEN side = 'long' THEN -1 ELSE 1 END * 0.1 * coalesce(atr, 0) AS st,
  CASE WHEN absorption_score <= 0.4 THEN 1.0 WHEN absorption_score >= 0.7 THEN 0.5 ELSE 1 - 0.5 * (absorption_score - 0.4) / (0.3 + 1e-9) END AS th FROM sig),
a1 AS (SELECT *, ql AND CASE legs WHEN 1 THEN fl AND displacement = 1 AND fresh_retest = 1 WHEN 2 THEN bos_flag = 1 AND fresh_retest = 1 WHEN 3 THEN fl ELSE true END
  AND greatest(legs - 1, 0) < 3 AND 0.5 + (legs - 1) * 0.25 + 0.25 <= 1.25 AS ok FROM a0),
a2 AS (SELECT *, CASE WHEN ok AND close > 0 AND st > 0 THEN coalesce(equity * 0.25 * th / 100 / nullif(abs(close - st), 0), 0) ELSE 0 END AS aq FROM a1)
SELECT id, CASE WHEN ok AND aq > 0 THEN 1 ELSE 0 END AS add_allowed, round(st, 6) AS add_stop, round(aq, 6) AS add_qty FROM a2""")
def add_on(spark, d):
    return neat(C.add_on(signals(spark, d)).select("id", "add_allowed", "add_stop", "add_qty"))


@query("F30_zone_rows", with_bars("1h") + ", " + q.zone_life("b_1h", "z") + """
SELECT z.asset, b.t AS start_t, CASE WHEN q > 0.7 THEN b.t + 7200 ELSE b.t + 18000 END AS end_t, 'ob' AS kind,
  CASE side WHEN 'demand' THEN 'bullish' ELSE 'bearish' END AS side, top, bottom FROM z_n z JOIN b_1h b ON b.asset = z.asset AND b.i = z.born""")
def zone_rows(spark, d):
    z = ST.zone_births(bars(spark, d, "1h")).filter((F.col("demand_born") == 1) | (F.col("supply_born") == 1))
    t = F.unix_seconds("bar_close")
    out = C.zone_rows(z.select(
        "asset", t.alias("start_t"), F.when(F.col("zone_quality") > 0.7, t + 7200).alias("end_t"),
        F.lit("Order block").alias("kind"), F.when(F.col("demand_born") == 1, "Bullish").otherwise("Bearish").alias("side"),
        F.col("zone_bottom").alias("top"), F.col("zone_top").alias("bottom")))
    return out


@query("F31_decision_payload", WITH_SIGNALS + """
SELECT id, p_liq_flow AS ml_liq, structural_bias_6h AS bias, p_regime_trend AS trend, flow_age_bars_1h AS age, hazard_score AS hazard, session_bucket AS bucket FROM sig""")
def decision_payload(spark, d):
    s = signals(spark, d)
    j = s.select("id", C.decision_payload(s).alias("j"))
    g = lambda p, t: F.get_json_object("j", p).cast(t)
    return j.select("id", g("$.ml.p_liq_flow", "double").alias("ml_liq"), g("$.structure.bias", "string").alias("bias"),
                    g("$.regime.trend", "double").alias("trend"), g("$.flow.age", "long").alias("age"),
                    g("$.hazard.score", "double").alias("hazard"), g("$.session.bucket", "string").alias("bucket"))


@query("F32_guardrails", WITH_SIGNALS + """
SELECT id, CASE WHEN bars_in_trade % 4 = 0 THEN 'warn' ELSE 'pass' END AS guard_cooling,
  CASE WHEN drawdown * 100 > 10 THEN 'block' WHEN drawdown * 100 > 4 THEN 'warn' ELSE 'pass' END AS guard_drawdown,
  CASE WHEN legs * 2 > 4 THEN 'warn' ELSE 'pass' END AS guard_execution FROM sig""")
def guardrails(spark, d):
    out = C.guardrails(signals(spark, d), F.col("drawdown") * 100, F.col("legs") * 2, F.col("bars_in_trade") % 4 == 0)
    return out.select("id", "guard_cooling", "guard_drawdown", "guard_execution")


@query("F27_regime_rule", WITH_SIGNALS + """,
x AS (SELECT *, greatest(p_regime_trend, p_regime_expansion, p_regime_collapse, p_regime_range) AS top FROM sig),
y AS (SELECT *, CASE WHEN p_regime_trend = top THEN 'trend' WHEN p_regime_expansion = top THEN 'expansion' WHEN p_regime_collapse = top THEN 'collapse' ELSE 'range' END AS rg FROM x)
SELECT id, CASE WHEN top >= 0.45 THEN CASE rg WHEN 'trend' THEN CASE WHEN side = 'long' THEN 'm1' ELSE 'm2' END WHEN 'expansion' THEN CASE WHEN side = 'long' THEN 'm3' ELSE 'm2' END
  WHEN 'collapse' THEN CASE WHEN side = 'long' THEN NULL ELSE 'm4' END END END AS model FROM y""")
def regime_rule(spark, d):
    s = signals(spark, d)
    usable = F.when(F.col("side") == "long", F.array(F.lit("m1"), F.lit("m3"))).otherwise(F.array(F.lit("m2"), F.lit("m4")))
    probs = {n: f"p_regime_{n}" for n in ("trend", "expansion", "collapse", "range")}
    prefer = {"trend": ["m1", "m2"], "expansion": ["m3", "m2", "m1"], "collapse": ["m4"]}
    return s.select("id", E.regime_rule(probs, prefer, usable, 0.45).alias("model"))


# ------------------------------------------------------------ ensembles: three models, two outputs per order

_OUT = """outp AS (SELECT o_orderkey AS row_id, m AS model, x AS output,
  CASE WHEN (o_orderkey + length(m) + length(x)) % 7 <> 0 THEN ((o_orderkey * (CASE m WHEN 'a' THEN 3 WHEN 'bb' THEN 5 ELSE 7 END) + o_custkey * length(x)) % 101) / 100.0::DOUBLE END AS p
  FROM orders, (VALUES ('a'), ('bb'), ('ccc')) mm(m), (VALUES ('up'), ('down')) xx(x)), pr AS (SELECT * FROM outp WHERE p IS NOT NULL)"""


def model_outputs(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    grid = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).alias("f"), F.lit(x).alias("output"))
                     for m, f in (("a", 3), ("bb", 5), ("ccc", 7)) for x in ("up", "down")])
    long = o.select(k.alias("row_id"), c.alias("c"), F.explode(grid).alias("g")).select("row_id", "c", "g.*")
    keep = (F.col("row_id") + F.length("model") + F.length("output")) % 7 != 0
    return long.filter(keep).select(
        "row_id", "model", "output", (((F.col("row_id") * F.col("f") + F.col("c") * F.length("output")) % 101) / 100.0).alias("p"))


@query("A31_fused_outputs", f"""WITH {_OUT},
w AS (SELECT *, CASE model WHEN 'a' THEN 0.5::DOUBLE WHEN 'bb' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS w FROM pr),
t AS (SELECT row_id, sum(w) AS tw FROM (SELECT DISTINCT row_id, model, w FROM w) GROUP BY 1)
SELECT w.row_id, output, round(sum(w * p) / any_value(tw), 6) AS fused FROM w JOIN t USING (row_id) GROUP BY 1, 2""")
def fused(spark, d):
    return neat(E.fuse(model_outputs(spark, d), {"a": 0.5, "bb": 0.3, "ccc": 0.2}))


@query("A31_disagreement", f"""WITH {_OUT},
v AS (SELECT row_id, var_pop(p) AS spread FROM pr GROUP BY 1),
g AS (SELECT row_id, max(gap) AS max_gap FROM (SELECT row_id, output, max(p) - min(p) AS gap FROM pr GROUP BY 1, 2) GROUP BY 1),
pw AS (SELECT a.row_id, avg(abs(a.p - b.p)) AS pairwise FROM pr a JOIN pr b ON a.row_id = b.row_id AND a.output = b.output GROUP BY 1)
SELECT v.row_id, round(spread, 6) AS spread, round(max_gap, 6) AS max_gap, round(pairwise, 6) AS pairwise FROM v JOIN g USING (row_id) JOIN pw USING (row_id)""")
def disagreement(spark, d):
    return neat(E.disagreement(model_outputs(spark, d)))


@query("A32_consensus_votes", WITH_LEDGER + """,
s AS (SELECT session AS candidate, tier AS model, round(avg(conf), 3) AS score FROM led GROUP BY 1, 2),
b AS (SELECT model, max(score) AS best FROM s GROUP BY 1)
SELECT candidate, count(*) FILTER (score >= best - 0.005) AS votes, round(avg(score), 6) AS score FROM s JOIN b USING (model) GROUP BY 1""")
def votes(spark, d):
    s = ledger(spark, d).groupBy(F.col("session").alias("candidate"), F.col("tier").alias("model")).agg(F.round(F.avg("conf"), 3).alias("score"))
    return neat(E.consensus_votes(s, ("candidate",), 0.005))


_STATIC = {"m1": 0.5, "m2": 0.3, "m3": 0.2}
_DELTA = {"p_regime_trend": {"m1": 0.4, "m2": -0.9}, "p_regime_expansion": {"m3": 0.5}}
_WSQL = {m: f"greatest({b} + " + " + ".join(f"{c} * {dd[m]}" for c, dd in _DELTA.items() if m in dd) + ", 0)" for m, b in _STATIC.items()}


def _regimes(spark, d):
    """Hourly bars with two regime odds taken from the bar itself."""
    b = bars(spark, d, "1h")
    rng = F.col("high") - F.col("low")
    return b.withColumns({"p_regime_trend": F.coalesce(safe_div(F.abs(F.col("close") - F.col("open")), rng), F.lit(0.0)),
                          "p_regime_expansion": F.coalesce(safe_div(rng, F.col("high")), F.lit(0.0))})


@query("W49_smoothed_weights", with_bars("1h") + ", r AS (SELECT *, coalesce(abs(c - o) / nullif(h - l, 0), 0) AS p_regime_trend, coalesce((h - l) / h, 0) AS p_regime_expansion FROM b_1h), "
       + "w0 AS (SELECT *, " + ", ".join(f"{e} AS {m}" for m, e in _WSQL.items()) + " FROM r), "
       + "w1 AS (SELECT asset, t, i, " + ", ".join(f"{m} / (m1 + m2 + m3) AS {m}" for m in _STATIC) + " FROM w0), "
       + "w2 AS (SELECT asset, t, " + ", ".join(
    f"list_reduce(list_prepend({b}::DOUBLE, list({m}) OVER {q.SO_FAR}), lambda y, x: y * 0.1 + x * 0.9) AS {m}" for m, b in _STATIC.items())
       + " FROM w1) SELECT asset, t, " + ", ".join(f"round({m}, 6) AS weight_{m}" for m in _STATIC) + " FROM w2")
def weights(spark, d):
    return show(E.smoothed_weights(_regimes(spark, d), _STATIC, _DELTA), [f"weight_{m}" for m in _STATIC])


@query("W47_best_version", WITH_LEDGER + """,
s AS (SELECT tier AS model, session AS version, CASE WHEN session <> 'ny' THEN round(avg(conf), 4) END AS cv_score, round(avg(hazard_entry), 4) AS brier FROM led GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN cv_score IS NOT NULL THEN 100 ELSE 10 END AS priority, CASE WHEN cv_score IS NOT NULL THEN cv_score ELSE -brier END AS score FROM s)
SELECT model, arg_max(version, (priority, score, version)) AS version, max(priority) AS priority, arg_max(score, (priority, score, version)) AS score FROM r GROUP BY 1""")
def best_version(spark, d):
    s = ledger(spark, d).groupBy(F.col("tier").alias("model"), F.col("session").alias("version")).agg(
        F.when(F.col("session") != "ny", F.round(F.avg("conf"), 4)).alias("cv_score"), F.round(F.avg("hazard_entry"), 4).alias("brier"))
    return neat(E.best_version(s))


# ------------------------------------------------------------ signal limits and history proxies

def _candidates(spark, d):
    b = pin(bars(spark, d, "15m"))
    return b.withColumns({"bar_index": F.col("row_idx"), "candidate": (F.col("close") > F.col("open")).cast("int")})


@query("W48_spaced_signals", q.spaced(with_bars("15m"), "SELECT asset, i, t FROM b_15m WHERE c > o", 2, 2) + """
SELECT b.asset, b.t, CAST(b.c > b.o AS INTEGER) AS candidate, CAST(coalesce(accepted, 0) AS INTEGER) AS accepted
FROM b_15m b LEFT JOIN decided d ON d.asset = b.asset AND d.i = b.i""")
def spaced(spark, d):
    out = C.spaced_signals(_candidates(spark, d), per_hour=2, min_gap=2)
    return out.select("asset", F.unix_seconds("bar_close").alias("t"), "candidate", "accepted")


@query("W48_top_per_hour", WITH_SIGNALS + """
SELECT id, rank FROM (SELECT id, row_number() OVER (PARTITION BY asset, date_trunc('hour', ts) ORDER BY hazard_score DESC, id) AS rank FROM sig) WHERE rank <= 2""")
def top_per_hour(spark, d):
    s = signals(spark, d).withColumn("bar_close", F.col("ts"))
    return neat(C.top_per_hour(s, 2, "hazard_score").select("id", "rank"))


def _scale(rel, x, lo, hi):
    return f"(1 / (1 + exp(-least(20, greatest(-20, ((coalesce({x}, {lo}) - {lo}) / greatest({hi} - {lo}, 1e-9) - 0.5) * 4)))))"


@query("F7_quantile_scaling", WITH_SIGNALS + """, e AS (SELECT quantile_cont(atr, 0.1) AS a0, quantile_cont(atr, 0.9) AS a1, quantile_cont(zone_score_6h, 0.1) AS z0, quantile_cont(zone_score_6h, 0.9) AS z1 FROM sig)
SELECT id, round(""" + _scale("sig", "atr", "a0", "a1") + ", 6) AS atr_q, round(" + _scale("sig", "zone_score_6h", "z0", "z1") + """, 6) AS zone_score_6h_q, 0.5::DOUBLE AS flat_q FROM sig, e""")
def scaling(spark, d):
    s = signals(spark, d).withColumn("flat", F.lit(3.0))
    out = C.quantile_scaled(s, {"atr": (0.1, 0.9), "zone_score_6h": (0.1, 0.9), "flat": (0.1, 0.9)})
    return neat(out.select("id", "atr_q", "zone_score_6h_q", "flat_q"))


_PROXY = WITH_SIGNALS + """,
e AS (SELECT quantile_cont(absorption_score, 0.1) AS a0, quantile_cont(absorption_score, 0.9) AS a1, quantile_cont(coalesce(toxicity_12h, 0), 0.1) AS t0, quantile_cont(coalesce(toxicity_12h, 0), 0.9) AS t1,
  quantile_cont(displacement_body_pct_1h, 0.1) AS d0, quantile_cont(displacement_body_pct_1h, 0.9) AS d1 FROM sig),
p0 AS (SELECT *, """ + _scale("", "absorption_score", "a0", "a1") + " AS ab, " + _scale("", "coalesce(toxicity_12h, 0)", "t0", "t1") + " AS tx, " + _scale("", "displacement_body_pct_1h", "d0", "d1") + """ AS dp,
  least(1, greatest(0, 0.6 * least(1, greatest(0, flow_strength_1h)) + 0.25 * coalesce(flow_ok_1h, 0))) AS fl,
  least(1, greatest(0, 0.45 * bos_flag + 0.15 * fresh_retest + 0.15)) AS su, least(1, greatest(0, 0.45 * p_regime_trend + 0.35 * p_regime_expansion + 0.2 * (1 - p_regime_collapse))) AS rg,
  coalesce(session_quality_multiplier, session_weight) AS mu FROM sig, e),
p1 AS (SELECT *, least(1, greatest(0, (mu - 0.75) / 0.40)) AS ses FROM p0),
p2 AS (SELECT *, least(1, greatest(0, 0.34 * fl + 0.22 * su + 0.19 * rg + 0.15 * ab + 0.10 * ses)) AS cr FROM p1),
e2 AS (SELECT quantile_cont(cr, 0.2) AS c0, quantile_cont(cr, 0.98) AS c1 FROM p2),
p3 AS (SELECT *, """ + _scale("", "cr", "c0", "c1") + """ AS cf, 0.75 * least(1, greatest(0, 0.34 * tx + 0.24 * 0.5 + 0.16 * 0.5 + 0.14 * 0.5 + 0.07 * CASE WHEN mu < 0.9 THEN 1 ELSE 0 END + 0.05 * 0.5)) AS hz FROM p2, e2),
p4 AS (SELECT *, least(6, greatest(-2, -0.6 + 2.4 * cf + 1.4 * least(1, greatest(0, flow_strength_1h)) + 0.8 * p_regime_trend + 0.6 * dp + 0.5 * ses + 0.4 * 0.5 - 2.1 * hz)) AS ev,
  least(12, greatest(0, 1.0 + 6.5 * cf + 2.0 * least(1, greatest(0, flow_strength_1h)) + 1.0 * dp + 0.8 * 0.5 - 4.0 * hz)) AS mr FROM p3)
SELECT id, round(cf, 6) AS conf_proxy, round(hz, 6) AS hazard_proxy, round(ev, 6) AS evr_proxy, round(mr, 6) AS median_r_proxy,
  CASE WHEN cf >= 0.8 AND ev >= 1.5 AND mr >= 5 AND hz <= 0.35 THEN 'A+' WHEN cf >= 0.62 AND ev >= 1.05 AND mr >= 3.5 AND hz <= 0.45 THEN 'A' ELSE 'B' END AS tier_proxy FROM p4"""


@query("F8_opportunity_proxies", _PROXY)
def proxies(spark, d):
    s = signals(spark, d).drop("displacement")
    out = C.opportunity_proxies(s).withColumn("tier_proxy", C.opportunity_tier())
    return neat(out.select("id", "conf_proxy", "hazard_proxy", "evr_proxy", "median_r_proxy", "tier_proxy"))
