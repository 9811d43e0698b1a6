"""Pivots, breaks, gaps, sweeps, zones and the higher-timeframe structure context."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.operators import structure as ST
from tickloom.operators.asof import asof
from tickloom.operators.series import pin
from tickloom.plans import sqltext as q
from tickloom.plans.features import show
from tickloom.plans.market import bars, epoch, with_bars
from tickloom.plans.registry import query


@query("W15_swing_pivots", with_bars("1h") + ", " + q.swings("b_1h", "s", 3, 3) + """
SELECT asset, t, swing_high, swing_low, confirmed_t FROM s""")
def pivots(spark, d):
    out = ST.swings(bars(spark, d, "1h"), 3, 3).withColumn("confirmed_t", epoch("swing_confirmed_at"))
    return show(out, ["swing_high", "swing_low", "confirmed_t"])


@query("W16_equal_levels_and_tiers", with_bars("15m") + ", " + q.swings("b_15m", "s", 2, 2) + """
SELECT asset, t, swing_equal_high, swing_equal_low, CASE WHEN sz > 0.005 * lvl THEN 'primary'
  WHEN sz > 0.002 * lvl THEN 'secondary' WHEN sz IS NOT NULL THEN 'extended' END AS swing_tier FROM s""")
def tiers(spark, d):
    return show(ST.swings(bars(spark, d, "15m"), 2, 2), ["swing_equal_high", "swing_equal_low", "swing_tier"])


_BREAK = ["bos_up", "bos_down", "choch_up", "choch_down", "bos_flag", "choch_flag", "broken_level", "bias"]


@query("W17_structure_breaks", with_bars("1h") + ", " + q.swings("b_1h", "s", 3, 3) + ", " + q.breaks("s", "k")
       + f"\nSELECT asset, t, {', '.join(_BREAK)} FROM k")
def breaks(spark, d):
    return show(ST.structure_breaks(ST.swings(bars(spark, d, "1h"), 3, 3)), _BREAK)


@query("W17_structure_breaks_confirmed", with_bars("1h") + ", " + q.swings("b_1h", "s", 3, 3) + ", "
       + q.breaks("s", "k", 3) + f"\nSELECT asset, t, {', '.join(_BREAK)} FROM k")
def breaks_confirmed(spark, d):
    return show(ST.structure_breaks(ST.swings(bars(spark, d, "1h"), 3, 3), confirmed_after=3), _BREAK)


def _gap_sql(start: int) -> str:
    shift = 1 - start
    return with_bars("1h") + ", " + q.gap_life("b_1h", "g", start) + f""",
op AS (SELECT r.asset, r.i, count(*) FILTER (g.dir = 1) AS up, count(*) FILTER (g.dir = -1) AS dn, max(g.born) AS nb
  FROM b_1h r JOIN g ON g.asset = r.asset AND g.born <= r.i AND (g.died IS NULL OR g.died > r.i) GROUP BY 1, 2),
en AS (SELECT asset, died AS i, max(touched) AS tc, max(1 - touched) AS br FROM g WHERE died IS NOT NULL GROUP BY 1, 2),
cx AS (SELECT r.asset, r.i, max_by(g, g.born) AS g FROM b_1h r JOIN g ON g.asset = r.asset AND g.born <= r.i GROUP BY 1, 2)
SELECT r.asset, r.t, r.g_up AS fvg_up, r.g_dn AS fvg_down,
  CASE WHEN g_up = 1 THEN l2 WHEN g_dn = 1 THEN l END AS fvg_gap_top,
  CASE WHEN g_up = 1 THEN h WHEN g_dn = 1 THEN h2 END AS fvg_gap_bottom,
  coalesce(tc, 0) AS fvg_touch_flag, coalesce(br, 0) AS fvg_is_broken, CASE WHEN br = 1 THEN c END AS fvg_broken_level,
  coalesce(up, 0) AS fvg_open_up, coalesce(dn, 0) AS fvg_open_down, r.i - nb + {shift} AS fvg_age,
  coalesce(cx.g.dir, 0) AS fvg_ctx_dir, r.i - cx.g.born AS fvg_ctx_age,
  round(CASE WHEN cx.g IS NULL OR (cx.g.beyond = 1 AND cx.g.died <= r.i) THEN 0.0 ELSE exp(-(r.i - cx.g.born) / 8.0) END, 6) AS fvg_ctx_weight,
  CASE WHEN r.i - cx.g.born <= 8 THEN 1 ELSE 0 END AS fvg_ctx_fresh, CASE WHEN r.i - cx.g.born > 24 THEN 1 ELSE 0 END AS fvg_ctx_stale,
  round(cx.g.top - c, 6) AS fvg_ctx_dist_top, round(cx.g.bottom - c, 6) AS fvg_ctx_dist_bot
FROM g_r r LEFT JOIN op USING (asset, i) LEFT JOIN en USING (asset, i) LEFT JOIN cx USING (asset, i)"""


_GAP = ["fvg_up", "fvg_down", "fvg_gap_top", "fvg_gap_bottom", "fvg_touch_flag", "fvg_is_broken", "fvg_broken_level",
        "fvg_open_up", "fvg_open_down", "fvg_age", "fvg_ctx_dir", "fvg_ctx_age", "fvg_ctx_weight", "fvg_ctx_fresh",
        "fvg_ctx_stale", "fvg_ctx_dist_top", "fvg_ctx_dist_bot"]


@query("W18_gaps", _gap_sql(1))
def gaps(spark, d):
    return show(ST.gaps(bars(spark, d, "1h")), _GAP)


@query("W18_gaps_from_birth_bar", _gap_sql(0))
def gaps_birth(spark, d):
    return show(ST.gaps(bars(spark, d, "1h"), include_birth_bar=True), _GAP)


_SWEEP = ["sweep_high", "sweep_low", "swept_level", "sweep_strength", "displacement_hint", "sweep_flag", "sweep_dir"]


@query("W19_sweeps", with_bars("15m") + ", " + q.sweeps("b_15m", "w") + """
SELECT asset, t, sweep_high, sweep_low, swept_level, round(sweep_strength, 6) AS sweep_strength,
  round(displacement_hint, 6) AS displacement_hint, sweep_flag, sweep_dir FROM w""")
def sweeps(spark, d):
    return show(ST.sweeps(bars(spark, d, "15m")), _SWEEP)


@query("W20_zone_births", with_bars("1h") + ", " + q.zone_life("b_1h", "z") + """
SELECT r.asset, r.t, max(CASE WHEN side = 'demand' THEN 1 ELSE 0 END) AS demand_born,
  max(CASE WHEN side = 'supply' THEN 1 ELSE 0 END) AS supply_born, round(max(q), 6) AS zone_quality
FROM b_1h r LEFT JOIN z_n z ON z.asset = r.asset AND z.born = r.i GROUP BY 1, 2""")
def zone_births(spark, d):
    return show(ST.zone_births(bars(spark, d, "1h")), ["demand_born", "supply_born", "zone_quality"])


_BEST = [f"{s}_{c}" for s in ("demand", "supply") for c in ("top", "bottom", "quality", "age", "touched")]


@query("W21_best_zone", with_bars("1h") + ", " + q.zone_life("b_1h", "z") + "\nSELECT asset, t, " + ", ".join(
    f"round({c}, 6) AS {c}" if c.endswith("quality") else c for c in _BEST) + " FROM z")
def best_zone(spark, d):
    return show(ST.zones(bars(spark, d, "1h")), _BEST)


@query("W22_zone_choice", with_bars("1h") + ", " + q.zone_life("b_1h", "z") + ", " + q.zone_choice("z", "y") + """
SELECT asset, t, zone_id, zone_hi, zone_lo, round(zone_recency, 6) AS zone_recency,
  round(zone_displacement, 6) AS zone_displacement, CAST(round(zone_mitigation, 6) AS DOUBLE) AS zone_mitigation FROM y""")
def zone_choice(spark, d):
    return show(ST.zones(bars(spark, d, "1h")), ["zone_id", "zone_hi", "zone_lo", "zone_recency", "zone_displacement",
                                                 "zone_mitigation"])


_CTX_SQL = (q.swings("b_6h", "s", 3, 3) + ", " + q.breaks("s", "k") + ", " + q.zone_life("k", "z") + ", "
            + q.zone_choice("z", "y") + f""",
c0 AS (SELECT *, {q.roll('max', 'h', 150, 5)} AS xh, {q.roll('min', 'l', 150, 5)} AS xl, {q.div('h - l', 'c')} AS rg FROM y),
c1 AS (SELECT *, {q.roll('avg', 'rg', 20, 5)} AS mr, CASE WHEN xh - xl > 0 THEN (c - xl) / (xh - xl) END AS pos FROM c0),
c2 AS (SELECT *, coalesce({q.div(q.lag('mr', 5) + ' - mr', q.lag('mr', 5))}, 0) AS dp FROM c1),
ctx AS (SELECT asset, t, CASE WHEN bos_up = 1 AND choch_down = 0 THEN 'UP' WHEN bos_down = 1 AND choch_up = 0 THEN 'DOWN' ELSE bias END AS structural_bias_6h,
  CASE WHEN pos <= 0.5 THEN 'DISCOUNT' WHEN pos >= 0.65 THEN 'PREMIUM' ELSE 'MID' END AS pd_context_6h,
  CASE WHEN rg <= 0.18 AND dp >= 0.35 THEN 1 ELSE 0 END AS compression_6h,
  round(0.35 * nullif(zone_recency, 0) + 0.30 * zone_displacement + 0.20 * zone_mitigation + 0.075, 6) AS zone_score_6h FROM c2)""")


def _context(spark, d):
    b = bars(spark, d, "6h")
    return X.structure_context(ST.zones(ST.structure_breaks(ST.swings(b, 3, 3))))


_CTX = ["structural_bias_6h", "pd_context_6h", "compression_6h", "zone_score_6h"]


@query("W23_structure_context", with_bars("6h") + ", " + _CTX_SQL + f"\nSELECT asset, t, {', '.join(_CTX)} FROM ctx")
def structure_context(spark, d):
    return show(_context(spark, d), _CTX)


@query("J2_structure_context_on_spine", with_bars("15m", "6h") + ", " + _CTX_SQL + f"""
SELECT s.asset, s.t, s.c AS close, {', '.join(f'x.{c}' for c in _CTX)} FROM b_15m s
ASOF LEFT JOIN ctx x ON x.asset = s.asset AND x.t <= s.t""")
def context_on_spine(spark, d):
    ctx = pin(_context(spark, d).select("asset", "bar_close", *_CTX))
    return show(asof(bars(spark, d, "15m"), ctx), ["close", *_CTX])


_LEAN = ["bos_flag", "choch_flag", "bias", "sweep_flag", "zone_id", "zone_hi", "zone_lo", "demand_quality",
         "supply_quality", "demand_age", "supply_age"]


@query("P6_lean_context_columns", with_bars("1h") + ", " + q.swings("b_1h", "s", 3, 3) + ", " + q.breaks("s", "k") + ", "
       + q.sweeps("k", "w") + ", " + q.zone_life("w", "z") + ", " + q.zone_choice("z", "y") + """
SELECT asset, t, """ + ", ".join(f"round({c}, 6) AS {c}" if "quality" in c else c for c in _LEAN) + " FROM y")
def lean(spark, d):
    full = ST.zones(ST.structure_block(bars(spark, d, "1h"), 3, 3))
    return show(full.select("asset", "bar_close", *_LEAN), _LEAN)


def _audit(tf):
    n = ST.PIVOTS[tf]
    k = f"_{tf}"
    return ", ".join([q.swings(f"b_{tf}", "s" + k, n, n), q.breaks("s" + k, "k" + k), q.sweeps("k" + k, "w" + k)])


@query("U1_structure_audit", with_bars("1h", "6h", "12h") + ", " + ", ".join(_audit(tf) for tf in ("1h", "6h", "12h"))
       + " " + " UNION ALL ".join(
    f"SELECT asset, '{tf}' AS tf, t, bos_flag, choch_flag, bias, sweep_flag FROM w_{tf}" for tf in ("1h", "6h", "12h")))
def audit(spark, d):
    out = None
    for tf in ("1h", "6h", "12h"):
        n = ST.PIVOTS[tf]
        x = ST.structure_block(bars(spark, d, tf), n, n).select(
            "asset", "tf", "bar_close", "bos_flag", "choch_flag", "bias", "sweep_flag")
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out.select("asset", "tf", epoch().alias("t"), "bos_flag", "choch_flag", "bias", "sweep_flag")


@query("J3_detector_join", with_bars("15m") + ", " + q.sweeps("b_15m", "w") + """
SELECT b.asset, b.t, b.c AS close, w.sweep_flag, w.sweep_dir FROM b_15m b LEFT JOIN w ON w.asset = b.asset AND w.t = b.t""")
def detector_join(spark, d):
    # detectors add their columns in place; joining a stored detector result back is a plain equi join
    b = bars(spark, d, "15m")
    found = pin(ST.sweeps(b).select("asset", "bar_close", "sweep_flag", "sweep_dir"))
    return show(b.join(found, ["asset", "bar_close"], "left"), ["close", "sweep_flag", "sweep_dir"])


@query("U5_merged_timeline", with_bars("15m") + "\nSELECT DISTINCT t FROM b_15m")
def timeline(spark, d):
    return bars(spark, d, "15m").select(epoch().alias("t")).distinct()


@query("J8_bar_index_of_event", with_bars("15m") + """
SELECT e.event_id, b.i AS bar_index FROM events e
LEFT JOIN b_15m b ON b.asset = e.event_type AND b.t = (epoch_us(e.ts) // 900000000) * 900 + 900""")
def bar_index(spark, d):
    from tickloom.plans.market import trades
    from tickloom.operators.rollup import floor_time

    b = bars(spark, d, "15m").select("asset", F.col("bar_open").alias("at"), F.col("row_idx").alias("bar_index"))
    t = trades(spark, d).select(F.col("seq").alias("event_id"), "asset", floor_time("ts", 900).alias("at"))
    return t.join(b, ["asset", "at"], "left").select("event_id", "bar_index")
