"""Rolling, exponential, liquidity, regime and session features on bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.rolling import crossed_above, crossed_below
from tickloom.functions.sessions import day_masks, session_columns
from tickloom.operators import features as X
from tickloom.operators import rollup as R
from tickloom.operators import sessions as S
from tickloom.operators import structure as ST
from tickloom.operators.series import framed
from tickloom.plans import sqltext as q
from tickloom.plans.market import bars, epoch, r6, with_bars
from tickloom.plans.registry import query


def show(df, cols, n=6):
    """asset, bar close as epoch seconds, and the named columns with doubles rounded."""
    kinds = dict(df.dtypes)
    return df.select(
        "asset", epoch().alias("t"),
        *[F.round(c, n).alias(c) if kinds[c] in ("double", "float") else
          (F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint") else F.col(c)) for c in cols],
    )


def sql_show(cols, rel):
    return f"SELECT asset, t, {q.rounded(*cols)} FROM {rel}"


@query("W1_lags", with_bars("1h") + f"""
SELECT asset, t, {', '.join(f"lag({c}, {n}) OVER {q.W} AS {name}_lag{n}" for c, name in (('c', 'close'), ('v', 'volume')) for n in (1, 2, 4))}
FROM b_1h""")
def lags(spark, d):
    out = X.lags(bars(spark, d, "1h"), ["close", "volume"], [1, 2, 4])
    return show(out, [f"{c}_lag{n}" for c in ("close", "volume") for n in (1, 2, 4)])


_ROLL = [(f, n) for n in (4, 16) for f in ("mean", "std", "min", "max")]


@query("W2_rolling_stats", with_bars("1h") + "\nSELECT asset, t, " + ", ".join(
    f"round({q.roll({'mean': 'avg', 'std': 'stddev_samp'}.get(f, f), 'c', n)}, 6) AS close_r{f}{n}" for f, n in _ROLL)
    + " FROM b_1h")
def rolling_stats(spark, d):
    return show(X.rolling_stats(bars(spark, d, "1h"), ["close"], [4, 16]), [f"close_r{f}{n}" for f, n in _ROLL])


@query("W3_rolling_zscores", with_bars("1h") + f"""
SELECT asset, t, round({q.zscore('c', 20)}, 6) AS close_z20,
  round(coalesce({q.zscore('c', 20, std='stddev_pop')}, 0), 6) AS close_zpop20,
  round(coalesce({q.zscore('c', 20, 2, 'stddev_pop')}, 0), 6) AS close_zlive20 FROM b_1h""")
def zscores(spark, d):
    return show(X.zscores(bars(spark, d, "1h"), "close", 20), ["close_z20", "close_zpop20", "close_zlive20"])


@query("W4_rolling_quantile", with_bars("1h") + f"""
SELECT asset, t, round({q.roll('quantile_cont($x, 0.05)', 'c', 40)}, 6) AS close_q5,
  round({q.roll('quantile_cont($x, 0.95)', 'c', 40)}, 6) AS close_q95 FROM b_1h""")
def quantiles(spark, d):
    return show(X.quantiles(bars(spark, d, "1h"), "close", 40, (0.05, 0.95)), ["close_q5", "close_q95"])


@query("W5_ema", with_bars("1h") + ", " + q.ema("b_1h", "c", {"ema_8": 8, "ema_50": 50}, "e") + f"""
SELECT asset, t, round(ema_8, 6) AS ema_8, round(ema_50, 6) AS ema_50,
  round({q.div('ema_8 - ' + q.lag('ema_8'), q.lag('ema_8'))}, 6) AS ema_8_slope,
  round(ema_50 - {q.lag('ema_50')}, 6) AS ema_50_diff FROM e""")
def ema(spark, d):
    out = X.ema(bars(spark, d, "1h"), {"ema_8": 8.0, "ema_50": 50.0})

    def build(rows, w):
        return rows.withColumns({"ema_8_slope": X.pct_change("ema_8", w),
                                 "ema_50_diff": F.col("ema_50") - F.lag("ema_50").over(w)})

    return show(framed(out, build, back=1), ["ema_8", "ema_50", "ema_8_slope", "ema_50_diff"])


@query("W6_true_range_atr", with_bars("1h") + ", " + q.true_range("b_1h", "a") + "\n" + sql_show(
    ["tr", "atr", "atr_early"], "a").replace("round(tr, 6) AS tr", "round(tr, 6) AS true_range"))
def atr(spark, d):
    return show(X.atr(bars(spark, d, "1h")), ["true_range", "atr", "atr_early"])


_VOL_LAGS = [f"{c}_lag{n}" for c in X.VOLATILITY for n in (1, 3)]


@query("W7_volatility_block", with_bars("1h") + ", " + q.volatility("b_1h", "v") + "\nSELECT asset, t, " + q.rounded(
    *X.VOLATILITY) + ", " + ", ".join(f"round({q.lag(c, n)}, 6) AS {c}_lag{n}" for c in X.VOLATILITY for n in (1, 3))
    + " FROM v")
def volatility(spark, d):
    return show(X.volatility(bars(spark, d, "1h")), [*X.VOLATILITY, *_VOL_LAGS])


@query("W8_ema_block", with_bars("1h") + ", " + q.true_range("b_1h", "a") + ", " + q.ema(
    "a", "c", {"ema_21": 21, "ema_55": 55}, "e") + ", " + "s AS (SELECT *, " + ", ".join(
    f"coalesce({q.div(f'ema_{p} - ' + q.lag(f'ema_{p}'), q.lag(f'ema_{p}'))}, 0) AS ema_slope_{p}, "
    f"{q.div(f'c - ema_{p}', 'atr_early')} AS dist_ema_{p}, CASE WHEN c < ema_{p} - 1.5 * atr_early THEN -1.0 "
    f"WHEN c > ema_{p} + 1.5 * atr_early THEN 1.0 ELSE 0.0 END AS band_regime_{p}" for p in (21, 55)) + " FROM e)\n"
    "SELECT asset, t, " + ", ".join(
    f"{q.rounded(f'ema_{p}', f'ema_slope_{p}', f'dist_ema_{p}')}, CAST(band_regime_{p} AS DOUBLE) AS band_regime_{p}, "
    f"round({q.zscore(f'dist_ema_{p}', 200, 10)}, 6) AS z_dist_ema_{p}" for p in (21, 55)) +
    f", CAST(sign(ema_21 - ema_55) AS BIGINT) AS ema_alignment, round({q.div('ema_21 - ema_55', 'ema_55')}, 6) AS ema_rel FROM s")
def ema_block(spark, d):
    cols = [f"{c}_{p}" for p in (21, 55) for c in ("ema", "ema_slope", "dist_ema", "z_dist_ema", "band_regime")]
    return show(X.ema_block(bars(spark, d, "1h"), (21, 55)), [*cols, "ema_alignment", "ema_rel"])


@query("W8_band_flags", with_bars("1h") + f""", s AS (SELECT *, {q.roll('avg', 'c', 20)} AS m, {q.roll('stddev_samp', 'c', 20)} AS sd FROM b_1h)
SELECT asset, t, CASE WHEN c >= m - sd AND c <= m + sd THEN 1 ELSE 0 END AS close_inband,
  CASE WHEN c > m + sd THEN 1 ELSE 0 END AS close_aboveband, CASE WHEN c < m - sd THEN 1 ELSE 0 END AS close_belowband
FROM s""")
def band_flags(spark, d):
    out = X.rolling_stats(bars(spark, d, "1h"), ["close"], [20])
    mean, sd = F.col("close_rmean20"), F.col("close_rstd20")
    return show(X.band_flags(out, "close", mean + sd, mean - sd), ["close_inband", "close_aboveband", "close_belowband"])


@query("W9_crosses", with_bars("1h") + f""", s AS (SELECT *, {q.roll('avg', 'c', 4)} AS f, {q.roll('avg', 'c', 16)} AS g FROM b_1h)
SELECT asset, t, CASE WHEN f > g AND {q.lag('f')} <= {q.lag('g')} THEN 1 ELSE 0 END AS above,
  CASE WHEN f < g AND {q.lag('f')} >= {q.lag('g')} THEN 1 ELSE 0 END AS below FROM s""")
def crosses(spark, d):
    out = X.rolling_stats(bars(spark, d, "1h"), ["close"], [4, 16])

    def build(rows, w):
        return rows.withColumns({"above": crossed_above("close_rmean4", "close_rmean16", w).cast("int"),
                                 "below": crossed_below("close_rmean4", "close_rmean16", w).cast("int")})

    return show(framed(out, build, back=1), ["above", "below"])


def _absorb_sql():
    def band(x, qq):
        fn = f"quantile_cont($x, {qq})"
        so_far = "OVER (PARTITION BY asset ORDER BY i)"
        return f"coalesce({q.roll(fn, x, 128, 32)}, CASE WHEN {x} IS NOT NULL AND count({x}) {so_far} >= 4 THEN {fn.replace('$x', x)} {so_far} END)"

    return with_bars("15m") + f""",
a0 AS (SELECT *, abs(c - o) AS bd, dv / CASE WHEN h = l THEN 1e-9 ELSE h - l END AS dn FROM b_15m),
a1 AS (SELECT *, {q.div(q.roll('sum', 'bd', 4), q.roll('sum', 'dv', 4))} AS pg, {q.roll('quantile_cont($x, 0.5)', 'dn', 4)} AS cl
  FROM a0),
a2 AS (SELECT *, {band('pg', 0.05)} AS p0, {band('pg', 0.95)} AS p1, coalesce({band('cl', 0.05)}, 0) AS c0,
  {band('cl', 0.95)} AS c1 FROM a1),
a3 AS (SELECT *, 1 - greatest(0, least(1, (pg - p0) / (coalesce(nullif(p1, 0), CASE WHEN p1 = 0 THEN 1e-9 END) - p0 + 1e-12))) AS slow0,
  greatest(0, least(1, (cl - c0) / (coalesce(nullif(c1, 0), CASE WHEN c1 = 0 THEN 1e-9 END) - c0 + 1e-12))) AS dense0 FROM a2),
a4 AS (SELECT *, CASE WHEN pg IS NULL OR p0 IS NULL OR p1 IS NULL THEN NULL ELSE slow0 END AS slow,
  CASE WHEN cl IS NULL OR c1 IS NULL THEN NULL ELSE dense0 END AS dense FROM a3)
SELECT asset, t, round(coalesce(CASE WHEN slow IS NOT NULL AND dense IS NOT NULL THEN
    greatest(0, least(1, 0.6 * slow + 0.4 * dense)) END, 0), 6) AS absorption_score,
  CASE WHEN dense > 0.65 THEN 1 ELSE 0 END AS absorption_near_entry,
  CASE WHEN slow > 0.65 THEN 1 ELSE 0 END AS absorption_near_stop FROM a4"""


@query("W10_absorption", _absorb_sql())
def absorption(spark, d):
    return show(X.absorption(bars(spark, d, "15m")), ["absorption_score", "absorption_near_entry", "absorption_near_stop"])


def _mode(x, n, minp):
    return q.roll("list_max(map_values(histogram($x)", x, n, minp).replace(f" OVER {q.frame(n)} END", f" OVER {q.frame(n)})) END")


@query("W11_liquidity_block", with_bars("1h") + f""",
l0 AS (SELECT *, round_even(h * 100, 0) / 100 AS h2, round_even(l * 100, 0) / 100 AS l2, round_even((h + l) / 2 * 100, 0) / 100 AS m2,
  (h - greatest(o, c)) - (least(o, c) - l) AS wk, {q.roll('max', 'h', 3, 2, 1)} AS h3, {q.roll('min', 'l', 3, 2, 1)} AS l3,
  {q.roll('max', 'h', 50, 50, 1)} AS ph, {q.roll('min', 'l', 50, 50, 1)} AS pl FROM b_1h),
l1 AS (SELECT *, coalesce({_mode('h2', 50, 2)}, 0) AS eh, coalesce({_mode('l2', 50, 2)}, 0) AS el, {_mode('m2', 60, 4)} AS lv
  FROM l0),
l2 AS (SELECT *, CAST(greatest(eh, el) AS DOUBLE) AS liq_eql_density, {q.zscore('lv', 60, 4)} AS liq_density,
  {q.zscore('wk', 14, 3)} AS liq_wick_pressure, {q.div('abs(wk)', 'h - l')} AS liq_displacement_ratio,
  {q.div('v - ' + q.lag('v'), q.lag('v'))} AS liq_volume_pressure,
  CASE WHEN h > h3 OR l < l3 THEN 1 ELSE 0 END AS liq_sweep, greatest(h - h3, l3 - l, 0) AS liq_sweep_strength,
  least(abs(c - ph), abs(c - pl)) AS liq_near_pool_dist FROM l1)
SELECT asset, t, {q.rounded('liq_eql_density', 'liq_density', 'liq_wick_pressure', 'liq_displacement_ratio',
    'liq_volume_pressure', 'liq_sweep_strength', 'liq_near_pool_dist')}, liq_sweep,
  round({q.lag('liq_density', 2)}, 6) AS liq_density_lag2 FROM l2""")
def liquidity(spark, d):
    cols = ["liq_eql_density", "liq_density", "liq_wick_pressure", "liq_displacement_ratio", "liq_volume_pressure",
            "liq_sweep_strength", "liq_near_pool_dist", "liq_sweep", "liq_density_lag2"]
    return show(X.liquidity(bars(spark, d, "1h")), cols)


@query("W12_pivot_pool_distance", with_bars("15m") + ", " + q.swings("b_15m", "s", 2, 2) + """,
lv AS (SELECT asset, i, h AS level FROM s WHERE swing_equal_high = 1 UNION ALL
       SELECT asset, i, l FROM s WHERE swing_equal_low = 1)
SELECT s.asset, s.t, round(coalesce(min(abs(lv.level - (s.h + s.l) / 2)), 0), 6) AS pool_distance
FROM s LEFT JOIN lv ON lv.asset = s.asset AND lv.i BETWEEN s.i - 50 AND s.i + 50 GROUP BY s.asset, s.t""")
def pool_distance(spark, d):
    return show(X.pivot_pool_distance(ST.swings(bars(spark, d, "15m"), 2, 2)), ["pool_distance"])


_REG = f"""r0 AS (SELECT *, abs(vol_zscore) AS av, CASE WHEN c > {q.lag('c')} THEN 1 ELSE 0 END AS up, h - l AS hl,
  abs({q.div('(h - l) - ' + q.lag('h - l'), q.lag('h - l'))}) AS dr FROM v),
r1 AS (SELECT *, av + dr AS tx, {q.roll('avg', 'hl', 30)} AS mr, list(av) FILTER (av IS NOT NULL) OVER {q.frame(200)} AS ls,
  count(av) OVER {q.frame(200)} AS na FROM r0),
r2 AS (SELECT *, CASE WHEN na >= 200 AND av IS NOT NULL THEN (len(list_filter(ls, lambda x: x < av)) +
    (len(list_filter(ls, lambda x: x = av)) + 1) / 2.0) / len(ls) END AS vol_pct,
  {q.roll('avg', 'up', 50)} AS trend_persist, {q.div('hl - mr', 'mr')} AS compression_12h,
  {q.roll('avg', 'tx', 30)} AS toxicity_12h FROM r1)"""


@query("W13_regime_inputs", with_bars("1h") + ", " + q.volatility("b_1h", "v") + ", " + _REG + f"""
SELECT asset, t, {q.rounded('vol_pct', 'trend_persist', 'compression_12h', 'toxicity_12h')},
  round({q.lag('vol_pct')}, 6) AS vol_pct_lag1 FROM r2""")
def regime_inputs(spark, d):
    out = X.regime_inputs(X.volatility(bars(spark, d, "1h"), with_lags=False))
    return show(out, ["vol_pct", "trend_persist", "compression_12h", "toxicity_12h", "vol_pct_lag1"])


@query("W14_regime_probabilities", with_bars("1h") + ", " + q.volatility("b_1h", "v") + ", " + _REG + """,
p0 AS (SELECT *, CASE WHEN trend_persist IS NULL THEN NULL ELSE least(1, greatest(0, trend_persist)) END AS tp,
  CASE WHEN vol_pct IS NULL THEN NULL ELSE least(1, greatest(0, vol_pct)) END AS vp,
  CASE WHEN compression_12h < -0.05 THEN 0.5 ELSE 0 END + coalesce(greatest(toxicity_12h, 0), 0) * 0.1 AS cp,
  CASE WHEN compression_12h IS NULL THEN NULL ELSE 1 + abs(least(compression_12h, 0)) END AS rp FROM r2),
p1 AS (SELECT *, vp * (1 - tp) AS ep, tp + vp * (1 - tp) + cp + rp AS tot FROM p0),
p2 AS (SELECT *, coalesce(tp / tot, 0.25) AS p_regime_trend, coalesce(rp / tot, 0.25) AS p_regime_range,
  coalesce(ep / tot, 0.25) AS p_regime_expansion, coalesce(cp / tot, 0.25) AS p_regime_collapse FROM p1)
SELECT asset, t, """ + q.rounded("p_regime_trend", "p_regime_range", "p_regime_expansion", "p_regime_collapse") + """,
  CASE greatest(p_regime_trend, p_regime_range, p_regime_expansion, p_regime_collapse) WHEN p_regime_trend THEN 'trend'
  WHEN p_regime_range THEN 'range' WHEN p_regime_expansion THEN 'expansion' ELSE 'collapse' END AS regime_state FROM p2""")
def regime_probabilities(spark, d):
    out = X.regime_probabilities(X.regime_inputs(X.volatility(bars(spark, d, "1h"), with_lags=False)))
    return show(out, ["p_regime_trend", "p_regime_range", "p_regime_expansion", "p_regime_collapse", "regime_state"])


_FLOW = f"""f0 AS (SELECT *, coalesce({q.div('h - l', 'c')}, 0) AS rp, coalesce({q.div('abs(c - o)', 'h - l')}, 0) AS bp,
  coalesce(least(1, greatest(0, {q.div('c - l', 'h - l')})), 0.5) AS cl0, sign(c - o) AS bd,
  coalesce({q.div('c - ' + q.lag('c'), q.lag('c'))}, 0) AS rt FROM b_1h),
f1 AS (SELECT *, CASE WHEN h = l THEN 0.5 ELSE cl0 END AS cl, coalesce({q.zscore('v', 48, 12)}, 0) AS vz,
  coalesce({q.zscore('rp', 48, 12)}, 0) AS rz FROM f0),
f2 AS (SELECT *, CASE WHEN bp >= 0.6 AND vz >= 0.8 AND bd > 0 AND cl >= 0.65 THEN 1
  WHEN bp >= 0.6 AND vz >= 0.8 AND bd < 0 AND cl <= 0.35 THEN -1 ELSE 0 END AS sg FROM f1),
f3 AS (SELECT *, coalesce(i - last_value(CASE WHEN sg <> 0 THEN i END IGNORE NULLS) OVER {q.SO_FAR}, 999) AS ag FROM f2),
flow AS (SELECT *, CASE WHEN sg <> 0 OR ag <= 4 THEN 1 ELSE 0 END AS ok1, least(1, greatest(0, 0.55 * least(1, greatest(0, bp))
  + 0.25 * least(3, greatest(-1, vz)) / 3 + 0.20 * least(3, greatest(-1, rz)) / 3)) AS st FROM f3)"""


@query("W24_flow_block", with_bars("1h") + ", " + _FLOW + """
SELECT asset, t, round(bp, 6) AS flow_body_pct, round(cl, 6) AS flow_close_loc, CAST(bd AS BIGINT) AS flow_body_dir,
  round(rt, 6) AS flow_ret, round(rp, 6) AS flow_range_pct, round(rz, 6) AS flow_range_z, round(vz, 6) AS flow_volume_z,
  sg AS flow_signal, ok1 AS flow_ok, round(st, 6) AS flow_strength FROM flow""")
def flow_block(spark, d):
    return show(X.flow_block(bars(spark, d, "1h")), [
        "flow_body_pct", "flow_close_loc", "flow_body_dir", "flow_ret", "flow_range_pct", "flow_range_z",
        "flow_volume_z", "flow_signal", "flow_ok", "flow_strength"])


@query("W25_bars_since_event", with_bars("1h") + ", " + _FLOW + "\nSELECT asset, t, ag AS flow_age_bars FROM flow")
def bars_since(spark, d):
    return show(X.flow_block(bars(spark, d, "1h")), ["flow_age_bars"])


@query("W43_event_lags", with_bars("1h") + ", " + q.sweeps("b_1h", "w") + f"""
SELECT asset, t, coalesce({q.lag('sweep_flag')}, 0) AS sweep_flag_lag1 FROM w""")
def event_lags(spark, d):
    return show(X.event_lags(ST.sweeps(bars(spark, d, "1h")), ["sweep_flag"]), ["sweep_flag_lag1"])


@query("W44_cluster_inputs", with_bars("1h") + f""",
k0 AS (SELECT *, ln({q.div('c', q.lag('c'))}) AS lr, h - l AS hl FROM b_1h)
SELECT asset, t, round(coalesce(lr, 0), 6) AS log_ret, round(coalesce({q.div('h - l', 'c')}, 0), 6) AS bar_range_pct,
  round(coalesce(ln(nullif(v, 0)), 0), 6) AS log_vol, round(coalesce(ln(nullif(c * v, 0)), 0), 6) AS dollar_vol_log,
  round(coalesce(CASE WHEN count(hl) OVER {q.frame(48)} >= 10 THEN (hl - avg(hl) OVER {q.frame(48)}) /
    (stddev_samp(hl) OVER {q.frame(48)} + 1e-9) END, 0), 6) AS range_z,
  round(coalesce(CASE WHEN count(v) OVER {q.frame(48)} >= 10 THEN (v - avg(v) OVER {q.frame(48)}) /
    (stddev_samp(v) OVER {q.frame(48)} + 1e-9) END, 0), 6) AS vol_z,
  round({q.roll('stddev_samp', 'lr', 64, 32)}, 6) AS hmm_realized_vol FROM k0""")
def cluster_inputs(spark, d):
    return show(X.cluster_inputs(bars(spark, d, "1h")), [
        "log_ret", "bar_range_pct", "log_vol", "dollar_vol_log", "range_z", "vol_z", "hmm_realized_vol"])


@query("W45_return_zscores", with_bars("1h") + f""",
k0 AS (SELECT *, {q.div('c - ' + q.lag('c'), q.lag('c'))} AS ret FROM b_1h),
k1 AS (SELECT *, {q.zscore('ret', 100)} AS ret_z, {q.roll('stddev_samp', 'ret', 100)} AS vol FROM k0),
k2 AS (SELECT *, {q.zscore('vol', 100)} AS vol_z FROM k1)
SELECT asset, t, {q.rounded('ret', 'ret_z', 'vol', 'vol_z')} FROM k2 WHERE vol_z IS NOT NULL AND ret_z IS NOT NULL
  AND ret IS NOT NULL AND vol IS NOT NULL""")
def return_zscores(spark, d):
    return show(X.return_zscores(bars(spark, d, "1h"), 100), ["ret", "ret_z", "vol", "vol_z"])


@query("F22_candle_helpers", with_bars("1h") + ", " + q.sweeps("b_1h", "w") + f"""
SELECT asset, t, round(abs(c - o) / CASE WHEN h = l THEN 1e-9 ELSE h - l END, 6) AS body_pct,
  round(coalesce({q.div('(h - greatest(o, c)) - (least(o, c) - l)', 'h - l')}, 0), 6) AS wick_asymmetry,
  CASE WHEN abs(c - o) / CASE WHEN h = l THEN 1e-9 ELSE h - l END >= 0.55 THEN 1 ELSE 0 END AS displacement,
  round(c * v, 4) AS traded_value, sweep_flag AS fresh_retest FROM w""")
def candle_helpers(spark, d):
    out = X.candle_helpers(ST.sweeps(bars(spark, d, "1h"))).withColumn("traded_value", r6("traded_value", 4))
    return show(out, ["body_pct", "wick_asymmetry", "displacement", "traded_value", "fresh_retest"])


# the driver data lie in January, when Europe/Berlin is one hour ahead of UTC throughout
_LOCAL = "((t + 3600) % 86400) // 60"
SESSION_SQL = f"""ss0 AS (SELECT *, {_LOCAL} AS m, (t + 3600) // 86400 AS ld FROM b_15m),
ss1 AS (SELECT *, m >= 480 AND m < 1020 AS lon, m >= 870 AND m < 1260 AS ny FROM ss0),
ss2 AS (SELECT *, lon AND ny AS ov, (NOT lon AND 480 - m BETWEEN 0 AND 60) OR (NOT ny AND 870 - m BETWEEN 0 AND 60) AS pre,
  (lon AND m - 480 BETWEEN 0 AND 120) OR (ny AND m - 870 BETWEEN 0 AND 90) AS ex FROM ss1),
ss AS (SELECT *, CASE WHEN ov THEN 'overlap' WHEN lon THEN 'london' WHEN ny THEN 'ny' ELSE 'off_hours' END AS session_name,
  CASE WHEN ov THEN 'overlap' WHEN ex THEN 'expansion' WHEN pre THEN 'pre_expansion' ELSE 'dead_zone' END AS session_bucket
  FROM ss2)"""


@query("F3_session_classes", with_bars("15m") + ", " + SESSION_SQL + """
SELECT asset, t, session_name, session_bucket,
  CASE session_bucket WHEN 'overlap' THEN 3 WHEN 'expansion' THEN 2 WHEN 'pre_expansion' THEN 1 ELSE 0 END AS session_bucket_id,
  CAST(CASE session_bucket WHEN 'overlap' THEN 1.15 WHEN 'expansion' THEN 1.05 WHEN 'pre_expansion' THEN 0.95 ELSE 0.75 END AS DOUBLE) AS session_quality_multiplier,
  CAST(CASE session_name WHEN 'overlap' THEN 1.1 WHEN 'off_hours' THEN 0.2 ELSE 1.0 END AS DOUBLE) AS session_weight,
  CASE WHEN lon THEN m - 480 ELSE -1 END AS minutes_since_london_open,
  CASE WHEN ny THEN m - 870 ELSE -1 END AS minutes_since_ny_open,
  480 - m AS minutes_to_london_open, 870 - m AS minutes_to_ny_open,
  CASE WHEN ov THEN 1020 - m ELSE -1 END AS minutes_to_overlap_close FROM ss""")
def session_classes(spark, d):
    return show(session_columns(bars(spark, d, "15m")), [
        "session_name", "session_bucket", "session_bucket_id", "session_quality_multiplier", "session_weight",
        "minutes_since_london_open", "minutes_since_ny_open", "minutes_to_london_open", "minutes_to_ny_open",
        "minutes_to_overlap_close"])


@query("F4_session_masks", with_bars("15m") + f"""
SELECT asset, t, CASE WHEN {_LOCAL} < 480 THEN 1 ELSE 0 END AS in_asia,
  CASE WHEN {_LOCAL} BETWEEN 480 AND 1019 THEN 1 ELSE 0 END AS in_london,
  CASE WHEN {_LOCAL} BETWEEN 870 AND 1259 THEN 1 ELSE 0 END AS in_ny, (t + 3600) // 86400 AS session_day FROM b_15m""")
def session_masks(spark, d):
    out = bars(spark, d, "15m").withColumns(day_masks())
    return show(out.withColumn("session_day", F.unix_date("session_date").cast("long")),
                ["in_asia", "in_london", "in_ny", "session_day"])


def _bucket_pct(x):
    parts = " ".join(
        f"WHEN session_bucket = '{b}' THEN CASE WHEN count(CASE WHEN session_bucket = '{b}' THEN {x} END) OVER {q.frame(96)} >= 24 THEN "
        f"({x} - avg(CASE WHEN session_bucket = '{b}' THEN {x} END) OVER {q.frame(96)}) / "
        f"nullif(stddev_samp(CASE WHEN session_bucket = '{b}' THEN {x} END) OVER {q.frame(96)}, 0) END"
        for b in ("dead_zone", "pre_expansion", "expansion", "overlap"))
    return f"round(coalesce(1 / (1 + exp(-1.702 * CASE {parts} END)), 0.5), 6)"


@query("W26_session_percentiles", with_bars("15m") + ", " + SESSION_SQL + f""",
e AS (SELECT *, coalesce(v, 0) AS xv, {q.div('h - l', 'c')} AS xr,
  coalesce({q.div('(h - greatest(o, c)) - (least(o, c) - l)', 'h - l')}, 0) AS xw, h - l AS hl FROM ss),
e1 AS (SELECT *, coalesce(nullif({q.roll('avg', 'hl', 14, 2)}, 0), 0) AS xa FROM e)
SELECT asset, t, {_bucket_pct('xv')} AS session_volume_pct, {_bucket_pct('xr')} AS session_range_pct,
  {_bucket_pct('xw')} AS session_wick_asym_pct, {_bucket_pct('xa')} AS session_atr_pct FROM e1""")
def session_percentiles(spark, d):
    out = S.session_context(session_columns(bars(spark, d, "15m")))
    return show(out, ["session_volume_pct", "session_range_pct", "session_wick_asym_pct", "session_atr_pct"])


_DAY = "(PARTITION BY asset, ld ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("J7_asia_extremes", with_bars("15m") + ", " + SESSION_SQL + f"""
SELECT asset, t, max(CASE WHEN m < 480 THEN h END) OVER {_DAY} AS asia_high,
  min(CASE WHEN m < 480 THEN l END) OVER {_DAY} AS asia_low,
  max(CASE WHEN m < 480 THEN h END) OVER (PARTITION BY asset, ld) AS asia_high_full,
  min(CASE WHEN m < 480 THEN l END) OVER (PARTITION BY asset, ld) AS asia_low_full FROM ss""")
def asia_extremes(spark, d):
    full = S.asia_extremes(bars(spark, d, "15m"), full_day=True).withColumnsRenamed(
        {"asia_high": "asia_high_full", "asia_low": "asia_low_full"})
    return show(S.asia_extremes(full), ["asia_high", "asia_low", "asia_high_full", "asia_low_full"])


@query("W27_london_extremes", with_bars("15m") + ", " + SESSION_SQL + f""",
e AS (SELECT *, max(CASE WHEN lon THEN h END) OVER {_DAY} AS london_high, min(CASE WHEN lon THEN l END) OVER {_DAY} AS london_low,
  h - l AS hl FROM ss),
e1 AS (SELECT *, {q.roll('avg', 'hl', 14, 2)} AS an FROM e)
SELECT asset, t, london_high, london_low, round({q.div('c - london_high', 'an')}, 6) AS dist_to_london_high_atr,
  round({q.div('c - london_low', 'an')}, 6) AS dist_to_london_low_atr FROM e1""")
def london_extremes(spark, d):
    out = S.atr_distances(S.london_extremes(S.atr_norm(bars(spark, d, "15m"))), ("london_high", "london_low"))
    return show(out, ["london_high", "london_low", "dist_to_london_high_atr", "dist_to_london_low_atr"])


@query("W28_overlap_breakout", with_bars("15m") + ", " + SESSION_SQL + f""",
e AS (SELECT *, {q.roll('max', 'h', 16, 4, 1)} AS ph, {q.roll('min', 'l', 16, 4, 1)} AS pl, lag(ov, 1, false) OVER {q.W} AS pov FROM ss)
SELECT asset, t, CASE WHEN ov AND NOT pov AND (c >= ph OR c <= pl) THEN 1 ELSE 0 END AS breakout_after_overlap_start_flag FROM e""")
def overlap_breakout(spark, d):
    return show(S.overlap_breakout(session_columns(bars(spark, d, "15m"))), ["breakout_after_overlap_start_flag"])


@query("W25_sweep_ages", with_bars("15m") + ", " + SESSION_SQL + ", " + q.sweeps("ss", "w") + f""",
e AS (SELECT *, i - last_value(CASE WHEN sweep_flag = 1 THEN i END IGNORE NULLS) OVER {q.SO_FAR} AS a1,
  i - last_value(CASE WHEN sweep_flag = 1 AND (lon OR ny) THEN i END IGNORE NULLS) OVER {q.SO_FAR} AS a2 FROM w)
SELECT asset, t, coalesce(a1, 999) AS bars_since_last_liquidity_sweep,
  CASE WHEN sweep_flag > 0 AND a2 BETWEEN 1 AND 4 THEN 1 ELSE 0 END AS first_retest_after_session_sweep FROM e""")
def sweep_ages(spark, d):
    out = X.candle_helpers(ST.sweeps(session_columns(bars(spark, d, "15m"))))
    return show(S.sweep_ages(out), ["bars_since_last_liquidity_sweep", "first_retest_after_session_sweep"])


@query("W42_limited_fill", with_bars("1h") + f""",
k AS (SELECT *, CASE WHEN v >= 50 THEN c END AS x FROM b_1h),
p AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER {q.SO_FAR} AS pi,
  last_value(x IGNORE NULLS) OVER {q.SO_FAR} AS px,
  first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
  first_value(x IGNORE NULLS) OVER (PARTITION BY asset ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM k),
lin AS (SELECT *, coalesce(x, CASE WHEN i - pi <= 2 THEN coalesce(px + (nx - px) * (i - pi) / (ni - pi), px) END) AS y FROM p)
SELECT asset, t, round(last_value(x IGNORE NULLS) OVER {q.frame(3)}, 6) AS filled,
  round(last_value(y IGNORE NULLS) OVER {q.frame(3)}, 6) AS lined FROM lin""")
def limited_fill(spark, d):
    b = bars(spark, d, "1h")
    x = F.when(F.col("volume") >= 50, F.col("close"))
    b = b.withColumns({"filled": x, "lined": x})
    return show(R.limited_ffill(R.limited_ffill(b, ["filled"], 2), ["lined"], 2, interpolate=True), ["filled", "lined"])


@query("W50_heuristic_context", with_bars("6h", "12h") + ", " + q.ema("b_6h", "c", {"ef": 8, "es": 21}, "e6") + f""",
h0 AS (SELECT *, coalesce(c - {q.lag('c')}, 0) AS st, coalesce(ef - {q.lag('ef')}, 0) AS sl, coalesce({q.div('ef - es', 'c')}, 0) AS sp FROM e6),
h1 AS (SELECT *, avg(CASE WHEN st > 0 THEN 1 ELSE 0 END) OVER {q.frame(12)} AS up, avg(CASE WHEN st < 0 THEN 1 ELSE 0 END) OVER {q.frame(12)} AS dn FROM h0)
SELECT asset, t, CASE WHEN sp >= 0 AND sl >= 0 THEN 'up' ELSE 'down' END AS heur_bias_6h,
  round(least(1, greatest(0, 0.35 + 45 * abs(sp) + 0.2 * CASE WHEN sp >= 0 AND sl >= 0 THEN up ELSE dn END)), 6) AS heur_zone_score_6h
FROM h1""")
def heuristic_structure(spark, d):
    return show(X.heuristic_structure(bars(spark, d, "6h")), ["heur_bias_6h", "heur_zone_score_6h"])


def _rank(x):
    return (f"(len(list_filter(list({x}) OVER {q.SO_FAR}, lambda z: z < {x})) + (len(list_filter(list({x}) OVER {q.SO_FAR}, "
            f"lambda z: z = {x})) + 1) / 2.0) / (i + 1)")


@query("W50_heuristic_regime", with_bars("12h") + ", " + q.true_range("b_12h", "a") + ", " + q.ema(
    "a", "c", {"ef": 12, "es": 48}, "e") + f""",
h0 AS (SELECT *, abs(coalesce({q.div('c - ' + q.lag('c'), q.lag('c'))}, 0)) AS rt, coalesce({q.div('h - l', 'c')}, 0) AS rg,
  least(0.99, greatest(0.01, 0.5 + 6 * coalesce({q.div('ef - es', 'c')}, 0))) AS pu FROM e),
h1 AS (SELECT *, {q.roll('avg', 'rt', 16, 2)} AS tx, {q.roll('avg', 'rg', 10, 2)} AS mr,
  list(atr_early) OVER {q.SO_FAR} AS la FROM h0),
h2 AS (SELECT *, list(tx) FILTER (tx IS NOT NULL) OVER {q.SO_FAR} AS lt FROM h1),
h3 AS (SELECT *, (len(list_filter(la, lambda z: z < atr_early)) + (len(list_filter(la, lambda z: z = atr_early)) + 1) / 2.0) / len(la) AS ap,
  CASE WHEN tx IS NOT NULL THEN (len(list_filter(lt, lambda z: z < tx)) + (len(list_filter(lt, lambda z: z = tx)) + 1) / 2.0) / len(lt) END AS tox,
  CASE WHEN mr IS NOT NULL THEN least(1, greatest(0, 1 - mr * 20)) END AS cm, least(0.99, greatest(0.01, 1 - pu)) AS pd FROM h2),
h4 AS (SELECT *, least(0.99, greatest(0.01, 0.2 + 0.7 * abs(pu - pd))) AS a1,
  CASE WHEN cm IS NOT NULL THEN least(0.99, greatest(0.01, 0.1 + 0.7 * ap * (1 - cm))) END AS a2,
  CASE WHEN cm IS NOT NULL THEN least(0.99, greatest(0.01, 0.05 + 0.6 * cm * (1 - ap))) END AS a3, 0.2 + 0.4 * cm AS a4 FROM h3)
SELECT asset, t, round(pu, 6) AS heur_p_up, round(tox, 6) AS heur_toxicity, round(cm, 6) AS heur_compression,
  round(a1 / (a1 + a2 + a3 + a4), 6) AS heur_p_trend, round(a2 / (a1 + a2 + a3 + a4), 6) AS heur_p_expansion,
  round(a3 / (a1 + a2 + a3 + a4), 6) AS heur_p_collapse, round(a4 / (a1 + a2 + a3 + a4), 6) AS heur_p_range FROM h4""")
def heuristic_regime(spark, d):
    return show(X.heuristic_regime(bars(spark, d, "12h"), history=None), [
        "heur_p_up", "heur_toxicity", "heur_compression", "heur_p_trend", "heur_p_expansion", "heur_p_collapse",
        "heur_p_range"])
