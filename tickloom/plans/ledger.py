"""Ledger analytics over orders (one closed trade each) and fills (lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import ledger as L
from tickloom.plans.market import LEDGER, WITH_LEDGER, fills, ledger, table
from tickloom.plans.registry import query

_SUMMARY = """round(sum(pnl), 2) AS pnl, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins,
  count(*) FILTER (pnl < 0) AS losses, round(avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END), 6) AS win_rate,
  round(avg(r), 6) AS avg_r, round(max(r), 6) AS best_r, round(min(r), 6) AS worst_r, round(avg(conf), 6) AS avg_conf,
  round(avg(evr), 6) AS avg_evr"""


def neat(df, n=6, **special):
    """Round every double column, to ``special[name]`` places where given; ints become long."""
    out = []
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append(F.round(c, special.get(c, n)).alias(c))
        elif kind in ("int", "smallint"):
            out.append(F.col(c).cast("long").alias(c))
        elif kind == "timestamp":
            out.append(F.unix_seconds(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


@query("S12_normalised_ledger", WITH_LEDGER + """
SELECT trade_id, epoch(entry_ts)::BIGINT AS entry_ts, asset, side, tier, coalesce(regime, 'unknown') AS regime, leg, session,
  round(pnl, 2) AS pnl, round(r, 6) AS r, 0.0::DOUBLE AS risk, round(size_usd, 2) AS size_usd,
  CASE WHEN pnl > 0 THEN 'win' WHEN pnl < 0 THEN 'loss' ELSE 'flat' END AS result FROM led""")
def normalised(spark, d):
    raw = ledger(spark, d).withColumnsRenamed({"entry_ts": "entry_time", "r": "realized_r", "size_usd": "size",
                                               "regime": "regime_state"})
    out = L.normalise(raw).select("trade_id", "entry_ts", "asset", "side", "tier", "regime", "leg", "session", "pnl",
                                  "r", "risk", "size_usd", "result")
    return neat(out, pnl=2, size_usd=2)


@query("P8_trade_filter", WITH_LEDGER + """
SELECT trade_id, round(pnl, 2) AS pnl FROM led WHERE side IN ('long') AND tier IN ('1-URGENT', '2-HIGH') AND regime IN ('F', 'O')
  AND coalesce(conf, -1e308) >= 0.25 AND coalesce(evr, -1e308) >= 0 AND coalesce(r, -1e308) >= -2 AND pnl > 0
  AND entry_ts >= TIMESTAMP '1996-01-01' AND entry_ts < TIMESTAMP '2000-01-01'""")
def trade_filter(spark, d):
    out = L.select_trades(
        ledger(spark, d), {"side": ["long"], "tier": ["1-URGENT", "2-HIGH"], "regime": ["F", "O"]},
        {"conf": 0.25, "evr": 0.0, "r": -2.0}, True, "1996-01-01", "1999-12-31")
    return out.select("trade_id", F.round("pnl", 2).alias("pnl"))


_PERIOD = {"day": "CAST(CAST(entry_ts AS DATE) AS VARCHAR)",
           "iso_week": "CAST(CAST(date_trunc('week', entry_ts) AS DATE) AS VARCHAR)",
           "week": "CAST(CAST(date_trunc('week', entry_ts - INTERVAL 1 DAY) AS DATE) + 1 AS VARCHAR) || '/' || CAST(CAST(date_trunc('week', entry_ts - INTERVAL 1 DAY) AS DATE) + 7 AS VARCHAR)",
           "month": "strftime(entry_ts, '%Y-%m')"}


@query("A7_calendar_pnl", WITH_LEDGER + " " + " UNION ALL ".join(
    f"SELECT '{k}' AS grain, {e} AS period, {_SUMMARY} FROM led GROUP BY 2" for k, e in _PERIOD.items()))
def calendar(spark, d):
    df = L.with_period_labels(ledger(spark, d))
    grains = F.array(*[F.struct(F.lit(k).alias("grain"), F.col(k).cast("string").alias("period")) for k in _PERIOD])
    out = df.withColumn("_p", F.explode(grains)).groupBy(
        F.col("_p.grain").alias("grain"), F.col("_p.period").alias("period")).agg(*L.trade_summary())
    return neat(out, pnl=2)


_DIMS = ("tier", "leg", "regime", "session", "asset", "side")


@query("A8_group_attribution", WITH_LEDGER + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS dim, {c} AS value, {_SUMMARY} FROM led GROUP BY {c}" for c in _DIMS))
def attribution(spark, d):
    return neat(L.attribution(ledger(spark, d), _DIMS), pnl=2)


@query("A8_group_attribution_known_only", WITH_LEDGER + f"""
SELECT 'override' AS dim, override AS value, {_SUMMARY} FROM led WHERE override IS NOT NULL GROUP BY override""")
def attribution_known(spark, d):
    return neat(L.attribution(ledger(spark, d), ["override"], keep_missing=False), pnl=2)


@query("A8_fill_attribution", """
SELECT l_returnflag AS regime, l_linestatus AS status, count(*) AS fills, round(sum(l_quantity), 2) AS qty,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS avg_discount
FROM lineitem GROUP BY 1, 2""")
def fill_attribution(spark, d):
    return fills(spark, d).groupBy("regime", "status").agg(
        F.count(F.lit(1)).alias("fills"), F.round(F.sum("qty"), 2).alias("qty"),
        F.round(F.sum(F.col("notional") * (1 - F.col("discount"))), 2).alias("net"),
        F.round(F.avg("discount"), 6).alias("avg_discount"))


@query("A9_heatmap", WITH_LEDGER + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS dim, {c} AS value, CAST(CAST(entry_ts AS DATE) AS VARCHAR) AS day, round(sum(pnl), 2) AS pnl FROM led GROUP BY 2, 3"
    for c in ("session", "tier")))
def heatmap(spark, d):
    df = ledger(spark, d)
    out = L.heatmap(df, "session").withColumn("dim", F.lit("session")).unionByName(
        L.heatmap(df, "tier").withColumn("dim", F.lit("tier")))
    return neat(out.select("dim", "value", "day", "pnl"), pnl=2)


@query("A10_clock_tables", WITH_LEDGER + """,
x AS (SELECT *, epoch(exit_ts - entry_ts) / 60.0 AS held FROM led),
cells AS (SELECT 'weekday' AS "table", ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(exit_ts)] AS label, pnl FROM x
  UNION ALL SELECT 'hour', strftime(exit_ts, '%H') || ':00', pnl FROM x
  UNION ALL SELECT 'hold', CASE WHEN held < 15 THEN '<15m' WHEN held < 60 THEN '15m-1h' WHEN held < 240 THEN '1h-4h' WHEN held < 720 THEN '4h-12h' ELSE '>12h' END, pnl FROM x),
spine AS (SELECT 'weekday' AS "table", unnest(['Mon','Tue','Wed','Thu','Fri','Sat','Sun']) AS label
  UNION ALL SELECT 'hour', lpad(CAST(h AS VARCHAR), 2, '0') || ':00' FROM range(24) t(h)
  UNION ALL SELECT 'hold', unnest(['<15m', '15m-1h', '1h-4h', '4h-12h', '>12h']))
SELECT s."table", s.label, round(coalesce(sum(pnl), 0), 2) AS pnl, count(pnl) AS trades,
  round(coalesce(100.0 * count(*) FILTER (pnl > 0) / nullif(count(pnl), 0), 0), 6) AS win_rate_pct
FROM spine s LEFT JOIN cells c ON c."table" = s."table" AND c.label = s.label GROUP BY 1, 2""")
def clock_tables(spark, d):
    return neat(L.clock_tables(ledger(spark, d)), pnl=2)


@query("A11_ledger_kpis", WITH_LEDGER + """
SELECT count(*) AS trades, round(avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END), 6) AS win_rate,
  round(avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) FILTER (side = 'long'), 6) AS win_rate_long,
  round(avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) FILTER (side = 'short'), 6) AS win_rate_short,
  round(avg(r), 6) AS avg_r, round(avg(pnl), 4) AS expectancy, round(sum(pnl), 2) AS total_pnl,
  round(sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0), 6) AS profit_factor,
  round(avg(pnl) FILTER (pnl > 0) / abs(avg(pnl) FILTER (pnl < 0)), 6) AS payoff,
  round(avg(pnl) FILTER (pnl > 0), 4) AS avg_win, round(avg(pnl) FILTER (pnl < 0), 4) AS avg_loss,
  round(max(pnl), 2) AS max_win, round(min(pnl), 2) AS max_loss, round(avg(epoch(exit_ts - entry_ts) / 60.0), 6) AS avg_hold_min
FROM led""")
def kpis(spark, d):
    return neat(L.kpis(ledger(spark, d)), expectancy=4, total_pnl=2, avg_win=4, avg_loss=4, max_win=2, max_loss=2)


@query("A11_r_quantiles", WITH_LEDGER + " " + " UNION ALL ".join(
    f"SELECT {x}::DOUBLE AS q, round(quantile_cont(r, {x}), 6) AS value FROM led" for x in (0.5, 0.95, 0.99)))
def r_quantiles(spark, d):
    return neat(L.r_quantiles(ledger(spark, d)))


@query("A12_growth_and_ratios", WITH_LEDGER + """,
dd AS (SELECT CAST(exit_ts AS DATE) AS d, sum(pnl) AS p, min(entry_ts) AS lo, max(exit_ts) AS hi FROM led GROUP BY 1),
x AS (SELECT *, p / 1e9 AS ret FROM dd),
y AS (SELECT greatest(floor(epoch(max(hi) - min(lo)) / 86400.0) / 365.0, 1e-9) AS yrs, (1e9 + sum(p)) / 1e9 AS f,
  avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS sortino FROM x)
SELECT round(pow(f, 1 / yrs) - 1, 8) AS cagr, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino FROM y""")
def growth(spark, d):
    return neat(L.growth_and_ratios(ledger(spark, d), 1e9), cagr=8)


@query("A13_override_counts", WITH_LEDGER + """
SELECT count(*) FILTER (override = 'moonshot') AS moonshot_overrides, count(*) FILTER (override = '2R') AS two_r_overrides,
  count(*) FILTER (override IS NULL) AS normal_entries FROM led""")
def overrides(spark, d):
    return L.override_counts(ledger(spark, d))


_STRESS_ROWS = ", ".join(
    "(" + ", ".join([f"'{s['name']}'", *[f"{float({**L.NEUTRAL, **s}[k])!r}::DOUBLE" for k in L.NEUTRAL]]) + ")" for s in L.SCENARIOS)
_STRESSED = LEDGER + f""",
sc AS (SELECT * FROM (VALUES {_STRESS_ROWS}) v(scenario, {', '.join(L.NEUTRAL)})),
s0 AS (SELECT led.*, sc.*, CASE WHEN abs(entry_price - stop_price) * qty > 1e-9 THEN abs(entry_price - stop_price) * qty
    ELSE greatest(abs(size_usd) * 0.01, 1e-9) END AS one_r,
  pnl * fill_ratio - abs(size_usd) * ((slippage_bps + spread_bps + fee_bps) / 10000.0) * fill_ratio AS p0 FROM led, sc),
s1 AS (SELECT *, CASE WHEN p0 >= 0 THEN p0 - one_r * latency_bars * latency_penalty_r ELSE p0 - one_r * latency_bars * latency_penalty_r * 0.5 END AS p1 FROM s0),
s2 AS (SELECT *, CASE WHEN p1 > 0 THEN p1 * winner_haircut ELSE p1 END AS p2 FROM s1),
st AS (SELECT *, CASE WHEN p2 < 0 THEN p2 * loss_multiplier ELSE p2 END + pnl_shift_usd AS adj_pnl FROM s2)"""


@query("F21_stressed_pnl", "WITH " + _STRESSED + "\nSELECT scenario, trade_id, round(adj_pnl, 6) AS adj_pnl FROM st")
def stressed(spark, d):
    return L.stressed(ledger(spark, d)).select("scenario", "trade_id", F.round("adj_pnl", 6).alias("adj_pnl"))


@query("J10_scenario_totals", "WITH " + _STRESSED + """
SELECT scenario, count(*) AS trades, round(sum(adj_pnl), 2) AS total_pnl, count(*) FILTER (adj_pnl > 0) AS wins FROM st GROUP BY 1""")
def scenario_totals(spark, d):
    return L.stressed(ledger(spark, d)).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("trades"), F.round(F.sum("adj_pnl"), 2).alias("total_pnl"),
        F.count_if(F.col("adj_pnl") > 0).alias("wins"))


# capital in proportion to the ledger, so that equity stays positive at every scale
_EQ = 33333.0
_EQ_SQL = f"(SELECT {_EQ} * count(*) FROM orders)"


def _stress_sql(cols):
    return "WITH " + _STRESSED + f""",
e0 AS (SELECT *, {_EQ_SQL} + sum(adj_pnl) OVER (PARTITION BY scenario ORDER BY entry_ts, trade_id ROWS UNBOUNDED PRECEDING) AS eq FROM st),
e1 AS (SELECT *, greatest({_EQ_SQL}, max(eq) OVER (PARTITION BY scenario ORDER BY entry_ts, trade_id ROWS UNBOUNDED PRECEDING)) AS pk,
  adj_pnl / greatest(eq - adj_pnl, 1e-9) AS ret FROM e0),
vr AS (SELECT scenario, quantile_cont(ret, 0.05) AS var95 FROM e1 GROUP BY 1),
mm AS (SELECT e1.scenario, count(*) AS trades, avg(CASE WHEN adj_pnl > 0 THEN 1 ELSE 0 END) AS win_rate, sum(adj_pnl) AS total_pnl,
  arg_max(eq, (entry_ts, trade_id)) AS ending_equity, greatest(max((pk - eq) / pk), 0) AS max_drawdown_pct, any_value(var95) AS var95,
  avg(ret) FILTER (ret <= var95 + 1e-15) AS cvar95, coalesce(avg(adj_pnl) FILTER (adj_pnl > 0), 0) AS avg_win,
  coalesce(avg(adj_pnl) FILTER (adj_pnl < 0), 0) AS avg_loss FROM e1 JOIN vr USING (scenario) GROUP BY 1),
m1x AS (SELECT *, CASE WHEN avg_win > 0 AND avg_loss < 0 THEN avg_win / abs(avg_loss) ELSE 0 END AS payoff_ratio,
  win_rate - (1 - win_rate) / greatest(avg_win / abs(avg_loss), 1e-9) AS edge,
  least(200, greatest(1, {_EQ_SQL} / greatest(abs(avg_loss), 1e-9))) AS units FROM mm),
m2 AS (SELECT *, CASE WHEN avg_win = 0 OR avg_loss = 0 THEN CASE WHEN avg_loss < 0 THEN 1.0 ELSE 0.0 END WHEN edge <= 0 THEN 1.0
  ELSE least(1, greatest(0, exp(-2 * edge * units))) END AS risk_of_ruin_proxy FROM m1x),
m3 AS (SELECT *, list_filter([CASE WHEN max_drawdown_pct > 0.4 THEN 'max_drawdown' END, CASE WHEN abs(cvar95) > 0.03 THEN 'cvar95' END,
  CASE WHEN ending_equity < {_EQ_SQL} * 0.75 THEN 'ending_equity_floor' END, CASE WHEN risk_of_ruin_proxy > 0.8 THEN 'risk_of_ruin_proxy' END],
  lambda x: x IS NOT NULL) AS rs FROM m2)
SELECT {cols} FROM m3"""


@query("A14_tail_risk", _stress_sql("""scenario, trades, round(win_rate, 6) AS win_rate, round(total_pnl, 2) AS total_pnl,
  round(ending_equity, 2) AS ending_equity, round(max_drawdown_pct, 6) AS max_drawdown_pct, round(var95, 6) AS var95,
  round(cvar95, 6) AS cvar95, round(avg_win, 4) AS avg_win, round(avg_loss, 4) AS avg_loss, round(payoff_ratio, 6) AS payoff_ratio,
  round(risk_of_ruin_proxy, 6) AS risk_of_ruin_proxy"""))
def tail_risk(spark, d):
    out = L.stress_report(ledger(spark, d), _EQ * ledger(spark, d).count())
    return neat(out.drop("reasons", "passed", "delta_total_pnl", "delta_max_drawdown_pct", "delta_cvar95"),
                total_pnl=2, ending_equity=2, avg_win=4, avg_loss=4)


@query("A15_thresholds_and_deltas", _stress_sql("""scenario, array_to_string(rs, ',') AS reasons, CASE WHEN len(rs) = 0 THEN 1 ELSE 0 END AS passed,
  round(total_pnl - (SELECT total_pnl FROM m3 WHERE scenario = 'baseline'), 3) AS delta_total_pnl,
  round(max_drawdown_pct - (SELECT max_drawdown_pct FROM m3 WHERE scenario = 'baseline'), 6) AS delta_max_drawdown_pct,
  round(cvar95 - (SELECT cvar95 FROM m3 WHERE scenario = 'baseline'), 6) AS delta_cvar95"""))
def thresholds(spark, d):
    out = L.stress_report(ledger(spark, d), _EQ * ledger(spark, d).count())
    return neat(out.select("scenario", "reasons", "passed", "delta_total_pnl", "delta_max_drawdown_pct", "delta_cvar95"),
                delta_total_pnl=3)


def _edges(rel, x, n, name):
    qs = ", ".join(f"{i / n!r}" for i in range(n + 1))
    return f"{name} AS (SELECT list_sort(list_distinct(quantile_cont({x}, [{qs}]))) AS e FROM {rel})"


def _bin(x, name):
    return f"(len(list_filter(list_slice({name}.e, 2, len({name}.e) - 1), lambda z: z < {x})) + 1)"


@query("A16_decile_attribution", WITH_LEDGER + ", " + _edges("led", "evr", 10, "ed") + f"""
SELECT {_bin('evr', 'ed')} AS bin, count(*) AS trades, round(sum(pnl), 2) AS pnl,
  round(avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END), 6) AS win_rate, round(avg(r), 6) AS avg_r FROM led, ed GROUP BY 1""")
def deciles(spark, d):
    return neat(L.bucket_attribution(ledger(spark, d), "evr"), pnl=2)


@query("A16_fill_deciles", "WITH " + _edges("lineitem", "l_extendedprice", 10, "ed") + f"""
SELECT {_bin('l_extendedprice', 'ed')} AS bin, count(*) AS fills, round(sum(l_quantity), 2) AS qty FROM lineitem, ed GROUP BY 1""")
def fill_deciles(spark, d):
    from tickloom.operators.quantile import quantile_buckets

    out = quantile_buckets(fills(spark, d), "notional", 10, "bin").groupBy("bin").agg(
        F.count(F.lit(1)).alias("fills"), F.sum("qty").alias("qty"))
    return neat(out, qty=2)


@query("A17_quartile_grid", WITH_LEDGER + ", " + _edges("led", "conf", 4, "ea") + ", " + _edges("led", "hazard_entry", 4, "eb") + f""",
x AS (SELECT {_bin('conf', 'ea')} AS bin_a, {_bin('hazard_entry', 'eb')} AS bin_b, pnl FROM led, ea, eb)
SELECT bin_a, """ + ", ".join(f'round(avg(pnl) FILTER (bin_b = {k}), 4) AS "{k}"' for k in range(1, 5)) + " FROM x GROUP BY 1")
def grid(spark, d):
    return neat(L.stress_grid(ledger(spark, d), "conf", "hazard_entry"), 4)


@query("A18_pivot_max", """WITH x AS (SELECT o_orderpriority AS target, o_orderstatus AS family, o_totalprice / 0.997::DOUBLE AS s FROM orders)
SELECT target, round(max(s) FILTER (family = 'F'), 4) AS "F", round(max(s) FILTER (family = 'O'), 4) AS "O",
  round(max(s) FILTER (family = 'P'), 4) AS "P", round(max(s) FILTER (family = 'F') - max(s) FILTER (family = 'O'), 4) AS delta FROM x GROUP BY 1""")
def pivot_max(spark, d):
    x = ledger(spark, d).groupBy(F.col("tier").alias("target")).pivot("regime").agg(F.max("size_usd"))
    return neat(x.withColumn("delta", F.col("F") - F.col("O")), 4)


@query("A19_reason_counts", WITH_LEDGER + "\nSELECT reason, count(*) AS trades FROM (SELECT unnest(gate_reasons) AS reason FROM led) GROUP BY 1")
def reasons(spark, d):
    return L.reason_counts(ledger(spark, d))


@query("A22_exposures", WITH_LEDGER + """,
op AS (SELECT asset, coalesce(sum(size_usd) FILTER (side = 'long'), 0) AS "long", coalesce(sum(size_usd) FILTER (side <> 'long'), 0) AS "short"
  FROM led WHERE exit_ts > TIMESTAMP '2001-01-01' GROUP BY 1),
t AS (SELECT sum("long" + "short") AS g FROM op)
SELECT asset, round("long", 2) AS "long", round("short", 2) AS "short", round("long" - "short", 2) AS net, round("long" + "short", 2) AS gross,
  round(("long" + "short") / 1e8, 6) AS risk_weight, round(g / 1e8, 6) AS leverage, CASE WHEN g <= 1e8 THEN 1 ELSE 0 END AS within_limits FROM op, t""")
def exposures(spark, d):
    # trades still open at the start of 2001
    df = ledger(spark, d)
    cut = F.lit("2001-01-01").cast("timestamp")
    df = df.filter(F.col("exit_ts") > cut).withColumn("exit_ts", F.lit(None).cast("timestamp"))
    return neat(L.exposures(df, 1e8), **{"long": 2, "short": 2, "net": 2, "gross": 2})


@query("A33_to_date_pnl", WITH_LEDGER + ", m AS (SELECT max(entry_ts) AS t FROM led)\nSELECT " + ", ".join(
    f"round(coalesce(sum(pnl) FILTER (entry_ts >= date_trunc('{u}', t)), 0), 2) AS pnl_{u}" for u in ("day", "week", "month"))
    + ", " + ", ".join(
    f"round(coalesce(sum(pnl) FILTER (entry_ts >= t - INTERVAL {n} DAY), 0), 2) AS pnl_last_{n}d, count(*) FILTER (entry_ts >= t - INTERVAL {n} DAY) AS trades_last_{n}d, "
    f"round(avg(r) FILTER (entry_ts >= t - INTERVAL {n} DAY), 6) AS avg_r_last_{n}d" for n in (1, 7, 30)) + " FROM led, m")
def to_date(spark, d):
    out = L.to_date_pnl(ledger(spark, d))
    return neat(out, **{c: 2 for c in out.columns if c.startswith("pnl")})


@query("A37_weighted_entry", """SELECT l_orderkey AS order_id, round(sum(l_quantity), 2) AS qty,
  round(sum(l_quantity * (l_extendedprice / 0.997::DOUBLE)) / sum(l_quantity), 4) AS avg_entry FROM lineitem GROUP BY 1""")
def weighted_entry(spark, d):
    price = F.col("notional") / 0.997
    return neat(L.weighted_entry(fills(spark, d).withColumn("price", price), "order_id"), qty=2, avg_entry=4)


@query("W29_equity_curve", WITH_LEDGER + """,
e AS (SELECT *, 1e9 + sum(pnl) OVER (ORDER BY entry_ts, trade_id ROWS UNBOUNDED PRECEDING) AS eq FROM led)
SELECT trade_id, round(eq, 2) AS equity, round(eq - max(eq) OVER (ORDER BY entry_ts, trade_id ROWS UNBOUNDED PRECEDING), 2) AS drawdown,
  round(pnl / greatest(eq - pnl, 1e-9), 9) AS ret_on_equity FROM e""")
def equity_curve(spark, d):
    out = L.equity_curve(L.ordered(ledger(spark, d).select("entry_ts", "trade_id", "pnl")), 1e9)
    return neat(out.select("trade_id", "equity", "drawdown", "ret_on_equity"), equity=2, drawdown=2, ret_on_equity=9)


@query("W30_longest_streaks", WITH_LEDGER + "".join(f""",
z{k} AS (SELECT *, {e} AS s FROM led),
y{k} AS (SELECT s, row_number() OVER (ORDER BY entry_ts, trade_id) - row_number() OVER (PARTITION BY s ORDER BY entry_ts, trade_id) AS g FROM z{k}),
x{k} AS (SELECT s, count(*) AS n FROM y{k} GROUP BY s, g)""" for k, e in (("a", "CASE WHEN pnl > 0 THEN 1 ELSE -1 END"), ("b", "sign(pnl)"))) + """
SELECT '0 is a loss' AS rule, coalesce(max(n) FILTER (s = 1), 0) AS max_win_streak, coalesce(max(n) FILTER (s = -1), 0) AS max_loss_streak FROM xa
UNION ALL SELECT '0 resets', coalesce(max(n) FILTER (s = 1), 0), coalesce(max(n) FILTER (s = -1), 0) FROM xb""")
def streaks(spark, d):
    rows = L.ordered(ledger(spark, d).select("entry_ts", "trade_id", "pnl"))
    out = L.longest_streaks(rows).withColumn("rule", F.lit("0 is a loss")).unionByName(
        L.longest_streaks(rows, zero_resets=True).withColumn("rule", F.lit("0 resets")))
    return neat(out)


@query("W46_trade_lifecycle", """WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS trade_id, * FROM events),
g AS (SELECT trade_id, arg_min(struct_pack(ts := ts, event_type := event_type, value := value), (ts, event_id)) FILTER (event_type IN ('view', 'click')) AS fi,
  arg_min(struct_pack(ts := ts, event_type := event_type, value := value), (ts, event_id)) AS fa,
  arg_max(struct_pack(ts := ts, event_type := event_type, value := value), (ts, event_id)) FILTER (event_type = 'purchase') AS ou FROM ev GROUP BY 1),
h AS (SELECT *, coalesce(fi, fa) AS i FROM g)
SELECT trade_id, floor(epoch(i.ts))::BIGINT AS entry_ts, floor(epoch(ou.ts))::BIGINT AS exit_ts, CASE WHEN ou IS NULL THEN 'open' ELSE 'closed' END AS status,
  i.event_type AS entry_reason, coalesce(ou.event_type, '') AS exit_reason, round(i.value, 6) AS entry_value, round(ou.value, 6) AS exit_value,
  CASE WHEN ou IS NOT NULL THEN round(greatest((epoch_us(ou.ts) - epoch_us(i.ts)) / 60e6, 0), 6) END AS duration_min FROM h""")
def lifecycle(spark, d):
    ev = table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value",
        F.col("user_id").cast("string").alias("trade_id"))
    out = L.lifecycle(ev, ("view", "click"), ("purchase",))
    return neat(out.withColumn("duration_min", F.when(F.col("exit_ts").isNotNull(), F.col("duration_min"))))


@query("W47_ranking", WITH_LEDGER + """,
s AS (SELECT tier AS model, session AS family, avg(evr) AS evr, avg(hazard_entry) AS cvar, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS prec,
  min(pnl) AS dd FROM led GROUP BY 1, 2)
SELECT model, family, row_number() OVER (ORDER BY evr DESC, cvar, prec DESC, model, family) AS rank_quality,
  row_number() OVER (ORDER BY -dd, cvar, model, family) AS rank_safety FROM s""")
def ranking(spark, d):
    from tickloom.operators.ensemble import rank_models

    s = ledger(spark, d).groupBy(F.col("tier").alias("model"), F.col("session").alias("family")).agg(
        F.avg("evr").alias("evr"), F.avg("hazard_entry").alias("cvar"), F.avg((F.col("pnl") > 0).cast("int")).alias("precision"),
        (-F.min("pnl")).alias("max_dd"))
    return neat(rank_models(s, ("model", "family")).select("model", "family", "rank_quality", "rank_safety"))


@query("F5_period_labels", WITH_LEDGER + f"""
SELECT trade_id, {_PERIOD['day']} AS day, {_PERIOD['iso_week']} AS iso_week, {_PERIOD['week']} AS week, {_PERIOD['month']} AS month,
  isodow(entry_ts) - 1 AS weekday, hour(entry_ts) AS hour, round(epoch(exit_ts - entry_ts) / 60.0, 6) AS duration_min,
  round(epoch(exit_ts - entry_ts) / 3600.0, 6) AS duration_hr FROM led""")
def period_labels(spark, d):
    out = L.with_period_labels(ledger(spark, d))
    return neat(out.select("trade_id", F.col("day").cast("string").alias("day"), F.col("iso_week").cast("string").alias("iso_week"),
                           "week", "month", "weekday", "hour", "duration_min", "duration_hr"))


@query("F23_outcomes", WITH_LEDGER + """
SELECT trade_id, CASE WHEN pnl > 0 THEN 'win' WHEN pnl < 0 THEN 'loss' ELSE 'flat' END AS outcome,
  CASE WHEN abs(size_usd) > 1e-9 THEN round(pnl / size_usd * 100, 6) END AS pnl_pct, round(evr, 6) AS rr_expected, round(r, 6) AS rr_realized FROM led""")
def outcomes(spark, d):
    out = L.with_period_labels(ledger(spark, d))
    return neat(out.select("trade_id", "outcome", "pnl_pct", F.col("evr").alias("rr_expected"), F.col("r").alias("rr_realized")))


@query("F25_list_texts", WITH_LEDGER + """
SELECT trade_id, array_to_string(gate_reasons, ', ') AS gate_reasons_txt,
  'ocean_12h:' || CAST(ok_ocean AS VARCHAR) || ', flow_1h:' || CAST(ok_flow AS VARCHAR) AS gates_txt FROM led""")
def list_texts(spark, d):
    return L.texts(ledger(spark, d)).select("trade_id", "gate_reasons_txt", "gates_txt")


@query("F19_cooldown_minutes", WITH_LEDGER + """,
n AS (SELECT *, row_number() OVER (PARTITION BY asset, CAST(exit_ts AS DATE) ORDER BY exit_ts, trade_id) AS k FROM led),
s AS (SELECT *, k - coalesce(max(CASE WHEN r >= 0 THEN k END) OVER (PARTITION BY asset, CAST(exit_ts AS DATE) ORDER BY exit_ts, trade_id ROWS UNBOUNDED PRECEDING), 0) AS ls FROM n)
SELECT trade_id, ls AS loss_streak, CASE WHEN r >= 5 OR (r >= 2 AND hazard_entry < 0.25) THEN 0.0 ELSE round(least(240, greatest(5,
  15.0 * CASE WHEN hazard_entry < 0.25 THEN 0.6::DOUBLE WHEN hazard_entry > 0.6 THEN 1.5 ELSE 1 END * CASE WHEN ls >= 2 THEN 1.3::DOUBLE + 0.2::DOUBLE * (ls - 1) ELSE 1 END
  * CASE WHEN k > 5 THEN 1 + (k - 5) * 0.2::DOUBLE ELSE 1 END)), 6) END AS cooldown_min FROM s""")
def cooldown(spark, d):
    return neat(L.cooldown_minutes(ledger(spark, d)).select("trade_id", "loss_streak", "cooldown_min"))


@query("U2_ledger_union", WITH_LEDGER + """
SELECT CASE WHEN leg = 'core' THEN 'backtest' ELSE 'forward' END AS source, trade_id, round(pnl, 2) AS pnl FROM led""")
def union(spark, d):
    df = ledger(spark, d)
    a = L.normalise(df.filter(F.col("leg") == "core").withColumnRenamed("r", "realized_r")).withColumn("source", F.lit("backtest"))
    b = L.normalise(df.filter(F.col("leg") != "core")).withColumn("source", F.lit("forward"))
    return neat(a.unionByName(b, allowMissingColumns=True).select("source", "trade_id", "pnl"), pnl=2)


@query("U3_keep_last", """SELECT o_custkey AS custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS trade_id,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS size_usd FROM orders GROUP BY 1""")
def keep_last(spark, d):
    from tickloom.sources.store import keep_last as last

    o = table(spark, d, "orders")
    a = o.filter(F.col("o_orderkey") % 2 == 0)
    b = o.filter(F.col("o_orderkey") % 2 == 1)
    return last(a.unionByName(b), ("o_custkey",), ("o_orderdate", "o_orderkey")).select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("trade_id"), F.col("o_totalprice").alias("size_usd"))


_EVENTS_SQL = LEDGER + """,
te AS (SELECT trade_id, entry_ts AS ts, 'entry' AS type, entry_price AS price, 'entry' AS reason, NULL::DOUBLE AS pnl, side, tier FROM led
UNION ALL SELECT trade_id, exit_ts, CASE WHEN reason LIKE '%stop%' THEN 'stop' ELSE 'exit' END, exit_price, reason, pnl, side, tier FROM led WHERE exit_ts IS NOT NULL)"""


@query("U4_trade_events", "WITH " + _EVENTS_SQL + """
SELECT trade_id, epoch(ts)::BIGINT AS ts, type, round(price, 6) AS price, reason, round(pnl, 2) AS pnl FROM te""")
def trade_events(spark, d):
    return neat(L.trade_events(ledger(spark, d)).select("trade_id", "ts", "type", "price", "reason", "pnl"), pnl=2)


@query("U6_chart_markers", "WITH " + _EVENTS_SQL + """
SELECT trade_id, epoch(ts)::BIGINT AS ts, CASE WHEN (type = 'entry') = (side = 'long') THEN 'belowBar' ELSE 'aboveBar' END AS position,
  CASE WHEN type <> 'entry' THEN 'circle' WHEN side = 'long' THEN 'arrowUp' ELSE 'arrowDown' END AS shape,
  CASE WHEN type = 'entry' THEN 'entry ' || tier ELSE 'exit ' || CASE WHEN pnl >= 0 THEN '+' ELSE '' END || CAST(CAST(round_even(pnl, 0) AS BIGINT) AS VARCHAR) END AS text FROM te""")
def markers(spark, d):
    return neat(L.chart_markers(ledger(spark, d)))


@query("K1_ordered_ledger", WITH_LEDGER + """
SELECT row_number() OVER (ORDER BY entry_ts NULLS LAST, trade_id) - 1 AS position, trade_id FROM led""")
def ordered(spark, d):
    return L.ordered(ledger(spark, d).select("entry_ts", "trade_id")).select(F.col("row_idx").alias("position"), "trade_id")


@query("K2_latest_trades", WITH_LEDGER + "\nSELECT trade_id, round(pnl, 2) AS pnl FROM led ORDER BY entry_ts DESC, trade_id DESC LIMIT 500")
def latest(spark, d):
    return ledger(spark, d).orderBy(F.desc("entry_ts"), F.desc("trade_id")).limit(500).select(
        "trade_id", F.round("pnl", 2).alias("pnl"))


@query("K3_top_and_bottom", WITH_LEDGER + """
SELECT * FROM (SELECT 'winner' AS kind, CAST(trade_id AS VARCHAR) AS label, round(pnl, 2) AS pnl FROM led ORDER BY led.pnl DESC, trade_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'loser', CAST(trade_id AS VARCHAR), round(pnl, 2) AS p FROM led ORDER BY led.pnl, trade_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'bucket', session, round(sum(pnl), 2) AS p FROM led GROUP BY session ORDER BY sum(led.pnl) DESC, session LIMIT 8)""")
def top(spark, d):
    df = ledger(spark, d)
    one = df.select(F.lit("x").alias("kind"), F.col("trade_id").cast("string").alias("label"), "pnl", "trade_id")
    win = one.orderBy(F.desc("pnl"), "trade_id").limit(10).withColumn("kind", F.lit("winner"))
    lose = one.orderBy("pnl", "trade_id").limit(10).withColumn("kind", F.lit("loser"))
    by = df.groupBy(F.col("session").alias("label")).agg(F.sum("pnl").alias("pnl")).orderBy(F.desc("pnl"), "label").limit(8)
    out = win.drop("trade_id").unionByName(lose.drop("trade_id")).unionByName(by.withColumn("kind", F.lit("bucket")))
    return neat(out, pnl=2)


@query("K4_large_r_trades", WITH_LEDGER + "\nSELECT trade_id, round(r, 6) AS r, side, tier, leg FROM led WHERE r >= 4")
def large_r(spark, d):
    return neat(ledger(spark, d).filter(F.col("r") >= 4).select("trade_id", "r", "side", "tier", "leg"))


_SCORE = "greatest(conf, 0) * (1 + greatest(evr, 0)) * (1 + greatest(r, 0)) * (1 - least(0.95, greatest(hazard_entry, 0)))"


@query("K5_signal_ranking", WITH_LEDGER + f"""
SELECT trade_id, round({_SCORE}, 4) AS signal_score FROM led""")
def signal_ranking(spark, d):
    from tickloom.operators.screen import signal_score

    df = ledger(spark, d).withColumns({"confluence": F.col("conf"), "median_r": F.col("r"), "hazard": F.col("hazard_entry"),
                                       "flow_1h": F.lit(0.0)})
    return df.select("trade_id", F.round(signal_score(), 4).alias("signal_score")).orderBy(F.desc("signal_score"), "trade_id")


@query("K7_first_bar_at_or_after", """SELECT o_orderkey AS trade_id,
  (SELECT min(epoch(o2.d))::BIGINT FROM (SELECT DISTINCT o_orderdate AS d FROM orders) o2 WHERE o2.d >= o.o_orderdate + INTERVAL 12 HOUR) AS bar_t FROM orders o""")
def first_bar(spark, d):
    from tickloom.operators.asof import first_at_or_after

    o = table(spark, d, "orders")
    bars = o.select(F.col("o_orderdate").cast("timestamp").alias("at")).distinct()
    want = o.select(F.col("o_orderkey").alias("trade_id"),
                    F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 43200).alias("at"))
    return first_at_or_after(want, bars, "at", "bar_t").select("trade_id", F.unix_seconds("bar_t").alias("bar_t"))
