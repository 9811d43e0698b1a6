"""The driver tables read as market data, and the same reading as SQL text.

events   -> trades  (asset = event_type, price = value + 1 to the cent, volume = props.k)
orders   -> ledger  (one closed trade per order)
lineitem -> fills   (grouping at larger row counts)
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.rollup import TIMEFRAMES, indexed_rollup, minute_bars


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trades(spark: SparkSession, folder: str) -> DataFrame:
    ev = table(spark, folder, "events")
    return ev.select(
        F.col("event_type").alias("asset"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.round(F.col("value") + 1, 2).alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        F.when(F.col("user_id") % 2 == 0, "b").otherwise("s").alias("side"),
    )


def minutes(spark: SparkSession, folder: str) -> DataFrame:
    return minute_bars(trades(spark, folder))


def bars(spark: SparkSession, folder: str, tf: str) -> DataFrame:
    return indexed_rollup(minutes(spark, folder), tf)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    pnl = (F.col("o_totalprice") - 250000.0) / 0.997
    return o.select(
        F.col("o_orderkey").alias("trade_id"),
        F.col("o_orderdate").cast("timestamp").alias("entry_ts"),
        F.timestamp_seconds(
            F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 97 + 1) * 900
        ).alias("exit_ts"),
        F.concat(F.lit("C"), (F.col("o_custkey") % 5).cast("string")).alias("asset"),
        F.when(F.col("o_custkey") % 2 == 0, "long").otherwise("short").alias("side"),
        F.col("o_orderpriority").alias("tier"),
        F.col("o_orderstatus").alias("regime"),
        F.when(F.col("o_orderkey") % 10 < 7, "core").otherwise("runner").alias("leg"),
        pnl.alias("pnl"),
        (pnl / 47123.0).alias("r"),
        (F.col("o_totalprice") / 0.997).alias("size_usd"),
        ((F.col("o_orderkey") % 100) / 100.0).alias("conf"),
        ((F.col("o_custkey") % 40) / 10.0 - 1.0).alias("evr"),
        (F.col("o_totalprice") / 1000.0).alias("entry_price"),
        (F.col("o_totalprice") / 1000.0 + pnl / 10000.0).alias("exit_price"),
        (F.col("o_totalprice") / 1000.0 - (F.col("o_custkey") % 7 + 1)).alias("stop_price"),
        (F.col("o_orderkey") % 9 + 1).cast("double").alias("qty"),
        ((F.col("o_custkey") % 50) / 50.0).alias("hazard_entry"),
        F.when(F.col("o_orderkey") % 11 == 0, "moonshot").when(F.col("o_orderkey") % 11 == 1, "2R").alias("override"),
        F.element_at(F.array(*[F.lit(s) for s in ("asia", "london", "ny", "overlap")]),
                     (F.col("o_custkey") % 4 + 1).cast("int")).alias("session"),
        F.when(F.col("o_orderkey") % 13 == 0, "stop_hit").otherwise("target").alias("reason"),
        F.array_compact(
            F.array(
                F.when(F.col("o_orderkey") % 3 == 0, "ocean_trend_low"),
                F.when(F.col("o_orderkey") % 4 == 0, "waves_zone_low"),
                F.when(F.col("o_orderkey") % 5 == 0, "flow_stale"),
            )
        ).alias("gate_reasons"),
        F.create_map(F.lit("ocean_12h"), F.col("o_orderkey") % 3 != 0, F.lit("flow_1h"), F.col("o_orderkey") % 5 != 0)
        .alias("gates"),
    )


def fills(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_returnflag").alias("regime"),
        F.col("l_linestatus").alias("status"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("notional"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


SIGNAL_COLUMNS = {
    "id": "k", "side": "CASE WHEN c % 2 = 0 THEN 'long' ELSE 'short' END",
    "asset": "concat('C', CAST(c % 5 AS STRING))", "leg": "CASE WHEN k % 3 = 0 THEN 'runner' ELSE 'core' END",
    "close": "px", "atr": "CASE WHEN k % 29 <> 0 THEN px * (k % 20 + 1) / 1000.0D END",
    "p_trend_up": "CASE WHEN k % 31 <> 0 THEN (c % 100) / 100.0D END",
    "p_trend_down": "CASE WHEN k % 31 <> 0 THEN (99 - c % 100) / 100.0D END",
    "p_regime_trend": "(k % 10) / 10.0D", "p_regime_expansion": "(k % 7) / 10.0D",
    "p_regime_collapse": "(c % 5) / 10.0D", "p_regime_range": "(c % 3) / 10.0D",
    "toxicity_12h": "CASE WHEN k % 37 <> 0 THEN (k % 50) / 100.0D END",
    "structural_bias_6h": "CASE k % 4 WHEN 0 THEN 'UP' WHEN 1 THEN 'down' WHEN 2 THEN 'NEUTRAL' END",
    "zone_score_6h": "CASE WHEN k % 8 <> 0 THEN (k % 97) / 96.0D END",
    "flow_ok_1h": "CASE WHEN k % 3 <> 0 THEN k % 2 END",
    "displacement_body_pct_1h": "(c % 91) / 90.0D", "volume_z_1h": "(k % 41) / 10.0D - 1.0D",
    "flow_age_bars_1h": "CASE WHEN k % 43 <> 0 THEN k % 9 END",
    "p_flow_1h": "CASE WHEN k % 23 <> 0 THEN (c % 77) / 76.0D END",
    "p_liq_flow": "(k % 83) / 82.0D", "p_bos_cont": "(k % 59) / 58.0D", "p_momo": "(c % 47) / 46.0D",
    "prob_meta": "(k % 71) / 70.0D", "p_eop": "(k % 19) / 18.0D", "p_edp": "(c % 19) / 18.0D",
    "session_bucket": "CASE (k + c) % 5 WHEN 0 THEN 'dead_zone' WHEN 1 THEN 'pre_expansion' WHEN 2 THEN 'expansion' WHEN 3 THEN 'overlap' END",
    "session_weight": "CASE (k + c) % 5 WHEN 3 THEN 1.1D WHEN 2 THEN 1.0D WHEN 1 THEN 1.0D ELSE 0.2D END",
    "session_quality_multiplier": "CASE (k + c) % 5 WHEN 0 THEN 0.75D WHEN 1 THEN 0.95D WHEN 2 THEN 1.05D WHEN 3 THEN 1.15D END",
    "hazard_score": "(c % 61) / 60.0D", "evr": "(k % 17) / 4.0D - 1.0D", "median_r": "(k % 13) * 1.0D",
    "confluence_score": "(k % 89) / 88.0D",
    "q05": "-(k % 40) / 1000.0D", "q10": "-(k % 25) / 1000.0D", "absorption_score": "(k % 101) / 100.0D",
    "ema_dist_z": "(c % 70) / 10.0D - 3.5D", "bars_in_trade": "k % 60",
    "entry_price": "px * (1.0D + (c % 21 - 10) / 1000.0D)",
    "stop_price": "px * (1.0D + (c % 21 - 10) / 1000.0D) * (1.0D + (CASE WHEN c % 2 = 0 THEN -1 ELSE 1 END) * (k % 15 + 1) / 500.0D)",
    "equity": "10000.0D + (k % 1000) * 50.0D", "free_capital": "(10000.0D + (k % 1000) * 50.0D) * 0.4D",
    "locked_profit": "(k % 50) * 100.0D", "drawdown": "(c % 23) / 200.0D", "legs": "k % 5",
    "displacement": "c % 2", "fresh_retest": "CASE WHEN c % 3 > 0 THEN 1 ELSE 0 END", "bos_flag": "k % 2",
    "flow_strength_1h": "(k % 11) / 10.0D - 0.2D", "qty": "CAST(k % 9 + 1 AS DOUBLE)",
}


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """One scored candidate per order: every screening input, with gaps, from the order's keys and price."""
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), (F.col("o_totalprice") / 997.0).alias("px"),
        F.col("o_orderdate").cast("timestamp").alias("ts"))
    return o.select("ts", *[F.expr(e).alias(n) for n, e in SIGNAL_COLUMNS.items()])


def epoch(c: str = "bar_close") -> Column:
    return F.unix_seconds(c)


def r6(c, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---------------------------------------------------------------- SQL text

TRADES = """trades AS (
  SELECT event_type AS asset, ts, event_id AS seq, round(value + 1, 2) AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
         CASE WHEN user_id % 2 = 0 THEN 'b' ELSE 's' END AS side
  FROM events)"""

MINUTES = TRADES + """, m1 AS (
  SELECT asset, (epoch_us(ts) // 60000000) * 60 AS o_t, (epoch_us(ts) // 60000000) * 60 + 60 AS t,
         arg_min(price, (ts, seq)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (ts, seq)) AS c,
         sum(volume) AS v, count(*) AS n
  FROM trades GROUP BY ALL)"""


def sql_rollup(tf: str, name: str = "b") -> str:
    s = TIMEFRAMES[tf]
    return f"""{name}_raw AS (
  SELECT asset, ((t + {s - 1}) // {s}) * {s} AS t, arg_min(o, m1.t) AS o, max(h) AS h, min(l) AS l,
         arg_max(c, m1.t) AS c, sum(v) AS v, sum(c * v) AS dv
  FROM m1 GROUP BY asset, ((m1.t + {s - 1}) // {s}) * {s}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY t) - 1 AS i FROM {name}_raw)"""


def with_bars(*tfs: str) -> str:
    """``WITH`` clause that defines ``b_15m``, ``b_1h``, ... (columns asset, t, o, h, l, c, v, dv, i)."""
    return "WITH " + ", ".join([MINUTES, *[sql_rollup(tf, f"b_{tf}") for tf in tfs]])


LEDGER = """led AS (
  SELECT o_orderkey AS trade_id, o_orderdate AS entry_ts,
         o_orderdate + to_seconds((o_orderkey % 97 + 1) * 900) AS exit_ts,
         'C' || CAST(o_custkey % 5 AS VARCHAR) AS asset,
         CASE WHEN o_custkey % 2 = 0 THEN 'long' ELSE 'short' END AS side,
         o_orderpriority AS tier, o_orderstatus AS regime,
         CASE WHEN o_orderkey % 10 < 7 THEN 'core' ELSE 'runner' END AS leg,
         (o_totalprice - 250000.0) / 0.997::DOUBLE AS pnl, (o_totalprice - 250000.0) / 0.997::DOUBLE / 47123.0 AS r, o_totalprice / 0.997::DOUBLE AS size_usd,
         (o_orderkey % 100) / 100.0::DOUBLE AS conf, (o_custkey % 40) / 10.0::DOUBLE - 1.0 AS evr,
         o_totalprice / 1000.0 AS entry_price, o_totalprice / 1000.0 + (o_totalprice - 250000.0) / 0.997::DOUBLE / 10000.0 AS exit_price,
         o_totalprice / 1000.0 - (o_custkey % 7 + 1) AS stop_price, CAST(o_orderkey % 9 + 1 AS DOUBLE) AS qty,
         (o_custkey % 50) / 50.0::DOUBLE AS hazard_entry,
         CASE WHEN o_orderkey % 11 = 0 THEN 'moonshot' WHEN o_orderkey % 11 = 1 THEN '2R' END AS override,
         ['asia', 'london', 'ny', 'overlap'][o_custkey % 4 + 1] AS session,
         CASE WHEN o_orderkey % 13 = 0 THEN 'stop_hit' ELSE 'target' END AS reason,
         list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'ocean_trend_low' END, CASE WHEN o_orderkey % 4 = 0 THEN 'waves_zone_low' END,
           CASE WHEN o_orderkey % 5 = 0 THEN 'flow_stale' END], lambda x: x IS NOT NULL) AS gate_reasons,
         o_orderkey % 3 <> 0 AS ok_ocean, o_orderkey % 5 <> 0 AS ok_flow
  FROM orders)"""
WITH_LEDGER = "WITH " + LEDGER


def _as_duck(expr: str) -> str:
    out = re.sub(r"(\d+\.\d+)D", r"CAST(\1 AS DOUBLE)", expr)
    return out.replace("AS STRING", "AS VARCHAR")


SIGNALS = ("sig AS (SELECT ts, " + ", ".join(f"{_as_duck(e)} AS {n}" for n, e in SIGNAL_COLUMNS.items())
           + " FROM (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice / 997.0 AS px, o_orderdate AS ts FROM orders))")
WITH_SIGNALS = "WITH " + SIGNALS
