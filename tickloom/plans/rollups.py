"""Bars from trades: rollups, gap filling, as-of context."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import rollup as R
from tickloom.operators.asof import asof, bucket_lookup
from tickloom.plans.market import MINUTES, TRADES, bars, epoch, minutes, r6, trades, with_bars
from tickloom.plans.registry import query


@query("A1_minute_bars", f"""WITH {MINUTES}
SELECT asset, o_t AS t, o AS open, h AS high, l AS low, c AS close, v AS volume, n AS trades FROM m1""")
def minute_bars(spark, d):
    return minutes(spark, d).select(
        "asset", epoch("bar_open").alias("t"), "open", "high", "low", "close", "volume", "trades"
    )


@query("A2_merge_partial_bars", f"""WITH {MINUTES}
SELECT asset, o_t AS t, o AS open, h AS high, l AS low, c AS close, v AS volume, n AS trades FROM m1""")
def merge_partial_bars(spark, d):
    # two loads that both saw part of every minute, merged from their partial bars
    t = trades(spark, d)
    even, odd = (R.minute_bars(t.filter(F.col("seq") % 2 == k)) for k in (0, 1))
    return R.merge_partials(even.unionByName(odd)).select(
        "asset", epoch("bar_open").alias("t"), "open", "high", "low", "close", "volume", "trades"
    )


def _out(df):
    return df.select(
        "asset", "tf", epoch().alias("t"), "open", "high", "low", "close", "volume",
        r6("dollar_volume", 4).alias("dollar_volume"),
    )


@query("A3_rollup", with_bars("15m", "1h", "6h", "12h") + " " + " UNION ALL ".join(
    f"SELECT asset, '{tf}' AS tf, t, o AS open, h AS high, l AS low, c AS close, v AS volume,"
    f" round(dv, 4) AS dollar_volume FROM b_{tf}" for tf in ("15m", "1h", "6h", "12h")))
def rollup_all(spark, d):
    return _out(R.rollups(minutes(spark, d)))


@query("S11_all_assets_all_timeframes", with_bars("15m", "1h", "6h", "12h") + " " + " UNION ALL ".join(
    f"SELECT asset, '{tf}' AS tf, count(*) AS bars, min(t) AS first_t, max(t) AS last_t FROM b_{tf} GROUP BY asset"
    for tf in ("15m", "1h", "6h", "12h")))
def all_timeframes(spark, d):
    return R.rollups(minutes(spark, d)).groupBy("asset", "tf").agg(
        F.count(F.lit(1)).alias("bars"), F.min(epoch()).alias("first_t"), F.max(epoch()).alias("last_t")
    )


@query("A4_close_only_rollup", f"""WITH {MINUTES},
r AS (SELECT asset, (o_t // 3600) * 3600 AS b, arg_min(c, o_t) AS open, max(c) AS high, min(c) AS low,
             arg_max(c, o_t) AS close, sum(v) AS volume FROM m1 GROUP BY 1, 2)
SELECT r.asset, b AS t, open, high, low, close, volume FROM r
JOIN (SELECT asset, max(t) AS last_t FROM m1 GROUP BY 1) x ON x.asset = r.asset AND r.b + 3600 <= x.last_t""")
def close_only(spark, d):
    return R.close_only_rollup(minutes(spark, d), "1h").select(
        "asset", epoch("bar_open").alias("t"), "open", "high", "low", "close", "volume"
    )


@query("A5_candles_from_end", with_bars("1h") + """,
g AS (SELECT *, (max(i) OVER (PARTITION BY asset) - i) // 7 AS candle FROM b_1h)
SELECT asset, candle, min(t) - 3600 AS t0, max(t) AS t1, arg_min(o, i) AS open, max(h) AS high, min(l) AS low,
       arg_max(c, i) AS close, sum(v) AS volume FROM g GROUP BY asset, candle HAVING count(*) = 7""")
def candles_from_end(spark, d):
    return R.candles_from_end(bars(spark, d, "1h"), 7).select(
        "asset", "candle", epoch("bar_open").alias("t0"), epoch("bar_close").alias("t1"),
        "open", "high", "low", "close", "volume",
    )


@query("A6_interval_means", with_bars("15m") + """
SELECT asset, (t // 21600) * 21600 AS bucket, round(avg(c), 6) AS close, round(avg(v), 6) AS volume,
       round(avg(h - l), 6) AS span FROM b_15m GROUP BY 1, 2""")
def interval_means(spark, d):
    b = R.rollup(minutes(spark, d), "15m").withColumn("span", F.col("high") - F.col("low"))
    m = R.interval_means(b, 21600, ["close", "volume", "span"])
    return m.select("asset", epoch("bucket").alias("bucket"), *[r6(c).alias(c) for c in ("close", "volume", "span")])


@query("W41_fill_gaps", with_bars("15m") + """,
lim AS (SELECT asset, min(t) AS lo, max(t) AS hi FROM b_15m GROUP BY asset),
grid AS (SELECT asset, unnest(generate_series(lo, hi, 900)) AS t FROM lim),
j AS (SELECT g.asset, g.t, b.o, b.h, b.l, b.c, b.v,
             last_value(b.c IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.t
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
      FROM grid g LEFT JOIN b_15m b ON b.asset = g.asset AND b.t = g.t)
SELECT asset, t, coalesce(o, p) AS open, coalesce(h, p) AS high, coalesce(l, p) AS low, coalesce(c, p) AS close,
       coalesce(v, 0) AS volume, CASE WHEN c IS NULL THEN 1 ELSE 0 END AS gap_filled FROM j""")
def fill_gaps(spark, d):
    return R.fill_gaps(R.rollup(minutes(spark, d), "15m"), 900).select(
        "asset", epoch().alias("t"), "open", "high", "low", "close", "volume", "gap_filled"
    )


@query("P14_drop_unfinished_bars", with_bars("6h") + """
SELECT b.asset, b.t, b.c AS close FROM b_6h b
JOIN (SELECT asset, max(t) AS last_t FROM m1 GROUP BY 1) x ON x.asset = b.asset AND b.t <= x.last_t""")
def drop_unfinished(spark, d):
    one = minutes(spark, d)
    return R.drop_unfinished(R.rollup(one, "6h"), one).select("asset", epoch().alias("t"), "close")


_ASOF = """
SELECT s.asset, s.t, s.c AS close, x.t AS ctx_t, x.c AS close_6h, x.h AS high_6h
FROM b_15m s ASOF LEFT JOIN b_6h x ON x.asset = s.asset AND x.t {op} s.t"""


def _asof(spark, d, strict):
    one = minutes(spark, d)
    spine = R.rollup(one, "15m").select("asset", "bar_close", "close")
    ctx = R.rollup(one, "6h").select("asset", "bar_close", "close", "high")
    return asof(spine, ctx, strict=strict, suffix="_6h").select(
        "asset", epoch().alias("t"), "close", epoch("bar_close_ctx_6h").alias("ctx_t"), "close_6h", "high_6h"
    )


@query("J1_asof_strict", with_bars("15m", "6h") + _ASOF.replace("{op}", "<"))
def asof_strict(spark, d):
    return _asof(spark, d, True)


@query("J2_asof_inclusive", with_bars("15m", "6h") + _ASOF.replace("{op}", "<="))
def asof_inclusive(spark, d):
    return _asof(spark, d, False)


@query("J2_bucket_lookup", with_bars("15m", "6h") + """
SELECT s.asset, s.t, s.c AS close, x.c AS close_6h FROM b_15m s
LEFT JOIN b_6h x ON x.asset = s.asset AND x.t = (s.t // 21600) * 21600""")
def bucket(spark, d):
    one = minutes(spark, d)
    spine = R.rollup(one, "15m").select("asset", "bar_close", "close")
    ctx = R.rollup(one, "6h").select("asset", "bar_close", "close")
    return bucket_lookup(spine, ctx, 21600, suffix="_6h").select("asset", epoch().alias("t"), "close", "close_6h")
