"""Streaming queries run to the end of their input; the results are those of the batch functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.operators import rollup as R
from tickloom.operators.series import pin
from tickloom.plans import sqltext as q
from tickloom.plans.features import show
from tickloom.plans.ledger import neat
from tickloom.plans.market import MINUTES, TRADES, minutes, signals, table, trades, with_bars
from tickloom.plans.registry import query
from tickloom.plans.screen import _CONF, _EVR, _SCREEN, with_targets  # noqa: F401
from tickloom.plans.sources import scratch
from tickloom.streaming import bars as B
from tickloom.streaming import live as V


def event_stream(spark, d):
    """The events table as a stream of trades."""
    schema = table(spark, d, "events").schema
    raw = B.trade_stream(spark, d, schema, pattern="events.parquet")
    return raw.select(
        F.col("event_type").alias("pair"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.round(F.col("value") + 1, 2).alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"),
        F.when(F.col("user_id") % 2 == 0, "b").otherwise("s").alias("side"))


def stored_stream(spark, df):
    """A frame written at once and read back as a stream."""
    path = scratch(spark, "stream_in")
    df.filter(F.col("bar_close").isNotNull()).write.parquet(path)
    return B.trade_stream(spark, path, df.schema)


def drain(spark, stream, name, sink=None, folders=None):
    """Run until the input is used up and return what was written; the same ``folders`` (output, checkpoint) go on with a stream."""
    out, at = folders or (scratch(spark, name), scratch(spark, name + "_at"))
    w = stream.writeStream.option("checkpointLocation", at).trigger(availableNow=True)
    if sink is None:
        w.format("parquet").option("path", out).outputMode("append").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    w.foreachBatch(sink).start().awaitTermination()
    return None


def replay(spark, df, spans, name, sink=None, build=lambda stream: stream):
    """``df`` arrives in ``spans`` successive spans of time; each is a micro-batch of one stream, used up before the next one is written.

    A span has a file for every task that holds some of its rows, so that no task gathers it.  Returns what was written.
    """
    path, folders = scratch(spark, "stream_in"), (scratch(spark, name), scratch(spark, name + "_at"))
    df = pin(df)
    t = F.unix_micros("bar_close")
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    step = (hi - lo) // spans + 1
    for k in range(spans):
        df.filter((t >= lo + k * step) & (t < lo + (k + 1) * step)).write.mode("append").parquet(path)
        done = drain(spark, build(B.trade_stream(spark, path, df.schema)), name, sink, folders)
    return done


def traded(spark, d):
    return event_stream(spark, d).withColumnRenamed("pair", "asset")


@query("T1_aliased_trades", f"WITH {TRADES}\nSELECT seq, CASE asset WHEN 'click' THEN 'XBT' WHEN 'view' THEN 'ETH' ELSE asset END AS asset, price FROM trades")
def aliased(spark, d):
    events = table(spark, d, "events").select(F.col("event_type").alias("pair")).distinct()
    aliases = events.filter(F.col("pair").isin("click", "view")).withColumn("asset", F.when(F.col("pair") == "click", "XBT").otherwise("ETH"))
    return drain(spark, B.with_asset(event_stream(spark, d), aliases).select("seq", "asset", "price"), "aliased")


@query("T2_closed_bars", f"""WITH {MINUTES}, mx AS (SELECT max(t) AS last_t FROM m1)
SELECT asset, t, c AS close FROM m1, mx WHERE t <= last_t""")
def closed(spark, d):
    m = minutes(spark, d).select("asset", "bar_close", "close")
    # every bar is sent twice; the second update carries the final close
    updates = m.withColumns({"close": F.col("close") - 1, "arrival": F.lit(1)}).unionByName(m.withColumn("arrival", F.lit(2)))
    out = drain(spark, B.closed_bars(stored_stream(spark, updates), "0 seconds"), "closed")
    return out.select("asset", F.unix_seconds("bar_close").alias("t"), "close")


@query("T3_streamed_rollup", with_bars("15m") + """, mx AS (SELECT max(epoch_us(ts)) AS u FROM events)
SELECT asset, t, o AS open, h AS high, l AS low, c AS close, v AS volume FROM b_15m, mx WHERE t * 1000000 <= (u // 1000) * 1000""")
def rolled(spark, d):
    out = drain(spark, B.stream_rollup(B.stream_minutes(traded(spark, d), "0 seconds"), "15m"), "rolled")
    return out.select("asset", F.unix_seconds("bar_close").alias("t"), "open", "high", "low", "close", "volume")


@query("T4_deduplicated", f"WITH {TRADES}\nSELECT DISTINCT seq, asset, price FROM trades")
def deduplicated(spark, d):
    t = trades(spark, d).withColumn("bar_close", F.col("ts"))
    twice = t.unionByName(t.filter(F.col("seq") % 4 == 0))
    out = drain(spark, B.without_duplicates(stored_stream(spark, twice), ["asset", "seq"]), "dedupe")
    return out.select("seq", "asset", "price")


@query("T5_live_features", with_bars("1h") + ", " + q.true_range("b_1h", "a") + f"""
SELECT asset, t, round(atr, 6) AS atr, round({q.roll('avg', 'c', 16)}, 6) AS close_rmean16 FROM a""")
def live_features(spark, d):
    b = R.rollup(minutes(spark, d), "1h")
    out = scratch(spark, "live")
    live = V.LiveFeatures(scratch(spark, "live_bars"), out, lambda x: X.rolling_stats(X.atr(x), ["close"], [16]), reach=40)
    replay(spark, b, 3, "live", live.write)
    return show(spark.read.parquet(out), ["atr", "close_rmean16"])


@query("T6_streamed_alerts", _SCREEN + "\nSELECT id, tier FROM w1 WHERE gp = 1 AND tier IN ('A+', 'A', 'B')")
def streamed_alerts(spark, d):
    s = with_targets(signals(spark, d).drop("evr", "median_r")).withColumnRenamed("ts", "bar_close")
    return replay(spark, s, 3, "alerts", build=lambda stream: V.alerts(stream).select("id", "tier"))


@query("T7_stateful_limits", q.spaced(with_bars("15m"), "SELECT asset, i, t FROM b_15m WHERE c > o", 2, 2) + """
SELECT asset, i AS bar_index, t, accepted FROM decided""")
def limits(spark, d):
    b = R.indexed_rollup(minutes(spark, d), "15m").filter(F.col("close") > F.col("open"))
    s = b.select("asset", F.col("row_idx").alias("bar_index"), "bar_close")
    out = scratch(spark, "limits_out")
    replay(spark, s, 3, "limits", V.LiveLimits(out, scratch(spark, "limits_state")).write)
    return spark.read.parquet(out).select("asset", "bar_index", F.unix_seconds("bar_close").alias("t"), F.col("accepted").cast("long").alias("accepted"))


@query("T8_incremental_bars", f"WITH {MINUTES}\nSELECT asset, o_t AS t, o AS open, h AS high, l AS low, c AS close, v AS volume, n AS trades FROM m1")
def incremental(spark, d):
    t = trades(spark, d).withColumn("bar_close", F.col("ts"))
    store = B.PartialBars(scratch(spark, "partials"))
    replay(spark, t, 3, "partials_run", store.write)
    return store.bars(spark).select("asset", F.unix_seconds("bar_open").alias("t"), "open", "high", "low", "close", "volume", "trades")


@query("T9_streamed_gap_fill", with_bars("15m") + """,
lim AS (SELECT asset, min(t) AS lo, max(t) AS hi FROM b_15m GROUP BY asset), grid AS (SELECT asset, unnest(generate_series(lo, hi, 900)) AS t FROM lim),
j AS (SELECT g.asset, g.t, b.c, b.v, last_value(b.c IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
  FROM grid g LEFT JOIN b_15m b ON b.asset = g.asset AND b.t = g.t)
SELECT asset, t, coalesce(c, p) AS close, coalesce(v, 0) AS volume, CASE WHEN c IS NULL THEN 1 ELSE 0 END AS gap_filled FROM j""")
def gap_filled(spark, d):
    b = R.rollup(minutes(spark, d), "15m").select("asset", "bar_open", "bar_close", "open", "high", "low", "close", "volume")
    path = scratch(spark, "filled")
    replay(spark, b, 3, "filled_run", B.FilledBars(path, 900).write)
    return neat(spark.read.parquet(path).select("asset", F.unix_seconds("bar_close").alias("t"), "close", "volume", "gap_filled"))
