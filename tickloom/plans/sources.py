"""Sources, sinks and stores, fed from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import rollup as R
from tickloom.operators.series import pin, shared_folder
from tickloom.plans.features import show
from tickloom.plans.ledger import neat
from tickloom.plans.market import LEDGER, MINUTES, TRADES, WITH_LEDGER, bars, ledger, minutes, table, trades, with_bars
from tickloom.plans.registry import query
from tickloom.sources import readers as S
from tickloom.sources import sinks
from tickloom.sources import store as T


def scratch(spark, name):
    """A fresh folder in the cluster's shared folder."""
    return f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"


@query("S1_bars_csv", with_bars("15m") + "\nSELECT t, o AS open, h AS high, l AS low, c AS close, v AS volume FROM b_15m WHERE v >= 20")
def bars_csv(spark, d):
    b = R.rollup(minutes(spark, d), "15m")
    path = scratch(spark, "bars_csv")
    volume = F.when(F.col("volume") >= 20, F.col("volume").cast("string")).otherwise("n/a")  # bad numbers drop the row
    b.select(F.unix_seconds("bar_close").alias("timestamp"), "open", "high", "low", "close", volume.alias("volume")).write.option("header", "true").csv(path)
    return S.read_bars_csv(spark, path).withColumnRenamed("timestamp", "t")


@query("S2_time_normalised", "SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000 AS from_ms FROM events")
def time_normalised(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("time"))
    out = S.normalise_time(e)
    return out.select("event_id", F.col("time").cast("long").alias("ms"), F.unix_millis("dt").alias("from_ms"))


@query("S3_distinct_trades", f"""WITH {TRADES}
SELECT DISTINCT asset, epoch_us(ts) AS us, price, volume, side FROM trades WHERE ts <= TIMESTAMP '2024-01-25 00:00:00'""")
def distinct_trades(spark, d):
    t = trades(spark, d)
    twice = t.unionByName(t.filter(F.col("seq") % 3 == 0))
    return S.distinct_trades(twice, "2024-01-25 00:00:00").select("asset", F.unix_micros("ts").alias("us"), "price", "volume", "side")


@query("S4_exchange_rows", f"WITH {MINUTES}\nSELECT asset, t, o AS open, h AS high, l AS low, c AS close, v AS volume FROM m1")
def exchange_rows(spark, d):
    m = minutes(spark, d)
    row = F.to_json(F.array(*[c.cast("string") for c in (F.unix_seconds("bar_close"), F.col("open"), F.col("high"), F.col("low"), F.col("close"),
                                                         F.lit(0.0), F.col("volume"), F.col("trades"))]))
    raw = m.select("asset", row.alias("row"), F.lit(0).alias("seq"))
    again = raw.withColumns({"seq": F.lit(1), "row": F.regexp_replace("row", '"0.0"', '"1.0"')})
    broken = raw.withColumns({"row": F.lit('["x"]'), "seq": F.lit(2)})
    return S.exchange_rows(raw.unionByName(again).unionByName(broken))


@query("S5_newer_rows", f"""WITH {TRADES},
hw AS (SELECT asset, max(ts) AS m FROM trades WHERE ts < TIMESTAMP '2024-01-20' AND asset <> 'view' GROUP BY 1)
SELECT t.seq AS event_id, t.asset FROM trades t LEFT JOIN hw ON hw.asset = t.asset WHERE hw.m IS NULL OR t.ts >= hw.m + INTERVAL 60 SECOND""")
def newer_rows(spark, d):
    t = trades(spark, d)
    stored = t.filter((F.col("ts") < F.lit("2024-01-20").cast("timestamp")) & (F.col("asset") != "view"))
    return T.newer_rows(t, stored, interval_seconds=60).select(F.col("seq").alias("event_id"), "asset")


@query("S6_integrity_report", with_bars("1h") + """
SELECT asset, count(*) AS rows, count(DISTINCT t) AS stamps, count(*) FILTER (v < 50 OR h < greatest(o, c)) AS invalid, 0 AS backward_steps, 1 AS is_unique, 1 AS is_monotonic FROM b_1h GROUP BY 1""")
def integrity(spark, d):
    b = bars(spark, d, "1h").withColumn("volume", F.when(F.col("volume") >= 50, F.col("volume")).otherwise(-1.0))
    out = S.integrity_report(b, arrival="row_idx")
    return neat(out.select("asset", "rows", "stamps", "invalid", "backward_steps", "is_unique", "is_monotonic"))


@query("S7_trimmed_window", with_bars("1h") + "\nSELECT asset, t, c AS close FROM b_1h WHERE t BETWEEN 1704844800 AND 1705449600")
def trimmed(spark, d):
    return show(S.trim(R.rollup(minutes(spark, d), "1h"), "2024-01-10 00:00:00", "2024-01-17 00:00:00"), ["close"])


@query("S8_bar_sink", with_bars("1h", "6h") + " SELECT asset, '1h' AS tf, t, c AS close FROM b_1h UNION ALL SELECT asset, '6h', t, c FROM b_6h")
def bar_sink(spark, d):
    one, path = minutes(spark, d), scratch(spark, "bars")
    T.write_bars(R.rollup(one, "1h"), path, "overwrite")
    T.write_bars(R.rollup(one, "6h"), path, "append")
    return spark.read.parquet(path).select("asset", "tf", F.unix_seconds("bar_close").alias("t"), "close")


@query("S9_feature_upsert", with_bars("1h") + """
SELECT asset, t, round(CASE WHEN t > 1705276800 THEN c + 1000 ELSE c END, 2) AS close, CASE WHEN t > 1705276800 THEN v END AS extra FROM b_1h""")
def upsert(spark, d):
    b = pin(R.rollup(minutes(spark, d), "1h").select("asset", "bar_close", "close", "volume"))
    store = T.FeatureTable(spark, scratch(spark, "features"))
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    store.save(b.drop("volume"), "overwrite", required=("close",))
    store.save(b.filter(F.col("bar_close") > cut).select("asset", "bar_close", (F.col("close") + 1000).alias("close"), F.col("volume").alias("extra")))
    return store.load().select("asset", F.unix_seconds("bar_close").alias("t"), F.round("close", 2).alias("close"), "extra")


@query("S10_feature_slice", with_bars("1h") + "\nSELECT asset, t, c AS close FROM b_1h WHERE t BETWEEN 1704844800 AND 1705449600")
def feature_slice(spark, d):
    store = T.FeatureTable(spark, scratch(spark, "slice"))
    store.save(R.rollup(minutes(spark, d), "1h"), "overwrite")
    return show(store.slice("2024-01-10 00:00:00", "2024-01-17 00:00:00"), ["close"])


_EVENT_TEXT = """SELECT event_id, event_type, ts, value, user_id FROM events"""


def payloads(spark, d):
    """Events as nested records, the way an event log holds them."""
    e = table(spark, d, "events")
    u = F.col("user_id")
    body = F.struct(
        F.when(u % 2 == 0, F.concat(F.lit("A"), (u % 3).cast("string"))).alias("asset"),
        F.when(u % 2 == 1, F.concat(F.lit("B"), (u % 3).cast("string"))).alias("symbol"),
        F.when(u % 5 != 0, "A+").alias("tier"), F.when(F.col("value") > 10, F.col("value")).alias("confluence"),
        F.struct(
            F.struct(F.lit("B").alias("tier"), (F.col("value") * 2).alias("confluence")).alias("final_decision"),
            F.struct(F.lit("trend").alias("regime_state"), (F.col("value") / 1000).alias("p_regime_trend")).alias("regime"),
            F.struct((F.col("value") / 500).alias("hazard_score")).alias("hazard")).alias("reasoning"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type"), u.cast("string").alias("trade_id"), F.to_json(body).alias("payload"))


_EV = """ev AS (SELECT event_id, event_type, ts, CAST(user_id AS VARCHAR) AS trade_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END || CAST(user_id % 3 AS VARCHAR) AS asset,
  CASE WHEN user_id % 5 <> 0 THEN 'A+' ELSE 'B' END AS tier, CASE WHEN value > 10 THEN value ELSE value * 2 END AS confluence, value / 1000 AS p_regime_trend, value / 500 AS hazard FROM events)"""


@query("S13_event_log", f"""WITH {_EV}
SELECT event_id, asset, tier, round(confluence, 6) AS confluence, 'trend' AS regime_state, round(p_regime_trend, 6) AS p_regime_trend, round(hazard, 6) AS hazard,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' || event_type || ' | ' || asset || ' | ' || trade_id AS event_label FROM ev""")
def event_log(spark, d):
    out = S.flatten_events(payloads(spark, d))
    return neat(out.select("event_id", "asset", "tier", "confluence", "regime_state", "p_regime_trend", "hazard", "event_label"))


@query("F26_nested_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing.path'), event_type) AS fallback FROM events")
def nested_fields(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"),
                    F.coalesce(F.get_json_object("props", "$.missing.path"), "event_type").alias("fallback"))


@query("P9_event_filter", f"""WITH {_EV}
SELECT event_id, trade_id, asset FROM ev WHERE event_type IN ('click', 'purchase') AND asset IN ('A0', 'B1') AND confluence >= 15 AND contains(lower(trade_id), '1')""")
def event_filter(spark, d):
    e = S.flatten_events(payloads(spark, d))
    return S.select_events(e, ("click", "purchase"), ("A0", "B1"), "1", {"confluence": 15.0}).select("event_id", "trade_id", "asset")


@query("A20_event_throughput", "SELECT (epoch_us(ts) // 900000000) * 900 AS t, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def throughput(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "15 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(
        F.unix_seconds("w.start").alias("t"), "event_type", "events")


@query("K6_latest_candidates", """SELECT event_id, CASE WHEN event_type = 'error' OR value > 30 THEN 'rejected' ELSE 'executable' END AS status FROM events
WHERE event_type IN ('error', 'click') ORDER BY ts DESC, event_id DESC LIMIT 5""")
def latest_candidates(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("error", "click"))
    kind = F.when(F.col("event_type") == "error", "scanner").otherwise("signal")
    out = S.candidate_signals(e.withColumns({"event_type": kind, "rejected": F.col("value") > 30}), 5)
    return out.select("event_id", "status")


@query("S14_report_bundle", WITH_LEDGER + """
SELECT 'daily' AS name, count(DISTINCT CAST(entry_ts AS DATE)) AS rows FROM led UNION ALL SELECT 'monthly', count(DISTINCT strftime(entry_ts, '%Y-%m')) FROM led
UNION ALL SELECT 'ledger', count(*) FROM led UNION ALL SELECT 'equity', count(*) FROM led UNION ALL SELECT 'execution_log', 2 * count(*) FROM led UNION ALL SELECT 'summary', 1""")
def report_bundle(spark, d):
    path = scratch(spark, "report")
    sinks.write_report(ledger(spark, d), path)
    out = None
    for name in ("ledger", "daily", "monthly", "equity", "execution_log", "summary"):
        part = spark.read.json(f"{path}/{name}") if name == "summary" else spark.read.parquet(f"{path}/{name}")
        n = part.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


@query("S15_metric_records", WITH_LEDGER + """
SELECT replace(tier, ' ', '_') AS model, session AS version, round(avg(conf), 6) AS cv_score FROM led GROUP BY 1, 2""")
def metric_records(spark, d):
    path = scratch(spark, "metrics")
    m = ledger(spark, d).groupBy(F.regexp_replace("tier", " ", "_").alias("model"), F.col("session").alias("version")).agg(
        F.round(F.avg("conf"), 6).alias("cv_score"))
    m.repartition("model", "version").write.partitionBy("model", "version").json(path)
    out = S.read_metrics(spark, f"{path}/*/*/*.json")
    strip = lambda c: F.regexp_replace(F.url_decode(c), "^[a-z]+=", "")
    return out.select(strip("model").alias("model"), strip("version").alias("version"), "cv_score")


@query("A38_class_share", WITH_LEDGER + """
SELECT tier AS model, round(count(*) FILTER (pnl > 0) / count(*), 6) AS positive_share FROM led GROUP BY 1""")
def class_share(spark, d):
    g = ledger(spark, d).groupBy(F.col("tier").alias("model")).agg(
        F.count_if(F.col("pnl") > 0).alias("p"), F.count_if(F.col("pnl") <= 0).alias("n"))
    counts = F.create_map(F.lit("1"), F.col("p"), F.lit("0"), F.col("n"))
    return neat(S.class_share(g.withColumn("class_counts", counts)).select("model", "positive_share"))


@query("S16_replay_export", with_bars("15m") + ", " + LEDGER + """,
x AS (SELECT event_id, event_type AS asset, ts FROM events)
SELECT x.event_id AS trade_id, x.asset, b.i AS entry_idx, strftime(x.ts, '%Y-%m-%dT%H:%M:%S') AS entry_dt FROM x ASOF LEFT JOIN b_15m b ON b.asset = x.asset AND b.t <= floor(epoch(x.ts))""")
def replay_export(spark, d):
    b = pin(bars(spark, d, "15m"))
    t = trades(spark, d)
    none = F.lit(None).cast("double")
    led = t.select(F.col("seq").alias("trade_id"), "asset", F.date_trunc("second", "ts").alias("entry_ts"), F.date_trunc("second", "ts").alias("exit_ts"), F.lit("long").alias("side"),
                   F.lit("core").alias("leg"), F.lit("A").alias("tier"), F.col("price").alias("entry_price"), F.col("price").alias("exit_price"),
                   *[none.alias(c) for c in ("stop_price", "pnl", "r", "conf", "evr")], *[F.lit("").alias(c) for c in ("reason", "session", "regime")])
    path = scratch(spark, "replay")
    sinks.replay_bars(b).write.json(f"{path}/bars")
    sinks.replay_trades(led, b).write.json(f"{path}/trades")
    return spark.read.schema("trade_id long, asset string, entry_idx long, entry_dt string").json(f"{path}/trades")


@query("S16_replay_equity", WITH_LEDGER + """,
e AS (SELECT *, 1e9 + sum(pnl) OVER o AS eq, row_number() OVER o - 1 AS idx FROM led WINDOW o AS (ORDER BY entry_ts, trade_id ROWS UNBOUNDED PRECEDING))
SELECT idx, strftime(entry_ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, round(eq, 2) AS equity, round(eq - max(eq) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING), 2) AS drawdown FROM e""")
def replay_equity(spark, d):
    path = scratch(spark, "replay")
    sinks.replay_equity(ledger(spark, d), 1e9).write.json(f"{path}/equity")
    return neat(spark.read.schema("idx long, timestamp string, equity double, drawdown double").json(f"{path}/equity"), 2)


@query("J5_merge_stored", with_bars("1h") + "\nSELECT asset, t, c AS close, CASE WHEN v >= 50 THEN c END AS close_stored, CASE WHEN v >= 50 THEN v END AS volume FROM b_1h")
def merge_stored(spark, d):
    b = pin(R.rollup(minutes(spark, d), "1h"))
    base = b.select("asset", "bar_close", "close")
    return show(T.merge_into(base, b.filter(F.col("volume") >= 50).select("asset", "bar_close", "close", "volume"), ("asset", "bar_close"),
                             suffix="_stored"), ["close", "close_stored", "volume"])


@query("J6_full_merge", with_bars("1h") + """
SELECT asset, t, round(CASE WHEN v >= 50 THEN c + 1 ELSE c END, 2) AS close FROM b_1h WHERE v < 200 OR v >= 50""")
def full_merge(spark, d):
    b = pin(R.rollup(minutes(spark, d), "1h").select("asset", "bar_close", "close", "volume"))
    a = b.filter(F.col("volume") < 200).select("asset", "bar_close", "close")
    n = b.filter(F.col("volume") >= 50).select("asset", "bar_close", (F.col("close") + 1).alias("close"))
    return show(T.merge_features(a, n, ("asset", "bar_close")), ["close"])


@query("A36_market_headline", with_bars("15m") + """,
n AS (SELECT *, max(i) OVER (PARTITION BY asset) AS last_i, c / nullif(lag(c) OVER (PARTITION BY asset ORDER BY i), 0) - 1 AS ret FROM b_15m),
w AS (SELECT * FROM n WHERE i > last_i - 96),
s AS (SELECT asset, stddev_pop(ret) * 100 AS vol FROM n WHERE i > last_i - 1200 + 1 GROUP BY 1)
SELECT w.asset, round((arg_max(c, i) / arg_min(c, i) - 1) * 100, 6) AS change_pct, round((max(h) - min(l)) / greatest(arg_max(c, i), 1e-9) * 100, 6) AS range_pct,
  round(sum(v), 2) AS volume, round(any_value(vol), 6) AS realized_vol FROM w JOIN s USING (asset) GROUP BY 1""")
def headline(spark, d):
    return neat(R.market_headline(bars(spark, d, "15m")), volume=2)


@query("F1_epoch_and_floor", "SELECT event_id, epoch_us(ts) // 1000000 AS epoch, (epoch_us(ts) // 3600000000) * 3600 AS hour_t, ((epoch_us(ts) + 899999999) // 900000000) * 900 AS end_t FROM events")
def epoch_and_floor(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", F.unix_seconds("ts").alias("epoch"), F.unix_seconds(R.floor_time("ts", 3600)).alias("hour_t"),
                    F.unix_seconds(R.ceil_time("ts", 900)).alias("end_t"))


@query("F2_parsed_dates", """SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS naive_utc, epoch(o_orderdate)::BIGINT - 19800 AS with_offset, epoch(o_orderdate)::BIGINT + 86399 AS day_end FROM orders""")
def parsed_dates(spark, d):
    from tickloom.functions.dates import parse_moment, parse_until

    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(F.col("o_orderkey").alias("id"), F.unix_seconds(parse_moment(day)).alias("naive_utc"),
                    F.unix_seconds(parse_moment(F.concat(day, F.lit("T00:00:00+05:30")))).alias("with_offset"), F.unix_seconds(parse_until(day)).alias("day_end"))


@query("F6_math", """SELECT o_orderkey AS id, round(least(300.0, greatest(100.0, o_totalprice / 997.0)), 6) AS clipped, CAST(sign(o_totalprice - 250000) AS BIGINT) AS sgn,
  round(ln(o_totalprice), 6) AS logged, round(1 / (1 + exp(-least(20, greatest(-20, (o_totalprice - 250000) / 9970)))), 6) AS squashed, round(exp(-(o_custkey % 30) / 8.0), 6) AS faded,
  round(o_totalprice / nullif(o_custkey % 5, 0), 4) AS ratio FROM orders""")
def math(spark, d):
    from tickloom.functions.scalar import clip, decay, safe_div, sigmoid

    o = table(spark, d, "orders")
    p, c = F.col("o_totalprice"), F.col("o_custkey")
    return neat(o.select(F.col("o_orderkey").alias("id"), clip(p / 997.0, F.lit(100.0), F.lit(300.0)).alias("clipped"),
                         F.signum(p - 250000).cast("long").alias("sgn"), F.ln(p).alias("logged"), sigmoid((p - 250000) / 9970).alias("squashed"),
                         decay(c % 30, 8.0).alias("faded"), safe_div(p, c % 5).alias("ratio")), ratio=4)
