import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import walk
from tickloom.operators import rollup as R
from tickloom.operators import screen as screen_module
from tickloom.plans import streams
from tickloom.plans.market import signals
from tickloom.plans.screen import with_targets
from tickloom.streaming import bars as B
from tickloom.streaming import live as V


def feed(spark, folder, frames):
    """One file per frame, in order, replayed one file per micro-batch."""
    for f in frames:
        spark.createDataFrame(f).coalesce(1).write.mode("append").parquet(folder)
    return B.trade_stream(spark, folder, spark.createDataFrame(frames[0]).schema, 1)


def run(spark, stream, out, mode="append"):
    q = (stream.writeStream.option("checkpointLocation", out + "_at").trigger(availableNow=True).outputMode(mode).format("parquet")
         .option("path", out).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).toPandas()


def test_late_and_repeated_bars(spark, tmp_path):
    t = pd.Timestamp("2024-01-01")
    rows = lambda *xs: pd.DataFrame([{"asset": "A", "bar_close": t + pd.Timedelta(minutes=m), "close": c, "arrival": a} for m, c, a in xs])
    frames = [rows((1, 1.0, 1), (2, 2.0, 2), (2, 2.5, 3)), rows((10, 10.0, 4)), rows((1, 99.0, 5), (12, 12.0, 6)), rows((30, 30.0, 7))]
    got = run(spark, B.closed_bars(feed(spark, str(tmp_path / "in"), frames), "1 minute"), str(tmp_path / "out"))
    seen = dict(zip(((got["bar_close"] - t).dt.total_seconds() // 60).astype(int), got["close"]))
    assert seen[2] == 2.5  # the later update stands
    assert seen[1] == 1.0  # an update behind the watermark is dropped
    assert set(seen) >= {1, 2, 10, 12} and 30 not in seen  # the newest bar is still open


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 600
    p = pd.DataFrame({"asset": rng.choice(["A", "B"], n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 86400, n)), unit="s"),
                      "seq": np.arange(n), "price": rng.integers(10, 99, n).astype(float), "volume": 1.0})
    s = feed(spark, str(tmp_path / "in"), [p.iloc[:200], p.iloc[200:400], p.iloc[400:]])
    got = run(spark, B.stream_rollup(B.stream_minutes(s, "0 seconds"), "1h"), str(tmp_path / "out"))
    want = R.rollup(R.minute_bars(spark.createDataFrame(p)), "1h").filter(F.col("bar_close") <= F.lit(p["ts"].max())).toPandas()
    a = got.sort_values(["asset", "bar_close"]).reset_index(drop=True)
    b = want.sort_values(["asset", "bar_close"]).reset_index(drop=True)
    for c in ("bar_close", "open", "high", "low", "close", "volume"):
        assert a[c].tolist() == b[c].tolist()


def test_a_repeated_batch_counts_once(spark, tmp_path):
    p = pd.DataFrame({"asset": "A", "ts": pd.date_range("2024-01-01", periods=10, freq="20s"), "seq": range(10), "price": 5.0, "volume": 1.0})
    store = B.PartialBars(str(tmp_path / "partials"))
    df = spark.createDataFrame(p)
    store.write(df.filter("seq < 5"), 0)
    for _ in range(2):  # the batch runs again after a failure
        store.write(df.filter("seq >= 5"), 1)
    assert store.bars(spark).agg(F.sum("volume")).first()[0] == 10.0


def test_stateful_limits_equal_the_loop(spark, tmp_path):
    p = walk(("A", "B"), 60)[["asset", "bar_close"]].copy()
    p["bar_index"] = p.groupby("asset").cumcount()
    p = p[p["bar_index"] % 5 != 1].sort_values("bar_close")
    cut = [p.iloc[:70], p.iloc[70:150], p.iloc[150:]]
    got = run(spark, V.limited(feed(spark, str(tmp_path / "in"), cut), 2, 2), str(tmp_path / "out"))
    for a, g in got.sort_values("bar_index").groupby("asset"):
        last, used = None, {}
        for r in g.itertuples():
            h = r.bar_close.floor("h")
            ok = (last is None or r.bar_index - last >= 2) and used.get(h, 0) < 2
            if ok:
                last, used[h] = r.bar_index, used.get(h, 0) + 1
            assert r.accepted == int(ok)


@pytest.mark.parametrize(("per_hour", "gap"), [(2, 2), (1, 5), (3, 1)])
def test_live_limits_in_batches_equal_the_loop(spark, tmp_path, monkeypatch, per_hour, gap):
    """Hours and spans cut by batches, and a batch that runs twice."""
    monkeypatch.setattr(screen_module, "SPAN_HOURS", 3)
    p = walk(("A", "B"), 60)[["asset", "bar_close"]].copy()
    p["bar_index"] = p.groupby("asset").cumcount()
    p = p[p["bar_index"] % 5 != 1].sort_values("bar_close")
    limits = V.LiveLimits(str(tmp_path / "out"), str(tmp_path / "state"), per_hour, gap)
    for k, part in enumerate([p.iloc[:17], p.iloc[17:18], p.iloc[18:150], p.iloc[:0], p.iloc[150:]]):
        batch = spark.createDataFrame(part, "asset string, bar_close timestamp, bar_index long")
        for _ in range(2 if k == 2 else 1):
            limits.write(batch, k)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(got) == len(p)
    for _, g in got.sort_values("bar_index").groupby("asset"):
        last, used = None, {}
        for r in g.itertuples():
            h = r.bar_close.floor("h")
            ok = (last is None or r.bar_index - last >= gap) and used.get(h, 0) < per_hour
            if ok:
                last, used[h] = r.bar_index, used.get(h, 0) + 1
            assert r.accepted == int(ok)


def test_no_task_gathers_a_span_of_a_replayed_table(spark, tmp_path, monkeypatch):
    """Every span is written as it is spread, the last one with a single row, and the spans come in order."""
    days = [t.to_pydatetime() for t in pd.date_range("2024-01-01", periods=90)]
    rows = [(k, k * 7919 % 1500, float(k * 37 % 5000) * 100 + 500, days[k % 60]) for k in range(6000)] + [(6000, 1, 700.0, days[89]), (6001, 1, 700.0, None)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz").repartition(5)
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    places = iter(range(100))
    monkeypatch.setattr(streams, "scratch", lambda spark, name: str(tmp_path / f"{name}.{next(places)}"))
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1g")  # a partition for each file
    try:
        got = streams.streamed_alerts(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    s = with_targets(signals(spark, str(tmp_path)).drop("evr", "median_r")).filter("ts IS NOT NULL")
    want = V.alerts(s).select("id", "tier").collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))
    spans = [f for f in (tmp_path / "stream_in.0").rglob("*.parquet")]
    assert len(spans) > 9  # five for each of the first two
    seen = []
    df = spark.createDataFrame([(k, days[k]) for k in range(30)], "id long, bar_close timestamp").repartition(4)
    streams.replay(spark, df, 3, "order", lambda batch, k: seen.append((k, sorted(r.id for r in batch.collect()))))
    assert seen == [(k, list(range(10 * k, 10 * k + 10))) for k in range(3)]
