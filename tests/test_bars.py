import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import back, same, to_bars, walk
from tickloom.functions.dates import parse_moment, parse_until
from tickloom.functions.sessions import session_columns
from tickloom.operators import rollup as R
from tickloom.operators.asof import asof, bucket_lookup, first_at_or_after
from tickloom.operators.quantile import exact_quantiles, quantile_buckets
from tickloom.sources import readers, store


@pytest.fixture(scope="module")
def trades(spark):
    rng = np.random.default_rng(5)
    n = 4000
    asset = np.where(rng.random(n) < 0.6, "HOT", rng.choice(["B", "C"], n))  # one asset with most rows
    t = pd.Timestamp("2024-03-01") + pd.to_timedelta(rng.integers(0, 3 * 86400, n), unit="s")
    return spark.createDataFrame(pd.DataFrame({"asset": asset, "ts": t, "seq": np.arange(n), "price": rng.integers(100, 200, n).astype(float),
                                               "volume": rng.integers(1, 9, n).astype(float)})).cache()


def test_minutes_and_rollup_match_pandas(trades):
    p = trades.toPandas().sort_values(["asset", "ts", "seq"])
    want = p.groupby(["asset", p["ts"].dt.floor("1h")]).agg(open=("price", "first"), high=("price", "max"), low=("price", "min"),
                                                           close=("price", "last"), volume=("volume", "sum")).reset_index()
    got = back(R.rollup(R.minute_bars(trades), "1h"))
    for c in ("open", "high", "low", "close", "volume"):
        same(got[c], want[c])
    assert (got["bar_open"] == want["ts"]).all()


def test_all_timeframes_in_one_pass(trades):
    m = R.minute_bars(trades)
    got = back(R.rollups(m), "tf", "asset", "bar_close")
    for tf in ("15m", "1h", "6h", "12h"):
        one = back(R.rollup(m, tf))
        part = got[got["tf"] == tf].reset_index(drop=True)
        same(part["close"], one["close"])
        same(part["dollar_volume"], one["dollar_volume"])


def test_a_trade_on_the_boundary_opens_the_next_bar(spark):
    t = spark.createDataFrame([("A", "2024-01-01 00:59:59.999999", 1, 5.0, 1.0), ("A", "2024-01-01 01:00:00", 2, 6.0, 1.0)],
                              "asset string, ts string, seq long, price double, volume double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = back(R.rollup(R.minute_bars(t), "1h"))
    assert got["close"].tolist() == [5.0, 6.0]
    assert got["bar_open"].dt.hour.tolist() == [0, 1]


def test_partial_bars_merge_in_any_order(trades):
    whole = back(R.minute_bars(trades), "asset", "bar_open")
    parts = [R.minute_bars(trades.filter(F.col("seq") % 3 == k)) for k in (2, 0, 1)]
    merged = back(R.merge_partials(parts[0].unionByName(parts[1]).unionByName(parts[2])), "asset", "bar_open")
    for c in ("open", "high", "low", "close", "volume", "trades"):
        same(whole[c], merged[c])


def test_gap_fill_across_days(trades):
    got = back(R.fill_gaps(R.minute_bars(trades), 60, span_seconds=7200), "asset", "bar_open")
    for _, g in got.groupby("asset"):
        step = g["bar_open"].diff().dropna().dt.total_seconds()
        assert (step == 60).all()
        gap = g["gap_filled"] == 1
        assert (g["volume"][gap] == 0).all() and gap.any()
        assert (g["close"][gap] == g["close"].shift()[gap]).all() and (g["open"][gap] == g["close"][gap]).all()


def test_asof_ties_and_first_rows(spark):
    s = spark.createDataFrame([("A", 5, 1), ("A", 10, 2), ("A", 15, 3), ("B", 10, 4)], "asset string, t long, id int").withColumn("bar_close", F.timestamp_seconds("t")).drop("t")
    c = spark.createDataFrame([("A", 10, 1.0), ("A", 12, 2.0)], "asset string, t long, v double").withColumn("bar_close", F.timestamp_seconds("t")).drop("t")
    for span in (3, 86400):
        near = back(asof(s, c, span_seconds=span), "id")["v"].tolist()
        before = back(asof(s, c, strict=True, span_seconds=span), "id")["v"].tolist()
        assert near[1:3] == [1.0, 2.0] and np.isnan(near[0]) and np.isnan(near[3])
        assert before[2] == 2.0 and np.isnan(before[1])


@pytest.mark.parametrize("span", [1800, 86400])
def test_asof_matches_pandas(trades, span):
    m = R.minute_bars(trades)
    spine = R.rollup(m, "15m").select("asset", "bar_close", "close")
    ctx = R.rollup(m, "6h").select("asset", "bar_close", F.col("close").alias("c6"))
    got = back(asof(spine, ctx, span_seconds=span))
    want = pd.merge_asof(spine.toPandas().sort_values("bar_close"), ctx.toPandas().sort_values("bar_close"), on="bar_close", by="asset")
    same(got["c6"], want.sort_values(["asset", "bar_close"])["c6"])
    assert back(bucket_lookup(spine, ctx, 21600)).shape[0] == got.shape[0]


def test_first_at_or_after(spark):
    marks = spark.createDataFrame([(10,), (20,)], "t long").select(F.timestamp_seconds("t").alias("at"))
    want = spark.createDataFrame([(1, 5), (2, 10), (3, 11), (4, 21)], "id int, t long").select("id", F.timestamp_seconds("t").alias("at"))
    got = first_at_or_after(want, marks, "at", "hit").select("id", F.unix_seconds("hit").alias("h")).orderBy("id").collect()
    assert [r["h"] for r in got] == [10, 10, 20, None]


def test_exact_quantiles_and_tied_buckets(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"k": rng.choice(["a", "b"], 900), "x": rng.integers(0, 30, 900).astype(float)})
    df = spark.createDataFrame(p)
    got = exact_quantiles(df, "x", (0.05, 0.5, 0.93), ("k",)).toPandas()
    for r in got.itertuples():
        assert r.value == pytest.approx(p[p["k"] == r.k]["x"].quantile(r.q))
    mine = quantile_buckets(df, "x", 10, "b").toPandas()
    assert (mine["b"] - 1 == pd.qcut(mine["x"], 10, labels=False, duplicates="drop")).all()


def test_quantiles_with_one_value_filling_half_the_column(spark):
    x = np.concatenate([np.zeros(500), np.random.default_rng(2).normal(size=501)])
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame({"x": x})).repartition(7), "x", (0.0, 0.1, 0.33, 0.5, 0.9, 1.0)).toPandas()
    for r in got.itertuples():
        assert r.value == pytest.approx(np.quantile(x, r.q))


def test_sessions_follow_daylight_saving(spark):
    stamps = ["2024-01-15 07:00:00", "2024-07-15 06:00:00", "2024-03-31 06:00:00", "2024-10-27 07:00:00", "2024-01-15 13:30:00",
              "2024-01-15 16:00:00", "2024-01-15 20:00:00", "2024-01-15 06:00:00", "2024-01-15 05:59:00"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "id int, s string").withColumn("bar_close", F.col("s").cast("timestamp"))
    got = session_columns(df).orderBy("id").toPandas()
    assert got["minutes_since_london_open"].tolist()[:4] == [0, 0, 0, 0]
    assert got["session_name"].tolist() == ["london", "london", "london", "london", "overlap", "ny", "off_hours", "off_hours", "off_hours"]
    assert got["session_bucket"].tolist()[4:] == ["overlap", "dead_zone", "dead_zone", "pre_expansion", "dead_zone"]
    assert got["session_weight"].tolist()[3:7] == [1.0, 1.1, 1.0, 0.2]


def test_dates(spark):
    rows = ["2024-01-02", "2024-01-02T03:04:05", "2024-01-02T03:04:05+02:00", "junk"]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select(F.unix_seconds(parse_moment("s")).alias("a"), F.unix_seconds(parse_until("s")).alias("b")).collect()
    assert [r["a"] for r in got] == [1704153600, 1704164645, 1704157445, None]
    assert got[0]["b"] == 1704153600 + 86399


def test_bar_text_is_checked(spark, tmp_path):
    f = tmp_path / "bars.csv"
    f.write_text("timestamp,open,high,low,close,volume\n60,1,2,0.5,1.5,3\n120,x,2,1,1,1\n180,1,2,1,,1\n")
    got = readers.read_bars_csv(spark, str(f)).collect()
    assert [r["timestamp"] for r in got] == [60]
    with pytest.raises(ValueError):
        readers.parse_bars(spark.createDataFrame([("1",)], "timestamp string"))


@pytest.mark.parametrize("scale", [1, 10**3, 10**6, 10**9])
def test_epoch_unit_is_found(spark, scale):
    base = [1704067200 + 60 * i for i in range(30)]
    df = spark.createDataFrame([(str(b * scale),) for b in base], "timestamp string")
    assert sorted(r[0] for r in readers.normalise_time(df).select(F.unix_seconds("dt")).collect()) == base


def test_integrity_report_sees_disorder(spark):
    p = walk(("A",), 5)
    p["arrival"] = np.arange(len(p))
    p.loc[3, "bar_close"], p.loc[4, "bar_close"] = p.loc[4, "bar_close"], p.loc[3, "bar_close"]
    p.loc[6, "high"] = 1.0
    r = readers.integrity_report(spark.createDataFrame(p), arrival="arrival").first()
    assert (r["backward_steps"], r["is_monotonic"], r["is_unique"], r["invalid"]) == (1, 0, 1, 1)


def test_feature_table_upsert(spark, tmp_path):
    t = store.FeatureTable(spark, str(tmp_path / "f"))
    df = spark.createDataFrame(walk(("A",), 60)).select("asset", "bar_close", "close")
    t.save(df)
    day = F.col("bar_close") > F.lit("2024-01-02 00:00:00").cast("timestamp")
    t.save(df.filter(day).withColumn("close", F.lit(1.0)))
    got = back(t.load())
    assert got.shape[0] == df.count()
    assert (got["close"][got["bar_close"] > "2024-01-02"] == 1.0).all() and (got["close"][got["bar_close"] <= "2024-01-02"] != 1.0).all()
    assert t.slice("2024-01-01 06:00:00", "2024-01-01 07:00:00").count() == 5
    with pytest.raises(ValueError):
        t.save(df, required=("absent",))
    t.drop()
    assert not t.exists()


def test_limited_fill(spark):
    p = walk(("A",), 4)
    x = [1.0, None, None, None, 5.0, None, None, None, None, None, 11.0, None]
    df = to_bars(spark, p).join(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "row_idx long, x double"), "row_idx")
    plain = back(R.limited_ffill(df, ["x"], 2))["x"]
    same(plain, pd.Series(x, dtype=float).ffill(limit=2))
    lined = back(R.limited_ffill(df, ["x"], 2, interpolate=True))["x"]
    same(lined, pd.Series(x, dtype=float).interpolate(limit=2).ffill(limit=2))
