"""Missing values in averages, large sequence numbers, tables stored as directories, stores that gain columns."""

import datetime as dt

import pandas as pd
from conftest import SMALL

from tickloom.operators import rollup
from tickloom.operators.series import BARS, IDX, ema
from tickloom.plans import streams
from tickloom.plans.ledger import pivot_max, signal_ranking
from tickloom.sources.store import FeatureTable


def averaged(spark, values, spans, block=4):
    rows = [("A", "1h", i, None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"asset string, tf string, {IDX} long, close double")
    out = ema(df, spans, lane=BARS.sized(block)).orderBy(IDX).toPandas()
    return {n: [None if pd.isna(x) else round(x, 9) for x in out[n]] for n in spans}


def plain(values, span):
    a, level, out = 2 / (span + 1), None, []
    for v in values:
        if v is not None:
            level = float(v) if level is None else a * v + (1 - a) * level
        out.append(None if level is None else round(level, 9))
    return out


def test_ema_carries_over_missing_values(spark):
    cases = [[10, None, 10, 10], [None, None, 3, 4, None, 5, 6, 7, None, None, None, None, None, 8, 9], [None] * 6, [1, 2, 3, 4, 5, 6, 7, 8, 9]]
    for values in cases:
        got = averaged(spark, values, {"one": 1.0, "three": 3.0, "nine": 9.0})
        assert got == {"one": plain(values, 1), "three": plain(values, 3), "nine": plain(values, 9)}


def test_ema_of_several_columns_in_one_pass(spark):
    df = spark.createDataFrame([("A", "1h", i, float(i), float(i % 3)) for i in range(20)], f"asset string, tf string, {IDX} long, a double, b double")
    out = ema(df, {"x": 5.0, "y": 5.0}, {"x": "a", "y": "b"}, BARS.sized(4)).orderBy(IDX).toPandas()
    assert [round(v, 9) for v in out["x"]] == plain(range(20), 5) and [round(v, 9) for v in out["y"]] == plain([i % 3 for i in range(20)], 5)


def test_any_sequence_number_orders_trades(spark):
    at = dt.datetime(2024, 1, 1, 0, 0, 1)
    rows = [("A", at, s, float(k), 1.0) for k, s in enumerate([5, 9_223_372_036_854_775_807, -9_223_372_036_854_775_808, 1_800_000_000_000_000_000])]
    bar = rollup.minute_bars(spark.createDataFrame(rows, "asset string, ts timestamp, seq long, price double, volume double")).first()
    assert (bar.open, bar.close) == (2.0, 1.0)


def test_streams_read_files_and_directories_alike(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    counts = [streams.aliased(spark, d).count() for d in (SMALL, str(tmp_path))]
    assert counts[0] == counts[1] > 0


def test_a_store_shows_columns_of_later_batches(spark, tmp_path):
    store = FeatureTable(spark, f"{tmp_path}/features")
    rows = spark.createDataFrame([("A", dt.datetime(2024, 1, d), float(d)) for d in (1, 2, 3)], "asset string, bar_close timestamp, close double")
    store.save(rows, "overwrite")
    store.save(rows.filter("close > 2").selectExpr("asset", "bar_close", "close + 10 AS close", "close AS extra"))
    assert {(r.close, r.extra) for r in store.load().collect()} == {(1.0, None), (2.0, None), (13.0, 3.0)}


def test_no_family_and_no_signal_is_cut(spark):
    assert {"F", "O", "P"} <= set(pivot_max(spark, SMALL).columns)
    assert signal_ranking(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()


def test_every_distinct_score_is_a_threshold(spark):
    from tickloom.operators.mlprep import threshold_table

    rows = [(i / 1000.0, int(i % 3 == 0)) for i in range(1, 1000) for _ in range(1 + i % 2)]
    got = {round(r.threshold, 9): (r.tp, r.flagged) for r in threshold_table(spark.createDataFrame(rows, "p double, y int"), "y", "p").collect()}
    assert len(got) == 999
    for t in (0.001, 0.25, 0.5, 0.999):
        assert got[t] == (sum(y for p, y in rows if p >= t), sum(p >= t for p, _ in rows))


def test_clusters_use_rows_with_any_value(spark):
    from tickloom.operators.mlprep import filled_and_clipped

    rows = [(None, 1.0), (2.0, None), (None, None), (4.0, 3.0), (6.0, 500.0)]
    got = filled_and_clipped(spark.createDataFrame(rows, "a double, b double"), ("a", "b"), 0.0, 0.75).collect()
    assert sorted((r.a, r.b) for r in got) == [(2.0, 3.0), (4.0, 1.0), (4.0, 3.0), (5.0, 251.5)]


def test_correlations_of_many_assets(spark):
    import numpy as np

    from tickloom.operators.mlprep import asset_correlations

    x = np.random.default_rng(4).normal(size=(60, 120))
    x[1] = -x[0]
    rows = [(f"A{a:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=t), float(x[a, t])) for a in range(60) for t in range(120) if a or t < 90]
    got = {(r.a, r.b): (r.rows, r.corr) for r in asset_correlations(spark.createDataFrame(rows, "asset string, bar_close timestamp, ret double")).collect()}
    assert len(got) == 60 * 59 // 2 and got["A000", "A001"][0] == 90 and abs(got["A000", "A001"][1] + 1) < 1e-9
    assert abs(got["A007", "A031"][1] - np.corrcoef(x[7], x[31])[0, 1]) < 1e-9
