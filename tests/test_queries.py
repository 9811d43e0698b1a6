"""Named queries against their SQL in DuckDB on the smallest tables.

A sample of every family runs by default; TICKLOOM_ALL=1 runs all of them.
"""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")
SAMPLE = ("A1_minute_bars", "A3_rollup", "J1_asof_strict", "W5_ema", "W7_volatility_block", "W18_gaps", "W22_zone_choice", "W26_session_percentiles",
          "W34_flow_follow_through_label", "P10_gates", "F16_position_and_ticket_size", "A8_group_attribution", "A14_tail_risk", "A16_decile_attribution",
          "A31_fused_outputs", "W46_trade_lifecycle", "S9_feature_upsert", "S13_event_log", "M3_mutual_information", "T8_incremental_bars",
          "hourly_features_with_context")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TICKLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    rel = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(cols, rel.fetchall())


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "atr" in df.columns


def test_trades_are_scanned_narrowly_and_combined_before_the_shuffle(spark):
    from tickloom.plans.market import minutes

    plan = minutes(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "SortAggregate" not in plan
    assert "user_id" not in plan.split("ReadSchema")[1].split("\n")[0]
