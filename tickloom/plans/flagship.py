"""Trades to hourly features with closed six-hour context: one query over the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.operators.asof import asof
from tickloom.operators.rollup import rollups
from tickloom.operators.series import ema, framed, index_rows
from tickloom.functions.rolling import roll_mean, roll_std, true_range
from tickloom.plans import sqltext as q
from tickloom.plans.features import show
from tickloom.plans.market import minutes, with_bars
from tickloom.plans.registry import query

COLS = ["close", "atr", "close_rmean16", "close_rstd16", "ema_21", "dist_ema", "close_6h", "range_6h"]


@query("hourly_features_with_context", with_bars("1h", "6h") + ", " + q.true_range("b_1h", "a") + ", " + q.ema("a", "c", {"ema_21": 21}, "e") + f""",
f AS (SELECT asset, t, c AS close, atr, {q.roll('avg', 'c', 16)} AS m16, {q.roll('stddev_samp', 'c', 16)} AS s16, ema_21, {q.div('c - ema_21', 'atr')} AS dist FROM e)
SELECT f.asset, f.t, close, round(atr, 6) AS atr, round(m16, 6) AS close_rmean16, round(s16, 6) AS close_rstd16, round(ema_21, 6) AS ema_21,
  round(dist, 6) AS dist_ema, x.c AS close_6h, round(x.h - x.l, 6) AS range_6h FROM f ASOF LEFT JOIN b_6h x ON x.asset = f.asset AND x.t <= f.t""")
def hourly(spark, d):
    # both timeframes from one pass over the trades, written and numbered once
    both = index_rows(rollups(minutes(spark, d), ("1h", "6h")), ("asset", "tf"), ("bar_close",))

    def build(rows, w):
        rows = rows.withColumn("_tr", true_range(w))
        return rows.withColumns({"atr": roll_mean("_tr", w, 14), "close_rmean16": roll_mean("close", w, 16),
                                 "close_rstd16": roll_std("close", w, 16)}).drop("_tr")

    hours = ema(framed(both.filter(F.col("tf") == "1h"), build, back=16), {"ema_21": 21.0})
    hours = hours.withColumn("dist_ema", X.safe_div(F.col("close") - F.col("ema_21"), "atr"))
    ctx = both.filter(F.col("tf") == "6h").select("asset", "bar_close", "close", (F.col("high") - F.col("low")).alias("range"))
    return show(asof(hours, ctx, suffix="_6h"), COLS)
