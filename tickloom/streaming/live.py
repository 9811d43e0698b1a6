"""Features, screening and signal limits on a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tickloom.operators.screen import POLICY, Policy, limits_after, screen, spaced_signals
from tickloom.operators.series import index_rows, pin


class LiveFeatures:
    """Features of newly closed bars: the batch functions run over each asset's latest bars, new rows are kept.

    ``reach`` is the longest look-back of the features; each micro-batch reads that many stored bars per asset.
    """

    def __init__(self, bars_path: str, out_path: str, build: Callable[[DataFrame], DataFrame], reach: int = 5000):
        self.bars_path, self.out_path, self.build, self.reach = bars_path, out_path, build, reach

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stamped = batch.withColumn("day", F.to_date("bar_close"))
        stamped.write.mode("overwrite").partitionBy("day").parquet(f"{self.bars_path}/batch_id={batch_id}")
        seen = spark.read.parquet(self.bars_path).filter(F.col("batch_id") <= batch_id)
        # rows stored per (asset, day), and how many newer ones follow: the days that are still in reach
        counts = seen.groupBy("asset", "day").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("batch_id") == batch_id).alias("_new"))
        later = Window.partitionBy("asset").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
        total_new = F.sum("_new").over(Window.partitionBy("asset"))
        after = counts.withColumns({"_after": F.coalesce(F.sum("_n").over(later), F.lit(0)), "_want": total_new + self.reach})
        near = pin(after.filter((F.col("_after") < F.col("_want")) & (F.col("_want") > self.reach)).drop("_n", "_new"))
        first_day = near.agg(F.min("day")).first()[0]
        # a bar interval bounds the rows of one (asset, day); the day filter prunes the files
        day = Window.partitionBy("asset", "day").orderBy(F.desc("bar_close"))
        recent = (
            seen.filter(F.col("day") >= F.lit(first_day)).join(near, ["asset", "day"])
            .withColumn("_k", F.row_number().over(day)).filter(F.col("_k") + F.col("_after") <= F.col("_want"))
            .drop("_k", "_after", "_want", "day")
        )
        out = self.build(index_rows(recent, ("asset", "tf"), ("bar_close",)))
        out.filter(F.col("batch_id") == batch_id).drop("batch_id", "row_idx").write.mode("overwrite").parquet(f"{self.out_path}/batch_id={batch_id}")


def alerts(stream: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Stateless screening; keeps the tiered candidates."""
    return screen(stream, policy).filter(F.col("tier").isin("A+", "A", "B") & (F.col("gate_passed") == 1))


class LiveLimits:
    """Per-asset limits on a stream whose assets may be large: a micro-batch is decided in parallel by ``spaced_signals``.

    What a batch leaves (three numbers an asset) is written beside its decisions under the batch's number, so a batch
    that runs again after a failure reads the same state and replaces its own output.  Input columns ``asset``,
    ``bar_index``, ``bar_close``; a later batch holds later bars of an asset.
    """

    STATE = "asset string, hour timestamp, used long, last_taken long"

    def __init__(self, out_path: str, state_path: str, per_hour: int = 2, min_gap: int = 2):
        self.out_path, self.state_path, self.per_hour, self.min_gap = out_path, state_path, per_hour, min_gap

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(self.STATE).parquet(f"{self.state_path}/batch_id={batch_id - 1}") if batch_id else None
        rows = pin(batch.select("asset", "bar_index", "bar_close", F.lit(1).alias("candidate")))
        out = f"{self.out_path}/batch_id={batch_id}"
        decided = spaced_signals(rows, self.per_hour, self.min_gap, before).drop("candidate")
        decided.write.mode("overwrite").parquet(out)
        limits_after(spark.read.schema(decided.schema).parquet(out), before).write.mode("overwrite").parquet(f"{self.state_path}/batch_id={batch_id}")


def limited(stream: DataFrame, per_hour: int = 2, min_gap: int = 2) -> DataFrame:
    """Per-asset limits with state: bars since the last accepted signal and the hour's count.

    Input columns ``asset``, ``bar_index``, ``bar_close``; rows are taken in bar order inside a micro-batch.
    The state of an asset is three numbers.  All rows of an asset in a micro-batch are one task; ``LiveLimits`` spreads them.
    """
    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, hour, used = state.get if state.exists else (-(2**31), -1, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("bar_index")
        accepted = []
        for bar, stamp in zip(rows["bar_index"], rows["bar_close"]):
            now = int(stamp.timestamp()) // 3600
            if now != hour:
                hour, used = now, 0
            ok = bar - last >= min_gap and used < per_hour
            if ok:
                last, used = int(bar), used + 1
            accepted.append(int(ok))
        state.update((int(last), int(hour), int(used)))
        yield pd.DataFrame({"asset": key[0], "bar_index": rows["bar_index"], "bar_close": rows["bar_close"], "accepted": accepted})

    return stream.select("asset", "bar_index", "bar_close").groupBy("asset").applyInPandasWithState(
        step, "asset string, bar_index long, bar_close timestamp, accepted int", "last long, hour long, used long", "append",
        GroupStateTimeout.NoTimeout)
