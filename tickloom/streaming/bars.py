"""Bars from a stream of trades.  The aggregates are those of the batch functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.rollup import TIMEFRAMES, fill_gaps, merge_partials, minute_bars, trade_order
from tickloom.sources.store import keep_last


def trade_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None, pattern: str | None = None,
                 fmt: str = "parquet") -> DataFrame:
    """File source; any source with the same columns does (Kafka after ``from_json``).

    ``pattern`` names one table of the folder, a file or a directory of part files.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
        if table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(table).isDirectory():
            return reader.load(f"{folder}/{pattern}")
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def with_asset(stream: DataFrame, aliases: DataFrame, pair: str = "pair") -> DataFrame:
    """Canonical asset of an exchange pair; unknown pairs keep their own name.

    ``aliases`` (pair, asset) is a static table; Spark broadcasts it while it is small.
    """
    return stream.join(aliases.select(pair, F.col("asset").alias("_asset")), pair, "left").withColumn(
        "asset", F.coalesce("_asset", pair)).drop("_asset")


def without_duplicates(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Exact duplicates inside the watermark go; state is dropped once the watermark passes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def closed_bars(updates: DataFrame, delay: str = "1 minute", stamp: str = "bar_close", arrival: str = "arrival") -> DataFrame:
    """Bar updates to closed bars: the latest update of a stamp stands, bars older than the watermark are dropped.

    Runs in append mode: a bar comes out once, after the watermark has passed its stamp.
    """
    rest = [c for c in updates.columns if c not in ("asset", stamp)]
    return updates.withWatermark(stamp, delay).groupBy("asset", stamp).agg(
        F.max_by(F.struct(*rest), arrival).alias("_r")).select("asset", stamp, "_r.*")


def _ohlcv(order: Column) -> list[Column]:
    return [F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", order).alias("close"), F.sum("volume").alias("volume")]


def stream_minutes(trades: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Trades to one-minute bars in append mode."""
    priced = trades.withWatermark("ts", delay).withColumns({"open": F.col("price"), "high": F.col("price"), "low": F.col("price"), "close": F.col("price")})
    out = priced.groupBy("asset", F.window("ts", "1 minute").alias("w")).agg(*_ohlcv(trade_order()))
    return out.select("asset", F.col("w.start").alias("bar_open"), F.window_time("w").alias("stamp"), "open", "high", "low", "close", "volume")


def stream_rollup(minutes: DataFrame, tf: str) -> DataFrame:
    """Closed minutes to ``tf`` bars; a bar comes out when the watermark reaches its end."""
    out = minutes.groupBy("asset", F.window("stamp", f"{TIMEFRAMES[tf]} seconds").alias("w")).agg(*_ohlcv(F.col("bar_open")))
    return out.select("asset", F.lit(tf).alias("tf"), F.col("w.start").alias("bar_open"), F.col("w.end").alias("bar_close"),
                      "open", "high", "low", "close", "volume")


class PartialBars:
    """Incremental rollup: every micro-batch stores the partial bars it saw, reading merges them.

    A batch that runs again after a failure rewrites its own partition, so nothing is
    counted twice; the query checkpoint is the resume cursor.
    """

    def __init__(self, path: str, seconds: int = 60):
        self.path, self.seconds = path, seconds

    def write(self, batch: DataFrame, batch_id: int) -> None:
        minute_bars(batch, self.seconds).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def bars(self, spark: SparkSession) -> DataFrame:
        return merge_partials(spark.read.parquet(self.path).drop("batch_id"))


class FilledBars:
    """Closed bars with missing bars filled from the last stored one of each asset.

    Every batch also stores the latest bar per asset, so the next one reads those few rows
    and not the history.
    """

    def __init__(self, path: str, seconds: int = 60):
        self.path, self.seconds = path.rstrip("/"), seconds

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cols = ["asset", "bar_open", "open", "high", "low", "close", "volume"]
        new = batch.select(*cols)
        if batch_id > 0:
            tail = spark.read.parquet(f"{self.path}_tail/batch_id={batch_id - 1}")
            old = tail.select("asset", F.col("bar_open").alias("_have"))
            # a tail is only filled up to bars of its own asset in this batch
            dense = fill_gaps(tail.join(new.select("asset").distinct(), "asset", "left_semi").unionByName(new), self.seconds).join(old, "asset", "left")
            out = dense.filter(F.col("_have").isNull() | (F.col("bar_open") > F.col("_have"))).drop("_have")
            latest = keep_last(tail.unionByName(new), ("asset",), ("bar_open",))
        else:
            out, latest = fill_gaps(new, self.seconds), keep_last(new, ("asset",), ("bar_open",))
        out.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        latest.write.mode("overwrite").parquet(f"{self.path}_tail/batch_id={batch_id}")
