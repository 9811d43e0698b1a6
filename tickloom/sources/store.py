"""Feature and bar tables on files: upsert, slice, merge, resume points, sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key.  An aggregate, not a window: partial results shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def upserted(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of both; where a key is in both, the new row stands.  Columns missing on a side become NULL."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, ("_batch",)).drop("_batch")


def write_bars(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Bars partitioned by asset and timeframe; CSV parts carry a header."""
    df.write.format(fmt).option("header", "true").mode(mode).partitionBy("asset", "tf").save(path)


class FeatureTable:
    """A feature table in date partitions; an upsert rewrites only the dates it touches."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("asset", "bar_close")):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), tuple(keys)

    def exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def load(self) -> DataFrame:
        """All rows; columns that only later batches have are NULL in earlier rows."""
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def slice(self, start: str, end: str) -> DataFrame:
        """Closed time range; the date partitions outside it are not read."""
        lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
        return self.load().filter(
            F.col("day").between(F.to_date(lo), F.to_date(hi)) & F.col("bar_close").between(lo, hi))

    def save(self, df: DataFrame, mode: str = "append", required: Sequence[str] = ()) -> None:
        missing = [c for c in (*self.keys, *required) if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        new = df.withColumn("day", F.to_date("bar_close"))
        if mode == "overwrite" or not self.exists():
            new.write.mode("overwrite").partitionBy("day").parquet(self.path)
            return
        from tickloom.operators.series import pin

        new = pin(new)
        days = new.select("day").distinct()
        touched = self.load().join(days, "day", "left_semi")
        merged = pin(upserted(touched, new, self.keys))  # read fully before its own partitions are replaced
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def merge_into(base: DataFrame, stored: DataFrame, keys: Sequence[str], how: str = "left", suffix: str = "_r") -> DataFrame:
    """Join stored features on the keys; names both sides have get the suffix on the right."""
    clash = {c: f"{c}{suffix}" for c in stored.columns if c in base.columns and c not in keys}
    return base.join(stored.withColumnsRenamed(clash), list(keys), how)


def merge_features(base: DataFrame, add: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer merge; a non-missing right value replaces the left one."""
    shared = [c for c in add.columns if c in base.columns and c not in keys]
    right = add.withColumnsRenamed({c: f"_new_{c}" for c in shared})
    out = base.join(right, list(keys), "full")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in shared}).drop(*[f"_new_{c}" for c in shared])


def newer_rows(new: DataFrame, stored: DataFrame, checkpoints: DataFrame | None = None, ts: str = "ts",
               by: str = "asset", interval_seconds: int = 0) -> DataFrame:
    """Rows after each asset's high-water mark: the later of its checkpoint and its last stored time, plus one interval."""
    marks = stored.groupBy(by).agg(F.max(ts).alias("_mark"))
    if checkpoints is not None:
        marks = marks.unionByName(checkpoints.select(by, F.col(ts).alias("_mark"))).groupBy(by).agg(F.max("_mark").alias("_mark"))
    start = F.timestamp_micros(F.unix_micros("_mark") + interval_seconds * 1_000_000)
    fresh = F.col("_mark").isNull() | (F.col(ts) >= start if interval_seconds else F.col(ts) > F.col("_mark"))
    return new.join(marks, by, "left").filter(fresh).drop("_mark")
