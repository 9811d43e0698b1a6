"""Backward as-of joins between timeframes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(
    spine: DataFrame,
    ctx: DataFrame,
    on: str = "bar_close",
    by: Sequence[str] = ("asset",),
    strict: bool = False,
    suffix: str = "",
    span_seconds: int = 86400,
) -> DataFrame:
    """Attach to each ``spine`` row the latest ``ctx`` row at or before it (before it when ``strict``).

    Both sides are unioned and the last context struct is carried forward inside
    (key, time chunk); a chunk starts from the last context of the chunks before
    it, found on one summary row per chunk.  No task ever holds a whole series; when
    the spine is trades rather than bars, shorten ``span_seconds`` to keep chunks small.
    """
    attrs = [c for c in ctx.columns if c not in (*by, on)]
    chunk = F.floor(F.unix_seconds(on) / span_seconds).cast("long")
    packed = F.struct(F.col(on).alias(on), *[F.col(c) for c in attrs])
    left = spine.withColumns({"_chunk": chunk, "_side": F.lit(0 if strict else 1)})
    right = ctx.select(
        *by, F.col(on), chunk.alias("_chunk"), F.lit(1 if strict else 0).alias("_side"), packed.alias("_ctx")
    )
    carried = right.groupBy(*by, "_chunk").agg(F.max_by("_ctx", on).alias("_ctx"))
    every = left.select(*by, "_chunk").distinct().unionByName(carried, allowMissingColumns=True)
    per_chunk = every.groupBy(*by, "_chunk").agg(F.first("_ctx", ignorenulls=True).alias("_ctx"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    seeds = per_chunk.select(*by, "_chunk", F.last("_ctx", ignorenulls=True).over(before).alias("_seed"))
    w = Window.partitionBy(*by, "_chunk").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    found = (
        both.withColumn("_hit", F.last("_ctx", ignorenulls=True).over(w))
        .filter(F.col("_side") == (0 if strict else 1))
        .join(seeds, [*by, "_chunk"], "left")
        .withColumn("_hit", F.coalesce("_hit", "_seed"))
    )
    return found.select(
        *spine.columns, *[F.col(f"_hit.{c}").alias(f"{c}{suffix}") for c in attrs],
        F.col(f"_hit.{on}").alias(f"{on}_ctx{suffix}"),
    )


def bucket_lookup(
    spine: DataFrame, ctx: DataFrame, seconds: int, on: str = "bar_close", by: Sequence[str] = ("asset",),
    suffix: str = "",
) -> DataFrame:
    """As-of against a gap-free context: an equi join on the computed bucket (AQE splits hot keys)."""
    attrs = [c for c in ctx.columns if c not in (*by, on)]
    right = ctx.select(*by, F.col(on).alias("_bucket"), *[F.col(c).alias(f"{c}{suffix}") for c in attrs])
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds(on) / seconds) * seconds)
    return spine.withColumn("_bucket", bucket).join(right, [*by, "_bucket"], "left").drop("_bucket")


def first_at_or_after(df: DataFrame, marks: DataFrame, on: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: the earliest ``marks.on`` at or after ``df.on`` (a forward as-of on mirrored time)."""
    keys = list(by)
    mirror = F.timestamp_micros(-F.unix_micros(on))
    left = df.withColumn("_m", mirror)
    right = marks.select(*keys, mirror.alias("_m"), F.col(on).alias(name))
    return asof(left, right, on="_m", by=keys).drop("_m", "_m_ctx")
