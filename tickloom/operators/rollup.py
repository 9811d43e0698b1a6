"""Trades to bars, and bars to coarser bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import BARS, IDX, Lane, carry_last, framed, index_rows

# Seconds per timeframe.
TIMEFRAMES = {"1m": 60, "15m": 900, "1h": 3600, "6h": 21600, "12h": 43200}


def floor_time(ts, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)
                                       / (seconds * 1_000_000)).cast("long") * seconds)


def ceil_time(ts, seconds: int) -> Column:
    """End of the right-closed interval ``(end - seconds, end]`` that holds ``ts``."""
    return F.timestamp_seconds(F.ceil(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)
                                      / (seconds * 1_000_000)).cast("long") * seconds)


def trade_order(ts: str = "ts", seq: str = "seq") -> Column:
    """(time, sequence) as one fixed-width decimal, so first/last price stay in a hash aggregate.

    Any 64-bit sequence number fits below the time (microseconds within the years 1653 to 2286).
    """
    micros = F.unix_micros(ts).cast("decimal(17,0)") * F.lit("1" + "0" * 20).cast("decimal(21,0)")
    return (micros + F.col(seq).cast("decimal(20,0)")).cast("decimal(38,0)")


def minute_bars(trades: DataFrame, seconds: int = 60) -> DataFrame:
    """Trades to bars over ``[open, open + seconds)``; partial sums are combined before the shuffle.

    Keeps the order keys of the first and last trade, so partial bars of the same
    bucket from different loads can be merged later (``merge_partials``).
    """
    keyed = trades.withColumns({"bar_open": floor_time("ts", seconds), "_ord": trade_order()})
    return keyed.groupBy("asset", "bar_open").agg(
        F.min_by("price", "_ord").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_ord").alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("trades"),
        F.min("_ord").alias("first_ord"),
        F.max("_ord").alias("last_ord"),
    ).withColumn("bar_close", F.timestamp_seconds(F.unix_seconds("bar_open") + seconds))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Combine partial bars of one bucket: earliest open, latest close, extremes, summed volume."""
    return partials.groupBy("asset", "bar_open", "bar_close").agg(
        F.min_by("open", "first_ord").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last_ord").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trades").alias("trades"),
        F.min("first_ord").alias("first_ord"),
        F.max("last_ord").alias("last_ord"),
    )


def rollup(minutes: DataFrame, tf: str) -> DataFrame:
    """Finer bars to ``tf`` bars: right-closed on the close stamp, right-labelled, empty buckets absent."""
    seconds = TIMEFRAMES[tf]
    return (
        minutes.withColumn("_end", ceil_time("bar_close", seconds))
        .groupBy("asset", "_end")
        .agg(
            F.min_by("open", "bar_close").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "bar_close").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum(F.col("close") * F.col("volume")).alias("dollar_volume"),
        )
        .select(
            "asset",
            F.lit(tf).alias("tf"),
            F.timestamp_seconds(F.unix_seconds("_end") - seconds).alias("bar_open"),
            F.col("_end").alias("bar_close"),
            "open", "high", "low", "close", "volume", "dollar_volume",
        )
    )


def rollups(minutes: DataFrame, tfs: tuple[str, ...] = ("15m", "1h", "6h", "12h")) -> DataFrame:
    """All timeframes from one pass over the finer bars."""
    sizes = F.array(*[F.struct(F.lit(tf).alias("tf"), F.lit(TIMEFRAMES[tf]).alias("s")) for tf in tfs])
    end = F.ceil(F.unix_seconds("bar_close") / F.col("_size.s")).cast("long") * F.col("_size.s")
    return (
        minutes.withColumn("_size", F.explode(sizes))
        .groupBy("asset", F.col("_size.tf").alias("tf"), F.col("_size.s").alias("_s"), end.alias("_end"))
        .agg(
            F.min_by("open", "bar_close").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "bar_close").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum(F.col("close") * F.col("volume")).alias("dollar_volume"),
        )
        .select(
            "asset", "tf",
            F.timestamp_seconds(F.col("_end") - F.col("_s")).alias("bar_open"),
            F.timestamp_seconds("_end").alias("bar_close"),
            "open", "high", "low", "close", "volume", "dollar_volume",
        )
    )


def indexed_rollup(minutes: DataFrame, tf: str) -> DataFrame:
    """``rollup`` plus the exact row position the ordered operators run on."""
    return index_rows(rollup(minutes, tf), ("asset", "tf"), ("bar_close",))


def close_only_rollup(minutes: DataFrame, tf: str) -> DataFrame:
    """Open/high/low/close all taken from the finer bars' closes, floor buckets, unfinished last bar withheld."""
    seconds = TIMEFRAMES[tf]
    bars = (
        minutes.withColumn("bar_open_tf", floor_time("bar_open", seconds))
        .groupBy("asset", "bar_open_tf")
        .agg(
            F.min_by("close", "bar_open").alias("open"),
            F.max("close").alias("high"),
            F.min("close").alias("low"),
            F.max_by("close", "bar_open").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("bar_open_tf", "bar_open")
        .withColumn("bar_close", F.timestamp_seconds(F.unix_seconds("bar_open") + seconds))
    )
    return drop_unfinished(bars, minutes)


def drop_unfinished(bars: DataFrame, source: DataFrame, stamp: str = "bar_close") -> DataFrame:
    """Remove bars that close after the last source stamp of their asset."""
    latest = source.groupBy("asset").agg(F.max(stamp).alias("_latest"))
    return bars.join(latest, "asset").filter(F.col("bar_close") <= F.col("_latest")).drop("_latest")


def candles_from_end(bars: DataFrame, n: int, keys: tuple[str, ...] = ("asset", "tf")) -> DataFrame:
    """Every ``n`` rows form one candle, counted back from the end; the incomplete oldest one is left out."""
    last = bars.groupBy(*keys).agg(F.max(IDX).alias("_last"))
    return (
        bars.join(last, list(keys))
        .withColumn("candle", F.floor((F.col("_last") - F.col(IDX)) / n).cast("long"))
        .groupBy(*keys, "candle")
        .agg(
            F.min("bar_open").alias("bar_open"),
            F.max("bar_close").alias("bar_close"),
            F.min_by("open", IDX).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", IDX).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .filter(F.col("_rows") == n)
        .drop("_rows")
    )


def interval_means(df: DataFrame, seconds: int, cols: list[str], ts: str = "bar_close") -> DataFrame:
    return df.groupBy("asset", floor_time(ts, seconds).alias("bucket")).agg(*[F.avg(c).alias(c) for c in cols])


def fill_gaps(bars: DataFrame, seconds: int = 60, span_seconds: int = 86400) -> DataFrame:
    """Dense grid per asset: missing bars repeat the previous close with zero volume.

    The grid is generated in two steps (days, then bars of a day), so no single row
    explodes into a whole history; the previous close crosses days on a one-row-per-day summary.
    """
    key = F.floor(F.unix_seconds("bar_open") / span_seconds).cast("long")
    real = bars.select("asset", "bar_open", "open", "high", "low", "close", "volume").withColumn("_day", key)
    bounds = real.groupBy("asset").agg(
        F.min(F.unix_seconds("bar_open")).alias("_lo"), F.max(F.unix_seconds("bar_open")).alias("_hi")
    )
    days = bounds.withColumn(
        "_day", F.explode(F.sequence(F.floor(F.col("_lo") / span_seconds), F.floor(F.col("_hi") / span_seconds)))
    )
    grid = days.repartition("asset", "_day").select(
        "asset",
        "_day",
        F.explode(
            F.sequence(
                F.greatest(F.col("_lo"), F.col("_day") * span_seconds),
                F.least(F.col("_hi"), (F.col("_day") + 1) * span_seconds - seconds),
                F.lit(seconds).cast("long"),
            )
        ).alias("_open"),
    ).select("asset", "_day", F.timestamp_seconds("_open").alias("bar_open"))
    ends = real.groupBy("asset", "_day").agg(F.max_by("close", "bar_open").alias("_end"))
    before = Window.partitionBy("asset").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    seeds = days.select("asset", "_day").join(ends, ["asset", "_day"], "left").select(
        "asset", "_day", F.last("_end", ignorenulls=True).over(before).alias("_seed")
    )
    w = Window.partitionBy("asset", "_day").orderBy("bar_open").rowsBetween(Window.unboundedPreceding, -1)
    dense = grid.join(real, ["asset", "_day", "bar_open"], "left").join(seeds, ["asset", "_day"], "left")
    prev = F.coalesce(F.last("close", ignorenulls=True).over(w), F.col("_seed"))
    return dense.withColumn("_prev", prev).select(
        "asset",
        "bar_open",
        F.timestamp_seconds(F.unix_seconds("bar_open") + seconds).alias("bar_close"),
        F.coalesce("open", "_prev").alias("open"),
        F.coalesce("high", "_prev").alias("high"),
        F.coalesce("low", "_prev").alias("low"),
        F.coalesce("close", "_prev").alias("close"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.col("close").isNull().cast("int").alias("gap_filled"),
    )


def limited_ffill(df: DataFrame, cols: list[str], limit: int, interpolate: bool = False, lane: Lane = BARS) -> DataFrame:
    """Forward fill over at most ``limit`` rows; optionally straight-line interpolation first.

    Interpolation fills up to ``limit`` rows after a known value when a later value exists,
    and repeats the last value where none does.
    """
    if not interpolate:
        def build(rows: DataFrame, w) -> DataFrame:
            frame = w.rowsBetween(-limit, 0)
            return rows.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in cols})

        return framed(df, build, back=limit, lane=lane)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(IDX).alias("i"), F.col(c).alias("v"))) for c in cols}
    both = carry_last(df, {f"_p_{c}": k for c, k in known.items()}, lane)
    both = carry_next(both, {f"_n_{c}": k for c, k in known.items()}, lane)
    fills = {}
    for c in cols:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        step = F.col(IDX) - p["i"]
        line = p["v"] + (n["v"] - p["v"]) * step / (n["i"] - p["i"])
        near = F.when(step <= limit, F.coalesce(line, p["v"]))
        # the plain fill that follows copies the last interpolated value a further ``limit`` rows
        edge = p["v"] + (n["v"] - p["v"]) * F.lit(limit) / (n["i"] - p["i"])
        fills[c] = F.coalesce(F.col(c), near, F.when(step <= 2 * limit, F.coalesce(edge, p["v"])))
    return both.withColumns(fills).drop(*[f"_p_{c}" for c in cols], *[f"_n_{c}" for c in cols])


def carry_next(df: DataFrame, values: dict[str, Column], lane: Lane = BARS) -> DataFrame:
    """First non-missing value at or after this row (the mirror image of ``carry_last``)."""
    tagged = df.withColumns({"_block": lane.number(), **{f"_v_{n}": c for n, c in values.items()}})
    summary = tagged.groupBy(*lane.keys, "_block").agg(
        *[F.min_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(IDX))).alias(n) for n in values]
    )
    after = Window.partitionBy(*lane.keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    seeds = summary.select(
        *lane.keys, "_block", *[F.first(n, ignorenulls=True).over(after).alias(f"_s_{n}") for n in values]
    )
    frame = lane.window().rowsBetween(0, Window.unboundedFollowing)
    out = tagged.join(seeds, [*lane.keys, "_block"], "left").withColumns(
        {n: F.coalesce(F.first(f"_v_{n}", ignorenulls=True).over(frame), F.col(f"_s_{n}")) for n in values}
    )
    return out.drop("_block", *[f"_v_{n}" for n in values], *[f"_s_{n}" for n in values])


def market_headline(bars: DataFrame, day: int = 96, span: int = 1200, keys: tuple[str, ...] = ("asset", "tf"), lane: Lane = BARS) -> DataFrame:
    """Change, range and volume of the last ``day`` bars, and the spread of returns over the last ``span``."""
    last = bars.groupBy(*keys).agg(F.max(IDX).alias("_last"))

    def build(d: DataFrame, w) -> DataFrame:
        prev = F.lag("close").over(w)
        return d.withColumn("_ret", F.try_divide(F.col("close"), F.when(prev > 0, prev)) - 1.0)

    d = framed(bars, build, back=1, lane=lane).join(last, list(keys))
    recent = F.col(IDX) > F.col("_last") - day
    c = F.max_by("close", IDX)
    first = F.min_by("close", F.when(recent, F.col(IDX)))
    return d.groupBy(*keys).agg(
        ((F.try_divide(c, first) - 1.0) * 100.0).alias("change_pct"),
        ((F.max(F.when(recent, F.col("high"))) - F.min(F.when(recent, F.col("low")))) / F.greatest(c, F.lit(1e-9)) * 100.0).alias("range_pct"),
        F.sum(F.when(recent, F.col("volume"))).alias("volume"),
        (F.stddev_pop(F.when(F.col(IDX) > F.col("_last") - span + 1, F.col("_ret"))) * 100.0).alias("realized_vol"),
    ).drop("tf")
