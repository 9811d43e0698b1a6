"""Session-aware features: relative percentiles, daily extremes, overlap breakouts, sweep ages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.rolling import roll_max, roll_mean, roll_min
from tickloom.functions.scalar import clip, flag, safe_div
from tickloom.functions.sessions import day_masks
from tickloom.operators.series import BARS, IDX, Lane, bars_since, framed


def bucket_percentiles(df: DataFrame, values: Mapping[str, Column], n: int = 96, lane: Lane = BARS) -> DataFrame:
    """Where a value sits among the rows of its own session bucket in the last ``n`` rows (logistic of the score)."""
    need = max(12, n // 4)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        # the same-bucket rows among the last n rows: a range over row positions inside the bucket
        own = Window.partitionBy(*lane.keys, "_block", "session_bucket").orderBy(IDX).rangeBetween(-(n - 1), 0)
        d = d.withColumns({f"_x_{k}": v for k, v in values.items()})
        out = {}
        for k in values:
            x = F.col(f"_x_{k}")
            z = F.when(F.count(x).over(own) >= need, safe_div(x - F.avg(x).over(own), F.stddev_samp(x).over(own)))
            out[k] = F.coalesce(1.0 / (1.0 + F.exp(-1.702 * z)), F.lit(0.5))
        return d.withColumns(out).drop(*[f"_x_{k}" for k in values])

    return framed(df, build, back=n, lane=lane)


def asia_extremes(df: DataFrame, full_day: bool = False, keys: tuple[str, ...] = ("asset", "tf")) -> DataFrame:
    """Asia-session high/low of the local date: known so far, or of the whole session when ``full_day``.

    A window here holds one local day of one series, so it stays small however long the history.
    """
    d = df.withColumns({k: v for k, v in day_masks().items() if k in ("in_asia", "session_date")})
    day = Window.partitionBy(*keys, "session_date")
    w = day if full_day else day.orderBy("bar_close").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumns(
        {
            "asia_high": F.max(F.when(F.col("in_asia") == 1, F.col("high"))).over(w),
            "asia_low": F.min(F.when(F.col("in_asia") == 1, F.col("low"))).over(w),
        }
    ).drop("in_asia", "session_date")


def london_extremes(df: DataFrame, keys: tuple[str, ...] = ("asset", "tf")) -> DataFrame:
    """Running London-session high/low of the local date, carried to the end of the day."""
    d = df.withColumns({k: v for k, v in day_masks().items() if k in ("in_london", "session_date")})
    w = Window.partitionBy(*keys, "session_date").orderBy("bar_close").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumns(
        {
            "london_high": F.max(F.when(F.col("in_london") == 1, F.col("high"))).over(w),
            "london_low": F.min(F.when(F.col("in_london") == 1, F.col("low"))).over(w),
        }
    ).drop("in_london", "session_date")


def atr_distances(df: DataFrame, levels: tuple[str, ...], atr: str = "atr_norm") -> DataFrame:
    return df.withColumns({f"dist_to_{c}_atr": safe_div(F.col("close") - F.col(c), atr) for c in levels})


def atr_norm(df: DataFrame, lane: Lane = BARS) -> DataFrame:
    """``atr`` where known, else the mean range of up to 14 bars."""
    have = "atr" in df.columns

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_rng", F.col("high") - F.col("low"))
        early = roll_mean("_rng", w, 14, 2)
        return d.withColumn("atr_norm", F.coalesce(F.col("atr"), early) if have else early).drop("_rng")

    return framed(df, build, back=14, lane=lane)


def overlap_breakout(df: DataFrame, lookback: int = 16, lane: Lane = BARS) -> DataFrame:
    """First overlap bar whose close reaches beyond the extremes of the bars before it."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        start = (F.col("session_overlap") == 1) & (F.lag("session_overlap", 1, 0).over(w) == 0)
        hi, lo = roll_max("high", w, lookback, 4, shift=1), roll_min("low", w, lookback, 4, shift=1)
        return d.withColumn(
            "breakout_after_overlap_start_flag", flag(start & ((F.col("close") >= hi) | (F.col("close") <= lo)))
        )

    return framed(df, build, back=lookback + 1, lane=lane)


def sweep_ages(df: DataFrame, lane: Lane = BARS) -> DataFrame:
    """Bars since the last sweep, and a retest within four bars of a sweep made in session."""
    swept = (F.col("sweep_high") == 1) | (F.col("sweep_low") == 1)
    in_session = (F.col("session_london") == 1) | (F.col("session_ny") == 1)
    out = bars_since(df, {"bars_since_last_liquidity_sweep": swept, "_session_sweep": swept & in_session}, 999, lane)
    fresh = F.coalesce(F.col("fresh_retest"), F.lit(0)) > 0
    return out.withColumn(
        "first_retest_after_session_sweep", flag(fresh & F.col("_session_sweep").between(1, 4))
    ).drop("_session_sweep")


def session_context(df: DataFrame, lane: Lane = BARS) -> DataFrame:
    """The session-relative percentiles of volume, range, wick asymmetry and ATR."""
    rng = F.col("high") - F.col("low")
    zero = F.lit(0.0)
    upper = clip(F.col("high") - F.greatest("open", "close"), zero)
    lower = clip(F.least("open", "close") - F.col("low"), zero)
    return bucket_percentiles(
        atr_norm(df, lane),
        {
            "session_volume_pct": F.coalesce("volume", zero),
            "session_range_pct": F.coalesce(safe_div(rng, "close"), zero),
            "session_wick_asym_pct": F.coalesce(safe_div(upper - lower, rng), zero),
            "session_atr_pct": F.coalesce(F.nullif("atr_norm", zero), zero),
        },
        lane=lane,
    )
