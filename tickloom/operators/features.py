"""Feature families over indexed bars.  Each returns its input with columns added.

All frames look back only, so recomputing on a longer series never changes an
earlier row.  ``BACK_*`` is the total reach of the chained frames of a family.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.rolling import (
    roll_max, roll_mean, roll_min, roll_mode_count, roll_quantile, roll_rank_pct, roll_std, roll_std_pop, roll_sum,
    roll_zscore, roll_zscore_pop, trailing, true_range,
)
from tickloom.functions.scalar import clip, flag, log_return, pct_change, safe_div
from tickloom.operators.quantile import quantiles_so_far
from tickloom.operators.series import BARS, IDX, Lane, bars_since, carry_last, ema, framed, pin, rank_so_far

# EMA spans per timeframe.
EMA_SPANS = {"15m": (21, 55), "1h": (50, 200), "6h": (100,), "12h": (200,)}


def lag_columns(cols: Sequence[str], lags: Sequence[int], w: WindowSpec) -> dict[str, Column]:
    return {f"{c}_lag{n}": F.lag(c, n).over(w) for c in cols for n in lags}


def lags(df: DataFrame, cols: Sequence[str], steps: Sequence[int], lane: Lane = BARS) -> DataFrame:
    return framed(df, lambda d, w: d.withColumns(lag_columns(cols, steps, w)), back=max(steps), lane=lane)


def event_lags(df: DataFrame, cols: Sequence[str], lane: Lane = BARS) -> DataFrame:
    """0/1 event flags shifted one bar, so a bar never sees its own event."""
    return framed(df, lambda d, w: d.withColumns({f"{c}_lag1": F.lag(c, 1, 0).over(w) for c in cols}), back=1, lane=lane)


def rolling_stats(df: DataFrame, cols: Sequence[str], windows: Sequence[int], lane: Lane = BARS) -> DataFrame:
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        out = {}
        for c in cols:
            for n in windows:
                out |= {
                    f"{c}_rmean{n}": roll_mean(c, w, n), f"{c}_rstd{n}": roll_std(c, w, n),
                    f"{c}_rmin{n}": roll_min(c, w, n), f"{c}_rmax{n}": roll_max(c, w, n),
                }
        return d.withColumns(out)

    return framed(df, build, back=max(windows), lane=lane)


def zscores(df: DataFrame, col: str, n: int, lane: Lane = BARS) -> DataFrame:
    """Three conventions: sample (NULL on zero spread), population (0 on zero spread), population from 2 rows."""
    return framed(
        df,
        lambda d, w: d.withColumns(
            {
                f"{col}_z{n}": roll_zscore(col, w, n),
                f"{col}_zpop{n}": roll_zscore_pop(col, w, n),
                f"{col}_zlive{n}": roll_zscore_pop(col, w, n, minp=2),
            }
        ),
        back=n, lane=lane,
    )


def quantiles(df: DataFrame, col: str, n: int, qs: Sequence[float], lane: Lane = BARS) -> DataFrame:
    return framed(
        df, lambda d, w: d.withColumns({f"{col}_q{int(q * 100)}": roll_quantile(col, q, w, n) for q in qs}),
        back=n, lane=lane,
    )


def atr(df: DataFrame, period: int = 14, lane: Lane = BARS) -> DataFrame:
    """``atr`` needs a full period; ``atr_early`` averages whatever is there."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("true_range", true_range(w))
        return d.withColumns(
            {"atr": roll_mean("true_range", w, period), "atr_early": roll_mean("true_range", w, period, 1)}
        )

    return framed(df, build, back=period + 1, lane=lane)


def _volatility(d: DataFrame, w: WindowSpec, atr_period=14, vol=30, slope=20, rng=40, z=200) -> DataFrame:
    d = d.withColumns({"_tr": true_range(w), "_ret": pct_change("close", w), "_rng": safe_div(
        F.col("high") - F.col("low"), "close")})
    d = d.withColumns(
        {"atr": roll_mean("_tr", w, atr_period), "realized_vol": roll_std("_ret", w, vol),
         "range_pct": roll_mean("_rng", w, rng)}
    )
    d = d.withColumns({"_step": pct_change("atr", w), "vol_zscore": roll_zscore("realized_vol", w, z)})
    return d.withColumn("atr_slope", roll_mean("_step", w, slope)).drop("_tr", "_ret", "_rng", "_step")


VOLATILITY = ("atr", "realized_vol", "atr_slope", "range_pct", "vol_zscore")


def volatility(df: DataFrame, lane: Lane = BARS, with_lags: bool = True, **periods: int) -> DataFrame:
    """ATR, realised volatility, ATR slope, mean range, volatility score, and their lags 1-3."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = _volatility(d, w, **periods)
        return d.withColumns(lag_columns(VOLATILITY, (1, 2, 3), w)) if with_lags else d

    reach = max(periods.get("vol", 30) + periods.get("z", 200), periods.get("atr_period", 14) +
                periods.get("slope", 20) + 1, periods.get("rng", 40)) + 5
    return framed(df, build, back=reach, lane=lane)


def ema_block(df: DataFrame, spans: Sequence[int], band: float = 1.5, z: int = 200, lane: Lane = BARS) -> DataFrame:
    """EMA level, slope, distance in ATR, distance score, band state, and fast/slow alignment."""
    names = {f"ema_{p}": float(p) for p in spans}
    base = ema(df, names, lane=lane)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_tr", true_range(w)).withColumn("_atr", roll_mean("_tr", w, 14, 1))
        first = {}
        for p in spans:
            e = F.col(f"ema_{p}")
            first |= {
                f"ema_slope_{p}": F.coalesce(pct_change(f"ema_{p}", w), F.lit(0.0)),
                f"dist_ema_{p}": safe_div(F.col("close") - e, "_atr"),
                f"band_regime_{p}": F.when(F.col("close") < e - band * F.col("_atr"), -1.0)
                .when(F.col("close") > e + band * F.col("_atr"), 1.0).otherwise(0.0),
            }
        d = d.withColumns(first)
        d = d.withColumns({f"z_dist_ema_{p}": roll_zscore(f"dist_ema_{p}", w, z, 10) for p in spans})
        fast, slow = F.col(f"ema_{spans[0]}"), F.col(f"ema_{spans[-1]}")
        return d.withColumns(
            {
                "ema_alignment": flag(fast > slow) - flag(fast < slow),
                "ema_rel": safe_div(fast - slow, slow),
            }
        ).drop("_tr", "_atr")

    return framed(base, build, back=z + 20, lane=lane)


def band_flags(df: DataFrame, col: str, upper: Column, lower: Column) -> DataFrame:
    x = F.col(col)
    return df.withColumns(
        {
            f"{col}_inband": flag((x >= lower) & (x <= upper)),
            f"{col}_aboveband": flag(x > upper),
            f"{col}_belowband": flag(x < lower),
        }
    )


def absorption(df: DataFrame, bar_minutes: int = 15, window_minutes: int = 60, lane: Lane = BARS) -> DataFrame:
    """Little price progress per dollar, and much turnover per unit of range, both scaled to 0..1.

    The scaling band is the rolling 5/95 % quantile over 128 bars (32 observations needed); where a frame holds fewer, the
    band of all bars so far (``quantiles_so_far``; at the start of a series, and after a stretch without turnover).
    """
    n = max(window_minutes // bar_minutes, 1)
    need, span, cluster_weight, ofi_weight = max(n, 32), 128, 0.4, 0.15
    series = {"p": "_progress", "c": "_cluster"}

    has_ofi = "ofi" in df.columns

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        rng = F.col("high") - F.col("low")
        d = d.withColumns(
            {
                "_body": F.abs(F.col("close") - F.col("open")),
                "_density": F.col("dollar_volume") / F.when(rng == 0, 1e-9).otherwise(rng),
                "_signed": F.col("close") - F.col("open"),
            }
        )
        d = d.withColumns(
            {
                "_progress": safe_div(roll_sum("_body", w, n), roll_sum("dollar_volume", w, n)),
                "_cluster": roll_quantile("_density", 0.5, w, n),
                **({"_ofi": F.coalesce(roll_mean("ofi", w, n), F.lit(0.0)),
                    "_dir": F.signum(F.coalesce(roll_sum("_signed", w, n), F.lit(0.0)))} if has_ofi else {}),
            }
        )
        # in the first rows the frame is all history
        cols = {f"_{k}_{q}": F.coalesce(roll_quantile(c, x, w, span, need), F.when(F.col(IDX) < span, roll_quantile(c, x, w, span, n)))
                for k, c in series.items() for q, x in (("lo", 0.05), ("hi", 0.95))}
        if has_ofi:
            d = d.withColumn("_ofi_abs", F.abs("_ofi"))
            cols["_ofi_q"] = roll_quantile("_ofi_abs", 0.9, w, span, need)
        return d.withColumns(cols)

    def scored(d: DataFrame) -> DataFrame:
        d = d.withColumn("_c_lo", F.coalesce("_c_lo", F.lit(0.0)))
        p_hi = F.when(F.col("_p_hi") == 0, 1e-9).otherwise(F.col("_p_hi"))
        c_hi = F.when(F.col("_c_hi") == 0, 1e-9).otherwise(F.col("_c_hi"))
        slow = 1.0 - clip((F.col("_progress") - F.col("_p_lo")) / (p_hi - F.col("_p_lo") + 1e-12), F.lit(0.0), F.lit(1.0))
        dense = clip((F.col("_cluster") - F.col("_c_lo")) / (c_hi - F.col("_c_lo") + 1e-12), F.lit(0.0), F.lit(1.0))
        d = d.withColumns({"_slow": slow, "_dense": dense})
        boost = F.lit(0.0)
        if has_ofi:
            against = ((F.col("_dir") > 0) & (F.col("_ofi") <= 0)) | ((F.col("_dir") < 0) & (F.col("_ofi") >= 0))
            size = clip(F.col("_ofi_abs") / F.when(F.col("_ofi_q") == 0, 1e-9).otherwise(F.col("_ofi_q")),
                        F.lit(0.0), F.lit(1.0))
            boost = against.cast("double") * ofi_weight * size
        score = clip((1.0 - cluster_weight) * F.col("_slow") + cluster_weight * F.col("_dense") + boost,
                     F.lit(0.0), F.lit(1.0))
        return d.withColumns(
            {
                "absorption_score": F.coalesce(score, F.lit(0.0)),
                "absorption_near_entry": flag(F.col("_dense") > 0.65),
                "absorption_near_stop": flag(F.col("_slow") > 0.65),
            }
        )

    out = pin(framed(df, build, back=span + n + 2, lane=lane))
    for k, c in series.items():
        few = F.col(f"_{k}_lo").isNull() & (F.col(IDX) >= span)
        if out.filter(few & F.col(c).isNotNull()).isEmpty():
            continue
        so_far = quantiles_so_far(out, few, c, (0.05, 0.95), lane).filter(F.col("seen") >= n).drop("seen")
        found = pin(so_far.withColumnsRenamed({"q_0": f"_{k}_lo2", "q_1": f"_{k}_hi2"}))
        out = out.join(found, [*lane.keys, IDX], "left").withColumns({f"_{k}_{q}": F.coalesce(f"_{k}_{q}", f"_{k}_{q}2") for q in ("lo", "hi")})
    return scored(out).select(*df.columns, "absorption_score", "absorption_near_entry", "absorption_near_stop")


def cents(x: Column) -> Column:
    """Two decimals, halves to even."""
    return F.rint(x * 100.0) / 100.0


def liquidity(df: DataFrame, pool: int = 50, density: int = 60, wick: int = 14, lane: Lane = BARS) -> DataFrame:
    """Repeated price levels, wick pressure, volume jumps and the distance to the nearest pool.

    Uses ``swing_high/low``, ``sweep_flag/strength`` and zone columns when present, else price extremes.
    """
    have = set(df.columns)
    swings = {c: F.col(s) for c, s in (("_pool_hi", "swing_high"), ("_pool_lo", "swing_low")) if s in have}
    base = carry_last(df, swings, lane) if swings else df

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        top, bottom = F.greatest("open", "close"), F.least("open", "close")
        upper, lower = F.col("high") - top, bottom - F.col("low")
        d = d.withColumns(
            {
                "_h2": cents(F.col("high")), "_l2": cents(F.col("low")),
                "_m2": cents((F.col("high") + F.col("low")) / 2.0), "_wick": upper - lower,
                "_hi3": roll_max("high", w, 3, 2, shift=1), "_lo3": roll_min("low", w, 3, 2, shift=1),
            }
        )
        d = d.withColumns(
            {
                "liq_eq_high_density": F.coalesce(roll_mode_count("_h2", w, pool, 2).cast("double"), F.lit(0.0)),
                "liq_eq_low_density": F.coalesce(roll_mode_count("_l2", w, pool, 2).cast("double"), F.lit(0.0)),
                "_lvl": roll_mode_count("_m2", w, density, 4).cast("double"),
                "liq_wick_pressure": roll_zscore("_wick", w, wick, 3),
                "liq_displacement_ratio": safe_div(F.abs(upper - lower), F.col("high") - F.col("low")),
                "liq_volume_pressure": pct_change("volume", w),
                "liq_sweep": F.coalesce(F.col("sweep_flag").cast("int"), F.lit(0)) if "sweep_flag" in have
                else flag((F.col("high") > F.col("_hi3")) | (F.col("low") < F.col("_lo3"))),
                "liq_sweep_strength": F.coalesce(F.col("sweep_strength"), F.lit(0.0)) if "sweep_strength" in have
                else F.greatest(F.col("high") - F.col("_hi3"), F.col("_lo3") - F.col("low"), F.lit(0.0)),
            }
        )
        hi = F.col("_pool_hi") if "_pool_hi" in swings else roll_max("high", w, pool, pool, shift=1)
        lo = F.col("_pool_lo") if "_pool_lo" in swings else roll_min("low", w, pool, pool, shift=1)
        marks = [hi, lo]
        for a, b in (("demand_top", "demand_bottom"), ("supply_top", "supply_bottom"), ("zone_hi", "zone_lo")):
            if {a, b} <= have:
                marks.append((F.col(a) + F.col(b)) / 2.0)
        d = d.withColumns(
            {
                "liq_eql_density": F.greatest("liq_eq_high_density", "liq_eq_low_density"),
                "liq_density": roll_zscore("_lvl", w, density, 4),
                "liq_near_pool_dist": F.least(*[F.abs(F.col("close") - m) for m in marks]),
                "liq_sweep_intensity": F.col("liq_sweep_strength"),
            }
        )
        keep = ("liq_sweep", "liq_eql_density", "liq_sweep_strength", "liq_wick_pressure", "liq_density",
                "liq_near_pool_dist")
        d = d.withColumns(lag_columns(keep, (1, 2, 3), w))
        return d.drop("_h2", "_l2", "_m2", "_wick", "_hi3", "_lo3", "_lvl", "_pool_hi", "_pool_lo")

    return framed(base, build, back=2 * density + pool + 5, lane=lane)


def pivot_pool_distance(df: DataFrame, reach: int = 50, lane: Lane = BARS) -> DataFrame:
    """Distance from mid price to the nearest equal-level pivot within ``reach`` bars either side, 0 if none."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        around = w.rowsBetween(-reach, reach)
        mid = (F.col("high") + F.col("low")) / 2.0
        levels = F.concat(
            F.collect_list(F.when(F.col("swing_equal_high") == 1, F.col("high"))).over(around),
            F.collect_list(F.when(F.col("swing_equal_low") == 1, F.col("low"))).over(around),
        )
        d = d.withColumn("_levels", levels)
        gap = F.array_min(F.transform("_levels", lambda v: F.abs(v - mid)))
        return d.withColumn("pool_distance", F.coalesce(gap, F.lit(0.0))).drop("_levels")

    return framed(df, build, back=reach, ahead=reach, lane=lane)


def regime_inputs(df: DataFrame, rank: int = 200, trend: int = 50, squeeze: int = 30, toxic: int = 30,
                  lane: Lane = BARS) -> DataFrame:
    """Volatility percentile, trend persistence, compression and toxicity (needs ``vol_zscore``), lags 1-2."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        rng = F.col("high") - F.col("low")
        d = d.withColumns(
            {
                "_av": F.abs("vol_zscore"), "_up": flag(pct_change("close", w) > 0), "_rng": rng,
                "_dr": F.abs(safe_div(rng - F.lag(rng).over(w), F.lag(rng).over(w))),
            }
        )
        d = d.withColumns({"_tox": F.col("_av") + F.col("_dr"), "_mr": roll_mean("_rng", w, squeeze)})
        d = d.withColumns(
            {
                "vol_pct": roll_rank_pct("_av", w, rank),
                "trend_persist": roll_mean("_up", w, trend),
                "compression_12h": safe_div(F.col("_rng") - F.col("_mr"), "_mr"),
                "toxicity_12h": roll_mean("_tox", w, toxic),
            }
        )
        keep = ("vol_pct", "trend_persist", "compression_12h", "toxicity_12h")
        return d.withColumns(lag_columns(keep, (1, 2), w)).drop("_av", "_up", "_rng", "_dr", "_tox", "_mr")

    return framed(df, build, back=max(rank, trend, squeeze, toxic) + 4, lane=lane)


def regime_probabilities(df: DataFrame) -> DataFrame:
    """Four normalised proxies and the name of the largest."""
    trend = clip("trend_persist", F.lit(0.0), F.lit(1.0))
    expansion = clip("vol_pct", F.lit(0.0), F.lit(1.0)) * (1.0 - trend)
    collapse = flag(F.col("compression_12h") < -0.05) * 0.5 + F.coalesce(
        clip("toxicity_12h", F.lit(0.0)), F.lit(0.0)
    ) * 0.1
    calm = 1.0 + F.abs(clip("compression_12h", None, F.lit(0.0)))
    total = trend + expansion + collapse + calm
    d = df.withColumns(
        {
            f"p_regime_{n}": F.coalesce(safe_div(c, total), F.lit(0.25))
            for n, c in (("trend", trend), ("range", calm), ("expansion", expansion), ("collapse", collapse))
        }
    )
    names = ("trend", "range", "expansion", "collapse")
    top = F.greatest(*[f"p_regime_{n}" for n in names])
    state = F.coalesce(*[F.when(F.col(f"p_regime_{n}") == top, F.lit(n)) for n in names])
    return d.withColumn("regime_state", state)


def structure_context(df: DataFrame, lookback: int = 150, lane: Lane = BARS) -> DataFrame:
    """Bias cascade, premium/discount of the external range, compression flag and zone score."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        rng = safe_div(F.col("high") - F.col("low"), "close")
        d = d.withColumns(
            {"_hi": roll_max("high", w, lookback, 5), "_lo": roll_min("low", w, lookback, 5), "_rng": rng}
        )
        d = d.withColumn("_mr", roll_mean("_rng", w, 20, 5))
        before = F.lag("_mr", 5).over(w)
        d = d.withColumn("_drop", F.coalesce(safe_div(before - F.col("_mr"), before), F.lit(0.0)))
        width = F.col("_hi") - F.col("_lo")
        where = F.when(width > 0, (F.col("close") - F.col("_lo")) / width)
        bias = (
            F.when((F.col("bos_up") == 1) & (F.col("choch_down") == 0), "UP")
            .when((F.col("bos_down") == 1) & (F.col("choch_up") == 0), "DOWN")
            .otherwise(F.upper(F.coalesce("bias", F.lit("NEUTRAL"))))
        )
        score = (
            0.35 * F.nullif("zone_recency", F.lit(0.0)) + 0.30 * F.col("zone_displacement")
            + 0.20 * F.col("zone_mitigation") + 0.10 * F.lit(0.5) + 0.05 * F.lit(0.5)
        )
        return d.withColumns(
            {
                "structural_bias_6h": bias,
                "pd_context_6h": F.when(where <= 0.50, "DISCOUNT").when(where >= 0.65, "PREMIUM").otherwise("MID"),
                "compression_6h": flag((F.col("_rng") <= 0.18) & (F.col("_drop") >= 0.35)),
                "zone_score_6h": score,
            }
        ).drop("_hi", "_lo", "_rng", "_mr", "_drop")

    return framed(df, build, back=lookback + 30, lane=lane)


def flow_block(df: DataFrame, lane: Lane = BARS) -> DataFrame:
    """Impulse bars: body share, volume and range scores, close location, signal, age and strength."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        rng = F.col("high") - F.col("low")
        body = F.col("close") - F.col("open")
        zero = F.lit(0.0)
        d = d.withColumns(
            {
                "flow_range_pct": F.coalesce(safe_div(rng, "close"), zero),
                "flow_body_pct": F.coalesce(safe_div(F.abs(body), rng), zero),
                "flow_close_loc": F.coalesce(clip(safe_div(F.col("close") - F.col("low"), rng), zero, F.lit(1.0)),
                                             F.lit(0.5)),
                "flow_body_dir": F.signum(body).cast("int"),
                "flow_ret": F.coalesce(pct_change("close", w), zero),
            }
        )
        d = d.withColumns(
            {
                "flow_volume_z": F.coalesce(roll_zscore("volume", w, 48, 12), zero),
                "flow_range_z": F.coalesce(roll_zscore("flow_range_pct", w, 48, 12), zero),
            }
        )
        strong = (F.col("flow_body_pct") >= 0.60) & (F.col("flow_volume_z") >= 0.80)
        return d.withColumn(
            "flow_signal",
            F.when(strong & (F.col("flow_body_dir") > 0) & (F.col("flow_close_loc") >= 0.65), 1)
            .when(strong & (F.col("flow_body_dir") < 0) & (F.col("flow_close_loc") <= 0.35), -1)
            .otherwise(0),
        )

    out = bars_since(framed(df, build, back=50, lane=lane), {"flow_age_bars": F.col("flow_signal") != 0}, 999, lane)

    def third(c: str) -> Column:
        return clip(c, F.lit(-1.0), F.lit(3.0)) / 3.0

    strength = 0.55 * clip("flow_body_pct", F.lit(0.0), F.lit(1.0)) + 0.25 * third("flow_volume_z") + 0.20 * third(
        "flow_range_z")
    return out.withColumns(
        {
            "flow_ok": flag((F.col("flow_signal") != 0) | (F.col("flow_age_bars") <= 4)),
            "flow_strength": clip(strength, F.lit(0.0), F.lit(1.0)),
        }
    )


def candle_helpers(df: DataFrame) -> DataFrame:
    """Body share, wick asymmetry, displacement flag, dollar volume, and a fresh-retest flag when events exist."""
    rng = F.col("high") - F.col("low")
    body = F.abs(F.col("close") - F.col("open"))
    upper = clip(F.col("high") - F.greatest("open", "close"), F.lit(0.0))
    lower = clip(F.least("open", "close") - F.col("low"), F.lit(0.0))
    touches = [F.coalesce(F.col(c).cast("int"), F.lit(0))
               for c in ("fvg_touch_flag", "fvg_filled_flag", "sweep_flag") if c in df.columns]
    retest = F.greatest(*touches) if len(touches) > 1 else (touches or [F.lit(0)])[0]
    return df.withColumns(
        {
            "body_pct": body / F.when(rng == 0, 1e-9).otherwise(rng),
            "wick_asymmetry": F.coalesce(safe_div(upper - lower, rng), F.lit(0.0)),
            "displacement": flag(body / F.when(rng == 0, 1e-9).otherwise(rng) >= 0.55),
            "traded_value": F.col("close") * F.col("volume"),
            "fresh_retest": flag(retest > 0),
        }
    )


def cluster_inputs(df: DataFrame, vol_window: int = 64, lane: Lane = BARS) -> DataFrame:
    """Raw-bar inputs for clustering and regime models."""
    zero = F.lit(0.0)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        rng = F.col("high") - F.col("low")
        d = d.withColumns({"_rng": rng, "logret": log_return("close", w)})

        def score(c: str) -> Column:
            frame = trailing(w, 48)
            return (F.col(c) - F.avg(c).over(frame)) / (F.stddev_samp(c).over(frame) + 1e-9)

        return d.withColumns(
            {
                "log_ret": F.coalesce("logret", zero),
                "bar_range_pct": F.coalesce(safe_div(rng, "close"), zero),
                "log_vol": F.coalesce(F.ln(F.nullif("volume", zero)), zero),
                "dollar_vol_log": F.coalesce(F.ln(F.nullif(F.col("close") * F.col("volume"), zero)), zero),
                "range_z": F.coalesce(F.when(F.count("_rng").over(trailing(w, 48)) >= 10, score("_rng")), zero),
                "vol_z": F.coalesce(F.when(F.count("volume").over(trailing(w, 48)) >= 10, score("volume")), zero),
                "hmm_realized_vol": roll_std("logret", w, vol_window, vol_window // 2),
            }
        ).drop("_rng")

    return framed(df, build, back=max(vol_window, 48) + 2, lane=lane)


def return_zscores(df: DataFrame, n: int = 200, lane: Lane = BARS) -> DataFrame:
    """Return and volatility scores; rows without both are dropped."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("ret", pct_change("close", w))
        d = d.withColumns({"ret_z": roll_zscore("ret", w, n), "vol": roll_std("ret", w, n)})
        return d.withColumn("vol_z", roll_zscore("vol", w, n))

    return framed(df, build, back=2 * n + 2, lane=lane).dropna(subset=["ret", "ret_z", "vol", "vol_z"])


def heuristic_structure(df: DataFrame, lane: Lane = BARS) -> DataFrame:
    """6h heuristic bias and zone score from EMA 8/21 spread, slope and trend consistency."""
    base = ema(df, {"_f": 8.0, "_s": 21.0}, lane=lane)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        step = F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0))
        d = d.withColumns({"_step": step, "_slope": F.coalesce(F.col("_f") - F.lag("_f").over(w), F.lit(0.0)),
                           "_spread": F.coalesce(safe_div(F.col("_f") - F.col("_s"), "close"), F.lit(0.0))})
        last12 = trailing(w, 12)
        d = d.withColumns({"_up": F.avg(flag(F.col("_step") > 0)).over(last12),
                           "_dn": F.avg(flag(F.col("_step") < 0)).over(last12)})
        up = (F.col("_spread") >= 0) & (F.col("_slope") >= 0)
        score = 0.35 + 45.0 * F.abs("_spread") + 0.20 * F.when(up, F.col("_up")).otherwise(F.col("_dn"))
        return d.withColumns(
            {"heur_bias_6h": F.when(up, "up").otherwise("down"), "heur_zone_score_6h": clip(score, F.lit(0.0), F.lit(1.0))}
        ).drop("_step", "_slope", "_spread", "_up", "_dn", "_f", "_s")

    return framed(base, build, back=14, lane=lane)


def heuristic_regime(df: DataFrame, history: int | None, lane: Lane = BARS) -> DataFrame:
    """12h heuristic: EMA 12/48 trend odds, ATR and toxicity percent ranks, compression, regime odds.

    ``history`` is the number of rows, up to the current one, in which the percent ranks are taken; None is all of them.
    """
    base = ema(df, {"_f": 12.0, "_s": 48.0}, lane=lane)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        zero = F.lit(0.0)
        spread = F.coalesce(safe_div(F.col("_f") - F.col("_s"), "close"), zero)
        d = d.withColumns(
            {
                "_tr": true_range(w), "_ret": F.abs(F.coalesce(pct_change("close", w), zero)),
                "_rng": F.coalesce(safe_div(F.col("high") - F.col("low"), "close"), zero),
                "heur_p_up": clip(0.5 + 6.0 * spread, F.lit(0.01), F.lit(0.99)),
            }
        )
        d = d.withColumns({"_atr": roll_mean("_tr", w, 14, 1), "_tox": roll_mean("_ret", w, 16, 2),
                           "_mr": roll_mean("_rng", w, 10, 2)})
        if history is not None:
            d = d.withColumns({"_atr_pct": roll_rank_pct("_atr", w, history, 1), "_tox_pct": roll_rank_pct("_tox", w, history, 1)})
        return d.drop("_tr", "_ret", "_rng")

    def odds(d: DataFrame) -> DataFrame:
        one, zero = F.lit(1.0), F.lit(0.0)
        d = d.withColumns(
            {
                "heur_toxicity": clip(F.col("_tox_pct"), zero, one),
                "heur_compression": clip(1.0 - F.col("_mr") * 20.0, zero, one),
                "heur_p_down": clip(1.0 - F.col("heur_p_up"), F.lit(0.01), F.lit(0.99)),
            }
        )
        lo, hi, comp = F.lit(0.01), F.lit(0.99), F.col("heur_compression")
        d = d.withColumns(
            {
                "_trend": clip(0.20 + 0.70 * F.abs(F.col("heur_p_up") - F.col("heur_p_down")), lo, hi),
                "_expansion": clip(0.10 + 0.70 * F.col("_atr_pct") * (1.0 - comp), lo, hi),
                "_collapse": clip(0.05 + 0.60 * comp * (1.0 - F.col("_atr_pct")), lo, hi),
                "_calm": 0.20 + 0.4 * comp,
            }
        )
        total = F.col("_trend") + F.col("_expansion") + F.col("_collapse") + F.col("_calm")
        return d.withColumns(
            {
                "heur_p_trend": F.col("_trend") / total, "heur_p_expansion": F.col("_expansion") / total,
                "heur_p_collapse": F.col("_collapse") / total, "heur_p_range": F.col("_calm") / total,
            }
        ).drop("_atr", "_tox", "_mr", "_atr_pct", "_tox_pct", "_trend", "_expansion", "_collapse", "_calm", "_f", "_s")

    if history is not None:
        return odds(framed(base, build, back=history + 20, lane=lane))
    return odds(rank_so_far(framed(base, build, back=20, lane=lane), {"_atr_pct": "_atr", "_tox_pct": "_tox"}, lane))


def atr_targets(df: DataFrame, side: Column, atr: str = "atr") -> DataFrame:
    """Default price targets at 1.5, 2, 3 and 4 ATR in the direction of ``side``."""
    sign = F.when(side == "long", 1.0).otherwise(-1.0)
    reach = F.greatest(F.coalesce(F.col(atr), F.lit(0.0)), F.lit(1e-9)) * sign
    mult = {"range_edge": 1.5, "swing_target": 2.0, "fvg_target": 3.0, "liquidity_pool": 4.0}
    return df.withColumns({n: F.col("close") + m * reach for n, m in mult.items()})
