"""Forward-looking labels.  Frames here look ahead by design; everything else looks back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.rolling import roll_std
from tickloom.functions.scalar import first_text, flag, pct_change, safe_div, truthy
from tickloom.operators.series import BARS, Lane, framed

Label = Callable[..., DataFrame]


def position_of(values: Column, test: Callable[[Column], Column]) -> Column:
    """1-based position of the first element meeting ``test``, NULL when none does."""
    at = F.array_position(F.transform(values, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True))
    return F.nullif(at, F.lit(0).cast("long"))


def reached_first(ahead: Column, long: Column, stop: Column, target: Column,
                  veto: Callable[[Column], Column] | None = None) -> Column:
    """1 when ``target`` is met before ``stop``; within one bar the stop (or veto) counts first."""
    def stopped(x: Column) -> Column:
        hit = F.when(long, x["low"] <= stop).otherwise(x["high"] >= stop)
        return hit | veto(x) if veto is not None else hit

    out = position_of(ahead, stopped)
    win = position_of(ahead, lambda x: F.when(long, x["high"] >= target).otherwise(x["low"] <= target))
    return flag(win.isNotNull() & (out.isNull() | (win < out)))


def direction(df: DataFrame) -> Column:
    """+1/-1/0 from the first source that says something: side, flow, sweep, break, bias."""
    have = set(df.columns)

    def sign(c: str) -> Column:
        s = F.signum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).cast("int")
        return F.when(s != 0, s)

    def pair(up: str, down: str) -> Column:
        # when both are set the later assignment, down, stands
        return F.when(truthy(down, "int"), -1).when(truthy(up, "int"), 1)

    steps = []
    if "side" in have:
        side = F.upper(F.trim("side"))
        steps.append(F.when(side == "LONG", 1).when(side == "SHORT", -1))
    steps += [sign(c) for c in ("flow_signal_1h", "sweep_dir") if c in have]
    if {"sweep_low", "sweep_high"} <= have:
        steps.append(pair("sweep_low", "sweep_high"))
    if {"bos_up", "bos_down"} <= have:
        steps.append(pair("bos_up", "bos_down"))
    texts = [c for c in ("bias", "structural_bias_6h") if c in have]
    if texts:
        t = first_text(*texts)
        steps.append(F.when(t == "UP", 1).when(t == "DOWN", -1))
    return F.coalesce(*steps, F.lit(0))


def opposite_reversal() -> tuple[Column, Column]:
    """(against a long, against a short)."""
    bias = first_text("bias")
    turned = F.col("choch_flag") == 1
    return (
        (F.col("choch_down") == 1) | (turned & (bias == "DOWN")),
        (F.col("choch_up") == 1) | (turned & (bias == "UP")),
    )


def liquidity_flow(df: DataFrame, horizon: int = 12, min_r: float = 1.0, min_body: float = 0.55,
                   require_displacement: bool = True, atr: str = "atr", lane: Lane = BARS) -> DataFrame:
    """After a sweep: +``min_r`` ATR before price returns through the swept level."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        side = F.when(F.col("sweep_low") == 1, 1).when(F.col("sweep_high") == 1, -1).otherwise(0)
        stop = F.coalesce("swept_level", F.when(side > 0, F.col("low")).otherwise(F.col("high")))
        d = d.withColumns({"_dir": side, "_stop": stop, "_to": F.col("close") + side * min_r * F.col(atr),
                           "_ahead": F.collect_list(F.struct("low", "high")).over(w.rowsBetween(1, horizon))})
        body = F.coalesce("displacement_hint", safe_div(F.abs(F.col("close") - F.col("open")),
                                                        F.greatest(F.col("high") - F.col("low"), F.lit(1e-9))))
        ready = (F.col("_dir") != 0) & (F.col(atr) > 0)
        if require_displacement:
            ready = ready & (body >= min_body)
        hit = reached_first(F.col("_ahead"), F.col("_dir") > 0, F.col("_stop"), F.col("_to"))
        return d.withColumn("label_liq_flow", F.when(ready, hit).otherwise(0)).drop("_dir", "_stop", "_to", "_ahead")

    return framed(df, build, ahead=horizon, lane=lane)


def break_continuation(df: DataFrame, horizon: int = 48, min_r: float = 3.0, buffer: float = 0.30, atr: str = "atr",
                       lane: Lane = BARS) -> DataFrame:
    """After a structure break: ``min_r`` ATR before the broken level or an opposite reversal."""
    against_long, against_short = opposite_reversal()

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        side = F.when(F.col("bos_up") == 1, 1).when(F.col("bos_down") == 1, -1).otherwise(0)
        long = side > 0
        entry, a = F.col("close"), F.col(atr)
        stop = F.when(long, F.coalesce(F.col("broken_level"), entry - a) - buffer * a).otherwise(
            F.coalesce(F.col("broken_level"), entry + a) + buffer * a)
        d = d.withColumns({"_ol": against_long, "_os": against_short})
        d = d.withColumns({"_dir": side, "_stop": stop, "_to": entry + side * min_r * a,
                           "_ahead": F.collect_list(F.struct("low", "high", "_ol", "_os")).over(w.rowsBetween(1, horizon))})
        up = F.col("_dir") > 0
        hit = reached_first(F.col("_ahead"), up, F.col("_stop"), F.col("_to"),
                            lambda x: F.when(up, x["_ol"]).otherwise(x["_os"]))
        ready = (F.col("_dir") != 0) & (a > 0)
        return d.withColumn("label_bos_cont", F.when(ready, hit).otherwise(0)).drop(
            "_dir", "_stop", "_to", "_ahead", "_ol", "_os")

    return framed(df, build, ahead=horizon, lane=lane)


def momentum(df: DataFrame, first: int = 4, last: int = 8, noise_sigma: float = 0.75, ret_sigma: float = 1.20,
             lane: Lane = BARS) -> DataFrame:
    """Best close ``first..last`` bars ahead beats the volatility-scaled threshold.

    The 50-bar noise estimate is copied back to the rows before its first value (a documented look-ahead).
    """
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_ret", F.coalesce(pct_change("close", w), F.lit(0.0)))
        d = d.withColumn("_noise", roll_std("_ret", w, 50))
        d = d.withColumns({"_noise": F.first("_noise", ignorenulls=True).over(w.rowsBetween(0, 49)),
                           "_best": F.max("close").over(w.rowsBetween(first, last))})
        gain = safe_div(F.col("_best") - F.col("close"), "close")
        hit = (F.col("close") > 0) & (F.col("_noise") != 0) & (gain >= F.col("_noise") * (ret_sigma + noise_sigma))
        return d.withColumn("label_momo", flag(hit)).drop("_ret", "_noise", "_best")

    return framed(df, build, back=51, ahead=max(last, 50), lane=lane)


def flow_follow_through(df: DataFrame, first: int = 4, last: int = 12, min_r: float = 1.5, stop_r: float = 1.0,
                        min_body: float = 0.60, min_volume_z: float = 0.80, max_age: int = 4, atr: str = "atr",
                        lane: Lane = BARS) -> DataFrame:
    """Recent strong higher-timeframe impulse: ``min_r`` before ``stop_r`` within bars ``first..last``."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        side = F.signum(F.coalesce(F.col("flow_signal_1h").cast("double"), F.lit(0.0)))
        d = d.withColumns({"_dir": side, "_stop": F.col("close") - side * stop_r * F.col(atr),
                           "_to": F.col("close") + side * min_r * F.col(atr),
                           "_ahead": F.collect_list(F.struct("low", "high")).over(w.rowsBetween(first, last))})
        ready = (
            (F.col("_dir") != 0) & (F.coalesce("displacement_body_pct_1h", F.lit(0.0)) >= min_body)
            & (F.coalesce("volume_z_1h", F.lit(0.0)) >= min_volume_z)
            & (F.coalesce(F.col("flow_age_bars_1h"), F.lit(999)) <= max_age) & (F.col(atr) > 0)
        )
        hit = reached_first(F.col("_ahead"), F.col("_dir") > 0, F.col("_stop"), F.col("_to"))
        return d.withColumn("label_flow_1h", F.when(ready, hit).otherwise(0)).drop("_dir", "_stop", "_to", "_ahead")

    return framed(df, build, ahead=last, lane=lane)


def opportunity(df: DataFrame, candidate: Column, horizon: int = 96, lane: Lane = BARS) -> DataFrame:
    """1 when any of the next ``horizon`` bars is a candidate."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_cand", flag(candidate))
        return d.withColumn("label_eop", F.coalesce(F.max("_cand").over(w.rowsBetween(1, horizon)), F.lit(0))).drop("_cand")

    return framed(df, build, ahead=horizon, lane=lane)


def danger(df: DataFrame, horizon: int = 96, drop_r: float = 3.0, atr: str = "atr", lane: Lane = BARS) -> DataFrame:
    """1 when the low falls ``drop_r`` ATR below the close within ``horizon`` bars."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        worst = F.min("low").over(w.rowsBetween(1, horizon))
        hit = (F.col(atr) > 0) & (F.col("close") > 0) & (worst <= F.col("close") - drop_r * F.col(atr))
        return d.withColumn("label_edp", flag(hit))

    return framed(df, build, ahead=horizon, lane=lane)


def survival(df: DataFrame, horizon: int = 48, stop_r: float = 1.0, atr: str = "atr", lane: Lane = BARS) -> DataFrame:
    """Bars until the stop or an opposite reversal; ``horizon`` and no event when neither comes."""
    against_long, against_short = opposite_reversal()
    side = direction(df)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        long = F.when(side == 0, F.lit(1)).otherwise(side) > 0
        a = F.col(atr)
        d = d.withColumns({"_ol": against_long, "_os": against_short, "_long": long})
        d = d.withColumns({"_stop": F.when(F.col("_long"), F.col("close") - stop_r * a).otherwise(F.col("close") + stop_r * a),
                           "_ahead": F.collect_list(F.struct("low", "high", "_ol", "_os")).over(w.rowsBetween(1, horizon))})
        up = F.col("_long")
        at = position_of(F.col("_ahead"), lambda x: F.when(up, (x["low"] <= F.col("_stop")) | x["_ol"]).otherwise(
            (x["high"] >= F.col("_stop")) | x["_os"]))
        valid = (a > 0) & (F.col("close") > 0)
        at = F.when(valid, at)
        return d.withColumns(
            {"hazard_event": flag(at.isNotNull()), "hazard_time": F.coalesce(at, F.lit(horizon)).cast("int")}
        ).drop("_ol", "_os", "_long", "_stop", "_ahead")

    return framed(df, build, ahead=horizon, lane=lane)


def forward_returns(df: DataFrame, horizons: tuple[int, ...] = (1, 4, 12), lane: Lane = BARS) -> DataFrame:
    return framed(
        df,
        lambda d, w: d.withColumns(
            {f"fwd_ret_{h}": F.ln(safe_div(F.lead("close", h).over(w), F.col("close"))) for h in horizons}
        ),
        ahead=max(horizons), lane=lane,
    )


# label name -> function; the horizon sweep looks labels up here
LABELS: dict[str, Label] = {
    "liq_flow": liquidity_flow, "bos_cont": break_continuation, "momo": momentum,
    "flow_1h": flow_follow_through, "eop": opportunity, "edp": danger, "hazard": survival,
}
# the column in which each of them leaves its label
LABEL_COLUMNS = {**{name: f"label_{name}" for name in LABELS}, "hazard": "hazard_event"}
