"""Trade-ledger analytics: attribution, calendars, equity, streaks, tail risk, stress."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import clip, flag, safe_div
from tickloom.operators.quantile import exact_quantiles, quantile_buckets
from tickloom.operators.series import IDX, LEDGER, Lane, carry_last, framed, index_rows, pin, running_peak

# Canonical ledger columns with their defaults, and the names they replace.
NUMBER_DEFAULTS = ("entry_price", "exit_price", "pnl", "r", "conf", "evr", "risk", "stop_price", "size_usd", "qty",
                   "hazard_entry")
TEXT_DEFAULTS = {"trade_id": "", "asset": "", "side": "long", "tier": "unranked", "override": "", "reason": "",
                 "leg": "core", "regime": "unknown", "session": "unknown"}
ALIASES = {"entry_time": "entry_ts", "exit_time": "exit_ts", "realized_r": "r", "r_mult": "r", "entry": "entry_price",
           "exit": "exit_price", "stop": "stop_price", "hazard_at_entry": "hazard_entry", "regime_state": "regime",
           "timestamp": "entry_ts", "size": "size_usd"}
START_EQUITY = 20000.0


def normalise(df: DataFrame) -> DataFrame:
    """Canonical names, types, defaults for absent columns, and the win/loss/flat result."""
    taken = set(df.columns)
    for old, new in ALIASES.items():
        if old in taken and new not in taken:
            df = df.withColumnRenamed(old, new)
            taken = set(df.columns)
    cols: dict[str, Column] = {}
    for c in ("entry_ts", "exit_ts"):
        cols[c] = F.col(c).try_cast("timestamp") if c in taken else F.lit(None).cast("timestamp")
    for c in NUMBER_DEFAULTS:
        cols[c] = F.col(c) if c in taken else F.lit(0.0)
    for c, v in TEXT_DEFAULTS.items():
        cols[c] = F.col(c) if c in taken else F.lit(v)
    cols["gates"] = F.col("gates") if "gates" in taken else F.create_map().cast("map<string,boolean>")
    cols["gate_reasons"] = F.col("gate_reasons") if "gate_reasons" in taken else F.array().cast("array<string>")
    if "result" in taken:
        cols["result"] = F.col("result")
    else:
        cols["result"] = F.when(cols["pnl"] > 0, "win").when(cols["pnl"] < 0, "loss").otherwise("flat")
    return df.select(*[c.alias(n) for n, c in cols.items()])


def with_period_labels(df: DataFrame, ts: str = "entry_ts") -> DataFrame:
    """Date, ISO week, week ending Monday, month, weekday, hour, duration, PnL % and outcome."""
    day = F.to_date(ts)
    # weeks that end on Monday start on Tuesday
    tuesday = F.date_add(F.to_date(F.date_trunc("week", F.date_sub(day, 1))), 1)
    minutes = F.greatest((F.unix_micros("exit_ts") - F.unix_micros("entry_ts")) / 60e6, F.lit(0.0))
    return df.withColumns(
        {
            "day": day, "iso_week": F.to_date(F.date_trunc("week", day)),
            "week": F.concat_ws("/", tuesday.cast("string"), F.date_add(tuesday, 6).cast("string")),
            "month": F.date_format(day, "yyyy-MM"), "weekday": F.weekday(day), "hour": F.hour(ts),
            "duration_min": F.when(F.col("exit_ts").isNotNull(), minutes),
            "duration_hr": F.when(F.col("exit_ts").isNotNull(), minutes / 60.0),
            "pnl_pct": F.when(F.abs("size_usd") > 1e-9, F.col("pnl") / F.col("size_usd") * 100.0),
            "outcome": F.when(F.col("pnl") > 0, "win").when(F.col("pnl") < 0, "loss").otherwise("flat"),
        }
    )


def texts(df: DataFrame) -> DataFrame:
    """Reasons and gates as display text."""
    pairs = F.transform(F.map_entries("gates"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return df.withColumns(
        {"gate_reasons_txt": F.array_join("gate_reasons", ", "), "gates_txt": F.array_join(pairs, ", ")}
    )


def select_trades(df: DataFrame, members: Mapping[str, Sequence[str]], floors: Mapping[str, float],
                  winners: bool = False, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Membership, floors (a missing value never passes one), winners, and an inclusive date range."""
    keep = F.lit(True)
    for c, allowed in members.items():
        keep = keep & F.col(c).isin(*allowed)
    for c, low in floors.items():
        keep = keep & (F.coalesce(F.col(c), F.lit(float("-inf"))) >= low)
    if winners:
        keep = keep & (F.coalesce(F.col("pnl"), F.lit(0.0)) > 0)
    if first_day:
        keep = keep & (F.col("entry_ts") >= F.to_timestamp(F.lit(first_day)))
    if last_day:
        keep = keep & (F.col("entry_ts") < F.to_timestamp(F.date_add(F.to_date(F.lit(last_day)), 1)))
    return df.filter(keep)


def trade_summary() -> list[Column]:
    """The aggregates shared by the calendar and attribution tables."""
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    return [
        F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"), F.count_if(win).alias("wins"),
        F.count_if(loss).alias("losses"), (F.count_if(win) / F.count(F.lit(1))).alias("win_rate"),
        F.avg("r").alias("avg_r"), F.max("r").alias("best_r"), F.min("r").alias("worst_r"),
        F.avg("conf").alias("avg_conf"), F.avg("evr").alias("avg_evr"),
    ]


def by_period(df: DataFrame, period: str) -> DataFrame:
    return df.groupBy(F.col(period).cast("string").alias("period")).agg(*trade_summary())


def attribution(df: DataFrame, dims: Sequence[str], keep_missing: bool = True) -> DataFrame:
    """All groupings in one pass; a missing group value is kept as NULL or left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in dims])
    d = df.withColumn("_g", F.explode(pairs)).withColumns({"dim": F.col("_g.dim"), "value": F.col("_g.value")})
    return (d if keep_missing else d.filter(F.col("value").isNotNull())).groupBy("dim", "value").agg(*trade_summary())


def heatmap(df: DataFrame, key: str, ts: str = "entry_ts") -> DataFrame:
    return df.groupBy(F.col(key).alias("value"), F.to_date(ts).cast("string").alias("day")).agg(F.sum("pnl").alias("pnl"))


# Labels of the weekday, hour and hold-time tables.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
HOLDS = ("<15m", "15m-1h", "1h-4h", "4h-12h", ">12h")


def clock_tables(df: DataFrame, ts: str = "exit_ts") -> DataFrame:
    """Weekday, hour and hold-time statistics with a zero row for every empty bucket."""
    held = F.greatest(F.coalesce((F.unix_micros("exit_ts") - F.unix_micros("entry_ts")) / 60e6, F.lit(0.0)), F.lit(0.0))
    hold = (F.when(held < 15, HOLDS[0]).when(held < 60, HOLDS[1]).when(held < 240, HOLDS[2]).when(held < 720, HOLDS[3])
            .otherwise(HOLDS[4]))
    day = F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(ts) + 1)
    hour = F.concat(F.lpad(F.hour(ts).cast("string"), 2, "0"), F.lit(":00"))
    cells = F.array(*[F.struct(F.lit(t).alias("table"), c.alias("label")) for t, c in
                      (("weekday", day), ("hour", hour), ("hold", hold))])
    seen = (
        df.withColumn("_c", F.explode(cells)).groupBy(F.col("_c.table").alias("table"), F.col("_c.label").alias("label"))
        .agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"))
    )
    labels = [("weekday", w) for w in WEEKDAYS] + [("hour", f"{h:02d}:00") for h in range(24)] + [("hold", h) for h in HOLDS]
    spine = df.sparkSession.createDataFrame(labels, "table string, label string")
    return spine.join(seen, ["table", "label"], "left").select(
        "table", "label", F.coalesce("pnl", F.lit(0.0)).alias("pnl"), F.coalesce("trades", F.lit(0)).alias("trades"),
        F.coalesce(safe_div(F.col("wins") * 100.0, F.col("trades")), F.lit(0.0)).alias("win_rate_pct"),
    )


def kpis(df: DataFrame) -> DataFrame:
    """One row of ledger figures; an undefined profit factor is NULL."""
    pnl, win, loss = F.col("pnl"), F.col("pnl") > 0, F.col("pnl") < 0
    long, short = F.col("side") == "long", F.col("side") == "short"
    gain = F.sum(F.when(win, pnl))
    pain = -F.sum(F.when(loss, pnl))
    held = F.greatest((F.unix_micros("exit_ts") - F.unix_micros("entry_ts")) / 60e6, F.lit(0.0))
    return df.agg(
        F.count(F.lit(1)).alias("trades"), F.avg(flag(win)).alias("win_rate"),
        F.avg(F.when(long, flag(win))).alias("win_rate_long"), F.avg(F.when(short, flag(win))).alias("win_rate_short"),
        F.avg("r").alias("avg_r"), F.avg("pnl").alias("expectancy"), F.sum("pnl").alias("total_pnl"),
        safe_div(gain, pain).alias("profit_factor"),
        safe_div(F.avg(F.when(win, pnl)), F.abs(F.avg(F.when(loss, pnl)))).alias("payoff"),
        F.avg(F.when(win, pnl)).alias("avg_win"), F.avg(F.when(loss, pnl)).alias("avg_loss"),
        F.max("pnl").alias("max_win"), F.min("pnl").alias("max_loss"), F.avg(held).alias("avg_hold_min"),
    )


def r_quantiles(df: DataFrame, qs: Sequence[float] = (0.5, 0.95, 0.99), value: str = "r") -> DataFrame:
    return exact_quantiles(df, value, qs)


def override_counts(df: DataFrame) -> DataFrame:
    o = F.col("override")
    return df.agg(F.count_if(o == "moonshot").alias("moonshot_overrides"), F.count_if(o == "2R").alias("two_r_overrides"),
                  F.count_if(o.isNull()).alias("normal_entries"))


def growth_and_ratios(df: DataFrame, start_equity: float = START_EQUITY) -> DataFrame:
    """Compound growth over the ledger's span; annualised Sharpe and Sortino of daily PnL on start equity."""
    closed = df.filter(F.col("exit_ts").isNotNull())
    days = closed.groupBy(F.to_date("exit_ts").alias("d")).agg(
        F.sum("pnl").alias("_pnl"), F.min("entry_ts").alias("_lo"), F.max("exit_ts").alias("_hi")
    ).withColumn("_ret", F.col("_pnl") / start_equity)
    years = F.greatest(
        F.floor((F.unix_micros(F.max("_hi")) - F.unix_micros(F.min("_lo"))) / 86400e6) / 365.0, F.lit(1e-9))
    final = (F.lit(start_equity) + F.sum("_pnl")) / start_equity
    root = 252.0 ** 0.5
    return days.agg(
        F.when(final > 0, F.pow(final, 1.0 / years) - 1.0).alias("cagr"),
        (safe_div(F.avg("_ret"), F.stddev_samp("_ret")) * root).alias("sharpe"),
        (safe_div(F.avg("_ret"), F.stddev_samp(F.when(F.col("_ret") < 0, F.col("_ret")))) * root).alias("sortino"),
    )


def ordered(df: DataFrame, order: Sequence[str] = ("entry_ts", "trade_id")) -> DataFrame:
    """Ledger with each trade's exact position; ``trade_id`` breaks ties in time."""
    return index_rows(df, (), order)


def equity_curve(rows: DataFrame, start_equity: float = START_EQUITY, value: str = "pnl", lane: Lane = LEDGER,
                 peak_from_start: bool = False) -> DataFrame:
    """Running equity, its peak, drawdown, and the return each trade made on the equity before it."""
    d = running_peak(rows.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(0.0))), "_v", lane)
    start = F.lit(float(start_equity))
    equity, peak = start + F.col("_sum"), start + F.col("_top")
    d = d.withColumns({"equity": equity, "peak": F.greatest(peak, start) if peak_from_start else peak})
    before = F.greatest(F.col("equity") - F.col("_v"), F.lit(1e-9))
    return d.withColumns(
        {
            "drawdown": F.col("equity") - F.col("peak"),
            "drawdown_pct": F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0),
            "ret_on_equity": F.col("_v") / before,
        }
    ).drop("_v", "_sum", "_top")


def streaks(rows: DataFrame, zero_resets: bool = False, lane: Lane = LEDGER) -> DataFrame:
    """Signed length of the running win (+) or loss (-) streak at every trade.

    ``zero_resets=False`` counts a zero as a loss; otherwise it ends both runs.
    """
    pnl = F.coalesce("pnl", F.lit(0.0))
    if zero_resets:
        state = F.signum(pnl).cast("int")
    else:
        state = F.when(pnl > 0, 1).otherwise(-1)
    d = rows.withColumn("_state", state)
    d = framed(d, lambda x, w: x.withColumn("_new", F.coalesce(F.lag("_state").over(w) != F.col("_state"), F.lit(True))),
               back=1, lane=lane)
    d = carry_last(d, {"_from": F.when(F.col("_new"), F.col(IDX))}, lane)
    return d.withColumn("streak", F.col("_state") * (F.col(IDX) - F.col("_from") + 1)).drop("_state", "_new", "_from")


def longest_streaks(rows: DataFrame, zero_resets: bool = False, lane: Lane = LEDGER) -> DataFrame:
    return streaks(rows, zero_resets, lane).agg(
        F.greatest(F.max("streak"), F.lit(0)).alias("max_win_streak"),
        F.greatest(-F.min("streak"), F.lit(0)).alias("max_loss_streak"),
    )


def bucket_attribution(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """PnL by quantile bin of ``col``; nothing when it has fewer than four distinct values."""
    known = df.filter(F.col(col).isNotNull())
    few = known.select(col).distinct().limit(max(bins, 4)).count()
    n = min(bins, few)
    out = quantile_buckets(known, col, n, "bin") if few >= 4 else known.withColumn("bin", F.lit(None).cast("int")).limit(0)
    return out.groupBy("bin").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("pnl"), F.avg(flag(F.col("pnl") > 0)).alias("win_rate"),
        F.avg("r").alias("avg_r"),
    )


def stress_grid(df: DataFrame, a: str, b: str, bins: int = 4) -> DataFrame:
    """Mean PnL by quantile bin of two columns, one column per bin of ``b``."""
    d = quantile_buckets(quantile_buckets(df, a, bins, "bin_a"), b, bins, "bin_b")
    return d.groupBy("bin_a").pivot("bin_b", list(range(1, bins + 1))).agg(F.avg("pnl"))


def reason_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("gate_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("trades"))


def exposures(df: DataFrame, equity: float, max_gross: float = 1.0) -> DataFrame:
    """Long, short, net and gross notional per asset of open positions, and the gross limit check."""
    size = F.abs("size_usd")
    per_asset = df.filter(F.col("exit_ts").isNull()).groupBy("asset").agg(
        F.coalesce(F.sum(F.when(F.col("side") == "long", size)), F.lit(0.0)).alias("long"),
        F.coalesce(F.sum(F.when(F.col("side") != "long", size)), F.lit(0.0)).alias("short"),
    )
    d = per_asset.withColumns({"net": F.col("long") - F.col("short"), "gross": F.abs("long") + F.abs("short")})
    book = d.agg(F.sum("gross").alias("g"))
    return d.withColumns(
        {
            "risk_weight": F.col("gross") / equity if equity > 0 else F.col("gross"),
            "leverage": book.scalar() / equity if equity > 0 else F.lit(0.0),
            "within_limits": flag(book.scalar() <= max_gross * equity),
        }
    )


def to_date_pnl(df: DataFrame, ts: str = "entry_ts") -> DataFrame:
    """PnL since the start of the day, week and month of the latest trade, and over the last 1, 7 and 30 days."""
    latest = df.agg(F.max(ts).alias("t")).scalar()
    t = F.col(ts)

    def since(start: Column) -> Column:
        return F.coalesce(F.sum(F.when(t >= start, F.col("pnl"))), F.lit(0.0))

    out = [since(F.date_trunc(u, latest)).alias(f"pnl_{u}") for u in ("day", "week", "month")]
    for n in (1, 7, 30):
        start = F.timestamp_micros(F.unix_micros(latest) - n * 86400 * 1_000_000)
        out += [since(start).alias(f"pnl_last_{n}d"), F.count_if(t >= start).alias(f"trades_last_{n}d"),
                F.avg(F.when(t >= start, F.col("r"))).alias(f"avg_r_last_{n}d")]
    return df.agg(*out)


def weighted_entry(legs: DataFrame, key: str, qty: str = "qty", price: str = "price") -> DataFrame:
    return legs.groupBy(key).agg(
        F.sum(qty).alias("qty"), safe_div(F.sum(F.col(qty) * F.col(price)), F.sum(qty)).alias("avg_entry")
    )


def trade_events(df: DataFrame) -> DataFrame:
    """Entry and exit rows of each trade; an exit whose reason mentions a stop is a ``stop``."""
    kind = F.when(F.lower(F.coalesce("reason", F.lit(""))).contains("stop"), "stop").otherwise("exit")
    none = F.lit(None).cast("double")
    steps = F.array(
        F.struct(F.col("entry_ts").alias("ts"), F.lit("entry").alias("type"), F.col("entry_price").alias("price"),
                 F.lit("entry").alias("reason"), none.alias("pnl"), none.alias("r")),
        F.struct(F.col("exit_ts").alias("ts"), kind.alias("type"), F.col("exit_price").alias("price"),
                 F.coalesce("reason", F.lit("exit")).alias("reason"), F.col("pnl").alias("pnl"), F.col("r").alias("r")),
    )
    return df.select("trade_id", "asset", "side", "leg", "tier", F.explode(steps).alias("e")).select(
        "trade_id", "asset", "side", "leg", "tier", "e.*").filter(F.col("ts").isNotNull())


def chart_markers(df: DataFrame) -> DataFrame:
    """Chart position, shape and text for entries and exits."""
    long = F.col("side") == "long"
    e = trade_events(df)
    entry = F.col("type") == "entry"
    return e.select(
        "trade_id", "ts",
        F.when(entry == long, "belowBar").otherwise("aboveBar").alias("position"),
        F.when(~entry, "circle").when(long, "arrowUp").otherwise("arrowDown").alias("shape"),
        F.when(entry, F.concat_ws(" ", F.lit("entry"), "tier"))
        .otherwise(F.concat(F.lit("exit "), F.when(F.col("pnl") >= 0, "+").otherwise(""), F.bround("pnl", 0).cast("long").cast("string")))
        .alias("text"),
    )


def lifecycle(events: DataFrame, entry_types: Sequence[str] = ("entry", "reasoning", "alert"),
              exit_types: Sequence[str] = ("exit", "exit_trade", "closed_trade"), tie: str = "event_id") -> DataFrame:
    """Earliest entry-type and latest exit-type event of every trade, duration and status."""
    is_in, is_out = F.col("event_type").isin(*entry_types), F.col("event_type").isin(*exit_types)
    at = F.struct("ts", tie)
    row = F.struct("ts", "event_type", "value")
    g = events.filter(F.length("trade_id") > 0).groupBy("trade_id").agg(
        F.min_by(row, F.when(is_in, at)).alias("_first_in"), F.min_by(row, at).alias("_first"),
        F.max_by(row, F.when(is_out, at)).alias("_out"),
    ).withColumn("_in", F.coalesce("_first_in", "_first"))
    return g.select(
        "trade_id", F.col("_in.ts").alias("entry_ts"), F.col("_out.ts").alias("exit_ts"),
        F.when(F.col("_out").isNotNull(), "closed").otherwise("open").alias("status"),
        F.col("_in.event_type").alias("entry_reason"), F.coalesce("_out.event_type", F.lit("")).alias("exit_reason"),
        F.col("_in.value").alias("entry_value"), F.col("_out.value").alias("exit_value"),
        F.greatest((F.unix_micros("_out.ts") - F.unix_micros("_in.ts")) / 60e6, F.lit(0.0)).alias("duration_min"),
    )


# The stress scenarios and the pass thresholds.
SCENARIOS = (
    {"name": "baseline"},
    {"name": "cost_pressure", "slippage_bps": 3.0, "spread_bps": 4.0, "fee_bps": 2.0},
    {"name": "latency_1bar", "latency_bars": 1, "latency_penalty_r": 0.15},
    {"name": "partial_fill", "fill_ratio": 0.75, "slippage_bps": 5.0, "spread_bps": 6.0, "fee_bps": 2.0,
     "latency_bars": 1, "latency_penalty_r": 0.10},
    {"name": "adverse_tail", "slippage_bps": 5.0, "spread_bps": 6.0, "fee_bps": 2.0, "winner_haircut": 0.90,
     "loss_multiplier": 1.25},
    {"name": "hard_regime", "fill_ratio": 0.65, "slippage_bps": 8.0, "spread_bps": 10.0, "fee_bps": 3.0,
     "latency_bars": 2, "latency_penalty_r": 0.20, "winner_haircut": 0.85, "loss_multiplier": 1.35},
)
NEUTRAL = {"slippage_bps": 0.0, "spread_bps": 0.0, "fee_bps": 0.0, "fill_ratio": 1.0, "latency_bars": 0,
           "latency_penalty_r": 0.0, "winner_haircut": 1.0, "loss_multiplier": 1.0, "pnl_shift_usd": 0.0}
MAX_DRAWDOWN, MAX_CVAR, MIN_ENDING, MAX_RUIN = 0.40, 0.03, 0.75, 0.80


def stressed(df: DataFrame, scenarios: Sequence[Mapping] = SCENARIOS) -> DataFrame:
    """Every trade under every scenario (a handful of literal rows exploded per trade), with ``adj_pnl``."""
    rows = [{**NEUTRAL, **s} for s in scenarios]
    packed = F.array(*[
        F.struct(F.lit(s["name"]).alias("name"), *[F.lit(float(s[k])).alias(k) for k in NEUTRAL]) for s in rows])
    d = df.withColumn("_s", F.explode(packed))
    s = F.col("_s")
    size = F.abs(F.coalesce("size_usd", F.lit(0.0)))
    one_r = F.abs(F.coalesce("entry_price", F.lit(0.0)) - F.coalesce("stop_price", F.lit(0.0))) * F.abs(
        F.coalesce("qty", F.lit(0.0)))
    one_r = F.when(one_r > 1e-9, one_r).otherwise(F.greatest(size * 0.01, F.lit(1e-9)))
    fill = F.least(F.greatest(s["fill_ratio"], F.lit(0.0)), F.lit(1.0))
    bps = F.greatest(s["slippage_bps"] + s["spread_bps"] + s["fee_bps"], F.lit(0.0))
    d = d.withColumn("adj_pnl", F.coalesce("pnl", F.lit(0.0)) * fill - size * (bps / 10000.0) * fill)
    late = F.when((s["latency_bars"] > 0) & (s["latency_penalty_r"] > 0),
                  one_r * s["latency_bars"] * s["latency_penalty_r"]).otherwise(0.0)
    p = F.col("adj_pnl")
    d = d.withColumn("adj_pnl", F.when(p >= 0, p - late).otherwise(p - late * 0.5))
    d = d.withColumn("adj_pnl", F.when(p > 0, p * s["winner_haircut"]).otherwise(p))
    d = d.withColumn("adj_pnl", F.when(p < 0, p * s["loss_multiplier"]).otherwise(p) + s["pnl_shift_usd"])
    return d.withColumn("scenario", s["name"]).drop("_s")


def ruin_odds(win_rate: Column, wins: Column, losses: Column, avg_win: Column, avg_loss: Column, equity: float) -> Column:
    """Closed-form ruin proxy from the edge and the number of average losses the capital covers."""
    payoff = avg_win / F.abs(avg_loss)
    edge = win_rate - (1.0 - win_rate) / F.greatest(payoff, F.lit(1e-9))
    units = clip(F.lit(equity) / F.greatest(F.abs(avg_loss), F.lit(1e-9)), F.lit(1.0), F.lit(200.0))
    return (
        F.when((wins == 0) | (losses == 0), F.when(losses > 0, 1.0).otherwise(0.0))
        .when(edge <= 0, 1.0).otherwise(clip(F.exp(-2.0 * edge * units), F.lit(0.0), F.lit(1.0)))
    )


def stress_report(df: DataFrame, equity: float, scenarios: Sequence[Mapping] = SCENARIOS) -> DataFrame:
    """Per scenario: equity path extremes, 5 % value at risk and tail mean, ruin proxy, verdict, change to baseline.

    The tail mean averages the returns at or below the exact 5 % quantile of each scenario.
    """
    lane = Lane(keys=("scenario",), block=LEDGER.block)
    needed = df.select("entry_ts", "trade_id", "pnl", "size_usd", "qty", "entry_price", "stop_price")
    rows = stressed(ordered(needed), scenarios).select("scenario", IDX, "adj_pnl")
    # read three times below: for the quantile, the tail and the path
    path = pin(equity_curve(rows, equity, "adj_pnl", lane, peak_from_start=True).drop("peak", "drawdown"))
    # one row per scenario; pinned, so that the path is not shuffled into one task per scenario to meet it
    var = pin(exact_quantiles(path, "ret_on_equity", (0.05,), ("scenario",)).select("scenario", F.col("value").alias("var95")))
    p, win, loss = F.col("adj_pnl"), F.col("adj_pnl") > 0, F.col("adj_pnl") < 0
    m = path.join(var, "scenario").groupBy("scenario").agg(
        F.count(F.lit(1)).alias("trades"), F.avg(flag(win)).alias("win_rate"), F.sum(p).alias("total_pnl"),
        F.max_by("equity", IDX).alias("ending_equity"), F.greatest(F.max("drawdown_pct"), F.lit(0.0)).alias("max_drawdown_pct"),
        F.first("var95").alias("var95"),
        F.avg(F.when(F.col("ret_on_equity") <= F.col("var95"), F.col("ret_on_equity"))).alias("cvar95"),
        F.count_if(win).alias("_w"), F.count_if(loss).alias("_l"), F.coalesce(F.avg(F.when(win, p)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(loss, p)), F.lit(0.0)).alias("avg_loss"),
    )
    m = m.withColumns(
        {
            "payoff_ratio": F.when((F.col("avg_win") > 0) & (F.col("avg_loss") < 0), F.col("avg_win") / F.abs("avg_loss"))
            .otherwise(0.0),
            "risk_of_ruin_proxy": ruin_odds(F.col("win_rate"), F.col("_w"), F.col("_l"), F.col("avg_win"),
                                            F.nullif("avg_loss", F.lit(0.0)), equity),
        }
    ).drop("_w", "_l")
    reasons = F.array_compact(F.array(
        F.when(F.col("max_drawdown_pct") > MAX_DRAWDOWN, "max_drawdown"),
        F.when(F.abs("cvar95") > MAX_CVAR, "cvar95"),
        F.when(F.col("ending_equity") < equity * MIN_ENDING, "ending_equity_floor"),
        F.when(F.col("risk_of_ruin_proxy") > MAX_RUIN, "risk_of_ruin_proxy"),
    ))
    m = m.withColumns({"reasons": F.array_join(reasons, ","), "passed": flag(F.size(reasons) == 0)})
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row per scenario
    is_base = F.col("scenario") == scenarios[0]["name"]
    return m.withColumns(
        {f"delta_{c}": F.col(c) - F.max(F.when(is_base, F.col(c))).over(every) for c in ("total_pnl", "max_drawdown_pct", "cvar95")}
    )


def cooldown_minutes(df: DataFrame, base: float = 15.0, moonshot_r: float = 5.0, cont_r: float = 2.0, relax: float = 0.25,
                     extend: float = 0.60, max_daily: int = 5) -> DataFrame:
    """Cooldown after each trade from its R, hazard, the loss streak, regime and the day's trade count.

    Streak and count restart every day: the series here are the trades of one asset on one day.
    """
    lane = Lane(keys=("asset", "trade_day"))
    rows = index_rows(df.withColumn("trade_day", F.to_date("exit_ts")), lane.keys, ("exit_ts", "trade_id"))
    d = carry_last(rows, {"_win_at": F.when(F.col("r") >= 0, F.col(IDX))}, lane)
    streak = F.col(IDX) - F.coalesce(F.col("_win_at"), F.lit(-1))
    nth = F.col(IDX) + 1
    h = F.col("hazard_entry")
    minutes = (
        F.lit(base) * F.when(h < relax, 0.6).when(h > extend, 1.5).otherwise(1.0)
        * F.when(streak >= 2, 1.3 + 0.2 * (streak - 1)).otherwise(1.0)
        * F.when(F.col("regime") == "trend", 0.8).when(F.col("regime").isin("chop", "range"), 1.25).otherwise(1.0)
        * F.when(nth > max_daily, 1.0 + (nth - max_daily) * 0.20).otherwise(1.0)
    )
    waived = (F.col("r") >= moonshot_r) | ((F.col("r") >= cont_r) & (h < relax))
    return d.withColumns(
        {"loss_streak": streak, "cooldown_min": F.when(waived, 0.0).otherwise(clip(minutes, F.lit(5.0), F.lit(240.0)))}
    ).drop("_win_at")
