"""File sources: bars, trades, exchange rows, ledgers, event logs, metric records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalar import flag
from tickloom.operators.series import framed, index_rows
from tickloom.sources.store import keep_first

PRICES = ("open", "high", "low", "close", "volume")
# Names a time column may have, in order of preference.
TIME_NAMES = ("dt", "timestamp", "ts", "time")


def read_bars_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Bars as text with a header; bad numbers become NULL and incomplete rows are dropped."""
    schema = ", ".join(f"{c} string" for c in ("timestamp", *PRICES))
    raw = spark.read.option("header", "true").option("enforceSchema", "false").schema(schema).csv(path)
    return parse_bars(raw)


def parse_bars(raw: DataFrame) -> DataFrame:
    missing = [c for c in ("timestamp", *PRICES) if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rest = [c for c in raw.columns if c not in ("timestamp", *PRICES)]
    out = raw.select(*rest, F.expr("try_cast(timestamp AS bigint)").alias("timestamp"),
                     *[F.col(c).try_cast("double").alias(c) for c in PRICES])
    return out.dropna(subset=["timestamp", *PRICES])


def normalise_time(df: DataFrame, hint: str | None = None, name: str = "dt") -> DataFrame:
    """Add ``name`` from the first known time column.

    A column that is at least 95 % numeric is an epoch; its unit follows from the size of
    its median (seconds, milliseconds, microseconds or nanoseconds).  Anything else is parsed as text.
    """
    lower = {c.lower(): c for c in df.columns}
    source = lower.get((hint or "").lower()) or next((lower[n] for n in TIME_NAMES if n in lower), None)
    if source is None:
        raise ValueError("no time column")
    kind = dict(df.dtypes)[source]
    if kind.startswith("timestamp") or kind == "date":
        return df.withColumn(name, F.col(source).cast("timestamp"))
    number = F.col(source).try_cast("double")
    # the unit shows in the size of the median, which need not be exact
    share = df.agg(F.count(number).alias("n"), F.count(source).alias("all"), F.percentile_approx(number, 0.5).alias("median")).first()
    if share["all"] and share["n"] >= 0.95 * share["all"]:
        size = abs(share["median"])
        scale = 1e-6 if size < 1e11 else 1e-3 if size < 1e14 else 1.0 if size < 1e17 else 1e3
        return df.withColumn(name, F.timestamp_micros(F.round(number / scale).cast("long")))
    return df.withColumn(name, F.expr(f"try_cast(`{source}` AS timestamp)"))


def read_trades_csv(spark: SparkSession, path: str | Sequence[str], end: str | None = None) -> DataFrame:
    raw = spark.read.option("header", "true").schema(
        "dt string, timestamp double, price double, volume double, side string").csv(path)
    out = raw.withColumn("ts", F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("long"))).drop("dt", "timestamp")
    return distinct_trades(out, end)


def distinct_trades(trades: DataFrame, end: str | None = None) -> DataFrame:
    """Exact duplicates on time, price, volume and side collapse (so do two genuine identical trades)."""
    keys = [c for c in ("asset", "ts", "price", "volume", "side") if c in trades.columns]
    kept = trades.filter(F.col("ts") <= F.lit(end).cast("timestamp")) if end else trades
    return kept.select(*keys).distinct()


def exchange_rows(raw: DataFrame, payload: str = "row", by: str = "asset", order: str = "seq") -> DataFrame:
    """OHLC rows sent as JSON arrays (time, o, h, l, c, vwap, volume, count); the first row of a time stands."""
    parts = F.from_json(payload, "array<string>")

    def at(i: int) -> Column:
        return F.get(parts, i).try_cast("double")

    out = raw.select(by, order, at(0).cast("long").alias("t"), *[at(i).alias(n) for i, n in
                                                               ((1, "open"), (2, "high"), (3, "low"), (4, "close"), (6, "volume"))])
    return keep_first(out.dropna(), (by, "t"), (order,)).drop(order)


def integrity_report(bars: DataFrame, start: str | None = None, end: str | None = None, keys=("asset", "tf"),
                     stamp: str = "bar_close", arrival: str | None = None) -> DataFrame:
    """Per series: rows, distinct stamps, out-of-order steps in arrival order, invalid bars, window covered."""
    valid = valid_bar()
    stats = bars.groupBy(*keys, stamp).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~valid).alias("_bad"))
    # distinct stamps are counted on the pre-aggregated (key, stamp) rows
    lo, hi = F.min(stamp), F.max(stamp)
    covered = F.lit(True)
    if start:
        covered = covered & (lo <= F.lit(start).cast("timestamp"))
    if end:
        covered = covered & (hi >= F.lit(end).cast("timestamp"))
    report = stats.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("stamps"), F.sum("_bad").alias("invalid"),
        lo.alias("first_stamp"), hi.alias("last_stamp"), flag(covered).alias("window_covered"))
    if arrival is None:
        return report.withColumn("is_unique", flag(F.col("rows") == F.col("stamps")))
    placed = index_rows(bars.select(*keys, stamp, arrival), keys, (arrival,))
    from tickloom.operators.series import Lane

    steps = framed(placed, lambda d, w: d.withColumn("_back", F.lag(stamp).over(w) > F.col(stamp)), back=1, lane=Lane(keys=tuple(keys)))
    backwards = steps.groupBy(*keys).agg(F.count_if("_back").alias("backward_steps"))
    return report.join(backwards, list(keys)).withColumns(
        {"is_unique": flag(F.col("rows") == F.col("stamps")), "is_monotonic": flag(F.col("backward_steps") == 0)})


def valid_bar() -> Column:
    """Positive prices, high not below open/close, low not above them."""
    o, h, lo, c, v = (F.col(x) for x in PRICES)
    return F.coalesce((o > 0) & (h > 0) & (lo > 0) & (c > 0) & (v >= 0) & (h >= F.greatest(o, c)) & (lo <= F.least(o, c)), F.lit(False))


def trim(bars: DataFrame, start: str, end: str, stamp: str = "bar_close") -> DataFrame:
    return bars.filter(F.col(stamp).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


# How an event's fields are found in its payload, first hit wins.
EVENT_PATHS = {
    "asset": ("$.asset", "$.symbol"), "side": ("$.side",), "leg": ("$.leg", "$.reasoning.final_decision.leg", "$.meta_leg"),
    "tier": ("$.tier", "$.reasoning.final_decision.tier"), "reason": ("$.reason", "$.reasoning.final_decision.reason"),
    "source": ("$.source",), "regime_state": ("$.regime_state", "$.reasoning.regime.regime_state"),
    "session": ("$.session", "$.reasoning.session"),
}
EVENT_NUMBERS = {
    "confluence": ("$.confluence", "$.reasoning.final_decision.confluence", "$.reasoning.confluence_breakdown.final_confluence"),
    "evr": ("$.evr.evr", "$.evr.EVR", "$.evr", "$.reasoning.evr.evr", "$.reasoning.evr", "$.reasoning.final_decision.evr"),
    "median_r": ("$.evr.median_r", "$.evr.median_R", "$.reasoning.final_decision.median_r", "$.median_r"),
    "hazard": ("$.hazard", "$.hazard_score", "$.reasoning.hazard.hazard_score", "$.hazard_entry"),
    "pnl": ("$.pnl", "$.realized_pnl"), "r": ("$.r", "$.r_mult", "$.realized_r"),
    "p_flow_1h": ("$.reasoning.confluence_breakdown.p_flow_1h", "$.reasoning.flow.p_flow_1h", "$.p_flow_1h"),
    "p_bos_cont": ("$.reasoning.confluence_breakdown.p_bos_cont", "$.p_bos_cont", "$.prob_bos_cont"),
    "prob_meta": ("$.reasoning.confluence_breakdown.prob_meta", "$.prob_meta"),
    "p_regime_trend": ("$.reasoning.regime.p_regime_trend",), "p_regime_expansion": ("$.reasoning.regime.p_regime_expansion",),
    "p_regime_collapse": ("$.reasoning.regime.p_regime_collapse",),
}


def read_events(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Newline-delimited JSON events with a nested payload kept as text."""
    raw = spark.read.text(path)
    get = lambda p: F.get_json_object("value", p)
    return flatten_events(raw.select(
        F.expr("try_cast(get_json_object(value, '$.timestamp') AS timestamp)").alias("ts"), get("$.event_type").alias("event_type"),
        get("$.trade_id").alias("trade_id"), get("$.payload").alias("payload")))


def flatten_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Event fields from a nested payload; a missing type is ``unknown`` and the label joins the main fields.

    The payload is parsed once per row, into a variant the fields are read from.
    """
    def pick(paths: Sequence[str], kind: str) -> Column:
        return F.coalesce(*[F.try_variant_get("_doc", p, kind) for p in paths])

    cols = {n: pick(p, "string") for n, p in EVENT_PATHS.items()} | {n: pick(p, "double") for n, p in EVENT_NUMBERS.items()}
    d = df.withColumn("_doc", F.try_parse_json(payload)).withColumns({"event_type": F.coalesce("event_type", F.lit("unknown")), **cols})
    d = d.withColumns({"trade_id": F.coalesce("trade_id", F.try_variant_get("_doc", "$.trade_id", "string"), F.lit("")),
                       "reason": F.coalesce("reason", "event_type")})
    stamp = F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("na"))
    return d.withColumn("event_label", F.concat_ws(" | ", stamp, "event_type", F.coalesce("asset", F.lit("na")),
                                                    F.coalesce(F.nullif("trade_id", F.lit("")), F.lit("-")))).drop(payload, "_doc")


def select_events(df: DataFrame, types: Sequence[str] = (), assets: Sequence[str] = (), text: str = "",
                  floors: dict[str, float] | None = None, entry_exit_only: bool = False) -> DataFrame:
    """Event predicates; ``text`` is a literal, case-insensitive part of the trade id."""
    keep = F.lit(True)
    if types:
        keep = keep & F.col("event_type").isin(*types)
    if assets:
        keep = keep & F.coalesce("asset", F.lit("")).isin(*assets)
    for c, low in (floors or {}).items():
        keep = keep & (F.coalesce(F.col(c), F.lit(float("-inf"))) >= low)
    if text:
        keep = keep & F.lower(F.coalesce("trade_id", F.lit(""))).contains(text.lower())
    if entry_exit_only:
        keep = keep & F.col("event_type").isin("entry", "exit", "exit_trade", "closed_trade")
    return df.filter(keep)


def candidate_signals(df: DataFrame, n: int = 5) -> DataFrame:
    """The latest ``n`` candidate events with their executable/rejected status."""
    kinds = ("entry", "scanner", "signal", "reasoning", "alert")
    rejected = (F.col("event_type") == "scanner") | F.coalesce(F.col("rejected"), F.lit(False))
    return df.filter(F.lower("event_type").isin(*kinds)).withColumn(
        "status", F.when(rejected, "rejected").otherwise("executable")).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def read_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """Metric records of every model version (one JSON file each), with model and version from the path."""
    where = F.col("_path")
    return spark.read.option("multiLine", "true").json(pattern).withColumn("_path", F.input_file_name()).withColumns(
        {"model": F.regexp_extract(where, r"([^/]+)/[^/]+/[^/]+$", 1), "version": F.regexp_extract(where, r"([^/]+)/[^/]+$", 1)}
    ).drop("_path")


def class_share(df: DataFrame, counts: str = "class_counts") -> DataFrame:
    """Share of positive labels from stored class counts (map of label to count)."""
    pos = F.coalesce(F.try_element_at(counts, F.lit("1")), F.lit(0)).cast("double")
    total = F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, v: a + v)
    return df.withColumn("positive_share", F.try_divide(pos, total))
