"""Report and replay outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import ledger as L
from tickloom.operators.asof import asof


def report_tables(trades: DataFrame, start_equity: float = L.START_EQUITY) -> dict[str, DataFrame]:
    """Ledger, daily, monthly, equity, execution log and a one-row summary."""
    labelled = L.with_period_labels(trades)
    curve = L.equity_curve(L.ordered(trades), start_equity)
    summary = L.kpis(trades).withColumns({"starting_equity": F.lit(start_equity),
                                          "ending_equity": F.col("total_pnl") + start_equity})
    return {
        "ledger": L.texts(labelled), "daily": L.by_period(labelled, "day"), "monthly": L.by_period(labelled, "month"),
        "equity": curve.select("entry_ts", "trade_id", "equity", "drawdown"), "execution_log": L.trade_events(trades),
        "summary": summary,
    }


def write_report(trades: DataFrame, path: str, start_equity: float = L.START_EQUITY) -> None:
    """One dataset per table under ``path``; the summary is a single JSON row."""
    for name, df in report_tables(trades, start_equity).items():
        writer = df.write.mode("overwrite")
        writer.json(f"{path}/{name}") if name == "summary" else writer.parquet(f"{path}/{name}")


def replay_bars(bars: DataFrame) -> DataFrame:
    """Canonical replay bars: position, time and short price names (needs ``row_idx``)."""
    return bars.select(
        "asset", F.col("row_idx").alias("idx"), F.date_format("bar_close", "yyyy-MM-dd'T'HH:mm:ss").alias("dt"),
        F.unix_seconds("bar_close").alias("timestamp"), *[F.col(c).alias(c[0]) for c in ("open", "high", "low", "close", "volume")])


def replay_equity(trades: DataFrame, start_equity: float = L.START_EQUITY) -> DataFrame:
    """Equity after every trade in entry order, with its distance from the highest equity so far."""
    curve = L.equity_curve(L.ordered(trades.select("entry_ts", "trade_id", "pnl")), start_equity)
    stamp = F.coalesce(F.date_format("entry_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return curve.select(F.col("row_idx").alias("idx"), stamp.alias("timestamp"), "equity", "drawdown")


def replay_trades(trades: DataFrame, bars: DataFrame, span_seconds: int = 3600) -> DataFrame:
    """Trades with the position of the last bar closed at or before entry and exit (needs ``row_idx`` on bars)."""
    marks = bars.select("asset", F.col("bar_close").alias("at"), F.col("row_idx").alias("idx"))

    def locate(df: DataFrame, ts: str, name: str) -> DataFrame:
        found = asof(df.withColumn("at", F.col(ts)), marks, on="at", span_seconds=span_seconds)
        return found.withColumnRenamed("idx", name).drop("at", "at_ctx")

    out = locate(locate(trades, "entry_ts", "entry_idx"), "exit_ts", "exit_idx")

    def iso(c: str) -> Column:
        return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias(c.replace("_ts", "_dt"))

    return out.select("trade_id", "asset", "side", "leg", "tier", iso("entry_ts"), iso("exit_ts"), "entry_idx", "exit_idx",
                      "entry_price", "exit_price", "stop_price", "pnl", "r", "conf", "evr", "reason", "session", "regime")
