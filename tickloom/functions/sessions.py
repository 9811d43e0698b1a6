"""Trading-session expressions in local wall-clock time (daylight saving included)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalar import as_col, flag

# Session hours (minutes after local midnight), weights and quality per bucket.
ZONE = "Europe/Berlin"
ASIA = (0, 480)
LONDON = (480, 1020)
NEW_YORK = (870, 1260)
PRE_MINUTES = 60
LONDON_EXPANSION = 120
NEW_YORK_EXPANSION = 90
WEIGHTS = {"overlap": 1.10, "london": 1.00, "ny": 1.00, "off_hours": 0.20}
QUALITY = {"dead_zone": 0.75, "pre_expansion": 0.95, "expansion": 1.05, "overlap": 1.15}
BUCKET_IDS = {"dead_zone": 0, "pre_expansion": 1, "expansion": 2, "overlap": 3}


def local_time(ts, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(as_col(ts), zone)


def minute_of_day(ts, zone: str = ZONE) -> Column:
    at = local_time(ts, zone)
    return F.hour(at) * 60 + F.minute(at)


def inside(minute: Column, span: tuple[int, int]) -> Column:
    return (minute >= span[0]) & (minute < span[1])


def session_columns(df: DataFrame, ts: str = "bar_close", zone: str = ZONE) -> DataFrame:
    """Session flags, name, weight, bucket, quality and the five minute counters."""
    m = F.col("_minute")
    second = F.second(local_time(ts, zone))
    lon, ny = inside(m, LONDON), inside(m, NEW_YORK)
    both = lon & ny
    # minutes until a target round down, so a started minute counts as gone
    part = F.when(second > 0, 1).otherwise(0)
    to_lon, to_ny = F.lit(LONDON[0]) - m - part, F.lit(NEW_YORK[0]) - m - part
    since_lon = F.when(lon, m - LONDON[0]).otherwise(-1)
    since_ny = F.when(ny, m - NEW_YORK[0]).otherwise(-1)
    pre = (~lon & to_lon.between(0, PRE_MINUTES)) | (~ny & to_ny.between(0, PRE_MINUTES))
    grow = (lon & since_lon.between(0, LONDON_EXPANSION)) | (ny & since_ny.between(0, NEW_YORK_EXPANSION))
    name = F.when(both, "overlap").when(lon, "london").when(ny, "ny").otherwise("off_hours")
    bucket = F.when(both, "overlap").when(grow, "expansion").when(pre, "pre_expansion").otherwise("dead_zone")

    def lookup(key: str, values: dict) -> Column:
        out = None
        for k, v in values.items():
            out = F.when(F.col(key) == k, F.lit(v)) if out is None else out.when(F.col(key) == k, F.lit(v))
        return out

    return (
        df.withColumn("_minute", minute_of_day(ts, zone))
        .withColumns(
            {
                "session_london": flag(lon), "session_ny": flag(ny), "session_overlap": flag(both),
                "session_offhours": flag(~(lon | ny)), "session_name": name, "session_bucket": bucket,
                "session_pre_expansion": flag(pre), "session_expansion": flag(grow),
                "minutes_since_london_open": since_lon, "minutes_since_ny_open": since_ny,
                "minutes_to_london_open": to_lon, "minutes_to_ny_open": to_ny,
                "minutes_to_overlap_close": F.when(both, F.lit(LONDON[1]) - m - part).otherwise(-1),
            }
        )
        .withColumns(
            {
                "session_weight": lookup("session_name", WEIGHTS),
                "session_bucket_id": lookup("session_bucket", BUCKET_IDS),
                "session_quality_multiplier": lookup("session_bucket", QUALITY),
            }
        )
        .drop("_minute")
    )


def day_masks(ts: str = "bar_close", zone: str = ZONE) -> dict[str, Column]:
    m = minute_of_day(ts, zone)
    return {
        "in_asia": flag(inside(m, ASIA)), "in_london": flag(inside(m, LONDON)),
        "in_ny": flag(inside(m, NEW_YORK)), "session_date": F.to_date(local_time(ts, zone)),
    }
