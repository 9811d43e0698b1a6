"""Row-frame window expressions with a minimum number of observations.

Every function takes an ordered window ``w`` and returns a column.  Spark hands
back partial aggregates at the start of a series; here a value appears only
once ``minp`` non-missing observations are inside the frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalar import as_col, safe_div


def trailing(w: WindowSpec, n: int, shift: int = 0) -> WindowSpec:
    """The last ``n`` rows, ending ``shift`` rows before the current one."""
    return w.rowsBetween(-(n - 1) - shift, -shift)


def roll(fn: Callable[[Column], Column], x, w: WindowSpec, n: int, minp: int | None = None, shift: int = 0) -> Column:
    x, frame = as_col(x), trailing(w, n, shift)
    need = n if minp is None else minp
    return F.when(F.count(x).over(frame) >= need, fn(x).over(frame))


def roll_mean(x, w, n, minp=None, shift=0) -> Column:
    return roll(F.avg, x, w, n, minp, shift)


def roll_sum(x, w, n, minp=None, shift=0) -> Column:
    return roll(F.sum, x, w, n, minp, shift)


def roll_std(x, w, n, minp=None, shift=0) -> Column:
    return roll(F.stddev_samp, x, w, n, minp, shift)


def roll_std_pop(x, w, n, minp=None, shift=0) -> Column:
    return roll(F.stddev_pop, x, w, n, minp, shift)


def roll_min(x, w, n, minp=None, shift=0) -> Column:
    return roll(F.min, x, w, n, minp, shift)


def roll_max(x, w, n, minp=None, shift=0) -> Column:
    return roll(F.max, x, w, n, minp, shift)


def roll_quantile(x, q: float, w, n, minp=None) -> Column:
    return roll(lambda c: F.percentile(c, F.lit(q)), x, w, n, minp)


def roll_zscore(x, w, n, minp=None) -> Column:
    """Sample-deviation score, NULL where the deviation is zero."""
    return safe_div(as_col(x) - roll_mean(x, w, n, minp), roll_std(x, w, n, minp))


def roll_zscore_pop(x, w, n, minp=None, fill: float | None = 0.0) -> Column:
    """Population-deviation score; zero deviation and warm-up become ``fill``."""
    z = safe_div(as_col(x) - roll_mean(x, w, n, minp), roll_std_pop(x, w, n, minp))
    return z if fill is None else F.coalesce(z, F.lit(fill))


def roll_rank_pct(x, w, n, minp=None) -> Column:
    """Average-rank percentile of the current value inside its own frame."""
    x, frame = as_col(x), trailing(w, n)
    need = n if minp is None else minp
    values = F.collect_list(x).over(frame)
    below = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    rank = below + (equal + 1) / F.lit(2.0)
    return F.when((F.count(x).over(frame) >= need) & x.isNotNull(), rank / F.size(values))


def roll_mode_count(x, w, n, minp=None) -> Column:
    """How often the most frequent value occurs inside the frame."""
    x, frame = as_col(x), trailing(w, n)
    need = n if minp is None else minp
    values = F.array_sort(F.collect_list(x).over(frame))
    # run lengths over the sorted frame: (previous value, run length, best run length)
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, v):
        run = F.when(acc["v"] == v, acc["run"] + 1).otherwise(1)
        return F.struct(v.cast("double").alias("v"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    best = F.aggregate(values, start, step, lambda acc: acc["best"])
    return F.when(F.count(x).over(frame) >= need, best)


def true_range(w: WindowSpec) -> Column:
    prev = F.lag("close").over(w)
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )


def crossed_above(left, right, w) -> Column:
    left, right = as_col(left), as_col(right)
    return F.coalesce((left > right) & (F.lag(left).over(w) <= F.lag(right).over(w)), F.lit(False))


def crossed_below(left, right, w) -> Column:
    left, right = as_col(left), as_col(right)
    return F.coalesce((left < right) & (F.lag(left).over(w) >= F.lag(right).over(w)), F.lit(False))


def lead_frame(w: WindowSpec, first: int, last: int) -> WindowSpec:
    return w.rowsBetween(first, last)


def no_frame(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)
