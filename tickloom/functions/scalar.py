"""Null-safe scalar expressions shared by every family of operators.

A missing number is always SQL NULL: divisions by zero yield NULL and no
expression lets NaN or infinity into a column, because Spark sorts NaN as the
largest value and averages propagate it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that count as true in a text flag, and text that means "missing".
TRUE_WORDS = ("1", "true", "yes", "up", "down", "long", "short")
MISSING_WORDS = ("", "NAN", "NONE", "NULL")


def as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def safe_div(a, b) -> Column:
    """``a / b``, NULL when ``b`` is zero or either side is missing."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def finite(x) -> Column:
    """NULL for NaN and infinities."""
    x = as_col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(x, lo=None, hi=None) -> Column:
    """Clamp, keeping NULL (``greatest``/``least`` skip NULL, so guard it)."""
    x = as_col(x)
    y = x
    if lo is not None:
        y = F.greatest(y, as_col(lo))
    if hi is not None:
        y = F.least(y, as_col(hi))
    return F.when(x.isNotNull(), y)


def flag(cond: Column) -> Column:
    """Boolean to 0/1, missing counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def sigmoid(x, limit: float = 20.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, F.lit(-limit), F.lit(limit))))


def decay(age, tau: float) -> Column:
    return F.exp(-as_col(age) / F.lit(float(tau)))


def truthy(x, dtype: str = "string") -> Column:
    """Flag normaliser: non-zero numbers, booleans, or one of ``TRUE_WORDS``."""
    x = as_col(x)
    if dtype == "boolean":
        return F.coalesce(x, F.lit(False))
    if dtype != "string":
        return F.coalesce(x.cast("double") != 0.0, F.lit(False))
    text = F.lower(F.trim(x))
    number = F.coalesce(F.expr("1").cast("double") * text.try_cast("double"), F.lit(0.0))
    return F.coalesce(text.isin(*TRUE_WORDS), F.lit(False)) | ((number != 0.0) & ~F.isnan(number))


def tidy_text(x) -> Column:
    """Upper-cased, trimmed text; the words that mean "missing" become NULL."""
    text = F.upper(F.trim(as_col(x)))
    return F.when(~text.isin(*MISSING_WORDS), text)


def first_text(*cols) -> Column:
    """First usable text per row, empty string when there is none."""
    return F.coalesce(*[tidy_text(c) for c in cols], F.lit(""))


def first_number(cols: Iterable, default: float | None = None) -> Column:
    """First non-missing number per row."""
    parts = [finite(as_col(c).cast("double")) for c in cols]
    if default is not None:
        parts.append(F.lit(float(default)))
    return F.coalesce(*parts)


def pct_change(x, w) -> Column:
    prev = F.lag(as_col(x)).over(w)
    return safe_div(as_col(x) - prev, prev)


def log_return(x, w, step: int = 1) -> Column:
    return F.ln(safe_div(as_col(x), F.lag(as_col(x), step).over(w)))
