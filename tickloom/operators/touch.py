"""First later row that meets a condition, for sparse events on long series.

With a reach limit (``first_hit_within``) an event visits the block(s) in its reach, each held once as an array.
Without one (``first_cross``) it searches its own block, climbs a tree of block extremes until a later block shows a
hit, and reads that block's record rows: no horizon cut-off, no event paired with every later row, and no list that
grows with the series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.series import BARS, IDX, Lane, pin

#: Children of one node of the tree of block extremes: with 4096 rows a block, three levels span a thousand million rows.
FAN = 64


def _block_arrays(rows: DataFrame, cols: Sequence[str], lane: Lane) -> DataFrame:
    return (
        rows.withColumn("_block", lane.number())
        .groupBy(*lane.keys, "_block")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(IDX).alias("i"), *cols))).alias("_rows"))
    )


def _first(rows: Column, start: Column, stop: Column, test: Callable[[Column], Column]) -> Column:
    hits = F.filter(rows, lambda x: (x["i"] >= start) & (x["i"] <= stop) & test(x))
    return F.try_element_at(hits, F.lit(1))


def first_hit_within(
    rows: DataFrame, events: DataFrame, cols: Sequence[str], test: Callable[[Column], Column],
    start: int, reach: int, event_keys: Sequence[str] = (), lane: Lane = BARS,
) -> DataFrame:
    """Add ``hit_idx``: first row in ``[row_idx + start, row_idx + reach]`` meeting ``test``."""
    begin, end = F.col(IDX) + start, F.col(IDX) + reach
    probes = events.withColumn(
        "_block", F.explode(F.sequence(F.floor(begin / lane.block).cast("long"), F.floor(end / lane.block).cast("long")))
    )
    found = probes.join(_block_arrays(rows, cols, lane), [*lane.keys, "_block"], "left").withColumn(
        "_hit", _first(F.col("_rows"), begin, end, test)["i"]
    )
    rest = [c for c in events.columns if c not in (*lane.keys, IDX, *event_keys)]
    return found.groupBy(*lane.keys, IDX, *event_keys).agg(
        *[F.first(c).alias(c) for c in rest], F.min("_hit").alias("hit_idx")
    )


def _first_at_most(values: np.ndarray, at: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Place of the first value from ``at`` on that is at most ``level``; the number of values where there is none."""
    n = len(values)
    least = [np.append(values, np.inf)]  # least[k][p]: smallest of the 2**k values from p on
    while 1 << len(least) <= n:
        step, last = 1 << (len(least) - 1), least[-1]
        least.append(np.minimum(last, last[np.minimum(np.arange(n + 1) + step, n)]))
    for k in range(len(least) - 1, -1, -1):
        at = np.where(least[k][at] > level, np.minimum(at + (1 << k), n), at)
    return at


def _in_own_block(rows: DataFrame, events: DataFrame, start: int, cols: Sequence[str], lane: Lane) -> DataFrame:
    """Add ``_hit``, the first hit inside the block in which the search begins, and ``_own``, the number of that block."""
    kept = T.StructType([T.StructField("i", T.LongType()), *[rows.schema[c] for c in cols]])
    own = F.floor((F.col(IDX) + start) / lane.block).cast("long")
    schema = T.StructType([*events.schema.fields, T.StructField("_own", T.LongType()), T.StructField("_hit", kept)])

    def numbers(column: pa.ChunkedArray, missing: float) -> np.ndarray:
        return np.nan_to_num(column.cast(pa.float64()).to_numpy(), nan=missing, posinf=np.inf, neginf=-np.inf)

    def search(sought: pa.Table, block: pa.Table) -> pa.Table:
        block = block.sort_by("i")
        place = block["i"].to_numpy()
        at = np.searchsorted(place, sought[IDX].to_numpy() + start)
        level, falls = numbers(sought["level"], np.nan), sought["falls"].to_numpy(zero_copy_only=False).astype(bool)
        down = _first_at_most(numbers(block["low"], np.inf), at, np.where(np.isnan(level), -np.inf, level))
        up = _first_at_most(-numbers(block["high"], -np.inf), at, np.where(np.isnan(level), -np.inf, -level))
        found = np.where(falls, down, up)
        none = pa.array(found >= len(place))
        hit = block.select(["i", *cols]).take(pa.array(found, pa.int64(), mask=found >= len(place)))
        fields = [pa.field(f.name, f.type) for f in hit.schema]
        hit = pa.StructArray.from_arrays([c.combine_chunks() for c in hit.columns], fields=fields, mask=none)
        return sought.append_column("_hit", hit)

    left = events.withColumn("_own", own).groupBy(*lane.keys, "_own")
    right = rows.select(*lane.keys, F.col(IDX).alias("i"), *cols, lane.number().alias("_own")).groupBy(*lane.keys, "_own")
    return left.cogroup(right).applyInArrow(search, schema)


def first_cross(
    rows: DataFrame, events: DataFrame, start: int = 1, extra: Sequence[str] = (), lane: Lane = BARS, fan: int = FAN
) -> DataFrame:
    """First row from ``row_idx + start`` on whose low reaches down to ``level`` (``falls``) or high up to it.

    Adds ``hit`` (the row as a struct: ``i``, ``low``, ``high`` and ``extra``), NULL where no row does or the level is
    missing.  An event reads its own block, at most two nodes of ``fan`` entries per level of the tree, and the record
    rows of one block.  ``events`` may hold any number of rows per block of the series and is written once.
    """
    cols = ["low", "high", *extra]

    def test(x: Column) -> Column:
        return F.when(F.col("falls"), x["low"] <= F.col("level")).otherwise(x["high"] >= F.col("level"))

    def first(entries: str, *also: Callable[[Column], Column]) -> Column:
        return F.try_element_at(F.filter(entries, lambda x: test(x) & (also[0](x) if also else F.lit(True))), F.lit(1))

    own = pin(_in_own_block(rows, events, start, cols, lane))
    blocked = rows.withColumn("_block", lane.number())
    extremes = pin(blocked.groupBy(*lane.keys, "_block").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    top = extremes.agg(F.max("_block")).first()[0] or 0
    if top == 0:  # every series is one block
        return own.withColumnRenamed("_hit", "hit").drop("_own")

    levels, size, below = [], 1, extremes.withColumnRenamed("_block", "n")
    while size <= top:
        up = F.floor(F.col("n") / fan).cast("long").alias("_node")
        levels.append(below.groupBy(*lane.keys, up).agg(F.array_sort(F.collect_list(F.struct("n", "low", "high"))).alias("_kids")))
        below = below.groupBy(*lane.keys, up).agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumnRenamed("_node", "n")
        size *= fan

    def visit(d: DataFrame, node: Column, level: DataFrame) -> DataFrame:
        # who needs no visit gets a number of its own that no node has, so that these rows share no join key
        return d.withColumn("_node", F.coalesce(node, -1 - F.col(IDX))).join(level, [*lane.keys, "_node"], "left")

    d = own.filter("_hit IS NULL").drop("_hit").withColumns({"_at": F.lit(None).cast("long"), "_height": F.lit(None).cast("int")})
    for k, level in enumerate(levels):  # up: the first later sibling that shows a hit
        path = F.floor(F.col("_own") / fan**k).cast("long")
        d = visit(d, F.when(F.col("_at").isNull(), F.floor(path / fan).cast("long")), level).withColumn("_kid", first("_kids", lambda x: x["n"] > path)["n"])
        d = d.withColumns({"_height": F.when(F.col("_at").isNull() & F.col("_kid").isNotNull(), k).otherwise(F.col("_height")), "_at": F.coalesce("_at", "_kid")})
        d = d.drop("_kids", "_kid", "_node")
    for k in range(len(levels) - 2, -1, -1):  # down: its first child that does
        above = F.col("_height") > k
        d = visit(d, F.when(above, F.col("_at")), levels[k]).withColumn("_at", F.when(above, first("_kids")["n"]).otherwise(F.col("_at"))).drop("_kids", "_node")
    # the first row of a block to reach a level is lower or higher than all rows before it
    before = lane.window().rowsBetween(Window.unboundedPreceding, -1)
    lowest, highest = F.min("low").over(before), F.max("high").over(before)
    records = (
        blocked.withColumns({"_lowest": lowest, "_highest": highest})
        .filter(F.col("_lowest").isNull() | F.col("_highest").isNull() | (F.col("low") < F.col("_lowest")) | (F.col("high") > F.col("_highest")))
        .groupBy(*lane.keys, F.col("_block").alias("_node")).agg(F.array_sort(F.collect_list(F.struct(F.col(IDX).alias("i"), *cols))).alias("_kids"))
    )
    late = visit(d, F.col("_at"), records).withColumn("hit", first("_kids")).select(*events.columns, "hit")
    return own.filter("_hit IS NOT NULL").select(*events.columns, F.col("_hit").alias("hit")).unionByName(late)
