"""Exact quantiles of a whole column, without one task ever holding the column."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import IDX, LEDGER, Lane, carry_total, index_rows, pin

#: Least number of observations in a run of times and in a range of values.
RUN = 4096


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles, one row per (keys, q).

    Equal values are counted first, so a value that fills a third of the column is one row
    from then on; a range-partitioned sort and running counts then say which ranks each
    distinct value covers.  NULL values and NULL keys do not take part.
    """
    named = list(keys) or ["_all"]
    data = df.select(*keys, F.col(value).cast("double").alias("_x")).dropna()
    if not keys:
        data = data.withColumn("_all", F.lit(0))
    distinct = data.groupBy(*named, "_x").agg(F.count(F.lit(1)).alias("_n"))
    placed = index_rows(distinct, named, ("_x",))
    upto = carry_total(placed, sums={"_upto": F.col("_n")}, lane=Lane(keys=tuple(named), block=LEDGER.block))
    # per key: the two neighbouring ranks of every requested quantile (a few entries, one row per key)
    last = F.col("_total") - 1
    ends = [
        F.struct(F.lit(float(q)).alias("q"), F.lit(e).alias("end"), (q * last - F.floor(q * last)).alias("frac"),
                 (F.floor(q * last) if e == 0 else F.ceil(q * last)).cast("long").alias("rank"))
        for q in qs for e in (0, 1)
    ]
    # pinned, so Spark sees its true size and does not gather the values of a key beside its one row
    wanted = pin(placed.groupBy(*named).agg(F.sum("_n").alias("_total"))).select(*named, F.array(*ends).alias("_want"))
    covers = F.filter("_want", lambda t: (t["rank"] >= F.col("_upto") - F.col("_n")) & (t["rank"] < F.col("_upto")))
    hits = upto.join(wanted, named).select(*named, "_x", F.inline(covers))
    lo, hi = (F.max(F.when(F.col("end") == e, F.col("_x"))) for e in (0, 1))
    return hits.groupBy(*named, "q").agg((lo + (hi - lo) * F.first("frac")).alias("value")).drop("_all")


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """The same for several columns at once: one sort over (column, value) pairs."""
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols]))
        .alias("p")
    ).select("p.column", "p.x")
    return exact_quantiles(pairs, "x", qs, ("column",))


def bucket_of(x: Column, edges: Sequence[float]) -> Column:
    """0-based bin of ``x`` between the edges; bins are open below and closed above, ties share a bin."""
    inner = sorted(set(edges))[1:-1]
    above = F.lit(0)
    for e in inner:
        above = above + (x > F.lit(e)).cast("int")
    return F.when(x.isNotNull(), above)


def quantile_buckets(df: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """Add the 1-based quantile bin of ``value``; equal edges are merged, NULL stays NULL."""
    # n + 1 numbers come to the driver and become literals
    edges = [r["value"] for r in exact_quantiles(df, value, [i / n for i in range(n + 1)]).collect()]
    return df.withColumn(name, bucket_of(F.col(value).cast("double"), edges) + 1)


def _located(pdf: pd.DataFrame) -> pd.DataFrame:
    """Value range and rank inside it of the k-th smallest observation so far, for the questions of one run of times."""
    grid, own = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1].sort_values("m")
    asked = pdf[pdf["kind"] == 2].sort_values("m")
    counts = np.zeros(int(max(grid["b"].max(), own["b"].max())) + 1, np.int64)
    counts[grid["b"].to_numpy(np.int64)] = grid["before"].to_numpy(np.int64)
    b, m = own["b"].to_numpy(np.int64), own["m"].to_numpy(np.int64)
    done, places, ranks, last, ends = 0, [], [], None, None
    for at, k in zip(asked["m"].to_numpy(np.int64), asked["k"].to_numpy(np.int64), strict=True):
        if at != last:
            upto = int(np.searchsorted(m, at, "right"))
            np.add.at(counts, b[done:upto], 1)
            done, last, ends = upto, at, np.cumsum(counts)
        place = int(np.searchsorted(ends, k, "right"))
        places.append(place)
        ranks.append(int(k - (ends[place - 1] if place else 0)))
    return asked.assign(b=np.array(places, np.int64), r=np.array(ranks, np.int64))


def _selected(pdf: pd.DataFrame) -> pd.DataFrame:
    """The value of every question from the observations of its value range."""
    own, asked = pdf[pdf["r"].isna()].sort_values("rk"), pdf[pdf["r"].notna()]
    m, v = own["m"].to_numpy(np.int64), own["v"].to_numpy(float)
    found = [v[np.flatnonzero(m <= at)[int(r)]] for at, r in zip(asked["m"], asked["r"], strict=True)]
    return asked.assign(v=np.array(found, float))


def quantiles_so_far(df: DataFrame, asks: Column, value: str, qs: Sequence[float], lane: Lane) -> DataFrame:
    """Linear-interpolated quantiles of all known values up to and with the row, for rows with ``asks`` and a known value.

    One row (keys, row_idx, seen, q_0, q_1, ...) per such row; ``seen`` values were known.  Observations are cut into runs by time and into ranges by value, each at least
    ``RUN`` and the root of the longest series wide, so the counts per (run, range) are no more than the observations.  Running
    counts over the runs before, and the row's own run, say which range holds the rank; only that range is then searched.
    """
    keys = list(lane.keys)
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(IDX).alias("_at"), F.col(value).cast("double").alias("v"), asks.alias("asks"))
    timed = index_rows(known, keys, ("_at",)).withColumnRenamed(IDX, "m")
    ranked = pin(index_rows(timed, keys, ("v", "m")).withColumnRenamed(IDX, "rk"))
    most = (ranked.agg(F.max("m")).first()[0] or 0) + 1
    width = max(RUN, math.isqrt(most) + 1)
    rows = ranked.withColumns({"t": F.expr(f"m DIV {width}"), "b": F.expr(f"rk DIV {width}")})
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.ceil if j else F.floor)(F.lit(float(q)) * F.col("m")).cast("long").alias("k")) for i, q in enumerate(qs) for j in (0, 1)]
    asked = pin(rows.filter("asks").select(*keys, "_at", "m", "t", F.inline(F.array(*steps))))

    runs = asked.select(*keys, "t").distinct()
    cells = rows.groupBy(*keys, "b", "t").agg(F.count(F.lit(1)).alias("n"))
    grid = cells.select(*keys, "b").distinct().join(runs, keys).withColumn("n", F.lit(0).cast("long")).withColumn("ask", F.lit(True))
    earlier = Window.partitionBy(*keys, "b").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("ask", F.lit(False)).unionByName(grid).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter("ask")

    types = {c: df.schema[c].dataType.simpleString() for c in keys}
    known_keys = ", ".join(f"{c} {t}" for c, t in types.items())
    columns = {"_at": "long", "m": "long", "t": "long", "i": "int", "j": "int", "k": "long", "b": "long", "before": "long", "kind": "int"}

    def shaped(part: DataFrame, names: dict[str, str], **given: Column) -> DataFrame:
        return part.select(*keys, *[given.get(c, F.col(c) if c in part.columns else F.lit(None)).cast(t).alias(c) for c, t in names.items()])

    mixed = shaped(counted, columns, kind=F.lit(0)).unionByName(shaped(rows.join(runs, [*keys, "t"]), columns, kind=F.lit(1))).unionByName(shaped(asked, columns, kind=F.lit(2)))
    out = {**{c: t for c, t in columns.items() if c not in ("before", "kind", "k")}, "r": "long"}
    named = [*keys, *out]
    placed = pin(mixed.groupBy(*keys, "t").applyInPandas(lambda pdf: _located(pdf)[named], f"{known_keys}, " + ", ".join(f"{c} {t}" for c, t in out.items())))

    # the observations of a range go to every run that asks for it, so that no range gathers all questions
    wanted = placed.select(*keys, "b", "t").distinct()
    full = {**out, "rk": "long", "v": "double"}
    body = shaped(rows.drop("t").join(wanted, [*keys, "b"]), full, r=F.lit(None)).unionByName(shaped(placed, full))
    answer = body.groupBy(*keys, "b", "t").applyInPandas(
        lambda pdf: _selected(pdf)[[*keys, "_at", "m", "i", "j", "v"]], f"{known_keys}, _at long, m long, i int, j int, v double")
    ends = answer.groupBy(*keys, "_at", "m").agg(*[F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v"))).alias(f"_{i}_{j}") for i in range(len(qs)) for j in (0, 1)])
    part = [F.lit(float(q)) * F.col("m") - F.floor(F.lit(float(q)) * F.col("m")) for q in qs]
    return ends.select(*keys, F.col("_at").alias(IDX), (F.col("m") + 1).alias("seen"), *[(F.col(f"_{i}_0") + (F.col(f"_{i}_1") - F.col(f"_{i}_0")) * part[i]).alias(f"q_{i}") for i in range(len(qs))])
