"""Price-structure detectors over indexed bars."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalar import clip, decay, flag, safe_div
from tickloom.operators.series import BARS, IDX, Lane, carry_last, framed, pin
from tickloom.operators.touch import first_cross, first_hit_within

# Pivot neighbourhoods per timeframe, level tolerance, swing magnitude tiers.
PIVOTS = {"15m": 2, "1h": 3, "6h": 3, "12h": 4}
EQUAL_TOLERANCE = 0.0002
PRIMARY_SWING, SECONDARY_SWING = 0.005, 0.002


def near_equal(a, b, tol: float = EQUAL_TOLERANCE) -> Column:
    """Two price levels within ``tol`` of the larger one."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.coalesce((a != 0) & (b != 0) & (safe_div(F.abs(a - b), F.greatest(a, b)) <= tol), F.lit(False))


def _swing_columns(d: DataFrame, w: WindowSpec, left: int, right: int) -> DataFrame:
    lo, hi = w.rowsBetween(-left, -1), w.rowsBetween(1, right)
    full = (F.count("high").over(lo) == left) & (F.count("high").over(hi) == right)
    d = d.withColumns(
        {
            "swing_high": F.when(full & (F.col("high") > F.max("high").over(lo)) & (F.col("high") > F.max("high").over(hi)), F.col("high")),
            "swing_low": F.when(full & (F.col("low") < F.min("low").over(lo)) & (F.col("low") < F.min("low").over(hi)), F.col("low")),
            "swing_confirmed_at": F.when(full, F.lead("bar_close", right).over(w)),
            "_ph": F.lag("high").over(w), "_nh": F.lead("high").over(w),
            "_pl": F.lag("low").over(w), "_nl": F.lead("low").over(w),
        }
    )
    sh, sl = F.col("swing_high"), F.col("swing_low")
    size = F.when(sh.isNotNull(), F.greatest(F.abs(sh - F.col("_ph")), F.abs(sh - F.col("_nh")))).when(
        sl.isNotNull(), F.greatest(F.abs(sl - F.col("_pl")), F.abs(sl - F.col("_nl"))))
    level = F.coalesce(sh, sl)
    return d.withColumns(
        {
            "swing_equal_high": flag(sh.isNotNull() & (near_equal(sh, "_ph") | near_equal(sh, "_nh"))),
            "swing_equal_low": flag(sl.isNotNull() & (near_equal(sl, "_pl") | near_equal(sl, "_nl"))),
            "swing_tier": F.when(size > PRIMARY_SWING * level, "primary")
            .when(size > SECONDARY_SWING * level, "secondary").when(size.isNotNull(), "extended"),
        }
    ).drop("_ph", "_nh", "_pl", "_nl")


def _break_inputs(d: DataFrame, w: WindowSpec, delay: int) -> DataFrame:
    return d.withColumns(
        {
            "_sh": F.lag("swing_high", delay).over(w) if delay else F.col("swing_high"),
            "_sl": F.lag("swing_low", delay).over(w) if delay else F.col("swing_low"),
            "_ph": F.coalesce(F.lag("high").over(w), F.col("high")),
            "_pl": F.coalesce(F.lag("low").over(w), F.col("low")),
        }
    )


_BREAK_CARRY = {"last_swing_high": "_sh", "last_swing_low": "_sl"}


def _break_columns(d: DataFrame, buffer: float) -> DataFrame:
    hi, lo = F.col("last_swing_high"), F.col("last_swing_low")
    d = d.withColumns({"bos_up": flag(F.col("close") > hi + buffer), "bos_down": flag(F.col("close") < lo - buffer)})
    d = d.withColumns(
        {
            "choch_up": flag((F.col("bos_up") == 1) & lo.isNotNull() & (F.col("close") > F.col("_ph"))),
            "choch_down": flag((F.col("bos_down") == 1) & hi.isNotNull() & (F.col("close") < F.col("_pl"))),
            "broken_level": F.when(F.col("bos_down") == 1, lo).when(F.col("bos_up") == 1, hi),
        }
    )
    return d.withColumns(
        {
            "bos_flag": F.greatest("bos_up", "bos_down"),
            "choch_flag": F.greatest("choch_up", "choch_down"),
            "bias": F.when(F.col("choch_down") == 1, "DOWN").when(F.col("choch_up") == 1, "UP")
            .when(F.col("bos_down") == 1, "DOWN").when(F.col("bos_up") == 1, "UP").otherwise("NEUTRAL"),
        }
    ).drop("_sh", "_sl", "_ph", "_pl")


def _sweep_inputs(d: DataFrame, w: WindowSpec, tol: float) -> DataFrame:
    high, low = near_equal(F.col("high"), F.lag("high").over(w), tol), near_equal(F.col("low"), F.lag("low").over(w), tol)
    d = d.withColumns({"equal_high": flag(high), "equal_low": flag(low)})
    return d.withColumns({"_eqh": F.when(F.col("equal_high") == 1, F.col("high")), "_eql": F.when(F.col("equal_low") == 1, F.col("low"))})


_SWEEP_CARRY = {"_eh": "_eqh", "_el": "_eql"}


def _sweep_columns(d: DataFrame) -> DataFrame:
    d = d.withColumns(
        {
            "sweep_high": flag((F.col("high") > F.col("_eh")) & (F.col("close") < F.col("_eh"))),
            "sweep_low": flag((F.col("low") < F.col("_el")) & (F.col("close") > F.col("_el"))),
        }
    )
    rng = F.greatest(F.lit(1e-9), F.col("high") - F.col("low"))
    lo, hi = F.col("sweep_low") == 1, F.col("sweep_high") == 1
    return d.withColumns(
        {
            "swept_level": F.when(lo, F.col("_el")).when(hi, F.col("_eh")),
            "sweep_strength": F.when(lo, F.col("_el") - F.col("low")).when(hi, F.col("high") - F.col("_eh")),
            "displacement_hint": F.when(lo, (F.col("high") - F.least("open", "close")) / rng).when(
                hi, (F.greatest("open", "close") - F.col("low")) / rng),
            "sweep_flag": F.greatest("sweep_high", "sweep_low"),
            "sweep_dir": F.when(lo, 1).when(hi, -1).otherwise(0),
        }
    ).drop("_eh", "_el", "_eqh", "_eql")


def swings(df: DataFrame, left: int = 2, right: int = 2, lane: Lane = BARS) -> DataFrame:
    """Strict pivots with full neighbourhoods, equal-level flags and magnitude tier.

    A pivot is written on its own bar, ``right`` bars before it can be known;
    ``swing_confirmed_at`` is the close of the bar that confirms it.
    """
    return framed(df, lambda d, w: _swing_columns(d, w, left, right), back=left + 1, ahead=right + 1, lane=lane)


def structure_breaks(df: DataFrame, confirmed_after: int = 0, buffer: float = 0.0, lane: Lane = BARS) -> DataFrame:
    """Closes beyond the last swing, reversal flags and bias (needs ``swing_high``/``swing_low``).

    ``confirmed_after=0`` uses a pivot from its own bar on; pass the pivot's right
    neighbourhood to use it only once it is known.
    """
    d = framed(df, lambda d, w: _break_inputs(d, w, confirmed_after), back=max(confirmed_after, 1), lane=lane)
    return _break_columns(carry_last(d, {n: F.col(c) for n, c in _BREAK_CARRY.items()}, lane), buffer)


def sweeps(df: DataFrame, tol: float = EQUAL_TOLERANCE, lane: Lane = BARS) -> DataFrame:
    """Wicks beyond a remembered equal level that close back inside it."""
    d = framed(df, lambda d, w: _sweep_inputs(d, w, tol), back=1, lane=lane)
    return _sweep_columns(carry_last(d, {n: F.col(c) for n, c in _SWEEP_CARRY.items()}, lane))


def structure_block(df: DataFrame, left: int = 2, right: int = 2, confirmed_after: int = 0, buffer: float = 0.0,
                    tol: float = EQUAL_TOLERANCE, lane: Lane = BARS) -> DataFrame:
    """Pivots, breaks and sweeps together: one pass over the frames and one for the carried levels."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return _sweep_inputs(_break_inputs(_swing_columns(d, w, left, right), w, confirmed_after), w, tol)

    d = framed(df, build, back=left + confirmed_after + 2, ahead=right + 1, lane=lane)
    d = carry_last(d, {n: F.col(c) for n, c in {**_BREAK_CARRY, **_SWEEP_CARRY}.items()}, lane)
    return _sweep_columns(_break_columns(d, buffer))


def gap_births(df: DataFrame, min_size: float = 0.0005, lane: Lane = BARS) -> DataFrame:
    """Three-bar gaps: ``up`` when the bar before last stayed wholly above this one, ``down`` when wholly below."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        old_low, old_high = F.lag("low", 2).over(w), F.lag("high", 2).over(w)
        floor = F.greatest(F.lit(1e-9), F.col("close"))
        up = (old_low > F.col("high")) & ((old_low - F.col("high")) / floor >= min_size)
        down = (old_high < F.col("low")) & ((F.col("low") - old_high) / floor >= min_size)
        return d.withColumns(
            {
                "fvg_up": flag(up), "fvg_down": flag(down),
                "fvg_gap_top": F.when(up, old_low).when(down, F.col("low")),
                "fvg_gap_bottom": F.when(up, F.col("high")).when(down, old_high),
            }
        )

    return framed(df, build, back=2, lane=lane)


def gap_intervals(df: DataFrame, include_birth_bar: bool = False, lane: Lane = BARS, eps: float = 1e-9) -> DataFrame:
    """One row per gap: birth, death (NULL while open), and how it ended.

    A gap ends when price touches it or closes beyond its far side.  For a gap above
    price both come down to the low reaching its top, and for one below to the high
    reaching its bottom, so the end is a single-sided first crossing.
    """
    born = df.filter((F.col("fvg_up") == 1) | (F.col("fvg_down") == 1)).select(
        *lane.keys, IDX, F.col("fvg_gap_top").alias("top"), F.col("fvg_gap_bottom").alias("bottom"),
        (F.col("fvg_up") == 1).alias("falls"),
        F.when(F.col("fvg_up") == 1, F.col("fvg_gap_top") + eps).otherwise(F.col("fvg_gap_bottom") - eps).alias("level"),
    )
    met = first_cross(df, born, 0 if include_birth_bar else 1, ("close",), lane)
    h = F.col("hit")
    touched = (h["low"] <= F.col("top") + eps) & (h["high"] >= F.col("bottom") - eps)
    beyond = F.when(F.col("falls"), h["close"] < F.col("bottom") - eps).otherwise(h["close"] > F.col("top") + eps)
    return met.select(
        *lane.keys, F.col(IDX).alias("born"), h["i"].alias("died"), F.when(F.col("falls"), 1).otherwise(-1).alias("dir"),
        "top", "bottom", flag(touched).alias("touched"), flag(beyond).alias("beyond"), h["close"].alias("end_close"),
    )


def _covering(life: DataFrame, blocks: DataFrame, lane: Lane) -> DataFrame:
    """Per block ``_cover``: birth of the newest gap that lives in every row of the block and was born before it.

    A gap that dies covers the blocks between those of its birth and death.  That run is cut into blocks of 1, 2, 4, ...
    (at most two of a size), each keeps its newest gap, and a block asks the runs that it is part of.  Of the gaps that
    stay open only the newest before the block matters.
    """
    first, last = F.floor(F.col("born") / lane.block).cast("long") + 1, F.floor(F.col("died") / lane.block).cast("long")
    runs = (
        life.filter("died IS NOT NULL").select(*lane.keys, "born", first.alias("_from"), last.alias("_to")).filter("_from < _to")
        .withColumn("_size", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_to") - F.col("_from"))).cast("int") + 1)))
        .withColumns({"_l": F.expr("cast(ceil(_from / shiftleft(1L, _size)) as long)"), "_r": F.expr("_to div shiftleft(1L, _size)")})
        .filter("_l < _r")
        .withColumn("_run", F.explode(F.array(F.when(F.col("_l") % 2 == 1, F.col("_l")), F.when(F.col("_r") % 2 == 1, F.col("_r") - 1))))
        .filter("_run IS NOT NULL").groupBy(*lane.keys, "_size", "_run").agg(F.max("born").alias("_newest"))
    )
    asked = blocks.filter("_block > 0").withColumn("_size", F.explode(F.sequence(F.lit(0), F.floor(F.log2("_block")).cast("int")))).withColumn(
        "_run", F.expr("_block div shiftleft(1L, _size)"))
    return asked.join(runs, [*lane.keys, "_size", "_run"]).groupBy(*lane.keys, "_block").agg(F.max("_newest").alias("_cover"))


def _newest_open(d: DataFrame, lane: Lane) -> DataFrame:
    """Add ``_newest``: birth of the newest gap still open, looking first at gaps born in the row's own block.

    Takes ``_gap`` (the gap born in the row), ``_older`` (newest open one from before the block) and ``_block``.
    """
    def step(block: pa.Table) -> pa.Table:
        block = block.sort_by(IDX)
        gap = block["_gap"].combine_chunks()
        died = gap.field("died").to_pylist()
        born = gap.is_valid().to_pylist()
        newest, open_gaps = [], []  # births and deaths, the newest last; what has died at the end goes for good
        for i, is_born, end in zip(block[IDX].to_pylist(), born, died, strict=True):
            if is_born:
                open_gaps.append((i, end))
            while open_gaps and open_gaps[-1][1] is not None and open_gaps[-1][1] <= i:
                open_gaps.pop()
            newest.append(open_gaps[-1][0] if open_gaps else None)
        newest = pc.coalesce(pa.array(newest, pa.int64()), block["_older"])
        return block.append_column("_newest", newest)

    return d.groupBy(*lane.keys, "_block").applyInArrow(step, T.StructType([*d.schema.fields, T.StructField("_newest", T.LongType())]))


def gaps(df: DataFrame, include_birth_bar: bool = False, atr: str | None = None, tau: float = 8.0, fresh: int = 8,
         stale: int = 24, lane: Lane = BARS) -> DataFrame:
    """Gap columns per bar: births, touches, fills, breaks, open counts, newest age, last-gap context.

    A gap is two rows, its birth and its death.  Open counts are running differences of both; one summary per block
    carries them, the last gap and the newest open gap on, so no row holds a list and a gap that never fills costs nothing.
    """
    rows = pin(gap_births(df, lane=lane))
    life = pin(gap_intervals(rows, include_birth_bar, lane))
    shift = 1 if include_birth_bar else 0
    birth_block, death_block = (F.floor(F.col(c) / lane.block).cast("long") for c in ("born", "died"))
    gap = F.struct("born", "died", "dir", "top", "bottom", "beyond")
    up, down = F.count_if(F.col("dir") == 1), F.count_if(F.col("dir") == -1)
    births = life.select(*lane.keys, F.col("born").alias(IDX), gap.alias("_gap"))
    deaths = life.filter("died IS NOT NULL").groupBy(*lane.keys, F.col("died").alias(IDX)).agg(
        F.max("touched").alias("_touched"), F.min("touched").alias("_all_touched"), up.alias("_dead_up"), down.alias("_dead_down"),
        F.max(F.when(birth_block < death_block, F.col("born"))).alias("_old"),
    )
    # what each block adds, and from it what each block begins with
    blocks = pin(rows.select(*lane.keys, lane.number().alias("_block")).distinct())
    born = life.groupBy(*lane.keys, birth_block.alias("_block")).agg(
        up.alias("_up"), down.alias("_down"), F.max_by(gap, "born").alias("_last"), F.max(F.when(F.col("died").isNull(), F.col("born"))).alias("_lasting"))
    died = life.filter("died IS NOT NULL").groupBy(*lane.keys, death_block.alias("_block")).agg(up.alias("_gone_up"), down.alias("_gone_down"))
    before = Window.partitionBy(*lane.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def net(plus: str, minus: str) -> Column:
        return F.coalesce(F.sum(F.coalesce(plus, F.lit(0)) - F.coalesce(minus, F.lit(0))).over(before), F.lit(0))

    on = [*lane.keys, "_block"]
    seeds = (
        blocks.join(born, on, "left").join(died, on, "left").join(_covering(life, blocks, lane), on, "left")
        .select(*on, net("_up", "_gone_up").alias("_up"), net("_down", "_gone_down").alias("_down"), F.last("_last", True).over(before).alias("_last"),
                F.greatest("_cover", F.max("_lasting").over(before)).alias("_cover"))
    )
    w = lane.window()
    so_far, later = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    d = rows.join(births, [*lane.keys, IDX], "left").join(deaths, [*lane.keys, IDX], "left")
    d = d.withColumn("_block", lane.number()).join(seeds, on, "left")
    i, c = F.col(IDX), F.col("_ctx")

    def still_open(side: int, seed: str, dead: str) -> Column:
        return (F.sum(F.when(F.col("_gap")["dir"] == side, 1).otherwise(0) - F.coalesce(dead, F.lit(0))).over(so_far) + F.col(seed)).cast("int")

    d = d.withColumns(
        {
            "fvg_open_up": still_open(1, "_up", "_dead_up"), "fvg_open_down": still_open(-1, "_down", "_dead_down"),
            "_ctx": F.coalesce(F.last("_gap", True).over(so_far), F.col("_last")),
            "_older": F.greatest(F.max("_old").over(later), F.col("_cover")),
        }
    ).drop("_up", "_down", "_last", "_cover", "_dead_up", "_dead_down", "_old")
    d = _newest_open(d, lane)
    broken = F.col("_all_touched") == 0
    age = i - c["born"]
    scale = F.when(F.col(atr) > 0, F.col(atr)) if atr else F.lit(None).cast("double")
    gone = (c["beyond"] == 1) & (c["died"] <= i)
    return d.withColumns(
        {
            "fvg_touch_flag": flag(F.col("_touched") == 1),
            "fvg_is_broken": flag(broken),
            "fvg_broken_level": F.when(broken, F.col("close")),
            "fvg_age": i - F.col("_newest") + shift,
            "fvg_filled_flag": flag(F.col("_touched") == 1),
            "fvg_open_total": F.col("fvg_open_up") + F.col("fvg_open_down"),
            "fvg_has_active": flag(F.col("fvg_open_up") + F.col("fvg_open_down") > 0),
            "fvg_mid": (F.col("fvg_gap_top") + F.col("fvg_gap_bottom")) / 2.0,
            "fvg_ctx_dir": F.coalesce(c["dir"], F.lit(0)),
            "fvg_ctx_age": age,
            "fvg_ctx_weight": F.when(c.isNull() | F.coalesce(gone, F.lit(False)), 0.0).otherwise(decay(age, tau)),
            "fvg_ctx_fresh": flag(age <= fresh),
            "fvg_ctx_stale": flag(age > stale),
            "fvg_ctx_dist_top": (c["top"] - F.col("close")) / F.coalesce(scale, F.lit(1.0)),
            "fvg_ctx_dist_bot": (c["bottom"] - F.col("close")) / F.coalesce(scale, F.lit(1.0)),
        }
    ).drop("_ctx", "_gap", "_older", "_newest", "_touched", "_all_touched", "_block")


def zone_births(df: DataFrame, min_body: float = 0.002, min_move: float = 0.003, lane: Lane = BARS) -> DataFrame:
    """Opposite-colour bar followed by a displacement bar: demand and supply zones with a quality score."""
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        po, pc = F.lag("open").over(w), F.lag("close").over(w)
        o, c = F.col("open"), F.col("close")
        price = F.greatest(F.lit(1e-9), c)
        body = F.abs(c - o) / price
        eligible = (F.col(IDX) >= 2) & (body >= min_body)
        demand = eligible & (pc < po) & (c > o) & ((c - o) / price >= min_move)
        supply = eligible & (pc > po) & (c < o) & ((po - c) / price >= min_move)
        imbalance = F.greatest(F.lit(1e-9), F.abs(c - o) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)))
        proximity = F.abs(pc - o) / F.greatest(F.lit(1e-9), o)
        quality = imbalance * 0.7 + (1.0 - proximity) * 0.3
        return d.withColumns(
            {
                "demand_born": flag(demand), "supply_born": flag(supply),
                "zone_top": F.lag("high").over(w), "zone_bottom": F.lag("low").over(w),
                "zone_quality": F.when(demand | supply, quality),
            }
        )

    return framed(df, build, back=1, lane=lane)


def zones(df: DataFrame, max_age: int = 300, lane: Lane = BARS) -> DataFrame:
    """Best zone of each side younger than ``max_age`` bars, whether price has been back in it, and the choice."""
    rows = zone_births(df, lane=lane)
    born = rows.filter((F.col("demand_born") == 1) | (F.col("supply_born") == 1)).select(
        *lane.keys, IDX, "zone_top", "zone_bottom", (F.col("demand_born") == 1).alias("_demand")
    )

    def back_inside(x: Column) -> Column:
        price = F.when(F.col("_demand"), x["low"]).otherwise(x["high"])
        return (price <= F.col("zone_top")) & (price >= F.col("zone_bottom"))

    reach = max_age - 2
    touched = first_hit_within(rows, born, ("low", "high"), back_inside, 0, reach, lane=lane).select(
        *lane.keys, IDX, F.col("hit_idx").alias("_touch")
    )
    d = rows.join(touched, [*lane.keys, IDX], "left")

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(-reach, 0)
        zone = F.struct(F.col("zone_top").alias("top"), F.col("zone_bottom").alias("bottom"),
                        F.col("zone_quality").alias("quality"), F.col(IDX).alias("born"), F.col("_touch").alias("touch"))
        out = {}
        for side in ("demand", "supply"):
            rank = F.when(F.col(f"{side}_born") == 1, F.struct(F.col("zone_quality").alias("q"), (-F.col(IDX)).alias("b")))
            out[f"_{side}"] = F.max_by(zone, rank).over(frame)
        return d.withColumns(out)

    d = framed(d, build, back=reach, lane=lane)
    cols = {}
    for side in ("demand", "supply"):
        z = F.col(f"_{side}")
        cols |= {
            f"{side}_top": z["top"], f"{side}_bottom": z["bottom"], f"{side}_quality": z["quality"],
            f"{side}_age": F.col(IDX) - z["born"] + 1,
            f"{side}_touched": F.when(z.isNotNull(), flag(z["touch"] <= F.col(IDX))),
        }
    d = d.withColumns(cols).drop("_demand", "_supply", "_touch", "zone_top", "zone_bottom", "zone_quality")
    pick = F.coalesce("demand_quality", F.lit(-1.0)) >= F.coalesce("supply_quality", F.lit(-1.0))

    def chosen(c: str) -> Column:
        return F.when(pick, F.col(f"demand_{c}")).otherwise(F.col(f"supply_{c}"))

    return d.withColumns(
        {
            "zone_id": F.when(pick & F.col("demand_top").isNotNull(), "demand")
            .when(~pick & F.col("supply_top").isNotNull(), "supply").otherwise(""),
            "zone_hi": chosen("top"), "zone_lo": chosen("bottom"),
            "zone_recency": F.coalesce(1.0 / (1.0 + chosen("age")), F.lit(0.0)),
            "zone_displacement": F.coalesce(clip(chosen("quality"), F.lit(0.0)), F.lit(0.0)),
            "zone_mitigation": 1.0 - F.coalesce(chosen("touched"), F.lit(0)).cast("double"),
        }
    )
