"""Combining and ranking model outputs held as rows (row_id, model, output, p)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import safe_div
from tickloom.operators.series import BARS, IDX, Lane, carry_last, ema


def weights_column(weights: Mapping[str, float], default: float = 1.0) -> Column:
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("model")), F.lit(default))


def fuse(outputs: DataFrame, weights: Mapping[str, float], rows: str = "row_id") -> DataFrame:
    """Weighted mean per (row, output).

    The weights of all models that answered for the row count, also for an output
    one of them did not give: that counts as zero.
    """
    w = weights_column(weights, 0.0)
    one_row = Window.partitionBy(rows)  # a row holds one entry per model and output
    d = outputs.withColumn("_w", w).filter(F.col("_w") > 0)
    voters = F.collect_set(F.struct("model", "_w")).over(one_row)
    d = d.withColumn("_total", F.aggregate(voters, F.lit(0.0), lambda acc, x: acc + x["_w"]))
    return d.groupBy(rows, "output").agg(
        (F.sum(F.col("_w") * F.coalesce("p", F.lit(0.0))) / F.first("_total")).alias("fused"))


def disagreement(outputs: DataFrame, rows: str = "row_id") -> DataFrame:
    """Per row: population variance of all outputs, widest gap of one output, mean absolute difference
    over the ordered model pairs of every output (self pairs included).

    Needs no pairs: with an output's values sorted, sum |a-b| = 2 * sum (2i - n + 1) * v_i.
    """
    d = outputs.withColumn("_var", F.var_pop("p").over(Window.partitionBy(rows)))
    per = d.groupBy(rows, "output").agg(
        F.first("_var").alias("_var"), (F.max("p") - F.min("p")).alias("_gap"), F.array_sort(F.collect_list("p")).alias("_v"))
    n = F.size("_v")
    spread = F.aggregate(F.transform("_v", lambda x, i: x * (2 * i - n + 1)), F.lit(0.0), lambda a, b: a + b)
    per = per.withColumns({"_sum": 2.0 * spread, "_pairs": n * n})
    return per.groupBy(rows).agg(
        F.first("_var").alias("spread"), F.max("_gap").alias("max_gap"),
        safe_div(F.sum("_sum"), F.sum("_pairs")).alias("pairwise"))


def consensus_votes(scores: DataFrame, candidate: Sequence[str], eps: float = 1e-9) -> DataFrame:
    """How many models rank a candidate within ``eps`` of their own best score (long table: candidate, model, score)."""
    best = scores.groupBy("model").agg(F.max("score").alias("_best"))
    near = F.col("score") >= F.col("_best") - eps
    return scores.join(best, "model").groupBy(*candidate).agg(F.count_if(near).alias("votes"), F.avg("score").alias("score"))


def rank_models(stats: DataFrame, ties: Sequence[str]) -> DataFrame:
    """Quality rank (EVR, then tail loss, then precision) and safety rank (drawdown, then tail loss).

    The table has one row per model, so one ordered window is enough.
    """
    quality = Window.orderBy(F.desc("evr"), "cvar", F.desc("precision"), *ties)
    safety = Window.orderBy("max_dd", "cvar", *ties)
    return stats.withColumns({"rank_quality": F.row_number().over(quality), "rank_safety": F.row_number().over(safety)})


# Metrics in order of preference; the second group is better when smaller.
HIGHER_IS_BETTER = ("cv_score", "cv_ap", "pr_auc", "cv_auc", "auc")
LOWER_IS_BETTER = ("brier", "logloss")


def best_version(stats: DataFrame, key: str = "model", version: str = "version") -> DataFrame:
    """Best version per model by the most preferred metric it reports; the newest wins a tie."""
    have = set(stats.columns)
    options = [(c, 1.0, 100 - i) for i, c in enumerate(HIGHER_IS_BETTER)] + [
        (c, -1.0, 10 - i) for i, c in enumerate(LOWER_IS_BETTER)]
    picks = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(p).alias("priority"), (F.col(c) * sign).alias("score")))
        for c, sign, p in options if c in have
    ]
    none = F.struct(F.lit(0).alias("priority"), F.lit(float("-inf")).alias("score"))
    d = stats.withColumn("_s", F.coalesce(*picks, none))
    rank = F.struct("_s.priority", "_s.score", version)
    return d.groupBy(key).agg(F.max_by(version, rank).alias(version), F.max(rank).alias("_r")).select(
        key, version, F.col("_r.priority").alias("priority"), F.col("_r.score").alias("score"))


def blended_weights(static: Mapping[str, float], deltas: Mapping[str, Mapping[str, float]]) -> dict[str, Column]:
    """Static weights plus regime odds times their deltas, no weight below zero, summing to one.

    ``deltas`` maps a probability column to the change it makes per model.
    """
    raw = {}
    for m, base in static.items():
        w = F.lit(float(base))
        for odds, change in deltas.items():
            if m in change:
                w = w + F.coalesce(F.col(odds), F.lit(0.0)) * float(change[m])
        raw[m] = F.greatest(w, F.lit(0.0))
    total = None
    for c in raw.values():
        total = c if total is None else total + c
    return {m: F.coalesce(safe_div(c, total), F.lit(1.0 / len(raw))) for m, c in raw.items()}


def smoothed_weights(df: DataFrame, static: Mapping[str, float], deltas: Mapping[str, Mapping[str, float]],
                     smooth: float = 0.1, lane: Lane = BARS) -> DataFrame:
    """``blended_weights`` smoothed along the series as ``s * previous + (1 - s) * now``, starting from the static weights.

    That is an exponential average with a = 1 - s, except for its start: ours begins with the
    first value, so the difference to the static start, fading by s per row, is added back.
    """
    now = blended_weights(static, deltas)
    d = df.withColumns({f"_now_{m}": c for m, c in now.items()})
    d = carry_last(d, {f"_first_{m}": F.when(F.col(IDX) == 0, F.col(f"_now_{m}")) for m in now}, lane)
    d = ema(d, {f"_ema_{m}": 2.0 / (1.0 - smooth) - 1.0 for m in now}, {f"_ema_{m}": f"_now_{m}" for m in now}, lane)
    fade = F.pow(F.lit(smooth), F.col(IDX) + 1)
    raw = {m: F.col(f"_ema_{m}") + fade * (F.lit(float(static[m])) - F.col(f"_first_{m}")) for m in now}
    out = d.withColumns({f"weight_{m}": c for m, c in raw.items()})
    return out.drop(*[f"_{k}_{m}" for m in now for k in ("now", "first", "ema")])


def regime_rule(probabilities: Mapping[str, str], prefer: Mapping[str, Sequence[str]], available: Column,
                min_prob: float = 0.5) -> Column:
    """First available model the most likely regime prefers, NULL below ``min_prob``.

    ``probabilities`` maps regime names to columns; the first of equal probabilities wins.
    """
    names = list(probabilities)
    top = F.greatest(*[F.coalesce(F.col(c), F.lit(-1.0)) for c in probabilities.values()])
    regime = F.coalesce(*[F.when(F.col(probabilities[n]) == top, F.lit(n)) for n in names])
    choice = None
    for n, order in prefer.items():
        pick = F.try_element_at(F.filter(F.array(*[F.lit(m) for m in order]), lambda m: F.array_contains(available, m)), F.lit(1))
        choice = F.when(regime == n, pick) if choice is None else choice.when(regime == n, pick)
    return F.when(top >= min_prob, choice)
