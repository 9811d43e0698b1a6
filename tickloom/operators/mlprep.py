"""Model data: splits, profiles, hygiene, weights, metrics, calibration, and ``pyspark.ml`` fits.

Tables that come back to the driver hold one row per column, candidate threshold,
bin or fold, never one per data row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, PCA, RobustScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import clip, flag, safe_div
from tickloom.operators.quantile import bucket_of, column_quantiles, exact_quantiles
from tickloom.operators.series import IDX, LEDGER, Lane, carry_total, index_rows, pin


# ------------------------------------------------------------------ splits

def trim_history(df: DataFrame, history: int, horizon: int, keys: Sequence[str] = ("asset", "tf")) -> DataFrame:
    """Drop the first ``history`` and last ``horizon`` rows of each series."""
    last = df.groupBy(*keys).agg(F.max(IDX).alias("_last"))
    return df.join(last, list(keys)).filter((F.col(IDX) >= history) & (F.col(IDX) <= F.col("_last") - horizon)).drop("_last")


def split_at(df: DataFrame, cut: str, until: str | None = None, ts: str = "bar_close") -> tuple[DataFrame, DataFrame]:
    """Chronological split; the row at the cut belongs to both sides."""
    at = F.lit(cut).cast("timestamp")
    late = F.col(ts) >= at
    return df.filter(F.col(ts) <= at), df.filter(late & (F.col(ts) <= F.lit(until).cast("timestamp")) if until else late)


def purged_folds(df: DataFrame, folds: int = 4, embargo: int = 2, purge: int = 0, min_train: int = 50, min_valid: int = 10) -> DataFrame:
    """Rows with their (fold, role): expanding train sets that end ``max(embargo, purge)`` rows before validation.

    ``row_idx`` is the position over the whole frame.  A row appears once per fold it serves.
    """
    total = df.agg((F.max(IDX) + 1).alias("n")).first()["n"] or 0
    size = total // (folds + 1)
    plan = []
    for k in range(folds):
        start = total - (folds - k) * size
        train = max(start - max(embargo, purge), 0)
        if train >= min_train and size >= min_valid:
            plan.append(F.struct(F.lit(k).alias("fold"), F.lit(train).alias("train"), F.lit(start).alias("start"),
                                 F.lit(start + size).alias("stop")))
    none = "array<struct<fold:int,train:int,start:int,stop:int>>"
    d = df.withColumn("_f", F.explode(F.array(*plan) if plan else F.array().cast(none)))
    role = F.when(F.col(IDX) < F.col("_f.train"), "train").when(
        (F.col(IDX) >= F.col("_f.start")) & (F.col(IDX) < F.col("_f.stop")), "valid")
    return d.withColumns({"fold": F.col("_f.fold"), "role": role}).filter(F.col("role").isNotNull()).drop("_f")


# ------------------------------------------------------------------ hygiene

def profile(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Missing share and distinct count per column, one pass (distinct values counted as (column, value) groups)."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x")).select("x.*")
    if approximate:
        return cells.groupBy("column").agg(F.avg(flag(F.col("v").isNull())).alias("missing"), F.approx_count_distinct("v").alias("distinct"))
    grouped = cells.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    return grouped.groupBy("column").agg(
        (F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("missing"),
        F.count("v").alias("distinct"))


def duplicate_columns(df: DataFrame, cols: Sequence[str], row_id: Column) -> list[tuple[str, str]]:
    """(later, earlier) pairs of identical columns: equal hashes first, then a full equality check of the candidates."""
    sums = df.agg(*[F.bit_xor(F.xxhash64(row_id, F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))))).alias(c) for c in cols]).first()
    seen: dict[int, str] = {}
    pairs = []
    for c in cols:
        if sums[c] in seen:
            pairs.append((c, seen[sums[c]]))
        else:
            seen[sums[c]] = c
    if not pairs:
        return []
    same = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(a) for a, b in pairs]).first()
    return [(a, b) for a, b in pairs if same[a]]


def correlations(df: DataFrame, cols: Sequence[str], min_rows: int = 2, per_pass: int = 500) -> DataFrame:
    """Pearson correlation of every column pair over the rows that have both, ``per_pass`` pairs to an aggregate.

    No pair of rows is ever formed; the result has one row per column pair.
    """
    pairs = list(combinations(cols, 2))
    out = None
    for at in range(0, len(pairs), per_pass):
        cells = []
        for a, b in pairs[at : at + per_pass]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both).alias("rows"),
                                  F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias("corr")))
        part = df.agg(F.array(*cells).alias("p")).select(F.explode("p").alias("p")).select("p.*")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("corr", F.when((F.col("rows") >= min_rows) & ~F.isnan("corr"), F.col("corr")))


def asset_correlations(df: DataFrame, value: str = "ret", min_rows: int = 50) -> DataFrame:
    """Correlation of every two assets over the times at which both have a value.

    Assets meet at their common times and are summed up per pair before the shuffle; no list of assets is ever built.
    """
    known = df.filter(F.col(value).isNotNull())
    a, b = (known.select("bar_close", F.col("asset").alias(n), F.col(value).cast("double").alias(f"_{n}")) for n in "ab")
    out = a.join(b, "bar_close").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("rows"), F.corr("_a", "_b").alias("corr"))
    return out.withColumn("corr", F.when((F.col("rows") >= min_rows) & ~F.isnan("corr"), F.col("corr")))


def hygiene(df: DataFrame, cols: Sequence[str], row_id: Column, max_missing: float = 0.35, max_corr: float = 0.90,
            floor: int = 24) -> list[str]:
    """Columns left after dropping empty, constant, sparse, duplicate and strongly correlated ones, never below ``floor``."""
    stats = {r["column"]: r for r in profile(df, cols).collect()}
    left = [c for c in cols if stats[c]["distinct"] > 1]

    def drop(bad: list[str]) -> None:
        for c in bad[: max(len(left) - floor, 0)]:
            left.remove(c)

    drop([c for c in left if stats[c]["missing"] > max_missing])
    if len(left) > floor:
        drop([a for a, _ in duplicate_columns(df, left, row_id)])
    if len(left) > floor and len(left) > 1:
        strong = {r["b"] for r in correlations(df, left).filter(F.abs("corr") >= max_corr).select("b").distinct().collect()}
        drop([c for c in left if c in strong])
    return left


def mutual_information(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information between the quantile bin of each column and the label; missing values form their own bin."""
    edges: dict[str, list[float]] = {c: [] for c in cols}
    for r in column_quantiles(df, cols, [i / bins for i in range(bins + 1)]).collect():
        edges[r["column"]].append(r["value"])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(bucket_of(F.col(c).cast("double"), edges[c]), F.lit(-1)).alias("bin")) for c in cols])
    n = df.select(F.explode(cells).alias("x"), F.col(label).alias("y")).groupBy("x.column", "x.bin", "y").agg(
        F.count(F.lit(1)).alias("n"))  # at most columns * bins * classes rows from here on
    by_bin = n.groupBy("column", "bin").agg(F.sum("n").alias("nb"))
    by_y = n.groupBy("column", "y").agg(F.sum("n").alias("ny"))
    total = n.groupBy("column").agg(F.sum("n").alias("nt"))
    j = n.join(by_bin, ["column", "bin"]).join(by_y, ["column", "y"]).join(total, "column")
    term = F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("nb") * F.col("ny")))
    return j.groupBy("column").agg(F.sum(term).alias("mi"))


# ------------------------------------------------------------------ weights and metrics

def class_balance(df: DataFrame, label: str, min_ratio: float = 1.5) -> DataFrame:
    """Counts, ratio and balanced class weights (1 when the classes are close to even)."""
    c = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    total, pos, neg = F.col("pos") + F.col("neg"), F.col("pos"), F.col("neg")
    skew = F.greatest(pos, neg) / F.greatest(F.least(pos, neg), F.lit(1))
    on = (pos > 0) & (neg > 0) & (skew >= min_ratio)
    return c.withColumns({"scale_pos_weight": safe_div(neg, pos), "weight_0": F.when(on, total / (2.0 * neg)).otherwise(1.0),
                          "weight_1": F.when(on, total / (2.0 * pos)).otherwise(1.0)})


def with_class_weight(df: DataFrame, label: str, name: str = "weight", min_ratio: float = 1.5) -> DataFrame:
    w = class_balance(df, label, min_ratio).first()
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(w["weight_1"])).otherwise(F.lit(w["weight_0"])))


def _clipped(score: str) -> Column:
    return clip(F.col(score).cast("double"), F.lit(1e-6), F.lit(1.0 - 1e-6))


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Average precision, ROC area, Brier score, and precision/recall/F1 at a threshold; equal scores rank as one."""
    p = _clipped(score)
    d = df.select(p.alias("p"), F.col(label).cast("int").alias("y")).dropna()
    ties = d.groupBy("p").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = index_rows(ties.withColumn("_down", -F.col("p")), (), ("_down",))
    cum = carry_total(ranked, sums={"tp": F.col("pos"), "seen": F.col("n")}, lane=LEDGER)
    neg = F.col("n") - F.col("pos")
    curve = cum.agg(
        F.sum("pos").alias("_p"), F.sum(neg).alias("_n"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("_ap"),
        F.sum(neg * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0)).alias("_auc"))
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    flat = d.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
        F.coalesce(safe_div(F.count_if(hit & pos), F.count_if(hit)), F.lit(0.0)).alias("precision"),
        F.coalesce(safe_div(F.count_if(hit & pos), F.count_if(pos)), F.lit(0.0)).alias("recall"), F.avg(flag(hit)).alias("positive_rate"))
    pr, rc = F.col("precision"), F.col("recall")
    areas = curve.select(F.struct(safe_div("_ap", "_p").alias("ap"), safe_div(F.col("_auc"), F.col("_p") * F.col("_n")).alias("auc")).alias("a"))
    return flat.withColumn("_a", areas.scalar()).select(
        "rows", F.col("_a.ap").alias("ap"), F.col("_a.auc").alias("auc"), "brier", "precision", "recall", F.coalesce(safe_div(2.0 * pr * rc, pr + rc), F.lit(0.0)).alias("f1"), "positive_rate")


def threshold_table(df: DataFrame, label: str, score: str, default: float = 0.5) -> DataFrame:
    """Precision, recall and F1 at every distinct score (kept within 1e-4 of 0 and 1) and at ``default``.

    Equal scores are counted first; running counts from the highest score down then give every threshold its row.
    """
    d = df.select(_clipped(score).alias("p"), F.col(label).cast("int").alias("y")).dropna()
    counts = d.groupBy("p").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    cuts = counts.select(clip(F.col("p"), F.lit(1e-4), F.lit(1.0 - 1e-4)).alias("p")).union(df.sparkSession.createDataFrame([(default,)], "p double")).distinct()
    values = counts.withColumn("cut", F.lit(0)).unionByName(cuts.select("p", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("cut")))
    merged = values.groupBy((-F.col("p")).alias("_down")).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.max("cut").alias("cut"))
    run = carry_total(index_rows(merged, (), ("_down",)), sums={"tp": F.col("pos"), "flagged": F.col("n")}, lane=LEDGER)
    total = counts.agg(F.sum("pos")).scalar()
    at = run.filter("cut = 1").select((-F.col("_down")).alias("threshold"), "tp", "flagged")
    out = at.withColumns({"precision": F.coalesce(safe_div("tp", "flagged"), F.lit(0.0)), "recall": F.coalesce(safe_div(F.col("tp"), total), F.lit(0.0))})
    pr, rc = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.coalesce(safe_div(2.0 * pr * rc, pr + rc), F.lit(0.0)))


def best_threshold(table: DataFrame, metric: str = "f1", min_precision: float = 0.10, min_recall: float = 0.01, default: float = 0.5) -> DataFrame:
    """Lowest threshold with the best metric among those that meet both floors, else the default."""
    ok = (F.col("precision") >= min_precision) & (F.col("recall") >= min_recall)
    rank = F.when(ok, F.struct(F.col(metric), (-F.col("threshold")).alias("t")))
    return table.agg(
        F.coalesce(F.max_by("threshold", rank), F.lit(default)).alias("threshold"),
        F.coalesce(F.max_by(metric, rank), F.max(F.when(F.col("threshold") == default, F.col(metric)))).alias("best_value"))


def top_share_precision(df: DataFrame, label: str, score: str, share: float, tie: str) -> DataFrame:
    """Share of positives among the best-scored rows (at least one row)."""
    ranked = index_rows(df.select((-F.col(score)).alias("_down"), tie, F.col(label).alias("y")), (), ("_down", tie))
    n = ranked.count()
    k = max(int(round(n * min(max(share, 0.001), 1.0))), 1)
    return ranked.filter(F.col(IDX) < k).agg(F.count(F.lit(1)).alias("rows"), F.avg("y").alias("precision_at_top"))


def winsor_bounds(train: DataFrame, cols: Sequence[str], low: float, high: float) -> dict[str, tuple[float, float]]:
    got: dict[str, dict[float, float]] = {}
    for r in column_quantiles(train, cols, (low, high)).collect():
        got.setdefault(r["column"], {})[r["q"]] = r["value"]
    return {c: (v[low], v[high]) for c, v in got.items()}


def winsorise(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Clip to bounds that were fitted elsewhere."""
    return df.withColumns({c: clip(F.col(c), F.lit(lo), F.lit(hi)) for c, (lo, hi) in bounds.items()})


def histogram_bin(score: str, bins: int = 15) -> Column:
    edges = np.linspace(0, 1, bins + 1)
    b = F.lit(-1)
    for e in edges:
        b = b + (F.col(score) >= F.lit(float(e))).cast("int")
    return F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1))


def histogram_calibrated(fit: DataFrame, df: DataFrame, label: str, score: str, bins: int = 15, name: str = "calibrated") -> DataFrame:
    """Mean label of the score's bin, 0.5 for a bin the fit never saw; at most ``bins`` numbers are carried over."""
    means = {r["b"]: r["m"] for r in fit.groupBy(histogram_bin(score, bins).alias("b")).agg(F.avg(label).alias("m")).collect()}
    table = F.array(*[F.lit(float(means.get(b, 0.5))) for b in range(bins)])
    return df.withColumn(name, F.element_at(table, histogram_bin(score, bins) + 1))


def choose_calibration(df: DataFrame, label: str, score: str) -> DataFrame:
    """Platt, isotonic and histogram calibration, each with its Brier score, best first."""
    y = F.col(label).cast("double")
    base = VectorAssembler(inputCols=[score], outputCol="_x").transform(df.withColumn("_y", y))
    platt = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=100).fit(base).transform(base)
    iso = IsotonicRegression(featuresCol="_x", labelCol="_y", predictionCol="_iso").fit(base).transform(base)
    hist = histogram_calibrated(df, df, label, score)

    def brier(d: DataFrame, p: Column, name: str) -> DataFrame:
        return d.agg(F.avg(F.pow(p - y, 2)).alias("brier")).withColumn("method", F.lit(name))

    out = brier(platt, vector_to_array("probability")[1], "platt").unionByName(
        brier(iso, F.col("_iso"), "isotonic")).unionByName(brier(hist, F.col("calibrated"), "histogram"))
    return out.orderBy("brier")


def pinball(df: DataFrame, actual: str, predicted: str, q: float) -> Column:
    e = F.col(actual) - F.col(predicted)
    return F.avg(F.greatest(q * e, (q - 1.0) * e))


def objective(ap: Column, auc: Column, topk: Column, positive_rate: Column) -> Column:
    """Weighted score of average precision, ROC edge, class balance and top-share precision."""
    floor = F.when(positive_rate > 0, F.least(positive_rate / 0.05, F.lit(1.0))).otherwise(0.0)
    cap = F.when(positive_rate < 1, F.least((1.0 - positive_rate) / 0.50, F.lit(1.0))).otherwise(0.0)
    return 0.55 * ap + 0.15 * F.greatest(auc - 0.5, F.lit(0.0)) + 0.10 * F.greatest(F.least(floor, cap), F.lit(0.0)) + 0.20 * topk


def fold_summary(scores: DataFrame, value: str = "objective") -> DataFrame:
    """Mean over folds with its 95 % interval."""
    half = F.coalesce(1.96 * F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))
    return scores.agg(F.count(value).alias("folds"), F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


# ------------------------------------------------------------------ pyspark.ml fits

def preprocessing(numeric: Sequence[str], categorical: Sequence[str] = (), robust: bool = False, out: str = "features") -> Pipeline:
    """Median imputation, scaling and one-hot encoding; fit it on a training fold only."""
    filled = [f"{c}__f" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
              VectorAssembler(inputCols=filled, outputCol="_num", handleInvalid="keep")]
    stages.append(RobustScaler(inputCol="_num", outputCol="_scaled", withCentering=True) if robust
                  else StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True))
    parts = ["_scaled"]
    if categorical:
        idx = [f"{c}__i" for c in categorical]
        hot = [f"{c}__h" for c in categorical]
        stages += [StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep"),
                   OneHotEncoder(inputCols=idx, outputCols=hot, handleInvalid="keep")]
        parts += hot
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep")])


def classifier(numeric: Sequence[str], label: str, weight: str | None = None, categorical: Sequence[str] = ()) -> Pipeline:
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=30, regParam=0.01, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[*preprocessing(numeric, categorical).getStages(), lr])


def probability(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    out = model.transform(df)
    return out.select(*df.columns, vector_to_array("probability")[1].alias(name))


def fold_ids(folds: DataFrame) -> list[int]:
    return [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]


def out_of_fold(folds: DataFrame, numeric: Sequence[str], label: str, name: str, categorical: Sequence[str] = ()) -> DataFrame:
    """Validation rows of every fold scored by a model that saw only that fold's training rows, with class weights."""
    parts = None
    for k in fold_ids(folds):
        fold = folds.filter(F.col("fold") == k)
        train = with_class_weight(fold.filter(F.col("role") == "train"), label)
        scored = probability(classifier(numeric, label, "weight", categorical).fit(train), fold.filter(F.col("role") == "valid"), name)
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def fold_metrics(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision and ROC area per fold."""
    rows = []
    for k in fold_ids(scored):
        m = binary_metrics(scored.filter(F.col("fold") == k), label, score).first()
        rows.append((k, m["rows"], m["ap"], m["auc"], m["brier"]))
    return scored.sparkSession.createDataFrame(rows, "fold int, rows long, ap double, auc double, brier double")


def stacked(folds: DataFrame, specialists: Mapping[str, Sequence[str]], label: str) -> DataFrame:
    """Second-stage score from truly out-of-fold specialist scores: fitted on the earlier folds, applied to the later."""
    oof = None
    for name, cols in specialists.items():
        s = pin(out_of_fold(folds, cols, label, f"prob_{name}").select("id", "fold", label, f"prob_{name}"))
        oof = s if oof is None else oof.join(s.drop(label), ["id", "fold"])
    probs = [f"prob_{n}" for n in specialists]
    ids = fold_ids(oof)
    parts = None
    for k in ids[1:]:
        model = classifier(probs, label).fit(oof.filter(F.col("fold") < k))
        scored = probability(model, oof.filter(F.col("fold") == k), "prob_meta")
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def person_periods(df: DataFrame, event: str = "hazard_event", time: str = "hazard_time") -> DataFrame:
    """One row per bar survived: ``failed`` is 1 only on the bar of the event."""
    d = df.withColumn("period", F.explode(F.sequence(F.lit(1), F.col(time))))
    return d.withColumn("failed", flag((F.col(event) == 1) & (F.col("period") == F.col(time))).cast("double"))


def hazard_model(train: DataFrame, numeric: Sequence[str]) -> PipelineModel:
    """Discrete-time hazard: one regression over bar-survival rows with the bar as a category."""
    rows = person_periods(train).withColumn("period_name", F.col("period").cast("string"))
    return classifier(numeric, "failed", categorical=["period_name"]).fit(rows)


def hazard_curves(model: PipelineModel, df: DataFrame, bars: Sequence[int], row_id: str) -> DataFrame:
    """Map of bar to failure probability per row."""
    spread = df.withColumn("period", F.explode(F.array(*[F.lit(b) for b in bars]))).withColumn("period_name", F.col("period").cast("string"))
    scored = probability(model, spread, "p")
    return scored.groupBy(row_id).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("period", "p")))).alias("hazard_curve"))


def conditional_quantiles(df: DataFrame, target: str, keys: Sequence[str], qs: Sequence[float] = (0.05, 0.10, 0.50, 0.90, 0.95)) -> DataFrame:
    """Empirical quantiles of the target in each group of conditions."""
    return exact_quantiles(df, target, qs, keys)


def permutation_drop(model: PipelineModel, df: DataFrame, col: str, label: str, seed_col: str) -> tuple[float, float]:
    """Average precision before and after one column is shuffled over the rows.

    The shuffle pairs each row with the row at the same rank in a hash order of the ids.
    """
    def ap(d: DataFrame) -> float:
        return binary_metrics(probability(model, d, "p"), label, "p").first()["ap"]

    here = index_rows(df.drop(IDX), (), (seed_col,))
    other = index_rows(df.select(seed_col, col, F.xxhash64(F.col(seed_col), F.lit(17)).alias("_h")), (), ("_h", seed_col)).select(IDX, F.col(col).alias("_swap"))
    mixed = here.join(other, IDX).withColumn(col, F.col("_swap")).drop("_swap")
    return ap(df), ap(mixed)


def filled_and_clipped(df: DataFrame, cols: Sequence[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Rows with any of the columns known; gaps take the column's median, values stay between two of its quantiles."""
    known = df.filter(F.coalesce(*cols).isNotNull())
    q = {(r["column"], r["q"]): r["value"] for r in column_quantiles(known, cols, (low, 0.5, high)).collect()}  # three numbers a column
    fitted = {}
    for c in cols:
        middle = q.get((c, 0.5), 0.0)
        fitted[c] = clip(F.coalesce(F.col(c), F.lit(middle)), F.lit(q.get((c, low), middle)), F.lit(q.get((c, high), middle)))
    return known.withColumns(fitted)


def clusters(df: DataFrame, cols: Sequence[str], k: int = 4, soft: bool = True, components: int | None = None) -> DataFrame:
    """Scaled features, optional PCA, then a Gaussian mixture (posteriors) or k-means; adds ``state``."""
    stages = list(preprocessing(cols, out="_vec").getStages())
    feats = "_vec"
    if components:
        stages.append(PCA(k=components, inputCol="_vec", outputCol="_pca"))
        feats = "_pca"
    stages.append(GaussianMixture(k=k, seed=7, featuresCol=feats, predictionCol="state", probabilityCol="_post", maxIter=20) if soft
                  else KMeans(k=k, seed=7, featuresCol=feats, predictionCol="state", maxIter=20))
    out = Pipeline(stages=stages).fit(df).transform(df)
    extra = [vector_to_array("_post").alias("posterior")] if soft else []
    return out.select(*df.columns, "state", *extra)


def regime_names(df: DataFrame, state: str = "state") -> DataFrame:
    """Mean volatility, trend and compression per state and the regime they suggest."""
    m = df.groupBy(state).agg(F.count(F.lit(1)).alias("rows"), F.avg("vol_pct").alias("vol"), F.avg("trend_persist").alias("trend"),
                              F.avg("compression_12h").alias("comp"))
    high = F.col("vol") > 0.66
    name = (F.when(high & (F.col("trend") > 0.55), "trend").when(high & (F.col("trend") <= 0.55), "expansion")
            .when(F.col("comp") < -0.05, "collapse").otherwise("range"))
    return m.withColumn("regime", name)


def label_summary(df: DataFrame, label: str = "state", noise: int = -1) -> DataFrame:
    """Rows and share per cluster label, and the noise share."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = n.agg(F.sum("rows")).scalar()
    quiet = n.agg(F.coalesce(F.sum(F.when(F.col(label) == noise, F.col("rows"))), F.lit(0))).scalar()
    return n.withColumns({"share": F.col("rows") / total, "noise_share": quiet / total})


def acceptance(metrics: DataFrame, cv_score: float, score: str = "ap", max_drop: float = 0.05, min_score: float | None = None,
               min_precision: float = 0.10) -> DataFrame:
    """Holdout verdict: no large drop from the cross-validated score, and enough precision at the threshold."""
    why = F.array_compact(F.array(
        F.when(F.col(score) < min_score, "acceptance_score_below_min") if min_score is not None else F.lit(None).cast("string"),
        F.when(F.lit(cv_score) - F.col(score) > max_drop, "acceptance_drop_exceeds_tolerance"),
        F.when(F.col("precision") < min_precision, "acceptance_precision_below_min")))
    return metrics.withColumns({"reasons": F.array_join(why, ","), "accepted": flag(F.size(why) == 0)})


def candidate_table(base: DataFrame, candidates: Sequence[tuple[str, Mapping]], registry: Mapping[str, Callable], columns: Mapping[str, str],
                    keep: Sequence[str]) -> DataFrame:
    """Long table (label, candidate, reach, ``keep`` columns, y): one branch of one union for each candidate."""
    parts = []
    for i, (name, params) in enumerate(candidates):
        reach = max([1, *[int(v) for k, v in params.items() if k in ("horizon", "last")]])
        rows = registry[name](base, **params)
        parts.append(rows.select(F.lit(name).alias("label"), F.lit(i).alias("candidate"), F.lit(reach).alias("reach"), *keep, F.col(columns[name]).cast("int").alias("y")))
    return reduce(DataFrame.unionByName, parts)


def ranked_scores(scored: DataFrame, keys: Sequence[str], share: float = 0.10) -> DataFrame:
    """Rows, average precision, ROC area and precision of the top ``share`` for every group of (keys, p, y).

    Equal scores are counted first, and one running count over all groups serves the three figures; ties at the edge of the
    top share count in proportion.  A group without both classes has neither average precision nor area.
    """
    d = scored.filter("p IS NOT NULL AND y IS NOT NULL")
    ties = pin(d.groupBy(*keys, (-F.col("p")).alias("_down")).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")))
    size = pin(ties.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sum("pos").alias("positives")))
    lane = Lane(keys=tuple(keys), block=LEDGER.block)
    run = carry_total(index_rows(ties, keys, ("_down",)), sums={"tp": F.col("pos"), "seen": F.col("n")}, lane=lane).join(size, list(keys))
    top = F.greatest(F.bround(F.col("rows") * share), F.lit(1.0))
    neg = F.col("n") - F.col("pos")
    inside = clip((top - (F.col("seen") - F.col("n"))) / F.col("n"), F.lit(0.0), F.lit(1.0))
    sums = run.groupBy(*keys).agg(
        F.first("rows").alias("rows"), F.first("positives").alias("positives"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("_ap"),
        F.sum(neg * (F.col("tp") - F.col("pos") / 2.0)).alias("_auc"), F.sum(F.col("pos") * inside).alias("_top"), F.first(top).alias("_k"))
    pairs = F.col("positives") * (F.col("rows") - F.col("positives"))
    return sums.select(*keys, "rows", "positives", F.when(pairs > 0, safe_div("_ap", "positives")).alias("ap"), safe_div(F.col("_auc"), pairs).alias("auc"), (F.col("_top") / F.col("_k")).alias("topk"))


def label_sweep(base: DataFrame, candidates: Sequence[tuple[str, Mapping]], registry: Mapping[str, Callable], columns: Mapping[str, str],
                scores: Sequence[str], order: Sequence[str], baseline: Sequence[int] = (), folds: int = 4, embargo: int = 2, eps: float = 1e-9,
                min_improvement: float = 0.01, min_votes: int | None = None, min_train: int = 50, min_valid: int = 10) -> DataFrame:
    """One row per (label, parameters) candidate: objective over purged folds, votes of the scores, and the promotion gate.

    Folds are runs of rows by ``order`` over the whole frame; training rows end max(embargo, reach of the label) before a fold.  A fold counts where
    both sides are large enough and hold both classes.  Every score gives each candidate the mean objective of its folds with a 95 % interval
    (without folds: the objective of a score that knows nothing) and votes for the best candidates of the label, within ``eps``.  The best mean
    over the scores is recommended, and promoted when it is not the baseline (the candidates at the places ``baseline``, else the first of a label), improves by
    ``min_improvement``, has ``min_votes`` (all scores) and an interval above the baseline's.

    All candidates are one long table and all figures grouped aggregates over it: the number of jobs does not depend on how many there are.
    """
    votes_needed = len(scores) if min_votes is None else min_votes
    placed = pin(index_rows(base.withColumnRenamed(IDX, "_own"), (), order).withColumnRenamed(IDX, "_at").withColumnRenamed("_own", IDX))
    n = placed.count()
    size = n // (folds + 1)
    table = pin(candidate_table(placed, candidates, registry, columns, ["_at", *scores]).filter("y IS NOT NULL"))

    starts = [n - (folds - k) * size for k in range(folds)]
    per_fold = []
    for k, start in enumerate(starts):
        train = F.col("_at") < F.lit(start) - F.greatest(F.lit(embargo), F.col("reach"))
        valid = (F.col("_at") >= start) & (F.col("_at") < start + size)
        per_fold.append(F.struct(F.lit(k).alias("fold"), *[c.alias(a) for c, a in (
            (F.count_if(train), "train"), (F.count_if(train & (F.col("y") == 1)), "train_pos"), (F.count_if(valid), "valid"), (F.count_if(valid & (F.col("y") == 1)), "valid_pos"))]))
    cells = pin(table.groupBy("label", "candidate", "reach").agg(F.count(F.lit(1)).alias("rows"), F.avg("y").alias("positive_rate"), F.array(*per_fold).alias("cells")))
    usable = cells.select("label", "candidate", "positive_rate", F.inline("cells")).filter(
        f"train >= {min_train} AND valid >= {min_valid} AND train_pos BETWEEN 1 AND train - 1 AND valid_pos BETWEEN 1 AND valid - 1")

    proxies = F.explode(F.array(*[F.struct(F.lit(s).alias("proxy"), F.col(s).cast("double").alias("p")) for s in scores])).alias("s")
    fold = F.floor((F.col("_at") - starts[0]) / max(size, 1)).cast("int").alias("fold")
    long = table.filter(F.col("_at") >= starts[0]).select("label", "candidate", fold, "y", proxies).select("label", "candidate", "fold", "s.proxy", "s.p", "y")
    figures = ranked_scores(long, ("label", "candidate", "proxy", "fold")).select("label", "candidate", "proxy", "fold", "ap", "auc", "topk")
    folded = figures.join(usable.select("label", "candidate", "fold", "positive_rate"), ["label", "candidate", "fold"]).filter("ap IS NOT NULL")
    folded = folded.withColumn("objective", objective(F.col("ap"), F.col("auc"), F.col("topk"), F.col("positive_rate")))
    half = F.coalesce(1.96 * F.stddev_samp("objective") / F.sqrt(F.count("objective")), F.lit(0.0))
    means = folded.groupBy("label", "candidate", "proxy").agg(
        F.count(F.lit(1)).alias("folds"), *[F.avg(c).alias(c) for c in ("ap", "auc", "topk")], F.avg("objective").alias("mean"), half.alias("half"))

    names = F.explode(F.array(*map(F.lit, scores))).alias("proxy")
    blank = objective(F.lit(0.0), F.lit(0.5), F.lit(0.0), F.col("positive_rate"))
    each = cells.select("label", "candidate", "rows", "positive_rate", names).join(means, ["label", "candidate", "proxy"], "left").withColumns(
        {"mean": F.coalesce("mean", blank), "half": F.coalesce("half", F.lit(0.0)), "folds": F.coalesce("folds", F.lit(0))})
    vote = F.max("mean").over(Window.partitionBy("label", "proxy")) - F.col("mean") <= eps
    voted = each.withColumn("vote", flag(vote)).groupBy("label", "candidate", "rows", "positive_rate").agg(
        F.min("folds").alias("folds"), F.avg(F.coalesce("ap", F.lit(0.0))).alias("ap"), F.avg(F.coalesce("auc", F.lit(0.5))).alias("auc"), F.avg(F.coalesce("topk", F.lit(0.0))).alias("topk"),
        F.avg("mean").alias("objective"), F.min(F.col("mean") - F.col("half")).alias("ci_low"), F.max(F.col("mean") + F.col("half")).alias("ci_high"), F.sum("vote").alias("votes"))

    first = {name: i for i, (name, _) in reversed(list(enumerate(candidates)))}
    chosen = [*baseline, *[i for name, i in first.items() if name not in {candidates[b][0] for b in baseline}]]
    texts = F.element_at(F.array(*[F.lit(", ".join(f"{k}={v}" for k, v in params.items() if isinstance(v, (int, float)))) for _, params in candidates]), F.col("candidate") + 1)
    group = Window.partitionBy("label")  # one row per candidate
    best = F.struct("objective", (-F.col("candidate")).alias("c"))
    out = voted.withColumns({"params": texts, "is_baseline": flag(F.col("candidate").isin(chosen)), "recommended": flag(best == F.max(best).over(group))})
    base_of = F.max(F.when(F.col("is_baseline") == 1, F.struct("objective", "ci_high"))).over(group)
    out = out.withColumns({"_base": base_of, "share_of_votes": F.col("votes") / len(scores)}).withColumn("improvement", F.col("objective") - F.col("_base.objective"))
    reason = (
        F.when(F.col("is_baseline") == 1, "recommended_is_baseline").when(F.col("improvement") < min_improvement, "min_improvement_not_met")
        .when(F.col("votes") < votes_needed, "consensus_not_met").when(F.col("ci_low") <= F.col("_base.ci_high"), "ci_delta_not_positive").otherwise("passed"))
    out = out.withColumn("reason", F.when(F.col("recommended") == 1, reason)).withColumn("promoted", F.coalesce(flag(F.col("reason") == "passed"), F.lit(0)))
    return out.drop("_base")


def area_under_roc(df: DataFrame, label: str, score: str) -> float:
    """The built-in evaluator, for comparison with ``binary_metrics``."""
    d = df.select(F.col(label).cast("double").alias("label"), F.col(score).alias("rawPrediction"))
    return BinaryClassificationEvaluator().evaluate(d)
