"""Model data: column rules, splits, hygiene, metrics, calibration, fits."""

from __future__ import annotations

from typing import Iterator, Tuple

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.functions.scalar import log_return
from tickloom.operators import columns as K
from tickloom.operators import features as X
from tickloom.operators import labels as L
from tickloom.operators import mlprep as M
from tickloom.operators.asof import asof
from tickloom.operators.series import framed, index_rows, pin
from tickloom.plans import sqltext as q
from tickloom.plans.features import _FLOW, show
from tickloom.plans.labels import structured
from tickloom.plans.ledger import neat
from tickloom.plans.market import SIGNALS, WITH_LEDGER, WITH_SIGNALS, bars, ledger, signals, with_bars
from tickloom.plans.registry import query
from tickloom.plans.sqltext import W

# ------------------------------------------------------------------ columns


def _frame(spark, d):
    s = signals(spark, d)
    return s.withColumnsRenamed({"atr": "atr_15m", "displacement": "displacement_15m"}).withColumns(
        {"label_eop": F.lit(0), "prob_eop": F.col("p_eop")})


_FRAME = SIGNALS + """, fr AS (SELECT * EXCLUDE (atr, displacement), atr AS atr_15m, displacement AS displacement_15m FROM sig)"""


@query("P1_feature_columns", "WITH " + _FRAME + "\nSELECT id, round(atr_15m, 6) AS atr_15m, round(displacement_15m, 6) AS displacement_15m, "
       "session_bucket, round(session_weight, 6) AS session_weight, round(session_quality_multiplier, 6) AS session_quality_multiplier, "
       "round(evr, 6) AS evr FROM fr")
def feature_columns(spark, d):
    f = _frame(spark, d)
    names = K.feature_names(f, groups=("session",), prefixes=("displacement_15",), contains=("atr",), exact=("evr", "id"))
    return neat(f.select(*names))


@query("P2_timeframe_scope", "WITH " + _FRAME + """
SELECT id, round(displacement_body_pct_1h, 6) AS displacement_body_pct_1h, round(volume_z_1h, 6) AS volume_z_1h, flow_age_bars_1h, flow_ok_1h,
  round(flow_strength_1h, 6) AS flow_strength_1h, round(p_flow_1h, 6) AS p_flow_1h, round(toxicity_12h, 6) AS toxicity_12h, round(p_regime_trend, 6) AS p_regime_trend,
  round(p_regime_expansion, 6) AS p_regime_expansion, round(p_regime_collapse, 6) AS p_regime_collapse, round(p_regime_range, 6) AS p_regime_range FROM fr""")
def scope(spark, d):
    f = _frame(spark, d)
    names = K.in_scope(f.columns, allowed=("1h", "6h", "12h"), unsuffixed=False, unsuffixed_exact=("id",), unsuffixed_prefixes=("p_regime_",),
                       prefixes={"6h": ("compression_",), "12h": ("toxicity",)})
    return neat(f.select(*names))


@query("P3_without_model_outputs", "WITH " + _FRAME + """
SELECT id, round(p_trend_up, 6) AS p_trend_up, round(p_regime_trend, 6) AS p_regime_trend, round(evr, 6) AS evr FROM fr""")
def no_outputs(spark, d):
    f = _frame(spark, d).select("id", "p_trend_up", "p_regime_trend", "p_flow_1h", "p_liq_flow", "prob_meta", "hazard_score", "q05", "label_eop", "evr")
    return neat(f.select(*[c for c in f.columns if not K.is_model_output(c)]))


@query("P4_first_usable", WITH_SIGNALS + """
SELECT id, round(coalesce(atr, zone_score_6h, 0), 6) AS per_row, round(coalesce(toxicity_12h, 0), 6) AS per_column FROM sig""")
def first_usable(spark, d):
    s = signals(spark, d).withColumn("empty", F.lit(None).cast("double"))
    return neat(s.select("id", F.coalesce("atr", "zone_score_6h", F.lit(0.0)).alias("per_row"),
                         K.first_usable(s, ("absent", "empty", "toxicity_12h", "atr")).alias("per_column")))


@query("P5_text_and_flags", """SELECT o_orderkey AS id, CASE WHEN lower(trim(o_orderpriority)) IN ('1', 'true', 'yes', 'up', 'down', 'long', 'short') OR
  coalesce(TRY_CAST(trim(split_part(o_orderpriority, '-', 1)) AS DOUBLE), 0) <> 0 AND false THEN 1 ELSE 0 END AS flag_text,
  CASE WHEN o_custkey % 4 <> 0 THEN 1 ELSE 0 END AS flag_number, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'UP' END AS bias FROM orders""")
def text_and_flags(spark, d):
    from tickloom.functions.scalar import first_text, truthy
    from tickloom.plans.market import table

    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.lit(" nan ")).otherwise(F.lit(" up"))
    return neat(o.select(k.alias("id"), truthy("o_orderpriority").cast("int").alias("flag_text"),
                         truthy(F.col("o_custkey") % 4, "bigint").cast("int").alias("flag_number"), first_text(raw, "o_orderstatus").alias("bias")))


@query("P7_complete_rows", WITH_SIGNALS + "\nSELECT id, round(atr, 6) AS atr FROM sig WHERE atr IS NOT NULL AND zone_score_6h IS NOT NULL AND close IS NOT NULL")
def complete(spark, d):
    return neat(signals(spark, d).dropna(subset=["atr", "zone_score_6h", "close"]).select("id", "atr"))


@query("P15_topic_maps", WITH_SIGNALS + """
SELECT id, 7 + CASE WHEN flow_ok_1h IS NULL THEN 0 ELSE 1 END - CASE WHEN flow_age_bars_1h IS NULL THEN 1 ELSE 0 END - CASE WHEN p_flow_1h IS NULL THEN 1 ELSE 0 END + 2 AS momentum,
  3 + CASE WHEN toxicity_12h IS NULL THEN 0 ELSE 1 END + CASE WHEN p_trend_up IS NULL THEN 0 ELSE 2 END + 1 AS regime FROM sig""")
def topics(spark, d):
    s = signals(spark, d).drop("session_quality_multiplier")
    maps = K.topic_map(s)
    return neat(s.select("id", F.size(maps["momentum"]).alias("momentum"), F.size(maps["regime"]).alias("regime")))


@query("F24_name_parsing", WITH_SIGNALS + """
SELECT id, concat_ws(' | ', asset, side, coalesce(session_bucket, 'na')) AS label, CASE WHEN starts_with(asset, 'C1') THEN 1 ELSE 0 END AS starts,
  CASE WHEN contains(lower(coalesce(structural_bias_6h, '')), 'up') THEN 1 ELSE 0 END AS has_up, regexp_extract('zone_score_' || CASE WHEN id % 2 = 0 THEN '6h' ELSE '12h' END, '_(15m|1h|6h|12h)$', 1) AS tf FROM sig""")
def names(spark, d):
    s = signals(spark, d)
    name = F.concat(F.lit("zone_score_"), F.when(F.col("id") % 2 == 0, "6h").otherwise("12h"))
    return neat(s.select(
        "id", F.concat_ws(" | ", "asset", "side", F.coalesce("session_bucket", F.lit("na"))).alias("label"),
        F.col("asset").startswith("C1").cast("int").alias("starts"),
        F.lower(F.coalesce("structural_bias_6h", F.lit(""))).contains("up").cast("int").alias("has_up"),
        F.regexp_extract(name, "_(15m|1h|6h|12h)$", 1).alias("tf")))


# ------------------------------------------------------------------ splits

@query("P11_trimmed_history", with_bars("1h") + """
SELECT asset, t, c AS close FROM (SELECT *, max(i) OVER (PARTITION BY asset) AS n FROM b_1h) WHERE i >= 48 AND i <= n - 12""")
def trimmed(spark, d):
    return show(M.trim_history(bars(spark, d, "1h"), 48, 12), ["close"])


@query("P12_walk_forward_split", with_bars("1h") + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS part, count(*) AS bars, min(t) AS first_t, max(t) AS last_t FROM b_1h WHERE {c}"
    for n, c in (("train", "t <= 1705276800"), ("valid", "t >= 1705276800 AND t <= 1705881600"))))
def walk_forward(spark, d):
    train, valid = M.split_at(bars(spark, d, "1h"), "2024-01-15 00:00:00", "2024-01-22 00:00:00")
    both = train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))
    t = F.unix_seconds("bar_close")
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("bars"), F.min(t).alias("first_t"), F.max(t).alias("last_t"))


@query("P13_purged_folds", WITH_LEDGER + """,
p AS (SELECT trade_id, row_number() OVER (ORDER BY entry_ts, trade_id) - 1 AS i, count(*) OVER () AS n FROM led),
f AS (SELECT k AS fold, n // 5 AS sz, n - (4 - k) * (n // 5) AS st FROM (SELECT DISTINCT n FROM p), range(4) t(k))
SELECT fold, CASE WHEN i < st - 12 THEN 'train' ELSE 'valid' END AS role, count(*) AS trades, min(i) AS first_i, max(i) AS last_i
FROM p, f WHERE i < st - 12 OR (i >= st AND i < st + sz) GROUP BY 1, 2""")
def folds(spark, d):
    rows = index_rows(ledger(spark, d).select("entry_ts", "trade_id"), (), ("entry_ts", "trade_id"))
    return neat(M.purged_folds(rows, 4, 2, 12).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("trades"), F.min("row_idx").alias("first_i"), F.max("row_idx").alias("last_i")))


@query("W39_lag_design_matrix", with_bars("1h") + f""",
x AS (SELECT *, ln(c / lag(c) OVER {W}) AS r FROM b_1h),
y AS (SELECT asset, t, {', '.join(f'lag(r, {n}) OVER {W} AS ar_{n}' for n in (1, 2, 3))}, {', '.join(f'lag(v, {n}) OVER {W} AS ex_{n}' for n in (1, 2))}, lead(r) OVER {W} AS target FROM x)
SELECT asset, t, {q.rounded('ar_1', 'ar_2', 'ar_3', 'ex_1', 'ex_2', 'target')} FROM y WHERE ar_3 IS NOT NULL AND ex_2 IS NOT NULL AND target IS NOT NULL""")
def design(spark, d):
    def build(rows, w):
        rows = rows.withColumn("r", log_return("close", w))
        lag = {f"ar_{n}": F.lag("r", n).over(w) for n in (1, 2, 3)} | {f"ex_{n}": F.lag("volume", n).over(w) for n in (1, 2)}
        return rows.withColumns({**lag, "target": F.lead("r").over(w)})

    cols = ["ar_1", "ar_2", "ar_3", "ex_1", "ex_2", "target"]
    return show(framed(bars(spark, d, "1h"), build, back=5, ahead=2).dropna(subset=cols), cols)


@query("W40_sequence_windows", with_bars("1h") + f""",
s AS (SELECT asset, t, i, list(c) OVER {q.frame(16)} AS cs, list(v) OVER {q.frame(16)} AS vs FROM b_1h)
SELECT asset, t, len(cs) AS steps, round(list_sum(cs), 4) AS close_sum, round(list_sum(vs), 4) AS volume_sum, cs[1] AS first_close FROM s WHERE len(cs) = 16""")
def sequences(spark, d):
    def build(rows, w):
        return rows.withColumn("seq", F.collect_list(F.array("close", "volume")).over(w.rowsBetween(-15, 0)))

    out = framed(bars(spark, d, "1h"), build, back=15).filter(F.size("seq") == 16)

    def total(i):
        return F.aggregate("seq", F.lit(0.0), lambda a, x: a + x[i])

    return show(out.withColumns({"steps": F.size("seq"), "close_sum": F.round(total(0), 4), "volume_sum": F.round(total(1), 4),
                                 "first_close": F.col("seq")[0][0]}), ["steps", "close_sum", "volume_sum", "first_close"])


# ------------------------------------------------------------------ hygiene and metrics

_NUM = ("atr", "zone_score_6h", "toxicity_12h", "flow_ok_1h", "p_trend_up", "volume_z_1h", "hazard_score", "legs")


@query("A23_column_profile", WITH_SIGNALS + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 6) AS missing, count(DISTINCT {c}) AS \"distinct\" FROM sig" for c in _NUM))
def profile(spark, d):
    return neat(M.profile(signals(spark, d), _NUM))


@query("A24_duplicate_columns", """SELECT 'twin' AS "column", 'hazard_score' AS same_as, count(*) AS rows FROM orders""")
def duplicates(spark, d):
    s = signals(spark, d).withColumns({"twin": F.col("hazard_score"), "near": F.col("hazard_score") + F.when(F.col("id") == 7, 1.0).otherwise(0.0)})
    pairs = M.duplicate_columns(s, ("hazard_score", "near", "twin", "atr"), F.col("id"))
    found = F.array(*[F.struct(F.lit(a).alias("column"), F.lit(b).alias("same_as")) for a, b in pairs])
    return s.select(F.explode(found).alias("p")).select("p.*").groupBy("column", "same_as").agg(F.count(F.lit(1)).alias("rows"))


_CORR = ("atr", "zone_score_6h", "close", "p_trend_up", "p_trend_down", "equity")


@query("A21_feature_correlations", WITH_SIGNALS + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS rows, round(corr({a}, {b}), 6) AS corr FROM sig"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]))
def correlations(spark, d):
    return neat(M.correlations(signals(spark, d), _CORR))


@query("A21_asset_correlations", with_bars("1h") + f""",
r AS (SELECT asset, t, c / lag(c) OVER {W} - 1 AS ret FROM b_1h),
p AS (SELECT a.asset AS a, b.asset AS b, count(*) AS rows, corr(a.ret, b.ret) AS c FROM r a JOIN r b ON a.t = b.t AND a.asset < b.asset
  WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2)
SELECT a, b, rows, CASE WHEN rows >= 50 THEN round(c, 6) END AS corr FROM p""")
def asset_correlations(spark, d):
    from tickloom.functions.scalar import pct_change

    r = framed(bars(spark, d, "1h"), lambda rows, w: rows.withColumn("ret", pct_change("close", w)), back=1)
    return neat(M.asset_correlations(r.select("asset", "bar_close", "ret")))


@query("M2_feature_hygiene", WITH_SIGNALS + """
SELECT count(*) AS rows, 'equity,hazard_score,p_trend_up,volume_z_1h,zone_score_6h' AS kept FROM sig""")
def hygiene(spark, d):
    s = signals(spark, d).withColumns({"const": F.lit(1.0), "twin": F.col("hazard_score"), "sparse": F.when(F.col("id") % 2 == 0, F.col("evr"))})
    left = M.hygiene(s, ("equity", "hazard_score", "p_trend_up", "volume_z_1h", "zone_score_6h", "p_trend_down", "const", "twin", "sparse"),
                     F.col("id"), floor=2)
    return s.agg(F.count(F.lit(1)).alias("rows")).withColumn("kept", F.lit(",".join(sorted(left))))


_Y = "CASE WHEN (id * 7 + CAST(round(hazard_score * 60) AS BIGINT)) % 5 < 1 OR confluence_score > 0.8 THEN 1 ELSE 0 END"


def labelled(spark, d):
    return signals(spark, d).withColumn("y", F.expr(_Y))


_WITH_Y = WITH_SIGNALS + f", ly AS (SELECT *, {_Y} AS y FROM sig)"


@query("A25_class_weights", _WITH_Y + """
SELECT sum(y)::BIGINT AS pos, (count(*) - sum(y))::BIGINT AS neg, round((count(*) - sum(y)) / sum(y), 6) AS scale_pos_weight, round(count(*) / (2.0 * (count(*) - sum(y))), 6) AS weight_0,
  round(count(*) / (2.0 * sum(y)), 6) AS weight_1 FROM ly""")
def class_weights(spark, d):
    return neat(M.class_balance(labelled(spark, d), "y"))


@query("A26_binary_metrics", _WITH_Y + """,
s AS (SELECT least(1 - 1e-6, greatest(1e-6, confluence_score)) AS p, y FROM ly),
g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen FROM g),
m AS (SELECT sum(pos * tp / seen) / sum(pos) AS ap, sum((n - pos) * (tp - pos + pos / 2.0)) / (sum(pos) * sum(n - pos)) AS auc FROM c),
z AS (SELECT count(*) AS rows, avg((p - y) * (p - y)) AS brier, count(*) FILTER (p >= 0.5 AND y = 1) AS hit, count(*) FILTER (p >= 0.5) AS fl, sum(y) AS ps FROM s)
SELECT rows, round(ap, 6) AS ap, round(auc, 6) AS auc, round(brier, 6) AS brier, round(hit / fl, 6) AS precision, round(hit / ps, 6) AS recall,
  round(2.0 * (hit / fl) * (hit / ps) / (hit / fl + hit / ps), 6) AS f1, round(fl / rows, 6) AS positive_rate FROM m, z""")
def binary_metrics(spark, d):
    return neat(M.binary_metrics(labelled(spark, d), "y", "confluence_score"))


_CUTS = WITH_SIGNALS + f""", ly AS (SELECT least(1 - 1e-6, greatest(1e-6, confluence_score)) AS p, {_Y} AS y FROM sig),
cu AS (SELECT DISTINCT least(1 - 1e-4, greatest(1e-4, p)) AS threshold FROM ly UNION SELECT 0.5::DOUBLE),
tb AS (SELECT threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold) AS fl, sum(y) AS ps FROM cu, ly GROUP BY 1),
t2 AS (SELECT threshold, tp, fl AS flagged, coalesce(tp / nullif(fl, 0), 0) AS pr, tp / ps AS rc FROM tb),
t3 AS (SELECT *, coalesce(2.0 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM t2)"""


@query("A27_threshold_sweep", _CUTS + "\nSELECT round(threshold, 8) AS threshold, tp, flagged, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM t3")
def sweep(spark, d):
    return neat(M.threshold_table(labelled(spark, d), "y", "confluence_score"), threshold=8)


@query("A27_best_threshold", _CUTS + """
SELECT round(arg_max(threshold, (f1, -threshold)), 8) AS threshold, round(max(f1), 6) AS best_value FROM t3 WHERE pr >= 0.25 AND rc >= 0.05""")
def best(spark, d):
    t = M.threshold_table(labelled(spark, d), "y", "confluence_score")
    return neat(M.best_threshold(t, min_precision=0.25, min_recall=0.05), threshold=8)


@query("A28_top_share_precision", _WITH_Y + """,
r AS (SELECT y, row_number() OVER (ORDER BY confluence_score DESC, id) AS k, count(*) OVER () AS n FROM ly)
SELECT count(*) AS rows, round(avg(y), 6) AS precision_at_top FROM r WHERE k <= round(n * 0.1)""")
def top_share(spark, d):
    return neat(M.top_share_precision(labelled(spark, d), "y", "confluence_score", 0.10, "id"))


@query("A29_histogram_calibration", _WITH_Y + """,
b AS (SELECT *, least(14, greatest(0, floor(confluence_score * 15 + 1e-12)::INT)) AS bin FROM ly),
m AS (SELECT bin, avg(y) AS m FROM b GROUP BY 1)
SELECT id, round(m, 6) AS calibrated FROM b JOIN m USING (bin)""")
def calibrated(spark, d):
    s = labelled(spark, d)
    return neat(M.histogram_calibrated(s, s, "y", "confluence_score").select("id", "calibrated"))


@query("A29_calibration_choice")
def calibration_choice(spark, d):
    return neat(M.choose_calibration(labelled(spark, d), "y", "confluence_score"))


@query("A30_winsorised", WITH_SIGNALS + """,
e AS (SELECT quantile_cont(evr, 0.05) AS a, quantile_cont(evr, 0.95) AS b, quantile_cont(close, 0.05) AS c, quantile_cont(close, 0.95) AS d FROM sig WHERE id % 3 <> 0)
SELECT id, round(least(b, greatest(a, evr)), 6) AS evr, round(least(d, greatest(c, close)), 6) AS close FROM sig, e""")
def winsorised(spark, d):
    s = signals(spark, d)
    bounds = M.winsor_bounds(s.filter(F.col("id") % 3 != 0), ("evr", "close"), 0.05, 0.95)
    return neat(M.winsorise(s, bounds).select("id", "evr", "close"))


@query("A34_label_summary", WITH_LEDGER + """, s AS (SELECT CASE tier WHEN '5-LOW' THEN -1 ELSE CAST(substr(tier, 1, 1) AS INT) END AS state FROM led)
SELECT state, count(*) AS rows, round(count(*) / (SELECT count(*) FROM s), 6) AS share, round((SELECT count(*) FROM s WHERE state = -1) / (SELECT count(*) FROM s), 6) AS noise_share FROM s GROUP BY 1""")
def label_summary(spark, d):
    s = ledger(spark, d).select(F.when(F.col("tier") == "5-LOW", -1).otherwise(F.substring("tier", 1, 1).cast("int")).alias("state"))
    return neat(M.label_summary(s))


@query("A35_regime_names", WITH_SIGNALS + """,
m AS (SELECT legs AS state, count(*) AS rows, avg(p_trend_up) AS vol, avg(p_eop) AS trend, avg(volume_z_1h - 1.2) AS comp FROM sig GROUP BY 1)
SELECT state, rows, round(vol, 6) AS vol, round(trend, 6) AS trend, round(comp, 6) AS comp, CASE WHEN vol > 0.66 AND trend > 0.55 THEN 'trend' WHEN vol > 0.66 THEN 'expansion'
  WHEN comp < -0.05 THEN 'collapse' ELSE 'range' END AS regime FROM m""")
def regime_names(spark, d):
    s = signals(spark, d).select(F.col("legs").alias("state"), F.col("p_trend_up").alias("vol_pct"), F.col("p_eop").alias("trend_persist"),
                                 (F.col("volume_z_1h") - 1.2).alias("compression_12h"))
    return neat(M.regime_names(s))


@query("F29_pinball_and_objective", WITH_SIGNALS + """
SELECT asset, round(avg(greatest(0.1 * (evr - q05), -0.9 * (evr - q05))), 6) AS pinball_10, round(avg(greatest(0.9 * (evr - q05), -0.1 * (evr - q05))), 6) AS pinball_90,
  round(0.55 * avg(p_eop) + 0.15 * greatest(avg(p_edp) - 0.4, 0) + 0.10 * least(avg(bos_flag) / 0.05, 1, (1 - avg(bos_flag)) / 0.5) + 0.2 * avg(p_momo), 6) AS objective FROM sig GROUP BY 1""")
def pinball(spark, d):
    s = signals(spark, d)
    return neat(s.groupBy("asset").agg(
        M.pinball(s, "evr", "q05", 0.1).alias("pinball_10"), M.pinball(s, "evr", "q05", 0.9).alias("pinball_90"),
        M.objective(F.avg("p_eop"), F.avg("p_edp") + 0.1, F.avg("p_momo"), F.avg("bos_flag")).alias("objective")))


# ------------------------------------------------------------------ fits

_INPUTS = ("atr", "zone_score_6h", "toxicity_12h", "volume_z_1h", "hazard_score", "confluence_score")


@query("M1_preprocessing", WITH_SIGNALS + """,
md AS (SELECT *, quantile_disc(atr, 0.5) OVER () AS q FROM sig), a AS (SELECT id, hazard_score AS h FROM sig)
SELECT count(*) AS rows, round(avg((h - m) / sd), 6) + 0.0 AS mean_scaled, round(stddev_samp((h - m) / sd), 6) AS sd_scaled, 9 AS width
FROM a, (SELECT avg(h) AS m, stddev_samp(h) AS sd FROM a)""")
def preprocessing(spark, d):
    from pyspark.ml.functions import vector_to_array

    s = signals(spark, d)
    out = M.preprocessing(("atr", "zone_score_6h", "hazard_score"), ("asset",)).fit(s).transform(s)
    v = vector_to_array("features")
    got = out.select(v[2].alias("h"), F.size(v).alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("h").alias("mean_scaled"), F.stddev_samp("h").alias("sd_scaled"), F.max("w").alias("width"))
    return neat(got.withColumn("mean_scaled", F.round("mean_scaled", 6) + 0.0))


def _mi_sql():
    parts = []
    for c in ("confluence_score", "hazard_score"):
        e = f"(SELECT list_sort(list_distinct(quantile_cont({c}, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM ly)"
        parts.append(f"SELECT '{c}' AS col, len(list_filter(list_slice(e, 2, len(e) - 1), lambda z: z < {c})) AS bin, y FROM ly, {e}")
    return _WITH_Y + f""", cells AS ({' UNION ALL '.join(parts)}),
n AS (SELECT col, bin, y, count(*) AS n FROM cells GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY col, bin) AS nb, sum(n) OVER (PARTITION BY col, y) AS ny, sum(n) OVER (PARTITION BY col) AS nt FROM n)
SELECT col AS "column", round(sum(n / nt * ln(n * nt / (nb * ny))), 6) AS mi FROM w GROUP BY 1"""


@query("M3_mutual_information", _mi_sql())
def mutual_information(spark, d):
    return neat(M.mutual_information(labelled(spark, d), ("confluence_score", "hazard_score"), "y"))


@query("K8_top_features", _mi_sql().replace("SELECT col AS", "SELECT col AS", 1) + " ORDER BY mi DESC LIMIT 1")
def top_features(spark, d):
    return neat(M.mutual_information(labelled(spark, d), ("confluence_score", "hazard_score"), "y").orderBy(F.desc("mi")).limit(1))


def _folds(spark, d, keep):
    rows = index_rows(labelled(spark, d).select("ts", "id", "y", *keep), (), ("ts", "id"))
    return pin(M.purged_folds(rows, 3, 2, 12))


@query("M4_specialist_folds")
def specialists(spark, d):
    scored = M.out_of_fold(_folds(spark, d, _INPUTS), _INPUTS, "y", "p")
    return neat(M.fold_metrics(pin(scored), "y", "p"))


@query("M5_stacked_scores")
def stacked(spark, d):
    out = M.stacked(_folds(spark, d, _INPUTS), {"price": ("atr", "volume_z_1h"), "quality": ("hazard_score", "confluence_score")}, "y")
    return neat(out.select("fold", "id", "y", "prob_price", "prob_quality", "prob_meta"))


@query("M6_hazard_periods", WITH_SIGNALS + """
SELECT id, p AS period, CASE WHEN bos_flag = 1 AND p = legs + 1 THEN 1.0::DOUBLE ELSE 0.0 END AS failed FROM (SELECT id, bos_flag, legs, unnest(range(1, legs + 2)) AS p FROM sig)""")
def periods(spark, d):
    s = signals(spark, d).select("id", F.col("bos_flag").alias("hazard_event"), (F.col("legs") + 1).cast("int").alias("hazard_time"))
    return neat(M.person_periods(s).select("id", "period", "failed"))


@query("M6_hazard_curves")
def curves(spark, d):
    s = signals(spark, d).withColumns({"hazard_event": F.col("bos_flag"), "hazard_time": (F.col("legs") + 1).cast("int")})
    model = M.hazard_model(s, ("hazard_score", "evr"))
    out = M.hazard_curves(model, s, (1, 2, 3, 4, 5), "id")
    from tickloom.operators.screen import hazard_from_curve

    return out.select("id", F.size("hazard_curve").alias("bars"), F.round(hazard_from_curve("hazard_curve"), 4).alias("hazard_score"))


@query("M7_conditional_quantiles", WITH_LEDGER + " " + " UNION ALL ".join(
    f"SELECT session, regime, {x}::DOUBLE AS q, round(quantile_cont(r, {x}), 6) AS value FROM led GROUP BY 1, 2" for x in (0.05, 0.1, 0.5, 0.9, 0.95)))
def conditional(spark, d):
    return neat(M.conditional_quantiles(ledger(spark, d), "r", ("session", "regime")))


@query("M8_batch_scoring")
def scoring(spark, d):
    s = labelled(spark, d)
    model = M.classifier(_INPUTS, "y").fit(s.filter(F.col("id") % 2 == 0))
    return neat(M.probability(model, s, "p").select("id", "y", "p"), 4)


#: Candidates of every label; the first of each is its baseline.
SWEEPS = [
    *[("liq_flow", {"horizon": h}) for h in (12, 8, 16, 24)],
    *[("bos_cont", {"horizon": h}) for h in (48, 24, 36, 64, 72)],
    *[("momo", {"first": a, "last": b}) for a, b in ((4, 8), (4, 6), (6, 10), (8, 12))],
    *[("flow_1h", {"first": a, "last": b}) for a, b in ((4, 12), (4, 8), (6, 12), (6, 16))],
    *[("eop", {"horizon": h}) for h in (96, 48, 72, 120, 144)],
    *[("edp", {"horizon": h}) for h in (96, 48, 72, 120, 144)],
    *[("hazard", {"horizon": h}) for h in (48, 24, 36, 64, 72)],
]
PROXIES = ["tilt", "drive", "reach_up"]


def _swept(spark, d):
    """15m bars with structure and closed 1h flow, and three scores that need no fit."""
    flow = X.flow_block(bars(spark, d, "1h")).select(
        "asset", "bar_close", F.col("flow_signal").alias("flow_signal_1h"), F.col("flow_body_pct").alias("displacement_body_pct_1h"),
        F.col("flow_volume_z").alias("volume_z_1h"), F.col("flow_age_bars").alias("flow_age_bars_1h"))
    b = asof(structured(spark, d), pin(flow))
    rng = F.col("high") - F.col("low")
    return b.withColumns({
        "tilt": F.coalesce(F.try_divide(F.col("close") - F.col("low"), rng), F.lit(0.5)),
        "drive": F.coalesce(F.try_divide(F.col("close") - F.col("open"), F.col("atr")), F.lit(0.0)),
        "reach_up": F.coalesce(F.try_divide(rng, F.col("atr")), F.lit(0.0)),
        "spot": (F.col("close") > F.col("high") - 0.2 * rng) & (rng > 1.5 * F.col("atr")),
    })


@query("M9_label_sweep")
def label_sweep(spark, d):
    registry = {**L.LABELS, "eop": lambda df, horizon: L.opportunity(df, F.col("spot"), horizon)}
    return neat(M.label_sweep(_swept(spark, d), SWEEPS, registry, L.LABEL_COLUMNS, PROXIES, ("bar_close", "asset")))


@query("J12_label_candidates", with_bars("1h") + ", " + q.true_range("b_1h", "a") + " " + " UNION ALL ".join(
    f"SELECT {h} AS horizon, {r}::DOUBLE AS drop_r, sum(CASE WHEN atr > 0 AND c > 0 AND ml <= c - {r} * atr THEN 1 ELSE 0 END)::BIGINT AS positives, count(*) AS bars "
    f"FROM (SELECT *, min(l) OVER {q.ahead(1, h)} AS ml FROM a)" for h in (12, 24, 48) for r in (2.0, 3.0)))
def candidates(spark, d):
    # one column set per candidate over the same blocks: the bars are read and sorted once
    cands = [(h, r) for h in (12, 24, 48) for r in (2.0, 3.0)]

    def build(rows, w):
        out = {}
        for h, r in cands:
            worst = F.min("low").over(w.rowsBetween(1, h))
            hit = (F.col("atr") > 0) & (F.col("close") > 0) & (worst <= F.col("close") - r * F.col("atr"))
            out[f"y_{h}_{int(r)}"] = F.coalesce(hit, F.lit(False)).cast("int")
        return rows.withColumns(out)

    b = framed(X.atr(bars(spark, d, "1h")), build, ahead=48)
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(r).alias("drop_r"), F.col(f"y_{h}_{int(r)}").alias("y")) for h, r in cands])
    return neat(b.select(F.explode(cells).alias("c")).select("c.*").groupBy("horizon", "drop_r").agg(
        F.sum("y").alias("positives"), F.count(F.lit(1)).alias("bars")))


@query("M10_permutation_audit")
def permutation(spark, d):
    s = pin(labelled(spark, d).select("id", "y", *_INPUTS).withColumn("held_out", F.pmod(F.xxhash64("id"), F.lit(4)) == 0))
    model = M.classifier(_INPUTS, "y").fit(s.filter("NOT held_out"))
    rows = [(c, *M.permutation_drop(model, s.filter("held_out"), c, "y", "id")) for c in _INPUTS]
    t = spark.createDataFrame(rows, "column string, ap double, ap_shuffled double")
    return neat(t.withColumn("drop", F.col("ap") - F.col("ap_shuffled")), 4)


@query("M11_regime_clusters")
def clusters(spark, d):
    x = X.regime_inputs(X.volatility(bars(spark, d, "1h"), with_lags=False), rank=50)
    inputs = ("vol_pct", "trend_persist", "compression_12h", "toxicity_12h")
    out = M.clusters(pin(M.filled_and_clipped(x, inputs)), inputs, k=3)
    return neat(M.regime_names(out), 4)


@query("M12_acceptance_gate", WITH_SIGNALS.replace("sig AS", "sig AS") + f""", ly AS (SELECT *, {_Y} AS y FROM sig),
r AS (SELECT *, row_number() OVER (ORDER BY ts, id) AS k, count(*) OVER () AS n FROM ly),
s AS (SELECT least(1 - 1e-6, greatest(1e-6, confluence_score)) AS p, y FROM r WHERE k > n - n // 5),
g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen FROM g)
SELECT (SELECT count(*) FROM s) AS rows, round(sum(pos * tp / seen) / sum(pos), 6) AS ap,
  CASE WHEN 0.9 - sum(pos * tp / seen) / sum(pos) > 0.05 THEN 'acceptance_drop_exceeds_tolerance' ELSE '' END AS reasons, CASE WHEN 0.9 - sum(pos * tp / seen) / sum(pos) > 0.05 THEN 0 ELSE 1 END AS accepted FROM c""")
def gate(spark, d):
    rows = index_rows(labelled(spark, d).select("ts", "id", "y", "confluence_score"), (), ("ts", "id"))
    n = rows.count()
    tail = rows.filter(F.col("row_idx") >= n - n // 5)
    return neat(M.acceptance(M.binary_metrics(tail, "y", "confluence_score"), cv_score=0.9).select("rows", "ap", "reasons", "accepted"))


@query("X1_rolling_lambda", with_bars("1h") + f"""
SELECT asset, t, round(list_max(list(c) OVER {q.frame(10)}) - list_min(list(c) OVER {q.frame(10)}), 6) AS spread, len(list_distinct(list(CAST(floor(c) AS BIGINT)) OVER {q.frame(10)})) AS levels FROM b_1h""")
def rolling_lambda(spark, d):
    """Any function of the rows of a frame: higher-order functions over the collected frame."""
    def build(rows, w):
        f = F.collect_list("close").over(w.rowsBetween(-9, 0))
        return rows.withColumns({"spread": F.array_max(f) - F.array_min(f),
                                 "levels": F.size(F.array_distinct(F.transform(f, lambda v: F.floor(v))))})

    return show(framed(bars(spark, d, "1h"), build, back=9), ["spread", "levels"])


@query("X2_group_aggregates", WITH_LEDGER + """
SELECT tier, leg, count(*) FILTER (pnl > 0) AS wins, round(sum(CASE WHEN r > 1 THEN pnl END), 2) AS big_pnl, round(max(pnl) FILTER (session = 'ny'), 2) AS best_ny FROM led GROUP BY 1, 2""")
def group_aggregates(spark, d):
    g = ledger(spark, d).groupBy("tier", "leg").agg(
        F.count_if(F.col("pnl") > 0).alias("wins"), F.sum(F.when(F.col("r") > 1, F.col("pnl"))).alias("big_pnl"),
        F.max(F.when(F.col("session") == "ny", F.col("pnl"))).alias("best_ny"))
    return neat(g, 2)


@query("X3_label_registry", with_bars("1h") + ", " + q.true_range("b_1h", "a") + f"""
SELECT asset, t, CASE WHEN atr > 0 AND c > 0 AND min(l) OVER {q.ahead(1, 24)} <= c - 3.0 * atr THEN 1 ELSE 0 END AS label_edp FROM a""")
def registry(spark, d):
    return show(L.LABELS["edp"](X.atr(bars(spark, d, "1h")), horizon=24), ["label_edp"])


@query("X4_plugged_predictor", WITH_SIGNALS + """
SELECT id, round(1 / (1 + exp(-(0.8 * hazard_score - 0.5 * evr + 0.1))), 6) AS p FROM sig""")
def predictor(spark, d):
    """An external model: an iterator pandas UDF that builds the model once per worker."""
    @F.pandas_udf("double")
    def predict(batches: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weights = np.array([0.8, -0.5])  # stands for loading the model
        for hazard, evr in batches:
            yield pd.Series(1.0 / (1.0 + np.exp(-(np.column_stack([hazard, evr]) @ weights + 0.1))))

    return neat(signals(spark, d).select("id", predict("hazard_score", "evr").alias("p")))


@query("M3_flow_information", with_bars("1h") + ", " + _FLOW + f""",
z AS (SELECT *, CASE WHEN lead(c) OVER {W} > c THEN 1 ELSE 0 END AS y FROM flow), e AS (SELECT list_sort(list_distinct(quantile_cont(st, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM z),
cells AS (SELECT len(list_filter(list_slice(e, 2, len(e) - 1), lambda k: k < st)) AS bin, y FROM z, e), n AS (SELECT bin, y, count(*) AS n FROM cells GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY bin) AS nb, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS nt FROM n)
SELECT 'flow_strength' AS "column", round(sum(n / nt * ln(n * nt / (nb * ny))), 6) AS mi FROM w""")
def flow_information(spark, d):
    x = framed(X.flow_block(bars(spark, d, "1h")), lambda rows, w: rows.withColumn(
        "y", F.coalesce(F.lead("close").over(w) > F.col("close"), F.lit(False)).cast("int")), ahead=1)
    return neat(M.mutual_information(pin(x.select("flow_strength", "y")), ("flow_strength",), "y"))
