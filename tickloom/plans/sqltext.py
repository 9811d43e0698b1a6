"""Small pieces of SQL text for the statements that restate a query's result.

``b`` relations have columns asset, t, o, h, l, c, v, dv and the row position i.
"""

from __future__ import annotations


def frame(n: int, shift: int = 0) -> str:
    end = f"{shift} PRECEDING" if shift else "CURRENT ROW"
    return f"(PARTITION BY asset ORDER BY i ROWS BETWEEN {n - 1 + shift} PRECEDING AND {end})"


W = "(PARTITION BY asset ORDER BY i)"
SO_FAR = "(PARTITION BY asset ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def ahead(first: int, last: int) -> str:
    return f"(PARTITION BY asset ORDER BY i ROWS BETWEEN {first} FOLLOWING AND {last} FOLLOWING)"


def roll(fn: str, x: str, n: int, minp: int | None = None, shift: int = 0) -> str:
    call = fn.replace("$x", x) if "$x" in fn else f"{fn}({x})"
    return (f"CASE WHEN count({x}) OVER {frame(n, shift)} >= {n if minp is None else minp} "
            f"THEN {call} OVER {frame(n, shift)} END")


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def zscore(x: str, n: int, minp: int | None = None, std: str = "stddev_samp") -> str:
    return div(f"{x} - {roll('avg', x, n, minp)}", roll(std, x, n, minp))


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {W}"


def rounded(*cols: str, n: int = 6) -> str:
    return ", ".join(f"round({c}, {n}) AS {c}" for c in cols)


def true_range(rel: str, name: str) -> str:
    """CTE ``name``: ``rel`` plus true range and the 14-bar averages (full and early)."""
    return f"""{name}_tr AS (SELECT *, greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')})) AS tr FROM {rel}),
{name} AS (SELECT *, {roll('avg', 'tr', 14)} AS atr, {roll('avg', 'tr', 14, 1)} AS atr_early FROM {name}_tr)"""


def volatility(rel: str, name: str) -> str:
    return f"""{name}_0 AS (SELECT *, greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')})) AS tr,
  {div('c - ' + lag('c'), lag('c'))} AS ret, {div('h - l', 'c')} AS rg FROM {rel}),
{name}_1 AS (SELECT *, {roll('avg', 'tr', 14)} AS atr, {roll('stddev_samp', 'ret', 30)} AS realized_vol,
  {roll('avg', 'rg', 40)} AS range_pct FROM {name}_0),
{name}_2 AS (SELECT *, {div('atr - ' + lag('atr'), lag('atr'))} AS step, {zscore('realized_vol', 200)} AS vol_zscore
  FROM {name}_1),
{name} AS (SELECT *, {roll('avg', 'step', 20)} AS atr_slope FROM {name}_2)"""


def ema(rel: str, x: str, spans: dict[str, int], name: str) -> str:
    """CTE ``name``: recursive averages by folding the list of values so far."""
    parts = []
    for col, span in spans.items():
        a = 2.0 / (span + 1.0)
        parts.append(f"list_reduce(xs, lambda y, x: y * {1.0 - a!r} + x * {a!r}) AS {col}")
    return (f"{name}_xs AS (SELECT *, list({x}) OVER {SO_FAR} AS xs FROM {rel}),\n"
            f"{name} AS (SELECT * EXCLUDE (xs), {', '.join(parts)} FROM {name}_xs)")


def swings(rel: str, name: str, left: int, right: int) -> str:
    lo = f"(PARTITION BY asset ORDER BY i ROWS BETWEEN {left} PRECEDING AND 1 PRECEDING)"
    hi = ahead(1, right)
    eq = "(abs({a} - {b}) / greatest({a}, {b}) <= 0.0002 AND {a} <> 0 AND {b} <> 0)"

    def pair(sw: str, x: str) -> str:
        tests = " OR ".join(f"coalesce({eq.format(a=sw, b=f'{k}_{x}')}, false)" for k in ("p", "n"))
        return f"CASE WHEN {sw} IS NOT NULL AND ({tests}) THEN 1 ELSE 0 END"

    return f"""{name}_0 AS (SELECT *,
  count(h) OVER {lo} = {left} AND count(h) OVER {hi} = {right} AS ok, max(h) OVER {lo} AS mh0, max(h) OVER {hi} AS mh1,
  min(l) OVER {lo} AS ml0, min(l) OVER {hi} AS ml1, lag(h) OVER {W} AS p_h, lead(h) OVER {W} AS n_h,
  lag(l) OVER {W} AS p_l, lead(l) OVER {W} AS n_l, lead(t, {right}) OVER {W} AS later FROM {rel}),
{name}_1 AS (SELECT *, CASE WHEN ok AND h > mh0 AND h > mh1 THEN h END AS swing_high,
  CASE WHEN ok AND l < ml0 AND l < ml1 THEN l END AS swing_low FROM {name}_0),
{name} AS (SELECT *, {pair('swing_high', 'h')} AS swing_equal_high, {pair('swing_low', 'l')} AS swing_equal_low,
  CASE WHEN ok THEN later END AS confirmed_t,
  CASE WHEN swing_high IS NOT NULL THEN greatest(abs(swing_high - p_h), abs(swing_high - n_h))
       WHEN swing_low IS NOT NULL THEN greatest(abs(swing_low - p_l), abs(swing_low - n_l)) END AS sz,
  coalesce(swing_high, swing_low) AS lvl FROM {name}_1)"""


def breaks(rel: str, name: str, delay: int = 0) -> str:
    sh, sl = (lag("swing_high", delay), lag("swing_low", delay)) if delay else ("swing_high", "swing_low")
    return f"""{name}_0 AS (SELECT *, {sh} AS d_sh, {sl} AS d_sl, coalesce({lag('h')}, h) AS q_h,
  coalesce({lag('l')}, l) AS q_l FROM {rel}),
{name}_1 AS (SELECT *, last_value(d_sh IGNORE NULLS) OVER {SO_FAR} AS lsh,
  last_value(d_sl IGNORE NULLS) OVER {SO_FAR} AS lsl FROM {name}_0),
{name}_2 AS (SELECT *, CASE WHEN c > lsh THEN 1 ELSE 0 END AS bos_up, CASE WHEN c < lsl THEN 1 ELSE 0 END AS bos_down
  FROM {name}_1),
{name}_3 AS (SELECT *, CASE WHEN bos_up = 1 AND lsl IS NOT NULL AND c > q_h THEN 1 ELSE 0 END AS choch_up,
  CASE WHEN bos_down = 1 AND lsh IS NOT NULL AND c < q_l THEN 1 ELSE 0 END AS choch_down,
  CASE WHEN bos_down = 1 THEN lsl WHEN bos_up = 1 THEN lsh END AS broken_level FROM {name}_2),
{name} AS (SELECT *, greatest(bos_up, bos_down) AS bos_flag, greatest(choch_up, choch_down) AS choch_flag,
  CASE WHEN choch_down = 1 THEN 'DOWN' WHEN choch_up = 1 THEN 'UP' WHEN bos_down = 1 THEN 'DOWN'
       WHEN bos_up = 1 THEN 'UP' ELSE 'NEUTRAL' END AS bias FROM {name}_3)"""


def sweeps(rel: str, name: str) -> str:
    def eq(x: str) -> str:
        p = lag(x)
        return f"coalesce(abs({x} - {p}) / greatest({x}, {p}) <= 0.0002 AND {x} <> 0 AND {p} <> 0, false)"

    return f"""{name}_0 AS (SELECT *, CASE WHEN {eq('h')} THEN h END AS eqh, CASE WHEN {eq('l')} THEN l END AS eql
  FROM {rel}),
{name}_1 AS (SELECT *, last_value(eqh IGNORE NULLS) OVER {SO_FAR} AS eh,
  last_value(eql IGNORE NULLS) OVER {SO_FAR} AS el FROM {name}_0),
{name}_2 AS (SELECT *, CASE WHEN h > eh AND c < eh THEN 1 ELSE 0 END AS sweep_high,
  CASE WHEN l < el AND c > el THEN 1 ELSE 0 END AS sweep_low FROM {name}_1),
{name} AS (SELECT *, CASE WHEN sweep_low = 1 THEN el WHEN sweep_high = 1 THEN eh END AS swept_level,
  CASE WHEN sweep_low = 1 THEN el - l WHEN sweep_high = 1 THEN h - eh END AS sweep_strength,
  CASE WHEN sweep_low = 1 THEN (h - least(o, c)) / greatest(1e-9, h - l)
       WHEN sweep_high = 1 THEN (greatest(o, c) - l) / greatest(1e-9, h - l) END AS displacement_hint,
  greatest(sweep_high, sweep_low) AS sweep_flag,
  CASE WHEN sweep_low = 1 THEN 1 WHEN sweep_high = 1 THEN -1 ELSE 0 END AS sweep_dir FROM {name}_2)"""


def gap_life(rel: str, name: str, start: int) -> str:
    """CTEs ``{name}_b`` (gap births) and ``{name}`` (births with their end)."""
    return f"""{name}_0 AS (SELECT *, lag(l, 2) OVER {W} AS l2, lag(h, 2) OVER {W} AS h2 FROM {rel}),
{name}_r AS (SELECT *, CASE WHEN l2 > h AND (l2 - h) / greatest(1e-9, c) >= 0.0005 THEN 1 ELSE 0 END AS g_up,
  CASE WHEN h2 < l AND (l - h2) / greatest(1e-9, c) >= 0.0005 THEN 1 ELSE 0 END AS g_dn FROM {name}_0),
{name}_b AS (SELECT asset, i AS born, CASE WHEN g_up = 1 THEN 1 ELSE -1 END AS dir,
  CASE WHEN g_up = 1 THEN l2 ELSE l END AS top, CASE WHEN g_up = 1 THEN h ELSE h2 END AS bottom
  FROM {name}_r WHERE g_up = 1 OR g_dn = 1),
{name}_d AS (SELECT g.asset, g.born, min(r.i) AS died FROM {name}_b g JOIN {rel} r ON r.asset = g.asset
  AND r.i >= g.born + {start} AND CASE WHEN g.dir = 1 THEN (r.h >= g.bottom - 1e-9 AND r.l <= g.top + 1e-9)
      OR r.c < g.bottom - 1e-9 ELSE (r.l <= g.top + 1e-9 AND r.h >= g.bottom - 1e-9) OR r.c > g.top + 1e-9 END
  GROUP BY 1, 2),
{name} AS (SELECT g.*, d.died,
  CASE WHEN r.l <= g.top + 1e-9 AND r.h >= g.bottom - 1e-9 THEN 1 ELSE 0 END AS touched,
  CASE WHEN (g.dir = 1 AND r.c < g.bottom - 1e-9) OR (g.dir = -1 AND r.c > g.top + 1e-9) THEN 1 ELSE 0 END AS beyond
  FROM {name}_b g LEFT JOIN {name}_d d USING (asset, born) LEFT JOIN {rel} r ON r.asset = g.asset AND r.i = d.died)"""


def zone_life(rel: str, name: str) -> str:
    """CTEs ``{name}_b`` (zone births with first touch) and ``{name}_p`` (best zone per bar and side)."""
    return f"""{name}_0 AS (SELECT *, lag(o) OVER {W} AS po, lag(c) OVER {W} AS pc, lag(h) OVER {W} AS ph,
  lag(l) OVER {W} AS pl FROM {rel}),
{name}_1 AS (SELECT *, abs(c - o) / greatest(1e-9, c) AS bd, greatest(1e-9, abs(c - o) / greatest(h - l, 1e-9)) * 0.7
  + (1 - abs(pc - o) / greatest(1e-9, o)) * 0.3 AS q FROM {name}_0),
{name}_n AS (SELECT asset, i AS born, 'demand' AS side, ph AS top, pl AS bottom, q FROM {name}_1
  WHERE i >= 2 AND pc < po AND c > o AND bd >= 0.002 AND (c - o) / greatest(1e-9, c) >= 0.003
  UNION ALL SELECT asset, i, 'supply', ph, pl, q FROM {name}_1
  WHERE i >= 2 AND pc > po AND c < o AND bd >= 0.002 AND (po - c) / greatest(1e-9, c) >= 0.003),
{name}_t AS (SELECT z.asset, z.born, z.side, min(r.i) AS touch FROM {name}_n z JOIN {rel} r ON r.asset = z.asset
  AND r.i BETWEEN z.born AND z.born + 298 AND CASE WHEN z.side = 'demand' THEN r.l BETWEEN z.bottom AND z.top
  ELSE r.h BETWEEN z.bottom AND z.top END GROUP BY ALL),
{name}_b AS (SELECT z.*, t.touch FROM {name}_n z LEFT JOIN {name}_t t USING (asset, born, side)),
{name}_p AS (SELECT r.asset, r.i, z.side, arg_max(z, (z.q, -z.born)) AS z FROM {rel} r JOIN {name}_b z
  ON z.asset = r.asset AND z.born BETWEEN r.i - 298 AND r.i GROUP BY ALL),
{name} AS (SELECT r.*, d.z.top AS demand_top, d.z.bottom AS demand_bottom, d.z.q AS demand_quality,
  r.i - d.z.born + 1 AS demand_age, CASE WHEN d.z IS NULL THEN NULL WHEN d.z.touch <= r.i THEN 1 ELSE 0 END
  AS demand_touched, s.z.top AS supply_top, s.z.bottom AS supply_bottom, s.z.q AS supply_quality,
  r.i - s.z.born + 1 AS supply_age, CASE WHEN s.z IS NULL THEN NULL WHEN s.z.touch <= r.i THEN 1 ELSE 0 END
  AS supply_touched, coalesce(d.z.q, -1) >= coalesce(s.z.q, -1) AS pick
  FROM {rel} r LEFT JOIN {name}_p d ON d.asset = r.asset AND d.i = r.i AND d.side = 'demand'
  LEFT JOIN {name}_p s ON s.asset = r.asset AND s.i = r.i AND s.side = 'supply')"""


def zone_choice(rel: str, name: str) -> str:
    return f"""{name} AS (SELECT *, CASE WHEN pick AND demand_top IS NOT NULL THEN 'demand'
  WHEN NOT pick AND supply_top IS NOT NULL THEN 'supply' ELSE '' END AS zone_id,
  CASE WHEN pick THEN demand_top ELSE supply_top END AS zone_hi,
  CASE WHEN pick THEN demand_bottom ELSE supply_bottom END AS zone_lo,
  coalesce(1.0 / (1.0 + CASE WHEN pick THEN demand_age ELSE supply_age END), 0) AS zone_recency,
  coalesce(greatest(CASE WHEN pick THEN demand_quality ELSE supply_quality END, 0), 0) AS zone_displacement,
  1.0 - coalesce(CASE WHEN pick THEN demand_touched ELSE supply_touched END, 0) AS zone_mitigation FROM {rel})"""


def first_ahead(rel: str, name: str, first: int, last: int, tests: dict[str, str], keep: str = "s.*") -> str:
    """CTE ``name``: for each test the smallest offset in ``first..last`` whose later row f meets it."""
    picks = ", ".join(f"min(CASE WHEN {t} THEN f.i - s.i END) AS {k}" for k, t in tests.items())
    return f"""{name}_h AS (SELECT s.asset, s.i, {picks} FROM {rel} s JOIN {rel} f ON f.asset = s.asset
  AND f.i BETWEEN s.i + {first} AND s.i + {last} GROUP BY 1, 2),
{name} AS (SELECT {keep}, {', '.join('x.' + k for k in tests)} FROM {rel} s LEFT JOIN {name}_h x USING (asset, i))"""


def spaced(with_: str, candidates: str, per_hour: int, min_gap: int) -> str:
    """``WITH`` clause that defines ``decided``: the candidates (asset, i, t) one after another, with the greedy limits."""
    ok = f"s.i - w.last >= {min_gap} AND (s.t // 3600 > w.hour OR w.used < {per_hour})"
    return with_.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
s AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY i) AS rn FROM ({candidates})),
w AS (
  SELECT asset, i, t, rn, 1::BIGINT AS accepted, i AS last, t // 3600 AS hour, 1 AS used FROM s WHERE rn = 1
  UNION ALL
  SELECT s.asset, s.i, s.t, s.rn, CASE WHEN {ok} THEN 1 ELSE 0 END, CASE WHEN {ok} THEN s.i ELSE w.last END, s.t // 3600,
    CASE WHEN s.t // 3600 > w.hour THEN 0 ELSE w.used END + CASE WHEN {ok} THEN 1 ELSE 0 END
  FROM w JOIN s ON s.asset = w.asset AND s.rn = w.rn + 1),
decided AS (SELECT asset, i, t, accepted FROM w)"""
