"""Every operator as a query on the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import classify, compose, evaluate, fills, filters, groups, level1, level2
from quillon.plans import chain, experiment
from quillon.plans.checkpoints import folder
from quillon.sources import files
from quillon.sources import panel as P
from quillon.streaming import bars as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EVENTS = """seen AS (SELECT user_id AS code, datediff('day', DATE '2024-01-01', ts::DATE) * 4 + hour(ts) // 6 AS t, avg(value) / 53.17 - 1 AS v FROM events GROUP BY 1, 2),
 grid AS (SELECT code, t FROM (SELECT DISTINCT code FROM seen), range(120) r(t)),
 flat AS (SELECT code, t, v FROM grid LEFT JOIN seen USING (code, t)),
 p AS (SELECT t // 40 AS gid, code, t % 40 AS bar, v FROM flat)"""
REVENUE = """seen AS (SELECT l_suppkey AS code, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, sum(l_extendedprice * (1 - l_discount) / 1e6) AS v FROM lineitem GROUP BY 1, 2),
 grid AS (SELECT code, t FROM (SELECT DISTINCT code FROM seen), range(84) r(t)),
 p AS (SELECT 1995 + t // 12 AS gid, code, t % 12 AS bar, v FROM grid LEFT JOIN seen USING (code, t))"""
FILLED = EVENTS + """, q AS (SELECT gid, code, bar, coalesce(v, avg(v) OVER (PARTITION BY gid, code), 0.0) AS v FROM p)"""
WINDOWS = """WINDOW w AS (PARTITION BY gid, code ORDER BY bar), wc AS (PARTITION BY gid, code), wx AS (PARTITION BY gid, bar), g AS (PARTITION BY gid),
 r5 AS (PARTITION BY gid, code ORDER BY bar ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
 ex AS (PARTITION BY gid, code ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 on_ AS (PARTITION BY gid, code ORDER BY bar ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
 al AS (PARTITION BY gid, code ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
 bk AS (PARTITION BY gid, code ORDER BY bar DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """gid, code, bar as integers and v rounded, without negative zeros."""
    keys = [c for c in df.columns if c != "v"]
    return df.select(*(F.col(k).cast("long").alias(k) for k in keys), (F.round("v", digits) + 0.0).alias("v"))


def out(keys: str, digits: int = 6) -> str:
    return f"SELECT {', '.join(f'{k}::BIGINT AS {k}' for k in keys.split())}, round(v, {digits}) + 0.0 AS v"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def filled(spark, d):
    p = P.event_panel(spark, d)
    return p.select("gid", "code", "bar", F.coalesce("v", F.avg("v").over(P.whole()), F.lit(0.0)).alias("v"))


REPAIR = "CASE WHEN x = 'inf'::DOUBLE THEN max(f) OVER wc WHEN x = '-inf'::DOUBLE THEN min(f) OVER wc ELSE f END"


def transform(name: str, sql: str, before: str = "", base: str = EVENTS, digits: int = 6, stage: str = "p") -> None:
    """A level-1 query: ``sql`` in terms of v and the named windows, after an optional CTE that adds columns."""
    step = f"o AS (SELECT gid, code, bar, {sql} AS v FROM {stage} {WINDOWS})"
    if name in level1.OVERFLOWS:
        step = f"o1 AS (SELECT gid, code, bar, {sql} AS x FROM {stage} {WINDOWS}), o2 AS (SELECT *, CASE WHEN isfinite(x) THEN x END AS f FROM o1), o AS (SELECT gid, code, bar, {REPAIR} AS v FROM o2 {WINDOWS})"
    add(f"l1_{name}", lambda s, d: rounded(level1.apply(P.event_panel(s, d), name), digits), f"WITH {base}{before}, {step} {out('gid code bar', digits)} FROM o")


CLIP = "greatest(least(v, 354.891356446692), -354.891356446692)"
for _n, _s in {
    "abs_v": "abs(v)", "reciprocal": "1 / nullif(v, 0)", "sigmoid": "1 / (1 + exp(-v))", "exp": "exp(v)", "lg1p": "CASE WHEN v = -1 THEN '-inf'::DOUBLE WHEN v > -1 THEN ln(1 + v) END",
    "tan": "tan(v)", "sin": "sin(v)", "cos": "cos(v)", "asin": "CASE WHEN abs(v) <= 1 THEN asin(v) END", "acos": "CASE WHEN abs(v) <= 1 THEN acos(v) END", "atan": "atan(v)",
    "sinh": f"CASE WHEN v IS NOT NULL THEN sinh({CLIP}) END", "cosh": f"CASE WHEN v IS NOT NULL THEN cosh({CLIP}) END", "tanh": "tanh(v)",
    "sec_zsc": "(v - avg(v) OVER wx) / nullif(stddev_pop(v) OVER wx, 0)",
    "pct_rank": "CASE WHEN v IS NOT NULL THEN (row_number() OVER (PARTITION BY gid, bar ORDER BY v NULLS LAST, code) - 1) / (count(v) OVER wx) END",
    "pct_rank_avg": "CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY gid, bar ORDER BY v NULLS LAST) + (count(v) OVER (PARTITION BY gid, bar, v) - 1) / 2) / (count(v) OVER wx) END",
    "apo": "abs(v - avg(v) OVER wc)",
    "normalize": "CASE WHEN max(v) OVER wc - min(v) OVER wc < 1e-9 THEN CASE WHEN v IS NOT NULL THEN 0.0 END ELSE (v - min(v) OVER wc) / nullif(max(v) OVER wc - min(v) OVER wc, 0) * 2 - 1 END",
    "diff": "v - lag(v) OVER w", "diff_lead": "lead(v) OVER w - v", "trewgt": "v * coalesce(sign(v - lag(v) OVER w), 0)",
    "trend_sign": "lead(v) OVER w * CASE WHEN lead(v) OVER w > v THEN 1 WHEN lead(v) OVER w IS NOT NULL AND v IS NOT NULL THEN -1 END",
    "rollmean": "CASE WHEN count(v) OVER r5 = 5 THEN avg(v) OVER r5 END", "rollsum": "CASE WHEN count(v) OVER r5 = 5 THEN sum(v) OVER r5 END",
    "rollmax": "CASE WHEN count(v) OVER r5 = 5 THEN max(v) OVER r5 END", "rollmin": "CASE WHEN count(v) OVER r5 = 5 THEN min(v) OVER r5 END",
    "rollstd": "CASE WHEN count(v) OVER r5 = 5 THEN stddev_samp(v) OVER r5 END", "rollzscore": "CASE WHEN count(v) OVER r5 = 5 THEN (v - avg(v) OVER r5) / nullif(stddev_samp(v) OVER r5, 0) END",
    "rollmedian": "CASE WHEN count(v) OVER r5 = 5 THEN quantile_cont(v, 0.5) OVER r5 END",
    "rollskew": "CASE WHEN row_number() OVER w >= 5 AND count(v) OVER r5 >= 3 THEN skewness(v) OVER r5 END", "rollkurt": "CASE WHEN row_number() OVER w >= 5 AND count(v) OVER r5 >= 4 THEN kurtosis(v) OVER r5 END",
    "aroonosc": "CASE WHEN count(v) OVER r5 = 5 THEN (-(max({'a': v, 'b': -bar}) OVER r5).b - (min({'a': v, 'b': bar}) OVER r5).b) * 100.0 / 5 END",
    "expandmean": "CASE WHEN v IS NOT NULL THEN sum(coalesce(v, 0)) OVER ex / row_number() OVER w END", "expandsum": "sum(coalesce(v, 0)) OVER ex",
    "expandstd": "CASE WHEN v IS NOT NULL AND row_number() OVER w > 1 THEN stddev_samp(coalesce(v, 0)) OVER ex END",
    "expandmax": "CASE WHEN v IS NOT NULL THEN max(v) OVER ex END", "expandmin": "CASE WHEN v IS NOT NULL THEN min(v) OVER ex END",
    "expandzscore": "(v - sum(coalesce(v, 0)) OVER ex / row_number() OVER w) / CASE WHEN row_number() OVER w > 1 THEN nullif(stddev_samp(coalesce(v, 0)) OVER ex, 0) END",
    "expandskew": "CASE WHEN count(v) OVER ex >= 3 THEN skewness(v) OVER ex END", "expandkurt": "CASE WHEN count(v) OVER ex >= 4 THEN kurtosis(v) OVER ex END",
    "rollskew_whole": "CASE WHEN count(v) OVER r5 = 5 THEN skewness(v) OVER r5 END", "rollkurt_whole": "CASE WHEN count(v) OVER r5 = 5 THEN kurtosis(v) OVER r5 END",
    "aroonosc_masked": "CASE WHEN row_number() OVER w >= 5 AND count(v) OVER r5 > 0 THEN (-(max(CASE WHEN v IS NOT NULL THEN {'a': v, 'b': -bar} END) OVER r5).b - (min(CASE WHEN v IS NOT NULL THEN {'a': v, 'b': bar} END) OVER r5).b) * 100.0 / 5 END",
    "rollskew_plain": "CASE WHEN count(v) OVER r5 >= 3 THEN CASE WHEN max(v) OVER r5 = min(v) OVER r5 THEN 0 ELSE skewness(v) OVER r5 * (count(v) OVER r5 - 2) / sqrt((count(v) OVER r5) * (count(v) OVER r5 - 1)) * pow((count(v) OVER r5 - 1) / (count(v) OVER r5), 1.5) END END",
    "rollkurt_plain": "CASE WHEN count(v) OVER r5 >= 4 THEN CASE WHEN max(v) OVER r5 = min(v) OVER r5 THEN 0 ELSE (kurtosis_pop(v) OVER r5 + 3) * pow((count(v) OVER r5 - 1) / (count(v) OVER r5), 2) - 3 END END",
    "bin_right": "CASE WHEN count(*) OVER wc > count(v) OVER wc THEN v WHEN max(v) OVER wc = min(v) OVER wc THEN 0.0 ELSE least(ceil((v - min(v) OVER wc) / (max(v) OVER wc - min(v) OVER wc) * 10), 10) END",
    "bin": "CASE WHEN count(*) OVER wc > count(v) OVER wc THEN v WHEN max(v) OVER wc = min(v) OVER wc THEN 10.0 ELSE least(floor((v - min(v) OVER wc) / (max(v) OVER wc - min(v) OVER wc) * 10) + 1, 10) END",
}.items():
    transform(_n, _s, digits=5 if "kurt" in _n or "skew" in _n else 6)
for _n, _s in {"sinh_scaled": "sinh(v * s) / s", "cosh_scaled": "cosh(v * s)"}.items():
    transform(_n, _s, ", p2 AS (SELECT gid, code, bar, v, quantile_cont(abs(v), 0.85) OVER (PARTITION BY gid) AS q FROM p), p3 AS (SELECT gid, code, bar, v, CASE WHEN q > 10 THEN 0.1 WHEN q < 0.1 THEN 10.0 ELSE 1.0 END AS s FROM p2)", stage="p3")
_DEV = """, d1 AS (SELECT *, v - lag(v) OVER w AS d, lead(v) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY gid, code ORDER BY bar)),
 d2 AS (SELECT *, abs(d - avg(d) OVER wc) / nullif(stddev_pop(d) OVER wc, 0) AS dev FROM d1 WINDOW wc AS (PARTITION BY gid, code)),
 d3 AS (SELECT *, lead(dev) OVER w AS ldev, coalesce(sign(d), 0) AS sg, CASE WHEN nxt > v THEN 1 WHEN nxt IS NOT NULL AND v IS NOT NULL THEN -1 END AS ahead FROM d2 WINDOW w AS (PARTITION BY gid, code ORDER BY bar))"""
for _n, _s in {
    "revwtg": "v * CASE WHEN dev > 1.5 THEN -1 ELSE 0 END", "reversal_sign": "nxt * CASE WHEN ldev > 1.5 THEN -1 ELSE 1 END",
    "trerevwtg": "v * (CASE WHEN dev > 1.5 THEN -1 ELSE 0 END + sg)", "trerev_sign": "nxt * (ahead + CASE WHEN ldev > 1.5 THEN -1 ELSE 1 END)",
}.items():
    transform(_n, _s, _DEV, stage="d3")

# ±inf repair, on planted infinities
_PLANTED = ", pl AS (SELECT gid, code, bar, CASE WHEN bar = 5 AND code % 7 = 0 THEN 'inf'::DOUBLE WHEN bar = 9 AND code % 5 = 0 THEN '-inf'::DOUBLE ELSE v END AS x FROM p), pf AS (SELECT *, CASE WHEN isfinite(x) THEN x END AS f FROM pl)"


def _planted(s, d):
    v = F.when((F.col("bar") == 5) & (F.col("code") % 7 == 0), float("inf")).when((F.col("bar") == 9) & (F.col("code") % 5 == 0), float("-inf")).otherwise(F.col("v"))
    return P.event_panel(s, d).select("gid", "code", "bar", v.alias("v"))


_repairs = {"time": (lambda p: p.withColumn("v", level1.repaired(F.col("v"), P.whole())), "wc"), "section": (lambda p: level1.repaired_by(p, ["gid", "bar"]), "wx")}
for _n, (_w, _sw) in _repairs.items():
    add(f"inf_repair_{_n}", lambda s, d, w=_w: rounded(w(_planted(s, d)).select("gid", "code", "bar", "v")), f"WITH {EVENTS}{_PLANTED}, o AS (SELECT gid, code, bar, {REPAIR.replace('wc', _sw)} AS v FROM pf {WINDOWS}) {out('gid code bar')} FROM o")

# the older repair leaves a series of one usable value alone; its infinities are shown as such
add("inf_repair_older", lambda s, d: rounded(level1.filled_inf(_planted(s, d).where("bar < 10 OR code % 3 > 0").where("code % 7 > 0 OR bar BETWEEN 5 AND 6"))), f"""WITH {EVENTS}{_PLANTED.replace('FROM pl)', 'FROM pl WHERE (bar < 10 OR code % 3 > 0) AND (code % 7 > 0 OR bar BETWEEN 5 AND 6))')},
 o AS (SELECT gid, code, bar, CASE WHEN count(f) OVER wc > 1 THEN {REPAIR} ELSE x END AS v FROM pf {WINDOWS}) {out('gid code bar')} FROM o""")

# fills
_NEAR = ", n AS (SELECT *, last_value(v IGNORE NULLS) OVER ex AS pv, last_value(CASE WHEN v IS NOT NULL THEN bar END IGNORE NULLS) OVER ex AS pb, first_value(v IGNORE NULLS) OVER on_ AS nv, first_value(CASE WHEN v IS NOT NULL THEN bar END IGNORE NULLS) OVER on_ AS nb, count(v) OVER wc AS c, nth_value(v, 1 IGNORE NULLS) OVER al AS f1, nth_value(v, 2 IGNORE NULLS) OVER al AS f2, nth_value(CASE WHEN v IS NOT NULL THEN bar END, 1 IGNORE NULLS) OVER al AS b1, nth_value(CASE WHEN v IS NOT NULL THEN bar END, 2 IGNORE NULLS) OVER al AS b2, nth_value(v, 1 IGNORE NULLS) OVER bk AS g1, nth_value(v, 2 IGNORE NULLS) OVER bk AS g2, nth_value(CASE WHEN v IS NOT NULL THEN bar END, 1 IGNORE NULLS) OVER bk AS h1, nth_value(CASE WHEN v IS NOT NULL THEN bar END, 2 IGNORE NULLS) OVER bk AS h2 FROM p " + WINDOWS + ")"
_INNER = "pv + (nv - pv) * (bar - pb) / nullif(nb - pb, 0)"
_EXTRA = f"CASE WHEN c >= 2 THEN coalesce(v, {_INNER}, CASE WHEN pv IS NULL THEN f1 + (f2 - f1) * (bar - b1) / (b2 - b1) WHEN nv IS NULL THEN g1 + (g2 - g1) * (bar - h1) / (h2 - h1) END) END"
for _n, _s, _st in (
    ("none", "v", "p"), ("ffill", "last_value(v IGNORE NULLS) OVER ex", "p"), ("bfill", "first_value(v IGNORE NULLS) OVER on_", "p"), ("xs_mean", "coalesce(v, avg(v) OVER wx)", "p"), ("xs_median", "coalesce(v, quantile_cont(v, 0.5) OVER wx)", "p"),
    ("time_mean", "coalesce(v, avg(v) OVER wc)", "p"), ("linear_interp", f"coalesce(v, {_INNER}, pv, nv)", "n"), ("interp_extrapolate", _EXTRA, "n"),
    ("interp_zero_ends", f"CASE WHEN c >= 2 THEN coalesce(v, {_INNER}, 0) END", "n"),
):
    add(f"fill_{_n}" if not _n.startswith("interp") else _n, lambda s, d, n=_n: rounded(fills.fill(P.event_panel(s, d), n)), f"WITH {EVENTS}{_NEAR if _st == 'n' else ''}, o AS (SELECT gid, code, bar, {_s} AS v FROM {_st} {WINDOWS if _st == 'p' else ''}) {out('gid code bar')} FROM o")
_KNN = """, f AS (SELECT gid, count(DISTINCT code) AS f FROM p WHERE v IS NOT NULL GROUP BY 1),
 dd AS (SELECT a.gid, a.bar, b.bar AS donor, round(any_value(f.f) / count(*) * sum((a.v - b.v) ** 2), 9) AS d2 FROM p a JOIN p b ON a.gid = b.gid AND a.code = b.code AND a.bar <> b.bar JOIN f ON f.gid = a.gid WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2, 3),
 nn AS (SELECT m.gid, m.code, m.bar, h.v AS dv, row_number() OVER (PARTITION BY m.gid, m.code, m.bar ORDER BY d2, donor) AS k FROM p m JOIN dd ON dd.gid = m.gid AND dd.bar = m.bar JOIN p h ON h.gid = m.gid AND h.code = m.code AND h.bar = dd.donor WHERE m.v IS NULL AND h.v IS NOT NULL),
 kn AS (SELECT gid, code, bar, avg(dv) AS nv FROM nn WHERE k <= 5 GROUP BY 1, 2, 3),
 o AS (SELECT p.gid, p.code, p.bar, coalesce(p.v, nv, avg(p.v) OVER (PARTITION BY p.gid, p.code)) AS v FROM p LEFT JOIN kn USING (gid, code, bar))"""
add("fill_knn", lambda s, d: rounded(fills.knn(P.event_panel(s, d), digits=9)), f"WITH {EVENTS}{_KNN} {out('gid code bar')} FROM o")


def _fill_stats(s, d):
    p = P.event_panel(s, d)
    x = fills.correlation_stats(fills.fill(p, "ffill"), P.event_panel(s, d).withColumn("v", F.col("v") * F.when(F.col("bar") % 3 == 0, 1.0).otherwise(F.col("code") % 5)))
    return x.select(*(F.round(c, 5).alias(c) for c in ("mean_corr", "std_corr", "median_corr", "min_corr", "max_corr", "mean_diff")), F.col("n").cast("long").alias("n"))


add("fill_corr_stats", _fill_stats, f"""WITH {EVENTS}, f AS (SELECT gid, code, bar, last_value(v IGNORE NULLS) OVER ex AS x, v * CASE WHEN bar % 3 = 0 THEN 1.0 ELSE code % 5 END AS y FROM p {WINDOWS}),
 c AS (SELECT gid, bar, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS c, avg(abs(x - y)) AS d FROM f WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2)
 SELECT round(avg(c), 5) AS mean_corr, round(stddev_samp(c), 5) AS std_corr, round(quantile_cont(c, 0.5), 5) AS median_corr, round(min(c), 5) AS min_corr, round(max(c), 5) AS max_corr, round(avg(d), 5) AS mean_diff, count(*) AS n FROM c WHERE c IS NOT NULL""")


def _fill_select(s, d):
    p = P.event_panel(s, d)
    one = lambda n: fills.correlation_stats(fills.fill(p, n), p).select(F.lit(n).alias("fill"), F.round("mean_corr", 6).alias("mean_corr"), F.round("std_corr", 6).alias("std_corr"), "n", F.lit(120).alias("total"), F.round("mean_diff", 6).alias("mean_diff"))
    return fills.robust(one("none").unionByName(one("ffill")).unionByName(one("bfill")).unionByName(one("xs_mean"))).select("fill", F.col("n").cast("long").alias("n"))


_FILLS4 = {"none": "v", "ffill": "last_value(v IGNORE NULLS) OVER ex", "bfill": "first_value(v IGNORE NULLS) OVER on_", "xs_mean": "coalesce(v, avg(v) OVER wx)"}
_EACH = ", ".join(f"f_{_n} AS (SELECT gid, bar, {_s} AS x, v AS y FROM p {WINDOWS}), c_{_n} AS (SELECT gid, bar, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS c, avg(abs(x - y)) AS d FROM f_{_n} WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2)" for _n, _s in _FILLS4.items())
_STATS4 = " UNION ALL ".join(f"SELECT '{_n}' AS fill, round(avg(c), 6) AS mc, round(stddev_samp(c), 6) AS sc, count(*) AS n, round(avg(d), 6) AS md FROM c_{_n} WHERE c IS NOT NULL" for _n in _FILLS4)
add("fill_select", _fill_select, f"WITH {EVENTS}, {_EACH}, s AS ({_STATS4}) SELECT fill, n FROM (SELECT * FROM s WHERE mc >= 0.9 AND coalesce(sc, 0) <= 0.1 AND n / 120 >= 0.8 ORDER BY mc DESC, sc, md, fill LIMIT 3)")

# filters
def kernel(name: str, k) -> str:
    """A matrix as a table (k, j, w)."""
    i, j = np.nonzero(np.abs(k) > 1e-15)
    return f"{name} AS (SELECT unnest({i.tolist()}) AS k, unnest({j.tolist()}) AS j, unnest({[float(x) for x in k[i, j]]}::DOUBLE[]) AS w)"


def linear(name: str, query, k, rows: str = "") -> None:
    add(name, query, f"""WITH {FILLED}, {kernel('kern', k)}, y AS (SELECT gid, code, k AS bar, CASE WHEN count(v) = count(*) THEN sum(w * v) END AS v FROM q JOIN kern ON j = bar {rows} GROUP BY ALL),
 o AS (SELECT q.gid, q.code, q.bar, y.v FROM q LEFT JOIN y USING (gid, code, bar)) {out('gid code bar')} FROM o""")


for _n in filters.KERNELS:
    linear(f"f_{_n}", lambda s, d, n=_n: rounded(filters.linear(filled(s, d), n, 40)), filters.KERNELS[_n](40), "WHERE k < 20" if _n in ("dwt_ca", "dwt_da") else "")
# settings: from a configuration's section, and as arguments in a name
_SET = filters.configured({
    "ewma_filter": {"span": 4}, "savgol_filter": {"window_length": 7, "polyorder": 3}, "hp_filter": {"lamb": 50}, "kalman_filter": {"transition_covariance": 0.2, "observation_covariance": 0.5},
    "lowpass_filter": {"cutoff": 0.1, "fs": 1, "order": 2}, "bandpass_filter": {"lowcut": 0.05, "highcut": 0.2, "fs": 1, "order": 3},
})
for _n, _settings in _SET.items():
    linear(f"f_set_{_n}", lambda s, d, n=_n, x=_settings: rounded(level1.apply(filled(s, d), n, **x)), filters.KERNELS[_n](40, **_settings))
linear("f_args_savgolfilt", lambda s, d: rounded(chain.step(filled(s, d), "savgolfilt(9, 3)")), filters.KERNELS["savgolfilt"](40, 9, 3))
linear("f_args_ewma", lambda s, d: rounded(chain.step(filled(s, d), "ewma_6")), filters.KERNELS["ewma"](40, 6))
add("f_medfilt_patch", lambda s, d: rounded(filters.median_patch(filled(s, d))), f"""WITH {FILLED}, r AS (SELECT *, dense_rank() OVER (PARTITION BY gid ORDER BY code) AS c FROM q),
 l AS (SELECT a.gid, a.code, a.bar, list(b.v) AS l FROM r a JOIN r b ON a.gid = b.gid AND b.c BETWEEN a.c - 2 AND a.c + 2 AND b.bar BETWEEN a.bar - 2 AND a.bar + 2 GROUP BY 1, 2, 3),
 o AS (SELECT gid, code, bar, list_sort(list_concat(l, list_transform(range(25 - len(l)), lambda e: 0.0)))[13] AS v FROM l) {out('gid code bar')} FROM o""")
_FFT = FILLED + """, ks AS (SELECT k FROM range(40) r(k)), z AS (SELECT gid, code, k AS bar, any_value(CASE WHEN k > 0 AND k < 39 THEN 2.0 ELSE 1.0 END) / 40 AS s, sum(v * cos(2 * pi() * k * bar / 40)) AS re, -sum(v * sin(2 * pi() * k * bar / 40)) AS im FROM q, ks GROUP BY 1, 2, 3)"""
for _n, _s in {"fft_r": "s * re", "fft_amp": "s * sqrt(re * re + im * im)"}.items():
    add(f"f_{_n}", lambda s, d, n=_n: rounded(filters.fourier(filled(s, d), n, 40)), f"WITH {_FFT}, o AS (SELECT gid, code, bar, {_s} AS v FROM z) {out('gid code bar')} FROM o")
# a phase is ill-defined where a part is 0 up to rounding: its sine counts, where the amplitude is not tiny
add("f_fft_angle", lambda s, d: rounded(filters.fourier(filled(s, d), "fft_angle", 40).withColumn("v", F.sin("v")), 5), f"WITH {_FFT}, o AS (SELECT gid, code, bar, CASE WHEN s * sqrt(re * re + im * im) >= 1e-10 THEN sin(atan2(im, re)) END AS v FROM z) {out('gid code bar', 5)} FROM o")
add("f_medfilt", lambda s, d: rounded(filters.median_filter(filled(s, d))), f"""WITH {FILLED}, l AS (SELECT gid, code, bar, list(v) OVER (PARTITION BY gid, code ORDER BY bar ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM q),
 o AS (SELECT gid, code, bar, list_sort(list_concat(l, list_transform(range(5 - len(l)), lambda e: 0.0)))[3] AS v FROM l) {out('gid code bar')} FROM o""")
add("f_rob_zsfilt", lambda s, d: rounded(filters.robust_z(filled(s, d))), f"""WITH {FILLED}, m AS (SELECT gid, code, list_sort(list(v))[20] AS med FROM q GROUP BY 1, 2), a AS (SELECT q.gid, q.code, list_sort(list(abs(v - med)))[20] AS mad FROM q JOIN m USING (gid, code) GROUP BY 1, 2),
 o AS (SELECT q.gid, q.code, bar, CASE WHEN mad = 0 OR abs(0.6745 * (v - med) / nullif(mad, 0)) <= 3 THEN v END AS v FROM q JOIN m USING (gid, code) JOIN a USING (gid, code)) {out('gid code bar')} FROM o""")
add("f_rollrankfilt", lambda s, d: rounded(filters.rolling_rank(filled(s, d))), f"""WITH {FILLED}, l AS (SELECT gid, code, bar, v, list(v) OVER r5 AS l FROM q {WINDOWS}),
 o AS (SELECT gid, code, bar, (len(list_filter(l, lambda e: e < v)) + (len(list_filter(l, lambda e: e = v)) + 1) / 2) / len(l) AS v FROM l) {out('gid code bar')} FROM o""")
_KAMA = FILLED.replace("WITH ", "") + f""", l AS (SELECT gid, code, bar, v, lag(v) OVER w AS pv, list(v) OVER (PARTITION BY gid, code ORDER BY bar ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM q WINDOW w AS (PARTITION BY gid, code ORDER BY bar)),
 s AS (SELECT *, list_sum(list_transform(l, lambda e: abs(e - list_avg(l)))) AS sp FROM l),
 al AS (SELECT gid, code, bar, v, CASE WHEN bar = 0 OR sp < 1e-12 THEN 0 ELSE abs(v - pv) / sp * ({2 / 3 - 2 / 11!r}) + {2 / 11!r} END AS a FROM s),
 k AS (SELECT gid, code, bar, v AS y, v AS z FROM al WHERE bar = 0 UNION ALL SELECT a.gid, a.code, a.bar, k.y + a.a * (a.v - k.y), k.z + 0.5 * (k.y + a.a * (a.v - k.y) - k.z) FROM k JOIN al a ON a.gid = k.gid AND a.code = k.code AND a.bar = k.bar + 1)"""
for _n, _m, _s in (("kauama", False, "y"), ("mesama", True, "y - z")):
    add(f"f_{_n}", lambda s, d, m=_m: rounded(filters.adaptive(filled(s, d), m)), f"WITH RECURSIVE {_KAMA}, o AS (SELECT gid, code, bar, {_s} AS v FROM k) {out('gid code bar')} FROM o")
_RA, _CD, _RD = filters.wavelet_kernels(40)
add("f_wavelet_denoise", lambda s, d: rounded(filters.wavelet_denoise(filled(s, d), 40)), f"""WITH {FILLED}, {kernel('ka', _RA)}, {kernel('kd', _CD)}, {kernel('kr', _RD)},
 a AS (SELECT gid, code, k AS bar, sum(w * v) AS a FROM q JOIN ka ON j = bar GROUP BY ALL), e AS (SELECT gid, code, k, sum(w * v) AS e FROM q JOIN kd ON j = bar GROUP BY ALL),
 t AS (SELECT gid, stddev_pop(e) * sqrt(2 * ln(40)) AS t FROM e GROUP BY 1), h AS (SELECT gid, code, e.k AS c, sign(e) * greatest(abs(e) - t, 0) AS e FROM e JOIN t USING (gid)),
 r AS (SELECT gid, code, k AS bar, sum(w * e) AS r FROM h JOIN kr ON j = c GROUP BY ALL), o AS (SELECT gid, code, bar, a + coalesce(r, 0) AS v FROM a LEFT JOIN r USING (gid, code, bar)) {out('gid code bar')} FROM o""")
add("f_hilbert_phase", lambda s, d: rounded(filters.hilbert_phase(filled(s, d))))

# level 2
_POP = "CASE WHEN count(v) = 2 AND var_pop(v) > 0 THEN 0.0 WHEN count(v) >= 3 AND var_pop(v) > 0 THEN skewness(v) * (count(v) - 2) / sqrt(count(v) * (count(v) - 1)) END"
for _n, _s in {
    "sum": "coalesce(sum(v), 0)", "mean": "avg(v)", "stddev": "stddev_pop(v)", "quantile_25": "quantile_cont(v, 0.25)", "quantile_75": "quantile_cont(v, 0.75)", "median": "quantile_cont(v, 0.5)", "mean_median_diff": "avg(v) - quantile_cont(v, 0.5)",
    "skew": _POP, "kurt": "CASE WHEN var_pop(v) > 0 THEN kurtosis_pop(v) END", "skew_unbiased": "CASE WHEN count(v) >= 3 THEN skewness(v) END", "kurt_unbiased": "CASE WHEN count(v) >= 4 THEN kurtosis(v) END", "cv": "stddev_pop(v) / nullif(avg(v), 0)",
    "bop": "CASE WHEN count(v) = count(*) THEN (arg_max(v, bar) - arg_min(v, bar)) / nullif(max(v) - min(v), 0) END", "ptp": "max(v) - min(v)", "entropy": "-sum(CASE WHEN v > -1e-10 THEN v * ln(v + 1e-10) END)",
}.items():
    add(f"l2_{_n}", lambda s, d, n=_n: rounded(level2.apply(P.revenue_panel(s, d), n), 5), f"WITH {REVENUE}, o AS (SELECT gid, code, {_s} AS v FROM p GROUP BY 1, 2) {out('gid code', 5)} FROM o")
add("l2_cv_adjusted", lambda s, d: rounded(level2.cv_adjusted(P.revenue_panel(s, d)), 5), f"""WITH {REVENUE}, a AS (SELECT gid, code, avg(v) AS m, stddev_pop(v) AS s FROM p GROUP BY 1, 2), e AS (SELECT *, coalesce(quantile_cont(CASE WHEN abs(m) >= 1e-4 THEN abs(m) END, 0.1) OVER (PARTITION BY gid), 1e-4) AS e FROM a),
 o AS (SELECT gid, code, s / nullif(CASE WHEN abs(m) < 1e-4 THEN sign(m) * e + e ELSE m END, 0) AS v FROM e) {out('gid code', 5)} FROM o""")
add("l2_acf", lambda s, d: rounded(level2.autocorrelation(P.event_panel(s, d)), 5), f"""WITH {EVENTS}{_NEAR}, i AS (SELECT gid, code, bar, coalesce(v, {_INNER}) AS v FROM n), d AS (SELECT *, v - avg(v) OVER (PARTITION BY gid, code) AS d FROM i), l AS (SELECT *, lag(d) OVER (PARTITION BY gid, code ORDER BY bar) AS l FROM d),
 o AS (SELECT gid, code, avg(d * l) / nullif(avg(d * d), 0) AS v FROM l GROUP BY 1, 2) {out('gid code', 5)} FROM o""")
add("l2_quantile", lambda s, d: rounded(P.revenue_panel(s, d).groupBy("gid", "code").agg(level2.quantile(40).alias("v"))), f"WITH {REVENUE}, o AS (SELECT gid, code, quantile_cont(v, 0.4) AS v FROM p GROUP BY 1, 2) {out('gid code')} FROM o")


# groups and screens
def _flat(s, d):
    p = P.event_panel(s, d, 120)
    return p.select("code", F.col("bar").alias("t"), "v")


for _n, _f, _s in (
    ("group_daily", lambda p: groups.daily(p, 4), "SELECT t // 4 AS gid, code, t % 4 AS bar, v FROM flat"),
    ("group_half_day", lambda p: groups.half_day(p, 4), "SELECT t // 4 AS gid, code, t % 4 AS bar, v FROM flat WHERE t % 4 < 2"),
    ("group_rolling_days", lambda p: groups.rolling_days(p, 4, 3), "SELECT g AS gid, code, (t // 4 - g + 2) * 4 + t % 4 AS bar, v FROM flat, range(2, 30) r(g) WHERE t // 4 BETWEEN g - 2 AND g"),
    ("group_rolling_days_half", lambda p: groups.rolling_days(p, 4, 3, True), "SELECT g AS gid, code, (t // 4 - g + 2) * 4 + t % 4 AS bar, v FROM flat, range(2, 30) r(g) WHERE t // 4 BETWEEN g - 2 AND g AND (t // 4 - g + 2) * 4 + t % 4 < 10"),
    ("group_table_b3_d1", lambda p: experiment.regrouped(p, "6_b3_d1", 4), "SELECT g + 1 AS gid, code, (t // 4 - g + 2) * 4 + t % 4 AS bar, v FROM flat, range(2, 30) r(g) WHERE t // 4 BETWEEN g - 2 AND g"),
    ("group_table_d2", lambda p: experiment.regrouped(p, "6_d2", 4), "SELECT t // 4 + 2 AS gid, code, t % 4 AS bar, v FROM flat"),
    ("group_rows_tumbling", lambda p: groups.rows_tumbling(p, 7), "SELECT t // 7 AS gid, code, t % 7 AS bar, v FROM flat"),
    ("group_rows_sliding", lambda p: groups.rows_sliding(p, 7), "SELECT g AS gid, code, t - g AS bar, v FROM flat, range(0, 114) r(g) WHERE t BETWEEN g AND g + 6"),
):
    add(_n, lambda s, d, f=_f: rounded(f(_flat(s, d))), f"WITH {EVENTS}, o AS ({_s}) {out('gid code bar')} FROM o")


def _holed(s, d):
    return P.revenue_panel(s, d).withColumn("v", F.when(F.col("gid") != 1997, F.when(F.col("gid") == 1999, F.lit(0.0)).otherwise(F.col("v"))))


_HOLED = REVENUE + ", h AS (SELECT gid, code, bar, CASE WHEN gid <> 1997 THEN CASE WHEN gid = 1999 THEN 0.0 ELSE v END END AS v FROM p)"
add("blank_empty", lambda s, d: rounded(groups.blank_empty(_holed(s, d))), f"WITH {_HOLED}, o AS (SELECT gid, code, bar, CASE WHEN coalesce(sum(abs(v)) OVER (PARTITION BY gid), 0) <> 0 THEN v END AS v FROM h) {out('gid code bar')} FROM o")
add("screen_l1", lambda s, d: rounded(groups.screen_l1(_holed(s, d))), f"WITH {_HOLED}, o AS (SELECT a.gid, a.code, a.bar, b.v FROM h a JOIN h b ON b.gid = CASE WHEN a.gid = 1997 THEN 1996 ELSE a.gid END AND a.code = b.code AND a.bar = b.bar) {out('gid code bar')} FROM o")
add("screen_l2", lambda s, d: groups.screen_l2(_holed(s, d)).select(*(F.col(c).cast("long").alias(c) for c in ("n", "empty", "zero")), "kept"), f"""WITH {_HOLED}, g AS (SELECT gid, count(v) AS c, max(abs(v)) AS m FROM h GROUP BY 1), a AS (SELECT count(*) AS n, count(*) FILTER (c = 0) AS "empty", count(*) FILTER (m = 0) AS zero FROM g) SELECT n, "empty", zero, "empty" * 3 < n AND zero * 3 < n AS kept FROM a""")
add("drop_empty", lambda s, d: rounded(groups.drop_empty(_holed(s, d))), f"WITH {_HOLED}, o AS (SELECT gid, code, bar, v FROM h QUALIFY coalesce(sum(abs(v)) OVER (PARTITION BY gid, code), 0) <> 0 AND count(v) OVER (PARTITION BY gid, bar) > 0) {out('gid code bar')} FROM o")

# chains, evaluation
_SEARCH = ["abs_v", "diff", "rollmean_3"]


_one = {"abs_v": "abs(v)", "diff": "v - lag(v) OVER w"}
for _k in (3, 6):
    _one[f"rollmean_{_k}"] = "CASE WHEN count(v) OVER ({0}) = {1} THEN avg(v) OVER ({0}) END".format(f"PARTITION BY gid, code ORDER BY bar ROWS BETWEEN {_k - 1} PRECEDING AND CURRENT ROW", _k)


def searched(names: list[str], longest: int, fill: str) -> str:
    """SQL of every tuple with the aggregates mean and ptp."""
    parts, first = [], {"ffill": "last_value(v IGNORE NULLS) OVER (PARTITION BY gid, code ORDER BY bar ROWS UNBOUNDED PRECEDING)", "none": "v"}[fill]
    for t in chain.tuples(names, longest):
        q = f"SELECT gid, code, bar, {first} AS v FROM p"
        for x in t:
            q = f"SELECT gid, code, bar, {_one[x]} AS v FROM ({q}) WINDOW w AS (PARTITION BY gid, code ORDER BY bar)"
        parts += [f"SELECT '{fill}' AS fill, '{'>'.join(t)}' AS l1, '{a}' AS l2, gid, code, {e} AS v FROM ({q}) GROUP BY gid, code" for a, e in (("mean", "avg(v)"), ("ptp", "max(v) - min(v)"))]
    return f"WITH {REVENUE}, o AS ({' UNION ALL '.join(parts)}) SELECT fill, l1, l2, gid::BIGINT AS gid, code::BIGINT AS code, round(v, 6) + 0.0 AS v FROM o"


def _found(f):
    return f.select("fill", "l1", "l2", F.col("gid").cast("long").alias("gid"), F.col("code").cast("long").alias("code"), (F.round("v", 6) + 0.0).alias("v"))


add("chain_search", lambda s, d: _found(chain.search(P.revenue_panel(s, d), _SEARCH, ["mean", "ptp"], 2, "ffill")), searched(_SEARCH, 2, "ffill"))
# tuples of three, with windows by the length of a group: three and six bars of twelve
_EXPANDED = chain.expanded(["abs_v", "rollmean"], 12)
add("chain_search_3", lambda s, d: _found(chain.search(P.revenue_panel(s, d), chain.expanded(["abs_v", "rollmean"], 12), ["mean", "ptp"], 3, "ffill")), searched(_EXPANDED, 3, "ffill"))


def _stored_factors(s, d):
    """Written by how they were made, and only those of one fill read again, without the rejected ones."""
    path = folder(s, "factors")
    f = chain.search(P.revenue_panel(s, d), _SEARCH, ["mean", "ptp"], 1, "ffill").unionByName(chain.search(P.revenue_panel(s, d), _SEARCH, ["mean"], 1, "none"))
    P.write_factors(f, path)
    rejected = s.createDataFrame([("ffill", "diff", "ptp")], "fill string, l1 string, l2 string")
    return _found(P.drop_rejected(P.read_factors(s, path, fill="ffill"), rejected))


add("factors_stored", _stored_factors, searched(_SEARCH, 1, "ffill") + " WHERE l1 <> 'diff' OR l2 <> 'ptp'")


def factor(s, d):
    p = fills.fill(P.revenue_panel(s, d), "ffill")
    return level2.apply(level1.apply(p, "rollmean", 3), "mean")


def returns(s, d):
    """Next year's revenue of a supplier over this year's, less 1."""
    t = P.revenue_panel(s, d).groupBy("gid", "code").agg(F.sum("v").alias("s"))
    return t.select("gid", "code", (F.try_divide(F.lead("s").over(Window.partitionBy("code").orderBy("gid")), F.col("s")) - 1).alias("ret"))


_IC = REVENUE + """, f0 AS (SELECT gid, code, bar, last_value(v IGNORE NULLS) OVER (PARTITION BY gid, code ORDER BY bar ROWS UNBOUNDED PRECEDING) AS v FROM p),
 f1 AS (SELECT gid, code, CASE WHEN count(v) OVER r = 3 THEN avg(v) OVER r END AS v FROM f0 WINDOW r AS (PARTITION BY gid, code ORDER BY bar ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 fa AS (SELECT gid, code, avg(v) AS f FROM f1 GROUP BY 1, 2), tot AS (SELECT gid, code, sum(v) AS s FROM p GROUP BY 1, 2),
 re AS (SELECT gid, code, lead(s) OVER (PARTITION BY code ORDER BY gid) / nullif(s, 0) - 1 AS r FROM tot), j0 AS (SELECT * FROM fa JOIN re USING (gid, code))"""
_RANK = "CASE WHEN {0} IS NOT NULL THEN rank() OVER (PARTITION BY gid ORDER BY {0} NULLS LAST) + (count({0}) OVER (PARTITION BY gid, {0}) - 1) / 2 END"
_ICS = f"""{_IC}, j AS (SELECT *, {_RANK.format('f')} AS fk, {_RANK.format('r')} AS rk FROM j0), jj AS (SELECT gid, r AS r0, CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN f END AS x, CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN r END AS y, CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN fk END AS xk, CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN rk END AS yk FROM j),
 ic AS (SELECT gid, count(x) AS n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS ic, covar_pop(xk, yk) / nullif(stddev_pop(xk) * stddev_pop(yk), 0) AS rank_ic, count(x) / nullif(count(r0), 0) AS coverage FROM jj GROUP BY 1)"""
_ic_cols = lambda df: df.select(F.col("gid").cast("long").alias("gid"), F.col("n").cast("long").alias("n"), *(F.round(c, 6).alias(c) for c in ("ic", "rank_ic", "coverage")))
_IC_OUT = "SELECT gid::BIGINT AS gid, n, round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic, round(coverage, 6) AS coverage FROM ic"
add("ic_daily", lambda s, d: _ic_cols(evaluate.ic_daily(factor(s, d), returns(s, d))), f"WITH {_ICS} {_IC_OUT}")
add("ic_coverage", lambda s, d: _ic_cols(evaluate.ic_daily(factor(s, d), returns(s, d), True)), f"WITH {_ICS.replace('FROM j0)', 'FROM (SELECT gid, r AS r1, CASE WHEN r IS NOT NULL THEN f END AS f, CASE WHEN f IS NOT NULL THEN r END AS r FROM j0))').replace('r AS r0', 'r1 AS r0')} {_IC_OUT}")
add("ic_gated", lambda s, d: evaluate.gated(evaluate.ic_daily(factor(s, d), returns(s, d)), 0.6).select(F.round("coverage", 6).alias("coverage"), F.round("rank_ic", 6).alias("rank_ic"), "passed", "expression"), f"""WITH {_ICS}, m AS (SELECT avg(coverage) AS c, avg(rank_ic) AS r FROM ic)
 SELECT round(c, 6) AS coverage, CASE WHEN c > 0.6 THEN round(r, 6) END AS rank_ic, c > 0.6 AND abs(r) > 0.015 AS passed, CASE WHEN c <= 0.6 THEN 'low cover' WHEN abs(r) <= 0.015 THEN 'low ic' WHEN r < 0 THEN '-1*alpha' ELSE 'alpha' END AS expression FROM m""")
add("ic_summary", lambda s, d: evaluate.ic_summary(evaluate.ic_daily(factor(s, d), returns(s, d))).select(*(F.round(c, 6).alias(c) for c in ("ic", "rank_ic", "coverage")), "passed", "direction"), f"WITH {_ICS} SELECT round(avg(ic), 6) AS ic, round(avg(rank_ic), 6) AS rank_ic, round(avg(coverage), 6) AS coverage, abs(avg(ic)) > 0.015 AND abs(avg(rank_ic)) > 0.015 AS passed, sign(avg(ic))::BIGINT AS direction FROM ic")


def _factors(s, d):
    p = P.revenue_panel(s, d)
    w = level2.aggregate(p, ["mean", "stddev", "ptp", "median", "quantile_75", "skew"])
    return w.unpivot(["gid", "code"], ["mean", "stddev", "ptp", "median", "quantile_75", "skew"], "name", "v")


add("factor_corr", lambda s, d: evaluate.factor_corr(_factors(s, d)).select("a", "b", F.round("corr", 6).alias("corr"), F.col("n").cast("long").alias("n")), f"""WITH {REVENUE}, w AS (SELECT gid, code, avg(v) AS mean, stddev_pop(v) AS stddev, max(v) - min(v) AS ptp, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS quantile_75, {_POP} AS skew FROM p GROUP BY 1, 2),
 l AS (UNPIVOT w ON mean, stddev, ptp, median, quantile_75, skew INTO NAME name VALUE v) SELECT x.name AS a, y.name AS b, round(covar_pop(x.v, y.v) / nullif(stddev_pop(x.v) * stddev_pop(y.v), 0), 6) AS corr, count(*) AS n FROM l x JOIN l y ON x.gid = y.gid AND x.code = y.code AND x.name < y.name GROUP BY 1, 2""")


def _greedy(s, d):
    f, r = _factors(s, d), returns(s, d)
    scores = experiment.ic_by_name(f, r).select("name", F.round("rank_ic", 9).alias("score"))
    return evaluate.greedy(scores, evaluate.factor_corr(f, 0.7)).select("name")


_GREEDY = f"""WITH RECURSIVE {_IC.replace('WITH ', '')}, wd AS (SELECT gid, code, avg(v) AS mean, stddev_pop(v) AS stddev, max(v) - min(v) AS ptp, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS quantile_75, {_POP} AS skew FROM p GROUP BY 1, 2),
 l AS (UNPIVOT wd ON mean, stddev, ptp, median, quantile_75, skew INTO NAME name VALUE v),
 cr AS (SELECT x.name AS a, y.name AS b FROM l x JOIN l y ON x.gid = y.gid AND x.code = y.code AND x.name <> y.name GROUP BY 1, 2 HAVING abs(covar_pop(x.v, y.v) / nullif(stddev_pop(x.v) * stddev_pop(y.v), 0)) > 0.7),
 jr AS (SELECT name, gid, code, v AS f, r FROM l JOIN re USING (gid, code)),
 jk AS (SELECT name, gid, f, r, rank() OVER (PARTITION BY name, gid ORDER BY f NULLS LAST) + (count(f) OVER (PARTITION BY name, gid, f) - 1) / 2 AS fk, rank() OVER (PARTITION BY name, gid ORDER BY r NULLS LAST) + (count(r) OVER (PARTITION BY name, gid, r) - 1) / 2 AS rk FROM jr),
 dy AS (SELECT name, gid, covar_pop(fk, rk) / nullif(stddev_pop(fk) * stddev_pop(rk), 0) AS c FROM jk WHERE f IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2),
 sc AS (SELECT name, abs(round(avg(c), 9)) / (any_value(coalesce(g.n, 0)) + 3) AS k FROM dy LEFT JOIN (SELECT a, count(*) AS n FROM cr GROUP BY 1) g ON g.a = dy.name GROUP BY name),
 od AS (SELECT name, row_number() OVER (ORDER BY k DESC, name) AS i FROM sc),
 st AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS kept UNION ALL SELECT od.i, CASE WHEN len(list_intersect(st.kept, coalesce((SELECT list(b) FROM cr WHERE a = od.name), []::VARCHAR[]))) = 0 THEN list_append(st.kept, od.name) ELSE st.kept END FROM st JOIN od ON od.i = st.i + 1)
 SELECT unnest(kept) AS name FROM st WHERE i = (SELECT max(i) FROM od)"""


def _enb(s, d):
    li, part = P.table(s, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice"), P.table(s, d, "part").select("p_partkey", "p_brand")
    pnl = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("name"), F.date_trunc("month", "l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("pnl"))
    return s.createDataFrame([(i, n) for i, n in enumerate(evaluate.select_enb(*evaluate.pnl_matrix(pnl), 6))], "position long, name string")


add("select_greedy", _greedy, _GREEDY)
add("select_enb", _enb)

# strategy statistics by brand and year
_STATS = """SELECT p_brand AS alpha, year(l_shipdate)::VARCHAR AS period, sum(l_extendedprice * l_discount) / 1e5 AS ret, sum(l_extendedprice * l_tax) / 1e5 AS ret_l, sum(l_extendedprice * (l_discount - l_tax)) / 1e5 AS ret_s, corr(l_quantity, l_discount) AS "IC", avg(l_discount) / nullif(stddev_samp(l_discount), 0) AS "ICIR", avg(l_quantity) AS tvr, avg(l_extendedprice) / stddev_samp(l_extendedprice) AS sharpe, (max(l_tax) - min(l_tax)) * 100 AS dd, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS pwin, count(*)::DOUBLE AS "long", CASE WHEN p_brand LIKE '%5' THEN '1996-01-01' ELSE '1995/01/01' END AS "from" FROM lineitem JOIN part ON l_partkey = p_partkey"""
_STATS_SQL = f"stats AS ({_STATS} GROUP BY 1, 2), total AS ({_STATS.replace('year(l_shipdate)::VARCHAR', chr(39) + 'Total' + chr(39))} GROUP BY 1, 2)"


def stats(s, d, total=False):
    li = P.table(s, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity", "l_tax")
    j = li.join(P.table(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).withColumn("alpha", F.col("p_brand")).withColumn("period", F.lit("Total") if total else F.year("l_shipdate").cast("string"))
    disc = F.col("l_discount")
    return j.groupBy("alpha", "period").agg(
        (F.sum(F.col("l_extendedprice") * disc) / 1e5).alias("ret"), (F.sum(F.col("l_extendedprice") * F.col("l_tax")) / 1e5).alias("ret_l"), (F.sum(F.col("l_extendedprice") * (disc - F.col("l_tax"))) / 1e5).alias("ret_s"), evaluate.safe_corr("l_quantity", "l_discount").alias("IC"), F.try_divide(F.avg(disc), F.stddev_samp(disc)).alias("ICIR"),
        F.avg("l_quantity").alias("tvr"), F.try_divide(F.avg("l_extendedprice"), F.stddev_samp("l_extendedprice")).alias("sharpe"), ((F.max("l_tax") - F.min("l_tax")) * 100).alias("dd"), F.avg(F.when(disc > 0.05, 1.0).otherwise(0.0)).alias("pwin"), F.count("*").cast("double").alias("long"),
    ).withColumn("from", F.when(F.col("alpha").endswith("5"), "1996-01-01").otherwise("1995/01/01"))


LIMITS = classify.Thresholds(ic=0.004, icir=1.5, dd=8.5, win=0.5, ret=40.0, ret_l=30.0, tvr_max=25.6, tvr_min=25.0, cover=10.0)


def _categories(s, d):
    return stats(s, d, True).withColumn("category", classify.category(LIMITS))


_T = LIMITS
_CASE = f"""CASE WHEN "from" IS NULL THEN 'drop' WHEN "from" <> '1995/01/01' THEN 'not_run' WHEN "long" IS NULL THEN 'not_run' WHEN "long" < {_T.cover} THEN 'drop'
 WHEN coalesce(abs("IC") < {_T.ic}, true) AND NOT coalesce(tvr < {_T.tvr_min}, false) THEN 'drop' WHEN "IC" <= -{_T.ic} THEN 'negative_ic' WHEN tvr < {_T.tvr_min} THEN 'low_tvr' WHEN tvr > {_T.tvr_max} THEN 'high_tvr'
 WHEN ret >= {_T.ret} AND dd <= {_T.dd} AND "ICIR" >= {_T.icir} AND pwin >= {_T.win} AND ret_l >= {_T.ret_l} THEN 'all_pass' WHEN ret >= {_T.ret} AND dd <= {_T.dd} AND "ICIR" >= {_T.icir} AND pwin >= {_T.win} THEN 'ret_long'
 WHEN ret >= {_T.ret} AND pwin >= {_T.win} THEN 'high_dd' WHEN abs("IC") >= {_T.ic} AND ret_l >= {_T.ret_l} THEN 'low_ret_s' WHEN ret >= {_T.ret} AND dd <= {_T.dd} THEN 'low_win' WHEN ret >= {_T.ret} OR ret + tvr / 35 >= {_T.ret} THEN 'adjustable_ret' ELSE 'drop' END"""
_CATS = f"{_STATS_SQL}, cat AS (SELECT *, {_CASE} AS category FROM total)"
_BUCKET = "CASE WHEN category IN ('ret_long', 'sharpe', 'all_pass') THEN 'pass' WHEN category IN ('drop', 'not_run') THEN category ELSE 'rerun' END"
add("cls_category", lambda s, d: _categories(s, d).select("alpha", "category"), f"WITH {_CATS} SELECT alpha, category FROM cat")
add("cls_bucket", lambda s, d: _categories(s, d).select(classify.bucket().alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")), f"WITH {_CATS} SELECT {_BUCKET} AS bucket, count(*) AS n FROM cat GROUP BY 1")
add("cls_not_run", lambda s, d: classify.not_run(P.table(s, d, "part").select(F.col("p_brand").alias("alpha")).distinct(), _categories(s, d).where("category <> 'drop'")), f"WITH {_CATS} SELECT DISTINCT p_brand AS alpha FROM part WHERE p_brand NOT IN (SELECT alpha FROM cat WHERE category <> 'drop')")
_SUMS = ", ".join(f'round({f}("{m}"), 5)::{"BIGINT" if n == "count" else "DOUBLE"} AS "{m}_{n}"' for m in classify.METRICS for n, f in (("count", "count"), ("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))


def _sums(df, *by):
    return df.select(*by, *(F.round(c, 5).alias(c) if not c.endswith("_count") else F.col(c).cast("long").alias(c) for c in df.columns if c not in by))


add("stats_overall", lambda s, d: _sums(classify.summaries(stats(s, d).unionByName(stats(s, d, True)), "period"), "period"), f"WITH {_STATS_SQL}, u AS (SELECT * FROM stats UNION ALL SELECT * FROM total) SELECT period, {_SUMS} FROM u GROUP BY period")
add("stats_category", lambda s, d: _sums(classify.by_category(stats(s, d).unionByName(stats(s, d, True)), _categories(s, d)), "category", "period"), f"WITH {_CATS}, u AS (SELECT * FROM stats UNION ALL SELECT * FROM total) SELECT category, u.period AS period, {_SUMS.replace('(' + chr(34), '(u.' + chr(34))} FROM u JOIN cat USING (alpha) WHERE category <> 'not_run' GROUP BY 1, 2")
_LONG = "UNPIVOT (SELECT category, alpha, {} FROM cat) ON {} INTO NAME metric VALUE value".format(", ".join(f'round("{m}", 6) AS "{m}"' for m in classify.METRICS), ", ".join(f'"{m}"' for m in classify.METRICS))


def _extremes(s, d):
    c = _categories(s, d)
    c = c.select("category", "alpha", *(F.round(m, 6).alias(m) for m in classify.METRICS))
    return classify.extremes(c, "category").unionByName(classify.extremes(c.withColumn("category", F.lit("all")), "category"))


add("stats_extremes", _extremes, f"""WITH {_CATS}, l0 AS ({_LONG}), l AS (SELECT * FROM l0 UNION ALL SELECT 'all', alpha, metric, value FROM l0),
 r AS (SELECT *, row_number() OVER (PARTITION BY category, metric ORDER BY value DESC, alpha) AS hi, row_number() OVER (PARTITION BY category, metric ORDER BY value, alpha) AS lo FROM l)
 SELECT category, metric, max(value) FILTER (hi = 1) AS max_value, max(alpha) FILTER (hi = 1) AS max_alpha, max(value) FILTER (lo = 1) AS min_value, max(alpha) FILTER (lo = 1) AS min_alpha FROM r GROUP BY 1, 2""")
_YEARS = ["1996", "1997", "1998"]
add("stats_pivot", lambda s, d: (lambda x: x.select("category", *(F.round(y, 5).alias(f"ret_{y}") for y in _YEARS)))(classify.pivoted(stats(s, d).join(_categories(s, d).select("alpha", "category"), "alpha"), _YEARS)), f"WITH {_CATS} SELECT category, {', '.join(f'round(avg(s.ret) FILTER (s.period = {chr(39)}{y}{chr(39)}), 5) AS ret_{y}' for y in _YEARS)} FROM stats s JOIN cat USING (alpha) GROUP BY category")


_CATEGORIES = ["all_pass", "low_tvr", "drop"]
_each = lambda g, y: [(f"{g}_{m}_{n}_{y}", m, f, f"s.period = '{y}'" + ("" if g == "overall" else f" AND category = '{g}'")) for m in classify.REPORTED for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
_wide = [x for g in ("overall", *_CATEGORIES) for y in _YEARS for x in _each(g, y)]
add("stats_wide", lambda s, d: (lambda x: x.select(*(F.round(c, 5).alias(c) for c in x.columns)))(classify.wide_report(stats(s, d), _categories(s, d), _CATEGORIES, _YEARS)), f"WITH {_CATS} SELECT " + ", ".join(f'round({f}(s."{m}") FILTER ({w}), 5) AS "{c}"' for c, m, f, w in _wide) + " FROM stats s JOIN cat USING (alpha)")
add("cls_checks", lambda s, d: stats(s, d, True).select("alpha", *(c.alias(n) for n, c in classify.checks(LIMITS).items())), f"""WITH {_STATS_SQL} SELECT alpha, CASE WHEN "IC" >= {_T.ic} THEN 1 WHEN "IC" <= -{_T.ic} THEN -1 ELSE 0 END AS ic, CASE WHEN tvr > {_T.tvr_max} THEN -1 WHEN tvr < {_T.tvr_min} THEN 1 ELSE 0 END AS tvr,
 CASE WHEN "long" >= {_T.cover} THEN 1 WHEN "long" < {_T.cover} THEN -1 ELSE 0 END AS cover, coalesce(ret >= {_T.ret}, false) AS ret, coalesce(ret_l >= {_T.ret_l}, false) AS ret_l, coalesce("ICIR" >= {_T.icir}, false) AS icir, coalesce(sharpe >= {_T.sharpe}, false) AS sharpe, coalesce(pwin >= {_T.win}, false) AS win, coalesce(dd <= {_T.dd}, false) AS dd FROM total""")
_CODE = "concat(p_brand, ': tvr_max=0.6, tvr_min  = 0.15 # was tvr_max = ', p_size)"
add("cls_patch", lambda s, d: P.table(s, d, "part").select("p_partkey", classify.patched(F.expr(_CODE), LIMITS).alias("text")), f"SELECT p_partkey, regexp_replace(regexp_replace({_CODE}, 'tvr_max\\s*=\\s*[\\d.]+', 'tvr_max = {_T.tvr_max * 0.9:.3f}', 'g'), 'tvr_min\\s*=\\s*[\\d.]+', 'tvr_min = {_T.tvr_min * 1.1:.3f}', 'g') AS text FROM part".replace("\\\\", "\\"))


def _csv(second: bool):
    """Statistics written as CSV files, one a strategy with Total as its last row, and where they are."""

    def write(s, d):
        path = folder(s, "stats")
        rows = stats(s, d).unionByName(stats(s, d, True)).select("alpha", F.lit("a").alias("x"), F.lit("b").alias("y"), *([F.lit(0).alias("_c0")] if second else []), "period", *classify.METRICS)
        rows.repartition("alpha").sortWithinPartitions("alpha", "x", "y", "period").write.partitionBy("alpha", "x", "y").option("header", True).csv(path)
        return f"{path}/*/*/*"

    return write


def _read(s, path, **how):
    r = P.read_stats(s, path, **how)
    return r.select(F.url_decode(F.regexp_replace("alpha", "^alpha=", "")).alias("alpha"), "period", *(F.round(c, 5).alias(c) for c in classify.METRICS))


_CSV_SQL = f"WITH {_STATS_SQL} SELECT alpha, period, " + ", ".join(f'round("{m}", 5) AS "{m}"' for m in classify.METRICS)
add("csv_total", lambda s, d: _read(s, _csv(False)(s, d), total=True), f"{_CSV_SQL} FROM total")
add("csv_yearly", lambda s, d: _read(s, _csv(False)(s, d), total=False), f"{_CSV_SQL} FROM stats")
add("csv_without_last", lambda s, d: _read(s, _csv(False)(s, d), exclude_last=True), f"{_CSV_SQL} FROM stats")
add("csv_second_index", lambda s, d: _read(s, _csv(True)(s, d)), f"{_CSV_SQL} FROM stats UNION ALL SELECT alpha, period, " + ", ".join(f'round("{m}", 5) AS "{m}"' for m in classify.METRICS) + " FROM total")


def _slice(s, d):
    """A panel made and stored if it is not there, and the part of it between two times, without codes that are empty in it."""
    path = folder(s, "panel")
    make = lambda: _flat(s, d).where("code % 5 > 0 OR t > 60").select("code", F.col("t").alias("ts"), "v")
    files.materialised(s, path, make)
    files.materialised(s, path, lambda: 1 / 0)
    return rounded(files.read_slice(s, path, "10", "30").select("code", "ts", "v"))


add("panel_slice", _slice, f"WITH {EVENTS}, x AS (SELECT code, t AS ts, v FROM flat WHERE (code % 5 > 0 OR t > 60) AND t BETWEEN 10 AND 30), o AS (SELECT * FROM x WHERE code IN (SELECT code FROM x WHERE v IS NOT NULL)) {out('code ts')} FROM o")
add("artefact_upsert", lambda s, d: P.upsert(P.table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("content")), P.table(s, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("new")).otherwise(F.col("n_nationkey").cast("string")).alias("content")).unionByName(P.table(s, d, "region").select(F.concat(F.lit("r"), "r_name").alias("name"), F.lit("region").alias("content")))), "SELECT n_name AS name, CASE WHEN n_nationkey % 6 = 0 THEN 'new' ELSE n_nationkey::VARCHAR END AS content FROM nation UNION ALL SELECT concat('r', r_name), 'region' FROM region")


def _names(s, d):
    texts = ["aroonosc_6", "quantile_25", "quantile_40", "savgolfilt(7, 3)", "f(2,3)", "abs_v", "rollmean_12"]
    tables = ["30_b10_d1", "30_b10", "30_d1", "5"]
    show = lambda x: ",".join("" if y is None else str(y) for y in x)
    rows = [(t, chain.parse(t)[0], show(chain.parse(t)[1])) for t in texts] + [(t, "table", show(chain.parse_table(t).values())) for t in tables]
    return s.createDataFrame(rows, "text string, name string, args string")


add("names_parsed", _names, "SELECT * FROM (VALUES ('aroonosc_6', 'aroonosc', '6'), ('quantile_25', 'quantile_25', ''), ('quantile_40', 'quantile', '40'), ('savgolfilt(7, 3)', 'savgolfilt', '7,3'), ('f(2,3)', 'f', '2,3'), ('abs_v', 'abs_v', ''), ('rollmean_12', 'rollmean', '12'), ('30_b10_d1', 'table', '30,10,1'), ('30_b10', 'table', '30,10,'), ('30_d1', 'table', '30,,1'), ('5', 'table', '5,,')) t(text, name, args)")


# composition: panels by day and bar
def _pair(s, d):
    e = P.table(s, d, "events").select(F.col("user_id").cast("long").alias("code"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("day"), F.floor(F.hour("ts") / 6).cast("long").alias("bar"), "value", "event_type")
    one = lambda c: e.where(c).groupBy(*compose.KEYS).agg(F.avg("value").alias("v"))
    return {"a": one("event_type IN ('click', 'view')"), "b": one("event_type = 'purchase'")}


_PAIR = """e AS (SELECT user_id AS code, datediff('day', DATE '2024-01-01', ts::DATE) AS day, hour(ts) // 6 AS bar, value, event_type FROM events), a AS (SELECT code, day, bar, avg(value) AS v FROM e WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3), b AS (SELECT code, day, bar, avg(value) AS v FROM e WHERE event_type = 'purchase' GROUP BY 1, 2, 3),
 al AS (SELECT code, day, bar, a.v AS a, b.v AS b FROM a FULL JOIN b USING (code, day, bar) WHERE code IN (SELECT code FROM a INTERSECT SELECT code FROM b) AND (day, bar) IN (SELECT (day, bar) FROM (SELECT day, bar FROM a INTERSECT SELECT day, bar FROM b)))"""
_kd = "SELECT code::BIGINT AS code, day::BIGINT AS day, bar::BIGINT AS bar"
add("panel_align", lambda s, d: compose.align(_pair(s, d)).select(*compose.KEYS, F.round("a", 6).alias("a"), F.round("b", 6).alias("b")), f"WITH {_PAIR} {_kd}, round(a, 6) AS a, round(b, 6) AS b FROM al")
for _n, _f, _s in (
    ("safe_add", lambda a, b: compose.safe_arithmetic([a, b], "add"), "CASE WHEN coalesce(a, b) IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END"),
    ("safe_sub", lambda a, b: compose.safe_scalar_first([a, b], "sub"), "coalesce(a - coalesce(b, 0), 0)"),
    ("safe_arith_panel_fill", lambda a, b: compose.safe_arithmetic([a, b], "div", [1.0, 2.0]), "CASE WHEN coalesce(a, b) IS NOT NULL THEN coalesce(a, 1) / nullif(coalesce(b, 2), 0) END"),
):
    add(_n, lambda s, d, f=_f: rounded(compose.align(_pair(s, d)).select(*compose.KEYS, f(F.col("a"), F.col("b")).alias("v"))), f"WITH {_PAIR}, o AS (SELECT code, day, bar, {_s} AS v FROM al) {_kd}, round(v, 6) + 0.0 AS v FROM o")
_DAYS = EVENTS + ", dy AS (SELECT code, t // 4 AS day, t % 4 AS bar, v FROM flat)"


def _days(s, d):
    return groups.daily(_flat(s, d), 4).select("code", F.col("gid").alias("day"), "bar", "v")


add("roll_same_time", lambda s, d: rounded(compose.roll_same_time(_days(s, d), 5)), f"WITH {_DAYS}, o AS (SELECT code, day, bar, avg(v) OVER (PARTITION BY code, bar ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM dy) {_kd}, round(v, 6) + 0.0 AS v FROM o")
add("shift_same_time", lambda s, d: rounded(compose.shift_same_time(_days(s, d), 2)), f"WITH {_DAYS}, o AS (SELECT code, day, bar, lag(v, 2) OVER (PARTITION BY code, bar ORDER BY day) AS v FROM dy) {_kd}, round(v, 6) + 0.0 AS v FROM o")


def _spread(s, d):
    li = P.table(s, d, "lineitem")
    g = li.groupBy(F.col("l_suppkey").cast("long").alias("code"), F.year("l_shipdate").cast("long").alias("day"), F.month("l_shipdate").cast("long").alias("bar"))
    p = g.agg(F.avg("l_extendedprice").alias("close"), F.min("l_extendedprice").alias("bid"), F.max("l_extendedprice").alias("ask"), F.sum("l_quantity").alias("big"), F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))).alias("large"), F.sum(F.when(F.col("l_tax") > 0.04, F.col("l_quantity"))).alias("med"))
    return rounded(compose.spread_factor(p))


add("spread_factor", _spread, f"""WITH p AS (SELECT l_suppkey AS code, year(l_shipdate) AS day, month(l_shipdate) AS bar, avg(l_extendedprice) AS close, min(l_extendedprice) AS bid, max(l_extendedprice) AS ask, sum(l_quantity) AS big, sum(l_quantity) FILTER (l_discount > 0.05) AS large, sum(l_quantity) FILTER (l_tax > 0.04) AS med FROM lineitem GROUP BY 1, 2, 3),
 x AS (SELECT code, day, bar, nullif(100 * (ask - bid) / nullif(close, 0) / nullif(sqrt(nullif(coalesce(big, 0) + coalesce(large, 0) + coalesce(med, 0), 0)), 0), 0) AS v FROM p), o AS (SELECT code, day, bar, coalesce(v, quantile_cont(v, 0.5) OVER (PARTITION BY code)) AS v FROM x) {_kd}, round(v, 6) + 0.0 AS v FROM o""")
add("event_bars", lambda s, d: streaming.bars(P.table(s, d, "events")).select(F.col("code").cast("long").alias("code"), F.date_format("ts", "yyyy-MM-dd HH").alias("ts"), F.round("v", 6).alias("v"), F.col("n").cast("long").alias("n")), "SELECT user_id AS code, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS ts, round(avg(value), 6) AS v, count(*) AS n FROM events GROUP BY 1, 2")


def _by_line(s, d):
    t = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("long")
    seen = P.table(s, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("code"), t.alias("t")).agg(F.avg("l_quantity").alias("v"))
    return groups.daily(P.on_grid(seen, 84), 12)


add("panel_wide_long", lambda s, d: rounded(P.long(P.wide(_by_line(s, d), [1, 2, 3, 4, 5, 6, 7]))), f"""WITH seen AS (SELECT l_linenumber AS code, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
 o AS (SELECT t // 12 AS gid, code, t % 12 AS bar, v FROM range(84) r(t) CROSS JOIN range(1, 8) c(code) LEFT JOIN seen USING (code, t)) {out('gid code bar')} FROM o""")


def _experiment(s, d):
    x = experiment.Experiment(("none", "ffill"), ("abs_v", "diff", "rollmean_3"), ("mean", "ptp", "stddev"), 2, 0.01, 0.9)
    return experiment.run(P.revenue_panel(s, d), returns(s, d), x).select("name", F.round("ic", 6).alias("ic"), F.round("rank_ic", 6).alias("rank_ic"), "direction", "spec")


add("experiment", _experiment)


def _tables(s, d):
    """Windows drawn at random from two parts of a range, over lookbacks and delays."""
    x = experiment.Experiment(("none",), ("abs_v", "rollmean"), ("mean", "ptp"), 1, 0.0, 0.95).drawn({"rollmean": (2, 4)}, 2, 5)
    flat = P.revenue_panel(s, d).select("code", ((F.col("gid") - 1995) * 12 + F.col("bar")).alias("t"), "v")
    r = returns(s, d).withColumn("gid", F.col("gid") - 1995)
    return experiment.run_tables(flat, r, x, 30, 12, (0, 2), (0, 1)).select("table", "name", F.round("ic", 6).alias("ic"), "direction")


add("experiment_tables", _tables)
