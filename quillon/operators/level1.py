"""Shape-preserving transforms of a panel: over time within (gid, code), across codes within (gid, bar)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.elementwise import ELEMENTWISE
from quillon.sources.panel import cross, over_time, roll, so_far, val, whole, with_stats

INF = float("inf")


def repaired(v: Column, window) -> Column:
    """±inf to the largest and smallest finite value of the window; NULL if it has none."""
    f = F.when((v < INF) & (v > -INF), v)
    return F.when(v == INF, F.max(f).over(window)).when(v == -INF, F.min(f).over(window)).otherwise(f)


def infinite(v: Column) -> Column:
    return (v == INF) | (v == -INF)


def repaired_by(panel: DataFrame, by: list[str]) -> DataFrame:
    """The panel with ±inf repaired by the finite values of each key, which are aggregated and joined, not windowed."""
    f = F.when((val() < INF) & (val() > -INF), val())
    p = with_stats(panel, by, _most=F.max(f), _least=F.min(f))
    v = F.when(val() == INF, F.col("_most")).when(val() == -INF, F.col("_least")).otherwise(f)
    return p.withColumn("v", v).drop("_most", "_least")


def filled_inf(panel: DataFrame) -> DataFrame:
    """The older repair: a series with at most one value that is neither NULL nor infinite keeps its infinities."""
    usable = F.count(F.when((val() < INF) & (val() > -INF), 1)).over(whole())
    return panel.select("gid", "code", "bar", F.when(usable > 1, repaired(val(), whole())).otherwise(val()).alias("v"))


def full(value: Column, n: int) -> Column:
    """The value where the frame has n rows without NULL."""
    return F.when(F.count(val()).over(roll(n)) == n, value)


def _unbiased_skew(v, w):
    m = F.count(v).over(w)
    return F.when(m >= 3, F.skewness(v).over(w) * F.sqrt(m * (m - 1)) / (m - 2))


def _unbiased_kurt(v, w):
    m = F.count(v).over(w)
    return F.when(m >= 4, (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * F.kurtosis(v).over(w) + 6))


def _plain_moment(v, w, k: int):
    """Mean of the k-th powers of deviations over the sample deviation (less 3 for the fourth), from power sums."""
    m, n, s = F.avg(v).over(w), F.count(v).over(w), F.stddev_samp(v).over(w)
    p2, p3, p4 = (F.avg(F.pow(v, F.lit(i))).over(w) for i in (2, 3, 4))
    top = p3 - 3 * m * p2 + 2 * m * m * m if k == 3 else p4 - 4 * m * p3 + 6 * m * m * p2 - 3 * m * m * m * m
    return F.when(F.max(v).over(w) == F.min(v).over(w), 0.0).when(n > 1, top / F.pow(s, F.lit(k)) - (3 if k == 4 else 0))


def rolling(n: int) -> dict[str, Column]:
    r = roll(n)
    position = F.row_number().over(over_time())
    zscore = F.try_divide(val() - F.avg(val()).over(r), F.stddev_samp(val()).over(r))
    there = lambda *c: F.when(val().isNotNull(), F.struct(val(), *c))
    hi, lo = F.max_by("bar", there(-F.col("bar"))).over(r), F.min_by("bar", there(F.col("bar"))).over(r)
    return {
        "rollmean": full(F.avg(val()).over(r), n), "rollsum": full(F.sum(val()).over(r), n), "rollmax": full(F.max(val()).over(r), n), "rollmin": full(F.min(val()).over(r), n),
        "rollstd": full(F.stddev_samp(val()).over(r), n), "rollzscore": full(zscore, n), "rollmedian": full(F.percentile(val(), F.lit(0.5)).over(r), n),
        "rollskew": F.when(position >= n, _unbiased_skew(val(), r)), "rollkurt": F.when(position >= n, _unbiased_kurt(val(), r)), "aroonosc": full((hi - lo) * 100.0 / n, n),
        # older forms: any gap in the frame gives NULL
        "rollskew_whole": full(_unbiased_skew(val(), r), n), "rollkurt_whole": full(_unbiased_kurt(val(), r), n),
        # a frame with gaps counts the values it has; one without any is NULL
        "aroonosc_masked": F.when((position >= n) & (F.count(val()).over(r) > 0), (hi - lo) * 100.0 / n),
        # moments by the sample deviation, 0 where that is 0, from three and four values
        "rollskew_plain": F.when(F.count(val()).over(r) >= 3, _plain_moment(val(), r, 3)), "rollkurt_plain": F.when(F.count(val()).over(r) >= 4, _plain_moment(val(), r, 4)),
    }


ROLLING = ("rollmean", "rollsum", "rollmax", "rollmin", "rollstd", "rollzscore", "rollmedian", "rollskew", "rollkurt", "aroonosc", "rollskew_whole", "rollkurt_whole", "aroonosc_masked", "rollskew_plain", "rollkurt_plain")


def _zero():
    return F.coalesce(val(), F.lit(0.0))


def _row():
    return F.row_number().over(over_time())


def _mean():
    return F.sum(_zero()).over(so_far()) / _row()


def _std():
    return F.when(_row() > 1, F.stddev_samp(_zero()).over(so_far()))


EXPANDING = {
    "expandmean": lambda: F.when(val().isNotNull(), _mean()),
    "expandsum": lambda: F.sum(_zero()).over(so_far()),
    "expandstd": lambda: F.when(val().isNotNull(), _std()),
    "expandmax": lambda: F.when(val().isNotNull(), F.max(val()).over(so_far())),
    "expandmin": lambda: F.when(val().isNotNull(), F.min(val()).over(so_far())),
    "expandzscore": lambda: F.try_divide(val() - _mean(), _std()),
    "expandskew": lambda: _unbiased_skew(val(), so_far()),
    "expandkurt": lambda: _unbiased_kurt(val(), so_far()),
}


def _diff():
    return val() - F.lag(val()).over(over_time())


def _sign():
    return F.coalesce(F.signum(_diff()), F.lit(0.0))


def _next():
    return F.lead(val()).over(over_time())


def _ahead():
    return F.when(_next() - val() > 0, 1.0).when(_next().isNotNull() & val().isNotNull(), -1.0)


CHANGE = {"diff": _diff, "diff_lead": lambda: _next() - val(), "trewgt": lambda: val() * _sign(), "trend_sign": lambda: _next() * _ahead()}


def reversal(panel: DataFrame) -> DataFrame:
    """Adds ``dev``, how many deviations the change at each bar lies from its mean, and ``lead_dev`` for the change to the next bar."""
    p = panel.withColumn("_d", _diff())
    dev = F.try_divide(F.abs(F.col("_d") - F.avg("_d").over(whole())), F.stddev_pop("_d").over(whole()))
    p = p.withColumn("dev", dev)
    return p.withColumn("lead_dev", F.lead("dev").over(over_time())).withColumn("sign", _sign()).withColumn("ahead", _ahead()).withColumn("nxt", _next()).drop("_d")


def _flip(c: str, otherwise: float):
    return F.when(F.col(c) > 1.5, -1.0).otherwise(otherwise)


REVERSAL = {
    "revwtg": lambda: val() * _flip("dev", 0.0),
    "reversal_sign": lambda: F.col("nxt") * _flip("lead_dev", 1.0),
    "trerevwtg": lambda: val() * (_flip("dev", 0.0) + F.col("sign")),
    "trerev_sign": lambda: F.col("nxt") * (F.col("ahead") + _flip("lead_dev", 1.0)),
}


def _rank_window(*more):
    return Window.partitionBy("gid", "bar").orderBy(val().asc_nulls_last(), *more)


def binned(bins: int) -> Column:
    lo, hi, gaps = F.min(val()).over(whole()), F.max(val()).over(whole()), F.count("*").over(whole()) - F.count(val()).over(whole())
    return F.when(gaps > 0, val()).otherwise(F.coalesce(F.least(F.width_bucket(val(), lo, hi, F.lit(bins)), F.lit(bins)), F.lit(bins)).cast("double"))


def bucketed(bins: int) -> Column:
    """Bins from 0 (the smallest value) to ``bins``, closed on the right; a series with gaps stays as it is."""
    lo, hi, gaps = F.min(val()).over(whole()), F.max(val()).over(whole()), F.count("*").over(whole()) - F.count(val()).over(whole())
    at = F.ceil((val() - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins).cast("double")
    return F.when(gaps > 0, val()).otherwise(F.coalesce(F.least(at, F.lit(float(bins))), F.lit(0.0)))


def _above(limit: float) -> tuple[dict[str, Column], Column]:
    """Aggregates of |v|, and whether its 0.85 quantile is above the limit: the two values that the quantile lies
    between are known from their counts, or are the neighbours of the limit."""
    a, tag = F.abs(val()), str(limit).replace(".", "_")
    stats = {f"_n{tag}": F.count(a), f"_c{tag}": F.count(F.when(a <= limit, 1)), f"_lo{tag}": F.max(F.when(a <= limit, a)), f"_hi{tag}": F.min(F.when(a > limit, a))}
    at = 0.85 * (F.col(f"_n{tag}") - 1)
    k, c = F.floor(at), F.col(f"_c{tag}")
    lo, hi = F.col(f"_lo{tag}"), F.col(f"_hi{tag}")
    between = lo + (at - k) * (hi - lo) > limit
    return stats, F.when(k >= c, True).when(k + 1 < c, False).when(at == k, False).otherwise(F.coalesce(between, F.lit(False)))


def scaled(panel: DataFrame, fn, back: bool) -> DataFrame:
    """A function of values scaled by 0.1 in groups whose 0.85 quantile of sizes is above 10, and by 10 where it is below 0.1.

    Only which side of 10 and 0.1 the quantile lies on counts, which sums, counts and extremes tell: no group is sorted.
    """
    high, is_high = _above(10.0)
    # below 0.1: not above the largest double below 0.1
    low, not_low = _above(0.09999999999999999)
    p = with_stats(panel, ["gid"], **high, **low)
    s = F.when(is_high, 0.1).when(F.col("_n10_0").isNull() | (F.col("_n10_0") == 0), 1.0).when(~not_low, 10.0).otherwise(1.0)
    return p.select("gid", "code", "bar", (fn(val() * s) / s if back else fn(val() * s)).alias("v"))


def section_z(panel: DataFrame) -> DataFrame:
    p = with_stats(panel, ["gid", "bar"], _m=F.avg(val()), _s=F.stddev_pop(val()))
    return p.select("gid", "code", "bar", F.try_divide(val() - F.col("_m"), F.col("_s")).alias("v"))


def normalised(s: float = 1.0) -> Column:
    lo, hi = F.min(val()).over(whole()), F.max(val()).over(whole())
    return F.when(hi - lo < 1e-9, F.when(val().isNotNull(), 0.0)).otherwise(((val() - lo) / F.nullif(hi - lo, F.lit(0.0)) * 2 - 1) * s)


CROSS_SECTION = {
    "pct_rank": lambda: F.when(val().isNotNull(), (F.row_number().over(_rank_window("code")) - 1) / F.count(val()).over(cross())),
    "pct_rank_avg": lambda: F.when(val().isNotNull(), (F.rank().over(_rank_window()) + (F.count(val()).over(Window.partitionBy("gid", "bar", "v")) - 1) / 2) / F.count(val()).over(cross())),
    "bin": lambda: binned(10),
    "apo": lambda: F.abs(val() - F.avg(val()).over(whole())),
    "bin_right": lambda: bucketed(10),
    "normalize": lambda: normalised(),
}
#: those that need statistics of a bar or a group
JOINED = {"sec_zsc": section_z, "sinh_scaled": lambda p: scaled(p, F.sinh, True), "cosh_scaled": lambda p: scaled(p, F.cosh, False)}

#: transforms whose finite inputs can give ±inf; only these need a repair
OVERFLOWS = frozenset({"exp", "lg1p", "tan", "sinh", "cosh", "reciprocal"})


def known(name: str) -> bool:
    return name in ELEMENTWISE or name in CROSS_SECTION or name in JOINED or name in CHANGE or name in EXPANDING or name in REVERSAL


def apply(panel: DataFrame, name: str, *args, **settings) -> DataFrame:
    """The panel with ``v`` transformed; ±inf that the transform made is repaired over time.

    Rolling functions take their number of bars, bin the number of bins, normalize its factor, filters
    their settings; more arguments than a function has are an error.
    """
    takes = 1 if name in ROLLING or name in ("bin", "bin_right", "normalize") else 0
    if known(name) or name in ROLLING:
        if len(args) > takes or settings:
            raise ValueError(f"{name} takes {takes} arguments")
    if name in REVERSAL:
        return reversal(panel).select("gid", "code", "bar", REVERSAL[name]().alias("v"))
    if name in JOINED:
        return JOINED[name](panel)
    direct = CROSS_SECTION | CHANGE | EXPANDING
    if name in ELEMENTWISE:
        made = ELEMENTWISE[name](val())
    elif args and name in ("bin", "bin_right", "normalize"):
        made = {"bin": binned, "bin_right": bucketed, "normalize": normalised}[name](args[0])
    elif name in direct:
        made = direct[name]()
    elif name in ROLLING:
        made = rolling(int(args[0]) if args else 5)[name]
    else:
        from quillon.operators import filters

        return filters.apply(panel, name, *args, **settings)
    out = panel.select("gid", "code", "bar", made.alias("v"))
    return out.withColumn("v", repaired(val(), whole())) if name in OVERFLOWS else out
