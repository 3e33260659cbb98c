"""Aggregates of a group's series to one value, all from one groupBy; and the repair of ±inf across codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import fills
from quillon.operators.level1 import infinite, repaired_by
from quillon.sources.panel import over_time, val, whole, with_stats


def _m():
    return F.count(val())


AGGREGATES = {
    "sum": lambda: F.coalesce(F.sum(val()), F.lit(0.0)),
    "mean": lambda: F.avg(val()),
    "stddev": lambda: F.stddev_pop(val()),
    "quantile_25": lambda: F.percentile(val(), F.lit(0.25)),
    "quantile_75": lambda: F.percentile(val(), F.lit(0.75)),
    "median": lambda: F.percentile(val(), F.lit(0.5)),
    "mean_median_diff": lambda: F.avg(val()) - F.percentile(val(), F.lit(0.5)),
    "skew": lambda: F.skewness(val()),
    "kurt": lambda: F.kurtosis(val()),
    "skew_unbiased": lambda: F.when(_m() >= 3, F.skewness(val()) * F.sqrt(_m() * (_m() - 1)) / (_m() - 2)),
    "kurt_unbiased": lambda: F.when(_m() >= 4, (_m() - 1) / ((_m() - 2) * (_m() - 3)) * ((_m() + 1) * F.kurtosis(val()) + 6)),
    "cv": lambda: F.try_divide(F.stddev_pop(val()), F.avg(val())),
    "bop": lambda: F.when(_m() == F.count("*"), F.try_divide(F.max_by(val(), "bar") - F.min_by(val(), "bar"), F.max(val()) - F.min(val()))),
    "ptp": lambda: F.max(val()) - F.min(val()),
    "entropy": lambda: -F.sum(F.when(val() > -1e-10, val() * F.ln(val() + 1e-10))),
}


def quantile(percent: float):
    return F.percentile(val(), F.lit(percent / 100))


def has_infinite(panel: DataFrame) -> bool:
    return not panel.where(infinite(val())).isEmpty()


def aggregate(panel: DataFrame, names: list[str], repair: bool = True) -> DataFrame:
    """(gid, code, one column an aggregate); ±inf in the input is repaired across codes at each bar, and in the results across the group's codes.

    ``repair`` False is for panels that are known to have no infinities.
    """
    f = repaired_by(panel.select("gid", "code", "bar", "v"), ["gid", "bar"]) if repair else panel
    out = f.groupBy("gid", "code").agg(*(AGGREGATES[n]().alias(n) for n in names))
    if not repair:
        return out
    finite = {n: F.when(~infinite(F.col(n)) & ~F.isnan(n), F.col(n)) for n in names}
    stats = {f"_{k}_{n}": g(finite[n]) for n in names for k, g in (("most", F.max), ("least", F.min))}
    inf = float("inf")
    fixed = lambda n: F.when(F.col(n) == inf, F.col(f"_most_{n}")).when(F.col(n) == -inf, F.col(f"_least_{n}")).otherwise(finite[n]).alias(n)
    return with_stats(out, ["gid"], **stats).select("gid", "code", *(fixed(n) for n in names))


def apply(panel: DataFrame, name: str, *args) -> DataFrame:
    """(gid, code, v), ±inf in the input repaired across codes at each bar and in the result across the group's codes.

    quantile takes its percentage, acf its lag.
    """
    if name.startswith("acf"):
        made = lambda f: autocorrelation(f, int(args[0]) if args else 1)
    elif name == "cv_adjusted":
        made = cv_adjusted
    elif name == "quantile":
        made = lambda f: f.groupBy("gid", "code").agg(quantile(float(args[0])).alias("v"))
    else:
        made = lambda f: f.groupBy("gid", "code").agg(AGGREGATES[name]().alias("v"))
    if not has_infinite(panel):
        return made(panel).select("gid", "code", "v")
    out = made(repaired_by(panel.select("gid", "code", "bar", "v"), ["gid", "bar"]))
    return repaired_by(out.select("gid", "code", "v"), ["gid"]).select("gid", "code", "v")


def cv_adjusted(panel: DataFrame) -> DataFrame:
    """Deviation over mean, with means within 1e-4 of 0 replaced by the group's tenth percentile of the others' sizes."""
    s = panel.groupBy("gid", "code").agg(F.avg(val()).alias("m"), F.stddev_pop(val()).alias("s"))
    far = F.when(F.abs("m") >= 1e-4, F.abs("m"))
    s = with_stats(s, ["gid"], _eps=F.percentile(far, F.lit(0.1)))
    eps = F.coalesce("_eps", F.lit(1e-4))
    m = F.when(F.abs("m") < 1e-4, F.signum("m") * eps + eps).otherwise(F.col("m"))
    return s.select("gid", "code", F.try_divide("s", m).alias("v"))


def autocorrelation(panel: DataFrame, lag: int = 1) -> DataFrame:
    """Mean product of deviations ``lag`` bars apart over the variance, gaps between values interpolated."""
    p = panel.select("gid", "code", "bar", fills.linear(False).alias("v"))
    p = p.withColumn("d", val() - F.avg(val()).over(whole())).withColumn("l", F.lag("d", lag).over(over_time()))
    return p.groupBy("gid", "code").agg(F.try_divide(F.avg(F.col("d") * F.col("l")), F.avg(F.col("d") * F.col("d"))).alias("v"))
