"""Gap filling of a panel within its groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.sources.panel import onward, over_time, so_far, val, whole, with_stats



def _neighbours():
    at = F.when(val().isNotNull(), F.col("bar"))
    return F.last(val(), True).over(so_far()), F.last(at, True).over(so_far()), F.first(val(), True).over(onward()), F.first(at, True).over(onward())


def linear(flat_ends: bool = True):
    """Straight lines between neighbours; ends flat, or left open."""
    pv, pb, nv, nb = _neighbours()
    inner = pv + (nv - pv) * (F.col("bar") - pb) / F.nullif(nb - pb, F.lit(0))
    return F.coalesce(val(), inner, *([pv, nv] if flat_ends else []))


def extrapolated():
    """Straight lines, continued through the two outermost valid points at the ends; fewer than two valid give NULL."""
    at = F.when(val().isNotNull(), F.col("bar"))
    nth = lambda c, k, w: F.nth_value(c, k, True).over(w)
    back = Window.partitionBy("gid", "code").orderBy(F.col("bar").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = lambda w: nth(val(), 1, w) + (nth(val(), 2, w) - nth(val(), 1, w)) * (F.col("bar") - nth(at, 1, w)) / (nth(at, 2, w) - nth(at, 1, w))
    pv, _, nv, _ = _neighbours()
    return F.when(F.count(val()).over(whole()) >= 2, F.coalesce(linear(False), F.when(pv.isNull(), line(over_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).when(nv.isNull(), line(back))))


def knn(panel: DataFrame, k: int = 5, digits: int | None = None) -> DataFrame:
    """Missing cells get the mean of the ``k`` nearest bars that have the code, by distance over shared codes; else the column's mean.

    Codes without any value stay empty; equal distances go to the earlier bar. ``digits`` rounds squared
    distances before they are compared, for agreement with another order of summing. Each series is one
    array. Distances are summed map-side over the pairs of bars of each: what is shuffled is bars
    squared for each group and task, whatever the number of codes. The bars of a group, ranked for
    each bar by distance, are one array a group, joined to its series; a gap takes the first that have the code.
    """
    s = panel.groupBy("gid", "code").agg(F.array_sort(F.collect_list(F.struct("bar", "v"))).alias("s"))
    seen = F.expr("filter(s, e -> e.v IS NOT NULL)")
    pairs = s.select("gid", seen.alias("s")).where("size(s) > 0")
    codes = pairs.groupBy("gid").agg(F.count("*").alias("f"))
    d = pairs.select("gid", "s", F.posexplode("s").alias("i", "a")).select("gid", "a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("b"))
    d = d.groupBy("gid", F.col("a.bar").alias("p"), F.col("b.bar").alias("q")).agg(F.sum((F.col("a.v") - F.col("b.v")) ** 2).alias("s"), F.count("*").alias("m"))
    d = d.select("gid", F.explode(F.array(F.struct(F.col("p").alias("bar"), F.col("q").alias("donor")), F.struct(F.col("q").alias("bar"), F.col("p").alias("donor")))).alias("x"), "s", "m").select("gid", "x.*", "s", "m")
    d2 = F.col("f") / F.col("m") * F.col("s")
    d = d.join(codes.withColumnRenamed("gid", "g"), F.col("gid") == F.col("g")).select("gid", "bar", "donor", (d2 if digits is None else F.round(d2, digits)).alias("d2"))
    near = d.groupBy("gid", "bar").agg(F.expr("transform(array_sort(collect_list(struct(d2, donor))), e -> e.donor)").alias("donors"))
    near = near.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("bar", "donors"))).alias("near")).withColumnRenamed("gid", "g")
    j = s.join(near, F.col("gid") == F.col("g"), "left").withColumn("have", F.map_from_entries(F.expr("transform(filter(s, e -> e.v IS NOT NULL), e -> struct(e.bar, e.v))")))
    mean = lambda a: f"aggregate({a}, 0D, (t, x) -> t + x, t -> if(size({a}) = 0, NULL, t / size({a})))"
    donors = f"slice(filter(coalesce(near[e.bar], array()), b -> map_contains_key(have, b)), 1, {k})"
    filled = f"transform(s, e -> struct(e.bar AS bar, coalesce(e.v, transform(array(transform({donors}, b -> have[b])), a -> {mean('a')})[0], {mean('map_values(have)')}) AS v))"
    return j.select("gid", "code", F.explode(F.expr(filled)).alias("e")).select("gid", "code", "e.bar", "e.v")


FILLS = {
    "none": val,
    "ffill": lambda: F.last(val(), True).over(so_far()),
    "bfill": lambda: F.first(val(), True).over(onward()),
    "linear_interp": linear,
    "time_mean": lambda: F.coalesce(val(), F.avg(val()).over(whole())),
    "interp_extrapolate": extrapolated,
    "interp_zero_ends": lambda: F.when(F.count(val()).over(whole()) >= 2, F.coalesce(linear(False), F.lit(0.0))),
}
#: those that need statistics of a bar
SECTION = {"xs_mean": lambda: F.avg(val()), "xs_median": lambda: F.percentile(val(), F.lit(0.5))}


def known(name: str) -> bool:
    return name in FILLS or name in SECTION or name == "knn"


def fill(panel: DataFrame, name: str) -> DataFrame:
    if name == "knn":
        return knn(panel)
    if name in SECTION:
        return with_stats(panel, ["gid", "bar"], _mid=SECTION[name]()).select("gid", "code", "bar", F.coalesce(val(), "_mid").alias("v"))
    if name not in FILLS:
        raise ValueError(f"unknown fill: {name}")
    return panel.select("gid", "code", "bar", FILLS[name]().alias("v"))


def correlation_stats(filled: DataFrame, original: DataFrame) -> DataFrame:
    """Statistics over bars of the correlation across codes of a filled panel with the original."""
    from quillon.operators.evaluate import safe_corr

    j = filled.select("gid", "code", "bar", F.col("v").alias("x")).join(original.select("gid", "code", "bar", F.col("v").alias("y")), ["gid", "code", "bar"]).where("x IS NOT NULL AND y IS NOT NULL")
    c = j.groupBy("gid", "bar").agg(safe_corr("x", "y").alias("c"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("d")).where("c IS NOT NULL")
    return c.agg(F.avg("c").alias("mean_corr"), F.stddev_samp("c").alias("std_corr"), F.percentile("c", F.lit(0.5)).alias("median_corr"), F.min("c").alias("min_corr"), F.max("c").alias("max_corr"), F.count("*").alias("n"), F.avg("d").alias("mean_diff"))


def robust(stats: DataFrame, threshold: float = 0.9, most: int = 3, at_least: bool = True) -> DataFrame:
    """Fills by (fill, mean_corr, std_corr, n, total, mean_diff) that agree with the data; the best three."""
    ok = F.col("mean_corr") >= threshold if at_least else F.col("mean_corr") <= threshold
    return stats.where(ok & (F.coalesce("std_corr", F.lit(0.0)) <= 0.1) & (F.col("n") / F.col("total") >= 0.8)).orderBy(F.desc("mean_corr"), "std_corr", "mean_diff", "fill").limit(most)
