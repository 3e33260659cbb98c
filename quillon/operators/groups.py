"""Regrouping of panels and screens on groups. Input panels carry (code, t, v) or (gid, code, bar, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.sources.panel import val, whole


def daily(p: DataFrame, bars: int) -> DataFrame:
    """(code, t, v) in groups of ``bars`` bars, one a day."""
    return p.select(F.floor(F.col("t") / bars).cast("long").alias("gid"), "code", (F.col("t") % bars).cast("long").alias("bar"), "v")


def half_day(p: DataFrame, bars: int) -> DataFrame:
    """The first half of each day's bars, so that nothing of its end is seen."""
    return daily(p, bars).where(F.col("bar") < bars // 2)


def rolling_days(p: DataFrame, bars: int, window: int, drop_half: bool = False) -> DataFrame:
    """Overlapping groups of ``window`` full days, named by their last day; optionally without the last half day."""
    d = daily(p, bars)
    last = d.agg(F.max("gid")).first()[0]
    if last is None:
        return d
    d = d.select(F.explode(F.sequence(F.greatest("gid", F.lit(window - 1).cast("long")), F.least(F.col("gid") + window - 1, F.lit(last).cast("long")))).alias("g"), "gid", "code", "bar", "v") if last >= window - 1 else d.withColumn("g", F.col("gid")).where("false")
    d = d.select(F.col("g").alias("gid"), "code", ((F.col("gid") - F.col("g") + window - 1) * bars + F.col("bar")).alias("bar"), "v")
    return d.where(F.col("bar") < bars * window - bars // 2) if drop_half else d


def rows_tumbling(p: DataFrame, width: int) -> DataFrame:
    """Groups of ``width`` bars; a short tail stays."""
    return daily(p, width)


def rows_sliding(p: DataFrame, width: int) -> DataFrame:
    """Every full run of ``width`` bars, named by its first bar."""
    last = p.agg(F.max("t")).first()[0]
    if last is None or last + 1 < width:
        return daily(p, width).where("false")
    g = p.select(F.explode(F.sequence(F.greatest(F.col("t") - width + 1, F.lit(0).cast("long")), F.least("t", F.lit(last - width + 1).cast("long")))).alias("gid"), "code", "t", "v")
    return g.select("gid", "code", (F.col("t") - F.col("gid")).alias("bar"), "v")


def blank_empty(p: DataFrame) -> DataFrame:
    """Groups whose values are all NULL or 0 become NULL."""
    s = p.groupBy("gid").agg(F.coalesce(F.sum(F.abs(val())), F.lit(0.0)).alias("s")).select(F.col("gid").alias("g"), "s")
    return p.join(s, F.col("gid") == F.col("g")).select("gid", "code", "bar", F.when(F.col("s") != 0, val()).alias("v"))


def screen_l1(p: DataFrame, most: float = 0.3) -> DataFrame:
    """Nothing if more than ``most`` of the groups are empty; else empty groups repeat the group before, cell by cell."""
    e = p.groupBy("gid").agg(F.count(val()).alias("n")).withColumn("empty", F.col("n") == 0)
    # one row a group: these windows hold as many rows as there are days
    order = Window.partitionBy(F.lit(0)).orderBy("gid").rowsBetween(Window.unboundedPreceding, 0)
    share = F.avg(F.col("empty").cast("double")).over(Window.partitionBy(F.lit(0)))
    src = e.select("gid", F.last(F.when(~F.col("empty"), F.col("gid")), True).over(order).alias("src"), share.alias("share")).where(F.col("share") <= most).select("gid", F.coalesce("src", "gid").alias("src"))
    cells = p.select(F.col("gid").alias("g"), "code", "bar", "v")
    return src.join(cells, F.col("src") == F.col("g")).select("gid", "code", "bar", "v")


def screen_l2(f: DataFrame) -> DataFrame:
    """(n, empty, zero, kept) of a factor's groups: kept if under a third are all NULL and under a third all zero."""
    g = f.groupBy("gid").agg(F.count(val()).alias("n"), F.max(F.abs(val())).alias("m"))
    out = g.agg(F.count("*").alias("n"), F.count(F.when(F.col("n") == 0, 1)).alias("empty"), F.count(F.when(F.col("m") == 0, 1)).alias("zero"))
    return out.withColumn("kept", (F.col("empty") * 3 < F.col("n")) & (F.col("zero") * 3 < F.col("n")))


def drop_empty(p: DataFrame) -> DataFrame:
    """Without bars that are all NULL, and without codes that are all NULL or all zero, in each group."""
    s = F.coalesce(F.sum(F.abs(val())).over(whole()), F.lit(0.0))
    n = F.count(val()).over(Window.partitionBy("gid", "bar"))
    return p.select("*", s.alias("_s"), n.alias("_n")).where("_s <> 0 AND _n > 0").select("gid", "code", "bar", "v")
