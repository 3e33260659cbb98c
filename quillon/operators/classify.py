"""Classes, summaries and extremes of strategy statistics by threshold rules."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["ret", "ret_l", "ret_s", "IC", "ICIR", "tvr", "sharpe", "dd", "pwin"]


@dataclass(frozen=True)
class Thresholds:
    start_date: str = "19950101"
    ic: float = 0.01
    icir: float = 0.1
    dd: float = 10.0
    win: float = 0.5
    ret: float = 5.0
    ret_l: float = 2.0
    tvr_max: float = 60.0
    tvr_min: float = 10.0
    sharpe: float = 1.0
    cover: float = 100.0

    def __post_init__(self):
        bad = [k for k, v in vars(self).items() if k != "start_date" and not v >= 0]
        if bad:
            raise ValueError(f"thresholds below 0: {bad}")
        if self.tvr_min > self.tvr_max:
            raise ValueError("tvr_min is above tvr_max")

    @staticmethod
    def read(config: dict) -> Thresholds:
        """From a configuration that has every threshold and an out_path (which is not one); others, and values that are no numbers, are errors."""
        names = [f.name for f in fields(Thresholds)]
        missing, unknown = sorted({*names, "out_path"} - set(config)), sorted(set(config) - {*names, "out_path", "backtest_folder"})
        if missing or unknown:
            raise ValueError(f"missing: {missing}, unknown: {unknown}")
        return Thresholds(str(config["start_date"]), **{n: float(config[n]) for n in names if n != "start_date"})

    @staticmethod
    def load(path: str) -> Thresholds:
        """From a JSON file."""
        with open(path) as f:
            return Thresholds.read(json.load(f))


def parsed_date(c: str) -> Column:
    """YYYY-MM-DD, YYYYMMDD (or a number) or YYYY/MM/DD."""
    s = F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    return F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), F.try_to_date(s, "yyyyMMdd"), F.try_to_date(s, "yyyy/MM/dd"))


def at_least(c: str, t: float) -> Column:
    return F.coalesce(F.col(c) >= t, F.lit(False))


def ic_class(c: str, t: float) -> Column:
    return F.when(F.col(c) >= t, 1).when(F.col(c) <= -t, -1).otherwise(0)


def tvr_class(c: str, t: Thresholds) -> Column:
    return F.when(F.col(c) > t.tvr_max, -1).when(F.col(c) < t.tvr_min, 1).otherwise(0)


def cover_class(c: str, t: float) -> Column:
    """1 from the threshold, -1 below it, 0 for no number."""
    return F.when(F.col(c).isNull() | F.isnan(c), 0).when(F.col(c) >= t, 1).otherwise(-1)


def checks(t: Thresholds) -> dict[str, Column]:
    """Every single check by name."""
    return {
        "ic": ic_class("IC", t.ic), "tvr": tvr_class("tvr", t), "cover": cover_class("long", t.cover), "ret": at_least("ret", t.ret), "ret_l": at_least("ret_l", t.ret_l),
        "icir": at_least("ICIR", t.icir), "sharpe": at_least("sharpe", t.sharpe), "win": at_least("pwin", t.win), "dd": F.coalesce(F.col("dd") <= t.dd, F.lit(False)),
    }


def patched(text: Column, t: Thresholds) -> Column:
    """A text with its turnover bounds set a tenth inside the thresholds."""
    for name, value in (("tvr_max", t.tvr_max * 0.9), ("tvr_min", t.tvr_min * 1.1)):
        text = F.regexp_replace(text, rf"{name}\s*=\s*[\d.]+", f"{name} = {value:.3f}")
    return text


def category(t: Thresholds) -> Column:
    """The first rule that holds; columns from, long and the metrics of the Total row."""
    ic, tvr = ic_class("IC", t.ic), tvr_class("tvr", t)
    ret, icir, win, ret_l = at_least("ret", t.ret), at_least("ICIR", t.icir), at_least("pwin", t.win), at_least("ret_l", t.ret_l)
    dd = F.coalesce(F.col("dd") <= t.dd, F.lit(False))
    start = F.to_date(F.lit(t.start_date.replace("-", "").replace("/", "")), "yyyyMMdd")
    rules = [
        (F.col("from").isNull(), "drop"), (~F.coalesce(parsed_date("from") == start, F.lit(False)), "not_run"), (F.col("long").isNull(), "not_run"),
        (cover_class("long", t.cover) == -1, "drop"), ((ic == 0) & (tvr != 1), "drop"), (ic == -1, "negative_ic"), (tvr == 1, "low_tvr"), (tvr == -1, "high_tvr"),
        (ret & dd & icir & win & ret_l, "all_pass"), (ret & dd & icir & win, "ret_long"), (ret & win, "high_dd"), ((ic != 0) & ret_l, "low_ret_s"), (ret & dd, "low_win"),
        (ret | F.coalesce(F.col("ret") + F.col("tvr") / 35 >= t.ret, F.lit(False)), "adjustable_ret"),
    ]
    out = F.when(*[rules[0][0], F.lit(rules[0][1])])
    for c, name in rules[1:]:
        out = out.when(c, F.lit(name))
    return out.otherwise("drop")


def bucket(c: str = "category") -> Column:
    """pass, rerun, drop or not_run; low_ret_s, which no bucket names, is run again."""
    return F.when(F.col(c).isin("ret_long", "sharpe", "all_pass"), "pass").when(F.col(c).isin("negative_ic", "high_tvr", "low_tvr", "low_win", "high_dd", "adjustable_ret", "low_ret_s"), "rerun").when(F.col(c) == "not_run", "not_run").otherwise("drop")


def not_run(names: DataFrame, stats: DataFrame) -> DataFrame:
    return names.join(stats.select("alpha"), "alpha", "left_anti")


def summaries(stats: DataFrame, *by: str) -> DataFrame:
    """count, mean, std, min and max of each metric by the given columns."""
    aggs = [f(m).alias(f"{m}_{n}") for m in METRICS for n, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return stats.groupBy(*by).agg(*aggs)


def by_category(stats: DataFrame, categories: DataFrame) -> DataFrame:
    """Summaries by (category, period), without not_run; uncategorised alphas count as drop."""
    s = stats.join(categories.select("alpha", "category"), "alpha", "left").withColumn("category", F.coalesce("category", F.lit("drop")))
    return summaries(s.where("category <> 'not_run'"), "category", "period")


def extremes(stats: DataFrame, *by: str) -> DataFrame:
    """(by, metric, max, max_alpha, min, min_alpha) in one pass; ties go to the first name."""
    long = stats.unpivot([*by, "alpha"], [F.col(m).cast("double").alias(m) for m in METRICS], "metric", "value").where("value IS NOT NULL")
    top, low = F.min(F.struct((-F.col("value")).alias("k"), "alpha")), F.min(F.struct("value", "alpha"))
    g = long.groupBy(*by, "metric").agg(top.alias("t"), low.alias("l"))
    return g.select(*by, "metric", (-F.col("t.k")).alias("max_value"), F.col("t.alpha").alias("max_alpha"), F.col("l.value").alias("min_value"), F.col("l.alpha").alias("min_alpha"))


def pivoted(stats: DataFrame, periods: list[str], metric: str = "ret") -> DataFrame:
    """One row a category, one column a period, for a bounded list of periods."""
    return stats.groupBy("category").pivot("period", periods).agg(F.avg(metric))


#: metrics of the wide report, and their statistics
REPORTED, STATISTICS = ("ret", "IC", "tvr", "sharpe"), (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))


def wide_report(stats: DataFrame, categories: DataFrame, names: list[str], periods: list[str]) -> DataFrame:
    """One row: overall_<metric>_<statistic>_<period> and <category>_<metric>_<statistic>_<period>, for bounded lists, in one pass."""
    s = stats.join(categories.select("alpha", "category"), "alpha", "left").withColumn("category", F.coalesce("category", F.lit("drop")))
    aggs = []
    for group in ("overall", *names):
        for period in periods:
            here = F.col("period") == period
            if group != "overall":
                here = here & (F.col("category") == group)
            aggs += [f(F.when(here, F.col(m))).alias(f"{group}_{m}_{n}_{period}") for m in REPORTED for n, f in STATISTICS]
    return s.agg(*aggs)
