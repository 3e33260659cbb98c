"""Panels: long tables (gid, code, bar, v) on a full grid of bars, NULL where nothing was observed.

Windows run within (gid, code) over time and within (gid, bar) across codes. A grid is made by
exploding the bars of each code, never by a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def val() -> Column:
    return F.col("v")


def over_time():
    return Window.partitionBy("gid", "code").orderBy("bar")


def whole():
    return Window.partitionBy("gid", "code")


def cross():
    return Window.partitionBy("gid", "bar")


def group():
    return Window.partitionBy("gid")


def so_far():
    return over_time().rowsBetween(Window.unboundedPreceding, 0)


def onward():
    return over_time().rowsBetween(0, Window.unboundedFollowing)


def roll(n: int):
    return over_time().rowsBetween(1 - n, 0)


def with_stats(panel: DataFrame, by: list[str], **stats: Column) -> DataFrame:
    """The panel with statistics of the rows of each key: aggregated map-side and joined back.

    A window over the key would sort all its rows in one task; here one row a key is joined.
    """
    s = panel.groupBy(*by).agg(*(c.alias(name) for name, c in stats.items()))
    s = s.select(*(F.col(c).alias(f"_by_{c}") for c in by), *stats)
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return panel.join(s, same).drop(*(f"_by_{c}" for c in by))


def clean(c: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(c), c)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_grid(observed: DataFrame, bars: int) -> DataFrame:
    """(code, t, v) on all ``bars`` bars of each code that has any observation; t from 0.

    The join is by sorting, whatever the sizes: the grid is estimated without its explosion, and a later
    filter on v makes the join an inner one, of which Spark would then broadcast the whole grid.
    """
    codes = observed.groupBy("code").agg(F.lit(1).alias("seen"))
    grid = codes.select("code", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bars - 1).cast("long"))).alias("t"))
    return grid.hint("merge").join(observed.where(F.col("v").isNotNull()), ["code", "t"], "left").select("code", "t", clean(F.col("v")).alias("v"))


def event_panel(spark: SparkSession, sf_dir: str, group: int = 40, first: str = "2024-01-01", days: int = 30) -> DataFrame:
    """Six-hour means of events by user over ``days`` days from ``first``, in groups of ``group`` bars; v is the mean over 53.17, less 1.

    The grid is what the parameters say: events outside of it are not in the panel.
    """
    e = table(spark, sf_dir, "events")
    t = (F.datediff("ts", F.lit(first).cast("date")) * 4 + F.floor(F.hour("ts") / 6)).cast("long")
    seen = e.select(F.col("user_id").cast("long").alias("code"), t.alias("t"), "value").groupBy("code", "t").agg((F.avg("value") / 53.17 - 1).alias("v"))
    p = on_grid(seen, 4 * days)
    return p.select(F.floor(F.col("t") / group).cast("long").alias("gid"), "code", (F.col("t") % group).alias("bar"), "v")


def revenue_panel(spark: SparkSession, sf_dir: str, first: int = 1995, years: int = 7) -> DataFrame:
    """Monthly revenue by supplier over ``years`` years from ``first``, grouped by year; v in millions. Other years are not in the panel."""
    li = table(spark, sf_dir, "lineitem")
    t = ((F.year("l_shipdate") - first) * 12 + F.month("l_shipdate") - 1).cast("long")
    seen = li.select(F.col("l_suppkey").cast("long").alias("code"), t.alias("t"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1e6).alias("x")).groupBy("code", "t").agg(F.sum("x").alias("v"))
    p = on_grid(seen, 12 * years)
    return p.select((F.lit(first) + F.floor(F.col("t") / 12)).cast("long").alias("gid"), "code", (F.col("t") % 12).alias("bar"), "v")


def wide(panel: DataFrame, codes: list) -> DataFrame:
    """One column a code, for a bounded list of codes."""
    return panel.groupBy("gid", "bar").pivot("code", codes).agg(F.first("v"))


def long(wide_panel: DataFrame) -> DataFrame:
    """The inverse of ``wide``."""
    codes = [c for c in wide_panel.columns if c not in ("gid", "bar")]
    return wide_panel.unpivot(["gid", "bar"], codes, "code", "v").select("gid", F.col("code").cast("long").alias("code"), "bar", "v")


def write_factors(factors: DataFrame, path: str, by: tuple[str, ...] = ("fill", "l1", "l2"), fmt: str = "parquet") -> None:
    """Factors partitioned by how they were made (pruned on read), zstd in Parquet."""
    w = factors.write.mode("overwrite").partitionBy(*by)
    (w.option("compression", "zstd").parquet(path) if fmt == "parquet" else w.option("header", True).csv(path))


def read_factors(spark: SparkSession, path: str, **which: str) -> DataFrame:
    """Factors of ``write_factors``; conditions on how they were made (fill="ffill") prune the folders that are read."""
    f = spark.read.parquet(path)
    for column, value in which.items():
        f = f.where(F.col(column) == value)
    return f


#: the columns of strategy statistics; fixed values
STATS = "from to ret ret_l ret_s IC ICIR tvr sharpe dd% pwin long short".split()


def read_stats(spark: SparkSession, paths: str | list[str], total: bool | None = None, exclude_last: bool = False) -> DataFrame:
    """Strategy statistics from CSV files named .../<alpha>/<folder>/<folder>/<file>: alpha (the great-grandparent's name), period, and the rest.

    The period is in the first column, or where that has no name and the second is not one of the
    statistics, in the second. ``total`` keeps the Total row only (True) or all others (False);
    ``exclude_last`` drops the last row of each file, whatever it is. A file is one partition's lines, in order.
    """
    raw = spark.read.option("header", True).csv(paths)
    names = raw.columns
    at = 1 if len(names) > 1 and names[0] in ("_c0", "Unnamed: 0") and names[1] not in STATS else 0
    rest = [c for c in names[at + 1 :]]
    path = F.url_decode(F.regexp_replace("_metadata.file_path", r"[+]", "%2B"))
    s = raw.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+/[^/]+$", 1).alias("alpha"), path.alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"),
        F.col(f"`{names[at]}`").cast("string").alias("period"), *(F.col(f"`{c}`") for c in rest),
    )
    if exclude_last:
        # rows of a file in order: by block, then as read within it
        last = s.groupBy("_file").agg(F.max(F.struct("_block", "_row")).alias("_last")).withColumnRenamed("_file", "_of")
        s = s.join(last, F.col("_file") == F.col("_of")).where(F.struct("_block", "_row") != F.col("_last"))
    if total is not None:
        s = s.where(F.col("period") == "Total" if total else F.coalesce(F.col("period") != "Total", F.lit(True)))
    return s.select("alpha", "period", *(F.expr(f"try_cast(`{c}` AS double)").alias(c) if c not in ("from", "to") else F.col(f"`{c}`") for c in rest))


def drop_rejected(factors: DataFrame, rejected: DataFrame, by: tuple[str, ...] = ("fill", "l1", "l2")) -> DataFrame:
    return factors.join(rejected.select(*by).distinct(), list(by), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "name", content: str = "content") -> DataFrame:
    """Artefacts by name; a new one replaces an old one whose SHA-256 differs, equal ones are left as they are."""
    same = old.join(new.select(F.col(key).alias("_k"), F.sha2(new[content], 256).alias("_h")), (F.col(key) == F.col("_k")) & (F.sha2(old[content], 256) == F.col("_h")), "left_semi")
    kept = old.join(new.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    return kept.unionByName(same).unionByName(new.join(same.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti"))
