"""Raw factors from several panels: alignment, arithmetic with gaps, same-time-of-day windows. Cells are (code, day, bar, v)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["code", "day", "bar"]


def same_time():
    return Window.partitionBy("code", "bar").orderBy("day")


def align(panels: dict[str, DataFrame]) -> DataFrame:
    """One column a panel, on the times and codes that all of them have."""
    items = list(panels.items())
    out = None
    for name, p in items:
        cell = p.select(*KEYS, F.col("v").alias(name))
        out = cell if out is None else out.join(cell, KEYS, "full")
    for _, p in items:
        out = out.join(p.select("code").distinct(), "code", "left_semi").join(p.select("day", "bar").distinct(), ["day", "bar"], "left_semi")
    return out.select(*KEYS, *(n for n, _ in items))


OPERATIONS = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a, b)}


def safe_arithmetic(columns: list[Column], operation: str, fills: list[float] | float = 0.0) -> Column:
    """The operands in turn, each gap filled by its own fill; NULL where all are NULL."""
    each = fills if isinstance(fills, list) else [fills] * len(columns)
    filled = [F.coalesce(c, F.lit(float(f))) for c, f in zip(columns, each, strict=True)]
    return F.when(F.coalesce(*columns).isNotNull(), reduce(OPERATIONS[operation], filled))


def safe_scalar_first(columns: list[Column], operation: str, fill: float = 0.0) -> Column:
    """Gaps of later operands are filled; a gap in the first gives the fill itself."""
    filled = [columns[0], *(F.coalesce(c, F.lit(float(fill))) for c in columns[1:])]
    return F.coalesce(reduce(OPERATIONS[operation], filled), F.lit(float(fill)))


def roll_same_time(p: DataFrame, n: int) -> DataFrame:
    """Mean of the last ``n`` days' values at the same bar, from one value up."""
    return p.select(*KEYS, F.avg("v").over(same_time().rowsBetween(1 - n, 0)).alias("v"))


def shift_same_time(p: DataFrame, n: int) -> DataFrame:
    return p.select(*KEYS, F.lag("v", n).over(same_time()).alias("v"))


def spread_factor(p: DataFrame) -> DataFrame:
    """100 (ask - bid) / close over the root of the large buy volume; 0 to NULL, NULL to the code's median.

    Columns: code, day, bar, close, bid, ask, big, large, med.
    """
    volume = F.nullif(sum((F.coalesce(c, F.lit(0.0)) for c in ("large", "med")), F.coalesce("big", F.lit(0.0))), F.lit(0.0))
    x = F.try_divide(100 * F.try_divide(F.col("ask") - F.col("bid"), F.col("close")), F.sqrt(volume))
    q = p.select(*KEYS, F.nullif(x, F.lit(0.0)).alias("v"))
    return q.select(*KEYS, F.coalesce("v", F.percentile("v", F.lit(0.5)).over(Window.partitionBy("code"))).alias("v"))
