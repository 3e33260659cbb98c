"""Element-wise transforms of a value column; NULL stays NULL, undefined results are NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.sources.panel import clean

#: arguments of sinh and cosh are held to this, so that they stay finite: half the log of the largest double
CLIP = math.log(1.7976931348623157e308) / 2


def _clip(v: Column) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(CLIP)), F.lit(-CLIP)))


def lg1p(v: Column) -> Column:
    return F.when(v == -1, F.lit(float("-inf"))).when(v > -1, F.log1p(v))


ELEMENTWISE = {
    "abs_v": F.abs,
    "reciprocal": lambda v: F.try_divide(F.lit(1.0), v),
    "sigmoid": lambda v: 1 / (1 + F.exp(-v)),
    "exp": F.exp,
    "lg1p": lg1p,
    "tan": F.tan,
    "sin": F.sin,
    "cos": F.cos,
    "asin": lambda v: clean(F.asin(_clip(v))),
    "acos": lambda v: clean(F.acos(_clip(v))),
    "atan": lambda v: F.atan(_clip(v)),
    "sinh": lambda v: F.sinh(_clip(v)),
    "cosh": lambda v: F.cosh(_clip(v)),
    "tanh": F.tanh,
}
