"""Chains of transforms: names, parsing, the search over ordered tuples, and their evaluation with shared prefixes."""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, field
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import fills, filters, level1, level2

ROLLING = frozenset(level1.ROLLING)


def known(name: str) -> bool:
    return level1.known(name) or name in filters.FILTERS or name in level2.AGGREGATES or name in ("cv_adjusted", "acf", "quantile") or fills.known(name)


def parse(text: str) -> tuple[str, tuple[float, ...]]:
    """name, name_5 or name(5, 2); an exact name comes first, so quantile_25 is not quantile with 25."""
    if known(text) or text in ROLLING:
        return text, ()
    m = re.fullmatch(r"(\w+)\(([^()]*)\)", text) or re.fullmatch(r"(\w+)_(\d+(?:\.\d+)?)", text)
    if not m:
        raise ValueError(f"not a function: {text}")
    return m[1], tuple(float(x) if "." in x else int(x) for x in re.split(r"\s*,\s*", m[2].strip()) if x)


def parse_table(text: str) -> dict:
    """30_b10_d1: frequency 30, lookback 10, delay 1."""
    m = re.fullmatch(r"(\d+)(?:_b(\d+))?(?:_d(\d+))?", text)
    if not m:
        raise ValueError(f"not a table parameter: {text}")
    return {"freq": int(m[1]), "lookback": int(m[2]) if m[2] else None, "delay": int(m[3]) if m[3] else None}


def expanded(names: list[str], bars: int) -> list[str]:
    """Rolling functions get windows of the rounded root of the bars, and of twice that."""
    n = round(math.sqrt(bars))
    return [y for x in names for y in ([f"{x}_{n}", f"{x}_{2 * n}"] if x in ROLLING else [x])]


def tuples(names: list[str], longest: int = 3):
    """All ordered tuples of distinct names, shortest first."""
    for k in range(1, longest + 1):
        yield from permutations(names, k)


def step(panel: DataFrame, text: str, settings: dict[str, dict] | None = None) -> DataFrame:
    """One transform: name, name_5 or name(5, 2), all arguments used; ``settings`` by name apply where the text has none."""
    name, args = parse(text)
    return level1.apply(panel, name, *args, **({} if args else (settings or {}).get(name, {})))


def search(panel: DataFrame, names: list[str], aggregates: list[str], longest: int = 2, fill: str = "none", settings: dict[str, dict] | None = None) -> DataFrame:
    """(fill, l1, l2, gid, code, v) of every tuple and aggregate.

    Tuples are walked as a trie: a prefix that has continuations is written once to the checkpoint
    folder, and its aggregates and continuations read it there. All aggregates of a node are one
    groupBy, with the repair of infinities that ``Spec.build`` makes, if there are any to repair.
    """
    from quillon.plans.checkpoints import cut

    base = fills.fill(panel, fill)
    # transforms repair what they make themselves, so infinities can only come from the input
    repair = level2.has_infinite(base)
    out, level = None, {(): cut(base) if longest else base}
    for depth in range(1, longest + 1):
        deeper = {}
        for prefix, at in level.items():
            for n in names:
                if n not in prefix:
                    p = step(at, n, settings)
                    deeper[(*prefix, n)] = cut(p) if depth < longest else p
        for t, p in deeper.items():
            wide = level2.aggregate(p, aggregates, repair).select("gid", "code", F.lit(fill).alias("fill"), F.lit(">".join(t)).alias("l1"), *(F.col(a).cast("double") for a in aggregates))
            f = wide.unpivot(["fill", "l1", "gid", "code"], aggregates, "l2", "v")
            out = f if out is None else out.unionByName(f)
        level = deeper
    return out.select("fill", "l1", "l2", "gid", "code", "v")


@dataclass(frozen=True)
class Spec:
    """A factor that can be made again: emitted as a JSON row instead of source text. ``params`` holds the settings of its filters by name."""

    name: str
    fill: str
    l1: tuple[str, ...]
    l2: str
    direction: int = 1
    params: dict = field(default_factory=dict)

    def json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def read(text: str) -> Spec:
        d = json.loads(text)
        return Spec(**(d | {"l1": tuple(d["l1"])}))

    def build(self, panel: DataFrame) -> DataFrame:
        p = fills.fill(panel, self.fill)
        for n in self.l1:
            p = step(p, n, self.params)
        name, args = parse(self.l2)
        f = level2.apply(p, name, *args)
        return f.select("gid", "code", (F.col("v") * self.direction).alias("v"))
