"""An experiment: search, score, screen and select factors, and emit them as specifications."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import evaluate, filters, groups
from quillon.plans import chain
from quillon.plans.checkpoints import cut


@dataclass(frozen=True)
class Experiment:
    fills: tuple[str, ...] = ("none",)
    transforms: tuple[str, ...] = ()
    aggregates: tuple[str, ...] = ("mean",)
    longest: int = 2
    ic: float = 0.015
    corr: float = 0.7
    settings: dict = field(default_factory=dict)

    @staticmethod
    def read(config: dict) -> Experiment:
        """From a configuration's global_settings, function_settings and filter_params; unknown names are an error."""
        f, p = config.get("function_settings", {}), config.get("filter_params", {})
        names = [*f.get("level1", []), *f.get("level2", []), *f.get("fills", ["none"])]
        bad = [n for n in names if not chain.known(n) and chain.parse(n)[0] not in chain.ROLLING and not chain.known(chain.parse(n)[0])]
        if bad:
            raise ValueError(f"unknown functions: {bad}")
        return Experiment(tuple(f.get("fills", ["none"])), tuple(f.get("level1", [])), tuple(f.get("level2", ["mean"])), int(config.get("global_settings", {}).get("longest", 2)), float(p.get("ic", 0.015)), float(p.get("corr", 0.7)), filters.configured(p.get("level1", {}).get("filters", {})))

    def expanded(self, bars: int) -> Experiment:
        """With windows by the length of a group for the rolling functions."""
        return replace(self, transforms=tuple(chain.expanded(list(self.transforms), bars)))

    def drawn(self, ranges: dict[str, tuple[int, int]], strata: int = 2, seed: int = 0) -> Experiment:
        """With the functions of ``ranges`` at one random parameter from each part of their range."""
        names = [y for x in self.transforms for y in ([f"{x}_{k}" for k in stratified(*ranges[x], strata, seed)] if x in ranges else [x])]
        return replace(self, transforms=tuple(dict.fromkeys(names)))


def stratified(low: int, high: int, strata: int = 2, seed: int = 0) -> list[int]:
    """One seeded random parameter from each equal part of a range."""
    r, width = random.Random(seed), (high - low + 1) / strata
    return [r.randint(low + int(i * width), max(low + int(i * width), low + int((i + 1) * width) - 1)) for i in range(strata)]


def ic_by_name(factors: DataFrame, returns: DataFrame) -> DataFrame:
    """(name, days, ic, rank_ic) of every factor of (name, gid, code, v): all factors in one join and one aggregation."""
    j = factors.select("name", "gid", "code", F.col("v").alias("f")).join(returns.select("gid", "code", F.col("ret").alias("r")), ["gid", "code"])

    def rank(c):
        return F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy("name", "gid").orderBy(F.col(c).asc_nulls_last())) + (F.count(c).over(Window.partitionBy("name", "gid", c)) - 1) / 2)

    j = j.select("*", rank("f").alias("fk"), rank("r").alias("rk")).where("f IS NOT NULL AND r IS NOT NULL")
    d = j.groupBy("name", "gid").agg(evaluate.safe_corr("f", "r").alias("ic"), evaluate.safe_corr("fk", "rk").alias("rank_ic"))
    return d.groupBy("name").agg(F.count("ic").alias("days"), F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"))


def screened(factors: DataFrame) -> DataFrame:
    """Factors with under a third of their groups all NULL and under a third all zero."""
    g = factors.groupBy("name", "gid").agg(F.count("v").alias("n"), F.max(F.abs("v")).alias("m"))
    ok = g.groupBy("name").agg(F.avg((F.col("n") == 0).cast("double")).alias("e"), F.avg((F.coalesce("m", F.lit(-1.0)) == 0).cast("double")).alias("z")).where("e < 1 / 3D AND z < 1 / 3D")
    return factors.join(ok.select("name"), "name", "left_semi")


def run(panel: DataFrame, returns: DataFrame, x: Experiment) -> DataFrame:
    """(name, ic, rank_ic, direction, spec): the selected factors. Names, scores and edges stay in tables."""
    all_ = None
    for fill in x.fills:
        f = chain.search(panel, list(x.transforms), list(x.aggregates), x.longest, fill, x.settings)
        all_ = f if all_ is None else all_.unionByName(f)
    f = cut(screened(all_.select(F.concat_ws("|", "fill", "l1", "l2").alias("name"), "gid", "code", "v")))
    scores = cut(ic_by_name(f, returns).where((F.abs("ic") > x.ic) & (F.abs("rank_ic") > x.ic)).select("name", "ic", "rank_ic"))
    passed = f.join(scores.select(F.col("name").alias("of")), F.col("name") == F.col("of"), "left_semi")
    edges = cut(evaluate.factor_corr(passed, x.corr).select("a", "b"))
    kept = evaluate.greedy(scores.select("name", F.col("ic").alias("score")), edges).select(F.col("name").alias("of"))
    part = F.split("name", "[|]")
    sign = F.when(F.col("ic") > 0, 1).otherwise(-1).alias("direction")
    out = scores.join(kept, F.col("name") == F.col("of"), "left_semi").select("name", "ic", "rank_ic", sign, part.alias("p"))
    # the fields of a Spec in the order of their names, as json.dumps sorts them
    params = json.dumps(x.settings, sort_keys=True)
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    steps = F.concat(F.lit("["), F.array_join(F.transform(F.split(F.col("p")[1], ">"), quoted), ", "), F.lit("]"))
    fields = (("direction", F.col("direction").cast("string")), ("fill", quoted(F.col("p")[0])), ("l1", steps), ("l2", quoted(F.col("p")[2])), ("name", quoted(F.col("name"))), ("params", F.lit(params)))
    spec = F.concat(F.lit("{"), *(y for i, (k, c) in enumerate(fields) for y in (F.lit(f'{", " if i else ""}"{k}": '), c)), F.lit("}"))
    return out.select("name", "ic", "rank_ic", "direction", spec.alias("spec"))


def regrouped(flat: DataFrame, text: str, bars: int) -> DataFrame:
    """A panel of (code, t, v) in the groups of a table name like 30_b10_d1.

    b days back make a group, which is named by its last day; without b a group is one day. d days
    of delay move it to a later day: what is known at the end of a day counts d days after.
    """
    x = chain.parse_table(text)
    p = groups.rolling_days(flat, bars, x["lookback"]) if x["lookback"] else groups.daily(flat, bars)
    return p.withColumn("gid", F.col("gid") + (x["delay"] or 0))


def run_tables(flat: DataFrame, returns: DataFrame, x: Experiment, frequency: int, bars: int, lookbacks: tuple[int, ...] = (0,), delays: tuple[int, ...] = (0,)) -> DataFrame:
    """The experiment over every lookback and delay: (table, name, ic, rank_ic, direction, spec), tables named 30_b10_d1, 30_b10, 30_d1 or 30."""
    out = None
    for b in lookbacks:
        for d in delays:
            text = f"{frequency}{f'_b{b}' if b > 0 else ''}{f'_d{d}' if d > 0 else ''}"
            found = run(regrouped(flat, text, bars), returns, x).select(F.lit(text).alias("table"), "name", "ic", "rank_ic", "direction", "spec")
            out = found if out is None else out.unionByName(found)
    return out
