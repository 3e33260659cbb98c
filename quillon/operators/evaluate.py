"""Scores of factors against returns, and selection among them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation from moments; NULL where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_rank(c: str, *by: str) -> Column:
    """Average rank within the rows of ``by``, NULL for NULL."""
    r = F.rank().over(Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last()))
    return F.when(F.col(c).isNotNull(), r + (F.count(c).over(Window.partitionBy(*by, c)) - 1) / 2)


def ic_daily(factor: DataFrame, returns: DataFrame, rank_after: bool = False) -> DataFrame:
    """(gid, n, ic, rank_ic, coverage) from (gid, code, v) and (gid, code, ret); ranks before or after pairs are completed."""
    j = factor.select("gid", "code", F.col("v").alias("f")).join(returns.select("gid", "code", F.col("ret").alias("r")), ["gid", "code"])
    if rank_after:
        j = j.withColumn("both", F.col("f").isNotNull() & F.col("r").isNotNull()).withColumn("fr", F.when(F.col("both"), F.col("f"))).withColumn("rr", F.when(F.col("both"), F.col("r")))
        j = j.select("*", average_rank("fr", "gid").alias("fk"), average_rank("rr", "gid").alias("rk"))
    else:
        j = j.select("*", average_rank("f", "gid").alias("fk"), average_rank("r", "gid").alias("rk"))
    both = F.col("f").isNotNull() & F.col("r").isNotNull()
    w = lambda c: F.when(both, F.col(c))
    j = j.select("gid", w("f").alias("x"), w("r").alias("y"), w("fk").alias("xk"), w("rk").alias("yk"), F.col("r").alias("r"))
    return j.groupBy("gid").agg(F.count("x").alias("n"), safe_corr("x", "y").alias("ic"), safe_corr("xk", "yk").alias("rank_ic"), F.try_divide(F.count("x"), F.count("r")).alias("coverage"))


def ic_summary(daily: DataFrame, threshold: float = 0.015) -> DataFrame:
    out = daily.agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.avg("coverage").alias("coverage"))
    return out.withColumn("passed", (F.abs("ic") > threshold) & (F.abs("rank_ic") > threshold)).withColumn("direction", F.signum("ic").cast("long"))


def gated(daily: DataFrame, cover: float = 0.7, threshold: float = 0.015) -> DataFrame:
    """(coverage, rank_ic, passed, expression): the mean rank IC counts only where the mean coverage is above ``cover``.

    expression is alpha or -1*alpha by the sign of an IC that passes, else why it does not: "low cover" or "low ic".
    """
    s = daily.agg(F.avg("coverage").alias("coverage"), F.avg("rank_ic").alias("rank_ic"))
    covered, strong = F.coalesce(F.col("coverage") > cover, F.lit(False)), F.coalesce(F.abs("rank_ic") > threshold, F.lit(False))
    text = F.when(~covered, "low cover").when(~strong, "low ic").when(F.col("rank_ic") < 0, "-1*alpha").otherwise("alpha")
    return s.select("coverage", F.when(covered, F.col("rank_ic")).alias("rank_ic"), (covered & strong).alias("passed"), text.alias("expression"))


#: names of one block of the correlation matrix, rows of one task, cells of one product
BLOCK, ROWS, CELLS = 256, 1_000_000, 4096


def _block_sums(pairs):
    """Sums over the cells of one slice, of every two names of a pair of blocks, as products of matrices."""
    import pyarrow as pa

    names, cells, v, side = (pairs.column(c).to_numpy(zero_copy_only=False) for c in ("name", "cell", "v", "side"))
    same = pairs.column("i")[0].as_py() == pairs.column("j")[0].as_py()
    cell_of, row = np.unique(cells, return_inverse=True)
    out = {k: [] for k in ("a", "b", "n", "x", "y", "xx", "yy", "xy")}

    def matrix(keep, known, at):
        x, m = np.zeros((CELLS, len(known))), np.zeros((CELLS, len(known)))
        column = np.searchsorted(known, names[keep])
        x[row[keep] - at, column], m[row[keep] - at, column] = v[keep], 1.0
        return x, m

    sums, a, b = None, *(np.unique(names[side == k]) for k in (0, 0 if same else 1))
    order = np.argsort(row, kind="stable")
    for at in range(0, len(cell_of), CELLS):  # so many cells at a time, that matrices stay small
        part = order[np.searchsorted(row[order], at) : np.searchsorted(row[order], at + CELLS)]
        (x, mx), (y, my) = (matrix(part[side[part] == k], known, at) for k, known in ((0, a), (0 if same else 1, b)))
        now = {"n": mx.T @ my, "x": x.T @ my, "y": mx.T @ y, "xx": (x * x).T @ my, "yy": mx.T @ (y * y), "xy": x.T @ y}
        sums = now if sums is None else {k: sums[k] + now[k] for k in now}
    p, q = np.nonzero((sums["n"] > 0) & (a[:, None] < b[None, :] if same else a[:, None] != b[None, :]))
    swap = a[p] > b[q]
    out["a"], out["b"] = np.where(swap, b[q], a[p]), np.where(swap, a[p], b[q])
    for one, two in (("x", "y"), ("xx", "yy")):
        out[one], out[two] = np.where(swap, sums[two][p, q], sums[one][p, q]), np.where(swap, sums[one][p, q], sums[two][p, q])
    out["n"], out["xy"] = sums["n"][p, q], sums["xy"][p, q]
    return pa.table({k: pa.array(out[k].tolist() if k in "ab" else out[k], pa.string() if k in ("a", "b") else pa.float64()) for k in out})


def factor_corr(factors: DataFrame, least: float | None = None) -> DataFrame:
    """(a, b, corr, n) of every two factors of (name, gid, code, v), over the cells both have; with ``least``, those above it in size.

    Names are dealt into blocks, and cells into slices of bounded size. A task has a slice of two blocks
    and gives its sums by products of matrices; the sums of the slices are added. A row is sent once for each
    block, not for each name. Values are centred by their name's mean first, so that sums of squares do not cancel.
    """
    f = factors.where("v IS NOT NULL").select("name", "gid", "code", "v")
    means = f.groupBy("name").agg(F.avg("v").alias("mean"), F.count("*").alias("rows"))
    names, rows = means.agg(F.count("*"), F.sum("rows")).first()
    blocks = max(1, -(-names // BLOCK))
    slices = max(1, -(-2 * (rows or 0) // (blocks * ROWS)))
    f = f.join(means.select(F.col("name").alias("of"), "mean"), F.col("name") == F.col("of"))
    f = f.select("name", (F.col("v") - F.col("mean")).alias("v"), F.xxhash64("gid", "code").alias("cell"), F.expr(f"int(pmod(xxhash64(name), {blocks}))").alias("at"))
    # a row of block x stands in the pairs (x, y) of all later blocks y as the first side, and of all earlier ones as the second
    pairs = f"transform(sequence(0, {blocks - 1}), y -> struct(least(at, y) AS i, greatest(at, y) AS j, int(y < at) AS side))"
    f = f.select("name", "v", "cell", F.explode(F.expr(pairs)).alias("x"), F.expr(f"int(pmod(cell, {slices}))").alias("part")).select("name", "v", "cell", "x.i", "x.j", "x.side", "part")
    sums = f.groupBy("i", "j", "part").applyInArrow(_block_sums, "a string, b string, n double, x double, y double, xx double, yy double, xy double")
    s = sums.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    spread = lambda c: F.greatest(F.col(f"{c}{c}") - F.col(c) * F.col(c) / F.col("n"), F.lit(0.0))
    corr = F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.sqrt(spread("x")) * F.sqrt(spread("y")))
    out = s.select("a", "b", corr.alias("corr"), F.col("n").cast("long").alias("n"))
    return out if least is None else out.where(F.abs("corr") > least)


def greedy(scores: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """The names of (name, score) that ``select_greedy`` keeps, with their order key, from edges (a, b), without collecting any of them.

    In each round a name is kept if its key comes before those of all its neighbours that are still
    open, and its neighbours go. Rounds end when no name is open: in any order there is a first one.
    """
    from quillon.plans.checkpoints import cut

    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    degree = both.groupBy("a").agg(F.count("*").alias("degree")).withColumnRenamed("a", "of")
    key = F.struct((-F.abs(F.coalesce("score", F.lit(0.0))) / (F.coalesce("degree", F.lit(0)) + 3)).alias("k"), "name").alias("key")
    open_ = cut(scores.join(degree, F.col("name") == F.col("of"), "left").select("name", key))
    live, kept = cut(both), None
    for _ in range(most):
        if open_.isEmpty():
            break
        rival = live.join(open_.select(F.col("name").alias("bn"), F.col("key").alias("bk")), F.col("b") == F.col("bn")).groupBy("a").agg(F.min("bk").alias("rival")).withColumnRenamed("a", "of")
        won = cut(open_.join(rival, F.col("name") == F.col("of"), "left").where("rival IS NULL OR key < rival").select("name", "key"))
        lost = live.join(won.select(F.col("name").alias("w")), F.col("a") == F.col("w")).select(F.col("b").alias("gone")).unionByName(won.select(F.col("name").alias("gone"))).distinct()
        kept = won if kept is None else kept.unionByName(won)
        lost = cut(lost)
        open_ = cut(open_.join(lost, F.col("name") == F.col("gone"), "left_anti"))
        live = cut(live.join(lost, F.col("a") == F.col("gone"), "left_anti").join(lost, F.col("b") == F.col("gone"), "left_anti"))
    else:
        raise RuntimeError("the selection did not settle")
    return open_ if kept is None else kept


def select_greedy(scores: dict[str, float], edges: list[tuple[str, str]]) -> list[str]:
    """Names by |IC| over (degree + 3), best first, each removing its neighbours; ties by name.

    The degree of a name in its thresholded correlation matrix counts its own loop twice.
    """
    near: dict[str, set] = {n: set() for n in scores}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    kept, gone = [], set()
    for n in sorted(scores, key=lambda n: (-abs(scores[n] or 0.0) / (len(near[n]) + 3), n)):
        if n not in gone:
            kept.append(n)
            gone |= {n} | near[n]
    return kept


def effective_bets(corr: np.ndarray) -> float:
    """The exponential of the entropy of the correlation matrix's normalised eigenvalues."""
    w = np.clip(np.linalg.eigvalsh(corr), 0, None)
    w = w / w.sum()
    w = w[w > 1e-12]
    return float(np.exp(-(w * np.log(w)).sum()))


def select_enb(corr: np.ndarray, names: list[str], deviations: list[float], count: int, first: str | None = None) -> list[str]:
    """Forward selection of the series whose effective number of bets is the largest; starts at the calmest."""
    if count >= len(names):
        return list(names)
    kept = [names.index(first) if first in names else int(np.argmin(deviations))]
    while len(kept) < count:
        rest = [i for i in range(len(names)) if i not in kept]
        kept.append(max(rest, key=lambda i: effective_bets(corr[np.ix_([*kept, i], [*kept, i])])))
    return [names[i] for i in kept]


def pnl_matrix(pnl: DataFrame) -> tuple[np.ndarray, list[str], list[float]]:
    """Correlations, names and deviations of (name, day, pnl). The driver gets the matrix of all names: they are the candidates
    of one selection, whose eigenvalues need it whole."""
    c = factor_corr(pnl.select("name", F.col("day").alias("gid"), F.lit(0).alias("code"), F.col("pnl").alias("v"))).collect()
    d = {r[0]: r[1] for r in pnl.groupBy("name").agg(F.stddev_samp("pnl")).collect()}
    names = sorted(d)
    m, at = np.eye(len(names)), {n: i for i, n in enumerate(names)}
    for r in c:
        i, j = at[r["a"]], at[r["b"]]
        m[i, j] = m[j, i] = r["corr"] or 0.0
    return m, names, [d[n] for n in names]
