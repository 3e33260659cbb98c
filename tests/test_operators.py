"""Literal inputs with expected outputs, and recomputation with numpy where SQL says little."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import classify, evaluate, fills, filters, groups, level1, level2
from quillon.plans import chain
from quillon.sources import panel as P
from quillon.streaming import bars

INF = float("inf")


def panel(spark, *columns, gid=0):
    data = [(gid, c, b, None if v is None else float(v)) for c, col in enumerate(columns) for b, v in enumerate(col)]
    return spark.createDataFrame(data, "gid long, code long, bar long, v double")


def column(df, code=0):
    return [r["v"] for r in df.where(F.col("code") == code).orderBy("gid", "bar").collect()]


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-6)), (a, b)


SERIES = [1, 2, 4, 9, 20]


@pytest.mark.parametrize(("a", "b", "x", "y"), [([1, INF, -INF, 5], [2, 3, 4, 6], [1, 5, 1, 5], [2, 3, 4, 6]), ([1, INF, -INF, 5], [None, 3, 4, 6], [1, 5, 1, 5], [None, 3, 4, 6]), ([INF, -INF], [INF, None], [None, None], [None, None])])
def test_infinities(spark, a, b, x, y):
    r = panel(spark, a, b).withColumn("v", level1.repaired(F.col("v"), P.whole()))
    close(column(r), x)
    close(column(r, 1), y)


def test_aroon(spark):
    r = level1.apply(panel(spark, [10, 15, 12, 17, 14], [20, 18, 22, 19, 21]), "aroonosc", 3)
    close(column(r), [None, None, 100 / 3, 100 / 3, 100 / 3])
    close(column(r, 1), [None, None, 100 / 3, 100 / 3, -100 / 3])


@pytest.mark.parametrize(("name", "want"), [("sum", 36), ("mean", 7.2), ("stddev", 6.968500556), ("quantile_25", 2), ("quantile_75", 9), ("skew", 0.999602864), ("kurt", -0.526142017), ("skew_unbiased", 1.49011997), ("kurt_unbiased", 1.895431932), ("cv", 0.967847299), ("bop", 1), ("ptp", 19)])
def test_aggregates(spark, name, want):
    assert level2.apply(panel(spark, SERIES), name).first()["v"] == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("name", sorted(level2.AGGREGATES))
def test_aggregates_of_nothing(spark, name):
    p = panel(spark, [None, None], [3.0, 3.0])
    got = {r["code"]: r["v"] for r in level2.apply(p, name).collect()}
    assert got[0] == (0.0 if name == "sum" else None)
    assert set(got) == {0, 1}


def test_bins_diffs_rolls(spark):
    close(column(panel(spark, SERIES).withColumn("v", level1.binned(4))), [1, 1, 1, 2, 4])
    close(column(panel(spark, [7, 7, 7]).withColumn("v", level1.binned(4))), [4, 4, 4])
    close(column(level1.apply(panel(spark, SERIES), "diff")), [None, 1, 2, 5, 11])
    close(column(level1.apply(panel(spark, SERIES), "rollmean", 3)), [None, None, 7 / 3, 5, 11])


def test_interpolation(spark):
    close(column(fills.fill(panel(spark, [None, None, 3, None, 5, None, 7, None, None]), "interp_extrapolate")), list(range(1, 10)))
    close(column(fills.fill(panel(spark, [None, 2, None, 4, None]), "linear_interp")), [2, 2, 3, 4, 4])
    close(column(fills.fill(panel(spark, [None, 2, None]), "interp_extrapolate")), [None] * 3)


def test_ffill_is_bfill_reversed(spark):
    x = [None, 1, None, None, 4, None]
    assert column(fills.fill(panel(spark, x), "ffill")) == column(fills.fill(panel(spark, x[::-1]), "bfill"))[::-1]


def test_adaptive_average(spark):
    close(column(filters.adaptive(panel(spark, [10, 15, 12, 17, 14]))), [10, 13.333333333, 12.727272727, 14.539944904, 14.366256333])


def test_kernels():
    n, rng = 24, np.random.default_rng(1)
    x = rng.normal(size=n)
    y, k = x[0], filters.ewma_kernel(n) @ x
    for i in range(1, n):
        y = (1 - 2 / 11) * y + 2 / 11 * x[i]
        assert k[i] == pytest.approx(y)
    assert filters.savgol_kernel(n)[10, 8:13] == pytest.approx(np.array([-3, 12, 17, 12, -3]) / 35)
    assert filters.savgol_kernel(n) @ np.arange(n) ** 2.0 == pytest.approx(np.arange(n) ** 2.0)
    d = np.diff(np.eye(n), 2, axis=0)
    assert filters.hp_kernel(n) @ (x + 1600 * d.T @ d @ x) == pytest.approx(x)
    re, im = filters.fourier_kernels(n)
    want = np.fft.fft(x) / n * np.where((np.arange(n) > 0) & (np.arange(n) < n - 1), 2, 1)
    assert re @ x == pytest.approx(want.real) and im @ x == pytest.approx(want.imag)
    for order, cut, kind in ((5, (0.02,), "low"), (5, (0.02,), "high"), (5, (0.02, 0.1), "band"), (2, (0.2,), "high")):
        b, a = filters.butterworth(order, cut, kind)
        gain = lambda w: abs(np.polyval(b, np.exp(1j * w)) / np.polyval(a, np.exp(1j * w)))  # noqa: B023, E731
        assert gain(np.pi * cut[0]) == pytest.approx(np.sqrt(0.5), rel=1e-4)
        assert gain(0.0 if kind == "low" else np.pi if kind == "high" else 2 * np.arctan(np.sqrt(np.tan(np.pi * 0.01) * np.tan(np.pi * 0.05)))) == pytest.approx(1, rel=1e-4)
    b, a = filters.butterworth(1, (0.5,), "low")
    assert b == pytest.approx([0.5, 0.5]) and a == pytest.approx([1, 0])
    assert filters.kalman_kernel(n) @ np.ones(n) == pytest.approx(np.ones(n))
    ra, cd, rd = filters.wavelet_kernels(n)
    assert (ra + rd @ cd) @ x == pytest.approx(x)


def test_kalman_solves_the_smoothing_problem():
    n, q, r = 12, 0.01, 0.1
    x = np.random.default_rng(2).normal(size=n)
    d = np.diff(np.eye(n), axis=0)
    h = np.eye(n) / r + d.T @ d / q
    h[0, 0] += 1
    rhs = x / r
    rhs[0] += x[0]
    assert filters.kalman_kernel(n, q, r) @ x == pytest.approx(np.linalg.solve(h, rhs))


@pytest.mark.parametrize("name", sorted(filters.FILTERS))
def test_filters_keep_the_shape(spark, name):
    p = panel(spark, np.random.default_rng(3).normal(size=12), [None] * 12, [1.0] * 12)
    out = level1.apply(p, name)
    assert out.count() == 36 and column(out, 1) == [None] * 12


def test_linear_filters_are_linear(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=16), rng.normal(size=16)
    for name in ("kalfilt", "lowpfilt", "savgolfilt"):
        r = level1.apply(panel(spark, x, y, 2 * x + 3 * y), name)
        close(column(r, 2), [2 * a + 3 * b for a, b in zip(column(r, 0), column(r, 1), strict=True)])


def test_hilbert_phase(spark):
    x = np.random.default_rng(5).normal(size=8)
    got = [r["v"] for r in filters.hilbert_phase(panel(spark, *[[v] for v in x])).orderBy("code").collect()]
    h = np.array([1, 2, 2, 2, 1, 0, 0, 0])
    assert got == pytest.approx(np.unwrap(np.angle(np.fft.ifft(np.fft.fft(x) * h))))


def test_names():
    assert chain.parse("aroonosc_6") == ("aroonosc", (6,))
    assert chain.parse("quantile_25") == ("quantile_25", ())
    assert chain.parse("f(2, 3)") == ("f", (2, 3))
    assert chain.parse_table("30_b10_d1") == {"freq": 30, "lookback": 10, "delay": 1}
    assert chain.parse_table("5") == {"freq": 5, "lookback": None, "delay": None}
    assert len(list(chain.tuples(list("abcd")))) == 40
    with pytest.raises(ValueError):
        chain.parse("nothing here")
    assert chain.expanded(["diff", "rollmean"], 48) == ["diff", "rollmean_7", "rollmean_14"]


def test_spec(spark):
    s = chain.Spec("x", "ffill", ("diff", "rollmean_2"), "mean", -1)
    assert chain.Spec.read(s.json()) == s
    assert s.build(panel(spark, SERIES)).first()["v"] == pytest.approx(-np.mean([1.5, 3.5, 8]))


def test_selection():
    assert evaluate.select_greedy({"a": 0.5, "b": 0.4, "c": 0.1}, [("a", "b")]) == ["a", "c"]
    x = np.eye(4)
    x[0, 1] = x[1, 0] = 0.9
    assert evaluate.select_enb(x, list("abcd"), [1, 2, 3, 4], 3) == ["a", "c", "d"]
    assert evaluate.effective_bets(np.eye(3)) == pytest.approx(3)


def test_thresholds():
    with pytest.raises(ValueError):
        classify.Thresholds(tvr_min=9, tvr_max=1)
    with pytest.raises(ValueError):
        classify.Thresholds(ic=-1)


def test_screens(spark):
    p = panel(spark, [1, 2]).unionByName(panel(spark, [None, None], gid=1)).unionByName(panel(spark, [3, 4], gid=2)).unionByName(panel(spark, [5, 6], gid=3))
    close(column(groups.screen_l1(p)), [1, 2, 1, 2, 3, 4, 5, 6])
    assert groups.screen_l1(panel(spark, [None, 1]).where("bar = 0")).count() == 0


def test_parquet_round_trip(spark, tmp_path):
    f = panel(spark, SERIES).withColumn("fill", F.lit("none")).withColumn("l1", F.lit("diff")).withColumn("l2", F.lit("mean"))
    P.write_factors(f, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("l1 = 'diff'").count() == 5
    assert P.drop_rejected(f, f).count() == 0


def test_stats_csv(spark, tmp_path):
    d = tmp_path / "AlphaX" / "out" / "run"
    d.mkdir(parents=True)
    (d / "s.csv").write_text("year,ret,IC\n2019,1.5,0.1\nTotal,2.5,\n")
    r = P.read_stats(spark, str(d / "s.csv")).where("period = 'Total'").first()
    assert (r["alpha"], r["ret"], r["IC"]) == ("AlphaX", 2.5, None)


def test_upsert(spark):
    old, new = (spark.createDataFrame(x, "name string, content string") for x in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]))
    assert sorted(map(tuple, P.upsert(old, new).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_stream_of_bars(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    e = spark.read.parquet(src)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = bars.bars(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.outputMode("complete").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("bars_out")
    assert got.exceptAll(bars.bars(e)).count() == 0 and got.count() > 0


def test_empty_panel(spark):
    e = panel(spark, SERIES).where("false")
    for name in ("rollmean", "sec_zsc", "revwtg", "pct_rank"):
        assert level1.apply(e, name).count() == 0
    assert level2.apply(e, "mean").count() == 0 and fills.fill(e, "knn").count() == 0


def test_experiment(spark):
    from quillon import queries
    from quillon.plans import experiment

    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["experiment"](spark, sf).collect()
    assert got
    p, r = P.revenue_panel(spark, sf), queries.returns(spark, sf)
    for row in got[:2]:
        f = chain.Spec.read(row["spec"]).build(p)
        ic = evaluate.ic_summary(evaluate.ic_daily(f, r)).first()["ic"]
        assert ic == pytest.approx(abs(row["ic"]), abs=1e-5) and ic > 0
    assert experiment.stratified(1, 10, seed=1) == experiment.stratified(1, 10, seed=1)
    assert experiment.Experiment.read({"function_settings": {"level1": ["rollmean_3", "diff"], "level2": ["quantile_25"]}}).aggregates == ("quantile_25",)
    with pytest.raises(ValueError):
        experiment.Experiment.read({"function_settings": {"level1": ["nonsense_3"]}})


def test_files(spark, tmp_path):
    from quillon.sources import files

    p = panel(spark, SERIES, [None] * 5).select("code", F.col("bar").alias("ts"), "v")
    t = files.materialised(spark, str(tmp_path / "p"), lambda: p)
    assert files.materialised(spark, str(tmp_path / "p"), lambda: 1 / 0).count() == t.count() == 10
    assert files.read_slice(spark, str(tmp_path / "p"), "1", "3").count() == 3
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.txt").write_text("same")
    a, b = (files.file_hashes(spark, str(tmp_path / d)) for d in ("a", "b"))
    assert files.same_tree(a, b, f"{tmp_path}/a", f"{tmp_path}/b")
    small = spark.createDataFrame([("x|y", 1.5, None)], "a string, b double, c int")
    assert files.markdown(small).endswith("| x\\|y | 1.5 |  |") and files.html(small).startswith("<table><tr><th>a</th>")
    with pytest.raises(ValueError):
        files.markdown(p, 2)


def test_filter_settings(spark):
    from quillon.plans import experiment

    x = np.random.default_rng(6).normal(size=20)
    p = panel(spark, x)
    close(column(chain.step(p, "ewma(3)")), filters.ewma_kernel(20, 3) @ x)
    close(column(chain.step(p, "savgolfilt(7, 3)")), filters.savgol_kernel(20, 7, 3) @ x)
    close(column(chain.step(p, "ewma", {"ewma": {"span": 5}})), filters.ewma_kernel(20, 5) @ x)
    for bad in ("ewma(1, 2)", "abs_v(1)", "rollmean(1, 2)"):
        with pytest.raises(ValueError):
            chain.step(p, bad)
    e = experiment.Experiment.read({"function_settings": {"level1": ["ewma", "lowpfilt"]}, "filter_params": {"level1": {"filters": {"ewma_filter": {"span": 4}, "lowpass_filter": {"cutoff": 0.1, "fs": 1, "order": 2}, "dwt_ca": {"wavelet": "db1"}}}}})
    assert e.settings == {"ewma": {"span": 4}, "lowpfilt": {"cutoff": 0.2, "order": 2}}
    s = chain.Spec("x", "none", ("ewma",), "mean", 1, e.settings)
    assert chain.Spec.read(s.json()).build(p).first()["v"] == pytest.approx((filters.ewma_kernel(20, 4) @ x).mean())
    # series of unequal lengths have matrices of their own
    q = p.unionByName(panel(spark, x[:7]).withColumn("gid", F.lit(9).cast("long")))
    close([r["v"] for r in level1.apply(q, "kalfilt").where("gid = 9").orderBy("bar").collect()], filters.kalman_kernel(7) @ x[:7])


def test_greedy_selection_in_tables(spark):
    rng = np.random.default_rng(7)
    names = [f"n{i:02d}" for i in range(40)]
    for _ in range(3):
        scores = {n: float(round(rng.normal(), 1)) for n in names}
        edges = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.08]
        s, e = spark.createDataFrame(list(scores.items()), "name string, score double"), spark.createDataFrame(edges, "a string, b string")
        assert {r["name"] for r in evaluate.greedy(s, e).collect()} == set(evaluate.select_greedy(scores, edges))
    assert evaluate.greedy(s.where("false"), e.where("false")).count() == 0


def test_correlations_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 9)) + 1e6
    x[rng.random(x.shape) < 0.3] = np.nan
    rows = [(f"f{j}", i // 20, i % 20, float(x[i, j])) for i in range(300) for j in range(9) if not np.isnan(x[i, j])]
    f = spark.createDataFrame(rows, "name string, gid long, code long, v double")
    for block, part in ((256, 10**6), (3, 200), (2, 10**6)):
        monkeypatch.setattr(evaluate, "BLOCK", block)
        monkeypatch.setattr(evaluate, "ROWS", part)
        got = {(r["a"], r["b"]): (r["corr"], r["n"]) for r in evaluate.factor_corr(f).collect()}
        assert len(got) == 36
        for (a, b), (c, n) in got.items():
            p, q = x[:, int(a[1:])], x[:, int(b[1:])]
            both = ~np.isnan(p) & ~np.isnan(q)
            assert n == both.sum() and c == pytest.approx(np.corrcoef(p[both], q[both])[0, 1], abs=1e-6)
    assert evaluate.factor_corr(f, 0.9).count() == 0 and evaluate.factor_corr(f.where("false")).count() == 0


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(14, 6))
    x[rng.random(x.shape) < 0.35] = np.nan
    got = fills.knn(panel(spark, *[[None if np.isnan(v) else float(v) for v in x[:, j]] for j in range(6)]), 3)
    want = x.copy()
    for i in range(14):
        for j in range(6):
            if np.isnan(x[i, j]):
                d = []
                for o in range(14):
                    both = ~np.isnan(x[i]) & ~np.isnan(x[o])
                    if o != i and both.any() and not np.isnan(x[o, j]):
                        d.append((6 / both.sum() * ((x[i] - x[o])[both] ** 2).sum(), o))
                want[i, j] = np.mean([x[o, j] for _, o in sorted(d)[:3]]) if d else np.nanmean(x[:, j])
    for j in range(6):
        close(column(got, j), want[:, j])


def test_scaling_by_the_quantile(spark):
    rng = np.random.default_rng(10)
    for _ in range(25):
        x = rng.normal(size=int(rng.integers(1, 9))) * rng.choice([0.05, 0.1, 1, 10, 20])
        q = np.quantile(np.abs(x), 0.85)
        s = 0.1 if q > 10 else 10.0 if q < 0.1 else 1.0
        close(column(level1.apply(panel(spark, x), "sinh_scaled")), np.sinh(x * s) / s)


def test_thresholds_from_configurations(tmp_path):
    import json

    c = {**vars(classify.Thresholds()), "out_path": "x"}
    assert classify.Thresholds.read(c) == classify.Thresholds()
    (tmp_path / "c.json").write_text(json.dumps(c))
    assert classify.Thresholds.load(str(tmp_path / "c.json")) == classify.Thresholds()
    for bad in ({**c, "other": 1}, {k: v for k, v in c.items() if k != "dd"}, {**c, "ic": "high"}, {**c, "tvr_min": 99}):
        with pytest.raises(ValueError):
            classify.Thresholds.read(bad)


def test_grid_is_never_broadcast(spark):
    seen = spark.createDataFrame([(1, 0, 1.0), (1, 2, 3.0), (2, 1, 5.0), (3, 9, 7.0)], "code long, t long, v double")
    p = P.on_grid(seen, 3).where("v IS NOT NULL")
    assert sorted(map(tuple, p.collect())) == [(1, 0, 1.0), (1, 2, 3.0), (2, 1, 5.0)]
    assert "BroadcastExchange" not in p._jdf.queryExecution().executedPlan().toString()
