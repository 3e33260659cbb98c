"""Signal filters over the bars of each code.

A linear filter is a matrix on the bars of a group, built with numpy on the driver: one row of a
small table for each length of series, holding the weights that are not 0. Each series becomes one
array by a single shuffle; the table is joined by the length of the series, and the filter is a dot
product of arrays, so rows are not multiplied by the filter's width, and neither the plan nor the
generated code grows with it. A full matrix has the square of a series' bars.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import fills
from quillon.sources.panel import val


def series(panel: DataFrame) -> DataFrame:
    """(gid, code, bars, x): the values of each series as one array in bar order."""
    s = F.array_sort(F.collect_list(F.struct("bar", "v")))
    return panel.groupBy("gid", "code").agg(s.alias("s")).select("gid", "code", F.expr("transform(s, e -> e.bar)").alias("bars"), F.expr("transform(s, e -> e.v)").alias("x"))


def rows(arrays: DataFrame, y: Column) -> DataFrame:
    return arrays.select("gid", "code", F.explode(F.arrays_zip("bars", y.alias("y"))).alias("e")).select("gid", "code", F.col("e.bars").alias("bar"), F.col("e.y").alias("v"))


def lengths(arrays: DataFrame, n: int | None = None) -> list[int]:
    """The lengths of the series; there are as many as there are kinds of groups (one, if groups are full)."""
    return [n] if n else sorted(r[0] for r in arrays.select(F.size("x").alias("n")).distinct().collect() if r[0] > 0)


def with_kernels(arrays: DataFrame, sizes: list[int], make, names: tuple[str, ...]) -> DataFrame:
    """The series with one column a matrix of ``make(n)``: array<struct<lo, w>>, the weights of each output from its first to its last that is not 0."""

    def packed(kernel):
        out = []
        for row in kernel:
            used = np.flatnonzero(np.abs(row) > 1e-15)
            lo, hi = (int(used[0]), int(used[-1]) + 1) if len(used) else (0, 1)
            out.append((lo, row[lo:hi].tolist()))
        return out

    table = [(n, *(packed(k) for k in make(n))) for n in sizes]
    kind = "array<struct<lo:int,w:array<double>>>"
    table = arrays.sparkSession.createDataFrame(table, ", ".join(["_n int", *(f"{x} {kind}" for x in names)]))
    # a row a length, each of at most the square of the bars: its size does not follow the number of series
    return arrays.join(F.broadcast(table), F.size("bars") == F.col("_n")).drop("_n")


def dot(kernel: str, x: str = "x") -> Column:
    """The array K x; an output is NULL if any value that it weighs is."""
    return F.expr(f"transform({kernel}, k -> aggregate(zip_with(slice({x}, k.lo + 1, size(k.w)), k.w, (a, b) -> if(b = 0D, 0D, a * b)), 0D, (s, p) -> s + p))")


def _poles(order: int) -> np.ndarray:
    return np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))


@lru_cache(None)
def butterworth(order: int, cut: tuple[float, ...], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth filter; cuts are shares of the Nyquist frequency."""
    w = [4 * np.tan(np.pi * c / 2) for c in cut]  # bilinear transform at a sampling rate of 2
    p = _poles(order)
    if kind == "low":
        p, z, gain = w[0] * p, np.zeros(0), w[0] ** order
    elif kind == "high":
        z, gain = np.zeros(order), np.real(1 / np.prod(-p))
        p = w[0] / p
    else:
        bw, mid = w[1] - w[0], np.sqrt(w[0] * w[1])
        q = p * bw / 2
        p = np.r_[q + np.sqrt(q * q - mid * mid), q - np.sqrt(q * q - mid * mid)]
        z, gain = np.zeros(order), bw**order
    zd, pd = (4 + z) / (4 - z), (4 + p) / (4 - p)
    gain = gain * np.real(np.prod(4 - z) / np.prod(4 - p))
    zd = np.r_[zd, -np.ones(len(pd) - len(zd))]
    return gain * np.real(np.poly(zd)), np.real(np.poly(pd))


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Direct-form filter along axis 0."""
    m = max(len(a), len(b))
    b, a = np.r_[b, np.zeros(m - len(b))] / a[0], np.r_[a, np.zeros(m - len(a))] / a[0]
    z = np.zeros((m, *x.shape[1:])) if state is None else np.concatenate([state, np.zeros((1, *x.shape[1:]))])
    y = np.empty_like(x, float)
    for i in range(len(x)):
        y[i] = b[0] * x[i] + z[0]
        for k in range(1, m):
            z[k - 1] = b[k] * x[i] + z[k] - a[k] * y[i]
    return y


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, over odd extensions, from steady states."""
    m = max(len(a), len(b))
    pad = min(3 * m, len(x) - 1)
    ext = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]])
    companion = np.zeros((m - 1, m - 1))
    companion[:, 0] = -a[1:]
    companion[: m - 2, 1:] += np.eye(m - 2)
    zi = np.linalg.solve(np.eye(m - 1) - companion, b[1:] - a[1:] * b[0])
    for _ in range(2):
        ext = lfilter(b, a, ext, zi[:, None] * ext[:1])[::-1]
    return ext[pad : pad + len(x)]


def savgol_kernel(n: int, window: int = 5, order: int = 2) -> np.ndarray:
    h = window // 2
    fit = np.linalg.pinv(np.vander(np.arange(-h, h + 1.0), order + 1))
    at = lambda t: np.vander([float(t)], order + 1)[0] @ fit
    k = np.zeros((n, n))
    for i in range(n):
        lo = min(max(i - h, 0), n - window)
        k[i, lo : lo + window] = at(i - lo - h)
    return k


def ewma_kernel(n: int, span: float = 10) -> np.ndarray:
    alpha, k = 2 / (span + 1), np.zeros((n, n))
    k[0, 0] = 1
    for i in range(1, n):
        k[i] = (1 - alpha) * k[i - 1]
        k[i, i] += alpha
    return k


def kalman_kernel(n: int, q: float = 0.01, r: float = 0.1) -> np.ndarray:
    """Local-level smoother that starts at the first value with variance 1; gains do not depend on the data."""
    e, m, p = np.eye(n), [], []
    pred_m, pred_p = [e[0]], [1.0]
    for i in range(n):
        gain = pred_p[i] / (pred_p[i] + r)
        m.append(pred_m[i] + gain * (e[i] - pred_m[i]))
        p.append((1 - gain) * pred_p[i])
        pred_m.append(m[i])
        pred_p.append(p[i] + q)
    out = [None] * n
    out[-1] = m[-1]
    for i in range(n - 2, -1, -1):
        out[i] = m[i] + p[i] / pred_p[i + 1] * (out[i + 1] - m[i])
    return np.array(out)


def hp_kernel(n: int, lam: float = 1600) -> np.ndarray:
    d = np.diff(np.eye(n), 2, axis=0)
    return np.linalg.inv(np.eye(n) + lam * d.T @ d)


def fourier_kernels(n: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(n)
    scale = np.where((k > 0) & (k < n - 1 + n % 2), 2.0, 1.0)[:, None] / n
    turn = 2 * np.pi * np.outer(k, k) / n
    return scale * np.cos(turn), -scale * np.sin(turn)


def haar_kernels(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Undecimated, causal, mirrored at the start: sums and differences (before minus now)."""
    low, high = np.zeros((n, n)), np.zeros((n, n))
    for i in range(n):
        before = i - 1 if i else min(1, n - 1)
        low[i, i] += 1 / np.sqrt(2)
        low[i, before] += 1 / np.sqrt(2)
        high[i, before] += 1 / np.sqrt(2)
        high[i, i] -= 1 / np.sqrt(2)
    return low, high


def pair_kernels(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimated: sums and differences of pairs of bars in the first half of the rows; an odd last bar is doubled."""
    low, high = np.zeros((n, n)), np.zeros((n, n))
    for i in range((n + 1) // 2):
        a, b = 2 * i, min(2 * i + 1, n - 1)
        low[i, a] += 1 / np.sqrt(2)
        low[i, b] += 1 / np.sqrt(2)
        high[i, a] += 1 / np.sqrt(2)
        high[i, b] -= 1 / np.sqrt(2)
    return low, high


def stretched(n: int) -> np.ndarray:
    """From decimated values, in the first half of the rows, to all bars: value i at bar 2i, straight lines between, the last one held."""
    out, last = np.zeros((n, n)), (n + 1) // 2 - 1
    for i in range(n):
        lo, hi = min(i // 2, last), min((i + 1) // 2, last)
        out[i, lo] += 0.5
        out[i, hi] += 0.5
    return out


def impulse_kernel(n: int, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    return lfilter(b, a, np.eye(n))


#: matrices by name, with their settings and the values that these have by default
KERNELS = {
    "savgolfilt": lambda n, window=5, order=2: savgol_kernel(n, window, order),
    "lowpfilt": lambda n, cutoff=0.02, order=5: impulse_kernel(n, *butterworth(order, (cutoff,), "low")),
    "highpfilt": lambda n, cutoff=0.02, order=5: impulse_kernel(n, *butterworth(order, (cutoff,), "high")),
    "bandpfilt": lambda n, low=0.02, high=0.1, order=5: impulse_kernel(n, *butterworth(order, (low, high), "band")),
    "butter_hpf": lambda n, cutoff=0.2, order=2: filtfilt(*butterworth(order, (cutoff,), "high"), np.eye(n)),
    "ewma": lambda n, span=10: ewma_kernel(n, span),
    "ewma_half": lambda n, alpha=0.5: ewma_kernel(n, 2 / alpha - 1),
    "kalfilt": lambda n, q=0.01, r=0.1: kalman_kernel(n, q, r),
    "hpfilt": lambda n, lam=1600: hp_kernel(n, lam),
    "dwt_ca_fver": lambda n: haar_kernels(n)[0],
    "dwt_da_fver": lambda n: haar_kernels(n)[1],
    "dwt_ca": lambda n: pair_kernels(n)[0],
    "dwt_da": lambda n: pair_kernels(n)[1],
    "dwt_ca_full": lambda n: stretched(n) @ pair_kernels(n)[0],
    "dwt_da_full": lambda n: stretched(n) @ pair_kernels(n)[1],
}
#: interpolated first, with gaps restored after
INTERPOLATED = frozenset({"butter_hpf", "hpfilt"})
#: interpolated first, with gaps left filled
FILLED = frozenset({"ewma_half"})
#: any gap empties the series
WHOLE_SERIES = frozenset({"dwt_ca_fver", "dwt_da_fver", "dwt_ca", "dwt_da", "dwt_ca_full", "dwt_da_full"})


def linear(panel: DataFrame, name: str, n: int | None = None, **settings) -> DataFrame:
    """A linear filter by name, with settings of its own (span, order, cutoff, lam and so on)."""
    base = fills.fill(panel, "interp_extrapolate") if name in INTERPOLATED | FILLED else panel
    s = series(base)
    s = with_kernels(s, lengths(s, n), lambda m: (KERNELS[name](m, **settings),), ("kernel",))
    y = dot("kernel")
    if name in WHOLE_SERIES:
        y = F.when(F.expr("exists(x, e -> e IS NULL)"), F.expr("transform(x, e -> cast(NULL AS double))")).otherwise(y)
    if name in ("dwt_ca", "dwt_da"):
        y = F.transform(y, lambda v, i: F.when(i < F.floor((F.size("x") + 1) / 2), v))
    out = rows(s, y)
    if name in INTERPOLATED:
        was = panel.select("gid", "code", "bar", val().isNull().alias("gap"))
        out = out.join(was, ["gid", "code", "bar"]).select("gid", "code", "bar", F.when(~F.col("gap"), val()).alias("v"))
    return out


def fourier(panel: DataFrame, what: str, n: int | None = None) -> DataFrame:
    s = series(panel)
    s = with_kernels(s, lengths(s, n), fourier_kernels, ("k_re", "k_im")).select("gid", "code", "bars", dot("k_re").alias("re"), dot("k_im").alias("im"))
    y = {
        "fft_r": F.col("re"),
        "fft_amp": F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b)),
        "fft_angle": F.zip_with("re", "im", lambda a, b: F.when(F.sqrt(a * a + b * b) >= 1e-10, F.atan2(b, a))),
    }[what]
    return rows(s, y)


def median_patch(panel: DataFrame, size: int = 5) -> DataFrame:
    """Medians of patches of ``size`` bars by ``size`` codes (in code order), zeros beyond the edges; a gap in the patch gives NULL.

    Each bar is one array of its codes' values; the arrays of ``size`` bars come together by a shift of rows, without a window over a group.
    """
    h = size // 2
    bars = panel.groupBy("gid", "bar").agg(F.array_sort(F.collect_list(F.struct("code", "v"))).alias("s"))
    near = bars.select("gid", F.explode(F.sequence(F.col("bar") - h, F.col("bar") + h)).alias("at"), F.col("bar").alias("of"), F.expr("transform(s, e -> e.v)").alias("x"))
    near = near.groupBy("gid", "at").agg(F.collect_list("x").alias("rows"), F.max(F.when(F.col("of") == F.col("at"), True)).alias("here")).where("here")
    j = bars.join(near.select(F.col("gid").alias("g"), "at", "rows"), (F.col("gid") == F.col("g")) & (F.col("bar") == F.col("at")))
    frame = f"flatten(transform(rows, r -> slice(r, greatest(i - {h - 1}, 1), least(i + {h + 1}, size(r)) - greatest(i - {h - 1}, 1) + 1)))"
    cells = size * size
    middle = f"""transform(array({frame}), f -> if(exists(f, e -> e IS NULL), NULL,
        try_element_at(array_sort(concat(f, array_repeat(0D, {cells} - size(f)))), {cells // 2 + 1})))[0]"""
    y = F.expr(f"transform(s, (e, i) -> named_struct('code', e.code, 'v', {middle}))")
    return j.select("gid", "bar", F.explode(y).alias("e")).select("gid", F.col("e.code").alias("code"), "bar", F.col("e.v").alias("v"))


def median_filter(panel: DataFrame, size: int = 5) -> DataFrame:
    """Running medians of each series, zeros beyond its ends; a gap in the window gives NULL."""
    h = size // 2
    s = series(panel).withColumn("p", F.concat(F.array_repeat(F.lit(0.0), h), "x", F.array_repeat(F.lit(0.0), h)))
    y = F.expr(f"transform(x, (v, i) -> if(exists(slice(p, i + 1, {size}), e -> e IS NULL), NULL, try_element_at(array_sort(slice(p, i + 1, {size})), {h + 1})))")
    return rows(s, y)


def robust_z(panel: DataFrame, limit: float = 3.0) -> DataFrame:
    """Outliers by median and MAD (lower medians) to NULL; a series with gaps, or a MAD of 0, stays as it is."""
    low = lambda a: f"try_element_at(array_sort({a}), int((size({a}) + 1) / 2))"
    s = series(panel).withColumn("med", F.expr(low("x"))).withColumn("d", F.expr("transform(x, v -> abs(v - med))")).withColumn("mad", F.expr(low("d")))
    y = F.expr(f"if(exists(x, e -> e IS NULL) OR mad = 0, x, transform(x, v -> if(abs(0.6745 * (v - med) / mad) > {limit}, NULL, v)))")
    return rows(s, y)


def rolling_rank(panel: DataFrame, size: int = 5) -> DataFrame:
    """Average rank of each bar among the last ``size`` interpolated bars, as a share; gaps restored."""
    s = series(fills.fill(panel, "interp_extrapolate"))
    frame = f"slice(x, greatest(i - {size - 2}, 1), least(i + 1, {size}))"
    y = F.expr(f"transform(x, (v, i) -> (size(filter({frame}, e -> e < v)) + (size(filter({frame}, e -> e = v)) + 1) / 2D) / size({frame}))")
    out = rows(s, y)
    return out.join(panel.select("gid", "code", "bar", F.col("v").alias("was")), ["gid", "code", "bar"]).select("gid", "code", "bar", F.when(F.col("was").isNotNull(), val()).alias("v"))


def adaptive(panel: DataFrame, mesa: bool = False, fast: int = 2, slow: int = 10) -> DataFrame:
    """Kaufman's adaptive average, or the difference of the Mesa pair; by code, a gap empties what follows."""
    f, w = 2 / (fast + 1), 2 / (slow + 1)
    frame = f"slice(x, greatest(i - {slow - 2}, 1), least(i + 1, {slow}))"
    mean = f"aggregate({frame}, 0D, (s, e) -> s + e, s -> s / size({frame}))"
    spread = f"aggregate(transform(array({mean}), m -> aggregate({frame}, 0D, (s, e) -> s + abs(e - m))), 0D, (s, e) -> s + e)"
    s = series(panel).withColumn("alpha", F.expr(f"transform(x, (v, i) -> if(i = 0, 0D, transform(array({spread}), q -> if(q < 1e-12, 0D, abs(v - try_element_at(x, i)) / q * {f - w!r}D + {w!r}D))[0]))"))
    step = "transform(array(acc.y + try_element_at(alpha, i) * (try_element_at(x, i) - acc.y)), y -> named_struct('y', y, 'z', acc.z + 0.5D * (y - acc.z), 'out', array_append(acc.out, {}(y, acc.z + 0.5D * (y - acc.z)))))[0]"
    body = step.replace("{}(y, acc.z + 0.5D * (y - acc.z))", "y - (acc.z + 0.5D * (y - acc.z))" if mesa else "y")
    y = F.expr(f"aggregate(sequence(2, size(x)), named_struct('y', x[0], 'z', x[0], 'out', array({'x[0] - x[0]' if mesa else 'x[0]'})), (acc, i) -> {body}, acc -> acc.out)")
    return rows(s, F.when(F.size("x") > 1, y).otherwise(F.expr("transform(x, v -> v - v)") if mesa else F.col("x")))


def hilbert_phase(panel: DataFrame) -> DataFrame:
    """Unwrapped phase of the analytic signal across the codes of each bar, in code order; a gap empties the bar."""

    def run(pdf):
        pdf = pdf.sort_values("code")
        x = pdf["v"].to_numpy(float)
        if np.isnan(x).any():
            return pdf.assign(v=np.nan)
        n = len(x)
        h = np.zeros(n)
        h[0] = 1
        h[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            h[n // 2] = 1
        return pdf.assign(v=np.unwrap(np.angle(np.fft.ifft(np.fft.fft(x) * h))))

    out = panel.select("gid", "code", "bar", "v").groupBy("gid", "bar").applyInPandas(run, "gid long, code long, bar long, v double")
    return out.withColumn("v", F.when(~F.isnan("v"), val()))


#: low-pass reconstruction taps of the four-moment Daubechies wavelet; fixed values
DB4 = (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278)


def wavelet_kernels(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(approximation part of the reconstruction, details, reconstruction from details) with half-sample mirroring."""
    lo = np.array(DB4)
    hi = lo[::-1] * np.array([(-1) ** i for i in range(8)])
    m = (n + 7) // 2
    pad = np.pad(np.arange(n), (7, 7), mode="symmetric")
    ca, cd = np.zeros((m, n)), np.zeros((m, n))
    for i in range(m):
        for j in range(8):
            at = pad[2 * i + 1 + 7 - j] if 2 * i + 8 - j < len(pad) else pad[-1]
            ca[i, at] += lo[::-1][j]
            cd[i, at] += hi[::-1][j]
    ra, rd = np.zeros((n, m)), np.zeros((n, m))
    for i in range(m):
        for j in range(8):
            t = 2 * i + j - 6
            if 0 <= t < n:
                ra[t, i] += lo[j]
                rd[t, i] += hi[j]
    return ra @ ca, cd, rd


def wavelet_denoise(panel: DataFrame, n: int | None = None) -> DataFrame:
    """One wavelet level, details soft-thresholded by their deviation pooled over the group; gaps restored."""
    s = series(fills.fill(panel, "interp_extrapolate"))
    s = with_kernels(s, lengths(s, n), wavelet_kernels, ("k_a", "k_d", "k_r")).select("gid", "code", "bars", dot("k_a").alias("a"), dot("k_d").alias("d"), "k_r")
    pooled = s.select("gid", F.size("bars").alias("n"), F.explode("d").alias("e")).groupBy("gid").agg((F.stddev_pop("e") * F.sqrt(2 * F.ln(F.max("n")))).alias("thr"))
    s = s.join(pooled, "gid", "left").withColumn("d", F.expr("transform(d, e -> signum(e) * greatest(abs(e) - thr, 0D))"))
    out = rows(s.withColumn("r", dot("k_r", "d")), F.zip_with("a", "r", lambda p, q: p + q))
    return out.join(panel.select("gid", "code", "bar", F.col("v").alias("was")), ["gid", "code", "bar"]).select("gid", "code", "bar", F.when(F.col("was").isNotNull(), val()).alias("v"))


FILTERS = {k: (lambda p, k=k, **settings: linear(p, k, **settings)) for k in KERNELS} | {k: (lambda p, k=k: fourier(p, k)) for k in ("fft_amp", "fft_angle", "fft_r")}
FILTERS |= {"medfilt": median_filter, "medfilt_patch": median_patch, "rob_zsfilt": robust_z, "rollrankfilt": rolling_rank, "kauama": adaptive, "hb_insphase": hilbert_phase, "wdfilt": wavelet_denoise}
FILTERS |= {"mesama": lambda p, fast=2, slow=10: adaptive(p, True, fast, slow)}
#: settings of each filter in the order in which f(a, b) gives them; fixed values
SETTINGS = {
    "savgolfilt": ("window", "order"), "lowpfilt": ("cutoff", "order"), "highpfilt": ("cutoff", "order"), "bandpfilt": ("low", "high", "order"), "butter_hpf": ("cutoff", "order"),
    "ewma": ("span",), "ewma_half": ("alpha",), "kalfilt": ("q", "r"), "hpfilt": ("lam",), "medfilt": ("size",), "medfilt_patch": ("size",), "rob_zsfilt": ("limit",), "rollrankfilt": ("size",),
    "kauama": ("fast", "slow"), "mesama": ("fast", "slow"),
}
#: filter and setting names of configurations; fixed values
CONFIGURED = {
    "savgol_filter": ("savgolfilt", {"window_length": "window", "polyorder": "order"}), "median_filter": ("medfilt", {"size": "size"}),
    "lowpass_filter": ("lowpfilt", {"cutoff": "cutoff", "order": "order"}), "highpass_filter": ("highpfilt", {"cutoff": "cutoff", "order": "order"}),
    "bandpass_filter": ("bandpfilt", {"lowcut": "low", "highcut": "high", "order": "order"}), "butter_highpass_filter": ("butter_hpf", {"cutoff": "cutoff", "order": "order"}),
    "ewma_filter": ("ewma", {"span": "span"}), "kalman_filter": ("kalfilt", {"transition_covariance": "q", "observation_covariance": "r"}), "hp_filter": ("hpfilt", {"lamb": "lam"}),
    "robust_zscore_filter": ("rob_zsfilt", {"threshold": "limit"}), "rolling_rank_filter": ("rollrankfilt", {"window": "size"}),
    "kaufman_adaptive_moving_average": ("kauama", {"fast_period": "fast", "slow_period": "slow"}), "mesa_adaptive_moving_average": ("mesama", {"fast_period": "fast", "slow_period": "slow"}),
}


def configured(filters: dict) -> dict[str, dict]:
    """Settings by filter, from a configuration's section of filters.

    Cut-off frequencies are divided by half the sampling rate (fs). Settings that no filter here has (wavelet, level, mode) are left out.
    """
    out = {}
    for given, values in filters.items():
        if given in CONFIGURED:
            name, keys = CONFIGURED[given]
            half = values.get("fs", 2) / 2
            out[name] = {ours: values[key] / half if ours in ("cutoff", "low", "high") else values[key] for key, ours in keys.items() if key in values}
    return out


def apply(panel: DataFrame, name: str, *args, **settings) -> DataFrame:
    """A filter by name, with settings in their order or by their names."""
    if name not in FILTERS:
        raise ValueError(f"unknown filter: {name}")
    known = SETTINGS.get(name, ())
    if len(args) > len(known) or set(settings) - set(known):
        raise ValueError(f"{name} has the settings {known}")
    return FILTERS[name](panel, **(settings | dict(zip(known, args, strict=False))))
