"""Calculators on whole slices: spectra, wavelets, template and ordinal entropies.

The slices of an Arrow batch that have one length are stacked into a matrix, so
a transform of all of them is one matrix product.  All wanted families share one
collection of the slices and one spectrum; the look-back bounds a slice.  Missing
values count as 0 in transforms and match no template.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.operators.features.rows import KEYS

# Parameter grids of the calculators.
FFT_COEFFS = 24
FFT_MOST = 99
WELCH_COEFFS = [2, 5, 8]
WELCH_LENGTH = 256
FOURIER_BINS = [2, 3, 5, 10, 100]
CWT_WIDTHS = [2, 5, 10, 20]
CWT_COEFFS = 15
RIDGE_WIDTHS = [1, 5]
PATTERN_SIZES = [3, 4, 5]
LONG_PATTERNS = [6, 7]
TOLERANCES = [0.1, 0.3, 0.5, 0.7, 0.9]
PARTIAL_LAGS = list(range(3, 10))

#: Numbers that one block of pairwise distances may hold.
PAIR_BLOCK = 4_000_000

Columns = dict[str, np.ndarray]


class Slices:
    """Stacked slices of one length with what several calculators share."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, x.shape[1]
        self.filled = np.nan_to_num(x, nan=0.0)
        self._spectrum: tuple[np.ndarray, np.ndarray] | None = None
        self._density: np.ndarray | None = None

    def spectrum(self) -> tuple[np.ndarray, np.ndarray]:
        """Real and imaginary part at k = 0 .. n / 2."""
        if self._spectrum is None:
            cos, sin = _waves(self.n)
            self._spectrum = self.filled @ cos, -(self.filled @ sin)
        return self._spectrum

    def density(self) -> np.ndarray:
        """Hann-windowed spectral density at unit sampling rate; longer slices are cut into half-overlapping segments that are averaged."""
        if self._density is None:
            size = min(self.n, WELCH_LENGTH)
            hop = max(size // 2, 1)
            cos, sin = _waves(size)
            w = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(size) / size)
            k = np.arange(size // 2 + 1)
            sides = np.where((k == 0) | (2 * k == size), 1.0, 2.0)
            parts = []
            for s in range((self.n - size) // hop + 1):
                part = self.x[:, s * hop : s * hop + size]
                held = np.isfinite(part)
                mean = np.where(held, part, 0.0).sum(1) / np.maximum(held.sum(1), 1)
                z = (np.where(held, part, 0.0) - mean[:, None]) * w
                parts.append(((z @ cos) ** 2 + (z @ sin) ** 2) * sides / ((w * w).sum() or np.nan))
            self._density = np.mean(parts, axis=0)
        return self._density


@lru_cache(maxsize=16)
def _waves(n: int) -> tuple[np.ndarray, np.ndarray]:
    turn = 2 * math.pi * (np.outer(np.arange(n), np.arange(n // 2 + 1)) % n) / n
    return np.cos(turn), np.sin(turn)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / np.where(b != 0, b, 1.0), np.nan)


def _coefficients(s: Slices, low: int, high: int) -> Columns:
    re, im = s.spectrum()
    size = np.hypot(re, im)
    angle = np.where(size >= 1e-9, np.degrees(np.arctan2(im, re)), np.nan)
    none, out = np.full(len(re), np.nan), {}
    for k in range(low, high + 1):
        for attr, v in (("real", re), ("imag", im), ("abs", size), ("angle", angle)):
            out[f'fft_coefficient__attr_"{attr}"__coeff_{k}'] = v[:, k] if k < v.shape[1] else none
    return out


def fft(s: Slices) -> Columns:
    out = _coefficients(s, 0, FFT_COEFFS)
    mag = np.hypot(*s.spectrum())
    k, total = np.arange(mag.shape[1], dtype=float), mag.sum(1)
    m1, m2, m3, m4 = (_ratio((mag * k**p).sum(1), total) for p in (1, 2, 3, 4))
    var = m2 - m1 * m1
    wide = np.where(var >= 0.5, var, np.nan)
    out['fft_aggregated__aggtype_"centroid"'] = m1
    out['fft_aggregated__aggtype_"variance"'] = var
    out['fft_aggregated__aggtype_"skew"'] = (m3 - 3 * m1 * var - m1**3) / wide**1.5
    out['fft_aggregated__aggtype_"kurtosis"'] = (m4 - 4 * m1 * m3 + 6 * m2 * m1 * m1 - 3 * m1**4) / wide**2
    return out


def fft_high(s: Slices) -> Columns:
    return _coefficients(s, FFT_COEFFS + 1, FFT_MOST)


def _entropy(codes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Entropy of the codes of every row where ``held``; rows without any have none."""
    row = np.repeat(np.arange(len(codes)), codes.shape[1])[held.ravel()]
    pair, count = np.unique(np.stack([row, codes.ravel()[held.ravel()]]), axis=1, return_counts=True)
    total = np.bincount(row, minlength=len(codes))
    p = count / total[pair[0]]
    return np.where(total > 0, np.bincount(pair[0], -p * np.log(p), minlength=len(codes)) + 0.0, np.nan)


def welch(s: Slices) -> Columns:
    d = s.density()
    none = np.full(len(d), np.nan)
    out = {f"spkt_welch_density__coeff_{c}": d[:, c] if c < d.shape[1] else none for c in WELCH_COEFFS}
    low, high = d.min(1, keepdims=True), d.max(1, keepdims=True)
    held = np.broadcast_to(high > low, d.shape)
    for bins in FOURIER_BINS:
        # Rounded so that a share on a bin edge falls the same way everywhere.
        share = np.floor((d - low) / np.where(high > low, high - low, 1.0) * bins * 1e9 + 0.5) / 1e9
        out[f"fourier_entropy__bins_{bins}"] = _entropy(np.minimum(np.floor(share), bins - 1).astype(np.int64), held)
    return out


def ricker(n: int, width: int, outputs: int) -> np.ndarray:
    """n x outputs matrix of the Ricker response of ``width`` at each output; its support is at most ten widths."""
    points = min(10 * width, n)
    offset = np.arange(outputs)[None, :] + (points - 1) // 2 - np.arange(n)[:, None]
    z = (offset - (points - 1) / 2.0) ** 2 / float(width * width)
    shape = 2 / (math.sqrt(3 * width) * math.pi**0.25) * (1 - z) * np.exp(-z / 2)
    return np.where((offset >= 0) & (offset < points), shape, 0.0)


def cwt(s: Slices) -> Columns:
    widths, out = "(" + ", ".join(map(str, CWT_WIDTHS)) + ")", {}
    for w in CWT_WIDTHS:
        response = s.filled @ ricker(s.n, w, CWT_COEFFS)
        out |= {f"cwt_coefficients__coeff_{c}__w_{w}__widths_{widths}": response[:, c] for c in range(CWT_COEFFS)}
    return out


def _maxima(y: np.ndarray) -> np.ndarray:
    top = np.zeros(y.shape, bool)
    top[:, 1:-1] = (y[:, 1:-1] > y[:, :-2]) & (y[:, 1:-1] > y[:, 2:])
    return top


def cwt_peaks(s: Slices) -> Columns:
    """Positions that are strict local maxima of the response at two or more widths."""
    often = sum(_maxima(s.filled @ ricker(s.n, w, s.n)).astype(int) for w in CWT_WIDTHS)
    return {"number_cwt_peaks__widths_2": (often >= 2).sum(1).astype(float)}


def ridge_count(tops: list[np.ndarray], narrow: np.ndarray, response: list[np.ndarray]) -> int:
    """Ridge lines through the maxima ``tops`` of every width that are long and loud enough.

    Lines start at the widest response with a maximum and go on to the narrower
    ones: a maximum joins the line that ended nearest, if within a quarter of its
    width, else it starts a line; a line may miss one width.  A line counts if it
    has maxima at a quarter of the widths and its narrowest one reaches the tenth
    percentile of the narrowest response around it.
    """
    n, lines, done = len(narrow), [], []
    for row in range(len(tops) - 1, -1, -1):
        if not lines and not done and not len(tops[row]):
            continue
        for line in lines:
            line["gap"] += 1
        ends = np.array([line["end"] for line in lines])
        for col in tops[row].tolist():
            line = None
            if len(ends):
                nearest = int(np.argmin(np.abs(ends - col)))
                if abs(ends[nearest] - col) <= (row + 1) / 4.0:
                    line = lines[nearest]
            if line is None:
                lines.append({"size": 1, "row": row, "first": col, "end": col, "gap": 0})
                continue
            if line["row"] != row:
                line["first"] = col
            line.update(size=line["size"] + 1, row=row, end=col, gap=0)
        done += [line for line in lines if line["gap"] > 1]
        lines = [line for line in lines if line["gap"] <= 1]
    half, odd = divmod(math.ceil(n / 20), 2)
    count = 0
    for line in [*done, *lines]:
        if line["size"] < math.ceil(len(tops) / 4):
            continue
        at = line["first"]
        noise = np.percentile(narrow[max(at - half, 0) : min(at + half + odd, n)], 10)
        with np.errstate(divide="ignore", invalid="ignore"):
            loud = abs(response[line["row"]][at] / noise)
        count += not loud < 1
    return count


def ridge_peaks(s: Slices) -> Columns:
    responses = [s.filled @ ricker(s.n, w, s.n) for w in range(1, max(RIDGE_WIDTHS) + 1)]
    tops = [_maxima(r) for r in responses]
    out = {}
    for most in RIDGE_WIDTHS:
        count = [ridge_count([np.flatnonzero(t[i]) for t in tops[:most]], responses[0][i], [r[i] for r in responses[:most]]) for i in range(len(s.x))]
        out[f"number_cwt_peaks__n_{most}"] = np.array(count, float)
    return out


def _matches(s: Slices, tolerances: Sequence[float], use: Callable[[int, np.ndarray, list[np.ndarray]], None]) -> None:
    """Calls ``use`` (tolerance number, rows, matrices of matches at 1, 2 and 3 points) for blocks of slices; the distances are made once for all tolerances."""
    step = max(1, PAIR_BLOCK // (s.n * s.n))
    spread = np.where(_has_spread(s), s.x.std(axis=1), 0.0)
    for a in range(0, len(s.x), step):
        x = s.x[a : a + step]
        far = [np.abs(x[:, :, None] - x[:, None, :])]
        for m in (1, 2):
            far.append(np.maximum(far[-1][:, :-1, :-1], far[0][:, m:, m:]))
        for t, tolerance in enumerate(tolerances):
            near = tolerance * spread[a : a + step, None, None]
            use(t, np.arange(a, a + len(x)), [d <= near for d in far])


def _approximate(near: list[np.ndarray]) -> np.ndarray:
    with np.errstate(divide="ignore"):
        phi = [np.log(d.mean(axis=2)).mean(axis=1) for d in near[1:]]
    return np.abs(phi[0] - phi[1])


def _has_spread(s: Slices) -> np.ndarray:
    """Slices of at least four values that are not all equal; none if a value is missing."""
    return (s.x.max(axis=1) > s.x.min(axis=1)) & (s.n >= 4)


def match_entropy(s: Slices) -> Columns:
    near_, sample = np.full(len(s.x), np.nan), np.full(len(s.x), np.nan)

    def use(_, rows: np.ndarray, near: list[np.ndarray]) -> None:
        near_[rows] = _approximate(near)
        b = near[1][:, :-1, :-1].sum(axis=(1, 2)) - (s.n - 2)
        a = near[2].sum(axis=(1, 2)) - (s.n - 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            sample[rows] = np.where((a > 0) & (b > 0), -np.log(a / b), np.nan)

    if s.n >= 4:
        _matches(s, [0.2], use)
    ok = _has_spread(s)
    return {"approximate_entropy__m_2__r_0.2": np.where(ok, near_, np.nan), "sample_entropy": np.where(ok, sample, np.nan)}


def match_entropy_grid(s: Slices) -> Columns:
    out = np.full((len(TOLERANCES), len(s.x)), np.nan)

    def use(t: int, rows: np.ndarray, near: list[np.ndarray]) -> None:
        out[t, rows] = _approximate(near)

    if s.n >= 4:
        _matches(s, TOLERANCES, use)
    ok = _has_spread(s)
    return {f"approximate_entropy__m_2__r_{r}": np.where(ok, v, np.nan) for r, v in zip(TOLERANCES, out, strict=True)}


def _patterns(s: Slices, sizes: Sequence[int]) -> Columns:
    """Entropy of ordinal patterns as Lehmer codes; equal values rank by position."""
    out, n = {}, s.n
    larger = np.zeros((max(sizes), len(s.x), n), np.int64)  # how many of the next k values are below
    for k in range(1, max(sizes)):
        larger[k] = larger[k - 1]
        if n > k:
            larger[k][:, : n - k] += ~(s.x[:, : n - k] <= s.x[:, k:])
    for size in sizes:
        if n < size:
            out[f"permutation_entropy__dimension_{size}__tau_1"] = np.full(len(s.x), np.nan)
            continue
        code = np.zeros((len(s.x), n - size + 1), np.int64)
        for i in range(size - 1):
            code = code * (size - i) + larger[size - 1 - i][:, i : i + n - size + 1]
        out[f"permutation_entropy__dimension_{size}__tau_1"] = _entropy(code, np.ones(code.shape, bool))
    return out


def partial_long(s: Slices) -> Columns:
    """Partial autocorrelations at longer lags, by the Levinson recursion on unbiased autocovariances."""
    out = {f"partial_autocorrelation__lag_{k}": np.full(len(s.x), np.nan) for k in PARTIAL_LAGS}
    most = min(max(PARTIAL_LAGS), s.n // 2 - 1)
    z = np.where(_has_spread(s)[:, None], s.x - s.x.mean(axis=1, keepdims=True), 0.0)
    g = [(z[:, : s.n - k] * z[:, k:]).sum(1) / (s.n - k) for k in range(max(most, 0) + 1)]
    if most < 1:
        return out
    phi, noise = [_ratio(g[1], g[0])], g[0] * (1 - _ratio(g[1], g[0]) ** 2)
    for k in range(2, most + 1):
        last = _ratio(g[k] - sum(p * g[k - 1 - i] for i, p in enumerate(phi)), noise)
        phi = [p - last * q for p, q in zip(phi, phi[::-1], strict=True)] + [last]
        noise = noise * (1 - last**2)
        if k in PARTIAL_LAGS:
            out[f"partial_autocorrelation__lag_{k}"] = last
    return out


FAMILIES: dict[str, Callable[[Slices], Columns]] = {
    "permutation_entropy": lambda s: _patterns(s, PATTERN_SIZES),
    "permutation_long": lambda s: _patterns(s, LONG_PATTERNS),
    "match_entropy": match_entropy,
    "match_entropy_grid": match_entropy_grid,
    "partial_long": partial_long,
    "fft": fft,
    "fft_high": fft_high,
    "welch": welch,
    "cwt": cwt,
    "cwt_peaks": cwt_peaks,
    "ridge_peaks": ridge_peaks,
}

#: Calculators of each family, so that a family nobody asked for is not built.
CALCULATORS: dict[str, list[str]] = {
    "permutation_entropy": ["permutation_entropy"],
    "permutation_long": ["permutation_entropy"],
    "match_entropy": ["approximate_entropy", "sample_entropy"],
    "match_entropy_grid": ["approximate_entropy"],
    "partial_long": ["partial_autocorrelation"],
    "fft": ["fft_coefficient", "fft_aggregated"],
    "fft_high": ["fft_coefficient"],
    "welch": ["spkt_welch_density", "fourier_entropy"],
    "cwt": ["cwt_coefficients"],
    "cwt_peaks": ["number_cwt_peaks"],
    "ridge_peaks": ["number_cwt_peaks"],
}
#: Computed only when asked for by name: other families have the default settings of the same calculator.
ON_REQUEST = ["cwt_peaks"]


def feature_names(family: str) -> list[str]:
    return list(FAMILIES[family](Slices(np.zeros((1, 8)))))


def compute(x: np.ndarray, families: Sequence[str], names: Sequence[str]) -> np.ndarray:
    """slices x names matrix of the features of stacked slices of one length."""
    s, found = Slices(x), {}
    for f in families:
        found |= FAMILIES[f](s)
    return np.stack([found[n] for n in names], axis=1)


def feature_rows(made: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long form of ``(series, id, metric, _f)`` with one value per name; NaN becomes NULL."""
    labels = F.array(*[F.lit(n) for n in names])
    cells = made.select("series", "id", "metric", F.posexplode("_f").alias("_k", "value"))
    value = F.nanvl("value", F.lit(None).cast("double"))
    return cells.select("series", "id", F.concat("metric", F.lit("__"), F.get(labels, F.col("_k"))).alias("feature"), value.alias("value"))


def array_features(matrix: DataFrame, wanted: Callable[[str], bool], families: Sequence[str]) -> DataFrame | None:
    """All wanted features of the ``families`` of the slices in ``matrix`` in one pass, long form."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "v")))
    slices = matrix.groupBy(*KEYS).agg(ordered.alias("_a")).select(*KEYS, F.col("_a.v").cast("array<double>").alias("v"))
    return features_of_arrays(slices, wanted, families)


def features_of_arrays(slices: DataFrame, wanted: Callable[[str], bool], families: Sequence[str]) -> DataFrame | None:
    """The same of slices given as ordered arrays ``v`` (series, id, metric, v); None if nothing is wanted."""
    named = {f: [n for n in feature_names(f) if wanted(n)] for f in families}
    used, names = [f for f in named if named[f]], [n for f in named for n in named[f]]
    if not names:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = np.full((b.num_rows, len(names)), np.nan)
                arrays = [np.asarray(v, float) for v in b.column("v").to_pylist()]
                size = np.array([len(v) for v in arrays])
                for n in np.unique(size[size > 0]):
                    rows = np.flatnonzero(size == n)
                    out[rows] = compute(np.stack([arrays[i] for i in rows]), used, names)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(names), pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEYS), lists], [*KEYS, "_f"])

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slices.schema if f.name in KEYS)
    return feature_rows(slices.select(*KEYS, "v").mapInArrow(run, f"{keys}, _f array<double>"), names)
