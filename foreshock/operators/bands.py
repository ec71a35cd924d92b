"""Band filters over pieces of a series, by overlap-save.

A filter's kernel dies away at a rate that its poles give, so a sample's result
depends on no more than a halo of samples around it.  Series are cut into pieces
of equal length; samples near a border are also sent to the neighbour, and each
piece is one product of spectra per band.  A group is a piece, whatever the
length of a series or its days, and results do not depend on where pieces end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``(name, low corner, high corner)`` in Hz.
Band = tuple[str, float, float]

ORDER = 4
SMALLEST_PIECE = 1 << 16


def check_bands(bands: Sequence[Band], rate: float) -> None:
    if not bands or rate <= 0:
        raise ValueError("bands and a positive rate are needed")
    if len({b[0] for b in bands}) < len(bands):
        raise ValueError("names of bands repeat")
    for name, low, high in bands:
        if not 0.0 < low < high <= rate / 2:
            raise ValueError(f"band {name} must satisfy 0 < low < high <= {rate / 2}")


def halo_samples(low: float, high: float, rate: float, tolerance: float) -> int:
    """Samples after which the slowest pole of the band has decayed to ``tolerance``."""
    centre, width = 2 * math.pi * math.sqrt(low * high), 2 * math.pi * (high - low)
    angles = math.pi / 2 + (2 * np.arange(ORDER) + 1) * math.pi / (2 * ORDER)
    scaled = np.exp(1j * angles) * width
    root = np.sqrt(scaled * scaled - 4 * centre * centre)
    slowest = np.abs(np.concatenate([scaled + root, scaled - root]).real / 2).min()
    return int(math.ceil(math.log(1.0 / tolerance) / slowest * rate)) + 1


def gain(freq: np.ndarray, low: float, high: float) -> np.ndarray:
    """Amplitude response of a Butterworth band-pass of four corners."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        shape = ((freq * freq - low * high) / (freq * (high - low))) ** (2 * ORDER)
        return np.where(freq > 0, 1.0 / np.sqrt(1.0 + shape), 0.0)


def kernel_points(halo: int) -> int:
    """Points of the spectrum that a kernel is taken from."""
    return 1 << max(12, (8 * halo).bit_length())


def kernel(low: float, high: float, rate: float, halo: int) -> np.ndarray:
    """Symmetric kernel of ``2 halo + 1`` weights that sum to zero, so a constant offset never leaks."""
    n = kernel_points(halo)
    whole = np.fft.irfft(gain(np.fft.rfftfreq(n, 1.0 / rate), low, high), n)
    weights = np.concatenate([whole[n - halo :], whole[: halo + 1]])
    return weights - weights.mean()


def bandpass(samples: DataFrame, bands: Sequence[Band], rate: float, tolerance: float = 1e-6, piece: int | None = None) -> DataFrame:
    """``(series, band, ts, x)``: every sample of ``samples(series, ts, x)`` once per band, filtered.

    The gain is ``1 / sqrt(1 + ((f^2 - f0^2) / (f bw))^8)`` with zero phase; a
    causal recursive filter has the same gain but shifts phase.  Kernels end
    where the slowest pole has decayed to ``tolerance``.  A missing sample (NULL
    or NaN) counts as zero for its neighbours and stays NULL; rows at one place
    of the grid of ``rate`` count by their mean; rows without ``ts`` are left
    out.  ``piece`` is the number of places in a piece, at least four halos of
    the slowest band (the default, but no less than 65,536), so at most half a
    piece is sent twice.  One exchange of the samples serves all bands.
    """
    check_bands(bands, rate)
    if not 0.0 < tolerance < 1.0:
        raise ValueError("tolerance must be in (0, 1)")
    halos = [halo_samples(low, high, rate, tolerance) for _, low, high in bands]
    widest = max(halos)
    length = max(SMALLEST_PIECE, 4 * widest) if piece is None else piece
    if length < 4 * widest:
        raise ValueError(f"a piece must have at least {4 * widest} places")
    n = 1 << (length + 2 * widest).bit_length()
    kernels = [kernel(low, high, rate, halo) for (_, low, high), halo in zip(bands, halos, strict=True)]

    def one_piece(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["_piece"].iloc[0]) * length - widest
        place = pdf["_place"].to_numpy() - first
        x = pdf["x"].to_numpy(dtype=float)
        there = ~np.isnan(x)
        count = np.bincount(place[there], minlength=n)
        trace = np.bincount(place[there], weights=x[there], minlength=n) / np.maximum(count, 1)
        own = pdf["_own"].to_numpy(dtype=bool)
        mine, at, there = pdf.loc[own, ["series", "ts"]], place[own], there[own]
        if not len(mine):
            return mine.assign(band=mine["series"].astype(str), x=0.0)[["series", "band", "ts", "x"]]
        spectrum, out = np.fft.rfft(trace), []
        for (name, _, _), halo, k in zip(bands, halos, kernels, strict=True):
            weights = np.zeros(n)
            weights[: 2 * halo + 1] = k
            filtered = np.fft.irfft(spectrum * np.fft.rfft(weights), n)
            out.append(mine.assign(band=name, x=np.where(there, filtered[at + halo], np.nan)))
        return pd.concat(out)[["series", "band", "ts", "x"]]

    place = F.round(F.unix_micros("ts") * F.lit(rate / 1e6)).cast("long")
    placed = samples.where(F.col("ts").isNotNull()).select("series", "ts", F.col("x").cast("double").alias("x"), place.alias("_place"))
    near = lambda shift: F.floor((F.col("_place") + F.lit(shift)) / F.lit(length)).cast("long")
    dealt = placed.select("*", near(0).alias("_home"), F.explode(F.array_distinct(F.array(near(-widest), near(0), near(widest)))).alias("_piece"))
    grouped = dealt.select("series", "ts", "x", "_place", "_piece", (F.col("_home") == F.col("_piece")).alias("_own")).groupBy("series", "_piece")
    out = grouped.applyInPandas(one_piece, "series string, band string, ts timestamp, x double")
    return out.withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
