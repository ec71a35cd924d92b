import numpy as np
import pytest
from pyspark.sql import functions as F

from foreshock.operators.features import arrays, extract
from tests.helpers import slices


def values(df):
    return {r["feature"].split("__", 1)[1]: r["value"] for r in df.collect()}


def series(n, seed=0):
    return np.random.default_rng(seed).normal(5, 2, n)


@pytest.mark.parametrize("n", [10, 33])
def test_rows_against_numpy(spark, n):
    x = series(n)
    got = values(extract.extract_features(slices(spark, x), exclude=(), families=["moments", "changes", "locations", "counts"]))
    d = np.diff(x)
    m, s = x.mean(), x.std()
    g1 = np.sqrt(n * (n - 1)) / (n - 2) * ((x - m) ** 3).mean() / s**3
    assert np.isclose(got["skewness"], g1)
    assert np.isclose(got["mean_second_derivative_central"], (x[-1] - x[-2] - x[1] + x[0]) / (2 * (n - 2)))
    assert np.isclose(got["c3__lag_2"], (x[:-4] * x[2:-2] * x[4:]).mean())
    assert np.isclose(got["cid_ce__normalize_True"], np.sqrt((d**2).sum()) / s)
    assert got["first_location_of_maximum"] == x.argmax() / n
    assert np.isclose(got["last_location_of_minimum"], 1 - x[::-1].argmin() / n)
    parts = np.array_split(x, 10)
    for k in (0, 4, 9):
        assert np.isclose(got[f"energy_ratio_by_chunks__num_segments_10__segment_focus_{k}"], (parts[k] ** 2).sum() / (x**2).sum())
    peaks = sum(x[i] > max(x[i - 3 : i].max(), x[i + 1 : i + 4].max()) for i in range(3, n - 3))
    assert got["number_peaks__n_3"] == peaks


@pytest.mark.parametrize("n", [9, 48])
def test_spectrum_against_numpy(spark, n):
    x = series(n, 1)
    re, im = arrays.Slices(np.stack([x, 2 * x])).spectrum()
    f = np.fft.rfft(x)
    assert re.shape == (2, len(f)) and np.allclose(re[0] + 1j * im[0], f) and np.allclose(re[1] + 1j * im[1], 2 * f)


@pytest.mark.parametrize("n", [48, 600])
def test_welch_segments(spark, n):
    x = series(n, 2)
    length = min(n, 256)
    hop = length // 2
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    psd = []
    for a in range(0, n - length + 1, hop):
        seg = x[a : a + length]
        p = np.abs(np.fft.rfft(w * (seg - seg.mean()))) ** 2 / (w**2).sum()
        p[1:-1] *= 2
        psd.append(p)
    assert np.allclose(arrays.Slices(x[None, :]).density()[0], np.mean(psd, axis=0))


def test_wavelet_is_a_centred_convolution(spark):
    x = series(48, 3)
    for w in (2, 5, 20):
        k = min(10 * w, 48)
        t = np.arange(k) - (k - 1) / 2
        wav = 2 / (np.sqrt(3 * w) * np.pi**0.25) * (1 - t**2 / w**2) * np.exp(-(t**2) / (2 * w**2))
        assert np.allclose(x @ arrays.ricker(48, w, 48), np.convolve(x, wav, mode="same"))


def test_match_entropies_brute_force(spark):
    x = np.sin(np.arange(30)) + 0.05 * series(30, 4)
    got = values(extract.extract_features(slices(spark, x), families=["match_entropy"]))
    r = 0.2 * x.std()

    def count(m, size):
        t = [x[i : i + m] for i in range(size)]
        return sum(np.abs(a - b).max() <= r for i, a in enumerate(t) for j, b in enumerate(t) if i != j)

    assert np.isclose(got["sample_entropy"], -np.log(count(3, 28) / count(2, 28)))


def test_constant_slice_has_no_nan(spark):
    df = extract.extract_features(slices(spark, [3.0] * 20), exclude=())
    bad = df.where(F.isnan("value") | (F.abs("value") == float("inf"))).collect()
    assert bad == []


def test_only_exclude_and_names(spark):
    m = slices(spark, series(20))
    only = extract.extract_features(m, only=["m__mean", 'm__linear_trend__attr_"slope"'])
    assert {r["feature"] for r in only.collect()} == {"m__mean", 'm__linear_trend__attr_"slope"'}
    default = {f.split("__")[0] for f in values(extract.extract_features(m, families=["moments", "repeats"]))}
    assert "median" not in default and "has_duplicate" not in default and "mean" in default
    with pytest.raises(ValueError):
        extract.extract_features(m, only=["mean"])
    with pytest.raises(ValueError):
        extract.extract_features(m, families=["nope"])
    row = extract.describe_features(
        spark.createDataFrame([('dsar_f2-f3__change_quantiles__f_agg_"mean"__isabs_True__qh_0.8__ql_0.2',)], "feature string")
    ).first()
    assert row["description"] == "Change within quantiles (f_agg=mean, isabs=True, qh=0.8, ql=0.2) of DSAR ratio 2/4.5 Hz"
    assert row["short_name"] == "dsar_f2-f3 | chg_q(mean, True, 0.8, 0.2)"


def test_impute_and_missing_labels(spark):
    inf = float("inf")
    rows = [("s", i, "f", v) for i, v in enumerate([1.0, 3.0, 5.0, inf, -inf, None, float("nan")])]
    df = spark.createDataFrame(rows, "series string, id long, feature string, value double")
    assert [r["value"] for r in extract.impute(df).orderBy("id").collect()] == [1, 3, 5, 5, 1, 3, 3]
    some = spark.createDataFrame([("s", 0, 1), ("s", 2, 0)], "series string, id long, is_erupted int")
    assert [r["id"] for r in extract.relevant_ids(df, some).orderBy("id").collect()] == [0, 2]
    labels = spark.createDataFrame([("s", 99, 1)], "series string, id long, is_erupted int")
    with pytest.raises(Exception, match="have no features"):
        extract.relevant_ids(df, labels).collect()


@pytest.mark.parametrize("n", [1, 2, 3])
def test_tiny_slices(spark, n):
    df = extract.extract_features(slices(spark, [1.5, -2.0, 4.0][:n]), exclude=())
    assert df.where(F.isnan("value")).count() == 0
    assert extract.extract_features(slices(spark, [1.0]).where("false"), exclude=()).count() == 0
