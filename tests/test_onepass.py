"""One scan and one exchange of raw size, and values against plain loops."""

import math
import re
from datetime import datetime, timedelta

import numpy as np
import pytest

from foreshock.operators import onepass, signal

START = datetime(2025, 1, 1)


@pytest.fixture
def stored_samples(spark, tmp_path):
    """Three days, two series, three bands, with gaps, missing and zero values, repeated instants, and hours without samples."""
    rng = np.random.default_rng(6)
    rows = []
    for series in ("s", "z"):
        for band in ("a", "b", "c"):
            t = np.sort(rng.uniform(0, 3 * 86400, 700))
            t = t[(t < 30000) | (t > 45000)]
            x = rng.normal(0, 1, len(t)) * 10 ** rng.uniform(0, 2)
            x[rng.integers(0, len(x), 5)] = 0.0
            for i, (a, v) in enumerate(zip(t, x, strict=True)):
                rows.append((series, band, START + timedelta(seconds=float(int(a))), None if i % 97 == 5 else float("nan") if i % 97 == 6 else float(v)))
    path = str(tmp_path / "samples")
    spark.createDataFrame(rows, "series string, band string, ts timestamp, x double").repartition(4).write.parquet(path)
    return spark.read.parquet(path), rows


def plain_integral(rows):
    out, state = {}, {}
    for series, band, ts, x in sorted((r for r in rows if r[3] is not None and r[3] == r[3]), key=lambda r: (r[0], r[1], r[2], r[3])):
        key = (series, band, ts.date())
        before = state.get(key)
        y = 0.0 if before is None else before[2] + (x + before[1]) / 2 * (ts - before[0]).total_seconds()
        state[key] = (ts, x, y)
        out.setdefault((series, band, ts), []).append(y)
    return out


def magnitude(values):
    a = np.abs([v for v in values if v])
    if not len(a):
        return None
    m, sd = a.mean(), a.std()
    return (a.sum() - a.max()) / (len(a) - 1) if sd > 0 and (a.max() - m) / sd > 3 else m


def test_integral_equals_a_loop(stored_samples):
    samples, rows = stored_samples
    want, got = plain_integral(rows), {}
    for r in signal.integrate(samples).collect():
        got.setdefault((r["series"], r["band"], r["ts"]), []).append(r["x"])
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(sorted(got[k]), sorted(v), rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("seconds", [600, 7200])
def test_table_equals_loops(stored_samples, seconds):
    samples, rows = stored_samples
    bands = ["a", "b", "c"]
    got = {(r["series"], r["ts"]): r for r in signal.tremor_table(samples, seconds, bands).collect()}
    window = lambda ts: START + timedelta(seconds=(ts - START).total_seconds() // seconds * seconds)
    raw, deep, pooled = {}, {}, {}
    for s, b, ts, x in rows:
        if x is not None and x == x:
            raw.setdefault((s, window(ts), b), []).append(x)
            pooled.setdefault((s, window(ts)), []).append(x)
    for (s, b, ts), ys in plain_integral(rows).items():
        deep.setdefault((s, window(ts), b), []).extend(ys)
    checked = 0
    for (s, ts), r in got.items():
        for i, b in enumerate(bands):
            want = magnitude(raw.get((s, ts, b), []))
            assert (r[f"rsam_f{i}"] is None) == (want is None) and (want is None or np.isclose(r[f"rsam_f{i}"], want))
        for i in range(2):
            top, bottom = (magnitude(deep.get((s, ts, b), [])) for b in bands[i : i + 2])
            want = top / bottom if top is not None and bottom else None
            v = r[f"dsar_f{i}-f{i + 1}"]
            assert (v is None) == (want is None) and (want is None or np.isclose(v, want, rtol=1e-6))
        a = np.abs([v for v in pooled.get((s, ts), []) if v])
        if len(a) > 3 and a.std() > 0:
            if (a.max() - a.mean()) / a.std() > 3:
                a = np.delete(a, a.argmax())
            y = np.exp(-((a - a.mean()) ** 2) / (2 * a.var())) / (a.std() * math.sqrt(2 * math.pi))
            if (a**2).sum() >= 1 and (y > 0).all():
                assert np.isclose(r["entropy"], -(y * np.log2(y)).sum(), rtol=1e-6)
                checked += 1
    assert checked > 20


def test_entropy_of_its_own_band(stored_samples):
    samples, _ = stored_samples
    one = signal.shannon_entropy(samples.where("band = 'b'"), 3600).collect()
    assert sorted(signal.shannon_entropy(samples, 3600, band="b").collect(), key=repr) == sorted(one, key=repr)
    table = {(r["series"], r["ts"]): r["entropy"] for r in signal.tremor_table(samples, 3600, ["a", "b", "c"], entropy_band="b").collect()}
    assert all(table[r["series"], r["ts"]] == r["v"] for r in one) and any(r["v"] for r in one)


@pytest.mark.parametrize("make", [signal.integrate, lambda s: signal.dsar(s, 600, ["a", "b", "c"]), lambda s: onepass.reduced(s, 600), lambda s: signal.shannon_entropy(s, 600)])
def test_one_scan_and_one_raw_exchange(spark, stored_samples, make):
    df = make(stored_samples[0])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1
    raw = re.findall(r"(?<!\], )Exchange hashpartitioning\(deal#\d+L?, \d+\), REPARTITION_BY_COL", plan)
    assert len(raw) == 1
    assert "band" in plan and "CartesianProduct" not in plan


def test_table_reads_its_samples_once(spark, stored_samples):
    """All metrics come from one persisted reduced table; nothing else reads the samples."""
    df = signal.tremor_long(stored_samples[0], 600, ["a", "b", "c"])
    plan = df._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan and not re.search(r"(?<!InMemory)Relation \[", plan)
