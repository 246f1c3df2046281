"""Clipped yearly sine, rank correlation with ties, order statistics by position."""

import datetime

import numpy as np
import pandas as pd

from basinspark.operators import experiments as x
from basinspark.operators import timeseries as t


def test_clipped_sine(spark):
    r = np.random.default_rng(3)
    days = [datetime.date(2001, 1, 1) + datetime.timedelta(int(i)) for i in range(730)]
    at = np.array([(d.timetuple().tm_yday - 1) / 365 for d in days])
    model = lambda m, a, f: np.maximum(0, m * (1 + a * np.sin(2 * np.pi * (at - f))))
    series = {"flat": model(2, 0.3, 0.2), "dry": model(1, 3, 0.9), "noisy": model(3, 1.5, 0.55) + r.normal(0, 0.5, 730), "zero": np.zeros(730), "below": -np.ones(730)}
    rows = [(k, d, float(v)) for k, vs in series.items() for d, v in zip(days, vs, strict=True)] + [("flat", days[0], None), ("empty", days[0], None)]
    got = {g.basin: g for g in t.sine_fit_clipped(spark.createDataFrame(rows, "basin string, d date, p double"), ["basin"], "d", "p").collect()}
    assert set(got) == set(series)
    for k, want in (("flat", (2, 0.3, 0.2)), ("dry", (1, 3, 0.9))):
        assert np.allclose((got[k].level, got[k].amplitude, got[k].phase), want, atol=1e-5)
    assert got["zero"].level == 0 and got["zero"].amplitude is None and got["below"].level == -1 and got["below"].phase is None
    # no point of a dense grid is better
    y, g = series["noisy"], got["noisy"]
    error = lambda *p: ((model(*p) - y) ** 2).sum()
    least = min(error(m, a, f) for m in np.linspace(2.5, 3.5, 21) for a in np.linspace(1, 2, 21) for f in np.linspace(0.5, 0.6, 21))
    assert error(g.level, g.amplitude, g.phase) <= least + 1e-9


def test_rank_correlation_with_ties(spark):
    r = np.random.default_rng(4)
    d = pd.DataFrame({"a": r.integers(0, 5, 300).astype(float), "b": r.normal(size=300), "s": r.integers(0, 20, 300).astype(float)})
    d.loc[::7, "b"] = None
    d.loc[5::50, "s"] = None
    rows = spark.createDataFrame([tuple(None if v != v else float(v) for v in row) for row in d.itertuples(index=False)], "a double, b double, s double")
    got = {g.parameter: g.spearman for g in x.spearman_sensitivity(rows, ["a", "b"], "s").collect()}
    for c in "ab":
        both = d[[c, "s"]].dropna().rank()
        assert abs(got[c] - abs(both[c].corr(both["s"]))) < 1e-9


def test_runtime_positions(spark):
    r = np.random.default_rng(6)
    values = {"a": r.normal(size=137), None: r.normal(size=40), "c": np.array([2.0])}
    rows = [(k, float(v), bool(i % 3)) for k, vs in values.items() for i, v in enumerate(vs)]
    got = {g.k: g for g in x.runtime_summary(spark.createDataFrame(rows, "k string, v double, ok boolean"), ["k"], "v", "ok").collect()}
    for k, vs in values.items():
        s, n = np.sort(vs), len(vs)
        assert (got[k].lo, got[k].hi, got[k].p50, got[k].p95, got[k].p99) == (s[0], s[-1], s[n // 2], s[int(n * 0.95)], s[int(n * 0.99)])
        assert abs(got[k].std - vs.std()) < 1e-12
