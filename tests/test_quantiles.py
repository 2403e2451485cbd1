"""Exact quantiles of many columns in two scans, against numpy."""

import numpy as np
import pytest

from netgeo.operators import stats


@pytest.mark.parametrize("accuracy", [20_000, 50])
def test_quantiles_against_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr(stats, "SKETCH_ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    n = 3001
    data = {"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": np.where(rng.random(n) < 0.97, np.nan, rng.random(n)),
            "d": np.full(n, 7.0), "e": np.full(n, np.nan), "x": np.where(np.arange(n) == 3, 4.5, np.nan), "f": np.exp(rng.normal(size=n) * 5)}
    rows = [tuple(None if np.isnan(v[i]) else float(v[i]) for v in data.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(7)
    for q in (0.5, 0.0, 1.0, 0.25, 0.999):
        got = stats.exact_quantiles(df, list(data), q)
        for c, v in data.items():
            v = v[~np.isnan(v)]
            assert got[c] is None if not len(v) else abs(got[c] - np.quantile(v, q)) <= 1e-9 * max(1, abs(got[c])), (c, q)
    assert stats.exact_quantiles(df.limit(0), ["a", "b"]) == {"a": None, "b": None}


def test_two_scans_whatever_the_columns(spark):
    read = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(float(i), float(i % 7), float(-i), 1.0) for i in range(500)], 2)

    def seen(r):
        read.add(1)
        return r

    df = spark.createDataFrame(rows.map(seen), "a double, b double, c double, d double")
    stats.exact_quantiles(df, ["a", "b", "c", "d"])
    assert read.value == 1000
