import collections

import pytest

from tabsmith.operators import frequent


@pytest.mark.parametrize("items", [16, 64, frequent.MOST_ITEMS])
@pytest.mark.parametrize("limit", [1, 5, 300])
def test_top_values_are_exact(spark, items, limit):
    """Skewed, flat, tied and missing values; sketches that are far too small fall back to counting all."""
    values = [v for k in range(1, 60) for v in [f"v{k}"] * (2000 // k // k + 1)] + [f"once{k}" for k in range(500)] + [None] * 400 + ["tie1", "tie2"] * 70
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    counts = collections.Counter(v for v in values if v is not None)
    want = sorted(counts.items(), key=lambda c: (-c[1], c[0].encode()))[:limit]
    assert [tuple(r) for r in frequent.top_values(df, "v", limit, items).collect()] == want


def test_candidates_are_proved(spark, monkeypatch):
    """With a heavy head the second pass is enough: nothing but candidates is grouped."""
    df = spark.createDataFrame([(k if k % 2 else k % 20,) for k in range(40000)], "v bigint")
    seen = []
    real = frequent.missed_at_most
    monkeypatch.setattr(frequent, "missed_at_most", lambda *a: seen.append(real(*a)) or real(*a))
    assert [tuple(r) for r in frequent.top_values(df, "v", 10, 1024).collect()] == [(k, 2000) for k in range(0, 20, 2)]
    assert seen and seen[0] < 2000
    assert frequent.top_values(df.filter("v < 0"), "v", 3).count() == 0
