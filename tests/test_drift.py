"""Windows against a reference: rank lookups equal the ECDF formula over all values."""

import random
from datetime import datetime, timedelta

import pytest

from looplake.operators import drift as D


def _plain(ref, cur):
    """sup and integral of |F - G| over the union of both sides' values."""
    xs = sorted({*ref, *cur})
    gap = [abs(sum(r <= x for r in ref) / len(ref) - sum(c <= x for c in cur) / len(cur)) for x in xs]
    return max(gap), sum(g * (b - a) for g, a, b in zip(gap, xs, xs[1:]))


def test_windows_equal_the_plain_formula(spark):
    rng = random.Random(3)
    ref = [(rng.choice([None, round(rng.gauss(38, 2), 1)]), float(rng.randrange(5))) for _ in range(300)]
    cur = []
    for h in range(6):
        for _ in range([1, 2, 40, 40, 90, 7][h]):
            # hours below, above and between the reference, ties with it, and one hour without any weight
            t = round(rng.gauss([10, 60, 38, 39, 38, 38][h], 2 + h % 3), 1)
            cur.append((datetime(2024, 1, 1) + timedelta(hours=h, minutes=rng.randrange(60)), t, None if h == 3 else float(rng.randrange(-2, 7))))
    cols = ("temperature", "weight_kg")
    r = spark.createDataFrame(ref, "temperature double, weight_kg double")
    c = spark.createDataFrame(cur, "ts timestamp, temperature double, weight_kg double")
    got = {(x.window_start.hour, x["column"]): x for x in D.drift_windows(r, c, "ts", cols).collect()}
    assert len(got) == 12
    for h in range(6):
        for k, col in enumerate(cols):
            a = [x[k] for x in ref if x[k] is not None]
            b = [x[k + 1] for x in cur if x[0].hour == h and x[k + 1] is not None]
            g = got[h, col]
            assert (g.n_ref, g.n_cur) == (len(a), len(b))
            if b:
                assert (g.ks_stat, g.wasserstein) == pytest.approx(_plain(a, b), abs=1e-9)
            else:
                assert g.ks_stat is None and g.wasserstein is None and g.drift_detected is None


def test_windows_without_reference(spark):
    c = spark.createDataFrame([(datetime(2024, 1, 1), 1.0)], "ts timestamp, temperature double")
    r = spark.createDataFrame([], "temperature double")
    (x,) = D.drift_windows(r, c, "ts", ("temperature",)).collect()
    assert (x.n_ref, x.n_cur, x.ks_stat, x.wasserstein) == (0, 1, None, None)
    assert D.drift_windows(c, c.limit(0), "ts", ("temperature",)).collect() == []


def test_no_product_of_windows_and_reference_values(spark):
    c = spark.range(50).selectExpr("timestamp_seconds(id * 600) AS ts", "cast(id % 7 AS double) AS temperature")
    plan = D.drift_windows(c, c, "ts", ("temperature",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan
