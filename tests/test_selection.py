"""Selection without sorting whole tables: hash cut-offs and exact quantiles."""

import hashlib
import random
import statistics
from collections import Counter

import pytest

from looplake.operators import monitor as M
from looplake.operators import ordering as O
from looplake.operators import trainset as TS


def _split(rows, ratio, seed):
    """Plain version: (scope, key, label) -> (stratified, is_validation)."""
    out = {}
    for scope in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == scope]
        sizes = Counter(r[2] for r in mine)
        strat = min(sizes.values()) >= 2 and len(sizes) >= 2
        for g in (sizes if strat else [None]):
            members = sorted((hashlib.sha256(f"{seed}:{r[1]}".encode()).hexdigest(), r[1]) for r in mine if not strat or r[2] == g)
            n = round(len(members) * ratio)
            for k, (_, key) in enumerate(members):
                out[scope, key] = (strat, k < n)
    return out


@pytest.mark.parametrize("digits", [0, 1, 4])
def test_random_split_equals_the_ranked_rule(spark, digits, monkeypatch):
    monkeypatch.setattr(TS, "SPLIT_DIGITS", digits)  # 0: all rows share a prefix
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b"]), f"k{k}", rng.choice(["x", "x", "y", None])) for k in range(400)]
    rows += [("one", "k900", "x"), ("c", "k901", "x"), ("c", "k902", "y"), ("c", "k903", "y"), ("c", "k904", "y")]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "scope_key string, row_key string, label string, extra double")
    got = TS.random_split(df, 0.3, 7, by=["scope_key"])
    assert set(got.columns) == {*df.columns, "stratified", "is_validation"}
    assert {(r.scope_key, r.row_key): (r.stratified, r.is_validation) for r in got.collect()} == _split(rows, 0.3, 7)
    got = TS.random_split(df, 0.25, 8).collect()
    assert {("", r.row_key): (r.stratified, r.is_validation) for r in got} == _split([("", *r[1:]) for r in rows], 0.25, 8)
    assert TS.random_split(df.limit(0), 0.25, 8, by=["scope_key"]).collect() == []


def test_random_split_sorts_no_whole_table(spark):
    df = spark.range(100).selectExpr("'a' AS scope_key", "cast(id AS string) AS row_key", "cast(id % 3 AS string) AS label")
    plan = TS.random_split(df, 0.3, 7, by=["scope_key"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    data = {g: [rng.choice([0.1, 0.5, rng.random()]) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 301), ("d", 40))}
    df = spark.createDataFrame([(g, v) for g, x in data.items() for v in x] + [("a", None), ("e", None)], "g string, v double")
    for q in (0.0, 0.25, 0.5, 1.0):
        got = {r.g: r["quantile"] for r in O.quantile(df, "v", q, ["g"]).collect()}
        want = {g: (sorted(x) * 2)[0] if len(x) == 1 else
                sorted(x)[int(q * (len(x) - 1))] * (1 - q * (len(x) - 1) % 1) + sorted(x)[-int(-q * (len(x) - 1) // 1)] * (q * (len(x) - 1) % 1)
                for g, x in data.items()}
        assert got == {g: pytest.approx(v) for g, v in want.items()}
    s = M.confidence_stats(df.withColumnRenamed("v", "confidence")).first()
    assert s.median == pytest.approx(statistics.median(v for x in data.values() for v in x))
    assert M.confidence_stats(df.where("g = 'e'").withColumnRenamed("v", "confidence")).first().median is None
