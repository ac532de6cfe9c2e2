"""Isotonic calibration of all scopes and classes in one pass, by pooled adjacent violators in parallel.

The points of a (scope, class) are its distinct scores with the number of rows and of hits.  They are
range-partitioned by (scope, class, score); every range pools its own violators, then the pools of all
ranges of a (scope, class) are pooled again in order of score.  Pools are compared in whole numbers, so
the result does not depend on where the ranges are cut.  One task merges the pools of a (scope, class):
pools of rising shares s/n need denominators that grow, so N rows leave at most about 0.9 N^(2/3) pools
(a million for a billion validation rows), and the merge streams and holds no more than these.

Between two pools the calibrated value is interpolated, outside them the nearest pool counts.  The
classes' values are divided by their sum; a row whose values are all 0 gets the same share of every
class; with two classes the second one's value decides both.

Defined cases: scopes with fewer than ``min_rows`` scored rows fit nothing and keep their scores
(``calibrated`` is false); rows without a score (no forest) or label do not take part in a fit; a label
that is no class of the forest is a miss for every class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from looplake.operators import forests as FO

POOL_DDL = "scope_key string, class string, lo double, hi double, s long, n long"
POOL = pa.schema([("scope_key", pa.string()), ("class", pa.string()), ("lo", pa.float64()), ("hi", pa.float64()),
                  ("s", pa.int64()), ("n", pa.int64())])
_OUT_ROWS = 20_000


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool the neighbours of sorted pools whose shares s/n do not rise."""
    key, stack, out = None, [], []

    def rows(found):
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, POOL, strict=True)], schema=POOL)

    for batch in batches:
        for scope, name, lo, hi, s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (scope, name) != key:
                out += [(*key, *x) for x in stack] if key else []
                key, stack = (scope, name), []
                if len(out) >= _OUT_ROWS:
                    yield rows(out)
                    out = []
            while stack and stack[-1][2] * n >= s * stack[-1][3]:
                before = stack.pop()
                lo, s, n = before[0], s + before[2], n + before[3]
            stack.append((lo, hi, s, n))
    out += [(*key, *x) for x in stack] if key else []
    for k in range(0, len(out), _OUT_ROWS):
        yield rows(out[k:k + _OUT_ROWS])


def fit_isotonic(scored: DataFrame, min_rows: int, ranges: int | None = None) -> DataFrame:
    """Pools ``scope_key, class, lo, hi, s, n`` from rows ``scope_key, label, top_k`` (all classes)."""
    known = scored.where("top_k is not null and label is not null")
    enough = known.groupBy("scope_key").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= min_rows).select("scope_key")
    points = known.join(enough, "scope_key", "left_semi").select("scope_key", "label", F.explode("top_k").alias("c")) \
        .groupBy("scope_key", F.col("c.label").alias("class"), F.col("c.prob").alias("lo")) \
        .agg(F.count_if(F.col("label") == F.col("c.label")).alias("s"), F.count(F.lit(1)).alias("n")) \
        .select("scope_key", "class", "lo", F.col("lo").alias("hi"), "s", "n")
    n = ranges or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["scope_key", "class", "lo"]
    parts = points.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_pool, POOL_DDL)
    return parts.repartition("scope_key", "class").sortWithinPartitions(*order).mapInArrow(_pool, POOL_DDL)


def calibrated_shares(shares: np.ndarray, names: list[str], pools: dict[str, list[tuple[float, float, float]]]) -> np.ndarray:
    """Calibrated shares of rows (one column a class) by the pools (lo, hi, value) of every class."""
    out = np.empty_like(shares)
    for j, name in enumerate(names):
        held = sorted(pools[name])
        at = np.array([x for lo, hi, _ in held for x in (lo, hi)])
        out[:, j] = np.interp(shares[:, j], at, np.array([v for _, _, v in held for _ in range(2)]))
    if len(names) == 2:
        out[:, 0] = 1.0 - out[:, 1]
    total = out.sum(1, keepdims=True)
    return np.where(total > 0, out / np.where(total > 0, total, 1.0), 1.0 / len(names))


def apply_isotonic(scored: DataFrame, pools: DataFrame, *keep: str, top: int = 3, part_rows: int = FO.PART_ROWS) -> DataFrame:
    """``keep, predicted_label, confidence, top_k, calibrated`` of rows ``scope_key, key, top_k`` (all classes)."""
    models = pools.groupBy("scope_key").agg(F.collect_list(F.struct("class", "lo", "hi", (F.col("s") / F.col("n")).alias("value"))).alias("pools"))
    known = scored.where("top_k is not null and key is not null").join(models.select("scope_key"), "scope_key", "left_semi").select(
        "scope_key", "key", "top_k", *(c for c in keep if c not in ("scope_key", "key")))
    kinds = {f.name: f for f in scored.schema.fields}
    result = StructType([kinds[c] for c in keep]).add("predicted_label", "string").add("confidence", "double") \
        .add("top_k", kinds["top_k"].dataType).add("calibrated", "boolean")
    schema = to_arrow_schema(result)

    def run(model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        of: dict[str, list] = {}
        for x in model["pools"]:
            of.setdefault(x["class"], []).append((x["lo"], x["hi"], x["value"]))
        names = sorted(of)
        at = {c: j for j, c in enumerate(names)}
        shares = np.zeros((len(rows), len(names)))
        for i, r in enumerate(rows):
            for x in r["top_k"]:
                shares[i, at[x["label"]]] = x["prob"]
        fresh = calibrated_shares(shares, names, of)
        order = np.argsort(fresh, axis=1, kind="stable")[:, ::-1][:, :top]
        for k in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_pylist([
                {**{c: r[c] for c in keep}, "predicted_label": names[o[0]], "confidence": float(p[o[0]]),
                 "top_k": [{"label": names[j], "prob": float(p[j])} for j in o], "calibrated": True}
                for r, p, o in zip(rows[k:k + 5000], fresh[k:k + 5000], order[k:k + 5000], strict=True)], schema=schema)

    done = FO._scoped(FO._with_models(known, models, part_rows), run, result)
    fits = F.col("top_k").isNotNull() & F.col("key").isNotNull() & F.col("_fits").isNotNull()
    marked = scored.join(models.select("scope_key", F.lit(True).alias("_fits")), "scope_key", "left")
    rest = marked.where(~fits).select(*keep, F.col("top_k")[0]["label"].alias("predicted_label"), F.col("top_k")[0]["prob"].alias("confidence"),
                                      F.slice("top_k", 1, top).alias("top_k"), F.lit(False).alias("calibrated"))
    return done.unionByName(rest)
