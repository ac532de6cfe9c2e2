"""Calibration and cross validation of all scopes: against min-max isotonic values and separate fits."""

import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from looplake.operators import calibration as CA
from looplake.operators import crossval as CV
from looplake.operators import forests as FO
from test_forests import SCHEMA, rows, small

SCORED = "scope_key string, key string, label string, top_k array<struct<label:string,prob:double>>"


def scored_rows(n, scope, names, seed, step=40):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        cuts = [rng.randrange(1, step) for _ in names]
        shares = [c / sum(cuts) for c in cuts]
        label = rng.choices(names, [s ** 2 for s in shares])[0]
        out.append((scope, f"{scope}:{k}", label, sorted(({"label": c, "prob": s} for c, s in zip(names, shares)), key=lambda x: -x["prob"])))
    return out


def min_max(points):
    """Isotonic value of every point: the largest over starts of the smallest mean over ends."""
    ps = sorted(points)
    mean = lambda a, b: Fraction(sum(points[p][0] for p in ps[a:b + 1]), sum(points[p][1] for p in ps[a:b + 1]))
    return {p: max(min(mean(a, b) for b in range(i, len(ps))) for a in range(i + 1)) for i, p in enumerate(ps)}


@pytest.fixture(scope="module")
def scored(spark):
    data = scored_rows(150, "global:GLOBAL", ["a", "b", "c"], 1, 8) + scored_rows(90, "clinic:x", ["no", "yes"], 2, 6) + scored_rows(10, "clinic:few", ["a", "b"], 3)
    data += [("global:GLOBAL", "lost", "a", None), ("global:GLOBAL", "new", "other", data[0][3]), ("global:GLOBAL", "unknown", None, data[1][3]),
             (None, "scopeless", "a", None)]
    return FO._stored(spark.createDataFrame(data, SCORED))


def test_pools_are_the_isotonic_values_wherever_the_ranges_are_cut(scored):
    points = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for r in scored.collect():
        for x in r.top_k or [] if r.label is not None else []:
            cell = points[r.scope_key, x.label][x.prob]
            cell[0] += r.label == x.label
            cell[1] += 1
    want = {(s, c, p): v for (s, c), cells in points.items() if s != "clinic:few" for p, v in min_max(cells).items()}
    for ranges in (1, 3, 16):
        pools = CA.fit_isotonic(scored, 50, ranges).collect()
        got = {(s, c, p): Fraction(x.s, x.n) for s, c, p in want for x in pools if (x.scope_key, x["class"]) == (s, c) and x.lo <= p <= x.hi}
        assert got == want
        assert sum(x.n for x in pools) == sum(n for (s, _), cells in points.items() if s != "clinic:few" for _, n in cells.values())


def test_calibrated_rows_are_interpolated_and_normalised(scored):
    pools = FO._stored(CA.fit_isotonic(scored, 50))
    held = defaultdict(list)
    for x in pools.collect():
        held[x.scope_key, x["class"]].append((x.lo, x.hi, x.s / x.n))
    for part_rows in (40, 1000):
        got = {r.key: r for r in CA.apply_isotonic(scored, pools, "scope_key", "key", top=9, part_rows=part_rows).collect()}
        assert len(got) == scored.count()
        for r in scored.collect():
            g = got[r.key]
            if r.top_k is None:
                assert g.predicted_label is None and g.confidence is None and not g.calibrated
            elif r.scope_key == "clinic:few":
                assert not g.calibrated and g.top_k == r.top_k
            else:
                value = {}
                for x in r.top_k:
                    at = sorted(held[r.scope_key, x.label])
                    value[x.label] = float(np.interp(x.prob, [e for lo, hi, _ in at for e in (lo, hi)], [v for _, _, v in at for _ in "lh"]))
                if r.scope_key == "clinic:x":
                    value["no"] = 1 - value["yes"]
                total = sum(value.values())
                assert g.calibrated and {x.label: pytest.approx(x.prob) for x in g.top_k} == {
                    c: v / total if total else 1 / len(value) for c, v in value.items()}
                assert g.top_k[0].label == g.predicted_label and g.confidence == max(x.prob for x in g.top_k)


def test_shares_without_any_hit_are_equal():
    pools = {c: [(0.0, 1.0, 0.0)] for c in "abc"}
    assert CA.calibrated_shares(np.array([[0.2, 0.3, 0.5]]), list("abc"), pools).tolist() == [[1 / 3] * 3]


@pytest.fixture(scope="module")
def frame(spark):
    data = rows(240, "global:GLOBAL", 1) + rows(90, "clinic:a:CLINIC_ONLY", 2)
    data += [(s, k, "one" if i else "single", *rest) for i, (s, k, _, *rest) in enumerate(rows(12, "clinic:one:CLINIC_ONLY", 4))]
    data += [("clinic:a:CLINIC_ONLY", None, "flu", 1.0, *[None] * 11), (None, "x", "flu", 1.0, *[None] * 11)]
    return FO._stored(FO.encode_rows(spark.createDataFrame(data, SCHEMA), "scope_key", "key", "label"))


def test_folds_are_stratified_and_drawn_anew_for_every_repeat(frame):
    got = CV.stratified_folds(frame, 3, 7).collect()
    assert {r.scope_key for r in got} == {"global:GLOBAL", "clinic:a:CLINIC_ONLY"}  # a class of one row: not validated
    size, order = defaultdict(int), defaultdict(dict)
    for r in got:
        size[r.scope_key, r.repeat, r.label, r.fold] += 1
        order[r.repeat][r.key] = r.fold
        assert 0 <= r.fold < r.folds
    folds = {r.scope_key: r.folds for r in got}
    for s, rep, label, _ in list(size):
        each = [size[s, rep, label, f] for f in range(folds[s])]
        assert max(each) - min(each) <= 1
    assert len(order) == 3 and order[0] != order[1] and len(order[0]) == 330


def test_shared_fits_equal_separate_ones(frame):
    settings = FO._stored(small(FO.scope_settings(frame.where("scope_key is not null")), trees=30, depth=5))
    shared = {(r.scope_key, r.repeat, r.fold, r.row_key): (r.label, r.predicted_label) for r in CV.fold_predictions(frame, settings, 2, 7).collect()}
    apart = {(r.scope_key, r.repeat, r.fold, r.row_key): (r.label, r.predicted_label)
             for r in CV.fold_predictions(frame, settings, 2, 7, part_rows=50).collect()}
    assert len(shared) == 2 * 330 and shared == apart


def test_votes_of_a_fold_are_those_of_the_forest_without_it(spark, frame):
    mine = frame.where("scope_key = 'clinic:a:CLINIC_ONLY' and key is not null").withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(4)).cast("int"))
    s = {**small(FO.scope_settings(frame.where("scope_key like 'clinic:a%'")), trees=3, depth=6).first().asDict(), "folds": 4}
    held = [{**r.asDict(), "y": s["classes"].index(r.label), "w": FO.UNIT, "key": r.h} for r in mine.withColumn("h", F.xxhash64("key")).collect()]
    got = CV.FoldGrower(held, s).votes(range(3))
    want = np.zeros_like(got)
    for fold in range(4):
        for batch in FO.Grower([r for r in held if r["fold"] != fold], s).grow(range(3)):
            nodes = {x["node"]: x for x in batch.to_pylist()}
            for i, r in enumerate(held):
                if r["fold"] == fold and nodes:
                    at = 1
                    while nodes[at]["feature"] is not None:
                        at = 2 * at + int(FO.Part([r]).right(nodes[at]["feature"], nodes[at]["threshold"])[0])
                    counts = np.array(nodes[at]["counts"])
                    want[i] += np.round(counts / counts.sum() * CV.SHARE).astype(np.int64)
    assert (got == want).all()


def test_summary_has_every_scope(spark, frame):
    settings = FO._stored(small(FO.scope_settings(frame.where("scope_key is not null")), trees=4, depth=4))
    fallback = spark.createDataFrame([("clinic:one:CLINIC_ONLY", 0.75, 0.5)], "scope_key string, training_accuracy double, validation_f1 double")
    got = {r.scope_key: r for r in CV.cv_summary(CV.cross_validate(frame, settings, 2, 7), settings, fallback).collect()}
    one = got.pop("clinic:one:CLINIC_ONLY")
    assert (one.status, one.n_fits, one.cv_mean_accuracy, one.cv_std_accuracy, one.cv_mean_f1_weighted) == ("skipped", 0, 0.75, 0.0, 0.5)
    assert set(got) == {"global:GLOBAL", "clinic:a:CLINIC_ONLY"}
    assert all(r.status == "fitted" and r.n_fits >= 4 and 0.4 < r.cv_mean_accuracy <= 1 and r.cv_std_accuracy >= 0 for r in got.values())


def test_empty_frames(frame, scored):
    none = frame.where("false")
    assert CV.cross_validate(none, FO.scope_settings(none), 2, 7).count() == 0
    empty = scored.where("false")
    assert CA.apply_isotonic(empty, CA.fit_isotonic(empty, 50), "key").count() == 0


def test_votes_of_a_task_are_one_row_a_held_out_row():
    assert CV.VOTES.names == ["scope_key", "repeat", "fold", "row_key", "label", "votes"]
