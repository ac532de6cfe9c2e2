"""Forests as node tables: growth against plain Python, parts, scopes, warm start, saved scoring."""

import random
from hashlib import blake2b

import numpy as np
import pytest
from pyspark.sql import functions as F

from looplake.config import NUMERIC_FEATURES
from looplake.operators import forests as FO

SCHEMA = ("scope_key string, key string, label string, weight double, age_months double, weight_kg double, temperature double, "
          "heart_rate double, symptom_duration double, animal_type string, gender string, current_season string, "
          "vaccination_status string, medical_history string, symptoms_list string")


def rows(n, scope, seed):
    """A label that depends on two numbers and a symptom, with noise."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        age, heart = rng.choice([None, *range(1, 40)]), rng.randrange(60, 180)
        symptoms = ",".join(rng.sample(["Fever", "cough", "vomiting", "itching"], rng.randrange(3)))
        label = "flu" if "Fever" in symptoms else "heart" if heart > 140 else "old" if (age or 0) > 30 else "well"
        if rng.random() < 0.05:
            label = rng.choice(["flu", "heart", "old", "well"])
        out.append((scope, f"{scope}:{k}", label, rng.choice([0.5, 1.0, 1.4]), age and float(age), float(rng.randrange(5, 50)),
                    38.0 + rng.randrange(5) / 2, float(heart), float(rng.randrange(30)), rng.choice(["dog", "cat", None]),
                    rng.choice(["Male", "Female"]), rng.choice(["Spring", "Fall"]), "Overdue", None, symptoms))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    data = rows(400, "global:GLOBAL", 1) + rows(150, "clinic:a:CLINIC_ONLY", 2) + rows(60, "clinic:b:CLINIC_ONLY", 3)
    data += [(s, k, "one", *rest) for s, k, _, *rest in rows(20, "clinic:one:CLINIC_ONLY", 4)]
    data += [("clinic:one:CLINIC_ONLY", None, "one", 1.0, *[None] * 11), (None, "x", "flu", 1.0, *[None] * 11)]
    return FO._stored(FO.encode_rows(spark.createDataFrame(data, SCHEMA), "scope_key", "key", "label", "weight"))


def small(settings, trees=6, depth=6):
    return settings.withColumn("n_estimators", F.lit(trees)).withColumn("max_depth", F.lit(depth))


def table(nodes):
    return sorted((r.scope_key, r.tree, r.node, r.feature or "", -1.0 if r.threshold is None else r.threshold, tuple(r.counts), r.n)
                  for r in nodes.collect())


def plain_forest(data, s, hashes):
    """The same trees by recursion over Python lists."""
    classes, out = s["classes"], []
    names = {f for r in data for f in r["items"]}

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    def looks(feature, node, tree):
        name = int.from_bytes(blake2b(feature.encode(), digest_size=8).digest(), "little")
        of_node = mixed((node * 2654435761 + s["random_state"] * 8191 + tree) % 2**64)
        return (mixed(name ^ of_node) >> 11) / 2**53 < s["n_features"] ** 0.5 / s["n_features"]

    def goes_right(r, feature, threshold):
        if feature in NUMERIC_FEATURES:
            x = r["numbers"][NUMERIC_FEATURES.index(feature)]
            return x is not None and x > threshold
        return feature in r["items"]

    def grow(held, tree, node):
        counts = [sum(r["w"] * t for r, t in held if r["label"] == c) for c in classes]

        def gini_sum(part):
            w = [sum(r["w"] * t for r, t in part if r["label"] == c) for c in classes]
            return sum(float(x) ** 2 for x in w) / sum(w)

        best = None
        if node.bit_length() - 1 < s["max_depth"] and len(held) >= s["min_samples_split"] and sum(c > 0 for c in counts) > 1:
            options = [(f, e) for k, f in enumerate(NUMERIC_FEATURES) for e in s["edges"][k]] + [(f, None) for f in names]
            for f, e in sorted(options, key=lambda o: (o[0], o[1] or 0)):
                if not looks(f, node, tree):
                    continue
                sides = [[x for x in held if goes_right(x[0], f, e) == side] for side in (False, True)]
                if min(map(len, sides)) >= max(1, s["min_samples_leaf"]):
                    gain = gini_sum(sides[0]) + gini_sum(sides[1])
                    if best is None or gain > best[0]:
                        best = gain, f, e, sides
            if best and best[0] <= gini_sum(held) * (1 + 1e-12):
                best = None
        out.append((s["scope_key"], tree, node, best[1] if best else "", -1.0 if not best or best[2] is None else best[2], tuple(counts), len(held)))
        if best:
            grow(best[3][0], tree, 2 * node)
            grow(best[3][1], tree, 2 * node + 1)

    for tree in range(s["n_estimators"]):
        times = FO.multiplicity(np.array(hashes, np.int64), tree, s["random_state"], s["bootstrap"]).tolist()
        held = [(r, t) for r, t in zip(data, times) if t]
        if held:
            grow(held, tree, 1)
    return out


def test_trees_equal_plain_python_in_one_part_and_in_several(spark, frame):
    settings = FO._stored(small(FO.scope_settings(frame.where("scope_key is not null")), trees=3, depth=5))
    whole = table(FO.train_forests(frame, settings))
    assert table(FO.train_forests(frame, settings, part_rows=70)) == whole  # three scopes have several parts
    want = []
    for s in settings.collect():
        got = frame.where((F.col("scope_key") == s.scope_key) & F.col("key").isNotNull()).withColumn("h", F.xxhash64("key")).collect()
        data = [{"numbers": r.numbers, "items": r["items"], "label": r.label, "w": round(r.weight * FO.UNIT)} for r in got]
        want += plain_forest(data, s.asDict(), [r.h for r in got])
    assert whole == sorted(want)


def test_every_scope_beats_its_majority_and_pure_scopes_are_leaves(spark, frame):
    settings = FO._stored(small(FO.scope_settings(frame), trees=30, depth=8))
    nodes = FO._stored(FO.train_forests(frame, settings))
    fresh = [("scope_key", r) for scope, seed in (("global:GLOBAL", 11), ("clinic:a:CLINIC_ONLY", 12)) for r in rows(200, scope, seed)]
    test = FO.encode_rows(spark.createDataFrame([r for _, r in fresh], SCHEMA), "scope_key", "key", "label")
    got = FO.score(test, nodes, settings, "scope_key", "label").collect()
    for scope in ("global:GLOBAL", "clinic:a:CLINIC_ONLY"):
        mine = [r for r in got if r.scope_key == scope]
        majority = max(sum(r.label == x for r in mine) for x in ("flu", "heart", "old", "well"))
        assert sum(r.label == r.predicted_label for r in mine) > majority + 0.2 * len(mine)
        assert all(len(r.top_k) == 3 and r.top_k[0].prob == r.confidence >= r.top_k[1].prob >= r.top_k[2].prob for r in mine)
    one = nodes.where("scope_key = 'clinic:one:CLINIC_ONLY'").collect()
    assert one and all(r.node == 1 and r.feature is None for r in one)
    checks = nodes.join(settings, "scope_key").where("feature is null")
    assert checks.where("n < min_samples_leaf and node > 1").count() == 0
    assert checks.where("floor(log2(node)) > max_depth").count() == 0


def test_scores_are_the_mean_of_leaf_shares(spark, frame):
    settings = FO._stored(small(FO.scope_settings(frame.where("scope_key like 'clinic:a%'")), trees=4, depth=4))
    nodes = FO._stored(FO.train_forests(frame.where("scope_key like 'clinic:a%'"), settings))
    classes = settings.first().classes
    test = frame.where("scope_key like 'clinic:a%'")
    by = {}
    for r in nodes.collect():
        by.setdefault(r.tree, {})[r.node] = r
    for part_rows in (50, 1000):
        got = {r.key: r for r in FO.score(test, nodes, settings, "key", top=4, part_rows=part_rows).collect()}
        for r in test.collect():
            total = dict.fromkeys(classes, 0.0)
            for tree in by.values():
                node = 1
                while (x := tree[node]).feature is not None:
                    value = r.numbers[NUMERIC_FEATURES.index(x.feature)] if x.feature in NUMERIC_FEATURES else None
                    right = value is not None and value > x.threshold if x.feature in NUMERIC_FEATURES else x.feature in r["items"]
                    node = 2 * node + right
                for c, w in zip(classes, x.counts):
                    total[c] += w / sum(x.counts) / len(by)
            assert {t.label: pytest.approx(t.prob) for t in got[r.key].top_k} == total


def test_warm_start_appends_trees_or_trains_anew(spark, frame):
    settings = FO._stored(small(FO.scope_settings(frame.where("scope_key is not null")), trees=4, depth=4))
    base = FO._stored(FO.train_forests(frame, settings))
    old = settings.select("scope_key", F.when(F.col("scope_key").like("clinic:b%"), F.array(F.lit("flu"))).otherwise(F.col("classes")).alias("classes")) \
        .where("scope_key not like 'clinic:one%'")
    kept_base = base.where("scope_key not like 'clinic:one%'")
    nodes, classes = FO.warm_start(kept_base, old, frame, settings, 3)
    got = nodes.groupBy("scope_key").agg(F.count_distinct("tree").alias("n")).collect()
    assert {r.scope_key: r.n for r in got} == {"global:GLOBAL": 7, "clinic:a:CLINIC_ONLY": 7, "clinic:b:CLINIC_ONLY": 4, "clinic:one:CLINIC_ONLY": 4}
    same = nodes.where("tree < 4 and scope_key in ('global:GLOBAL', 'clinic:a:CLINIC_ONLY')")
    assert table(same) == table(base.where("scope_key in ('global:GLOBAL', 'clinic:a:CLINIC_ONLY')"))
    assert {r.scope_key: r.classes for r in classes.collect()} == {r.scope_key: r.classes for r in settings.collect()}
    assert table(nodes.where("tree >= 4 and scope_key = 'global:GLOBAL'")) != [(s, t + 4, *x) for s, t, *x in table(base.where("scope_key = 'global:GLOBAL' and tree < 3"))]


def test_saved_forests_score_every_tenant_by_its_own_or_the_global_one(spark, frame):
    settings = FO._stored(small(FO.scope_settings(frame.where("scope_key is not null")), trees=3, depth=4))
    folder = FO.new_folder(spark)
    FO.save_forests(FO.train_forests(frame, settings), settings, folder, "v1")
    nodes, classes = FO.load_forests(spark, folder, "v1")
    log = frame.where("scope_key = 'global:GLOBAL'").select("key", "numbers", "items", F.when(F.pmod(F.xxhash64("key"), F.lit(3)) == 0, "a").when(
        F.pmod(F.xxhash64("key"), F.lit(3)) == 1, "unknown").alias("clinic"))
    routed = FO.own_or_global(log, F.col("clinic"), classes)
    assert {(r.clinic, r.scope_key) for r in routed.collect()} == {
        ("a", "clinic:a:CLINIC_ONLY"), ("unknown", "global:GLOBAL"), (None, "global:GLOBAL")}
    got = FO.score(routed, nodes, classes, "key", "scope_key").collect()
    assert len(got) == log.count() and all(r.predicted_label is not None for r in got)
    lost = FO.score(routed.withColumn("scope_key", F.lit("clinic:none")), nodes, classes, "key").collect()
    assert len(lost) == log.count() and all(r.predicted_label is None and r.top_k is None for r in lost)


def test_an_empty_frame_has_no_forest(spark, frame):
    none = frame.where("false")
    assert FO.train_forests(none, FO.scope_settings(none)).count() == 0


def test_large_scopes_are_grown_whole_in_few_bunches(spark):
    settings = spark.createDataFrame([("small", 20_000, 300), ("large", 600_000, 300)], "scope_key string, rows long, n_estimators int")
    got = {(r.scope_key, r.bunch): list(FO._of_bunch(r.asDict())) for r in FO._bunches(settings).collect()}
    assert [len(got["large", k]) for k in range(3)] == [100] * 3 and len([k for k in got if k[0] == "small"]) == 12
    assert sorted(t for (s, _), trees in got.items() if s == "large" for t in trees) == list(range(300))
    assert FO.WHOLE_ROWS >= 600_000 > FO.PART_ROWS


def test_part_walks_only_the_rows_that_stand_at_a_node():
    held = [{"numbers": [float(k), None, 1.0, 2.0, 3.0], "items": ["a=b"] * (k % 2) + [f"symptom={k}"]} for k in range(40)]
    part = FO.Part(held)
    assert list(part.has) == [part.at["a=b"]]  # the others have lists of rows
    at = part.walk([(1, "age_months", 19.5), (3, "a=b", None), (7, "symptom=31", None), (2, "unknown", None)])
    assert {node: rows.tolist() for node, rows in at.items()} == {
        4: list(range(20)), 6: list(range(20, 40, 2)), 14: [k for k in range(21, 40, 2) if k != 31], 15: [31]}
    assert FO.multiplicity(np.arange(5000), 3, 42, True).tolist() == np.searchsorted(
        FO._POISSON, FO._share(np.arange(5000).view(np.uint64) ^ FO._mixed(np.array([42 * 1_000_003 + 3], np.uint64))[0]), "right").tolist()
