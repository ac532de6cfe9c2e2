"""What a run of the global model costs, how scored rows find their leaves, and what tasks get beside their rows."""

import glob
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from looplake.config import DEFAULT, NUMERIC_FEATURES
from looplake.operators import crossval as CV
from looplake.operators import forests as FO
from looplake.operators import models as MD
from looplake.operators import ordering
from looplake.plans.registry import load_all
from looplake.sources import ingest as I
from conftest import SF_SMALL


def test_metrics_row_does_not_train_fold_by_fold(spark, monkeypatch):
    def one_by_one(*args, **kwargs):
        raise AssertionError("a forest of its own")

    monkeypatch.setattr(MD, "RandomForestClassifier", one_by_one)
    r = load_all()["training_metrics_row"].build(spark, SF_SMALL).first()
    assert r.n_fits % DEFAULT.cv_repeats == 0 and r.cv_status == ("fitted" if r.n_fits else "skipped")
    if not r.n_fits:
        assert (r.cv_mean_accuracy, r.cv_std_accuracy, r.cv_mean_f1_weighted) == (r.training_accuracy, 0.0, r.validation_f1)
    assert r.n_samples == r.n_train + r.n_validation and r.calibration in ("sigmoid", "skipped")
    assert 0 <= r.brier_before <= 2 and 0 <= r.cv_mean_accuracy <= 1 and r.n_features > len(NUMERIC_FEATURES)


def test_votes_are_those_of_the_walk():
    rng = np.random.default_rng(1)
    names = ["animal_type=dog", "animal_type=cat", *(f"symptom=t{k}" for k in range(20))]
    rows = [{"key": k, "numbers": [None if x == 9 else float(x) for x in rng.integers(0, 10, len(NUMERIC_FEATURES))],
             "items": sorted({names[j] for j in rng.integers(0, len(names), 4)}), "y": int(rng.integers(0, 3)), "w": 1_000_000, "fold": 0}
            for k in range(3000)]
    settings = {"scope_key": "s", "classes": ["a", "b", "c"], "edges": [[1.0, 3.0, 6.0]] * len(NUMERIC_FEATURES), "n_features": 25, "max_depth": 6,
                "min_samples_split": 5, "min_samples_leaf": 2, "bootstrap": True, "random_state": 7}
    trees = [[x for x in b.to_pylist() if x["counts"]] for b in FO.Grower(rows, settings).grow(range(5))]
    part = FO.Part(rows)
    want = np.zeros((part.n, 3))
    for tree in trees:
        of = {x["node"]: np.array(x["counts"], np.float64) for x in tree}
        for node, here in part.walk([(x["node"], x["feature"], x["threshold"]) for x in tree if x["feature"] is not None]).items():
            want[here] += of[node] / of[node].sum()
    for tests, block in ((512, 4096), (1, 7), (30, 1000)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(FO, "TESTS", tests)
            m.setattr(FO, "BLOCK", block)
            got = np.zeros((part.n, 3))
            FO.add_votes(part, trees, got)
        assert (got == want).all()


def test_lists_of_a_model_are_empty_beside_rows(spark):
    models = spark.createDataFrame([("s", ["a", "b"], [[1.0], None], 3)], "scope_key string, classes array<string>, edges array<array<double>>, trees int")
    rows = spark.createDataFrame([("s", k, ["x"]) for k in range(20)] + [("other", 1, [])], "scope_key string, key long, items array<string>")
    got = FO._with_models(rows, models, 1000).where("scope_key = 's'").collect()
    heads = [r for r in got if r.model.scope_key is not None]
    assert len(got) == 21 and [(r.model.classes, r.model.edges, r.model.trees, r.row) for r in heads] == [(["a", "b"], [[1.0], None], 3, None)]
    assert all((r.model.classes, r.model.edges, r.model.trees) == ([], [], None) for r in got if r.row is not None)

    def run(model, batches):
        yield pa.RecordBatch.from_pylist([{"name": "".join(model["classes"]), "n": sum(b.num_rows for b in batches)}])

    assert FO._scoped(FO._with_models(rows, models, 1000), run, "name string, n long").collect() == [("ab", 20)]


def test_export_goes_around_the_writer_that_opens_every_folder(spark, tmp_path, monkeypatch):
    values = ["plain", "a, b ", ' "quoted"', "back\\slash\\", "two\nlines", "", None, "ü"]
    rows = spark.createDataFrame([(f"s:{k % 3}" if k % 7 else None, k // 2, values[k % len(values)], k / 4, k % 2 == 0 if k % 5 else None) for k in range(60)],
                                 "scope_key string, training_id int, text string, x double, ok boolean").repartition(5)
    path, by = str(tmp_path / "export"), ["scope_key", "training_id"]
    seen = []

    def rows_written(df, *args, old=I.write_csv):
        seen.append(df.count())
        return old(df, *args)

    monkeypatch.setattr(I, "write_csv", rows_written)
    for _ in range(2):  # the second time over the first
        assert I.dataset_export(rows, path, by) == path
    assert seen == [0, 0]
    folders = {(r.scope_key, r.training_id) for r in rows.collect()}
    files = glob.glob(f"{path}/scope_key=*/training_id=*/*")
    assert len(files) == len(folders) and all(f.endswith(".csv") for f in files) and (tmp_path / "export" / "_SUCCESS").exists()
    back = I.read_export(spark, path, rows.schema, by)
    assert back.dtypes == [("text", "string"), ("x", "string"), ("ok", "string"), ("scope_key", "string"), ("training_id", "int")]
    want = [(r.text or None, str(r.x), None if r.ok is None else str(r.ok).lower(), r.scope_key, r.training_id) for r in rows.collect()]
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, want))
    # Spark's reader finds the same folders, and the same rows where no value has a line end
    plain = rows.where("text is null or not contains(text, '\n')")
    I.dataset_export(plain, path, by)
    spark_rows = spark.read.option("header", True).csv(path).collect()
    assert sorted(map(repr, map(tuple, spark_rows))) == sorted(map(repr, map(tuple, I.read_export(spark, path, rows.schema, by).collect())))


def test_export_without_rows_and_in_an_unknown_store(spark, tmp_path, monkeypatch):
    rows = spark.range(30).select((F.col("id") % 4).cast("int").alias("training_id"), F.col("id").alias("v"))
    path = I.dataset_export(rows.limit(0), str(tmp_path / "none"))
    assert I.read_export(spark, path, rows.schema, ["training_id"]).collect() == []
    monkeypatch.setattr(I, "_file_store", lambda spark, path: (path, False))
    path = I.dataset_export(rows, str(tmp_path / "other"))
    assert sorted((r.training_id, r.v) for r in I.read_export(spark, path, rows.schema, ["training_id"]).collect()) == sorted(
        (k % 4, str(k)) for k in range(30))


def fold_rows(n, scopes=("s", "t")):
    rng = np.random.default_rng(3)
    names = ["animal_type=dog", "animal_type=cat", *(f"symptom=t{k}" for k in range(12))]
    return [(s, f"k{k}", "abc"[int(rng.integers(0, 3))], [None if x == 9 else float(x) for x in rng.integers(0, 10, len(NUMERIC_FEATURES))],
             sorted({names[j] for j in rng.integers(0, len(names), 3)})) for s in scopes for k in range(n)]


FOLD_DDL = "scope_key string, key string, label string, numbers array<double>, items array<string>"


def test_pieces_hold_every_row_of_a_scope(spark, monkeypatch):
    monkeypatch.setattr(FO, "PIECE_ROWS", 50)
    data = [*fold_rows(120), ("u", "only", "a", [None] * len(NUMERIC_FEATURES), [])]
    pieces = FO.packed(spark.createDataFrame(data, FOLD_DDL).repartition(3)).collect()
    assert len({(r.scope_key, r.key) for r in pieces}) == len(pieces) < 20
    back = [(r.scope_key, x["key"], x["label"], x["numbers"], x["items"]) for r in pieces
            for _, b in FO.unpacked([pa.RecordBatch.from_pylist([{"key": r.key, "data": bytes(r.data)}])]) for x in b.to_pylist()]
    assert sorted(map(repr, back)) == sorted(map(repr, data))


def test_folds_need_no_sorted_table_of_all_rows(spark, monkeypatch):
    def sorted_table(*args, **kwargs):
        raise AssertionError("all rows sorted")

    monkeypatch.setattr(ordering, "with_row_number", sorted_table)
    data = fold_rows(90)
    got = CV.stratified_folds(spark.createDataFrame(data, FOLD_DDL).repartition(5), 2, 7).collect()
    want = {}
    for repeat in range(2):
        for s, label in {(x[0], x[2]) for x in data}:
            order = sorted((hashlib.sha256(f"7:{repeat}:{x[1]}".encode()).hexdigest(), x[1]) for x in data if (x[0], x[2]) == (s, label))
            want |= {(s, key, repeat): place % 5 for place, (_, key) in enumerate(order)}
    assert {(r.scope_key, r.key, r.repeat): r.fold for r in got} == want and len(got) == len(want)


def test_rows_that_repeat_a_key_are_validated_each(spark):
    rows = spark.createDataFrame([x for x in fold_rows(40, ("s",)) for _ in range(2)], FOLD_DDL)
    settings = FO.scope_settings(rows).withColumns({"n_estimators": F.lit(3), "max_depth": F.lit(3)})
    each = CV.fold_predictions(rows, settings, 2, 7)
    assert each.count() == 160
    counts = CV._predictions(rows, settings, 2, 7, DEFAULT, None, False)
    row = ["scope_key", "repeat", "fold", "label", "predicted_label"]
    many = CV.fold_predictions(spark.createDataFrame([x for x in fold_rows(40, ("s",)) for _ in range(7)], FOLD_DDL), settings, 2, 7)
    assert many.count() == many.select("scope_key", "repeat", "fold", "row_key", "label").distinct().count() == 2 * 5 * 40  # as one row of a fold
    assert sorted(counts.select(*row, "n").collect()) == sorted(each.groupBy(*row).count().collect())


def test_a_row_of_a_grower_takes_few_bytes():
    held = [{"key": k, "numbers": x[3], "items": x[4], "y": "abc".index(x[2]), "w": 1_000_000, "fold": k % 5} for k, x in enumerate(fold_rows(2000, ("s",)))]
    settings = {"scope_key": "s", "classes": ["a", "b", "c"], "edges": [[1.0, 3.0, 6.0]] * len(NUMERIC_FEATURES), "n_features": 19, "max_depth": 6,
                "min_samples_split": 5, "min_samples_leaf": 2, "bootstrap": True, "random_state": 7, "folds": 5}
    grower = CV.FoldGrower(held, settings)
    arrays = [x for v in grower.__dict__.values() for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else [v]) if isinstance(x, np.ndarray)]
    assert sum(x.nbytes for x in arrays if x.dtype != object) < 70 * len(held)
    assert FO.WHOLE_ROWS * 150 < 1 << 30


def test_training_rows_of_the_metrics_row_are_only_counted(spark, monkeypatch):
    ranked, bunches = [], []

    def ranks(df, labels, old=MD.with_prediction):
        ranked.append(df.count())
        return old(df, labels)

    def bunch(settings, *args, old=FO._bunches):
        bunches.append(args)
        return old(settings, *args)

    monkeypatch.setattr(MD, "with_prediction", ranks)
    monkeypatch.setattr(FO, "_bunches", bunch)
    r = load_all()["training_metrics_row"].build(spark, SF_SMALL).first()
    assert ranked == [r.n_validation] and 0 <= r.training_accuracy <= 1
    assert bunches and set(bunches) == {(2,)}  # of a large scope 6 tasks to train and 18 to validate 300 trees, not 3 and 9
