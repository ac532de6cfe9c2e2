"""Repeated stratified cross validation of the forests of all scopes in one job.

The k fits of a repeat differ by the fold they leave out only, so they share their work: as long as fits
have made the same splits on the way to a node, its rows are counted once, by fold, and the sums of a
fit are the whole sums minus those of its own fold.  Where fits split differently they go on apart.  The
held-out rows walk along and get the votes of the leaf that they end in, so no node table is written.
A fit's trees are those of ``forests.train_forests`` on its rows, with the settings of its scope.

A scope of more than ``forests.WHOLE_ROWS`` rows does not fit one task: its fits are grown as forests of their
own by the level passes of ``forests``, all in one job.  Both ways give the same trees.

Folds: the position of a row in its class, in an order drawn by a hash for every repeat, modulo k; k
follows from the scope's smallest class.  Fits are unweighted.  Defined cases: a scope whose smallest
class has one row is not validated (status ``skipped``, no fits, scores from ``fallback`` if given);
rows with a null scope, key or label take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from looplake.config import DEFAULT, NUMERIC_FEATURES, Config
from looplake.operators import evaluate as E
from looplake.operators import forests as FO
from looplake.operators import trainset as TS

#: Cells of the sums that a task holds at once.
CELLS = 4_000_000
#: A leaf's share of a class in whole numbers, so that sums do not depend on the order of trees.
SHARE = 1 << 32
#: Hex digits of the hash by which rows are counted before they are numbered.
DIGITS = 3
VOTES = pa.schema([("scope_key", pa.string()), ("repeat", pa.int32()), ("fold", pa.int32()), ("row_key", pa.string()),
                   ("label", pa.string()), ("votes", pa.list_(pa.int64()))])


def _folds(rows: DataFrame, repeats: int, seed: int, cfg: Config) -> DataFrame:
    """Stored rows with ``folds`` (of their scope) and ``at``, their fold in every repeat.  Rows are counted by the
    first digits of their hash; a row's position is that of its digits' first row plus the one among these rows, so no
    table is sorted as a whole and only a row's keys are shuffled."""
    rows = FO._stored(rows.where("scope_key is not null and key is not null and label is not null").withColumn("_id", F.monotonically_increasing_id()))
    least = FO._stored(rows.groupBy("scope_key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("scope_key")
                       .agg(TS.adaptive_cv_folds(F.min("c"), cfg).alias("folds")).where("folds >= 2"))
    group = ["scope_key", "repeat", "label", "_digits"]
    drawn = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("repeat").cast("string"), F.col("key").cast("string")), 256)
    each = rows.select("scope_key", "label", "key", "_id").join(least, "scope_key").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))) \
        .withColumn("_drawn", drawn).withColumn("_digits", F.substring("_drawn", 1, DIGITS)).withColumn("_drawn", F.unhex("_drawn"))
    sizes = each.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group[:3]).orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select(*group, before.alias("_first"))
    among = F.row_number().over(Window.partitionBy(*group).orderBy("_drawn", "key", "_id"))
    placed = each.join(first, group).select("_id", "repeat", ((F.col("_first") + among - 1) % F.col("folds")).cast("int").alias("fold"))
    at = placed.groupBy("_id").agg(*(F.max(F.when(F.col("repeat") == r, F.col("fold"))).alias(f"f{r}") for r in range(repeats)))
    return rows.join(at.select("_id", F.array(*(f"f{r}" for r in range(repeats))).alias("at")), "_id").join(least, "scope_key").drop("_id")


def _each_repeat(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.posexplode("at").alias("repeat", "fold")).drop("at")


def stratified_folds(rows: DataFrame, repeats: int, seed: int, cfg: Config = DEFAULT) -> DataFrame:
    """Every row once a repeat, with ``repeat``, ``folds`` (of its scope) and ``fold``."""
    return _each_repeat(_folds(rows, repeats, seed, cfg))


class Group:
    """Rows of some fits at a node, fold by fold: those that the tree has drawn, and the held-out ones of the fits,
    drawn or not.  A lone fit's own fold is not among the drawn."""

    def __init__(self, node: int, fits: list[int], rows: list[np.ndarray], held: list[np.ndarray]):
        self.node, self.fits, self.rows, self.held = node, fits, rows, held


class FoldGrower(FO.Grower):
    """The trees of all fits of a repeat on the rows of one scope."""

    def _sums(self, tree: int, weight: np.ndarray, groups: list[Group]) -> FO.Sums:
        """Sums of every (group, fit): those of the group's rows minus those of the fit's fold."""
        s, names = self.settings, self.names.tolist()
        ends = np.cumsum([0, *(len(g.fits) for g in groups)])
        nodes = np.array([g.node for g in groups], np.int64)
        looked = FO.looks_at([*NUMERIC_FEATURES, *names], nodes, tree, s["random_state"], s["n_features"])
        out = FO.Sums(np.repeat(nodes, np.diff(ends)), names, self.k)
        for i, g in enumerate(groups):
            alone = len(g.fits) == 1
            rows = np.concatenate(g.rows)
            its = FO._at(weight, rows)
            # where a fold of a fit begins and ends; what is left has the sums of all fits
            cuts = np.array([0, len(rows)]) if alone else np.cumsum([0, *(len(x) for x in g.rows)])

            def counted(code, size, at):
                mine = its if at is None else its[at]
                bounds = cuts if at is None else np.searchsorted(at, cuts)
                each = [self.counted(code[a:b], mine[a:b], size) if a < b else (np.zeros(size, np.int64),) * 2 for a, b in zip(bounds[:-1], bounds[1:])]
                w, n = (np.array(x) for x in zip(*each))
                if alone:
                    return w, n
                return w.sum(0) - w[g.fits], n.sum(0) - n[g.fits]

            of = slice(ends[i], ends[i + 1])
            for kind, j, w, n in self.tables(looked[i], rows, its, counted):
                getattr(out, kind)[of if j is None else (of, j)] = w
                getattr(out, f"{kind}_n")[of if j is None else (of, j)] = n.sum(-1) if j is None else n
        return out

    def votes(self, trees) -> np.ndarray:
        """The leaf shares that every row gets from the trees of the fit that leaves it out."""
        folds = range(self.settings["folds"])
        out = np.zeros((self.n, self.k), np.int64)
        per_slot = (len(NUMERIC_FEATURES) * FO.BINS + len(self.names) + 1) * (self.k + 1)
        wide = max(1, CELLS // (per_slot * (len(folds) + 1)))
        of_fold = [np.flatnonzero(self.fold == f) for f in folds]
        leaf_of = np.zeros(self.n, np.int32)
        for tree in trees:
            times = FO.multiplicity(self.key, tree, self.settings["random_state"], self.settings["bootstrap"])
            weight = self.weights(times)
            shares = [np.zeros(self.k, np.int64)]
            leaf_of[:] = 0

            def leaf(held, counts):
                if counts.sum():
                    leaf_of[held] = len(shares)
                    shares.append(np.round(counts / counts.sum() * SHARE).astype(np.int64))

            drawn = [x[times[x] > 0] for x in of_fold]
            level = [Group(1, list(folds), drawn, of_fold)]
            while level:
                following = []
                for k in range(0, len(level), wide):
                    groups = level[k:k + wide]
                    found = iter(self._sums(tree, weight, groups).splits(self.settings))
                    for g in groups:
                        by_split: dict[tuple, list] = {}
                        for fit, held in zip(g.fits, g.held, strict=True):
                            _, feature, threshold, counts, _, _ = next(found)
                            if feature is None:
                                leaf(held, counts)
                            else:
                                by_split.setdefault((feature, threshold), []).append((fit, held, next(found), next(found)))
                        for (feature, threshold), its in by_split.items():
                            following += self._below(g, feature, threshold, its, leaf)
                level = following
            shares = np.array(shares)
            for k in range(0, self.n, FO.BLOCK):
                out[k:k + FO.BLOCK] += shares.take(leaf_of[k:k + FO.BLOCK], axis=0)
        return out

    def _below(self, g: Group, feature: str, threshold: float | None, its: list[tuple], leaf) -> list[Group]:
        """The groups of the two children for the fits that have made a split."""
        goes_on = [[x for x in its if x[side][5]] for side in (2, 3)]
        held = [self.right(feature, threshold, x[1]) for x in its]
        halves = []
        for side, right in ((2, False), (3, True)):
            mine = []
            for x, r in zip(its, held, strict=True):
                rows = x[1].compress(r if right else ~r)
                if x[side][5]:
                    mine.append(rows)
                else:
                    leaf(rows, x[side][3])
            halves.append(mine)
        if not any(goes_on):
            return []
        rows, out = g.rows, []
        if len(g.fits) > 1 and len(its) == 1:
            rows = [x for f, x in enumerate(g.rows) if f != its[0][0]]
        right = [self.right(feature, threshold, x) for x in rows]
        for side, mine, going in ((0, halves[0], goes_on[0]), (1, halves[1], goes_on[1])):
            if going:
                here = [x.compress(r if side else ~r) for x, r in zip(rows, right, strict=True)]
                if len(going) == 1 and len(its) > 1:
                    here = [x for f, x in enumerate(here) if f != going[0][0]]
                out.append(Group(2 * g.node + side, [x[0] for x in going], here, mine))
        return out


def fold_predictions(train: DataFrame, settings: DataFrame, repeats: int, seed: int, cfg: Config = DEFAULT,
                     part_rows: int | None = None) -> DataFrame:
    """``scope_key, repeat, fold, row_key, label, predicted_label`` of every row as held-out row of every
    repeat, from rows ``scope_key, key, label, numbers, items`` and the settings of their scopes."""
    return _predictions(train, settings, repeats, seed, cfg, part_rows, True)


def _predictions(train: DataFrame, settings: DataFrame, repeats: int, seed: int, cfg: Config, part_rows: int | None, rowwise: bool) -> DataFrame:
    """``fold_predictions``, or without ``row_key`` but with ``n``, the rows that agree in the other columns."""
    settings = FO._stored(settings)
    rows = FO._stored(_folds(train.select("scope_key", "key", "label", "numbers", "items"), repeats, seed, cfg))
    of = rows.select("scope_key", "folds").distinct().join(settings, "scope_key").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    large = F.col("rows") > (part_rows or FO.WHOLE_ROWS)
    apart = _apart(rows, of.where(large), part_rows)
    if rowwise:
        return _shared(rows, of.where(~large), True).unionByName(apart)
    row = ["scope_key", "repeat", "fold", "label", "predicted_label"]
    apart = apart.groupBy(*row).agg(F.count(F.lit(1)).alias("n"))
    return _shared(rows, of.where(~large), False).unionByName(apart).groupBy(*row).agg(F.sum("n").alias("n"))


def _merged(rows: pa.RecordBatch, votes: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows of one key, label and fold count as one row with all their votes."""
    key, label = (rows[c].dictionary_encode().indices.to_numpy().astype(np.int64) for c in ("row_key", "label"))
    fold = rows["fold"].to_numpy()
    _, first, of = np.unique((key * (label.max() + 1) + label) * (int(fold.max()) + 1) + fold, return_index=True, return_inverse=True)
    if len(first) == len(votes):
        return rows, votes
    added = np.zeros((len(first), votes.shape[1]), votes.dtype)
    np.add.at(added, of, votes)
    return rows.take(pa.array(first)), added


def _shared(rows: DataFrame, of: DataFrame, rowwise: bool) -> DataFrame:
    """Scopes of one part: tasks take a bunch of trees of all fits of a repeat and give every row's votes by class, which
    are added up piece by piece."""
    name = F.concat_ws("#", F.col("bunch").cast("string"), F.col("repeat").cast("string"), F.col("scope_key"))
    bunches = FO._bunches(of, 2).withColumn("of", F.col("scope_key"))
    classes = F.broadcast(of.select("scope_key", "classes").distinct())
    pieces = FO._stored(FO.packed(rows.join(classes, "scope_key").select(
        "scope_key", F.xxhash64("key").alias("key"), F.col("key").cast("string").alias("row_key"), "label", "at", "numbers", "items",
        (F.array_position("classes", F.col("label")) - 1).cast("int").alias("y"), F.lit(FO.UNIT).cast("long").alias("w")), together=True))
    tasks = pieces.join(bunches.select("scope_key", "bunch", "repeat"), "scope_key").select(name.alias("scope_key"), "key", "data")

    def run(model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple] = []

        def its_rows():
            for key, b in FO.unpacked(batches):
                fold = pa.array(b["at"].flatten().to_numpy().reshape(b.num_rows, -1)[:, model["repeat"]].astype(np.int32))
                known.append((key, fold, b["row_key"], b["label"].dictionary_encode()))
                yield b.drop_columns(["at"]).append_column("fold", fold)

        votes, first = FoldGrower(its_rows(), model).votes(FO._of_bunch(model)), 0
        for key, fold, row_key, label in known:
            n, mine = len(fold), votes[first:first + len(fold)]
            first += n
            held = pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(model["of"], pa.string()), n), pa.repeat(pa.scalar(model["repeat"], pa.int32()), n), fold, row_key, label.cast(pa.string()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, mine.size + 1, mine.shape[1], dtype=np.int32)), pa.array(mine.reshape(-1)))],
                schema=VOTES)
            yield pa.RecordBatch.from_arrays([pa.array([f"{model['repeat']}#{model['of']}"]), pa.array([key]), pa.array([FO._bytes(held)], pa.binary())],
                                             names=["scope_key", "key", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((scope, key, rows) for b in batches for scope, (key, rows) in zip(b["scope_key"].to_pylist(), FO.unpacked([b]), strict=True))
        for _, same in groupby(each, key=lambda x: x[:2]):
            total, one = None, None
            for _, _, b in same:
                votes = b["votes"].flatten().to_numpy().reshape(b.num_rows, -1)
                total, one = (votes.copy(), b) if total is None else (total + votes, one)
            one, total = _merged(one, total)
            # most votes, of equal ones the higher class
            best = pa.array((total.shape[1] - 1 - np.argmax(total[:, ::-1], axis=1)).astype(np.int32))
            found = pa.Table.from_batches([one.drop_columns(["votes"]).append_column("best", best)])
            if rowwise:
                yield from found.to_batches()
            else:
                found = found.drop_columns(["row_key"])
                found = found.group_by(found.column_names).aggregate([([], "count_all")])
                yield from found.rename_columns([*found.column_names[:-1], "n"]).combine_chunks().to_batches()

    row = ["scope_key", "repeat", "fold", *(["row_key"] if rowwise else []), "label"]
    kinds = {"repeat": "int", "fold": "int"}
    votes = FO._scoped(FO._with_models(tasks, bunches.withColumn("scope_key", name), 1 << 30), run, "scope_key string, key string, data binary")
    held = votes.repartition(FO._task_partitions(rows.sparkSession), "scope_key", "key").sortWithinPartitions("scope_key", "key") \
        .mapInArrow(added, ", ".join([*(f"{c} {kinds.get(c, 'string')}" for c in row), "best int", *([] if rowwise else ["n long"])]))
    return held.join(classes, "scope_key").select(*row, F.get("classes", "best").alias("predicted_label"), *([] if rowwise else ["n"]))


def _apart(rows: DataFrame, of: DataFrame, part_rows: int | None) -> DataFrame:
    """Scopes of several parts: every fit is a forest of its own, all grown by the same passes."""
    def name(fit):
        return F.concat_ws("#", F.col("repeat").cast("string"), fit.cast("string"), F.col("scope_key")).alias("scope_key")

    fits = of.withColumn("fit", F.explode(F.sequence(F.lit(0), F.col("folds") - 1)))
    mine = _each_repeat(rows.join(of.select("scope_key"), "scope_key", "left_semi"))
    train = mine.withColumn("fit", F.explode(F.sequence(F.lit(0), F.col("folds") - 1))).where("fit != fold")
    settings = FO._stored(fits.select(name(F.col("fit")), *(c for c in of.columns if c not in ("scope_key", "repeat", "folds"))))
    nodes = FO._stored(FO.train_forests(train.select(name(F.col("fit")), "key", "label", F.lit(1.0).alias("weight"), "numbers", "items"), settings, part_rows))
    held = mine.select(name(F.col("fold")), "key", "numbers", "items", F.col("scope_key").alias("of"), "repeat", "fold",
                       F.col("key").cast("string").alias("row_key"), "label")
    return FO.score(held, nodes, settings, "of", "repeat", "fold", "row_key", "label", part_rows=part_rows or FO.PART_ROWS) \
        .select(F.col("of").alias("scope_key"), "repeat", "fold", "row_key", "label", "predicted_label")


def cross_validate(train: DataFrame, settings: DataFrame, repeats: int, seed: int, cfg: Config = DEFAULT,
                   part_rows: int | None = None) -> DataFrame:
    """``scope_key, repeat, fold, accuracy, f1_weighted`` of every fit."""
    held = FO._stored(_predictions(train, settings, repeats, seed, cfg, part_rows, False))
    return E.classification_metrics(held, "label", "predicted_label", by=["scope_key", "repeat", "fold"], count_col="n") \
        .select("scope_key", "repeat", "fold", "accuracy", "f1_weighted")


def cv_summary(scores: DataFrame, settings: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Per scope the means and population stds over its fits; scopes without fits are ``skipped`` and take
    ``training_accuracy`` and ``validation_f1`` from ``fallback`` with std 0."""
    fits = scores.groupBy("scope_key").agg(
        F.avg("accuracy").alias("acc"), F.stddev_pop("accuracy").alias("acc_std"), F.avg("f1_weighted").alias("f1"),
        F.stddev_pop("f1_weighted").alias("f1_std"), F.count(F.lit(1)).alias("n"))
    both = settings.select("scope_key").join(fits, "scope_key", "left")
    both = both.join(fallback.select("scope_key", "training_accuracy", "validation_f1"), "scope_key", "left") if fallback is not None else \
        both.withColumn("training_accuracy", F.lit(None).cast("double")).withColumn("validation_f1", F.lit(None).cast("double"))
    return both.select("scope_key", F.coalesce("acc", "training_accuracy").alias("cv_mean_accuracy"), F.coalesce("acc_std", F.lit(0.0)).alias("cv_std_accuracy"),
                       F.coalesce("f1", "validation_f1").alias("cv_mean_f1_weighted"), F.coalesce("f1_std", F.lit(0.0)).alias("cv_std_f1_weighted"),
                       F.coalesce("n", F.lit(0)).alias("n_fits"), F.when(F.col("n").isNotNull(), "fitted").otherwise("skipped").alias("status"))
