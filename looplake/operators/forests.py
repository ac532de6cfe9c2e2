"""Forests for many scopes at once: level-wise histogram trees kept as node tables.

A forest is rows ``scope_key, tree, node, feature, threshold, counts, n``: node 1 is the root, the
children of i are 2i and 2i + 1; a split has a feature and sends a row to the right if the number is
above the threshold, or if the row has the item ("animal_type=dog", "symptom=cough"); a leaf has no
feature, and ``counts`` are the class weights that vote.

A scope of up to ``WHOLE_ROWS`` rows is grown whole: tasks take all levels of a bunch of its trees, with
a row's node kept from level to level.  The trees of larger scopes grow by one pass over the rows a level:
tasks hold a part of a scope's rows and sum class weights by (scope, tree, node, feature, bin, class), one
aggregation adds the parts up, and every tree picks its splits from its own sums.  The sums of a pass do
not grow with the rows.  Both ways use the same sums and splits and give the same trees.
Weights count in millionths, so sums and with them the trees do not depend on the order of rows.

Rows reach a tree with a multiplicity drawn from their key (Poisson, in place of drawing with
replacement), a node looks at a feature with a probability of sqrt(F) / F, and numbers are cut at 31
quantiles of the scope.  Nodes split while they are impure, above the depth, have at least
``min_samples_split`` rows and a split with ``min_samples_leaf`` rows on both sides.

Defined cases: a null number goes to the left, a null category has no item; a scope of one class has
single leaves; rows with null label, scope or key take no part; scopes without rows have no forest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import chain, count, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from looplake.config import CATEGORICAL_FEATURES, DEFAULT, NUMERIC_FEATURES, Config
from looplake.functions import scalars as S
from looplake.operators import trainset as TS
from looplake.session import ensure_checkpoint_dir

UNIT = 1_000_000
BINS = 32
#: Rows that a task holds of a scope in parts, and of one that is grown whole (about 130 bytes a row).
PART_ROWS = 50_000
WHOLE_ROWS = 5_000_000
#: Trees that a task grows of a scope of up to PART_ROWS rows; of larger ones four times as many, so that
#: their rows go to fewer tasks, or twice as many where the rows go in pieces.
TREE_BUNCH = 25
#: Rows of a piece.
PIECE_ROWS = 10_000
#: Tests that are held for all rows of a part, and rows that step through the trees at a time.
TESTS = 512
BLOCK = 4096
#: Bits of a sum of weights and rows that count rows.
PACKED = 24
#: Keys that are hashed at a time.
DRAWN = 1 << 14
_POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])
#: The same limits for the 53 bits of a hash.
_POISSON_BITS = np.ceil(_POISSON * 2.0**53).astype(np.uint64)
ROW = pa.schema([("key", pa.int64()), ("numbers", pa.list_(pa.float64())), ("items", pa.list_(pa.string())), ("y", pa.int32()),
                 ("w", pa.int64()), ("fold", pa.int32())])
NODE_DDL = "scope_key string, tree int, node long, feature string, threshold double, counts array<long>, n long, open boolean"
NODE = pa.schema([("scope_key", pa.string()), ("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.string()),
                  ("threshold", pa.float64()), ("counts", pa.list_(pa.int64())), ("n", pa.int64()), ("open", pa.bool_())])


def _stored(df: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/forest-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _share(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers from 0 to 1."""
    return (_mixed(x) >> np.uint64(11)).astype(np.float64) / 2.0**53


def multiplicity(keys: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """How often a tree has each row."""
    if not bootstrap:
        return np.ones(len(keys), np.int8)
    salt = _mixed(np.array([seed * 1_000_003 + tree], np.uint64))[0]
    out = np.zeros(len(keys), np.int8)
    for k in range(0, len(keys), DRAWN):
        drawn, here = _mixed(keys[k:k + DRAWN].view(np.uint64) ^ salt) >> np.uint64(11), out[k:k + DRAWN]
        for limit in _POISSON_BITS:
            here += drawn >= limit
    return out


def looks_at(names: list[str], nodes: np.ndarray, tree: int, seed: int, n_features: int) -> np.ndarray:
    """Which features (columns) a node (rows) looks at."""
    of_name = np.array([int.from_bytes(blake2b(f.encode(), digest_size=8).digest(), "little") for f in names], np.uint64)
    of_node = _mixed(nodes.astype(np.uint64) * np.uint64(2654435761) + np.uint64(seed * 8191 + tree))
    return _share(of_name[None, :] ^ of_node[:, None]) < np.sqrt(n_features) / n_features


# ------------------------------------------------------------------ rows and encoders
def encode_rows(frame: DataFrame, *keep: str, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES,
                symptoms: str = "symptoms_list") -> DataFrame:
    """``keep``, ``numbers``, ``items`` of every row."""
    items = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in categorical]
    tokens = F.transform(F.array_distinct(S.parse_symptoms(symptoms)), lambda t: F.concat(F.lit("symptom="), t))
    return frame.select(*keep, F.array(*(F.col(c).cast("double") for c in numeric)).alias("numbers"),
                        F.array_compact(F.concat(F.array(*items), F.coalesce(tokens, F.array().cast("array<string>")))).alias("items"))


def scope_settings(train: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row a scope: classes in order, quantiles of every number, features, tiered parameters."""
    n_numbers = len(NUMERIC_FEATURES)
    cuts = [k / BINS for k in range(1, BINS)]
    edges = [F.array_distinct(F.coalesce(F.percentile_approx(F.get("numbers", k), cuts, 10_000), F.array().cast("array<double>")))
             for k in range(n_numbers)]
    base = train.groupBy("scope_key").agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("label")).alias("classes"),
                                          F.array(*edges).alias("edges"))
    items = train.select("scope_key", F.explode("items").alias("item")).groupBy("scope_key").agg(F.count_distinct("item").alias("n_items"))
    full = base.join(items, "scope_key", "left").withColumn("n_features", F.lit(n_numbers) + F.coalesce("n_items", F.lit(0)))
    return full.select("scope_key", "rows", "classes", "edges", "n_features",
                       *TS.adaptive_forest_params(F.col("rows"), F.col("n_features"), cfg)).drop("n_items")


# ------------------------------------------------------------------ walking and growing
class Part:
    """Some rows of one scope as arrays, from Arrow batches (or a list of dicts)."""

    def __init__(self, rows: Iterable):
        batches = [pa.RecordBatch.from_pylist(rows, schema=ROW)] if isinstance(rows, list) and isinstance(rows[0], dict) else rows
        numbers, found, ids, many = [], {}, [], []
        for b in batches:
            self.take(b)
            numbers.append(self.held(b["numbers"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(NUMERIC_FEATURES)).T))
            many.append(b["items"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int32))
            coded = b["items"].flatten()
            coded = coded if pa.types.is_dictionary(coded.type) else coded.dictionary_encode()
            known = np.array([found.setdefault(i, len(found)) for i in coded.dictionary.to_pylist()], np.int32)
            ids.append(known[coded.indices.to_numpy(zero_copy_only=False)])
        self.numbers = np.concatenate(numbers, 1)
        del numbers
        self.n = self.numbers.shape[1]
        self.names = np.array(sorted(found), dtype=object)
        self.at = {name: k for k, name in enumerate(self.names)}
        place = np.array([self.at[name] for name in found], np.min_scalar_type(len(found)))
        item = np.concatenate([place[x] for x in ids])
        del ids
        row = np.repeat(np.arange(self.n, dtype=np.int32), np.concatenate(many))
        # items that an eighth of the rows have, at most some 50, have a column; the others their rows
        self.has: dict[int, np.ndarray] = {}
        rare = np.ones(len(self.names) + 1, bool)
        for k in np.flatnonzero(np.bincount(item, minlength=len(self.names)) * 8 >= self.n).tolist() if found else []:
            self.has[k] = np.zeros(self.n, bool)
            self.has[k][row[item == k]] = True
            rare[k] = False
        few = rare[item]
        self.few_item, self.few_row = item[few], row[few]
        by = np.argsort(self.few_item, kind="stable")
        self._rows, self._ends = self.few_row[by], np.searchsorted(self.few_item[by], np.arange(len(self.names) + 1))
        self._scratch = np.zeros(self.n, bool)

    def held(self, numbers: np.ndarray) -> np.ndarray:
        """What is kept of numbers, one line a feature."""
        return np.ascontiguousarray(numbers)

    def take(self, batch: pa.RecordBatch) -> None:
        """Further columns of the rows."""

    def _mark(self, column: np.ndarray, item: int, value: bool) -> np.ndarray:
        column[self._rows[self._ends[item]:self._ends[item + 1]]] = value
        return column

    def right(self, feature: str, threshold: float | None, rows: np.ndarray | None = None) -> np.ndarray:
        """Which rows a split sends to the right."""
        of = slice(None) if rows is None else rows
        if feature in NUMERIC_FEATURES:
            return self.numbers[NUMERIC_FEATURES.index(feature)][of] > threshold  # false for a missing number
        k = self.at.get(feature)
        if k is None:
            return np.zeros(self.n if rows is None else len(rows), bool)
        if k in self.has:
            return self.has[k][of].copy()
        out = self._mark(self._scratch, k, True)[of].copy()
        self._mark(self._scratch, k, False)
        return out

    def walk(self, splits: list[tuple], rows: np.ndarray | None = None) -> dict[int, np.ndarray]:
        """The rows at every node that has some, by the splits (node, feature, threshold) of a tree."""
        at = {1: np.arange(self.n) if rows is None else rows}
        for node, feature, threshold in sorted(splits, key=lambda x: x[0]):
            here = at.pop(node, None)
            if here is not None:
                right = self.right(feature, threshold, here)
                at[2 * node], at[2 * node + 1] = here.compress(~right), here.compress(right)
        return {node: here for node, here in at.items() if len(here)}


def _at(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return values.take(rows, mode="clip")  # the rows are known to be there: several times as fast as values[rows]


HISTOGRAM = pa.schema([("scope_key", pa.string()), ("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.string()),
                       ("bin", pa.int32()), ("y", pa.int32()), ("w", pa.int64()), ("n", pa.int64())])


class Sums:
    """Class weights and rows of some open nodes of a tree, by feature, bin and class."""

    def __init__(self, nodes: np.ndarray, names: list[str], n_classes: int):
        shape = len(nodes), n_classes
        self.nodes, self.names = nodes, names
        self.total, self.total_n = np.zeros(shape, np.int64), np.zeros(len(nodes), np.int64)
        self.number = np.zeros((len(nodes), len(NUMERIC_FEATURES), BINS, n_classes), np.int64)
        self.number_n = np.zeros(self.number.shape[:3], np.int64)
        self.item = np.zeros((len(nodes), len(names), n_classes), np.int64)
        self.item_n = np.zeros(self.item.shape[:2], np.int64)

    def splits(self, settings: dict) -> list[tuple]:
        """(node, feature, threshold, counts, n, open) of the nodes and of their children.  A node takes the
        split that lowers the weighted Gini impurity most; ties go to the first feature name, then the
        lowest threshold; without a split it is a leaf."""
        def may_split(node, counts, n):
            return int(node).bit_length() - 1 < settings["max_depth"] and n >= settings["min_samples_split"] and (counts > 0).sum() > 1

        # the options of the nodes that have rows: place of the node, rank of the option, sums and rows to the left
        k = self.total.shape[1]
        rank = {f: j for j, f in enumerate(sorted([*NUMERIC_FEATURES, *self.names]))}
        of_rank = sorted(rank, key=rank.get)
        known = np.arange(BINS)[None, :] < np.array([len(e) for e in settings["edges"]])[:, None]
        at, j = np.nonzero(self.number_n.any(2))
        cut = np.cumsum(self.number[at, j], 1).reshape(-1, k)
        cut_n = np.where(known[j], np.cumsum(self.number_n[at, j], 1), 0).reshape(-1)
        ranks = np.array([rank[f] for f in NUMERIC_FEATURES], np.int64)[j][:, None] * BINS + np.arange(BINS)
        it, f = np.nonzero(self.item_n)
        of_item = np.array([rank[x] for x in self.names], np.int64)
        place = np.concatenate([np.repeat(at, BINS), it])
        option = np.concatenate([ranks.reshape(-1), of_item[f] * BINS if len(f) else np.empty(0, np.int64)])
        left = np.concatenate([cut, self.total[it] - self.item[it, f]])
        left_n = np.concatenate([cut_n, self.total_n[it] - self.item_n[it, f]])
        right, right_n = self.total[place] - left, self.total_n[place] - left_n
        fits = (np.minimum(left_n, right_n) >= max(1, settings["min_samples_leaf"])) & (left.sum(1) > 0) & (right.sum(1) > 0)
        place, option, left, left_n, right, right_n = (x[fits] for x in (place, option, left, left_n, right, right_n))
        purity = sum((x.astype(np.float64) ** 2).sum(1) / x.sum(1) for x in (left, right))
        order = np.lexsort((option, -purity, place))
        best = dict(zip(*(x.tolist() for x in np.unique(place[order], return_index=True)), strict=True)) if len(order) else {}
        out = []
        for i, node in enumerate(self.nodes.tolist()):
            counts, n = self.total[i], int(self.total_n[i])
            before = float((counts.astype(np.float64) ** 2).sum() / max(1, counts.sum()))
            o = order[best[i]] if i in best else None
            if o is None or not may_split(node, counts, n) or purity[o] <= before * (1 + 1e-12):
                out.append((node, None, None, counts, n, False))
                continue
            feature, b = of_rank[option[o] // BINS], option[o] % BINS
            numeric = feature in NUMERIC_FEATURES
            out.append((node, feature, settings["edges"][NUMERIC_FEATURES.index(feature)][b] if numeric else None, counts, n, False))
            for child, c, m in ((2 * node, left[o], int(left_n[o])), (2 * node + 1, right[o], int(right_n[o]))):
                out.append((child, None, None, c, m, may_split(child, c, m)))
        return out


class Grower(Part):
    """Sums of one part of a scope's rows.  A row is held by small codes: (bin, class) of every number, (has it,
    class) of the items that many rows have, lists of rows for the others."""

    def __init__(self, rows: Iterable, settings: dict):
        self.settings, self.k = settings, len(settings["classes"])
        self._taken: dict[str, list] = {}
        self._edges = [np.array(e, np.float64) for e in settings["edges"]]
        super().__init__(rows)
        self.__dict__.update({c: np.concatenate(x) for c, x in self._taken.items()})
        del self._taken
        small = np.min_scalar_type(BINS * self.k)
        self.y = self.y.astype(small)
        self.code = [x.astype(small) * small.type(self.k) + self.y for x in self.numbers]
        self.own = {j: column * small.type(self.k) + self.y for j, column in self.has.items()}
        self.few_first = np.searchsorted(self.few_row, np.arange(self.n + 1)).astype(np.int32)
        self.has_few = np.diff(self.few_first) > 0
        # equal weights: sums and counts of rows go through one pass, as one number
        self.unit = int(self.w[0]) if self.n < 1 << PACKED and (self.w == self.w[0]).all() else None
        self.w = np.broadcast_to(self.w[0], self.n) if self.unit is not None else self.w
        del self.numbers, self.has, self.few_row

    def take(self, batch: pa.RecordBatch) -> None:
        for c, kind in (("y", np.int32), ("w", np.int64), ("key", np.int64), ("fold", np.int16)):
            if c in batch.schema.names and batch[c].null_count == 0:
                self._taken.setdefault(c, []).append(batch[c].to_numpy(zero_copy_only=False).astype(kind))

    def held(self, numbers: np.ndarray) -> np.ndarray:
        """The bins of numbers; a missing one stands in the first."""
        return np.array([np.where(np.isnan(x), 0, np.searchsorted(e, x, "left")) for x, e in zip(numbers, self._edges, strict=True)], np.uint8)

    def right(self, feature: str, threshold: float | None, rows: np.ndarray) -> np.ndarray:
        if feature in NUMERIC_FEATURES:  # a threshold is one of the edges
            j = NUMERIC_FEATURES.index(feature)
            above = np.searchsorted(self._edges[j], threshold, "left") + 1
            return _at(self.code[j], rows) >= above * self.k
        k = self.at.get(feature)
        if k is None:
            return np.zeros(len(rows), bool)
        if k in self.own:
            return _at(self.own[k], rows) >= self.k
        out = _at(self._mark(self._scratch, k, True), rows)
        self._mark(self._scratch, k, False)
        return out

    def draw(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that a tree has, and the weight with which it sums every row."""
        times = multiplicity(self.key, tree, self.settings["random_state"], self.settings["bootstrap"])
        return np.flatnonzero(times), self.weights(times)

    def weights(self, times: np.ndarray) -> np.ndarray:
        return times * float(1 << PACKED) + 1 if self.unit is not None else (self.w * times).astype(np.float64)

    def counted(self, code: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Class weights and rows by code."""
        if self.unit is None:
            return np.bincount(code, weight, size).astype(np.int64), np.bincount(code, minlength=size)
        both = np.bincount(code, weight, size).astype(np.int64)
        return (both >> PACKED) * self.unit, both & ((1 << PACKED) - 1)

    def tables(self, looked: np.ndarray, rows: np.ndarray, weight: np.ndarray, counted) -> Iterator[tuple]:
        """(kind of sums, place, class weights, rows) of everything that a node looks at, ``counted(codes, size,
        rows or None)`` by code; the weights and rows go in whatever shape it gives them before the codes."""
        k, width = self.k, len(NUMERIC_FEATURES)
        yield ("total", None, *counted(_at(self.y, rows), k, None))
        for j in np.flatnonzero(looked[:width]).tolist():
            w, n = counted(_at(self.code[j], rows), BINS * k, None)
            yield "number", j, w.reshape(*w.shape[:-1], BINS, k), n.reshape(*n.shape[:-1], BINS, k).sum(-1)
        looks = looked[width:]
        for j in np.flatnonzero(looks).tolist():
            if j in self.own:
                w, n = counted(_at(self.own[j], rows), 2 * k, None)
                yield "item", j, w[..., k:], n[..., k:].sum(-1)
        some = np.flatnonzero(_at(self.has_few, rows)) if len(self.few_item) and any(j not in self.own for j in np.flatnonzero(looks).tolist()) else []
        if len(some):
            first = self.few_first[rows[some]]
            many = self.few_first[rows[some] + 1] - first
            item = self.few_item[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
            at = np.repeat(some, many)
            seen = looks[item]
            at, item = at[seen], item[seen]
            if len(at):
                names = np.flatnonzero(looks)
                w, n = counted(np.searchsorted(names, item) * k + self.y[rows[at]], len(names) * k, at)
                w, n = w.reshape(*w.shape[:-1], len(names), k), n.reshape(*n.shape[:-1], len(names), k).sum(-1)
                for place, j in enumerate(names.tolist()):
                    if j not in self.own:
                        yield "item", j, w[..., place, :], n[..., place]

    def sums(self, tree: int, groups: list[tuple[int, np.ndarray]], weight: np.ndarray) -> Sums:
        """Sums for open nodes (in order) of a tree with their drawn rows."""
        s = self.settings
        nodes = np.array([node for node, _ in groups], np.int64)
        looked = looks_at([*NUMERIC_FEATURES, *self.names], nodes, tree, s["random_state"], s["n_features"])
        out = Sums(nodes, self.names.tolist(), self.k)
        for g, (_, rows) in enumerate(groups):
            its = _at(weight, rows)
            for kind, j, w, n in self.tables(looked[g], rows, its, lambda code, size, at: self.counted(code, its if at is None else its[at], size)):
                of = g if j is None else (g, j)
                getattr(out, kind)[of] = w
                getattr(out, f"{kind}_n")[of] = n.sum() if j is None else n
        return out

    def cells(self, tree: int, s: Sums) -> pa.RecordBatch:
        """The sums as rows of ``HISTOGRAM``; feature '' has the nodes' totals."""
        found = []
        for w, n, names in ((s.total, s.total_n, None), (s.number, s.number_n, np.array(NUMERIC_FEATURES, object)), (s.item, s.item_n, self.names)):
            # rows are counted by bin alone: they stand with the class -1
            at_w, at_n = np.argwhere(w), np.argwhere(n)
            for at, values, c in ((at_w, w[tuple(at_w.T)], at_w[:, -1]), (at_n, n[tuple(at_n.T)], np.full(len(at_n), -1))):
                found.append((s.nodes[at[:, 0]], np.full(len(at), "", object) if names is None else names[at[:, 1]],
                              at[:, 2] if names is not None and len(names) and w.ndim == 4 else np.zeros(len(at), np.int64), c, values))
        node, feature, b, c, value = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([
            pa.array([self.settings["scope_key"]] * len(node), pa.string()), pa.array(np.full(len(node), tree, np.int32)), pa.array(node),
            pa.array(feature, pa.string()), pa.array(b.astype(np.int32)), pa.array(c.astype(np.int32)),
            pa.array(np.where(c >= 0, value, 0)), pa.array(np.where(c < 0, value, 0))], schema=HISTOGRAM)

    def grow(self, trees: Iterable[int]) -> Iterator[pa.RecordBatch]:
        """Whole trees of a scope that has one part."""
        for tree in trees:
            rows, weight = self.draw(tree)
            done, level = {}, [(1, rows)] if len(rows) else []  # a tree without rows has no nodes
            while level:
                following = []
                fresh = {x[0]: x for x in self.sums(tree, level, weight).splits(self.settings)}
                done |= fresh
                for node, rows in level:
                    if fresh[node][1] is None:
                        continue
                    right = self.right(*fresh[node][1:3], rows)
                    for child, its in ((2 * node, rows.compress(~right)), (2 * node + 1, rows.compress(right))):
                        if fresh[child][5] and len(its):
                            following.append((child, its))
                        else:
                            done[child] = (*fresh[child][:5], False)
                level = following
            yield _node_rows(self.settings["scope_key"], tree, list(done.values()))


def _node_rows(scope: str, tree: int, nodes: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*nodes, strict=True)) if nodes else [()] * 6
    return pa.RecordBatch.from_arrays([
        pa.array([scope] * len(nodes), pa.string()), pa.array([tree] * len(nodes), pa.int32()), pa.array(columns[0], pa.int64()),
        pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()),
        pa.array([c.tolist() for c in columns[3]], pa.list_(pa.int64())), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.bool_())],
        schema=NODE)


def split_tree(cells: pa.Table, settings: pa.Table) -> pa.Table:
    """New nodes of one tree from its added-up sums: the open nodes, as splits with two children or as leaves."""
    s, tree = settings.to_pylist()[0], cells["tree"][0].as_py()
    node, feature, b, c, w, n = (cells[x].to_numpy() for x in ("node", "feature", "bin", "y", "w", "n"))
    nodes, place = np.unique(node, return_inverse=True)
    names = sorted({f for f in feature.tolist() if f and f not in NUMERIC_FEATURES})
    out = Sums(nodes, names, len(s["classes"]))
    at_name = {f: j for j, f in enumerate(names)} | {f: j for j, f in enumerate(NUMERIC_FEATURES)} | {"": 0}
    j = np.array([at_name[f] for f in feature.tolist()], np.int64)
    kind = np.array([0 if not f else 1 if f in NUMERIC_FEATURES else 2 for f in feature.tolist()])
    for k, held, held_n in ((0, out.total, out.total_n), (1, out.number, out.number_n), (2, out.item, out.item_n)):
        x = kind == k
        index = (place[x],) if k == 0 else (place[x], j[x], b[x]) if k == 1 else (place[x], j[x])
        real = c[x] >= 0
        held[(*(i[real] for i in index), c[x][real])] = w[x][real]
        held_n[tuple(i[~real] for i in index)] = n[x][~real]
    return pa.Table.from_batches([_node_rows(s["scope_key"], tree, out.splits(s))])


def _with_models(rows: DataFrame, models: DataFrame, part_rows: int) -> DataFrame:
    """Task rows: the model of a scope once for each part of its rows (``head``), then these.  Beside a row the
    model's lists are empty, not null: Spark's Arrow writer sizes a batch after every row and walks back over
    all nulls of a list each time."""
    sizes = rows.groupBy("scope_key").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    each = models.join(sizes, "scope_key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = rows.join(sizes, "scope_key").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    none = F.struct(*((F.array() if isinstance(f.dataType, ArrayType) else F.lit(None)).cast(f.dataType).alias(f.name) for f in models.schema.fields))
    return each.select("scope_key", "part", F.lit(True).alias("head"), F.struct(*models.columns).alias("model"), F.lit(None).cast(split.select(
        F.struct(*rows.columns)).schema[0].dataType).alias("row")).unionByName(split.select(
            "scope_key", "part", F.lit(False).alias("head"), none.alias("model"), F.struct(*rows.columns).alias("row")))


def _scoped(tasks: DataFrame, run, result) -> DataFrame:
    """Run over (model, Arrow batches of rows) of every part of a scope."""
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for b in batches:
                if not b.num_rows:
                    continue
                scope, part = b["scope_key"].dictionary_encode(), b["part"].to_numpy()
                code = scope.indices.to_numpy()
                cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(part)]
                for k, end in zip(cuts, cuts[1:]):
                    yield (scope[k].as_py(), int(part[k])), b.slice(k, end - k)

        def its_rows(first: pa.RecordBatch, others):
            for b in chain((first,), (b for _, b in others)):
                if b.num_rows:
                    row = b["row"]
                    yield pa.RecordBatch.from_arrays(row.flatten(), names=[f.name for f in row.type])

        for _, group in groupby(flat(), key=lambda x: x[0]):
            first = next(group)[1]
            if not first["head"][0].as_py():
                continue
            model, rows = first["model"][0].as_py(), its_rows(first.slice(1), group)
            one = next(rows, None)
            if one is not None:
                yield from run(model, chain((one,), rows))

    # a stated number of partitions: the rows are few bytes and much work, so they must not be coalesced by size;
    # many, so that few tasks hold the parts of several scopes
    return tasks.repartition(_task_partitions(tasks.sparkSession), "scope_key", "part") \
        .sortWithinPartitions("scope_key", "part", ~F.col("head")).mapInArrow(over, result)


def packed(rows: DataFrame, together: bool = False) -> DataFrame:
    """Rows ``scope_key, ...`` as pieces ``scope_key, key, data`` of some ``PIECE_ROWS`` rows of a scope, compressed in
    Arrow's format: rows that go to many tasks are turned into columns once, and a piece moves as one value.
    ``together``: rows of one ``key`` stand in one piece."""
    if together:
        sizes = rows.groupBy("scope_key").agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).alias("_pieces"))
        piece = F.concat_ws("#", F.pmod(F.xxhash64("key"), F.col("_pieces")).cast("string"), "scope_key")
        rows = rows.join(sizes, "scope_key").withColumn("scope_key", piece).drop("_pieces") \
            .repartition(_task_partitions(rows.sparkSession), "scope_key").sortWithinPartitions("scope_key")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        task, made = TaskContext.get().partitionId(), count()

        def pieces(scopes):
            for scope in scopes:
                table = pa.Table.from_batches(held.pop(scope)).combine_chunks()
                del sizes[scope]
                if "items" in table.column_names:
                    items = table["items"].combine_chunks()
                    ends = pa.array(np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())]).astype(np.int32))
                    table = table.set_column(table.schema.get_field_index("items"), "items", pa.ListArray.from_arrays(ends, items.flatten().dictionary_encode()))
                scope = scope.partition("#")[2] if together else scope
                yield pa.RecordBatch.from_arrays([pa.array([scope], pa.string()), pa.array([f"{task}-{next(made)}"]), pa.array([_bytes(table.to_batches()[0])], pa.binary())],
                                                 names=["scope_key", "key", "data"])

        for b in batches:
            scope = b["scope_key"].dictionary_encode()
            code, b = scope.indices.to_numpy(), b.drop_columns(["scope_key"])
            for k, name in enumerate(scope.dictionary.to_pylist()):
                its = b if len(scope.dictionary) == 1 else b.take(pa.array(np.flatnonzero(code == k)))
                if its.num_rows:
                    held.setdefault(name, []).append(its)
                    sizes[name] = sizes.get(name, 0) + its.num_rows
            if together:  # in order: only the last one goes on
                yield from pieces(list(held)[:-1])
            else:
                full = [name for name, n in sizes.items() if n >= PIECE_ROWS]
                yield from pieces(full if sum(sizes.values()) < 20 * PIECE_ROWS else list(held))
        yield from pieces(list(held))

    return rows.mapInArrow(pack, "scope_key string, key string, data binary")


def _bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(pieces: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """(key, rows) of pieces."""
    for b in pieces:
        for key, data in zip(b["key"].to_pylist(), b["data"]):
            yield key, pa.ipc.open_stream(data.as_buffer()).read_next_batch()


def _task_partitions(spark) -> int:
    # many more than tasks run at a time: two heavy parts seldom meet in one
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 32 * spark.sparkContext.defaultParallelism)


def _bunches(settings: DataFrame, larger: int = 4) -> DataFrame:
    """Every scope once for each bunch of ``bunch_trees`` of its trees."""
    held = settings.withColumn("bunch_trees", F.when(F.col("rows") <= PART_ROWS, TREE_BUNCH).otherwise(larger * TREE_BUNCH))
    return held.withColumn("bunch", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_estimators") - 1) / F.col("bunch_trees")).cast("int"))))


def _of_bunch(model: dict) -> range:
    first = model["bunch"] * model["bunch_trees"]
    return range(first, min(first + model["bunch_trees"], model["n_estimators"]))


def train_forests(train: DataFrame, settings: DataFrame, part_rows: int | None = None) -> DataFrame:
    """Forests of all scopes from rows ``scope_key, key, label, weight, numbers, items`` and their
    settings (``scope_settings``, whose parameters may be changed; ``first_tree`` numbers the trees).
    Scopes of up to ``WHOLE_ROWS`` rows are grown whole, others in parts of ``PART_ROWS``; ``part_rows``
    stands for both."""
    whole_rows, part_rows = part_rows or WHOLE_ROWS, part_rows or PART_ROWS
    if "first_tree" not in settings.columns:
        settings = settings.withColumn("first_tree", F.lit(0))
    settings = _stored(settings)
    rows = _stored(train.where("scope_key is not null and label is not null and key is not null and weight > 0")
                   .join(settings.select("scope_key", "classes"), "scope_key")
                   .select("scope_key", F.xxhash64("key").alias("key"), "numbers", "items",
                           (F.array_position("classes", F.col("label")) - 1).cast("int").alias("y"),
                           F.round(F.col("weight") * UNIT).cast("long").alias("w")))
    trees = F.sequence(F.col("first_tree").cast("int"), (F.col("first_tree") + F.col("n_estimators") - 1).cast("int"))
    nodes = settings.select("scope_key", F.explode(trees).alias("tree"), F.lit(1).cast("long").alias("node"),
                            F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("threshold"),
                            F.array().cast("array<long>").alias("counts"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("open"))
    settings_cols = ["scope_key", "classes", "edges", "n_features", "max_depth", "min_samples_split", "min_samples_leaf", "bootstrap",
                     "random_state"]
    # scopes that are grown whole: all levels of a bunch of trees on all rows of the scope
    small = settings.where(F.col("rows") <= whole_rows)
    bunches = _bunches(small, 2).select(*settings_cols, "n_estimators", "first_tree", "bunch", "bunch_trees")
    pieces = _stored(packed(rows.join(small.select("scope_key"), "scope_key", "left_semi")))
    of_bunch = pieces.join(bunches.select("scope_key", "bunch"), "scope_key").select(
        F.concat_ws("#", F.col("bunch").cast("string"), "scope_key").alias("scope_key"), "key", "data")
    asked = bunches.withColumn("of", F.col("scope_key")).withColumn("scope_key", F.concat_ws("#", F.col("bunch").cast("string"), "scope_key"))

    def whole(model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Grower((b for _, b in unpacked(batches)), {**model, "scope_key": model["of"]}).grow([t + model["first_tree"] for t in _of_bunch(model)])

    done = _stored(_scoped(_with_models(of_bunch, asked, 1 << 30), whole, NODE_DDL))
    nodes = _stored(nodes.join(small.select("scope_key"), "scope_key", "left_anti"))

    def run(model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grower = Grower(batches, model)
        trees: dict[int, tuple[list, set]] = {}
        for x in model["nodes"]:
            splits, open_nodes = trees.setdefault(x["tree"], ([], set()))
            if x["feature"] is not None:
                splits.append((x["node"], x["feature"], x["threshold"]))
            elif x["open"]:
                open_nodes.add(x["node"])
        for tree, (splits, open_nodes) in trees.items():
            # only the splits above open nodes are walked
            above = {node >> d for node in open_nodes for d in range(1, node.bit_length())}
            rows, weight = grower.draw(tree)
            at = grower.walk([x for x in splits if x[0] in above], rows) if open_nodes and len(rows) else {}
            found = sorted((node, at[node]) for node in open_nodes & at.keys())
            if found:
                yield grower.cells(tree, grower.sums(tree, found, weight))

    # the others: one pass over all parts a level
    while nodes.where("open").limit(1).count():
        growing = nodes.where("open").select("scope_key").distinct()
        held = nodes.groupBy("scope_key").agg(F.collect_list(F.struct("tree", "node", "feature", "threshold", "open")).alias("nodes"))
        models = settings.join(growing, "scope_key", "left_semi").join(held, "scope_key").select(*settings_cols, "nodes")
        cells = _scoped(_with_models(rows.join(growing, "scope_key", "left_semi"), models, part_rows), run,
                        "scope_key string, tree int, node long, feature string, bin int, y int, w long, n long")
        # a stated number of partitions, here too: a tree's sums are few bytes and much work
        sums = cells.repartition(_task_partitions(cells.sparkSession), "scope_key", "tree").groupBy("scope_key", "tree", "node", "feature", "bin", "y").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        of = settings.select(F.col("scope_key").alias("of_scope"), F.explode(trees).alias("of_tree"), *settings_cols)
        fresh = sums.groupBy("scope_key", "tree").cogroup(of.groupBy("of_scope", "of_tree")).applyInArrow(
            lambda a, b: split_tree(a, b) if len(a) else NODE.empty_table(), NODE_DDL)
        fresh = _stored(fresh)
        # an open node without any drawn row stays as the leaf that its parent's split described
        kept = nodes.join(fresh.select("scope_key", "tree", "node"), ["scope_key", "tree", "node"], "left_anti").withColumn("open", F.lit(False))
        nodes = _stored(kept.unionByName(fresh))
    return done.unionByName(nodes).where(F.size("counts") > 0).drop("open")


# ------------------------------------------------------------------ saved forests, warm start, scoring
def save_forests(nodes: DataFrame, settings: DataFrame, folder: str, version: str) -> None:
    """Write the node tables and classes of all scopes under a version."""
    nodes.write.mode("error").parquet(f"{folder}/nodes/version={version}")
    settings.select("scope_key", "classes").write.mode("error").parquet(f"{folder}/classes/version={version}")


def new_folder(spark) -> str:
    """A folder for saved forests in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/forests-{uuid.uuid4().hex}"


def load_forests(spark, folder: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Node tables and classes of a saved version."""
    return tuple(spark.read.parquet(f"{folder}/{part}/version={version}") for part in ("nodes", "classes"))


def warm_start(nodes: DataFrame, classes: DataFrame, train: DataFrame, settings: DataFrame, extra_trees: int,
               part_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(node tables, classes): scopes whose classes are those of their old forest keep its trees and get
    ``extra_trees`` more, grown on the new rows; the others, and new scopes, are trained anew."""
    old = classes.select("scope_key", F.col("classes").alias("old"))
    first = nodes.groupBy("scope_key").agg((F.max("tree") + 1).alias("next"))
    both = settings.join(old, "scope_key", "left").join(first, "scope_key", "left") \
        .withColumn("keeps", F.coalesce(F.col("old") == F.col("classes"), F.lit(False)) & F.col("next").isNotNull())
    plan = _stored(both.withColumn("first_tree", F.when(F.col("keeps"), F.col("next")).otherwise(0))
                   .withColumn("n_estimators", F.when(F.col("keeps"), F.lit(extra_trees)).otherwise(F.col("n_estimators")))
                   .withColumn("random_state", F.col("random_state") + F.col("keeps").cast("int")).drop("old", "next"))
    grown = train_forests(train, plan.drop("keeps"), part_rows)
    retrained = plan.where("not keeps").select("scope_key")
    kept = nodes.join(retrained, "scope_key", "left_anti").unionByName(grown)
    known = classes.select("scope_key", "classes").join(retrained, "scope_key", "left_anti").unionByName(
        plan.where("not keeps").select("scope_key", "classes"))
    return kept, known


def add_votes(part: Part, trees: list[list], total: np.ndarray) -> None:
    """Add the leaf shares of all trees to the rows' totals, tree by tree.  The tests of a group of trees are taken
    once for all rows; then every row steps from node to node, where a leaf has a test that no row passes and
    itself as child."""
    first = 0
    while first < len(trees):
        tests: dict[tuple, int] = {}
        group = []
        for tree in trees[first:]:
            its = {(x["feature"], x["threshold"]) for x in tree if x["feature"] is not None}
            if group and len(its | tests.keys()) > TESTS:
                break
            for t in its:
                tests.setdefault(t, len(tests))
            group.append(tree)
        first += len(group)
        passed = np.zeros((len(tests) + 1, part.n), np.uint8)
        for (feature, threshold), k in tests.items():
            passed[k] = part.right(feature, threshold)
        passed = passed.reshape(-1)
        tables = [_stepping(tree, tests, part.n) for tree in group]
        for start in range(0, part.n, BLOCK):
            rows = np.arange(start, min(start + BLOCK, part.n))
            at, x = np.empty(len(rows), np.int64), np.empty(len(rows), np.uint8)
            out = total[start:start + len(rows)]
            for test, child, depth, votes in tables:
                node = np.zeros(len(rows), np.int64)
                for _ in range(depth):
                    np.take(test, node, out=at, mode="clip")
                    at += rows
                    np.take(passed, at, out=x, mode="clip")
                    np.take(child, node, out=at, mode="clip")
                    np.add(at, x, out=node)
                out += votes.take(node, axis=0)


def _stepping(tree: list, tests: dict[tuple, int], n: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(first cell of the test, left child, depth, leaf shares) of the nodes of a tree; a right child stands next to the left one."""
    of = {x["node"]: x for x in tree}
    order = [1]
    for node in order:
        if of[node]["feature"] is not None:
            order += (2 * node, 2 * node + 1)
    place = {node: k for k, node in enumerate(order)}
    split = [of[node]["feature"] is not None for node in order]
    test = np.array([tests[of[node]["feature"], of[node]["threshold"]] if s else len(tests) for node, s in zip(order, split)], np.int64) * n
    child = np.array([place[2 * node] if s else place[node] for node, s in zip(order, split)], np.int64)
    votes = np.array([of[node]["counts"] for node in order], np.float64)
    return test, child, order[-1].bit_length() - 1, votes / votes.sum(1, keepdims=True)


def score(rows: DataFrame, nodes: DataFrame, classes: DataFrame, *keep: str, top: int = 3, part_rows: int = PART_ROWS) -> DataFrame:
    """``keep, predicted_label, confidence, top_k`` of rows ``scope_key, key, numbers, items`` by the forest
    of their scope (or scope and version as one key): the mean of all trees' leaf shares; ties go to the
    higher class.  Rows whose scope has no forest have nulls."""
    held = nodes.groupBy("scope_key").agg(F.collect_list(F.struct("tree", "node", "feature", "threshold", "counts")).alias("nodes"))
    models = held.join(classes.select("scope_key", "classes"), "scope_key")
    known = rows.join(models.select("scope_key"), "scope_key", "left_semi").select(
        "scope_key", "key", "numbers", "items", *(c for c in keep if c not in ("scope_key", "key", "numbers", "items")))
    kinds = {f.name: f for f in known.schema.fields}
    top_type = ArrayType(StructType().add("label", "string").add("prob", "double"))
    result = StructType([kinds[c] for c in keep]).add("predicted_label", "string").add("confidence", "double").add("top_k", top_type)
    schema = to_arrow_schema(result)

    def run(model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        part, names = Part(batches), model["classes"]
        trees: dict[int, list] = {}
        for x in model["nodes"]:
            trees.setdefault(x["tree"], []).append(x)
        total = np.zeros((part.n, len(names)))
        add_votes(part, [trees[tree] for tree in sorted(trees)], total)
        total /= len(trees)
        order = np.argsort(total, axis=1, kind="stable")[:, ::-1][:, :top]
        labels, first = pa.array(names, pa.string()), 0
        for b in batches:
            o = order[first:first + b.num_rows]
            p = np.take_along_axis(total[first:first + b.num_rows], o, 1)
            first += b.num_rows
            each = pa.StructArray.from_arrays([labels.take(pa.array(o.reshape(-1))), pa.array(p.reshape(-1))], names=["label", "prob"])
            ends = pa.array(np.arange(0, o.size + 1, o.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*(b[c].cast(schema.field(c).type) for c in keep), labels.take(pa.array(o[:, 0].copy())),
                                              pa.array(p[:, 0].copy()), pa.ListArray.from_arrays(ends, each).cast(schema.field("top_k").type)], schema=schema)

    scored = _scoped(_with_models(known, models, part_rows), run, result)
    lost = rows.join(models.select("scope_key"), "scope_key", "left_anti").select(
        *keep, F.lit(None).cast("string").alias("predicted_label"), F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast(top_type).alias("top_k"))
    return scored.unionByName(lost)


def own_or_global(rows: DataFrame, clinic_key: Column, scopes: DataFrame, fallback: str = "global:GLOBAL") -> DataFrame:
    """Rows with the scope whose forest scores them: the clinic's own, if ``scopes`` has one, else the global one."""
    own = scopes.select(F.col("scope_key").alias("_own")).where("_own like 'clinic:%'") \
        .withColumn("_clinic", F.regexp_extract("_own", r"^clinic:(.*):[^:]*$", 1))
    return rows.withColumn("_c", clinic_key).join(own, F.col("_c") == F.col("_clinic"), "left") \
        .withColumn("scope_key", F.coalesce("_own", F.lit(fallback))).drop("_c", "_own", "_clinic")
