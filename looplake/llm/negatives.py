"""Hard-negative mining by threshold joins over an inverted index of bounded norms.

Anchors (a stated set of rows) look for their best rows of the same label, the positives, and for
every positive for the best rows of other labels whose score lies in a window below the positive's.
Both are threshold joins "all rows with an inner product of at least t", asked with falling t until
the windows are full:

* Rows stand in blocks of bounded size, anchors come to every block in batches.  A block orders its
  dimensions by their share of all squares and cuts them into slices.  For a threshold of ``theta``
  times the block's largest norm, a row is indexed from the first slice on before which its norm
  exceeds ``theta``: the leading slices before that cannot reach the threshold alone, and stay out.
  Rows are sorted by that slice, so the posting list of a slice is a range of rows.
* An anchor runs through the slices from the last to the first and adds up partial scores.  A row is
  given up when its partial score plus the product of the remaining norms is below the threshold;
  once few are left, they go on as single pairs.  Pairs that reach the unindexed slices add them and
  are compared exactly.
* Anchors whose windows are not full go on with the next lower threshold, at last with the lower
  ends of their windows, so the result is exact.

A block gives at most the wanted number of rows for a window; Spark merges the blocks by a group
limit.  Positives use blocks of one label (a frequent label has several), negatives blocks of all
rows.  Only integers are compared: a component x counts as floor(scale * x).

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no
part; vectors of different length are filled up with zeros; "other" rows are rows with another id,
and rows that repeat an id are rows of their own, as anchors too; an anchor without a positive and a
positive without a window (a score below zero) give no rows; ties go to the smaller id; scores
of 2^53 or more raise an error; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from looplake.llm.common import batch, give_back, materialize, text_batches

#: Thresholds in turn, as shares of anchor norm times largest row norm; then the windows' ends.
LADDER = (0.8, 0.65, 0.52, 0.42, 0.33, 0.25, 0.17, 0.08, 0.0)
SLICES = 8
#: Pairs go on one by one once less than this share of a posting list is left.
SPARSE = 0.08


def _exact(norms: float):
    """The cheapest type in which all partial sums are exact: they are bounded by the product of norms."""
    if norms >= 2**53:
        raise ValueError("inner products of 2^53 or more are not supported")
    return np.float32 if norms < 2**24 else np.float64


def _tails(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of every row before each cut, rounded up."""
    squares = np.cumsum(x.astype(np.float64) ** 2, axis=1)
    before = np.stack([squares[:, c - 1] if c else np.zeros(len(x)) for c in cuts], axis=1)
    return np.sqrt(before) * (1 + 1e-9)


class Block:
    """Rows ready for threshold joins."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(0), kind="stable")
        self.ids, self.labels, self.vectors = ids, labels, vectors[:, self.order]
        d = vectors.shape[1]
        self.cuts = sorted({round(k * d / SLICES) for k in range(SLICES + 1)})
        self.norms = _tails(self.vectors, self.cuts)
        self.largest = float(self.norms[:, -1].max(initial=0.0))
        self.levels: dict = {}

    def index(self, theta: float, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Row numbers by first indexed slice, that slice, vectors, norms, and how many each slice lists."""
        if (theta, kind) not in self.levels:
            least = theta * self.largest
            first = (self.norms[:, 1:] < least).sum(1) if theta > 0 else np.zeros(len(self.ids), np.int64)
            rows = np.argsort(first, kind="stable")
            listed = np.searchsorted(first[rows], np.arange(len(self.cuts) - 1), "right").tolist()
            rows = rows[:listed[-1]]
            self.levels[theta, kind] = rows, first[rows], self.vectors[rows].astype(kind), self.norms[rows], listed
        return self.levels[theta, kind]

    def at_least(self, anchors: np.ndarray, least: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs with a score of at least ``least`` (by anchor), which is
        not below ``theta`` times the norms."""
        mine = anchors[:, self.order]
        norms = _tails(mine, self.cuts)
        kind = _exact(self.largest * norms[:, -1].max(initial=0.0))
        rows, first, vectors, rest, listed = self.index(theta, kind)
        q = mine.astype(kind)
        bound = least - 0.5  # scores are whole numbers

        def add(a, r, s, k):
            return s + np.einsum("ij,ij->i", q[a, self.cuts[k]:self.cuts[k + 1]], vectors[r, self.cuts[k]:self.cuts[k + 1]])

        partial = np.zeros((len(q), len(rows)), kind)
        pairs, k = None, len(self.cuts) - 2
        while pairs is None:
            n, lo, hi = listed[k], self.cuts[k], self.cuts[k + 1]
            if n:
                partial[:, :n] += q[:, lo:hi] @ vectors[:n, lo:hi].T
            if 2 * k < len(self.cuts):
                # a row still lacks the slices before this one, or before its first indexed one
                lack = np.maximum(first, k)
                alive = partial + norms[:, lack] * rest[np.arange(len(rows)), lack] >= bound[:, None]
                if k == 0 or alive.sum() <= SPARSE * alive.size:
                    a, r = np.nonzero(alive)
                    pairs = a, r, partial[a, r]
            k -= 1
        a, r, s = pairs
        for j in range(len(self.cuts) - 2, -1, -1):
            if j > k:  # indexed slices are in already
                late = np.flatnonzero(first[r] > j)
                s[late] = add(a[late], r[late], s[late], j)
            else:
                s = add(a, r, s, j)
                alive = s + norms[a, j] * rest[r, j] >= bound[a]
                a, r, s = a[alive], r[alive], s[alive]
        found = s >= bound[a]
        return a[found], rows[r[found]], s[found].astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, wanted: int) -> np.ndarray:
    """The first rows by falling score, then id."""
    if len(scores) > 4 * wanted:  # ties at the border stay
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - wanted)[len(scores) - wanted])
        return keep[np.lexsort((ids[keep], -scores[keep]))[:wanted]]
    return np.lexsort((ids, -scores))[:wanted]


def search(block: Block, anchors: dict, same: bool, wanted: int) -> Iterator[tuple]:
    """(anchor, window, row, score): for each anchor and window (lowest, highest score) the first rows
    of the block of the same (or another) label."""
    n = len(anchors["id"])
    open_ = {i: list(range(len(anchors["windows"][i]))) for i in range(n) if anchors["windows"][i]}
    size = np.sqrt((anchors["vector"].astype(np.float64) ** 2).sum(1)) * block.largest
    for theta in (*LADDER, -np.inf):
        if not open_:
            return
        who = np.array(sorted(open_))
        lowest = np.array([min(anchors["windows"][i][w][0] for w in open_[i]) for i in who], np.float64)
        step = np.maximum(np.ceil(theta * size[who] * (1 + 1e-9)), 1) if theta > 0 else np.full(len(who), -np.inf if theta < 0 else 0.0)
        least = np.maximum(step, lowest)
        top = np.array([max(anchors["windows"][i][w][1] for w in open_[i]) for i in who], np.float64)
        go = np.flatnonzero(least <= top)  # no window of the others reaches up to here
        a, r, s = block.at_least(anchors["vector"][who[go]], least[go], theta)
        a = who[go][a]
        like = block.labels[r] == anchors["label"][a]
        fit = (like if same else ~like) & (block.ids[r] != anchors["id"][a])
        a, r, s = a[fit], r[fit], s[fit]
        order = np.argsort(a, kind="stable")
        a, r, s = a[order], r[order], s[order]
        starts, ends = np.searchsorted(a, who, "left"), np.searchsorted(a, who, "right")
        for i, x, y, t in zip(who.tolist(), starts.tolist(), ends.tolist(), least.tolist(), strict=True):
            left = []
            for w in open_[i]:
                low, high = anchors["windows"][i][w]
                inside = np.flatnonzero((s[x:y] >= low) & (s[x:y] <= high)) + x
                if len(inside) < wanted and t > low:
                    left.append(w)
                    continue
                for k in inside[_best(block.ids[r[inside]], s[inside], wanted)]:
                    yield i, w, int(r[k]), int(s[k])
            if left:
                open_[i] = left
            else:
                del open_[i]


_FOUND = pa.schema([("row_no", pa.int64()), ("window", pa.int32()), ("found_id", pa.int64()), ("score", pa.int64())])


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _join(tasks: DataFrame, same: bool, wanted: int, batch_anchors: int) -> DataFrame:
    """``row_no, window, found_id, score``: the windows of every (anchor, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            """(block, is anchor, rows) in sorted order, anchors at most a batch at once."""
            for b in batches:
                of = np.stack([b.column(k).cast(pa.int64()).to_numpy() for k in range(3)])
                edges = (np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0)) + 1).tolist()
                for x, y in zip([0, *edges], [*edges, b.num_rows], strict=True):
                    step = batch_anchors if of[2, x] else y - x
                    for z in range(x, y, step):
                        yield (int(of[0, x]), int(of[1, x])), bool(of[2, x]), b.slice(z, min(step, y - z))

        for _, group in groupby(parts(), key=lambda p: p[0]):
            rows, block = [], None
            for _, is_anchor, part in group:
                if not is_anchor:
                    rows.append(part)
                    continue
                if not rows:
                    continue
                if block is None:
                    width = max(1, *(int(np.diff(p.column(6).offsets.to_numpy()).max()) for p in rows))
                    block = Block(np.concatenate([p.column(4).to_numpy() for p in rows]),
                                  np.concatenate([p.column(5).to_numpy() for p in rows]),
                                  np.concatenate([_matrix(p.column(6), width) for p in rows]))
                wide = max(block.vectors.shape[1], int(np.diff(part.column(6).offsets.to_numpy()).max()))
                anchors = {"id": part.column(4).to_numpy(), "label": part.column(5).to_numpy(),
                           "vector": _matrix(part.column(6), wide)[:, :block.vectors.shape[1]],
                           "windows": [[(w["low"], w["high"]) for w in ws] for ws in part.column(7).to_pylist()]}
                found = list(search(block, anchors, same, wanted))
                if found:
                    i, w, r, s = zip(*found, strict=True)
                    yield batch(_FOUND, {"row_no": part.column(3).to_numpy()[list(i)], "window": w,
                                         "found_id": block.ids[list(r)], "score": s})
        give_back()

    return text_batches(tasks.repartition("grp", "part").sortWithinPartitions("grp", "part", "anchor")) \
        .mapInArrow(run, "row_no long, window int, found_id long, score long")


def _parts(rows: Column, block_rows: int, least_blocks: int) -> Column:
    """Blocks for so many rows: of ``block_rows`` rows at most, smaller ones where there would be few of them."""
    return F.greatest(F.ceil(rows / block_rows), F.least(F.lit(least_blocks), F.ceil(rows / 2048))).cast("long")


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low_pct: int = 30,
         high_pct: int = 90, scale: int = 256, block_rows: int = 32768, batch_anchors: int = 64,
         id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for anchors and
    their first ``n_positives`` rows of the same label the first ``n_negatives`` rows of other labels
    with ``low_pct * positive_score <= 100 * negative_score <= high_pct * positive_score``."""
    spark = vectors.sparkSession
    values = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
        F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    label = F.col("label") if label is None else label
    rows = materialize(vectors.where(sound).select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        values.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")).where("label is not null"))
    anchors = rows.where("is_anchor").drop("is_anchor")
    rows = rows.drop("is_anchor")
    least_blocks = max(1, spark.sparkContext.defaultParallelism)
    none = F.lit(None).cast("array<struct<low:long,high:long>>")
    cols = ["row_no", "id", "label", "v", "windows"]

    def tasks(split: DataFrame, asking: DataFrame) -> DataFrame:
        """Rows of each block (``grp, part``), and the anchors, of ``parts`` blocks each, once for every block."""
        return split.select("grp", F.pmod(F.xxhash64("row_no"), "parts").alias("part"), F.lit(False).alias("anchor"),
                            *cols[:-1], none.alias("windows")) \
            .unionByName(asking.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                                       F.lit(True).alias("anchor"), *cols))

    # positives: blocks of one label, more of them for a frequent one
    everything = F.array(F.struct(F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high")))
    parts = rows.groupBy("label").agg(_parts(F.count(F.lit(1)), block_rows, least_blocks).alias("parts")) \
        .withColumn("grp", F.col("label"))
    near = _join(tasks(rows.join(parts, "label"), anchors.withColumn("windows", everything).join(parts, "label")),
                 True, n_positives, batch_anchors)
    place = Window.partitionBy("row_no").orderBy(F.desc("score"), "found_id")
    positives = materialize(near.withColumn("window", F.row_number().over(place) - 1).where(f"window < {n_positives}")
                            .select("row_no", "window", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # windows by positive; below a score of zero they are empty, and those positives come last
    span = F.struct(F.expr(f"(positive_score * {low_pct} + 99) div 100").alias("low"),
                    F.expr(f"(positive_score * {high_pct}) div 100").alias("high"))
    asked = positives.where("positive_score >= 0").groupBy("row_no").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("window", span.alias("span")))), lambda x: x["span"]).alias("windows"))
    n_blocks = rows.agg(F.coalesce(_parts(F.count(F.lit(1)), block_rows, least_blocks), F.lit(0)).alias("n")).first()["n"]
    whole = {"grp": F.lit(0).cast("long"), "parts": F.lit(n_blocks).cast("long")}
    far = _join(tasks(rows.withColumns(whole), anchors.join(asked, "row_no").withColumns(whole)),
                False, n_negatives, batch_anchors)
    place = Window.partitionBy("row_no", "window").orderBy(F.desc("score"), "found_id")
    ranked = far.withColumn("rank", F.row_number().over(place)).where(f"rank <= {n_negatives}")
    return ranked.join(positives, ["row_no", "window"]).join(anchors.select("row_no", F.col("id").alias("anchor_id")), "row_no") \
        .select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"))
