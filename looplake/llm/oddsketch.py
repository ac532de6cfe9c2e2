"""Near duplicates by odd sketches: banded candidates, parity bitmaps, exact verification.

A document's set are the hashes of its distinct four-word shingles (64 bits).  Two documents link
when 100 |x & y| >= 80 |x | y|; the result are the connected components of these links.

1. One pass over the texts makes for every document: the size and a digest of its set; 128 minima
   under multiplications, in 32 bands of 4; and an odd sketch: the least hash of each of 1,024 ranges
   of hashes is a MinHash sample, and each sample flips one bit of a bitmap of 1,024 bits.
   Documents with equal digests are collapsed.  Sets and texts are not kept.
2. Documents meet in a bucket for every band.  Of a linked pair at the threshold all 32 bands differ
   with a probability of (1 - 0.8^4)^32 = 5e-8, the only way to miss a candidate.
3. The bitmaps' XOR keeps a bit for every sample that only one of two documents has, less pairs of
   them on one bit.  Its population count bounds the difference of the samples (``limit``); pairs
   over the bound, which lies six deviations over the expected count of a linked pair, are dropped.
   a. In each bucket one document, the pivot, is compared with the others.
   b. Documents near a pivot, but not linked to it, are compared with those that are (the Jaccard
      distance is a metric: who is over 0.4 from the pivot is over 0.2 from its star).
   c. Documents that are left in a bucket are compared with each other.
   b. and c. leave out documents that are connected by then; they compare blocks of at most 512
   bitmaps with a stream of others, each pair of a bucket in the bucket of its first common band.
4. Pairs that pass are confirmed on full sets, which only the texts of documents that share a bucket
   are cut into again: in a. as pairs with the pivot, in b. and c. inside the task, so that only
   links become rows, however many documents of a bucket are similar without linking.
5. Components of the confirmed links and the copies.

Defined cases: a document without words has an empty set and no link; with fewer than four words its
whole sequence is the only shingle; rows that repeat a doc_id are texts of one document, which links
if one of them does, with a row each; rows with null doc_id keep their size, link with nothing and
have no component; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from looplake.llm.common import batch, give_back, lower_words, materialize, text_batches
from looplake.llm.components import connected_components

WIDTH, PERCENT = 4, 80
#: Who is less similar to a pivot links to none of the pivot's partners: 1 - 2 (1 - 0.8).
NEAR_PERCENT = 2 * PERCENT - 100
BANDS, ROWS = 32, 4
#: Ranges of hashes (samples), and bits of a sketch.
BINS = BITS = 1024
_WORDS = BITS // 64
_TOP = np.uint64(64 - 10)
#: Odd multipliers: for the minima, for the places of a shingle or band, and for bits.
_ODD = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, BANDS * ROWS + WIDTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MINIMA, _PLACE, _BIT = _ODD[:BANDS * ROWS, None], _ODD[BANDS * ROWS:-1], _ODD[-1]


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _BIT
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = lower_words(text)
    n = len(words) - WIDTH + 1
    if n <= 0:
        return np.array([xxh64_intdigest(b" ".join(words), 1)] if words else [], dtype=np.uint64)
    hashed = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    total = sum(_scatter(hashed[k:n + k] + _PLACE[k]) * _PLACE[k] for k in range(WIDTH))
    return np.unique(_scatter(total))


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for every band; equal sets have equal keys."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(s), 4096):
        np.minimum(least, (_MINIMA * s[None, k:k + 4096]).min(1), out=least)
    mixed = _scatter((least.reshape(BANDS, ROWS) * _PLACE[None, :ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return mixed.view(np.int64)


def odd_sketch(s: np.ndarray) -> bytes:
    """Parity of the samples on every bit.  The hashes are sorted: a range's least is its first."""
    part = s >> _TOP
    samples = s[np.concatenate([[True], part[1:] != part[:-1]])] if len(s) else s
    flips = np.bincount((_scatter(samples * _PLACE[0]) >> _TOP).astype(np.int64), minlength=BITS)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def limit(least_size, percent: int):
    """Most differing bits of two documents, the smaller of ``least_size`` shingles, that are similar by
    ``percent``: each of their ranges has another sample with a probability of 1 - percent / 100, six
    deviations added, but in no more ranges than shingles differ; four more for bits that meet."""
    similar = percent / 100
    size = np.asarray(least_size, np.float64)
    ranges = np.minimum(BINS, size / similar)
    differ = np.minimum(ranges * (1 - similar) + 6 * np.sqrt(ranges * similar * (1 - similar)) + 3, size * (1 - similar) / similar)
    share = (1 - (1 - 2 / BITS) ** (2 * differ)) / 2
    return BITS * share + 4 * np.sqrt(BITS * share * (1 - share)) + 1


SKETCHES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()),
                      ("bands", pa.list_(pa.int64()))])


def sketch_documents(docs: DataFrame) -> DataFrame:
    """Step 1: ``doc_id, n, digest, sketch, bands``, the last three null for an empty set or a null id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                s = shingle_set(text)
                rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), odd_sketch(s), band_keys(s))
                            if len(s) and doc_id is not None else (doc_id, len(s), None, None, None))
            yield batch(SKETCHES, dict(zip(SKETCHES.names, zip(*rows), strict=True)))
        give_back()

    return text_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, n long, digest binary, sketch binary, bands array<long>")


def _blocks(batches: Iterator[pa.RecordBatch], n_columns: int, step: int) -> Iterator[tuple]:
    """((key, part), rows) of sorted task rows: anchors first, then the others in steps."""
    def flat():
        for b in batches:
            yield from zip(*(b.column(k).to_pylist() for k in range(n_columns)), strict=True)

    for _, group in groupby(flat(), key=lambda r: r[:2]):
        anchors, others = [], []
        for row in group:
            (anchors if row[2] else others).append(row)
            if len(others) >= step:
                yield anchors, others
                others = []
        if anchors and others:
            yield anchors, others


def _near(anchors: list, others: list, percent: int, key: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs of rows ``.., doc, n, component, sketch, bands`` whose sketches allow a similarity
    of ``percent``, and which of them allow the threshold.  Rows with a component: only pairs of two.
    With a key, a list's number: each pair of a list once, and only in the list of its first common band."""
    def column(rows, k, kind=np.int64):
        return np.array([r[k] for r in rows], dtype=kind)

    (docs_a, docs_b), (n_a, n_b) = ([column(rows, k) for rows in (anchors, others)] for k in (3, 4))
    bits_a, bits_b = (np.frombuffer(b"".join(r[6] for r in rows), np.uint64).reshape(-1, _WORDS) for rows in (anchors, others))
    small, large = np.minimum(n_a[:, None], n_b[None]), np.maximum(n_a[:, None], n_b[None])
    fit = (100 * small >= percent * large) & (docs_a[:, None] != docs_b[None] if key is None else docs_a[:, None] < docs_b[None])
    if anchors[0][5] is not None:
        fit &= column(anchors, 5)[:, None] != column(others, 5)[None]
    x, y = np.nonzero(fit)
    count = np.bitwise_count(bits_a[x] ^ bits_b[y]).sum(1, dtype=np.int64)
    least = small[x, y]
    keep = count <= limit(least, percent)
    x, y, count, least = x[keep], y[keep], count[keep], least[keep]
    if key is not None and len(x):
        bands_a, bands_b = (np.array([r[7] for r in rows], np.int64) for rows in (anchors, others))
        first = (bands_a[x] == bands_b[y]).argmax(1)
        mine = bands_a[x, first] == key
        x, y, count, least = x[mine], y[mine], count[mine], least[mine]
    return x, y, (count <= limit(least, PERCENT)) & (100 * least >= PERCENT * large[x, y])


def _linked(a: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which sets link to ``a``."""
    sizes = np.array([len(h) for h in sets])
    every = np.concatenate(sets)
    at = np.minimum(np.searchsorted(a, every), len(a) - 1)
    common = np.add.reduceat((a[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * common >= PERCENT * (len(a) + sizes - common)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tasks(tasks: DataFrame, run, result: str, *more: str) -> DataFrame:
    """Run over task rows, by (key, part), anchors first."""
    return tasks.select("key", "part", "anchor", "doc", *more).repartition("key", "part") \
        .sortWithinPartitions("key", "part", F.desc("anchor"), "doc").mapInArrow(run, result)


def near_pivots(tasks: DataFrame) -> DataFrame:
    """Pairs ``a, b, near`` of an anchor, the pivot, and the others of its tasks that may be similar by
    ``NEAR_PERCENT``; ``near``: by the threshold."""
    schema = pa.schema([*_PAIR, ("near", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, others in _blocks(batches, 7, 4096):
            x, y, near = _near(anchors, others, NEAR_PERCENT, None)
            if len(x):
                yield batch(schema, {"a": [anchors[k][3] for k in x], "b": [others[k][3] for k in y], "near": near})
        give_back()

    return _tasks(tasks.withColumn("component", F.lit(None).cast("long")), run, "a long, b long, near boolean", "n", "component", "sketch")


def with_partners(tasks: DataFrame) -> DataFrame:
    """Rows ``key, doc`` of lists: documents that have a partner of another component whose sketch is
    near.  One or two rows for a block of comparisons and document, whatever the number of partners."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, others in _blocks(batches, 8, 64):
            x, y, near = _near(anchors, others, PERCENT, anchors[0][0])
            docs = sorted({anchors[k][3] for k in x[near]} | {others[k][3] for k in y[near]})
            if docs:
                yield batch(schema, {"key": [anchors[0][0]] * len(docs), "doc": docs})
        give_back()

    return _tasks(tasks, run, "key long, doc long", "n", "component", "sketch", "bands").distinct()


def links_in_lists(tasks: DataFrame, once: bool) -> DataFrame:
    """Links ``a, b`` between the anchors and the others of a task, of different components: sketches
    that are near are confirmed on the full sets at once, so only links become rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, others in _blocks(batches, 9, 64):
            x, y, near = _near(anchors, others, PERCENT, anchors[0][0] if once else None)
            x, y = x[near], y[near]
            sets = [np.frombuffer(r[8], np.uint64) for r in others]
            for k in np.unique(x):
                mine = y[x == k]
                found = mine[_linked(np.frombuffer(anchors[k][8], np.uint64), [sets[j] for j in mine])]
                if len(found):
                    yield batch(_PAIR, {"a": [anchors[k][3]] * len(found), "b": [others[j][3] for j in found]})
        give_back()

    return _tasks(tasks, run, "a long, b long", "n", "component", "sketch", "bands", "hashes")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc, hashes`` of the documents ``doc_id`` of ids, written to the shared folder.  The ids may
    be many: the join is a shuffle at every size."""
    schema = pa.schema([("doc", pa.int64()), ("hashes", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            sets = zip(part.column(0).to_pylist(), (shingle_set(t) for t in part.column(1).to_pylist()), strict=True)
            sets = [(i, s.tobytes()) for i, s in sets if len(s)]
            if sets:
                yield batch(schema, dict(zip(schema.names, zip(*sets), strict=True)))
        give_back()

    return materialize(text_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
                       .join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(cut, "doc long, hashes binary"))


def confirm(pairs: DataFrame, sets: DataFrame, part_docs: int) -> DataFrame:
    """The pairs ``a, b`` that link, by their full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, others in _blocks(batches, 5, 256):
            hashes = [np.frombuffer(r[4], np.uint64) for r in others]
            for row in anchors:
                found = np.flatnonzero(_linked(np.frombuffer(row[4], np.uint64), hashes))
                if len(found):
                    yield batch(_PAIR, {"a": [row[3]] * len(found), "b": [others[k][3] for k in found]})
        give_back()

    return materialize(_tasks(_stars(pairs.select("a", "b"), part_docs).join(sets, "doc"), run, "a long, b long", "hashes")
                       .where("a <> b").distinct())


def _stars(pairs: DataFrame, part_docs: int) -> DataFrame:
    """Task rows ``key, part, anchor, doc``: every a with its bs, in parts of bounded size."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / part_docs).cast("int").alias("parts"))
    others = pairs.join(sizes, "a").select(F.col("a").alias("key"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"),
                                           F.lit(False).alias("anchor"), F.col("b").alias("doc"))
    return others.unionByName(sizes.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                           F.lit(True).alias("anchor"), F.col("a").alias("doc")))


def _grid(anchors: DataFrame, others: DataFrame, block_docs: int) -> DataFrame:
    """Task rows: the anchors ``key, doc`` of a key in blocks, and all others of the key for each block."""
    sizes = anchors.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_docs).cast("int").alias("parts"))
    return anchors.join(sizes, "key").select("key", F.pmod(F.xxhash64("doc"), "parts").cast("int").alias("part"),
                                             F.lit(True).alias("anchor"), "doc").unionByName(
        others.join(sizes, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                         F.lit(False).alias("anchor"), "doc"))


def near_duplicates(docs: DataFrame, part_docs: int = 2048, block_docs: int = 512) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    made = materialize(sketch_documents(docs))
    whole = made.where("digest is not null")
    first = whole.groupBy("n", "digest").agg(F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    first = materialize(first)
    copies = whole.select("doc_id", "n", "digest").join(first.select("n", "digest", "doc"), ["n", "digest"]) \
        .where("doc_id <> doc").select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))
    sketches = first.select("doc", "n", "sketch")
    # a. buckets and their pivots
    entries = first.select("doc", F.explode("bands").alias("h"))
    buckets = entries.groupBy("h").agg(F.min("doc").alias("pivot"), F.max("doc").alias("last")).where("pivot <> last")
    members = materialize(entries.join(buckets.select("h", "pivot"), "h").where("doc <> pivot").distinct())
    pairs = members.select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    tested = materialize(near_pivots(_stars(pairs, part_docs).join(sketches, "doc")).groupBy("a", "b").agg(F.max("near").alias("near")))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = full_sets(docs, ids)
    star = confirm(tested.where("near"), sets, part_docs)
    roots = connected_components(star)
    label = materialize(first.join(roots.select(F.col("node").alias("doc"), "component"), "doc", "left")
                        .select("doc", "n", F.coalesce("component", "doc").alias("component"), "sketch", "bands"))
    of = label.select("doc", "component")
    # b. near a pivot, not connected with it: against the pivot's star
    apart = tested.join(star, ["a", "b"], "left_anti").join(of.select(F.col("doc").alias("a"), F.col("component").alias("of_a")), "a") \
        .join(of.select(F.col("doc").alias("b"), F.col("component").alias("of_b")), "b").where("of_a <> of_b")
    comers = apart.select(F.col("a").alias("key"), F.col("b").alias("doc"))
    partners = star.select(F.col("a").alias("key"), F.col("b").alias("doc"))
    rest = _grid(comers.join(partners.select("key").distinct(), "key", "left_semi"), partners, block_docs)
    late = links_in_lists(rest.join(label, "doc").join(sets, "doc"), False)
    # c. what no pivot links to, in lists of several components; first only who has a partner at all
    left = members.join(star.select(F.col("a").alias("pivot"), F.col("b").alias("doc")), ["pivot", "doc"], "left_anti") \
        .select(F.col("h").alias("key"), "doc")
    mixed = left.join(of, "doc").groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    left = left.join(mixed.select("key"), "key", "left_semi")
    left = materialize(with_partners(_grid(left, left, block_docs).join(label, "doc")))
    late = materialize(late.unionByName(links_in_lists(_grid(left, left, block_docs).join(label, "doc").join(sets, "doc"), True)).distinct())
    links = roots.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")) \
        .unionByName(late).unionByName(copies)
    components = connected_components(links).withColumnRenamed("node", "doc_id")
    return made.join(components, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component", "doc_id")).alias("kept"))
