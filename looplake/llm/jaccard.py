"""N-gram Jaccard join: near-duplicate documents by a grouped prefix join.

A document's set are the hashes of its distinct five-word shingles (64 bits).  Two documents link
when 100 |x & y| >= 75 |x | y|; the result are the connected components of these links.

1. ``shared_shingles``: tasks cut their documents into sets, keep one of the documents with equal
   sets, and send the hashes, one entry for each hash of a batch of documents, to hash buckets.
   A bucket tells which hashes are in several documents.  A document can only link if at least
   75 % of its hashes are; all others are done.  The entries travel as sorted, compressed arrays.
2. Documents with equal sets are collapsed.  The hashes are put into one order for all documents:
   unshared ones first, then by hash, the most frequent ones (a list of bounded size) last.  The
   prefix of a set of n are its first n - ceil(0.75 n) + 1 hashes: linked sets share one there.
3. Documents with the same prefix and size form a group; prefixes are indexed by group.
   a. In each index list one document, the pivot, is compared with the members of all groups.
   b. Documents that do not link to their pivot are compared with the rest of its star.
   c. Documents left in a list are paired with each other unless they are connected by now.
   Any linked pair is connected by one of the three: both link to the pivot, one does (b), or
   none does (c).  So no link between components is lost.  Step c does expand what is left of a
   list to its unconnected pairs of similar size, which grows with the square of that rest.
4. Components of all verified links.

Defined cases: a document without words has an empty set and no link; with fewer than five words
its whole sequence is the only shingle; rows that repeat a doc_id are one document with the union
of their sets; rows with null doc_id keep their size, link with nothing and have no component;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from looplake.llm.common import batch, give_back, lower_words, materialize, text_batches
from looplake.llm.components import connected_components

WIDTH, PERCENT = 5, 75
#: 1 - 2 (1 - 0.75): who is less similar to a pivot links to none of the pivot's partners.
NEAR_PERCENT = 2 * PERCENT - 100
#: Odd multipliers for the places of a shingle.
_PLACE = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
                                 0x27D4EB2F165667C5)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = lower_words(text)
    n = len(words) - WIDTH + 1
    if n <= 0:
        return np.array([xxh64_intdigest(b" ".join(words), 1)] if words else [], dtype=np.uint64)
    hashed = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    total = hashed[:n] * _PLACE[0]
    for k in range(1, WIDTH):
        total += hashed[k:n + k] * _PLACE[k]
    total = _mix(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def required(n: int) -> int:
    """Least overlap of a set of n with any set that it links to."""
    return -(-PERCENT * n // 100)


def linked(n: int, m: int, overlap: int) -> bool:
    return 100 * overlap >= PERCENT * (n + m - overlap)


def pack(values: np.ndarray) -> bytes:
    """An array by byte planes, compressed: the leading bytes of sorted values nearly vanish."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes | None, dtype) -> np.ndarray:
    if not data:
        return np.empty(0, dtype=dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def _home(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group in which a document's hashes meet again."""
    return (_mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int32)


ENTRIES = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()),
                     ("reps", pa.binary()), ("sizes", pa.binary()), ("null_sizes", pa.binary())])
ENTRIES_DDL = "bucket int, home int, hashes binary, docs binary, reps binary, sizes binary, null_sizes binary"
#: A row has entries for a bucket (home null), shared hashes for a home, or sizes (and reps) for a home.
_NO_DOC = -(1 << 63)


def _entry_rows(docs: list, sets: list, null_sizes: list, groups: int) -> list[dict]:
    """The rows of one batch of documents."""
    rows: list[dict] = []
    if null_sizes:
        rows.append({"bucket": len(null_sizes) % groups, "home": 0, "null_sizes": pack(np.array(null_sizes, np.int64))})
    if not docs:
        return rows
    ids, first, own = np.array(docs, np.int64), {}, []
    reps = np.empty(len(docs), np.int64)
    for k, s in enumerate(sets):  # documents with equal sets: only one sends its hashes
        key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else k
        if first.setdefault(key, k) == k:
            own.append(k)
        reps[k] = docs[first[key]]
    home = _home(ids, groups)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(groups + 1))
    n = np.array([len(s) for s in sets], np.int64)
    for h in np.unique(home):
        part = order[cuts[h]:cuts[h + 1]]
        rows.append({"bucket": int(h), "home": int(h), "docs": pack(ids[part]), "reps": pack(reps[part]), "sizes": pack(n[part])})
    hashes = np.concatenate([sets[k] for k in own])
    owner = np.repeat(ids[own], [len(sets[k]) for k in own])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.empty(0, bool)
    several = ~fresh | np.concatenate([~fresh[1:], [False]]) if len(hashes) else fresh
    # a hash that the batch has twice is known to be shared: its documents learn it without the bucket,
    # and the bucket gets it once, without a document
    known, docs_of = hashes[several], owner[several]
    at = _home(docs_of, groups)
    order = np.lexsort((known, at))
    known, docs_of, at = known[order], docs_of[order], at[order]
    cuts = np.searchsorted(at, np.arange(groups + 1))
    for h in np.unique(at):
        a, b = cuts[h], cuts[h + 1]
        rows.append({"bucket": int(h), "home": int(h), "hashes": pack(known[a:b]), "docs": pack(docs_of[a:b])})
    hashes, owner = hashes[fresh], np.where(several, _NO_DOC, owner)[fresh]
    bucket = ((hashes >> np.uint64(40)) % np.uint64(groups)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")  # hashes stay sorted inside a bucket
    hashes, owner, bucket = hashes[order], owner[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(groups + 1))
    for h in np.unique(bucket):
        a, b = cuts[h], cuts[h + 1]
        rows.append({"bucket": int(h), "home": None, "hashes": pack(hashes[a:b]), "docs": pack(owner[a:b])})
    return rows


def _cut(docs: DataFrame, groups: int, batch_shingles: int) -> DataFrame:
    """Step 1, first half: the sets of all documents as rows of ``ENTRIES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        nulls: list[int] = []
        held = 0

        def flush():
            rows = _entry_rows(list(sets), list(sets.values()), nulls, groups)
            return batch(ENTRIES, {n: [r.get(n) for r in rows] for n in ENTRIES.names})

        for part in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                s = shingle_set(text)
                if doc_id is None:
                    nulls.append(len(s))
                    continue
                sets[doc_id] = np.union1d(sets[doc_id], s) if doc_id in sets else s
                held += len(s)
                if held >= batch_shingles:
                    yield flush()
                    sets, nulls, held = {}, [], 0
        if sets or nulls:
            yield flush()
        sets.clear()
        give_back()

    return text_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ENTRIES_DDL)


def _tell_shared(groups: int):
    """Step 1, second half, for one bucket: hashes of several documents go to the documents' homes."""

    def run(rows: pa.Table) -> pa.Table:
        out: list[dict] = []
        hashes, docs = [], []
        for r in rows.to_pylist():
            if r["home"] is None:
                hashes.append(unpack(r["hashes"], np.uint64))
                docs.append(unpack(r["docs"], np.int64))
            else:
                out.append(r)
        if hashes:
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            same = h[1:] == h[:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            keep = shared & (d != _NO_DOC)
            h, d = h[keep], d[keep]
            at = _home(d, groups)
            order = np.lexsort((h, at))
            h, d, at = h[order], d[order], at[order]
            cuts = np.searchsorted(at, np.arange(groups + 1))
            for k in np.unique(at):
                out.append({"home": int(k), "hashes": pack(h[cuts[k]:cuts[k + 1]]), "docs": pack(d[cuts[k]:cuts[k + 1]])})
        return pa.Table.from_batches([batch(_HOMES, {n: [r.get(n) for r in out] for n in _HOMES.names})])

    return run


_HOMES = pa.schema([f for f in ENTRIES if f.name != "bucket"])
SETS = pa.schema([("doc_id", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("signature", pa.binary()),
                  ("shared", pa.list_(pa.int64()))])


def _gather(rows: pa.Table) -> pa.Table:
    """Documents of one home: size, and for those that may link the shared hashes, sorted."""
    sized, nulls, hashes, docs = [], [], [], []
    for r in rows.to_pylist():
        if r["sizes"]:
            sized.append(tuple(unpack(r[c], np.int64) for c in ("docs", "reps", "sizes")))
        elif r["null_sizes"]:
            nulls.append(unpack(r["null_sizes"], np.int64))
        elif r["hashes"]:
            hashes.append(unpack(r["hashes"], np.uint64))
            docs.append(unpack(r["docs"], np.int64))
    out = {n: [] for n in SETS.names}

    def put(*values):
        for n, v in zip(SETS.names, values, strict=True):
            out[n].append(v)

    for n in nulls:
        for v in n.tolist():
            put(None, None, v, None, None)
    if sized:
        ids, reps, n = (np.concatenate(x) for x in zip(*sized))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        d = np.concatenate(docs) if docs else np.empty(0, np.int64)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        again = np.concatenate([[False], (d[1:] == d[:-1]) & (h[1:] == h[:-1])]) if len(d) else np.empty(0, bool)
        order = np.argsort(ids, kind="stable")
        ids, reps, n = ids[order], reps[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
            doc = ids[a]
            lo, hi = np.searchsorted(d, doc, "left"), np.searchsorted(d, doc, "right")
            mine = h[lo:hi][~again[lo:hi]]
            own = reps[a:b] == doc
            rep = int(doc) if own.any() else int(reps[a])
            # an id that several tasks have seen: the union of its sets
            size = int(n[a:b][own].sum()) - int(again[lo:hi].sum()) if own.any() else int(n[a])
            may = rep == doc and size > 0 and len(mine) >= required(size)
            whole = hashlib.blake2b(mine.tobytes(), digest_size=16).digest() if may and len(mine) == size else None
            put(int(doc), rep, size, whole, mine.view(np.int64) if may else None)
    return pa.Table.from_batches([batch(SETS, out)])


def shared_shingles(docs: DataFrame, groups: int | None = None, batch_shingles: int = 1_000_000) -> DataFrame:
    """Step 1: ``doc_id, rep, n, signature, shared``; ``rep`` is a document with an equal set (or
    itself), ``shared`` the hashes that other documents have too, null if the document cannot link."""
    if groups is None:  # by the size of the input, so that a bucket holds about a million hashes
        chars = docs.agg(F.sum(F.char_length("text").cast("long"))).first()[0] or 0
        groups = max(64, 1 << max(0, (chars // 6_000_000)).bit_length())
    entries = _cut(docs, groups, batch_shingles)
    homes = entries.groupBy("bucket").applyInArrow(_tell_shared(groups), ENTRIES_DDL.removeprefix("bucket int, "))
    return homes.groupBy("home").applyInArrow(_gather, "doc_id long, rep long, n long, signature binary, shared array<long>")


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column without null elements, as arrays."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield values[a:b]


def _prefixes(sets: DataFrame, heavy) -> DataFrame:
    """Step 2: prefix (hashes in the common order) and group key of every set."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("prefix", pa.list_(pa.int64())),
                        ("prefix_key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = heavy.value
        for b in batches:
            out = {n: [] for n in schema.names}
            for doc, n, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _lists(b.column(2)), strict=True):
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, weight[at], 0)
                length = n - required(n) + 1 - (n - len(h))  # unshared hashes come first and match nothing
                prefix = h[np.lexsort((h, rank))][:length]
                for c, v in zip(schema.names, (doc, n, len(h), prefix, hashlib.blake2b(prefix.tobytes(), digest_size=16).digest()),
                                strict=True):
                    out[c].append(v)
            yield batch(schema, out)

    return sets.select("doc_id", "n", "shared").mapInArrow(run, "doc long, n long, m long, prefix array<long>, prefix_key binary")


def _overlaps(anchors: list, others: list, least: int) -> Iterator[tuple[int, int, bool]]:
    """(anchor, other, linked) of sets of sorted hashes, given as (id, n, hashes), with a similarity
    of at least ``least`` per cent."""
    hashes = np.concatenate([o[2] for o in others])
    owner = np.repeat(np.arange(len(others)), [len(o[2]) for o in others])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    sizes = np.array([o[1] for o in others])
    for a, n, mine in anchors:
        lo, hi = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        common = np.bincount(owner[at], minlength=len(others))
        union = n + sizes - common
        for k in np.flatnonzero(100 * common >= least * union):
            if others[k][0] != a:
                yield a, others[k][0], bool(100 * common[k] >= PERCENT * union[k])


def compare(tasks: DataFrame, least: int = PERCENT, block: int = 256) -> DataFrame:
    """Pairs ``a, b, linked`` of at least ``least`` per cent similarity from rows ``key, part, anchor,
    doc, n, shared``: inside a (key, part) every anchor row is compared with every other row.  Rows
    are streamed in sorted order, anchors first; callers bound the anchors of a part."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in range(5)), _lists(b.column(5)), strict=True)

        found: list = []
        for _, group in groupby(flat(), key=lambda r: r[:2]):
            anchors, others = [], []
            for _, _, anchor, doc, n, shared in group:
                (anchors if anchor else others).append((doc, n, shared))
                if len(others) >= block:
                    found.extend(_overlaps(anchors, others, least))
                    others = []
            if anchors and others:
                found.extend(_overlaps(anchors, others, least))
            if len(found) >= 10_000:
                yield batch(schema, dict(zip(schema.names, zip(*found), strict=True)))
                found = []
        if found:
            yield batch(schema, dict(zip(schema.names, zip(*found), strict=True)))
        give_back()

    return tasks.select("key", "part", "anchor", "doc", "n", "shared").repartition("key", "part") \
        .sortWithinPartitions("key", "part", F.desc("anchor"), "doc").mapInArrow(run, "a long, b long, linked boolean")


def _star_tasks(pairs: DataFrame, sets: DataFrame, part_docs: int) -> DataFrame:
    """Comparison rows for pairs (a, b): b goes to a's parts, a to each of them as their anchor."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / part_docs).cast("int").alias("parts"))
    split = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = split.select(F.col("a").alias("key"), "part", F.lit(False).alias("anchor"), F.col("b").alias("doc"))
    anchors = parts.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                           F.lit(True).alias("anchor"), F.col("a").alias("doc"))
    return members.unionByName(anchors).join(sets.select(F.col("doc_id").alias("doc"), "n", "shared"), "doc")


def near_duplicates(docs: DataFrame, heavy_hashes: int = 200_000, heavy_from: int = 16, part_docs: int = 2048,
                    block_docs: int = 256) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    spark = docs.sparkSession
    sets = materialize(shared_shingles(docs))
    # step 2: equal sets
    whole = sets.where("signature is not null")
    same = whole.groupBy("n", "signature").agg(F.min("doc_id").alias("first"))
    copies = whole.join(same, ["n", "signature"]).where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    links = [sets.where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), copies]
    alone = materialize(sets.where("shared is not null").join(copies.select(F.col("b").alias("doc_id")), "doc_id", "left_anti")
                        .select("doc_id", "n", "shared"))
    # the most frequent hashes; the list only sets the order, so its bound loses nothing
    top = alone.select(F.explode("shared").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")) \
        .where(F.col("df") >= heavy_from).orderBy(F.desc("df"), "h").limit(heavy_hashes).toPandas().sort_values("h")
    heavy = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64), top["df"].to_numpy(np.int64)))
    prefixes = materialize(_prefixes(alone, heavy))
    # step 3: groups, their index, pivots
    key = ["n", "prefix_key"]
    groups = prefixes.groupBy(*key).agg(F.max_by("doc", F.struct("m", F.col("doc"))).alias("head"), F.max("m").alias("m"))
    members = prefixes.join(groups.select(*key, "head"), key).select("doc", "n", "head", "prefix")
    index = members.where("doc = head").select("head", "n", F.explode("prefix").alias("h")).join(
        groups.select("head", "m"), "head")
    pivots = index.groupBy("h").agg(F.max_by(F.struct("head", "n"), F.struct(2 * F.col("m") - F.col("n"), "head")).alias("p"),
                                    F.count(F.lit(1)).alias("size"))
    # group pairs (pivot, head), by size at least as similar as b. asks for; a group is also compared
    # with its own members
    near = index.join(pivots.where("size > 1"), "h").where("head <> p.head").where(
        F.least("n", F.col("p.n")) * 100 >= NEAR_PERCENT * F.greatest("n", F.col("p.n")))
    group_pairs = near.select(F.col("p.head").alias("a"), "head").distinct().unionByName(
        groups.select(F.col("head").alias("a"), "head"))
    pairs = group_pairs.join(members.select(F.col("doc").alias("b"), "head"), "head").where("a <> b").select("a", "b").distinct()
    tested = materialize(compare(_star_tasks(pairs, alone, part_docs), least=NEAR_PERCENT))
    star = tested.where("linked").select("a", "b")
    # b. members of a list that its pivot does not link to, against the rest of the pivot's star.  The
    # Jaccard distance is a metric: who is over 0.5 from the pivot is over 0.25 from its star
    lists = materialize(members.select("doc", "n", F.slice(F.array_sort("prefix"), 1, 8).alias("low"), F.explode("prefix").alias("h")).join(
        pivots.select("h", F.col("p.head").alias("pivot")), "h").where("doc <> pivot")
        .join(star.select(F.col("a").alias("pivot"), F.col("b").alias("doc")), ["pivot", "doc"], "left_anti"))
    stars = star.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / block_docs).cast("int").alias("parts"))
    asked = tested.where("not linked").join(stars, "a")
    comers = asked.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                          F.lit(False).alias("anchor"), F.col("b").alias("doc"))
    rest = star.join(stars, "a").join(asked.select("a").distinct(), "a", "left_semi").select(
        F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"),
        F.lit(True).alias("anchor"), F.col("b").alias("doc"))
    tasks = rest.unionByName(comers).join(alone.select(F.col("doc_id").alias("doc"), "n", "shared"), "doc")
    links += [star, materialize(compare(tasks, block=block_docs)).select("a", "b")]
    found = connected_components(links[2].unionByName(links[3]))
    # c. what is left of a list: pairs that are not connected yet
    label = found.select(F.col("node").alias("doc"), "component")
    left = lists.join(label, "doc", "left").select("h", "doc", "n", "low", F.coalesce("component", "doc").alias("component"))
    x, y = left.alias("x"), left.alias("y")
    # a pair stands in many lists; where the eight smallest hashes of both prefixes meet, only the list
    # of the smallest common one makes it (if one of the two is not left there, a. or b. has done it)
    both_low = F.array_intersect("x.low", "y.low")
    apart = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.doc") < F.col("y.doc"))
                   & (F.col("x.component") != F.col("y.component"))
                   & (F.least("x.n", "y.n") * 100 >= PERCENT * F.greatest("x.n", "y.n"))
                   & ((F.size(both_low) == 0) | (F.array_min(both_low) == F.col("x.h")))) \
        .select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
    links.append(compare(_star_tasks(apart, alone, part_docs)).select("a", "b"))
    links[2:4] = [found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))]
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    components = connected_components(every).withColumnRenamed("node", "doc_id")
    return sets.join(components, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
