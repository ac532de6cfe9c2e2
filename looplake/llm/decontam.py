"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are far shorter than documents, so their similarity to a whole document says nothing;
what counts is containment, the share of an item's shingles that the document has.  The items
are partitioned by the size of their shingle sets (powers of two); each partition gets the
bottom-k MinHash sketch whose length fits its upper size u: k = u - ceil(t u) + 1.  A document
with at least the share t of an item's shingles misses at most size - ceil(t size) of them, so it
has one of the k smallest: the search finds every true pair.  Documents are read once, without a
shuffle: their shingles are looked up in the sketches, and candidates are verified by exact
containment with the whole shingle sets.

Items are worked off in blocks of ``block_items``, so that what is broadcast is bounded for any
benchmark; with several blocks the passes are chained.

Words are lower-cased (A-Z) runs without ASCII white space, shingles are five words; an item of
fewer words is one shingle of its whole sequence.  Defined cases: null or empty documents are
clean; null or empty items match nothing; items that repeat an id or a text are found each; a
null item_id counts but is not listed; repeated documents are judged each; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looplake.llm.common import batch, lower_words, text_batches

WIDTH = 5
_BITS = 20
#: Odd multipliers for the places of a shingle.
_PLACE = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5],
                  dtype=np.uint64)


def _scatter(x: np.ndarray) -> np.ndarray:
    """64-bit mixing of numbers, so that small ids spread over the whole range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, mixed: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` word numbers."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    word = mixed[ids]
    total = word[:n] * _PLACE[0]
    for k in range(1, width):
        total += word[k:n + k] * _PLACE[k]
    return _scatter(total)


@dataclass
class Index:
    """Sketches of a block of items; ``sketch`` has, by shingle width, sorted hashes, the items they
    belong to, and a table of their leading bits."""

    vocab: dict[bytes, int]
    mixed: np.ndarray
    item_ids: list
    sets: list[np.ndarray]
    widths: list[int]
    sketch: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def sketch_length(size: int, percent: int) -> int:
    """k of the partition of a set: its upper size decides."""
    upper = (1 << size.bit_length()) - 1
    return upper - (-(-percent * upper // 100)) + 1


def build_index(items: list[tuple[int | None, str | None]], percent: int) -> Index:
    words = [(i, lower_words(t)) for i, t in items]
    words = [(i, w) for i, w in words if w]
    vocab: dict[bytes, int] = {}
    for _, w in words:
        for x in w:
            vocab.setdefault(x, len(vocab) + 1)
    mixed = _scatter(np.arange(len(vocab) + 1, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    index = Index(vocab, mixed, [i for i, _ in words], [], [], {})
    entries: dict[int, list] = {}
    for k, (_, w) in enumerate(words):
        width = min(WIDTH, len(w))
        hashes = np.unique(shingle_hashes(np.array([vocab[x] for x in w]), mixed, width))
        index.sets.append(hashes)
        index.widths.append(width)
        for h in hashes[:sketch_length(len(hashes), percent)]:
            entries.setdefault(width, []).append((h, k))
    for width, found in entries.items():
        found.sort(key=lambda x: int(x[0]))
        hashes = np.array([h for h, _ in found], dtype=np.uint64)
        bits = np.zeros(1 << _BITS, dtype=bool)
        bits[hashes >> np.uint64(64 - _BITS)] = True
        index.sketch[width] = (hashes, np.array([k for _, k in found]), bits)
    return index


def search(index: Index, text: str | None, percent: int) -> list[tuple[int, int]]:
    """(item number, contained shingles) of the items that the text contains."""
    words = lower_words(text)
    if not words:
        return []
    ids = np.fromiter(map(index.vocab.get, words, repeat(0)), dtype=np.int64, count=len(words))
    unknown = np.concatenate([[0], np.cumsum(ids == 0)])
    out = []
    for width, (hashes, owner, bits) in index.sketch.items():
        known = unknown[width:] == unknown[:-width] if len(ids) >= width else np.empty(0, bool)
        if not known.any():
            continue
        have = shingle_hashes(ids, index.mixed, width)[known]
        hit = have[bits[have >> np.uint64(64 - _BITS)]]
        if not len(hit):
            continue
        hit = np.unique(hit)
        lo, hi = np.searchsorted(hashes, hit, "left"), np.searchsorted(hashes, hit, "right")
        items = {int(owner[j]) for a, b in zip(lo, hi, strict=True) for j in range(a, b)}
        if not items:
            continue
        have = np.unique(have)
        for k in sorted(items):
            want = index.sets[k]
            at = np.minimum(np.searchsorted(have, want), len(have) - 1)
            n = int((have[at] == want).sum())
            if 100 * n >= percent * len(want):
                out.append((k, n))
    return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("n_items", pa.int64()),
                    ("item_ids", pa.list_(pa.int64())), ("max_containment", pa.float64())])
DDL = "doc_id long, text string, n_items long, item_ids array<long>, max_containment double"


def item_blocks(items: DataFrame, percent: int, block_items: int) -> Iterator:
    """Broadcast indexes of blocks of about ``block_items`` items: bounded, whatever the benchmark."""
    items = items.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("text is not null")
    blocks = max(1, -(-items.count() // block_items))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = build_index([(r["item_id"], r["text"]) for r in part.collect()], percent)
        yield items.sparkSession.sparkContext.broadcast(index)


def find_items(docs: DataFrame, items: DataFrame, percent: int = 75, block_items: int = 20_000) -> DataFrame:
    """Every document with the test items it contains: ``doc_id, n_items, item_ids, max_containment``
    and ``contaminated``."""
    rows = text_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "0L n_items",
                           "cast(array() as array<long>) item_ids", "0D max_containment")
    for shared in item_blocks(items, percent, block_items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                counts, lists, best = (b.column(n).to_pylist() for n in ("n_items", "item_ids", "max_containment"))
                for i, text in enumerate(b.column("text").to_pylist()):
                    for k, n in search(index, text, percent):
                        counts[i] += 1
                        best[i] = max(best[i], n / len(index.sets[k]))
                        if index.item_ids[k] is not None:
                            lists[i] = sorted([*lists[i], index.item_ids[k]])
                yield batch(SCHEMA, {"doc_id": b.column("doc_id"), "text": b.column("text").cast(pa.large_string()),
                                     "n_items": counts, "item_ids": lists, "max_containment": best})

        rows = rows.mapInArrow(run, DDL)
    return rows.select("doc_id", "n_items", "item_ids", "max_containment", (F.col("n_items") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = 75, block_items: int = 20_000) -> DataFrame:
    """The documents, in their own columns, that contain no test item."""
    at = docs.columns.index("text")
    for shared in item_blocks(items, percent, block_items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not search(shared.value, t, percent) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = text_batches(docs).mapInArrow(run, docs.schema)
    return docs
