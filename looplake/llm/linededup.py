"""Line deduplication by levelled sorted runs of line hashes (native: DataFrame functions only).

The lines of the corpus are keyed by the line with ASCII white space stripped at both ends and
A-Z in lower case.  Documents arrive in batches from the largest ``doc_id`` down.  A batch's
keys are aggregated to (hash, documents, largest doc_id) and merged against the runs of the
batches before it: keys the runs do not have (the anti join) are new lines and form a run of
their own with their holder, keys they have (the semi join) only add to the number of documents.
Runs are written sorted by hash to the shared folder; after every ``fan_in`` runs of a level they
are compacted into one run of the next level.  At the end the levels are merged once more, and the lines of keys in at least
``min_docs`` documents are dropped from every document but the key's holder, the largest doc_id.

Hot lines never meet in one task: every count is a hash aggregation with partial sums, and only
(hash, count, max) rows are shuffled.  Two 64-bit hashes identify a key.

Defined cases: null or empty text is one empty line; keys shorter than ``min_chars`` are never
dropped; rows that repeat a doc_id count as one document, but each row loses the lines of its own
text only; a document with null doc_id keeps all its lines and is not counted; extra columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from looplake.llm.common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def _row() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line whose key is long enough; ``row`` tells the texts of an id apart."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    keyed = docs.where("doc_id is not null").select("doc_id", _row().alias("row"), F.posexplode(lines).alias("pos", "line")) \
        .select("doc_id", "row", "pos", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= min_chars)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"))


def _merge(runs: list[DataFrame]) -> DataFrame:
    """Compaction: one run from several, counts added, the largest holder kept."""
    rows = reduce(DataFrame.unionByName, runs)
    return rows.groupBy(*_HASH).agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))


def build_runs(lines: DataFrame, batches: int, fan_in: int) -> list[DataFrame]:
    """Feed the batches, largest doc_id first, through the levels; returns the runs that are left."""
    edges = lines.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if edges["lo"] is None:
        return []
    step = max(1, -(-(edges["hi"] - edges["lo"] + 1) // batches))
    levels: list[list[DataFrame]] = [[]]
    for b in range(batches):
        top = edges["hi"] - b * step
        if top < edges["lo"]:
            break
        fresh = lines.where((F.col("doc_id") <= top) & (F.col("doc_id") > top - step)) \
            .select(*_HASH, "doc_id").distinct().groupBy(*_HASH) \
            .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder"))
        seen = [r for level in levels for r in level]
        if seen:
            known = reduce(DataFrame.unionByName, [r.select(*_HASH) for r in seen])
            new = fresh.join(known, _HASH, "left_anti")
            # a key that a run has keeps its holder there: this batch only adds documents
            more = fresh.join(known, _HASH, "left_semi").withColumn("holder", F.lit(None).cast("long"))
            fresh = new.unionByName(more)
        levels[0].append(_write_run(fresh))
        for k in range(len(levels)):
            if len(levels[k]) >= fan_in:
                if k + 1 == len(levels):
                    levels.append([])
                levels[k + 1].append(_write_run(_merge(levels[k])))
                levels[k] = []
    return [r for level in levels for r in level]


def _write_run(df: DataFrame) -> DataFrame:
    return materialize(df.sortWithinPartitions(*_HASH))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4,
                fan_in: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``doc_id, n_lines, n_dropped, kept_text``, and ``carried``, a struct of the
    columns named in ``carry``."""
    more = [F.struct(*(F.col(c) for c in carry)).alias("carried")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    carried = ["carried"] if carry else []
    lines = materialize(_lines(docs, min_chars))
    runs = build_runs(lines, batches, fan_in)
    whole = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    if not runs:
        return docs.select("doc_id", F.size(whole).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"),
                           F.coalesce("text", F.lit("")).alias("kept_text"), *carried)
    common = _merge(runs).where(F.col("n") >= min_docs).select(*_HASH, "holder")
    drops = lines.join(common, _HASH).where(F.col("doc_id") != F.col("holder")) \
        .groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drops"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col("drops")),
                       lambda i: F.get(F.col("lines"), i))
    return docs.withColumn("row", _row()).join(drops, ["doc_id", "row"], "left").withColumn("lines", whole).select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
        .alias("kept_text"), *carried)
