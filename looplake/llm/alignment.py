"""Cross-tokenizer alignment: which tokens of one tokenizer share bytes with which of another.

Tokenizer A is a byte-level vocabulary (JSON file), B a piece model with byte fallback.  Both cut the
same bytes, a blank and the text.  Where tokens of A and of B end at the same byte a group of tokens
ends; all A-B pairs of tokens in a group are linked.

1. Tasks take their documents in chunks of bounded text and work on Arrow columns: token lists are
   flattened with their parent indices; token lengths are summed up by segments to byte ends; a hash
   join of the two tables on the key (document, end) finds the common ends; running counts of these
   number the groups; a hash join on the group makes the links, counted by ``Table.group_by`` for
   each document and then for the chunk.  A chunk becomes one row: its documents' figures, its
   distinct links, and, packed, which document has which of them how often.
2. Spark merges the chunks' partial counts: documents by id pair, and the highest count of an A id.
3. Every chunk gets the counts of its own distinct links back and adds them up for its documents.

Only chunk rows and counts are shuffled, no texts; chunks are written to the shared folder, so no
text is cut twice.  Large groups are counted by distinct ids before they are joined, so the rows of a
join stay bounded by the vocabularies where a group is long.

Defined cases: null and empty texts, and texts whose joined tokens are not a blank and the text (a
marker character in the text, for instance), have no tokens: figures of zero, an empty digest; the
strings of special tokens are ordinary text; rows that repeat a doc_id, or have none, are documents
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looplake.llm.common import batch, give_back, materialize, text_batches
from looplake.llm.jaccard import pack, unpack

MARK = "▁"
#: Fixed value: the pattern by which byte-level vocabularies of this kind cut texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank at a text's end or beside another white space character, or a marker.
CLOSE_BLANKS = r"^ | $|[\t-\r\x{85}\p{Z}] | [\t-\r\x{85}\p{Z}]|" + MARK
#: Documents are joined in slices of about so many tokens, so that a join's table stays in the cache.
SLICE_TOKENS = 100_000
#: Groups with more links than this are counted by distinct ids first.
LARGE_GROUP = 256
_A_SHIFT = 32


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokenizer:
    """Tokenizer A from its JSON text."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        made = json.loads(definition)
        letters, special = byte_letters(), {t["id"] for t in made["added_tokens"]}
        vocabulary = made["model"]["vocab"]
        self.tokens = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for word, i in vocabulary.items():
            if i not in special:
                self.tokens[i] = bytes(map(letters.__getitem__, word))
        # ids in the order of merges, and words cut by the known pattern: the faster library gives the same
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in made["model"]["merges"]]
        cutter = made.get("pre_tokenizer") or {}
        self.ranks = None
        if (made.get("normalizer") is None and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space")
                and cutter.get("use_regex", True) and not made["model"].get("ignore_merges")
                and all(vocabulary.get(m) == 256 + k for k, m in enumerate(merges))):
            import tiktoken

            self.ranks = tiktoken.Encoding("ranks", pat_str=WORDS, special_tokens={}, mergeable_ranks={
                t: i for i, t in enumerate(self.tokens) if t})

        self.by_words = self.ranks is not None
        self.lengths = np.array([len(t) for t in self.tokens])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of a blank and each text."""
        texts = [" " + t for t in texts]
        if self.ranks is None:
            return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.ranks.encode_to_numpy(t, disallowed_special=()) for t in texts]

    def encode_words(self, words: list[str]) -> pa.ListArray:
        """The same for words: one text of all of them, cut at their ends."""
        joined = "".join([" " + w for w in words])
        ids = self.ranks.encode_to_numpy(joined, disallowed_special=()).astype(np.int32)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends, "left") + 1
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]), pa.int32()), pa.array(ids))


class PieceTokenizer:
    """Tokenizer B from its model's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.tokens.append(bytes([int(piece[3:5], 16)]))
            else:
                self.tokens.append(b"" if self.library.is_control(i) or self.library.is_unknown(i)
                                   else piece.replace(MARK, " ").encode())
        # no piece goes on behind a blank, and the model adds just one in front
        self.by_words = not any(b" " in t.lstrip(b" ") for t in self.tokens) and all(
            self.library.encode(t) == self.library.encode(t.split(" ")[0]) + self.library.encode(t.split(" ")[1]) for t in ("a b", "\ufb01\n x"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def encode_words(self, words: list[str]) -> pa.ListArray:
        return _lists(self.encode(words))


#: Tokenizers that this Python worker has built, by their definitions' digest.
_BUILT: dict = {}


def _built(kind, definition):
    raw = definition.encode() if isinstance(definition, str) else definition
    key = kind.__name__, hashlib.sha256(raw).digest()
    if key not in _BUILT:
        made = kind(definition)
        _BUILT[key] = made, pa.array(made.tokens, pa.binary()), np.array([len(t) for t in made.tokens], np.int64)
    return _BUILT[key]


class Side:
    """The tokens of one tokenizer over some documents, as columns."""

    def __init__(self, lists: pa.ListArray, lengths: np.ndarray):
        self.ids = pc.list_flatten(lists)
        self.doc = pc.list_parent_indices(lists).cast(pa.int64())
        self.counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        # segmented running sum: the sum over all, less what stood at the document's begin
        run = pc.cumulative_sum(pa.array(lengths).take(self.ids)).to_numpy(zero_copy_only=False)
        starts = lists.offsets.to_numpy()[:-1]
        before = np.where(starts > 0, run[starts - 1] if len(run) else 0, 0)
        self.end = pa.array(run - np.repeat(before, self.counts))

    def keys(self) -> pa.Array:
        return pc.bit_wise_or(pc.shift_left(self.doc, 32), self.end)

    def group(self, ends: np.ndarray) -> np.ndarray:
        """Group number of every token: how many groups have ended before it."""
        flags = np.zeros(len(self.ids), np.int64)
        flags[ends] = 1
        return pc.cumulative_sum(pa.array(flags)).to_numpy(zero_copy_only=False) - flags


def _lists(parts: list) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    if parts and isinstance(parts[0], np.ndarray):
        flat = np.concatenate(parts).astype(np.int32)
    else:
        flat = np.fromiter(chain.from_iterable(parts), np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def encode_both(a: ByteTokenizer, b: PieceTokenizer, texts: pa.Array) -> list[pa.ListArray]:
    """Token ids of every text.  Both tokenizers cut at a blank that stands alone, so texts without
    other blanks take the ids of their words from the chunk's distinct words."""
    if not (a.by_words and b.by_words):
        return [_lists(t.encode(texts.to_pylist())) for t in (a, b)]
    close = pc.match_substring_regex(texts, CLOSE_BLANKS)
    plain = pc.invert(close)
    words = pc.split_pattern(texts.filter(plain), " ")
    flat = pc.list_flatten(words).dictionary_encode()
    distinct, rest = flat.dictionary.to_pylist(), texts.filter(close).to_pylist()
    mask = plain.to_numpy(zero_copy_only=False)
    place = pa.array(np.where(mask, np.cumsum(mask) - 1, len(words) + np.cumsum(~mask) - 1))
    out = []
    for tokenizer in (a, b):
        taken = tokenizer.encode_words(distinct).take(flat.indices)
        ends = taken.offsets.to_numpy()[words.offsets.to_numpy()]
        by_words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.values)
        out.append(pa.concat_arrays([by_words, _lists(tokenizer.encode(rest))]).take(place) if rest else by_words)
    return out


def _joined(lists: pa.ListArray, surfaces: pa.Array) -> tuple[bytes, np.ndarray]:
    """Bytes of all tokens, and where each document begins."""
    taken = surfaces.take(pc.list_flatten(lists))
    at = np.frombuffer(taken.buffers()[1], np.int32, count=len(taken) + 1) if len(taken) else np.zeros(1, np.int32)
    data = taken.buffers()[2]
    return data.to_pybytes()[:at[-1]] if data is not None else b"", at[lists.offsets.to_numpy()]


def sound(texts: list[str], a: pa.ListArray, b: pa.ListArray, surfaces_a: pa.Array, surfaces_b: pa.Array) -> np.ndarray:
    """Which documents' tokens join to a blank and the text, in both."""
    want = [b" " + t.encode() for t in texts]
    whole, ok = b"".join(want), np.ones(len(texts), bool)
    for lists, surfaces in ((a, surfaces_a), (b, surfaces_b)):
        data, at = _joined(lists, surfaces)
        if data != whole:
            ok &= [data[x:y] == w for x, y, w in zip(at[:-1], at[1:], want, strict=True)]
    return ok


def digests(a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray, n_groups: int) -> list[str]:
    """SHA-256 of the groups' ids as text, by document."""
    size_a, size_b = len(a.ids), len(b.ids)
    last_a = np.append(group_a[1:] != group_a[:-1], True) if size_a else np.zeros(0, bool)
    last_b = np.append(group_b[1:] != group_b[:-1], True) if size_b else np.zeros(0, bool)
    top = int(max(pc.max(a.ids).as_py() or 0, pc.max(b.ids).as_py() or 0)) + 1
    words = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(top)])
    end_a = np.cumsum(np.bincount(group_a, minlength=n_groups))
    begin_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n_groups))])
    line = np.empty(size_a + size_b, np.int64)
    line[np.arange(size_a) + begin_b[group_a]] = a.ids.to_numpy() + np.where(last_a, top, 0)
    line[np.arange(size_b) + end_a[group_b]] = b.ids.to_numpy() + np.where(last_b, 2 * top, 0)
    text = words.take(pa.array(line))
    at = np.frombuffer(text.buffers()[1], np.int32, count=len(text) + 1)
    data = memoryview(text.buffers()[2])
    ends = at[np.cumsum(a.counts + b.counts)].tolist()
    return [hashlib.sha256(data[x:y - 1]).hexdigest() for x, y in zip([0, *ends], ends, strict=False)]


def links_of(a: Side, b: Side, group_a: np.ndarray, group_b: np.ndarray, n_groups: int) -> pa.Table:
    """``doc, pair, n``: how often a document links an id pair.  A pair is its A id, shifted, and its B id."""
    size = np.bincount(group_a, minlength=n_groups) * np.bincount(group_b, minlength=n_groups)
    single = [size[group] == 1 for group in (group_a, group_b)]  # one token a side: the rows lie side by side
    parts = [pa.table({"doc": a.doc.filter(pa.array(single[0])), "pair": _pair(a.ids.filter(pa.array(single[0])), b.ids.filter(
        pa.array(single[1]))), "n": np.ones(int(single[0].sum()), np.int64)})]
    for large in (False, True):
        tables = []
        for side, group, alone in zip((a, b), (group_a, group_b), single, strict=True):
            mine = pa.array(~alone & ((size[group] > LARGE_GROUP) == large))
            one = pa.table({"group": pa.array(group).filter(mine), "id": side.ids.filter(mine), "doc": side.doc.filter(mine)})
            tables.append(one.group_by(one.column_names, use_threads=False).aggregate([([], "count_all")]) if large
                          else one.append_column("count_all", pa.array(np.ones(len(one), np.int64))))
        if len(tables[0]):
            both = tables[0].join(tables[1].drop_columns("doc").rename_columns(["group", "b", "m"]), "group", join_type="inner",
                                  use_threads=False)
            parts.append(pa.table({"doc": both["doc"], "pair": _pair(both["id"], both["b"]), "n": pc.multiply(both["count_all"], both["m"])}))
    return pa.concat_tables(parts).group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")]) \
        .rename_columns(["doc", "pair", "n"])


def _pair(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.bit_wise_or(pc.shift_left(a.cast(pa.int64()), _A_SHIFT), b.cast(pa.int64()))


def common_ends(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of A and of B that end where one of the other ends."""
    key_a, key_b = a.keys(), b.keys()
    at_a, at_b = (np.concatenate([[0], np.cumsum(s.counts)]) for s in (a, b))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(at_a, np.arange(SLICE_TOKENS, at_a[-1], SLICE_TOKENS)), [len(a.counts)]]))
    found = []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        sides = [pa.table({"key": key[at[x]:at[y]], name: np.arange(at[x], at[y])}) for key, at, name in ((key_a, at_a, "a"), (key_b, at_b, "b"))]
        found.append(sides[0].join(sides[1], "key", join_type="inner", use_threads=False))
    ends = pa.concat_tables(found)
    return np.sort(ends["a"].to_numpy()), ends["b"].to_numpy()


CHUNK = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
    ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("groups_sha256", pa.list_(pa.string())),
    ("entries", pa.list_(pa.int32())), ("at", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())),
    ("n_docs", pa.list_(pa.int64()))])
CHUNK_DDL = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
             "groups_sha256 array<string>, entries array<int>, at binary, times binary, pairs array<long>, n_docs array<long>")


def chunk_row(number: int, ids: list, texts: list[str | None], tok_a, tok_b) -> pa.RecordBatch:
    """One row of ``CHUNK`` for some documents."""
    (lib_a, surface_a, length_a), (lib_b, surface_b, length_b) = tok_a, tok_b
    where = [k for k, t in enumerate(texts) if t]
    full = [texts[k] for k in where]
    column = pa.array(full, pa.string())
    la, lb = encode_both(lib_a, lib_b, column)
    ok = sound(full, la, lb, surface_a, surface_b)
    if not ok.all():
        la, lb = la.filter(pa.array(ok)), lb.filter(pa.array(ok))
        where = [k for k, good in zip(where, ok) if good]
    n = len(texts)
    out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"entries": np.zeros(n, np.int32)}
    sha = [""] * n
    at, times, pairs, n_docs = np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    if where:
        a, b = Side(la, length_a), Side(lb, length_b)
        end_a, end_b = common_ends(a, b)
        n_groups = len(end_a)
        group_a, group_b = a.group(end_a), b.group(end_b)
        doc_of = a.doc.to_numpy()[end_a]
        products = np.bincount(group_a, minlength=n_groups) * np.bincount(group_b, minlength=n_groups)
        out["n_a"][where], out["n_b"][where] = a.counts, b.counts
        out["n_groups"][where] = np.bincount(doc_of, minlength=len(where))
        edges = np.cumsum(out["n_groups"][where])
        out["n_links"][where] = np.diff(np.concatenate([[0], np.cumsum(products)])[np.concatenate([[0], edges])])
        for k, digest in zip(where, digests(a, b, group_a, group_b, n_groups), strict=True):
            sha[k] = digest
        held = links_of(a, b, group_a, group_b, n_groups)
        counted = held.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
        pairs, n_docs = counted["pair"].to_numpy(), counted["count_all"].to_numpy()
        place = pc.index_in(held["pair"].combine_chunks(), value_set=pa.array(pairs)).to_numpy()
        docs = held["doc"].to_numpy()
        order = np.argsort((docs << 32) | place)
        at, times = place[order].astype(np.uint32), held["n"].to_numpy()[order]
        out["entries"][where] = np.bincount(docs, minlength=len(where))
        at[1:] -= at[:-1].copy()  # ascending inside a document; wraps at its begin
        times = times.astype(np.uint64)
    values = {"chunk": [number], "doc_id": [ids], "groups_sha256": [sha], "at": [pack(at)], "times": [pack(times.astype(np.uint64))],
              "pairs": [pairs], "n_docs": [n_docs]} | {c: [v] for c, v in out.items()}
    return batch(CHUNK, values)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                     ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _finish(counts: pa.Table, chunk: pa.Table) -> pa.Table:
    """The documents of one chunk with the counts of its links (``place, n, best``)."""
    row = {c: chunk[c][0] for c in chunk.column_names}
    order = np.argsort(counts["place"].to_numpy())
    n, best = (counts[c].to_numpy(zero_copy_only=False)[order].astype(np.int64) for c in ("n", "best"))
    at = np.cumsum(unpack(row["at"].as_py(), np.uint32), dtype=np.uint32).astype(np.int64)
    times = unpack(row["times"].as_py(), np.uint64).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(row["entries"].values.to_numpy())])

    def total(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[edges])

    made = {c: row[c].values for c in _RESULT.names if c in row} | {"n_best": total(times * best[at]), "count_sum": total(times * n[at])}
    return pa.Table.from_batches([batch(_RESULT, made)])


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, chunk_chars: int = 4_000_000,
          chunk_docs: int = 20_000) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every whole text;
    the paths name the two tokenizers' files on the driver."""
    with open(byte_vocabulary, encoding="utf-8") as f:
        definition = f.read()
    with open(piece_model, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((definition, model))  # bounded: two vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        tok_a, tok_b = _built(ByteTokenizer, shared.value[0]), _built(PieceTokenizer, shared.value[1])
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for part in (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128)):
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                held += len(t or "")
                if held >= chunk_chars or len(ids) >= chunk_docs:
                    yield chunk_row(number, ids, texts, tok_a, tok_b)
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield chunk_row(number, ids, texts, tok_a, tok_b)
        ids, texts = [], []
        give_back()

    chunks = materialize(text_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
                         .mapInArrow(run, CHUNK_DDL))
    partial = chunks.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).select("p.pairs", "p.n_docs")
    counts = partial.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n_docs").alias("n"))
    of_a = F.shiftright("pair", _A_SHIFT).alias("a")
    highest = counts.groupBy(of_a).agg(F.max("n").alias("highest"))
    ranked = counts.withColumn("a", of_a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    asked = chunks.select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("place", "pair")).join(ranked, "pair") \
        .select("of", "place", "n", "best")
    return asked.groupBy("of").cogroup(chunks.drop("pairs", "n_docs").groupBy("chunk")).applyInArrow(
        _finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
