"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary is a public model file (its path is a parameter, ``vocabulary``).  The only one at
hand stores merge ranks instead of log probabilities; by default (``scores="zipf"``) a piece of
rank r among n gets the log probability -ln(r H_n) of Zipf's law, ``scores="stored"`` takes the
scores of a unigram model's file as they are.

Blanks are written as the marker U+2581, one more is put in front.  No piece has a marker behind
another character (checked on loading), so the best segmentation of a text is that of its words,
each with the markers before it; a task computes a word once and keeps it in a bounded cache.
Characters without a piece fall back to byte pieces.  Decoding joins the pieces' bytes, turns
markers into blanks and drops the first.

Defined cases: null or empty text has no pieces and decodes to the empty text; a marker character
in the text decodes to a blank, as the format has it; very long words are segmented without the
cache; repeated rows are encoded each; a null doc_id is carried through; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from looplake.llm.common import batch, give_back, text_batches

MARK = "▁"
_MARK = MARK.encode()
CACHE_WORDS = 400_000
CACHED_CHARS = 32
#: Longer words are segmented one by one.
TOGETHER_CHARS = 256
#: Fixed value: an unknown character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class DoubleArray:
    """Trie over bytes in two arrays: the child of state s by byte c is t = base[s] + c + 1, and it
    is one if check[t] = s.  ``value`` has the key's number, or -1."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        number = [-1]
        for i, key in enumerate(keys):
            node = 0
            for c in key:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    number.append(-1)
                node = nxt
            number[node] = i
        size = 2 * len(children) + 600
        base, check, value = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0] = 1
        scan, todo = 1, [(0, 0)]
        value[0] = number[0]
        while todo:
            node, state = todo.pop()
            codes = sorted(children[node])
            if not codes:
                continue
            first = codes[0] + 1
            slot, tried = max(scan, first), 0
            while used[slot] or any(used[slot - first + c + 1] for c in codes):
                slot, tried = slot + 1, tried + 1
                if slot + 257 >= size:
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                    used += bytearray(size)
                    size *= 2
            if tried > 256:  # what lies behind is nearly full: later nodes begin further on
                scan = slot - 64
            at = slot - first
            base[state] = at
            for c in codes:
                t = at + c + 1
                used[t], check[t], value[t] = 1, state, number[children[node][c]]
                todo.append((children[node][c], t))
        self.base, self.check, self.value = base, check, value
        self.arrays = tuple(np.array(x, dtype=np.int32) for x in (base, check, value))


@dataclass
class Vocabulary:
    pieces: list[bytes]  # surface of every id as bytes, markers as blanks; controls empty
    trie: DoubleArray
    ids: list[int]  # of the trie's keys
    scores: list[float]
    byte_ids: list[int]
    unknown: float
    key: tuple  # file, kind of scores, checksum


def load(path: str, scores: str = "zipf") -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids, surfaces, ids = [0] * 256, [b""] * n, []
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surfaces[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            if not re.fullmatch(f"{MARK}*[^{MARK}]*", piece):
                raise ValueError(f"piece {i} has a marker inside: words cannot be segmented alone")
            surfaces[i] = piece.replace(MARK, " ").encode()
            ids.append(i)
    harmonic = sum(1 / r for r in range(1, len(ids) + 1))
    values = [-math.log(r * harmonic) if scores == "zipf" else model.get_score(i) for r, i in enumerate(ids, 1)]
    return Vocabulary(surfaces, DoubleArray([model.id_to_piece(i).encode() for i in ids]), ids, values, byte_ids,
                      min(values) - UNKNOWN_PENALTY, (path, scores, hash((tuple(surfaces), tuple(values)))))


def viterbi(v: Vocabulary, word: bytes) -> list[int]:
    """Ids of the best segmentation of UTF-8 bytes; ties go to the piece that begins first."""
    n = len(word)
    best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = 0.0
    base, check, value, scores = v.trie.base, v.trie.check, v.trie.value, v.scores
    at = 0
    while at < n:
        lead = word[at]
        char = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
        state, end, here, single = 0, at, best[at], False
        while end < n:
            t = base[state] + word[end] + 1
            if check[t] != state:
                break
            state, end = t, end + 1
            k = value[t]
            if k >= 0:
                single = single or end == char
                s = here + scores[k]
                if s > best[end]:
                    best[end], back[end] = s, (at, k)
        if not single and here + v.unknown > best[char]:
            best[char], back[char] = here + v.unknown, (at, -1)
        at = char
    out: list[int] = []
    while n:
        start, k = back[n]
        if k >= 0:
            out.append(v.ids[k])
        else:
            out.extend(v.byte_ids[c] for c in reversed(word[start:n]))
        n = start
    out.reverse()
    return out


def viterbi_many(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """The same for many short words at once: all words take a step of the trie together.  Returns
    the ids packed as 32-bit numbers."""
    base, check, value = v.trie.arrays
    score, ids = np.array(v.scores), np.array(v.ids, dtype=np.int32)
    size = np.array([len(w) for w in words])
    n, width = len(words), int(size.max())
    text = np.zeros((n, width), np.int32)
    text[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    lead = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0.0
    start, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
    for at in range(width):
        rows = np.flatnonzero((size > at) & ((text[:, at] & 0xC0) != 0x80))
        if not len(rows):
            continue
        here, after = best[rows, at], at + lead[rows, at]
        single, live, state = np.zeros(len(rows), bool), np.arange(len(rows)), np.zeros(len(rows), np.int32)
        for end in range(at + 1, width + 1):
            step = base[state] + text[rows[live], end - 1] + 1
            ok = (check[step] == state) & (size[rows[live]] >= end)
            live, state = live[ok], step[ok]
            if not len(live):
                break
            found = value[state]
            has = found >= 0
            at_end, k = live[has], found[has]
            single[at_end] |= after[at_end] == end
            gain = here[at_end] + score[k]
            better = gain > best[rows[at_end], end]
            at_end, k = at_end[better], k[better]
            best[rows[at_end], end], start[rows[at_end], end], piece[rows[at_end], end] = gain[better], at, k
        lost = np.flatnonzero(~single)
        gain = here[lost] + v.unknown
        better = gain > best[rows[lost], after[lost]]
        r, e = rows[lost[better]], after[lost[better]]
        best[r, e], start[r, e], piece[r, e] = gain[better], at, -1
    # from the ends back: column by column, the last piece first
    chosen = np.full((n, width), -1, np.int32)
    unknown = np.zeros(n, bool)
    rows, end, k = np.arange(n), size.copy(), 0
    while len(rows):
        chosen[rows, k] = piece[rows, end]
        unknown[rows] |= piece[rows, end] < 0
        end = start[rows, end]
        rows, end, k = rows[end > 0], end[end > 0], k + 1
    count = (chosen >= 0).sum(1)
    last = np.concatenate([[0], np.cumsum(count)]) * 4
    back = chosen[:, ::-1]
    packed = ids[back[back >= 0]].tobytes()
    out = [packed[a:b] for a, b in zip(last[:-1].tolist(), last[1:].tolist(), strict=True)]
    for i in np.flatnonzero(unknown):
        e, parts = int(size[i]), []
        while e:
            b, p = int(start[i, e]), int(piece[i, e])
            parts.append([v.ids[p]] if p >= 0 else [v.byte_ids[c] for c in words[i][b:e]])
            e = b
        out[i] = np.array([x for part in reversed(parts) for x in part], dtype=np.int32).tobytes()
    return out


#: Words that this Python worker has segmented, for the vocabulary it used last.
_WORDS: dict[tuple, dict[str, bytes]] = {}


class Encoder:
    """Encodes texts to packed 32-bit ids; remembers words, over the tasks of a worker too."""

    def __init__(self, v: Vocabulary):
        self.v = v
        if v.key not in _WORDS:
            _WORDS.clear()
        self.cache = _WORDS.setdefault(v.key, {})

    def _learn(self, words: list[str]) -> None:
        """Segment words of similar length together, which bounds the padding."""
        coded = sorted(((MARK + w if w[:1] != MARK else w).encode("utf-8", "replace"), w) for w in words)
        coded.sort(key=lambda x: len(x[0]))
        k = 0
        while k < len(coded):
            part = coded[k:k + max(64, 200_000 // len(coded[k][0]))]
            k += len(part)
            self.cache.update(zip((w for _, w in part), viterbi_many(self.v, [c for c, _ in part]), strict=True))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Words are kept without their marker if it is one, with all markers else."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:  # the half that was learned first goes
            for w in list(islice(cache, CACHE_WORDS // 2)):
                del cache[w]
        split: list[list[str]] = []
        for text in texts:
            if not text:
                words = []
            elif MARK in text or "  " in text or text[-1] == " " or text[0] == " ":
                words = [w[1:] if w[1:2] != MARK and len(w) > 1 else w for w in _CHUNK.findall(MARK + text.replace(" ", MARK))]
            else:
                words = text.split(" ")
            split.append(words)
        new = set().union(*split) - cache.keys()
        long = [w for w in new if len(w) > CACHED_CHARS]
        for w in long:
            if len(w) > TOGETHER_CHARS:
                new.discard(w)
                cache[w] = np.array(viterbi(self.v, (MARK + w if w[:1] != MARK else w).encode("utf-8", "replace")), dtype=np.int32).tobytes()
        self._learn(list(new))
        out = [b"".join(map(cache.__getitem__, words)) for words in split]
        for w in long:  # not remembered
            del cache[w]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


def decode(v: Vocabulary, ids) -> str:
    text = b"".join(map(v.pieces.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_byte_pieces", pa.int64())])


def encode_documents(docs: DataFrame, vocabulary: str, scores: str = "zipf") -> DataFrame:
    """``doc_id, ids, n_byte_pieces`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary, scores))  # bounded: one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        is_byte = np.zeros(len(shared.value.pieces), dtype=bool)
        is_byte[shared.value.byte_ids] = True
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                rows = [np.frombuffer(x, dtype=np.int32) for x in encoder.encode_many(part.column(1).to_pylist())]
                ends = np.cumsum([0] + [len(r) for r in rows], dtype=np.int32)
                ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows)))
                yield batch(ENCODED, {"doc_id": part.column(0), "ids": ids,
                                      "n_byte_pieces": [int(is_byte[r].sum()) for r in rows]})
        give_back()

    return text_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text") \
        .mapInArrow(run, "doc_id long, ids array<int>, n_byte_pieces long")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``text`` in place of ``ids``; the other columns stay.  A null list of ids is the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(vocabulary))
    rest = [c for c in encoded.columns if c not in ("ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = pa.array([decode(v, r or ()) for r in part.column("ids").to_pylist()], type=pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), texts], names=[*rest, "text"])
        give_back()

    schema = StructType([encoded.schema[c] for c in rest] + [StructField("text", StringType())])
    return text_batches(encoded).select(*rest, "ids").mapInArrow(run, schema)
