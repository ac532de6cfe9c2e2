"""Quality rules, line first.

Every line of a text is judged by punctuation, navigation and boilerplate rules; lines that
fail are removed; a document that loses too much of its text that way is rejected.  Counts over
the whole text (``base``) reject documents that are too short or repeat themselves.

Defined cases: a null or empty text has no words, all counts 0, and is rejected (too short);
blank lines pass every rule and lose nothing; repeated rows are judged one by one; a null
``doc_id`` is carried through; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from looplake.llm.common import SPACES, batch, text_batches, words_of

SYMBOLS = "#*$%&|<>"
#: A line of prose ends in one of these marks.
TERMINAL = ".!?:;\"')]…”’»"
#: Phrases of page furniture (matched without regard to ASCII case).
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
               "subscribe to our newsletter", "sign up now", "log in to", "click here", "read more", "share this",
               "enable javascript", "lorem ipsum", "skip to content", "back to top")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.I | re.A)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_pct: int = 50
    #: a line of fewer words that does not end in a terminal mark fails (headings, menu entries)
    open_line_words: int = 12
    #: a line with more symbols, or more exclamation marks, per 100 words than this fails
    max_symbol_pct: int = 30
    max_shout_pct: int = 30
    #: a line with this many separators, at least one for four words, is navigation
    min_pipes: int = 2
    #: a document that loses more of its word characters than this, in per cent, is rejected
    max_loss_pct: int = 30


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
                    ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
                    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_lines_removed", pa.int64()),
                    ("lost_chars", pa.int64()), ("clean_text", pa.string())])
DDL = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, kept boolean, n_lines_removed long, lost_chars long, clean_text string")


def count_symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def count_word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, SPACES))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice (every occurrence counts)."""
    n = len(words)
    if n < 4:
        return 0
    last = dict(zip(words, range(n)))
    ids = np.fromiter(map(last.__getitem__, words), dtype=np.int64, count=n)
    if n < 1 << 20:
        pair, base = ids[:-1] * n + ids[1:], n
    else:  # three ids no longer fit into 63 bits: number the pairs first
        pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1].astype(np.int64)
        base = n
    key = pair[:-1] * base + ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, dtype=bool)
    for k in range(3):
        cover[k:n - 2 + k] |= twice
    return int(cover.sum())


def line_fails(line: str, rules: Rules) -> str | None:
    """Name of the first rule that a line breaks, or None."""
    body = line.strip(SPACES)
    if not body:
        return None
    n = len(body.encode("utf-8", "surrogatepass").split())
    pipes = body.count("|")
    if pipes >= rules.min_pipes and 4 * pipes >= n:
        return "navigation"
    if (body[-1] not in TERMINAL and n < rules.open_line_words or 100 * count_symbols(body) > rules.max_symbol_pct * n
            or 100 * body.count("!") > rules.max_shout_pct * n and body.count("!") >= 3):
        return "punctuation"
    if _BOILERPLATE.search(body):
        return "boilerplate"
    return None


def judge(text: str | None, rules: Rules) -> tuple:
    """All result columns but doc_id for one text."""
    text = text or ""
    words = words_of(text)
    lines = text.split("\n")
    real = [x for x in lines if x.strip(SPACES)]
    repeat, chars = repeated_words(words), count_word_chars(text)
    base = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_pct * len(words)
    good = [x for x in lines if line_fails(x, rules) is None]
    removed = len(lines) - len(good)
    lost = chars - count_word_chars("\n".join(good)) if removed else 0
    kept = not base and 100 * lost <= rules.max_loss_pct * chars
    return (len(words), chars, count_symbols(text), len(real) - len(set(real)), repeat, base, kept, removed, lost,
            "\n".join(good) if removed else text)


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Judge every document: counts, verdict (``kept``) and the text without its failed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                rows = [judge(x, rules) for x in part.column(1).to_pylist()]
                names = SCHEMA.names[1:]
                yield batch(SCHEMA, {"doc_id": part.column(0)} | {c: [r[i] for r in rows] for i, c in enumerate(names)})

    return text_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, DDL)


def filter_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents in their own columns: ``text`` without its failed lines, ``n_chars`` (if
    there is one) its new length."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                rows = [judge(x, rules) for x in part.column(names.index("text")).to_pylist()]
                new = {"text": [r[-1] for r in rows], "n_chars": [len(r[-1]) for r in rows]}
                out = pa.RecordBatch.from_arrays(
                    [pa.array(new[c], type=part.column(i).type) if c in new else part.column(i) for i, c in enumerate(names)],
                    schema=part.schema)
                yield out.filter(pa.array([r[6] for r in rows]))

    return text_batches(docs).mapInArrow(run, docs.schema)
