"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  Nothing is known of
it: successive prefixes of a conversation are rendered, and what a prefix adds to the one before
it is the span of the new turn.  A prefix that does not begin with the output before it shows a
template that rewrites history: the conversation is marked, and spans that it has moved are void.
Where a turn's own text lies inside its span is found by rendering the turn with two one-letter
texts: what their outputs share at both ends is the frame.

The output is in blocks of ``block_turns`` turn numbers.  A template that writes every turn by itself
(``per_turn``, as ``inst_template`` does) is rendered block by block, so that the rows of a block, but
never those of a conversation, are gathered in one task.  Any other template may look at all turns
before: one task renders the prefixes of a whole conversation, whose cost grows with the square of its
turns, and cuts the last one into blocks.  Where a later turn has rewritten the text around the border
of two blocks, the later block begins where the texts begin to differ.

Defined cases: null text and null role are empty; rows are ordered by turn (null first), role and
text, so ties and repeated rows have a place and all stay; a null conv_id is a conversation of its
own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from looplake.llm.common import batch

Template = Callable[[list[tuple[str, str]]], str]

#: The control strings of the template. A backslash is put behind the first
#: character of a control string inside a text, one more where backslashes stand there already.
TURN_OPEN, ROLE_CLOSE, TURN_CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def inst_template(turns: list[tuple[str, str]]) -> str:
    """Every turn: <s>[INST]role[/INST]text</s>, with control strings escaped."""
    return "".join(f"{TURN_OPEN}{escape(r)}{ROLE_CLOSE}{escape(t)}{TURN_CLOSE}" for r, t in turns)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of an output of ``inst_template``."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def render(template: Template, turns: list[tuple[str, str]], before: list[tuple[str, str]] = [],
           loss_role: str = "assistant") -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """(text, spans, rewrites) of ``turns`` after the turns ``before``, for a template that does not
    rewrite those.  A span is (start, end, loss start, loss end) in the text; the loss part is the
    turn's own text if it is of ``loss_role``, else empty.  Spans that a later prefix has changed are
    (-1, -1, -1, -1)."""
    return _render(template, turns, before, loss_role)[:3]


def _render(template: Template, turns: list[tuple[str, str]], before: list[tuple[str, str]], loss_role: str,
            first: frozenset[int] = frozenset()) -> tuple[str, list[tuple[int, int, int, int]], bool, list[int]]:
    """``render``, and where in the text the blocks begin whose first turns have the indices ``first``."""
    done = list(before)
    last = template(done) if done else ""
    cut, spans, rewrites, edges = len(last), [], False, []
    for k, (role, text) in enumerate(turns):
        if k in first:
            edges.append(len(last) - cut)
        now = template([*done, (role, text)])
        if not now.startswith(last):
            rewrites = True
            same = _shared(now, last)
            edges = [min(e, same - cut) for e in edges]
            spans = [s if s[1] + cut <= same else (-1,) * 4 for s in spans]
            start = end = -1
        else:
            start, end = len(last) - cut, len(now) - cut
        lo = hi = max(start, 0)
        if start < 0:
            lo = hi = -1
        elif role == loss_role:
            one, two = template([*done, (role, "A")]), template([*done, (role, "B")])
            head = _shared(one, two)
            tail = _shared(one[head:][::-1], two[head:][::-1])
            lo, hi = head - cut, end - tail
            if not (one.startswith(last) and start <= lo <= hi <= end):
                lo = hi = -1  # the template does not show the text as it is
        spans.append((start, end, lo, hi))
        done.append((role, text))
        last = now
    return last[cut:], spans, rewrites, edges


def render_blocks(template: Template, turns: list[tuple[int, str, str]], loss_role: str = "assistant"
                  ) -> list[tuple[int, str, list[tuple[int, int, int, int]], bool]]:
    """(block, text, spans, rewrites) of the blocks of a whole conversation of (block, role, text) in
    order: the texts together are the template's output, and spans count from the start of their block."""
    first = [k for k, t in enumerate(turns) if k == 0 or t[0] != turns[k - 1][0]]
    text, spans, rewrites, edges = _render(template, [t[1:] for t in turns], [], loss_role, frozenset(first))
    out = []
    for k, end, a, b in zip(first, [*first[1:], len(turns)], edges, [*edges[1:], len(text)], strict=True):
        own = [tuple(x - a if x >= 0 else -1 for x in s) for s in spans[k:end]]
        out.append((turns[k][0], text[a:b], own, rewrites))
    return out


SPAN = "array<struct<start:long,end:long,loss_start:long,loss_end:long>>"
SCHEMA = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("text", pa.large_string()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()),
                                                  ("loss_start", pa.int64()), ("loss_end", pa.int64())]))),
                    ("rewrites", pa.bool_())])


def format_conversations(conversations: DataFrame, template: Template = inst_template, block_turns: int = 64,
                         loss_role: str = "assistant", per_turn: bool | None = None) -> DataFrame:
    """``conv_id, block, text, spans, rewrites``: the formatted text in blocks; the text of a
    conversation is that of its blocks in order, spans count from the start of their block.
    ``per_turn`` says that the template's output is that of its turns one by one; without it, that is
    taken for ``inst_template`` only."""
    if per_turn is None:
        per_turn = template is inst_template
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns).cast("long"), F.lit(-(1 << 62))))
    schema = f"conv_id long, block long, text string, spans {SPAN}, rewrites boolean"

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def packed(blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for conv, block, text, spans, rewrites in blocks:
            out.append((conv, block, text, [dict(zip(("start", "end", "loss_start", "loss_end"), s)) for s in spans], rewrites))
            if len(out) >= 256:
                yield batch(SCHEMA, dict(zip(SCHEMA.names, zip(*out), strict=True)))
                out = []
        if out:
            yield batch(SCHEMA, dict(zip(SCHEMA.names, zip(*out), strict=True)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed((conv, *b) for conv, group in groupby(flat(batches), key=lambda r: r[0])
                          for b in render_blocks(template, [r[1:] for r in group], loss_role))

    if not per_turn:
        return rows.repartition("conv_id") \
            .sortWithinPartitions("conv_id", "block", F.asc_nulls_first("turn"), "role", "text") \
            .select("conv_id", "block", "role", "text").mapInArrow(whole, schema)
    order = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), "role", "text")
    # one row for each block, not for each turn: the last turn of a block goes in front of the next
    lasts = rows.groupBy("conv_id", "block").agg(F.max_by(F.struct("role", "text"), order).alias("last"))
    following = F.lead("block").over(Window.partitionBy("conv_id").orderBy("block"))
    heads = lasts.withColumn("block", following).where("block is not null") \
        .select("conv_id", "block", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), "last.role", "last.text")
    both = rows.select("conv_id", "block", F.lit(False).alias("head"), "turn", "role", "text").unionByName(heads)

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for (conv, block), group in groupby(flat(batches), key=lambda r: r[:2]):
                members = list(group)  # a block: its turns are bounded
                before = [r[4:] for r in members if r[2]]
                yield conv, block, *render(template, [r[4:] for r in members if not r[2]], before, loss_role)

        yield from packed(blocks())

    return both.repartition("conv_id", "block") \
        .sortWithinPartitions("conv_id", "block", F.desc("head"), F.asc_nulls_first("turn"), "role", "text") \
        .mapInArrow(by_block, schema)


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                    ("rewrites", pa.bool_())])


def read_back(formatted: DataFrame, parser: Callable[[str], list[tuple[str, str]]] = parse,
              unescaper: Callable[[str], str] = unescape) -> DataFrame:
    """Digests of every conversation, read from its formatted text and loss spans alone.

    A digest of a whole conversation is a chain over its turns, so one task follows it; the task
    streams the blocks in order and holds one block and two hash states, whatever the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out: list = []
        for conv, group in groupby(flat(), key=lambda r: r[0]):
            n = chars = size = 0
            turns, loss, rewrites = hashlib.sha256(), hashlib.sha256(), False
            for _, _, text, spans, moved in group:
                for role, body in parser(text):
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    if s["loss_end"] > s["loss_start"]:
                        piece = unescaper(text[s["loss_start"]:s["loss_end"]])
                        chars += len(piece)
                        loss.update(piece.encode("utf-8", "surrogatepass"))
                size += len(text)
                rewrites |= moved
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, rewrites))
            if len(out) >= 4096:
                yield batch(DIGEST, dict(zip(DIGEST.names, zip(*out), strict=True)))
                out = []
        if out:
            yield batch(DIGEST, dict(zip(DIGEST.names, zip(*out), strict=True)))

    return formatted.select("conv_id", "block", "text", "spans", "rewrites").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "block").mapInArrow(
            run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                 "formatted_chars long, rewrites boolean")
