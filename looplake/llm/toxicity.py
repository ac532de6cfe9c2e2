"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes homoglyphs, digit substitutions and invisible characters; accents stay, since they
tell words apart.  The lexicon
(whole words and word stems with log-odds weights), the exception phrases and the calibration
are learned from a bounded sample of labelled rows: at most ``sample_toxic`` toxic and
``sample_clean`` clean rows, those with the smallest hash of their id.  Scoring is one pass over
the table without a shuffle: matches inside exception phrases do not count, the weights of the
others are summed, normalised by the number of words, and mapped to a probability.

Defined cases: null or empty text scores as a text without any match; a null doc_id is carried
through; labels that are null, or that disagree for one doc_id, are taken as the largest; with
no labels of one class every score is the prior; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looplake.llm.common import batch, held_out, materialize, text_batches

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
              "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n",
              "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
              "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d"}
#: Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
#: Harmless phrases with words that are insults elsewhere.
EXCEPTIONS = ("trash can", "trash bin", "pond scum", "clown fish")


_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | dict.fromkeys(INVISIBLE, ""))
_SIGN = re.compile(r"[@$](?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        # full-width and mathematical letters; combining marks join their letters
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(_FOLD)


@dataclass
class Lexicon:
    """Weights by term; stems match at the start of a word, words as a whole."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    prior: float = 0.0
    coef: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        a = ahocorasick.Automaton()
        known: dict[str, list] = {}
        for kind, terms in (("w", self.words), ("s", self.stems)):
            for t, weight in terms.items():
                known.setdefault(t, []).append((kind, len(t), weight))
        for t in self.exceptions:
            known.setdefault(t, []).append(("x", len(t), 0.0))
        for t, values in known.items():
            a.add_word(t, values)
        if known:
            a.make_automaton()
        return a if known else None


def matches(automaton, text: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the terms in a folded text; of overlapping terms the heaviest;
    none that touches an exception phrase."""
    if automaton is None:
        return []
    hits, spared, n = [], [], len(text)
    for last, values in automaton.iter(text):
        for kind, size, weight in values:
            start = last + 1 - size
            if start and text[start - 1].isalnum():
                continue
            if kind != "s" and last + 1 < n and text[last + 1].isalnum():
                continue
            (spared if kind == "x" else hits).append((start, last + 1, weight))
    out: list[tuple[int, int, float]] = []
    for h in sorted(hits, key=lambda h: (h[0], -h[2], -h[1])):
        if out and h[0] < out[-1][1] or any(h[0] < e and s < h[1] for s, e, _ in spared):
            continue
        out.append(h)
    return out


def signal(automaton, text: str | None) -> tuple[float, float, int]:
    """(log of the summed weight, log of the weight for 1000 words, matches)."""
    folded = fold(text)
    found = matches(automaton, folded)
    if not found:
        return 0.0, 0.0, 0
    total = sum(w for _, _, w in found)
    return math.log1p(total), math.log1p(1000 * total / (folded.count(" ") + folded.count("\n") + 20)), len(found)


def probability(lexicon: Lexicon, a: float, b: float) -> float:
    z = lexicon.coef[0] + lexicon.coef[1] * a + lexicon.coef[2] * b
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, sample_toxic: int, sample_clean: int) -> DataFrame:
    """(toxic, text) of a bounded sample of the labelled rows that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.where("toxic = 1").orderBy(*order).limit(sample_toxic) \
        .unionByName(known.where("toxic = 0").orderBy(*order).limit(sample_clean))
    # at most sample_toxic + sample_clean ids: bounded by parameters
    return docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id") \
        .select("toxic", "text")


def learn(docs: DataFrame, labels: DataFrame, sample_toxic: int = 3000, sample_clean: int = 5000,
          min_docs: int = 6, min_weight: float = 1.0, max_terms: int = 20_000) -> Lexicon:
    rows = materialize(training_rows(docs, labels, sample_toxic, sample_clean))

    def words(batches):
        for b in batches:
            out: dict[tuple[str, int], int] = {}
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in set(_WORD.findall(fold(text))):
                    out[w, toxic] = out.get((w, toxic), 0) + 1
            yield pa.RecordBatch.from_pydict({"word": [k[0] for k in out], "toxic": pa.array([k[1] for k in out], pa.int32()),
                                              "n": list(out.values())})

    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon(coef=(3.0 if toxic else -3.0, 0.0, 0.0))
    counted = rows.mapInArrow(words, "word string, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    sizes = F.array(*(F.lit(k) for k in range(4, 9)))
    stems = F.transform(F.filter(sizes, lambda k: k <= F.char_length("word")), lambda k: F.substring("word", F.lit(1), k))
    keys = F.array_union(F.array(F.concat(F.lit("w"), "word")), F.transform(stems, lambda s: F.concat(F.lit("s"), s)))
    # the lower bound of the log odds: terms that few rows show weigh little
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    weight = odds - 2.5 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    terms = counted.select(F.explode(keys).alias("term"), "t", "c").groupBy("term") \
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c")).withColumn("weight", weight) \
        .where((F.col("t") >= min_docs) & (F.col("weight") >= min_weight)) \
        .orderBy(F.desc("weight"), "term").limit(max_terms).collect()
    lexicon = choose_terms([(r["term"], r["t"], r["weight"]) for r in terms])
    lexicon.exceptions = (*EXCEPTIONS, *_learned_exceptions(rows, lexicon))
    return calibrate(rows, lexicon)


def choose_terms(terms: list[tuple[str, int, float]]) -> Lexicon:
    """Drop what a shorter stem says as well: a term stays if it weighs clearly more than the
    stems that cover it."""
    lexicon = Lexicon()
    counts = {t: n for t, n, _ in terms}
    for term, n, weight in sorted(terms, key=lambda x: (x[0][0] != "s", len(x[0]), x[0])):
        body = term[1:]
        covers = [lexicon.stems[body[:k]] for k in range(1, len(body) + 1) if body[:k] in lexicon.stems]
        if covers and max(covers) >= weight - 0.7:
            continue
        if term[0] == "w":
            lexicon.words[body] = weight
        elif counts.get("w" + body, 0) < 0.9 * n:  # only one word begins so: the word itself will do
            lexicon.stems[body] = weight
    return lexicon


def _learned_exceptions(rows: DataFrame, lexicon: Lexicon, min_clean: int = 5) -> list[str]:
    """Matched terms with a neighbour word that are seen in clean rows only."""

    def phrases(batches):
        automaton = lexicon.automaton()
        for b in batches:
            out: dict[tuple[str, int], int] = {}
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folded, seen = fold(text), set()
                for s, e, _ in matches(automaton, folded):
                    before = re.search(r"([^\W\d_]+ )$", folded[max(0, s - 40):s])
                    after = re.match(r"[^\W\d_]*( [^\W\d_]+)?", folded[e:e + 40])
                    if before:
                        seen.add(before[1] + folded[s:e])
                    if after and after[1]:
                        seen.add(folded[s:e] + after[0])
                for x in seen:
                    out[x, toxic] = out.get((x, toxic), 0) + 1
            yield pa.RecordBatch.from_pydict({"p": pa.array([k[0] for k in out], pa.string()),
                                              "toxic": pa.array([k[1] for k in out], pa.int32()),
                                              "n": pa.array(list(out.values()), pa.int64())})

    found = rows.mapInArrow(phrases, "p string, toxic int, n long").groupBy("p").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    return [r["p"] for r in found.where((F.col("t") == 0) & (F.col("c") >= min_clean))
            .orderBy(F.desc("c"), "p").limit(1000).collect()]


def calibrate(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Logistic regression of the label on the two signals, by Newton steps on the sample."""

    def signals(batches):
        automaton = lexicon.automaton()
        for b in batches:
            s = [signal(automaton, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": b.column(0), "a": [x[0] for x in s], "b": [x[1] for x in s]})

    got = rows.mapInArrow(signals, "toxic int, a double, b double").toPandas()
    x = np.column_stack([np.ones(len(got)), got["a"], got["b"]])
    y = got["toxic"].to_numpy(float)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - np.array([1e-3, 0.1, 0.1]) * w)
    lexicon.coef, lexicon.prior = tuple(float(v) for v in w), float(y.mean())
    return lexicon


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_matches", pa.int64())])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score, predicted, n_matches`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            found = [signal(automaton, t) for t in b.column(1).to_pylist()]
            p = [probability(lexicon, x, y) for x, y, _ in found]
            yield batch(SCHEMA, {"doc_id": b.column(0), "score": p, "predicted": [int(v >= 0.5) for v in p],
                                 "n_matches": [f[2] for f in found]})

    return text_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text") \
        .mapInArrow(run, "doc_id long, score double, predicted int, n_matches long")
