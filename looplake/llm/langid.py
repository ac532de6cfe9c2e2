"""Language identification of words by a linear-chain conditional random field.

Words are labelled with a language each, so that code-switched text comes out in parts; a
document gets the language with the largest sum of word marginals.  Features of a word are its
prefixes and suffixes of one to three letters, its letter bigrams and trigrams with word ends, and
itself if it is frequent (the lexicon); transitions between the languages of neighbours are learned
with the weights.  Marginals come from forward-backward over chains of ``CHAIN`` words; a longer
line is a row of chains, and chains are worked off together, place by place.

Training is on a bounded sample: for each of at most ``max_languages`` languages the
``sample_docs`` documents with the smallest hash of their id, of each the ``sample_chains`` chains
with the smallest hash of their words.  A part of the chains is joined from two halves of different
languages, from which the transitions learn switches.  Weights are fitted by full-batch gradient
steps (Adam) on the chains' conditional likelihood.  Scoring is one pass without a shuffle.

Defined cases: null text, and text without a letter, is ``und`` with score 0; without any learned
language every text is; a null doc_id is carried through and never learned from; repeated rows are
labelled each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from looplake.llm.common import batch, held_out, text_batches

CHAIN = 32
CACHE_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of_text(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    w = f"^{word}$"
    n = len(w)
    out = [w]
    out += ["p" + word[:k] for k in (1, 2, 3)]
    out += ["s" + word[-k:] for k in (1, 2, 3)]
    out += [w[i:i + 2] for i in range(n - 1)]
    out += [w[i:i + 3] for i in range(n - 2)]
    return out


@dataclass
class Model:
    languages: list[str]
    index: dict[str, int]  # feature -> row of weights
    weights: np.ndarray  # (features, languages)
    transition: np.ndarray  # (languages, languages), scores
    start: np.ndarray


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Emission scores (words, languages)."""
    ids, ends = [], [0]
    get = model.index.get
    for w in words:
        ids.extend(i for f in features(w) if (i := get(f)) is not None)
        ends.append(len(ids))
    total = np.zeros((len(ids) + 1, len(model.languages)))
    np.cumsum(model.weights[ids], axis=0, out=total[1:]) if ids else None
    ends = np.array(ends)
    return total[ends[1:]] - total[ends[:-1]]


def marginals(emission: np.ndarray, mask: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Forward-backward over chains: emission (chains, places, labels), mask (chains, places).
    Returns the marginals of every place, the log partition, and the expected transitions."""
    s, t, k = emission.shape
    peak = emission.max(axis=2, keepdims=True)
    e = np.exp(emission - peak)
    shift = transition.max()
    step = np.exp(transition - shift)
    first = np.exp(start)
    alpha, beta, scale = np.zeros((s, t, k)), np.ones((s, t, k)), np.ones((s, t))
    a = first * e[:, 0]
    scale[:, 0] = a.sum(1)
    alpha[:, 0] = a / scale[:, :1]
    for i in range(1, t):
        a = np.where(mask[:, i, None], (alpha[:, i - 1] @ step) * e[:, i], alpha[:, i - 1])
        scale[:, i] = a.sum(1)
        alpha[:, i] = a / scale[:, i, None]
    for i in range(t - 2, -1, -1):
        b = (beta[:, i + 1] * e[:, i + 1]) @ step.T / scale[:, i + 1, None]
        beta[:, i] = np.where(mask[:, i + 1, None], b, beta[:, i + 1])
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    log_z = (np.log(scale) + np.where(mask, peak[:, :, 0], 0)).sum(1) + shift * (mask.sum(1) - 1)
    right = beta[:, 1:] * e[:, 1:] / scale[:, 1:, None] * mask[:, 1:, None]
    pairs = np.einsum("sti,stj->ij", alpha[:, :-1], right) * step
    return gamma, log_z, pairs


def chains_of(words: list[str]) -> list[list[str]]:
    return [words[i:i + CHAIN] for i in range(0, len(words), CHAIN)]


def fit(samples: list[tuple[str, list[str]]], rounds: int = 80, min_count: int = 3, l2: float = 1e-3, mixed: float = 0.25) -> Model:
    """Train on (language, chain) pairs."""
    languages = sorted({x for x, _ in samples})
    if not languages:
        return Model([], {}, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    label = {x: i for i, x in enumerate(languages)}
    chains, labels = [], []
    for i, (x, c) in enumerate(samples):
        other = samples[(i * 7919 + 13) % len(samples)]
        if other[0] != x and i % 100 < 100 * mixed:
            half = CHAIN // 2
            chains.append(c[:half] + other[1][:half])
            labels.append([label[x]] * len(c[:half]) + [label[other[0]]] * len(other[1][:half]))
        else:
            chains.append(c)
            labels.append([label[x]] * len(c))
    vocab: dict[str, int] = {}
    for c in chains:
        for w in c:
            vocab.setdefault(w, len(vocab))
    per_word = [features(w) for w in vocab]
    count = Counter(f for fs in per_word for f in fs)
    freq = Counter(w for c in chains for w in c)
    count.update({f"^{w}$": n - 1 for w, n in freq.items()})
    index = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= min_count))}
    rows = [[index[f] for f in fs if f in index] for fs in per_word]
    flat = np.array([i for r in rows for i in r], dtype=np.int64)
    of_word = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    s, k = len(chains), len(languages)
    ids, gold, mask = np.zeros((s, CHAIN), np.int64), np.zeros((s, CHAIN), np.int64), np.zeros((s, CHAIN), bool)
    for i, (c, y) in enumerate(zip(chains, labels, strict=True)):
        ids[i, :len(c)] = [vocab[w] for w in c]
        gold[i, :len(c)], mask[i, :len(c)] = y, True
    truth = np.zeros((s, CHAIN, k))
    np.put_along_axis(truth, gold[:, :, None], 1.0, axis=2)
    truth *= mask[:, :, None]
    both = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
    n = mask.sum()
    params = [np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        word = np.zeros((len(vocab), k))
        for j in range(k):
            word[:, j] = np.bincount(of_word, weights=params[0][flat, j], minlength=len(vocab))
        gamma, _, pairs = marginals(word[ids], mask, params[1], params[2])
        error = (truth - gamma * mask[:, :, None])
        by_word = np.stack([np.bincount(ids.ravel(), weights=error[:, :, j].ravel(), minlength=len(vocab)) for j in range(k)], 1)
        g = np.stack([np.bincount(flat, weights=by_word[of_word, j], minlength=len(index)) for j in range(k)], 1)
        grads = [g / n - l2 * params[0] / 10, (seen - pairs) / n - l2 * params[1], error[:, 0].sum(0) / n - l2 * params[2]]
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.99 * second[i] + 0.01 * d * d
            params[i] = params[i] + 0.1 * (first[i] / (1 - 0.9**r)) / (np.sqrt(second[i] / (1 - 0.99**r)) + 1e-7)
    return Model(languages, index, *params)


def learn(docs: DataFrame, max_languages: int = 64, sample_docs: int = 400, sample_chains: int = 4) -> Model:
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    top = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    place = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # a group limit: every task keeps sample_docs rows of a language before the shuffle
    ids = known.select("doc_id", "lang").join(F.broadcast(top.select("lang")), "lang") \
        .withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample_docs).select("doc_id", "lang")

    def chains(batches):
        for b in batches:
            out: list[tuple[str, list[str]]] = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cut = sorted(chains_of(words_of_text(text)), key=lambda c: xxh64_intdigest(" ".join(c)))
                out += [(lang, c) for c in cut[:sample_chains]]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in out], pa.string()),
                                              "words": pa.array([c for _, c in out], pa.list_(pa.string()))})

    rows = known.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("lang", "text") \
        .mapInArrow(chains, "lang string, words array<string>").collect()  # at most 64 x 400 x 4 chains
    return fit(sorted((r["lang"], list(r["words"])) for r in rows if r["words"]))


class Labeller:
    """Word marginals of texts under a model; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.table = np.zeros((1024, len(model.languages)))

    def _rows(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = list(set(words).difference(known))
        if new:
            if len(known) + len(new) > CACHE_WORDS and len(new) < CACHE_WORDS:
                known.clear()
                new = list(set(words))
            at = len(known)
            while at + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at:at + len(new)] = word_scores(self.model, new)
            known.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginals (words, languages) of every text."""
        words = [w for t in texts for w in t]
        k = len(self.model.languages)
        if not words or not k:
            return [np.zeros((len(t), k)) for t in texts]
        rows = self._rows(words)
        sizes = [len(t) for t in texts]
        counts = np.array([-(-n // CHAIN) for n in sizes])
        mask = np.zeros((counts.sum(), CHAIN), bool)
        at = 0
        for n, c in zip(sizes, counts, strict=True):
            mask[at:at + c].reshape(-1)[:n] = True
            at += c
        grid = np.zeros((len(mask), CHAIN), np.int64)
        grid[mask] = rows
        flat = np.empty((len(words), k))
        done = 0
        for a in range(0, len(mask), 8192):  # bounded memory, whatever the texts' lengths
            m = mask[a:a + 8192]
            gamma, _, _ = marginals(self.table[grid[a:a + 8192]], m, self.model.transition, self.model.start)
            n = int(m.sum())
            flat[done:done + n] = gamma[m]
            done += n
        return np.split(flat, np.cumsum(sizes)[:-1])


SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_switches", pa.int64())])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, n_switches``: the language, its mean marginal over the words, and
    how often the most likely language of a word differs from that of the word before."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        names = shared.value.languages
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                out = {n: [] for n in SCHEMA.names[1:]}
                for g in labeller.label([words_of_text(t) for t in part.column(1).to_pylist()]):
                    if not len(g) or not names:
                        best = ("und", 0.0, 0)
                    else:
                        mean, top = g.mean(0), g.argmax(1)
                        best = (names[int(mean.argmax())], float(mean.max()), int((top[1:] != top[:-1]).sum()))
                    for n, v in zip(out, best, strict=True):
                        out[n].append(v)
                yield batch(SCHEMA, {"doc_id": part.column(0)} | out)

    return text_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text") \
        .mapInArrow(run, "doc_id long, lang_pred string, score double, n_switches long")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, spans``: runs of words of one language as (lang, first word, words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct(
        [("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        names = shared.value.languages
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                spans = []
                for g in labeller.label([words_of_text(t) for t in part.column(1).to_pylist()]):
                    top = g.argmax(1) if names and len(g) else np.empty(0, np.int64)
                    cuts = [0, *(np.flatnonzero(top[1:] != top[:-1]) + 1).tolist(), len(top)] if len(top) else []
                    spans.append([{"lang": names[top[a]], "first_word": a, "n_words": z - a} for a, z in zip(cuts, cuts[1:])])
                yield batch(schema, {"doc_id": part.column(0), "spans": spans})

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text") \
        .mapInArrow(run, "doc_id long, spans array<struct<lang:string,first_word:long,n_words:long>>")
