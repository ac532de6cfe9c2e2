"""Plain Python versions of the training-data operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

from looplake.llm import quality

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """(doc_id, text) -> {doc_id: (size, component)}"""
    sets = defaultdict(set)
    for i, t in rows:
        sets[i] |= shingles(t)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {i: (len(sets[i]), find(i)) for i in ids}


def dedup(rows, min_chars=20, min_docs=3):
    """(doc_id, text) -> [(doc_id, lines, dropped, kept text)]"""
    holders = defaultdict(set)
    key = lambda x: lower(x.strip(SPACE))
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [i is not None and len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != i
                for x in lines]
        out.append((i, len(lines), sum(drop), "\n".join(x for x, d in zip(lines, drop) if not d)))
    return out


def base_counts(text):
    w = words(text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {p for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(hit))


def quality_filter(rows, rules=quality.Rules()):
    """(doc_id, text) -> kept (doc_id, text)"""
    out = []
    for i, t in rows:
        n, chars, _, _, rep = base_counts(t)
        good = [x for x in (t or "").split("\n") if quality.line_fails(x, rules) is None]
        lost = chars - sum(map(len, words("\n".join(good))))
        if n >= 50 and 100 * rep <= 50 * n and 100 * lost <= rules.max_loss_pct * chars:
            out.append((i, "\n".join(good)))
    return out


def contained(rows, items):
    """(doc_id, text), (item_id, text) -> {doc_id: [item_id]}"""
    out = {}
    for i, t in rows:
        w = words(lower(t))
        found = []
        for j, s in items:
            want = shingles(s)
            if not want:
                continue
            n = len(next(iter(want)))
            have = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
            if 100 * len(want & have) >= 75 * len(want):
                found.append(j)
        out[i] = found
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
