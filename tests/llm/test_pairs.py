"""Odd sketches, tokenizer alignment and hard negatives against plain Python: nulls, empty and long
texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from looplake.llm import alignment, negatives, oddsketch
from looplake.llm.queries import BYTE_VOCABULARY, VOCABULARY, op12_tokenizer_alignment
from tests.conftest import SF_SMALL
from tests.llm import brute

CLASH = ["a", "b", "n", "h", "key", "part", "doc", "pair", "chunk", "place", "rank", "score", "window", "grp", "v", "id", "row_no"]


def with_clashes(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH))


# op11


def shingles4(text):
    w = brute.words(brute.lower(text))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def components4(rows):
    """Any text of a document may link it."""
    ids = sorted({i for i, _ in rows if i is not None})
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(shingles4(t))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return sorted(((i, len(shingles4(t)), find(i) if i is not None else None) for i, t in rows), key=repr)


def copies():
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = [(None, "a b c d e"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one  TWO"), (6, "one two three"),
            (7, "x"), (7, "x"), (8, "alpha beta gamma delta epsilon"), (8, "One TWO")]
    for _ in range(14):
        base = prose(rng.choice([5, 25, 120, 500]))
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 25, len(base) // 10])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) + 100, " ".join(copy)))
    hot = prose(60)  # a frequent passage in documents that do not link
    rows += [(1000 + k, " ".join(hot + prose(rng.choice([3, 9, 20, 200])))) for k in range(40)]
    rows.append((5000, " ".join(prose(20_000))))
    long = prose(400)  # a chain of growing texts
    rows += [(6000 + k, " ".join(long[:n])) for k, n in enumerate((84, 100, 120, 144, 175, 212, 260))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_odd_sketch_components_equal_brute_force(spark, parts):
    rows = copies()
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(parts)
    got = oddsketch.near_duplicates(df, part_docs=8, block_docs=3).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == components4(rows)
    assert all(r.kept == (None if r.doc_id is None else r.doc_id == r.component_id) for r in got)


def test_odd_sketch_empty_table(spark):
    assert oddsketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 10**6))
def test_linked_sets_stay_below_the_sketches_limit(n, seed):
    rng = np.random.default_rng(seed)
    union = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    common = -(-80 * len(union) // 100)
    order = rng.permutation(len(union))
    cut = rng.integers(common, len(union) + 1)
    a, b = np.sort(union[order[:cut]]), np.sort(np.concatenate([union[order[:common]], union[order[cut:]]]))
    bits = [np.frombuffer(oddsketch.odd_sketch(s), np.uint64) for s in (a, b)]
    assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= oddsketch.limit(min(len(a), len(b)), 80)


def test_a_sketch_is_the_parity_of_its_samples():
    s = np.sort(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    least = {}
    for h in s.tolist():
        least[h >> 54] = min(h, least.get(h >> 54, h))
    flips = Counter(int(x) for x in (oddsketch._scatter(np.array(sorted(least.values()), np.uint64) * oddsketch._PLACE[0]) >> oddsketch._TOP))
    bits = np.unpackbits(np.frombuffer(oddsketch.odd_sketch(s), np.uint8))
    assert [flips[k] % 2 for k in range(oddsketch.BITS)] == bits.tolist()


# op12


def align_brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, letters = Tokenizer.from_file(BYTE_VOCABULARY), alignment.byte_letters()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    made, counts = [], Counter()
    for i, t in rows:
        groups = []
        if t:
            left = [(k, bytes(letters[c] for c in a.id_to_token(k))) for k in a.encode(" " + t, add_special_tokens=False).ids]
            right = [(k, bytes([k - 3]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(t)]
            if b"".join(x for _, x in left) == b"".join(x for _, x in right) == (" " + t).encode():
                ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (left, right)]
                common = sorted(set(ends[0]) & set(ends[1]))
                groups = [([], []) for _ in common]
                for s, side in enumerate((left, right)):
                    for (k, _), e in zip(side, ends[s], strict=True):
                        groups[bisect.bisect_left(common, e)][s].append(k)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        counts.update(links.keys())
        made.append((i, groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], counts[x, _])
    return sorted(((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()),
                    hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
                    if groups else "") for i, groups, links in made), key=repr)


def odd_texts():
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, " "), (4, "  two  blanks "), (5, "tab\t and \n lines\n\n end "), (6, "<s> </s> <|endoftext|> [INST] <0x41> <unk>"),
            (7, "▁marker in the text"), (8, "漢字かな 🦊🦊 é   　x"), (9, "don't we'll it's"), (9, "don't we'll it's"), (None, "no id"),
            (10, "=" * 3000 + " " * 500 + "ab" * 2000), (11, "\x00\x01  x \x85y"), (12, "ﬁ ² ℃ fullwidth ＡＢＣ")]
    for k in range(400):
        rows.append((100 + k, "".join(rng.choice(["a", "b", "é", "漢", " ", " ", "\n", "the ", " thing", "'s", "1", "22", ".", "\t", "　", "🦊"])
                                      for _ in range(rng.randrange(30)))))
    rows.append((900, " ".join(rng.choice(["alpha", "beta,", "Gamma.", "x1"]) for _ in range(30_000))))
    return rows


@pytest.mark.parametrize("chunk", [200, 1_000_000])
def test_alignment_equals_brute_force(spark, chunk):
    rows = odd_texts()
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got = alignment.align(df, BYTE_VOCABULARY, VOCABULARY, chunk_chars=chunk, chunk_docs=100).collect()
    assert sorted(map(tuple, got), key=repr) == align_brute(rows)


def test_alignment_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, op12_tokenizer_alignment(spark, SF_SMALL).collect()), key=repr) == align_brute(rows)


def test_alignment_of_large_groups_counts_every_link():
    lists = pa.array([[7, 8] * 300, [9]], pa.list_(pa.int32()))
    a, b = alignment.Side(lists, np.ones(20, np.int64)), alignment.Side(lists, np.ones(20, np.int64))
    group = np.array([0] * 600 + [1])
    got = {(r["doc"], r["pair"] >> 32, r["pair"] & 0xFFFF): r["n"] for r in alignment.links_of(a, b, group, group, 2).to_pylist()}
    assert got == {(0, x, y): 90_000 for x in (7, 8) for y in (7, 8)} | {(1, 9, 9): 1}


def test_alignment_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), BYTE_VOCABULARY, VOCABULARY).count() == 0


# op13


def mine_brute(rows, anchor, n_pos=5, n_neg=10, low=30, high=90):
    sound = [(i, v, lab) for i, v, lab in rows if i is not None and lab is not None and v is not None
             and all(x is not None and np.isfinite(x) for x in v)]
    sound = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], lab) for i, v, lab in sound]
    out = []
    for i, v, lab in sound:
        if not anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, k) for j, w, k in sound if j != i)
        for p, j, _ in [s for s in scored if s[2] == lab][:n_pos]:
            fit = [s for s in scored if s[2] != lab and low * -p <= 100 * -s[0] <= high * -p][:n_neg]
            out += [(i, j, r, s[1], -p, -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(4)
    rows = [(None, [1.0, 0.0], 1), (50, None, 1), (51, [None, 1.0], 1), (52, [float("nan"), 1.0], 2), (53, [float("inf"), 1.0], 2),
            (54, [1.0], None), (55, [], 1), (56, [0.5], 2), (100, [0.0] * 6, 1)]
    for k in range(260):
        v = rng.normal(size=6)
        rows.append((200 + k, (v / np.linalg.norm(v) * rng.choice([0.3, 1.0, 1.0, 2.0])).tolist(), int(rng.integers(0, 3))))
    same = rng.normal(size=6).tolist()  # a frequent vector: ties on every score
    rows += [(600 + k, same, k % 3) for k in range(80)]
    rows += [(700, same, 1), (700, same, 1), (700, [-x for x in same], 2), (800, [-x for x in same], 9)]
    return rows


@pytest.mark.parametrize("block_rows,batch_anchors", [(17, 3), (32768, 64)])
def test_hard_negatives_equal_brute_force(spark, block_rows, batch_anchors):
    rows = vectors()
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, block_rows=block_rows, batch_anchors=batch_anchors)
    got = got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, got)) == mine_brute(rows, lambda i: i % 10 == 0)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 30), st.sampled_from([0.8, 0.42, 0.17, 0.0, -np.inf]), st.integers(0, 10**6))
def test_threshold_join_finds_every_pair(rows, width, theta, seed):
    rng = np.random.default_rng(seed)
    x, q = (np.floor(256 * rng.normal(size=(n, width)) * rng.choice([0.1, 1, 3], size=(n, 1))).astype(np.int64) for n in (rows, 5))
    block = negatives.Block(np.arange(rows), np.zeros(rows, np.int64), x)
    norms = np.sqrt((q.astype(float) ** 2).sum(1)) * block.largest
    least = np.ceil(theta * norms * (1 + 1e-9)) if theta > 0 else np.full(5, theta if theta < 0 else 0.0)
    a, r, s = block.at_least(q, least, theta)
    want = q @ x.T
    assert sorted(zip(a.tolist(), r.tolist(), s.tolist())) == [(i, j, int(want[i, j])) for i in range(5) for j in range(rows) if want[i, j] >= least[i]]


def test_hard_negatives_of_large_components_raise(spark):
    df = spark.createDataFrame([(0, [1e12, 1.0], 1), (1, [1e12, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="2\\^53"):
        negatives.mine(df, F.col("vec_id") == 0).collect()


def test_hard_negatives_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(df, F.col("vec_id") % 100 == 0).count() == 0
