"""Edge cases of the training-data operators against plain Python: nulls, empty and long texts,
ties, repeated rows, empty tables, extra columns with clashing names."""

import gzip
import hashlib
import random
import re

import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from looplake.llm import chat, components, decontam, jaccard, langid, licenses, linededup, pieces, quality, toxicity, warc
from looplake.llm.common import shared_folder
from looplake.llm.queries import VOCABULARY
from tests.llm import brute

CLASH = ["lines", "h1", "n", "drops", "pos", "line", "score", "rep", "ids", "block", "digest", "holder", "low", "state", "row"]


def docs_frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH))


def prose(rng, n, vocab=4000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def near_copies():
    rng = random.Random(5)
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one  TWO"), (6, "one two three"),
            (7, "x"), (7, "x")]
    for family in range(12):
        base = prose(rng, rng.choice([6, 30, 120, 400])).split()
        for _ in range(rng.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 20, len(base) // 8])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) + 100, " ".join(copy)))
    hot = prose(rng, 40)
    rows += [(1000 + k, hot + " " + prose(rng, rng.choice([3, 9, 200]))) for k in range(40)]
    rows.append((5000, prose(rng, 20_000)))
    long = prose(rng, 400)  # a chain of growing texts: the ends do not link, not even by size
    rows += [(6000 + k, " ".join(long.split()[:n])) for k, n in enumerate((84, 104, 124, 154, 190, 235, 290))]
    rng.shuffle(rows)
    return rows


def test_jaccard_components_equal_brute_force(spark):
    rows = near_copies()
    for parts in (1, 5):
        got = jaccard.near_duplicates(docs_frame(spark, rows).repartition(parts), heavy_from=4, part_docs=8, block_docs=3).collect()
        assert sorted((r.doc_id, (r.n_shingles, r.component_id)) for r in got if r.doc_id is not None) == \
            sorted(brute.components([r for r in rows if r[0] is not None]).items())
        assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(2, None)]


def test_jaccard_threshold_is_exact():
    assert jaccard.linked(4, 3, 3) and not jaccard.linked(100, 100, 85) and jaccard.linked(100, 100, 86)
    assert [jaccard.required(n) for n in (1, 4, 5)] == [1, 3, 4]


def test_jaccard_empty_table(spark):
    assert jaccard.near_duplicates(docs_frame(spark, [])).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


LINES = ["This very line stands in many documents.", "  this VERY line stands in many documents.\t", "short", "",
         "Twenty characters ab", "Another shared line of some length"]


def line_rows():
    rng = random.Random(3)
    rows = [(None, LINES[0]), (1, None), (2, ""), (3, "\n\n"), (4, LINES[0] + "\n" + LINES[0]), (4, LINES[0] + "\n" + LINES[0]),
            (9999, "\n".join(f"a line of its own, number {k}" for k in range(20_000)))]
    return rows + [(k, "\n".join(rng.choice([*LINES, f"own line number {rng.random()}"]) for _ in range(rng.randrange(6))))
                   for k in range(5, 60)]


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup_equals_brute_force(spark, batches):
    rows = line_rows()
    got = linededup.dedup_lines(docs_frame(spark, rows), batches=batches, carry=("lines", "drops")).collect()
    key = lambda r: (r[0] is None, *r)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=key) == sorted(brute.dedup(rows), key=key)
    assert {tuple(r.carried) for r in got} == {("x", "x")}
    assert linededup.dedup_lines(docs_frame(spark, [])).count() == 0


def test_quality_counts_and_verdicts(spark):
    good = "\n".join(" ".join(f"word{k}x{j}" for j in range(12)) + "." for k in range(10))
    rows = [(None, good), (1, None), (2, ""), (3, good), (3, good), (4, good + "\nHome | News | Sport | About | Login"),
            (5, "a b c " * 30 + "."), (6, "Home | News | Sport\n" * 40), (7, "\n".join(f"A{k}!! B{k}!! C{k}!!" for k in range(40))),
            (8, "aa aa aa aa"), (9, prose(random.Random(1), 200_000) + "."), (10, "x y z " * 60 + ".")]
    got = {r.doc_id: r for r in quality.clean_documents(docs_frame(spark, rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_counts(t)
    assert {i for i, r in got.items() if r.kept} == {None, 3, 4, 9}
    assert got[4].clean_text == good and got[4].n_lines_removed == 1
    kept = quality.filter_documents(docs_frame(spark, rows).withColumn("n_chars", F.lit(0)))
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in kept.collect()) == \
        sorted((i or 0, t, len(t)) for i, t in brute.quality_filter(rows))
    assert quality.clean_documents(docs_frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30))
def test_repeated_words(words):
    assert quality.repeated_words([w.encode() for w in words]) == brute.base_counts(" ".join(words))[4]


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 9, 20, 33, 60, 200])] + [(50, None), (51, ""), (None, "only this"),
                                                                                         (52, prose(rng, 20))]
    items += [items[8], (60, items[8][1])]
    rows = [(None, items[7][1]), (1, None), (2, ""), (3, prose(rng, 5000))]
    for k, (_, t) in enumerate(items):
        for damage in (0, 1, 2, 4):
            w = (t or "").upper().split()
            for _ in range(damage if len(w) > 8 else 0):
                w[rng.randrange(len(w))] = "changed"
            rows.append((10 * k + damage + 100, prose(rng, 3000) + "\n" + " ".join(w) + "\t" + prose(rng, 50)))
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    want = brute.contained(rows, items)
    for block in (20_000, 4):
        got = decontam.find_items(docs_frame(spark, rows), frame, block_items=block).collect()
        for r in got:
            assert r.item_ids == sorted(j for j in want[r.doc_id] if j is not None), r.doc_id
            assert r.contaminated == bool(want[r.doc_id]) and r.n_items == len(want[r.doc_id])
        kept = decontam.drop_contaminated(docs_frame(spark, rows), frame, block_items=block)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, f in want.items() if not f)
    assert not any(r.contaminated for r in decontam.find_items(docs_frame(spark, rows), frame.limit(0)).collect())
    assert decontam.find_items(docs_frame(spark, []), frame).count() == 0


def test_pieces_equal_public_library(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    v = pieces.load(VOCABULARY)
    model = pb.ModelProto()
    with open(VOCABULARY, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the same pieces as a unigram model
    values = iter(v.scores)
    score = {}
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = score[i] = next(values)
    public = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = ["", " ", "Hello world", "  two  blanks  ", "line\nbreak\ttab", "Ünïcode ﷽ \U0001F600", "x" * 5000, "no", "$$$ %%%",
             *(prose(random.Random(k), 50) for k in range(10))]
    rows = [(None, None), *enumerate(texts), (0, "")]
    encoded = pieces.encode_documents(docs_frame(spark, rows), VOCABULARY)
    got = {r.doc_id: r for r in encoded.collect()}
    cost = lambda ids: sum(score.get(i, 0) for i in ids)
    for i, t in enumerate(texts):
        want = public.encode(t)
        assert got[i].ids == want or abs(cost(got[i].ids) - cost(want)) < 1e-3, t
        assert got[i].n_byte_pieces == sum(public.is_byte(x) for x in want)
    back = pieces.decode_documents(encoded, VOCABULARY).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t or "") for i, t in rows}
    assert got[None].ids == []
    assert pieces.encode_documents(docs_frame(spark, []), VOCABULARY).count() == 0


def test_double_array_holds_its_keys():
    keys = sorted({bytes(random.Random(k).choices(range(256), k=1 + k % 5)) for k in range(500)})
    t = pieces.DoubleArray(keys)
    for i, key in enumerate(keys):
        s = 0
        for c in key:
            n = t.base[s] + c + 1
            assert t.check[n] == s
            s = n
        assert t.value[s] == i


PAGES = [(1, "http://www.a.com/x", "p" * 2000), (2, "http://a.com/x#frag", "p" * 2000), (3, "http://b.a.com/", "p" * 2000), (4, None, None),
         (5, "", "small"), (6, "not a url [", "small"), (None, "http://a.com", "p" * 2000), (7, "http://a.com/\nz", "é" * 600),
         (7, "http://a.com/y", "é" * 600), (-8, "http://z.org", "q" * 999), (9, "http://z.org", "q" * 999), (10, "http://z.org", "\r\n\r\n" * 500)]


def test_warc_round_trip_and_merge(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("x")).repartition(3)
    folder = shared_folder(spark, "warc")
    index = warc.write_archive(pages, folder, roll_bytes=1500)
    got = warc.read_archive(index, folder, payload=True).collect()
    assert len(got) == len(PAGES)
    same = lambda h: (hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode()))
    for page, _, html in PAGES:
        rows = [r for r in got if r.page_id == page and r.payload_digest == same(html)[0]]
        assert rows and all(r.payload_bytes == same(html)[1] for r in rows)
        for r in rows:
            if page in (1, 2):
                assert (r.record_type, r.refers_to, r.payload) == ("revisit", 3, None)
            else:
                assert (r.record_type, r.refers_to, bytes(r.payload).decode()) == ("response", None, html or "")
    merged = warc.merge_index(index).collect()
    key = lambda r: (r.url_key, r.captured, r.page_id is not None, r.page_id or 0)
    assert [key(r) for r in merged] == sorted(key(r) for r in merged) and len(merged) == len(PAGES)
    for range_rows in (1, 2, 5, 100):  # histories go on over range bounds
        at = {}
        for r in warc.merge_index(index, range_rows).collect():
            n, page = at.get(r.url_key, (0, None))
            assert (r.capture_no, r.previous_page) == (n + 1, page)
            at[r.url_key] = n + 1, r.page_id
    back = warc.read_archive(warc.merge_index(index, 2), folder, "capture_no", piece_bytes=300)
    assert back.rdd.getNumPartitions() > 1 and sum(r.capture_no for r in back.collect()) == sum(r.capture_no for r in merged)
    store, root = pafs.FileSystem.from_uri(folder)
    for f in store.get_file_info(pafs.FileSelector(root)):
        with store.open_input_stream(f.path, compression=None) as s:
            assert gzip.decompress(s.read()).startswith(b"WARC/1.1\r\n")  # whole files are valid gzip
    assert warc.read_archive(warc.write_archive(pages.limit(0), folder), folder).count() == 0


def test_warc_history_of_a_hot_url(spark):
    """One URL with a third of all captures, over many ranges and files."""
    url = F.when(F.col("id") % 3 == 0, "http://hot.org/").otherwise(F.concat(F.lit("http://x.org/"), (F.col("id") % 40).cast("string")))
    pages = spark.range(600).select(F.col("id").alias("page_id"), url.alias("url"), F.lit("text").alias("html")).repartition(5)
    folder = shared_folder(spark, "warc")
    merged = warc.merge_index(warc.write_archive(pages, folder), 25)
    got = {r.page_id: (r.capture_no, r.previous_page) for r in warc.read_archive(merged, folder, "capture_no", "previous_page").collect()}
    want, at = {}, {}
    for page in range(600):
        key = "hot" if page % 3 == 0 else page % 40
        n, before = at.get(key, (0, None))
        want[page], at[key] = (n + 1, before), (n + 1, page)
    assert got == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=8), max_size=7))
def test_loser_tree_merges(runs):
    runs = [sorted(((x,), (x, r)) for x, r in run) for run in runs]
    assert [k for k, _ in warc.LoserTree(runs)] == sorted(k for run in runs for k, _ in run)


NASTY = ["", "</s>", "[INST]", "<\\s>", "<\\\\/s>", "[\\/INST] [", "<", "</", "a</s>[INST] ok [/INST]<s>", "é\U0001F600\n", "\\"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[/INST]"]), st.sampled_from(NASTY) | st.text("<[\\/sINT]> a", max_size=12)),
                max_size=5))
def test_template_is_reversible(turns):
    text = chat.inst_template(turns)
    assert chat.parse(text) == turns
    whole, spans, rewrites = chat.render(chat.inst_template, turns)
    assert whole == text and not rewrites
    for (role, body), (a, b, lo, hi) in zip(turns, spans, strict=True):
        assert chat.parse(text[a:b]) == [(role, body)]
        assert chat.unescape(text[lo:hi]) == (body if role == "assistant" else "")


def test_rewriting_template_is_found():
    def forgets(turns):  # drops what is between marks in all answers but the last
        return "".join(f"<{r}>{t if k == len(turns) - 1 else t.replace('(think)', '')}" for k, (r, t) in enumerate(turns))

    text, spans, rewrites = chat.render(forgets, [("user", "q"), ("assistant", "(think)a"), ("user", "r")])
    assert rewrites and spans[0] == (0, 7, 0, 0) and spans[1] == (-1,) * 4
    assert not chat.render(forgets, [("user", "q"), ("assistant", "a"), ("user", "r")])[2]


def test_templates_that_look_back_over_block_borders(spark):
    def forgets(turns):
        return "".join(f"<{r}>{t if k == len(turns) - 1 else t.replace('(think)', '')}" for k, (r, t) in enumerate(turns))

    def system(turns):  # every answer repeats the first turn
        return "".join(f"<{r}>{t}{turns[0][1] if r == 'assistant' else ''}" for r, t in turns)

    def parity(turns):
        return "".join(f"<{k % 3}{r}>{t}" for k, (r, t) in enumerate(turns))

    def counts(turns):  # rewrites from the first character on
        return f"{len(turns)}:" + "".join(f"<{r}>{t}" for r, t in turns)

    turns = {1: [("system", "be kind")] + [("user", f"q{k}") if k % 2 == 0 else ("assistant", f"(think)a{k}") for k in range(1, 140)],
             2: [("assistant", "(think)a"), ("user", "r")], 3: [("user", "q"), ("assistant", "a")] * 70}
    frame = spark.createDataFrame([(c, k, *t) for c, ts in turns.items() for k, t in enumerate(ts)],
                                  "conv_id long, turn long, role string, text string")
    for template in (forgets, system, parity, counts):
        for block in (1, 64):
            got = chat.format_conversations(frame, template, block).collect()
            for conv, ts in turns.items():
                text, spans, rewrites = chat.render(template, ts)
                blocks = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.block)
                assert [r.block for r in blocks] == list(range((len(ts) - 1) // block + 1))
                assert "".join(r.text for r in blocks) == text == template(ts)
                assert all(r.rewrites == rewrites for r in blocks)
                starts = [sum(len(r.text) for r in blocks[:k]) for k in range(len(blocks))]
                assert [tuple(x + a if x >= 0 else x for x in s) for a, r in zip(starts, blocks) for s in r.spans] == spans
                assert all(0 <= s.start <= s.end <= len(r.text) for r in blocks for s in r.spans if s.start >= 0)
    last = chat.format_conversations(frame.where("conv_id = 2"), forgets, 1).orderBy("block").collect()[-1]
    assert last.text.endswith("<user>r") and last.rewrites


def test_chat_blocks_and_edges(spark):
    rng = random.Random(2)
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"),
            (2, 5, "system", None)]
    rows += [(3, k * rng.choice([1, 1, 1]) + (500 if k > 90 else 0), rng.choice(["user", "assistant"]), rng.choice(NASTY) + str(k))
             for k in range(200)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("x"))
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        want[conv] = (len(turns), brute.sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)),
                      brute.sha("".join(x for *_, r, x in turns if r == "assistant")),
                      len(chat.inst_template([(r, x) for *_, r, x in turns])))
    for block in (1, 7, 1000):
        got = chat.read_back(chat.format_conversations(frame, block_turns=block)).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_sha256, r.formatted_chars) for r in got} == want
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, 60) + (" Blarg snorf!" if k % 3 == 0 else "") + " " + prose(rng, 30)) for k in range(300)]
    labels = [(k, 1, int(k % 3 == 0)) for k in range(300)] + [(None, 1, 1), (5, None, None), (3, 0, 0)]
    extra = [(None, "blarg"), (1001, None), (1002, ""), (1003, "You BL4RG ѕnоrf"), (1004, "blargs snorfing"), (1005, prose(rng, 200_000)),
             (1006, "b​larg snorf " + prose(rng, 20))]
    docs, marks = docs_frame(spark, rows + extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    assert len(got) == len(rows + extra) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[k].predicted == int(k % 3 == 0) for k in range(300))
    assert got[1003].predicted == got[1006].predicted == 1
    assert got[1001].score == got[1002].score == got[1005].score < 0.5 and got[1004].n_matches in (0, 2)
    none = toxicity.learn(docs, marks.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs_frame(spark, []), lexicon).count() == 0


def test_toxicity_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"trash": 2.0}, {"idio": 3.0}, ("trash can",))
    a = lexicon.automaton()
    assert [w for *_, w in toxicity.matches(a, toxicity.fold("1D10T tr4$h"))] == [3.0, 2.0]
    assert toxicity.matches(a, toxicity.fold("a trash can, trashy, xidiot")) == []


def test_language(spark):
    rng = random.Random(6)
    speak = {"aa": "lorem dolor amet sit", "bb": "zwik krapt snel vreugd", "cc": "ñandu cañon señal"}
    rows = [(k, " ".join(rng.choices(speak[x].split(), k=30)), x) for k in range(300) for x in [rng.choice(list(speak))]]
    rows += [(None, "lorem dolor", "aa"), (900, None, "aa"), (901, "", "bb"), (902, "12 34 !", None), (903, "snel " * 70_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[:300])
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902)) and got[903].lang_pred == "bb"
    mixed = spark.createDataFrame([(1, "lorem dolor amet sit lorem zwik krapt snel vreugd snel"), (2, None)], "doc_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in langid.label_words(mixed, model).collect()}
    assert spans == {1: [("aa", 0, 5), ("bb", 5, 5)], 2: []}
    empty = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    e, t, s = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    paths = list(itertools.product(range(3), repeat=4))
    weight = np.array([np.exp(s[p[0]] + sum(e[0, i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))) for p in paths])
    gamma, log_z, pairs = langid.marginals(e, np.ones((1, 4), bool), t, s)
    assert np.isclose(log_z[0], np.log(weight.sum()))
    for i in range(4):
        for y in range(3):
            assert np.isclose(gamma[0, i, y], weight[[p[i] == y for p in paths]].sum() / weight.sum())
    assert np.isclose(pairs[0, 1], sum(w * sum((a, b) == (0, 1) for a, b in zip(p, p[1:])) for p, w in zip(paths, weight)) / weight.sum())


def test_licenses(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software. The above copyright\n"
           "notice and this permission notice shall be included in all copies.")
    rows = [(None, "All rights reserved."), (1, None), (2, ""), (3, mit), (3, mit), (4, "Released under the MIT License."),
            (5, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
            (6, "This work is licensed under the GNU General Public License, version 3."), (7, "Licensed under CC BY-NC 4.0."),
            (8, "Copyright (c) 2020 X. All rights reserved."), (9, "word " * 100_000 + "SPDX-License-Identifier: MIT")]
    got = {r.doc_id: r for r in licenses.scan(docs_frame(spark, rows)).collect()}
    assert {i: r.licenses for i, r in got.items()} == {
        None: ["All-Rights-Reserved"], 1: [], 2: [], 3: ["MIT"], 4: ["MIT"], 5: ["Apache-2.0"], 6: ["GPL-3.0"], 7: ["CC-BY-NC"],
        8: ["All-Rights-Reserved"], 9: ["MIT"]}
    assert got[3].sentence_ids == ["MIT_GRANT", "MIT_NOTICE"] and got[3].n_unmatched == 0
    assert licenses.scan(docs_frame(spark, [])).count() == 0


def test_licenses_in_wrapped_sentences(spark):
    rows = [(1, "All rights\nreserved."), (2, "Released into the public\n# domain."), (3, "ALL-RIGHTS-RESERVED"),
            (4, "Dedicated to the public-domain."), (5, "Available under CC\nBY 4.0."),
            (6, "Released under the Creative\nCommons Attribution-ShareAlike 4.0."), (7, "All rights are\nreserved.")]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs_frame(spark, rows)).collect()}
    assert got == {1: ["All-Rights-Reserved"], 2: ["Public-Domain"], 3: ["All-Rights-Reserved"], 4: ["Public-Domain"],
                   5: ["CC-BY"], 6: ["CC-BY-SA"], 7: []}


def test_all_licences_of_headers(spark):
    tag = "SPDX-License-Identifier: "
    spdx = {"ISC": "ISC", "AGPL-3.0-only": "AGPL-3.0", "LGPL-2.1-or-later": "LGPL", "GPL-1.0-only": "GPL", "MPL-2.0": "MPL-2.0",
            "CC-BY-NC-SA-4.0": "CC-BY-NC-SA", "CC-BY-NC-4.0": "CC-BY-NC", "CC-BY-SA-4.0": "CC-BY-SA", "CC-BY-4.0": "CC-BY",
            "CC0-1.0": "Public-Domain", "GPL-2.0+": "GPL-2.0", "GPL-3.0-or-later": "GPL-3.0", "MIT": "MIT",
            "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause"}
    rows = [(1, f"# {tag}MIT\n# {tag}Apache-2.0\n"), (2, f"{tag}MIT OR Apache-2.0"), (3, "Licensed under CC BY 4.0\nAll rights reserved"),
            (4, f"// {tag}(MPL-2.0 AND\n// (LGPL-2.1-or-later OR ISC))\nint x;"), (5, f"/* {tag}GPL-2.0 WITH Classpath-exception-2.0 */"),
            (6, f"{tag}ISC\nCopyright (c) 2020 A\nCopyright 2021 B\nAll rights reserved"), (7, "All rights reserved\nReleased under the MIT License"),
            (8, "Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted, provided that the "
                "above\ncopyright notice and this permission notice appear in all copies."), (9, f"{tag}CC-BY-ND-4.0"),
            (10, "You should have received a copy of the GNU General Public License"), (11, f"{tag}MIT/Apache-2.0"),
            (12, f"text {tag}\nMIT and {tag}ISC")]
    rows += [(100 + i, tag + x) for i, x in enumerate(spdx)]
    got = {r.doc_id: r for r in licenses.scan(docs_frame(spark, rows)).collect()}
    assert {i: r.sentence_ids for i, r in got.items() if i < 100} == {
        1: ["SPDX_MIT", "SPDX_APACHE2"], 2: ["SPDX_MIT", "SPDX_APACHE2"], 3: ["CCBY_REF", "RESERVED"],
        4: ["SPDX_MPL2", "SPDX_LGPL", "SPDX_ISC"], 5: ["SPDX_GPL2"], 6: ["SPDX_ISC", "COPYRIGHT", "COPYRIGHT", "RESERVED"],
        7: ["RESERVED", "MIT_REF"], 8: ["ISC_GRANT", "ISC_NOTICE"], 9: [], 10: ["GPL_COPY"], 11: ["SPDX_MIT", "SPDX_APACHE2"],
        12: ["SPDX_MIT", "SPDX_ISC"]}
    assert {i: (set(r.licenses), r.n_unmatched) for i, r in got.items() if i < 9} == {
        1: ({"MIT", "Apache-2.0"}, 0), 2: ({"MIT", "Apache-2.0"}, 0), 3: ({"CC-BY", "All-Rights-Reserved"}, 0),
        4: ({"MPL-2.0", "LGPL", "ISC"}, 0), 5: ({"GPL-2.0"}, 0), 6: ({"ISC", "All-Rights-Reserved"}, 1),
        7: ({"MIT", "All-Rights-Reserved"}, 0), 8: ({"ISC"}, 0)}
    assert [got[100 + i].licenses for i in range(len(spdx))] == [[x] for x in spdx.values()]


def test_every_licence_sentence_has_a_word():
    for _, pattern in licenses.SENTENCES + licenses.SPDX_SENTENCES:
        plain = pattern.replace("[sc]", "s")
        # without optional parts and alternatives, a word must be left in every reading
        if not any(w in re.sub(r"\([^()]*\)", "", plain) for w in licenses.WORDS):
            parts = re.findall(r"\(([^()]*\|[^()]*)\)", plain)
            assert any(all(any(w in x for w in licenses.WORDS) for x in p.split("|")) for p in parts), pattern


def test_line_dedup_of_repeated_ids_keeps_each_rows_own_lines(spark):
    common = "a line that three documents share"
    rows = [(1, f"unique first line that must stay here\n{common}"), (1, f"{common}\nanother unique line that has to stay")]
    rows += [(k, common) for k in (2, 3, 4)] + [(1, None), (1, f"{common}\n{common}")]
    got = linededup.dedup_lines(docs_frame(spark, rows)).collect()
    key = lambda r: (r[0], r[3], r[1])
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=key) == sorted(brute.dedup(rows), key=key)


def test_encoder_forgets_the_older_half_and_segments_long_words(spark):
    encoder = pieces.Encoder(v := pieces.load(VOCABULARY))
    rng = random.Random(9)
    pieces._WORDS[v.key] = encoder.cache = {}
    old, pieces.CACHE_WORDS = pieces.CACHE_WORDS, 50
    try:
        for _ in range(12):
            texts = [" ".join("".join(rng.choice("abé漢1.") for _ in range(rng.choice([1, 3, 8, 40, 300]))) for _ in range(20))
                     for _ in range(3)]
            want = [b"".join(pieces.np.array(pieces.viterbi(v, (pieces.MARK + w).encode()), "int32").tobytes() for w in t.split(" "))
                    for t in texts]
            assert encoder.encode_many(texts) == want
        assert all(len(w) <= pieces.CACHED_CHARS for w in encoder.cache)
    finally:
        pieces.CACHE_WORDS = old
        pieces._WORDS.clear()
