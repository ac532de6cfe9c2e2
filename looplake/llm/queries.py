"""Registered queries of the training-data operators, with DuckDB text where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from looplake.llm import (
    alignment, chat, decontam, jaccard, langid, licenses, linededup, negatives, oddsketch, pieces, quality, toxicity, warc)
from looplake.llm.common import held_out, table


#: The public vocabulary that op8 uses.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The public byte-level vocabulary that op12 aligns with it.
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _sha256(text) -> F.Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).withColumn("held_out", held_out(F.col("doc_id")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(rows))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs)).withColumn("held_out", held_out(F.col("doc_id")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_documents(table(spark, sf_dir, "documents")).drop("clean_text")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", F.array_join("licenses", " ").alias("licenses"), F.array_join("sentence_ids", " ").alias("sentence_ids"),
        F.size("sentence_ids").cast("long").alias("n_sentences"), "n_unmatched")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "n_byte_pieces", F.xxhash64("ids").alias("ids_hash"))
    return pieces.decode_documents(encoded, VOCABULARY).select(
        "doc_id", "n_pieces", "n_byte_pieces", "ids_hash", _sha256(F.col("text")).alias("decoded_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", _sha256(F.col("kept_text")).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archive(table(spark, sf_dir, "pages"), folder := warc.shared_folder(spark, "warc"))
    return warc.read_archive(warc.merge_index(index), folder, "capture_no", "previous_page").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_no", "previous_page")


def op11_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, VOCABULARY)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0,
                          label=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_chat_format": op2_chat_format,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_line_dedup": op9_line_dedup,
    "op10_warc": op10_warc,
    "op11_odd_sketch": op11_odd_sketch,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}


def _license_sql() -> str:
    """The scan in SQL: the same fixed rules over unnested sentences, then nested replacements."""
    triggers = " OR ".join(f"contains(low, '{t}')" for t in licenses.TRIGGERS)
    ids = "CASE " + " ".join(f"WHEN regexp_matches(norm, '{p}') THEN '{n}'" for n, p in licenses.SENTENCES) + " END"
    steps, last = [], "s0 AS (SELECT doc_id, sentence_ids, coalesce('<' || replace(sentence_ids, ' ', '><') || '>', '') AS state FROM seq)"
    steps.append(last)
    hits = []
    for k, (name, parts) in enumerate(licenses.RULES):
        pattern = licenses.rule_pattern(parts)
        steps.append(f"s{k + 1} AS (SELECT * REPLACE (regexp_replace(state, '{pattern}', '|', 'g') AS state), "
                     f"CASE WHEN regexp_matches(state, '{pattern}') THEN '{name}' END AS hit{k} FROM s{k})")
        hits.append(f"hit{k}")
    found = f"list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL)"
    first = f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"
    return rf"""
WITH sent AS (SELECT doc_id, unnest(list_zip(range(1, len(c) + 1), c)) AS z FROM (SELECT doc_id, string_split(
    regexp_replace(low, '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)) AS c
    FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents) WHERE {triggers})),
norm AS (SELECT doc_id, z[1] AS pos, z[2] AS low FROM sent),
ided AS (SELECT doc_id, pos, {ids} AS id FROM (SELECT doc_id, pos, trim(regexp_replace(low, '[^a-z0-9]+', ' ', 'g')) AS norm
    FROM norm WHERE {triggers})),
seq AS (SELECT d.doc_id, s.sentence_ids FROM documents d LEFT JOIN (SELECT doc_id, string_agg(id, ' ' ORDER BY pos)
    AS sentence_ids FROM ided WHERE id IS NOT NULL GROUP BY doc_id) s USING (doc_id)),
{', '.join(steps)}
SELECT doc_id, array_to_string({first}, ' ') AS licenses, coalesce(sentence_ids, '') AS sentence_ids,
  CASE WHEN sentence_ids IS NULL THEN 0 ELSE len(string_split(sentence_ids, ' ')) END::BIGINT AS n_sentences,
  (len(state) - len(replace(state, '<', '')))::BIGINT AS n_unmatched FROM s{len(licenses.RULES)}"""


_W = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op2_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, 20 + len(role) + len(text) + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\])'))
  + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\])')) AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, false AS rewrites FROM t GROUP BY conv_id""",
    "op6_decontamination": r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT item_id, w, least(5, len(w)) AS n FROM i WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, w[k:k + n - 1] AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM iw)),
sz AS (SELECT item_id, count(*) AS size FROM ig GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, w[k:k + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
    FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, count(*) AS hits FROM dg JOIN ig USING (g) GROUP BY doc_id, item_id),
f AS (SELECT doc_id, item_id, hits / size AS share FROM m JOIN sz USING (item_id) WHERE 100 * hits >= 75 * size)
SELECT doc_id, count(item_id)::BIGINT AS n_items, coalesce(list(item_id ORDER BY item_id) FILTER (item_id IS NOT NULL), []) AS item_ids,
  coalesce(max(share), 0)::DOUBLE AS max_containment, count(item_id) > 0 AS contaminated
FROM (SELECT doc_id FROM documents) LEFT JOIN f USING (doc_id) GROUP BY doc_id""",
    "op3_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, w[k:k + n - 1] AS g FROM (SELECT doc_id, w, least(5, len(w)) AS n,
    unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM w WHERE len(w) > 0)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s sa ON a = sa.doc_id JOIN s sb ON b = sb.doc_id
    WHERE 100 * common >= 75 * (sa.n + sb.n - common)),
r AS (SELECT a AS doc_id, a AS node FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.node = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op11_odd_sketch": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, w[k:k + n - 1] AS g FROM (SELECT doc_id, w, least(4, len(w)) AS n,
    unnest(range(1, len(w) - least(4, len(w)) + 2)) AS k FROM w WHERE len(w) > 0)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s sa ON a = sa.doc_id JOIN s sb ON b = sb.doc_id
    WHERE 100 * common >= 80 * (sa.n + sb.n - common)),
r AS (SELECT a AS doc_id, a AS node FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.node = l.a),
c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  d.doc_id = coalesce(c.component_id, d.doc_id) AS kept FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL
  AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank,
  id AS negative_id, positive_score, score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 10""",
    "op5_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_W}') AS words, string_split(text, chr(10)) AS lines FROM d),
grams AS (SELECT doc_id, i, words[i:i+2] AS g FROM
  (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) >= 2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM
  (SELECT grams.doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id),
ln AS (SELECT doc_id, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
  len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM (SELECT doc_id, unnest(lines) AS line FROM w)),
lc AS (SELECT *, len(regexp_extract_all(body, '{_W}')) AS n, len(body) - len(replace(body, '|', '')) AS pipes,
  len(body) - len(replace(body, '!', '')) AS shouts, len(regexp_extract_all(body, '[#*$%&|<>]')) AS symbols FROM ln),
lf AS (SELECT doc_id, line, body, chars, body <> '' AND ((pipes >= 2 AND 4 * pipes >= n)
  OR (n < 12 AND NOT regexp_matches(body, '[.!?:;"'')\]…”’»]$')) OR 100 * symbols > 30 * n OR (100 * shouts > 30 * n AND shouts >= 3)
  OR regexp_matches(body, '{"|".join(quality.BOILERPLATE)}', 'i')) AS fails FROM lc),
l AS (SELECT doc_id, count(*) FILTER (body <> '') - coalesce(count(DISTINCT line) FILTER (body <> ''), 0) AS n_dup_lines,
  count(*) FILTER (fails) AS n_lines_removed, coalesce(sum(chars) FILTER (fails), 0) AS lost_chars
  FROM lf GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= 30 * word_chars AS kept, n_lines_removed, lost_chars FROM (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, l.n_dup_lines::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    l.n_lines_removed::BIGINT AS n_lines_removed, l.lost_chars::BIGINT AS lost_chars
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id))""",
    "op7_license_scan": _license_sql(),
    "op9_line_dedup": r"""
WITH ln AS (SELECT doc_id, pos, lines[pos] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM ln),
hot AS (SELECT key, max(doc_id) AS holder FROM k WHERE len(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (holder IS NOT NULL AND holder <> doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (holder IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\.', '') AS host,
  regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^#]*?(\?[^#]*)', 1) AS query FROM pages),
h AS (SELECT payload_digest, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest),
k AS (SELECT *, lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE path WHEN '' THEN '/' ELSE path END || query) AS url_key
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN holder <> page_id THEN holder END AS refers_to, row_number() OVER history AS capture_no, lag(page_id) OVER history AS previous_page
FROM k LEFT JOIN h USING (payload_digest) WINDOW history AS (PARTITION BY url_key ORDER BY page_id % 1000000000, page_id)""",
}
