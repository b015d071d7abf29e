"""The registered query of each operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import cdc, dac, decontam, exact_dedup, lexical, licenses, mixing, nbsvm, repeats, separator_scan, simhash, trie, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.encode_table(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return nbsvm.score(docs, nbsvm.train(docs, table(spark, sf_dir, "labels")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.passages(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), repetition=2.0)
    return mixed.select("doc_id", "source", F.col("_mix_tokens").alias("n_tokens"), F.col("_mix_pass").alias("pass"), F.col("_mix_block").alias("block"), F.col("_mix_order").alias("block_order"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_scan.document_counts(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4, blocks=7)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_starts(table(spark, sf_dir, "conversations"), every=100, most=6)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(table(spark, sf_dir, "documents"), least=400)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_token_files, op3_decontaminate, op4_quality, op5_warc, op6_substring_dedup, op7_mix_sources, op8_token_counts, op9_license_scan, op10_simhash, op11_prefix_trie, op12_suffix_dedup, op13_lexical_search)
}

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
    "op3_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS phrase, least(len(w), 13) AS size
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM p),
g AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, s)),
m AS (SELECT doc_id, item_id, i, g.size FROM g JOIN p ON g.phrase = p.phrase AND g.size = p.size),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS at FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op5_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, sha256(coalesce(html, '')) AS k FROM pages),
g AS (SELECT k, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to FROM p LEFT JOIN g USING (k)""",
    "op11_prefix_trie": """
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
             xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
                 lambda crc, b: list_reduce(list_concat([xor(crc, b)], CAST(range(8) AS BIGINT[])), lambda x, bit: xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END))), CAST(4294967295 AS BIGINT)) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM c)),
r AS (SELECT k.conv_id, c.i, role, text FROM k JOIN c ON c.conv_id = k.base AND c.i <= k.h
      UNION ALL SELECT k.conv_id, 1000000 + c.i, role, text FROM k JOIN c ON c.conv_id = k.conv_id AND c.i > k.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, sha256(array_to_string(list(sha256(length(role) || ':' || role || text)) OVER w, ',')) AS key, length(text) AS size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
m AS (SELECT conv_id, 0 AS depth, '' AS key, 0 AS size FROM k UNION ALL SELECT * FROM p),
e AS (SELECT conv_id, max(depth) AS total FROM m GROUP BY conv_id),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS own,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = total), '')) AS ends_sha256
      FROM m JOIN e USING (conv_id) GROUP BY depth, key),
u AS (SELECT n.depth, n.key, n.conv_id, n.n_convs, n.own, n.ends_sha256, o.key AS above, o.conv_id AS parent_conv_id
      FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN n o ON o.depth = n.depth - 1 AND o.key = m.key),
f AS (SELECT depth - 1 AS depth, above AS key, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
t AS (SELECT u.depth, u.key, coalesce(f.n_children, 0) AS n_children, u.own FROM u LEFT JOIN f ON f.depth = u.depth AND f.key = u.key),
g AS (SELECT m.depth, m.key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(t.own) AS BIGINT) AS saved_tokens
      FROM t JOIN n ON n.depth = t.depth AND n.key = t.key JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.depth, m.key)
SELECT u.conv_id, u.depth, u.parent_conv_id, u.n_convs, t.n_children, g.n_leaves, g.saved_tokens, u.ends_sha256
FROM u JOIN t ON t.depth = u.depth AND t.key = u.key JOIN g ON g.depth = u.depth AND g.key = u.key""",
    "op13_lexical_search": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY doc_id, w, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term),
q AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
c AS (SELECT item_id, doc_id, CAST(sum(q.n * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * t.n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN t USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""",
}


def _license_sql() -> str:
    known = ", ".join(f"('{s}', '{name}')" for s, name in licenses.SENTENCES.items())
    holds = lambda ids: f"regexp_matches(line, ',{',(.*,)?'.join(ids)},')"
    held = ", ".join(f"CASE WHEN {' AND NOT '.join(map(holds, [ids, *licenses.wider_rules(ids, licenses.RULES)]))} THEN '{name}' END" for name, ids in licenses.RULES)
    norm = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
    ends = ["y", "yf", "y || ' ' || z", "y || ' ' || zf"]
    joined = ", ".join(f"{h} || ' ' || {e}" for h in ("w", "l") for e in ends)
    return rf"""
WITH k(s, name) AS (VALUES {known}),
u AS (SELECT doc_id, generate_subscripts(x, 1) AS a, unnest(x) AS s FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{licenses.ENDS}') AS x FROM documents)),
p AS (SELECT doc_id, a, {norm.format('s')} AS w, list_filter(list_transform(regexp_split_to_array(s, '[
]+'), lambda x: {norm.format('x')}), lambda x: x <> '') AS n FROM u),
m AS (SELECT doc_id, a, w, CASE WHEN len(n) > 1 THEN n ELSE [] END AS n FROM p WHERE w <> ''),
j AS (SELECT *, n[len(n)] AS l, lead(w) OVER d AS y, lead(n[1]) OVER d AS yf, lead(w, 2) OVER d AS z, lead(n[1], 2) OVER d AS zf FROM m WINDOW d AS (PARTITION BY doc_id ORDER BY a)),
v AS (SELECT doc_id, a, generate_subscripts(c, 1) AS b, unnest(c) AS s FROM (SELECT doc_id, a, list_concat([w], n, [{joined}]) AS c FROM j)),
f AS (SELECT doc_id, a, b, name FROM v JOIN k ON regexp_replace(v.s, '{licenses.LEAD}', 'under ') = k.s),
n AS (SELECT doc_id, count(*) AS n_sentences, string_agg(name, ',' ORDER BY a, b) AS ids FROM f GROUP BY doc_id),
l AS (SELECT *, ',' || ids || ',' AS line FROM n)
SELECT doc_id, array_to_string(CASE WHEN len(x) > 1 THEN list_filter(x, lambda y: y <> '{licenses.ELSE}') ELSE x END, ',') AS licenses, n_sentences, sentence_ids FROM (
SELECT d.doc_id, list_sort(list_distinct(list_filter([{held}], lambda x: x IS NOT NULL))) AS x,
       coalesce(n_sentences, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id)"""


ORACLES["op9_license_scan"] = _license_sql()
