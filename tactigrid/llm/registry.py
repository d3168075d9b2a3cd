"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactigrid.llm import chat, empirical_bayes, exact_dedup, html_text, impact_search, language, licenses, lloyd, minhash, mixing, packing, quality_rules, repair
from tactigrid.llm.common import read_table


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; see llm.language."""
    return language.identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site posteriors and verdict of every document; see llm.empirical_bayes."""
    return empirical_bayes.score(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), read_table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and divergence of every document; see llm.quality_rules."""
    measured = quality_rules.apply_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document; see llm.minhash."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best 5 of every query vector; see llm.impact_search."""
    return impact_search.top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; see llm.mixing."""
    return mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's place in the packed sequences; see llm.packing."""
    import public_tokenizers

    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; see llm.html_text."""
    return html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every conversation as canonical JSON, in order; see llm.chat."""
    return chat.format_chats(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every document; see llm.licenses."""
    return licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, cheapest edits and hash of every damaged conversation; see llm.repair."""
    return repair.audits(repair.damaged(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document; see llm.exact_dedup."""
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every usable vector; see llm.lloyd."""
    return lloyd.cluster(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id AND reach.root < links.b
), roots AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN roots USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP7_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '*') AS lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), m AS (
  SELECT doc_id, lang, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS symbols, length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) AS uppers,
         length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(t, '[^.,;:!?''"()-]', '', 'g')) AS marks,
         length(t) - length(array_to_string(w, '')) AS spaces, length(t) AS total,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM w
), x AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM m, unnest(range(1, n_words - 1)) u(i) WHERE n_words >= 3),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(3) r(k) GROUP BY doc_id),
measured AS (SELECT m.*, coalesce(covered.n, 0) AS n_repeat_words, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM m LEFT JOIN covered USING (doc_id)),
tokens AS (SELECT doc_id, lang, lower(u.word) AS word FROM m, unnest(w) u(word)),
both_langs AS (SELECT doc_id, lang FROM m WHERE lang <> '*' UNION ALL SELECT doc_id, '*' FROM m),
ref AS (
  SELECT b.lang, sum(n_words) AS words, [sum(uppers), sum(digits), sum(marks), sum(symbols), sum(spaces), sum(total - uppers - digits - marks - symbols - spaces)] AS c
  FROM both_langs b JOIN m USING (doc_id) GROUP BY b.lang HAVING sum(n_words) >= 2000
), counts AS (SELECT b.lang, word, count(*) AS n FROM both_langs b JOIN tokens t USING (doc_id) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM counts WHERE regexp_matches(word, '[\\p{L}\\p{N}]')) WHERE r <= 20),
lone AS (SELECT lang, sum(n) AS n FROM counts WHERE NOT regexp_matches(word, '[\\p{L}\\p{N}]') GROUP BY lang),
keyed AS (SELECT m.doc_id, CASE WHEN EXISTS (SELECT 1 FROM ref WHERE ref.lang = m.lang) THEN m.lang ELSE '*' END AS ref_lang FROM m),
bins AS (
  SELECT k.doc_id, 'c' AS kind, CAST([uppers, digits, marks, symbols, spaces, total - uppers - digits - marks - symbols - spaces][i] AS DOUBLE) / total AS p, CAST(c[i] AS DOUBLE) / list_sum(c) AS q
  FROM keyed k JOIN m USING (doc_id) JOIN ref ON ref.lang = k.ref_lang, range(1, 7) r(i)
  WHERE total > 0
), hits AS (SELECT k.doc_id, t.word, count(*) AS n FROM keyed k JOIN tokens t USING (doc_id) GROUP BY ALL),
known AS (
  SELECT k.doc_id, CAST(coalesce(h.n, 0) AS DOUBLE) AS own, CAST(top.n AS DOUBLE) AS other
  FROM keyed k JOIN top ON top.lang = k.ref_lang LEFT JOIN hits h ON h.doc_id = k.doc_id AND h.word = top.word
  UNION ALL
  SELECT k.doc_id, coalesce((SELECT sum(n) FROM hits h WHERE h.doc_id = k.doc_id AND NOT regexp_matches(h.word, '[\\p{L}\\p{N}]')), 0), coalesce(l.n, 0)
  FROM keyed k LEFT JOIN lone l ON l.lang = k.ref_lang
), every AS (
  SELECT * FROM known
  UNION ALL
  SELECT k.doc_id, any_value(m.n_words) - sum(own), any_value(ref.words) - sum(other) FROM known k JOIN m USING (doc_id) JOIN keyed USING (doc_id) JOIN ref ON ref.lang = ref_lang GROUP BY k.doc_id
), all_bins AS (
  SELECT * FROM bins
  UNION ALL
  SELECT e.doc_id, 'w', own / n_words, other / words FROM every e JOIN m USING (doc_id) JOIN keyed USING (doc_id) JOIN ref ON ref.lang = ref_lang WHERE n_words > 0
), js AS (
  SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS d FROM all_bins GROUP BY ALL
), judged AS (
  SELECT a.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_words >= 50 AND word_chars >= 100 THEN c.d END AS class_distance, CASE WHEN n_words >= 50 AND word_chars >= 100 THEN v.d END AS word_distance
  FROM measured a LEFT JOIN js c ON c.doc_id = a.doc_id AND c.kind = 'c' LEFT JOIN js v ON v.doc_id = a.doc_id AND v.kind = 'w'
)
SELECT doc_id, n_words, word_chars, symbols AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(class_distance > 0.27 OR word_distance > 0.35, FALSE) AS kept, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM judged
"""

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

#: Of tables without tool turns; any turn that looks like one is an error.
OP9_SQL = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position, turn, role,
       CASE WHEN role IN ('assistant', 'tool') AND ltrim(text) LIKE '{%' THEN error('a turn may hold calls or a result') ELSE 'message' END AS status,
       CAST(NULL AS VARCHAR) AS call_id, CAST(0 AS INTEGER) AS n_calls, CAST(0 AS INTEGER) AS n_answered, CAST(NULL AS BOOLEAN) AS valid,
       '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json
FROM conversations
"""

OP11_SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))),
             lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 20 AS kind
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM c, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) WHERE kind <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM d
), r AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN pos > min(pos) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS i FROM n
), told AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
), start AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS phase, '0000000000:' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM conversations
), best(conv_id, pos, phase, s0, s1, s2, s3) AS ( -- the least cost (ten digits) and audit after every row (phase 0: before, 1 and 2: after inserts) that leads to each state
  SELECT * FROM start
  UNION ALL
  SELECT b.conv_id, CASE WHEN b.phase < 2 THEN b.pos ELSE b.pos + 1 END, (b.phase + 1) % 3,
    CASE WHEN b.phase < 2 THEN s0 ELSE D(s0) END,
    CASE WHEN b.phase < 2 THEN s1 ELSE least(D(s1), CASE WHEN i = 's' THEN K(s0) END) END,
    CASE WHEN b.phase < 2 THEN least(s2, I(s0), I(s1), I(s3)) ELSE least(D(s2), R(s0), R(s1), R(s3), CASE WHEN i = 'u' THEN least(K(s0), K(s1), K(s3)) END) END,
    CASE WHEN b.phase < 2 THEN least(s3, I(s2)) ELSE least(D(s3), R(s2), CASE WHEN i = 'a' THEN K(s2) END) END
  FROM best b LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos + 1
  WHERE b.phase < 2 OR r.pos IS NOT NULL
), ends AS (
  SELECT conv_id, arg_max(least(s0, s3), pos) AS found FROM best WHERE phase = 2 GROUP BY conv_id
), audits AS (
  SELECT conv_id, CAST(left(found, 10) AS BIGINT) AS cost, found[12:] AS audit FROM ends
), edits AS (
  SELECT conv_id, audit, k, audit[k] AS e, count(*) FILTER (audit[k] <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS pos, count(*) FILTER (audit[k] <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS place, length(replace(audit, 'D', '')) AS size
  FROM audits, unnest(range(1, length(audit) + 1)) u(k)
), texts AS (
  SELECT e.conv_id, string_agg(CASE WHEN e.e = 'K' THEN r.role WHEN (place + size) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e.e = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY k) AS text
  FROM edits e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.pos = e.pos
  WHERE e.e <> 'D' GROUP BY e.conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM audits a LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def _with_costs(sql: str) -> str:
    """Write out D(x), K(x), R(x) and I(x): the audit x with one more edit, at its cost."""
    for letter, cost in (("D", "CASE WHEN fault IN ('blank', 'duplicate', 'truncated', '') THEN 4 END"), ("K", "CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 3 END"), ("R", "CASE fault WHEN '' THEN 3 WHEN 'truncated' THEN 6 END"), ("I", "3")):
        sql = re.sub(rf"\b{letter}\((s\d)\)", rf"(lpad(CAST(CAST(left(\1, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || \1[11:] || '{letter}')", sql)
    return sql


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def _op13_sql(rounds: int = 10) -> str:
    """The rounds one after the other. vc: component i of vector id (a row number); c0, c1, ...: component i of centroid k."""
    nearest = "SELECT id, arg_min(k, (d, k)) AS k, min(d) AS distance FROM (SELECT v.id, c.k, sum((v.q - c.q) * (v.q - c.q)) AS d FROM vc v JOIN c{0} c ON c.i = v.i GROUP BY v.id, c.k) GROUP BY id"
    steps = ""
    for n in range(rounds):
        steps += f""", a{n} AS MATERIALIZED ({nearest.format(n)}), s{n} AS (SELECT k, i, sum(q) AS s, count(*) AS n FROM vc JOIN a{n} USING (id) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.q) AS q FROM c{n} c LEFT JOIN s{n} s USING (k, i))"""
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, q) AS id, vec_id, q
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(least(floor(1024 * CAST(x AS DOUBLE)), 134217728), -134217728) AS BIGINT)) AS q
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), vc AS MATERIALIZED (SELECT id, i, CAST(q[i] AS HUGEINT) AS q FROM v, range(1, 65) r(i)),
c0 AS (SELECT id - 1 AS k, i, q FROM vc WHERE id <= 8){steps}, f AS MATERIALIZED ({nearest.format(rounds)}),
h AS (SELECT k, sha256(string_agg(CAST(q AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM f JOIN v USING (id) JOIN h USING (k)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_impact_search, op3_html_text, op4_packing, op5_mixing, op6_language_id, op7_quality_rules, op8_quality_classifier, op9_chat_format, op10_license_scan, op11_conversation_repair, op12_exact_dedup, op13_lloyd)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1_SQL, "op2_impact_search": OP2_SQL, "op7_quality_rules": OP7_SQL, "op9_chat_format": OP9_SQL, "op11_conversation_repair": _with_costs(OP11_SQL), "op12_exact_dedup": OP12_SQL, "op13_lloyd": _op13_sql()}
