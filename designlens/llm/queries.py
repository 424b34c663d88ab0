"""The registered queries of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from designlens.llm import conversation, decontaminate, html_text, language_id, merkle, near_dedup, quality, token_store, topk_search, unigram, url_filter, warc


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judged(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audited_pages(_table(spark, sf_dir, "pages"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages")).drop("ratio")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encoded_digest(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "lang", "lid_lang", "lid_posterior", F.col("lid_kept").alias("kept"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4, threshold=0.8)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_documents(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digest(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair_digest(conversation.damage(_table(spark, sf_dir, "conversations")))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_benchmark_decontamination, op3_token_counts, op4_warc_audit, op5_url_filters, op6_html_extraction, op7_sentencepiece, op8_language_id, op9_minhash_near_dedup, op10_token_output, op11_merkle_manifest, op12_conversation_repair, op13_exact_topk)
}

_OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS k(k) WHERE c > 1 GROUP BY r
), m AS (
  SELECT w.r, doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(regexp_extract_all(t, '!!')) AS n_shouts,
         len(regexp_extract_all(t, '\p{Lu}')) AS n_capitals
  FROM w LEFT JOIN rep ON w.r = rep.r
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 10 * n_shouts > n_words OR 10 * n_capitals > 3 * word_chars) AS kept
FROM b
"""

_OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.y = p.x
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON w.doc_id = c.x
"""

#: Unsigned crc32 of the bytes of an ASCII string ``s``.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({s}, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

_FIELD = "coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"

_OP11 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g,
         {" || ".join(_FIELD.format(v=v) for v in ("doc_id", "source", "lang", "n_chars"))} AS head, text,
         coalesce({_CRC32.format(s="doc_id::VARCHAR")} % 3 = 0, false) AS tampered FROM documents
), l AS (
  SELECT r, doc_id, g, sha256(head || {_FIELD.format(v="text")}) AS leaf, tampered,
         sha256(head || {_FIELD.format(v="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS changed FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM l
), t(g, lv, i, h) AS (
  SELECT g, 0, i, leaf FROM p
  UNION ALL
  SELECT g, lv + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM t) WHERE m > 1 GROUP BY g, lv, i // 8
), top AS (
  SELECT g, h AS subroot FROM t QUALIFY row_number() OVER (PARTITION BY g ORDER BY lv DESC) = 1
), u(lv, i, h) AS (
  SELECT 0, row_number() OVER (ORDER BY g) - 1, subroot FROM top
  UNION ALL
  SELECT lv + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS m FROM u) WHERE m > 1 GROUP BY lv, i // 8
), n AS (
  SELECT g, lv, i, h FROM t
  UNION ALL
  SELECT top.g, depth + 1 + u.lv, u.i, u.h FROM u, (SELECT g, max(lv) AS depth FROM t GROUP BY g) top
), place AS (
  SELECT g, max(lv) AS depth, (SELECT count(*) FROM top x WHERE x.g < t.g) AS gi FROM t GROUP BY g
), step AS (
  SELECT p.r, p.doc_id, p.g, p.leaf, CASE WHEN tampered THEN changed ELSE leaf END AS found, depth,
         unnest(range(0, depth + (SELECT max(lv) FROM u))) AS lv, p.i, gi FROM p JOIN place ON p.g = place.g
), s AS (
  SELECT r, doc_id, g, found, lv, CASE WHEN lv < depth THEN i // (8 ** lv)::BIGINT ELSE gi // (8 ** (lv - depth))::BIGINT END AS own, depth FROM step
), sib AS (
  SELECT s.r, s.lv, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i < own), '') AS a, coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i > own), '') AS b
  FROM s JOIN n ON s.g = n.g AND n.lv = CASE WHEN s.lv < depth THEN s.lv ELSE s.lv + 1 END AND n.i // 8 = own // 8 GROUP BY s.r, s.lv
), f(r, lv, h) AS (
  SELECT r, 0, CASE WHEN tampered THEN changed ELSE leaf END FROM p
  UNION ALL
  SELECT f.r, f.lv + 1, sha256(a || h || b) FROM f JOIN sib ON f.r = sib.r AND f.lv = sib.lv
), proof AS (
  SELECT r, sha256(string_agg(a || b, '' ORDER BY lv)) AS proof FROM sib GROUP BY r
), root AS (
  SELECT h AS root FROM u ORDER BY lv DESC LIMIT 1
)
SELECT p.doc_id, p.leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, z.h AS folded_root, z.h = root AS verified
FROM p JOIN top ON p.g = top.g CROSS JOIN root LEFT JOIN proof ON p.r = proof.r
JOIN (SELECT r, h FROM f QUALIFY row_number() OVER (PARTITION BY r ORDER BY lv DESC) = 1) z ON p.r = z.r
"""

_OP13 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 5
"""

_OP12 = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, coalesce('=' || conv_id, '') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), k AS (
  SELECT *, {_CRC32.format(s="k")} % 20 AS kind FROM c
), d AS (
  SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(0, 2) r(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d
), f AS (
  SELECT g, turn, role, text, i, role[1] AS a, count(*) OVER (PARTITION BY g) AS n,
         CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o
), facts AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (b IS NOT NULL AND (b || a) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(a) OVER (PARTITION BY g ORDER BY i) AS b FROM f) GROUP BY g
), ins(s, t, c, x) AS (
  VALUES ('0', '0', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('0', 'u', 2, 'I'), ('s', 'u', 2, 'I'), ('a', 'u', 2, 'I'), ('u', 'a', 2, 'I'), ('0', 'a', 4, 'II'), ('s', 'a', 4, 'II')
), edit(s, t, a) AS (
  VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')
), dp(g, i, s, w) AS (
  SELECT DISTINCT g, 0::BIGINT, '0', {{'cost': 0, 'audit': ''}} FROM c
  UNION ALL
  SELECT f.g, f.i, e.t, min({{'cost': dp.w.cost + ins.c + e.c, 'audit': dp.w.audit || ins.x || e.x}})
  FROM dp JOIN ins ON dp.s = ins.s JOIN f ON dp.g = f.g AND f.i = dp.i + 1
  JOIN (
    SELECT s, t, a, 0 AS c, 'K' AS x FROM edit UNION ALL SELECT s, t, NULL, 2, 'R' FROM edit WHERE t <> 's' UNION ALL SELECT s, s, NULL, 3, 'D' FROM (SELECT DISTINCT t AS s FROM ins)
  ) e0 ON e0.s = ins.t AND (e0.x = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (e0.x <> 'K' OR e0.a = f.a)
  CROSS JOIN LATERAL (SELECT e0.t AS t, e0.x AS x, e0.c + CASE WHEN e0.x <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS c) e
  GROUP BY f.g, f.i, e.t
), best AS (
  SELECT dp.g, min({{'cost': w.cost + c, 'audit': w.audit || x}}) AS w FROM dp JOIN ins ON dp.s = ins.s LEFT JOIN (SELECT DISTINCT g, n FROM f) n ON dp.g = n.g WHERE dp.i = coalesce(n, 0) AND ins.t IN ('0', 'a') GROUP BY dp.g
), walk(g, p, i, s, line) AS (
  SELECT g, 0::BIGINT, 0::BIGINT, '0', NULL::VARCHAR FROM best
  UNION ALL
  SELECT b.g, walk.p + 1, walk.i + CASE WHEN x = 'I' THEN 0 ELSE 1 END,
         CASE WHEN x = 'D' THEN s WHEN x = 'K' THEN f.a WHEN s = 'u' THEN 'a' ELSE 'u' END,
         CASE x WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text WHEN 'R' THEN CASE WHEN s = 'u' THEN 'assistant:' ELSE 'user:' END || text ELSE CASE WHEN s = 'u' THEN 'assistant:' ELSE 'user:' END END
  FROM walk JOIN (SELECT g, unnest(range(1, len(w.audit) + 1)) AS p, unnest(string_split(w.audit, '')) AS x FROM best WHERE w.audit <> '') b ON walk.g = b.g AND b.p = walk.p + 1
  LEFT JOIN f ON f.g = walk.g AND x <> 'I' AND f.i = walk.i + 1
), sha AS (
  SELECT g, sha256(coalesce(string_agg(line, chr(10) ORDER BY p), '')) AS repaired_sha256 FROM walk GROUP BY g
)
SELECT u.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(best.w.cost AS BIGINT) AS cost, best.w.audit AS audit, repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM c) u JOIN best ON u.g = best.g JOIN sha ON u.g = sha.g LEFT JOIN facts ON u.g = facts.g
"""

ORACLES: dict[str, str] = {"op1_quality_rules": _OP1, "op9_minhash_near_dedup": _OP9, "op11_merkle_manifest": _OP11, "op12_conversation_repair": _OP12, "op13_exact_topk": _OP13}
