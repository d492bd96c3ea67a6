"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordlake.llm import embeddings, fingerprint, lm, minhash, packing, pii, sentencepieces, suffixes, tokencount, toxicity
from recordlake.llm.common import table, tokenizer_path


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score_texts(docs, toxicity.held_out("doc_id", 1))


def op2_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_links(table(spark, sf_dir, "embeddings"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), give_ids=False)


#: the setting that holds the key of surrogates; a deployment must set its own secret
PII_SETTING = "spark.recordlake.pii.key"
#: stands in where the setting is not set, as in tests: with it anyone can compute surrogates
PUBLIC_KEY = "public key of the tests"


def pii_key(spark: SparkSession) -> bytes:
    return (spark.conf.get(PII_SETTING, None) or PUBLIC_KEY).encode()


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.surrogate_texts(docs, pii_key(spark))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def lm_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: its counts."""
    return op1_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: the edited texts."""
    return fingerprint.edits(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_embedding_links": op2_embedding_links,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprint": op10_fingerprint,
    "lm_token_counts": lm_token_counts,
    "fingerprint_edits": fingerprint_edits,
}

_COSINE = "list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))"

_CRC32 = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))
  ), 4294967295::BIGINT)"""

ORACLE_SQL: dict[str, str] = {
    "lm_token_counts": rf"""
WITH d AS (
  SELECT doc_id, {_CRC32} % 5 = 1 AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+'), '') AS ws
  FROM documents),
t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
known AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(known.w)::BIGINT AS n_known, (SELECT coalesce(sum(c), 0) FROM known)::BIGINT AS train_tokens
FROM t LEFT JOIN known USING (w) GROUP BY doc_id, held_out""",
    "fingerprint_edits": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS after FROM d WINDOW w AS (ORDER BY doc_id DESC))
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(after, 1, length(t) // 2)) AS edited_sha256 FROM n""",
    "op2_embedding_links": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE {_COSINE} >= 0.93),
reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, m AS component_id, v.vec_id = m AS kept
FROM v JOIN (SELECT vec_id, min(r) AS m FROM reach GROUP BY 1) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id)""",
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS p FROM w JOIN m USING (s) WHERE m.low < w.doc_id),
run AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY ALL),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM span),
parts AS (SELECT gap.doc_id, count(*) AS n, sum(b - a) AS gone, max(b) AS last,
                 string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS pre
          FROM gap JOIN d USING (doc_id) GROUP BY gap.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE pre || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id)""",
    "op3_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, min(r) AS class_id, doc_id = min(r) AS kept FROM reach GROUP BY doc_id""",
}
