"""Queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import op1_minhash, op2_secrets, op3_shards, op4_packing, op5_topk, op6_licenses, op7_pieces, op8_embeddings, op9_language, op10_ctw


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file; the folder is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def queries() -> dict:
    return {
        "op1_minhash": lambda s, d: op1_minhash.near_duplicates(_read(s, d, "documents"), shingle_words=2, percent=80),
        "op2_secrets": lambda s, d: op2_secrets.scan(_read(s, d, "documents")),
        "op3_shards": lambda s, d: op3_shards.shard(_read(s, d, "documents"), shards=24),
        "op4_packing": lambda s, d: op4_packing.pack(_read(s, d, "documents"), tokenizer("byte_bpe_50k.json")),
        "op5_topk": lambda s, d: op5_topk.top_k(_read(s, d, "embeddings"), k=5, every=50),
        "op6_licenses": lambda s, d: op6_licenses.find_licenses(_read(s, d, "documents")),
        "op7_pieces": lambda s, d: op7_pieces.round_trip(_read(s, d, "documents"), tokenizer("piece_bpe_32k.model"), dropout=0.1, seed=42),
        "op8_embeddings": lambda s, d: op8_embeddings.near_duplicates(_read(s, d, "embeddings"), threshold=0.93),
        "op9_language": lambda s, d: op9_language.identify(_read(s, d, "documents")),
        "op10_ctw": lambda s, d: op10_ctw.score(_read(s, d, "documents")),
    }


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS p
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, p[i + 1] || ' ' || p[i + 2] AS g FROM (SELECT doc_id, p, unnest(range(0, len(p) - 1)) AS i FROM w WHERE len(p) >= 2)
  UNION ALL SELECT doc_id, p[1] FROM w WHERE len(p) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.r) AS component_id, d.doc_id = min(reach.r) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, n.n"""

OP3_SQL = """
WITH RECURSIVE n(k) AS (VALUES (24), (25)),
jump AS (
  SELECT doc_id, k, ((doc_id::HUGEINT + 18446744073709551616) % 18446744073709551616)::HUGEINT AS key, -1::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT doc_id FROM documents), n
  UNION ALL
  SELECT doc_id, k, x, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((x // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS x FROM jump WHERE j < k)),
placed AS (SELECT doc_id, max(b) FILTER (k = 24) AS shard, max(b) FILTER (k = 25) AS grown_shard FROM jump GROUP BY doc_id),
crc_step(t) AS (
  SELECT [list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)]),
bytes AS (
  SELECT doc_id, text, [(strpos('0123456789ABCDEF', h[1]) * 16 + strpos('0123456789ABCDEF', h[2]) - 17)::BIGINT FOR h IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS b FROM documents),
crc AS (
  SELECT doc_id, len(b) + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM bytes, crc_step)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard
FROM crc JOIN placed USING (doc_id)"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5"""

OP8_SQL = """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
low AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1_SQL, "op3_shards": OP3_SQL, "op5_topk": OP5_SQL, "op6_licenses": op6_licenses.oracle(), "op8_embeddings": OP8_SQL}
