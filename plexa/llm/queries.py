"""The operators' queries over whole tables, and their SQL where there is one."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, lines, mixing, nearest, neardup, packing, secrets, substrings, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scored(_table(spark, sf_dir, "documents"), toxicity.folds(F.col("doc_id"), 10) == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(_table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_k(_table(spark, sf_dir, "embeddings"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substrings, op2_toxicity, op3_bpe, op4_neardup, op5_secrets, op6_mixing, op7_packing, op8_lines, op9_nearest, op10_langid)}

_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op1_substrings": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT g.doc_id, g.i, unnest(range(50)) AS j FROM g JOIN f ON f.h = g.h WHERE first < doc_id)),
r AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id""",
    "op8_lines": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS host, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
m AS (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(8)) AS j FROM m WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS x FROM d)),
hosts AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY host),
common AS (SELECT l.host, line FROM l JOIN hosts ON hosts.host = l.host WHERE line <> '' GROUP BY l.host, line, hosts.n HAVING count(DISTINCT doc_id) >= {lines.LEAST_DOCS} AND count(DISTINCT doc_id) > {lines.GROWTH} * sqrt(hosts.n)),
lost AS (SELECT doc_id, CAST(sum(len(string_split(l.line, ' '))) AS BIGINT) AS n FROM l JOIN common c ON c.host = l.host AND c.line = l.line GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD}))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})))) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_removed_words FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (n_removed_words = 0 OR (n_words - n_removed_words >= {lines.LEAST_WORDS} AND n_words - n_removed_words >= {lines.LEAST_KEPT} * n_words)) AS kept FROM b""",
    "op9_nearest": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS g FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.g, c.g) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 5""",
}
