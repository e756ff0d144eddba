"""The operators of this subpackage as queries over the driver's tables, and their SQL where SQL can say it.

Each query is thin: it reads whole tables, applies its operator with production parameters and derives
the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import table
from .exact_substring import exact_substring_dedup
from .line_dedup import line_dedup
from .mixing import mix
from .near_dedup import near_duplicates
from .pii import personal_data
from .quality_model import quality_scores
from .quality_rules import quality_rules
from .sentencepiece_fst import encode
from .token_counts import token_counts


def tokenizer_file(name: str) -> str:
    """Where the installed public_tokenizers package keeps a file; executors have the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("redacted")


def op2_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("h")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_exact_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), runs=True)
    return out.select("row.doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_quality_scores": op2_quality_scores,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_substring": op7_exact_substring,
    "op8_nearest": op8_nearest,
    "op9_token_counts": op9_token_counts,
    "op10_line_dedup": op10_line_dedup,
}

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS v FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.v = b.v AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS c FROM s UNION SELECT p.y, r.c FROM r JOIN p ON p.x = r.x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, sh
"""

OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM x, (VALUES (0), (1), (2)) v(o) WHERE k > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS bad FROM f GROUP BY host),
p AS (SELECT avg(bad / n) AS m, coalesce(var_pop(bad / n), 0) AS v FROM h),
q AS (SELECT m, least(1000, greatest(1, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000 END)) AS s FROM p),
o AS (SELECT host, (bad + s * m) / (n + s) <= 0.6 AS ok FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN o USING (host)
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
b AS (SELECT doc_id, j, substr(h, 2 * j + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, n)) AS j FROM d)),
c AS (
  SELECT b.doc_id, j, x, max(i) OVER (PARTITION BY b.doc_id ORDER BY j ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM b LEFT JOIN r ON r.doc_id = b.doc_id AND r.i = b.j),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS opens FROM c),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
    coalesce(string_agg(x, '' ORDER BY j) FILTER (WHERE NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

OP8_SQL = r"""
WITH e AS (
  SELECT vec_id, v, row_number() OVER () AS r FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL) x
  WHERE len(list_filter(v, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(v, lambda y: y <> 0)) > 0),
d AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.r <> q.r)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op8_nearest": OP8_SQL,
    "op4_near_duplicates": OP4_SQL,
    "op6_quality_rules": OP6_SQL,
    "op7_exact_substring": OP7_SQL,
}
