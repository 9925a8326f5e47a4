"""The corpus operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_conversations
from .decontaminate import decontaminate
from .language_model import language_model
from .license_scan import license_scan
from .minhash_dedup import near_duplicates
from .mix_sources import mix
from .nearest import nearest
from .quality import quality
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are full of the template's own marks."""
    hard = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").selectExpr("CAST(conv_id AS LONG) AS conv_id", "CAST(turn AS LONG) AS turn", "role", "text")
    return format_conversations(turns.unionByName(own))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_language_model": op4_language_model,
    "op5_quality": op5_quality,
    "op6_chat_format": op6_chat_format,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_nearest": op10_nearest,
}

_NEAREST = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][i % 3 + 1] AS HUGEINT) AS w FROM s),
l AS (
  SELECT *, sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY s * 3 * (10 // w), i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY s * 3 * (10 // w), i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM w),
c AS (SELECT *, 3 * s * weights <= w * rest AS capped FROM l),
f AS (SELECT *, max(CASE WHEN NOT capped THEN rest END) OVER () AS r, max(CASE WHEN NOT capped THEN weights END) OVER () AS v FROM c),
n AS (
  SELECT source, s, CASE WHEN capped THEN CAST(3 * s AS DOUBLE) ELSE CAST(w * r AS DOUBLE) / CAST(v AS DOUBLE) END AS target,
         CASE WHEN capped THEN CAST(3 AS HUGEINT) ELSE w * r END AS num, CASE WHEN capped THEN CAST(1 AS HUGEINT) ELSE v * s END AS den, i
  FROM f),
o AS (SELECT *, CAST((i * 2654435761 + 40503) % 1000003 AS HUGEINT) * den // 1000003 AS off FROM n),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS HUGEINT) AS k FROM d)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
       CAST(size * (CASE WHEN den = 0 THEN 0 ELSE ((k + 1) * num + off) // den - (k * num + off) // den END) AS BIGINT) AS taken
FROM k JOIN o ON k.source IS NOT DISTINCT FROM o.source
"""

_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(role) + len(regexp_extract_all(role, '[\\:\n]')) + length(text) + len(regexp_extract_all(text, '###|</turn>'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

#: Every window of 50 words, with the smallest document that has it.
_REPEATS = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL),
win AS MATERIALIZED (SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS key FROM starts),
first AS (SELECT key, min(doc_id) AS f FROM win GROUP BY key),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM win JOIN first USING (key) WHERE doc_id > f),
left_over AS (SELECT r, array_to_string(list(word ORDER BY j), ' ') AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = t.r AND g.j = t.j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (r)
"""

#: All pairs with a shingle in common, and what is reached over links. Groups of copies are expanded into pairs here, so it is for small tables.
_NEAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0),
sh AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS s FROM starts),
size AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY r),
both_in AS (SELECT a.r AS p, b.r AS q, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
link AS MATERIALIZED (SELECT DISTINCT x.doc_id AS u, y.doc_id AS v FROM both_in JOIN size m ON m.r = p JOIN size n ON n.r = q JOIN d x ON x.r = p JOIN d y ON y.r = q
  WHERE 100 * c >= 85 * (m.n + n.n - c) AND x.doc_id <> y.doc_id),
two AS MATERIALIZED (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach(u, v) AS (SELECT u, v FROM two UNION SELECT reach.u, two.v FROM reach JOIN two ON two.u = reach.v),
low AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(v, doc_id)) AS component_id, doc_id IS NULL OR least(doc_id, coalesce(v, doc_id)) = doc_id AS kept
FROM d LEFT JOIN size USING (r) LEFT JOIN low ON low.u = d.doc_id
"""

#: Every string of 400 bytes, by its digest.
_BYTES = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT r, x, unnest(range(0, CAST(length(x) // 2 - 399 AS BIGINT))) AS i FROM d WHERE length(x) >= 800),
win AS MATERIALIZED (SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS key FROM starts),
many AS (SELECT key FROM win GROUP BY key HAVING count(*) > 1),
hit AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM win JOIN many USING (key)),
run AS (SELECT r, i, sum(CASE WHEN step <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
span AS (SELECT r, k, min(i) AS a, max(i) + 400 AS b FROM run GROUP BY r, k),
edge AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
part AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n, max(b) AS stop, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM edge JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN stop IS NULL THEN x ELSE head || substr(x, 2 * stop + 1) END)) AS kept_sha256
FROM d LEFT JOIN part USING (r)
"""

#: Every window of items, against every window of documents of the same number of words.
_LEAKS = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0),
win AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM starts),
sizes AS (SELECT DISTINCT n FROM win),
dat AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n),
hit AS MATERIALIZED (SELECT DISTINCT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM dat) JOIN win USING (n, key)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS names FROM hit WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(names), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": _REPEATS,
    "op2_mix_sources": _MIX,
    "op3_minhash_dedup": _NEAR,
    "op6_chat_format": _CHAT,
    "op8_suffix_dedup": _BYTES,
    "op9_decontaminate": _LEAKS,
    "op10_nearest": _NEAREST,
}
