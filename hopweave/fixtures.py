"""Two graphs over the star schema's tables, as SQL that Spark and DuckDB both run. Whole tables, no samples.

ev: the events of a user in order; labels view 0, click 1, signup 2, purchase 3, other 4. Acyclic.
tr: customer 0, order 1, part 2, supplier 3, nation 4, each a vertex key * 8 + label. Cyclic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.graph import LabeledGraph

EV_EDGES = """
SELECT src, dst, w FROM (
  SELECT CAST(event_id AS BIGINT) AS src, CAST(LEAD(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS dst,
         CAST(1 + event_id % 2 AS INT) AS w
  FROM {events}) t WHERE dst IS NOT NULL"""
EV_LABELS = """
SELECT CAST(event_id AS BIGINT) AS vid,
       CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS INT) AS label
FROM {events}"""
TR_EDGES = """
SELECT CAST(o_custkey * 8 AS BIGINT) AS src, CAST(o_orderkey * 8 + 1 AS BIGINT) AS dst, CAST(1 AS INT) AS w FROM {orders}
UNION ALL SELECT CAST(l_orderkey * 8 + 1 AS BIGINT), CAST(l_partkey * 8 + 2 AS BIGINT), CAST(MIN(l_linenumber) AS INT) FROM {lineitem} GROUP BY 1, 2
UNION ALL SELECT CAST(l_partkey * 8 + 2 AS BIGINT), CAST(l_suppkey * 8 + 3 AS BIGINT), CAST(MIN(1 + l_linenumber % 3) AS INT) FROM {lineitem} GROUP BY 1, 2
UNION ALL SELECT CAST(s_suppkey * 8 + 3 AS BIGINT), CAST(s_nationkey * 8 + 4 AS BIGINT), CAST(1 AS INT) FROM {supplier}
UNION ALL SELECT CAST(n_nationkey * 8 + 4 AS BIGINT), CAST(c_custkey * 8 AS BIGINT), CAST(2 AS INT) FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"""
TABLES = ("events", "orders", "lineitem", "supplier", "customer", "nation")


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text})


def events_graph(spark: SparkSession, sf_dir: str) -> LabeledGraph:
    return LabeledGraph.of(_sql(spark, sf_dir, EV_EDGES), _sql(spark, sf_dir, EV_LABELS))


def trade_graph(spark: SparkSession, sf_dir: str) -> LabeledGraph:
    return LabeledGraph.of(_sql(spark, sf_dir, TR_EDGES), F.col("vid") % 8)


def _plain(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


#: CTEs for the oracle: ev_e, ev_v, tr_e, tr_v and the undirected tr_u.
EV = f"""ev_e AS ({_plain(EV_EDGES)}),
ev_v AS (SELECT vid, label FROM ({_plain(EV_LABELS)}) WHERE vid IN (SELECT src FROM ev_e UNION SELECT dst FROM ev_e))"""
TR = f"""tr_e AS MATERIALIZED ({_plain(TR_EDGES)}),
tr_v AS MATERIALIZED (SELECT vid, CAST(vid % 8 AS INTEGER) AS label FROM (SELECT src AS vid FROM tr_e UNION SELECT dst FROM tr_e)),
tr_u AS (SELECT src, dst, w FROM tr_e UNION ALL SELECT dst, src, w FROM tr_e)"""
