"""Queries on the topic hierarchy by component-wise traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft.operators.hierarchy import Hierarchy, links_of
from mnemoweft.tables import current


def _hierarchy(spark: SparkSession, sf: str) -> Hierarchy:
    topics = current(spark, sf, "topics", ["topic_id", "parent_ids", "child_ids"])
    return Hierarchy(links_of(topics, "topic_id", "parent_ids", "child_ids"), nodes=topics.select(F.col("topic_id").alias("node")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _hierarchy(spark, sf).cycles().select(F.col("node").alias("topic_id"))


def p1_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return _hierarchy(spark, sf).cycles().select(F.col("node").alias("topic_id"), F.col("cycle").alias("cycle_id"))


def p1_back_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _hierarchy(spark, sf).back_edges()


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return _hierarchy(spark, sf).descendants().select("ancestor", "descendant")


def p1_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _hierarchy(spark, sf).paths().withColumn("path", F.array_join("path", "/"))


QUERIES = {f.__name__: f for f in (p1_found, p1_cycles, p1_back_edges, p1_descendants, p1_paths)}

_REACH = """
cur AS (SELECT topic_id, parent_ids, child_ids FROM topics
        QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC) = 1),
links AS (SELECT DISTINCT p, c FROM (SELECT unnest(parent_ids) AS p, topic_id AS c FROM cur UNION ALL SELECT topic_id, unnest(child_ids) FROM cur)
          WHERE p IS NOT NULL AND c IS NOT NULL),
reach AS (SELECT p AS a, c AS d FROM links UNION SELECT a, c FROM reach JOIN links ON p = d)
"""

SQL = {
    "p1_found": f"WITH RECURSIVE {_REACH} SELECT a AS topic_id FROM reach WHERE a = d",
    "p1_cycles": f"""WITH RECURSIVE {_REACH} SELECT x.a AS topic_id, min(x.d) AS cycle_id
FROM reach x JOIN reach y ON x.a = y.d AND x.d = y.a GROUP BY 1""",
    "p1_paths": f"""WITH RECURSIVE {_REACH},
nodes AS (SELECT topic_id AS v FROM cur WHERE topic_id IS NOT NULL UNION SELECT p FROM links UNION SELECT c FROM links),
above AS (SELECT r.d AS v, r.a, b.a IS NOT NULL AS back FROM reach r LEFT JOIN reach b ON b.a = r.d AND b.d = r.a),
tops AS (SELECT v FROM nodes WHERE v NOT IN (SELECT v FROM above WHERE NOT back OR a < v)),
near AS (SELECT v AS top, v AS node, 0 AS depth FROM tops UNION SELECT top, c, depth + 1 FROM near JOIN links ON p = node WHERE depth < 400),
dist AS MATERIALIZED (SELECT top, node, min(depth)::INT AS depth FROM near GROUP BY 1, 2),
pred AS MATERIALIZED (SELECT x.top, x.node, min(p) AS p FROM dist x JOIN links ON c = x.node JOIN dist y ON y.top = x.top AND y.node = p AND y.depth = x.depth - 1 GROUP BY 1, 2),
way AS (SELECT v AS top, v AS node, v AS path FROM tops UNION ALL SELECT way.top, pred.node, path || '/' || pred.node FROM way JOIN pred ON pred.top = way.top AND pred.p = way.node)
SELECT node, top, depth, path FROM way JOIN dist USING (top, node)""",
    "p1_descendants": f"WITH RECURSIVE {_REACH} SELECT a AS ancestor, d AS descendant FROM reach",
}
