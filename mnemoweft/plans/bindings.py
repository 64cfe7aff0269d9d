"""How the canonical entities are found in the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft.functions.vector import mean_vector, normalise
from mnemoweft.operators.assoc import bridge
from mnemoweft.operators.search import nearest_items
from mnemoweft.tables import current, table


def rounded(*names: str, digits: int = 6):
    return [(F.round(n, digits) + F.lit(0.0)).alias(n) for n in names]


def memory_topics(spark: SparkSession, sf: str) -> DataFrame:
    return bridge(current(spark, sf, "memories", ["memory_id", "topic_ids"]), "memory_id", "topic_ids")


def order_brands(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(part, "l_partkey").select(F.col("l_orderkey").alias("memory"), "topic").distinct()


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "ts", "event_type")
    return events.select(F.struct("user_id", F.to_date("ts").alias("day")).alias("memory"), F.col("event_type").alias("topic")).distinct()


def session_topics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "segments").select(F.struct("sample_id", "session_id").alias("memory"), F.explode("topic_ids").alias("topic"))
    return rows.filter("topic is not null").distinct()


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """topic, vector, keywords: the normalised mean of each label."""
    mean = mean_vector(vectors(spark, sf), ["label"], "v", "vector")
    parity = F.when(F.col("label") % 2 == 0, "even").otherwise("odd")
    return mean.select(F.col("label").alias("topic"), "vector", F.array(F.concat(F.lit("topic"), F.col("label")), parity).alias("keywords"))


def vector_topics(spark: SparkSession, sf: str) -> DataFrame:
    """memory, topic: the own label and the most similar other centroid."""
    v, c = vectors(spark, sf), centroids(spark, sf)
    # the two nearest centroids hold the nearest other one
    near = nearest_items(c.select(F.col("topic").alias("item"), "vector"), v.select(F.struct("vec_id", "label").alias("query"), F.col("v").alias("qv")), 2).filter("query.label <> item")
    best = near.groupBy("query.vec_id").agg(F.min_by("item", "rank").alias("topic"))
    return v.select(F.col("vec_id").alias("memory"), F.col("label").alias("topic")).unionByName(best.select(F.col("vec_id").alias("memory"), "topic"))


def queries_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """query, qv, text: every vector whose id is divisible by 50, with a question about its label."""
    v = vectors(spark, sf).filter(F.col("vec_id") % 50 == 0)
    opening = F.when(F.col("vec_id") % 100 == 0, "Which is topic").otherwise("Tell about topic")
    text = F.concat(opening, F.col("label"), F.when(F.col("label") % 2 == 0, ", the even one?").otherwise("?"))
    return v.select(F.col("vec_id").alias("query"), normalise(F.col("v")).alias("qv"), text.alias("text"))


# The same in SQL
MEMORY_TOPICS = """
mcur AS (SELECT memory_id, topic_ids FROM memories
         QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at DESC) = 1),
mt AS (SELECT DISTINCT memory, topic FROM (SELECT memory_id AS memory, unnest(topic_ids) AS topic FROM mcur) WHERE topic IS NOT NULL)
"""
ORDER_BRANDS = "mt AS (SELECT DISTINCT l_orderkey AS memory, p_brand AS topic FROM lineitem JOIN part ON p_partkey = l_partkey)"
USER_DAYS = "mt AS (SELECT DISTINCT (user_id, ts::DATE) AS memory, event_type AS topic FROM events)"
SESSION_TOPICS = """mt AS (SELECT DISTINCT memory, topic FROM (SELECT (sample_id, session_id) AS memory, unnest(topic_ids) AS topic FROM segments)
WHERE topic IS NOT NULL)"""
PAIRS = """
one AS (SELECT topic, count(*) AS c FROM mt GROUP BY topic),
two AS (SELECT x.topic AS a, y.topic AS b, count(*) AS n_ab FROM mt x JOIN mt y ON x.memory = y.memory AND x.topic < y.topic GROUP BY 1, 2)
"""
NPMI = """
np AS (SELECT a, b, n_ab, p.c AS n_a, q.c AS n_b, n,
              CASE WHEN n_ab <> n THEN ln(n_ab * n::DOUBLE / (p.c::DOUBLE * q.c)) / -ln(n_ab / n::DOUBLE) ELSE 0 END AS npmi
       FROM two JOIN one p ON p.topic = a JOIN one q ON q.topic = b CROSS JOIN tot)
"""
DIRECTED = """
lean AS (SELECT *, n_ab / n_a::DOUBLE - n_ab / n_b::DOUBLE AS d FROM np WHERE npmi > {t}),
edges AS (SELECT a AS source, b AS target, npmi AS npmi_mem FROM lean WHERE d >= -0.05
          UNION ALL SELECT b, a, npmi FROM lean WHERE d <= 0.05)
"""
VECTORS = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
parts AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM v) GROUP BY label, i),
means AS (SELECT label, list(x ORDER BY i) AS x FROM parts GROUP BY label),
c AS (SELECT label AS topic, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS vector,
             ['topic' || label, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END] AS keywords FROM means),
vt AS (SELECT vec_id AS memory, label AS topic FROM v UNION ALL
       SELECT vec_id, topic FROM (SELECT vec_id, topic FROM v JOIN c ON label <> topic
       QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(v, vector), 9) DESC, topic) = 1)),
q AS (SELECT vec_id AS query, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS qv,
             CASE WHEN vec_id % 100 = 0 THEN 'Which is topic' ELSE 'Tell about topic' END || label ||
             CASE WHEN label % 2 = 0 THEN ', the even one?' ELSE '?' END AS text FROM v WHERE vec_id % 50 = 0)
"""
EDGES = """
ecur AS (SELECT source_id AS source, target_id AS target, edge_type, npmi_mem, llm_score, npmi_temp, weight, last_updated FROM assoc_edges
         QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY last_updated DESC, weight DESC) = 1)
"""
