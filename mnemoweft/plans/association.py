"""Queries on co-occurrence and the association graph."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft.config import DEFAULTS
from mnemoweft.functions.info import log_likelihood_ratio
from mnemoweft.operators import assoc
from mnemoweft.operators.ppr import personalized_pagerank
from mnemoweft.plans import bindings as B
from mnemoweft.plans.bindings import rounded
from mnemoweft.runtime import cut
from mnemoweft.tables import current, table

AS_OF = "2025-01-01 00:00:00"


def _npmi(spark: SparkSession, sf: str, members: DataFrame, total: DataFrame | None = None) -> DataFrame:
    total = members.agg(F.count_distinct("memory").alias("n")) if total is None else total
    return assoc.with_npmi(assoc.cooccurrences(members), assoc.marginals(members), total)


def _memory_pairs(spark: SparkSession, sf: str) -> DataFrame:
    total = table(spark, sf, "memories").agg(F.count_distinct("memory_id").alias("n"))
    return _npmi(spark, sf, B.memory_topics(spark, sf), total)


def cooccurrence_memory(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.cooccurrences(B.memory_topics(spark, sf))


def cooccurrence_brand(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.cooccurrences(B.order_brands(spark, sf))


def cooccurrence_soft(spark: SparkSession, sf: str) -> DataFrame:
    memories = B.vectors(spark, sf).select(F.col("vec_id").alias("memory"), F.col("v").alias("vector"))
    return assoc.cooccurrences(assoc.soft_memberships(B.vector_topics(spark, sf), memories, B.centroids(spark, sf).select("topic", "vector"), 0.2))


def npmi_memory(spark: SparkSession, sf: str) -> DataFrame:
    return _memory_pairs(spark, sf).select("a", "b", "n_ab", "n_a", "n_b", *rounded("npmi"))


def npmi_brand(spark: SparkSession, sf: str) -> DataFrame:
    return _npmi(spark, sf, B.order_brands(spark, sf)).select("a", "b", "n_ab", "n_a", "n_b", *rounded("npmi"))


def npmi_event_day(spark: SparkSession, sf: str) -> DataFrame:
    return _npmi(spark, sf, B.user_days(spark, sf)).select("a", "b", "n_ab", "n_a", "n_b", *rounded("npmi"))


def npmi_session(spark: SparkSession, sf: str) -> DataFrame:
    return _npmi(spark, sf, B.session_topics(spark, sf)).select("a", "b", "n_ab", "n_a", "n_b", *rounded("npmi"))


def llr_brand(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _npmi(spark, sf, B.order_brands(spark, sf))
    return pairs.select("a", "b", F.round(log_likelihood_ratio(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n")), 4).alias("llr"))


def edge_direction(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.directed(_memory_pairs(spark, sf)).select("source", "target", *rounded("npmi_mem"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    known = ["source_id", "target_id", "edge_type", "npmi_mem", "llm_score", "npmi_temp", "last_updated"]
    rows = table(spark, sf, "assoc_edges").select(*known).withColumn("llm_score", F.col("llm_score") / 100)
    return assoc.merge_edges(rows.withColumnsRenamed({"source_id": "source", "target_id": "target"}), at="last_updated")


def edge_weight(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("source", "target", "edge_type", *rounded("npmi_mem", "llm_score", "npmi_temp", "weight", digits=9))


def edge_prune(spark: SparkSession, sf: str) -> DataFrame:
    merged = _scored(spark, sf).withColumn("weight", F.round("weight", 9))
    return assoc.prune(merged).select("source", "target", "rank", "weight")


def build_association(spark: SparkSession, sf: str) -> DataFrame:
    """Co-occurrence to NPMI to direction to weight to pruning, in one plan."""
    e = assoc.directed(_memory_pairs(spark, sf))
    merged = assoc.merge_edges(e.select("*", F.lit("co").alias("edge_type"), F.lit(0.0).alias("llm_score"), F.lit(0.0).alias("npmi_temp")))
    return assoc.prune(merged.withColumn("weight", F.round("weight", 9))).select("source", "target", "rank", "weight")


def causal_candidates(spark: SparkSession, sf: str) -> DataFrame:
    topics = B.centroids(spark, sf).select("topic", "vector")
    none = spark.createDataFrame([(0, 1)], "source int, target int")
    return assoc.causal_candidates(topics, none, -0.4, 0.4).select("a", "b", *rounded("similarity"))


def _current_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = current(spark, sf, "assoc_edges", ["source_id", "target_id", "weight", "last_updated"])
    return e.withColumnsRenamed({"source_id": "source", "target_id": "target"}).filter(F.col("weight").isNotNull() & ~F.isnan("weight"))


def edge_decay(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.decayed(_current_edges(spark, sf), F.lit(AS_OF)).select("source", "target", *rounded("weight"))


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    edges = _current_edges(spark, sf)
    return assoc.neighbours(edges, edges.select("source")).select("source", "target", "rank")


def decay_reinforce(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)).alias("delta"))
    return assoc.reinforced(events, ["user_id", "event_type"], "delta", "ts", "event_id").select("user_id", "event_type", *rounded("weight"))


def _brand_edges(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _npmi(spark, sf, B.order_brands(spark, sf))
    return assoc.directed(pairs, threshold=0.0).select("source", "target", (0.4 * F.col("npmi_mem")).alias("weight"))


def ppr_topk(spark: SparkSession, sf: str) -> DataFrame:
    edges = cut(_brand_edges(spark, sf))
    seeds = edges.select(F.col("source").alias("query"), F.col("source").alias("node"), F.lit(1.0).alias("mass")).distinct()
    found = personalized_pagerank(edges, seeds, replace(DEFAULTS, ppr_top_k=5), epsilon=0)
    return found.select("query", "node", *rounded("score"), "rank")


QUERIES = {
    f.__name__: f
    for f in (
        cooccurrence_memory, cooccurrence_brand, cooccurrence_soft, npmi_memory, npmi_brand, npmi_event_day, npmi_session, llr_brand,
        edge_direction, edge_weight, edge_prune, build_association, causal_candidates, edge_decay, neighbours, decay_reinforce, ppr_topk,
    )
}

_TOT = "tot AS (SELECT count(DISTINCT memory) AS n FROM mt)"
_MTOT = "tot AS (SELECT count(DISTINCT memory_id) AS n FROM memories)"
_NPMI_OUT = "SELECT a, b, n_ab, n_a, n_b, round(npmi, 6) + 0.0 AS npmi FROM np"
_SCORED = """
raw AS (SELECT source_id AS source, target_id AS target, edge_type,
               CASE WHEN isnan(npmi_mem) THEN NULL ELSE npmi_mem END AS a, CASE WHEN isnan(llm_score) THEN NULL ELSE llm_score / 100 END AS b,
               CASE WHEN isnan(npmi_temp) THEN NULL ELSE npmi_temp END AS c, last_updated FROM assoc_edges),
mx AS (SELECT source, target, greatest(coalesce(max(a), 0), 0) AS npmi_mem, greatest(coalesce(max(b), 0), 0) AS llm_score,
              greatest(coalesce(max(c), 0), 0) AS npmi_temp, coalesce(max({'t': last_updated, 'e': edge_type}) FILTER (edge_type <> 'co')['e'], 'co') AS edge_type
       FROM raw GROUP BY 1, 2),
scored AS (SELECT *, greatest(0, least(1, 0.4::DOUBLE * npmi_mem + 0.4::DOUBLE * llm_score + 0.2::DOUBLE * npmi_temp)) AS weight FROM mx)
"""
_PRUNE = """SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY round(weight, 9) DESC, target)::INT AS rank, round(weight, 9) AS weight
FROM {t} WHERE round(weight, 9) >= 0.08 QUALIFY rank <= 5"""


def _unrolled_ppr(rounds: int) -> str:
    steps = ["p0 AS (SELECT q, node, s AS p FROM seed)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"p{k} AS MATERIALIZED (SELECT q, node, sum(p) AS p FROM (SELECT q, target AS node, 0.85::DOUBLE * p * share AS p FROM p{k - 1} JOIN moves ON node = source "
            "UNION ALL SELECT q, node, 0.15::DOUBLE * s FROM seed) GROUP BY 1, 2)"
        )
    return ",\n".join(steps)


SQL = {
    "cooccurrence_memory": f"WITH {B.MEMORY_TOPICS}, {B.PAIRS} SELECT a, b, n_ab FROM two",
    "cooccurrence_brand": f"WITH {B.ORDER_BRANDS}, {B.PAIRS} SELECT a, b, n_ab FROM two",
    "cooccurrence_soft": f"""WITH {B.VECTORS}, mt AS (SELECT memory, topic FROM vt UNION SELECT vec_id, topic FROM v JOIN c ON list_dot_product(v, vector) >= 0.2),
{B.PAIRS} SELECT a, b, n_ab FROM two""",
    "npmi_memory": f"WITH {B.MEMORY_TOPICS}, {_MTOT}, {B.PAIRS}, {B.NPMI} {_NPMI_OUT}",
    "npmi_brand": f"WITH {B.ORDER_BRANDS}, {_TOT}, {B.PAIRS}, {B.NPMI} {_NPMI_OUT}",
    "npmi_event_day": f"WITH {B.USER_DAYS}, {_TOT}, {B.PAIRS}, {B.NPMI} {_NPMI_OUT}",
    "npmi_session": f"WITH {B.SESSION_TOPICS}, {_TOT}, {B.PAIRS}, {B.NPMI} {_NPMI_OUT}",
    "llr_brand": f"""WITH {B.ORDER_BRANDS}, {_TOT}, {B.PAIRS}, {B.NPMI},
cells AS (SELECT a, b, unnest([n_ab, n_a - n_ab, n_b - n_ab, n - n_a - n_b + n_ab])::DOUBLE AS o,
                 unnest([n_a::DOUBLE * n_b / n, n_a::DOUBLE * (n - n_b) / n, (n - n_a)::DOUBLE * n_b / n, (n - n_a)::DOUBLE * (n - n_b) / n]) AS e FROM np)
SELECT a, b, round(2 * sum(CASE WHEN o > 0 THEN o * ln(o / e) ELSE 0 END), 4) AS llr FROM cells GROUP BY 1, 2""",
    "edge_direction": f"WITH {B.MEMORY_TOPICS}, {_MTOT}, {B.PAIRS}, {B.NPMI}, {B.DIRECTED.format(t=0.1)} SELECT source, target, round(npmi_mem, 6) AS npmi_mem FROM edges",
    "edge_weight": f"""WITH {_SCORED} SELECT source, target, edge_type, round(npmi_mem, 9) AS npmi_mem, round(llm_score, 9) AS llm_score,
round(npmi_temp, 9) AS npmi_temp, round(weight, 9) AS weight FROM scored""",
    "edge_prune": f"WITH {_SCORED} {_PRUNE.format(t='scored')}",
    "build_association": f"""WITH {B.MEMORY_TOPICS}, {_MTOT}, {B.PAIRS}, {B.NPMI}, {B.DIRECTED.format(t=0.1)},
w AS (SELECT source, target, greatest(0, least(1, 0.4::DOUBLE * npmi_mem)) AS weight FROM edges) {_PRUNE.format(t='w')}""",
    "causal_candidates": f"""WITH {B.VECTORS} SELECT x.topic AS a, y.topic AS b, round(list_dot_product(x.vector, y.vector), 6) + 0.0 AS similarity FROM c x JOIN c y ON x.topic < y.topic
WHERE abs(list_dot_product(x.vector, y.vector)) < 0.4 AND NOT (x.topic = 0 AND y.topic = 1)
ORDER BY round(abs(list_dot_product(x.vector, y.vector)), 9), 1, 2 LIMIT 30""",
    "edge_decay": f"""WITH {B.EDGES} SELECT source, target,
round(weight * exp(-ln(2) / 30 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_updated)) / 86400e6), 6) AS weight FROM ecur WHERE NOT isnan(weight)""",
    "neighbours": f"""WITH {B.EDGES} SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target)::INT AS rank FROM ecur WHERE NOT isnan(weight)""",
    "decay_reinforce": """WITH e AS (SELECT user_id, event_type, ts, event_id, greatest(0, least(1, value / 100))::DOUBLE AS d FROM events),
l AS (SELECT user_id, event_type, list({'w': greatest(0, least(1, 0.4::DOUBLE * d)), 't': epoch_us(ts), 'd': d} ORDER BY ts, event_id) AS l FROM e GROUP BY 1, 2)
SELECT user_id, event_type, round(list_reduce(l, lambda s, x: {
  'w': least(1, s.w * exp(-ln(2) / 30 * (x.t - s.t) / 86400e6) + 0.2::DOUBLE * (1 - s.w * exp(-ln(2) / 30 * (x.t - s.t) / 86400e6)) * x.d), 't': x.t, 'd': x.d}).w, 6) AS weight FROM l""",
    "ppr_topk": f"""WITH {B.ORDER_BRANDS}, {_TOT}, {B.PAIRS}, {B.NPMI}, {B.DIRECTED.format(t=0)},
outw AS (SELECT source, sum(npmi_mem) AS s FROM edges GROUP BY 1),
moves AS MATERIALIZED (SELECT e.source, target, npmi_mem / s AS share FROM edges e JOIN outw o ON o.source = e.source),
seed AS MATERIALIZED (SELECT DISTINCT source AS q, source AS node, 1.0::DOUBLE AS s FROM edges),
{_unrolled_ppr(20)}
SELECT q AS query, node, round(p, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(p, 12) DESC, node)::INT AS rank
FROM p20 WHERE p > 0 AND q <> node QUALIFY rank <= 5""",
}
