"""Queries on routing and retrieval, over the vectors and their labels as topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft.functions.vector import normalise
from mnemoweft.operators import assoc
from mnemoweft.operators import retrieve as R
from mnemoweft.operators.search import items_above, nearest_items
from mnemoweft.plans import bindings as B
from mnemoweft.plans.bindings import rounded
from mnemoweft.runtime import cut


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return B.vectors(spark, sf).select(F.col("vec_id").alias("item"), F.col("v").alias("vector"))


def store(spark: SparkSession, sf: str) -> R.Store:
    v, members, c = B.vectors(spark, sf), cut(B.vector_topics(spark, sf)), cut(B.centroids(spark, sf))
    # a summary lies between a topic and the next one; the last has none
    after = c.select((F.col("topic") - 1).alias("topic"), F.col("vector").alias("next"))
    between = normalise(F.zip_with("vector", "next", lambda x, y: x + y))
    leaves = c.join(after, "topic", "left").select("topic", F.col("vector").alias("label_vector"), between.alias("summary_vector"), "keywords", F.lit(False).alias("is_virtual"))
    leaves = cut(leaves)
    dag = leaves.select((100 + F.col("topic") % 3).alias("parent"), F.col("topic").alias("child"))
    roots = dag.select(F.lit(-1).alias("parent"), F.col("parent").alias("child")).distinct()
    closure = dag.unionByName(roots).toDF("ancestor", "descendant").unionByName(dag.select(F.lit(-1).alias("ancestor"), F.col("child").alias("descendant")))
    topics = members.groupBy("memory").agg(F.array_sort(F.collect_set("topic")).alias("topics")).withColumnRenamed("memory", "item")
    memories = v.select(F.col("vec_id").alias("item"), F.col("v").alias("vector"), F.array(F.concat(F.lit("topic"), "label")).alias("keywords"), ((F.col("vec_id") % 10) / 10).alias("importance")).join(topics, "item")
    counts = assoc.marginals(members)
    pairs = assoc.cooccurrences(members)
    ways = pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), "n_ab").unionByName(pairs.select(F.col("b").alias("source"), F.col("a").alias("target"), "n_ab"))
    edges = ways.join(counts.withColumnRenamed("topic", "source"), "source").select("source", "target", (F.col("n_ab") / F.col("n_topic")).alias("weight"))
    return R.Store(leaves, memories, dag.unionByName(roots), closure, cut(edges))


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_items(_items(spark, sf), B.queries_by_id(spark, sf), 10).select("query", "item", *rounded("score"), "rank")


def filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf).join(store(spark, sf).memories.select("item", "topics"), "item")
    own = B.vectors(spark, sf).select(F.col("vec_id").alias("query"), F.array("label").alias("topics"))
    return nearest_items(items, B.queries_by_id(spark, sf).join(own, "query"), 10, filtered=True).select("query", "item", *rounded("score"), "rank")


def similar_above(spark: SparkSession, sf: str) -> DataFrame:
    return items_above(_items(spark, sf), B.queries_by_id(spark, sf), 0.35).select("query", "item", *rounded("score"))


def centroid_topics(spark: SparkSession, sf: str) -> DataFrame:
    c = B.centroids(spark, sf).select("topic", F.posexplode("vector").alias("i", "x"))
    return c.select("topic", "i", *rounded("x"))


def single_topic(spark: SparkSession, sf: str) -> DataFrame:
    """Each memory keeps the one of its topics that is most similar to it."""
    from mnemoweft.functions.vector import dot

    rows = B.vector_topics(spark, sf).join(B.vectors(spark, sf).select(F.col("vec_id").alias("memory"), "v"), "memory").join(B.centroids(spark, sf).select("topic", "vector"), "topic")
    best = F.max_by("topic", F.struct(F.round(dot(F.col("v"), F.col("vector")), 9), -F.col("topic")))
    return rows.groupBy("memory").agg(best.alias("topic"))


def route_topics(spark: SparkSession, sf: str) -> DataFrame:
    return R.route_all(store(spark, sf), B.queries_by_id(spark, sf)).select("query", "topic", *rounded("score"))


def route_topics_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    return R.route_indexed(store(spark, sf), B.queries_by_id(spark, sf)).select("query", "topic", *rounded("score"))


def dag_adjust_expand(spark: SparkSession, sf: str) -> DataFrame:
    s = store(spark, sf)
    routed = R.route_indexed(s, B.queries_by_id(spark, sf)).filter("score >= 0.25")
    return R.adjust(s, routed).select("query", "topic", *rounded("score"), "rank")


def dag_adjust_reduce(spark: SparkSession, sf: str) -> DataFrame:
    s = store(spark, sf)
    leaves = R.route_indexed(s, B.queries_by_id(spark, sf)).filter("topic <> 0")
    parents = s.dag.filter("parent >= 0").select(F.col("child").alias("topic"), "parent")
    upper = leaves.join(parents, "topic").groupBy("query", F.col("parent").alias("topic")).agg(F.max("score").alias("score"))
    lone = leaves.select("query").distinct().select("query", F.lit(500).alias("topic"), F.lit(0.01).alias("score"))
    return R.adjust(s, leaves.unionByName(upper).unionByName(lone)).select("query", "topic", *rounded("score"), "rank")


def _stages(spark: SparkSession, sf: str):
    s, q = store(spark, sf), B.queries_by_id(spark, sf)
    adjusted = R.adjust(s, R.route_indexed(s, q))
    return s, q, adjusted, R.intra(s, q, adjusted)


def intra_topic_score(spark: SparkSession, sf: str) -> DataFrame:
    return _stages(spark, sf)[3].select("query", "item", *rounded("score"), F.array_join("matched", ",").alias("matched"), "rank")


def dense_fusion(spark: SparkSession, sf: str) -> DataFrame:
    s, q, _, inner = _stages(spark, sf)
    return R.fuse(s, q, inner, 10).select("query", "item", *rounded("score"), "source_type")


def expand_trigger(spark: SparkSession, sf: str) -> DataFrame:
    s, q, _, inner = _stages(spark, sf)
    return R.expands(s, q, inner)


def cross_topic_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    s, q, adjusted, inner = _stages(spark, sf)
    return R.cross(s, q, adjusted, R.fuse(s, q, inner, 10), epsilon=0).select("query", "item", *rounded("score"))


def retrieve_full(spark: SparkSession, sf: str) -> DataFrame:
    return R.retrieve(store(spark, sf), B.queries_by_id(spark, sf), 10, epsilon=0).select("query", "item", *rounded("score"), "source_type", "rank")


def retrieve_memory_mode(spark: SparkSession, sf: str) -> DataFrame:
    return R.retrieve(store(spark, sf), B.queries_by_id(spark, sf), 10, mode="memory", epsilon=0).select("query", "item", *rounded("score"), "source_type", "rank")


def mmr_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return R.retrieve(store(spark, sf), B.queries_by_id(spark, sf), 10, diversify=True).select("query", "item", *rounded("score"), "rank")


QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, filtered_topk, similar_above, centroid_topics, single_topic, route_topics, route_topics_two_stage, dag_adjust_expand, dag_adjust_reduce,
        intra_topic_score, dense_fusion, expand_trigger, cross_topic_retrieve, retrieve_full, retrieve_memory_mode, mmr_rerank,
    )
}

_DOT = "round(list_dot_product({a}, {b}), 9)"
_STORE = f"""{B.VECTORS},
sm AS (SELECT x.topic, list_transform(list_zip(x.vector, y.vector), lambda e: e[1] + e[2]) AS s FROM c x JOIN c y ON y.topic = x.topic + 1),
t AS (SELECT topic, vector AS lv, (SELECT list_transform(s, lambda e: e / sqrt(list_dot_product(s, s))) FROM sm WHERE sm.topic = c.topic) AS sv, keywords FROM c),
tops AS (SELECT memory AS item, list_distinct(list(topic)) AS topics FROM vt GROUP BY 1),
mem AS (SELECT vec_id AS item, v, label, topics, (vec_id % 10) / 10 AS importance FROM v JOIN tops ON item = vec_id),
kw AS (SELECT query, topic, qv, lv, sv, text, len(list_filter(keywords, lambda k: contains(lower(text), lower(k)))) / len(keywords)::DOUBLE AS kr FROM q CROSS JOIN t),
route AS (SELECT query, topic, 0.4::DOUBLE * {_DOT.format(a='qv', b='lv')} + 0.35::DOUBLE * {_DOT.format(a='qv', b='coalesce(sv, lv)')} + 0.25::DOUBLE * kr AS score FROM kw)"""
_ADJUST = """adj AS (SELECT query, topic, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, topic)::INT AS rank FROM route QUALIFY rank <= 7)"""
_INTRA = f"""ql AS (SELECT query, list(topic) AS ts, list(topic) FILTER (rank <= 5) AS sc FROM adj GROUP BY 1),
hit AS (SELECT query, text, item, label, importance, topics, sc, ts, {_DOT.format(a='mem.v', b='qv')} AS sim FROM ql JOIN q USING (query) JOIN mem ON list_has_any(topics, ts)
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) <= 20),
hb AS (SELECT hit.query, item, text, label, importance, topics, sc, ts, sim, greatest(0, max(score)) AS best FROM hit JOIN adj ON adj.query = hit.query AND list_contains(topics, topic) GROUP BY ALL),
inner_ AS (SELECT query, item, sim + CASE WHEN list_has_any(topics, sc) THEN 0.2::DOUBLE * best + 0.1::DOUBLE * (contains(lower(text), 'topic' || label))::INT + 0.08::DOUBLE * importance ELSE 0 END AS score,
           array_to_string(list_sort(list_filter(topics, lambda x: list_contains(ts, x))), ',') AS matched FROM hb),
ir AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item)::INT AS rank FROM inner_ QUALIFY rank <= 10)"""
_FUSE = f"""gl AS (SELECT query, vec_id AS item, 0.8::DOUBLE * {_DOT.format(a='v.v', b='qv')} AS g FROM q CROSS JOIN v
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY {_DOT.format(a='v.v', b='qv')} DESC, vec_id) <= 20),
fu AS (SELECT coalesce(ir.query, gl.query) AS query, coalesce(ir.item, gl.item) AS item, greatest(score, g) AS score,
              CASE WHEN score IS NULL THEN 'global_dense' ELSE 'intra' END AS source_type FROM ir FULL JOIN gl ON ir.query = gl.query AND ir.item = gl.item)"""
_TRIGGER = """tr AS (SELECT q.query, coalesce(round(avg(score), 9) < 0.35, true) OR regexp_matches(lower(text), 'why|reason|cause|how come|what led to|explain|how did|what has|what have|what did|how many|how much|list|all the|all of|every|each time|what are|what were|which|name all') AS expand
       FROM q LEFT JOIN ir USING (query) GROUP BY q.query, text)"""


def _cross(only: str) -> str:
    steps = ["p0 AS (SELECT q, node, s AS p FROM seed)"]
    for k in range(1, 21):
        steps.append(
            f"p{k} AS MATERIALIZED (SELECT q, node, sum(p) AS p FROM (SELECT q, target AS node, 0.85::DOUBLE * p * share AS p FROM p{k - 1} JOIN moves ON node = source "
            "UNION ALL SELECT q, node, 0.15::DOUBLE * s FROM seed) GROUP BY 1, 2)"
        )
    return f"""one AS (SELECT topic, count(*) AS c FROM vt GROUP BY 1),
two AS (SELECT x.topic AS source, y.topic AS target, count(*) AS n FROM vt x JOIN vt y ON x.memory = y.memory AND x.topic <> y.topic GROUP BY 1, 2),
w AS (SELECT source, target, n / c::DOUBLE AS w FROM two JOIN one ON topic = source),
moves AS MATERIALIZED (SELECT source, target, w / sum(w) OVER (PARTITION BY source) AS share FROM w),
seed AS MATERIALIZED (SELECT query AS q, topic AS node, 1 / (count(*) OVER (PARTITION BY query))::DOUBLE AS s FROM adj {only}),
{', '.join(steps)},
re AS (SELECT q, node, p FROM p20 WHERE p > 0 AND (q, node) NOT IN (SELECT (q, node) FROM seed)
       QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(p, 12) DESC, node) <= 5),
ch AS (SELECT q.query, node, item, p, {_DOT.format(a='mem.v', b='qv')} AS sim FROM re JOIN q ON q.query = re.q JOIN mem ON list_contains(topics, node)
       QUALIFY row_number() OVER (PARTITION BY q.query, node ORDER BY sim DESC, item) <= 5),
cs AS (SELECT query, item, max(sim * p * 0.7::DOUBLE) AS score FROM ch WHERE (query, item) NOT IN (SELECT (query, item) FROM fu) GROUP BY 1, 2),
cr AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) <= 5)"""


_ALL_ROUTES = f"""ra AS (SELECT query, topic, 0.4::DOUBLE * greatest(0, {_DOT.format(a='qv', b='lv')}) + 0.35::DOUBLE * greatest(0, {_DOT.format(a='qv', b='coalesce(sv, lv)')}) + 0.25::DOUBLE * kr AS score FROM kw),
r AS (SELECT * FROM ra WHERE score > 0), n AS (SELECT query, count(*) AS n FROM r GROUP BY 1),
sib AS (SELECT query, t.topic, 0.7::DOUBLE * max(r.score) AS score FROM r JOIN n USING (query) JOIN t ON t.topic % 3 = r.topic % 3 WHERE n < 3
        AND (query, t.topic) NOT IN (SELECT (query, topic) FROM r) GROUP BY 1, 2),
adj AS (SELECT query, topic, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, topic)::INT AS rank FROM (SELECT * FROM r UNION ALL SELECT * FROM sib) QUALIFY rank <= 7)"""

SQL = {
    "retrieve_memory_mode": f"""WITH {_STORE}, {_ALL_ROUTES}, {_INTRA.replace('QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) <= 20', '')},
fu AS (SELECT query, item, score, 'intra' AS source_type FROM ir), {_TRIGGER}, {_cross('WHERE query IN (SELECT query FROM tr WHERE expand)')},
al AS (SELECT query, item, score, source_type FROM fu UNION ALL SELECT query, item, score, 'cross' FROM cr)
SELECT query, item, round(score, 6) + 0.0 AS score, source_type, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item)::INT AS rank FROM al QUALIFY rank <= 10""",
    "dense_topk": f"""WITH {B.VECTORS} SELECT query, vec_id AS item, round({_DOT.format(a='v.v', b='qv')}, 6) + 0.0 AS score,
row_number() OVER (PARTITION BY query ORDER BY {_DOT.format(a='v.v', b='qv')} DESC, vec_id)::INT AS rank FROM q CROSS JOIN v QUALIFY rank <= 10""",
    "filtered_topk": f"""WITH {_STORE}, x AS (SELECT query, item, {_DOT.format(a='mem.v', b='qv')} AS s FROM q JOIN v ON vec_id = query JOIN mem ON list_contains(topics, v.label))
SELECT query, item, round(s, 6) + 0.0 AS score, row_number() OVER (PARTITION BY query ORDER BY s DESC, item)::INT AS rank FROM x QUALIFY rank <= 10""",
    "similar_above": f"""WITH {B.VECTORS} SELECT query, vec_id AS item, round({_DOT.format(a='v.v', b='qv')}, 6) AS score FROM q CROSS JOIN v WHERE {_DOT.format(a='v.v', b='qv')} >= 0.35""",
    "centroid_topics": f"""WITH {B.VECTORS} SELECT topic, (unnest(range(len(vector))))::INT AS i, round(unnest(vector), 6) + 0.0 AS x FROM c""",
    "single_topic": f"""WITH {B.VECTORS} SELECT memory, vt.topic FROM vt JOIN v ON vec_id = memory JOIN c ON c.topic = vt.topic
QUALIFY row_number() OVER (PARTITION BY memory ORDER BY {_DOT.format(a='v.v', b='vector')} DESC, vt.topic) = 1""",
    "route_topics": f"""WITH {_STORE}, x AS (SELECT query, topic, 0.4::DOUBLE * greatest(0, {_DOT.format(a='qv', b='lv')}) + 0.35::DOUBLE * greatest(0, {_DOT.format(a='qv', b='coalesce(sv, lv)')}) + 0.25::DOUBLE * kr AS score FROM kw)
SELECT query, topic, round(score, 6) AS score FROM x WHERE score > 0""",
    "route_topics_two_stage": f"WITH {_STORE} SELECT query, topic, round(score, 6) + 0.0 AS score FROM route",
    "dag_adjust_expand": f"""WITH {_STORE}, r AS (SELECT * FROM route WHERE score >= 0.25), n AS (SELECT query, count(*) AS n FROM r GROUP BY 1),
sib AS (SELECT query, t.topic, 0.7::DOUBLE * max(r.score) AS score FROM r JOIN n USING (query) JOIN t ON t.topic % 3 = r.topic % 3 WHERE n < 3
        AND (query, t.topic) NOT IN (SELECT (query, topic) FROM r) GROUP BY 1, 2)
SELECT query, topic, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, topic)::INT AS rank FROM (SELECT * FROM r UNION ALL SELECT * FROM sib)
QUALIFY rank <= 7""",
    "dag_adjust_reduce": f"""WITH {_STORE}, r AS (SELECT query, topic, score FROM route WHERE topic <> 0 UNION ALL SELECT DISTINCT query, 500, 0.01::DOUBLE FROM route)
SELECT query, topic, round(score, 6) + 0.0 AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, topic)::INT AS rank FROM r QUALIFY rank <= 7""",
    "intra_topic_score": f"WITH {_STORE}, {_ADJUST}, {_INTRA} SELECT query, item, round(score, 6) + 0.0 AS score, matched, rank FROM ir",
    "dense_fusion": f"WITH {_STORE}, {_ADJUST}, {_INTRA}, {_FUSE} SELECT query, item, round(score, 6) + 0.0 AS score, source_type FROM fu",
    "expand_trigger": f"WITH {_STORE}, {_ADJUST}, {_INTRA}, {_TRIGGER} SELECT query, expand FROM tr",
    "cross_topic_retrieve": f"WITH {_STORE}, {_ADJUST}, {_INTRA}, {_FUSE}, {_cross('')} SELECT query, item, round(score, 6) + 0.0 AS score FROM cr",
    "retrieve_full": f"""WITH {_STORE}, {_ADJUST}, {_INTRA}, {_FUSE}, {_TRIGGER}, {_cross('WHERE query IN (SELECT query FROM tr WHERE expand)')},
al AS (SELECT query, item, score, source_type FROM fu UNION ALL SELECT query, item, score, 'cross' FROM cr)
SELECT query, item, round(score, 6) + 0.0 AS score, source_type, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item)::INT AS rank FROM al QUALIFY rank <= 10""",
}
