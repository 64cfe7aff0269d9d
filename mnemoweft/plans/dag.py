"""Queries on building and maintaining the hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft.functions.vector import norm, normalise
from mnemoweft.operators import dag as D
from mnemoweft.operators.assoc import marginals
from mnemoweft.operators.hierarchy import Hierarchy, links_of
from mnemoweft.plans import bindings as B
from mnemoweft.plans.bindings import rounded
from mnemoweft.runtime import cut
from mnemoweft.tables import current, table

MIDDLE = "2024-01-16"


def _geo(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    nation, customer, supplier = (table(spark, sf, t) for t in ("nation", "customer", "supplier"))
    parts = [
        nation.select(name("R", "n_regionkey").alias("parent"), name("N", "n_nationkey").alias("child")),
        customer.select(name("N", "c_nationkey").alias("parent"), name("C", "c_custkey").alias("child")),
        supplier.select(name("N", "s_nationkey").alias("parent"), name("S", "s_suppkey").alias("child")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _topic_links(spark: SparkSession, sf: str) -> DataFrame:
    return links_of(current(spark, sf, "topics", ["topic_id", "parent_ids", "child_ids"]), "topic_id", "parent_ids", "child_ids")


def _topics(spark: SparkSession, sf: str, unit: bool = True) -> DataFrame:
    """Current topics; without unit the vectors are the floats of the table, to be divided by their lengths where they are used."""
    names = ["topic_id", "label", "keywords", "label_embedding", "summary_embedding", "is_virtual", "depth", "memory_count_since_summary"]
    t = current(spark, sf, "topics", names)

    def vector(c):
        ok = (F.size(c) == 384) & (norm(F.col(c)) > 0)
        return F.when(ok, normalise(F.col(c)) if unit else F.col(c))

    words = F.array_distinct(F.filter(F.transform("keywords", lambda k: F.lower(F.trim(k))), lambda k: k.isNotNull() & (k != "")))
    return t.select(F.col("topic_id").alias("topic"), "label", words.alias("keywords"), vector("label_embedding").alias("label_vector"), vector("summary_embedding").alias("summary_vector"), "is_virtual", "depth", "memory_count_since_summary")


def descendants(spark: SparkSession, sf: str) -> DataFrame:
    return Hierarchy(_geo(spark, sf)).descendants().select("ancestor", "descendant", F.col("distance").cast("long").alias("distance"))


def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    up = Hierarchy(_geo(spark, sf)).descendants()
    return up.groupBy(F.col("descendant").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("ancestor")), ",").alias("ancestors"))


def siblings(spark: SparkSession, sf: str) -> DataFrame:
    """Of every 50th customer, among all nodes of the geography."""
    asked = table(spark, sf, "customer").filter(F.col("c_custkey") % 50 == 0).select(F.concat(F.lit("C"), "c_custkey").alias("topic"))
    return D.siblings_of(_geo(spark, sf), asked)


def children_parents(spark: SparkSession, sf: str) -> DataFrame:
    links = _topic_links(spark, sf)
    down = links.groupBy(F.col("parent").alias("topic")).agg(F.count("*").alias("n_children"))
    up = links.groupBy(F.col("child").alias("topic")).agg(F.count("*").alias("n_parents"))
    return down.join(up, "topic", "full").select("topic", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_parents", F.lit(0)).alias("n_parents"))


def dag_depth(spark: SparkSession, sf: str) -> DataFrame:
    links = cut(_topic_links(spark, sf))
    return Hierarchy(links).paths().join(links.select(F.col("child").alias("top")).distinct(), "top", "left_anti").groupBy("node").agg(F.min("depth").alias("depth"))


def attach_orphans(spark: SparkSession, sf: str) -> DataFrame:
    nodes = current(spark, sf, "topics", ["topic_id"]).select(F.col("topic_id").alias("topic"))
    return D.attach_orphans(nodes, _topic_links(spark, sf))


def dag_tree(spark: SparkSession, sf: str) -> DataFrame:
    geo = _geo(spark, sf)
    names = table(spark, sf, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"), F.col("r_name").alias("label"), F.lit(True).alias("is_virtual"))
    nations = table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.col("n_name").alias("label"), F.lit(False).alias("is_virtual"))
    return D.tree_lines(Hierarchy(geo).paths(), names.unionByName(nations))


def topic_similarity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return D.similar_pairs(_topics(spark, sf, unit=False), 0.55, unit=True).select("a", "b", *rounded("similarity"))


def multi_parent_candidates(spark: SparkSession, sf: str) -> DataFrame:
    t = cut(_topics(spark, sf))
    return D.multi_parents(t.filter("not is_virtual"), t.filter("is_virtual"), _topic_links(spark, sf), least=0.45).select("child", "parent", *rounded("similarity"))


def sibling_merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    t = _topics(spark, sf, unit=False)
    links = cut(_topic_links(spark, sf).filter("parent <> '__ROOT__'").unionByName(D.attach_orphans(t, _topic_links(spark, sf)).filter("parent = '__ROOT__'")))
    return _mergeable(spark, sf, t, links)


def _mergeable(spark: SparkSession, sf: str, t: DataFrame, links: DataFrame) -> DataFrame:
    from dataclasses import replace

    from mnemoweft.config import DEFAULTS

    return D.mergeable_siblings(t, links.distinct(), marginals(B.memory_topics(spark, sf)), replace(DEFAULTS, sibling_merge=0.5, sibling_merge_memories=1000), unit=True).select("a", "b", *rounded("similarity"))


def sibling_merge(spark: SparkSession, sf: str) -> DataFrame:
    return D.rewire(_topic_links(spark, sf), D.merge_map(cut(sibling_merge_candidates(spark, sf))))


def topic_split_halves(spark: SparkSession, sf: str) -> DataFrame:
    m = current(spark, sf, "memories", ["memory_id", "created_at"]).select(F.col("memory_id").alias("memory"), "created_at")
    rows = B.memory_topics(spark, sf).join(m, "memory")
    return D.split_halves(rows, "topic", ["created_at", "memory"]).select("topic", "memory", "half")


def drift_jsd(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "ts")
    return D.drift(e.filter(F.col("ts") < MIDDLE), e.filter(F.col("ts") >= MIDDLE), ["user_id"], "event_type").select("user_id", *rounded("jsd"))


def hac_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of all topics that are not virtual, by their own distance at the default cuts."""
    return D.cluster_topics(_topics(spark, sf, unit=False).filter("not is_virtual"), unit=True).select("cluster", "distance", "member")


def insert_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Where topics without a parent would go: greedy descent from the root."""
    t = cut(_topics(spark, sf))
    links = cut(_topic_links(spark, sf))
    lone = t.filter("topic <> '__ROOT__'").join(links.select(F.col("child").alias("topic")), "topic", "left_anti")
    return D.greedy_descent(lone, t, links, "__ROOT__", 0.15)


def summary_due(spark: SparkSession, sf: str) -> DataFrame:
    m = current(spark, sf, "memories", ["memory_id", "content"]).withColumnRenamed("memory_id", "memory")
    due = D.summaries_due(_topics(spark, sf), B.memory_topics(spark, sf), m)
    return due.select("topic", F.size("texts").alias("n"), F.array_join("texts", " ").alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        descendants, ancestors, siblings, children_parents, dag_depth, attach_orphans, dag_tree, topic_similarity_pairs, multi_parent_candidates,
        sibling_merge_candidates, sibling_merge, topic_split_halves, drift_jsd, hac_cut, insert_candidates, summary_due,
    )
}

_GEO = """geo AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier)"""
_DOWN = f"""{_GEO}, down AS (SELECT parent AS ancestor, child AS descendant, 1 AS distance FROM geo UNION ALL
SELECT ancestor, child, distance + 1 FROM down JOIN geo ON parent = descendant)"""
_LINKS = """kcur AS (SELECT topic_id, parent_ids, child_ids FROM topics QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC) = 1),
links AS (SELECT DISTINCT parent, child FROM (SELECT unnest(parent_ids) AS parent, topic_id AS child FROM kcur UNION ALL SELECT topic_id, unnest(child_ids) FROM kcur)
          WHERE parent IS NOT NULL AND child IS NOT NULL)"""


def _unit(c: str) -> str:
    return f"CASE WHEN len({c}) = 384 AND list_dot_product({c}::DOUBLE[], {c}::DOUBLE[]) > 0 THEN list_transform({c}::DOUBLE[], lambda e: e / sqrt(list_dot_product({c}::DOUBLE[], {c}::DOUBLE[]))) END"


_SIM = f"""ucur AS (SELECT * FROM topics QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC) = 1),
u AS MATERIALIZED (SELECT topic_id AS topic, is_virtual, depth, memory_count_since_summary,
      list_distinct(list_filter(list_transform(coalesce(keywords, []), lambda k: lower(trim(k))), lambda k: k <> '')) AS kw,
      list_distinct(list_filter(regexp_split_to_array(lower(coalesce(label, '')), '\\s+'), lambda k: k <> '')) AS ws,
      {_unit('label_embedding')} AS lv, {_unit('summary_embedding')} AS sv FROM ucur),
pr AS (SELECT a.topic AS a, b.topic AS b, a.depth AS da, b.depth AS db, a.is_virtual AS va, b.is_virtual AS vb,
        coalesce(round(list_dot_product(a.lv, b.lv), 9), 0) AS l, round(list_dot_product(a.sv, b.sv), 9) AS s,
        len(list_intersect(a.kw, b.kw)) AS ki, len(a.kw) AS ka, len(b.kw) AS kb, len(list_intersect(a.ws, b.ws)) AS wi, least(len(a.ws), len(b.ws)) AS wm FROM u a JOIN u b ON a.topic <> b.topic),
sim AS MATERIALIZED (SELECT a, b, da, db, va, vb, round(0.35::DOUBLE * l + 0.25::DOUBLE * coalesce(s, l) + CASE WHEN ka + kb > 0 THEN 0.2::DOUBLE * (ki / (ka + kb - ki)::DOUBLE) ELSE 0 END
        + CASE WHEN wm > 0 THEN 0.2::DOUBLE * (wi / wm::DOUBLE) ELSE 0 END, 9) AS similarity FROM pr)"""

_FEW = """few AS (SELECT topic FROM u WHERE topic NOT IN (SELECT topic FROM mt GROUP BY 1 HAVING count(*) >= 1000)),
al AS (SELECT parent, child FROM links UNION SELECT '__ROOT__', topic FROM u WHERE topic <> '__ROOT__' AND topic NOT IN (SELECT child FROM links)),
mg AS (SELECT DISTINCT a, b, round(similarity, 6) AS similarity FROM sim JOIN al x ON x.child = a JOIN al y ON y.child = b AND x.parent = y.parent
       WHERE a < b AND similarity > 0.5 AND a IN (SELECT topic FROM few) AND b IN (SELECT topic FROM few))"""

SQL = {
    "descendants": f"WITH RECURSIVE {_DOWN} SELECT ancestor, descendant, distance::BIGINT AS distance FROM down",
    "ancestors": f"WITH RECURSIVE {_DOWN} SELECT descendant AS node, string_agg(ancestor, ',' ORDER BY ancestor) AS ancestors FROM down GROUP BY 1",
    "siblings": f"WITH {_GEO} SELECT DISTINCT a.child AS topic, b.child AS sibling FROM geo a JOIN geo b ON a.parent = b.parent AND a.child <> b.child WHERE a.child LIKE 'C%' AND substr(a.child, 2)::INT % 50 = 0",
    "children_parents": f"""WITH {_LINKS} SELECT topic, (count(*) FILTER (down))::BIGINT AS n_children, (count(*) FILTER (NOT down))::BIGINT AS n_parents
FROM (SELECT parent AS topic, true AS down FROM links UNION ALL SELECT child, false FROM links) GROUP BY 1""",
    "dag_depth": f"""WITH RECURSIVE {_LINKS}, d AS (SELECT DISTINCT parent AS node, 0 AS depth FROM links WHERE parent NOT IN (SELECT child FROM links)
UNION SELECT child, depth + 1 FROM d JOIN links ON parent = node WHERE depth < 400) SELECT node, min(depth) AS depth FROM d GROUP BY 1""",
    "attach_orphans": f"""WITH {_LINKS} SELECT parent, child FROM links UNION ALL
SELECT '__ROOT__', topic_id FROM kcur WHERE topic_id <> '__ROOT__' AND topic_id NOT IN (SELECT child FROM links)""",
    "dag_tree": f"""WITH {_GEO}, r AS (SELECT 'R' || r_regionkey AS id, r_name AS l FROM region), n AS (SELECT 'N' || n_nationkey AS id, n_name AS l FROM nation),
used AS (SELECT DISTINCT parent FROM geo WHERE parent LIKE 'R%')
SELECT id AS path, '[V] ' || l AS line FROM r JOIN used ON parent = id
UNION ALL SELECT g.parent || '/' || id, '  ' || l FROM geo g JOIN n ON child = id
UNION ALL SELECT g.parent || '/' || h.parent || '/' || h.child, '    ' || h.child FROM geo g JOIN geo h ON h.parent = g.child""",
    "topic_similarity_pairs": f"WITH {_SIM} SELECT a, b, round(similarity, 6) AS similarity FROM sim WHERE a < b AND similarity >= 0.55",
    "multi_parent_candidates": f"""WITH {_LINKS}, {_SIM} SELECT a AS child, b AS parent, round(similarity, 6) AS similarity FROM sim
WHERE NOT va AND vb AND db < da AND similarity > 0.45 AND (a, b) NOT IN (SELECT (child, parent) FROM links) ORDER BY sim.similarity DESC, a, b LIMIT 50""",
    "sibling_merge_candidates": f"""WITH {_LINKS}, {_SIM}, {B.MEMORY_TOPICS}, {_FEW} SELECT * FROM mg""",
    "sibling_merge": f"""WITH RECURSIVE {_LINKS}, {_SIM}, {B.MEMORY_TOPICS}, {_FEW},
ed AS (SELECT a AS x, b AS y FROM mg UNION SELECT b, a FROM mg), rc AS (SELECT x, y FROM ed UNION SELECT rc.x, ed.y FROM rc JOIN ed ON rc.y = ed.x),
mp AS (SELECT x AS k, min(y) AS into_ FROM rc GROUP BY 1 HAVING min(y) < x)
SELECT DISTINCT coalesce(p.into_, parent) AS parent, coalesce(q.into_, child) AS child FROM links LEFT JOIN mp p ON p.k = parent LEFT JOIN mp q ON q.k = child
WHERE coalesce(p.into_, parent) <> coalesce(q.into_, child)""",
    "insert_candidates": f"""WITH RECURSIVE {_LINKS}, {_SIM},
go AS (SELECT topic, '__ROOT__' AS visited, 0 AS depth, ['__ROOT__'] AS seen FROM u WHERE topic <> '__ROOT__' AND topic NOT IN (SELECT child FROM links) UNION ALL
SELECT topic, child, depth + 1, list_append(seen, child) FROM (SELECT topic, child, depth, seen, row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, child) AS k
      FROM go JOIN links ON parent = visited JOIN sim ON a = topic AND b = child WHERE similarity >= 0.15) WHERE k = 1 AND NOT list_contains(seen, child))
SELECT topic, visited, depth FROM go""",
    "topic_split_halves": f"""WITH {B.MEMORY_TOPICS}, c AS (SELECT memory_id, created_at FROM memories QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at DESC) = 1),
r AS (SELECT topic, memory, row_number() OVER (PARTITION BY topic ORDER BY created_at, memory) AS k, count(*) OVER (PARTITION BY topic) AS n FROM mt JOIN c ON memory_id = memory)
SELECT topic, memory, (k > n // 2)::INT AS half FROM r""",
    "drift_jsd": f"""WITH h AS (SELECT user_id, event_type, ts < '{MIDDLE}' AS early, count(*)::DOUBLE AS c FROM events GROUP BY ALL),
us AS (SELECT user_id, bool_or(early) AND bool_or(NOT early) AS both_ FROM h GROUP BY 1),
k AS (SELECT DISTINCT user_id, event_type FROM h),
w AS (SELECT user_id, event_type, coalesce(p.c, 1e-10) AS p, coalesce(q.c, 1e-10) AS q FROM k LEFT JOIN (SELECT * FROM h WHERE early) p USING (user_id, event_type)
      LEFT JOIN (SELECT * FROM h WHERE NOT early) q USING (user_id, event_type)),
z AS (SELECT user_id, p / sum(p) OVER (PARTITION BY user_id) AS p, q / sum(q) OVER (PARTITION BY user_id) AS q FROM w),
j AS (SELECT user_id, sum(0.5::DOUBLE * p * ln(p / ((p + q) / 2)) + 0.5::DOUBLE * q * ln(q / ((p + q) / 2))) AS j FROM z GROUP BY 1)
SELECT user_id, round(CASE WHEN both_ THEN j ELSE ln(2) END, 6) + 0.0 AS jsd FROM j JOIN us USING (user_id)""",
    "summary_due": f"""WITH {B.MEMORY_TOPICS}, c AS (SELECT memory_id, content FROM memories QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at DESC, content DESC NULLS LAST) = 1),
d AS (SELECT topic_id FROM (SELECT * FROM topics QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC) = 1) WHERE memory_count_since_summary >= 5 AND NOT is_virtual),
r AS (SELECT topic, content, memory FROM mt JOIN d ON topic_id = topic JOIN c ON memory_id = memory WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic ORDER BY memory) <= 20)
SELECT topic, count(*)::INT AS n, string_agg(content, ' ' ORDER BY memory) AS text FROM r GROUP BY 1""",
}
