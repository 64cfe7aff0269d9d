"""Queries that run the stages of retrieval, the engine and its ablations over topics, memories and turns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft import experiments as X
from mnemoweft.engine import Engine
from mnemoweft.functions.text import ENUMERATIONS, REASONS
from mnemoweft.functions.vector import dot
from mnemoweft.models import HashEmbedder, KeywordModel
from mnemoweft.operators import evaluate as E
from mnemoweft.operators import retrieve as R
from mnemoweft.operators.hierarchy import Hierarchy
from mnemoweft.plans import bindings as B
from mnemoweft.plans.bindings import rounded
from mnemoweft.plans.dag import _LINKS, _topic_links
from mnemoweft.plans.evaluation import _MEMBERS, _SCORED, _evidence, _members, _texts
from mnemoweft.plans.segmentation import _SEGMENTS, _TURNS, hashed
from mnemoweft.runtime import cut
from mnemoweft.tables import current, table

K = 5
#: Labels that stand for a model's, and the words that bring them.
RULES = {
    "moods": ["overwhelmed", "relieved", "determined", "exhausted"], "outdoors": ["stargazing", "birdwatching", "cycling", "rowing"],
    "crafts": ["welding", "coding", "repairs"], "seasons": ["winter", "spring", "summer"], "meals": ["breakfast", "picnic", "kettle"],
    "crowds": ["auction", "concert", "charity"], "illness": ["surgery", "recovering"],
}


def store(spark: SparkSession, sf: str) -> R.Store:
    """Current topics, memories, links and edges, with vectors of their texts."""
    encode = lambda c: HashEmbedder(64).encode(F.col(c))
    clean = lambda c: F.coalesce(F.array_distinct(F.filter(F.transform(c, lambda k: F.lower(F.trim(k))), lambda k: k.isNotNull() & (k != ""))), F.array().cast("array<string>"))
    t = current(spark, sf, "topics", ["topic_id", "label", "summary", "keywords", "is_virtual"])
    summary = F.when(F.coalesce(F.trim("summary"), F.lit("")) != "", encode("summary"))
    topics = t.select(F.col("topic_id").alias("topic"), encode("label").alias("label_vector"), summary.alias("summary_vector"), clean("keywords").alias("keywords"), "is_virtual")
    m = current(spark, sf, "memories", ["memory_id", "content", "topic_ids", "keywords", "importance"])
    of = F.coalesce(F.array_distinct(F.filter("topic_ids", lambda x: x.isNotNull())), F.array().cast("array<string>"))
    memories = m.select(F.col("memory_id").alias("item"), encode("content").alias("vector"), of.alias("topics"), clean("keywords").alias("keywords"), "importance")
    links = cut(_topic_links(spark, sf))
    e = current(spark, sf, "assoc_edges", ["source_id", "target_id", "weight"])
    edges = e.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "weight").filter("weight > 0 and not isnan(weight)")
    return R.Store(cut(topics), cut(memories), links, cut(Hierarchy(links).descendants().select("ancestor", "descendant")), cut(edges))


def _single(s: R.Store) -> R.Store:
    """Each memory with the most similar of its topics only."""
    rows = s.memories.select("item", "vector", F.explode("topics").alias("topic")).join(s.topics.select("topic", "label_vector"), "topic")
    best = rows.groupBy("item").agg(F.max_by("topic", F.struct(F.round(dot(F.col("vector"), F.col("label_vector")), 9), "topic")).alias("one"))
    one = F.when(F.col("one").isNotNull(), F.array("one")).otherwise(F.col("topics"))
    return replace(s, memories=cut(s.memories.join(best, "item", "left").withColumn("topics", one).drop("one")))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "eval_items")
    return cut(q.select(F.col("item_id").alias("query"), F.col("question").alias("text"), F.col("sample_id").alias("sample"), "category", "evidence", HashEmbedder(64).encode(F.col("question")).alias("qv")))


def store_route(spark: SparkSession, sf: str) -> DataFrame:
    """The two-stage search of topics for all questions."""
    return R.route_indexed(store(spark, sf), _asked(spark, sf)).select(F.col("query").alias("item_id"), "topic", *rounded("score"))


def store_adjust(spark: SparkSession, sf: str) -> DataFrame:
    s = store(spark, sf)
    return R.adjust(s, R.route_indexed(s, _asked(spark, sf))).select(F.col("query").alias("item_id"), "topic", *rounded("score"), "rank")


def store_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    found = R.retrieve(store(spark, sf), _asked(spark, sf), K, epsilon=0)
    return found.select(F.col("query").alias("item_id"), "item", *rounded("score"), "source_type", "rank")


def retrieve_results(spark: SparkSession, sf: str) -> DataFrame:
    """What retrieve finds, as shown to a reader."""
    s = store(spark, sf)
    m = current(spark, sf, "memories", ["memory_id", "content"]).select(F.col("memory_id").alias("item"), "content")
    t = current(spark, sf, "topics", ["topic_id", "label"]).select(F.col("topic_id").alias("topic"), "label")
    shown = R.formatted(R.retrieve(s, _asked(spark, sf), K, epsilon=0), m.join(s.memories.select("item", "topics"), "item"), t)
    return shown.select(F.col("query").alias("item_id"), "rank", "item", "content", "score", F.array_join("labels", ", ").alias("labels"))


def _sources(spark: SparkSession, sf: str, s: R.Store) -> DataFrame:
    m = current(spark, sf, "memories", ["memory_id", "source_segment_id", "source_dia_ids"])
    seg = table(spark, sf, "segments").groupBy("segment_id").agg(F.max("sample_id").alias("sample"))
    rows = m.join(seg, m["source_segment_id"] == seg["segment_id"], "left").select(F.col("memory_id").alias("item"), F.col("source_dia_ids").alias("sources"), "sample")
    return cut(rows.join(s.memories.select("item", "vector"), "item"))


def ablation_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """P@5 and R@5 of retrieval as a whole and with one part left out (the store is given, so its boundaries stay)."""
    s, q = store(spark, sf), _asked(spark, sf)
    m, texts = _sources(spark, sf, s), cut(_texts(spark, sf))
    out = None
    for name in ("full", "no_multilabel", "no_dag", "no_cross"):
        found = R.retrieve(_single(s) if name == "no_multilabel" else s, q, K, epsilon=0, **X.FLAGS.get(name, {}))
        part = cut(X.scored(found, m, q, texts, K).select(F.lit(name).alias("variant"), "p_at_k", "r_at_k"))
        out = part if out is None else out.unionByName(part)
    names = ["full", "no_multilabel", "no_dag", "no_cross"]
    return E.compare(out, "variant", names, ["p_at_k", "r_at_k"]).select("measure", *rounded(*names))


def _wanted(spark: SparkSession, sf: str, s: R.Store, q: DataFrame) -> DataFrame:
    """query, item: the evidence memories outside the routed topics, of questions whose evidence spans topics."""
    routed = R.route_indexed(s, q)
    tops = routed.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct(-F.round("score", 9), "topic"))), 1, s.settings.max_routed)["topic"].alias("t"))
    evidence = _evidence(spark, sf).join(q.select("query", "sample"), "query")
    held = cut(E.evidence_memories(_sources(spark, sf, s), evidence, _texts(spark, sf)))
    return cut(E.cross_topic(held, _members(spark, sf), tops.select("query", F.explode("t").alias("topic"))))


def cross_topic_memories(spark: SparkSession, sf: str) -> DataFrame:
    return _wanted(spark, sf, store(spark, sf), _asked(spark, sf)).withColumnRenamed("query", "item_id")


def ppr_contribution(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of those memories with and without the expansion by PageRank, and its mean gain."""
    s, q = store(spark, sf), _asked(spark, sf)
    run = lambda use: R.retrieve(s, q, K, epsilon=0, use_cross=use)
    rows = X.contribution(run, _wanted(spark, sf, s, q), q)
    return rows.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("full", "without", "difference")], F.count("*").alias("n"))


def metric_items(spark: SparkSession, sf: str) -> DataFrame:
    """The lists of answered items per sample as rows, without category 5."""
    q = table(spark, sf, "eval_items").select("sample_id", F.struct("item_id", "category", F.length("question").alias("n_chars")).alias("one"))
    lists = q.groupBy("sample_id").agg(F.array_sort(F.collect_list("one")).alias("items"))
    return E.flattened(lists, "sample_id", "items")


def _engine(spark: SparkSession, sf: str) -> Engine:
    turns = current(spark, sf, "turns", ["sample_id", "session_id", "turn_idx", "dia_id", "role", "content", "ts", "ingested_at"])
    e = Engine(spark, model=KeywordModel(RULES))
    e.ingest(turns.drop("ingested_at").withColumn("role", F.lower(F.trim("role"))))
    return e


def engine_memories(spark: SparkSession, sf: str) -> DataFrame:
    """All turns through the engine: a memory per segment with the labels of its topics, a store per sample."""
    e = _engine(spark, sf)
    named = e.tables["memories"].select("item", F.posexplode("topics").alias("at", "topic")).join(e.tables["topics"].select("topic", "label", F.col("scope").alias("own")), "topic")
    labels = named.groupBy("item").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "label")))["label"], ",").alias("labels"), F.max("own").alias("own"))
    rows = e.tables["memories"].join(labels, "item").filter("own = sample_id")
    return rows.select("sample_id", F.array_join("source_dia_ids", ",").alias("dia_ids"), "content", "labels")


def engine_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The association graph of each sample that the engine builds from all turns."""
    e = _engine(spark, sf)
    edges = e.association(e.tables["topics"])
    label = lambda end: e.tables["topics"].select(F.col("topic").alias(end), F.col("label").alias(f"{end}_label"), F.col("scope").alias(f"{end}_scope"))
    rows = edges.join(label("source"), "source").join(label("target"), "target").filter("source_scope = target_scope")
    return rows.select(F.col("source_scope").alias("sample_id"), F.col("source_label").alias("source"), F.col("target_label").alias("target"), F.round("weight", 6).alias("weight"))


QUERIES = {
    f.__name__: f
    for f in (
        store_route, store_adjust, store_retrieve, retrieve_results, ablation_pivot, cross_topic_memories, ppr_contribution, metric_items, engine_memories, engine_edges,
    )
}


def _dense(source: str, key: str, text: str, name: str) -> str:
    """name(key, v): the hash vector of a text as a list."""
    return f"""{hashed(source, key, text, name + '_s')},
{name} AS (SELECT s.{key}, list(coalesce(h.x, 0)::DOUBLE ORDER BY d.i) AS v FROM {source} s CROSS JOIN (SELECT unnest(range(64)) AS i) d LEFT JOIN {name}_s h ON h.{key} = s.{key} AND h.i = d.i GROUP BY 1)"""


def _clean(c: str) -> str:
    return f"list_distinct(list_filter(list_transform(coalesce({c}, []), lambda k: lower(trim(k))), lambda k: k <> ''))"


_DOT = "round(list_dot_product({}, {}), 9)"
_RATIO = "CASE WHEN len({k}) > 0 THEN len(list_filter({k}, lambda k: contains(lower(text), k))) / len({k})::DOUBLE ELSE 0 END"
_BASE = f"""{_LINKS}, rch AS (SELECT parent AS a, child AS d FROM links UNION SELECT a, child FROM rch JOIN links ON parent = d),
tc AS (SELECT topic_id AS topic, label, summary, keywords, is_virtual FROM topics QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC) = 1),
ts AS (SELECT topic, summary FROM tc WHERE coalesce(trim(summary), '') <> ''),
{_dense('tc', 'topic', 'label', 'tl')}, {_dense('ts', 'topic', 'summary', 'tu')},
t AS MATERIALIZED (SELECT topic, tl.v AS lv, coalesce(tu.v, tl.v) AS sv, {_clean('keywords')} AS kw, is_virtual FROM tc JOIN tl USING (topic) LEFT JOIN tu USING (topic)),
mc AS (SELECT memory_id AS item, content, topic_ids, keywords, importance, source_segment_id, source_dia_ids FROM memories QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at DESC, content DESC NULLS LAST) = 1),
{_dense('mc', 'item', 'content', 'mh')},
mem0 AS MATERIALIZED (SELECT item, v, list_distinct(list_filter(coalesce(topic_ids, []), lambda x: x IS NOT NULL)) AS topics, {_clean('keywords')} AS kw, coalesce(importance, 0.5) AS importance FROM mc JOIN mh USING (item)),
qq AS (SELECT item_id AS query, question AS text FROM eval_items), {_dense('qq', 'query', 'text', 'qh')},
q AS MATERIALIZED (SELECT query, text, v AS qv FROM qq JOIN qh USING (query))"""
_SINGLE = f"""mem AS MATERIALIZED (SELECT mem0.item, v, coalesce(one, topics) AS topics, kw, importance FROM mem0 LEFT JOIN (SELECT item, [max_by(t.topic, ({_DOT.format('v', 'lv')}, t.topic))] AS one
FROM (SELECT item, v, unnest(topics) AS topic FROM mem0) x JOIN t ON t.topic = x.topic GROUP BY 1) s ON s.item = mem0.item)"""
_ALL = "mem AS (SELECT * FROM mem0)"
_ROUTE = f"""live AS (SELECT topic, kw FROM t WHERE NOT is_virtual AND topic IN (SELECT unnest(topics) FROM mem)),
hits AS (SELECT query, topic, 0.4::DOUBLE * s AS s FROM (SELECT query, topic, {_DOT.format('qv', 'lv')} AS s FROM q CROSS JOIN t QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, topic) <= 21)
  UNION ALL SELECT query, topic, 0.35::DOUBLE * s FROM (SELECT query, topic, {_DOT.format('qv', 'sv')} AS s FROM q CROSS JOIN t QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, topic) <= 21)),
route AS MATERIALIZED (SELECT query, topic, s + 0.25::DOUBLE * {_RATIO.format(k='kw')} AS score FROM (SELECT query, topic, sum(s) AS s FROM hits GROUP BY 1, 2) JOIN live USING (topic) JOIN q USING (query))"""
_ADJUST = """n AS (SELECT query, count(*) AS n FROM route GROUP BY 1),
kin AS (SELECT query, y.child AS topic, 0.7::DOUBLE * max(score) AS score FROM route JOIN n USING (query) JOIN links x ON x.child = topic JOIN links y ON y.parent = x.parent WHERE n < 3
        AND (query, y.child) NOT IN (SELECT (query, topic) FROM route) GROUP BY 1, 2),
ev0 AS (SELECT query, topic, score, count(*) OVER (PARTITION BY query) AS m FROM (SELECT * FROM route UNION ALL SELECT * FROM kin)),
over_ AS (SELECT DISTINCT x.query, x.topic FROM ev0 x JOIN rch ON a = x.topic AND d <> a JOIN ev0 y ON y.query = x.query AND y.topic = d WHERE x.m > 7),
adj AS MATERIALIZED (SELECT query, topic, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, topic)::INT AS rank FROM ev0 WHERE (query, topic) NOT IN (SELECT (query, topic) FROM over_) QUALIFY rank <= 7)"""
_PLAIN = "adj AS MATERIALIZED (SELECT query, topic, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, topic)::INT AS rank FROM route QUALIFY rank <= 7)"
_INNER = f"""pair AS (SELECT query, x.item, max(adj.score) AS best, bool_or(rank <= 5) AS sc FROM (SELECT item, unnest(topics) AS topic FROM mem) x JOIN adj USING (topic) GROUP BY 1, 2),
hit AS (SELECT query, item, best, sc, {_DOT.format('v', 'qv')} AS sim, mem.kw, importance, text FROM pair JOIN mem USING (item) JOIN q USING (query) QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) <= 20),
ir AS MATERIALIZED (SELECT query, item, sim + CASE WHEN sc THEN 0.2::DOUBLE * greatest(best, 0) + 0.1::DOUBLE * {_RATIO.format(k='kw')} + 0.08::DOUBLE * importance ELSE 0 END AS score FROM hit
       QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) <= 10),
gl AS (SELECT query, item, 0.8::DOUBLE * {_DOT.format('v', 'qv')} AS g FROM q CROSS JOIN mem QUALIFY row_number() OVER (PARTITION BY query ORDER BY {_DOT.format('v', 'qv')} DESC, item) <= 10),
fu AS MATERIALIZED (SELECT coalesce(ir.query, gl.query) AS query, coalesce(ir.item, gl.item) AS item, greatest(score, g) AS score, CASE WHEN score IS NULL THEN 'global_dense' ELSE 'intra' END AS source_type
       FROM ir FULL JOIN gl ON ir.query = gl.query AND ir.item = gl.item),
tr AS (SELECT q.query, coalesce(round(avg(score), 9) < 0.35, true) OR regexp_matches(lower(text), '{"|".join(REASONS + ENUMERATIONS)}') AS expand FROM q LEFT JOIN ir USING (query) GROUP BY q.query, text)"""


def _expansion() -> str:
    steps = ["p0 AS (SELECT q, node, s AS p FROM seed)"]
    for k in range(1, 21):
        steps.append(
            f"p{k} AS MATERIALIZED (SELECT q, node, sum(p) AS p FROM (SELECT q, target AS node, 0.85::DOUBLE * p * share AS p FROM p{k - 1} JOIN moves ON node = source "
            "UNION ALL SELECT q, node, 0.15::DOUBLE * s FROM seed) GROUP BY 1, 2)"
        )
    return f"""{B.EDGES}, moves AS MATERIALIZED (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS share FROM ecur WHERE weight > 0 AND NOT isnan(weight)),
seed AS MATERIALIZED (SELECT query AS q, topic AS node, 1 / (count(*) OVER (PARTITION BY query))::DOUBLE AS s FROM adj WHERE query IN (SELECT query FROM tr WHERE expand)),
{', '.join(steps)},
re AS MATERIALIZED (SELECT q, node, p FROM p20 WHERE p > 0 AND (q, node) NOT IN (SELECT (q, node) FROM seed) QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(p, 12) DESC, node) <= 5),
ch AS (SELECT q.query, node, item, p, {_DOT.format('mem.v', 'qv')} AS sim FROM re JOIN q ON q.query = re.q JOIN (SELECT item, v, unnest(topics) AS topic FROM mem) mem ON topic = node
       QUALIFY row_number() OVER (PARTITION BY q.query, node ORDER BY sim DESC, item) <= 5),
cs AS (SELECT query, item, max(sim * p * 0.7::DOUBLE) AS score FROM ch WHERE (query, item) NOT IN (SELECT (query, item) FROM fu) GROUP BY 1, 2),
cr AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) <= 5),
al AS (SELECT query, item, score, source_type FROM fu UNION ALL SELECT query, item, score, 'cross' FROM cr)"""


def _found(single: bool = False, dag: bool = True, cross: bool = True) -> str:
    """Components up to fin(query, item, score, source_type, rank)."""
    parts = [_BASE, _SINGLE if single else _ALL, _ROUTE, _ADJUST if dag else _PLAIN, _INNER, _expansion() if cross else "al AS (SELECT * FROM fu)"]
    parts.append("fin AS MATERIALIZED (SELECT query, item, score, source_type, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item)::INT AS rank FROM al QUALIFY rank <= 5)")
    return ",\n".join(parts)


_ME = f"""sg AS (SELECT segment_id, max(sample_id) AS sample FROM segments GROUP BY 1),
me AS (SELECT item, content, source_dia_ids AS sources, sample FROM mc LEFT JOIN sg ON segment_id = source_segment_id), {hashed('me', 'item', 'content', 'mv')},
ret AS (SELECT query AS item_id, fin.item, sample_id, rank FROM fin JOIN eval_items ON item_id = query)"""


def _means(name: str, **flags) -> str:
    return f"{name} AS (WITH RECURSIVE {_found(**flags)}, {_ME}, {_SCORED} SELECT avg(p_at_k) AS p_at_k, avg(r_at_k) AS r_at_k FROM sc)"


_WANTED = f"""top7 AS (SELECT query AS item_id, topic FROM route QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, topic) <= 7),
sg AS (SELECT segment_id, max(sample_id) AS sample FROM segments GROUP BY 1),
me AS (SELECT item, content, source_dia_ids AS sources, sample FROM mc LEFT JOIN sg ON segment_id = source_segment_id),
evi AS (SELECT DISTINCT item_id, sample_id AS sample, dia FROM (SELECT item_id, sample_id, unnest(evidence) AS dia FROM eval_items) WHERE dia IS NOT NULL),
tk AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY sample_id, session_id, turn_idx ORDER BY ingested_at DESC) = 1),
tx AS (SELECT sample_id AS sample, dia_id AS dia, max(content) AS content FROM tk GROUP BY 1, 2), {hashed('tx', 'sample, dia', 'content', 'xh')}, {hashed('me', 'item', 'content', 'mv')},
em AS (SELECT item_id, me.item FROM evi JOIN me ON me.sample = evi.sample AND list_contains(sources, evi.dia) UNION
  SELECT item_id, item FROM (SELECT item_id, me.item, evi.dia, round(sum(x.x * m.x), 9) AS s FROM evi JOIN me ON me.sample = evi.sample JOIN xh x ON x.sample = evi.sample AND x.dia = evi.dia JOIN mv m ON m.item = me.item AND m.i = x.i GROUP BY ALL) WHERE s >= 0.6),
wide AS (SELECT item_id FROM em JOIN mm USING (item) GROUP BY 1 HAVING count(DISTINCT topic) >= 2),
ins AS (SELECT DISTINCT em.item_id, em.item FROM em JOIN mm USING (item) JOIN top7 ON top7.item_id = em.item_id AND top7.topic = mm.topic),
want AS MATERIALIZED (SELECT * FROM em WHERE item_id IN (SELECT item_id FROM wide) AND (item_id, item) NOT IN (SELECT (item_id, item) FROM ins))"""
_RULES_SQL = "(" + " || ".join(f"""CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in words)} THEN ['{label}'] ELSE [] END""" for label, words in RULES.items()) + ")"
_MADE = f"""{_TURNS}, {_SEGMENTS},
tx AS (SELECT sample_id, session_id, segment, string_agg(CASE WHEN lower(trim(role)) = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(content, ''), chr(10) ORDER BY pos) AS text,
       coalesce(string_agg(dia_id, ',' ORDER BY pos), '') AS dia_ids FROM seg JOIN m USING (sample_id, session_id) WHERE pos BETWEEN start_pos AND end_pos GROUP BY ALL),
made AS MATERIALIZED (SELECT sample_id, session_id, segment, dia_ids, substr(text, 1, 100) AS content, CASE WHEN len({_RULES_SQL}) = 0 THEN ['Unknown Topic'] ELSE {_RULES_SQL} END AS ls FROM tx WHERE trim(substr(text, 1, 100)) <> '')"""

SQL = {
    "store_route": f"WITH RECURSIVE {_BASE}, {_ALL}, {_ROUTE} SELECT query AS item_id, topic, round(score, 6) + 0.0 AS score FROM route",
    "store_adjust": f"WITH RECURSIVE {_BASE}, {_ALL}, {_ROUTE}, {_ADJUST} SELECT query AS item_id, topic, round(score, 6) + 0.0 AS score, rank FROM adj",
    "store_retrieve": f"WITH RECURSIVE {_found()} SELECT query AS item_id, item, round(score, 6) + 0.0 AS score, source_type, rank FROM fin",
    "retrieve_results": f"""WITH RECURSIVE {_found()}, nm AS (SELECT item, string_agg(label, ', ' ORDER BY k) AS labels FROM (SELECT item, unnest(range(len(topics))) AS k, unnest(topics) AS topic FROM
(SELECT item, list_filter(topic_ids, lambda x, i: x IS NOT NULL AND list_position(topic_ids, x) = i) AS topics FROM mc)) JOIN tc USING (topic) WHERE label IS NOT NULL GROUP BY 1)
SELECT query AS item_id, rank, fin.item, content, round(score, 2) + 0.0 AS score, coalesce(labels, '') AS labels FROM fin JOIN mc USING (item) LEFT JOIN nm USING (item)""",
    "ablation_pivot": f"""WITH {_means('a')}, {_means('b', single=True)}, {_means('c', dag=False)}, {_means('d', cross=False)}
SELECT 'p_at_k' AS measure, round(a.p_at_k, 6) AS "full", round(b.p_at_k, 6) AS no_multilabel, round(c.p_at_k, 6) AS no_dag, round(d.p_at_k, 6) AS no_cross FROM a, b, c, d
UNION ALL SELECT 'r_at_k', round(a.r_at_k, 6), round(b.r_at_k, 6), round(c.r_at_k, 6), round(d.r_at_k, 6) FROM a, b, c, d""",
    "cross_topic_memories": f"WITH RECURSIVE {_BASE}, {_ALL}, {_ROUTE}, {_MEMBERS}, {_WANTED} SELECT item_id, item FROM want",
    "ppr_contribution": f"""WITH w AS MATERIALIZED (WITH RECURSIVE {_BASE}, {_ALL}, {_ROUTE}, {_MEMBERS}, {_WANTED} SELECT item_id, item FROM want),
f AS MATERIALIZED (WITH RECURSIVE {_found()} SELECT query AS item_id, item FROM fin), o AS MATERIALIZED (WITH RECURSIVE {_found(cross=False)} SELECT query AS item_id, item FROM fin),
r AS (SELECT w.item_id, avg((f.item IS NOT NULL)::INT) AS a, avg((o.item IS NOT NULL)::INT) AS b FROM w LEFT JOIN f ON f.item_id = w.item_id AND f.item = w.item LEFT JOIN o ON o.item_id = w.item_id AND o.item = w.item GROUP BY 1)
SELECT round(avg(coalesce(a, 1)), 6) AS "full", round(avg(coalesce(b, 1)), 6) AS without, round(avg(coalesce(a, 1) - coalesce(b, 1)), 6) + 0.0 AS difference, count(*) AS n FROM eval_items LEFT JOIN r USING (item_id)""",
    "metric_items": """SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY item_id, category, length(question)) - 1)::INT AS pos, item_id, category, length(question)::INT AS n_chars
FROM eval_items QUALIFY category IS NULL OR category <> 5""",
    "engine_memories": f"WITH {_MADE} SELECT sample_id, dia_ids, content, array_to_string(ls, ',') AS labels FROM made WHERE len(ls) > 0",
    "engine_edges": f"""WITH {_MADE}, mo AS (SELECT row_number() OVER () AS id, sample_id, content, ls FROM made), hard AS (SELECT id, sample_id, unnest(ls) AS label FROM mo),
lt AS (SELECT DISTINCT sample_id, label FROM hard), ll AS (SELECT DISTINCT label FROM lt), {hashed('mo', 'id', 'content', 'mh')}, {hashed('ll', 'label', 'label', 'lh')},
soft AS (SELECT id, sample_id, label FROM hard UNION SELECT id, sample_id, label FROM (SELECT mo.id, mo.sample_id, lt.label, round(sum(mh.x * lh.x), 9) AS s FROM mo JOIN lt USING (sample_id) JOIN mh ON mh.id = mo.id
  JOIN lh ON lh.label = lt.label AND lh.i = mh.i GROUP BY ALL) WHERE s >= 0.5),
tot AS (SELECT sample_id, count(*)::DOUBLE AS n FROM mo GROUP BY 1), one AS (SELECT sample_id, label, count(*) AS c FROM hard GROUP BY 1, 2),
two AS (SELECT x.sample_id, x.label AS a, y.label AS b, count(*)::DOUBLE AS k FROM soft x JOIN soft y ON x.id = y.id AND x.label < y.label GROUP BY 1, 2, 3),
np AS (SELECT sample_id, a, b, k / p.c - k / r.c AS lean, CASE WHEN k <> n THEN ln(k * n / (p.c::DOUBLE * r.c)) / -ln(k / n) ELSE 0 END AS s FROM two JOIN tot USING (sample_id)
  JOIN one p ON p.sample_id = two.sample_id AND p.label = a JOIN one r ON r.sample_id = two.sample_id AND r.label = b),
ed AS (SELECT sample_id, a AS source, b AS target, s FROM np WHERE s > 0.1 AND lean >= -0.05 UNION ALL SELECT sample_id, b, a, s FROM np WHERE s > 0.1 AND lean <= 0.05),
w AS (SELECT *, greatest(0, least(1, 0.4::DOUBLE * s)) AS weight FROM ed),
ids AS (SELECT sample_id, label, sha256(lower(trim(sample_id || '/' || label))) AS id FROM lt)
SELECT w.sample_id, source, target, round(weight, 6) AS weight FROM w JOIN ids ON ids.sample_id = w.sample_id AND ids.label = target WHERE weight >= 0.08
QUALIFY row_number() OVER (PARTITION BY w.sample_id, source ORDER BY weight DESC, id) <= 5""",
}
