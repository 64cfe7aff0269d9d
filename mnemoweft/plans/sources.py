"""Queries on the shape of the input, on stores and on assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft.functions.text import namespace
from mnemoweft.models import HashEmbedder
from mnemoweft.operators import assign as A
from mnemoweft.operators import maintain as M
from mnemoweft.plans.dag import _topic_links, _topics
from mnemoweft.plans.segmentation import hashed
from mnemoweft.runtime import cut
from mnemoweft.sources import corpus as C
from mnemoweft.sources.store import exposed_ids
from mnemoweft.tables import current, table

TURN = ["sample_id", "session_id", "turn_idx"]


def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "turns").groupBy("sample_id").agg(F.count_distinct("session_id").alias("n_sessions"), F.count_distinct("session_id", "turn_idx").alias("n_turns"))
    q = table(spark, sf, "eval_items").groupBy("sample_id").pivot("category", [1, 2, 3, 4, 5]).count()
    named = q.select("sample_id", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"qa_{c}") for c in range(1, 6)])
    per = t.join(named, "sample_id", "left").na.fill(0)
    sums = [F.sum(c).alias(c) for c in per.columns if c != "sample_id"]
    return per.rollup("sample_id").agg(*sums)


def qa_filter(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "eval_items").filter(C.within_sessions(F.col("evidence"), 6))
    return q.select("item_id", "category", C.gold_answer(F.col("category"), F.col("answer"), F.col("adversarial_answer")).alias("answer"))


def session_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of the sessions before the first missing number of each sample, with captions."""
    t = current(spark, sf, "turns", [*TURN, "dia_id", "content", "blip_caption"])
    n = t.select("*", F.regexp_extract("session_id", r"session_(\d+)$", 1).cast("int").alias("n"))
    kept = C.until_gap(n.select("sample_id", "n").distinct(), ["sample_id"], "n")
    return n.join(kept, ["sample_id", "n"], "left_semi").select(*TURN, "dia_id", C.with_caption(F.col("content"), F.col("blip_caption")).alias("content"))


def dia_lookup(spark: SparkSession, sf: str) -> DataFrame:
    t = current(spark, sf, "turns", [*TURN, "dia_id", "content", "blip_caption"])
    return t.filter("dia_id is not null").groupBy("sample_id", "dia_id").agg(F.max(C.with_caption(F.col("content"), F.col("blip_caption"))).alias("text"))


def perspective_remap(spark: SparkSession, sf: str) -> DataFrame:
    t = current(spark, sf, "turns", [*TURN, "role", "content"]).withColumn("speaker", F.lower(F.trim("role"))).filter("speaker <> ''")
    names = t.groupBy("sample_id").agg(F.min("speaker").alias("a"), F.max("speaker").alias("b"))
    speakers = names.select("sample_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("perspective"))
    return C.seen_by(t, speakers).select(*TURN, "perspective", "role", "content")


def system_stats(spark: SparkSession, sf: str) -> DataFrame:
    topics = current(spark, sf, "topics", ["topic_id", "is_virtual"]).agg(F.count("*").alias("topics"), F.count_if("is_virtual").alias("virtual_topics"))
    parts = [
        topics.selectExpr("stack(2, 'topics', topics, 'virtual_topics', virtual_topics) as (what, n)"),
        current(spark, sf, "memories", ["memory_id"]).agg(F.count("*").alias("n")).select(F.lit("memories").alias("what"), "n"),
        current(spark, sf, "assoc_edges", ["source_id", "target_id"]).agg(F.count("*").alias("n")).select(F.lit("assoc_edges").alias("what"), "n"),
        _topic_links(spark, sf).agg(F.count("*").alias("n")).select(F.lit("dag_edges").alias("what"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def namespaced_ids(spark: SparkSession, sf: str) -> DataFrame:
    t = current(spark, sf, "topics", ["topic_id", "label"])
    return t.select("topic_id", F.concat_ws(":", namespace(F.coalesce("label", F.lit("default"))), F.lit("topic"), "topic_id").alias("node_id"))


def visible_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids as users see them: virtual topics have no raw one here."""
    t = current(spark, sf, "topics", ["topic_id", "is_virtual"])
    return exposed_ids(t.select("topic_id", F.concat_ws(":", F.lit("default"), "topic_id").alias("node_id"), F.when(~F.col("is_virtual"), F.col("topic_id")).alias("raw_id")))


def upsert_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Old states of the topics with the newest put in by key."""
    t = table(spark, sf, "topics").select("topic_id", "updated_at", "label")
    first = t.groupBy("topic_id").agg(F.min(F.struct("updated_at", "label")).alias("r")).select("topic_id", "r.*")
    last = t.groupBy("topic_id").agg(F.max(F.struct("updated_at", "label")).alias("r")).select("topic_id", "r.*")
    changed = last.join(first, ["topic_id", "updated_at"], "left_anti").select("topic_id", "updated_at", "label")
    return M.upsert(first, changed, ["topic_id"]).select("topic_id", "label")


def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    gone = current(spark, sf, "topics", ["topic_id", "is_virtual"]).filter("is_virtual")
    edges = current(spark, sf, "assoc_edges", ["source_id", "target_id"])
    return M.delete(edges, gone, ["source_id", "target_id"], "topic_id")


def topic_points(spark: SparkSession, sf: str) -> DataFrame:
    p = M.topic_points(_topics(spark, sf))
    return p.select("topic", F.round(F.get("label_vector", F.lit(0)), 6).alias("label_0"), F.round(F.get("summary_vector", F.lit(0)), 6).alias("summary_0"))


def memory_sources(spark: SparkSession, sf: str) -> DataFrame:
    m = current(spark, sf, "memories", ["memory_id", "source_segment_id"])
    return A.with_sources(m, table(spark, sf, "segments")).select("memory_id", F.array_join("source_dia_ids", ",").alias("dia_ids"))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "segments").select(F.explode("raw_labels").alias("l")).select("l.label", F.coalesce("l.keywords", F.array().cast("array<string>")).alias("keywords"))
    named = rows.filter(F.coalesce(F.trim("label"), F.lit("")) != "").groupBy("label").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords")))).alias("keywords"))
    none = F.lit(None).cast("array<double>")
    return named.select(F.col("label").alias("topic"), "label", HashEmbedder(64).encode(F.col("label")).alias("label_vector"), none.alias("summary_vector"), "keywords")


def topic_match(spark: SparkSession, sf: str) -> DataFrame:
    t = current(spark, sf, "topics", ["topic_id", "label", "keywords", "created_at"])
    none = F.lit(None).cast("array<double>")
    topics = t.select(F.col("topic_id").alias("topic"), "label", HashEmbedder(64).encode(F.col("label")).alias("label_vector"), none.alias("summary_vector"), F.array_distinct(F.coalesce("keywords", F.array().cast("array<string>"))).alias("keywords"), F.col("created_at").alias("seq"))
    return A.match_labels(cut(_labels(spark, sf)), cut(topics)).select("name", "topic", F.round("similarity", 6).alias("similarity"), "exact")


def assign_topics(spark: SparkSession, sf: str) -> DataFrame:
    return A.group_labels(cut(_labels(spark, sf)))


def resolve_topics(spark: SparkSession, sf: str) -> DataFrame:
    """The labels of each segment among its topics, both in their order."""
    e = HashEmbedder(64)
    seg = table(spark, sf, "segments").groupBy("segment_id").agg(F.max("topic_ids").alias("topic_ids"), F.max("raw_labels").alias("raw_labels"))
    names = seg.select(F.col("segment_id").alias("owner"), F.posexplode("raw_labels").alias("pos", "l")).select("owner", "pos", F.col("l.label").alias("name")).filter("name is not null")
    labels = current(spark, sf, "topics", ["topic_id", "label"]).filter("label is not null")
    topics = seg.select(F.col("segment_id").alias("owner"), F.posexplode("topic_ids").alias("pos", "topic_id")).join(labels, "topic_id").select("owner", "pos", F.col("topic_id").alias("topic"), "label")
    found = A.resolve(names.withColumn("vector", e.encode(F.col("name"))), topics.withColumn("vector", e.encode(F.col("label"))))
    return found.select(F.col("owner").alias("segment_id"), F.array_join("topics", ",").alias("topics"))


def memory_build(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter(F.lower(F.trim("source")) == "model_output").select("doc_id", "text")
    return A.memories_of(d, "doc_id", "text").select("doc_id", "pos", "content", F.array_join("topics", ",").alias("topics"), F.array_join("keywords", ",").alias("keywords"), "importance")


QUERIES = {
    f.__name__: f
    for f in (
        dataset_stats, qa_filter, session_flatten, dia_lookup, perspective_remap, system_stats, namespaced_ids, visible_ids, upsert_topics, delete_cascade, topic_points,
        memory_sources, topic_match, assign_topics, resolve_topics, memory_build,
    )
}

_CAP = "coalesce(content, '') || CASE WHEN coalesce(blip_caption, '') <> '' THEN ' [shares image: ' || blip_caption || ']' ELSE '' END"
_TCUR = """tcur AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY sample_id, session_id, turn_idx
ORDER BY ingested_at DESC, dia_id DESC NULLS LAST, role DESC NULLS LAST, content DESC NULLS LAST, blip_caption DESC NULLS LAST) = 1)"""
_LABELS = """raw AS (SELECT l.label AS label, l.keywords AS keywords FROM (SELECT unnest(raw_labels) AS l FROM segments)),
lb AS (SELECT label, list_distinct(flatten(list(coalesce(keywords, [])))) AS kw FROM raw WHERE coalesce(trim(label), '') <> '' GROUP BY 1),
tcu AS (SELECT topic_id, label, list_distinct(coalesce(keywords, [])) || CASE WHEN len(list_filter(keywords, lambda x: x IS NULL)) > 0 THEN [NULL] ELSE [] END AS kw, created_at FROM topics QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC, keywords DESC NULLS LAST) = 1)"""

SQL = {
    "dataset_stats": """WITH t AS (SELECT sample_id, count(DISTINCT session_id) AS n_sessions, count(DISTINCT (session_id, turn_idx)) AS n_turns FROM turns GROUP BY 1),
q AS (SELECT sample_id, count(*) FILTER (category = 1) AS a, count(*) FILTER (category = 2) AS b, count(*) FILTER (category = 3) AS c, count(*) FILTER (category = 4) AS d, count(*) FILTER (category = 5) AS e FROM eval_items GROUP BY 1),
p AS (SELECT t.*, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d, coalesce(e, 0) AS e FROM t LEFT JOIN q USING (sample_id))
SELECT sample_id, sum(n_sessions)::BIGINT AS n_sessions, sum(n_turns)::BIGINT AS n_turns, sum(a)::BIGINT AS qa_1, sum(b)::BIGINT AS qa_2, sum(c)::BIGINT AS qa_3, sum(d)::BIGINT AS qa_4, sum(e)::BIGINT AS qa_5 FROM p GROUP BY ROLLUP (sample_id)""",
    "qa_filter": """SELECT item_id, category, CASE WHEN category = 5 THEN coalesce(adversarial_answer, 'no information available') ELSE coalesce(answer, '') END AS answer
FROM eval_items WHERE len(list_filter(coalesce(evidence, []), lambda e: coalesce(try_cast(regexp_extract(e, '^D([0-9]+):', 1) AS INT) > 6, false))) = 0""",
    "session_flatten": f"""WITH {_TCUR}, s AS (SELECT DISTINCT sample_id, regexp_extract(session_id, 'session_([0-9]+)$', 1)::INT AS n FROM tcur),
k AS (SELECT sample_id, n FROM s QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY n) = n)
SELECT tcur.sample_id, session_id, turn_idx, dia_id, {_CAP} AS content FROM tcur JOIN k ON k.sample_id = tcur.sample_id AND session_id = 'session_' || n""",
    "dia_lookup": f"WITH {_TCUR} SELECT sample_id, dia_id, max({_CAP}) AS text FROM tcur WHERE dia_id IS NOT NULL GROUP BY 1, 2",
    "perspective_remap": f"""WITH {_TCUR}, t AS (SELECT *, lower(trim(role)) AS speaker FROM tcur WHERE trim(role) <> ''),
s AS (SELECT sample_id, unnest([min(speaker), max(speaker)]) AS perspective FROM t GROUP BY 1), d AS (SELECT DISTINCT * FROM s)
SELECT sample_id, session_id, turn_idx, perspective, CASE WHEN speaker = perspective THEN 'user' ELSE 'assistant' END AS role, speaker || ': ' || coalesce(content, '') AS content FROM t JOIN d USING (sample_id)""",
    "system_stats": """WITH t AS (SELECT topic_id, is_virtual, parent_ids, child_ids FROM topics QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC) = 1),
l AS (SELECT DISTINCT p, c FROM (SELECT unnest(parent_ids) AS p, topic_id AS c FROM t UNION ALL SELECT topic_id, unnest(child_ids) FROM t) WHERE p IS NOT NULL AND c IS NOT NULL)
SELECT 'topics' AS what, count(*) AS n FROM t UNION ALL SELECT 'virtual_topics', count(*) FILTER (is_virtual) FROM t UNION ALL SELECT 'memories', count(DISTINCT memory_id) FROM memories
UNION ALL SELECT 'assoc_edges', count(DISTINCT (source_id, target_id)) FROM assoc_edges UNION ALL SELECT 'dag_edges', count(*) FROM l""",
    "namespaced_ids": """SELECT topic_id, regexp_replace(substr(regexp_replace(coalesce(label, 'default'), '[^A-Za-z0-9_-]', '_', 'g'), 1, 48), '^_+|_+$', '', 'g') || ':topic:' || topic_id AS node_id
FROM (SELECT * FROM topics QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC, label DESC NULLS LAST) = 1)""",
    "visible_ids": """SELECT topic_id, CASE WHEN NOT is_virtual THEN topic_id ELSE 'default:' || topic_id END AS id
FROM (SELECT * FROM topics QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC, is_virtual DESC NULLS LAST) = 1)""",
    "upsert_topics": "SELECT topic_id, label FROM (SELECT * FROM topics QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC, label DESC NULLS LAST) = 1)",
    "delete_cascade": """WITH g AS (SELECT topic_id FROM (SELECT * FROM topics QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC) = 1) WHERE is_virtual)
SELECT DISTINCT source_id, target_id FROM assoc_edges WHERE source_id NOT IN (SELECT topic_id FROM g) AND target_id NOT IN (SELECT topic_id FROM g)""",
    "topic_points": """WITH t AS (SELECT topic_id, label_embedding::DOUBLE[] AS l, summary_embedding::DOUBLE[] AS s FROM topics QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC) = 1),
u AS (SELECT topic_id, CASE WHEN len(l) = 384 AND list_dot_product(l, l) > 0 THEN l[1] / sqrt(list_dot_product(l, l)) END AS a,
      CASE WHEN len(s) = 384 AND list_dot_product(s, s) > 0 THEN s[1] / sqrt(list_dot_product(s, s)) END AS b FROM t)
SELECT topic_id AS topic, round(coalesce(a, b), 6) AS label_0, round(coalesce(b, a), 6) AS summary_0 FROM u WHERE coalesce(a, b) IS NOT NULL""",
    "memory_sources": """WITH m AS (SELECT memory_id, source_segment_id FROM memories QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at DESC, source_segment_id DESC NULLS LAST) = 1),
s AS (SELECT segment_id, max(dia_ids) AS d FROM segments GROUP BY 1) SELECT memory_id, array_to_string(d, ',') AS dia_ids FROM m LEFT JOIN s ON segment_id = source_segment_id""",
    "topic_match": f"""WITH {_LABELS}, {hashed('lb', 'label', 'label', 'lh')}, {hashed('tcu', 'topic_id', 'label', 'th')},
ex AS (SELECT lb.label AS name, topic_id AS topic FROM lb JOIN tcu ON lower(trim(lb.label)) = lower(trim(tcu.label)) QUALIFY row_number() OVER (PARTITION BY lb.label ORDER BY created_at, topic_id) = 1),
dt AS (SELECT l.label AS name, t.topic_id, round(sum(l.x * t.x), 9) AS c FROM lh l JOIN th t ON l.i = t.i WHERE l.label NOT IN (SELECT name FROM ex) GROUP BY 1, 2),
pr AS (SELECT name, dt.topic_id, created_at, c, lb.kw AS ka, tcu.kw AS kb,
       list_distinct(list_filter(regexp_split_to_array(lower(lb.label), '\\s+'), lambda x: x <> '')) AS wa, list_distinct(list_filter(regexp_split_to_array(lower(tcu.label), '\\s+'), lambda x: x <> '')) AS wb
       FROM dt JOIN lb ON lb.label = name JOIN tcu ON tcu.topic_id = dt.topic_id),
ss AS (SELECT name, topic_id, created_at, round(0.6::DOUBLE * c + CASE WHEN len(ka) + len(kb) > 0 THEN 0.2::DOUBLE * (len(list_intersect(ka, kb)) / (len(ka) + len(kb) - len(list_intersect(ka, kb)))::DOUBLE) ELSE 0 END
       + CASE WHEN least(len(wa), len(wb)) > 0 THEN 0.2::DOUBLE * (len(list_intersect(wa, wb)) / least(len(wa), len(wb))::DOUBLE) ELSE 0 END, 9) AS s FROM pr)
SELECT name, topic, 1.0::DOUBLE AS similarity, true AS exact FROM ex UNION ALL
SELECT name, topic_id, round(s, 6), false FROM (SELECT * FROM ss WHERE s >= 0.65 QUALIFY row_number() OVER (PARTITION BY name ORDER BY s DESC, created_at, topic_id) = 1)""",
    "assign_topics": f"""WITH RECURSIVE {_LABELS}, hd AS (SELECT min(label) AS label FROM lb GROUP BY lower(trim(label))), {hashed('hd', 'label', 'label', 'lh')},
w AS (SELECT hd.label, kw, list_distinct(list_filter(regexp_split_to_array(lower(hd.label), '\\s+'), lambda x: x <> '')) AS ws FROM hd JOIN lb USING (label)),
dt AS (SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 9) AS c FROM lh a JOIN lh b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
ed AS (SELECT a, b FROM dt JOIN w x ON x.label = a JOIN w y ON y.label = b WHERE round(0.6::DOUBLE * c
  + CASE WHEN len(x.kw) + len(y.kw) > 0 THEN 0.2::DOUBLE * (len(list_intersect(x.kw, y.kw)) / (len(x.kw) + len(y.kw) - len(list_intersect(x.kw, y.kw)))::DOUBLE) ELSE 0 END
  + CASE WHEN least(len(x.ws), len(y.ws)) > 0 THEN 0.2::DOUBLE * (len(list_intersect(x.ws, y.ws)) / least(len(x.ws), len(y.ws))::DOUBLE) ELSE 0 END, 9) >= 0.65),
rc AS (SELECT label AS a, label AS b FROM hd UNION SELECT rc.a, ed.b FROM rc JOIN ed ON rc.b = ed.a),
ld AS (SELECT a, min(b) AS leader FROM rc GROUP BY 1)
SELECT lb.label AS name, leader FROM lb JOIN (SELECT label, min(label) OVER (PARTITION BY lower(trim(label))) AS h FROM lb) f ON f.label = lb.label JOIN ld ON ld.a = f.h""",
    "resolve_topics": f"""WITH sg AS (SELECT segment_id, max(topic_ids) AS ts, max(raw_labels) AS ls FROM segments GROUP BY 1),
nm AS (SELECT segment_id, unnest(range(len(ls))) AS pos, unnest(list_transform(ls, lambda l: l.label)) AS name FROM sg),
tl AS (SELECT topic_id, label FROM topics QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC, label DESC NULLS LAST) = 1),
ow AS (SELECT segment_id, nth, o.topic_id, label FROM (SELECT segment_id, unnest(range(len(ts))) AS nth, unnest(ts) AS topic_id FROM sg) o JOIN tl ON tl.topic_id = o.topic_id WHERE label IS NOT NULL),
ns AS (SELECT DISTINCT name FROM nm WHERE name IS NOT NULL), ts AS (SELECT DISTINCT label FROM ow), {hashed('ns', 'name', 'name', 'nh')}, {hashed('ts', 'label', 'label', 'th')},
pr AS (SELECT DISTINCT name, label FROM nm JOIN ow USING (segment_id) WHERE name IS NOT NULL),
dt AS (SELECT pr.name, pr.label, round(sum(n.x * t.x), 9) AS c FROM pr JOIN nh n ON n.name = pr.name JOIN th t ON t.label = pr.label AND t.i = n.i GROUP BY 1, 2),
sc AS (SELECT segment_id, pos, nth, topic_id, CASE WHEN lower(trim(nm.name)) = lower(trim(ow.label)) THEN 2 ELSE coalesce(c, 0) END AS s
       FROM nm JOIN ow USING (segment_id) LEFT JOIN dt ON dt.name = nm.name AND dt.label = ow.label WHERE nm.name IS NOT NULL),
bs AS (SELECT segment_id, pos, topic_id FROM sc WHERE s >= 0.65 QUALIFY row_number() OVER (PARTITION BY segment_id, pos ORDER BY s DESC, nth, topic_id) = 1),
pk AS (SELECT segment_id, string_agg(topic_id, ',' ORDER BY k) AS p FROM (SELECT segment_id, topic_id, min(pos) AS k FROM bs GROUP BY 1, 2) GROUP BY 1),
ev AS (SELECT segment_id, string_agg(topic_id, ',' ORDER BY k) AS t FROM (SELECT segment_id, topic_id, min(nth) AS k FROM ow GROUP BY 1, 2) GROUP BY 1)
SELECT ev.segment_id, coalesce(p, t) AS topics FROM ev LEFT JOIN pk USING (segment_id)""",
    "memory_build": r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '<think>.*?</think>', '', 'gs')) AS bare FROM documents WHERE lower(trim(source)) = 'model_output'),
b AS (SELECT doc_id, CASE WHEN fenced <> '' THEN fenced ELSE bare END AS body FROM (SELECT doc_id, bare, trim(regexp_extract(bare, '(?s)```(?:json)?\s*(.*?)```', 1)) AS fenced FROM d)),
x AS (SELECT doc_id, body, [regexp_extract(body, '(?s)\[\s*\{.*\}\s*\]', 0), regexp_extract(body, '(?s)\{.*\}', 0), '[' || regexp_extract(body, '(?s)\{.*\}', 0) || ']', regexp_extract(body, '(?s)\[.*\]', 0)] AS parts FROM b),
j AS (SELECT doc_id, CASE WHEN json_valid(body) AND regexp_matches(body, '^\s*[\[{]') THEN body ELSE list_filter(parts, lambda p: p <> '' AND json_valid(p))[1] END AS js FROM x),
l AS (SELECT doc_id, json_extract(CASE WHEN regexp_matches(js, '^\s*\{') THEN '[' || js || ']' ELSE js END, '$[*]') AS l FROM j WHERE js IS NOT NULL),
e AS (SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS o FROM l)
SELECT doc_id, pos, json_extract_string(o, '$.content') AS content, array_to_string(json_extract_string(o, '$.topics[*]'), ',') AS topics, array_to_string(json_extract_string(o, '$.keywords[*]'), ',') AS keywords,
       coalesce(try_cast(json_extract_string(o, '$.importance') AS DOUBLE), 0.5) AS importance FROM e WHERE json_type(o) = 'OBJECT' AND coalesce(trim(json_extract_string(o, '$.content')), '') <> ''""",
}
