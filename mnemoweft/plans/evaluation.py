"""Queries on the evaluation of retrieval and answers, over eval_items and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft.functions import scores as S
from mnemoweft.functions.sets import evidence_recall as recall_by_id
from mnemoweft.models import HashEmbedder
from mnemoweft.operators import evaluate as E
from mnemoweft.operators.search import nearest_items
from mnemoweft.plans import bindings as B
from mnemoweft.plans.bindings import rounded
from mnemoweft.plans.segmentation import hashed
from mnemoweft.runtime import cut
from mnemoweft.sources.corpus import gold_answer
from mnemoweft.tables import current, table

K = 5


def _memories(spark: SparkSession, sf: str) -> DataFrame:
    m = current(spark, sf, "memories", ["memory_id", "content", "source_segment_id", "source_dia_ids"])
    seg = table(spark, sf, "segments").groupBy("segment_id").agg(F.max("sample_id").alias("sample"))
    rows = m.join(seg, m["source_segment_id"] == seg["segment_id"], "left")
    return cut(rows.select(F.col("memory_id").alias("item"), "content", F.col("source_dia_ids").alias("sources"), "sample", HashEmbedder(64).encode(F.col("content")).alias("vector")))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "eval_items")
    return q.select(F.col("item_id").alias("query"), F.col("sample_id").alias("sample"), "category", "evidence", gold_answer(F.col("category"), F.col("answer"), F.col("adversarial_answer")).alias("gold"), HashEmbedder(64).encode(F.col("question")).alias("qv"))


def _retrieved(spark: SparkSession, sf: str, memories: DataFrame, own: bool = True) -> DataFrame:
    q = _questions(spark, sf)
    if own:
        found = nearest_items(memories.select("item", "vector", F.array("sample").alias("topics")), q.select("query", "qv", F.array("sample").alias("topics")), K, filtered=True)
    else:
        found = nearest_items(memories.select("item", "vector"), q.select("query", "qv"), K)
    return found.join(q.select("query", "sample"), "query")


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select(F.col("item_id").alias("query"), F.explode("evidence").alias("dia")).filter("dia is not null")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    t = current(spark, sf, "turns", ["sample_id", "session_id", "turn_idx", "dia_id", "content"])
    t = t.groupBy("sample_id", "dia_id").agg(F.max("content").alias("content"))
    return t.select(F.col("sample_id").alias("sample"), F.col("dia_id").alias("dia"), HashEmbedder(64).encode(F.col("content")).alias("vector"))


def _scored(spark: SparkSession, sf: str, own: bool = True) -> DataFrame:
    m = _memories(spark, sf)
    found = E.matches(_retrieved(spark, sf, m, own), m, _evidence(spark, sf), _texts(spark, sf))
    return E.precision_recall(_questions(spark, sf).select("query", "sample", "category", "evidence"), found, K)


def evaluate_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(F.col("query").alias("item_id"), *rounded("p_at_k", "r_at_k"))


def evidence_recall(spark: SparkSession, sf: str) -> DataFrame:
    m = _memories(spark, sf)
    got = _retrieved(spark, sf, m).join(m.select("item", F.explode("sources").alias("d")), "item").groupBy("query").agg(F.collect_set("d").alias("got"))
    q = table(spark, sf, "eval_items").select(F.col("item_id").alias("query"), "evidence").join(got, "query", "left")
    return q.select(F.col("query").alias("item_id"), F.round(recall_by_id(F.col("evidence"), F.coalesce("got", F.array().cast("array<string>"))), 6).alias("recall"))


def per_category(spark: SparkSession, sf: str) -> DataFrame:
    return E.by_category(_scored(spark, sf), ["p_at_k", "r_at_k"])


def macro_average(spark: SparkSession, sf: str) -> DataFrame:
    return E.macro_mean(_scored(spark, sf), "sample", ["p_at_k", "r_at_k"]).select(*rounded("p_at_k", "r_at_k"), "n_groups")


def _reference(spark: SparkSession, sf: str) -> DataFrame:
    """query, topic: topics of the segments that hold evidence."""
    seg = table(spark, sf, "segments").select("sample_id", F.explode("dia_ids").alias("dia"), "topic_ids").select("sample_id", "dia", F.explode("topic_ids").alias("topic")).filter("topic is not null").distinct()
    q = table(spark, sf, "eval_items").select(F.col("item_id").alias("query"), "sample_id")
    return _evidence(spark, sf).join(q, "query").join(seg, ["sample_id", "dia"]).select("query", "topic").distinct()


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return B.memory_topics(spark, sf).withColumnRenamed("memory", "item")


def noise_count(spark: SparkSession, sf: str) -> DataFrame:
    m = _memories(spark, sf)
    return E.noise(_retrieved(spark, sf, m), _members(spark, sf), _reference(spark, sf)).withColumnRenamed("query", "item_id")


def _evidence_memories(spark: SparkSession, sf: str, m: DataFrame) -> DataFrame:
    own = m.select("item", "sample", F.explode("sources").alias("dia"))
    q = table(spark, sf, "eval_items").select(F.col("item_id").alias("query"), F.col("sample_id").alias("sample"))
    return _evidence(spark, sf).join(q, "query").join(own, ["sample", "dia"]).select("query", "item").distinct()


def cross_topic_recall(spark: SparkSession, sf: str) -> DataFrame:
    m = _memories(spark, sf)
    found = _retrieved(spark, sf, m)
    first = found.filter("rank = 1").join(_members(spark, sf), "item").select("query", "topic").distinct()
    wanted = E.cross_topic(_evidence_memories(spark, sf, m), _members(spark, sf), first)
    return E.recall_of(wanted, found, _questions(spark, sf)).select(F.col("query").alias("item_id"), *rounded("recall"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    m = _memories(spark, sf)
    top = _retrieved(spark, sf, m).filter("rank = 1").join(m.select("item", F.col("content").alias("prediction")), "item").select("query", "prediction")
    return _questions(spark, sf).select("query", "category", "gold").join(top, "query", "left").select(F.col("query").alias("item_id"), "category", F.coalesce("gold", F.lit("")).alias("gold"), F.coalesce("prediction", F.lit("")).alias("prediction"))


def token_f1(spark: SparkSession, sf: str) -> DataFrame:
    a, p, g = _answers(spark, sf), F.col("prediction"), F.col("gold")
    return a.select("item_id", F.round(S.bag_f1(p, g), 6).alias("bag_f1"), F.round(S.set_f1(p, g), 6).alias("set_f1"), S.exact_match(p, g).alias("exact"))


def answer_scores(spark: SparkSession, sf: str) -> DataFrame:
    a, p, g = _answers(spark, sf), F.col("prediction"), F.col("gold")
    named = [F.round(S.bleu(p, g, n), 6).alias(f"bleu_{n}") for n in (1, 2, 3, 4)] + [F.round(S.rouge_n(p, g, n), 6).alias(f"rouge_{n}") for n in (1, 2)]
    return a.select("item_id", F.round(S.category_score(F.col("category"), p, g), 6).alias("score"), *named)


def answer_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """The longest common subsequences of answers and golds."""
    a, p, g = _answers(spark, sf), F.col("prediction"), F.col("gold")
    return a.select("item_id", F.round(S.rouge_l(p, g), 6).alias("rouge_l"))


def score_report(spark: SparkSession, sf: str) -> DataFrame:
    a = _answers(spark, sf)
    rows = a.filter("category <> 5").select("category", S.bag_f1(F.col("prediction"), F.col("gold")).alias("f1"), S.set_f1(F.col("prediction"), F.col("gold")).alias("set_f1"))
    return E.by_category(rows, ["f1", "set_f1"])


def judge_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    a = _answers(spark, sf).filter("category <> 5")
    right = S.set_f1(F.col("prediction"), F.col("gold")) >= 0.05
    return a.groupBy("category").agg(F.round(E.judged(right), 6).alias("accuracy"), F.count_if(right).alias("n_right"), F.count("*").alias("n"))


def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("source"), "n_chars")
    return E.summary(d, "source", "n_chars").select("source", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "median", "min", "max", "n", "overall")


QUERIES = {
    f.__name__: f
    for f in (
        evaluate_retrieval, evidence_recall, per_category, macro_average, noise_count, cross_topic_recall, token_f1, answer_scores, answer_sequences,
        score_report, judge_accuracy, metric_summary,
    )
}

_RETRIEVED = f"""mc AS (SELECT * FROM memories QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at DESC, content DESC NULLS LAST) = 1),
sg AS (SELECT segment_id, max(sample_id) AS sample FROM segments GROUP BY 1),
me AS (SELECT memory_id AS item, content, source_dia_ids AS sources, sample FROM mc LEFT JOIN sg ON segment_id = source_segment_id),
{hashed('me', 'item', 'content', 'mv')}, {hashed('eval_items', 'item_id', 'question', 'qh')},
dt AS (SELECT item_id, item, round(sum(q.x * m.x), 9) AS s FROM qh q JOIN mv m ON q.i = m.i GROUP BY ALL),
cand AS (SELECT e.item_id, sample_id, category, me.item, coalesce(s, 0) AS s FROM eval_items e JOIN me ON {{own}} LEFT JOIN dt ON dt.item_id = e.item_id AND dt.item = me.item),
ret AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, item) AS rank FROM cand QUALIFY rank <= 5)"""
_OWN = _RETRIEVED.format(own="me.sample = e.sample_id")
_ALL = _RETRIEVED.format(own="true")
_SCORED = f"""ev AS (SELECT DISTINCT item_id, dia FROM (SELECT item_id, unnest(evidence) AS dia FROM eval_items) WHERE dia IS NOT NULL),
tk AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY sample_id, session_id, turn_idx ORDER BY ingested_at DESC) = 1),
tx AS (SELECT sample_id AS sample, dia_id AS dia, max(content) AS content FROM tk GROUP BY 1, 2),
{hashed('tx', 'sample, dia', 'content', 'th')},
pr AS (SELECT r.item_id, r.item, r.sample_id, e.dia, list_contains(sources, e.dia) AS direct FROM ret r JOIN ev e USING (item_id) JOIN me USING (item)),
sm AS (SELECT item_id, pr.item, pr.dia, round(sum(m.x * t.x), 9) AS s FROM pr JOIN mv m ON m.item = pr.item JOIN th t ON t.sample = pr.sample_id AND t.dia = pr.dia AND t.i = m.i GROUP BY ALL),
ht AS (SELECT pr.* FROM pr LEFT JOIN sm USING (item_id, item, dia) WHERE coalesce(direct, false) OR coalesce(s, 0) >= 0.6),
hs AS (SELECT item_id, count(DISTINCT item) AS i, count(DISTINCT dia) AS d FROM ht GROUP BY 1),
sc AS (SELECT e.item_id, e.sample_id, category, CASE WHEN coalesce(len(evidence), 0) = 0 THEN 0 ELSE coalesce(i, 0) / 5 END::DOUBLE AS p_at_k,
              CASE WHEN coalesce(len(evidence), 0) = 0 THEN 1 ELSE coalesce(d, 0) / len(evidence) END::DOUBLE AS r_at_k FROM eval_items e LEFT JOIN hs USING (item_id))"""
_MEMBERS = """mm AS (SELECT DISTINCT item, topic FROM (SELECT memory_id AS item, unnest(topic_ids) AS topic FROM memories
QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at DESC) = 1) WHERE topic IS NOT NULL)"""
_ANSWERS = """an AS (SELECT e.item_id, e.category, coalesce(CASE WHEN e.category = 5 THEN coalesce(adversarial_answer, 'no information available') ELSE coalesce(answer, '') END, '') AS gold,
       coalesce(content, '') AS pred FROM eval_items e LEFT JOIN (SELECT item_id, content FROM ret JOIN me USING (item) WHERE rank = 1) USING (item_id)),
tk2 AS (SELECT item_id, category, pred, gold,
  list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(pred), ',', '', 'g'), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the', 'and')) AS p,
  list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(gold), ',', '', 'g'), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the', 'and')) AS g,
  list_distinct(list_filter(regexp_split_to_array(translate(lower(pred), '.,!?', '    '), '\\s+'), lambda x: x <> '')) AS ps,
  list_distinct(list_filter(regexp_split_to_array(translate(lower(gold), '.,!?', '    '), '\\s+'), lambda x: x <> '')) AS gs FROM an),
f1s AS (SELECT item_id, category,
  CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 WHEN len(p) = 0 OR len(g) = 0 THEN 0 ELSE
    2 * coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda u: u = t)), len(list_filter(g, lambda u: u = t))))), 0) / (len(p) + len(g)) END::DOUBLE AS bag_f1,
  CASE WHEN trim(pred) = '' OR trim(gold) = '' OR len(list_intersect(ps, gs)) = 0 THEN 0 ELSE 2 * len(list_intersect(ps, gs)) / (len(ps) + len(gs)) END::DOUBLE AS set_f1,
  (lower(trim(pred)) = lower(trim(gold)))::INT AS exact FROM tk2)"""

def _met(a: str, b: str) -> str:
    """Common values of two lists, repeats counted as often as both have them."""
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least(len(list_filter({a}, lambda u: u = t)), len(list_filter({b}, lambda u: u = t))))), 0)"


def _bleu(order: int) -> str:
    weight = 0.33 if order == 3 else 1 / order
    logs = " + ".join(f"{weight}::DOUBLE * ln(CASE WHEN m{n} > 0 THEN m{n} ELSE 0.1 END / greatest(len(p{n}), 1))" for n in range(1, order + 1))
    return f"CASE WHEN trim(pred) = '' OR trim(gold) = '' OR m1 = 0 THEN 0 ELSE CASE WHEN len(p1) > len(g1) THEN 1 ELSE exp(1 - len(g1) / len(p1)::DOUBLE) END * exp({logs}) END"


_TOKENS = "list_filter(regexp_split_to_array(translate(lower({c}), '.,!?', '    '), '\\s+'), lambda x: x <> '')"
_BARE = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({c}), ',', '', 'g'), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the', 'and'))"
_GRAMS = "list_transform(range(1, len({v}) - {n} + 2), lambda i: array_to_string({v}[i : i + {n} - 1], ' '))"
_GRADED = f"""wd AS (SELECT item_id, category, pred, gold, {_TOKENS.format(c='pred')} AS p1, {_TOKENS.format(c='gold')} AS g1 FROM an),
gr AS (SELECT *, {', '.join(f"{_GRAMS.format(v=f'{c}1', n=n)} AS {c}{n}" for n in (2, 3, 4) for c in 'pg')} FROM wd),
ct AS (SELECT *, {', '.join(f"{_met(f'p{n}', f'g{n}')} AS m{n}" for n in (1, 2, 3, 4))} FROM gr),
pt AS (SELECT item_id, i, {_BARE.format(c='pp')} AS p, {_BARE.format(c='gp')} AS g FROM (
  SELECT item_id, i, unnest(CASE WHEN category = 1 THEN string_split(pred, ',') ELSE [pred] END) AS pp, gp FROM (
  SELECT item_id, category, pred, unnest(range(len(gs))) AS i, unnest(gs) AS gp FROM (SELECT *, CASE WHEN category = 1 THEN string_split(gold, ',') WHEN category = 3 THEN string_split(gold, ';')[1:1] ELSE [gold] END AS gs FROM an)))),
pf AS (SELECT item_id, i, max(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 WHEN len(p) = 0 OR len(g) = 0 THEN 0 ELSE 2 * {_met('p', 'g')} / (len(p) + len(g)) END::DOUBLE) AS f FROM pt GROUP BY 1, 2),
mf AS (SELECT item_id, avg(f) AS f FROM pf GROUP BY 1)"""

SQL = {
    "answer_scores": f"""WITH {_OWN}, {_ANSWERS}, {_GRADED} SELECT item_id, round(CASE WHEN category = 5 THEN (contains(lower(pred), 'no information available') OR contains(lower(pred), 'not mentioned'))::INT ELSE f END, 6)::DOUBLE AS score,
{', '.join(f"round({_bleu(n)}, 6)::DOUBLE AS bleu_{n}" for n in (1, 2, 3, 4))},
{', '.join(f"round(CASE WHEN m{n} > 0 THEN 2 * m{n} / (len(p{n}) + len(g{n}))::DOUBLE ELSE 0 END, 6)::DOUBLE AS rouge_{n}" for n in (1, 2))} FROM ct JOIN mf USING (item_id)""",
    "evaluate_retrieval": f"WITH {_OWN}, {_SCORED} SELECT item_id, round(p_at_k, 6) AS p_at_k, round(r_at_k, 6) AS r_at_k FROM sc",
    "evidence_recall": f"""WITH {_OWN}, g AS (SELECT item_id, list_distinct(flatten(list(sources))) AS got FROM ret JOIN me USING (item) GROUP BY 1)
SELECT e.item_id, round(CASE WHEN coalesce(len(evidence), 0) = 0 THEN 1 ELSE len(list_filter(evidence, lambda x: list_contains(coalesce(got, []), x))) / len(evidence) END, 6)::DOUBLE AS recall
FROM eval_items e LEFT JOIN g USING (item_id)""",
    "per_category": f"""WITH {_OWN}, {_SCORED} SELECT category, round(avg(p_at_k), 4) AS p_at_k, round(avg(r_at_k), 4) AS r_at_k, count(*) AS n, 0 AS overall FROM sc GROUP BY 1
UNION ALL SELECT NULL, round(avg(round(p_at_k, 4)), 4), round(avg(round(r_at_k, 4)), 4), count(*), 1 FROM sc""",
    "macro_average": f"""WITH {_OWN}, {_SCORED}, g AS (SELECT sample_id, avg(p_at_k) AS p, avg(r_at_k) AS r FROM sc GROUP BY 1)
SELECT round(avg(p), 6) AS p_at_k, round(avg(r), 6) AS r_at_k, count(*) AS n_groups FROM g""",
    "noise_count": f"""WITH {_OWN}, {_MEMBERS}, ev AS (SELECT DISTINCT item_id, sample_id, dia FROM (SELECT item_id, sample_id, unnest(evidence) AS dia FROM eval_items)),
rf AS (SELECT DISTINCT item_id, topic FROM ev JOIN (SELECT sample_id, dia, unnest(topic_ids) AS topic FROM (SELECT sample_id, unnest(dia_ids) AS dia, topic_ids FROM segments)) USING (sample_id, dia) WHERE topic IS NOT NULL),
ok AS (SELECT DISTINCT ret.item_id, ret.item FROM ret JOIN mm USING (item) JOIN rf ON rf.item_id = ret.item_id AND rf.topic = mm.topic)
SELECT ret.item_id, (count(*) FILTER (ok.item IS NULL))::BIGINT AS n_noise FROM ret LEFT JOIN ok ON ok.item_id = ret.item_id AND ok.item = ret.item GROUP BY 1""",
    "cross_topic_recall": f"""WITH {_OWN}, {_MEMBERS}, ev AS (SELECT DISTINCT item_id, sample_id, dia FROM (SELECT item_id, sample_id, unnest(evidence) AS dia FROM eval_items)),
em AS (SELECT DISTINCT item_id, item FROM ev JOIN (SELECT item, sample, unnest(sources) AS dia FROM me) x ON x.sample = sample_id AND x.dia = ev.dia),
wide AS (SELECT item_id FROM em JOIN mm USING (item) GROUP BY 1 HAVING count(DISTINCT topic) >= 2),
seed AS (SELECT DISTINCT item_id, topic FROM ret JOIN mm USING (item) WHERE rank = 1),
ins AS (SELECT DISTINCT em.item_id, em.item FROM em JOIN mm USING (item) JOIN seed ON seed.item_id = em.item_id AND seed.topic = mm.topic),
want AS (SELECT * FROM em WHERE item_id IN (SELECT item_id FROM wide) AND (item_id, item) NOT IN (SELECT (item_id, item) FROM ins)),
rc AS (SELECT want.item_id, avg((ret.item IS NOT NULL)::INT) AS r FROM want LEFT JOIN ret ON ret.item_id = want.item_id AND ret.item = want.item GROUP BY 1)
SELECT e.item_id, round(coalesce(r, 1), 6)::DOUBLE AS recall FROM eval_items e LEFT JOIN rc USING (item_id)""",
    "token_f1": f"WITH {_OWN}, {_ANSWERS} SELECT item_id, round(bag_f1, 6) AS bag_f1, round(set_f1, 6) AS set_f1, exact FROM f1s",
    "score_report": f"""WITH {_OWN}, {_ANSWERS}, x AS (SELECT * FROM f1s WHERE category <> 5) SELECT category, round(avg(bag_f1), 4) AS f1, round(avg(set_f1), 4) AS set_f1, count(*) AS n, 0 AS overall FROM x GROUP BY 1
UNION ALL SELECT NULL, round(avg(round(bag_f1, 4)), 4), round(avg(round(set_f1, 4)), 4), count(*), 1 FROM x""",
    "judge_accuracy": f"""WITH {_OWN}, {_ANSWERS} SELECT category, round(avg((set_f1 >= 0.05)::INT), 6) AS accuracy, (count(*) FILTER (set_f1 >= 0.05))::BIGINT AS n_right, count(*) AS n FROM f1s WHERE category <> 5 GROUP BY 1""",
    "metric_summary": """WITH d AS (SELECT coalesce(lower(trim(source)), 'none') AS source, n_chars::DOUBLE AS v FROM documents)
SELECT source, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std, median(v) AS median, min(v) AS min, max(v) AS max, count(v) AS n, grouping(source)::INT AS overall
FROM d GROUP BY ROLLUP (source)""",
}
