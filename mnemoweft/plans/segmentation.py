"""Queries on turns, segments and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft.functions.text import TRANSITIONS, dialogue_text, history_line, memory_line
from mnemoweft.models import HashEmbedder
from mnemoweft.operators import segment as S
from mnemoweft.operators.search import nearest_items
from mnemoweft.runtime import cut
from mnemoweft.tables import current, table

SESSION = ["sample_id", "session_id"]


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    t = current(spark, sf, "turns", [*SESSION, "turn_idx", "dia_id", "role", "content", "ingested_at"]).drop("ingested_at")
    return t.withColumn("vector", HashEmbedder(64).encode(F.col("content")))


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    return S.boundaries(_turns(spark, sf), SESSION, "turn_idx")


def boundary_detect(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select(*SESSION, "turn_idx", "similarity", "boundary")


def segment(spark: SparkSession, sf: str) -> DataFrame:
    return S.segments(_marked(spark, sf), SESSION)


def segment_text(spark: SparkSession, sf: str) -> DataFrame:
    whole = cut(_marked(spark, sf).select(*SESSION, "pos", "role", "content", "dia_id", "boundary"))
    marked = whole.drop("boundary")
    runs = S.segments(whole, SESSION).withColumn("pos", F.explode(F.sequence("start_pos", "end_pos")))
    rows = runs.select(*SESSION, "segment", "pos").join(marked, [*SESSION, "pos"]).groupBy(*SESSION, "segment").agg(F.array_sort(F.collect_list(F.struct("pos", F.lower(F.trim("role")).alias("role"), "content", "dia_id"))).alias("t"))
    ids = F.array_join(F.filter(F.col("t")["dia_id"], lambda x: x.isNotNull()), ",")
    return rows.select(*SESSION, "segment", ids.alias("dia_ids"), dialogue_text(F.col("t")).alias("text"))


def fixed_window(spark: SparkSession, sf: str) -> DataFrame:
    return S.fixed_windows(current(spark, sf, "turns", [*SESSION, "turn_idx"]), SESSION, "turn_idx")


def message_batches(spark: SparkSession, sf: str) -> DataFrame:
    return S.fixed_windows(current(spark, sf, "turns", [*SESSION, "turn_idx"]), SESSION, "turn_idx", 2)


def rag_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return S.chunks(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 100)


def rag_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = HashEmbedder(64)
    parts = rag_chunk(spark, sf).select(F.struct("doc_id", "chunk").alias("item"), e.encode(F.col("text")).alias("vector"))
    asked = table(spark, sf, "eval_items").select(F.col("item_id").alias("query"), e.encode(F.col("question")).alias("qv"))
    return nearest_items(parts, asked, 2).select(F.col("query").alias("item_id"), "item.doc_id", "item.chunk", F.round("score", 6).alias("score"), "rank")


def rag_context(spark: SparkSession, sf: str) -> DataFrame:
    top = rag_topk(spark, sf)
    text = rag_chunk(spark, sf).withColumnRenamed("text", "part")
    rows = top.join(text, ["doc_id", "chunk"]).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("l"))
    return rows.select("item_id", F.array_join(F.col("l")["part"], "\n<->\n").alias("context"))


def chat_history(spark: SparkSession, sf: str) -> DataFrame:
    t = current(spark, sf, "turns", [*SESSION, "turn_idx", "role", "content", "ts"])
    return t.select(*SESSION, "turn_idx", history_line(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("role"), F.col("content")).alias("line"))


def memory_lines(spark: SparkSession, sf: str) -> DataFrame:
    m = current(spark, sf, "memories", ["memory_id", "content", "created_at"])
    return m.select("memory_id", memory_line(F.date_format("created_at", "yyyy-MM-dd"), F.coalesce("content", F.lit(""))).alias("line"))


QUERIES = {f.__name__: f for f in (boundary_detect, segment, segment_text, fixed_window, message_batches, rag_chunk, rag_topk, rag_context, chat_history, memory_lines)}


def hashed(source: str, key: str, text: str, name: str) -> str:
    """Components of hash vectors in SQL: name(key, i, x)."""
    return f"""{name}_t AS (SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')) AS t FROM {source}),
{name}_h AS (SELECT {key}, ('0x' || substr(md5(t), 1, 4))::INT AS h FROM {name}_t),
{name}_r AS (SELECT {key}, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM {name}_h GROUP BY ALL),
{name}_n AS (SELECT {key}, sqrt(sum(x * x)) AS n FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {key}, i, x / n AS x FROM {name}_r JOIN {name}_n USING ({key}) WHERE n > 0)"""


_PHRASES = "|".join(TRANSITIONS).lower()
_TURNS = f"""tcur AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY sample_id, session_id, turn_idx
      ORDER BY ingested_at DESC, content DESC NULLS LAST, role DESC NULLS LAST) = 1),
tp AS (SELECT *, row_number() OVER (PARTITION BY sample_id, session_id ORDER BY turn_idx) - 1 AS pos FROM tcur),
{hashed('tp', 'sample_id, session_id, pos', 'content', 'e')},
d AS (SELECT b.sample_id, b.session_id, b.pos, sum(a.x * b.x) AS d FROM e a JOIN e b
      ON a.sample_id = b.sample_id AND a.session_id = b.session_id AND b.pos = a.pos + 1 AND a.i = b.i GROUP BY ALL),
s AS (SELECT tp.*, CASE WHEN tp.pos > 0 THEN round(coalesce(d, 0), 9) END AS sim FROM tp LEFT JOIN d USING (sample_id, session_id, pos)),
m AS (SELECT *, coalesce(sim < 0.35 OR (sim < 0.5 AND regexp_matches(coalesce(content, ''), '(?i)\\b({_PHRASES})\\b')), false) AS boundary FROM s)"""
_SEGMENTS = """l AS (SELECT sample_id, session_id, count(*) AS n, coalesce(list(pos ORDER BY pos) FILTER (boundary), []) AS b FROM m GROUP BY ALL),
fold AS (SELECT sample_id, session_id, n, list_reduce(list_concat([[0]::BIGINT[]], list_transform(b, lambda x: [x]::BIGINT[])),
         lambda a, x: CASE WHEN x[1] - a[-1] >= 3 THEN list_append(a, x[1]) ELSE a END) AS k FROM l),
kept AS (SELECT sample_id, session_id, n, CASE WHEN len(k) > 1 AND n - k[-1] < 3 THEN k[:-2] ELSE k END AS k FROM fold),
seg AS (SELECT sample_id, session_id, unnest(range(len(k)))::INT AS segment, unnest(k)::INT AS start_pos,
               unnest(list_transform(list_append(k[2:], n), lambda x: x - 1))::INT AS end_pos FROM kept)"""
_WINDOWS = """WITH k AS (SELECT DISTINCT sample_id, session_id, turn_idx FROM turns),
p AS (SELECT sample_id, session_id, row_number() OVER (PARTITION BY sample_id, session_id ORDER BY turn_idx) - 1 AS pos FROM k)
SELECT sample_id, session_id, (pos // {n})::INT AS segment, min(pos)::INT AS start_pos, max(pos)::INT AS end_pos FROM p GROUP BY 1, 2, 3"""
_CHUNKS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
ch AS (SELECT doc_id, c::INT AS chunk, array_to_string(ws[c * 100 + 1 : c * 100 + 100], ' ') AS text
       FROM (SELECT doc_id, ws, unnest(range((len(ws) + 99) // 100)) AS c FROM w WHERE len(ws) > 0))"""
_TOP = f"""{hashed('ch', 'doc_id, chunk', 'text', 'ce')}, {hashed('eval_items', 'item_id', 'question', 'qe')},
sc AS (SELECT item_id, doc_id, chunk, round(sum(q.x * c.x), 9) AS s FROM qe q JOIN ce c ON q.i = c.i GROUP BY ALL),
al AS (SELECT item_id, doc_id, chunk, coalesce(s, 0) AS s FROM (SELECT item_id, doc_id, chunk FROM eval_items CROSS JOIN ch) LEFT JOIN sc USING (item_id, doc_id, chunk)),
top AS (SELECT item_id, doc_id, chunk, round(s, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id, chunk)::INT AS rank FROM al QUALIFY rank <= 2)"""

SQL = {
    "boundary_detect": f"WITH {_TURNS} SELECT sample_id, session_id, turn_idx, sim AS similarity, boundary FROM m",
    "segment": f"WITH {_TURNS}, {_SEGMENTS} SELECT * FROM seg",
    "segment_text": f"""WITH {_TURNS}, {_SEGMENTS} SELECT sample_id, session_id, segment,
coalesce(string_agg(dia_id, ',' ORDER BY pos), '') AS dia_ids,
string_agg(CASE WHEN lower(trim(role)) = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(content, ''), chr(10) ORDER BY pos) AS text
FROM seg JOIN m USING (sample_id, session_id) WHERE pos BETWEEN start_pos AND end_pos GROUP BY ALL""",
    "fixed_window": _WINDOWS.format(n=5),
    "message_batches": _WINDOWS.format(n=2),
    "rag_chunk": f"WITH {_CHUNKS} SELECT * FROM ch",
    "rag_topk": f"WITH {_CHUNKS}, {_TOP} SELECT * FROM top",
    "rag_context": f"""WITH {_CHUNKS}, {_TOP} SELECT item_id, string_agg(text, chr(10) || '<->' || chr(10) ORDER BY rank) AS context
FROM top JOIN ch USING (doc_id, chunk) GROUP BY 1""",
    "chat_history": """SELECT sample_id, session_id, turn_idx, coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), '') || ' | ' || coalesce(role, '') || ': ' || coalesce(content, '') || chr(10) AS line
FROM (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY sample_id, session_id, turn_idx
      ORDER BY ingested_at DESC, role DESC NULLS LAST, content DESC NULLS LAST) = 1)""",
    "memory_lines": """SELECT memory_id, CASE WHEN created_at IS NOT NULL THEN strftime(created_at, '%Y-%m-%d') || ': ' ELSE '' END || coalesce(content, '') AS line
FROM (SELECT * FROM memories QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at DESC, content DESC NULLS LAST) = 1)""",
}
