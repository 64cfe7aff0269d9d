"""The pN_ queries of the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft.llm.cooccurrence import cooccurrence
from mnemoweft.llm.fusion import fuse_ranks
from mnemoweft.llm.knn import nearest
from mnemoweft.llm.leakage import leaks
from mnemoweft.llm.mixing import mix_sources
from mnemoweft.llm.repetition import fertility, repetition, repetitive
from mnemoweft.llm.setjoin import similar_sets
from mnemoweft.tables import current, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
VOCABULARIES = [f"{TOKENIZERS}/{name}" for name in ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model")]
SCORES = ["npmi_mem", "llm_score", "npmi_temp", "weight"]


def _memory_topics(spark: SparkSession, sf: str) -> DataFrame:
    return current(spark, sf, "memories", ["memory_id", "topic_ids"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cooccurrence(_memory_topics(spark, sf), "memory_id", "topic_ids", min_count=8)
    return pairs.filter(F.col("npmi") >= 0.55).select(F.col("item_a").alias("topic_id_a"), F.col("item_b").alias("topic_id_b"))


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cooccurrence(_memory_topics(spark, sf), "memory_id", "topic_ids")
    rounded = [F.round(c, 6).alias(c) for c in ("pmi", "npmi", "lift", "odds_ratio", "log_odds")]
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", *rounded)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    topics = current(spark, sf, "topics", ["topic_id", "keywords"])
    pairs = similar_sets(topics, "topic_id", "keywords", threshold=0.6, min_size=4).expanded()
    return pairs.select(F.col("id_a").alias("topic_id_a"), F.col("id_b").alias("topic_id_b"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    names = ["memory", "topic_label", "topic_summary"]
    topics, memories = table(spark, sf, "topics"), table(spark, sf, "memories")
    pick = lambda df, id, version, vector: df.select(F.col(id).alias("id"), F.col(version).alias("version"), F.col(vector).alias("vector"))
    found = nearest(
        [
            pick(memories, "memory_id", "ingested_at", "embedding"),
            pick(topics, "topic_id", "updated_at", "label_embedding"),
            pick(topics, "topic_id", "updated_at", "summary_embedding"),
        ],
        dim=384,
        k=5,
        min_cosine=0.9,
    )
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("collection") + 1)
    return found.select(name.alias("collection"), F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return current(spark, sf, "assoc_edges", ["source_id", "target_id", *SCORES])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    fused = fuse_ranks(_edges(spark, sf), "source_id", SCORES)
    best = F.min(F.struct(-F.col("fused"), F.col("target_id").alias("target_id")))
    tops = fused.groupBy("source_id").agg(F.count("*").alias("n"), best.alias("best"))
    return tops.filter("n >= 6").select("source_id", "best.target_id")


def p5_ranking(spark: SparkSession, sf: str) -> DataFrame:
    ranks = [f"rank_{s}" for s in SCORES]
    return fuse_ranks(_edges(spark, sf), "source_id", SCORES).select("source_id", "target_id", *ranks, F.round("fused", 9).alias("fused"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), VOCABULARY)
    return mixed.report.filter(~F.col("met")).select("source")


def p7_selection(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), VOCABULARY)
    return mixed.selection.withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), VOCABULARY).report


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return repetitive(table(spark, sf, "documents"), VOCABULARY, share=0.3, least=20).select("doc_id")


def p8_repetition(spark: SparkSession, sf: str) -> DataFrame:
    return repetition(table(spark, sf, "documents")).withColumn("repeated_share", F.round("repeated_share", 6))


def p8_fertility(spark: SparkSession, sf: str) -> DataFrame:
    return fertility(table(spark, sf, "documents"), VOCABULARIES)


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_pairs, p3_found, p4_found, p5_found, p5_ranking, p6_found,
        p7_found, p7_selection, p7_report, p8_found, p8_repetition, p8_fertility,
    )
}

_MEMORY_TOPICS = """
cur AS (SELECT memory_id, topic_ids FROM memories
        QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at DESC, topic_ids DESC NULLS LAST) = 1),
mt AS (SELECT DISTINCT memory_id, t FROM (SELECT memory_id, unnest(topic_ids) AS t FROM cur) WHERE t IS NOT NULL),
tot AS (SELECT count(DISTINCT memory_id)::DOUBLE AS n FROM cur),
one AS (SELECT t, count(*) AS c FROM mt GROUP BY t),
two AS (SELECT a.t AS item_a, b.t AS item_b, count(*) AS n_ab FROM mt a JOIN mt b ON a.memory_id = b.memory_id AND a.t < b.t GROUP BY 1, 2),
pairs AS (SELECT item_a, item_b, n_ab, x.c AS n_a, y.c AS n_b, n FROM two JOIN one x ON x.t = item_a JOIN one y ON y.t = item_b CROSS JOIN tot)
"""

_EDGES = """
cur AS (SELECT source_id, target_id, npmi_mem, llm_score, npmi_temp, weight FROM assoc_edges
        QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY last_updated DESC, npmi_mem DESC NULLS LAST,
                                   llm_score DESC NULLS LAST, npmi_temp DESC NULLS LAST, weight DESC NULLS LAST) = 1),
k AS (SELECT source_id, target_id, CASE WHEN NOT isnan(npmi_mem) THEN npmi_mem END AS a, CASE WHEN NOT isnan(llm_score) THEN llm_score END AS b,
             CASE WHEN NOT isnan(npmi_temp) THEN npmi_temp END AS c, CASE WHEN NOT isnan(weight) THEN weight END AS d FROM cur),
r AS (SELECT source_id, target_id,
        rank() OVER (PARTITION BY source_id ORDER BY a DESC NULLS LAST) AS rank_npmi_mem,
        rank() OVER (PARTITION BY source_id ORDER BY b DESC NULLS LAST) AS rank_llm_score,
        rank() OVER (PARTITION BY source_id ORDER BY c DESC NULLS LAST) AS rank_npmi_temp,
        rank() OVER (PARTITION BY source_id ORDER BY d DESC NULLS LAST) AS rank_weight FROM k),
f AS (SELECT *, 1.0::DOUBLE / (rank_npmi_mem + 60) + 1.0::DOUBLE / (rank_llm_score + 60) + 1.0::DOUBLE / (rank_npmi_temp + 60)
             + 1.0::DOUBLE / (rank_weight + 60) AS fused FROM r)
"""

_REPEATED = r"""
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS k, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id, array_to_string(ws[k:k+4], ' ') ORDER BY k) AS nth FROM g),
x AS (SELECT DISTINCT doc_id, unnest(range(k, k + 5)) AS at FROM h WHERE nth > 1),
c AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
r AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated FROM w LEFT JOIN c ON c.doc_id = w.doc_id)
"""



def _letters(c: str) -> str:
    """Text in SQL without JSON escapes, tags, entities, case and accents."""
    bare = rf"regexp_replace(regexp_replace(regexp_replace({c}, '\\[nrtbf]', ' ', 'g'), '<[^<>]*>', '', 'g'), '&[a-zA-Z]+;', ' ', 'g')"
    return f"strip_accents(replace(lower({bare}), 'ß', 'ss'))"


SQL = {
    "p7_found": r"""WITH d AS (SELECT lower(trim(source)) AS source, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS n FROM documents WHERE text IS NOT NULL),
t AS (SELECT lower(trim(source)) AS source, target_share, max_repeats FROM mix_targets),
o AS (SELECT t.source, target_share, max_repeats, coalesce(sum(n), 0) AS own FROM t LEFT JOIN d ON d.source = t.source GROUP BY 1, 2, 3)
SELECT source FROM o WHERE max_repeats * own < target_share * (SELECT sum(own) FROM o)""",
    "p2_found": f"""WITH {_MEMORY_TOPICS}
SELECT item_a AS topic_id_a, item_b AS topic_id_b FROM pairs
WHERE n_ab >= 8 AND ln((n_ab / n) / ((n_a / n) * (n_b / n))) / -ln(n_ab / n) >= 0.55""",
    "p2_pairs": f"""WITH {_MEMORY_TOPICS}
SELECT item_a, item_b, n_ab, n_a, n_b, n::BIGINT AS n, round(ln(n_ab * n / (n_a * n_b)), 6) AS pmi,
       round(CASE WHEN -ln(n_ab / n) > 0 THEN ln(n_ab * n / (n_a * n_b)) / -ln(n_ab / n) ELSE 0 END, 6) AS npmi,
       round(n_ab * n / (n_a * n_b), 6) AS lift,
       round(((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5)) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)), 6) AS odds_ratio,
       round(ln(((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5)) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))), 6) AS log_odds
FROM pairs""",
    "p3_found": """WITH cur AS (SELECT topic_id, keywords FROM topics
        QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC, keywords DESC NULLS LAST) = 1),
k AS (SELECT DISTINCT topic_id, w FROM (SELECT topic_id, lower(trim(unnest(keywords))) AS w FROM cur) WHERE w <> ''),
s AS (SELECT topic_id, count(*) AS c FROM k GROUP BY topic_id HAVING count(*) >= 4),
o AS (SELECT a.topic_id AS x, b.topic_id AS y, count(*) AS n FROM k a JOIN k b ON a.w = b.w AND a.topic_id < b.topic_id GROUP BY 1, 2)
SELECT x AS topic_id_a, y AS topic_id_b FROM o JOIN s p ON p.topic_id = x JOIN s q ON q.topic_id = y WHERE n >= 0.6 * (p.c + q.c - n)""",
    "p5_found": f"""WITH {_EDGES}
SELECT source_id, target_id FROM f
QUALIFY count(*) OVER (PARTITION BY source_id) >= 6 AND row_number() OVER (PARTITION BY source_id ORDER BY fused DESC, target_id) = 1""",
    "p5_ranking": f"""WITH {_EDGES}
SELECT source_id, target_id, rank_npmi_mem, rank_llm_score, rank_npmi_temp, rank_weight, round(fused, 9) AS fused FROM f""",
    "p4_found": """WITH m AS (SELECT memory_id AS id, embedding AS v FROM memories
        QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at DESC) = 1),
t AS (SELECT topic_id AS id, label_embedding AS l, summary_embedding AS s FROM topics
        QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY updated_at DESC) = 1),
v AS (SELECT c, id, v::DOUBLE[] AS v FROM (SELECT 'memory' AS c, id, v FROM m UNION ALL SELECT 'topic_label', id, l FROM t UNION ALL
      SELECT 'topic_summary', id, s FROM t) WHERE len(v) = 384 AND list_max(list_transform(v, lambda x: abs(x))) > 0),
p AS (SELECT a.c, a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS cos FROM v a JOIN v b ON a.c = b.c AND a.id < b.id),
d AS (SELECT c, x, y, cos FROM p WHERE cos >= 0.9 UNION ALL SELECT c, y, x, cos FROM p WHERE cos >= 0.9),
r AS (SELECT c, x, y FROM d QUALIFY row_number() OVER (PARTITION BY c, x ORDER BY cos DESC, y) <= 5)
SELECT DISTINCT c AS collection, least(x, y) AS id_a, greatest(x, y) AS id_b FROM r""",
    "p8_repetition": f"""WITH {_REPEATED}
SELECT doc_id, n_words, n_repeated, round(CASE WHEN n_words > 0 THEN n_repeated / n_words ELSE 0 END, 6) AS repeated_share FROM r""",
    "p8_found": f"""WITH {_REPEATED}
SELECT doc_id FROM r WHERE n_words >= 20 AND n_repeated >= 0.3 * n_words""",
    "p6_found": f"""WITH f AS (SELECT item_id, unnest([question, context]) AS t FROM eval_items),
w AS (SELECT item_id, regexp_extract_all({_letters('t')}, '[a-z0-9]+') AS ws FROM f WHERE t IS NOT NULL),
n AS (SELECT DISTINCT item_id, array_to_string(ws[k:k+11], '') AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM w WHERE len(ws) >= 12)),
d AS (SELECT doc_id, regexp_replace({_letters('text')}, '[^a-z0-9]+', '', 'g') AS s FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, item_id FROM d JOIN n ON contains(d.s, n.s)""",
}
