"""Comparisons of the engine with parts of it left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweft.engine import Engine
from mnemoweft.operators import evaluate as E
from mnemoweft.runtime import cut

VARIANTS = ("full", "no_boundary", "no_multilabel", "no_dag", "no_cross")
FLAGS = {"no_dag": {"use_dag": False}, "no_cross": {"use_cross": False}}


def scored(found: DataFrame, memories: DataFrame, questions: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """query, sample, category, p_at_k, r_at_k of what was found for each question.

    found(query, item), memories(item, sources, vector), questions(query, sample, category, evidence),
    texts(sample, dia, vector).
    """
    evidence = questions.select("query", F.explode("evidence").alias("dia")).filter("dia is not null")
    hits = E.matches(found.select("query", "item").join(questions.select("query", "sample"), "query"), memories, evidence, texts)
    return E.precision_recall(questions.select("query", "sample", "category", "evidence"), hits, k).drop("evidence")


def ablations(engine: Engine, turns: DataFrame, questions: DataFrame, k: int = 5, window: int = 5, variants: tuple[str, ...] = VARIANTS, **flags) -> DataFrame:
    """variant, query, sample, category, p_at_k, r_at_k of the whole pipeline over the turns and with a part left out.

    no_boundary cuts every `window` turns, no_multilabel keeps one topic per memory, no_dag leaves out the
    hierarchy, no_cross the expansion by PageRank.  questions(query, text, sample_id, category, evidence).
    The given engine's tables stay as they are.
    """
    ways = {"no_boundary": {"window": window}, "no_multilabel": {"multilabel": False}}
    built: dict[str, Engine] = {}
    rows = turns.filter("dia_id is not null").groupBy(F.col("sample_id").alias("sample"), F.col("dia_id").alias("dia")).agg(F.max("content").alias("content"))
    texts = cut(rows.select("sample", "dia", engine.embedder.encode(F.col("content")).alias("vector")))
    asked = questions.withColumnRenamed("sample_id", "sample")
    out = None
    for name in variants:
        kind = name if name in ways else "full"
        if kind not in built:
            e = built[kind] = engine.copy()
            e.clear()
            e.ingest(turns, **ways.get(kind, {}))
            e.build_index()
        e = built[kind]
        found = e.retrieve(questions, k, **FLAGS.get(name, {}), **flags)
        memories = e.tables["memories"].select("item", F.col("source_dia_ids").alias("sources"), "vector")
        part = cut(scored(found, memories, asked, texts, k).select(F.lit(name).alias("variant"), "*"))
        out = part if out is None else out.unionByName(part)
    return out


def contribution(run: Callable[[bool], DataFrame], wanted: DataFrame, questions: DataFrame) -> DataFrame:
    """query, full, without, difference: recall of the wanted(query, item) with and without the expansion by PageRank.

    run(use_cross) gives what was found (query, item).  Without anything wanted all are 1, 1 and 0.
    """
    both = [E.recall_of(wanted, run(use), questions).withColumnRenamed("recall", name) for use, name in ((True, "full"), (False, "without"))]
    return both[0].join(both[1], "query").withColumn("difference", F.col("full") - F.col("without"))
