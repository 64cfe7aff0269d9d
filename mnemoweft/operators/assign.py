"""Labels to topics, segments to topics, replies to memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoweft.config import DEFAULTS
from mnemoweft.functions.loose_json import json_text, number_or
from mnemoweft.functions.vector import dot
from mnemoweft.operators.components import connected_components
from mnemoweft.operators.dag import similar_topics
from mnemoweft.runtime import cut


def match_labels(labels: DataFrame, topics: DataFrame, least: float = DEFAULTS.label_match, keyed: bool = False) -> DataFrame:
    """name, topic, similarity, exact of each label that has a topic (with keyed: of the same key).

    labels and topics have label, label_vector, summary_vector and keywords; labels are named by `topic`
    (their own id), topics have seq, the order they were made in.  The same label but for case and blanks
    wins, the earliest topic first; only the others are compared, and the most similar topic counts from
    `least` on, again the earliest of equals.
    """
    key = ["key"] if keyed else []
    name = F.lower(F.trim("label")).alias("__l")
    first = topics.select(*key, name, "seq", "topic").groupBy(*key, "__l").agg(F.min(F.struct("seq", "topic"))["topic"].alias("found")).filter("__l is not null")
    exact = labels.select(*key, name, F.col("topic").alias("name")).join(first, [*key, "__l"]).select("name", F.col("found").alias("topic"), F.lit(1.0).alias("similarity"), F.lit(True).alias("exact"))
    rest = labels.join(exact.select(F.col("name").alias("topic")), "topic", "left_anti")
    near = similar_topics(rest, topics, least, keyed=keyed).join(topics.select(F.col("topic").alias("b"), "seq"), "b")
    best = near.groupBy(F.col("a").alias("name")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "seq", F.col("b").alias("topic"))).alias("m"))
    return exact.unionByName(best.select("name", "m.topic", (-F.col("m.s")).alias("similarity"), F.lit(False).alias("exact")))


def group_labels(labels: DataFrame, least: float = DEFAULTS.label_match, keyed: bool = False) -> DataFrame:
    """name, leader: new labels (with keyed: of one key) that hang together by similarity become one topic, named by the first.

    This stands for creating topics label by label, where each new topic is seen by the next label: it does
    not depend on the order and joins the chains that the order would cut.
    """
    by = [*(["key"] if keyed else []), "k"]
    named = labels.withColumn("k", F.lower(F.trim("label")))
    same = named.groupBy(*by).agg(F.min("topic").alias("first"))
    own = cut(named.select("topic", *by).join(same, by).select(F.col("topic").alias("name"), "first"))
    heads = labels.join(own.select(F.col("first").alias("topic")).distinct(), "topic", "left_semi")
    pairs = similar_topics(heads, heads, least, keyed=keyed).filter("a < b").select("a", "b")
    comp = connected_components(pairs, "a", "b")
    lead = comp.join(comp.groupBy("component").agg(F.min("node").alias("leader")), "component").select(F.col("node").alias("first"), "leader")
    return own.join(lead, "first", "left").select("name", F.coalesce("leader", "first").alias("leader"))


def ordered_distinct(rows: DataFrame, owner: list[str], place: str, value: str, name: str) -> DataFrame:
    """owner, name: the different values of each owner as a list, in the order of their first place."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(*owner, value).agg(F.min(place).alias("__at"))
    return first.groupBy(*owner).agg(F.array_sort(F.collect_list(F.struct("__at", value)))[value].alias(name))


def resolve(names: DataFrame, topics: DataFrame, least: float = DEFAULTS.label_match) -> DataFrame:
    """owner, topics: the names of each owner among its own topics, in the order of the names.

    names(owner, pos, name, vector), topics(owner, pos, topic, label, vector).  A name takes the topic of the
    same label, else the most similar from `least` on, the earliest of equals; an owner none of whose
    names takes one has all its topics, in their order.
    """
    pairs = names.select("owner", F.col("pos").alias("at"), "name", "vector").join(topics.select("owner", "pos", "topic", "label", F.col("vector").alias("tv")), "owner")
    same = F.lower(F.trim("name")) == F.lower(F.trim("label"))
    score = F.when(same, F.lit(2.0)).otherwise(F.round(F.coalesce(dot(F.col("vector"), F.col("tv")), F.lit(0.0)), 9))
    near = pairs.select("owner", "at", "pos", "topic", score.alias("s")).filter(F.col("s") >= least)
    best = near.groupBy("owner", "at").agg(F.min(F.struct(-F.col("s"), F.col("pos"), F.col("topic").alias("topic")))["topic"].alias("topic"))
    picked = ordered_distinct(best, ["owner"], "at", "topic", "p")
    every = ordered_distinct(topics, ["owner"], "pos", "topic", "t")
    return every.join(picked, "owner", "left").select("owner", F.coalesce("p", "t").alias("topics"))


MEMORY = "struct<content string, topics array<string>, keywords array<string>, importance string>"


def memories_of(replies: DataFrame, id: str, reply: str) -> DataFrame:
    """id, pos, content, topics, keywords, importance of the memories in a model's replies.

    The reply may be fenced, framed by remarks or a single object; elements that are no objects and
    those without content are dropped, an importance that is no number is 0.5.
    """
    json = json_text(F.col(reply))
    listed = F.from_json(F.when(json.rlike(r"^\s*\{"), F.concat(F.lit("["), json, F.lit("]"))).otherwise(json), "array<string>")
    rows = replies.select(id, F.posexplode(listed).alias("pos", "one")).filter(F.col("one").rlike(r"^\s*\{"))
    m = rows.select(id, "pos", F.from_json("one", MEMORY).alias("m"))
    none = F.array().cast("array<string>")
    return m.filter(F.coalesce(F.trim("m.content"), F.lit("")) != "").select(
        id, "pos", "m.content", F.coalesce("m.topics", none).alias("topics"), F.coalesce("m.keywords", none).alias("keywords"), number_or(F.col("m.importance")).alias("importance")
    )


def with_sources(memories: DataFrame, segments: DataFrame) -> DataFrame:
    """memories with the dia_ids of their segment (each segment once)."""
    once = segments.groupBy("segment_id").agg(F.max("dia_ids").alias("source_dia_ids"))
    return memories.drop("source_dia_ids").join(once, memories["source_segment_id"] == once["segment_id"], "left").drop("segment_id")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
