"""The engine: turns in, answers out, all state as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoweft.config import DEFAULTS, Settings
from mnemoweft.functions.loose_json import json_text, labels_of
from mnemoweft.functions.text import dialogue_text
from mnemoweft.functions.vector import dot
from mnemoweft.models import NO_ANSWER, Embedder, FallbackModel, HashEmbedder, TextModel
from mnemoweft.operators import assoc, dag
from mnemoweft.operators.assign import group_labels, match_labels, memories_of, ordered_distinct, resolve
from mnemoweft.operators.hierarchy import Hierarchy
from mnemoweft.operators.maintain import upsert
from mnemoweft.operators.retrieve import Store, formatted, retrieve
from mnemoweft.operators.segment import boundaries, fixed_windows, segments
from mnemoweft.runtime import cut

SESSION = ["sample_id", "session_id"]


@dataclass
class Engine:
    """ingest() turns, build_index(), then retrieve().

    Frames are immutable, so copy() costs nothing and serves ablations.  Ids are hashes of natural keys.
    With by_sample every sample is a store of its own (the scope of all rows): its topics, hierarchy,
    counts, edges and results hold nothing of others.  All samples go through the same jobs.

    tables: segments(segment_id, scope, ..., topic_ids), topics(topic, scope, label, label_vector,
    summary_vector, keywords, is_virtual, depth, seq, memory_count_since_summary), memories(item, scope, ...),
    links(parent, child), edges(source, target, ...).
    """

    spark: SparkSession
    embedder: Embedder = field(default_factory=HashEmbedder)
    model: TextModel = field(default_factory=FallbackModel)
    settings: Settings = DEFAULTS
    by_sample: bool = True
    tables: dict[str, DataFrame] = field(default_factory=dict)
    batches: int = 0
    since_build: int = 0

    def copy(self, **changes) -> Engine:
        return replace(self, tables=dict(self.tables), **changes)

    def clear(self) -> None:
        self.tables.clear()
        self.batches = self.since_build = 0

    def _scope(self) -> Column:
        return F.col("sample_id") if self.by_sample else F.lit("")

    # --- ingest

    def ingest(self, turns: DataFrame, window: int | None = None, multilabel: bool = True, online: bool = False) -> None:
        """turns(sample_id, session_id, turn_idx, dia_id, role, content[, ts]) to segments, topics and memories.

        What came before stays: labels take the topics they match, and only others make new ones; rows of
        the same id (a segment is named by its first turn) are replaced.  window cuts every so many turns
        instead of by content; without multilabel each memory keeps its most similar topic only.  online
        fires the triggers: summaries of topics that grew by summary_interval memories, and the index once
        rebuild_interval memories came since it was built.
        """
        self.batches += 1
        segs = self._segments(turns, window)
        owned = self._topics(segs)
        ids = ordered_distinct(owned, ["segment_id"], "pos", "topic", "topic_ids")
        segs = cut(segs.join(ids, "segment_id", "left"))
        memories = self._memories(segs, owned)
        if not multilabel:
            memories = self._single(memories)
        old = self.tables.get("memories")
        memories = cut(memories)
        new = memories if old is None else memories.join(old.select("item"), "item", "left_anti")
        grown = new.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("__n"))
        topics = self.tables["topics"].join(grown, "topic", "left").withColumn("memory_count_since_summary", F.col("memory_count_since_summary") + F.coalesce("__n", F.lit(0))).drop("__n")
        self.since_build += new.count()
        for name, rows, key in (("segments", segs, "segment_id"), ("memories", memories, "item")):
            before = self.tables.get(name)
            self.tables[name] = rows if before is None else cut(upsert(before, rows.select(*before.columns), [key]))
        self.tables["topics"] = cut(topics)
        if online:
            self.tables["topics"] = self._summarised(self.tables["topics"])
            if self.since_build >= self.settings.rebuild_interval:
                self.build_index()

    def _segments(self, turns: DataFrame, window: int | None) -> DataFrame:
        ts = F.col("ts") if "ts" in turns.columns else F.lit(None).cast("timestamp_ntz")
        placed = turns.select(*SESSION, "turn_idx", "dia_id", "role", "content", ts.alias("ts"), self.embedder.encode(F.col("content")).alias("vector"))
        marked = cut(boundaries(placed, SESSION, "turn_idx", self.settings).drop("vector"))
        runs = fixed_windows(marked, SESSION, "turn_idx", window) if window else segments(marked, SESSION, self.settings.min_segment_turns)
        each = runs.withColumn("pos", F.explode(F.sequence("start_pos", "end_pos")))
        held = each.select(*SESSION, "segment", "pos").join(marked.select(*SESSION, "pos", "turn_idx", "role", "content", "dia_id", "ts"), [*SESSION, "pos"])
        rows = held.groupBy(*SESSION, "segment").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content", "dia_id"))).alias("t"), F.min("turn_idx").alias("first"), F.min("ts").alias("created_at"))
        segment_id = F.sha2(F.concat_ws("/", *SESSION, "first"), 256)
        dias = F.filter(F.col("t")["dia_id"], lambda d: d.isNotNull())
        text = rows.select(segment_id.alias("segment_id"), self._scope().alias("scope"), *SESSION, dias.alias("dia_ids"), dialogue_text(F.col("t")).alias("text"), "created_at")
        return cut(text.withColumn("raw_labels", labels_of(json_text(self.model.labels(F.col("text"))))))

    def _topics(self, segs: DataFrame) -> DataFrame:
        """segment_id, scope, pos, label, topic; the table of topics has the new ones and all keywords."""
        none = F.array().cast("array<string>")
        flat = cut(segs.select("segment_id", "scope", F.posexplode("raw_labels").alias("pos", "l")).select("segment_id", "scope", "pos", "l.label", F.coalesce("l.keywords", none).alias("keywords")).filter("label is not null"))
        own = F.concat_ws("/", F.col("key"), F.col("label"))
        united = F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords")))).alias("keywords")
        names = flat.groupBy(F.col("scope").alias("key"), "label").agg(united)
        labels = cut(names.select("key", own.alias("topic"), "label", self.embedder.encode(F.col("label")).alias("label_vector"), F.lit(None).cast("array<double>").alias("summary_vector"), "keywords"))
        old = self.tables.get("topics")
        if old is None:
            known = self.spark.createDataFrame([], "name string, topic string")
        else:
            known = cut(match_labels(labels, old.filter("not is_virtual").withColumn("key", F.col("scope")), self.settings.label_match, keyed=True).select("name", "topic"))
        fresh = labels.join(known.select(F.col("name").alias("topic")), "topic", "left_anti")
        leaders = cut(group_labels(fresh, self.settings.label_match, keyed=True))
        made = leaders.select("name", F.sha2(F.lower(F.trim("leader")), 256).alias("topic"), (F.col("name") == F.col("leader")).alias("leads"))
        named = cut(made.unionByName(known.withColumn("leads", F.lit(False))))
        words = labels.select(F.col("topic").alias("name"), "keywords").join(named, "name").groupBy("topic").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keywords"))
        heads = labels.withColumnRenamed("topic", "name").join(named.filter("leads"), "name").drop("keywords", "name").join(words, "topic")
        new = heads.select(
            "topic", F.col("key").alias("scope"), "label", "label_vector", "summary_vector", "keywords", F.lit(False).alias("is_virtual"), F.lit(None).cast("int").alias("depth"),
            F.lit(self.batches).alias("seq"), F.lit(0).cast("long").alias("memory_count_since_summary"),
        )
        if old is not None:
            more = words.withColumnRenamed("keywords", "__k")
            both = F.array_sort(F.array_distinct(F.concat(F.coalesce("keywords", none), F.coalesce("__k", none))))
            kept = old.join(more, "topic", "left").withColumn("keywords", F.when(F.col("__k").isNull(), F.col("keywords")).otherwise(both)).drop("__k")
            new = kept.unionByName(new.join(old.select("topic"), "topic", "left_anti"))
        self.tables["topics"] = cut(new)
        return cut(flat.withColumn("name", F.concat_ws("/", "scope", "label")).join(named.select("name", "topic"), "name").select("segment_id", "scope", "pos", "label", "topic"))

    def _memories(self, segs: DataFrame, owned: DataFrame) -> DataFrame:
        reply = self.model.memories(F.col("text"), F.col("raw_labels")["label"])
        made = cut(memories_of(segs.select("segment_id", reply.alias("reply")), "segment_id", "reply"))
        owner = F.struct("segment_id", "pos").alias("owner")
        asked = made.select(owner, F.posexplode("topics").alias("at", "name")).select("owner", F.col("at").alias("pos"), "name").withColumn("vector", self.embedder.encode(F.col("name")))
        may = made.select("segment_id", owner).join(owned.select("segment_id", F.col("pos").alias("at"), "topic", "label"), "segment_id").select("owner", F.col("at").alias("pos"), "topic", "label").withColumn("vector", self.embedder.encode(F.col("label")))
        found = resolve(asked, may, self.settings.label_match).select("owner.segment_id", "owner.pos", F.col("topics").alias("topic_ids"))
        full = made.drop("topics").join(found, ["segment_id", "pos"], "left").join(segs.select("segment_id", "scope", "sample_id", "dia_ids", "created_at"), "segment_id")
        return full.select(
            F.sha2(F.concat_ws("/", "segment_id", "pos"), 256).alias("item"), "scope", "sample_id", "content", F.coalesce("topic_ids", F.array().cast("array<string>")).alias("topics"),
            "keywords", "importance", F.col("dia_ids").alias("source_dia_ids"), "created_at", self.embedder.encode(F.col("content")).alias("vector"),
        )

    def _single(self, memories: DataFrame) -> DataFrame:
        t = self.tables["topics"].select("topic", "label_vector")
        rows = memories.select("item", "vector", F.explode("topics").alias("topic")).join(t, "topic")
        best = rows.groupBy("item").agg(F.max_by("topic", F.struct(F.round(dot(F.col("vector"), F.col("label_vector")), 9), "topic")).alias("one"))
        return memories.join(best, "item", "left").withColumn("topics", F.when(F.col("one").isNotNull(), F.array("one")).otherwise(F.col("topics"))).drop("one")

    # --- index

    def build_index(self) -> None:
        """Hierarchy by clustering, further parents, summaries and merged siblings, then the association graph.

        Made anew from the topics that are not virtual.  A scope of fewer than two topics has no clusters:
        its topics lie below its root.
        """
        topics = cut(self.tables["topics"].filter("not is_virtual"))
        self.tables["topics"] = topics
        every, links = self.hierarchy(topics)
        every, links = self._more_parents(every, links)
        every, links = self._merge_siblings(self._summarised(every), links)
        every = cut(dag.with_depth(every, links))
        self.tables |= {"topics": every, "links": links, "edges": self.association(every.filter("not is_virtual"))}
        self.since_build = 0

    def hierarchy(self, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All topics, those of the clusters too, and the links to them and to the roots."""
        inner = cut(dag.cluster_topics(topics.withColumn("key", F.col("scope")), self.settings.cluster_distances, keyed=True).select(F.col("cluster").alias("parent"), F.col("member").alias("child")))
        below = inner.join(topics.select(F.col("topic").alias("child"), "scope", "label", "keywords"), "child")
        united = F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keywords")
        labels = below.groupBy(F.col("parent").alias("topic")).agg(F.min("scope").alias("scope"), F.array_sort(F.collect_list("label")).alias("l"), united)
        virtual = labels.withColumn("label", self.model.cluster_name(F.col("l"))).withColumn("label_vector", self.embedder.encode(F.col("label")))
        upper = virtual.select(
            "topic", "scope", "label", "label_vector", F.lit(None).cast("array<double>").alias("summary_vector"), "keywords", F.lit(True).alias("is_virtual"), F.lit(None).cast("int").alias("depth"),
            F.lit(self.batches).alias("seq"), F.lit(0).cast("long").alias("memory_count_since_summary"),
        )
        every = cut(topics.unionByName(upper))
        return every, cut(dag.attach_orphans(every, inner))

    def association(self, topics: DataFrame) -> DataFrame:
        """Co-occurrence by hard and soft memberships, the model's verdicts, weights, pruning."""
        s, memories = self.settings, self.tables["memories"]
        members = cut(assoc.bridge(memories, "item", "topics"))
        soft = assoc.soft_memberships(members, memories.select(F.col("item").alias("memory"), "vector", "scope"), topics.select("topic", F.col("label_vector").alias("vector"), "scope"), s.soft_membership)
        total = memories.groupBy("scope").agg(F.count("*").alias("n"))
        counts = assoc.marginals(members).join(topics.select("topic", "scope"), "topic")
        scored = assoc.with_npmi(assoc.cooccurrences(soft), counts, total).filter("n_a > 0 and n_b > 0")
        edges = assoc.directed(scored, s.npmi, s.min_cooccurrence, s.direction_epsilon).select("*", F.lit("co").alias("edge_type"), F.lit(0.0).alias("llm_score"), F.lit(0.0).alias("npmi_temp"))
        edges = cut(edges)
        edges = edges.unionByName(self._judged(topics, edges))
        return cut(assoc.prune(assoc.merge_edges(edges, s.edge_weights), s.prune_weight, s.max_out_degree).drop("rank"))

    def _more_parents(self, topics: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """topics with depth, and links and those from similar clusters that the model confirms."""
        topics = cut(dag.with_depth(topics, links))
        t = topics.withColumn("key", F.col("scope"))
        found = dag.multi_parents(t.filter("not is_virtual"), t.filter("is_virtual"), links, self.settings.multi_parent, self.settings.multi_parent_candidates, keyed=True)
        label = lambda end: topics.select(F.col("topic").alias(end), F.col("label").alias(f"{end}_label"))
        asked = found.join(label("parent"), "parent").join(label("child"), "child")
        told = cut(asked.withColumn("yes", self.model.is_parent(F.col("parent_label"), F.col("child_label")).try_cast("boolean")))
        return topics, cut(links.unionByName(told.filter("yes").select("parent", "child")))

    def _summarised(self, topics: DataFrame) -> DataFrame:
        """topics with the vector of a new summary, and a count from 0 on, where enough memories came."""
        members, s = assoc.bridge(self.tables["memories"], "item", "topics"), self.settings
        due = dag.summaries_due(topics, members, self.tables["memories"].select(F.col("item").alias("memory"), "content"), s.summary_interval)
        made = cut(due.join(topics.select("topic", "label"), "topic").select("topic", self.model.summary(F.col("label"), F.col("texts")).alias("summary")))
        vector = F.when(F.trim("summary") != "", self.embedder.encode(F.col("summary")))
        new = made.select("topic", vector.alias("__new"), F.lit(True).alias("__due"))
        rows = topics.join(new, "topic", "left").withColumn("summary_vector", F.coalesce("__new", "summary_vector"))
        return cut(rows.withColumn("memory_count_since_summary", F.when(F.col("__due"), F.lit(0)).otherwise(F.col("memory_count_since_summary")).cast("long")).drop("__new", "__due"))

    def _merge_siblings(self, topics: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """topics and links with similar siblings of few memories merged; memories and segments name what is left."""
        counts = assoc.marginals(assoc.bridge(self.tables["memories"], "item", "topics"))
        merged = cut(dag.merge_map(cut(dag.mergeable_siblings(topics.withColumn("key", F.col("scope")), links, counts, self.settings))))
        if merged.isEmpty():
            return topics, links
        kept, joined = topics, links
        for k, (table, key, column) in enumerate((("memories", "item", "topics"), ("segments", "segment_id", "topic_ids"))):
            rows = self.tables[table]
            each = rows.select(key, F.posexplode(column).alias("at", "topic"))
            if k == 0:
                kept, joined, each = dag.merge_topics(topics, links, each, merged)
            else:
                each = each.join(merged, "topic", "left").withColumn("topic", F.coalesce("into", "topic"))
            self.tables[table] = cut(rows.join(ordered_distinct(each, [key], "at", "topic", "__now"), key, "left").withColumn(column, F.coalesce("__now", column)).drop("__now"))
        return cut(kept), cut(joined)

    def _judged(self, topics: DataFrame, edges: DataFrame) -> DataFrame:
        """Edges between moderately similar topics without one, as the model sees them."""
        s = self.settings
        pairs = assoc.causal_candidates(topics.select("topic", "scope", F.col("label_vector").alias("vector")), edges, s.causal_low, s.causal_high, s.causal_candidates)
        label = lambda end: topics.select(F.col("topic").alias(end), F.col("label").alias(f"{end}_label"))
        asked = pairs.join(label("a"), "a").join(label("b"), "b")
        return assoc.judged_edges(cut(asked.select("a", "b", self.model.association(F.col("a_label"), F.col("b_label")).alias("reply"))))

    # --- queries

    def store(self) -> Store:
        t = self.tables
        closure = Hierarchy(t["links"]).descendants().select("ancestor", "descendant")
        return Store(
            t["topics"].select("topic", "label_vector", "summary_vector", "keywords", "is_virtual", "scope"), t["memories"].select("item", "vector", "topics", "keywords", "importance", "scope"),
            t["links"], cut(closure), t["edges"].select("source", "target", "weight"), self.settings,
        )

    def retrieve(self, queries: DataFrame, k: int = 10, **flags) -> DataFrame:
        """queries(query, text[, sample_id]) to query, item, score, source_type, matched, rank.

        With by_sample a query sees the memories of its sample only.
        """
        asked = cut(queries.select("query", "text", self._scope().alias("scope"), self.embedder.encode(F.col("text")).alias("qv")))
        return retrieve(self.store(), asked, k, **flags)

    def results(self, queries: DataFrame, k: int = 10, **flags) -> DataFrame:
        """What retrieve finds, as shown to a reader: contents, rounded scores, labels of topics."""
        return formatted(self.retrieve(queries, k, **flags), self.tables["memories"], self.tables["topics"])

    def answer(self, queries: DataFrame, k: int = 10, **flags) -> DataFrame:
        """query, text, memories (the contents of the k best, in order), answer: the model's, or the fallback's."""
        found = self.retrieve(queries, k, **flags).join(self.tables["memories"].select("item", "content"), "item").filter("content is not null")
        told = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "content")))["content"].alias("memories"))
        rows = cut(queries.select("query", "text").join(told, "query", "left").withColumn("memories", F.coalesce("memories", F.array().cast("array<string>"))))
        reply = F.coalesce(F.nullif(F.trim(self.model.answer(F.col("text"), F.col("memories"))), F.lit("")), F.lit(NO_ANSWER))
        return cut(rows.withColumn("answer", reply))

    def judge(self, answers: DataFrame) -> DataFrame:
        """answers(text, gold, answer, ...) with correct: 1 if the model's verdict is CORRECT."""
        verdict = self.model.judge(F.col("text"), F.col("gold"), F.col("answer"))
        return answers.withColumn("correct", F.coalesce((F.upper(F.trim(verdict)) == "CORRECT").cast("int"), F.lit(0)))

    def stats(self) -> dict[str, int]:
        n = {name: df.count() for name, df in self.tables.items()}
        return n | {"virtual_topics": self.tables["topics"].filter("is_virtual").count()} if "topics" in self.tables else n
