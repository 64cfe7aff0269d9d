"""Two subjects, a transition phrase, and a question whose verb fits both."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from mnemoweft.config import DEFAULTS
from mnemoweft.engine import Engine
from mnemoweft.experiments import ablations, contribution
from mnemoweft.models import EchoModel, HashEmbedder

GARDEN = [f"garden compost soil {w}" for w in ("needs care", "is rich now", "likes rain", "in spring", "for beds", "stays moist", "smells good")]
TURNS = "sample_id string, session_id string, turn_idx int, dia_id string, role string, content string"
CHESS = [f"chess knight opening {w}" for w in ("by the way", "is sharp", "takes time", "wins games", "was new", "needs nerve", "they said")]


class Model(EchoModel):
    def labels(self, text):
        garden = F.contains(text, F.lit("garden"))
        return F.when(garden, '```json\n[{"label": "garden care", "keywords": ["garden", "compost"]}]\n```').otherwise('<think>hm</think>["chess openings", 7]')


@pytest.fixture(scope="module")
def engine(spark):
    rows = [("s", "session_1", k, f"SYNTH:{k + 1}", ["user", "assistant"][k % 2], t) for k, t in enumerate(GARDEN + CHESS)]
    e = Engine(spark, model=Model())
    e.ingest(spark.createDataFrame(rows, TURNS))
    e.build_index()
    return e


def test_segments_and_topics(engine):
    segs = engine.tables["segments"].orderBy(F.element_at("dia_ids", 1)).collect()
    assert sorted(len(s.dia_ids) for s in segs) == [7, 7]
    assert sorted(r.label for r in engine.tables["topics"].filter("not is_virtual").collect()) == ["chess openings", "garden care"]
    assert engine.stats()["memories"] == 2


def test_retrieval_finds_the_subject(spark, engine):
    q = spark.createDataFrame([(1, "how does compost help the garden", "s"), (2, "which chess opening moves the knight", "s"), (3, "compost", "other")], "query int, text string, sample_id string")
    for mode in ("store", "memory"):
        top = engine.retrieve(q, 1, mode=mode).join(engine.tables["memories"].select("item", "content"), "item").collect()
        got = {r.query: r.content for r in top}
        assert "garden" in got[1] and "chess" in got[2] and 3 not in got


def test_copies_are_independent(engine):
    other = engine.copy()
    other.clear()
    assert engine.tables and not other.tables


def test_other_segmentation_and_single_topic(spark, engine):
    e = engine.copy()
    rows = [("s", "x", k, f"D{k}", "user", t) for k, t in enumerate(GARDEN)]
    e.clear()
    e.ingest(spark.createDataFrame(rows, TURNS), window=3, multilabel=False)
    assert e.tables["segments"].count() == 3 and e.tables["memories"].filter("size(topics) = 1").count() == 3


def test_index_asks_the_model_and_merges_siblings(spark):
    class Telling(EchoModel):
        def is_parent(self, parent, child):
            return F.lit(True)

        def summary(self, label, memories):
            return F.concat(F.lit("about "), label)

        def association(self, a, b):
            return F.lit('{"related": true, "type": "causal", "score": 0.9, "direction": "a->b"}')

    unit = lambda *v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    vectors = {"a": unit(1.0, 0.0, 0.0), "a2": unit(1.0, 0.01, 0.0), "c": unit(0.45, 0.9, 0.0), "d": unit(0.0, 0.0, 1.0)}
    words = {"a": "garden care", "a2": "garden care", "c": "chess", "d": "music"}
    topics = [(t, "s", words[t], v, None, [words[t]], False, None, 1, 6 if t == "d" else 1) for t, v in vectors.items()]
    memories = [(f"m{k}", "s", "s", f"text {k}", ["d"], ["k"], 0.5, [], vectors["d"]) for k in range(6)] + [("n", "s", "s", "soil", ["a", "a2"], ["k"], 0.5, [], vectors["a"])]
    e = Engine(spark, embedder=HashEmbedder(3), model=Telling())
    e.tables = {
        "topics": spark.createDataFrame(topics, "topic string, scope string, label string, label_vector array<double>, summary_vector array<double>, keywords array<string>, is_virtual boolean, depth int, seq int, memory_count_since_summary long"),
        "memories": spark.createDataFrame(memories, "item string, scope string, sample_id string, content string, topics array<string>, keywords array<string>, importance double, source_dia_ids array<string>, vector array<double>"),
        "segments": spark.createDataFrame([("s1", ["a2"])], "segment_id string, topic_ids array<string>"),
    }
    e.build_index()
    got = {r.topic: r for r in e.tables["topics"].collect()}
    assert "a" in got and "a2" not in got
    assert e.tables["segments"].first().topic_ids == ["a"]
    assert e.tables["memories"].filter("item = 'n'").first().topics == ["a"]
    assert got["d"].summary_vector is not None and got["a"].summary_vector is None
    assert e.tables["links"].filter("parent = 'a2' or child = 'a2'").isEmpty()
    judged = {(r.source, r.target): (r.llm_score, r.edge_type) for r in e.tables["edges"].collect() if r.llm_score > 0}
    assert judged == {("a", "c"): (0.9, "causal")}


class Naming(EchoModel):
    """The first word of a text is its label."""

    def labels(self, text):
        word = F.regexp_extract(text, r": (\w+)", 1)
        return F.concat(F.lit('[{"label": "'), word, F.lit('", "keywords": ["'), word, F.lit('"]}]'))

    def answer(self, question, memories):
        return F.when(F.size(memories) > 0, F.concat(F.lit("so "), F.get(memories, F.lit(0))))


def turns(spark, sample, session, texts, start=0):
    return spark.createDataFrame([(sample, session, start + k, f"D{k}", "user", t) for k, t in enumerate(texts)], TURNS)


def test_later_turns_add_to_the_store_and_samples_stay_apart(spark):
    e = Engine(spark, model=Naming())
    e.ingest(turns(spark, "a", "s1", ["garden one", "garden two", "garden three"]), window=3)
    first = e.tables["topics"].collect()
    e.ingest(turns(spark, "a", "s2", ["Garden four", "garden five", "chess six", "chess seven"]), window=2)
    e.ingest(turns(spark, "b", "s1", ["garden nine", "garden ten"]), window=2)
    got = sorted((t.scope, t.label) for t in e.tables["topics"].collect())
    assert got == [("a", "chess"), ("a", "garden"), ("b", "garden")]
    assert {t.topic for t in first} < {t.topic for t in e.tables["topics"].collect()}
    assert e.tables["segments"].count() == 4 and e.tables["memories"].count() == 4
    garden = next(t for t in e.tables["topics"].collect() if (t.scope, t.label) == ("a", "garden"))
    assert garden.keywords == ["Garden", "garden"] and garden.memory_count_since_summary == 2
    e.ingest(turns(spark, "b", "s1", ["garden nine", "garden ten"]), window=2)  # again: nothing new
    assert e.tables["memories"].count() == 4
    e.build_index()
    assert e.tables["topics"].filter("depth is null").isEmpty()
    roots = {r.parent for r in e.tables["links"].collect() if r.parent.startswith("__ROOT__")}
    assert roots == {"__ROOT__/a", "__ROOT__/b"}
    q = spark.createDataFrame([(1, "garden", "a"), (2, "garden", "b"), (3, "garden", "c")], "query int, text string, sample_id string")
    shown = e.results(q, 5).collect()
    assert {(r.query, tuple(r.labels)) for r in shown} == {(1, ("garden",)), (1, ("chess",)), (2, ("garden",))}
    assert all(r.score == round(r.score, 2) for r in shown)
    told = {r.query: r.answer for r in e.answer(q, 5).collect()}
    assert told[2].startswith("so User: garden nine") and told[3] == "no information available"
    whole = Engine(spark, model=Naming(), by_sample=False)
    whole.ingest(turns(spark, "a", "s1", ["garden one"]).unionByName(turns(spark, "b", "s1", ["garden two"])), window=1)
    assert whole.tables["topics"].count() == 1


def test_triggers_fire_while_turns_come_in(spark):
    e = Engine(spark, model=Naming(), settings=replace(DEFAULTS, summary_interval=3, rebuild_interval=5))
    e.ingest(turns(spark, "a", "s1", ["garden one", "garden two"]), window=1, online=True)
    assert e.tables["topics"].first().memory_count_since_summary == 2 and "links" not in e.tables
    e.ingest(turns(spark, "a", "s2", ["garden three", "garden four", "garden five"]), window=1, online=True)
    t = e.tables["topics"].first()
    assert t.memory_count_since_summary == 0 and t.summary_vector is not None and "links" in e.tables and e.since_build == 0


def test_ablations_and_contribution(spark):
    texts = ["garden one", "garden two", "chess three", "chess four"]
    q = spark.createDataFrame([(1, "garden two", "a", 1, ["D1"]), (2, "chess", "a", 2, []), (3, "chess four", "b", 1, ["D9"])], "query int, text string, sample_id string, category int, evidence array<string>")
    got = {(r.variant, r.query): (r.p_at_k, r.r_at_k) for r in ablations(Engine(spark, model=Naming()), turns(spark, "a", "s", texts), q, k=2, window=2, variants=("full", "no_multilabel")).collect()}
    assert len(got) == 6 and got["full", 1][1] == 1.0 and got["full", 2] == (0.0, 1.0) and got["full", 3] == (0.0, 0.0)
    found = lambda use: spark.createDataFrame([(1, "x"), (1, "y")] if use else [(1, "x")], "query int, item string")
    rows = contribution(found, spark.createDataFrame([(1, "x"), (1, "y")], "query int, item string"), q).orderBy("query").collect()
    assert [(r.full, r.without, r.difference) for r in rows] == [(1.0, 0.5, 0.5), (1.0, 1.0, 0.0), (1.0, 1.0, 0.0)]
