"""Operators on small fixtures, against brute force where there is any."""

import itertools
import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemoweft.config import Settings
from mnemoweft.functions.vector import mean_vector, normalise
from mnemoweft.operators import assign, assoc, dag, evaluate, maintain, retrieve, search, segment
from mnemoweft.operators.ppr import closed_form, personalized_pagerank
from mnemoweft.operators.search import items_above, nearest_items
from mnemoweft.runtime import cut, split_join, with_dense_codes, with_positions
from mnemoweft.sources import corpus
from mnemoweft.sources.store import TableStore, write_json
from mnemoweft.streaming.incremental import IncrementalAssociation, reinforce_onto
from mnemoweft.tables import current_rows


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) if names else tuple(r) for r in df.collect())


def test_current_rows(spark):
    data = [("a", 1, "x", {"k": 1.0}), ("a", 2, None, None), ("a", 2, None, None), ("b", None, "y", {"k": 2.0}), (None, 3, "z", None), ("c", 1, "p", None), ("c", 1, "q", None)]
    df = spark.createDataFrame(data, "id string, version int, value string, extra map<string,double>")
    assert [tuple(r) for r in current_rows(df, ["id"], "version").orderBy("id").collect()] == [("a", 2, None, None), ("b", None, "y", {"k": 2.0}), ("c", 1, "q", None)]


def test_codes_positions_and_split_join(spark):
    df = spark.createDataFrame([(f"k{i:03}", i % 7) for i in range(200)], "k string, g int")
    assert rows(with_dense_codes(df, ["k"]), "k", "code") == [(f"k{i:03}", i) for i in range(200)]
    placed = with_positions(df.repartition(5), ["g"], ["k"])
    assert rows(placed, "k", "pos") == [(f"k{i:03}", i // 7) for i in range(200)]
    left = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"c{i}", i) for i in range(100)], "k string, v int")
    right = spark.createDataFrame([("hot", 900, "H")] + [(f"c{i}", 1, "C") for i in range(0, 100, 2)], "k string, n long, tag string")
    got = split_join(left, right, "k", "n", 1000, share=0.01)
    assert got.count() == 950 and got.filter("tag = 'H'").count() == 900


@pytest.mark.parametrize(("marks", "n", "want"), [([1, 2, 5, 6, 9], 12, [5, 9]), ([1, 2, 5, 6, 9], 11, [5]), ([], 5, []), ([3], 5, []), ([3], 6, [3]), ([1], 2, [])])
def test_kept_boundaries(spark, marks, n, want):
    arr = F.array(*map(F.lit, marks)) if marks else F.array().cast("array<int>")
    assert spark.range(1).select(segment.kept_boundaries(arr, F.lit(n)).alias("k")).first().k == want


def test_chunks(spark):
    d = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, "  "), (3, None), (4, "x")], "id int, text string")
    assert [r.text.split()[0] for r in segment.chunks(d, "id", "text", 10).orderBy("id", "chunk").collect()] == ["0", "10", "20", "x"]
    assert segment.chunks(d, "id", "text", -1).count() == 2


def test_search_against_numpy(spark):
    r = np.random.default_rng(1)
    v, q = r.standard_normal((300, 8)), r.standard_normal((5, 8))
    items = spark.createDataFrame([(i, x.tolist(), [i % 4]) for i, x in enumerate(v)] + [(900, None, [0]), (901, [1.0], [0])], "item int, vector array<double>, topics array<int>").repartition(6)
    asked = spark.createDataFrame([(i, x.tolist(), [i % 4, 9]) for i, x in enumerate(q)], "query int, qv array<double>, topics array<int>")
    g = q @ v.T
    got = rows(nearest_items(items, asked, 7), "query", "rank", "item")
    assert got == sorted((i, k + 1, int(j)) for i in range(5) for k, j in enumerate(np.argsort(-g[i])[:7]))
    masked = np.where((np.arange(300) % 4)[None] == (np.arange(5) % 4)[:, None], g, -np.inf)
    assert rows(nearest_items(items, asked, 7, filtered=True), "query", "rank", "item") == sorted((i, k + 1, int(j)) for i in range(5) for k, j in enumerate(np.argsort(-masked[i])[:7]))
    assert rows(items_above(items, asked, 3.0), "query", "item") == sorted((int(a), int(b)) for a, b in zip(*np.nonzero(g >= 3.0)))
    assert nearest_items(items, asked.limit(0), 3).count() == 0


def test_search_in_many_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 2)
    monkeypatch.setattr(search, "ROWS", 8)
    monkeypatch.setattr(search, "HELD", 50)
    monkeypatch.setattr(search, "PART", 16)
    monkeypatch.setattr(search, "PRODUCTS", 40)
    r = np.random.default_rng(2)
    v, q = r.integers(-2, 3, (200, 4)).astype(float), r.standard_normal((7, 4))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item int, vector array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query int, qv array<double>")
    g = np.round(q @ v.T, 9)
    want = sorted((i, k + 1, j) for i in range(7) for k, j in enumerate(sorted(range(200), key=lambda j: (-g[i, j], j))[:5]))
    assert rows(nearest_items(items, asked, 5), "query", "rank", "item") == want
    assert rows(items_above(items, asked, 2.0), "query", "item") == sorted((int(a), int(b)) for a, b in zip(*np.nonzero(g >= 2.0)))
    monkeypatch.setattr(search, "BLOCK", 100)
    assert rows(nearest_items(items, asked, 5), "query", "rank", "item") == want
    # the same in this process, where the small limits hold
    scan = search._block_scan(pa.array(range(7)), q, 5, None)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(v.tolist())], names=["item", "vector"])
    got = {(a, b) for out in scan([batch, batch.slice(0, 0)]) for a, b in zip(out[0].to_pylist(), out[1].to_pylist())}
    assert {(i, j) for i, _, j in want} <= got and len(got) < 7 * 60


def naive_clusters(ids, d, cuts):
    groups = [[i] for i in range(len(ids))]
    dist = lambda x, y: np.mean([d[i][j] for i in x for j in y])
    out = {}
    for limit in sorted(cuts):
        while len(groups) > 1:
            x, y = min(itertools.combinations(groups, 2), key=lambda p: dist(*p))
            if dist(x, y) > limit:
                break
            groups = [g for g in groups if g not in (x, y)] + [x + y]
        for g in groups:
            if len(g) > 1:
                out.setdefault(tuple(sorted(ids[i] for i in g)), limit)
    return out


def test_average_linkage(spark):
    r = random.Random(3)
    ids = [f"t{k:02}" for k in range(24)]
    points = [(r.random(), r.random()) for _ in ids]
    d = [[min(1.0, 2 * ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5) for b in points] for a in points]
    pairs = spark.createDataFrame([(ids[i], ids[j], float(d[i][j])) for i in range(24) for j in range(i + 1, 24)], "a string, b string, distance double")
    want = naive_clusters(ids, d, (0.5, 0.3, 0.2))
    for bound in (10**6, 9):
        held = defaultdict(list)
        for x in dag.cluster_cuts(pairs, (0.5, 0.3, 0.2), task_links=bound).collect():
            held[x.cluster, x.distance].append(x.member)
        assert {tuple(sorted(m)): c for (_, c), m in held.items()} == want
    inner = {x.cluster: x.parent for x in dag.cluster_cuts(pairs, (0.5, 0.3, 0.2), nested=True).collect()}
    assert set(inner.values()) - {None} <= set(inner) and all(p is None or int(p.split("+")[1]) > int(c.split("+")[1]) for c, p in inner.items())
    assert dag.cluster_cuts(pairs.limit(0)).count() == 0


def topics_frame(spark, data):
    schema = "topic string, label string, label_vector array<double>, summary_vector array<double>, keywords array<string>"
    return spark.createDataFrame(data, schema)


def test_topic_similarity_and_siblings(spark):
    t = topics_frame(spark, [("a", "red fox", [1.0, 0.0], None, ["k"]), ("b", "Red dog", [1.0, 0.0], [0.0, 1.0], ["k", "m"]), ("c", "blue", [0.0, 1.0], [1.0, 0.0], []), ("d", None, None, None, None)])
    got = {(r.a, r.b): r.similarity for r in dag.similar_topics(t, t, 0.5).filter("a < b").collect()}
    assert got == {("a", "b"): pytest.approx(0.6 + 0.2 * 0.5 + 0.2 * 0.5)}
    links = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c"), ("b", "z")], "parent string, child string")
    counts = spark.createDataFrame([("a", 3), ("b", 50)], "topic string, n_topic long")
    assert dag.mergeable_siblings(t, links, counts, Settings(sibling_merge=0.7)).count() == 0
    pairs = dag.mergeable_siblings(t, links, counts.filter("topic = 'a'"), Settings(sibling_merge=0.7))
    assert rows(pairs, "a", "b") == [("a", "b")]
    assert rows(dag.rewire(links, dag.merge_map(pairs))) == [("a", "z"), ("p", "a"), ("q", "c")]
    assert rows(dag.siblings_of(links, t.filter("topic = 'a'"))) == [("a", "b")]


def test_greedy_descent_and_multi_parents(spark):
    t = topics_frame(spark, [("m", "x", [1.0, 0.0], None, []), ("n", "x", [0.8, 0.6], None, []), ("o", "y", [0.0, 1.0], None, [])])
    links = spark.createDataFrame([("ROOT", "m"), ("ROOT", "o"), ("m", "n")], "parent string, child string")
    new = topics_frame(spark, [("new", "x", [0.9, 0.435], None, []), ("odd", "w", [-1.0, 0.0], None, [])])
    assert rows(dag.greedy_descent(new, t, links, "ROOT", 0.5), "topic", "visited", "depth") == [("new", "ROOT", 0), ("new", "m", 1), ("new", "n", 2), ("odd", "ROOT", 0)]
    leaves, uppers = new.withColumn("depth", F.lit(3)), t.withColumn("depth", F.lit(1))
    assert rows(dag.multi_parents(leaves, uppers, links, 0.5), "child", "parent") == [("new", "m"), ("new", "n")]


def test_halves_put_the_odd_row_second(spark):
    df = spark.createDataFrame([("g", k) for k in range(5)] + [("h", 1)], "g string, t int")
    assert rows(dag.split_halves(df, "g", ["t"])) == [("g", 0, 0), ("g", 1, 0), ("g", 2, 1), ("g", 3, 1), ("g", 4, 1), ("h", 1, 1)]


def test_pagerank_on_a_path(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0)], "source string, target string, weight double")
    seeds = spark.createDataFrame([("q", "a", 1.0)], "query string, node string, mass double")
    assert rows(personalized_pagerank(edges, seeds, task_edges=1), "node") == [("b",), ("c",)]
    got = {r.node: r.score for r in personalized_pagerank(edges, seeds).collect()}
    assert got == {"b": pytest.approx(0.15 * 0.85), "c": pytest.approx(0.15 * 0.85**2)}


def fold(events, s=Settings()):
    w = t = None
    for ts, d in sorted(events):
        if w is None:
            w = max(0.0, min(1.0, s.edge_weights[0] * d))
        else:
            w *= 0.5 ** ((ts - t).total_seconds() / 86400 / s.half_life_days)
            w = min(1.0, w + s.learning_rate * (1 - w) * d)
        t = ts
    return w


def test_reinforcement_in_one_and_in_many_batches(spark):
    r = random.Random(2)
    base = datetime(2024, 1, 1)
    ev = [(k, base + timedelta(hours=7 * i + r.random()), r.random(), i) for i, k in enumerate(r.choices("abc", k=60))]
    df = spark.createDataFrame(ev, "k string, t timestamp_ntz, d double, i int")
    want = {k: fold([(t, d) for x, t, d, _ in ev if x == k]) for k in "abc"}
    assert {x.k: x.weight for x in assoc.reinforced(df, ["k"], "d", "t", "i").collect()} == pytest.approx(want)
    state = spark.createDataFrame([], "k string, weight double, last_updated timestamp_ntz")
    for lo, hi in ((0, 13), (13, 14), (14, 60)):
        state = spark.createDataFrame(reinforce_onto(state, df.filter(f"i >= {lo} and i < {hi}"), ["k"], "d", "t", "i").collect(), "k string, weight double, last_updated timestamp_ntz")
    assert {x.k: x.weight for x in state.collect()} == pytest.approx(want)


def test_edges(spark):
    pairs = spark.createDataFrame([("a", "b", 4, 4, 40, 0.5), ("c", "d", 5, 10, 10, 0.5), ("e", "f", 9, 9, 9, 0.05)], "a string, b string, n_ab int, n_a int, n_b int, npmi double")
    assert rows(assoc.directed(pairs), "source", "target") == [("a", "b"), ("c", "d"), ("d", "c")]
    typed = spark.createDataFrame([("a", "b", "zz", 1), ("a", "b", "causal", 2), ("a", "b", "co", 3)], "source string, target string, edge_type string, at int")
    typed = typed.withColumns({c: F.lit(0.0) for c in ("npmi_mem", "llm_score", "npmi_temp")})
    assert assoc.merge_edges(typed, at="at").first().edge_type == "causal" and assoc.merge_edges(typed).first().edge_type == "zz"
    e = spark.createDataFrame([("a", "b", "co", 0.5, None, 0.0), ("a", "b", "causal", 0.2, 0.9, float("nan")), ("a", "c", "co", 9.0, 9.0, 9.0)], "source string, target string, edge_type string, npmi_mem double, llm_score double, npmi_temp double")
    got = {r.target: r for r in assoc.merge_edges(e).collect()}
    assert got["b"].edge_type == "causal" and got["b"].weight == pytest.approx(0.4 * 0.5 + 0.4 * 0.9) and got["c"].weight == 1
    w = spark.createDataFrame([("s", f"t{k}", 0.1 * k) for k in range(9)], "source string, target string, weight double")
    assert rows(assoc.prune(w), "target", "rank") == [("t4", 5), ("t5", 4), ("t6", 3), ("t7", 2), ("t8", 1)]


def test_diversity(spark):
    data = [(1, k, 1.0 - k / 10, k + 1, [1.0, 0.0] if k < 3 else [0.0, 1.0], ["x"] if k < 3 else ["y"]) for k in range(5)]
    c = spark.createDataFrame(data, "query int, item int, score double, rank int, vector array<double>, topics array<string>")
    assert [r.item for r in retrieve.diversified(c, 2).orderBy("rank").collect()] == [0, 3]
    assert [r.item for r in retrieve.diversified(c, 3, Settings(mmr_lambda=1.0)).orderBy("rank").collect()] == [0, 1, 2]


def test_labels_match_and_group(spark):
    t = topics_frame(spark, [("t1", "Garden Care", [1.0, 0.0], None, []), ("t0", "garden care ", [1.0, 0.0], None, []), ("t2", "chess", [0.0, 1.0], None, ["k"])]).withColumn("seq", F.when(F.col("topic") == "t1", 1).otherwise(2))
    labels = topics_frame(spark, [("n1", " GARDEN care", [0.0, 1.0], None, []), ("n2", "chess club", [0.0, 1.0], None, []), ("n3", "far", [-1.0, 0.0], None, [])])
    assert rows(assign.match_labels(labels, t), "name", "topic", "exact") == [("n1", "t1", True), ("n2", "t2", False)]
    assert rows(assign.group_labels(t)) == [("t0", "t0"), ("t1", "t0"), ("t2", "t2")]
    names = spark.createDataFrame([("o", 0, "Chess", None), ("p", 0, "none", [1.0, 0.0]), ("q", 0, "y", None), ("q", 1, "x", None), ("q", 2, "Y", None)], "owner string, pos int, name string, vector array<double>")
    data = [("o", 0, "t2", "chess", None), ("o", 1, "t1", "x", None), ("p", 0, "t2", "y", [0.0, 1.0]), ("p", 1, "t1", "x", None), ("q", 0, "t1", "x", None), ("q", 1, "t2", "y", None)]
    own = spark.createDataFrame(data, "owner string, pos int, topic string, label string, vector array<double>")
    assert rows(assign.resolve(names, own)) == [("o", ["t2"]), ("p", ["t2", "t1"]), ("q", ["t2", "t1"])]
    keyed = labels.withColumn("key", F.lit("other"))
    assert assign.match_labels(keyed, t.withColumn("key", F.lit("own")), keyed=True).count() == 0


def test_memories_of_replies(spark):
    replies = [(1, '[{"content": "a", "topics": ["t"], "importance": "high"}, {"content": " "}, 3, {"topics": []}]'), (2, 'Here: {"content": "b", "importance": 0.9} ok'), (3, "nothing"), (4, None), (5, "```json\n[]\n```")]
    got = rows(assign.memories_of(spark.createDataFrame(replies, "id int, reply string"), "id", "reply"), "id", "content", "topics", "importance")
    assert got == [(1, "a", ["t"], 0.5), (2, "b", [], 0.9)]


def test_corpus(spark, tmp_path):
    turn = lambda s, i, **k: {"speaker": "Ann" if i % 2 else "Bob", "dia_id": f"D{s}:{i}", "text": f"text {i}", **k}
    conv = {"speaker_a": "Ann", "speaker_b": "Bob", "session_1": [turn(1, 1), turn(1, 2, blip_caption="a cat")], "session_1_date_time": "1:56 pm on 8 May, 2023", "session_2": [], "session_4": [turn(4, 1)], "session_4_date_time": "soon"}
    qa = [{"question": "q", "answer": 2022, "evidence": ["D1:1"], "category": 1}, {"question": "r", "evidence": ["D4:1", "odd"], "category": 5}]
    (tmp_path / "c.json").write_text(json.dumps([{"sample_id": "s1", "conversation": conv, "qa": qa}]))
    samples = corpus.read_samples(spark, str(tmp_path / "c.json"))
    line = json.dumps({"sample_id": "s1", "conversation": conv, "qa": qa})
    (tmp_path / "lines.json").write_text("\n" + line + "\n" + line.replace('"s1"', '"s2"') + "\n" + line.replace('"s1"', '"s3"'))
    assert rows(corpus.read_samples(spark, str(tmp_path / "lines.json")), "sample_id") == [("s1",), ("s2",), ("s3",)]
    assert corpus.read_samples(spark, str(tmp_path / "lines.json"), lines=True).count() == 3
    assert corpus.sample(samples, "s1").count() == 1 and corpus.sample(samples, "no").count() == 0
    assert rows(corpus.sessions(samples), "n") == [(1,)] and rows(corpus.sessions(samples, stop_at_gap=False), "n") == [(1,), (4,)]
    turns = corpus.flatten(corpus.sessions(samples, stop_at_gap=False)).orderBy("session_id", "turn_idx").collect()
    assert [t.content for t in turns] == ["text 1", "text 2 [shares image: a cat]", "text 1"]
    assert [str(t.ts) for t in turns[1:]] == ["2023-05-08 13:56:00", "2023-05-05 00:00:00"]
    assert rows(corpus.questions(samples), "question", "answer") == [("q", "2022"), ("r", "no information available")]
    assert rows(corpus.questions(samples, max_sessions=1), "question") == [("q",)] and corpus.questions(samples, [5]).count() == 1


def test_store_and_upsert(spark, tmp_path):
    a, b = TableStore(spark, str(tmp_path), "a"), TableStore(spark, str(tmp_path), "b")
    df = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v int")
    a.sync(topics=df)
    b.sync(topics=df.filter("v = 1"))
    a.write("topics", maintain.upsert(df, spark.createDataFrame([("y", 5), ("z", 3), ("z", 4)], "id string, v int"), ["id"]))
    assert rows(a.read("topics")) == [("x", 1), ("y", 5), ("z", 4)] and b.count("topics") == 1
    a.assert_unique("topics", ["id"])
    a.clear("topics")
    assert b.count("topics") == 1 and a.count("topics") == 0
    edges = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "w")], "s string, t string")
    assert rows(maintain.delete(edges, spark.createDataFrame([("y",)], "id string"), ["s", "t"], "id")) == [("z", "w")]


def test_incremental_state_equals_whole(spark, tmp_path):
    r = random.Random(5)
    base = datetime(2024, 1, 1)
    data = [(f"m{r.randrange(40)}", r.sample("abcdef", r.randrange(4)), base + timedelta(hours=r.randrange(50), seconds=k)) for k in range(150)]
    schema = "memory string, topics array<string>, version timestamp_ntz"
    rebuilt = []
    state = IncrementalAssociation(spark, str(tmp_path / "s"), Settings(rebuild_interval=15), rebuilt.append)
    for b, lo in enumerate(range(0, 150, 50)):
        state.process(spark.createDataFrame(data[lo : lo + 50], schema), b)
        state.process(spark.createDataFrame(data[lo : lo + 50], schema), b)  # a batch that runs again
    whole = current_rows(spark.createDataFrame(data, schema), ["memory"], "version")
    members = assoc.bridge(whole, "memory", "topics")
    want = assoc.with_npmi(assoc.cooccurrences(members), assoc.marginals(members), whole.agg(F.count("*")))
    assert rows(state.npmi().select("a", "b", "n_ab", "n_a", "n_b", "n")) == rows(want.select("a", "b", "n_ab", "n_a", "n_b", "n"))
    assert rebuilt
    edges = {(r.source, r.target): r for r in state.read("edges").collect()}
    assert edges and all(0 < r.weight <= 1 for r in edges.values()) and max(r.last_updated for r in edges.values()) <= max(d[2] for d in data)
    assert state._versions() == [1, 2]


def test_edges_of_the_stream(spark, tmp_path):
    base = datetime(2024, 1, 1)
    state = IncrementalAssociation(spark, str(tmp_path / "s"))
    schema = "memory string, topics array<string>, version timestamp_ntz"
    first = [("m0", ["a", "b"], base), ("m1", ["c"], base), ("m2", ["c"], base)]
    state.process(spark.createDataFrame(first, schema), 0)
    assert {(r.source, r.target): r.weight for r in state.read("edges").collect()} == pytest.approx({("a", "b"): 0.4, ("b", "a"): 0.4})
    state.process(spark.createDataFrame([("m3", ["a", "b"], base + timedelta(days=30)), ("m4", ["a"], base)], schema), 1)
    n = np.log(2 * 5 / (3 * 2)) / -np.log(2 / 5)  # a 3, b 2, both 2 of 5: b leans to a
    want = 0.4 * 0.5 * (1 - 0.2 * n) + 0.2 * n
    assert {(r.source, r.target): r.weight for r in state.read("edges").collect()} == pytest.approx({("a", "b"): 0.4, ("b", "a"): want})


def test_result_does_not_depend_on_partitions(spark):
    t = spark.createDataFrame([("s", "x", k, f"so {k % 5} word{k % 3}", [float(k % 2), 1.0]) for k in range(40)], "a string, b string, i int, content string, vector array<double>")
    run = lambda d: rows(segment.segments(segment.boundaries(d, ["a", "b"], "i"), ["a", "b"]))
    assert run(t) == run(t.repartition(9))


def test_queries_of_another_size_do_not_hide_the_others(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item int, vector array<double>")
    asked = spark.createDataFrame([(0, []), (1, [1.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "query int, qv array<double>").coalesce(1)
    assert rows(nearest_items(items, asked, 1), "query", "item") == [(2, 1), (3, 2)]
    assert rows(items_above(items, asked, 0.5), "query", "item") == [(2, 1), (3, 2)]


def test_similar_topics_without_vectors_and_below_any_bound(spark):
    t = topics_frame(spark, [("a", "red fox", None, None, ["k"]), ("b", "red fox", None, None, ["k"]), ("c", "blue", [1.0, 0.0], None, []), ("d", None, [-1.0, 0.0], [0.0, 1.0], None)])
    got = {(r.a, r.b): r.similarity for r in dag.similar_topics(t, t, 0.3).filter("a < b").collect()}
    assert got == {("a", "b"): pytest.approx(0.4)}
    every = {(r.a, r.b): r.similarity for r in dag.similar_topics(t, t, -2.0).filter("a < b").collect()}
    assert len(every) == 6 and every["c", "d"] == pytest.approx(-0.6)
    x = F.struct(*t.columns)
    same = t.select(F.col("topic").alias("a"), x.alias("x")).crossJoin(t.select(F.col("topic").alias("b"), x.alias("y"))).filter("a < b")
    assert {(r.a, r.b): r.s for r in same.select("a", "b", dag.topic_similarity("x", "y").alias("s")).collect()} == pytest.approx(every)


def test_cooccurrence_of_a_large_memory(spark):
    members = spark.createDataFrame([("m", f"t{k:03}") for k in range(50)] + [("n", "t001"), ("n", "t002"), ("o", "t003")], "memory string, topic string")
    got = {(r.a, r.b): r.n_ab for r in assoc.cooccurrences(members, block=7).collect()}
    assert len(got) == 50 * 49 // 2 and got["t001", "t002"] == 2 and got["t001", "t003"] == 1
    assert got == {(r.a, r.b): r.n_ab for r in assoc.cooccurrences(members).collect()}


def test_split_and_merge_topics(spark):
    t = topics_frame(spark, [("a", "x", [1.0], None, ["k"]), ("b", "y", [1.0], None, ["m"]), ("c", "z", [1.0], None, None)]).withColumn("is_virtual", F.lit(False))
    links = spark.createDataFrame([("r", "a"), ("r", "b"), ("b", "c")], "parent string, child string")
    members = spark.createDataFrame([("b", k) for k in range(5)] + [("a", 9)], "topic string, memory int")
    topics, now, held = dag.split_topics(t, links, members, t.filter("topic = 'b'"), ["memory"])
    assert rows(topics, "topic") == [("a",), ("b/1",), ("b/2",), ("c",)]
    assert rows(now) == [("b/1", "c"), ("b/2", "c"), ("r", "a"), ("r", "b/1"), ("r", "b/2")]
    assert rows(held, "topic", "memory") == [("a", 9), ("b/1", 0), ("b/1", 1), ("b/2", 2), ("b/2", 3), ("b/2", 4)]
    topics, now, held = dag.merge_topics(t, links, members, spark.createDataFrame([("b", "a")], "topic string, into string"))
    assert rows(topics, "topic", "keywords") == [("a", ["k", "m"]), ("c", None)] or {r.topic: r.keywords for r in topics.collect()} == {"a": ["k", "m"], "c": None}
    assert rows(now) == [("a", "c"), ("r", "a")] and held.filter("topic = 'a'").count() == 6


def test_drift_of_keys_on_one_side(spark):
    side = lambda data: spark.createDataFrame(data, "k string, v string")
    got = {r.k: r.jsd for r in dag.drift(side([("a", "x"), ("b", "x")]), side([("a", "x"), ("c", "y")]), ["k"], "v").collect()}
    assert got == {"a": pytest.approx(0.0, abs=1e-9), "b": pytest.approx(0.6931, abs=1e-3), "c": pytest.approx(0.6931, abs=1e-3)}


def test_estimates_do_not_grow_through_cuts(spark):
    df = spark.createDataFrame([(k, k) for k in range(3)], "a int, b int")
    for _ in range(7):
        df = cut(df.join(df.withColumnRenamed("b", "c"), "a").select("a", "b"))
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63
    assert df.count() == 3 and cut(df) is df and cut(df.filter("a > 0")).count() == 2


def test_closed_form_is_the_limit(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 3.0), ("c", "x", 1.0)], "source string, target string, weight double")
    seeds = spark.createDataFrame([("q", "a", 1.0), ("q", "lone", 1.0), ("r", "b", 2.0)], "query string, node string, mass double")
    want = {(r.query, r.node): r.score for r in personalized_pagerank(edges, seeds, Settings(ppr_iterations=60, ppr_top_k=9), epsilon=0).collect()}
    got = {(r.query, r.node): r.score for r in closed_form(edges, seeds).collect()}
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-4) and got["q", "lone"] == pytest.approx(0.075)
    with pytest.raises(ValueError):
        closed_form(edges, seeds, most=2)


def test_token_chunks(spark):
    from mnemoweft.functions.tokens import load_encoding

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    text = "the garden of the house " * 30
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    got = [r.text for r in segment.token_chunks(d, "id", "text", path, 20).orderBy("chunk").collect()]
    assert "".join(got) == text and all(len(load_encoding(path).encode_ordinary(t)) <= 20 for t in got)
    assert [r.text for r in segment.token_chunks(d, "id", "text", path, -1).collect()] == [text]


def test_store_by_topic_and_results_by_sample(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), "n")
    store.write_by_topic(spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["y", None]), ("c", [])], "item string, topics array<string>"), 4)
    assert rows(store.by_topic(["x", "y"], 4), "item") == [("a",), ("b",)] and rows(store.by_topic(["x"], 4), "item") == [("a",)]
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "sample_id string, v int")
    write_json(df, str(tmp_path / "j"), "sample_id")
    write_json(df.filter("v = 2").withColumn("v", F.lit(5)), str(tmp_path / "j"), "sample_id")
    assert rows(spark.read.json(str(tmp_path / "j")), "sample_id", "v") == [("s1", 1), ("s2", 5)]


def test_evidence_by_id_or_likeness(spark):
    m = spark.createDataFrame([("m1", "s", ["D1"], [1.0, 0.0]), ("m2", "s", [], [0.0, 1.0]), ("m3", "t", ["D1"], [0.0, 1.0])], "item string, sample string, sources array<string>, vector array<double>")
    ev = spark.createDataFrame([(1, "s", "D1"), (1, "s", "D2")], "query int, sample string, dia string")
    tx = spark.createDataFrame([("s", "D2", [0.0, 1.0])], "sample string, dia string, vector array<double>")
    assert rows(evaluate.evidence_memories(m, ev, tx)) == [(1, "m1"), (1, "m2")]


def test_pagerank_in_tasks_and_by_joins(spark):
    r = random.Random(4)
    e = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}", r.random()) for _ in range(90)]
    edges = spark.createDataFrame(e, "source string, target string, weight double")
    seeds = spark.createDataFrame([(q, f"n{r.randrange(33)}", 1.0 + q) for q in range(12)] + [(3, "n1", 2.0)], "query int, node string, mass double")
    for eps in (0.0, 0.02):
        s = Settings(ppr_top_k=50)
        a, b = ({(x.query, x.node): x.score for x in personalized_pagerank(edges, seeds, s, eps, task_edges=n).collect()} for n in (10**5, 10))
        assert a == pytest.approx(b) and len(a) > 50


def test_mean_of_vectors(spark):
    df = spark.createDataFrame([("a", 1, [3.0, 0.0]), ("a", 1, [1.0, None]), ("a", 2, [0.0, 5.0]), (None, 1, [0.0, 2.0]), ("b", 1, None), ("b", 1, [])], "k string, g int, v array<double>").repartition(3)
    got = {(x.k, x.g): x.m for x in mean_vector(df, ["k", "g"], "v", "m").collect()}
    assert got == {("a", 1): [1.0, 0.0], ("a", 2): [0.0, 1.0], (None, 1): [0.0, 1.0]}


def random_topics(n):
    r = random.Random(n)
    some = lambda most, words: [f"{words}{r.randrange(12)}" for _ in range(r.randrange(most))]
    vector = lambda: r.choice([None, [0.0, 0.0, 0.0], *([r.gauss(0, 1) for _ in range(k)] for k in (3, 3, 3, 2))])
    return [(f"t{k:03}", r.choice([None, " ".join(some(4, "w"))]), vector(), vector(), r.choice([None, some(5, "k")])) for k in range(n)]


def test_pairs_in_blocks_write_nothing_per_pair_of_blocks(spark, monkeypatch):
    t = topics_frame(spark, random_topics(120))
    monkeypatch.setattr(search, "PART", 20)  # six blocks
    for least, unit in ((0.9, False), (0.4, True), (-2.0, False)):
        found = dag.similar_pairs(t, least, unit=unit)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        every = dag.similar_topics(t, t, float("-inf"), unit=unit).filter(f"a < b and similarity >= {least}")
        got, want = ({(x.a, x.b): x.similarity for x in df.collect()} for df in (found, every))
        assert got == pytest.approx(want, abs=1e-8) and len(want) > 20


def test_sibling_queries_keep_floats_and_shuffle_no_vectors_twice(spark, monkeypatch):
    from mnemoweft.plans import dag as plans

    asked = []
    pairs = dag.similar_pairs
    monkeypatch.setattr(plans.D, "similar_pairs", lambda t, *a, **k: asked.append((dict(t.dtypes)["label_vector"], k.get("unit"))) or pairs(t, *a, **k))
    links = plans.sibling_merge(spark, "/root/testdata/sf0.001")
    assert asked == [("array<float>", True)] and links.count() > 0


def test_clusters_of_floats_by_packed_blocks(spark, monkeypatch):
    found = []
    pairs = dag.similar_pairs
    monkeypatch.setattr(dag, "similar_pairs", lambda t, *a, **k: found.append(k["keyed"]) or pairs(t, *a, **k))
    t = topics_frame(spark, random_topics(60))
    floats = t.withColumns({c: F.col(c).cast("array<float>").cast("array<double>") for c in ("label_vector", "summary_vector")})
    raw = t.withColumns({c: F.col(c).cast("array<float>") for c in ("label_vector", "summary_vector")})
    unit = lambda c: F.when(F.size(c) > 0, normalise(F.col(c)))
    want, got = dag.cluster_topics(floats.withColumns({c: unit(c) for c in ("label_vector", "summary_vector")})), dag.cluster_topics(raw, unit=True)
    assert rows(got) == rows(want) != [] and found == [False, True] * 2
