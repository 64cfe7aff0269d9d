"""Hierarchy against brute force, in one task per component and beyond it."""

import itertools
import random
from collections import defaultdict, deque

import pytest

from mnemoweft.operators.components import connected_components
from mnemoweft.operators.hierarchy import Hierarchy, links_of


def random_links(seed, n=40, m=55):
    r = random.Random(seed)
    links = {(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(m)}
    chain = {(f"c{k:02}", f"c{k + 1:02}") for k in range(12)}
    return sorted(links | chain | {("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x3", "y"), ("s", "s")})


def reach(links):
    children = defaultdict(set)
    for p, c in links:
        children[p].add(c)
    out = {}
    for v in {x for e in links for x in e}:
        dist, queue = {}, deque([(v, 0)])
        while queue:
            x, d = queue.popleft()
            for y in children[x]:
                if y not in dist:
                    dist[y] = d + 1
                    queue.append((y, d + 1))
        out[v] = dist
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seed", "bound"), [(1, 10**6), (1, 6), (2, 10**6), (3, 20)])
def test_against_brute_force(spark, seed, bound):
    links = random_links(seed)
    h = Hierarchy(spark.createDataFrame(links, "parent string, child string"), task_links=bound)
    down = reach(links)
    assert rows(h.descendants()) == sorted((a, d, n) for a in down for d, n in down[a].items())
    cyclic = {v for v in down if v in down[v]}
    assert rows(h.cycles()) == sorted((v, min({v} | {w for w in cyclic if w in down[v] and v in down[w]})) for v in cyclic)
    back = set(rows(h.back_edges()))
    assert back <= set(links)
    assert all(v not in d for v, d in reach([e for e in links if e not in back]).items())
    up = {v: {a for a in down if v in down[a]} for v in down}
    tops = {v for v in down if all(a in down[v] for a in up[v]) and (v not in cyclic or v == min(a for a in up[v] | {v}))}
    paths = rows(h.paths())
    want = {(v, t): (0 if v == t else down[t][v]) for t in tops for v in {t, *down[t]}}
    assert {(v, t): d for v, t, d, _ in paths} == want
    assert len(paths) == len(want)
    for v, t, d, path in paths:
        assert path[0] == t and path[-1] == v and len(path) == d + 1
        assert all(e in set(links) for e in itertools.pairwise(path))


def test_both_ways_agree_on_paths(spark):
    df = spark.createDataFrame(random_links(7), "parent string, child string")
    assert rows(Hierarchy(df).paths()) == rows(Hierarchy(df, task_links=5).paths())


def test_dirty_links(spark):
    data = [("a", None, ["b", None, "b"], 1), ("b", ["a", "ghost"], None, 2), (None, ["a"], [], 3), ("lone", [], [], 4)]
    nodes = spark.createDataFrame(data, "id string, up array<string>, down array<string>, parent int")
    assert rows(links_of(nodes, "id", "up", "down")) == [("a", "b"), ("ghost", "b")]
    empty = Hierarchy(spark.createDataFrame([], "parent string, child string"))
    assert rows(empty.cycles()) == rows(empty.paths()) == rows(empty.descendants()) == rows(empty.back_edges()) == []


def test_hub_and_long_chain(spark):
    links = [("hub", f"k{i}") for i in range(3000)] + [(f"d{i:04}", f"d{i + 1:04}") for i in range(600)] + [("hub", "d0000")]
    h = Hierarchy(spark.createDataFrame(links, "parent string, child string"))
    assert h.paths().agg({"depth": "max"}).first()[0] == 601
    assert h.descendants().filter("ancestor = 'hub'").count() == 3601
    assert h.cycles().count() == 0


@pytest.mark.parametrize("bound", [10**6, 10])
def test_components(spark, bound):
    links = [(f"a{i}", f"a{i + 1}") for i in range(40)] + [(f"b{i}", "b") for i in range(30)] + [("z", "z"), (None, "q")]
    got = connected_components(spark.createDataFrame(links, "x string, y string"), "x", "y", bound)
    groups = defaultdict(set)
    for r in got.collect():
        groups[r.component].add(r.node)
    assert sorted(map(len, groups.values())) == [1, 31, 41]
    assert all(c in g for c, g in groups.items())


@pytest.mark.parametrize("bound", [10**6, 2])
def test_nodes_without_a_link_are_their_own_tops(spark, bound):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d")], "parent string, child string")
    nodes = spark.createDataFrame([("a",), ("lone",), ("lone",), ("c",), (None,)], "node string")
    h = Hierarchy(links, task_links=bound, nodes=nodes)
    paths = rows(h.paths())
    assert [p for p in paths if p[0] == "lone"] == [("lone", "lone", 0, ["lone"])]
    assert len(paths) == 5 and all(t == "a" for v, t, _, _ in paths if v != "lone")
    alone = Hierarchy(links.limit(0), nodes=nodes.limit(2))
    assert rows(alone.paths()) == [("a", "a", 0, ["a"]), ("lone", "lone", 0, ["lone"])]


def test_every_topic_has_a_path(spark, tmp_path):
    from mnemoweft.plans.hierarchies import p1_paths

    data = [("r", None, ["x"], 1), ("x", ["r"], None, 1), ("lone", [], None, 1), ("lone", None, None, 2)]
    spark.createDataFrame(data, "topic_id string, parent_ids array<string>, child_ids array<string>, updated_at int").write.parquet(f"{tmp_path}/topics.parquet")
    assert rows(p1_paths(spark, str(tmp_path)).select("node", "depth")) == [("lone", 0), ("r", 0), ("x", 1)]


def test_both_ways_agree_on_back_edges(spark):
    links = random_links(11, n=30, m=75)
    ring = [(f"r{k:02}", f"r{(k * 7 + 1) % 20:02}") for k in range(20)] + [(f"r{k:02}", f"r{(k + 1) % 20:02}") for k in range(20)]
    df = spark.createDataFrame(links + ring, "parent string, child string")
    want = rows(Hierarchy(df).back_edges())
    assert want and want == rows(Hierarchy(df, task_links=5).back_edges()) == rows(Hierarchy(df, task_links=50).back_edges())
