"""Parent-child links to full hierarchies: paths, depths, tops, descendants and cycles."""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweft.operators.components import TASK_LINKS, connected_components, encode
from mnemoweft.runtime import cut, iter_groups, parallelism, with_dense_codes

CHUNK = 50_000  # links of small components that are walked together
WHITE, GREY, BLACK = 0, 1, 2


def links_of(nodes: DataFrame, id: str, parents: str, children: str) -> DataFrame:
    """parent, child from lists on either side; nulls and repeated links are dropped."""
    up = nodes.select(F.explode(parents).alias("parent"), F.col(id).alias("child"))
    down = nodes.select(F.col(id).alias("parent"), F.explode(children).alias("child"))
    return clean_links(up.unionByName(down), "parent", "child")


def clean_links(links: DataFrame, parent: str, child: str) -> DataFrame:
    return links.select(F.col(parent).alias("parent"), F.col(child).alias("child")).filter("parent is not null and child is not null").distinct()


def back_links(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the links a -> b (sorted by a, b) that close a cycle in a depth-first traversal.

    Nodes 0 .. n - 1 are coloured; roots and children are taken in their order.  Some 20 bytes a
    link and a node.
    """
    ends = memoryview(np.searchsorted(a, np.arange(1, n + 1)).astype(np.int64))
    at = memoryview(np.searchsorted(a, np.arange(n)).astype(np.int64))  # the next link to follow
    heads = memoryview(np.ascontiguousarray(b, np.int64))
    colour, back = bytearray(n), array("q")
    for root in range(n):
        if colour[root] != WHITE:
            continue
        colour[root] = GREY
        path = array("q", [root])
        while path:
            v = path[-1]
            k = at[v]
            if k == ends[v]:
                colour[v] = BLACK
                path.pop()
                continue
            at[v] = k + 1
            w = heads[k]
            if colour[w] == WHITE:
                colour[w] = GREY
                path.append(w)
            elif colour[w] == GREY:
                back.append(k)
    return np.array(back, np.int64)


class Walk:
    """Iterative depth-first traversal of some whole components."""

    def __init__(self, table: pa.Table):
        self.ids, a, b = encode(table["parent"].combine_chunks(), table["child"].combine_chunks())
        self.n = len(self.ids)
        order = np.lexsort((b, a))
        self.a, self.b = a[order], b[order]
        starts = np.searchsorted(self.a, np.arange(self.n + 1)).tolist()
        heads = self.b.tolist()
        self.children = [heads[starts[k] : starts[k + 1]] for k in range(self.n)]
        self.scc = self._components()

    def _components(self):
        index, low = [-1] * self.n, [0] * self.n
        scc, stack, clock = [-1] * self.n, [], 0
        for root in range(self.n):
            if index[root] >= 0:
                continue
            path = [root]
            at = [0]
            index[root] = low[root] = clock
            clock += 1
            stack.append(root)
            while path:
                v = path[-1]
                if at[-1] < len(self.children[v]):
                    w = self.children[v][at[-1]]
                    at[-1] += 1
                    if index[w] < 0:
                        index[w] = low[w] = clock
                        clock += 1
                        stack.append(w)
                        path.append(w)
                        at.append(0)
                        continue
                    if scc[w] < 0:
                        low[v] = min(low[v], index[w])
                    continue
                path.pop()
                at.pop()
                if path:
                    low[path[-1]] = min(low[path[-1]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        members.append(w)
                        if w == v:
                            break
                    name = min(members)
                    for w in members:
                        scc[w] = name
        return np.array(scc, np.int64)

    def cyclic(self) -> np.ndarray:
        """Whether each node lies on a cycle."""
        sizes = np.bincount(self.scc, minlength=self.n)
        on = sizes[self.scc] > 1
        on[self.a[self.a == self.b]] = True
        return on

    def tops(self) -> list[int]:
        """Nodes without a parent; of cycles that no link enters, the smallest node."""
        inner = self.scc[self.a] == self.scc[self.b]
        entered = np.zeros(self.n, bool)
        entered[self.scc[self.b[~inner]]] = True
        return np.flatnonzero((self.scc == np.arange(self.n)) & ~entered).tolist()

    def below(self, start: int):
        """(node, distance, previous) breadth first; start itself last, if a cycle leads back to it."""
        distance = {start: 0}
        level, d, again = [start], 0, None
        while level:
            d += 1
            step: dict[int, int] = {}
            for v in level:
                for w in self.children[v]:
                    if w not in distance:
                        if v < step.get(w, self.n):
                            step[w] = v
                    elif w == start and again is None:
                        again = (start, d, v)
            for w in sorted(step):
                distance[w] = d
                yield w, d, step[w]
            level = list(step)
        if again:
            yield again


def _chunks(batches, keys: list[str]):
    """Tables of whole groups, of about CHUNK rows or one larger group."""
    held, rows = [], 0
    for g in iter_groups(batches, keys):
        if held and rows + g.num_rows > CHUNK:
            yield pa.concat_tables(held)
            held, rows = [], 0
        held.append(g)
        rows += g.num_rows
    if held:
        yield pa.concat_tables(held)


def _cycles(batches):
    for t in _chunks(batches, ["component"]):
        w = Walk(t)
        at = np.flatnonzero(w.cyclic())
        yield pa.RecordBatch.from_arrays([w.ids.take(pa.array(at)), w.ids.take(pa.array(w.scc[at]))], names=["node", "cycle"])


def _back_edges(batches):
    for t in _chunks(batches, ["component"]):
        w = Walk(t)
        inner = w.scc[w.a] == w.scc[w.b]
        a, b = w.a[inner], w.b[inner]
        at = back_links(w.n, a, b)
        yield pa.RecordBatch.from_arrays([w.ids.take(pa.array(x[at])) for x in (a, b)], names=["parent", "child"])


def _back_codes(batches):
    """The same for whole strongly connected components (cycle, a, b) with dense codes in place of ids."""
    for t in iter_groups(batches, ["cycle"]):
        a, b = (t[c].to_numpy() for c in ("a", "b"))
        low = min(a.min(), b.min())
        order = np.lexsort((b, a))
        a, b = a[order] - low, b[order] - low
        at = back_links(int(max(a.max(), b.max())) + 1, a, b)
        yield pa.RecordBatch.from_arrays([pa.array(x[at] + low) for x in (a, b)], names=["a", "b"])


def _descendants(batches):
    for t in _chunks(batches, ["component", "slot"]):
        slots = t["slots"][0].as_py()
        slot = t["slot"][0].as_py()
        w = Walk(t)
        rows: list[tuple[int, int, int]] = []

        def out():
            x = np.array(rows, np.int64).reshape(-1, 3)  # noqa: B023
            rows.clear()  # noqa: B023
            ids = [w.ids.take(pa.array(x[:, k])) for k in (0, 1)]  # noqa: B023
            return pa.RecordBatch.from_arrays([*ids, pa.array(x[:, 2])], names=["ancestor", "descendant", "distance"])

        for v in range(w.n):
            if slots > 1 and v % slots != slot:
                continue
            rows += [(v, x, d) for x, d, _ in w.below(v)]
            if len(rows) > 100_000:
                yield out()
        yield out()


def _paths(batches):
    for t in _chunks(batches, ["component"]):
        w = Walk(t)
        nodes, tops, ways = array("q"), array("q"), array("q")  # ways: paths one after the other
        ends = array("q", [0])

        def out():
            take = lambda v: w.ids.take(pa.array(np.array(v, np.int64)))  # noqa: B023, E731
            paths = pa.ListArray.from_arrays(pa.array(np.array(ends), pa.int32()), take(ways))  # noqa: B023
            depth = pa.array(np.diff(np.array(ends)) - 1, pa.int32())  # noqa: B023
            batch = pa.RecordBatch.from_arrays([take(nodes), take(tops), depth, paths], names=["node", "top", "depth", "path"])  # noqa: B023
            for held in (nodes, tops, ways, ends):  # noqa: B023
                del held[:]
            ends.append(0)  # noqa: B023
            return batch

        for top in w.tops():
            before = {top: -1}  # only predecessors are kept; a path is written when its node is met
            for x, _, previous in chain([(top, 0, -1)], w.below(top)):
                if x == top and previous >= 0:
                    continue
                before[x] = previous
                way = [x]
                while (previous := before[way[-1]]) >= 0:
                    way.append(previous)
                way.reverse()
                ways.extend(way)
                nodes.append(x)
                tops.append(top)
                ends.append(len(ways))
                if len(ways) > 500_000:
                    yield out()
        yield out()


class Hierarchy:
    """The hierarchy of parent-child links of unknown depth, several parents and cycles allowed.

    links has a parent and a child column (ids of one type).  Rows with a null end are ignored, repeated
    links count once, a node naming itself is a cycle of one; nodes need no row of their own, further
    columns are not read, an empty table gives empty results.  nodes has a column node; those of it
    without a link are tops of their own in paths() and occur nowhere else.

    Connected components are found, each is co-located in one task and walked depth first with node
    colouring; small ones share tasks.  A component of more than task_links links is never gathered:
    its cycles come from trimming and colour propagation and its paths and descendants from joins of the
    links with a growing frontier, one round per level.  Both give the same rows.
    """

    def __init__(self, links: DataFrame, parent: str = "parent", child: str = "child", task_links: int = TASK_LINKS, nodes: DataFrame | None = None):
        self.task_links = task_links
        self.nodes = nodes
        self.spark = links.sparkSession
        self.links = cut(clean_links(links, parent, child))
        self.kind = dict(self.links.dtypes)["parent"]
        if self.links.limit(task_links + 1).count() <= task_links:
            # all components fit a task: those of one task are told apart there, too
            names = connected_components(self.links, "parent", "child", task_links)
            self._small, self._large = self._named(names), None
            return
        named = cut(self._named(connected_components(self.links, "parent", "child", task_links)))
        sizes = named.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > task_links).select("component")
        self._small = named.join(sizes, "component", "left_anti")
        self._large = named.join(sizes, "component", "left_semi")

    def _named(self, names: DataFrame) -> DataFrame:
        return self.links.join(names.select(F.col("node").alias("parent"), "component"), "parent").select("parent", "child", "component")

    def _located(self, links: DataFrame) -> DataFrame:
        return links.repartition(parallelism(self.spark), "component").sortWithinPartitions("component")

    def cycles(self) -> DataFrame:
        """node, cycle: the nodes that are their own ancestors and the smallest node they share circles with."""
        out = self._located(self._small).mapInArrow(_cycles, f"node {self.kind}, cycle {self.kind}")
        return out if self._large is None else out.unionByName(self._large_cycles())

    def back_edges(self) -> DataFrame:
        """parent, child of the links that close a cycle in the traversal; without them there is none.

        Each strongly connected component is walked depth first by the links within it, from its smallest
        node, children in the order of their ids.  A component beyond task_links is taken apart without
        gathering it; each strongly connected component of it is then walked in one task by
        numbers in the order of the ids, whatever its size, as depth-first order cannot be divided.
        """
        out = self._located(self._small).mapInArrow(_back_edges, f"parent {self.kind}, child {self.kind}")
        if self._large is None:
            return out
        c = cut(self._large_cycles())
        inner = (
            self._large.join(c.select(F.col("node").alias("parent"), F.col("cycle").alias("x")), "parent")
            .join(c.select(F.col("node").alias("child"), F.col("cycle").alias("y")), "child")
            .filter("x = y")
        )
        codes = cut(with_dense_codes(c, ["cycle", "node"]))
        number = lambda end, name: codes.select(F.col("node").alias(end), F.col("code").alias(name))
        first = codes.groupBy("cycle").agg(F.min("code").alias("first"))
        coded = inner.select("parent", "child", F.col("x").alias("cycle")).join(first, "cycle").join(number("parent", "a"), "parent").join(number("child", "b"), "child")
        coded = coded.select(F.col("first").alias("cycle"), "a", "b").repartition(parallelism(self.spark), "cycle").sortWithinPartitions("cycle")
        back = coded.mapInArrow(_back_codes, "a long, b long")
        return out.unionByName(back.join(number("parent", "a"), "a").join(number("child", "b"), "b").select("parent", "child"))

    def descendants(self) -> DataFrame:
        """ancestor, descendant, distance (of the shortest way) of all pairs; a node on a cycle is its own."""
        sizes = self._small.groupBy("component").agg(F.count("*").alias("n"))
        most = parallelism(self.spark)
        slots = F.least(F.lit(most), F.ceil(F.col("n") / CHUNK)).cast("int")
        spread = self._small.join(sizes, "component").select("component", "parent", "child", slots.alias("slots"))
        spread = spread.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        # a component's sources are dealt to several tasks, each with the component's links
        out = (
            spread.repartition(most, "component", "slot")
            .sortWithinPartitions("component", "slot")
            .mapInArrow(_descendants, f"ancestor {self.kind}, descendant {self.kind}, distance long")
        )
        return out if self._large is None else out.unionByName(self._large_descendants())

    def paths(self) -> DataFrame:
        """node, top, depth, path: a row per node and top above it, with the shortest path from there.

        A top is a node without a parent or, of a cycle that no link enters, its smallest node.  Of
        equally short paths that through the smallest previous node is taken; a top has depth 0.
        """
        out = self._located(self._small).mapInArrow(_paths, f"node {self.kind}, top {self.kind}, depth int, path array<{self.kind}>")
        if self._large is not None:
            out = out.unionByName(self._large_paths())
        if self.nodes is None:
            return out
        linked = self.links.select(F.col("parent").alias("node")).union(self.links.select("child"))
        lone = self.nodes.select("node").filter("node is not null").distinct().join(linked, "node", "left_anti")
        return out.unionByName(lone.select("node", F.col("node").alias("top"), F.lit(0).alias("depth"), F.array("node").alias("path")))

    # --- components beyond one task: one join per level, lineage cut each time

    def _grow(self, links: DataFrame, seeds: DataFrame, carry) -> DataFrame:
        """Breadth-first rows (source, node, distance, ...) from seeds until nothing new comes.

        Each level is written once; what was found before is read, not written again.
        """
        seen = frontier = cut(seeds)
        while True:
            step = carry(frontier.join(links.select(F.col("parent").alias("node"), "child"), "node"))
            frontier = cut(step.join(seen.select("source", "node"), ["source", "node"], "left_anti"))
            if frontier.isEmpty():
                return seen
            seen = seen.unionByName(frontier)

    def _large_descendants(self) -> DataFrame:
        links = self._large.select("parent", "child")
        seeds = links.select(F.col("parent").alias("source"), F.col("child").alias("node"), F.lit(1).cast("long").alias("distance"))

        def carry(j):
            return j.select("source", F.col("child").alias("node"), (F.col("distance") + 1).alias("distance")).distinct()

        return self._grow(links, seeds, carry).select(F.col("source").alias("ancestor"), F.col("node").alias("descendant"), "distance")

    def _large_paths(self) -> DataFrame:
        links = self._large.select("parent", "child")
        cyclic = cut(self._large_cycles())
        inside = links.join(cyclic.select(F.col("node").alias("parent"), F.col("cycle").alias("x")), "parent", "left").join(
            cyclic.select(F.col("node").alias("child"), F.col("cycle").alias("y")), "child", "left"
        )
        outer = inside.filter(~(F.coalesce(F.col("x") == F.col("y"), F.lit(False))) & (F.col("parent") != F.col("child")))
        entered = outer.select(F.coalesce("y", "child").alias("top")).distinct()
        every = links.select(F.col("parent").alias("node")).union(links.select("child")).distinct()
        tops = every.join(cyclic, "node", "left").select(F.coalesce("cycle", "node").alias("top")).distinct().join(entered, "top", "left_anti")
        seeds = tops.select(F.col("top").alias("source"), F.col("top").alias("node"), F.array("top").alias("path"))

        def carry(j):
            way = F.min_by(F.col("path"), F.col("node"))
            return j.groupBy("source", "child").agg(way.alias("path")).select("source", F.col("child").alias("node"), F.concat("path", F.array("child")).alias("path"))

        rows = self._grow(links, seeds, carry)
        return rows.select("node", F.col("source").alias("top"), (F.size("path") - 1).alias("depth"), "path")

    def _trim(self, links: DataFrame) -> DataFrame:
        """links without those of nodes that have no way in or no way out, again and again."""
        links, n = cut(links), -1
        while (m := links.count()) != n:
            n = m
            kept = links.join(links.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
            links = cut(kept.join(links.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child"))
        return links

    def _large_cycles(self) -> DataFrame:
        schema = f"node {self.kind}, cycle {self.kind}"
        out = self.spark.createDataFrame([], schema)
        rest = self._trim(self._large.select("parent", "child"))
        while not rest.isEmpty():
            names = connected_components(rest, "parent", "child", self.task_links)
            named = cut(rest.join(names.select(F.col("node").alias("parent"), "component"), "parent").select("parent", "child", "component"))
            large = named.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > self.task_links).select("component")
            out = out.unionByName(self._located(named.join(large, "component", "left_anti")).mapInArrow(_cycles, schema))
            rest = cut(named.join(large, "component", "left_semi").select("parent", "child"))
            if rest.isEmpty():
                break
            colours = self._spread_colours(rest)
            ends = rest.join(colours.select(F.col("node").alias("parent"), F.col("colour").alias("x")), "parent").join(
                colours.select(F.col("node").alias("child"), F.col("colour").alias("y")), "child"
            )
            # back from each colour's own node within the colour: its strongly connected component
            same = cut(ends.filter("x = y").select(F.col("child").alias("parent"), F.col("parent").alias("child")))
            seeds = colours.filter("node = colour").select(F.col("colour").alias("source"), "node")
            found = self._grow(same, seeds, lambda j: j.select("source", F.col("child").alias("node")).distinct())
            sizes = found.groupBy("source").agg(F.count("*").alias("n"), F.min("node").alias("cycle"))
            loops = rest.filter("parent = child").select(F.col("parent").alias("node"), F.lit(True).alias("loop"))
            real = found.join(sizes, "source").join(loops, "node", "left").filter("n > 1 or loop")
            out = cut(out.unionByName(real.select("node", "cycle")))
            gone = found.select("node")
            left = rest.join(gone.select(F.col("node").alias("parent")), "parent", "left_anti").join(gone.select(F.col("node").alias("child")), "child", "left_anti")
            rest = self._trim(left.select("parent", "child"))
        return out

    def _spread_colours(self, links: DataFrame) -> DataFrame:
        """node, colour: the largest node that leads to it."""
        every = links.select(F.col("parent").alias("node")).union(links.select("child")).distinct()
        colours = cut(every.withColumn("colour", F.col("node")))
        while True:
            come = links.join(colours.withColumnRenamed("node", "parent"), "parent").groupBy(F.col("child").alias("node")).agg(F.max("colour").alias("come"))
            new = cut(colours.join(come, "node", "left").select("node", F.greatest("colour", F.coalesce("come", "colour")).alias("colour"), (F.col("come") > F.col("colour")).alias("grew")))
            colours = new.select("node", "colour")
            if new.filter("grew").isEmpty():
                return colours
