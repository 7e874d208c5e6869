"""Bubbles: pairs of different walks with common ends.

Two kinds of pairs start at a node with two successors or more, its *forks*.

* For two forks, breadth-first searches from either take turns, a node each per round, the newest edges first. The first
  round in which a search takes a node that the other has discovered ends the pair. Until then neither search knows of
  the other, so each is one table per fork, made once: the order in which nodes are taken, and after how many rounds each
  was discovered. The round at which a pair ends is then a comparison of two tables.
* For a fork and the other ways to it: the nodes that a breadth-first search from the other forks reaches without
  passing a fork are ranked by discovery, and every walk along rising ranks from another fork to this one counts.

Read support isn't considered, and the walks of a pair may share inner nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BUBBLE_ROUNDS
from ..schema import GraphSet
from . import wholes

_SCHEMA = pa.schema([("graph_id", pa.string()), ("path1", pa.list_(pa.string())), ("path2", pa.list_(pa.string()))])
#: Pairs in an output batch.
BATCH = 5000


class Search:
    """A breadth-first search: ``taken`` nodes in order, ``known`` after how many of them a node is discovered, and ``via`` which."""

    def __init__(self, successors: dict[str, list[str]], start: str, rounds: int | None):
        self.taken, self.known, self.via = [start], {start: 0}, {}
        for i, node in enumerate(self.taken):  # grows as it goes
            if i == rounds:
                break
            for nxt in successors.get(node, ()):
                if nxt not in self.known:
                    self.known[nxt], self.via[nxt] = i + 1, node
                    self.taken.append(nxt)
        if rounds is not None:
            del self.taken[rounds:]

    def walk(self, node: str) -> list[str]:
        out = [node]
        while out[-1] in self.via:
            out.append(self.via[out[-1]])
        return out[::-1]

    def first(self, other: Search, ahead: int) -> int | None:
        """The first round whose node the other search has discovered, ``ahead`` rounds later."""
        return next((r for r, node in enumerate(self.taken) if other.known.get(node, r + ahead + 1) <= r + ahead), None)


def meetings(one: Search, two: Search) -> list[str]:
    """The nodes at which two searches meet, ``one`` taking its turn first; at most one each."""
    x, y = one.first(two, 0), two.first(one, 1)
    if x is None and y is None:
        return []
    if y is None or (x is not None and x <= y):
        out = [one.taken[x]]
        # in that round the first search didn't go on, so the second knows what was there before
        if x < len(two.taken) and one.known.get(two.taken[x], x + 1) <= x and two.taken[x] not in out:
            out.append(two.taken[x])
        return out
    return [two.taken[y]]


def detours(successors: dict[str, list[str]], source: str, target: str) -> Iterator[list[str]]:
    """The walks from ``source`` to its successor ``target`` that start at another successor and pass no further one."""
    forks = successors[source]
    ranked = {n: i for i, n in enumerate(n for n in forks if n not in (source, target))}
    closed = {source, *forks}
    before: dict[str, list[str]] = {}
    todo = list(ranked)
    for node in todo:
        for nxt in successors.get(node, ()):
            if nxt not in closed and nxt not in ranked:
                ranked[nxt] = len(ranked)
                todo.append(nxt)
            if nxt == target or (nxt not in closed and ranked[nxt] > ranked[node]):
                before.setdefault(nxt, []).append(node)
    walks = [[target]]  # backwards
    while walks:
        walk = walks.pop()
        for node in before.get(walk[-1], ()):
            if node in closed:
                yield [source, node, *walk[::-1]]
            else:
                walks.append([*walk, node])


def pairs(successors: dict[str, list[str]], rounds: int | None = BUBBLE_ROUNDS) -> Iterator[tuple[list[str], list[str]]]:
    """The pairs of one graph; ``successors``: distinct, the newest edge's first. ``rounds`` None searches to the end."""
    searches: dict[str, Search] = {}
    for source, forks in successors.items():
        if len(forks) < 2:
            continue
        for i, a in enumerate(forks):
            for b in forks[i + 1 :]:
                one, two = (searches.get(n) or searches.setdefault(n, Search(successors, n, rounds)) for n in (a, b))
                for node in meetings(one, two):
                    x, y = [source, *one.walk(node)], [source, *two.walk(node)]
                    if min(len(x), len(y)) >= 3 and x != y:
                        yield x, y
        for target in forks:
            for way in detours(successors, source, target):
                yield [source, target], way


def bubbles(g: GraphSet, only: DataFrame | None = None, rounds: int | None = BUBBLE_ROUNDS) -> DataFrame:
    """(graph_id, path1, path2): the pairs of every graph, or of those in ``only`` (graph_id), as arrays of node ids.

    The searches depend on the order of edges, so a graph's edges meet in one task; only graphs with a node of two
    successors or more are sent there. Pairs are returned as they are found.
    """
    edges = g.edges.select("graph_id", "ord", "source_id", "sink_id")
    if only is not None:
        edges = edges.join(only.select("graph_id"), "graph_id", "left_semi")
    forked = edges.groupBy("graph_id", "source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("graph_id").distinct()

    def search(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.sort_by([("graph_id", "ascending"), ("ord", "descending")])
        held: list[tuple] = []
        graph, out = None, {}

        def found() -> Iterator[tuple]:
            for p in pairs({a: list(x) for a, x in out.items()}, rounds):
                yield graph, *p

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

        ends = zip(*(t.column(c).to_pylist() for c in ("graph_id", "source_id", "sink_id")), strict=True)
        for gid, a, b in [*ends, (None, None, None)]:
            if gid != graph:
                for row in found():
                    held.append(row)
                    if len(held) >= BATCH:
                        yield flush()
                        held = []
                graph, out = gid, {}
            out.setdefault(a, {}).setdefault(b)
        if held:
            yield flush()

    return wholes.solve(edges.join(forked, "graph_id", "left_semi"), search, "graph_id string, path1 array<string>, path2 array<string>")
