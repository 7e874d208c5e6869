"""Whole graphs in one task, many at a time.

Graphs of at most ``SMALL`` edges are dealt by id and handed over as Arrow tables that hold each of them whole, so one
shuffle settles any number of them. What is larger is left to the callers' plans of joins, which have no such bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of a graph that a task takes as a whole (some 50 MB as strings).
SMALL = 200_000
#: Rows that a task gathers before it solves them.
GATHER = 200_000


def by_size(edges: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """The edges of graphs with at most ``small`` edges, and those of the others (None without any)."""
    large = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("graph_id")
    if not large.take(1):
        return edges, None
    return edges.join(large, "graph_id", "left_anti"), edges.join(large, "graph_id", "left_semi")


def solve(edges: DataFrame, f: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``f`` over tables of whole graphs, sorted by graph_id; a task holds ``GATHER`` rows and one graph more at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < GATHER:
                continue
            t = pa.Table.from_batches(held)
            ids = t.column("graph_id")
            last, at = ids[-1], t.num_rows - 1
            step = 1
            while at > 0 and ids[at - 1] == last:  # the last graph may go on: gallop to its first row
                back = max(0, at - step)
                at, step = (back, step * 2) if ids[back] == last else (at - 1, 1)
            if at:
                yield from f(t.slice(0, at))
                held, n = t.slice(at).to_batches(), t.num_rows - at
        if n:
            yield from f(pa.Table.from_batches(held))

    return edges.repartition("graph_id").sortWithinPartitions("graph_id").mapInArrow(run, schema)


def numbered(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of a table of edges: source and sink as node numbers, the graph number of each node, and the graphs' ids."""
    graph = t.column("graph_id").combine_chunks().dictionary_encode()
    at = graph.indices.to_numpy()
    names = pa.concat_arrays([*t.column("source_id").chunks, *t.column("sink_id").chunks]).dictionary_encode()
    width = len(names.dictionary)
    keys, node = np.unique(np.concatenate([at, at]).astype(np.int64) * width + names.indices.to_numpy(), return_inverse=True)
    return node[: len(at)], node[len(at) :], keys // width, graph.dictionary


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes is joined to by the edges (a, b), in either direction."""
    parent = np.arange(n)
    while True:
        while (parent != (up := parent[parent])).any():
            parent = up
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])


def on_cycles(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which nodes are left when those without an edge into them are taken away, again and again: any is a sign of a cycle."""
    order = np.argsort(a, kind="stable")
    targets, first = b[order], np.searchsorted(a[order], np.arange(n + 1))
    into = np.bincount(b, minlength=n)
    left = np.ones(n, dtype=bool)
    front = np.flatnonzero(into == 0)
    while len(front):
        left[front] = False
        many = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.concatenate([[0], many.cumsum()[:-1]]), many) + np.arange(many.sum())
        hit, times = np.unique(targets[at], return_counts=True)
        into[hit] -= times
        front = hit[into[hit] == 0]
    return left
