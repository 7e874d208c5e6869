"""Read-supported path enumeration: all source-to-sink walks whose nodes share a read, over all graphs in one plan.

A state is a partial walk with the reads that all its nodes share. Each round joins the frontier with the steps out of
its nodes and intersects the reads; states at sinks are paths. Steps are cut beforehand to edges whose ends share a read,
which can't lose a path; sources and sinks are those of the whole graph. Read identities don't matter: a walk that the
look-ahead for inner reads would drop is one that loses its reads before a sink anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import path_identifier
from ..functions.intervals import read_ids
from ..schema import GraphSet
from ..storage import materialise


class SupportedCycle(ValueError):
    """A cycle whose nodes share a read: its walks have no end."""


def ends(g: GraphSet) -> DataFrame:
    """(graph_id, node_id, ord, ids, is_source, is_sink) of every node; ``ids``: its distinct reads."""
    into = g.edges.select("graph_id", F.col("sink_id").alias("node_id")).distinct().withColumn("has_in", F.lit(True))
    out = g.edges.select("graph_id", F.col("source_id").alias("node_id")).distinct().withColumn("has_out", F.lit(True))
    return g.nodes.select("graph_id", "node_id", "ord", read_ids(F.col("reads")).alias("ids")).join(into, ["graph_id", "node_id"], "left").join(
        out, ["graph_id", "node_id"], "left").select(
        "graph_id", "node_id", "ord", "ids", F.col("has_in").isNull().alias("is_source"), F.col("has_out").isNull().alias("is_sink"))


def steps(g: GraphSet, node: DataFrame) -> DataFrame:
    """The edges whose ends share a read, with the sink's reads."""
    a = node.select("graph_id", F.col("node_id").alias("source_id"), F.col("ids").alias("a"))
    b = node.select("graph_id", F.col("node_id").alias("sink_id"), F.col("ids").alias("next_ids"), F.col("is_sink").alias("next_is_sink"))
    return g.edges.select("graph_id", "edge_id", "ord", "source_id", "sink_id").join(a, ["graph_id", "source_id"]).join(b, ["graph_id", "sink_id"]).where(
        F.arrays_overlap("a", "next_ids")).select("graph_id", F.col("source_id").alias("node_id"), "sink_id", "edge_id", F.col("ord").alias("edge_ord"), "next_ids", "next_is_sink")


def traverse(g: GraphSet, max_depth: int | None = None) -> DataFrame:
    """graph_id, path_ord, path_id, nodes, edges, reads of every path.

    Paths of a graph come by source, then by length, then by their edges, the newest first. A supported cycle raises,
    unless ``max_depth`` bounds the nodes of a walk.
    """
    node = materialise(ends(g), "ends")
    step = materialise(steps(g, node), "steps")
    empty = F.array().cast("array<string>")
    front = node.where(F.col("is_source") & (F.size("ids") > 0)).select(
        "graph_id", "node_id", "is_sink", F.col("ord").alias("source_ord"), F.array("node_id").alias("nodes"), empty.alias("edges"),
        F.array().cast("array<bigint>").alias("order"), F.col("ids").alias("reads"))
    done, depth = [], 1
    while True:
        done.append(front.where("is_sink"))
        if max_depth is not None and depth >= max_depth:
            break
        active = F.array_intersect("reads", "next_ids")
        nxt = front.where("not is_sink").join(step, ["graph_id", "node_id"]).withColumn("active", active).where(F.size("active") > 0).select(
            "graph_id", F.col("sink_id").alias("node_id"), F.col("next_is_sink").alias("is_sink"), "source_ord",
            F.concat("nodes", F.array("sink_id")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"),
            F.concat("order", F.array(-F.col("edge_ord"))).alias("order"), F.col("active").alias("reads"),
            F.array_contains("nodes", F.col("sink_id")).alias("again"))
        nxt = materialise(nxt, f"front-{depth}")
        state = nxt.agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).first()
        if not state["n"]:
            break
        if state["again"] and max_depth is None:
            raise SupportedCycle("a cycle is supported by a common read; give max_depth to bound its walks")
        front, depth = nxt.drop("again"), depth + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    order = Window.partitionBy("graph_id").orderBy("source_ord", F.size("nodes"), "order")
    return out.select("graph_id", (F.row_number().over(order) - 1).cast("bigint").alias("path_ord"), path_identifier(F.col("nodes")).alias("path_id"), "nodes", "edges", "reads")


def traverse_by_id(g: GraphSet, graph_id: str, max_depth: int | None = None) -> DataFrame:
    from .lookups import graph

    return traverse(graph(g, graph_id), max_depth)


def read_first_paths(g: GraphSet, max_depth: int | None = None) -> DataFrame:
    """The same paths found read by read: walks in each read's subgraph, then grouped by walk. Cheaper on branching graphs.

    graph_id, nodes, n_reads. As in :func:`traverse`, a supported cycle raises unless ``max_depth`` bounds the nodes of a walk.
    """
    node = materialise(ends(g), "ends")
    held = node.select("graph_id", "node_id", F.explode("ids").alias("read"), "is_source", "is_sink")
    step = materialise(
        g.edges.select("graph_id", F.col("source_id").alias("node_id"), "sink_id")
        .join(held.select("graph_id", "node_id", "read"), ["graph_id", "node_id"])
        .join(held.select("graph_id", F.col("node_id").alias("sink_id"), "read", F.col("is_sink").alias("next_is_sink")), ["graph_id", "sink_id", "read"]), "read-steps")
    front = held.where("is_source").select("graph_id", "read", "node_id", "is_sink", F.array("node_id").alias("nodes"))
    done, depth = [], 1
    while True:
        done.append(front.where("is_sink"))
        if max_depth is not None and depth >= max_depth:
            break
        nxt = materialise(front.where("not is_sink").join(step, ["graph_id", "node_id", "read"]).select(
            "graph_id", "read", F.col("sink_id").alias("node_id"), F.col("next_is_sink").alias("is_sink"), F.concat("nodes", F.array("sink_id")).alias("nodes"),
            F.array_contains("nodes", F.col("sink_id")).alias("again")), f"read-front-{depth}")
        state = nxt.agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).first()
        if not state["n"]:
            break
        if state["again"] and max_depth is None:
            raise SupportedCycle("a cycle is supported by a common read; give max_depth to bound its walks")
        front, depth = nxt.drop("again"), depth + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("graph_id", "nodes").agg(F.countDistinct("read").alias("n_reads"))


def is_super(paths: DataFrame) -> DataFrame:
    """``paths`` with ``is_super``: two nodes or more. Every traversed path has a read that all its nodes share."""
    return paths.withColumn("is_super", F.size("nodes") >= 2)


def shares_read(node_reads: Column) -> Column:
    """Over an array of read-id arrays: two or more, with a read in all of them."""
    common = F.aggregate(F.slice(node_reads, F.lit(2), F.greatest(F.size(node_reads) - 1, F.lit(0))), F.get(node_reads, F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return (F.size(node_reads) >= 2) & (F.size(common) > 0)
