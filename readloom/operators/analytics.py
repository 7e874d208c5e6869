"""Per-graph analytics: degrees, connectivity, cycles, bubbles, topology, summary; all graphs in each job."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SUMMARY_COLUMNS
from ..schema import GraphSet
from ..storage import materialise
from . import wholes
from .bubbles import bubbles
from .traversal import is_super, traverse


def degrees(g: GraphSet) -> DataFrame:
    """(graph_id, node_id, in_degree, out_degree) of every node: one shuffle of both edge ends."""
    ends = g.edges.select("graph_id", F.inline(F.array(
        F.struct(F.col("source_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("sink_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    none = g.nodes.select("graph_id", "node_id", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return none.unionByName(ends).groupBy("graph_id", "node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def source_sink_counts(g: GraphSet) -> DataFrame:
    return degrees(g).groupBy("graph_id").agg(F.count_if(F.col("in_degree") == 0).alias("sources"), F.count_if(F.col("out_degree") == 0).alias("sinks"))


# --- connectivity and cycles ---------------------------------------------------------------------------------------


def _edges(g: GraphSet) -> DataFrame:
    return g.edges.select("graph_id", "source_id", "sink_id")


def _shapes_of_small(edges: DataFrame) -> DataFrame:
    schema = pa.schema([("graph_id", pa.string()), ("linked", pa.int64()), ("parts", pa.int64()), ("ring", pa.bool_())])

    def shapes_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b, graph, ids = wholes.numbered(t)
        n = len(graph)
        linked = np.bincount(graph, minlength=len(ids))
        parts = np.bincount(graph[np.unique(wholes.components(n, a, b))], minlength=len(ids))
        ring = np.bincount(graph[wholes.on_cycles(n, a, b)], minlength=len(ids)) > 0
        yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), pa.array(linked), pa.array(parts), pa.array(ring)], schema=schema)

    return wholes.solve(edges, shapes_of, "graph_id string, linked long, parts long, ring boolean")


def parts_by_labels(edges: DataFrame) -> DataFrame:
    """(graph_id, linked, parts): the nodes with edges and their connected parts, for graphs of any size.

    Nodes take the least label of their neighbours, and then the label of that label. A graph in which nothing changes is
    settled and leaves the rounds.
    """
    both = materialise(edges.unionByName(edges.select("graph_id", F.col("sink_id").alias("source_id"), F.col("source_id").alias("sink_id"))).distinct(), "neighbours")
    label = materialise(both.select("graph_id", F.col("source_id").alias("node_id")).distinct().withColumn("label", F.col("node_id")), "labels")
    settled = []
    while True:
        near = both.join(label.select("graph_id", F.col("node_id").alias("sink_id"), F.col("label").alias("l")), ["graph_id", "sink_id"]).groupBy(
            "graph_id", F.col("source_id").alias("node_id")).agg(F.min("l").alias("l"))
        least = label.join(near, ["graph_id", "node_id"]).select("graph_id", "node_id", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = label.select("graph_id", F.col("node_id").alias("label"), F.col("label").alias("far"))
        new = materialise(least.join(jump, ["graph_id", "label"]).select("graph_id", "node_id", "old", F.least("label", "far").alias("label")), "labels")
        moving = materialise(new.where("label <> old").select("graph_id").distinct(), "moving")
        settled.append(new.join(moving, "graph_id", "left_anti"))
        if not moving.take(1):
            break
        label = new.join(moving, "graph_id", "left_semi").drop("old")
    return reduce(DataFrame.unionByName, settled).groupBy("graph_id").agg(F.count(F.lit(1)).alias("linked"), F.countDistinct("label").alias("parts"))


def rings_by_rounds(edges: DataFrame) -> DataFrame:
    """(graph_id) of the graphs with a directed cycle, of any size.

    A round takes away edges that nothing leads to or that lead nowhere further, on both ends at once. A graph that loses
    none has a cycle: each of its edges can be followed for ever. So that long chains don't take a round per node, nodes
    with one edge in and one out are bridged, those that fall on heads while the node before them falls on tails.
    """
    left, turn, found = materialise(edges.distinct(), "unpeeled"), 0, []
    while left.take(1):
        into = left.select("graph_id", F.col("sink_id").alias("source_id")).distinct()
        onward = left.select("graph_id", F.col("source_id").alias("sink_id")).distinct()
        kept = materialise(left.join(into, ["graph_id", "source_id"], "left_semi").join(onward, ["graph_id", "sink_id"], "left_semi"), "unpeeled")
        sizes = lambda t, n: t.groupBy("graph_id").agg(F.count(F.lit(1)).alias(n))
        stuck = materialise(sizes(kept, "m").join(sizes(left, "n"), "graph_id").where("m = n").select("graph_id"), "cyclic")
        found.append(stuck)
        rest = kept.join(stuck, "graph_id", "left_anti").select("graph_id", "source_id", "sink_id")
        one_in = rest.groupBy("graph_id", F.col("sink_id").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("a")).where("n = 1")
        one_out = rest.groupBy("graph_id", F.col("source_id").alias("v")).agg(F.count(F.lit(1)).alias("m"), F.min("sink_id").alias("z")).where("m = 1")
        heads = lambda c: F.xxhash64("graph_id", c, F.lit(turn)).bitwiseAND(1) == 1  # noqa: E731, B023
        bridged = materialise(one_in.join(one_out, ["graph_id", "v"]).where((F.col("a") != F.col("v")) & heads("v") & ~heads("a")).select("graph_id", "v", "a", "z"), "bridged")
        gone = bridged.select("graph_id", F.col("v").alias("source_id"))
        rest = rest.join(gone, ["graph_id", "source_id"], "left_anti").join(gone.withColumnRenamed("source_id", "sink_id"), ["graph_id", "sink_id"], "left_anti")
        over = bridged.select("graph_id", F.col("a").alias("source_id"), F.col("z").alias("sink_id"))
        left, turn = materialise(rest.select(*over.columns).unionByName(over).distinct(), "unpeeled"), turn + 1
    return reduce(DataFrame.unionByName, found).distinct() if found else edges.select("graph_id").limit(0)


def shapes(g: GraphSet, small: int = wholes.SMALL) -> DataFrame:
    """(graph_id, is_connected, is_cyclic) of every graph.

    Weak connectivity, a graph without nodes being connected; a directed cycle anywhere, a self-loop being one. Graphs of
    up to ``small`` edges are settled whole in one shuffle, larger ones by rounds of joins.
    """
    few, many = wholes.by_size(_edges(g), small)
    found = _shapes_of_small(few)
    if many is not None:
        many = materialise(many, "large")
        rings = rings_by_rounds(many).withColumn("ring", F.lit(True))
        found = found.unionByName(parts_by_labels(many).join(rings, "graph_id", "left").withColumn("ring", F.coalesce("ring", F.lit(False))))
    nodes = g.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    none = lambda c: F.coalesce(c, F.lit(0))
    return g.graphs.select("graph_id").join(nodes, "graph_id", "left").join(found, "graph_id", "left").select(
        "graph_id", (none("nodes") - none("linked") + none("parts") <= 1).alias("is_connected"), F.coalesce("ring", F.lit(False)).alias("is_cyclic"))


def is_connected(g: GraphSet) -> DataFrame:
    """(graph_id, is_connected)."""
    return shapes(g).select("graph_id", "is_connected")


def is_cyclic(g: GraphSet) -> DataFrame:
    """(graph_id, is_cyclic)."""
    return shapes(g).select("graph_id", "is_cyclic")


def is_dag(g: GraphSet) -> DataFrame:
    """(graph_id, is_dag): connected and without a cycle."""
    return shapes(g).select("graph_id", (F.col("is_connected") & ~F.col("is_cyclic")).alias("is_dag"))


# --- topology and summary ------------------------------------------------------------------------------------------


def path_stats(g: GraphSet, paths: DataFrame) -> DataFrame:
    """(graph_id, paths, max_path_len, super_path) of every graph; zero, zero and false without a path."""
    stats = is_super(paths).groupBy("graph_id").agg(F.count(F.lit(1)).alias("p"), F.max(F.size("nodes")).cast("bigint").alias("m"), F.max("is_super").alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return g.graphs.select("graph_id").join(stats, "graph_id", "left").select(
        "graph_id", zero("p").alias("paths"), zero("m").alias("max_path_len"), F.coalesce("s", F.lit(False)).alias("super_path"))


def is_simple(g: GraphSet, paths: DataFrame) -> DataFrame:
    """(graph_id, is_simple): the longest path has two nodes."""
    return path_stats(g, paths).select("graph_id", (F.col("max_path_len") == 2).alias("is_simple"))


def is_bubble(g: GraphSet) -> DataFrame:
    found = bubbles(g).select("graph_id").distinct().withColumn("b", F.lit(True))
    return g.graphs.select("graph_id").join(found, "graph_id", "left").select("graph_id", F.coalesce("b", F.lit(False)).alias("is_bubble"))


def facts(g: GraphSet, paths: DataFrame) -> DataFrame:
    """What topology goes by: the columns of :func:`path_stats`, sources and sinks, a row per graph."""
    return path_stats(g, paths).join(source_sink_counts(g), "graph_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sources", "sinks")})


def topology(g: GraphSet, paths: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(graph_id, topology) of every graph. A single source and sink decide before bubbles are looked at.

    ``known``: the stored :func:`facts`, if they are at hand. Bubbles are sought only in graphs that they decide.
    """
    known = materialise(facts(g, paths), "facts") if known is None else known
    simple = F.when((F.col("sinks") == 1) & (F.col("sources") > 1), "FadeIn").when((F.col("sources") == 1) & (F.col("sinks") > 1), "FadeOut").when(
        (F.col("sources") > 1) & (F.col("sinks") > 1), "Bipartite").otherwise("NotDefined")
    unique = (F.col("sources") == 1) & (F.col("sinks") == 1)
    pairs = bubbles(g, only=known.where((F.col("max_path_len") != 2) & ~unique)).groupBy("graph_id").agg(F.max(F.size("path1") != F.size("path2")).alias("unequal"))
    other = F.when(unique, "UniquePath").when(F.col("unequal").isNull(), "NotDefined").when(F.col("unequal"), "HeteroPath").otherwise("EquiPath")
    return known.join(pairs, "graph_id", "left").select("graph_id", F.when(F.col("max_path_len") == 2, simple).otherwise(other).alias("topology"))


def has_topology(topologies: DataFrame, name: str) -> DataFrame:
    """(graph_id, matches) against one class."""
    return topologies.select("graph_id", (F.col("topology") == name).alias("matches"))


def summary(g: GraphSet, paths: DataFrame | None = None) -> DataFrame:
    """A row per graph with the columns of the CSV summary. The edge count is of distinct edge ids."""
    paths = materialise(traverse(g) if paths is None else paths, "paths")
    known = materialise(facts(g, paths), "facts")
    count = lambda t, n: t.groupBy("graph_id").agg(F.count(F.lit(1)).alias(n))
    out = known.join(count(g.nodes, "nodes"), "graph_id", "left").join(count(g.edge_aliases, "edges"), "graph_id", "left")
    out = out.join(shapes(g), "graph_id").join(topology(g, paths, known), "graph_id").withColumnRenamed("graph_id", "gid")
    zero = F.lit(0).cast("bigint")
    return out.withColumns({"nodes": F.coalesce("nodes", zero), "edges": F.coalesce("edges", zero)}).select(*SUMMARY_COLUMNS)
