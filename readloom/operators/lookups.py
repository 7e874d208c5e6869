"""Point lookups and listings; every one is a filter that Catalyst pushes to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_GRAPH
from ..schema import GraphSet


def _of(t: DataFrame, graph_id: str) -> DataFrame:
    return t.where(F.col("graph_id") == graph_id)


def graph(g: GraphSet, graph_id: str) -> GraphSet:
    """One graph as a collection; links that touch it stay."""
    return GraphSet(g.headers, *(_of(t, graph_id) for t in (g.graphs, g.nodes, g.edges, g.edge_aliases, g.groups)),
                    g.links.where((F.col("source_graph") == graph_id) | (F.col("target_graph") == graph_id)))


def default_graph(g: GraphSet) -> GraphSet:
    return graph(g, DEFAULT_GRAPH)


def nodes(g: GraphSet, graph_id: str) -> DataFrame:
    return _of(g.nodes, graph_id)


def edges(g: GraphSet, graph_id: str) -> DataFrame:
    """The edges of a graph's edge ids: an id that was overwritten by a parallel edge lists the surviving one."""
    kept = g.edges.withColumnRenamed("edge_id", "_kept")
    return _of(g.edge_aliases, graph_id).join(kept, ["file", "graph_id", "source_id", "sink_id"])


def node(g: GraphSet, graph_id: str, node_id: str) -> DataFrame:
    return nodes(g, graph_id).where(F.col("node_id") == node_id)


def edge(g: GraphSet, graph_id: str, edge_id: str) -> DataFrame:
    """The edge that an id leads to now."""
    return edges(g, graph_id).where(F.col("edge_id") == edge_id).drop("edge_id").withColumnRenamed("_kept", "edge_id")


def numbered(t: DataFrame) -> DataFrame:
    """``t`` with ``idx``, the place of a row in its graph, from 0."""
    return t.withColumn("idx", F.row_number().over(Window.partitionBy("graph_id").orderBy("ord")) - 1)


def node_indices(g: GraphSet) -> DataFrame:
    return numbered(g.nodes).select("graph_id", "idx", "node_id")


def edge_indices(g: GraphSet) -> DataFrame:
    return numbered(g.edges).select("graph_id", "idx", "edge_id")


def node_by_index(g: GraphSet, graph_id: str, idx: int) -> DataFrame:
    return numbered(nodes(g, graph_id)).where(F.col("idx") == idx)


def edge_by_index(g: GraphSet, graph_id: str, idx: int) -> DataFrame:
    return numbered(_of(g.edges, graph_id)).where(F.col("idx") == idx)


def chain_elements(g: GraphSet) -> DataFrame:
    """(graph_id, group_id, pos, id, is_node) of every chain."""
    return g.groups.where("kind = 'C'").select("graph_id", "group_id", F.posexplode("elements.id").alias("pos", "id")).withColumn("is_node", F.col("pos") % 2 == 0)


def _chain_part(g: GraphSet, known: DataFrame, is_node: bool) -> DataFrame:
    part = chain_elements(g).where(F.col("is_node") == is_node)
    found = part.join(known.withColumn("found", F.lit(True)), ["graph_id", "id"], "left")
    out = found.groupBy("graph_id", "group_id").agg(
        F.count_if(F.col("found").isNull()).alias("missing"), F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("p"))
    return out.where("missing = 0").select("graph_id", "group_id", F.transform("p", lambda x: x["id"]).alias("ids"))


def chain_nodes(g: GraphSet) -> DataFrame:
    """The node ids of each chain in order; chains with a missing node are left out."""
    return _chain_part(g, g.nodes.select("graph_id", F.col("node_id").alias("id")), True)


def chain_edges(g: GraphSet) -> DataFrame:
    """The edge ids of each chain in order; chains with a missing edge are left out."""
    return _chain_part(g, g.edge_aliases.select("graph_id", F.col("edge_id").alias("id")), False)
